"""Files that tasks write to and read from the shared folder, through pyarrow's file systems.

A task writes under a name of its own, so a repeated or speculative attempt never touches another's
file; which files count is what the table of the task's results says, and Spark commits that once.
"""

from __future__ import annotations

import uuid

from pyarrow import fs


def opened(url: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(url if "://" in url or url.startswith("file:") else f"file://{url}")


class Writer:
    """A new file in folder (a URL), with the position reached."""

    def __init__(self, folder: str, suffix: str) -> None:
        self.url = f"{folder}/{uuid.uuid4().hex}{suffix}"
        system, path = opened(self.url)
        system.create_dir(path.rsplit("/", 1)[0], recursive=True)
        self.out, self.position = system.open_output_stream(path, compression=None), 0

    def write(self, data: bytes) -> int:
        """Appends; returns where data begins."""
        at, self.position = self.position, self.position + len(data)
        self.out.write(data)
        return at

    def close(self) -> None:
        self.out.close()


class Reader:
    """Range reads of one file."""

    def __init__(self, url: str) -> None:
        system, path = opened(url)
        self.file = system.open_input_file(path)

    def read(self, at: int, length: int) -> bytes:
        data = self.file.read_at(length, at)
        if len(data) != length:
            raise EOFError(f"{length} bytes wanted at {at}, {len(data)} there")
        return data

    def close(self) -> None:
        self.file.close()
