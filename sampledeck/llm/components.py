"""Connected components of a table of links, and the pieces that operators share for it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

#: Links that one task may join up at the end; beyond, rounds of star operations go on.
LAST_LINKS = 20_000
_LINKS = "src long, dst long"


def labels_of(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For nodes 0..n-1 and links a[i]-b[i] the smallest node that each reaches."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        new = np.minimum(new, label)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
        apart = label[a] != label[b]
        a, b = a[apart], b[apart]
    while not np.array_equal(label, label[label]):
        label = label[label]
    return label


#: Links that a worker contracts at once.
HELD_LINKS = 1 << 21


def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A partition's links as links to the smallest node each reaches among those held at once."""
    held, n = [], 0

    def contracted() -> pa.RecordBatch:
        src, dst = (np.concatenate([np.asarray(b.column(k)) for b in held]) for k in (0, 1))
        nodes, at = np.unique(np.concatenate([src, dst]), return_inverse=True)
        root = nodes[labels_of(len(nodes), at[: len(src)], at[len(src) :])]
        apart = root != nodes
        return pa.record_batch([pa.array(nodes[apart]), pa.array(root[apart])], ["src", "dst"])

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            n += batch.num_rows
            if n >= HELD_LINKS:
                yield contracted()
                held, n = [], 0
    if held:
        yield contracted()


def star_round(links: DataFrame) -> DataFrame:
    """One large-star and one small-star step: every node's links move to its smallest neighbour.
    The joins are plain equi-joins, which Spark splits where a node has very many links."""
    both = links.union(links.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    least = both.groupBy("src").agg(F.least(F.min("dst"), F.col("src")).alias("low"))
    large = both.filter("dst > src").join(least, "src").select(F.col("dst").alias("src"), F.col("low").alias("dst")).filter("src > dst").distinct()
    low = large.groupBy("src").agg(F.min("dst").alias("low"))
    return large.join(low, "src").select(F.greatest("dst", F.when(F.col("dst") == F.col("low"), F.col("src")).otherwise(F.col("dst"))).alias("src"), F.col("low").alias("dst")).filter("src > dst").distinct()


def components(links: DataFrame) -> DataFrame:
    """Rows (node, component) for every node of links (src, dst long, not null), component being
    the smallest node that it reaches. No links give no rows; repeated links and links of a node
    to itself change nothing."""
    links = written(links.select("src", "dst").mapInArrow(contract, _LINKS), "links")
    state = None
    while True:
        n, now = links.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("src", "dst")), F.lit(0))).first()
        if n <= LAST_LINKS:
            links = written(links.coalesce(1).mapInArrow(contract, _LINKS), "links")
            break
        if (n, now) == state:
            break
        state = (n, now)
        links = written(star_round(links), "links")
    stars = links.select(F.col("src").alias("node"), F.col("dst").alias("component"))
    return stars.union(stars.select(F.col("component").alias("node"), "component").distinct())
