"""Near-duplicates by the Jaccard similarity of their sets of word shingles.

Candidates are first those that operator 4's method finds: SimHash fingerprints, here of the sets,
whose chains of DISTANCE bits or fewer multi-index hashing connects.  Many pairs at the threshold
differ in more bits, more than balls can cover, so texts that share a band of ROWS MinHash values are
candidates, too.  Two texts of similarity s agree in a value with chance s, so with 48 bands of 5 a
pair at 0.8 shares none with chance (1 - 0.8^5)^48 = 5e-9, more similar pairs far less.  Every
candidate is verified by the exact similarity of the two sets.  Documents with equal sets are one
node.  In each group, of fingerprints or of a band, the nodes are first compared with one of
them, the pivot; groups that these links leave in several components are compared with another pivot,
ROUNDS times at most; the pairs that are still in different components are compared after that, in
blocks where a group is large, so near copies of one text never meet pair by pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, give_back, text_column, written
from .components import components
from .simhash import fingerprint_links, print_of

WORDS, BANDS, ROWS = 5, 48, 5
#: Bits that two fingerprints which link may differ in.
DISTANCE = 3
#: Similarity from which texts are near-duplicates, as a fraction of whole numbers.
NEAR = (4, 5)
#: Nodes of a band's group that a join pairs; larger groups go to blocks.
KEY_LIMIT = 16
#: Times that the groups left apart are compared with one of their nodes before their pairs are.
ROUNDS = 5
#: Nodes in a block.
BLOCK = 512
_FACTORS = np.random.default_rng(20).integers(0, 1 << 64, (2, BANDS * ROWS), dtype=np.uint64) | np.uint64(1)


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a lower-cased text's word shingles; a text of fewer words is
    one shingle, as is a null or empty one."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
    joined, n = b" ".join(tokens), max(1, len(tokens) - words + 1)
    if n == 1:
        return np.array([xxhash.xxh64_intdigest(joined, 42)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    stops, starts = ends[-n:].tolist(), [0, *(ends[: n - 1] + 1).tolist()]
    hashed = xxhash.xxh64_intdigest
    return np.unique(np.array([hashed(joined[a:b], 42) for a, b in zip(starts, stops, strict=True)], np.uint64))


def node_of(found: np.ndarray) -> int:
    return int(np.array(xxhash.xxh64_intdigest(found.tobytes(), 7), np.uint64).view(np.int64))


def band_keys(found: np.ndarray) -> np.ndarray:
    """A long for each band."""
    least, step = np.empty(BANDS * ROWS, np.uint64), max(1, (1 << 18) // len(found))
    for k in range(0, len(least), step):
        x = found[None, :] * _FACTORS[0, k : k + step, None]
        x ^= x >> np.uint64(32)
        x *= _FACTORS[1, k : k + step, None]
        least[k : k + step] = x.min(1)
    return np.array([xxhash.xxh64_intdigest(row.tobytes(), k) for k, row in enumerate(least.reshape(BANDS, ROWS))], np.uint64).view(np.int64)


def signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in parts_of(batch):
            nodes, prints, keys = [], [], []
            for text in part.column("text"):
                found = shingles(text.as_py())
                nodes.append(node_of(found))
                prints.append(print_of(found))
                keys.append(band_keys(found))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1, dtype=np.int32) * BANDS), pa.array(np.concatenate(keys)))
            yield pa.record_batch([part.column("doc_id"), part.column("row_key"), pa.array(nodes, pa.int64()), pa.array(np.array(prints, np.uint64).view(np.int64)), lists], ["doc_id", "row_key", "node", "fp", "keys"])
        give_back()


def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in parts_of(batch):
            found = [shingles(text.as_py()) for text in part.column("text")]
            ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found).view(np.int64)))
            yield pa.record_batch([pa.array([node_of(x) for x in found], pa.int64()), lists], ["node", "held"])
        give_back()


def parts_of(batch: pa.RecordBatch, rows: int = 256) -> list[pa.RecordBatch]:
    """Few rows at a time, so that a worker holds few sets."""
    return [batch.slice(k, rows) for k in range(0, batch.num_rows, rows)]


def verified(pairs: DataFrame, held: DataFrame) -> DataFrame:
    """The pairs (src, dst) that are near, by their sets in held (node, held)."""
    right = held.select(F.col("node").alias("dst"), F.col("held").alias("b"))
    left = held.select(F.col("node").alias("src"), F.col("held").alias("a"))
    both = F.size("a") + F.size("b")
    shared = F.size(F.array_intersect("a", "b"))
    return pairs.join(right, "dst").join(left, "src").filter(shared * (NEAR[0] + NEAR[1]) >= both * NEAR[0]).select("src", "dst")


def block_links(table: pa.Table) -> pa.Table:
    """Links between near nodes of different roots in a block or a pair of blocks."""
    nodes, first = np.unique(np.asarray(table.column("node")), return_index=True)
    roots = np.asarray(table.column("root"))[first]
    held = [np.asarray(table.column("held")[int(k)].values) for k in first]
    sizes = np.array([len(x) for x in held])
    owner, values = np.repeat(np.arange(len(nodes)), sizes), np.concatenate(held)
    order = np.argsort(values, kind="stable")
    owner, values = owner[order], values[order]
    kinds, at = np.unique(roots, return_inverse=True)
    most = np.argmax(np.bincount(at))  # of every pair looked for, one node has another root than this
    src, dst = [], []
    for k in np.flatnonzero(at != most).tolist():
        low, high = np.searchsorted(values, held[k], "left"), np.searchsorted(values, held[k], "right")
        total = np.zeros(len(nodes), np.int64)
        for a, b in zip(low.tolist(), high.tolist(), strict=True):
            total[owner[a:b]] += 1
        near = np.flatnonzero((total * (NEAR[0] + NEAR[1]) >= (sizes + sizes[k]) * NEAR[0]) & (at != at[k]))
        src += [k] * len(near)
        dst += near.tolist()
    return pa.table({"src": pa.array(nodes[np.array(src, np.int64)]), "dst": pa.array(nodes[np.array(dst, np.int64)])})


def near_links(members: DataFrame, sets_of) -> DataFrame:
    """Links (src, dst) that connect the nodes that chains of near pairs connect, for members (key,
    node): the nodes under each key of two or more. sets_of(nodes) gives the sets (node, held) of a
    table of nodes."""
    held = written(sets_of(members.select("node").distinct()), "shingle-sets")
    left, links, before = members.withColumn("root", F.col("node")), None, None
    for turn in range(ROUNDS):
        # one order of all nodes, so that the groups of a text's bands choose alike
        first = F.min_by(F.struct("node", "root"), F.xxhash64("node", F.lit(turn)))
        pivots = left.groupBy("key").agg(first.alias("pivot"))
        stars = left.join(pivots, "key").filter(F.col("root") != F.col("pivot.root")).select(F.col("node").alias("src"), F.col("pivot.node").alias("dst")).distinct()
        found = written(verified(stars, held), "star-links")
        links = found if links is None else links.union(found)
        roots = written(components(links), "star-roots")
        rooted = left.drop("root").join(roots, "node", "left").select("key", "node", F.coalesce("component", "node").alias("root"))
        apart = written(rooted.groupBy("key").agg(F.count("*").alias("n"), F.min("root").alias("r"), F.max("root").alias("s")).filter("r <> s").select("key", "n"), "keys-apart")
        left = written(rooted.join(apart, "key"), "nodes-apart")
        n, most = left.agg(F.count("*"), F.coalesce(F.max("n"), F.lit(0))).first()
        if most <= KEY_LIMIT or before is not None and n > 0.9 * before:
            break
        before, left = n, left.drop("n") if turn < ROUNDS - 1 else left
    few, many = left.filter(F.col("n") <= KEY_LIMIT), left.filter(F.col("n") > KEY_LIMIT)
    pairs = few.alias("p").join(few.alias("c"), "key").filter("p.node < c.node and p.root <> c.root").select(F.col("p.node").alias("src"), F.col("c.node").alias("dst")).distinct()
    links = links.union(verified(pairs, held))
    if not many.isEmpty():
        blocks = F.ceil(F.col("n") / BLOCK).cast("int")
        split = many.withColumn("b", F.pmod(F.xxhash64("node"), blocks).cast("int"))
        split = split.withColumn("o", F.explode(F.sequence(F.lit(0), blocks - 1))).select("key", F.least("b", "o").alias("low"), F.greatest("b", "o").alias("high"), "node", "root")
        links = links.union(split.join(held, "node").groupBy("key", "low", "high").applyInArrow(block_links, "src long, dst long"))
    return links


def shared(members: DataFrame, name: str) -> DataFrame:
    """Of members (key, node) those under keys of two nodes or more, each once."""
    keys = written(members.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high")).filter("low <> high").select("key"), f"shared-{name}")
    return written(members.join(keys, "key").select("key", "node").distinct(), f"{name}-members")


def print_members(marks: DataFrame) -> DataFrame:
    """(key, node) of the nodes of marks (node, fp) whose fingerprints are equal or linked by chains."""
    prints = marks.select("fp", "node").distinct()
    roots = components(fingerprint_links(written(prints.select("fp").distinct(), "prints"), DISTANCE))
    return shared(prints.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(F.coalesce("component", "fp").alias("key"), "node"), "print")


def band_members(marks: DataFrame) -> DataFrame:
    """(key, node) of the nodes of marks (node, keys) that share a band."""
    return shared(marks.select("node", F.explode("keys").alias("key")), "band")


def marked_rows(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of docs: doc_id, row_key (a hash of the text, which tells rows of one doc_id apart),
    component_id as in near_groups(), and stays: whether it is its group's first by doc_id (null
    last) and row_key."""
    rows = text_column(docs, text).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    rows = rows.withColumn("row_key", F.xxhash64(F.coalesce("text", F.lit(""))))
    marks = written(rows.mapInArrow(signatures, "doc_id long, row_key long, node long, fp long, keys array<long>"), "signatures")
    members = print_members(marks).unionByName(band_members(marks))

    def sets_of(nodes: DataFrame) -> DataFrame:
        wanted = written(nodes, "candidates")
        return rows.select("text").mapInArrow(sets, "node long, held array<long>").join(wanted, "node", "left_semi").dropDuplicates(["node"])

    roots = components(near_links(members, sets_of))
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key")
    classes = marks.groupBy("node").agg(F.min(first).alias("first"))
    grouped = written(classes.join(roots, "node", "left").select("node", "first", F.coalesce("component", "node").alias("root")), "near-groups")
    of_root = grouped.groupBy("root").agg(F.min("first").alias("best"))
    out = marks.select("doc_id", "row_key", "node").join(grouped.join(of_root, "root").select("node", "best"), "node")
    return out.select("doc_id", "row_key", F.col("best.doc_id").alias("component_id"), (F.col("doc_id").eqNullSafe(F.col("best.doc_id")) & (F.col("row_key") == F.col("best.row_key"))).alias("stays"))


def near_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of docs: doc_id and component_id, the smallest doc_id that chains of texts with a
    similarity of 0.8 or more reach, its own included.

    Null text counts as empty; texts without words are near-duplicates of one another. Repeated rows
    each get a row. A null doc_id gets its group's smallest id, or null if the group has none.
    """
    return marked_rows(docs, doc_id, text).select("doc_id", "component_id")


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """docs without the near-duplicates: of each group the row with the smallest doc_id (null last)
    stays, of several texts under that id one. Rows that repeat both id and text are one document,
    and stay or go together."""
    key, id_, gone_key = fresh(docs, "_key"), fresh(docs, "_id"), fresh(docs, "_gone")
    # written, so that Spark knows its size: a small one is broadcast and no text is shuffled
    gone = written(marked_rows(docs).filter(~F.col("stays")).select(F.col("doc_id").alias(id_), F.col("row_key").alias(gone_key)).distinct(), "near-duplicates")
    marked = docs.withColumn(key, F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))))
    return marked.join(gone, F.col("doc_id").cast("long").eqNullSafe(F.col(id_)) & (F.col(key) == F.col(gone_key)), "left_anti").select(*docs.columns)
