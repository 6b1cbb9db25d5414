"""The trie of conversations' prefixes (operator 12).

A conversation is a sequence of turns (role, text); a node is a distinct sequence of first turns.

Turns.  A turn is named by a hash of role and text; texts of one hash are compared with one of them
and those that differ get numbers of their own, so (hash, number) is the turn exactly.  Conversations
are put in order by a range partitioning over (conversation, turn), which cuts long ones, too.

Prefixes.  The fingerprint of a prefix is the sum of its turns' values times powers of a base, modulo
2^61 - 1, so it is a running sum: numpy scans blocks of BLOCK turns, and blocks' sums are scanned the
same way.  Rows of equal depth and fingerprint are a candidate group.  Each of its members is verified
against the group's representative, turn by turn: the last turn must be the same and what precedes it
must be in the same group of the depth before.  Where a member differs the group is split, and so is
what follows it: its rows are told apart by the turns at which their groups were split.

Rollup.  Every conversation has a random label, and a node belongs to the smallest label of its
members, so the nodes of a label are a chain, downwards to that conversation's end.  On a path down
the labels are running minima of nested sets, so it crosses about ln(conversations) chains, however
deep it is.  Sums over subtrees are sums over chains by doubling, and one more running sum within each.
Groups with very many members are only ever counted, never collected.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import dense_number, give_back, written

#: Turns, or nodes of a chain, that are scanned as one.
BLOCK = 4096
#: Conversations of a node in a piece of the list that is hashed.
PIECE = 1024
PRIME = (1 << 61) - 1
#: The base of fingerprints, and what turns' hashes are mixed with.
BASE, MIX = 0x1B873593CC9E2D51 % PRIME, np.uint64(0x9E3779B97F4A7C15)
#: Columns that tell a node.
NODE = ["depth", "print", "tag"]


def times(a: np.ndarray, b: np.ndarray | np.uint64) -> np.ndarray:
    """a * b modulo PRIME, of numbers below it, by halves of 31 bits."""
    low, thirty, shift = np.uint64((1 << 31) - 1), np.uint64((1 << 30) - 1), np.uint64(31)
    ah, al, bh, bl = a >> shift, a & low, b >> shift, b & low
    mid = al * bh + ah * bl
    out = ((ah * bh) << np.uint64(1)) + (mid >> np.uint64(30)) + ((mid & thirty) << shift) + al * bl
    return reduced(out)


def reduced(a: np.ndarray) -> np.ndarray:
    """uint64 modulo PRIME."""
    return a % np.uint64(PRIME)


def power(exponents: np.ndarray) -> np.ndarray:
    """BASE to those powers."""
    out, square, left = np.ones(len(exponents), np.uint64), np.uint64(BASE), exponents.astype(np.uint64)
    while left.any():
        out = np.where(left & np.uint64(1) > 0, times(out, square), out)
        square, left = times(np.array([square]), square)[0], left >> np.uint64(1)
    return out


def running(values: np.ndarray, begins: np.ndarray, before: int, modular: bool) -> np.ndarray:
    """Sums up to each place since the last of begins (first places of groups), the values ahead of
    the first one after `before`."""
    group = np.searchsorted(begins, np.arange(len(values)), "right")
    low, high = values & 0xFFFFFFFF, values >> 32

    def summed(x: np.ndarray) -> np.ndarray:
        total = np.append(0, np.cumsum(x))
        return total[1:] - total[np.append(0, begins)][group]

    if not modular:
        return np.cumsum(np.append(0, values))[1:] - np.append(0, np.cumsum(values))[np.append(0, begins)][group] + np.where(group == 0, before, 0)
    out = reduced(summed(low).astype(np.uint64)) + times(reduced(summed(high).astype(np.uint64)), np.uint64(1 << 32)) + np.where(group == 0, np.uint64(before), np.uint64(0))
    return reduced(out).astype(np.int64)


def scan_sorted(keys: list[str], columns: list[str], modular: bool):
    """Rows in order, with sums of the columns since the keys changed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, sums = None, dict.fromkeys(columns, 0)
        for batch in batches:
            if not batch.num_rows:
                continue
            own = [np.asarray(batch.column(batch.schema.get_field_index(k))) for k in keys]
            changed = np.zeros(batch.num_rows, bool)
            for k in own:
                changed[1:] |= k[1:] != k[:-1]
            changed[0] = last != tuple(k[0] for k in own)
            begins = np.flatnonzero(changed)
            out = list(batch.columns)
            for c in columns:
                values = running(np.asarray(batch.column(batch.schema.get_field_index(c))), begins, sums[c], modular)
                sums[c] = int(values[-1])
                out.append(pa.array(values))
            last = tuple(k[-1] for k in own)
            yield pa.record_batch(out, [*batch.schema.names, *(f"{c}_sum" for c in columns)])

    return run


def scan(rows: DataFrame, keys: list[str], place: str, columns: list[str], modular: bool) -> DataFrame:
    names = ", ".join([f"`{c}` {t}" for c, t in rows.dtypes] + [f"`{c}_sum` long" for c in columns])
    return rows.repartition(*keys).sortWithinPartitions(*keys, place).mapInArrow(scan_sorted(keys, columns, modular), names)


def running_sums(rows: DataFrame, key: str, place: str, columns: list[str], modular: bool, name: str) -> DataFrame:
    """rows with {column}_sum for the columns: their sums over the rows of the key up to this place.
    Places of a key are whole numbers without gaps. Blocks of places are scanned each on its own,
    then the blocks' sums, so a key of any length is dealt out."""
    block = F.floor(F.col(place) / BLOCK)
    done = written(scan(rows.withColumn("_block", block), [key, "_block"], place, columns, modular), name)
    sums = [f"{c}_sum" for c in columns]
    ends = done.filter(F.col(place) % BLOCK == BLOCK - 1).select(key, "_block", *[F.col(f"{c}_sum").alias(c) for c in columns])
    carried = scan(ends, [key], "_block", columns, modular).select(F.col(key), (F.col("_block") + 1).alias("_block"), *[F.col(c).alias(f"{c}_carry") for c in sums])
    plus = lambda a, b: (a + b) % F.lit(PRIME) if modular else a + b
    high = done.filter(F.col(place) >= BLOCK).join(carried, [key, "_block"], "left")
    high = high.withColumns({c: plus(F.col(c), F.coalesce(F.col(f"{c}_carry"), F.lit(0))) for c in sums}).select(*done.columns)
    return done.filter(F.col(place) < BLOCK).unionByName(high).drop("_block")


def numbered_turns(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", hash_values: int | None = None) -> DataFrame:
    """Rows (conv_id, place, hash, number, n_bytes): the turns of each conversation from place 1 on, in
    order of turn, null first, and of (hash, number) where turns are equal. Null roles and texts are
    empty ones; rows without a conversation's id belong to none and are left out. hash_values: how
    many hashes there are, for tests of equal ones."""
    rows = conversations.select(F.col(conv_id).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"), *(F.coalesce(F.col(a).cast("string"), F.lit("")).alias(b) for a, b in ((role, "role"), (text, "text")))).filter("conv_id is not null")
    hashed = F.xxhash64("role", "text")
    rows = rows.withColumn("hash", F.pmod(hashed, F.lit(hash_values)) if hash_values else hashed).withColumn("n_bytes", F.octet_length("text").cast("long"))
    # written, so that Spark can split a hash that very many turns have when it joins
    first = written(rows.groupBy("hash").agg(F.min(F.struct("role", "text")).alias("first")), "first-turns")
    same = (F.col("role") == F.col("first.role")) & (F.col("text") == F.col("first.text"))
    compared = rows.join(first, "hash").select("conv_id", "turn", "hash", "n_bytes", F.when(same, 0).cast("long").alias("number"), *(F.when(~same, F.col(c)).alias(c) for c in ("role", "text")))
    compared = written(compared, "turns")
    others = compared.filter("number is null").drop("number")
    named = others.select("hash", "role", "text").distinct().withColumn("number", F.row_number().over(Window.partitionBy("hash").orderBy("role", "text")).cast("long"))
    columns = ["conv_id", "turn", "hash", "number", "n_bytes"]
    exact = compared.filter("number is not null").select(*columns).unionByName(others.join(named, ["hash", "role", "text"]).select(*columns))
    ordered = dense_number(exact, [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("hash"), F.col("number")], "at")
    begins = ordered.groupBy("conv_id").agg(F.min("at").alias("begin"))
    return written(ordered.join(begins, "conv_id").select("conv_id", (F.col("at") - F.col("begin") + 1).alias("place"), "hash", "number", "n_bytes"), "placed-turns")


def fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with value: what a turn adds to the fingerprint at its depth."""
    for batch in batches:
        get = lambda c: np.asarray(batch.column(batch.schema.get_field_index(c)))  # noqa: E731, B023
        mixed = (get("hash").view(np.uint64) ^ (get("number").astype(np.uint64) * MIX)) * MIX
        mixed ^= mixed >> np.uint64(29)
        value = times(reduced(mixed), power(get("depth"))).astype(np.int64)
        yield pa.record_batch([*batch.columns, pa.array(value)], [*batch.schema.names, "value"])


def with_prints(turns: DataFrame, print_values: int) -> DataFrame:
    """turns with print, before: fingerprints of the prefix that a turn ends, and of the one before."""
    names = ", ".join(f"`{c}` {t}" for c, t in turns.dtypes) + ", value long"
    summed = running_sums(turns.mapInArrow(fingerprints, names), "conv_id", "depth", ["value"], True, "prefixes")
    before = F.pmod(F.col("value_sum") - F.col("value"), F.lit(PRIME))
    cut = lambda x: x % F.lit(print_values)
    return summed.withColumns({"print": cut(F.col("value_sum")), "before": cut(before)}).drop("value", "value_sum")


def candidates(rows: DataFrame) -> DataFrame:
    """A row for each group: its members' count, smallest id, label and whether they are all verified."""
    found = rows.groupBy(*NODE).agg(
        F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.min(F.xxhash64("conv_id")).alias("chain"), F.max("n_bytes").alias("n_bytes"), F.min("before").alias("before"), F.min("before_tag").alias("before_tag"),
        *(f(c).alias(f"{c}_{k}") for c in ("hash", "number", "before", "before_tag") for k, f in (("least", F.min), ("most", F.max))),
    )
    alike = [F.col(f"{c}_least") == F.col(f"{c}_most") for c in ("hash", "number", "before", "before_tag")]
    return found.select(*NODE, "conv_id", "n_convs", "chain", "n_bytes", "before", "before_tag", (alike[0] & alike[1] & alike[2] & alike[3]).alias("verified"))


def split(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """rows of groups that aren't verified, and of what follows in their conversations, with tags: what
    the turns at which a conversation's groups are split look like, to this depth. Rows of one depth,
    fingerprint and tag are of equal prefixes then: of equal tags, every group on the way down either
    holds one continuation only or names it."""
    at = rows.join(groups.filter("not verified").select(*NODE), NODE)
    look = F.concat_ws(":", "depth", "hash", "number", "before")
    tags = at.groupBy("conv_id").agg(F.collect_list(F.struct("depth", look.alias("look"))).alias("tags"))
    joined = rows.join(tags, "conv_id", "left")
    upto = lambda most: F.concat_ws(",", F.transform(F.filter(F.array_sort("tags"), lambda t: t["depth"] <= most), lambda t: t["look"]))
    here = lambda most: F.coalesce(F.when(F.col("tags").isNotNull(), upto(most)), F.lit(""))
    return joined.withColumns({"tag": here(F.col("depth")), "before_tag": here(F.col("depth") - 1)}).drop("tags")


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of node and conversation as pieces of their nodes' lists."""
    for batch in batches:
        if not batch.num_rows:
            continue
        depth, prints, ids = (np.asarray(batch.column(k)) for k in (0, 1, 3))
        tag = np.asarray(batch.column(2).dictionary_encode().indices)
        begins = np.flatnonzero(np.append(True, (np.diff(depth) != 0) | (np.diff(prints) != 0) | (np.diff(tag) != 0)))
        begins = np.concatenate([np.arange(a, b, PIECE) for a, b in zip(begins, np.append(begins[1:], len(ids)), strict=True)])
        spelled = ids.astype(str).tolist()
        lists = [",".join(spelled[a:b]).encode() for a, b in zip(begins.tolist(), [*begins[1:].tolist(), len(ids)], strict=True)]
        at = pa.array(begins)
        yield pa.record_batch([*(batch.column(k).take(at) for k in range(4)), pa.array(lists, pa.binary())], [*NODE, "first", "ids"])


def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces in order as a hash for each node; holds one state."""
    node, state, done = None, None, []

    def rows() -> pa.RecordBatch:
        return pa.record_batch([pa.array([x[0] for x in done], pa.int64()), pa.array([x[1] for x in done], pa.int64()), pa.array([x[2] for x in done], pa.string()), pa.array([x[3] for x in done], pa.string())], [*NODE, "ends_sha256"])

    for batch in batches:
        for *own, ids in zip(*(batch.column(k).to_pylist() for k in (0, 1, 2, 4)), strict=True):
            if own != node:
                if state:
                    done.append((*node, state.hexdigest()))
                node, state = own, hashlib.sha256(ids)
            else:
                state.update(b"," + ids)
        if done:
            yield rows()
            done = []
    if state:
        done.append((*node, state.hexdigest()))
        yield rows()
    give_back()


def ends_of(ends: DataFrame) -> DataFrame:
    """NODE and ends_sha256 for rows (NODE, conv_id) of the node with which a conversation ends."""
    listed = ends.select(*NODE, "conv_id").repartitionByRange(*NODE, "conv_id").sortWithinPartitions(*NODE, "conv_id").mapInArrow(pieces, "depth long, print long, tag string, first long, ids binary")
    return listed.repartition(*NODE).sortWithinPartitions(*NODE, "first").mapInArrow(digests, "depth long, print long, tag string, ends_sha256 string")


def chain_totals(chains: DataFrame) -> DataFrame:
    """chain, leaves, saved: sums over all chains at or below, of rows (chain, up, leaves, saved), up
    being the chain that one hangs from, null for the root's. After k rounds sums reach 2^k chains
    down and up is the chain that many up."""
    state = chains
    while not state.filter("up is not null").isEmpty():
        gain = state.filter("up is not null").groupBy(F.col("up").alias("chain")).agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
        above = state.select(F.col("chain").alias("up"), F.col("up").alias("next"))
        added = state.join(gain, "chain", "left").join(above, "up", "left")
        state = written(added.select("chain", F.col("next").alias("up"), *((F.col(c) + F.coalesce(F.col(f"more_{c}"), F.lit(0))).alias(c) for c in ("leaves", "saved"))), "chains")
    return state.select("chain", F.col("leaves").alias("all_leaves"), F.col("saved").alias("all_saved"))


def trie(turns: DataFrame, conversations: DataFrame, print_values: int = PRIME) -> DataFrame:
    """Per node: conv_id (its smallest member), depth, parent_conv_id (null for the root), n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256; see op12.

    turns: rows (conv_id, depth, hash, number, n_bytes), the depths of a conversation being 1, 2, ... its
    length; conversations: (conv_id, length), each once, with those of no turns. No conversations
    give no nodes, not even the root. print_values: how many fingerprints are told apart, for tests.
    """
    told = with_prints(turns.select("conv_id", F.col("depth").cast("long").alias("depth"), "hash", "number", "n_bytes"), print_values)
    rows = written(told.withColumns({"tag": F.lit(""), "before_tag": F.lit("")}), "prints")
    groups = written(candidates(rows), "groups")
    if not groups.filter("not verified").isEmpty():
        rows = written(split(rows, groups), "split-prints")
        groups = written(candidates(rows), "split-groups")
    lengths = conversations.select("conv_id", F.col("length").cast("long").alias("length"))
    root = lengths.groupBy().agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.min(F.xxhash64("conv_id")).alias("chain")).filter("n_convs > 0")
    top = {"depth": F.lit(0).cast("long"), "print": F.lit(0).cast("long"), "tag": F.lit("")}
    root = root.withColumns({**top, "n_bytes": F.lit(0).cast("long"), "before": F.lit(None).cast("long"), "before_tag": F.lit(None).cast("string")})
    nodes = groups.drop("verified").unionByName(root)
    above = nodes.select((F.col("depth") + 1).alias("depth"), F.col("print").alias("before"), F.col("tag").alias("before_tag"), F.col("conv_id").alias("parent_conv_id"), F.col("chain").alias("up"))
    linked = written(nodes.join(above, ["depth", "before", "before_tag"], "left").drop("before", "before_tag"), "nodes")
    children = linked.filter("parent_conv_id is not null").groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    counted = linked.join(children, ["conv_id", "depth"], "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    valued = written(counted.withColumns({"leaves": (F.col("n_children") == 0).cast("long"), "saved": (F.col("n_convs") - 1) * F.col("n_bytes")}), "valued-nodes")
    hung = F.when(F.col("up") != F.col("chain"), F.col("up"))
    chains = written(valued.groupBy("chain").agg(F.max(hung).alias("up"), F.min("depth").alias("top"), F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")), "chains")
    totals = written(chain_totals(chains.drop("top")), "chain-totals")
    hanging = chains.filter("up is not null").join(totals, "chain").groupBy(F.col("up").alias("chain"), (F.col("top") - 1).alias("depth")).agg(F.sum("all_leaves").alias("more_leaves"), F.sum("all_saved").alias("more_saved"))
    whole = valued.join(hanging, ["chain", "depth"], "left").withColumns({c: F.col(c) + F.coalesce(F.col(f"more_{c}"), F.lit(0)) for c in ("leaves", "saved")}).drop("up", "more_leaves", "more_saved", "n_bytes")
    summed = running_sums(whole, "chain", "depth", ["leaves", "saved"], False, "chain-sums").join(totals, "chain")
    below = {"n_leaves": F.col("all_leaves") - F.col("leaves_sum") + F.col("leaves"), "saved_tokens": F.col("all_saved") - F.col("saved_sum") + F.col("saved")}
    last = rows.join(lengths, "conv_id").filter("depth = length").select(*NODE, "conv_id")
    none = lengths.filter("length = 0").select(*(v.alias(k) for k, v in top.items()), "conv_id")
    ends = ends_of(last.unionByName(none))
    empty = F.lit(hashlib.sha256(b"").hexdigest())
    out = summed.withColumns(below).join(ends, NODE, "left").withColumn("ends_sha256", F.coalesce("ends_sha256", empty))
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def prefix_trie(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The trie of the conversations as they are; see trie(). Ties, nulls and repeated rows are as
    numbered_turns() says: repeated rows are turns of their own. Other columns are ignored."""
    turns = numbered_turns(conversations, conv_id, turn, role, text)
    return trie(turns.withColumnRenamed("place", "depth"), turns.groupBy("conv_id").agg(F.max("place").alias("length")))


def rebuilt(turns: DataFrame, siblings: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """(turns, conversations) as trie() takes them, of conversations that begin like another: the
    first h turns of c - c % siblings (all if it has fewer, none if it isn't there), then c's own
    after its first h, h being crc32 of c in decimal, modulo `most`. % is that of SQL: it takes its
    sign from c."""
    own = turns.groupBy("conv_id").agg(F.max("place").alias("n"))
    base = F.col("conv_id") - F.col("conv_id") % siblings
    drawn = own.withColumns({"base": base, "h": F.crc32(F.col("conv_id").cast("string").cast("binary")) % most})
    taken = F.least("h", F.coalesce("base_n", F.lit(0)))
    joined = drawn.join(own.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n")), "base", "left").withColumn("taken", taken)
    plan = written(joined.withColumn("length", F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).select("conv_id", "base", "h", "taken", "length"), "rebuilt")
    rest = turns.join(plan.select("conv_id", "h", "taken"), "conv_id").filter("place > h").withColumn("depth", F.col("taken") + F.col("place") - F.col("h"))
    early = turns.filter((F.col("place") < most) & (F.col("conv_id") == base)).withColumnRenamed("conv_id", "base")
    begun = early.join(plan.select("conv_id", "base", "h"), "base").filter("place <= h").withColumn("depth", F.col("place"))
    columns = ["conv_id", "depth", "hash", "number", "n_bytes"]
    return rest.select(*columns).unionByName(begun.select(*columns)), plan.select("conv_id", "length")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(*rebuilt(numbered_turns(spark.read.parquet(f"{sf_dir}/conversations.parquet"))))


OP12_SQL = r"""
with t as (
  select conv_id, coalesce(role, '') as role, coalesce(text, '') as text, row_number() over (partition by conv_id order by turn nulls first, role, text) as pos
  from conversations where conv_id is not null),
digits as (select distinct conv_id, list_transform(string_split(conv_id::varchar, ''), lambda x: ord(x)::ubigint) as bytes from t),
crcs as (
  select conv_id, xor(list_reduce(bytes, lambda acc, x: list_reduce([0, 1, 2, 3, 4, 5, 6, 7]::ubigint[], lambda z, i: case when z & 1 = 1 then xor(z >> 1, 3988292384::ubigint) else z >> 1 end, xor(acc, x)), 4294967295::ubigint), 4294967295::ubigint) as crc
  from digits),
own as (select conv_id, count(*) as n from t group by conv_id),
c as (
  select crcs.conv_id, crcs.conv_id - crcs.conv_id % 5 as base, (crc % 9)::bigint as h, least((crc % 9)::bigint, coalesce(o.n, 0)) as taken
  from crcs left join own o on o.conv_id = crcs.conv_id - crcs.conv_id % 5),
r as (
  select c.conv_id, t.pos as d, role, text from c join t on t.conv_id = c.base where t.pos <= c.h
  union all select c.conv_id, taken + t.pos - h, role, text from c join t on t.conv_id = c.conv_id where t.pos > c.h),
m0 as (
  select conv_id, d, list({'r': role, 't': text}) over (partition by conv_id order by d) as k, strlen(text) as bytes from r
  union all select conv_id, 0, []::struct(r varchar, t varchar)[], 0 from c),
node as (select d, k, min(conv_id) as id, count(*) as n, any_value(bytes) as bytes from m0 group by d, k),
m as (select m0.conv_id, m0.d, node.id from m0 join node using (d, k)),
tree as (select node.id, node.d, node.n, node.bytes, m.id as parent from node left join m on m.conv_id = node.id and m.d = node.d - 1),
kids as (select parent as id, d - 1 as d, count(*) as kids from tree where d > 0 group by all),
valued as (select tree.*, coalesce(kids, 0) as kids, (n - 1) * bytes as saved from tree left join kids using (id, d)),
sums as (
  select m.id, m.d, sum((v.kids = 0)::bigint)::bigint as leaves, sum(v.saved)::bigint as saved
  from valued v join m on m.conv_id = v.id and m.d <= v.d group by m.id, m.d),
lengths as (select conv_id, max(d) as d from m group by conv_id),
ends as (select m.id, m.d, sha256(string_agg(m.conv_id::varchar, ',' order by m.conv_id)) as sha from m join lengths using (conv_id, d) group by m.id, m.d)
select v.id as conv_id, v.d::bigint as depth, v.parent as parent_conv_id, v.n::bigint as n_convs, v.kids::bigint as n_children, s.leaves as n_leaves, s.saved as saved_tokens,
  coalesce(sha, sha256('')) as ends_sha256
from valued v join sums s using (id, d) left join ends e using (id, d)
"""
