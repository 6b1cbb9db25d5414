"""Removal of lines that spread over many sites, by HyperLogLog sketches (operator 10).

Each line's hash gets a sketch of the sites that hold it; sketches merge in the aggregation, so a
line that a third of all documents hold costs a sketch a task.  Of the hashes that may be on enough
sites the lines themselves are sketched again, each by its text, as lines of one hash can differ;
those whose estimate lies within BAND standard errors of the threshold get an exact distinct count.
Lines on enough sites are boilerplate: they go everywhere but in the document with the smallest id,
which keeps the text.  All in DataFrame operations.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, text_column, written

#: Sites that make a line boilerplate.
SITES = 10
#: Log2 of a sketch's registers; the standard error is 1.04 / sqrt(2 ** LOG_REGISTERS).
LOG_REGISTERS = 10
BAND = 4.0
#: A line of white space only is never judged.
SOMETHING = r"[^\x20\x09-\x0D]"


def line_key(line):
    return F.struct(F.xxhash64(line).alias("hash"), F.octet_length(line).alias("bytes"))


def boilerplate(docs: DataFrame, sites: int = SITES, site: str = "source") -> DataFrame:
    """Lines on at least `sites` sites: (key, line, least), least the smallest doc_id that holds it."""
    error = BAND * 1.04 / 2 ** (LOG_REGISTERS / 2)
    low, high = sites * (1 - error) - 1, sites * (1 + error) + 1
    # a null site is one site, apart from all others
    lines = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.concat(F.lit("+"), F.col(site).cast("string")), F.lit("")).alias("site"), F.explode(F.split("text", "\n", -1)).alias("line")).filter(F.col("line").rlike(SOMETHING))
    keyed = lines.withColumn("key", line_key(F.col("line")))
    sketch = F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(LOG_REGISTERS))).alias("sites")
    maybe = written(keyed.groupBy("key").agg(sketch).filter(F.col("sites") >= low).select("key"), "line-hashes")
    spread = written(keyed.join(maybe, "key", "left_semi").groupBy("key", "line").agg(sketch, F.min("doc_id").alias("least")).filter(F.col("sites") >= low), "line-spread")
    near = spread.filter(F.col("sites") <= high)
    exact = keyed.join(near.select("key", "line"), ["key", "line"], "left_semi").groupBy("key", "line").agg(F.count_distinct("site").alias("exact")).filter(F.col("exact") >= sites)
    sure = spread.filter(F.col("sites") > high).select("key", "line", "least")
    return written(sure.union(near.join(exact.select("key", "line"), ["key", "line"]).select("key", "line", "least")), "boilerplate")


def drop_boilerplate(docs: DataFrame, sites: int = SITES, site: str = "source") -> DataFrame:
    """docs (doc_id, text, the site column and any others) with text less the boilerplate lines, and
    columns n_lines and n_removed (new; columns of these names are replaced).

    Lines end at line feeds. A line is removed where it is boilerplate and a document with a smaller
    id holds it too. A null text stays null with no lines; an empty one has one line; a text that
    loses all lines is empty. Rows with a null doc_id keep all lines. Rows that repeat a doc_id are
    judged alike. A null site counts as one site. No rows give no rows.
    """
    docs = text_column(docs).drop("n_lines", "n_removed")
    own, gone, kept = (fresh(docs, name) for name in ("_doc", "_gone", "_kept"))
    found = boilerplate(docs, sites, site)
    lines = docs.select(F.col("doc_id").cast("long").alias(own), F.explode(F.split("text", "\n", -1)).alias("line")).select(own, "line", line_key(F.col("line")).alias("key"))
    removed = lines.join(found, ["key", "line"]).filter(F.col(own) > F.col("least")).groupBy(own).agg(F.collect_set("line").alias(gone))
    split = F.split("text", "\n", -1)
    out = docs.join(removed, F.col("doc_id").cast("long") == F.col(own), "left")
    out = out.withColumn(kept, F.when(F.col(gone).isNotNull(), F.filter(split, lambda line: ~F.array_contains(gone, line))))
    out = out.withColumn("n_lines", F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.size(split)).cast("long"))
    out = out.withColumn("n_removed", F.when(F.col(kept).isNull(), F.lit(0)).otherwise(F.col("n_lines") - F.size(kept)).cast("long"))
    out = out.withColumn("text", F.coalesce(F.array_join(kept, "\n"), F.col("text")))
    return out.select(*docs.columns, "n_lines", "n_removed")


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_boilerplate(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.length("text").cast("long").alias("kept_chars"), F.md5("text").alias("kept_md5"))


OP10_SQL = f"""
with lines as (select doc_id, coalesce('+' || source, '') as site, unnest(string_split(text, chr(10))) as line from documents),
found as (
  select line, min(doc_id) as least from lines where regexp_matches(line, '{SOMETHING}')
  group by line having count(distinct site) >= {SITES}),
gone as (select doc_id, list(distinct line) as gone from lines join found using (line) where doc_id > least group by doc_id),
cut as (
  select doc_id, string_split(text, chr(10)) as was, text, gone from documents left join gone using (doc_id)),
kept as (
  select doc_id, was, case when gone is null then was else list_filter(was, lambda x: not list_contains(gone, x)) end as lines from cut),
joined as (select doc_id, len(was) as n, len(lines) as k, coalesce(array_to_string(lines, chr(10)), '') as text from kept)
select doc_id, n::bigint as n_lines, (n - k)::bigint as n_removed, length(text)::bigint as kept_chars, md5(text) as kept_md5 from joined
"""


def without_boilerplate(docs: DataFrame) -> DataFrame:
    """docs, every row, with the text less the boilerplate lines and n_chars to match."""
    out = drop_boilerplate(docs)
    return out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)).select(*docs.columns)
