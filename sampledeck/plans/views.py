"""The driver's tables as signals: events as irregular samples, embeddings as spectra and voltages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sampledeck.plans.observation import Observation, Signal

TYPES = ("click", "error", "purchase", "signup", "view")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def samples_in(df: DataFrame, column: str) -> int:
    """One past the largest index, from the column alone."""
    return df.agg(F.coalesce(F.max(column) + 1, F.lit(0))).first()[0]


def sig(spark: SparkSession, folder: str) -> Signal:
    """events: idat, us, ichan (by type), ipol (by user), v; one sample has one channel only."""
    rows = table(spark, folder, "events")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    ichan = (F.array_position(F.array(*[F.lit(t) for t in TYPES]), F.col("event_type")) - 1).cast("int")
    data = rows.select(F.col("event_id").alias("idat"), us.alias("us"), ichan.alias("ichan"), (F.col("user_id") % 2).cast("int").alias("ipol"), F.col("value").alias("v"))
    return Signal(data, Observation(state="PPQQ", nchan=len(TYPES), npol=2, ndat=samples_in(rows, "event_id"), centre_frequency=1400.0, bandwidth=-400.0, rate=1000.0))


def spec(spark: SparkSession, folder: str) -> Signal:
    """embeddings as detected spectra of 64 channels."""
    rows = table(spark, folder, "embeddings")
    data = rows.select(F.col("vec_id").alias("idat"), F.posexplode("embedding").alias("ichan", "v")).select("idat", "ichan", F.lit(0).alias("ipol"), F.col("v").cast("double").alias("v"))
    return Signal(data, Observation(nchan=64, ndat=samples_in(rows, "vec_id"), centre_frequency=1382.0, bandwidth=-400.0, rate=1000.0, dispersion_measure=2.0))


def volt(spark: SparkSession, folder: str) -> Signal:
    """embeddings as complex voltages of 16 channels and 2 polarizations."""
    rows = table(spark, folder, "embeddings")
    pair = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda j: F.struct(F.expr("0").alias("z"), F.try_element_at("embedding", (2 * j + 1).cast("int")).cast("double").alias("re"), F.try_element_at("embedding", (2 * j + 2).cast("int")).cast("double").alias("im")))
    data = rows.select(F.col("vec_id").alias("idat"), F.posexplode(pair).alias("j", "z")).select("idat", F.expr("cast(j div 2 as int)").alias("ichan"), (F.col("j") % 2).cast("int").alias("ipol"), "z.re", "z.im")
    return Signal(data, Observation(state="Analytic", ndim=2, nchan=16, npol=2, ndat=samples_in(rows, "vec_id"), centre_frequency=1382.0, bandwidth=-400.0, rate=1000.0, dispersion_measure=2.0))


SQL_VIEWS = {
    "sig": "sig as (select event_id::bigint as idat, epoch_us(ts)::bigint as us, (list_position(['click', 'error', 'purchase', 'signup', 'view'], event_type) - 1)::int as ichan, (user_id % 2)::int as ipol, value as v from events)",
    "spec": "spec as (select vec_id::bigint as idat, k::int as ichan, 0::int as ipol, embedding[k + 1]::double as v from embeddings, range(64) as t(k))",
    "volt": "volt as (select vec_id::bigint as idat, (j // 2)::int as ichan, (j % 2)::int as ipol, embedding[2 * j + 1]::double as re, embedding[2 * j + 2]::double as im from embeddings, range(32) as t(j))",
    "power": "power as (select idat, ichan, ipol, re * re + im * im as v from volt)",
    "coh": "coh as (select idat, ichan, r0 * r0 + i0 * i0 as pp, r1 * r1 + i1 * i1 as qq, r0 * r1 + i0 * i1 as re, r0 * i1 - i0 * r1 as im from (select idat, ichan, max(re) filter (ipol = 0) as r0, max(im) filter (ipol = 0) as i0, max(re) filter (ipol = 1) as r1, max(im) filter (ipol = 1) as i1 from volt group by idat, ichan))",
    "stokes": "stokes as (select idat, ichan, pp + qq as s0, pp - qq as s1, 2 * re as s2, 2 * im as s3 from coh)",
    "dirty": "dirty as (select idat, ichan, ipol, case when ichan = 3 and idat // 50 % 5 = 1 and idat % 25 = 0 then v * 40.0 when ichan = 7 and idat % 500 >= 250 then v + 0.05 when idat // 50 % 5 = 2 then v * (1.0 + 0.45 * (1 - 2 * (idat % 2))) else v end as v from power)",
    "sk": "sk as (select idat // 50 as ipart, ichan, ipol, sum(v) as s1, sum(v * v) as s2, case when sum(v) = 0 then 0.0 else 51.0 / 49.0 * (50.0 * sum(v * v) / (sum(v) * sum(v)) - 1) end as sk from dirty where idat < (select (max(idat) + 1) // 50 * 50 from dirty) group by idat // 50, ichan, ipol)",
}
SQL_NEEDS = {"power": ("volt",), "coh": ("volt",), "stokes": ("volt", "coh"), "dirty": ("volt", "power"), "sk": ("volt", "power", "dirty")}


def with_views(sql: str, *names: str) -> str:
    """sql with those views and what they build on."""
    wanted: list[str] = []
    for name in names:
        wanted += [n for n in (*SQL_NEEDS.get(name, ()), name) if n not in wanted]
    body = sql.strip()
    tail = ", " + body[5:] if body.lower().startswith("with ") else " " + body
    return "with " + ", ".join(SQL_VIEWS[n] for n in wanted) + tail
