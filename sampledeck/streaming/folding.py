"""Folds and sub-integrations of live samples.

A fold is associative, so its state is one row a sub-integration and bin, and a sub-integration is
complete when the watermark has passed its end.  What depends on order (a decaying baseline) keeps
its state by channel.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read_stream(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """A Parquet folder or file as a stream of samples."""
    schema = spark.read.parquet(path).schema
    path = f"{path[:-1]}[{path[-1]}]"  # a pattern, as a stream takes no single file by its name
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).parquet(path)


def fold_stream(samples: DataFrame, period_us: int, nbin: int, length: str = "1 day", late: str = "1 hour", time: str = "ts", keys: tuple[str, ...] = ("ichan",)) -> DataFrame:
    """samples (time, keys, v) folded by tumbling sub-integration: start_us, keys, ibin, sum, hits."""
    rows = samples.withColumn("_time", F.col(time).cast("timestamp"))
    us = F.unix_micros("_time")
    rows = rows.withColumn("ibin", F.floor(F.pmod(us, F.lit(period_us)) * nbin / period_us).cast("int")).withWatermark("_time", late)
    out = rows.groupBy(F.window("_time", length).alias("w"), *keys, "ibin").agg(F.sum("v").alias("sum"), F.count("v").alias("hits"))
    return out.select(F.unix_micros("w.start").alias("start_us"), *keys, "ibin", "sum", "hits")


def fold_stream_turns(samples: DataFrame, period_us: int, turns: int, nbin: int, late: str = "1 hour", time: str = "ts", keys: tuple[str, ...] = ("ichan",)) -> DataFrame:
    """As fold_stream(), sub-integrations being windows of whole turns, counted from 1970: a window is
    complete when the watermark has passed its last turn."""
    return fold_stream(samples, period_us, nbin, f"{period_us * turns} microseconds", late, time, keys)


def sliding_moments(samples: DataFrame, length: str, slide: str, late: str = "1 hour", time: str = "ts", keys: tuple[str, ...] = ("ichan",)) -> DataFrame:
    """Mean and sigma over sliding windows."""
    rows = samples.withColumn("_time", F.col(time).cast("timestamp")).withWatermark("_time", late)
    out = rows.groupBy(F.window("_time", length, slide).alias("w"), *keys).agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("sigma"), F.count("v").alias("n"))
    return out.select(F.unix_micros("w.start").alias("start_us"), *keys, "mean", "sigma", "n")


def runs(samples: DataFrame, gap: str, late: str = "1 hour", time: str = "ts", keys: tuple[str, ...] = ("ichan",)) -> DataFrame:
    """Stretches of samples no further apart than gap: start_us, end_us, n."""
    rows = samples.withColumn("_time", F.col(time).cast("timestamp")).withWatermark("_time", late)
    out = rows.groupBy(F.session_window("_time", gap).alias("w"), *keys).agg(F.count("*").alias("n"))
    return out.select(F.unix_micros("w.start").alias("start_us"), F.unix_micros("w.end").alias("end_us"), *keys, "n")


#: Rows of a key that leave a task at once.
OUT_ROWS = 1 << 14


def in_order(parts: Iterator[pd.DataFrame]) -> tuple[np.ndarray, np.ndarray]:
    """idat and v of all parts in order of idat. Only those numbers are held, a part's frame is not."""
    held = [(p["idat"].to_numpy(copy=True), p["v"].to_numpy(float, copy=True)) for p in parts]
    idat = np.concatenate([x for x, _ in held])
    held = [x for _, x in held]
    v = np.concatenate(held)
    del held
    if (idat[1:] < idat[:-1]).any():
        order = np.argsort(idat, kind="stable")
        idat, v = idat[order], v[order]
    return idat, v


def follow_baseline(samples: DataFrame, decay: float, keys: tuple[str, ...] = ("ichan",)) -> DataFrame:
    """keys, idat, v less a baseline that follows v with that decay in samples; the baseline is the
    state of each key. Samples of a key must come in order of idat from trigger to trigger. A task
    holds the numbers of a key's samples in a trigger, about 50 bytes a sample at most."""
    types = dict(samples.dtypes)
    schema = ", ".join(f"{k} {types[k]}" for k in keys) + ", idat long, v double"
    weight = 1.0 / decay

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        idat, v = in_order(parts)
        before = state.get[0] if state.exists else v[0]
        base = pd.Series(np.concatenate([[before], v])).ewm(alpha=weight, adjust=False).mean().to_numpy()[1:]
        state.update((float(base[-1]),))
        v -= base
        del base
        for k in range(0, len(v), OUT_ROWS):
            yield pd.DataFrame({**dict(zip(keys, key, strict=True)), "idat": idat[k : k + OUT_ROWS], "v": v[k : k + OUT_ROWS]})

    return samples.select(*keys, "idat", F.col("v").cast("double").alias("v")).groupBy(*keys).applyInPandasWithState(step, schema, "base double", "append", GroupStateTimeout.NoTimeout)


def run_available(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is there, to Parquet under folder, and returns the result."""
    spark = stream.sparkSession
    query = stream.writeStream.format("parquet").outputMode(mode).option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")
