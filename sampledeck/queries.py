"""One query for each operator, over the driver's tables, with the same in SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sampledeck.functions import responses
from sampledeck.functions.numeric import DISPERSION_K, sk_limits, sk_variance, window
from sampledeck.operators import blocks, calibrate, cyclic, delay, detect, digitize, fold, kernels, lags, rfi, scrunch, stats, weights
from sampledeck.plans import nodes, pipelines
from sampledeck.plans.observation import Signal
from sampledeck.plans.views import sig, spec, table, volt, with_views
from sampledeck.sources import frames, headers, raw, unload
from sampledeck.streaming import folding, live

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: The events' epoch (2024-01-01 UTC), the fold's period and bins, and a day: fixed by the queries.
EPOCH, PERIOD, NBIN, DAY = 1704067200000000, 37_000_000, 16, 86_400_000_000
M, PARTS, SIGMAS = 50, 5, 3.0


def query(name: str, sql: str = "", *views: str):
    """Registers a query; sql may use the views and {placeholders} already filled in."""

    def add(function):
        QUERIES[name] = function
        if sql:
            ORACLES[name] = with_views(sql, *views) if views else sql
        return function

    return add


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) + F.lit(0.0) for c in columns or [c for c, t in df.dtypes if t == "double"]})


def r(expression: str, digits: int = 6) -> str:
    return f"round({expression}, {digits}) + 0.0"


# Detection ------------------------------------------------------------------------------------


@query("detect_square_law", f"select idat, ichan, ipol, {r('v')} as v from power", "power")
def _(spark, d):
    return rounded(detect.square_law(volt(spark, d)).data)


@query("detect_intensity", f"select idat, ichan, 0::int as ipol, {r('sum(v)')} as v from power group by idat, ichan", "power")
def _(spark, d):
    return rounded(detect.intensity(volt(spark, d)).data)


@query("detect_nth_power", f"select idat, ichan, 0::int as ipol, {r('sum(v) * sum(v)')} as v from power group by idat, ichan", "power")
def _(spark, d):
    return rounded(detect.nth_power(volt(spark, d)).data)


@query("detect_coherence", f"select idat, ichan, {r('pp')} as pp, {r('qq')} as qq, {r('re')} as re, {r('im')} as im from coh", "coh")
def _(spark, d):
    return rounded(detect.coherence(volt(spark, d)).data)


@query("detect_stokes", f"select idat, ichan, {r('s0')} as s0, {r('s1')} as s1, {r('s2')} as s2, {r('s3')} as s3 from stokes", "stokes")
def _(spark, d):
    return rounded(detect.stokes(volt(spark, d)).data)


_M = ", ".join(f"{r(f'avg(s{i} * s{j})')} as m{i}{j}" for i, j in detect.PRODUCTS)


@query("fourth_moment", f"select ichan, {_M} from stokes group by ichan", "stokes")
def _(spark, d):
    moments = detect.fourth_moment(detect.stokes(volt(spark, d)))
    return rounded(moments.data.groupBy("ichan").agg(*[F.avg(f"m{i}{j}").alias(f"m{i}{j}") for i, j in detect.PRODUCTS]))


_C = ", ".join(f"{r(f'(avg(s{i} * s{j}) - avg(s{i}) * avg(s{j})) / count(*)', 9)} as c{i}{j}" for i, j in detect.PRODUCTS)


@query("central_moment", f"select ichan, count(*) as n, {_C} from stokes group by ichan", "stokes")
def _(spark, d):
    return rounded(detect.central_moments(detect.fourth_moment(detect.stokes(volt(spark, d))), "ichan"), digits=9)


@query("detect_none", f"select idat, ichan, ipol, {r('v')} as v from spec", "spec")
def _(spark, d):
    """Detected data stay as they are."""
    return rounded(detect.square_law(spec(spark, d)).data)


@query("poln_select", f"select idat, ichan, 0::int as ipol, {r('v')} as v from power where ipol = 1", "power")
def _(spark, d):
    return rounded(detect.select_polarization(detect.square_law(volt(spark, d)), 1).data)


@query("poln_reshape", f"select idat, ichan, k::int as ipol, {r('[pp, qq, re, im][k + 1]')} as v from coh, range(4) as t(k)", "coh")
def _(spark, d):
    return rounded(detect.reshape_products(detect.coherence(volt(spark, d))).data)


# Selection and scrunching ---------------------------------------------------------------------


@query("freq_zoom", "select idat, (ichan - 16)::int as ichan, ipol, v from spec where ichan between 16 and 31", "spec")
def _(spark, d):
    return scrunch.zoom(spec(spark, d), 1432.0, 100.0).data


@query("chomp", f"select idat, ichan, ipol, {r('v * 2.5')} as v from spec where idat < 96", "spec")
def _(spark, d):
    return rounded(scrunch.chomp(spec(spark, d), 100, 16, 2.5).data)


@query("resize", "select idat, ichan, ipol, v from spec where idat < (select max(idat) + 1 - 7 from spec)", "spec")
def _(spark, d):
    return scrunch.resize(spec(spark, d), -7).data


@query("seek_total", "select idat - 20 as idat, ichan, ipol, v from spec where idat >= 20 and idat < 70", "spec")
def _(spark, d):
    return scrunch.seek(spec(spark, d), 0.02, 0.05).data


@query("tscrunch_10", f"select idat // 10 as idat, ichan, ipol, {r('sum(v)')} as v from spec where idat < (select (max(idat) + 1) // 10 * 10 from spec) group by idat // 10, ichan, ipol", "spec")
def _(spark, d):
    return rounded(scrunch.tscrunch(spec(spark, d), 10).data)


@query("fscrunch_4", f"select idat, (ichan // 4)::int as ichan, ipol, {r('sum(v)')} as v from spec group by idat, ichan // 4, ipol", "spec")
def _(spark, d):
    return rounded(scrunch.fscrunch(spec(spark, d), 4).data)


@query("tfscrunch", f"select idat // 8 as idat, (ichan // 5)::int as ichan, ipol, {r('sum(v)')} as v from spec where ichan < 60 and idat < (select (max(idat) + 1) // 8 * 8 from spec) group by idat // 8, ichan // 5, ipol", "spec")
def _(spark, d):
    return rounded(scrunch.fscrunch(scrunch.tscrunch(spec(spark, d), 8), 5).data)


@query("tfscrunch_fused", f"select idat // 8 as idat, (ichan // 5)::int as ichan, ipol, {r('sum(v)')} as v from spec where ichan < 60 and idat < (select (max(idat) + 1) // 8 * 8 from spec) group by idat // 8, ichan // 5, ipol", "spec")
def _(spark, d):
    return rounded(scrunch.scrunch(spec(spark, d), 8, 5).data)


@query("pscrunch", f"select idat, ichan, 0::int as ipol, {r('sum(v) / sqrt(2.0)')} as v from power group by idat, ichan", "power")
def _(spark, d):
    return rounded(scrunch.pscrunch(detect.square_law(volt(spark, d))).data)


@query("append_series", "select idat, ichan, ipol, v from spec union all select idat + (select max(idat) + 1 from spec), ichan, ipol, v from spec", "spec")
def _(spark, d):
    return scrunch.append(spec(spark, d), spec(spark, d)).data


@query("add_series", f"select idat, ichan, ipol, {r('v * 3')} as v from spec", "spec")
def _(spark, d):
    both = spec(spark, d)
    return rounded(scrunch.add(both, scrunch.multiply(both, 2.0)).data)


@query("accumulate", "select idat, ichan, ipol, v from spec where idat < 64", "spec")
def _(spark, d):
    return scrunch.accumulate(spec(spark, d), 64).data


@query("accumulate_blocks", "select idat, ichan, ipol, v from (select idat + k * n as idat, ichan, ipol, v from spec, (select max(idat) + 1 as n from spec), range(3) as t(k)) where idat < 1200", "spec")
def _(spark, d):
    """Three blocks to a buffer of 1200 samples."""
    found, full, _ = scrunch.accumulated([spec(spark, d)] * 3, 1200)
    assert full
    return found.data


@query("time_order", "select idat, k - 1 as place, v from (select idat, ichan + 1 as k, v from spec)", "spec")
def _(spark, d):
    rows = scrunch.time_order(spec(spark, d))
    return rows.select("idat", F.posexplode("spec").alias("place", "v")).withColumn("place", F.col("place").cast("int"))


@query("range_check", "select ichan, ipol, count(*) as n, count(*) filter (isnan(v) or isinf(v)) as not_finite, count(*) filter (v not between 1 and 100) as outside from sig group by ichan, ipol", "sig")
def _(spark, d):
    return scrunch.out_of_range(sig(spark, d), 1, 100)


# Folding --------------------------------------------------------------------------------------

_BIN = f"((us - {EPOCH}) % {PERIOD} * {NBIN} // {PERIOD})::int"


def events_folded(spark, d, *keys: str, **more) -> DataFrame:
    rows = sig(spark, d).data.withColumn("ibin", fold.constant_bin(F.col("us"), EPOCH, PERIOD, NBIN)).withColumns(more)
    return fold.fold(rows, *keys)


@query("fold_const", f"select ichan, {_BIN} as ibin, {r('sum(v)')} as sum, count(*) as hits from sig group by all", "sig")
def _(spark, d):
    return rounded(events_folded(spark, d, "ichan"))


_PROFILE = f"""with f as (select ichan, ipol, {_BIN} as ibin, sum(v) as s, count(*) as n from sig group by all),
means as (select ichan, ipol, avg(s / n) as mean from f group by all)
select m.ichan, m.ipol, b.ibin::int as ibin, {r('coalesce(s / n, mean)')} as amp, coalesce(n, 0) as hits
from means m cross join range({NBIN}) as b(ibin) left join f on f.ichan = m.ichan and f.ipol = m.ipol and f.ibin = b.ibin"""


@query("fold_profile", _PROFILE, "sig")
def fold_profile(spark, d):
    return rounded(fold.normalise(events_folded(spark, d, "ichan", "ipol"), NBIN, "ichan", "ipol"))


@query("fold_valid", f"select ichan, {_BIN} as ibin, {r('sum(v) filter (v > 20)')} as sum, count(*) filter (v > 20) as hits from sig group by ichan, {_BIN}", "sig")
def _(spark, d):
    rows = sig(spark, d).data.withColumn("ibin", fold.constant_bin(F.col("us"), EPOCH, PERIOD, NBIN))
    return rounded(fold.fold(rows, "ichan", valid=F.col("v") > 20))


@query("fold_subint_seconds", f"select (us - {EPOCH}) // {DAY} as subint, ichan, {_BIN} as ibin, {r('sum(v)')} as sum, count(*) as hits from sig group by all", "sig")
def _(spark, d):
    return rounded(events_folded(spark, d, "subint", "ichan", subint=fold.division(F.col("us"), EPOCH, DAY)))


@query("fold_subint_turns", f"select (us - {EPOCH}) // {PERIOD * 1000} as subint, ichan, {_BIN} as ibin, {r('sum(v)')} as sum, count(*) as hits from sig group by all", "sig")
def _(spark, d):
    return rounded(events_folded(spark, d, "subint", "ichan", subint=fold.division(F.col("us"), EPOCH, PERIOD * 1000)))


_LONG = 7 * DAY


@query("fold_min_length", f"""with rows as (select (us - {EPOCH}) // {_LONG} as subint, us, {_BIN} as ibin, v from sig),
kept as (select subint from rows group by subint having max(us) - min(us) >= 0.5 * {_LONG})
select subint, ibin, {r('sum(v)')} as sum, count(*) as hits from rows where subint in (select subint from kept) group by all""", "sig")
def _(spark, d):
    rows = sig(spark, d).data.withColumn("subint", fold.division(F.col("us"), EPOCH, _LONG)).withColumn("ibin", fold.constant_bin(F.col("us"), EPOCH, PERIOD, NBIN))
    return rounded(fold.long_enough(fold.fold(rows, "subint"), fold.subint_spans(rows), _LONG, 0.5))


@query("fold_multi", "select p::bigint as period_us, ichan, ((us - %d) %% p * %d // p)::int as ibin, %s as sum, count(*) as hits from sig, (values (37000000), (41000000), (86400000)) as t(p) group by all" % (EPOCH, NBIN, r("sum(v)")), "sig")
def _(spark, d):
    return rounded(fold.fold_many(sig(spark, d).data, [37_000_000, 41_000_000, 86_400_000], EPOCH, NBIN, "ichan"))


_SEGMENTS = [(EPOCH + (2 * k + 1) * DAY * 5 // 2, 0.25 * k, 1 / 3600, [0.0, 0.0, 1e-9 * k]) for k in range(6)]
_VALUES = ", ".join(f"({k}, {m}, {p}, {f!r}, {c[2]!r})" for k, (m, p, f, c) in enumerate(_SEGMENTS))


@query("fold_predictor", f"""with seg(segment, tmid, rphase, f0, c2) as (values {_VALUES}),
rows as (select ichan, v, rphase + 60.0 * ((us - tmid) / 60e6) * f0 + c2 * pow((us - tmid) / 60e6, 2) as turns from sig join seg on segment = (us - {EPOCH}) // {5 * DAY})
select ichan, least(floor((turns - floor(turns)) * {NBIN}), {NBIN - 1})::int as ibin, {r('sum(v)')} as sum, count(*) as hits from rows group by all""", "sig")
def _(spark, d):
    segments = fold.predictor(spark, _SEGMENTS, 5 * DAY, EPOCH)
    rows = fold.predicted(sig(spark, d).data, segments, 5 * DAY, EPOCH)
    return rounded(fold.fold(rows.withColumn("ibin", fold.turn_bin(NBIN)), "ichan"))


@query("fold_partial_final", f"select ichan, {_BIN} as ibin, {r('sum(v)')} as sum, count(*) as hits from sig group by all", "sig")
def _(spark, d):
    parts = events_folded(spark, d, "block", "ichan", block=F.expr("idat div 512"))
    return rounded(fold.combine(parts, "ichan", "ibin"))


@query("subint_expected", f"select (us - {EPOCH}) // {DAY} as subint, count(*) as n, count(*) >= 0.9 * (select count(*) / 30.0 from sig) as complete from sig group by 1", "sig")
def _(spark, d):
    signal = sig(spark, d)
    rows = signal.data.withColumn("subint", fold.division(F.col("us"), EPOCH, DAY))
    return fold.expected(fold.subint_spans(rows), signal.obs.ndat / 30.0)


@query("fold_weights", f"select ichan, {r('count(*) / (select count(*)::double from sig)')} as weight from sig group by ichan", "sig")
def _(spark, d):
    return rounded(fold.channel_weights(events_folded(spark, d, "ichan"), sig(spark, d).obs.ndat, "ichan"))


@query("folded_seconds", f"select ichan, {r('count(*) / 1000.0')} as seconds from sig group by ichan", "sig")
def _(spark, d):
    return rounded(fold.folded_seconds(events_folded(spark, d, "ichan"), 1000.0, "ichan"))


# Statistics and rescaling ---------------------------------------------------------------------


@query("stats_chan_pol", f"select ichan, ipol, count(*) as n, {r('avg(v)')} as mean, {r('stddev_pop(v)')} as sigma from sig group by ichan, ipol", "sig")
def _(spark, d):
    return rounded(stats.channel_stats(sig(spark, d)))


@query("bandpass_detected", f"select ichan, ipol, {r('sum(v)')} as total, count(*) as n from power group by ichan, ipol", "power")
def _(spark, d):
    return rounded(stats.bandpass(detect.square_law(volt(spark, d))))


_RESCALED = "({v} - avg) * case when sd > 0 then 1.0 / sd else 1.0 end"


@query("rescale_interval", f"with m as (select idat // 100 as i, ichan, ipol, avg(v) as avg, stddev_pop(v) as sd from spec group by all) select idat, ichan, ipol, {r(_RESCALED.format(v='v'))} as v from spec join m using (ichan, ipol) where i = idat // 100", "spec")
def _(spark, d):
    return rounded(stats.rescale(spec(spark, d), 100).data)


@query("rescale_constant", f"with m as (select ichan, ipol, avg(v) as avg, stddev_pop(v) as sd from spec where idat < 100 group by all) select idat, ichan, ipol, {r(_RESCALED.format(v='v'))} as v from spec join m using (ichan, ipol)", "spec")
def _(spark, d):
    return rounded(stats.rescale(spec(spark, d), 100, constant=True).data)


@query("rescale_update_bands", f"select idat // 100 as interval, ((idat // 100 + 1) * 100000)::bigint as at_us, ichan, ipol, {r('avg(v)')} as mean, {r('stddev_pop(v)')} as sigma from spec group by all", "spec")
def _(spark, d):
    return rounded(stats.rescale_updates(spec(spark, d), 100)[0])


@query("rescale_update_times", f"select idat // 100 as interval, ((idat // 100 + 1) * 100000)::bigint as at_us, idat, ipol, {r('sum(v)')} as total from spec group by all", "spec")
def _(spark, d):
    return rounded(stats.rescale_updates(spec(spark, d), 100)[1])


@query("rescale_time_total", f"select idat, {r('sum(v)')} as total from spec group by idat", "spec")
def _(spark, d):
    return rounded(stats.time_totals(spec(spark, d)))


@query("level_stats", f"select ichan, ipol, count(*) as n, {r('avg(v)')} as mean, {r('var_pop(v)')} as variance, {r('avg(v * v)')} as power from sig group by ichan, ipol", "sig")
def _(spark, d):
    return rounded(stats.level_stats(sig(spark, d)), digits=6)


@query("gain_correction", f"select ichan, ipol, {r('avg(v)')} as mean, {r('case when var_pop(v) > 0 then sqrt(1.0 / var_pop(v)) else 1.0 end')} as gain from sig group by ichan, ipol", "sig")
def _(spark, d):
    return rounded(stats.gain_correction(sig(spark, d)))


@query("level_monitor", f"select ichan, ipol, {r('avg(v)')} as mean, {r('case when var_pop(v) > 0 then sqrt(4.0 / var_pop(v)) else 1.0 end')} as gain from sig group by ichan, ipol", "sig")
def _(spark, d):
    return rounded(stats.level_monitor(sig(spark, d), 4.0))


@query("histogram_codes", "select ichan, ipol, greatest(0, least(15, floor(v * 16 / 400.0)))::int as code, count(*) as n from sig group by all", "sig")
def _(spark, d):
    return stats.histogram(sig(spark, d), 0.0, 400.0, 16)


@query("running_moment", f"""with b as (select idat // 50 as block, ichan, ipol, count(*) as n, sum(v) as s, sum(v * v) as q from spec group by all),
w as (select block, ichan, ipol, sum(n) over o as n, sum(s) over o as s, sum(q) over o as q from b window o as (partition by ichan, ipol order by block rows between 3 preceding and current row))
select block, ichan, ipol, {r('s / n')} as mean, {r('sqrt(greatest(q / n - (s / n) * (s / n), 0.0))')} as sigma from w""", "spec")
def _(spark, d):
    return rounded(stats.running_moments(spec(spark, d), 50, 4))


@query("median_birdie", f"""with t as (select ichan, ipol, sum(v) as total from power group by all),
m as (select *, quantile_cont(total, 0.5) over (partition by ipol order by ichan rows between 3 preceding and 3 following) as baseline from t)
select ichan, ipol, {r('total')} as total, {r('baseline')} as baseline, abs(total - baseline) > 1.5 * sqrt(avg((total - baseline) * (total - baseline)) over (partition by ipol)) as bad from m""", "power")
def _(spark, d):
    return rounded(stats.median_birdies(detect.square_law(volt(spark, d)), 3, 1.5))


def _round(k: int) -> str:
    return f"""r{k} as (select ichan, residual, before, good and not (abs(residual) > 2.0 * sigma or (abs(residual - before) > 4.0 * sigma and abs(residual) >= abs(before))) as good
  from r{k - 1}, (select sqrt(avg(residual * residual)) as sigma from r{k - 1} where good))"""


_BIRDIES = f"""with t as (select ichan, sum(v) as total from power group by ichan), n as (select count(*) as n from t),
p as (select ichan, o, case when ichan + o < 0 then -(ichan + o) when ichan + o > n - 1 then 2 * (n - 1) - (ichan + o) else ichan + o end as at from t, n, range(-3, 4) as x(o)),
m as (select p.ichan, median(t.total) as base from p join t on t.ichan = p.at group by p.ichan),
d as (select ichan, total - base as residual from t join m using (ichan)),
r0 as (select ichan, residual, lag(residual, 1, residual) over (order by ichan) as before, true as good from d), {", ".join(_round(k) for k in range(1, 17))}
select ichan from r16 where not good"""


@query("birdie_channels", _BIRDIES, "power")
def _(spark, d):
    bad = stats.birdie_channels(detect.square_law(volt(spark, d)), 3, 2.0)
    return spark.createDataFrame([(c,) for c in bad], "ichan int")


def _part_round(k: int) -> str:
    return f"""r{k} as (select ipart, ichan, residual, before, good and not (abs(residual) > 2.0 * sigma or (abs(residual - before) > 4.0 * sigma and abs(residual) >= abs(before))) as good
  from r{k - 1} join (select ipart, sqrt(avg(residual * residual)) as sigma from r{k - 1} where good group by ipart) using (ipart))"""


_BY_PART = f"""t as (select idat // 50 as ipart, ichan, sum(v) as total from dirty group by all), n as (select ipart, count(*) as n from t group by ipart),
p as (select ipart, ichan, case when ichan + o < 0 then -(ichan + o) when ichan + o > n - 1 then 2 * (n - 1) - (ichan + o) else ichan + o end as at from t join n using (ipart), range(-3, 4) as x(o)),
m as (select p.ipart, p.ichan, median(t.total) as base from p join t on t.ipart = p.ipart and t.ichan = p.at group by all),
d as (select ipart, ichan, total - base as residual from t join m using (ipart, ichan)),
r0 as (select ipart, ichan, residual, lag(residual, 1, residual) over (partition by ipart order by ichan) as before, true as good from d), {", ".join(_part_round(k) for k in range(1, 17))}"""


@query("birdie_mask", f"with {_BY_PART} select ipart, ichan from r16 where not good", "dirty")
def _(spark, d):
    """Channels that stand off in each interval of 50 samples."""
    return stats.birdie_mask(powers(spark, d), 50, 3, 2.0)


@query("fold_birdies", f"""with {_BY_PART}, zapped as (select ipart, ichan from r16 where not good),
rows as (select ichan, ipol, v, (floor((idat + 0.5) * 1000.0)::bigint % 20000 * 8 // 20000)::int as ibin from dirty where (idat // 50, ichan) not in (select ipart, ichan from zapped)),
f as (select ichan, ipol, ibin, sum(v) as s, count(*) as n from rows group by all), means as (select ichan, ipol, avg(s / n) as mean from f group by all)
select 0::bigint as subint, m.ichan, m.ipol, x.ibin::int as ibin, {r('coalesce(s / n, mean)')} as amp, coalesce(n, 0) as hits from means m cross join range(8) as x(ibin) left join f on f.ichan = m.ichan and f.ipol = m.ipol and f.ibin = x.ibin""", "dirty")
def _(spark, d):
    """The fold program without the channels that stand off in an interval."""
    return rounded(pipelines.fold_signal(powers(spark, d), pipelines.FoldConfig(period_us=20_000, nbin=8, epoch_us=0, birdies=(50, 3, 2.0))))


def recursive(sql: str, *views: str) -> str:
    return with_views(sql, *views).replace("with ", "with recursive ", 1)


@query("decay_baseline", recursive(f"""with f(idat, ichan, ipol, v, b) as (select idat, ichan, ipol, v, v from spec where idat = 0
  union all select s.idat, s.ichan, s.ipol, s.v, f.b + (s.v - f.b) / 32.0 from f join spec s on s.ichan = f.ichan and s.ipol = f.ipol and s.idat = f.idat + 1)
select idat, ichan, ipol, {r('v - b')} as v from f""", "spec"))
def _(spark, d):
    return rounded(stats.decay_baseline(spec(spark, d), 32.0).data)


# Delays ---------------------------------------------------------------------------------------

_DM, _CF, _BW, _RATE = 2.0, 1382.0, -400.0, 1000.0
_FREQ = f"({_CF - _BW / 2 + _BW / 128!r} + k * ({_BW / 64!r}))"
_DELAY = f"floor({_DM / DISPERSION_K!r} * (1.0 / ({_CF} * {_CF}) - 1.0 / ({_FREQ} * {_FREQ})) * {_RATE} + 0.5)::bigint"


@query("dispersion_delay", f"select k::int as ichan, {r(_FREQ)} as freq, {_DELAY} as delay, n, {r('total')} as total from range(64) as t(k) join (select ichan, count(*) as n, sum(v) as total from spec group by ichan) s on s.ichan = k", "spec")
def _(spark, d):
    """Each channel's delay beside what the table has of it."""
    signal = spec(spark, d)
    there = signal.data.groupBy("ichan").agg(F.count("*").alias("n"), F.sum("v").alias("total"))
    return rounded(delay.dispersion_delays(spark, signal.obs).join(there, "ichan"))


_DELAYED = f"""with t as (select k::int as ichan, {_DELAY} as delay from range(64) as t(k)), e as (select max(delay) as most, min(delay) as least from t),
moved as (select idat - (most - delay) as idat, ichan, ipol, v from spec join t using (ichan), e)
select {{columns}} from moved, e where idat >= 0 and idat < (select max(idat) + 1 from spec) - (most - least) {{group}}"""


@query("sample_delay", _DELAYED.format(columns="idat, ichan, ipol, v", group=""), "spec")
def _(spark, d):
    return delay.dedisperse(spec(spark, d)).data


@query("dedisperse_sum", _DELAYED.format(columns=f"idat, {r('sum(v)')} as total", group="group by idat"), "spec")
def _(spark, d):
    return rounded(stats.time_totals(delay.dedisperse(spec(spark, d))))


@query("geometric_delay", "select idat - 4 + 4 * ipol as idat, ichan, ipol, v from power where idat - 4 + 4 * ipol >= 0 and idat - 4 + 4 * ipol < (select max(idat) + 1 - 4 from power)".replace(", v from", f", {r('v')} as v from"), "power")
def _(spark, d):
    return rounded(delay.sample_delay(detect.square_law(volt(spark, d)), delay.geometric_delays(spark)).data)


_LOW, _HIGH = f"({_FREQ} - 3.125)", f"({_FREQ} + 3.125)"


@query("smearing_time", f"select k::int as ichan, {r(_FREQ)} as freq, {r(f'{_DM / DISPERSION_K!r} * (1.0 / ({_LOW} * {_LOW}) - 1.0 / ({_HIGH} * {_HIGH}))', 9)} as smearing, n, {r('sigma')} as sigma from range(64) as t(k) join (select ichan, count(*) as n, stddev_pop(v) as sigma from spec group by ichan) s on s.ichan = k", "spec")
def _(spark, d):
    """How far dispersion spreads each channel, beside its samples' number and spread."""
    signal = spec(spark, d)
    there = stats.channel_stats(signal).select("ichan", "n", "sigma")
    return rounded(rounded(delay.smearing_table(spark, signal.obs).join(there, "ichan"), "smearing", digits=9), "freq", "sigma")


# Interference ---------------------------------------------------------------------------------

#: Bounds of the kurtosis estimate at 3 sigmas for that many spectra.
SK_BOUNDS = {50: (0.452965336, 2.348475674), 100: (0.563649979, 1.888977341), 150: (0.625528396, 1.691277206), 200: (0.666038943, 1.577948040), 250: (0.695182466, 1.503290503)}
_OUT = f"sk < {SK_BOUNDS[M][0]} or sk > {SK_BOUNDS[M][1]}"


def interfered(power: Signal) -> Signal:
    """Detected data with impulses in a channel, a tone in another, and times of which all channels
    are modulated, too weakly to show in one; so every kind of mask has something to find."""
    part = F.expr("idat div 50") % 5
    v = F.when((F.col("ichan") == 3) & (part == 1) & (F.col("idat") % 25 == 0), F.col("v") * 40.0)
    v = v.when((F.col("ichan") == 7) & (F.col("idat") % 500 >= 250), F.col("v") + 0.05)
    v = v.when(part == 2, F.col("v") * (1.0 + 0.45 * (1 - 2 * (F.col("idat") % 2)))).otherwise(F.col("v"))
    return Signal(power.data.withColumn("v", v), power.obs)


def powers(spark, d) -> Signal:
    return interfered(detect.square_law(volt(spark, d)))


@query("sk_estimate", f"select ipart, ichan, ipol, {r('sk')} as sk from sk", "sk")
def _(spark, d):
    return rounded(rfi.kurtosis(powers(spark, d), M).select("ipart", "ichan", "ipol", "sk"))


_BLOCK = f"select ipart // {PARTS} as iblock, ichan, ipol, count(*) * {M} as n, case when sum(s1) = 0 then 0.0 else (count(*) * {M} + 1.0) / (count(*) * {M} - 1.0) * (count(*) * {M} * sum(s2) / (sum(s1) * sum(s1)) - 1) end as sk from sk group by ipart // {PARTS}, ichan, ipol"


@query("sk_block", f"select iblock, ichan, ipol, n, {r('sk')} as sk from ({_BLOCK})", "sk")
def _(spark, d):
    return rounded(rfi.block_kurtosis(rfi.kurtosis(powers(spark, d), M), M, PARTS))


@query("sk_mask_ft", f"select distinct ipart, ichan from sk where {_OUT}", "sk")
def _(spark, d):
    return rfi.mask_parts(rfi.kurtosis(powers(spark, d), M), sk_limits(M, SIGMAS))


_BLIMITS = " or ".join(f"(n = {n} and (sk < {low} or sk > {high}))" for n, (low, high) in SK_BOUNDS.items())


@query("sk_mask_tscr", f"select distinct iblock, ichan from ({_BLOCK}) where {_BLIMITS}", "sk")
def _(spark, d):
    power = powers(spark, d)
    return rfi.mask_blocks(rfi.kurtosis(power, M), M, PARTS, SIGMAS, power.obs.ndat)


_FT = f"ft as (select distinct ipart, ichan from sk where {_OUT}), tb as (select distinct iblock, ichan from ({_BLOCK}) where {_BLIMITS})"
_TIMES = f"select distinct ipart from (select ipart, ipol, avg(sk) as mean, count(*) as n from sk where not exists (select 1 from {{mask}} f where f.ipart = sk.ipart and f.ichan = sk.ichan) group by ipart, ipol) where abs(mean - 1) > {1 + SIGMAS} * sqrt({sk_variance(M)!r} / n)"


@query("sk_mask_fscr", f"with {_FT} " + _TIMES.format(mask="ft"), "sk")
def _(spark, d):
    found = rfi.kurtosis(powers(spark, d), M)
    return rfi.mask_times(found, rfi.mask_parts(found, sk_limits(M, SIGMAS)), M, SIGMAS)


_ALL = f"""{_FT}, one as (select ipart, ichan from ft union select distinct ipart, ichan from sk where exists (select 1 from tb where tb.iblock = sk.ipart // {PARTS} and tb.ichan = sk.ichan)),
fs as ({_TIMES.format(mask='one')}), mask as (select ipart, ichan from one union select distinct ipart, ichan from sk where ipart in (select ipart from fs))"""


def full_mask(spark, d) -> DataFrame:
    """The mask, from sums that are written once and read by each of its steps."""
    power = powers(spark, d)
    path = scratch(spark)
    found = rfi.kurtosis(power, M)
    found.write.parquet(path)
    return rfi.mask_all(spark.read.schema(found.schema).parquet(path), M, PARTS, SIGMAS, ndat=power.obs.ndat)


@query("sk_mask_all", f"with {_ALL} select ipart, ichan from mask", "sk")
def _(spark, d):
    return full_mask(spark, d)


_ZAPPED = f"select p.idat, p.ichan, p.ipol, case when m.ipart is null then p.v else 0.0 end as v, m.ipart is not null as zapped from dirty p left join mask m on m.ichan = p.ichan and m.ipart = p.idat // {M}"


@query("sk_apply", f"with {_ALL} select idat, ichan, ipol, {r('v')} as v, zapped from ({_ZAPPED})", "sk")
def _(spark, d):
    return rounded(rfi.apply_mask(powers(spark, d), full_mask(spark, d), M))


@query("sk_counts", f"with {_ALL} select ichan, ipol, count(*) as hits, count(*) filter (not zapped) as hits_left, {r('sum(v)')} as sum_left, count(*) filter (zapped) as hits_zapped from ({_ZAPPED}) group by ichan, ipol", "sk")
def _(spark, d):
    return rounded(rfi.mask_counts(rfi.apply_mask(powers(spark, d), full_mask(spark, d), M)))


@query("mask_anti", f"with {_ALL} select p.idat, p.ichan, p.ipol, {r('p.v')} as v from dirty p where not exists (select 1 from mask m where m.ichan = p.ichan and m.ipart = p.idat // {M})", "sk")
def _(spark, d):
    return rounded(rfi.drop_masked(powers(spark, d), full_mask(spark, d), M).data)


_SIGMA = sk_variance(M) ** 0.5


@query("zap_weight", f"""with spots as (select ipart, ichan, bool_or(abs(sk - 1) > {1.5 * _SIGMA!r}) as bad, bool_or(abs(sk - 1) > {2.0 * _SIGMA!r}) as very from sk group by all),
whole as (select ipart from spots group by ipart having count(*) filter (very) > 2),
mask as (select ipart, ichan from spots where bad or ipart in (select ipart from whole))
select idat, ichan, ipol, {r('v')} as v, zapped from ({_ZAPPED})""", "sk")
def _(spark, d):
    power = powers(spark, d)
    return rounded(rfi.zap_by_estimate(power, rfi.kurtosis(power, M), M, 1.5, 2, 2.0))


# Weights --------------------------------------------------------------------------------------


def some_weights(spark, d, per: int = 10) -> DataFrame:
    """A block is bad if its number of low values is a multiple of seven."""
    rows = spec(spark, d).data.groupBy(F.expr(f"idat div {per}").alias("iweight")).agg(F.count_if(F.abs("v") < 0.1).alias("low"))
    return rows.select("iweight", F.when(F.col("low") % 7 == 0, 0).otherwise(1).alias("weight"))


_SOME = "w as (select idat // 10 as iweight, case when count_if(abs(v) < 0.1) % 7 = 0 then 0 else 1 end as weight from spec group by 1)"


@query("weight_drop", f"with {_SOME} select idat, ichan, ipol, v from spec join w on iweight = idat // 10 where weight <> 0", "spec")
def _(spark, d):
    return weights.drop_bad(spec(spark, d), some_weights(spark, d), 10).data


@query("weight_mask", "select iweight, min(case when low <= 1 then 0 else 1 end)::int as weight from (select idat // 10 as iweight, ichan, count_if(abs(v) < 0.1) as low from spec group by all) group by iweight", "spec")
def _(spark, d):
    """A block with a channel of one low value at most is bad in all channels."""
    low = weights.low_counts(spec(spark, d), 10, 0.1)
    return weights.mask_across(low.select("iweight", "ichan", F.when(F.col("nlow") <= 1, 0).otherwise(1).alias("weight")), ("ichan",))


@query("weight_convolve", f"with {_SOME} select b as iblock, min(weight)::int as weight from w, (select unnest(range((max(idat) + 1 - 32) // 24 + 1)) as b from spec) as t where iweight * 10 < b * 24 + 32 and iweight * 10 + 9 >= b * 24 group by b", "spec")
def _(spark, d):
    return weights.convolved(some_weights(spark, d), 10, 32, 24, (spec(spark, d).obs.ndat - 32) // 24 + 1)


@query("weight_scrunch", f"with {_SOME} select iweight // 3 as iweight, (case when min(weight) = 0 then 0 else sum(weight) end)::bigint as weight from w group by iweight // 3", "spec")
def _(spark, d):
    return weights.scrunched(some_weights(spark, d), 3)


@query("excision", f"""with c as (select idat // 50 as w, ichan, ipol, count(*) as n, count(*) filter (abs(v) < 0.1) as nlow from spec group by all)
select s.idat, s.ichan, s.ipol, case when nlow / n between 0.5 and 0.62 then v else 0.0 end as v, (case when nlow / n between 0.5 and 0.62 then 1 else 0 end)::int as weight from spec s join c on c.w = s.idat // 50 and c.ichan = s.ichan and c.ipol = s.ipol""", "spec")
def _(spark, d):
    return weights.excise(spec(spark, d), 50, 0.1, 0.5, 0.62)


@query("two_bit_levels", """with codes as (select idat, ichan, ipol, (case when v < -0.1 then 0 when v < 0 then 1 when v < 0.1 then 2 else 3 end) as code from spec),
c as (select idat // 50 as w, ichan, count(*) filter (code in (1, 2)) as nlow from codes group by all)
select k.idat, k.ichan, k.ipol, case when nlow between 25 and 34 then (case when code in (1, 2) then 1.0 else 3.0 + nlow / 100.0 end) * (case when code < 2 then -1.0 else 1.0 end) else 0.0 end as v, (case when nlow between 25 and 34 then 1 else 0 end)::int as weight from codes k join c on c.w = k.idat // 50 and c.ichan = k.ichan""", "spec")
def _(spark, d):
    signal = spec(spark, d)
    code = F.when(F.col("v") < -0.1, 0).when(F.col("v") < 0, 1).when(F.col("v") < 0.1, 2).otherwise(3)
    levels = spark.range(25, 35).select(F.col("id").alias("nlow"), F.lit(1.0).alias("lo"), (3.0 + F.col("id") / 100.0).alias("hi"))
    return weights.two_bit_levels(Signal(signal.data.withColumn("code", code), signal.obs), 50, levels)


#: Nlow of 50, and the levels within and beyond the threshold, in its units.
_DYNAMIC = """(25, 0.559968152, 2.020557929), (26, 0.558305043, 1.959204116), (27, 0.556527711, 1.902289673), (28, 0.554627443, 1.849321333), (29, 0.552594305, 1.799872171), (30, 0.550416922, 1.753570251), (31, 0.548082185, 1.710089407), (32, 0.545574902, 1.669141662), (33, 0.542877341, 1.630470922), (34, 0.539968638, 1.593847640)"""


@query("two_bit_dynamic", f"""with levels as (select nlow, lo::double as lo, hi::double as hi from (values {_DYNAMIC}) as t(nlow, lo, hi)), codes as (select idat, ichan, ipol, (case when v < -0.1 then 0 when v < 0 then 1 when v < 0.1 then 2 else 3 end) as code from spec),
c as (select idat // 50 as w, ichan, count(*) filter (code in (1, 2)) as nlow from codes group by all)
select k.idat, k.ichan, k.ipol, {r('case when lo is null then 0.0 else (case when code in (1, 2) then lo else hi end) * (case when code < 2 then -1.0 else 1.0 end) end')} as v, (case when lo is null then 0 else 1 end)::int as weight
from codes k join c on c.w = k.idat // 50 and c.ichan = k.ichan left join levels on levels.nlow = c.nlow""", "spec")
def _(spark, d):
    signal = spec(spark, d)
    code = F.when(F.col("v") < -0.1, 0).when(F.col("v") < 0, 1).when(F.col("v") < 0.1, 2).otherwise(3)
    return rounded(weights.two_bit_levels(Signal(signal.data.withColumn("code", code), signal.obs), 50, weights.dynamic_levels(spark, 50, 0.5, 0.69)))


# Calibration ------------------------------------------------------------------------------------

_RECEIVER = "receiver as (select ichan, sqrt(2 * avg(pp)) as gain, sqrt(avg(qq) / avg(pp)) as ratio, atan2(avg(im), avg(re)) as phase from coh group by ichan)"
_CALIBRATED = "calibrated as (select idat, v.ichan, ipol, case when ipol = 0 then re / gain else (re * cos(phase) + im * sin(phase)) / (gain * ratio) end as re, case when ipol = 0 then im / gain else (im * cos(phase) - re * sin(phase)) / (gain * ratio) end as im from volt v join receiver using (ichan))"


@query("receiver_parameters", f"with {_RECEIVER} select ichan, {r('gain')} as gain, {r('ratio')} as ratio, {r('phase')} as phase from receiver", "coh")
def _(spark, d):
    return rounded(calibrate.receiver_parameters(detect.coherence(volt(spark, d))))


@query("calibrated", f"with {_RECEIVER}, {_CALIBRATED} select idat, ichan, ipol, {r('re')} as re, {r('im')} as im from calibrated", "coh")
def _(spark, d):
    return rounded(calibrate.calibrated(volt(spark, d), calibrate.receiver_parameters(detect.coherence(volt(spark, d)))).data)


@query("calibrated_in_convolution", f"with {_RECEIVER}, {_CALIBRATED} select idat - 8 as idat, ichan, ipol, {r('re')} as re, {r('im')} as im from calibrated where idat >= 8 and idat - 8 < (select ((max(idat) + 1 - 64) // 48 + 1) * 48 from volt)", "coh")
def _(spark, d):
    signal = volt(spark, d)
    found = calibrate.calibration_responses(calibrate.receiver_parameters(detect.coherence(signal)), 64)
    return rounded(kernels.convolve_matrix(signal, found, (8, 8)).data)


# Digitizing -----------------------------------------------------------------------------------


def _digitized(bits: int) -> str:
    return f"select idat, ichan, ipol, greatest(0, least({(1 << bits) - 1}, trunc((v * 8) * {digitize.CODE_SCALE[bits]!r} + {digitize.CODE_MEAN[bits]!r} + 0.5)))::int as code from spec"


def codes_of(spark, d, bits: int) -> DataFrame:
    return digitize.digitize(spec(spark, d), bits, 1 / 8)


for _bits in (1, 2, 4, 8, 16):
    query(f"digitize_{_bits}", _digitized(_bits), "spec")(lambda spark, d, bits=_bits: codes_of(spark, d, bits))


@query("digitize_fits", f"""with m as (select idat // 100 as b, ichan, ipol, avg(v) as mean, sqrt(greatest(avg(v * v) - avg(v) * avg(v), 0.0)) as sd from spec group by all)
select idat, s.ichan, s.ipol, greatest(0, least(255, trunc((v - mean) / case when sd > 0 then sd else 1.0 end * {digitize.CODE_SCALE[8]!r} + 128.0)))::int as code, {r('mean')} as offset, {r('case when sd > 0 then sd else 1.0 end')} as scale from spec s join m on m.b = idat // 100 and m.ichan = s.ichan and m.ipol = s.ipol""", "spec")
def _(spark, d):
    return rounded(digitize.digitize_by_block(spec(spark, d), 8, 100))


_TWO = f"codes as ({_digitized(2)})"
_PACKED = "select ichan, ipol, idat // 4 as ibyte, sum(code << (2 * (idat % 4))::int)::int as byte from codes group by all"


@query("pack_bits", f"with {_TWO} {_PACKED}", "spec")
def _(spark, d):
    return digitize.pack_bits(codes_of(spark, d, 2), 2, "ichan", "ipol")


@query("unpack_bits", f"with {_TWO}, p as ({_PACKED}) select ichan, ipol, ibyte * 4 + k as idat, ((byte >> (2 * k)::int) & 3)::int as code from p, range(4) as t(k)", "spec")
def _(spark, d):
    packed = digitize.pack_bits(codes_of(spark, d, 2), 2, "ichan", "ipol")
    return digitize.unpack_bits(packed, 2, "ichan", "ipol")


@query("decode_levels", f"with {_TWO} select idat, ichan, ipol, code, [-{digitize.OUTER}, -1.0, 1.0, {digitize.OUTER}][code + 1]::double as v from codes", "spec")
def _(spark, d):
    return digitize.decode(codes_of(spark, d, 2), 2)


@query("unpack_scale_offset", f"with codes as ({_digitized(8)}) select idat, ichan, ipol, code, {r('(code - 127.5) * (1 + ichan / 64.0) + ichan')} as v from codes", "spec")
def _(spark, d):
    scales = spark.range(64).select(F.col("id").cast("int").alias("ichan"), (1 + F.col("id") / 64.0).alias("scale"), F.col("id").cast("double").alias("offset"))
    return rounded(digitize.scale_offset(codes_of(spark, d, 8), scales, ["ichan"], 127.5), "v")


@query("one_bit", f"with codes as ({_digitized(1)}) select idat, ichan, ipol, code, case when code = 1 then 0.5 else -0.5 end::double as v from codes", "spec")
def _(spark, d):
    return digitize.one_bit(codes_of(spark, d, 1), 0.5)


@query("digitizer_histogram", f"with {_TWO} select ichan, ipol, code, count(*) as n from codes group by all", "spec")
def _(spark, d):
    return digitize.code_histogram(codes_of(spark, d, 2))


# Kernels --------------------------------------------------------------------------------------


def _dft(n: int) -> str:
    turn = f"(2 * pi() * k * (idat % {n}) / {n})"
    return f"select idat // {n} as b, ichan, ipol, k, sum(re * cos{turn} + im * sin{turn}) as re, sum(im * cos{turn} - re * sin{turn}) as im from volt, range({n}) as t(k) where idat < (select (max(idat) + 1) // {n} * {n} from volt) group by all"


@query("filterbank_dft_16", f"select b as idat, (ichan * 16 + (k + 8) % 16)::int as ichan, ipol, {r('re')} as re, {r('im')} as im from ({_dft(16)})", "volt")
def _(spark, d):
    return rounded(kernels.filterbank(volt(spark, d), 16).data)


@query("tfp_filterbank", f"select b as idat, (ichan * 8 + (k + 4) % 8)::int as ichan, 0::int as ipol, {r('sum(re * re + im * im)')} as v from ({_dft(8)}) group by all", "volt")
def _(spark, d):
    return rounded(kernels.tfp_filterbank(volt(spark, d), 8, sum_polarizations=True).data)


@query("voltage_bandpass", f"select (ichan * 8 + (k + 4) % 8)::int as ichan, ipol, {r('sum(re * re + im * im)')} as total, count(*) as n from ({_dft(8)}) group by 1, 2", "volt")
def _(spark, d):
    return rounded(kernels.voltage_bandpass(volt(spark, d), 8))


@query("bandpass_products", f"""with z as ({_dft(8)}), p as (select b, ichan, k, max(re) filter (ipol = 0) as r0, max(im) filter (ipol = 0) as i0, max(re) filter (ipol = 1) as r1, max(im) filter (ipol = 1) as i1 from z group by all),
s as (select (ichan * 8 + (k + 4) % 8)::int as ichan, [sum(r0 * r0 + i0 * i0), sum(r1 * r1 + i1 * i1), sum(r0 * r1 + i0 * i1), sum(r0 * i1 - i0 * r1)] as v, count(*) as n from p group by 1)
select ichan, j::int as ipol, {r('v[j + 1]')} as total, n from s, range(4) as x(j)""", "volt")
def _(spark, d):
    """Passband of both polarizations' four products."""
    return rounded(kernels.voltage_bandpass(volt(spark, d), 8, full=True))


@query("incoherent_filterbank", f"""with x as (select idat // 16 as b, ichan, ipol, idat % 16 as j, re as v from volt where idat < (select (max(idat) + 1) // 16 * 16 from volt)),
z as (select b, ichan, ipol, k, sum(v * cos(pi() * k * j / 8)) as c, sum(v * sin(pi() * k * j / 8)) as s from x, range(8) as t(k) group by all)
select b as idat, (ichan * 8 + k)::int as ichan, 0::int as ipol, {r('sum(c * c + s * s)')} as v from z group by b, ichan, k""", "volt")
def _(spark, d):
    """Eight channels of real voltages (the voltages' real part), both polarizations' powers added."""
    signal = volt(spark, d)
    real = Signal(signal.data.select("idat", "ichan", "ipol", F.col("re").alias("v")), replace(signal.obs, state="Nyquist", ndim=1))
    return rounded(kernels.incoherent_filterbank(real, 8).data)


@query("dft_expression", f"select b, ichan, ipol, k::int as k, {r('re')} as re, {r('im')} as im from ({_dft(8)})", "volt")
def _(spark, d):
    signal = volt(spark, d)
    rows = signal.data.filter(F.col("idat") < signal.obs.ndat // 8 * 8).groupBy(F.expr("idat div 8").alias("b"), "ichan", "ipol").agg(F.array_sort(F.collect_list(F.struct("idat", "re", "im"))).alias("z"))
    return rounded(kernels.dft(rows.select("b", "ichan", "ipol", F.col("z.re").alias("re"), F.col("z.im").alias("im")), 8))


_KEPT = "(select ((max(idat) + 1 - 64) // 48 + 1) * 48 from volt)"


@query("convolve_delta", f"select idat - 8 as idat, ichan, ipol, {r('re')} as re, {r('im')} as im from volt where idat >= 8 and idat - 8 < {_KEPT}", "volt")
def _(spark, d):
    return rounded(kernels.convolve(volt(spark, d), np.ones(64, complex), (8, 8)).data)


@query("convolve_matrix", f"select idat - 8 as idat, ichan, (1 - ipol)::int as ipol, {r('re')} as re, {r('im')} as im from volt where idat >= 8 and idat - 8 < {_KEPT}", "volt")
def _(spark, d):
    swap = np.broadcast_to(np.array([[0, 1], [1, 0]], complex), (64, 2, 2))
    return rounded(kernels.convolve_matrix(volt(spark, d), swap, (8, 8)).data)


#: An impulse response of three taps, and the response of 64 points that has it.
TAPS = (0.5, 0.3 - 0.1j, -0.2j)
_AT = "partition by ichan, ipol order by idat"


def taps_response(scale: float = 1.0) -> np.ndarray:
    return np.fft.fft([x * scale for x in TAPS], 64)


def _tapped(re: str = "re", im: str = "im") -> tuple[str, str]:
    """The three taps over earlier samples, spelled out."""
    return (f"0.5 * {re} + 0.3 * lag({re}, 1) over w + 0.1 * lag({im}, 1) over w + 0.2 * lag({im}, 2) over w", f"0.5 * {im} + 0.3 * lag({im}, 1) over w - 0.1 * lag({re}, 1) over w - 0.2 * lag({re}, 2) over w")


_TAPPED = f"select idat, ichan, ipol, {_tapped()[0]} as re, {_tapped()[1]} as im from volt window w as ({_AT})"


@query("convolve_taps", f"select idat - 8 as idat, ichan, ipol, {r('re')} as re, {r('im')} as im from ({_TAPPED}) where idat >= 8 and idat - 8 < {_KEPT}", "volt")
def _(spark, d):
    return rounded(kernels.convolve(volt(spark, d), taps_response(), (8, 8)).data)


@query("convolve_product", f"""with a as (select idat, ichan, ipol, 0.5 * re + 0.3 * lag(re, 1) over w + 0.25 * lag(re, 2) over w + 0.15 * lag(re, 3) over w as re, 0.5 * im + 0.3 * lag(im, 1) over w + 0.25 * lag(im, 2) over w + 0.15 * lag(im, 3) over w as im from volt window w as ({_AT}))
select idat - 8 as idat, ichan, ipol, {r('re * (1 + ichan / 16.0)')} as re, {r('im * (1 + ichan / 16.0)')} as im from a where idat >= 8 and idat - 8 < {_KEPT}""", "volt")
def _(spark, d):
    """Two responses and a gain by channel, multiplied first: one transform for all."""
    n = taps_response().shape[-1]
    first, second = np.zeros(n), np.zeros(n)
    first[:2], second[[0, 2]] = (0.5, 0.3), (1, 0.5)
    gains = (1 + np.arange(16) / 16)[:, None] * np.ones(n)
    whole = responses.product([np.fft.fft(first)[None], np.fft.fft(second)[None], gains], match=2)
    return rounded(kernels.convolve(volt(spark, d), dict(enumerate(whole)), (8, 8)).data)


@query("convolve_by_channel", f"select idat - 8 as idat, ichan, ipol, {r('re * (1 + ichan / 16.0)')} as re, {r('im * (1 + ichan / 16.0)')} as im from ({_TAPPED}) where idat >= 8 and idat - 8 < {_KEPT}", "volt")
def _(spark, d):
    return rounded(kernels.convolve(volt(spark, d), {c: taps_response(1 + c / 16) for c in range(16)}, (8, 8)).data)


@query("convolve_matrix_taps", f"""with t as ({_TAPPED}), m as (select t.idat, t.ichan, t.ipol, case when t.ipol = 0 then t.re else v.re end as re, case when t.ipol = 0 then t.im else v.im end as im, 2 * o.re as ore, 2 * o.im as oim
  from t join volt v on v.idat = t.idat and v.ichan = t.ichan and v.ipol = t.ipol join volt o on o.idat = t.idat - 1 and o.ichan = t.ichan and o.ipol = 1 - t.ipol)
select idat - 8 as idat, ichan, ipol, {r('re - oim')} as re, {r('im + ore')} as im from m where idat >= 8 and idat - 8 < {_KEPT}""", "volt")
def _(spark, d):
    """Taps on the first polarization, and 2i times the other one a sample before on both."""
    jones = np.zeros((64, 2, 2), complex)
    jones[:, 0, 0], jones[:, 1, 1] = taps_response(), 1
    jones[:, 0, 1] = jones[:, 1, 0] = np.fft.fft([0, 2j], 64)
    return rounded(kernels.convolve_matrix(volt(spark, d), jones, (8, 8)).data)


@query("filterbank_res_4", f"""with z as (select b, ichan, ipol, ((k + 8) % 16) // 4 as c, ((k + 8) % 16 + 2) % 4 as j, re, im from ({_dft(16)}))
select b * 4 + t as idat, (ichan * 4 + c)::int as ichan, ipol, {r('sum(re * cos(pi() * j * t / 2) - im * sin(pi() * j * t / 2)) / 4')} as re, {r('sum(im * cos(pi() * j * t / 2) + re * sin(pi() * j * t / 2)) / 4')} as im from z, range(4) as x(t) group by b, t, ichan, c, ipol""", "volt")
def _(spark, d):
    return rounded(kernels.filterbank(volt(spark, d), 4, 4).data)


@query("passband_in_convolution", f"""with t as (select j, (case when j = 0 then 0.5 when j = 1 then 0.3 else 0 end)::double as a, (case when j = 1 then -0.1 when j = 2 then -0.2 else 0 end)::double as c from range(3) as t(j)),
h as (select k, sum(a * cos(2 * pi() * k * j / 64) + c * sin(2 * pi() * k * j / 64)) as hr, sum(c * cos(2 * pi() * k * j / 64) - a * sin(2 * pi() * k * j / 64)) as hi from t, range(64) as p(k) group by k),
w as (select b, idat - b * 48 as m, ichan, ipol, re, im from volt join range((select max(idat) + 1 from volt)) as x(b) on idat >= b * 48 and idat < b * 48 + 64 where b * 48 + 64 <= (select max(idat) + 1 from volt)),
z as (select b, ichan, ipol, k, sum(re * cos(2 * pi() * (k * m % 64) / 64) + im * sin(2 * pi() * (k * m % 64) / 64)) as zr, sum(im * cos(2 * pi() * (k * m % 64) / 64) - re * sin(2 * pi() * (k * m % 64) / 64)) as zi from w, range(64) as p(k) group by all)
select ichan, ipol, k::int as point, {r('sum((zr * zr + zi * zi) * (hr * hr + hi * hi))')} as total, count(*) as n from z join h using (k) group by ichan, ipol, k""", "volt")
def _(spark, d):
    return rounded(kernels.passband(volt(spark, d), taps_response(), (8, 8)))


@query("autocorr_lags", f"select a.idat // 32 as part, a.ichan, a.ipol, (b.idat - a.idat)::int as lag, {r('sum(a.v * b.v)')} as r from spec a join spec b on a.ichan = b.ichan and a.ipol = b.ipol and b.idat >= a.idat and b.idat < a.idat + 8 and a.idat // 32 = b.idat // 32 group by all", "spec")
def _(spark, d):
    return rounded(kernels.lag_products(spec(spark, d).data, 8, 32, F.col("v")))


@query("acf_filterbank", f"select a.idat // 16 as idat, a.ichan, a.ipol, (b.idat - a.idat)::int as lag, {r('sum(b.re * a.re + b.im * a.im)')} as re, {r('sum(b.im * a.re - b.re * a.im)')} as im from volt a join volt b on a.ichan = b.ichan and a.ipol = b.ipol and b.idat >= a.idat and a.idat // 16 = b.idat // 16 where a.idat < (select (max(idat) + 1) // 16 * 16 from volt) group by all", "volt")
def _(spark, d):
    return rounded(kernels.autocorrelation_fft(volt(spark, d), 16))


_ACF = "acf as (select a.idat // 32 as part, a.ichan, (b.idat - a.idat)::int as lag, sum(a.v * b.v) as r from spec a join spec b on a.ichan = b.ichan and b.idat >= a.idat and b.idat < a.idat + 8 and a.idat // 32 = b.idat // 32 group by all)"


@query("lag_spectra", f"with {_ACF}, whole as (select part, ichan from acf group by all having count(*) = 8) select part, ichan as input, k::int as ichan, {r('sum(case when lag = 0 then r else 2 * r * cos(pi() / 8 * lag * (k + 0.5)) end)')} as v from acf join whole using (part, ichan), range(8) as t(k) group by all", "spec")
def _(spark, d):
    found = kernels.lag_products(spec(spark, d).data, 8, 32, F.col("v"))
    return rounded(lags.lag_spectra(found.select("part", F.col("ichan").alias("input"), "lag", "r"), 8, "part", "input"))


@query("lag_spectra_one_bit", f"""with signs as (select idat, ichan, sign(v) as v from spec), acf as (select a.idat // 32 as part, a.ichan, (b.idat - a.idat)::int as lag, sum(a.v * b.v) as r from signs a join signs b on a.ichan = b.ichan and b.idat >= a.idat and b.idat < a.idat + 8 and a.idat // 32 = b.idat // 32 group by all),
whole as (select part, ichan, max(r) filter (lag = 0) as zero from acf group by all having count(*) = 8)
select part, ichan as input, k::int as ichan, {r('sum(case when lag = 0 then r else 2 * zero * sin(pi() / 2 * r / zero) * cos(pi() / 8 * lag * (k + 0.5)) end)')} as v from acf join whole using (part, ichan), range(8) as t(k) group by all""", "spec")
def _(spark, d):
    found = kernels.lag_products(spec(spark, d).data, 8, 32, F.signum("v"))
    return rounded(lags.lag_spectra(found.select("part", F.col("ichan").alias("input"), "lag", "r"), 8, "part", "input", one_bit=True))


@query("lags_three_level")
def _(spark, d):
    """Correlations of the samples behind three levels."""
    level = F.when(F.col("v") > 0.08, 1.0).when(F.col("v") < -0.08, -1.0).otherwise(0.0)
    found = kernels.lag_products(spec(spark, d).data, 8, 64, level / 8)  # 64 samples a part
    return rounded(lags.quantizer_corrected(found, 8, 3, "part", "ichan", "ipol"))


@query("search_rows", f"with codes as ({_digitized(2)}) select idat // 64 as irow, {r('((idat // 64 + 0.5) * 0.064)::double')} as offset_seconds, count(*)::int as n, sum(code)::bigint as total from codes group by idat // 64", "spec")
def _(spark, d):
    rows = unload.search_rows(codes_of(spark, d, 2), spec(spark, d).obs, 64)
    return rounded(rows.select("irow", "offset_seconds", F.size("data").alias("n"), F.aggregate("data", F.lit(0).cast("long"), lambda a, b: a + b).alias("total")))


@query("profile_names", f"select distinct (us - {EPOCH}) // {DAY} as subint, strftime(make_timestamp(us // {DAY} * {DAY}), '%Y-%m-%d-%H:%M:%S') as by_epoch, 'pulse_' || lpad(((us - {EPOCH}) // {DAY})::varchar, 10, '0') as by_pulse, printf('%04d/%08d', (us - {EPOCH}) // {DAY} // 10, (us - {EPOCH}) // {DAY}) as in_sequence from sig", "sig")
def _(spark, d):
    subints = sig(spark, d).data.select(fold.division(F.col("us"), EPOCH, DAY).alias("subint")).distinct()
    return subints.select("subint", unload.name_by_epoch(F.col("subint") * DAY + EPOCH).alias("by_epoch"), unload.name_by_pulse(F.col("subint")).alias("by_pulse"), unload.name_in_sequence(F.col("subint"), 10).alias("in_sequence"))


for _kind, _sql in {"hann": "0.5 * (1 - cos(2 * pi() * (idat % 32) / 31))", "welch": "1 - pow((idat % 32 - 15.5) / 15.5, 2)", "bartlett": "1 - abs((idat % 32 - 15.5) / 15.5)"}.items():

    def _apodized(spark, d, kind=_kind):
        values = F.array(*[F.lit(float(x)) for x in window(kind, 32)])
        return rounded(spec(spark, d).data.withColumn("v", F.col("v") * F.element_at(values, (F.col("idat") % 32 + 1).cast("int"))))

    query(f"apodize_{_kind}", f"select idat, ichan, ipol, {r(f'v * ({_sql})')} as v from spec", "spec")(_apodized)


_X = "((m - 15.5) / 8)"


@query("polyphase_filterbank", f"""with w as (select b, idat - b * 8 as m, ichan, ipol, re, im from volt join range((select max(idat) + 1 from volt)) as x(b) on idat >= b * 8 and idat < b * 8 + 32 where b * 8 + 32 <= (select max(idat) + 1 from volt)),
t as (select m, (0.5 - 0.5 * cos(2 * pi() * m / 31)) * sin(pi() * {_X}) / (pi() * {_X}) as tap from range(32) as x(m))
select b as idat, (ichan * 8 + (k + 4) % 8)::int as ichan, ipol, {r('sum(tap * (re * cos(pi() * k * m / 4) + im * sin(pi() * k * m / 4)))')} as re, {r('sum(tap * (im * cos(pi() * k * m / 4) - re * sin(pi() * k * m / 4)))')} as im
from w join t using (m), range(8) as y(k) group by b, k, ichan, ipol""", "volt")
def _(spark, d):
    taps = np.hanning(32) * np.sinc((np.arange(32) - 15.5) / 8)
    return rounded(kernels.polyphase_filterbank(volt(spark, d), 8, taps).data)


_OFF = "((case when k < 32 then k else k - 64 end) / 64.0 * -25.0)"
_F0 = "(1382.0 + 200.0 - 12.5 - 25.0 * ichan)"


@query("chirp_convolve", f"""with h as (select ichan, k, case when k = 0 then 0.0 else cos(phase) end as hr, case when k = 0 then 0.0 else sin(phase) end as hi
  from (select ichan, k, 2e6 * pi() * 2.0 / 2.41e-4 * {_OFF} * {_OFF} / ({_F0} * {_F0} * ({_F0} + {_OFF})) as phase from range(16) as c(ichan), range(64) as p(k))),
w as (select b, idat - b * 48 as m, ichan, ipol, re, im from volt join range((select max(idat) + 1 from volt)) as x(b) on idat >= b * 48 and idat < b * 48 + 64 where b * 48 + 64 <= (select max(idat) + 1 from volt)),
z as (select b, ichan, ipol, k, sum(re * cos(2 * pi() * (k * m % 64) / 64) + im * sin(2 * pi() * (k * m % 64) / 64)) as zr, sum(im * cos(2 * pi() * (k * m % 64) / 64) - re * sin(2 * pi() * (k * m % 64) / 64)) as zi from w, range(64) as p(k) group by all),
y as (select b, z.ichan, ipol, z.k, zr * hr - zi * hi as yr, zr * hi + zi * hr as yi from z join h on h.ichan = z.ichan and h.k = z.k)
select b * 48 + t - 8 as idat, ichan, ipol, {r('sum(yr * cos(2 * pi() * (k * t % 64) / 64) - yi * sin(2 * pi() * (k * t % 64) / 64)) / 64')} as re, {r('sum(yi * cos(2 * pi() * (k * t % 64) / 64) + yr * sin(2 * pi() * (k * t % 64) / 64)) / 64')} as im
from y, range(8, 56) as x(t) group by b, t, ichan, ipol""".replace("{_OFF}", _OFF), "volt")
def _(spark, d):
    return rounded(kernels.coherent_dedispersion(volt(spark, d), 64, (8, 8)).data)


_CP, _CB, _CL = 20, 4, 5


_LAGS = f"select a.ichan, a.ipol, (b.idat - a.idat)::int as lag, ((2 * a.idat + b.idat - a.idat) % {2 * _CP} * {_CB} // {2 * _CP})::int as ibin, sum(a.re * b.re + a.im * b.im) as re, sum(a.im * b.re - a.re * b.im) as im, count(*) as hits from volt a join volt b on a.ichan = b.ichan and a.ipol = b.ipol and b.idat >= a.idat and b.idat < a.idat + {_CL} group by all"


@query("cyclic_lags", f"select ichan, ipol, lag, ibin, {r('re')} as re, {r('im')} as im, hits from ({_LAGS})", "volt")
def _(spark, d):
    return rounded(cyclic.cyclic_lags(volt(spark, d), _CL, _CP, _CB))


_CROSS = f"select a.ichan, {{pol}} as ipol, (b.idat - a.idat)::int as lag, ((2 * a.idat + b.idat - a.idat) % {2 * _CP} * {_CB} // {2 * _CP})::int as ibin, {r('sum(a.re * b.re + a.im * b.im)')} as re, {r('sum(a.im * b.re - a.re * b.im)')} as im, count(*) as hits from volt a join volt b on a.ichan = b.ichan and {{pair}} and b.idat >= a.idat and b.idat < a.idat + {_CL} group by all"


@query("cyclic_products", " union all ".join(f"({_CROSS.format(pol=pol, pair=pair)})" for pol, pair in (("a.ipol", "a.ipol = b.ipol"), ("(2 + a.ipol)::int", "a.ipol = 1 - b.ipol"))).replace("(", "select * from (", 1), "volt")
def _(spark, d):
    """Lag products of both polarizations, and of each with the other."""
    return rounded(cyclic.cyclic_lags(volt(spark, d), _CL, _CP, _CB, products=4))


@query("cyclic_fold", f"""select (ichan * 8 + n)::int as ichan, ipol, ibin, {r('sum(case when lag in (0, 4) then re / hits * case when lag = 4 and n % 2 = 1 then -1 else 1 end else 2 * (re * cos(pi() * lag * n / 4) - im * sin(pi() * lag * n / 4)) / hits end) / 8')} as v
from ({_LAGS}), range(8) as t(n) group by ichan, n, ipol, ibin""", "volt")
def _(spark, d):
    return rounded(cyclic.cyclic_spectra(cyclic.cyclic_lags(volt(spark, d), _CL, _CP, _CB), _CL))


@query("cyclic_fold_subint", f"select a.idat // 100 as subint, a.ichan, a.ipol, (b.idat - a.idat)::int as lag, ((2 * a.idat + b.idat - a.idat) % {2 * _CP} * {_CB} // {2 * _CP})::int as ibin, {r('sum(a.re * b.re + a.im * b.im)')} as re, {r('sum(a.im * b.re - a.re * b.im)')} as im, count(*) as hits from volt a join volt b on a.ichan = b.ichan and a.ipol = b.ipol and b.idat >= a.idat and b.idat < a.idat + {_CL} group by all", "volt")
def _(spark, d):
    return rounded(cyclic.cyclic_lags(volt(spark, d), _CL, _CP, _CB, 100))


_SLOT = f"""with slots as (select t, s, t * {_CP} + s * {_CP} // {_CB} as b from (select distinct idat // {_CP} as t from volt), range({_CB}) as x(s)),
whole as (select t, s, b from slots where b + 4 <= (select max(idat) + 1 from volt)),
z as (select t, s, ichan, ipol, k, sum(re * cos(2 * pi() * k * (idat - b) / 4) + im * sin(2 * pi() * k * (idat - b) / 4)) as re, sum(im * cos(2 * pi() * k * (idat - b) / 4) - re * sin(2 * pi() * k * (idat - b) / 4)) as im from whole join volt on idat >= b and idat < b + 4, range(4) as y(k) group by all)
select (ichan * 4 + k)::int as ichan, ipol, s::int as ibin, {r('sum(re * re + im * im)')} as v, count(*) as hits from z group by 1, 2, 3"""


@query("phase_locked_products", _SLOT[: _SLOT.index("select (ichan * 4 + k)::int")].rstrip() + f""",
y as (select t, s, ichan, k, max(re) filter (ipol = 0) as r0, max(im) filter (ipol = 0) as i0, max(re) filter (ipol = 1) as r1, max(im) filter (ipol = 1) as i1 from z group by all),
q as (select (ichan * 4 + k)::int as ichan, s::int as ibin, [sum(r0 * r0 + i0 * i0), sum(r1 * r1 + i1 * i1), sum(r0 * r1 + i0 * i1), sum(r0 * i1 - i0 * r1)] as v, count(*) as hits from y group by 1, 2)
select ichan, j::int as ipol, ibin, {r('v[j + 1]')} as v, hits from q, range(4) as x(j)""", "volt")
def _(spark, d):
    """Spectra by phase of both polarizations' four products."""
    return rounded(cyclic.phase_locked(volt(spark, d), 4, _CP, _CB, products=4))


@query("phase_locked_subint", _SLOT.replace("select (ichan * 4 + k)::int", f"select t * {_CP} // 100 as subint, (ichan * 4 + k)::int").replace("group by 1, 2, 3", "group by 1, 2, 3, 4"), "volt")
def _(spark, d):
    return rounded(cyclic.phase_locked(volt(spark, d), 4, _CP, _CB, 100))


@query("phase_locked", _SLOT, "volt")
def _(spark, d):
    return rounded(cyclic.phase_locked(volt(spark, d), 4, _CP, _CB))


# Sources and sinks ----------------------------------------------------------------------------


@query("header_parse", """with h as (select s_suppkey as id, 'HDR_VERSION 1.0' || chr(10) || 'source ' || s_name || ' # the name' || chr(10) || '# nothing' || chr(10) || 'NBIT ' || (s_nationkey + 1) || chr(10) || 'EMPTY' || chr(10) as text from supplier),
l as (select id, trim(string_split(unnest(string_split(text, chr(10))), '#')[1]) as line from h)
select id, upper(regexp_extract(line, '^(\\S+)', 1)) as key, regexp_extract(line, '^\\S+\\s+(.*\\S)\\s*$', 1) as value from l where regexp_matches(line, '^\\S+\\s+\\S')""")
def _(spark, d):
    text = F.concat(F.lit("HDR_VERSION 1.0\nsource "), F.col("s_name"), F.lit(" # the name\n# nothing\nNBIT "), F.col("s_nationkey") + 1, F.lit("\nEMPTY\n"))
    return headers.header_rows(table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), text.alias("text")))


@query("multifile_gap", """with f as (select o_orderdate::date as day, epoch_us(o_orderdate::date::timestamp)::bigint as start_us, count(*) as ndat from orders group by all),
g as (select start_us, ndat, start_us - lag(start_us + ndat / 0.0002 * 1000000.0) over (order by start_us) as gap_us from f)
select start_us, ndat, 0.0002::double as rate, round(gap_us, 3) as gap_us, abs(gap_us) < 0.9e6 / 0.0002 as contiguous from g""")
def _(spark, d):
    day = F.unix_micros(F.date_trunc("day", F.col("o_orderdate").cast("timestamp")))
    files = table(spark, d, "orders").groupBy(day.alias("start_us")).agg(F.count("*").alias("ndat")).withColumn("rate", F.lit(0.0002))
    return rounded(raw.gaps(files), "gap_us", digits=3)


@query("multiplex", "select ichan, idat, v from spec where idat < (select (max(idat) + 1) // 12 * 12 from spec)", "spec")
def _(spark, d):
    """Every channel dealt over three files in packets of four samples, and put together again."""
    signal = spec(spark, d)
    rows = signal.data.filter(F.col("idat") < signal.obs.ndat // 12 * 12).withColumn("p", F.expr("idat div 4"))
    packets = rows.groupBy("ichan", (F.col("p") % 3).alias("file_no"), F.expr("p div 3").alias("packet")).agg(F.transform(F.array_sort(F.collect_list(F.struct("idat", "v"))), lambda z: z["v"]).alias("values"))
    return raw.demultiplex(packets, 3, 4)


@query("read_after_write", _digitized(8).replace(" as code", " - 127.5 as v"), "spec")
def read_after_write(spark, d):
    """Digitized, written as filterbank files, and read back by byte ranges."""
    signal = spec(spark, d)
    obs = replace(signal.obs, nbit=8, nsub_swap=0)
    files = raw.write_filterbank(codes_of(spark, d, 8), obs, scratch(spark), 128).collect()  # a row a file
    return raw.read_samples(spark, [f["url"] for f in files], force=True, samples=50).data


_BLOCKED = f"""with m as (select idat // 100 as b, ichan, ipol, avg(v) as mean, sqrt(greatest(avg(v * v) - avg(v) * avg(v), 0.0)) as sd from spec group by all)
select idat, s.ichan, s.ipol, greatest(0, least(15, trunc((v - mean) / case when sd > 0 then sd else 1.0 end * {digitize.CODE_SCALE[4]!r} + 8.0)))::int as code, {r('mean', 4)} as offset, {r('case when sd > 0 then sd else 1.0 end', 4)} as scale from spec s join m on m.b = idat // 100 and m.ichan = s.ichan and m.ipol = s.ipol"""


@query("search_files", _BLOCKED, "spec")
def _(spark, d):
    """Written as search-mode table files with scales and offsets, and read back."""
    signal = spec(spark, d)
    files = unload.write_search_files(digitize.digitize_by_block(signal, 4, 100), signal.obs, 4, 100, scratch(spark), 3)
    path = scratch(spark)
    files.write.parquet(path)  # written once, whatever reads it
    rows = unload.read_search_rows(spark.read.parquet(path), 4, 64, 1, 100)
    return rounded(rows, "offset", "scale", digits=4)


@query("dump_binary", "select idat, ichan, ipol, re, im from volt", "volt")
def _(spark, d):
    """Dumped as floats under text headers, and read back as one series."""
    files = unload.dump_binary(volt(spark, d), scratch(spark), 150).collect()  # a row a file
    return raw.read_samples(spark, [f["url"] for f in files]).data


@query("seek_over_files", "select idat - 120 as idat, ichan, ipol, re, im from volt where idat >= 120 and idat < 320", "volt")
def _(spark, d):
    """0.2 seconds from 0.12 on of a series in files of 150 samples."""
    files = unload.dump_binary(volt(spark, d), scratch(spark), 150).collect()  # a row a file
    found = raw.read_samples(spark, [f["url"] for f in files], start=0.12, total=0.2)
    assert (found.obs.ndat, found.obs.start_us) == (200, 120_000)
    return found.data


@query("byte_plan", f"""with p as (select k as subint, k * 150 as first, least(150, n - k * 150) as n, 4096 + k * 150 * 64 as begin, 4096 + (k * 150 + least(150, n - k * 150)) * 64 as end from (select max(vec_id) + 1 as n from embeddings), (select distinct vec_id // 150 as k from embeddings))
select p.*, {r('total')} as total from p join (select idat // 150 as subint, sum(v) as total from spec group by 1) using (subint)""", "spec")
def _(spark, d):
    """Where sub-integrations of 150 samples of 64 bytes lie after a header of 4096, and their totals."""
    signal = spec(spark, d)
    plan = raw.byte_plan(spark, replace(signal.obs, nbit=8), 4096, 150)
    return rounded(plan.join(signal.data.groupBy(F.expr("idat div 150").alias("subint")).agg(F.sum("v").alias("total")), "subint"))


_DECIMATED = f"""with a as (select idat // 5 as t, ichan // 4 as c, sum(v) as v from spec where idat < (select (max(idat) + 1) // 5 * 5 from spec) group by all),
m as (select t // 40 as i, c, avg(v) as avg, stddev_pop(v) as sd from a group by all)
select t as idat, a.c::int as ichan, 0::int as ipol, greatest(0, least(255, trunc((v - avg) * case when sd > 0 then 1.0 / sd else 1.0 end * {digitize.CODE_SCALE[8]!r} + 128.0)))::int - 127.5 as v from a join m on m.i = t // 40 and m.c = a.c"""


@query("decimate_files", _DECIMATED, "spec")
def _(spark, d):
    """Scrunched, rescaled and digitized anew, as files of 16 samples, and read back."""
    config = pipelines.SearchConfig(fscrunch=4, tscrunch=5, rescale_seconds=0.2, bits=8)
    files = pipelines.decimate(spec(spark, d), config, scratch(spark), 16).collect()  # a row a file
    return raw.read_samples(spark, [f["url"] for f in files], force=True).data


def scratch(spark) -> str:
    """A new folder in the one that driver and executors share."""
    return nodes.new_folder(spark, "query")


@query("synthetic_noise", "select ichan, ipol, count(*) as n, true as centred, true as unit from spec group by all", "spec")
def _(spark, d):
    """Noise on top of the table's samples: each channel's mean stays within 5 of its errors, and its
    variance grows by 1 within 5 of that's."""
    signal = spec(spark, d)
    noisy = scrunch.add(signal, raw.synthetic(spark, signal.obs))
    before = stats.channel_stats(signal).select("ichan", F.col("mean").alias("m"), F.col("sigma").alias("s"))
    both = stats.channel_stats(noisy).join(before, "ichan")
    grown = F.col("sigma") * F.col("sigma") - F.col("s") * F.col("s") - 1
    return both.select("ichan", "ipol", "n", (F.abs(F.col("mean") - F.col("m")) < 5 / F.sqrt("n")).alias("centred"), (F.abs(grown) < 5 * F.sqrt(2 / F.col("n") * (1 + 2 * F.col("s") * F.col("s")))).alias("unit"))


_LEVELS = {2: f"[-{digitize.OUTER}, -1.0, 1.0, {digitize.OUTER}][code + 1]", 4: "code - 7.5", 16: "code - 32767.5"}


def _bits_back(spark, d, bits: int) -> DataFrame:
    """Codes of so many bits in filterbank files, and read back by byte ranges."""
    files = raw.write_filterbank(codes_of(spark, d, bits), replace(spec(spark, d).obs, nbit=bits), scratch(spark), 200).collect()  # a row a file
    return raw.read_samples(spark, [f["url"] for f in files], samples=77).data


for _bits, _level in _LEVELS.items():
    query(f"read_bits_{_bits}", f"select idat, ichan, ipol, {_level}::double as v from ({_digitized(_bits)})", "spec")(lambda spark, d, bits=_bits: _bits_back(spark, d, bits))


@query("stream_samples", "select idat, ichan, ipol, re, im from volt", "volt")
def _(spark, d):
    """A file of the voltages as a stream of its samples."""
    (file,) = unload.dump_binary(volt(spark, d), scratch(spark), 1 << 40).collect()
    return folding.run_available(raw.live_samples(spark, file["url"], samples=64), scratch(spark))


# Programs -------------------------------------------------------------------------------------

_SEARCH = """with a as (select idat, ichan // 4 as c, sum(v) as v from power group by all),
b as (select idat // 5 as t, c, sum(v) as v from a where idat < (select (max(idat) + 1) // 5 * 5 from power) group by all),
m as (select t // 40 as i, c, avg(v) as avg, stddev_pop(v) as sd from b group by all)
select t as idat, b.c::int as ichan, 0::int as ipol, greatest(0, least(3, trunc((v - avg) * case when sd > 0 then 1.0 / sd else 1.0 end + 2.0)))::int as code from b join m on m.i = t // 40 and m.c = b.c"""


@query("search_mode_pipeline", _SEARCH, "power")
def _(spark, d):
    config = pipelines.SearchConfig(fscrunch=4, tscrunch=5, rescale_seconds=0.2, bits=2)
    return pipelines.search_codes(volt(spark, d), config)


_FITS = f"""with a as (select idat // 2 as t, ichan, sum(v) as v from power where idat < (select (max(idat) + 1) // 2 * 2 from power) group by all),
m as (select t // 50 as b, ichan, avg(v) as mean, sqrt(greatest(avg(v * v) - avg(v) * avg(v), 0.0)) as sd from a group by all)
select t as idat, a.ichan, 0::int as ipol, greatest(0, least(15, trunc((v - mean) / case when sd > 0 then sd else 1.0 end * 1.25 + 8.0)))::int as code, {r('mean')} as offset, {r('case when sd > 0 then sd else 1.0 end')} as scale from a join m on m.b = t // 50 and m.ichan = a.ichan"""


@query("fits_mode_pipeline", _FITS, "power")
def _(spark, d):
    return rounded(pipelines.fits_mode(volt(spark, d), pipelines.SearchConfig(tscrunch=2, bits=4), 50))


_FOLDED = f"""with p as (select idat, ichan, sum(v) as v from power group by all),
rows as (select ichan, v, (floor((idat + 0.5) * 1000.0)::bigint % 20000 * 8 // 20000)::int as ibin, floor((idat + 0.5) * 1000.0)::bigint // 100000 as subint from p),
f as (select subint, ichan, ibin, sum(v) as s, count(*) as n from rows group by all), means as (select subint, ichan, avg(s / n) as mean from f group by all)
select m.subint, m.ichan, 0::int as ipol, x.ibin::int as ibin, {r('coalesce(s / n, mean)')} as amp, coalesce(n, 0) as hits from means m cross join range(8) as x(ibin) left join f on f.subint = m.subint and f.ichan = m.ichan and f.ibin = x.ibin"""


@query("fold_pipeline", _FOLDED, "power")
def _(spark, d):
    config = pipelines.FoldConfig(period_us=20_000, nbin=8, epoch_us=0, subint_us=100_000)
    return rounded(pipelines.fold_signal(volt(spark, d), config))


@query("fold_chosen_bins", _FOLDED.replace("* 8 // 20000", "* 16 // 20000").replace("range(8)", "range(16)"), "power")
def _(spark, d):
    """As many bins as the sampling supports: 16 of a period of 20 samples."""
    return rounded(pipelines.fold_signal(volt(spark, d), pipelines.FoldConfig(period_us=20_000, epoch_us=0, subint_us=100_000)))


_SEGMENT_ROWS = f"""seg(segment, tmid, rphase, f0, c2) as (values {_VALUES}),
turned as (select ichan, ipol, v, rphase + 60.0 * ((us - tmid) / 60e6) * f0 + c2 * pow((us - tmid) / 60e6, 2) as turns from sig join seg on segment = (us - {EPOCH}) // {5 * DAY})"""


def _profile(rows: str, nbin: int, subint: str, columns: str = "") -> str:
    """Normalised profiles of rows (ichan, ipol, v, ibin, subint), gaps filled."""
    return f"""{rows}, f as (select {subint} as subint, ichan, ipol, ibin, sum(v) as s, count(*) as n from rows group by all), means as (select subint, ichan, ipol, avg(s / n) as mean from f group by all)
select {columns} m.subint, m.ichan, m.ipol, x.ibin::int as ibin, {r('coalesce(s / n, mean)')} as amp, coalesce(n, 0) as hits from means m cross join range({nbin}) as x(ibin) left join f on f.subint = m.subint and f.ichan = m.ichan and f.ipol = m.ipol and f.ibin = x.ibin"""


BY_SEGMENTS = pipelines.Ephemeris("predicted", segments=tuple(_SEGMENTS), span_us=5 * DAY, first_us=EPOCH, nbin=NBIN)
_PREDICTED = f"with {_SEGMENT_ROWS}, rows as (select *, least(floor((turns - floor(turns)) * {NBIN}), {NBIN - 1})::int as ibin from turned)"


@query("fold_program_predictor", _profile(_PREDICTED, NBIN, "0::bigint"), "sig")
def _(spark, d):
    return rounded(pipelines.fold_signal(sig(spark, d), pipelines.FoldConfig(ephemeris=BY_SEGMENTS)))


@query("subint_turns_predictor", _profile(_PREDICTED, NBIN, "floor(floor(turns) / 24)::bigint"), "sig")
def _(spark, d):
    """Sub-integrations of 24 turns, by a predictor."""
    return rounded(pipelines.fold_signal(sig(spark, d), pipelines.FoldConfig(ephemeris=BY_SEGMENTS, subint_turns=24)))


_BY_PERIOD = f"with rows as (select ichan, ipol, v, (us - {EPOCH}) % {PERIOD} * 8 // {PERIOD} as ibin from sig)"


@query("fold_program_multi", "select * from (" + with_views(_profile(_PREDICTED, NBIN, "0::bigint", "'predicted' as source,"), "sig") + ") union all select * from (" + with_views(_profile(_BY_PERIOD, 8, "0::bigint", "'constant' as source,"), "sig") + ")")
def _(spark, d):
    """Two sources, one by a predictor and one at a constant period, each with its bins."""
    sources = [BY_SEGMENTS, pipelines.Ephemeris("constant", PERIOD, nbin=8)]
    return rounded(pipelines.fold_sources(sig(spark, d), pipelines.FoldConfig(epoch_us=EPOCH), sources))


_SNAPPED = f"""with bounds as (select d, round_even(3.3 + d * 33.37, 0)::bigint as first from range(-1, (select max(idat) + 2 from spec as s0)) as t(d)),
rows as (select (select max(d) from bounds where first <= idat) as subint, ichan, ipol, v from spec)
select subint, ichan, count(*) as n, {r('sum(v)')} as total from rows group by all"""


@query("subint_snapped", _SNAPPED.replace("(select max(d) from bounds where first <= idat)", "b.d").replace("from spec)", "from spec join bounds b on first <= idat and idat < round_even(3.3 + (b.d + 1) * 33.37, 0))"), "spec")
def _(spark, d):
    """Sub-integrations of 33.37 samples from 3.3 samples on, each of whole samples."""
    signal = spec(spark, d)
    rows = signal.data.withColumn("subint", fold.snapped_division(F.col("idat"), signal.obs.rate, 0.0, 3_300, 33_370))
    return rounded(rows.groupBy("subint", "ichan").agg(F.count("*").alias("n"), F.sum("v").alias("total")))


@query("subint_parts_of_a_turn", f"with {_SEGMENT_ROWS} select floor((turns - 0.25) * 4)::bigint as part, ichan, count(*) as n, {r('sum(v)')} as total from turned group by all", "sig")
def _(spark, d):
    rows = fold.predicted(sig(spark, d).data, fold.predictor(spark, _SEGMENTS, 5 * DAY, EPOCH), 5 * DAY, EPOCH)
    return rounded(rows.groupBy(fold.phase_division(F.col("turns"), 4, 0.25).alias("part"), "ichan").agg(F.count("*").alias("n"), F.sum("v").alias("total")))


_MITIGATED = f"""with sk as (select idat // {M} as ipart, ichan, ipol, sum(v) as s1, sum(v * v) as s2, case when sum(v) = 0 then 0.0 else {M + 1}.0 / {M - 1}.0 * ({M}.0 * sum(v * v) / (sum(v) * sum(v)) - 1) end as sk from power where idat < (select (max(idat) + 1) // {M} * {M} from power) group by idat // {M}, ichan, ipol),
ft as (select distinct ipart, ichan from sk where sk < 0.8 or sk > 1.3),
p as (select idat, ichan, sum(v) as v from power group by all),
rows as (select idat, p.ichan, case when f.ipart is null then v else 0.0 end as v, f.ipart is not null as zapped, (floor((idat + 0.5) * 1000.0)::bigint % 20000 * 8 // 20000)::int as ibin from p left join ft f on f.ipart = idat // {M} and f.ichan = p.ichan),
f as (select ichan, ibin, sum(v) filter (not zapped) as s, count(*) filter (not zapped) as n from rows group by all), means as (select ichan, avg(s / n) as mean from f where n > 0 group by all)
select {{kind}} 0::bigint as subint, m.ichan, 0::int as ipol, x.ibin::int as ibin, {r('coalesce(s / n, mean)')} as amp, coalesce(n, 0) as hits from means m cross join range(8) as x(ibin) left join f on f.ichan = m.ichan and f.ibin = x.ibin and f.n > 0"""
_PLAIN = _MITIGATED.replace("sk < 0.8 or sk > 1.3", "false")


@query("fold_mitigated_pipeline", _MITIGATED.format(kind=""), "power")
def _(spark, d):
    config = pipelines.FoldConfig(period_us=20_000, nbin=8, epoch_us=0, sk_samples=M, sk_limits=(0.8, 1.3))
    return rounded(pipelines.fold_signal(volt(spark, d), config))


@query("fold_files", _MITIGATED.format(kind="").replace("f.ichan = p.ichan),", f"f.ichan = p.ichan where idat < (select (max(idat) + 1) // {M} * {M} from p)),"), "power")
def _(spark, d):
    """The fold program on files as arrays, mitigation included: one exchange, of bins."""
    files = unload.dump_binary(volt(spark, d), scratch(spark), 120).collect()  # a row a file
    config = pipelines.FoldConfig(period_us=20_000, nbin=8, epoch_us=0, sk_samples=M, sk_limits=(0.8, 1.3))
    return rounded(pipelines.fold_files(spark, [f["url"] for f in files], config))


_ARCHIVE = f"""with pro as (select ichan, ipol, (floor((idat + 0.5) * 1000.0)::bigint % 20000 * 8 // 20000)::int as place, avg(v) as value from power group by all),
p as (select ichan, ipol, k, sum(re * re + im * im) as value from ({{dft}}) group by all),
c as (select ichan, ipol, greatest(0, least(15, floor((re + 0.4) * 16 / 0.8)))::int as place, count(*)::double as value from volt group by all)
select 'profile' as kind, ichan, ipol, place, {r('value')} as value from pro
union all select 'passband', (ichan * 8)::int, ipol, ((k + 4) % 8)::int, {r('value')} from p
union all select 'counts', ichan, ipol, place, value from c"""


@query("profile_archive", _ARCHIVE.format(dft=_dft(8)), "volt", "power")
def _(spark, d):
    """A profile with its passband and its digitizers' counts, written and read back."""
    signal, folder = volt(spark, d), scratch(spark)
    profile = pipelines.fold_signal(signal, pipelines.FoldConfig(period_us=20_000, nbin=8, epoch_us=0, state="PPQQ"))
    counts = stats.histogram(replace(signal, data=signal.data.withColumn("v", F.col("re"))), -0.4, 0.4, 16)
    unload.write_archive(profile, signal.obs, folder, passband=kernels.voltage_bandpass(signal, 8), counts=counts)
    back = unload.read_archive(spark, folder)
    rows = [
        back["profile"].select(F.lit("profile").alias("kind"), "ichan", "ipol", F.col("ibin").alias("place"), F.col("amp").alias("value")),
        back["passband"].select(F.lit("passband"), F.expr("cast(ichan div 8 * 8 as int)"), "ipol", F.expr("cast(ichan % 8 as int)"), "total"),
        back["counts"].select(F.lit("counts"), "ichan", "ipol", "code", F.col("n").cast("double")),
    ]
    return rounded(rows[0].union(rows[1]).union(rows[2]), "value")


@query("pulse_phase_order", f"""with pro as (select ichan, ipol, (floor((idat + 0.5) * 1000.0)::bigint % 20000 * 8 // 20000)::int as ibin, avg(v) as amp from power group by all),
top as (select ichan, ipol, min_by(ibin, (-amp, ibin)) as peak, count(*) as n from pro group by all)
select ichan, ipol, ((ibin - peak + n) % n)::int as ibin, {r('amp')} as amp from pro join top using (ichan, ipol)""", "power")
def _(spark, d):
    """Each profile rotated to begin with its highest bin."""
    profile = pipelines.fold_signal(detect.square_law(volt(spark, d)), pipelines.FoldConfig(period_us=20_000, nbin=8, epoch_us=0))
    return rounded(fold.pulse_phase_order(profile, "ichan", "ipol").select("ichan", "ipol", "ibin", "amp"))


@query("fold_forked", "select * from (" + with_views(_MITIGATED.format(kind="true as mitigated,"), "power") + ") union all select * from (" + with_views(_PLAIN.format(kind="false as mitigated,"), "power") + ")")
def _(spark, d):
    """One pass over the voltages, folded with and without mitigation."""
    config = pipelines.FoldConfig(period_us=20_000, nbin=8, epoch_us=0, sk_samples=M, sk_limits=(0.8, 1.3))
    return rounded(pipelines.fold_forked(volt(spark, d), config))


_EXCISED = f"""with bits as (select idat // 25 as w, ichan, ipol, count(*) * 2 as n, count_if(abs(re) < 0.1) + count_if(abs(im) < 0.1) as nlow from volt group by all),
bad as (select distinct w, ichan from bits where nlow / n not between 0.44 and 0.7),
blocks as (select b from range((select (max(idat) + 1 - 8) // 5 + 1 from volt)) as t(b)),
hit as (select distinct b, ichan from bad, blocks where w * 25 <= b * 5 + 7 and w * 25 + 24 >= b * 5),
z as (select v.idat - 2 as idat, v.ichan, v.ipol, case when x.w is null then re * re + im * im else 0.0 end as v from volt v left join bad x on x.w = v.idat // 25 and x.ichan = v.ichan),
p as (select idat, ichan, sum(v) as v from z where idat >= 0 and idat // 5 in (select b from blocks) group by all),
rows as (select p.ichan, v, (floor((idat + 0.5) * 1000.0)::bigint % 20000 * 8 // 20000)::int as ibin from p left join hit h on h.b = idat // 5 and h.ichan = p.ichan where h.b is null),
f as (select ichan, ibin, sum(v) as s, count(*) as n from rows group by all), means as (select ichan, avg(s / n) as mean from f group by all)
select 0::bigint as subint, m.ichan, 0::int as ipol, x.ibin::int as ibin, {r('coalesce(s / n, mean)')} as amp, coalesce(n, 0) as hits from means m cross join range(8) as x(ibin) left join f on f.ichan = m.ichan and f.ibin = x.ibin"""


@query("excise_convolve_fold", _EXCISED, "volt")
def _(spark, d):
    """Blocks of 25 samples with an odd share of low values don't count, nor does any transform of 8
    samples that takes one of them: what a fold at the end leaves out, and its hits."""
    signal = weights.excised(volt(spark, d), 25, 0.1, 0.44, 0.7, together=False)
    signal = replace(signal, weights=signal.weights.across("ipol"))
    signal = replace(signal, data=weights.zeroed(signal))
    work = kernels.convolve(signal, np.ones(8), (2, 1))
    return rounded(pipelines.fold_signal(replace(work, obs=replace(work.obs, start_us=0, start_fraction=0.0)), pipelines.FoldConfig(period_us=20_000, nbin=8, epoch_us=0)))


_BLOCKS = _EXCISED.replace("(max(idat) + 1 - 8) // 5 + 1 from volt", "((max(idat) + 1) // 25 * 25 - 8) // 5 + 1 from volt")
_GAP = _BLOCKS.replace("not between 0.44 and 0.7)", "not between 0.44 and 0.7 or w between 8 and 11)")


def block_profile(chain) -> DataFrame:
    """Excised by blocks of 25 samples, convolved in transforms of 8, detected and folded."""
    chain = chain.then(blocks.excise, 25, 0.1, 0.44, 0.7, together=False).then(blocks.convolve, np.ones(8), (2, 1)).then(blocks.detect)
    chain = replace(chain, stages=(*chain.stages[:-1], replace(chain.stages[-1], obs=replace(chain.obs, start_us=0, start_fraction=0.0))))
    return rounded(fold.normalise(chain.fold(20_000, 8, 0, size=60), 8, "subint", "ichan", "ipol"))


@query("block_fold", _BLOCKS, "volt")
def _(spark, d):
    """As excise_convolve_fold, on arrays: a table's rows meet in pieces, and bins are all that is
    shuffled after that."""
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("idat"), F.col("embedding").alias("values"))
    return block_profile(blocks.from_rows(rows, volt(spark, d).obs))


@query("block_fold_files", _GAP, "volt")
def _(spark, d):
    """The same of files of 100 samples, one of which is missing: no transform that needs it counts."""
    files = unload.dump_binary(volt(spark, d), scratch(spark), 100).filter("file_no <> 2").collect()  # a row a file
    return block_profile(blocks.from_files(spark, [f["url"] for f in files], force=True))


@query("gapped_files", f"select idat, ichan, ipol, case when idat % 29 = 5 or idat // 64 = 4 then -127.5 else code - 127.5 end as v from ({_digitized(8)}) where idat // 64 <> 2", "spec")
def _(spark, d):
    """Samples and a whole file that have no rows are written as 0; where a file is gone, the others'
    samples keep their numbers."""
    codes = codes_of(spark, d, 8).filter("idat % 29 <> 5 and idat div 64 <> 4")
    files = raw.write_filterbank(codes, replace(spec(spark, d).obs, nbit=8), scratch(spark), 64).filter("file_no <> 2").collect()  # a row a file
    return raw.read_samples(spark, [f["url"] for f in files], force=True, samples=50).data


#: 8-bit codes of the voltages, and which frames of 20 samples of a polarization get lost or are invalid.
_CODE = "greatest(0, least(255, floor({} * 256) + 128))"
_LOST = "(2 * (idat // 20) + ipol) % 7 = 3 or (idat // 20) % 11 = 5"


def write_frames(spark, d, per_file: int = 10) -> list[str]:
    """Files of frames of 20 samples of one polarization, in no order; some aren't written, some are
    marked invalid."""
    size, folder = 32 + 20 * 16 * 2, scratch(spark)
    cells = volt(spark, d).data.withColumns({"k": F.expr("idat div 20"), **{c: F.greatest(F.lit(0), F.least(F.lit(255), F.floor(F.col(c) * 256) + 128)) for c in ("re", "im")}})

    def run(rows: pa.Table) -> pa.Table:
        out = []
        for (k, p), own in rows.to_pandas().groupby(["k", "ipol"], sort=False):
            if (2 * k + p) % 7 != 3 and len(own) == 320:
                own = own.sort_values(["idat", "ichan"])
                head = frames.frame_header(100 + k // 50, k % 50, p, size, k % 11 == 5)
                out.append(head + own[["re", "im"]].to_numpy().astype(np.uint8).tobytes())
        return pa.table({"url": [raw.write_file(f"{folder}/{rows.column('file_no')[0].as_py()}.frames", b"".join(out[::-1]))]})

    return [r["url"] for r in cells.withColumn("file_no", F.expr(f"k div {per_file}")).groupBy("file_no").applyInArrow(run, "url string").collect()]


_FRAMES = f"""select idat, ichan, ipol, {_CODE.format('re')} - 127.5 as re, {_CODE.format('im')} - 127.5 as im from volt where idat < (select (max(idat) + 1) // 20 * 20 from volt) and not ({_LOST})"""


@query("read_frames", _FRAMES, "volt")
def _(spark, d):
    """Voltages in frames, read back by their times; lost and invalid ones have no weight."""
    obs = replace(volt(spark, d).obs, nbit=8)
    return frames.read_frames(spark, write_frames(spark, d), frames.Layout(32 + 640, 50), obs).good()


_PART = f"({_DM / DISPERSION_K!r} * (1.0 / (1382.0 * 1382.0) - 1.0 / ((1569.5 - 25.0 * v.ichan) * (1569.5 - 25.0 * v.ichan))) * 1000.0)"


@query("fractional_delay", f"""with n as (select max(idat) + 1 as n from volt),
o as (select t, t // 4 * 4 as first, t % 4 + 2 as p from n, range((n - 8) // 4 * 4 + 4) as x(t)),
g as (select t, v.ichan, v.ipol, re, im, p - (v.idat - first) - ({_PART} - floor({_PART} + 0.5)) as g from o join volt v on v.idat >= first and v.idat < first + 8),
k as (select *, list_sum(list_transform(range(-4, 4), lambda f: cos(2 * pi() * f * g / 8))) / 8 as kr, list_sum(list_transform(range(-4, 4), lambda f: sin(2 * pi() * f * g / 8))) / 8 as ki from g)
select t as idat, ichan, ipol, {r('sum(re * kr - im * ki)')} as re, {r('sum(re * ki + im * kr)')} as im from k group by all""", "volt")
def _(spark, d):
    """Each channel moved by the part of a sample that whole delays leave."""
    return rounded(kernels.fractional_delay(volt(spark, d), 8, (2, 2)).data)


_FOLD_EXCISED = f"""with bits as (select idat // 25 as w, ichan, ipol, count(*) * 2 as n, count_if(abs(re) < 0.1) + count_if(abs(im) < 0.1) as nlow from volt group by all),
bad as (select distinct w from bits where nlow / n not between 0.36 and 0.78),
p as (select idat // 2 as idat, ichan // 4 as ichan, sum(v) as v, max(idat) as last, min(idat) as first from power group by idat // 2, ichan // 4),
rows as (select ichan, v, (floor((idat + 0.5) * 2000.0)::bigint % 20000 * 8 // 20000)::int as ibin from p where first // 25 not in (select w from bad) and last // 25 not in (select w from bad) and last % 2 = 1),
f as (select ichan, ibin, sum(v) as s, count(*) as n from rows group by all), means as (select ichan, avg(s / n) as mean from f group by all)
select 0::bigint as subint, m.ichan::int as ichan, 0::int as ipol, x.ibin::int as ibin, {r('coalesce(s / n / 8.0, mean / 8.0)')} as amp, coalesce(n, 0) as hits from means m cross join range(8) as x(ibin) left join f on f.ichan = m.ichan and f.ibin = x.ibin"""


@query("excise_scrunch_fold", _FOLD_EXCISED, "power")
def _(spark, d):
    """Excision, detection, sums of 2 samples and 4 channels, fold: a sum with a bad sample is bad."""
    signal = weights.excised(volt(spark, d), 25, 0.1, 0.36, 0.78)
    work = scrunch.scrunch(detect.intensity(signal), 2, 4)
    return rounded(pipelines.fold_signal(work, pipelines.FoldConfig(period_us=20_000, nbin=8, epoch_us=0)))


# Streams --------------------------------------------------------------------------------------


def event_stream(spark, d) -> DataFrame:
    rows = folding.read_stream(spark, f"{d}/events.parquet")
    ichan = (F.array_position(F.array(*[F.lit(t) for t in ("click", "error", "purchase", "signup", "view")]), F.col("event_type")) - 1).cast("int")
    return rows.select("ts", ichan.alias("ichan"), F.col("event_id").alias("idat"), F.col("value").alias("v"))


_CLOSED = f"(select max(us) - 3600000000 from sig)"


@query("stream_fold", f"select us // {DAY} * {DAY} as start_us, ichan, (us % {PERIOD} * {NBIN} // {PERIOD})::int as ibin, {r('sum(v)')} as sum, count(*) as hits from sig where us // {DAY} * {DAY} + {DAY} <= {_CLOSED} group by all", "sig")
def _(spark, d):
    return rounded(folding.run_available(folding.fold_stream(event_stream(spark, d), PERIOD, NBIN), scratch(spark)))


_TURNS = PERIOD * 2000


@query("stream_fold_turns", f"select us // {_TURNS} * {_TURNS} as start_us, ichan, (us % {PERIOD} * {NBIN} // {PERIOD})::int as ibin, {r('sum(v)')} as sum, count(*) as hits from sig where us // {_TURNS} * {_TURNS} + {_TURNS} <= {_CLOSED} group by all", "sig")
def _(spark, d):
    return rounded(folding.run_available(folding.fold_stream_turns(event_stream(spark, d), PERIOD, 2000, NBIN), scratch(spark)))


@query("stream_sliding", f"select s * {DAY // 2} as start_us, ichan, {r('avg(v)')} as mean, {r('stddev_pop(v)')} as sigma, count(*) as n from (select unnest([us // {DAY // 2}, us // {DAY // 2} - 1]) as s, ichan, v from sig) where s * {DAY // 2} + {DAY} <= {_CLOSED} group by all", "sig")
def _(spark, d):
    return rounded(folding.run_available(folding.sliding_moments(event_stream(spark, d), "1 day", "12 hours"), scratch(spark)))


@query("stream_runs", f"""with m as (select ichan, us, case when us - lag(us) over (partition by ichan order by us) < 3600000000 then 0 else 1 end as new from sig),
g as (select ichan, us, sum(new) over (partition by ichan order by us rows unbounded preceding) as g from m)
select min(us) as start_us, max(us) + 3600000000 as end_us, ichan, count(*) as n from g group by ichan, g having max(us) + 3600000000 <= {_CLOSED}""", "sig")
def _(spark, d):
    return folding.run_available(folding.runs(event_stream(spark, d), "1 hour"), scratch(spark))


@query("stream_baseline", recursive(f"""with n as (select ichan, idat, v, row_number() over (partition by ichan order by idat) as k from sig),
f(ichan, idat, k, v, b) as (select ichan, idat, k, v, v from n where k = 1
  union all select n.ichan, n.idat, n.k, n.v, f.b + (n.v - f.b) / 32.0 from f join n on n.ichan = f.ichan and n.k = f.k + 1)
select ichan, idat, {r('v - b')} as v from f""", "sig"))
def _(spark, d):
    return rounded(folding.run_available(folding.follow_baseline(event_stream(spark, d), 32.0), scratch(spark)))


_DIVIDED = f"""with {_SEGMENT_ROWS}, shifted as (select *, floor((floor(turns) - 3) / 24)::bigint as subint, least(floor((turns - floor(turns)) * {NBIN}), {NBIN - 1})::int as ibin from turned where turns >= 3),
w as (select max(us) - 3600000000 as us from sig), reached as (select rphase + 60.0 * ((us - tmid) / 60e6) * f0 + c2 * pow((us - tmid) / 60e6, 2) as turns from w join seg on segment = (us - {EPOCH}) // {5 * DAY})
select subint, ichan, ibin, {r('sum(v)')} as sum, count(*) as hits from shifted, reached where (subint + 1) * 24 + 3 <= reached.turns group by all"""


@query("stream_turns_predictor", _DIVIDED, "sig")
def _(spark, d):
    """Sub-integrations of 24 turns by a predictor, from turn 3 on, each given once the watermark has
    passed its last turn."""
    turns = live.Turns(segments=_SEGMENTS, span_us=5 * DAY, first_us=EPOCH)
    found = folding.run_available(live.fold_divisions(event_stream(spark, d), turns, 24, NBIN, 3), scratch(spark))
    return rounded(found.select("subint", "ichan", "ibin", "sum", "hits"), "sum")


def volt_stream(spark, d):
    """The voltages as a stream of three triggers, cut where no transform ends."""
    folder, signal = scratch(spark), volt(spark, d)
    for k in range(3):
        part = F.col("idat").between(k * signal.obs.ndat // 3 + 1 - (k == 0), (k + 1) * signal.obs.ndat // 3)
        signal.data.filter(part).coalesce(1).write.mode("append").parquet(folder)
    return folding.read_stream(spark, folder, 1), signal.obs


_DFT4 = f"""with x as (select idat // 4 as t, ichan, ipol, idat % 4 as j, re, im from volt where idat < (select (max(idat) + 1) // 4 * 4 from volt))
select t as idat, (ichan * 4 + k)::int as ichan, ipol, {r('sum(re * cos(pi() / 2 * j * (k - 2)) + im * sin(pi() / 2 * j * (k - 2)))')} as re, {r('sum(im * cos(pi() / 2 * j * (k - 2)) - re * sin(pi() / 2 * j * (k - 2)))')} as im
from x, range(4) as b(k) group by t, ichan, ipol, k"""


@query("stream_filterbank", _DFT4, "volt")
def _(spark, d):
    """Four channels from each, on a stream that keeps what the next transform needs as state."""
    stream, obs = volt_stream(spark, d)
    out, _ = live.filterbank_stream(stream, obs, 4)
    return rounded(folding.run_available(out, scratch(spark)))


@query("stream_convolve", f"""with n as (select max(idat) + 1 as n from volt)
select v.idat - 2 as idat, v.ichan, v.ipol, {r('v.re + 0.5 * coalesce(p.re, 0)')} as re, {r('v.im + 0.5 * coalesce(p.im, 0)')} as im
from volt v join volt p on p.idat = v.idat - 1 and p.ichan = v.ichan and p.ipol = v.ipol, n where v.idat >= 2 and v.idat - 2 < ((n - 16) // 13 + 1) * 13""", "volt")
def _(spark, d):
    """Each sample and half the one before, by overlap-save on a stream."""
    stream, obs = volt_stream(spark, d)
    taps = np.zeros(16)
    taps[:2] = 1, 0.5
    out, _ = live.convolve_stream(stream, obs, np.fft.fft(taps), (2, 1))
    return rounded(folding.run_available(out, scratch(spark)))
