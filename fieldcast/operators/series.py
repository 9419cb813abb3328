"""Operators along time: running sums, SPI, lags, windows, interpolation, gap filling, checks.

Every function takes key columns; all keys run in one job, parted by key. Keys of more than ``hot_rows`` rows are cut into
ranges (``ranges.by_parts``), with the same results.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from ..functions import laws
from ..sources.io import scratch
from .ranges import HOT_ROWS, by_parts, expected_few


def _order(key: list[str], time: list[str] | str) -> WindowSpec:
    return Window.partitionBy(*key).orderBy(*([time] if isinstance(time, str) else time))


def _past(key: list[str], first: int = Window.unboundedPreceding, last: int = 0) -> WindowSpec:
    return Window.partitionBy(*key).orderBy("_i").rowsBetween(first, last)


def _future(key: list[str], last: int = 0) -> WindowSpec:
    """From the end backwards: frames that end with the series are quadratic in Spark, frames that begin with it aren't."""
    return Window.partitionBy(*key).orderBy(F.desc("_i")).rowsBetween(Window.unboundedPreceding, last)


def running_total(df: DataFrame, key: list[str], time, columns: dict[str, str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """{new: source}: cumulative sums; a NULL row stays NULL and the sum goes on."""

    def run(d: DataFrame, by: list[str]) -> DataFrame:
        return d.withColumns({n: F.when(F.col(c).isNotNull(), F.sum(c).over(_past(by))) for n, c in columns.items()})

    return by_parts(df, key, time, run, sums=sorted(set(columns.values())), hot_rows=hot_rows)


def rolling_sum(df: DataFrame, key: list[str], time, column: str, scale: int, name: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Over full windows only; NULL if any value inside is."""

    def run(d: DataFrame, by: list[str]) -> DataFrame:
        w = _past(by, -(scale - 1))
        return d.withColumn(name, F.when(F.count(column).over(w) == scale, F.sum(column).over(w)))

    return by_parts(df, key, time, run, before=scale - 1, hot_rows=hot_rows)


def with_key_stats(df: DataFrame, key: list[str], stats: dict[str, Column], derived: dict[str, Column] = {}) -> DataFrame:  # noqa: B006
    """Aggregates of each key, and what derives from them, beside its rows: by a join, so no key is one task."""
    own = df.groupBy(*key).agg(*(v.alias(n) for n, v in stats.items())).withColumns(derived).withColumnsRenamed({k: f"_of_{k}" for k in key})
    same = reduce(Column.__and__, (F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in key)) if key else F.lit(True)
    return df.join(own, same).drop(*(f"_of_{k}" for k in key))


def spi(df: DataFrame, key: list[str], time, column: str, scale: int = 3, name: str = "spi", least: int = 10, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Standardized precipitation index: gamma fit to the rolling sums, or z-scores of the raw values below ``least`` sums.

    ``{name}_status``: gamma, zscore, or nonpositive (a sum of 0 or less is outside the fit; the series is NULL).
    """
    c, s = F.col(column), F.col("_sum")
    d = rolling_sum(df, key, time, column, scale, "_sum", hot_rows)
    stats = {"_n": F.count("_sum"), "_bad": F.max((s <= 0).cast("int")), "_m": F.avg("_sum"), "_g": F.avg(F.when(s > 0, F.ln(s))), "_avg": F.avg(column), "_std": F.stddev_samp(column)}
    d = with_key_stats(d, key, stats, {"_a": F.when(F.col("_m") > 0, laws.gamma_shape(F.col("_m"), F.col("_g")))})
    z = F.try_divide(c - F.col("_avg"), F.col("_std") + 1e-10)
    d = d.withColumn("_q", F.when((s > 0) & F.col("_a").isNotNull(), laws.normal_quantile(laws.gamma_cdf(s * F.col("_a") / F.col("_m"), F.col("_a")))))
    d = d.withColumn("_r", F.when(F.col("_n") < least, z).when(F.coalesce("_bad", F.lit(0)) == 0, F.col("_q")))

    def run(x: DataFrame, by: list[str]) -> DataFrame:
        return x.withColumn(name, F.coalesce(F.last("_r", ignorenulls=True).over(_past(by)), F.last("_r", ignorenulls=True).over(_future(by))))

    d = by_parts(d, key, time, run, ends=["_r"], hot_rows=hot_rows)
    status = F.when(F.col("_n") < least, "zscore").when(F.coalesce("_bad", F.lit(0)) == 1, "nonpositive").otherwise("gamma")
    return d.withColumn(f"{name}_status", status).drop("_sum", "_n", "_bad", "_m", "_g", "_a", "_avg", "_std", "_q", "_r")


def lags(df: DataFrame, key: list[str], time, column: str, steps: list[int], hot_rows: int = HOT_ROWS) -> DataFrame:
    """{column}_lag_{k}: the value k rows before (of a negative k: after)."""

    def run(d: DataFrame, by: list[str]) -> DataFrame:
        o = Window.partitionBy(*by).orderBy("_i")
        return d.withColumns({f"{column}_lag_{k}": F.lag(column, k).over(o) for k in steps})

    return by_parts(df, key, time, run, before=max([0, *steps]), after=max([0, *(-k for k in steps)]), hot_rows=hot_rows)


def sequences(df: DataFrame, key: list[str], time, features: list[str], target: str, window: int, step: int = 1, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Windows of ``window`` rows and the target of the next row: key, start, features (matrix), label.

    Starts are 0, step, 2 * step ...; a window without a next row or with a NULL label is left out; NULL features stay.
    """
    order = [time] if isinstance(time, str) else list(time)

    def run(d: DataFrame, by: list[str]) -> DataFrame:
        o = Window.partitionBy(*by).orderBy("_i")
        row = F.array(*(F.col(c).cast("double") for c in features))
        return d.withColumns({"_start": F.col("_i") - 1, "_rows": F.collect_list(row).over(o.rowsBetween(0, window - 1)), "_label": F.lead(target, window).over(o).cast("double")})

    d = df.select(*dict.fromkeys([*key, *order, *features, target]))
    d = by_parts(d, key, order, run, after=window, hot_rows=hot_rows)
    d = d.filter((F.col("_start") % step == 0) & F.col("_label").isNotNull() & (F.size("_rows") == window))
    return d.select(*key, F.col("_start").alias("start"), F.col("_rows").alias("features"), F.col("_label").alias("label"))


def last_of_year(df: DataFrame, key: list[str], time: str, values: list[str], year: Column | str, window: int) -> DataFrame:
    """Per key and year the last ``window`` rows as a matrix, or a status: ok, or how many rows are needed."""
    year = F.year(F.col(time)) if isinstance(year, str) and year == time else F.col(year) if isinstance(year, str) else year
    d = df.withColumn("year", year)
    w = Window.partitionBy(*key, "year")
    d = d.withColumns({"_r": F.row_number().over(w.orderBy(F.desc(time), *(F.desc(v) for v in values))), "_n": F.count(F.lit(1)).over(w)}).filter(F.col("_r") <= window)
    packed = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("_r")).alias("_o"), F.array(*(F.col(v).cast("double") for v in values)).alias("v")))), lambda x: x["v"])
    out = d.groupBy(*key, "year").agg(packed.alias("matrix"), F.max("_n").alias("n_rows"))
    enough = F.col("n_rows") >= window
    status = F.when(enough, "ok").otherwise(F.format_string("%d rows, need at least %d", F.col("n_rows"), F.lit(window)))
    return out.withColumns({"status": status, "matrix": F.when(enough, F.col("matrix"))})


def first_per_day(df: DataFrame, key: list[str], time: str, ties: list[str], day: str = "day") -> DataFrame:
    d = df.withColumn(day, F.date_trunc("day", F.col(time)))
    w = Window.partitionBy(*key, day).orderBy(time, *ties)
    return d.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def daily_mean(df: DataFrame, key: list[str], time: str, values: list[str], spine: bool = False) -> DataFrame:
    """Per key and day, NULLs skipped; with ``spine`` also the days without rows, as NULL."""
    out = df.groupBy(*key, F.date_trunc("day", F.col(time)).alias("day")).agg(*(F.avg(v).alias(v) for v in values))
    if not spine:
        return out
    ends = out.groupBy(*key).agg(F.min("day").alias("_a"), F.max("day").alias("_b"))
    days = ends.select(*key, F.explode(F.sequence("_a", "_b", F.expr("interval 1 day"))).alias("day"))
    return days.join(out, [*key, "day"], "left")


def interpolate(df: DataFrame, key: list[str], time, columns: list[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Linear by row position; gaps at the ends take the nearest value; all NULL stays."""

    def run(d: DataFrame, by: list[str]) -> DataFrame:
        near = {c: F.when(F.col(c).isNotNull(), F.struct(F.col("_i").alias("i"), F.col(c).cast("double").alias("v"))) for c in columns}
        d = d.withColumns({f"_a_{c}": F.last(x, True).over(_past(by)) for c, x in near.items()})
        d = d.withColumns({f"_b_{c}": F.last(x, True).over(_future(by)) for c, x in near.items()})
        for c in columns:
            a, b = F.col(f"_a_{c}"), F.col(f"_b_{c}")
            between = a["v"] + (b["v"] - a["v"]) * F.try_divide(F.col("_i") - a["i"], (b["i"] - a["i"]).cast("double"))
            d = d.withColumn(f"_v_{c}", F.when(F.col(c).isNotNull(), F.col(c).cast("double")).when(a.isNull(), b["v"]).when(b.isNull(), a["v"]).otherwise(between))
        return d.drop(*(f"_{s}_{c}" for c in columns for s in "ab"))

    d = by_parts(df, key, time, run, ends=columns, hot_rows=hot_rows)
    return d.withColumns({c: F.col(f"_v_{c}") for c in columns}).drop(*(f"_v_{c}" for c in columns))


def _seconds(df: DataFrame, time: str) -> Column:
    """Time as a number whose differences are exact."""
    kind = dict(df.dtypes)[time]
    if kind.startswith("timestamp") or kind == "date":
        return F.unix_micros(F.col(time).cast("timestamp"))
    return F.col(time).cast("double")


def _end_slope(h0: Column, h1: Column, s0: Column, s1: Column) -> Column:
    """Slope at an end from two steps: three-point, not against the first step, and at most three times it where they differ in sign."""
    e = F.try_divide((2 * h0 + h1) * s0 - h0 * s1, h0 + h1)
    return F.when(e * s0 <= 0, 0.0).when((s0 * s1 <= 0) & (F.abs(e) > 3 * F.abs(s0)), 3 * s0).otherwise(e)


def _inner_slope(h0: Column, s0: Column, h1: Column, s1: Column) -> Column:
    """Weighted harmonic mean of the steps at a point, 0 where they differ in sign."""
    w0, w1 = 2 * h1 + h0, h1 + 2 * h0
    return F.when(s0 * s1 > 0, F.try_divide(w0 + w1, F.try_divide(w0, s0) + F.try_divide(w1, s1))).otherwise(0.0)


def fill_gaps(df: DataFrame, key: list[str], time: str, columns: list[str], limit: int = 5, hot_rows: int = HOT_ROWS, ties: list[str] = []) -> DataFrame:  # noqa: B006
    """Monotone cubic (PCHIP) over real time, at most ``limit`` rows into each inner gap; what is left becomes 0.

    All by window expressions: a time sees the two valid values on each side, which fix the cubic between the inner two. Of
    rows with equal times, ordered by ``ties``, the first valid value counts. Windows along a key read one row for each of its
    times, so repeated times make no task larger; rows take their time's value, and the last position that it may fill.
    """

    def run(d: DataFrame, by: list[str]) -> DataFrame:
        x = _seconds(d, time)
        point = {c: F.when(F.col(f"_k_{c}").isNotNull(), F.struct("_pos", x.alias("x"), F.col(f"_k_{c}").alias("y"))) for c in columns}
        for side, w in (("p", _past), ("n", _future)):
            beyond = w(by, last=-1)
            d = d.withColumns({f"_{side}q_{c}": F.when(v.isNotNull(), F.struct(F.last(v, True).over(beyond).alias("q"))) for c, v in point.items()})
            d = d.withColumns({f"_{side}_{c}": F.last(v, True).over(w(by)) for c, v in point.items()} | {f"_{side}r_{c}": F.last(f"_{side}q_{c}", True).over(w(by)) for c in columns})
        scale = 1e6 if dict(d.dtypes)[time] in ("timestamp", "timestamp_ntz", "date") else 1.0
        col = lambda name, c: F.col(f"_{name}_{c}")
        steps: dict[str, Column] = {}
        for c in columns:  # in stages, so that nothing is worked out twice
            p, n, pp, nn = col("p", c), col("n", c), col("pr", c)["q"], col("nr", c)["q"]
            for name, u, v in (("", p, n), ("l", pp, p), ("r", n, nn)):
                steps[f"_h{name}_{c}"] = (v["x"] - u["x"]).cast("double") / scale
                steps[f"_s{name}_{c}"] = F.try_divide((v["y"] - u["y"]) * scale, (v["x"] - u["x"]).cast("double"))
            steps[f"_u_{c}"] = F.try_divide((x - p["x"]).cast("double"), (n["x"] - p["x"]).cast("double"))
        d = d.withColumns(steps)
        slopes: dict[str, Column] = {}
        for c in columns:
            h, s, hl, sl, hr, sr = (col(k, c) for k in ("h", "s", "hl", "sl", "hr", "sr"))
            alone = hl.isNull() & hr.isNull()
            slopes[f"_a_{c}"] = F.when(alone, s).when(hl.isNull(), _end_slope(h, hr, s, sr)).otherwise(_inner_slope(hl, sl, h, s))
            slopes[f"_b_{c}"] = F.when(alone, s).when(hr.isNull(), _end_slope(h, hl, s, sl)).otherwise(_inner_slope(h, s, hr, sr))
        d = d.withColumns(slopes)
        for c in columns:
            p, n, u, h = col("p", c), col("n", c), col("u", c), col("h", c)
            cubic = (1 + 2 * u) * (1 - u) * (1 - u) * p["y"] + u * (1 - u) * (1 - u) * h * col("a", c) + u * u * (3 - 2 * u) * n["y"] + u * u * (u - 1) * h * col("b", c)
            same = p["x"] == x  # this time has a value, for its later rows too
            value = F.when(same, p["y"]).when(p.isNotNull() & n.isNotNull(), cubic)
            upto = F.when(same, F.lit((1 << 63) - 1)).otherwise(p["_pos"] + limit)
            d = d.withColumn(f"_v_{c}", F.struct(value.alias("v"), upto.alias("upto")))
        return d.drop(*(f"_{s}_{c}" for c in columns for s in ("p", "n", "pq", "nq", "pr", "nr", "h", "hl", "hr", "s", "sl", "sr", "u", "a", "b")))

    d = df.withColumns({c: nan_to_null_column(c) for c in columns})
    at, order = Window.partitionBy(*key, time), ties or [time]
    every = at.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    times = d.withColumns({"_n": F.count(F.lit(1)).over(every), **{f"_k_{c}": F.first(c, ignorenulls=True).over(every) for c in columns}})
    times = times.withColumn("_r", F.row_number().over(at.orderBy(*order))).filter("_r = 1").select(*key, time, "_n", *(f"_k_{c}" for c in columns))
    if not expected_few(df, hot_rows):  # several passes read the times
        path = scratch(df.sparkSession, "times")
        times.write.parquet(path)
        times = df.sparkSession.read.parquet(path)
    times = running_total(times, key, time, {"_pos": "_n"}, hot_rows).withColumn("_pos", F.col("_pos") - F.col("_n") + 1)
    times = by_parts(times, key, [time, "_pos"], run, ends=[f"_k_{c}" for c in columns], valid=2, hot_rows=hot_rows)
    times = times.select(*key, time, F.struct("_pos", *(f"_v_{c}" for c in columns)).alias("_time"))
    # each time's row comes before the rows of its time and is handed down to them
    both = d.withColumn("_own", F.lit(True)).unionByName(times.withColumn("_own", F.lit(False)), allowMissingColumns=True)
    down = at.orderBy("_own", *order)
    both = both.withColumns({"_time": F.first("_time").over(down.rowsBetween(Window.unboundedPreceding, 0)), "_r": F.row_number().over(down)}).filter("_own")
    i = F.col("_time._pos") + F.col("_r") - 2
    fill = {c: F.coalesce(c, F.when(i <= F.col(f"_time._v_{c}.upto"), F.col(f"_time._v_{c}.v")), F.lit(0.0)) for c in columns}
    return both.withColumns(fill).drop("_own", "_time", "_r")


def nan_to_null_column(name: str) -> Column:
    v = F.col(name).cast("double")
    return F.when(~F.isnan(v), v)


def integrity(df: DataFrame, key: list[str], order: str, time: str) -> DataFrame:
    """Per key: rows whose time is before the one before them in the given order, and surplus rows of equal times."""
    d = df.withColumn("_back", (F.lag(time).over(_order(key, order)) > F.col(time)).cast("int"))
    per = d.groupBy(*key, time).agg(F.sum(F.coalesce("_back", F.lit(0))).alias("_b"), F.count(F.lit(1)).alias("_n"))
    out = per.groupBy(*key).agg(F.sum("_b").cast("long").alias("order_violations"), F.sum(F.col("_n") - 1).cast("long").alias("duplicates"))
    return out.withColumn("status", F.when(F.col("order_violations") > 0, "error").when(F.col("duplicates") > 0, "warning").otherwise("ok"))
