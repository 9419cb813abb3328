"""All registered queries of the main library and their SQL. Each runs over the whole of its tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import mixture, risk, scalars
from ..operators import align, bias, drift, impute, metrics, score, series, tables
from ..schema import numeric_columns
from ..sources import io, synth
from . import jobs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
c, lit = F.col, F.lit


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


LINE = ["l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_shipdate"]
LINE_SQL = ", ".join(LINE)
GAPPY = "CASE WHEN event_id % 7 <> 0 THEN value END"


def gappy(spark, d):
    return t(spark, d, "events").withColumn("v", F.when(c("event_id") % 7 != 0, c("value")))


def r6(x, name):
    return F.round(x, 6).alias(name)


# ---- scalars


@query(f"""SELECT {LINE_SQL}, round((nir - red) / (nir + red + 1e-10), 6) AS ndvi,
round(2.5 * (nir - red) / (nir + 6 * red - 7.5 * blue + 1 + 1e-10), 6) AS evi, round((nir - swir) / (nir + swir + 1e-10), 6) AS lswi,
round((nir - red) / CASE WHEN nir + red = 0 THEN 1e-6 ELSE nir + red END, 6) AS ndvi_safe, round(red / 10000, 9) AS red_scaled
FROM (SELECT *, l_discount AS red, l_tax + 0.2 AS nir, l_discount / 2 AS blue, l_quantity / 100 AS swir FROM lineitem)""")
def scalar_indices(spark, d):
    x = t(spark, d, "lineitem").select(*LINE, c("l_discount").alias("B04"), (c("l_tax") + 0.2).alias("B08"), (c("l_discount") / 2).alias("B02"), (c("l_quantity") / 100).alias("B11"))
    x = scalars.all_indices(x).withColumn("ndvi_safe", scalars.ndvi_zero_safe(c("B04"), c("B08")))
    x = scalars.rescale(x.withColumn("red_scaled", c("B04")), ["red_scaled"])
    return x.select(*LINE, r6(c("ndvi"), "ndvi"), r6(c("evi"), "evi"), r6(c("lswi"), "lswi"), r6(c("ndvi_safe"), "ndvi_safe"), F.round("red_scaled", 9).alias("red_scaled"))


@query(f"""SELECT {LINE_SQL}, CASE WHEN l_linenumber IN (4, 5, 6) THEN l_quantity END AS l_quantity, CASE WHEN l_linenumber IN (4, 5, 6) THEN l_linenumber END AS scene FROM lineitem""")
def cloud_mask(spark, d):
    x = t(spark, d, "lineitem").select(*LINE, "l_quantity", c("l_linenumber").alias("scene"))
    return scalars.cloud_mask(x, ["l_quantity"], "scene")


@query(f"""SELECT {LINE_SQL}, greatest((least(greatest(l_quantity, 10), 35) + least(greatest(l_quantity - 8, 10), 35)) / 2 - 10, 0) AS gdd,
round(sin(2 * pi() * month(l_shipdate) / 12), 6) + 0.0 AS month_sin, round(cos(2 * pi() * month(l_shipdate) / 12), 6) + 0.0 AS month_cos,
CASE WHEN l_quantity > 40 THEN 'Clay' WHEN l_tax * 1000 + 10 > 85 THEN 'Sand' ELSE 'Loam' END AS texture,
round((l_quantity - 25) / (25 + 1e-10), 6) AS anomaly, least(greatest(l_quantity, 5), 45) AS clipped, l_discount * 10 < 0.3 AS stressed, l_discount * 10 >= 0.5 AS healthy, l_tax * 100 - 5 < -1 AS drought FROM lineitem""")
def scalar_weather_soil(spark, d):
    x = t(spark, d, "lineitem")
    s, k = scalars.cyclical_month(c("l_shipdate"))
    return x.select(
        *LINE,
        scalars.growing_degree_days(c("l_quantity"), c("l_quantity") - 8).alias("gdd"),
        (F.round(s, 6) + 0.0).alias("month_sin"),
        (F.round(k, 6) + 0.0).alias("month_cos"),
        scalars.soil_texture(c("l_quantity"), c("l_tax") * 1000 + 10).alias("texture"),
        r6(scalars.anomaly(c("l_quantity"), lit(25.0)), "anomaly"),
        scalars.clip(c("l_quantity"), lit(5.0), lit(45.0)).alias("clipped"),
        *(scalars.stress_flags(c("l_discount") * 10, c("l_tax") * 100 - 5)[k].alias(n) for k, n in (("ndvi_stress", "stressed"), ("ndvi_healthy", "healthy"), ("drought", "drought"))),
    )


@query("""SELECT s.s_suppkey, count(*) AS customers FROM supplier s JOIN customer k
ON k.c_acctbal / 20 BETWEEN s.s_acctbal / 20 - 100 AND s.s_acctbal / 20 + 100 AND k.c_nationkey = s.s_nationkey AND k.c_custkey BETWEEN s.s_suppkey - 500 AND s.s_suppkey + 500 GROUP BY 1""")
def bbox_filter(spark, d):
    s = t(spark, d, "supplier").select("s_suppkey", c("s_nationkey").alias("n"), scalars.bbox_of_point(c("s_acctbal") / 20, c("s_suppkey").cast("double"), 100.0).alias("b"))
    s = s.select("s_suppkey", "n", F.array(c("b")[0] - 400, c("b")[1], c("b")[2] + 400, c("b")[3]).alias("box"))
    k = t(spark, d, "customer").select(c("c_nationkey").alias("n"), (c("c_acctbal") / 20).alias("lat"), c("c_custkey").cast("double").alias("lon"))
    return align.in_boxes(k, s, ["n"], "lat", "lon", "box").groupBy("s_suppkey").agg(F.count(lit(1)).alias("customers"))


@query("""SELECT c_custkey, p.lat, p.lon FROM customer LEFT JOIN (SELECT 'BUILD' AS place, 23.2324 AS lat, 87.8615 AS lon UNION ALL SELECT 'AUTO', 10.5, 20.25) p ON contains(c_mktsegment, p.place)""")
def district_lookup(spark, d):
    places = spark.createDataFrame([("BUILD", 23.2324, 87.8615), ("AUTO", 10.5, 20.25)], "place string, lat double, lon double")
    return tables.districts(t(spark, d, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", places).select("c_custkey", "lat", "lon")


TIER_SQL = "CASE WHEN (a - p) / a > 0.5 THEN 'High Risk' WHEN (a - p) / a > 0.2 THEN 'Medium Risk' ELSE 'Low Risk' END"
UP_SQL = """CASE WHEN s / (p + 1e-10) > 0.15 AND tier = 'Low Risk' THEN 'Medium Risk (Elevated due to uncertainty)'
WHEN s / (p + 1e-10) > 0.15 AND tier = 'Medium Risk' THEN 'High Risk (Elevated due to uncertainty)' ELSE tier END"""


@query(f"""WITH h AS (SELECT o_custkey, avg(o_totalprice) AS a, coalesce(stddev_samp(o_totalprice), 0) / 10 AS s FROM orders GROUP BY 1),
r AS (SELECT o.o_orderkey, o_totalprice AS p, a, s FROM orders o JOIN h USING (o_custkey)), x AS (SELECT *, {TIER_SQL} AS tier FROM r)
SELECT {UP_SQL} AS calibrated_risk, count(*) AS orders, round(avg(p), 4) AS mean_price FROM x GROUP BY 1""")
def slice_risk_tiers(spark, d):
    o = t(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    h = o.groupBy("o_custkey").agg(F.avg("o_totalprice").alias("a"), (F.coalesce(F.stddev_samp("o_totalprice"), lit(0.0)) / 10).alias("s"))
    tier = risk.calibrated_risk(risk.risk_tier(c("o_totalprice"), c("a")), c("o_totalprice"), c("s"))
    return align.attach(o, h, ["o_custkey"]).groupBy(tier.alias("calibrated_risk")).agg(F.count(lit(1)).alias("orders"), F.round(F.avg("o_totalprice"), 4).alias("mean_price"))


@query(f"""WITH x AS (SELECT o_orderkey, o_totalprice / 20000 AS p, 8.0 AS a, o_totalprice / 400000 + 0.3 AS s FROM orders), y AS (SELECT *, {TIER_SQL} AS tier FROM x)
SELECT o_orderkey, {UP_SQL} AS calibrated_risk, round(greatest(0, p - 1.96 * s), 6) AS lower_bound, round(p + 1.96 * s, 6) AS upper_bound,
CASE WHEN p > 0 AND p < 15 THEN 'ok' ELSE 'implausible' END AS status FROM y""")
def risk_report(spark, d):
    x = t(spark, d, "orders").select("o_orderkey", (c("o_totalprice") / 20000).alias("p"), (c("o_totalprice") / 400000 + 0.3).alias("s"))
    low, high = risk.bounds_95(c("p"), c("s"))
    return x.select("o_orderkey", risk.calibrated_risk(risk.risk_tier(c("p"), lit(8.0)), c("p"), c("s")).alias("calibrated_risk"), r6(low, "lower_bound"), r6(high, "upper_bound"), F.when(risk.plausible(c("p")), "ok").otherwise("implausible").alias("status"))


_SAID = {"Satellite": risk.SATELLITE_ADVICE, "Weather": risk.WEATHER_ADVICE, "Soil": risk.SOIL_ADVICE}
_QUOTED = {k: v.replace("%s%%", "{}%").replace("'", "''") for k, v in _SAID.items()}


@query(f"""WITH x AS (SELECT {LINE_SQL}, l_discount * 4 AS a, l_tax * 6 AS w, 0.25 AS s, CASE l_linenumber WHEN 1 THEN 'HIGH' WHEN 2 THEN 'LOW' ELSE 'High Risk' END AS r, l_quantity AS p FROM lineitem)
SELECT {LINE_SQL}, array_to_string(list_filter([
CASE WHEN a >= w AND a >= s THEN format('{_QUOTED["Satellite"]}', CAST(round_even(a * 100, 0) AS INT)) WHEN w >= s THEN format('{_QUOTED["Weather"]}', CAST(round_even(w * 100, 0) AS INT)) ELSE format('{_QUOTED["Soil"]}', CAST(round_even(s * 100, 0) AS INT)) END,
CASE r WHEN 'HIGH' THEN '{risk.HIGH_ADVICE}' WHEN 'LOW' THEN '{risk.LOW_ADVICE}' END, CASE WHEN 4 / p > 0.4 THEN '{risk.VOLATILE_ADVICE}' END], lambda y: y IS NOT NULL), '|') AS advice FROM x""")
def forecast_advice(spark, d):
    x = t(spark, d, "lineitem").select(*LINE, (c("l_discount") * 4).alias("a"), (c("l_tax") * 6).alias("w"), lit(0.25).alias("s"), F.when(c("l_linenumber") == 1, "HIGH").when(c("l_linenumber") == 2, "LOW").otherwise("High Risk").alias("r"), c("l_quantity").alias("p"))
    return x.select(*LINE, F.array_join(risk.forecast_advice(c("a"), c("w"), c("s"), c("r"), c("p") - 2, c("p") + 2, c("p")), "|").alias("advice"))


@query(f"""WITH x AS (SELECT {LINE_SQL}, CASE l_returnflag WHEN 'A' THEN 'High Risk' WHEN 'N' THEN 'Medium Risk' ELSE 'Low Risk' END AS r, CASE WHEN l_tax >= l_discount AND l_tax >= 0.05 THEN 'accumulated_precip' WHEN l_discount >= 0.05 THEN 'gdd' ELSE 'ph' END AS f FROM lineitem)
SELECT {LINE_SQL}, CASE WHEN r = 'Low Risk' THEN '{risk.GOOD_ADVICE}' WHEN f = 'accumulated_precip' THEN '{risk.PRECIP_ADVICE.replace("%s", "Rainfall")}' WHEN f = 'gdd' THEN '{risk.HEAT_ADVICE.replace("%s", "Temperature/Accumulated Heat")}' ELSE '{risk.ACID_ADVICE.replace("%s", "Soil acidity (pH)")}' END AS advice FROM x""")
def attribution_advice(spark, d):
    x = t(spark, d, "lineitem").select(*LINE, F.create_map(lit("accumulated_precip"), c("l_tax"), lit("gdd"), c("l_discount"), lit("ph"), lit(0.05)).alias("m"), F.when(c("l_returnflag") == "A", risk.HIGH).when(c("l_returnflag") == "N", risk.MEDIUM).otherwise(risk.LOW).alias("r"))
    return x.select(*LINE, F.array_join(risk.attribution_advice(c("r"), c("m")), "|").alias("advice"))


# ---- series (events by user)


@query(f"""SELECT event_id, CASE WHEN v IS NOT NULL THEN round(sum(v) OVER w, 4) END AS running_value,
CASE WHEN count(v) OVER r = 3 THEN round(sum(v) OVER r, 4) END AS rolling_value, lag(v, 1) OVER o AS v_lag_1, lag(v, 3) OVER o AS v_lag_3
FROM (SELECT *, {GAPPY} AS v FROM events) WINDOW o AS (PARTITION BY user_id ORDER BY ts, event_id), w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), r AS (PARTITION BY user_id ORDER BY ts, event_id ROWS 2 PRECEDING)""")
def running_rolling_lag(spark, d):
    k, o = ["user_id"], ["ts", "event_id"]
    x = series.running_total(gappy(spark, d), k, o, {"running_value": "v"})
    x = series.lags(series.rolling_sum(x, k, o, "v", 3, "rolling_value"), k, o, "v", [1, 3])
    return x.select("event_id", F.round("running_value", 4).alias("running_value"), F.round("rolling_value", 4).alias("rolling_value"), "v_lag_1", "v_lag_3")


@query(f"""WITH x AS (SELECT user_id, row_number() OVER o - 1 AS start, lead({GAPPY}, 4) OVER o AS label, count(*) OVER w AS n, round(sum(value) OVER w, 4) AS total
FROM events WINDOW o AS (PARTITION BY user_id ORDER BY ts, event_id), w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING))
SELECT user_id, start, total, label FROM x WHERE start % 2 = 0 AND label IS NOT NULL AND n = 4""")
def sliding_sequences(spark, d):
    s = series.sequences(gappy(spark, d), ["user_id"], ["ts", "event_id"], ["value"], "v", 4, 2)
    return s.select("user_id", "start", F.round(mixture.total(F.flatten("features")), 4).alias("total"), "label")


@query(f"""WITH x AS (SELECT *, {GAPPY} AS v, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
y AS (SELECT *, last_value(v IGNORE NULLS) OVER p AS a, first_value(v IGNORE NULLS) OVER f AS b, last_value(CASE WHEN v IS NOT NULL THEN i END IGNORE NULLS) OVER p AS ia, first_value(CASE WHEN v IS NOT NULL THEN i END IGNORE NULLS) OVER f AS ib
FROM x WINDOW p AS (PARTITION BY user_id ORDER BY i ROWS UNBOUNDED PRECEDING), f AS (PARTITION BY user_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT event_id, round(CASE WHEN v IS NOT NULL THEN v WHEN a IS NULL THEN b WHEN b IS NULL THEN a ELSE a + (b - a) * (i - ia) / (ib - ia) END, 6) AS v FROM y""")
def linear_interpolation(spark, d):
    return series.interpolate(gappy(spark, d), ["user_id"], ["ts", "event_id"], ["v"]).select("event_id", r6(c("v"), "v"))


def _end_slope(h0: str, h1: str, s0: str, s1: str) -> str:
    e = f"(((2 * {h0} + {h1}) * {s0} - {h0} * {s1}) / ({h0} + {h1}))"
    return f"CASE WHEN {e} * {s0} <= 0 THEN 0 WHEN {s0} * {s1} <= 0 AND abs({e}) > 3 * abs({s0}) THEN 3 * {s0} ELSE {e} END"


@query(f"""WITH x AS (SELECT event_id, user_id, ts, {GAPPY} AS v, (epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) / 1e6 AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS i FROM events),
k AS (SELECT user_id, i, t AS x0, v AS y0, lead(t) OVER w AS x1, lead(v) OVER w AS y1, lag(t) OVER w AS xp, lag(v) OVER w AS yp FROM x WHERE v IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY i)),
s AS (SELECT *, x1 - x0 AS h, (y1 - y0) / (x1 - x0) AS s, x0 - xp AS hp, (y0 - yp) / (x0 - xp) AS sp FROM k),
n AS (SELECT *, lead(h) OVER w AS hn, lead(s) OVER w AS sn, lag(hp) OVER w AS hq, lag(sp) OVER w AS sq FROM s WINDOW w AS (PARTITION BY user_id ORDER BY i)),
d AS (SELECT *, CASE WHEN hp IS NULL THEN {_end_slope("h", "hn", "s", "sn")} WHEN h IS NULL THEN {_end_slope("hp", "hq", "sp", "sq")} WHEN s * sp > 0 THEN (3 * h + 3 * hp) / ((2 * h + hp) / sp + (h + 2 * hp) / s) ELSE 0 END AS d FROM n),
e AS (SELECT *, lead(d) OVER (PARTITION BY user_id ORDER BY i) AS d1 FROM d),
g AS (SELECT *, max(CASE WHEN v IS NOT NULL THEN i END) OVER (PARTITION BY user_id ORDER BY i) AS j FROM x),
f AS (SELECT g.event_id, g.user_id, g.ts, g.v, g.i - g.j AS run, e.h, e.y0, e.y1, e.d, e.d1, (g.t - e.x0) / e.h AS u FROM g LEFT JOIN e ON e.user_id = g.user_id AND e.i = g.j)
SELECT event_id, user_id, ts, round(CASE WHEN v IS NOT NULL THEN v WHEN run <= 5 AND h IS NOT NULL THEN (1 + 2 * u) * (1 - u) ** 2 * y0 + u * (1 - u) ** 2 * h * d + u * u * (3 - 2 * u) * y1 + u * u * (u - 1) * h * d1 ELSE 0 END, 6) AS v FROM f""")
def pchip_gap_fill(spark, d):
    return series.fill_gaps(gappy(spark, d).select("event_id", "user_id", "ts", "v"), ["user_id"], "ts", ["v"]).withColumn("v", F.round("v", 6))


@query("""SELECT event_id, user_id, date_trunc('day', ts)::TIMESTAMP AS day FROM (SELECT *, row_number() OVER (PARTITION BY user_id, date_trunc('day', ts) ORDER BY ts, event_id) AS r FROM events) WHERE r = 1""")
def first_per_day(spark, d):
    return series.first_per_day(t(spark, d, "events"), ["user_id"], "ts", ["event_id"]).select("event_id", "user_id", "day")


@query("""WITH m AS (SELECT user_id, date_trunc('day', ts)::TIMESTAMP AS day, round(avg(value), 6) AS value FROM events GROUP BY ALL),
s AS (SELECT user_id, unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS day FROM m GROUP BY 1) SELECT user_id, day, value FROM s LEFT JOIN m USING (user_id, day)""")
def daily_mean(spark, d):
    return series.daily_mean(t(spark, d, "events"), ["user_id"], "ts", ["value"], spine=True).select("user_id", "day", r6(c("value"), "value"))


@query("""WITH x AS (SELECT *, week(ts) AS year, row_number() OVER (PARTITION BY user_id, week(ts) ORDER BY ts DESC, value DESC) AS r, count(*) OVER (PARTITION BY user_id, week(ts)) AS n FROM events)
SELECT user_id, year, max(n) AS n_rows, CASE WHEN max(n) >= 12 THEN 'ok' ELSE max(n) || ' rows, need at least 12' END AS status, CASE WHEN max(n) >= 12 THEN round(sum(value) FILTER (r <= 12), 4) END AS total FROM x GROUP BY ALL""")
def last_of_period(spark, d):
    x = series.last_of_year(t(spark, d, "events"), ["user_id"], "ts", ["value"], F.weekofyear("ts").cast("long"), 12)
    return x.select("user_id", "year", "n_rows", "status", F.round(mixture.total(F.flatten("matrix")), 4).alias("total"))


@query("""WITH x AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY event_id) > ts THEN 1 ELSE 0 END AS b FROM events),
p AS (SELECT user_id, ts, sum(b) AS b, count(*) AS n FROM x GROUP BY ALL), q AS (SELECT user_id, sum(b)::BIGINT AS order_violations, sum(n - 1)::BIGINT AS duplicates FROM p GROUP BY 1)
SELECT *, CASE WHEN order_violations > 0 THEN 'error' WHEN duplicates > 0 THEN 'warning' ELSE 'ok' END AS status FROM q""")
def temporal_integrity(spark, d):
    return series.integrity(t(spark, d, "events"), ["user_id"], "event_id", "ts")


def _phi(z: str) -> str:
    """The normal distribution function by a series of positive terms."""
    return f"""(CASE WHEN {z} < -9 THEN 0 WHEN {z} > 9 THEN 1 WHEN {z} = 0 THEN 0.5 ELSE 0.5 + sign({z}) * exp(-{z} * {z} / 2) / sqrt(2 * pi()) *
list_sum(list_transform(range(0, 160), lambda n: exp((2 * n + 1) * ln(abs({z})) - (n + 1) * ln(2) - lgamma(n + 1.5) + 0.5 * ln(pi())))) END)"""


def _spi_sql(source: str, key: str, column: str, scale: int = 3, least: int = 10) -> str:
    """(event_id, spi, spi_status) of a table (event_id, key, o, column): rolling sums, a gamma fit by Newton steps, its distribution
    function by lgamma, the normal quantile by Newton steps on ``_phi``, forward then backward filled."""
    psi = "(ln({a} + 12) - 0.5 / ({a} + 12) - 1 / (12 * ({a} + 12) ** 2) + 1 / (120 * ({a} + 12) ** 4) - 1 / (252 * ({a} + 12) ** 6) - list_sum(list_transform(range(0, 12), lambda k: 1 / ({a} + k))))".format(a="a")
    psi1 = "(1 / (a + 12) + 1 / (2 * (a + 12) ** 2) + 1 / (6 * (a + 12) ** 3) - 1 / (30 * (a + 12) ** 5) + list_sum(list_transform(range(0, 12), lambda k: 1 / ((a + k) * (a + k)))))"
    return f"""WITH b AS ({source}), r AS (SELECT *, CASE WHEN count({column}) OVER w = {scale} THEN sum({column}) OVER w END AS s FROM b WINDOW w AS (PARTITION BY {key} ORDER BY o ROWS {scale - 1} PRECEDING)),
k AS (SELECT {key}, count(s) AS n, bool_or(s <= 0) AS bad, avg(s) AS m, ln(avg(s)) - avg(CASE WHEN s > 0 THEN ln(s) END) AS u, avg({column}) AS av, stddev_samp({column}) AS sd FROM r GROUP BY 1),
f AS (SELECT *, list_reduce(list_prepend((3 - u + sqrt((u - 3) ** 2 + 24 * u)) / (12 * u), range(0, 12)::DOUBLE[]), lambda a, i: a - (ln(a) - {psi} - u) / (1 / a - {psi1})) AS a FROM k),
g AS (SELECT r.*, n, bad, av, sd, list_sum(list_transform(range(0, 400), lambda i: exp((a + i) * ln(s * a / m) - s * a / m - lgamma(a + i + 1)))) AS p FROM r JOIN f USING ({key})),
q AS (SELECT *, CASE WHEN n < {least} THEN ({column} - av) / (sd + 1e-10) WHEN NOT coalesce(bad, false) AND p > 0 AND p < 1 THEN
list_reduce(list_prepend((p ** 0.135 - (1 - p) ** 0.135) / 0.1975, range(0, 6)::DOUBLE[]), lambda z, i: z - ({_phi("z")} - p) / (exp(-z * z / 2) / sqrt(2 * pi()))) END AS z FROM g)
SELECT event_id, {key}, round(coalesce(last_value(z IGNORE NULLS) OVER p, first_value(z IGNORE NULLS) OVER f), 6) AS spi, CASE WHEN n < {least} THEN 'zscore' WHEN bad THEN 'nonpositive' ELSE 'gamma' END AS spi_status
FROM q WINDOW p AS (PARTITION BY {key} ORDER BY o ROWS UNBOUNDED PRECEDING), f AS (PARTITION BY {key} ORDER BY o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)"""


@query(_spi_sql("SELECT event_id, user_id, (ts, event_id) AS o, value + 1 AS v FROM events", "user_id", "v"))
def spi_index(spark, d):
    return series.spi(t(spark, d, "events").withColumn("v", c("value") + 1), ["user_id"], ["ts", "event_id"], "v").select("event_id", "user_id", r6(c("spi"), "spi"), "spi_status")


@query("""WITH y AS (SELECT user_id, list_sort(list(DISTINCT year(ts))) AS y FROM events GROUP BY 1) SELECT user_id, array_to_string(y, ',') AS years FROM y""")
def distinct_years(spark, d):
    y = tables.years(t(spark, d, "events").withColumn("y", F.year("ts")), "y", "user_id")
    return y.select("user_id", F.array_join(F.transform("years", lambda x: x.cast("string")), ",").alias("years"))


# ---- joins


@query("""WITH a AS (SELECT DISTINCT n_regionkey AS r, round(c_acctbal, -2) AS x FROM customer JOIN nation ON c_nationkey = n_nationkey),
p AS (SELECT s_suppkey, n_regionkey AS r, s_acctbal AS v FROM supplier JOIN nation ON s_nationkey = n_nationkey),
k AS (SELECT s_suppkey, x, row_number() OVER (PARTITION BY s_suppkey ORDER BY abs(x - v), x DESC) AS i FROM p JOIN a USING (r)) SELECT s_suppkey, x AS nearest FROM k WHERE i = 1""")
def nearest_axis_value(spark, d):
    n = t(spark, d, "nation").select("n_nationkey", c("n_regionkey").alias("r"))
    axis = t(spark, d, "customer").join(n, c("c_nationkey") == c("n_nationkey")).select("r", F.round("c_acctbal", -2).alias("x"))
    points = t(spark, d, "supplier").join(n, c("s_nationkey") == c("n_nationkey")).select("s_suppkey", "r", "s_acctbal")
    return align.nearest_on_axis(points, axis, ["r"], "s_acctbal", "x", "nearest").select("s_suppkey", "nearest")


@query("""WITH g AS (SELECT DISTINCT n_regionkey AS r, round(c_acctbal / 50, 1) AS lat, c_custkey % 997 / 7.0 AS lon FROM customer JOIN nation ON c_nationkey = n_nationkey),
p AS (SELECT o_orderkey, n_regionkey AS r, o_totalprice / 2500 AS lat, o_orderkey % 10007 / 70.0 AS lon FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
la AS (SELECT r, lat AS a, lead(lat) OVER (PARTITION BY r ORDER BY lat) AS b, lag(lat) OVER (PARTITION BY r ORDER BY lat) IS NULL AS first FROM (SELECT DISTINCT r, lat FROM g)),
lo AS (SELECT r, lon AS a, lead(lon) OVER (PARTITION BY r ORDER BY lon) AS b, lag(lon) OVER (PARTITION BY r ORDER BY lon) IS NULL AS first FROM (SELECT DISTINCT r, lon FROM g))
SELECT o_orderkey, CASE WHEN p.lat < x.a OR x.b IS NULL THEN x.a WHEN x.b - p.lat <= p.lat - x.a THEN x.b ELSE x.a END AS cell_lat, round(CASE WHEN p.lon < y.a OR y.b IS NULL THEN y.a WHEN y.b - p.lon <= p.lon - y.a THEN y.b ELSE y.a END, 6) AS cell_lon
FROM p JOIN la x ON x.r = p.r AND (p.lat >= x.a OR x.first) AND (p.lat < x.b OR x.b IS NULL) JOIN lo y ON y.r = p.r AND (p.lon >= y.a OR y.first) AND (p.lon < y.b OR y.b IS NULL)""")
def nearest_cells(spark, d):
    """Cells of customers near orders, both axes, five sites of all rows: each is a hot key."""
    n = t(spark, d, "nation").select(c("n_nationkey").alias("c_nationkey"), c("n_regionkey").alias("r"))
    k = t(spark, d, "customer").join(n, "c_nationkey")
    grid = k.select("r", F.round(c("c_acctbal") / 50, 1).alias("lat"), (c("c_custkey") % 997 / 7).alias("lon"))
    o = t(spark, d, "orders").join(k.select(c("c_custkey").alias("o_custkey"), "r"), "o_custkey")
    points = o.select("o_orderkey", "r", (c("o_totalprice") / 2500).alias("lat"), (c("o_orderkey") % 10007 / 70).alias("lon"))
    return align.nearest_cell(points, grid, ["r"], hot_rows=2000).select("o_orderkey", "cell_lat", F.round("cell_lon", 6).alias("cell_lon"))


@query("""WITH l AS (SELECT DISTINCT user_id, date_trunc('week', ts)::TIMESTAMP AS week FROM events),
h AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
j AS (SELECT l.user_id, l.week, h.i, h.value, count(*) FILTER (h.ts <= l.week) OVER (PARTITION BY l.user_id, l.week) AS past, count(*) OVER (PARTITION BY l.user_id, l.week) AS n FROM l JOIN h USING (user_id))
SELECT user_id, week, CASE WHEN max(past) >= 12 THEN 'recent' ELSE 'first' END AS window_source, round(sum(value), 4) AS total FROM j
WHERE n >= 12 AND ((past >= 12 AND i > past - 12 AND i <= past) OR (past < 12 AND i <= 12)) GROUP BY ALL""")
def as_of_windows(spark, d):
    e = t(spark, d, "events")
    labels = e.select("user_id", F.date_trunc("week", "ts").alias("week")).distinct()
    w = align.history_windows(labels, e, ["user_id"], ["user_id", "week"], "week", "ts", ["value"], ["event_id"], 12)
    return w.select("user_id", "week", "window_source", F.round(mixture.total(F.flatten("window")), 4).alias("total"))


@query("""WITH a AS (SELECT DISTINCT user_id, date_trunc('day', ts)::TIMESTAMP AS day FROM events WHERE event_type = 'click'), b AS (SELECT DISTINCT user_id, date_trunc('day', ts)::TIMESTAMP AS day FROM events WHERE event_type <> 'click')
SELECT user_id, day FROM a JOIN b USING (user_id, day)""")
def common_days(spark, d):
    e = t(spark, d, "events").withColumn("day", F.date_trunc("day", "ts"))
    a, _ = align.common_days(e.filter("event_type = 'click'").select("user_id", "day").distinct(), e.filter("event_type <> 'click'").select("user_id", "day"), ["user_id"])
    return a


_GRID = "SELECT p_size % 5 AS lat, p_partkey % 5 AS lon, p_brand AS site, avg(p_retailprice) AS v FROM part GROUP BY ALL"


@query(f"""WITH g AS ({_GRID}), f AS (SELECT s.site, i * 0.5 - 0.25 AS lat, j * 0.5 - 0.25 AS lon FROM (SELECT DISTINCT site FROM g) s, range(10) a(i), range(10) b(j)),
ax AS (SELECT site, lat AS a, lead(lat) OVER (PARTITION BY site ORDER BY lat) AS b FROM (SELECT DISTINCT site, lat FROM g)), ay AS (SELECT site, lon AS a, lead(lon) OVER (PARTITION BY site ORDER BY lon) AS b FROM (SELECT DISTINCT site, lon FROM g)),
h AS (SELECT f.site, f.lat, f.lon, x.a AS x0, x.b AS x1, y.a AS y0, y.b AS y1, (f.lat - x.a) / (x.b - x.a) AS u, (f.lon - y.a) / (y.b - y.a) AS w FROM f JOIN ax x ON x.site = f.site AND f.lat > x.a AND f.lat < x.b JOIN ay y ON y.site = f.site AND f.lon > y.a AND f.lon < y.b),
r AS (SELECT h.site, h.lat, h.lon, (1-u)*(1-w)*p.v + (1-u)*w*q.v + u*(1-w)*s.v + u*w*t.v AS v FROM h JOIN g p ON p.site=h.site AND p.lat=x0 AND p.lon=y0 JOIN g q ON q.site=h.site AND q.lat=x0 AND q.lon=y1 JOIN g s ON s.site=h.site AND s.lat=x1 AND s.lon=y0 JOIN g t ON t.site=h.site AND t.lat=x1 AND t.lon=y1)
SELECT f.site, f.lat, f.lon, round(coalesce(r.v, 0), 7) AS v FROM f LEFT JOIN r USING (site, lat, lon)""")
def bilinear_regrid(spark, d):
    g = t(spark, d, "part").groupBy((c("p_size") % 5).cast("double").alias("lat"), (c("p_partkey") % 5).cast("double").alias("lon"), c("p_brand").alias("site")).agg(F.avg("p_retailprice").alias("v"))
    g = g.withColumn("day", lit("2024-01-01"))
    axis = F.sequence(lit(0), lit(9))
    fine = g.select("site").distinct().withColumn("i", F.explode(axis)).withColumn("j", F.explode(axis)).select("site", (c("i") * 0.5 - 0.25).alias("lat"), (c("j") * 0.5 - 0.25).alias("lon"))
    return align.regrid(g, fine, ["site"], "day", ["v"]).select("site", "lat", "lon", F.round("v", 7).alias("v"))


@query("""SELECT o_orderkey, c_acctbal, n_name, coalesce(s.n, 0) AS suppliers FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN (SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY 1) s ON s.s_nationkey = c_nationkey""")
def attach_labels_and_soil(spark, d):
    o = t(spark, d, "orders").select("o_orderkey", c("o_custkey").alias("c_custkey"))
    x = align.attach(o, t(spark, d, "customer").select("c_custkey", "c_acctbal", "c_nationkey"), ["c_custkey"])
    x = align.attach(x, t(spark, d, "nation").select(c("n_nationkey").alias("c_nationkey"), "n_name"), ["c_nationkey"], "left")
    s = t(spark, d, "supplier").groupBy(c("s_nationkey").alias("c_nationkey")).agg(F.count(lit(1)).alias("n"))
    return align.attach(x, s, ["c_nationkey"], "left").select("o_orderkey", "c_acctbal", "n_name", F.coalesce("n", lit(0)).alias("suppliers"))


@query("""WITH p AS (SELECT c_nationkey AS k, avg(o_totalprice) AS p FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1) SELECT s_suppkey, round(coalesce(s_acctbal * p, 0), 2) AS interaction FROM supplier LEFT JOIN p ON k = s_nationkey""")
def soil_weather_interaction(spark, d):
    w = t(spark, d, "orders").join(t(spark, d, "customer"), c("o_custkey") == c("c_custkey")).select(c("c_nationkey").alias("site"), c("o_totalprice").alias("precip"))
    s = t(spark, d, "supplier").select("s_suppkey", c("s_nationkey").alias("site"), c("s_acctbal").alias("soil_pH"))
    return tables.soil_precip_interaction(s, w, "site").select("s_suppkey", F.round("ph_precip_interaction", 2).alias("interaction"))


@query("""SELECT n_nationkey, CASE WHEN n % 5 = 0 THEN 'MISSING → zero-vector' ELSE 'file:' || n_name || '_soil.csv' END AS soil_source, CASE WHEN n % 5 = 0 THEN '0.0,0.0,0.0' ELSE n || '.0,' || n * 2 || '.0,0.0' END AS soil,
CASE WHEN n % 5 = 0 THEN 'no soil row' ELSE '' END AS soil_warnings FROM (SELECT *, n_nationkey AS n FROM nation)""")
def soil_provenance(spark, d):
    n = t(spark, d, "nation").select("n_nationkey", "n_name")
    soil = n.filter("n_nationkey % 5 <> 0").select("n_name", c("n_nationkey").cast("double").alias("a"), (c("n_nationkey") * 2).cast("double").alias("b"))
    x = tables.soil_vectors(n, soil, "n_name", ["a", "b"], 3)
    return x.select("n_nationkey", "soil_source", F.array_join(F.transform("soil", lambda v: v.cast("string")), ",").alias("soil"), F.array_join("soil_warnings", ",").alias("soil_warnings"))


@query("""SELECT user_id, day, round(a.value, 4) AS sat, round(b.value, 4) AS rain FROM (SELECT user_id, date_trunc('day', ts)::TIMESTAMP AS day, avg(value) AS value FROM events WHERE event_type = 'click' GROUP BY ALL) a
JOIN (SELECT user_id, date_trunc('day', ts)::TIMESTAMP AS day, avg(value) AS value FROM events WHERE event_type <> 'click' GROUP BY ALL) b USING (user_id, day)""")
def stack_modalities(spark, d):
    e = t(spark, d, "events")
    a = series.daily_mean(e.filter("event_type = 'click'"), ["user_id"], "ts", ["value"]).withColumnRenamed("value", "s")
    b = series.daily_mean(e.filter("event_type <> 'click'"), ["user_id"], "ts", ["value"]).withColumnRenamed("value", "w")
    x = align.stack_features(a, b, ["user_id", "day"], ["s"], ["w"])
    x = align.split_features(x.withColumn("features", F.array("features")), 1)
    return x.select("user_id", "day", F.round(c("sat")[0][0], 4).alias("sat"), F.round(c("weather")[0][0], 4).alias("rain"))


@query("""SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE year(o_orderdate) = 1995) OR c_custkey NOT IN (SELECT o_custkey FROM orders WHERE year(o_orderdate) = 1997)""")
def sites_without_features(spark, d):
    o = t(spark, d, "orders").select(c("o_custkey").alias("c_custkey"), F.year("o_orderdate").alias("y"))
    return align.missing_sites(t(spark, d, "customer").select("c_custkey"), o.filter("y = 1995"), o.filter("y = 1997"), on=["c_custkey"])


@query("""WITH c AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE year(o_orderdate) = 1997), r AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE year(o_orderdate) = 1995) SELECT k, k NOT IN (SELECT k FROM r) AS reference_missing FROM c""")
def match_reference(spark, d):
    o = t(spark, d, "orders").select(c("o_custkey").alias("k"), F.year("o_orderdate").alias("y"))
    return align.match_reference(o.filter("y = 1997"), o.filter("y = 1995"), "k")


@query("""WITH m AS (SELECT o_custkey AS k, avg(o_totalprice) AS v FROM orders GROUP BY 1) SELECT k, c_nationkey, round(CASE WHEN k % 10 = 0 THEN 1000.5 ELSE v END, 4) AS shown_yield FROM m JOIN customer ON c_custkey = k""")
def map_table(spark, d):
    y = t(spark, d, "orders").select(c("o_custkey").alias("k"), "o_totalprice")
    areas = t(spark, d, "customer").select(c("c_custkey").alias("k"), "c_nationkey")
    f = areas.filter("k % 10 = 0").select("k", lit(1000.5).alias("forecast"))
    return tables.map_table(y, areas, f, "k", "o_totalprice").select("k", "c_nationkey", F.round("shown_yield", 4).alias("shown_yield"))


@query("""SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""")
def region_filter(spark, d):
    y = t(spark, d, "orders").select("o_orderkey", c("o_custkey").alias("site"))
    return tables.region_filter(y, t(spark, d, "customer").filter("c_mktsegment = 'BUILDING'").select(c("c_custkey").alias("site")), "site").select("o_orderkey")


# ---- aggregations


@query("""SELECT l_returnflag, round(avg(CASE WHEN l_linenumber IN (4, 5, 6) THEN 1.0 ELSE 0 END), 6) AS valid_ratio, avg(CASE WHEN l_linenumber IN (4, 5, 6) THEN 1.0 ELSE 0 END) < 0.1 AS is_unreliable FROM lineitem GROUP BY 1""")
def valid_ratio(spark, d):
    return tables.valid_ratio(t(spark, d, "lineitem"), ["l_returnflag"], "l_linenumber").withColumn("valid_ratio", F.round("valid_ratio", 6))


@query("""SELECT p_partkey, round((p_retailprice - m) / s, 6) AS price_z, round((p_size - n) / q, 6) AS size_z FROM part, (SELECT avg(p_retailprice) AS m, stddev_samp(p_retailprice) AS s, avg(p_size) AS n, stddev_samp(p_size) AS q FROM part)""")
def soil_z_scores(spark, d):
    x = t(spark, d, "part").select("p_partkey", c("p_retailprice").alias("price_z"), c("p_size").alias("size_z"))
    return tables.z_scores(x, ["price_z", "size_z"]).select("p_partkey", r6(c("price_z"), "price_z"), r6(c("size_z"), "size_z"))


_IQR = "(SELECT q1, q3, q1 - 1.5 * (q3 - q1) AS lower, q3 + 1.5 * (q3 - q1) AS upper FROM (SELECT quantile_cont(l_extendedprice, 0.25) AS q1, quantile_cont(l_extendedprice, 0.75) AS q3 FROM lineitem))"


@query(f"""SELECT round(q1, 4) AS q1, round(q3, 4) AS q3, round(lower, 4) AS lower, round(upper, 4) AS upper, count(*) FILTER (l_extendedprice < lower OR l_extendedprice > upper) AS outliers FROM lineitem, {_IQR} GROUP BY q1, q3, lower, upper""")
def iqr_outliers(spark, d):
    x = bias.iqr_bounds(t(spark, d, "lineitem"), "l_extendedprice")
    return x.select(*(F.round(n, 4).alias(n) for n in ("q1", "q3", "lower", "upper")), "outliers")


@query(f"""SELECT count(*) AS n, round(sum(least(greatest(l_extendedprice, lower), upper)), 2) AS total FROM lineitem, {_IQR}""")
def bias_clip(spark, d):
    return bias.correct_bias(t(spark, d, "lineitem"), ["l_extendedprice"], fix_skew=False).agg(F.count(lit(1)).alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("total"))


def _box_cox_sql(table: str, column: str) -> str:
    """lambda_{column}: the best of a fine grid of powers, by the profile likelihood of the centred logs."""
    u = f"ln({column}) - (SELECT avg(ln({column})) FROM {table})"
    return f"""SELECT k / 1000.0 FROM (SELECT k, var_pop(CASE WHEN k = 0 THEN u ELSE exp(k / 1000.0 * u) / (k / 1000.0) END) AS v FROM (SELECT {u} AS u FROM {table}) t, (SELECT unnest(range(-3000, 3001)) AS k) g GROUP BY k) ORDER BY v, k LIMIT 1"""


@query(f"""WITH p AS (SELECT p_partkey, p_retailprice AS price, p_size::DOUBLE AS size, (p_partkey % 13 + 1)::DOUBLE ** 3 AS cube FROM part),
k AS (SELECT ({_box_cox_sql("p", "price")}) AS a, ({_box_cox_sql("p", "size")}) AS b, ({_box_cox_sql("p", "cube")}) AS c)
SELECT count(*) AS n, round(any_value(a), 2) AS lambda_price, round(any_value(b), 2) AS lambda_size, round(any_value(c), 2) AS lambda_cube FROM p, k""")
def box_cox_powers(spark, d):
    """Three columns in the same passes; powers to two digits, which a grid of thousandths can tell."""
    p = t(spark, d, "part").select(c("p_retailprice").alias("price"), c("p_size").cast("double").alias("size"), F.pow((c("p_partkey") % 13 + 1).cast("double"), lit(3.0)).alias("cube"))
    k = {n: v for n, (v, _) in bias.box_cox_all(p, ["price", "size", "cube"]).items()}
    return p.agg(F.count(lit(1)).alias("n")).select("n", *(F.round(lit(v), 2).alias(f"lambda_{n}") for n, v in k.items()))


@query()
def box_cox(spark, d):
    x, k, shift = bias.box_cox(t(spark, d, "part").select("p_partkey", "p_retailprice"), "p_retailprice", "price_bc")
    return x.withColumns({"box_cox_lambda": lit(k), "shift": lit(shift)})


_HASH = "('0x' || substr(md5({}), 1, 15))::BIGINT"


@query(f"""WITH o AS (SELECT o_orderkey, o_orderpriority AS p, {_HASH.format("'42:' || o_orderkey")} % greatest(1, (SELECT max(n) FROM (SELECT count(*) AS n FROM orders GROUP BY o_orderpriority)) // 100000) AS part FROM orders),
r AS (SELECT *, row_number() OVER (PARTITION BY p ORDER BY part, o_orderkey) - 1 AS i FROM o), k AS (SELECT p, count(*) AS n FROM o GROUP BY 1), m AS (SELECT max(n) AS m FROM k),
w AS (SELECT p, {_HASH.format("'42:' || p || ':' || x")} % n AS i FROM (SELECT p, n, unnest(range(0, m - n)) AS x FROM k, m WHERE n < m)),
a AS (SELECT p, i FROM w UNION ALL SELECT p, i FROM r) SELECT r.o_orderkey, r.p AS o_orderpriority, count(*) AS copies FROM a JOIN r USING (p, i) GROUP BY ALL""")
def class_balance(spark, d):
    x = bias.balance_classes(t(spark, d, "orders"), "o_orderpriority", ["o_orderkey"])
    return x.groupBy("o_orderkey", "o_orderpriority").agg(F.count(lit(1)).alias("copies"))


_SIDES = "SELECT l_returnflag AS region, CASE WHEN year(l_shipdate) <= 1997 THEN 'ref' ELSE 'cur' END AS side, l_extendedprice AS x FROM lineitem"


def sides(spark, d):
    return t(spark, d, "lineitem").select(c("l_returnflag").alias("region"), F.when(F.year("l_shipdate") <= 1997, "ref").otherwise("cur").alias("side"), c("l_extendedprice").alias("x"))


@query(f"""WITH s AS ({_SIDES}), m AS (SELECT region, min(x) AS a, max(x) AS b, count(*) FILTER (side = 'ref') AS nr, count(*) FILTER (side = 'cur') AS nc FROM s GROUP BY 1),
k AS (SELECT s.region, side, (SELECT count(*) FROM range(1, 10) e(i) WHERE s.x >= m.a + (m.b - m.a) * i / 10) AS bin FROM s JOIN m USING (region)),
z AS (SELECT m.region, nr, nc, i AS bin, a, b FROM m, range(0, 10) e(i)),
h AS (SELECT z.region, nr, nc, a, b, z.bin, count(*) FILTER (k.side = 'ref') AS r, count(*) FILTER (k.side = 'cur') AS c FROM z LEFT JOIN k ON k.region = z.region AND k.bin = z.bin GROUP BY ALL),
p AS (SELECT *, CASE WHEN r = 0 THEN 1e-4 ELSE r / nr END AS pr, CASE WHEN c = 0 THEN 1e-4 ELSE c / nc END AS pc FROM h),
q AS (SELECT region, CASE WHEN max(nr) > 5 AND max(nc) > 5 THEN sum((pc - pr) * ln(pc / pr)) END AS psi FROM p GROUP BY 1)
SELECT region, round(psi, 6) AS psi, CASE WHEN psi IS NULL THEN 'SKIP' WHEN psi >= 0.25 THEN 'BLOCK' WHEN psi >= 0.1 THEN 'WARN' ELSE 'OK' END AS status FROM q""")
def psi_drift(spark, d):
    p = drift.psi(sides(spark, d), "region", "side", "x")
    return p.select("region", r6(c("psi"), "psi"), drift.psi_status(c("psi")).alias("status"))


@query(f"""WITH s AS ({_SIDES}), n AS (SELECT region, count(*) FILTER (side = 'ref') AS nr, count(*) FILTER (side = 'cur') AS nc FROM s GROUP BY 1),
v AS (SELECT region, x, count(*) FILTER (side = 'ref') AS r, count(*) FILTER (side = 'cur') AS c FROM s GROUP BY ALL),
u AS (SELECT region, sum(r) OVER w AS r, sum(c) OVER w AS c FROM v WINDOW w AS (PARTITION BY region ORDER BY x))
SELECT region, nr AS n_ref, nc AS n_cur, round(max(abs(r / nullif(nr, 0) - c / nullif(nc, 0))), 9) AS ks_d FROM u JOIN n USING (region) GROUP BY ALL""")
def ks_distance(spark, d):
    x = drift.ks_distance(sides(spark, d), "region", "side", "x")
    return x.select("region", "n_ref", "n_cur", F.round("ks_d", 9).alias("ks_d"))


@query(f"""WITH s AS ({_SIDES}), b AS (SELECT region, side, x, least(greatest(floor(x / 120000 * 3000), 0), 2999)::INT AS bin FROM s WHERE x IS NOT NULL),
g AS (SELECT region, bin, count(*) FILTER (side = 'ref') AS r, count(*) FILTER (side = 'cur') AS c, min(x) AS lo, max(x) AS hi FROM b GROUP BY ALL),
e AS (SELECT region, min(lo) AS a, max(hi) AS z, sum(r) AS nr, sum(c) AS nc FROM g GROUP BY 1),
p AS (SELECT g.*, a, z, nr, nc, least(floor((lo - a) / (z - a) * 10), 9) AS f, least(floor((hi - a) / (z - a) * 10), 9) AS l, abs(sum(r) OVER w / nr - sum(c) OVER w / nc) AS gap FROM g JOIN e USING (region) WINDOW w AS (PARTITION BY region ORDER BY bin)),
k AS (SELECT region, max(gap) AS ks_d, max(greatest(r / nr, c / nc)) AS ks_off, sum(CASE WHEN f <> l THEN r + c ELSE 0 END) / sum(r + c) AS psi_off FROM p GROUP BY 1),
q AS (SELECT region, f, sum(r) / any_value(nr) AS r, sum(c) / any_value(nc) AS c FROM p GROUP BY ALL),
h AS (SELECT region, sum((CASE WHEN coalesce(c, 0) = 0 THEN 1e-4 ELSE c END - CASE WHEN coalesce(r, 0) = 0 THEN 1e-4 ELSE r END) * ln(CASE WHEN coalesce(c, 0) = 0 THEN 1e-4 ELSE c END / CASE WHEN coalesce(r, 0) = 0 THEN 1e-4 ELSE r END)) AS psi
FROM (SELECT region, unnest(range(0, 10)) AS f FROM e) LEFT JOIN q USING (region, f) GROUP BY 1)
SELECT region, nr::BIGINT AS n_ref, nc::BIGINT AS n_cur, round(psi, 6) AS psi, round(psi_off, 9) AS psi_off, round(ks_d, 9) AS ks_d, round(ks_off, 9) AS ks_off FROM h JOIN k USING (region) JOIN e USING (region)""")
def drift_histograms(spark, d):
    """Drift from a stored sketch by month: any two periods can be compared without the values."""
    x = sides(spark, d)
    path = io.scratch(spark, "histograms")
    drift.histograms(x, "region", "side", "x", 0.0, 120000.0, 3000).write.parquet(path)
    p = drift.drift_of_histograms(spark.read.parquet(path), "region", c("side"))
    return p.select("region", "n_ref", "n_cur", r6(c("psi"), "psi"), *(F.round(n, 9).alias(n) for n in ("psi_off", "ks_d", "ks_off")))


@query("""WITH x AS (SELECT l_returnflag AS site, year(l_shipdate) <= 1997 AS ref, CASE WHEN (l_tax + 0.2) + l_discount = 0 THEN 1e-6 ELSE (l_tax + 0.2) + l_discount END AS u, (l_tax + 0.2) - l_discount AS w, l_quantity AS q FROM lineitem),
v AS (SELECT site, ref, w / u AS v, q FROM x), m AS (SELECT site, min(v) AS a, max(v) AS b, count(*) FILTER (ref) AS nr, count(*) FILTER (NOT ref) AS nc FROM v GROUP BY 1),
k AS (SELECT v.site, ref, list_sum(list_transform(range(1, 10), lambda i: (v.v >= m.a + (m.b - m.a) * i / 10)::INT)) AS bin FROM v JOIN m USING (site)),
g AS (SELECT s.site, s.bin, nr, nc, count(*) FILTER (k.ref) AS r, count(*) FILTER (NOT k.ref) AS c FROM (SELECT site, nr, nc, unnest(range(0, 10)) AS bin FROM m) s LEFT JOIN k ON k.site = s.site AND k.bin = s.bin GROUP BY ALL),
p AS (SELECT site, sum((pc - pr) * ln(pc / pr)) AS psi FROM (SELECT site, CASE WHEN r = 0 THEN 1e-4 ELSE r / nr END AS pr, CASE WHEN c = 0 THEN 1e-4 ELSE c / nc END AS pc FROM g) GROUP BY 1),
d AS (SELECT site, any_value(nr) * any_value(nc) / (any_value(nr) + any_value(nc)) AS n, max(abs(r / nr - c / nc)) AS d FROM
(SELECT site, q, nr, nc, sum(r) OVER (PARTITION BY site ORDER BY q) AS r, sum(c) OVER (PARTITION BY site ORDER BY q) AS c FROM (SELECT site, q, count(*) FILTER (ref) AS r, count(*) FILTER (NOT ref) AS c FROM v GROUP BY ALL) JOIN m USING (site)) GROUP BY 1),
t AS (SELECT site, CASE WHEN psi >= 0.25 THEN 'BLOCK' WHEN psi >= 0.1 THEN 'WARN' ELSE 'OK' END AS ndvi_status, round(psi, 4) AS ndvi_psi,
CASE WHEN z < 0.3 THEN 1 ELSE 2 * list_sum(list_transform(range(1, 101), lambda j: CASE WHEN j % 2 = 1 THEN 1 ELSE -1 END * exp(-2.0 * j * j * z * z))) END AS pv FROM p JOIN (SELECT site, (sqrt(n) + 0.12 + 0.11 / sqrt(n)) * d AS z FROM d) USING (site))
SELECT site, ndvi_psi, ndvi_status, CASE WHEN pv < 0.001 THEN 'BLOCK' WHEN pv < 0.05 THEN 'WARN' ELSE 'OK' END AS ks_status,
CASE WHEN ndvi_status = 'BLOCK' OR pv < 0.001 THEN 'BLOCK' WHEN ndvi_status = 'WARN' OR pv < 0.05 THEN 'WARN' ELSE 'OK' END AS overall_status, false AS reference_missing FROM t""")
def drift_verdicts(spark, d):
    """The drift report without the digits of p, which SQL has by a series only."""
    return drift_report(spark, d).drop("ks_pvalue")


@query()
def drift_report(spark, d):
    x = t(spark, d, "lineitem").select(c("l_returnflag").alias("site"), F.year("l_shipdate").alias("y"), c("l_discount").alias("B04"), (c("l_tax") + 0.2).alias("B08"), c("l_quantity").alias("t_max"))
    a, b = x.filter("y <= 1997"), x.filter("y > 1997")
    return jobs.drift_check(a, b, a, b)


_PRED = "SELECT l_returnflag, l_quantity + 1 AS y, l_quantity + 1 + (l_discount - 0.05) * 10 AS p, 0.3 AS s FROM lineitem"


@query(f"""WITH x AS ({_PRED}) SELECT l_returnflag, round(avg(abs(p - y)), 4) AS mae, round(sqrt(avg((p - y) * (p - y))), 4) AS rmse, round(1 - sum((p - y) * (p - y)) / (var_pop(y) * count(*)), 4) AS r2, round(avg(abs((y - p) / (y + 1e-10))) * 100, 2) AS mape, round(avg(p - y), 4) AS mean_bias FROM x GROUP BY 1""")
def point_metrics(spark, d):
    x = t(spark, d, "lineitem").select("l_returnflag", (c("l_quantity") + 1).alias("y"), (c("l_quantity") + 1 + (c("l_discount") - 0.05) * 10).alias("p"))
    return metrics.point_metrics(x, "y", "p", ["l_returnflag"])


@query(f"""WITH x AS ({_PRED}) SELECT round(sqrt(avg((p - y) * (p - y))), 6) AS rmse, round(avg(abs(p - y)), 6) AS mae, round(avg(CASE WHEN abs(y - p) <= 1.96 * s THEN 1.0 ELSE 0 END), 6) AS calibration_95, count(*) AS num_samples, round(avg((y - p) * (y - p)) + 0.1 * avg(abs(y - p)), 6) AS point_loss FROM x""")
def benchmark_metrics(spark, d):
    x = t(spark, d, "lineitem").select((c("l_quantity") + 1).alias("y"), (c("l_quantity") + 1 + (c("l_discount") - 0.05) * 10).alias("p"), lit(0.3).alias("s"))
    b = metrics.benchmark_report(x, "y", "p", "s").crossJoin(x.agg(mixture.point_loss(c("y"), c("p")).alias("point_loss")))
    return b.select(r6(c("rmse"), "rmse"), r6(c("mae"), "mae"), r6(c("calibration_95"), "calibration_95"), "num_samples", r6(c("point_loss"), "point_loss"))


@query("""WITH h AS (SELECT o_custkey AS site, avg(o_totalprice) AS a FROM orders GROUP BY 1), l AS (SELECT o_custkey AS site, year(o_orderdate) AS year, arg_max(o_totalprice, (o_orderdate, o_totalprice)) AS y FROM orders GROUP BY ALL)
SELECT site, year, round(y, 4) AS observed_yield, round(a, 4) AS historical_avg FROM l JOIN h USING (site)""")
def site_history(spark, d):
    y = t(spark, d, "orders").select(c("o_custkey").alias("site"), F.year("o_orderdate").cast("long").alias("year"), "o_orderdate", "o_totalprice")
    x = tables.site_history(y, "site", "year", "o_orderdate", "o_totalprice")
    return x.select("site", "year", F.round("observed_yield", 4).alias("observed_yield"), F.round("historical_avg", 4).alias("historical_avg"))


@query("""WITH m AS (SELECT o_custkey AS site, avg(o_totalprice) AS v FROM orders GROUP BY 1) SELECT site, round(v, 4) AS mean_value, round((v - lo) / greatest(hi - lo, 0.1), 6) AS ratio FROM m, (SELECT min(v) AS lo, max(v) AS hi FROM m)""")
def scaled_site_means(spark, d):
    x = tables.scaled_means(t(spark, d, "orders").select(c("o_custkey").alias("site"), "o_totalprice"), "site", "o_totalprice")
    return x.select("site", F.round("mean_value", 4).alias("mean_value"), r6(c("ratio"), "ratio"))


_COLS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query(" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM lineitem" for a in _COLS for b in _COLS))
def correlation_matrix(spark, d):
    return tables.correlations(t(spark, d, "lineitem"), list(_COLS)).select("a", "b", r6(c("r"), "r"))


@query("""WITH q AS (SELECT l_returnflag AS k, min(l_quantity) AS a, quantile_cont(l_quantity, 0.25) AS q1, quantile_cont(l_quantity, 0.5) AS m, quantile_cont(l_quantity, 0.75) AS q3, max(l_quantity) AS b FROM lineitem GROUP BY 1)
SELECT l_returnflag, a AS min_value, q1, m AS median, q3, b AS max_value, min(l_quantity) FILTER (l_quantity >= q1 - 1.5 * (q3 - q1)) AS whisker_low, max(l_quantity) FILTER (l_quantity <= q3 + 1.5 * (q3 - q1)) AS whisker_high FROM lineitem JOIN q ON k = l_returnflag GROUP BY ALL""")
def distribution_summary(spark, d):
    return tables.summary(t(spark, d, "lineitem").select("l_returnflag", "l_quantity"), ["l_returnflag"], "l_quantity")


# ---- mixtures (slices of embeddings)

_MIX = """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS e, (vec_id % 5)::DOUBLE AS y FROM embeddings),
s AS (SELECT vec_id, y, list_transform(e[1:5], lambda x: exp(4 * x)) AS w, list_transform(e[6:10], lambda x: 0.1 + abs(x)) AS sigma, list_transform(e[11:15], lambda x: 3 + 8 * x) AS mu FROM e),
u AS (SELECT vec_id, y, i, w[i] / list_sum(w) AS p, sigma[i] AS s, mu[i] AS m FROM s, range(1, 6) r(i)),
g AS (SELECT vec_id, y, sum(p * m) AS mean, sqrt(greatest(sum(p * (s * s + m * m)) - sum(p * m) * sum(p * m), 1e-6)) AS std, sum(p * s) AS spread,
 max(ln(p + 1e-10) - 0.5 * ((y - m) * (y - m) / (s * s) + ln(s * s) + ln(2 * pi()))) AS top, sum(p * ln(p + 1e-10)) AS ent,
 sum(p * -0.5 * ((y - m) * (y - m) / (s * s + 1e-6) + ln(s * s + 1e-6) + ln(2 * pi()))) AS wl, list(struct_pack(k := -p, i := i, p := p, m := m) ORDER BY p DESC, i) FILTER (p >= 0.2) AS modes FROM u GROUP BY ALL),
f AS (SELECT g.*, -(top + ln((SELECT sum(exp(ln(p + 1e-10) - 0.5 * ((u.y - m) * (u.y - m) / (s * s) + ln(s * s) + ln(2 * pi())) - g.top)) FROM u WHERE u.vec_id = g.vec_id))) + 0.01 * ent AS nll,
 coalesce(len(modes) >= 2 AND abs(modes[1].m - modes[2].m) / (spread + 1e-8) >= 1.5, false) AS two FROM g)"""


def mixtures(spark, d):
    e = t(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("e"), (c("vec_id") % 5).cast("double").alias("y"))
    w = F.transform(F.slice("e", 1, 5), lambda x: F.exp(4 * x))
    e = e.withColumn("w", w)
    return e.select("vec_id", "y", F.transform("w", lambda x: x / mixture.total(c("w"))).alias("pi"), F.transform(F.slice("e", 6, 5), lambda x: 0.1 + F.abs(x)).alias("sigma"), F.transform(F.slice("e", 11, 5), lambda x: 3 + 8 * x).alias("mu"))


def parts():
    return c("pi"), c("sigma"), c("mu")


@query(_MIX + """ SELECT vec_id, round(mean, 5) AS mean, round(std, 5) AS std, two AS is_bimodal, round(CASE WHEN two THEN modes[1].m ELSE mean END, 5) AS estimate,
round(CASE WHEN two THEN 1 - abs(modes[1].p - modes[2].p) / (modes[1].p + modes[2].p + 1e-8) ELSE 0 END, 5) AS valley_depth, coalesce(len(modes), 0) AS n_modes, round(nll, 5) AS nll, round(mean - 1.959963984540054 * spread, 5) AS lower, round(mean + 1.959963984540054 * spread, 5) AS upper FROM f""")
def mixture_functions(spark, d):
    x = mixtures(spark, d).withColumn("report", mixture.bimodality(*parts()))
    low, high = mixture.interval(*parts())
    r5 = lambda v, n: F.round(v, 5).alias(n)
    return x.select(
        "vec_id",
        r5(mixture.mean(c("pi"), c("mu")), "mean"),
        r5(mixture.std(*parts()), "std"),
        c("report.is_bimodal").alias("is_bimodal"),
        r5(mixture.safe_estimate(c("report"))[0], "estimate"),
        r5(c("report.valley_depth"), "valley_depth"),
        F.size("report.modes").cast("long").alias("n_modes"),
        r5(mixture.nll(*parts(), c("y")), "nll"),
        r5(low, "lower"),
        r5(high, "upper"),
    )


@query(_MIX + """ SELECT round(avg(nll), 6) AS nll, round(-avg(wl), 6) AS diagnostic_nll, round(avg(abs(y - mean)) + 0.1 * avg(spread), 6) AS crps_approximation FROM f""")
def mixture_metrics(spark, d):
    x = mixtures(spark, d)
    return x.agg(r6(F.avg(mixture.nll(*parts(), c("y"))), "nll"), r6(metrics.diagnostic_nll(*parts(), c("y")), "diagnostic_nll"), r6(metrics.crps_approximation(*parts(), c("y")), "crps_approximation"))


@query()
def pit_calibration(spark, d):
    x = metrics.calibration(metrics.pit(mixtures(spark, d)))
    return x.select("n", "is_calibrated", *(r6(c(n), n) for n in ("ks_d", "p_value", "sharpness_residual")))


_ATT = "SELECT vec_id, i, embedding[i]::DOUBLE AS x FROM embeddings, range(1, 65) r(i)"


def attributions(spark, d):
    e = F.transform("embedding", lambda x: x.cast("double"))
    rows = lambda a, n, w: F.transform(F.sequence(lit(0), lit(n - 1)), lambda i: F.slice(c("e"), a + i * w, w))
    return t(spark, d, "embeddings").withColumn("e", e).select("vec_id", rows(1, 4, 5).alias("sat"), rows(21, 5, 8).alias("weather"), F.slice("e", 61, 4).alias("soil"))


@query(f"""WITH a AS ({_ATT}), m AS (SELECT vec_id, avg(abs(x)) FILTER (i <= 20) AS s, avg(abs(x)) FILTER (i BETWEEN 21 AND 60) AS w, avg(abs(x)) FILTER (i > 60) AS g FROM a GROUP BY 1) SELECT round(avg(s), 4) AS "Satellite", round(avg(w), 4) AS "Weather", round(avg(g), 4) AS "Soil" FROM m""")
def modality_importance(spark, d):
    return tables.modality_importance(attributions(spark, d))


@query(f"""WITH a AS ({_ATT}) SELECT ((i - 1) // 5)::INT AS step, round(avg(abs(x)), 6) AS importance FROM a WHERE i <= 20 GROUP BY 1""")
def temporal_importance(spark, d):
    return tables.temporal_importance(attributions(spark, d)).select("step", r6(c("importance"), "importance"))


@query(f"""WITH a AS ({_ATT}) SELECT CASE WHEN i <= 60 THEN coalesce(['gdd', 'precip'][(i - 21) % 8 + 1], 'Weather_' || (i - 21) % 8) ELSE coalesce(['ph'][i - 60], 'Soil_' || (i - 61)) END AS feature, round(sum(abs(x)), 4) AS importance FROM a WHERE i > 20 GROUP BY 1""")
def feature_importance(spark, d):
    return tables.feature_importance(attributions(spark, d), ["gdd", "precip"], ["ph"]).select("feature", F.round("importance", 4).alias("importance"))


# ---- helpers and jobs


@query(f"""SELECT o_orderkey, row_number() OVER (ORDER BY {_HASH.format("'42:' || o_orderkey")}, o_orderkey) <= floor((SELECT count(*) FROM orders) * 0.8) AS is_train FROM orders""")
def train_split(spark, d):
    return bias.split(t(spark, d, "orders"), ["o_orderkey"]).select("o_orderkey", "is_train")


@query("""WITH p AS (SELECT p_partkey AS k, p_brand AS b, CASE WHEN p_partkey % 9 <> 0 THEN p_retailprice END AS u, CASE WHEN p_partkey % 11 <> 0 THEN p_size::DOUBLE END AS v, (p_partkey % 13)::DOUBLE AS x FROM part),
d AS (SELECT q.k, o.k AS o, q.u IS NULL AS wants_u, q.v IS NULL AS wants_v, o.u, o.v,
 sqrt(3.0 / (1 + (q.u IS NOT NULL AND o.u IS NOT NULL)::INT + (q.v IS NOT NULL AND o.v IS NOT NULL)::INT) * ((q.x - o.x) ** 2 + coalesce((q.u - o.u) ** 2, 0) + coalesce((q.v - o.v) ** 2, 0))) AS d
 FROM p q JOIN p o ON o.b = q.b AND o.k <> q.k WHERE q.u IS NULL OR q.v IS NULL),
n AS (SELECT k, 'u' AS c, o, u AS y, d FROM d WHERE wants_u AND u IS NOT NULL UNION ALL SELECT k, 'v', o, v, d FROM d WHERE wants_v AND v IS NOT NULL),
r AS (SELECT *, row_number() OVER (PARTITION BY k, c ORDER BY d, o) AS i FROM n),
f AS (SELECT k, c, CASE WHEN min(d) = 0 THEN avg(y) FILTER (d = 0) ELSE sum(y / nullif(d, 0)) / sum(1 / nullif(d, 0)) END AS y FROM r WHERE i <= 5 GROUP BY ALL)
SELECT p.k AS p_partkey, b AS p_brand, round(coalesce(u, (SELECT y FROM f WHERE f.k = p.k AND c = 'u'), (SELECT avg(u) FROM p)), 6) AS price, round(coalesce(v, (SELECT y FROM f WHERE f.k = p.k AND c = 'v'), (SELECT avg(v) FROM p)), 6) AS size, x FROM p""")
def knn_imputation(spark, d):
    p = t(spark, d, "part").select("p_partkey", "p_brand", F.when(c("p_partkey") % 9 != 0, c("p_retailprice")).alias("price"), F.when(c("p_partkey") % 11 != 0, c("p_size").cast("double")).alias("size"), (c("p_partkey") % 13).cast("double").alias("x"))
    return impute.impute(p, ["price", "size", "x"], "p_partkey", block="p_brand").select("p_partkey", "p_brand", r6(c("price"), "price"), r6(c("size"), "size"), "x")


@query(ORACLES["linear_interpolation"].replace("SELECT event_id, round(", "SELECT event_id, user_id, ts, round("))
def time_series_imputation(spark, d):
    e = gappy(spark, d).select("event_id", "user_id", "ts", "v")
    return impute.impute(e, ["v"], "event_id", ["user_id"], ["ts", "event_id"]).withColumn("v", F.round("v", 6))


@query(f"""WITH l AS ({ORACLES["linear_interpolation"].replace("FROM events),", "FROM events WHERE user_id % 25 <> 0),").replace("SELECT event_id, round(", "SELECT event_id, (").replace(", 6) AS v FROM y", ") AS v FROM y")}),
e AS (SELECT event_id, hour(ts) AS h, v FROM events LEFT JOIN l USING (event_id)),
d AS (SELECT h, avg(v) AS m FROM (SELECT h, v, row_number() OVER (PARTITION BY h ORDER BY event_id) AS r FROM e WHERE v IS NOT NULL) WHERE r <= 5 GROUP BY 1)
SELECT event_id, round(coalesce(v, m), 6) AS v FROM e LEFT JOIN d USING (h)""")
def series_then_neighbours(spark, d):
    """Every 25th series has no value at all, so its rows take the nearest rows' by hour; of equal distances the lowest ids'."""
    e = gappy(spark, d).select("event_id", "user_id", "ts", F.when(c("user_id") % 25 != 0, c("v")).alias("v"), F.hour("ts").cast("double").alias("h"))
    x = impute.interpolate(e, ["user_id"], ["ts", "event_id"], ["v"])
    return impute.knn_impute(x, ["v", "h"], "event_id").select("event_id", r6(c("v"), "v"))


@query("""WITH x AS (SELECT event_id, user_id, ts, value + 1 AS precip, greatest((least(greatest(value / 10 + 20, 10), 35) + least(greatest(value / 10, 10), 35)) / 2 - 10, 0) AS gdd FROM events)
SELECT event_id, round(gdd, 6) AS gdd, round(sum(precip) OVER w, 4) AS accumulated_precip, round(sum(gdd) OVER w, 4) AS accumulated_gdd FROM x WINDOW w AS (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING)""")
def weather_totals(spark, d):
    return rain_features(spark, d).select("event_id", r6(c("gdd"), "gdd"), F.round("accumulated_precip", 4).alias("accumulated_precip"), F.round("accumulated_gdd", 4).alias("accumulated_gdd"))


@query(f"""WITH i AS ({_spi_sql("SELECT event_id, user_id, ts AS o, value + 1 AS precip FROM events", "user_id", "precip")}),
x AS (SELECT event_id, user_id, ts, value + 1 AS precip, greatest((least(greatest(value / 10 + 20, 10), 35) + least(greatest(value / 10, 10), 35)) / 2 - 10, 0) AS gdd FROM events)
SELECT event_id, round(gdd, 6) AS gdd, round(sum(precip) OVER w, 4) AS accumulated_precip, round(sum(gdd) OVER w, 4) AS accumulated_gdd, spi, spi_status FROM x JOIN i USING (event_id) WINDOW w AS (PARTITION BY x.user_id ORDER BY ts ROWS UNBOUNDED PRECEDING)""")
def weather_features(spark, d):
    x = rain_features(spark, d)
    return x.select("event_id", r6(c("gdd"), "gdd"), F.round("accumulated_precip", 4).alias("accumulated_precip"), F.round("accumulated_gdd", 4).alias("accumulated_gdd"), r6(c("spi"), "spi"), "spi_status")


def rain_features(spark, d):
    e = t(spark, d, "events").select("event_id", c("user_id").cast("string").alias("site"), c("ts").alias("time"), (c("value") / 10 + 20).alias("t_max"), (c("value") / 10).alias("t_min"), (c("value") + 1).alias("precip"))
    return jobs.weather_features(e, ["site"])


def event_inputs(spark, d):
    e = t(spark, d, "events").withColumn("day", F.date_trunc("day", "ts"))
    m = series.daily_mean(e.withColumn("w", F.hour("ts").cast("double")), ["user_id"], "ts", ["value", "w"])
    w = series.last_of_year(m, ["user_id"], "day", ["value", "w"], "day", 6).filter("status = 'ok'")
    return align.split_features(w, 1, "matrix").select(c("user_id").cast("string").alias("site"), "year", "sat", "weather", F.array(lit(6.5), lit(1.8)).alias("soil"))


@query(f"""WITH m AS (SELECT user_id, date_trunc('day', ts) AS day, avg(value) AS v, avg(hour(ts)) AS w FROM events GROUP BY ALL),
l AS (SELECT *, year(day) AS year, row_number() OVER (PARTITION BY user_id, year(day) ORDER BY day DESC) AS r, count(*) OVER (PARTITION BY user_id, year(day)) AS n FROM m),
i AS (SELECT user_id, year, avg(v) AS a, avg(w) AS b FROM l WHERE r <= 6 AND n >= 6 GROUP BY ALL),
z AS (SELECT user_id, year, unnest([a, b / 100, 4.15 / 10]) AS z, unnest([3 + tanh(a), 3 + tanh(b / 50), 3 + tanh(4.15 / 5)]) AS mu, unnest([1, 2, 3]) AS k FROM i),
p AS (SELECT *, exp(z - max(z) OVER q) / sum(exp(z - mz)) OVER q AS pi, 0.2 + 0.1 * abs(tanh(z)) AS sigma FROM (SELECT *, max(z) OVER (PARTITION BY user_id, year) AS mz FROM z) WINDOW q AS (PARTITION BY user_id, year)),
g AS (SELECT user_id, year, sum(pi * mu) AS mean, sqrt(greatest(sum(pi * (sigma * sigma + mu * mu)) - sum(pi * mu) ** 2, 1e-6)) AS s, sum(pi * sigma) AS spread, list(struct_pack(x := -pi, k := k, mu := mu) ORDER BY pi DESC, k) FILTER (pi >= 0.2) AS modes FROM p GROUP BY ALL),
f AS (SELECT user_id, year, s, CASE WHEN len(modes) >= 2 AND abs(modes[1].mu - modes[2].mu) / (spread + 1e-8) >= 1.5 THEN modes[1].mu ELSE mean END AS p FROM g),
h AS (SELECT user_id, avg(value / 50) AS a, arg_max(value / 50, (ts, value)) AS y FROM events WHERE user_id % 7 <> 0 GROUP BY 1),
j AS (SELECT f.user_id, f.year, s, a, y, CASE WHEN p > 0 AND p < 15 THEN p END AS p FROM f LEFT JOIN h USING (user_id)),
x AS (SELECT *, CASE WHEN p IS NULL THEN NULL WHEN a IS NULL OR a = 0 THEN 'Unknown' ELSE {TIER_SQL} END AS tier FROM j)
SELECT user_id::VARCHAR AS site, year, CASE WHEN p IS NULL THEN 'implausible' ELSE 'ok' END AS status, round(p, 6) AS predicted_yield, round(greatest(0, p - 1.96 * s), 6) AS lower_bound, round(p + 1.96 * s, 6) AS upper_bound, round(s, 6) AS std, {UP_SQL} AS risk,
array_to_string(list_filter(['{_QUOTED["Satellite"].replace("{}", "50")}', CASE WHEN (p + 1.96 * s - greatest(0, p - 1.96 * s)) / p > 0.4 THEN '{risk.VOLATILE_ADVICE}' END], lambda v: v IS NOT NULL), '|') AS advice, round(y, 6) AS observed_yield, round(a, 6) AS historical_avg FROM x""")
def batch_forecast(spark, d):
    """Every seventh site has no history."""
    e = t(spark, d, "events").filter("user_id % 7 <> 0").select(c("user_id").cast("string").alias("site"), F.year("ts").alias("year"), c("ts").alias("time"), (c("value") / 50).alias("yield"))
    h = tables.site_history(e, "site", "year", "time", "yield")
    out = jobs.forecast(event_inputs(spark, d).withColumns({"a": lit(0.5), "w": lit(0.3), "g": lit(0.2)}), h, score.stand_in_scorer, ("a", "w", "g"))
    n = ["predicted_yield", "lower_bound", "upper_bound", "std", "observed_yield", "historical_avg"]
    return out.withColumns({k: F.round(k, 6) for k in n}).select("site", c("year").cast("long").alias("year"), "status", *n, "risk", F.array_join("advice", "|").alias("advice"))


@query("""WITH e AS (SELECT user_id, ts, value / 100 AS r, hour(ts) AS n, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS i, count(*) OVER (PARTITION BY user_id) AS k FROM events),
w AS (SELECT user_id, k, round(sum((n - r) / CASE WHEN n + r = 0 THEN 1e-6 ELSE n + r END) FILTER (i <= 60), 6) AS s FROM e GROUP BY ALL), y AS (SELECT unnest([2023, 2024]) AS year)
SELECT user_id, y.year::BIGINT AS year, CASE WHEN y.year = 2023 THEN 'no satellite features' WHEN k < 60 THEN 'satellite: ' || k || ' rows, need at least 60' ELSE 'ok' END AS input_status,
CASE WHEN y.year = 2024 AND k >= 60 THEN s END AS ndvi, CASE WHEN user_id % 2 = 0 THEN 'MISSING → zero-vector' ELSE 'file:' || user_id || '_soil.csv' END AS soil_source FROM w, y""")
def live_inputs(spark, d):
    """One cell per user; soil of every other one."""
    e = t(spark, d, "events").select(c("user_id").alias("site"), c("ts").alias("time"), lit(1.0).alias("lat"), lit(2.0).alias("lon"), (c("value") / 100).alias("B04"), F.hour("ts").cast("double").alias("B08"))
    areas = e.select("site", lit(1.2).alias("lat"), lit(1.9).alias("lon")).distinct()
    years = areas.select("site", F.explode(F.array(lit(2023), lit(2024))).alias("year"))
    soil = areas.filter("site % 2 = 1").select("site", lit(6.5).alias("ph"))
    x = jobs.live_inputs(areas, years, e, e.withColumn("rain", c("B04")), soil, ["B04", "B08"], ["rain"], ["ph"], 2, 60)
    return x.select(c("site").alias("user_id"), c("year").cast("long").alias("year"), "input_status", F.round(mixture.total(c("ndvi_series")), 6).alias("ndvi"), "soil_source")


def _estimate(sat: str, wea: str, soil: str) -> str:
    """The stand-in model's mean."""
    parts = [(sat, sat), (f"{wea} / 100", f"{wea} / 50"), (f"{soil} / 10", f"{soil} / 5")]
    return f"(({' + '.join(f'exp({z}) * (3 + tanh({m}))' for z, m in parts)}) / ({' + '.join(f'exp({z})' for z, _ in parts)}))"


_SHARES = {"Satellite": "a1", "Weather": "a2", "Soil": "a3"}


@query(f"""WITH e AS (SELECT user_id, ts, value / 400 + CASE WHEN user_id % 3 = 0 THEN 1.5 ELSE 0 END AS r, value / 200 AS n, value / 10 + CASE WHEN user_id % 3 = 1 THEN 90 ELSE 0 END AS rain,
row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS i, count(*) OVER (PARTITION BY user_id) AS k FROM events),
w AS (SELECT user_id, any_value(k) AS k, avg((r + n) / 2) AS s, avg(rain) AS w, CASE WHEN user_id % 5 = 0 THEN 0 WHEN user_id % 3 = 2 THEN 20 ELSE 4 END / 2 AS g, sum((n - r) / CASE WHEN n + r = 0 THEN 1e-6 ELSE n + r END) AS ndvi FROM e WHERE i <= 60 GROUP BY 1),
i AS (SELECT user_id, 2024 AS year, s, w, g, ndvi FROM w WHERE k >= 60), b AS (SELECT avg(s) AS s0, avg(w) AS w0, avg(g) AS g0 FROM i),
v AS (SELECT i.*, abs({_estimate("s", "w", "g")} - {_estimate("s0", "w", "g")}) AS d1, abs({_estimate("s", "w", "g")} - {_estimate("s", "w0", "g")}) AS d2, abs({_estimate("s", "w", "g")} - {_estimate("s", "w", "g0")}) AS d3 FROM i, b),
u AS (SELECT *, round(d1 / (d1 + d2 + d3), 4) AS a1, round(d2 / (d1 + d2 + d3), 4) AS a2, round(d3 / (d1 + d2 + d3), 4) AS a3 FROM v),
z AS (SELECT user_id, unnest([s, w / 100, g / 10]) AS z, unnest([3 + tanh(s), 3 + tanh(w / 50), 3 + tanh(g / 5)]) AS mu, unnest([1, 2, 3]) AS k FROM u),
p AS (SELECT *, exp(z) / sum(exp(z)) OVER (PARTITION BY user_id) AS pi, 0.2 + 0.1 * abs(tanh(z)) AS sigma FROM z),
g AS (SELECT user_id, sum(pi * mu) AS mean, sqrt(greatest(sum(pi * (sigma * sigma + mu * mu)) - sum(pi * mu) ** 2, 1e-6)) AS s, sum(pi * sigma) AS spread, list(struct_pack(x := -pi, k := k, mu := mu) ORDER BY pi DESC, k) FILTER (pi >= 0.2) AS modes FROM p GROUP BY 1),
f AS (SELECT user_id, s, len(modes) >= 2 AND abs(modes[1].mu - modes[2].mu) / (spread + 1e-8) >= 1.5 AS two, CASE WHEN len(modes) >= 2 AND abs(modes[1].mu - modes[2].mu) / (spread + 1e-8) >= 1.5 THEN modes[1].mu ELSE mean END AS p FROM g),
h AS (SELECT user_id, avg(value / 50) AS a, arg_max(value / 50, (ts, value)) AS y FROM events WHERE user_id % 7 <> 0 GROUP BY 1),
q AS (SELECT w.user_id, years.year, w.k, h.a, CASE WHEN years.year = 2024 THEN h.y END AS y, f.s, f.p, f.two, u.a1, u.a2, u.a3, u.ndvi FROM w CROSS JOIN (SELECT unnest([2023, 2024]) AS year) years LEFT JOIN u ON u.user_id = w.user_id AND u.year = years.year LEFT JOIN f ON f.user_id = u.user_id LEFT JOIN h ON h.user_id = w.user_id),
x AS (SELECT *, CASE WHEN p IS NULL THEN NULL WHEN a IS NULL OR a = 0 THEN 'Unknown' ELSE {TIER_SQL} END AS tier FROM q)
SELECT user_id, year::BIGINT AS year, CASE WHEN p IS NULL THEN 'no input' ELSE 'ok' END AS status, CASE WHEN year = 2023 THEN 'no satellite features' WHEN k < 60 THEN 'satellite: ' || k || ' rows, need at least 60' ELSE 'ok' END AS input_status,
CASE WHEN user_id % 5 = 0 THEN 'MISSING → zero-vector' ELSE 'file:' || user_id || '_soil.csv' END AS soil_source, CASE WHEN user_id % 5 = 0 THEN 'no soil row' ELSE '' END AS soil_warnings, round(CASE WHEN p IS NOT NULL THEN ndvi END, 6) AS ndvi,
round(p, 6) AS predicted_yield, round(CASE WHEN p IS NOT NULL THEN greatest(0, p - 1.96 * s) END, 6) AS lower_bound, round(p + 1.96 * s, 6) AS upper_bound, round(s, 6) AS std, {UP_SQL} AS risk, two AS is_bimodal, a1 AS satellite, a2 AS weather, a3 AS soil_share,
CASE WHEN p IS NOT NULL THEN array_to_string(list_filter([CASE WHEN a1 >= a2 AND a1 >= a3 THEN format('{_QUOTED["Satellite"]}', CAST(round_even(a1 * 100, 0) AS INT)) WHEN a2 >= a3 THEN format('{_QUOTED["Weather"]}', CAST(round_even(a2 * 100, 0) AS INT)) ELSE format('{_QUOTED["Soil"]}', CAST(round_even(a3 * 100, 0) AS INT)) END,
CASE WHEN (p + 1.96 * s - greatest(0, p - 1.96 * s)) / p > 0.4 THEN '{risk.VOLATILE_ADVICE}' END], lambda l: l IS NOT NULL), '|') END AS advice, round(y, 6) AS observed_yield, round(a, 6) AS historical_avg FROM x""")
def store_forecast(spark, d):
    """From features to answers: ready, short and absent inputs, soil of four in five sites, yields of six in seven."""
    e = t(spark, d, "events").select(c("user_id").alias("site"), c("ts").alias("time"), lit(1.0).alias("lat"), lit(2.0).alias("lon"), "value")
    sat = e.select("site", "time", "lat", "lon", (c("value") / 400 + F.when(c("site") % 3 == 0, 1.5).otherwise(0.0)).alias("B04"), (c("value") / 200).alias("B08"))
    rain = e.select("site", "time", "lat", "lon", (c("value") / 10 + F.when(c("site") % 3 == 1, 90.0).otherwise(0.0)).alias("rain"))
    areas = e.select("site", lit(1.2).alias("lat"), lit(1.9).alias("lon")).distinct()
    years = areas.select("site", F.explode(F.array(lit(2023), lit(2024))).alias("year"))
    soil = areas.filter("site % 5 <> 0").select("site", F.when(c("site") % 3 == 2, 20.0).otherwise(4.0).alias("ph"))
    yields = e.filter("site % 7 <> 0").select("site", F.year("time").alias("year"), "time", (c("value") / 50).alias("yield"))
    x = jobs.store_forecast(areas, years, sat, rain, soil, yields, score.stand_in_scorer, ["B04", "B08"], ["rain"], ["ph"], 2, 60)
    n = ["predicted_yield", "lower_bound", "upper_bound", "std", "observed_yield", "historical_avg"]
    shares = [c(f"attribution.{k}").alias(v) for k, v in (("Satellite", "satellite"), ("Weather", "weather"), ("Soil", "soil_share"))]
    return x.select(
        c("site").alias("user_id"), c("year").cast("long").alias("year"), "status", "input_status", "soil_source", F.array_join("soil_warnings", ",").alias("soil_warnings"), F.round(F.when(c("pi").isNotNull(), mixture.total(c("ndvi_series"))), 6).alias("ndvi"),
        *(F.round(k, 6).alias(k) for k in n), "risk", c("report.is_bimodal").alias("is_bimodal"), *shares, F.array_join("advice", "|").alias("advice"),
    )


def evaluated(spark, d):
    return jobs.evaluate(mixtures(spark, d))


_PHI = _phi("z")
_PIT = f"{_MIX}, phi AS (SELECT vec_id, p, (y - m) / s AS z FROM u), pit AS (SELECT vec_id, sum(p * {_PHI}) AS pit FROM phi GROUP BY 1)"


@query(_PIT + " SELECT vec_id, round(pit, 6) AS pit FROM pit")
def pit_values(spark, d):
    return metrics.pit(mixtures(spark, d)).select("vec_id", r6(c("pit"), "pit"))


_CALIBRATED = _PIT + """, r AS (SELECT pit, row_number() OVER (ORDER BY pit) AS i, count(*) OVER () AS n FROM pit),
k AS (SELECT greatest(max(i / n - pit), max(pit - (i - 1) / n)) AS ks_d, abs(stddev_pop(pit) - 0.288) AS sharpness_residual FROM r),
h AS (SELECT *, round(2 * list_sum(list_transform(range(1, 101), lambda j: CASE WHEN j % 2 = 1 THEN 1 ELSE -1 END * exp(-2.0 * j * j * ks_d * ks_d * n))), 6) AS p_value FROM k, (SELECT count(*) AS n FROM pit))"""
ORACLES["pit_calibration"] = _CALIBRATED + " SELECT n, p_value > 0.05 AS is_calibrated, round(ks_d, 6) AS ks_d, p_value, round(sharpness_residual, 6) AS sharpness_residual FROM h"


@query(_CALIBRATED + """ SELECT round(avg(abs(mean - y)), 4) AS mae, round(sqrt(avg((mean - y) ** 2)), 4) AS rmse, round(1 - sum((mean - y) ** 2) / (var_pop(y) * count(*)), 4) AS r2, round(avg(abs((y - mean) / (y + 1e-10))) * 100, 2) AS mape, round(avg(mean - y), 4) AS mean_bias,
round(avg(CASE WHEN abs(y - mean) <= 1.96 * std THEN 1.0 ELSE 0 END), 6) AS calibration_95, count(*) AS num_samples, round(-avg(wl), 6) AS diagnostic_nll, round(avg(abs(y - mean)) + 0.1 * avg(spread), 6) AS crps_approximation, round(avg(nll), 6) AS nll,
round(any_value(ks_d), 6) AS ks_d, any_value(p_value) AS p_value, any_value(p_value) > 0.05 AS is_calibrated, round(any_value(sharpness_residual), 6) AS sharpness_residual FROM f, h""")
def evaluate_mixtures(spark, d):
    """Every number of the evaluation. The distance is far beyond what the exact law is used for, so Kolmogorov's series gives p."""
    x = evaluated(spark, d)
    six = ("calibration_95", "diagnostic_nll", "crps_approximation", "nll", "ks_d", "sharpness_residual", "p_value")
    return x.select("mae", "rmse", "r2", "mape", "mean_bias", "num_samples", "is_calibrated", *(r6(c(n), n) for n in six))


@query(_PIT + """, r AS (SELECT pit, row_number() OVER (ORDER BY pit) AS i, count(*) OVER () AS n FROM pit),
k AS (SELECT greatest(max(i / n - pit), max(pit - (i - 1) / n)) AS ks_d, abs(stddev_pop(pit) - 0.288) AS sharpness_residual FROM r)
SELECT round(avg(abs(mean - y)), 4) AS mae, round(sqrt(avg((mean - y) ** 2)), 4) AS rmse, round(1 - sum((mean - y) ** 2) / (var_pop(y) * count(*)), 4) AS r2, round(avg(mean - y), 4) AS mean_bias,
round(avg(CASE WHEN abs(y - mean) <= 1.96 * std THEN 1.0 ELSE 0 END), 6) AS calibration_95, count(*) AS num_samples, round(-avg(wl), 6) AS diagnostic_nll, round(avg(abs(y - mean)) + 0.1 * avg(spread), 6) AS crps_approximation, round(avg(nll), 6) AS nll,
round(any_value(ks_d), 6) AS ks_d, round(any_value(sharpness_residual), 6) AS sharpness_residual FROM f, k""")
def evaluation_metrics(spark, d):
    """What SQL can express of the evaluation: all but the p-value."""
    x = evaluated(spark, d)
    return x.select("mae", "rmse", "r2", "mean_bias", "num_samples", *(r6(c(n), n) for n in ("calibration_95", "diagnostic_nll", "crps_approximation", "nll", "ks_d", "sharpness_residual")))


@query("""WITH y AS (SELECT o_custkey AS site, year(o_orderdate) AS year, arg_max(o_totalprice, (o_orderdate, o_totalprice)) AS v FROM orders WHERE o_custkey % 5 <> 0 GROUP BY ALL),
a AS (SELECT o_custkey AS site, avg(o_totalprice) AS a FROM orders WHERE o_custkey % 5 <> 0 GROUP BY 1), k AS (SELECT c_custkey AS site, unnest(range(1992, 2004)) AS year FROM customer)
SELECT k.site, k.year, round(v, 4) AS observed_yield, round(a, 6) AS historical_avg, k.site % 3 <> 0 AND k.site % 4 <> 0 AND k.year > 1993 AND k.site % 11 <> 0 AS live_ready,
CASE WHEN k.site % 11 = 0 THEN 'too few timesteps' WHEN k.site % 3 = 0 THEN 'Missing processed feature store for this region' WHEN k.site % 4 = 0 THEN 'Missing trained checkpoint' WHEN k.year <= 1993 THEN 'Processed features do not cover ' || k.year ELSE 'Ready for live inference' END AS status
FROM k LEFT JOIN y USING (site, year) LEFT JOIN a USING (site)""")
def region_context(spark, d):
    """Every fifth site has no history at all, and all have years without a harvest."""
    y = t(spark, d, "orders").filter("o_custkey % 5 <> 0").select(c("o_custkey").alias("site"), F.year("o_orderdate").cast("long").alias("year"), "o_orderdate", "o_totalprice")
    areas = t(spark, d, "customer").select(c("c_custkey").alias("site"))
    h = tables.site_history(y, "site", "year", "o_orderdate", "o_totalprice")
    years = areas.select("site", F.explode(F.sequence(lit(1992).cast("long"), lit(2003).cast("long"))).alias("year"))
    error = F.when(c("site") % 11 == 0, "too few timesteps")
    live = years.select("site", "year", (c("site") % 3 != 0).alias("has_store"), (c("site") % 4 != 0).alias("has_model"), error.alias("live_error"), (c("year") > 1993).alias("covers_year"))
    return jobs.region_context(areas, years, h, live).select("site", "year", F.round("observed_yield", 4).alias("observed_yield"), r6(c("historical_avg"), "historical_avg"), "live_ready", "status")


SIXTH = 0.5235987755982988  # a factor without a short decimal form: rounded results have no ties


def line_grids(spark, d):
    x = t(spark, d, "lineitem")
    red = c("l_discount") * SIXTH
    place = [c("l_returnflag").alias("site"), c("l_shipdate").alias("time")]
    sat = x.select(*place, c("l_linenumber").cast("double").alias("lat"), (c("l_suppkey") % 5).cast("double").alias("lon"), (red / 2).alias("B02"), red.alias("B03"), red.alias("B04"), ((c("l_tax") + 0.2) * SIXTH).alias("B08"), (c("l_orderkey") % 6 + 3).cast("int").alias("SCL"))
    rain = x.select(*place, (c("l_linenumber") % 3 * 3 + 1).cast("double").alias("lat"), (c("l_suppkey") % 3 * 2).cast("double").alias("lon"), c("l_quantity").alias("t_max"), (c("l_quantity") - 8).alias("t_min"), (c("l_tax") * 100).alias("precip"))
    return sat, rain


def _hermite(c: str) -> str:
    """CTEs that fill column {c} of x (cell, t, i, {c}) by PCHIP, at most five rows into a gap, as f_{c} (cell, i, v)."""
    w = "WINDOW w AS (PARTITION BY cell ORDER BY t)"
    return f"""g_{c} AS (SELECT cell, t, min(i) AS i, arg_min({c}, i) FILTER ({c} IS NOT NULL) AS y FROM x GROUP BY ALL),
k_{c} AS (SELECT cell, t, i, t AS x0, y AS y0, lead(t) OVER w AS x1, lead(y) OVER w AS y1, lag(t) OVER w AS xp, lag(y) OVER w AS yp FROM g_{c} WHERE y IS NOT NULL {w}),
s_{c} AS (SELECT *, x1 - x0 AS h, (y1 - y0) / (x1 - x0) AS s, x0 - xp AS hp, (y0 - yp) / (x0 - xp) AS sp FROM k_{c}),
n_{c} AS (SELECT *, lead(h) OVER w AS hn, lead(s) OVER w AS sn, lag(hp) OVER w AS hq, lag(sp) OVER w AS sq FROM s_{c} {w}),
d_{c} AS (SELECT *, CASE WHEN hp IS NULL THEN CASE WHEN hn IS NULL THEN s ELSE {_end_slope("h", "hn", "s", "sn")} END WHEN h IS NULL THEN CASE WHEN hq IS NULL THEN sp ELSE {_end_slope("hp", "hq", "sp", "sq")} END
WHEN s * sp > 0 THEN (3 * h + 3 * hp) / ((2 * h + hp) / sp + (h + 2 * hp) / s) ELSE 0 END AS d FROM n_{c}),
e_{c} AS (SELECT *, lead(d) OVER (PARTITION BY cell ORDER BY t) AS d1 FROM d_{c}),
f_{c} AS (SELECT x.cell, x.i, CASE WHEN x.{c} IS NOT NULL THEN x.{c} WHEN e.t = x.t THEN e.y0 WHEN e.t IS NOT NULL AND x1 IS NOT NULL AND x.i - e.i <= 5 THEN
(1 + 2 * u(x.t)) * (1 - u(x.t)) ** 2 * y0 + u(x.t) * (1 - u(x.t)) ** 2 * h * d + u(x.t) ** 2 * (3 - 2 * u(x.t)) * y1 + u(x.t) ** 2 * (u(x.t) - 1) * h * d1 ELSE 0 END AS v
FROM x ASOF LEFT JOIN e_{c} e ON x.cell = e.cell AND x.t >= e.t)""".replace("u(x.t)", "((x.t - x0) / h)")


def _axis(c: str) -> str:
    """Corners and shares of the fine values of an axis between the coarse ones."""
    return f"""c_{c} AS (SELECT site, a, lead(a) OVER (PARTITION BY site ORDER BY a) AS b FROM (SELECT DISTINCT site, {c} AS a FROM rain)),
w_{c} AS (SELECT site, {c}, a AS corner, CASE WHEN b IS NULL THEN 1 ELSE 1 - ({c} - a) / (b - a) END AS w FROM (SELECT DISTINCT site, {c} FROM sat) JOIN c_{c} USING (site) WHERE {c} >= a AND ({c} < b OR (b IS NULL AND {c} = a))
UNION ALL SELECT site, {c}, b, ({c} - a) / (b - a) FROM (SELECT DISTINCT site, {c} FROM sat) JOIN c_{c} USING (site) WHERE {c} > a AND {c} < b)"""


_GRIDS = f"""WITH raw AS (SELECT l_returnflag AS site, l_linenumber::DOUBLE AS lat, (l_suppkey % 5)::DOUBLE AS lon, l_shipdate::TIMESTAMP AS day, l_discount * {SIXTH} AS p, (l_tax + 0.2) * {SIXTH} AS q, l_orderkey % 6 + 3 IN (4, 5, 6) AS clear FROM lineitem),
x AS (SELECT {{'s': site, 'a': lat, 'o': lon}} AS cell, day, epoch(day) AS t, CASE WHEN clear THEN p END AS p, CASE WHEN clear THEN q END AS q,
row_number() OVER (PARTITION BY site, lat, lon ORDER BY day, CASE WHEN clear THEN p END NULLS FIRST, CASE WHEN clear THEN q END NULLS FIRST) AS i FROM raw),
{_hermite("p")},
{_hermite("q")},
sat AS (SELECT x.cell.s AS site, x.cell.a AS lat, x.cell.o AS lon, day, arg_min({{'p': fp.v, 'q': fq.v}}, {{'p': fp.v, 'q': fq.v}}) AS v FROM x JOIN f_p fp USING (cell, i) JOIN f_q fq USING (cell, i) GROUP BY ALL),
rain AS (SELECT l_returnflag AS site, l_shipdate::TIMESTAMP AS day, (l_linenumber % 3 * 3 + 1)::DOUBLE AS lat, (l_suppkey % 3 * 2)::DOUBLE AS lon, avg(l_quantity) AS t_max, avg(l_quantity - 8) AS t_min, avg(l_tax * 100) AS precip FROM lineitem GROUP BY ALL),
{_axis("lat")},
{_axis("lon")},
parts AS (SELECT y.site, y.lat, z.lon, r.day, y.w * z.w AS w, t_max, t_min, precip FROM w_lat y JOIN w_lon z ON z.site = y.site JOIN rain r ON r.site = y.site AND r.lat = y.corner AND r.lon = z.corner WHERE y.w > 0 AND z.w > 0),
wet AS (SELECT site, lat, lon, day, sum(w * t_max) AS t_max, sum(w * t_min) AS t_min, sum(w * precip) AS precip FROM parts GROUP BY ALL HAVING abs(sum(w) - 1) < 1e-9),
quality AS (SELECT site, avg(clear::INT) AS valid_ratio FROM raw GROUP BY 1),
grids AS (SELECT site, lat, lon, day, sat.v.p AS p, sat.v.q AS q, coalesce(t_max, 0) AS t_max, coalesce(t_min, 0) AS t_min, coalesce(precip, 0) AS precip FROM sat LEFT JOIN wet USING (site, lat, lon, day))"""


@query(_GRIDS + """ SELECT site, day, lat, lon, round(p / 2, 8) AS "B02", round(p, 8) AS "B03", round(p, 8) AS "B04", round(q, 8) AS "B08", round(t_max, 8) AS t_max, round(t_min, 8) AS t_min, round(precip, 8) AS precip,
round(valid_ratio, 9) AS valid_ratio, valid_ratio < 0.1 AS is_unreliable FROM grids JOIN quality USING (site)""")
def preprocess_grids(spark, d):
    sat, rain, quality = jobs.preprocess(*line_grids(spark, d))
    x = sat.join(rain, ["site", "day", "lat", "lon"]).join(quality, "site")
    values = [F.round(n, 8).alias(n) for n in (*jobs.BANDS, *jobs.RAIN)]
    return x.select("site", "day", "lat", "lon", *values, F.round("valid_ratio", 9).alias("valid_ratio"), "is_unreliable")


@query(_GRIDS + f""", lab AS (SELECT l_returnflag AS site, date_trunc('year', l_shipdate)::TIMESTAMP AS time, avg(l_extendedprice) AS y, count(*) OVER () AS n FROM lineitem GROUP BY ALL),
h AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY day) AS i, count(*) OVER (PARTITION BY site) AS size FROM grids WHERE lat = 3 AND lon = 2),
j AS (SELECT lab.site, lab.time, any_value(y) AS y, any_value(n) AS n, count(*) FILTER (h.day <= lab.time) AS past, max(size) AS size FROM lab JOIN h USING (site) GROUP BY ALL),
w AS (SELECT j.site, j.time, any_value(y) AS y, any_value(n) AS n, any_value(past) AS past, sum(2.5 * p + q) AS sat, sum(t_max + t_min + precip) AS weather FROM j JOIN h ON h.site = j.site AND j.size >= 12
AND CASE WHEN past >= 12 THEN i > past - 12 AND i <= past ELSE i <= 12 END GROUP BY ALL),
soil AS (SELECT l_returnflag AS site, avg(l_tax) AS ph, avg(l_discount) AS soc FROM lineitem GROUP BY 1)
SELECT site, time, round(y, 4) AS "yield", CASE WHEN past >= 12 THEN 'recent' ELSE 'first' END AS window_source, round(sat, 4) AS sat, round(weather, 4) AS weather, round(ph + soc, 6) AS soil, 'file:' || site || '_soil.csv' AS soil_source,
row_number() OVER (ORDER BY {_HASH.format("'42:' || site || ':' || strftime(time, '%Y-%m-%d %H:%M:%S')")}) <= floor(count(*) OVER () * 0.8) AS is_train FROM w JOIN soil USING (site)""")
def build_training_set(spark, d):
    labels = t(spark, d, "lineitem").groupBy(c("l_returnflag").alias("site"), F.date_trunc("year", "l_shipdate").alias("time")).agg(lit(3.2).alias("lat"), lit(1.6).alias("lon"), F.avg("l_extendedprice").alias("yield"))
    raw, weather = line_grids(spark, d)
    sat, rain, _ = jobs.preprocess(raw, weather, jobs.needed_cells(labels, raw))
    soil = t(spark, d, "lineitem").groupBy(c("l_returnflag").alias("site")).agg(F.avg("l_tax").alias("ph"), F.avg("l_discount").alias("soc"))
    x = jobs.training_set(labels, sat, rain, soil, jobs.BANDS, jobs.RAIN, ["ph", "soc"], 4, grid=raw)
    sums = {"sat": mixture.total(F.flatten("sat")), "weather": mixture.total(F.flatten("weather"))}
    return x.select("site", "time", F.round("yield", 4).alias("yield"), "window_source", *(F.round(v, 4).alias(k) for k, v in sums.items()), F.round(mixture.total(c("soil")), 6).alias("soil"), "soil_source", "is_train")


@query()
def clean_records(spark, d):
    p = t(spark, d, "part").select("p_partkey", F.when(c("p_partkey") % 9 != 0, c("p_retailprice")).alias("price"), F.when(c("p_partkey") % 11 != 0, c("p_size").cast("double")).alias("size"))
    return jobs.clean_records(p, ["price", "size"], "p_partkey")


# ---- files


@query("""SELECT user_id::VARCHAR AS site, round(value, 4) AS v, event_id FROM events WHERE user_id % 4 <> 1 UNION ALL SELECT user_id::VARCHAR, -1, event_id FROM events WHERE user_id % 4 = 1""")
def io_feature_store(spark, d):
    """One folder a site; a second write replaces only the sites that it holds; long axis names are shortened at reading."""
    path = io.scratch(spark, "features")
    e = t(spark, d, "events").select((c("user_id") % 40).cast("string").alias("folder"), c("user_id").cast("string").alias("site"), F.round("value", 4).alias("v"), "event_id")
    io.write_features(e.withColumnRenamed("v", "latitude"), path, "folder")
    again = e.withColumn("v", F.when(c("site").cast("long") % 4 == 1, lit(-1.0)).otherwise(c("v"))).filter("cast(folder AS long) % 4 = 1")
    io.write_features(again.withColumnRenamed("v", "latitude"), path, "folder")
    return io.read_grid(spark, path).select("site", c("lat").alias("v"), "event_id")


@query("""WITH m AS (SELECT user_id, date_trunc('day', ts)::TIMESTAMP AS day, avg(value) AS v, max(hour(ts)) AS h FROM events GROUP BY ALL)
SELECT user_id, day, round(v, 6) AS sat, h::DOUBLE AS rain, round(avg(v) OVER (PARTITION BY user_id ORDER BY day ROWS 2 PRECEDING), 6) AS mean3 FROM m WHERE year(day) = 2024""")
def feature_store_join(spark, d):
    """Two bucketed feature tables, joined by cell and day and windowed by cell without a shuffle; one year's folders are read."""
    e = t(spark, d, "events").withColumn("day", F.date_trunc("day", "ts"))
    m = e.groupBy(c("user_id").alias("site"), lit(1.0).alias("lat"), lit(2.0).alias("lon"), "day").agg(F.avg("value").alias("v"), F.max(F.hour("ts")).cast("double").alias("h"))
    names = [f"features_{uuid.uuid4().hex}" for _ in range(2)]
    for name, column in zip(names, ("v", "h")):
        io.save_features(m.select("site", "lat", "lon", "day", column), name, io.scratch(spark, "bucketed"), "day", 8)
    io.co_located(spark)
    a, b = (spark.table(n).filter("year = 2024").drop("year") for n in names)
    x = align.stack_features(a, b, ["site", "cell", "day"], ["v"], ["h"])
    w = Window.partitionBy("site", "cell").orderBy("day").rowsBetween(-2, 0)
    f = c("features")
    return x.withColumn("mean3", F.avg(f[0]).over(w)).select(c("site").alias("user_id"), "day", r6(f[0], "sat"), f[1].alias("rain"), r6(c("mean3"), "mean3"))


@query("""SELECT 'r' || (user_id % 40) AS record, round(sum(CASE WHEN user_id % 3 <> 0 THEN value END), 4) AS sat, round(sum(CASE WHEN user_id % 5 <> 0 THEN value * 2 END), 4) AS weather,
round(arg_min(value, event_id) FILTER (user_id % 7 <> 0), 4) AS soil FROM events WHERE user_id % 3 <> 0 OR user_id % 5 <> 0 OR user_id % 7 <> 0 GROUP BY 1""")
def io_record_folders(spark, d):
    """Triples of files for each record; some files of a record lack rows."""
    path = io.scratch(spark, "records")
    e = t(spark, d, "events").select("event_id", "value", "user_id", F.concat(lit("r"), c("user_id") % 40).alias("record"))
    for name, keep, value in (("satellite", 3, c("value")), ("weather", 5, c("value") * 2), ("soil", 7, c("value"))):
        io.write_record_files(e.filter(c("user_id") % keep != 0).select("record", c("event_id").alias("step"), value.alias("x")), path, name, "step")
    x = io.read_record_files(spark, path, ["x"], ["x"], ["x"], "step")
    total = lambda n: F.round(mixture.total(F.flatten(n)), 4).alias(n)
    return x.select("record", total("sat"), total("weather"), F.round(c("soil")[0], 4).alias("soil"))


@query("""SELECT o_custkey::VARCHAR AS site_id, o_orderdate::TIMESTAMP AS time, round(o_totalprice, 2) AS yield, year(o_orderdate)::INT AS year FROM orders""")
def io_yields_csv(spark, d):
    path = io.scratch(spark, "yields")
    t(spark, d, "orders").select(c("o_custkey").alias("site_id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("time"), F.round("o_totalprice", 2).alias("yield")).write.option("header", True).csv(path)
    return io.read_yields(spark, path).select("site_id", "time", "yield", "year")


@query("""SELECT vec_id, round(list_sum(embedding[1:5]::DOUBLE[]), 5) AS sat, round(list_sum(embedding[21:28]::DOUBLE[]), 5) AS weather, round(list_sum(embedding[61:64]::DOUBLE[]), 5) AS soil FROM embeddings""")
def io_requests_json(spark, d):
    """Requests as JSON objects; the id is the one soil value more."""
    path = io.scratch(spark, "requests")
    attributions(spark, d).select("sat", "weather", F.concat("soil", F.array(c("vec_id").cast("double"))).alias("soil")).write.json(path)
    first = lambda n: F.round(mixture.total(c(n)[0]), 5).alias(n)
    r = io.read_requests(spark, path, multi_line=False)
    return r.select(c("soil")[4].cast("long").alias("vec_id"), first("sat"), first("weather"), F.round(mixture.total(F.slice("soil", 1, 4)), 5).alias("soil"))


@query("""WITH r AS (SELECT o_orderpriority AS p, count(*) AS n, round(avg(o_totalprice), 2) AS m FROM orders GROUP BY 1)
SELECT 'csv' AS kind, 'all' AS region, count(*) AS n, round(avg(o_totalprice), 2) AS mean FROM orders UNION ALL SELECT 'json', 'all', count(*), round(avg(o_totalprice), 2) FROM orders
UNION ALL SELECT 'drift', p, n, m FROM r UNION ALL SELECT 'summary p', p, (SELECT count(*) FROM orders), NULL FROM r""")
def io_reports(spark, d):
    """A one-row report as CSV and JSON, a report of one object a region, and a training summary, all read back."""
    path = io.scratch(spark, "reports")
    o = t(spark, d, "orders")
    facts = [F.count(lit(1)).alias("n"), F.round(F.avg("o_totalprice"), 2).alias("mean")]
    io.write_report(o.agg(*facts), path)
    io.write_drift(o.groupBy(c("o_orderpriority").alias("region")).agg(*facts), f"{path}/drift")
    io.write_training_summary(o, "o_orderpriority", f"{path}/summary", "p")
    row = lambda kind, region, n, mean: [kind.alias("kind"), region.alias("region"), n.cast("long").alias("n"), mean.cast("double").alias("mean")]
    out = spark.read.option("header", True).csv(f"{path}/csv").select(row(lit("csv"), lit("all"), c("n"), c("mean")))
    out = out.unionByName(spark.read.json(f"{path}/json").select(row(lit("json"), lit("all"), c("n"), c("mean"))))
    out = out.unionByName(spark.read.json(f"{path}/drift").select(row(lit("drift"), c("region"), c("n"), c("mean"))))
    told = spark.read.json(f"{path}/summary").withColumn("r", F.explode("trained_regions"))
    return out.unionByName(told.select(row(F.concat(lit("summary "), c("project_name")), c("r"), c("num_sequences"), lit(None))))


@query("""SELECT n_name AS site, n_nationkey + 0.5 AS ph, CASE WHEN n_nationkey % 3 > 0 THEN n_regionkey::DOUBLE END AS soc, n_name || '_soil.csv' AS file FROM nation""")
def io_soil_files(spark, d):
    """A soil file for each site, of which the first row counts; a text in place of a number is NULL."""
    path = io.scratch(spark, "soil")
    n = t(spark, d, "nation").select(c("n_name").alias("site"), "n_nationkey", F.when(c("n_nationkey") % 3 > 0, c("n_regionkey").cast("string")).otherwise("none").alias("soc"))
    rows = n.select("site", F.posexplode(F.array(c("n_nationkey") + 0.5, lit(99.0))).alias("_k", "ph"), "soc").repartition("site").sortWithinPartitions("site", "_k")
    io.write_soil(rows.drop("_k"), path)
    return io.read_soil(spark, path, ["ph", "soc"]).select("site", "ph", "soc", "file")


@query("""SELECT c_name AS name, round(c_acctbal / 100, 4) AS lat, c_custkey % 180 + 0.25 AS lon, CASE WHEN c_custkey % 2 = 0 THEN c_custkey % 180 + 0.75 END AS east FROM customer""")
def io_study_areas(spark, d):
    path = io.scratch(spark, "areas")
    lat, lon = F.round(c("c_acctbal") / 100, 4), c("c_custkey") % 180 + 0.25
    box = F.when(c("c_custkey") % 2 == 0, scalars.bbox_of_point(lat, lon, 0.5))
    t(spark, d, "customer").select(c("c_name").alias("name"), lat.alias("lat"), lon.alias("lon"), box.alias("bbox")).write.json(path)
    return io.read_study_areas(spark, path).select("name", "lat", "lon", c("bbox")[2].alias("east"))


@query("""SELECT p_name, round((p_partkey - (SELECT avg(p_partkey) FROM part)) / (SELECT stddev_samp(p_partkey) FROM part), 6) AS p_partkey, round((p_size - (SELECT avg(p_size) FROM part)) / (SELECT stddev_samp(p_size) FROM part), 6) AS p_size,
round((p_retailprice - (SELECT avg(p_retailprice) FROM part)) / (SELECT stddev_samp(p_retailprice) FROM part), 6) AS p_retailprice FROM part""")
def z_scores_of_all_numbers(spark, d):
    """The number columns are found by their types."""
    z = tables.z_scores(t(spark, d, "part"))
    return z.select("p_name", *(r6(c(n), n) for n in numeric_columns(t(spark, d, "part"))))


def _uniform(seed: str, *key: str) -> str:
    return f"((('0x' || substr(md5('{seed}:' || {" || ':' || ".join(f"CAST({k} AS VARCHAR)" for k in key)}), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496)"


def _normal(seed: str, *key: str) -> str:
    return f"(sqrt(-2 * ln({_uniform(seed + 'r', *key)})) * cos(2 * pi() * {_uniform(seed + 'a', *key)}))"


def customer_areas(spark, d):
    lat, lon = (20 + c("c_custkey") % 15).cast("double"), (75 + c("c_custkey") % 11).cast("double")
    return t(spark, d, "customer").select(c("c_name").alias("site"), lat.alias("lat"), lon.alias("lon"), scalars.bbox_of_point(lat, lon, 0.25).alias("bbox"), "c_custkey")


@query(f"""WITH a AS (SELECT c_name AS site, unnest(range(2018, 2021))::INT AS year FROM customer)
SELECT a.site, a.year, make_timestamp(a.year, 12, 31, 0, 0, 0) AS time, round(3.5 + 0.5 * {_normal("yield", "a.site", "a.year")}, 6) AS "yield", round(6.5 + 0.1 * {_normal("ph", "a.site")}, 6) AS ph, round(12.5 + 0.5 * {_normal("soc", "a.site")}, 6) AS soc FROM a""")
def synthetic_yields(spark, d):
    """Made yields and soil of the given areas; every draw follows from its key."""
    areas = customer_areas(spark, d)
    y = synth.yields(areas, 2018, 2020).withColumnRenamed("site_id", "site")
    return y.join(synth.soil(areas), "site").select("site", "year", "time", *(r6(c(n), n) for n in ("yield", "ph", "soc")))


@query(f"""WITH g AS (SELECT c_name AS site, t AS time, 20 + c_custkey % 15 - 0.25 + 0.5 * i / 2.0 AS lat, 75 + c_custkey % 11 - 0.25 + 0.5 * j / 2.0 AS lon
FROM customer, (SELECT unnest([TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-16', TIMESTAMP '2024-01-31']) AS t), range(3) a(i), range(3) b(j) WHERE c_custkey % 10 = 0),
k AS (SELECT site, time, lat::DOUBLE AS lat, lon::DOUBLE AS lon FROM g)
SELECT site, time, round(lat, 6) AS lat, round(lon, 6) AS lon, round(0.01 + 0.09 * {_uniform("B04", "site", "time", "lat", "lon")}, 6) AS "B04", round(0.2 + 0.4 * {_uniform("B08", "site", "time", "lat", "lon")}, 6) AS "B08",
[4, 5, 6, 8, 9][1 + floor({_uniform("SCL", "site", "time", "lat", "lon")} * 5)::INT] AS "SCL" FROM k""")
def synthetic_grids(spark, d):
    """Made satellite bands on the grids of every tenth area (the others have no box)."""
    areas = customer_areas(spark, d).withColumn("bbox", F.when(c("c_custkey") % 10 == 0, c("bbox")))
    s = synth.satellite(areas, "2024-01-01", "2024-02-10", n=3)
    return s.select("site", "time", *(r6(c(n), n) for n in ("lat", "lon", "B04", "B08")), "SCL")


@query("""SELECT o_custkey AS site, year(o_orderdate) AS year, o_totalprice AS v FROM orders""")
def yield_trend(spark, d):
    """The halves of two regions' tables as one, by site and year."""
    o = t(spark, d, "orders").select(c("o_custkey").alias("site"), F.year("o_orderdate").cast("long").alias("year"), c("o_totalprice").alias("v"))
    return tables.yield_trend(tables.all_sites([o.filter("site % 2 = 0"), o.filter("site % 2 = 1")]), "site", "year", "v")
