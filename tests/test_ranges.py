"""Hot keys cut into ranges give what plain windows give."""

import random
from statistics import median

import pytest
from pyspark.sql import functions as F

from fieldcast.functions.numeric import pchip_fill
from fieldcast.operators import ranges, series


@pytest.fixture(autouse=True)
def many_parts(spark):
    """Small partitions stay apart."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def made(spark, n=900):
    rng = random.Random(4)
    rows = []
    for k, size in (("hot", n), ("b", 30), (None, 40), ("all null", 20), ("one", 1)):
        t = 0
        for i in range(size):
            t += rng.choice((1, 1, 2, 5))
            gap = k == "all null" or (k == "hot" and 200 < i < 500) or rng.random() < 0.4
            rows.append((k, t, None if gap else rng.uniform(0, 9), float(rng.randrange(1, 9)), i))
    rng.shuffle(rows)
    return spark.createDataFrame(rows, "k string, t long, v double, w double, n int").repartition(4)


def table(df):
    return sorted((tuple(round(x, 9) if isinstance(x, float) else str(x) for x in (r[c] for c in sorted(df.columns))) for r in df.collect()), key=str)


CASES = {
    "running": lambda d, **m: series.running_total(d, ["k"], "t", {"x": "v", "y": "w"}, **m),
    "rolling": lambda d, **m: series.rolling_sum(d, ["k"], ["t"], "w", 7, "x", **m),
    "lags": lambda d, **m: series.lags(d, ["k"], "t", "v", [1, 5, -2], **m),
    "sequences": lambda d, **m: series.sequences(d, ["k"], "t", ["v", "w"], "w", 6, 2, **m),
    "interpolate": lambda d, **m: series.interpolate(d, ["k"], "t", ["v", "w"], **m),
    "fill_gaps": lambda d, **m: series.fill_gaps(d, ["k"], "t", ["v", "w"], 4, **m),
    "spi": lambda d, **m: series.spi(d, ["k"], "t", "w", **m),
}


@pytest.mark.parametrize("name", CASES)
def test_ranges_give_what_windows_give(spark, name):
    d = made(spark)
    want = table(CASES[name](d))
    assert table(CASES[name](d, hot_rows=35)) == want and want
    assert CASES[name](d, hot_rows=35).columns == CASES[name](d).columns


def test_a_hot_key_is_many_even_parts(spark):
    d = spark.range(40_000).select(F.lit("hot").alias("k"), F.col("id").alias("t"), F.rand(1).alias("v"))
    sizes = []

    def run(x, by):
        sizes.append([r["count"] for r in x.filter("_own").groupBy(*by).count().collect()] if "_own" in x.columns else [])
        return x.withColumn("x", F.lit(1))

    assert ranges.by_parts(d, ["k"], "t", run, hot_rows=1000).count() == 40_000
    assert len(sizes[1]) == 4 and max(sizes[1]) < 2 * median(sizes[1])


def test_no_key_and_an_empty_table(spark):
    d = spark.range(50).select(F.col("id").alias("t"), F.when(F.col("id") % 3 > 0, F.col("id").cast("double")).alias("v"))
    want = [r["v"] for r in series.interpolate(d, [], "t", ["v"]).orderBy("t").collect()]
    assert [r["v"] for r in series.interpolate(d, [], "t", ["v"], hot_rows=10).orderBy("t").collect()] == want == [1.0, *map(float, range(1, 50))][:49] + want[49:]
    assert series.fill_gaps(d.limit(0), [], "t", ["v"], hot_rows=10).count() == 0


def test_gap_filling_against_the_array_version(spark):
    import numpy as np

    d = made(spark)
    got = {(r["k"], r["n"]): r["v"] for r in series.fill_gaps(d, ["k"], "t", ["v"], 4).collect()}
    for k in {r["k"] for r in d.select("k").distinct().collect()}:
        rows = sorted((r for r in d.collect() if r["k"] == k), key=lambda r: r["t"])
        want = pchip_fill(np.array([float(r["t"]) for r in rows]), np.array([np.nan if r["v"] is None else r["v"] for r in rows]), 4)
        assert [got[k, r["n"]] for r in rows] == pytest.approx(want.tolist(), abs=1e-9)
    tied = spark.createDataFrame([("a", 0, 1.0), ("a", 0, None), ("a", 1, None), ("a", 2, 3.0)], "k string, t int, v double")
    assert sorted(r["v"] for r in series.fill_gaps(tied, ["k"], "t", ["v"]).collect() if r["t"] != 0) == [2.0, 3.0]


def test_repeated_times_make_no_series_longer(spark, monkeypatch):
    """900 rows at 30 times: the windows along the key read 30 rows, and results are those of all rows."""
    d = spark.range(900).select(F.lit("k").alias("k"), (F.col("id") % 30).alias("t"), F.when((F.col("id") % 30) % 7 < 2, F.col("id").cast("double")).alias("v"), "id")
    read, plain = [], ranges.by_parts
    monkeypatch.setattr(series, "by_parts", lambda x, *a, **b: read.append(x.count()) or plain(x, *a, **b))
    got = sorted((r["id"], r["v"]) for r in series.fill_gaps(d, ["k"], "t", ["v"], 35, ties=["v"]).collect())
    assert read and max(read) == 30
    at = {t: [v for i, v in got if i % 30 == t] for t in (1, 2, 3)}
    assert at[1] == [float(i) for i in range(1, 900, 30)] and set(at[3]) == {0.0}
    assert sorted(at[2]) == [0.0] * 24 + [pytest.approx(2.0)] * 6  # the first row of time 1 is the 31st, so the 66th is the last within 35
