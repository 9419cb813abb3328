"""What plans do: layout of stored features, candidates of spatial joins, passes of searches."""

import random
import uuid

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fieldcast.operators import align, bias, drift
from fieldcast.sources import io


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture()
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.unset("spark.sql.requireAllClusterKeysForCoPartition")


def test_stored_features_are_joined_without_a_shuffle(spark, no_broadcast):
    d = spark.range(600).select((F.col("id") % 7).alias("site"), (F.col("id") % 3).cast("double").alias("lat"), F.lit(1.0).alias("lon"), F.timestamp_seconds(F.col("id") * 86_400 + 1_600_000_000).alias("day"), F.rand(1).alias("v"))
    names = [f"features_{uuid.uuid4().hex}" for _ in range(2)]
    paths = [io.scratch(spark, "bucketed") for _ in names]
    for name, path in zip(names, paths):
        io.save_features(d, name, path, "day", 4)
    io.co_located(spark)
    a, b = (spark.table(n).filter("year = 2021") for n in names)
    w = Window.partitionBy("site", "cell").orderBy("day")
    joined = a.join(b.select("site", "cell", "day", F.col("v").alias("u")), ["site", "cell", "day"]).withColumn("r", F.row_number().over(w))
    assert "Exchange" not in plan(joined) and "SortMergeJoin" in plan(joined)
    assert plan(joined).count("PartitionFilters: [isnotnull(year") == 2
    assert joined.count() == d.filter("year(day) = 2021").count() > 0
    files = spark.read.parquet(paths[0]).select(F.input_file_name().alias("f")).distinct().count()
    assert files <= 4 * d.select(F.year("day")).distinct().count()
    for name in names:
        spark.sql(f"DROP TABLE {name}")


def test_a_site_has_as_many_files_as_its_rows_need(spark):
    d = spark.range(3000).repartition(8).select(F.when(F.col("id") < 2500, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 5)).alias("site"), "id")
    path = io.scratch(spark, "features")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    io.write_features(d, path, rows_per_file=500)
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = {r["site"]: r["n"] for r in spark.read.parquet(path).select("site", F.input_file_name().alias("f")).distinct().groupBy("site").agg(F.count("f").alias("n")).collect()}
    assert 1 < files.pop("hot") <= 5 and set(files.values()) == {1}
    assert spark.read.parquet(path).count() == 3000


def boxes_and_points(seed=3, n=400):
    rng = random.Random(seed)
    boxes = []
    for i in range(60):
        x, y, w, h = rng.uniform(-50, 50), rng.uniform(-50, 50), rng.choice((0.0, 0.3, 2.0, 17.0)), rng.choice((0.3, 1.0, 40.0))
        boxes.append((i, rng.choice("ab"), [x, y, x + w, y + h]))
    points = [(i, rng.choice("ab"), rng.uniform(-50, 50), rng.uniform(-50, 50)) for i in range(n)] + [(n + i, k, b[1], b[0]) for i, k, b in boxes]
    return boxes + [(99, "a", None), (98, "a", [1.0, 1.0, 0.0, 0.0])], points + [(9999, None, 0.0, 0.0), (9998, "a", None, 0.0)]


@pytest.mark.parametrize("hot", [10, 1_000_000])
def test_points_in_boxes(spark, hot):
    boxes, points = boxes_and_points()
    b = spark.createDataFrame(boxes, "b int, k string, box array<double>")
    p = spark.createDataFrame(points, "p int, k string, lat double, lon double")
    got = sorted((r["p"], r["b"]) for r in align.in_boxes(p, b, ["k"], "lat", "lon", "box", hot_points=hot).collect())
    want = sorted((i, j) for i, k, lat, lon in points for j, m, x in boxes if x and k == m and lat is not None and x[0] <= lon <= x[2] and x[1] <= lat <= x[3])
    assert got == want and len(want) > 100


def test_candidates_are_near_the_results(spark, monkeypatch):
    """Boxes of like size over many points: the tiles hand over at most three candidates for each result, not all points of a key."""
    rng = random.Random(5)
    b = spark.createDataFrame([(i, [x, y, x + 1.3, y + 0.7]) for i in range(200) for x, y in [(rng.uniform(0, 30), rng.uniform(0, 30))]], "b int, box array<double>")
    p = spark.createDataFrame([(i, rng.uniform(0, 30), rng.uniform(0, 30)) for i in range(8000)], "p int, lat double, lon double")
    results = align.in_boxes(p, b, [], "lat", "lon", "box").count()
    monkeypatch.setattr(align, "in_bbox", lambda *_: F.lit(True))
    candidates = align.in_boxes(p, b, [], "lat", "lon", "box").count()
    assert 500 < results <= candidates < 3 * results


def test_nearest_cells_need_no_join(spark):
    rng = random.Random(7)
    p = spark.createDataFrame([(i, rng.choice("ab"), rng.choice((rng.uniform(0, 9), float(rng.randrange(9)), 4.5)), rng.uniform(0, 9)) for i in range(200)] + [(900, "c", 1.0, 1.0), (901, "a", None, 1.0), (902, None, 1.0, 1.0)], "i int, site string, lat double, lon double")
    cells = [(rng.choice("ab"), float(rng.randrange(9)), rng.uniform(0, 9)) for _ in range(150)]
    g = spark.createDataFrame(cells, "site string, lat double, lon double")
    near = align.nearest_cell(p, g)
    assert "Join" not in plan(near)
    for found in (near, align.nearest_cell(p, g, hot_rows=20)):
        for r in found.collect():
            for axis, k in (("lat", 1), ("lon", 2)):
                own = [c[k] for c in cells if c[0] == r["site"]]
                want = None if r[axis] is None or not own else min(own, key=lambda v: (abs(v - r[axis]), -v))
                assert r[f"cell_{axis}"] == want
    assert near.count() == 203


def test_passes_dont_grow_with_the_columns(spark):
    d = spark.range(500).select(*((F.col("id") % (k + 5) + 1.0).alias(f"c{k}") for k in range(6)), F.lit(3.0).alias("same"), F.lit(None).cast("double").alias("none"))
    jobs = []
    for columns in (["c0"], [f"c{k}" for k in range(6)] + ["same", "none"]):
        group = uuid.uuid4().hex
        spark.sparkContext.setJobGroup(group, "")
        fits = bias.box_cox_all(d, columns)
        jobs.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert fits["same"] == (None, 0.0) and fits["none"][0] is None and fits["c0"][0] is not None
    assert jobs[1] <= jobs[0] + 4  # one more widening of a range at most


def test_histograms_bound_what_they_leave_out(spark):
    rng = random.Random(9)
    rows = [(r, m, rng.gauss(m / 10, 1 + 0.1 * (r == "b"))) for r in "ab" for m in range(6) for _ in range(400)] + [("a", 1, None), ("a", 1, float("nan")), ("few", 0, 1.0)]
    d = spark.createDataFrame(rows, "region string, month int, x double")
    h = drift.histograms(d, "region", "month", "x", -5.0, 6.0, 400)
    side = F.when(F.col("month") < 2, "ref").when(F.col("month") > 3, "cur")
    got = {r["region"]: r for r in drift.drift_of_histograms(h, "region", side).collect()}
    clean = d.filter(~F.isnan("x")).withColumn("side", side).filter("side IS NOT NULL")
    exact = {r["region"]: r["psi"] for r in drift.psi(clean, "region", "side", "x").collect()}
    far = {r["region"]: r["ks_d"] for r in drift.ks_distance(clean, "region", "side", "x").collect()}
    for r in "ab":
        assert got[r]["psi"] == pytest.approx(exact[r], abs=0.05) and got[r]["psi_off"] < 0.05
        assert got[r]["ks_d"] <= far[r] + 1e-12 <= got[r]["ks_d"] + got[r]["ks_off"] + 1e-9
    assert got["few"]["psi"] is None


def test_status_of_regions_broadcasts_no_table(spark, sf_dir):
    """Exploded years look as small as their areas, and a million areas as small as their compressed file."""
    from fieldcast.plans.registry import QUERIES

    p = plan(QUERIES["region_context"](spark, sf_dir))
    assert "BroadcastExchange" not in p and p.count("SortMergeJoin") == 6


def test_equal_rows_ask_once_for_their_neighbours(spark):
    """2000 rows of 4 kinds lack a value; 4 rows are compared with others, not 2000, and all 2000 get the values of all pairs."""
    from fieldcast.operators import impute

    d = spark.range(4000).select("id", (F.col("id") % 4).cast("double").alias("h"), F.when(F.col("id") >= 2000, F.col("id") * 0.5).alias("v"))
    for rows in (10_000, 500):  # one tile, many tiles
        found = impute.neighbours(d, ["v", "h"], "id", donor_rows=rows).filter("_c = -1").collect()
        assert {r["_id"] for r in found} == {0, 1, 2, 3}
        got = impute.knn_impute(d, ["v", "h"], "id", donor_rows=rows).filter("id < 2000").collect()
        assert len(got) == 2000 and all(r["v"] == 1000 + (r["id"] % 4) * 0.5 + 4 for r in got)  # the mean of the first five: 0, 2, ... 8 beyond the first
