"""Readers and writers of the known files."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import REQUEST, STUDY_AREAS, nan_to_null


def read_yields(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header; ``year`` from ``time``. A missing file is an empty table; without ``time`` the year is NULL."""
    try:
        raw = spark.read.option("header", True).csv(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], "site_id string, time timestamp, yield double, year int")
    numbers = {c: F.col(c).try_cast("double") for c in ("lat", "lon", "yield") if c in raw.columns}
    d = nan_to_null(raw.withColumns(numbers))
    if "time" not in d.columns:
        return d.withColumn("year", F.lit(None).cast("int"))
    return d.withColumn("time", F.try_to_timestamp("time")).withColumn("year", F.year("time"))


def read_soil(spark: SparkSession, folder: str, values: list[str]) -> DataFrame:
    """Files ``{site}_soil.csv``: site (from the file name), its first row's numbers, the file name.

    A file is read as one partition, so the first row is the first line of its file.
    """
    name = F.url_decode(F.regexp_extract("_metadata.file_path", "([^/]+)$", 1))
    schema = ", ".join(f"`{c}` string" for c in values)
    raw = spark.read.schema(schema).option("header", True).option("enforceSchema", False).option("multiLine", True).csv(f"{folder}/*_soil.csv")
    d = raw.select(*(F.col(c).try_cast("double").alias(c) for c in values), name.alias("file"), F.monotonically_increasing_id().alias("_o"))
    first = d.groupBy("file").agg(F.min_by(F.struct(*values), "_o").alias("_r"))
    return first.select(F.regexp_replace("file", "_soil\\.csv$", "").alias("site"), *(F.col(f"_r.{c}").alias(c) for c in values), "file")


def write_soil(df: DataFrame, folder: str, site: str = "site") -> None:
    """One file ``{site}_soil.csv`` for each site, with its rows; sites are as many as files that a folder should have."""
    spark = df.sparkSession
    parts = f"{folder}/_parts"
    df.repartition(site).write.partitionBy(site).option("header", True).csv(parts)
    jvm = spark.sparkContext._jvm
    top = jvm.org.apache.hadoop.fs.Path(parts)
    fs = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for own in fs.listStatus(top):
        name = own.getPath().getName()
        if not name.startswith(f"{site}="):
            continue
        files = [f.getPath() for f in fs.listStatus(own.getPath()) if f.getPath().getName().startswith("part-")]
        for k, file in enumerate(sorted(files, key=str)):  # a site is one task's, so one file, unless it is very large
            fs.rename(file, jvm.org.apache.hadoop.fs.Path(f"{folder}/{name.removeprefix(f'{site}=')}{f'.{k}' if k else ''}_soil.csv"))
    fs.delete(top, True)


def read_grid(spark: SparkSession, path: str, site: str | None = None) -> DataFrame:
    """Long-form Parquet; latitude and longitude may have their long names; one site's read is pruned."""
    d = spark.read.parquet(path).withColumnsRenamed({"latitude": "lat", "longitude": "lon"})
    return d if site is None else d.filter(F.col("site") == site)


def write_features(df: DataFrame, path: str, site: str = "site", rows_per_file: int = 5_000_000) -> None:
    """One folder per site; a write replaces only the sites that it holds.

    Rows are dealt by site, and a site of more than ``rows_per_file`` rows by a hash of the row too, so a site has as many files
    as its rows need, whatever the number of tasks.
    """
    files = df.groupBy(site).agg(F.ceil(F.count(F.lit(1)) / rows_per_file).cast("int").alias("_files")).filter("_files > 1").withColumnRenamed(site, "_of")
    dealt = df.join(files, F.col(site).eqNullSafe(F.col("_of")), "left").withColumn("_file", F.pmod(F.xxhash64(*df.columns), F.coalesce("_files", F.lit(1))))
    dealt = dealt.repartition(site, "_file").select(*df.columns)
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(site).parquet(path)


CELL = ["site", "cell"]


def save_features(df: DataFrame, table: str, path: str, time: str, buckets: int) -> None:
    """A feature table of the catalog, with a folder per ``year`` and in it a file per bucket of (site, cell), sorted by them and time.

    ``cell`` is the text of lat and lon: Spark normalizes floating keys before it compares them, which undoes buckets. Tables of
    equal buckets are joined and windowed by (site, cell) without a shuffle (``co_located``), and a filter on ``year`` reads
    its folders only.
    """
    d = df.withColumns({"cell": F.concat_ws(",", "lat", "lon"), "year": F.year(time)}).repartition(buckets, *CELL)
    d.write.mode("overwrite").partitionBy("year").bucketBy(buckets, *CELL).sortBy(*CELL, time).option("path", path).saveAsTable(table)


def co_located(spark: SparkSession) -> None:
    """Let joins on more than the bucketed key, such as key and day, use the buckets as they are."""
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")


def write_record_files(df: DataFrame, folder: str, name: str, step: str, record: str = "record") -> None:
    """One input (satellite, weather or soil) of many scoring records: ``{folder}/{name}/{record}=.../`` with one CSV file each."""
    df.repartition(record).sortWithinPartitions(record, step).write.partitionBy(record).option("header", True).csv(f"{folder}/{name}")


def read_record_files(spark: SparkSession, folder: str, sat: list[str], weather: list[str], soil: list[str], step: str | None = None, record: str = "record") -> DataFrame:
    """Scoring records in bulk: record (as text), sat, weather, soil of the files below ``{folder}/satellite``, ``weather`` and ``soil``.

    Rows stand in file order, or by a ``step`` column; a record's soil is its first row. What a record lacks is NULL.
    """

    def rows(name: str, columns: list[str]) -> DataFrame:
        raw = spark.read.option("header", True).option("recursiveFileLookup", True).option("multiLine", True).csv(f"{folder}/{name}")
        own = F.url_decode(F.regexp_extract("_metadata.file_path", f"{record}=([^/]+)/", 1))
        order = F.col(step).try_cast("double") if step else F.monotonically_increasing_id()
        return raw.select(own.alias(record), order.alias("_o"), F.array(*(F.col(c).try_cast("double") for c in columns)).alias("_v"))

    def matrix(name: str, columns: list[str], out: str) -> DataFrame:
        packed = F.transform(F.array_sort(F.collect_list(F.struct("_o", "_v"))), lambda x: x["_v"])
        return rows(name, columns).groupBy(record).agg(packed.alias(out))

    first = rows("soil", soil).groupBy(record).agg(F.min_by("_v", "_o").alias("soil"))
    return matrix("satellite", sat, "sat").join(matrix("weather", weather, "weather"), record, "full").join(first, record, "full")


def read_records_csv(spark: SparkSession, satellite: str, weather: str, soil: str, step: str | None = None) -> DataFrame:
    """One scoring record (sat, weather, soil) of three CSV files, rows in file order or by a ``step`` column."""

    def rows(path: str) -> DataFrame:
        d = spark.read.option("header", True).option("inferSchema", True).option("multiLine", True).csv(path)
        order = F.col(step) if step else F.monotonically_increasing_id()
        return d.select(order.alias("_o"), F.array(*(F.col(c).cast("double") for c in d.columns if c != step)).alias("v"))

    def matrix(path: str, name: str) -> DataFrame:
        return rows(path).agg(F.transform(F.array_sort(F.collect_list(F.struct("_o", "v"))), lambda x: x["v"]).alias(name))

    return matrix(satellite, "sat").crossJoin(matrix(weather, "weather")).crossJoin(rows(soil).agg(F.min_by("v", "_o").alias("soil")))  # one row each


def read_requests(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Scoring requests: JSON objects or arrays of a file each, or with ``multi_line=False`` one object a line."""
    return spark.read.schema(REQUEST).option("multiLine", multi_line).json(path)


def write_report(df: DataFrame, path: str) -> None:
    """A report of one row, as CSV and as JSON."""
    one = df.coalesce(1)
    one.write.mode("overwrite").option("header", True).csv(f"{path}/csv")
    one.write.mode("overwrite").json(f"{path}/json")


def write_drift(report: DataFrame, path: str) -> None:
    report.write.mode("overwrite").json(path)


def training_summary(sequences: DataFrame, site: str) -> DataFrame:
    return sequences.agg(F.array_sort(F.collect_set(site)).alias("trained_regions"), F.count(F.lit(1)).alias("num_sequences"))


def write_training_summary(sequences: DataFrame, site: str, path: str, project: str) -> None:
    """The summary as one JSON object, with the project's name."""
    training_summary(sequences, site).select(F.lit(project).alias("project_name"), "*").coalesce(1).write.mode("overwrite").json(path)


def scratch(spark: SparkSession, what: str) -> str:
    """A path of its own in the folder of ``spark.checkpoint.dir``; only a local master may go without that setting."""
    found = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="fieldcast-")
        spark.sparkContext.setCheckpointDir(found)
    return f"{found.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def read_study_areas(spark: SparkSession, path: str) -> DataFrame:
    """Areas (name, lat, lon, bbox or NULL) of JSON objects, one a line."""
    return spark.read.schema(STUDY_AREAS).json(path)


def study_areas(spark: SparkSession, areas: list[dict]) -> DataFrame:
    return spark.createDataFrame([(a["name"], float(a["lat"]), float(a["lon"]), [float(x) for x in a["bbox"]] if a.get("bbox") else None) for a in areas], STUDY_AREAS)
