"""The jobs that users run, as compositions of the operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import mixture, risk, scalars
from ..operators import align, bias, drift, impute, metrics, score, series, tables
from ..sources.io import scratch

# The status sentences of a region's context.
READY = "Ready for live inference"
NO_STORE = "Missing processed feature store for this region"
NO_MODEL = "Missing trained checkpoint"
NOT_COVERED = "Processed features do not cover %d"

FEW_CELLS = 200_000
BANDS = ["B02", "B03", "B04", "B08"]
RAIN = ["t_max", "t_min", "precip"]


def needed_cells(points: DataFrame, satellite: DataFrame) -> DataFrame:
    """Distinct (site, lat, lon) of the satellite cells nearest to the points (site, lat, lon)."""
    at = align.nearest_cell(points.select("site", "lat", "lon").distinct(), satellite)
    return at.filter("cell_lat IS NOT NULL").select("site", F.col("cell_lat").alias("lat"), F.col("cell_lon").alias("lon")).distinct()


def preprocess(satellite: DataFrame, weather: DataFrame, cells: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(satellite, weather, quality) on common days and on the satellite's cells: masked, gap-filled, daily, regridded.

    With ``cells`` (``needed_cells``) only these are filled and regridded; days and quality are still those of the whole grid.
    """
    cell = ["site", "lat", "lon"]
    quality = tables.valid_ratio(satellite, ["site"])
    daily_rain = series.daily_mean(weather, cell, "time", RAIN)
    days = satellite.select("site", F.date_trunc("day", "time").alias("day")).distinct()
    days = days.join(daily_rain.select("site", "day").distinct(), ["site", "day"], "left_semi")
    if cells is not None:
        satellite = satellite.join(cells, cell, "left_semi")
    places = satellite.select(*cell).join(days.select("site").distinct(), "site", "left_semi").distinct()  # of the raw grid: reading it is cheap
    masked = scalars.cloud_mask(satellite, BANDS)
    filled = series.fill_gaps(masked.select("site", "time", "lat", "lon", *BANDS), cell, "time", BANDS, ties=BANDS)
    sat = series.first_per_day(filled, cell, "time", BANDS).drop("time").join(days, ["site", "day"], "left_semi")
    rain = daily_rain.join(days, ["site", "day"], "left_semi")
    return sat, align.regrid(rain, places, ["site"], "day", RAIN), quality


def training_set(labels: DataFrame, satellite: DataFrame, weather: DataFrame, soil: DataFrame, sat_values: list[str], weather_values: list[str], soil_values: list[str], soil_dim: int, window: int = 12, fallback: str = "first", train_fraction: float = 0.8, grid: DataFrame | None = None) -> DataFrame:
    """One row per label with sat, weather and soil inputs, the label and is_train. Labels: site, time, lat, lon, yield.

    ``grid`` (site, lat, lon) has the cells to choose from, where that is cheaper to read than ``satellite``.
    """
    ids = ["site", "time"]
    at = align.nearest_cell(labels, satellite if grid is None else grid).withColumnsRenamed({"lat": "label_lat", "lon": "label_lon", "cell_lat": "lat", "cell_lon": "lon"})
    cell = ["site", "lat", "lon"]
    needed = at.select(*cell).distinct()
    stacked = align.stack_features(satellite.join(needed, cell, "left_semi"), weather.join(needed, cell, "left_semi"), [*cell, "day"], sat_values, weather_values)
    flat = stacked.select(*cell, "day", *(F.col("features")[i].alias(f"f{i}") for i in range(len(sat_values) + len(weather_values))))
    names = [f"f{i}" for i in range(len(sat_values) + len(weather_values))]
    w = align.history_windows(at, flat, cell, ids, "time", "day", names, [], window, fallback)
    w = align.split_features(w, len(sat_values), "window").drop("window")
    path = scratch(labels.sparkSession, "training")  # the split counts it several times
    tables.soil_vectors(w, soil, "site", soil_values, soil_dim).write.parquet(path)
    return bias.split(labels.sparkSession.read.parquet(path), ids, train_fraction)


def weather_features(weather: DataFrame, key: list[str], time: str = "time", scale: int = 3) -> DataFrame:
    d = weather.withColumn("gdd", scalars.growing_degree_days(F.col("t_max"), F.col("t_min")))
    d = series.running_total(d, key, time, {"accumulated_precip": "precip", "accumulated_gdd": "gdd"})
    return series.spi(d, key, time, "precip", scale)


def drift_check(reference_sat: DataFrame, current_sat: DataFrame, reference_weather: DataFrame, current_weather: DataFrame, variable: str = "t_max", region: str = "site") -> DataFrame:
    """region, ndvi_psi, ndvi_status, ks_pvalue, ks_status, overall_status, reference_missing."""
    matched = align.match_reference(current_sat, reference_sat, region)

    def sides(ref: DataFrame, cur: DataFrame, value) -> DataFrame:
        missing = matched.filter("reference_missing").select(region)
        c = cur.select(region, value.alias("x"))
        r = ref.select(region, value.alias("x")).join(matched.select(region), region, "left_semi").unionByName(c.join(missing, region, "left_semi"))
        return r.withColumn("side", F.lit("ref")).unionByName(c.withColumn("side", F.lit("cur"))).filter(scalars.finite(F.col("x")))

    v = scalars.ndvi_zero_safe(F.col("B04"), F.col("B08"))
    p = drift.psi(sides(reference_sat, current_sat, v), region, "side", "x").select(region, F.col("psi").alias("_psi"))
    empty = variable not in reference_weather.columns or variable not in current_weather.columns
    out = matched.join(p, region, "left")
    if empty:
        out = out.withColumn("_p", F.lit(None).cast("double"))
    else:
        k = drift.ks_test(sides(reference_weather, current_weather, F.col(variable).cast("double")), region, "side", "x")
        out = out.join(k.select(region, F.col("ks_pvalue").alias("_p")), region, "left")
    out = out.withColumns({"ndvi_psi": F.round("_psi", 4), "ndvi_status": drift.psi_status(F.col("_psi")), "ks_pvalue": F.round("_p", 6), "ks_status": drift.ks_status(F.col("_p"))})
    out = out.withColumn("overall_status", drift.overall_status(F.col("ndvi_status"), F.col("ks_status")))
    return out.select(region, "ndvi_psi", "ndvi_status", "ks_pvalue", "ks_status", "overall_status", "reference_missing")


def forecast(inputs: DataFrame, history: DataFrame, load: Callable, shares: tuple[str, str, str] | None = None, explain: bool = False) -> DataFrame:
    """A forecast per (site, year) row of ``inputs`` (sat, weather, soil, and any columns that travel along): estimate, bounds,
    risk, advice, bimodality report, status.

    ``history`` is ``tables.site_history``'s result. ``shares`` names attribution columns of satellite, weather and soil; with
    ``explain`` they are computed instead, as ``attribution``: how far the estimate moves when a modality is put to its mean over
    the inputs. A row without whole inputs has the status "no input" (``input_status``, if there, says why); an implausible
    estimate has the status "implausible". Both have no forecast and no risk; a site without history (or with an average of 0)
    has the risk "Unknown".
    """
    c = F.col
    if explain:
        whole = inputs.filter("sat IS NOT NULL AND weather IS NOT NULL AND soil IS NOT NULL")
        d = score.score(inputs, load, means=score.feature_means(whole))
        d = d.withColumn("attribution", F.when(c("shares").isNotNull(), F.struct(*(F.round(c("shares")[i], 4).alias(m) for i, m in enumerate(score.MODALITIES))))).drop("shares")
        shares = tuple(f"attribution.{m}" for m in score.MODALITIES)
    else:
        d = score.score(inputs, load)
    d = d.withColumn("report", F.when(c("pi").isNotNull(), mixture.bimodality(c("pi"), c("sigma"), c("mu"))))
    estimate, warning = mixture.safe_estimate(c("report"))
    d = d.withColumns({"_p": estimate, "warning": warning, "std": F.when(c("pi").isNotNull(), mixture.std(c("pi"), c("sigma"), c("mu")))})
    average = history.select("site", "historical_avg").distinct()
    observed = history.select("site", "year", "observed_yield")
    d = d.join(average.hint("merge"), "site", "left").join(observed.hint("merge"), ["site", "year"], "left")
    ok = risk.plausible(c("_p"))
    status = F.when(c("pi").isNull(), "no input").when(ok, "ok").otherwise("implausible")
    d = d.withColumns({"status": status, "predicted_yield": F.when(ok, c("_p"))}).drop("_p")
    low, high = risk.bounds_95(c("predicted_yield"), c("std"))
    tier = risk.risk_tier(c("predicted_yield"), c("historical_avg"))
    d = d.withColumns({"lower_bound": low, "upper_bound": high, "risk": risk.calibrated_risk(tier, c("predicted_yield"), c("std"))})
    if shares:
        advice = risk.forecast_advice(*map(c, shares), c("risk"), c("lower_bound"), c("upper_bound"), c("predicted_yield"))
        d = d.withColumn("advice", F.when(c("pi").isNotNull(), advice))
    return d


def store_forecast(areas: DataFrame, years: DataFrame, satellite: DataFrame, weather: DataFrame, soil: DataFrame, yields: DataFrame, load: Callable, sat_values: list[str], weather_values: list[str], soil_values: list[str], soil_dim: int, window: int = 12) -> DataFrame:
    """From the feature store to the answer: a row per (site, year) of ``years``, with all that ``live_inputs`` and ``forecast`` add.

    ``yields``: site, year, time, yield. Inputs are stored once before they are scored, as their means are needed first.
    """
    inputs = live_inputs(areas, years, satellite, weather, soil, sat_values, weather_values, soil_values, soil_dim, window)
    path = scratch(areas.sparkSession, "inputs")
    inputs.write.parquet(path)
    history = tables.site_history(yields, "site", "year", "time", "yield")
    return forecast(areas.sparkSession.read.parquet(path), history, load, explain=True)


def live_inputs(areas: DataFrame, years: DataFrame, satellite: DataFrame, weather: DataFrame, soil: DataFrame, sat_values: list[str], weather_values: list[str], soil_values: list[str], soil_dim: int, window: int = 12) -> DataFrame:
    """Inputs of ``forecast`` per (site, year) of ``years``, from feature tables: the last ``window`` rows of the year at the
    cell nearest to the area (site, lat, lon), and the soil vector with its source and warnings. ``input_status`` is "ok" or says
    what is lacking; ``ndvi_series`` comes with the satellite window, if it has B04 and B08."""
    at = areas.select("site", "lat", "lon")

    def last(grid: DataFrame, values: list[str], name: str) -> DataFrame:
        cells = needed_cells(at, grid)  # one per site; only its rows are windowed
        own = grid.join(F.broadcast(cells) if cells.limit(FEW_CELLS + 1).count() <= FEW_CELLS else cells, ["site", "lat", "lon"], "left_semi")
        w = series.last_of_year(own, ["site"], "time", values, F.year("time"), window)
        return w.select("site", "year", F.col("matrix").alias(name), F.col("status").alias(f"_{name}"))

    d = years.select("site", F.col("year").cast("int").alias("year")).hint("merge").join(at.select("site").hint("merge"), "site")
    for name, grid, values in (("sat", satellite, sat_values), ("weather", weather, weather_values)):
        d = d.join(last(grid, values, name).hint("merge"), ["site", "year"], "left")
    short = lambda name, said: F.when(F.col(f"_{name}").isNull(), f"no {said} features").when(F.col(f"_{name}") != "ok", F.concat(F.lit(f"{said}: "), f"_{name}"))
    d = d.withColumn("input_status", F.coalesce(short("sat", "satellite"), short("weather", "weather"), F.lit("ok"))).drop("_sat", "_weather")
    if {"B04", "B08"} <= set(sat_values):
        red, nir = sat_values.index("B04"), sat_values.index("B08")
        d = d.withColumn("ndvi_series", F.transform("sat", lambda r: scalars.ndvi_zero_safe(r[red], r[nir])))
    return tables.soil_vectors(d, soil, "site", soil_values, soil_dim)


def region_context(areas: DataFrame, years: DataFrame, history: DataFrame, live: DataFrame, inputs: DataFrame | None = None, store_years: DataFrame | None = None) -> DataFrame:
    """A status row per (site, year) of ``years``: history, coverage and readiness.

    The average is the site's, so a year without a harvest has it too. ``live``: site, year, has_store, has_model, live_error
    (NULL if none), covers_year. ``inputs`` (``live_inputs``) adds the year's NDVI series, where its inputs are whole;
    ``store_years`` (``tables.years`` of the feature store) adds ``feature_years``.
    """
    c = F.col
    observed = history.select("site", "year", "observed_yield")
    average = history.select("site", "historical_avg").distinct()
    # Spark takes exploded years for as small as their areas, so by its own estimate it would broadcast them
    d = areas.select("site").hint("merge").join(years.hint("merge"), "site").join(observed.hint("merge"), ["site", "year"], "left")
    d = d.join(average.hint("merge"), "site", "left").join(live.hint("merge"), ["site", "year"], "left")
    store, model, covers = (F.coalesce(n, F.lit(False)) for n in ("has_store", "has_model", "covers_year"))
    ready = store & model & covers & c("live_error").isNull()
    status = (
        F.when(ready, READY)
        .when(c("live_error").isNotNull(), c("live_error"))
        .when(~store, NO_STORE)
        .when(~model, NO_MODEL)
        .otherwise(F.format_string(NOT_COVERED, c("year")))
    )
    d = d.withColumns({"live_ready": ready, "status": status})
    if inputs is not None:
        d = d.join(inputs.filter("input_status = 'ok'").select("site", "year", "ndvi_series").hint("merge"), ["site", "year"], "left")
    if store_years is not None:
        d = d.join(store_years.select("site", c("years").alias("feature_years")).hint("merge"), "site", "left").withColumn("feature_years", F.coalesce("feature_years", F.array().cast("array<int>")))
    return d


def evaluate(scored: DataFrame, y: str = "y") -> DataFrame:
    """One row of point, interval and mixture metrics of pi, sigma, mu against y."""
    c = F.col
    d = scored.withColumns({"_p": mixture.mean(c("pi"), c("mu")), "_s": mixture.std(c("pi"), c("sigma"), c("mu"))})
    m = metrics.point_metrics(d, y, "_p")
    b = metrics.benchmark_report(d, y, "_p", "_s").select("calibration_95", "num_samples")
    a = (c("pi"), c("sigma"), c("mu"), c(y))
    more = d.agg(metrics.diagnostic_nll(*a).alias("diagnostic_nll"), metrics.crps_approximation(*a).alias("crps_approximation"), F.avg(mixture.nll(*a)).alias("nll"))
    k = metrics.calibration(metrics.pit(d, y=y)).select("ks_d", "p_value", "is_calibrated", "sharpness_residual")
    return m.crossJoin(b).crossJoin(more).crossJoin(k)  # one row each


def clean_records(df: DataFrame, columns: list[str], row_id: str, fix_skew: bool = True) -> DataFrame:
    """Impute, then clip outliers and correct skew. The imputed table is stored, as the corrections read it many times."""
    path = scratch(df.sparkSession, "imputed")
    impute.impute(df, columns, row_id).write.parquet(path)
    return bias.correct_bias(df.sparkSession.read.parquet(path), columns, fix_skew)
