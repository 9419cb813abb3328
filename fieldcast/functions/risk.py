"""Risk tiers, bounds and advice, as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The tier labels.
LOW, MEDIUM, HIGH = "Low Risk", "Medium Risk", "High Risk"
UNKNOWN = "Unknown"
ELEVATED = " (Elevated due to uncertainty)"


def risk_tier(predicted: Column, average: Column, low: float = 0.2, high: float = 0.5) -> Column:
    """By the share that the prediction falls short of the average; without a prediction NULL, without an average (NULL or 0) unknown."""
    short = F.try_divide(average - predicted, average)
    return F.when(predicted.isNull(), None).when(short.isNull(), UNKNOWN).when(short > high, HIGH).when(short > low, MEDIUM).otherwise(LOW)


def calibrated_risk(tier: Column, mean: Column, std: Column, limit: float = 0.15) -> Column:
    """One tier up where the relative spread is over the limit."""
    wide = F.try_divide(std, mean + 1e-10) > limit
    return F.when(wide & (tier == LOW), MEDIUM + ELEVATED).when(wide & (tier == MEDIUM), HIGH + ELEVATED).otherwise(tier)


def bounds_95(p: Column, std: Column) -> tuple[Column, Column]:
    return F.when(p.isNotNull() & std.isNotNull(), F.greatest(F.lit(0.0), p - 1.96 * std)), p + 1.96 * std


def plausible(p: Column) -> Column:
    """A forecast in t/ha lies strictly between 0 and 15."""
    return (p > 0) & (p < 15)


# The advice sentences.
WEATHER_ADVICE = "🌦️ **Weather Dominance (%s%%):** The model is highly sensitive to recent climate shifts. Prioritize monitoring short-term weather alerts."
SATELLITE_ADVICE = "🛰️ **Biomass Signal (%s%%):** The forecast is driven primarily by current crop vigor (NDVI). The crop looks healthy, but maintain vigilance for late-season pests."
SOIL_ADVICE = "🌱 **Soil Constraints (%s%%):** Regional soil properties are limiting the yield ceiling. Consider a mid-season NPK top-dress if moisture allows."
HIGH_ADVICE = "🚨 **Emergency Action:** Yield is significantly below the 5-year trend. Conduct a field-level audit for water stress or nutrient deficiency immediately."
LOW_ADVICE = "📈 **Surplus Opportunity:** Yield is above average. Secure storage and transport logistics early to avoid post-harvest losses."
VOLATILE_ADVICE = "⚠️ **Data Volatility:** High variance in the forecast. This usually indicates conflicting signals between satellite imagery and weather data. Re-verify the forecast in 7 days."
PRECIP_ADVICE = "Low yield predicted due to %s. Consider supplemental irrigation."
HEAT_ADVICE = "Heat stress from %s detected. Use mulch or shade if possible."
ACID_ADVICE = "Soil acidity (%s) is a limiting factor. Consider liming."
GOOD_ADVICE = "Condition looks optimal for high yield. Maintain current management practices."
NO_DATA_ADVICE = "No explanation data available to generate recommendations."
FEATURE_NAMES = {
    "accumulated_precip": "Rainfall",
    "gdd": "Temperature/Accumulated Heat",
    "ph": "Soil acidity (pH)",
    "soc": "Soil Organic Carbon (Fertility)",
}


def top_modality(satellite: Column, weather: Column, soil: Column) -> Column:
    """The largest share's name; the first of satellite, weather, soil on ties."""
    return F.when((satellite >= weather) & (satellite >= soil), "Satellite").when(weather >= soil, "Weather").otherwise("Soil")


def forecast_advice(satellite: Column, weather: Column, soil: Column, risk: Column, lower: Column, upper: Column, p: Column) -> Column:
    """Sentences of one forecast, in order; the risk sentences need exactly HIGH or LOW."""
    top = top_modality(satellite, weather, soil)
    percent = lambda x: F.bround(x * 100, 0).cast("int").cast("string")
    first = (
        F.when(top == "Weather", F.format_string(WEATHER_ADVICE, percent(weather)))
        .when(top == "Satellite", F.format_string(SATELLITE_ADVICE, percent(satellite)))
        .otherwise(F.format_string(SOIL_ADVICE, percent(soil)))
    )
    second = F.when(risk == "HIGH", HIGH_ADVICE).when(risk == "LOW", LOW_ADVICE)
    third = F.when(F.try_divide(upper - lower, p) > 0.4, VOLATILE_ADVICE)
    return F.array_compact(F.array(first, second, third))


def top_feature(importance: Column) -> Column:
    """Key of the largest value of a map; the first entry on ties."""
    e = F.map_entries(importance)
    best = F.array_max(F.transform(e, lambda x: x["value"]))
    return F.filter(e, lambda x: x["value"] == best)[0]["key"]


def attribution_advice(risk: Column, importance: Column) -> Column:
    """Sentences from the feature that drove a forecast."""
    top = top_feature(importance)
    name = top
    for key, said in FEATURE_NAMES.items():
        name = F.when(top == key, said).otherwise(name)
    said = (
        F.when(top.contains("precip"), F.format_string(PRECIP_ADVICE, name))
        .when(top.contains("temp") | top.contains("gdd"), F.format_string(HEAT_ADVICE, name))
        .when(top.contains("ph"), F.format_string(ACID_ADVICE, name))
    )
    none = importance.isNull() | (F.size(importance) == 0)
    return F.when(none, F.array(F.lit(NO_DATA_ADVICE))).when(risk.isin(MEDIUM, HIGH), F.array_compact(F.array(said))).otherwise(F.array(F.lit(GOOD_ADVICE)))
