"""Landed weather and air-quality payloads to typed rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.timeutil import observed_at
from tidemark.operators.weather import aqi_category


def observations(raw: DataFrame) -> DataFrame:
    """(station, rank, temp_c, ...) of observation payloads (place, station, rank, payload)."""
    q = lambda c: F.get_json_object("payload", f"$.properties.{c}.value").try_cast("double")
    t = lambda c: F.get_json_object("payload", f"$.properties.{c}")
    return raw.select("place", "station", "rank", F.coalesce(t("textDescription"), F.lit("")).alias("description"), t("icon").alias("icon"), t("timestamp").alias("observed_at"), q("temperature").alias("temp_c"), q("windSpeed").alias("wind_kmh"), q("windDirection").alias("wind_degrees"), q("relativeHumidity").alias("humidity"))


def station_ids(raw: DataFrame, limit: int) -> DataFrame:
    """(place, rank from 1, station) of the first stations of station-list payloads."""
    ids = F.slice(F.from_json(F.get_json_object("payload", "$.features"), "array<struct<id:string>>"), 1, limit)
    return raw.select("place", F.posexplode(ids).alias("n", "s")).select("place", (F.col("n") + 1).alias("rank"), F.col("s.id").alias("station"))


def forecasts(raw: DataFrame) -> DataFrame:
    """(place, periods) of forecast payloads."""
    kind = "array<struct<name:string,temperature:double,temperatureUnit:string,probabilityOfPrecipitation:struct<value:double>,shortForecast:string,detailedForecast:string>>"
    return raw.select("place", F.from_json(F.get_json_object("payload", "$.properties.periods"), kind).alias("periods"))


def air_quality(raw: DataFrame) -> DataFrame:
    """(area, position, pollutant, aqi, category, category_name, observed_at) of air-quality payloads; values below 0 and other than numbers are none."""
    e = F.from_json("payload", "array<string>")
    rows = raw.select("area", F.posexplode(e).alias("position", "item"))
    g = lambda c: F.get_json_object("item", f"$.{c}")
    value = F.when(g("nowcastAQI").rlike(r"^-?[0-9]"), g("nowcastAQI").try_cast("double"))
    value = F.when(value >= 0, value)
    return rows.select("area", "position", g("parameterName").alias("pollutant"), value.alias("aqi"), aqi_category(value).alias("category"), g("aqiCategoryName").alias("category_name"), observed_at(g("dateObserved"), g("hourObserved"), g("localTimeZone")).alias("observed_at"))
