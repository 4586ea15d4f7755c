"""Weather and air-quality readings of many stations and areas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The sixteen winds, clockwise from north.
COMPASS = ["N", "NNE", "NE", "ENE", "E", "ESE", "SE", "SSE", "S", "SSW", "SW", "WSW", "W", "WNW", "NW", "NNW"]
#: Upper bounds of air-quality categories 1 to 5.
AQI_BOUNDS = (50, 100, 150, 200, 300)


def compass(degrees: Column) -> Column:
    return F.when(degrees.isNotNull(), F.element_at(F.array(*map(F.lit, COMPASS)), (F.pmod(F.bround(degrees / 22.5), F.lit(16)) + 1).cast("int")))


def conditions(observations: DataFrame) -> DataFrame:
    """Observations (station, temp_c, wind_kmh, wind_degrees, humidity and others) in F and mph, rounded half to even; rows without temperature go."""
    out = observations.filter(F.col("temp_c").isNotNull())
    whole = lambda c: F.bround(c).cast("long")
    return out.select(
        *[c for c in observations.columns if c not in ("temp_c", "wind_kmh", "wind_degrees", "humidity")], whole(F.col("temp_c") * 9 / 5 + 32).alias("temperature_f"), whole(F.col("wind_kmh") * 0.621371).alias("wind_mph"),
        compass(F.col("wind_degrees")).alias("wind_direction"), whole(F.col("humidity")).alias("humidity_percent"),
    )


def first_periods(forecasts: DataFrame, count: int = 2) -> DataFrame:
    """The first `count` periods of each forecast, names as they are."""
    return forecasts.select("*", F.posexplode(F.slice("periods", 1, count)).alias("position", "period")).drop("periods")


def usable_station(ranked: DataFrame, key: str = "place", most: int = 3) -> DataFrame:
    """Per place the nearest of the first `most` stations that gives a temperature."""
    fields = [c for c in ranked.columns if c != key]
    good = ranked.filter((F.col("rank") <= most) & F.col("temp_c").isNotNull())
    return good.groupBy(key).agg(F.min_by(F.struct(*fields), "rank").alias("s")).select(key, "s.*")


def usable_aqi(value: Column) -> Column:
    return F.when(value >= 0, value)


def aqi_category(value: Column) -> Column:
    out = F.when(value.isNull(), F.lit(None).cast("int"))
    for k, bound in enumerate(AQI_BOUNDS, 1):
        out = out.when(value <= bound, k)
    return out.otherwise(len(AQI_BOUNDS) + 1)


def overall_aqi(readings: DataFrame, key: list[str]) -> DataFrame:
    """The worst pollutant of each key, the first on ties; without a usable value no row. Columns pollutant, aqi, position."""
    good = readings.filter(usable_aqi(F.col("aqi")).isNotNull())
    w = good.groupBy(*key).agg(F.max_by(F.struct("aqi", "pollutant"), F.struct(F.col("aqi"), (-F.col("position")).alias("early"))).alias("w"))
    return w.select(*key, F.col("w.aqi").alias("aqi"), F.col("w.pollutant").alias("pollutant"), aqi_category(F.col("w.aqi")).alias("category"))


def carry_forward(refreshes: DataFrame, key: str, at: str, value: str, observed: str, max_minutes: int = 120) -> DataFrame:
    """Refreshes whose value is missing take the last one of their key while its observation is at most max_minutes old."""
    w = Window.partitionBy(key).orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col(value).isNotNull(), F.struct(F.col(value).alias("v"), F.col(observed).alias("o"))), ignorenulls=True).over(w)
    out = refreshes.withColumn("__l", last)
    fresh = F.unix_seconds(F.col(at)) - F.unix_seconds(F.col("__l.o")) <= max_minutes * 60
    return out.withColumns({"carried": F.col(value).isNull() & F.coalesce(fresh, F.lit(False)), value: F.when(F.col(value).isNotNull(), F.col(value)).when(fresh, F.col("__l.v"))}).drop("__l")


def changed_payloads(rows: DataFrame, key: str, at: str, payload: list[str]) -> DataFrame:
    """Rows whose payload differs from the one before of the same key."""
    w = Window.partitionBy(key).orderBy(at)
    n = F.row_number().over(w)
    same = F.struct(*payload).eqNullSafe(F.lag(F.struct(*payload)).over(w))
    return rows.withColumns({"__n": n, "__same": same}).filter((F.col("__n") == 1) | ~F.col("__same")).drop("__n", "__same")


def error_messages(payload: Column) -> Column:
    """Message texts of an error envelope; none for any other payload."""
    e = F.from_json(payload, "struct<WebServiceError:array<struct<Message:string>>>")["WebServiceError"]
    return F.coalesce(F.array_compact(F.transform(e, lambda x: x["Message"])), F.array().cast("array<string>"))
