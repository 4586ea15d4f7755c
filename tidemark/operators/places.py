"""Addresses to coordinates through a cache and a gazetteer table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lookup_keys(address: Column) -> Column:
    """Texts to look an address up by, best first: all of it, from four parts on without the first, from five on the last four."""
    parts = F.filter(F.transform(F.split(address, ","), lambda p: F.trim(p)), lambda p: p != "")
    n = F.size(parts)
    keys = F.array(address, F.when(n >= 4, F.array_join(F.slice(parts, F.lit(2), F.greatest(n - 1, F.lit(0))), ", ")), F.when(n >= 5, F.array_join(F.slice(parts, n - 3, F.lit(4)), ", ")))
    return F.array_distinct(F.array_compact(keys))


def geocode(addresses: DataFrame, gazetteer: DataFrame, column: str = "address") -> DataFrame:
    """(address, latitude, longitude) of distinct addresses by their best key that the gazetteer (query, latitude, longitude) has; null coordinates where none."""
    a = addresses.select(F.col(column).alias("address")).filter("address IS NOT NULL AND address <> ''").distinct()
    tried = a.select("address", F.posexplode(lookup_keys(F.col("address"))).alias("n", "query"))
    best = tried.join(gazetteer, "query").groupBy("address").agg(F.min_by(F.struct("latitude", "longitude"), "n").alias("c"))
    return a.join(best, "address", "left").select("address", "c.latitude", "c.longitude")


def cache_misses(rows: DataFrame, cache: DataFrame) -> DataFrame:
    """Distinct addresses of rows without coordinates of their own that the cache lacks."""
    own = F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
    return rows.filter(~own).select("address").filter("address IS NOT NULL AND address <> ''").distinct().join(cache, "address", "left_anti")


def located(rows: DataFrame, cache: DataFrame) -> DataFrame:
    """rows with coordinates: their own, else the cache's for their address (a failed lookup stays null)."""
    c = cache.select("address", F.col("latitude").alias("__lat"), F.col("longitude").alias("__lon"))
    own = F.col("latitude").isNotNull() & F.col("longitude").isNotNull()
    j = rows.join(c, "address", "left")
    return j.withColumns({"__la": F.when(own, F.col("latitude")).otherwise(F.col("__lat")), "__lo": F.when(own, F.col("longitude")).otherwise(F.col("__lon"))}).select(*[F.col("__la").alias(x) if x == "latitude" else F.col("__lo").alias(x) if x == "longitude" else F.col(x) for x in rows.columns])


def due_retries(cache: DataFrame, now: Column, retry_hours: float, batch: int) -> DataFrame:
    """Failed rows last tried more than retry_hours ago, oldest first and then by address, at most batch; none where either is 0 or less."""
    if retry_hours <= 0 or batch <= 0:
        return cache.limit(0)
    return cache.filter(F.col("latitude").isNull() & (F.col("last_attempted_at") < now - F.make_dt_interval(secs=F.lit(retry_hours * 3600)))).orderBy("last_attempted_at", "address").limit(batch)


def retry(cache: DataFrame, events: DataFrame, gazetteer: DataFrame, now: Column, retry_hours: float, batch: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(cache after the retries, events with unlocated ones of resolved addresses filled, the retried rows)."""
    due = due_retries(cache, now, retry_hours, batch)
    tried = due.select("address").join(geocode(due, gazetteer), "address").withColumn("last_attempted_at", now)
    rest = cache.join(tried.select("address"), "address", "left_anti")
    new = rest.unionByName(tried.select(*cache.columns))
    found = tried.filter("latitude IS NOT NULL").select("address", "latitude", "longitude")
    missing = F.col("latitude").isNull()
    f = found.withColumnsRenamed({"latitude": "__lat", "longitude": "__lon"})
    filled = events.join(f, "address", "left").withColumns({"__la": F.when(missing, F.col("__lat")).otherwise(F.col("latitude")), "__lo": F.when(missing, F.col("__lon")).otherwise(F.col("longitude"))})
    filled = filled.select(*[F.col("__la").alias(x) if x == "latitude" else F.col("__lo").alias(x) if x == "longitude" else F.col(x) for x in events.columns])
    return new, filled, tried
