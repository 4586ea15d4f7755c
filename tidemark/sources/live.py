"""Landed payloads of live feeds to snapshot rows. Every function takes raw rows (source_key, poll_at, payload JSON text) and returns snapshot columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.timeutil import parse_iso, to_float

COLUMNS = ["source_key", "poll_at", "external_id", "category", "label", "lat", "lon", "geometry", "status", "source_time", "properties", "seq"]

#: Fixed values of the feeds: names and the categories they stand for.
AGENCIES = {"Law": "police", "Fire": "fire", "EMS": "ems"}
OUTAGE_LABELS = {"energy": "Energy Outage", "fiber": "Fiber Outage"}
ROAD_TYPES = {"Incident": "incident", "Operations": "construction", "SpecialEvent": "special_event"}
LEFT_OUT = "PERBURN"


def _pick(value: Column, table: dict[str, str], other: str) -> Column:
    return F.coalesce(*[F.when(value == k, F.lit(v)) for k, v in table.items()], F.lit(other))


def _items(raw: DataFrame) -> DataFrame:
    """One row per element of a payload that is an array, as JSON text with its position."""
    items = F.from_json("payload", "array<string>")
    return raw.select("source_key", "poll_at", F.posexplode(items).alias("seq", "item"))


def _get(name: str, item: str = "item") -> Column:
    return F.get_json_object(item, f"$.{name}")


def _first(rows: DataFrame, *order: Column) -> DataFrame:
    w = Window.partitionBy("source_key", "poll_at", "external_id").orderBy(*order)
    return rows.withColumn("__n", F.row_number().over(w)).filter("__n = 1").select(*COLUMNS)


def emergency_calls(raw: DataFrame) -> DataFrame:
    """Active calls: one type left out, rows without id dropped, category by agency, times before 1990 are none; the last row of an id counts."""
    since = lambda c: F.when(F.year(parse_iso(c)) >= 1990, parse_iso(c))
    text = lambda c: F.nullif(_get(c), F.lit(""))
    rows = _items(raw).filter(~F.coalesce(_get("type") == LEFT_OUT, F.lit(False)) & _get("master_incident_id").isNotNull())
    return _first(rows.select(
        "source_key", "poll_at", _get("master_incident_id").alias("external_id"), _pick(F.trim(_get("agency_type")), AGENCIES, "other").alias("category"), F.coalesce(text("type"), text("type_description")).alias("label"), to_float(_get("latitude")).alias("lat"),
        to_float(_get("longitude")).alias("lon"), F.lit(None).cast("string").alias("geometry"), _get("status").alias("status"), F.coalesce(since(_get("statusdatetime")), since(_get("creation"))).alias("source_time"), F.col("item").alias("properties"), "seq",
    ), F.desc("seq"))


@F.pandas_udf(T.StringType())
def _six(values):
    """Numbers with six decimals of their exact binary value."""
    return values.map(lambda v: None if v != v else f"{v:.6f}")


def outages(raw: DataFrame) -> DataFrame:
    """Outages of `{service: [incident]}`: unlocated ones dropped, id from service and place, the last of a place counts."""
    by = F.from_json("payload", "map<string,array<string>>")
    rows = raw.select("source_key", "poll_at", F.explode(by).alias("service", "list")).select("source_key", "poll_at", "service", F.posexplode("list").alias("seq", "item"))
    rows = rows.withColumns({"lat": to_float(_get("latitude")), "lon": to_float(_get("longitude"))}).filter("lat IS NOT NULL AND lon IS NOT NULL")
    props = F.map_concat(F.map_filter(F.from_json("item", "map<string,string>"), lambda k, v: k != "service"), F.create_map(F.lit("service"), F.col("service")))
    return _first(rows.select(
        "source_key", "poll_at", F.concat("service", F.lit(":"), _six("lat"), F.lit(","), _six("lon")).alias("external_id"), F.col("service").alias("category"), _pick(F.col("service"), OUTAGE_LABELS, "Outage").alias("label"), "lat", "lon",
        F.lit(None).cast("string").alias("geometry"), _get("incident_status").alias("status"), F.lit(None).cast("timestamp").alias("source_time"), F.to_json(props, {"ignoreNullFields": "false"}).alias("properties"), "seq",
    ), F.desc("seq"))


def road_events(raw: DataFrame) -> DataFrame:
    """Road events of several endpoints in one list: severe ones by their flag, place from the first location's middle or first coordinate; the first row of an id counts unless a later one is severe."""
    at = lambda c: to_float(F.coalesce(_get(f"locations[0].midPoint.{c}"), F.when(_get("locations[0].midPoint.lat").isNull() & _get("locations[0].midPoint.lng").isNull(), _get(f"locations[0].coordinates[0].{c}"))))
    severe = F.coalesce(_get("isSevere") == "true", F.lit(False))
    text = lambda c: F.nullif(_get(c), F.lit(""))
    rows = _items(raw).filter(_get("id").isNotNull()).select(
        "source_key", "poll_at", _get("id").alias("external_id"), F.when(severe, "severe").otherwise(_pick(_get("eventTypeName"), ROAD_TYPES, "other")).alias("category"), F.coalesce(text("eventSubTypeDescription"), text("eventTypeName")).alias("label"),
        at("lat").alias("lat"), at("lng").alias("lon"), F.lit(None).cast("string").alias("geometry"), _get("status").alias("status"), F.coalesce(parse_iso(_get("revisedDate")), parse_iso(_get("beginningDate"))).alias("source_time"), F.col("item").alias("properties"), "seq",
    )
    return _first(rows, (F.col("category") == "severe").desc(), F.col("seq"))


def advisories(raw: DataFrame) -> DataFrame:
    """Area advisories of `[{"category", "features"}]`: an id and a geometry are needed, status is the type or else the status; the last layer of an id counts."""
    layers = F.from_json("payload", "array<struct<category:string,features:array<string>>>")
    rows = raw.select("source_key", "poll_at", F.posexplode(layers).alias("layer", "l")).select("source_key", "poll_at", "layer", "l.category", F.posexplode("l.features").alias("n", "item"))
    p = lambda c: F.nullif(_get(f"properties.{c}"), F.lit(""))
    rows = rows.filter(_get("properties.EventID").isNotNull() & _get("geometry").startswith("{"))
    props = F.map_concat(F.map_filter(F.from_json(_get("properties"), "map<string,string>"), lambda k, v: k != "advisory_type"), F.create_map(F.lit("advisory_type"), F.col("category")))
    return _first(rows.select(
        "source_key", "poll_at", _get("properties.EventID").alias("external_id"), "category", _get("properties.EventHeader").alias("label"), F.lit(None).cast("double").alias("lat"), F.lit(None).cast("double").alias("lon"), _get("geometry").alias("geometry"),
        F.coalesce(p("EventType"), p("EventStatus")).alias("status"), F.lit(None).cast("timestamp").alias("source_time"), F.to_json(props, {"ignoreNullFields": "false"}).alias("properties"), (F.col("layer") * 1_000_000 + F.col("n")).alias("seq"),
    ), F.desc("seq"))


#: Feeds by name: what a user adds to. Each is a function of raw rows to snapshot rows.
FEEDS = {"calls": emergency_calls, "outages": outages, "roads": road_events, "advisories": advisories}


def normalized(raws: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(snapshot rows of all feeds, a status row per feed). A payload that is no JSON costs only its own poll: it is reported and not a successful poll."""
    out, status = None, None
    for name, raw in raws.items():
        good = F.try_parse_json("payload").isNotNull()
        rows = FEEDS[name](raw.filter(good))
        report = raw.select("source_key", "poll_at", F.coalesce(good, F.lit(False)).alias("ok"), F.when(~F.coalesce(good, F.lit(False)), "payload is no JSON").alias("error"))
        out, status = (rows, report) if out is None else (out.unionByName(rows), status.unionByName(report))
    return out, status
