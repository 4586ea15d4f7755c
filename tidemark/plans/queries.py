"""The registered queries over the bindings, one or more per operator, with the SQL each is held against. Times are given as seconds."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import geo, text, timeutil
from tidemark.operators import history, listings, places, stories, weather
from tidemark.operators.keyed import KeyedTable
from tidemark.plans import landed
from tidemark.plans.bindings import ARTICLES, RAW_EVENTS, READINGS, SNAPSHOTS, articles, polls, raw_events, read, readings, snapshots
from tidemark.tables import materialize, new_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = dict(landed.QUERIES)
ORACLE_SQL: dict[str, str] = dict(landed.ORACLE_SQL)
SPANS = landed.SPANS

#: A place, a time and a box of the bindings.
CENTER = (35.0456, -85.3097)
NOW = "2024-01-20 00:00:00"
BOX = (-85.31, 35.05, -85.305, 35.08)


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return add


def seconds(c: str) -> Column:
    return F.unix_seconds(F.col(c).cast("timestamp"))


def now():
    return F.lit(NOW).cast("timestamp")


def _log(spark: SparkSession, sf: str) -> DataFrame:
    s = snapshots(spark, sf)
    return history.replay(s, polls(s))


def _state(spark: SparkSession, sf: str) -> DataFrame:
    s = snapshots(spark, sf)
    return history.final_state(s, polls(s))


# ---- history -------------------------------------------------------------------------------------------------------


@query("h01_resolved_geometry", f"WITH {SNAPSHOTS} SELECT source_key, external_id, poll_at, lon AS lon, lat AS lat, 'Point' AS kind FROM snaps")
def h01(spark, sf):
    s = snapshots(spark, sf)
    g = geo.resolved_geometry(F.col("geometry"), F.col("lat"), F.col("lon"))
    at = lambda k: F.get_json_object(g, f"$.coordinates[{k}]").cast("double")
    return s.select("source_key", "external_id", seconds("poll_at").alias("poll_at"), at(0).alias("lon"), at(1).alias("lat"), F.get_json_object(g, "$.type").alias("kind"))


@query("h02_fingerprint", f"WITH {SNAPSHOTS} SELECT source_key, external_id, poll_at, fp AS fingerprint FROM fps")
def h02(spark, sf):
    s = history.with_fingerprint(snapshots(spark, sf))
    return s.select("source_key", "external_id", seconds("poll_at").alias("poll_at"), "fingerprint")


@query("h02_shape_fingerprint", f"""WITH {SNAPSHOTS}, q AS (SELECT DISTINCT source_key, external_id, CAST(lon AS VARCHAR) AS x, CAST(lat AS VARCHAR) AS y, CAST(round(lon + 0.1, 4) AS VARCHAR) AS x2, CAST(round(lat + 0.1, 4) AS VARCHAR) AS y2 FROM snaps)
SELECT source_key, external_id, sha1('{{"coordinates":[[[' || x || ',' || y || '],[' || x || ',' || y2 || '],[' || x2 || ',' || y || '],[' || x || ',' || y || ']]],"type":"Polygon"}}') AS fingerprint FROM q""")
def h02b(spark, sf):
    """Squares around each entity's places: the fingerprints of areas."""
    s = snapshots(spark, sf)
    ring = F.format_string("[[[%s,%s],[%s,%s],[%s,%s],[%s,%s]]]", "lon", "lat", "lon", F.round(F.col("lat") + 0.1, 4), F.round(F.col("lon") + 0.1, 4), "lat", "lon", "lat")
    shapes = s.select("source_key", "external_id", F.concat(F.lit('{"type":"Polygon","coordinates":'), ring, F.lit("}")).alias("geometry")).distinct()
    return shapes.select("source_key", "external_id", geo.shape_fingerprint("geometry").alias("fingerprint"))


@query("h03_state_changed", f"WITH {SNAPSHOTS} SELECT source_key, count(*) AS rows_seen, count(*) FILTER (WHERE p_seq IS NOT NULL AND (p_seq <> poll_seq - 1 OR p_status IS DISTINCT FROM status OR p_fp IS DISTINCT FROM fp)) AS changed FROM runs GROUP BY source_key")
def h03(spark, sf):
    from pyspark.sql import Window

    s = snapshots(spark, sf)
    rows = history.with_fingerprint(s).join(history.numbered_polls(polls(s)), ["source_key", "poll_at"])
    w = Window.partitionBy("source_key", "external_id").orderBy("poll_seq")
    rows = rows.withColumns({"p": F.lag("poll_seq").over(w), "ps": F.lag("status").over(w), "pf": F.lag("fingerprint").over(w)})
    changed = F.col("p").isNotNull() & history.state_changed(F.col("ps"), F.col("pf"), F.col("p") == F.col("poll_seq") - 1, F.col("status"), F.col("fingerprint"))
    return rows.groupBy("source_key").agg(F.count(F.lit(1)).alias("rows_seen"), F.count_if(changed).alias("changed"))


_RECONCILE = f"""WITH {SNAPSHOTS}, cut AS (SELECT max(poll_at) AS last FROM snaps), before AS (
  SELECT r.*, CASE WHEN r.poll_at = (SELECT max(poll_at) FROM pollq p, cut WHERE p.poll_at < cut.last) THEN 1 ELSE 0 END AS act,
         row_number() OVER (PARTITION BY source_key, external_id ORDER BY poll_seq DESC) AS rn FROM runs r, cut WHERE r.poll_at < cut.last
), old AS (SELECT * FROM before WHERE rn = 1), snap AS (SELECT f.* FROM fps f, cut WHERE f.poll_at = cut.last)
SELECT coalesce(o.source_key, s.source_key) AS source_key, coalesce(o.external_id, s.external_id) AS external_id,
  CASE WHEN o.source_key IS NULL THEN 'new' WHEN s.source_key IS NULL THEN 'closed' WHEN o.act = 0 OR o.status <> s.status OR o.fp <> s.fp THEN 'updated' ELSE 'unchanged' END AS change,
  CASE WHEN s.source_key IS NULL THEN o.status ELSE s.status END AS status, s.source_key IS NOT NULL AS is_active
FROM old o FULL JOIN snap s ON o.source_key = s.source_key AND o.external_id = s.external_id WHERE s.source_key IS NOT NULL OR o.act = 1"""


@query("h04_reconcile", _RECONCILE)
def h04(spark, sf):
    s = snapshots(spark, sf)
    p = polls(s)
    last = F.lit(s.agg(F.max("poll_at")).first()[0])
    state = history.final_state(s.filter(F.col("poll_at") < last), p.filter(F.col("poll_at") < last))
    out = history.reconcile(state, s.filter(F.col("poll_at") == last), p.filter(F.col("poll_at") == last))
    return out.select("source_key", "external_id", "change", "status", "is_active")


@query("h05_closures", f"WITH {SNAPSHOTS} SELECT source_key, external_id, observed_at, '{{\"reason\":\"absent_from_feed\"}}' AS properties FROM changes WHERE change = 'closed'")
def h05(spark, sf):
    return _log(spark, sf).filter("change = 'closed'").select("source_key", "external_id", seconds("observed_at").alias("observed_at"), "properties")


@query("h06_reappearances", f"WITH {SNAPSHOTS} SELECT source_key, external_id, poll_at AS observed_at FROM runs WHERE p_seq IS NOT NULL AND p_seq < poll_seq - 1")
def h06(spark, sf):
    from pyspark.sql import Window

    log = _log(spark, sf)
    w = Window.partitionBy("source_key", "external_id").orderBy("observed_at", F.col("change") != "closed")
    return log.withColumn("p", F.lag("change").over(w)).filter("change = 'updated' AND p = 'closed'").select("source_key", "external_id", seconds("observed_at").alias("observed_at"))


def _typed(snaps: DataFrame) -> DataFrame:
    """Snapshots whose properties hold numbers, booleans, nulls, quotes and nested values."""
    k = F.get_json_object("properties", "$.k").cast("int")
    text = F.format_string('{"k": %d, "where": {"a": [%d, "x", false]}, "customer_quantity": %d.5, "major": %s, "none": null, "note": "say \\"%s\\"", "status": "raw"}', k, k, k, k % 2 == 0, "status")
    return snaps.withColumn("properties", text)


def _typed_sql(k: str = "k", between: str = "", status: str = "'\"' || status || '\"'") -> str:
    """The same properties, keys in order."""
    return f"""'{{"customer_quantity":' || k || '.5,"k":' || {k} || ',"major":' || CASE WHEN k % 2 = 0 THEN 'true' ELSE 'false' END || ',"none":null,"note":"say \\"' || status || '\\"",{between}"status":' || {status} || ',"where":{{"a":[' || k || ',"x",false]}}}}'"""


@query("h07_current_state", f"WITH {SNAPSHOTS} SELECT source_key, external_id, first_seen_at, last_seen_at, is_active, status, fp AS fingerprint, category, {_typed_sql()} AS properties FROM state")
def h07(spark, sf):
    s = _typed(snapshots(spark, sf))
    state = history.final_state(s, polls(s))
    return state.select("source_key", "external_id", seconds("first_seen_at").alias("first_seen_at"), seconds("last_seen_at").alias("last_seen_at"), "is_active", "status", "fingerprint", "category", "properties")


_SOURCE_TIME = """"source_time":"' || strftime(ts, '%Y-%m-%dT%H:%M:%S+00:00') || '","""


@query("h08_observation_properties", f"""WITH {SNAPSHOTS} SELECT source_key, external_id, poll_at, {_typed_sql(between=_SOURCE_TIME, status="'\"raw\"'")} AS properties FROM snaps""")
def h08(spark, sf):
    s = _typed(snapshots(spark, sf))
    return s.select("source_key", "external_id", seconds("poll_at").alias("poll_at"), history.with_source_time(F.col("properties"), F.col("source_time")).alias("properties"))


@query("h09_replay", f"WITH {SNAPSHOTS} SELECT source_key, external_id, observed_at, change, status, fp AS fingerprint, category FROM changes")
def h09(spark, sf):
    return _log(spark, sf).select("source_key", "external_id", seconds("observed_at").alias("observed_at"), "change", "status", "fingerprint", "category")


@query("h10_entities", f"""WITH {SNAPSHOTS} SELECT source_key, external_id, CASE WHEN is_active THEN status ELSE 'Closed' END AS status, last_seen_at FROM state
WHERE (is_active OR last_seen_at >= epoch(TIMESTAMP '2024-01-31 00:00:00') - 2880 * 60) AND lon BETWEEN {BOX[0]} AND {BOX[2]} AND lat BETWEEN {BOX[1]} AND {BOX[3]}""")
def h10(spark, sf):
    out = history.entities(_state(spark, sf), F.lit("2024-01-31 00:00:00").cast("timestamp"), closed_within=2880, bbox=BOX)
    return out.select("source_key", "external_id", "status", seconds("last_seen_at").alias("last_seen_at"))


@query("h10_inactive_entities", f"WITH {SNAPSHOTS} SELECT source_key, external_id, 'Closed' AS status FROM state WHERE NOT is_active AND source_key = 'src1' AND category = 'c1'")
def h10b(spark, sf):
    return history.entities(_state(spark, sf), now(), active=False, source="src1", category="c1").select("source_key", "external_id", "status")


@query("h11_entity_detail", f"WITH {SNAPSHOTS} SELECT source_key, external_id, is_active, CASE WHEN is_active THEN status ELSE 'Closed' END AS status, first_seen_at FROM state WHERE external_id IN ('5', '17')")
def h11(spark, sf):
    s = _state(spark, sf).filter(F.col("external_id").isin("5", "17"))
    return s.select("source_key", "external_id", "is_active", history.shown_status(F.col("is_active"), F.col("status")).alias("status"), seconds("first_seen_at").alias("first_seen_at"))


@query("h12_tracks", f"WITH {SNAPSHOTS} SELECT source_key, external_id, segment, count(*) AS steps, string_agg(observed_at || ':' || status, ' ' ORDER BY observed_at, status, lon) AS track FROM (SELECT *, (row_number() OVER (PARTITION BY source_key, external_id ORDER BY observed_at, status, lon) - 1) // 16 AS segment FROM changes) GROUP BY source_key, external_id, segment")
def h12(spark, sf):
    t = history.tracks(_log(spark, sf), steps=16)
    return t.select("source_key", "external_id", "segment", F.size("track").cast("long").alias("steps"), F.array_join(F.transform("track", lambda x: F.concat(F.unix_seconds(x["observed_at"]).cast("string"), F.lit(":"), x["status"])), " ").alias("track"))


@query("h13_observations", f"""WITH {SNAPSHOTS} SELECT source_key, external_id, observed_at, status FROM changes WHERE source_key = 'src2' AND observed_at BETWEEN epoch(TIMESTAMP '2024-01-05') AND epoch(TIMESTAMP '2024-01-12')
ORDER BY observed_at DESC, source_key, external_id LIMIT 50000""")
def h13(spark, sf):
    """From stored history, which source and days choose the folders of."""
    path = new_path(spark, "history")
    history.append_observations(_log(spark, sf), path, "all")
    at = lambda d: F.lit(d).cast("timestamp")
    found = history.observations(history.stored_observations(spark, path), source="src2", start=at("2024-01-05"), end=at("2024-01-12"), limit=50000)
    return found.select("source_key", "external_id", seconds("observed_at").alias("observed_at"), "status")


_OWN_KEY = """"source_key":"' || source_key || '","""


@query("h14_property_precedence", f"""WITH {SNAPSHOTS} SELECT source_key, external_id, {_typed_sql(k="'[1,null]'", between=_OWN_KEY)} AS entity, {_typed_sql(between=_OWN_KEY)} AS observation FROM state""")
def h14(spark, sf):
    s = _typed(snapshots(spark, sf))
    own = F.format_string('{"k": [1, null], "source_key": "%s"}', "source_key")
    e, o = history.entity_properties(F.col("properties"), own), history.observation_properties(F.col("properties"), own)
    return history.final_state(s, polls(s)).select("source_key", "external_id", e.alias("entity"), o.alias("observation"))


@query("h15_last_runs", f"WITH {SNAPSHOTS}, per AS (SELECT source_key, poll_at, count(*) AS n FROM snaps GROUP BY 1, 2) SELECT source_key, max(poll_at) AS last_run_at, 'ok' AS last_status, arg_max(n, poll_at) AS last_count FROM per GROUP BY source_key")
def h15(spark, sf):
    runs = snapshots(spark, sf).groupBy("source_key", F.col("poll_at").alias("run_at")).agg(F.count(F.lit(1)).alias("count")).withColumns({"status": F.lit("ok"), "error": F.lit(None).cast("string")})
    return history.last_runs(runs).select("source_key", seconds("last_run_at").alias("last_run_at"), "last_status", "last_count")


@query("h16_outage_rollup", f"""WITH {SNAPSHOTS}, s AS (SELECT unnest(['c0', 'c1', 'c2', 'c9']) AS service)
SELECT service, count(st.category) AS outages, round(coalesce(sum(CASE WHEN customer_quantity > 0 THEN customer_quantity END), 0), 4) AS customers FROM s LEFT JOIN state st ON st.category = service AND st.is_active GROUP BY service""")
def h16(spark, sf):
    s = snapshots(spark, sf)
    q = s.groupBy("source_key", "external_id").agg(F.max_by("customer_quantity", "poll_at").alias("customer_quantity"))
    state = history.final_state(s, polls(s)).join(q, ["source_key", "external_id"])
    services = state.select(F.explode(F.array(*map(F.lit, ["c0", "c1", "c2", "c9"]))).alias("service")).distinct()
    return history.outage_rollup(state, services).withColumn("customers", F.round("customers", 4))


@query("h17_facets", f"WITH {SNAPSHOTS} SELECT DISTINCT status AS value FROM state WHERE status <> ''")
def h17(spark, sf):
    return history.facet(_state(spark, sf), "status")


@query("h18_feature_filter", f"""WITH {SNAPSHOTS}, f AS (SELECT *, CASE WHEN is_active THEN status ELSE 'Closed' END AS shown FROM state)
SELECT source_key, external_id, shown AS status FROM f WHERE source_key || ':' || category IN ('src0:c0', 'src1:c1', 'src3:c2') AND shown <> 'Closed' AND contains(lower('User ' || external_id || ' ' || shown), 'user 1')""")
def h18(spark, sf):
    f = _state(spark, sf).withColumns({"status": history.shown_status(F.col("is_active"), F.col("status")), "title": F.concat(F.lit("User "), "external_id"), "location": F.lit("")})
    return history.feature_filter(f, ["src0:c0", "src1:c1", "src3:c2"], hide_closed=True, search="USER 1").select("source_key", "external_id", "status")


@query("h19_labels", f"WITH {SNAPSHOTS} SELECT source_key, external_id, CASE status WHEN 'view' THEN 'Seen' ELSE upper(status[1]) || substring(status, 2) END AS label, 'user ' || external_id AS title FROM state")
def h19(spark, sf):
    s = _state(spark, sf)
    return s.select("source_key", "external_id", history.status_label(F.col("status"), {"view": "Seen"}).alias("label"), history.advisory_title(F.concat("label", F.lit(" : more"))).alias("title"))


@query("h20_fold_changes", f"WITH {SNAPSHOTS} SELECT source_key, external_id, status FROM state WHERE is_active")
def h20(spark, sf):
    return history.fold_changes(_log(spark, sf)).select("source_key", "external_id", "status")


@query("s16_append_history", f"WITH {SNAPSHOTS} SELECT source_key, strftime(make_timestamp(observed_at * 1000000), '%Y-%m-%d') AS observed_date, count(*) AS observations FROM changes GROUP BY 1, 2")
def s16(spark, sf):
    """Two batches, the second written twice as after a failure."""
    path, log = new_path(spark, "history"), _log(spark, sf)
    early = F.col("observed_at") < F.lit("2024-01-10 12:00:00").cast("timestamp")
    history.append_observations(log.filter(early), path, "1")
    for _ in range(2):
        history.append_observations(log.filter(~early), path, "2")
    back = history.stored_observations(spark, path)
    return back.groupBy("source_key", F.date_format("observed_date", "yyyy-MM-dd").alias("observed_date")).agg(F.count(F.lit(1)).alias("observations"))


@query("s17_keyed_upsert", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'new' ELSE o_orderstatus END AS status, o_custkey AS customer FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 3 = 1 UNION ALL SELECT o_orderkey, 'new', -1 FROM orders WHERE o_orderkey % 2 = 1 AND o_orderkey % 3 <> 1")
def s17(spark, sf):
    o = read(spark, sf, "orders")
    # each order is stored, in the batch, or both
    stored = o.filter("o_orderkey % 2 = 0 OR o_orderkey % 3 = 1").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.col("o_custkey").alias("customer"))
    rows = o.filter("o_orderkey % 3 = 0 OR (o_orderkey % 2 = 1 AND o_orderkey % 3 <> 1)").select(F.col("o_orderkey").alias("id"), F.lit("new").alias("status"), F.lit(-1).cast("long").alias("customer"))
    table = KeyedTable(spark, new_path(spark, "orders"), ["id"])
    table.upsert(stored, ["status"], 0)
    table.upsert(rows, ["status"], 1)
    return table.read()


@query("s18_registry_sync", "SELECT c_custkey, count(o_orderkey) AS orders FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1) GROUP BY c_custkey")
def s18(spark, sf):
    c = read(spark, sf, "customer").withColumnRenamed("c_nationkey", "k")
    registry = read(spark, sf, "nation").filter("n_regionkey = 1").select(F.col("n_nationkey").alias("k"))
    kept, _ = history.registry_sync(c, read(spark, sf, "nation").withColumnRenamed("n_nationkey", "nk"), registry, "k", "nk")
    orders = read(spark, sf, "orders").join(kept.select(F.col("c_custkey").alias("o_custkey")), "o_custkey", "left_semi")
    return orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("o_orderkey").alias("orders"))


@query("s19_features", f"""WITH {SNAPSHOTS} SELECT external_id, lon, lat, source_key, replace({_typed_sql(between=_OWN_KEY)}, '"k":', '"external_id":"' || external_id || '","k":') AS properties FROM state""")
def s19(spark, sf):
    s = _typed(snapshots(spark, sf))
    own = F.format_string('{"source_key": "%s", "external_id": "%s"}', "source_key", "external_id")
    f = history.features(history.final_state(s, polls(s)), history.entity_properties(F.col("properties"), own))
    g = lambda p: F.get_json_object("value", p)
    return f.select(
        g("$.properties.external_id").alias("external_id"), g("$.geometry.coordinates[0]").cast("double").alias("lon"), g("$.geometry.coordinates[1]").cast("double").alias("lat"), g("$.properties.source_key").alias("source_key"),
        F.regexp_extract("value", r'"properties":(.*)\}$', 1).alias("properties"),
    )


@query("s20_change_messages", f"WITH {SNAPSHOTS} SELECT source_key, observed_at, coalesce(string_agg(external_id, ',' ORDER BY external_id) FILTER (WHERE change = 'new'), '') AS new, coalesce(string_agg(external_id, ',' ORDER BY external_id) FILTER (WHERE change = 'updated'), '') AS updated, coalesce(string_agg(external_id, ',' ORDER BY external_id) FILTER (WHERE change = 'closed'), '') AS closed FROM changes GROUP BY 1, 2")
def s20(spark, sf):
    m = history.change_messages(_log(spark, sf))
    return m.select("source_key", seconds("observed_at").alias("observed_at"), *[F.array_join(c, ",").alias(c) for c in ("new", "updated", "closed")])


# ---- places --------------------------------------------------------------------------------------------------------


@query("g01_bbox", f"WITH {SNAPSHOTS} SELECT source_key, external_id, poll_at FROM snaps WHERE lon BETWEEN {BOX[0]} AND {BOX[2]} AND lat BETWEEN {BOX[1]} AND {BOX[3]}")
def g01(spark, sf):
    box = geo.parse_bbox(",".join(map(str, BOX)))
    return snapshots(spark, sf).filter(geo.in_bbox(F.col("lon"), F.col("lat"), box)).select("source_key", "external_id", seconds("poll_at").alias("poll_at"))


_SQL_MILES = "2 * 3958.8 * asin(sqrt(pow(sin((radians({a}) - radians({c})) / 2), 2) + cos(radians({c})) * cos(radians({a})) * pow(sin((radians({b}) - radians({d})) / 2), 2)))"
_FROM_CENTER = _SQL_MILES.format(a="lat", b="lon", c=CENTER[0], d=CENTER[1])


@query("g02_haversine", f"WITH {SNAPSHOTS} SELECT source_key, external_id, round({_FROM_CENTER}, 5) AS miles FROM state")
def g02(spark, sf):
    d = geo.haversine_miles(F.lit(CENTER[0]), F.lit(CENTER[1]), F.col("lat"), F.col("lon"))
    return _state(spark, sf).select("source_key", "external_id", F.round(d, 5).alias("miles"))


#: A box that only some entities' triangles reach.
_FAR_BOX = (-85.25, 35.1, -85.2, 35.13)


@query("g01_shapes_in_box", f"""WITH {SNAPSHOTS}, q AS (SELECT DISTINCT source_key, external_id, lon, lat FROM snaps)
SELECT source_key, external_id, round(lon, 4) AS lon FROM q WHERE lon <= {_FAR_BOX[2]} AND lat <= {_FAR_BOX[3]} AND greatest(lon, {_FAR_BOX[0]}) - lon + greatest(lat, {_FAR_BOX[1]}) - lat <= 0.1""")
def g01b(spark, sf):
    """Triangles of a tenth of a degree right and up from each place: those that touch a box."""
    s = snapshots(spark, sf).select("source_key", "external_id", "lon", "lat").distinct()
    ring = F.format_string("[[[%s,%s],[%s,%s],[%s,%s],[%s,%s]]]", "lon", "lat", "lon", F.col("lat") + 0.1, F.col("lon") + 0.1, "lat", "lon", "lat")
    shapes = s.withColumn("geometry", F.concat(F.lit('{"type":"Polygon","coordinates":'), ring, F.lit("}")))
    return shapes.filter(geo.shape_meets_box("geometry", *map(F.lit, _FAR_BOX))).select("source_key", "external_id", F.round("lon", 4).alias("lon"))


#: Metres by the radii of curvature in the middle of a short way: within a millionth of the geodesic on the given places.
_SQL_SPHEROID = f"""sqrt(pow(6378137.0 * (1 - 0.00669437999014) / pow(1 - 0.00669437999014 * pow(sin(radians((lat + {CENTER[0]}) / 2)), 2), 1.5) * radians(lat - {CENTER[0]}), 2)
  + pow(6378137.0 / sqrt(1 - 0.00669437999014 * pow(sin(radians((lat + {CENTER[0]}) / 2)), 2)) * cos(radians((lat + {CENTER[0]}) / 2)) * radians(lon - ({CENTER[1]})), 2))"""


@query("g03_spheroid_distance", f"WITH {SNAPSHOTS} SELECT source_key, external_id, round_even({_SQL_SPHEROID} / 1609.344, 1) AS distance_miles FROM state")
def g03(spark, sf):
    s = _state(spark, sf)
    return s.select("source_key", "external_id", F.bround(geo.spheroid_meters("lat", "lon", F.lit(CENTER[0]), F.lit(CENTER[1])) / geo.METERS_PER_MILE, 1).alias("distance_miles"))


@query("g04_within_miles", f"WITH {SNAPSHOTS} SELECT source_key, external_id FROM state WHERE {_FROM_CENTER} <= 1.7")
def g04(spark, sf):
    s = _state(spark, sf)
    near = geo.near_box(F.col("lat"), F.col("lon"), *CENTER, 1.7) & (geo.haversine_miles(F.lit(CENTER[0]), F.lit(CENTER[1]), F.col("lat"), F.col("lon")) <= 1.7)
    return s.filter(near).select("source_key", "external_id")


_RAW_MILES = _SQL_MILES.format(a="latitude", b="longitude", c=CENTER[0], d=CENTER[1])


@query("g05_ingest_radius", f"WITH {RAW_EVENTS} SELECT source_name, count(*) AS kept, count(latitude) AS located FROM raws WHERE latitude IS NULL OR {_RAW_MILES} <= 0.8 GROUP BY source_name")
def g05(spark, sf):
    r = listings.within_radius(raw_events(spark, sf), CENTER, 0.8)
    return r.groupBy("source_name").agg(F.count(F.lit(1)).alias("kept"), F.count("latitude").alias("located"))


@query("g06_ewkt", f"WITH {SNAPSHOTS} SELECT source_key, external_id, 'SRID=4326;POINT(' || CAST(lon AS VARCHAR) || ' ' || CAST(lat AS VARCHAR) || ')' AS ewkt FROM state")
def g06(spark, sf):
    return _state(spark, sf).select("source_key", "external_id", geo.ewkt_point(F.col("lat"), F.col("lon")).alias("ewkt"))


def _addresses(spark, sf):
    s = read(spark, sf, "supplier")
    return s.select(F.col("s_suppkey").alias("k"), F.concat_ws(", ", F.concat(F.lit("Hall "), F.col("s_suppkey").cast("string")), F.concat((F.col("s_suppkey") % 7).cast("string"), F.lit(" Main St")), F.lit("Town"), F.lit("TN"), F.concat(F.lit("374"), (F.col("s_suppkey") % 5).cast("string"))).alias("address"))


_ADDRESSES = "adr AS (SELECT s_suppkey AS k, 'Hall ' || s_suppkey || ', ' || (s_suppkey % 7) || ' Main St, Town, TN, 374' || (s_suppkey % 5) AS address FROM supplier)"


def _gazetteer(spark, sf):
    a = _addresses(spark, sf)
    street = F.expr("substring_index(address, ', ', -4)")
    return a.filter("k % 2 = 0").select(street.alias("query"), (F.col("k") % 7).cast("double").alias("latitude"), (F.col("k") % 5).cast("double").alias("longitude")).distinct()


_GAZ = "gaz AS (SELECT DISTINCT (k % 7) || ' Main St, Town, TN, 374' || (k % 5) AS query, CAST(k % 7 AS DOUBLE) AS latitude, CAST(k % 5 AS DOUBLE) AS longitude FROM adr WHERE k % 2 = 0)"


@query("g07_geocode", f"WITH {_ADDRESSES}, {_GAZ} SELECT a.address, g.latitude, g.longitude FROM adr a LEFT JOIN gaz g ON g.query = (a.k % 7) || ' Main St, Town, TN, 374' || (a.k % 5)")
def g07(spark, sf):
    return places.geocode(_addresses(spark, sf), _gazetteer(spark, sf))


@query("g08_lookup_keys", f"WITH {_ADDRESSES} SELECT k, 0 AS n, address AS query FROM adr UNION ALL SELECT k, 1, (k % 7) || ' Main St, Town, TN, 374' || (k % 5) FROM adr")
def g08(spark, sf):
    return _addresses(spark, sf).select("k", F.posexplode(places.lookup_keys(F.col("address"))).alias("n", "query"))


@query("g09_geocode_retry", f"""WITH {_ADDRESSES}, {_GAZ}, due AS (SELECT * FROM (SELECT address, k, 1704067200 + k % 40 * 3600 AS tried FROM adr) WHERE tried < 1704067200 + 48 * 3600 - 24 * 3600 ORDER BY tried, address LIMIT 25)
SELECT d.address, g.latitude, g.longitude FROM due d LEFT JOIN gaz g ON g.query = (d.k % 7) || ' Main St, Town, TN, 374' || (d.k % 5)""")
def g09(spark, sf):
    a = _addresses(spark, sf)
    none = F.lit(None).cast("double")
    cache = a.select("address", none.alias("latitude"), none.alias("longitude"), F.timestamp_seconds(F.lit(1704067200) + F.col("k") % 40 * 3600).alias("last_attempted_at"))
    events = a.select("k", "address", none.alias("latitude"), none.alias("longitude"))
    _, _, tried = places.retry(cache, events, _gazetteer(spark, sf), F.timestamp_seconds(F.lit(1704067200 + 48 * 3600)), 24, 25)
    return tried.select("address", "latitude", "longitude")


# ---- stories -------------------------------------------------------------------------------------------------------

_STOP = ", ".join(f"'{w}'" for w in text.HEADLINE_STOPWORDS)
_SQL_TOKENS = r"list_distinct(list_filter(regexp_extract_all(lower({c}), '[a-z0-9'']+'), lambda w: (regexp_full_match(w, '[0-9]+') OR length(w) > 2) AND w NOT IN (" + _STOP + ")))"


@query("n01_headline_tokens", f"WITH {ARTICLES} SELECT id, array_to_string(list_sort({_SQL_TOKENS.format(c='title')}), ' ') AS tokens FROM arts")
def n01(spark, sf):
    return articles(spark, sf).select("id", F.array_join(F.array_sort(text.headline_tokens(F.col("title"))), " ").alias("tokens"))


@query("n02_token_weights", f"WITH {ARTICLES}, t AS (SELECT unnest({_SQL_TOKENS.format(c='title')}) AS token FROM arts), n AS (SELECT count(*) AS n FROM arts) SELECT token, count(*) AS df, round(ln((any_value(n.n) + 1.0) / (count(*) + 1.0)), 6) AS weight FROM t, n GROUP BY token")
def n02(spark, sf):
    return stories.token_weights(articles(spark, sf), text.headline_tokens(F.col("title"))).select("token", "df", F.round("weight", 6).alias("weight"))


@query("n05_number_tokens", f"WITH {ARTICLES} SELECT id, len(list_filter({_SQL_TOKENS.format(c='summary')}, lambda w: regexp_full_match(w, '[0-9]+') AND NOT regexp_full_match(w, '(19|20)..'))) AS numbers FROM arts")
def n05(spark, sf):
    return articles(spark, sf).select("id", F.size(text.number_tokens(text.headline_tokens(F.col("summary")))).cast("long").alias("numbers"))


@query("n06_column_keys", f"WITH {ARTICLES} SELECT id, array_to_string(list_transform(regexp_extract_all(lower(title), '[a-z0-9]+'), lambda w: CASE WHEN length(w) > 3 AND w LIKE '%s' THEN substring(w, 1, length(w) - 1) ELSE w END), ' ') AS column_key FROM arts")
def n06(spark, sf):
    return articles(spark, sf).select("id", text.column_key(F.col("title")).alias("column_key"))


_MATCH_SQL = f"""WITH {ARTICLES}, p AS (
  SELECT id, source_id, published AS pub, {_SQL_TOKENS.format(c='title')} AS t, CASE WHEN length(summary) >= 40 THEN {_SQL_TOKENS.format(c="title || ' ' || summary")} END AS x, {_SQL_TOKENS.format(c="title || ' ' || summary")} AS x_all,
         array_to_string(list_transform(regexp_extract_all(lower(title), '[a-z0-9]+'), lambda w: CASE WHEN length(w) > 3 AND w LIKE '%s' THEN substring(w, 1, length(w) - 1) ELSE w END), ' ') AS ck FROM arts
), n AS (SELECT count(*) AS n FROM p), tw AS (SELECT token, ln(((SELECT n FROM n) + 1.0) / (count(*) + 1.0)) AS w FROM (SELECT unnest(t) AS token FROM p) GROUP BY token),
xw AS (SELECT token, ln(((SELECT n FROM n) + 1.0) / (count(*) + 1.0)) AS w FROM (SELECT unnest(x_all) AS token FROM p) GROUP BY token),
tot AS (SELECT id, sum(w) AS w FROM (SELECT id, unnest(t) AS token FROM p) JOIN tw USING (token) GROUP BY id),
sh AS (SELECT a.id AS a, b.id AS b, sum(w) AS w, count(*) AS c FROM (SELECT id, pub, unnest(t) AS token FROM p) a JOIN (SELECT id, pub, unnest(t) AS token FROM p) b ON a.token = b.token AND (a.pub < b.pub OR (a.pub = b.pub AND a.id < b.id)) AND b.pub - a.pub <= 129600 JOIN tw ON tw.token = a.token GROUP BY 1, 2),
sc AS (SELECT sh.*, sh.w / (ta.w + tb.w - sh.w) AS j, sh.w / least(ta.w, tb.w) AS k FROM sh JOIN tot ta ON ta.id = sh.a JOIN tot tb ON tb.id = sh.b WHERE ta.w + tb.w - sh.w > 0),
ok AS (SELECT sc.*, pa.x AS xa, pb.x AS xb FROM sc JOIN p pa ON pa.id = sc.a JOIN p pb ON pb.id = sc.b WHERE (j >= 0.35 OR (j >= 0.30 AND c >= 2 AND k >= 0.45)) AND NOT (pa.source_id = pb.source_id AND pa.ck = pb.ck AND abs(pa.pub - pb.pub) > 43200)
  AND NOT (len(list_filter(pa.t, lambda q: regexp_full_match(q, '[0-9]+') AND NOT regexp_full_match(q, '(19|20)..'))) > 0 AND len(list_filter(pb.t, lambda q: regexp_full_match(q, '[0-9]+') AND NOT regexp_full_match(q, '(19|20)..'))) > 0
           AND NOT list_has_any(list_filter(pa.t, lambda q: regexp_full_match(q, '[0-9]+') AND NOT regexp_full_match(q, '(19|20)..')), list_filter(pb.t, lambda q: regexp_full_match(q, '[0-9]+') AND NOT regexp_full_match(q, '(19|20)..'))))),
tx AS (SELECT a, b, sum(CASE WHEN list_contains(xa, u.token) AND list_contains(xb, u.token) THEN w ELSE 0 END) / nullif(sum(w), 0) AS tj FROM (SELECT a, b, xa, xb, unnest(list_distinct(list_concat(xa, xb))) AS token FROM ok WHERE xa IS NOT NULL AND xb IS NOT NULL) u JOIN xw ON xw.token = u.token GROUP BY a, b)
SELECT ok.a, ok.b, round(j, 6) AS jaccard, round(k, 6) AS containment, round(coalesce(tx.tj, CASE WHEN xa IS NULL OR xb IS NULL THEN NULL ELSE 0 END), 6) AS text_jaccard FROM ok LEFT JOIN tx ON tx.a = ok.a AND tx.b = ok.b WHERE xa IS NULL OR xb IS NULL OR coalesce(tx.tj, 0) >= 0.12"""


@query("n08_matches", _MATCH_SQL)
def n08(spark, sf):
    a = articles(spark, sf)
    m = stories.matches(a, a)
    return m.select("a", "b", *[F.round(c, 6).alias(c) for c in ("jaccard", "containment", "text_jaccard")])


def _clustered(spark, sf):
    a = articles(spark, sf)
    return a.join(stories.assign_clusters(a, a), "id")


@query("n09_assign_clusters", None)
def n09(spark, sf):
    return _clustered(spark, sf).select("id", "cluster_id")


@query("n10_recluster", None)
def n10(spark, sf):
    return stories.recluster(articles(spark, sf), F.lit("2024-01-08 00:00:00").cast("timestamp")).select("id", "cluster_id")


def _sql_topics(table, hay):
    return " ".join(f"WHEN {' OR '.join(f'contains({hay}, {chr(39)}{w}{chr(39)})' for w in words)} THEN '{k}'" for k, words in table.items())


@query("n11_classify", f"""WITH {ARTICLES}, h AS (SELECT *, ' ' || lower(title || ' ' || summary) || ' ' AS hay FROM arts)
SELECT id, CASE WHEN lang = 'en' THEN 'sports' WHEN lang = 'de' THEN 'news' {_sql_topics(stories.TOPICS, 'hay')} ELSE feed_category END AS category FROM h""")
def n11(spark, sf):
    tags = F.when(F.col("lang") == "en", F.array(F.lit("Local"), F.lit(" Sports "))).when(F.col("lang") == "de", F.array(F.lit("Top Stories"), F.lit("x"))).otherwise(F.array(F.lit("x")))
    return articles(spark, sf).select("id", stories.classify(F.col("title"), F.col("summary"), tags, F.col("feed_category")).alias("category"))


def _sql_keys(table, hay):
    return "list_filter([" + ", ".join(f"CASE WHEN {' OR '.join(f'contains({hay}, {chr(39)}{w}{chr(39)})' for w in words)} THEN '{k}' END" for k, words in table.items()) + "], lambda x: x IS NOT NULL)"


@query("n12_keyword_keys", f"WITH h AS (SELECT doc_id, ' ' || lower(text) || ' ' AS hay FROM documents) SELECT doc_id, array_to_string({_sql_keys(listings.TOPICS, 'hay')}, ' ') AS topics FROM h")
def n12(spark, sf):
    return read(spark, sf, "documents").select("doc_id", F.array_join(text.keyword_keys(F.col("text"), listings.TOPICS), " ").alias("topics"))


@query("n13_upsert_articles", f"""WITH {ARTICLES}, old AS (SELECT source_id, guid, id, 'old' AS category, published FROM (SELECT *, row_number() OVER (PARTITION BY source_id, guid ORDER BY id) AS rn FROM arts WHERE id % 2 = 0 OR id % 3 = 1) WHERE rn = 1),
new AS (SELECT source_id, guid, id, 'new' AS category, least(published, fetched_at) AS published FROM (SELECT *, row_number() OVER (PARTITION BY source_id, guid ORDER BY id) AS rn FROM arts WHERE id % 3 = 0 OR (id % 2 = 1 AND id % 3 <> 1)) WHERE rn = 1)
SELECT coalesce(o.source_id, n.source_id) AS source_id, coalesce(o.guid, n.guid) AS guid, coalesce(o.id, n.id) AS id, coalesce(n.category, o.category) AS category, coalesce(o.published, n.published) AS published FROM old o FULL JOIN new n ON o.source_id = n.source_id AND o.guid = n.guid""")
def n13(spark, sf):
    a = articles(spark, sf).select("source_id", "guid", "id", "published", "fetched_at")
    stored = stories.first_of_batch(a.filter("id % 2 = 0 OR id % 3 = 1"), ["source_id", "guid"], ["id"]).withColumn("category", F.lit("old"))
    out = stories.upsert_articles(stored, a.filter("id % 3 = 0 OR (id % 2 = 1 AND id % 3 <> 1)").withColumn("category", F.lit("new")), ["id"])
    return out.select("source_id", "guid", "id", "category", seconds("published").alias("published"))


@query("n14_clamp_future", f"WITH {ARTICLES} SELECT id, least(published, fetched_at) AS published FROM arts")
def n14(spark, sf):
    return articles(spark, sf).select("id", F.unix_seconds(stories.clamp_future(F.col("published"), F.col("fetched_at"))).alias("published"))


def _by_source(spark, sf):
    """Articles in stories of a day and outlet pair, for the story rows alone."""
    a = articles(spark, sf)
    return a.withColumns({"cluster_id": F.floor(F.col("id") / 7), "category": F.when(F.col("id") % 3 == 0, "news").otherwise(F.concat(F.lit("k"), (F.col("id") % 2).cast("string"))), "source_slug": F.concat(F.lit("o"), F.col("source_id").cast("string")), "source_name": F.concat(F.lit("Outlet "), F.col("source_id").cast("string")), "image_url": F.when(F.col("id") % 4 == 1, F.concat(F.lit("i"), F.col("id").cast("string")))})


_STORY_SQL = f"""WITH {ARTICLES}, r AS (SELECT *, id // 7 AS cluster_id, CASE WHEN id % 3 = 0 THEN 'news' ELSE 'k' || (id % 2) END AS category, CASE WHEN id % 4 = 1 THEN 'i' || id END AS image_url FROM arts),
v AS (SELECT cluster_id, category, count(*) AS n, min(id) AS f FROM r GROUP BY 1, 2), top AS (SELECT cluster_id, category, row_number() OVER (PARTITION BY cluster_id ORDER BY n DESC, category <> 'news' DESC, f) AS rn FROM v),
l AS (SELECT cluster_id, source_id, min(id) AS id FROM r GROUP BY 1, 2), ll AS (SELECT cluster_id, count(*) AS source_count, string_agg(source_id, ',' ORDER BY id) AS sources FROM l GROUP BY 1)
SELECT r.cluster_id AS id, arg_min(title, id) AS title, any_value(top.category) AS category, arg_min(image_url, id) FILTER (WHERE image_url IS NOT NULL) AS image_url, min(published) AS first_published, max(published) AS latest_published, any_value(ll.source_count) AS source_count, count(*) AS article_count, any_value(ll.sources) AS sources
FROM r JOIN top ON top.cluster_id = r.cluster_id AND top.rn = 1 JOIN ll ON ll.cluster_id = r.cluster_id GROUP BY r.cluster_id"""


@query("n15_build_stories", _STORY_SQL)
def n15(spark, sf):
    s = stories.build_stories(_by_source(spark, sf))
    return s.select("id", "title", "category", "image_url", seconds("first_published").alias("first_published"), seconds("latest_published").alias("latest_published"), F.col("source_count").cast("long").alias("source_count"), "article_count", F.array_join(F.transform("sources", lambda x: F.substring(x["slug"], F.lit(2), F.lit(9))), ",").alias("sources"))


def _outlets(spark, sf):
    return articles(spark, sf).select(F.col("source_id").alias("id")).distinct().withColumns({"slug": F.concat(F.lit("o"), F.col("id").cast("string")), "name": F.concat(F.lit("Outlet "), F.lpad(F.col("id").cast("string"), 3, "0"))})


@query("n16_get_stories", f"WITH {ARTICLES} SELECT id // 7 AS id, count(*) AS article_count, max(published) AS latest_published FROM arts WHERE published >= epoch(TIMESTAMP '2024-01-07') - 72 * 3600 GROUP BY 1 ORDER BY latest_published DESC, id LIMIT 50")
def n16(spark, sf):
    a = _by_source(spark, sf).drop("source_slug", "source_name")
    return stories.get_stories(a, _outlets(spark, sf), F.lit("2024-01-07").cast("timestamp"), hours=72, limit=50).select("id", "article_count", seconds("latest_published").alias("latest_published"))


@query("n17_feed_health", f"""WITH {ARTICLES}, o AS (SELECT DISTINCT source_id FROM arts), f AS (SELECT source_id, p AS position, 's' || p AS category FROM o, (SELECT unnest([0, 1]) AS p) UNION ALL SELECT 9999, 0, 's0')
SELECT 'o' || f.source_id AS slug, f.category, f.position, (SELECT count(*) FROM arts a WHERE a.source_id = f.source_id) AS article_count FROM f""")
def n17(spark, sf):
    o = _outlets(spark, sf)
    extra = o.limit(1).select(F.lit(9999).alias("id"), F.lit("o9999").alias("slug"), F.lit("None").alias("name"))
    feeds = o.select(F.col("id").alias("source_id"), F.explode(F.array(F.lit(0), F.lit(1))).alias("position")).unionByName(extra.select(F.col("id").alias("source_id"), F.lit(0).alias("position"))).withColumn("category", F.concat(F.lit("s"), F.col("position").cast("string")))
    return stories.feed_health(o.unionByName(extra), feeds, articles(spark, sf)).select("slug", "category", "position", "article_count")


@query("n18_tabs", f"WITH {ARTICLES}, d AS (SELECT * FROM (VALUES ('k1', 0), ('news', 1), ('life', 2), ('k0', 3)) t(category, position)) SELECT * FROM d WHERE category IN (SELECT CASE WHEN id % 3 = 0 THEN 'news' ELSE 'k' || (id % 2) END FROM arts)")
def n18(spark, sf):
    names = F.array(*map(F.lit, ["k1", "news", "life", "k0"]))
    display = read(spark, sf, "region").select(F.posexplode(names).alias("position", "category")).distinct().select("category", "position")
    return stories.tabs(_by_source(spark, sf), display)


@query("n19_lead_image", "SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'https://example.org/' || page_id ELSE nullif(regexp_extract(html, '(?i)<img[^>]+src=[\"'']([^\"'']+)[\"'']', 1), '') END AS image FROM pages")
def n19(spark, sf):
    enclosure = F.array(F.struct(F.when(F.col("page_id") % 2 == 0, "image/png").otherwise("audio/mpeg").alias("type"), F.concat(F.lit("https://example.org/"), F.col("page_id").cast("string")).alias("href")))
    return read(spark, sf, "pages").select("page_id", stories.lead_image(enclosure, F.col("html")).alias("image"))


@query("n20_pair_quality", f"""WITH {ARTICLES}, r AS (SELECT id // 7 AS c, id // 5 AS g FROM arts), both_ AS (SELECT sum(n * (n - 1) / 2) AS p FROM (SELECT count(*) AS n FROM r GROUP BY c, g)), pc AS (SELECT sum(n * (n - 1) / 2) AS p FROM (SELECT count(*) AS n FROM r GROUP BY c)), pg AS (SELECT sum(n * (n - 1) / 2) AS p FROM (SELECT count(*) AS n FROM r GROUP BY g))
SELECT round(both_.p / pc.p, 9) AS precision, round(both_.p / pg.p, 9) AS recall FROM both_, pc, pg""")
def n20(spark, sf):
    a = articles(spark, sf).select(F.floor(F.col("id") / 7).alias("cluster_id"), F.floor(F.col("id") / 5).alias("story"))
    return stories.pair_quality(a).select(F.round("precision", 9).alias("precision"), F.round("recall", 9).alias("recall"))


# ---- listings ------------------------------------------------------------------------------------------------------

_TSTOP = ", ".join(f"'{w}'" for w in text.TITLE_STOPWORDS)
_WORDS = "list_filter(string_split_regex(regexp_replace(lower({c}), '[^a-z0-9 ]', ' ', 'g'), ' +'), lambda w: w <> '')"
_TTOK = f"(CASE WHEN len(list_filter({_WORDS}, lambda w: w NOT IN ({_TSTOP}))) = 0 THEN {_WORDS} ELSE list_filter({_WORDS}, lambda w: w NOT IN ({_TSTOP})) END)"
_NORM = f"array_to_string({_TTOK}, ' ')"
_CKEY = "substring(sha256(" + _NORM.format(c="title") + " || '|' || strftime(make_timestamp(start_time * 1000000), '%Y-%m-%dT%H')), 1, 32)"


@query("e01_normal_titles", f"WITH {RAW_EVENTS} SELECT DISTINCT title, {_NORM.format(c='title')} AS normal FROM raws")
def e01(spark, sf):
    return raw_events(spark, sf).select("title").distinct().select("title", text.normal_title(F.col("title")).alias("normal"))


@query("e02_canonical_keys", f"WITH {RAW_EVENTS} SELECT {_CKEY} AS canonical_key, count(*) AS listings FROM raws GROUP BY 1")
def e02(spark, sf):
    r = raw_events(spark, sf).select(text.canonical_key(F.col("title"), F.col("start_time")).alias("canonical_key"))
    return r.groupBy("canonical_key").agg(F.count(F.lit(1)).alias("listings"))


@query("e03_token_equality", f"""WITH v AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS t FROM part), w AS (SELECT t FROM v UNION SELECT t || 's' FROM v UNION SELECT substring(t, 2) FROM v WHERE length(t) > 1), pairs AS (SELECT a.t AS a, b.t AS b FROM w a, w b)
SELECT a, b FROM pairs WHERE a = b OR (least(length(a), length(b)) >= 5 AND levenshtein(a, b) <= 1)""")
def e03(spark, sf):
    v = read(spark, sf, "part").select(F.explode(F.split("p_name", " ")).alias("t")).distinct()
    w = v.select(F.explode(F.array("t", F.concat("t", F.lit("s")), F.when(F.length("t") > 1, F.substring("t", 2, 1 << 30)))).alias("word")).filter("word IS NOT NULL").distinct()
    return listings.near_words(w).select(F.col("word").alias("a"), F.col("near").alias("b"))


def _titles_at(spark, sf):
    """The order lines as listings, those of equal title, start and venue once; written, so that their titles are read once each and not on every line."""
    r = raw_events(spark, sf)
    once = r.groupBy("title", "start_time", "venue_name").agg(F.min("seq").alias("id"), F.max("latitude").alias("latitude"), F.max("longitude").alias("longitude"))
    return materialize(once.withColumn("address", F.lit(None).cast("string")), "titles-at")


_TOKENS_OF = f"""WITH {RAW_EVENTS}, n AS (SELECT min(seq) AS id, title, start_time AS sec, venue_name, max(latitude) AS latitude, max(longitude) AS longitude FROM raws GROUP BY title, start_time, venue_name),
t AS (SELECT *, sec // 7200 AS bucket FROM (SELECT *, {_TTOK.format(c='title')} AS tokens FROM n) WHERE len(tokens) >= 2), g AS (SELECT tokens, sec, bucket, min(id) AS id FROM t GROUP BY 1, 2, 3),
m AS (SELECT x.tokens AS tx, x.sec AS ax, x.id AS ix, y.tokens AS ty, y.sec AS ay, y.id AS iy FROM g x JOIN (SELECT *, unnest([bucket - 1, bucket, bucket + 1]) AS near FROM g) y ON x.bucket = y.near AND abs(x.sec - y.sec) <= 7200 AND len(x.tokens) <= len(y.tokens)
  WHERE len(list_filter(x.tokens, lambda w: len(list_filter(y.tokens, lambda v: v = w OR (least(length(v), length(w)) >= 5 AND levenshtein(v, w) <= 1))) = 0)) = 0)"""


@query("e04_title_pairs", f"{_TOKENS_OF} SELECT DISTINCT least(ix, iy) AS a, greatest(ix, iy) AS b FROM m WHERE ix <> iy UNION ALL SELECT DISTINCT g.id, t.id FROM t JOIN g ON g.tokens = t.tokens AND g.sec = t.sec WHERE t.id <> g.id")
def e04(spark, sf):
    t = _titles_at(spark, sf)
    return listings.title_pairs(t.select("id", "title", seconds("start_time").alias("at")), 2)


_LOCATED = "CASE WHEN a.latitude IS NOT NULL AND b.latitude IS NOT NULL THEN " + _SQL_MILES.format(a="a.latitude", b="a.longitude", c="b.latitude", d="b.longitude") + " <= 0.5 ELSE a.venue_name = b.venue_name END"


@query("e05_event_pairs", f"{_TOKENS_OF} SELECT DISTINCT least(a.id, b.id) AS a, greatest(a.id, b.id) AS b FROM m JOIN t a ON a.tokens = m.tx AND a.sec = m.ax JOIN t b ON b.tokens = m.ty AND b.sec = m.ay WHERE a.id <> b.id AND {_LOCATED}")
def e05(spark, sf):
    return listings.fuzzy_pairs(_titles_at(spark, sf).withColumnRenamed("start_time", "starts_at"))


def _stored(spark, sf):
    """The even order lines as stored events, each with its link, which has its own start as ids repeat."""
    r = raw_events(spark, sf).filter("floor(seq / 10) % 2 = 0")
    first = r.groupBy(text.canonical_key(F.col("title"), F.col("start_time")).alias("canonical_key")).agg(F.min_by(F.struct("seq", "title", "start_time"), "seq").alias("e"))
    events = first.select(F.col("e.seq").alias("id"), "canonical_key", "e.title", F.col("e.start_time").alias("starts_at"))
    links = r.select(F.col("seq").alias("event_id"), "source_name", "source_url", "source_event_id", F.col("start_time").alias("starts_at")).join(events.select(F.col("id").alias("event_id")), "event_id", "left_semi")
    return events, links


@query("e06_known_events", f"""WITH {RAW_EVENTS}, k AS (SELECT *, {_CKEY} AS ck FROM raws), ev AS (SELECT ck, min(seq) AS id FROM k WHERE (seq // 10) % 2 = 0 GROUP BY ck), li AS (SELECT k.*, k.seq AS event_id, k.start_time // 86400 AS day FROM k JOIN ev ON ev.id = k.seq),
r AS (SELECT *, start_time // 86400 AS day FROM k WHERE (seq // 10) % 2 = 1),
one AS (SELECT seq, min(event_id) AS event_id FROM (SELECT r.seq, li.event_id FROM r JOIN li ON r.source_name = li.source_name AND r.source_event_id = li.source_event_id AND r.day = li.day UNION ALL SELECT r.seq, li.event_id FROM r JOIN li ON r.source_event_id IS NULL AND r.source_name = li.source_name AND r.source_url = li.source_url AND r.day = li.day) GROUP BY seq)
SELECT seq, event_id, 1 AS tier FROM one UNION ALL SELECT r.seq, ev.id, 2 FROM r JOIN ev ON ev.ck = r.ck WHERE r.seq NOT IN (SELECT seq FROM one)""")
def e06(spark, sf):
    events, links = _stored(spark, sf)
    return listings.known_events(raw_events(spark, sf).filter("floor(seq / 10) % 2 = 1"), events, links)


@query("e07_drifted_keys", f"""WITH {RAW_EVENTS}, k AS (SELECT *, {_CKEY} AS ck FROM raws), ev AS (SELECT ck, min(seq) AS id FROM k WHERE (seq // 10) % 2 = 0 GROUP BY ck), li AS (SELECT DISTINCT k.source_name, k.source_url, k.source_event_id, k.seq AS event_id, ev.ck AS canonical_key, e.start_time // 86400 AS day
  FROM k JOIN ev ON ev.id = k.seq JOIN (SELECT ck, arg_min(start_time, seq) AS start_time FROM k WHERE (seq // 10) % 2 = 0 GROUP BY ck) e ON e.ck = ev.ck),
again AS (SELECT seq, source_name, source_url, source_event_id, title || CASE seq % 3 WHEN 0 THEN ' again' WHEN 1 THEN ' revisited' ELSE '' END AS title, start_time FROM raws),
r AS (SELECT *, start_time // 86400 AS day, {_CKEY} AS ck FROM again),
one AS (SELECT seq, ck, min((event_id, canonical_key)) AS e FROM (SELECT r.seq, r.ck, li.event_id, li.canonical_key FROM r JOIN li ON r.source_name = li.source_name AND r.source_event_id = li.source_event_id AND r.day = li.day UNION ALL SELECT r.seq, r.ck, li.event_id, li.canonical_key FROM r JOIN li ON r.source_event_id IS NULL AND r.source_name = li.source_name AND r.source_url = li.source_url AND r.day = li.day) GROUP BY seq, ck),
free AS (SELECT seq, ck AS new_key, e[1] AS event_id, e[2] AS canonical_key FROM one WHERE ck NOT IN (SELECT ck FROM ev)),
own AS (SELECT * FROM free QUALIFY row_number() OVER (PARTITION BY event_id, canonical_key ORDER BY seq, new_key) = 1)
SELECT event_id, canonical_key, new_key, seq FROM own QUALIFY row_number() OVER (PARTITION BY new_key ORDER BY seq, event_id, canonical_key) = 1""")
def e07(spark, sf):
    """All order lines come again, two of three under a longer title."""
    events, links = _stored(spark, sf)
    n = F.col("seq") % 3
    again = raw_events(spark, sf).withColumn("title", F.concat("title", F.when(n == 0, " again").when(n == 1, " revisited").otherwise("")))
    return listings.drifted_keys(again, events, links.drop("starts_at"))


@query("e09_upsert", None)
def e09(spark, sf):
    out = listings.upsert_raw_events(raw_events(spark, sf), 100, CENTER)
    return out.select("id", "canonical_key", "title", seconds("starts_at").alias("starts_at"), "outcome", "merged", F.size("links").alias("links"))


@query("e10_backfill", f"WITH {RAW_EVENTS} SELECT source_url, arg_min(description, seq) FILTER (WHERE description <> '') AS description, arg_min(latitude, seq) FILTER (WHERE latitude IS NOT NULL) AS latitude FROM raws GROUP BY source_url")
def e10(spark, sf):
    return listings.backfilled(raw_events(spark, sf), "source_url", ["description", "latitude"], "seq")


@query("e11_links", f"WITH {RAW_EVENTS}, k AS (SELECT *, {_CKEY} AS ck FROM raws) SELECT ck AS canonical_key, source_name, source_url, arg_max(source_event_id, seq) FILTER (WHERE source_event_id IS NOT NULL) AS source_event_id FROM k GROUP BY 1, 2, 3")
def e11(spark, sf):
    r = raw_events(spark, sf).withColumn("canonical_key", text.canonical_key(F.col("title"), F.col("start_time")))
    return listings.merged_links(r, "canonical_key", "seq")


@query("e12_tags", f"WITH {RAW_EVENTS}, h AS (SELECT seq, tag, ' ' || lower(title || ' ' || description) || ' ' AS hay FROM raws) SELECT seq, CASE WHEN seq % 2 = 0 THEN tag ELSE array_to_string(list_sort(list_filter({_sql_keys(listings.TOPICS, 'hay')}, lambda t: t <> 'arts')), ' ') END AS tags FROM h")
def e12(spark, sf):
    r = raw_events(spark, sf)
    own = F.when(F.col("seq") % 2 == 0, F.col("tags")).otherwise(F.array().cast("array<string>"))
    return r.select("seq", F.array_join(listings.tag_names(own, F.col("title"), F.col("description"), ("arts",)), " ").alias("tags"))


@query("e13_purge_tags", "SELECT p_type AS tag, count(*) AS events FROM part WHERE p_type NOT IN (SELECT min(p_type) FROM part) GROUP BY p_type")
def e13(spark, sf):
    t = read(spark, sf, "part").select(F.col("p_partkey").alias("event_id"), F.col("p_type").alias("tag"))
    blocked = [t.agg(F.min("tag")).first()[0]]
    return listings.purge_tags(t, blocked)[0].groupBy("tag").agg(F.count(F.lit(1)).alias("events"))


@query("e15_reconcile", None)
def e15(spark, sf):
    r = raw_events(spark, sf)
    first = r.groupBy("title", "start_time", "venue_name").agg(F.min_by(F.struct("seq", "description", "latitude", "longitude", "source_name", "source_url", "source_event_id", "tags"), "seq").alias("e"))
    events = first.select(F.col("e.seq").alias("id"), "title", F.col("start_time").alias("starts_at"), F.lit(None).cast("timestamp").alias("ends_at"), "e.description", "venue_name", F.lit(None).cast("string").alias("address"), "e.latitude", "e.longitude", F.lit(None).cast("string").alias("image_url"), "e.tags", F.array(F.struct("e.source_name", "e.source_url", "e.source_event_id")).alias("links"))
    out = listings.reconcile_events(events, F.lit("1990-01-01").cast("timestamp"))
    return out.select("id", "canonical_key", "title", seconds("starts_at").alias("starts_at"), "absorbed", F.size("links").alias("links"))


@query("e16_listing", f"""WITH {RAW_EVENTS} SELECT seq AS id, title, start_time AS starts_at, round_even({_RAW_MILES}, 1) AS distance_miles FROM raws WHERE start_time >= epoch(TIMESTAMP '1997-01-01') AND title ILIKE '%the%' AND {_RAW_MILES} <= 0.9 ORDER BY start_time, seq LIMIT 300""")
def e16(spark, sf):
    e = raw_events(spark, sf).select(F.col("seq").alias("id"), "title", F.col("start_time").alias("starts_at"), F.col("end_time").alias("ends_at"), "latitude", "longitude", "tags")
    return listings.listing(e, F.lit("1997-01-01").cast("timestamp"), CENTER, search="the", max_miles=0.9, limit=300).select("id", "title", seconds("starts_at").alias("starts_at"), "distance_miles")


@query("e17_all_tags", "SELECT DISTINCT lower(p_type) AS tag FROM part")
def e17(spark, sf):
    return listings.all_tags(read(spark, sf, "part").select(F.lower("p_type").alias("tag")))


@query("e18_rolled_tags", """WITH RECURSIVE t AS (SELECT p_partkey AS id, 'tag ' || p_partkey AS name, CASE WHEN p_partkey < 5 THEN NULL ELSE p_partkey // 4 END AS parent FROM part), up AS (
SELECT id, id AS node, parent, 0 AS depth FROM t UNION ALL SELECT u.id, t.id, t.parent, u.depth + 1 FROM up u JOIN t ON t.id = u.parent)
SELECT id, 'tag ' || CASE WHEN max(depth) = 0 THEN id ELSE arg_max(node, depth) FILTER (WHERE parent IS NOT NULL OR depth = 0) END AS name FROM up GROUP BY id""")
def e18(spark, sf):
    t = read(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.concat(F.lit("tag "), F.col("p_partkey").cast("string")).alias("name"), F.when(F.col("p_partkey") >= 5, F.floor(F.col("p_partkey") / 4)).alias("parent"))
    return listings.rolled_tags(t)


@query("e19_clean_images", "SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN NULL WHEN p_partkey % 5 = 0 THEN NULL ELSE 'https://example.org/stock/p' || p_partkey || '.jpg?default=1' END AS image FROM part")
def e19(spark, sf):
    k = F.col("p_partkey")
    url = F.when(k % 3 == 0, "  ").when(k % 5 == 0, F.concat(F.lit("https://example.org/a/My-Generic-"), k.cast("string"), F.lit(".jpg"))).otherwise(F.concat(F.lit(" https://example.org/stock/p"), k.cast("string"), F.lit(".jpg?default=1")))
    return read(spark, sf, "part").select("p_partkey", text.clean_image(url).alias("image"))


@query("e20_join_address", "SELECT s_suppkey, array_to_string(list_filter([trim(s_name), CASE WHEN s_suppkey % 2 = 0 THEN NULL ELSE 'TN' END, NULL], lambda x: x IS NOT NULL), ', ') AS address FROM supplier")
def e20(spark, sf):
    k = F.col("s_suppkey")
    return read(spark, sf, "supplier").select("s_suppkey", text.join_parts(F.concat(F.lit("  "), "s_name", F.lit(" ")), F.when(k % 2 == 0, "  ").otherwise("TN"), F.lit(None).cast("string")).alias("address"))


@query("e21_resolve_year", f"WITH {SPANS} SELECT o_orderkey, strftime(dt, '%Y-%m-%d') AS resolved FROM orders LEFT JOIN x ON k = o_orderkey")
def e21(spark, sf):
    d = timeutil.resolve_year(F.month("o_orderdate"), F.dayofmonth("o_orderdate"), F.lit("2026-07-20").cast("date"))
    return read(spark, sf, "orders").select("o_orderkey", F.date_format(d, "yyyy-MM-dd").alias("resolved"))


@query("e22_occurrences", f"WITH {SPANS} SELECT o_orderkey, start_at, end_at FROM orders LEFT JOIN (SELECT * FROM t WHERE end_at >= CAST(epoch(TIMESTAMP '2026-07-20 12:00:00') AS BIGINT)) ON k = o_orderkey")
def e22(spark, sf):
    h = (F.col("o_orderkey") % 11 + 1).cast("string")
    span = F.concat(F.date_format("o_orderdate", "MMMM d"), F.lit(" | "), h, F.lit(" AM - "), h, F.lit(":30 p.m."))
    o = read(spark, sf, "orders").withColumn("w", timeutil.occurrence(span, F.lit("2026-07-20 12:00:00").cast("timestamp")))
    return o.select("o_orderkey", F.unix_seconds("w.start").alias("start_at"), F.unix_seconds("w.end").alias("end_at"))


@query("e23_digest", f"""WITH {RAW_EVENTS}, near AS (SELECT seq AS id, title, start_time AS starts_at FROM raws WHERE start_time >= epoch(TIMESTAMP '1997-01-01') AND {_RAW_MILES} <= 35 ORDER BY start_time, seq LIMIT 10)
SELECT * FROM near WHERE starts_at - 5 * 3600 >= epoch(TIMESTAMP '1996-12-31') AND starts_at - 5 * 3600 < epoch(TIMESTAMP '1997-01-01')""")
def e23(spark, sf):
    e = raw_events(spark, sf).select(F.col("seq").alias("id"), "title", F.col("start_time").alias("starts_at"), F.col("end_time").alias("ends_at"), "latitude", "longitude", "tags")
    return listings.digest(e, F.lit("1997-01-01").cast("timestamp"), CENTER).select("id", "title", seconds("starts_at").alias("starts_at"))


@query("e24_refresh_summary", None)
def e24(spark, sf):
    up = materialize(listings.upsert_raw_events(raw_events(spark, sf), 100, CENTER), "upserted")
    events = up.filter("outcome = 'created'").select("id", "title", "starts_at", "ends_at", "description", "venue_name", "address", "latitude", "longitude", "image_url", "tags", "links")
    return listings.refresh_summary(up, listings.reconcile_events(events, F.lit("1990-01-01").cast("timestamp")))


# ---- weather -------------------------------------------------------------------------------------------------------


@query("w01_conditions", f"""WITH {READINGS} SELECT position, CAST(round_even(aqi * 9 / 5 + 32, 0) AS BIGINT) AS temperature_f, CAST(round_even(aqi * 0.621371, 0) AS BIGINT) AS wind_mph, ['N','NNE','NE','ENE','E','ESE','SE','SSE','S','SSW','SW','WSW','W','WNW','NW','NNW'][CAST(round_even((position % 360) / 22.5, 0) AS BIGINT) % 16 + 1] AS wind_direction, CAST(round_even(aqi / 2, 0) AS BIGINT) AS humidity_percent FROM reads WHERE pollutant <> 'error'""")
def w01(spark, sf):
    r = readings(spark, sf)
    o = r.select("position", F.when(F.col("pollutant") != "error", F.col("aqi")).alias("temp_c"), F.col("aqi").alias("wind_kmh"), (F.col("position") % 360).cast("double").alias("wind_degrees"), (F.col("aqi") / 2).alias("humidity"))
    return weather.conditions(o)


@query("w02_first_periods", f"WITH {READINGS}, r AS (SELECT *, row_number() OVER (PARTITION BY area, hour ORDER BY position) - 1 AS n FROM reads) SELECT area, hour, CAST(n AS INT) AS position, pollutant AS name FROM r WHERE n < 2")
def w02(spark, sf):
    f = readings(spark, sf).groupBy("area", "hour").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "pollutant"))), lambda x: F.struct(x["pollutant"].alias("name"))).alias("periods"))
    return weather.first_periods(f).select("area", "hour", "position", F.col("period.name").alias("name"))


@query("w03_usable_station", f"WITH {READINGS}, r AS (SELECT *, row_number() OVER (PARTITION BY area, hour ORDER BY position) AS rank FROM reads) SELECT area * 100000000 + hour AS place, min(rank) AS rank, arg_min(position, rank) AS station FROM r WHERE rank <= 3 AND pollutant <> 'view' GROUP BY 1")
def w03(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("area", "hour").orderBy("position")
    r = readings(spark, sf).select((F.col("area") * 100000000 + F.col("hour")).alias("place"), F.row_number().over(w).cast("long").alias("rank"), F.col("position").alias("station"), F.when(F.col("pollutant") != "view", F.col("aqi")).alias("temp_c"))
    return weather.usable_station(r).select("place", "rank", "station")


_CATEGORY = "CASE WHEN aqi <= 50 THEN 1 WHEN aqi <= 100 THEN 2 WHEN aqi <= 150 THEN 3 WHEN aqi <= 200 THEN 4 WHEN aqi <= 300 THEN 5 ELSE 6 END"
_WORST = f"{READINGS}, worst AS (SELECT area, hour, aqi, pollutant, {_CATEGORY} AS category FROM (SELECT *, row_number() OVER (PARTITION BY area, hour ORDER BY aqi DESC, position) AS rn FROM reads WHERE aqi >= 0) WHERE rn = 1)"


@query("w04_overall_aqi", f"WITH {_WORST} SELECT * FROM worst")
def w04(spark, sf):
    return weather.overall_aqi(readings(spark, sf), ["area", "hour"])


@query("w05_aqi_category", f"WITH {READINGS} SELECT {_CATEGORY} AS category, count(*) AS readings FROM (SELECT aqi * 4 AS aqi FROM reads) GROUP BY 1")
def w05(spark, sf):
    return readings(spark, sf).select(weather.aqi_category(F.col("aqi") * 4).alias("category")).groupBy("category").agg(F.count(F.lit(1)).alias("readings"))


@query("w06_observed_at", f"WITH {READINGS} SELECT position, strftime(make_timestamp(hour * 3600000000), '%Y-%m-%dT%H:00:00') || CASE area % 3 WHEN 0 THEN '-05:00' WHEN 1 THEN '-08:00' ELSE '' END AS observed_at FROM reads")
def w06(spark, sf):
    r = readings(spark, sf)
    at = F.timestamp_seconds(F.col("hour") * 3600)
    zone = F.when(F.col("area") % 3 == 0, "est ").when(F.col("area") % 3 == 1, "PST").otherwise("XYZ")
    return r.select("position", timeutil.observed_at(F.date_format(at, "yyyy-MM-dd"), F.date_format(at, "HH:mm"), zone).alias("observed_at"))


@query("w07_carry_forward", f"""WITH {_WORST}, r AS (SELECT area, hour, CASE WHEN pollutant <> 'view' THEN aqi END AS aqi FROM worst), l AS (SELECT *, last_value(CASE WHEN aqi IS NOT NULL THEN hour END IGNORE NULLS) OVER w AS lh, last_value(aqi IGNORE NULLS) OVER w AS la FROM r WINDOW w AS (PARTITION BY area ORDER BY hour ROWS UNBOUNDED PRECEDING))
SELECT area, hour, CASE WHEN aqi IS NOT NULL THEN aqi WHEN (hour - lh) * 60 <= 120 THEN la END AS aqi, aqi IS NULL AND coalesce((hour - lh) * 60 <= 120, false) AS carried FROM l""")
def w07(spark, sf):
    worst = weather.overall_aqi(readings(spark, sf), ["area", "hour"])
    r = worst.select("area", "hour", F.timestamp_seconds(F.col("hour") * 3600).alias("at"), F.when(F.col("pollutant") != "view", F.col("aqi")).alias("aqi"))
    return weather.carry_forward(r.withColumn("observed", F.col("at")), "area", "at", "aqi", "observed").select("area", "hour", "aqi", "carried")


@query("w08_changed_payloads", f"WITH {_WORST}, l AS (SELECT *, lag(pollutant) OVER w AS p, lag(category) OVER w AS c, row_number() OVER w AS n FROM worst WINDOW w AS (PARTITION BY area ORDER BY hour)) SELECT area, hour, pollutant, category FROM l WHERE n = 1 OR p <> pollutant OR c <> category")
def w08(spark, sf):
    worst = weather.overall_aqi(readings(spark, sf), ["area", "hour"])
    return weather.changed_payloads(worst, "area", "hour", ["pollutant", "category"]).select("area", "hour", "pollutant", "category")


@query("w09_error_messages", "SELECT event_id, CASE WHEN event_type = 'error' THEN 'failed ' || user_id ELSE '' END AS messages FROM events")
def w09(spark, sf):
    e = read(spark, sf, "events")
    payload = F.when(F.col("event_type") == "error", F.concat(F.lit('{"WebServiceError":[{"Message":"failed '), F.col("user_id").cast("string"), F.lit('"}]}'))).otherwise(F.col("props"))
    return e.select("event_id", F.array_join(weather.error_messages(payload), "; ").alias("messages"))


# ---- text and time -------------------------------------------------------------------------------------------------


@query("t01_strip_html", None)
def t01(spark, sf):
    return read(spark, sf, "pages").select("page_id", text.strip_html("html").alias("text"))


_CUT = "substring(text, 1, 400)"
_SQL_LAST = "(CASE WHEN contains(" + _CUT + ", '{s}') THEN length(" + _CUT + ") - instr(reverse(" + _CUT + "), '{r}') - {n} + 1 ELSE -1 END)"


def _last(s):
    return _SQL_LAST.format(s=s, r=s[::-1], n=len(s))


@query("t02_truncate", f"""SELECT doc_id, md5(CASE WHEN length(text) <= 400 THEN text WHEN {_last('. ')} > 200 THEN substring(text, 1, {_last('. ')} + 1) WHEN {_last('! ')} > 200 THEN substring(text, 1, {_last('! ')} + 1) WHEN {_last('? ')} > 200 THEN substring(text, 1, {_last('? ')} + 1)
ELSE rtrim(CASE WHEN {_last(' ')} > 0 THEN substring(text, 1, {_last(' ')}) ELSE {_CUT} END, ',;:') || '…' END) AS cut FROM documents""")
def t02(spark, sf):
    return read(spark, sf, "documents").select("doc_id", F.md5(text.truncate_sentences(F.col("text"), 400)).alias("cut"))


@query("t03_parse_iso", "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN CAST(epoch(o_orderdate) AS BIGINT) WHEN 1 THEN CAST(epoch(o_orderdate) AS BIGINT) - 3 * 3600 + 3600 WHEN 2 THEN NULL ELSE CAST(epoch(o_orderdate) AS BIGINT) + 45000 END AS at FROM orders")
def t03(spark, sf):
    d = F.date_format("o_orderdate", "yyyy-MM-dd")
    n = F.col("o_orderkey") % 4
    t = F.when(n == 0, d).when(n == 1, F.concat(d, F.lit("T01:00:00+03:00"))).when(n == 2, F.concat(F.lit("x"), d)).otherwise(F.concat(d, F.lit("T12:30:00Z")))
    return read(spark, sf, "orders").select("o_orderkey", F.unix_seconds(timeutil.parse_iso(t)).alias("at"))


@query("t04_to_float", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN value END AS number FROM events")
def t04(spark, sf):
    n = F.col("event_id") % 3
    t = F.when(n == 0, F.col("value").cast("string")).when(n == 1, "NaN").otherwise("n/a")
    return read(spark, sf, "events").select("event_id", timeutil.to_float(t).alias("number"))


@query("t05_redact", "SELECT o_orderkey, 'GET /x?a=' || o_orderkey || '&api_key=[REDACTED]&b=2 [REDACTED]' AS masked FROM orders")
def t05(spark, sf):
    t = F.concat(F.lit("GET /x?a="), F.col("o_orderkey").cast("string"), F.lit("&api_key="), F.col("o_custkey").cast("string"), F.lit("&b=2 top%2Fsecret"))
    return read(spark, sf, "orders").select("o_orderkey", text.redact(t, ["top/secret", "short"]).alias("masked"))


def entry(spark: SparkSession, sf: str) -> DataFrame:
    """Changes of each source: new, updated and closed."""
    log = _log(spark, sf)
    return log.groupBy("source_key").agg(*[F.count_if(F.col("change") == c).alias(c) for c in ("new", "updated", "closed")]).orderBy("source_key")
