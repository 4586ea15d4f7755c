"""Queries over landed files: payloads are made from the given tables by Spark, written to the shared folder as a feed would land them, read back and parsed. The SQL says what the rows must be, from the tables alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import history, weather
from tidemark.plans.bindings import articles, read
from tidemark.sources import calendars, live, news, stations
from tidemark.streaming import changes as streams
from tidemark.tables import new_path

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
DAY = 86400


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return add


def seconds(c: str) -> Column:
    return F.unix_seconds(F.col(c).cast("timestamp"))


def text(c) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def land(rows: DataFrame, name: str) -> DataFrame:
    """Rows with JSON payloads, written as JSON lines and read back."""
    path = new_path(rows.sparkSession, f"landed-{name}")
    rows.write.json(path)
    return rows.sparkSession.read.schema(rows.schema).json(path)


def listed(rows: DataFrame, by: list[str], order: str, item: Column, opening: str = "[", closing: str = "]") -> DataFrame:
    """One payload for each key: the items in order, inside the given brackets."""
    items = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), item.alias("i")))), lambda x: x["i"])
    return rows.groupBy(*by).agg(F.concat(F.lit(opening), F.array_join(items, ","), F.lit(closing)).alias("payload"))


# ---- live feeds: events as polls, one a day ------------------------------------------------------------------------


def _polled(spark: SparkSession, sf: str) -> DataFrame:
    at = F.unix_seconds(F.col("ts").cast("timestamp"))
    e = read(spark, sf, "events").select("event_id", "user_id", "event_type", "value", at.alias("at"))
    return e.select("*", F.concat(F.lit("s"), text(F.col("user_id") % 3)).alias("source_key"), F.timestamp_seconds(F.floor(F.col("at") / DAY) * DAY).alias("poll_at"), F.date_format(F.timestamp_seconds("at"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("iso"))


_POLLED = """ev AS (SELECT event_id, user_id, event_type, value, CAST(floor(epoch(ts)) AS BIGINT) AS sec, 's' || (user_id % 3) AS source_key, CAST(floor(epoch(ts) / 86400) AS BIGINT) * 86400 AS poll_at,
  (350456 + user_id % 50 * 10) / 10000 AS lat, (-853097 + user_id % 40 * 100) / 10000 AS lon FROM events)"""
_LAST = "row_number() OVER (PARTITION BY source_key, poll_at, user_id ORDER BY event_id DESC) AS rn"


def _lat() -> Column:
    return (F.lit(350456) + F.col("user_id") % 50 * 10) / 10000


def _lon() -> Column:
    return (F.lit(-853097) + F.col("user_id") % 40 * 100) / 10000


_CALL_LABEL = "CASE WHEN event_id % 5 = 0 THEN 'described ' || event_type ELSE event_type END"


@query("s01_calls", f"""WITH {_POLLED}, r AS (SELECT *, {_LAST} FROM ev WHERE event_type <> 'error' AND event_id % 11 <> 0)
SELECT source_key, poll_at, CAST(user_id AS VARCHAR) AS external_id, CASE event_id % 4 WHEN 0 THEN 'police' WHEN 1 THEN 'fire' WHEN 2 THEN 'ems' ELSE 'other' END AS category, {_CALL_LABEL} AS label, CASE WHEN event_id % 6 <> 0 THEN lat END AS lat, lon,
  event_type AS status, CASE WHEN event_id % 7 = 0 THEN sec - 3600 ELSE sec END AS source_time FROM r WHERE rn = 1""")
def s01(spark, sf):
    e = F.col("event_id")
    item = F.to_json(F.struct(
        F.when(e % 11 != 0, F.col("user_id")).alias("master_incident_id"), F.when(F.col("event_type") == "error", "PERBURN").when(e % 5 == 0, "").otherwise(F.col("event_type")).alias("type"), F.concat(F.lit("described "), "event_type").alias("type_description"),
        F.element_at(F.array(F.lit("Law "), F.lit("Fire"), F.lit("EMS"), F.lit("Zoo")), (e % 4 + 1).cast("int")).alias("agency_type"), F.when(e % 6 == 0, "n/a").otherwise(text(_lat())).alias("latitude"), _lon().alias("longitude"), F.col("event_type").alias("status"),
        F.when(e % 7 == 0, "1900-01-01T00:00:00Z").otherwise(F.col("iso")).alias("statusdatetime"), F.when(e % 7 == 0, F.date_format(F.timestamp_seconds(F.col("at") - 3600), "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("creation"),
    ))
    raw = land(listed(_polled(spark, sf), ["source_key", "poll_at"], "event_id", item), "calls")
    return live.emergency_calls(raw).select("source_key", seconds("poll_at").alias("poll_at"), "external_id", "category", "label", "lat", "lon", "status", seconds("source_time").alias("source_time"))


@query("s02_outages", f"""WITH {_POLLED}, i AS (SELECT *, CASE event_id % 3 WHEN 0 THEN 'energy' WHEN 1 THEN 'fiber' ELSE 'water' END AS service FROM ev WHERE event_id % 7 <> 0),
r AS (SELECT *, row_number() OVER (PARTITION BY source_key, poll_at, service, lat, lon ORDER BY event_id DESC) AS rn FROM i)
SELECT source_key, poll_at, service || ':' || printf('%.6f,%.6f', lat, lon) AS external_id, service AS category, CASE service WHEN 'energy' THEN 'Energy Outage' WHEN 'fiber' THEN 'Fiber Outage' ELSE 'Outage' END AS label, lat, lon, event_type AS status, user_id AS customers FROM r WHERE rn = 1""")
def s02(spark, sf):
    item = F.to_json(F.struct(F.when(F.col("event_id") % 7 != 0, _lat()).alias("latitude"), _lon().alias("longitude"), F.col("event_type").alias("incident_status"), F.col("user_id").alias("customer_quantity")))
    services = F.element_at(F.array(F.lit("energy"), F.lit("fiber"), F.lit("water")), (F.col("event_id") % 3 + 1).cast("int"))
    by = listed(_polled(spark, sf).withColumn("service", services), ["source_key", "poll_at", "service"], "event_id", item)
    raw = land(listed(by.withColumnRenamed("payload", "list"), ["source_key", "poll_at"], "service", F.concat(F.lit('"'), "service", F.lit('":'), "list"), "{", "}"), "outages")
    p = lambda c: F.get_json_object("properties", f"$.{c}")
    return live.outages(raw).select("source_key", seconds("poll_at").alias("poll_at"), "external_id", "category", "label", "lat", "lon", "status", p("customer_quantity").cast("long").alias("customers"))


@query("s03_roads", f"""WITH {_POLLED}, r AS (SELECT *, row_number() OVER (PARTITION BY source_key, poll_at, user_id ORDER BY event_id % 9 <> 0, event_id) AS rn FROM ev WHERE event_id % 13 <> 0)
SELECT source_key, poll_at, CAST(user_id AS VARCHAR) AS external_id, CASE WHEN event_id % 9 = 0 THEN 'severe' ELSE CASE event_id % 4 WHEN 0 THEN 'incident' WHEN 1 THEN 'construction' WHEN 2 THEN 'special_event' ELSE 'other' END END AS category,
  CASE WHEN event_id % 2 = 0 THEN 'sub ' || event_type ELSE CASE event_id % 4 WHEN 1 THEN 'Operations' ELSE 'Zoo' END END AS label, CASE WHEN event_id % 5 <> 0 THEN lat END AS lat, CASE WHEN event_id % 5 <> 0 THEN lon END AS lon, sec + CASE WHEN event_id % 3 = 0 THEN 5 * 3600 ELSE 0 END AS source_time FROM r WHERE rn = 1""")
def s03(spark, sf):
    e = F.col("event_id")
    point = F.struct(_lat().alias("lat"), _lon().alias("lng"))
    place = F.when(e % 5 == 0, F.lit("[]")).when(e % 5 == 1, F.concat(F.lit('[{"midPoint":'), F.to_json(point), F.lit(',"coordinates":[{"lat":1.0,"lng":2.0}]}]'))).otherwise(F.concat(F.lit('[{"coordinates":['), F.to_json(point), F.lit("]}]")))
    head = F.to_json(F.struct(
        F.when(e % 13 != 0, F.col("user_id")).alias("id"), F.element_at(F.array(F.lit("Incident"), F.lit("Operations"), F.lit("SpecialEvent"), F.lit("Zoo")), (e % 4 + 1).cast("int")).alias("eventTypeName"), F.when(e % 2 == 0, F.concat(F.lit("sub "), "event_type")).otherwise("").alias("eventSubTypeDescription"),
        (e % 9 == 0).alias("isSevere"), F.lit("ok").alias("status"), F.when(e % 3 == 0, F.concat(F.left("iso", F.lit(19)), F.lit("-05:00"))).alias("revisedDate"), F.col("iso").alias("beginningDate"),
    ))
    item = F.concat(F.left(head, F.length(head) - 1), F.lit(',"locations":'), place, F.lit("}"))
    raw = land(listed(_polled(spark, sf), ["source_key", "poll_at"], "event_id", item), "roads")
    return live.road_events(raw).select("source_key", seconds("poll_at").alias("poll_at"), "external_id", "category", "label", "lat", "lon", seconds("source_time").alias("source_time"))


@query("s04_advisories", f"""WITH {_POLLED}, r AS (SELECT *, row_number() OVER (PARTITION BY source_key, poll_at, user_id ORDER BY event_type DESC, event_id DESC) AS rn FROM ev WHERE event_id % 4 <> 0)
SELECT source_key, poll_at, CAST(user_id AS VARCHAR) AS external_id, event_type AS category, 'header ' || event_id AS label, CASE WHEN event_id % 3 = 0 THEN 'active' ELSE 'type ' || (event_id % 5) END AS status, event_type AS advisory_type, lon AS first_lon FROM r WHERE rn = 1""")
def s04(spark, sf):
    e = F.col("event_id")
    ring = F.format_string("[[[%s,%s],[%s,1.0],[0.0,1.0],[%s,%s]]]", _lon(), _lat(), _lon(), _lon(), _lat())
    shape = F.when(e % 4 == 0, "null").otherwise(F.concat(F.lit('{"type":"Polygon","coordinates":'), ring, F.lit("}")))
    props = F.to_json(F.struct(text("user_id").alias("EventID"), F.when(e % 3 == 0, "").otherwise(F.concat(F.lit("type "), text(e % 5))).alias("EventType"), F.lit("active").alias("EventStatus"), F.concat(F.lit("header "), text(e)).alias("EventHeader")))
    features = listed(_polled(spark, sf), ["source_key", "poll_at", "event_type"], "event_id", F.concat(F.lit('{"properties":'), props, F.lit(',"geometry":'), shape, F.lit("}")))
    layer = F.concat(F.lit('{"category":"'), "event_type", F.lit('","features":'), "list", F.lit("}"))
    raw = land(listed(features.withColumnRenamed("payload", "list"), ["source_key", "poll_at"], "event_type", layer), "advisories")
    g = F.get_json_object("geometry", "$.coordinates[0][0][0]").cast("double")
    return live.advisories(raw).select("source_key", seconds("poll_at").alias("poll_at"), "external_id", "category", "label", "status", F.get_json_object("properties", "$.advisory_type").alias("advisory_type"), g.alias("first_lon"))


@query("s15_isolation", f"""WITH {_POLLED}, p AS (SELECT source_key, poll_at, (poll_at // 86400) % 5 <> 0 AS ok, count(DISTINCT user_id) AS n FROM ev GROUP BY 1, 2)
SELECT feed, source_key, poll_at, ok, CASE WHEN NOT ok THEN 'payload is no JSON' END AS error, CASE WHEN ok THEN n ELSE 0 END AS rows_kept FROM (SELECT 'calls' AS feed, * FROM p UNION ALL SELECT 'roads', source_key, poll_at, true, n FROM p)""")
def s15(spark, sf):
    e = _polled(spark, sf)
    calls = listed(e, ["source_key", "poll_at"], "event_id", F.to_json(F.struct(F.col("user_id").alias("master_incident_id"))))
    bad = F.floor(F.unix_seconds("poll_at") / DAY) % 5 == 0
    calls = land(calls.withColumn("payload", F.when(bad, F.concat(F.lit("{"), "payload")).otherwise(F.col("payload"))).withColumn("source_key", F.concat(F.lit("calls:"), "source_key")), "some-bad")
    roads = land(listed(e, ["source_key", "poll_at"], "event_id", F.to_json(F.struct(F.col("user_id").alias("id")))).withColumn("source_key", F.concat(F.lit("roads:"), "source_key")), "all-good")
    rows, status = live.normalized({"calls": calls, "roads": roads})
    kept = rows.groupBy("source_key", "poll_at").agg(F.count(F.lit(1)).alias("rows_kept"))
    part = lambda k: F.split_part("source_key", F.lit(":"), F.lit(k))
    return status.join(kept, ["source_key", "poll_at"], "left").select(part(1).alias("feed"), part(2).alias("source_key"), seconds("poll_at").alias("poll_at"), "ok", "error", F.coalesce("rows_kept", F.lit(0)).alias("rows_kept"))


# ---- news: documents as feed items and listing pages ---------------------------------------------------------------

FETCHED = 1735689600  # 2025-01-01


def _items(spark: SparkSession, sf: str) -> DataFrame:
    """A short plain title of each document's first letters, and a time by its id."""
    d = read(spark, sf, "documents")
    words = F.trim(F.regexp_replace(F.left(F.coalesce("text", F.lit("")), F.lit(120)), "[^A-Za-z0-9]+", " "))
    return d.select("doc_id", F.floor(F.col("doc_id") / 50).alias("file"), words.alias("words"), F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 60).alias("at"))


_WORDS = "trim(regexp_replace(substring(coalesce(text, ''), 1, 120), '[^A-Za-z0-9]+', ' ', 'g'))"


@query("s05_feeds", f"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents)
SELECT CASE WHEN doc_id % 3 = 0 THEN 'https://example.org/' || doc_id ELSE 'tag:' || doc_id END AS guid, 'https://example.org/' || doc_id AS url, trim('N' || doc_id || ' ' || w) AS title, CASE WHEN doc_id % 2 = 0 THEN trim('body ' || w) ELSE trim('short ' || w) END AS summary,
  CASE WHEN doc_id % 4 = 0 THEN 'i' || doc_id || '.png' END AS image_url, 'c' || (doc_id % 3) AS tags, CASE WHEN doc_id % 5 = 0 THEN {FETCHED} ELSE 1704067200 + doc_id * 60 END AS published FROM d WHERE doc_id % 7 <> 0""")
def s05(spark, sf):
    i = _items(spark, sf)
    k = F.col("doc_id")
    n, link = text(k), F.concat(F.lit("https://example.org/"), text(k))
    body = F.concat(F.lit("&lt;p&gt;body "), "words", F.lit("&lt;/p&gt;"))
    part = lambda tag, v, given=F.lit(True): F.when(given, F.concat(F.lit(f"<{tag}>"), v, F.lit(f"</{tag}>"))).otherwise("")
    title = F.concat(F.lit("N"), n, F.lit(" &lt;b&gt;"), "words", F.lit("&lt;/b&gt;"))
    given = (k % 7 != 0) & (k % 5 != 0)
    rss = F.concat(
        F.lit("<item>"), part("title", title), part("link", link, k % 7 != 0), part("guid", F.concat(F.lit("tag:"), n), k % 3 != 0), part("pubDate", F.concat(F.date_format("at", "EEE, dd MMM yyyy HH:mm:ss"), F.lit(" +0000")), given), part("description", F.concat(F.lit("short "), "words")),
        part("content:encoded", body, k % 2 == 0), part("category", F.concat(F.lit("c"), text(k % 3))), F.when(k % 4 == 0, F.concat(F.lit('<enclosure url="i'), n, F.lit('.png" type="image/png"/>'))).otherwise(""), F.lit("</item>"),
    )
    atom = F.concat(
        F.lit("<entry>"), part("title", title), F.when(k % 7 != 0, F.concat(F.lit('<link rel="self" href="x"/><link href="'), link, F.lit('"/>'))).otherwise(""), F.when(k % 4 == 0, F.concat(F.lit('<link rel="enclosure" type="image/png" href="i'), n, F.lit('.png"/>'))).otherwise(""),
        part("id", F.concat(F.lit("tag:"), n), k % 3 != 0), part("updated", F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss'Z'"), given), part("summary", F.concat(F.lit("short "), "words")), F.when(k % 2 == 0, F.concat(F.lit('<content type="html">'), body, F.lit("</content>"))).otherwise(""),
        F.concat(F.lit('<category term="c'), text(k % 3), F.lit('"/>')), F.lit("</entry>"),
    )
    item = F.when(F.col("file") % 2 == 0, rss).otherwise(atom)
    files = i.groupBy("file").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", item.alias("item")))), lambda x: x["item"]), "").alias("items"))
    page = F.when(F.col("file") % 2 == 0, F.concat(F.lit('<rss xmlns:content="c"><channel>'), "items", F.lit("</channel></rss>"))).otherwise(F.concat(F.lit("<feed>"), "items", F.lit("</feed>")))
    path = new_path(spark, "landed-feeds")
    files.select(page.alias("value")).write.option("maxRecordsPerFile", 1).text(path)  # a feed is a file
    out = news.feed_articles(news.read_feeds(spark, path), F.timestamp_seconds(F.lit(FETCHED)))
    return out.select("guid", "url", "title", "summary", "image_url", F.array_join("tags", ",").alias("tags"), seconds("published").alias("published"))


@query("s06_listing_pages", f"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents)
SELECT 'https://town.example/news/' || doc_id AS guid, trim('N' || doc_id || ' ' || w) AS title, trim('Body ' || w) AS summary, CASE WHEN doc_id % 5 = 0 THEN {FETCHED} ELSE 1704067200 + doc_id * 60 + 4 * 3600 END AS published FROM d WHERE doc_id % 6 <> 0""")
def s06(spark, sf):
    k = F.col("doc_id")
    link = F.when(k % 6 == 0, "").otherwise(F.concat(F.lit('<a href="/news/'), text(k), F.lit('">N'), text(k), F.lit(" <i>"), "words", F.lit("</i></a>")))
    when = F.when(k % 5 == 0, "").otherwise(F.concat(F.lit('<time datetime="'), F.date_format("at", "yyyy-MM-dd'T'HH:mm:ss"), F.lit('-04:00">x</time>')))
    row = F.concat(F.lit('<div class="views-row"><div class="views-field-title"><h3>'), link, F.lit('</h3></div><div class="views-field-body"><div class="field-content"><p>Body '), "words", F.lit('</p></div></div><div class="views-field-created">'), when, F.lit("</div></div>"))
    pages = listed(_items(spark, sf), ["file"], "doc_id", row, "<html>", "</html>").select(F.lit("https://town.example/list").alias("page_url"), F.replace("payload", F.lit("</div></div>,<div"), F.lit("</div></div><div")).alias("html"))
    out = news.listing_articles(land(pages, "listing-pages"), F.timestamp_seconds(F.lit(FETCHED)))
    return out.select("guid", "title", "summary", seconds("published").alias("published"))


# ---- calendars: orders as listings ---------------------------------------------------------------------------------


def _orders(spark: SparkSession, sf: str) -> DataFrame:
    o = read(spark, sf, "orders")
    return o.select(F.col("o_orderkey").alias("k"), F.floor(F.col("o_orderkey") / 100).alias("page"), F.to_date("o_orderdate").alias("day"), F.col("o_orderpriority").alias("name"))


_ORDERS = "o AS (SELECT o_orderkey AS k, o_orderkey // 100 AS page, CAST(floor(epoch(o_orderdate) / 86400) AS BIGINT) * 86400 AS d, o_orderpriority AS name FROM orders)"


def json_of(**fields) -> Column:
    """A JSON object of column expressions that are JSON already."""
    parts = [F.concat(F.lit(f'"{n}":'), v) for n, v in fields.items()]
    return F.concat(F.lit("{"), *[x for p in parts for x in (p, F.lit(","))][:-1], F.lit("}"))


def quoted(*parts) -> Column:
    return F.concat(F.lit('"'), *[F.lit(p) if isinstance(p, str) else text(p) for p in parts], F.lit('"'))


@query("s07_paged_calendar", f"""WITH {_ORDERS}
SELECT CASE WHEN k % 7 = 0 THEN 'Untitled event' ELSE 'Tea & ' || name END AS title, d + 36000 AS start_at, CASE WHEN k % 3 <> 0 THEN d + 45000 END AS end_at, 'u/' || k AS source_url, CAST(k AS VARCHAR) AS source_event_id, 'a ' || k || ' b' AS description, CASE WHEN k % 3 <> 0 THEN 'Hall ' || (k % 10) END AS venue_name,
  CASE WHEN k % 3 <> 0 THEN k || ' St, 37402' END AS address, CASE WHEN k % 3 <> 0 THEN 35.5 END AS latitude, CASE WHEN k % 3 <> 0 AND k % 2 = 1 THEN -85.25 END AS longitude, CASE WHEN k % 4 >= 2 THEN 'https://x/' || k || '.png' END AS image_url, 'music,' || lower(name) AS tags FROM o WHERE k % 5 <> 0""")
def s07(spark, sf):
    k = F.col("k")
    day = F.date_format("day", "yyyy-MM-dd")
    venue = F.when(k % 3 == 0, "[]").otherwise(json_of(venue=quoted("Hall ", k % 10), address=quoted(" ", k, " St"), city=quoted(""), zip=quoted("37402"), geo_lat=F.lit("35.5"), geo_lng=F.when(k % 2 == 0, "false").otherwise("-85.25")))
    image = F.when(k % 4 == 0, "false").otherwise(json_of(url=F.when(k % 4 == 1, quoted("https://x/default.png")).otherwise(quoted("https://x/", k, ".png"))))
    tags = F.concat(F.lit('[{"name":"Music"},{"name":"music"},{"name":'), quoted(F.col("name")), F.lit("}]"))
    start = F.when(k % 5 == 0, "null").otherwise(quoted(day, " 10:00:00"))
    item = json_of(id=text(k), title=F.when(k % 7 == 0, quoted("")).otherwise(quoted("Tea &amp; ", F.col("name"))), description=quoted("<p>a ", k, "</p><p>b</p>"), utc_start_date=start, utc_end_date=F.when(k % 3 == 0, "null").otherwise(quoted(day, " 12:30:00")), venue=venue, image=image, categories=tags, url=quoted("u/", k))
    raw = land(listed(_orders(spark, sf), ["page"], "k", item, '{"events":[', "]}").withColumn("source_name", F.lit("cal")), "calendar")
    return _raw_out(calendars.paged_calendar(raw))


def _raw_out(rows: DataFrame) -> DataFrame:
    return rows.select("title", seconds("start_time").alias("start_at"), seconds("end_time").alias("end_at"), "source_url", "source_event_id", "description", "venue_name", "address", "latitude", "longitude", "image_url", F.array_join("tags", ",").alias("tags"))


@query("s08_aggregator", f"""WITH {_ORDERS}
SELECT CASE WHEN k % 7 = 0 THEN 'Untitled event' ELSE 'Fun Run ' || name END AS title, d + 36000 AS start_at, CAST(NULL AS BIGINT) AS end_at, CASE WHEN k % 3 = 0 THEN 'p/' || k WHEN k % 3 = 1 THEN 'l/' || k ELSE 'https://x/#/details/' || CASE WHEN k % 7 = 0 THEN 'event' ELSE 'fun-run-' || trim(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '-') END || '/' || k END AS source_url,
  'i' || k AS source_event_id, CASE WHEN k % 2 = 0 THEN 'about' ELSE '' END AS description, CAST(NULL AS VARCHAR) AS venue_name, 'Town, TN' AS address, 35.25 AS latitude, CAST(NULL AS DOUBLE) AS longitude, CASE WHEN k % 4 = 0 THEN 'b' || k || '.png' WHEN k % 4 = 1 THEN 'm' || k || '.png' END AS image_url, CASE WHEN k % 2 = 0 THEN 'sports,music' ELSE '' END AS tags FROM o WHERE k % 5 <> 0""")
def s08(spark, sf):
    k = F.col("k")
    start = quoted(F.date_format("day", "yyyy-MM-dd"), "T10:00:00Z")
    item = json_of(
        Name=F.when(k % 7 == 0, "null").otherwise(quoted("Fun Run ", F.col("name"))), PId=text(k), Id=quoted("i", k), StartUTC=F.when(k % 5 == 0, "null").otherwise(start), DateStart=start, Tags=F.when(k % 2 == 0, "[2,3,1]").otherwise("[]"), PrimaryUrl=F.when(k % 3 == 0, quoted("p/", k)).otherwise('""'),
        Links=F.when(k % 3 == 1, F.concat(F.lit('[{"url":""},{"url":'), quoted("l/", k), F.lit("}]"))).otherwise("[]"), MediumImg=F.when(k % 4 == 1, quoted("m", k, ".png")).otherwise(quoted("a/generic.png")), Images=F.when(k % 4 == 0, F.concat(F.lit('[{"url":'), quoted("b", k, ".png"), F.lit("}]"))).otherwise("[]"),
        CityState=quoted("Town, TN"), latitude=F.lit("35.25"), Description=F.when(k % 2 == 0, quoted("about")).otherwise("null"),
    )
    raw = land(listed(_orders(spark, sf), ["page"], "k", item, '{"Value":[', "]}").select(F.concat(F.lit("agg"), text("page")).alias("source_name"), F.lit("https://x/#/").alias("base_url"), "payload"), "aggregator")
    tree = spark.createDataFrame([(1, "Music"), (2, "Sports"), (3, "music")], "id int, name string")
    return _raw_out(calendars.aggregator(raw, tree))


@query("s09_graph_search", f"""WITH {_ORDERS}
SELECT CASE WHEN k % 7 = 0 THEN 'Untitled event' ELSE 'T ' || name END AS title, d + 36000 + 5 * 3600 AS start_at, CAST(NULL AS BIGINT) AS end_at, CASE WHEN k % 2 = 0 THEN 'e/' || k ELSE 'fallback' END AS source_url, CAST(k AS VARCHAR) AS source_event_id,
  CASE WHEN k % 3 = 0 THEN 'about' WHEN k % 3 = 1 THEN 'Group — about' ELSE 'Group' END AS description, 'Hall' AS venue_name, CASE WHEN k % 4 = 0 THEN 'Hall' ELSE '1 St, TN' END AS address, CAST(NULL AS DOUBLE) AS latitude, CAST(NULL AS DOUBLE) AS longitude,
  CASE WHEN k % 2 = 0 THEN 'h' || k || '.png' END AS image_url, '' AS tags FROM o WHERE k % 5 <> 0 AND k % 11 <> 0""")
def s09(spark, sf):
    k = F.col("k")
    when = F.when(k % 5 == 0, "null").otherwise(quoted(F.date_format("day", "yyyy-MM-dd"), "T10:00:00-05:00"))
    venue = F.when(k % 4 == 0, F.lit('{"name":"Hall","address":"","city":"","state":""}')).otherwise('{"name":"Hall","address":"1 St","city":"","state":"TN"}')
    photo = F.when(k % 2 == 0, F.concat(F.lit('{"source":"","highResUrl":'), quoted("h", k, ".png"), F.lit("}"))).otherwise("null")
    result = json_of(id=F.when(k % 11 == 0, '""').otherwise(quoted(k)), title=F.when(k % 7 == 0, '""').otherwise(quoted("T ", F.col("name"))), dateTime=when, eventUrl=F.when(k % 2 == 0, quoted("e/", k)).otherwise('""'), group=F.when(k % 3 == 0, "null").otherwise('{"name":"Group"}'), description=F.when(k % 3 == 2, "null").otherwise('"about"'), venue=venue, featuredEventPhoto=photo)
    item = json_of(node=json_of(result=result))
    raw = land(listed(_orders(spark, sf), ["page"], "k", item, '{"data":{"keywordSearch":{"edges":[', "]}}}").select(F.lit("m").alias("source_name"), F.lit("fallback").alias("fallback_url"), "payload"), "search")
    return _raw_out(calendars.graph_search(raw))


@query("s10_structured_pages", f"""WITH {_ORDERS}
SELECT 'Car & ' || name AS title, d + 43200 AS start_at, CASE WHEN k % 2 = 0 THEN d + 50400 END AS end_at, 'https://x.org/e/' || k || '/?a=1' AS source_url, 'e/' || k AS source_event_id, CASE WHEN k % 3 = 0 THEN 'plain text' ELSE '' END AS description, CASE WHEN k % 4 <> 0 THEN 'Lot ' || (k % 10) END AS venue_name,
  CASE WHEN k % 4 = 1 THEN '1 St, 37402' WHEN k % 4 = 2 THEN 'as one text' END AS address, CAST(NULL AS DOUBLE) AS latitude, CAST(NULL AS DOUBLE) AS longitude, CASE WHEN k % 3 = 0 THEN 'a' || k || '.png' WHEN k % 3 = 1 THEN 'b' || k || '.png' END AS image_url, '' AS tags FROM o WHERE k % 5 <> 0 AND page % 9 <> 0""")
def s10(spark, sf):
    """Nodes stand alone, in lists or in graphs, by page; every ninth page's block is no JSON."""
    k = F.col("k")
    day = F.date_format("day", "yyyy-MM-dd")
    place = F.when(k % 4 == 0, "null").when(k % 4 == 1, json_of(name=quoted("Lot ", k % 10), address=F.lit('{"streetAddress":"1 St","postalCode":"37402"}'))).when(k % 4 == 2, json_of(name=quoted("Lot ", k % 10), address=F.lit('"as one text"'))).otherwise(json_of(name=quoted("Lot ", k % 10)))
    image = F.when(k % 3 == 0, quoted("a", k, ".png")).when(k % 3 == 1, F.concat(F.lit('["a/stock.png",{"url":'), quoted("b", k, ".png"), F.lit("}]"))).otherwise("null")
    node = json_of(name=quoted("Car &amp; ", F.col("name")), startDate=F.when(k % 5 == 0, "null").otherwise(quoted(day, "T12:00:00Z")), endDate=F.when(k % 2 == 0, quoted(day, "T09:00:00-05:00")).otherwise("null"), url=quoted("https://x.org/e/", k, "/?a=1"), description=F.when(k % 3 == 0, quoted("<b>plain</b> text")).otherwise("null"), location=place, image=image)
    node = F.concat(F.lit('{"@type":"Event",'), F.substring(node, 2, 1 << 30))
    pages = listed(_orders(spark, sf), ["page"], "k", node, "", "")
    block = F.when(F.col("page") % 9 == 0, F.concat(F.lit("{oops"), "payload")).when(F.col("page") % 2 == 0, F.concat(F.lit("["), "payload", F.lit("]"))).otherwise(F.concat(F.lit('{"@graph":['), "payload", F.lit(',{"@type":"Org"}]}')))
    html = F.concat(F.lit('<html><script type="application/ld+json">'), block, F.lit("</script></html>"))
    return _raw_out(calendars.structured_pages(land(pages.select(F.lit("c").alias("source_name"), F.lit("p").alias("page_url"), html.alias("html")), "structured")))


#: The spans of all orders as their local hours in the year nearest to 2026-07-20, and the hours UTC is ahead at the start and the end: clocks change at 2; an hour that is left out goes by the time before, one that comes twice by its first.
SPANS = """o AS (SELECT o_orderkey AS k, month(o_orderdate) AS m, day(o_orderdate) AS dd, 1 + o_orderkey % 11 AS h FROM orders), y AS (SELECT *, try_cast(yr || '-' || lpad(CAST(m AS VARCHAR), 2, '0') || '-' || lpad(CAST(dd AS VARCHAR), 2, '0') AS DATE) AS dt FROM o, (SELECT unnest([2025, 2026, 2027]) AS yr)),
x AS (SELECT k, h, arg_min(dt, abs(date_diff('day', DATE '2026-07-20', dt)) * 10 + year(dt) - 2020) AS dt FROM y WHERE dt IS NOT NULL GROUP BY k, h),
z AS (SELECT *, CASE WHEN dt >= DATE '2025-11-02' AND dt < DATE '2026-03-08' OR dt >= DATE '2026-11-01' AND dt < DATE '2027-03-14' OR dt < DATE '2025-03-09' THEN 5 ELSE 4 END AS away FROM x),
t AS (SELECT k, dt, CAST(epoch(dt) AS BIGINT) + (h + CASE WHEN dt IN (DATE '2025-03-09', DATE '2026-03-08', DATE '2027-03-14') AND h <= 2 THEN 5 WHEN dt IN (DATE '2025-11-02', DATE '2026-11-01') AND h = 1 THEN 4 ELSE away END) * 3600 AS start_at, CAST(epoch(dt) AS BIGINT) + (h + 12 + away) * 3600 + 1800 AS end_at FROM z)"""


def _span() -> Column:
    h = text(F.col("k") % 11 + 1)
    return F.concat(F.date_format("day", "MMMM d"), F.lit(" | "), h, F.lit(" AM - "), h, F.lit(":30 p.m."))


@query("s12_ical", f"""WITH {_ORDERS}, q AS (SELECT *, CAST(make_timestamp(d * 1000000) AS DATE) AS day FROM o)
SELECT CASE WHEN k % 7 = 0 THEN 'Untitled event' ELSE 'Walk, ' || name || '; more' END AS title, CASE k % 4 WHEN 0 THEN d WHEN 1 THEN d + 36000 ELSE d + 43200 + 5 * 3600 - CASE WHEN day >= make_date(year(day), 4, 1) + CAST((7 - dayofweek(make_date(year(day), 4, 1))) % 7 AS INT) AND day < make_date(year(day), 10, 31) - CAST(dayofweek(make_date(year(day), 10, 31)) AS INT) THEN 3600 ELSE 0 END END AS start_at, CASE WHEN k % 4 = 1 THEN d + 45000 END AS end_at, CASE WHEN k % 2 = 0 THEN 'https://u/' || k ELSE 'feed' END AS source_url,
  'id' || k AS source_event_id, CASE WHEN k % 3 = 0 THEN 'first' || chr(10) || 'second' ELSE '' END AS description, 'Hall' AS venue_name, 'Hall' AS address, CAST(NULL AS DOUBLE) AS latitude, CAST(NULL AS DOUBLE) AS longitude, CASE WHEN k % 3 = 1 THEN 'https://x/' || k || '.jpg?s=1' WHEN k % 3 = 2 THEN 'https://x/' || k END AS image_url, '' AS tags
FROM q WHERE k % 5 <> 0""")
def s12(spark, sf):
    """Events of each page as one calendar file with folded lines. In the years of the orders summer time went from the first Sunday of April to the last of October."""
    k = F.col("k")
    day = F.date_format("day", "yyyyMMdd")
    start = F.when(k % 5 == 0, "").when(k % 4 == 0, F.concat(F.lit("DTSTART;VALUE=DATE:"), day, F.lit("\r\n"))).when(k % 4 == 1, F.concat(F.lit("DTSTART:"), day, F.lit("T100000Z\r\nDTEND:"), day, F.lit("T123000Z\r\n"))).otherwise(F.concat(F.lit("DTSTART;TZID=America/New_York:"), day, F.lit("T120000\r\n")))
    image = F.when(k % 3 == 1, F.concat(F.lit("ATTACH:https://x/Generic-1.jpg\r\nATTACH:https://x/"), text(k), F.lit(".jpg?s=1\r\n"))).when(k % 3 == 2, F.concat(F.lit("ATTACH;FMTTYPE=image/png:https://x/"), text(k), F.lit("\r\n"))).otherwise("")
    event = F.concat(
        F.lit("BEGIN:VEVENT\r\nUID:id"), text(k), F.lit("\r\n"), F.when(k % 7 == 0, "").otherwise(F.concat(F.lit("SUMMARY:Wa\r\n lk\\, "), "name", F.lit("\\; more\r\n"))), start, F.when(k % 2 == 0, F.concat(F.lit("URL:https://u/"), text(k), F.lit("\r\n"))).otherwise(""),
        F.when(k % 3 == 0, "DESCRIPTION:first\\nsecond\r\n").otherwise(""), F.lit("LOCATION:Hall\r\n"), image, F.lit("END:VEVENT\r\n"),
    )
    pages = _orders(spark, sf).groupBy("page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", event.alias("e")))), lambda x: x["e"]), "").alias("body"))
    raw = land(pages.select(F.lit("i").alias("source_name"), F.lit("feed").alias("feed_url"), F.concat(F.lit("BEGIN:VCALENDAR\r\n"), "body", F.lit("END:VCALENDAR")).alias("payload")), "ical")
    return _raw_out(calendars.ical(raw))


@query("s14_merge_pages", f"WITH {_ORDERS}, r AS (SELECT k % 997 AS id, page, k % 100 AS position, name, row_number() OVER (PARTITION BY k % 997 ORDER BY page, k % 100) AS rn FROM o) SELECT id, page, position, name FROM r WHERE rn = 1")
def s14(spark, sf):
    item = F.to_json(F.struct((F.col("k") % 997).alias("Id"), (F.col("k") % 100).alias("position"), "name"))
    raw = land(listed(_orders(spark, sf), ["page"], "k", item), "pages")
    rows = raw.select("page", F.explode(F.from_json("payload", "array<struct<Id:long,position:long,name:string>>")).alias("i")).select(F.col("i.Id").alias("id"), "page", "i.position", "i.name")
    return calendars.merge_pages(rows, "id", "page", "position")


# ---- stations: events as readings ----------------------------------------------------------------------------------

_AQI = "CASE WHEN aqi <= 50 THEN 1 WHEN aqi <= 100 THEN 2 WHEN aqi <= 150 THEN 3 WHEN aqi <= 200 THEN 4 WHEN aqi <= 300 THEN 5 ELSE 6 END"


@query("s13_stations", f"""WITH {_POLLED}, o AS (SELECT 'observation' AS kind, CAST(event_id AS VARCHAR) AS key, CASE WHEN event_id % 4 <> 0 THEN round(value, 3) END AS value, event_type AS label, CAST(NULL AS INT) AS category FROM ev),
q AS (SELECT event_id, event_type, CASE WHEN event_id % 5 = 0 THEN NULL WHEN event_id % 5 = 1 THEN NULL ELSE round(value * 4, 3) END AS aqi FROM ev),
s AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rank FROM ev)
SELECT * FROM o UNION ALL SELECT 'air', CAST(event_id AS VARCHAR), aqi, event_type, CASE WHEN aqi IS NOT NULL THEN {_AQI} END FROM q
UNION ALL SELECT 'station', user_id || ':' || rank, NULL, 'st' || event_id, NULL FROM s WHERE rank <= 3 UNION ALL SELECT 'forecast', user_id || ':' || rank, CAST(event_id % 90 AS DOUBLE), 'Period ' || event_id, NULL FROM s WHERE rank <= 2""")
def s13(spark, sf):
    e, k = _polled(spark, sf), F.col("event_id")
    value = F.round("value", 3)
    q = lambda v: json_of(value=F.coalesce(text(v), F.lit("null")))
    raw = e.select(text(k).alias("place"), text(k).alias("station"), F.lit(1).alias("rank"), json_of(properties=json_of(temperature=q(F.when(k % 4 != 0, value)), textDescription=quoted(F.col("event_type")))).alias("payload"))
    o = stations.observations(land(raw, "observations")).select(F.lit("observation").alias("kind"), F.col("station").alias("key"), F.col("temp_c").alias("value"), F.col("description").alias("label"), F.lit(None).cast("int").alias("category"))
    number = F.when(k % 5 == 0, "-999").when(k % 5 == 1, '"n/a"').otherwise(text(F.round(F.col("value") * 4, 3)))
    air = listed(e.withColumn("area", F.col("source_key")), ["area", "poll_at"], "event_id", json_of(parameterName=quoted(F.col("event_type")), nowcastAQI=number, aqiCategoryName=quoted(k)))
    a = stations.air_quality(land(air, "air")).select(F.lit("air"), "category_name", "aqi", "pollutant", "category")
    ids = land(listed(e.withColumn("place", text("user_id")), ["place"], "event_id", json_of(id=quoted("st", k)), '{"features":[', "]}"), "stations")
    s = stations.station_ids(ids, 3).select(F.lit("station"), F.concat("place", F.lit(":"), text("rank")), F.lit(None).cast("double"), "station", F.lit(None).cast("int"))
    periods = land(listed(e.withColumn("place", text("user_id")), ["place"], "event_id", json_of(name=quoted("Period ", k), temperature=text(k % 90)), '{"properties":{"periods":[', "]}}"), "forecasts")
    f = weather.first_periods(stations.forecasts(periods)).select(F.lit("forecast"), F.concat("place", F.lit(":"), text(F.col("position") + 1)), F.col("period.temperature"), F.col("period.name"), F.lit(None).cast("int"))
    return o.union(a).union(s).union(f)


@query("s11_details", f"""WITH {SPANS} SELECT 'Show ' || k AS title, start_at, end_at, 'https://zoo.example/events/e' || k AS source_url, 'e' || k || '#' || strftime(dt, '%Y-%m-%d') AS source_event_id, CASE WHEN k % 2 = 0 THEN 'Under stars' ELSE 'One. Two.' END AS description, CASE WHEN k % 3 = 0 THEN 'm' || k || '.png' END AS image_url
FROM t WHERE k % 5 <> 0 AND end_at >= CAST(epoch(TIMESTAMP '2026-07-20 12:00:00') AS BIGINT)""")
def s11(spark, sf):
    k = F.col("k")
    o = _orders(spark, sf)
    card = F.concat(F.lit('<a class="col third fundraiser" href="/events/e'), text(k), F.lit('"><h3>'), F.when(k % 5 == 0, "").otherwise(F.concat(F.lit("Card "), text(k))), F.lit("</h3>"), F.when(k % 3 == 0, F.concat(F.lit('<img src="m'), text(k), F.lit('.png">'))).otherwise(""), F.lit("</a>"))
    lists = land(listed(o, ["page"], "k", card, "<html>", "</html>").select(F.lit("https://zoo.example/list").alias("page_url"), F.col("payload").alias("html")), "cards")
    blurb = F.when(k % 2 == 0, "<h3>Under <b>stars</b></h3>").otherwise("")
    prices = F.when(k % 2 == 0, "").otherwise('<div id="prices"><section class="two-thirds"><p>One.</p><p>Two.</p></section></div>')
    page = F.concat(F.lit('<div class="intro"><h1>Show '), text(k), F.lit('</h1></div><div class="event-logo">'), blurb, F.lit("<h5><span>"), _span(), F.lit("</span><span>soon</span></h5></div>"), prices)
    details = land(o.select(F.concat(F.lit("https://zoo.example/events/e"), text(k)).alias("url"), page.alias("html")), "details")
    rows = calendars.occurrences(calendars.listing_cards(lists), details, F.lit("2026-07-20 12:00:00").cast("timestamp"), "Zoo", ("Zoo", "1 St", 35.0, -85.0))
    return rows.select("title", seconds("start_time").alias("start_at"), seconds("end_time").alias("end_at"), "source_url", "source_event_id", "description", "image_url")


# ---- streams -------------------------------------------------------------------------------------------------------


def _weekly(spark: SparkSession, sf: str) -> DataFrame:
    """Weekly polls of four feeds: the last event of a user in a week is the entity's state. Landed as files, one week after the other."""
    e = read(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    week = F.timestamp_seconds(F.floor(F.unix_seconds("ts") / (7 * DAY)) * 7 * DAY)
    rows = e.groupBy(F.concat(F.lit("src"), text(F.col("user_id") % 4)).alias("source_key"), text("user_id").alias("external_id"), week.alias("poll_at")).agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("status"), F.max_by("event_id", F.struct("ts", "event_id")).alias("last"))
    none = F.lit(None).cast("string")
    k = F.col("external_id").cast("long")
    return rows.select("source_key", "external_id", "poll_at", F.concat(F.lit("c"), text(k % 3)).alias("category"), F.concat(F.lit("user "), "external_id").alias("label"), ((F.lit(350456) + k % 50 * 10) / 10000).alias("lat"), ((F.lit(-853097) + F.col("last") % 2 * 100) / 10000).alias("lon"), none.alias("geometry"), "status", F.col("poll_at").alias("source_time"), none.alias("properties"))


_WEEKLY = """w AS (SELECT source_key, external_id, poll_at, status, printf('%.6f,%.6f', (-853097 + event_id % 2 * 100) / 10000, (350456 + user_id % 50 * 10) / 10000) AS fp FROM (
  SELECT 'src' || (user_id % 4) AS source_key, CAST(user_id AS VARCHAR) AS external_id, CAST(floor(epoch(ts) / 604800) AS BIGINT) * 604800 AS poll_at, event_type AS status, event_id, user_id,
         row_number() OVER (PARTITION BY user_id, CAST(floor(epoch(ts) / 604800) AS BIGINT) ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1),
l AS (SELECT *, lag(poll_at) OVER v AS p_at, lag(status) OVER v AS p_status, lag(fp) OVER v AS p_fp, lead(poll_at) OVER v AS n_at FROM w WINDOW v AS (PARTITION BY source_key, external_id ORDER BY poll_at)),
pl AS (SELECT DISTINCT poll_at FROM w), c AS (
  SELECT source_key, external_id, poll_at AS observed_at, CASE WHEN p_at IS NULL THEN 'new' ELSE 'updated' END AS change FROM l WHERE p_at IS NULL OR p_at < poll_at - 604800 OR p_status <> status OR p_fp <> fp
  UNION ALL SELECT source_key, external_id, poll_at + 604800, 'closed' FROM l WHERE poll_at + 604800 IN (SELECT poll_at FROM pl) AND (n_at IS NULL OR n_at > poll_at + 604800))"""


def _landed_stream(rows: DataFrame, name: str) -> DataFrame:
    path = new_path(rows.sparkSession, f"landed-{name}")
    rows.write.parquet(path)
    return rows.sparkSession.readStream.schema(rows.schema).parquet(path)


def _run(writer, spark: SparkSession) -> None:
    q = writer.option("checkpointLocation", new_path(spark, "stream")).trigger(availableNow=True).start()
    q.awaitTermination()


@query("r01_entity_changes", f"WITH {_WEEKLY} SELECT source_key, external_id, poll_at AS observed_at, CASE WHEN p_at IS NULL THEN 'new' ELSE 'updated' END AS change, status, fp AS fingerprint FROM l WHERE p_at IS NULL OR p_status <> status OR p_fp <> fp")
def r01(spark, sf):
    changes = streams.entity_changes(_landed_stream(_weekly(spark, sf), "polls"))
    path = new_path(spark, "entity-changes")
    _run(changes.writeStream.format("parquet").option("path", path).outputMode("append"), spark)
    return spark.read.schema(changes.schema).parquet(path).select("source_key", "external_id", seconds("observed_at").alias("observed_at"), "change", "status", "fingerprint")


@query("r01_poll_changes", f"WITH {_WEEKLY} SELECT source_key, external_id, observed_at, change FROM c")
def r01b(spark, sf):
    """New, updated and closed rows from one streaming query, its polls a second stream."""
    rows = _weekly(spark, sf)
    sources = F.array(*[F.lit(f"src{k}") for k in range(4)])
    polls = rows.select("poll_at").distinct().select(F.explode(sources).alias("source_key"), "poll_at", F.lit(True).alias("ok"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        changes = streams.poll_changes(_landed_stream(rows, "polled"), _landed_stream(polls, "poll-marks"), shards=4)
        path = new_path(spark, "poll-changes")
        _run(changes.writeStream.format("parquet").option("path", path).outputMode("append"), spark)
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    return spark.read.schema(changes.schema).parquet(path).select("source_key", "external_id", seconds("observed_at").alias("observed_at"), "change")


def _outbox(spark: SparkSession, sf: str) -> DataFrame:
    """The messages of a stream of weekly polls."""
    rows = _weekly(spark, sf)
    state, outbox = streams.VersionedTable(spark, new_path(spark, "state")), streams.VersionedTable(spark, new_path(spark, "outbox"))
    sources = F.array(*[F.lit(f"src{k}") for k in range(4)])
    polled = lambda b: b.select("poll_at").distinct().select(F.explode(sources).alias("source_key"), "poll_at", F.lit(True).alias("ok"))
    empty = history.final_state(rows.limit(0), polled(rows))
    _run(_landed_stream(rows, "poll-batches").writeStream.foreachBatch(streams.poll_batches(state, outbox, polled, empty)), spark)
    return outbox.all()


@query("r02_poll_batches", f"WITH {_WEEKLY} SELECT source_key, observed_at, coalesce(string_agg(external_id, ',' ORDER BY external_id) FILTER (WHERE change = 'new'), '') AS new, coalesce(string_agg(external_id, ',' ORDER BY external_id) FILTER (WHERE change = 'updated'), '') AS updated, coalesce(string_agg(external_id, ',' ORDER BY external_id) FILTER (WHERE change = 'closed'), '') AS closed FROM c GROUP BY 1, 2")
def r02(spark, sf):
    return _outbox(spark, sf).select("source_key", seconds("observed_at").alias("observed_at"), *[F.array_join(c, ",").alias(c) for c in ("new", "updated", "closed")])


@query("r03_article_batches", "SELECT doc_id AS id, 'https://example.org/a/' || doc_id AS url, CASE WHEN doc_id % 3 = 0 THEN 'again' ELSE 's' || (doc_id % 3) END AS category FROM documents UNION ALL SELECT 1000000000 + doc_id, 'https://example.org/b/' || doc_id, 'again' FROM documents WHERE doc_id % 3 = 1")
def r03(spark, sf):
    """All documents as stored articles; two of three come again in a batch, one of them as a new one."""
    a = articles(spark, sf).drop("lang").withColumnRenamed("feed_category", "category").withColumns({"cluster_id": F.lit(None).cast("long"), "guid": text("id")})
    n = F.col("id") % 3
    again = a.filter(n < 2).withColumns({"url": F.when(n == 1, F.concat(F.lit("https://example.org/b/"), text("id"))).otherwise(F.col("url")), "id": F.when(n == 1, F.col("id") + 1_000_000_000).otherwise(F.col("id")), "guid": F.when(n == 1, F.concat(F.lit("b"), text("id"))).otherwise(F.col("guid")), "category": F.lit("again")})
    stored, signals = streams.KeyedTable(spark, new_path(spark, "articles"), ["source_id", "guid"]), streams.VersionedTable(spark, new_path(spark, "signals"))
    stored.upsert(a, [], -1)
    _run(_landed_stream(again, "articles").writeStream.foreachBatch(streams.article_batches(stored, signals, lambda: F.lit("2024-01-08 00:00:00").cast("timestamp"))), spark)
    return stored.read().select("id", "url", "category")


@query("r04_signals", f"WITH {_WEEKLY} SELECT observed_at, count(*) FILTER (WHERE change = 'new') AS created, count(*) FILTER (WHERE change = 'updated') AS updated, count(*) FILTER (WHERE change = 'closed') AS closed FROM c GROUP BY 1")
def r04(spark, sf):
    m = _outbox(spark, sf).groupBy("observed_at").agg(*[F.coalesce(F.sum(F.size(c)), F.lit(0)).alias(n) for c, n in (("new", "created"), ("updated", "updated"), ("closed", "closed"))])
    summary = m.withColumn("changed", F.col("created") + F.col("updated") + F.col("closed") > 0)
    return streams.signals(summary).select(seconds("observed_at").alias("observed_at"), "created", "updated", "closed")
