"""The domain tables of the registered queries, derived from the given tables; the SQL prefixes say the same for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Polls of four feeds every six hours: the last event of a user in each is the entity's state."""
    e = read(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    k = F.get_json_object("props", "$.k").cast("int")
    rows = e.select(
        F.concat(F.lit("src"), (F.col("user_id") % 4).cast("string")).alias("source_key"), F.timestamp_seconds(F.floor(F.unix_seconds("ts") / 21600) * 21600).alias("poll_at"), F.col("user_id").cast("string").alias("external_id"),
        F.concat(F.lit("c"), (F.col("user_id") % 3).cast("string")).alias("category"), F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("label"),
        (F.lit(350456) + F.col("user_id") % 50 * 10).alias("lat4"), (F.lit(-853097) + F.floor(k / 50) * 100).alias("lon4"), F.lit(None).cast("string").alias("geometry"), F.col("event_type").alias("status"),
        F.col("ts").alias("source_time"), F.col("props").alias("properties"), F.col("value").alias("customer_quantity"), F.col("event_id").alias("seq"),
    )
    rows = rows.withColumns({"lat": F.col("lat4") / 10000, "lon": F.col("lon4") / 10000}).drop("lat4", "lon4")
    last = rows.groupBy("source_key", "external_id", "poll_at").agg(F.max_by(F.struct(*[c for c in rows.columns if c not in ("source_key", "external_id", "poll_at")]), F.struct("source_time", "seq")).alias("r"))
    return last.select("source_key", "external_id", "poll_at", "r.*")


def polls(snaps: DataFrame) -> DataFrame:
    """Every poll time of any source is a successful poll of the four sources."""
    sources = F.array(*[F.lit(f"src{k}") for k in range(4)])
    return snaps.select("poll_at").distinct().select(F.explode(sources).alias("source_key"), "poll_at", F.lit(True).alias("ok"))


SNAPSHOTS = """
snaps AS (
  SELECT source_key, external_id, poll_at, category, lat, lon, status, customer_quantity, ts, seq, k FROM (
    SELECT 'src' || (user_id % 4) AS source_key, CAST(user_id AS VARCHAR) AS external_id, CAST(floor(epoch(ts) / 21600) AS BIGINT) * 21600 AS poll_at, 'c' || (user_id % 3) AS category,
           (350456 + user_id % 50 * 10) / 10000 AS lat, (-853097 + CAST(floor(CAST(json_extract_string(props, '$.k') AS INT) / 50) AS BIGINT) * 100) / 10000 AS lon, event_type AS status, value AS customer_quantity, ts, event_id AS seq,
           CAST(json_extract_string(props, '$.k') AS INT) AS k,
           row_number() OVER (PARTITION BY user_id, CAST(floor(epoch(ts) / 21600) AS BIGINT) ORDER BY ts DESC, event_id DESC) AS rn
    FROM events) WHERE rn = 1
), fps AS (
  SELECT *, printf('%.6f,%.6f', lon, lat) AS fp FROM snaps
), pollq AS (
  SELECT source_key, poll_at, row_number() OVER (PARTITION BY source_key ORDER BY poll_at) AS poll_seq, lead(poll_at) OVER (PARTITION BY source_key ORDER BY poll_at) AS next_poll
  FROM (SELECT DISTINCT source_key FROM snaps) CROSS JOIN (SELECT DISTINCT poll_at FROM snaps)
), runs AS (
  SELECT f.*, p.poll_seq, p.next_poll, lag(p.poll_seq) OVER w AS p_seq, lag(status) OVER w AS p_status, lag(fp) OVER w AS p_fp, lead(p.poll_seq) OVER w AS n_seq
  FROM fps f JOIN pollq p USING (source_key, poll_at) WINDOW w AS (PARTITION BY source_key, external_id ORDER BY p.poll_seq)
), changes AS (
  SELECT source_key, external_id, poll_at AS observed_at, CASE WHEN p_seq IS NULL THEN 'new' ELSE 'updated' END AS change, status, fp, category, lat, lon
  FROM runs WHERE p_seq IS NULL OR p_seq <> poll_seq - 1 OR p_status IS DISTINCT FROM status OR p_fp IS DISTINCT FROM fp
  UNION ALL
  SELECT source_key, external_id, next_poll, 'closed', 'Closed', fp, category, lat, lon FROM runs WHERE next_poll IS NOT NULL AND (n_seq IS NULL OR n_seq > poll_seq + 1)
), state AS (
  SELECT source_key, external_id, min(poll_at) AS first_seen_at, arg_max(coalesce(next_poll, poll_at), poll_seq) AS last_seen_at, arg_max(CASE WHEN next_poll IS NULL THEN 1 ELSE 0 END, poll_seq) = 1 AS is_active,
         arg_max(status, poll_seq) AS status, arg_max(fp, poll_seq) AS fp, arg_max(category, poll_seq) AS category, arg_max(lat, poll_seq) AS lat, arg_max(lon, poll_seq) AS lon, arg_max(customer_quantity, poll_seq) AS customer_quantity, arg_max(k, poll_seq) AS k
  FROM runs GROUP BY source_key, external_id
)"""


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as articles of the outlet their source number names."""
    d = read(spark, sf_dir, "documents")
    head = F.regexp_extract("text", r"^([^.!?\n]*)", 1)
    title = F.left(head, F.lit(90))
    at = F.lit(1704067200) + F.col("doc_id") * 600
    return d.select(
        F.col("doc_id").alias("id"), F.regexp_extract("source", r"(\d+)", 1).cast("int").alias("source_id"), F.md5("text").alias("guid"), F.concat(F.lit("https://example.org/a/"), F.col("doc_id").cast("string")).alias("url"), title.alias("title"),
        F.expr("substring(text, char_length(regexp_extract(text, '^([^.!?\\\\n]*)', 1)) + 1, 400)").alias("summary"), F.timestamp_seconds(at).alias("published"), F.timestamp_seconds(at + (F.col("doc_id") % 5 - 1) * 3600).alias("fetched_at"),
        F.concat(F.lit("s"), (F.col("doc_id") % 3).cast("string")).alias("feed_category"), F.lit(None).cast("string").alias("image_url"), F.col("lang"),
    )


ARTICLES = r"""
arts AS (
  SELECT doc_id AS id, CAST(regexp_extract(source, '(\d+)', 1) AS INT) AS source_id, md5(text) AS guid, substring(h, 1, 90) AS title, substring(text, length(h) + 1, 400) AS summary,
         1704067200 + doc_id * 600 AS published, 1704067200 + doc_id * 600 + (doc_id % 5 - 1) * 3600 AS fetched_at, 's' || (doc_id % 3) AS feed_category, lang
  FROM (SELECT *, regexp_extract(text, '^([^.!?\n]*)', 1) AS h FROM documents)
)"""


def raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as event listings: three spellings of a part's name, by suppliers as venues."""
    li, p = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "part")
    j = li.join(p, li.l_partkey == p.p_partkey)
    n = F.col("l_linenumber") % 3
    title = F.when(n == 0, F.col("p_name")).when(n == 1, F.concat(F.lit("The "), F.col("p_name"), F.lit("!"))).otherwise(F.concat_ws(" ", "p_name", "p_brand"))
    start = F.floor(F.unix_seconds(F.col("l_shipdate").cast("timestamp")) / 86400) * 86400 + F.col("l_suppkey") % 24 * 3600
    place = F.col("l_partkey") % 4 != 0
    s = lambda c: F.col(c).cast("string")
    return j.select(
        title.alias("title"), F.timestamp_seconds(start).alias("start_time"), F.lit(None).cast("timestamp").alias("end_time"), F.concat(F.lit("s"), (F.col("l_suppkey") % 5).cast("string")).alias("source_name"),
        F.concat(F.lit("https://example.org/e/"), s("l_partkey"), F.lit("/"), s("l_suppkey")).alias("source_url"), F.when(F.col("l_orderkey") % 2 == 0, F.concat_ws("-", s("l_partkey"), s("l_suppkey"))).alias("source_event_id"),
        F.when(F.col("l_orderkey") % 3 == 0, "").otherwise(F.col("p_type")).alias("description"), F.concat(F.lit("Venue "), (F.col("l_suppkey") % 10).cast("string")).alias("venue_name"), F.lit(None).cast("string").alias("address"),
        F.when(place, (F.lit(350456) + F.col("l_suppkey") % 40 * 5) / 10000).alias("latitude"), F.when(place, F.lit(-85.3097)).alias("longitude"), F.lit(None).cast("string").alias("image_url"),
        F.array(F.lower("p_type")).alias("tags"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"),
    )


RAW_EVENTS = """
raws AS (
  SELECT CASE l_linenumber % 3 WHEN 0 THEN p_name WHEN 1 THEN 'The ' || p_name || '!' ELSE p_name || ' ' || p_brand END AS title,
         CAST(floor(epoch(l_shipdate) / 86400) AS BIGINT) * 86400 + l_suppkey % 24 * 3600 AS start_time, 's' || (l_suppkey % 5) AS source_name, 'https://example.org/e/' || l_partkey || '/' || l_suppkey AS source_url,
         CASE WHEN l_orderkey % 2 = 0 THEN l_partkey || '-' || l_suppkey END AS source_event_id, CASE WHEN l_orderkey % 3 = 0 THEN '' ELSE p_type END AS description, 'Venue ' || (l_suppkey % 10) AS venue_name,
         CASE WHEN l_partkey % 4 <> 0 THEN (350456 + l_suppkey % 40 * 5) / 10000 END AS latitude, CASE WHEN l_partkey % 4 <> 0 THEN -85.3097 END AS longitude, lower(p_type) AS tag, l_orderkey * 10 + l_linenumber AS seq
  FROM lineitem JOIN part ON l_partkey = p_partkey
)"""


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as hourly pollutant readings of twenty areas."""
    e = read(spark, sf_dir, "events")
    return e.select((F.col("user_id") % 20).alias("area"), F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 3600).alias("hour"), F.col("event_type").alias("pollutant"), F.col("value").alias("aqi"), F.col("event_id").alias("position"))


READINGS = """
reads AS (SELECT user_id % 20 AS area, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS hour, event_type AS pollutant, value AS aqi, event_id AS position FROM events)"""
