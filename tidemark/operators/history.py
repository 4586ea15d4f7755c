"""Snapshots of live feeds to a change history: what is new, what changed, what went away.

A snapshot row: source_key, poll_at, external_id, category, label, lat, lon, geometry (GeoJSON text), status,
source_time, properties (JSON text). `polls` (source_key, poll_at, ok) lists every poll, so that an empty successful
poll closes everything and a failed one nothing. An id that stands twice in one snapshot counts once: the last row by
(seq, or status and properties where there is no seq column).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.geo import grid_cell, in_bbox, resolved_geometry, with_fingerprint
from tidemark.functions.openjson import json_string, member, members, merged, written
from tidemark.tables import materialize

KEY = ["source_key", "external_id"]
CLOSED = "Closed"


def state_changed(prev_status: Column, prev_fp: Column, prev_active: Column, status: Column, fp: Column) -> Column:
    """True if the entity was inactive, or its status or fingerprint differs; '' and null are equal."""
    same = lambda a, b: F.nullif(a, F.lit("")).eqNullSafe(F.nullif(b, F.lit("")))
    return ~prev_active | ~same(prev_status, status) | ~same(prev_fp, fp)


def latest_properties(properties: Column, status: Column) -> Column:
    """Properties with `status` replaced by the normalized one, null where there is none; all other values keep their type."""
    return written(merged(members(properties), F.array(member("status", json_string(status)))))


def with_source_time(properties: Column, source_time: Column) -> Column:
    """Properties with `source_time` as ISO text, unless the key is there already or there is no time; all other values keep their type."""
    iso = F.date_format(source_time, "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
    add = F.when(source_time.isNotNull(), F.array(member("source_time", json_string(iso)))).otherwise(F.array().cast("array<struct<key:string,value:string>>"))
    return written(merged(add, members(properties)))


def _tie(snapshots: DataFrame) -> list[str]:
    """What tells rows of one id in one poll apart: the greatest counts."""
    return ["seq"] if "seq" in snapshots.columns else ["status", "properties"]


def one_per_poll(snapshots: DataFrame) -> DataFrame:
    w = Window.partitionBy(*KEY, "poll_at").orderBy(*[F.col(c).desc_nulls_last() for c in _tie(snapshots)])
    return snapshots.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n")


def numbered_polls(polls: DataFrame) -> DataFrame:
    """Successful polls with `seq` from 1 in each source, and the next poll's time. Polls are few: one row for each minute at most."""
    w = Window.partitionBy("source_key").orderBy("poll_at")
    return polls.filter("ok").select("source_key", "poll_at").distinct().withColumns({"poll_seq": F.row_number().over(w), "next_poll": F.lead("poll_at").over(w)})


#: Polls of a history that are sent to the executors: some 50 MB. More are joined by a shuffle.
_SENT_POLLS = 1_000_000


def _of_polls(snapshots: DataFrame, polls: DataFrame) -> DataFrame:
    """Snapshot rows of successful polls with poll_seq and next_poll. The polls are written and counted first."""
    p = materialize(numbered_polls(polls), "polls")
    return snapshots.join(F.broadcast(p) if p.count() <= _SENT_POLLS else p, ["source_key", "poll_at"])


def replay(snapshots: DataFrame, polls: DataFrame) -> DataFrame:
    """The whole change log of a poll history: source_key, external_id, observed_at, change (new/updated/closed), status, fingerprint, category, label, lat, lon, geometry, properties, source_time.

    The same log as reconciling poll by poll. Rows of failed or unlisted polls are ignored. One shuffle and one sort, by
    entity: rows of an id that stands twice in a poll lie side by side, and all but the last go; closures are read off
    the gap to an entity's next poll, so nothing is compared with every poll.
    """
    rows = with_fingerprint(_of_polls(snapshots, polls))
    in_order = Window.partitionBy(*KEY).orderBy("poll_seq", *[F.col(c).asc_nulls_first() for c in _tie(snapshots)])
    again = F.lead("poll_seq").over(in_order)
    rows = rows.withColumn("__again", again).filter(F.col("__again").isNull() | (F.col("__again") != F.col("poll_seq"))).drop("__again")
    w = Window.partitionBy(*KEY).orderBy("poll_seq")
    lag = lambda c: F.lag(c).over(w)
    rows = rows.withColumns({"p_seq": lag("poll_seq"), "p_status": lag("status"), "p_fp": lag("fingerprint"), "n_seq": F.lead("poll_seq").over(w)})
    gone = F.col("next_poll").isNotNull() & (F.col("n_seq").isNull() | (F.col("n_seq") > F.col("poll_seq") + 1))
    changed = F.col("p_seq").isNull() | state_changed(F.col("p_status"), F.col("p_fp"), F.col("p_seq") == F.col("poll_seq") - 1, F.col("status"), F.col("fingerprint"))
    seen = F.when(changed, F.struct(F.col("poll_at").alias("at"), F.when(F.col("p_seq").isNull(), "new").otherwise("updated").alias("change")))
    left = F.when(gone, F.struct(F.col("next_poll").alias("at"), F.lit("closed").alias("change")))
    out = rows.withColumn("__e", F.explode(F.array_compact(F.array(seen, left))))
    closed = F.col("__e.change") == "closed"
    return out.select(
        *KEY, F.col("__e.at").alias("observed_at"), F.col("__e.change").alias("change"), F.when(closed, CLOSED).otherwise(F.col("status")).alias("status"), "fingerprint", "category", "label", "lat", "lon", "geometry",
        F.when(closed, '{"reason":"absent_from_feed"}').otherwise(with_source_time(F.col("properties"), F.col("source_time"))).alias("properties"), F.when(~closed, F.col("source_time")).alias("source_time"),
    )


def final_state(snapshots: DataFrame, polls: DataFrame) -> DataFrame:
    """Current state after a poll history: one row per entity with first and last sight, activity, and the last row's fields. One shuffle, of one row per entity and task."""
    rows = _of_polls(snapshots, polls)
    fields = ["poll_at", "next_poll", "category", "label", "status", "lat", "lon", "geometry", "properties"]
    last = F.struct("poll_seq", *_tie(snapshots))
    state = with_fingerprint(rows.groupBy(*KEY).agg(F.min("poll_at").alias("first_seen_at"), F.max_by(F.struct(*fields), last).alias("l")).select(*KEY, "first_seen_at", "l.*"))
    return state.select(
        *KEY, "category", "label", "first_seen_at", F.coalesce("next_poll", "poll_at").alias("last_seen_at"), F.col("next_poll").isNull().alias("is_active"), "status", "fingerprint", "lat", "lon", "geometry",
        latest_properties(F.col("properties"), F.col("status")).alias("properties"),
    )


def reconcile(state: DataFrame, snapshot: DataFrame, polls: DataFrame) -> DataFrame:
    """One poll of each source against the stored state: every touched entity with `change` (new/updated/unchanged/closed) and its new state.

    `polls`: source_key, poll_at, ok of this round. Sources without a successful poll are left alone. Of the state only
    active rows and those present in the snapshot are joined; the join shuffles once by entity.
    """
    ok = polls.filter("ok").select("source_key", F.col("poll_at").alias("__now")).distinct()
    snap = with_fingerprint(one_per_poll(snapshot)).join(ok, "source_key").filter(F.col("poll_at") == F.col("__now")).drop("__now", "poll_at")
    present = snap.select(*KEY).withColumn("__here", F.lit(True))
    old = state.join(ok, "source_key", "left_semi").join(present, KEY, "left").filter(F.col("is_active") | F.col("__here")).drop("__here")
    fields = ["category", "label", "status", "fingerprint", "lat", "lon", "geometry", "properties"]
    n = snap.select(*KEY, F.struct(*fields).alias("n"))
    o = old.select(*KEY, F.struct(*fields, "first_seen_at", "last_seen_at", "is_active").alias("o"))
    both = o.join(n, KEY, "full_outer").join(ok, "source_key")
    change = (
        F.when(F.col("o").isNull(), "new")
        .when(F.col("n").isNull(), "closed")
        .when(state_changed(F.col("o.status"), F.col("o.fingerprint"), F.col("o.is_active"), F.col("n.status"), F.col("n.fingerprint")), "updated")
        .otherwise("unchanged")
    )
    pick = lambda c: F.when(F.col("n").isNull(), F.col(f"o.{c}")).otherwise(F.col(f"n.{c}")).alias(c)
    return both.select(
        *KEY, change.alias("change"), pick("category"), pick("label"), F.coalesce(F.col("o.first_seen_at"), F.col("__now")).alias("first_seen_at"), F.col("__now").alias("last_seen_at"), F.col("n").isNotNull().alias("is_active"), pick("status"),
        pick("fingerprint"), pick("lat"), pick("lon"), pick("geometry"), F.when(F.col("n").isNull(), F.col("o.properties")).otherwise(latest_properties(F.col("n.properties"), F.col("n.status"))).alias("properties"),
    )


def merged_state(state: DataFrame, changes: DataFrame) -> DataFrame:
    """State after reconcile(): touched rows replaced, the rest kept."""
    return state.join(changes, KEY, "left_anti").unionByName(changes.select(*state.columns))


def shown_status(active: Column, status: Column) -> Column:
    return F.when(~active, CLOSED).otherwise(status)


def entities(state: DataFrame, now: Column, active: bool = True, source: str | None = None, category: str | None = None, bbox: tuple | None = None, closed_within: int | None = None) -> DataFrame:
    """Entities that are active (or not), with closed_within also those closed in the last minutes (0 to 10080), by source, category and box; closed ones show `Closed`."""
    if closed_within is not None and not 0 <= closed_within <= 10080:
        raise ValueError("closed_within must be 0 to 10080 minutes")
    keep = F.col("is_active") if active else ~F.col("is_active")
    if active and closed_within is not None:
        keep |= F.col("last_seen_at") >= now - F.make_dt_interval(mins=F.lit(closed_within))
    out = state.filter(keep)
    if source:
        out = out.filter(F.col("source_key") == source)
    if category:
        out = out.filter(F.col("category") == category)
    if bbox:
        out = out.filter(in_bbox(F.col("lon"), F.col("lat"), bbox))
    return out.withColumn("status", shown_status(F.col("is_active"), F.col("status")))


def utc_day(at: Column) -> Column:
    """The day of a time by UTC, whatever the session's time zone."""
    return F.date_from_unix_date(F.floor(F.unix_micros(at) / 86_400_000_000).cast("int"))


def observations(log: DataFrame, source: str | None = None, category: str | None = None, start: Column | None = None, end: Column | None = None, bbox: tuple | None = None, limit: int = 5000) -> DataFrame:
    """Observations of a window (both ends included), newest first, at most `limit` (1 to 50000).

    On history written by append_observations the source and the days of the window choose the folders to read, and a
    box the row groups: their statistics hold a narrow range of coordinates each.
    """
    if not 1 <= limit <= 50000:
        raise ValueError("limit must be 1 to 50000")
    out = log
    stored = "observed_date" in log.columns
    if source:
        out = out.filter(F.col("source_key") == source)
    if category:
        out = out.filter(F.col("category") == category)
    if start is not None:
        out = out.filter(F.col("observed_at") >= start)
        out = out.filter(F.col("observed_date") >= utc_day(start)) if stored else out
    if end is not None:
        out = out.filter(F.col("observed_at") <= end)
        out = out.filter(F.col("observed_date") <= utc_day(end)) if stored else out
    if bbox:
        out = out.filter(F.col("lon").between(bbox[0], bbox[2])).filter(F.col("lat").between(bbox[1], bbox[3]))
    return out.orderBy(F.desc("observed_at"), *KEY).limit(limit)


def tracks(log: DataFrame, steps: int = 10_000) -> DataFrame:
    """Every entity's observations, oldest first, with coordinates for points only, as rows of at most `steps` observations: source_key, external_id, segment (from 0, in order of time), track.

    An entity's rows are numbered in a sorted stream, so no row of the result and no group holds more than `steps`,
    however long a track is.
    """
    step = F.struct("observed_at", "status", F.when(F.col("geometry").isNull(), F.col("lon")).alias("lon"), F.when(F.col("geometry").isNull(), F.col("lat")).alias("lat"))
    rows = log.select(*KEY, step.alias("step"))
    number = F.row_number().over(Window.partitionBy(*KEY).orderBy("step"))
    cut = rows.withColumn("segment", F.floor((number - 1) / steps).cast("long"))
    return cut.groupBy(*KEY, "segment").agg(F.array_sort(F.collect_list("step")).alias("track"))


def entity_properties(properties: Column, own: Column) -> Column:
    """Feature properties of an entity, as JSON text: its own fields win over raw ones; values keep their type."""
    return written(merged(members(properties), members(own)))


def observation_properties(properties: Column, own: Column) -> Column:
    """Feature properties of an observation, as JSON text: stored ones win over added ones; values keep their type."""
    return written(merged(members(own), members(properties)))


def last_runs(runs: DataFrame) -> DataFrame:
    """The latest run of each source: status, error, count and time."""
    return runs.groupBy("source_key").agg(F.max_by(F.struct("run_at", "status", "error", "count"), "run_at").alias("r")).select("source_key", F.col("r.run_at").alias("last_run_at"), F.col("r.status").alias("last_status"), F.col("r.error").alias("last_error"), F.col("r.count").alias("last_count"))


def outage_rollup(state: DataFrame, services: DataFrame) -> DataFrame:
    """Active outages of each listed service: how many, and the customers of those with a number above 0. Services without any show 0."""
    q = F.col("customer_quantity").try_cast("double")
    sums = state.filter("is_active").groupBy("category").agg(F.count(F.lit(1)).alias("outages"), F.sum(F.when(q > 0, q)).alias("customers"))
    return services.join(sums, services.service == sums.category, "left").select("service", F.coalesce("outages", F.lit(0)).alias("outages"), F.coalesce("customers", F.lit(0.0)).alias("customers"))


def facet(state: DataFrame, column: str) -> DataFrame:
    """Distinct values that are not empty, sorted."""
    return state.filter(F.col(column).isNotNull() & (F.col(column) != "")).select(F.col(column).alias("value")).distinct().orderBy("value")


def feature_filter(features: DataFrame, enabled: list[str], hide_closed: bool = False, status: str | None = None, search: str = "") -> DataFrame:
    """Features of the enabled `source:category` keys, by status and a case-blind text in title, location or status; latest sight first."""
    out = features.filter(F.concat_ws(":", "source_key", "category").isin(*enabled))
    if hide_closed:
        out = out.filter(F.coalesce(F.col("status"), F.lit("")) != CLOSED)
    if status:
        out = out.filter(F.col("status") == status)
    if search:
        hay = F.lower(F.concat_ws(" ", *[F.coalesce(F.col(c), F.lit("")) for c in ("title", "location", "status")]))
        out = out.filter(hay.contains(search.lower()))
    return out.orderBy(F.desc("last_seen_at"), *KEY)


def status_label(code: Column, labels: dict[str, str]) -> Column:
    """A status for readers: from the table, else underscores to blanks and a capital."""
    plain = F.lower(F.replace(code, F.lit("_"), F.lit(" ")))
    known = [F.when(code == k, F.lit(v)) for k, v in labels.items()]
    return F.coalesce(*known, F.concat(F.upper(F.left(plain, F.lit(1))), F.substring(plain, F.lit(2), F.length(plain))))


def advisory_title(header: Column) -> Column:
    """What stands before ` : `."""
    return F.trim(F.substring_index(header, " : ", 1))


def fold_changes(changes: DataFrame, order: str = "observed_at", keep_closed: bool = False) -> DataFrame:
    """A change feed folded to current rows: the last change of each entity; closed ones go or stay as `Closed`. At one time a closure comes last."""
    fields = [c for c in changes.columns if c not in KEY]
    last = changes.groupBy(*KEY).agg(F.max_by(F.struct(*fields), F.struct(F.col(order), (F.col("change") == "closed").alias("c"))).alias("l")).select(*KEY, *[f"l.{c}" for c in fields])
    return last.withColumn("status", F.when(F.col("change") == "closed", CLOSED).otherwise(F.col("status"))) if keep_closed else last.filter("change <> 'closed'")


def change_messages(changes: DataFrame) -> DataFrame:
    """One message per source and time with lists of new, updated and closed ids; none where nothing changed."""
    ids = lambda kind: F.array_sort(F.collect_list(F.when(F.col("change") == kind, F.col("external_id"))))
    return changes.filter(F.col("change").isin("new", "updated", "closed")).groupBy("source_key", "observed_at").agg(ids("new").alias("new"), ids("updated").alias("updated"), ids("closed").alias("closed"))


def geometry_of(df: DataFrame) -> Column:
    return resolved_geometry(F.col("geometry"), F.col("lat"), F.col("lon"))


def features(df: DataFrame, properties: Column) -> DataFrame:
    """One GeoJSON Feature text per row; properties are JSON text, taken as it is, or a struct or map."""
    shape = F.coalesce(geometry_of(df), F.lit("null"))
    text = df.select(properties.alias("p")).schema["p"].dataType.typeName() == "string"
    inside = F.coalesce(properties, F.lit("{}")) if text else F.to_json(properties)
    return df.select(F.concat(F.lit('{"type":"Feature","geometry":'), shape, F.lit(',"properties":'), inside, F.lit("}")).alias("value"))


def append_observations(log: DataFrame, path: str, batch: str) -> None:
    """Append a batch to history in folders by source, UTC day and batch. A batch that comes again replaces its own folders and no other, so a retry doubles nothing.

    Rows are dealt by ranges of (source, day, cell of the globe, time): a hot source-day is cut into as many ranges as its
    share needs, and each file holds a narrow stretch of places and times, which its statistics tell a reader.
    """
    dated = log.withColumns({"observed_date": utc_day(F.col("observed_at")), "batch": F.lit(batch), "cell": grid_cell(F.col("lat"), F.col("lon"))})
    order = ["source_key", "observed_date", "cell", "observed_at", "external_id"]
    dealt = dated.repartitionByRange(*order).sortWithinPartitions("source_key", "observed_date", "batch", "cell", "observed_at", "external_id")
    dealt.write.partitionBy("source_key", "observed_date", "batch").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)


def stored_observations(spark: SparkSession, path: str) -> DataFrame:
    """History as append_observations() wrote it; source_key and batch are texts."""
    fields = spark.read.parquet(path).schema
    as_text = [f"`{f.name}` string" if f.name in ("source_key", "batch") else f"`{f.name}` {f.dataType.simpleString()}" for f in fields]
    return spark.read.schema(", ".join(as_text)).parquet(path)


def upsert(target: DataFrame, rows: DataFrame, key: list[str], update: list[str]) -> DataFrame:
    """target with rows inserted, or their `update` columns replaced where the key is known; other columns keep what was stored. A key that stands twice in rows counts once (any; deduplicate before)."""
    marked = rows.withColumn("__new", F.lit(True))
    t, r = target.alias("t"), marked.alias("r")
    on = [F.col(f"t.{k}").eqNullSafe(F.col(f"r.{k}")) for k in key]
    joined = t.withColumn("__old", F.lit(True)).alias("t").join(r, on, "full_outer")
    pick = []
    for c in target.columns:
        new, old = F.col(f"r.{c}"), F.col(f"t.{c}")
        if c in key or c not in update:
            pick.append(F.when(F.col("t.__old"), old).otherwise(new).alias(c))
        else:
            pick.append(F.when(F.col("r.__new"), new).otherwise(old).alias(c))
    return joined.select(*pick)


def registry_sync(rows: DataFrame, children: DataFrame, registry: DataFrame, key: str, parent: str) -> tuple[DataFrame, DataFrame]:
    """rows and their children without those missing from the registry."""
    kept = rows.join(registry.select(key).distinct(), key, "left_semi")
    return kept, children.join(kept.select(F.col(key).alias(parent)).distinct(), parent, "left_semi")
