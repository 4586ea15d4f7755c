import datetime as dt
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from tidemark.operators import history

SNAP = "source_key string, poll_at timestamp, external_id string, category string, label string, lat double, lon double, geometry string, status string, source_time timestamp, properties string"
T0 = dt.datetime(2024, 1, 1)
POLLY = '{"type":"Polygon","coordinates":[[[0,0],[0,1],[1,1],[0,0]]]}'


def at(k):
    return T0 + dt.timedelta(minutes=k)


def row(k, i, status="Queued", source="s", lat=35.0, geometry=None, properties='{"a":"1","status":"raw"}'):
    return (source, at(k), i, "c", f"l{i}", lat, -85.0, geometry, status, None, properties)


def frames(spark, rows, polls):
    return spark.createDataFrame(rows, SNAP), spark.createDataFrame(polls, "source_key string, poll_at timestamp, ok boolean")


def counts(log):
    return {(r.observed_at, r.change): r.n for r in log.groupBy("observed_at", "change").agg(F.count(F.lit(1)).alias("n")).collect()}


def test_lifecycle(spark):
    rows = [row(1, "1"), row(1, "2", "Enroute"), row(2, "1", "Enroute"), row(2, "2", "Enroute"), row(3, "1", "Enroute"), row(4, "1", "Enroute"), row(4, "2")]
    s, p = frames(spark, rows, [("s", at(k), True) for k in range(1, 5)])
    log = history.replay(s, p)
    assert counts(log) == {(at(1), "new"): 2, (at(2), "updated"): 1, (at(3), "closed"): 1, (at(4), "updated"): 1}
    closed = log.filter("change = 'closed'").first()
    assert closed.properties == '{"reason":"absent_from_feed"}' and closed.status == "Closed" and closed.lat == 35.0
    state = {r.external_id: r for r in history.final_state(s, p).collect()}
    assert all(r.is_active for r in state.values()) and state["2"].first_seen_at == at(1)
    assert '"status":"Queued"' in state["2"].properties


def test_empty_and_failed_polls(spark):
    s, p = frames(spark, [row(1, "1"), row(1, "2")], [("s", at(1), True), ("s", at(2), False), ("s", at(3), True)])
    assert counts(history.replay(s, p)) == {(at(1), "new"): 2, (at(3), "closed"): 2}
    s, p = frames(spark, [row(1, "1", None), row(2, "1", None), row(3, "1", geometry=POLLY)], [("s", at(k), True) for k in (1, 2, 3)])
    log = history.replay(s, p)
    assert counts(log) == {(at(1), "new"): 1, (at(3), "updated"): 1}
    assert history.replay(s.limit(0), p).count() == 0


def test_replay_equals_poll_by_poll(spark):
    rng = random.Random(1)
    rows, polls = [], []
    for source in ("a", "b"):
        for k in range(1, 7):
            ok = rng.random() > 0.2
            polls.append((source, at(k), ok))
            for i in range(8):
                if ok and rng.random() > 0.4:
                    rows.append(row(k, str(i), rng.choice(["x", "y", None, ""]), source, rng.choice([35.0, 36.0]), rng.choice([None, None, POLLY])))
    rows.append(rows[0])
    s, p = frames(spark, rows, polls)
    state, log = None, []
    for k in range(1, 7):
        one, now = s.filter(F.col("poll_at") == F.lit(at(k))), p.filter(F.col("poll_at") == F.lit(at(k)))
        if state is None:
            state = history.reconcile(history.final_state(one.limit(0), now), one, now)
            changes = state
        else:
            changes = history.reconcile(state.drop("change"), one, now)
        changes = spark.createDataFrame(changes.collect(), changes.schema)
        log += [(r.source_key, r.external_id, at(k), r.change, "Closed" if r.change == "closed" else r.status, r.fingerprint) for r in changes.collect() if r.change != "unchanged"]
        merged = history.merged_state(state.drop("change"), changes) if k > 1 else changes.drop("change")
        state = spark.createDataFrame(merged.collect(), merged.schema)
    want = sorted(log, key=repr)
    got = sorted([(r.source_key, r.external_id, r.observed_at, r.change, r.status, r.fingerprint) for r in history.replay(s, p).collect()], key=repr)
    assert got == want
    fields = ["source_key", "external_id", "is_active", "first_seen_at", "last_seen_at", "status", "fingerprint"]
    shuffled = history.final_state(s.repartition(7), p.repartition(3))
    # a closed entity was last seen when its absence was noticed
    assert sorted(map(tuple, shuffled.select(*fields).collect()), key=repr) == sorted(map(tuple, state.select(*fields).collect()), key=repr)


def test_queries(spark):
    s, p = frames(spark, [row(1, "1"), row(2, "1"), row(1, "2"), row(1, "3", geometry=POLLY), row(2, "3", geometry=POLLY)], [("s", at(1), True), ("s", at(2), True)])
    state, log = history.final_state(s, p), history.replay(s, p)
    now = F.lit(at(2))
    ids = lambda df: sorted(r.external_id for r in df.collect())
    assert ids(history.entities(state, now)) == ["1", "3"] and ids(history.entities(state, now, active=False)) == ["2"] and ids(history.entities(state, now, closed_within=0)) == ["1", "2", "3"]
    assert ids(history.entities(state, now, bbox=(-86, 34, -84, 35))) == ["1", "3"] and ids(history.entities(state, now, category="z")) == []
    for bad in (-1, 10081):
        with pytest.raises(ValueError):
            history.entities(state, now, closed_within=bad)
    with pytest.raises(ValueError):
        history.observations(log, limit=0)
    assert [r.external_id for r in history.observations(log, start=F.lit(at(1)), end=F.lit(at(2)), limit=2).collect()] == ["2", "1"]
    tracks = {r.external_id: r.track for r in history.tracks(log).collect()}
    assert [x.status for x in tracks["2"]] == ["Queued", "Closed"] and tracks["3"][0].lon is None
    assert ids(history.fold_changes(log)) == ["1", "3"] and {r.external_id: r.status for r in history.fold_changes(log, keep_closed=True).collect()}["2"] == "Closed"
    messages = {r.observed_at: r for r in history.change_messages(log).collect()}
    assert list(messages[at(1)].new) == ["1", "2", "3"] and list(messages[at(2)].closed) == ["2"]
    feature = [r.value for r in history.features(state, F.struct("external_id")).collect() if '"3"' in r.value][0]
    assert feature == f'{{"type":"Feature","geometry":{POLLY},"properties":{{"external_id":"3"}}}}'


def test_tables(spark, tmp_path):
    s, p = frames(spark, [row(1, "1"), row(3000, "1", "x")], [("s", at(1), True), ("s", at(3000), True)])
    log = history.replay(s, p)
    for batch in ("1", "2", "2"):
        history.append_observations(log, str(tmp_path / "h"), batch)
    back = history.stored_observations(spark, str(tmp_path / "h"))
    assert back.count() == 4 and sorted(x.name for x in (tmp_path / "h" / "source_key=s").iterdir()) == ["observed_date=2024-01-01", "observed_date=2024-01-03"]
    t = spark.createDataFrame([(1, "a", "k"), (2, None, "k")], "id int, v string, w string")
    r = spark.createDataFrame([(2, "b", "n"), (3, "c", "n")], "id int, v string, w string")
    assert sorted(map(tuple, history.upsert(t, r, ["id"], ["v"]).collect())) == [(1, "a", "k"), (2, "b", "k"), (3, "c", "n")]
    kept, children = history.registry_sync(t, spark.createDataFrame([(1, 9), (2, 8)], "parent int, x int"), r, "id", "parent")
    assert [r.id for r in kept.collect()] == [2] and [r.x for r in children.collect()] == [8]


TYPED = '{"n": 3, "f": 2.5, "big": 12345678901234567890, "yes": true, "no": null, "text": "3", "quote": "a\\"b\\u00e9", "where": {"a": [1, null, {"b": false}]}, "status": "raw"}'


def test_open_properties_keep_their_types(spark):
    def changed(text, status, at_time=None):
        c = F.lit(text).cast("string")
        row = spark.range(1).select(history.latest_properties(c, F.lit(status).cast("string")).alias("l"), history.with_source_time(c, F.lit(at_time).cast("timestamp")).alias("t")).first()
        return json.loads(row.l), json.loads(row.t)

    plain = json.loads(TYPED)
    latest, timed = changed(TYPED, "Open", "2024-01-02 03:04:05")
    assert latest == plain | {"status": "Open"} and type(latest["n"]) is int and latest["yes"] is True
    assert timed == plain | {"source_time": "2024-01-02T03:04:05+00:00"}
    assert changed(TYPED, None)[0] == plain | {"status": None} and changed(TYPED, "x")[1] == plain
    assert changed('{"source_time": 5}', "x", "2024-01-02")[1] == {"source_time": 5}
    for odd in (None, "", "bad", "[1]", "null", "{}"):
        assert changed(odd, "x") == ({"status": "x"}, {})
    assert changed('{"a": 1, "a": [2], "": 0}', "x")[1] == {"a": [2], "": 0}
    own = F.lit('{"n": false, "id": 9}')
    e, o = spark.range(1).select(history.entity_properties(F.lit(TYPED), own), history.observation_properties(F.lit(TYPED), own)).first()
    assert json.loads(e) == plain | {"n": False, "id": 9} and json.loads(o) == {"id": 9} | plain


def test_replay_shuffles_once_and_sends_no_point_through_python(spark):
    rng = random.Random(2)
    rows = [row(k, str(i), rng.choice("xy")) for k in range(1, 5) for i in range(20)] + [row(2, "3", "z"), row(1, "9", geometry=POLLY)]
    s, p = frames(spark, rows, [("s", at(k), True) for k in range(1, 5)])
    log = history.replay(s, p)
    log.collect()
    plan = log._jdf.queryExecution().executedPlan().toString()
    final = plan.split("== Initial Plan ==")[0]
    assert len(re.findall(r"\n[^\n]*?(?<!Broadcast)Exchange hashpartitioning", final)) == 1 and "SortMergeJoin" not in final
    # the branch with the Python function holds only rows with a shape
    python = re.search(r"ArrowEvalPython.*", final, re.S).group()
    assert final.count("ArrowEvalPython [") == 1 and "isnotnull(geometry" in python


def test_stored_history_is_pruned_by_source_day_and_place(spark, tmp_path):
    places = [(35.0 + i % 10, -85.0 + i // 10) for i in range(100)]
    log = spark.createDataFrame([(f"s{i % 3}", at(1440 * d + i), str(i), "c", "x", *places[i]) for i in range(100) for d in range(10)] + [("s1", at(1440 * 4 + i % 1000), str(i), "c", "hot", *places[i % 100]) for i in range(5000)], "source_key string, observed_at timestamp, external_id string, category string, status string, lat double, lon double")
    path = str(tmp_path / "h")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so that small ranges stay apart
    history.append_observations(log, path, "1")
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    hot = list((tmp_path / "h" / "source_key=s1" / "observed_date=2024-01-05").rglob("*.parquet"))
    assert len(hot) > 1, "a hot source-day is cut into files"
    stored = history.stored_observations(spark, path)
    found = history.observations(stored, source="s1", start=F.lit(at(1440 * 3)), end=F.lit(at(1440 * 5 - 1)), bbox=(-85, 35, -84, 37), limit=50000)
    want = history.observations(log, source="s1", start=F.lit(at(1440 * 3)), end=F.lit(at(1440 * 5 - 1)), bbox=(-85, 35, -84, 37), limit=50000)
    got = found.select(*want.columns).collect()
    assert got == want.collect() and len(got) > 100
    spark.conf.set("spark.sql.maxMetadataStringLength", "10000")
    plan = found._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert re.search(r"PartitionFilters: \[[^\]]*observed_date[^\]]*", plan) and "GreaterThanOrEqual(lat" in plan
    all_files, read = len(stored.inputFiles()), len([f for f in stored.inputFiles() if "source_key=s1/" in f and ("2024-01-04" in f or "2024-01-05" in f)])
    assert 0 < read < all_files / 4
    found.collect()
    metrics = found._jdf.queryExecution().executedPlan().collectLeaves()
    files = [metrics.apply(k).metrics().get("numFiles").get().value() for k in range(metrics.size()) if metrics.apply(k).metrics().contains("numFiles")]
    assert files == [read]
    # files of a hot day hold stretches of the globe, told by their statistics
    cells = [(f.lat_min, f.lat_max) for f in spark.read.parquet(*map(str, hot)).groupBy(F.input_file_name()).agg(F.min("cell").alias("lat_min"), F.max("cell").alias("lat_max")).collect()]
    cells.sort()
    assert all(a[1] <= b[0] for a, b in zip(cells, cells[1:], strict=False))


def test_tracks_come_in_segments(spark):
    log = spark.createDataFrame([("s", "1", at(k % 100), "x", None, 1.0 * k, 2.0) for k in range(257)] + [("s", "2", at(1), None, POLLY, 1.0, 2.0)], "source_key string, external_id string, observed_at timestamp, status string, geometry string, lon double, lat double")
    rows = sorted(history.tracks(log, steps=50).collect(), key=lambda r: (r.external_id, r.segment))
    assert [(r.external_id, r.segment, len(r.track)) for r in rows] == [("1", k, min(50, 257 - 50 * k)) for k in range(6)] + [("2", 0, 1)]
    whole = history.tracks(log).filter("external_id = '1'").first().track
    assert [x for r in rows if r.external_id == "1" for x in r.track] == whole


def test_days_do_not_depend_on_the_time_zone(spark):
    df = spark.sql("SELECT timestamp'1969-12-31 23:00:00' AS a, timestamp'2024-01-05 23:30:00' AS b")
    for zone in ("UTC", "America/New_York"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        days = df.select(history.utc_day(F.timestamp_seconds(F.lit(-3600))).cast("string"), history.utc_day(F.timestamp_seconds(F.lit(1704497400))).cast("string")).first()
        assert tuple(days) == ("1969-12-31", "2024-01-05")
    spark.conf.set("spark.sql.session.timeZone", "UTC")
