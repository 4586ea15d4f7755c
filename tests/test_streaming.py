import datetime as dt
import random
import shutil

from pyspark.sql import functions as F

from tests.test_history import SNAP, at, row
from tidemark.operators import history
from tidemark.operators.keyed import KeyedTable
from tidemark.streaming.changes import VersionedTable, article_batches, entity_changes, poll_batches, poll_changes, signals


def write_polls(spark, path, polls):
    for k, rows in enumerate(polls):
        spark.createDataFrame(rows, SNAP).coalesce(1).write.mode("append").parquet(str(path / f"{k}"))


def test_entity_changes(spark, tmp_path):
    write_polls(spark, tmp_path / "in", [[row(1, "1"), row(1, "2")], [row(2, "1", "x"), row(2, "2")], [row(3, "1", "x")]])
    stream = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in/0")).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    q = entity_changes(stream).writeStream.format("memory").queryName("changes").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted((r.external_id, r.change, r.status) for r in spark.table("changes").collect())
    assert got == [("1", "new", "Queued"), ("1", "updated", "x"), ("2", "new", "Queued")]


def test_poll_batches(spark, tmp_path):
    """Folding polls in batches gives what the replay of all of them gives; a batch that comes again changes nothing, also after a failure between message and state."""
    rows = [row(1, "1"), row(1, "2"), row(2, "1", "x"), row(3, "1", "x"), row(3, "2")]
    s = spark.createDataFrame(rows, SNAP)
    p = s.select("source_key", "poll_at").distinct().withColumn("ok", F.lit(True))
    state, outbox = VersionedTable(spark, str(tmp_path / "state")), VersionedTable(spark, str(tmp_path / "outbox"))
    run = poll_batches(state, outbox, lambda b: b.select("source_key", "poll_at").distinct().withColumn("ok", F.lit(True)), history.final_state(s.limit(0), p))
    write_polls(spark, tmp_path / "in", [[r for r in rows if r[1] == at(k)] for k in (1, 2, 3)])
    stream = spark.readStream.schema(s.schema).parquet(str(tmp_path / "in/*"))
    stream.writeStream.foreachBatch(run).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(120)
    want = [(at(1), ["1", "2"], [], []), (at(2), [], ["1"], ["2"]), (at(3), [], ["2"], [])]
    told = lambda: [(m.observed_at, list(m.new), list(m.updated), list(m.closed)) for m in outbox.all().orderBy("version").collect()]
    assert told() == want
    assert {r.external_id: r.is_active for r in state.read().collect()} == {"1": True, "2": True}
    shutil.rmtree(tmp_path / "state" / f"version={state.versions()[-1]}")
    run(s, 0)
    assert told() == want and {r.external_id: r.is_active for r in state.read().collect()} == {"1": True, "2": True}
    run(s.filter(F.col("poll_at") == F.lit(at(3))), 9)
    assert told() == want  # nothing changed, no message


def test_article_batches(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    schema = "id long, source_id int, guid string, url string, title string, summary string, category string, published timestamp, fetched_at timestamp, image_url string, cluster_id long"
    art = lambda i, title: (i, i, f"g{i}", f"u{i}", title, "", "news", t, t, None, None)
    table = lambda name: KeyedTable(spark, str(tmp_path / name), ["source_id", "guid"])
    stored, outbox = table("articles"), VersionedTable(spark, str(tmp_path / "signals"))
    stored.upsert(spark.createDataFrame([art(1, "Warehouse blaze on Amnicola Highway")] + [art(50 + k, f"filler{k} words{k}") for k in range(8)], schema), [], -1)
    run = article_batches(stored, outbox, lambda: F.lit(dt.datetime(2024, 1, 2)))
    batch = spark.createDataFrame([art(2, "Crews battle warehouse blaze on Amnicola Highway")], schema)
    for _ in range(2):
        run(batch, 3)
    got = {r.id: r.cluster_id for r in stored.read().collect()}
    (s,) = outbox.all().collect()
    assert got[1] == got[2] == 1 and len(got) == 10 and s.stories == 9 and s.cycle == 3
    first, told = table("none"), VersionedTable(spark, str(tmp_path / "told"))
    article_batches(first, told, lambda: F.lit(dt.datetime(2024, 1, 2)))(stored.read().drop("cluster_id"), 0)  # from an empty store
    again = {r.id: r.cluster_id for r in first.read().collect()}
    assert again == got and told.all().first().stories == 9
    s = spark.createDataFrame([(1, True), (2, False)], "created int, changed boolean")
    assert [r.created for r in signals(s).collect()] == [1]


def test_keyed_table_rewrites_only_touched_buckets(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), ["k", "s"], buckets=16)
    assert table.read() is None
    rows = lambda ids, v: spark.createDataFrame([(i, None if i % 5 == 0 else f"s{i}", v) for i in ids], "k long, s string, v string")
    table.upsert(rows(range(2000), "old").withColumn("w", F.lit("kept")), ["v"], 0)
    files = lambda: {p: p.stat().st_mtime_ns for p in (tmp_path / "t").rglob("part-*.parquet")}
    before = files()
    batch = rows([5, 5, 7, 3000], "new").withColumn("w", F.lit("lost"))
    touched = {r.bucket for r in table.placed(batch).select("bucket").distinct().collect()}
    for _ in range(2):
        table.upsert(batch, ["v"], 1)
    after = files()
    assert {p: t for p, t in after.items() if p in before} == before and len(touched) <= 3
    assert {p.parts[-3] for p in after.keys() - before.keys()} == {f"bucket={b}" for b in touched}
    got = {(r.k, r.s): (r.v, r.w) for r in table.read().collect()}
    assert len(got) == table.read().count() == 2001
    assert got[5, None] == got[7, "s7"] == ("new", "kept") and got[3000, None] == ("new", "lost") and got[8, "s8"] == ("old", "kept")
    # a version without its mark does not count, and comes again whole
    (tmp_path / "t/_done/1").unlink()
    assert {r.v for r in table.read().collect()} == {"old"}
    table.upsert(batch, ["v"], 1)
    assert {(r.k, r.s): (r.v, r.w) for r in table.read().collect()} == got
    for v in (2, 3):
        table.upsert(batch.withColumn("v", F.lit(f"v{v}")), ["v"], v)
    assert table.folders()[min(touched)] == [2, 3] and table.read().filter("k = 5").first().v == "v3"
    assert table.read().filter("k = 9").first().v == "old"


def test_poll_changes_and_restart(spark, tmp_path):
    """One streaming query, stopped and started again between polls, tells what the replay tells; what was closed long ago is forgotten."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rng = random.Random(8)
    rows = {k: [row(k, str(i), rng.choice("xy"), source) for source in ("a", "b") for i in range(12) if rng.random() < 0.6] for k in range(1, 7)}
    rows[3].append(row(3, "3", "z", "a"))
    rows[4] = [r for r in rows[4] if r[0] == "a"]  # an empty poll of b
    polls = {k: [("a", at(k), True), ("b", at(k), k != 5)] for k in rows}
    all_rows, all_polls = spark.createDataFrame(sum(rows.values(), []), SNAP), spark.createDataFrame(sum(polls.values(), []), "source_key string, poll_at timestamp, ok boolean")

    def land(k):
        spark.createDataFrame(rows[k] or rows[1][:0], SNAP).coalesce(1).write.mode("append").parquet(str(tmp_path / "rows"))
        spark.createDataFrame(polls[k], all_polls.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "polls"))

    def run(name):
        stream = lambda df, folder: spark.readStream.schema(df.schema).parquet(str(tmp_path / folder))
        q = poll_changes(stream(all_rows, "rows"), stream(all_polls, "polls"), shards=3, remember=dt.timedelta(minutes=2)).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination(180)

    for step in ((1, 2), (3,), (4, 5, 6)):
        for k in step:
            land(k)
        run(step)
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = sorted((r.source_key, r.external_id, r.observed_at, r.change, r.status) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    replayed = [(r.source_key, r.external_id, r.observed_at, r.change, r.status) for r in history.replay(all_rows, all_polls).collect()]
    closed = {(s, i, t) for s, i, t, c, _ in replayed if c == "closed"}
    # two minutes after it was closed an entity is forgotten, so that it comes back as new
    back = lambda s, i, t: max((u for x, j, u in closed if (x, j) == (s, i) and u < t), default=None)
    want = sorted((s, i, t, "new" if c == "updated" and back(s, i, t) and forgotten(polls, s, back(s, i, t), t) else c, st) for s, i, t, c, st in replayed)
    assert got == want and any(c == "closed" for *_, c, _ in got)


def forgotten(polls, source, closed, back):
    """Whether a successful poll between the closure and the return was more than two minutes after the closure, and the entity stayed closed until then."""
    return any(closed + dt.timedelta(minutes=2) < t < back for k in polls for s, t, ok in polls[k] if s == source and ok)
