"""Change tracking over streams of landed snapshots."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from tidemark.operators.history import KEY, change_messages, merged_state, reconcile, with_fingerprint
from tidemark.operators.keyed import KeyedTable
from tidemark.tables import discard, materialize

_STATE = "status string, fingerprint string, poll_at timestamp"
_OUT = "source_key string, external_id string, observed_at timestamp, change string, status string, fingerprint string"


def entity_changes(snapshots: DataFrame) -> DataFrame:
    """A stream of snapshot rows to new and updated rows of each entity: state holds the last status, fingerprint and poll. What is absent is told by closures() when a poll is complete."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values("poll_at")
        known = state.get if state.exists else None
        out = []
        for r in rows.to_dict("records"):
            status, fp = r["status"] or "", r["fingerprint"] or ""
            if known is not None and r["poll_at"] <= known[2]:
                continue  # a late or repeated poll
            if known is None or (known[0] or "") != status or (known[1] or "") != fp:
                out.append({"source_key": key[0], "external_id": key[1], "observed_at": r["poll_at"], "change": "new" if known is None else "updated", "status": r["status"], "fingerprint": r["fingerprint"]})
            known = (r["status"], r["fingerprint"], r["poll_at"])
        if known is not None:
            state.update(known)
        if out:
            yield pd.DataFrame(out)

    rows = with_fingerprint(snapshots).select(*KEY, "poll_at", "status", "fingerprint")
    return rows.groupBy(*KEY).applyInPandasWithState(step, _OUT, _STATE, "append", GroupStateTimeout.NoTimeout)


class _PollProcessor(StatefulProcessor):
    """One shard of a source: `known` holds the last status and fingerprint of its entities, the open ones and those closed lately."""

    def __init__(self, remember: dt.timedelta):
        self.remember = remember

    def init(self, handle) -> None:
        self.known = handle.getMapState("known", "external_id string", "status string, fingerprint string, open boolean, seen timestamp")
        self.last = handle.getValueState("last", "poll_at timestamp")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows))
        last = self.last.get()[0] if self.last.exists() else None
        before = {k[0]: (v[0], v[1], v[2], v[3]) for k, v in self.known.iterator()}
        known, out = dict(before), []

        def tell(entity, at, change, status, fingerprint) -> None:
            out.append({"source_key": key[0], "external_id": entity, "observed_at": at, "change": change, "status": status, "fingerprint": fingerprint})

        for at, poll in sorted(new.groupby("poll_at"), key=lambda p: p[0]):
            at = at.to_pydatetime()
            marks = poll[poll["mark"]]
            if (last is not None and at <= last) or (len(marks) and not marks["ok"].any()):
                continue  # a late, repeated or failed poll
            last, present = at, set()
            for status, fingerprint, entity in sorted((r.status or "", r.fingerprint or "", r.external_id) for r in poll[~poll["mark"]].itertuples()):
                # of rows of one id the greatest status counts: it comes last
                present.add(entity)
                known[entity, at] = (status, fingerprint)
            for entity in present:
                status, fingerprint = known.pop((entity, at))
                old = known.get(entity)
                if old is None or not old[2] or (old[0] or "", old[1] or "") != (status, fingerprint):
                    tell(entity, at, "new" if old is None else "updated", status or None, fingerprint or None)
                known[entity] = (status or None, fingerprint or None, True, at)
            if len(marks):  # the poll is whole: what it lacks is gone
                for entity, (status, fingerprint, is_open, seen) in list(known.items()):
                    if is_open and entity not in present:
                        known[entity] = (status, fingerprint, False, at)
                        tell(entity, at, "closed", "Closed", fingerprint)
                    elif not is_open and at - seen > self.remember:
                        del known[entity]
        for entity in before.keys() - known.keys():
            self.known.removeKey((entity,))
        for entity, value in known.items():
            if before.get(entity) != value:
                self.known.updateValue((entity,), value)
        if last is not None:
            self.last.update((last,))
        if out:
            yield pd.DataFrame(out)

    def close(self) -> None:
        pass


def poll_changes(snapshots: DataFrame, polls: DataFrame, shards: int = 16, remember: dt.timedelta = dt.timedelta(days=30)) -> DataFrame:
    """Streams of snapshot rows and of polls (source_key, poll_at, ok) to new, updated and closed rows of entities, in one query: what a successful poll lacks is closed.

    Each source goes in `shards` parts by entity, so that a source with a third of all rows is many tasks' work; a poll's mark goes
    to all of them. A poll's rows and its mark come in one batch; rows without a mark open and change entities but close
    none. Polls that come late, again or failed change nothing. State holds what is open, and what was closed for
    `remember`: an entity that comes back later is new. Needs the state store provider that keeps state on disk
    (RocksDB).
    """
    rows = with_fingerprint(snapshots).select(*KEY, "poll_at", "status", "fingerprint", F.pmod(F.xxhash64("external_id"), F.lit(shards)).cast("int").alias("shard"), F.lit(False).alias("mark"), F.lit(True).alias("ok"))
    none = F.lit(None).cast("string")
    marks = polls.select("source_key", none.alias("external_id"), "poll_at", none.alias("status"), none.alias("fingerprint"), F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(True).alias("mark"), F.coalesce("ok", F.lit(False)).alias("ok"))
    return rows.unionByName(marks).groupBy("source_key", "shard").transformWithStateInPandas(_PollProcessor(remember), _OUT, "append", "none")


class VersionedTable:
    """A table whose versions are folders: a reader sees the last one that was written whole, and writing a version again replaces it."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def versions(self) -> list[int]:
        """The versions written whole, in order."""
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        root = hadoop.Path(self.path)
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(root):
            return []
        names = [f.getPath() for f in fs.listStatus(root)]
        return sorted(int(p.getName().removeprefix("version=")) for p in names if fs.exists(hadoop.Path(p, "_SUCCESS")))

    def read(self) -> DataFrame | None:
        found = self.versions()
        return self.spark.read.parquet(f"{self.path}/version={found[-1]}") if found else None

    def all(self) -> DataFrame:
        """Every version's rows with `version`."""
        return self.spark.read.option("basePath", self.path).parquet(*[f"{self.path}/version={v}" for v in self.versions()])

    def save(self, rows: DataFrame, version: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/version={version}")


#: Polls that one batch may bring, as versions are numbered by batch and poll.
_POLLS = 1 << 20


def poll_batches(state: VersionedTable, outbox: VersionedTable, polls: Callable[[DataFrame], DataFrame], empty: DataFrame) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: each poll of a batch is reconciled with the stored state in order of time; its changes go to the outbox as messages (none where nothing changed), then the new state is saved under the same version. Absence from a complete poll closes, never a timeout.

    `empty` is a state without rows, to begin with. A batch that comes again after a failure writes the polls that are
    not saved once more, under the same versions, so no message is lost or doubled.
    """

    def run(batch: DataFrame, number: int) -> None:
        done = max(state.versions(), default=-1)
        times = [r.poll_at for r in batch.select("poll_at").distinct().orderBy("poll_at").toLocalIterator()]
        for k, at in enumerate(times):
            version = number * _POLLS + k
            if version <= done:
                continue
            part = batch.filter(F.col("poll_at") == F.lit(at))
            before = state.read()
            before = empty if before is None else before
            changes = materialize(reconcile(before, part, polls(part)), "changes")
            messages = materialize(change_messages(changes.withColumn("observed_at", F.lit(at))), "messages")
            if not messages.isEmpty():
                outbox.save(messages, version)
            state.save(merged_state(before, changes), version)
            discard(changes, messages)

    return run


def article_batches(stored: KeyedTable, outbox: VersionedTable, now: Callable[[], Column]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function for articles: upsert by (source_id, guid), recluster the window, save what changed, and signal each cycle with the number of stories.

    Of the stored articles only the buckets of new ones, and of those whose category or cluster is another, are
    written. The first batch begins with no articles. A batch that comes again writes its version again.
    """
    from tidemark.operators.stories import recluster, upsert_articles

    key = ["source_id", "guid"]

    def run(batch: DataFrame, number: int) -> None:
        if number in stored.versions():
            return
        if "cluster_id" not in batch.columns:
            batch = batch.withColumn("cluster_id", F.lit(None).cast("long"))
        before = stored.read()
        before = batch.limit(0) if before is None else before
        rows = materialize(upsert_articles(before, batch, ["url"]), "articles")
        clusters = materialize(recluster(rows, now()).select("id", F.col("cluster_id").alias("__c")), "clusters")
        out = rows.join(clusters, "id", "left").withColumn("cluster_id", F.coalesce("__c", "cluster_id")).select(*rows.columns)
        outbox.save(clusters.agg(F.count_distinct("__c").alias("stories")).withColumn("cycle", F.lit(number)), number)
        old = before.select(*[F.col(c).alias(f"__{c}") for c in (*key, "category", "cluster_id")])
        same = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in (*key, "category", "cluster_id")]
        changed = materialize(out.join(old, [*same], "left_anti"), "changed-articles")
        stored.upsert(changed, ["category", "cluster_id"], number)
        discard(rows, clusters, changed)

    return run


def signals(summary: DataFrame) -> DataFrame:
    """The rows of a refresh summary that tell of a change; none, no signal."""
    return summary.filter("changed")
