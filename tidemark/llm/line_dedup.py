"""Line dedup: explode normalised lines, hash them, count the documents of each hash, drop lines over the threshold, reassemble by position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What is stripped from both ends of a line: blank and U+0009 to U+000D.
_SPACE = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    """The line stripped of white space at both ends, A-Z lower-cased."""
    bare = F.btrim(line, F.lit(_SPACE))
    # lower() is the fast way and exact for ASCII; elsewhere it would also fold letters beyond A-Z
    return F.when(F.length(bare) == F.octet_length(bare), F.lower(bare)).otherwise(F.translate(bare, _UPPER, _LOWER))


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3, prefix: str = "") -> DataFrame:
    """docs with `kept_text` (text without repeated lines), `n_lines` and `n_dropped` added, their names after `prefix`; columns of those names are replaced.

    A line goes if its key has at least min_chars code points, stands in at least min_docs distinct ids, and the row's
    id is not the largest one holding it. Null or empty text is one empty line. Rows with one id count as one
    document: all of them keep what the largest id keeps. A row with a null id never counts and never is the largest,
    so its repeated lines go. Other columns stay untouched, whatever their names.

    Shuffles: 24-byte line hashes (combined before the shuffle), then only the positions to drop, then the documents
    that lose lines meet their positions by (id, text hash). Hot lines are spread by (hash, id) in the distinct count;
    in the joins Spark splits them (AQE skew join).
    """
    rid, rhash = "__line_row_id", "__line_row_hash"
    base = docs.withColumns({rid: F.col(id_col), rhash: F.xxhash64(F.col(text_col))})
    lines = base.select(rid, rhash, F.posexplode(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")).alias("pos", "line"))
    keyed = lines.withColumn("key", line_key("line")).filter(F.length("key") >= min_chars)
    # 128 bits from two seeds, so that distinct lines do not meet even among 10**12
    hashed = keyed.select(rid, rhash, "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), F.col("key")).alias("h2"))
    hot = hashed.groupBy("h1", "h2").agg(F.count_distinct(rid).alias("docs"), F.max(rid).alias("keeper")).filter(F.col("docs") >= min_docs)
    # a table of its own, so that Spark can split a hot line's rows in the join
    hot = materialize(hot.select("h1", "h2", "keeper"), "hot-lines")
    drops = (
        hashed.hint("merge").join(hot, ["h1", "h2"])
        .filter(~F.col(rid).eqNullSafe(F.col("keeper")))
        .groupBy(rid, rhash)
        .agg(F.collect_set("pos").alias("__line_drop"))
    )
    drops = materialize(drops, "line-drops")
    d = drops.withColumnsRenamed({rid: "__line_d_id", rhash: "__line_d_hash"})
    # the positions grow with the corpus: always a shuffle, at any size
    joined = base.hint("merge").join(d, F.col(rid).eqNullSafe(F.col("__line_d_id")) & F.col(rhash).eqNullSafe(F.col("__line_d_hash")), "left")
    parts = F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")
    drop = F.col("__line_drop")
    # array_except on integers uses a hash set: linear even for very long documents
    kept = F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), drop), lambda i: F.get(parts, i)), "\n")
    return joined.select(
        *[F.col(f"`{c}`") for c in docs.columns if c not in (f"{prefix}kept_text", f"{prefix}n_lines", f"{prefix}n_dropped")],
        F.when(drop.isNull(), F.coalesce(F.col(text_col), F.lit(""))).otherwise(kept).alias(f"{prefix}kept_text"),
        F.size(parts).cast("long").alias(f"{prefix}n_lines"),
        F.coalesce(F.size(F.when(drop.isNotNull(), drop)), F.lit(0)).cast("long").alias(f"{prefix}n_dropped"),
    )
