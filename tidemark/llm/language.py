"""Language ID by Bayesian evidence fusion: text likelihoods, the language a page declares, and host priors smoothed toward address suffix and corpus."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, texts

_BITS = 16
#: Letters (A-Z lower-cased, bytes of 0x80 and more) stay, all else is a blank.
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_SLICE = 1 << 20
UNKNOWN = "und"


def _coded(values: list[bytes | None]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, end, codes, starts) for runs of texts of about a million bytes: hashed byte trigrams of each text's words, and where each text begins."""
    first, parts, size = 0, [], 0
    for k, value in enumerate(values):
        parts.append(b" " + b" ".join((value or b"").translate(_LETTERS).split()) + b"  ")
        size += len(parts[-1])
        if size >= _SLICE or k == len(values) - 1:
            a = np.frombuffer(b"".join(parts), np.uint8).astype(np.uint32)
            lengths = np.array([len(p) for p in parts])
            codes = (((a[:-2] * np.uint32(0x01000193) + a[1:-1]) * np.uint32(0x01000193) + a[2:]) * np.uint32(0x9E3779B1)) >> np.uint32(32 - _BITS)
            # trigrams of two texts and of blanks alone belong to none
            owner = np.repeat(np.arange(len(parts)), lengths)
            inside = (owner[2:] == owner[:-2]) & (a[1:-1] != 32)
            yield first, k + 1, codes[inside], np.searchsorted(owner[:-2][inside], np.arange(len(parts) + 1))
            first, parts, size = k + 1, [], 0


class Model:
    """log P(trigram | language) for a list of languages."""

    def __init__(self, languages: list[str], counts: np.ndarray, alpha: float = 0.5):
        self.languages = languages
        smooth = counts + alpha
        self.table = np.log(smooth / smooth.sum(1, keepdims=True)).T.astype(np.float32).copy()


def _bounds(hashes: DataFrame, rows: int) -> dict[str, int]:
    """The largest hash of each label's share of `rows`, of distinct (lang, h): only about the shares reach the driver."""
    counts = {r.lang: r.n for r in hashes.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    left, share = rows, 1
    for k, n in enumerate(sorted(counts.values())):
        share = max(left // (len(counts) - k), 1)
        if n > share:
            break
        left -= n
    # hashes are evenly spread: a little more than the share lies under this part of their range
    most = [(lang, -(1 << 63) + min(int((1 << 64) * (share + 6 * share**0.5 + 10) / n), (1 << 64) - 1)) for lang, n in counts.items()]
    if not most:
        return {}
    near = hashes.join(F.broadcast(hashes.sparkSession.createDataFrame(most, "lang string, most long")), "lang").filter("h <= most").select("lang", "h").toPandas()
    return {lang: int(h.nsmallest(share).max()) for lang, h in near.groupby("lang")["h"]}


def train(labelled: DataFrame, text_col: str = "text", label_col: str = "lang", rows: int = 20_000) -> Model:
    """A model from at most `rows` distinct labelled texts, of each label those whose hash is smallest (all of them where there are fewer): a bounded sample, the same on every run.

    Labels share the rows evenly, and what a rare one leaves goes to the others, so every label is in the model at
    every size. Rows without text or label teach nothing, copies under one label teach once. Trigrams are counted in tasks and summed by (language, trigram); what
    reaches the driver is at most 65,536 counts for each language.
    """
    known = labelled.select(F.col(label_col).alias("lang"), F.col(text_col).alias("text")).filter("lang IS NOT NULL AND text IS NOT NULL").withColumn("h", F.xxhash64("text"))
    bounds = _bounds(materialize(known.select("lang", "h").distinct(), "labelled"), rows)
    schema = pa.schema([("lang", pa.string()), ("code", pa.int32()), ("n", pa.int64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for b in batches:
            langs = b.column(0).to_pylist()
            for first, end, codes, starts in _coded(texts(b.column(1))):
                for k in range(first, end):
                    own = codes[starts[k - first] : starts[k - first + 1]]
                    total = counts.setdefault(langs[k], np.zeros(1 << _BITS, np.int64))
                    if len(own) > 1 << 14:
                        total += np.bincount(own, minlength=1 << _BITS)
                    else:
                        np.add.at(total, own, 1)
        for lang, total in counts.items():
            code = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(code), pa.string()), pa.array(code.astype(np.int32)), pa.array(total[code])], schema=schema)

    if not bounds:
        return Model([], np.zeros((0, 1 << _BITS)))
    limits = F.broadcast(labelled.sparkSession.createDataFrame(list(bounds.items()), "lang string, bound long"))
    sample = known.join(limits, "lang").filter("h <= bound").groupBy("lang", "h").agg(F.min("text").alias("text"))
    sums = sample.select("lang", "text").mapInArrow(work, "lang string, code int, n long").groupBy("lang", "code").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(sums["lang"].unique())
    counts = np.zeros((len(languages), 1 << _BITS))
    counts[np.searchsorted(languages, sums["lang"]), sums["code"]] = sums["n"]
    return Model(languages, counts)


def _likelihoods(rows: DataFrame, model: Model) -> DataFrame:
    """rows (text first) with `grams`, `ll` (a third of the log likelihoods, as each letter stands in three trigrams) and `share` (their posterior under equal priors)."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    keep = rows.columns[1:]
    schema = ", ".join(f"{name} {kind}" for name, kind in rows.dtypes[1:]) + ", grams long, ll array<double>, share array<double>"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value.table
        for b in batches:
            grams, ll = np.zeros(b.num_rows, np.int64), np.zeros((b.num_rows, table.shape[1]))
            for first, end, codes, starts in _coded(texts(b.column(0))):
                grams[first:end] = np.diff(starts)
                full = np.flatnonzero(np.diff(starts))
                if len(full):
                    ll[first + full] = np.add.reduceat(table[codes], starts[full], axis=0, dtype=np.float64)
            ll /= 3
            share = np.exp(ll - ll.max(1, keepdims=True)) if ll.shape[1] else ll
            share /= np.maximum(share.sum(1, keepdims=True), 1e-300)
            list_of = lambda x: pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([*(b.column(k + 1) for k in range(len(keep))), pa.array(grams), list_of(ll), list_of(share)], [*keep, "grams", "ll", "share"])

    return rows.mapInArrow(work, schema)


def host_suffix(host: Column) -> Column:
    """What follows a host's last dot, '' where there is none."""
    return F.when(host.contains("."), F.substring_index(host, ".", -1)).otherwise("")


def identify(rows: DataFrame, model: Model, key: list[str], text: Column, host: Column, declared: Column | None = None, strength: float = 8.0) -> DataFrame:
    """One row per row: the key columns, lang, confidence, grams, accepted.

    Fuses for each language of the model: the text's likelihood; the declared language, as reliable as declarations
    agree with texts over all rows; and a prior of the row's host, counted from all rows (without the row itself) and
    smoothed with `strength` rows' worth of its address suffix's prior, which is smoothed likewise with the corpus's.
    "Unknown" competes as a text of evenly likely trigrams. A row is accepted if a language wins with a confidence of
    at least 0.5. A text without letters (null, empty, digits, signs) is `und` with confidence 0 and not accepted,
    whatever else it declares. A null host is a host of its own, a null or foreign declaration says nothing; repeated
    rows are judged each.

    Only numbers are shuffled: texts are read once, hosts are counted before the shuffle, hot hosts are split in the join.
    """
    n = len(model.languages)
    declared = F.lower(declared.cast("string")) if declared is not None else F.lit(None).cast("string")
    at = F.array_position(F.array(*map(F.lit, model.languages)) if n else F.array().cast("array<string>"), F.substring_index(declared, "-", 1))
    ev = _likelihoods(rows.select(text.alias("__text"), *key, F.coalesce(host, F.lit("")).alias("__host"), F.coalesce(at, F.lit(0)).cast("int").alias("__at")), model)
    ev = materialize(ev.withColumn("__suffix", host_suffix(F.col("__host"))), "evidence")
    if not n:
        return ev.select(*key, F.lit(UNKNOWN).alias("lang"), F.lit(0.0).alias("confidence"), "grams", F.lit(False).alias("accepted"))
    known = ev.filter("grams > 0")
    sums = [F.sum(F.col("share")[k]).alias(f"s{k}") for k in range(n)]
    hosts = materialize(known.groupBy("__suffix", "__host").agg(*sums), "hosts")
    suffixes = hosts.groupBy("__suffix").agg(*[F.sum(f"s{k}").alias(f"t{k}") for k in range(n)])
    top = suffixes.agg(*[F.sum(f"t{k}") for k in range(n)]).first()
    top = np.array([x or 0.0 for x in top])
    base = (top + 1) / (top.sum() + n)
    total = lambda c: sum((F.col(f"{c}{k}") for k in range(1, n)), F.col(f"{c}0"))
    priors = hosts.join(suffixes, "__suffix").select("__suffix", "__host", F.array(*[F.col(f"s{k}") for k in range(n)]).alias("__s"), F.array(*[(F.col(f"t{k}") + strength * float(base[k])) / (total("t") + strength) for k in range(n)]).alias("__p"))
    said = known.filter("__at > 0").agg(F.count(F.lit(1)), F.sum((F.expr("share[__at - 1]") >= F.array_max("share")).cast("long"))).first()
    trust = ((said[1] or 0) + 9) / (said[0] + 10)
    other = (1 - trust) / max(n - 1, 1)

    count = F.aggregate("__s", F.lit(0.0), lambda a, x: a + x) - 1
    score = F.transform(
        F.sequence(F.lit(0), F.lit(n - 1)),
        lambda k: F.get("ll", k)
        + F.log((F.greatest(F.get("__s", k) - F.get("share", k), F.lit(0.0)) + strength * F.get("__p", k)) / (F.greatest(count, F.lit(0.0)) + strength))
        + F.when(F.col("__at") == 0, 0.0).when(F.col("__at") == k + 1, float(np.log(trust))).otherwise(float(np.log(other)) if other > 0 else -700.0),
    )
    scored = ev.join(materialize(priors, "priors"), ["__suffix", "__host"], "left").withColumn("__score", score)
    best = F.array_max("__score")
    # evenly likely trigrams, and one row in a thousand
    unknown = F.col("grams") * float(-np.log(1 << _BITS) / 3) + float(np.log(1e-3))
    sure = 1 / (F.aggregate("__score", F.lit(0.0), lambda a, x: a + F.exp(x - best)) + F.exp(F.least(unknown - best, F.lit(700.0))))
    lang = F.get(F.array(*map(F.lit, model.languages)), (F.array_position("__score", best) - 1).cast("int"))
    has = F.col("grams") > 0
    scored = scored.select(*key, "grams", F.when(has & (best >= unknown), lang).otherwise(UNKNOWN).alias("lang"), F.when(has & (best >= unknown), F.round(sure, 6)).otherwise(0.0).alias("confidence"))
    return scored.select(*key, "lang", "confidence", "grams", (F.col("confidence") >= 0.5).alias("accepted"))


def identify_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", host_col: str = "source", train_rows: int = 20_000, model: Model | None = None) -> DataFrame:
    """(doc_id, row_hash, lang, confidence, grams, accepted) of documents: texts against a model of their own labelled rows, or a given one, sources as hosts. The label itself is no evidence."""
    model = train(docs, text_col, label_col, train_rows) if model is None else model
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("row_hash"), F.col(text_col).alias("text"), F.col(host_col).alias("host"))
    return identify(rows, model, ["doc_id", "row_hash"], F.col("text"), F.col("host"))


def visible_text(html: Column) -> Column:
    """Text of a page, near enough for its language: scripts, styles, comments and tags cut, entities left out."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>|&#?\w+;", " ")
    return bare


def declared_language(html: Column) -> Column:
    """The lang attribute of a page's html element, null without one."""
    return F.nullif(F.regexp_extract(html, r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?([a-z]{2,3})", 1), F.lit(""))


def identify_pages(pages: DataFrame, model: Model, id_col: str = "page_id") -> DataFrame:
    """(page_id, lang, confidence, grams, accepted) of web pages: visible text, declared language, host and address suffix."""
    rows = pages.select(F.col(id_col).alias("page_id"), F.col("html"), F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1)).alias("host"))
    return identify(rows, model, ["page_id"], visible_text(F.col("html")), F.col("host"), declared_language(F.col("html")))


def keep_identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", train_rows: int = 20_000, **options) -> DataFrame:
    """docs whose language is accepted, unchanged: decisions join back by id and text hash. Where no row has a label there is nothing to tell languages by, and all rows stay."""
    model = train(docs, text_col, label_col, train_rows)
    if not model.languages:
        return docs
    found = identify_documents(docs, id_col, text_col, model=model, **options).filter(~F.col("accepted"))
    gone = materialize(found.select(F.col("doc_id").alias("__lang_id"), F.col("row_hash").alias("__lang_hash")).distinct(), "rejected")
    return docs.hint("merge").join(gone, F.col(id_col).eqNullSafe(F.col("__lang_id")) & (F.xxhash64(F.col(text_col)) == F.col("__lang_hash")), "left_anti")
