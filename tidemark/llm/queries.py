"""The registered queries of the training-text operators and the SQL they are held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, decontaminate, language, lengths, licenses, line_dedup, media, packing, passages, set_join, toxicity, warc, whitening


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's record after the way through archives, sorted runs and their merge."""
    return warc.capture_history(read(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every document before and after repeated ones went, and a digest of what stays."""
    kept = line_dedup.drop_repeated_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document inside benchmark windows, and which items they are of."""
    found = decontaminate.contamination(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark"))
    names = F.array_sort(F.array_distinct("item_ids"))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size(names).cast("long").alias("n_items"), F.sha2(F.array_join(names, ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document by text and source."""
    return language.identify_documents(read(spark, sf_dir, "documents")).drop("row_hash")


def page_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same operator on `pages`, where addresses and declarations are evidence too."""
    model = language.train(read(spark, sf_dir, "documents"))
    return language.identify_pages(read(spark, sf_dir, "pages"), model)


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every token length as context limit, what the histogram of all documents answers."""
    histogram = lengths.length_histogram(read(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))
    return lengths.context_limits(histogram)


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text through a stored FLAC stream and back: digests of the samples read back and of the stream."""
    back = media.from_media(media.stored(media.to_media(read(spark, sf_dir, "documents"))))
    return back.select(
        "doc_id", "n_bytes", F.octet_length("pcm").cast("long").alias("payload_bytes"), F.sha2("pcm", 256).alias("payload_sha256"), F.crc32(F.expr("substring(pcm, -64)")).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "feature", F.size("blocks").alias("blocks"),
    )


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all documents, each a sequence of a power of two."""
    packed = packing.pack_power_of_two(read(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_path("word_bpe_49k.json"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket")


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known licence sentences of every document and the licences whose rules they match."""
    found = licenses.scan_licenses(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_sentences", F.array_join("sentence_ids", " ").alias("sentence_ids"), F.array_join("licenses", " ").alias("licenses"), F.size("matches").alias("n_matches"), F.array_join("unmatched", " ").alias("unmatched"))


def op9_set_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class, copies and links of every document by word shingles."""
    return set_join.similar_documents(read(spark, sf_dir, "documents")).drop("row_hash")


def op10_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with passages that others hold too, and what to remove of them."""
    return passages.repeated_passages(read(spark, sf_dir, "documents")).drop("row_hash")


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens, groups and links of two tokenizers over every document, and how common the linked pairs are."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return alignment.align_documents(docs, tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A toxicity score of every document; labels of rows whose crc32 of the id leaves 2 on division by 4 are not learned from."""
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    held_out = lambda c: F.crc32(F.coalesce(F.col(c).cast("string"), F.lit(""))) % 4 == 2
    model = toxicity.train(docs.select("doc_id", "text"), labels.filter(~held_out("doc_id")).select("doc_id", "toxic"))
    return toxicity.score(docs, model).select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector on the first eight components of all vectors' covariance, scaled to unit variance."""
    return whitening.whiten(read(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_warc": op1_warc,
    "op2_line_dedup": op2_line_dedup,
    "op3_decontaminate": op3_decontaminate,
    "op4_language_id": op4_language_id,
    "op5_token_counts": op5_token_counts,
    "op6_media": op6_media,
    "op7_packing": op7_packing,
    "op8_licenses": op8_licenses,
    "op9_set_join": op9_set_join,
    "op10_passages": op10_passages,
    "op11_alignment": op11_alignment,
    "op12_toxicity": op12_toxicity,
    "op13_whitening": op13_whitening,
    "page_languages": page_languages,
}

_OP1 = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
g AS (SELECT payload_digest, max(page_id) AS keeper FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT p.page_id, p.payload_bytes, p.payload_digest, CASE WHEN g.keeper IS NOT NULL AND g.keeper IS DISTINCT FROM p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN g.keeper IS DISTINCT FROM p.page_id THEN g.keeper END AS refers_to
FROM p LEFT JOIN g ON p.payload_digest = g.payload_digest AND p.payload_bytes >= 1000
"""

_OP2 = r"""
WITH lines AS (
  SELECT doc_id, i, l, translate(trim(l, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(ls) AS l, unnest(range(1, len(ls) + 1)) AS i
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))
), hot AS (
  SELECT k, max(doc_id) AS keeper FROM lines WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3
), marked AS (
  SELECT a.doc_id, a.i, a.l, (h.k IS NOT NULL AND a.doc_id IS DISTINCT FROM h.keeper) AS gone FROM lines a LEFT JOIN hot h ON a.k = h.k
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(l, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

_OP3 = r"""
WITH items AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), phrases AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(list_slice(w, s, s + least(10, len(w)) - 1), ' ') AS p
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM items WHERE len(w) > 0)
), docs AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents
), sizes AS (SELECT DISTINCT n FROM phrases
), spots AS (
  SELECT doc_id, n, s, array_to_string(list_slice(w, s, s + n - 1), ' ') AS p
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM docs, sizes WHERE len(w) >= n)
), found AS (
  SELECT s.doc_id, s.s, s.n, f.item_id FROM spots s JOIN phrases f ON s.p = f.p AND s.n = f.n
), hits AS (
  SELECT doc_id, count(DISTINCT spot) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(s, s + n)) AS spot FROM found) GROUP BY doc_id
), named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id
)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(n.n_items, 0) AS n_items, sha256(coalesce(n.names, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM docs d LEFT JOIN hits h ON d.doc_id = h.doc_id LEFT JOIN named n ON d.doc_id = n.doc_id
"""

ORACLE_SQL = {"op1_warc": _OP1, "op2_line_dedup": _OP2, "op3_decontaminate": _OP3}
