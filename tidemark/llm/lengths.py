"""Token counts: an exact histogram of encoded lengths; suffix sums answer totals, quantiles and truncated totals for every context limit."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize
from .tokens import cached_encoder

_BLOCK = 1024


def length_histogram(docs: DataFrame, tokenizer: str, text_col: str = "text") -> DataFrame:
    """(length, docs): how many texts have each encoded length. Null and empty texts have length 0; repeated rows count each. Counted in the task before the shuffle."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, counts = cached_encoder(tokenizer), Counter()
        for b in batches:
            for text in b.column(0):
                counts[len(encode(text.as_py() or "")) // 4] += 1
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.int64()), pa.array(list(counts.values()), pa.int64())], ["length", "docs"])

    return docs.select(text_col).mapInArrow(work, "length long, docs long").groupBy("length").agg(F.sum("docs").alias("docs"))


def context_limits(histogram: DataFrame) -> DataFrame:
    """One row for each length that occurs, taken as context limit: context_limit, docs, docs_longer, tokens_longer, docs_total, tokens_total, truncated_total, quantile.

    docs have just this length; docs_longer and tokens_longer are sums over all greater lengths; truncated_total is
    the tokens left when each document is cut at the limit; quantile is the share of documents that fit. Between two
    lengths docs_longer and tokens_longer stay as at the lower one, so truncated_total(L) = tokens_total -
    tokens_longer + L * docs_longer answers any limit. No histogram rows, no rows.

    Suffix sums go by blocks of 1024 lengths: inside each block in parallel, and over the blocks' sums, of which there
    are as many as the longest document has thousands of tokens.
    """
    h = materialize(histogram.select("length", "docs", (F.col("length") / _BLOCK).cast("long").alias("block")), "lengths")
    blocks = h.groupBy("block").agg(F.sum("docs").alias("d"), F.sum(F.col("docs") * F.col("length")).alias("t"))
    after = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    total = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    blocks = blocks.select("block", F.coalesce(F.sum("d").over(after), F.lit(0)).alias("d_after"), F.coalesce(F.sum("t").over(after), F.lit(0)).alias("t_after"), F.sum("d").over(total).alias("docs_total"), F.sum("t").over(total).alias("tokens_total"))
    inside = Window.partitionBy("block").orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, -1)
    longer = F.coalesce(F.sum("docs").over(inside), F.lit(0)) + F.col("d_after")
    tokens = F.coalesce(F.sum(F.col("docs") * F.col("length")).over(inside), F.lit(0)) + F.col("t_after")
    found = h.join(blocks, "block").select(F.col("length").alias("context_limit"), "docs", longer.alias("docs_longer"), tokens.alias("tokens_longer"), "docs_total", "tokens_total")
    return found.select(
        "*", (F.col("tokens_total") - F.col("tokens_longer") + F.col("context_limit") * F.col("docs_longer")).alias("truncated_total"), (1 - F.col("docs_longer") / F.col("docs_total")).alias("quantile")
    )
