"""Token counts: the exact histogram of encoded lengths, and its suffix sums for every context limit.

Documents are encoded whole, one after the other inside tasks; only (length, number of documents) leaves them, already
added up.  The histogram has one row per length that occurs.  Sums over all longer lengths answer, for a limit that is a
row: how many documents and tokens exceed it, and how many tokens remain when every document is cut to it.  ``at_limits``
does so for any limits, by the sums of the first length above each, ``quantiles`` for any shares.  ``answered`` puts the
answers beside the lengths they were read from.

Sums run in stripes of ``STRIPE`` lengths with the stripes' totals added, so no task sees the whole histogram.

A null or empty text has length 0 and counts as a document.  Runs of white space may have any length (:func:`encoded`).  Other
columns are not read; grouping columns keep null as a group.  The vocabulary file is read once on the driver and shipped to
the tasks.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusrules.llm.storage import written

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how this vocabulary cuts text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: White space as the pattern means it, in runs that its engine could not hold on its stack (it ends at a million).
BLANKS = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{100000,}")
STRIPE = 4096
#: Context limits and shares that ``answered`` gives unless asked for others.
CONTEXTS = tuple(1 << k for k in range(7, 18))
SHARES = (0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99, 1.0)


def vocabulary(spark: SparkSession, path: str = VOCABULARY):
    """The vocabulary file's bytes as a broadcast (below a megabyte)."""
    with open(path, "rb") as file:
        return spark.sparkContext.broadcast(file.read())


@lru_cache(maxsize=1)
def encoding(ranks: bytes) -> tiktoken.Encoding:
    """The tokenizer of a file of ranks; texts hold no special tokens."""
    table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, ranks.splitlines()) if token}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})


def encoded(encoder: tiktoken.Encoding, text: str, blanks: re.Pattern = BLANKS) -> list[int]:
    """The ids of a text.

    Where the pattern meets a run of white space, it takes all of it at the end of the text, else all but the last character, which it
    leaves to what follows.  Long runs are cut out just so, and merged as the one piece that they are; ids are the same.
    """
    ids, first = [], 0
    for run in blanks.finditer(text):
        last = run.end() if run.end() == len(text) else run.end() - 1
        if run.start() > first:
            ids += encoder.encode_ordinary(text[first : run.start()])
        ids += encoder._encode_single_piece(text[run.start() : last])
        first = last
    return ids + encoder.encode_ordinary(text[first:]) if first else encoder.encode_ordinary(text)


def token_length(spark: SparkSession, text: Column, path: str = VOCABULARY) -> Column:
    """The encoded length of each text."""
    shared = vocabulary(spark, path)

    @F.arrow_udf(T.LongType())
    def length(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = encoding(shared.value)
        for texts in batches:
            yield pa.array(np.fromiter((len(encoded(encoder, t.as_py())) if t.is_valid else 0 for t in texts), np.int64, len(texts)))

    return length(text.cast("string"))


def length_histogram(docs: DataFrame, *, text_col: str = "text", by: Sequence[str] = (), path: str = VOCABULARY) -> DataFrame:
    """``by`` columns, ``length`` and ``n_docs``: every length that occurs."""
    return docs.select(*by, token_length(docs.sparkSession, F.col(text_col), path).alias("length")).groupBy(*by, "length").agg(F.count("*").alias("n_docs"))


def with_suffix_sums(histogram: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Adds, for each length: documents and tokens at least that long, tokens left when all are cut to it, and the share up to it."""
    striped = histogram.withColumn("stripe", F.floor(F.col("length") / STRIPE))
    weight = F.col("n_docs") * F.col("length")
    totals = striped.groupBy(*by, "stripe").agg(F.sum("n_docs").alias("docs"), F.sum(weight).alias("tokens"))
    after = Window.partitionBy(*by).orderBy("stripe").rowsBetween(1, Window.unboundedFollowing)
    whole = Window.partitionBy(*by)
    totals = totals.select(
        *[F.col(c).alias(f"t_{c}") for c in by],
        F.col("stripe").alias("t_stripe"),
        F.coalesce(F.sum("docs").over(after), F.lit(0)).alias("docs_after"),
        F.coalesce(F.sum("tokens").over(after), F.lit(0)).alias("tokens_after"),
        F.sum("docs").over(whole).alias("all_docs"),
        F.sum("tokens").over(whole).alias("all_tokens"),
    )
    same = F.col("stripe") == F.col("t_stripe")
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"t_{c}"))
    inside = Window.partitionBy(*by, "stripe").orderBy("length").rowsBetween(0, Window.unboundedFollowing)
    summed = striped.withColumn("d", F.sum("n_docs").over(inside)).withColumn("t", F.sum(weight).over(inside)).join(totals, same)
    docs, tokens = F.col("d") + F.col("docs_after"), F.col("t") + F.col("tokens_after")
    return summed.select(
        *by,
        "length",
        "n_docs",
        docs.alias("docs_at_least"),
        tokens.alias("tokens_at_least"),
        (F.col("all_tokens") - tokens + docs * F.col("length")).alias("tokens_cut"),
        ((F.col("all_docs") - docs + F.col("n_docs")) / F.col("all_docs")).alias("share_up_to"),
    )


def at_limits(sums: DataFrame, limits: Sequence[int], by: Sequence[str] = ()) -> DataFrame:
    """For each context limit (and group): documents that fit, tokens in all, tokens kept when cut to it, tokens lost.

    ``length`` is the greatest that fits, null if none does.
    """
    row = F.struct("length", "docs_at_least", "tokens_at_least")
    # The sums of the first length above a limit are those of all that exceed it; those of the least length, of all.
    looked = {int(x): (F.max(F.when(F.col("length") <= int(x), F.col("length"))), F.min(F.when(F.col("length") > int(x), row))) for x in limits}
    found = sums.groupBy(*by).agg(F.min(row).alias("whole"), F.array(*(F.struct(F.lit(x).cast("long").alias("context"), fits.alias("length"), above.alias("above")) for x, (fits, above) in looked.items())).alias("looked"))
    rows = found.where("whole is not null").select(*by, "whole", F.explode("looked").alias("at")).select(*by, "whole", "at.*")
    docs, tokens = (F.coalesce(F.col(f"above.{c}"), F.lit(0)) for c in ("docs_at_least", "tokens_at_least"))
    lost = tokens - docs * F.col("context")
    return rows.select(*by, "context", (F.col("whole.docs_at_least") - docs).alias("docs_within"), F.col("whole.tokens_at_least").alias("tokens"), (F.col("whole.tokens_at_least") - lost).alias("tokens_kept"), lost.alias("tokens_lost"), "length")


def quantiles(sums: DataFrame, shares: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """For each share (and group): the shortest length that this share of all documents does not exceed."""
    looked = [F.struct(F.lit(x).alias("share"), F.min(F.when(F.col("share_up_to") >= x, F.col("length"))).alias("length")) for x in dict.fromkeys(map(float, shares))]
    found = sums.groupBy(*by).agg(F.explode(F.array(*looked)).alias("at"))
    return found.select(*by, "at.*").where("length is not null")


def answered(sums: DataFrame, *, limits: Sequence[int] = CONTEXTS, shares: Sequence[float] = SHARES, by: Sequence[str] = ()) -> DataFrame:
    """``sums`` with two arrays: ``contexts``, the answers for limits from this length up to the next one (those below every
    length are at the least), and ``quantiles``, the shares that this length is the quantile of.  Each answer is there once."""
    least = sums.groupBy(*by).agg(F.min("length").alias("least"))
    answer = F.struct("context", "docs_within", "tokens", "tokens_kept", "tokens_lost")

    def beside(rows: DataFrame, other: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
        """A join in which null groups meet."""
        named = other.select(*[F.col(c).alias(f"o_{c}") for c in keys], *[c for c in other.columns if c not in keys])
        same = F.lit(True)
        for c in keys:
            same &= F.col(c).eqNullSafe(F.col(f"o_{c}"))
        return rows.join(named if keys else F.broadcast(named), same, how).drop(*[f"o_{c}" for c in keys])

    met = beside(at_limits(sums, limits, by), least, by, "inner").withColumn("length", F.coalesce("length", "least"))
    contexts = met.groupBy(*by, "length").agg(F.sort_array(F.collect_list(answer)).alias("contexts"))
    shared = quantiles(sums, shares, by).groupBy(*by, "length").agg(F.sort_array(F.collect_list("share")).alias("quantiles"))
    return beside(beside(sums, contexts, [*by, "length"], "left"), shared, [*by, "length"], "left")


def token_counts(docs: DataFrame, *, text_col: str = "text", by: Sequence[str] = (), path: str = VOCABULARY) -> DataFrame:
    """The histogram with its suffix sums, one row per length (and group); the histogram is written, so texts are encoded once."""
    return with_suffix_sums(written(length_histogram(docs, text_col=text_col, by=by, path=path), "lengths"), by)
