"""Benchmark decontamination: one Aho-Corasick automaton over normalised benchmark windows, one scan of each text.

Texts are lower-cased (A-Z) and reduced to words of ASCII letters, digits and everything outside ASCII.  A window is
``window`` consecutive words of an item; a shorter item is one window, an item without words none.  Every word of a
document inside an occurrence of a window is hit, and runs of hit words are mapped back to offsets of the original text.

The automaton's size is checked: it has about a node for every byte of its windows and takes some 50 bytes of memory for each, so
``MAX_AUTOMATON_BYTES`` of windows are held at a time (100 MB a worker).  A benchmark beyond that is cut into shards of distinct windows by hash.  Documents
are then numbered and written once, each shard is a scan of its own that writes what it finds (rows of hit documents only), and findings meet their documents at
the end; no task ever holds more than one shard.

Nulls and empties: a null or empty text has no words, no hits and no items.  A null item text has no windows; an item
without id marks words but is not listed.  Repeated items count once, repeated documents keep their rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusrules.llm.storage import free_name, written
from corpusrules.llm.words import released

WINDOW = 10
MAX_AUTOMATON_BYTES = 2 << 20

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_WORD = re.compile(WORD)
_LOWER_LETTERS = str.maketrans({chr(c): chr(c + 32) for c in range(ord("A"), ord("Z") + 1)})
_BYTES = bytes(
    b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256)
)

_SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
FOUND = "struct<n_words:bigint,hit:array<int>,items:array<string>>"
_FOUND_TYPE = pa.struct([("n_words", pa.int64()), ("hit", pa.list_(pa.int32())), ("items", pa.list_(pa.string()))])


def benchmark_windows(items: DataFrame, item_col: str, text_col: str, window: int) -> DataFrame:
    """Distinct windows and the ids of their items: ``window`` (words with a space around each) and ``items``."""
    lower = F.translate(F.col(text_col), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.regexp_extract_all(lower, F.lit(WORD), F.lit(0))
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - (window - 1), F.lit(1)))
    cut = F.transform(starts, lambda i: F.concat(F.lit(" "), F.array_join(F.slice("words", i, window), " "), F.lit(" ")))
    return (
        items.select(F.col(item_col).cast("string").alias("item"), words.alias("words"))
        .where(F.size("words") > 0)
        .select("item", F.explode(cut).alias("window"))
        .groupBy("window")
        .agg(F.collect_set("item").alias("items"))
    )


def window_shards(windows: DataFrame, most: int) -> Iterator[list[tuple[str, list[str]]]]:
    """Windows in shards of about ``most`` bytes, each read when it is asked for."""
    bulk = F.octet_length("window") + F.coalesce(F.aggregate("items", F.lit(0), lambda a, x: a + F.octet_length(x)), F.lit(0))
    total = windows.agg(F.sum(bulk.cast("long"))).first()[0] or 0
    count = max(1, -(-total // most))
    shard = F.pmod(F.xxhash64("window"), F.lit(count))
    for k in range(count):
        yield [(r[0], list(r[1])) for r in windows.where(shard == k).select("window", "items").collect()]


_AUTOMATA: dict[int, tuple[ahocorasick.Automaton, list]] = {}


def _automaton(shared: Broadcast) -> tuple[ahocorasick.Automaton, list]:
    """Built once per worker: windows are kept as Latin-1 text, so one character is one UTF-8 byte."""
    known = shared.value
    if id(known) not in _AUTOMATA:
        _AUTOMATA.clear()
        automaton = ahocorasick.Automaton()
        for k, (window, _) in enumerate(known):
            text = window.encode().decode("latin-1")
            automaton.add_word(text, (k, len(text)))
        automaton.make_automaton()
        _AUTOMATA[id(known)] = automaton, known
    return _AUTOMATA[id(known)]


def normalised(text: str) -> bytes:
    """Words in lower case with one space around each."""
    return b" ".join([b"", *text.encode().translate(_BYTES).split(), b""])


def _scanner(shared: Broadcast):
    @F.arrow_udf(FOUND)
    def scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        automaton, known = _automaton(shared)
        for texts in released(batches):
            out = []
            for text in texts:
                line = normalised(text.as_py() or "")
                n_words = max(0, line.count(b" ") - 1)
                hit, items = np.zeros(0, np.int64), set()
                if len(known):
                    gaps, runs = None, []
                    for end, (k, length) in automaton.iter(line.decode("latin-1")):
                        if gaps is None:
                            gaps = np.flatnonzero(np.frombuffer(line, np.uint8) == 0x20)
                        first, last = int(np.searchsorted(gaps, end - length + 1)), int(np.searchsorted(gaps, end))
                        items.update(known[k][1])
                        # Occurrences come by their ends; runs are kept joined, so a text full of hits takes no more than its words.
                        while runs and runs[-1][0] >= first:
                            last = max(last, runs.pop()[1])
                        if runs and runs[-1][1] >= first:
                            runs[-1][1] = max(runs[-1][1], last)
                        else:
                            runs.append([first, last])
                    if runs:
                        hit = np.concatenate([np.arange(a, b) for a, b in runs])
                out.append((n_words, hit, sorted(items)))
            yield pa.array([dict(zip(("n_words", "hit", "items"), row, strict=True)) for row in out], _FOUND_TYPE)

    return scan


def with_findings(docs: DataFrame, items: DataFrame, name: str, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, most: int = MAX_AUTOMATON_BYTES) -> DataFrame:
    """``docs`` with a column ``name``: number of words, positions of hit words, ids of the items found (ascending)."""
    spark = docs.sparkSession
    shards = window_shards(benchmark_windows(items, item_col, item_text_col, window), most)
    first, second = next(shards), next(shards, None)
    if second is None:
        return docs.withColumn(name, _scanner(spark.sparkContext.broadcast(first))(F.col(text_col)))
    row = free_name(docs, "_row")
    kept = written(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")
    found = None
    for k, shard in enumerate(chain([first, second], shards)):
        scanned = kept.select(row, _scanner(spark.sparkContext.broadcast(shard))(F.col(text_col)).alias(name))
        # The first scan says for every document how many words it has.
        part = written(scanned if k == 0 else scanned.where(F.size(f"{name}.hit") > 0), "findings")
        found = part if found is None else found.union(part)
    listed = found.groupBy(row).agg(
        F.max(f"{name}.n_words").alias("n_words"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_list(f"{name}.hit")))).alias("hit"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_list(f"{name}.items")))).alias("items"),
    )
    return kept.join(listed.select(row, F.struct("n_words", "hit", "items").cast(FOUND).alias(name)), row).drop(row)


@F.arrow_udf(_SPANS)
def hit_spans(texts: pa.Array, hits: pa.Array) -> pa.Array:
    """Runs of hit words as character offsets of the original text, ends exclusive."""
    out = []
    for text, hit in zip(texts, hits, strict=True):
        positions, runs = hit.as_py() or [], []
        if positions:
            at = [m.span() for m in _WORD.finditer(text.as_py().translate(_LOWER_LETTERS))]
            for k in positions:
                if runs and runs[-1][2] == k - 1:
                    runs[-1][1:] = [at[k][1], k]
                else:
                    runs.append([at[k][0], at[k][1], k])
        out.append([{"start": a, "end": b} for a, b, _ in runs])
    return pa.array(out, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))


def decontaminate(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, most: int = MAX_AUTOMATON_BYTES) -> DataFrame:
    """One row per document: id, ``n_words``, ``n_hit``, ``items`` (ids as text, ascending) and ``spans`` of the original text.

    Other columns of ``docs`` are not read, whatever their names.
    """
    slim = docs.select(F.col(id_col), F.col(text_col).alias("text"))
    found = with_findings(slim, items, "found", item_col=item_col, item_text_col=item_text_col, window=window, most=most)
    return found.select(
        id_col,
        F.col("found.n_words").alias("n_words"),
        F.size("found.hit").cast("long").alias("n_hit"),
        F.col("found.items").alias("items"),
        hit_spans("text", "found.hit").alias("spans"),
    )


def without_contaminated(docs: DataFrame, items: DataFrame, *, text_col: str = "text", window: int = WINDOW, **names: str) -> DataFrame:
    """``docs`` without the documents that hold a window of a benchmark item; all other rows and columns as they were."""
    mark = free_name(docs, "found")
    return with_findings(docs, items, mark, text_col=text_col, window=window, **names).where(F.size(f"{mark}.hit") == 0).drop(mark)


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The contract's row per document."""
    return found.select(
        id_col,
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )

