"""Search over an index: files landed with numbers, and posting lists of their trigrams.

:func:`write_index` lands the files as they are split and lists, for each trigram and block of ``BLOCK`` files, the files that have it.  :func:`indexed_search` asks a
search what its files must hold (``functions.trigrams``), meets the posting lists block by block, and verifies the candidates line by line, so contents are read
only where the lists leave a possibility.  Results are those of ``operators.search.search_content`` over all files.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusrules.functions import trigrams as G
from corpusrules.operators.search import search_content
from corpusrules.rulepack import Search
from corpusrules.session import scratch_path

#: Files of a block, as a power of two; a posting list has one entry a file.
BLOCK_BITS = 16
#: Postings that a task gathers before it writes them out, and what it is handed at a time: a task's memory is some 50 bytes a posting, whatever the files.
GATHERED = 1_000_000
HANDED = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}
#: Candidates that are looked up one by one; of more, parts with candidates are read whole.
MOST_CANDIDATES = 5_000_000

_PART_BITS = 33
_CANDIDATES = "search_name string, part int, file_no long"
_POSTINGS = "trigram int, part int, block int, files binary"


def _poster() -> Callable:
    schema = pa.schema([("trigram", pa.int32()), ("part", pa.int32()), ("block", pa.int32()), ("files", pa.binary())])

    def rows(part: int, block: int, held: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
        own = np.concatenate([c for _, c in held]).astype(np.uint64) << np.uint64(32)
        own |= np.repeat(np.array([p for p, _ in held], np.uint64), [len(c) for _, c in held])
        own.sort()
        codes, places = (own >> np.uint64(32)).astype(np.int32), own.astype(np.uint32)
        starts = np.flatnonzero(np.diff(codes, prepend=-1))
        offsets = (np.append(starts, len(codes)) * places.itemsize).astype(np.int32)
        lists = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(places)])
        columns = [codes[starts], np.full(len(starts), part, np.int32), np.full(len(starts), block, np.int32)]
        return pa.RecordBatch.from_arrays([*map(pa.array, columns), lists], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, size = None, [], 0
        for batch in batches:
            for number, content in zip(batch.column("file_no").to_pylist(), batch.column("content"), strict=True):
                part, place = number >> _PART_BITS, number & (1 << _PART_BITS) - 1
                own = G.codes(content.as_py()) if content.is_valid else np.zeros(0, np.uint32)
                if held and (at != (part, place >> BLOCK_BITS) or size + len(own) > GATHERED):
                    yield rows(*at, held)
                    held, size = [], 0
                at = (part, place >> BLOCK_BITS)
                held.append((place, own))
                size += len(own)
        if held:
            yield rows(*at, held)

    return run


@contextmanager
def _set(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    """The session with other settings while this lasts."""
    before = {key: spark.conf.get(key, None) for key in settings}
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def write_index(files: DataFrame, path: str) -> None:
    """Land ``files`` below ``path`` with their posting lists; a reader's split becomes a part."""
    number = F.monotonically_increasing_id()
    landed = files.withColumn("file_no", number).withColumn("part", F.shiftright("file_no", _PART_BITS).cast("int"))
    landed.write.partitionBy("part").parquet(f"{path}/files")
    stored = files.sparkSession.read.parquet(f"{path}/files")
    # Numbers grow within a part, so a task meets a part's blocks in order, and lists ascend.
    lists = stored.select("file_no", F.col("content").cast("binary").alias("content")).mapInArrow(_poster(), _POSTINGS)
    with _set(files.sparkSession, HANDED):
        lists.repartitionByRange("trigram", "part").sortWithinPartitions("trigram", "part", "block").write.parquet(f"{path}/postings")


def indexed_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/files")


def _meet(condition: G.Condition, lists: dict[int, np.ndarray]) -> np.ndarray:
    if isinstance(condition, str):
        found = None
        for code in sorted(G.trigrams(condition).tolist(), key=lambda c: len(lists.get(c, ()))):
            own = lists.get(code, np.zeros(0, np.uint32))
            found = own if found is None else np.intersect1d(found, own, assume_unique=True)
            if not len(found):
                break
        return found
    parts = [_meet(c, lists) for c in condition[1]]
    together = np.intersect1d if condition[0] == "and" else np.union1d
    found = parts[0]
    for part in parts[1:]:
        found = together(found, part)
    return found


def _matcher(conditions: list[tuple[str, G.Condition]]) -> Callable:
    schema = pa.schema([("search_name", pa.string()), ("part", pa.int32()), ("file_no", pa.int64())])

    def run(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        gathered: dict[int, list[np.ndarray]] = {}
        for code, files in zip(table.column("trigram").to_pylist(), table.column("files"), strict=True):
            gathered.setdefault(code, []).append(np.frombuffer(files.as_buffer(), np.uint32))
        lists = {code: np.unique(np.concatenate(own)) for code, own in gathered.items()}
        found = [(name, _meet(condition, lists)) for name, condition in conditions]
        names = np.repeat(np.arange(len(found)), [len(f) for _, f in found])
        numbers = np.concatenate([f for _, f in found]).astype(np.int64) | part << _PART_BITS
        return pa.table({"search_name": pa.array([found[k][0] for k in names], pa.string()), "part": pa.array(np.full(len(numbers), part, np.int32)), "file_no": numbers}, schema=schema)

    return run


def candidates(spark: SparkSession, path: str, searches: Sequence[Search]) -> DataFrame:
    """``search_name``, ``part`` and ``file_no`` of the files that may have a match; searches that ask for nothing are left out."""
    conditions = [(s.name, c) for s in searches if (c := G.of_search(s)) is not True]
    wanted = sorted({int(t) for _, c in conditions for t in G.trigrams(c)})
    lists = spark.read.parquet(f"{path}/postings").where(F.col("trigram").isin(wanted))
    return lists.groupBy("part", "block").applyInArrow(_matcher(conditions), _CANDIDATES)


def indexed_search(spark: SparkSession, path: str, searches: Sequence[Search] | Search) -> DataFrame:
    """``search_content`` over the indexed files, reading only candidates."""
    searches = [searches] if isinstance(searches, Search) else list(searches)
    if not searches:
        raise ValueError("config holds no search definitions")
    stored = indexed_files(spark, path)
    # Candidates are numbers; they are stored, since they are counted first and looked up then.
    found_at = scratch_path(spark, "candidates")
    candidates(spark, path, searches).write.parquet(found_at)
    known = spark.read.schema(_CANDIDATES).parquet(found_at)
    sizes = {r[0]: (r[1], r[2]) for r in known.groupBy("search_name").agg(F.count("*"), F.collect_set("part")).collect()}
    found = None
    for search in searches:
        files = stored
        if G.of_search(search) is not True:
            count, parts = sizes.get(search.name, (0, []))
            files = files.where(F.col("part").isin(parts) if parts else F.lit(False))
            if count <= MOST_CANDIDATES:
                own = known.where(F.col("search_name") == search.name).select("file_no")
                files = files.join(F.broadcast(own), "file_no", "left_semi")
        own = search_content(files, [search])
        found = own if found is None else found.unionByName(own, allowMissingColumns=True)
    return found


def index_report(spark: SparkSession, path: str, searches: Sequence[Search] | Search) -> DataFrame:
    """Per search: files in all, and files that are read for it."""
    searches = [searches] if isinstance(searches, Search) else list(searches)
    total = indexed_files(spark, path).count()
    counts = {r[0]: r[1] for r in candidates(spark, path, searches).groupBy("search_name").count().collect()}
    rows = [(s.name, total, total if G.of_search(s) is True else counts.get(s.name, 0)) for s in searches]
    return spark.createDataFrame(rows, "search_name string, files long, files_read long")
