"""Suffix-array dedup: bytes covered by a ``LENGTH``-byte string that also begins anywhere else in the corpus are removed.

Repeats are found by suffix arrays, which external induced sorting builds shard by shard (``suffixes``); three steps deal the
corpus to shards so that equal strings meet, and leave out what cannot repeat:

1. Texts become blocks of about ``BLOCK_BYTES`` (compressed; one row each), written once, by hash of the block: answers and spans come to them.
2. A string of ``LENGTH`` bytes has an *anchor*: the ``GRAM``-byte piece with the least hash, the leftmost of equals.  Equal
   strings have equal anchors.  Successive strings of a text with one anchor are a *stretch*, and the strings' whole range
   its content.  Blocks send each (anchor, content) once, as hashes (128 bits of the content), to buckets by anchor, and get back for
   each whether the anchor has one stretch only (nothing in it repeats), or whether this block is to send the content itself or, since
   another block does, its name.
3. Contents go to shards by anchor, one row for a block and a shard: each content's bytes from one block, 256 bits of digest from
   all blocks that have it, and all places.  What arrives waits on the task's scratch disk, and is sorted in lots by anchor.  A lot's
   contents become one text, separated, whose suffixes are sorted with bounded memory, whatever its size; neighbours with ``LENGTH``
   common bytes are repeats, and so is a suffix of a content with several places.  Digests are made again from the bytes sorted.
4. Each block joins what was found in it, and cuts its texts.

A piece that is the anchor of very many contents (a short passage that many texts have, each with other neighbours) would send them
all to one bucket and one shard.  Such pieces are looked for first, in whole blocks of a sample: they are no anchors as long as a
string has another piece, so its strings are dealt by their neighbours.  This depends on the pieces alone, so equal strings still meet,
and results are the same whatever the sample shows.

All strings are judged on the input.  Matches never cross texts.  A null or empty text has no bytes and keeps none; repeated
rows are repeats of each other; texts shorter than ``LENGTH`` keep everything; other columns are not read.  Cut texts are
bytes: a cut may fall within a character.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from corpusrules.llm.storage import kept_by
from corpusrules.llm.suffixes import Scratch, repeated_windows
from corpusrules.llm.words import mix, text_buffer

LENGTH = 200
GRAM = 64
BLOCK_BYTES = 16 << 20
BUCKET_BYTES = 64 << 20
SHARD_BYTES = 16 << 20
#: An anchor with this many contents, and some of them in a block, is hot; how many blocks are looked at, how often, and the most kept.
HOT_CONTENTS, HOT_IN_BLOCK, HOT_BLOCKS, HOT_ROUNDS, HOT_MOST = 20_000, 16, 8, 4, 1_000_000
#: Bytes of contents that are sorted together, unless one anchor has more; entries that a sort holds in memory.
LOT_BYTES, MEMORY = 2 << 20, 1 << 20
DIGEST = 32
#: Windows looked at together; their number and place fit the low bits of a hash.
CHUNK = 1 << 16
PLACE_BITS = 18

_BASE, _INVERSE = 0xD1342543DE82EF95, pow(0xD1342543DE82EF95, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, count: int) -> np.ndarray:
    """``base ** k`` modulo 2**64 for k below ``count``."""
    if base not in _powers or len(_powers[base]) < count:
        factors = np.full(max(count, CHUNK + LENGTH), base, np.uint64)
        factors[0] = 1
        _powers[base] = np.cumprod(factors)
    return _powers[base][:count]


class Texts(NamedTuple):
    """A block's texts one after the other, and where each begins."""

    data: np.ndarray
    bounds: np.ndarray


class Found(NamedTuple):
    """Stretches: first window and number of windows, the hash of the anchor, and two hashes of the content."""

    start: np.ndarray
    windows: np.ndarray
    anchor: np.ndarray
    content: np.ndarray


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` successive values, by doubling."""
    have = 1
    while 2 * have <= width:
        values = np.minimum(values[:-have], values[have:])
        have *= 2
    return np.minimum(values[: len(values) - (width - have)], values[width - have :]) if have < width else values


def _anchor_ids(grams: np.ndarray) -> np.ndarray:
    """Least hashes are all small; mixed again, they spread over buckets and shards."""
    return mix(grams + np.uint64(0x2545F4914F6CDD1D))


def stretches(texts: Texts, length: int = LENGTH, gram: int = GRAM, hot: np.ndarray | None = None) -> Found:
    """All stretches of a block, in order; chunks of windows are looked at one by one, so long texts take no more memory.

    Pieces in ``hot`` (anchors, ascending) come after all others.
    """
    parts = []
    n = len(texts.data)
    low = np.uint64((1 << PLACE_BITS) - 1)
    for first in range(0, max(0, n - length + 1), CHUNK):
        last = min(n, first + CHUNK + length - 1)
        # Windows that end within their text, as ranges of the texts that have some here.
        own = np.arange(np.searchsorted(texts.bounds, first, "right") - 1, np.searchsorted(texts.bounds, last, "left"))
        starts, ends = np.maximum(texts.bounds[own] - first, 0), np.minimum(texts.bounds[own + 1], last) - first - length + 1
        starts, ends = starts[ends > starts], ends[ends > starts]
        if not len(starts):
            continue
        data = texts.data[first:last].astype(np.uint64) + np.uint64(1)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(data * _power(_BASE, len(data)))])
        back = _power(_INVERSE, len(data) + 1)
        grams = mix((sums[gram:] - sums[:-gram]) * back[: len(sums) - gram])
        placed = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)
        if hot is not None and len(hot):
            names = _anchor_ids(grams)
            last_resort = hot[np.minimum(np.searchsorted(hot, names), len(hot) - 1)] == names
            placed = placed >> np.uint64(1) & ~low | placed & low | last_resort.astype(np.uint64) << np.uint64(63)
        anchor_at = (_least(placed, length - gram + 1) & low).astype(np.int64)
        cut = np.ones(len(anchor_at) + 1, dtype=bool)
        cut[1:-1] = anchor_at[1:] != anchor_at[:-1]
        cut[starts] = True
        cut[ends] = True
        edge = np.flatnonzero(cut)
        start, count = edge[:-1], np.diff(edge)
        inside = np.searchsorted(ends, start, "right")
        whole = (inside < len(ends)) & (starts[np.minimum(inside, len(ends) - 1)] <= start)
        start, count = start[whole], count[whole]
        end = start + count + length - 1
        ordered = mix((sums[end] - sums[start]) * back[start] + count.astype(np.uint64))
        held = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_anchor_ids(grams))])
        bag = mix(held[end - gram + 1] - held[start] + ordered)
        parts.append(Found(start + first, count, _anchor_ids(grams[anchor_at[start]]), np.stack([ordered, bag], axis=1)))
    if not parts:
        return Found(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros((0, 2), np.uint64))
    return Found(*(np.concatenate(c) for c in zip(*parts, strict=True)))


class Pairs(NamedTuple):
    """Distinct (anchor, content) of a block in order: both, how often, and each stretch's pair."""

    anchor: np.ndarray
    content: np.ndarray
    count: np.ndarray
    place: np.ndarray


def _pairs(found: Found) -> Pairs:
    order = np.lexsort((*found.content.T[::-1], found.anchor))
    anchor, content = found.anchor[order], found.content[order]
    new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (content[1:] != content[:-1]).any(axis=1)]) if len(order) else np.zeros(0, dtype=bool)
    starts = np.flatnonzero(new)
    place = np.empty(len(order), np.int64)
    place[order] = np.cumsum(new) - 1
    return Pairs(anchor[starts], content[starts], np.diff(np.append(starts, len(order))), place)


def _bucket(anchor: np.ndarray, buckets: int) -> np.ndarray:
    return ((anchor >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int32)


def _blocker(schema: pa.Schema) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, place, ids, sizes, held, size = TaskContext.get().partitionId(), 0, [], [], [], 0

        def row() -> pa.RecordBatch:
            data = b"".join(held)
            out = {"block": [task << 32 | place], "ids": [pa.concat_arrays(ids).to_pylist()], "sizes": [np.concatenate(sizes)], "data": [pa.compress(data, "zstd", asbytes=True)]}
            return pa.RecordBatch.from_pydict(out, schema=schema)

        for batch in batches:
            flat, bounds = text_buffer(batch.column("text"))
            first = 0
            while first < len(batch):
                last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + BLOCK_BYTES - size, "right")) - 1)
                held.append(flat[bounds[first] : bounds[last]].tobytes())
                ids.append(batch.column("id")[first:last])
                sizes.append(np.diff(bounds[first : last + 1]))
                size += len(held[-1])
                if size >= BLOCK_BYTES or last < len(batch):
                    yield row()
                    place, ids, sizes, held, size = place + 1, [], [], [], 0
                first = last
        if ids:
            yield row()

    return run


def _texts(sizes: pa.Scalar, data: pa.Scalar) -> Texts:
    bounds = np.concatenate([[0], np.cumsum(sizes.values.to_numpy())]).astype(np.int64)
    size = int(bounds[-1])
    raw = pa.decompress(data.as_buffer(), size, "zstd") if size else b""
    return Texts(np.frombuffer(raw, np.uint8), bounds)


def _crowded(length: int, gram: int, hot: np.ndarray) -> Callable:
    """How many contents each anchor of a block has, for those with several (by hash; only what is hot depends on it)."""
    schema = pa.schema([("anchor", pa.int64()), ("contents", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for sizes, data in zip(batch.column("sizes"), batch.column("data"), strict=True):
                found = stretches(_texts(sizes, data), length, gram, hot)
                anchor, contents = np.unique(_pairs(found).anchor, return_counts=True)
                several = contents >= HOT_IN_BLOCK
                yield pa.RecordBatch.from_arrays([pa.array(anchor[several].view(np.int64)), pa.array(contents[several])], schema=schema)

    return run


def hot_anchors(blocks: DataFrame, length: int, gram: int) -> np.ndarray:
    """Pieces that are to be anchors only where nothing else can be, ascending.

    Blocks are drawn by hash, ``HOT_BLOCKS`` of them or all, and looked at again with what was found, since other pieces of the same
    passage may take its place.  At most ``HOT_MOST`` are kept, those with the most contents first.
    """
    total = blocks.count()
    every = max(1, total // HOT_BLOCKS)
    drawn = blocks.where(F.pmod(F.xxhash64("block"), F.lit(every)) == 0).select("sizes", "data")
    hot = np.zeros(0, np.uint64)
    for _ in range(HOT_ROUNDS):
        counted = drawn.mapInArrow(_crowded(length, gram, hot), "anchor long, contents long").groupBy("anchor").agg(F.sum("contents").alias("contents"))
        crowded = counted.where(F.col("contents") * every >= HOT_CONTENTS).orderBy(F.desc("contents"), "anchor").limit(HOT_MOST - len(hot))
        found = np.array([r[0] for r in crowded.select("anchor").collect()], np.int64).view(np.uint64)
        fresh = np.setdiff1d(found, hot)
        if not len(fresh):
            break
        hot = np.union1d(hot, fresh)
    return hot


#: Answers: nothing here repeats; this block sends the bytes; another one does, and this block sends the digest.
NONE, BYTES, NAMED = 0, 1, 2


def _asker(buckets: int, length: int, gram: int, hot: np.ndarray | None = None) -> Callable:
    schema = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("anchors", pa.binary()), ("contents", pa.binary()), ("counts", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, sizes, data in zip(*(batch.column(c) for c in ("block", "sizes", "data")), strict=True):
                pairs = _pairs(stretches(_texts(sizes, data), length, gram, hot))
                cuts = np.searchsorted(_bucket(pairs.anchor, buckets), np.arange(buckets + 1))
                full = np.flatnonzero(cuts[1:] > cuts[:-1])
                parts = (("anchors", pairs.anchor), ("contents", pairs.content), ("counts", (pairs.count > 1).astype(np.uint8)))
                yield pa.RecordBatch.from_pydict(
                    {"block": [block.as_py()] * len(full), "bucket": full.astype(np.int32)} | {c: [v[cuts[k] : cuts[k + 1]].tobytes() for k in full] for c, v in parts},
                    schema=schema,
                )

    return run


def _answers(table: pa.Table) -> pa.Table:
    """For each question, in the order asked; of several blocks with a content, the first sends it."""
    parts = [[np.frombuffer(x.as_buffer(), kind) for x in table.column(c)] for c, kind in (("anchors", np.uint64), ("contents", np.uint64), ("counts", np.uint8))]
    blocks = table.column("block").to_numpy()
    anchor, content, several = (np.concatenate(p) for p in parts)
    content = content.reshape(-1, 2)
    block = np.repeat(blocks, [len(p) for p in parts[0]])
    order = np.lexsort((block, *content.T[::-1], anchor))
    a, c = anchor[order], content[order]
    new_anchor = np.concatenate([[True], a[1:] != a[:-1]])
    new_pair = new_anchor | np.concatenate([[True], (c[1:] != c[:-1]).any(axis=1)])
    pair, group = np.cumsum(new_pair) - 1, np.cumsum(new_anchor) - 1
    times = np.bincount(pair) + np.bincount(pair, several[order])
    contents = np.bincount(group, new_pair)
    answer = np.empty(len(order), np.uint8)
    answer[order] = np.where((times[pair] > 1) | (contents[group] > 1), np.where(new_pair, BYTES, NAMED), NONE)
    cuts = np.cumsum([len(p) for p in parts[0]])[:-1]
    return pa.table({"block": pa.array(blocks), "bucket": table.column("bucket").cast(pa.int32()), "answer": pa.array([x.tobytes() for x in np.split(answer, cuts)], pa.binary())})


_FOUND = "block long, shard int, lots binary, windows binary, places binary, starts binary, digests binary, size long, data binary"
_FOUND_ARROW = pa.schema([("block", pa.int64()), ("shard", pa.int32()), *((c, pa.binary()) for c in ("lots", "windows", "places", "starts", "digests")), ("size", pa.int64()), ("data", pa.binary())])


def _digests(texts: Texts, begin: np.ndarray, finish: np.ndarray) -> np.ndarray:
    data = memoryview(texts.data)
    found = b"".join([hashlib.blake2b(data[a:b], digest_size=DIGEST).digest() for a, b in zip(begin.tolist(), finish.tolist(), strict=True)])
    return np.frombuffer(found, np.uint64).reshape(-1, DIGEST // 8)


def _sender(shards: int, length: int, gram: int, hot: np.ndarray | None = None) -> Callable:
    """A row per block and shard: contents that come as bytes, joined and compressed, then those that come as digests."""

    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        out: dict[str, list] = {c: [] for c in _FOUND_ARROW.names}
        for block, sizes, data in zip(*(table.column(c) for c in ("block", "sizes", "data")), strict=True):
            texts = _texts(sizes, data)
            found = stretches(texts, length, gram, hot)
            pairs = _pairs(found)
            order = np.argsort(answers.column("bucket").to_numpy())
            replies = answers.column("answer").to_pylist()
            answer = np.concatenate([np.frombuffer(replies[k], np.uint8) for k in order] or [np.zeros(0, np.uint8)])
            sent = np.flatnonzero(answer)
            shard = ((pairs.anchor[sent] & np.uint64(0xFFFFFFFF)) % np.uint64(shards)).astype(np.int32)
            by_shard = np.lexsort((answer[sent], shard))
            sent, shard = sent[by_shard], shard[by_shard]
            # Stretches in the order of the pairs that they are of.
            rank = np.full(len(pairs.anchor), -1, np.int64)
            rank[sent] = np.arange(len(sent))
            own = rank[pairs.place] if len(pairs.place) else pairs.place
            stretch = np.argsort(own, kind="stable")
            stretch = stretch[np.searchsorted(own[stretch], 0) :]
            begin, finish = found.start[stretch], (found.start + found.windows + length - 1)[stretch]
            ends = np.concatenate([[0], np.cumsum(pairs.count[sent])])
            digest = _digests(texts, begin, finish)
            first = ends[:-1]
            if (digest != np.repeat(digest[first], pairs.count[sent], axis=0)).any():
                raise RuntimeError("two contents agree in all hashes, but not in their digests")
            cuts = np.append(np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]])), len(sent)) if len(sent) else np.zeros(1, np.int64)
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                whole = a + int(np.searchsorted(answer[sent[a:b]], BYTES, "right"))
                raw = b"".join(texts.data[x:y].tobytes() for x, y in zip(begin[first[a:whole]].tolist(), finish[first[a:whole]].tolist(), strict=True))
                row = {
                    "block": block.as_py(),
                    "shard": int(shard[a]),
                    "lots": (pairs.anchor[sent[a:b]] >> np.uint64(48)).astype(np.uint16).tobytes(),
                    "windows": found.windows[stretch[first[a:b]]].astype(np.int32).tobytes(),
                    "places": pairs.count[sent[a:b]].astype(np.int32).tobytes(),
                    "starts": begin[ends[a] : ends[b]].astype(np.int32).tobytes(),
                    "digests": digest[first[a:b]].tobytes(),
                    "size": len(raw),
                    "data": pa.compress(raw, "zstd", asbytes=True),
                }
                for name, value in row.items():
                    out[name].append(value)
        return pa.Table.from_pydict(out, schema=_FOUND_ARROW)

    return run


class _Shipment(NamedTuple):
    """A block's contents for a shard: lots, windows, places and digests of all, the bytes of the first ones, joined and compressed."""

    block: int
    lots: np.ndarray
    windows: np.ndarray
    places: np.ndarray
    starts: np.ndarray
    digests: np.ndarray
    size: int
    data: bytes


class _Shipments:
    """What blocks sent, on the scratch disk, as it came."""

    def __init__(self, scratch: Scratch):
        self.path, self.size, self.bytes = scratch.file(), 0, 0
        self.out = open(self.path, "wb")

    def add(self, row: dict[str, pa.Scalar]) -> None:
        parts = [row[c].as_py() for c in ("lots", "windows", "places", "starts", "digests", "data")]
        self.out.write(np.array([row["block"].as_py(), row["size"].as_py(), *map(len, parts)], np.int64).tobytes())
        self.out.writelines(parts)
        self.bytes += row["size"].as_py() + len(parts[1]) // 4

    def __iter__(self) -> Iterator[_Shipment]:
        self.out.flush()
        with open(self.path, "rb") as file:
            while head := file.read(64):
                block, size, *lengths = np.frombuffer(head, np.int64).tolist()
                lots, windows, places, starts, digests, data = (file.read(n) for n in lengths)
                yield _Shipment(block, np.frombuffer(lots, np.uint16), *(np.frombuffer(x, np.int32) for x in (windows, places, starts)), np.frombuffer(digests, np.uint64).reshape(-1, DIGEST // 8), size, data)


def _runs(repeated: np.ndarray, at: np.ndarray, windows: np.ndarray, several: np.ndarray, memory: int) -> tuple[np.ndarray, np.ndarray]:
    """Runs of repeated windows of each content, as starts and ends within it, and where each content's runs begin; in bounded pieces."""
    found, counts = [np.zeros((0, 2), np.int32)], np.zeros(len(at) + 1, np.int64)
    first = 0
    while first < len(at):
        last = max(first + 1, int(np.searchsorted(at, at[first] + memory, "right")) - 1)
        low, high = int(at[first]), int(at[last - 1] + windows[last - 1])
        edge = np.zeros(high - low + 1, np.int8)
        edge[at[first:last] - low] += 1
        np.subtract.at(edge, at[first:last] + windows[first:last] - low, 1)
        inside = np.cumsum(edge[:-1], dtype=np.int8).astype(bool)
        marked = np.asarray(repeated[low:high]) | np.repeat(np.repeat(several[first:last], 2) & np.tile([True, False], last - first), np.diff(np.append(np.stack([at[first:last], at[first:last] + windows[first:last]], axis=1).ravel(), high) - low))
        cut = np.flatnonzero(np.diff(np.concatenate([[0], (marked & inside).astype(np.int8), [0]]))).reshape(-1, 2) + low
        owner = np.searchsorted(at, cut[:, 0], "right") - 1
        counts[1:] += np.bincount(owner, minlength=len(at))
        found.append((cut - at[owner][:, None]).astype(np.int32))
        first = last
    return np.concatenate(found), np.cumsum(counts)


def _sorted_lot(shipments: _Shipments, lot: int, lots: int, scratch: Scratch, length: int, memory: int) -> Iterator[tuple[int, np.ndarray]]:
    """Blocks and their spans, from the contents of one lot: joined into one text, and its suffixes sorted."""
    numbers: dict[bytes, int] = {}
    at, wide, size = [], [], 0
    path = scratch.file()
    with open(path, "wb") as file:
        for s in shipments:
            if not s.size:
                continue
            raw = np.frombuffer(pa.decompress(s.data, s.size, "zstd"), np.uint8)
            ends = np.cumsum(s.windows + (length - 1), dtype=np.int64)
            came = int(np.searchsorted(ends, s.size, "right"))
            for k in np.flatnonzero(s.lots[:came] % lots == lot).tolist():
                content = raw[ends[k] - s.windows[k] - length + 1 : ends[k]]
                # The bytes that are sorted are those that the digest stands for.
                name = hashlib.blake2b(content, digest_size=DIGEST).digest()
                if numbers.setdefault(name, len(at)) == len(at):
                    file.write(np.append(content.astype(np.uint16) + np.uint16(2), np.uint16(1)).tobytes())
                    at.append(size)
                    wide.append(int(s.windows[k]))
                    size += len(content) + 1
        file.write(np.zeros(1, np.uint16).tobytes())
    times = np.zeros(len(at), np.int64)
    for s in shipments:
        own = s.lots % lots == lot
        np.add.at(times, _numbered(numbers, s.digests[own]), s.places[own])
    repeated = repeated_windows(np.memmap(path, np.uint16, "r"), scratch, length, memory)
    path.unlink()
    runs, bounds = _runs(repeated, np.array(at, np.int64), np.array(wide, np.int64), times > 1, memory)
    scratch.drop(repeated)
    for s in shipments:
        own = s.lots % lots == lot
        content = np.repeat(_numbered(numbers, s.digests[own]), s.places[own])
        count = (bounds[1:] - bounds[:-1])[content]
        which = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(bounds[:-1][content], count)
        if len(which):
            starts = s.starts[np.repeat(own, s.places)]
            yield s.block, (runs[which] + np.repeat(starts, count)[:, None] + np.array([0, length - 1], np.int32)).astype(np.int32)


def _sorter(length: int, memory: int, lot_bytes: int) -> Callable:
    """A shard's contents, lot by lot (by anchor); the repeated windows of each as spans of the blocks that have it."""
    schema = pa.schema([("block", pa.int64()), ("spans", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with tempfile.TemporaryDirectory() as folder:
            scratch = Scratch(folder, memory // 2)
            shipments = _Shipments(scratch)
            for batch in batches:
                for k in range(batch.num_rows):
                    shipments.add({c: batch.column(c)[k] for c in batch.schema.names})
            lots = max(1, -(-shipments.bytes // lot_bytes))
            for lot in range(lots):
                for block, spans in _sorted_lot(shipments, lot, lots, scratch, length, memory):
                    yield pa.RecordBatch.from_pydict({"block": [block], "spans": [spans.tobytes()]}, schema=schema)

    return run


def _numbered(numbers: dict[bytes, int], digests: np.ndarray) -> np.ndarray:
    """Numbers of contents by their digests.  A block names what another one sends if all hashes agree; then the digests have to."""
    names = digests.tobytes()
    try:
        return np.array([numbers[names[k : k + DIGEST]] for k in range(0, len(names), DIGEST)], np.int64)
    except KeyError:
        raise RuntimeError("two contents agree in all hashes, but not in their digests") from None


def merged(spans: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Spans, each within one text, joined where they touch or overlap within it; ascending."""
    if not len(spans):
        return np.zeros((0, 2), np.int64)
    spans = spans[np.argsort(spans[:, 0], kind="stable")].astype(np.int64)
    owner = np.searchsorted(bounds, spans[:, 0], "right")
    reach = np.maximum.accumulate(spans[:, 1])
    new = np.concatenate([[True], (spans[1:, 0] > reach[:-1]) | (owner[1:] != owner[:-1])])
    starts = np.flatnonzero(new)
    return np.stack([spans[starts, 0], reach[np.append(starts[1:], len(spans)) - 1]], axis=1)


def _cutter(schema: pa.Schema, kept: bool) -> Callable:
    def run(table: pa.Table, found: pa.Table) -> pa.Table:
        out: dict[str, list] = {c: [] for c in schema.names}
        for ids, sizes, data in zip(*(table.column(c) for c in ("ids", "sizes", "data")), strict=True):
            texts = _texts(sizes, data)
            spans = np.concatenate([np.frombuffer(x.as_buffer(), np.int32).reshape(-1, 2) for x in found.column("spans")] or [np.zeros((0, 2), np.int32)])
            runs = merged(spans, texts.bounds)
            at = np.searchsorted(runs[:, 0], texts.bounds)
            for k, (key, a, b) in enumerate(zip(ids.as_py(), texts.bounds[:-1], texts.bounds[1:], strict=True)):
                own = (runs[at[k] : at[k + 1]] - a).tolist()
                edges = [0, *(x for run in own for x in run), int(b - a)]
                rest = b"".join(texts.data[a + x : a + y].tobytes() for x, y in zip(edges[::2], edges[1::2], strict=True))
                row = {"id": key, "n_bytes": int(b - a), "n_removed": int(b - a) - len(rest), "n_spans": len(own), "kept_sha256": hashlib.sha256(rest).hexdigest(), "spans": [{"start": x, "end": y} for x, y in own]}
                if kept:
                    row["kept"] = rest
                for name, value in row.items():
                    out[name].append(value)
        return pa.Table.from_pydict(out, schema=schema)

    return run


def without_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int | None = None, memory: int = MEMORY, kept: bool = False) -> DataFrame:
    """One row per document: ``id``, ``n_bytes``, ``n_removed``, ``n_spans``, ``kept_sha256``, ``spans`` (byte offsets), and ``kept`` bytes if asked for."""
    gram = min(GRAM, max(1, length // 3)) if gram is None else gram
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = slim.schema["id"].dataType
    block_schema = T.StructType([T.StructField("block", T.LongType()), T.StructField("ids", T.ArrayType(kind)), T.StructField("sizes", T.ArrayType(T.LongType())), T.StructField("data", T.BinaryType())])
    blocks = kept_by(slim.mapInArrow(_blocker(to_arrow_schema(block_schema)), block_schema), "block", "blocks")
    size = blocks.agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0
    buckets, shards = max(1, -(-size // BUCKET_BYTES)), max(1, -(-size // SHARD_BYTES))
    hot = hot_anchors(blocks, length, gram)
    asked = blocks.select("block", "sizes", "data").mapInArrow(_asker(buckets, length, gram, hot), "block long, bucket int, anchors binary, contents binary, counts binary")
    answers = asked.groupBy("bucket").applyInArrow(_answers, "block long, bucket int, answer binary")
    found = blocks.select("block", "sizes", "data").groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_sender(shards, length, gram, hot), _FOUND)
    sort = _sorter(length, memory, LOT_BYTES)

    def sorted_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from sort(batches)

    spans = found.groupBy("shard").applyInArrow(sorted_shard, "block long, spans binary")
    fields = [T.StructField("id", kind), *(T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")), T.StructField("kept_sha256", T.StringType())]
    fields.append(T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))))
    schema = T.StructType(fields + ([T.StructField("kept", T.BinaryType())] if kept else []))
    return blocks.groupBy("block").cogroup(spans.groupBy("block")).applyInArrow(_cutter(to_arrow_schema(schema), kept), schema)


def digest(cut: DataFrame) -> DataFrame:
    """The contract's row per document."""
    return cut.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")
