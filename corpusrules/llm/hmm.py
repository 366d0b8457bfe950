"""Hidden Markov language model with emissions for single words: Baum-Welch counts summed over tasks, exact scaled forward likelihoods.

A text is its words (A-Z lower-cased) and one end token.  Words that the training texts have ``OWN`` times or more are *symbols* of their own, up to ``SYMBOLS`` of them (if more
words are as frequent, the bar is doubled until they fit: the table of symbols is broadcast); all others share ``CLASSES`` symbols by hash, and the end token is one.  ``STATES`` latent states emit
symbols, ``B(state, symbol) = (1 - BASE) * q(state, symbol) + BASE * P(symbol)``, and a shared symbol emits a word by its add-one share of it.  ``P`` is the
symbol's share of the training counts (add-one by word, and one unknown word a class), so probabilities of words sum to one.  ``q`` is learned:

1. Texts become blocks of about ``BLOCK_BYTES`` (compressed; one row each) as they are read, written once.
2. Blocks send their distinct words (64-bit hashes) with their training counts to buckets by hash, and get the corpus counts back in the order sent.  All words are counted, whatever
   their number; a word, however frequent, is one entry per block.
3. A Baum-Welch round is one scan of the blocks: forward and backward over their training texts.  Tasks add up expected counts, and stripes of symbols are added up over tasks.
4. Scoring joins each block with its counts.

Forward and backward run over stretches of ``STRETCH`` tokens of all texts of a piece at once.  A later stretch's effect is a matrix from the state before it to the
state at its end; products of these give each stretch its exact forward vector before and backward vector behind, so no move between stretches is lost, in training or
scoring, and a long text is no long loop.

Null and empty texts are the end token alone.  A null id is a training row.  With no training text, all words share what an unknown one has, and the end too.
Repeated rows count and are scored each; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from corpusrules.llm.storage import written
from corpusrules.llm.words import Words, hash_words, mix, release, released, row_sums, split_words, text_buffer

STATES = 8
ROUNDS = 5
#: Training occurrences from which a word is a symbol of its own, the most of these, and symbols that the others share.
OWN, SYMBOLS, CLASSES = 16, 1 << 16, 2048
STRETCH = 1024
#: Steps after which the products of a stretch are scaled.
SCALED = 16
BLOCK_BYTES = 16 << 20
#: Entries (distinct words of blocks) of a bucket; far fewer buckets than blocks.
BUCKET_WORDS = 1 << 20
STRIPES = 64
SEED = 8
#: The share of ``P`` in emissions.
BASE = 0.1
#: Added to every expected first state and move.
SMOOTH = 1e-2


class Hmm(NamedTuple):
    """``first`` and ``move`` by state, and ``q``, a row per symbol: words of their own, shared symbols, the end token."""

    first: np.ndarray
    move: np.ndarray
    learned: np.ndarray


class Lexicon(NamedTuple):
    """Words with symbols of their own (hashes, ascending) and their counts; tokens and distinct words of each class of the others; the end token's
    count; and tokens and distinct ones in all, the end token's included."""

    words: np.ndarray
    counts: np.ndarray
    class_tokens: np.ndarray
    class_words: np.ndarray
    ends: int
    tokens: int
    distinct: int

    @property
    def size(self) -> int:
        return len(self.words) + CLASSES + 1

    @property
    def shares(self) -> np.ndarray:
        """``P`` of all symbols."""
        weights = np.concatenate([self.counts + 1.0, self.class_tokens + self.class_words + 1.0, [self.ends + 1.0]])
        return weights / weights.sum()

    def within(self, words: np.ndarray, counts: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """Each word's share of its symbol."""
        of = _class(words)
        shared = (counts + 1.0) / (self.class_tokens[of] + self.class_words[of] + 1.0)
        return np.where(symbols < len(self.words), 1.0, shared)


class Lookup:
    """Symbols of word hashes: two tables with room to spare, and the few words that are in neither."""

    def __init__(self, words: np.ndarray):
        self.words, self.bits = words, np.uint64(max(4 * len(words), 16).bit_length())
        numbers = np.arange(len(words), dtype=np.int32)
        self.tables = []
        for k in range(2):
            table = np.full(1 << int(self.bits), -1, np.int32)
            table[self._slot(words[numbers], k)] = numbers
            numbers = numbers[table[self._slot(words[numbers], k)] != numbers]
            self.tables.append(table)
        self.rest = numbers

    def _slot(self, words: np.ndarray, k: int) -> np.ndarray:
        return ((words * np.uint64((0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)[k])) >> (np.uint64(64) - self.bits)).astype(np.int64)

    def __call__(self, words: np.ndarray) -> np.ndarray:
        out = len(self.words) + _class(words)
        open_ = np.arange(len(words))
        for k, table in enumerate(self.tables):
            found = table[self._slot(words[open_], k)]
            hit = (found >= 0) & (self.words[np.maximum(found, 0)] == words[open_]) if len(self.words) else np.zeros(len(open_), dtype=bool)
            out[open_[hit]] = found[hit]
            open_ = open_[~hit]
        if len(self.rest):
            kept = self.words[self.rest]
            at = np.minimum(np.searchsorted(kept, words[open_]), len(kept) - 1)
            hit = kept[at] == words[open_]
            out[open_[hit]] = self.rest[at[hit]]
        return out


def _class(words: np.ndarray) -> np.ndarray:
    return (words % np.uint64(CLASSES)).astype(np.int64)


def with_ends(words: Words, values: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """A number per token of a piece, the end tokens' put in, and each text's bounds."""
    out = np.full(len(values) + words.rows, end, np.int64)
    out[np.arange(len(values)) + words.row] = values
    return out, words.bounds() + np.arange(words.rows + 1)


class Stretches(NamedTuple):
    """Runs of at most ``STRETCH`` tokens, longest first; ``running[t]`` of them have a token ``t``."""

    text: np.ndarray
    number: np.ndarray
    start: np.ndarray
    length: np.ndarray
    running: np.ndarray

    def where(self, kept: np.ndarray) -> Stretches:
        length = self.length[kept]
        return Stretches(self.text[kept], self.number[kept], self.start[kept], length, _running(length))


def _running(length: np.ndarray) -> np.ndarray:
    return np.searchsorted(-length, -np.arange(length[0] if len(length) else 0), "left")


def stretches(bounds: np.ndarray, most: int = STRETCH) -> Stretches:
    lengths = np.diff(bounds)
    counts = -(-lengths // most)
    text = np.repeat(np.arange(len(lengths)), counts)
    number = np.arange(len(text)) - np.repeat(np.cumsum(counts) - counts, counts)
    start = bounds[text] + number * most
    length = np.minimum(most, bounds[text + 1] - start)
    order = np.argsort(-length, kind="stable")
    length = length[order]
    return Stretches(text[order], number[order], start[order], length, _running(length))


class Edges(NamedTuple):
    """For each stretch, the forward vector before it (not of first ones) and the backward vector behind it; each text's log-likelihood."""

    before: np.ndarray
    behind: np.ndarray
    logs: np.ndarray


def edges(model: Hmm, emit: np.ndarray, tokens: np.ndarray, runs: Stretches, texts: int) -> Edges:
    """By one forward pass: the vector after a text's first stretch, the matrices of later ones (a row for each state that the one before may have ended in)."""
    states = len(model.first)
    first = runs.number == 0
    vector, level = np.zeros((int(first.sum()), states)), np.zeros(len(first))
    maps = np.zeros((len(first) - len(vector), states, states))
    # Runs of both kinds are ordered by length, and so are those that still go on.
    ends = np.concatenate([[0], np.cumsum(first)])
    vector_at, map_at = np.cumsum(first) - 1, np.cumsum(~first) - 1
    for t, n in enumerate(runs.running):
        e = emit[tokens[runs.start[:n] + t]].astype(np.float64)
        one, other = first[:n], ~first[:n]
        v, m = int(ends[n]), int(n - ends[n])
        vector[:v] = (model.first if t == 0 else vector[:v] @ model.move) * e[one]
        moved = np.broadcast_to(model.move, (m, states, states)) if t == 0 else (maps[:m].reshape(-1, states) @ model.move).reshape(m, states, states)
        np.multiply(moved, e[other][:, None, :], out=maps[:m])
        last = n if t + 1 == len(runs.running) else int(runs.running[t + 1])
        # Products are scaled now and then, and where a run ends.
        if t % SCALED == SCALED - 1 or last < n or t + 1 == len(runs.running):
            scale = np.empty(n)
            scale[one], scale[other] = vector[:v].sum(axis=1), maps[:m].sum(axis=(1, 2))
            vector[:v] /= scale[one][:, None]
            maps[:m] /= scale[other][:, None, None]
            level[:n] += np.log(scale)
    order = np.lexsort((runs.text, runs.number))
    cuts = np.searchsorted(runs.number[order], np.arange(runs.number.max() + 2)) if len(order) else np.zeros(1, np.int64)
    before, behind = np.zeros((len(first), states)), np.ones((len(first), states))
    logs, current = np.zeros(texts), np.zeros((texts, states))
    for number in range(len(cuts) - 1):
        which = order[cuts[number] : cuts[number + 1]]
        text = runs.text[which]
        if number == 0:
            current[text], logs[text] = vector[vector_at[which]], level[which]
            continue
        before[which] = current[text]
        joined = np.einsum("ns,nsk->nk", current[text], maps[map_at[which]])
        scale = joined.sum(axis=1)
        current[text] = joined / scale[:, None]
        logs[text] += level[which] + np.log(scale)
    current = np.ones((texts, states))
    for number in range(len(cuts) - 2, -1, -1):
        which = order[cuts[number] : cuts[number + 1]]
        text = runs.text[which]
        behind[which] = current[text]
        if number:
            back = np.einsum("nsk,nk->ns", maps[map_at[which]], current[text])
            current[text] = back / back.max(axis=1, keepdims=True)
    return Edges(before, behind, logs)


class Counts:
    """Expected counts of one Baum-Welch round: first states, moves, log-likelihood and tokens, and occupations by symbol."""

    def __init__(self, states: int, symbols: int):
        self.first, self.move, self.total, self.symbols = np.zeros(states), np.zeros((states, states)), np.zeros(2), np.zeros((symbols, states))

    def add(self, model: Hmm, emit: np.ndarray, tokens: np.ndarray, bounds: np.ndarray, most: int = STRETCH) -> None:
        """Forward and backward over all stretches of a piece at once, one step per position."""
        runs = stretches(bounds, most)
        if not len(runs.start):
            return
        states, kind = len(model.first), emit.dtype
        begin = runs.number == 0
        long = (np.diff(bounds) > most)[runs.text]
        ahead, before, behind = np.tile(model.first, (len(begin), 1)), np.zeros((len(begin), states)), np.ones((len(begin), states))
        if long.any():
            joint = edges(model, emit, tokens, runs.where(long), len(bounds) - 1)
            before[long], behind[long] = joint.before, joint.behind
            ahead[~begin] = before[~begin] @ model.move
        move, back, ones = model.move.astype(kind), np.ascontiguousarray(model.move.T).astype(kind), np.ones((states, 1), kind)
        ahead, behind = ahead.astype(kind), behind.astype(kind)
        alphas, emits, scales, seen = [], [], [], []
        for t, n in enumerate(runs.running):
            x = tokens[runs.start[:n] + t]
            e = emit[x]
            a = (ahead if t == 0 else alphas[-1][:n] @ move) * e
            scale = a @ ones
            a /= scale
            alphas.append(a)
            # What a step back needs of a token.
            e /= scale
            emits.append(e)
            scales.append(scale)
            seen.append(x)
        raw_moves = np.zeros_like(model.move)
        beta, later, gammas = np.zeros((0, states), kind), 0, []
        for t in range(len(alphas) - 1, -1, -1):
            n = len(alphas[t])
            own = np.empty_like(alphas[t])
            if later:
                step = emits[t + 1] * beta
                raw_moves += alphas[t][:later].T @ step
                np.matmul(step, back, out=own[:later])
            if later < n:
                # Stretches that end here, scaled so that forward and backward meet in a distribution.
                own[later:] = behind[later:n] / ((alphas[t][later:] * behind[later:n]) @ ones)
            beta, later = own, n
            gammas.append(alphas[t] * beta)
        if not begin.all():
            raw_moves += before[~begin].T @ (emits[0] * beta)[~begin]
        self.move += raw_moves * model.move
        self.first += gammas[-1][begin].sum(axis=0)
        gamma, x = np.concatenate(gammas[::-1]), np.concatenate(seen)
        del alphas, emits, gammas
        for k in range(states):
            self.symbols[:, k] += np.bincount(x, gamma[:, k], len(self.symbols))
        self.total += (float(np.log(np.concatenate(scales), dtype=np.float64).sum()), len(x))


def _blocker(schema: pa.Schema, block_bytes: int) -> Callable:
    """Texts as they come, in blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, place, ids, held, sizes, data, size = TaskContext.get().partitionId(), 0, [], [], [], [], 0

        def row() -> pa.RecordBatch:
            packed = pa.compress(b"".join(data), "zstd", asbytes=True)
            values = {"block": [task << 32 | place], "ids": [pa.concat_arrays(ids).to_pylist()], "held": [np.concatenate(held).tolist()], "sizes": [np.concatenate(sizes)], "data": [packed]}
            return pa.RecordBatch.from_pydict(values, schema=schema)

        for batch in released(batches):
            flat, bounds = text_buffer(batch.column("text"))
            first = 0
            while first < len(batch):
                last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + block_bytes - size, "right")) - 1)
                data.append(flat[bounds[first] : bounds[last]].tobytes())
                ids.append(batch.column("id")[first:last])
                held.append(batch.column("held_out")[first:last].to_numpy(zero_copy_only=False))
                sizes.append(np.diff(bounds[first : last + 1]))
                size += len(data[-1])
                if size >= block_bytes or last < len(batch):
                    yield row()
                    place, ids, held, sizes, data, size = place + 1, [], [], [], [], 0
                first = last
        if ids:
            yield row()

    return run


def _texts(sizes: pa.Scalar, data: pa.Scalar) -> pa.Array:
    bounds = np.concatenate([[0], np.cumsum(sizes.values.to_numpy())]).astype(np.int64)
    size = int(bounds[-1])
    raw = pa.decompress(data.as_buffer(), size, "zstd") if size else pa.py_buffer(b"")
    return pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds), raw])


def _held(row: pa.Scalar) -> np.ndarray:
    return row.values.to_numpy(zero_copy_only=False).astype(bool)


def _block_words(texts: pa.Array, held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct word hashes of a block, ascending, and how often each is in the texts learned from."""
    values, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for words in split_words(texts):
        hashes, own = np.unique(hash_words(words), return_inverse=True)
        values.append(hashes)
        counts.append(np.bincount(own, ~held[words.first : words.last][words.row], len(hashes)).astype(np.int64))
    distinct, place = np.unique(np.concatenate(values), return_inverse=True)
    return distinct, np.bincount(place, np.concatenate(counts), len(distinct)).astype(np.int64)


def _packed(counts: np.ndarray) -> bytes:
    """Counts are mostly small."""
    return pa.compress(counts.tobytes(), "zstd", asbytes=True)


def _unpacked(counts: pa.Scalar, size: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(counts.as_buffer(), 8 * size, "zstd"), np.int64)


def _asker(buckets: int) -> Callable:
    """A block's distinct words in ascending order, cut by bucket, with their counts in its training texts."""
    schema = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("words", pa.binary()), ("learned", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in released(batches):
            for block, held, sizes, data in zip(*(batch.column(c) for c in ("block", "held", "sizes", "data")), strict=True):
                words, learned = _block_words(_texts(sizes, data), _held(held))
                cuts = np.searchsorted((words >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32), np.arange(buckets + 1))
                full = np.flatnonzero(cuts[1:] > cuts[:-1])
                values = {"words": [words[cuts[k] : cuts[k + 1]].tobytes() for k in full], "learned": [_packed(learned[cuts[k] : cuts[k + 1]]) for k in full]}
                yield pa.RecordBatch.from_pydict({"block": [block.as_py()] * len(full), "bucket": full.astype(np.int32), **values}, schema=schema)

    return run


_BARS = 40
_COUNTED = "block long, bucket int, counts binary, size int, totals binary, words binary, often binary"


def _counter(table: pa.Table) -> pa.Table:
    """Corpus counts for each block, in its order; and one row with the bucket's totals: tokens, distinct words, words at each bar (``OWN`` doubled
    again and again), tokens and words of each class; and the words at the first bar with their counts."""
    asked = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("words")]
    learned = [_unpacked(x, len(words)) for x, words in zip(table.column("learned"), asked, strict=True)]
    distinct, place = np.unique(np.concatenate(asked), return_inverse=True)
    total = np.bincount(place, np.concatenate(learned), len(distinct)).astype(np.int64)
    per_block = np.split(total[place], np.cumsum([len(a) for a in asked])[:-1])
    known, own = total > 0, total >= OWN
    of = _class(distinct[known])
    bars = [(total >= OWN << k).sum() for k in range(_BARS)]
    totals = np.concatenate([[total.sum(), known.sum()], bars, np.bincount(of, total[known], CLASSES), np.bincount(of, minlength=CLASSES)]).astype(np.float64)
    rows = len(asked)
    values = {
        "block": [*table.column("block").to_pylist(), None],
        "bucket": [*table.column("bucket").to_pylist(), table.column("bucket")[0].as_py()],
        "counts": [*map(_packed, per_block), None],
        "size": [*map(len, per_block), None],
        "totals": [None] * rows + [totals.tobytes()],
        "words": [None] * rows + [distinct[own].tobytes()],
        "often": [None] * rows + [total[own].tobytes()],
    }
    return pa.Table.from_pydict(values, schema=pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("counts", pa.binary()), ("size", pa.int32()), *((c, pa.binary()) for c in ("totals", "words", "often"))]))


def _summed(table: pa.Table) -> pa.Table:
    return pa.table({"totals": pa.array([np.sum([np.frombuffer(x.as_buffer()) for x in table.column("totals")], axis=0).tobytes()], pa.binary())})


def _frequent(bar: int) -> Callable:
    schema = pa.schema([("words", pa.binary()), ("often", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {"words": [], "often": []}
            for words, often in zip(batch.column("words"), batch.column("often"), strict=True):
                counts = np.frombuffer(often.as_buffer(), np.int64)
                kept = counts >= bar
                out["words"].append(np.frombuffer(words.as_buffer(), np.uint64)[kept].tobytes())
                out["often"].append(counts[kept].tobytes())
            yield pa.RecordBatch.from_pydict(out, schema=schema)

    return run


class Corpus(NamedTuple):
    """Blocks of texts, the corpus counts of each block's words, and what symbols are made of."""

    blocks: DataFrame
    replies: DataFrame
    lexicon: Lexicon


def corpus(docs: DataFrame, *, id_col: str, text_col: str, folds: int, fold: int, block_bytes: int = BLOCK_BYTES, symbols: int = SYMBOLS) -> Corpus:
    """Blocks written, words counted, symbols chosen."""
    left_out = F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(folds)) == fold, F.lit(False))
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), left_out.alias("held_out"))
    fields = [("block", T.LongType()), ("ids", T.ArrayType(slim.schema["id"].dataType)), ("held", T.ArrayType(T.BooleanType())), ("sizes", T.ArrayType(T.LongType())), ("data", T.BinaryType())]
    schema = T.StructType([T.StructField(*f) for f in fields])
    blocks = written(slim.mapInArrow(_blocker(to_arrow_schema(schema), block_bytes), schema), "blocks")
    ends = blocks.select(F.sum(F.size(F.filter("held", lambda h: ~h)))).first()[0] or 0
    # About a distinct word for every hundred bytes of a block.
    size = blocks.select(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0
    buckets = max(1, -(-size // (100 * BUCKET_WORDS)))
    asked = blocks.select("block", "held", "sizes", "data").mapInArrow(_asker(buckets), "block long, bucket int, words binary, learned binary")
    replies = written(asked.groupBy("bucket").applyInArrow(_counter, _COUNTED), "counts")
    of_buckets = replies.where("block is null")
    parts = of_buckets.select("totals", F.pmod("bucket", F.lit(STRIPES)).alias("stripe")).groupBy("stripe").applyInArrow(_summed, "totals binary").collect()
    totals = np.sum([np.frombuffer(r[0]) for r in parts], axis=0) if parts else np.zeros(2 + _BARS + 2 * CLASSES)
    (tokens, distinct), bars, classes = totals[:2], totals[2 : 2 + _BARS], totals[2 + _BARS :].reshape(2, CLASSES)
    bar = OWN << next((k for k in range(_BARS) if bars[k] <= symbols), _BARS)
    chosen = of_buckets.select("words", "often").mapInArrow(_frequent(bar), "words binary, often binary").collect()
    words = np.concatenate([np.frombuffer(r[0], np.uint64) for r in chosen] or [np.zeros(0, np.uint64)])
    counts = np.concatenate([np.frombuffer(r[1], np.int64) for r in chosen] or [np.zeros(0, np.int64)])
    order = np.argsort(words)
    words, counts = words[order], counts[order]
    rest = classes[0] - np.bincount(_class(words), counts, CLASSES), classes[1] - np.bincount(_class(words), minlength=CLASSES)
    lexicon = Lexicon(words, counts, *rest, int(ends), int(tokens) + int(ends), int(distinct) + (ends > 0))
    return Corpus(blocks, replies.where("block is not null").select("block", "bucket", "counts", "size"), lexicon)


def noise(words: np.ndarray, states: int, seed: int = SEED) -> np.ndarray:
    """A positive weight for every word and state, by hash: what tells the states apart at first."""
    out = np.zeros((len(words), states))
    for k in range(states):
        one = mix(words + np.uint64(2 * (seed * states + k) + 1))
        for value in (one, mix(one ^ np.uint64(0x9E3779B97F4A7C15))):
            out[:, k] -= np.log(((value >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53))
    return out


def starting_model(lexicon: Lexicon, states: int = STATES) -> Hmm:
    """States that stay, and emit symbols by their counts, each state with noise of its own."""
    move = np.full((states, states), 0.1 / states) + 0.9 * np.eye(states)
    shared = mix(np.arange(CLASSES + 1, dtype=np.uint64) + np.uint64(0x2545F4914F6CDD1D))
    counts = np.concatenate([lexicon.counts, lexicon.class_tokens, [lexicon.ends]])
    weights = counts[:, None] * noise(np.concatenate([lexicon.words, shared]), states)
    return Hmm(np.full(states, 1 / states), move / move.sum(axis=1, keepdims=True), weights / np.maximum(weights.sum(axis=0), np.finfo(float).tiny))


def emissions(model: Hmm, lexicon: Lexicon) -> np.ndarray:
    """``B``, a row per symbol."""
    return (1 - BASE) * model.learned + BASE * lexicon.shares[:, None]


_LOOKUPS: dict[int, Lookup] = {}


def _lookup(words: np.ndarray) -> Lookup:
    """Built once per worker."""
    if id(words) not in _LOOKUPS:
        _LOOKUPS.clear()
        _LOOKUPS[id(words)] = Lookup(words)
    return _LOOKUPS[id(words)]


def _expecter(model: Hmm, words: Broadcast, emit: Broadcast) -> Callable:
    """Expected counts of a task's training texts: by stripes of the symbols that it met, and one row of the rest."""
    schema = pa.schema([("stripe", pa.int32()), ("symbols", pa.binary()), ("counts", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, look_up = emit.value, _lookup(words.value)
        counts = Counts(len(model.first), len(table))
        for batch in released(batches):
            for held, sizes, data in zip(*(batch.column(c) for c in ("held", "sizes", "data")), strict=True):
                texts = _texts(sizes, data).filter(pa.array(~_held(held)))
                for own in split_words(texts):
                    symbols, bounds = with_ends(own, look_up(hash_words(own)), len(table) - 1)
                    counts.add(model, table, symbols, bounds)
        met = np.flatnonzero(counts.symbols.any(axis=1))
        cuts = np.searchsorted(met % STRIPES, np.arange(STRIPES + 1), sorter=np.argsort(met % STRIPES, kind="stable"))
        met = met[np.argsort(met % STRIPES, kind="stable")]
        small = np.concatenate([counts.first, counts.move.ravel(), counts.total])
        full = np.flatnonzero(cuts[1:] > cuts[:-1])
        values = {
            "stripe": [-1, *full.tolist()],
            "symbols": [None, *(met[cuts[k] : cuts[k + 1]].astype(np.uint32).tobytes() for k in full)],
            "counts": [small.tobytes(), *(counts.symbols[met[cuts[k] : cuts[k + 1]]].astype(np.float32).tobytes() for k in full)],
        }
        yield pa.RecordBatch.from_pydict(values, schema=schema)

    return run


def _adder(states: int) -> Callable:
    """The sums of a stripe."""
    schema = pa.schema([("stripe", pa.int32()), ("symbols", pa.binary()), ("counts", pa.binary())])

    def run(table: pa.Table) -> pa.Table:
        stripe = table.column("stripe")[0].as_py()
        if stripe < 0:
            total = np.sum([np.frombuffer(x.as_buffer()) for x in table.column("counts")], axis=0)
            return pa.Table.from_pydict({"stripe": [-1], "symbols": [None], "counts": [total.tobytes()]}, schema=schema)
        symbols = np.concatenate([np.frombuffer(x.as_buffer(), np.uint32) for x in table.column("symbols")])
        counts = np.concatenate([np.frombuffer(x.as_buffer(), np.float32) for x in table.column("counts")]).reshape(-1, states)
        distinct, place = np.unique(symbols, return_inverse=True)
        added = np.stack([np.bincount(place, counts[:, k], len(distinct)) for k in range(states)], axis=1)
        return pa.Table.from_pydict({"stripe": [stripe], "symbols": [distinct.tobytes()], "counts": [added.tobytes()]}, schema=schema)

    return run


def baum_welch(found: Corpus, model: Hmm, rounds: int = ROUNDS) -> tuple[Hmm, list[float]]:
    """The model after ``rounds`` scans, and the mean log-likelihood of a symbol before each."""
    history: list[float] = []
    states, lexicon = len(model.first), found.lexicon
    spark = found.blocks.sparkSession.sparkContext
    words = spark.broadcast(lexicon.words)
    for _ in range(rounds if lexicon.ends else 0):
        emit = emissions(model, lexicon)
        shared = spark.broadcast(emit.astype(np.float32))
        expected = found.blocks.select("held", "sizes", "data").mapInArrow(_expecter(model, words, shared), "stripe int, symbols binary, counts binary")
        occupied, small = np.zeros_like(emit), None
        for row in expected.groupBy("stripe").applyInArrow(_adder(states), "stripe int, symbols binary, counts binary").collect():
            if row["stripe"] < 0:
                small = np.frombuffer(row["counts"])
            else:
                occupied[np.frombuffer(row["symbols"], np.uint32)] = np.frombuffer(row["counts"]).reshape(-1, states)
        shared.unpersist()
        first, move, total = small[:states] + SMOOTH, small[states:-2].reshape(states, states) + SMOOTH, small[-2:]
        history.append(float(total[0] / total[1]))
        # Occupations are due to what was learned, or to shares; only the former are learned from.
        gained = occupied * ((1 - BASE) * model.learned / emit)
        learned = gained / np.maximum(gained.sum(axis=0), np.finfo(float).tiny)
        model = Hmm(first / first.sum(), move / move.sum(axis=1, keepdims=True), learned)
    return model, history


def _scorer(model: Hmm, shared: Broadcast, schema: pa.Schema) -> Callable:
    """Scores of a block's texts; ``shared`` holds the lexicon and emissions."""

    def run(blocks: pa.Table, replies: pa.Table) -> pa.Table:
        release()
        if not len(blocks):
            return schema.empty_table()
        lexicon, emit = shared.value
        look_up = _lookup(lexicon.words)
        row = {c: blocks.column(c)[0] for c in blocks.column_names}
        held, texts = _held(row["held"]), _texts(row["sizes"], row["data"])
        distinct, _ = _block_words(texts, held)
        order = np.argsort(replies.column("bucket").to_numpy())
        answers, sizes = replies.column("counts"), replies.column("size").to_pylist()
        counts = np.concatenate([_unpacked(answers[int(k)], sizes[k]) for k in order] or [np.zeros(0, np.int64)])
        symbols = look_up(distinct)
        within = np.log(lexicon.within(distinct, counts, symbols))
        seen, floor = np.log10(counts + 1.0), np.log10(lexicon.tokens + lexicon.distinct + 1)
        out: dict[str, list] = {"n_tokens": [], "n_known": [], "base_score": [], "score": []}
        for words in split_words(texts):
            place, at = np.searchsorted(distinct, hash_words(words)), words.bounds()
            n = np.diff(at) + 1
            tokens, bounds = with_ends(words, symbols[place], len(emit) - 1)
            logs = edges(model, emit, tokens, stretches(bounds), words.rows).logs
            out["n_tokens"].append(n)
            out["n_known"].append(row_sums((counts[place] > 0).astype(np.int64), at) + int(lexicon.ends > 0))
            out["base_score"].append(row_sums(seen[place], at) + np.log10(lexicon.ends + 1) - floor * n)
            out["score"].append((logs + row_sums(within[place], at)) / np.log(10))
        columns = {c: np.concatenate(v) if v else np.zeros(0) for c, v in out.items()}
        return pa.Table.from_pydict({"id": row["ids"].values.cast(schema.field("id").type), "held_out": pa.array(held), **columns}, schema=schema)

    return run


def scores(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    folds: int = 7,
    fold: int = 2,
    rounds: int = ROUNDS,
    states: int = STATES,
    block_bytes: int = BLOCK_BYTES,
    symbols: int = SYMBOLS,
) -> DataFrame:
    """One row per document: ``id``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``."""
    found = corpus(docs, id_col=id_col, text_col=text_col, folds=folds, fold=fold, block_bytes=block_bytes, symbols=symbols)
    model, _ = baum_welch(found, starting_model(found.lexicon, states), rounds)
    fields = [T.StructField("id", found.blocks.schema["ids"].dataType.elementType), T.StructField("held_out", T.BooleanType()), *(T.StructField(c, T.LongType()) for c in ("n_tokens", "n_known"))]
    schema = T.StructType(fields + [T.StructField(c, T.DoubleType()) for c in ("base_score", "score")])
    shared = docs.sparkSession.sparkContext.broadcast((found.lexicon, emissions(model, found.lexicon).astype(np.float32)))
    scored = found.blocks.groupBy("block").cogroup(found.replies.groupBy("block")).applyInArrow(_scorer(model, shared, to_arrow_schema(schema)), schema)
    return scored.withColumn("train_tokens", F.lit(found.lexicon.tokens).cast("long")).select("id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
