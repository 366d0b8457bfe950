import hashlib
import random
import tempfile
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pytest

from corpusrules.llm import repeats as op
from corpusrules.llm.suffixes import ExternalSort, Scratch, doubled_ranks, repeated_windows, sorted_suffixes


def brute(texts, length):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + length] for r in raw for i in range(len(r) - length + 1))
    out = []
    for r in raw:
        gone = [False] * len(r)
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        rest = bytes(b for b, g in zip(r, gone, strict=True) if not g)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((len(r), sum(gone), spans, hashlib.sha256(rest).hexdigest()))
    return out


def corpus(seed, length):
    rng = random.Random(seed)
    letters = "abcde é"

    def some(n):
        return "".join(rng.choices(letters, k=n))

    passages = [some(length + rng.randint(-3, 60)) for _ in range(6)]
    texts = [some(rng.randint(0, 4 * length)) for _ in range(30)]
    for _ in range(40):
        p = rng.choice(passages)
        a = rng.randint(0, 10)
        texts.append(some(rng.randint(0, 2 * length)) + p[a:] + some(rng.randint(0, length)) + (rng.choice(passages) if rng.random() < 0.4 else ""))
    copy = some(3 * length)
    texts += [copy, copy, copy, copy[:length], copy[1 : length + 1], copy[: length - 1], "x" * (length + 50), "xy" * length, None, "", "a"]
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("seed,length", [(0, 200), (1, 40), (2, 12)])
def test_against_brute_force(docs, seed, length):
    texts = corpus(seed, length)
    got = {r["doc_id"]: tuple(r)[1:] for r in op.digest(op.without_repeats(docs(*texts), length=length)).collect()}
    assert [got[k] for k in range(len(texts))] == brute(texts, length)


def test_many_blocks_buckets_and_shards_with_little_memory(docs, monkeypatch):
    for name, value in (("BLOCK_BYTES", 500), ("BUCKET_BYTES", 3000), ("SHARD_BYTES", 4000), ("CHUNK", 256)):
        monkeypatch.setattr(op, name, value)
    texts = corpus(3, 40)
    got = {r["id"]: r for r in op.without_repeats(docs(*texts), length=40, memory=16, kept=True).collect()}
    expected = brute(texts, 40)
    assert [(got[k]["n_bytes"], got[k]["n_removed"], got[k]["n_spans"], got[k]["kept_sha256"]) for k in range(len(texts))] == expected
    for k, text in enumerate(texts):
        raw, kept, at = (text or "").encode(), b"", 0
        for s in got[k]["spans"]:
            kept += raw[at : s["start"]]
            at = s["end"]
        assert bytes(got[k]["kept"]) == kept + raw[at:]


def test_nothing_crosses_texts_and_long_texts(docs):
    half = "".join(random.Random(9).choices("abcdefgh", k=300))
    texts = [half[:150], half[150:], half, half[:150], "q" * 100_000]
    got = {r["doc_id"]: tuple(r)[1:] for r in op.digest(op.without_repeats(docs(*texts))).collect()}
    assert [got[k] for k in range(4)] == brute(texts[:4], 200)
    assert got[4][1:] == (100_000, 1, hashlib.sha256(b"").hexdigest())


def through_blocks(raw, length, gram, shards=2, lot=op.LOT_BYTES):
    """The steps by hand over two blocks: rows sent, and removed bytes of each text."""
    halves = [raw[: len(raw) // 2], raw[len(raw) // 2 :]]
    blocks = pa.table({"block": [0, 1], "sizes": [[len(r) for r in half] for half in halves], "data": [pa.compress(b"".join(half), "zstd", asbytes=True) for half in halves]})
    asked = pa.Table.from_batches(op._asker(1, length, gram)(blocks.to_batches()))
    answers = op._answers(asked)
    sent = pa.concat_tables(op._sender(shards, length, gram)(blocks.slice(k, 1), answers.filter(pc.equal(answers["block"], k))) for k in (0, 1))
    spans = pa.concat_tables(pa.Table.from_batches(op._sorter(length, 16, lot)(sent.filter(pc.equal(sent["shard"], k)).to_batches()), schema=pa.schema([("block", pa.int64()), ("spans", pa.binary())])) for k in range(shards))
    got = []
    for k, half in enumerate(halves):
        gone = np.zeros(sum(map(len, half)), bool)
        for x in spans.filter(pc.equal(spans["block"], k))["spans"]:
            for a, b in np.frombuffer(x.as_buffer(), np.int32).reshape(-1, 2):
                gone[a:b] = True
        got += [int(part.sum()) for part in np.split(gone, np.cumsum([len(r) for r in half])[:-1])]
    return sent, got


@pytest.mark.parametrize("lot", [op.LOT_BYTES, 1000])
def test_contents_travel_once(lot):
    """A row per block and shard; the bytes of a content come from one block only."""
    length, texts = 40, corpus(5, 40)
    raw = [(t or "").encode() for t in texts]
    sent, got = through_blocks(raw, length, 13, lot=lot)
    assert got == [removed for _, removed, _, _ in brute(texts, length)] and sum(got) > 0
    assert len(sent) <= 4
    copies = ["".join(random.Random(k).choices("abcdefgh", k=300)).encode() for k in range(8)]
    sent, got = through_blocks(copies + copies, 40, 13)
    assert got == [300] * 16
    rows = sent.to_pylist()
    assert {r["block"] for r in rows if r["size"]} == {0} and {r["block"] for r in rows} == {0, 1}
    assert all(len(r["windows"]) // 4 == len(r["digests"]) // op.DIGEST for r in rows)


@pytest.mark.parametrize("apart", [False, True])
def test_hashes_that_agree_stop_the_job(monkeypatch, apart):
    """Every content has the same hashes: bytes tell them apart, in a block or between two, and nothing is passed off as a repeat."""
    find = op.stretches
    monkeypatch.setattr(op, "stretches", lambda *args: find(*args)._replace(anchor=np.zeros(len(find(*args).start), np.uint64), content=np.zeros((len(find(*args).start), 2), np.uint64)))
    texts = ["".join(random.Random(k).choices("abcdefgh", k=40)).encode() for k in range(4)]
    with pytest.raises(RuntimeError, match="digests"):
        through_blocks(texts[:2] if apart else texts, 40, 13, 1)


def test_hot_anchors_are_dealt_by_their_neighbours(docs, monkeypatch):
    """A short passage in all texts, each time between other words: with it as an anchor and without, the same bytes go."""
    rng = random.Random(8)
    passage = "".join(rng.choices("abcdefgh", k=16))
    texts = ["".join(rng.choices("abcdefgh", k=60)) + passage + "".join(rng.choices("abcdefgh", k=60)) for _ in range(200)]
    texts += [t[20:120] for t in texts[:30]] + [texts[0], texts[1] + texts[2]]
    expected = brute(texts, 40)
    seen = []
    find = op.hot_anchors
    monkeypatch.setattr(op, "hot_anchors", lambda *args: seen.append(find(*args)) or seen[-1])
    for contents in (50, 10**9):
        monkeypatch.setattr(op, "HOT_CONTENTS", contents)
        got = {r["doc_id"]: tuple(r)[1:] for r in op.digest(op.without_repeats(docs(*texts), length=40, gram=13)).collect()}
        assert [got[k] for k in range(len(texts))] == expected
    assert len(seen[0]) and not len(seen[1])


def test_blocks_stay_where_they_are(docs):
    """Texts move once, when they become blocks; later steps shuffle what is found."""
    plan = op.without_repeats(docs(*corpus(6, 40)), length=40)._jdf.queryExecution().executedPlan().toString()
    exchanged = [line for line in plan.split("\n") if "Exchange" in line and "block" in line]
    assert len(exchanged) == 2 and all("hashpartitioning(block" in line for line in exchanged)


def test_merged_spans():
    bounds = np.array([0, 10, 10, 20])
    spans = np.array([[12, 15], [2, 6], [6, 10], [10, 11], [1, 3], [15, 16], [18, 20]], np.int32)
    assert op.merged(spans, bounds).tolist() == [[1, 10], [10, 11], [12, 16], [18, 20]]
    assert op.merged(spans[:0], bounds).tolist() == []


def test_edges(docs, rows):
    assert op.without_repeats(docs()).collect() == []
    twins = rows("doc_id string, text string, block int", (None, "z" * 200, 1), (None, "z" * 200, 1), ("a", None, 1), ("b", "", 1))
    got = sorted((str(r[0]), r[1], r[2], r[3]) for r in op.digest(op.without_repeats(twins)).collect())
    assert got == [("None", 200, 200, 1), ("None", 200, 200, 1), ("a", 0, 0, 0), ("b", 0, 0, 0)]


def _texts(rng):
    for trial in range(150):
        n, sigma = int(rng.integers(0, 70)), int(rng.choice([1, 2, 3, 300]))
        body = rng.integers(1, sigma + 1, n)
        if trial % 3 == 0 and n:
            body = np.tile(body[: max(1, n // 5)], 5)[:n]
        yield np.append(body, 0).astype(np.int64 if sigma > 100 else np.uint16)


@pytest.mark.parametrize("memory,keep", [(1, 0), (3, 0), (3, 5), (8, 4), (1000, 0), (1000, 500)])
def test_suffix_order_and_common_prefixes(memory, keep, tmp_path):
    """Small memory: runs of sorts and queues go to disk, and names that repeat are sorted by recursion."""
    rng = np.random.default_rng(1)
    for text in _texts(rng):
        most = int(rng.choice([1, 2, 5, 200]))
        with tempfile.TemporaryDirectory(dir=tmp_path) as folder:
            blocks = list(sorted_suffixes(text, Scratch(folder, keep), memory, most))
            assert not list(Path(folder).iterdir())
        values = text.tolist()
        order = sorted(range(len(values)), key=lambda i: values[i:])
        assert [int(p) for positions, _ in blocks for p in positions] == order
        common = [0]
        for a, b in zip(order, order[1:], strict=False):
            k = 0
            while k < most and values[a + k : a + k + 1] == values[b + k : b + k + 1]:
                k += 1
            common.append(k)
        assert [int(c) for _, commons in blocks for c in commons] == common


def test_blocks_stay_small(tmp_path):
    rng = np.random.default_rng(2)
    text = np.append(rng.integers(1, 5, 5000), 0).astype(np.uint16)
    with tempfile.TemporaryDirectory(dir=tmp_path) as folder:
        sizes = [len(p) for p, _ in sorted_suffixes(text, Scratch(folder), 100, 8)]
    assert sum(sizes) == 5001 and max(sizes) <= 101


def test_external_sort(tmp_path):
    rng = np.random.default_rng(3)
    kind = np.dtype([("key", np.uint64), ("star", np.int64)])
    for most in (1, 7, 10**6):
        sort = ExternalSort(Scratch(tmp_path / str(most)), kind, most)
        sort.scratch.folder.mkdir()
        keys = rng.integers(0, 50, 500).astype(np.uint64)
        for part in np.split(keys, [10, 11, 200]):
            records = np.zeros(len(part), kind)
            records["key"] = part
            sort.add(records)
        blocks = [b["key"] for b in sort.blocks()]
        assert np.concatenate(blocks).tolist() == sorted(keys.tolist())
        assert all(a[-1] < b[0] for a, b in zip(blocks, blocks[1:], strict=False))


def test_windows(tmp_path):
    text = np.array([2, 3, 4, 1, 3, 4, 1, 2, 3, 4, 1, 0], np.uint16)
    with tempfile.TemporaryDirectory(dir=tmp_path) as folder:
        assert np.flatnonzero(repeated_windows(text, Scratch(folder), 2, 4)).tolist() == [0, 1, 2, 4, 5, 7, 8, 9]


def test_doubling_sorts_what_is_still_shared(monkeypatch):
    """Ranks are those of plain sorting; suffixes that stand alone are not sorted again."""
    rng = np.random.default_rng(3)
    for size, letters in ((1, 1), (2, 1), (60, 1), (200, 2), (300, 40)):
        text = np.append(np.tile(rng.integers(1, letters + 1, size), 2), 0)
        order = sorted(range(len(text)), key=lambda k: text[k:].tolist())
        assert doubled_ranks(text)[order].tolist() == list(range(len(text)))
    sorted_at_a_time = []
    plain = np.argsort
    monkeypatch.setattr(np, "argsort", lambda keys, *a, **k: sorted_at_a_time.append(len(keys)) or plain(keys, *a, **k))
    text = np.concatenate([np.arange(1, 5001), np.ones(300, np.int64), [0]])
    assert sorted(doubled_ranks(text).tolist()) == list(range(len(text)))
    assert len(sorted_at_a_time) > 5 and max(sorted_at_a_time) < 400
