import hashlib
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusrules.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars int, tree string, place long, digest string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", 3, "d") for r in rows], SCHEMA)


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row, lower=False):
    doc_id, text, lang, source, n_chars = row
    if lower and text is not None:
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def climb(nodes):
    """The root of nodes, and each node's path: runs with its place in them."""
    paths = [[] for _ in nodes]
    at = list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[k : k + 16] for k in range(0, len(nodes), 16)]
        for k, i in enumerate(at):
            paths[k].append((runs[i // 16], i % 16))
            at[k] = i // 16
        nodes = [h("".join(r)) for r in runs]
    return nodes[0], paths


def brute(rows):
    groups = {}
    for row in rows:
        groups.setdefault(row[3], []).append(row)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    climbed = {}
    for source in order:
        groups[source].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        climbed[source] = climb([leaf_of(r) for r in groups[source]])
    root, tops = climb([climbed[s][0] for s in order])
    out = []
    for source, top in zip(order, tops, strict=True):
        for row, path in zip(groups[source], climbed[source][1], strict=True):
            hit = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0
            value = leaf_of(row, lower=hit)
            proof = ""
            for run, at in path + top:
                proof += "".join(run[:at] + run[at + 1 :])
                value = h("".join(run[:at] + [value] + run[at + 1 :]))
            out.append((row[0], leaf_of(row), climbed[source][0], root, h(proof), value, value == root))
    return out


def rows_of(found):
    return [tuple(r[c] for c in ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")) for r in found.collect()]


@settings(deadline=None, max_examples=60)
@given(st.integers(1, merkle.BLOCK))
def test_addresses_fill_the_array_once(leaves):
    for height in range(merkle.height_of(leaves), merkle.HEIGHT + 2):
        counts = merkle.counts_of(leaves, height)
        every = np.concatenate([merkle.addresses(counts, level, np.arange(n)) for level, n in enumerate(counts)])
        assert np.array_equal(np.sort(every), np.arange(sum(counts)))
        assert merkle.addresses(counts, height, np.zeros(1, np.int64))[0] == 0


def test_parts_are_stored_together():
    """Four levels are split in the middle: the root and its children, then each child's children with their own."""
    counts = merkle.counts_of(4096, 3)
    part = merkle.addresses(counts, 1, np.array([17]))
    leaves = merkle.addresses(counts, 0, np.arange(17 * 16, 18 * 16))
    assert list(leaves) == [part[0] + 1 + k for k in range(16)]
    assert list(merkle.addresses(counts, 2, np.arange(16))) == list(range(1, 17))


@pytest.mark.parametrize("leaves", [1, 2, 16, 17, 255, 256, 257, 4095, 4096])
def test_block_against_plain_lists(leaves):
    digests = [hashlib.sha256(str(k).encode()).digest() for k in range(leaves)]
    block = merkle.Block.build(np.frombuffer(b"".join(digests), np.uint8).reshape(-1, 32), merkle.height_of(leaves))
    root, paths = climb([d.hex() for d in digests])
    assert block.root.hex() == root
    for k in {0, leaves // 2, leaves - 1}:
        path = [(block.run(level, k // 16**level), k // 16**level % 16) for level in range(block.height)]
        assert path == [("".join(run), at) for run, at in paths[k]]
        assert merkle.folded(digests[k].hex(), path) == root


def test_against_brute_force(spark):
    rows = [(k, f"Text {k}", "en", f"s{k % 3}", k) for k in range(60)]
    rows += [(100 + k, f"T{k}", None, "ß", 1) for k in range(17)] + [(200 + k, f"T{k}", "de", "ss", 1) for k in range(16)]
    rows += [(5, None, None, None, None), (6, "", "", "", 0), (None, "A", "en", "s0", 1), (None, None, "en", "s0", 1)]
    rows += [(7, "Dup", "en", "s1", 3)] * 2 + [(7, "Other Dup", "en", "s1", 3), (300, "Ä" * 200_000 + "Z", "de", "s2", 200_001)]
    found = merkle.digest(frame(spark, rows).repartition(3))
    assert Counter(rows_of(found)) == Counter(brute(rows))
    # Tampering shows wherever it changed something, and nowhere else.
    assert {r["verified"] for r in found.collect()} == {True, False}


def test_several_tiers_and_many_sources(spark):
    rows = [(k, f"T{k}", "en", "hot", 1) for k in range(merkle.BLOCK * 2 + 1)] + [(k, "Same", "en", f"s{k}", 1) for k in range(merkle.BLOCK + 7)]
    found = merkle.digest(frame(spark, rows))
    assert Counter(rows_of(found)) == Counter(brute(rows))


def test_one_row_and_none(spark):
    (only,) = rows_of(merkle.digest(frame(spark, [(1, "x", "en", "s", 1)])))
    assert only[1] == only[2] == only[3] and only[4] == h("")
    assert rows_of(merkle.digest(frame(spark, []))) == []


def test_paths_and_nodes_are_kept(spark):
    rows = [(k, f"Text {k}", "en", f"s{k % 2}", k) for k in range(40)]
    made = merkle.manifest(frame(spark, rows))
    for r in merkle.proofs(made, paths=True).collect():
        path = [(step["run"], step["at"]) for step in r["path"]]
        assert merkle.folded(r["leaf"], path) == made.root == r["root"] and r["verified"]
        assert merkle.folded(h("other"), path) != made.root
    (block,) = made.tiers[0].where("tree = 's1'").collect()
    assert len(block["nodes"]) == 32 * (20 + 2 + 1) and block["nodes"][:32] == block["root"]
