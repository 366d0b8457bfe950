"""External induced suffix sorting with common prefixes, for texts far larger than memory.

A level sorts the suffixes of one text of integers that ends with a 0 occurring nowhere else:

1. A backward scan finds the types: S suffixes are smaller than the next one, L suffixes larger.  *Stars* are S suffixes
   after an L suffix.
2. The substrings from star to star are sorted, a few characters a round, by an external merge sort, and named by rank.
3. If names repeat, the text of names is sorted by recursion: another level, or prefix doubling once it fits into memory.
4. From the ordered stars, a priority queue induces all L suffixes, smallest first, and from those another induces all S
   suffixes, largest first.  The queues hold tuples (character, order, position, common): a suffix enters when its successor
   leaves, and ``common`` is how much the successor has in common with that of the tuple before it under the same
   character.  A tuple that leaves thus knows the common prefix with its neighbour: ``common + 1``.

Queues, sort runs, types, stars, ranks and sorted suffixes are files in one scratch folder of the caller, each removed as soon as
the next step has it; arrays in memory have about ``memory`` entries, however long the text.  What has no more entries than
the folder's ``keep`` stays in memory instead, so short texts leave no files.  Tuples are handled in blocks: all tuples of a
character that are there at once.  Common prefixes are counted up to ``most``.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from pathlib import Path

import numpy as np

MEMORY = 1 << 22


class Scratch:
    """Files of one folder, named in turn; arrays and spools of up to ``keep`` entries are kept in memory."""

    def __init__(self, folder: str | Path, keep: int = 0):
        self.folder, self.keep, self.names = Path(folder), keep, itertools.count()

    def array(self, kind, size: int) -> np.ndarray:
        return np.memmap(self.file(), kind, "w+", shape=(size,)) if size > self.keep else np.zeros(size, kind)

    def drop(self, array: np.ndarray) -> None:
        """The array's file, if it has one, goes with its last reader."""
        if isinstance(array, np.memmap) and array.filename:
            Path(array.filename).unlink(missing_ok=True)

    def file(self) -> Path:
        return self.folder / f"{next(self.names)}"


class Spool:
    """Blocks of records appended under a key, in memory up to the folder's ``keep`` and then in a file; read back per key,
    forwards or backwards, in bounded blocks."""

    def __init__(self, scratch: Scratch, kind: np.dtype, most: int):
        self.scratch, self.kind, self.most = scratch, np.dtype(kind), most
        self.path: Path | None = None
        self.held: dict[int, np.ndarray] = {}
        self.parts: dict[int, list[tuple[int, int]]] = {}
        self.size = 0

    def add(self, key: int, records: np.ndarray) -> None:
        if not len(records):
            return
        if self.path is None and self.size + len(records) > self.scratch.keep:
            self.path = self.scratch.file()
            self.out = open(self.path, "wb")
            for part in self.held.values():
                self.out.write(part.tobytes())
            self.held = {}
        if self.path is None:
            self.held[self.size] = np.array(records)
        else:
            self.out.write(records.tobytes())
        self.parts.setdefault(key, []).append((self.size, len(records)))
        self.size += len(records)

    def read(self, key: int, backwards: bool = False) -> Iterator[np.ndarray]:
        parts = self.parts.get(key, [])
        for start, count in reversed(parts) if backwards else parts:
            cuts = range(0, count, self.most)
            for cut in reversed(cuts) if backwards else cuts:
                wide = min(self.most, count - cut)
                if start in self.held:
                    block = self.held[start][cut : cut + wide].copy()
                else:
                    self.out.flush()
                    block = np.fromfile(self.path, self.kind, wide, offset=(start + cut) * self.kind.itemsize)
                yield block[::-1] if backwards else block

    def close(self) -> None:
        self.held = {}
        if self.path is not None:
            self.out.close()
            self.path.unlink()


_TUPLE = np.dtype([("position", np.int64), ("common", np.int32)])


class DiskQueue:
    """Priority queue of suffix tuples whose order is (character, time of entry).

    A successor's rank grows with time, so tuples of one character leave in the order they came.  Tuples in memory beyond
    ``most`` are written out as one run, ordered by character; a character's tuples are then a stretch of each run.
    """

    def __init__(self, scratch: Scratch, most: int):
        self.scratch, self.most = scratch, most
        self.held: dict[int, list[np.ndarray]] = {}
        self.count = 0
        self.runs: list[Spool] = []
        self.spilled: dict[int, list[Spool]] = {}

    def push(self, chars: np.ndarray, tuples: np.ndarray) -> None:
        """Tuples in the order of their ranks."""
        if not len(tuples):
            return
        order = np.argsort(chars, kind="stable")
        chars, tuples = chars[order], tuples[order]
        starts = np.flatnonzero(np.concatenate([[True], chars[1:] != chars[:-1]]))
        for char, part in zip(chars[starts].tolist(), np.split(tuples, starts[1:]), strict=True):
            self.held.setdefault(char, []).append(part)
        self.count += len(tuples)
        if self.count > self.most:
            self.spill()

    def spill(self) -> None:
        run = Spool(self.scratch, _TUPLE, self.most)
        for char in sorted(self.held):
            for part in self.held[char]:
                run.add(char, part)
            self.spilled.setdefault(char, []).append(run)
        self.runs.append(run)
        self.held, self.count = {}, 0

    def pop(self, char: int) -> Iterator[np.ndarray]:
        """Blocks of all tuples that the character has now; what enters meanwhile is for the next call."""
        runs, parts = self.spilled.pop(char, []), self.held.pop(char, [])
        self.count -= sum(map(len, parts))
        for run in runs:
            yield from run.read(char)
        if parts:
            yield np.concatenate(parts)

    def close(self) -> None:
        for run in self.runs:
            run.close()


class ExternalSort:
    """Records by their field ``key`` (uint64): sorted runs on disk, merged block by block."""

    def __init__(self, scratch: Scratch, kind: np.dtype, most: int):
        self.scratch, self.kind, self.most = scratch, kind, most
        self.parts: list[np.ndarray] = []
        self.count = 0
        self.runs: list[Spool] = []

    def add(self, records: np.ndarray) -> None:
        self.parts.append(records)
        self.count += len(records)
        if self.count > self.most:
            self._spill()

    def _sorted(self) -> np.ndarray:
        records = np.concatenate(self.parts) if self.parts else np.zeros(0, self.kind)
        self.parts, self.count = [], 0
        return records[np.argsort(records["key"], kind="stable")]

    def _spill(self) -> None:
        run = Spool(self.scratch, self.kind, self.most)
        run.add(0, self._sorted())
        self.runs.append(run)

    def blocks(self) -> Iterator[np.ndarray]:
        """All records in order; equal keys are never in two blocks."""
        if not self.runs:
            if self.count:
                yield self._sorted()
            return
        if self.count:
            self._spill()
        wide = max(1, self.most // len(self.runs))
        for run in self.runs:
            run.most = wide
        sources = [run.read(0) for run in self.runs]
        heads: list[np.ndarray | None] = [next(s, None) for s in sources]
        while any(h is not None for h in heads):
            # Up to the least of the last keys held, everything is in memory; the last key itself may go on in its run.
            cut = min(h["key"][-1] for h in heads if h is not None)
            taken = []
            for k, head in enumerate(heads):
                while head is not None:
                    n = int(np.searchsorted(head["key"], cut, "right"))
                    taken.append(head[:n])
                    if n < len(head):
                        heads[k] = head[n:]
                        break
                    head = heads[k] = next(sources[k], None)
            block = np.concatenate(taken)
            yield block[np.argsort(block["key"], kind="stable")]
        for run in self.runs:
            run.close()


def suffix_types(text: np.ndarray, scratch: Scratch, memory: int) -> np.ndarray:
    """1 for S suffixes, 0 for L, by one scan from the end."""
    n = len(text)
    out = scratch.array(np.uint8, n)
    out[n - 1] = 1
    after = n - 1
    while after > 0:
        start = max(0, after - memory)
        here = np.asarray(text[start : after + 1])
        differs, rises = here[:-1] != here[1:], here[:-1] < here[1:]
        places = np.where(differs, np.arange(after - start), after - start)
        decided = np.minimum.accumulate(places[::-1])[::-1]
        out[start:after] = np.append(rises, out[after])[decided]
        after = start
    return out


def star_positions(types: np.ndarray, scratch: Scratch, memory: int) -> np.ndarray:
    parts = Spool(scratch, np.int64, memory)
    for start in range(1, len(types), memory):
        here = np.asarray(types[start - 1 : min(len(types), start + memory)])
        parts.add(0, np.flatnonzero(here[1:] > here[:-1]) + start)
    out, at = scratch.array(np.int64, parts.size), 0
    for block in parts.read(0):
        out[at : at + len(block)] = block
        at += len(block)
    parts.close()
    return out


_RECORD = np.dtype([("key", np.uint64), ("star", np.int64)])


def star_ranks(text: np.ndarray, types: np.ndarray, stars: np.ndarray, scratch: Scratch, memory: int) -> tuple[np.ndarray, bool]:
    """Each star's rank by its substring (equal ones share the least), and whether all differ.

    A round orders what is still open by (rank so far, next characters with their types); ranks take 32 bits of a key.
    """
    count = len(stars)
    if count >= 1 << 32:
        raise ValueError("a level holds fewer than 2**32 stars")
    ranks = scratch.array(np.int64, count)
    small = int(text.max()) < 1 << 9
    step, bits = (3, 10) if small else (1, 32)
    still = Spool(scratch, np.int64, memory)
    for start in range(0, count, memory):
        still.add(0, np.arange(start, min(count, start + memory)))
    offset, unique = 0, True
    last = len(text) - 1
    while still.size:
        sort = ExternalSort(scratch, _RECORD, memory)
        for star in still.read(0):
            key = ranks[star].astype(np.uint64) << np.uint64(32)
            begin, end = np.asarray(stars[star]) + offset, np.asarray(stars[np.minimum(star + 1, count - 1)])
            for k in range(step):
                at = begin + k
                outside = at > end
                np.minimum(at, last, out=at)
                part = np.asarray(text[at]).astype(np.uint64)
                part <<= np.uint64(1)
                part |= types[at]
                part[outside] = 0
                part <<= np.uint64(bits * (step - 1 - k))
                key |= part
            records = np.empty(len(star), _RECORD)
            records["key"], records["star"] = key, star
            sort.add(records)
        still.close()
        still = Spool(scratch, np.int64, memory)
        group, used = -1, 0
        for block in sort.blocks():
            keys, star = block["key"], block["star"]
            starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            sizes = np.diff(np.append(starts, len(keys)))
            old = (keys[starts] >> np.uint64(32)).astype(np.int64)
            # Places within a group go on over blocks; a group begins at its rank.
            before = np.cumsum(sizes) - sizes
            first = np.concatenate([[True], old[1:] != old[:-1]])
            begin = np.maximum.accumulate(np.where(first, before, 0))
            shift = np.where(old == group, used, 0)
            new = old + before - begin + shift
            group, used = int(old[-1]), int(new[-1] + sizes[-1] - old[-1])
            ranks[star] = np.repeat(new, sizes)
            several = np.repeat(sizes > 1, sizes)
            if several.any():
                own = star[several]
                ended = np.asarray(stars[own]) + offset + step > np.asarray(stars[np.minimum(own + 1, count - 1)])
                unique &= not ended.any()
                if (~ended).any():
                    still.add(0, own[~ended])
        offset += step
    still.close()
    return ranks, unique


def doubled_ranks(names: np.ndarray) -> np.ndarray:
    """Ranks of all suffixes of a text in memory, by prefix doubling; the last character is the least and single.

    A suffix has the place where its group begins, and is sorted only while others share it.
    """
    inverse, counts = np.unique(np.asarray(names), return_inverse=True, return_counts=True)[1:]
    n = len(inverse)
    ranks = (np.cumsum(counts) - counts)[inverse].astype(np.int64)
    still = np.flatnonzero(counts[inverse] > 1)
    width = 1
    while len(still):
        ahead = still + width
        keys = ranks[still] * (n + 1) + np.where(ahead < n, ranks[np.minimum(ahead, n - 1)] + 1, 0)
        order = np.argsort(keys)
        keys, still = keys[order], still[order]
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        sizes = np.diff(np.append(starts, len(keys)))
        old = keys[starts] // (n + 1)
        begin = np.maximum.accumulate(np.where(np.concatenate([[True], old[1:] != old[:-1]]), starts, 0))
        ranks[still] = np.repeat(old + starts - begin, sizes)
        still = still[np.repeat(sizes > 1, sizes)]
        width *= 2
    return ranks


def star_order(text: np.ndarray, types: np.ndarray, stars: np.ndarray, scratch: Scratch, memory: int) -> np.ndarray:
    """Positions of the stars, their suffixes ascending."""
    ranks, unique = star_ranks(text, types, stars, scratch, memory)
    count = len(stars)
    if not unique:
        if count <= memory:
            names, ranks = ranks, doubled_ranks(ranks)
            scratch.drop(names)
        else:
            order = scratch.array(np.int64, count)
            at = 0
            for positions, _ in sorted_suffixes(ranks, scratch, memory, 0):
                order[at : at + len(positions)] = positions
                at += len(positions)
            scratch.drop(ranks)
            ranks = scratch.array(np.int64, count)
            for start in range(0, count, memory):
                ranks[order[start : start + memory]] = np.arange(start, min(count, start + memory))
            scratch.drop(order)
    out = scratch.array(np.int64, count)
    for start in range(0, count, memory):
        out[ranks[start : start + memory]] = stars[start : start + memory]
    scratch.drop(ranks)
    return out


def common_prefixes(text: np.ndarray, first: np.ndarray, second: np.ndarray, most: int) -> np.ndarray:
    """How many characters two suffixes share, up to ``most``, four at a time."""
    shared = np.zeros(len(first), np.int32)
    live, last = np.arange(len(first)), len(text) - 1
    while len(live):
        same = np.ones(len(live), dtype=bool)
        for _ in range(4):
            a, b = np.minimum(first[live] + shared[live], last), np.minimum(second[live] + shared[live], last)
            same &= (text[a] == text[b]) & (a != b)
            shared[live] += same
        live = live[same & (shared[live] < most)]
    return np.minimum(shared, most)


class _Inducer:
    """One direction of induction: visits suffixes in order and enters their predecessors."""

    def __init__(self, text: np.ndarray, scratch: Scratch, memory: int, most: int, chars: int):
        self.text, self.most = text, most
        self.queue = DiskQueue(scratch, memory)
        #: Common prefix of the suffix visited last with the one whose predecessor last entered under each character.
        self.since = np.full(chars, most, np.int32) if most else None

    def visit(self, positions: np.ndarray, common: np.ndarray, char: int, wanted) -> None:
        """``common[k]``: with the suffix visited before; ``wanted(previous characters, char)`` says which predecessors are of the type."""
        before = positions - 1
        chars = np.asarray(self.text[np.maximum(before, 0)]).astype(np.int64)
        enters = np.flatnonzero((before >= 0) & wanted(chars, char))
        tuples = np.zeros(len(enters), _TUPLE)
        tuples["position"] = before[enters]
        if self.most:
            tuples["common"] = self._commons(common.astype(np.int32), enters, chars[enters])
        self.queue.push(chars[enters], tuples)

    def _commons(self, common: np.ndarray, enters: np.ndarray, chars: np.ndarray) -> np.ndarray:
        """Least common prefix between the visits of one suffix and of the last one entered under the same character."""
        order = np.argsort(chars, kind="stable")
        at, char = enters[order], chars[order]
        first = np.concatenate([[True], char[1:] != char[:-1]]) if len(at) else np.zeros(0, dtype=bool)
        begin = np.where(first, 0, np.concatenate([[0], at[:-1] + 1])) if len(at) else at
        padded = np.append(common, np.int32(self.most))
        found = np.zeros(len(at), np.int32)
        if len(at):
            found = np.minimum.reduceat(padded, np.stack([begin, at + 1], axis=1).ravel())[::2]
            found = np.where(first, np.minimum(found, self.since[char]), found)
        rest = np.minimum.accumulate(padded[::-1])[::-1]
        np.minimum(self.since, rest[0], out=self.since)
        if len(at):
            ends = np.append(first[1:], True)
            self.since[char[ends]] = rest[at[ends] + 1]
        out = np.empty(len(at), np.int32)
        out[order] = found
        return out


def sorted_suffixes(text: np.ndarray, scratch: Scratch, memory: int = MEMORY, most: int = 0) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All suffixes in order as blocks (positions, common prefix with the suffix before, up to ``most``).

    ``text`` is an integer array, possibly on disk, whose last value is 0, single and least.
    """
    chars = int(text.max()) + 1
    types = suffix_types(text, scratch, memory)
    stars = star_positions(types, scratch, memory)
    kind = np.dtype([("position", np.int64), ("common", np.int32)])
    if not len(stars):  # the text is its end, or falls all the way to it
        stars = np.array([len(text) - 1])
    order = star_order(text, types, stars, scratch, memory) if len(stars) > 1 else stars
    scratch.drop(types)
    if order is not stars:
        scratch.drop(stars)
    del types, stars
    seeds = Spool(scratch, kind, memory)
    for start in range(0, len(order), memory):
        here = np.asarray(order[start : start + memory])
        block = np.zeros(len(here), kind)
        block["position"] = here
        if most:
            earlier = np.append(order[start - 1] if start else here[0], here[:-1])
            block["common"] = common_prefixes(text, earlier, here, most)
            if not start:
                block["common"][0] = 0
        own = np.asarray(text[here])
        cuts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        for char, part in zip(own[cuts].tolist(), np.split(block, cuts[1:]), strict=True):
            seeds.add(int(char), part)

    scratch.drop(order)
    del order

    def run_of(position: int, char: int) -> int:
        length = 0
        while length < max(most, 1) and text[position + length] == char:
            length += 1
        return length

    falling, rising = Spool(scratch, kind, memory), Spool(scratch, kind, memory)
    waves = {}  # how often the largest L suffix of a character begins with it
    up = _Inducer(text, scratch, memory, most, chars)
    for char in range(chars):
        wave = 0
        while char in up.queue.held or char in up.queue.spilled:
            for block in up.queue.pop(char):
                block["common"] = np.minimum(block["common"] + 1, most)
                if not wave:
                    block["common"][0] = 0
                    wave = 1
                falling.add(char, block)
                up.visit(block["position"], block["common"], char, np.greater_equal)
            waves[char] = waves.get(char, 0) + 1
        started = bool(wave)
        begin = True
        for block in seeds.read(char):
            if begin:
                block["common"][0] = min(waves[char], run_of(int(block["position"][0]), char)) if started else 0
                begin = False
            up.visit(block["position"], block["common"], char, np.greater_equal)
    up.queue.close()
    seeds.close()

    down = _Inducer(text, scratch, memory, most, chars)
    joints = {}  # common prefix of the largest L and the least S suffix of a character
    for char in range(chars - 1, -1, -1):
        rounds = 0
        while char in down.queue.held or char in down.queue.spilled:
            for block in down.queue.pop(char):
                block["common"] = np.minimum(block["common"] + 1, most)
                if char not in rising.parts:
                    block["common"][0] = 0
                rising.add(char, block)
                down.visit(block["position"], block["common"], char, np.less_equal)
            rounds += 1
        joints[char] = min(rounds, waves.get(char, 0), most)
        carried = joints[char]
        for block in falling.read(char, backwards=True):
            # Backwards, a suffix's common prefix is that of the one visited before it.
            common = np.append(carried, block["common"][:-1])
            carried = block["common"][-1]
            down.visit(block["position"], common, char, np.less)
    down.queue.close()

    yield np.array([len(text) - 1]), np.zeros(1, np.int32)
    for char in range(1, chars):
        for block in falling.read(char):
            yield block["position"], block["common"]
        carried = joints[char]
        for block in rising.read(char, backwards=True):
            common = np.append(carried, block["common"][:-1])
            carried = block["common"][-1]
            yield block["position"], common
    falling.close()
    rising.close()


def repeated_windows(text: np.ndarray, scratch: Scratch, length: int, memory: int = MEMORY) -> np.ndarray:
    """For each position, whether the ``length`` characters from it also begin somewhere else (over separators too)."""
    out = scratch.array(np.bool_, len(text))
    last = -1
    for positions, common in sorted_suffixes(text, scratch, memory, length):
        again = common >= length
        out[positions[again]] = True
        previous = np.append(last, positions[:-1])[again]
        out[previous] = True
        last = positions[-1]
    return out
