"""N-gram Jaccard join, size-aware: fixed-size subsets for small sets, inverted lists for large ones.

A document's set is its distinct ``WIDTH``-word shingles (64-bit hashes).  Equal sets are one *node*.  The join is exact
over nodes; nothing is capped or sampled, and copies are never expanded into pairs.

1. ``describe``: one scan gives each document its node and set size, and the shingles that are frequent within a task's
   batch.  Those that make up 0.5 % of all sets or more (``heavy`` shingles; at most ``200 x`` the mean set size of them,
   also checked) are broadcast.
2. ``shared_sets``: shingles go to buckets by hash, and come back to their nodes with their document frequency when another
   node has them too; both ways, a row holds all that one block or bucket has for the same part of the nodes.  A heavy shingle does not
   travel: it goes back to its node at once, and is last in the order of frequency.  A node with less than 80 % of its set shared
   cannot link and is dropped.
3. Small sets (up to a boundary found by comparing the cost of both ways over the histogram of sizes) list every subset
   of the size that a link needs; sharing one *is* a link.
4. Pairs with a large set come from inverted lists of the rarest shingles: a set that misses at most ``n - ceil(0.8 n)``
   shingles shares one of its ``n - ceil(0.8 n) + 1`` rarest.  Each list first links its members to its most typical one;
   components are formed; then all pairs of a list that are still in different components are compared: every member outside the
   list's largest component meets those of its own band of sizes and of the bands beside it.

A pair is compared by its exact overlap: ``100 * both >= 80 * either``.

Null and empty texts have an empty set and link with nothing; fewer than five words are one shingle; repeated rows and ids
keep their rows; an id that is null never is a component's smallest.  Other columns are not read.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from hashlib import blake2b
from itertools import combinations
from math import comb, log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from corpusrules.llm.components import components
from corpusrules.llm.lookup import looked_up, small_side
from corpusrules.llm.storage import free_name, written
from corpusrules.llm.words import hash_words, mix, release, released, row_sums, shingle_sets, split_words

WIDTH = 5
#: Links need 100 * intersection >= 80 * union; the ratio in lowest terms.
NEED, OF = 4, 5
HEAVY_SHARE, HEAVY_LEAST, HEAVY_MOST = 200, 64, 1_000_000
#: Stands for the frequency of heavy shingles.
HEAVY_FREQUENCY = 1 << 20
BUCKET_SHINGLES = 1_000_000
SMALL_MOST = 24
#: Sizes of one band; linked sets differ by 1.25 at most, so their bands are equal or neighbours.
BAND = 1.26


def overlap_needed(n: int, m: int) -> int:
    """Smallest intersection of linked sets of ``n`` and ``m``: both >= NEED / (NEED + OF) * (n + m)."""
    return -(-NEED * (n + m) // (NEED + OF))


def _floor_needed(n):
    """Overlap that any link of a set of ``n`` needs (numpy or int)."""
    return -(-NEED * n // OF)


def _batch_sets(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Set size and node of each row (0 and 0 without words), and all shingles in row order."""
    sizes, nodes, shingles = [], [], []
    for words in split_words(texts):
        values, bounds = shingle_sets(words, hash_words(words), width)
        n = np.diff(bounds)
        one = row_sums(mix(values ^ np.uint64(0x5851F42D4C957F2D)), bounds)
        two = row_sums(mix(values + np.uint64(0x14057B7EF767814F)), bounds)
        sizes.append(n)
        nodes.append(mix(one + mix(two + n.astype(np.uint64))).view(np.int64))
        shingles.append(values)
    if not sizes:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(sizes), np.concatenate(nodes), np.concatenate(shingles)


def _distinct_sets(sizes: np.ndarray, nodes: np.ndarray, shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same without empty sets and with each node once."""
    _, first = np.unique(nodes, return_index=True)
    keep = np.zeros(len(nodes), dtype=bool)
    keep[first] = True
    keep &= sizes > 0
    return sizes[keep], nodes[keep], shingles[np.repeat(keep, sizes)]


def _describer(width: int, schema: pa.Schema) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in released(batches):
            sizes, nodes, shingles = _batch_sets(batch.column("text"), width)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(sizes), pa.array(nodes, mask=sizes == 0), pa.nulls(len(batch), pa.int64()), pa.nulls(len(batch), pa.int64())], schema=schema
            )
            kept, _, own = _distinct_sets(sizes, nodes, shingles)
            own.sort()
            starts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else np.zeros(0, np.int64)
            counts = np.diff(np.append(starts, len(own)))
            often = counts >= max(8, len(kept) // HEAVY_SHARE)
            if often.any():
                tokens = own[starts[often]].view(np.int64)
                none = len(tokens)
                yield pa.RecordBatch.from_arrays(
                    [pa.nulls(none, schema.field("id").type), pa.nulls(none, pa.int64()), pa.nulls(none, pa.int64()), pa.array(tokens), pa.array(counts[often].astype(np.int64))], schema=schema
                )

    return run


def describe(docs: DataFrame, id_col: str, text_col: str, width: int = WIDTH) -> tuple[DataFrame, DataFrame]:
    """Documents (``id``, ``n``, ``node``; node null for empty sets) and frequent shingles (``token``, ``count``)."""
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    fields = T.StructType([T.StructField("id", slim.schema["id"].dataType)] + [T.StructField(c, T.LongType()) for c in ("n", "node", "token", "count")])
    rows = written(slim.mapInArrow(_describer(width, to_arrow_schema(fields)), fields), "sets")
    return rows.where("n is not null").select("id", "n", "node"), rows.where("token is not null").select("token", "count")


def _mapper(width: int, buckets: int, heavy: np.ndarray) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in released(batches):
            sizes, nodes, shingles = _distinct_sets(*_batch_sets(batch.column("text"), width))
            if not len(shingles):
                continue
            owner = np.repeat(np.arange(len(nodes), dtype=np.int32), sizes)
            bucket = ((shingles >> np.uint64(40)) * np.uint64(buckets) >> np.uint64(24)).astype(np.int64)
            if len(heavy):
                known = heavy[np.minimum(np.searchsorted(heavy, shingles), len(heavy) - 1)] == shingles
                at_home = buckets + (mix(nodes.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
                bucket[known] = at_home[owner[known]]
            order = np.argsort(bucket, kind="stable")
            bucket, owner, shingles = bucket[order], owner[order], shingles[order]
            runs = np.flatnonzero(np.concatenate([[True], (bucket[1:] != bucket[:-1]) | (owner[1:] != owner[:-1])]))
            lengths = np.diff(np.append(runs, len(owner))).astype(np.int32)
            run_bucket, run_node = bucket[runs], nodes[owner[runs]]
            cuts = np.append(np.flatnonzero(np.concatenate([[True], run_bucket[1:] != run_bucket[:-1]])), len(runs))
            out = {"bucket": [], "nodes": [], "lengths": [], "tokens": []}
            ends = np.append(runs, len(owner))
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                out["bucket"].append(int(run_bucket[a]))
                out["nodes"].append(run_node[a:b].tobytes())
                out["lengths"].append(lengths[a:b].tobytes())
                out["tokens"].append(shingles[ends[a] : ends[b]].tobytes())
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("bucket", pa.int64()), ("nodes", pa.binary()), ("lengths", pa.binary()), ("tokens", pa.binary())]))

    return run


def _joined(column: pa.ChunkedArray, kind) -> np.ndarray:
    return np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in column] or [np.zeros(0, kind)])


_REPLY = "part long, nodes binary, lengths binary, tokens binary, often binary"


def _reducer(buckets: int) -> Callable:
    kind = pa.schema([("part", pa.int64()), *((c, pa.binary()) for c in ("nodes", "lengths", "tokens", "often"))])

    def run(table: pa.Table) -> pa.Table:
        release()
        at_home = table.column("bucket")[0].as_py() >= buckets
        tokens = _joined(table.column("tokens"), np.uint64)
        owner = np.repeat(_joined(table.column("nodes"), np.int64), _joined(table.column("lengths"), np.int32))
        if at_home:
            often = np.full(len(tokens), HEAVY_FREQUENCY, np.int32)
        else:
            order = np.lexsort((owner, tokens))
            tokens, owner = tokens[order], owner[order]
            once = np.concatenate([[True], (tokens[1:] != tokens[:-1]) | (owner[1:] != owner[:-1])])
            tokens, owner = tokens[once], owner[once]
            starts = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
            often = np.diff(np.append(starts, len(tokens))).astype(np.int32)
            often = np.repeat(often, often)
            shared = often > 1
            tokens, owner, often = tokens[shared], owner[shared], often[shared]
        part = owner % buckets
        order = np.lexsort((tokens, owner, part))
        tokens, owner, often, part = tokens[order], owner[order], often[order], part[order]
        once = np.concatenate([[True], (tokens[1:] != tokens[:-1]) | (owner[1:] != owner[:-1])]) if len(tokens) else np.zeros(0, bool)
        tokens, owner, often, part = tokens[once], owner[once], often[once], part[once]
        runs = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]])) if len(owner) else np.zeros(0, np.int64)
        ends = np.append(runs, len(owner))
        lengths, node, run_part = np.diff(ends).astype(np.int32), owner[runs], part[runs]
        cuts = np.append(np.flatnonzero(np.concatenate([[True], run_part[1:] != run_part[:-1]])), len(runs)) if len(runs) else np.zeros(1, np.int64)
        out: dict[str, list] = {c: [] for c in kind.names}
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            own = slice(ends[a], ends[b])
            for name, value in zip(kind.names, (int(run_part[a]), node[a:b].tobytes(), lengths[a:b].tobytes(), tokens[own].tobytes(), often[own].tobytes()), strict=True):
                out[name].append(value)
        return pa.Table.from_pydict(out, schema=kind)

    return run


def _lists(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values.view(np.int64)))


_CANDIDATE = "node long, n long, tokens array<long>, prefix array<long>, typical double, scan long"
_CANDIDATE_ARROW = pa.schema(
    [("node", pa.int64()), ("n", pa.int64()), ("tokens", pa.list_(pa.int64())), ("prefix", pa.list_(pa.int64())), ("typical", pa.float64()), ("scan", pa.int64())]
)


def _gather(found: pa.Table, known: pa.Table) -> pa.Table:
    """Nodes with enough shared shingles: those, rarest first, the first ones that a link must touch, and how typical the set is."""
    release()
    tokens, often = _joined(found.column("tokens"), np.uint64), _joined(found.column("often"), np.int32)
    sender, wide = _joined(found.column("nodes"), np.int64), _joined(found.column("lengths"), np.int32)
    nodes, n = known.column("node").to_numpy(), known.column("n").to_numpy()
    by_node = np.argsort(nodes)
    nodes, n = nodes[by_node], n[by_node]
    owner = np.searchsorted(nodes, np.repeat(sender, wide)) if len(nodes) else np.zeros(0, np.int64)
    counts = np.bincount(owner, minlength=len(nodes)) if len(nodes) else np.zeros(0, np.int64)
    able = counts >= np.maximum(1, _floor_needed(n))
    keep = able[owner]
    tokens, often, owner = tokens[keep], often[keep], owner[keep]
    # The order of frequency is the same in all sets.
    order = np.lexsort((tokens, often, owner))
    tokens, often, owner = tokens[order], often[order], owner[order]
    counts = np.bincount(owner, minlength=len(nodes)) if len(nodes) else counts
    begin = np.concatenate([[0], np.cumsum(counts)])
    # Shingles that no other node has come first in the order and are not here.
    prefix_length = np.where(able, n - _floor_needed(n) + 1 - (n - counts), 0)
    chosen = np.arange(len(owner)) - begin[owner] < prefix_length[owner]
    weight = np.bincount(owner, np.log2(often), len(nodes)) if len(nodes) else np.zeros(0)
    scan = np.bincount(owner[chosen], often[chosen], len(nodes)) if len(nodes) else np.zeros(0)
    starts = np.concatenate([[0], np.cumsum(counts[able])])
    prefix_starts = np.concatenate([[0], np.cumsum(prefix_length[able])])
    return pa.Table.from_arrays(
        [pa.array(nodes[able]), pa.array(n[able]), _lists(tokens, starts), _lists(tokens[chosen], prefix_starts), pa.array(weight[able] / np.maximum(n[able], 1)), pa.array(scan[able].astype(np.int64))],
        schema=_CANDIDATE_ARROW,
    )


def shared_sets(docs: DataFrame, described: DataFrame, frequent: DataFrame, text_col: str, width: int = WIDTH) -> DataFrame:
    """Nodes that can link, with their shared shingles; see ``_CANDIDATE``."""
    nodes = described.where("node is not null").groupBy("node").agg(F.first("n").alias("n"))
    total, count = nodes.agg(F.sum("n"), F.count("*")).first()
    buckets = max(1, -(-(total or 0) // BUCKET_SHINGLES))
    often = frequent.groupBy("token").agg(F.sum("count").alias("count")).where(F.col("count") >= max(HEAVY_LEAST, count // HEAVY_SHARE))
    heavy = np.array([r[0] for r in often.orderBy(F.desc("count"), "token").limit(HEAVY_MOST).select("token").collect()], np.int64).view(np.uint64)
    heavy.sort()
    sent = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(_mapper(width, buckets, heavy), "bucket long, nodes binary, lengths binary, tokens binary")
    found = sent.groupBy("bucket").applyInArrow(_reducer(buckets), _REPLY)
    # Nodes are hashes; their parts are remainders, here as in the buckets.
    part = F.pmod("node", F.lit(buckets))
    gathered = found.groupBy("part").cogroup(nodes.groupBy(part.alias("part"))).applyInArrow(_gather, _CANDIDATE)
    return written(gathered, "shared")


def subset_cost(n: int, most: int) -> int:
    """Subsets that a set of ``n`` lists to meet all sets of up to ``most``."""
    return sum(comb(n, overlap_needed(n, m)) for m in range(_floor_needed(n), min(most, n * OF // NEED) + 1))


def boundary(candidates: DataFrame) -> int:
    """The largest size of small sets: where listing subsets plus scanning lists costs least, over the sizes that occur."""
    sizes = {r["n"]: (r["sets"], r["scan"]) for r in candidates.where(F.col("n") <= SMALL_MOST).groupBy("n").agg(F.count("*").alias("sets"), F.sum("scan").alias("scan")).collect()}

    def cost(most: int) -> int:
        return sum(sets * subset_cost(n, most) if n <= most else scan for n, (sets, scan) in sizes.items())

    return min(range(SMALL_MOST + 1), key=cost)


def _subsets(most: int) -> Callable:
    schema = pa.schema([("key", pa.binary()), ("side", pa.int32()), ("node", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for node, n, tokens in zip(*(batch.column(c).to_pylist() for c in ("node", "n", "tokens")), strict=True):
                keys, sides = [], []
                for m in range(_floor_needed(n), min(most, n * OF // NEED) + 1):
                    tag = struct.pack("<qq", min(n, m), max(n, m))
                    for chosen in combinations(tokens, overlap_needed(n, m)):
                        keys.append(blake2b(tag + struct.pack(f"<{len(chosen)}q", *chosen), digest_size=16).digest())
                        sides.append((n > m) - (n < m))
                yield pa.RecordBatch.from_pydict({"key": keys, "side": sides, "node": [node] * len(keys)}, schema=schema)

    return run


def small_links(candidates: DataFrame, most: int) -> DataFrame:
    """Links among sets of up to ``most``: equal subset, sizes as the subset was made for.  One link per row to the least node across."""
    rows = candidates.where(F.col("n") <= most).select("node", "n", "tokens").mapInArrow(_subsets(most), "key binary, side int, node long")
    least = rows.groupBy("key").agg(*(F.min(F.when(F.col("side") == s, F.col("node"))).alias(c) for s, c in ((-1, "less"), (0, "same"), (1, "more"))), F.count("*").alias("members")).where("members > 1")
    other = F.when(F.col("side") == 0, F.col("same")).when(F.col("side") < 0, F.col("more")).otherwise(F.col("less"))
    return rows.join(least, "key").select(F.col("node").alias("a"), other.alias("b")).where("b is not null and a <> b").distinct()


def _fit(a: str, b: str, most: int) -> Column:
    """What sizes and places allow; one set is large.

    Shingles that no other node has count for the size but can never be in an overlap, nor can those before the first one
    that a pair has in common.  A pair that links passes at that shingle, which both prefixes hold; it need not pass at others.
    """
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    shared = F.least(F.col(f"{a}.shared") - F.col(f"{a}.place"), F.col(f"{b}.shared") - F.col(f"{b}.place"))
    return (F.lit(NEED + OF) * shared >= F.lit(NEED) * (n + m)) & (F.greatest(n, m) > most)


def compared(pairs: DataFrame, candidates: DataFrame) -> DataFrame:
    """The rows of ``pairs`` (``a``, ``b`` and more) whose nodes link, by exact overlap."""
    names = pairs.columns
    pairs = small_side(written(pairs, "pairs"))
    sets = candidates.select("node", "n", "tokens")
    first = sets.select(F.col("node").alias("a"), F.col("n").alias("_na"), F.col("tokens").alias("_ta"))
    second = sets.select(F.col("node").alias("b"), F.col("n").alias("_nb"), F.col("tokens").alias("_tb"))
    both = F.size(F.array_intersect("_ta", "_tb"))
    return second.join(pairs, "b").join(first, "a").where(F.lit(NEED + OF) * both >= F.lit(NEED) * (F.col("_na") + F.col("_nb"))).select(*names)


def star_links(candidates: DataFrame, posts: DataFrame, most: int) -> DataFrame:
    """Links of each list's most typical member with the others that it links to."""
    head = F.max(F.struct("typical", "node", "n", "shared", "place")).alias("head")
    heads = posts.groupBy("token").agg(head, F.count("*").alias("members")).where("members > 1").select("token", "head.*")
    met = posts.alias("p").join(heads.alias("h"), F.col("p.token") == F.col("h.token"))
    met = met.where((F.col("p.node") != F.col("h.node")) & _fit("p", "h", most))
    return compared(met.select(F.col("h.node").alias("a"), F.col("p.node").alias("b")).distinct(), candidates)


def open_members(posts: DataFrame, roots: DataFrame) -> DataFrame:
    """Members of lists that span several components, with their ``root``, ``band``, and whether it is the list's largest one (``major``)."""
    placed = posts.drop("typical").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    tally = placed.groupBy("token", "root").agg(F.count("*").alias("members"))
    lists = tally.groupBy("token").agg(F.max(F.struct("members", "root")).alias("top"), F.count("*").alias("several")).where("several > 1")
    mixed = small_side(written(lists.select("token", F.col("top.root").alias("top")), "lists"))
    band = F.floor(F.log("n") / F.lit(log(BAND)))
    return written(placed.join(mixed, "token").select("token", "node", "n", "shared", "place", "root", band.alias("band"), (F.col("root") == F.col("top")).alias("major")), "open")


def _beside(members: DataFrame) -> DataFrame:
    """Members under each band that a set of theirs may have."""
    return members.withColumn("band", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)))


def pairs_tried(members: DataFrame) -> int:
    """How many pairs of members the join of :func:`rest_links` looks at."""
    own = members.where("not major").groupBy("token", "band").agg(F.count("*").alias("x"))
    met = _beside(members).groupBy("token", "band").agg(F.count("*").alias("y"))
    return own.join(met, ["token", "band"]).agg(F.sum(F.col("x") * F.col("y"))).first()[0] or 0


def rest_links(candidates: DataFrame, members: DataFrame, most: int) -> DataFrame:
    """Links between components (``ra``, ``rb``): of two members in different ones, one at least is outside the list's largest."""
    p, q = members.where("not major").alias("p"), _beside(members).alias("q")
    met = p.join(q, (F.col("p.token") == F.col("q.token")) & (F.col("p.band") == F.col("q.band")))
    met = met.where((F.col("q.major") | (F.col("p.node") < F.col("q.node"))) & (F.col("p.root") != F.col("q.root")) & _fit("p", "q", most))
    pairs = met.select(F.col("p.node").alias("a"), F.col("q.node").alias("b"), F.col("p.root").alias("ra"), F.col("q.root").alias("rb"))
    return compared(pairs.distinct(), candidates).select("ra", "rb")


def linked_nodes(candidates: DataFrame) -> DataFrame:
    """``node`` and ``root`` of every node that links with another."""
    most = boundary(candidates)
    posts = candidates.select("node", "n", F.size("tokens").alias("shared"), "typical", F.posexplode("prefix").alias("place", "token"))
    roots = written(components(written(star_links(candidates, posts, most).union(small_links(candidates, most)), "links")), "roots")
    rest = written(rest_links(candidates, open_members(posts, roots), most), "rest")
    if rest.isEmpty():
        return roots
    # Components that link are joined; this graph has a node per component only.
    joined = written(components(rest, "ra", "rb"), "joined").select(F.col("node").alias("old"), F.col("root").alias("new"))
    grown = roots.join(joined, F.col("root") == F.col("old"), "left").select("node", F.coalesce("new", "root").alias("root"))
    alone = joined.join(roots, F.col("old") == F.col("node"), "left_anti").select(F.col("old").alias("node"), F.col("new").alias("root"))
    return grown.union(alone)


def similar_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """One row per document: ``id``, ``n`` (set size), ``component`` (smallest id that links reach), ``node``, ``root``."""
    described, frequent = describe(docs, id_col, text_col, width)
    candidates = shared_sets(docs, described, frequent, text_col, width)
    roots = linked_nodes(candidates)
    placed = written(looked_up(described, "node", roots).select("id", "n", "node", F.coalesce("root", "node").alias("root")), "placed")
    # A document by itself is its own component's smallest.
    groups = placed.where("root is not null").groupBy("root").agg(F.min("id").alias("least"), F.count("*").alias("members")).where("members > 1")
    return looked_up(placed, "root", groups.select("root", "least")).select("id", "n", F.coalesce("least", "id").alias("component"), "node", "root")


def digest(found: DataFrame) -> DataFrame:
    """The contract's row per document."""
    return found.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def set_nodes(texts: pa.Array, width: int = WIDTH) -> pa.Array:
    """The node of each text, null without words."""
    sizes, nodes, _ = _batch_sets(texts, width)
    return pa.array(nodes, mask=sizes == 0)


def first_of_each_group(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """``docs`` with one row of each group, of those with the smallest id (null last); documents without words all stay.

    Rows are told apart by id and node; rows equal in both are copies of each other, and any one of them stays.
    """
    found = written(similar_documents(docs, id_col=id_col, text_col=text_col, width=width).where("node is not null"), "groups")
    own = free_name(docs, "node")
    first = F.min(F.struct(F.col("id").isNull().alias("last"), "id", "node")).alias("first")
    named = found.select("id", "node", "root").distinct()
    kept = named.groupBy("root").agg(first).select(F.col("first.id").alias("first_id"), F.col("first.node").alias("first_node"))
    is_first = F.col("id").eqNullSafe(F.col("first_id")) & (F.col("node") == F.col("first_node"))
    dropped = written(named.select("id", "node").join(kept, is_first, "left_anti"), "dropped")
    again = written(found.groupBy("id", "node").count().where("count > 1").select("id", "node"), "again")
    marked = docs.withColumn(own, F.arrow_udf(lambda texts: set_nodes(texts, width), T.LongType())(F.col(text_col).cast("string")))

    def met(rows: DataFrame, other: DataFrame, how: str) -> DataFrame:
        same = F.col(f"d.`{id_col}`").eqNullSafe(F.col("o.id")) & (F.col(f"d.`{own}`") == F.col("o.node"))
        return rows.alias("d").join(small_side(other).alias("o"), same, how)

    left = met(marked, dropped, "left_anti")
    if again.isEmpty():
        return left.drop(own)
    single = met(left, again, "left_anti")
    several = met(left, again, "left_semi").dropDuplicates([id_col, own])
    return single.union(several).drop(own)
