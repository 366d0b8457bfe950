"""Mixing sources to target weights: a multivariate-hypergeometric splitting tree, in DataFrame and SQL functions only.

A *block* is one copy of a document, its size the number of its words.  Sources (by code point, null last) have weights
that repeat; together they get ``share`` times all words, none more than ``most`` times its own (the excess goes to the
others by weight).  A source's target is met by whole copies of all its documents and one more copy of the first
documents of a random order, as many as come nearest to the target.

The numbers of blocks of all sources are split among output shards by a binary tree: a node's left child gets half of its
blocks, and how many of each source is one draw of the multivariate hypergeometric distribution (univariate draws, source
after source, by inversion around the mode), so every shard's numbers are those of a random deal without replacement and
add up exactly.  Each shard then owns consecutive stretches of each source's block permutation, and is shuffled locally.

Only counts and order statistics move: orders are hashes, cut into ``STRIPES`` equal stripes, and rows are ranked only
inside the stripes where a bound falls.  Documents find their copies and shards in their own row, from one row per source.
No window ever covers a source, however large.  The quota vector of a tree node (one number per source) is one row.

Null texts and texts without words have size 0 and count as blocks of size 0; a null source is a source, the last one; rows
with equal ids have equal keys and are taken together; other columns are not read.  Empty tables give empty mixes.
Results depend on ids and ``seed`` only, so reruns agree.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusrules.llm.storage import free_name, written

WEIGHTS = (5, 2, 1)
SHARE, MOST = 1.5, 2.0
SHARDS = 64
#: Words of a shard that one task shuffles.
PIECE_WORDS = 32_000_000
STRIPES = 4096
SEED = 20

WORD = r"[^\x20\x09-\x0D]+"


def order_key(id_col: str | Column, seed: int, copy: Column | None = None) -> Column:
    """A random order of documents, or of their copies: 32 hex digits."""
    parts = [F.lit(str(seed)), *([copy.cast("string")] if copy is not None else []), F.coalesce(F.col(id_col).cast("string") if isinstance(id_col, str) else id_col.cast("string"), F.lit(""))]
    return F.md5(F.concat_ws(":", *parts))


def _stripe(key: str) -> Column:
    return (F.conv(F.substring(key, 1, 6), 16, 10).cast("long") * STRIPES / F.lit(1 << 24)).cast("int")


def narrow_rows(docs: DataFrame, id_col: str, source_col: str, text_col: str, seed: int) -> DataFrame:
    """``id``, ``source``, ``size``, ``key`` of every row; written once, since all later steps read only this."""
    slim = docs.select(
        F.col(id_col).alias("id"),
        F.col(source_col).cast("string").alias("source"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        order_key(id_col, seed).alias("key"),
    )
    return written(slim, "sizes")


def source_targets(rows: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """One row per source: ``number`` (its place), ``docs``, ``source_size``, ``target``."""
    alone = Window.orderBy(F.col("source").asc_nulls_last())
    sized = rows.groupBy("source").agg(F.count("*").alias("docs"), F.sum("size").alias("source_size"))
    listed = sized.withColumn("number", (F.row_number().over(alone) - 1).cast("long"))
    weighed = listed.withColumn("weight", F.element_at(F.array(*map(F.lit, map(float, weights))), (F.pmod("number", F.lit(len(weights))) + 1).cast("int")))
    capped = weighed.withColumn("cap", F.col("source_size") * F.lit(float(most))).withColumn("full_at", F.col("cap") / F.col("weight"))
    # Sources fill up in the order of ``full_at``; the level is that of the first one that stays below its cap.
    before = Window.orderBy("full_at", "number").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy("full_at", "number").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    spent = F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    used = F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    level = (F.sum("source_size").over(everything) * F.lit(float(share)) - spent) / (F.sum("weight").over(everything) - used)
    tried = capped.withColumn("level", level)
    final = F.min(F.when(F.col("level") <= F.col("full_at"), F.struct("full_at", "number", "level"))).over(everything)
    found = tried.withColumn("final", final["level"])
    target = F.when(F.col("final").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("final") * F.col("weight")))
    return found.select("source", "number", "docs", "source_size", target.alias("target"))


def source_copies(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """Per source also ``whole`` (copies of every document) and ``last_key`` (documents up to it get one more; null: none)."""
    planned = targets.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    planned = planned.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    striped = rows.select("source", "size", "key", _stripe("key").alias("stripe"))
    stripes = striped.groupBy("source", "stripe").agg(F.sum("size").alias("words"))
    running = Window.partitionBy("source").orderBy("stripe").rowsBetween(Window.unboundedPreceding, -1)
    stripes = stripes.withColumn("before", F.coalesce(F.sum("words").over(running), F.lit(0)))
    open_stripe = (
        stripes.join(planned.select(F.col("source").alias("s"), "rest"), F.col("source").eqNullSafe(F.col("s")))
        .where((F.col("before") <= F.col("rest")) & (F.col("rest") > 0))
        .groupBy("source")
        .agg(F.max(F.struct("stripe", "before", "rest")).alias("at"))
        .select(F.col("source").alias("s"), F.col("at.stripe").alias("t"), F.col("at.before").alias("before"), F.col("at.rest").alias("rest"))
    )
    inside = striped.join(open_stripe, F.col("source").eqNullSafe(F.col("s")) & (F.col("stripe") == F.col("t")))
    keyed = inside.groupBy("source", "stripe", "key").agg(F.sum("size").alias("words"), F.first("before").alias("before"), F.first("rest").alias("rest"))
    ahead = Window.partitionBy("source", "stripe").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    taken = keyed.withColumn("ahead", F.col("before") + F.coalesce(F.sum("words").over(ahead), F.lit(0))).where(F.col("ahead") + F.col("words") / 2 <= F.col("rest"))
    # A stripe whose first document already is too much: all earlier stripes, that is every key below the stripe's first.
    last = open_stripe.join(taken.groupBy("source").agg(F.max("key").alias("key")), F.col("s").eqNullSafe(F.col("source")), "left").select(
        F.col("s"), F.coalesce("key", F.lpad(F.lower(F.conv((F.col("t") * F.lit((1 << 24) // STRIPES)).cast("string"), 10, 16)), 6, "0")).alias("last_key")
    )
    return planned.join(last, F.col("source").eqNullSafe(F.col("s")), "left").drop("s", "rest")


def _copies(whole: str, key: str, last_key: str) -> Column:
    return (F.col(whole) + F.when(F.col(key) <= F.col(last_key), 1).otherwise(0)).cast("int")


def hypergeometric(total: str, marked: str, drawn: str, uniform: str) -> str:
    """SQL for the number of marked ones among ``drawn`` of ``total``: inversion over all outcomes within 9 standard deviations.

    Outcomes are passed from the mode upwards, then downwards, each weight from the last one; both ways are walked twice,
    for the sum and for the draw.  (The mass left out is below 1e-15.)
    """
    setting = f"""named_struct('pool', CAST({total} AS DOUBLE), 'good', CAST({marked} AS DOUBLE), 'pick', CAST({drawn} AS DOUBLE), 'u', {uniform})"""
    ranged = """named_struct('pool', p.pool, 'good', p.good, 'pick', p.pick, 'u', p.u,
      'mode', greatest(greatest(0D, p.pick + p.good - p.pool), least(least(p.pick, p.good), floor((p.pick + 1) * (p.good + 1) / (p.pool + 2)))),
      'low', greatest(0D, p.pick + p.good - p.pool), 'high', least(p.pick, p.good),
      'wide', CASE WHEN p.pool > 1 THEN ceil(9 * sqrt(p.pick * (p.good / p.pool) * (1 - p.good / p.pool) * (p.pool - p.pick) / (p.pool - 1))) + 2 ELSE 1D END)"""
    up = "CASE WHEN least(q.high, q.mode + q.wide) > q.mode THEN sequence(CAST(q.mode AS BIGINT), CAST(least(q.high, q.mode + q.wide) AS BIGINT) - 1) ELSE array() END"
    down = "CASE WHEN greatest(q.low, q.mode - q.wide) < q.mode THEN sequence(CAST(q.mode AS BIGINT), CAST(greatest(q.low, q.mode - q.wide) AS BIGINT) + 1, -1) ELSE array() END"
    rise = "a.w * (q.good - k) * (q.pick - k) / ((k + 1) * (q.pool - q.good - q.pick + k + 1))"
    fall = "a.w * k * (q.pool - q.good - q.pick + k) / ((q.good - k + 1) * (q.pick - k + 1))"

    def summed(over: str, step: str) -> str:
        return f"aggregate({over}, named_struct('w', 1D, 's', 0D), (a, k) -> named_struct('w', {step}, 's', a.s + {step}), a -> a.s)"

    def drawn_from(start: str, over: str, step: str, move: str) -> str:
        return f"""aggregate({over}, {start}, (a, k) -> named_struct('w', {step}, 'left', a.left - {step},
          'x', CASE WHEN a.x IS NULL AND a.left - {step} <= 0 THEN CAST(k AS DOUBLE) {move} 1 ELSE a.x END))"""

    goal = f"q.u * (1D + {summed(up, rise)} + {summed(down, fall)})"
    first = f"transform(array({goal}), g -> named_struct('w', 1D, 'left', g - 1D, 'x', CASE WHEN g <= 1D THEN q.mode END))[0]"
    after_up = drawn_from("f", up, rise, "+")
    after_down = drawn_from("named_struct('w', 1D, 'left', h.left, 'x', h.x)", down, fall, "-")
    walked = f"transform(array({first}), f -> transform(array({after_up}), h -> {after_down})[0])[0]"
    # Rounding may leave nothing chosen at the very end of the walk; the mode is as good as the last outcome then.
    return f"transform(array({setting}), p -> transform(array({ranged}), q -> CAST(coalesce({walked}.x, q.mode) AS BIGINT))[0])[0]"


def split_quotas(quotas: DataFrame, shards: int, seed: int = SEED) -> DataFrame:
    """``number``, ``shard``, ``quota`` from ``number`` (source) and ``blocks``; ``shards`` is a power of two."""
    if shards < 1 or shards & (shards - 1):
        raise ValueError("shards must be a power of two")
    nodes = quotas.agg(F.sort_array(F.collect_list(F.struct("number", "blocks"))).alias("sources")).select(
        F.lit(0).cast("long").alias("node"), F.col("sources.number").alias("numbers"), F.col("sources.blocks").alias("counts")
    )
    uniform = f"(pmod(xxhash64({seed}, level, node, i), 9007199254740992L) + 0.5D) / 9007199254740992D"
    draw = hypergeometric("a.total", "counts[i]", "a.half", uniform)
    fold = f"""aggregate(sequence(0, size(counts) - 1),
      named_struct('total', total, 'half', total div 2, 'left', CAST(array() AS ARRAY<BIGINT>)),
      (a, i) -> transform(array({draw}), x -> named_struct('total', a.total - counts[i], 'half', a.half - x, 'left', array_append(a.left, x)))[0],
      a -> a.left)"""
    for level in range(shards.bit_length() - 1):
        summed = nodes.where("size(counts) > 0").withColumn("level", F.lit(level)).withColumn("total", F.expr("aggregate(counts, 0L, (s, c) -> s + c)"))
        halves = summed.withColumn("left_counts", F.expr(fold))
        nodes = halves.select(
            "numbers",
            F.explode(
                F.array(
                    F.struct((F.col("node") * 2).alias("node"), F.col("left_counts").alias("counts")),
                    F.struct((F.col("node") * 2 + 1).alias("node"), F.zip_with("counts", "left_counts", lambda c, x: c - x).alias("counts")),
                )
            ).alias("half"),
        ).select("numbers", F.col("half.node").alias("node"), F.col("half.counts").alias("counts"))
    return nodes.select(F.col("node").cast("int").alias("shard"), F.explode(F.arrays_zip("numbers", "counts")).alias("s")).select(
        F.col("s.numbers").alias("number"), "shard", F.col("s.counts").alias("quota")
    )


def shard_bounds(rows: DataFrame, plan: DataFrame, shards: int, seed: int = SEED) -> DataFrame:
    """Per source ``number``: the last block key of each shard but the final one, ascending (``bounds``, one per shard)."""
    slim = rows.join(plan.select(F.col("source").alias("s"), "number", "whole", "last_key"), F.col("source").eqNullSafe(F.col("s")))
    copies = slim.select("id", "number", _copies("whole", "key", "last_key").alias("copies")).where("copies > 0")
    blocks = copies.select("number", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"), "id").select("number", order_key("id", seed + 1, F.col("copy")).alias("block"))
    blocks = blocks.withColumn("stripe", _stripe("block"))
    stripes = written(blocks.groupBy("number", "stripe").agg(F.count("*").alias("held")), "stripes")
    quotas = split_quotas(stripes.groupBy("number").agg(F.sum("held").alias("blocks")), shards, seed)
    upto = Window.partitionBy("number").orderBy("shard").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = written(quotas.withColumn("end", F.sum("quota").over(upto)).select("number", "shard", "end"), "ends")
    running = Window.partitionBy("number").orderBy("stripe").rowsBetween(Window.unboundedPreceding, -1)
    placed = stripes.withColumn("before", F.coalesce(F.sum("held").over(running), F.lit(0)))
    # An end lies in the stripe with before < end <= before + held; end 0 lies before every block.
    spots = (
        ends.where("end > 0")
        .join(placed, "number")
        .where((F.col("before") < F.col("end")) & (F.col("end") <= F.col("before") + F.col("held")))
        .select("number", "stripe", "shard", (F.col("end") - F.col("before")).alias("rank"))
    )
    wanted = spots.select("number", "stripe").distinct()
    inside = blocks.join(wanted, ["number", "stripe"], "left_semi")
    ranked = inside.withColumn("rank", F.row_number().over(Window.partitionBy("number", "stripe").orderBy("block")).cast("long"))
    found = ranked.join(spots, ["number", "stripe", "rank"]).select("number", "shard", "block")
    listed = ends.join(found, ["number", "shard"], "left").withColumn("block", F.coalesce("block", F.lit("")))
    return listed.groupBy("number").agg(F.sort_array(F.collect_list(F.struct("shard", "block"))).alias("b")).select("number", F.col("b.block").alias("bounds"))


def mix_plan(rows: DataFrame, *, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: float = MOST, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """One row per source: ``source``, ``source_size``, ``target``, ``whole``, ``last_key``, ``bounds``.  Written."""
    plan = written(source_copies(rows, source_targets(rows, weights, share, most)), "targets")
    bounds = shard_bounds(rows, plan, shards, seed)
    return written(plan.join(bounds, "number", "left").select("source", "source_size", "target", "whole", "last_key", "bounds"), "mix")


def _shards(copies: Column, id_col: str, bounds: Column, seed: int) -> Column:
    """The shard of each copy of a row: the first one whose last block is not before it."""
    return F.when(copies > 0, F.transform(F.sequence(F.lit(1), copies), lambda c: F.size(F.filter(bounds, lambda b: b < order_key(id_col, seed + 1, c))))).otherwise(
        F.array().cast("array<int>")
    )


def mixed_rows(docs: DataFrame, *, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", shards: int = SHARDS, seed: int = SEED, **shape) -> DataFrame:
    """One row per document: ``id``, ``size``, ``source_size``, ``target``, and ``shards``, the output shard of each copy taken."""
    rows = narrow_rows(docs, id_col, source_col, text_col, seed)
    plan = mix_plan(rows, shards=shards, seed=seed, **shape).withColumnRenamed("source", "s")
    joined = rows.join(plan, F.col("source").eqNullSafe(F.col("s")))
    return joined.select("id", "size", "source_size", "target", _shards(_copies("whole", "key", "last_key"), "id", F.col("bounds"), seed).alias("shards"))


def digest(mixed: DataFrame) -> DataFrame:
    """The contract's row per document; words taken are those of the copies that the shards drew."""
    return mixed.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.size("shards") * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, *, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", shards: int = SHARDS, seed: int = SEED, **shape) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as it is taken, by shard and in random order within it."""
    rows = narrow_rows(docs, id_col, source_col, text_col, seed)
    plan = mix_plan(rows, shards=shards, seed=seed, **shape)
    # A shard of many words is several tasks' work; each has a random part of it, in random order.
    words = rows.agg(F.sum("size")).first()[0] or 0
    pieces = max(1, -(-words // (shards * PIECE_WORDS)))
    own = free_name(docs, "mix")
    plan = plan.select(F.struct("source", "whole", "last_key", "bounds").alias(own))
    joined = docs.join(plan, docs[source_col].cast("string").eqNullSafe(F.col(f"{own}.source")))
    copies = (F.col(f"{own}.whole") + F.when(order_key(id_col, seed) <= F.col(f"{own}.last_key"), 1).otherwise(0)).cast("int")
    drawn = joined.select(*docs.columns, F.posexplode(_shards(copies, id_col, F.col(f"{own}.bounds"), seed)).alias(f"{own}_copy", f"{own}_shard"))
    place = order_key(id_col, seed + 2, F.col(f"{own}_copy"))
    piece = F.pmod(F.xxhash64(place), F.lit(pieces))
    return drawn.repartition(shards * pieces, f"{own}_shard", piece).sortWithinPartitions(f"{own}_shard", place).select(*docs.columns)
