"""DuckDB answers of the dealt operators that SQL can express."""

from __future__ import annotations

from corpusrules.llm.sharding import MULTIPLIERS, OVERHEAD, SEED, SHARDS, round_keys

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1 = rf"""
WITH w AS (
  SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_LOWER.format("text")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark
), windows AS (
  SELECT DISTINCT item, list_slice(words, i, i + 9) AS run FROM (SELECT item, words, unnest(range(1, greatest(len(words) - 9, 1) + 1)) AS i FROM b WHERE len(words) > 0)
), sizes AS (SELECT DISTINCT len(run) AS n FROM windows
), grams AS (
  SELECT doc_id, i, n, list_slice(words, i, i + n - 1) AS run
  FROM (SELECT doc_id, words, n, unnest(range(1, len(words) - n + 2)) AS i FROM w, sizes WHERE len(words) >= n)
), found AS (SELECT g.doc_id, g.i, g.n, t.item FROM grams g JOIN windows t USING (run)
), hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM found)) GROUP BY 1
), items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS joined FROM (SELECT DISTINCT doc_id, item FROM found WHERE item IS NOT NULL) GROUP BY 1
)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(joined, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)
"""

OP3 = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') AS words FROM documents
), s AS (
  SELECT DISTINCT doc_id, list_slice(words, i, i + 4) AS run FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 4, 1) + 1)) AS i FROM w WHERE len(words) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1
), h AS (SELECT doc_id, md5(CAST(run AS VARCHAR)) AS run FROM s
), common AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS met FROM h x JOIN h y ON x.run = y.run AND x.doc_id <> y.doc_id GROUP BY 1, 2
), link AS (
  SELECT a, b FROM common JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * met >= 80 * (na.n + nb.n - met)
), reach AS (
  SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT x, b FROM reach JOIN link ON y = a
)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, component_id
FROM (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY 1) LEFT JOIN n USING (doc_id)
"""

OP9 = r"""
WITH d AS (SELECT doc_id, coalesce(hex(encode(text)), '') AS h FROM documents
), p AS (
  SELECT doc_id, i, hash(substr(h, 2 * i + 1, 400)) AS piece FROM (SELECT doc_id, h, unnest(range(0, CAST(len(h) / 2 - 199 AS BIGINT))) AS i FROM d WHERE len(h) >= 400)
), twice AS (SELECT piece FROM p GROUP BY piece HAVING count(*) > 1
), s AS (
  SELECT doc_id, i, max(i) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS earlier FROM p JOIN twice USING (piece)
), m AS (SELECT doc_id, i, sum(CASE WHEN i > earlier + 200 OR earlier IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM s
), r AS (SELECT doc_id, run, min(i) AS a, max(i) + 200 AS b FROM m GROUP BY ALL
), k AS (
  SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS start FROM r
), g AS (
  SELECT d.doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, string_agg(substr(h, 2 * start + 1, 2 * (a - start)), '' ORDER BY a) || substr(any_value(h), 2 * max(b) + 1) AS rest
  FROM k JOIN d USING (doc_id) GROUP BY d.doc_id
)
SELECT doc_id, CAST(len(h) / 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(rest, h))) AS kept_sha256
FROM d LEFT JOIN g USING (doc_id)
"""

OP10 = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
    md5('20:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS k
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [5.0, 2.0, 1.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] :: DOUBLE AS weight FROM d GROUP BY source
), f AS (SELECT *, source_size * 2.0 :: DOUBLE AS cap, source_size * 2.0 :: DOUBLE / weight AS full_at FROM s
), l AS (
  SELECT *, ((sum(source_size) OVER ()) * 1.5 :: DOUBLE - coalesce(sum(cap) OVER (ORDER BY full_at, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / ((sum(weight) OVER ()) - coalesce(sum(weight) OVER (ORDER BY full_at, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
  FROM f
), t AS (
  SELECT source, source_size, least(cap, coalesce((SELECT arg_min(level, full_at) FROM l WHERE level <= full_at), 1e300) * weight) AS target FROM l
), c AS (
  SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole,
    coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, CAST(size * (whole + CASE WHEN target - whole * source_size > 0 AND ahead + size / 2.0 <= target - whole * source_size THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM c
"""

#: CRC-32 of a list of hex digit pairs: the table of its remainders, then a fold over the bytes.
_CRC_TABLE = """(
  SELECT list_transform(range(256), lambda c: list_reduce([c, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, z: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)) AS t
)"""
_CRC = "xor(4294967295, list_reduce(list_prepend(4294967295 :: BIGINT, list_transform(regexp_extract_all(hex(encode({})), '..'), lambda p: ('0x' || p) :: BIGINT)), lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)])))"


def _network(source: str) -> str:
    """The Feistel network over ``x`` of ``source``, round by round, giving ``y``."""
    one, two = MULTIPLIERS
    text = f"SELECT i, n, lb, rb, x >> rb AS l, x & ((1::BIGINT << rb) - 1) AS r FROM {source}"
    for k, key in enumerate(round_keys(SEED)):
        text = f"SELECT *, (r + {key}) * {one} AS a FROM ({text})"
        text = f"SELECT *, (xor(a, a >> 23) & 4294967295) * {two} AS b FROM ({text})"
        wide = "rb" if k % 2 else "lb"
        text = f"SELECT i, n, lb, rb, r AS l, xor(l, (xor(b, b >> 29) >> 20) & ((1::BIGINT << {wide}) - 1)) AS r FROM ({text})"
    return f"SELECT i, n, lb, rb, (l << rb) | r AS y FROM ({text})"


OP11 = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, octet_length(encode(coalesce(text, ''))) + {OVERHEAD} AS size, {_CRC.format("coalesce(text, '')")} AS crc FROM documents, {_CRC_TABLE}
), r AS (SELECT *, row_number() OVER (ORDER BY doc_id NULLS LAST, size, crc) - 1 AS i, count(*) OVER () AS n FROM d
), s AS (SELECT i, i AS x, n, bits // 2 AS lb, bits - bits // 2 AS rb FROM (SELECT i, n, greatest(2, ceil(log2(n)) :: BIGINT) AS bits FROM r)
), walk AS ({_network("s")} UNION ALL {_network("(SELECT i, n, lb, rb, y AS x FROM walk WHERE y >= n)")}
)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(crc AS BIGINT) AS text_crc32, 'rows' AS law, CAST(y % {SHARDS} AS INTEGER) AS shard, CAST(y // {SHARDS} AS BIGINT) AS slot,
  CAST(NULL AS INTEGER) AS grown_shard
FROM r JOIN walk ON r.i = walk.i AND y < r.n
"""


def _framed(*columns: str) -> str:
    return " || ".join(f"CASE WHEN {c} IS NULL THEN '-' ELSE octet_length(encode(CAST({c} AS VARCHAR))) || ':' || {c} END" for c in columns)


def _levels(name: str, tree: str, levels: int) -> str:
    """Trees ``{name}0`` (``tree``, ``i``, ``h``) level by level up to ``16 ** levels`` leaves, with each node's siblings before and after it."""
    parts = []
    for k in range(levels):
        run = f"(PARTITION BY {tree}, i // 16 ORDER BY i ROWS BETWEEN"
        parts.append(f"""{name}{k}w AS (
  SELECT {tree}, i, h, count(*) OVER (PARTITION BY {tree}) > 1 AS more, coalesce(string_agg(h, '') OVER {run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before,
    coalesce(string_agg(h, '') OVER {run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS behind
  FROM {name}{k}
), {name}{k + 1} AS (
  SELECT {tree}, i // 16 AS i, CASE WHEN any_value(more) THEN sha256(string_agg(h, '' ORDER BY i)) ELSE any_value(h) END AS h FROM {name}{k}w GROUP BY ALL
)""")
    return ", ".join(parts)


def _folds(name: str, tree: str, levels: int, of: str) -> str:
    """Each document's fold up those trees, and its siblings on the way, from ``{of}`` (``j``: its leaf, ``f``, ``p``)."""
    parts = []
    for k in range(levels):
        last = f"{name}f{k - 1}" if k else of
        parts.append(f"""{name}f{k} AS (
  SELECT {last}.* EXCLUDE (j, f, p), j // 16 AS j, CASE WHEN more THEN sha256(before || f || behind) ELSE f END AS f, CASE WHEN more THEN p || before || behind ELSE p END AS p
  FROM {last} JOIN {name}{k}w w ON {last}.{tree} IS NOT DISTINCT FROM w.{tree} AND j = w.i
)""")
    return ", ".join(parts)


#: Levels that the SQL climbs: 16 ** 6 documents a source, 16 ** 4 sources.
_LOW, _HIGH = 6, 4
OP13 = f"""
WITH d AS (
  SELECT *, sha256({_framed("doc_id", "source", "lang", "n_chars", "text")}) AS leaf, sha256({_framed("doc_id", "source", "lang", "n_chars", "lower_text")}) AS other
  FROM (SELECT *, {_LOWER.format("text")} AS lower_text FROM documents)
), t AS (
  SELECT doc_id, source, leaf, CASE WHEN coalesce({_CRC.format("CAST(doc_id AS VARCHAR)")} % 5 = 0, false) THEN other ELSE leaf END AS f,
    row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS j
  FROM d, {_CRC_TABLE}
), s0 AS (SELECT source, j AS i, leaf AS h FROM t
), {_levels("s", "source", _LOW)}, g AS (SELECT source, h AS subroot, 1 AS one, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS place FROM s{_LOW}
), u0 AS (SELECT one, place AS i, subroot AS h FROM g
), {_levels("u", "one", _HIGH)}, a AS (SELECT doc_id, source, leaf, j, f, '' AS p FROM t
), {_folds("s", "source", _LOW, "a")}, b AS (
  SELECT doc_id, leaf, subroot, one, place AS j, f, p FROM sf{_LOW - 1} x JOIN g ON x.source IS NOT DISTINCT FROM g.source
), {_folds("u", "one", _HIGH, "b")}
SELECT doc_id, leaf, subroot, u{_HIGH}.h AS root, sha256(p) AS proof_sha256, f AS folded_root, f = u{_HIGH}.h AS verified FROM uf{_HIGH - 1} z JOIN u{_HIGH} USING (one)
"""

ORACLES: dict[str, str] = {
    "op13_merkle": OP13,
    "op11_sharding": OP11,
    "op9_suffix_dedup": OP9,
    "op10_mixing": OP10,
    "op3_ngram_jaccard": OP3,
    "op1_decontamination": OP1,
}
