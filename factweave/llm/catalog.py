"""Registered queries of the subpackage, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import (
    bpe, bwt, decontaminate, licences, merkle, minhash, neardup, passages, periodic, quality, sharding, simhash, templates,
)
from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = " ".join(sql.split())
        return fn

    return add


_WORDS = r"""regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

CONTAMINATION_SQL = f"""
WITH d AS (SELECT doc_id, coalesce({_WORDS}, []) AS ws FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item_id, {_WORDS} AS ws FROM benchmark),
g AS (SELECT DISTINCT item_id, l, array_to_string(ws[p:p + l - 1], ' ') AS w FROM (
  SELECT item_id, ws, l, unnest(range(1, len(ws) - l + 2)) AS p FROM (
    SELECT item_id, ws, least(len(ws), 13) AS l FROM i WHERE len(ws) > 0))),
dw AS (SELECT doc_id, l, p, array_to_string(ws[p:p + l - 1], ' ') AS w FROM (
  SELECT doc_id, ws, l, unnest(range(1, len(ws) - l + 2)) AS p FROM d, (SELECT DISTINCT l FROM g) WHERE len(ws) >= l)),
m AS (SELECT doc_id, item_id, p, dw.l FROM dw JOIN g ON dw.w = g.w AND dw.l = g.l),
h AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + l)) AS q FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT doc_id, item_id FROM m) GROUP BY doc_id)
SELECT d.doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""


@query("op1_contamination", CONTAMINATION_SQL)
def op1_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that stand in a 13-word run of a benchmark item."""
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), decontaminate.contaminated().alias("contaminated"),
    )


@query("op7_shards")
def op7_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards of near equal bytes."""
    placed = sharding.shards(table(spark, sf_dir, "documents"), 40)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", sharding.grown_shard().alias("grown_shard")
    )


@query("op8_simhash_components")
def op8_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id")
    )


@query("op2_fingerprints")
def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-permutation MinHash of every document and of its edited text."""
    return minhash.with_next(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"
    )


@query("op6_bpe_round_trip")
def op6_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document, and the text decoded from them."""
    done = bpe.round_trip(table(spark, sf_dir, "documents"))
    return done.select(
        "doc_id", (F.octet_length("packed") / 4).cast("bigint").alias("n_tokens"), F.sha2("packed", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@query("op5_repeated_strings")
def op5_repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every document that a string of 400 bytes found elsewhere does not cover."""
    done = bwt.repeated_strings(table(spark, sf_dir, "documents"))
    gone = F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, x: a + x["end"] - x["start"])
    return done.select(
        "doc_id", "n_bytes", gone.alias("n_removed"), F.size("spans").cast("bigint").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
        F.make_valid_utf8(F.col("kept").cast("string")).alias("text"),  # what is left; a cut may fall inside a character
    )


@query("op9_near_passages")
def op9_near_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of at least 50 words of every document that have a near-duplicate in another one."""
    return passages.near_passages(table(spark, sf_dir, "documents")).select(
        "doc_id", F.col("start").alias("start_word"), F.col("end").alias("end_word"), F.col("first").alias("first_doc_id")
    )


@query("op3_quality")
def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every document, and whether it is rejected."""
    return quality.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select(
        "doc_id", *(F.round(c, 6).alias(c) for c in ("junk", "toxic", "quality")), "rejected"
    )


@query("op10_licences")
def op10_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence families found in every document."""
    found = licences.scan(table(spark, sf_dir, "documents"))
    families = F.array_sort(F.array_distinct(F.transform("notices", lambda x: x["family"])))
    return found.select(
        "doc_id", "n_paragraphs", F.size("notices").cast("bigint").alias("n_notices"), F.array_join(families, ",").alias("families"),
        F.array_join(F.transform("notices", lambda x: x["paragraph"].cast("string")), ",").alias("paragraphs"),
    )


@query("op4_main_text")
def op4_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return templates.extract(table(spark, sf_dir, "pages")).select(
        "page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars")
    )


# ---------------------------------------------------------------- manifests, runs, near-duplicates by MinHash

#: The checksum of a decimal number: a byte at a time, bit by bit.
_CRC = """list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ord(c) AS BIGINT))),
 lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda x, k: CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END))"""
_CRC = f"(4294967295 - {_CRC})"
_PART = "coalesce(CAST(strlen(CAST({0} AS VARCHAR)) AS VARCHAR) || ':' || CAST({0} AS VARCHAR), '-')"


def _leaf_sql(text: str) -> str:
    return "sha256(" + " || ".join(_PART.format(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


MANIFEST_SQL = f"""
WITH RECURSIVE d AS (SELECT *, {_leaf_sql("text")} AS leaf,
  CASE WHEN {_CRC} % 2 = 0 THEN {_leaf_sql("replace(text, chr(10), '')")} ELSE {_leaf_sql("text")} END AS claim FROM documents),
l AS (SELECT row_number() OVER () AS id, doc_id, source, leaf, claim,
  row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM d),
t AS (SELECT source, 0 AS lvl, pos, n, leaf AS h FROM l
  UNION ALL
  SELECT source, lvl + 1, pos // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM t WHERE n > 1 GROUP BY source, lvl, pos // 3, n),
r AS (SELECT source, h AS subroot, lvl AS height, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM t WHERE n = 1),
u AS (SELECT 0 AS lvl, pos, n, subroot AS h FROM r
  UNION ALL
  SELECT lvl + 1, pos // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM u WHERE n > 1 GROUP BY lvl, pos // 3, n),
sib AS (SELECT x.source, x.lvl, x.pos, coalesce(string_agg(y.h, '' ORDER BY y.pos) FILTER (WHERE y.pos < x.pos), '') AS lhs,
  coalesce(string_agg(y.h, '' ORDER BY y.pos) FILTER (WHERE y.pos > x.pos), '') AS rhs
  FROM t x LEFT JOIN t y ON x.source IS NOT DISTINCT FROM y.source AND x.lvl = y.lvl AND x.pos // 3 = y.pos // 3 AND x.pos <> y.pos
  WHERE x.n > 1 GROUP BY x.source, x.lvl, x.pos),
tops AS (SELECT x.lvl, x.pos, coalesce(string_agg(y.h, '' ORDER BY y.pos) FILTER (WHERE y.pos < x.pos), '') AS lhs,
  coalesce(string_agg(y.h, '' ORDER BY y.pos) FILTER (WHERE y.pos > x.pos), '') AS rhs
  FROM u x LEFT JOIN u y ON x.lvl = y.lvl AND x.pos // 3 = y.pos // 3 AND x.pos <> y.pos WHERE x.n > 1 GROUP BY x.lvl, x.pos),
path AS (SELECT l.id, s.lvl AS step, s.lhs, s.rhs FROM l JOIN sib s ON l.source IS NOT DISTINCT FROM s.source AND s.pos = l.pos // CAST(pow(3, s.lvl) AS BIGINT)
  UNION ALL
  SELECT l.id, r.height + p.lvl, p.lhs, p.rhs FROM l JOIN r ON l.source IS NOT DISTINCT FROM r.source JOIN tops p ON p.pos = r.pos // CAST(pow(3, p.lvl) AS BIGINT)),
f AS (SELECT id, 0 AS step, claim AS h FROM l
  UNION ALL
  SELECT f.id, f.step + 1, sha256(p.lhs || f.h || p.rhs) FROM f JOIN path p ON p.id = f.id AND p.step = f.step),
root AS (SELECT h AS root FROM u WHERE n = 1)
SELECT l.doc_id, l.leaf, r.subroot, root.root,
  sha256(coalesce((SELECT string_agg(p.lhs || p.rhs, '' ORDER BY p.step) FROM path p WHERE p.id = l.id), '')) AS proof_sha256,
  (SELECT arg_max(f.h, f.step) FROM f WHERE f.id = l.id) AS folded_root,
  (SELECT arg_max(f.h, f.step) FROM f WHERE f.id = l.id) = root.root AS verified
FROM l JOIN r ON l.source IS NOT DISTINCT FROM r.source, root
"""


@query("op11_manifest", MANIFEST_SQL)
def op11_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, root and proof of every document, and whether a possibly tampered copy leads to the root."""
    m = merkle.manifest(table(spark, sf_dir, "documents"), claim=merkle.tampered())
    return merkle.prove(m).select(
        F.col("key").alias("doc_id"), "leaf", "subroot", "root", F.col("proof").alias("proof_sha256"),
        F.col("folded").alias("folded_root"), (F.col("folded") == F.col("root")).alias("verified"),
    )


_SOLID = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"

#: A run of period q has six or more words in a row that stand q words further on as well.
RUNS_SQL = f"""
WITH d AS (SELECT doc_id, coalesce({_SOLID.format("text")}, []) AS w, coalesce({_CRC}, 1) AS h FROM documents),
e AS (SELECT *, len(w) AS n, h // 10 AS g FROM d),
p AS (SELECT *, CASE WHEN n > 0 THEN g % n END AS a FROM e),
c AS (SELECT row_number() OVER () AS id, doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN
  list_transform(range(n), lambda i: CASE WHEN i < a THEN w[i + 1] ELSE w[a + (i - a) % (1 + (n - a) // (3 + g % 8)) + 1] END) ELSE w END AS w FROM p),
k AS (SELECT id, unnest(range(n - 5)) AS i, unnest(list_transform(range(n - 5), lambda i: list_slice(w, i + 1, i + 6))) AS gram FROM c WHERE n >= 12),
m AS (SELECT x.id, x.i, y.i - x.i AS q FROM k x JOIN k y ON x.id = y.id AND x.gram = y.gram AND x.i < y.i),
s AS (SELECT id, q, min(i) AS s, max(i) + 6 + q AS e FROM (SELECT *, i - row_number() OVER (PARTITION BY id, q ORDER BY i) AS isle FROM m) GROUP BY id, q, isle),
r AS (SELECT id, s AS start, e - s AS length, min(q) AS period FROM s WHERE e - s >= greatest(12, 2 * q) GROUP BY id, s, e),
gone AS (SELECT DISTINCT id, unnest(range(start + period, start + length)) AS i FROM r),
kept AS (SELECT id, string_agg(word, ' ' ORDER BY i) AS words FROM
  (SELECT id, unnest(range(n)) AS i, unnest(w) AS word FROM c) ANTI JOIN gone USING (id, i) GROUP BY id),
best AS (SELECT id, count(*) AS n_runs, arg_max(struct_pack(start := start, length := length, period := period), (length, -start, -period)) AS b,
  string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS listed FROM r GROUP BY id)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, b.start AS start, b.length AS length, b.period AS period,
  1000 * b.length // b.period AS exponent_milli, sha256(coalesce(listed, '')) AS runs_sha256, sha256(coalesce(words, '')) AS collapsed_sha256
FROM c LEFT JOIN best USING (id) LEFT JOIN kept USING (id)
"""


@query("op12_periodic_runs", RUNS_SQL)
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every document, of which a tenth get a tail that repeats itself, and the text without repetitions."""
    found = periodic.periodic_runs(table(spark, sf_dir, "documents"), prepare=periodic.looped)
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    listed = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    out = found.withColumn("best", best)
    return out.select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), (-F.col("best.start")).alias("start"),
        F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"),
        F.floor(1000 * F.col("best.length") / -F.col("best.period")).cast("bigint").alias("exponent_milli"),
        F.sha2(F.array_join(listed, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

NEAR_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce({_SOLID.format(_LOWER)}, []) AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(len(w) - 4), lambda i: array_to_string(list_slice(w, i + 1, i + 5), ' '))) END AS g FROM d),
c AS (SELECT sha256(array_to_string(list_sort(g), chr(10))) AS node, any_value(g) AS g, len(any_value(g)) AS n FROM s WHERE len(g) > 0 GROUP BY 1),
e AS (SELECT node, n, unnest(g) AS x FROM c),
i AS (SELECT a.node AS a, b.node AS b, a.n AS an, b.n AS bn, count(*) AS k FROM e a JOIN e b ON a.x = b.x AND a.node < b.node
  AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) GROUP BY ALL),
l AS (SELECT a, b FROM i WHERE 100 * k >= 85 * (an + bn - k)),
both_ways AS (SELECT a, b FROM l UNION SELECT b, a FROM l UNION SELECT node, node FROM c),
reach AS (SELECT a, b FROM both_ways UNION SELECT r.a, l.b FROM reach r JOIN both_ways l ON r.b = l.a),
named AS (SELECT doc_id, len(g) AS n_shingles, CASE WHEN len(g) > 0 THEN sha256(array_to_string(list_sort(g), chr(10))) END AS node FROM s),
low AS (SELECT node, min(doc_id) AS low FROM named WHERE node IS NOT NULL GROUP BY node),
comp AS (SELECT r.a AS node, min(low) AS component_id FROM reach r JOIN low ON r.b = low.node GROUP BY r.a)
SELECT doc_id, n_shingles, CASE WHEN n_shingles = 0 THEN doc_id ELSE component_id END AS component_id,
  n_shingles = 0 OR doc_id IS NOT DISTINCT FROM component_id AS kept FROM named LEFT JOIN comp USING (node)
"""


@query("op13_minhash_components", NEAR_SQL)
def op13_minhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate component of every document by its five-word shingles, and whether it is the one to keep."""
    found = neardup.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_shingles", F.col("component").alias("component_id"), "kept")
