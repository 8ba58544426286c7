"""Registered queries: each operator over its whole table, and SQL where SQL can say the same."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm import (
    decontamination,
    embedding_dedup,
    hard_negatives,
    neardup,
    packing,
    pattern_packing,
    prefix_trie,
    quality,
    sanitise,
    substring_dedup,
    token_counts,
    toxicity,
    warc,
)
from tallyframe.llm.shared import crc_remainder


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    out = decontamination.decontaminate(
        _table(spark, folder, "documents"), _table(spark, folder, "benchmark"), keep=["doc_id"]
    )
    return out.select(
        F.col("row.doc_id").alias("doc_id"),
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


def op2_warc_derivatives(spark: SparkSession, folder: str) -> DataFrame:
    return warc.derivatives(warc.responses(_table(spark, folder, "pages")), keep=["page_id"])


def op3_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    path = public_tokenizers.path("piece_bpe_32k.model")
    out = token_counts.count_tokens(_table(spark, folder, "documents"), path, keep=["doc_id"])
    return out.select(F.col("row.doc_id").alias("doc_id"), "n_bytes", "n_tokens", "over_limit")


def _scored(out: DataFrame, divisor: int, held: int) -> DataFrame:
    doc_id = F.col("row.doc_id")
    return out.select(
        doc_id.alias("doc_id"), (crc_remainder(doc_id, divisor) == held).alias("held_out"), "score", "predicted"
    )


def op4_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = _table(spark, folder, "documents"), _table(spark, folder, "labels")
    return _scored(quality.rate(docs, labels, lambda i: crc_remainder(i, 4) != 2, keep=["doc_id"]), 4, 2)


def op5_packing(spark: SparkSession, folder: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    return packing.pack(_table(spark, folder, "documents"), path, with_ids=False).drop("ids")


def op6_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, folder, "documents"))


def op7_embedding_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return embedding_dedup.near_duplicates(_table(spark, folder, "embeddings"))


def op8_repeated_strings(spark: SparkSession, folder: str) -> DataFrame:
    out = substring_dedup.removed(_table(spark, folder, "documents"), with_text=False)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op9_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    out = sanitise.personal_data(_table(spark, folder, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return out.select(
        "doc_id",
        *[count(i).alias(f"n_{kind}") for i, kind in enumerate(sanitise.KINDS[:4])],
        F.sha2(sanitise.listed(F.col("base")), 256).alias("base_sha256"),
        sanitise.listed(F.col("spans")).alias("spans"),
    )


def op10_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = _table(spark, folder, "documents"), _table(spark, folder, "labels")
    return _scored(toxicity.rate(docs, labels, lambda i: crc_remainder(i, 5) != 0, keep=["doc_id"]), 5, 0)


def op11_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    rows = hard_negatives.usable(_table(spark, folder, "embeddings"))
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(rows.withColumn("label", shifted), F.col("vec_id") % 50 == 0)


def op12_conversation_trie(spark: SparkSession, folder: str) -> DataFrame:
    return prefix_trie.rebuilt_trie(_table(spark, folder, "conversations"))


def op13_pattern_packing(spark: SparkSession, folder: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    return pattern_packing.pack(_table(spark, folder, "documents"), path, with_ids=False).drop("ids")


def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, folder)


def queries() -> dict:
    own = [
        op1_benchmark_decontamination,
        op2_warc_derivatives,
        op3_token_counts,
        op4_quality,
        op5_packing,
        op6_near_duplicates,
        op7_embedding_near_duplicates,
        op8_repeated_strings,
        op9_personal_data,
        op10_toxicity,
        op11_hard_negatives,
        op12_conversation_trie,
        op13_pattern_packing,
        pipeline,
    ]
    return {f.__name__: f for f in own}


#: The windows of the items, joined with those of the documents, one length at a time.
OP1 = r"""
WITH items AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
sized AS (SELECT item_id, words, least(len(words), 13) AS w FROM items WHERE len(words) > 0),
windows AS (
  SELECT DISTINCT item_id, w, array_to_string(words[i:i + w - 1], ' ') AS gram
  FROM (SELECT item_id, words, w, unnest(range(1, len(words) - w + 2)) AS i FROM sized)),
docs AS (
  SELECT doc_id,
         coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS words
  FROM documents),
grams AS (
  SELECT doc_id, w, i, array_to_string(words[i:i + w - 1], ' ') AS gram
  FROM (SELECT doc_id, words, w, unnest(range(1, len(words) - w + 2)) AS i
        FROM docs, (SELECT DISTINCT w FROM sized) WHERE len(words) >= w)),
found AS (SELECT g.doc_id, g.w, g.i, n.item_id FROM grams g JOIN windows n ON g.w = n.w AND g.gram = n.gram),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit
        FROM (SELECT doc_id, unnest(range(i, i + w)) AS p FROM found) GROUP BY doc_id),
named AS (SELECT doc_id, count(DISTINCT item_id) AS n_items,
                 array_to_string(list_sort(list(DISTINCT item_id)), ',') AS items FROM found GROUP BY doc_id)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(words) AS contaminated
FROM docs LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
"""

#: The cosine of all pairs, and the closure of the links.
OP7 = """
WITH RECURSIVE usable AS (
  SELECT vec_id, [CAST(x AS DOUBLE) FOR x IN embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len([1 FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
    AND len([1 FOR x IN embedding IF x <> 0]) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b
  ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.9),
reached(vec_id, other) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT r.vec_id, l.b FROM reached r JOIN links l ON r.other = l.a),
least_id AS (SELECT vec_id, min(other) AS component_id FROM reached GROUP BY vec_id),
counts AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings LEFT JOIN counts USING (vec_id) LEFT JOIN least_id USING (vec_id)
"""


#: All pairs that share a shingle, by their number of common ones, and the closure of the links.
OP6 = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (
  SELECT c.a, c.b FROM common c JOIN sizes x ON x.doc_id = c.a JOIN sizes y ON y.doc_id = c.b WHERE 100 * c.n >= 85 * (x.n + y.n - c.n)),
reached(doc_id, other) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.b FROM reached r JOIN links l ON r.other = l.a),
least_id AS (SELECT doc_id, min(other) AS component_id FROM reached GROUP BY doc_id)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, doc_id = component_id AS kept
FROM documents LEFT JOIN sizes USING (doc_id) LEFT JOIN least_id USING (doc_id)
"""

#: Every 50-byte string with the smallest id that holds it, in hexadecimal digits.
OP8 = """
WITH bytes AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
parts AS (
  SELECT doc_id, n, k, substr(h, CAST(200 * k + 1 AS BIGINT), 300) AS part
  FROM (SELECT doc_id, h, n, unnest(range(0, (n - 49 + 99) // 100)) AS k FROM bytes WHERE n >= 50)),
strings AS (
  SELECT doc_id, 100 * k + j AS i, substr(part, CAST(2 * j + 1 AS BIGINT), 100) AS s
  FROM (SELECT doc_id, k, part, unnest(range(0, least(100, n - 49 - 100 * k))) AS j FROM parts)),
firsts AS (SELECT s, min(doc_id) AS first_id FROM strings GROUP BY s),
found AS (SELECT t.doc_id, t.i FROM strings t JOIN firsts f ON t.s = f.s AND t.doc_id > f.first_id),
marked AS (
  SELECT doc_id, i, CASE WHEN i - lag(i) OVER w <= 50 THEN 0 ELSE 1 END AS opens FROM found WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
numbered AS (SELECT doc_id, i, sum(opens) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM marked),
spans AS (SELECT doc_id, span, min(i) AS a, max(i) + 50 AS b FROM numbered GROUP BY doc_id, span),
gaps AS (
  SELECT s.doc_id, s.a, s.b, s.span, coalesce(lag(s.b) OVER (PARTITION BY s.doc_id ORDER BY s.a), 0) AS since FROM spans s),
kept AS (
  SELECT g.doc_id, sum(g.b - g.a) AS n_removed, count(*) AS n_spans, max(g.b) AS last,
         string_agg(substr(b.h, CAST(2 * g.since + 1 AS BIGINT), CAST(2 * (g.a - g.since) AS BIGINT)), '' ORDER BY g.a) AS h
  FROM gaps g JOIN bytes b USING (doc_id) GROUP BY g.doc_id)
SELECT b.doc_id, CAST(b.n AS BIGINT) AS n_bytes, CAST(coalesce(k.n_removed, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(k.n_spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(coalesce(k.h, '') || substr(b.h, CAST(2 * coalesce(k.last, 0) + 1 AS BIGINT)))) AS kept_sha256
FROM bytes b LEFT JOIN kept k USING (doc_id)
"""

#: The scores of all anchors with all rows.
OP11 = """
WITH used AS (
  SELECT vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label,
         [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len([1 FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
scores AS (
  SELECT a.vec_id AS anchor, b.vec_id AS id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM used a JOIN used b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v)),
positives AS (
  SELECT anchor, id, score FROM scores WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, id) <= 5),
ranked AS (
  SELECT p.anchor AS anchor_id, p.id AS positive_id,
         CAST(row_number() OVER (PARTITION BY p.anchor, p.id ORDER BY n.score DESC, n.id) AS INTEGER) AS rank,
         n.id AS negative_id, p.score AS positive_score, n.score AS negative_score
  FROM positives p JOIN scores n ON n.anchor = p.anchor AND NOT n.same
    AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score)
SELECT * FROM ranked WHERE rank <= 3
"""

#: Every start of every rebuilt conversation by the digests of its turns; crc32 bit by bit.
OP12 = """
WITH own AS (
  SELECT CAST(conv_id AS BIGINT) AS conv_id,
         list({'k': md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || ':' || coalesce(text, '')),
               'n': strlen(coalesce(text, ''))} ORDER BY turn NULLS FIRST, role, text) AS turns
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY ALL),
sums AS (
  SELECT *, list_reduce(list_prepend(4294967295, [CAST(ord(c) AS BIGINT) FOR c IN string_split(CAST(conv_id AS VARCHAR), '')]),
    lambda v, b: list_reduce(list_prepend(xor(v, b), range(8)),
      lambda w, i: CASE WHEN w % 2 = 1 THEN xor(w >> 1, 3988292384) ELSE w >> 1 END)) AS crc FROM own),
heads AS (SELECT *, xor(crc, 4294967295) % 9 AS h, conv_id - conv_id % 5 AS base FROM sums),
built AS (
  SELECT a.conv_id, list_concat(coalesce(b.turns, [])[1:a.h], a.turns[a.h + 1:]) AS turns
  FROM heads a LEFT JOIN own b ON b.conv_id = a.base),
starts AS (
  SELECT conv_id, d, len(turns) AS size, array_to_string([t.k FOR t IN turns[1:d]], ',') AS node,
         array_to_string([t.k FOR t IN turns[1:d - 1]], ',') AS above, CASE WHEN d = 0 THEN 0 ELSE turns[d].n END AS bytes
  FROM (SELECT conv_id, turns, unnest(range(0, len(turns) + 1)) AS d FROM built)),
nodes AS (
  SELECT d, node, any_value(above) AS above, any_value(bytes) AS bytes, min(conv_id) AS conv_id, count(*) AS n_convs,
         array_to_string(list(conv_id ORDER BY conv_id) FILTER (size = d), ',') AS ends
  FROM starts GROUP BY d, node),
children AS (SELECT d - 1 AS d, above AS node, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY ALL),
counted AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM nodes n LEFT JOIN children c USING (d, node)),
below AS (
  SELECT s.d, s.node, count(*) FILTER (u.n_children = 0) AS n_leaves, sum((u.n_convs - 1) * u.bytes) AS saved
  FROM counted u JOIN starts s ON s.conv_id = u.conv_id AND s.d <= u.d GROUP BY ALL)
SELECT n.conv_id, n.d AS depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, n_leaves,
       CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(n.ends, '')) AS ends_sha256
FROM counted n JOIN below USING (d, node) LEFT JOIN nodes p ON n.d > 0 AND p.d = n.d - 1 AND p.node = n.above
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_benchmark_decontamination": OP1,
        "op6_near_duplicates": OP6,
        "op7_embedding_near_duplicates": OP7,
        "op8_repeated_strings": OP8,
        "op11_hard_negatives": OP11,
        "op12_conversation_trie": OP12,
    }
