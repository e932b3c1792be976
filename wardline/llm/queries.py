"""The registered queries of the operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(run: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return run

    return add


def vocabulary() -> str:
    """The file of the public vocabulary that the packing query names."""
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


OP3_SQL = r"""
WITH u AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), h AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u
), r(rh, rp, kind) AS (VALUES {rules}),
m AS (
  SELECT page_id, host, path, rh || rp AS key, kind FROM h LEFT JOIN r
  ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)
)
SELECT page_id, host, path,
  max_by(key, length(key) * 2 + (CASE kind WHEN 'allow' THEN 1 ELSE 0 END)) FILTER (kind IN ('allow', 'block')) AS rule,
  COALESCE(max_by(kind, length(key) * 2 + (CASE kind WHEN 'allow' THEN 1 ELSE 0 END)) FILTER (kind IN ('allow', 'block')),
           CASE WHEN count(*) FILTER (kind = 'listed') > 0 THEN 'block' ELSE 'allow' END) AS verdict
FROM m GROUP BY page_id, host, path
"""


def _op3_sql() -> str:
    from wardline.llm.urls import ALLOW_RULES, BLOCK_RULES, LISTED

    rows = [(*k.partition("/")[::2], kind) for kind, keys in (("block", BLOCK_RULES), ("allow", ALLOW_RULES), ("listed", LISTED)) for k in keys]
    return OP3_SQL.replace("{rules}", ", ".join(f"('{h}', '/{p}', '{k}')" for h, p, k in rows))


@query("op3_url_filters", _op3_sql())
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wardline.llm.urls import judge_urls

    pages = table(spark, sf_dir, "pages")
    return judge_urls(pages.select("page_id", "url")).select("page_id", "judged.*")


@query("op4_packing")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wardline.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"), vocabulary(), with_ids=False)


@query("op8_exact_dedup", r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256 FROM n
""")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wardline.llm.dedup import deduplicate

    return deduplicate(table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256")


OP9_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size, md5(CAST(doc_id AS VARCHAR)) AS draw FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM d GROUP BY source
), w AS (
  SELECT *, CASE rank % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight FROM s
), c AS (
  SELECT *, 2 * source_size AS cap, source_size * (6 // weight) AS fill FROM w
), l AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - (sum(cap) OVER (ORDER BY fill, rank) - cap)) / (sum(weight) OVER () - (sum(weight) OVER (ORDER BY fill, rank) - weight))::DOUBLE AS level FROM c
), t AS (
  SELECT l.*, least(cap::DOUBLE, weight * (SELECT min_by(level, (fill, rank)) FROM l WHERE level * weight <= cap)) AS target FROM l
), p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.rank % 3 AS kind, CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY draw, d.doc_id) - d.size AS BIGINT) AS b
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
), e AS (
  SELECT *, greatest(least(CAST(floor(target) AS BIGINT) - b, size), 0) AS w1, greatest(least(CAST(floor(target) AS BIGINT) - b - source_size, size), 0) AS w2,
    [1.5, 1.0, 0.5][kind + 1]::DOUBLE AS early, [0.625, 0.5, 0.375][kind + 1]::DOUBLE AS half, [-1.0, 0.0, 1.0][kind + 1]::DOUBLE AS slope FROM p
), m AS (
  SELECT *, CASE WHEN w1 > 0 THEN least((b + w1 / 2.0::DOUBLE) / target, 1.0) END AS m1, CASE WHEN w2 > 0 THEN least((b + source_size + w2 / 2.0::DOUBLE) / target, 1.0) END AS m2 FROM e
)
SELECT doc_id, size, source_size, target, CAST(w1 + w2 AS BIGINT) AS taken, CAST((w1 > 0)::INT + (w2 > 0)::INT AS BIGINT) AS copies,
  {position_1} AS position_1, {position_2} AS position_2 FROM m
"""


def _op9_sql() -> str:
    """The demand of a source is quadratic in each half of the training; it is solved for the middle of each copy."""
    inverse = """round(CASE WHEN {m} <= half THEN 2 * {m} / (early + sqrt(greatest(early * early + 2 * slope * {m}, 0)))
    ELSE 0.5 + 2 * ({m} - half) / (1 + sqrt(greatest(1 + 2 * slope * ({m} - half), 0))) END + 1e-9, 6)"""
    return OP9_SQL.replace("{position_1}", inverse.replace("{m}", "m1")).replace("{position_2}", inverse.replace("{m}", "m2"))


@query("op9_mixing", _op9_sql())
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wardline.llm.mixing import curriculum, in_training_order

    rows = in_training_order(curriculum(table(spark, sf_dir, "documents")))
    positions = [F.round(F.try_element_at("copies", F.lit(i))["position"] + F.lit(1e-9), 6).alias(f"position_{i}") for i in (1, 2)]
    return rows.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", F.size("copies").cast("long").alias("copies"), *positions)


@query("op5_jaccard_join")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wardline.llm.jaccard import jaccard_classes

    return jaccard_classes(table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "class_id", "links")


@query("op10_language_id")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wardline.llm.language import identify

    return identify(table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "lang", "posterior", F.col("identified").alias("kept"))


@query("op6_substring_dedup")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wardline.llm.substring import repeated_passages

    return repeated_passages(table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "start", "stop", "cluster", "removed")


OP7_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.q::DOUBLE[], b.q::DOUBLE[]) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""


@query("op7_topk_search", OP7_SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wardline.llm.topk import top_k

    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


@query("op1_quality_classifier")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wardline.llm.quality import quality

    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select(F.col("id").alias("doc_id"), "evidence", "host_rate", "path_rate", "score", "kept")


@query("op2_toxicity")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wardline.llm.toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select(F.col("id").alias("doc_id"), "held_out", "score", "predicted")


def _op11_sql() -> str:
    from wardline.llm.rules import FENCE, LEAST_DOCUMENTS, MEASURES

    def bucket(v: str) -> str:
        return f"CASE WHEN {v} < 32 THEN {v} ELSE (length(bin({v})) - 6) * 32 + ({v} >> (length(bin({v})) - 6)) END"

    def low(b: str) -> str:
        return f"CASE WHEN {b} < 32 THEN {b} ELSE ({b} % 32 + 32) << CAST({b} // 32 - 1 AS BIGINT) END"

    def high(b: str) -> str:
        return f"CASE WHEN {b} < 32 THEN {b} ELSE (({b} % 32 + 33) << CAST({b} // 32 - 1 AS BIGINT)) - 1 END"

    shares = " UNION ALL ".join(f"SELECT rn, base_failed, lang, source, '{m}' AS measure, {s} AS slack, 1000 * {a} // greatest({b}, 1) AS v FROM base" for m, a, b, s in MEASURES)
    return rf"""
WITH d AS (
  SELECT row_number() OVER () AS rn, doc_id, lang, source, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d
), g AS (
  SELECT rn, unnest(generate_series(1, len(ws) - 7)) AS p, unnest(list_transform(generate_series(1, len(ws) - 7), lambda i: array_to_string(ws[i:i + 7], ' '))) AS words FROM w WHERE len(ws) > 7
), r AS (
  SELECT rn, p, count(*) OVER (PARTITION BY rn, words) AS times FROM g
), c AS (
  SELECT rn, count(DISTINCT q) AS n_repeat_words FROM (SELECT rn, unnest(generate_series(p, p + 7)) AS q FROM r WHERE times > 1) GROUP BY rn
), base AS (
  SELECT w.rn, doc_id, lang, source, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
    len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
    coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, len(ls)::BIGINT AS n_lines,
    len(ws) < 20 OR 100 * coalesce(n_repeat_words, 0) > 30 * len(ws) AS base_failed
  FROM w LEFT JOIN c ON w.rn = c.rn
), v AS (
  {shares}
), b AS (
  SELECT lang, source, measure, slack, {bucket("v")} AS bucket, count(*) AS n FROM v WHERE NOT base_failed GROUP BY ALL
), s AS (
  SELECT lang, source, 0 AS level, measure, slack, bucket, n FROM b
  UNION ALL SELECT lang, NULL, 1, measure, slack, bucket, sum(n) FROM b GROUP BY ALL
  UNION ALL SELECT NULL, NULL, 2, measure, slack, bucket, sum(n) FROM b GROUP BY ALL
), k AS (
  SELECT *, sum(n) OVER (PARTITION BY level, lang, source, measure ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY level, lang, source, measure) AS total FROM s
), q AS (
  SELECT level, lang, source, measure, slack, max(total) AS documents, min(bucket) FILTER (4 * upto >= total) AS q1,
    min(bucket) FILTER (4 * upto >= 2 * total) AS q2, min(bucket) FILTER (4 * upto >= 3 * total) AS q3 FROM k GROUP BY ALL
), f AS (
  SELECT *, ({low("q2")}) - greatest({FENCE} * (({high("q2")}) - ({low("q1")})), slack) AS low,
    ({high("q2")}) + greatest({FENCE} * (({high("q3")}) - ({low("q2")})), slack) AS high FROM q
), j AS (
  SELECT v.rn, string_agg(v.measure, ',' ORDER BY CASE v.measure WHEN 'word_length' THEN 1 WHEN 'symbols' THEN 2 WHEN 'dup_lines' THEN 3 ELSE 4 END)
    FILTER (CASE WHEN o.documents >= {LEAST_DOCUMENTS} THEN v.v < o.low OR v.v > o.high
                 WHEN l.documents >= {LEAST_DOCUMENTS} THEN v.v < l.low OR v.v > l.high ELSE v.v < a.low OR v.v > a.high END) AS why
  FROM v LEFT JOIN f o ON o.level = 0 AND o.measure = v.measure AND o.lang IS NOT DISTINCT FROM v.lang AND o.source IS NOT DISTINCT FROM v.source
  LEFT JOIN f l ON l.level = 1 AND l.measure = v.measure AND l.lang IS NOT DISTINCT FROM v.lang
  LEFT JOIN f a ON a.level = 2 AND a.measure = v.measure
  WHERE NOT v.base_failed GROUP BY v.rn
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  CASE WHEN base_failed THEN 'base' ELSE coalesce(why, '') END AS reasons, NOT base_failed AND why IS NULL AS kept
FROM base LEFT JOIN j ON base.rn = j.rn
"""


@query("op11_quality_rules", _op11_sql())
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wardline.llm.rules import quality_rules

    return quality_rules(table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "reasons", "kept")


@query("op13_embedding_whitening")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wardline.llm.whitening import whitened_embeddings

    return whitened_embeddings(table(spark, sf_dir, "embeddings")).select(
        F.col("id").alias("vec_id"), "component", "n", F.col("deviation").try_cast("bigint").alias("deviation"), "whitened", "explained", "identity_error")


@query("op12_phrase_collocation", r"""
WITH d AS (
  SELECT row_number() OVER () AS doc, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), p AS (
  SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d
), w AS (
  SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p
), g AS (
  SELECT lang, size, unnest(list_transform(generate_series(1, len(ws) - size + 1), lambda i: array_to_string(ws[i:i + size - 1], ' '))) AS phrase
  FROM w, (VALUES (1), (2), (3)) AS s(size) WHERE len(ws) >= size
), f AS (
  SELECT lang, size, phrase, lang || chr(10) || phrase AS key, count(*) AS a FROM g GROUP BY ALL
), n AS (
  SELECT lang, sum(a)::BIGINT AS n FROM f WHERE size = 1 GROUP BY lang
), c AS (
  SELECT *, string_split(phrase, ' ') AS ws FROM f WHERE size > 1 AND a >= 10
), k AS (
  SELECT c.lang, c.size, c.phrase, c.a, cut, x.a AS l, y.a AS r, ((1000000::HUGEINT * c.a * c.a) // (x.a::HUGEINT * y.a))::BIGINT AS score
  FROM (SELECT *, unnest(generate_series(1, size - 1)) AS cut FROM c) c
  JOIN f x ON x.key = c.lang || chr(10) || array_to_string(ws[1:cut], ' ') JOIN f y ON y.key = c.lang || chr(10) || array_to_string(ws[cut + 1:], ' ')
), b AS (
  SELECT lang, size, phrase, any_value(a) AS a, min_by(l, (score, cut)) AS l, min_by(r, (score, cut)) AS r, min(score) AS score FROM k GROUP BY lang, size, phrase
), o AS (
  SELECT lang, part, max(a) AS most FROM (
    SELECT lang, a, array_to_string(ws[1:2], ' ') AS part FROM c WHERE size = 3 UNION ALL SELECT lang, a, array_to_string(ws[2:3], ' ') FROM c WHERE size = 3) GROUP BY ALL
), q AS (
  SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank
  FROM b LEFT JOIN o ON b.size = 2 AND o.lang = b.lang AND o.part = b.phrase WHERE most IS NULL OR 100 * most < 50 * a
)
SELECT q.lang, rank, phrase, a, l, r, n, score FROM q JOIN n ON q.lang = n.lang WHERE rank <= 2000
""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    from wardline.llm.collocation import collocations

    return collocations(table(spark, sf_dir, "documents"))
