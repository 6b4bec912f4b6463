"""The operators bound to the driver's tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from faultline.llm import align, audit, bpe, ctph, jaccard, lm, mixing, neardup, quality, repeats, rules, secrets, urls
from faultline.llm._cut import small_batches
from faultline.sources.tables import read_table

# Target weights of the languages' tokens.
TARGETS = {"en": 0.4, "de": 0.2, "es": 0.2, "fr": 0.2}


def vocabulary(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def word_bpe_path() -> str:
    return vocabulary("word_bpe_49k.json")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return bpe.digest(read_table(spark, sf_dir, "documents", "doc_id", "text"), word_bpe_path())


def op2_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return neardup.join(read_table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label"))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return secrets.report(read_table(spark, sf_dir, "documents", "doc_id", "text"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return quality.judged(read_table(spark, sf_dir, "documents", "doc_id", "text"), read_table(spark, sf_dir, "labels", "doc_id", "quality"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return mixing.rates(read_table(spark, sf_dir, "documents", "doc_id", "text", "lang"), read_table(spark, sf_dir, "labels", "doc_id"), TARGETS)


def op6_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return urls.judge(read_table(spark, sf_dir, "pages", "page_id", "url"))


def op7_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return lm.score(read_table(spark, sf_dir, "documents", "doc_id", "text"), every=True)


def op8_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return rules.judge(read_table(spark, sf_dir, "documents", "doc_id", "text"), read_table(spark, sf_dir, "labels", "doc_id", "quality"))


def op9_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return repeats.report(read_table(spark, sf_dir, "documents", "doc_id", "text"))


def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return jaccard.join(read_table(spark, sf_dir, "documents", "doc_id", "text"))


def op11_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return audit.audit(read_table(spark, sf_dir, "documents", "text", "lang", "source"))


def op12_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return ctph.edits(read_table(spark, sf_dir, "documents", "doc_id", "text"))


def op13_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    return align.report(docs, vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))


QUERIES = {q.__name__: q for q in (
    op1_bpe, op2_neardup, op3_secrets, op4_quality, op5_mixing, op6_urls, op7_lm, op8_rules, op9_repeats, op10_jaccard,
    op11_audit, op12_fingerprints, op13_align,
)}
ORACLE: dict[str, str] = {
    "op2_neardup": """
WITH RECURSIVE v AS (
  SELECT vec_id, label, [x::DOUBLE for x in embedding] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0 AND len([x for x in embedding if x <> 0]) > 0
), p AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b
  ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.93
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM embeddings
  UNION
  SELECT reach.a, p.b FROM reach JOIN p ON reach.b = p.a
)
SELECT e.vec_id, (SELECT count(*) FROM p WHERE p.a = e.vec_id) AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) c ON c.a = e.vec_id""",
    "op10_jaccard": """
WITH RECURSIVE w AS (
  SELECT doc_id, [x for x in regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+') if x <> ''] AS words FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) >= 5 THEN [array_to_string(words[i:i + 4], ' ') for i in range(1, len(words) - 3)]
                                      WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE [] END) AS g FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2
), p AS (SELECT i.a, i.b FROM i JOIN n x ON x.doc_id = i.a JOIN n y ON y.doc_id = i.b WHERE 100 * c >= 75 * (x.n + y.n - c)
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION
  SELECT reach.a, p.b FROM reach JOIN p ON reach.b = p.a
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) c ON c.a = d.doc_id""",
    "op11_audit": """
WITH d AS (SELECT row_number() OVER () AS r, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents
), t AS (
  SELECT r, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d
), k AS (SELECT lang, term, count(*) AS total FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 30
), c AS (SELECT lang, source, term, count(*) AS n FROM t GROUP BY lang, source, term
), v AS (SELECT lang, count(*) AS v, sum(total) AS all_n FROM k GROUP BY lang
), g AS (SELECT DISTINCT lang, source FROM d
), s AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, k.total FROM g JOIN k ON k.lang = g.lang
  LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), n AS (SELECT lang, source, sum(n) AS n FROM s GROUP BY lang, source
), p AS (
  SELECT s.lang, s.source, s.term, s.n, 1 + (1000000000::HUGEINT * (s.n + 5)) // (n.n + 5 * v.v) AS p, 1 + (1000000000::HUGEINT * (s.total + 5)) // (v.all_n + 5 * v.v) AS q
  FROM s JOIN n ON n.lang = s.lang AND n.source = s.source JOIN v ON v.lang = s.lang
), f AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (
    SELECT a.lang, a.source, b.source AS other, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
  ) x ON x.lang = a.lang AND x.source = a.source AND x.other = b.source
  UNION ALL
  SELECT lang, source, 'term', term, (p - q)::BIGINT FROM p WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, value, rank::INT AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank FROM f
) WHERE part = 'pair' OR rank <= 50""",
}
