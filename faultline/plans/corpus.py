"""Corpus operators bound to the driver tables: encoding, de-duplication,
chunking, corpus statistics and path rules.

``documents`` stands for source files (``source`` ~ project); ``pages.url``
for file paths; ``benchmark`` passages for failure descriptions to search with.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.functions import encode as E
from faultline.functions import text as T
from faultline.operators import embed, segment
from faultline.operators.knn import knn_join
from faultline.sources import files as S
from faultline.sources.tables import read_table

DIM = E.DEFAULT_DIM
CHUNK_SIZE = 2000
PASSAGE_K = 5
MIN_GROUP = 20
SEG_WINDOW = 20
# Ignore rules applied to page paths (gitwildmatch syntax).
IGNORE_RULES = ["# generated pages", "*.html  ", "!/en/1*.html", "fr/", "**/de/7*", "", "es/[!0-4]*", "e**n/2[0-2]?", "\\!x"]


def _docs(spark, sf, *cols):
    return read_table(spark, sf, "documents", *cols)


def _r6(c):
    return F.round(c, 6)


def hash_encode(spark: SparkSession, sf: str) -> DataFrame:
    """UDTF-13/AGG-18: every document encoded directly (no de-duplication)."""
    s = E.hash_counts(_docs(spark, sf, "doc_id", "text"), ["doc_id"], "text", DIM)
    return s.select("doc_id", "dim", _r6("value").alias("value"))


def embed_once_fanout(spark: SparkSession, sf: str) -> DataFrame:
    """JON-04: encode each distinct text once, fan vectors out to every document."""
    d = embed.embed_once(_docs(spark, sf, "doc_id", "text"), "text")
    s = embed.sparse(d, ["doc_id"])
    return s.select("doc_id", "dim", _r6("value").alias("value"))


def text_usage(spark, sf):
    return embed.text_usage(_docs(spark, sf, "doc_id", "text", "source"), "text", "doc_id", by=["source"])


def content_hash_match(spark, sf):
    return embed.canonical_by_hash(_docs(spark, sf, "doc_id", "text"), "text", "doc_id")


def masked_mean_pool(spark, sf):
    """AGG-18 as a distributed aggregate: per source, the mean vector of its
    documents with the quality label as mask (unlabelled → 0)."""
    d = _docs(spark, sf, "doc_id", "source", "text")
    lab = read_table(spark, sf, "labels", "doc_id", "quality")
    v = embed.embed_once(d, "text").join(lab, "doc_id", "left")
    m = F.coalesce(F.col("quality"), F.lit(0)).cast("double")
    x = v.select("source", m.alias("m"), F.posexplode("embedding").alias("dim", "v"))
    return x.groupBy("source", F.col("dim").cast("int").alias("dim")).agg(
        _r6(F.sum(F.col("v") * F.col("m")) / F.greatest(F.sum("m"), F.lit(1e-9))).alias("value")
    )


def retrieve_passages(spark, sf):
    """Encode benchmark passages and documents; K nearest documents by cosine."""
    q = E.hash_vectors(read_table(spark, sf, "benchmark", "item_id", "text"), ["item_id"], "text", DIM)
    c = embed.embed_once(_docs(spark, sf, "doc_id", "text"), "text").select("doc_id", "embedding")
    return knn_join(q, c, k=PASSAGE_K, query_id="item_id", corpus_id="doc_id", metric="cosine", out_id="doc_id")


def query_text_strategies(spark, sf):
    """PRJ-02: code = text, symptom = lang, trace = source."""
    d = _docs(spark, sf, "doc_id", "lang", "source", "text")
    x = d.withColumn("strategy", F.explode(F.array(*[F.lit(s) for s in ("code_only", "error_info", "full")])))
    q = segment.query_text(F.col("strategy"), F.col("text"), F.col("lang"), F.col("source"))
    return x.select("doc_id", "strategy", F.length(q).cast("bigint").alias("n_chars"), F.md5(q).alias("query_md5"))


def fixed_chunks(spark, sf):
    c = segment.fixed_chunks(_docs(spark, sf, "doc_id", "text"), ["doc_id"], "text", CHUNK_SIZE)
    return c.select("doc_id", "chunk_no", F.length("chunk").cast("bigint").alias("chunk_len"), F.md5("chunk").alias("chunk_md5"))


def min_cost_segments(spark, sf):
    """UDTF-03: segment each document's lines; a chunk ending with a short
    line (< 40 characters, a paragraph end) costs 3, any other end 10."""
    d = _docs(spark, sf, "doc_id", "text")
    ln = d.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    br = ln.where(F.length("line") < 40).select("doc_id", (F.col("pos") + 1).alias("line_no"), F.lit(3.0).alias("cost"))
    return segment.min_cost_segments(d, br, window=SEG_WINDOW, general_cost=10.0)


def line_stats(spark, sf):
    """AGG-11: lines per file, per project."""
    d = _docs(spark, sf, "source", "text").select("source", T.n_parts(F.col("text")).alias("n"))
    return d.groupBy("source").agg(
        F.min("n").alias("min_lines"), F.max("n").alias("max_lines"), _r6(F.avg("n")).alias("avg_lines"),
        F.count(F.lit(1)).cast("bigint").alias("n_files"),
    )


def _kept_pages(spark, sf):
    p = read_table(spark, sf, "pages", "page_id", "url", "html")
    return p.where(F.col("url").contains("example.com") & ~F.col("url").contains(".html"))


def total_lines(spark, sf):
    """AGG-13: readlines-count total over names containing one text and not another."""
    return _kept_pages(spark, sf).agg(
        F.count(F.lit(1)).cast("bigint").alias("n_files"),
        F.sum(T.n_readlines(F.col("html"))).cast("bigint").alias("total_lines"),
    )


def counted_files(spark, sf):
    """AGG-13's file list as rows (one a file, so it never gathers in one place)."""
    return _kept_pages(spark, sf).select("page_id", "url", T.n_readlines(F.col("html")).cast("bigint").alias("n_lines"))


def substring_counts(spark, sf):
    """SCA-12: how often a text holds ``th``."""
    return _docs(spark, sf, "doc_id", "text").select("doc_id", T.count_substr(F.col("text"), "th").alias("n"))


def usage_rows(spark, sf):
    """AGG-15: each use of a text by a project."""
    return embed.usage_rows(_docs(spark, sf, "doc_id", "text", "source"), "text", ["source", "doc_id"])


def dedup_ratio(spark, sf):
    return embed.dedup_ratio(_docs(spark, sf, "text"), "text")


def single_item_filter(spark, sf):
    """FLT-01/02: conversations with exactly one user turn and a non-empty
    last assistant reply."""
    c = read_table(spark, sf, "conversations", "conv_id", "turn", "role", "text")
    per = c.groupBy("conv_id").agg(
        F.count_if(F.col("role") == "user").alias("n_user"),
        F.max_by(F.when(F.col("role") == "assistant", F.col("text")),
                 F.when(F.col("role") == "assistant", F.col("turn"))).alias("reply"),
        F.count(F.lit(1)).cast("bigint").alias("n_turns"),
    )
    return per.where((F.col("n_user") == 1) & (F.coalesce(T.py_strip(F.col("reply")), F.lit("")) != "")).select(
        "conv_id", "n_turns"
    )


def min_group_size(spark, sf):
    """FLT-07: projects with at least 20 bugs (sources with >= 20 documents)."""
    n = _docs(spark, sf, "source").groupBy("source").agg(F.count(F.lit(1)).cast("bigint").alias("n_docs"))
    return n.where(F.col("n_docs") >= MIN_GROUP)


def _page_paths(spark, sf):
    p = read_table(spark, sf, "pages", "page_id", "url")
    return p.select("page_id", F.regexp_extract("url", r"^[a-z]+://[^/]+/([^?#]*)", 1).alias("path"))


def path_filters(spark, sf):
    """SRC-03/04, PRJ-01: visible paths with a web-page extension."""
    p = _page_paths(spark, sf)
    mapping = {"web": [".html"]}
    keep = S.is_visible(F.col("path")) & S.has_language(F.col("path"), "web", mapping)
    return p.where(keep).select("page_id", "path", T.basename(F.col("path")).alias("basename"),
                                S.extension(F.col("path")).alias("ext"))


def ignore_rules(spark, sf):
    rules = S.compile_rules(IGNORE_RULES)
    p = _page_paths(spark, sf)
    return p.select("page_id", "path", S.ignored(F.col("path"), rules).alias("ignored"))


def latest_content_lookup(spark, sf):
    """SRC-06: look up page content for every labelled document id."""
    wanted = read_table(spark, sf, "labels", "doc_id")
    snap = read_table(spark, sf, "pages", "page_id", "html").withColumnRenamed("page_id", "doc_id")
    r = S.lookup_content(wanted, snap, ["doc_id"], "html")
    return r.select("doc_id", "found", F.length("html").cast("bigint").alias("n_chars"))


QUERIES = {
    "hash_encode": hash_encode,
    "embed_once_fanout": embed_once_fanout,
    "text_usage": text_usage,
    "content_hash_match": content_hash_match,
    "masked_mean_pool": masked_mean_pool,
    "retrieve_passages": retrieve_passages,
    "query_text_strategies": query_text_strategies,
    "fixed_chunks": fixed_chunks,
    "min_cost_segments": min_cost_segments,
    "line_stats": line_stats,
    "total_lines": total_lines,
    "counted_files": counted_files,
    "usage_rows": usage_rows,
    "substring_counts": substring_counts,
    "dedup_ratio": dedup_ratio,
    "single_item_filter": single_item_filter,
    "min_group_size": min_group_size,
    "path_filters": path_filters,
    "ignore_rules": ignore_rules,
    "latest_content_lookup": latest_content_lookup,
}

_BKT = "('0x' || substr(md5(t), 1, 4))::INTEGER % 64"
_TOK = "list_filter(regexp_split_to_array(lower({x}), '[^\\p{{L}}\\p{{N}}_]+'), lambda t: t <> '')"
_SPARSE = f"""
tok AS (SELECT doc_id, {_TOK.format(x='text')} AS toks FROM documents),
b AS (SELECT doc_id, len(toks) AS n, unnest(list_transform(toks, lambda t: {_BKT})) AS dim FROM tok),
sp AS (SELECT doc_id, CAST(dim AS INTEGER) AS dim, count(*) / max(n) AS value FROM b GROUP BY doc_id, dim)"""


# What the rules mean, written out by hand: (regex, ignored), the last that matches decides.
_IGNORED = [
    (r"\.html(/.*)?$", "true"),
    (r"^en/1[^/]*\.html(/.*)?$", "false"),
    (r"(^|/)fr/", "true"),
    (r"(^|/)de/7[^/]*(/.*)?$", "true"),
    (r"^es/[^/0-4][^/]*(/.*)?$", "true"),
    (r"^e[^/]*n/2[0-2][^/](/.*)?$", "true"),
    (r"(^|/)!x(/.*)?$", "true"),
]


def _ignored_sql(col: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({col}, '{rx}') THEN {out}" for rx, out in reversed(_IGNORED)) + " ELSE false END"


_PATHS = "SELECT page_id, regexp_extract(url, '^[a-z]+://[^/]+/([^?#]*)', 1) AS path FROM pages"

ORACLE = {
    "hash_encode": f"WITH {_SPARSE} SELECT doc_id, dim, round(value, 6) AS value FROM sp",
    "embed_once_fanout": f"WITH {_SPARSE} SELECT doc_id, dim, round(value, 6) AS value FROM sp",
    "text_usage": """
SELECT sha256(text) AS text_sha, CAST(count(*) AS BIGINT) AS n_uses, min(doc_id) AS first_id,
       CAST(count(DISTINCT source) AS BIGINT) AS n_source
FROM documents GROUP BY sha256(text)""",
    "content_hash_match": """
WITH h AS (SELECT doc_id, sha256(text) AS sha FROM documents)
SELECT doc_id, sha, min(doc_id) OVER (PARTITION BY sha) AS canonical_id FROM h""",
    "masked_mean_pool": f"""
WITH {_SPARSE},
m AS (SELECT d.doc_id, d.source, CAST(coalesce(l.quality, 0) AS DOUBLE) AS m
      FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id),
den AS (SELECT source, greatest(sum(m), 1e-9) AS den FROM m GROUP BY source),
num AS (SELECT m.source, sp.dim, sum(sp.value * m.m) AS num FROM sp JOIN m USING (doc_id) GROUP BY m.source, sp.dim),
g AS (SELECT source, CAST(unnest(range(64)) AS INTEGER) AS dim FROM den)
SELECT g.source, g.dim, round(coalesce(num.num, 0.0) / den.den, 6) AS value
FROM g JOIN den USING (source) LEFT JOIN num ON num.source = g.source AND num.dim = g.dim""",
    "retrieve_passages": f"""
WITH {_SPARSE},
qt AS (SELECT item_id, {_TOK.format(x='text')} AS toks FROM benchmark),
qb AS (SELECT item_id, len(toks) AS n, unnest(list_transform(toks, lambda t: {_BKT})) AS dim FROM qt),
qs AS (SELECT item_id, CAST(dim AS INTEGER) AS dim, count(*) / max(n) AS value FROM qb GROUP BY item_id, dim),
dv AS (SELECT g.doc_id, list(coalesce(sp.value, 0.0) ORDER BY g.dim) AS v
       FROM (SELECT doc_id, unnest(range(64)) AS dim FROM documents) g
       LEFT JOIN sp ON sp.doc_id = g.doc_id AND sp.dim = g.dim GROUP BY g.doc_id),
qv AS (SELECT g.item_id, list(coalesce(qs.value, 0.0) ORDER BY g.dim) AS v
       FROM (SELECT item_id, unnest(range(64)) AS dim FROM benchmark) g
       LEFT JOIN qs ON qs.item_id = g.item_id AND qs.dim = g.dim GROUP BY g.item_id),
d AS (SELECT a.item_id, b.doc_id,
             round(list_sum(list_transform(list_zip(a.v, b.v), lambda x: x[1] * x[2]))
               / (sqrt(list_sum(list_transform(a.v, lambda x: x * x))) * sqrt(list_sum(list_transform(b.v, lambda x: x * x)))), 6) AS score
      FROM qv a, dv b),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank
      FROM d WHERE score IS NOT NULL AND NOT isnan(score))
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM r WHERE rank <= {PASSAGE_K}""",
    "query_text_strategies": """
WITH x AS (SELECT d.*, s.strategy FROM documents d, (VALUES ('code_only'), ('error_info'), ('full')) s(strategy)),
q AS (SELECT doc_id, strategy, CASE strategy WHEN 'code_only' THEN text WHEN 'error_info' THEN lang || ' ' || source
                                ELSE lang || ' ' || source || ' ' || text END AS q FROM x)
SELECT doc_id, strategy, CAST(length(q) AS BIGINT) AS n_chars, md5(q) AS query_md5 FROM q""",
    "fixed_chunks": f"""
WITH s AS (SELECT doc_id, text, unnest(range(0, length(text), {CHUNK_SIZE})) AS i FROM documents WHERE length(text) > 0)
SELECT doc_id, CAST(i / {CHUNK_SIZE} AS INTEGER) AS chunk_no, CAST(length(substring(text, i + 1, {CHUNK_SIZE})) AS BIGINT) AS chunk_len,
       md5(substring(text, i + 1, {CHUNK_SIZE})) AS chunk_md5 FROM s""",
    "line_stats": """
WITH d AS (SELECT source, CAST(len(string_split(text, chr(10))) AS BIGINT) AS n FROM documents)
SELECT source, min(n) AS min_lines, max(n) AS max_lines, round(avg(n), 6) AS avg_lines, CAST(count(*) AS BIGINT) AS n_files
FROM d GROUP BY source""",
    "total_lines": """
SELECT CAST(count(*) AS BIGINT) AS n_files,
       CAST(sum(length(html) - length(replace(html, chr(10), ''))
                + CASE WHEN length(html) > 0 AND NOT ends_with(html, chr(10)) THEN 1 ELSE 0 END) AS BIGINT) AS total_lines
FROM pages WHERE contains(url, 'example.com') AND NOT contains(url, '.html')""",
    "counted_files": """
SELECT page_id, url, CAST(length(html) - length(replace(html, chr(10), '')) + CASE WHEN length(html) > 0 AND NOT ends_with(html, chr(10)) THEN 1 ELSE 0 END AS BIGINT) AS n_lines
FROM pages WHERE contains(url, 'example.com') AND NOT contains(url, '.html')""",
    "substring_counts": "SELECT doc_id, CAST((length(text) - length(replace(text, 'th', ''))) / 2 AS BIGINT) AS n FROM documents",
    "usage_rows": "SELECT sha256(text) AS text_sha, source, doc_id FROM documents",
    "dedup_ratio": """
SELECT CAST(count(*) AS BIGINT) AS n_texts, CAST(count(DISTINCT sha256(text)) AS BIGINT) AS n_distinct,
       round(count(DISTINCT sha256(text)) / count(*), 6) AS ratio FROM documents""",
    "min_cost_segments": f"""
WITH RECURSIVE x AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
d(doc_id, i, best, begins) AS (
  SELECT doc_id, 0, [0.0::DOUBLE], [0] FROM x
  UNION ALL
  SELECT doc_id, i + 1, list_append(best, m + CASE WHEN length(ls[i + 1]) < 40 THEN 3.0 ELSE 10.0 END), list_append(begins, CAST(lo + list_position(best[lo + 1:], m) - 1 AS INTEGER))
  FROM (SELECT *, list_min(best[lo + 1:]) AS m FROM (SELECT d.*, x.ls, greatest(d.i + 1 - {SEG_WINDOW}, 0) AS lo FROM d JOIN x USING (doc_id) WHERE d.i < len(x.ls)))
),
f AS (SELECT d.*, x.ls FROM d JOIN x USING (doc_id) WHERE d.i = len(x.ls)),
s(doc_id, stop, start, best, begins, ls) AS (
  SELECT doc_id, i, begins[i + 1], best, begins, ls FROM f
  UNION ALL SELECT doc_id, start, begins[start + 1], best, begins, ls FROM s WHERE start > 0
)
SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY start) - 1 AS INTEGER) AS seg_no, CAST(start AS INTEGER) AS start_line, CAST(stop - 1 AS INTEGER) AS end_line,
       CAST(length(regexp_replace(array_to_string(ls[start + 1:stop], chr(10)), '^\\s+|\\s+$', '', 'g')) AS BIGINT) AS n_chars, best[-1] AS total_cost FROM s""",
    "single_item_filter": """
WITH per AS (SELECT conv_id, count(*) FILTER (WHERE role = 'user') AS n_user,
                    arg_max(text, turn) FILTER (WHERE role = 'assistant') AS reply, CAST(count(*) AS BIGINT) AS n_turns
             FROM conversations GROUP BY conv_id)
SELECT conv_id, n_turns FROM per
WHERE n_user = 1 AND coalesce(regexp_replace(reply, '^\\s+|\\s+$', '', 'g'), '') <> ''""",
    "min_group_size": f"""
SELECT source, CAST(count(*) AS BIGINT) AS n_docs FROM documents GROUP BY source HAVING count(*) >= {MIN_GROUP}""",
    "path_filters": f"""
WITH p AS ({_PATHS})
SELECT page_id, path, string_split(path, '/')[-1] AS basename,
       regexp_extract(string_split(path, '/')[-1], '^.+(\\.[^.]*)$', 1) AS ext FROM p
WHERE NOT list_bool_or(list_transform(string_split(path, '/'), lambda c: starts_with(c, '.')))
  AND regexp_extract(string_split(path, '/')[-1], '^.+(\\.[^.]*)$', 1) IN ('.html')""",
    "ignore_rules": f"WITH p AS ({_PATHS}) SELECT page_id, path, {_ignored_sql('path')} AS ignored FROM p",
    "latest_content_lookup": """
SELECT l.doc_id, p.page_id IS NOT NULL AS found, CAST(length(coalesce(p.html, '')) AS BIGINT) AS n_chars
FROM labels l LEFT JOIN pages p ON p.page_id = l.doc_id""",
}
