"""Documented options beside the published behaviour (Q2, Q5, Q22), the corpus job over a
file tree, a model's vectors and its input limit, bound to the driver tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from faultline.functions import encode as E
from faultline.operators import embed, report, source
from faultline.operators import evaluate as ev
from faultline.plans import retrieval
from faultline.plans.truth import _MOD, KEY, part_facts, part_sources
from faultline.session import checkpoint_dir
from faultline.sources import files
from faultline.sources.tables import read_table

LETTERS = "aeiou"
MODULES = 2048  # of a file in the tree, at most


def ap_over_all(spark: SparkSession, sf: str):
    """Q2: AP divided by all vectors of the query's label in its snapshot, found or not."""
    e = read_table(spark, sf, "embeddings", "vec_id", "label")
    d = read_table(spark, sf, "documents", F.col("doc_id").alias("vec_id"), "source")
    at = e.join(d, "vec_id", "left")
    n = at.groupBy("source", "label").agg((F.count("*") - 1).alias("n_relevant"))
    relevant = at.join(n, ["source", "label"]).select("vec_id", "n_relevant")
    per = ev.average_precision(retrieval.ranked_with_relevance(spark, sf), ["vec_id"], relevant=relevant)
    return per.select("vec_id", "ap", "n_hits")


def path_matches(spark, sf):
    """Q5: ranked files of a part, relevant by name and by path."""
    p = read_table(spark, sf, "part", "p_partkey", "p_name", "p_brand", "p_size")
    fn, brand = F.regexp_replace("p_name", " ", "_"), F.lower(F.regexp_replace("p_brand", "#", "_"))
    own = F.concat(F.lit("pkg/"), brand, F.lit("/"))
    ranked = p.select("p_partkey", F.posexplode(F.array(F.concat(own, F.lit("__init__.py")), F.concat(own, fn, F.lit(".py")), F.lit("pkg/other/__init__.py"))).alias("rank", "path"))
    where = F.when(F.col("p_size") % 3 == 0, F.concat(own, fn, F.lit(".py"))).when(F.col("p_size") % 3 == 1, "lib/__init__.py").otherwise(F.concat(own, F.lit("__init__.py")))
    truth = p.select("p_partkey", where.alias("path"))
    by_name = ev.path_relevance(ranked, truth, KEY, "path").withColumnRenamed("rel", "by_name")
    by_path = ev.path_relevance(ranked, truth, KEY, "path", match="path").select("p_partkey", "rank", F.col("rel").alias("by_path"))
    return by_name.join(by_path, ["p_partkey", "rank"])


def code_roots(spark, sf):
    """Q22: the root remainder of the part modules when definitions cover all of their lines."""
    c = source.chunks(*part_facts(spark, sf), KEY, cover="end_line")
    return c.where("name = 'root'").select("p_partkey", F.length("code").cast("bigint").alias("n_chars"), F.md5("code").alias("code_md5"))


def tree_corpus(spark, sf):
    """UDTF-15 (SRC-01/05/11, SNK-01): a tree of files, a folder a brand with its modules one behind
    the other, in files of at most MODULES each, read whole, cut into chunks, written by project and read again."""
    root, out = (f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}" for name in ("tree", "corpus"))
    modules = part_sources(spark, sf).join(read_table(spark, sf, "part", "p_partkey", "p_brand"), "p_partkey")
    modules = modules.withColumn("project", F.regexp_replace("p_brand", "#", "_"))
    # a brand's modules are dealt out to one partition; a file, which is one row where it is read, ends with a module
    brands = modules.repartition("project").sortWithinPartitions("project", "p_partkey").select("project", F.col("content").alias("value"))
    brands.write.option("maxRecordsPerFile", MODULES).partitionBy("project").text(root)
    tree = files.read_tree(spark, root, "*.txt").withColumn("path", files.relative_path(F.col("path"), root))
    tree = tree.withColumn("project", F.regexp_extract("path", "project=([^/]*)", 1))
    key = ["project", "path"]
    ln, found = source.facts(tree.select(*key, "content"), key)
    report.write_json(source.chunks(ln, found, key).drop("path"), out, partition_by=["project"])
    chunks = files.read_documents(spark, out, "seq int, name string, start_line int, end_line int, code string, project string", multi_line=False)
    return chunks.where("name <> 'root'").groupBy("project").agg(
        F.count("*").cast("bigint").alias("n_chunks"), F.sum(F.length("code")).alias("n_chars"), F.count_distinct("code").cast("bigint").alias("n_codes"))


def _vowels() -> Callable[[list[str]], list[list[float]]]:
    return lambda texts: [[float(t.count(c)) for c in LETTERS] for t in texts]


def model_vectors(spark, sf):
    """UDTF-13 with a model in Python workers, which sees each distinct text once."""
    d = read_table(spark, sf, "documents", "doc_id", "text")
    return embed.embed_once(d, "text", embed.model_encoder(_vowels, 256))


def model_input(spark, sf):
    """PRJ-04: what a model with an input limit sees of each text."""
    d = read_table(spark, sf, "documents", "doc_id", "text").withColumn("t", E.tokens(F.col("text")))
    kept = E.truncate(F.col("t"), E.MODEL_MAX_TOKENS)
    return d.select("doc_id", F.size("t").cast("bigint").alias("n_tokens"), F.size(kept).cast("bigint").alias("n_kept"), F.md5(F.array_join(kept, " ")).alias("kept_md5"))


QUERIES = {q.__name__: q for q in (ap_over_all, path_matches, code_roots, tree_corpus, model_vectors, model_input)}

_B = "lower(replace(p_brand, '#', '_'))"
_FN = "replace(p_name, ' ', '_')"
_PATHS = f"['pkg/' || {_B} || '/__init__.py', 'pkg/' || {_B} || '/' || {_FN} || '.py', 'pkg/other/__init__.py']"

ORACLE = {
    "ap_over_all": retrieval._RANKED + """, n AS (SELECT source, label, count(*) - 1 AS n FROM e GROUP BY source, label)
SELECT h.vec_id, round(sum(CASE WHEN rel = 1 THEN hits / rank ELSE 0.0 END) / greatest(max(n.n), 1), 6) AS ap, CAST(sum(rel) AS BIGINT) AS n_hits
FROM h JOIN e ON e.vec_id = h.vec_id JOIN n ON n.source = e.source AND n.label = e.label GROUP BY h.vec_id""",
    "path_matches": f"""
WITH r AS (SELECT p_partkey, p_size % 3 AS k, unnest([0, 1, 2]) AS rank, unnest({_PATHS}) AS path FROM part)
SELECT p_partkey, rank, path, CASE WHEN k = 0 THEN rank = 1 ELSE rank <> 1 END::INT AS by_name, CASE k WHEN 0 THEN rank = 1 WHEN 1 THEN FALSE ELSE rank = 0 END::INT AS by_path FROM r""",
    "code_roots": f"""WITH {_MOD},
root AS (SELECT p_partkey, string_agg(line, chr(10) ORDER BY n) AS code FROM ml
         WHERE NOT EXISTS (SELECT 1 FROM sp WHERE sp.p_partkey = ml.p_partkey AND kind <> 'async_function' AND n BETWEEN s AND e) GROUP BY p_partkey)
SELECT p_partkey, CAST(length(code) AS BIGINT) AS n_chars, md5(code) AS code_md5 FROM root""",
    "tree_corpus": f"""WITH {_MOD},
ch AS (SELECT sp.p_partkey, name, f, string_agg(line, chr(10) ORDER BY n) AS code FROM sp JOIN ml ON ml.p_partkey = sp.p_partkey AND n BETWEEN f AND e
       WHERE kind <> 'async_function' GROUP BY ALL)
SELECT replace(p_brand, '#', '_') AS project, count(*) AS n_chunks, CAST(sum(length(code)) AS BIGINT) AS n_chars, count(DISTINCT code) AS n_codes
FROM ch JOIN part USING (p_partkey) GROUP BY ALL""",
    "model_vectors": f"SELECT doc_id, CASE WHEN text IS NOT NULL THEN [{', '.join(f'''(length(text) - length(replace(text, '{c}', '')))::DOUBLE''' for c in LETTERS)}] END AS embedding FROM documents",
    "model_input": """
WITH t AS (SELECT doc_id, [x FOR x IN regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}_]+') IF x <> ''] AS t FROM documents)
SELECT doc_id, CAST(len(t) AS BIGINT) AS n_tokens, CAST(least(len(t), 1024) AS BIGINT) AS n_kept, md5(array_to_string(t[1:1024], ' ')) AS kept_md5 FROM t""",
}
