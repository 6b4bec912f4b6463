"""Supplied call graphs, context cut by localisation, lines numbered by hunks, frames,
positions, and what is written and read again, bound to the driver tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from faultline.operators import context, graph, logs, patches, positions, report, source, spans
from faultline.plans.calls import MAX_DEPTH, order_calls
from faultline.plans.truth import KEY, part_facts
from faultline.session import checkpoint_dir
from faultline.sources import files, runs
from faultline.sources.tables import read_table

NL = "\n"
RELEVANT = 3  # nodes of an order that localisation keeps


def _folder(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


# ---------------------------------------------------------------- walks
def _order_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Line items with their number in the order, as ``calls.order_calls`` counts them."""
    li = read_table(spark, sf, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_shipdate", "l_extendedprice")
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_shipdate")
    return li.select("l_orderkey", F.row_number().over(w).alias("n"), "l_partkey", "l_extendedprice")


def call_graph_walk(spark, sf):
    """JON-12: an order's lines are the entries of a supplied call graph, several of them
    with one last name component; each calls the next two.  A hop to a lower number is a
    hop into another file."""
    x = _order_lines(spark, sf).withColumn("f", F.pmod("l_partkey", F.lit(4)).cast("string"))
    w = Window.partitionBy("l_orderkey").orderBy("n")
    name = F.concat(F.lit("pkg.m"), F.col("n").cast("string"), F.lit(".f_"), F.col("f"))
    x = x.withColumn("caller", name)
    entries = x.select("l_orderkey", F.col("n").alias("ord"), "caller", F.array_compact(F.array(F.lead("caller").over(w), F.lead("caller", 2).over(w))).alias("callees"))
    named = graph.named_callees(entries, ["l_orderkey"])
    edges = named.select("l_orderkey", F.col("name").alias("src"), F.col("callee").alias("dst"), F.when(F.col("callee") < F.col("name"), 1).otherwise(0).alias("cost"))
    first = F.concat(F.lit("f_"), F.col("f"))
    roots = x.where("n = 1").select("l_orderkey", first.alias("root"), first.alias("node"))
    walked = graph.reachability(edges, roots, max_depth=MAX_DEPTH, keys=["l_orderkey"])
    return walked.select("l_orderkey", "root", "node", F.col("depth").cast("int"))


def resolved_edges(spark, sf):
    """JON-08..10: the calls of the part modules as edges of the walk, each part a snapshot
    with its module and, for some, the module that it imports from."""
    ln, found = part_facts(spark, sf)
    here = F.lit("main.py").alias("path")
    p = read_table(spark, sf, "part", "p_partkey", "p_name", "p_brand", "p_size")
    brand = F.concat(F.lit("pkg/"), F.lower(F.regexp_replace("p_brand", "#", "_")))
    kind = F.col("p_size") % 3
    other = p.where(kind > 0).select("p_partkey", F.when(kind == 1, F.concat(brand, F.lit(".py"))).otherwise(F.concat(brand, F.lit("/__init__.py"))).alias("path"))
    helper = p.where(kind == 1).select(
        "p_partkey", F.concat(brand, F.lit(".py")).alias("path"), F.concat(F.lit("h_"), F.regexp_replace("p_name", " ", "_")).alias("name"))
    at = ["p_partkey", here]
    edges = graph.call_edges(
        source.calls(ln, found, KEY).select(*at, "caller", "callee"), source.defined(found, KEY).select(*at, "name").unionByName(helper),
        source.imports(source.by_file(ln, KEY), KEY).select(*at, "alias", "target"), other.unionByName(p.select(*at)), KEY)
    show = lambda c: F.concat_ws(":", f"{c}.path", f"{c}.name")
    return edges.select("p_partkey", show("src").alias("src"), "callee", F.when(F.col("dst").isNotNull(), show("dst")).alias("dst"), F.col("cost").cast("int"), "status")


def pruned_walk(spark, sf):
    """FLT-09: the walk of ``reachability`` on an order's most relevant lines alone, those of
    the highest price; what lies behind another line isn't reached."""
    calls = order_calls(spark, sf).where("status is null")
    scores = _order_lines(spark, sf).select("l_orderkey", F.col("n").alias("node"), F.col("l_extendedprice").alias("score"))
    kept = graph.most_relevant(scores, RELEVANT, ["l_orderkey"])
    roots = read_table(spark, sf, "lineitem", "l_orderkey").distinct().select("l_orderkey", F.lit(1).alias("root"), F.lit(1).alias("node"))
    walked = graph.reachability(calls, roots, max_depth=None, keys=["l_orderkey"], relevant=kept)
    return walked.select("l_orderkey", "root", "node", F.col("depth").cast("int"))


# ---------------------------------------------------------------- positions
def zip_by_position(spark, sf):
    """JON-03: parts in the order of their keys beside parts in the order of their prices,
    which have nothing in common but their place."""
    left = read_table(spark, sf, "part", "p_partkey", "p_name")
    right = read_table(spark, sf, "part", F.col("p_retailprice").alias("price"), F.col("p_brand").alias("brand"), F.col("p_partkey").alias("_k"))
    return positions.zipped(left, right, ["p_partkey"], [F.desc("price"), "_k"]).drop("_k")


def numbered_bugs(spark, sf):
    """SRC-08/SRT-03: the bugs of result folders, by project and number."""
    p = read_table(spark, sf, "part", "p_brand", "p_size", "p_type")
    path = F.concat_ws("/", "p_brand", F.when(F.col("p_type") == "SMALL", F.concat(F.lit("x"), F.col("p_size").cast("string"))).otherwise(F.col("p_size").cast("string")), F.lit("chunks.json"))
    bugs = files.bugs_of(p.select(path.alias("path")))
    return positions.numbered(bugs, ["project", F.expr("try_cast(bug as bigint)").asc_nulls_last(), "bug"])


# ---------------------------------------------------------------- patches and traces
def part_hunks(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """(patches, old files) of parts: a file that has one line several times, and a patch
    that changes a later one of them; for some parts the patch is of another version of
    the file, or the file is missing."""
    p = read_table(spark, sf, "part", "p_partkey", "p_name", "p_size")
    size, kind = F.col("p_size").cast("string"), F.col("p_size") % 4
    path = F.concat(F.lit("pkg/"), F.regexp_replace("p_name", " ", "_"), F.lit(".py"))
    join = lambda *x: F.concat_ws(NL, *[F.lit(v) if isinstance(v, str) else v for v in x])
    more = F.concat(F.lit("x = "), size)
    content = join("def a():", "    return 1", "def b():", "    return 1", more, "def c():", "    return 1", "")
    head = F.when(kind == 1, "@@ -4,3 +4,3 @@ def b():").otherwise("@@ -3,3 +3,3 @@ def b():")
    diff = join(
        F.concat(F.lit("diff --git a/"), path, F.lit(" b/"), path), F.concat(F.lit("--- a/"), path), F.concat(F.lit("+++ b/"), path),
        head, " def b():", "-    return 1", "+    y = 1", "+    return y", F.concat(F.lit(" "), more),
        "@@ -6,2 +7 @@", "-def c():", "     return 1", "\\ No newline at end of file",
    )
    return p.select("p_partkey", diff.alias("diff")), p.where(kind != 2).select("p_partkey", path.alias("file"), content.alias("content"))


def locate_by_hunk(spark, sf):
    """JON-05 in both modes: the removed lines by their hunks' numbers, and by their first occurrence."""
    diff, old = part_hunks(spark, sf)
    at = ["p_partkey", "file"]
    by_hunk = spans.locate_at(patches.numbered_lines(diff, KEY), old, at)
    first = spans.locate(patches.changed_lines(diff, KEY), old, at).select("p_partkey", "pos", F.col("line_no").alias("first_line"))
    return by_hunk.join(first, ["p_partkey", "pos"]).select("p_partkey", F.col("pos").cast("int").alias("pos"), "line_no", "status", "first_line")


def added_line_numbers(spark, sf):
    """JON-05: the added lines with their numbers in the new file."""
    diff, _ = part_hunks(spark, sf)
    return patches.numbered_lines(diff, KEY, fixed=True).select("p_partkey", F.col("pos").cast("int").alias("pos"), "code", "line_no")


def frame_filter(spark, sf):
    """FLT-08: a Python traceback an event, without the frames of packages, of logging and of
    code without a file."""
    e = read_table(spark, sf, "events", "event_id", "user_id", "event_type", "value")
    uid = F.col("user_id").cast("string")
    trace = F.concat(
        F.lit("Traceback (most recent call last):\n  File \"/app/suite_"), uid, F.lit(".py\", line 3, in test\n    check(x)\n"),
        F.when(F.col("event_type") == "error", "  File \"/usr/lib/python3.11/logging/__init__.py\", line 9, in emit\n    self.flush()\n").otherwise(""),
        F.when(F.col("value") > 50, "  File \"/venv/lib/python3.11/site-packages/lib/mod.py\", line 7, in run\n    call(\n        y)\n").otherwise(""),
        F.lit("  File \"/app/core.py\", line 1, in f\nValueError: "), uid,
        F.lit("\n    not a frame's code\n\nDuring handling of the above:\n  File \"<string>\", line 1\n    bad\n    ^\nSyntaxError: bad"),
    )
    kept = logs.informative(e.select("event_id", trace.alias("trace")), ["event_id"])
    return kept.select("event_id", "n_frames", "n_dropped", F.length("trace").cast("bigint").alias("n_chars"), F.md5("trace").alias("trace_md5"))


# ---------------------------------------------------------------- written and read again
EARLIER, LATER, BROKEN = "12_31_2023__23_59_59", "01_05_2024__10_00_00", "02_01_2024__00_00_00"


def resume_from_run(spark, sf):
    """SNK-06/JON-17/18: two runs are published and a third one breaks off; documents go on from
    the latest complete one, which isn't the last by name."""
    root = _folder(spark, "runs")
    labels = read_table(spark, sf, "labels", "doc_id", "quality", "toxic")
    runs.publish(labels.select("doc_id", (F.col("toxic") == 1).alias("solved")), root, EARLIER)
    runs.publish(labels.select("doc_id", (F.col("quality") == 1).alias("solved")), root, LATER)
    runs.write_rows(labels.select("doc_id", F.lit(False).alias("solved")), root, BROKEN)
    previous = runs.latest(spark, root, "doc_id long, solved boolean")
    out = context.carry_forward(read_table(spark, sf, "documents", "doc_id"), previous, ["doc_id"])
    return out.join(previous.select("doc_id", "run"), "doc_id", "left")


def json_round_trip(spark, sf):
    """SNK-01, SRC-12/14/15: chunks written as JSON by project and bug, among records that
    are cut off, and read again with what the folders' names tell."""
    path = _folder(spark, "chunks")
    p = read_table(spark, sf, "part", "p_brand", "p_size", "p_name", "p_partkey")
    rows = p.select(F.col("p_brand").alias("project"), F.col("p_size").alias("bug"), F.col("p_name").alias("name"), F.col("p_partkey").alias("seq"))
    report.write_json(rows, path, partition_by=["project", "bug"])
    cut_off = rows.where("bug % 10 = 0").select("project", "bug", F.concat(F.lit('{"name": "'), "name", F.lit('", "seq')).alias("value"))
    cut_off.write.partitionBy("project", "bug").mode("append").text(path)
    good, bad = files.read_checked(spark, path, "name string, seq long")
    per = good.groupBy("project", F.col("bug").cast("int").alias("bug")).agg(
        F.count("*").cast("bigint").alias("n"), F.sum("seq").alias("seq_sum"), F.min("name").alias("first_name"))
    lost = bad.agg(F.lit("(corrupt)").alias("project"), F.lit(None).cast("int").alias("bug"), F.count("*").cast("bigint").alias("n"),
                   F.sum(F.length("record")).alias("seq_sum"), F.min("record").alias("first_name"))
    return per.unionByName(lost)


def vector_round_trip(spark, sf):
    """SNK-02, SRC-13: vectors written by label and read again; every seventh one has lost numbers."""
    path = _folder(spark, "vectors")
    v = read_table(spark, sf, "embeddings", "vec_id", "embedding", "label")
    broken = F.when(F.col("vec_id") % 7 == 0, F.slice("embedding", 1, 3)).otherwise(F.col("embedding"))
    report.write_vectors(v.withColumn("embedding", broken), path, "vec_id", partition_by=["label"])
    dim = v.agg(F.max(F.size("embedding"))).first()[0]
    good, bad = files.read_vectors(spark, path, dim=dim)
    out = good.withColumn("whole", F.lit(True)).unionByName(bad.withColumn("whole", F.lit(False)))
    total = F.aggregate("embedding", F.lit(0).cast("bigint"), lambda a, x: a + F.floor(x.cast("double") * 1000))
    return out.select("vec_id", F.col("label").cast("int").alias("label"), "whole", F.size("embedding").alias("dim"), total.alias("total"))


QUERIES = {q.__name__: q for q in (
    call_graph_walk, resolved_edges, pruned_walk, zip_by_position, numbered_bugs, locate_by_hunk, added_line_numbers, frame_filter,
    resume_from_run, json_round_trip, vector_round_trip,
)}

_X = """x AS (SELECT l_orderkey, l_partkey, p_brand, p_size, l_extendedprice AS price,
  CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_shipdate) AS INTEGER) AS n
  FROM lineitem LEFT JOIN part ON p_partkey = l_partkey)"""
_FN = "replace(p_name, ' ', '_')"
_B = "'pkg/' || lower(replace(p_brand, '#', '_'))"

ORACLE = {
    "call_graph_walk": f"""
WITH RECURSIVE {_X}, f AS (SELECT l_orderkey, n, 'f_' || (l_partkey % 4) AS f FROM x),
first AS (SELECT l_orderkey, f, min(n) AS n FROM f GROUP BY l_orderkey, f),
e AS (SELECT DISTINCT a.l_orderkey, a.f AS src, b.f AS dst, CASE WHEN b.f < a.f THEN 1 ELSE 0 END AS cost
      FROM first a JOIN f b ON b.l_orderkey = a.l_orderkey AND b.n IN (a.n + 1, a.n + 2)),
r(l_orderkey, root, node, depth) AS (SELECT l_orderkey, f, f, 0 FROM f WHERE n = 1
  UNION SELECT r.l_orderkey, r.root, e.dst, r.depth + e.cost FROM r JOIN e ON e.l_orderkey = r.l_orderkey AND e.src = r.node WHERE r.depth + e.cost <= {MAX_DEPTH})
SELECT l_orderkey, root, node, min(depth) AS depth FROM r GROUP BY ALL""",
    "resolved_edges": f"""
WITH c AS (
  SELECT p_partkey, p_size, {_B} AS b, {_FN} AS fn, unnest([{_FN}, {_FN}, 'inner', 'price'] || CASE WHEN p_size % 2 = 1 THEN ['cost', 'cost'] ELSE [] END) AS caller,
         unnest(['h_' || {_FN}, 'inner', 'h_' || {_FN}, {_FN}] || CASE WHEN p_size % 2 = 1 THEN ['js_', 'price'] ELSE [] END) AS callee FROM part
), k AS (SELECT *, callee IN (fn, 'price') AS here, callee = 'h_' || fn AS imported FROM c)
SELECT p_partkey, 'main.py:' || caller AS src, callee,
       CASE WHEN here THEN 'main.py:' || callee WHEN imported AND p_size % 3 = 1 THEN b || '.py:' || callee END AS dst, CASE WHEN here THEN 0 ELSE 1 END AS cost,
       CASE WHEN here THEN NULL WHEN NOT imported THEN 'external' WHEN p_size % 3 = 0 THEN 'no_module' WHEN p_size % 3 = 2 THEN 'no_function' END AS status FROM k""",
    "pruned_walk": f"""
WITH RECURSIVE {_X}, k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY price DESC, n) AS r FROM x) WHERE r <= {RELEVANT}),
e AS (SELECT a.l_orderkey, a.n AS src, b.n AS dst, CASE WHEN a.p_brand = b.p_brand THEN 0 ELSE 1 END AS cost
      FROM x a JOIN k b ON b.l_orderkey = a.l_orderkey AND b.n = a.n + 1 WHERE b.p_size % 10 <> 0 AND b.p_size % 7 <> 0),
r(l_orderkey, node, depth) AS (SELECT DISTINCT l_orderkey, 1, 0 FROM lineitem
  UNION ALL SELECT r.l_orderkey, e.dst, r.depth + e.cost FROM r JOIN e ON e.l_orderkey = r.l_orderkey AND e.src = r.node)
SELECT l_orderkey, 1 AS root, node, depth FROM r""",
    "zip_by_position": """
SELECT a.p_partkey, a.p_name, b.price, b.brand, a.position FROM (SELECT p_partkey, p_name, row_number() OVER (ORDER BY p_partkey) - 1 AS position FROM part) a
JOIN (SELECT p_retailprice AS price, p_brand AS brand, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) - 1 AS position FROM part) b USING (position)""",
    "numbered_bugs": """
WITH b AS (SELECT DISTINCT p_brand AS project, CASE WHEN p_type = 'SMALL' THEN 'x' ELSE '' END || p_size AS bug FROM part)
SELECT project, bug, row_number() OVER (ORDER BY project, try_cast(bug AS BIGINT) NULLS LAST, bug) - 1 AS position FROM b""",
    "locate_by_hunk": """
WITH p AS (SELECT p_partkey, p_size % 4 AS k FROM part)
SELECT p_partkey, 5 AS pos, CASE WHEN k = 1 THEN 5 ELSE 4 END AS line_no, CASE k WHEN 1 THEN 'not_found' WHEN 2 THEN 'no_file' ELSE 'found' END AS status,
       CASE WHEN k <> 2 THEN 2 END AS first_line FROM p
UNION ALL SELECT p_partkey, 10, 6, CASE WHEN k = 2 THEN 'no_file' ELSE 'found' END, CASE WHEN k <> 2 THEN 6 END FROM p""",
    "added_line_numbers": """
WITH p AS (SELECT p_partkey, CASE WHEN p_size % 4 = 1 THEN 1 ELSE 0 END AS k FROM part)
SELECT p_partkey, 6 AS pos, '    y = 1' AS code, 4 + k AS line_no FROM p UNION ALL SELECT p_partkey, 7, '    return y', 5 + k FROM p""",
    "frame_filter": """
WITH t AS (SELECT event_id, 3 + CASE WHEN event_type = 'error' THEN 1 ELSE 0 END + CASE WHEN value > 50 THEN 1 ELSE 0 END AS f,
  concat_ws(chr(10), 'Traceback (most recent call last):', '  File "/app/suite_' || user_id || '.py", line 3, in test', '    check(x)',
    '  File "/app/core.py", line 1, in f', 'ValueError: ' || user_id, '    not a frame''s code', '', 'During handling of the above:', 'SyntaxError: bad') AS t FROM events)
SELECT event_id, CAST(f AS BIGINT) AS n_frames, CAST(f - 2 AS BIGINT) AS n_dropped, CAST(length(t) AS BIGINT) AS n_chars, md5(t) AS trace_md5 FROM t""",
    "resume_from_run": f"""
SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'fresh' WHEN l.quality = 1 THEN 'carry' ELSE 'continue' END AS action,
       CASE WHEN l.doc_id IS NOT NULL THEN '{LATER}' END AS run FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""",
    "json_round_trip": """
SELECT p_brand AS project, p_size AS bug, count(*) AS n, CAST(sum(p_partkey) AS BIGINT) AS seq_sum, min(p_name) AS first_name FROM part GROUP BY ALL
UNION ALL SELECT '(corrupt)', NULL, count(*), CAST(sum(length(r)) AS BIGINT), min(r) FROM (SELECT '{"name": "' || p_name || '", "seq' AS r FROM part WHERE p_size % 10 = 0)""",
    "vector_round_trip": """
WITH v AS (SELECT vec_id, label, vec_id % 7 <> 0 AS whole, CASE WHEN vec_id % 7 = 0 THEN embedding[1:3] ELSE embedding END AS e FROM embeddings)
SELECT vec_id, label, whole, len(e) AS dim, CAST(list_sum([CAST(floor(x::DOUBLE * 1000) AS BIGINT) FOR x IN e]) AS BIGINT) AS total FROM v""",
}
