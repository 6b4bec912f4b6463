"""Call resolution and reachability bound to the driver tables.

Call graph: an order is a snapshot and its line items, in order, are a chain of
functions; each calls the next one.  A hop inside one brand (same module) costs
0, a hop across brands (another file) costs 1.  Some callees have no module file
or no function of that name, and the last one calls an external name.  The first
line is the failing test: one root an order, walked up to one cross-file hop.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from faultline.operators import graph, patches, source
from faultline.plans.texts import part_patches
from faultline.plans.truth import KEY, part_facts
from faultline.sources.tables import read_table

MAX_DEPTH = 1


def order_calls(spark: SparkSession, sf: str) -> DataFrame:
    """``l_orderkey, src, callee, dst, cost, status`` with nodes numbered from 1."""
    li = read_table(spark, sf, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_shipdate")
    p = read_table(spark, sf, "part", F.col("p_partkey").alias("l_partkey"), "p_brand", "p_size")
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_shipdate")
    x = li.withColumn("src", F.row_number().over(w)).join(p, "l_partkey", "left")
    w = Window.partitionBy("l_orderkey").orderBy("src")
    x = x.select("l_orderkey", "src", "p_brand", F.lead("src").over(w).alias("dst"), F.lead("l_partkey").over(w).alias("to"), F.lead("p_brand").over(w).alias("b"), F.lead("p_size").over(w).alias("z"))
    status = F.when(F.col("dst").isNull(), "external").when(F.col("z") % 10 == 0, "no_module").when(F.col("z") % 7 == 0, "no_function")
    return x.select(
        "l_orderkey", "src", F.coalesce(F.concat(F.lit("f_"), F.col("to").cast("string")), F.lit("print")).alias("callee"),
        F.when(status.isNull(), F.col("dst")).alias("dst"), F.when(F.col("p_brand") == F.col("b"), 0).otherwise(1).alias("cost"), status.alias("status"),
    )


def _walk(spark, sf) -> tuple[DataFrame, DataFrame]:
    calls = order_calls(spark, sf)
    roots = read_table(spark, sf, "lineitem", "l_orderkey").distinct().select("l_orderkey", F.lit(1).alias("root"), F.lit(1).alias("node"))
    return graph.reachability(calls.where("status is null"), roots, max_depth=MAX_DEPTH, keys=["l_orderkey"]), calls


def reachability(spark, sf):
    r, _ = _walk(spark, sf)
    return r.select("l_orderkey", "root", "node", F.col("depth").cast("int"))


def call_tree(spark, sf):
    r, calls = _walk(spark, sf)
    t = graph.call_tree(r, calls, MAX_DEPTH, ["l_orderkey"])
    return t.select("l_orderkey", "root", "src", "callee", "dst", F.col("depth").cast("int"), "label")


def resolve_import(spark, sf):
    """JON-10: module names per part (file level and package level) against
    the changed paths plus package markers of SMALL parts."""
    pp = part_patches(spark, sf)
    paths = patches.changed_paths(pp, ["p_partkey"]).select("p_partkey", "path")
    small = read_table(spark, sf, "part", "p_partkey", "p_type").where(F.col("p_type") == "SMALL")
    inits = paths.join(small, "p_partkey", "left_semi").select(
        F.concat(F.regexp_extract("path", r"^(.*)/[^/]*$", 1), F.lit("/__init__.py")).alias("path")
    )
    files = paths.select("path").unionByName(inits)
    p = read_table(spark, sf, "part", "p_partkey", "p_name", "p_brand")
    brand = F.lower(F.regexp_replace("p_brand", "#", "_"))
    fn = F.regexp_replace("p_name", " ", "_")
    mods = p.select(
        "p_partkey",
        F.explode(F.array(
            F.concat(F.lit("pkg."), brand, F.lit("."), fn, F.lit(".run")),
            F.concat(F.lit("pkg."), brand, F.lit(".run")),
        )).alias("module"),
    )
    return graph.resolve_module(mods, files)


def call_resolution(spark, sf):
    """JON-08/09: each call of the part modules, resolved locally, through an
    import alias, or as external."""
    ln, found = part_facts(spark, sf)
    calls, defined, imports = source.calls(ln, found, KEY), source.defined(found, KEY), source.imports(source.by_file(ln, KEY), KEY)
    return graph.classify_calls(calls, defined, imports, ["p_partkey"])


QUERIES = {
    "reachability": reachability,
    "call_tree": call_tree,
    "resolve_import": resolve_import,
    "call_resolution": call_resolution,
}

_WALK = f"""
x AS (SELECT l_orderkey, l_partkey, p_brand, p_size, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_shipdate) AS INTEGER) AS src
      FROM lineitem LEFT JOIN part ON p_partkey = l_partkey),
c AS (SELECT x.l_orderkey, x.src, coalesce('f_' || y.l_partkey, 'print') AS callee, y.src AS next,
             CASE WHEN x.p_brand = y.p_brand THEN 0 ELSE 1 END AS cost,
             CASE WHEN y.src IS NULL THEN 'External or builtin function' WHEN y.p_size % 10 = 0 THEN 'Module file not found'
                  WHEN y.p_size % 7 = 0 THEN 'Function not found' END AS leaf
      FROM x LEFT JOIN x y ON y.l_orderkey = x.l_orderkey AND y.src = x.src + 1),
r(l_orderkey, node, depth) AS (SELECT DISTINCT l_orderkey, 1, 0 FROM lineitem
  UNION ALL SELECT r.l_orderkey, c.next, r.depth + c.cost FROM r JOIN c ON c.l_orderkey = r.l_orderkey AND c.src = r.node
  WHERE c.leaf IS NULL AND r.depth + c.cost <= {MAX_DEPTH})"""

_FN = "replace(p_name, ' ', '_')"
_B = "lower(replace(p_brand, '#', '_'))"

ORACLE = {
    "reachability": f"""WITH RECURSIVE {_WALK} SELECT l_orderkey, 1 AS root, node, depth FROM r""",
    "call_tree": f"""WITH RECURSIVE {_WALK}
SELECT c.l_orderkey, 1 AS root, c.src, c.callee, CASE WHEN c.leaf IS NULL THEN c.next END AS dst, r.depth,
       CASE WHEN c.leaf IS NOT NULL THEN c.leaf WHEN r.depth + c.cost > {MAX_DEPTH} THEN 'Max depth reached' END AS label
FROM r JOIN c ON c.l_orderkey = r.l_orderkey AND c.src = r.node""",
    "resolve_import": f"""
WITH paths AS (SELECT 'pkg/' || {_B} || '/' || {_FN} || '.py' AS path, p_type FROM part
               UNION ALL SELECT 'tests/test_' || {_FN} || '.py', p_type FROM part),
files AS (SELECT path FROM paths UNION SELECT regexp_extract(path, '^(.*)/[^/]*$', 1) || '/__init__.py' FROM paths WHERE p_type = 'SMALL'),
m AS (SELECT p_partkey, 'pkg.' || {_B} || '.' || {_FN} || '.run' AS module FROM part
      UNION ALL SELECT p_partkey, 'pkg.' || {_B} || '.run' FROM part),
c AS (SELECT *, array_to_string(string_split(module, '.')[1:len(string_split(module, '.')) - 1], '/') AS base FROM m)
SELECT p_partkey, module, coalesce(f1.path, f2.path) AS resolved FROM c
LEFT JOIN (SELECT DISTINCT path FROM files) f1 ON f1.path = c.base || '.py'
LEFT JOIN (SELECT DISTINCT path FROM files) f2 ON f2.path = c.base || '/__init__.py'""",
    "call_resolution": f"""
SELECT p_partkey, {_FN} AS caller, 'h_' || {_FN} AS callee, 'import' AS resolution,
       'pkg.' || {_B} || '.helper' AS import_target FROM part
UNION ALL SELECT p_partkey, {_FN}, 'inner', 'External or builtin function', NULL FROM part
UNION ALL SELECT p_partkey, 'inner', 'h_' || {_FN}, 'import', 'pkg.' || {_B} || '.helper' FROM part
UNION ALL SELECT p_partkey, 'price', {_FN}, 'local', NULL FROM part
UNION ALL SELECT p_partkey, 'cost', 'js_', 'External or builtin function', NULL FROM part WHERE p_size % 2 = 1
UNION ALL SELECT p_partkey, 'cost', 'price', 'local', NULL FROM part WHERE p_size % 2 = 1""",
}
