"""Call-graph operators: name resolution, reachability with depth, call trees.

Reachability is a 0/1-weight breadth-first search run as a short driver
loop of DataFrame joins: hops of cost 0 (same file / same module) are
expanded to a fixpoint, then one hop of cost 1 (cross-file) increases the
depth.  A walk stays inside its snapshot (``keys``), so output grows with the
snapshots and not with their product.  Every round joins the frontier to the
edge table and removes what was already visited (``left_anti``); its new rows
go to a table in the session's checkpoint folder, which cuts the lineage, and
the visited set is one scan of that table, so plans don't grow with rounds.
The only value brought to the driver per round is whether the new frontier is
empty; the walk ends there and nowhere else.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faultline.functions import text as T
from faultline.session import checkpoint_dir, cut

# Fixed leaf labels of the call walk.
LEAF_NOT_FOUND = "Function not found"
LEAF_MAX_DEPTH = "Max depth reached"
LEAF_NO_MODULE = "Module file not found"
LEAF_EXTERNAL = "External or builtin function"


def resolve_module(modules: DataFrame, files: DataFrame, module: str = "module", path: str = "path") -> DataFrame:
    """JON-10/SCA-18: module → ``a/b.py`` if that file exists, else
    ``a/b/__init__.py`` if it exists, else null (two left joins)."""
    cand = modules.withColumn("_c", T.module_path(F.col(module)))
    f = files.select(F.col(path).alias("_p")).distinct()
    a = f.select(F.col("_p").alias("_as_file"))
    b = f.select(F.col("_p").alias("_as_pkg"))
    j = cand.join(a, cand["_c.as_file"] == a["_as_file"], "left").join(b, cand["_c.as_pkg"] == b["_as_pkg"], "left")
    return j.select(*modules.columns, F.coalesce(F.col("_as_file"), F.col("_as_pkg")).alias("resolved"))


class _Rounds:
    """Rows written round by round to one folder of the shared checkpoint folder."""

    def __init__(self, like: DataFrame):
        self.spark, self.schema = like.sparkSession, like.schema
        self.path = f"{checkpoint_dir(self.spark)}/walk-{uuid.uuid4().hex}"
        self.n = 0

    def add(self, df: DataFrame) -> DataFrame:
        path = f"{self.path}/round={self.n}"
        self.n += 1
        df.select(*self.schema.names).write.parquet(path)
        return self.spark.read.schema(self.schema).parquet(path)

    def all(self) -> DataFrame:
        return self.spark.read.schema(self.schema).option("recursiveFileLookup", "true").parquet(self.path)


def reachability(
    edges: DataFrame,
    roots: DataFrame,
    max_depth: int | None = None,
    src: str = "src",
    dst: str = "dst",
    cost: str = "cost",
    keys: Sequence[str] = (),
    max_rounds: int | None = None,
    relevant: DataFrame | None = None,
) -> DataFrame:
    """JON-11/12: nodes reachable from each root with the minimum number of
    cost-1 hops (``depth``); walks stop at ``max_depth`` cost-1 hops
    (unlimited when None).  Cycles terminate because visited pairs are
    removed every round.

    ``edges(keys, src, dst, cost)`` with cost 0 or 1; ``roots(keys, root, node)``.
    Output ``keys + [root, node, depth]``.  ``max_rounds`` is a guard, not a
    limit: a walk that would need more rounds is an error, never a part.

    FLT-09: with ``relevant(keys, node)`` (see ``most_relevant``) a walk steps on
    these nodes alone.  Edges to others go before the first round, so what lies
    behind a node that is left out is never expanded; a root stays in any case.
    """
    keys = list(keys)
    at = [*keys, "node"]
    e = edges.select(*keys, F.col(src).alias("node"), F.col(dst).alias("_d"), F.col(cost).cast("int").alias("_w")).distinct()
    if relevant is not None:
        e = e.join(relevant.select(*keys, F.col("node").alias("_d")).distinct(), [*keys, "_d"], "left_semi").select(*at, "_d", "_w")
    e = cut(e, "edges")  # every round reads them
    start = roots.select(*keys, "root", "node").distinct().withColumn("depth", F.lit(0))
    done = _Rounds(start)
    frontier, depth = done.add(start), 0

    def step(front: DataFrame, weight: int) -> DataFrame:
        if max_rounds is not None and done.n > max_rounds:
            raise RuntimeError(f"the walk isn't complete after {max_rounds} rounds")
        hop = front.select(*keys, "root", "node").join(e.where(F.col("_w") == weight), at)
        new = hop.select(*keys, "root", F.col("_d").alias("node")).distinct()
        new = new.join(done.all().select(*keys, "root", "node"), [*keys, "root", "node"], "left_anti")
        return done.add(new.withColumn("depth", F.lit(depth)))

    while True:
        while not frontier.isEmpty():  # hops inside a file, to the end
            frontier = step(frontier, 0)
        if max_depth is not None and depth >= max_depth:
            break
        level = done.all().where(F.col("depth") == depth)
        depth += 1
        frontier = step(level, 1)
        if frontier.isEmpty():
            break
    return done.all()


def most_relevant(scores: DataFrame, k: int, keys: Sequence[str] = (), node: str = "node", score: str = "score") -> DataFrame:
    """FLT-09: ``keys + [node]``: the ``k`` nodes of highest localisation score in each
    snapshot, by node on a tie.  Catalyst cuts each partition to ``k`` before the
    shuffle (``WindowGroupLimit``)."""
    order = Window.partitionBy(*keys).orderBy(F.col(score).desc_nulls_last(), F.col(node))
    ranked = scores.select(*keys, F.col(node).alias("node"), F.row_number().over(order).alias("_r"))
    return ranked.where(F.col("_r") <= k).select(*keys, "node")


def named_callees(call_graph: DataFrame, keys: Sequence[str], order: str = "ord", caller: str = "caller", callees: str = "callees") -> DataFrame:
    """JON-12: ``keys + [name, callee]`` of a supplied call graph, as a lookup of
    ``.name`` finds them: of the entries of a snapshot (or file) whose dotted caller
    ends in ``.name``, the first one in input order counts and the others are not
    looked at; a callee is its last component.

    ``call_graph(keys, ord, caller, callees)`` with ``callees`` an array.  The first
    entry is an aggregate over (order, entry), so no entry of a frequent name waits
    for another.  A caller without a dot is found by no name."""
    keys = list(keys)
    entries = call_graph.where(F.contains(caller, F.lit("."))).select(
        *keys, F.substring_index(caller, ".", -1).alias("name"), F.struct(F.col(order).alias("o"), F.col(callees).alias("c")).alias("_e"))
    first = entries.groupBy(*keys, "name").agg(F.min_by("_e", "_e.o").alias("_e"))
    return first.select(*keys, "name", F.explode("_e.c").alias("callee")).select(*keys, "name", F.substring_index("callee", ".", -1).alias("callee")).distinct()


def call_edges(calls: DataFrame, defined: DataFrame, imports: DataFrame, files: DataFrame, key: Sequence[str], path: str = "path") -> DataFrame:
    """JON-08..10/12: the calls of every file as edges of the walk:
    ``key + [src, callee, dst, cost, status]`` with nodes ``(path, name)``.

    ``calls(key, path, caller, callee)``, ``defined(key, path, name)``,
    ``imports(key, path, alias, target)``, ``files(key, path)``.  A callee defined in
    the file is a hop of cost 0; an imported one is a hop of cost 1 into its
    module's file, ``no_module`` without such a file and ``no_function`` where the
    file doesn't define it; all others are ``external``."""
    key = list(key)
    at = [*key, path]
    c = classify_calls(calls, defined, imports, at)
    module = T.module_path(F.col("import_target"))
    place = lambda alias: files.select(*key, F.col(path).alias(alias), F.lit(True).alias(f"_has{alias}")).distinct()
    c = c.withColumns({"_f": module["as_file"], "_p": module["as_pkg"]})
    c = c.join(place("_f").hint("merge"), [*key, "_f"], "left").join(place("_p").hint("merge"), [*key, "_p"], "left")
    local = F.col("resolution") == "local"
    to = F.when(local, F.col(path)).when(F.col("_has_f"), F.col("_f")).when(F.col("_has_p"), F.col("_p"))
    there = defined.select(*key, F.col(path).alias("_to"), F.col("name").alias("callee"), F.lit(True).alias("_there")).distinct()
    c = c.withColumn("_to", to).join(there.hint("merge"), [*key, "_to", "callee"], "left")
    status = (
        F.when(F.col("resolution") == LEAF_EXTERNAL, "external").when(F.col("_to").isNull(), "no_module")
        .when(F.col("_there").isNull(), "no_function")
    )
    node = lambda p, n: F.struct(p.alias("path"), n.alias("name"))
    return c.select(
        *key, node(F.col(path), F.col("caller")).alias("src"), "callee",
        F.when(status.isNull(), node(F.col("_to"), F.col("callee"))).alias("dst"), F.when(local, 0).otherwise(1).alias("cost"), status.alias("status"),
    )


def call_tree(
    visited: DataFrame, calls: DataFrame, max_depth: int | None = None, keys: Sequence[str] = (),
    src: str = "src", dst: str = "dst", cost: str = "cost", callee: str = "callee", status: str = "status",
) -> DataFrame:
    """JON-11: the walked calls of every root, ``keys + [root, src, callee, dst, depth, label]``.

    ``calls(keys, src, callee, dst, cost, status)``: ``status`` is null for a
    resolved call, else ``external``, ``no_module`` or ``no_function``.  ``label``
    is null for an edge that the walk follows and names a leaf otherwise: an
    external name, a missing module file or function, or a call across files
    beyond the depth limit to a node that the walk doesn't reach another way."""
    keys = list(keys)
    c = calls.select(*keys, F.col(src).alias("node"), F.col(callee).alias("callee"), F.col(dst).alias("dst"), F.col(cost).alias("_w"), F.col(status).alias("_s")).distinct()
    seen = visited.select(*keys, "root", F.col("node").alias("dst"), F.lit(True).alias("_seen"))
    j = visited.join(c, [*keys, "node"]).join(seen, [*keys, "root", "dst"], "left")
    beyond = F.lit(False) if max_depth is None else (F.col("depth") >= max_depth) & (F.col("_w") == 1)
    label = (
        F.when(F.col("_s") == "external", LEAF_EXTERNAL).when(F.col("_s") == "no_module", LEAF_NO_MODULE).when(F.col("_s") == "no_function", LEAF_NOT_FOUND)
        .when(beyond & F.col("_seen").isNull(), LEAF_MAX_DEPTH)
    )
    return j.select(*keys, "root", F.col("node").alias("src"), "callee", "dst", "depth", label.alias("label"))


def classify_calls(calls: DataFrame, defined: DataFrame, imports: DataFrame, key: list[str]) -> DataFrame:
    """JON-08/09: each call ``(key, caller, callee)`` is ``local`` when the
    callee is defined in the same file, else ``import`` (with the alias
    target) when imported, else the external/builtin leaf."""
    d = defined.select(*key, F.col("name").alias("callee")).distinct().withColumn("_local", F.lit(True))
    i = imports.select(*key, F.col("alias").alias("callee"), F.col("target").alias("import_target"))
    # one row a definition or import: both grow with the files
    j = calls.join(d.hint("merge"), [*key, "callee"], "left").join(i.hint("merge"), [*key, "callee"], "left")
    res = (
        F.when(F.col("_local"), F.lit("local"))
        .when(F.col("import_target").isNotNull(), F.lit("import"))
        .otherwise(F.lit(LEAF_EXTERNAL))
    )
    return j.select(*calls.columns, res.alias("resolution"),
                    F.when(~F.coalesce(F.col("_local"), F.lit(False)), F.col("import_target")).alias("import_target"))
