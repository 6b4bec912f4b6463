"""Unified-diff operators: changed paths, hunk function names, changed lines.

A diff is one row; its lines are exploded with their position and the hunk
state machine becomes running window values partitioned by the diff's key,
so the work per window partition is bounded by the size of one diff.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faultline.functions import text as T
from faultline.operators import spans as S
from faultline.session import cut, spread


def changed_paths(patches: DataFrame, key: Sequence[str], diff: str = "diff") -> DataFrame:
    """SCA-01 + SRC-10: a patch that parses as a JSON array of strings is the
    path list; otherwise one path per ``diff --git`` line (order and duplicates
    kept).  Output ``key + [pos, path]``."""
    d = F.col(diff)
    as_json = F.when(d.rlike(r"^\s*\["), F.from_json(d, "array<string>"))
    from_diff = F.transform(
        F.filter(T.lines(d), lambda ln: ln.startswith("diff --git") & ln.rlike(T.DIFF_PATH_RE)),
        lambda ln: F.regexp_extract(ln, T.DIFF_PATH_RE, 1),
    )
    paths = F.coalesce(as_json, from_diff)
    return patches.select(*key, F.posexplode(paths).alias("pos", "path"))


def hunk_functions(patches: DataFrame, key: Sequence[str], diff: str = "diff") -> DataFrame:
    """SCA-02: distinct ``def`` names in hunk headers, sorted for determinism."""
    names = F.array_sort(F.array_distinct(F.regexp_extract_all(F.col(diff), F.lit(T.HUNK_DEF_RE), 1)))
    return patches.select(*key, names.alias("functions"))


def changed_lines(
    patches: DataFrame, key: Sequence[str], diff: str = "diff", fixed: bool = False
) -> DataFrame:
    """SCA-03/WIN-05: lines removed (or added, ``fixed=True``) inside hunks,
    with the file named by the last ``--- a/`` header of the current diff
    section.  A block whose file is unknown is dropped (Q12).
    Output ``key + [pos, file, code]``."""
    return _kept(_marked(patches, key, diff), key, fixed)


def _marked(patches: DataFrame, key: Sequence[str], diff: str) -> DataFrame:
    """``key + [pos, line]`` of every line, with what kind of header it is and the file and hunk it stands in."""
    x = spread(patches, key, text=diff).select(*key, F.posexplode(T.lines(F.col(diff))).alias("pos", "line"))
    ln = F.col("line")
    is_diff = ln.startswith("diff --git")
    is_file = ~is_diff & ln.startswith("--- a/")
    is_hunk = ~is_diff & ~is_file & ln.startswith("@@")
    w = Window.partitionBy(*key).orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # '' marks "reset by a diff header"; a file header sets the name
    file_mark = F.when(is_diff, F.lit("")).when(is_file, T.py_strip(F.substring(ln, 7, 1 << 30)))
    hunk_mark = F.when(is_diff, F.lit(0)).when(is_hunk, F.lit(1))
    return x.select(
        *key,
        "pos",
        "line",
        is_diff.alias("_d"),
        is_file.alias("_f"),
        is_hunk.alias("_h"),
        F.last(file_mark, ignorenulls=True).over(w).alias("_file"),
        F.last(hunk_mark, ignorenulls=True).over(w).alias("_in"),
    )


def _kept(marked: DataFrame, key: Sequence[str], fixed: bool, *more: str) -> DataFrame:
    if fixed:
        take = F.col("line").startswith("+")
    else:
        take = F.col("line").startswith("-") & ~F.col("line").startswith("---")
    keep = ~F.col("_d") & ~F.col("_f") & ~F.col("_h") & (F.col("_in") == 1) & take
    return marked.where(keep & (F.coalesce(F.col("_file"), F.lit("")) != "")).select(
        *key, "pos", F.col("_file").alias("file"), F.substring(F.col("line"), 2, 1 << 30).alias("code"), *more
    )


HUNK_START = r"^@@ -(\d+)(?:,\d+)? \+(\d+)(?:,\d+)? @@"


def numbered_lines(patches: DataFrame, key: Sequence[str], diff: str = "diff", fixed: bool = False) -> DataFrame:
    """JON-05 by hunks (Q11): ``changed_lines`` with the line's number in the old file
    (in the new one, ``fixed=True``).

    A hunk header ``@@ -a,b +c,d @@`` sets the old file's line to ``a`` and the new
    one's to ``c``; behind it a common line moves both, a removed one the old, an
    added one the new: a running sum that starts anew at each header.  Output
    ``key + [pos, file, code, line_no]``; without a readable header the number is
    null.  Lines are read once, in one pass by key; a key that comes several times has at each
    place the numbers of all its patches, and a null key none."""
    key = list(key)
    x = _marked(patches, key, diff)
    ln = F.col("line")
    head = ln.startswith("@@")
    section = ln.startswith("diff --git")
    so_far = Window.partitionBy(*key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    x = x.withColumn("_hunk", F.sum((head | section).cast("int")).over(so_far))
    at = Window.partitionBy(*key, "_hunk").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    # an empty line is a common one whose blank was lost
    moves = (ln.startswith("+" if fixed else "-") | ln.startswith(" ") | (ln == "")) & ~head & ~section
    start = F.regexp_extract("line", HUNK_START, 2 if fixed else 1)
    x = x.withColumns({
        "_start": F.max(F.when(head & (start != ""), start.cast("int"))).over(Window.partitionBy(*key, "_hunk")),
        "_moved": F.coalesce(F.sum(moves.cast("int")).over(at), F.lit(0)),
    })
    number = (F.col("_start") + F.col("_moved")).cast("int")
    # collect_list leaves nulls out, a struct isn't one
    x = x.withColumn("_numbers", F.collect_list(F.struct(number.alias("n"))).over(Window.partitionBy(*key, "pos")))
    known = F.lit(True)
    for k in key:
        known = known & F.col(k).isNotNull()
    found = _kept(x, key, fixed, "_numbers")
    return found.select(*key, "pos", "file", "code", F.explode(F.when(known, F.col("_numbers.n")).otherwise(F.array(F.lit(None).cast("int")))).alias("line_no"))


def changed_functions(
    patches: DataFrame, old_files: DataFrame, old_spans: DataFrame, new_files: DataFrame, new_spans: DataFrame, key: Sequence[str], diff: str = "diff",
) -> DataFrame:
    """SCA-04: the definitions around removed lines in the old files; for a patch
    without any found that way, those around its added lines in the new ones.

    ``files(key, file, content)``, ``spans(key, file, name, kind, start_line,
    end_line)``.  Output: ``key + [pos, file, line_no, status, enclosing,
    enclosing_kind, mode]`` for every line looked up, with ``mode`` 'buggy' or 'fixed'."""
    at = [*key, "file"]
    marked = _marked(patches, key, diff)

    def found(fixed: bool, files: DataFrame, spans: DataFrame) -> DataFrame:
        # lines and places are read several times below
        x = cut(S.locate(cut(_kept(marked, key, fixed), "changed"), files, at), "located")
        y = S.enclosing(x, spans, at)
        return y.select(*key, "pos", "file", "line_no", "status", "enclosing", "enclosing_kind", F.lit("fixed" if fixed else "buggy").alias("mode"))

    old = cut(found(False, old_files, old_spans), "old")
    has = old.where(F.col("enclosing_kind").isin("function", "async_function")).select(*key).distinct().hint("merge")
    new = found(True, new_files, new_spans).join(has, list(key), "left_anti")
    return old.unionByName(new)


def last_wins_map(named: DataFrame, key: Sequence[str], name: str, value: str, seq: str) -> DataFrame:
    """AGG-16: name → value where a later ``seq`` overwrites an earlier one."""
    return named.groupBy(*key, name).agg(F.max_by(F.col(value), F.col(seq)).alias(value))
