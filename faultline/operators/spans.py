"""Line ↔ span operators: locate a changed line, find its enclosing
definition (interval join), and the lines no definition covers.

The interval join is an equi join on ``key + bucket`` followed by the range
predicate: each span is replicated into the ``bucket_lines``-sized buckets
it overlaps, each point falls in exactly one bucket.  A long file therefore
never produces a (lines × spans) product per file, only per bucket.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.session import spread

DEFAULT_BUCKET = 256
# Preference of span kinds when choosing the enclosing one
# (any function first, then a class).
KIND_RANK = {"function": 0, "async_function": 0, "class": 1}


def line_of_first_occurrence(source: Column, needle: Column) -> Column:
    """JON-05: 1-based line of the first occurrence of ``needle`` in
    ``source`` (``''`` matches at line 1, Q11); null when absent."""
    p = F.instr(source, needle)
    before = F.substring(source, 1, p - 1)
    nl = F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit("")))
    return F.when(p > 0, (nl + 1).cast("int")).when(needle == "", F.lit(1))


def locate(
    changed: DataFrame, sources: DataFrame, key: Sequence[str], line: str = "code", content: str = "content"
) -> DataFrame:
    """JON-05 as a join: ``changed(key, …, line)`` ⟕ ``sources(key, content)``.
    ``status`` is ``found`` / ``not_found`` (no match) / ``no_file``.

    A file's distinct changed lines go to its text, which travels once, and come
    back as line numbers; the text is never repeated for each of its lines."""
    key = list(key)
    wanted = changed.where(F.col(line).isNotNull()).groupBy(*key).agg(F.collect_set(line).alias("_lines"))
    texts = sources.where(F.col(content).isNotNull()).select(*key, F.col(content).alias("_src"))
    numbered = F.transform("_lines", lambda n: F.struct(n.alias("n"), line_of_first_occurrence(F.col("_src"), n).alias("at")))
    found = texts.join(wanted.hint("merge"), key).select(*key, F.explode(numbered).alias("_x")).select(*key, F.col("_x.n").alias(line), F.col("_x.at").alias("line_no"), F.lit(True).alias("_file"))
    j = changed.join(found.hint("merge"), [*key, line], "left")
    status = F.when(F.col("_file").isNull(), "no_file").when(F.col("line_no").isNull(), "not_found").otherwise("found")
    return j.select(*changed.columns, "line_no", status.alias("status"))


def locate_at(changed: DataFrame, sources: DataFrame, key: Sequence[str], line: str = "code", content: str = "content", line_no: str = "line_no") -> DataFrame:
    """JON-05 by hunks: lines that come with their number (``patches.numbered_lines``)
    looked up there.  ``status`` is ``found`` where the file has that text on that
    line, ``not_found`` where it has another or none, ``no_file``.

    A file's distinct numbers go to its text, as in :func:`locate`."""
    key = list(key)
    wanted = changed.where(F.col(line_no).isNotNull()).groupBy(*key).agg(F.collect_set(line_no).alias("_numbers"))
    texts = sources.where(F.col(content).isNotNull()).select(*key, F.split(content, "\n", -1).alias("_src"))
    at = F.transform("_numbers", lambda n: F.struct(n.alias("n"), F.get("_src", n - 1).alias("text")))
    shown = texts.join(wanted.hint("merge"), key).select(*key, F.explode(at).alias("_x")).select(*key, F.col("_x.n").alias(line_no), F.col("_x.text").alias("_text"))
    files = texts.select(*key, F.lit(True).alias("_file"))
    j = changed.join(shown.hint("merge"), [*key, line_no], "left").join(files.hint("merge"), key, "left")
    status = F.when(F.col("_file").isNull(), "no_file").when(F.col("_text") == F.col(line), "found").otherwise("not_found")
    return j.select(*changed.columns, status.alias("status"))


def _bucketed_spans(spans: DataFrame, start: str, end: str, bucket_lines: int) -> DataFrame:
    lo = F.floor((F.col(start) - 1) / bucket_lines).cast("int")
    hi = F.floor((F.col(end) - 1) / bucket_lines).cast("int")
    return spans.withColumn("_b", F.explode(F.sequence(lo, F.greatest(lo, hi))))


def interval_join(
    points: DataFrame,
    spans: DataFrame,
    key: Sequence[str],
    point: str,
    start: str = "start_line",
    end: str = "end_line",
    how: str = "inner",
    bucket_lines: int = DEFAULT_BUCKET,
    partitions: int | None = None,
) -> DataFrame:
    """Rows of ``points`` with every span of the same key where
    ``start <= point <= end`` (``how`` = inner, left_semi or left_anti).

    Spans grow with the files, so they are never sent to the driver, however small
    their tables are estimated.  ``partitions`` fixes how many the join has."""
    p = points.withColumn("_b", F.floor((F.col(point) - 1) / bucket_lines).cast("int"))
    s = _bucketed_spans(spans, start, end, bucket_lines)
    s_cols = [c for c in s.columns if c not in key and c != "_b"]
    s = s.select(*[F.col(k).alias(f"_s_{k}") for k in key], F.col("_b").alias("_s_b"),
                 *[F.col(c).alias(c) for c in s_cols])
    if partitions:
        p, s = spread(p, [*key, "_b"], n=partitions), spread(s, [*(f"_s_{k}" for k in key), "_s_b"], n=partitions)
    cond = [p[k] == s[f"_s_{k}"] for k in key] + [p["_b"] == s["_s_b"]]
    cond += [s[start] <= p[point], p[point] <= s[end]]
    j = p.join(s.hint("merge"), cond, how)
    if how in ("left_semi", "left_anti"):
        return j.drop("_b")
    return j.drop("_b", "_s_b", *[f"_s_{k}" for k in key])


def enclosing(
    points: DataFrame,
    spans: DataFrame,
    key: Sequence[str],
    point: str = "line_no",
    name: str = "name",
    kind: str = "kind",
    bucket_lines: int = DEFAULT_BUCKET,
) -> DataFrame:
    """JON-06/SRT-06: the outermost enclosing function (smallest start; on a
    tie the longer one, then the name), else the outermost class, else null.
    Output: ``points`` columns + ``enclosing``, ``enclosing_kind``."""
    rank = F.coalesce(*[F.when(F.col(kind) == k, F.lit(v)) for k, v in KIND_RANK.items()], F.lit(9))
    sp = spans.select(*key, F.col(name).alias("_n"), F.col(kind).alias("_k"), rank.alias("_r"),
                      F.col("start_line"), F.col("end_line"))
    # the answer depends only on (key, point): compute it once per distinct
    # point and join back (deterministic under recomputation)
    pts = points.select(*key, point).distinct()
    hit = interval_join(pts, sp, key, point, bucket_lines=bucket_lines)
    best = hit.groupBy(*key, point).agg(
        F.min_by(F.struct(F.col("_n"), F.col("_k")),
                 F.struct(F.col("_r"), F.col("start_line"), -F.col("end_line"), F.col("_n"))).alias("_best")
    )
    out = points.join(best.hint("merge"), [*key, point], "left")
    return out.select(*points.columns, F.col("_best._n").alias("enclosing"), F.col("_best._k").alias("enclosing_kind"))


def uncovered_lines(
    lines: DataFrame, spans: DataFrame, key: Sequence[str], start: str = "start_line", cover_end: str = "cover_end",
    bucket_lines: int = DEFAULT_BUCKET,
) -> DataFrame:
    """FLT-06: the lines (``key + [line_no, line]``) outside every span's cover."""
    s = spans.select(*key, F.col(start).alias("start_line"), F.col(cover_end).alias("end_line"))
    return interval_join(lines, s, key, "line_no", how="left_anti", bucket_lines=bucket_lines)
