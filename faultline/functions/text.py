"""Text helpers as Column expressions (JVM-side, inside whole-stage codegen).

Regex notes: Java's ``\\w``/``\\s`` are ASCII unless ``(?U)``; Python's ``\\Z``
is Java's ``\\z``; multiline ``^``/``$`` need ``(?d)`` to treat only ``\\n`` as
a line end.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NL = "\n"

# Fixed values that must equal the original rules.
# Decoration line (full match after strip): a run of 5+ of "-_=~" or whitespace,
# or such a run, anything, and another such run.
DECORATION_RE = r"(?U)^(?:[-_=~\s]{5,}|[-_=~\s]{5,}.*?[-_=~\s]{5,})$"
# Failing test names in a test log: "ERROR: name" or "FAIL: name".
FAILING_TEST_RE = r"(?U)(?:ERROR|FAIL): (\w+)"
# Hunk-header function names: "@@ ... def name(" at a line start.
HUNK_DEF_RE = r"(?md)^@@.*\b(?:def)\s+(\w+)\s*\("
# Path from a diff header "diff --git a/X b/Y" (greedy: the last " b/").
DIFF_PATH_RE = r"^diff --git a/.* b/(.*)$"
# pytest sections: after a FAILURES/ERRORS banner, up to the next banner or end.
PYTEST_SECTION_RE = (
    r"(?s)=+ (?:FAILURES|ERRORS) =+\n(.*?)"
    r"(?=\n[-=]{10,} (Captured|warnings summary|short test summary info|ERRORS|FAILURES|slowest)[^\n]* [-=]{10,}|\z)"
)
# unittest block: first FAIL/ERROR line, a dashed line, then up to the next
# 10+ dash line or the end.
UNITTEST_BLOCK_RE = r"(?smd)^(FAIL|ERROR): .+?\n-+\n(?:.*?)(?=^-{10,}|\z)"


def lines(c: Column) -> Column:
    """``str.splitlines()`` for text without ``\\r``/``\\v``/``\\f``: split on
    ``\\n`` and drop the one empty piece a trailing newline leaves."""
    parts = F.split(c, NL, -1)
    return F.when(c == "", F.array().cast("array<string>")).otherwise(
        F.when(c.endswith(NL), F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    )


def py_strip(c: Column) -> Column:
    """``str.strip()``: Unicode whitespace at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def basename(c: Column) -> Column:
    """PRJ-01: ``x.split('/')[-1]``."""
    return F.substring_index(c, "/", -1)


def merge_newlines(c: Column) -> Column:
    """SCA-08: runs of newlines become one."""
    return F.regexp_replace(c, "\n+", "\n")


def count_substr(c: Column, needle: str) -> Column:
    """SCA-12: ``str.count`` (non-overlapping occurrences)."""
    return F.floor((F.length(c) - F.length(F.replace(c, F.lit(needle), F.lit("")))) / F.lit(len(needle))).cast("bigint")


def n_parts(c: Column) -> Column:
    """SCA-16: number of ``\\n``-separated parts (``len(x.split('\\n'))``)."""
    return F.size(F.split(c, NL, -1)).cast("bigint")


def n_readlines(c: Column) -> Column:
    """SCA-16: ``len(f.readlines())``: no extra line after a final newline."""
    nl = (F.length(c) - F.length(F.replace(c, F.lit(NL), F.lit("")))).cast("bigint")
    return nl + F.when((F.length(c) > 0) & ~c.endswith(NL), F.lit(1)).otherwise(F.lit(0))


def remove_decorations(c: Column) -> Column:
    """FLT-03: drop lines that are separators or ``___ name ___`` banners."""
    return F.array_join(F.filter(lines(c), lambda ln: ~py_strip(ln).rlike(DECORATION_RE)), NL)


def failing_tests(c: Column) -> Column:
    """SCA-05: every ``FAIL:``/``ERROR:`` test name, duplicates kept, in order."""
    return F.regexp_extract_all(c, F.lit(FAILING_TEST_RE), 1)


def pytest_sections(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(PYTEST_SECTION_RE), 1)


def extract_traceback(raw: Column, sections: Column) -> Column:
    """SCA-06: pytest form (every failure section, stripped, joined, then
    FLT-03), else the first unittest block prefixed ``FAIL: `` (Q13), else null.
    ``sections`` is a column that holds :func:`pytest_sections`."""
    pytest_text = remove_decorations(F.array_join(F.transform(sections, py_strip), NL))
    ut = F.regexp_extract(raw, UNITTEST_BLOCK_RE, 0)
    return (
        F.when(F.size(sections) > 0, pytest_text)
        .when(ut != "", F.concat(F.lit("FAIL: "), py_strip(ut)))
        .otherwise(F.lit(None).cast("string"))
    )


def parse_kv(c: Column) -> Column:
    """SRC-09/SCA-07: ``key="value"`` lines → array<struct<pos,key,value>>.

    Per line: strip, split on ``=``, key = trimmed field 0, value = field 1
    with every ``"`` removed (text after a second ``=`` is dropped, Q15).
    Lines without ``=`` give a null value (the original raises).  Duplicate
    keys are resolved by the caller with ``max_by(value, pos)`` (last wins).
    """
    ls = F.split(py_strip(c), NL, -1)
    return F.transform(
        ls,
        lambda ln, i: F.struct(
            i.alias("pos"),
            py_strip(F.split(py_strip(ln), "=", -1)[0]).alias("key"),
            F.replace(F.get(F.split(py_strip(ln), "=", -1), 1), F.lit('"'), F.lit("")).alias("value"),
        ),
    )


def fmt_pct(c: Column, digits: int = 2) -> Column:
    """SCA-13: ``f"{x*100:.2f}%"``."""
    return F.format_string(f"%.{digits}f%%", c * 100.0)


def module_path(c: Column) -> Column:
    """SCA-18: module ``a.b.c`` → candidate paths ``a/b.py`` and
    ``a/b/__init__.py`` (the last part is dropped when there is more than one)."""
    parts = F.split(c, r"\.", -1)
    keep = F.when(F.size(parts) > 1, F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    base = F.array_join(keep, "/")
    return F.struct(F.concat(base, F.lit(".py")).alias("as_file"), F.concat(base, F.lit("/__init__.py")).alias("as_pkg"))
