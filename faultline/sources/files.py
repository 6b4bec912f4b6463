"""File-tree scans and path rules.

A source tree is read as rows ``(path, content)`` with Spark's file sources;
path rules (ignore patterns, language extensions, hidden components) are
Column predicates, so they run inside the scan's stage with no join.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Language → file extensions of the original repository helper.
LANGUAGE_EXTENSIONS: dict[str, list[str]] = {
    "python": [".py"],
    "java": [".java"],
    "c++": [".cpp", ".cxx", ".cc", ".h"],
    "javascript": [".js", ".ts"],
    "go": [".go"],
}


def read_tree(spark: SparkSession, root: str, glob: str = "*.py", binary: bool = False) -> DataFrame:
    """SRC-01/05/11: every file under ``root`` matching ``glob`` as
    ``(path, content)``; undecodable files are dropped (binary mode + UTF-8
    validation) instead of failing the task."""
    if binary:
        df = (
            spark.read.format("binaryFile")
            .option("recursiveFileLookup", "true")
            .option("pathGlobFilter", glob)
            .load(root)
        )
        txt = F.try_validate_utf8(F.col("content").cast("string"))
        return df.select(F.col("path"), txt.alias("content")).where(F.col("content").isNotNull())
    df = (
        spark.read.option("recursiveFileLookup", "true")
        .option("pathGlobFilter", glob)
        .text(root, wholetext=True)
    )
    return df.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))


def relative_path(path: Column, root: str) -> Column:
    """Path below ``root``; a ``file:`` scheme on either side is ignored."""
    strip = lambda x: F.regexp_replace(x, r"^file:(//)?", "")
    prefix = root.rstrip("/") + "/"
    if prefix.startswith("file:"):
        prefix = prefix[5:].lstrip("/")
        prefix = "/" + prefix
    p = strip(path)
    return F.when(p.startswith(prefix), F.substring(p, len(prefix) + 1, 1 << 30)).otherwise(p)


def extension(path: Column) -> Column:
    """``os.path.splitext``: the last ``.suffix`` of the basename ('' when none)."""
    return F.regexp_extract(F.substring_index(path, "/", -1), r"^.+(\.[^.]*)$", 1)


def has_language(path: Column, language: str, mapping: Mapping[str, Sequence[str]] | None = None) -> Column:
    """SRC-03: extension is one of the language's extensions."""
    exts = (mapping or LANGUAGE_EXTENSIONS)[language]
    return extension(path).isin(*exts)


def is_visible(path: Column) -> Column:
    """SRC-04: no path component starts with ``.`` (the original helper is
    named ``is_hidden`` but returns True for visible paths)."""
    return ~F.exists(F.split(path, "/", -1), lambda c: c.startswith("."))


def _class_regex(body: str) -> str:
    """A bracket expression's body as a regex class that never matches ``/``."""
    negated = body[:1] in ("!", "^")
    inner = re.sub(r"([\\\[\]&~^])", r"\\\1", body[1:] if negated else body)
    return f"[^/{inner}]" if negated else f"(?!/)[{inner}]"


def wildmatch_regex(pattern: str) -> tuple[str, bool] | None:
    """One gitwildmatch rule → (anchored regex on a relative path, negated).

    Blank lines and comments give None; blanks at the end don't count unless
    escaped; ``\\`` takes the next character as it is; ``[...]`` is a class; ``**`` is
    special only as a whole path component and like ``*`` elsewhere."""
    rule = pattern.rstrip("\n")
    while rule.endswith(" ") and not rule.endswith("\\ "):
        rule = rule[:-1]
    if not rule or rule.startswith("#"):
        return None
    negated = rule.startswith("!")
    rule = rule[negated:]
    only_folders = rule.endswith("/")
    rule = rule.rstrip("/")
    from_root = "/" in rule
    parts = rule.lstrip("/").split("/")
    out = ""
    for k, part in enumerate(parts):
        last = k == len(parts) - 1
        if part == "**":
            out += ".+" if last else "(?:.*/)?"
            continue
        i = 0
        while i < len(part):
            c = part[i]
            close = part.find("]", i + 2 + (part[i + 1:i + 2] in ("!", "^"))) if c == "[" else -1
            if c == "\\" and i + 1 < len(part):
                i += 1
                out += re.escape(part[i])
            elif c == "*":
                while part[i + 1:i + 2] == "*":
                    i += 1
                out += "[^/]*"
            elif c == "?":
                out += "[^/]"
            elif close > 0:
                out += _class_regex(part[i + 1:close])
                i = close
            else:
                out += re.escape(c)
            i += 1
        out += "" if last else "/"
    return ("^" if from_root else "^(?:.*/)?") + out + ("/.*$" if only_folders else "(?:/.*)?$"), negated


def compile_rules(lines: Sequence[str]) -> list[tuple[str, bool]]:
    """SRC-02: rule file lines → ordered (regex, negated); a missing file is []."""
    return [r for r in (wildmatch_regex(x) for x in lines) if r is not None]


def ignored(path: Column, rules: Sequence[tuple[str, bool]]) -> Column:
    """SRC-02: the last matching rule decides (negated rules re-include).

    Built as one CASE expression, last rule first; there is no join, so the
    rule set never multiplies rows.
    """
    expr = None
    for regex, neg in reversed(list(rules)):
        cond = path.rlike(regex)
        val = F.lit(not neg)
        expr = F.when(cond, val) if expr is None else expr.when(cond, val)
    return F.lit(False) if expr is None else expr.otherwise(F.lit(False))


def lookup_content(wanted: DataFrame, snapshot: DataFrame, on: Sequence[str], content: str = "content") -> DataFrame:
    """SRC-06: point lookups; a missing file gives '' (never an error)."""
    j = wanted.join(snapshot.select(*on, content), list(on), "left")
    return j.select(*wanted.columns, F.col(content).isNotNull().alias("found"),
                    F.coalesce(F.col(content), F.lit("")).alias(content))


def read_documents(spark: SparkSession, path: str, schema: str, multi_line: bool = True) -> DataFrame:
    """SRC-12/14: JSON documents (a list or an object a file, or a line) with a given schema; a malformed one is left out."""
    return spark.read.schema(schema).option("multiLine", multi_line).option("mode", "DROPMALFORMED").json(path)


CORRUPT = "_corrupt_record"


def read_checked(spark: SparkSession, path: str, schema: str, multi_line: bool = False) -> tuple[DataFrame, DataFrame]:
    """SRC-12/14: JSON documents (one a line, or one a file) in two tables: those that fit
    the schema, with the columns that the folders' names give, and ``(path, record)``
    of those that don't.  Blank lines are no documents."""
    raw = spark.read.text(path, wholetext=multi_line).where(F.trim("value") != "")
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    parsed = F.from_json("value", f"{schema}, {CORRUPT} string", options)
    folders = [c for c in raw.columns if c != "value"]
    rows = raw.select(*folders, "value", F.col("_metadata.file_path").alias("path"), parsed.alias("_j"))
    bad = F.coalesce(F.col(f"_j.{CORRUPT}").isNotNull(), F.lit(True))
    good = rows.where(~bad).select(*folders, "_j.*").drop(CORRUPT)
    return good, rows.where(bad).select("path", F.col("value").alias("record"))


def read_vectors(spark: SparkSession, path: str, vec: str = "embedding", dim: int | None = None) -> tuple[DataFrame, DataFrame]:
    """SRC-13: vectors that ``report.write_vectors`` wrote, in two tables: those of
    ``dim`` finite numbers (any length without ``dim``), and the others."""
    rows = spark.read.parquet(path)
    whole = F.col(vec).isNotNull() & ~F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    if dim is not None:
        whole = whole & (F.size(vec) == dim)
    whole = F.coalesce(whole, F.lit(False))
    return rows.where(whole), rows.where(~whole)


def read_results(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """SRC-15: the ``.json`` files of a result folder, with ``project`` from the file's name."""
    rows = spark.read.schema(schema).option("multiLine", True).option("pathGlobFilter", "*.json").json(folder)
    return rows.withColumn("project", F.regexp_replace(F.col("_metadata.file_name"), r"\.json$", ""))


def bugs_of(paths: DataFrame, path: str = "path") -> DataFrame:
    """SRC-08: the distinct (project, bug) folders of relative paths ``project/bug/…``."""
    p = F.split(path, "/", -1)
    return paths.where(F.size(p) > 2).select(p[0].alias("project"), p[1].alias("bug")).distinct()


def in_numeric_order(bugs: DataFrame, bug: str = "bug") -> DataFrame:
    """SRT-03: string ids in the order of their numbers; others come last, by text."""
    return bugs.orderBy(F.expr(f"try_cast({bug} as bigint)").asc_nulls_last(), bug)
