"""Code facts of Python files, derived from their lines as a Spark job.

``lexer.lines`` tells, for every line, what is code, string and comment, how far
it is indented and whether a statement begins there.  A block (what is indented
below a header, definitions among them) ends before the next line that is indented
no further, which is the next row of its level when every line is listed under the
levels that it can close.  Blocks nest, so one sweep over their starts and ends,
with running sums of what is open, gives each definition its number, its depth and
what it stands in.  All else (chunks, calls, imports, names, removal of comments)
are filters, interval joins and ordered aggregates on those two tables: UDTF-01, -05
to -09, -11, -12, FLT-05, AGG-17, SRT-05.  ``facts`` writes both once.

Groups are files, so a task holds the lines of one file at most, one row each.
A header that a backslash cuts in two is not seen as one, nor are calls inside
f-strings.  Unparsable text gives whatever its lines show and fails nothing.
"""

from __future__ import annotations

import builtins
import keyword
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faultline.operators.lexer import CLOSED, lines
from faultline.operators.spans import interval_join
from faultline.session import cut, parts, spread

HEADER = r"^\s*(async\s+def|def|class)\s+(\w+)"
NOT_CALLS = sorted({*dir(builtins), *keyword.kwlist})
# Clauses that go on with the statement before them at their level.
CLAUSES = ("elif", "else", "except", "finally")
LINES = 1 << 17  # lines for each partition


def facts(files: DataFrame, key: Sequence[str], content: str = "content") -> tuple[DataFrame, DataFrame]:
    """The ``lines`` and ``spans`` of files, each derived once and written to the
    session's shared folder."""
    found = cut(lines(files, key, content), "lines")
    return found, cut(spans(by_file(found, key), key), "spans")


def by_file(file_lines: DataFrame, key: Sequence[str]) -> DataFrame:
    """Lines that were written, dealt out by file for what goes along it."""
    return spread(file_lines, key, LINES)


def spans(file_lines: DataFrame, key: Sequence[str]) -> DataFrame:
    """UDTF-07: ``key + [seq, name, kind, first_line, start_line, end_line, cover_end, depth, level, nested]``.

    ``first_line`` is the first decorator's; ``cover_end`` the line where the last
    statement of the body begins (Q22); ``depth`` counts the definitions around
    it, ``level`` the nodes around it in the syntax tree (blocks, with the nodes of
    ``except`` and ``case`` and the chain of ``elif``); ``nested`` tells whether it
    stands in a function."""
    key = list(key)
    order = Window.partitionBy(*key).orderBy("line_no")
    held = file_lines.where("holds").withColumns({"_before": F.lag("line_no").over(order), "_last": F.max("line_no").over(Window.partitionBy(*key))})
    code = F.trim("code")
    s = held.where("starts").select(
        *key, "line_no", "indent", "_before", "_last", F.startswith(code, F.lit("@")).alias("_deco"), F.regexp_extract("code", HEADER, 2).alias("name"),
        F.regexp_replace(F.regexp_extract("code", HEADER, 1), r"\s+", " ").alias("_kind"), F.regexp_extract(code, r"^\w*", 0).alias("_word"),
    )
    # decorators share the number of other lines before them with the header that follows
    s = s.withColumn("_run", F.coalesce(F.sum((~F.col("_deco")).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    s = s.withColumn("first_line", F.min("line_no").over(Window.partitionBy(*key, "_run")))
    inner = F.lead("indent").over(order)
    s = s.withColumn("_body", F.when(inner > F.col("indent"), inner)).withColumn("_def", F.col("_kind") != "")
    s = s.withColumn("_head", F.col("_def") | F.col("_body").isNotNull())
    # every line under the levels that it ends: the row after a header's is where it ends at its own level,
    # and at the level of its body the rows up to the next line further out are its statements
    levels = s.where("_head").select(*key, F.explode(F.array_compact(F.array("indent", "_body"))).alias("_level")).distinct()
    at = Window.partitionBy(*key, "_level").orderBy("line_no")
    so_far = at.rowsBetween(Window.unboundedPreceding, 0)
    listed = s.join(levels.hint("merge"), key).where("indent <= _level")
    own = F.col("indent") == F.col("_level")
    listed = listed.withColumns({
        "_next": F.lead("_before").over(at),
        "_block": F.sum((~own).cast("int")).over(so_far),
        # a statement with its clauses, and how many elif it has had
        "_with": F.sum((~(own & F.col("_word").isin(*CLAUSES))).cast("int")).over(so_far),
    })
    listed = listed.withColumns({
        "_stmt": F.max(F.when(~F.col("_deco"), F.col("line_no"))).over(Window.partitionBy(*key, "_level", "_block")),
        "_elifs": F.sum((own & (F.col("_word") == "elif")).cast("int")).over(
            Window.partitionBy(*key, "_level", "_with").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)),
    })
    weight = F.when(F.col("_word").isin("elif", "else"), F.col("_elifs") + 1).when(F.col("_word") == "except", 2).otherwise(1)
    h = listed.where("_head").groupBy(*key, "line_no").agg(
        *(F.first(c).alias(c) for c in ("name", "_kind", "_def", "first_line", "_last")), F.max(F.when(own, F.col("_next"))).alias("_end"),
        F.max(F.when(F.col("_level") == F.col("_body"), F.col("_stmt"))).alias("_cover"), F.max(F.when(own, weight)).alias("_weight"),
    ).withColumn("_end", F.coalesce("_end", "_last"))
    # the sweep: a start comes before what begins in it, an end behind all of its line
    turn = lambda pos, sign: F.struct(pos.alias("_pos"), F.lit(sign).alias("_sign"))
    events = h.select("*", F.explode(F.array(turn(2 * F.col("line_no"), 1), turn(2 * F.col("_end") + 1, -1))).alias("_t")).select("*", "_t.*").drop("_t")
    before = Window.partitionBy(*key).orderBy("_pos").rowsBetween(Window.unboundedPreceding, -1)
    is_def, is_function = F.col("_def").cast("int"), (F.col("_def") & (F.col("_kind") != "class")).cast("int")
    running = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0)).cast("int")
    swept = events.withColumns({
        "seq": running(F.when(F.col("_sign") == 1, is_def)), "depth": running(F.col("_sign") * is_def),
        "level": running(F.col("_sign") * F.col("_weight")), "_in_function": running(F.col("_sign") * is_function),
    })
    return swept.where("_def and _sign = 1").select(
        *key, "seq", "name", F.when(F.col("_kind") == "class", "class").when(F.col("_kind") == "def", "function").otherwise("async_function").alias("kind"),
        "first_line", F.col("line_no").alias("start_line"), F.col("_end").alias("end_line"), F.coalesce("_cover", "line_no").alias("cover_end"),
        "depth", "level", (F.col("_in_function") > 0).alias("nested"),
    )


def _text(rows: DataFrame, key: Sequence[str], by: Sequence[str], n: int) -> DataFrame:
    """Lines of each group as one text, in line order; ``n`` partitions."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda r: r["text"]), "\n")
    return spread(rows, key, n=n).groupBy(*key, *by).agg(joined.alias("code"))


def chunks(file_lines: DataFrame, found: DataFrame, key: Sequence[str], cover: str = "cover_end") -> DataFrame:
    """UDTF-01: ``key + [seq, name, start_line, end_line, code]``: the root remainder
    (if any line is left), then functions and classes, outer nodes of the syntax
    tree first; async functions are not chunked.  A definition covers the lines up to
    where its last statement begins; with ``cover="end_line"`` up to its end (Q22)."""
    key = list(key)
    n = parts(file_lines, LINES)
    own = found.where("kind <> 'async_function'")
    shown = file_lines.select(*key, "line_no", "text")
    # a file's final line feed ends its last line and doesn't begin another
    last = F.max("line_no").over(Window.partitionBy(*key))
    covers = own.select(*key, "start_line", F.col(cover).alias("_cover"))
    left = interval_join(spread(shown, key, n=n).withColumn("_n", last), covers, key, "line_no", end="_cover", how="left_anti", partitions=n)
    root = _text(left.where(~((F.col("line_no") == F.col("_n")) & (F.col("text") == ""))), key, [], n).where("code <> ''")
    none = F.lit(None).cast("int")
    root = root.select(*key, F.lit(-1).alias("level"), F.lit("root").alias("name"), none.alias("start_line"), none.alias("end_line"), "code")
    spans_of = own.select(*key, "level", "name", F.col("first_line").alias("start_line"), "end_line")
    rest = _text(interval_join(shown, spans_of, key, "line_no", partitions=n), key, ["level", "name", "start_line", "end_line"], n)
    every = spread(root.unionByName(rest.select(root.columns)), key, n=n)
    rank = F.row_number().over(Window.partitionBy(*key).orderBy("level", "start_line"))
    return every.select(*key, (rank - 1).cast("int").alias("seq"), "name", "start_line", "end_line", "code")


def bodies(file_lines: DataFrame, found: DataFrame, key: Sequence[str]) -> DataFrame:
    """UDTF-09: ``key + [seq, code]``: source of every span, without its decorators."""
    key, n = list(key), parts(file_lines, LINES)
    inside = interval_join(file_lines.select(*key, "line_no", "text"), found.select(*key, "seq", "start_line", "end_line"), key, "line_no", partitions=n)
    return _text(inside, key, ["seq"], n)


def calls(file_lines: DataFrame, found: DataFrame, key: Sequence[str]) -> DataFrame:
    """UDTF-05/FLT-05: distinct ``key + [caller, callee]`` of functions that are
    not async; a function's own decorators are not part of it."""
    key, n = list(key), parts(file_lines, LINES)
    code = F.regexp_replace("code", HEADER, "")
    named = file_lines.where(F.contains("code", F.lit("("))).select(
        *key, "line_no", F.explode(F.regexp_extract_all(code, F.lit(r"([A-Za-z_]\w*)\s*\("), 1)).alias("callee")).where(~F.col("callee").isin(NOT_CALLS))
    callers = found.where("kind = 'function'").select(*key, F.col("name").alias("caller"), "start_line", "end_line")
    return spread(interval_join(named, callers, key, "line_no", partitions=n).select(*key, "caller", "callee"), key, n=n).distinct()


def defined(found: DataFrame, key: Sequence[str]) -> DataFrame:
    """UDTF-06: distinct names of functions outside functions (module level or in classes)."""
    return found.where("kind = 'function' and not nested").select(*key, "name").distinct()


def imports(file_lines: DataFrame, key: Sequence[str]) -> DataFrame:
    """UDTF-08: ``key + [alias, target]`` of imports that aren't indented, of several
    on a line each; the last of several with one alias counts."""
    key = list(key)
    order = Window.partitionBy(*key).orderBy("line_no")
    x = file_lines.where(F.trim("code") != "").select(*key, "line_no", "code", "indent", F.sum(F.col("starts").cast("int")).over(order).alias("_s"))
    # lines of one statement, kept where it can be an import: most statements go before lines are put together
    x = x.withColumn("_any", F.max(F.contains("code", F.lit("import")).cast("int")).over(Window.partitionBy(*key, "_s"))).where("_any = 1")
    piece = F.regexp_replace("code", r"\\$", "")
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", piece.alias("t")))), lambda r: r["t"]), " ")
    s = x.groupBy(*key, "_s").agg(whole.alias("_t"), F.min_by("indent", "line_no").alias("_i")).where("_i = 0")
    s = s.select(*key, "_s", F.posexplode(F.split("_t", ";")).alias("_k", "_t")).withColumn("_t", F.trim("_t"))
    source = F.regexp_extract("_t", r"^from\s+(\.*\s*[\w.]*)\s+import\s", 1)
    named = F.regexp_replace(F.regexp_extract("_t", r"^(?:from\s+\.*\s*[\w.]*\s+)?import\s+(.*)$", 1), r"[()]", "")
    s = s.select(*key, "_s", "_k", F.regexp_replace(source, r"^\.+\s*", "").alias("_m"), F.startswith("_t", F.lit("from")).alias("_from"), F.posexplode(F.split(named, ",")).alias("_p", "_n"))
    name, alias = F.regexp_extract("_n", r"^\s*([\w.*]+)", 1), F.regexp_extract("_n", r"\sas\s+(\w+)\s*$", 1)
    target = F.when(F.col("_from"), F.concat_ws(".", F.when(F.col("_m") == "", "None").otherwise(F.col("_m")), name)).otherwise(name)
    s = s.where(name != "").select(*key, "_s", "_k", "_p", F.when(alias != "", alias).otherwise(name).alias("alias"), target.alias("target"))
    return s.groupBy(*key, "alias").agg(F.max_by("target", F.struct("_s", "_k", "_p")).alias("target"))


def without_comments(files: DataFrame, file_lines: DataFrame, key: Sequence[str], content: str = "content") -> DataFrame:
    """UDTF-12/SRT-05: ``key + [code]``: every occurrence of each comment's text is
    removed, the longest first (two characters or fewer stay), then runs of line
    feeds become one."""
    key = list(key)
    text = F.trim("comment")
    found = file_lines.where(F.length(text) > 2).groupBy(*key).agg(F.collect_set(text).alias("_c"))
    by_length = F.reverse(F.array_sort(F.transform("_c", lambda c: F.struct(F.length(c).alias("n"), c.alias("c")))))
    left = F.aggregate(F.coalesce(by_length, F.array().cast("array<struct<n:int,c:string>>")), F.coalesce(F.col(content), F.lit("")), lambda acc, c: F.replace(acc, c["c"], F.lit("")))
    return files.join(found.hint("merge"), key, "left").select(*key, F.regexp_replace(left, "\n+", "\n").alias("code"))


def masked(file_lines: DataFrame, key: Sequence[str]) -> DataFrame:
    """UDTF-11: ``key + [code]`` as a reading of the tokens puts it together again: a
    comment is ``##`` and a line feed; the string that begins an indented block, or
    the file, is ``#--``; a backslash at the end of a line goes with its line feed
    and the blanks before it.  Tabs between tokens stay as they are."""
    key = list(key)
    order = Window.partitionBy(*key).orderBy("line_no")
    x = file_lines.withColumn("_run", F.sum(F.col("starts").cast("int")).over(order))
    # the first statement of a block is indented further than the one before it
    before = F.last(F.when(F.col("starts"), F.col("indent")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    string = F.regexp_like("text", F.lit(r"^[ \t]*(?i:[rub]|rb|br)?['\"]"))
    x = x.withColumn("_doc", F.col("starts") & string & F.when(before.isNull(), F.col("line_no") == 1).otherwise(F.col("indent") > before))
    # the string's own lines: up to the first one behind which it doesn't go on
    run = Window.partitionBy(*key, "_run").orderBy("line_no")
    ended = F.coalesce(F.sum((~F.col("opens")).cast("int")).over(run.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    x = x.withColumn("_of_doc", F.max("_doc").over(Window.partitionBy(*key, "_run")) & (ended == 0))
    n = F.length("comment")
    without = lambda c: F.when(n > 0, F.concat(F.expr(f"substring({c}, 1, length({c}) - length(comment))"), F.lit("##\n"))).otherwise(F.col(c))
    indent = F.regexp_extract("text", r"^[ \t]*", 0)
    # behind the string's opening and closing on one line
    behind = F.regexp_replace(without("text"), rf"(?s)^[ \t]*(?i:[rub]|rb|br)?(?:{CLOSED})", "")
    shown = (
        F.when(F.col("_doc") & F.col("opens"), F.concat(indent, F.lit("#--")))
        .when(F.col("_doc"), F.concat(indent, F.lit("#--"), behind))
        .when(F.col("_of_doc") & F.col("opens"), "")
        .when(F.col("_of_doc"), without("own"))
        .when(F.endswith("code", F.lit("\\")) & ~F.col("opens"), F.regexp_replace("text", r"\s*\\$", ""))
        .otherwise(without("text"))
    )
    joined = (F.col("_of_doc") & F.col("opens")) | (F.endswith("code", F.lit("\\")) & ~F.col("opens"))
    last = F.col("line_no") == F.max("line_no").over(Window.partitionBy(*key))
    feed = F.when(joined | last, "").otherwise("\n")
    x = x.select(*key, "line_no", F.concat(shown, feed).alias("text"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "text"))), lambda r: r["text"]), "")
    return x.groupBy(*key).agg(whole.alias("code"))
