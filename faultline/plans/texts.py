"""Text, diff and test-log operators bound to the driver tables.

The tables hold no diffs, info files or test logs, so each query first
builds such text **per row** from table columns (one part → one diff, one
event → one log record), then runs the operator on it.  Nothing is
concatenated across rows, so no group grows with the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.functions import text as T
from faultline.operators import logs, patches, source
from faultline.sources.tables import read_table

NL = "\n"


# ---------------------------------------------------------------- builders
def _fn(c: Column) -> Column:
    return F.regexp_replace(c, " ", "_")


def part_info(spark: SparkSession, sf: str) -> DataFrame:
    """An info file per part: ``key="value"`` lines, one value holding a
    second ``=``, and a repeated key (the later one wins)."""
    p = read_table(spark, sf, "part", "p_partkey", "p_name", "p_brand", "p_type", "p_size")
    info = F.concat(
        F.lit('name="'), F.col("p_name"), F.lit('"\n'),
        F.lit('brand = "'), F.col("p_brand"), F.lit('"\n'),
        F.lit('type="'), F.col("p_type"), F.lit("="), F.col("p_size").cast("string"), F.lit('"\n'),
        F.lit("size="), F.col("p_size").cast("string"), F.lit("\n"),
        F.lit('name="'), F.upper(F.col("p_name")), F.lit('"\n'),
    )
    return p.select("p_partkey", info.alias("info"))


def part_patches(spark: SparkSession, sf: str) -> DataFrame:
    """A patch per part: a two-file unified diff, or (for SMALL parts) a JSON
    array of the changed paths."""
    p = read_table(spark, sf, "part", "p_partkey", "p_name", "p_brand", "p_type", "p_size")
    fn = _fn(F.col("p_name"))
    path = F.concat(F.lit("pkg/"), F.lower(F.regexp_replace("p_brand", "#", "_")), F.lit("/"), fn, F.lit(".py"))
    tpath = F.concat(F.lit("tests/test_"), fn, F.lit(".py"))
    size = F.col("p_size").cast("string")
    size1 = (F.col("p_size") + 1).cast("string")
    diff = F.concat_ws(
        NL,
        F.concat(F.lit("diff --git a/"), path, F.lit(" b/"), path),
        F.lit("index 0000000..1111111 100644"),
        F.concat(F.lit("--- a/"), path),
        F.concat(F.lit("+++ b/"), path),
        F.concat(F.lit("@@ -1,4 +1,4 @@ def "), fn, F.lit("(x):")),
        F.concat(F.lit('     """'), F.col("p_type"), F.lit('"""')),
        F.concat(F.lit("-    return x * "), size),
        F.concat(F.lit("+    return x * "), size1),
        F.lit("     # unchanged"),
        F.concat(F.lit("diff --git a/"), tpath, F.lit(" b/"), tpath),
        F.concat(F.lit("--- a/"), tpath),
        F.concat(F.lit("+++ b/"), tpath),
        F.concat(F.lit("@@ -10,3 +10,3 @@ class Test"), F.initcap(F.col("p_type")), F.lit(":")),
        F.concat(F.lit("-    assert "), fn, F.lit("(1) == "), size),
        F.lit("---- not a header"),
        F.concat(F.lit("+    assert "), fn, F.lit("(1) == "), size1),
        F.concat(F.lit("@@ -20,2 +20,2 @@ def test_"), fn, F.lit("_again():")),
        F.concat(F.lit("-    check("), size, F.lit(")")),
    )
    as_json = F.concat(F.lit('["'), path, F.lit('", "'), tpath, F.lit('"]'))
    return p.select("p_partkey", F.when(F.col("p_type") == "SMALL", as_json).otherwise(diff).alias("diff"))


def event_logs(spark: SparkSession, sf: str) -> DataFrame:
    """A test-run record per event: unittest lines naming failing tests."""
    e = read_table(spark, sf, "events", "event_id", "user_id", "event_type", "value")
    raw = F.concat(
        F.when(F.col("event_type") == "error", F.lit("FAIL")).otherwise(F.lit("ok")),
        F.lit(": test_"), F.col("event_type"), F.lit("_"), F.col("user_id").cast("string"), F.lit(" (suite.Case)\n"),
        F.when(
            F.col("value") > 50,
            F.concat(F.lit("ERROR: test_value_"), F.floor(F.col("value")).cast("bigint").cast("string")),
        ).otherwise(F.lit("passed")),
    )
    return e.select("event_id", raw.alias("raw"))


def event_traces(spark: SparkSession, sf: str) -> DataFrame:
    """A raw test output per event: pytest form for errors, unittest form for
    clicks, no failure otherwise."""
    e = read_table(spark, sf, "events", "event_id", "user_id", "event_type", "value", "props")
    uid = F.col("user_id").cast("string")
    pytest_txt = F.concat(
        F.lit("platform linux -- Python 3\ncollected 2 items\n\n"),
        F.lit("=================================== FAILURES ===================================\n"),
        F.lit("_________________________________ test_value _________________________________\n\n"),
        F.lit("    def test_value():\n>       assert check("), uid, F.lit(")\nE       AssertionError: "),
        F.col("props"),
        F.lit("\n\n---------------------------- Captured stdout call -----------------------------\n"),
        F.lit("value="), F.col("value").cast("string"),
        F.lit("\n=========================== short test summary info ============================\n"),
        F.lit("FAILED test_x.py::test_value"),
    )
    unittest_txt = F.concat(
        F.lit("..F\n======================================================================\n"),
        F.lit("FAIL: test_click (suite.T"), uid, F.lit(")\n"),
        F.lit("----------------------------------------------------------------------\n"),
        F.lit("Traceback (most recent call last):\n  File \"suite.py\", line "), uid,
        F.lit(", in test_click\nAssertionError: "), F.col("value").cast("string"),
        F.lit("\n\n----------------------------------------------------------------------\n"),
        F.lit("Ran 3 tests in 0.001s\n\nFAILED (failures=1)"),
    )
    raw = (
        F.when(F.col("event_type") == "error", pytest_txt)
        .when(F.col("event_type") == "click", unittest_txt)
        .otherwise(F.lit("3 passed"))
    )
    return e.select("event_id", raw.alias("raw"))


def outcome_log(spark: SparkSession, sf: str) -> DataFrame:
    """Log lines ``container | project,bug,phase,status`` per event."""
    e = read_table(spark, sf, "events", "event_id", "user_id", "event_type")
    line = F.concat(
        F.lit("ctr-"), F.col("user_id").cast("string"), F.lit(" | proj"), F.col("user_id").cast("string"),
        F.lit(","), F.col("event_id").cast("string"), F.lit(","), F.col("event_type"), F.lit(","),
        F.when(F.col("event_type") == "error", F.lit("fail")).otherwise(F.lit("pass")),
    )
    return e.select(line.alias("value"))


# ---------------------------------------------------------------- queries
def kv_info(spark, sf):
    x = part_info(spark, sf).select("p_partkey", F.explode(T.parse_kv(F.col("info"))).alias("kv"))
    x = x.select("p_partkey", "kv.pos", "kv.key", "kv.value")
    return x.groupBy("p_partkey", "key").agg(F.max_by("value", "pos").alias("value"))


def merge_newlines(spark, sf):
    d = read_table(spark, sf, "documents", "doc_id", "text")
    spaced = F.regexp_replace(F.col("text"), r"\. ", ".\n\n\n")
    return d.select(
        "doc_id",
        F.length(spaced).cast("bigint").alias("n_before"),
        F.length(T.merge_newlines(spaced)).cast("bigint").alias("n_after"),
        F.md5(T.merge_newlines(spaced)).alias("merged_md5"),
    )


def decoration_filter(spark, sf):
    d = read_table(spark, sf, "documents", "doc_id", "source", "lang", "text")
    raw = F.concat(
        F.lit("_____ test_"), F.col("source"), F.lit(" _____\n"), F.col("text"),
        F.lit("\n----\n-----\n"), F.col("lang"), F.lit(" ~~~~~ end\n=====  done ====="),
    )
    out = T.remove_decorations(raw)
    return d.select("doc_id", T.n_parts(out).alias("n_lines"), F.md5(out).alias("kept_md5"))


def failing_tests(spark, sf):
    names = logs.failing_test_names(event_logs(spark, sf), ["event_id"])
    return names.groupBy("test").agg(F.count(F.lit(1)).cast("bigint").alias("n"))


def traceback_extract(spark, sf):
    t = logs.tracebacks(event_traces(spark, sf), ["event_id"])
    return t.select("event_id", F.md5("trace").alias("trace_md5"), F.length("trace").cast("bigint").alias("n_chars"))


def pass_ratio(spark, sf):
    o = logs.parse_outcome_lines(outcome_log(spark, sf))
    return logs.pass_ratio(o, ["phase"])


def pass_success_cumulative(spark, sf):
    e = read_table(spark, sf, "events", "user_id", "ts", "event_type")
    o = e.select(
        "user_id",
        F.to_date("ts").alias("day"),
        (F.floor(F.hour("ts") / 8) + 1).cast("int").alias("pass_no"),
        F.when(F.col("event_type") == "error", F.lit("fail")).otherwise(F.lit("pass")).alias("status"),
    )
    return logs.cumulative_success(o, ["user_id", "day"])


def diff_paths(spark, sf):
    return patches.changed_paths(part_patches(spark, sf), ["p_partkey"]).withColumn("pos", F.col("pos").cast("int"))


def diff_hunk_functions(spark, sf):
    h = patches.hunk_functions(part_patches(spark, sf), ["p_partkey"])
    return h.select("p_partkey", F.array_join("functions", ",").alias("functions"))


def diff_changed_lines(spark, sf):
    """SCA-03 in both directions: removed lines ('buggy') and added ones ('fixed')."""
    pp = part_patches(spark, sf)
    old = patches.changed_lines(pp, ["p_partkey"]).withColumn("mode", F.lit("buggy"))
    c = old.unionByName(patches.changed_lines(pp, ["p_partkey"], fixed=True).withColumn("mode", F.lit("fixed")))
    return c.select("p_partkey", F.col("pos").cast("int").alias("pos"), "file", "code", "mode")


def part_changes(spark: SparkSession, sf: str):
    """(patches, old files, new files) of parts, in five kinds by size: lines only
    added; module-level lines removed; a function's line replaced; a removed line
    that the old file doesn't have; an old file that is missing."""
    p = read_table(spark, sf, "part", "p_partkey", "p_name", "p_size")
    fn, size, kind = _fn(F.col("p_name")), F.col("p_size").cast("string"), F.col("p_size") % 5
    path = F.concat(F.lit("pkg/"), fn, F.lit(".py"))
    top, head, ret = F.concat(F.lit("X = "), size), F.concat(F.lit("def "), fn, F.lit("(x):")), F.lit("    return y")
    times, plus = F.concat(F.lit("    y = x * "), size), F.concat(F.lit("    y = x + "), size)
    extra = F.concat(F.lit("    return z - "), size)
    join = lambda *x: F.concat_ws(NL, *[F.lit(v) if isinstance(v, str) else v for v in x])
    old = join(top, head, times, ret)
    new = F.when(kind == 0, join(top, head, times, "    y += 1", ret)).when(kind == 1, join("X = -1", head, times, ret, "def extra(z):", extra)).otherwise(join(top, head, plus, ret))
    sign = lambda c, x: F.concat(F.lit(c), x)
    hunk = (
        F.when(kind == 0, F.lit("+    y += 1"))
        .when(kind == 1, join(sign("-", top), "+X = -1", "+def extra(z):", sign("+", extra)))
        .when(kind == 3, join(sign("-", F.concat(F.lit("    y = x / "), size)), sign("+", plus)))
        .otherwise(join(sign("-", times), sign("+", plus)))
    )
    diff = join(F.concat(F.lit("diff --git a/"), path, F.lit(" b/"), path), sign("--- a/", path), sign("+++ b/", path), "@@ -1,4 +1,4 @@", hunk)
    files = lambda content, rows: rows.select("p_partkey", path.alias("file"), content.alias("content"))
    return p.select("p_partkey", diff.alias("diff")), files(old, p.where(kind != 4)), files(new, p)


def changed_functions(spark, sf):
    """SCA-04: the functions that a patch changes, from its added lines where the removed ones lead to none."""
    at = ["p_partkey", "file"]
    diff, old, new = part_changes(spark, sf)
    found = patches.changed_functions(diff, old, source.facts(old, at)[1], new, source.facts(new, at)[1], ["p_partkey"])
    return found.withColumn("pos", F.col("pos").cast("int"))


def trace_lengths(spark, sf):
    """AGG-12: lengths of the raw traces of each kind of event."""
    e = read_table(spark, sf, "events", "event_id", "event_type")
    return logs.trace_lengths(event_traces(spark, sf).join(e, "event_id"), ["event_type"])


def changed_name_map(spark, sf):
    """AGG-16: per part, test-function name → file of its last removed line."""
    c = patches.changed_lines(part_patches(spark, sf), ["p_partkey"])
    named = c.select("p_partkey", "pos", "file", F.regexp_extract("code", r"(\w+)\(", 1).alias("name"))
    named = named.where(F.col("name") != "")
    return patches.last_wins_map(named, ["p_partkey"], "name", "file", "pos")


QUERIES = {
    "kv_info": kv_info,
    "merge_newlines": merge_newlines,
    "decoration_filter": decoration_filter,
    "failing_tests": failing_tests,
    "traceback_extract": traceback_extract,
    "pass_ratio": pass_ratio,
    "pass_success_cumulative": pass_success_cumulative,
    "diff_paths": diff_paths,
    "diff_hunk_functions": diff_hunk_functions,
    "diff_changed_lines": diff_changed_lines,
    "changed_functions": changed_functions,
    "trace_lengths": trace_lengths,
    "changed_name_map": changed_name_map,
}

# ---------------------------------------------------------------- oracles
_STRIP = "regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"
_FN = "replace(p_name, ' ', '_')"
_PATH = f"'pkg/' || lower(replace(p_brand, '#', '_')) || '/' || {_FN} || '.py'"
_TPATH = f"'tests/test_' || {_FN} || '.py'"
_DIFF = f"""CASE WHEN p_type = 'SMALL' THEN '["' || {_PATH} || '", "' || {_TPATH} || '"]' ELSE concat_ws(chr(10),
  'diff --git a/' || {_PATH} || ' b/' || {_PATH}, 'index 0000000..1111111 100644',
  '--- a/' || {_PATH}, '+++ b/' || {_PATH}, '@@ -1,4 +1,4 @@ def ' || {_FN} || '(x):',
  '     \"\"\"' || p_type || '\"\"\"', '-    return x * ' || p_size, '+    return x * ' || (p_size + 1),
  '     # unchanged', 'diff --git a/' || {_TPATH} || ' b/' || {_TPATH}, '--- a/' || {_TPATH}, '+++ b/' || {_TPATH},
  '@@ -10,3 +10,3 @@ class Test' || upper(p_type[1]) || lower(p_type[2:]) || ':',
  '-    assert ' || {_FN} || '(1) == ' || p_size, '---- not a header', '+    assert ' || {_FN} || '(1) == ' || (p_size + 1),
  '@@ -20,2 +20,2 @@ def test_' || {_FN} || '_again():', '-    check(' || p_size || ')') END"""
_LINES = f"""l AS (SELECT p_partkey, unnest(string_split(d, chr(10))) AS line,
                 CAST(generate_subscripts(string_split(d, chr(10)), 1) - 1 AS INTEGER) AS pos
          FROM (SELECT p_partkey, {_DIFF} AS d FROM part) WHERE d NOT LIKE '[%'),
s AS (SELECT *, line LIKE 'diff --git%' AS is_d,
             line NOT LIKE 'diff --git%' AND line LIKE '--- a/%' AS is_f,
             line NOT LIKE 'diff --git%' AND line NOT LIKE '--- a/%' AND line LIKE '@@%' AS is_h FROM l),
w AS (SELECT *,
        last_value(CASE WHEN is_d THEN '' WHEN is_f THEN {_STRIP.format(x="line[7:]")} END IGNORE NULLS)
          OVER (PARTITION BY p_partkey ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS file,
        last_value(CASE WHEN is_d THEN 0 WHEN is_h THEN 1 END IGNORE NULLS)
          OVER (PARTITION BY p_partkey ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS in_h
      FROM s),
old AS (SELECT p_partkey, pos, file, line[2:] AS code, 'buggy' AS mode FROM w
        WHERE NOT is_d AND NOT is_f AND NOT is_h AND in_h = 1 AND line LIKE '-%' AND line NOT LIKE '---%'
          AND coalesce(file, '') <> ''),
new AS (SELECT p_partkey, pos, file, line[2:] AS code, 'fixed' AS mode FROM w
        WHERE NOT is_d AND NOT is_f AND NOT is_h AND in_h = 1 AND line LIKE '+%' AND coalesce(file, '') <> '')"""

_DECOR = "'^(?:[-_=~\\s]{5,}|[-_=~\\s]{5,}.*?[-_=~\\s]{5,})$'"

# raw test output of an event, apart from the Spark code
_TRACE = """CASE event_type WHEN 'error' THEN concat_ws(chr(10), 'platform linux -- Python 3', 'collected 2 items', '',
  repeat('=', 35) || ' FAILURES ' || repeat('=', 35), repeat('_', 33) || ' test_value ' || repeat('_', 33), '', '    def test_value():',
  '>       assert check(' || user_id || ')', 'E       AssertionError: ' || props, '', repeat('-', 28) || ' Captured stdout call ' || repeat('-', 29),
  'value=' || value, repeat('=', 27) || ' short test summary info ' || repeat('=', 28), 'FAILED test_x.py::test_value')
 WHEN 'click' THEN concat_ws(chr(10), '..F', repeat('=', 70), 'FAIL: test_click (suite.T' || user_id || ')', repeat('-', 70),
  'Traceback (most recent call last):', '  File "suite.py", line ' || user_id || ', in test_click', 'AssertionError: ' || value, '', repeat('-', 70),
  'Ran 3 tests in 0.001s', '', 'FAILED (failures=1)') ELSE '3 passed' END"""

ORACLE = {
    "kv_info": f"""
WITH s AS (SELECT p_partkey, trim('name=\"' || p_name || '\"' || chr(10) || 'brand = \"' || p_brand || '\"' || chr(10)
            || 'type=\"' || p_type || '=' || p_size || '\"' || chr(10) || 'size=' || p_size || chr(10)
            || 'name=\"' || upper(p_name) || '\"' || chr(10), chr(10)) AS info FROM part),
l AS (SELECT p_partkey, unnest(string_split(info, chr(10))) AS line,
             generate_subscripts(string_split(info, chr(10)), 1) AS pos FROM s),
kv AS (SELECT p_partkey, pos, trim(split_part(trim(line), '=', 1)) AS key,
              replace(split_part(trim(line), '=', 2), '\"', '') AS value FROM l)
SELECT p_partkey, key, arg_max(value, pos) AS value FROM kv GROUP BY p_partkey, key""",
    "merge_newlines": """
WITH s AS (SELECT doc_id, replace(text, '. ', '.' || chr(10) || chr(10) || chr(10)) AS t FROM documents)
SELECT doc_id, CAST(length(t) AS BIGINT) AS n_before,
       CAST(length(regexp_replace(t, '\\n+', chr(10), 'g')) AS BIGINT) AS n_after,
       md5(regexp_replace(t, '\\n+', chr(10), 'g')) AS merged_md5 FROM s""",
    "decoration_filter": f"""
WITH s AS (SELECT doc_id, '_____ test_' || source || ' _____' || chr(10) || text || chr(10) || '----' || chr(10)
                  || '-----' || chr(10) || lang || ' ~~~~~ end' || chr(10) || '=====  done =====' AS raw FROM documents),
k AS (SELECT doc_id, array_to_string(list_filter(string_split(raw, chr(10)),
        lambda ln: NOT regexp_full_match({_STRIP.format(x="ln")}, {_DECOR})), chr(10)) AS o FROM s)
SELECT doc_id, CAST(len(string_split(o, chr(10))) AS BIGINT) AS n_lines, md5(o) AS kept_md5 FROM k""",
    "failing_tests": """
WITH s AS (SELECT CASE WHEN event_type = 'error' THEN 'FAIL' ELSE 'ok' END || ': test_' || event_type || '_' || user_id
                  || ' (suite.Case)' || chr(10)
                  || CASE WHEN value > 50 THEN 'ERROR: test_value_' || CAST(floor(value) AS BIGINT) ELSE 'passed' END AS raw
           FROM events),
t AS (SELECT unnest(regexp_extract_all(raw, '(?:ERROR|FAIL): (\\w+)', 1)) AS test FROM s)
SELECT test, CAST(count(*) AS BIGINT) AS n FROM t GROUP BY test""",
    "pass_ratio": """
WITH l AS (SELECT 'ctr-' || user_id || ' | proj' || user_id || ',' || event_id || ',' || event_type || ','
                  || CASE WHEN event_type = 'error' THEN 'fail' ELSE 'pass' END AS value FROM events),
f AS (SELECT string_split(trim(string_split(value, '|')[-1]), ',') AS p FROM l),
o AS (SELECT trim(p[3]) AS phase, trim(p[4]) AS status FROM f WHERE len(p) = 4)
SELECT phase, CAST(count(*) FILTER (WHERE status = 'pass') AS BIGINT) AS n_pass,
       CAST(count(*) FILTER (WHERE status = 'fail') AS BIGINT) AS n_fail,
       round(count(*) FILTER (WHERE status = 'pass') / nullif(count(*) FILTER (WHERE status IN ('pass', 'fail')), 0), 6) AS ratio
FROM o GROUP BY phase""",
    "pass_success_cumulative": """
WITH o AS (SELECT user_id, CAST(ts AS DATE) AS day, CAST(floor(hour(ts) / 8) + 1 AS INTEGER) AS pass_no,
                  CASE WHEN event_type = 'error' THEN 'fail' ELSE 'pass' END AS status FROM events),
b AS (SELECT user_id, day, min(CASE WHEN status = 'pass' THEN pass_no END) AS first FROM o GROUP BY user_id, day),
x AS (SELECT b.*, p AS pass FROM b, (SELECT unnest(range(1, 4)) AS p))
SELECT CAST(pass AS INTEGER) AS pass, CAST(count(*) FILTER (WHERE first <= pass) AS BIGINT) AS solved,
       CAST(count(*) AS BIGINT) AS bugs, round(count(*) FILTER (WHERE first <= pass) / count(*), 6) AS rate
FROM x GROUP BY pass""",
    "diff_paths": f"""
WITH s AS (SELECT p_partkey, {_DIFF} AS d FROM part),
p AS (SELECT p_partkey, CASE WHEN regexp_matches(d, '^\\s*\\[') THEN from_json(d, '["VARCHAR"]')
        ELSE list_transform(list_filter(string_split(d, chr(10)),
               lambda ln: starts_with(ln, 'diff --git') AND regexp_matches(ln, '^diff --git a/.* b/(.*)$')),
             lambda ln: regexp_extract(ln, '^diff --git a/.* b/(.*)$', 1)) END AS paths FROM s)
SELECT p_partkey, CAST(generate_subscripts(paths, 1) - 1 AS INTEGER) AS pos, unnest(paths) AS path FROM p""",
    "diff_hunk_functions": f"""
SELECT p_partkey, array_to_string(list_sort(list_distinct(
         regexp_extract_all({_DIFF}, '(?m)^@@.*\\b(?:def)\\s+(\\w+)\\s*\\(', 1))), ',') AS functions FROM part""",
    "diff_changed_lines": f"WITH {_LINES} SELECT * FROM old UNION ALL SELECT * FROM new",
    "changed_functions": f"""
WITH m AS (SELECT p_partkey, p_size % 5 AS k, 'pkg/' || {_FN} || '.py' AS file, {_FN} AS fn FROM part)
SELECT p_partkey, pos, file, line_no, status, enclosing, CASE WHEN enclosing IS NULL THEN NULL ELSE 'function' END AS enclosing_kind, mode FROM (
  SELECT p_partkey, 4 AS pos, file, 4 AS line_no, 'found' AS status, fn AS enclosing, 'fixed' AS mode FROM m WHERE k = 0
  UNION ALL SELECT p_partkey, 4, file, 1, 'found', NULL, 'buggy' FROM m WHERE k = 1
  UNION ALL SELECT p_partkey, 5, file, 1, 'found', NULL, 'fixed' FROM m WHERE k = 1
  UNION ALL SELECT p_partkey, 6, file, 5, 'found', 'extra', 'fixed' FROM m WHERE k = 1
  UNION ALL SELECT p_partkey, 7, file, 6, 'found', 'extra', 'fixed' FROM m WHERE k = 1
  UNION ALL SELECT p_partkey, 4, file, 3, 'found', fn, 'buggy' FROM m WHERE k = 2
  UNION ALL SELECT p_partkey, 4, file, NULL, CASE k WHEN 3 THEN 'not_found' ELSE 'no_file' END, NULL, 'buggy' FROM m WHERE k IN (3, 4)
  UNION ALL SELECT p_partkey, 5, file, 3, 'found', fn, 'fixed' FROM m WHERE k IN (3, 4))""",
    "trace_lengths": f"""
WITH t AS (SELECT event_type, CAST(len(string_split({_TRACE}, chr(10))) AS BIGINT) AS n FROM events)
SELECT event_type, min(n) AS min_lines, max(n) AS max_lines, round(avg(n), 6) AS avg_lines, CAST(count(n) AS BIGINT) AS n_traces FROM t GROUP BY event_type""",
    "traceback_extract": f"""
WITH t AS (SELECT event_id, string_split({_TRACE}, chr(10)) AS ls FROM events WHERE event_type IN ('error', 'click')),
l AS (SELECT event_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS n FROM t),
b AS (SELECT event_id, min(n) FILTER (WHERE regexp_matches(line, '=+ (FAILURES|ERRORS) =+$')) AS banner,
             min(n) FILTER (WHERE regexp_matches(line, '^(FAIL|ERROR): ')) AS fail FROM l GROUP BY event_id),
e AS (SELECT b.event_id, banner, fail,
             coalesce(min(n) FILTER (WHERE n > banner AND regexp_matches(line, '^[-=]{{10,}} (Captured|warnings summary|short test summary info|ERRORS|FAILURES|slowest)[^\n]* [-=]{{10,}}')), 1000000) AS stop,
             coalesce(min(n) FILTER (WHERE n > fail + 1 AND regexp_matches(line, '^-{{10,}}')), 1000000) AS dash
      FROM b JOIN l ON l.event_id = b.event_id GROUP BY b.event_id, banner, fail),
s AS (SELECT e.event_id, banner IS NOT NULL AS py, {_STRIP.format(x="string_agg(line, chr(10) ORDER BY n)")} AS body
      FROM e JOIN l ON l.event_id = e.event_id AND CASE WHEN banner IS NOT NULL THEN n > banner AND n < stop ELSE n >= fail AND n < dash END
      GROUP BY e.event_id, banner),
r AS (SELECT event_id, CASE WHEN py THEN array_to_string([x for x in string_split(body, chr(10)) if NOT regexp_full_match({_STRIP.format(x="x")}, {_DECOR})], chr(10)) ELSE 'FAIL: ' || body END AS trace FROM s)
SELECT event_id, md5(trace) AS trace_md5, CAST(length(trace) AS BIGINT) AS n_chars FROM r WHERE trace <> ''""",
    "changed_name_map": f"""WITH {_LINES},
n AS (SELECT p_partkey, pos, file, regexp_extract(code, '(\\w+)\\(', 1) AS name FROM old)
SELECT p_partkey, name, arg_max(file, pos) AS file FROM n WHERE name <> '' GROUP BY p_partkey, name""",
}
