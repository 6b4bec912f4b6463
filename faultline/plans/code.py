"""Code facts where a reading line by line goes wrong, bound to the driver tables.

Every part is a module in which quotes, comment signs, semicolons and
backslashes stand in each other's way; what varies with the part moves its lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.operators import source
from faultline.plans.truth import KEY
from faultline.sources.tables import read_table

NL = "\n"
# Lines of the module; {fn} and {size} are the part's, {i} counts.
HEAD = ['"""module', "of {fn}", '""" ; import os; import sys as s']
REPEATED = "Q{i} = \"''' # \" + '\"\"\"' # q"
BODY = [
    "def {fn}(x):", "    'one \\", "    # of two'; y = 1 # end", "    z = '''# {size}", "def no(): # no", "''' + \"#\" # yes",
    "    return g('\"') + \\", "        h(z, {size})",
]
TAIL = ["if s: t = 1; u = 2", "else:", "    class K: '#'; v = k('#') # k"]
# The same after masking.
MASKED_HEAD = "#-- ; import os; import sys as s\n"
MASKED_REPEATED = "Q{i} = \"''' # \" + '\"\"\"' ##\n\n"
MASKED_BODY = "def {fn}(x):\n    #--; y = 1 ##\n\n    z = '''# {size}\ndef no(): # no\n''' + \"#\" ##\n\n    return g('\"') +        h(z, {size})"
MASKED_TAIL = "\nif s: t = 1; u = 2\nelse:\n    class K: '#'; v = k('#') ##\n"


def odd_sources(spark: SparkSession, sf: str) -> DataFrame:
    p = read_table(spark, sf, "part", "p_partkey", "p_name", "p_size")
    fn, size = F.regexp_replace("p_name", " ", "_"), F.col("p_size").cast("string")

    def line(template: str, i=None):
        out = F.replace(F.replace(F.lit(template), F.lit("{fn}"), fn), F.lit("{size}"), size)
        return out if i is None else F.replace(out, F.lit("{i}"), i.cast("string"))

    numbers = F.expr("if(p_size % 3 = 0, array(), sequence(1, p_size % 3))")
    some = F.when(F.col("p_size") % 2 == 1, F.array(*map(line, TAIL))).otherwise(F.array().cast("array<string>"))
    text = [F.array(*map(line, HEAD)), F.transform(numbers, lambda i: line(REPEATED, i)), F.array(*map(line, BODY)), some]
    return p.select("p_partkey", F.array_join(F.flatten(F.array(*text)), NL).alias("content"))


def masked_source(spark, sf):
    """UDTF-11: comments and docstrings of the modules masked."""
    m = source.masked(source.lines(odd_sources(spark, sf), KEY), KEY)
    return m.select("p_partkey", F.length("code").cast("bigint").alias("n_chars"), F.md5("code").alias("code_md5"))


def odd_facts(spark, sf):
    """UDTF-05..08: what the modules define, call and import, one row each."""
    ln, found = source.facts(odd_sources(spark, sf), KEY)

    def rows(df: DataFrame, what: str, name: str, detail):
        return df.select("p_partkey", F.lit(what).alias("what"), F.col(name).alias("name"), detail.alias("detail"))

    return (
        rows(found, "span", "name", F.concat_ws("-", "start_line", "end_line"))
        .unionByName(rows(source.calls(ln, found, KEY), "call", "caller", F.col("callee")))
        .unionByName(rows(source.imports(source.by_file(ln, KEY), KEY), "import", "alias", F.col("target")))
    )


QUERIES = {"masked_source": masked_source, "odd_facts": odd_facts}


def _sql(text: str) -> str:
    """A template as a SQL expression over ``fn``, ``p_size`` and ``i``."""
    quoted = "'" + text.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"
    return quoted.replace("{fn}", "' || fn || '").replace("{size}", "' || p_size || '").replace("{i}", "' || i || '")


_M = "m AS (SELECT p_partkey, p_size, p_size % 3 AS o, p_size % 2 = 1 AS odd, replace(p_name, ' ', '_') AS fn FROM part)"
ORACLE = {
    "masked_source": f"""
WITH {_M}, t AS (
  SELECT p_partkey, {_sql(MASKED_HEAD)} || coalesce(array_to_string([{_sql(MASKED_REPEATED)} FOR i IN range(1, o + 1)], ''), '') || {_sql(MASKED_BODY)}
         || CASE WHEN odd THEN {_sql(MASKED_TAIL)} ELSE '' END AS code FROM m)
SELECT p_partkey, CAST(length(code) AS BIGINT) AS n_chars, md5(code) AS code_md5 FROM t""",
    "odd_facts": f"""
WITH {_M}
SELECT p_partkey, 'span' AS what, fn AS name, (4 + o) || '-' || (11 + o) AS detail FROM m
UNION ALL SELECT p_partkey, 'span', 'K', (14 + o) || '-' || (14 + o) FROM m WHERE odd
UNION ALL SELECT p_partkey, 'call', fn, unnest(['g', 'h']) FROM m
UNION ALL SELECT p_partkey, 'import', unnest(['os', 's']), unnest(['os', 'sys']) FROM m""",
}
