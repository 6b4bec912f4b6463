"""Ground truth and code facts bound to the driver tables.

Documents as files: a *changed line* is a document line that also occurs in
another document or in a benchmark passage (copied text); it is located by
its first occurrence in its own document (JON-05), mapped to the enclosing
span (JON-06) of a nested block layout derived from the line count, and
the lines outside every span form the root remainder (JON-07/FLT-06).

Parts as Python modules: each part row becomes a small module (imports,
nested functions, a decorated class with methods and an async method,
comments, a docstring) whose length and members vary with the part; code facts
come from its lines (UDTF-01/05..09/12).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.functions import text as T
from faultline.operators import source, spans
from faultline.session import cut
from faultline.sources.tables import read_table

NL = "\n"
BLOCK = 10


def _doc_lines(spark, sf) -> DataFrame:
    d = read_table(spark, sf, "documents", "doc_id", "text")
    return d.select("doc_id", F.posexplode(F.split("text", NL, -1)).alias("pos", "line")).select(
        "doc_id", (F.col("pos") + 1).cast("int").alias("line_no"), "line"
    )


def changed_lines(spark, sf) -> DataFrame:
    """Distinct (doc_id, line) where the line is copied: it occurs in another
    document, or it is a line of a benchmark passage."""
    ln = _doc_lines(spark, sf).where(F.col("line") != "")
    shared = ln.groupBy("line").agg(F.count_distinct("doc_id").alias("_n")).where(F.col("_n") > 1).select("line")
    bench = read_table(spark, sf, "benchmark", "text").select(F.explode(F.split("text", NL, -1)).alias("line"))
    copied = shared.unionByName(bench).distinct()
    return ln.join(copied, "line", "left_semi").select("doc_id", "line").distinct()


def doc_spans(spark, sf) -> DataFrame:
    """Per document and per block of 10 lines: function f{i} (lines 1-6),
    nested f{i}_inner (2-4), class C{i} (1-9); line 10 is outside all."""
    d = read_table(spark, sf, "documents", "doc_id", "text")
    n = F.size(F.split("text", NL, -1))
    b = d.select("doc_id", F.explode(F.sequence(F.lit(0), F.ceil(n / BLOCK).cast("int") - 1)).alias("i"))
    base = F.col("i") * BLOCK
    rows = F.array(
        F.struct(F.concat(F.lit("f"), F.col("i").cast("string")).alias("name"), F.lit("function").alias("kind"),
                 (base + 1).alias("start_line"), (base + 6).alias("end_line")),
        F.struct(F.concat(F.lit("f"), F.col("i").cast("string"), F.lit("_inner")).alias("name"),
                 F.lit("function").alias("kind"), (base + 2).alias("start_line"), (base + 4).alias("end_line")),
        F.struct(F.concat(F.lit("C"), F.col("i").cast("string")).alias("name"), F.lit("class").alias("kind"),
                 (base + 1).alias("start_line"), (base + 9).alias("end_line")),
    )
    s = b.select("doc_id", F.explode(rows).alias("s")).select("doc_id", "s.*")
    return s.select("doc_id", "name", "kind", F.col("start_line").cast("int"), F.col("end_line").cast("int"))


def locate_passage(spark, sf):
    docs = read_table(spark, sf, "documents", "doc_id", "text")
    loc = spans.locate(cut(changed_lines(spark, sf), "changed"), docs, ["doc_id"], line="line", content="text")
    return loc.select("doc_id", F.md5("line").alias("line_md5"), "line_no", "status")


def enclosing_span(spark, sf):
    docs = read_table(spark, sf, "documents", "doc_id", "text")
    loc = cut(spans.locate(cut(changed_lines(spark, sf), "changed"), docs, ["doc_id"], line="line", content="text"), "located")
    enc = spans.enclosing(loc.select("doc_id", "line", "line_no"), doc_spans(spark, sf), ["doc_id"])
    return enc.select("doc_id", F.md5("line").alias("line_md5"), "line_no", "enclosing", "enclosing_kind")


def uncovered_lines(spark, sf):
    sp = doc_spans(spark, sf).withColumn("cover_end", F.col("end_line"))
    root = spans.uncovered_lines(_doc_lines(spark, sf), sp, ["doc_id"])
    per = root.groupBy("doc_id").agg(
        F.count(F.lit(1)).cast("bigint").alias("n_root_lines"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))), lambda x: x["line"]),
                     NL).alias("_root"),
    )
    return per.where(F.col("_root") != "").select("doc_id", "n_root_lines", F.md5("_root").alias("root_md5"))


# ---------------------------------------------------------------- code facts
def part_sources(spark: SparkSession, sf: str) -> DataFrame:
    """One module a part; comments, a method and all line numbers vary with the size."""
    p = read_table(spark, sf, "part", "p_partkey", "p_name", "p_brand", "p_type", "p_size")
    fn = F.regexp_replace("p_name", " ", "_")
    brand = F.lower(F.regexp_replace("p_brand", "#", "_"))
    size = F.col("p_size").cast("string")
    notes = F.transform(F.expr("if(p_size % 4 = 0, array(), sequence(1, p_size % 4))"), lambda i: F.concat(F.lit("# note "), i.cast("string")))
    text = [
        F.array(F.lit("import os"), F.concat(F.lit("from pkg."), brand, F.lit(" import helper as h_"), fn)),
        notes,
        F.array(
            F.lit(""),
            F.concat(F.lit("def "), fn, F.lit("(x):")),
            F.concat(F.lit('    """'), F.col("p_type"), F.lit(' part"""')),
            F.lit("    def inner():"),
            F.concat(F.lit("        return h_"), fn, F.lit("(x) + len(str(x))")),
            F.concat(F.lit("    return inner()  # size "), size),
            F.lit(""),
            F.lit("@decorated"),
            F.concat(F.lit("class Part"), F.col("p_partkey").cast("string"), F.lit(":")),
            F.concat(F.lit("    size = "), size),
            F.lit("    def price(self):"),
            F.concat(F.lit("        return "), fn, F.lit("(self.size) * 2  # price")),
            F.lit("    async def fetch(self):"),
            F.lit("        return os.getcwd()"),
        ),
        F.when(F.col("p_size") % 2 == 1, F.array(F.lit("    def cost(self):"), F.lit("        return js_(self.price())"))).otherwise(F.array().cast("array<string>")),
        F.array(F.lit(""), F.concat(F.lit("print("), fn, F.lit("("), size, F.lit("))"))),
    ]
    return p.select("p_partkey", F.array_join(F.flatten(F.array(*text)), NL).alias("content"))


KEY = ["p_partkey"]


def part_lines(spark, sf) -> DataFrame:
    return source.lines(part_sources(spark, sf), KEY)


def part_facts(spark, sf) -> tuple[DataFrame, DataFrame]:
    return source.facts(part_sources(spark, sf), KEY)


def code_chunks(spark, sf):
    c = source.chunks(*part_facts(spark, sf), KEY)
    return c.select("p_partkey", "seq", "name", "start_line", "end_line", T.n_parts(F.col("code")).alias("n_lines"), F.md5("code").alias("code_md5"))


def code_spans(spark, sf):
    return part_facts(spark, sf)[1].select("p_partkey", "seq", "name", "kind", "start_line", "end_line", "nested")


def called_names(spark, sf):
    return source.calls(*part_facts(spark, sf), KEY)


def import_aliases(spark, sf):
    return source.imports(part_lines(spark, sf), KEY)


def defined_names(spark, sf):
    """AGG-17: distinct defined names per file, sorted and joined."""
    d = source.defined(part_facts(spark, sf)[1], KEY)
    return d.groupBy("p_partkey").agg(F.array_join(F.array_sort(F.collect_set("name")), ",").alias("names"))


def strip_comments(spark, sf):
    s = source.without_comments(part_sources(spark, sf), part_lines(spark, sf), KEY)
    return s.select("p_partkey", F.length("code").cast("bigint").alias("n_chars"), F.md5("code").alias("code_md5"))


QUERIES = {
    "locate_passage": locate_passage,
    "enclosing_span": enclosing_span,
    "uncovered_lines": uncovered_lines,
    "code_chunks": code_chunks,
    "code_spans": code_spans,
    "called_names": called_names,
    "import_aliases": import_aliases,
    "defined_names": defined_names,
    "strip_comments": strip_comments,
}

_CHANGED = """
ln AS (SELECT doc_id, CAST(generate_subscripts(string_split(text, chr(10)), 1) AS INTEGER) AS line_no,
              unnest(string_split(text, chr(10))) AS line FROM documents),
sh AS (SELECT line FROM ln WHERE line <> '' GROUP BY line HAVING count(DISTINCT doc_id) > 1),
bl AS (SELECT unnest(string_split(text, chr(10))) AS line FROM benchmark),
ch AS (SELECT DISTINCT ln.doc_id, ln.line FROM ln WHERE line <> '' AND line IN (SELECT line FROM sh UNION SELECT line FROM bl)),
loc AS (SELECT ch.doc_id, ch.line,
               CAST(length(d.text[1:strpos(d.text, ch.line) - 1]) - length(replace(d.text[1:strpos(d.text, ch.line) - 1], chr(10), '')) + 1 AS INTEGER) AS line_no
        FROM ch JOIN documents d USING (doc_id))"""

_SPANS = f"""
blk AS (SELECT doc_id, unnest(range(0, CAST(ceil(len(string_split(text, chr(10))) / {BLOCK}) AS INTEGER))) AS i FROM documents),
sp AS (SELECT doc_id, 'f' || i AS name, 'function' AS kind, 0 AS r, i * {BLOCK} + 1 AS s, i * {BLOCK} + 6 AS e FROM blk
       UNION ALL SELECT doc_id, 'f' || i || '_inner', 'function', 0, i * {BLOCK} + 2, i * {BLOCK} + 4 FROM blk
       UNION ALL SELECT doc_id, 'C' || i, 'class', 1, i * {BLOCK} + 1, i * {BLOCK} + 9 FROM blk)"""

_FN = "replace(p_name, ' ', '_')"
# the part's module as a list of (line, text), built apart from the Spark code
_MOD = f"""
m AS (SELECT p_partkey, p_size, p_size % 4 AS o, p_size % 2 = 1 AS odd, {_FN} AS fn, list_concat(
  ['import os', 'from pkg.' || lower(replace(p_brand, '#', '_')) || ' import helper as h_' || {_FN}],
  ['# note ' || i FOR i IN range(1, p_size % 4 + 1)],
  ['', 'def ' || {_FN} || '(x):', '    \"\"\"' || p_type || ' part\"\"\"', '    def inner():', '        return h_' || {_FN} || '(x) + len(str(x))',
   '    return inner()  # size ' || p_size, '', '@decorated', 'class Part' || p_partkey || ':', '    size = ' || p_size, '    def price(self):',
   '        return ' || {_FN} || '(self.size) * 2  # price', '    async def fetch(self):', '        return os.getcwd()'],
  CASE WHEN p_size % 2 = 1 THEN ['    def cost(self):', '        return js_(self.price())'] ELSE [] END,
  ['', 'print(' || {_FN} || '(' || p_size || '))']) AS t FROM part),
sp AS (SELECT p_partkey, fn AS name, 'function' AS kind, 4 + o AS f, 4 + o AS s, 8 + o AS e, 8 + o AS c, 0 AS depth FROM m
       UNION ALL SELECT p_partkey, 'inner', 'function', 6 + o, 6 + o, 7 + o, 7 + o, 1 FROM m
       UNION ALL SELECT p_partkey, 'Part' || p_partkey, 'class', 10 + o, 11 + o, CASE WHEN odd THEN 18 ELSE 16 END + o, CASE WHEN odd THEN 17 ELSE 15 END + o, 0 FROM m
       UNION ALL SELECT p_partkey, 'price', 'function', 13 + o, 13 + o, 14 + o, 14 + o, 1 FROM m
       UNION ALL SELECT p_partkey, 'fetch', 'async_function', 15 + o, 15 + o, 16 + o, 16 + o, 1 FROM m
       UNION ALL SELECT p_partkey, 'cost', 'function', 17 + o, 17 + o, 18 + o, 18 + o, 1 FROM m WHERE odd),
ml AS (SELECT p_partkey, CAST(generate_subscripts(t, 1) AS INTEGER) AS n, unnest(t) AS line FROM m)"""

ORACLE = {
    "locate_passage": f"WITH {_CHANGED} SELECT doc_id, md5(line) AS line_md5, line_no, 'found' AS status FROM loc",
    "enclosing_span": f"""WITH {_CHANGED}, {_SPANS},
hit AS (SELECT loc.doc_id, loc.line, loc.line_no, sp.name, sp.kind,
               row_number() OVER (PARTITION BY loc.doc_id, loc.line ORDER BY sp.r, sp.s, sp.e DESC, sp.name) AS rk
        FROM loc JOIN sp ON sp.doc_id = loc.doc_id AND loc.line_no BETWEEN sp.s AND sp.e)
SELECT loc.doc_id, md5(loc.line) AS line_md5, loc.line_no, hit.name AS enclosing, hit.kind AS enclosing_kind
FROM loc LEFT JOIN hit ON hit.doc_id = loc.doc_id AND hit.line = loc.line AND hit.rk = 1""",
    "uncovered_lines": f"""WITH ln AS (SELECT doc_id, CAST(generate_subscripts(string_split(text, chr(10)), 1) AS INTEGER) AS line_no,
              unnest(string_split(text, chr(10))) AS line FROM documents), {_SPANS},
r AS (SELECT * FROM ln WHERE NOT EXISTS (SELECT 1 FROM sp WHERE sp.doc_id = ln.doc_id AND ln.line_no BETWEEN sp.s AND sp.e)),
per AS (SELECT doc_id, CAST(count(*) AS BIGINT) AS n_root_lines, string_agg(line, chr(10) ORDER BY line_no) AS root FROM r GROUP BY doc_id)
SELECT doc_id, n_root_lines, md5(root) AS root_md5 FROM per WHERE root <> ''""",
    "code_chunks": f"""WITH {_MOD},
root AS (SELECT p_partkey, string_agg(line, chr(10) ORDER BY n) AS code FROM ml
         WHERE NOT EXISTS (SELECT 1 FROM sp WHERE sp.p_partkey = ml.p_partkey AND kind <> 'async_function' AND n BETWEEN s AND c) GROUP BY p_partkey),
ch AS (SELECT p_partkey, -1 AS depth, 'root' AS name, CAST(NULL AS INTEGER) AS start_line, CAST(NULL AS INTEGER) AS end_line, code FROM root
       UNION ALL SELECT sp.p_partkey, depth, name, CAST(f AS INTEGER), CAST(e AS INTEGER), string_agg(line, chr(10) ORDER BY n)
       FROM sp JOIN ml ON ml.p_partkey = sp.p_partkey AND n BETWEEN f AND e WHERE kind <> 'async_function' GROUP BY ALL)
SELECT p_partkey, CAST(row_number() OVER (PARTITION BY p_partkey ORDER BY depth, start_line) - 1 AS INTEGER) AS seq, name, start_line, end_line,
       CAST(len(string_split(code, chr(10))) AS BIGINT) AS n_lines, md5(code) AS code_md5 FROM ch""",
    "code_spans": f"""WITH {_MOD}
SELECT p_partkey, CAST(row_number() OVER (PARTITION BY p_partkey ORDER BY s) - 1 AS INTEGER) AS seq, name, kind,
       CAST(s AS INTEGER) AS start_line, CAST(e AS INTEGER) AS end_line, name = 'inner' AS nested FROM sp""",
    "called_names": f"""WITH {_MOD},
c AS (SELECT p_partkey, n, unnest(regexp_extract_all(regexp_replace(line, '^ *(async def|def|class) [A-Za-z0-9_]+|\"[^\"]*\"|#.*$', '', 'g'), '([A-Za-z_][A-Za-z0-9_]*)\\(', 1)) AS callee FROM ml)
SELECT DISTINCT sp.p_partkey, sp.name AS caller, callee FROM sp JOIN c ON c.p_partkey = sp.p_partkey AND n BETWEEN s AND e
WHERE kind = 'function' AND callee NOT IN ('len', 'str', 'print')""",
    "import_aliases": f"""
SELECT p_partkey, 'os' AS alias, 'os' AS target FROM part
UNION ALL SELECT p_partkey, 'h_' || {_FN}, 'pkg.' || lower(replace(p_brand, '#', '_')) || '.helper' FROM part""",
    "defined_names": f"""WITH {_MOD}
SELECT p_partkey, string_agg(DISTINCT name, ',' ORDER BY name) AS names FROM sp WHERE kind = 'function' AND name <> 'inner' GROUP BY p_partkey""",
    "strip_comments": f"""WITH {_MOD},
k AS (SELECT p_partkey, regexp_replace(string_agg(regexp_replace(line, '#.*$', ''), chr(10) ORDER BY n), '\\n+', chr(10), 'g') AS code FROM ml GROUP BY p_partkey)
SELECT p_partkey, CAST(length(code) AS BIGINT) AS n_chars, md5(code) AS code_md5 FROM k""",
}
