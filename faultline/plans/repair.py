"""Repair context, resume, reports and legacy evaluation bound to the
driver tables.

* prompts: a benchmark passage is the failure text; its top-5 retrieved
  documents are the code context (bounded by K).
* resume: conversations already answered in ``labels`` are skipped;
  documents labelled before are carried forward / continued / started.
* legacy three-state rule: a document's expected checks are ``quality`` and
  ``clean``; a label row is its result; no label → skipped.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from faultline.operators import context, report, segment, source
from faultline.operators import evaluate as ev
from faultline.plans import corpus, retrieval
from faultline.plans.truth import _MOD, KEY, part_facts
from faultline.sources.tables import read_table

# Display order of groups in the printed report (a fixed dimension).
REPORT_ORDER = [9, 8, 7, 6, 5, 4, 3, 2, 1, 0]
REPORT_K = 5
CHAT_PROMPT = "Repair the code."


def prompt_assembly(spark: SparkSession, sf: str):
    hits = corpus.retrieve_passages(spark, sf)
    docs = read_table(spark, sf, "documents", "doc_id", "text")
    ctx = hits.join(docs, "doc_id").select("item_id", "rank", F.col("text").alias("chunk"))
    bugs = read_table(spark, sf, "benchmark", "item_id", "text").withColumnRenamed("text", "trace")
    m = context.prompt_messages(bugs, ctx, ["item_id"])
    return m.select("item_id", F.col("msg_no").cast("int"), "role", F.length("content").cast("bigint").alias("n_chars"),
                    F.md5("content").alias("content_md5"))


def resume_skip(spark, sf):
    todo = read_table(spark, sf, "conversations", "conv_id").distinct()
    done = read_table(spark, sf, "labels", "doc_id").withColumnRenamed("doc_id", "conv_id")
    return context.skip_processed(todo, done, ["conv_id"])


def carry_forward(spark, sf):
    cur = read_table(spark, sf, "documents", "doc_id")
    prev = read_table(spark, sf, "labels", "doc_id", "quality").select("doc_id", (F.col("quality") == 1).alias("solved"))
    return context.carry_forward(cur, prev, ["doc_id"])


def next_chats(spark, sf):
    """JON-18/AGG-19/UDTF-14: conversations as earlier chats, labels as earlier results, documents as new errors."""
    chats = context.ordered_chats(read_table(spark, sf, "conversations", F.col("conv_id").alias("doc_id"), "turn", "role", "text"), ["doc_id"])
    prev = read_table(spark, sf, "labels", "doc_id", "quality").select("doc_id", (F.col("quality") == 1).alias("solved"))
    bugs = read_table(spark, sf, "documents", "doc_id", F.col("text").alias("trace"))
    out = context.next_chats(bugs, prev, chats, ["doc_id"], system_prompt=CHAT_PROMPT)
    said = F.array_join(F.transform("chat", lambda m: F.concat(m["role"], F.lit(": "), m["content"])), "\n")
    return out.select("doc_id", "action", "solved", F.size("chat").cast("bigint").alias("n_messages"), F.md5(said).alias("chat_md5"))


def metrics_document(spark, sf):
    """SNK-05: overall and per-label numbers of each k, as one text a k."""
    pq = retrieval.per_query(spark, sf)
    per_k = ev.success_at_k(pq)
    roll = ev.success_rollup(pq.join(read_table(spark, sf, "embeddings", "vec_id", "label"), "vec_id"), "label").where("is_total = 0")
    doc = report.metrics_document(per_k, roll, "label")
    return doc.select("k", F.col("metrics.passed").alias("passed"), F.array_join(F.transform("groups", lambda g: F.concat_ws(":", g["label"].cast("string"), g["passed"].cast("string"), g["failed"].cast("string"))), ",").alias("groups"))


def latex_rows(spark, sf):
    """SNK-07: the ordered report's rows as table rows."""
    roll = retrieval.success_rollup(spark, sf).where((F.col("k") == REPORT_K) & (F.col("is_total") == 0))
    rows = report.ordered_rows(roll, report.order_dimension(spark, REPORT_ORDER, "label", "int"), "label")
    return rows.select("ord", "label", report.latex_row(F.col("label"), F.col("passed"), F.col("total")).alias("row"))


def run_stamps(spark, sf):
    """SCA-14/SNK-06: folder names of runs that begin at the events' times."""
    e = read_table(spark, sf, "events", "event_id", "ts")
    return e.select("event_id", report.run_stamp(F.col("ts")).alias("run"))


def break_costs(spark, sf):
    """UDTF-04: break candidates of the part modules."""
    ln, sp = part_facts(spark, sf)
    body = source.bodies(ln, sp, KEY)
    return segment.break_costs(sp.join(body.hint("merge"), [*KEY, "seq"]), KEY)


def record_merge(spark, sf):
    """SET-04: customers and suppliers merged by their numbers, the supplier's values winning."""
    a = read_table(spark, sf, "customer", F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance"))
    b = read_table(spark, sf, "supplier", F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("nation"), F.col("s_name").alias("name"))
    return report.merged(a, b, ["id"])


def name_lookup(spark, sf):
    chunks = source.chunks(*part_facts(spark, sf), KEY).select("p_partkey", "name", "seq")
    p = read_table(spark, sf, "part", "p_partkey", "p_name")
    wanted = p.select("p_partkey", F.explode(F.array(
        F.lit("inner"), F.lit("price"), F.lit("fetch"), F.regexp_replace("p_name", " ", "_"))).alias("name"))
    return context.first_by_name(chunks, wanted, ["p_partkey"])


def part_replies(spark, sf):
    p = read_table(spark, sf, "part", "p_partkey", "p_name", "p_size")
    fn = F.regexp_replace("p_name", " ", "_")
    reply = F.concat(
        F.lit("Here is the fix:\n```python\n@dec\ndef f_"), fn, F.lit("(x):\n    return x * "),
        F.col("p_size").cast("string"), F.lit("\n\ndef g_"), fn, F.lit("(y):\n    return y\n```\nand in js:\n"),
        F.lit("```js\nfunction a() {}\n```\n```\ndef untagged():\n    pass\n```"),
    )
    return p.select("p_partkey", reply.alias("reply"))


def patch_parse(spark, sf):
    r = context.parse_patches(part_replies(spark, sf), ["p_partkey"])
    return r.select("p_partkey", "pos", "fn_name", F.length("fn_code").cast("bigint").alias("n_chars"),
                    F.md5("fn_code").alias("code_md5"))


def retrieval_report(spark, sf):
    """SNK-04: per query, its ranked list as ``rank:id`` items in rank order."""
    ranked = retrieval.knn_l2_global(spark, sf)
    lists = report.ranked_lists(ranked, ["vec_id"], ["neighbor_id"])
    return lists.select(
        "vec_id", F.size("results").cast("bigint").alias("n_results"),
        F.array_join(F.transform(F.col("results"),
                                 lambda x, i: F.concat((i + 1).cast("string"), F.lit(":"),
                                                       x["neighbor_id"].cast("string"))), ",").alias("results"),
    )


def ordered_report(spark, sf):
    """JON-16/SNK-07/SCA-13: success@5 per label in the fixed display order,
    printed as aligned text lines."""
    roll = retrieval.success_rollup(spark, sf).where((F.col("k") == REPORT_K) & (F.col("is_total") == 0))
    order = report.order_dimension(spark, REPORT_ORDER, "label", "int")
    rows = report.ordered_rows(roll, order, "label")
    return rows.select("ord", "label",
                       report.format_line(F.col("label"), F.col("passed"), F.col("total"), F.col("success_rate"))
                       .alias("line"))


def all_required_in_topk(spark, sf):
    """AGG-05: each role of a conversation must appear within its first k turns."""
    c = read_table(spark, sf, "conversations", "conv_id", "turn", "role")
    pred = c.select("conv_id", F.col("role"), (F.col("turn") + 1).alias("rank"))
    req = c.select("conv_id", "role")
    return ev.all_required_at_k(req, pred, ["conv_id"], "role")


def _classified(spark, sf):
    d = read_table(spark, sf, "documents", "doc_id", "source")
    lab = read_table(spark, sf, "labels", "doc_id", "quality", "toxic")
    items = lab.select("doc_id", F.explode(F.array(
        F.struct(F.lit("quality").alias("item"), (F.col("quality") == 1).alias("found")),
        F.struct(F.lit("clean").alias("item"), (F.col("toxic") == 0).alias("found")),
    )).alias("x")).select("doc_id", "x.item", "x.found")
    q = d.join(lab.select("doc_id", F.lit(True).alias("has_result")), "doc_id", "left").select(
        "doc_id", "source", F.coalesce(F.col("has_result"), F.lit(False)).alias("has_result"))
    cls = ev.classify_majority(items, q.select("doc_id", "has_result"), ["doc_id"])
    return cls.join(d, "doc_id")


def majority_three_state(spark, sf):
    return _classified(spark, sf).select("doc_id", "n_items", "n_missing", "state", "reason")


def rates_with_skips(spark, sf):
    return ev.rates_with_skips(_classified(spark, sf), ["source"])


def count_check(spark, sf):
    return ev.assert_consistent(ev.rates_with_skips(_classified(spark, sf)))


QUERIES = {
    "prompt_assembly": prompt_assembly,
    "resume_skip": resume_skip,
    "carry_forward": carry_forward,
    "name_lookup": name_lookup,
    "next_chats": next_chats,
    "metrics_document": metrics_document,
    "break_costs": break_costs,
    "latex_rows": latex_rows,
    "run_stamps": run_stamps,
    "record_merge": record_merge,
    "patch_parse": patch_parse,
    "retrieval_report": retrieval_report,
    "ordered_report": ordered_report,
    "all_required_in_topk": all_required_in_topk,
    "majority_three_state": majority_three_state,
    "rates_with_skips": rates_with_skips,
    "count_check": count_check,
}

_FN = "replace(p_name, ' ', '_')"
_F_CODE = f"'def f_' || {_FN} || '(x):' || chr(10) || '    return x * ' || p_size"
_G_CODE = f"'def g_' || {_FN} || '(y):' || chr(10) || '    return y'"
_CLS = """
lab AS (SELECT doc_id, quality, toxic FROM labels),
it AS (SELECT doc_id, 2 AS n_items, (CASE WHEN quality = 1 THEN 0 ELSE 1 END) + (CASE WHEN toxic = 0 THEN 0 ELSE 1 END) AS n_missing FROM lab),
cls AS (SELECT d.doc_id, d.source, CAST(coalesce(it.n_items, 0) AS BIGINT) AS n_items, CAST(coalesce(it.n_missing, 0) AS BIGINT) AS n_missing,
               CASE WHEN it.doc_id IS NULL THEN 'skipped' WHEN coalesce(it.n_missing, 0) * 2 >= coalesce(it.n_items, 0) THEN 'failed' ELSE 'passed' END AS state,
               CASE WHEN it.doc_id IS NULL THEN 'no result' END AS reason
        FROM documents d LEFT JOIN it USING (doc_id))"""
_RATES = """CAST(count(*) FILTER (WHERE state = 'passed') AS BIGINT) AS passed,
       CAST(count(*) FILTER (WHERE state = 'failed') AS BIGINT) AS failed,
       CAST(count(*) FILTER (WHERE state = 'skipped') AS BIGINT) AS skipped,
       CAST(count(*) AS BIGINT) AS total,
       round(count(*) FILTER (WHERE state = 'passed') / nullif(count(*) FILTER (WHERE state IN ('passed', 'failed')), 0), 6) AS rate_without_skips,
       round(count(*) FILTER (WHERE state = 'passed') / count(*), 6) AS rate_with_skips,
       count(*) FILTER (WHERE state IN ('passed', 'failed', 'skipped')) = count(*) AS consistent"""


def _oracle():
    from faultline.plans.corpus import ORACLE as C
    from faultline.plans.retrieval import ORACLE as R
    from faultline.plans.retrieval import _RANKED

    sysmsg = context.DEFAULT_SYSTEM_PROMPT.replace("'", "''")
    order_vals = ", ".join(f"({v}, {i})" for i, v in enumerate(REPORT_ORDER))
    return {
        "prompt_assembly": f"""
WITH rp AS ({C['retrieve_passages']}),
code AS (SELECT rp.item_id, string_agg(d.text, chr(10) ORDER BY rp.rank) AS code
         FROM rp JOIN documents d ON d.doc_id = rp.doc_id GROUP BY rp.item_id),
m AS (SELECT b.item_id, 0 AS msg_no, 'system' AS role, '{sysmsg}' AS content FROM benchmark b
      UNION ALL SELECT item_id, 1, 'user', 'Traceback: ' || text FROM benchmark
      UNION ALL SELECT b.item_id, 2, 'user', 'Code: ' || coalesce(code.code, '') FROM benchmark b LEFT JOIN code USING (item_id))
SELECT item_id, CAST(msg_no AS INTEGER) AS msg_no, role, CAST(length(content) AS BIGINT) AS n_chars, md5(content) AS content_md5 FROM m""",
        "resume_skip": "SELECT DISTINCT conv_id FROM conversations WHERE conv_id NOT IN (SELECT doc_id FROM labels)",
        "carry_forward": """
SELECT d.doc_id, CASE WHEN l.doc_id IS NULL THEN 'fresh' WHEN l.quality = 1 THEN 'carry' ELSE 'continue' END AS action
FROM documents d LEFT JOIN labels l USING (doc_id)""",
        "next_chats": f"""
WITH c AS (SELECT conv_id AS doc_id, count(*) AS n, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS said FROM conversations GROUP BY conv_id),
x AS (SELECT d.doc_id, d.text, l.quality = 1 AS solved, coalesce(c.n, 0) AS n, c.said,
             CASE WHEN l.doc_id IS NULL THEN 'fresh' WHEN l.quality = 1 THEN 'carry' ELSE 'continue' END AS action
      FROM documents d LEFT JOIN labels l USING (doc_id) LEFT JOIN c ON c.doc_id = d.doc_id)
SELECT doc_id, action, solved, CAST(CASE action WHEN 'fresh' THEN 2 WHEN 'carry' THEN n ELSE n + 1 END AS BIGINT) AS n_messages,
       md5(CASE action WHEN 'fresh' THEN 'system: {CHAT_PROMPT}' || chr(10) || 'user: Traceback: ' || text WHEN 'carry' THEN coalesce(said, '')
                       ELSE coalesce(said || chr(10), '') || 'user: New error: ' || text END) AS chat_md5 FROM x""",
        "metrics_document": f"""
WITH a AS ({R['success_at_k']}), g AS ({R['success_rollup']})
SELECT a.k, a.passed, string_agg(g.label || ':' || g.passed || ':' || g.failed, ',' ORDER BY g.label) AS groups FROM a JOIN g ON g.k = a.k AND g.is_total = 0 GROUP BY a.k, a.passed""",
        "latex_rows": f"""
WITH g AS ({R['success_rollup']})
SELECT CAST(9 - label AS INTEGER) AS ord, label, label || ' & ' || passed || ' & ' || total || ' \\\\' AS row FROM g WHERE k = {REPORT_K} AND is_total = 0""",
        "run_stamps": "SELECT event_id, strftime(ts, '%m_%d_%Y__%H_%M_%S') AS run FROM events",
        "break_costs": f"""WITH {_MOD} SELECT p_partkey, CAST(s AS INTEGER) AS line_no, CASE kind WHEN 'class' THEN 3.0::DOUBLE ELSE 5.0::DOUBLE END AS cost FROM sp""",
        "record_merge": """
SELECT coalesce(c_custkey, s_suppkey) AS id, CASE WHEN s_suppkey IS NULL THEN c_nationkey ELSE s_nationkey END AS nation, c_acctbal AS balance, s_name AS name
FROM customer FULL JOIN supplier ON c_custkey = s_suppkey""",
        "name_lookup": f"""
SELECT p_partkey, 'inner' AS name, 3 AS found_seq FROM part
UNION ALL SELECT p_partkey, 'price', 4 FROM part
UNION ALL SELECT p_partkey, 'fetch', NULL FROM part
UNION ALL SELECT p_partkey, {_FN}, 1 FROM part""",
        "patch_parse": f"""
SELECT p_partkey, 0 AS pos, 'f_' || {_FN} AS fn_name, CAST(length({_F_CODE}) AS BIGINT) AS n_chars, md5({_F_CODE}) AS code_md5 FROM part
UNION ALL SELECT p_partkey, 1, 'g_' || {_FN}, CAST(length({_G_CODE}) AS BIGINT), md5({_G_CODE}) FROM part""",
        "retrieval_report": f"""
WITH r AS ({R['knn_l2_global']})
SELECT vec_id, CAST(count(*) AS BIGINT) AS n_results, string_agg(rank || ':' || neighbor_id, ',' ORDER BY rank) AS results
FROM r GROUP BY vec_id""",
        "ordered_report": f"""
WITH sr AS ({R['success_rollup']}),
o(label, ord) AS (VALUES {order_vals})
SELECT o.ord, sr.label,
       printf('%-12s %5d/%-5d %7s', CAST(sr.label AS VARCHAR), sr.passed, sr.total, printf('%.2f%%', sr.success_rate * 100.0)) AS line
FROM sr JOIN o ON o.label = sr.label WHERE sr.k = {REPORT_K} AND sr.is_total = 0""",
        "all_required_in_topk": """
WITH best AS (SELECT conv_id, role, min(turn + 1) AS b FROM conversations GROUP BY conv_id, role),
q AS (SELECT conv_id, CAST(count(*) AS BIGINT) AS n_required, max(b) AS need FROM best GROUP BY conv_id)
SELECT conv_id, k, n_required, need <= k AS passed FROM q, (VALUES (1), (5), (10)) ks(k)""",
        "majority_three_state": f"WITH {_CLS} SELECT doc_id, n_items, n_missing, state, reason FROM cls",
        "rates_with_skips": f"WITH {_CLS} SELECT source, {_RATES} FROM cls GROUP BY source",
        "count_check": f"WITH {_CLS} SELECT {_RATES} FROM cls",
    }


ORACLE = _oracle()
