"""Repair context: prompt messages, resume/carry-forward across passes,
chunk lookup by name, and parsing function patches out of replies.

The model call itself is outside Spark: prompts are written as a table
(one row per message), replies come back as a table keyed the same way.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.functions import text as T

# Default system message; callers pass their own instruction text.
DEFAULT_SYSTEM_PROMPT = (
    "You repair Python code. Given a traceback and the relevant functions, reply with the corrected "
    "functions in one python code block."
)
# The shape of a reply's code.
# Fenced block ```lang\n…``` and, inside python blocks, each "def name(" up to
# the next line-start "def " or the block end.
FENCE_RE = r"(?s)```(?:([a-zA-Z]+)\n)?(.*?)```"
DEF_RE = r"(?smd)(def\s+[a-zA-Z_][a-zA-Z0-9_]*\s*\(.*?(?:(?=^def\s)|\z))"
DEF_NAME_RE = r"^def\s+([a-zA-Z_][a-zA-Z0-9_]*)"


def prompt_messages(
    bugs: DataFrame,
    context: DataFrame,
    key: Sequence[str],
    trace: str = "trace",
    chunk: str = "chunk",
    order: str = "rank",
    system_prompt: str = DEFAULT_SYSTEM_PROMPT,
) -> DataFrame:
    """PRJ-05/AGG-19: the first-pass chat per bug as rows ``key + [msg_no,
    role, content]``: system, ``Traceback: …``, ``Code: `` + the context
    chunks joined by newlines in ``order``.

    ``context`` must be bounded per bug (e.g. the top-K retrieval), since its
    chunks are joined into one message."""
    code = context.groupBy(*key).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order), F.col(chunk)))),
                                 lambda x: x[chunk]), "\n").alias("_code")
    )
    b = bugs.join(code, list(key), "left")
    msgs = F.array(
        F.struct(F.lit(0).alias("msg_no"), F.lit("system").alias("role"), F.lit(system_prompt).alias("content")),
        F.struct(F.lit(1).alias("msg_no"), F.lit("user").alias("role"),
                 F.concat(F.lit("Traceback: "), F.col(trace)).alias("content")),
        F.struct(F.lit(2).alias("msg_no"), F.lit("user").alias("role"),
                 F.concat(F.lit("Code: "), F.coalesce(F.col("_code"), F.lit(""))).alias("content")),
    )
    return b.select(*key, F.explode(msgs).alias("m")).select(*key, "m.msg_no", "m.role", "m.content")


def ordered_chats(turns: DataFrame, key: Sequence[str], turn: str = "turn", role: str = "role", content: str = "text") -> DataFrame:
    """AGG-19: ``key + [chat]``: a chat's messages in order of their turns, as an
    array of (role, content).  A chat is one conversation, so its size is bounded by it."""
    one = F.struct(F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(content).alias("content"))
    in_order = F.transform(F.array_sort(F.collect_list(one)), lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))
    return turns.groupBy(*key).agg(in_order.alias("chat"))


def next_chats(
    bugs: DataFrame, previous: DataFrame, chats: DataFrame, key: Sequence[str], trace: str = "trace", solved: str = "solved", system_prompt: str = DEFAULT_SYSTEM_PROMPT,
) -> DataFrame:
    """JON-18/UDTF-14: ``key + [action, solved, chat]`` of every bug: solved earlier
    → its record and chat carried as they are; unsolved → its chat and the message
    ``New error: …``; not in the earlier run → a new chat (Q17).  The model's
    replies come back as a table of turns, which :func:`ordered_chats` reads."""
    prev = previous.select(*key, F.col(solved).alias("_solved"), F.lit(True).alias("_seen"))
    j = carry_forward(bugs, previous, key, solved).join(prev, list(key), "left").join(chats.select(*key, F.col("chat").alias("_chat")), list(key), "left")
    message = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    empty = F.array().cast("array<struct<role:string,content:string>>")
    old = F.coalesce(F.col("_chat"), empty)
    fresh = F.array(message("system", F.lit(system_prompt)), message("user", F.concat(F.lit("Traceback: "), F.col(trace))))
    more = F.concat(old, F.array(message("user", F.concat(F.lit("New error: "), F.col(trace)))))
    chat = F.when(F.col("action") == "carry", old).when(F.col("action") == "continue", more).otherwise(fresh)
    return j.select(*key, "action", F.col("_solved").alias("solved"), chat.alias("chat"))


def skip_processed(todo: DataFrame, done: DataFrame, key: Sequence[str]) -> DataFrame:
    """JON-17: bugs not yet processed in this run."""
    return todo.join(done.select(*key).distinct(), list(key), "left_anti")


def carry_forward(current: DataFrame, previous: DataFrame, key: Sequence[str], solved: str = "solved") -> DataFrame:
    """JON-18: solved earlier → carry the earlier record; unsolved → continue
    its chat; absent from the earlier run → start fresh (Q17)."""
    prev = previous.select(*key, F.col(solved).alias("_solved"), F.lit(True).alias("_seen"))
    j = current.join(prev, list(key), "left")
    action = (
        F.when(F.col("_seen").isNull(), F.lit("fresh"))
        .when(F.col("_solved"), F.lit("carry"))
        .otherwise(F.lit("continue"))
    )
    return j.select(*current.columns, action.alias("action"))


def first_by_name(chunks: DataFrame, wanted: DataFrame, key: Sequence[str], name: str = "name",
                  seq: str = "seq") -> DataFrame:
    """JON-15/WIN-03: the first chunk (in chunk order) with each wanted name;
    null when absent (Q25)."""
    first = chunks.groupBy(*key, name).agg(F.min(seq).alias("found_seq"))
    return wanted.join(first.hint("merge"), [*key, name], "left")


def parse_patches(replies: DataFrame, key: Sequence[str], text: str = "reply") -> DataFrame:
    """UDTF-10/FLT-04: function definitions inside ``python``-tagged fences.
    Output ``key + [pos, fn_name, fn_code]`` (code stripped)."""
    blocks = F.arrays_zip(
        F.regexp_extract_all(F.col(text), F.lit(FENCE_RE), 1).alias("lang"),
        F.regexp_extract_all(F.col(text), F.lit(FENCE_RE), 2).alias("body"),
    )
    py = F.filter(blocks, lambda b: b["lang"] == "python")
    defs = F.flatten(F.transform(py, lambda b: F.regexp_extract_all(b["body"], F.lit(DEF_RE), 1)))
    x = replies.select(*key, F.posexplode(defs).alias("pos", "_c"))
    return x.select(*key, F.col("pos").cast("int"), F.regexp_extract(F.col("_c"), DEF_NAME_RE, 1).alias("fn_name"),
                    T.py_strip(F.col("_c")).alias("fn_code"))
