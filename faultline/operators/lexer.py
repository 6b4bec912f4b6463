"""Lines of Python files with the lexer's state, as a parallel prefix in Spark.

What a line does to the lexer depends on the state it begins in: code, or one of
four open strings.  So a line is a function from states to states, written as a
text of five digits (the end state for each start state), and two functions
compose by ``translate``.  Functions of lines are computed independently, composed
within blocks of lines, and the blocks' functions along the file; then each
block gives its lines their states.  A file arrives as one row, and all of this
happens in that row or in rows of one block: files are dealt out before, lines are not
shuffled, and what is kept along a file is five digits a block.

Strings end where Python's do: at their own quotes, at the end of the line for
one quote without a backslash before the line feed.  A quote inside another
literal or a comment opens nothing.  Nested quotes inside the braces of an
f-string (Python 3.12) are not followed.  A null file has one empty line.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.session import spread

BLOCK = 64
# States at the beginning of a line: code, in ''' or \"\"\", in ' or " behind a backslash.
CODE, TRIPLE_ONE, TRIPLE_TWO, ONE, TWO = "01234"
SAME = "01234"


def _rest(quote: str) -> str:
    """The inside of a string up to (not with) its closing quotes, without going back."""
    c = quote[0]
    inner = r"\\." if len(quote) == 1 else rf"\\.|{c}(?!{c}{c})"
    return rf"[^{c}\\]*+(?:(?:{inner})[^{c}\\]*+)*+"


CLOSED = "|".join(f"{start}{_rest(q)}{q}" for q, start in (
    ('"""', '"""'), ("'''", "'''"), ('"', '"(?!"")'), ("'", "'(?!'')")))
#: code and closed literals up to a comment, an open string or the end
AHEAD = rf"(?:[^'\"#]++|{CLOSED})*+"
#: what is open at the end of the line, behind AHEAD
OPEN = "|".join(['"""', "'''", *(rf"{q}(?={_rest(q)}\\\z)" for q in "\"'")])
LITERAL = rf"{CLOSED}|(?:\"\"\"|'''|\"|').*\z"  # open ones as well
STATES = {'"""': TRIPLE_TWO, "'''": TRIPLE_ONE, '"': TWO, "'": ONE}


def _end(opener: Column) -> Column:
    out = F.lit(CODE)
    for quote, state in STATES.items():
        out = F.when(opener == quote, state).otherwise(out)
    return out


def transition(line: Column) -> Column:
    """A line's function: its end state for each of the five start states."""

    def after(quote: str) -> Column:
        closing = rf"(?s)^{_rest(quote)}{quote}{AHEAD}({OPEN})?"
        state = STATES[quote]
        goes_on = F.lit(state) if len(quote) == 3 else F.when(F.regexp_like(line, F.lit(rf"(?s)^{_rest(quote)}\\\z")), state).otherwise(CODE)
        return F.when(F.regexp_extract(line, closing, 0) == "", goes_on).otherwise(_end(F.regexp_extract(line, closing, 1)))

    full = F.concat(_end(F.regexp_extract(line, rf"(?s)^{AHEAD}({OPEN})?", 1)), after("'''"), after('"""'), after("'"), after('"'))
    return F.when(F.regexp_like(line, F.lit(r"['\"\\]")), full).otherwise(CODE + TRIPLE_ONE + TRIPLE_TWO + CODE + CODE)


def compose(first: Column, then: Column) -> Column:
    """The function that applies ``first`` and then ``then``."""
    return F.call_function("translate", first, F.lit(SAME), then)


def states(files: DataFrame, key: Sequence[str], content: str = "content") -> DataFrame:
    """``key + [line_no, text, state]``: each line with the state it begins in."""
    key = list(key)
    whole = F.regexp_replace(F.coalesce(F.col(content), F.lit("")), "\r\n?", "\n")
    x = spread(files, key, text=content).select(*key, F.split(whole, "\n", -1).alias("_lines"))
    x = x.withColumn("_does", F.transform("_lines", transition))
    part = lambda c, b: F.slice(F.col(c), b * BLOCK + 1, F.lit(BLOCK))
    numbers = F.sequence(F.lit(0), F.floor((F.size("_lines") - 1) / BLOCK).cast("int"))
    blocks = F.transform(numbers, lambda b: F.aggregate(part("_does", b), F.lit(SAME), compose))
    # the state that each block begins in: its digits in one text, the last one behind the file's end
    walk = lambda functions, start: F.aggregate(
        functions, start, lambda acc, does: F.concat(acc, compose(F.substring(acc, -1, 1), does)))
    x = x.withColumn("_starts", walk(blocks, F.lit(CODE)))
    x = x.select(*key, "_starts", F.explode(F.transform(numbers, lambda b: F.struct(
        b.alias("b"), part("_lines", b).alias("lines"), part("_does", b).alias("does")))).alias("_x"))
    x = x.select(*key, "_x.b", "_x.lines", walk(F.col("_x.does"), F.expr("substring(_starts, _x.b + 1, 1)")).alias("_at"))
    x = x.select(*key, "b", "_at", F.posexplode("lines").alias("_p", "text"))
    return x.select(*key, (F.col("b") * BLOCK + F.col("_p") + 1).alias("line_no"), "text", F.expr("substring(_at, _p + 1, 1)").alias("state"))


def lines(files: DataFrame, key: Sequence[str], content: str = "content") -> DataFrame:
    """``key + [line_no, text, own, code, comment, indent, inside, opens, starts, holds]``.

    ``own``: what stands outside a string that began on an earlier line (``inside``);
    ``code``: that without comments and with empty literals; ``opens``: a string
    goes on behind the line; ``starts``: a statement begins here; ``holds``: the line
    has code or a part of a string."""
    key = list(key)
    x = states(files, key, content)
    t = F.col("text")
    own = t
    for quote, state in STATES.items():
        closing = rf"(?s)^{_rest(quote)}{quote}"
        rest = F.when(F.regexp_like(t, F.lit(closing)), F.regexp_replace(t, closing, "")).otherwise("")
        own = F.when(F.col("state") == state, rest).otherwise(own)
    x = x.withColumn("own", own)
    quoted = F.regexp_like("own", F.lit("['\"#]"))
    # a literal becomes two quotes, and so does the place before a comment, which goes with it
    plain = F.regexp_replace(F.regexp_replace("own", rf"(?s){LITERAL}|(#.*)\z", '""$1'), r'(?s)""#.*\z', "")
    x = x.withColumns({
        "code": F.rtrim(F.when(quoted, plain).otherwise(F.col("own"))),
        "comment": F.when(quoted, F.regexp_extract("own", rf"(?s)^{AHEAD}(#.*)\z", 1)).otherwise(""),
        "indent": F.length(F.regexp_replace(F.regexp_extract("text", r"^[ \t]*", 0), " {8}| {0,7}\t", " " * 8)),
        "inside": F.col("state") != CODE,
    })
    count = lambda chars: F.length("code") - F.length(F.translate("code", chars, ""))
    order = Window.partitionBy(*key).orderBy("line_no")
    depth = F.coalesce(F.sum(count("([{") - count(")]}")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    goes_on = F.coalesce(F.endswith(F.lag("code").over(order), F.lit("\\")), F.lit(False))
    next_inside = F.coalesce(F.lead("inside").over(order), F.lit(False))
    return x.select(
        *key, "line_no", "text", "own", "code", "comment", "indent", "inside", next_inside.alias("opens"),
        ((F.trim("code") != "") & ~F.col("inside") & (depth <= 0) & ~goes_on).alias("starts"),
        ((F.trim("text") != "") & (F.col("inside") | (F.trim("code") != ""))).alias("holds"),
    )
