"""Code facts against Python's own tokenizer and parser."""

import ast
import io
import keyword
import builtins
import random
import tokenize

import pytest

from faultline.operators import lexer, source

SOURCES = [
    "",
    "x = 1",
    '"""doc"""\nx = "\'\'\'"  # not \'\'\' open\ny = \'"""\'\ndef f():\n    return g(x)\n',
    "'''doc\nof two''' ; import os; import sys as s\nfrom a.b import (c as d,\n    e)  # e\nx = 1; from q import r\n",
    "def f():\n    'one \\\n    # of two'; y = 1 # end\n    z = '''# \ndef no(): # no\n''' + \"#\" # yes\n    return g('\"') + \\\n        h(z)\n",
    "class A:\n    r'''d'''\n    x = {\n  'def': [1,\n  2]}\n    def m(self): return p(self)\n    async def n(self):\n        await q()\n\n    @w(1)\n    @v\n    def o(self):\n        # only\n        pass\nprint(A)\n",
    "if a:\n    def one(): pass\nelif b:\n    def two():\n        class Deep:\n            def in_deep(self): f()\nelif c:\n    def three(): pass\nelse:\n    def four(): pass\ndef five():\n    pass\n"
    "try:\n    def six(): pass\nexcept E:\n    def seven(): pass\nelse:\n    def eight(): pass\nfinally:\n    def nine(): pass\nfor i in z:\n    while i:\n        def ten(): pass\n    else:\n        def eleven(): pass\n",
    "match x:\n    case 1:\n        def a(): pass\n    case _:\n        def b(): pass\ndef c():\n    with p as q:\n        def d(): pass\n    def e(): pass\n",
    "x = '\\\\'  # after a backslash\ny = \"\\\"#\"  # c\nz = '''\\'''# in'''  # out\nw = \"\"\"a\"b\"\"c\"\"\"\n",
    "def f(a, b=')', c='('):\n    return (a\n# in brackets\n  + g(b))\n\n\n# end\n",
    "\tx\n",
    "def tabs():\n\tif a:\n\t\treturn b()\n        # eight blanks\n\treturn c()\n",
    "s = 'it''s'; t = \"\"; u = ''\nv = '' ''\nw = \"\" '''a''' \"b\"\ndef last(): return 1",
    "# first\n'''not the first token'''\nclass C:\n    # comment\n    u'''doc'''  # c\n    y = 2   \n\n    z = 3\n",
]


def mask(text):
    """The tokens put together again, with docstrings and comments replaced."""
    out, before, line, col = [], tokenize.INDENT, -1, 0
    for t in tokenize.generate_tokens(io.StringIO(text).readline):
        if t.start[0] > line:
            col = 0
        out.append(" " * max(0, t.start[1] - col))
        out.append("#--" if t.type == tokenize.STRING and before == tokenize.INDENT else "##\n" if t.type == tokenize.COMMENT else t.string)
        before, (line, col) = t.type, t.end
    return "".join(out)


def parsed(text):
    tree = ast.parse(text)
    spans, calls, imports, order = set(), set(), {}, []
    known = {*dir(builtins), *keyword.kwlist}
    for node in ast.walk(tree):
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            first = min([node.lineno, *(d.lineno for d in node.decorator_list)])
            spans.add((node.name, type(node).__name__, first, node.lineno, node.end_lineno, node.body[-1].lineno))
            if not isinstance(node, ast.AsyncFunctionDef):
                order.append(node.name)
        if isinstance(node, ast.FunctionDef):
            for n in (x for part in [node.args, *node.body] for x in ast.walk(part)):
                if isinstance(n, ast.Call):
                    name = getattr(n.func, "id", getattr(n.func, "attr", None))
                    if name and name not in known:
                        calls.add((node.name, name))
    for node in tree.body:
        if isinstance(node, ast.Import):
            imports |= {a.asname or a.name: a.name for a in node.names}
        if isinstance(node, ast.ImportFrom):
            imports |= {a.asname or a.name: f"{node.module}.{a.name}" for a in node.names}
    return spans, calls, imports, order


KINDS = {"function": "FunctionDef", "async_function": "AsyncFunctionDef", "class": "ClassDef"}


def files(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "f int, content string")


def test_facts_equal_the_parsers(spark):
    good = [t for t in SOURCES if not t.startswith("\t")]
    src = files(spark, good)
    ln, found = source.facts(src, ["f"])
    got = {k: (set(), set(), {}, []) for k in range(len(good))}
    for r in found.collect():
        got[r.f][0].add((r.name, KINDS[r.kind], r.first_line, r.start_line, r.end_line, r.cover_end))
    for r in source.calls(ln, found, ["f"]).collect():
        got[r.f][1].add((r.caller, r.callee))
    for r in source.imports(ln, ["f"]).collect():
        got[r.f][2][r.alias] = r.target
    for r in source.chunks(ln, found, ["f"]).orderBy("f", "seq").collect():
        if r.name != "root":
            got[r.f][3].append(r.name)
    for k, text in enumerate(good):
        assert got[k] == parsed(text), text


def test_masked_equals_the_tokenizer(spark):
    good = [t for t in SOURCES if not t.startswith("\t") and "\t" not in t]
    out = {r.f: r.code for r in source.masked(source.lines(files(spark, good), ["f"]), ["f"]).collect()}
    for k, text in enumerate(good):
        assert out[k] == mask(text), text


def plain_states(text):
    """The state at the beginning of each line, character by character."""
    out, state, i, closing = [lexer.CODE], lexer.CODE, 0, {v: k for k, v in lexer.STATES.items()}
    comment = False
    while i < len(text):
        c = text[i]
        if c == "\n":
            comment = False
            if state in (lexer.ONE, lexer.TWO) and not escaped:
                state = lexer.CODE
            out.append(state)
        escaped = False
        if state == lexer.CODE:
            if not comment and c == "#":
                comment = True
            elif not comment and text[i:i + 3] in ("'''", '"""'):
                state, i = lexer.STATES[text[i:i + 3]], i + 2
            elif not comment and c in "'\"":
                state = lexer.STATES[c]
        elif c == "\\":
            if text[i + 1:i + 2] != "\n":
                i += 1
            else:
                escaped = True
        elif text.startswith(closing[state], i):
            i, state = i + len(closing[state]) - 1, lexer.CODE
        i += 1
    return out


@pytest.mark.parametrize("block", [1, 7, 64])
def test_states_of_any_text(spark, monkeypatch, block):
    monkeypatch.setattr(lexer, "BLOCK", block)
    rnd = random.Random(block)
    pieces = ["'", '"', "'''", '"""', "\\", "\\\n", "\n", "\n", "#", "x", " ", "(", "\u2028", "\x0c", "é"]
    texts = [*SOURCES, *("".join(rnd.choice(pieces) for _ in range(rnd.randint(0, 200))) for _ in range(300)), "'''\n" * 999, "x = 'y' # z\n" * 2000, '"' + "a\\\n" * 500]
    got = {}
    for r in lexer.states(files(spark, texts), ["f"]).collect():
        got.setdefault(r.f, []).append((r.line_no, r.state, r.text))
    for k, text in enumerate(texts):
        rows = sorted(got[k])
        assert "\n".join(r[2] for r in rows) == text
        assert [r[1] for r in rows] == plain_states(text), repr(text)


def test_functions_compose():
    """Composing first and then applying is applying one after the other."""
    rnd = random.Random(1)
    translate = lambda a, b: "".join(b[int(c)] for c in a)
    for _ in range(50):
        f, g, h = ("".join(rnd.choice("01234") for _ in range(5)) for _ in range(3))
        assert translate(translate(f, g), h) == translate(f, translate(g, h))


def test_a_line_of_many_literals_and_a_null_file(spark):
    long = "x = [" + "'a\\'b', " * 50000 + "]  # end"
    df = spark.createDataFrame([(0, long), (1, None)], "f int, content string")
    rows = {r.f: r for r in source.lines(df, ["f"]).collect()}
    assert rows[0].comment == "# end" and len(rows[0].code) == 5 + 4 * 50000 + 1
    assert rows[1].text == "" and not rows[1].starts
    assert source.lines(df.limit(0), ["f"]).collect() == []
