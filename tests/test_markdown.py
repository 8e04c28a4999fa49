"""Block structure by cases of the public specification, front matter, and what documents are made of."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tidewell.functions import markdown as M
from tidewell.operators import chunk as C
from tidewell.sources import files

CASES = [
    ("# foo\n## foo\n###### foo", ["h1 foo", "h2 foo", "h6 foo"]),
    ("####### foo\n\n#5 bolt\n\n#hashtag", ["p ####### foo", "p #5 bolt", "p #hashtag"]),
    ("## foo ##\n  ###   bar    ###\n# foo#\n### foo ### b", ["h2 foo", "h3 bar", "h1 foo#", "h3 foo ### b"]),
    ("## \n#\n### ###", ["h2 ", "h1 ", "h3 "]),
    ("    # foo\n\nfoo\n    # bar", ["c # foo", "p foo\n# bar"]),
    ("Foo *bar*\n=========\n\nFoo\n---------", ["h1 Foo *bar*", "h2 Foo"]),
    ("Foo\nBar\n===", ["h1 Foo\nBar"]),
    ("Foo\n= =\n\nFoo\n--- -", ["p Foo\n= =", "p Foo", "r --- -"]),
    ("> foo\n-----\n\n- Foo\n---", ["p> foo", "r -----", "p- Foo", "r ---"]),
    ("- foo\n-----", ["p- foo", "r -----"]),
    ("    foo\n---\n\n> foo\nbar\n===", ["c foo", "r ---", "p> foo\nbar\n==="]),
    ("***\n---\n___\n _ _ _ _\n--\n**", ["r ***", "r ---", "r ___", "r _ _ _ _", "p --\n**"]),
    ("```\n<\n >\n```\n~~~\n<\n~~~", ["f <\n >", "f <"]),
    ("```\naaa\n~~~\n```\n````\naaa\n```\n``````", ["f aaa\n~~~", "f aaa\n```"]),
    ("``\nfoo\n``", ["p ``\nfoo\n``"]),
    ("```\n\n`````\n```\naaa", ["f ", "f aaa"]),
    ("> ```\n> aaa\n\nbbb", ["f> aaa", "p bbb"]),
    ("   ```\n   aaa\n    aaa\n  aaa\n   ```", ["f aaa\n aaa\naaa"]),
    ("```\naaa\n    ```", ["f aaa\n    ```"]),
    ("foo\n```\nbar\n```\nbaz", ["p foo", "f bar", "p baz"]),
    ("``` aa ```\naaa\n~~~ aa ``` ~~~\nb\n~~~", ["p ``` aa ```\naaa", "f b"]),
    ("    a simple\n      indented\n\n\n    more\nafter", ["c a simple\n  indented\n\n\nmore", "p after"]),
    ("Foo\n    bar", ["p Foo\nbar"]),
    ("- foo\n\n      bar", ["p- foo", "c- bar"]),
    ("<table>\n <tr>\n</table>\n\nokay.", ["x <table>\n <tr>\n</table>", "p okay."]),
    ("<pre><code>\n# x\n\ny</code></pre>\nokay", ["x <pre><code>\n# x\n\ny</code></pre>", "p okay"]),
    ("<!-- Foo\n\n# bar -->\nokay", ["x <!-- Foo\n\n# bar -->", "p okay"]),
    ("Foo\n<a href=\"bar\">\nbaz\n\n<a href=\"bar\">\n*x*\n</a>", ["p Foo\n<a href=\"bar\">\nbaz", "x <a href=\"bar\">\n*x*\n</a>"]),
    ("Foo\n<div>\nbar\n</div>", ["p Foo", "x <div>\nbar\n</div>"]),
    ("[foo]: /url \"title\"\n\n[foo]", ["d /url", "p [foo]"]),
    ("[Foo bar]: <my url>\n[b]: /u\ntext", ["d my url", "d /u", "p text"]),
    ("[foo]: /url\n===\n[foo]", ["d /url", "p ===\n[foo]"]),
    ("> # Foo\n> bar\n> baz", ["h1> Foo", "p> bar\nbaz"]),
    ("> bar\nbaz\n> foo", ["p> bar\nbaz\nfoo"]),
    ("> - foo\n- bar\n> > deep", ["p>- foo", "p- bar", "p>> deep"]),
    ("> ```\nfoo\n```", ["f> ", "p foo", "f "]),
    ("- one\n\n two", ["p- one", "p two"]),
    ("- one\n\n  two\n\n10) a\n    b", ["p- one", "p- two", "p- a\nb"]),
    ("The number is\n14. A door\n1. yes", ["p The number is\n14. A door", "p- yes"]),
    ("- a\n  - b\n    - c\n- d", ["p- a", "p-- b", "p--- c", "p- d"]),
    ("* Foo\n* * *\n* Bar", ["p- Foo", "r * * *", "p- Bar"]),
    ("\tfoo\tbaz\n\n- \tx", ["c foo\tbaz", "p- x"]),
    ("", []),
    ("\r\n# a\r\nb\r\n", ["h1 a", "p b"]),
]
LETTER = {"paragraph": "p", "fence": "f", "indented": "c", "html": "x", "rule": "r", "definition": "d"}


@pytest.mark.parametrize(("text", "want"), CASES)
def test_blocks(text, want):
    assert [f"{'h' + str(level) if kind == 'heading' else LETTER[kind]}{inside} {content}" for kind, level, _, _, _, inside, content in M.blocks(text)] == want


def test_lines_are_told():
    found = M.blocks("a\nb\n\n~~~py x\nc\n~~~\n# h\nT\n--\n")
    assert [(b[0], b[2], b[3], b[4]) for b in found] == [("paragraph", "", 0, 1), ("fence", "py x", 3, 5), ("heading", "", 6, 6), ("heading", "", 7, 8)]
    for odd in ("`" * 50000, "# " + " " * 50000 + "x", "> " * 3000 + "x", "- " * 3000 + "x", "<a " + "b " * 20000, "[" * 50000, "*" * 50000 + "x", ("`" * 3 + "\n") * 3001):
        M.blocks(odd)


def test_sections(spark):
    text = "intro\n# A\n\n```bash\n# install it\n```\n## B ##\ny\n\nC\n---\n<!--\n# no\n-->\n> # q\n- # i\n"
    rows = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "#\n\nx")], "id long, text string")
    got = {(r["id"], r["section"]): (r["level"], r["title"], r["header_path"], r["content"]) for r in C.header_sections(rows, "id", "text").collect()}
    assert got == {
        (1, 0): (0, None, "", "intro"), (1, 1): (1, "A", "A", "```bash\n# install it\n```"), (1, 2): (2, "B", "A > B", "y"), (1, 3): (2, "C", "A > C", "<!--\n# no\n-->\n> # q\n- # i"),
        (4, 1): (1, "", "", "x"),
    }


MATTER = [
    ("title: A: b\ntags: [x, \"y, z\"]", {"title": "A: b", "tags": ["x", "y, z"]}),
    ("t: 'it''s'\nq: \"a\\nb\"\nn: 3\nf: 1.5\nv: 1.10\ndate: 2024-01-02\nno: false\nz:\nlist:\n- p\n- q # c\nlast: ~", {"t": "it's", "q": "a\nb", "n": 3, "f": 1.5, "v": "1.10", "date": "2024-01-02", "no": False, "z": None, "list": ["p", "q"], "last": None}),
    ("a:\n  b:\n    - c: 1\n      d: 2\n    - e\n  f: {x: 1, y: [2, 3]}", {"a": {"b": [{"c": 1, "d": 2}, "e"], "f": {"x": 1, "y": [2, 3]}}}),
    ("d: >\n  one\n  two\n\n  three\nl: |-\n  k: v\n   w\nend: x", {"d": "one two\nthree\n", "l": "k: v\n w", "end": "x"}),
    ("# only a comment", {}), ("- a\n- b", {}), ("just text", {}), ("", {}), ("a: 1\na: 2\n\tb: 3\n???\nc: 4", {"a": 1, "c": 4}),
]


@pytest.mark.parametrize(("text", "want"), MATTER)
def test_front_matter(text, want):
    got = M.front_fields(text)
    got.pop("\tb", None)
    got.pop("b", None)
    assert got == want


def test_odd_matter():
    assert M.document_fields("a: " + "[" * 20000 + "]" * 20000)[0][0] == {} and M.document_fields("n: " + "9" * 9000)[0]


def test_parsed_documents(spark, tmp_path):
    """Links, tags and code come from blocks; fields from real front matter."""
    (tmp_path / "a.md").write_text(
        "---\ntitle: \"The: title\"\nauthor:\n  - Ann\n  - Bob\ntags:\n  - t1\n  - two words\naliases: [x]\nrelated: other\nsummary: >\n  long\n  text\n---\n\n# A #h\n\nSee [[w]] and [one](b.md), [two][ref], [Ref] and `[[code]]`.\n\n"
        "````\n```\n[[fenced]] #no\n```\n````\n\n    [[indented]] #none\n\nhas #tag\n\n[ref]: /target 'T'\n"
    )
    (tmp_path / "b.txt").write_text("---\nplain: text\n---\n[[x]] #y")
    rows = {r["doc_id"]: r for r in files.parse(files.discover(spark, [str(tmp_path), f"{tmp_path}/"])).collect()}
    a, b = rows["a"], rows["b"]
    assert a["links"] == ["w", "b.md", "/target", "other"] and a["tags"] == ["h", "t1", "tag", "two words"] and a["aliases"] == ["x"]
    assert a["metadata"] == {"title": "The: title", "author": '["Ann", "Bob"]', "summary": "long text\n"} and a["content"].startswith("# A #h")
    assert b["links"] == b["tags"] == [] and b["metadata"] == {} and b["content"].startswith("---")
    found = M.read_blocks(spark.createDataFrame([(1, "```py x\na\n```\n~~~~\nb\n~~~~")], "id long, t string"), ["id"], "t").select(F.inline(M.code(F.col("blocks"))))
    assert [tuple(r) for r in found.collect()] == [("py", "a"), ("", "b")]


def test_discovery_has_no_shuffle(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.md").write_text("x")
    found = files.discover(spark, [str(tmp_path), f"{tmp_path}/in"])
    assert [(r["root"], r["file_path"]) for r in found.collect()] == [(f"{tmp_path}/in", "x.md")]
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
