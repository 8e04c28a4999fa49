from __future__ import annotations

import fnmatch
from pathlib import PurePosixPath

import pytest
from pyspark.sql import functions as F

from tidewell.functions import text as T
from tidewell.operators import chunk as C
from tidewell.sources import files, gitlog


def value(spark, column, **cells):
    schema = ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'binary' if isinstance(v, bytes) else 'string'}" for k, v in cells.items())
    return spark.createDataFrame([tuple(cells.values())], schema).select(column.alias("x")).first()[0]


PAGE = "---\ntitle: 'A page'\ntags: [one, \"two\"]\nrelated:\n  - x.md\n  - y\n---\n# Head\nSee [[Note|n]], ![[Embed]], ![pic](p.png) and [l](docs/a.md \"t\") #café #ok\n`[[no]]`\n```\n[[never]] #never\n```\n"


def test_front_matter(spark):
    m = T.front_matter(F.col("t"))
    assert value(spark, T.front_value(m, "title"), t=PAGE) == "A page"
    assert value(spark, T.front_list(m, "tags"), t=PAGE) == ["one", "two"]
    assert value(spark, T.front_list(m, "related"), t=PAGE) == ["x.md", "y"]
    assert value(spark, T.front_list(m, "aliases"), t=PAGE) == []
    assert value(spark, T.front_value(m, "title"), t="\n---\ntitle: no\n---\n") is None
    assert value(spark, T.body(F.col("t")), t="---\na: 1\n---\n\n text \n") == "text"


def test_links_and_tags(spark):
    bare = T.without_code(T.body(F.col("t")))
    assert value(spark, T.wikilinks(bare), t=PAGE) == ["Note", "docs/a.md"]
    assert value(spark, T.transclusions(bare), t=PAGE) == ["Embed"]
    assert value(spark, T.inline_tags(bare), t=PAGE) == ["café", "ok"]
    assert value(spark, T.wikilinks(F.col("t")), t="[[]] ![[a]] [[b]]") == ["b"]


@pytest.mark.parametrize(("path", "glob"), [("src/x/a.py", "src/**/*.py"), ("lib/src/x/a.py", "src/**/*.py"), ("src/a.py", "src/**/*.py"), ("src/x/y/a.py", "src/**/*.py"), ("a/b.md", "*.md"), ("a/B.MD", "*.md"), ("a/b.md", "a/?.md"), ("x.py", "[xy].py")])
def test_globs(spark, path, glob):
    expected = PurePosixPath(path).match(glob)
    assert value(spark, F.col("p").rlike(T.glob_pattern(glob)), p=path) == expected
    assert fnmatch.fnmatch("a", "a")


@pytest.mark.parametrize(("path", "want"), [("a/b.md", True), (".git/x.md", False), ("a/.gitignore", False), ("..dots../x.md", False), ("my.folder/x.md", True), ("a\\.b\\c.md", False), ("node_modules/x.md", False)])
def test_accepted(spark, path, want):
    assert value(spark, files.accepted(F.col("p"), [], ["node_modules/*"]), p=path) is want


def test_decoded(spark):
    assert value(spark, T.decoded(F.col("c")), c="é\r\nb\rc".encode()) == "é\nb\nc"
    assert value(spark, T.decoded(F.col("c")), c="é".encode("latin-1")) == "é"


@pytest.mark.parametrize(("q", "kind"), [("getUserById", "factual"), ("snake_case use", "factual"), ("v1.2.3 notes", "factual"), ("install guide", "navigational"), ("see [[Page]]", "navigational"), ("how does it work?", "exploratory"), ("plain", "exploratory")])
def test_query_type(spark, q, kind):
    assert value(spark, T.query_type(F.col("q")), q=q) == kind


def test_trigrams(spark):
    assert value(spark, T.trigrams(F.col("t")), t="AbcabC") == ["abc", "bca", "cab"]
    assert value(spark, T.trigrams(F.col("t")), t="ab") == []


def packed_lines(text, tokens, overlap):
    """The rule of line_chunks as a loop."""
    most, tail = tokens * 3, overlap * 3
    parts = [p for line in text.strip(" \t\r\n").split("\n") for p in ([line[i : i + most] for i in range(0, len(line), most)] or [""])]
    out, held = [], []
    size = lambda xs: sum(map(len, xs)) + max(0, len(xs) - 1)
    for p in parts:
        if held and size(held) + len(p) + 1 > most:
            out.append("\n".join(held))
            back, n = [], 0
            for x in reversed(held) if tail else ():
                if back and n + len(x) > tail:
                    break
                back.insert(0, x)
                n += len(x)
            held = back
        held.append(p)
    out.append("\n".join(held))
    return [c for x in out if (c := x.strip(" \t\r\n"))]


@pytest.mark.parametrize("text", ["", "one", "a\nb\nc", "x" * 100, "word " * 40 + "\n" + "line\n" * 30, "\n\n a \n\n"])
def test_line_chunks(spark, text):
    for tokens, overlap in ((10, 3), (10, 0), (50, 10)):
        assert value(spark, C.line_chunks(F.col("t"), tokens, overlap), t=text) == packed_lines(text, tokens, overlap)


def test_line_chunks_on_documents(spark, folder):
    for r in spark.read.parquet(f"{folder}/documents.parquet").limit(60).select("text", C.line_chunks(F.col("text")).alias("c")).collect():
        assert r["c"] == packed_lines(r["text"], C.TOKENS, C.TOKEN_OVERLAP)


def test_header_chunks(spark):
    page = "intro\n# A\none\n## B\ntwo\n# C\n" + "three " * 10
    rows = C.header_sections(spark.createDataFrame([(1, page)], "k int, t string"), "k", "t").orderBy("section").collect()
    assert [(r["level"], r["header_path"]) for r in rows] == [(0, ""), (1, "A"), (2, "A > B"), (1, "C")]
    merged = C.merged_sections(C.header_sections(spark.createDataFrame([(1, page)], "k int, t string"), "k", "t"), "k", least=20, most=40).orderBy("chunk_index", "sub").collect()
    assert merged[0]["content"].startswith("intro\n\nA\none")
    assert all(len(r["content"]) <= 40 + C.OVERLAP + 2 for r in merged)


def test_parents(spark):
    rows = spark.createDataFrame([(1, i, "x" * 700) for i in range(5)], "k int, i int, t string")
    got = [r["parent_chunk_id"] for r in C.parents(rows, "k", "i", "t").orderBy("i").collect()]
    assert got == ["1_parent_0"] * 3 + ["1_parent_1"] * 2


def test_commit_chunks(spark):
    diff = "diff --git a/x b/x\n+1\ndiff --git a/y b/y\n" + "+line\n" * 400
    rows = spark.createDataFrame([("h", "", "body", "A <a>", "", ["x", "y"], diff)], "hash string, title string, message string, author string, committer string, files_changed array<string>, delta_truncated string")
    got = C.commit_chunks(rows, 100, 10).collect()
    assert got[0]["text"] == "Summary:\n(no commit message)\n\nAuthor: A <a>\n\nFiles changed:\nx\ny"
    assert {r["section"] for r in got} == {"summary", "body", "diff"}
    assert all(r["estimated_tokens"] <= 100 for r in got)
    with pytest.raises(ValueError):
        C.commit_chunks(rows, 10, 10)


def test_git_text(spark):
    assert value(spark, gitlog.message_text(F.col("m")), m="\n \n a  \nb\t\n\n") == " a\nb"
    long = "\n".join(map(str, range(300)))
    short = value(spark, gitlog.truncated(F.col("d")), d=long)
    assert short.split("\n")[199] == "199" and short.endswith("(100 lines omitted)")
