from __future__ import annotations

import subprocess

import pytest
from pyspark.sql import functions as F

from tidewell import config
from tidewell.operators import projects as P
from tidewell.sources import gitlog as G


def test_names(spark):
    rows = spark.createDataFrame([(1, "a b"), (2, "a-b"), (3, "é"), (4, "a/b/")], "k int, n string")
    assert {r["k"]: r["name"] for r in P.unique_names(rows, "k", "n").collect()} == {1: "a-b", 2: "a-b-2", 3: "project", 4: "a-b-3"}
    assert [r[0] for r in rows.select(P.valid_name(F.col("n"))).collect()] == [False, True, False, False]


def test_warnings(spark):
    roots = spark.createDataFrame([("a", "/x", "g"), ("b", "/x/y", "g"), ("c", "/", None), ("d", "/xy", "h")], "name string, root string, repository string")
    got = sorted(map(tuple, P.warnings(roots, "name", "root", "repository", "/home/me").collect()))
    assert got == [("a", "shares g"), ("b", "inside a"), ("b", "shares g"), ("c", "unsafe root")]


def test_detected(spark):
    roots = spark.createDataFrame([("a", "/x", "g"), ("b", "/x/y", None)], "project string, root string, repository string")
    places = spark.createDataFrame([("/x/y/z.md", None, None), ("/x/q.md", None, None), ("/else", "b", None), ("/copy/q.md", None, "g"), ("/no", None, None)], "place string, named string, repository string")
    got = {r["place"]: r["project"] for r in P.detected(places, roots, "place").collect()}
    assert got == {"/x/y/z.md": "b", "/x/q.md": "a", "/else": "b", "/copy/q.md": "a", "/no": None}


def test_main_copy(spark):
    rows = spark.createDataFrame([("g", "/w/feature", "f"), ("g", "/w/main", "x"), ("h", "/w/b", "main"), ("h", "/w/a", "x")], "repository string, root string, branch string")
    assert {r["repository"]: r["root"] for r in P.main_copy(rows, "repository", "root", "branch").collect()} == {"g": "/w/main", "h": "/w/b"}


def test_places_that_are_asked_for(spark):
    """By name, by root, within a root, or as a transient project with a name of its own; a name that is nothing gives null."""
    roots = spark.createDataFrame([("a", "/x", None), ("y", "/x/y", None), ("new", "/n", None)], "project string, root string, repository string")
    rows = [("/x/1", "y", False), ("/x/2", "/x/y/", True), ("/x/3", "/x/y/deep", True), ("/x/4", "/tmp/new", True), ("/x/5", "/else/new", True), ("/x/6", "nothing", False), ("/x/7", "", True), ("/x/8", None, None), ("/q", "/x", False)]
    got = {r["place"]: r["project"] for r in P.detected(spark.createDataFrame(rows, "place string, named string, exists boolean"), roots, "place").collect()}
    assert got == {"/x/1": "y", "/x/2": "y", "/x/3": "y", "/x/4": "new-3", "/x/5": "new-2", "/x/6": None, "/x/7": "a", "/x/8": "a", "/q": "a"}


def test_working_copies(spark, tmp_path):
    """Copies as git lists them; with neither names nor branches to choose by, the branch of HEAD and the place decide."""
    git = lambda *a: subprocess.run(["git", "-C", str(tmp_path / "one"), "-c", "user.name=n", "-c", "user.email=n@n", *a], check=True, capture_output=True)
    (tmp_path / "one").mkdir()
    git("init", "-q", "-b", "trunk")
    git("commit", "-q", "--allow-empty", "-m", "first")
    git("worktree", "add", "-q", "-b", "topic", str(tmp_path / "a topic"))
    git("worktree", "add", "-q", "--detach", str(tmp_path / "bare"))
    (tmp_path / "bare" / "in").mkdir()
    places = spark.createDataFrame([(str(tmp_path / "bare" / "in"),), (str(tmp_path),), ("/nowhere",), (None,)], "place string")
    found = G.worktrees(places, "place")
    got = {r["root"].rsplit("/", 1)[1]: (r["branch"], r["head"], r["current"]) for r in found.collect()}
    assert got == {"one": ("trunk", "trunk", False), "a topic": ("topic", "trunk", False), "bare": (None, "trunk", True)}
    assert P.main_copy(found, "repository", "root", "branch").first()["root"].endswith("/one")
    # Without a branch that is preferred the place's own copy comes before the first by path.
    assert P.main_copy(found.withColumn("head", F.lit(None).cast("string")), "repository", "root", "branch").first()["root"].endswith("/bare")


def test_registered(tmp_path):
    at = tmp_path / "deep" / "config.toml"
    assert [p.name for p in config.registered(at, "a", "/x").projects] == ["a"]
    at.write_text("# mine\n[search]\nsemantic_weight = 0.5 # half\n\n" + at.read_text().rstrip("\n"))
    assert [(p.name, p.path) for p in config.registered(at, "b", '/y "q" \\ é\x7f').projects] == [("a", "/x"), ("b", '/y "q" \\ é\x7f')]
    before = at.read_text()
    assert before.startswith("# mine\n[search]\nsemantic_weight = 0.5 # half\n") and config.load(at).search.semantic_weight == 0.5
    assert len(config.registered(at, "a", "/other").projects) == len(config.registered(at, "c", "/x").projects) == 2 and at.read_text() == before
    with pytest.raises(ValueError):
        config.registered(at, "not a name", "/z")
    at.write_text("projects = []\n")
    with pytest.raises(ValueError):
        config.registered(at, "d", "/d")
    assert at.read_text() == "projects = []\n" and [p.name for p in at.parent.iterdir()] == ["config.toml"]


def test_scope():
    assert P.allowed_projects(None, ["a"]) == ["a"] and P.allowed_projects(["a", "b"], []) == ["a", "b"]
    with pytest.raises(PermissionError):
        P.allowed_projects(["a"], ["b"])
