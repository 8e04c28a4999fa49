from __future__ import annotations

import os
import subprocess

import pytest
from pyspark.sql import functions as F

from tidewell.sources import files, gitlog, records


def test_files(spark, tmp_path):
    (tmp_path / "a" / ".hidden").mkdir(parents=True)
    (tmp_path / "a" / "one.md").write_text("---\ntitle: One\ntags: t\n---\n# H\n[[two]] #x\n")
    (tmp_path / "a" / "two.txt").write_bytes("caf\xe9\r\nend".encode("latin-1"))
    (tmp_path / "a" / ".hidden" / "no.md").write_text("no")
    (tmp_path / "skip.md").write_text("no")
    (tmp_path / "odd.bin").write_bytes(b"\0")
    found = files.discover(spark, [str(tmp_path)], exclude=["skip.md"])
    assert sorted(r["file_path"] for r in found.select("file_path").collect()) == ["a/one.md", "a/two.txt", "odd.bin"]
    docs = {r["doc_id"]: r for r in files.parse(found).collect()}
    assert set(docs) == {"a/one", "a/two"}
    assert docs["a/one"]["links"] == ["two"] and docs["a/one"]["tags"] == ["t", "x"] and docs["a/one"]["metadata"]["title"] == "One"
    assert docs["a/two"]["content"] == "café\nend" and docs["a/two"]["metadata"]["encoding"] == "latin-1"
    assert files.failed(found).count() == 1


@pytest.fixture
def repo(tmp_path):
    env = os.environ | {"GIT_AUTHOR_NAME": "A", "GIT_AUTHOR_EMAIL": "a@x", "GIT_COMMITTER_NAME": "C", "GIT_COMMITTER_EMAIL": "c@x", "GIT_CONFIG_GLOBAL": "/dev/null"}
    run = lambda *a, **k: subprocess.run(["git", "-C", str(tmp_path), *a], check=True, capture_output=True, env=env | k)
    run("init", "-q")
    for i in range(3):
        (tmp_path / f"f{i}.txt").write_text(f"text {i}\n" * (300 if i == 2 else 1))
        run("add", ".")
        run("commit", "-q", "-m", f"title {i}\n\nbody é {i}", GIT_AUTHOR_DATE=f"{1700000000 + i * 100} +0000", GIT_COMMITTER_DATE=f"{1700000000 + i * 100} +0000")
    return str(tmp_path)


def test_gitlog(spark, repo):
    rows = gitlog.read(spark, [repo]).orderBy("timestamp").collect()
    assert [r["title"] for r in rows] == ["title 0", "title 1", "title 2"]
    assert rows[1]["message"] == "body é 1" and rows[1]["files_changed"] == ["f1.txt"] and rows[1]["author"] == "A <a@x>"
    assert rows[2]["delta_truncated"].startswith("diff --git") and "lines omitted" in rows[2]["delta_truncated"]
    assert gitlog.read(spark, [repo], since=1700000150).count() == 1
    assert gitlog.tips(repo) == [rows[2]["hash"]]


def test_gitlog_stream(spark, repo, tmp_path_factory):
    import json

    spark.dataSource.register(gitlog.GitLog)
    stream = spark.readStream.format("gitlog").option("repos", json.dumps([repo])).load()
    q = stream.writeStream.format("memory").queryName("commits_seen").option("checkpointLocation", str(tmp_path_factory.mktemp("ck"))).start()
    try:
        q.processAllAvailable()
        assert spark.table("commits_seen").select("hash").distinct().count() == 3
    finally:
        q.stop()


def git(repo, *args, **env):
    import os
    import subprocess

    return subprocess.run(["git", "-C", repo, *args], check=True, capture_output=True, env=os.environ | {"GIT_AUTHOR_NAME": "A", "GIT_AUTHOR_EMAIL": "a@x", "GIT_COMMITTER_NAME": "A", "GIT_COMMITTER_EMAIL": "a@x"} | env).stdout.decode()


def grown(repo, branch, n):
    """So many commits on a branch, made at once."""
    old = git(str(repo), "rev-parse", "-q", "--verify", "HEAD").strip() if (repo / ".git" / "HEAD").exists() and git(str(repo), "for-each-ref") else None
    import subprocess

    lines = []
    for i in range(n):
        lines.append(f"commit refs/heads/{branch}\ncommitter A <a@x> {1700000000 + 1000 * sum(map(ord, branch)) + i} +0000\ndata 3\nm{i % 10}\n\n" + (f"from {old}\n" if i == 0 and old else ""))
    subprocess.run(["git", "-C", str(repo), "fast-import", "--quiet"], input="".join(lines).encode(), check=True)


def test_bounded_places(tmp_path):
    """10,000 commits in batches of 500: none twice, none lost when tips move in between, in order."""
    repo = tmp_path / "r"
    repo.mkdir()
    git(str(repo), "init", "-q", "-b", "main")
    grown(repo, "main", 10_000)
    place, told, steps = None, [], 0
    while steps < 100:
        new, taken = gitlog.moved(place, str(repo), 0, 500)
        if new == place:
            break
        own = gitlog.between(str(repo), 0, place, new)
        assert len(own) == taken <= 500
        told += own
        place, steps = new, steps + 1
        if steps == 3:
            grown(repo, "other", 700)
        if steps == 7:
            git(str(repo), "branch", "again", "other")
            grown(repo, "main2", 300)
    assert len(told) == len(set(told)) == 11_000 and set(told) == set(gitlog.hashes(str(repo)))
    position = {h: i for i, h in enumerate(told)}
    for line in git(str(repo), "rev-list", "--all", "--parents").splitlines():
        child, *parents = line.split()
        assert all(position[p] < position[child] for p in parents)


def test_bounded_stream(spark, tmp_path):
    """A stream with a limit, stopped and begun again, over two repositories."""
    import json

    repos = []
    for name, n in (("a", 23), ("b", 4)):
        (tmp_path / name).mkdir()
        git(str(tmp_path / name), "init", "-q", "-b", "main")
        grown(tmp_path / name, "main", n)
        repos.append(str(tmp_path / name))
    spark.dataSource.register(gitlog.GitLog)
    sizes, seen = [], []

    def batch(rows, number):
        sizes.append(rows.count())
        seen.extend((r["repo"], r["hash"]) for r in rows.select("repo", "hash").collect())

    def run(until):
        stream = spark.readStream.format("gitlog").option("repos", json.dumps(repos)).option("limit", 10).option("position", str(tmp_path / "position")).load()
        q = stream.writeStream.foreachBatch(batch).option("checkpointLocation", str(tmp_path / "ck")).start()
        try:
            for _ in range(240):
                if len(seen) >= until or q.exception():
                    break
                q.awaitTermination(0.25)
            assert q.exception() is None
        finally:
            q.stop()

    run(20)
    grown(tmp_path / "b", "main", 5)
    run(32)
    assert len(seen) == len(set(seen)) == 32 and max(sizes) <= 10
    with pytest.raises(ValueError):
        gitlog._Stream({"repos": "[]", "limit": "5"})


def test_records(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"source_kind":"note","source_id":"1","body":"b","workspace_id":"w","metadata":{"a":"b"}}\n{"source_id":"2"}\nnot json\n')
    good, bad = records.read_json(spark, str(tmp_path / "r.json"))
    assert [r["storage_key"] for r in good.collect()] == ["w|note|1"]
    assert sorted(r["error"] for r in bad.collect()) == ["missing: source_kind, body", "not a JSON object"]


def test_table_order(spark, tmp_path):
    """A stream's batch after a manual write outranks it, and one that comes again does not."""
    t = records.Table(spark, f"file://{tmp_path}/t", ["k"])
    one = lambda v: spark.createDataFrame([(1, v)], "k int, v string")
    held = lambda: [r["v"] for r in t.read().collect()]
    t.upsert(one("stream 0"), "s00000000000000000000")
    t.upsert(one("manual"))
    assert held() == ["manual"]
    last = t.upsert(one("stream 1"), "s00000000000000000001")
    assert held() == ["stream 1"] and t.version() == last
    assert t.upsert(one("stream 0 again"), "s00000000000000000000") < last and held() == ["stream 1"]
    t.delete(spark.createDataFrame([(1,)], "k int"))
    t.upsert(one("stream 1 again"), "s00000000000000000001")
    assert held() == []
    # A batch without a number, as they were before, is older than all.
    one("old").withColumn("_deleted", F.lit(False)).write.parquet(f"{tmp_path}/u/batch=t00000000000000000007-x")
    u = records.Table(spark, f"file://{tmp_path}/u", ["k"])
    assert [r["v"] for r in u.read().collect()] == ["old"]
    u.upsert(one("new"), "s00000000000000000000")
    assert [r["v"] for r in u.read().collect()] == ["new"]


def test_table(spark, tmp_path):
    t = records.Table(spark, f"file://{tmp_path}/t", ["k"])
    assert t.read() is None and t.version() is None
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    first = t.upsert(rows)
    assert t.upsert(spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")) > first
    t.delete(spark.createDataFrame([(1,)], "k int"))
    assert sorted(map(tuple, t.read().select("k", "v").collect())) == [(2, "c"), (3, "d")]
    # Two writers that began with the same rows: neither loses a row. A batch that is written again changes nothing.
    other = records.Table(spark, f"file://{tmp_path}/t", ["k"])
    for _ in range(2):
        t.upsert(spark.createDataFrame([(4, "e")], "k int, v string"), "x1")
        other.upsert(spark.createDataFrame([(5, "f")], "k int, v string"), "x2")
    assert {r["k"] for r in t.read().collect()} == {2, 3, 4, 5}
    small = t.compacted(f"file://{tmp_path}/small")
    assert sorted(map(tuple, small.read().select("k", "v").collect())) == [(2, "c"), (3, "d"), (4, "e"), (5, "f")]


CASES = [
    ("/path/to/file.md", ["**/*"], [], True), ("readme.md", ["**/*"], [], True), ("/project/build/docs/README.md", ["**/*"], ["**/build/**"], False), ("/project/docs/build/api.md", ["**/*.md"], ["**/build/**"], False),
    ("/project/docs/README.md", ["**/*.md"], [], True), ("/project/docs/notes.txt", ["**/*.md"], [], False), ("/p/node_modules/package/index.js", ["**/*"], ["**/build/**", "**/node_modules/**"], False), ("node_modules/z.md", ["**/*"], ["**/node_modules/**"], False),
    ("a/build/b/c/d.md", ["**/*"], ["**/build/**"], False), ("/p/libs/mylib/build/docs/api.md", ["**/*"], ["**/build/**"], False), ("/p/.stversions/file.md", ["**/*"], [], False), ("/p/a/b/.secret/c/d/file.md", ["**/*"], [], False), ("/p/docs/.gitignore", ["**/*"], [], False),
    ("/p/my.folder/file.md", ["**/*"], [], True), ("/p/..dots../file.md", ["**/*"], [], False), ("C:\\project\\.hidden\\file.md", ["**/*"], [], False), ("a/x.md", ["a/*.md"], [], True), ("a/b/x.md", ["a/*.md"], [], False), ("b/skip.md", ["**/*"], ["skip.md"], False), ("a/x1.md", ["a/x[0-9].md"], [], True), ("a/xy.md", ["a/x[!0-9].md"], [], True), ("mybuild/x.md", ["**/*"], ["**/build/**"], True),
]


def test_globs(spark):
    for path, include, exclude, want in CASES:
        frame = spark.createDataFrame([(path,)], "path string")
        assert frame.select(files.accepted(F.col("path"), include, exclude)).first()[0] is want, (path, include, exclude)


def test_odd_commits(spark, repo, tmp_path_factory):
    """Control characters in files and messages, renames, and repositories that are found."""
    env = os.environ | {"GIT_AUTHOR_NAME": "A", "GIT_AUTHOR_EMAIL": "a@x", "GIT_COMMITTER_NAME": "C", "GIT_COMMITTER_EMAIL": "c@x", "GIT_CONFIG_GLOBAL": "/dev/null"}
    run = lambda *a: subprocess.run(["git", "-C", repo, *a], check=True, capture_output=True, env=env)
    with open(f"{repo}/odd.txt", "w") as f:
        f.write("a \x1e b \x1f c \x01 diff --git\n")
    run("add", ".")
    run("commit", "-q", "-m", "odd \x1e title\n\n:body\twith \x1f signs")
    run("mv", "f0.txt", "g0.txt")
    run("commit", "-q", "-m", "moved")
    rows = {r["title"]: r for r in gitlog.read(spark, [repo]).collect()}
    assert len(rows) == 5 and rows["odd \x1e title"]["files_changed"] == ["odd.txt"] and "\x1f c" in rows["odd \x1e title"]["delta_truncated"]
    assert sorted(rows["moved"]["files_changed"]) == ["f0.txt", "g0.txt"]
    listed = gitlog.hashes(repo)
    keep = gitlog.BATCH
    assert [c[1] for c in gitlog.commits(repo, listed)] == listed and keep == 32
    root = tmp_path_factory.mktemp("roots")
    for name in ("a/.git", "b/c/.git", "a/inner/.git", ".hidden/.git", "build/.git"):
        (root / name).mkdir(parents=True)
    found = [os.path.relpath(r, root) for r in gitlog.discover([str(root), str(root / "b")], ["**/build/**"])]
    assert found == ["a", "b/c"] and gitlog.discover([repo]) == [os.path.realpath(repo)]


def test_late_commits(spark, repo, tmp_path_factory):
    """A commit that becomes reachable later, with a time before all others, is read by the stream."""
    import json

    spark.dataSource.register(gitlog.GitLog)
    at = str(tmp_path_factory.mktemp("late"))
    frame = spark.readStream.format("gitlog").option("repos", json.dumps([repo])).load()

    def drain():
        frame.writeStream.format("parquet").option("path", f"{at}/out").option("checkpointLocation", f"{at}/ck").trigger(availableNow=True).start().awaitTermination(120)
        return [r["title"] for r in spark.read.parquet(f"{at}/out").collect()]

    assert len(drain()) == 3
    env = os.environ | {"GIT_AUTHOR_NAME": "A", "GIT_AUTHOR_EMAIL": "a@x", "GIT_COMMITTER_NAME": "C", "GIT_COMMITTER_EMAIL": "c@x", "GIT_CONFIG_GLOBAL": "/dev/null", "GIT_AUTHOR_DATE": "1600000000 +0000", "GIT_COMMITTER_DATE": "1600000000 +0000"}
    subprocess.run(["git", "-C", repo, "commit", "-q", "--allow-empty", "-m", "late"], check=True, capture_output=True, env=env)
    assert sorted(drain()) == ["late", "title 0", "title 1", "title 2"]


def test_yaml(spark):
    matter = "title: 5\ndate: 2024-01-02\nnested:\n  a: [1, true]\nkeywords: [x, 2]\ntags: [t]\n"
    rows = spark.createDataFrame([(1, matter), (2, "- a list"), (3, "bad: [1"), (4, None)], "k long, m string")
    got = {r["k"]: r["fields"] for r in files.yaml_fields(rows, "k", "m").collect()}
    assert got[1] == '{"date": "2024-01-02", "keywords": ["x", "2"], "nested": {"a": [1, true]}, "title": "5"}'
    assert got[2] == got[3] == got[4] == "{}"


def test_link_headings(spark):
    page = "[[zero]]\n# One é\n[[a]] ![[no]]\n```\n# code [[no]]\n```\n## Two ##\ntext [[b|B]] and [[c]]"
    got = files.links_with_context(spark.createDataFrame([(1, page), (2, "none")], "k long, t string"), "k", "t")
    assert [(r["target"], r["header"]) for r in got.collect()][:2] == [("zero", ""), ("a", "One é")] and got.count() == 4
