"""From folders to an index, also when a run is killed between commits."""

from __future__ import annotations

import os

import pytest

from tidewell.plans.ingest import ingest
from tidewell.plans.search import Index, Request

FILES = {
    "notes/a.md": "---\ntitle: A\nauthor: Ann\ntags: [sea]\n---\n# Tides\n\nThe moon pulls the sea. See [[b]] and [gone](none.md).\n\n## See also\n\n[[sub/c]]\n",
    "notes/b.md": "# Boats\n\n```\n# no heading\n```\nBoats wait in the harbour for high water and the moon.\n",
    "notes/sub/c.md": "# Compost\n\nCompost needs air and brown leaves.\n",
    "notes/d.txt": "Plain text about worms.",
    "more/a.md": "# Other\n\nAnother A, about masts and the moon.\n",
    "more/empty.md": "",
    "more/skip.bin": "binary",
}


def written(at, files):
    for name, text in files.items():
        (at / name).parent.mkdir(parents=True, exist_ok=True)
        (at / name).write_text(text)


def told(index):
    rows = index.records.select("doc_id", "title", "body", "header_path", "project", "author", "tags").collect()
    keys = {r["key"]: r["doc_id"] for r in index.records.select("key", "doc_id").collect()}
    edges = sorted((keys[r["src"]], keys[r["dst"]]) for r in index.edges.collect()) if index.edges is not None else []
    found = [r["doc_id"] for r in index.query_documents("moon harbour", Request(top_n=10)).collect()]
    return sorted(map(str, rows)), edges, sorted(r["doc_id"] for r in index.files.collect()), found, index.stats


class Killed(Exception):
    pass


def test_ingest(spark, tmp_path):
    written(tmp_path, FILES)
    roots = {"n": str(tmp_path / "notes"), "m": str(tmp_path / "more")}
    whole = told(ingest(spark, roots, str(tmp_path / "whole")))
    assert whole[1] == [("n/a.md", "n/b.md"), ("n/a.md", "n/sub/c.md")]
    assert whole[2] == ["m/a.md", "n/a.md", "n/b.md", "n/d.txt", "n/sub/c.md"]
    assert whole[3][0] == "n/b.md" and any("no heading" in r and "Boats" in r for r in whole[0])

    # Killed after every commit, and begun again, until nothing is left.
    at, times = str(tmp_path / "killed"), 0
    while True:

        def kill(index, left):
            raise Killed

        try:
            index = ingest(spark, roots, at, most=2, vectors=False, between=kill)
            break
        except Killed:
            times += 1
            assert times < 20
    assert times > 1 and told(index) == whole
    number = index.manifest.number
    assert ingest(spark, roots, at).manifest.number == number  # nothing changed, nothing is written

    # Changed, new and removed files; a link that led nowhere finds its file.
    written(tmp_path, {"notes/none.md": "# None\n\nNow here.\n", "notes/b.md": "# Boats\n\nBoats left.\n"})
    os.utime(tmp_path / "notes" / "b.md", (2_000_000_000, 2_000_000_000))
    (tmp_path / "notes" / "sub" / "c.md").unlink()
    after, anew = ingest(spark, roots, at), ingest(spark, roots, str(tmp_path / "anew"))
    assert told(after) == told(anew) and told(after)[1] == [("n/a.md", "n/b.md"), ("n/a.md", "n/none.md")]
    assert {r["doc_id"] for r in after.records.select("doc_id").collect()} == {"n/a.md", "n/b.md", "n/d.txt", "n/none.md", "m/a.md"}


def test_killed_before_the_commit(spark, tmp_path, monkeypatch):
    """Tables that no manifest names are as if they were not."""
    written(tmp_path, FILES)
    roots = {"n": str(tmp_path / "notes")}
    with monkeypatch.context() as m:
        m.setattr("tidewell.sources.store.Store._put", lambda *_: (_ for _ in ()).throw(Killed()))
        with pytest.raises(Killed):
            ingest(spark, roots, str(tmp_path / "i"))
    index = ingest(spark, roots, str(tmp_path / "i"))
    assert index.files.count() == 4 and Index.open(spark, str(tmp_path / "i")).records.count() == index.records.count()
