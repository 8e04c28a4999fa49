"""Commits of Git repositories as a data source: spark.read.format("gitlog").option("repos", ...).

The driver lists hashes; tasks read COMMITS_A_TASK of them each, oldest first; `since` (seconds) leaves out older
commits. As a stream, an offset holds the tips of every repository's refs, so a commit is read once it can be reached,
whatever its time says; with a limit it holds a place on the way there.
"""

from __future__ import annotations

import json
import os
import re
import subprocess
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "repo string, hash string, timestamp long, author string, committer string, title string, message string, files_changed array<string>, delta string"
#: Lines of a diff that are kept.
DELTA_LINES = 200
#: Commits that one call of git shows, and that a task reads.
BATCH, COMMITS_A_TASK = 32, 2048
#: Fields end with NUL, which no name or message holds; a record begins with NUL, the next control and a hash.
FORMAT = "%x00%x01%H%x00%ct%x00%an <%ae>%x00%cn <%ce>%x00%s%x00%b%x00"
RECORD = re.compile(r"\x00\x01(?=[0-9a-f]{40,64}\x00\d+\x00)")


def _git(repo: str, *args: str) -> str:
    return subprocess.run(["git", "-C", repo, *args], capture_output=True, check=True).stdout.decode("utf-8", "replace")


def discover(roots: list[str], exclude: list[str] | None = None, hidden: bool = False) -> list[str]:
    """Repositories under the roots, sorted, each once; none is looked for inside another. exclude: globs of folders."""
    from ..functions.text import path_glob

    patterns = [re.compile(path_glob(g)) for g in exclude or []]
    found = set()
    for root in roots:
        for folder, inner, _ in os.walk(root):
            # A folder matches as itself, or as all that lies below it.
            left_out = lambda d: any(p.search(d) or p.search(d + "/x") for p in patterns)
            if ".git" in inner:
                if not left_out(folder):
                    found.add(os.path.realpath(folder))
                inner.clear()
            inner[:] = [d for d in inner if not left_out(os.path.join(folder, d)) and (hidden or not d.startswith("."))]
    return sorted(found)


def tips(repo: str) -> list[str]:
    """What the refs and HEAD point to."""
    refs = _git(repo, "for-each-ref", "--format=%(objectname)").split()
    head = subprocess.run(["git", "-C", repo, "rev-parse", "-q", "--verify", "HEAD"], capture_output=True, check=False).stdout.decode().split()
    return sorted({*refs, *head})


def hashes(repo: str, since: int = 0, end: list[str] | None = None, start: list[str] | None = None) -> list[str]:
    """Commits that can be reached from the tips `end`, or from any ref, and not from `start`; oldest first."""
    end = tips(repo) if end is None else end
    after = [f"--after={since}"] if since else []
    return _git(repo, "rev-list", "--reverse", "--ignore-missing", *after, *end, *(["--not", *start] if start else [])).split() if end else []


def _parsed(repo: str, record: str) -> tuple:
    sha, ts, author, committer, title, message, rest = record.split("\x00", 6)
    at = min((rest.find(m) for m in ("\ndiff --git ", "\ndiff --cc ") if m in rest), default=-1)
    listed = rest if at < 0 else rest[:at]
    files = [line.split("\t")[-1] for line in listed.split("\n") if line.startswith(":") and "\t" in line]
    return repo, sha, int(ts), author, committer, title, message, files, rest[at + 1 :] if at >= 0 else ""


def _shown(repo: str, listed: list[str]) -> str:
    return _git(repo, "show", "--raw", "-p", "-m", "--first-parent", "--no-renames", f"--format={FORMAT}", *listed)


def commits(repo: str, listed: list[str]) -> Iterator[tuple]:
    """The commits of these hashes, in order. A call that fails, or whose records are not those asked for as a diff looks
    like one, is made again for each commit."""
    for i in range(0, len(listed), BATCH):
        some = listed[i : i + BATCH]
        try:
            records = RECORD.split(_shown(repo, some))[1:]
        except subprocess.CalledProcessError:
            records = []
        if [r[: r.find("\x00")] for r in records] != some:
            records = [RECORD.split(_shown(repo, [sha]), maxsplit=1)[1] for sha in some]
        for record in records:
            yield _parsed(repo, record)


class _Some(InputPartition):
    def __init__(self, repo: str, listed: list[str]):
        self.repo, self.listed = repo, listed


def _dealt(repo: str, listed: list[str]) -> list[InputPartition]:
    return [_Some(repo, listed[i : i + COMMITS_A_TASK]) for i in range(0, len(listed), COMMITS_A_TASK)]


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.repos, self.since = json.loads(options["repos"]), int(options.get("since", 0))

    def partitions(self) -> list[InputPartition]:
        return [p for r in self.repos for p in _dealt(r, hashes(r, self.since))] or [_Some("", [])]

    def read(self, partition: _Some) -> Iterator[tuple]:
        return commits(partition.repo, partition.listed)


#: Where a repository's stream stands: what can be reached from `from` is done, and of the further commits of `to` the first `at`.
NOTHING = {"from": [], "to": [], "at": 0}


def _ended(place: dict) -> bool:
    return place["from"] == place["to"]


def moved(place: dict | None, repo: str, since: int, most: int) -> tuple[dict, int]:
    """The place up to `most` commits on, and how many these are. Tips are looked at anew only once those before are done,
    so commits come in order, and none twice or never, however the tips move."""
    place = place or NOTHING
    to = tips(repo) if _ended(place) else place["to"]
    total = len(hashes(repo, since, to, place["from"]))
    at = min(total, place["at"] + max(0, most))
    return ({"from": to, "to": to, "at": 0} if at == total else {"from": place["from"], "to": to, "at": at}), at - min(total, place["at"])


def between(repo: str, since: int, start: dict | None, end: dict) -> list[str]:
    """The commits between two places."""
    start = start or NOTHING
    listed = hashes(repo, since, end["to"], start["to"] if _ended(start) else start["from"])
    return listed[0 if _ended(start) else start["at"] : len(listed) if _ended(end) else end["at"]]


class _Stream(DataSourceStreamReader):
    """Without a limit an offset holds tips, and a batch all new commits. With `limit`, a batch has so many at most, of all
    repositories together; the last planned place is kept in the file `position`, as Spark tells a Python source neither
    a limit nor where it stands. A batch that Spark makes again has the same commits."""

    def __init__(self, options: dict[str, str]):
        self.repos, self.since = json.loads(options["repos"]), int(options.get("since", 0))
        self.limit, self.position = int(options.get("limit", 0)), options.get("position")
        if self.limit and not self.position:
            raise ValueError("a limit needs a file for the position")

    def initialOffset(self) -> dict:  # noqa: N802
        return {}

    def latestOffset(self) -> dict:  # noqa: N802
        if not self.limit:
            return {r: tips(r) for r in self.repos}
        try:
            with open(self.position) as f:
                places = json.load(f)
        except FileNotFoundError:
            places = {}
        left = self.limit
        for r in self.repos:
            if left > 0:
                places[r], taken = moved(places.get(r), r, self.since, left)
                left -= taken
        return places

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        if not self.limit:
            return [p for r in end for p in _dealt(r, hashes(r, self.since, end[r], start.get(r)))]
        # What is planned here is done, or planned again, before the next offset is asked for.
        draft = f"{self.position}.{os.getpid()}"
        with open(draft, "w") as f:
            json.dump(end, f)
        os.replace(draft, self.position)
        return [p for r in end for p in _dealt(r, between(r, self.since, start.get(r), end[r]))]

    def read(self, partition: _Some) -> Iterator[tuple]:
        return commits(partition.repo, partition.listed)


class GitLog(DataSource):
    @classmethod
    def name(cls) -> str:
        return "gitlog"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: N802
        return _Stream(self.options)


def read(spark: SparkSession, repos: list[str], since: int = 0) -> DataFrame:
    spark.dataSource.register(GitLog)
    return cleaned(spark.read.format("gitlog").option("repos", json.dumps(repos)).option("since", since).load())


def _copies(place: str) -> list[tuple]:
    """(repository, root, branch, head, current) of all working copies of the repository that a place lies in."""
    told = lambda *args: subprocess.run(["git", "-C", place, *args], capture_output=True, check=False).stdout.decode(errors="replace").rstrip("\n")
    if not os.path.isdir(place) or not (common := told("rev-parse", "--path-format=absolute", "--git-common-dir")):
        return []
    own = os.path.realpath(told("rev-parse", "--show-toplevel") or place)
    # HEAD of the common folder, whatever the copies are on.
    head = subprocess.run(["git", f"--git-dir={common}", "symbolic-ref", "-q", "--short", "HEAD"], capture_output=True, check=False).stdout.decode().strip() or None
    out = []
    for block in told("worktree", "list", "--porcelain", "-z").split("\0\0"):
        fields = dict(line.partition(" ")[::2] for line in block.split("\0") if line)
        root = fields.get("worktree")
        if root is None or "bare" in fields or "prunable" in fields or not os.path.isdir(root):
            continue
        root = os.path.realpath(root)
        branch = fields.get("branch", "").removeprefix("refs/heads/") or None
        out.append((os.path.realpath(common), root, branch, head, root == own))
    return out


def worktrees(places: DataFrame, place: str) -> DataFrame:
    """place, repository (its common git folder), root, branch, head (the branch that the common folder is on) and current
    (whether the place lies in it) of every working copy of each place's repository; detached copies have no branch.
    Copies whose folder is gone are left out, and places outside repositories have none. Read by git in tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(p, *c) for p in batch.column(0).to_pylist() if p for c in _copies(p)]
            types = [pa.string()] * 5 + [pa.bool_()]
            columns = zip(*rows, strict=True) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], [place, "repository", "root", "branch", "head", "current"])

    return places.select(F.col(place).cast("string").alias(place)).distinct().mapInArrow(run, f"{place} string, repository string, root string, branch string, head string, current boolean")


def message_text(message: Column) -> Column:
    """Without blank lines at the start, blanks at line ends, and white space at the end."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(message, r"^(?:[ \t]*\n)+", ""), r"(?m)[ \t]+$", ""), r"\s+$", "")


def truncated(delta: Column, lines: int = DELTA_LINES) -> Column:
    """The first lines, and how many are omitted."""
    parts = F.split(delta, "\n")
    return F.when(F.size(parts) > lines, F.concat(F.array_join(F.slice(parts, 1, lines), "\n"), F.lit("\n... ("), (F.size(parts) - lines).cast("string"), F.lit(" lines omitted)"))).otherwise(delta)


def cleaned(rows: DataFrame) -> DataFrame:
    return rows.withColumn("message", message_text(F.col("message"))).withColumn("delta_truncated", truncated(F.col("delta"))).drop("delta").withColumn("committed_at", F.timestamp_seconds("timestamp"))
