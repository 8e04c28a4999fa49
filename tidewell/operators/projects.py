"""Projects and their roots: names, duplicates, nesting, the project of a place, the main copy of a repository."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def valid_name(name: Column) -> Column:
    return name.rlike("^[A-Za-z0-9_-]+$")


def unique_names(rows: DataFrame, key: str, wanted: str) -> DataFrame:
    """key and name: other signs become hyphens; the second of equal names gets -2, the third -3, by key."""
    clean = F.regexp_replace(F.regexp_replace(F.col(wanted), "[^A-Za-z0-9_-]+", "-"), "^-+|-+$", "")
    clean = F.when(clean == "", "project").otherwise(clean)
    n = F.row_number().over(Window.partitionBy("clean").orderBy(key))
    named = rows.select(key, clean.alias("clean")).withColumn("n", n)
    return named.select(key, F.when(F.col("n") == 1, F.col("clean")).otherwise(F.concat("clean", F.lit("-"), F.col("n").cast("string"))).alias("name"))


def duplicates(rows: DataFrame, by: str, key: str) -> DataFrame:
    """Values that several rows share, with those rows' keys."""
    return rows.groupBy(by).agg(F.array_sort(F.collect_list(key)).alias("keys")).where(F.size("keys") > 1)


def ancestors(path: Column) -> Column:
    """The folders above a path, from the top."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))


def nested(roots: DataFrame, name: str, root: str) -> DataFrame:
    """outer and inner: pairs of roots one of which lies in the other. Joined by ancestors, so roots may be many."""
    inner = roots.select(F.col(name).alias("inner"), F.col(root).alias("_path"), F.explode(ancestors(F.col(root))).alias("_up")).where("_up <> _path")
    return inner.join(roots.select(F.col(name).alias("outer"), F.col(root).alias("_up")), "_up").select("outer", "inner")


def warnings(roots: DataFrame, name: str, root: str, repository: str, home: str) -> DataFrame:
    """name and warning: unsafe roots, nested ones, and several projects in one repository."""
    unsafe = roots.where(F.col(root).isin("", "/", home)).select(name, F.lit("unsafe root").alias("warning"))
    inside = nested(roots, name, root).select(F.col("inner").alias(name), F.concat(F.lit("inside "), "outer").alias("warning"))
    shared = duplicates(roots.where(F.col(repository).isNotNull()), repository, name).select(F.explode("keys").alias(name), F.concat(F.lit("shares "), repository).alias("warning"))
    return unsafe.unionByName(inside).unionByName(shared)


def detected(places: DataFrame, roots: DataFrame, place: str) -> DataFrame:
    """Project of each place: that in whose deepest root it lies, or else one of the same repository. Where a place asks for one,
    the project of that name, at exactly that root, or in whose deepest root it lies; and else a transient one.

    places: place, and optional columns `named` (a name or path that is asked for), `exists` (whether that path does) and
    `repository`; roots: project, root, and `repository`. A transient project is called as the path's last part, apart from
    all projects that there are; a name that is no project and no path that exists gives null. Empty names ask for nothing."""
    from .state import deepest_root

    out = deepest_root(places, roots.select("project", "root"), place).withColumnRenamed("project", "_inside")
    own = ["_inside"]
    if "repository" in places.columns:
        out = out.join(roots.where("repository is not null").groupBy("repository").agg(F.min("project").alias("_same")), "repository", "left")
        own.append("_same")
    if "named" not in places.columns:
        return out.withColumn("project", F.coalesce(*own)).drop(*own)
    asked = F.coalesce("named", F.lit("")) != ""
    bare = F.when(F.col("named").rlike("^/+$"), "/").otherwise(F.regexp_replace("named", "/+$", ""))
    names = roots.select(F.col("project").alias("named"), F.col("project").alias("_named")).distinct()
    paths = deepest_root(places.where(asked).select(bare.alias("_path")).distinct(), roots.select("project", "root"), "_path").withColumnRenamed("project", "_at")
    out = out.join(names, "named", "left").withColumn("_path", bare).join(paths, "_path", "left")
    found = F.coalesce("_named", "_at")
    if "exists" in places.columns:
        # Projects come before paths, so that theirs are the names without a number.
        fresh = out.where(asked & found.isNull() & F.col("exists")).select(F.lit(1).alias("_new"), F.col("_path").alias("_key"), F.substring_index("_path", "/", -1).alias("_wanted")).distinct()
        taken = roots.select(F.lit(0).alias("_new"), F.col("project").alias("_key"), F.col("project").alias("_wanted")).distinct()
        called = unique_names(taken.unionByName(fresh).withColumn("_order", F.struct("_new", "_key")), "_order", "_wanted").where("_order._new = 1")
        out = out.join(called.select(F.col("_order._key").alias("_path"), F.col("name").alias("_transient")), "_path", "left")
        found = F.coalesce(found, F.when(F.col("exists"), F.col("_transient")))
    out = out.withColumn("project", F.when(asked, found).otherwise(F.coalesce(*own)))
    return out.select(*places.columns, "project")


def main_copy(copies: DataFrame, repository: str, root: str, branch: str, preferred: str = "main") -> DataFrame:
    """One root of each repository: called main or master, on such a branch, on the preferred one or called as it, the one that
    is looked from, or the first by path.

    The preferred branch is that of the column `head` where there is one, as `gitlog.worktrees` reads it; `current` marks
    the root that is looked from."""
    last = F.substring_index(root, "/", -1)
    wanted = F.col("head") if "head" in copies.columns else F.lit(preferred)
    current = F.coalesce(F.col("current"), F.lit(False)) if "current" in copies.columns else F.lit(False)
    on = F.coalesce(F.col(branch) == wanted, F.lit(False)) | F.coalesce(last == wanted, F.lit(False))
    order = F.struct(~last.isin("main", "master"), ~F.coalesce(F.col(branch).isin("main", "master"), F.lit(False)), ~on, ~current, F.col(root))
    return copies.groupBy(repository).agg(F.min_by(root, order).alias(root))


def index_state(records: Column, found: Column, running: Column, failed: Column) -> Column:
    return F.when(failed, "failed").when(running, "indexing").when(records == 0, "uninitialized").when(records < found, "partial").otherwise("ready")


def allowed_projects(claimed: list[str] | None, requested: list[str]) -> list[str]:
    """Projects that a caller may search: its claim bounds the request; a request beyond it is refused."""
    if claimed is None:
        return requested
    if beyond := sorted(set(requested) - set(claimed)):
        raise PermissionError(f"not allowed: {', '.join(beyond)}")
    return requested or claimed


def registration(places: DataFrame, roots: DataFrame, unsafe: list[str]) -> DataFrame:
    """place, reason and project: what registering a place as a project's root would mean.

    places: place; roots: project, root. Unsafe roots are refused first; then a place may be registered already, lie inside
    a registered root (the deepest is told), or hold one; else it is new and gets a name of its own."""
    from .state import deepest_root

    rows = places.select("place").distinct()
    exact = roots.select(F.col("root").alias("place"), F.col("project").alias("_exact"))
    inside = deepest_root(rows, roots.select("project", "root"), "place").select("place", F.col("project").alias("_inside"))
    holds = roots.select(F.explode(ancestors(F.col("root"))).alias("place"), F.col("root")).where("place <> root").select("place", F.lit(True).alias("_holds")).distinct()
    rows = rows.join(exact, "place", "left").join(inside, "place", "left").join(holds, "place", "left")
    reason = F.when(F.col("place").isin(unsafe), "unsafe_root").when(F.col("_exact").isNotNull(), "already_registered").when(F.col("_inside").isNotNull(), "inside_registered_project").when(F.col("_holds"), "contains_registered_project").otherwise("registered")
    rows = rows.withColumn("reason", reason)
    taken = roots.select(F.col("root").alias("_key"), F.col("project").alias("_wanted"), F.lit(0).alias("_new"))
    fresh = rows.where("reason = 'registered'").select(F.col("place").alias("_key"), F.substring_index("place", "/", -1).alias("_wanted"), F.lit(1).alias("_new"))
    named = unique_names(taken.unionByName(fresh).withColumn("_order", F.struct("_new", "_key")), "_order", "_wanted").where("_order._new = 1").select(F.col("_order._key").alias("place"), F.col("name").alias("_name"))
    known = F.when(F.col("reason").isin("already_registered", "inside_registered_project"), F.coalesce("_exact", "_inside")).when(F.col("reason") == "registered", F.col("_name"))
    return rows.join(named, "place", "left").select("place", "reason", known.alias("project"))


def rebuild_scope(descriptions: DataFrame, roots: list[str]) -> DataFrame:
    """Documents of an index whose file lies under one of the roots, which are to be built anew."""
    inside = F.lit(False)
    for r in roots:
        inside = inside | (F.col("file_path") == r.rstrip("/")) | F.startswith("file_path", F.lit(r.rstrip("/") + "/"))
    return descriptions.where(inside)
