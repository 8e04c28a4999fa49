"""Chunks: by headings, by paragraphs, by lines under a token budget, with overlap and parents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.markdown import read_sections
from ..functions.text import CHARS_A_TOKEN, estimated_tokens

#: Characters of a chunk, of the overlap of forced splits, and of a parent.
LEAST, MOST, OVERLAP, PARENT_LEAST, PARENT_MOST = 1000, 3000, 200, 1500, 4000
#: What ends a line.
LINE_END = "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
#: Tokens of a commit chunk and of its overlap.
TOKENS, TOKEN_OVERLAP = 448, 32


def packed(parts: Column, most: int, join: str) -> Column:
    """Neighbouring parts joined up to `most` characters; a longer part stands alone."""
    empty = F.struct(F.array().cast("array<string>").alias("done"), F.lit(None).cast("string").alias("open"))

    def step(acc: Column, part: Column) -> Column:
        fits = F.length(acc["open"]) + len(join) + F.length(part) <= most
        return F.when(acc["open"].isNull(), F.struct(acc["done"].alias("done"), part.alias("open"))).when(fits, F.struct(acc["done"].alias("done"), F.concat(acc["open"], F.lit(join), part).alias("open"))).otherwise(
            F.struct(F.concat(acc["done"], F.array(acc["open"])).alias("done"), part.alias("open"))
        )

    return F.aggregate(parts, empty, step, lambda acc: F.concat(acc["done"], F.filter(F.array(acc["open"]), lambda x: x.isNotNull())))


def split_long(text: Column, most: int) -> Column:
    """Pieces of up to `most` characters; one empty piece of an empty text."""
    return F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.length(text) / most) - 1, F.lit(0)).cast("int")), lambda i: F.substring(text, i * most + 1, F.lit(most)))


def paragraphs(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"\n\s*\n"), lambda p: F.trim(p, F.lit(" \t\r\n"))), lambda p: p != "")


def paragraph_chunks(rows: DataFrame, key: str, text: str, most: int = MOST) -> DataFrame:
    """key, chunk_index, chunk_id and content: paragraphs packed up to `most` characters."""
    pieces = F.flatten(F.transform(paragraphs(F.col(text)), lambda p: split_long(p, most)))
    out = rows.select(key, F.posexplode(packed(pieces, most, "\n\n")).alias("chunk_index", "content"))
    return out.withColumn("chunk_id", F.concat(F.col(key).cast("string"), F.lit("_chunk_"), F.col("chunk_index").cast("string")))


def windows(text: Column, size: int, overlap: int) -> Column:
    """Pieces of `size` characters, each with the last `overlap` of the one before; the last may be shorter. None of an empty text."""
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and under the size of a window")
    step = size - overlap
    starts = F.sequence(F.lit(0), F.greatest(F.ceil((F.length(text) - overlap) / step).cast("int") - 1, F.lit(0)))
    return F.when(F.length(text) > 0, F.transform(starts, lambda i: F.substring(text, i * step + 1, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def sentences(text: Column, most: int = MOST) -> Column:
    """Sentences, which end with a sign and white space, packed up to `most` characters."""
    parts = F.filter(F.transform(F.split(text, r"(?<=[.!?…。！？])\s+"), lambda x: F.trim(x, F.lit(" \t\r\n"))), lambda x: x != "")
    return packed(F.flatten(F.transform(parts, lambda x: split_long(x, most))), most, " ")


def line_chunks(text: Column, tokens: int = TOKENS, overlap: int = TOKEN_OVERLAP) -> Column:
    """Lines packed into chunks of tokens * CHARS_A_TOKEN characters; each begins with the last lines of the one before,
    as many as the overlap holds and one at least."""
    most, tail = tokens * CHARS_A_TOKEN, overlap * CHARS_A_TOKEN
    lines = F.flatten(F.transform(F.split(F.trim(text, F.lit(" \t\r\n")), LINE_END), lambda x: split_long(x, most)))
    none = F.array().cast("array<string>")
    start = F.struct(none.alias("done"), none.alias("open"))
    size = lambda xs: F.aggregate(xs, F.lit(0), lambda a, x: a + F.length(x)) + F.greatest(F.size(xs) - 1, F.lit(0))

    def last_lines(xs: Column) -> Column:
        if tail <= 0:
            return none
        begin = F.struct(none.alias("held"), F.lit(0).alias("n"), F.lit(True).alias("more"))

        def step(acc: Column, x: Column) -> Column:
            over = (acc["n"] + F.length(x) > tail) & (F.size(acc["held"]) > 0)
            grown = F.struct(F.concat(F.array(x), acc["held"]).alias("held"), (acc["n"] + F.length(x)).alias("n"), F.lit(True).alias("more"))
            return F.when(~acc["more"] | over, F.struct(acc["held"].alias("held"), acc["n"].alias("n"), F.lit(False).alias("more"))).otherwise(grown)

        return F.aggregate(F.reverse(xs), begin, step, lambda acc: acc["held"])

    def step(acc: Column, line: Column) -> Column:
        full = (F.size(acc["open"]) > 0) & (size(acc["open"]) + F.length(line) + 1 > most)
        closed = F.struct(F.concat(acc["done"], F.array(F.array_join(acc["open"], "\n"))).alias("done"), F.concat(last_lines(acc["open"]), F.array(line)).alias("open"))
        return F.when(full, closed).otherwise(F.struct(acc["done"].alias("done"), F.concat(acc["open"], F.array(line)).alias("open")))

    joined = F.aggregate(lines, start, step, lambda acc: F.concat(acc["done"], F.array(F.array_join(acc["open"], "\n"))))
    return F.filter(F.transform(joined, lambda c: F.trim(c, F.lit(" \t\r\n"))), lambda c: c != "")


def header_sections(rows: DataFrame, key: str, text: str) -> DataFrame:
    """key, section, level, title, header_path and content of the parts between Markdown headings; 0 and no title before the first.

    Headings are those of the block structure: none is found in code, HTML, quotes or lists, and underlined ones count."""
    parts = read_sections(rows, key, text).select(key, F.posexplode("sections").alias("section", "part")).select(key, "section", "part.*")
    # For each level the last heading at or above it that no higher heading has ended.
    w = Window.partitionBy(key).orderBy("section").rowsBetween(Window.unboundedPreceding, 0)
    at = lambda level: F.max(F.when((F.col("level") > 0) & (F.col("level") <= level), F.struct("section", "level", "title"))).over(w)
    path = F.array(*[F.when(at(i)["level"] == i, at(i)["title"]) for i in range(1, 7)])
    out = parts.withColumn("header_path", F.array_join(F.array_compact(path), " > "))
    return out.where((F.col("section") > 0) | (F.col("content") != ""))


def merged_sections(sections: DataFrame, key: str, least: int = LEAST, most: int = MOST) -> DataFrame:
    """Sections under `least` characters joined with those after them, a last small one with the one before; long ones
    split at paragraphs with sub ids and overlap between the splits."""
    text = F.concat_ws("\n", "title", F.when(F.contains("header_path", F.lit(" > ")), F.concat(F.lit("Context: "), F.col("header_path"))), F.nullif("content", F.lit("")))
    rows = sections.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("section", "header_path", text.alias("t")))).alias("s"))
    kind = "struct<header_path:string,t:string>"
    none = F.array().cast(f"array<{kind}>")
    start = F.struct(none.alias("done"), F.lit(None).cast(kind).alias("open"))

    def step(acc: Column, s: Column) -> Column:
        one = F.struct(s["header_path"].alias("header_path"), s["t"].alias("t"))
        grown = F.struct(acc["open"]["header_path"].alias("header_path"), F.concat(acc["open"]["t"], F.lit("\n\n"), s["t"]).alias("t"))
        return (
            F.when(acc["open"].isNull(), F.struct(acc["done"].alias("done"), one.alias("open")))
            .when(F.length(acc["open"]["t"]) < least, F.struct(acc["done"].alias("done"), grown.alias("open")))
            .otherwise(F.struct(F.concat(acc["done"], F.array(acc["open"])).alias("done"), one.alias("open")))
        )

    def end(acc: Column) -> Column:
        small = (F.length(acc["open"]["t"]) < least) & (F.size(acc["done"]) > 0)
        last = F.element_at(acc["done"], -1)
        back = F.struct(last["header_path"].alias("header_path"), F.concat(last["t"], F.lit("\n\n"), acc["open"]["t"]).alias("t"))
        return F.when(small, F.concat(F.slice(acc["done"], 1, F.size(acc["done"]) - 1), F.array(back))).otherwise(F.concat(acc["done"], F.filter(F.array(acc["open"]), lambda x: x.isNotNull())))

    chunks = rows.select(key, F.posexplode(F.aggregate("s", start, step, end)).alias("chunk_index", "c"))
    pieces = F.when(F.length("c.t") > most, packed(F.flatten(F.transform(paragraphs(F.col("c.t")), lambda p: split_long(p, most))), most, "\n\n")).otherwise(F.array("c.t"))
    subs = chunks.select(key, "chunk_index", F.col("c.header_path"), F.size(pieces).alias("n"), F.posexplode(pieces).alias("sub", "content"))
    id_ = F.concat(F.col(key).cast("string"), F.lit("_chunk_"), F.col("chunk_index").cast("string"), F.when(F.col("n") > 1, F.concat(F.lit("_sub_"), F.col("sub").cast("string"))).otherwise(F.lit("")))
    return overlapped(subs.withColumn("chunk_id", id_), [key, "chunk_index"], "sub", "content").drop("n")


def overlapped(rows: DataFrame, siblings: list[str], order: str, content: str, overlap: int = OVERLAP) -> DataFrame:
    """Content after the last characters of the sibling before, with a blank line between."""
    before = F.lag(content).over(Window.partitionBy(*siblings).orderBy(order))
    return rows.withColumn(content, F.when(before.isNotNull(), F.concat(F.right(before, F.lit(overlap)), F.lit("\n\n"), F.col(content))).otherwise(F.col(content)))


def parents(chunks: DataFrame, key: str, order: str, content: str, least: int = PARENT_LEAST, most: int = PARENT_MOST) -> DataFrame:
    """Chunks with parent_chunk_id: in order, a new parent once the open one has `least` characters or would pass `most`."""
    start = F.struct(F.array().cast("array<int>").alias("numbers"), F.lit(0).alias("number"), F.lit(0).alias("size"))

    def step(acc: Column, one: Column) -> Column:
        full = (acc["size"] > 0) & ((acc["size"] >= least) | (acc["size"] + one["n"] > most))
        number = F.when(full, acc["number"] + 1).otherwise(acc["number"])
        return F.struct(F.concat(acc["numbers"], F.array(number)).alias("numbers"), number.alias("number"), F.when(full, one["n"]).otherwise(acc["size"] + one["n"]).alias("size"))

    listed = chunks.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.length(content).alias("n")))).alias("_l"))
    numbers = listed.select(key, F.inline(F.arrays_zip(F.transform("_l", lambda x: x["o"]).alias(order), F.aggregate("_l", start, step, lambda acc: acc["numbers"]).alias("_number"))))
    return chunks.join(numbers, [key, order]).withColumn("parent_chunk_id", F.concat(F.col(key).cast("string"), F.lit("_parent_"), F.col("_number").cast("string"))).drop("_number")


def shared_path(paths: Column) -> Column:
    """What an array of header paths has in common at its start; empty if nothing."""
    parts = F.transform(paths, lambda p: F.split(p, " > "))
    first = F.get(parts, 0)
    same = F.filter(F.sequence(F.lit(1), F.greatest(F.size(first), F.lit(1))), lambda i: F.forall(parts, lambda p: F.slice(p, F.lit(1), i) == F.slice(first, F.lit(1), i)))
    return F.array_join(F.slice(first, F.lit(1), F.coalesce(F.array_max(same), F.lit(0))), " > ")


def parent_texts(chunks: DataFrame, key: str, order: str, content: str) -> DataFrame:
    """parent_chunk_id and its text, from chunks with parents; and the header path that they share, if they have one."""
    listed = F.array_sort(F.collect_list(F.struct(order, content)))
    more = [shared_path(F.collect_list("header_path")).alias("header_path")] if "header_path" in chunks.columns else []
    return chunks.groupBy(key, "parent_chunk_id").agg(F.array_join(F.transform(listed, lambda x: x[content]), "\n\n").alias("parent_content"), *more)


def expanded_parents(hits: DataFrame, query_key: str) -> DataFrame:
    """The best hit of each parent; a hit without parent is its own."""
    w = Window.partitionBy(query_key, F.coalesce("parent_chunk_id", "chunk_id")).orderBy(F.desc("score"), "chunk_id")
    return hits.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def commit_chunks(commits: DataFrame, tokens: int = TOKENS, overlap: int = TOKEN_OVERLAP) -> DataFrame:
    """hash, section, section_index, text and estimated_tokens: a summary, the message, and each file of the diff."""
    if not 0 <= overlap < tokens:
        raise ValueError("overlap must be at least 0 and under the tokens of a chunk")
    listed = F.when(F.size("files_changed") > 0, F.concat(F.lit("Files changed:\n"), F.array_join("files_changed", "\n")))
    full = lambda c: F.nullif(c, F.lit(""))
    summary = F.concat_ws("\n\n", F.coalesce(full(F.col("title")), F.lit("(no commit message)")), F.concat(F.lit("Author: "), full(F.col("author"))), F.concat(F.lit("Committer: "), full(F.col("committer"))), listed)
    files = F.filter(F.split(F.coalesce("delta_truncated", F.lit("")), r"(?m)(?=^diff --(?:git|cc) )"), lambda x: F.trim(x, F.lit(" \t\r\n")) != "")

    def section(name: str, text: Column, over: int) -> Column:
        label = f"{name.title()}:\n"
        budget = tokens - -(-len(label) // CHARS_A_TOKEN)
        if budget < 1:
            raise ValueError("too few tokens for the section's label")
        return F.transform(line_chunks(text, budget, over), lambda c, i: F.struct(F.lit(name).alias("section"), i.alias("section_index"), F.concat(F.lit(label), c).alias("text")))

    every = F.concat(section("summary", summary, 0), section("body", F.coalesce("message", F.lit("")), 0), F.flatten(F.transform(files, lambda f: section("diff", f, overlap))))
    return commits.select("hash", F.inline(every)).withColumn("estimated_tokens", estimated_tokens(F.col("text")))


def chunked(rows: DataFrame, key: str, text: str, strategy: str = "header_based", most: int = MOST, overlap: int = OVERLAP) -> DataFrame:
    """key, chunk_index, chunk_id and content by a strategy: none (the text as it is), header_based, paragraph, sentence or sliding_window."""
    if strategy == "header_based":
        found = merged_sections(header_sections(rows, key, text), key, most=most)
        place = F.row_number().over(Window.partitionBy(key).orderBy("chunk_index", "sub")) - 1
        return found.withColumn("chunk_index", place).select(key, "chunk_index", "chunk_id", "content")
    if strategy == "paragraph":
        return paragraph_chunks(rows, key, text, most).select(key, "chunk_index", "chunk_id", "content")
    pieces = {"none": F.array(text), "sentence": sentences(F.col(text), most), "sliding_window": windows(F.col(text), most, overlap)}
    if strategy not in pieces:
        raise ValueError(f"no such strategy: {strategy}")
    out = rows.select(key, F.posexplode(pieces[strategy]).alias("chunk_index", "content"))
    return out.select(key, "chunk_index", F.concat(F.col(key).cast("string"), F.lit("_chunk_"), F.col("chunk_index").cast("string")).alias("chunk_id"), "content")
