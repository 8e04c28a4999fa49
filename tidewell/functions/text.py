"""Column functions on text: words, Markdown parts, paths, tokens."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that vocabularies leave out.
STOPWORDS = (
    "a an the and or but in on at to for of with by from as is was are were been be have has had do does did will would could should may might must shall can need "
    "this that these those it its they them their he she him her his hers we us our you your i me my who what which where when how why all each every both few more most "
    "other some such no not only same so than too very just also now here there then"
).split()
#: Words that mark a query as navigational, and the patterns that mark one as factual (identifiers, code, versions, quotes) or as a link.
NAVIGATIONAL = "section chapter guide tutorial documentation docs".split()
FACTS = [r"[a-z][A-Z]|[A-Z]{2,}[a-z]", r"\b[a-z]+_[a-z_]+\b", "`[^`]+`", r"\b[vV]?\d+\.\d+(?:\.\d+)?(?:-\w+)?\b", '"[^"]+"']
LINK = r"\[\[[^\]]+\]\]"
#: Characters that a token stands for.
CHARS_A_TOKEN = 3


def all_matches(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def words(text: Column) -> Column:
    """Lower-case runs of letters, digits and underscores, of any script."""
    return all_matches(F.lower(text), r"[\p{L}\p{N}_]+")


def query_tokens(text: Column) -> Column:
    """Distinct tokens that metadata are matched by: paths and versions stay whole."""
    return F.array_distinct(all_matches(F.lower(text), r"[a-z0-9_./-]+"))


def vocabulary_terms(text: Column) -> Column:
    """Lower-case words that begin with a letter, with hyphens and underscores."""
    return all_matches(F.lower(text), r"\b[a-z][a-z0-9_-]*\b")


def code_tokens(text: Column) -> Column:
    """Identifiers with their camel-case and snake-case parts, in lower case, each once, sorted."""
    whole = all_matches(text, r"[A-Za-z_][A-Za-z0-9_]*")
    camel = all_matches(text, r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
    return F.array_sort(F.array_distinct(F.transform(F.concat(whole, camel), lambda t: F.lower(t))))


def trigrams(text: Column) -> Column:
    """Distinct character trigrams in lower case, blanks kept; none of a text under three characters."""


    def grams(letters: Column) -> Column:
        starts = F.when(F.size(letters) >= 3, F.sequence(F.lit(0), F.size(letters) - 3)).otherwise(F.array().cast("array<int>"))
        return F.array_distinct(F.transform(starts, lambda i: F.concat(F.get(letters, i), F.get(letters, i + 1), F.get(letters, i + 2))))

    # As the argument of a function the letters are split once.
    return F.element_at(F.transform(F.array(F.split(F.lower(text), "")), grams), 1)


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays of distinct items; 0 if both are empty."""
    both = F.size(F.array_intersect(a, b))
    return F.coalesce(both / F.nullif(F.size(a) + F.size(b) - both, F.lit(0)), F.lit(0.0))


def estimated_tokens(text: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.length(text) / CHARS_A_TOKEN)).cast("int")


# Markdown


def front_matter(text: Column) -> Column:
    """What stands between --- lines at the very start; empty if there is none."""
    return F.regexp_extract(text, r"(?s)^---[^\S\n]*\n(.*?)\n---[^\S\n]*\n", 1)


def front_value(matter: Column, key: str) -> Column:
    """A scalar of front matter without quotes; null if it is missing."""
    value = F.regexp_extract(matter, rf"(?m)^{re.escape(key)}:[ \t]*[\"']?(.*?)[\"']?[ \t]*$", 1)
    return F.nullif(value, F.lit(""))


def front_list(matter: Column, key: str) -> Column:
    """A list of front matter, in brackets or a line each, or a scalar as a list of one; empty if it is missing."""
    inline = F.regexp_extract(matter, rf"(?m)^{re.escape(key)}:[ \t]*\[(.*?)\]", 1)
    lines = F.regexp_extract(matter, rf"(?m)^{re.escape(key)}:[ \t]*\n((?:[ \t]*- .*(?:\n|$))+)", 1)
    clean = lambda xs: F.filter(F.transform(xs, lambda x: F.regexp_replace(x, r"^[\s\"'-]+|[\s\"']+$", "")), lambda x: x != "")
    scalar = front_value(matter, key)
    return F.when(inline != "", clean(F.split(inline, ","))).when(lines != "", clean(F.split(lines, "\n"))).when(scalar.isNotNull() & ~scalar.startswith("["), F.array(scalar)).otherwise(F.array().cast("array<string>"))


def body(text: Column) -> Column:
    """The text without front matter and without white space at its ends."""
    return F.regexp_replace(F.regexp_replace(text, r"(?s)^---[^\S\n]*\n.*?\n---[^\S\n]*\n", ""), r"^\s+|\s+$", "")


def without_code(text: Column) -> Column:
    """Fenced blocks, indented blocks after a blank line, and back-tick spans give way to blanks."""
    fenced = F.regexp_replace(text, r"(?ms)^(```|~~~).*?(?:^\1[^\n]*$|\z)", " ")
    indented = F.regexp_replace(fenced, r"(?m)(?<=\n\n)(?:(?: {4}|\t)[^\n]*\n?)+", " ")
    return F.regexp_replace(indented, r"`[^`\n]*`", " ")


def wikilinks(text: Column) -> Column:
    """Targets of [[links]], then of [links](target), each once; no embeds or images."""
    wiki = all_matches(text, r"(?<!!)\[\[([^\]|]+)(?:\|[^\]]+)?\]\]", 1)
    plain = all_matches(text, r"(?<!!)\[[^\[\]]*\]\(([^)\s]+)[^)]*\)", 1)
    return F.array_distinct(F.concat(wiki, plain))


def transclusions(text: Column) -> Column:
    return all_matches(text, r"!\[\[([^\]]+)\]\]", 1)


def inline_tags(text: Column) -> Column:
    """#tags at a line's start or after white space, sorted, each once."""
    return F.array_sort(F.array_distinct(all_matches(text, r"(?U)(?m)(?:^|\s)#([\w-]+)", 1)))


def fenced_code(text: Column) -> Column:
    """(language, code) of fenced blocks."""
    at = r"(?s)```(\w*)\n(.*?)```"
    return F.arrays_zip(all_matches(text, at, 1).alias("language"), all_matches(text, at, 2).alias("code"))


def edge_type(header: Column) -> Column:
    low = F.lower(F.coalesce(header, F.lit("")))
    return F.when(low.contains("test"), "tests").when(low.contains("implement"), "implements").when(low.contains("see also") | low.contains("related"), "related").otherwise("links_to")


# Paths


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def without_suffix(path: Column) -> Column:
    return F.regexp_replace(path, r"(?<=[^/])\.[^./]*$", "")


def hidden(path: Column) -> Column:
    """Whether a part of a relative path begins with a dot; . and .. do not count."""
    return F.exists(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), lambda p: p.startswith(".") & ~p.isin(".", ".."))


def glob_pattern(glob: str) -> str:
    """A regular expression for a glob that is anchored at the right; ** is like *, and neither crosses a slash."""
    part = {"*": "[^/]*", "?": "[^/]"}
    parts = re.findall(r"\*+|\?|\[[^\]]*\]|.", glob)
    return "(?:^|/)" + "".join(part["*"] if p[0] == "*" else part.get(p) or (p if p[0] == "[" and len(p) > 2 else re.escape(p)) for p in parts) + "$"


def path_glob(glob: str) -> str:
    """A regular expression for a glob over whole paths: **/ stands for any folders, or none, and /** for all that lies
    below; * and ? do not cross a slash. A glob without a slash is for the name alone, in any folder."""
    glob = glob.replace("\\", "/")
    part = {"**/": "(?:.*/)?", "**": ".*", "*": "[^/]*", "?": "[^/]"}
    parts = re.findall(r"\*\*/|\*\*|\*|\?|\[!?\]?[^\]]*\]|.", glob)
    written = "".join(part.get(p) or ("[" + ("^" if p[1] == "!" else "") + p[1 + (p[1] == "!") : -1].replace("\\", "\\\\") + "]" if len(p) > 2 and p[0] == "[" else re.escape(p)) for p in parts)
    return ("^" if "/" in glob else "(?:^|/)") + written + "$"


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.[^./]+$", 0))


def decoded(content: Column) -> Column:
    """UTF-8 if the bytes are valid, else Latin-1, with line ends as \\n."""
    text = F.when(F.is_valid_utf8(content.cast("string")), content.cast("string")).otherwise(F.decode(content, "ISO-8859-1"))
    return F.regexp_replace(text, "\r\n?", "\n")


# Queries


def query_type(query: Column) -> Column:
    """factual, navigational or exploratory; the first that matches."""
    factual = query.rlike("|".join(FACTS))
    navigational = F.lower(query).rlike("|".join(NAVIGATIONAL)) | query.rlike(LINK)
    return F.when(factual, "factual").when(navigational, "navigational").otherwise("exploratory")


def lexical_match(query: Column, metadata: Column, text: Column, by_keyword: Column) -> Column:
    """Whether the query or all its tokens are in the metadata, or, for a keyword hit, any token is in the text."""
    tokens, low = query_tokens(query), F.lower(metadata)
    inside = F.contains(low, F.lower(query)) | (F.size(F.array_except(tokens, query_tokens(metadata))) == 0)
    return (F.size(tokens) > 0) & (inside | (by_keyword & F.exists(tokens, lambda t: F.contains(F.lower(text), t))))


def metadata_rank(query: Column, *fields: Column) -> Column:
    """2 if a field holds the query, 1 if the fields' tokens cover it, else 0."""
    low = F.lower(F.trim(query))
    tokens = query_tokens(low)
    held = F.lit(False)
    for f in fields:
        held = held | F.contains(F.lower(F.coalesce(f, F.lit(""))), low)
    covered = F.size(F.array_except(tokens, query_tokens(F.concat_ws(" ", *fields)))) == 0
    return F.when(low == "", 0).when(held, 2).when((F.size(tokens) > 0) & covered, 1).otherwise(0)


def git_document(title: Column, message: Column, author: Column, committer: Column, files: Column, delta: Column) -> Column:
    """The searchable text of a commit; empty parts are left out."""
    full = lambda c: F.nullif(c, F.lit(""))
    people = F.concat_ws("\n", F.concat(F.lit("Author: "), full(author)), F.concat(F.lit("Committer: "), full(committer)))
    listed = F.when(F.size(files) > 0, F.concat(F.lit("Files changed:\n"), F.array_join(files, "\n")))
    return F.concat_ws("\n\n", full(title), full(message), full(people), listed, full(delta))
