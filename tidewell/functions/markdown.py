"""Markdown by blocks: a state machine over lines, as the public CommonMark text describes it, and front matter.

One pass over the lines of a text keeps the open containers (quotes, list items) and the open leaf. What is a heading,
code or prose is told by that state and not by patterns over the whole text, so a comment in a fence is no heading.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of CommonMark: elements that begin an HTML block, and how its kinds begin and end.
HTML_BLOCK = "address|article|aside|base|basefont|blockquote|body|caption|center|col|colgroup|dd|details|dialog|dir|div|dl|dt|fieldset|figcaption|figure|footer|form|frame|frameset|h1|h2|h3|h4|h5|h6|head|header|hr|html|iframe|legend|li|link|main|menu|menuitem|nav|noframes|ol|optgroup|option|p|param|search|section|summary|table|tbody|td|tfoot|th|thead|title|tr|track|ul"
HTML = [
    (re.compile(r"<(?:script|pre|style|textarea)(?:\s|>|$)", re.I), re.compile(r"</(?:script|pre|style|textarea)>", re.I)),
    (re.compile(r"<!--"), re.compile(r"-->")),
    (re.compile(r"<\?"), re.compile(r"\?>")),
    (re.compile(r"<![A-Za-z]"), re.compile(r">")),
    (re.compile(r"<!\[CDATA\["), re.compile(r"\]\]>")),
    (re.compile(rf"</?(?:{HTML_BLOCK})(?:\s|/?>|$)", re.I), None),
]
ALONE = re.compile(r"(?:<[A-Za-z][A-Za-z0-9-]*(?:\s+[A-Za-z_:][\w.:-]*(?:\s*=\s*(?:[^\s\"'=<>`]+|'[^']*'|\"[^\"]*\"))?)*\s*/?>|</[A-Za-z][A-Za-z0-9-]*\s*>)\s*$")
HEADING = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*)|$)")
UNDERLINE, RULE = re.compile(r" {0,3}(=+|-+)[ \t]*$"), re.compile(r" {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")
FENCE, QUOTE, ITEM = re.compile(r"( {0,3})(`{3,}|~{3,})[ \t]*(.*)$"), re.compile(r" {0,3}> ?"), re.compile(r"( {0,3})([-+*]|\d{1,9}[.)])( +|$)")
DEFINED = re.compile(r" {0,3}\[((?:[^\[\]\\]|\\.)+)\]:\s*(?:<([^<>\n]*)>|(\S+))(?:[ \t]+(?:\"[^\"]*\"|'[^']*'|\([^()]*\)))?[ \t]*$")
BLOCK = "struct<kind: string, level: int, info: string, first: int, last: int, inside: string, content: string>"
#: Kinds of blocks that are code.
CODE = ("fence", "indented")


def headline(text: str) -> str:
    """A heading's text without the signs that may close it."""
    text = text.strip()
    bare = text.rstrip("#")
    return bare.rstrip() if not bare or bare[-1] in " \t" else text


def blocks(text: str) -> list[tuple[str, int, str, int, int, str, str]]:
    """(kind, level, info, first and last line, containers, content) of the leaves of a text, in order.

    Kinds: heading, paragraph, fence, indented, html, rule, definition. level: of a heading; info: of a fence what stands
    behind it, of a definition its label. Containers: > for a quote, - for an item, from the outermost."""
    out: list[tuple[str, int, str, int, int, str, str]] = []
    stack: list[int] = []  # 0 for a quote, or the columns that an item's content is indented by
    leaf: dict | None = None

    def told(kind: str, level: int, info: str, first: int, last: int, content: str) -> None:
        out.append((kind, level, info, first, last, "".join("-" if x else ">" for x in stack), content))

    def close() -> None:
        nonlocal leaf
        if leaf is None:
            return
        kind, lines, first, last = leaf["kind"], leaf["lines"], leaf["first"], leaf["last"]
        if kind == "paragraph":
            while lines and (m := DEFINED.match(lines[0])):
                told("definition", 0, " ".join(m[1].split()).casefold(), first, first, m[2] if m[2] is not None else m[3])
                lines, first = lines[1:], first + 1
        if kind == "indented":
            while lines and not lines[-1].strip():
                lines.pop()
                last -= 1
        if lines or kind == "fence":
            told(kind, 0, leaf.get("info", ""), first, last, "\n".join(x.strip() for x in lines) if kind == "paragraph" else "\n".join(lines))
        leaf = None

    for no, raw in enumerate(text.split("\n")):
        raw = raw.removesuffix("\r")
        bare = raw.lstrip(" \t")
        line = raw[: len(raw) - len(bare)].expandtabs(4) + bare
        held = 0
        for x in stack:
            if x == 0:
                if not (m := QUOTE.match(line)):
                    break
                line = line[m.end() :]
            elif line.strip() and len(line) - len(line.lstrip(" ")) < x:
                break
            else:
                line = line[x:]
            held += 1
        if leaf is not None and leaf["kind"] in ("fence", "html"):
            if held == len(stack):
                leaf["last"] = no
                if leaf["kind"] == "fence":
                    m = FENCE.match(line)
                    if m and m[2][0] == leaf["mark"][0] and len(m[2]) >= len(leaf["mark"]) and not m[3].strip():
                        close()
                    else:
                        leaf["lines"].append(line[min(leaf["indent"], len(line) - len(line.lstrip(" "))) :])
                elif leaf["end"] is None and not line.strip():
                    close()
                else:
                    leaf["lines"].append(line)
                    if leaf["end"] is not None and leaf["end"].search(line):
                        close()
                continue
            close()
        open_ = leaf is not None and leaf["kind"] == "paragraph"
        began = False
        while len(line) - len(line.lstrip(" ")) < 4:
            if m := QUOTE.match(line):
                width = 0
            elif (m := ITEM.match(line)) and not RULE.match(line):
                after = line[m.end() :]
                if open_ and not began and held == len(stack) and (not after.strip() or m[2][-1] in ".)" and int(m[2][:-1]) != 1):
                    break
                width = len(m[1]) + len(m[2]) + (len(m[3]) if after.strip() and len(m[3]) < 5 else 1)
            else:
                break
            close()
            del stack[held:]
            stack.append(width)
            held += 1
            began = True
            line = line[m.end() :] if width == 0 else line[width:]
        blank, indent = not line.strip(), len(line) - len(line.lstrip(" "))
        fence, heading = FENCE.match(line), HEADING.match(line)
        if fence and fence[2][0] == "`" and "`" in fence[3]:
            fence = None
        html = None
        if indent < 4 and line.lstrip(" ").startswith("<"):
            own = line.lstrip(" ")
            html = next(((end,) for begin, end in HTML if begin.match(own)), None)
            if html is None and not open_ and ALONE.match(own):
                html = (None,)
        if held < len(stack):
            # A paragraph may go on without the marks of its containers.
            if open_ and not blank and not (fence or heading or html or RULE.match(line)):
                leaf["lines"].append(line)
                leaf["last"] = no
                continue
            close()
            del stack[held:]
            open_ = False
        if began:
            open_ = False
        if blank:
            if leaf is not None and leaf["kind"] == "indented":
                leaf["lines"].append(line[4:])
                leaf["last"] = no
            else:
                close()
        elif leaf is not None and leaf["kind"] == "indented" and indent >= 4:
            leaf["lines"].append(line[4:])
            leaf["last"] = no
        elif open_ and (m := UNDERLINE.match(line)) and not all(DEFINED.match(x) for x in leaf["lines"]):
            first, lines = leaf["first"], leaf["lines"]
            leaf = None
            told("heading", 1 if m[1][0] == "=" else 2, "", first, no, "\n".join(x.strip() for x in lines))
        elif RULE.match(line):
            close()
            told("rule", 0, "", no, no, line.strip())
        elif heading:
            close()
            told("heading", len(heading[1]), "", no, no, headline(heading[2] or ""))
        elif fence:
            close()
            leaf = {"kind": "fence", "info": fence[3].strip(), "mark": fence[2], "indent": len(fence[1]), "lines": [], "first": no, "last": no}
        elif html:
            close()
            leaf = {"kind": "html", "end": html[0], "lines": [line], "first": no, "last": no}
            if html[0] is not None and html[0].search(line):
                close()
        elif open_:
            leaf["lines"].append(line)
            leaf["last"] = no
        else:
            close()
            kind = "indented" if indent >= 4 else "paragraph"
            leaf = {"kind": kind, "lines": [line[4:] if indent >= 4 else line], "first": no, "last": no}
    close()
    return out


def sections(text: str) -> list[tuple[int, str | None, str]]:
    """(level, title, content) of the parts between headings that stand in no container; level 0 and no title before the first."""
    lines = text.split("\n")
    heads = [b for b in blocks(text) if b[0] == "heading" and not b[5]]
    cuts = [(0, None, 0)] + [(b[1], " ".join(b[6].split("\n")), b[4] + 1) for b in heads]
    ends = [b[3] for b in heads] + [len(lines)]
    return [(level, title, "\n".join(lines[at:end]).strip()) for (level, title, at), end in zip(cuts, ends, strict=True)]


def _mapped(rows: DataFrame, keep: list[str], text: str, kind: str, read: Callable[[str], list]) -> DataFrame:
    """The columns in `keep` and `found`, what is read of a text; null of a null one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, 100):
                some = batch.slice(s, 100)
                found = [None if x is None else [dict(zip(names, r, strict=True)) for r in read(x)] for x in some.column(text).to_pylist()]
                yield pa.RecordBatch.from_arrays([*(some.column(c) for c in keep), pa.array(found, pa.list_(types))], [*keep, "found"])

    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import _parse_datatype_string

    types = to_arrow_type(_parse_datatype_string(kind))
    names = [f.name for f in types]
    have = dict(rows.dtypes)
    return rows.select(*dict.fromkeys((*keep, text))).mapInArrow(run, ", ".join([f"`{c}` {have[c]}" for c in keep] + [f"found array<{kind}>"]))


def read_blocks(rows: DataFrame, keep: list[str], text: str) -> DataFrame:
    """The columns in `keep` and blocks, an array of kind, level, info, first, last, inside and content; null of a null text. No shuffle."""
    return _mapped(rows, keep, text, BLOCK, blocks).withColumnRenamed("found", "blocks")


def read_sections(rows: DataFrame, key: str, text: str) -> DataFrame:
    """key and sections, an array of level, title and content."""
    return _mapped(rows, [key], text, "struct<level: int, title: string, content: string>", sections).withColumnRenamed("found", "sections")


def prose(found: Column) -> Column:
    """The text of blocks that are no code and no definitions, without back-tick spans."""
    text = F.array_join(F.transform(F.filter(found, lambda b: ~b["kind"].isin(*CODE, "definition", "rule")), lambda b: b["content"]), "\n\n")
    return F.regexp_replace(text, r"(?<!`)(`+)(?!`)(?s:.+?)(?<!`)\1(?!`)", " ")


def code(found: Column) -> Column:
    """(language, code) of fences."""
    return F.transform(F.filter(found, lambda b: b["kind"] == "fence"), lambda b: F.struct(F.split(b["info"], r"\s+")[0].alias("language"), b["content"].alias("code")))


def referred(found: Column, text: Column) -> Column:
    """Targets of reference links in a prose: [text][label], [label][] and [label], of labels that the blocks define."""
    defined = F.map_from_entries(F.filter(F.transform(F.filter(found, lambda b: b["kind"] == "definition"), lambda b: F.struct(b["info"].alias("key"), b["content"].alias("value"))), lambda e: e["key"].isNotNull()))
    at = lambda pattern: F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), lambda x: F.lower(F.regexp_replace(F.trim(x), r"\s+", " ")))
    labels = F.concat(at(r"(?<!!)\[[^\[\]]+\]\[([^\[\]]+)\]"), at(r"(?<![!\]\[])\[([^\[\]]+)\](?![(\[\]:])(?:\[\])?"), at(r"(?<![!\]\[])\[([^\[\]]+)\]\[\]"))
    return F.array_compact(F.array_distinct(F.transform(labels, lambda x: F.try_element_at(defined, x))))


# Front matter

#: How YAML says what is no text.
SCALAR = {"true": True, "yes": True, "on": True, "false": False, "no": False, "off": False, "null": None, "~": None, "": None}
NUMBER = re.compile(r"[-+]?(?:\d+|\d*\.\d+(?:[eE][-+]?\d+)?|\d+\.\d*(?:[eE][-+]?\d+)?)$")


def scalar(text: str):
    """A scalar, or a list or map in brackets, of front matter."""
    text = text.strip()
    if len(text) > 1 and text[0] == text[-1] == '"':
        try:
            return json.loads(text)
        except ValueError:
            return text[1:-1]
    if len(text) > 1 and text[0] == text[-1] == "'":
        return text[1:-1].replace("''", "'")
    if text[:1] in "[{" and text[-1:] == {"[": "]", "{": "}"}.get(text[:1]):
        parts, depth, quote, at = [], 0, "", 1
        for i, c in enumerate(text):
            if quote:
                quote = "" if c == quote else quote
            elif c in "\"'":
                quote = c
            elif c in "[{":
                depth += 1
            elif c in "]}":
                depth -= 1
            if not quote and (c == "," and depth == 1 or i == len(text) - 1):
                parts.append(text[at:i].strip())
                at = i + 1
        parts = [p for p in parts if p]
        return [scalar(p) for p in parts] if text[0] == "[" else {str(scalar(k)): scalar(v) for k, _, v in (p.partition(":") for p in parts)}
    text = re.sub(r"(?:^|\s+)#.*$", "", text)
    if text.lower() in SCALAR:
        return SCALAR[text.lower()]
    if NUMBER.match(text):
        number = int(text) if text.lstrip("+-").isdigit() else float(text)
        return number if str(number) == text else text
    return text


def front_fields(matter: str) -> dict:
    """The fields of front matter: nested by indentation, with lists, texts in quotes and of several lines (| and >). {} of
    what is no map. Anchors and tags of types are text as they stand."""
    lines = matter.split("\n")
    at = 0

    def depth(i: int) -> int:
        return len(lines[i]) - len(lines[i].lstrip(" "))

    def skip() -> None:
        nonlocal at
        while at < len(lines) and (not lines[at].strip() or lines[at].lstrip().startswith("#")):
            at += 1

    def value(text: str, indent: int):
        nonlocal at
        if text[:1] in ("|", ">") and re.fullmatch(r"[|>][-+0-9]*", text):
            own = []
            while at < len(lines) and (not lines[at].strip() or depth(at) > indent):
                own.append(lines[at])
                at += 1
            while own and not own[-1].strip():
                own.pop()
            cut = min((len(x) - len(x.lstrip(" ")) for x in own if x.strip()), default=0)
            own = [x[cut:] for x in own]
            joined = "\n".join(own) if text[0] == "|" else re.sub(r"(?<!\n)\n(?!\n)", " ", "\n".join(own)).replace("\n\n", "\n")
            return joined + ("" if "-" in text or not own else "\n")
        if text and not text.startswith("#"):
            return scalar(text)
        skip()
        if at < len(lines) and (depth(at) > indent or depth(at) == indent and re.match(r" *-(?: |$)", lines[at])):
            return node(depth(at))
        return None

    def node(indent: int):
        nonlocal at
        out: dict | list | None = None
        while True:
            skip()
            if at >= len(lines) or depth(at) != indent:
                return out
            line = lines[at].strip()
            if line == "-" or line.startswith("- "):
                if isinstance(out, dict):
                    return out
                out = [] if out is None else out
                rest = line[1:].strip()
                if re.match(r"(?:\"[^\"]*\"|'[^']*'|[^\"'\[{#:][^:]*):(?: |$)", rest):
                    lines[at] = " " * (indent + 2) + rest
                    out.append(node(indent + 2))
                else:
                    at += 1
                    out.append(value(rest, indent))
            else:
                m = re.match(r"(\"[^\"]*\"|'[^']*'|[^:#]+?)\s*:(?:\s+(.*)|$)", line)
                if isinstance(out, list):
                    return out
                if m is None:
                    at += 1
                    continue
                out = {} if out is None else out
                at += 1
                found = value((m[2] or "").strip(), indent)
                out.setdefault(str(scalar(m[1])) if m[1][0] in "\"'" else m[1].strip(), found)

    skip()
    found = node(depth(at)) if at < len(lines) else None
    return found if isinstance(found, dict) else {}


MATTER = "struct<fields: map<string, string>, tags: array<string>, aliases: array<string>, keywords: array<string>, related: array<string>>"


def as_text(value) -> str:
    """A value as text: lists and maps as JSON."""
    return value if isinstance(value, str) else json.dumps(value, ensure_ascii=False, sort_keys=True)


def as_list(value) -> list[str]:
    """A list of texts: of one a list of its own."""
    return [x for x in (as_text(v) for v in (value if isinstance(value, list) else [value]) if v is not None) if x]


def document_fields(matter: str) -> list[tuple]:
    """One row: all fields as texts, and those that are lists. What cannot be read has none."""
    try:
        found = front_fields(matter)
    except (RecursionError, ValueError):  # brackets or numbers without end
        found = {}
    return [({k: as_text(v) for k, v in found.items() if v is not None}, *(as_list(found.get(n)) for n in ("tags", "aliases", "keywords", "related")))]


def read_matter(rows: DataFrame, keep: list[str], matter: str) -> DataFrame:
    """The columns in `keep` and matter: the fields of front matter as texts, and tags, aliases, keywords and related as lists."""
    return _mapped(rows, keep, matter, MATTER, document_fields).withColumn("matter", F.col("found")[0]).drop("found")
