"""Chat formatting: layouts told by the hash of their field paths, canonical turns, a reversible template and a loss mask.

A record may hold a prompt and its answer, an instruction, a list of messages, or one turn of a conversation. The
paths of the known fields that a record fills are hashed; the hash selects a declarative mapping to turns of a role and
a text. Each turn is wrapped in control strings. Those that stand inside a text get a backslash after their first
character, one more if they have some, so texts hold no control string and the way back is exact. Everything is
DataFrame functions: no Python runs in a task.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from itertools import chain, combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Control strings of public chat templates; a text never shows one as it is, whatever template is used.
CONTROLS = ("<|im_start|>", "<|im_sep|>", "<|im_end|>", "<|start_header_id|>", "<|end_header_id|>", "<|eot_id|>", "<|begin_of_text|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")


@dataclass(frozen=True)
class Template:
    """opening role between text closing, for each turn; `learned` are the roles whose texts are under the loss mask."""

    opening: str = "<|im_start|>"
    between: str = "<|im_sep|>"
    closing: str = "<|im_end|>"
    learned: tuple[str, ...] = ("assistant",)

    def __post_init__(self) -> None:
        """Control strings must not overlap or hold each other, nor a backslash: only then one character tells them apart."""
        every = self.controls()
        for a in every:
            if len(a) < 2 or "\\" in a:
                raise ValueError(f"no control string: {a!r}")
            for b in every:
                if a != b and a.startswith(b) or any(a[i:].startswith(b) or b.startswith(a[i:]) for i in range(1, len(a))):
                    raise ValueError(f"{a!r} and {b!r} overlap")

    def controls(self) -> list[str]:
        return sorted({*CONTROLS, self.opening, self.between, self.closing})

    def _first(self, slashes: str) -> str:
        """The first character of a control string, with so many backslashes after it."""
        return "|".join(rf"{re.escape(c)}(?=\\{slashes}(?:{'|'.join(re.escape(x[1:]) for x in self.controls() if x[0] == c)}))" for c in sorted({x[0] for x in self.controls()}))

    def escaped(self, text: Column) -> Column:
        return F.regexp_replace(text, f"({self._first('*')})", r"$1\\")

    def plain(self, text: Column) -> Column:
        return F.regexp_replace(text, rf"({self._first('+')})\\", "$1")


@dataclass(frozen=True)
class Part:
    """A turn of a fixed role whose text is the filled ones of the fields, one blank line between; left out if all are null."""

    role: str
    fields: tuple[str, ...]
    optional: tuple[str, ...] = ()


@dataclass(frozen=True)
class Listed:
    """Turns from an array of structs; `roles` renames."""

    field: str
    role: str
    text: str
    roles: tuple[tuple[str, str], ...] = ()


@dataclass(frozen=True)
class Turn:
    """One turn a row: rows of a key make a conversation."""

    role: str = "role"
    text: str = "text"


@dataclass(frozen=True)
class Layout:
    """How a record's fields become turns."""

    name: str
    steps: tuple[Part | Listed | Turn, ...]


SYSTEM = Part("system", ("system",), ("system",))
#: Mappings by name. A record belongs to the one whose paths it fills, optional ones or not.
LAYOUTS = (
    Layout("messages", (SYSTEM, Listed("messages", "role", "content"))),
    Layout("from_value", (SYSTEM, Listed("conversations", "from", "value", (("human", "user"), ("gpt", "assistant"))))),
    Layout("prompt_completion", (SYSTEM, Part("user", ("prompt",)), Part("assistant", ("completion",)))),
    Layout("prompt_response", (SYSTEM, Part("user", ("prompt",)), Part("assistant", ("response",)))),
    Layout("question_answer", (SYSTEM, Part("user", ("question",)), Part("assistant", ("answer",)))),
    Layout("instruction", (SYSTEM, Part("user", ("instruction", "input"), ("input",)), Part("assistant", ("output",)))),
    Layout("turn", (Turn(),)),
)


def known_schema(layouts: tuple[Layout, ...] = LAYOUTS) -> str:
    """The fields that the mappings read, as a schema: records in JSON are read with it, other fields are not."""
    kinds: dict[str, dict[str, None] | None] = {}
    for step in chain.from_iterable(x.steps for x in layouts):
        if isinstance(step, Listed):
            kinds.setdefault(step.field, {}).update({step.role: None, step.text: None})
        else:
            kinds |= dict.fromkeys(step.fields if isinstance(step, Part) else (step.role, step.text))
    return ", ".join(f"`{k}` " + ("string" if v is None else f"array<struct<{', '.join(f'`{x}`: string' for x in v)}>>") for k, v in kinds.items())


def _paths(layout: Layout) -> list[tuple[set[str], set[str]]]:
    """For each step, the paths that must be filled, and those that may be."""
    out = []
    for s in layout.steps:
        if isinstance(s, Part):
            out.append((set(s.fields) - set(s.optional), set(s.optional)))
        elif isinstance(s, Listed):
            out.append(({s.field}, {f"{s.field}[].{s.role}", f"{s.field}[].{s.text}"}))
        else:
            out.append((set(), {s.role, s.text}))
    return out


def _joined(paths: set[str]) -> str:
    return "\n".join(sorted(paths))


def fingerprints(layouts: tuple[Layout, ...] = LAYOUTS) -> dict[str, str]:
    """Sorted field paths, one a line, and the name of the mapping that reads them; two mappings never share one."""
    out: dict[str, str] = {}
    for layout in layouts:
        steps = _paths(layout)
        must, may = set().union(*(m for m, _ in steps)), sorted(set().union(*(o for _, o in steps)))
        for n in range(len(may) + 1):
            for some in combinations(may, n):
                if out.setdefault(_joined(must | set(some)), layout.name) != layout.name:
                    raise ValueError(f"{layout.name} and {out[_joined(must | set(some))]} read the same fields")
    return out


def _filled(name: str) -> Callable[[Column], Column]:
    return lambda m: m[name].isNotNull()


def _listed(step: Listed) -> Callable[[Column], Column]:
    """A turn of an element."""

    def one(m: Column) -> Column:
        role = m[step.role]
        for old, new in step.roles:
            role = F.when(m[step.role] == old, F.lit(new)).otherwise(role)
        return _turn(role, m[step.text])

    return one


def _known(names: list[str], inner: list[str]) -> Callable[[Column], Column]:
    """An element's known fields as texts, null where it has none."""
    return lambda m: F.struct(*((m[n] if n in inner else F.lit(None)).cast("string").alias(n) for n in names))


def fingerprint(fields: dict[str, Column], layouts: tuple[Layout, ...] = LAYOUTS) -> Column:
    """64-bit hash of the known paths that a record fills: those whose value is not null, in a list those that any element fills."""
    present: dict[str, Column] = {}
    for s in chain.from_iterable(x.steps for x in layouts):
        if isinstance(s, Listed):
            if s.field in fields:
                at = fields[s.field]
                present[s.field] = at.isNotNull()
                for name in (s.role, s.text):
                    present[f"{s.field}[].{name}"] = F.exists(at, _filled(name))
        else:
            present |= {f: fields[f].isNotNull() for f in (s.fields if isinstance(s, Part) else (s.role, s.text)) if f in fields}
    if not present:
        return F.xxhash64(F.lit(""))
    return F.xxhash64(F.array_join(F.array_compact(F.array(*(F.when(c, F.lit(p)) for p, c in sorted(present.items())))), "\n"))


def _turn(role: Column, text: Column) -> Column:
    return F.struct(F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))


def _turns(layout: Layout, fields: dict[str, Column]) -> Column:
    out = []
    for s in layout.steps:
        if isinstance(s, Part):
            some = [fields[f] for f in s.fields if f in fields]
            if some:
                out.append(F.when(F.coalesce(*some).isNotNull(), F.array(_turn(F.lit(s.role), F.concat_ws("\n\n", *some)))))
        elif isinstance(s, Listed):
            out.append(F.transform(fields[s.field], _listed(s)))
        else:
            out.append(F.array(_turn(*(fields[f] if f in fields else F.lit(None).cast("string") for f in (s.role, s.text)))))
    return F.flatten(F.array_compact(F.array(*out)))


def canonical(records: DataFrame, json: str | None = None, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """The rows with `layout`, the name of a mapping or null, and `turns`, array<struct<role, text>>, null without a mapping.

    Fields are the records' own columns, or with `json` those of that column's JSON objects; a field that is no text
    (no list of role and text) is read as if it were missing. Whatever other fields there are, they change nothing.
    """
    known = {}
    if json is None:
        want = records.sparkSession.createDataFrame([], known_schema(layouts)).schema
        for f in want:
            if f.name in records.columns:
                have = records.schema[f.name].dataType
                inner = getattr(getattr(have, "elementType", None), "names", None)
                if f.dataType.typeName() == "array" and inner is not None and set(f.dataType.elementType.names) & set(inner):
                    known[f.name] = F.transform(records[f.name], _known(f.dataType.elementType.names, inner))
                elif f.dataType.typeName() == "string" and have.typeName() in ("string", "varchar", "char"):
                    known[f.name] = F.col(f"`{f.name}`")
        rows = records
    else:
        rows = records.withColumn("_record", F.from_json(F.col(f"`{json}`"), known_schema(layouts), {"mode": "PERMISSIVE"}))
        known = {f.name: F.col(f"_record.`{f.name}`") for f in rows.schema["_record"].dataType}
    by_hash = F.create_map(*chain.from_iterable((F.xxhash64(F.lit(p)), F.lit(name)) for p, name in fingerprints(layouts).items()))
    rows = rows.withColumn("layout", F.try_element_at(by_hash, fingerprint(known, layouts)))
    turns = F.lit(None).cast("array<struct<role: string, text: string>>")
    for x in layouts:
        reads = [s.field for s in x.steps if isinstance(s, Listed)] + [f for s in x.steps if isinstance(s, Part) for f in s.fields if f not in s.optional]
        if all(f in known for f in reads):
            turns = F.when(F.col("layout") == x.name, _turns(x, known)).otherwise(turns)
    return rows.withColumn("turns", turns).drop("_record")


def _pieces(turns: Column, template: Template) -> Column:
    """What stands in the output, piece by piece; `loss` tells what is learned from."""
    piece = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    return F.flatten(
        F.transform(
            turns,
            lambda t: F.array(
                piece(F.concat(F.lit(template.opening), template.escaped(t["role"]), F.lit(template.between)), F.lit(False)),
                piece(template.escaped(t["text"]), t["role"].isin(*template.learned)),
                piece(F.lit(template.closing), F.lit(False)),
            ),
        )
    )


def formatted(records: DataFrame, key: str = "conv_id", place: str = "turn", template: Template = Template(), json: str | None = None, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:  # noqa: B008, frozen
    """key, layout, pieces (array<struct<text, loss>>) and formatted, the pieces' texts one after another.

    A record that holds its whole conversation is a row, and is not shuffled. Records of one turn each are joined by
    `key`, ordered by `place`, null ones first, ties by role and text; rows that are repeated are turns of their own, and
    rows without key are one conversation. A null text or role is an empty one. A record without a mapping stays, with
    nulls. No rows give no rows; other columns are not read. A conversation is one value, so it is bounded by the 2 GB
    of a Spark string and built by one task; turns are escaped before the shuffle.
    """
    rows = canonical(records, json, layouts)
    single = [x.name for x in layouts if any(isinstance(s, Turn) for s in x.steps)]
    rows = rows.select(F.col(f"`{key}`").alias("key"), (F.col(f"`{place}`") if place in rows.columns else F.lit(None).cast("long")).alias("place"), "layout", "turns", _pieces(F.col("turns"), template).alias("pieces"))
    whole = rows.where(F.col("layout").isNull() | ~F.col("layout").isin(*single)).select("key", "layout", "pieces")
    out = whole
    if all(f in records.columns for x in layouts for s in x.steps if isinstance(s, Turn) for f in (s.role, s.text)) or json is not None:
        joined = (
            rows.where(F.col("layout").isin(*single))
            .groupBy("key", "layout")
            .agg(F.sort_array(F.collect_list(F.struct("place", "turns", "pieces"))).alias("all"))
            .select("key", "layout", F.flatten(F.transform("all", lambda r: r["pieces"])).alias("pieces"))
        )
        out = whole.unionByName(joined)
    return out.select(F.col("key").alias(key), "layout", "pieces", F.array_join(F.transform("pieces", lambda p: p["text"]), "").alias("formatted"))


def read_back(text: Column, template: Template = Template()) -> Column:  # noqa: B008, frozen
    """array<struct<role, text>> that a formatted text says."""
    quoted = lambda x: re.escape(x)
    turns = F.filter(F.split(text, quoted(template.closing)), lambda x: x != "")

    def one(turn: Column) -> Column:
        two = F.split(F.substring(turn, len(template.opening) + 1, 2**31 - 1), quoted(template.between), 2)
        return F.struct(template.plain(two[0]).alias("role"), template.plain(two[1]).alias("text"))

    return F.transform(turns, one)


def learned(pieces: Column, template: Template = Template()) -> Column:  # noqa: B008, frozen
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(F.filter(pieces, lambda p: p["loss"]), lambda p: template.plain(p["text"])), "")


def digests(chats: DataFrame, key: str = "conv_id", template: Template = Template()) -> DataFrame:  # noqa: B008, frozen
    """key, n_turns, turns_sha256, loss_chars, loss_sha256 and formatted_chars, read back from `formatted` and its mask; nulls for records without a mapping."""
    back = chats.select(F.col(f"`{key}`"), "formatted", read_back(F.col("formatted"), template).alias("turns"), learned(F.col("pieces"), template).alias("learned"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        F.col(f"`{key}`"),
        F.when(F.col("turns").isNotNull(), F.size("turns")).cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.char_length("learned").cast("long").alias("loss_chars"),
        F.sha2("learned", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )
