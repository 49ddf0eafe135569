"""Chat records of many layouts as canonical turns, and turns as one training text.

The layout of a record or table is recognised by a fingerprint: the hash of its
sorted nested field paths, as far as a mapping needs them. A lookup of fingerprints
selects a declarative mapping, which says where the turns are: in an array, in
fields, or in rows of their own. The text format marks turns with control strings; such
strings inside a role or text are escaped, and both can be read back. Only
DataFrame functions are used.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadstats.llm.common import let, without

TURNS = "array<struct<role:string,text:string>>"


def paths(kind: T.DataType, prefix: str = "$") -> list[str]:
    """Nested field paths of a type; an array adds ``[]``. Leaves have no type."""
    if isinstance(kind, T.StructType):
        return sorted(p for f in kind.fields for p in paths(f.dataType, f"{prefix}.{f.name}"))
    if isinstance(kind, T.ArrayType):
        return paths(kind.elementType, f"{prefix}[]")
    return [prefix]


def fingerprint_of(found: list[str]) -> str:
    return hashlib.sha256("\n".join(sorted(found)).encode()).hexdigest()[:16]


def schema_fingerprint(kind: T.DataType) -> str:
    """Hash of the sorted nested field paths of a table's or record's type."""
    return fingerprint_of(paths(kind))


@dataclass(frozen=True)
class Mapping:
    """Where a layout has its turns.

    Fields may be paths with dots. Either ``turns`` is the array of turns and ``role`` and ``text`` the fields of
    one, or ``fixed`` lists (role, field) of the turns, of which missing ones are
    left out, or the layout is that of a row, ``key`` names the conversation and
    ``order`` the turn's place. ``roles`` renames roles.
    """

    name: str
    layout: str
    turns: str | None = None
    role: str = "role"
    text: str = "content"
    fixed: tuple[tuple[str, str], ...] = ()
    roles: tuple[tuple[str, str], ...] = ()
    key: str | None = None
    order: str | None = None

    @property
    def kind(self) -> T.DataType:
        return T._parse_datatype_string(self.layout)

    @property
    def fingerprint(self) -> str:
        return schema_fingerprint(self.kind)


_SPOKEN = (("human", "user"), ("gpt", "assistant"), ("bot", "assistant"), ("model", "assistant"))

#: Layouts known from the start; add more with the same fields.
MAPPINGS = (
    Mapping("messages", "messages array<struct<role:string,content:string>>", "messages"),
    Mapping("turns", "turns array<struct<role:string,text:string>>", "turns", text="text"),
    Mapping(
        "conversations",
        "conversations array<struct<from:string,value:string>>",
        "conversations",
        "from",
        "value",
        roles=_SPOKEN,
    ),
    Mapping(
        "instruction",
        "instruction string, input string, output string",
        fixed=(("user", "instruction"), ("user", "input"), ("assistant", "output")),
    ),
    Mapping(
        "instruction_only",
        "instruction string, output string",
        fixed=(("user", "instruction"), ("assistant", "output")),
    ),
    Mapping(
        "prompt", "prompt string, response string", fixed=(("user", "prompt"), ("assistant", "response"))
    ),
    Mapping(
        "system_prompt",
        "system string, prompt string, response string",
        fixed=(("system", "system"), ("user", "prompt"), ("assistant", "response")),
    ),
    Mapping(
        "question", "question string, answer string", fixed=(("user", "question"), ("assistant", "answer"))
    ),
)


#: Layout of a table that has one turn a row.
TURN_ROWS = "conv_id bigint, turn bigint, role string, text string"
ROWS = Mapping("turn_rows", TURN_ROWS, text="text", key="conv_id", order="turn")


@dataclass(frozen=True)
class Entry:
    """A line of the lookup: of the ``among`` paths a record must have those of ``fingerprint``."""

    among: tuple[str, ...]
    fingerprint: str
    mapping: Mapping


def lookup(mappings: tuple[Mapping, ...] = (*MAPPINGS, ROWS)) -> list[Entry]:
    """The lookup of fingerprints. Of several that fit, the first counts: more paths first, then as listed.

    Only the paths that a mapping needs are hashed, so other fields do not matter. An
    empty array of turns, which has no paths below it, is a line of its own.
    """
    full = [Entry(tuple(paths(m.kind)), m.fingerprint, m) for m in mappings]
    full.sort(key=lambda e: -len(e.among))
    empty = [f"$.{m.turns}[]" for m in mappings if m.turns]
    owners = [m for m in mappings if m.turns]
    none = [Entry((*paths(m.kind), e), fingerprint_of([e]), m) for e, m in zip(empty, owners, strict=True)]
    return full + none


def json_paths(record: Column, entries: list[Entry]) -> Column:
    """The sorted field paths of a JSON record, as far as any of the ``entries`` looks; none if it is no JSON.

    They are those of the record itself, so records of one column may differ. Types
    do not count: a field that is a text in one turn and a list in another is one
    path. An array of turns has the fields of any of them, an empty one the path ``[]``.
    """
    none = F.array().cast("array<string>")
    found = []
    for box in sorted({p.rsplit(".", 1)[0] for e in entries for p in e.among if not p.endswith("[]")}):
        inside = F.get_json_object(record, box.removesuffix("[]")) if box != "$" else record
        if box.endswith("[]"):
            turns = F.from_json(inside, "array<map<string,string>>")
            keys = F.array_distinct(F.flatten(F.transform(turns, lambda t: F.coalesce(F.map_keys(t), none))))
            found.append(F.when(F.json_array_length(inside) == 0, F.array(F.lit(box))).otherwise(none))
        else:
            keys = F.json_object_keys(inside)
        start = F.lit(box + ".")
        found.append(F.transform(keys, lambda k: F.concat(start, k)))  # noqa: B023
    return F.array_sort(F.array_distinct(F.concat(*[F.coalesce(f, none) for f in found])))


def _turns(value: Column, mapping: Mapping) -> Column:
    """Canonical turns of a record ``value`` of the mapping's layout."""

    def named(role: Column) -> Column:
        out = role
        for old, new in mapping.roles:
            out = F.when(role == old, new).otherwise(out)
        return out

    def at(path: str) -> Column:
        return reduce(lambda v, name: v[name], path.split("."), value)

    if mapping.turns:
        return F.transform(
            at(mapping.turns),
            lambda t: F.struct(named(t[mapping.role]).alias("role"), t[mapping.text].alias("text")),
        )
    cells = [F.struct(F.lit(r).alias("role"), at(f).alias("text")) for r, f in mapping.fixed]
    return F.filter(F.array(*cells), lambda t: t["text"].isNotNull() & (t["text"] != ""))


def canonical_turns(records: DataFrame, column: str, mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """``records`` with ``layout`` (a mapping's name) and ``turns``, the canonical turns.

    ``column`` holds one JSON record a row, each with a layout of its own. The
    hashes of a record's field paths are looked up among those of the mappings
    (:func:`lookup`, which states the order of several that fit). Other fields
    don't matter; an empty array has no turns; a text that is a list or object in a
    turn is its JSON, a missing one NULL. A record that is no JSON, or of a layout
    without a mapping, keeps its row with NULL in both columns. Clashing columns
    ``layout`` and ``turns`` are replaced.
    """
    rest = without(records, "layout", "turns")
    entries = lookup(tuple(m for m in mappings if not m.key))
    layout, turns = F.lit(None).cast("string"), F.lit(None).cast(TURNS)
    for e in reversed(entries):
        own = F.array_intersect(F.col("_paths"), F.array(*map(F.lit, e.among)))
        hit = F.substring(F.sha2(F.array_join(own, "\n"), 256), 1, 16) == e.fingerprint
        value = F.from_json(column, e.mapping.layout)
        layout = F.when(hit, e.mapping.name).otherwise(layout)
        turns = F.when(hit, _turns(value, e.mapping).cast(TURNS)).otherwise(turns)
    found = records.select(*rest, json_paths(F.col(column), entries).alias("_paths"))
    return found.select(*rest, layout.alias("layout"), turns.alias("turns"))


def select_mapping(kind: T.StructType, mappings: tuple[Mapping, ...] = (*MAPPINGS, ROWS)) -> Mapping:
    """The mapping of a table, looked up by the fingerprints of its field paths. Raises if there is none."""
    own = set(paths(kind))
    for e in lookup(mappings):
        if fingerprint_of([p for p in e.among if p in own]) == e.fingerprint:
            return e.mapping
    raise ValueError(f"no mapping gives turns of {sorted(own)}")


def table_turns(table: DataFrame, mappings: tuple[Mapping, ...] = (*MAPPINGS, ROWS)) -> DataFrame:
    """``turns`` (and what names them) from a table of any known layout, selected by its fingerprint.

    A layout of records gives each row's other columns and ``turns``. A layout of rows
    gives the key and ``turns``, one row for each conversation: turns are ordered
    by their place, then role and text (NULL last), so repeated or unnumbered turns
    have a defined place; all rows with a NULL key form one conversation; a NULL
    role or text is an empty one; columns beyond the layout are dropped before; one
    conversation is one record and is held by one task.
    """
    m = select_mapping(table.schema, mappings)
    if not m.key:
        fields = {p.split(".")[1].removesuffix("[]") for p in paths(m.kind)}
        turns = _turns(F.struct(*[F.col(f) for f in sorted(fields)]), m).cast(TURNS)
        rest = [c for c in table.columns if c not in fields and c != "turns"]
        return table.select(*rest, turns.alias("turns"))
    key = F.struct(
        F.col(m.order).isNull().alias("last"),
        F.col(m.order),
        F.coalesce(m.role, F.lit("")).alias("role"),
        F.coalesce(m.text, F.lit("")).alias("text"),
    )
    held = table.groupBy(m.key).agg(F.sort_array(F.collect_list(key)).alias("_turns"))
    return held.select(
        m.key,
        F.transform("_turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"),
    )


# The format: <s>[INST]role[/INST]text</s> for each turn.
OPEN, CLOSE, END = "<s>[INST]", "[/INST]", "</s>"


def escape(text: Column) -> Column:
    """``text`` in which no control string occurs: a backslash goes behind its first character."""
    plain = F.coalesce(text, F.lit(""))
    once = F.regexp_replace(plain, r"<(\\*)(/?s>)", r"<\\$1$2")
    return F.regexp_replace(once, r"\[(\\*)(/?INST\])", r"[\\$1$2")


def unescape(text: Column) -> Column:
    once = F.regexp_replace(text, r"<\\(\\*)(/?s>)", r"<$1$2")
    return F.regexp_replace(once, r"\[\\(\\*)(/?INST\])", r"[$1$2")


def format_turns(turns: Column, learn: str = "assistant") -> tuple[Column, Column]:
    """The formatted text of a conversation, and its segments with a loss mask.

    Segments ``text, loss`` concatenate to the formatted text; ``loss`` marks the
    texts of ``learn``. A NULL conversation has no segments and an empty text.
    """
    none = F.array().cast("array<struct<text:string,loss:boolean>>")

    def parts(t: Column) -> Column:
        head = F.concat(F.lit(OPEN), escape(t["role"]), F.lit(CLOSE))
        return F.array(
            F.struct(head.alias("text"), F.lit(False).alias("loss")),
            F.struct(escape(t["text"]).alias("text"), (F.coalesce(t["role"], F.lit("")) == learn).alias("loss")),
            F.struct(F.lit(END).alias("text"), F.lit(False).alias("loss")),
        )

    segments = F.coalesce(F.flatten(F.transform(turns, parts)), none)
    return F.array_join(F.transform(segments, lambda s: s["text"]), ""), segments


def parse_turns(formatted: Column) -> Column:
    """Turns read back from a formatted text."""
    pieces = F.split(formatted, END)

    def turn(piece: Column) -> Column:
        # The first closing string ends the role; escaped ones do not match.
        at = F.instr(piece, CLOSE)
        role = F.substring(piece, F.lit(len(OPEN) + 1), at - len(OPEN) - 1)
        text = F.substring(piece, at + len(CLOSE), F.length(piece))
        return F.struct(unescape(role).alias("role"), unescape(text).alias("text"))

    return let(pieces, lambda p: F.transform(F.slice(p, F.lit(1), F.greatest(F.size(p) - 1, F.lit(0))), turn))


def format_chat(conversations: DataFrame, learn: str = "assistant") -> DataFrame:
    """``conversations`` (with ``turns``) and ``formatted``, ``segments`` (with the loss mask)."""
    formatted, segments = format_turns(F.col("turns"), learn)
    return conversations.select(
        *without(conversations, "formatted", "segments"), formatted.alias("formatted"), segments.alias("segments")
    )


def chat_digest(formatted: DataFrame) -> DataFrame:
    """``conv_id`` and what reading ``formatted`` and ``segments`` back yields, as digests."""

    def joined(t: Column) -> Column:
        return F.array_join(F.transform(t, lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")

    learned = F.array_join(
        F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"])), ""
    )

    def row(turns: Column) -> Column:
        return F.struct(
            F.size(turns).cast("long").alias("n_turns"),
            F.sha2(F.encode(joined(turns), "UTF-8"), 256).alias("turns_sha256"),
            F.length("_learned").cast("long").alias("loss_chars"),
            F.sha2(F.encode(F.col("_learned"), "UTF-8"), 256).alias("loss_sha256"),
            F.length("formatted").cast("long").alias("formatted_chars"),
        )

    held = formatted.withColumn("_learned", learned)
    return held.select("conv_id", F.inline(F.array(let(parse_turns(F.col("formatted")), row))))
