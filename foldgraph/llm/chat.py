"""Chat formatting by schema fingerprint (DataFrame functions only).

A record's nested field paths, as far as a mapping uses them, are hashed; the hash
picks the declarative mapping that says where the turns are, so other fields are no
matter.  Of several, the one with the most paths is taken.  Records of different layouts
can be mixed in one column of JSON text.  Every layout ends as canonical turns
``(role, text)``, which a reversible template turns into one string with a loss
mask over the assistants' texts.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import unused

OPEN, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
#: Strings that a text must not bring into the output: our own and those of common templates.
CONTROL = [OPEN, SEP, END, "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"]
_TAILS = "|".join(re.escape(c[1:]).replace("/", "/") for c in CONTROL)
_ESCAPE = r"([<\[])(\\*)(" + _TAILS + ")"
_UNESCAPE = r"([<\[])\\(\\*)(" + _TAILS + ")"
#: Turn numbers of one chunk.  A conversation of any length is formatted in chunks.
CHUNK = 64


def hashed(paths) -> str:
    return hashlib.sha256(", ".join(sorted(paths)).encode()).hexdigest()[:16]


@dataclass(frozen=True)
class Layout:
    """Where a record keeps its turns.

    ``pairs``: role and top-level field of each turn, in order; then ``many``: array
    field, role field, text field; or ``row``: fields of a record that is one turn.
    """

    name: str
    pairs: tuple[tuple[str, str], ...] = ()
    many: tuple[str, str, str] | None = None
    row: tuple[str, ...] = ()
    rename: dict[str, str] = field(default_factory=lambda: {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"})

    @property
    def paths(self) -> list[str]:
        """The field paths that the mapping uses, sorted."""
        array = [f"{self.many[0]}[].{x}" for x in self.many[1:]] if self.many else []
        return sorted([*(x for _, x in self.pairs), *array, *self.row])

    @property
    def fingerprint(self) -> str:
        return hashed(self.paths)


_PAIRS = [
    ("prompt_response", (("user", "prompt"), ("assistant", "response"))),
    ("prompt_completion", (("user", "prompt"), ("assistant", "completion"))),
    ("question_answer", (("user", "question"), ("assistant", "answer"))),
    ("instruction", (("user", "instruction"), ("assistant", "output"))),
    ("instruction_input", (("user", "instruction"), ("user", "input"), ("assistant", "output"))),
]
_MANY = [("messages", ("messages", "role", "content")), ("conversations", ("conversations", "from", "value")), ("turns", ("turns", "role", "text"))]
_SYSTEM = (("system", "system"),)
#: A table with one row for each turn, or a record of one turn.
TURN_ROWS = Layout("turn_rows", row=("conv_id", "role", "text", "turn"))
#: Each layout also with a system text of its own field.  Arrays come first: where paths are as many, the first is taken.
LAYOUTS = [
    *(Layout(name, many=many) for name, many in _MANY), *(Layout(f"system_{name}", _SYSTEM, many) for name, many in _MANY),
    *(Layout(name, pairs) for name, pairs in _PAIRS), *(Layout(f"system_{name}", _SYSTEM + pairs) for name, pairs in _PAIRS),
    TURN_ROWS,
]

_TURNS = "array<struct<role:string,text:string>>"


def paths_of(schema: T.DataType, at: str = "") -> set[str]:
    """The nested field paths of a Spark type that hold scalars, in the notation of ``Layout.paths``."""
    if isinstance(schema, T.StructType):
        return {p for f in schema.fields for p in paths_of(f.dataType, f"{at}.{f.name}" if at else f.name)}
    if isinstance(schema, T.ArrayType):
        return paths_of(schema.elementType, f"{at}[]")
    return {at}


def layout_of(paths: set[str], layouts: list[Layout] = LAYOUTS) -> Layout | None:
    """The mapping for a table with these field paths, by the same hashes as for records."""
    found = [x for x in layouts if hashed(p for p in x.paths if p in paths) == x.fingerprint]
    return max(found, key=lambda x: len(x.paths), default=None)


def _elements(v: Column, array: str) -> Column:
    return F.try_variant_get(v, f"$.{array}", "array<variant>")


def _has(v: Column, path: str) -> Column:
    """Has the record this path?  Null values count; of an array, any element may have it."""
    if "[]." not in path:
        return F.try_variant_get(v, f"$.{path}", "variant").isNotNull()
    array, name = path.split("[].")
    return F.exists(_elements(v, array), lambda e: F.try_variant_get(e, f"$.{name}", "variant").isNotNull())


def record_fingerprint(v: Column, layout: Layout) -> Column:
    """Hash of those of a layout's field paths that a record, a variant, has."""
    held = F.concat_ws(", ", *[F.when(_has(v, p), F.lit(p)) for p in layout.paths])
    return F.substring(F.sha2(F.encode(held, "UTF-8"), 256), 1, 16)


def _turns(v: Column, layout: Layout) -> Column:
    pairs = [(F.lit(role), name) for role, name in layout.pairs]
    made = [F.struct(role.alias("role"), F.try_variant_get(v, f"$.{name}", "string").alias("text")) for role, name in pairs]
    turns = F.filter(F.array(*made).cast(_TURNS), lambda t: t["text"].isNotNull() & (t["text"] != ""))
    if layout.row:
        return F.array(F.struct(F.try_variant_get(v, "$.role", "string").alias("role"), F.try_variant_get(v, "$.text", "string").alias("text"))).cast(_TURNS)
    if layout.many:
        array, role, text = layout.many
        renamed = F.create_map(*[F.lit(x) for pair in layout.rename.items() for x in pair])
        said = F.transform(_elements(v, array), lambda e: F.struct(F.try_variant_get(e, f"$.{role}", "string").alias("role"), F.try_variant_get(e, f"$.{text}", "string").alias("text")))
        turns = F.concat(turns, F.transform(said, lambda t: F.struct(F.coalesce(renamed[t["role"]], t["role"]).alias("role"), t["text"].alias("text"))).cast(_TURNS))
    return turns


def records_to_turns(records: DataFrame, record: str = "record", layouts: list[Layout] = LAYOUTS) -> DataFrame:
    """``records`` with ``layout``, ``chunk`` (0) and ``turns`` from a column of JSON text.

    Records of no known layout, and null or broken JSON, stay: layout ``unknown``,
    no turns.  Fields that no layout uses are no matter.  Empty fields of prompt and
    instruction layouts are no turns.
    """
    v = unused(records, "__v")[0]
    out = records.withColumn(v, F.try_parse_json(F.col(record)))
    name, turns = F.lit("unknown"), F.array().cast(_TURNS)
    for x in sorted(reversed(layouts), key=lambda x: len(x.paths)):  # the last that fits is tried first
        fits = record_fingerprint(F.col(v), x) == x.fingerprint
        name = F.when(fits, x.name).otherwise(name)
        turns = F.when(fits, _turns(F.col(v), x)).otherwise(turns)
    return out.withColumn("layout", name).withColumn("chunk", F.lit(0).cast("bigint")).withColumn("turns", F.coalesce(turns, F.array().cast(_TURNS))).drop(v)


def rows_to_turns(rows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """``(conv_id, layout, chunk, turns)`` from a table of one row per turn.

    Turns are ordered by number, ties by role and text (repeated rows stay); null
    numbers come first; null roles and texts are empty.  A row holds the turns of
    ``chunk`` consecutive numbers of a conversation, so a conversation with very
    many turns is spread over tasks.
    """
    if layout_of(paths_of(rows.schema), [TURN_ROWS]) is None:
        raise ValueError("turn rows need the scalar columns conv_id, turn, role and text")
    part = F.floor(F.col("turn") / chunk).cast("bigint").alias("chunk")
    turn = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    held = rows.groupBy("conv_id", part).agg(F.sort_array(F.collect_list(turn)).alias("t"))
    turns = F.transform("t", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    return held.select("conv_id", F.lit(TURN_ROWS.name).alias("layout"), "chunk", turns.alias("turns"))


def to_turns(table: DataFrame, record: str = "record") -> DataFrame:
    """Canonical turns of a table, by the fingerprint of what it holds.

    One row per turn; or a column of JSON records; or records in columns, whose own
    field paths choose the mapping.  Extra columns are kept in the second case.
    """
    if layout_of(paths_of(table.schema)) is TURN_ROWS:
        return rows_to_turns(table)
    if record in table.columns:
        return records_to_turns(table, record)
    return records_to_turns(table.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias(record)), record)


def escaped(text: Column) -> Column:
    """Breaks each control string by a backslash after its first character; reversible."""
    return F.regexp_replace(text, _ESCAPE, r"$1\\$2$3")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, _UNESCAPE, "$1$2$3")


def formatted(turns: DataFrame, trained: str = "assistant") -> DataFrame:
    """``turns`` with ``formatted`` and ``loss_mask`` in place of the turns.

    ``loss_mask``: the runs ``[first, end)`` of code points of ``formatted`` that hold
    the text of a turn whose role is ``trained``, in order.
    """
    own, ends = unused(turns, "__parts", "__ends")
    parts = F.transform("turns", lambda t: F.struct(
        F.concat(F.lit(OPEN), escaped(F.coalesce(t["role"], F.lit(""))), F.lit(SEP)).alias("head"),
        escaped(F.coalesce(t["text"], F.lit(""))).alias("body"), F.coalesce(t["role"] == trained, F.lit(False)).alias("loss")))
    out = turns.withColumn(own, parts)
    size = F.transform(own, lambda p: F.length(p["head"]) + F.length(p["body"]) + len(END))
    out = out.withColumn(ends, size)
    begin = lambda i: F.aggregate(F.slice(ends, F.lit(1), i), F.lit(0), lambda a, x: a + x)
    runs = F.transform(own, lambda p, i: F.struct(
        (begin(i) + F.length(p["head"])).alias("first"), (begin(i) + F.length(p["head"]) + F.length(p["body"])).alias("end"), p["loss"].alias("loss")))
    mask = F.transform(F.filter(runs, lambda r: r["loss"]), lambda r: F.struct(r["first"].alias("first"), r["end"].alias("end")))
    text = F.array_join(F.transform(own, lambda p: F.concat(p["head"], p["body"], F.lit(END))), "")
    return out.withColumn("formatted", text).withColumn("loss_mask", mask).drop("turns", own, ends)


def read_turns(text: Column) -> Column:
    """The turns that a formatted string holds."""
    pieces = F.split(text, re.escape(END), -1)
    whole = F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0)))
    head = lambda p: F.substring_index(p, SEP, 1)
    return F.transform(whole, lambda p: F.struct(
        unescaped(F.substr(head(p), F.lit(len(OPEN) + 1))).alias("role"), unescaped(F.substr(p, F.length(head(p)) + len(SEP) + 1)).alias("text")))


def read_loss(text: Column, mask: Column) -> Column:
    """The texts under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(mask, lambda r: unescaped(F.substr(text, r["first"] + 1, r["end"] - r["first"]))), "")
