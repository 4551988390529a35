"""Chat formatting by schema fingerprints, with DataFrame functions only.

Records of unlike layouts (turn tables, message lists, instructions, prompts with answers) are told apart by a fingerprint:
a hash of their nested fields, by name, written as one text (``OBJECT<messages: ARRAY<OBJECT<content, role>>>``); for tables
it is made from the schema, for JSON from each record. Each known fingerprint selects a declarative mapping to canonical
turns (conv_id, turn, role, text). Canonical turns are formatted by one template, ``<turn role>text</turn>`` and a line feed.
Inside roles and texts, ``\\``, ``<`` and ``>`` are written ``\\0``, ``\\1`` and ``\\2``, so no text can forge a mark, and reading
the output back gives the very turns.

Defined cases: a null text or role is empty; turns of a conversation come by turn (null first), then role, then text, so
ties and repeated rows have one order and all stay; rows with a null conv_id are one conversation; a conversation without
an assistant turn has an empty loss mask; an empty table gives no rows; columns that no table layout names are ignored; a
table of an unknown layout (a column missing, or nested where a scalar is wanted) is a ValueError; records of an unknown layout are returned by
``unmapped``. A conversation is formatted in one row, so it must fit a task's memory.
"""

from __future__ import annotations

import hashlib
from collections.abc import Collection, Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

ESCAPES = [("\\", "\\0"), ("<", "\\1"), (">", "\\2")]
TURNS = "array<struct<turn:bigint,role:string,text:string>>"


@dataclass(frozen=True)
class Layout:
    """A record layout: its field paths, and how it maps to turns.

    ``single`` lists (role, path) for layouts with one field per turn (absent or empty optional fields give no turn);
    ``many`` gives (list path, role field, text field) for layouts with a list of messages; ``rows`` gives the columns
    (turn, role, text) of a table with a row for each turn.
    """

    name: str
    paths: tuple[str, ...]
    single: tuple[tuple[str, str], ...] = ()
    many: tuple[str, str, str] | None = None
    rows: tuple[str, str, str] | None = None


LAYOUTS = [
    Layout("turn rows", ("conv_id", "role", "text", "turn"), rows=("turn", "role", "text")),
    Layout("messages", ("messages[].content", "messages[].role"), many=("messages", "role", "content")),
    Layout("from and value", ("conversations[].from", "conversations[].value"), many=("conversations", "from", "value")),
    Layout("instruction", ("instruction", "output"), single=(("user", "instruction"), ("assistant", "output"))),
    Layout("instruction with input", ("input", "instruction", "output"), single=(("user", "instruction"), ("user", "input"), ("assistant", "output"))),
    Layout("prompt and response", ("prompt", "response"), single=(("user", "prompt"), ("assistant", "response"))),
    Layout("prompt and completion", ("completion", "prompt"), single=(("user", "prompt"), ("assistant", "completion"))),
    Layout("system and prompt", ("prompt", "response", "system"), single=(("system", "system"), ("user", "prompt"), ("assistant", "response"))),
    Layout("question and answer", ("answer", "question"), single=(("user", "question"), ("assistant", "answer"))),
]
#: Names that mean one of the canonical roles.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def schema_shape(kind: T.DataType, only: Collection[str] | None = None) -> str:
    """The text of a schema's nested field names, without the scalars' types; ``only``: the top fields that count."""
    if isinstance(kind, T.StructType):
        fields = sorted((f for f in kind.fields if only is None or f.name in only), key=lambda f: f.name)
        inner = [(f.name, schema_shape(f.dataType)) for f in fields]
        return f"OBJECT<{', '.join(n if not x else f'{n}: {x}' for n, x in inner)}>"
    if isinstance(kind, T.ArrayType):
        return f"ARRAY<{schema_shape(kind.elementType)}>"
    return ""


def _shape(value: Column) -> Column:
    """The same text of a JSON value."""
    schema = F.schema_of_variant(value)
    return F.regexp_replace(schema, r": (?!OBJECT|ARRAY)[A-Z]+(\([0-9, ]*\))?", "")


def layout_shape(layout: Layout) -> str:
    """The text that _shape gives for records of a layout: fields by name, lists as ARRAY<OBJECT<...>>."""
    if layout.many:
        name, role, text = layout.many
        return f"OBJECT<{name}: ARRAY<OBJECT<{', '.join(sorted([role, text]))}>>>"
    return f"OBJECT<{', '.join(sorted(layout.paths))}>"


def fingerprint(shape: str) -> str:
    return hashlib.sha256(shape.encode()).hexdigest()


def with_fingerprint(records: DataFrame, column: str) -> DataFrame:
    """``records`` with __json (a variant) and __fp, the fingerprint of the record."""
    return records.withColumn("__json", F.try_parse_json(F.col(column))).withColumn("__fp", F.sha2(_shape(F.col("__json")), 256))


def _turns(layout: Layout) -> Column:
    get = lambda path, kind: F.try_variant_get(F.col("__json"), f"$.{path}", kind)
    if layout.many:
        name, role, text = layout.many
        items = get(name, f"array<struct<`{role}`:string,`{text}`:string>>")
        return F.transform(items, lambda m, i: F.struct(i.cast("bigint").alias("turn"), m[role].alias("role"), m[text].alias("text"))).cast(TURNS)
    parts = [F.struct(F.lit(k).cast("bigint").alias("turn"), F.lit(role).alias("role"), get(path, "string").alias("text")) for k, (role, path) in enumerate(layout.single)]
    needed = {layout.single[-1][1], "prompt", "instruction", "question"}
    wanted = F.array(*[F.lit(path in needed) for _, path in layout.single])
    return F.filter(F.array(*parts), lambda t: F.coalesce(F.length(t["text"]) > 0, F.lit(False)) | F.element_at(wanted, t["turn"].cast("int") + 1)).cast(TURNS)


def with_roles(turns: DataFrame, roles: Mapping[str, str]) -> DataFrame:
    """``turns`` with roles by their canonical names; others stay as they are."""
    if not roles:
        return turns
    names = F.create_map(*[F.lit(x) for pair in roles.items() for x in pair])
    return turns.withColumn("role", F.coalesce(F.element_at(names, F.lower("role")), F.col("role")))


def turns_of_records(records: DataFrame, conv_id: str, column: str, layouts: list[Layout] = LAYOUTS, roles: Mapping[str, str] = ROLES) -> DataFrame:
    """Canonical turns of JSON records in one column; each record's fingerprint selects its mapping."""
    known = [x for x in layouts if not x.rows]
    told = with_fingerprint(records.select(F.col(conv_id).alias("conv_id"), F.col(column).alias("__text")), "__text")
    of = lambda x: F.lit(fingerprint(layout_shape(x)))
    turns = reduce(lambda out, x: out.when(F.col("__fp") == of(x), _turns(x)), known[1:], F.when(F.col("__fp") == of(known[0]), _turns(known[0])))
    flat = told.select("conv_id", F.explode(turns).alias("t")).select("conv_id", "t.turn", "t.role", "t.text")
    return with_roles(flat, roles)


def unmapped(records: DataFrame, column: str, layouts: list[Layout] = LAYOUTS) -> DataFrame:
    """The records that no mapping fits, with their fingerprint in __fp."""
    shapes = [fingerprint(layout_shape(x)) for x in layouts if not x.rows]
    told = with_fingerprint(records, column).drop("__json")
    return told.filter(F.col("__fp").isNull() | ~F.col("__fp").isin(shapes))


def canonical_turns(table: DataFrame, layouts: list[Layout] = LAYOUTS, roles: Mapping[str, str] = ROLES) -> DataFrame:
    """Canonical turns of a table with a row for each turn; the fingerprint of those of its fields that table layouts name
    selects its mapping."""
    known = {fingerprint(layout_shape(x)): x for x in layouts if x.rows}
    named = {p for x in known.values() for p in x.paths}
    found = known.get(fingerprint(schema_shape(table.schema, named)))
    if found is None:
        raise ValueError(f"no layout has the fields {schema_shape(table.schema)}")
    turn, role, text = found.rows
    out = table.select("conv_id", F.col(turn).cast("bigint").alias("turn"), F.col(role).cast("string").alias("role"), F.col(text).cast("string").alias("text"))
    return with_roles(out, roles)


def escaped(text: Column) -> Column:
    return reduce(lambda c, x: F.replace(c, F.lit(x[0]), F.lit(x[1])), ESCAPES, F.coalesce(text, F.lit("")))


def unescaped(text: Column) -> Column:
    return reduce(lambda c, x: F.replace(c, F.lit(x[1]), F.lit(x[0])), reversed(ESCAPES), text)


def format_turns(turns: DataFrame) -> DataFrame:
    """conv_id, formatted (the whole conversation) and loss_spans (start and length, in code points, of the assistant's
    texts in it)."""
    head = F.concat(F.lit("<turn "), escaped(F.col("role")), F.lit(">"))
    body = escaped(F.col("text"))
    rows = turns.select("conv_id", "turn", F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    rows = rows.select("conv_id", "turn", "role", "text", head.alias("__head"), body.alias("__body"))
    rows = rows.withColumn("__size", F.length("__head") + F.length("__body") + F.lit(len("</turn>\n")))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = rows.withColumn("__pos", F.row_number().over(order)).withColumn("__end", F.sum("__size").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    span = F.when(F.col("role") == "assistant", F.struct((F.col("__end") - F.col("__size") + F.length("__head")).alias("start"), F.length("__body").cast("bigint").alias("length")))
    piece = F.struct(F.col("__pos").alias("pos"), F.concat("__head", "__body", F.lit("</turn>\n")).alias("piece"), span.alias("span"))
    out = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(piece)).alias("p"))
    return out.select("conv_id", F.array_join(F.col("p.piece"), "").alias("formatted"), F.filter(F.col("p.span"), lambda s: s.isNotNull()).alias("loss_spans"))


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, turns (role and text, unescaped) and loss_text, all read from what format_turns wrote."""
    every = F.lit(r"<turn ([^>]*)>([^<]*)</turn>\n")
    part = lambda k: F.regexp_extract_all("formatted", every, F.lit(k))
    turns = F.arrays_zip(F.transform(part(1), unescaped).alias("role"), F.transform(part(2), unescaped).alias("text"))
    loss = F.transform("loss_spans", lambda s: unescaped(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int"))))
    return formatted.select("conv_id", "formatted", turns.alias("turns"), F.array_join(loss, "").alias("loss_text"))
