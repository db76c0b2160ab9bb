"""Chat formatting: fingerprints of field paths select the mapping to canonical turns."""

from __future__ import annotations

from dataclasses import dataclass
from hashlib import sha256

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Layout:
    """A way to write conversations down: its field paths, and where role and text are found.

    `rows`: one row per turn, columns (order, role, text). `turns`: an array field and the element's (role,
    text). `fields`: (role, field) in the order of turns; several fields of a role are joined by an empty line.
    """

    paths: tuple[str, ...]
    rows: tuple[str, str, str] | None = None
    turns: tuple[str, str, str] | None = None
    fields: tuple[tuple[str, str], ...] = ()

    @property
    def fingerprint(self) -> str:
        return fingerprint(self.paths)


def fingerprint(paths) -> str:
    return sha256("\n".join(sorted(paths)).encode()).hexdigest()


#: Names that sources use for the three usual roles (fixed values).
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}

LAYOUTS = (
    Layout(("turn", "role", "text"), rows=("turn", "role", "text")),
    Layout(("messages[].role", "messages[].content"), turns=("messages", "role", "content")),
    Layout(("conversations[].from", "conversations[].value"), turns=("conversations", "from", "value")),
    Layout(("prompt", "completion"), fields=(("user", "prompt"), ("assistant", "completion"))),
    Layout(("prompt", "response"), fields=(("user", "prompt"), ("assistant", "response"))),
    Layout(("instruction", "output"), fields=(("user", "instruction"), ("assistant", "output"))),
    Layout(
        ("instruction", "input", "output"),
        fields=(("user", "instruction"), ("user", "input"), ("assistant", "output")),
    ),
    Layout(
        ("system", "prompt", "response"),
        fields=(("system", "system"), ("user", "prompt"), ("assistant", "response")),
    ),
)
_BY_FINGERPRINT = {layout.fingerprint: layout for layout in LAYOUTS}
_KNOWN_PATHS = sorted({path for layout in LAYOUTS for path in layout.paths})

BEGIN, TEXT, TEXT_END, END = "<s>", "[INST] ", " [/INST]", "</s>"


def schema_paths(kind: T.DataType, prefix: str = "") -> list[str]:
    """Paths of the leaves of a type; [] stands for the elements of an array."""
    if isinstance(kind, T.StructType):
        return [p for f in kind.fields for p in schema_paths(f.dataType, f"{prefix}.{f.name}" if prefix else f.name)]
    if isinstance(kind, T.ArrayType):
        return schema_paths(kind.elementType, f"{prefix}[]")
    return [prefix]


def layout_of(records: DataFrame) -> Layout:
    """The layout whose paths are those of the records; paths that no layout knows are left out first."""
    found = fingerprint(set(schema_paths(records.schema)) & set(_KNOWN_PATHS))
    if found not in _BY_FINGERPRINT:
        raise ValueError(f"no mapping for these fields: {schema_paths(records.schema)}")
    return _BY_FINGERPRINT[found]


def _role(role: Column) -> Column:
    names = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])
    return F.coalesce(F.element_at(names, F.lower(role)), role, F.lit(""))


def _array_turns(turns: Column, role: str, text: str) -> Column:
    return F.transform(turns, lambda t: F.struct(t[role].alias("role"), t[text].alias("text")))


def _field_turns(layout: Layout, at) -> Column:
    """Turns of a record with one field per part of a turn; empty optional parts are left out."""
    roles = list(dict.fromkeys(role for role, _ in layout.fields))
    turns = []
    for role in roles:
        parts = F.array(*[at(field) for own, field in layout.fields if own == role])
        text = F.array_join(F.filter(parts, lambda part: F.coalesce(part, F.lit("")) != ""), "\n\n")
        turns.append(F.struct(F.lit(role).alias("role"), text.alias("text")))
    return F.array(*turns)


def canonical_turns(records: DataFrame, id_col: str) -> DataFrame:
    """Rows (conv_id, turn, role, text) of records in any known layout; the fields' fingerprint selects the mapping.

    Rows by turn keep their turn. NULL roles and texts become empty. A record without turns gives no row.
    """
    layout = layout_of(records)
    key = F.col(id_col).alias("conv_id")
    if layout.rows:
        turn, role, text = layout.rows
        return records.select(
            key, F.col(turn).cast("long").alias("turn"), _role(F.col(role)).alias("role"),
            F.coalesce(F.col(text), F.lit("")).alias("text"),
        )
    if layout.turns:
        name, role, text = layout.turns
        parts = _array_turns(F.col(name), role, text)
    else:
        parts = _field_turns(layout, F.col)
    rows = records.select(key, F.posexplode(parts).alias("turn", "t"))
    text = F.coalesce("t.text", F.lit("")).alias("text")
    return rows.select("conv_id", F.col("turn").cast("long"), _role(F.col("t.role")).alias("role"), text)


def canonical_json(records: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """The same of JSON texts whose layout differs from row to row.

    Each text's fingerprint is taken over the known paths that it has. Columns: conv_id, layout (the
    fingerprint), turn, role, text. A text without a known layout, a broken and a NULL one give one row with
    NULL turn, role and text.
    """
    records = records.select(F.col(id_col).alias("conv_id"), F.col(json_col).alias("json"))
    text = F.col("json")
    has = [
        F.when(F.get_json_object(text, "$." + path.replace("[]", "[0]")).isNotNull(), F.lit(path))
        for path in _KNOWN_PATHS
    ]
    found = F.sha2(F.array_join(F.array_sort(F.filter(F.array(*has), lambda p: p.isNotNull())), "\n"), 256)
    turns = F.lit(None).cast("array<struct<role:string,text:string>>")
    for layout in LAYOUTS:
        if layout.rows:
            continue
        if layout.turns:
            name, role, body = layout.turns
            kind = f"struct<`{name}`: array<struct<`{role}`: string, `{body}`: string>>>"
            own = _array_turns(F.from_json(text, kind)[name], role, body)
        else:
            own = _field_turns(layout, lambda field: F.get_json_object(text, f"$.{field}"))
        turns = F.when(F.col("layout") == layout.fingerprint, own).otherwise(turns)
    rows = records.select("conv_id", "json", found.alias("layout"))
    rows = rows.select("conv_id", "layout", F.posexplode_outer(turns).alias("turn", "t"))
    role = F.when(F.col("turn").isNotNull(), _role(F.col("t.role")))
    body = F.when(F.col("turn").isNotNull(), F.coalesce("t.text", F.lit("")))
    return rows.select("conv_id", "layout", F.col("turn").cast("long"), role.alias("role"), body.alias("text"))


def escaped(text: Column) -> Column:
    r"""No control string is left: they all begin with < or [, which become \l and \b; \ becomes \e."""
    for char, mark in (("\\", "\\e"), ("<", "\\l"), ("[", "\\b")):
        text = F.replace(text, F.lit(char), F.lit(mark))
    return text


def unescaped(text: Column) -> Column:
    for char, mark in (("<", "\\l"), ("[", "\\b"), ("\\", "\\e")):
        text = F.replace(text, F.lit(mark), F.lit(char))
    return text


def formatted(turns: DataFrame, learn_from: str = "assistant") -> DataFrame:
    """Rows (conv_id, formatted, loss_spans): a conversation as one text, and where the loss applies.

    Turns are in the order of turn, then role and text. Every turn is `<s>role[INST] text [/INST]</s>`, role
    and text escaped. `loss_spans` are (start, length) in code points, from 0, of the escaped texts of
    `learn_from`; marks are not learnt. Repeated turns are kept. Rows with a NULL id are one conversation. A
    conversation is one value, so its turns meet in one task.
    """
    text, role = escaped(F.col("text")), escaped(F.col("role"))
    head = F.concat(F.lit(BEGIN), role, F.lit(TEXT))
    turns = turns.select(
        "conv_id", "turn", F.col("role").alias("_role"), F.col("text").alias("_text"),
        F.concat(head, text, F.lit(TEXT_END + END)).alias("piece"),
        F.length(head).alias("head"),
        F.length(text).alias("chars"),
        (F.col("role") == learn_from).alias("learnt"),
    )
    order = ["turn", "_role", "_text"]
    before = Window.partitionBy("conv_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("piece")).over(before), F.lit(0)) + F.col("head")
    placed = turns.withColumn("start", start.cast("long"))
    entry = F.struct("start", "piece", F.when(F.col("learnt"), F.col("chars").cast("long")).alias("chars"))
    grouped = placed.groupBy("conv_id").agg(F.array_sort(F.collect_list(entry)).alias("turns"))
    spans = F.transform(
        F.filter("turns", lambda t: t["chars"].isNotNull()),
        lambda t: F.struct(t["start"].alias("start"), t["chars"].alias("length")),
    )
    whole = F.array_join(F.transform("turns", lambda t: t["piece"]), "")
    return grouped.select("conv_id", whole.alias("formatted"), spans.alias("loss_spans"))


def read_back(texts: DataFrame) -> DataFrame:
    """Rows (conv_id, turns, loss_text) from formatted texts: turns as (role, text), and all text under the loss."""
    pieces = F.filter(F.split("formatted", END), lambda p: p != "")
    pattern = r"(?s)^<s>([^\[]*)\[INST\] (.*) \[/INST\]$"
    turns = F.transform(
        pieces,
        lambda p: F.struct(
            unescaped(F.regexp_extract(p, pattern, 1)).alias("role"),
            unescaped(F.regexp_extract(p, pattern, 2)).alias("text"),
        ),
    )
    learnt = F.transform(
        "loss_spans",
        lambda s: F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int")),
    )
    return texts.select("conv_id", turns.alias("turns"), unescaped(F.array_join(learnt, "")).alias("loss_text"))
