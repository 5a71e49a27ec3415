"""Chat formatting by schema fingerprints (DataFrame functions only).

Records of different layouts (one row a turn, message lists, from/value lists,
prompt and completion, instruction and output) come as one column of any
struct, VARIANT or JSON text.  The paths of a record's nested fields, without
their scalar types, are hashed; the hash selects a declarative mapping, which
says where roles and texts lie.  Mapped turns are written with a template that
escapes control strings reversibly, and can be parsed back.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import let


@dataclass(frozen=True)
class Mapping:
    """One layout.

    paths: the field paths of its records, such as "messages[].role"; optional
    holds paths that may be missing besides.  Either `items` names the array of
    turns and `role`/`text` are paths inside an item, or `turns` lists (fixed
    role or path of the role, paths of text parts joined by a blank line).
    rename: role names to canonical ones.
    """

    name: str
    paths: tuple[str, ...]
    optional: tuple[str, ...] = ()
    items: str | None = None
    role: str = "role"
    text: str = "content"
    turns: tuple[tuple[str, tuple[str, ...]], ...] = ()
    rename: tuple[tuple[str, str], ...] = (("human", "user"), ("gpt", "assistant"), ("bot", "assistant"))


MAPPINGS = (
    Mapping("turn_row", ("role", "text"), ("conv_id", "turn"), turns=(("$role", ("text",)),)),
    Mapping("messages", ("messages[].content", "messages[].role"), ("id",), items="messages"),
    Mapping("conversations", ("conversations[].from", "conversations[].value"), ("id",), items="conversations", role="from", text="value"),
    Mapping("prompt_completion", ("completion", "prompt"), ("id", "system"), turns=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("completion",)))),
    Mapping("prompt_response", ("prompt", "response"), ("id", "system"), turns=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",)))),
    Mapping("instruction", ("instruction", "output"), ("id", "input", "system"), turns=(("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",)))),
    Mapping("question_answer", ("answer", "question"), ("id", "context"), turns=(("user", ("context", "question")), ("assistant", ("answer",)))),
)


@dataclass(frozen=True)
class Template:
    """Control strings around a turn.  Each must start with `lead`, and never with `lead` and a backslash."""

    open: str = "<|turn|>"
    middle: str = "<|text|>"
    close: str = "<|end|>"
    lead: str = "<"

    def __post_init__(self) -> None:
        for s in (self.open, self.middle, self.close):
            if not s.startswith(self.lead) or s.startswith(self.lead + "\\") or len(self.lead) != 1 or self.lead == "\\":
                raise ValueError(f"control string {s!r} must start with {self.lead!r} and no backslash after it")

    def escape(self, text: Column) -> Column:
        """Doubles backslashes and puts one behind every `lead`, so no control string can arise."""
        return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit(self.lead), F.lit(self.lead + "\\"))

    def unescape(self, text: Column) -> Column:
        return F.regexp_replace(text, f"({re.escape(self.lead)})\\\\|\\\\(\\\\)", "$1$2")


def field_paths(record: Column) -> Column:
    """Canonical text of a VARIANT's nested field paths: its schema without scalar types and nullness.

    Keys come sorted from schema_of_variant; the elements of an array are merged.
    """
    schema = F.schema_of_variant(record)
    bare = F.regexp_replace(schema, r": (?!OBJECT|ARRAY)[A-Z]+(\(\d+, ?-?\d+\))?", "")
    return F.regexp_replace(bare, r"ARRAY<(?!OBJECT|ARRAY)[A-Z]+(\(\d+, ?-?\d+\))?>", "ARRAY<>")


def fingerprint(record: Column) -> Column:
    return F.xxhash64(field_paths(record))


def _shape(paths: tuple[str, ...]) -> str:
    """The text that field_paths() gives a record of these paths."""
    tree: dict = {}
    for p in paths:
        node = tree
        for key in p.split("."):
            node = node.setdefault(key, {})

    def show(node: dict) -> str:
        parts = []
        for key in sorted(node, key=lambda k: k.removesuffix("[]")):
            inner = show(node[key]) if node[key] else ""
            if key.endswith("[]"):
                parts.append(f"{key[:-2]}: ARRAY<{inner}>")
            else:
                parts.append(f"{key}: {inner}" if inner else key)
        return f"OBJECT<{', '.join(parts)}>"

    return show(tree)


def shapes(mapping: Mapping) -> list[str]:
    """All shapes of a mapping, with every choice of optional paths."""
    out = [mapping.paths]
    for extra in mapping.optional:
        out += [(*p, extra) for p in out]
    return [_shape(p) for p in out]


def fingerprint_table(spark: SparkSession, mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """fingerprint -> mapping name: a few rows for each mapping."""
    rows = [(s, m.name) for m in mappings for s in shapes(m)]
    if len({s for s, _ in rows}) < len(rows):
        raise ValueError("two mappings claim the same layout")
    return spark.createDataFrame(rows, "shape string, mapping string").select(F.xxhash64("shape").alias("fingerprint"), "mapping")


def _string(record: Column, path: str) -> Column:
    return F.try_variant_get(record, F.lit(f"$.{path}"), "string")


def _turns(record: Column, m: Mapping) -> Column:
    """array<struct<role, text>> of a record of layout `m`."""
    renames = F.create_map(*[F.lit(x) for pair in m.rename for x in pair])
    canonical = lambda r: F.coalesce(renames[r], r, F.lit(""))
    turn = lambda r, t: F.struct(canonical(r).alias("role"), F.coalesce(t, F.lit("")).alias("text"))
    if m.items:
        items = F.try_variant_get(record, F.lit(f"$.{m.items}"), "array<variant>")
        return F.transform(items, lambda x: turn(_string(x, m.role), _string(x, m.text)))
    made = []
    for role, parts in m.turns:
        r = _string(record, role[1:]) if role.startswith("$") else F.lit(role)
        texts = F.filter(F.array(*[_string(record, p) for p in parts]), lambda x: x.isNotNull())
        joined = F.array_join(texts, "\n\n")
        # a fixed role whose fields are all missing makes no turn; a turn row always makes one
        made.append(turn(r, joined) if role.startswith("$") else F.when(F.size(texts) > 0, turn(r, joined)))
    return F.filter(F.array(*made), lambda x: x.isNotNull())


def canonical_turns(records: DataFrame, record_col: str = "record", mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """`records` with columns mapping and turns (array of role and text) for a VARIANT column.

    Records of an unknown layout, and null ones, keep null in both: nothing is
    dropped.  Null texts become empty, null roles too.  Columns of the names
    fingerprint, mapping and turns are replaced.
    """
    spark = records.sparkSession
    keep = [c for c in records.columns if c.lower() not in ("fingerprint", "mapping", "turns")]
    # the table's size is fixed by `mappings`
    known = F.broadcast(fingerprint_table(spark, mappings))
    rows = records.select(*[records[f"`{c}`"] for c in keep], fingerprint(records[f"`{record_col}`"]).alias("fingerprint")).join(known, "fingerprint", "left")
    record = F.col(f"`{record_col}`")
    turns = F.lit(None).cast("array<struct<role:string,text:string>>")
    for m in mappings:
        turns = F.when(F.col("mapping") == m.name, _turns(record, m)).otherwise(turns)
    return rows.select(*[F.col(f"`{c}`") for c in keep], "fingerprint", "mapping", turns.alias("turns"))


def format_chat(turns: DataFrame, template: Template = Template(), loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row a conversation of `turns` (conv_id, position columns turn and part, role, text).

    formatted: the turns in order, each open + role + middle + text + close with
    role and text escaped.  loss: for every turn under the loss mask its number
    (from 0) and where its escaped text lies in the formatted text (start and
    length in code points).  Ties in position are ordered by role and text;
    null positions come first.  Rows of a null id belong to no conversation that
    others share: each is one of its own, or those of one `record_key`, if there
    is such a column; so rows without an id are no group that grows.
    """
    own = F.col("record_key") if "record_key" in turns.columns else F.monotonically_increasing_id()
    turns = turns.withColumn("record_key", F.when(F.col("conv_id").isNull(), own))
    conversation = ["conv_id", "record_key"]
    piece = F.concat(F.lit(template.open), template.escape(F.col("role")), F.lit(template.middle), template.escape(F.col("text")), F.lit(template.close))
    in_order = Window.partitionBy(*conversation).orderBy("turn", "part", "role", "text")
    rows = turns.select(*conversation, "turn", "part", "role", "text", piece.alias("piece"))
    rows = rows.select(
        *conversation, "piece",
        (F.row_number().over(in_order) - 1).alias("nth"),
        F.sum(F.char_length("piece").cast("long")).over(in_order.rowsBetween(Window.unboundedPreceding, 0)).alias("upto"),
        F.col("role").isin(*loss_roles).alias("masked"),
        F.char_length(template.escape(F.col("text"))).cast("long").alias("length"),
    )
    span = F.struct(F.col("nth").cast("int").alias("turn"), (F.col("upto") - len(template.close) - F.col("length")).alias("start"), F.col("length").alias("length"))
    grouped = rows.groupBy(*conversation).agg(F.array_sort(F.collect_list(F.struct("nth", "piece", F.when(F.col("masked"), span).alias("span")))).alias("p"))
    return grouped.select(
        "conv_id",
        F.array_join(F.transform("p", lambda x: x["piece"]), "").alias("formatted"),
        F.filter(F.transform("p", lambda x: x["span"]), lambda x: x.isNotNull()).alias("loss"),
    )


def parse_chat(formatted: Column, template: Template = Template()) -> Column:
    """array<struct<role, text>> read back from a formatted text."""
    pieces = F.filter(F.split(formatted, re.escape(template.open), -1), lambda x: x != "")

    def turn(piece: Column) -> Column:
        body = F.substring_index(piece, template.close, 1)
        return let(F.split(body, re.escape(template.middle), 2), lambda p: F.struct(
            template.unescape(p[0]).alias("role"), template.unescape(F.get(p, F.lit(1))).alias("text")))

    return F.transform(pieces, turn)


def masked_text(formatted: Column, loss: Column, template: Template = Template()) -> Column:
    """array<string>: the unescaped texts under the loss mask, in order.

    The mask is applied turn by turn, a span being the end of its turn, so the
    cost stays linear in the conversation's length.
    """
    def read(pieces: Column) -> Column:
        def cut(span: Column) -> Column:
            piece = F.get(pieces, span["turn"])
            end = F.char_length(piece) - len(template.close)
            return template.unescape(F.substring(piece, (end - span["length"] + 1).cast("int"), span["length"].cast("int")))

        return F.transform(loss, cut)

    return let(F.filter(F.split(formatted, re.escape(template.open), -1), lambda x: x != ""), read)


def turn_records(conversations: DataFrame) -> DataFrame:
    """The rows of a table by turn (conv_id, turn, role, text) as VARIANT records with their ids."""
    record = F.to_variant_object(F.struct("role", "text", "conv_id", "turn"))
    return conversations.select("conv_id", "turn", record.alias("record"))


def format_records(records: DataFrame, template: Template = Template(), mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """Formats records (conv_id, turn, record): maps each by its fingerprint, then groups by conversation.

    A record of an unknown layout raises an error when it is read: silence would lose turns.
    """
    mapped = canonical_turns(records, "record", mappings)
    checked = F.when(F.col("mapping").isNull() & F.col("record").isNotNull(), F.raise_error(F.concat(F.lit("unknown record layout: "), field_paths(F.col("record"))))).otherwise(F.col("turns"))
    keyed = mapped.select("conv_id", "turn", F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id()).alias("record_key"), checked.alias("turns"))
    rows = keyed.select("conv_id", "record_key", "turn", F.posexplode("turns").alias("part", "t")).select("conv_id", "record_key", "turn", "part", "t.role", "t.text")
    return format_chat(rows, template)
