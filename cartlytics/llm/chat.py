"""Chat formatting: schema fingerprints select the mapping to canonical turns.

A layout is known by its schema: the nested field paths (arrays as ``[]``), sorted, one per line,
hashed with SHA-256.  A declarative mapping is registered for each fingerprint; it says where
the turns, roles and texts of that layout are.  Frames with typed columns have one fingerprint;
JSON records have one each.  What comes out is the same for all: conv_id, turn, role, text.

The template writes a turn as ``<|turn|>role<|text|>text<|end|>`` followed by a newline, and
escapes control strings inside roles and texts: a backslash is doubled and ``\\.`` is put after the
first character of each control string, so that none is left whole.  ``unescape`` undoes both.
The loss mask is the list of (start, length) spans of the assistants' escaped texts.

Cases: null roles and texts are empty; turns are in the order of turn, role, text (null first), so
ties and repeated rows keep all rows; a null conv_id is a conversation of its own; a conversation without
turns, or JSON that no mapping fits, gives no rows (``unmapped`` returns the latter);
extra columns of the flat layout are ignored: the mapping is chosen by the fields that it names.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Control strings that no text may contain whole: those of this template and of common ones (fixed values).
CONTROLS = ("<|turn|>", "<|text|>", "<|end|>", "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|startoftext|>",
            "<s>", "</s>", "<<SYS>>", "<</SYS>>", "[INST]", "[/INST]")
_BROKEN = "([<\\[])(?=" + "|".join(
    "".join("\\" + c if c in "|[]/" else c for c in s[1:]) for s in CONTROLS) + ")"
ASSISTANT = "assistant"
# Names of roles in other layouts (fixed values).
ROLE_NAMES = {"human": "user", "prompter": "user", "gpt": ASSISTANT, "bot": ASSISTANT, "model": ASSISTANT}


def field_paths(schema: T.DataType, at: str = "") -> list[str]:
    """Nested paths of the leaves of a type: a.b for structs, a[] for arrays."""
    if isinstance(schema, T.StructType):
        return sorted(p for f in schema.fields for p in field_paths(f.dataType, f"{at}.{f.name}" if at else f.name))
    if isinstance(schema, T.ArrayType):
        return field_paths(schema.elementType, at + "[]")
    return [at]


def fingerprint(paths: list[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


def layout(paths: list[str], rule: dict) -> dict:
    return rule | {"paths": sorted(paths), "fingerprint": fingerprint(paths)}


#: Declarative mappings.  rows: a row is a turn.  list: one array of turns.  fields: one field a turn, in order.
LAYOUTS = [
    layout(["conv_id", "turn", "role", "text"], {"kind": "rows", "turn": "turn", "role": "role", "text": "text"}),
    layout(["conv_id", "messages[].role", "messages[].content"], {"kind": "list", "list": "messages", "role": "role", "text": "content"}),
    layout(["conv_id", "conversations[].from", "conversations[].value"], {"kind": "list", "list": "conversations", "role": "from", "text": "value", "names": ROLE_NAMES}),
    layout(["conv_id", "prompt", "completion"], {"kind": "fields", "turns": [("user", ["prompt"]), (ASSISTANT, ["completion"])]}),
    layout(["conv_id", "instruction", "output"], {"kind": "fields", "turns": [("user", ["instruction"]), (ASSISTANT, ["output"])]}),
    layout(["conv_id", "instruction", "input", "output"], {"kind": "fields", "turns": [("user", ["instruction", "input"]), (ASSISTANT, ["output"])]}),
]
BY_FINGERPRINT = {x["fingerprint"]: x for x in LAYOUTS}


def _role(column: Column, rule: dict) -> Column:
    """The role, by the layout's own names for roles where it has them."""
    out = F.coalesce(column.cast("string"), F.lit(""))
    for theirs, ours in rule.get("names", {}).items():
        out = F.when(column == theirs, F.lit(ours)).otherwise(out)
    return out


def _turns(rule: dict, get) -> Column:
    """array<struct<turn, role, text>> of a record; ``get(name)`` is the column of a top-level field."""
    if rule["kind"] == "rows":
        return F.array(F.struct(get(rule["turn"]).cast("long").alias("turn"), _role(get(rule["role"]), rule).alias("role"),
                                F.coalesce(get(rule["text"]).cast("string"), F.lit("")).alias("text")))
    if rule["kind"] == "list":
        return F.transform(get(rule["list"]), lambda x, i: F.struct(
            i.cast("long").alias("turn"), _role(x[rule["role"]], rule).alias("role"), F.coalesce(x[rule["text"]].cast("string"), F.lit("")).alias("text")))
    made = []
    for i, (role, fields) in enumerate(rule["turns"]):
        # empty and missing fields leave no blank line
        text = F.concat_ws("\n", *[F.when(get(f) != "", get(f)) for f in fields])
        made.append(F.struct(F.lit(i).cast("long").alias("turn"), F.lit(role).alias("role"), text.alias("text")))
    return F.array(*made)


#: Field names that any layout has: others are no part of a fingerprint.
VOCABULARY = {part for x in LAYOUTS for p in x["paths"] for part in p.replace("[]", "").split(".")}


def known_paths(schema: T.StructType) -> list[str]:
    """The field paths of a schema whose names all belong to the vocabulary."""
    return [p for p in field_paths(schema) if set(p.replace("[]", "").split(".")) <= VOCABULARY]


def canonical(df: DataFrame) -> DataFrame:
    """conv_id, turn, role, text of a frame whose columns follow a known layout.

    The layout is the one of the fingerprint of the frame's own field paths; fields whose names no layout has are no part of it.
    Only where extra fields clash with names of other layouts, so that the fingerprint is of none, the layout with most
    fields of those in the frame is taken."""
    paths = known_paths(df.schema)
    rule = BY_FINGERPRINT.get(fingerprint(paths))
    if rule is None:
        rule = max((x for x in LAYOUTS if set(x["paths"]) <= set(paths)), key=lambda x: len(x["paths"]), default=None)
    named = df
    if rule is None:
        raise ValueError(f"no mapping for the layout {field_paths(df.schema)}")
    return (named.select("conv_id", F.explode(_turns(rule, F.col)).alias("t"))
            .select(F.col("conv_id").cast("long").alias("conv_id"), "t.turn", "t.role", "t.text"))


def record_fingerprint(json: str = "json") -> Column:
    """The fingerprint of each JSON record, from its top-level fields and those of the first element of arrays."""
    keys = F.json_object_keys(F.col(json))
    listed = [x["list"] for x in LAYOUTS if x["kind"] == "list"]

    def nested_in(name):
        inner = F.json_object_keys(F.get_json_object(F.col(json), f"$.{name}[0]"))
        return F.when(F.array_contains(keys, name), F.transform(inner, lambda k: F.concat(F.lit(name + "[]."), k)))

    nested = [nested_in(name) for name in listed]
    plain = F.filter(keys, lambda k: ~k.isin(listed))
    paths = F.concat(plain, *[F.coalesce(x, F.array().cast("array<string>")) for x in nested])
    return F.sha2(F.array_join(F.sort_array(paths), "\n"), 256)


def canonical_records(records: DataFrame, json: str = "json") -> DataFrame:
    """conv_id, turn, role, text of JSON records of mixed layouts, each mapped by its own fingerprint."""
    marked = records.select(json, record_fingerprint(json).alias("layout"))
    fields = {"conv_id": "long"}
    for x in LAYOUTS:
        for p in x["paths"]:
            top = p.split("[]")[0].split(".")[0]
            fields[top] = f"array<struct<`{x['role']}`:string,`{x['text']}`:string>>" if "[]" in p else fields.get(top, "string")
    schema = ", ".join(f"`{k}` {v}" for k, v in fields.items())
    parsed = marked.select("layout", F.from_json(json, schema).alias("r"))
    turns = F.lit(None)
    for x in LAYOUTS:
        turns = F.when(F.col("layout") == x["fingerprint"], _turns(x, lambda name: F.col("r")[name])).otherwise(turns)
    return (parsed.select(F.col("r.conv_id").alias("conv_id"), F.explode(turns).alias("t")).select("conv_id", "t.turn", "t.role", "t.text"))


def unmapped(records: DataFrame, json: str = "json") -> DataFrame:
    """The records whose fingerprint has no mapping."""
    mark = record_fingerprint(json)
    return records.where(~F.coalesce(mark.isin(list(BY_FINGERPRINT)), F.lit(False)))


# ---------------------------------------------------------------- template

def escape(c: Column) -> Column:
    return F.regexp_replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), _BROKEN, "$1\\\\.")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"\\(?:(\\)|\.)", "$1")


def format_turns(turns: DataFrame) -> DataFrame:
    """conv_id, formatted, loss_spans of every conversation.  The output is one string a conversation, so
    its rows meet in one task; before that they only carry their own text."""
    rows = turns.select("conv_id", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    grouped = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    grouped = grouped.select("conv_id", F.transform("ts", lambda t: F.struct(
        t["role"].alias("role"), F.concat(F.lit("<|turn|>"), escape(t["role"]), F.lit("<|text|>")).alias("head"), escape(t["text"]).alias("body"))).alias("ts"))
    end = "<|end|>\n"
    formatted = F.concat(F.array_join(F.transform("ts", lambda t: F.concat(t["head"], t["body"])), end), F.lit(end))
    state = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))
    spans = F.aggregate("ts", state, lambda s, t: F.struct(
        (s["at"] + F.length(t["head"]) + F.length(t["body"]) + len(end)).alias("at"),
        F.when(t["role"] == ASSISTANT, F.concat(s["spans"], F.array(F.struct(
            (s["at"] + F.length(t["head"])).alias("start"), F.length(t["body"]).alias("length"))))).otherwise(s["spans"]).alias("spans")), lambda s: s["spans"])
    return grouped.select("conv_id", formatted.alias("formatted"), spans.alias("loss_spans"))


def read_back(formatted: Column) -> Column:
    """array<struct<role, text>> of a formatted conversation."""
    pieces = F.split(formatted, r"<\|end\|>\n", -1)
    turns = F.slice(pieces, 1, F.size(pieces) - 1)
    return F.transform(turns, lambda t: F.struct(
        unescape(F.substring_index(F.replace(t, F.lit("<|turn|>"), F.lit("")), "<|text|>", 1)).alias("role"),
        unescape(F.substring_index(t, "<|text|>", -1)).alias("text")))


def digest(formatted: DataFrame) -> DataFrame:
    """What the output says when it is read back: turns, and the text under the loss mask."""
    said = formatted.select("conv_id", "formatted", read_back(F.col("formatted")).alias("turns"),
                            F.array_join(F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["length"]))), "").alias("loss"))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return said.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(whole, 256).alias("turns_sha256"),
                       F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
                       F.length("formatted").cast("long").alias("formatted_chars"))
