"""Chat formatting: schema fingerprints choose declarative mappings into canonical turns.

A fingerprint is the hash of nested field paths, sorted, without values and list positions. Of a record's paths, those that any layout
knows are hashed, and the layout with that very hash is the record's; fields that no layout knows don't count. Its mapping says which
fields hold prompt, instruction or messages, and which role each gets, and turns the record into an array of (role, text). A record
that mixes layouts, such as one with a prompt and both a response and a completion, has no layout, as one of its texts would be lost;
nor has a list whose items don't all have the mapping's fields. Records without a layout come out with null turns and their own
fingerprint, by which ``unknown`` counts them. A table with a row for each turn has the one row layout whose columns it has.

The template marks turns with control strings that begin with ``<|``. In a role or text, every run ``<\\...\\|`` gets one backslash
more, so that no control string can arise; reading takes it off again. Line feeds in roles become a control string.

Null texts and roles count as empty. Turns come in the order of their number, then role and text; null numbers come first; repeated
rows are turns of their own. Very long texts are formatted whole; a conversation is one value, so that its turns have to fit a task.
Conversations without turns don't exist in row layouts and format to an empty string in record layouts. A null conversation id is
an id of its own. Other columns are left out. An empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame, types as T
from pyspark.sql import functions as F

START, END, NEWLINE = "<|im_start|>", "<|im_end|>", "<|nl|>"
TURNS = "array<struct<role:string,text:string>>"
#: Objects within objects whose paths are told; what lies deeper counts as a value.
DEPTH = 3


def schema_paths(kind: T.DataType, at: str = "") -> list[str]:
    """Nested field paths of a Spark type; lists are marked and have no positions; values in lists end in a star."""
    if isinstance(kind, T.StructType):
        return [p for f in kind.fields for p in schema_paths(f.dataType, f"{at}.{f.name}")]
    if isinstance(kind, T.ArrayType):
        return schema_paths(kind.elementType, at + "[]")
    return [at + "*"] if at.endswith("[]") else [at]


def example_paths(value: object, at: str = "", depth: int = DEPTH) -> set[str]:
    """Nested field paths of a parsed JSON record, as ``record_paths`` tells them."""
    if isinstance(value, dict):
        return {p for k, v in value.items() for p in ({f"{at}.{k}"} if depth == 1 else example_paths(v, f"{at}.{k}", depth - 1))}
    if isinstance(value, list):
        return {p for v in value for p in (example_paths(v, at + "[]", depth) if isinstance(v, dict) else {at + "[]*"})} or {at + "[]"}
    return {at}


def path_hash(paths: set[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()


def fingerprint(paths: Column) -> Column:
    """The same of an array of field paths."""
    return F.sha2(F.array_join(F.sort_array(F.array_distinct(paths)), "\n"), 256)


def record_paths(value: Column, depth: int = DEPTH) -> Column:
    """Nested field paths of a variant; null if it is no object."""

    def of(entry: Column) -> Column:
        at, kind = F.concat(F.lit("."), entry["key"]), F.schema_of_variant(entry["value"])
        if depth == 1:
            return F.array(at)
        below = lambda v: F.coalesce(record_paths(v, depth - 1), F.array().cast("array<string>"))
        listed = F.transform(
            entry["value"].try_cast("array<variant>"),
            lambda x: F.when(F.schema_of_variant(x).startswith("OBJECT"), below(x)).otherwise(F.array(F.lit("*"))),
        )
        inside = F.transform(F.flatten(listed), lambda p: F.concat(at, F.lit("[]"), p))
        return (
            F.when(kind.startswith("OBJECT"), F.transform(below(entry["value"]), lambda p: F.concat(at, p)))
            .when(kind.startswith("ARRAY"), F.when(F.size(inside) > 0, inside).otherwise(F.array(F.concat(at, F.lit("[]")))))
            .otherwise(F.array(at))
        )

    return F.array_distinct(F.flatten(F.transform(F.map_entries(value.try_cast("map<string,variant>")), of)))


def message_list(path: str, role: str, text: str, roles: dict[str, str] | None = None) -> str:
    """SQL of a mapping from a list of messages in the JSON text ``record``."""
    renamed = f"coalesce(element_at(map({', '.join(f"'{a}', '{b}'" for a, b in (roles or {}).items())}), m.r), m.r)" if roles else "m.r"
    parsed = f"from_json(get_json_object(record, '{path}'), 'array<struct<{role}:string,{text}:string>>')"
    items = f"from_json(get_json_object(record, '{path}'), 'array<map<string,string>>')"
    whole = f"forall({items}, m -> map_contains_key(m, '{role}') AND map_contains_key(m, '{text}'))"
    return f"if(coalesce({whole}, false), transform(transform({parsed}, m -> struct(m.{role} AS r, m.{text} AS t)), m -> struct(coalesce({renamed}, '') AS role, coalesce(m.t, '') AS text)), NULL)"


def single_fields(*fields: tuple[str, str]) -> str:
    """SQL of a mapping from named text fields, each one a turn; ``a+b`` joins two by a blank line if the second isn't empty."""
    turns = []
    for role, names in fields:
        got = [f"coalesce(get_json_object(record, '$.{n}'), '')" for n in names.split("+")]
        text = got[0] if len(got) == 1 else f"concat({got[0]}, if({got[1]} = '', '', concat(decode(X'0A0A', 'UTF-8'), {got[1]})))"
        turns.append(f"struct('{role}' AS role, {text} AS text)")
    return f"array({', '.join(turns)})"


#: Example records, which stand for their layouts, and the mapping of each.
LAYOUTS: tuple[tuple[str, str], ...] = (
    ('{"prompt": "p", "response": "r"}', single_fields(("user", "prompt"), ("assistant", "response"))),
    ('{"prompt": "p", "completion": "r"}', single_fields(("user", "prompt"), ("assistant", "completion"))),
    ('{"question": "p", "answer": "r"}', single_fields(("user", "question"), ("assistant", "answer"))),
    ('{"instruction": "i", "output": "o"}', single_fields(("user", "instruction"), ("assistant", "output"))),
    ('{"instruction": "i", "input": "x", "output": "o"}', single_fields(("user", "instruction+input"), ("assistant", "output"))),
    ('{"system": "s", "prompt": "p", "response": "r"}', single_fields(("system", "system"), ("user", "prompt"), ("assistant", "response"))),
    ('{"messages": []}', "array()"),
    ('{"conversations": []}', "array()"),
    ('{"messages": [{"role": "r", "content": "t"}]}', message_list("$.messages", "role", "content")),
    ('{"conversations": [{"from": "r", "value": "t"}]}', message_list("$.conversations", "from", "value", {"human": "user", "gpt": "assistant"})),
)


def canonical_records(records: DataFrame, id_col: str, record_col: str) -> DataFrame:
    """conv_id, fingerprint, turns of JSON records of many layouts; turns is null where no layout has the hash of the known paths."""
    known = records.select(F.col(id_col).alias("conv_id"), F.col(record_col).alias("record")).withColumn("paths", record_paths(F.try_parse_json("record")))
    layouts = [(example_paths(json.loads(example)), mapping) for example, mapping in LAYOUTS]
    known = known.withColumn("own", fingerprint(F.array_intersect("paths", F.array(*map(F.lit, sorted(set().union(*[x for x, _ in layouts])))))))
    turns = F.lit(None).cast(TURNS)
    for needed, mapping in layouts:
        turns = F.when(F.col("own") == path_hash(needed), F.expr(mapping).cast(TURNS)).otherwise(turns)
    return known.select("conv_id", fingerprint(F.col("paths")).alias("fingerprint"), turns.alias("turns"))


def unknown(canonical: DataFrame) -> DataFrame:
    """fingerprint, n of the records that no mapping turned into turns; null for what is no JSON object."""
    return canonical.filter(F.col("turns").isNull()).groupBy("fingerprint").agg(F.count("*").alias("n"))


#: Column sets of tables with a row for each turn: conversation, order, role, text.
ROW_LAYOUTS: tuple[tuple[str, str, str, str], ...] = (
    ("conv_id", "turn", "role", "text"),
    ("conversation_id", "turn", "role", "content"),
    ("conversation_id", "position", "from", "value"),
)


def canonical_rows(rows: DataFrame, layout: tuple[str, str, str, str] | None = None) -> DataFrame:
    """conv_id, fingerprint, turns of a table with a row for each turn; the table's field paths choose the layout as a record's do.

    A conversation is one value of the result, so that its turns have to meet in one task; only conversations do.
    """
    paths = set(schema_paths(rows.schema))
    if layout is None:
        known = {path_hash({f".{c}" for c in x}): x for x in ROW_LAYOUTS}
        layout = known.get(path_hash(paths & {f".{c}" for x in ROW_LAYOUTS for c in x}))
    if layout is None:
        raise ValueError(f"no row layout has the field paths {sorted(paths)}")
    conv, turn, role, text = (F.col(f"`{x}`") for x in layout)
    item = F.struct(turn.alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
    listed = rows.select(conv.alias("conv_id"), item.alias("x")).groupBy("conv_id").agg(F.sort_array(F.collect_list("x")).alias("xs"))
    return listed.select("conv_id", F.lit(path_hash(paths)).alias("fingerprint"), F.transform("xs", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("turns"))


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\\\|", "<$1|")


def formatted(turns: DataFrame, trained: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """Adds formatted, the text of all turns, and loss_spans: start from 0 and length of each trained turn's text in it."""
    safe = F.transform(
        "turns",
        lambda t: F.struct(
            F.concat(F.lit(START), F.replace(escaped(F.coalesce(t["role"], F.lit(""))), F.lit("\n"), F.lit(NEWLINE)), F.lit("\n")).alias("head"),
            escaped(F.coalesce(t["text"], F.lit(""))).alias("body"),
            F.coalesce(t["role"], F.lit("")).isin(*trained).alias("trained"),
        ),
    )
    staged = turns.withColumn("_s", safe)
    # lengths first, as running sums over numbers; texts are joined once
    ends = F.aggregate(
        "_s",
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans")),
        lambda a, x: F.struct(
            (a["at"] + F.length(x["head"]) + F.length(x["body"]) + len(END) + 1).alias("at"),
            F.when(x["trained"], F.concat(a["spans"], F.array(F.struct((a["at"] + F.length(x["head"])).alias("start"), F.length(x["body"]).alias("length"))))).otherwise(a["spans"]).alias("spans"),
        ),
        lambda a: a["spans"],
    )
    text = F.array_join(F.transform("_s", lambda x: F.concat(x["head"], x["body"], F.lit(END + "\n"))), "")
    return staged.select("*", text.alias("formatted"), ends.alias("loss_spans")).drop("_s")


def parsed(df: DataFrame) -> DataFrame:
    """Adds read_turns and read_loss, read back from ``formatted`` and ``loss_spans`` alone."""
    pieces = F.slice(F.split("formatted", r"<\|im_start\|>", -1), 2, F.greatest(F.size(F.split("formatted", r"<\|im_start\|>", -1)), F.lit(1)))

    def turn(p: Column) -> Column:
        head = F.substring_index(p, "\n", 1)
        body = F.substr(p, F.length(head) + 2, F.length(p) - F.length(head) - 2 - len(END))
        return F.struct(unescaped(F.replace(head, F.lit(NEWLINE), F.lit("\n"))).alias("role"), unescaped(body).alias("text"))

    loss = F.array_join(F.transform("loss_spans", lambda s: unescaped(F.substr("formatted", s["start"] + 1, s["length"]))), "")
    return df.withColumns({"read_turns": F.transform(pieces, turn), "read_loss": loss})
