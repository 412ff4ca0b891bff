"""Chat formatting: schema fingerprints select declarative mappings to canonical turns; a reversible template renders them.

A layout is the set of nested field paths of a record or of a table's schema. The hash of that set (its fingerprint)
is looked up in a registry of mappings, and the mapping found says which fields become turns: a row for each turn, a list
of messages, or a field for each turn. A further layout takes a further mapping and no code. A JSON record's layout is
known exactly or refused. A table may have extra columns: of the mappings whose fingerprint is that of some of its
paths, the one with most paths is taken, and a table with none, or with two alike, is refused.

Defined cases: a null text or role counts as empty; turns with the same number are ordered by role, then text; null
numbers come first; repeated rows are turns of their own; an empty table gives no conversations; a row without messages
is a conversation without turns; a layout without ids gives null ids; what is no string is written as JSON, and a lone
surrogate as U+FFFD; a record that is no JSON object, is nested too deeply to be read, or has an unknown layout has the
layout null and no turns; columns named layout or turns are replaced.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

START, END = "<|im_start|>", "<|im_end|>"
TURNS = T.ArrayType(T.StructType([T.StructField("role", T.StringType()), T.StructField("text", T.StringType())]))


# --- fingerprints and mappings ---------------------------------------------------------------------------------------


def _name(name: str) -> str:
    """A field's name in a path: the signs of paths are escaped in it, so that no name looks like a path."""
    return re.sub(r"([\\.\[])", r"\\\1", name)


def schema_paths(kind: T.DataType, at: str = "") -> set[str]:
    """Paths of the leaves of a Spark type: `messages[].role`."""
    if isinstance(kind, T.StructType):
        return set().union(*(schema_paths(f.dataType, f"{at}.{_name(f.name)}" if at else _name(f.name)) for f in kind.fields))
    if isinstance(kind, T.ArrayType):
        return schema_paths(kind.elementType, f"{at}[]")
    return {at}


def record_paths(value: object, at: str = "") -> set[str]:
    """Paths of the leaves of a JSON value; empty lists and objects count as leaves of their own."""
    if isinstance(value, dict) and value:
        return set().union(*(record_paths(v, f"{at}.{_name(k)}" if at else _name(k)) for k, v in value.items()))
    if isinstance(value, list) and value:
        return set().union(*(record_paths(v, f"{at}[]") for v in value))
    return {at}


def fingerprint(paths: set[str]) -> str:
    """Hash of a set of paths, whatever their order."""
    return hashlib.sha256("\n".join(sorted(paths)).encode("utf-8", "surrogatepass")).hexdigest()[:16]


@dataclass(frozen=True)
class Mapping:
    """rows: the fields of conversation, order, role and text of a table with a row for each turn; or turns: (role, path) pairs in order, for layouts with a field a turn; and messages: the list's path, then the fields of role and text. conv: the field of the conversation's id, if there is one. aliases: whether names of roles are made canonical."""

    name: str
    paths: frozenset[str]
    turns: tuple[tuple[str, str], ...] = ()
    messages: tuple[str, str, str] | None = None
    rows: tuple[str, str, str, str] | None = None
    conv: str | None = None
    aliases: bool = True

    @property
    def key(self) -> str:
        return fingerprint(set(self.paths))


def _flat(name: str, *turns: tuple[str, str]) -> Mapping:
    return Mapping(name, frozenset(path for _, path in turns), turns=turns)


def _list(name: str, at: str, role: str, text: str, *more: tuple[str, str], conv: str | None = None) -> Mapping:
    return Mapping(name, frozenset({f"{at}[].{role}", f"{at}[].{text}", *(p for _, p in more), *([conv] if conv else [])}), turns=more, messages=(at, role, text), conv=conv)


def rows_mapping(name: str, conv: str, order: str, role: str, text: str, aliases: bool = True) -> Mapping:
    """Of a table with a row for each turn."""
    return Mapping(name, frozenset({conv, order, role, text}), rows=(conv, order, role, text), aliases=aliases)


MAPPINGS = (
    _flat("prompt_response", ("user", "prompt"), ("assistant", "response")),
    _flat("prompt_completion", ("user", "prompt"), ("assistant", "completion")),
    _flat("question_answer", ("user", "question"), ("assistant", "answer")),
    _flat("system_question_response", ("system", "system_prompt"), ("user", "question"), ("assistant", "response")),
    _flat("instruction_output", ("user", "instruction"), ("assistant", "output")),
    _flat("instruction_input_output", ("user", "instruction"), ("user", "input"), ("assistant", "output")),
    _list("messages", "messages", "role", "content"),
    _list("conversations", "conversations", "from", "value"),
    _list("system_conversations", "conversations", "from", "value", ("system", "system")),
    _list("messages_by_id", "messages", "role", "content", conv="conv_id"),
    _list("conversations_by_id", "conversations", "from", "value", conv="id"),
    rows_mapping("turn_rows", "conv_id", "turn", "role", "text", aliases=False),  # canonical already
    rows_mapping("message_rows", "conversation_id", "message_index", "role", "content"),
)
#: Names of roles in public layouts.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def registry(mappings: tuple[Mapping, ...] = MAPPINGS) -> dict[str, Mapping]:
    """Mappings by fingerprint."""
    return {m.key: m for m in mappings}


def select_mapping(paths: set[str], mappings: tuple[Mapping, ...] = MAPPINGS) -> Mapping:
    """The mapping whose fingerprint equals that of a table's paths; with extra columns, the one with most paths among those whose fingerprint the table's paths of these names have."""
    known = registry(mappings)
    found = known.get(fingerprint(paths))
    if found:
        return found
    within = [m for key, m in known.items() if fingerprint(paths & m.paths) == key]
    most = max((len(m.paths) for m in within), default=0)
    best = [m for m in within if len(m.paths) == most]
    if len(best) != 1:
        raise ValueError(f"{'two mappings' if best else 'no mapping'} for the layout {sorted(paths)}")
    return best[0]


def _text(value: object) -> str:
    """A JSON value as text that can be stored."""
    text = "" if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)
    return re.sub("[\ud800-\udfff]", "\ufffd", text)


def _value(record: dict, path: str) -> object:
    for name in path.split("."):
        record = record[name]
    return record


def _joined(turns: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """Turns with the same role that follow one another, joined by a newline."""
    out: list[tuple[str, str]] = []
    for role, text in turns:
        if out and out[-1][0] == role:
            out[-1] = (role, out[-1][1] + "\n" * bool(text) + text)
        else:
            out.append((role, text))
    return out


def record_turns(record: dict, known: dict[str, Mapping] | None = None) -> tuple[str, list[tuple[str, str]]] | None:
    """The layout and the canonical turns of a JSON record; None for a layout that no mapping knows. Turns with the same role that follow one another in a flat layout are joined by a newline."""
    m = (known or registry()).get(fingerprint(record_paths(record)))
    if m is None or m.rows:
        return None
    turns = _joined([(role, _text(_value(record, path))) for role, path in m.turns])
    if m.messages:
        at, role, text = m.messages
        said = [(_text(x.get(role)), _text(x.get(text))) for x in _value(record, at)]
        turns += [(ROLES.get(r, r) if m.aliases else r, t) for r, t in said]
    return m.name, turns


def canonical_json(df: DataFrame, column: str, mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """JSON records of mixed layouts, a fingerprint each: adds `layout` (null: unknown or not JSON) and `turns`."""
    known = registry(mappings)
    schema = T.StructType([f for f in df.schema.fields if f.name not in ("layout", "turns")] + [T.StructField("layout", T.StringType()), T.StructField("turns", TURNS)])

    def turns_of(line: str | None) -> tuple[str, list[tuple[str, str]]] | None:
        try:
            record = json.loads(line)
            return record_turns(record, known) if isinstance(record, dict) else None
        except (TypeError, ValueError, RecursionError):
            return None

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [turns_of(s) for s in b.column(column).to_pylist()]
            layouts = [g and g[0] for g in got]
            turns = [g and [{"role": r, "text": t} for r, t in g[1]] for g in got]
            kept = [n for n in b.schema.names if n not in ("layout", "turns")]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in kept), pa.array(layouts, pa.string()), pa.array(turns, pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())])))], names=[*kept, "layout", "turns"])

    return df.mapInArrow(read, schema)


def canonical_rows(df: DataFrame, mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """A table as `conv_id, turns`: the fingerprint of its nested schema selects the mapping, and that says what is read. Extra columns are ignored."""
    m = select_mapping(schema_paths(df.schema), mappings)
    said = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    alias = F.create_map(*(F.lit(x) for pair in ROLES.items() for x in pair))
    canonical = lambda r: F.coalesce(F.element_at(alias, r), r) if m.aliases else r
    turn = lambda r, t: F.struct(r.alias("role"), t.alias("text"))
    if m.rows:
        conv, order, role, text = map(F.col, m.rows)
        rows = df.select(conv.alias("conv_id"), F.struct(order.alias("turn"), said(role).alias("role"), said(text).alias("text")).alias("t"))
        turns = F.transform(F.sort_array(F.collect_list("t")), lambda t: turn(canonical(t["role"]), t["text"]))
        return rows.groupBy("conv_id").agg(turns.alias("turns"))
    runs: list[tuple[str, list]] = []  # fields of one role that follow one another are one turn
    for role, path in m.turns:
        if runs and runs[-1][0] == role:
            runs[-1][1].append(path)
        else:
            runs.append((role, [path]))
    follows = lambda c: F.when(said(c) != "", F.concat(F.lit("\n"), said(c))).otherwise("")
    turns = F.array(*(turn(F.lit(role), F.concat(said(F.col(first)), *(follows(F.col(p)) for p in more))) for role, (first, *more) in runs)).cast(TURNS)
    if m.messages:
        at, role, text = m.messages
        list_turns = F.transform(F.col(at), lambda x: turn(canonical(said(x[role])), said(x[text])))
        turns = F.concat(turns, F.coalesce(list_turns.cast(TURNS), F.array().cast(TURNS)))
    conv = F.col(m.conv) if m.conv else F.lit(None).cast("long")
    return df.select(conv.alias("conv_id"), turns.alias("turns"))


# --- template --------------------------------------------------------------------------------------------------------


def escape(text: str) -> str:
    """No control string is left: `<`, any backslashes, `|` gets one backslash more."""
    return re.sub(r"<(\\*)\|", r"<\1\\|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation, and its loss mask: the spans (code points) of the assistant's texts."""
    parts, mask, at = [], [], 0
    for role, text in turns:
        head = START + escape(role).replace("\\", "\\\\").replace("\n", "\\n") + "\n"
        body = escape(text)
        if role == "assistant":
            mask.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, END, "\n"]
        at += len(head) + len(body) + len(END) + 1
    return "".join(parts), mask


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation; the inverse of render."""
    turns = []
    for part in formatted.split(END + "\n")[:-1]:
        role, text = part.removeprefix(START).split("\n", 1)
        role = re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], role)
        turns.append((unescape(role), unescape(text)))
    return turns


def format_turns(df: DataFrame) -> DataFrame:
    """conv_id, formatted string, loss_mask array<struct<start,end>>, of a DataFrame with conv_id and turns."""
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [render([(t["role"] or "", t["text"] or "") for t in turns or []]) for turns in b.column("turns").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("conv_id"), pa.array([m[0] for m in made], pa.string()), pa.array([[{"start": s, "end": e} for s, e in m[1]] for m in made], span)], names=["conv_id", "formatted", "loss_mask"])

    return df.select("conv_id", "turns").mapInArrow(run, T.StructType([df.schema["conv_id"], T.StructField("formatted", T.StringType()), T.StructField("loss_mask", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])))]))


def format_conversations(df: DataFrame, mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """A table of any known layout, formatted."""
    return format_turns(canonical_rows(df, mappings))
