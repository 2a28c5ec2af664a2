"""Chat formatting: heterogeneous records to canonical turns, to one templated text, and back.

A record's nested field paths are hashed; the hash selects a declarative mapping
that says where roles and texts lie (``LAYOUTS``). For tables the paths come from
the schema and the mapping compiles to column expressions; for JSON strings each
record is fingerprinted on its own and parsed with the layout it selects.

Template, per turn: ``<|im_start|>ROLE\\nTEXT<|im_end|>\\n``. Inside roles and
texts every ``<``, backslashes, ``|`` gets one more backslash, so no control
string survives in them; removing one backslash restores the input. A line break
in a role becomes ``<\\n>`` after the same rule for ``<``, backslashes, ``n>``.

Defined cases: null role or text is empty; turns sort by turn, then role, then
text, nulls first, repeated rows stay; fields that no layout lists (columns, keys of
a record or of its turns) are ignored, for tables and records alike; a null field or
an empty list counts as present and gives an empty text or no turns; a record that no
layout fits gets null turns and stays as a conversation of 0 turns with a status; where
several layouts fit, the first of ``LAYOUTS`` is taken; a text that is no string (a list of
parts, say) is its JSON without spaces. An
empty table gives an empty result. A column of the table that is named like one of the
result's (layout, schema_fp, turns, status, parsed) stays as input_NAME. Rows that
repeat a key are turns of one conversation.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
from collections.abc import Iterator
from itertools import combinations
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import apart, parts

START, END = "<|im_start|>", "<|im_end|>"

#: name, required paths, optional paths, and where turns come from. A ``list``
#: mapping reads role and text from each item; a ``fields`` mapping names the
#: roles itself and joins the listed fields of each with a blank line.
LAYOUTS: tuple[dict[str, Any], ...] = (
    {"name": "turn_rows", "need": ("turn", "role", "text"), "may": (), "row": ("turn", "role", "text")},
    {"name": "messages", "need": ("messages[].role", "messages[].content"), "may": (), "list": ("messages", "role", "content")},
    {"name": "conversation", "need": ("conversation[].role", "conversation[].text"), "may": (), "list": ("conversation", "role", "text")},
    {"name": "share", "need": ("conversations[].from", "conversations[].value"), "may": (), "list": ("conversations", "from", "value")},
    {"name": "instruction", "need": ("instruction", "output"), "may": ("input", "system"), "fields": (("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",)))},
    {"name": "prompt", "need": ("prompt", "completion"), "may": ("system",), "fields": (("system", ("system",)), ("user", ("prompt",)), ("assistant", ("completion",)))},
    {"name": "prompt_response", "need": ("prompt", "response"), "may": ("system",), "fields": (("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",)))},
    {"name": "question", "need": ("question", "answer"), "may": ("context",), "fields": (("user", ("context", "question")), ("assistant", ("answer",)))},
    {"name": "nested_prompt", "need": ("prompt.messages[].role", "prompt.messages[].content", "response"), "may": (), "list": ("prompt.messages", "role", "content"), "then": (("assistant", ("response",)),)},
)
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
TURNS = "array<struct<role:string,text:string>>"


def fingerprint(paths: Any) -> str:
    """Hash of a set of nested field paths."""
    return hashlib.sha256("\n".join(sorted(set(paths))).encode()).hexdigest()[:16]


def schema_paths(kind: T.DataType, at: str = "") -> list[str]:
    if isinstance(kind, T.StructType):
        return [p for f in kind for p in schema_paths(f.dataType, f"{at}.{f.name}" if at else f.name)]
    return schema_paths(kind.elementType, f"{at}[]") if isinstance(kind, T.ArrayType) else [at]


def value_paths(value: Any, at: str = "") -> set[str]:
    if isinstance(value, dict):
        return {p for k, v in value.items() for p in value_paths(v, f"{at}.{k}" if at else k)}
    if isinstance(value, list):
        return {p for v in value for p in value_paths(v, f"{at}[]")} or {f"{at}[]"}
    return {at}


@functools.cache
def registry() -> dict[str, dict[str, Any]]:
    """Each layout under the fingerprints of its required paths with any of its optional ones."""
    return {fingerprint([*x["need"], *more]): x for x in LAYOUTS for n in range(len(x["may"]) + 1) for more in combinations(x["may"], n)}


def layout_of(value: dict[str, Any]) -> tuple[dict[str, Any] | None, str]:
    """The layout that fits a record, and the fingerprint of the paths it knows; of all paths where none fits.

    Layouts are tried in their order, rows last: first by paths that are there, then
    with empty or null lists in place of their items' paths.
    """
    have, known = value_paths(value), registry()
    empty = {at for p in have if _dig(value, at := p.removesuffix("[]")) in ([], None)}
    for stands in (set(), empty):
        for layout in sorted(LAYOUTS, key=lambda x: "row" in x):
            there = have | {p for p in layout["need"] if "[]" in p and p.split("[]")[0] in stands}
            if layout is known.get(fp := fingerprint(there & {*layout["need"], *layout["may"]})):
                return layout, fp
    return None, fingerprint(have)


def _dig(value: Any, path: str) -> Any:
    for k in path.split("."):
        value = value.get(k) if isinstance(value, dict) else None
    return value


def turns_of(record: Any, layout: dict[str, Any]) -> list[dict[str, str]]:
    """Canonical turns of one parsed record under a layout's mapping."""
    word = lambda x: x if isinstance(x, str) else "" if x is None else json.dumps(x, ensure_ascii=False, separators=(",", ":"))
    turns = []
    if "list" in layout:
        items, role, text = layout["list"]
        found = _dig(record, items)
        for x in found if isinstance(found, list) else []:
            x = x if isinstance(x, dict) else {text: x}
            turns.append({"role": ROLES.get(word(x.get(role)), word(x.get(role))), "text": word(x.get(text))})
    if "row" in layout:
        _, role, text = layout["row"]
        turns = [{"role": word(record.get(role)), "text": word(record.get(text))}]
    for role, fields in (*layout.get("fields", ()), *layout.get("then", ())):
        if found := [word(v) for f in fields if (v := _dig(record, f)) not in (None, "")]:
            turns.append({"role": role, "text": "\n\n".join(found)})
        elif role == "assistant":
            turns.append({"role": role, "text": ""})
    return turns


def canonical_turns(df: DataFrame, record: str = "record") -> DataFrame:
    """Adds layout, schema_fp, turns and status (ok, empty, unmatched, unreadable) to a table with one JSON record a row."""

    @F.pandas_udf(f"struct<layout:string,schema_fp:string,turns:{TURNS},status:string>")
    def parse(col: pd.Series) -> pd.DataFrame:
        out = []
        for raw in col:
            try:
                value = json.loads(raw) if raw is not None else None
            except (ValueError, RecursionError):
                value = None
            layout, fp = layout_of(value) if isinstance(value, dict) else (None, None)
            turns = turns_of(value, layout) if layout else None
            status = "unreadable" if fp is None else "unmatched" if turns is None else "ok" if turns else "empty"
            out.append((layout and layout["name"], fp, turns, status))
        return pd.DataFrame(out, columns=["layout", "schema_fp", "turns", "status"])

    table = apart(df.select(F.col(record).alias(record), *[c for c in df.columns if c != record]), ("layout", "schema_fp", "turns", "status", "parsed"))
    found = table.withColumn("parsed", parse(table[0]))
    return found.select(*table.columns, "parsed.layout", "parsed.schema_fp", "parsed.turns", "parsed.status")


def _kind(kind: T.DataType, path: str) -> T.DataType | None:
    for k in path.split("."):
        kind = kind[k].dataType if isinstance(kind, T.StructType) and k in kind.names else None
    return kind


def compiled_turns(schema: T.StructType, layout: dict[str, Any]) -> Column:
    """A layout's mapping as a column expression over a table of this schema: its canonical turns, as ``turns_of`` gives them for JSON."""

    def word(c: Column, kind: T.DataType | None) -> Column:
        plain = isinstance(kind, T.StringType) or kind is None
        return F.coalesce(c if plain else F.to_json(c) if isinstance(kind, (T.StructType, T.ArrayType, T.MapType)) else c.cast("string"), F.lit(""))

    at = lambda path: F.col(".".join(f"`{k}`" for k in path.split(".")))
    roles = F.create_map(*[F.lit(x) for kv in ROLES.items() for x in kv])
    none = F.array().cast(TURNS)
    found = []
    if "list" in layout:
        items, role, text = layout["list"]
        inner = _kind(schema, items).elementType
        said = lambda x: word(x[role], _kind(inner, role))
        found.append(F.coalesce(F.transform(at(items), lambda x: F.struct(F.coalesce(F.try_element_at(roles, said(x)), said(x)).alias("role"), word(x[text], _kind(inner, text)).alias("text"))), none))
    for role, fields in (*layout.get("fields", ()), *layout.get("then", ())):
        there = F.filter(F.array(*[word(at(f), k) for f in fields if (k := _kind(schema, f)) is not None]).cast("array<string>"), lambda x: x != "")
        turn = F.array(F.struct(F.lit(role).alias("role"), F.array_join(there, "\n\n").alias("text")))
        found.append(turn if role == "assistant" else F.when(F.size(there) > 0, turn).otherwise(none))
    return F.concat(*found)


def turn_rows(df: DataFrame, key: str) -> DataFrame:
    """key, turn, role, text, status from a table: of turn rows or nested or flat records, by its schema's fingerprint, or of records that hold turns.

    A layout's mapping compiles to a column expression. A record without turns is one row of nulls whose status says why.
    """
    if "turns" in df.columns:
        why = F.col("status") if "status" in df.columns else F.when(F.col("turns").isNull(), "unmatched").when(F.size("turns") == 0, "empty").otherwise("ok")
        return df.select(key, why.alias("status"), F.posexplode_outer("turns").alias("turn", "_t")).select(key, F.col("turn").cast("long"), "_t.role", "_t.text", "status")
    have = set(schema_paths(df.schema))
    for layout in sorted(LAYOUTS, key=lambda x: "row" in x):
        if registry().get(fingerprint(have & {*layout["need"], *layout["may"]})) is not layout:
            continue
        if "row" not in layout:
            rows = df.select(key, compiled_turns(df.schema, layout).alias("turns"))
            rows = rows.select(key, F.when(F.size("turns") > 0, "ok").otherwise("empty").alias("status"), F.posexplode_outer("turns").alias("turn", "_t"))
            return rows.select(key, F.col("turn").cast("long"), "_t.role", "_t.text", "status")
        turn, role, text = layout["row"]
        return df.select(key, F.col(turn).cast("long").alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"), F.lit("ok").alias("status"))
    raise ValueError(f"no layout has the field paths {sorted(have)}")


def _escaped(c: Column, role: bool = False) -> Column:
    c = F.regexp_replace(F.coalesce(c, F.lit("")), r"<(\\*)\|", r"<$1\\|")
    return F.regexp_replace(F.regexp_replace(c, r"<(\\*)n>", r"<$1\\n>"), "\n", "<n>") if role else c


def format_chats(rows: DataFrame, key: str) -> DataFrame:
    """One row a conversation: key, formatted, n_turns, loss_spans (code points, end exclusive), status.

    Records without turns are no turns; their statuses are the conversation's. Rows are dealt by key and sorted; the mapper joins one conversation at a time
    and holds no more than that conversation and a batch.
    """
    schema = T.StructType([rows.schema[key], *T._parse_datatype_string("formatted string, n_turns long, loss_spans array<struct<start:long,end:long>>, status string")])
    piece = F.concat(F.lit(START), _escaped(F.col("role"), True), F.lit("\n"))
    dealt = (
        rows.withColumn("head", piece).withColumn("body", _escaped(F.col("text"))).withColumn("loss", F.coalesce(F.col("role") == "assistant", F.lit(False)))
        .repartition(parts(rows.sparkSession), key).sortWithinPartitions(key, "turn", "role", "text").select(key, "head", "body", "loss", "status")
    )
    arrow = pa.schema([("formatted", pa.string()), ("n_turns", pa.int64()), ("loss_spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("status", pa.string())])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Any] = []
        at, pieces, spans, n = object(), [], [], 0
        why: set[str] = set()
        size = length = 0

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                cols = [pa.array([h[i] for h in held], t) for i, t in enumerate([kind, *[f.type for f in arrow]])]
                yield pa.RecordBatch.from_arrays(cols, names=[key, *arrow.names])
                held.clear()

        kind = None
        for batch in batches:
            kind = batch.schema.field(key).type
            for k, head, body, loss, status in zip(*(batch.column(c).to_pylist() for c in (key, "head", "body", "loss", "status")), strict=True):
                if k != at:
                    if why:
                        held.append((at, "".join(pieces), n, spans, ",".join(sorted(why - {"ok"})) or "ok"))
                        size += length
                        if size > 4_000_000 or len(held) >= 5000:
                            yield from flush()
                            size = 0
                    at, pieces, spans, n, length, why = k, [], [], 0, 0, set()
                why.add(status)
                if status != "ok":
                    continue
                length += len(head)
                if loss:
                    spans.append({"start": length, "end": length + len(body)})
                length += len(body) + len(END) + 1
                pieces += (head, body, END, "\n")
                n += 1
        if why:
            held.append((at, "".join(pieces), n, spans, ",".join(sorted(why - {"ok"})) or "ok"))
        yield from flush()

    return dealt.mapInArrow(join, schema)


_TURN = re.compile(r"<\|im_start\|>([^\n]*)\n(.*?)<\|im_end\|>\n", re.S)


def unescaped(text: str, role: bool = False) -> str:
    if role:
        text = re.sub(r"<(\\+)n>", lambda m: f"<{m[1][1:]}n>", text.replace("<n>", "\n"))
    return re.sub(r"<(\\+)\|", lambda m: f"<{m[1][1:]}|", text)


def parse_chat(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn, from a formatted text alone."""
    return [(unescaped(r, True), unescaped(t)) for r, t in _TURN.findall(formatted)]


def chat_digests(formatted: DataFrame) -> DataFrame:
    """Adds what reading the formatted texts back gives: turn and loss-mask digests."""

    @F.pandas_udf("struct<n_turns:long,turns_sha256:string,loss_chars:long,loss_sha256:string,formatted_chars:long>")
    def read(text: pd.Series, spans: pd.Series) -> pd.DataFrame:
        out = []
        for t, s in zip(text, spans, strict=True):
            turns, loss, sha = parse_chat(t), hashlib.sha256(), hashlib.sha256()
            for role, body in turns:
                sha.update(f"{role}\n{body}\n".encode())
            chars = 0
            for x in s:
                part = unescaped(t[x["start"] : x["end"]])
                chars += len(part)
                loss.update(part.encode())
            out.append((len(turns), sha.hexdigest(), chars, loss.hexdigest(), len(t)))
        return pd.DataFrame(out, columns=["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return formatted.drop("n_turns").withColumn("_r", read("formatted", "loss_spans")).select("*", "_r.*").drop("_r")
