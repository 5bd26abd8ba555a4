"""Deeply nested JSON text as related flat tables (problem 6).

Every JSON object becomes one row that keeps the path of its nearest enclosing object. A bottom-up
tree automaton gives each value a state: scalars have the state of their type, an array the set of the
states of its elements, an object the sorted list of (key, state of the value). The state of an object is
its shape; objects are routed by kind (the path without array positions) and shape to typed subtype
tables, which all keep row_id, path, parent_path and the keys common to every shape of the kind. Columns
and types of a table come from the shapes. Scalars in arrays are a child table by position.

Defined results: null, blank, cut-off and otherwise unreadable JSON gives no rows; JSON text that is
stored as a JSON string (once or more often) counts as its content; an empty object gives one row with an
empty shape; a repeated key keeps its last value; a repeated input row gives repeated rows; an empty
table gives an empty result. Objects nested deeper than the interpreter's recursion limit are walked
iteratively, so depth isn't limited by the walk.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NODE_SCHEMA = "src string, row_id bigint, path string, parent_path string, kind string, shape string, fields map<string,string>"

_ARROW = pa.schema([
    ("src", pa.string()), ("row_id", pa.int64()), ("path", pa.string()), ("parent_path", pa.string()),
    ("kind", pa.string()), ("shape", pa.string()), ("fields", pa.map_(pa.string(), pa.string())),
])


def _refuse(name: str) -> None:
    raise ValueError(name)


def read_json(text: str | None) -> object | None:
    """The value of a JSON text, through any layers of JSON strings; None where it can't be read."""
    value: object = text
    while isinstance(value, str):
        try:
            value = json.loads(value.lstrip("﻿"), parse_constant=_refuse)
        except (ValueError, RecursionError):
            return None
    return value


def _inner(value: object) -> object:
    """A nested string that holds the JSON text of an object or array counts as its content."""
    while isinstance(value, str) and value.lstrip()[:1] in ("{", "["):
        found = read_json(value)
        if not isinstance(found, dict | list):
            return value
        value = found
    return value


# In a shape the characters that build it are escaped where a key holds them.
_MARKS, _ESCAPED = re.compile(r"[\\{}\[\],:|]"), r"\\\g<0>"


def _scalar_state(value: object) -> str:
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "bool"
    if isinstance(value, int | float):
        return "number"
    return "string"


def walk(value: object) -> list[tuple[str, str, str, str, list[tuple[str, str]]]]:
    """(path, parent path, kind, shape, scalar fields) of each object, the outermost first.

    The first pass goes down and writes paths, the second comes up and lets the automaton assign states.
    """
    order: list[list] = []  # value, path, kind, enclosing object's path, index of the parent, key, state
    stack: list[tuple] = [(_inner(value), "$", "$", "", -1, "")]
    while stack:
        v, path, kind, above, parent, key = stack.pop()
        at = len(order)
        order.append([v, path, kind, above, parent, key, None])
        if isinstance(v, dict):
            stack.extend((_inner(x), f"{path}.{k}", f"{kind}.{k}", path, at, k) for k, x in reversed(list(v.items())))
        elif isinstance(v, list):
            stack.extend((_inner(x), f"{path}[{i}]", f"{kind}[]", above, at, "") for i, x in reversed(list(enumerate(v))))
    below: list[list[tuple[str, str]]] = [[] for _ in order]
    for at in range(len(order) - 1, -1, -1):
        v, _, _, _, parent, key, _ = order[at]
        if isinstance(v, dict):
            state = "{" + ",".join(f"{k if k.isidentifier() else _MARKS.sub(_ESCAPED, k)}:{s}" for k, s in sorted(below[at])) + "}"
        elif isinstance(v, list):
            state = "[" + "|".join(sorted({s for _, s in below[at]})) + "]"
        else:
            state = _scalar_state(v)
        order[at][6] = state
        if parent >= 0:
            below[parent].append((key, state))
    rows = []
    for v, path, kind, above, _, _, state in order:
        if isinstance(v, dict):
            fields = [(k, x if isinstance(x, str) else json.dumps(x, ensure_ascii=False)) for k, x in v.items() if x is not None and not isinstance(_inner(x), dict | list)]
            rows.append((path, above, kind, state, fields))
    return rows


def scalars_of(value: object) -> list[tuple[str, str, str, str | None, int | None, str, str | None]]:
    """(path, enclosing object's path, kind, key, index, state, text) of each scalar, in the order of the text.

    A field of an object has the object's path and its key; an element of an array has the array's path and its index.
    """
    rows = []
    stack: list[tuple] = [(_inner(value), "$", "$", "", "", "", None, None)]
    while stack:
        v, path, kind, above, holder, held, key, index = stack.pop()
        if isinstance(v, dict):
            stack.extend((_inner(x), f"{path}.{k}", f"{kind}.{k}", path, path, kind, k, None) for k, x in reversed(list(v.items())))
        elif isinstance(v, list):
            stack.extend((_inner(x), f"{path}[{i}]", f"{kind}[]", above, path, kind, None, i) for i, x in reversed(list(enumerate(v))))
        elif holder:
            rows.append((holder, above, held, key, index, _scalar_state(v), v if v is None or isinstance(v, str) else json.dumps(v, ensure_ascii=False)))
    return rows


def _explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for src, row_id, text in zip(*(batch.column(c).to_pylist() for c in ("src", "row_id", "text")), strict=True):
            rows.extend((src, row_id, *node) for node in walk(read_json(text)))
            if len(rows) >= 50_000:  # a batch of long values is handed on in parts
                yield _batch(rows)
                rows = []
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), _ARROW, strict=True)], schema=_ARROW)


def json_objects(df: DataFrame, src: str, row_id: str, text: str) -> DataFrame:
    """One row for each JSON object at any depth of `text`, with its shape and its scalar fields.

    Map-side only: no shuffle. Values without an opening brace hold no object and never leave the JVM.
    """
    picked = df.select(F.lit(src).alias("src"), df[row_id].cast("bigint").alias("row_id"), df[text].alias("text"))
    return picked.where(F.col("text").contains("{")).mapInArrow(_explode, NODE_SCHEMA)


SCALAR_SCHEMA = "src string, row_id bigint, path string, object_path string, kind string, key string, index int, type string, value string"
_SCALAR_ARROW = pa.schema([(c, pa.int64() if c == "row_id" else pa.int32() if c == "index" else pa.string()) for c in ("src", "row_id", "path", "object_path", "kind", "key", "index", "type", "value")])


def _scalars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for src, row_id, text in zip(*(batch.column(c).to_pylist() for c in ("src", "row_id", "text")), strict=True):
            rows.extend((src, row_id, *x) for x in scalars_of(read_json(text)))
            if len(rows) >= 50_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), _SCALAR_ARROW, strict=True)], schema=_SCALAR_ARROW)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), _SCALAR_ARROW, strict=True)], schema=_SCALAR_ARROW)


def json_scalars(df: DataFrame, src: str, row_id: str, text: str) -> DataFrame:
    """One row for each scalar of `text`, of objects by key and of arrays by index; map-side only."""
    picked = df.select(F.lit(src).alias("src"), df[row_id].cast("bigint").alias("row_id"), df[text].alias("text"))
    return picked.where(F.col("text").rlike(r"[\[{]")).mapInArrow(_scalars, SCALAR_SCHEMA)


def array_values(scalars: DataFrame) -> DataFrame:
    """The child table of scalars in arrays: path of the array, the enclosing object's path, position and value."""
    picked = scalars.where(F.col("index").isNotNull())
    return picked.select("src", "row_id", "path", F.col("object_path").alias("parent_path"), "kind", "index", "type", "value")


def field_values(scalars: DataFrame) -> DataFrame:
    """The scalar fields of the objects of every kind, each in the column of its type."""
    of = lambda t, to: F.when(F.col("type") == t, F.col("value").try_cast(to))
    picked = scalars.where(F.col("key").isNotNull())
    return picked.select("src", "row_id", "path", "kind", "key", "type", of("string", "string").alias("as_string"), of("number", "double").alias("as_number"), of("bool", "boolean").alias("as_bool"))


def routed(nodes: DataFrame) -> DataFrame:
    """The common supertype of all subtype tables: every object with its parent link, and by kind and shape the table it goes to."""
    return nodes.select("src", "row_id", "path", "parent_path", "kind", F.sha1("shape").alias("shape_id"))


def found(nodes: DataFrame) -> DataFrame:
    """The objects of all variants with their parent links: what every subtype table keeps of its supertype."""
    return routed(nodes).where(F.col("shape_id").isNotNull()).select("src", "row_id", "path", "parent_path")


def shapes(nodes: DataFrame) -> DataFrame:
    """The structural variants: objects per source, kind and shape, with the keys common to the kind.

    Counting is partial on the map side; what is shuffled is one row per variant and task.
    """
    per = nodes.groupBy("src", "kind", "shape").agg(F.count("*").alias("n_objects"))
    keys = _with_keys(per)
    common = keys.groupBy("src", "kind").agg(F.count("*").alias("n_shapes"), F.collect_set("keys").alias("each"))
    common = common.select("src", "kind", "n_shapes", F.aggregate("each", F.expr("each[0]"), lambda a, b: F.array_intersect(a, b)).alias("common_keys"))
    joined = keys.join(common, ["src", "kind"])
    return joined.select("src", "kind", F.sha1("shape").alias("shape_id"), "shape", "n_objects", "n_shapes", F.array_join(F.array_sort("common_keys"), ",").alias("common_keys"))


def shape_states(shape: str) -> list[tuple[str, str]]:
    """(key, state) of the outermost object of a shape text, at any depth below it and with any characters in its keys."""
    pairs, depth, key, part, i = [], 0, None, [], 1
    while i < len(shape):
        c = shape[i]
        if c == "\\":
            part.append(shape[i + 1] if key is None else shape[i : i + 2])
            i += 2
            continue
        if depth == 0 and key is None and c == ":":
            key, part = "".join(part), []
        elif depth == 0 and c in ",}":
            if key is not None:
                pairs.append((key, "".join(part)))
            key, part = None, []
        else:
            depth += (c in "{[") - (c in "}]")
            part.append(c)
        i += 1
    return pairs


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        each = [shape_states(x) for x in batch.column("shape").to_pylist()]
        keys = pa.array([[k for k, _ in x] for x in each], pa.list_(pa.string()))
        states = pa.array([[v for _, v in x] for x in each], pa.list_(pa.string()))
        yield pa.RecordBatch.from_arrays([*batch.columns, keys, states], [*batch.schema.names, "keys", "states"])


def _with_keys(variants: DataFrame) -> DataFrame:
    """One row per variant, with keys and states of its outermost object."""
    columns = ", ".join(f"{c} {t}" for c, t in variants.dtypes)
    return variants.mapInArrow(_keys, f"{columns}, keys array<string>, states array<string>")


def typed_columns(nodes: DataFrame) -> dict[str, str]:
    """Key and Spark type of the scalar fields of the rows, from their shapes; keys of several types are text.

    What reaches the driver is one row for each key and type, however many rows or shapes there are.
    """
    each = _with_keys(nodes.select("shape").distinct()).select(F.explode(F.arrays_zip("keys", "states")).alias("x")).select(F.col("x.keys").alias("k"), F.col("x.states").alias("s"))
    each = each.where(F.col("s").isin("null", "bool", "number", "string")).distinct()
    types: dict[str, set[str]] = {}
    for r in each.collect():
        types.setdefault(r.k, set()).update({"bool": ["boolean"], "number": ["double"], "string": ["string"]}.get(r.s, []))
    return {k: t.pop() if len(t) == 1 else "string" for k, t in sorted(types.items())}


def subtype_table(nodes: DataFrame, kind: str | list[str] | None, columns: dict[str, str] | None = None, shape_id: str | None = None) -> DataFrame:
    """The typed table of a kind, of several kinds or of all rows: `columns` maps keys to Spark types.

    Without `columns` they come from the shapes, and then no value is lost; text that doesn't fit a given
    type is null. Every table keeps src, row_id, path and parent_path, so children join their parents on
    (src, row_id, parent_path = path), and shape_id, by which one structural variant can be picked.
    """
    if kind is not None:
        nodes = nodes.where(F.col("kind").isin([kind] if isinstance(kind, str) else kind))
    if shape_id is not None:
        nodes = nodes.where(F.sha1("shape") == shape_id)
    if columns is None:
        columns = typed_columns(nodes)
    taken, typed = {"src", "row_id", "path", "parent_path", "shape_id"}, []
    for k, t in columns.items():
        name = k
        while name.lower() in taken:  # Spark's names have no case
            name += "_value"
        taken.add(name.lower())
        typed.append(F.expr(f"try_cast(fields[{_sql(k)}] AS {t})").alias(name))
    return nodes.select("src", "row_id", "path", "parent_path", F.sha1("shape").alias("shape_id"), *typed)


def last_key(kind: Column) -> Column:
    """The key under which objects of a kind are held; `$` for the outermost."""
    return F.regexp_extract(kind, r"([^.\[\]]+)(?:\[\])*$", 1)


def _sql(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"
