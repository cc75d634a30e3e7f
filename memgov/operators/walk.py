"""String walk: a request body becomes scan units, each with its strings in document order."""

from __future__ import annotations

import json
import unicodedata

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from memgov import fixed
from memgov.functions.jsontext import parsed
from memgov.functions.text import with_canonical_text

UNITS = T.ArrayType(
    T.StructType(
        [
            T.StructField(
                "fields",
                T.ArrayType(
                    T.StructType(
                        [
                            T.StructField("path", T.StringType()),
                            T.StructField("text", T.StringType()),
                            T.StructField("is_key", T.BooleanType()),
                        ]
                    )
                ),
            ),
            T.StructField("nfkc", T.BooleanType()),
            T.StructField("invisible", T.BooleanType()),
            T.StructField("overflow", T.BooleanType()),
        ]
    )
)
_ARROW_UNITS = pa.list_(
    pa.struct(
        [
            (
                "fields",
                pa.list_(
                    pa.struct([("path", pa.string()), ("text", pa.string()), ("is_key", pa.bool_())])
                ),
            ),
            ("nfkc", pa.bool_()),
            ("invisible", pa.bool_()),
            ("overflow", pa.bool_()),
        ]
    )
)
_DROPPED = {cp: None for cp in (0x200B, 0x200C, 0x200D, 0x2060)}
_DROPPED.update(dict.fromkeys(range(0xFE00, 0xFE10)))
_DROPPED.update(dict.fromkeys(range(0xE0000, 0xE0080)))


def _strings(value, path, limit):
    """(path, text, is_key) in document order; keys come before their values."""
    stack = [(path, value, False)]
    while stack and limit > 0:
        at, node, is_key = stack.pop()
        if isinstance(node, str):
            limit -= 1
            yield at, node, is_key
        elif isinstance(node, list):
            stack.extend((f"{at}.{i}", node[i], False) for i in range(len(node) - 1, -1, -1))
        elif isinstance(node, dict):
            for key in reversed(node):
                stack.append((f"{at}.{key}", node[key], False))
                stack.append((f"{at}.{key}", key, True))


def _unit(value, path):
    limit = fixed.SCAN_FIELDS
    found = list(_strings(value, path, limit + 1))
    fields, nfkc, invisible = [], False, False
    for at, raw, is_key in found[:limit]:
        if raw.isascii():
            text = raw
        else:
            composed = unicodedata.normalize("NFKC", raw)
            text = composed.translate(_DROPPED)
            nfkc = nfkc or composed != raw
            invisible = invisible or text != composed
        fields.append((at, text.encode("utf-8", "replace").decode(), is_key))
    return {
        "fields": [{"path": p, "text": t, "is_key": k} for p, t, k in fields],
        "nfkc": nfkc,
        "invisible": invisible,
        "overflow": len(found) > limit,
    }


def _units_of(body: str, kind: str):
    value = parsed(body)
    if value is None and body.strip() != "null":
        return None
    if kind == "recalled_extras" and not isinstance(value, dict):
        kind = "recalled_memory"
    if kind == "recalled_extras":
        value = {k: v for k, v in value.items() if k not in ("id", "text")}
        kind = "recalled_memory"
    if kind != "retain" or not isinstance(value, dict):
        return [_unit(value, kind)]
    rest = {k: v for k, v in value.items() if k != "items"}
    items = value.get("items")
    units = [_unit(rest, kind)] if rest else []
    if isinstance(items, list):
        units += [_unit(item, f"{kind}.items.{i}") for i, item in enumerate(items)]
    return units


def _walker(kind: str):
    @F.arrow_udf(UNITS)
    def walk(bodies: pa.Array) -> pa.Array:
        return pa.array(
            [None if b is None else _units_of(b, kind) for b in bodies.to_pylist()], _ARROW_UNITS
        )

    return walk


walk_retain = _walker("retain")
walk_recall = _walker("recall")
walk_result = _walker("recalled_memory")
walk_extras = _walker("recalled_extras")


@F.arrow_udf(
    T.ArrayType(T.StructType([T.StructField("key", T.StringType()), T.StructField("value", T.StringType())]))
)
def json_entries(maps: pa.Array) -> pa.Array:
    """Entries of a JSON object in document order, each value as JSON text; null otherwise."""

    def one(text):
        value = parsed(text)
        if not isinstance(value, dict):
            return None
        return [{"key": k, "value": json.dumps(v, ensure_ascii=False)} for k, v in value.items()]

    return pa.array(
        [one(m) for m in maps.to_pylist()],
        pa.list_(pa.struct([("key", pa.string()), ("value", pa.string())])),
    )


def with_units(df: DataFrame, body: str, kind: str, target: str = "units") -> DataFrame:
    """Scan units of a JSON body. Retain: the rest of the body and each item; else one unit."""
    walker = {"retain": walk_retain, "recall": walk_recall, "recalled_memory": walk_result}[kind]
    return df.withColumn(target, walker(F.col(body)))


def with_text_unit(df: DataFrame, text: str, path: str = "content", target: str = "units") -> DataFrame:
    """One unit with one value field, from a plain text column. Python sees unusual text only."""
    return with_field_units(df, [(path, text)], target, keyed=False)


def with_field_units(
    df: DataFrame, fields: list[tuple[str, str]], target: str = "units", keyed: bool = True
) -> DataFrame:
    """One unit from typed text columns: key, value, key, value in the order given.

    Null columns count as absent. This is the walk of a flat object without going through JSON.
    """
    step, parts, changes = df, [], []
    for i, (path, column) in enumerate(fields):
        step = with_canonical_text(step, column, f"_t{i}", f"_c{i}")
        value = _field(path, F.col(f"_t{i}"), False)
        pair = F.array(_field(path, F.lit(path), True), value) if keyed else F.array(value)
        parts.append(F.when(F.col(column).isNotNull(), pair))
        changes.append(F.coalesce(F.col(f"_c{i}"), F.array().cast("array<string>")))
    flags = F.concat(*changes)
    unit = F.struct(
        F.flatten(F.array_compact(F.array(*parts))).alias("fields"),
        F.array_contains(flags, "nfkc").alias("nfkc"),
        F.array_contains(flags, "invisible").alias("invisible"),
        F.lit(False).alias("overflow"),
    )
    dropped = [f"_{c}{i}" for c in "tc" for i in range(len(fields))]
    return step.withColumn(target, F.array(unit)).drop(*dropped)


def _field(path: str, text: Column, is_key: bool) -> Column:
    return F.struct(F.lit(path).alias("path"), text.alias("text"), F.lit(is_key).alias("is_key"))


def walk_rows(df: DataFrame, keys: list[str], units: str = "units") -> DataFrame:
    """One row per string: unit number, position, path, text, is_key."""
    return (
        df.select(*keys, F.posexplode(units).alias("unit", "_u"))
        .select(*keys, "unit", F.posexplode("_u.fields").alias("ord", "_f"))
        .select(*keys, "unit", "ord", "_f.path", "_f.text", "_f.is_key")
    )

