"""JSON helpers: checks on raw text, canonical form, digests, projections."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from memgov import fixed

_STRING = r'"(?:[^"\\]|\\.)*+"'
_NUMBER = r"(-?[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?)"
_LONE_SURROGATE = (
    r"(?<!\\)(?:\\\\)*(?:\\u[dD][89abAB][0-9a-fA-F]{2}(?!\\u[dD][c-fC-F])"
    r"|(?<!\\u[dD][89abAB][0-9a-fA-F]{2})\\u[dD][c-fC-F][0-9a-fA-F]{2})"
)


def without_strings(body: Column) -> Column:
    """JSON text with every string token reduced to an empty string."""
    return F.regexp_replace(body, _STRING, '""')


def numbers(body: Column) -> Column:
    return F.regexp_extract_all(without_strings(body), F.lit(_NUMBER), 1)



def has_unsafe_number(body: Column) -> Column:
    """Integers past 2^53-1 and decimals past the double range have no canonical form."""

    def unsafe(token: Column) -> Column:
        whole = token.rlike("^-?[0-9]+$")
        size = F.abs(token.cast("double"))
        exact = F.abs(token.try_cast("decimal(38,0)"))
        return F.when(
            whole,
            F.coalesce(exact > F.lit(fixed.MAX_SAFE_INTEGER).cast("decimal(38,0)"), F.lit(True)),
        ).otherwise(size == F.lit(float("inf")))

    return F.exists(numbers(body), unsafe)


def has_lone_surrogate(body: Column) -> Column:
    return body.contains("\\u") & body.rlike(_LONE_SURROGATE)


def is_representable(body: Column) -> Column:
    return ~(has_unsafe_number(body) | has_lone_surrogate(body))


def json_depth(body: Column) -> Column:
    """Nesting depth: the root counts 1 and a scalar inside a container counts one level."""
    marks = F.regexp_replace(
        F.regexp_replace(without_strings(body), r"[\s,:]+", " "), r"[^\[\]{} ]+", "x"
    )
    marks = F.regexp_replace(marks, r"[ ]+|(?<=x)x+", "")
    start = F.struct(F.lit(0).alias("open"), F.lit(0).alias("deepest"))

    def step(acc: Column, ch: Column) -> Column:
        opens = ch.isin("[", "{")
        closes = ch.isin("]", "}")
        level = F.when(closes, acc["open"] - 1).when(opens, acc["open"] + 1).otherwise(acc["open"])
        seen = F.when(closes, F.lit(0)).when(opens, level).otherwise(level + 1)
        return F.struct(level.alias("open"), F.greatest(acc["deepest"], seen).alias("deepest"))

    return F.aggregate(F.split(marks, ""), start, step, lambda acc: acc["deepest"])


def too_deep(body: Column, limit: int = fixed.MAX_JSON_DEPTH) -> Column:
    """True when the depth passes the limit; bodies with few brackets skip the fold."""
    brackets = F.length(body) - F.length(F.translate(body, "[{", ""))
    return F.when(brackets < limit, F.lit(False)).otherwise(json_depth(body) > limit)


def _es_number(value: float) -> str:
    """Shortest decimal form with the exponent rules of ECMAScript."""
    if value == 0:
        return "0"
    if value == int(value) and abs(value) < 1e21:
        return str(int(value))
    mantissa, _, exponent = repr(value).partition("e")
    if not exponent:
        return mantissa
    power = int(exponent)
    if -7 < power < 0:
        sign = "-" if mantissa.startswith("-") else ""
        digits = mantissa.lstrip("-").replace(".", "")
        return f"{sign}0.{'0' * (-power - 1)}{digits}"
    return f"{mantissa.removesuffix('.0')}e{'+' if power > 0 else '-'}{abs(power)}"


def render_canonical(value) -> str:
    """Canonical text of a parsed value: keys by UTF-16 order, shortest numbers, raw strings."""
    if isinstance(value, dict):
        keys = sorted(value, key=lambda k: k.encode("utf-16-be", "surrogatepass"))
        pairs = (f"{render_canonical(k)}:{render_canonical(value[k])}" for k in keys)
        return "{" + ",".join(pairs) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(render_canonical, value)) + "]"
    if isinstance(value, float):
        if value in (float("inf"), float("-inf")) or value != value:
            raise ValueError("no canonical form")
        return _es_number(value)
    if isinstance(value, int) and not isinstance(value, bool):
        if abs(value) > 9007199254740991:
            raise ValueError("no canonical form")
        return str(value)
    return json.dumps(value, ensure_ascii=False)


@F.arrow_udf(T.StringType())
def canonical_json_slow(bodies: pa.Array) -> pa.Array:
    def one(body):
        try:
            text = render_canonical(json.loads(body))
            text.encode("utf-8")
            return text
        except (ValueError, TypeError, RecursionError):
            return None

    return pa.array([b if b is None else one(b) for b in bodies.to_pylist()], pa.string())


def _is_plain(body: Column) -> Column:
    """Whole numbers only, no escapes and short digits: VARIANT rendering is then canonical."""
    return ~(
        body.contains("\\")
        | without_strings(body).rlike(r"[.eE+]|[0-9]{16}|-0|NaN|Infinity")
    )


def canonical_json(body: Column) -> Column:
    """RFC 8785 text, or null where the value has none."""
    plain = _is_plain(body)
    fast = F.when(plain, F.to_json(F.try_parse_json(body)))
    return F.coalesce(fast, canonical_json_slow(F.when(fast.isNull(), body)))


def sha256_text(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def content_sha256(body: Column) -> Column:
    return sha256_text(canonical_json(body))


def audit_digest(body: Column) -> Column:
    """Digest of the canonical form, or of the text itself where there is none."""
    return F.coalesce(content_sha256(body), sha256_text(body))


@F.arrow_udf(T.StringType())
def last_key_wins(bodies: pa.Array) -> pa.Array:
    """Re-render bodies that the strict parser refused only for repeated keys; else null."""

    def refuse(token):
        raise ValueError(token)

    def one(body):
        try:
            return json.dumps(json.loads(body, parse_constant=refuse), ensure_ascii=False)
        except (ValueError, RecursionError):
            return None

    return pa.array([b if b is None else one(b) for b in bodies.to_pylist()], pa.string())


def parsed(text: str | None):
    """The value of a JSON text, or None if there is none: malformed text is refused, never raised."""
    try:
        return None if text is None else json.loads(text)
    except (ValueError, RecursionError):
        return None


def well_formed(text: Column) -> Column:
    return F.try_parse_json(text).isNotNull()


@F.arrow_udf(T.StringType())
def string_projection(bodies: pa.Array) -> pa.Array:
    """Keep only strings of a nested value; every other scalar becomes null."""

    def keep(value):
        if isinstance(value, str):
            return value
        if isinstance(value, list):
            return [keep(v) for v in value]
        if isinstance(value, dict):
            return {k: keep(v) for k, v in value.items()}
        return None

    return pa.array(
        [None if (v := parsed(b)) is None and b != "null" else json.dumps(keep(v), ensure_ascii=False)
         for b in bodies.to_pylist()],
        pa.string(),
    )


@F.arrow_udf(T.ArrayType(T.StringType()))
def family_forms(bodies: pa.Array) -> pa.Array:
    """Two canonical texts of a body: normalised strings, and string shapes with type names."""
    import unicodedata

    unordered = {"document_tags", "tags", "types"}

    def tidy(text):
        return " ".join(unicodedata.normalize("NFKC", text).strip().casefold().split())

    def shape(text):
        words = len(text.split())
        return {"text_length_bucket": len(text) // 32, "token_count_bucket": words // 4}

    def kind(value):
        if value is None:
            return "object"
        return "boolean" if isinstance(value, bool) else "number"

    def rebuild(value, on_text, on_other, key=None):
        if isinstance(value, str):
            return on_text(tidy(value))
        if isinstance(value, list):
            out = [rebuild(v, on_text, on_other) for v in value]
            return sorted(out, key=render_canonical) if key in unordered else out
        if isinstance(value, dict):
            return {k: rebuild(v, on_text, on_other, k) for k, v in value.items()}
        return on_other(value)

    def one(body):
        value = parsed(body)
        if value is None and body != "null":
            return None
        return [
            render_canonical(rebuild(value, str, lambda v: v)),
            render_canonical(rebuild(value, shape, kind)),
        ]

    return pa.array(
        [b if b is None else one(b) for b in bodies.to_pylist()], pa.list_(pa.string())
    )


@F.arrow_udf(T.LongType())
def _walked_bytes(bodies: pa.Array) -> pa.Array:
    def total(value):
        size, waiting = 0, [value]
        while waiting:
            one = waiting.pop()
            if isinstance(one, str):
                size += len(one.encode("utf-8", "surrogatepass"))
            elif isinstance(one, list):
                waiting.extend(one)
            elif isinstance(one, dict):
                waiting.extend(one.values())
        return size

    return pa.array([None if b is None else total(parsed(b)) for b in bodies.to_pylist()], pa.int64())


def with_value_bytes(df: DataFrame, body: str = "body", target: str = "value_bytes") -> DataFrame:
    """UTF-8 bytes of all string values of a JSON body as sent, however many; keys do not count.

    Bodies without escapes are measured by pattern, the others are walked.
    """
    plain = ~F.col(body).contains("\\")
    walked = df.withColumn("_walked", _walked_bytes(F.when(~plain, F.col(body))))
    token = F.lit('"([^"]*)"\\s*+(:?)')
    strings = F.arrays_zip(F.regexp_extract_all(F.col(body), token, 1).alias("s"), F.regexp_extract_all(F.col(body), token, 2).alias("k"))
    values = F.transform(F.filter(strings, lambda t: t["k"] == ""), lambda t: t["s"])
    return walked.withColumn(target, F.when(plain, string_bytes(values)).otherwise(F.col("_walked"))).drop("_walked")


def string_bytes(texts: Column) -> Column:
    """UTF-8 bytes over an array of strings."""
    return F.aggregate(
        F.transform(texts, lambda t: F.octet_length(t).cast("long")),
        F.lit(0).cast("long"),
        lambda acc, n: acc + n,
    )
