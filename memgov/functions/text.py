"""Text helpers: normal forms, white space, byte suffixes, review escapes."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPACE = r"[\s\x1c-\x1f]"
# White space at the ends of a text, as one trim set.
WHITE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
# NFKC leaves texts alone whose characters end at U+017E, but for these.
NFKC_PAST = "[^\\x00-\\u017e]"
NFKC_ODD = (
    "[\\u00a0\\u00a8\\u00aa\\u00af\\u00b2-\\u00b5\\u00b8-\\u00ba\\u00bc-\\u00be"
    "\\u0132\\u0133\\u013f\\u0140\\u0149]"
)
NON_ASCII = r"[^\x00-\x7f]"
# Zero-width marks, variation selectors and tag characters.
INVISIBLE = "[\\u200b\\u200c\\u200d\\u2060\\ufe00-\\ufe0f\\x{e0000}-\\x{e007f}]"
CONTROL_OR_INVISIBLE = (
    "[\\x00-\\x1f\\x7f-\\u009f\\u200b\\u200c\\u200d\\u2060\\ufe00-\\ufe0f\\x{e0000}-\\x{e007f}]"
)


def is_blank(text: Column) -> Column:
    return text.rlike(rf"(?U)^{SPACE}*$")


def strip(text: Column) -> Column:
    ends = F.concat(F.substring(text, 1, 1), F.substring(text, -1, 1))
    return F.when(ends.rlike(rf"(?U){SPACE}"), F.trim(text, F.lit(WHITE))).otherwise(text)


def nfkc_unsure(text: Column) -> Column:
    """True where NFKC may change the text; plain texts are settled by one pass."""
    near = text.rlike("[\\u00a0-\\u00be]") | text.rlike("[\\u0132-\\u0149]")
    return text.rlike(NON_ASCII) & (text.rlike(NFKC_PAST) | (near & text.rlike(NFKC_ODD)))


@F.arrow_udf(T.StringType())
def nfkc(texts: pa.Array) -> pa.Array:
    return pa.array(
        [None if t is None else unicodedata.normalize("NFKC", t) for t in texts.to_pylist()],
        pa.string(),
    )


@F.arrow_udf(T.StringType())
def casefold_text(texts: pa.Array) -> pa.Array:
    """NFKC, strip, casefold and collapse white space, for rows SQL cannot settle."""
    return pa.array(
        [
            None
            if t is None
            else " ".join(unicodedata.normalize("NFKC", t).strip().casefold().split())
            for t in texts.to_pylist()
        ],
        pa.string(),
    )


def composed(text: Column) -> Column:
    """NFKC; only rows with characters that may change are sent to Python."""
    return F.coalesce(nfkc(F.when(nfkc_unsure(text), text)), text)


_LISTS = T.StructType(
    [
        T.StructField("text", T.ArrayType(T.StringType())),
        T.StructField("changes", T.ArrayType(T.StringType())),
    ]
)


@F.arrow_udf(_LISTS)
def canonical_lists(rows: pa.Array) -> pa.Array:
    """Canonical text for arrays of texts, with the transformations applied anywhere in a row."""
    dropped = {cp: None for cp in (0x200B, 0x200C, 0x200D, 0x2060)}
    dropped.update(dict.fromkeys(range(0xFE00, 0xFE10)))
    dropped.update(dict.fromkeys(range(0xE0000, 0xE0080)))

    def one(texts):
        composed = [None if t is None else unicodedata.normalize("NFKC", t) for t in texts]
        final = [None if t is None else t.translate(dropped) for t in composed]
        changes = [
            name for name, before, after in
            (("invisible", composed, final), ("nfkc", texts, composed)) if before != after
        ]
        return {"text": final, "changes": changes}

    return pa.array(
        [None if row is None else one(row) for row in rows.to_pylist()],
        pa.struct([("text", pa.list_(pa.string())), ("changes", pa.list_(pa.string()))]),
    )


def drop_invisible(text: Column) -> Column:
    return F.when(text.rlike(NFKC_PAST), F.regexp_replace(text, INVISIBLE, "")).otherwise(text)


def with_canonical_text(df, source: str, target: str, changes: str):
    """Add the canonical text and the sorted list of transformations applied (nfkc, invisible)."""
    step = df.withColumn("_composed", composed(F.col(source)))
    flags = F.array_compact(
        F.array(
            F.when(
                F.col("_composed").rlike(NFKC_PAST) & F.col("_composed").rlike(INVISIBLE),
                F.lit("invisible"),
            ),
            F.when(F.col("_composed") != F.col(source), F.lit("nfkc")),
        )
    )
    return (
        step.withColumn(changes, flags)
        .withColumn(target, drop_invisible(F.col("_composed")))
        .drop("_composed")
    )


def collapse_ascii(text: Column) -> Column:
    squeezed = F.regexp_replace(F.lower(text), r"[\s\x1c-\x1f]+", " ")
    return F.trim(squeezed)


def normalize_text(text: Column) -> Column:
    """NFKC, strip, casefold, collapse white space. ASCII rows stay in SQL."""
    odd = text.rlike(NON_ASCII)
    return F.coalesce(casefold_text(F.when(odd, text)), collapse_ascii(text))


def token_count(normalized: Column) -> Column:
    return F.when(normalized == "", 0).otherwise(F.size(F.split(normalized, " ")))


def text_shape(normalized: Column) -> Column:
    """Length bucket (32 characters) and token bucket (4 tokens)."""
    return F.struct(
        F.floor(F.length(normalized) / 32).alias("text_length_bucket"),
        F.floor(token_count(normalized) / 4).alias("token_count_bucket"),
    )


def byte_suffix(text: Column, limit: int) -> Column:
    """The longest suffix of at most `limit` UTF-8 bytes that starts on a character."""
    tail = F.make_valid_utf8(F.substring(text.cast("binary"), -limit, limit).cast("string"))
    return F.when(F.octet_length(text) <= limit, text).otherwise(
        F.regexp_replace(tail, "^\\ufffd{1,3}", "")
    )


def _escapes() -> dict[int, str]:
    """How reviewers see each character that they could not see."""
    spans = ((0x00, 0x1F), (0x7F, 0x9F), (0x200B, 0x200D), (0x2060, 0x2060), (0xFE00, 0xFE0F), (0xE0000, 0xE007F))
    shown = {c: f"\\u{c:04X}" if c < 0x10000 else f"\\u{{{c:X}}}" for first, last in spans for c in range(first, last + 1)}
    return shown | {ord(c): repr(c)[1:-1] for c in "\n\r\t"}


_SHOWN = _escapes()


@F.arrow_udf(T.StringType())
def _escape_marks(texts: pa.Array) -> pa.Array:
    return pa.array([None if t is None else t.translate(_SHOWN) for t in texts.to_pylist()], pa.string())


@F.arrow_udf(T.StringType())
def escape_json_for_review(bodies: pa.Array) -> pa.Array:
    """The same for every string and key of a JSON value, however deep; null where the text is no JSON."""
    import json

    def shown(value):
        if isinstance(value, str):
            return value.translate(_SHOWN)
        if isinstance(value, list):
            return [shown(v) for v in value]
        if isinstance(value, dict):
            return {k.translate(_SHOWN): shown(v) for k, v in value.items()}
        return value

    def one(text):
        try:
            return None if text is None else json.dumps(shown(json.loads(text)), ensure_ascii=False)
        except (ValueError, RecursionError):
            return None

    return pa.array([one(t) for t in bodies.to_pylist()], pa.string())


def escape_for_review(text: Column) -> Column:
    """Show control and invisible characters as escapes; rows without any stay in SQL."""
    return F.coalesce(_escape_marks(F.when(text.rlike(CONTROL_OR_INVISIBLE), text)), text)


def needs_escape(text: Column) -> Column:
    return text.rlike(CONTROL_OR_INVISIBLE)
