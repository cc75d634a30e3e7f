"""Base64 helpers used by the encoded-text scan and the envelope checks."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from memgov.functions.text import strip

# Runs of eight or more base64 characters that can look encoded. A run of letters only must have
# a length divisible by four and must not start with g to v, whose first byte is never UTF-8.
RUN = (
    r"(?<![\p{Alnum}+/=])(?=[\p{Alnum}+/=]{8})(?:\p{Alpha}*+[0-9+/=][\p{Alnum}+/=]*+"
    r"|[A-Za-fw-z]\p{Alpha}{3}(?:\p{Alpha}{4})++(?![\p{Alnum}+/=]))"
)
STRICT = r"^(?:[A-Za-z0-9+/]{4})*(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?$"
# Printable or white space, as one class: no control, format or unassigned characters.
READABLE = r"^(?:\P{C}|[\t-\r\x1c-\x1f\x85])+$"


def is_strict(text: Column) -> Column:
    return (F.length(text) % 4 == 0) & text.rlike(STRICT)


def decoded_text(text: Column) -> Column:
    """The decoded UTF-8 text, or null. Valid only where `is_strict` holds."""
    raw = F.unbase64(text).cast("string")
    return F.when(F.is_valid_utf8(raw), raw)


def hard_signal(text: Column) -> Column:
    return text.contains("=") | text.contains("+") | text.contains("/")


def weak_signal(text: Column) -> Column:
    return text.rlike("[0-9]") & text.rlike("[A-Z]") & text.rlike("[a-z]")


def looks_encoded(text: Column) -> Column:
    plain = F.when(is_strict(text), decoded_text(text))
    return (F.length(text) >= 8) & (
        hard_signal(text)
        | weak_signal(text)
        | F.coalesce(
            F.when(F.length(text) % 4 == 0, (F.length(plain) > 0) & plain.rlike(READABLE)),
            F.lit(False),
        )
    )


def fragment(text: Column) -> Column:
    """Base64 piece held by a field once separators are removed; null for prose and blanks."""
    stripped = strip(text)
    pieces = F.regexp_extract_all(stripped, F.lit(r"([\p{Alnum}+/=]+)"), 1)
    joined = F.array_join(pieces, "")
    separators = F.regexp_replace(stripped, r"[\p{Alnum}+/=]+", "")
    spaced = separators.rlike(r"(?U)[\s\x1c-\x1f]")
    long_piece = stripped.rlike(r"[\p{Alnum}+/=]{8}")
    return (
        F.when(stripped == "", None)
        .when(stripped.rlike(r"^[\p{Alnum}+/=]++$"), stripped)
        .when(stripped.contains(" ") & long_piece, None)
        .when(stripped.rlike(r"(?U)[\s\x1c-\x1f]") & long_piece, None)
        .when(separators.rlike(r"[\p{L}\p{N}]") | (F.size(pieces) < 2), None)
        .when(spaced & ~looks_encoded(joined), None)
        .otherwise(joined)
    )
