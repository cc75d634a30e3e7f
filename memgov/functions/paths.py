"""Request paths: dot segments, percent escapes, route classes and operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BANKS = "^/v1/default/banks/"
# --- fixed values: operations by method and path ---------------------------------------------
ROUTES = (
    ("POST", r"^/v1/default/banks/([^/]+)/memories$", "retain"),
    ("POST", r"^/v1/default/banks/([^/]+)/memories/recall$", "recall"),
    ("PUT", r"^/v1/default/banks/([^/]+)$", "bank"),
    ("PATCH", r"^/v1/default/banks/([^/]+)/config$", "config"),
    ("GET", r"^/v1/default/banks/([^/]+)/mental-models$", "mental-models.list"),
    ("POST", r"^/v1/default/banks/([^/]+)/mental-models$", "mental-models.create"),
    ("GET", r"^/v1/default/banks/([^/]+)/mental-models/([^/]+)$", "mental-models.read"),
    ("PATCH", r"^/v1/default/banks/([^/]+)/mental-models/([^/]+)$", "mental-models.update"),
    ("DELETE", r"^/v1/default/banks/([^/]+)/mental-models/([^/]+)$", "mental-models.delete"),
    ("POST", r"^/v1/default/banks/([^/]+)/reflect$", "reflect"),
)
ADMIN_ROUTES = (
    ("GET", r"^/admin/quarantine/queue$", "queue"),
    ("GET", r"^/admin/quarantine/stats$", "stats"),
    ("POST", r"^/admin/quarantine/cleanup$", "cleanup"),
    ("GET", r"^/admin/quarantine/items/([^/]+)$", "read_item"),
    ("POST", r"^/admin/quarantine/items/([^/]+)/approve$", "approve"),
    ("POST", r"^/admin/quarantine/items/([^/]+)/reject$", "reject"),
    ("POST", r"^/admin/quarantine/items/([^/]+)/postpone$", "postpone"),
)


def normalize_path(path: Column) -> Column:
    """Resolve `.` and `..` segments, also as %2e; a trailing dot segment leaves a slash."""
    parts = F.split(path, "/", -1)
    last = F.size(parts) - 1
    numbered = F.transform(parts, lambda p, i: F.struct(p.alias("part"), i.alias("at")))

    def step(acc: Column, seg: Column) -> Column:
        plain = F.regexp_replace(seg["part"], "(?i)%2e", ".")
        at_root = (F.size(acc) == 0) | ((F.size(acc) == 1) & (F.element_at(acc, 1) == ""))
        popped = F.when(at_root, acc).otherwise(F.slice(acc, 1, F.size(acc) - 1))
        tail = F.when(seg["at"] == last, F.array(F.lit(""))).otherwise(
            F.array().cast("array<string>")
        )
        return (
            F.when(plain == ".", F.concat(acc, tail))
            .when(plain == "..", F.concat(popped, tail))
            .otherwise(F.concat(acc, F.array(seg["part"])))
        )

    folded = F.array_join(F.aggregate(numbered, F.array().cast("array<string>"), step), "/")
    has_dots = path.rlike(r"(?i)(?:^|/)(?:\.|%2e){1,2}(?:/|$)")
    return F.when(has_dots, folded).otherwise(path)


def decode_segment(segment: Column) -> Column:
    """Percent-decoded text; null for malformed escapes and for invalid UTF-8."""
    malformed = segment.rlike("%(?![0-9A-Fa-f]{2})")
    # Bytes first: hex digits of escapes and of plain text, joined and read back as UTF-8.
    pieces = F.regexp_extract_all(segment, F.lit("(%[0-9A-Fa-f]{2}|[^%]+)"), 1)
    as_hex = F.transform(
        pieces,
        lambda p: F.when(p.startswith("%"), F.substring(p, 2, 2)).otherwise(F.hex(p)),
    )
    raw = F.unhex(F.array_join(as_hex, "")).cast("string")
    return (
        F.when(malformed, None)
        .when(~segment.contains("%"), segment)
        .when(F.is_valid_utf8(raw), raw)
    )


def route_class(path: Column) -> Column:
    return (
        F.when(path.isin("/health", "/health/ready", "/ready"), "readiness")
        .when(path == "/health/live", "liveness")
        .when(path == "/version", "version")
        .when(path.startswith("/admin/"), "admin")
        .when(path.rlike(BANKS + "[^/]+/memories(?:/recall)?$"), "memory")
        .when(path.startswith("/v1/default/banks/"), "facade")
        .otherwise("unmatched")
    )


def operation_of(method: Column, path: Column) -> Column:
    """Operation of a normalised path: `denied`, or `admin_not_found` below /admin/, otherwise."""
    found = F.when((method == "GET") & (path == "/version"), "version")
    for verb, pattern, name in ADMIN_ROUTES:
        found = found.when((method == verb) & path.rlike(pattern), name)
    found = found.when(path.startswith("/admin/"), "admin_not_found")
    for verb, pattern, name in ROUTES:
        found = found.when((method == verb) & path.rlike(pattern), name)
    return found.otherwise("denied")


def admin_scope(method: Column, path: Column) -> Column:
    return F.when(
        path.startswith("/admin/"),
        F.when(method == "GET", "read")
        .when((method == "POST") & (path == "/admin/quarantine/cleanup"), "cleanup")
        .otherwise("review"),
    )


def resolve_routes(access: DataFrame) -> DataFrame:
    """Add path, route_class, operation, admin_scope, writer_id, item_id and path_error."""
    known = [name for _, _, name in ROUTES]
    with_item = ["mental-models.read", "mental-models.update", "mental-models.delete"]
    reviews = ["read_item", "approve", "reject", "postpone"]
    path = F.col("path")
    operation = F.col("operation")
    writer = F.when(operation.isin(known), F.regexp_extract(path, BANKS + "([^/]+)", 1))
    item = F.when(operation.isin(with_item), F.regexp_extract(path, "mental-models/([^/]+)$", 1)).when(
        operation.isin(reviews), F.regexp_extract(path, "^/admin/quarantine/items/([^/]+)", 1)
    )
    return (
        access.withColumn("path", normalize_path(path))
        .withColumn("route_class", route_class(path))
        .withColumn("operation", operation_of(F.col("method"), path))
        .withColumn("admin_scope", admin_scope(F.col("method"), path))
        .withColumn("_writer", writer)
        .withColumn("_item", item)
        .withColumn("writer_id", decode_segment(F.col("_writer")))
        .withColumn("item_id", decode_segment(F.col("_item")))
        .withColumn(
            "path_error",
            F.when(
                (F.col("_writer").isNotNull() & F.col("writer_id").isNull())
                | (F.col("_item").isNotNull() & F.col("item_id").isNull()),
                "invalid_path_encoding",
            ),
        )
        .drop("_writer", "_item")
    )
