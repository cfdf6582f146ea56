"""Content-free summaries of call arguments and results."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# How the fields of a call are treated.
TEXT_FIELDS = ("observation", "content", "context")
LIST_FIELDS = ("facts", "observations")
IDENTIFIER_FIELDS = ("entity", "from", "to", "label", "query")
RESULT_FIELDS = (
    "total_facts", "total", "stored", "deleted", "created", "found",
    "observations_attached", "compact",
)
RESULT_LISTS = {
    "results": "entity_groups", "entities": "entities", "events": "events", "facts": "facts",
}


def hash_identifier(c: Column, strict: bool = True) -> Column:
    if not strict:
        return c
    return F.when(c == "", c).otherwise(F.concat(F.lit("sha256:"), F.sha2(c, 256)))


def _json_type(v: Column) -> Column:
    """JSON type name of a variant."""
    kind = F.schema_of_variant(v)
    return (
        F.when(kind == "VOID", "null")
        .when(kind == "BOOLEAN", "boolean")
        .when(kind == "STRING", "string")
        .when(kind.startswith("ARRAY"), "array")
        .when(kind.startswith("OBJECT"), "object")
        .otherwise("number")
    )


def _fields(json: Column) -> Column:
    """The members of a JSON object as map<string, variant>; NULL for anything else."""
    return F.try_variant_get(F.try_parse_json(json), "$", "map<string,variant>")


def _text(v: Column) -> Column:
    return F.try_variant_get(v, "$", "string")


def _items(v: Column) -> Column:
    return F.size(F.try_variant_get(v, "$", "array<variant>"))


def sanitize_args(json: Column, strict: bool = False) -> Column:
    """JSON of the call arguments without content, keys in order."""

    def safe(key: Column, value: Column) -> Column:
        kind = _json_type(value)
        redacted = F.concat(F.lit("<redacted "), kind, F.lit(">"))
        text = F.concat(F.lit("<"), F.char_length(_text(value)).cast("string"), F.lit(" chars>"))
        count = F.concat(F.lit("<"), _items(value).cast("string"), F.lit(" "), key, F.lit(">"))
        summary = (
            F.when(key.isin(*TEXT_FIELDS), F.when(kind == "string", text).otherwise(redacted))
            .when(key.isin(*LIST_FIELDS), F.when(kind == "array", count).otherwise(redacted))
            .when(
                key.isin(*IDENTIFIER_FIELDS),
                F.when(kind == "string", hash_identifier(_text(value), strict)).otherwise(redacted),
            )
        )
        return F.when(summary.isNotNull(), summary.cast("variant")).otherwise(value)

    return F.to_json(F.transform_values(_fields(json), safe))


def summarize_result(json: Column) -> Column:
    """JSON of counts and flags of a result, never its content."""
    fields = _fields(json)
    kept = F.map_filter(fields, lambda k, v: k.isin(*RESULT_FIELDS))
    counted = F.map_filter(
        fields, lambda k, v: k.isin(*RESULT_LISTS) & (_json_type(v) == "array")
    )
    names = F.create_map(*[F.lit(x) for kv in RESULT_LISTS.items() for x in kv])
    counts = F.transform_values(
        F.transform_keys(counted, lambda k, v: F.element_at(names, k)),
        lambda k, v: _items(v).cast("variant"),
    )
    entries = F.array_sort(
        F.transform(F.map_keys(F.map_concat(kept, counts)), lambda k: k)
    )
    merged = F.map_concat(kept, counts)
    ordered = F.map_from_arrays(entries, F.transform(entries, lambda k: F.element_at(merged, k)))
    return F.to_json(ordered)
