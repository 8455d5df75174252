"""Extraction results that arrive as JSON text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from rosterlake import vocab
from rosterlake.functions.phones import normalize_phone
from rosterlake.functions.text import bind, normalize_name


def _items(payload: Column, name: str) -> Column:
    """The list under ``name`` as JSON texts, one per item."""
    return F.coalesce(
        F.from_json(F.get_json_object(payload, f"$.{name}"), "array<variant>"),
        F.array().cast("array<variant>"),
    )


def _text_under(item: Column, key: str) -> Column:
    """The string under ``key`` of an object; NULL if blank or no string."""
    kind = F.schema_of_variant(F.try_variant_get(item, f"$.{key}", "variant"))
    text = F.try_variant_get(item, f"$.{key}", "string")
    return F.when((kind == "STRING") & (F.trim(text) != ""), text)


def _unwrap(item: Column, keys) -> Column:
    """A bare string, or the first non-blank string under one of the keys."""
    kind = F.schema_of_variant(item)
    return F.when(kind == "STRING", F.try_variant_get(item, "$", "string")).when(
        kind.startswith("OBJECT"), F.coalesce(*[_text_under(item, k) for k in keys])
    )


def payload_emails(payload: Column) -> Column:
    """Distinct trimmed lowered addresses of a contact payload."""
    values = F.transform(_items(payload, "emails"), lambda i: _unwrap(i, vocab.EMAIL_KEYS))
    addresses = F.filter(values, lambda v: v.contains("@"))
    return F.array_distinct(F.transform(addresses, lambda v: F.lower(F.trim(v))))


def payload_phones(payload: Column) -> Column:
    """Distinct standardised numbers of a contact payload."""
    values = F.transform(_items(payload, "phones"), lambda i: _unwrap(i, vocab.PHONE_KEYS))
    numbers = F.transform(F.filter(values, lambda v: v.isNotNull()), normalize_phone)
    return F.array_distinct(F.filter(numbers, lambda v: v.isNotNull()))


def _header_place(headers: Column, words) -> Column:
    """1-based place of the first header holding one of the words; 0 if none."""
    pattern = "|".join(words)
    hits = F.transform(headers, lambda h: F.lower(h).rlike(pattern))
    return F.array_position(hits, True).cast("int")


def table_rows(payload: Column) -> Column:
    """(name, district) pairs in the tables of a table payload, in order.

    A table without a recognisable name column is skipped whole. Rows may be
    lists or objects; an object counts as the list of its values.
    """
    tables = F.coalesce(
        F.from_json(
            F.get_json_object(payload, "$.tables"),
            "array<struct<headers: array<string>, rows: array<string>>>",
        ),
        F.array().cast("array<struct<headers: array<string>, rows: array<string>>>"),
    )

    def read_table(table: Column) -> Column:
        headers = F.coalesce(table["headers"], F.array().cast("array<string>"))
        rows = F.coalesce(table["rows"], F.array().cast("array<string>"))

        def read_rows(place: Column) -> Column:
            def read(row: Column) -> Column:
                as_list = F.from_json(row, "array<string>")
                as_map = F.map_values(F.from_json(row, "map<string,string>"))
                return bind(
                    F.when(row.startswith("["), as_list).otherwise(as_map),
                    lambda cells: F.struct(
                        F.trim(F.get(cells, place["name"] - 1)).alias("name"),
                        F.coalesce(
                            F.when(place["district"] > 0, F.trim(F.get(cells, place["district"] - 1))),
                            F.lit(""),
                        ).alias("district"),
                    ),
                )

            return F.when(place["name"] > 0, F.transform(rows, read)).otherwise(
                F.array().cast("array<struct<name: string, district: string>>")
            )

        return bind(
            F.struct(
                F.coalesce(_header_place(headers, vocab.NAME_HEADERS), F.lit(0)).alias("name"),
                F.coalesce(_header_place(headers, vocab.DISTRICT_HEADERS), F.lit(0)).alias("district"),
            ),
            read_rows,
        )

    pairs = F.flatten(F.transform(tables, read_table))
    return F.filter(
        pairs, lambda p: (F.length(p["name"]) >= 6) & (normalize_name(p["name"]) != "")
    )
