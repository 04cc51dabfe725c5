"""JSON objects and string maps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pairforge.functions.text import as_col, let

EMPTY_MAP = "map<string,string>"


def merge_meta(old: Column | str, new: Column | str) -> Column:
    """Right side wins per key; a NULL side counts as empty."""

    def body(v: Column) -> Column:
        rest = F.map_filter(v["old"], lambda k, _: ~F.map_contains_key(v["new"], k))
        return F.map_concat(rest, v["new"])

    empty = F.create_map().cast(EMPTY_MAP)
    return let(
        F.struct(F.coalesce(as_col(old), empty).alias("old"), F.coalesce(as_col(new), empty).alias("new")), body
    )


def text_variant(c: Column) -> Column:
    """A string as a JSON string value."""
    return F.try_variant_get(F.try_parse_json(F.to_json(F.array(c))), "$[0]", "variant")


def set_fields(doc: Column, fields: dict[str, Column]) -> Column:
    """JSON text of the object ``doc`` (a variant) with some string fields replaced.
    All other keys keep value *and type*; non-ASCII text stays unescaped. NULL when
    ``doc`` is not an object."""
    names = [F.lit(n) for n in fields]

    def body(old: Column) -> Column:
        rest = F.map_filter(old, lambda k, _: ~F.array_contains(F.array(*names), k))
        values = F.array(*[text_variant(v) for v in fields.values()])
        return F.to_json(F.map_concat(rest, F.map_from_arrays(F.array(*names), values)))

    return let(F.try_variant_get(doc, "$", "map<string,variant>"), body)


def json_set(raw: Column | str, fields: dict[str, Column]) -> Column:
    """:func:`set_fields` on JSON text."""
    return set_fields(F.try_parse_json(as_col(raw)), fields)
