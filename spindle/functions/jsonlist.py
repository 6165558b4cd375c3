"""Strict parsing of JSON text that should hold a list of strings.

The reference parses with ``json.loads`` and then validates the type of the record field:

* SQL NULL, malformed text or JSON ``null``  -> no list (a warning, the document goes on);
* well-formed JSON that is not a list of strings -> the record is rejected.

``from_json(..., 'array<string>')`` cannot tell these apart (it coerces numbers to strings and
keeps nulls), so the rule is written over the variant type instead.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

STATE_OK = "ok"
STATE_NULL = "null"
STATE_REJECT = "reject"


def parse_string_list(c: Column | str) -> Column:
    """STRUCT<value ARRAY<STRING>, state STRING> with state in ok / null / reject."""
    c = F.col(c) if isinstance(c, str) else c
    return variant_string_list(F.try_parse_json(c), F.from_json(c, "array<string>"))


def variant_string_list(v: Column, items: Column | None = None) -> Column:
    """The same for a value that is already a variant.

    The lambdas bind the variant and its list, so that a value is parsed once however often state and
    value are used. The type of the whole list tells strings from all else but null elements.
    ``items`` may give the list as another parser reads it, faster than it is cast from the variant.
    """

    got = F.try_variant_get(v, "$", "array<string>") if items is None else items
    parsed = F.transform(
        F.array(F.struct(v.alias("v"), got.alias("items"))),
        lambda x: F.struct((x["v"].isNull() | F.is_variant_null(x["v"])).alias("none"), F.schema_of_variant(x["v"]).alias("kind"), x["items"].alias("items")),
    )

    def judge(p: Column) -> Column:
        strings = p["kind"].isin("ARRAY<STRING>", "ARRAY<VOID>") & ~F.exists(p["items"], lambda e: e.isNull())
        state = F.when(p["none"], F.lit(STATE_NULL)).when(strings, F.lit(STATE_OK)).otherwise(F.lit(STATE_REJECT))
        return F.struct(p["items"].alias("items"), state.alias("state"))

    def answer(p: Column) -> Column:
        return F.struct(F.when(p["state"] == STATE_OK, p["items"]).alias("value"), p["state"].alias("state"))

    return F.get(F.transform(F.transform(parsed, judge), answer), 0)
