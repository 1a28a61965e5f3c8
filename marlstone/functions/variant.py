"""Strict reading of JSON that others have written: a shape is required, not guessed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a value of each plain type may be to a parser that knows it.
PLAIN = {"string": ("STRING",), "long": ("BIGINT",), "double": ("BIGINT", "DOUBLE"), "boolean": ("BOOLEAN",)}


def _is(v: Column, kinds: tuple[str, ...]) -> Column:
    kind = F.schema_of_variant(v)
    found = kind.isin(*kinds)
    return found | kind.startswith("DECIMAL") if "DOUBLE" in kinds else found


def _entries(v: Column) -> Column:
    return F.map_entries(F.try_variant_get(v, "$", "map<string,variant>"))


def conforms(v: Column, shape: str | list | dict) -> Column:
    """Whether a VARIANT has a shape: a plain type by name, [shape] for an array of it, {name: shape} for an object.

    Unknown fields and values of another type are refused, also deep inside; nulls and absent fields are allowed
    anywhere. Names match in any case. A null column (text that is no JSON, or names a field twice) is refused.
    """
    null = F.is_variant_null(v)
    if isinstance(shape, str):
        good = _is(v, PLAIN[shape])
    elif isinstance(shape, list):
        good = F.forall(F.try_variant_get(v, "$", "array<variant>"), lambda x: conforms(x, shape[0]))
    else:

        def known(e: Column) -> Column:
            out = F.lit(False)
            for name, inner in shape.items():
                out = F.when(F.lower(e["key"]) == name.lower(), conforms(e["value"], inner)).otherwise(out)
            return out

        good = F.forall(_entries(v), known)
    return F.coalesce(null | F.coalesce(good, F.lit(False)), F.lit(False))


def once(value: Column, use) -> Column:
    """What `use` makes of a value that is computed only once."""
    return F.transform(F.array(value), use)[0]


def strict(text: Column, shape: dict) -> Column:
    """The VARIANT of a JSON object of this shape, its fields' names as in `shape`; null for anything else.

    Where a name comes in several cases, the last in the order of code points counts."""
    # The parser stops behind the first value; with the text's digest behind it nothing else can stand there.
    digest = F.md5(text.cast("binary"))
    both = F.try_parse_json(F.concat(F.lit("["), text, F.lit(',"'), digest, F.lit('"]')))
    alone = once(both, lambda v: F.when(F.try_variant_get(v, "$[1]", "string") == digest, F.try_variant_get(v, "$[0]", "variant")))
    return once(alone, lambda v: F.when(F.coalesce(~F.is_variant_null(v), F.lit(False)) & conforms(v, shape), v))


def field(v: Column, name: str) -> Column:
    """An object's field by its name in any case; null where it is absent or null."""
    same = F.filter(_entries(v), lambda e: (F.lower(e["key"]) == name.lower()) & ~F.is_variant_null(e["value"]))
    return F.get(F.reverse(same), F.lit(0))["value"]


def text(v: Column, name: str) -> Column:
    """A text field; empty where it is absent or null."""
    return F.coalesce(F.try_variant_get(field(v, name), "$", "string"), F.lit(""))


def items(v: Column, name: str) -> Column:
    """An array field; empty where it is absent or null."""
    return F.coalesce(F.try_variant_get(field(v, name), "$", "array<variant>"), F.array().cast("array<variant>"))
