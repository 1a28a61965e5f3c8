"""Content hashes and keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from marlstone.functions.text import ws

NULL_MARK = "\x00null"


def length_prefixed(c: Column) -> Column:
    """Eight bytes of big-endian byte length, then the bytes."""
    return F.concat(F.unhex(F.lpad(F.hex(F.octet_length(c).cast("long")), 16, "0")), c.cast("binary"))


def canonical(fields: dict[str, Column]) -> dict[str, Column]:
    """Canonical text of each field: null apart from empty, white space normalised. Keys in byte order."""
    return {k: F.coalesce(ws(fields[k].cast("string")), F.lit(NULL_MARK)) for k in sorted(fields)}


def content_hash(fields: dict[str, Column]) -> Column:
    """SHA-256 over the length-prefixed keys and canonical values, in key order."""
    parts = []
    for k, v in canonical(fields).items():
        parts += [length_prefixed(F.lit(k)), length_prefixed(v)]
    return F.sha2(F.concat(*parts), 256)


def canonical_array(a: Column) -> Column:
    """Sorted JSON array of the normalised elements; null is the empty array."""
    none = F.expr("CAST(array() AS array<string>)")
    return F.to_json(F.array_sort(F.transform(F.coalesce(a, none), ws)))


def canonical_sources(a: Column) -> Column:
    """Sources without their time, normalised, distinct, ordered by their JSON."""
    none = F.expr("CAST(array() AS array<string>)")
    keys = F.transform(a, lambda s: F.to_json(F.array(ws(s["url"]), ws(s["type"]), ws(s["publisher"]))))
    return F.concat(F.lit("["), F.array_join(F.array_sort(F.array_distinct(F.coalesce(keys, none))), ","), F.lit("]"))


def normalize_name(c: Column) -> Column:
    """A name without year, edition, case and punctuation."""
    s = F.lower(F.trim(c))
    s = F.regexp_replace(s, "20[0-9]{2}년?", "")
    s = F.regexp_replace(s, r"제\s*[0-9]+\s*회", "")
    s = F.regexp_replace(s, r"(?<![0-9A-Za-z_])[0-9]+(?:st|nd|rd|th)(?![0-9A-Za-z_])", "")
    return F.regexp_replace(s, r"[^\p{L}\p{N}]+", "")


def content_key(name: Column, start_date: Column, venue: Column) -> Column:
    """name|date|venue, or null where a part is missing."""
    n = normalize_name(name)
    whole = (n != "") & (start_date != "") & (venue != "")
    return F.when(whole, F.concat_ws("|", n, start_date, venue))


def source_of(event_id: Column) -> Column:
    return F.when(F.instr(event_id, "-") > 1, F.substring_index(event_id, "-", 1)).otherwise("")


#: The rank of each source as owner of a record; others rank as DEFAULT_AUTHORITY.
AUTHORITY = {"coex": 100, "kintex": 100, "benchmark": 100, "showala": 10}
DEFAULT_AUTHORITY = 100


def authority(source: Column, ranks: dict[str, int] | None = None) -> Column:
    out = F.lit(DEFAULT_AUTHORITY)
    for k, v in (ranks or AUTHORITY).items():
        out = F.when(source == k, v).otherwise(out)
    return out
