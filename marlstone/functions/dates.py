"""Date functions on texts. Dates stay ISO strings, which compare as dates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

KST = "Asia/Seoul"
DATE = r"([0-9]{4})\s*[년./-]\s*([0-9]{1,2})\s*[월./-]\s*([0-9]{1,2})\s*일?"


def parse_date(raw: Column) -> Column:
    """ISO date of a text in one of five strict layouts, or null. A date-time keeps the date of its own offset."""
    t = F.trim(raw)

    def layout(mark: str) -> Column:
        m = rf"^([0-9]{{4}}){mark}([0-9]{{1,2}}){mark}([0-9]{{1,2}})$"
        return F.when(F.regexp_like(t, F.lit(m)), _iso(F.regexp_extract(t, m, 1), F.regexp_extract(t, m, 2), F.regexp_extract(t, m, 3)))

    full = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9](\.[0-9]+)?(Z|[+-]([01][0-9]|2[0-3]):[0-5][0-9])$"
    stamped = F.when(F.regexp_like(t, F.lit(full)), F.try_to_date(F.substring(t, 1, 10), "yyyy-MM-dd"))
    return F.date_format(F.coalesce(stamped, layout(r"\."), layout("-")), "yyyy-MM-dd")


def _iso(y: Column, m: Column, d: Column) -> Column:
    return F.try_to_date(F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0")), "yyyy-MM-dd")


def date_range(start_raw: Column, end_raw: Column) -> Column:
    """struct<start, end, confidence, note>: a range that ends before it starts is dropped whole."""
    s, e = parse_date(start_raw), parse_date(end_raw)
    wrong = F.coalesce(e < s, F.lit(False))
    note = F.when(wrong, F.concat(F.lit("end_date "), e, F.lit(" precedes start_date "), s, F.lit("; both dropped"))).otherwise("")
    return F.struct(F.when(~wrong, s).alias("start"), F.when(~wrong, e).alias("end"), F.when(wrong | s.isNull() | e.isNull(), "low").otherwise("high").alias("confidence"), note.alias("note"))


def normalize_deadline(raw: Column) -> Column:
    """ISO date of the first date in a deadline text; years 2000 to 2100, days to 31 without a calendar check."""
    part = lambda t, i: F.regexp_extract(t, DATE, i).try_cast("int")
    two = lambda n: F.lpad(n.cast("string"), 2, "0")

    def told(p: Column) -> Column:
        ok = p["y"].between(2000, 2100) & p["m"].between(1, 12) & p["d"].between(1, 31)
        return F.when(ok, F.concat_ws("-", p["y"].cast("string"), two(p["m"]), two(p["d"])))

    # Text, parts and date are each computed once, as elements of arrays that the next step reads.
    parts = F.transform(F.array(raw), lambda t: F.struct(part(t, 1).alias("y"), part(t, 2).alias("m"), part(t, 3).alias("d")))
    return F.transform(parts, told)[0]


def date_evidence(text: Column, iso: Column) -> Column:
    """Whether an ISO date stands in a text in any usual shape, the year left out included."""
    return stands_in(text, date_shapes(iso))


def date_shapes(iso: Column) -> Column:
    """struct<iso, full, short>: the patterns of an ISO date with its year and without; computed once for any number of texts."""
    y, m, d = F.substring(iso, 1, 4), F.regexp_replace(F.substring(iso, 6, 2), "^0", ""), F.regexp_replace(F.substring(iso, 9, 2), "^0", "")
    full = F.concat(y, F.lit(r"\s*[-./년]\s*0?"), m, F.lit(r"\s*[-./월]\s*0?"), d)
    short = F.concat(F.lit("(^|[^0-9])0?"), m, F.lit(r"\s*[./월]\s*0?"), d, F.lit("($|[^0-9])"))
    return F.struct(iso.alias("iso"), full.alias("full"), short.alias("short"))


def stands_in(text: Column, shapes: Column) -> Column:
    """Whether a date of `date_shapes` stands in a text."""
    whole = F.regexp_like(shapes["iso"], F.lit(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"))
    return whole & (F.regexp_like(text, shapes["full"]) | F.regexp_like(text, shapes["short"]))


def date_context(text: Column, iso: Column) -> Column:
    """The first mention of an ISO date, in full or else without its year, with 90 characters on each side; null if there is none."""
    y, m, d = F.substring(iso, 1, 4), F.substring(iso, 6, 2).try_cast("int").cast("string"), F.substring(iso, 9, 2).try_cast("int").cast("string")
    full = F.concat(y, F.lit(r"\s*[-./년]\s*0?"), m, F.lit(r"\s*[-./월]\s*0?"), d)
    short = F.concat(F.lit(r"(?<![0-9])0?"), m, F.lit(r"\s*[./월]\s*0?"), d, F.lit("(?![0-9])"))
    return F.when(F.regexp_like(iso, F.lit(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$")), F.coalesce(find_in_context(text, full), find_in_context(text, short)))


def find_in_context(text: Column, pattern: str | Column, around: int = 90) -> Column:
    """The first match with `around` characters on each side, white space collapsed; null without a match."""
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    at = F.regexp_instr(text, pattern)
    size = F.length(F.regexp_substr(text, pattern))
    lo = F.greatest(F.lit(1), at - around)
    cut = F.substr(text, lo, at + size + around - lo)
    return F.when(at > 0, F.trim(F.regexp_replace(cut, r"\s+", " ")))


def deadline_near(low: Column, labels: list[str], window: int = 80) -> Column:
    """The first date within `window` bytes of the first label that has one."""
    raw = F.encode(low, "UTF-8")

    def one(label: str) -> Column:
        at = F.instr(low, label)
        bytes_before = F.octet_length(F.substr(low, F.lit(1), at - 1))
        near = F.substring(raw, bytes_before + 1, F.lit(window)).cast("string")  # a cut character matches nothing
        hit = F.regexp_substr(near, F.lit(r"20[0-9]{2}[.-][01]?[0-9][.-][0-3]?[0-9]"))
        return F.when(at > 0, hit)

    return F.coalesce(*[one(x.lower()) for x in labels])


def kst_date(ts: Column) -> Column:
    """The Korean calendar date of a UTC time without zone."""
    return F.to_date(F.from_utc_timestamp(ts.cast("timestamp"), KST))
