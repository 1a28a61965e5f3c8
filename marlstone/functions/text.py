"""Text functions: Column in, Column out."""

from __future__ import annotations

import functools

from pyspark.sql import Column
from pyspark.sql import functions as F



def ws(c: Column) -> Column:
    """Unicode white space trimmed and runs collapsed to one space."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def squish_ascii(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def blank_to_null(c: Column) -> Column:
    t = F.trim(c)
    return F.when(t != "", t)


def drop_blank(a: Column) -> Column:
    return F.filter(F.transform(a, lambda x: F.trim(x)), lambda x: x.isNotNull() & (x != ""))


def left_runes(c: Column, n: int) -> Column:
    """The first n code points, without an ellipsis."""
    return F.substring(c, 1, n)


def strip_contacts(c: Column) -> Column:
    """E-mail addresses, then domestic phone numbers, replaced by a note; classes are ASCII."""
    mail = F.regexp_replace(c, r"[0-9A-Za-z_.+-]+@[0-9A-Za-z_-]+\.[0-9A-Za-z_.-]+", "[email removed]")
    return F.regexp_replace(mail, r"0[0-9]{1,2}[-\s]?[0-9]{3,4}[-\s]?[0-9]{4}", "[phone removed]")


def prompt_safe_line(c: Column) -> Column:
    """Control characters become spaces, angle brackets go, white space collapses."""
    return ws(F.regexp_replace(F.regexp_replace(c, r"\p{Cc}", " "), "[<>]", ""))


def slugify(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-|-$", "")


def md_text(c: Column) -> Column:
    """Markdown control characters escaped in one pass; line ends become spaces; null is empty."""
    flat = F.regexp_replace(F.coalesce(c, F.lit("")), r"\r\n|\n|\r", " ")
    return F.regexp_replace(flat, r"([\\`|*_\[\]()<>&])", r"\\$1")


def md_url(c: Column) -> Column:
    bare = F.replace(F.regexp_replace(F.trim(c), r"[<>\r\n]", ""), F.lit(" "), F.lit("%20"))
    return F.when(F.trim(F.coalesce(c, F.lit(""))) == "", F.lit("")).otherwise(F.concat(F.lit("<"), bare, F.lit(">")))


def any_of(c: Column, keywords: list[str]) -> Column:
    """Whether a lowered text holds any of the keywords; one that holds another keyword isn't looked for."""
    low = [k.lower() for k in keywords]
    least = [k for i, k in enumerate(low) if not any(o in k and (o != k or j < i) for j, o in enumerate(low) if j != i)]
    return functools.reduce(lambda x, y: x | y, [F.contains(c, F.lit(k)) for k in least])


#: The controlled vocabulary, in its order, and the fragments that imply each entry.
CATEGORIES = ("ai", "humanoid-robotics", "bio", "medical-devices", "digital-health")
AUDIENCES = ("b2b", "buyers", "investors", "manufacturers", "startups", "public")
CATEGORY_WORDS = {
    "ai": ["ai ", " ai", "ai엑스포", "ai expo", "인공지능", "artificial intelligence", "generative", "생성형", "딥러닝", "deep learning", "머신러닝", "machine learning", "llm", "챗봇", "데이터 사이언스"],
    "humanoid-robotics": ["로봇", "robot", "휴머노이드", "humanoid", "로보", "robo", "자동화", "automation", "스마트팩토리", "smart factory", "스마트 팩토리", "무인화", "협동로봇", "cobot"],
    "bio": ["바이오", "bio", "제약", "pharma", "신약", "biotech", "생명공학", "제약·바이오", "lab automation", "랩 자동화", "셀", "유전체", "genomics"],
    "medical-devices": ["의료기기", "medical device", "medical devices", "진단기기", "진단", "diagnostic", "병원설비", "병원", "hospital", "kimes", "수술", "surgical", "임플란트", "치과", "dental", "영상진단"],
    "digital-health": ["디지털 헬스", "디지털헬스", "digital health", "헬스케어", "healthcare", "health care", "재활", "rehabilitation", "원격의료", "telemedicine", "telehealth", "의료it", "헬스케어 it", "웰니스", "wellness"],
}
NON_INDUSTRY = ["유학설명회", "유학 설명회", "study abroad", "어학연수", "채용박람회", "채용 박람회", "취업박람회", "취업 박람회", "일자리 박람회", "잡페어", "job fair", "입시설명회", "입시 설명회", "대입", "수험생", "동문회", "총동창회", "alumni", "웨딩박람회", "웨딩 박람회", "wedding", "공무원", "고시", "자격증 시험"]
CATEGORY_ALIASES = {"robotics": "humanoid-robotics", "medical": "medical-devices", "health": "digital-health"}
COST_HINTS = ("free", "paid", "mixed", "unknown")


def ai_before_hangul(low: Column) -> Column:
    return F.regexp_like(low, F.lit("ai[가-힣]"))


def classify(c: Column) -> Column:
    """struct<categories, excluded, confidence>: exclusion words end it; else every category one of whose fragments occurs.

    The lowered text and the categories are each computed once, as elements of arrays that the next step reads.
    """
    none = F.expr("CAST(array() AS array<string>)")

    def found(low: Column) -> Column:
        hits = F.filter(F.array(*[F.when(any_of(low, words), F.lit(k)) for k, words in CATEGORY_WORDS.items()]), lambda x: x.isNotNull())
        return F.transform(F.array(hits), lambda h: F.when(F.size(h) > 0, h).when(ai_before_hangul(low), F.array(F.lit("ai"))).otherwise(none))[0]

    def allowed(low: Column) -> Column:
        return F.transform(F.array(found(low)), lambda h: F.when((F.size(h) > 0) & any_of(low, NON_INDUSTRY), none).otherwise(h))[0]

    cats = F.transform(F.array(F.lower(F.coalesce(c, F.lit("")))), allowed)
    return F.transform(cats, lambda k: F.struct(k.alias("categories"), (F.size(k) == 0).alias("excluded"), F.when(F.size(k) > 0, "high").otherwise("low").alias("confidence")))[0]


def cost_hint(low: Column) -> Column:
    free, paid = any_of(low, ["무료", "free"]), any_of(low, ["유료", "paid", "fee"])
    return F.when(free & paid, "mixed").when(free, "free").when(paid, "paid")


def venue_id(source: Column, name: Column) -> Column:
    """A venue's own source names it; other sources are resolved by the venue's name."""
    low = F.lower(name)
    return F.when(source.isin("coex", "kintex"), source).when(any_of(low, ["킨텍스", "kintex"]), "kintex").when(any_of(low, ["코엑스", "coex"]), "coex").otherwise("")


def latin_name(name: Column, source_name: Column) -> Column:
    """Whether at least half of a name's letters are ASCII and it differs from the source's name."""
    letters = F.length(F.regexp_replace(name, r"[^\p{L}]", ""))
    ascii_ = F.length(F.regexp_replace(name, "[^A-Za-z]", ""))
    return (letters > 0) & (2 * ascii_ >= letters) & (F.lower(F.trim(name)) != F.lower(F.trim(source_name)))


def norm_field(field: Column, v: Column) -> Column:
    """A field's value as scoring compares it: digits of dates, bare lower-case URLs, lowered text."""
    digits = F.array_join(F.regexp_extract_all(v, F.lit("([0-9]+)"), F.lit(1)), "")
    url = F.regexp_replace(F.lower(F.trim(v)), "/+$", "")
    return F.when(field.isin("start_raw", "end_raw"), digits).when(field == "homepage_url", url).otherwise(ws(F.lower(v)))


def field_match(field: Column, want: Column, got: Column) -> Column:
    """Whether an output agrees with what is wanted; a venue may have a hall or room behind it."""
    a, b = norm_field(field, F.coalesce(want, F.lit(""))), norm_field(field, F.coalesce(got, F.lit("")))
    return F.when((field == "venue_name") & (a != ""), F.contains(b, a)).otherwise(a == b)


def bracket_prefix(c: Column) -> Column:
    """An organiser of 1 to 40 characters in leading brackets."""
    return F.nullif(F.trim(F.regexp_extract(c, r"^\[([^\[\]]{1,40})\]", 1)), F.lit(""))


def split_period(c: Column, mark: str = "~") -> Column:
    """struct<start, end> of a period; a single date is both."""
    p = F.split(c, mark, 2)
    return F.struct(F.trim(p[0]).alias("start"), F.trim(F.coalesce(F.get(p, F.lit(1)), p[0])).alias("end"))
