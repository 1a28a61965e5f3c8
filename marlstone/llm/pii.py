r"""Personal data by candidate gradient boosting, in DataFrame operations only.

Generators of high recall propose overlapping spans: the base patterns, numbers with separators, addresses written with
"at" and "dot", and hexadecimal groups with colons. Features of a candidate's format and context go into boosted trees,
which are column expressions; a candidate whose score passes its kind's calibrated threshold is added to the base spans.
Trees and thresholds are fitted on the rule-made labelled table of `examples`, at most `MOST_EXAMPLES` rows, whose
features come from the same expressions.

Positions come from splitting a text at a pattern's matches, so each text is read once per pattern, and never leaves its
row: no shuffle. Patterns are possessive and anchored at run starts, which keeps them linear on texts without spaces.
Positions are running sums, and overlaps are found by running maxima over sorted moments, so that a text of very many
matches costs no more for each of them.

Null and empty texts have no spans. Repeated rows are read each by itself. Of findings that overlap, equally far above
their thresholds, the one that starts first stays, then the kind listed first. An empty table gives an empty one. Other
columns are not read.
"""

from __future__ import annotations

import random
from collections.abc import Callable
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm import boosting
from marlstone.llm.common import documents

KINDS = ("email", "ip", "card", "phone")
MOST_EXAMPLES = 4000
PRECISION = 0.995

#: The base patterns. A run is entered at its start or where the last match ended, as a plain search would.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){11,18}+(?![ -]?[0-9])"
PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
#: The further generators.
NUMBER = r"(?<![0-9A-Za-z])[(]?[0-9](?:[ ()./-]{0,2}+[0-9]){6,18}+(?![0-9])"
WRITTEN = r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?(?:\(at\)|\[at\]|\{at\}|<at>| at |@) ?[A-Za-z0-9-]{1,63}+(?: ?(?:\(dot\)|\[dot\]|\{dot\}|<dot>| dot |\.) ?[A-Za-z0-9-]{1,63}+){1,6}+"
COLONS = r"(?<![0-9A-Za-z:])[0-9A-Fa-f]{0,4}+(?::[0-9A-Fa-f]{0,4}+){2,7}+(?![0-9A-Za-z:])"

#: Words that speak for a kind, and words that speak against personal data, just before a candidate.
CUES = {
    "email": r"(?i)(?:mail|contact|write|reach|correo|courriel|kontakt|schreib|escrib|address)",
    "ip": r"(?i)(?:\bip\b|ipv6|host|server|addr|client|from)",
    "card": r"(?i)(?:card|visa|master|amex|credit|debit|karte|carte|tarjeta|\bcc\b)",
    "phone": r"(?i)(?:phone|\btel|call|fax|mobil|cell|whatsapp|\bsms\b|ring|appel|anruf|ruf|llam|m[oó]vil|handy)",
}
AGAINST = r"(?i)(?:order|invoice|isbn|issn|doi|version|\bref|\bid\b|serial|ticket|tracking|\bno\b|\bnr\b|page|pages|year|between|price|total|date|score|table|[$€£#=]) ?[.:#]? ?$"


#: What a text must have for a pattern to match at all; cheaper to look for than the pattern.
NEEDS = {
    "email": lambda t: F.contains(t, F.lit("@")),
    "ip": lambda t: F.regexp_like(t, F.lit(r"[0-9]\.[0-9]")),
    "card": lambda t: F.regexp_like(t, F.lit("[0-9][ -]?[0-9]")),
    "phone": lambda t: F.contains(t, F.lit("+")),
    "number": lambda t: F.regexp_like(t, F.lit("[0-9][ ()./-]{0,2}[0-9]")),
    "written": lambda t: F.regexp_like(t, F.lit(r"(?i)[(\[{<]at[)\]}>]| @|@ | at [A-Za-z0-9-]{1,63}+(?: ?[(\[{<]dot| dot | ?\.[a-z])")),
    "colons": lambda t: F.regexp_like(t, F.lit("[0-9A-Fa-f]:[0-9A-Fa-f:]|::")),
}
PATTERNS = {"email": EMAIL, "ip": IP, "card": CARD, "phone": PHONE, "number": NUMBER, "written": WRITTEN, "colons": COLONS}
MATCHES = "array<struct<start:bigint,end:bigint,value:string,before:string,after:string>>"


#: Elements that are summed up together; an array is copied once for each.
BLOCK = 64


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """What `use` makes of a value that is computed only once, also where `use` reads it for every element of an array."""
    return F.transform(F.array(value), use)[0]


def running(items: Column, weight: Callable[[Column], Column], how: str) -> Column:
    """array<bigint>: for each element the sum or maximum ("sum", "max") of the weights up to it, in linear time.

    Blocks are added up first, then the blocks' totals, then each block from what stands before it: only arrays of a
    block, and one of the totals, are grown by appending. Maxima of nothing are -1.
    """
    none, empty = F.lit(0 if how == "sum" else -1).cast("long"), F.expr("CAST(array() AS array<bigint>)")
    plus = (lambda a, x: a + x) if how == "sum" else F.greatest
    state = lambda v: F.struct(v.alias("v"), empty.alias("out"))
    grown = lambda acc, v, x: F.struct(x.alias("v"), F.concat(acc["out"], F.array(v)).alias("out"))

    def blocks(a: Column) -> Column:
        part = lambda j: F.slice(a, j * BLOCK + 1, F.lit(BLOCK))
        every = F.sequence(F.lit(0), F.greatest(F.ceil(F.size(a) / BLOCK).cast("int") - 1, F.lit(0)))
        total = lambda j: F.aggregate(part(j), none, lambda acc, x: plus(acc, weight(x).cast("long")))
        before = F.aggregate(F.transform(every, total), state(none), lambda acc, x: grown(acc, acc["v"], plus(acc["v"], x)), lambda acc: acc["out"])

        def step(acc: Column, x: Column) -> Column:
            v = plus(acc["v"], weight(x).cast("long"))
            return grown(acc, v, v)

        inside = lambda j, b: F.aggregate(part(j), state(F.get(b, j)), step, lambda acc: acc["out"])
        return once(before, lambda b: F.flatten(F.transform(every, lambda j: inside(j, b))))

    return once(items, blocks)


def at_moments(asked: Column, held: Column, at: Callable[[Column], Column], of: Callable[[Column], tuple[Column, Column]], how: str, same: bool) -> Column:
    """array<bigint>: for each element of `asked` the running sum or maximum, at its place `at`, of the (place, weight) that `of`
    gives for the elements of `held`; what stands at that very place counts if `same`."""
    late = 0 if same else 2
    none = F.lit(0 if how == "sum" else -1).cast("long")
    moment = lambda place, order, i, w: F.struct(place.cast("long").alias("at"), F.lit(order).alias("order"), i.cast("long").alias("i"), w.cast("long").alias("w"))
    every = F.concat(F.transform(asked, lambda x, i: moment(at(x), 1, i, none)), F.transform(held, lambda x, i: moment(of(x)[0], late, i, of(x)[1])))

    def read(m: Column) -> Column:
        found = F.zip_with(m, running(m, lambda x: x["w"], how), lambda x, v: F.struct(x["i"].alias("i"), x["order"].alias("order"), v.alias("v")))
        return F.transform(F.sort_array(F.filter(found, lambda x: x["order"] == 1)), lambda x: x["v"])

    return once(F.sort_array(every), read)


def apart(spans: Column, others: Column) -> Column:
    """The spans that none of the others overlaps: of those that start before a span's end, the furthest end isn't past its start."""
    reach = at_moments(spans, others, lambda c: c["end"], lambda b: (b["start"], b["end"]), "max", False)
    free = F.filter(F.zip_with(spans, reach, lambda c, r: F.struct(c.alias("c"), r.alias("r"))), lambda x: x["r"] <= x["c"]["start"])
    return F.when(F.size(others) == 0, spans).otherwise(F.transform(free, lambda x: x["c"]))


def strongest(spans: Column) -> Column:
    """The spans (start, kind, end, margin) that no overlapping one beats by margin, then by start and kind, sorted.

    In order of their starts, all that may overlap a span stand between the first whose running furthest end is past the
    span's start and the last that starts before its end. Candidates have bounded lengths, so these are few.
    """

    def pick(s: Column) -> Column:
        def within(ends: Column) -> Column:
            before = at_moments(s, ends, lambda c: c["start"], lambda e: (e, F.lit(1)), "sum", True)
            upto = at_moments(s, s, lambda c: c["end"], lambda o: (o["start"], F.lit(1)), "sum", False)
            return F.zip_with(before, upto, lambda lo, hi: F.struct(lo.cast("int").alias("lo"), hi.cast("int").alias("hi")))

        beats = lambda o, c: (o["start"] < c["end"]) & (c["start"] < o["end"]) & (F.struct(o["margin"], -o["start"], -o["kind"]) > F.struct(c["margin"], -c["start"], -c["kind"]))
        stays = lambda x: ~F.exists(F.slice(s, x["w"]["lo"] + 1, F.greatest(x["w"]["hi"] - x["w"]["lo"], F.lit(0))), lambda o: beats(o, x["c"]))
        both = F.zip_with(s, once(running(s, lambda c: c["end"], "max"), within), lambda c, w: F.struct(c.alias("c"), w.alias("w")))
        return F.transform(F.filter(both, stays), lambda x: x["c"])

    return F.when(F.size(spans) < 2, spans).otherwise(once(F.sort_array(spans), pick))


def _located(df: DataFrame) -> DataFrame:
    """Replaces `text` by a column for each pattern: its matches as array<struct<start, end, value, before, after>>.

    A pattern cuts the text into gaps and values once; the second projection only adds up their lengths.
    """
    text, others = F.col("text"), [c for c in df.columns if c != "text"]
    none = F.expr("CAST(array() AS array<string>)")
    cuts = []
    for name, pattern in PATTERNS.items():
        has = NEEDS[name](text)
        cuts += [F.when(has, F.split(text, pattern, -1)).otherwise(none).alias(f"g_{name}"), F.when(has, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(none).alias(f"v_{name}")]

    def found(name: str) -> Column:
        gaps = F.col(f"g_{name}")
        zipped = F.arrays_zip(gaps.alias("gap"), F.col(f"v_{name}").alias("value"), F.slice(gaps, F.lit(2), F.greatest(F.size(gaps) - 1, F.lit(0))).alias("after"))

        def placed(x: Column, end: Column) -> Column:
            start = end - F.length(x["value"])
            return F.struct(start.alias("start"), end.alias("end"), x["value"].alias("value"), F.right(x["gap"], F.lit(24)).alias("before"), F.left(x["after"], F.lit(8)).alias("after"))

        ends = lambda z: running(z, lambda x: F.length(x["gap"]) + F.length(x["value"]), "sum")
        every = once(F.filter(zipped, lambda x: x["value"].isNotNull()), lambda z: F.zip_with(z, ends(z), placed))
        return F.when(F.size(f"v_{name}") > 0, every).otherwise(F.expr(f"CAST(array() AS {MATCHES})"))

    return df.select(*others, *cuts).select(*others, *[found(n).alias(f"m_{n}") for n in PATTERNS])


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def value(ch: Column, i: Column) -> Column:
        n = ch.cast("int") * F.when(i % 2 == 1, 2).otherwise(1)
        return n - F.when(n > 9, 9).otherwise(0)

    each = F.transform(F.split(F.reverse(digits), "(?<=.)(?=.)"), value)
    return F.aggregate(each, F.lit(0), lambda a, n: a + n) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.regexp_like(value, F.lit(r"^0*+(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})?(?:\.0*+(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})?){3}$"))
    if kind == "card":
        return _luhn(_digits(value))
    if kind == "phone":
        return F.length(_digits(value)).between(9, 15)
    return F.lit(True)


def base() -> Column:
    """The base spans of a located text: array<struct<start, kind, end>>, kind as its number; not sorted."""

    def kept(kind: str) -> Column:
        ok = F.filter(f"m_{kind}", lambda x: _valid(kind, x["value"]))
        return F.transform(ok, lambda x: F.struct(x["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), x["end"].alias("end")))

    return F.concat(*[kept(k) for k in KINDS])


FEATURES = ("kind", "digits", "length", "marks", "groups", "longest", "shortest", "parens", "luhn", "dots", "hyphens", "spaces", "cue", "against", "tight_before", "tight_after", "phone_shape", "card_shape", "date_shape", "at_bracket", "dot_word", "known_end", "colons", "hex_letter", "pair_shape")


def features(x: Column) -> Column:
    """The features of a candidate (start, kind, end, value, before, after), in the order of `FEATURES`."""
    v, before, after = x["value"], x["before"], x["after"]

    def flag(c: Column) -> Column:
        return F.coalesce(c, F.lit(False)).cast("double")

    def like(c: Column, pattern: str) -> Column:
        return flag(F.regexp_like(c, F.lit(pattern)))

    digits = _digits(v)
    sizes = F.transform(F.filter(F.split(v, "[^0-9]+"), lambda g: F.length(g) > 0), lambda g: F.length(g))
    cue = F.coalesce(*[F.when(x["kind"] == i, like(before, CUES[k])) for i, k in enumerate(KINDS)])
    every = [
        x["kind"].cast("double"),
        F.length(digits).cast("double"),
        F.length(v).cast("double"),
        F.length(F.regexp_replace(v, "[0-9A-Za-z]", "")).cast("double"),
        F.size(sizes).cast("double"),
        F.coalesce(F.array_max(sizes), F.lit(0)).cast("double"),
        F.coalesce(F.array_min(sizes), F.lit(0)).cast("double"),
        like(v, "[()]"),
        F.when(F.length(digits).between(12, 19), flag(_luhn(digits))).otherwise(0.0),
        like(v, r"[0-9]\.[0-9]"),
        like(v, "-"),
        like(v, " "),
        cue,
        like(before, AGAINST),
        like(before, r"[0-9A-Za-z@_/$€£#=.,-]$"),
        like(after, r"^[0-9A-Za-z@_/%€:-]|^[.,][0-9]"),
        like(v, r"^\(?[0-9]{2,5}\)?[ ./-]{1,2}[0-9]{3,4}[ .-][0-9]{4}$"),
        like(v, r"^[0-9]{4}([ .-])[0-9]{4}\1[0-9]{4}\1[0-9]{4}$"),
        like(v, r"^(?:[0-9]{4}[-./][0-9]{1,2}[-./][0-9]{1,2}|[0-9]{1,2}[-./][0-9]{1,2}[-./][0-9]{4})"),
        like(v, r"(?i)[(\[{<]at[)\]}>]"),
        like(v, r"(?i)(?: dot |[(\[{<]dot[)\]}>])"),
        like(v, r"(?i)(?:\.|dot[)\]}>]? ?)(?:com|org|net|edu|gov|io|info|de|fr|es|uk|eu)$"),
        F.length(F.regexp_replace(v, "[^:]", "")).cast("double"),
        like(v, "[A-Fa-f]"),
        like(v, r"^\(?0[0-9](?:[ .-][0-9]{2}){4}$|^0[0-9]{2,4}[ /-][0-9]{5,8}$"),
    ]
    return F.array(*every)


def candidates() -> Column:
    """What the further generators propose in a located text: array<struct<start, kind, end, value, before, after>>."""

    def proposed(name: str, kind: str, fits) -> Column:
        ok = F.filter(f"m_{name}", lambda x: fits(x["value"]))
        return F.transform(ok, lambda x: F.struct(x["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), x["end"].alias("end"), *[x[c].alias(c) for c in ("value", "before", "after")]))

    return F.concat(
        proposed("written", "email", lambda v: ~F.regexp_like(v, F.lit(r"^[^ ]*[0-9A-Za-z._%+-]@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+$"))),
        proposed("colons", "ip", lambda v: F.length(v) >= 5),
        proposed("number", "card", lambda v: F.length(_digits(v)).between(12, 19)),
        proposed("number", "phone", lambda v: F.length(_digits(v)).between(7, 15)),
    )


# --- the model ----------------------------------------------------------------------------------------------------------


def examples(seed: int = 11) -> list[tuple[int, str]]:
    """(label, text) by rule: 1 where what stands between the bars is personal data, 0 where it only looks like it."""
    rng = random.Random(seed)
    fill = ("the", "note", "und", "para", "les", "of it", "ontion", "seen", "was", "ist", "que", "more")
    good = {
        "phone": ["(###) ###-####", "###-###-####", "###.###.####", "### ### ####", "0# ## ## ## ##", "0### ######", "0###/#######", "(0##) ####-####", "00## ### #######", "0## #### ####"],
        "card": ["#### #### #### ####", "####-####-####-####", "####.####.####.####", "################", "#### ###### #####"],
        "email": ["@n (at) @d (dot) @t", "@n [at] @d [dot] @t", "@n(at)@d.@t", "@n at @d dot @t", "@n @ @d.@t", "@n {at} @d {dot} @t", "@n [at] @d.@t", "@n AT @d DOT @t"],
        "ip": ["2001:db8::x:x", "fe80::x:x:x:x", "x:x:x:x:x:x:x:x", "2a02:x:x::1"],
    }
    said = {"phone": ["call", "Tel.", "tel:", "phone", "Phone:", "fax", "mobile", "WhatsApp", "Telefon", "teléfono móvil", "appelez", "cell"], "card": ["card", "Visa", "credit card number", "Mastercard:", "carte", "Karte", "tarjeta"], "email": ["mail", "contact", "write to", "e-mail:", "correo", ""], "ip": ["from", "host", "ip", "server", "client", ""]}
    bad = ["####-0#-1#", "1#/0#/19## 1#:##", "19## - 20##", "19## 20## 19##", "#.##### #.####", "978-#-###-#####-#", "#.#.#.#.#.#.#", "# ### ###", "## ## ## ## ## ##", "#######", "############", "################", "### ### ###", "# # # # # # # #", "####/##/####", "##-##-####-##", "###########", "#########", "### #### ##"]
    not_ip = ["1#:##:##", "ab:cd:ef:##:##:##", "a:b:c", "##:##:##:##", "1#:##:##:##"]
    not_mail = ["look at @d.@t", "was at home. Then", "met at noon. The", "sat at it. And", "@w at @w. @w", "@w at @w.@w", "is at the dot"]
    against = ["order", "invoice no", "ISBN", "version", "ref:", "ID", "ticket #", "total", "year", "table", "pages", "price $"]

    def made(t: str) -> str:
        t = t.replace("@n", rng.choice(["john.doe", "anna", "m.smith", "info", "k_lee", "user" + str(rng.randrange(99))]))
        t = t.replace("@d", rng.choice(["example", "mail", "corp-site", "uni", "acme"])).replace("@t", rng.choice(["com", "org", "net", "de", "co.uk", "fr"]))
        while "@w" in t:
            t = t.replace("@w", rng.choice(["noon", "home", "era", "thing", "Then", "hath", "ontion", "an"]), 1)
        t = "".join(rng.choice("0123456789abcdef") * 1 if c == "x" else c for c in t)
        return "".join(rng.choice("0123456789") if c == "#" else c for c in t)

    def luhn_ok(t: str) -> str:
        digits = [int(c) for c in t if c.isdigit()]
        total = sum(d * 2 - 9 * (d > 4) if i % 2 else d for i, d in enumerate(reversed(digits[:-1] + [0])))
        last = str(-total % 10)
        return t[:-1] + last

    out = []
    for kind, shapes in good.items():
        for shape in shapes:
            for n in range(26):
                v = made(shape)
                if kind == "card" and n % 3:
                    v = luhn_ok(v)
                bare = kind in ("email", "ip") or (kind == "phone" and shape in ("(###) ###-####", "###-###-####")) or (kind == "card" and n % 3 and "." in shape)
                cue = rng.choice(said[kind]) if not bare or n % 2 else ""
                out.append((1, f"{rng.choice(fill)} {cue} |{v}| {rng.choice(fill)}"))
    for shapes, times in ((bad, 40), (not_ip, 40), (not_mail, 40)):
        for shape in shapes:
            for n in range(times):
                cue = rng.choice(against) if n % 2 else rng.choice(fill)
                out.append((0, f"{rng.choice(fill)} {cue} |{made(shape)}| {rng.choice(fill)}"))
    rng.shuffle(out)
    return out[:MOST_EXAMPLES]


@lru_cache(maxsize=1)
def _model(spark: SparkSession) -> tuple[list[dict], list[float]]:
    """Trees and a threshold per kind. A third of the examples is held out for the thresholds."""
    lines = [f"{label}\t{text.index('|')}\t{text.rindex('|') - 1}\t{text.replace('|', '')}" for label, text in examples()]
    rows = spark.range(1).select(F.posexplode(F.split(F.lit("\n".join(lines)), "\n")).alias("n", "line"))
    part = F.split("line", "\t")
    rows = rows.select("n", part[0].cast("int").alias("y"), part[1].cast("int").alias("a"), part[2].cast("int").alias("b"), part[3].alias("text"))
    c = _located(rows).select("n", "y", "a", "b", F.explode(candidates()).alias("c")).where("c.end > a AND c.start < b")
    got = sorted(c.select("n", (F.col("y") == 1) & (F.col("c.start") <= F.col("a")) & (F.col("c.end") >= F.col("b")), "c.kind", features(F.col("c"))).collect(), key=lambda r: (r[0], r[2], tuple(r[3])))
    x, y = np.array([r[3] for r in got]), np.array([float(r[1]) for r in got])
    kind = np.array([r[2] for r in got])
    # A candidate of another kind than what stands there is no finding.
    true_kind = {n: _kind_of(label, text) for n, (label, text) in enumerate(examples())}
    y = np.where(kind == np.array([true_kind[r[0]] for r in got]), y, 0.0)
    held = np.array([r[0] % 3 == 0 for r in got])
    trees = boosting.fit(x[~held], y[~held])
    score = boosting.predict(trees, x[held])
    return trees, [max(0.0, boosting.threshold(score[kind[held] == k], y[held][kind[held] == k], PRECISION)) for k in range(len(KINDS))]


def _kind_of(label: int, text: str) -> int:
    v = text[text.index("|") + 1 : text.rindex("|")]
    if not label:
        return -1
    if ":" in v:
        return 1
    if any(c.isalpha() for c in v):
        return 0
    return 2 if sum(c.isdigit() for c in v) >= 14 else 3


def find(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, base, spans): array<struct<start, kind, end>> sorted by start, then kind; spans has the base and what the
    model adds."""
    trees, cuts = _model(df.sparkSession)
    rows = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = _located(rows).select("id", base().alias("base"), candidates().alias("c"))
    fresh = apart(F.col("c"), F.col("base"))
    margin = lambda c: once(features(c), lambda f: boosting.expression(trees, f)) - F.element_at(F.array(*[F.lit(t) for t in cuts]), c["kind"] + 1)
    scored = F.transform(fresh, lambda c: F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end"), margin(c).alias("margin")))
    rows = rows.select("id", F.sort_array("base").alias("base"), F.filter(scored, lambda c: c["margin"] > 0).alias("c"))
    # Of overlapping findings the one furthest above its threshold stays.
    best = strongest(F.col("c"))
    added = F.transform(best, lambda c: F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end")))
    return rows.select("id", "base", F.sort_array(F.concat("base", added)).alias("spans"))


def joined(spans: Column) -> Column:
    name = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(name, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def op1_pii(spark, sf_dir):
    found = find(documents(spark, sf_dir))

    def count(i: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == i)).cast("long").alias(f"n_{KINDS[i]}")

    return found.select(F.col("id").alias("doc_id"), *[count(i) for i in range(len(KINDS))], F.sha2(joined(F.col("base")).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
