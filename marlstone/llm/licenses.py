"""Licence scan: an Aho-Corasick automaton finds identifier tags and notice phrases, a shunting-yard parser evaluates expressions.

Two automata run over each whole text. One goes over its words (lower case, anything else one space) and knows the notice
phrases; places that stand inside a longer phrase's place count for the base only. The other goes over the lower-cased text
and knows the names of tags, as `SPDX-License-Identifier:` or `license =`; from there the parser reads identifiers, `and`,
`or`, `with` and brackets up to the first token that can't go on, on that line. `with` binds closest, then `and`, then `or`.
An operator without a right side is dropped, an open bracket closes at the end. Each identifier has a freedom from 0 (none)
to 1 (permissive): `or` takes the greater, `and` the less, `with` a known linking exception lifts to that of weak copyleft.

Columns: `n_words`; the base phrases' `n_base`, `first_word`, `last_word`, `base_labels`; `labels` of everything found;
`score`, the strongest evidence (tag 1, notice 0.9, named licence 0.5, none 0); `freedom`, the least over expressions and
notices (null without any; a notice of a licence that an expression names counts there alone); `expressions`, the distinct ones in order of their text, joined by "; ".

An identifier that isn't known counts as `other` with freedom 0 after a licence-identifier tag, and isn't read after the
plain word `license`. NONE and NOASSERTION give no label and freedom 0. Null and empty texts have no words, labels or score. Repeated
rows are scanned each by itself, an empty table gives an empty one, other columns aren't read. Time and memory are linear in
a text's length, however deep its brackets.
"""

from __future__ import annotations

import re
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import as_bytes, batches, documents

#: The phrases of the contract and their labels. Fixed values.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: Families of public licence identifiers and how freely they let a work be used.
FAMILIES = {
    "mit": 1.0, "mit-0": 1.0, "isc": 1.0, "0bsd": 1.0, "bsd-2-clause": 1.0, "bsd-3-clause": 1.0, "apache": 1.0, "zlib": 1.0, "unlicense": 1.0, "cc0": 1.0,
    "wtfpl": 1.0, "postgresql": 1.0, "python": 1.0, "psf": 1.0, "bsl": 1.0, "ofl": 0.8, "artistic": 0.8, "cc-by": 0.9, "cc-by-sa": 0.6, "mpl": 0.6, "epl": 0.6, "eupl": 0.5,
    "lgpl": 0.6, "gpl": 0.4, "agpl": 0.3, "cc-by-nd": 0.2, "cc-by-nc": 0.2, "cc-by-nc-sa": 0.2, "cc-by-nc-nd": 0.1, "reserved": 0.0,
}
WEAK = 0.6
EXCEPTIONS = {"classpath-exception-2.0", "gcc-exception-2.0", "gcc-exception-3.1", "llvm-exception", "bison-exception-2.2", "font-exception-2.0", "autoconf-exception-3.0", "linux-syscall-note", "openvpn-openssl-exception", "qt-gpl-exception-1.0", "universal-foss-exception-1.0"}

NOTICE, NAMED = 0.9, 0.5
#: Phrases of notices: label and evidence. The base phrases are notices too.
PHRASES = {
    "permission is hereby granted free of charge to any person obtaining a copy": ("mit", NOTICE),
    "mit license": ("mit", NAMED),
    "apache license 2 0": ("apache-2", NOTICE),
    "apache 2 0 license": ("apache-2", NOTICE),
    "apache license version 2 0": ("apache-2", NOTICE),
    "gnu general public license": ("gpl", NAMED),
    "gnu general public license version 2": ("gpl-2", NOTICE),
    "gnu general public license v2": ("gpl-2", NOTICE),
    "gnu general public license version 3": ("gpl-3", NOTICE),
    "gnu general public license v3": ("gpl-3", NOTICE),
    "gnu gpl version 2": ("gpl-2", NOTICE),
    "gnu gpl version 3": ("gpl-3", NOTICE),
    "gnu gpl v2": ("gpl-2", NOTICE),
    "gnu gpl v3": ("gpl-3", NOTICE),
    "gnu lesser general public license": ("lgpl", NAMED),
    "gnu lesser general public license version 2 1": ("lgpl-2.1", NOTICE),
    "gnu lesser general public license version 3": ("lgpl-3", NOTICE),
    "gnu affero general public license": ("agpl", NAMED),
    "gnu affero general public license version 3": ("agpl-3", NOTICE),
    "mozilla public license": ("mpl", NAMED),
    "mozilla public license version 2 0": ("mpl-2", NOTICE),
    "mozilla public license v 2 0": ("mpl-2", NOTICE),
    "mozilla public license 2 0": ("mpl-2", NOTICE),
    "eclipse public license": ("epl", NAMED),
    "eclipse public license v2 0": ("epl-2", NOTICE),
    "bsd 2 clause license": ("bsd-2-clause", NOTICE),
    "bsd 3 clause license": ("bsd-3-clause", NOTICE),
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": ("isc", NOTICE),
    "isc license": ("isc", NAMED),
    "this is free and unencumbered software released into the public domain": ("unlicense", NOTICE),
    "creative commons attribution 4 0": ("cc-by", NOTICE),
    "creative commons attribution sharealike": ("cc-by-sa", NOTICE),
    "creative commons attribution noncommercial": ("cc-by-nc", NOTICE),
    "creative commons attribution non commercial": ("cc-by-nc", NOTICE),
    "creative commons attribution noncommercial sharealike": ("cc-by-nc-sa", NOTICE),
    "creative commons attribution noncommercial noderivatives": ("cc-by-nc-nd", NOTICE),
    "creative commons attribution noderivatives": ("cc-by-nd", NOTICE),
    "cc by 4 0": ("cc-by", NOTICE),
    "cc by 3 0": ("cc-by", NOTICE),
    "cc by sa": ("cc-by-sa", NOTICE),
    "cc by nd": ("cc-by-nd", NOTICE),
    "cc by nc sa": ("cc-by-nc-sa", NOTICE),
    "cc by nc nd": ("cc-by-nc-nd", NOTICE),
    "cc0 1 0": ("cc0", NOTICE),
    "all rights reserved": ("reserved", NAMED),
}

#: Names of tags; the strict ones take any identifier.
STRICT = ("spdx-license-identifier", "license-expression")
LOOSE = ("license", "licence")
#: A-Z in lower case, all else as it is; and for words, ASCII other than digits and letters as a space.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
CLEAN = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in LOWER)
SPACES = re.compile(b" +")
GIVES = re.compile(r"[\"']?[ \t]*[:=][ \t]*[\"']?")
TOKEN = re.compile(r"[ \t]*([()]|[a-z0-9][a-z0-9.+-]*)")
RANK = {"or": 1, "and": 2, "with": 3}
VERSION = re.compile(r"(.+?)-(\d+(?:\.\d+)*)$")
NOTHING = ("none", "noassertion")


@lru_cache(maxsize=4096)
def identified(name: str) -> tuple[str, float] | None:
    """(label, freedom) of a licence identifier in lower case; None where it isn't known."""
    name = name.rstrip("+").removesuffix("-only").removesuffix("-or-later")
    if name in FAMILIES:
        return name, FAMILIES[name]
    m = VERSION.match(name)
    if m is None or m[1] not in FAMILIES:
        return None
    family, version = m[1], m[2].removesuffix(".0")
    return (family if family.startswith(("cc", "bsd", "mit")) else f"{family}-{version}"), FAMILIES[family]


def parse(text: str, at: int, strict: bool) -> tuple[list[str], int]:
    """The expression that starts at `at`, in postfix order, and where it ends; empty where none starts there."""
    out: list[str] = []
    held: list[str] = []
    want, deep, after_with = True, 0, False
    while (m := TOKEN.match(text, at)) is not None:
        t = m[1] if m[1] in "()" else m[1].rstrip(".-")
        if want:
            if t == "(" and not after_with:
                held.append(t)
                deep += 1
            elif t in RANK or t in ("(", ")") or not (strict or after_with or t in NOTHING or identified(t)):
                break
            else:
                out.append(t)
                want = after_with = False
        elif t in RANK:
            while held and held[-1] != "(" and RANK[held[-1]] >= RANK[t]:
                out.append(held.pop())
            held.append(t)
            want, after_with = True, t == "with"
        elif t == ")" and deep:
            while held[-1] != "(":
                out.append(held.pop())
            held.pop()
            deep -= 1
        else:
            break
        at = m.end()
        if m[1] != t:  # a full stop ends a sentence
            break
    while want and held and held.pop() == "(":
        pass
    return out + [t for t in reversed(held) if t != "("], at


def evaluate(postfix: list[str]) -> tuple[float, set[str], str]:
    """(freedom, labels, the expression written out) of an expression in postfix order."""
    stack: list[tuple[float, bool]] = []
    labels: set[str] = set()
    for t in postfix:
        if t in RANK:
            right, left = stack.pop(), stack.pop()
            if t == "with":
                stack.append((max(left[0], WEAK) if right[1] else left[0], False))
            else:
                stack.append(((max if t == "or" else min)(left[0], right[0]), False))
        else:
            known = identified(t)
            stack.append((known[1] if known else 0.0, t in EXCEPTIONS))
    exception = _exceptions(postfix)
    for i, t in enumerate(postfix):
        if t not in RANK and t not in NOTHING and i not in exception:
            labels.add(identified(t)[0] if identified(t) else "other")
    return stack[0][0], labels, " ".join(postfix)


def _exceptions(postfix: list[str]) -> set[int]:
    """Places of the names that follow `with`: an exception is a single name, so it stands right before its operator."""
    return {i - 1 for i, t in enumerate(postfix) if t == "with"}


def _automaton(words) -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for w, value in words:
        a.add_word(w, value)
    a.make_automaton()
    return a


@lru_cache(maxsize=1)
def automata() -> tuple[ahocorasick.Automaton, ahocorasick.Automaton]:
    """Of the phrases, each with a space before and behind it, and of the tags' names."""
    phrases = [(p, label, NOTICE, p in BASE) for p, label in BASE.items()] + [(p, *v, False) for p, v in PHRASES.items() if p not in BASE]
    return _automaton((f" {p} ", (p.count(" ") + 1, label, weight, base)) for p, label, weight, base in phrases), _automaton((t, (len(t), t in STRICT)) for t in STRICT + LOOSE)


def phrases(words: str) -> tuple[list[tuple[int, str]], list[tuple[str, float]]]:
    """(start, label) of every base phrase, and (label, evidence) of the phrases that no longer one covers; words: single spaces, also around."""
    base, places = [], []
    seen = at = 0
    for end, (n, label, weight, is_base) in automata()[0].iter(words):
        seen += words.count(" ", at, end)
        at = end
        start = seen - n
        if is_base:
            base.append((start, label))
        places.append((start, -seen, label, weight))
    free, reach = [], -1
    for start, stop, label, weight in sorted(places):
        if -stop > reach:
            free.append((label, weight))
            reach = -stop
    return base, free


def tags(low: str) -> list[list[str]]:
    """The postfix expressions behind tags, for text in lower case."""
    out, done = [], 0
    if "licen" not in low:
        return out
    for end, (n, strict) in automata()[1].iter(low):
        start = end - n + 1
        if start < done or (start and (low[start - 1].isalnum() or low[start - 1] in "-_")):
            continue
        gives = GIVES.match(low, end + 1)
        if gives:
            found, stop = parse(low, gives.end(), strict)
            if found:
                out.append(found)
                done = stop
    return out


def scan(text: bytes) -> tuple:
    """The columns after the id, for a text in UTF-8."""
    words = SPACES.sub(b" ", text.translate(CLEAN)).strip(b" ")
    n_words = words.count(b" ") + 1 if words else 0
    base, free = phrases(f" {words.decode()} ") if words else ([], [])
    labels, freedom, written = set(), [], set()
    for postfix in tags(text.translate(LOWER).decode()):
        free_as, named, form = evaluate(postfix)
        labels |= named
        freedom.append(free_as)
        written.add(form)
    score = 1.0 if written else max((weight for _, weight in free), default=0.0)
    freedom += [identified(label)[1] for label, _ in free if label not in labels]
    labels |= {label for label, _ in free} | {label for _, label in base}
    at = [x for x, _ in base]
    return n_words, len(base), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in base})), ",".join(sorted(labels)), score, min(freedom, default=None), "; ".join(sorted(written))


COLUMNS = {"n_words": "long", "n_base": "long", "first_word": "long", "last_word": "long", "base_labels": "string", "labels": "string", "score": "double", "freedom": "double", "expressions": "string"}
_ARROW = {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}


def find(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, the columns above) of every row."""
    id_type = df.schema[id_col].dataType.simpleString()

    def run(frames):
        for b in batches(frames, 1024):
            rows = [scan(t) for t in as_bytes(b.column(1))]
            cols = zip(*rows, strict=True) if rows else [[] for _ in COLUMNS]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, _ARROW[t]) for c, t in zip(cols, COLUMNS.values(), strict=True))], names=["doc_id", *COLUMNS])

    return df.select(F.col(id_col), F.col(text_col)).mapInArrow(run, ", ".join([f"doc_id {id_type}", *(f"{c} {t}" for c, t in COLUMNS.items())]))


def op13_licenses(spark, sf_dir):
    return find(documents(spark, sf_dir))
