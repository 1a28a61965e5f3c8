import random
import re
import time

import pytest

from marlstone.llm import licenses as L

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}


def base(text):
    w = WORD.findall((text or "").translate(LOWER))
    at = [(i, label) for p, label in PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    starts = [i for i, _ in at]
    return len(w), len(at), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in at}))


TEXTS = [
    None, "", " \n", "Released under the MIT License.", "UNDER-THE-MIT-LICENSE under the mit\nlicense", "xunder the mit license", "under the mit licenses", "éunder the mit license",
    "Apache License, Version 2.0 and Apache License Version 2", "cc by nc by nc cc-by-nc-sa", "cc by cc by nc", "K under the mit license", "under the mİt license", "under\x00the\x7fmit license",
]


def test_base_equals_brute_force():
    rng = random.Random(8)
    pool = "under the mit license apache version 2 0 cc by nc sa É 東".split()
    texts = TEXTS + [rng.choice([" ", "-", " \n"]).join(rng.choice(pool) for _ in range(rng.randrange(200))) for _ in range(300)]
    for t in texts:
        got = L.scan((t or "").encode())
        assert got[:5] == base(t), t
        assert set(filter(None, got[4].split(","))) <= set(got[5].split(","))
        assert 0 <= got[6] <= 1 and (got[6] > 0) == bool(got[5])


@pytest.mark.parametrize(
    "text, labels, score, freedom",
    [
        ("SPDX-License-Identifier: MIT", "mit", 1.0, 1.0),
        ("// spdx-license-identifier: (GPL-2.0-only OR MIT) AND Apache-2.0 */", "apache-2,gpl-2,mit", 1.0, 1.0),
        ("SPDX-License-Identifier: GPL-2.0+ WITH Classpath-exception-2.0", "gpl-2", 1.0, 0.6),
        ("SPDX-License-Identifier: GPL-2.0 WITH Odd-exception", "gpl-2", 1.0, 0.4),
        ("SPDX-License-Identifier: MIT OR GPL-3.0 AND CC-BY-NC-4.0", "cc-by-nc,gpl-3,mit", 1.0, 1.0),
        ("SPDX-License-Identifier: (MIT OR GPL-3.0) AND CC-BY-NC-4.0", "cc-by-nc,gpl-3,mit", 1.0, 0.2),
        ("SPDX-License-Identifier: LicenseRef-Own OR", "other", 1.0, 0.0),
        ("SPDX-License-Identifier: NONE", "", 1.0, 0.0),
        ("SPDX-License-Identifier:\nMIT", "", 0.0, None),
        ("license = 'MIT OR Apache-2.0'", "apache-2,mit", 1.0, 1.0),
        ('"License": "BSD-3-Clause",', "bsd-3-clause", 1.0, 1.0),
        ("License: see the file", "", 0.0, None),
        ("License: MIT and so on. License: ISC.", "isc,mit", 1.0, 1.0),
        ("sublicense: MIT", "", 0.0, None),
        ("licensed under the GNU General Public License, version 3.", "gpl-3", 0.9, 0.4),
        ("the GNU General Public License in general", "gpl", 0.5, 0.4),
        ("under CC BY-NC-SA 4.0", "cc-by-nc,cc-by-nc-sa", 0.9, 0.2),
        ("All rights reserved", "reserved", 0.5, 0.0),
        ("a licence to a clean document", "", 0.0, None),
    ],
)
def test_method(text, labels, score, freedom):
    assert L.scan(text.encode())[5:8] == (labels, score, freedom)


def recursive(tokens):
    """(value, rest) by descent: an expression of `or`, of `and`, of `with`."""

    def atom(t):
        if t[0] == "(":
            v, t = level(t[1:], 0)
            return v, t[1:]
        return L.identified(t[0])[1], t[1:]

    def level(t, k):
        if k == 2:
            v, t = atom(t)
            while t and t[0] == "with":
                v, t = (max(v, L.WEAK) if t[1] in L.EXCEPTIONS else v), t[2:]
            return v, t
        v, t = level(t, k + 1)
        while t and t[0] == ("or", "and")[k]:
            w, t = level(t[1:], k + 1)
            v = (max, min)[k](v, w)
        return v, t

    return level(tokens, 0)


def test_expressions_equal_recursive_descent():
    rng = random.Random(9)

    def make(depth):
        if depth == 0 or rng.random() < 0.3:
            t = [rng.choice(["mit", "gpl-3.0", "cc-by-nc-4.0", "lgpl-2.1-or-later", "agpl-3.0", "cc-by-sa-4.0"])]
            return t + rng.choice([[], [], ["with", "classpath-exception-2.0"], ["with", "odd"]])
        inner = make(depth - 1) + [rng.choice(["and", "or"])] + make(depth - 1)
        return ["(", *inner, ")"] if rng.random() < 0.5 else inner

    for _ in range(400):
        t = make(5)
        postfix, _ = L.parse(" ".join(t), 0, True)
        assert L.evaluate(postfix)[0] == recursive(t)[0]


def test_malformed_expressions_and_long_texts():
    for x, want in [("mit and (", ["mit"]), ("((", []), (") mit", []), ("mit or isc and", ["mit", "isc", "or"]), ("(mit", ["mit"]), ("and mit", []), ("mit with (isc)", ["mit"]), ("mit and ((isc) or (", ["mit", "isc", "and"])]:
        assert L.parse(x, 0, True)[0] == want
    began = time.time()
    deep = "SPDX-License-Identifier: " + "(" * 500000 + "MIT" + ")" * 500000 + "\n" + "license=mit and " * 60000 + "cc by nc " * 100000
    got = L.scan(deep.encode())
    assert got[:5] == base(deep) and got[5] == "cc-by-nc,mit" and time.time() - began < 20


def test_table(spark):
    rows = [(i, t, "x", i) for i, t in enumerate(TEXTS)] + [(None, TEXTS[3], "x", 0), (3, TEXTS[3], "x", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, labels string, n_words long")
    got = sorted(((r.doc_id, *r[1:6]) for r in L.find(df).collect()), key=str)
    assert got == sorted(((i, *base(t)) for i, t, _, _ in rows), key=str)
    assert L.find(df.limit(0)).count() == 0
