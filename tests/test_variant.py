"""Strict reading of JSON against Python's parser, and what pages let one do."""

import json
import random

import pytest
from pyspark.sql import functions as F

from marlstone.functions import variant as V
from marlstone.operators import steps
from marlstone.operators.enrich import page_actions

SHAPE = {"action": "string", "n": "long", "x": "double", "ok": "boolean", "list": [{"url": "string", "tags": ["string"]}], "sub": {"a": {"b": "string"}}}


def fits(v, shape):
    if v is None:
        return True
    if isinstance(shape, str):
        kinds = {"string": str, "long": int, "double": (int, float), "boolean": bool}[shape]
        return isinstance(v, kinds) and (shape == "boolean" or not isinstance(v, bool))
    if isinstance(shape, list):
        return isinstance(v, list) and all(fits(x, shape[0]) for x in v)
    low = {k.lower(): s for k, s in shape.items()}
    return isinstance(v, dict) and all(k.lower() in low and fits(x, low[k.lower()]) for k, x in v.items())


def test_conforms_equals_a_plain_check(spark):
    rng = random.Random(3)

    def some(depth):
        kind = rng.randrange(8 if depth else 5)
        if kind < 5:
            return [None, "t", 5, 2.5, True][kind]
        if kind == 5:
            return [some(depth - 1) for _ in range(rng.randrange(3))]
        return {rng.choice(["action", "N", "x", "OK", "list", "sub", "a", "b", "url", "tags", "more"]): some(depth - 1) for _ in range(rng.randrange(3))}

    texts = [json.dumps({rng.choice(list(SHAPE)): some(3) for _ in range(rng.randrange(4))}) for _ in range(1500)] + ["[]", "null", "5", '"x"', "{", "{}x", "", "{},{}", "{} {}", '{}] {}', '{},"5"] {}', " {} "]
    df = spark.createDataFrame([(t,) for t in texts] + [(None,)], "t string")
    got = {r.t: r.ok for r in df.select("t", V.strict(F.col("t"), SHAPE).isNotNull().alias("ok")).collect()}

    def want(t):
        try:
            v = json.loads(t)
        except (TypeError, ValueError):
            return False
        return isinstance(v, dict) and fits(v, SHAPE)

    assert got == {t: want(t) for t in [*texts, None]} and 30 < sum(got.values()) < len(got) - 30


@pytest.mark.parametrize(
    "answer, kind",
    [
        ('{"action":"search","query":"x","extra":1}', None),
        ('{"action":"open","url":5}', None),
        ('{"action":"accept","selections":[{"url":"a","more":1}]}', None),
        ('{"action":"accept","selections":[{"url":["a"]}]}', None),
        ('{"action":["done"]}', None),
        ('{"action":"done","query":null}', "done"),
        ('{"ACTION":"done"}', "done"),
        ('first {"action":"search"} then {"action":"open","url":" u "}', "open"),
    ],
)
def test_actions_are_strict(spark, answer, kind):
    got = steps.actions(spark.createDataFrame([(answer,)], "a string"), "a").first()
    assert got.kind == kind and (kind != "open" or got.url == "u")


def test_actions_of_anchors(spark):
    pages = [
        (1, "https://a.org/x/", '<a rel="noopener" href="/register"><img></a><a href="booth"> b </a>'),
        (2, "https://a.org/", '<link rel="next" href="/register"><a href="javascript:x()">등록하기</a><a href=" ">register</a><a name="register">register</a>'),
        (3, None, None),
        (4, "https://a.org/", '<a href="/one">Sponsor</a><a href="/two">ticket</a><a href="/three">ticket</a> 무료 Registration deadline: 2026-05-01'),
    ]
    got = {r.id: r for r in page_actions(spark.createDataFrame(pages, "id int, url string, html string"), "id").collect()}
    assert (got[1].can_register, got[1].register_url, got[1].exhibit_url) == (True, "https://a.org/register", "https://a.org/x/booth")
    assert got[2].can_register is None and got[3].can_register is None and got[3].cost_hint is None
    assert (got[4].can_sponsor, got[4].register_url, got[4].cost_hint, got[4].registration_deadline) == (True, "https://a.org/two", "free", "2026-05-01")
