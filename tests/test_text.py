"""Text columns against CPython's own behaviour."""

import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from threadmill.functions import text as t

SPACES = "".join(chr(c) for c in range(0x110000) if chr(c).isspace())


def evaluate(spark, texts, **columns):
    frame = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i long, x string")
    return [r.asDict() for r in frame.select("i", *(c.alias(n) for n, c in columns.items())).orderBy("i").collect()]


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(alphabet=st.sampled_from(SPACES + "ab?é,\n"), max_size=40), min_size=30, max_size=60))
def test_words_and_strip_as_in_python(spark, texts):
    got = evaluate(spark, texts, n=t.word_count("x"), s=t.strip("x"), l=t.strip_length("x"), b=t.is_blank("x"), q=t.squeeze("x"), h=t.has_needle("x", "?"))
    for x, r in zip(texts, got, strict=True):
        assert (r["n"], r["s"], r["l"], r["b"], r["q"], r["h"]) == (len(x.split()), x.strip(), len(x.strip()), not x.strip(), " ".join(x.split()), "?" in x)


def test_every_space_counts(spark):
    texts = [f"a{c}b" for c in SPACES] + [f"{c}{c}" for c in SPACES]
    got = evaluate(spark, texts, n=t.word_count("x"))
    assert [r["n"] for r in got] == [2] * len(SPACES) + [0] * len(SPACES)


def test_null_is_empty(spark):
    r = evaluate(spark, [None], n=t.word_count("x"), l=t.strip_length("x"), b=t.is_blank("x"), h=t.has_needle("x"), f=t.is_filled("x"), d=t.falsy_to("x", "none"), m=t.matches("x", "a"))[0]
    assert (r["n"], r["l"], r["b"], r["h"], r["f"], r["d"], r["m"]) == (0, 0, True, False, False, "none", False)


@pytest.mark.parametrize("text,found", [("I am ILL today", True), ("illness", True), ("ſick", True), ("éill", False), ("ill_x", False), ("well-known", True), ("swell", False), ("", False)])
def test_terms_are_words(spark, text, found):
    from threadmill.operators.threads import TERMS_3, matches_terms

    assert spark.createDataFrame([(text,)], "x string").select(matches_terms(TERMS_3, "x").alias("m")).first()["m"] is found


def test_preview_cuts_after_300(spark):
    got = evaluate(spark, ["a" * 300, "a" * 301, "a  b\n"], p=t.preview("x"))
    assert [r["p"] for r in got] == ["a" * 300, "a" * 300 + "...", "a b"]


def test_answers_of_both_shapes(spark):
    texts = ['{"comments":[{"body":"x","author_type":"c"}]}', '[{"body":"y"}]', "3", "no json"]
    got = [r["p"] for r in evaluate(spark, texts, p=t.parse_replies("x"))]
    assert [c["body"] for c in got[0]] == ["x"] and [c["body"] for c in got[1]] == ["y"] and not got[2] and not got[3]


def test_part_after_does_not_fail(spark):
    got = evaluate(spark, ["t3_abc", "abc", None, "t3_a_b"], p=t.part_after("x", "_"))
    assert [r["p"] for r in got] == ["abc", None, None, "a"]


def test_random_texts_have_python_length(spark):
    rng = random.Random(1)
    texts = ["".join(chr(rng.choice([0x41, 0xE9, 0x1F600, 0x20])) for _ in range(30)) for _ in range(50)]
    assert [r["l"] for r in evaluate(spark, texts, l=t.strip_length("x"))] == [len(x.strip()) for x in texts]


def test_one_pass_filling():
    from threadmill.operators.generation import _fill

    assert _fill("{title}: {body} {n} {x}", {"title": "{body} {n}", "body": "b", "n": 3}) == "{body} {n}: b 3 {x}"
