"""The join of fuzzy names against all pairs scored."""

import random

import pytest

from veilframe.functions import fuzzy
from veilframe.operators import similar

WORDS = "red blue small large widget bolt gear anna maria".split()


def names(r, n):
    out = set()
    for _ in range(n):
        x = " ".join(r.choice(WORDS) for _ in range(r.randrange(1, 4)))
        for _ in range(r.randrange(0, 3)):
            i = r.randrange(len(x) or 1)
            x = x[:i] + r.choice(("", x[i : i + 1] * 2, r.choice("xyz"))) + x[i + 1 :]
        out.add(x)
    return sorted(x for x in out if x.strip())


def frame(spark, texts):
    return spark.createDataFrame([(t, "x") for t in texts], "text string, key string")


def all_pairs(terms, texts, t):
    fits = lambda a, b: len(b.strip()) >= max(len(a) / 2, 3) and max(fuzzy.token_set_ratio(a, b), fuzzy.partial_ratio(a, b)) >= 100 * t
    return {(a, b) for a in terms for b in texts if fits(a, b)}


@pytest.mark.parametrize(("seed", "threshold", "heavy"), [(1, 0.85, None), (2, 0.6, None), (3, 0.95, 0), (4, 1.0, None)])
def test_no_pair_is_lost(spark, seed, threshold, heavy):
    r = random.Random(seed)
    terms, texts = names(r, 60), [*names(r, 80), "x y " * 20 + "red widgt " + "z " * 9, "é ü", "aaa aaa aaa"]
    found = similar.similar(frame(spark, terms), frame(spark, texts), threshold, heavy=heavy).collect()
    assert {(x["term"], x["text"]) for x in found} == all_pairs(terms, texts, threshold)
    assert len(found) == len({(x["term"], x["text"]) for x in found})
    for x in found:
        assert x["token_set"] == pytest.approx(fuzzy.token_set_ratio(x["term"], x["text"])) and x["partial"] == pytest.approx(fuzzy.partial_ratio(x["term"], x["text"]))


def test_few_pairs_are_scored(spark):
    r = random.Random(9)
    letters = "abcdefghijklmnopqrstuvwxyz"
    own = ["".join(r.choice(letters) for _ in range(7)) + " " + "".join(r.choice(letters) for _ in range(8)) for _ in range(120)]
    bent = [x[:3] + x[4:] for x in own]
    pairs = similar.candidates(frame(spark, bent).select("text"), frame(spark, own).select("text"), 0.85)
    assert 120 <= pairs.count() < 0.03 * 120 * 120


def test_odd_strings(spark):
    found = similar.similar(frame(spark, [None, "", " ", "Ab Cd", "ab cd", "x"]), frame(spark, [None, "", "  ", "AB CD", "ab  cd", "cd ab", "x"]), 0.85).collect()
    assert {(x["term"], x["text"]) for x in found} == {("ab cd", "ab cd"), ("ab cd", "ab  cd"), ("ab cd", "cd ab")}
    assert similar.similar(frame(spark, []), frame(spark, ["a b c"])).count() == 0
    with pytest.raises(ValueError):
        similar.similar(frame(spark, []), frame(spark, []), 0)


def test_the_plan_joins_on_equal_keys(spark):
    plan = similar.similar(frame(spark, ["ab cd"]), frame(spark, ["ab cd"]))._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
