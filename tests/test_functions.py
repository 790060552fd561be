import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veilframe.functions import address as A
from veilframe.functions import fuzzy
from veilframe.functions import text as X


def one(spark, expression, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(expression.alias("x")).first()["x"]


def naive_lcs(a, b):
    row = [0] * (len(b) + 1)
    for c in a:
        new = [0]
        for j, d in enumerate(b):
            new.append(max(row[j + 1], new[-1], row[j] + (c == d)))
        row = new
    return row[-1]


SHORT = st.text("abc d", max_size=12)


@given(SHORT, SHORT)
def test_lcs_is_the_table_of_lengths(a, b):
    assert fuzzy.lcs(a, b) == naive_lcs(a, b) == fuzzy.lcs(b, a)


def test_known_scores():
    assert round(fuzzy.partial_ratio("jane corpus", "email: jane.corpus@example.com"), 3) == 90.909
    assert fuzzy.partial_ratio("jane c", "jane corpus") == 100
    assert fuzzy.token_set_ratio("smith jane", "jane q smith") == 100
    assert fuzzy.token_set_ratio("", "a") == 0


@settings(max_examples=300, deadline=None)
@given(st.text("abcd ", min_size=4, max_size=9), st.text("abcd ", min_size=10, max_size=40), st.sampled_from([0.7, 0.85, 0.95]))
def test_scan_loses_no_hit(term, text, threshold):
    exact = fuzzy.partial_ratio(term, text)
    found = fuzzy.Needle(term, threshold).partial(text)
    assert found <= exact + 1e-9
    if exact >= 100 * threshold:
        assert found == pytest.approx(exact)


@settings(max_examples=300, deadline=None)
@given(st.text("ab ", min_size=1, max_size=9), st.text("abc ", max_size=20), st.sampled_from([0.6, 0.85, 1.0]))
def test_same_words_is_the_token_set_ratio(term, text, threshold):
    score = fuzzy.token_set_ratio(term, text)
    if abs(score - 100 * threshold) > 1e-6:
        assert fuzzy.Needle(term, threshold).same_words(text) == (score >= 100 * threshold)


def test_condition_before_scoring_is_lossless(spark):
    r = random.Random(3)
    terms, texts = ["jane corpus", "o neil"], []
    for _ in range(400):
        t = list(r.choice(terms))
        for _ in range(r.randrange(3)):
            t[r.randrange(len(t))] = r.choice("abc ")
        texts.append("".join(r.choice("xyz jan") for _ in range(r.randrange(20))) + "".join(t) + "".join(r.choice("xyz co") for _ in range(r.randrange(20))))
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    rows = df.select("text", fuzzy.may_fit(F.col("text"), terms, 0.85).alias("may"), fuzzy.fuzzy_hit(F.col("text"), terms, 0.85).alias("hit")).collect()
    naive = lambda t: any(max(fuzzy.partial_ratio(x, t), fuzzy.token_set_ratio(x, t)) >= 85 for x in terms)
    assert all(r["may"] or not r["hit"] for r in rows)
    assert [r["hit"] for r in rows] == [naive(r["text"]) for r in rows]
    assert any(r["hit"] for r in rows) and not all(r["may"] for r in rows)


@pytest.mark.parametrize(
    ("value", "keep", "shown"),
    [("1111-2222-3333-4444", 4, "XXXX-XXXX-XXXX-4444"), ("1234567812345678", 4, "XXXXXXXXXXXX5678"), ("12 34", 0, "XX XX"), ("123", 9, "123"), ("", 4, "")],
)
def test_mask_account(spark, value, keep, shown):
    assert one(spark, X.mask_account(F.col("v"), keep), v=value) == shown


@pytest.mark.parametrize(("match", "keep", "hidden"), [("1234567812345678", 4, 12), ("9834-12", 4, 2), ("12", 4, None), ("0021305789Q834", 4, 9), ("1234", 0, None)])
def test_hidden_length(spark, match, keep, hidden):
    assert one(spark, X.hidden_length(F.col("m"), keep), m=match) == hidden


def test_account_matches(spark):
    found = one(spark, X.account_matches(F.col("t"), "12-34 A"), t="x 1234a, 1.2 3-4A y")
    assert [(m["start"], m["match"]) for m in found] == [(2, "1234a"), (9, "1.2 3-4A")]
    assert one(spark, X.account_matches(F.col("t"), "--"), t="x") == []


def test_word_match_needs_edges(spark):
    for text, hit in (("Ann went", True), ("Anna", False), ("(ANN)", True), ("éann", False), ("ann_", False)):
        assert one(spark, X.has_word(F.col("t"), "ann"), t=text) is hit


def test_corporate(spark):
    assert one(spark, X.is_corporate(F.col("t")), t="Jane Smith LLC.") is True
    assert one(spark, X.is_corporate(F.col("t")), t="LLC of Jane") is False
    assert one(spark, X.is_corporate(F.col("t")), t="...") is False


def test_error_classes(spark):
    cases = [("no_text", "x", "OCR_REQUIRED"), ("extraction", "is Encrypted", "ENCRYPTED"), ("extraction", "Permission denied", "PERMISSION"), ("extraction", None, "CORRUPT"), ("zero", "x", "UNKNOWN")]
    df = spark.createDataFrame([c[:2] for c in cases], "k string, m string")
    assert [r[0] for r in df.select(X.error_class(F.col("k"), F.col("m"))[0]).collect()] == [c[2] for c in cases]


LINES = [
    ("123 Main Street, Springfield, IL 62701", True, True),
    ("Address: 42 Oak Ave.", True, False),
    ("12 N Mill Rd Apt 4", True, False),
    ("1,234.56", False, False),
    ("62701", False, True),
    ("Springfield, IL 62701", False, True),
    ("Suite 400", False, True),
    ("Invoice: 12345 IL", False, False),
    ("#62701", False, False),
    ("", False, True),
]


@pytest.mark.parametrize(("text", "candidate", "continuation"), LINES)
def test_address_predicates(spark, text, candidate, continuation):
    assert one(spark, A.is_candidate(F.col("t")), t=text) is candidate
    assert one(spark, A.is_continuation(F.col("t")), t=text) is continuation


def test_prose(spark):
    for text, prose in (("this line has just about eight plain words", True), ("a b c d e f g 62701 now", False), ("one two three four five six CA seven", False), ("short line", False)):
        assert one(spark, A.is_prose(F.col("t")), t=text) is prose


def test_normalize(spark):
    text = "12 Main St., Springfield, IL 62701-1234"
    assert one(spark, A.normalize(F.col("t")), t=text) == "12 main street springfield il 62701"


def test_indel_column(spark):
    for a, b in (("abc", "abd"), ("", "a"), ("", ""), ("kitten", "sitting")):
        assert one(spark, fuzzy.indel(F.col("a"), F.col("b")), a=a, b=b) == pytest.approx(fuzzy.ratio(a, b))
