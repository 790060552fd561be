"""Very many subjects at once against one profile at a time."""

import random

import pytest
from pyspark.sql import functions as F

from veilframe import model
from veilframe.operators import detect, subjects
from veilframe.profile import Profile
from veilframe.sources import spans as sources

WORDS = "anna bob carl dora erik fay of the and paid by to".split()
SUBJECT = {f.name: f.dataType for f in model.SUBJECT}


def frame(spark, people):
    rows = [(k, Profile.model_validate({"subject": p}).model_dump()["subject"]) for k, p in people.items()]
    return spark.createDataFrame(rows, f"subject_id long, subject {model.SUBJECT.simpleString()}")


def one_by_one(spans, people):
    """Each subject as a profile of its own; names as phrases of words."""
    out = set()
    rows = [(r["doc_id"], r["ord"], r["text"]) for r in spans.collect()]
    for k, p in people.items():
        profile = Profile.model_validate({"subject": p})
        for hit in detect.detect_accounts(spans, profile.subject.account_numbers).unionByName(detect.detect_contacts(spans, profile)).collect():
            out.add((k, hit["doc_id"], hit["ord"], hit["entity_type"], hit["text"], round(hit["bbox"]["x0"], 3), round(hit["bbox"]["x1"], 3)))
        names = [" ".join(detect.re.findall(r"\w+", n.lower())) for n in [profile.subject.display_name, *profile.subject.aliases]]
        for doc, o, text in rows:
            words = detect.re.findall(r"\w+", text.lower())
            if any(len(w) >= 2 for w in words) and words[-1] not in detect.X.CORPORATE and any(f" {n} " in f" {' '.join(words)} " for n in names if any(len(w) >= 2 for w in n.split())):
                out.add((k, doc, o, "PERSON", text, 72.0, round(72 + 6.0 * len(text), 3)))
    return out


def told(found):
    return {(r["subject_id"], r["doc_id"], r["ord"], r["entity_type"], r["text"], round(r["bbox"]["x0"], 3), round(r["bbox"]["x1"], 3)) for r in found.collect()}


PEOPLE = {
    1: {"display_name": "Anna Bob", "aliases": ["fay"], "account_numbers": [{"value": "12345678", "preserve_last": 4}], "phones": ["+1 (222) 555-1234"], "emails": ["anna.b@mail.org"]},
    2: {"display_name": "Bob Carl", "aliases": ["Fay", "x"], "account_numbers": [{"value": "GB-77", "preserve_last": 0}, {"value": "1234", "preserve_last": 2}], "ssns": ["123-45-6789"]},
    3: {"display_name": "Dora of the Erik", "emails": ["a@b", "Q.Q@q.q"], "account_numbers": [{"value": "9"}, {"value": "zz"}]},
    4: {"display_name": "Nobody Here", "account_numbers": [{"value": "12345678", "preserve_last": 0}, {"value": "--"}], "phones": ["none"]},
}
LINES = [
    "Anna  Bob paid", "to anna, bob carl", "fay Inc", "FAY!", "anna bobby", "no 1234-56 78 or x12345678y", "gb 77 GB77 gb.7-7", "1.234 and 12345 678", "call 1 222.555 1234", "ssn 123456789", "dora of the erik", "dora of the, erik",
    "mail xanna.b@mail.orgs ANNA.B@MAIL.ORG", "a@bc q.q@Q.q", "zzz 9", "", "x",
]


@pytest.mark.parametrize("heavy", [None, 0])
def test_many_subjects_find_what_each_finds(spark, heavy):
    spans = sources.lines(spark.createDataFrame(list(enumerate(LINES)), "doc_id long, text string"), "doc_id", "text")
    assert told(subjects.find_terms(spans, subjects.dictionary(frame(spark, PEOPLE)), heavy=heavy)) == one_by_one(spans, PEOPLE)


def test_random_subjects(spark):
    r = random.Random(1)
    digits = lambda n: "".join(r.choice("012") for _ in range(n))
    people = {
        k: {"display_name": " ".join(r.sample(WORDS, r.randrange(1, 4))), "aliases": [r.choice(WORDS)], "account_numbers": [{"value": digits(r.choice((2, 4, 5, 8, 9))), "preserve_last": r.randrange(0, 3)}]}
        for k in range(40)
    }
    lines = [" ".join(r.choice((r.choice(WORDS), r.choice(WORDS).title() + ",", r.choice(("", "-", " ", ".")).join(digits(r.randrange(2, 10))))) for _ in range(r.randrange(1, 9))) for _ in range(60)]
    spans = sources.lines(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string"), "doc_id", "text")
    assert told(subjects.find_terms(spans, subjects.dictionary(frame(spark, people)))) == one_by_one(spans, people)


def test_no_terms(spark):
    spans = sources.lines(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), "doc_id", "text")
    none = frame(spark, {1: {"display_name": "x"}})
    found = subjects.find_terms(spans, subjects.dictionary(none))
    assert found.columns == [*detect.COLUMNS, "subject_id"] and found.count() == 0


def test_the_plan_joins_on_equal_keys(spark):
    spans = sources.lines(spark.createDataFrame(list(enumerate(LINES)), "doc_id long, text string"), "doc_id", "text")
    found = subjects.find_terms(spans, subjects.dictionary(frame(spark, PEOPLE)))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and "Python" not in plan


def test_a_shared_term_stands_once(spark):
    book = subjects.dictionary(frame(spark, PEOPLE))
    assert book.terms.where("norm = 'fay'").count() == 1 and book.owners.where("norm = 'fay'").count() == 2
    assert book.terms.where(F.col("norm") == "12345678").count() == 1


@pytest.mark.parametrize("heavy", [None, 0])
def test_classes_and_members_say_what_each_subject_finds(spark, heavy):
    spans = sources.lines(spark.createDataFrame(list(enumerate(LINES)), "doc_id long, text string"), "doc_id", "text")
    book = subjects.dictionary(frame(spark, PEOPLE))
    hits, who = subjects.find_classes(spans, book, heavy=heavy), subjects.members(book)
    assert told(hits.drop("representative", "subjects").join(who, ["entity_type", "term", "preserve_last"])) == one_by_one(spans, PEOPLE)
    fay = hits.where("term = 'fay'").collect()
    assert [(r["doc_id"], r["representative"], r["subjects"]) for r in fay] == [(3, 1, 2)]
    assert {(r["term"], r["subject_id"]) for r in who.where("subjects > 1").collect()} == {("fay", 1), ("fay", 2)}


def test_a_term_that_all_share_is_not_multiplied_out(spark):
    spans = sources.lines(spark.range(50).selectExpr("id", "'paid by fay' as text"), "id", "text")
    book = subjects.dictionary(frame(spark, {i: {"display_name": "fay"} for i in range(40)}))
    assert subjects.find_classes(spans, book).count() == 50 and subjects.members(book).count() == 40 and subjects.find_terms(spans, book).count() == 2000


def test_no_terms_no_classes(spark):
    spans = sources.lines(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), "doc_id", "text")
    book = subjects.dictionary(frame(spark, {1: {"display_name": "x"}}))
    assert subjects.find_classes(spans, book).count() == subjects.members(book).count() == 0
