"""The tagger against labelled lines that it has not seen, beside the two patterns."""

import itertools
import random

import numpy as np
import pytest

from veilframe.operators import detect, tagger
from veilframe.plans.engine import Engine
from veilframe.profile import Profile
from veilframe.sources import spans as sources

LEARN = [
    "Met {P} at {L}, today", "{P} lives in {L}.", "invoice for {P}", "Please call {P} or Mr. {P} before noon", "sent to {L} on Monday", "Order of {P}, shipped to {L}", "Total due on Friday", "The Annual Report of the year", "Dear {P},",
    "Last week {P} wrote to us", "Returned by Mrs. {P} from {L}", "Today {P} paid the bill", "They asked {P} about it", "Delivered to {P}, {L}.", "Thanks to {P}", "Read Section 4 of the Manual", "Paid in January", "Our Terms and Conditions apply", "Contract with {P}", "He went to {L} and back",
]
HELD = ["Yesterday {P} moved to {L}.", "Invoice for Dr. {P}, {L}", "We thank {P} for the order", "Shipped to {L} by {P}", "See Chapter 7 of the Report", "Total for March"]


def labelled(templates, words, streets, n, seed):
    r = random.Random(seed)
    out = []
    for _ in range(n):
        text, entities = "", []
        for part in itertools.chain.from_iterable((p, "}") if i else (p,) for i, p in enumerate(r.choice(templates).split("{"))):
            if part == "}":
                continue
            if part[:2] in ("P}", "L}"):
                value = " ".join(r.sample(words, r.choice((1, 2, 2, 3)))) if part[0] == "P" else f"{r.randrange(1, 999)} {r.choice(words)} {r.choice(streets)}"
                entities.append(("PERSON" if part[0] == "P" else "LOCATION", len(text), len(value)))
                text += value + part[2:]
            else:
                text += part
        out.append((text, entities))
    return out


@pytest.fixture(scope="module")
def lines(spark):
    """Names are words of the documents, those for training and those held out apart."""
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("lang = 'en'").select("text").collect()
    words = sorted({w.title() for r in rows for w in r["text"].split() if w.isalpha() and 4 <= len(w) <= 9})
    streets = ["Street", "St", "Road", "Lane", "Avenue", "Plaza"]
    plain = [(line.strip(), []) for r in rows[::2] for line in r["text"].split("\n") if 10 < len(line) < 200][:300]
    return labelled(LEARN, words[::2], streets, 1_500, 1) + plain, labelled(HELD, words[1::2], streets, 400, 2)


def quality(found, lines):
    want = {(i, e, t[s : s + n]) for i, (t, entities) in enumerate(lines) for e, s, n in entities}
    hits = len(found & want)
    return hits / max(1, len(found)), hits / len(want)


def test_held_out_lines(spark, lines):
    learn, held = lines
    frame = spark.createDataFrame([(t, e) for t, e in learn], "text string, entities array<struct<entity:string,start:int,length:int>>")
    model = tagger.fit(frame)
    spans = sources.lines(spark.createDataFrame([(i, t) for i, (t, _) in enumerate(held)], "doc_id long, text string"), "doc_id", "text")
    told = lambda m: {(r["doc_id"], r["entity_type"], r["text"]) for r in detect.detect_entities(spans, ["PERSON", "LOCATION"], tagger=m).collect()}
    precision, recall = quality(told(model), held)
    rule_precision, rule_recall = quality(told(None), held)
    print(f"tagger {precision:.3f} {recall:.3f}, patterns {rule_precision:.3f} {rule_recall:.3f}")
    # Lines of forms that it has not seen, with invented names: unknown capitalised words, months too, look like names.
    assert precision > rule_precision and recall > 0.7 and recall > rule_recall + 0.3
    one = detect.detect_entities(spans, ["PERSON"], tagger=model)
    assert {r["entity_type"] for r in one.collect()} == {"PERSON"}
    assert all(r["text"] == held[r["doc_id"]][0][r["start"] : r["start"] + r["size"]] for r in one.collect())


def test_a_run_with_a_tagger(spark, lines):
    model = tagger.train(lines[0][:600])
    profile = Profile.model_validate({"subject": {"display_name": " x"}, "detection": {"full_token_min_length": 9, "use_presidio": True, "presidio_entities": ["PERSON"]}})
    name = next(t[s : s + n] for t, e in lines[0] for k, s, n in e if k == "PERSON" and t.startswith("Dear"))
    run = Engine(profile, granularity="match", tagger=model).run(sources.lines(spark.createDataFrame([(1, f"Dear {name},\nTotal due on Friday")], "doc_id long, text string"), "doc_id", "text"))
    assert [r["text"] for r in run.spans.orderBy("ord").collect()] == [f"Dear {'█' * len(name)},", "Total due on Friday"]


def test_viterbi_is_the_best_path():
    r = np.random.default_rng(1)
    n = len(tagger.TAGS)
    for _ in range(60):
        model = tagger.Tagger(np.zeros((1, n)), r.normal(size=(n, n)))
        scores = r.normal(size=(4, n))
        able = [p for p in itertools.product(range(n), repeat=4) if tagger.OPENS[p[0]] and all(tagger.ALLOWED[a][b] for a, b in itertools.pairwise(p))]
        best = max(able, key=lambda p: sum(scores[i][t] for i, t in enumerate(p)) + sum(model.steps[a][b] for a, b in itertools.pairwise(p)))
        assert model.path(scores) == list(best)


def test_odd_lines():
    model = tagger.train([("Dear Bob", [("PERSON", 5, 3)]), ("", []), (" ", [])])
    assert model.tag("") == [] and model.tag("  ") == [] and [x["match"] for x in model.tag("Dear Bob")] == ["Bob"]
    assert tagger.tags_of("a b", [("OTHER", 0, 1)]) == (["a", "b"], [0, 0])
    assert tagger.train([]).tag("Dear Bob") == []


def test_query(spark, sf):
    """Of the entities of lines that the tagger did not learn from, nearly all are found."""
    from pyspark.sql import functions as F

    from veilframe.plans import queries as q

    found = q.ner_tagged(spark, sf).collect()
    held = q.table(spark, sf, "orders").where(F.pmod(F.xxhash64("o_orderkey"), F.lit(5)) != 0).count()
    assert len(found) >= 0.9 * 2 * held and not {r["doc_id"] for r in found} & {r[0] for r in q.table(spark, sf, "orders").where(F.pmod(F.xxhash64("o_orderkey"), F.lit(5)) == 0).select("o_orderkey").collect()}
