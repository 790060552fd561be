"""What may reach the driver or one task stays bounded, with the same results."""

import random

import pytest
from pyspark.sql.classic.dataframe import DataFrame

from veilframe.llm import decontam, near_dedup, quality_rules, zstd_quality


@pytest.fixture
def collected(monkeypatch):
    """Numbers of rows that collects bring to the driver."""
    rows, real, lazily = [], DataFrame.collect, DataFrame.toLocalIterator

    def collect(df):
        out = real(df)
        rows.append(len(out))
        return out

    def iterate(df, *a, **k):
        out = list(lazily(df, *a, **k))
        rows.append(len(out))
        return iter(out)

    monkeypatch.setattr(DataFrame, "collect", collect)
    monkeypatch.setattr(DataFrame, "toLocalIterator", iterate)
    return rows


def test_repeated_ids_bring_one_text_each(spark, collected):
    docs = spark.range(3000).selectExpr("cast(id % 3 as long) as doc_id", "concat('text number ', cast(id as string)) as text")
    labels = spark.createDataFrame([(i, i % 2) for i in range(3)] * 2, "doc_id long, quality int")
    sample, _ = zstd_quality.sample(docs, labels, "doc_id", "text", "doc_id", "quality", 10, 5, 9)
    assert len(sample) == 3 and max(collected) <= 3


def test_rare_languages_are_not_collected(spark, collected):
    rows = [(i, "the cat and the dog went on to the house by the sea " * 8, "en") for i in range(60)] + [(100 + i, "junk junk words", f"x{i}") for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    found = quality_rules.fit(docs, reference_docs=50, reference_words=100)
    assert list(found) == ["en"] and max(collected) < 100
    alone = quality_rules.fit(docs.where("lang = 'en'"), reference_docs=50, reference_words=100)
    assert found == alone and found.words == alone.words


def test_a_tally_of_many_languages_goes_on(spark, monkeypatch):
    rows = [(i, f"word{i % 7} the and " * 20, f"l{i % 9}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1)
    whole = quality_rules.fit(docs, reference_docs=10, reference_words=100)
    monkeypatch.setattr(quality_rules, "TASK_LANGS", 2)
    assert quality_rules.fit(docs, reference_docs=10, reference_words=100) == whole and len(whole) == 9


def test_pairs_that_share_their_second_side(spark, monkeypatch):
    """A document that very many pairs have as `b` is dealt out as one that they have as `a`."""
    r = random.Random(1)
    base = [f"w{r.randrange(10**6)}" for _ in range(60)]
    texts = {i: " ".join(base[:-1] + [f"z{i}"]) if i % 3 else " ".join(f"q{r.randrange(10**6)}" for _ in range(40)) for i in range(40)} | {99: " ".join(base)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    pairs = spark.createDataFrame([(i, 99) for i in range(40)] + [(i, i + 1) for i in range(39)], "a long, b long")
    monkeypatch.setattr(near_dedup, "HEAD_PAIRS", 8)
    turned = near_dedup.turned(pairs)
    assert {tuple(x) for x in turned.collect()} == {(99, i) for i in range(40)} | {(i, i + 1) for i in range(39)}
    found = {frozenset((x["a"], x["b"])) for x in near_dedup.verify(pairs, docs).collect()}
    monkeypatch.setattr(near_dedup, "HEAD_PAIRS", 10**6)
    assert found == {frozenset((x["a"], x["b"])) for x in near_dedup.verify(pairs, docs).collect()}
    assert {frozenset((i, 99)) for i in range(40) if i % 3} <= found


def test_blocks_store_matches_only(spark, monkeypatch):
    r = random.Random(2)
    fresh = lambda n: " ".join(f"w{r.randrange(10**6)}" for _ in range(n))
    items = [(i, fresh(12)) for i in range(8)]
    docs = [(i, fresh(30) + (" " + items[i % 8][1] if i % 10 == 0 else "")) for i in range(200)]
    sizes, real = [], decontam.stored

    def stored(df):
        out = real(df)
        if "spans" in df.columns:
            sizes.append(out.count())
        return out

    monkeypatch.setattr(decontam, "stored", stored)
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    few = {tuple(x[:2]) for x in decontam.contaminated(d, b, block_words=15).select("doc_id", "n_hit").collect()}
    assert len(sizes) > 2 and sum(sizes) <= 20
    assert few == {tuple(x[:2]) for x in decontam.contaminated(d, b).select("doc_id", "n_hit").collect()}


def test_counts_by_bytes_and_by_places():
    """Class counts over bytes and word counts over places are those over code points and distinct words."""
    import numpy as np

    r = random.Random(4)
    letters = "aZ09 .,#\n\té漢Ω­\U0001f600 İß"
    places = quality_rules.Places(["the", "é", "a"])
    for _ in range(300):
        text = "".join(r.choice(letters) for _ in range(r.randrange(0, 60))) + r.choice(("", " the (The) 'é' a"))
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        assert (quality_rules.class_counts(text) == np.bincount(quality_rules.class_table()[codes], minlength=len(quality_rules.CLASSES))).all()
        found = quality_rules.word_counts(text)
        assert places.counts(text).tolist() == [found["the"], found["é"], found["a"], sum(found.values()) - found["the"] - found["é"] - found["a"]]
