"""BPE and token counts against the tokenizers library, on texts that exercise every branch."""

import hashlib

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from veilframe.llm import bpe, queries, token_counts

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
CODEC = bpe.Codec(bpe.read_spec(PATH))

TEXTS = [
    None, "", " \t\n", "Hello World's <|endoftext|> x<|startoftext|>y don't I'LL aaaa AAAA", "ÀÉÎ Σας ΣΑΣ İstanbul 日本語 ½²٣ \x1c\x1d a\x0bb\xa0c é ﬁ", "''s '' 'S <|endof text|> x\x85y",
    "🙂🙂 naïve\x00\x01 �", "ſß ǅ ᾳ ῼ 123 1a2b Å K", "a" * 5000, "word " * 3000, "<|endoftext|>" * 3, "é É",
]


def expected(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("text", TEXTS)
def test_same_ids_and_text(text):
    ids, bounds = CODEC.encode(["x", text or "", "y"])
    own = ids[bounds[1] : bounds[2]].tolist()
    assert own == expected(text)
    assert CODEC.decode(own) == LIBRARY.decode(own, skip_special_tokens=False)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    assert CODEC.encode([text])[0].tolist() == expected(text)


def test_ranks_are_trained_in_order():
    """No rule joins parts that a later rule makes, so ascending ranks give the library's result."""
    made = {}
    for r, (_, _, new) in enumerate(CODEC.pairs.rules):
        made.setdefault(new, r)
    assert all(made.get(a, -1) < r and made.get(b, -1) < r for r, (a, b, _) in enumerate(CODEC.pairs.rules))


def test_small_cache_changes_nothing():
    small = bpe.Codec(bpe.read_spec(PATH), cache_words=4)
    for t in ("one two three four five six", "six seven one"):
        assert small.encode([t])[0].tolist() == expected(t)


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(None, "a b", "y"), (1, "", "z"), (1, "", "z")]
    return spark.createDataFrame(rows, "doc_id long, text string, token_ids string")


def test_encode_and_decode(docs):
    out = bpe.encode(docs, PATH)
    rows = out.collect()
    assert out.columns == ["doc_id", "token_ids"] and len(rows) == len(TEXTS) + 3
    assert all(r["token_ids"] == expected(TEXTS[r["doc_id"]]) for r in rows if r["doc_id"] not in (None, 1))
    back = {r["doc_id"]: r["text"] for r in bpe.decode(out, PATH).collect()}
    assert all(back[i] == LIBRARY.decode(expected(t), skip_special_tokens=False) for i, t in enumerate(TEXTS))


def test_decode_of_null_and_unknown_ids(spark):
    df = spark.createDataFrame([(1, None), (2, [320, None, 99999999])], "doc_id long, token_ids array<int>")
    assert [r["text"] for r in bpe.decode(df, PATH).orderBy("doc_id").collect()] == ["", CODEC.pairs.token[320]]


def test_empty_tables(docs):
    none = docs.where("false")
    assert bpe.encode(none, PATH).count() == 0
    assert token_counts.token_counts(none, PATH).count() == 0


def test_counts(docs):
    rows = token_counts.token_counts(docs, PATH, limit=100, table_words=8).collect()
    assert len(rows) == len(TEXTS) + 3
    for r in rows:
        text = "a b" if r["doc_id"] is None else TEXTS[r["doc_id"]] or ""
        assert (r["n_tokens"], r["n_bytes"]) == (len(expected(text)), len(text.encode()))
        assert r["over_limit"] == (r["n_tokens"] > 100)


def test_counts_do_not_depend_on_the_table(docs):
    few = {tuple(r) for r in token_counts.token_counts(docs, PATH, table_words=1).collect()}
    assert few == {tuple(r) for r in token_counts.token_counts(docs, PATH).collect()}


def test_table_packs():
    lengths = {"the": 1, "é": 2, "x" * 50: 9}
    assert token_counts.unpack(token_counts.pack(lengths)) == lengths


def test_queries(spark, sf):
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op1_bpe(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = expected(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(LIBRARY.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    counts = {r["doc_id"]: r for r in queries.op3_token_counts(spark, sf).collect()}
    assert all(counts[r["doc_id"]]["n_tokens"] == r["n_tokens"] for r in rows)
    assert queries.op3_token_counts(spark, sf).where(F.col("over_limit") != (F.col("n_tokens") > 2048)).count() == 0


def test_no_word_is_shuffled(spark, sf, monkeypatch):
    """Summaries are packed rows, merged a few at a time whatever the number of tasks; the table is that of one pass."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").repartition(11)
    spec, plans = bpe.read_spec(PATH), []
    real = token_counts.stored
    monkeypatch.setattr(token_counts, "stored", lambda df: plans.append((df.columns, df._jdf.queryExecution().executedPlan().toString())) or real(df))
    merged = token_counts.frequent_lengths(docs, spec, text_col="text", table_words=500, merged=3)
    assert len(plans) == 3 and all(c == ["packed"] for c, _ in plans)
    assert all("hashpartitioning" not in p and "Aggregate" not in p for _, p in plans)
    whole = token_counts.frequent_lengths(docs, spec, text_col="text", table_words=500)
    assert len(token_counts.unpack(merged)) == 500 and len(token_counts.unpack(merged).keys() & token_counts.unpack(whole).keys()) > 400


def test_the_tiers_stay_apart():
    """The table is only read, the cache is bounded and filled by its misses."""
    codec = bpe.Codec(bpe.read_spec(PATH))
    table = dict(zip(["the", "and"], codec.pairs.encode([b"the", b"and"])[1].tolist(), strict=True))
    counts = token_counts.Counts(codec, table, cache_words=40 + len(codec.pairs.specials))
    texts = [" ".join(f"word{i}x the and" for i in range(k, k + 20)) for k in range(0, 200, 20)]
    assert [counts.count([t])[0] for t in texts] == [len(codec.encode([t])[0]) for t in texts]
    assert dict(counts.table) == table and "the" not in counts.cache and len(counts.cache) <= 40 + len(codec.pairs.specials)
    # A wrong table shows, so it is the table that is asked first.
    assert token_counts.Counts(codec, {"the": 7}).count(["the the"]) == [14]


def test_packed_counts():
    counts = token_counts.Counter({"a": 3, "é": 2, "b": 2, "x\ny": 9})
    assert token_counts.unpack_counts(token_counts.pack_counts(counts, 2)) == {"a": 3, "b": 2}
    assert token_counts.unpack_counts(token_counts.pack_counts(token_counts.Counter(), 2)) == {}
