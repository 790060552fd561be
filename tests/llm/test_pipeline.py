"""The pipeline's stages on planted cases and on rows that are null, empty, long or repeated, and run() against the stages done plainly."""

import random
import re

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as cp

LIBRARY = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    """Documents with copies, shared passages, benchmark text and junk, in a folder of their own."""
    r = random.Random(4)
    fresh = lambda n: " ".join(r.choice(["the", "of", "and", "thorin", "reath", "onest", "inghe", "eronat"]) + str(r.randrange(99)) * (r.random() < 0.3) for _ in range(n))
    rows, labels = [], []
    for i in range(60):
        bad = i % 6 == 5
        t = fresh(80)
        rows.append((i, " ".join(w + "***" for w in t.upper().split()) if bad else t, "en", "s", len(t)))
        labels.append((i, 0 if bad else 1, 0))
    passage, item = fresh(60), fresh(14)
    rows += [(100, rows[0][1], "en", "s", 0), (101, rows[1][1] + " extra", "en", "s", 0)]
    rows += [(102, f"{fresh(50)} {passage} {fresh(50)}", "en", "s", 0), (103, f"{fresh(70)} {passage} {fresh(40)}", None, None, None)]
    rows += [(104, f"{fresh(40)} {item} {fresh(40)}", "en", "s", 0)]
    top = tmp_path_factory.mktemp("planted")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{top}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{top}/benchmark.parquet")
    return str(top), {r[0]: r[1] for r in rows}, passage


def test_stages_take_effect(spark, planted, tmp_path):
    top, texts, passage = planted
    docs, seen = spark.read.parquet(f"{top}/documents.parquet"), {}
    for name, stage in cp.STAGES:
        out = stage(spark, docs, top)
        if name != cp.STAGES[-1][0]:
            assert tuple(out.columns) == cp.COLUMNS
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = {r["doc_id"]: r for r in docs.collect()}
    good = {i for i in range(60) if i % 6 != 5}
    assert set(seen["quality"]) == good | {100, 101, 102, 103, 104}
    assert set(seen["near_dedup"]) == good | {102, 103, 104}
    cut = seen["substring_dedup"]
    assert passage in cut[102]["text"] and passage not in cut[103]["text"] and cut[103]["n_chars"] == len(cut[103]["text"])
    assert all(cut[i]["text"] == texts[i] for i in good)
    assert set(seen["decontamination"]) == good | {102, 103}
    for i, r in seen["bpe"].items():
        assert r["token_ids"] == LIBRARY.encode(cut[i]["text"], add_special_tokens=False).ids and r["n_tokens"] == len(r["token_ids"])


def test_run_is_the_stages(spark, planted):
    top, _, _ = planted
    assert {r["doc_id"] for r in cp.run(spark, top).collect()} == {i for i in range(60) if i % 6 != 5} | {102, 103}


def test_last_stage_decodes(spark):
    texts = ["The planted words, 12 of them.", "", None, "thorin reath " * 300]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    rows = cp.tokenise(spark, docs, "").collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r["decoded"] == LIBRARY.decode(LIBRARY.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids, skip_special_tokens=False)


def test_five_stages_in_order():
    assert [n for n, _ in cp.STAGES] == ["quality", "near_dedup", "substring_dedup", "decontamination", "bpe"]
    assert cp.ORACLE_SQL is None


WORDS = re.compile("[^\x20\x09-\x0d]+")


def plain_pipeline(rows, items, good):
    """{(id, text)} after quality (`good` says), near dedup, substring dedup and decontamination, the long way round."""
    kept = [r for r in dict.fromkeys(rows) if good(r[1])]
    shingle = lambda t: {tuple(w[i : i + 5]) for w in [WORDS.findall(t.lower())] for i in range(max(1, len(w) - 4))} if WORDS.search(t) else set()
    group = {r: r for r in kept}
    for a in kept:
        for b in kept:
            x, y = shingle(a[1]), shingle(b[1])
            if a < b and x and 100 * len(x & y) >= 75 * len(x | y):
                old, new = max(group[a], group[b]), min(group[a], group[b])
                group = {k: new if v == old else v for k, v in group.items()}
    out, seen = [], set()
    for i, t in sorted(r for r in kept if group[r] == r):
        w, gone = WORDS.findall(t), set()
        for k in range(len(w) - 19):
            if (x := tuple(w[k : k + 20])) in seen:
                gone.update(range(k, k + 20))
            seen.add(x)
        words = [v for k, v in enumerate(w) if k not in gone]
        plain = [re.findall(r"[a-z0-9]+", v.lower()) for v in (" ".join(words), *items)]
        windows = {tuple(p[k : k + 10]) for p in plain[1:] for k in range(len(p) - 9)}
        if not any(tuple(plain[0][k : k + 10]) in windows for k in range(len(plain[0]) - 9)):
            out.append((i, words))
    return out


def test_run_against_brute_force(spark, planted):
    top, texts, _ = planted
    bad = lambda t: "***" in t
    items = [r["text"] for r in spark.read.parquet(f"{top}/benchmark.parquet").collect()]
    want = plain_pipeline(list(texts.items()), items, lambda t: not bad(t))
    out = {r["doc_id"]: r["token_ids"] for r in cp.run(spark, top).collect()}
    assert sorted(out) == [i for i, _ in want]
    for i, words in want:
        assert out[i] == LIBRARY.encode(" ".join(words), add_special_tokens=False).ids


def awkward(spark, top, rows):
    schema = "doc_id long, text string, lang string, source string, n_chars long, spans string, shard string, bands string, k string, left string, text_md5 string"
    spark.createDataFrame([(i, t, None, "s", None, "x", "x", "x", "x", "x", "x") for i, t in rows], schema).write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (None, 0, None), (1, None, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{top}/labels.parquet")
    spark.createDataFrame([(1, None), (None, ""), (None, "q1 q2 q3 q4 q5 q6 q7 q8 q9 q10 q11")], "item_id long, text string").write.parquet(f"{top}/benchmark.parquet")


def test_awkward_rows(spark, tmp_path):
    """Null, empty, repeated and very long rows, and extra columns with the names that operators use."""
    t, u = (" ".join(f"{x}{i}" for i in range(30)) for x in "tu")
    long = " ".join("z%d" % (i % 7919) for i in range(60_000))
    rows = [(1, t), (1, t), (2, None), (2, None), (None, t), (None, None), (3, ""), (4, " \n"), (5, u), (5, t), (6, long), (7, "q1 q2 Q3 q4 q5 q6 q7 q8 q9 q10")]
    awkward(spark, tmp_path, rows)
    out = sorted(((r["doc_id"] or 0), r["n_tokens"] > 0) for r in cp.run(spark, str(tmp_path)).collect())
    # (5, t) is a copy of (1, t); the long text keeps its first lap; 7 is contaminated.
    assert out == [(0, False), (0, True), (1, True), (2, False), (3, False), (4, False), (5, True), (6, True)]
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in cp.STAGES[:-1]:
        assert tuple(stage(spark, docs, str(tmp_path)).columns) == cp.COLUMNS, name


def test_empty_tables(spark, tmp_path):
    awkward(spark, tmp_path, [(1, "a")])
    for name in ("documents", "labels", "benchmark"):
        table = spark.read.parquet(f"{tmp_path}/{name}.parquet")
        spark.createDataFrame([], table.schema).write.parquet(f"{tmp_path}/none/{name}.parquet")
    assert cp.run(spark, f"{tmp_path}/none").count() == 0
