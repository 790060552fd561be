"""Both dedup operators against brute force."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from pyspark.sql import functions as F

from veilframe.llm import common, near_dedup, queries, substring_dedup

SPACE = re.compile("[^\x20\x09-\x0d]+")
SCHEMA = "doc_id long, text string, id string, rest string, shard string, __gone_id string"


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def shingles(text):
    w = SPACE.findall(lower(text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def groups(rows):
    sets = {d: shingles(t) for d, t in rows}
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in sets}


def corpus(seed, n=60, words=60):
    """Random texts, exact copies, near copies that chain, and short and empty ones."""
    r = random.Random(seed)
    vocabulary = ["w%d" % i for i in range(400)]
    texts = []
    for i in range(n):
        kind = i % 6
        if kind == 0 or not texts:
            texts.append([r.choice(vocabulary) for _ in range(words)])
        elif kind == 1:
            texts.append(list(texts[-1]))
        elif kind in (2, 3, 4):
            t = list(texts[-1])
            for _ in range(r.randrange(1, 3)):
                if t:
                    t[r.randrange(len(t))] = r.choice(vocabulary)
            texts.append(t)
        else:
            texts.append(r.choice([[], ["a"], ["a", "b", "c"], ["A", "b", "c"], vocabulary[:5]]))
    return [(i * 3, " ".join(t).upper() if i % 7 == 0 else "\n ".join(t)) for i, t in enumerate(texts)]


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "i", "r", "s", "g") for d, t in rows], SCHEMA)


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates(spark, seed):
    rows = corpus(seed)
    found = near_dedup.near_duplicates(frame(spark, rows)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == groups(rows)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in found)
    kept = near_dedup.keep_one(frame(spark, rows))
    assert kept.columns == SCHEMA.replace(" long", "").replace(" string", "").split(", ")
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(d for d, (_, c) in groups(rows).items() if c == d)


def test_large_group_of_near_copies(spark, monkeypatch):
    """Members that the least document of a bucket doesn't link are still found, over several blocks."""
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    monkeypatch.setattr(near_dedup, "SLOT_ROWS", 64)
    monkeypatch.setattr(near_dedup, "HEAD_PAIRS", 16)
    monkeypatch.setattr(common, "HEAVY_ROWS", 16)
    r = random.Random(5)
    base = ["b%d" % i for i in range(120)]
    rows = []
    for i in range(90):
        t = list(base)
        for _ in range(r.randrange(0, 9)):
            t[r.randrange(len(t))] = "x%d" % r.randrange(10**6)
        rows.append((i, " ".join(t)))
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(frame(spark, rows)).collect()}
    assert found == groups(rows)


def test_join_of_heavy_groups(spark):
    """Dealt out or not, each row meets its key's row once; keys that one side lacks and null keys meet none."""
    rows = [(i % 3 if i < 90 else 100 + i, i) for i in range(95)] + [(None, 200), (1, None), (1, 5), (1, 5)]
    left = spark.createDataFrame(rows, "k long, id long")
    right = spark.createDataFrame([(0, "zero", 30), (1, "one", 33), (190, "few", 1), (7, "none", 40), (None, "null", 1)], "k long, name string, n long")
    expected = sorted(((k, i or -1, name) for k, i in rows for q, name in [(0, "zero"), (1, "one"), (190, "few")] if k == q), key=str)
    for heavy in (1_000, 31, 0):
        out = common.join_groups(left, right, ["k"], "n", ["id"], heavy=heavy)
        assert sorted(out.columns) == ["id", "k", "n", "name"]
        assert sorted(((r["k"], r["id"] or -1, r["name"]) for r in out.collect()), key=str) == expected


def test_heavy_groups_of_copies(spark, monkeypatch):
    """Exact and near copies beyond the bound of a join give the same groups; a third of the rows have no words."""
    monkeypatch.setattr(common, "HEAVY_ROWS", 5)
    rows = corpus(3, 48)
    n = len(rows)
    rows += [(1_000 + i, rows[0][1]) for i in range(20)] + [(2_000 + i, None if i % 2 else " ") for i in range(n // 2)]
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(frame(spark, rows)).collect()}
    assert found == groups(rows)


def test_near_edge_cases(spark):
    rows = [(None, "a b c d e f"), (5, "a b c d e f"), (4, "a b c d e f"), (4, "a b c d e f"), (9, None), (8, ""), (7, " \n"), (6, "a b c d e f " * 2000)]
    out = near_dedup.near_duplicates(frame(spark, rows)).collect()
    assert len(out) == len(rows)
    by = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in out}
    assert by[None] == (2, None, True) and by[5] == (2, 4, False) and by[4] == (2, 4, True)
    assert all(by[d] == (0, d, True) for d in (7, 8, 9)) and by[6][1] == 6
    assert near_dedup.near_duplicates(frame(spark, rows).where("false")).count() == 0
    assert near_dedup.keep_one(frame(spark, rows)).count() == len(rows) - 1


def test_keep_one_by_text_where_ids_repeat(spark, monkeypatch):
    """A clean text stays though its id also has a copy; a group linked through one text of an id keeps a row of the other; copies go."""
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    a, b, c, d = (" ".join(f"{x}{i}" for i in range(40)) for x in "abcd")
    rows = [(1, a), (5, a), (5, b), (6, c), (6, d), (3, c + " more"), (7, d), (8, None), (8, None), (9, b), (9, b), (None, a), (2, "x y"), (2, "x y")]
    base = ["g%d" % i for i in range(120)]
    r = random.Random(5)
    group = [(100 + i, " ".join("y%d" % r.randrange(10**6) if r.random() < 0.04 else w for w in base)) for i in range(30)]
    out = sorted((x["doc_id"] or 0, x["text"] or "") for x in near_dedup.keep_one(frame(spark, rows + group), repeats=False).collect())
    small = [x for x in out if x[0] < 100]
    assert small == sorted([(1, a), (5, b), (3, c + " more"), (6, d), (8, ""), (0, a), (2, "x y")])
    assert [x[0] for x in out if x[0] >= 100] == sorted(i for i, (_, g) in groups(group).items() if g == i)
    assert near_dedup.keep_one(frame(spark, rows)).where("doc_id = 2").count() == 2


def test_sketches_fill_and_concentrate():
    r = np.random.default_rng(1)
    sets = [np.unique(r.integers(0, 2**63, n).astype(np.uint64)) for n in (1, 3, 50, 900)]
    s = near_dedup.sketches([np.zeros(0, np.uint64), *sets])
    assert s.shape == (5, near_dedup.T) and not s[0].any()
    whole = np.unique(r.integers(0, 2**63, 700).astype(np.uint64))
    a, b = near_dedup.sketches([whole[:600], whole[100:]])
    assert abs((a == b).mean() - 500 / 700) < 4 * (0.2 / near_dedup.T) ** 0.5


def test_recall_at_the_threshold():
    """Planted pairs of similarity 0.75 to 0.78 all share a band, and sketches put next to none of them further under the threshold than SLACK."""
    r = np.random.default_rng(3)
    for union in (12, 40, 200, 600):
        pairs = []
        for _ in range(1500 if union < 600 else 300):
            common = int(np.ceil(r.uniform(0.75, 0.78) * union))
            v = r.integers(0, 2**63, union).astype(np.uint64)
            k = r.integers(common, union + 1)
            pairs += [np.unique(v[:k]), np.unique(np.concatenate([v[:common], v[k:]]))]
        s = near_dedup.sketches(pairs)
        bands = np.ascontiguousarray(s[:, : near_dedup.BANDS * near_dedup.ROWS]).view(np.int64)
        assert (bands[0::2] == bands[1::2]).any(axis=1).mean() == 1
        assert ((s[0::2] == s[1::2]).mean(axis=1) >= 0.75 - near_dedup.SLACK).mean() > 0.9995


def test_small_unequal_sets_share_bands():
    """Rounds from 512 on have keys of their own: sets of few shingles reach them, and one of two near copies may stop before."""
    r = np.random.default_rng(7)
    for common, union in ((3, 4), (4, 5), (6, 7), (6, 8), (9, 10), (9, 12)):
        sets = []
        for _ in range(500):
            v = r.integers(0, 2**63, union).astype(np.uint64)
            k = r.integers(common, union + 1)
            sets += [np.unique(v[:k]), np.unique(np.concatenate([v[:common], v[k:]]))]
        s = near_dedup.sketches(sets)
        bands = np.ascontiguousarray(s[:, : near_dedup.BANDS * near_dedup.ROWS]).view(np.int64)
        assert (bands[0::2] == bands[1::2]).any(axis=1).all()
        share = (s[0::2] == s[1::2]).mean(axis=1)
        assert abs(share.mean() - common / union) < 0.004 and (share >= common / union - near_dedup.SLACK).all()


def removed(rows):
    """Brute force: (n_words, n_removed, kept words) of each document."""
    seen, out = set(), {}
    for d, t in sorted(rows):
        w, gone = SPACE.findall(t or ""), set()
        for k in range(len(w) - 19):
            x = tuple(w[k : k + 20])
            if x in seen:
                gone.update(range(k, k + 20))
            seen.add(x)
        out[d] = (len(w), len(gone), " ".join(v for i, v in enumerate(w) if i not in gone))
    return out


def passages(seed):
    r = random.Random(seed)
    fresh = lambda n: ["%s%d" % (r.choice("abé"), r.randrange(10**5)) for _ in range(n)]
    shared = [fresh(n) for n in (19, 20, 21, 45, 120)]
    rows = []
    for i in range(50):
        t = fresh(r.randrange(0, 40))
        for _ in range(r.randrange(0, 3)):
            p = r.choice(shared)
            k = r.randrange(0, len(p) // 2)
            t += p[k:] + fresh(r.randrange(0, 6))
        if i % 9 == 0:
            t += t[:30] + t[:30]
        if i % 11 == 0:
            t = ["z"] * r.randrange(15, 80)
        rows.append((100 - i, r.choice([" ", "\n", "\t "]).join(t)))
    return rows + [(200, rows[0][1]), (201, rows[0][1])]


@pytest.mark.parametrize(("seed", "shard_bytes", "slot_bytes"), [(1, 1 << 20, 1 << 20), (2, 2000, 1000), (3, 300, 300), (4, 1 << 20, 600)])
def test_substrings(spark, seed, shard_bytes, slot_bytes):
    rows = passages(seed)
    out = substring_dedup.remove_repeats(frame(spark, rows), carry=("rest", "id"), shard_bytes=shard_bytes, slot_bytes=slot_bytes)
    assert out.columns == ["doc_id", "rest", "id", "n_words", "n_removed", "kept_words", "text"]
    found = out.collect()
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_words"]) for r in found} == removed(rows)
    assert all(SPACE.findall(r["text"]) == r["kept_words"].split() and r["rest"] == "r" for r in found)
    assert any(r["n_removed"] for r in found)


def test_phrases_of_many_documents(spark, monkeypatch):
    """A phrase of more documents than the bound of a join is dealt out; the result is the same."""
    monkeypatch.setattr(common, "HEAVY_ROWS", 4)
    rows = passages(6)
    out = substring_dedup.remove_repeats(frame(spark, rows), shard_bytes=2_000, slot_bytes=1_000).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_words"]) for r in out} == removed(rows)


def test_substring_edge_cases(spark):
    p = " ".join("p%d" % i for i in range(25))
    rows = [(None, p), (3, p), (3, p), (2, None), (1, ""), (4, p), (5, "x " * 30000)]
    out = substring_dedup.remove_repeats(frame(spark, rows)).collect()
    assert len(out) == len(rows)
    by = {}
    for r in out:
        by.setdefault(r["doc_id"], []).append(r["n_removed"])
    assert by == {None: [0], 3: [0, 0], 2: [0], 1: [0], 4: [25], 5: [29999]}
    assert substring_dedup.remove_repeats(frame(spark, rows).where("false")).count() == 0


def test_the_automaton_decides(monkeypatch):
    """Occurrences come from the automaton only: without its finds, and without any one phrase, windows are missing."""
    words = ["p%d" % i for i in range(40)]
    texts = [" ".join(words).encode(), " ".join(["x", *words, "y"]).encode()]
    flat, starts, counts = substring_dedup.layout(texts)
    g, least, _ = substring_dedup.least_seeds(flat, starts, counts)
    ks = np.unique(least[:21]).view(np.int64)

    def slot(ks):
        zip_ = zstandard.ZstdCompressor().compress
        table = pa.table({"id": [1, 2], "mark": [0, 0], "packed": [zip_(t) for t in texts], "ks": pa.array([ks, None], pa.list_(pa.int64())), "stream": [True, True]})
        return substring_dedup.windows_of(table)

    doc, at, _, first = slot(ks.tolist())
    assert doc.tolist() == [0] * 21 + [1] * 23 and at.tolist() == [*range(21), *range(23)] and first.tolist() == [True] * 22 + [False] * 21 + [True]
    assert len(ks) > 1 and len(slot(ks[1:].tolist())[0]) < 44
    monkeypatch.setattr(substring_dedup, "located", lambda flat, starts, counts, phrases: np.isin(np.arange(len(flat)), phrases))
    assert slot(ks.tolist())[0].tolist() == [0] * 21
    monkeypatch.setattr(substring_dedup, "located", lambda flat, starts, counts, phrases: np.zeros(len(flat), bool))
    assert not len(slot(ks.tolist())[0])


def test_windows_are_compared_by_words(spark, monkeypatch):
    """Where all windows of a slot have one hash, the result is the same."""
    r = np.random.default_rng(3)
    flat = r.integers(0, 3, 4000).astype(np.int32)
    at = np.nonzero(r.random(3980) < 0.7)[0]
    seen, want = set(), []
    for i in at.tolist():
        w = tuple(flat[i : i + 6].tolist())
        want.append(w not in seen)
        seen.add(w)
    assert substring_dedup.firsts(flat, at, 6).tolist() == want
    real = substring_dedup.windows
    monkeypatch.setattr(substring_dedup, "windows", lambda hashes, width: real(hashes, width) % np.uint64(5))
    assert substring_dedup.firsts(flat, at, 6).tolist() == want
    monkeypatch.setattr(substring_dedup, "windows", lambda hashes, width: real(hashes, width) * np.uint64(0))
    assert substring_dedup.firsts(flat, at, 6).tolist() == want


def test_streamed_texts_are_found_without_their_hashes(monkeypatch):
    """What a slot reads of a streamed text is its words: forged hashes of them change nothing."""
    words = ["p%d" % i for i in range(40)]
    texts = [" ".join(words).encode(), " ".join(["x", *words, "y"]).encode()]
    flat, starts, counts = substring_dedup.layout(texts)
    ks = np.unique(substring_dedup.least_seeds(flat, starts, counts)[1][:21]).view(np.int64).tolist()
    zip_ = zstandard.ZstdCompressor().compress
    table = pa.table({"id": [1, 2], "mark": [0, 0], "packed": [zip_(t) for t in texts], "ks": pa.array([ks, None], pa.list_(pa.int64())), "stream": [True, True]})
    want = [x.tolist() for x in np.array(substring_dedup.windows_of(table), dtype=object)[[0, 1, 3]]]
    real = substring_dedup.WORDS.of
    monkeypatch.setattr(substring_dedup, "WORDS", type("Forged", (), {"of": staticmethod(lambda lists: real(lists) if lists[0][0] == b"p0" else (np.zeros(sum(map(len, lists)), np.uint64), None))}))
    assert [x.tolist() for x in np.array(substring_dedup.windows_of(table), dtype=object)[[0, 1, 3]]] == want


def test_located_phrases():
    texts = [b"a b c d e f g h i", b"", b"x a b c d e f g h"]
    flat, starts, counts = substring_dedup.layout(texts)
    assert np.nonzero(substring_dedup.located(flat, starts, counts, np.array([0])))[0].tolist() == [0, 10]


def test_queries(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = removed(docs)
    rows = queries.op7_substring_dedup(spark, sf).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in rows} == {d: (n, g, hashlib.sha256(k.encode()).hexdigest()) for d, (n, g, k) in want.items()}
    rows = queries.op10_near_dedup(spark, sf).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows} == groups(docs)


def test_sql_of_exact_operators(spark, sf):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    for name, sql in queries.ORACLE.items():
        df = queries.QUERIES[name](spark, sf)
        found = c.execute(sql)
        columns = [d[0] for d in found.description]
        assert sorted(columns) == sorted(df.columns)
        assert sorted(map(tuple, df.select(*columns).collect())) == sorted(map(tuple, found.fetchall()))


def test_slots_exchange_windows_of_own_seeds_only(spark):
    """A passage in all documents, each else of words of its own: of the windows that reach out of it about half are exchanged, all repeats are found."""
    r = random.Random(11)
    fresh = lambda n: [f"w{r.randrange(10**9)}" for _ in range(n)]
    passage = fresh(30)
    texts = {i: [*fresh(40), *passage, *fresh(40)] for i in range(60)}
    docs = spark.createDataFrame([(i, 0, " ".join(t)) for i, t in texts.items()], "id long, mark long, text string")
    plan = substring_dedup.routes(substring_dedup.seeds(docs), 1, 6)
    packed = docs.select("id", "mark", F.encode("text", "utf-8").alias("text"))
    zip_ = F.udf(lambda t: substring_dedup.zstandard.ZstdCompressor().compress(bytes(t)), "binary")
    found = substring_dedup.found_rows(plan.join(packed.select("id", "mark", zip_("text").alias("packed")), ["id", "mark"])).collect()
    heads = [(x["id"], x["at"]) for x in found if x["k"] is not None]
    slots = plan.select("slot").distinct().count()
    assert slots > 5 and len(heads) < 0.75 * (24 * 60 + 11 * slots)
    assert len({x["id"] for x in found if x["k"] is not None and 40 <= x["at"] <= 50}) >= slots - 1
    out = substring_dedup.remove_repeats(docs.selectExpr("id as doc_id", "text"), slot_bytes=4096).collect()
    assert {x["doc_id"]: x["n_removed"] for x in out} == {i: 30 if i else 0 for i in texts}


def slots_found(docs, per_slot):
    """The plan of one shard of texts by id, and what its slots find."""
    plan = substring_dedup.routes(substring_dedup.seeds(docs), 1, per_slot)
    zip_ = F.udf(lambda t: substring_dedup.zstandard.ZstdCompressor().compress(t.encode()), "binary")
    return plan, substring_dedup.found_rows(plan.join(docs.select("id", "mark", zip_("text").alias("packed")), ["id", "mark"])).collect()


def test_phrases_of_few_documents_exchange_nothing(spark):
    """A shard that is large by the number of its phrases is dealt out by owners, so no window has to be agreed on."""
    r = random.Random(21)
    fresh = lambda n: [f"w{r.randrange(10**9)}" for _ in range(n)]
    shared = [fresh(30) for _ in range(40)]
    texts = {i: " ".join([*fresh(30), *shared[i % 40], *fresh(30)]) for i in range(120)}
    docs = spark.createDataFrame([(i, 0, t) for i, t in texts.items()], "id long, mark long, text string")
    plan, found = slots_found(docs, 40)
    assert plan.select("shard").distinct().count() > 3 and not [x for x in found if x["k"] is not None]
    out = substring_dedup.remove_repeats(docs.selectExpr("id as doc_id", "text"), slot_bytes=20_000).collect()
    assert {x["doc_id"]: (x["n_words"], x["n_removed"], x["kept_words"]) for x in out} == removed(texts.items())


def test_a_common_line_alone_is_not_exchanged(spark):
    """Of a line in all documents only places go to a slot that have more words in common, and there only windows that hold them."""
    r = random.Random(22)
    fresh = lambda n: [f"w{r.randrange(10**9)}" for _ in range(n)]
    line, before, after = fresh(10), fresh(10), fresh(10)
    texts = {}
    for i in range(90):
        mid = {0: [*before, *line], 1: [*line, *after], 2: [*before[4:], *line, *after[:4]]}.get(i % 15, line)
        texts[i] = " ".join([*fresh(30), *mid, *fresh(30), *(line if i % 7 == 3 else []), *fresh(25)])
    texts |= {90: " ".join([*before[:4], *line, *fresh(20)]), 91: " ".join([*fresh(20), *line, *after[:7]]), 92: " ".join([*fresh(3), *line, *after]), 93: " ".join(line * 6)}
    docs = spark.createDataFrame([(i, 0, t) for i, t in texts.items()], "id long, mark long, text string")
    plan, found = slots_found(docs, 4)
    heads = [x for x in found if x["k"] is not None]
    assert plan.where("stream").select("id").distinct().count() < 30 and 0 < len(heads) < 90
    out = substring_dedup.remove_repeats(docs.selectExpr("id as doc_id", "text"), slot_bytes=4096).collect()
    assert {x["doc_id"]: (x["n_words"], x["n_removed"], x["kept_words"]) for x in out} == removed(texts.items())
