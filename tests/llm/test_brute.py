"""Scores and verdicts that SQL cannot say, against slow and plain versions of them."""

import collections
import math
import random
import unicodedata

import numpy as np
import pytest
import zstandard

from veilframe.llm import byte_cnn, common, decontam, quality_rules, zstd_quality


def plain_classes(text):
    out = [0] * 8
    for c in text:
        k = unicodedata.category(c)
        if c in "#*$%&|<>":
            name = "symbol"
        elif c in "\t\n\x0b\x0c\r ":
            name = "blank"
        else:
            name = {"Ll": "lower", "Lu": "upper", "Lt": "upper"}.get(k) or {"L": "letter", "M": "letter", "N": "digit", "Z": "blank", "P": "mark", "S": "symbol", "C": "control"}[k[0]]
        out[quality_rules.CLASSES.index(name)] += 1
    return out


def plain_words(text):
    return [w.strip(quality_rules.EDGE) for w in text.lower().split()]


def plain_distance(p, q):
    p, q = [x / sum(p) for x in p], [x / sum(q) for x in q]
    kl = lambda a, b: sum(x * math.log2(x / y) for x, y in zip(a, b, strict=True) if x)
    m = [(x + y) / 2 for x, y in zip(p, q, strict=True)]
    return math.sqrt(max(0, (kl(p, m) + kl(q, m)) / 2))


def test_quality_verdicts(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r["doc_id"], r["text"] or "", r["lang"]) for r in docs.collect()]
    rows += [(10_000, "Éßa 漢字 ١٢ " * 60, None), (10_001, "the of and " * 4000, "xx"), (10_002, None, "en")]
    frame = spark.createDataFrame([(i, t, lang, "k") for i, t, lang in rows], "doc_id long, text string, lang string, kept string")
    counts, classes, n_docs = collections.defaultdict(collections.Counter), {}, collections.Counter()
    for _, t, lang in rows:
        if lang is not None:
            t = t or ""
            counts[lang].update(plain_words(t))
            classes[lang] = [x + y for x, y in zip(classes.get(lang, [0] * 8), plain_classes(t), strict=True)]
            n_docs[lang] += 1
    langs = [k for k in counts if n_docs[k] >= quality_rules.REFERENCE_DOCS and sum(counts[k].values()) >= quality_rules.REFERENCE_WORDS]
    assert "xx" not in langs and len(langs) == 4
    words = sorted({w for k in langs for w, n in counts[k].items() if w and n >= quality_rules.COMMON_SHARE * sum(counts[k].values())})
    found = quality_rules.fit(frame)
    assert found.words == tuple(words) and sorted(found) == sorted(langs)
    assert all(found[k][0] == classes[k] for k in langs)
    both = 0
    for r in quality_rules.judge(frame, found).collect():
        t = next(x[1] for x in rows if x[0] == r["doc_id"]) or ""
        n = r["n_words"]
        a = min(plain_distance(plain_classes(t), classes[k]) for k in langs) if len(t) >= quality_rules.MIN_CHARS else None
        own = collections.Counter(plain_words(t))
        vector = lambda c: [*(c[w] for w in words), sum(c.values()) - sum(c[w] for w in words)]
        b = min(plain_distance(vector(own), vector(counts[k])) for k in langs) if n >= quality_rules.MIN_WORDS else None
        assert (r["class_distance"] is None) == (a is None) and (r["word_distance"] is None) == (b is None)
        assert a is None or r["class_distance"] == pytest.approx(a, abs=1e-9)
        assert b is None or r["word_distance"] == pytest.approx(b, abs=2e-3)
        far = (a or 0) > quality_rules.MAX_CLASS_DISTANCE or (b or 0) > quality_rules.WORD_DISTANCE + quality_rules.WORD_NOISE / max(1, n) ** 0.5
        assert r["kept"] == (not r["base_failed"] and not far)
        both += far and not r["base_failed"]
    assert both


def test_quality_rules_edge_cases(spark):
    frame = spark.createDataFrame([(1, None, "en", "x"), (1, "", None, "x"), (None, "a b", "en", "x"), (1, "a b", "en", "x"), (2, "word " * 90_000, "en", "x")], "doc_id long, text string, lang string, n_words string")
    found = quality_rules.fit(frame)
    assert found == {} and found.words == ()
    out = quality_rules.judge(frame, found).collect()
    assert sorted((r["doc_id"] or 0, r["n_words"], r["base_failed"]) for r in out) == [(0, 2, True), (1, 0, True), (1, 0, True), (1, 2, True), (2, 90_000, True)]
    assert quality_rules.fit(frame.where("false")) == {} and quality_rules.judge(frame.where("false"), found).count() == 0


def test_full_summaries_keep_what_is_common(monkeypatch):
    monkeypatch.setattr(quality_rules, "SUMMARY_WORDS", 50)
    monkeypatch.setattr(quality_rules, "TASK_SHARE", 0.01)
    t = quality_rules.Tally()
    for i in range(300):
        t.add(f"the cat r{i} s{i}, THE")
    rows = {name: n for kind, name, n in t.rows() if kind == "word"}
    assert rows == {"the": 600, "cat": 300} and t.total == 1500 and t.docs == 300


def test_compressed_size_difference(spark):
    r = random.Random(3)
    good = [" ".join(r.choice(["the", "river", "stone", "bridge", "walks", "evening"]) for _ in range(60)) for _ in range(80)]
    bad = [" ".join(r.choice(["win$$$", "cash!!!", "click***", "now%%%", "free###"]) for _ in range(60)) for _ in range(80)]
    rows = [(i, t, "s") for i, t in enumerate(good + bad)] + [(500, good[0] * 400, "s"), (501, good[1], "s"), (501, good[1], "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, int(i < 80)) for i in range(160)], "doc_id long, quality int")
    model = zstd_quality.fit(docs, labels)
    out = zstd_quality.score(docs, model).collect()
    ends = [zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(d), level=model.level, write_content_size=False, write_checksum=False, write_dict_id=False) for d in (model.good, model.bad)]
    for x in out:
        data = next(t for i, t, _ in rows if i == x["doc_id"]).encode()
        a, b = (sum(len(e.compress(data[i : i + model.piece])) for i in range(0, len(data), model.piece)) for e in ends)
        assert x["difference"] == pytest.approx((b - a) / math.sqrt(len(data) * max(a, b)))
        curve = 1 / (1 + math.exp(-max(-500, min(500, model.slope * x["difference"] + model.offset))))
        xs, ys = model.steps
        want = (1 - zstd_quality.TILT) * float(np.interp(x["difference"], xs, ys)) + zstd_quality.TILT * curve
        assert x["score"] == pytest.approx(want) and x["predicted"] == int(want >= 0.3)
    assert [x["predicted"] for x in out if x["doc_id"] < 160] == [1] * 80 + [0] * 80
    assert len({x["score"] for x in out if x["doc_id"] == 501}) == 1 and sum(x["doc_id"] == 501 for x in out) == 2
    assert all(len(t) <= zstd_quality.ROWS for t in ([p for p in zstd_quality.sample(docs, labels, "doc_id", "text", "doc_id", "quality", 5, 5, 0)[0] if p[0] == y] for y in (0, 1)))
    assert {t for _, t in zstd_quality.sample(docs, labels, "doc_id", "text", "doc_id", "quality", 5, 5, 0)[0]} <= {t.encode() for t in good + bad}


def plain_scores(net, text):
    """Log probabilities of a text: every window, filter and place in loops."""
    sums, total = [0.0] * len(net.languages), 0.0
    for at in range(0, max(1, len(text)), byte_cnn.LENGTH):
        window = text[at : at + byte_cnn.LENGTH].ljust(byte_cnn.LENGTH, b"\0")
        pooled = []
        for w in byte_cnn.WIDTHS:
            for f in range(byte_cnn.FILTERS):
                best = max(sum(float(net.embed[window[p + j]] @ net.filters[w][j, :, f]) for j in range(w)) for p in range(byte_cnn.LENGTH - w + 1))
                pooled.append(max(0.0, best + float(net.bias[w][f])))
        z = [sum(h * float(net.dense[i, k]) for i, h in enumerate(pooled)) + float(net.dense_bias[k]) for k in range(len(net.languages))]
        norm = max(z) + math.log(sum(math.exp(v - max(z)) for v in z))
        weight = sum(b != 0 for b in window) + 1e-6
        sums = [s + weight * (v - norm) for s, v in zip(sums, z, strict=True)]
        total += weight
    p = [math.exp(s / total) for s in sums]
    return [x / sum(p) for x in p]


def test_forward_pass(spark):
    texts = ["lorem ipsum dolor sit amet " * 8, "żółć gęślą jaźń " * 9, "x", "αβγ δεζ " * 40]
    net = byte_cnn.train([t.encode() for t in texts], ["la", "pl", "la", "el"], epochs=3)
    numbers, sure = net.predict([t.encode() for t in texts])
    for t, n, p in zip(texts, numbers.tolist(), sure.tolist(), strict=True):
        want = plain_scores(net, t.encode())
        assert n == int(np.argmax(want)) and p == pytest.approx(max(want), abs=1e-4)
    docs = spark.createDataFrame([(1, texts[0] * 2000), (2, texts[0]), (2, texts[0])], "doc_id long, text string")
    rows = byte_cnn.identify(docs, net).collect()
    assert len(rows) == 3 and len({(r["lang_pred"], r["score"]) for r in rows if r["doc_id"] == 2}) == 1
    assert next(r["lang_pred"] for r in rows if r["doc_id"] == 1) == "la"


def test_language_sample_is_bounded_and_even(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(byte_cnn, "train", lambda texts, languages: seen.append((texts, languages)))
    rows = [(i, f"some text {i} " * (1 + i % 50), "en") for i in range(3000)] + [(5000 + i, f"ein text {i}", f"l{i % 9}") for i in range(90)]
    byte_cnn.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), rows=100)
    texts, languages = seen[0]
    n = collections.Counter(languages)
    assert len(texts) <= 100 and len(n) == 10 and n["en"] == 10 and min(n.values()) >= 4
    whole = {t.encode() for _, t, _ in rows}
    assert all(t in whole for t in texts)


def test_search_of_many_windows():
    """300,000 benchmark windows against one shard, beside a dictionary of all windows."""
    r = random.Random(5)
    vocabulary = [b"v%d" % i for i in range(3000)]
    fresh = lambda n: r.choices(vocabulary, k=n)
    items = [(str(i), fresh(309)) for i in range(1000)]
    texts = [fresh(r.randrange(5, 400)) for _ in range(400)]
    for t in texts[::3]:
        w = r.choice(items)[1]
        k = r.randrange(0, 290)
        t += w[k : k + r.randrange(8, 19)]
    block = decontam.Block(items, 10)
    assert len(block.windows) == 300_000
    where = {}
    for name, w in items:
        for k in range(300):
            where.setdefault(tuple(w[k : k + 10]), set()).add(name)
    shard = decontam.Shard.of([b" ".join(t) for t in texts], decontam.gap_of(10, 2))
    packed = shard.pack()
    spans, exact, _ = decontam.Shard.unpack(*packed, shard.counts.tolist(), decontam.gap_of(10, 2)).search(block, 2)
    got = collections.defaultdict(set)
    for t, i in exact.tolist():
        got[t].add(block.names[i])
    for n, t in enumerate(texts):
        hit = [k for k in range(len(t) - 9) if tuple(t[k : k + 10]) in where]
        assert decontam.merged([(k, k + 10) for k in hit]) == [tuple(s) for s in spans[n].tolist()]
        assert got[n] == {x for k in hit for x in where[tuple(t[k : k + 10])]}
    assert sum(map(len, got.values())) > 50


def test_checkpoints_need_a_shared_folder(monkeypatch):
    class Java:
        def sc(self):
            return self

        getCheckpointDir = sc

        def isDefined(self):
            return False

    class Session:
        class conf:  # noqa: N801
            get = staticmethod(lambda key, default=None: default)

        class sparkContext:  # noqa: N801
            master, _jsc = "spark://host:7077", Java()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.checkpoint_dir(Session)
