"""Detectors, bridging, merging, redaction and verification on small literal spans."""

import re

import pytest
from pyspark.sql import functions as F

from veilframe import model
from veilframe.functions import text as X
from veilframe.operators import detect, ocr, redact, verify
from veilframe.plans.engine import Engine
from veilframe.profile import AccountNumber, CustomPattern, Profile
from veilframe.sources import spans as sources

HEIGHT = 12.0


def spans(spark, *texts, doc=1, page=0, width=None):
    rows = [(doc, page, i, t, (72.0, 72.0 + 14 * i, 72.0 + (width or 6.0 * len(t)), 84.0 + 14 * i), 0) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, model.SPANS)


def profile(**subject):
    settings = subject.pop("detection", {})
    return Profile.model_validate({"subject": {"display_name": "Jane Corpus"} | subject, "detection": settings})


@pytest.mark.parametrize(
    ("text", "hit"),
    [
        ("Jane Corpus", True), ("JANE CORPUS", True), ("Jane Q. Corpus", True), ("Corpus, Jane", True), ("Dear Jane Corpus, hello", True), ("Jane Corpus LLC", False),
        ("invoice total due now", False), ("an", False), ("", False), ("Corpus", True), ("Jane Marble", False),
    ],
)
def test_names(spark, text, hit):
    found = detect.detect_names(spans(spark, text), profile(detection={"match_threshold": 0.85})).collect()
    assert bool(found) is hit
    assert all(r["score"] == 1.0 and r["text"] == text and r["entity_type"] == "PERSON" for r in found)


def test_single_token_alias_is_exact(spark):
    p = profile(display_name="Jo", aliases=["zz"])
    assert [r["ord"] for r in detect.detect_names(spans(spark, "Jo went", "Joanna", "a zz b"), p).orderBy("ord").collect()] == [0, 2]


def test_terms_too_short_are_left_out(spark):
    assert detect.detect_names(spans(spark, "J"), profile(display_name="J")).count() == 0


def test_accounts(spark):
    accounts = [AccountNumber(value="1234567812345678"), AccountNumber(value="99-8", preserve_last=0)]
    rows = detect.detect_accounts(spans(spark, "no 1234-5678-1234-5678 and 998", "none"), accounts).orderBy("text").collect()
    assert [(r["text"], r["preserve_last"]) for r in rows] == [("1234-5678-1234-5678", 4), ("998", 0)]
    assert rows[0]["bbox"]["x0"] == pytest.approx(72 + 6 * 3)
    assert rows[0]["bbox"]["x1"] == pytest.approx(72 + 6 * (3 + 14))
    assert rows[1]["bbox"]["x0"] == 72


def test_patterns(spark):
    patterns = [CustomPattern(name="EMP", regex="EMP-[0-9]+"), CustomPattern(name="X", regex="x+")]
    rows = detect.detect_patterns(spans(spark, "EMP-1 EMP-22 xx", "-"), patterns).collect()
    assert sorted((r["entity_type"], r["text"]) for r in rows) == [("EMP", "EMP-1"), ("EMP", "EMP-22"), ("X", "xx")]
    assert detect.detect_patterns(spans(spark, "a"), []).count() == 0


ADDRESS = "123 Main Street, Springfield, IL 62701"


@pytest.mark.parametrize(
    ("lines", "hits"),
    [
        ([ADDRESS], [0]), (["123 MAIN ST SPRINGFIELD IL 62701-1234"], [0]), (["123 Main St.", "Springfield, IL 62701"], [0, 1]), (["123 Main St.", "IL", "Springfield, IL 62701"], [0, 1, 2]),
        (["123 Main St.", " ", "Springfield, IL 62701"], [0, 2]), (["123 Main St.", "and then we went on for a long walk", "Springfield, IL 62701"], [0]), (["62701"], []), (["1,234"], []), (["9 Other Road, Elsewhere, CA 90001"], []),
    ],
)
def test_addresses(spark, lines, hits):
    found = detect.detect_addresses(spans(spark, *lines), profile(addresses=[ADDRESS]))
    assert sorted(r["ord"] for r in found.collect()) == hits


def grouped(spark, rows, window=3, column_aware=True):
    frame = spark.createDataFrame([(1, 0, i, t, (float(a), 0.0, float(b), 12.0), 0) for i, (t, a, b) in enumerate(rows)], model.SPANS)
    return sorted([x["ord"] for x in r["lines"]] for r in detect.address_groups(frame, window, column_aware).collect())


def test_groups_stop_at_another_column_and_window(spark):
    far = [("12 Main St.", 72, 200), ("Springfield, IL 62701", 400, 500)]
    assert grouped(spark, far) == [[0]]
    assert grouped(spark, far, column_aware=False) == [[0, 1]]
    many = [("12 Main St.", 0, 60)] + [("Suite 1", 0, 60)] * 5
    assert grouped(spark, many) == [[0, 1, 2, 3]]
    assert grouped(spark, many, window=0) == [[0]]
    assert grouped(spark, [("12 Main St.", 0, 60), (" ", 0, 9), ("14 Main St, IL", 0, 60)]) == [[0, 2]]


def walked(rows, window, column_aware, flags):
    """Line by line: the open group takes a line or the line may open one."""
    groups, left, seed = [], 0, None
    for i, (t, a, b) in enumerate(rows):
        candidate, goes = flags[i]
        if not t.strip():
            continue
        near = seed is not None and (not column_aware or abs((a + b) / 2 - seed[0]) <= seed[1])
        if seed is not None and left and near and goes:
            groups[-1].append(i)
            left -= 1
        elif candidate:
            groups.append([i])
            left, seed = window, ((a + b) / 2, max(b - a, 50.0))
        else:
            seed = None
    return groups


@pytest.mark.parametrize("window", [0, 1, 3, 10])
def test_groups_against_a_walk(spark, window):
    """Lines that open and go on with addresses at once make long chains."""
    import random

    from veilframe.functions import address as A

    r = random.Random(window)
    kinds = ["12 Main St.", "14 Main St, IL", "Suite 4", "Springfield, IL 62701", " ", "and then some more words than six of them", "Invoice 5", "7 Oak Lane, CA 90001"]
    rows = [(r.choice(kinds), x := r.choice((0, 0, 0, 90)), x + r.choice((30, 80, 200))) for _ in range(400)]
    flags = spark.createDataFrame([(t, i) for i, (t, _, _) in enumerate(rows)], "text string, i int")
    flags = flags.select("i", A.is_candidate(F.col("text")).alias("c"), (A.is_continuation(F.col("text")) & ~A.is_prose(F.col("text"))).alias("g")).orderBy("i").collect()
    for column_aware in (True, False):
        assert grouped(spark, rows, window, column_aware) == walked(rows, window, column_aware, [(f["c"], f["g"]) for f in flags])


def test_overlapping_matches_are_hidden_together(spark):
    s = spans(spark, "call 1234-5678-9012 now")
    patterns = [{"name": "A", "regex": "1234-5678"}, {"name": "B", "regex": "5678-9012"}]
    run = Engine(profile(custom_patterns=patterns), granularity="match").run(s)
    assert run.spans.first()["text"] == "call ██████████████ now"
    assert run.results.first()["verification_passed"]


def test_what_is_left_of_a_hit_fails_verification(spark):
    s = spans(spark, "call 1234-5678-9012 now", "x 77")
    hits = detect.detect_patterns(s, [CustomPattern(name="A", regex="1234-5678"), CustomPattern(name="B", regex="5678-9012")])
    half = s.withColumn("text", F.replace("text", F.lit("1234-5678"), F.lit("█" * 9)))
    assert [r["text"] for r in redact.exposed(half, hits, "match").collect()] == ["████-9012"]
    assert redact.exposed(redact.redact_spans(s, hits, "match"), hits, "match").count() == 0
    kept = detect.detect_accounts(s, [AccountNumber(value="12345678", preserve_last=4)])
    assert redact.exposed(redact.redact_spans(s, kept), kept).count() == 0


def tall(spark, *texts, doc=1):
    """Lines that reach into the next."""
    return spans(spark, *texts, doc=doc).withColumn("bbox", F.struct("bbox.x0", "bbox.y0", "bbox.x1", (F.col("bbox.y1") + 8).alias("y1")))


def test_a_second_pass_finds_what_the_first_left_to_another(spark):
    """An entity hit under a profile hit of another line is left in the first pass and hidden in the second."""
    p = profile(custom_patterns=[{"name": "N", "regex": "77"}], detection={"use_presidio": True, "presidio_entities": ["DATE_TIME"]})
    s = tall(spark, "x 77", "on 2024-01-02", "clean", doc=1).unionByName(tall(spark, "clean", "on 2024-01-02", doc=2)).unionByName(tall(spark, "nothing", doc=3))
    run = Engine(p).run(s)
    assert {r["doc_id"]: (r["detections"], r["safety_passes"], r["verification_passed"]) for r in run.results.collect()} == {1: (2, 1, True), 2: (1, 0, True), 3: (0, 0, True)}
    assert run.searched == [6, 3, 1]
    assert "2024" not in "".join(r["text"] for r in run.spans.collect())


def test_no_table_of_a_run_is_broadcast(spark):
    """All tables of a run grow with its documents, and their files tell too little of their size in memory."""
    p = profile(custom_patterns=[{"name": "N", "regex": "77"}], detection={"use_presidio": True, "presidio_entities": ["DATE_TIME"]})
    s = tall(spark, "x 77", "on 2024-01-02", "clean")
    run = Engine(p, guards=True).run(s)
    again = detect.merged(run.detections.drop("pass_num"))
    for df in (run.results, again, redact.redact_spans(s, again), redact.exposed(s, again), redact.guarded(again, s)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_addresses_are_looked_for_again_around_changes(spark):
    p = profile(addresses=[ADDRESS], custom_patterns=[{"name": "N", "regex": "77"}])
    s = spans(spark, "123 Main St.", "Springfield, IL 62701", "x 77", "neutral")
    run = Engine(p).run(s)
    assert [r["text"].strip("█") for r in run.spans.orderBy("ord").collect()] == ["", "", "", "neutral"]
    assert run.results.first()["verification_passed"] and run.searched[1] < run.searched[0]


def test_boxes_meet_in_bands(spark):
    import random

    r = random.Random(2)
    box = lambda: (x := r.uniform(0, 300), y := r.uniform(-50, 300), x + r.choice((0, 20, 90)), y + r.choice((0, 5, 12, 100)))
    rows = [(r.randrange(2), r.randrange(2), i, "t", "E", 1.0, box(), 0, r.choice(("profile", "entity")), 0, 1) for i in range(300)]
    hits = spark.createDataFrame(rows, model.DETECTIONS)
    over = lambda a, b: a[0] < b[2] and a[2] > b[0] and a[1] < b[3] and a[3] > b[1]
    want = {x[2] for x in rows if x[8] == "profile" or not any(y[8] == "profile" and y[:2] == x[:2] and over(x[6], y[6]) for y in rows)}
    assert {x["ord"] for x in detect.merged(hits).collect()} == want


def test_line_detectors_are_one_scan(spark, sf):
    from veilframe.plans import queries as q

    found = detect.line_hits(q.spans(spark, sf), q.PROFILE, True, detect.DEFAULT_ENTITIES)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert (plan.count("FileScan"), plan.count("Exchange"), plan.count("+- ArrowEvalPython")) == (1, 0, 1)


def test_functions_reach_workers_without_the_package(spark, tmp_path):
    """A process that has only the shipped file can run what plans pickle by name."""
    import subprocess
    import sys

    from pyspark.serializers import CloudPickleSerializer

    from veilframe import cluster
    from veilframe.functions import fuzzy

    cluster.ship(spark)
    [package] = [f for f in spark.sparkContext._python_includes if f.startswith("veilframe_pkg")]
    from pyspark import SparkFiles

    (tmp_path / "f").write_bytes(CloudPickleSerializer().dumps(fuzzy.partial_ratio))
    code = "import pickle, sys; sys.path.insert(0, sys.argv[1]); print(pickle.load(open(sys.argv[2], 'rb'))('ab', 'xabx'))"
    done = subprocess.run([sys.executable, "-c", code, f"{SparkFiles.getRootDirectory()}/{package}", str(tmp_path / "f")], capture_output=True, text=True, cwd=tmp_path, env={"PATH": "/usr/bin:/bin"})
    assert done.stdout.strip() == "100.0", done.stderr


def test_entities(spark):
    s = spans(spark, "mail a.b@c.org or +1 (222) 555-1234", "card 4111111111111111 not 4111111111111112", "ssn 123-45-6789 on 2024-01-02 from 10.0.0.1")
    found = {(r["entity_type"], r["text"]) for r in detect.detect_entities(s).collect()}
    assert {("EMAIL_ADDRESS", "a.b@c.org"), ("PHONE_NUMBER", "+1 (222) 555-1234"), ("CREDIT_CARD", "4111111111111111"), ("US_SSN", "123-45-6789"), ("DATE_TIME", "2024-01-02"), ("IP_ADDRESS", "10.0.0.1")} <= found
    assert ("CREDIT_CARD", "4111111111111112") not in found
    assert detect.detect_entities(s, ["DATE_TIME"], threshold=0.9).count() == 0


def test_profile_wins_where_boxes_overlap(spark):
    s = spans(spark, "a@b.org 77", "c@d.org")
    p = detect.detect_patterns(s, [CustomPattern(name="N", regex="77")])
    merged = detect.merge(p.unionByName(p), detect.detect_entities(s, ["EMAIL_ADDRESS"]))
    assert sorted((r["entity_type"], r["ord"]) for r in merged.collect()) == [("EMAIL_ADDRESS", 1), ("N", 0), ("N", 0)]


def test_redaction(spark):
    s = spans(spark, "id 1234-5678 end", "x 77 y", "clean")
    hits = detect.detect_accounts(s, [AccountNumber(value="12345678", preserve_last=4)]).unionByName(detect.detect_patterns(s, [CustomPattern(name="N", regex="77")]))
    assert [r["text"] for r in redact.redact_spans(s, hits).orderBy("ord").collect()] == ["id ████-5678 end", "██████", "clean"]
    assert [r["text"] for r in redact.redact_spans(s, hits, "match").orderBy("ord").collect()] == ["id ████-5678 end", "x ██ y", "clean"]


def test_guards(spark):
    s = spans(spark, "a", "b", "c 77", width=100)
    hits = detect.detect_patterns(s, [CustomPattern(name="N", regex="77")])
    big = hits.withColumn("bbox", F.struct(F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), F.lit(600.0).alias("x1"), F.lit(700.0).alias("y1")))
    tall = hits.withColumn("bbox", F.struct(F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), F.lit(1.0).alias("x1"), F.lit(49.0).alias("y1")))
    assert [r["rejected"] for r in redact.guarded(hits.unionByName(big).unionByName(tall), s).collect()].count(None) == 1
    assert {r["rejected"] for r in redact.guarded(big.unionByName(tall), s).collect()} == {"area", "height"}
    assert redact.redact_guarded(s, big).where("hits > 0").count() == 0


def test_kept_suffix_is_no_survivor(spark):
    s = spans(spark, "ends 5678", "other 9999")
    originals = detect.detect_accounts(spans(spark, "1234-5678"), [AccountNumber(value="12345678")])
    left = verify.drop_kept_suffixes(detect.detect_patterns(s, [CustomPattern(name="D", regex="[0-9]{4}")]), originals)
    assert [r["text"] for r in left.collect()] == ["9999"]


LABELS = ["Name: Jane Corpus", f"Address: {ADDRESS}", "Phone: +1 (222) 555-1234", "Email: jane@corpus.org", "SSN: 123-45-6789", "Account: 1234-5678-1234-5678", "neutral line", "total 12.50"]


def test_corpus_of_documents_comes_clean(spark):
    p = profile(addresses=[ADDRESS], phones=["+1 (222) 555-1234"], emails=["jane@corpus.org"], ssns=["123-45-6789"], account_numbers=[{"value": "1234567812345678", "preserve_last": 0}])
    docs = spans(spark, *LABELS, doc=0)
    for d in range(1, 12):
        docs = docs.unionByName(spans(spark, *LABELS[d % 3 :], *LABELS[: d % 3], doc=d))
    run = Engine(p, contacts=True).run(docs)
    results = run.results.collect()
    assert len(results) == 12 and all(r["verification_passed"] and r["survivors"] == 0 and 6 <= r["detections"] <= 7 for r in results)
    text = "\n".join(r["text"] for r in run.spans.collect())
    assert not any(x in text for x in ("Jane Corpus", "Main Street", "555-1234", "jane@", "6789", "5678"))
    assert "neutral line" in text
    assert run.unsettled.count() == 0


def test_ocr_words(spark):
    rows = [
        (1, 0, 0, "Jane", "95", 300.0, 300.0, 120.0, 30.0), (1, 0, 1, "low", "59", 0.0, 0.0, 9.0, 30.0), (1, 0, 2, " ", "99", 0.0, 0.0, 9.0, 30.0), (1, 0, 3, "n", "x", 0.0, 0.0, 9.0, 30.0),
        (1, 0, 4, "huge", "95", 0.0, 0.0, 2550.0, 1650.0), (1, 0, 5, "ok", "60", 0.0, 0.0, 50.0, 34.0),
    ]
    raw = spark.createDataFrame(rows, model.OCR_RAW)
    words = ocr.ocr_words(raw).orderBy("ord").collect()
    assert [w["text"] for w in words] == ["Jane", "ok"]
    assert words[0]["bbox"]["x0"] == pytest.approx(72) and words[0]["bbox"]["x1"] == pytest.approx(100.8)
    assert tuple(ocr.low_confidence(raw).first()[2:]) == (3, 1)
    found = ocr.detections(ocr.matches(ocr.ocr_words(raw), profile())).collect()
    assert [(r["text"], r["score"]) for r in found] == [("Jane", 0.95)]


def test_batch_goes_on_after_a_bad_document(spark):
    rows = [(1, "/a.txt", "x 77", False, None, None), (2, "/b.pdf", None, False, "extraction", "document is encrypted"), (3, "/c.txt", "", True, None, None)]
    opened = spark.createDataFrame(rows, "doc_id long, path string, text string, has_images boolean, error_kind string, error string")
    run = Engine(profile(custom_patterns=[{"name": "N", "regex": "77"}])).run_batch(opened, allow_ocr=False)
    assert {(r["doc_id"], r["category"]) for r in run.errors.collect()} == {(2, "ENCRYPTED"), (3, "OCR_REQUIRED")}
    assert [(r["doc_id"], r["detections"]) for r in run.results.collect()] == [(1, 1)]


def test_detection_has_one_schema(spark):
    s = spans(spark, "x")
    frames = [detect.detect_names(s, profile()), detect.detect_accounts(s, []), detect.detect_entities(s), detect.detect_addresses(s, profile(addresses=[ADDRESS])), detect.detect_contacts(s, profile(phones=["1"]))]
    assert all(f.columns == detect.COLUMNS for f in frames)


def test_fuzzy_names_of_all_lines_against_brute_force(spark, sf):
    """Every line of the table, and lines with the name bent in several ways, scored window by window."""
    from veilframe.functions import fuzzy
    from veilframe.plans import queries as q

    lines = [r["text"] for r in q.spans(spark, sf).where("length(text) < 600").select("text").distinct().collect()]
    lines += ["To Hein Therand, here", "hein therean", "Thereand Hein", "and hein x thereand", "Hei nThereand", "x" * 300 + "heinthereand", "Mr. HEIN  THEREAND of it", "here and in there", "Thereand, Hein Inc", "hein hein hein hein hein hein hein"]
    rows = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    found = {r["doc_id"] for r in detect.detect_names(sources.lines(rows, "doc_id", "text"), q.PROFILE).collect()}
    terms = ["hein thereand", "thereand, hein"]
    want = set()
    for i, t in enumerate(lines):
        low = t.lower()
        words = re.findall(r"\w+", low)
        if words and words[-1] in X.CORPORATE:
            continue
        fits = any(len(low.strip()) >= len(x) / 2 and max(fuzzy.token_set_ratio(x, low), fuzzy.partial_ratio(x, low)) >= 85 for x in terms)
        if fits or "clown" in words:
            want.add(i)
    assert found == want and len(want) >= 5


def test_an_address_is_scored_once(monkeypatch):
    """Texts that repeat, and those that the scan rules out, cost no exact score; the scores are those of the long way."""
    import random

    from veilframe.functions import fuzzy

    r = random.Random(5)
    near = ["".join(c for c in ADDRESS.lower().replace(",", "") if r.random() < 0.95) + r.choice(("", " tel 5", " and a way to go")) for _ in range(60)]
    texts = [*near, *("%d far away road" % i * 4 for i in range(60)), "x", ""]
    wanted = [ADDRESS.lower().replace(",", ""), "1 far away road"]
    needles = [fuzzy.Needle(w, 0.85) for w in wanted]
    want = {t: next((s / 100 for w in wanted if (s := fuzzy.partial_ratio(w, t)) >= 85), None) for t in texts}
    scored, real = [], fuzzy.Needle.partial
    monkeypatch.setattr(fuzzy.Needle, "partial", lambda n, t: scored.append(t) or real(n, t))
    assert detect.first_fits(texts, needles) == want
    assert 20 < sum(v is not None for v in want.values()) < len(want) and len(scored) < 2 * len(texts)
