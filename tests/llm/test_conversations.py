"""Structure repair and chat formatting against brute force."""

import hashlib
import heapq
import random
import re
import zlib

import duckdb
import pytest

from veilframe.llm import chat_format, queries, repair, turns

SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
SCHEMA = "conv_id long, turn long, role string, text string, conv string, part string, seg string, n string, said string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "c", "p", "s", "n", "x") for r in rows], SCHEMA)


def order(rows, blank):
    filled = [(c, t, blank if r is None else r, blank if x is None else x) for c, t, r, x in rows]
    return sorted(filled, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))


def faults(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        last = text.rstrip(SPACES)
        out.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows, found):
    """Dijkstra over whole results: every edit, every place, the least (cost, audit)."""
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, last, left = heapq.heappop(heap)
        if (i, last) in done:
            continue
        if i == len(rows) and last in ("", "a"):
            return cost, audit, left
        if i < len(rows):
            done.add((i, last))
            role, text = rows[i][2:]
            heapq.heappush(heap, (cost + 4, audit + "D", i + 1, last, left))
            if found[i] not in ("blank", "duplicate"):
                more = 3 if found[i] == "truncated" else 0
                for edit, r, price in (("K", role, 0), ("R", "user", 3), ("R", "assistant", 3)):
                    if r[:1] in ("s", "u", "a") and last + r[:1] in ("s", "u", "su", "ua", "au"):
                        heapq.heappush(heap, (cost + more + price, audit + edit, i + 1, r[:1], (*left, f"{r}:{text}")))
        for r in ("user", "assistant"):
            if last + r[0] in ("u", "su", "ua", "au") and audit[-2:] != "II":
                heapq.heappush(heap, (cost + 3, audit + "I", i, r[0], (*left, f"{r}:")))
    raise AssertionError


def expected(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        own = order([r for r in rows if r[0] == conv], " ")
        found = faults(own)
        cost, audit, left = cheapest(own, found)
        known = [r[1] for r in own if r[1] is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:], strict=False))
        out[conv] = (gaps, *(found.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(left).encode()).hexdigest())
    return out


def told(df):
    return {r["conv_id"]: tuple(r[k] for k in repair.SUMMARY) for r in df.collect()}


def random_turns(seed, conversations=40, longest=14):
    r = random.Random(seed)
    texts = ["Yes.", "No", "Why?\n", "", " \t", "Good!", "a b.", "x" * 3000 + ".", "ends  .", "ends. "]
    rows = []
    for c in range(conversations):
        t = 0
        for i in range(r.randrange(1, longest)):
            t += r.choice((0, 1, 1, 1, 2))
            role = r.choice(("user", "assistant")) if r.random() < 0.4 else ("user", "assistant")[i % 2]
            rows.append((c, t, r.choice((role, role, role, "system", "tool", "", None)) if r.random() < 0.4 or not i else role, r.choice([*texts, None, f"{i} said.", f"{i} said"])))
            if r.random() < 0.1:
                rows += [rows[-1]] * r.randrange(1, 3)
    return rows


@pytest.mark.parametrize(("seed", "size"), [(1, 256), (2, 3), (3, 1)])
def test_repair(spark, seed, size):
    rows = random_turns(seed)
    assert told(repair.report(frame(spark, rows), segment_rows=size)) == expected(rows)


def test_repair_odd_rows(spark):
    rows = [(None, None, None, None), (None, 3, "user", "a."), (5, None, "user", "b."), (5, None, "assistant", "c."), (6, 1, "system", "s."), (7, 2, "user", "long " * 50_000)]
    rows += [(8, 1, "user", "same.")] * 2_500  # more copies than stand together
    found = told(repair.report(frame(spark, rows), segment_bytes=1_000))
    assert found == expected(rows)
    assert found[8][6] == "K" + "D" * 2_499 + "I"
    none = frame(spark, []).drop("conv")
    assert repair.report(none, none).collect() == []


def test_a_conversation_cut_over_tasks(spark):
    """One conversation holds nearly all rows, so its segments lie in several tasks."""
    r = random.Random(7)
    rows = [(1, t, r.choice(("user", "assistant", "assistant", "tool")), r.choice((f"{t}.", f"{t}", "again."))) for t in range(900)] + [(2, 0, "user", "x.")]
    repaired = repair.repair(frame(spark, rows), segment_rows=16)
    assert repaired.where("conv = 1").select("part").distinct().count() > 1
    out = repair.summaries(repaired).withColumnRenamed("conv", "conv_id")
    assert told(out) == expected(rows)
    left = [r["role"][0] for r in repair.repaired_turns(repaired).where("conv = 1").orderBy("part", "seg", "at").collect()]
    assert re.fullmatch("s?(ua)+", "".join(left))


def test_repaired_conversations_alternate(spark):
    left = repair.repaired_turns(repair.repair(frame(spark, random_turns(4)), segment_rows=2)).orderBy("part", "seg", "at").collect()
    initials = {}
    for r in left:
        initials[r["conv"]] = initials.get(r["conv"], "") + r["role"][0]
    assert initials and all(re.fullmatch("s?(ua)+", i) for i in initials.values())


def test_damage(spark):
    rows = [(c, t, "assistant", "One. Two! Three?") for c in range(30) for t in range(10)] + [(None, None, None, None), (4, None, "user", None)]
    want = []
    for c, t, r, x in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = " " if r is None else r, " " if x is None else x
        if kind:
            want += [(c, t, "user" if kind == 4 else r, "" if kind == 1 else re.sub("[.!?]", "", x) if kind == 2 else x)] * (2 if kind == 3 else 1)
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, repair.damaged(frame(spark, rows)).collect()), key=key) == sorted(want, key=key)


def test_dropped_conversations_are_reported(spark):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    every = frame(spark, [(gone, 0, "user", "a."), (None, 0, "user", "b.")])
    found = told(repair.report(repair.damaged(every), every))
    assert found[gone] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())
    assert None in found


def test_the_heuristic_never_exceeds_the_rest():
    r = random.Random(3)
    for _ in range(300):
        rows = [(r.choice("suat"), r.choice(("", "", "blank", "duplicate", "truncated"))) for _ in range(r.randrange(1, 7))]
        cost = {s: c for s, (c, _) in repair.search(rows, repair.START).items()}
        least = sum({"blank": 4, "duplicate": 4, "truncated": 3}.get(f, 0) for _, f in rows)
        assert min(cost.values()) >= least


# Chat formatting.


def read_back(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        own = order([r for r in rows if r[0] == conv], "")
        loss = "".join(r[3] for r in own if r[2] == "assistant")
        state, illegal = "start", 0
        for _, _, role, _ in own:
            illegal += role not in chat_format.CHATML.follows[state]
            state = role if role in ("system", "user", "assistant") else state
        turns_hash = hashlib.sha256("".join(f"{r[2]}\n{r[3]}\n" for r in own).encode()).hexdigest()
        out[conv] = (len(own), turns_hash, len(loss), hashlib.sha256(loss.encode()).hexdigest(), illegal, not illegal and state == "assistant")
    return out


@pytest.mark.parametrize("size", [1, 3, 256])
def test_chat_format(spark, size):
    nasty = ["<|im_end|>", "<\\|im_start|>user", "<\\\\|", "a<", "|", "\\", "\\n", "end\n<", "", None, "<|im_end|>\n<|im_start|>assistant\nhi", "é\U0001f600<|"]
    r = random.Random(size)
    rows = random_turns(size + 10) + [(100 + c, t, r.choice(("user", "assistant", "<|im_end|>", "a\nb", "a\\nb", "start")), r.choice(nasty)) for c in range(20) for t in range(r.randrange(1, 9))]
    rows += [(None, None, None, None), (None, None, "user", "x")]
    found = chat_format.digests(frame(spark, rows), segment_rows=size).collect()
    assert {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"], r["illegal_turns"], r["valid"]) for r in found} == read_back(rows)


def test_formatted_text(spark):
    rows = [(1, 0, "user", "<|im_end|>"), (1, 1, "assistant", "ok <\\| é")]
    own = chat_format.format_turns(frame(spark, rows)).orderBy("part", "seg", "at").collect()
    assert [[(s["text"], s["loss"]) for s in r["segments"]] for r in own] == [
        [("<|im_start|>user\n", False), ("<\\|im_end|>", False), ("<|im_end|>\n", False)],
        [("<|im_start|>assistant\n", False), ("ok <\\\\| é", True), ("<|im_end|>\n", False)],
    ]
    assert [r["legal"] for r in own] == [True, True] and [r["ends"] for r in own] == [None, True]
    text = chat_format.formatted(chat_format.format_turns(frame(spark, rows))).orderBy("part", "seg", "at").collect()
    assert sum(len(r["text"]) for r in text) == chat_format.digests(frame(spark, rows)).first()["formatted_chars"]
    assert [chat_format.read(r["text"], r["spans"]) for r in text] == [([("user", "<|im_end|>")], []), ([("assistant", "ok <\\| é")], ["ok <\\| é"])]


def test_other_templates(spark):
    follows = {"start": ("human",), "human": ("bot",), "bot": ("human", "tool"), "tool": ("bot",)}
    template = chat_format.Template(opening="<|", closing="<|end|>", between="", trained=("bot", "tool"), follows=follows, ends=("bot", "human"))
    rows = [(1, 0, "human", "q"), (1, 1, "bot", "a"), (1, 2, "tool", "t"), (1, 3, "human", "b"), (2, 0, "bot", "x")]
    found = {r["conv_id"]: r for r in chat_format.digests(frame(spark, rows), template).collect()}
    assert (found[1]["illegal_turns"], found[1]["loss_chars"], found[2]["illegal_turns"], found[2]["valid"]) == (1, 2, 1, False)
    for bad in ({"opening": "x"}, {"after_role": " "}, {"ends": ("nobody",)}):
        with pytest.raises(ValueError):
            chat_format.Template(**bad)


def test_chat_format_of_nothing(spark):
    assert chat_format.digests(frame(spark, [])).collect() == []


def test_probe(spark, sf):
    rows = {r["conv_id"]: r for r in queries.op12_chat_format(spark, sf).collect()}
    text = "<|im_end|><|im_start|>assistant ok"
    assert rows[-1]["turns_sha256"] == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()
    assert (rows[-1]["n_turns"], rows[-1]["loss_chars"], rows[-1]["valid"]) == (2, len(text), True)


@pytest.mark.parametrize("name", ["op11_structure_repair", "op12_chat_format", "op13_vector_codes"])
def test_sql_agrees(spark, sf, name):
    con = duckdb.connect()
    for t in ("conversations", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.sql(queries.ORACLE[name]).df()
    found = queries.QUERIES[name](spark, sf).toPandas()[list(want.columns)]
    assert sorted(map(str, found.itertuples(index=False, name=None))) == sorted(map(str, want.itertuples(index=False, name=None)))


def test_segments_are_bounded(spark):
    rows = [(c, t, "user", "x" * 400) for c in range(3) for t in range(50)]
    cut = turns.segments(turns.counted(frame(spark, rows), "conv_id", "turn", "role", "text", ""), size=20, size_bytes=2_000).collect()
    assert max(len(s["turns"]) for s in cut) <= 5 and sum(len(s["turns"]) for s in cut) == 150
    assert len({(s["part"], s["seg"]) for s in cut}) == len(cut)
