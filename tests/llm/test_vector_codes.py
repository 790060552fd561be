"""Product codes against plain Lloyd in integers."""

import hashlib
import math
import random

import numpy as np
import pytest

from veilframe.llm import queries, vector_codes

SCHEMA = "vec_id long, embedding array<float>, label int, id string, code string, vector string, n string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "i", "c", "v", "n") for r in rows], SCHEMA)


def brute(rows, parts=16, entries=64, rounds=2):
    """{id: (code, error)} and the codebooks."""
    good = [(i, np.array([math.floor(256 * float(np.float32(x))) for x in v])) for i, v, _ in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    good.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1].tolist()))
    x = np.array([v for _, v in good]).reshape(len(good), parts, -1)
    books = x[:entries].transpose(1, 0, 2).copy()

    def assign():
        d = ((x[:, :, None] - books[None]) ** 2).sum(3)
        return d.argmin(2), d.min(2).sum(1)

    for _ in range(rounds):
        own = assign()[0]
        for p in range(parts):
            for e in range(books.shape[1]):
                if (m := own[:, p] == e).any():
                    books[p, e] = [int(s) // int(m.sum()) for s in x[m, p].sum(0)]
    own, error = assign()
    return [(i, bytes(c.astype(np.uint8)).hex(), int(e)) for (i, _), c, e in zip(good, own, error, strict=True)], books


def grid(n, seed, steps=4, length=32):
    """Few distinct values, so very many distances tie."""
    r = random.Random(seed)
    return [(i, [r.randrange(-steps, steps) / 256 * r.choice((1, 1, 40)) for _ in range(length)], r.choice((1, 2, None))) for i in range(n)]


@pytest.mark.parametrize(("seed", "entries", "rounds"), [(1, 64, 2), (2, 30, 4), (3, 7, 3)])
def test_codes(spark, seed, entries, rounds):
    rows = grid(700, seed)
    codes = vector_codes.encode(frame(spark, rows), entries=entries, rounds=rounds)
    want, books = brute(rows, entries=entries, rounds=rounds)
    assert sorted((r["id"], r["code"], r["error"]) for r in codes.rows.collect()) == want
    assert (codes.codebooks == books).all()
    sums = {}
    for (_, _, error), (_, _, label) in zip(want, rows, strict=True):
        sums[label] = sums.get(label, 0) + error
    assert {(r["id"], r["label_error"]) for r in vector_codes.label_errors(codes).collect()} == {(i, sums[label]) for i, _, label in rows}


def test_bounds_save_distances():
    """On clustered vectors most groups are passed over, and the assignment is still the brute-force one."""
    r = np.random.default_rng(5)
    centres = r.integers(-4000, 4000, (64, 4, 8))
    x = centres[r.integers(0, 64, 3000)] + r.integers(-60, 60, (3000, 4, 8))
    entries = x[:64].transpose(1, 0, 2).copy()
    group = vector_codes.groups_of(entries)
    own, near, far = vector_codes.first_assignment(x, entries, group)
    asked = 0
    for _ in range(3):
        sums, counts = np.zeros(entries.shape, np.int64), np.zeros(entries.shape[:2], np.int64)
        vector_codes.tallies(x, own, sums, counts)
        then = np.where(counts[..., None] > 0, sums // np.maximum(counts, 1)[..., None], entries)
        move = vector_codes.Move(then, np.sqrt(((then - entries) ** 2).sum(2)) * (1 + 1e-6) + 1e-6)
        asked += vector_codes.reassign(x, own, near, far, move, group)
        entries = then
        want = np.stack([vector_codes.squares(x[:, p], entries[p]).argmin(1) for p in range(4)], 1)
        assert (own == want).all()
        for p in range(4):
            roots = np.sqrt(vector_codes.squares(x[:, p], entries[p]))
            assert (near[:, p] >= roots[np.arange(3000), own[:, p]] * (1 - 1e-9)).all()
            roots[np.arange(3000), own[:, p]] = np.inf
            assert (far[:, p] <= vector_codes.least_in_groups(roots, group[p], far.shape[2])).all()
    assert asked < 0.5 * 3 * 3000 * 4 * 64


def test_odd_rows(spark):
    rows = grid(90, 4)
    odd = [(200, None, 1), (201, [None] * 32, 1), (202, [float("nan")] * 32, 1), (203, [float("inf")] + [0.0] * 31, 2), (7, rows[7][1], 5), (7, rows[8][1], 5), (None, rows[3][1], 9)]
    other = [(300, [0.5] * 16, 1), (301, [], 4), (302, [1e30] * 32, 4), (303, [0.1] * 5, None)]
    codes = vector_codes.encode(frame(spark, rows + odd + other))
    found = codes.rows.collect()
    want, books = brute(rows + odd)
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted([(r["id"], r["code"], r["error"]) for r in found if r["code"]], key=key) == sorted(want, key=key)
    assert sorted(r["id"] for r in found if r["code"] is None) == [300, 301, 302, 303]
    assert (codes.codebooks == books).all()
    assert vector_codes.label_errors(codes).count() == len(found)


@pytest.mark.parametrize("rows", [[], [(1, None, 1)], [(1, [], 1)]])
def test_nothing_to_encode(spark, rows):
    codes = vector_codes.encode(frame(spark, rows))
    assert [r["code"] for r in codes.rows.collect()] == [None] * (rows == [(1, [], 1)])
    assert codes.digest() == hashlib.sha256().hexdigest()


def test_fewer_rows_than_entries(spark):
    rows = grid(5, 6)
    codes = vector_codes.encode(frame(spark, rows))
    want, books = brute(rows)
    assert sorted((r["id"], r["code"], r["error"]) for r in codes.rows.collect()) == want and codes.codebooks.shape == books.shape


def test_decode(spark):
    rows = grid(40, 8)
    codes = vector_codes.encode(frame(spark, rows))
    back = {r["id"]: r["decoded"] for r in vector_codes.decode(codes.rows, codes.codebooks).collect()}
    whole = {i: [math.floor(256 * float(np.float32(x))) for x in v] for i, v, _ in rows}
    errors = {r["id"]: r["error"] for r in codes.rows.collect()}
    for i, v in back.items():
        assert sum((a - round(256 * b)) ** 2 for a, b in zip(whole[i], v, strict=True)) == errors[i]


def test_indexes_have_two_digits(spark):
    with pytest.raises(ValueError):
        vector_codes.encode(frame(spark, []), entries=257)


def test_query(spark, sf):
    rows = queries.op13_vector_codes(spark, sf).collect()
    assert all(len(r["code"]) == 32 for r in rows) and len({r["codebooks_sha256"] for r in rows}) == 1
