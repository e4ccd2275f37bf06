"""Hard negatives and vector codes against brute force."""

import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from filingscope.llm import hard_negatives
from filingscope.llm.hard_negatives import Best, Side, mine, rotation, search
from filingscope.llm.vector_codes import Cells, compress

NAN, INF = float("nan"), float("inf")


def whole(v):
    return [int(np.floor(256 * x)) for x in v]


def brute_negatives(rows):
    """All scores of all pairs; rows are (id, label, vector)."""
    out = []
    for a, la, va in rows:
        if a % 100:
            continue
        score = sorted((-int(np.dot(whole(va), whole(v))), i, la == lab) for i, lab, v in rows if i != a)
        for p, pos, _ in [x for x in score if x[2]][:5]:
            hits = [(s, n) for s, n, same in score if not same and -80 * p <= -100 * s <= -100 * p][:5]
            out += [(a, pos, r, n, -p, -s) for r, (s, n) in enumerate(hits, 1)]
    return sorted(out)


def mined(df):
    return sorted(map(tuple, mine(df, F.col("vec_id") % 100 == 0).collect()))


def vectors_of(n, seed=3, width=12, labels=4, copies=0):
    rng = np.random.default_rng(seed)
    data = np.round(rng.normal(size=(n, width)) + 0.6, 2)
    data[: copies] = data[0]  # ties
    return [(i, int(x), v.tolist()) for i, (x, v) in enumerate(zip(rng.integers(0, labels, n), data))]


@pytest.mark.parametrize("copies", [0, 40])
def test_negatives_as_brute_force(spark, monkeypatch, copies):
    rows = vectors_of(450, copies=copies)
    df = spark.createDataFrame([(i, lab, v, "x", 1) for i, lab, v in rows], "vec_id long, label int, embedding array<double>, id string, vector int")
    want = brute_negatives(rows)
    assert want and mined(df) == want
    monkeypatch.setattr(hard_negatives, "BLOCK", 64)  # several blocks and groups
    monkeypatch.setattr(hard_negatives, "STEP_ROWS", 16)
    monkeypatch.setattr(hard_negatives, "STEP_ANCHORS", 2)
    assert mined(df) == want
    monkeypatch.setattr(hard_negatives, "principal", lambda *_: None)  # without a rotation
    assert mined(df) == want


def test_rows_that_take_no_part_in_mining(spark):
    kind = "vec_id long, label int, embedding array<double>"
    good = vectors_of(120)
    rest = [(None, 1, good[0][2]), (300, None, good[0][2]), (301, 1, None), (302, 1, [NAN] * 12), (303, 1, [INF] * 12), (304, 1, [None] * 12), (305, 1, [1e9] * 12), (306, 1, good[5][2] + [1.0]), (307, 1, [])]
    df = spark.createDataFrame(good + rest, kind)
    assert mined(df) == brute_negatives(good)
    assert mined(df.limit(0)) == [] and mined(df.where("vec_id % 100 <> 0")) == []
    assert mined(spark.createDataFrame([(0, 1, [])] * 3, kind)) == []
    again = spark.createDataFrame(good + [(i, lab + 1, v) for i, lab, v in good], kind)  # a larger label of the same id stands back
    assert mined(again) == brute_negatives(good)


def test_pairs_are_discarded_early(monkeypatch):
    rng = np.random.default_rng(1)
    data = np.floor(256 * rng.normal(size=(3000, 32)) * 0.7 ** np.arange(32)).astype(np.int64) @ np.linalg.qr(rng.normal(size=(32, 32)))[0]
    data = np.floor(data).astype(np.int64)
    turn = rotation((data.T @ data).astype(float))
    ids, labels = np.arange(3000), np.zeros(3000, dtype=np.int64)
    rows = Side.of(ids, labels, data, turn)
    verified = []
    add = Best.add
    monkeypatch.setattr(Best, "add", lambda self, slot, i, v: (verified.append(len(slot)), add(self, slot, i, v))[1])
    band = np.full((50, 1), INF)
    found = search(rows.part(slice(0, 50)), rows, -band, band, 5, True)
    product = data[:50] @ data.T
    product[np.arange(50), np.arange(50)] = -(1 << 60)
    order = np.lexsort((np.broadcast_to(ids, product.shape), -product))[:, :5]
    assert (found.id == order).all() and (found.score == np.take_along_axis(product, order, 1)).all()
    assert sum(verified) < 0.05 * product.size


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 2**32 - 1), st.integers(1, 70), st.integers(0, 6), st.sampled_from([1, 20, 10**6]))
def test_cells_find_the_nearest_entry(seed, entries, width, size):
    rng = np.random.default_rng(seed)
    book, parts = rng.integers(-size, size + 1, (entries, width)), rng.integers(-2 * size, 2 * size + 1, (50, width))
    cells = Cells(book)
    exact = ((parts[:, None] - book[None]) ** 2).sum(axis=2)
    lower, upper = cells.bounds(parts)
    assert (lower <= exact).all() and (exact <= upper).all()
    index, off = cells.nearest(parts)
    assert (index == exact.argmin(axis=1)).all() and (off == exact.min(axis=1)).all()


def test_few_entries_are_compared_exactly():
    rng = np.random.default_rng(2)
    data = np.floor(256 * rng.normal(size=(2000, 4))).astype(np.int64)
    lower, upper = Cells(data[:64]).bounds(data)
    assert (lower <= upper.min(axis=1, keepdims=True)).mean() < 0.2


def brute_codes(rows, parts=16):
    """Rows are (id, label, vector) of one width, ids distinct."""
    rows = sorted(rows)
    data = np.array([whole(v) for _, _, v in rows])
    book, width = data[:64].copy(), data.shape[1]
    cuts = [(j * width // parts, (j + 1) * width // parts) for j in range(parts)]
    for last in (False, False, True):
        new, code, error = book.copy(), [], 0
        for lo, hi in cuts:
            d = ((data[:, None, lo:hi] - book[None, :, lo:hi]) ** 2).sum(axis=2)
            at = d.argmin(axis=1)
            code.append(at)
            error = error + d.min(axis=1)
            for e in set(at.tolist()):
                new[e, lo:hi] = [sum(c) // len(c) for c in data[at == e, lo:hi].T.tolist()]
        if not last:
            book = new
    sha = hashlib.sha256(",".join(str(x) for lo, hi in cuts for x in book[:, lo:hi].ravel().tolist()).encode()).hexdigest()
    total = {}
    for (_, lab, _), e in zip(rows, error.tolist()):
        total[lab] = total.get(lab, 0) + e
    return sorted((i, "".join(f"{c[n]:02x}" for c in code), int(error[n]), total[lab], sha) for n, (i, lab, _) in enumerate(rows))


@pytest.mark.parametrize(("n", "width"), [(300, 32), (40, 16), (100, 20), (1, 64)])
def test_codes_as_brute_force(spark, n, width):
    rows = [(i, lab if lab else None, v) for i, lab, v in vectors_of(n, width=width, copies=min(n, 9))]
    df = spark.createDataFrame([(i, lab, v, "x", 2) for i, lab, v in rows], "vec_id long, label int, embedding array<double>, code string, error int").repartition(5)
    assert sorted(map(tuple, compress(df).collect())) == brute_codes(rows)


def test_rows_without_a_code(spark, monkeypatch):
    kind = "vec_id long, label int, embedding array<double>"
    good = vectors_of(80, width=16)
    drop = [(300, 1, None), (301, 1, [NAN] * 16), (302, 1, [-INF] * 16), (303, 1, [None] * 16), (304, 1, [1e30] * 16)]
    found = {r.vec_id: r for r in compress(spark.createDataFrame(good + drop + [(305, 99, [1.0]), (306, 99, [])], kind)).collect()}
    assert sorted(tuple(r) for i, r in found.items() if i < 300) == brute_codes(good)
    assert set(found) == {*range(80), 305, 306} and found[305][1:4] == (None, None, None)
    assert compress(spark.createDataFrame([], kind)).collect() == []
    twice = compress(spark.createDataFrame(good[:30] + good[:30] + [(None, 1, good[2][2])], kind)).collect()
    assert len(twice) == 61 and all(r.code for r in twice)
    monkeypatch.setattr("filingscope.llm.components.HOT_ROWS", 3)  # hot labels
    assert sorted(map(tuple, compress(spark.createDataFrame(good, kind)).collect())) == brute_codes(good)
