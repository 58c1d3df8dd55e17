"""Hard negatives, whitening and packing against brute force."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from kursbuch.llm import negatives, packing, whitening

VECTORS = "vec_id long, embedding array<double>, label int, v string, rb int"
PATH = public_tokenizers.path("byte_bpe_50k.json")


def make_vectors(spark, rows):
    """rows of (id, vector, label); the other columns clash with names that operators use inside."""
    return spark.createDataFrame([(i, v, g, "x", 1) for i, v, g in rows], VECTORS)


def usable(rows):
    return [(i, v, g) for i, v, g in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]


@pytest.fixture(scope="module")
def vectors():
    """A third in one label, ties, repeated rows and ids, nulls, non-finite, wide and empty vectors, other lengths."""
    rnd = random.Random(3)
    say = lambda n=7: [rnd.gauss(0.4, 1) for _ in range(n)]
    rows = [(i, say(), 1 if i % 3 == 0 else i % 5) for i in range(160)]
    rows += [(200 + i, rows[i][1], i % 5) for i in range(30)]
    rows += [rows[10], rows[20], (20, say(), 2), (300, say(), None), (310, None, 1), (320, [*say(6), None], 1), (330, [*say(6), math.nan], 1)]
    rows += [(340, [*say(6), math.inf], 2), (350, [x * 1e30 for x in say()], 1), (360, [x * 1e30 for x in say()], 2), (370, [x * 1e5 for x in say()], 1)]
    rows += [(380, [], 1), (390, [], 2), (400, say(3), 1), (401, say(3), 1), (402, say(3), 2), (None, say(), 1), (410, [0.0] * 7, 1)]
    return rows


def brute_negatives(rows, asks, k, m, low, high, scale):
    whole = lambda v: [math.floor(x * scale) for x in v]
    rows = [(i, whole(v), g) for i, v, g in usable(rows) if i is not None and g is not None]
    anchors = {}
    for i, v, g in rows:
        if asks(i):
            anchors[i] = min(anchors.get(i, (g, len(v), v)), (g, len(v), v))
    fits = lambda s: s if -(2**63) <= s < 2**63 else None
    out = []
    for a, (g, _, w) in anchors.items():
        scored = [(sum(x * y for x, y in zip(v, w, strict=True)), i, h) for i, v, h in rows if i != a and len(v) == len(w)]
        scored.sort(key=lambda s: (-s[0], s[1]))
        for p, i, _ in [s for s in scored if s[2] == g][:k]:
            near = [s for s in scored if s[2] != g and low * p <= 100 * s[0] <= high * p][:m]
            out += [(a, i, n + 1, s[1], fits(p), fits(s[0])) for n, s in enumerate(near)]
    return Counter(out)


@pytest.mark.parametrize("asks", [lambda i: i % 10 == 0, lambda i: True])
def test_hard_negatives(spark, vectors, asks, monkeypatch):
    # decimal vectors of few digits, so that doubles times 16 are the same whole numbers here and there
    df = make_vectors(spark, vectors)
    found = negatives.mine(df, df.filter("vec_id % 10 = 0") if not asks(1) else df, positives=3, negatives=4, low=30, high=90, scale=16)
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert Counter(map(tuple, found.collect())) == brute_negatives(vectors, asks, 3, 4, 30, 90, 16)


def test_hard_negatives_of_nothing(spark):
    df = make_vectors(spark, [])
    assert negatives.mine(df, df).count() == 0
    one = make_vectors(spark, [(0, [1.0, 2.0], 1), (1, [1.0, 2.0], 1), (2, None, None)])
    assert negatives.mine(one, one).count() == 0


def test_bounds_hold_and_filter():
    rng = np.random.default_rng(1)
    values = np.floor(256 * rng.standard_normal((3000, 64)) / 8).astype(np.int64)
    index = negatives.Quantised(values, negatives.fit_codebooks(values[:500]))
    anchors = values[:70]
    low, high = index.bounds(anchors)
    exact = anchors @ values.T
    assert (low <= exact).all() and (exact <= high).all()
    rows = negatives.candidates(low[0], high[0], np.arange(3000) > 0, None, 5)
    best = np.argsort(-exact[0][1:], kind="stable")[:5] + 1
    assert set(best) <= set(rows.tolist()) and len(rows) < 1500
    ps = int(exact[0][best[0]])
    rows = set(negatives.candidates(low[0], high[0], np.arange(3000) > 0, (30 * ps, 90 * ps), 10).tolist())
    fits = [i for i in np.argsort(-exact[0], kind="stable") if i and 30 * ps <= 100 * exact[0][i] <= 90 * ps][:10]
    assert set(fits) <= rows and len(rows) < 3000


def brute_whitening(rows, scale, shift, dims):
    x = [(i, tuple(math.floor(scale * c) + shift for c in v)) for i, v, _ in usable(rows) if len(v) == dims]
    fit = sorted({v for _, v in x})
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    centred = np.array([[(n * c - s) / n for c, s in zip(v, sums, strict=True)] for v in fit])
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    return x, n, sums, values[::-1], axes[:, ::-1]


@pytest.mark.parametrize("k", [3, 16])
def test_whitening(spark, vectors, k):
    rows = [r for r in vectors if r[0] is None or not 350 <= r[0] < 380]
    found = whitening.whiten(make_vectors(spark, rows), components=k, scale=64, shift=1000).collect()
    x, n, sums, values, axes = brute_whitening(rows, 64, 1000, 7)
    k = min(k, 7)
    got = defaultdict(list)
    for r in found:
        assert r["n"] == n and r["identity_error"] < 1e-9
        assert r["explained"] == pytest.approx(values[r["component"] - 1] / values.sum(), rel=1e-9)
        got[r["vec_id"]].append(r)
    sign = {}
    assert len(found) == k * len(x)
    for i, v in x:
        c = np.array([(n * a - s) / n for a, s in zip(v, sums, strict=True)])
        for j in range(k):
            want = c @ axes[:, j] / values[j] ** 0.5
            near = [r for r in got[i] if r["component"] == j + 1 and abs(abs(r["whitened"]) - abs(want)) < 1e-8]
            assert any(r["deviation"] == sum((n * a - s) ** 2 for a, s in zip(v, sums, strict=True)) for r in near)
            if abs(want) > 1e-6:
                assert sign.setdefault(j, np.sign(want * near[0]["whitened"])) == np.sign(want * near[0]["whitened"])


def test_whitening_by_passes_alone(spark):
    """A spectrum that falls fast needs no full dimension; equal eigenvalues do."""
    rng = np.random.default_rng(2)
    rows = [(i, [float(c) for c in rng.standard_normal(40) * 4.0 ** -np.arange(40) * 1e4], 0) for i in range(400)]
    found = whitening.whiten(make_vectors(spark, rows), components=3, scale=64).collect()
    _, n, _, values, _ = brute_whitening(rows, 64, 0, 40)
    assert {r["component"] for r in found} == {1, 2, 3} and found[0]["identity_error"] < 1e-9
    assert sorted({r["explained"] for r in found}) == pytest.approx(sorted(values[:3] / values.sum()), rel=1e-9)
    corners = [(i, [float((i >> b) & 1) for b in range(5)], 0) for i in range(32)]
    found = whitening.whiten(make_vectors(spark, corners), components=16, scale=64).collect()
    assert len(found) == 32 * 5 and max(r["identity_error"] for r in found) < 1e-9


def test_whitening_of_little(spark):
    assert whitening.whiten(make_vectors(spark, [])).count() == 0
    assert whitening.whiten(make_vectors(spark, [(1, None, 1), (2, [], 1)])).count() == 0
    assert whitening.whiten(make_vectors(spark, [(1, [1.0, 2.0], 1), (2, [1.0, 2.0], 1)])).count() == 0
    line = whitening.whiten(make_vectors(spark, [(1, [1.0, 2.0], 1), (2, [3.0, 6.0], 1), (2, [3.0, 6.0], 1)]), components=2).collect()
    assert [r["component"] for r in line] == [1, 1, 1] and {r["n"] for r in line} == {2}
    wide = whitening.whiten(make_vectors(spark, [(1, [1e300, 2.0], 1), (2, [-1e300, 6.0], 1)]), components=1).collect()
    assert [r["deviation"] for r in wide] == [None, None] and [abs(r["whitened"]) for r in wide] == pytest.approx([1, 1])


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_cut(spark, docs, corpus, library):
    more = ["<|endoftext|> and <|endoftext|>", "Zahl  ½ ² ß\x85\xa0 it's 'S 'll \n\n\n x", "日本語 текст ​ ǅ ꟊ", "\x1c\x1d a\x1f"]
    rows = [*corpus, *((900 + i, t, "s0") for i, t in enumerate(more))]
    from tests.llm.conftest import make_docs

    cut = packing.cut(make_docs(spark, rows).withColumnRenamed("size", "length"), PATH, end_id=2, capacity=64).collect()
    by = defaultdict(list)
    for r in cut:
        by[r["doc_id"]].append(r)
    for i, text, _ in rows:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        first = len(ids) % 64 or 64
        want = [(0, 0, ids[:first])] + [(n + 1, b, ids[b : b + 64]) for n, b in enumerate(range(first, len(ids), 64))]
        got = [(r["piece"], r["start"], np.frombuffer(r["ids"], "<u4").tolist()) for r in by[i]]
        assert all(w in got for w in want) and all(r["_length"] == len(r["ids"]) // 4 for r in by[i])
    assert packing.cut(make_docs(spark, []), PATH, 2).count() == 0


def test_every_character_as_the_library(library):
    coder = packing.IdBytes(PATH)
    for c in [*range(1, 0x300), 0x1C8A, 0xA7CB, 0xA7DC, 0x2028, 0x3000, 0x10FFFF]:
        text = f"a{chr(c)}b {chr(c)}{chr(c)}1{chr(c)} 's{chr(c)}"
        assert np.frombuffer(coder.encode(text), np.uint32).tolist() == library.encode(text, add_special_tokens=False).ids, c


def check_packed(rows, capacity):
    by = defaultdict(list)
    for sequence, offset, length in rows:
        by[sequence].append((offset, length))
    for held in by.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def best_fit(lengths, capacity):
    """One piece at a time, longest first, where the least room is left."""
    room = []
    for x in sorted(lengths, reverse=True):
        fits = [i for i, r in enumerate(room) if r >= x]
        if fits:
            i = min(fits, key=lambda i: room[i])
            room[i] -= x
        else:
            room.append(capacity - x)
    return len(room)


@pytest.mark.parametrize("capacity,draw", [(64, lambda r: r.randint(1, 64)), (64, lambda r: r.choice([20, 21, 22, 23])), (100, lambda r: min(100, int(r.expovariate(0.05)) + 1)), (50, lambda r: 50), (32, lambda r: 17)])
def test_pack(spark, capacity, draw):
    rnd = random.Random(4)
    lengths = [draw(rnd) for _ in range(700)]
    rows = [(i // 2, n, "x") for i, n in enumerate(lengths)] + [(1, lengths[0], "x")] * 3 + [(5, None, "x"), (6, 0, "x"), (7, capacity + 1, "x")]
    df = spark.createDataFrame(rows, "doc_id long, length long, offset string")
    packed = packing.pack(df, capacity).collect()
    assert Counter((r["doc_id"], r["length"], r["offset"]) for r in packed) == Counter(rows)
    odd = [r for r in packed if r["length"] is None or not 1 <= r["length"] <= capacity]
    assert len(odd) == 3 and all(r["sequence_id"] is None and r["_offset"] is None for r in odd)
    fine = [(r["sequence_id"], r["_offset"], r["length"]) for r in packed if r["sequence_id"] is not None]
    assert check_packed(fine, capacity) <= best_fit([n for _, _, n in fine], capacity)
    assert packing.pack(df.limit(0), capacity).count() == 0


def test_sequences(spark):
    df = spark.createDataFrame([(i, bytes([i] * 4 * n), n) for i, n in enumerate([3, 5, 2, 6, 4])], "doc_id long, ids binary, length long")
    packed = packing.pack(df, 8)
    whole = packing.sequences(packed).collect()
    assert sorted(r["length"] for r in whole) == [4, 8, 8] and all(len(r["ids"]) == 4 * r["length"] for r in whole)
    by = {r["sequence_id"]: bytes(r["ids"]) for r in whole}
    assert all(by[r["sequence_id"]][4 * r["offset"] :].startswith(bytes(r["ids"])) for r in packed.collect())
