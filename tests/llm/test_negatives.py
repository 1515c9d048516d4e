"""Hard negatives against sorting all rows for every anchor."""

import math
import random

import numpy as np
import pytest

from tessera.llm import negatives as neg

SCHEMA = "vec_id long, embedding array<float>, label int, row long, norm string, `a.b` string"


def brute(rows, every=100, keep=5):
    sound = []
    for i, (vec_id, x, label) in enumerate(rows):
        if label is None or x is None or any(c is None or not math.isfinite(c) for c in x):
            continue
        label = (label + 1) % 10 if vec_id is not None and vec_id % 7 == 0 else label
        sound.append((i, vec_id, label, [math.floor(256 * float(np.float32(c))) for c in x]))
    order = lambda p: (-p[0], p[1] is None, p[1] or 0)
    out = []
    for i, vec_id, label, x in sound:
        if vec_id is None or vec_id % every:
            continue
        scored = [(sum(a * b for a, b in zip(x, y, strict=False)), v, l == label) for j, v, l, y in sound if j != i]
        for score, positive, _ in sorted((s for s in scored if s[2]), key=order)[:keep]:
            found = sorted((s for s in scored if not s[2] and 80 * score <= 100 * s[0] <= 100 * score), key=order)[:keep]
            out += [(vec_id, positive, k + 1, v, score, s) for k, (s, v, _) in enumerate(found)]
    return sorted(out, key=repr)


def mined(spark, rows, **more):
    table = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], SCHEMA)
    return sorted((tuple(r) for r in neg.hard_negatives(table, **more).collect()), key=repr)


def vectors(seed, n, dims, groups):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((groups, dims)) * 3
    return [(int(i), [float(c) for c in centres[rng.integers(groups)] + 0.4 * rng.standard_normal(dims) * rng.choice([0.2, 1.0])], int(rng.integers(10))) for i in range(n)]


@pytest.mark.parametrize(("n", "dims", "groups", "every", "bucket", "block", "step"), [(900, 8, 6, 20, 64, 8, 16), (400, 24, 1, 100, 16384, 512, 1024), (500, 3, 40, 5, 50, 20, 7)])
def test_negatives_against_sorting(spark, monkeypatch, n, dims, groups, every, bucket, block, step):
    for name, value in (("BUCKET", bucket), ("BLOCK", block), ("STEP", step), ("ANCHORS", 8)):
        monkeypatch.setattr(neg, name, value)
    rows = vectors(n, n, dims, groups)
    assert mined(spark, rows, every=every) == brute(rows, every)


def test_awkward_rows(spark, monkeypatch):
    monkeypatch.setattr(neg, "BUCKET", 30)
    rng = random.Random(2)
    rows = [(i % 150, [float(rng.randint(-2, 2)) / 4 for _ in range(4)], rng.randrange(4)) for i in range(260)]  # ties and repeated ids
    rows += [(200 + i, [0.5, -0.25, 0.5, 1.0], i % 3) for i in range(90)]  # a large group of one vector
    nan, inf = float("nan"), float("inf")
    rows += [(300, None, 1), (400, [nan, 0.0, 0.0, 1.0], 1), (500, [inf, 0.0, 0.0, 1.0], 1), (600, [None, 1.0, 1.0, 1.0], 1), (700, [1.0] * 4, None), (None, [1.0] * 4, 1), (None, [1.0] * 4, 2)]
    rows += [(800, [0.0] * 4, 1), (900, [], 2), (1000, [1.0], 3), (1100, [-1.0] * 4, 0)]
    assert mined(spark, rows) == brute(rows)
    assert mined(spark, []) == [] and mined(spark, [(1, [1.0], 1)]) == [] and mined(spark, [(100, [1.0], 1)]) == []


def test_very_great_components(spark):
    rows = [(i, [float(np.float32(x)) for x in np.random.default_rng(i).standard_normal(4) * 1e5], i % 2) for i in range(120)]
    assert mined(spark, rows, every=10) == brute(rows, 10)


def test_walks_end_early_on_clustered_vectors():
    rng = np.random.default_rng(1)
    near, far = rng.standard_normal(16), rng.standard_normal((20000, 16))
    x = np.rint(256 * np.vstack([near + 0.05 * rng.standard_normal((1000, 16)), far]))
    centre = (near / np.linalg.norm(near))[None]
    norm = neg._norms(x)
    found = {"x": x, "norm": norm, "angles": neg._angles(x, norm, centre), "label": np.arange(len(x)) % 2, "row": np.arange(len(x)), "vec_id": np.arange(len(x))}
    anchors = {"x": x[:50], "norm": norm[:50], "label": found["label"][:50], "row": np.arange(50), "slot_anchor": np.arange(50), "low": np.full(50, -neg._LONG - 1), "high": np.full(50, neg._LONG)}
    best, taken = neg._walk(anchors, found, neg.share_list(found, 0, found["angles"][:50].max()), 5, True)
    scores = (x[:50] @ x.T).astype(np.int64)
    for i in range(50):
        mine = [j for j in np.lexsort((np.arange(len(x)), -scores[i])) if j != i and j % 2 == i % 2][:5]
        assert best.vec[best.slot == i].tolist() == mine
    assert taken < 0.25 * scores.size
