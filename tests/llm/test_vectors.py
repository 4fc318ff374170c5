"""Operator 4 against brute force, odd vectors included."""

import numpy as np

from meshset.llm import nn_descent


def test_links(spark):
    rng = np.random.default_rng(2)
    rows, centres = [], rng.standard_normal((6, 16))
    for k in range(300):
        rows.append((k, rng.standard_normal(16).astype(np.float32).tolist(), k % 3))
    for k in range(300, 420):
        rows.append((k, (centres[k % 6] + 0.06 * rng.standard_normal(16)).astype(np.float32).tolist(), k % 6 % 3))
    rows += [(500 + k, rows[300][1], rows[300][2]) for k in range(3)] + [(510, [2 * x for x in rows[300][1]], rows[300][2])]
    rows += [(600, None, 1), (601, [0.0] * 16, 1), (602, [1.0, None, *[0.0] * 14], 1), (603, [float("nan")] * 16, 1), (604, [float("inf"), *[1.0] * 15], 1), (605, rows[300][1], None), (606, [], 1), (607, [1.0, 2.0], 1), (None, rows[301][1], rows[301][2])]
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, label int, vid string")
    good = [k for k, (_, v, y) in enumerate(rows) if y is not None and v and len(v) == 16 and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    m = np.array([rows[k][1] for k in good], float)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    y = np.array([rows[k][2] for k in good])
    near = (m @ m.T >= 0.98) & (y[:, None] == y[None, :])
    label = np.arange(len(good))
    while True:
        new = np.array([label[n].min() for n in near])
        if (new == label).all():
            break
        label = new
    want = {r[0]: (0, r[0]) for r in rows}
    for k, g in enumerate(good):
        ids = [rows[good[j]][0] for j in np.flatnonzero(label == label[k])]
        want[rows[g][0]] = (int(near[k].sum()) - 1, min(i for i in ids if i is not None))
    got = {r.vec_id: (r.n_links, r.component_id) for r in nn_descent.near_vectors(df).collect()}
    assert got == want
    assert nn_descent.near_vectors(df.where("false")).count() == 0


def test_groups_wider_than_lists(spark):
    """Two groups whose members have more nearer links than a list holds, linked with each other."""
    rng = np.random.default_rng(3)
    x, y = np.linalg.qr(rng.standard_normal((16, 2)))[0].T
    centres = [x, 0.985 * x + np.sqrt(1 - 0.985**2) * y]
    rows = [(k, (centres[k % 2] + 0.0005 * rng.standard_normal(16)).tolist(), 1) for k in range(200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in nn_descent.near_vectors(df).collect()}
    assert got == {k: (199, 0) for k in range(200)}


def test_completed_where_the_descent_finds_too_little(spark, monkeypatch):
    """One table with a window of one and no rounds misses links; they are found by full comparison, and that is reported."""
    rng = np.random.default_rng(4)
    centres = rng.standard_normal((40, 16))
    rows = [(k, (centres[k % 40] + 0.05 * rng.standard_normal(16)).tolist(), "ab"[k % 2]) for k in range(900)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")
    m = np.array([v for _, v, _ in rows])
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    near = (m @ m.T >= 0.98) & (np.arange(900)[:, None] % 2 == np.arange(900)[None, :] % 2)
    label = np.arange(900)
    while (label != (new := np.array([label[n].min() for n in near]))).any():
        label = new
    want = {k: (int(near[k].sum()) - 1, int(label[k])) for k in range(900)}
    for small, few in ((False, 8), (True, 1)):
        report = {}
        if small:
            for name, x in {"TABLES": 1, "MOST_TABLES": 1, "ROUNDS": 0, "SMALL": 64}.items():
                monkeypatch.setattr(nn_descent, name, x)
            monkeypatch.setattr(nn_descent.seeds, "__defaults__", (1, 8))
            monkeypatch.setattr(nn_descent.compare, "__defaults__", (64, 128))
        got = {r.vec_id: (r.n_links, r.component_id) for r in nn_descent.near_vectors(df, report=report).collect()}
        assert got == want
        assert report["completed"] is small and report["tables"] == few and (report["recall"] < 0.97) is small


def test_audit_without_links(spark):
    df = spark.createDataFrame([(k, np.eye(8)[k].tolist(), 1) for k in range(8)], "vec_id long, embedding array<double>, label int")
    report = {}
    assert {(r.n_links, r.kept) for r in nn_descent.near_vectors(df, report=report).collect()} == {(0, True)} and report["recall"] is None
