import numpy as np
import pytest

from labelops.llm import covertree as C

SCHEMA = "vec_id long, embedding array<float>, label int, n_links string, node string"


def brute(rows):
    """(vec_id, n_links, component_id, kept) in row order."""
    ok = {}
    for k, (_, v, label) in enumerate(rows):
        if v and label is not None and all(c is not None and np.isfinite(c) for c in v) and any(v):
            x = np.array(v, np.float32).astype(float)
            ok[k] = x / np.linalg.norm(x)
    root, n = list(range(len(rows))), [0] * len(rows)

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    keys = sorted(ok)
    for i in keys:
        for j in keys:
            if i < j and rows[i][2] == rows[j][2] and len(ok[i]) == len(ok[j]) and ok[i] @ ok[j] >= 0.93:
                n[i] += 1
                n[j] += 1
                root[find(j)] = find(i)
    least = {}
    for k, (v, _, _) in enumerate(rows):
        if v is not None:
            least[find(k)] = min(v, least.get(find(k), v))
    out = []
    for k, (v, _, _) in enumerate(rows):
        c = least.get(find(k))
        out.append((v, n[k], c, v is not None and v == c))
    return sorted(out, key=str)


def found(spark, rows, **how):
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA).repartition(3)
    out = C.link_counts(df, **how)
    assert out.columns == ["vec_id", "n_links", "component_id", "kept"]
    return sorted((tuple(r) for r in out.collect()), key=str)


def cloud(seed, n, dim, centres, spread, labels=2):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(centres, dim))
    x = (c[rng.integers(0, centres, n)] + spread * rng.normal(size=(n, dim))).astype(np.float32)
    return [(int(k), [float(t) for t in v], int(lab)) for k, v, lab in zip(rng.permutation(n), x, rng.integers(0, labels, n))]


ODD = [(1000, None, 1), (1001, [], 1), (1002, [0.0, 0.0, 0.0], 1), (1003, [float("nan"), 1.0, 0.0], 1), (1004, [1.0, None, 0.0], 1),
       (1005, [float("inf"), 1.0, 0.0], 1), (1006, [1.0, 2.0, 3.0], None), (1007, [1.0, 2.0, 3.0], None), (None, [1.0, 2.0, 3.0], 7),
       (None, [1.0, 2.0, 3.1], 7), (1008, [3.0, -4.0, 0.0], 8), (1008, [3.0, -4.0, 0.0], 8), (1009, [6.0, -8.0, -0.0], 8),
       (1010, [3.0, -4.0], 8), (-5, [1.0, 0.0, 0.0], 9), (-4, [0.0, 1.0, 0.0], 9)]


def test_equals_brute_force_with_odd_rows(spark):
    rows = cloud(1, 300, 3, 12, 0.2) + ODD + cloud(1, 300, 3, 12, 0.2)[:20]
    assert found(spark, rows) == brute(rows)


@pytest.mark.parametrize("dim,centres,spread,cell,depth", [(3, 6, 0.25, 24 * 20, 12), (8, 40, 0.01, 64 * 9, 1)])
def test_split_nodes_equal_brute_force(spark, dim, centres, spread, cell, depth):
    """Cells of a few points: the top of the tree is walked in Spark, down to the dealing by hash."""
    rows = cloud(2, 400, dim, centres, spread, labels=2)
    rows += [(5000 + k, v, label) for k, (_, v, label) in enumerate(rows[:30])]  # repeated vectors
    assert found(spark, rows, cell_bytes=cell, depth=depth) == brute(rows)


def test_hot_tight_cluster_is_linked_as_a_whole(spark):
    """Most vectors of a label in one narrow cluster: nodes are linked by their radii."""
    rng = np.random.default_rng(3)
    base = rng.normal(size=16)
    x = np.concatenate([base + 0.01 * rng.normal(size=(300, 16)), rng.normal(size=(60, 16))])
    rows = [(k, [float(np.float32(t)) for t in v], 1) for k, v in enumerate(x)]
    assert found(spark, rows, cell_bytes=8 * 16 * 25) == brute(rows)


def test_bounds_near_the_threshold(spark):
    angles = [k * np.arccos(0.93) * f for k in range(6) for f in (1, 1 - 1e-6, 1 + 1e-6)]
    rows = [(k, [float(np.cos(a)), float(np.sin(a)), 0.5], 1) for k, a in enumerate(angles)]
    assert found(spark, rows) == brute(rows)


def test_cover_is_a_separated_net():
    rng = np.random.default_rng(4)
    x = C.unit(rng.normal(size=(900, 4)))
    centres, owner = C.cover(x, 0.5)
    d = C.distances(x[centres], x[centres])
    assert centres[0] == 0 and (d[~np.eye(len(centres), dtype=bool)] > 0.5).all()
    assert (np.linalg.norm(x - x[centres][owner], axis=1) <= 0.5 + 1e-9).all()


def test_empty(spark):
    assert found(spark, []) == []
