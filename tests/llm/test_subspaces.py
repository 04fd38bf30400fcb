"""Subspace pigeonhole join against all pairs in double precision."""

import numpy as np
import pytest

from tessera.llm import subspaces

SCHEMA = "vec_id long, embedding array<float>, label int, n_links string"


def plain(rows, cosine=0.93):
    """row index -> (n_links, component's rows)"""
    units = []
    for _, v, label, _ in rows:
        ok = v is not None and label is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)
        if ok:
            x = np.array(v, np.float32).astype(float)
            x /= np.abs(x).max()
            units.append((label, len(v), x / np.linalg.norm(x)))
        else:
            units.append(None)
    n, parent = [0] * len(rows), list(range(len(rows)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    by = {}
    for i, u in enumerate(units):
        if u:
            by.setdefault(u[:2], []).append(i)
    for at in by.values():
        x = np.stack([units[i][2] for i in at])
        linked = x @ x.T >= cosine
        for k, i in enumerate(at):
            others = [at[m] for m in np.flatnonzero(linked[k]) if m != k]
            n[i] = len(others)
            for j in others:
                parent[top(i)] = top(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[top(i)] = min(least.get(top(i), r[0]), r[0])
    return sorted((str(r[0]), n[i], str(least.get(top(i))), r[0] == least.get(top(i))) for i, r in enumerate(rows))


def found(spark, rows, parts=3, **options):
    got = subspaces.near_vectors(spark.createDataFrame(rows, SCHEMA).repartition(parts), **options)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    return sorted((str(r["vec_id"]), r["n_links"], str(r["component_id"]), r["kept"]) for r in got.collect())


def clustered(seed, d, labels=3):
    """Background, tight groups, wide groups with links to some only, chains, scaled and exact copies."""
    r = np.random.default_rng(seed)
    made = [(r.normal(size=d), int(r.integers(labels))) for _ in range(300)]
    for size, spread in ((120, 0.02), (60, 0.2), (60, 0.27), (40, 0.3), (3, 0.1), (2, 0.05)):
        base, label = r.normal(size=d), int(r.integers(labels))
        made += [(base + spread * r.normal(size=d), label) for _ in range(size)]
    step, label = r.normal(size=d), 1
    for _ in range(12):                                          # a chain whose ends are far apart
        made.append((step, label))
        turn = r.normal(size=d)
        step = step + 0.3 * np.linalg.norm(step) * turn / np.linalg.norm(turn)
    copy = r.normal(size=d)
    made += [(copy, 2)] * 50 + [(copy * k, 2) for k in (0.5, 3, 100)] + [(-copy, 2), (copy, 0)]
    order = r.permutation(len(made))
    return [(int(i), [float(x) for x in made[i][0]], made[i][1], "other") for i in order]


@pytest.mark.parametrize("d, options", [(64, {}), (64, {"chunk": 32, "tile": 40}), (16, {}), (3, {}), (1, {}), (24, {"cosine": 0.8})])
def test_links_equal_those_of_all_pairs(spark, d, options):
    rows = clustered(d, d)
    assert found(spark, rows, **options) == plain(rows, options.get("cosine", 0.93))


def test_balls_whose_members_link_in_part(spark):
    r = np.random.default_rng(8)
    base = np.zeros(64)
    base[0] = 1
    turned = base.copy()
    turned[:2] = [np.cos(0.37), np.sin(0.37)]                    # the angle of a cosine of 0.93 is 0.376
    rows = [(k, [float(x) for x in c + 0.004 * r.normal(size=64)], 1, "x") for k, c in enumerate([base, turned] * 40)]
    want = plain(rows)
    assert len({x[1] for x in want}) > 2                         # neither all with all nor none
    assert found(spark, rows) == want


def test_awkward_rows(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(1, v, 1, "a"), (2, v, 1, "a"), (2, v, 1, "a"), (None, v, 1, "a"), (3, v, None, "a"), (4, None, 1, "a"), (5, [], 1, "a"),
            (6, [0.0] * 3, 1, "a"), (7, [1.0, None, 3.0], 1, "a"), (8, [float("nan"), 2.0, 3.0], 1, "a"), (9, [float("inf"), 2.0, 3.0], 1, "a"),
            (10, [1.0, 2.0], 1, "a"), (None, None, None, "a"), (11, [3e38, 3e38, 3e38], 2, "a"), (12, [1e-40, 1e-40, 1e-40], 2, "a")]
    assert found(spark, rows) == plain(rows)
    assert found(spark, []) == []
