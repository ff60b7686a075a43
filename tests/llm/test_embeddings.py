"""Embedding near-duplicates against brute force, where cells, tables and the first-table rule are at work."""

import numpy as np
import pytest

from weftgraph.llm import embed_dedup


def planted(n: int, groups: int, size: int = 64, seed: int = 4):
    """n random vectors, and around some of them others at cosines from 0.925 to 0.94, and one tight group."""
    dice = np.random.RandomState(seed)
    base = dice.standard_normal((n, size))
    rows = [*base]
    for k in range(groups):
        u = base[k] / np.linalg.norm(base[k])
        for cosine in (0.925, 0.9302, 0.9305, 0.94):
            w = dice.standard_normal(size)
            w -= (w @ u) * u
            rows.append(cosine * u + np.sqrt(1 - cosine * cosine) * w / np.linalg.norm(w))
    rows += [base[n - 1] + 0.02 * dice.standard_normal(size) for _ in range(200)]
    return np.array(rows, dtype=np.float32)


def brute(vectors):
    unit = vectors.astype(np.float64)
    unit /= np.sqrt((unit * unit).sum(axis=1, keepdims=True))
    near = unit @ unit.T >= 0.93
    np.fill_diagonal(near, False)
    label = np.arange(len(near))
    while True:
        low = np.array([min(label[k], label[near[k]].min(initial=len(near))) for k in range(len(near))])
        if (low == label).all():
            return near.sum(axis=1), label
        label = low


@pytest.mark.parametrize("kind", ["float", "double"])
def test_planted_links_of_a_large_label(spark, kind):
    vectors = planted(3000, 100)
    how = embed_dedup.calibrated(len(vectors))
    assert how["axes"] > 2 and how["tables"] > 5
    rows = [(k, v.tolist(), "a") for k, v in enumerate(vectors)] + [(10_000 + k, v.tolist(), "b") for k, v in enumerate(vectors[:50])]
    got = {r["vec_id"]: r for r in embed_dedup.groups(spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label string")).collect()}
    links, component = brute(vectors)
    found = sum(got[k]["n_links"] for k in range(len(vectors)))
    assert all(got[k]["n_links"] <= links[k] for k in range(len(vectors)))  # no wrong link
    assert links.sum() > 40_000 and found >= 0.99 * links.sum()
    few = np.flatnonzero((links > 0) & (links < 10))  # outside the tight group, where links are thousands
    assert sum(got[int(k)]["n_links"] for k in few) >= 0.99 * links[few].sum()
    assert sum(got[k]["component_id"] == component[k] for k in range(len(vectors))) >= 0.99 * len(vectors)
    assert all(got[10_000 + k]["n_links"] == 0 for k in range(50))  # the other label has them alone
