import numpy as np
import pytest

from tessera.llm import embedding_dedup as ed
from tests.llm.test_simhash import plain_components


def vectors(spark, seed, groups, noise):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(150, 16))
    rows = [list(map(float, v)) for v in base]
    for g in range(groups):
        for _ in range(12):
            rows.append(list(map(float, base[g] + noise * rng.normal(size=16))))
    rows += [rows[3], rows[3], [2 * x for x in rows[4]], [0.0] * 16, None, [1.0, None], [float("nan")] * 16, [float("inf")] + [1.0] * 15, rows[5][:8], []]
    ids = [(k, v, 1, 0) for k, v in enumerate(rows)] + [(None, rows[6], 1, 0), (7, rows[7], 1, 0)]
    return ids, spark.createDataFrame(ids, "vec_id long, embedding array<double>, n_links int, node int").repartition(3)


def plain(ids):
    unit = []
    for i, v, *_ in ids:
        ok = i is not None and v and None not in v and np.isfinite(v).all() and any(v)
        unit.append(np.array(v) / np.linalg.norm(v) if ok else None)
    near = lambda a, b: unit[a] is not None and unit[b] is not None and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.95
    n = range(len(ids))
    links = [sum(near(a, b) for b in n if b != a) for a in n]
    label = plain_components(list(n), near)
    least = {}
    for a in n:
        if ids[a][0] is not None:
            least[label[a]] = min(ids[a][0], least.get(label[a], ids[a][0]))
    return sorted((str(ids[a][0]), links[a], str(least.get(label[a]))) for a in n)


@pytest.mark.parametrize("shard", [1024, 60])
def test_links_equal_all_pairs(spark, monkeypatch, shard):
    monkeypatch.setattr(ed, "SHARD", shard)
    monkeypatch.setattr(ed, "SHARD_MOST", 2 * shard)
    monkeypatch.setattr(ed, "BLOCK", shard)
    ids, df = vectors(spark, 3, 6, 0.12)
    rows, recall = ed.embedding_links(df)
    got = sorted((str(r["vec_id"]), r["n_links"], str(r["component_id"])) for r in rows.collect())
    want = plain(ids)
    assert recall >= 0.9 and len(got) == len(want)
    assert sum(r[1] for r in got) >= 0.97 * sum(r[1] for r in want)
    if shard == 1024:
        assert got == want


def test_graph_is_reachable_and_searched():
    rng = np.random.default_rng(0)
    unit = np.concatenate([rng.normal(size=(300, 24)), 0.05 * rng.normal(size=(200, 24)) + 1]).astype(np.float32)
    unit /= np.linalg.norm(unit, axis=1)[:, None]
    lists, start = ed.build_graph(unit), ed.medoid(unit)
    seen, front = {start}, [start]
    while front:
        front = [y for x in front for y in lists[x].tolist() if y >= 0 and y not in seen and not seen.add(y)]
    assert len(seen) == 500
    q, x = ed.search(unit, lists, start, unit, 48, 0.92)
    true = set(zip(*np.nonzero(unit @ unit.T >= 0.92), strict=True))
    assert len(set(zip(q, x, strict=True)) & true) >= 0.99 * len(true)


def test_no_vectors(spark):
    rows, recall = ed.embedding_links(spark.createDataFrame([], "vec_id long, embedding array<float>"))
    assert rows.count() == 0 and recall == 1.0
