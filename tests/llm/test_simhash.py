import random
from collections import Counter

import pytest
import xxhash

from tessera.llm import simhash_dedup as sd
from tessera.llm.graphs import bucket_components, components
from pyspark.sql import functions as F


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    grams = [b" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(nodes, near):
    label = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a in nodes:
            for b in nodes:
                if near(a, b) and label[b] < label[a]:
                    label[a], changed = label[b], True
    return label


def test_triples_cover_every_four_positions():
    from itertools import combinations

    triples = [set(t) for t in sd.position_triples()]
    assert len(triples) == 20
    assert all(any(t <= set(four) for t in triples) for four in combinations(range(8), 4))


@pytest.mark.parametrize("edges", [
    [], [(1, 1)], [(5, 4), (4, 3), (3, 2), (2, 1), (9, 8), (8, 9), (9, 8)], [(1, k) for k in range(2, 40)],
    [(k, k + 1) for k in range(60)] + [(100, 7)],
])
def test_components(spark, edges):
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    nodes = sorted({x for e in edges if e[0] != e[1] for x in e})
    linked = set(edges) | {(b, a) for a, b in edges}
    assert got == plain_components(nodes, lambda a, b: (a, b) in linked)


def test_bucket_components_lose_no_link(spark):
    """Chains inside a bucket, and links that only members other than the smallest have."""
    rng = random.Random(5)
    rows = [(k, n, n) for n in rng.sample(range(400), 120) for k in {n // 40, (n + 20) // 40 + 100}]
    near = lambda a, b: F.abs(a - b) <= 3
    got = bucket_components(spark.createDataFrame(rows, "key long, node long, print long"), near)
    label = plain_components(sorted({n for _, n, _ in rows}), lambda a, b: abs(a - b) <= 3)
    sizes = Counter(label.values())
    assert {r["node"]: r["component"] for r in got.collect()} == {n: c for n, c in label.items() if sizes[c] > 1}


def test_classes_equal_all_pairs(spark):
    rng = random.Random(3)
    words = [f"w{k}" for k in range(400)]
    base = [" ".join(rng.choices(words, k=120)) for _ in range(25)]
    rows = [(k, t) for k, t in enumerate(base)]
    for k in range(60):  # near copies, some of them copies of copies
        of = rng.choice(rows)[1].split()
        of[rng.randrange(len(of))] = rng.choice(words)
        rows.append((100 + k, " ".join(of)))
    rows += [(200, None), (201, ""), (202, " \n"), (203, "two words"), (204, "TWO\tWORDS"), (205, base[0]), (205, base[0]),
             (None, base[1]), (None, "only here"), (206, "Ünï É"), (207, "ünï é"), (208, "long " * 30_000)]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, fp string, key int").repartition(4)
    prints = [plain_fingerprint(t) for _, t in rows]
    label = plain_components(sorted(set(prints)), lambda a, b: (a ^ b).bit_count() <= 4)
    least = {}
    for (i, _), p in zip(rows, prints, strict=True):
        if i is not None:
            least[label[p]] = min(i, least.get(label[p], i))
    want = Counter((i, p, least.get(label[p])) for (i, _), p in zip(rows, prints, strict=True))
    got = sd.simhash_components(docs)
    assert Counter((r["doc_id"], r["fp"] % 2**64, r["component_id"]) for r in got.collect()) == want
    kept = sd.drop_near_copies(docs)
    assert kept.columns == docs.columns
    firsts = {i for i, p, c in want if i == c or i is None}
    assert {r["doc_id"] for r in kept.collect()} == firsts


def test_no_documents(spark):
    assert sd.simhash_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0
