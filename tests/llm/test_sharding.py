"""Shards by sampled splitters: the law of equal bytes, and positions against a plain version."""

import random
import zlib
from collections import Counter, defaultdict

import pytest

from tessera.llm import sharding


def documents(n, seed=1):
    rng = random.Random(seed)
    rows = [(k, "wörd " * rng.randrange(1, 60) + str(k), "a", 1) for k in range(n)]
    rows += [(10_000 + k, "the same text " * 30, "b", 2) for k in range(n // 2)]  # a third of all rows
    rows += [(None, None, None, None)] * 40 + [(7, "", "c", 0), (7, "", "c", 0), (8, None, "c", 0), (3, rows[3][1], "x", 9)]
    return rows


SCHEMA = "doc_id long, text string, slot string, shard int"


def bytes_of(text):
    return len((text or "").encode()) + 8


def checked(placed, rows, shards):
    """Each row once, slots gapless; the sizes of the shards."""
    got = placed.collect()
    assert Counter(tuple(r["row"]) for r in got) == Counter(rows)
    slots, sizes = defaultdict(list), dict.fromkeys(range(shards), 0)
    for r in got:
        slots[r["shard"]].append(r["slot"])
        sizes[r["shard"]] += bytes_of(r["row"]["text"])
    assert set(slots) <= set(range(shards))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return list(sizes.values())


@pytest.mark.parametrize("range_bytes", [sharding.RANGE_BYTES, 2_000])
def test_shards_hold_equal_bytes(spark, range_bytes):
    rows = documents(2_000)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    sizes = checked(sharding.place_rows(docs, 7, range_bytes), rows, 7)
    mean = sum(sizes) / 7
    assert max(sizes) - min(sizes) <= 0.045 * mean + 8


def test_large_rows_are_levelled(spark):
    rows = documents(400) + [(500 + k, "x" * 9_000 * k, "l", 0) for k in range(6)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    sizes = checked(sharding.place_rows(docs, 5), rows, 5)
    assert max(sizes) - min(sizes) <= 0.045 * sum(sizes) / 5 + 8


def test_a_row_larger_than_a_shard(spark):
    rows = documents(50) + [(500, "x" * 1_000_000, "l", 0)]
    sizes = checked(sharding.place_rows(spark.createDataFrame(rows, SCHEMA), 4), rows, 4)
    rest = sorted(sizes)[:3]
    assert max(sizes) >= 1_000_000 and max(rest) - min(rest) <= max(bytes_of(t) for d, t, *_ in rows if d != 500)


@pytest.mark.parametrize("n", [0, 1, 3])
def test_few_rows(spark, n):
    rows = [(k, "text", "a", 0) for k in range(n)]
    sizes = checked(sharding.place_rows(spark.createDataFrame(rows, SCHEMA), 5), rows, 5)
    assert sorted(sizes, reverse=True) == [12] * n + [0] * (5 - n)


def test_equal_texts_stay_in_neighbouring_shards(spark, monkeypatch):
    monkeypatch.setattr(sharding, "LARGE_PART", 1)
    rows = documents(600)
    placed = sharding.place_rows(spark.createDataFrame(rows, SCHEMA).repartition(4), 24).select("row.text", "shard").distinct()
    shards = defaultdict(set)
    for text, shard in placed.collect():
        shards[text].add(shard)
    once = [s for t, s in shards.items() if t and not t.startswith("the same")]
    assert all(max(s) - min(s) <= 1 for s in once)
    assert len(shards["the same text " * 30]) > 3


def test_positions_follow_from_the_splitters(spark, monkeypatch):
    """Shards and slots against a plain pass over the written keys, with the splitters of the operator."""
    rows, seen = documents(500), {}
    keyed, cut = sharding.keyed_rows, sharding.splitters
    monkeypatch.setattr(sharding, "keyed_rows", lambda docs: seen.setdefault("held", keyed(docs)))
    monkeypatch.setattr(sharding, "splitters", lambda *a: seen.setdefault("cuts", cut(*a)))
    got = sharding.place_rows(spark.createDataFrame(rows, SCHEMA).repartition(3), 6)
    held = seen["held"].collect()
    total = sum(r["size"] for r in held)
    most = max(8, total // (6 * sharding.LARGE_PART))
    dealt, loads = sharding.deal_large([(r["at"], r["size"]) for r in held if r["size"] > most], 6)
    small = sorted((r["key"], r["at"], r["size"], tuple(r["row"])) for r in held if r["size"] <= most)
    ends, position, want, filled = sharding.boundaries(loads, total - sum(loads)), 0, [], Counter()
    for _, _, size, row in small:
        shard = sum(e <= position + size // 2 for e in ends[:-1])
        want.append((row, shard, filled[shard]))
        filled[shard] += 1
        position += size
    by_at = {r["at"]: tuple(r["row"]) for r in held}
    want += [(by_at[at], shard, filled[shard] + place) for at, shard, place in dealt]
    assert len(seen["cuts"]) > 10
    assert Counter((tuple(r["row"]), r["shard"], r["slot"]) for r in got.collect()) == Counter(want)


def test_boundaries_level_the_loads():
    assert sharding.boundaries([0, 0, 0, 0], 100) == [25, 50, 75, 100]
    assert sharding.boundaries([50, 0, 10], 20) == [0, 15, 20]
    assert sharding.boundaries([5, 1], 0) == [0, 0]
    for loads, rest in (([3, 9, 1, 4], 31), ([0], 5), ([100, 1, 1], 50)):
        ends = sharding.boundaries(loads, rest)
        full = [x + b - a for x, a, b in zip(loads, [0, *ends], ends)]
        assert sum(full) == sum(loads) + rest and ends == sorted(ends)
        touched = [f for f, a, b in zip(full, [0, *ends], ends) if b > a]
        assert max(touched) - min(touched) <= 1 and max(touched) <= min(f for f, x in zip(full, loads) if f == x or True) + max(full)


def test_written_shards(spark, tmp_path):
    rows = documents(100)
    got = sharding.write_shards(spark.createDataFrame(rows, SCHEMA), 3, str(tmp_path / "shards"))
    checked(got, rows, 3)
    assert sorted(p.name for p in (tmp_path / "shards").glob("shard=*")) == ["shard=0", "shard=1", "shard=2"]


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    got = sharding.op11_sampled_splitters(spark, sf).collect()
    want = Counter((d["doc_id"], bytes_of(d["text"]), zlib.crc32((d["text"] or "").encode())) for d in docs)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    assert {(r["law"], r["grown_shard"]) for r in got} == {("bytes", None)}
    sizes, slots = Counter(), defaultdict(list)
    for r in got:
        sizes[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert set(sizes) == set(range(24)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(sizes.values()) - min(sizes.values()) <= 0.045 * sum(sizes.values()) / 24
