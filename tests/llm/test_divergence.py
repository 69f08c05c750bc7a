"""Source divergence against a plain count of every term and pair."""

import random
import re
from collections import Counter, defaultdict

import pytest

from tessera.llm import divergence as dv

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def folded(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def plain(rows, least, top):
    n, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source in rows:
        lang, source, terms = lang or "", source or "", TERM.findall(folded(text))
        groups.add((lang, source))
        n[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = set()
    for lang, source in groups:
        kept = [t for t, d in docs[lang].items() if d >= least]
        sources = sorted(s for g, s in groups if g == lang)

        def shares(counts, kept=kept):
            total = sum(counts[t] for t in kept)
            return {t: 1 + 1_000_000_000 * (counts[t] + 2) // (total + 2 * len(kept)) for t in kept}

        own = shares(n[lang, source])
        f = lambda p, q: (p - q) ** 2 // (p + q)
        pairs = []
        for other in sources:
            if other != source:
                q = shares(n[lang, other])
                pairs.append((-sum(f(own[t], q[t]) for t in kept), other.encode()))
        whole = shares(sum((n[lang, s] for s in sources), Counter()))
        terms = [(-f(own[t], whole[t]), t.encode()) for t in kept if n[lang, source][t] and own[t] > whole[t]]
        for part, items in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
            out |= {(lang, source, part, item.decode(), -v, k + 1) for k, (v, item) in enumerate(items)}
    return out


def rows(seed, n):
    rng = random.Random(seed)
    vocabulary = ["Alpha", "beta", "été", "ÉTÉ", "straße", "x1y", "naïve", "日本", "𝄞a", "a", "I'm"] + [f"w{chr(97 + k)}{chr(97 + j)}" for k in range(12) for j in range(5)]
    made = []
    for k in range(n):
        lang, source = rng.choice(["en", "fr", None, ""]), rng.choice(["s0", "s0", "s0", "s1", "S2", None, "é"])
        text = rng.choice([None, "", " ,;-\n\0"]) if rng.random() < 0.05 else rng.choice([" ", "\n", "_", "@"]).join(rng.choices(vocabulary, k=rng.randrange(1, 40)))
        made.append((k, text, lang, source))
    made += [made[3]] * 4 + [(1, "lonely words only", "de", "s9"), (2, None, "de", "s8"), (None, "beta " * 40_000, "en", "s1")]
    return made


@pytest.mark.parametrize("least,held", [(10, 300_000), (2, 50)])
def test_equal_to_plain_counts(spark, monkeypatch, least, held):
    made = rows(least, 500)
    monkeypatch.setattr(dv, "HELD_WORDS", held)
    docs = spark.createDataFrame([(*r, "clash", 1) for r in made], "doc_id long, text string, lang string, source string, term string, n int")
    got = dv.source_divergence(docs.repartition(4), least)
    assert {tuple(r) for r in got.collect()} == plain(made, least, 10)
    assert got.count() == len(plain(made, least, 10))


def test_ties_are_cut_in_byte_order(spark):
    made = [(k, "zeta Ωmega élan alpha 𝄞 one two three four five six seven eight nine ten", "en", "a") for k in range(12)]
    made += [(k, "other", "en", "b") for k in range(12)]
    docs = spark.createDataFrame(made, "doc_id long, text string, lang string, source string")
    got = dv.source_divergence(docs)
    want = plain(made, 10, 10)
    assert {tuple(r) for r in got.collect()} == want
    assert len([w for w in want if w[:3] == ("en", "a", "term")]) == 10


@pytest.mark.parametrize("made", [[], [(1, "a b", "en", "s")], [(1, None, None, None), (2, "x", None, "t")]])
def test_small_tables(spark, made):
    docs = spark.createDataFrame(made, "doc_id long, text string, lang string, source string")
    assert {tuple(r) for r in dv.source_divergence(docs).collect()} == plain(made, 10, 10)
