"""Fill-in-the-middle against regular expressions and plain slices."""

import hashlib
import random
import re

import pytest

from tessera.llm import fill_middle as fm

UNIT = re.compile(r"[A-Za-z]+|[^A-Za-z]", re.DOTALL)


def plain(text, doc_id):
    text = text or ""
    units = UNIT.findall(text)
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k:k + 8], 16) for k in (0, 8, 16, 24))
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or "<P>" in text or "<S>" in text or "<M>" in text or h3 % 100 >= 90:
        return len(units), "plain", None, None, text
    if h4 % 100 < 20:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def texts():
    rng = random.Random(4)
    alphabet = "abcXYZ  \n\t0.,<>PSM/é€𝄞ß"
    made = ["".join(rng.choices(alphabet, k=rng.randrange(0, 200))) for _ in range(300)]
    return made + [None, "", "a", " ", "ab", "<P>", "x <M> y", "a<" * 50, "<S" * 40, "word " * 3000, "Z" * 5000, "𝄞" * 300, "nul\0byte"]


@pytest.mark.parametrize("span,piece", [(16, 1 << 20), (2, 7), (3, 64)])
def test_every_rank_of_the_skip_list(monkeypatch, span, piece):
    monkeypatch.setattr(fm, "SPAN", span)
    monkeypatch.setattr(fm, "PIECE", piece)
    for text in texts()[-40:]:
        units = UNIT.findall(text or "")
        listed = fm.SkipList(text or "")
        assert listed.units == len(units)
        at = 0
        for rank in range(0, len(units) + 1):
            if rank < 300 or rank % 97 == 0 or rank == len(units):
                assert listed.code_point(rank) == at
            at += len(units[rank]) if rank < len(units) else 0
        assert all(int(u.sum()) == len(units) and int(c.sum()) == len(text or "") for u, c in listed.lanes)


def test_rows_equal_plain_ones_and_restore(spark):
    rows = [(k, t, "x", "y") for k, t in enumerate(texts())] + [(None, "no id here", "x", "y"), (5, "again a five", "", ""), (5, "again a five", "", "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, output string, n string").repartition(3)
    want = sorted(((d, *plain(t, d), t or "") for d, t, *_ in rows), key=repr)
    cuts = fm.restored(fm.fill_in_middle(docs))
    got = sorted(((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"], r["text"]) for r in cuts.collect()), key=repr)
    assert got == want
    assert {r[2] for r in got} == {"plain", "psm", "spm"}
    assert all(fm.restore(r[5], r[2]) == r[6] for r in got)


def test_a_very_long_text(spark):
    text = "lorem ipsum, dolor " * 200_000
    for doc_id in range(8):
        cut = fm.rearrange(text, doc_id)
        assert (cut.units, cut.form, cut.output) == tuple(plain(text, doc_id)[k] for k in (0, 1, 4))
        assert fm.restore(cut.output, cut.form) == text


def test_no_documents(spark):
    assert fm.fill_in_middle(spark.createDataFrame([], "doc_id long, text string")).count() == 0
