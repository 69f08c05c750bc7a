"""Line dedup, quality, urls, archives, languages and the pipeline against plain versions."""

import base64
import gzip
import hashlib
import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.llm import language, line_dedup, quality, url_filter, warc
from tessera.llm.files import read_file, shared_folder
from tests.llm.test_simhash import plain_components

WORDS = [f"{a}{b}" for a in "bcdfghjklm" for b in ("an", "er", "ou", "ist", "ell", "orn")]


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema).repartition(3)


# ---- lines -----------------------------------------------------------------------------------------------------------

def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_lines_equal_all_pairs(spark):
    rng = random.Random(2)
    lines = [" ".join(rng.choices(WORDS, k=30)) for _ in range(12)]
    near = []
    for k in range(30):
        words = rng.choice(lines + near).split()
        words[rng.randrange(30)] = rng.choice(WORDS)
        near.append(" ".join(words))
    pool = lines + near + ["too short", "", "   ", "Page 1 of many pages here", "page 1, of MANY pages here!", "de " * 40_000]
    docs = [(k, "\n".join(rng.choices(pool[:-1], k=6)), 0, "n") for k in range(30)]
    docs += [(50, pool[-1] + "\nx"), (51, pool[-1]), (52, None), (None, lines[0]), (53, ""), (7, docs[7][1])]
    docs += [(7, lines[1] + "\nonly in this row of the id seven\n" + lines[2])]
    docs = [(d[0], d[1], 0, "n", 1, 2, "t") for d in docs]
    given = frame(spark, docs, "doc_id long, text string, n_chars int, gone string, _id int, line_no int, h string")
    shown = sorted({norm(p) for p in pool if len(norm(p).split()) >= 5})

    def close(a, b):
        most = int(max(len(a), len(b)) * (1 - 0.9))
        return a == b or abs(len(a) - len(b)) <= most and edits(a, b) <= most

    group = plain_components(shown, close)
    assert len(set(group.values())) < len(group) - 8
    first = {}
    for d, text, *_ in sorted((d for d in docs if d[0] is not None and d[1] is not None), key=lambda d: d[0]):
        for k, line in enumerate(text.split("\n")):
            if norm(line) in group:
                first[group[norm(line)]] = min(first.get(group[norm(line)], (d, k, line)), (d, k, line))
    # of different lines at the first place of a group any one may be kept, so the data has none
    kept = {(d, k, norm(line)) for d, k, line in first.values()}

    def left(d, text):
        if d is None or text is None:
            return text
        return "\n".join(x for k, x in enumerate(text.split("\n")) if norm(x) not in group or (d, k, norm(x)) in kept)

    got = line_dedup.dedup_lines(given)
    assert got.schema == given.schema
    want = Counter((d, left(d, t)) for d, t, *_ in docs)
    assert Counter((r["doc_id"], r["text"]) for r in got.collect()) == want
    assert all(r["n_chars"] == len(r["text"]) for r in got.collect() if r["text"] and r["n_chars"])
    assert all((r["gone"], r["_id"], r["line_no"], r["h"]) == ("n", 1, 2, "t") for r in got.collect())


def test_rows_of_one_id_lose_only_their_own_copies(spark):
    line, u, v = (" ".join(WORDS[k:k + 8]) for k in (0, 20, 40))
    docs = [(1, line), (7, line + "\nkeep"), (7, u + "\n" + v)]
    got = line_dedup.dedup_lines(frame(spark, docs, "doc_id long, text string"))
    assert Counter(tuple(r) for r in got.collect()) == Counter([(1, line), (7, "keep"), (7, u + "\n" + v)])


def norm(line):
    import regex
    return regex.sub(r"[^\p{L}\p{M}\p{N}]+", " ", line.lower()).strip()


def test_long_lines_allow_a_tenth_of_edits(spark):
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefghijklmnop", k=rng.randrange(2, 9))) for _ in range(700)]
    moved, far = words[28:] + words[:28], words[200:] + words[:200]
    assert len(" ".join(words)) > 4000 and 256 < edits(" ".join(words), " ".join(moved)) < len(" ".join(words)) // 10
    docs = [(1, " ".join(words)), (2, " ".join(moved)), (3, " ".join(far) + " x" * 400)]
    got = {(r["doc_id"], r["first_doc"]) for r in line_dedup.repeated_lines(frame(spark, docs, "doc_id long, text string")).collect()}
    assert got == {(2, 1)}


def changed(rng, line, share):
    at = rng.sample([k for k, c in enumerate(line) if c != " "], max(1, int(len(line) * share)))
    return "".join(chr(ord("a") + (ord(c) - 96) % 26) if k in at else c for k, c in enumerate(line))


@pytest.mark.parametrize("share", [0, 0.03, 0.05, 0.0999])
def test_recall_of_edit_similar_lines(spark, share):
    """Copies with letters changed at random places; 0 stands for one letter."""
    rng = random.Random(5)
    lines = [" ".join("".join(rng.choices("abcdefghijklmnoprstu", k=rng.randrange(2, 9))) for _ in range(n)) for n in (5, 8, 15, 25, 40, 120) for _ in range(50)]
    docs = [(2 * k + c, changed(rng, x, share) if c else x) for k, x in enumerate(lines) for c in (0, 1)]
    texts = [t for _, t in docs]
    pairs = {(2 * k, 2 * k + 1) for k in range(len(lines))}
    assert all(edits(a, b) <= len(a) // 10 for a, b in list(zip(texts[::2], texts[1::2], strict=True))[:100:7])
    got = {(r["first_doc"], r["doc_id"]) for r in line_dedup.repeated_lines(frame(spark, docs, "doc_id long, text string")).collect()}
    assert got <= pairs and len(got) >= (0.9 if share > 0.05 else 0.97) * len(pairs)


def test_grams_and_keys_of_lines():
    import numpy as np

    data = np.frombuffer(b"abcdefghijklmnopabcdefghijklmnop", np.uint8)
    for size in (1, 2, 3, 5, 7, 8, 12):
        code = line_dedup._grams(data, size)
        assert len(code) == 32 - size + 1 and code[0] == code[16] and len(set(code.tolist())) == 16
    norms = [b"a b c d e", b"one two three four five six seven eight nine ten eleven twelve thirteen", b"a b c d e", b"x" * 30 + b" a b c " + b"y" * 25]
    together = line_dedup.line_keys(norms)
    assert [len(k) for k in together] == [24, 21, 24, 45]
    for norm, keys in zip(norms, together, strict=True):  # the neighbours of a line in its batch do not matter
        assert line_dedup.line_keys([norm])[0].tolist() == keys.tolist()
    assert line_dedup.normalised("One, TWO-three  (4) É!") == "one two three 4 é".encode() and line_dedup.normalised("a b c d") is None
    assert line_dedup.normalised("Page 1 of MANY pages.") == b"page 1 of many pages"


def test_counts_of_grams_reject_no_true_pair():
    rng = random.Random(11)
    for n in (9, 60, 400, 1990, 2005, 5000):
        for _ in range(6):
            a = "".join(rng.choices("abcdé  𝄞ß", k=n))
            b, allowed = list(a), n // 10
            for _ in range(allowed):
                at = rng.randrange(len(b))
                b[at:at + 1] = rng.choice([[], ["x"], [b[at], "y"]])
            assert line_dedup.grams_allow(a, "".join(b), allowed)
    words = ["".join(rng.choices("abcdefghijkl", k=rng.randrange(2, 9))) for _ in range(4000)]
    one, other = (" ".join(rng.sample(words, 3000)) for _ in range(2))
    assert not line_dedup.grams_allow(one, other, len(one) // 20)


def test_no_lines(spark):
    assert line_dedup.dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# ---- quality ---------------------------------------------------------------------------------------------------------

def plain_counts(text):
    text = text or ""
    words = [w for w in text.translate(str.maketrans("\t\n\x0b\x0c\r", "     ")).split(" ") if w]
    windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    often = Counter(windows)
    marked = {j for i, w in enumerate(windows) if often[w] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(marked)


def test_counts_equal_plain_ones(spark):
    rng = random.Random(4)
    texts = [None, "", " \n\t", "a", "one\x0btwo\u00a0three\n\nfour", "é💧 # <b>", "x y z " * 2000, "same\nsame\n same\nsame"]
    texts += [" ".join(rng.choices("ab", k=n)) for n in (7, 8, 9, 20, 60)] + ["q " * 9, " ".join(rng.choices(WORDS, k=300)) * 2]
    got = quality.features(frame(spark, list(enumerate(texts)), "doc_id long, text string")).collect()
    for r in got:
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == plain_counts(texts[r["doc_id"]])


def test_votes_outweigh_each_other(spark):
    rng = random.Random(1)
    good = [" ".join(rng.choices([*WORDS, "the", "of", "and", "with"], k=120)) + "." for _ in range(80)]
    junk = ["#$% &&& " + " ### ".join(rng.choices(WORDS, k=80)) for _ in range(10)] + [(" ".join(rng.choices(WORDS, k=12)) + "!! ").upper() * 12 for _ in range(6)]
    rows = [(k, t, 1, True) for k, t in enumerate(good + junk)] + [(None, None, 1, True), (3, "", 1, True)]
    docs = frame(spark, rows, "doc_id long, text string, n_words int, kept boolean")
    kept = {r["doc_id"] for r in quality.assess(docs).where("kept").collect()}
    assert kept == set(range(80))
    left = quality.good_documents(docs)
    assert left.columns == docs.columns and {r["doc_id"] for r in left.collect()} == kept
    none = docs.where("false")
    assert quality.assess(none).count() == 0 and quality.good_documents(none).count() == 0


# ---- urls ------------------------------------------------------------------------------------------------------------

def test_rules_hosts_and_templates(spark):
    urls = [None, "", "no scheme", "http://", "HTTP://Example.COM/en/1?x#y", "http://www.example.com/en/1", "http://a.example.com/en",
            "http://xexample.com/en/", "http://net/es/1", "x://a.net/fr/", "x://a.net?/fr/", "http://ÄB.org/é"]
    rows = [(k, u, "x", 1) for k, u in enumerate(urls)] + [(0, urls[4], "x", 1), (None, urls[4], "x", 1)]
    got = url_filter.judge_urls(frame(spark, rows, "page_id long, url string, host string, bad int")).collect()
    by = {r["page_id"]: r for r in got}
    assert len(got) == len(rows)
    assert [by[k]["host"] for k in (1, 2, 3, 6)] == ["", "", "", "a.example.com"] and by[11]["host"] == "Äb.org"
    assert [by[k]["rule"] for k in (5, 6, 7, 8, 9, 10, 11)] == [
        "www.example.com/en/", "com/", "com/", "net/es/", "net/fr/", None, None]
    labelled = [(k, f"http://a.net/{('es', 'fr')[k % 2]}/{k}") for k in range(60)] + [(100 + k, f"http://a.net/en/{k}") for k in range(30)]
    labelled += [(200 + k, f"http://b.net/shop/{w}/x") for k, w in enumerate(WORDS)] + [(300, "http://a.net/d/e/f/g/h/i")]
    got = {r["page_id"]: r for r in url_filter.judge_urls(frame(spark, labelled, "page_id long, url string")).collect()}
    assert {got[k]["template"].rstrip("/") for k in range(60)} == {"a.net/~/{n}"}
    assert got[0]["purity"] > 0.9
    assert {got[200 + k]["template"].rstrip("/") for k in range(60)} == {"b.net/shop/*/x"} and got[300]["template"] == "a.net/d/e/f/g/h/i"
    assert url_filter.judge_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_branches_without_labels_take_after_their_siblings(spark):
    rules = (("allow", "ok.org/good/"), ("allow", "ok.org/fine/"), ("block", "bad.org/spam/"), ("block", "bad.org/junk/"), ("block", "ok.org/a/b/c/d/e/f/"))
    urls = [f"http://{h}/{s}/{k}" for h, s in (("ok.org", "good"), ("ok.org", "fine"), ("bad.org", "spam"), ("bad.org", "junk")) for k in range(40)]
    asked = ["http://ok.org/new/1", "http://ok.org/", "http://bad.org/new/1", "http://bad.org/x/y/z/1/2/3/4/5/6", "http://none.org/new/1", "http://a.ok.org/new/1"]
    urls += asked + [f"http://ok.org/a/b/c/d/e/f/{w}" for w in WORDS[:40]] + ["http://ok.org/a/b/c/d/e/g"]
    got = {r["url"]: r for r in url_filter.judge_urls(frame(spark, [(k, u) for k, u in enumerate(urls)], "page_id long, url string"), rules)
           .join(frame(spark, [(k, u) for k, u in enumerate(urls)], "page_id long, url string"), "page_id").collect()}
    assert [got[u]["verdict"] for u in asked] == ["allow", "allow", "block", "block", "allow", "allow"]
    assert got[asked[2]]["rule"] is None and got[asked[2]]["purity"] >= url_filter.REJECT_FROM
    # beyond the fourth segment: 40 bad pages beside it, 80 good ones further up
    assert got["http://ok.org/a/b/c/d/e/g"]["verdict"] == "block" and got["http://ok.org/a/b/c/d/e/g"]["purity"] < 1


def test_templates_of_bad_labels_are_rejected(spark):
    rows = [("h", ["x", "{n}"], True if k < 40 else None) for k in range(50)] + [("h", ["y", "{n}"], False)] * 50 + [("g", [], None)]
    got = url_filter.template_verdicts(spark.createDataFrame(rows, "host string, cut array<string>, bad boolean"))
    assert {(r["host"], r["shape"], r["rejected"]) for r in got.collect()} == {("h", "x/{n}", True), ("h", "y/{n}", False), ("g", "", False)}


# ---- archives --------------------------------------------------------------------------------------------------------

PAGES = [(1, "http://a/\r\nX: y", "same"), (2, None, "same"), (9, "u", "same"), (3, "u", None), (4, "u", ""), (5, "u", "é\r\n\r\nWARC/1.0\r\n"),
         (6, "u", "x" * 300_000), (None, "u", "same"), (7, "u", "twin"), (7, "u", "other"), (7, "u", "twin"), (None, "u", "lone")]


def test_archive_round_trip(spark):
    pages = frame(spark, [(*p, "d") for p in PAGES], "page_id long, url string, html string, digest string")
    folder = shared_folder(spark, "warc")
    index = warc.archive_pages(pages, folder)
    got = Counter(tuple(r) for r in warc.page_digests(index).collect())
    last = {}
    for p, _, h in PAGES:
        if p is not None:
            last[h or ""] = max(p, last.get(h or "", p))
    want = Counter()
    for p, _, h in PAGES:
        raw = (h or "").encode()
        again = p is not None and p < last[h or ""]
        want[p, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if again else "response",
             last[h or ""] if again else None] += 1
    assert got == want
    for r in index.collect():  # every record is a member of its own, and the members are the whole file
        data = read_file(r["path"])
        member = gzip.decompress(data[r["offset"]:r["offset"] + r["length"]])
        assert member.startswith(b"WARC/1.0\r\n") and member.endswith(b"\r\n\r\n")
    sizes = {r["path"]: r["n"] for r in index.groupBy("path").agg(F.sum("length").alias("n")).collect()}
    assert all(len(read_file(p)) == n for p, n in sizes.items())
    none = warc.archive_pages(pages.where("false"), shared_folder(spark, "warc"))
    assert warc.page_digests(none).count() == 0


def test_broken_archives_fail():
    packed = gzip.compress(b"WARC/1.0\r\nContent-Length: 9\r\n\r\nabc")
    with pytest.raises(ValueError, match="ends within a record"):
        list(warc.records(warc.inflated(packed)))
    with pytest.raises((ValueError, zlib.error)):
        list(warc.records(warc.inflated(packed[:-9])))
    both = gzip.compress(b"ab") + gzip.compress(b"cd")
    assert b"".join(warc.inflated(both)) == b"abcd"


# ---- languages -------------------------------------------------------------------------------------------------------

def test_languages(spark):
    rng = random.Random(6)
    kinds = {"aa": ["ba", "do", "ti", "kel"], "bb": ["ßü", "sch", "ung", "ä"], "cc": ["ção", "lh", "ões", "nh"]}
    rows = [(k, "".join(rng.choice([*kinds[lang], " "]) for _ in range(rng.choice([20, 400]))), lang, 0.5) for k, lang in enumerate(list(kinds) * 80)]
    rows += [(900, None, "aa", 0.0), (901, "", "aa", 0.0), (902, "12 +-", "bb", 0.0), (903, "schung", None, 0.0), (None, "schung", "bb", 0.0), (904, "baba " * 50_000, "aa", 0.0)]
    docs = frame(spark, rows, "doc_id long, text string, lang string, score double")
    held = {r["doc_id"] for r in docs.where(language.held_out()).collect()}
    assert held == {d for d, *_ in rows if d is not None and zlib.crc32(str(d).encode()) % 4 == 2}
    model = language.learn(docs.where(~language.held_out()), 120, 30)
    got = {r["doc_id"]: r for r in language.identify(docs, model).collect()}
    tested = [(d, lang) for d, t, lang, _ in rows[:240] if d in held]
    assert sum(got[d]["lang_pred"] == lang for d, lang in tested) >= 0.95 * len(tested)
    assert [got[d]["lang_pred"] for d in (900, 901, 902, 903, 904)] == ["und", "und", "und", "bb", "aa"]
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert {r["lang_pred"] for r in language.identify(docs, None).collect()} == {"und"}
    left = language.known_language(docs)
    assert left.schema == docs.schema and not {900, 901, 902} & {r["doc_id"] for r in left.collect()}
    assert language.learn(docs.where("false")) is None and language.known_language(docs.where("false")).count() == 0
    assert {r["doc_id"] for r in language.known_language(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {d for d, t, *_ in rows if language.has_letter(t)}


def test_copied_languages_are_learned(spark):
    rng = random.Random(8)
    rows = [(" ".join(rng.choices(WORDS, k=20)), lang) for lang in ("aa", "bb") for _ in range(200)]
    rows += [(f"nur {page} eine seite", f"c{page}") for page in range(6) for _ in range(2000)]
    rows += [("12 3", "dd"), (f"{rows[0][0]} 7", "dd")] + [(f"{k} .", "dd") for k in range(3000)]
    got = Counter(lang for lang, _ in language.training_sample(frame(spark, rows, "text string, lang string"), 90))
    assert got == {"aa": 10, "bb": 10, "dd": 1} | {f"c{page}": 1 for page in range(6)}


def test_predictions_equal_plain_kernel_ridge_regression(spark):
    """All training texts as landmarks: the regression is that on the full kernel of common n-grams, worked out with sets."""
    import numpy as np

    rng = random.Random(9)
    kinds = {"aa": ["ba", "do", "ti", "kel", "an"], "bb": ["bo", "da", "ung", "ti", "an"], "cc": ["lh", "nh", "do", "en", "ti"]}
    rows = [(k, "".join(rng.choice([*kinds[lang], " "]) for _ in range(rng.choice([8, 30, 90]))), lang) for k, lang in enumerate(list(kinds) * 25)]
    train, asked = rows[:45], rows[45:]
    model = language.learn(frame(spark, train, "doc_id long, text string, lang string"), 45, 45)
    got = {r["doc_id"]: r["lang_pred"] for r in language.identify(frame(spark, asked, "doc_id long, text string, lang string"), model).collect()}
    grams = lambda t: {t.lower()[i:i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1)}
    kernel = lambda a, b: np.array([[len(x & y) / (len(x) * len(y)) ** 0.5 for y in map(grams, b)] for x in map(grams, a)])
    texts = [t for _, t, _ in train]
    target = np.array([[float(lang == own) for own in kinds] for _, _, lang in train])
    weights = np.linalg.solve(kernel(texts, texts) + language.RIDGE * np.eye(len(texts)), target)
    values = kernel([t for _, t, _ in asked], texts) @ weights
    clear = np.sort(values, axis=1)[:, -1] - np.sort(values, axis=1)[:, -2] > 0.02  # hashed n-grams meet now and then
    assert clear.sum() >= 0.9 * len(asked)
    assert all(got[d] == list(kinds)[v.argmax()] for (d, _, _), v, c in zip(asked, values, clear, strict=True) if c)


def test_landmarks_are_neither_the_shortest_nor_the_longest(spark):
    rng = random.Random(3)
    rows = [(" ".join(rng.choices(WORDS, k=rng.choice([5, 200]))), "aa") for _ in range(400)]
    sample = language.training_sample(frame(spark, rows, "text string, lang string"), 300)
    sizes = [sum(map(int.bit_count, bits)) for _, bits in sample]
    assert len(sample) == 300 and 0.3 < sum(n > 150 for n in sizes[:64]) / 64 < 0.7


def test_kernel_is_the_share_of_common_grams():
    a, b = language.presence("abcab"), language.presence("abd")
    grams = lambda t: {t[i:i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1)}
    assert a.sum() == len(grams("abcab")) and (a & b).sum() == len(grams("abcab") & grams("abd"))
    long = "".join(random.Random(0).choices("abcdefgh ", k=200_000))
    whole = language.presence(long)
    assert whole.sum() == (language.presence(long[:70_000]) | language.presence(long[69_990:140_000]) | language.presence(long[139_990:])).sum()


# ---- pipeline --------------------------------------------------------------------------------------------------------

def test_pipeline_stages_on_odd_rows(spark):
    """Nulls in every column, empty and long texts, repeated rows, names that the operators use, and an empty table."""
    import corpus_pipeline

    rng = random.Random(7)
    good = [" ".join(rng.choices([*WORDS, "the", "of", "and", "with"], k=120)) + "." for _ in range(40)]
    extra = ("v", 1, "g", 2, "q", 3)
    rows = [(k, t, "en", "s", len(t), *extra) for k, t in enumerate(good)] + [(0, good[0], "en", "s", len(good[0]), *extra)] * 2
    rows += [(50, None, None, None, None, *[None] * 6), (None, good[3] + " more", None, "s", None, *extra), (51, "", "en", "s", 0, *extra),
             (52, "12 34 " * 30, "en", "s", 1, *extra), (53, "\n".join(rng.sample(good, 30)) + "\n" + " ".join(rng.choices(WORDS, k=30_000)), "en", "s", 1, *extra)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, votes string, gone int, row string, h int, quality string, `key` int"
    for given in (frame(spark, rows, schema), spark.createDataFrame([], schema)):
        docs = given
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = line_dedup.materialize(stage(spark, docs, ""), "odd-stage")
            assert docs.schema.simpleString() == given.schema.simpleString()
        packed = corpus_pipeline.STAGES[-1][1](spark, docs, "").collect()
        assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in docs.collect()}
        kept = {r["doc_id"] for r in docs.collect()}
        assert not kept & {50, 51, 52} and (not kept or {*range(1, 40)} <= kept)

def test_pipeline_stages(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = line_dedup.materialize(stage(spark, docs, sf), "test-stage")
        assert docs.columns == columns
        assert 0 < docs.count() <= before
        before = docs.count()
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in docs.collect()}
    assert corpus_pipeline.run(spark, sf).count() == len(packed)
    assert corpus_pipeline.ORACLE_SQL is None


def test_written_tables_leave_no_shuffle_files(tmp_path):
    """The write of a chain of tables keeps no shuffle files; run in a session of its own, whose local folder is known."""
    import subprocess
    import sys

    code = f"""
import os, time
from tessera.session import build_session, materialize
spark = build_session("free", "local[2]", spark__ui__enabled="false", spark__local__dir={str(tmp_path / "local")!r},
                      spark__checkpoint__dir={str(tmp_path / "shared")!r}, spark__sql__shuffle__partitions="3")
count = lambda: sum(f.startswith("shuffle_") for _, _, files in os.walk({str(tmp_path / "local")!r}) for f in files)
many = spark.range(20000).selectExpr("id % 700 as k", "id")
few = many.groupBy("k").count()
got = materialize(many.join(few.hint("merge"), "k").distinct(), "joined")
time.sleep(2)
left = count()
assert got.count() == 20000 and few.count() == 700 and materialize(few, "few").count() == 700 and few.count() == 700
print("LEFT", left)
"""
    import os

    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=200, env=os.environ | {"PYTHONPATH": root})
    assert done.returncode == 0, done.stderr[-2000:]
    assert int(done.stdout.split("LEFT")[1].split()[0]) == 0


def test_slices_of_keys_join_the_same_nodes(spark):
    from tessera.llm.graphs import bucket_components

    rng = random.Random(5)
    rows = [(rng.randrange(-40, 40), k % 60, 0) for k in range(150)]
    postings = frame(spark, rows, "key long, node long, print int")
    found = [Counter(map(tuple, bucket_components(postings, lambda a, b: a == b, None, n).collect())) for n in (1, 3)]
    assert found[0] == found[1] and len(found[0]) > 10
