import hashlib
import random

from keyloom.llm import decontaminate
from keyloom.llm.decontaminate import cleaned, contamination, words


def brute(docs, items, window):
    out = []
    for i, t in docs:
        seq, hit, found = words(t), set(), set()
        for k, x in items:
            w = words(x)
            if k is None or not w:
                continue
            n = min(window, len(w))
            grams = {tuple(w[a : a + n]) for a in range(len(w) - n + 1)}
            for a in range(len(seq) - n + 1):
                if tuple(seq[a : a + n]) in grams:
                    hit |= set(range(a, a + n))
                    found.add(str(k))
        out.append((i, len(seq), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(found) >= 2))
    return sorted(out, key=str)


def data(seed):
    rng = random.Random(seed)
    draw = lambda n: [rng.choice("abcdé") for _ in range(n)]
    items = [(k, " ".join(draw(rng.randrange(1, 16)))) for k in range(8, 20)] + [(30, None), (31, "!!"), (None, "a b c d")]
    items.append((32, items[3][1]))
    docs = [(i, rng.choice([" ", ", ", "\n"]).join(draw(rng.randrange(0, 60)))) for i in range(40)]
    docs = [(i, t.upper() if i % 3 else t + " " + (items[i % 12][1] or "") + " zz") for i, t in docs] + [(50, None), (None, "a"), (51, ""), (1, docs[1][1])]
    return docs, items


def test_against_brute_force(spark, monkeypatch):
    for seed, window, block, once in ((1, 8, 10**6, 10**6), (2, 4, 10**6, 10**6), (3, 8, 20, 10**6), (4, 8, 20, 40)):
        monkeypatch.setattr(decontaminate, "BLOCK_WORDS", block)
        monkeypatch.setattr(decontaminate, "PASS_WORDS", once)
        docs, items = data(seed)
        a = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as n_words")
        b = spark.createDataFrame(items, "item_id long, text string")
        assert sorted(map(tuple, contamination(a, b, window).collect()), key=str) == brute(docs, items, window)


def test_cleaned(spark):
    item = "one two three four five six seven eight nine"
    docs = [(1, f"Before it. {item.upper()}! After it", 3), (2, item, 3), (3, "clean text", 10), (4, None, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string, n_chars long")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = sorted(map(tuple, cleaned(df, bench).collect()))
    assert got == [(1, "Before it. ! After it", 21), (3, "clean text", 10), (4, None, None)]
    assert cleaned(df.limit(0), bench).count() == 0 and cleaned(df, bench.limit(0)).count() == 4
    assert {r.doc_id for r in cleaned(df, bench, longest=5).collect()} == {3, 4}


def test_cuts_are_looked_at_again(spark, monkeypatch):
    inner, outer = "a b c d e f g h", "one two three four five six seven eight"
    words_ = outer.split()
    docs = [(1, " ".join(["start", *words_[:4], inner, *words_[4:], "end of it all"] + ["more"] * 20)), (2, "one two " + inner + " x" * 40)]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as `a.b`", "2 as c0")
    bench = spark.createDataFrame([(1, inner), (2, outer)], "item_id long, text string")
    for once in (10**6, 8):
        monkeypatch.setattr(decontaminate, "BLOCK_WORDS", 8)
        monkeypatch.setattr(decontaminate, "PASS_WORDS", once)
        got = cleaned(df, bench)
        assert got.columns == df.columns
        texts = {r.doc_id: r.text.split() for r in got.collect()}
        assert texts[1] == ["start", "end", "of", "it", "all"] + ["more"] * 20 and texts[2][:3] == ["one", "two", "x"]


def test_long_text(spark):
    item = " ".join(f"w{i}" for i in range(9))
    df = spark.createDataFrame([(1, "w0 " * 300_000 + item + " w1" * 300_000)], "doc_id long, text string")
    r = contamination(df, spark.createDataFrame([(1, item)], "item_id long, text string")).first()
    assert (r.n_words, r.n_hit, r.n_items) == (600_009, 9, 1)
