import zlib

import numpy as np

from keyloom.llm.common import hash_bound
from keyloom.llm.language_id import AT_ONCE, DIM, Space, languages

DATA = "/root/testdata/sf0.01/documents.parquet"


def test_bundles_match_the_definition():
    s = Space()
    text = "Ab, c!"
    letters = " ab c "
    slow = np.zeros(DIM)
    for a, b, c in zip(letters, letters[1:], letters[2:], strict=False):
        va, vb, vc = (s.letter_vector(ord(x)).astype(float) for x in (a, b, c))
        slow += np.roll(va, 2) * np.roll(vb, 1) * vc
    got = s.bundles([text, None, "12 !"])
    assert np.allclose(got[0], slow / np.linalg.norm(slow), atol=1e-5) and not got[1:].any()


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(DATA)
    got = languages(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == 1000
    held = [r for r in got if r.held_out]
    assert {r.doc_id for r in held} == {r.doc_id for r in got if zlib.crc32(str(r.doc_id).encode()) % 4 == 2}
    assert sum(r.lang_pred == r.lang for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in got)


def test_cases(spark):
    rows = [(i, t, lang, 0.5) for i, (t, lang) in enumerate([("the cat and the dog", "en"), ("der hund und die katze", "de")] * 10)]
    rows += [(100, None, "en", 1.0), (101, "12 %%", "de", 1.0), (102, "the dog", None, 1.0), (None, "die katze", "de", 1.0), (103, "the dog " * 50_000, None, 0.0), (102, "the dog", None, 1.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    got = [tuple(r)[:3] + (r.score == 0,) for r in languages(df).collect()]
    assert len(got) == len(rows)
    pick = lambda i: {g[2:] for g in got if g[0] == i}
    assert pick(100) == pick(101) == {("und", True)} and pick(102) == pick(103) == {("en", False)} and pick(None) == {("de", False)}
    assert {r.lang_pred for r in languages(df.withColumn("lang", df.lang.substr(9, 1)).where("lang is null")).collect()} == {"und"}
    assert languages(df.limit(0)).count() == 0


def test_sample_of_huge_tables():
    whole = 1 << 64
    for n in (1, 1999, 2001, 3 * 10**9, 10**10, 10**13):
        share = (hash_bound(n, -(1 << 63), 2000) + (1 << 63)) / whole
        assert share > 0 and abs(share * n - min(n, 2000)) < 1
    assert hash_bound(10**15, 7, 1) == 7


def test_long_text_by_parts():
    s = Space()
    text = "".join(map(chr, np.random.default_rng(0).integers(0x4E00, 0x9FA5, 20_000)))
    keys, count = s.counts(text)
    assert len(keys) > 2 * AT_ONCE
    got = s.bundles([text])[0]
    slow = np.zeros(DIM)
    for k, n in zip(keys.tolist(), count.tolist(), strict=True):
        a, b, c = (s.letter_vector(k >> at & 0x1FFFFF).astype(float) for at in (42, 21, 0))
        slow += np.sqrt(n) * np.roll(a, 2) * np.roll(b, 1) * c
    assert np.allclose(got, slow / np.linalg.norm(slow), atol=1e-4)


def test_scores_match_the_definition(spark):
    """Prototypes, cosine and choice against bundles written out."""
    docs = spark.read.parquet(DATA).where("doc_id < 300")
    rows, s = docs.collect(), Space()
    proto = {}
    for r in rows:
        if r.lang and r.text is not None and zlib.crc32(str(r.doc_id).encode()) % 4 != 2:
            proto[r.lang] = proto.get(r.lang, 0) + s.bundles([r.text])[0].astype(float)
    names = sorted(proto)
    unit = np.array([proto[n] / np.linalg.norm(proto[n]) for n in names])
    want = {r.doc_id: unit @ s.bundles([r.text])[0] for r in rows}
    for r in languages(docs).collect():
        cos = want[r.doc_id]
        assert (r.lang_pred == names[cos.argmax()] and abs(r.score - min(1, max(0, cos.max()))) < 1e-4) or not cos.any()


def test_gram_vectors_take_a_byte_a_component():
    space = Space()
    space.bundles(["the quick brown fox jumps over the lazy dog"])
    assert len(space.keys) and space.grams.nbytes == len(space.keys) * space.grams.shape[1]
