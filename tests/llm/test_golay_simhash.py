import random

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from keyloom.llm import golay_simhash
from keyloom.llm.golay_simhash import SEGMENTS, fingerprint, golay, keys_of, linked, near_duplicates


def slow_fingerprint(text):
    seq = "".join(c.lower() if c.isascii() else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        seq = seq.replace(c, " ")
    seq = [w for w in seq.split(" ") if w]
    hs = [xxhash.xxh64_intdigest(" ".join(seq[i : i + 4]), 42) for i in range(max(1, len(seq) - 3))] if seq else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)) if hs else 0


def brute(docs):
    fps = [slow_fingerprint(t) for _, t in docs]
    root = list(range(len(docs)))
    find = lambda i: i if root[i] == i else find(root[i])
    for i in range(len(docs)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        least[find(i)] = min([x for x in (least.get(find(i)), d) if x is not None], default=None)
    return sorted(((d, f"{fps[i]:016x}", least[find(i)]) for i, (d, _) in enumerate(docs)), key=str)


def test_code():
    g = golay()
    words = g.number.astype(int)
    assert len(set(words.tolist())) == 4096 and np.bincount(words).tolist() == [2048] * 4096


@settings(max_examples=300, deadline=None)
@given(st.integers(0, 2**64 - 1), st.sets(st.integers(0, 63), max_size=4))
def test_no_pair_without_a_key(fp, flips):
    other = fp
    for b in flips:
        other ^= 1 << b
    _, a = keys_of(np.array([fp], np.uint64))
    _, b = keys_of(np.array([other], np.uint64))
    assert set(a.tolist()) & set(b.tolist())


def test_segments_cover_all_bits():
    assert [a for a, _ in SEGMENTS] == [0, 22, 43] and sum(n for _, n in SEGMENTS) == 64


def test_links_span():
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(6)]
    fps = np.unique(np.array([b ^ sum(1 << rng.randrange(64) for _ in range(2)) for b in base for _ in range(40)], np.uint64))
    got = [(int(x), int(y)) for a, b in linked(fps[:, None]) for x, y in zip(a[:, 0], b[:, 0], strict=True)]
    root = {int(f): int(f) for f in fps}
    find = lambda i: i if root[i] == i else find(root[i])
    assert len(got) < len(fps)
    for x, y in got:
        root[find(x)] = find(y)
    want = {int(f): int(f) for f in fps}
    find2 = lambda i: i if want[i] == i else find2(want[i])
    for x in fps.tolist():
        for y in fps.tolist():
            if (x ^ y).bit_count() <= 4:
                want[find2(x)] = find2(y)
    assert len({find(int(f)) for f in fps}) == len({find2(int(f)) for f in fps})


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="aB c\n\té ", max_size=60))
def test_fingerprint(text):
    assert fingerprint(text) == (slow_fingerprint(text),)
    assert fingerprint(text, words=2)[0] == slow_fingerprint(text)


def data():
    rng = random.Random(9)
    vocab = ["".join(rng.choices("abcdefgh", k=4)) for _ in range(200)]
    docs = []
    for _ in range(25):
        seq = rng.choices(vocab, k=rng.randrange(5, 300))
        docs.append(seq)
        for _ in range(rng.randrange(0, 6)):
            copy = list(seq)
            copy[rng.randrange(len(copy))] = "Changed"
            docs.append(copy)
    docs = [(i * 3, " ".join(s)) for i, s in enumerate(docs)]
    docs += [(1000 + i, docs[0][1]) for i in range(40)] + [(2001, None), (2000, ""), (2002, " \n"), (None, docs[0][1]), (None, "only one without an id here"), (7, "x"), (7, "x")]
    rng.shuffle(docs)
    return docs


def test_against_brute_force(spark):
    docs = data()
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as fp").repartition(5)
    assert sorted(map(tuple, near_duplicates(df).collect()), key=str) == brute(docs)
    assert near_duplicates(df.limit(0)).count() == 0


def test_wider_fingerprints_find_similar_texts(spark):
    rng = random.Random(11)
    vocab = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(900)]
    docs, same = [], []
    for k in range(60):
        seq = rng.choices(vocab, k=400)
        copy = list(seq)
        for _ in range(4):  # about 0.9 of the five-word shingles stay
            copy[rng.randrange(len(copy))] = "edited"
        docs += [(2 * k, " ".join(seq)), (2 * k + 1, " ".join(copy))]
        same.append((2 * k, 2 * k + 1))
    got = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), size=5, bits=22, words=2).collect()}
    assert sum(got[b] == a for a, b in same) >= 50
    assert all(c in (d, d - d % 2) for d, c in got.items())


def test_long_runs_lose_no_pair(monkeypatch):
    monkeypatch.setattr(golay_simhash, "RUN", 4)
    rng = random.Random(2)
    for kind, (open_, errors) in enumerate(((2, 4), (1, 4), (0, 4), (2, 2), (0, 2), (1, 2))):
        at, n = SEGMENTS[open_]
        for _ in range(50):
            base = rng.getrandbits(64)
            pair = {base, base ^ sum(1 << b for b in rng.sample(range(at, at + n), errors))}
            fps = np.unique(np.array([*pair, *(rng.getrandbits(64) for _ in range(6))], np.uint64))
            found = {frozenset((int(x), int(y))) for a, b in golay_simhash._run_links(fps[:, None], kind) for x, y in zip(a[:, 0], b[:, 0], strict=True)}
            assert frozenset(pair) in found


def test_long_runs_of_wide_fingerprints_lose_no_pair(monkeypatch):
    monkeypatch.setattr(golay_simhash, "RUN", 4)
    rng = random.Random(3)
    at, n = SEGMENTS[2]
    edges = np.linspace(0, n, 7).astype(int)[:-1]
    base = rng.getrandbits(64)
    other = base ^ sum(1 << (at + int(e)) for e in edges)  # differs in each of the six ranges
    fps = np.array([[base, 0], [other, (1 << 16) - 1], *([rng.getrandbits(64), rng.getrandbits(64)] for _ in range(6))], np.uint64)
    found = {frozenset((int(x[0]), int(y[0]))) for a, b in golay_simhash._run_links(fps, 0, 22) for x, y in zip(a, b, strict=True)}
    assert found == {frozenset((base, other))}


def test_lone_pairs_are_joined_by_their_shingles(spark):
    """Pairs of 0.82 are joined, pairs of 0.74 are not, whatever bits their fingerprints differ in."""
    rng = random.Random(13)
    vocab = ["".join(rng.choices("abcdefgh", k=6)) for _ in range(5000)]
    docs = []
    for k in range(100):
        seq = rng.choices(vocab, k=404)
        copy = list(seq)
        for i in range(10, 400, 390 // (8 if k < 50 else 12))[: 8 if k < 50 else 12]:  # five shingles each
            copy[i] = "edited"
        docs += [(2 * k, " ".join(seq)), (2 * k + 1, " ".join(copy))]
    docs += [(300, "a b c"), (301, "A  b c"), (302, "a b d"), (303, None), (304, ""), (None, docs[0][1]), (0, docs[0][1])]
    got = near_duplicates(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), size=5, bits=44, words=3).collect()
    assert len(got) == len(docs)
    by = {r.doc_id: r.component_id for r in got}
    assert sum(by[2 * k + 1] == 2 * k for k in range(50)) >= 48
    assert all(by[2 * k + 1] == 2 * k + 1 for k in range(50, 100))
    assert (by[300], by[301], by[302], by[303], by[304], by[None]) == (300, 300, 302, 303, 303, 0)


def test_alike_against_all_pairs():
    rng = np.random.default_rng(4)
    sets = []
    for _ in range(12):
        base = rng.integers(0, 400, 60)
        for _ in range(6):
            base = base.copy()
            base[rng.integers(0, 60, 4)] = rng.integers(0, 400, 4)
            sets.append(np.unique(base).astype(np.uint64))
    sets.append(np.zeros(0, np.uint64))
    root = list(range(len(sets)))
    find = lambda i: i if root[i] == i else find(root[i])
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            both = len(np.intersect1d(a, b))
            if 5 * both >= 4 * (len(a) + len(b) - both) and both:
                root[find(i)] = find(j)
    got = golay_simhash.alike(sets, 0.8).tolist()
    assert all((got[i] == got[j]) == (find(i) == find(j)) for i in range(len(sets)) for j in range(i))
