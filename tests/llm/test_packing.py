import math
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from keyloom.llm import packing
from keyloom.llm.common import kept_by_worker, let_go, texts
from keyloom.llm.packing import Index, WordEncoder, pack_shard, packed

PATH = public_tokenizers.path("word_bpe_49k.json")
T = Tokenizer.from_file(PATH)
E = WordEncoder(PATH)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="aB thE's.,!12é́ÅΣς\n\x1c\xa0日<|endoftext|>_", max_size=40))
def test_ids(text):
    assert E([text])[0].tolist() == T.encode(text, add_special_tokens=False).ids


@settings(max_examples=1500, deadline=None)
@given(st.lists(st.tuples(st.text(max_size=4), st.sampled_from(["İ", "ŉ", "Σ", "ß", "क़", "é", "ﬁ", "a", ""]), st.text(alphabet=".,;!'-\u0301 1", max_size=3)), max_size=5))
def test_ids_of_any_letters(parts):
    text = "".join(map("".join, parts))
    assert E([text])[0].tolist() == T.encode(text, add_special_tokens=False).ids


@settings(max_examples=1500, deadline=None)
@given(st.text(alphabet="aBstdZéßÿÀªºµ×÷²½'.,!_-|12 \n\t\xa0\x85\xad", max_size=30))
def test_ids_of_latin_letters(text):
    assert E([text])[0].tolist() == T.encode(text, add_special_tokens=False).ids


def test_spellings_of_a_word_are_remembered_once():
    """A memo of spellings is full so soon that most of its words are met again as new ones."""
    encoder, marks = WordEncoder(PATH), ["", ",", ".", "!?", "...", ')"']
    text = " ".join(w + m for w in ("naïve", "Naïve", "word", "WORD", "time") for m in marks)
    assert encoder([text])[0].tolist() == T.encode(text, add_special_tokens=False).ids
    assert set(encoder.memo) == {"naïve", "word", "time", *marks[1:]}


def test_special_strings():
    for text in ("BELEDİYESİ.", "TARİHİ, x", "क़.", "x" * 500 + ".", "a<|endoftext|>b", "<|startoftext|>", "Don't STOP...,. it's 12.5%", "tion.Nd,"):
        assert E([text])[0].tolist() == T.encode(text, add_special_tokens=False).ids


def test_neighbours_are_the_alike():
    docs = [np.array(x, "<u2") for x in ([1, 2, 3, 9], [50, 51, 52], [1, 2, 3, 8], [50, 51, 60], [7])]
    ix = Index(docs)
    assert ix.neighbours(0)[:2].tolist() == [0, 2] and sorted(ix.neighbours(3).tolist()) == [1, 3] and ix.neighbours(4).tolist() == []


def test_scores_are_bm25():
    rng = np.random.default_rng(3)
    docs = [rng.choice(40, rng.integers(1, 30), p=np.arange(40, 0, -1) / 820).astype("<u2") for _ in range(60)]
    ix, mean, has = Index(docs), np.mean([len(d) for d in docs]), [set(d.tolist()) for d in docs]
    for seed in range(60):
        score = np.zeros(60)
        for t in has[seed]:
            df = sum(t in h for h in has)
            for k, d in enumerate(docs):
                tf = int((d == t).sum())
                if tf and df > 1:
                    score[k] += math.log(1 + (60 - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(d) / mean))
        got = ix.neighbours(seed)
        assert set(got.tolist()) == set(np.flatnonzero(score > 0).tolist())
        assert (np.diff(score[got]) <= 1e-5).all()


def check(rows, docs, window):
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    padding = 0
    for rs in sequences.values():
        at = 0
        for r in sorted(rs, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= window
        padding += 0 if at & (at - 1) == 0 else window - at
    assert padding == 0
    for d, text in docs:
        ids = T.encode(text or "", add_special_tokens=False).ids + [2]
        at = 0
        for r in sorted(pieces[d], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            part = np.array(ids[at : at + r.length], "<u4").tobytes()
            assert r.ids_crc32 == zlib.crc32(part) and r.ids == part
            at += r.length
        assert at == len(ids)


def test_packed(spark):
    rng = random.Random(4)
    vocab = ["".join(rng.choices("abcdefgh", k=rng.randrange(1, 9))) for _ in range(300)]
    docs = [(i, " ".join(rng.choices(vocab, k=rng.choice([0, 3, 20, 200])))) for i in range(150)] + [(900, None), (901, ""), (902, "word " * 500)]
    df = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as length").repartition(3)
    for shard in (1 << 20, 500):
        check(packed(df, PATH, window=64, shard_tokens=shard, with_ids=True).collect(), docs, 64)
    assert packed(df.limit(0), PATH).count() == 0
    twice = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c")], "doc_id long, text string")
    assert sum(r.length for r in packed(twice, PATH).collect()) == 8


def test_shard_of_long_documents():
    docs = [np.arange(n) % 100 for n in (1000, 1, 64, 65, 63)]
    for window in (64, 48):
        out = pack_shard(docs, window)
        assert sum(n for s in out for _, _, n in s) == 1193
        assert all(sum(n for _, _, n in s) == window for s in out[:-11])


def test_windows_of_short_documents_are_filled_by_retrieval():
    """100 documents of a topic among others: more than 64 fit, and none is taken in the table's order."""
    docs = [np.array([1000 + i % 2, 2000 + i, 2500 + i], "<u2") for i in range(200)]
    out = pack_shard(docs, 256)
    assert [{d % 2 for d, _, _ in x[:84]} for x in out[:1]] == [{0}]


def test_all_terms_of_a_seed_score():
    seed = np.arange(100, 200, dtype="<u2")
    docs = [seed, *(np.array([t], "<u2") for t in seed), *(np.array([100 + k, 300 + k], "<u2") for k in range(100))]
    assert set(Index(docs).neighbours(0).tolist()) == set(range(len(docs)))


def test_alike_documents_meet_wherever_the_table_has_them(spark):
    rng = random.Random(8)
    words = "time year people way day man thing woman life child world school state family student group country problem hand part place case week company system program question work number night point home water room mother area money story fact month lot right study book eye job word business issue side kind head house service friend father power hour game line end member law car city community name".split()
    topics = [rng.sample(words, 12) for _ in range(16)]
    docs = [(100 * half + k, " ".join(rng.sample(t, 12) * 2)) for half in range(2) for k, t in enumerate(topics)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartitionByRange(8, "doc_id")
    rows = packed(df, PATH, window=64, shard_tokens=100, with_ids=True).collect()
    check(rows, docs, 64)
    at = defaultdict(set)
    for r in rows:
        at[r.doc_id].add(r.sequence_id >> 32)
    assert sum(bool(at[k] & at[100 + k]) for k in range(16)) >= 12


def test_memo_is_bounded_and_keeps_what_comes_again(monkeypatch):
    """A batch's words may be new every time; those that return are not encoded twice."""
    monkeypatch.setattr(packing, "MEMO", 400)
    encoder, plain, asked = WordEncoder(PATH), WordEncoder._plain, []
    monkeypatch.setattr(WordEncoder, "_plain", lambda self, w: asked.append(w) or plain(self, w))
    letters = [a + b + c for a in "abcdefghij" for b in "klmnopqrst" for c in "uvwxyz"]
    for k in range(30):
        text = " ".join(["constant", *(f"{x}{y}" for x in letters[k * 10 : k * 10 + 10] for y in "abcdefghij")])
        assert encoder([text])[0].tolist() == T.encode(text, add_special_tokens=False).ids
        assert len(encoder.memo) + len(encoder.older) <= 2 * (packing.MEMO + 101)
    assert asked.count("constant") == 1
    assert len(asked) == 3001


def test_memo_of_a_worker_is_small():
    """Two workers' memos must fit beside an executor's JVM: 800,000 distinct words came to more than a quarter of that room."""
    encoder = WordEncoder(PATH)
    for at in range(0, 800_000, 40_000):
        encoder([" ".join("".join(chr(97 + n // 26**p % 26) for p in range(5)) for n in range(at, at + 40_000))])
    assert sum(len(v) for v in vars(encoder).values() if isinstance(v, dict)) < 700_000


def test_long_words_and_their_parts_are_not_kept():
    encoder = WordEncoder(PATH)
    text = " ".join(["x" * 500 + ".", "y" * 300, "Z" * 200, "short,"])
    assert encoder([text])[0].tolist() == T.encode(text, add_special_tokens=False).ids
    assert max(map(len, encoder.memo)) < packing.LONG


def test_what_a_worker_keeps_can_go():
    assert kept_by_worker("test", lambda: 1) == kept_by_worker("test", lambda: 2) == 1
    let_go()
    assert kept_by_worker("test", lambda: 2) == 2
    let_go()


def test_batches_are_bounded(spark):
    """An executor holds a batch of each task several times over."""
    df = texts(spark.range(64, numPartitions=1).selectExpr("repeat('x', 200000 + cast(id as int)) as text"), "text")
    sizes = df.mapInArrow(lambda bs: (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"]) for b in bs), "n long").collect()
    assert 64 * 200_000 < sum(r.n for r in sizes) and max(r.n for r in sizes) < 3 << 20
