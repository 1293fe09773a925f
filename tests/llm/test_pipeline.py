import random

import corpus_pipeline as P
from keyloom.llm.decontaminate import words
from keyloom.llm.golay_simhash import near_duplicates

DIR = "/root/testdata/sf0.01"


def test_stages(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    kept, before = docs, 1000
    ids = [before]
    for name, stage in P.STAGES[:-1]:
        was = {r.doc_id: r for r in kept.collect()}
        out = stage(spark, kept, DIR)
        assert out.columns == docs.columns
        rows = out.collect()
        now = {r.doc_id: r for r in rows}
        assert len(now) == len(rows) and now.keys() <= was.keys()
        if name == "simhash_dedup":
            groups = {r.doc_id: r.component_id for r in near_duplicates(kept, size=P.COPY_WORDS, bits=P.COPY_BITS, words=2).collect()}
            assert now.keys() == set(groups.values())
        if name == "decontaminate":
            windows = {tuple(w[i : i + 8]) for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect() for w in [words(r.text)] for i in range(len(w) - 7)}
            for r in rows:
                w = words(r.text)
                left = sum(tuple(w[i : i + 8]) in windows for i in range(len(w) - 7))
                assert not left and r.n_chars == len(r.text)
                old = words(was[r.doc_id].text)
                if not any(tuple(old[i : i + 8]) in windows for i in range(len(old) - 7)):
                    assert r == was[r.doc_id]
        else:
            assert all(now[i] == was[i] for i in now)
        ids.append(len(rows))
        kept = spark.createDataFrame(rows, docs.schema) if rows else out
    assert ids[1] >= 990 and ids[2] > 0.8 * ids[1]
    pieces = P.into_sequences(spark, kept, DIR).collect()
    assert {r.doc_id for r in pieces} == {r.doc_id for r in rows}


def test_language_stage(spark):
    rng = random.Random(1)
    en = [(i, " ".join(rng.choices("the of and to in is that for was with".split(), k=60)), "en") for i in range(40)]
    odd = [(100, "日本語の文章です" * 9, None), (101, None, None), (102, "12 34", None)]
    df = spark.createDataFrame(en + odd, "doc_id long, text string, lang string")
    assert {r.doc_id for r in P.by_language(spark, df, DIR).collect()} == set(range(40))
    none = df.selectExpr("doc_id", "text", "cast(null as string) as lang")
    assert {r.doc_id for r in P.by_language(spark, none, DIR).collect()} == {*range(40), 100}
    assert P.by_language(spark, df.limit(0), DIR).count() == 0


def test_run(spark):
    rows = P.run(spark, "/root/testdata/sf0.001").collect()
    assert rows and {"doc_id", "sequence_id", "offset"} <= set(rows[0].asDict())
