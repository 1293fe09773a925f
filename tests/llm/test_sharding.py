import hashlib
import random
import zlib
from collections import defaultdict

from keyloom.llm.sharding import byte_shards


def brute(rows, shards):
    rows = sorted(rows, key=lambda r: (hashlib.md5((r[1] or "").encode()).hexdigest(), r[0] is not None, r[0] or 0))
    sizes = [len((t or "").encode()) + 8 for _, t in rows]
    total, at, slots, out = sum(sizes), 0, defaultdict(int), []
    for (i, t), s in zip(rows, sizes, strict=True):
        k = min((2 * at + s) * shards // (2 * total), shards - 1)
        out.append((i, s, zlib.crc32((t or "").encode()), k, slots[k]))
        slots[k] += 1
        at += s
    return out


def test_against_brute_force(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice(["", None, "x" * rng.randrange(900), "née " * 40])) for i in range(400)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7).selectExpr("*", "1 as size", "'a' as law")
    got = byte_shards(df, 24).collect()
    assert sorted((r.doc_id, r.size, r.text_crc32, r.shard, r.slot) for r in got) == sorted(brute(rows, 24))
    assert {(r.law, r.grown_shard) for r in got} == {("bytes", None)}


def test_cases(spark):
    one = spark.createDataFrame([(5, "a")] * 50 + [(None, None)], "doc_id long, text string")
    got = byte_shards(one, 4).collect()
    assert len(got) == 51 and {r.shard for r in got} == {0, 1, 2, 3}
    for s in range(4):
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots)))
    assert byte_shards(one.limit(0)).count() == 0


def test_equal_texts_stay_together(spark):
    rng = random.Random(3)
    rows = [(i, f"text {rng.randrange(60)} " * 5) for i in range(600)]
    got = byte_shards(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), 10).collect()
    at, said = defaultdict(set), dict(rows)
    for r in got:
        at[said[r.doc_id]].add(r.shard)
    # nine cuts part nine groups at most
    assert sum(len(x) > 1 for x in at.values()) <= 9 and sum(map(len, at.values())) <= 60 + 9
