"""The engine against a plain model, and the parts that no query shows."""

import random
import struct

import pytest
from pyspark.sql import functions as F

from keyloom.functions import bytes as fmt
from keyloom.functions import histogram, keys
from keyloom.operators import changelog, compaction, lookup, scan, segments, view
from keyloom.operators.changelog import schema
from keyloom.operators.ranges import following, numbered, running_sum
from keyloom.sources import store as store_module
from keyloom.sources import wal
from keyloom.sources.files import Corruption, Files, InvalidArgument, NotFound, NotSupported, StoreIOError, file_name, parse_name
from keyloom.sources.store import Manifest, Options, Store, destroy


def model_live(ops, as_of):
    live = {}
    for k, s, op, v in ops:
        if s <= as_of:
            if op:
                live[k] = (s, v)
            else:
                live.pop(k, None)
    return sorted((k, s, v) for k, (s, v) in live.items())


def random_log(seed, n=300):
    rng = random.Random(seed)
    return [(str(rng.randrange(30)), i + 1, op, float(i) if op else None) for i in range(n) for op in [int(rng.random() < 0.7)]]


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("seed", [1, 2])
def test_views_and_rewrites(spark, seed):
    ops = random_log(seed)
    log = spark.createDataFrame(ops, schema())
    for as_of in (1, 100, 300):
        assert rows(view.live(log, as_of)) == rows(view.live_by_max(log, as_of)) == sorted(model_live(ops, as_of), key=str)
    small = 150
    kept = compaction.kept(log, small)
    counts = compaction.drop_counts(log, small).first()
    assert counts.read - counts.dropped == counts.written == kept.count()
    new = compaction.rewritten(log, small, 20, n=3)
    for as_of in (150, 200, 300):
        assert rows(view.live(kept, as_of)) == rows(view.live(new, as_of)) == sorted(model_live(ops, as_of), key=str)
        assert rows(view.live(compaction.purged(log, small), as_of)) == sorted(model_live(ops, as_of), key=str)
    assert segments.islands(segments.manifest(new)).agg(F.max(F.col("island")), F.count("*")).first() == (new.select("segment_id").distinct().count(),) * 2


def test_ranges_hide_nothing(spark):
    ops = random_log(3)
    live = view.live(spark.createDataFrame(ops, schema()))
    targets = spark.createDataFrame([(str(i),) for i in range(-2, 40)] + [("3",)], "target string")
    for n in (1, 4):
        for forward in (True, False):
            want = set()
            names = sorted(k for k, _, _ in model_live(ops, 300))
            for (t,) in set(map(tuple, targets.collect())):
                near = [k for k in names if (k >= t if forward else k < t)]
                want.add((t, (min(near) if forward else max(near)) if near else None))
            got = scan.seek_many(live, targets, forward, n)
            assert {(r.target, r.found_key) for r in got.collect()} == want
        names = sorted(k for k, _, _ in model_live(ops, 300))
        assert rows(scan.neighbours(live, n)) == sorted(zip(names, [None, *names[:-1]], [*names[1:], None], strict=True), key=str)
        same = spark.range(100).select(F.lit(1).alias("a"), "id")
        assert [r.seq for r in numbered(same, [F.col("a"), F.col("id")], 10, n=n).orderBy("id").collect()] == list(range(11, 111))
    probes = spark.createDataFrame([(str(i),) for i in range(40)], "user_key string")
    m = segments.manifest(segments.cut(spark.createDataFrame(ops, schema()), 30))
    assert rows(segments.stab(m, probes)) == rows(segments.stab(m, probes, 5))


def test_store_against_model(spark, tmp_path):
    rng = random.Random(5)
    at = f"file://{tmp_path}/s"
    store = Store.open(spark, at, Options(segment_rows=10))
    ops, held, seq = [], [], 0
    for step in range(14):
        what = ("put", "delete", "flush", "snapshot", "compact", "put", "reopen", "release", "vacuum", "delete", "flush", "compact", "put", "compact_range")[step]
        if what in ("put", "delete"):
            picked = sorted({f"k{rng.randrange(25):02d}" for _ in range(12)})
            new = [(k, seq + i + 1, int(what == "put"), float(seq + i) if what == "put" else None) for i, k in enumerate(picked)]
            df = spark.createDataFrame([(k, v) for k, _, _, v in new], "user_key string, value double")
            store.put(df) if what == "put" else store.delete(df.select("user_key"))
            ops, seq = ops + new, seq + len(new)
        elif what == "snapshot":
            held.append(store.snapshot())
        elif what == "release" and held:
            store.release(held.pop())
        elif what == "reopen":
            store = Store.open(spark, at, Options(create_if_missing=False, segment_rows=10))
        else:
            {"flush": store.flush, "compact": store.maybe_compact, "vacuum": store.vacuum, "compact_range": store.compact_range}.get(what, list)()
        for s in [seq, *held]:
            assert rows(store.live(s)) == model_live(ops, s), what
    assert [r.user_key for r in store.scan("k05", "k15", reverse=True).collect()] == [k for k, _, _ in reversed(model_live(ops, seq)) if "k05" <= k < "k15"]
    probe = spark.createDataFrame([("k01",), ("nope",)], "user_key string")
    assert {r.user_key: r.found for r in store.get(probe).collect()} == {"k01": "k01" in {k for k, _, _ in model_live(ops, seq)}, "nope": False}
    assert store.stats()["last_seq"] == seq and store.stab(probe).count() >= 1
    sizes = store.approximate_sizes(spark.createDataFrame([(None, "k10"), ("k10", None), (None, None)], "start string, limit string")).collect()
    total = {(r.start, r.limit): r.bytes for r in sizes}
    assert total[None, "k10"] + total["k10", None] == total[None, None] > 0
    store.flush()
    store.vacuum()
    before = rows(store.live())
    store.repair()
    assert rows(store.live()) == before
    with pytest.raises(InvalidArgument):
        Store.open(spark, at, Options(error_if_exists=True))
    with pytest.raises(InvalidArgument):
        Store.open(spark, at, Options(codec="decimal-16"))
    with pytest.raises(NotSupported, match="not supported"):
        Options(codec="other")
    with pytest.raises(Exception, match="a key is null"):
        store.put(spark.createDataFrame([(None, 1.0)], "user_key string, value double"))
    destroy(spark, at)
    destroy(spark, at)
    with pytest.raises(NotFound):
        Store.open(spark, at, Options(create_if_missing=False))


def test_old_snapshot_reads_its_own_key(spark, tmp_path):
    """Every version of k1 is newer than the snapshot: its read finds nothing, not the next key's value."""
    store = Store.open(spark, f"file://{tmp_path}/s")
    store.put(spark.createDataFrame([("k2", 2.0)], "user_key string, value double"))
    with store.held() as s:
        store.put(spark.createDataFrame([("k1", 1.0)], "user_key string, value double"))
        store.flush()
        assert [(r.user_key, r.found) for r in store.get(spark.createDataFrame([("k1",)], "user_key string"), s).collect()] == [("k1", False)]


def test_lost_race_is_numbered_on(spark, tmp_path, monkeypatch):
    store = Store.open(spark, f"file://{tmp_path}/s")
    df = spark.createDataFrame([("a", 1.0)], "user_key string, value double")
    create, raced = store.files.create, []

    def slow(name, text):
        if not raced:
            raced.append(1)
            Store.open(spark, store.root).put(spark.createDataFrame([("b", 2.0)], "user_key string, value double"))
        return create(name, text)

    monkeypatch.setattr(store.files, "create", slow)
    store.put(df)
    assert rows(store.live()) == [("a", 2, 1.0), ("b", 1, 2.0)]


def test_streams_apply_once(spark, tmp_path):
    store = Store.open(spark, f"file://{tmp_path}/s")
    df = spark.createDataFrame([("a", 1, 1.0)], "user_key string, op int, value double")
    for epoch in (0, 0, 1, 0):
        store.write(df, [F.col("user_key")], ("q", epoch))
    assert store.manifest().last_seq == 2
    with pytest.raises(Corruption):
        Manifest.loads("{")


def test_byte_formats():
    assert fmt.crc32c(b"123456789") == 0xE3069283 and fmt.crc32c(b"TestCRCBuffer") == 0xDCBC59FA
    data = [b"", b"a", b"123456789", bytes(range(256)) * 3]
    assert fmt.crc32c_many(data).tolist() == [fmt.crc32c(x) for x in data]
    assert fmt.crc32c(b"6789", fmt.crc32c(b"12345")) == 0xE3069283
    for n in (0, 1, 127, 128, 2**32 - 1, 2**63):
        assert fmt.get_varint(fmt.put_varint(n)) == (n, len(fmt.put_varint(n)))
        assert fmt.unmasked(fmt.masked(n % 2**32)) == n % 2**32 != fmt.masked(n % 2**32)
    assert fmt.get_varint(b"\x80") is None and fmt.get_slice(b"\x05ab") is None and fmt.get_slice(b"\x02abc") == (b"ab", 3)
    assert fmt.separator(b"abcd", b"abzz") == b"abd" and fmt.separator(b"ab", b"abc") == b"ab" and fmt.successor(b"\xff\xffa") == b"\xff\xffb" and fmt.successor(b"\xff") == b"\xff"
    assert fmt.escaped(b"a\x00\xff") == "a\\x00\\xff" and fmt.lcg(0, 1) == 16807 and fmt.lcg(301, 2) == 301 * 16807 * 16807 % 2147483647
    assert keys.prefix_end(b"a\xff") == b"b" and keys.prefix_end(b"\xff") is None
    assert len(histogram.LIMITS) == 154 and histogram.LIMITS[-2:] == [9e9, 1e200]
    for kind, n in (("manifest", 3), ("log", 12), ("segments", 7)):
        assert parse_name(file_name(kind, n)) == (kind, n)
    assert parse_name("x.log") is None


def test_key_expressions(spark):
    df = spark.createDataFrame([("12a",), ("18446744073709551615x",), ("18446744073709551616",), ("",), ("x1",), ("007",)], "t string")
    got = [r.c and (int(r.c.number), r.c.rest) for r in df.select(keys.consume_decimal(F.col("t")).alias("c")).collect()]
    assert got == [(12, "a"), (2**64 - 1, "x"), None, None, None, (7, "")]
    k = spark.createDataFrame([(b"\x00k", 2**40 + 3, 1), (b"", 1, 0)], "k binary, s long, o int")
    packed = k.select("*", keys.internal_key(F.col("k"), F.col("s"), F.col("o")).alias("i"))
    assert [bytes(r.i) for r in packed.collect()] == [bytes(r.k) + struct.pack("<Q", r.s << 8 | r.o) for r in k.collect()]
    back = packed.select(keys.parse_internal_key(F.col("i")).alias("p")).collect()
    assert [(bytes(r.p.user_key), r.p.seq, r.p.op) for r in back] == [(b"\x00k", 2**40 + 3, 1), (b"", 1, 0)]
    bad = spark.createDataFrame([(b"short",), (b"x" + struct.pack("<Q", 1 << 8 | 7),)], "i binary")
    assert [r.p for r in bad.select(keys.parse_internal_key(F.col("i")).alias("p")).collect()] == [None, None]


def test_wal(spark, tmp_path):
    rng = random.Random(8)
    batches = [wal.encode_batch(i * 10 + 1, [(1, f"k{j}".encode(), bytes(rng.randrange(0, 9000))) if rng.random() < 0.8 else (0, b"gone", None) for j in range(10)]) for i in range(12)]
    data = wal.encode_records(batches)
    assert [r for _, r, _, _ in wal.decode_records(data)] == batches
    assert [r for _, r, _, _ in wal.decode_records(data[:-5])] == batches[:-1]  # a cut tail is no trouble
    assert list(wal.decode_records(bytes(wal.BLOCK) + b"")) == []
    broken = bytearray(data)
    broken[20] ^= 1
    got = list(wal.decode_records(bytes(broken)))
    assert got[0][2:] == (wal.DAMAGED, wal.BLOCK) and [r for _, r, t, _ in got if not t] == batches[-len([r for _, r, t, _ in got if not t]):]
    lost = data[wal.BLOCK:]
    assert next(wal.decode_records(lost))[2] == wal.HEADLESS
    later = [o for o, r, _, _ in wal.decode_records(data) if o >= wal.BLOCK]
    for start in (wal.BLOCK, wal.BLOCK - 6):
        assert [o for o, r, _, _ in wal.decode_records(data, start) if r is not None] == later
    first = later[0] + 1
    assert [o for o, r, _, _ in wal.decode_records(data, first) if r is not None] == later[1:]
    cut = wal.encode_records([b"x" * 40_000])[: wal.BLOCK] + wal.encode_records([b"next"])
    assert list(wal.decode_records(cut)) == [(0, None, wal.ENDLESS, wal.BLOCK - 7), (wal.BLOCK, b"next", "", 0)]
    odd = bytearray(wal.encode_records([b"ab", b"cd"]))
    odd[4:6] = b"\xff\xff"
    assert [t for *_, t, _ in wal.decode_records(bytes(odd) + bytes(wal.BLOCK))] == [wal.OVERLONG]
    kind9 = struct.pack("<IHB", fmt.masked(fmt.crc32c(b"\x09zz")), 2, 9) + b"zz"
    assert list(wal.decode_records(kind9 + wal.encode_records([b"ok"]))) == [(0, None, wal.STRANGE, 2), (9, b"ok", "", 0)]
    for bad in (b"short", struct.pack("<QI", 1, 2) + b"\x00\x01a", struct.pack("<QI", 1, 1) + b"\x07\x01a", struct.pack("<QI", 1, 1) + b"\x01\x01a"):
        with pytest.raises(Corruption):
            wal.decode_batch(bad)
    (tmp_path / "000001.log").write_bytes(data)
    (tmp_path / "000002.log").write_bytes(bytes(broken))
    df = wal.read_wal(spark, f"file://{tmp_path}")
    good = df.where("path like '%000001.log'").orderBy("seq").collect()
    assert [(r.seq, r.op, bytes(r.user_key)) for r in good] == [(s, op, k) for b in batches for s, op, k, _ in wal.decode_batch(b)]
    assert df.where("_corrupt is not null").count() >= 1
    with pytest.raises(Exception, match="checksum"):
        wal.read_wal(spark, f"file://{tmp_path}", paranoid=True).collect()


def test_smoke_order(spark):
    """Unpadded decimals are in byte order, forward and backward; after deleting all nothing is left."""
    n = 2000
    put = spark.range(1, n + 1).selectExpr("cast(id as string) user_key", "id as seq", "1 as op", "cast(id + 1 as double) as value")
    want = sorted(map(str, range(1, n + 1)))
    assert [r.user_key for r in scan.range_scan(view.live(put)).collect()] == want
    assert [r.user_key for r in scan.range_scan(view.live(put), reverse=True).collect()] == want[::-1]
    gone = put.selectExpr("user_key", f"seq + {n} as seq", "0 as op", "cast(null as double) as value")
    assert view.live(put.unionByName(gone)).count() == 0 and view.live(put.unionByName(gone), n).count() == n


def test_order_operators_do_not_depend_on_ranges(spark):
    ops = random_log(11)
    log = spark.createDataFrame(ops, schema())
    m = segments.manifest(segments.cut(log, 20))
    probes = spark.createDataFrame([(str(i),) for i in range(-3, 40)], "user_key string")
    for build in (
        lambda n: segments.stab(m, probes, n), lambda n: segments.overlap_counts(m, probes, n), lambda n: segments.mountains(m, n), lambda n: segments.islands(m, n),
        lambda n: segments.windows(m, probes, n), lambda n: segments.next_starts(m, probes, "25", 200, n), lambda n: segments.containing(m, probes.selectExpr("user_key lo", "concat(user_key, '5') hi"), n),
        lambda n: lookup.asof_get(log, probes.selectExpr("user_key", "explode(array(0L, 1L, 77L, 150L, 400L)) as_of_seq"), n), lambda n: following(log, [F.col("user_key"), F.col("seq")], F.col("op"), "was", n),
        lambda n: running_sum(log, [F.col("seq")], F.col("op"), "upto", n),
    ):
        assert rows(build(1)) == rows(build(7))
    live = {as_of: {k: v for k, _, v in model_live(ops, as_of)} for as_of in (0, 1, 77, 150, 400)}
    for r in lookup.asof_get(log, probes.selectExpr("user_key", "explode(array(0L, 1L, 77L, 150L, 400L)) as_of_seq"), 5).collect():
        assert (r.found, r.value) == (r.user_key in live[r.as_of_seq], live[r.as_of_seq].get(r.user_key))
    spans = [(r.inf_key, r.sup_key) for r in m.collect()]
    for r in segments.overlap_counts(m, probes, 6).collect():
        assert r.overlaps == sum(a <= r.probe <= b for a, b in spans)


def test_hot_key_is_read_over_ranges(spark):
    """One key with nearly all versions: compaction and history across range edges."""
    log = spark.createDataFrame([("hot" if i % 50 else f"k{i}", i, i % 3 and 1, float(i)) for i in range(1, 2001)], "user_key string, seq long, op int, value double")
    prev, want = {}, set()
    for k, s, *_ in sorted(map(tuple, log.collect()), key=lambda r: -r[1]):
        want |= {(k, s)} if prev.get(k, 10**9) <= 1500 else set()
        prev[k] = s
    got = following(log, [F.col("user_key"), -F.col("seq")], F.struct("user_key", "seq"), "b", 9).where("b.user_key = user_key and b.seq <= 1500")
    assert {(r.user_key, r.seq) for r in got.collect()} == want == {(r.user_key, r.seq) for r in compaction.marked(log, 1500).where("dropped").collect()}


def one(spark, key, value=1.0):
    return spark.createDataFrame([(key, value)], "user_key string, value double")


def test_torn_manifest_is_passed_over(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store_module, "TAKEOVER", 0.3)
    store = Store.open(spark, f"file://{tmp_path}/s")
    store.put(one(spark, "a"))
    store.files.create(file_name("manifest", 2), "")  # a writer died here
    again = Store.open(spark, store.root)
    assert rows(again.live()) == [("a", 1, 1.0)]
    m = again.put(one(spark, "b"))
    assert (m.number, m.parent) == (3, 1) and [r[0] for r in rows(Store.open(spark, store.root).live())] == ["a", "b"]
    # the writer comes back and finishes its manifest: it isn't among the newest one's parents, so it commits again
    assert not store._stands(2) and store._stands(1) and store._stands(3)


def test_vacuum_leaves_writes_under_way(spark, tmp_path, monkeypatch):
    store = Store.open(spark, f"file://{tmp_path}/s")
    store.put(one(spark, "a"))
    commit = store._commit

    def late(change):
        Store.open(spark, store.root).vacuum()
        return commit(change)

    monkeypatch.setattr(store, "_commit", late)
    store.put(one(spark, "b"))
    assert [r[0] for r in rows(Store.open(spark, store.root).live())] == ["a", "b"]
    assert not [n for n in store.files.list() if n.endswith(".mark")]

    def gone(change):
        Store.open(spark, store.root).vacuum(abandoned=0)
        return commit(change)

    monkeypatch.setattr(store, "_commit", gone)
    with pytest.raises(NotFound, match="not found"):
        store.put(one(spark, "c"))
    assert [r[0] for r in rows(Store.open(spark, store.root).live())] == ["a", "b"]


def test_errors_stay(spark, tmp_path, monkeypatch, caplog):
    store = Store.open(spark, f"file://{tmp_path}/s")
    with caplog.at_level("INFO", "keyloom.store"):
        store.put(one(spark, "a"))
    assert "version 1, last sequence 1" in caplog.text
    monkeypatch.setattr(compaction, "kept", lambda *_: (_ for _ in ()).throw(StoreIOError("disk", "full")))
    store.flush()
    with pytest.raises(StoreIOError, match="input or output failed: disk: full"):
        store.compact_range()
    with pytest.raises(StoreIOError):
        store.put(one(spark, "b"))
    monkeypatch.undo()
    again = Store.open(spark, store.root)
    again.put(one(spark, "b"))
    assert [r[0] for r in rows(again.live())] == ["a", "b"]


def test_reads_below_what_was_kept_are_refused(spark, tmp_path):
    store = Store.open(spark, f"file://{tmp_path}/s")
    for i in range(4):
        store.put(one(spark, "a", float(i)))
    held = store.snapshot()
    store.put(one(spark, "a", 9.0))
    store.flush()
    store.compact_range()
    assert rows(store.live(held)) == [("a", 4, 3.0)] and rows(store.live()) == [("a", 5, 9.0)]
    with pytest.raises(InvalidArgument, match="compacted away"):
        store.live(2)
    with pytest.raises(InvalidArgument):
        store.get(one(spark, "a").select("user_key"), 2)
    number = store.manifest().number
    store.vacuum()
    store.files.delete(file_name("manifest", number))
    m = store.repair()
    assert m.value == "double" and m.last_seq == 5 and rows(store.live()) == [("a", 5, 9.0)]


def test_logs_are_replayed_once(spark, tmp_path):
    at = f"file://{tmp_path}/s"
    ops = random_log(21)
    names = wal.write_logs(spark.createDataFrame(ops, schema()), at, per_file=120, batch=7)
    assert names == ["000001.log", "000002.log", "000003.log"]
    for _ in range(2):
        store = Store.open(spark, at)
        assert rows(store.live()) == model_live(ops, 300) and store.manifest().replayed == 3 and store.manifest().last_seq == 300
    wal.write_logs(spark.createDataFrame([("zz", 1, 1, 5.0)], schema()), at, first=4)
    assert rows(Store.open(spark, at).live())[-1] == ("zz", 301, 5.0)
    # a damaged log: left out, or with paranoid checks an error
    data = bytearray((tmp_path / "s" / "000004.log").read_bytes())
    data[9] ^= 1
    (tmp_path / "s" / "000005.log").write_bytes(bytes(data))
    with pytest.raises(Exception, match="checksum"):
        Store.open(spark, at, Options(paranoid_checks=True))
    assert Store.open(spark, at).manifest().last_seq == 301
    lost = wal.read_wal(spark, f"{at}/000005.log").collect()
    assert [(r._corrupt, r._lost) for r in lost] == [(wal.DAMAGED, len(data))]
    with pytest.raises(InvalidArgument):
        wal.write_logs(spark.createDataFrame([("zz", 1, 1, 5.0)], schema()), at, first=4)


def test_rotation_and_grouped_writes(spark, tmp_path):
    store = Store.open(spark, f"file://{tmp_path}/s", Options(write_buffer_rows=1, peak_overlap=2))
    assert store.options.write_buffer_rows == 1 << 10
    many = spark.range(1500).selectExpr("concat('k', lpad(id, 4, '0')) user_key", "cast(id as double) value")
    store.put(many)
    assert store.stats()["logs"] == 0 and store.stats()["segments"] >= 1 and not store.stats()["should_delay"]
    store.put(many)
    assert store.stats()["should_delay"] and {r.stamp for r in store.segment_manifest().collect()} == {1500, 3000}
    before = store.manifest().number
    m = store.write_all([changelog.puts(one(spark, "k0000", 1.0)), changelog.deletes(one(spark, "k0000")), changelog.puts(one(spark, "k0000", 2.0))], [F.col("user_key")])
    assert m.number == before + 1 and m.last_seq == 3003
    assert store.get(one(spark, "k0000").select("user_key")).first().value == 2.0


def test_files(spark, tmp_path):
    files = Files(spark, f"file://{tmp_path}")
    assert files.create("a", "1") and not files.create("a", "2") and files.read("a") == "1" and files.age("a") < 60
    files.rename("a", "b")
    files.create("a", "2")
    for name, to, error in (("a", "b", InvalidArgument), ("nope", "c", NotFound)):
        with pytest.raises(error):
            files.rename(name, to)
    with pytest.raises(NotSupported):
        files.append("a", "more")  # checksummed local files can't be added to
    files.append("new", "begun")
    assert files.read("new") == "begun" and files.list() == ["a", "b", "new"] and files.size("new") == 5


def test_checksums_of_long_values():
    rng = random.Random(4)
    data = [rng.randbytes(n) for n in (0, 1, 1023, 1024, 1025, 2048, 5000, 70_001)]
    assert fmt.crc32c_many(data).tolist() == [fmt.crc32c(x) for x in data]


def test_merged(spark):
    a, b = (spark.createDataFrame([("k", 1, 1, x), ("j", 2, 1, x)], schema()) for x in (1.0, 2.0))
    assert scan.merged(schema(), spark=spark).count() == 0
    assert [r.value for r in scan.merged(schema(), a, b, spark=spark).where("user_key = 'k'").collect()] == [1.0, 2.0]
    assert [r.value for r in scan.merged(schema(), a, b, spark=spark, reverse=True).where("user_key = 'k'").collect()] == [2.0, 1.0]


@pytest.mark.parametrize("n", [1, 3, 7])
@pytest.mark.parametrize("small", [0, 150, 1 << 40])
def test_segments_are_cut_by_the_whole_order(spark, n, small):
    # few keys of many versions, so that some run over several ranges
    ops = [(f"{i % 7 % 4}", i + 1, 1, float(i)) for i in range(300)] + [(f"9{i:03}", 301 + i, 1, 0.0) for i in range(95)]
    log = spark.createDataFrame(ops, schema())
    keep, newer = [], (None, 0)
    for k, s, _, _ in sorted(ops, key=lambda r: (r[0], -r[1])):
        if not (newer[0] == k and newer[1] <= small):
            keep.append((k, s))
        newer = (k, s)
    first = {}
    for i, (k, _) in enumerate(keep):
        first.setdefault(k, i)
    got = compaction.rewritten(log, small, 10, n=n).select("user_key", "seq", "segment_id")
    assert sorted(map(tuple, got.collect())) == sorted((k, s, first[k] // 10) for k, s in keep)


def test_a_rewrite_deals_its_rows_once(spark):
    log = spark.createDataFrame(random_log(4), schema())
    plan = compaction.rewritten(log, 150, 10, n=3)._jdf.queryExecution().executedPlan().toString()
    # the rows, and keys alone for what each range holds
    assert plan.count("Exchange hashpartitioning") == 2


def test_a_rewrite_without_its_segments_orders_its_rows_once(spark):
    """What ranges hold is summed up before it is dealt where no segment is asked for."""
    log = spark.createDataFrame(random_log(4), schema())
    out = compaction.rewritten(log, 150, 10, n=3).select("user_key", "seq", "op", "value")
    plan = out._jdf.queryExecution().executedPlan().toString()
    by_range = [x for x in plan.splitlines() if "Window [" in x and "user_key" in x and "[_range#" in x]
    assert len(by_range) == 1
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, compaction.kept(log, 150).collect()))


def test_varints_of_more_than_five_bytes(spark):
    ns = [0, 127, 128, 2**35 - 1, 2**35, 4_338_899 * 7919, 2**42, 2**63 - 1]
    got = spark.createDataFrame([(n,) for n in ns], "n long").select("n", keys.varint(F.col("n")).alias("b"), fmt.get_varint_udf(keys.varint(F.col("n"))).alias("back")).collect()
    assert [(r.n, bytes(r.b), r.back) for r in got] == [(n, fmt.put_varint(n), n) for n in ns]
