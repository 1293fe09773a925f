"""A durable store of the change log: Parquet logs and segments under numbered, immutable manifests.

A manifest names the logs and segments that make up one version of the store, its parent's number, its last sequence,
the sequence from which on every read is answered rightly, its key codec, the binary logs replayed and the last
streaming epochs. Committing writes the next number's manifest if nobody has yet; a lost race is tried again on top of
the winner, so readers see whole versions only. The store's state is its highest manifest that is whole. One that a
writer died in is passed over: the next writer waits TAKEOVER seconds for it, then commits the number after it, and a
writer that comes back finds that its own isn't among the newest one's parents and commits again. On file systems whose
create isn't exclusive, one writer at a time is required. Reads pin the manifest they were opened on.

Data are written to a folder of their own that a mark announces until it is committed, so a vacuum leaves it alone.
A failed rewrite is remembered, and writes are refused until the store is opened again.
"""

from __future__ import annotations

import functools
import json
import logging
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import changelog, compaction, segments, view
from ..operators.ranges import running_sum
from ..operators.scan import nearest
from . import wal
from .files import Corruption, Files, InvalidArgument, NotFound, NotSupported, file_name, parse_name

CODEC = "utf8-bytes"
#: Codecs whose keys' byte order is the order that their users mean.
CODECS = (CODEC, "decimal-16")
#: Seconds that a manifest may be unfinished, and for which data that nobody announces any more are kept.
TAKEOVER, ABANDONED = 10.0, 86_400.0
#: What the store does, as it does it.
LOGGER = logging.getLogger("keyloom.store")


@dataclass(frozen=True)
class Options:
    """Behaviour of a store; sizes are clipped to what is sound."""

    create_if_missing: bool = True
    error_if_exists: bool = False
    paranoid_checks: bool = False
    write_buffer_rows: int = 4 << 20
    segment_rows: int = 1 << 20
    max_overlap: int = 2
    peak_overlap: int = 100
    codec: str = CODEC

    def __post_init__(self):
        object.__setattr__(self, "write_buffer_rows", min(max(self.write_buffer_rows, 1 << 10), 1 << 30))
        object.__setattr__(self, "max_overlap", max(self.max_overlap, 2))
        if self.codec not in CODECS:
            raise NotSupported(self.codec, "is no codec that keeps the order of keys")


@dataclass(frozen=True)
class Manifest:
    """One version: files are (name, rows, least key, greatest key, stamp), the stamp a log's first sequence or the
    newest one that a segment was made at."""

    number: int = 0
    parent: int = -1
    last_seq: int = 0
    kept_from: int = 0
    replayed: int = 0
    next_file: int = 1
    logs: tuple = ()
    segments: tuple = ()
    snapshots: tuple = ()
    epochs: tuple = ()
    value: str = "double"
    codec: str = CODEC

    def dumps(self) -> str:
        return json.dumps(self.__dict__)

    @staticmethod
    def loads(text: str) -> Manifest:
        try:
            got = json.loads(text)
            tuples = {k: tuple(tuple(x) if isinstance(x, list) else x for x in v) if isinstance(v, list) else v for k, v in got.items()}
            return Manifest(**tuples)
        except (ValueError, TypeError) as e:
            raise Corruption(f"a manifest can't be read: {e}") from e


def _remembered(job):
    """A maintenance job whose failure makes later writes fail."""

    @functools.wraps(job)
    def run(self, *args, **kwargs):
        try:
            return job(self, *args, **kwargs)
        except Exception as e:
            self.error = self.error or e
            LOGGER.error("%s: %s failed: %s", self.root, job.__name__, e)
            raise

    return run


class Store:
    """open() one, write batches, read views."""

    def __init__(self, spark: SparkSession, root: str, options: Options):
        self.spark, self.root, self.options = spark, root.rstrip("/"), options
        self.files = Files(spark, root)
        self.error: Exception | None = None

    @classmethod
    def open(cls, spark: SparkSession, root: str, options: Options | None = None, value: str = "double") -> Store:
        """The store at root, made if it isn't there; binary logs in its folder that it hasn't seen are replayed."""
        store = cls(spark, root, options or Options())
        there = store._newest() is not None
        if there and store.options.error_if_exists:
            raise InvalidArgument(root, "exists")
        if not there:
            if not store.options.create_if_missing:
                raise NotFound(root, "does not exist")
            store.files.mkdir()
            store.files.create(file_name("manifest", 0), Manifest(value=value, codec=store.options.codec).dumps())
        m = store.manifest()
        if m.codec != store.options.codec:
            raise InvalidArgument(root, f"has keys of codec {m.codec}")
        store.replay()
        return store

    # --- versions
    def _numbers(self) -> list[int]:
        return sorted((p[1] for n in self.files.list() if (p := parse_name(n)) and p[0] == "manifest"), reverse=True)

    def _whole(self, number: int) -> Manifest | None:
        try:
            return Manifest.loads(self.files.read(file_name("manifest", number)))
        except (Corruption, NotFound):
            return None

    def _newest(self) -> Manifest | None:
        return next((m for n in self._numbers() if (m := self._whole(n))), None)

    def manifest(self, number: int | None = None) -> Manifest:
        found = self._newest() if number is None else Manifest.loads(self.files.read(file_name("manifest", number)))
        if found is None:
            raise NotFound(self.root, "no manifest is whole")
        return found

    def _commit(self, change) -> Manifest:
        """change(manifest) is applied to the newest version until its number is won; None leaves all as it is."""
        if self.error:
            raise self.error
        while True:
            old = self.manifest()
            highest = max(self._numbers())
            if highest > old.number:  # somebody is writing it, or died doing so
                name = file_name("manifest", highest)
                if self.files.age(name) < TAKEOVER:
                    time.sleep(0.1)
                    continue
            new = change(old)
            if new is None:
                return old
            new = replace(new, number=highest + 1, parent=old.number)
            if self.files.create(file_name("manifest", new.number), new.dumps()) and self._stands(new.number):
                LOGGER.info("%s: version %d, last sequence %d", self.root, new.number, new.last_seq)
                return new

    def _stands(self, number: int) -> bool:
        """Whether a version is the newest or one of its parents."""
        m = self._newest()
        while m and m.number > number:
            m = self._whole(m.parent) if m.parent >= 0 else None
        return m is not None and m.number == number

    # --- reading
    def _schema(self, m: Manifest) -> T.StructType:
        return changelog.schema(T._parse_datatype_string(m.value))

    def log(self, m: Manifest | None = None, lo: str | None = None, hi: str | None = None) -> DataFrame:
        """The change log of a version; files whose key range can't meet [lo, hi) are not read."""
        m = m or self.manifest()
        meets = lambda f: (hi is None or f[2] is None or f[2] < hi) and (lo is None or f[3] is None or f[3] >= lo)
        names = [f"{self.root}/{f[0]}" for f in (*m.logs, *m.segments) if meets(f)]
        if not names:
            return self.spark.createDataFrame([], self._schema(m))
        rows = self.spark.read.schema(self._schema(m)).parquet(*names).where(F.col("seq") <= m.last_seq)
        if lo is not None:
            rows = rows.where(F.col("user_key") >= lo)
        return rows if hi is None else rows.where(F.col("user_key") < hi)

    def _readable(self, m: Manifest, as_of: int | None) -> Manifest:
        if as_of is not None and as_of < m.kept_from:
            raise InvalidArgument(f"sequence {as_of}", f"versions before {m.kept_from} were compacted away")
        return m

    def live(self, as_of: int | None = None, lo: str | None = None, hi: str | None = None) -> DataFrame:
        return view.live(self.log(self._readable(self.manifest(), as_of), lo, hi), as_of)

    def scan(self, lo: str | None = None, hi: str | None = None, as_of: int | None = None, reverse: bool = False) -> DataFrame:
        return self.live(as_of, lo, hi).orderBy(F.desc("user_key") if reverse else F.asc("user_key"))

    def get(self, keys: DataFrame, as_of: int | None = None) -> DataFrame:
        from ..operators.lookup import multi_get

        log = self.log(self._readable(self.manifest(), as_of))
        return multi_get(view.live(log.join(keys.select("user_key").distinct(), "user_key", "left_semi"), as_of), keys)

    # --- writing
    @contextmanager
    def _announced(self) -> Iterator[str]:
        """The name of a new data folder, which a mark beside it keeps from being taken for a leftover."""
        name = f"data-{uuid.uuid4().hex}"
        self.files.create(f"{name}.mark", "")
        try:
            yield name
        finally:
            self.files.delete(f"{name}.mark")

    def write(self, batch: DataFrame, order: list[Column], epoch: tuple[str, int] | None = None, replayed: int = 0) -> Manifest:
        """Append a batch (user_key, op, value and the columns of order), numbered on in that order. Whole or not at
        all; a streaming epoch that the store has already is skipped. A full write buffer is flushed."""
        if self.error:
            raise self.error
        seen_at = self.manifest()
        if epoch and dict(seen_at.epochs).get(epoch[0], -1) >= epoch[1]:
            return seen_at
        base = seen_at.last_seq
        with self._announced() as name:
            changelog.sequenced(changelog.accepted(batch), order, base).write.parquet(f"{self.root}/{name}")
            meta = self.spark.read.parquet(f"{self.root}/{name}").agg(F.count("*"), F.min("user_key"), F.max("user_key")).first()
            if not meta[0] and not epoch and not replayed:
                self.files.delete(name)
                return self.manifest()

            def change(m: Manifest) -> Manifest | None:
                seen = dict(m.epochs)
                if epoch and seen.get(epoch[0], -1) >= epoch[1] or replayed and m.replayed >= replayed:
                    return None
                if epoch:
                    seen[epoch[0]] = epoch[1]
                out = replace(m, epochs=tuple(sorted(seen.items())), replayed=max(m.replayed, replayed))
                if not meta[0]:
                    return out
                placed = name
                if m.last_seq != base:  # another writer was first: number on from its last
                    placed = f"{name}-{m.last_seq}"
                    at = self.spark.read.schema(self._schema(m)).parquet(f"{self.root}/{name}")
                    at.withColumn("seq", F.col("seq") + (m.last_seq - base)).write.mode("overwrite").parquet(f"{self.root}/{placed}")
                if not self.files.exists(placed):
                    raise NotFound(f"{self.root}/{placed}", "was deleted before it was committed")
                return replace(out, last_seq=m.last_seq + meta[0], next_file=m.next_file + 1, logs=(*m.logs, (placed, *meta, m.last_seq + 1)))

            done = self._commit(change)
        if sum(f[1] for f in done.logs) >= self.options.write_buffer_rows:
            LOGGER.info("%s: the write buffer is full", self.root)
            return self.flush()
        return done

    def write_all(self, batches: list[DataFrame], order: list[Column]) -> Manifest:
        """Several writers' batches as one commit, each one's operations behind those of the batches before it."""
        joined = functools.reduce(DataFrame.unionByName, [b.withColumn("_batch", F.lit(i)) for i, b in enumerate(batches)])
        return self.write(joined, [F.col("_batch"), *order])

    def replay(self) -> Manifest:
        """Append what the binary logs in the store's folder hold, in their numbers' order and each one's own, where it
        isn't in the store yet. What can't be read is left out, or with paranoid_checks an error."""
        m = self.manifest()
        found = sorted(p[1] for n in self.files.list() if (p := parse_name(n)) and p[0] == "log" and p[1] > m.replayed)
        if not found:
            return m
        LOGGER.info("%s: replaying %d logs", self.root, len(found))
        rows = wal.read_wal(self.spark, [f"{self.root}/{file_name('log', n)}" for n in found], paranoid=self.options.paranoid_checks)
        number = F.regexp_extract("path", r"(\d+)\.log$", 1).cast("bigint")
        rows = rows.where("_corrupt is null").select(F.col("user_key").cast("string").alias("user_key"), "op", F.col("value").cast("string").cast(m.value).alias("value"), number.alias("log"), "record_offset", F.col("seq").alias("at"))
        return self.write(rows, [F.col("log"), F.col("record_offset"), F.col("at")], replayed=found[-1])

    def put(self, df: DataFrame) -> Manifest:
        return self.write(changelog.puts(df), [F.col("user_key")])

    def delete(self, keys: DataFrame) -> Manifest:
        return self.write(changelog.deletes(keys, self.manifest().value), [F.col("user_key")])

    # --- snapshots
    def snapshot(self) -> int:
        """Register the last sequence: versions that it sees are kept."""
        return self._commit(lambda m: replace(m, snapshots=(*m.snapshots, m.last_seq))).snapshots[-1]

    def release(self, seq: int) -> None:
        def change(m: Manifest) -> Manifest | None:
            if seq not in m.snapshots:
                return None
            at = m.snapshots.index(seq)
            return replace(m, snapshots=m.snapshots[:at] + m.snapshots[at + 1 :])

        self._commit(change)

    @contextmanager
    def held(self) -> Iterator[int]:
        seq = self.snapshot()
        try:
            yield seq
        finally:
            self.release(seq)

    # --- maintenance
    @_remembered
    def _rewrite(self, pick, smallest: int | None) -> Manifest:
        """Replace the picked files by sorted segments that don't overlap, without what no snapshot sees."""
        m = self.manifest()
        old = pick(m)
        if not old:
            return m
        least = min([*m.snapshots, m.last_seq]) if smallest is None else smallest
        rows = self.spark.read.schema(self._schema(m)).parquet(*[f"{self.root}/{f[0]}" for f in old])
        rows = compaction.kept(rows, least) if smallest is None or smallest >= 0 else rows
        total = sum(f[1] for f in old)
        n = max(1, total // self.options.segment_rows)
        stamp = max(m.last_seq if f in m.logs else f[4] for f in old)
        with self._announced() as name:
            rows.repartitionByRange(n, "user_key").sortWithinPartitions("user_key", F.desc("seq")).write.parquet(f"{self.root}/{name}")
            parts = self.spark.read.parquet(f"{self.root}/{name}").groupBy(F.input_file_name().alias("f")).agg(F.count("*").alias("n"), F.min("user_key").alias("lo"), F.max("user_key").alias("hi")).collect()
            new = tuple((f"{name}/{r.f.rsplit('/', 1)[1]}", r.n, r.lo, r.hi, stamp) for r in sorted(parts, key=lambda r: r.lo))
            names = {f[0] for f in old}

            def change(now: Manifest) -> Manifest | None:
                if not names <= {f[0] for f in (*now.logs, *now.segments)}:
                    return None  # another rewrite was first
                # a snapshot taken since sees the last sequence of its time, so nothing that it needs was dropped
                gone = lambda fs: tuple(f for f in fs if f[0] not in names)
                kept_from = max(now.kept_from, least) if smallest is None or smallest >= 0 else now.kept_from
                return replace(now, logs=gone(now.logs), segments=gone(now.segments) + new, kept_from=kept_from)

            return self._commit(change)

    def flush(self) -> Manifest:
        """The logs as sorted segments, every version kept."""
        return self._rewrite(lambda m: m.logs, -1)

    def overlaps(self, m: Manifest | None = None) -> list[list[tuple]]:
        """Runs of segments whose key ranges overlap."""
        out: list[list[tuple]] = []
        reach = None
        for f in sorted((m or self.manifest()).segments, key=lambda f: (f[2], f[3])):
            if out and f[2] <= reach:
                out[-1].append(f)
                reach = max(reach, f[3])
            else:
                out.append([f])
                reach = f[3]
        return out

    def maybe_compact(self) -> Manifest:
        """Compact the first run of at least max_overlap segments. Keys may live in other files too, which is why
        tombstones stay."""
        return self._rewrite(lambda m: tuple(next((r for r in self.overlaps(m) if len(r) >= self.options.max_overlap), ())), None)

    def compact_range(self, lo: str | None = None, hi: str | None = None) -> Manifest:
        """Compact the segments that meet [lo, hi)."""
        return self._rewrite(lambda m: tuple(f for f in m.segments if (hi is None or f[2] < hi) and (lo is None or f[3] >= lo)), None)

    def vacuum(self, keep_manifests: int = 1, abandoned: float = ABANDONED) -> list[str]:
        """Delete data that none of the newest manifests names. What a write under way has announced stays, unless its
        mark is `abandoned` seconds old."""
        there = self.files.list()
        marked = {n.removesuffix(".mark") for n in there if n.endswith(".mark") and self.files.age(n) < abandoned}
        newest = self.manifest().number
        kept = [m for n in range(max(0, newest - keep_manifests + 1), newest + 1) if (m := self._whole(n))]
        used = {f[0].split("/")[0] for m in kept for f in (*m.logs, *m.segments)} | marked | {f"{n}.mark" for n in marked}
        leftover = lambda n: n.startswith("data-") and n not in used and n.rsplit("-", 1)[0] not in marked
        gone = [n for n in there if leftover(n) or (p := parse_name(n)) and p[0] == "manifest" and p[1] <= newest - keep_manifests]
        for n in gone:
            self.files.delete(n)
        LOGGER.info("%s: %d leftovers deleted", self.root, len(gone))
        return gone

    def repair(self) -> Manifest:
        """A manifest of all readable data files, when the newest manifests are lost: logs and segments can't be told
        apart, nor dropped files from kept ones, so run it on a vacuumed store only. The value's type, snapshots, epochs
        and marks come from the newest manifest that is whole; without one, the type is that of the data."""
        found, old = [], self._newest()
        kind = old.value if old else None
        for n in self.files.list():
            if n.startswith("data-") and not n.endswith(".mark"):
                rows = self.spark.read.parquet(f"{self.root}/{n}")
                kind = kind or rows.schema["value"].dataType.simpleString()
                r = rows.agg(F.count("*"), F.min("user_key"), F.max("user_key"), F.max("seq")).first()
                found.append((n, *r))
        base = old or Manifest(value=kind or "double", codec=self.options.codec)
        last = max([base.last_seq, *(f[4] or 0 for f in found)])
        number = max(self._numbers(), default=-1) + 1
        m = replace(base, number=number, parent=old.number if old else -1, last_seq=last, next_file=len(found) + 1, logs=(), segments=tuple(f for f in found if f[1]))
        self.files.create(file_name("manifest", m.number), m.dumps())
        LOGGER.info("%s: repaired from %d folders", self.root, len(found))
        return m

    def stats(self) -> dict:
        m = self.manifest()
        peak = max(map(len, self.overlaps(m)), default=0)
        return {"logs": len(m.logs), "segments": len(m.segments), "entries": sum(f[1] for f in (*m.logs, *m.segments)), "bytes": sum(self.files.size(f[0]) for f in (*m.logs, *m.segments)), "last_seq": m.last_seq, "peak_overlap": peak, "should_delay": peak >= self.options.peak_overlap}

    def approximate_sizes(self, ranges: DataFrame) -> DataFrame:
        """start, limit, bytes of the entries in each range (null ends are open): the difference of two running sums."""
        n = F.octet_length("user_key") + F.coalesce(F.octet_length(F.col("value").cast("string")), F.lit(0))
        keys = self.log().groupBy("user_key").agg(F.sum(n).cast("bigint").alias("n"))
        upto = running_sum(keys, [F.col("user_key")], F.col("n"), "upto").withColumn("at", F.lit(1))
        r = ranges.select("start", "limit").distinct()
        # what lies below a bound is the sum up to the last key below it
        asked = r.select(F.explode(F.array("start", "limit")).alias("user_key")).where("user_key is not null").distinct().withColumn("at", F.lit(0))
        below = nearest(upto, asked, ["user_key", "at"], F.struct("upto"), False).select("user_key", F.coalesce("hit.upto", F.lit(0)).alias("below"))
        total = F.broadcast(keys.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("total")))  # one row
        side = lambda c, name: below.select(F.col("user_key").alias(c), F.col("below").alias(name))
        out = r.join(side("start", "a"), "start", "left").join(side("limit", "b"), "limit", "left").join(total)
        return out.select("start", "limit", F.greatest(F.coalesce("b", "total") - F.coalesce("a", F.lit(0)), F.lit(0)).alias("bytes"))

    def segment_manifest(self) -> DataFrame:
        """The manifest's files as a manifest table, for stabs and islands."""
        m = self.manifest()
        rows = [(i, f[2], f[3], f[1], f[4]) for i, f in enumerate((*m.segments, *m.logs))]
        return self.spark.createDataFrame(rows, "segment_id long, inf_key string, sup_key string, n_entries long, stamp long")

    def stab(self, keys: DataFrame) -> DataFrame:
        return segments.stab(self.segment_manifest(), keys)


def destroy(spark: SparkSession, root: str) -> None:
    """Delete the files of a store, and its folder if nothing else is in it; a missing one is fine."""
    files = Files(spark, root)
    for n in files.list():
        if n.startswith(("data-", "logs-")) or parse_name(n):
            files.delete(n)
    if files.exists() and not files.list():
        files.delete()
