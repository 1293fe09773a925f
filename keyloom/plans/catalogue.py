"""The named queries over the test tables, each beside the DuckDB SQL of the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..durable import shared_folder
from ..functions import bytes as fmt
from ..functions import histogram, keys, workload
from ..operators import changelog, compaction, lookup, scan, segments, view
from ..operators.ranges import following
from ..sources import wal
from ..sources.files import file_name
from ..sources.store import Options, Store, destroy
from ..streaming.ingest import ingest

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

SQL_E = """SELECT lpad(CAST(user_id AS VARCHAR),16,'0') user_key, event_id+1 seq,
  CASE WHEN event_type='error' THEN 0 ELSE 1 END op, CASE WHEN event_type='error' THEN NULL ELSE value END AS value FROM events"""
SQL_O = """SELECT user_key, CAST(row_number() OVER (ORDER BY wave, user_key) AS BIGINT) seq, op, value FROM (
  SELECT 1 wave, lpad(CAST(o_orderkey AS VARCHAR),16,'0') user_key, 1 op, o_totalprice AS value FROM orders
  UNION ALL SELECT 2, lpad(CAST(o_orderkey AS VARCHAR),16,'0'), 0, CAST(NULL AS DOUBLE) FROM orders WHERE o_orderstatus='F') t"""
SQL_L = """SELECT concat(lpad(CAST(l_orderkey AS VARCHAR),16,'0'),'.',lpad(CAST(l_linenumber AS VARCHAR),4,'0')) user_key,
  CAST(row_number() OVER (ORDER BY l_shipdate,l_orderkey,l_linenumber,l_partkey,l_suppkey,l_extendedprice) AS BIGINT) seq,
  CASE WHEN l_returnflag='R' THEN 0 ELSE 1 END op, CASE WHEN l_returnflag='R' THEN NULL ELSE l_extendedprice END AS value FROM lineitem"""
LIVE = "{0}v AS (SELECT user_key, seq, value FROM (SELECT *, row_number() OVER (PARTITION BY user_key ORDER BY seq DESC) rn FROM {0} {1}) t WHERE rn = 1 AND op = 1)"
WITH = f"WITH e AS ({SQL_E}), o AS ({SQL_O}), l AS ({SQL_L}), {LIVE.format('e', '')}, {LIVE.format('o', '')}, {LIVE.format('l', '')}"
# segments of 500 operations, and their manifests
SEG = """, {0}g AS (SELECT *, CAST(floor((seq-1)/500) AS BIGINT) segment_id FROM {0}), {0}m AS (SELECT segment_id,
  arg_min(user_key, (user_key, -seq)) inf_key, arg_min(seq, (user_key, -seq)) inf_seq, arg_max(user_key, (user_key, -seq)) sup_key,
  arg_max(seq, (user_key, -seq)) sup_seq, max(seq) stamp, count(*) n_entries FROM {0}g GROUP BY segment_id)"""
SEGS = WITH + SEG.format("e") + SEG.format("l") + SEG.format("o")
ISLANDS = SEGS + """, i AS (SELECT *, CAST(sum(nw) OVER (ORDER BY inf_key, sup_key, segment_id) AS BIGINT) island FROM (SELECT *,
  CASE WHEN max(sup_key) OVER (ORDER BY inf_key, sup_key, segment_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) >= inf_key THEN 0 ELSE 1 END nw FROM om) t)"""
PROBES = ", p AS (SELECT lpad(CAST(c_custkey AS VARCHAR),16,'0') user_key FROM customer)"


def events(s: SparkSession, d: str) -> DataFrame:
    return changelog.from_events(s.read.parquet(f"{d}/events.parquet"))


def orders(s: SparkSession, d: str) -> DataFrame:
    return changelog.from_orders(s.read.parquet(f"{d}/orders.parquet"))


def lines(s: SparkSession, d: str) -> DataFrame:
    return changelog.from_lineitem(s.read.parquet(f"{d}/lineitem.parquet"))


def customers(s: SparkSession, d: str) -> DataFrame:
    """Probe keys: some are live users or orders, some are not."""
    return s.read.parquet(f"{d}/customer.parquet").select(keys.int_key(F.col("c_custkey")).alias("user_key"))


def manifest_of(log: DataFrame) -> DataFrame:
    return segments.manifest(segments.cut(log))


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def simple(name: str, build: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = build
    if sql:
        ORACLE[name] = sql


# --- ingest
simple("kv_changelog_events", events, SQL_E)
simple("kv_changelog_orders", orders, SQL_O)
simple("kv_changelog_lineitem", lines, SQL_L)
BATCHES = """SELECT CAST(c_custkey-1 AS BIGINT) op_ix, 1 op, lpad(CAST(c_custkey AS VARCHAR),16,'0') user_key, c_acctbal AS value FROM customer"""


def _batches(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    c = s.read.parquet(f"{d}/customer.parquet")
    first = c.select((F.col("c_custkey") - 1).alias("op_ix"), F.lit(1).alias("op"), keys.int_key(F.col("c_custkey")).alias("user_key"), F.col("c_acctbal").alias("value"))
    gone = s.read.parquet(f"{d}/supplier.parquet")
    second = gone.select((F.col("s_suppkey") - 1).alias("op_ix"), F.lit(0).alias("op"), keys.int_key(F.col("s_suppkey")).alias("user_key"), F.lit(None).cast("double").alias("value"))
    return first, second


TWO = f"""SELECT CAST(row_number() OVER (ORDER BY b, op_ix)-1 AS BIGINT) op_ix, op, user_key, value FROM (SELECT 0 b, * FROM ({BATCHES}) x
  UNION ALL SELECT 1, s_suppkey-1, 0, lpad(CAST(s_suppkey AS VARCHAR),16,'0'), CAST(NULL AS DOUBLE) FROM supplier) t"""
simple("kv_batch_append", lambda s, d: changelog.appended(*_batches(s, d)), TWO)
simple(
    "kv_batch_size",
    lambda s, d: changelog.batch_bytes(s.read.parquet(f"{d}/documents.parquet").select(F.col("source").alias("user_key"), F.when(F.col("doc_id") % 3 == 0, 0).otherwise(1).alias("op"), F.when(F.col("doc_id") % 3 != 0, F.col("text")).alias("value"), "source"), "source"),
    """SELECT source, CAST(12 + sum(1 + vl(strlen(source)) + strlen(source) + CASE WHEN doc_id % 3 <> 0 THEN vl(strlen(text)) + strlen(text) ELSE 0 END) AS BIGINT) bytes, count(*) ops FROM documents GROUP BY source""".replace("vl(strlen(source))", "1").replace("vl(strlen(text))", "CASE WHEN strlen(text) < 128 THEN 1 WHEN strlen(text) < 16384 THEN 2 WHEN strlen(text) < 2097152 THEN 3 ELSE 4 END"),
)

# --- views
for _name, _log, _t in (("kv_live_view", events, "e"), ("kv_live_view_orders", orders, "o"), ("kv_live_view_lineitem", lines, "l")):
    simple(_name, lambda s, d, log=_log: view.live(log(s, d)), f"{WITH} SELECT user_key, seq, value FROM {_t}v")
simple("kv_live_view_maxby", lambda s, d: view.live_by_max(lines(s, d)), f"{WITH} SELECT user_key, seq, value FROM lv")
simple("kv_snapshot_view_5000", lambda s, d: view.live(events(s, d), 5000), f"{WITH}, {LIVE.format('e', 'WHERE seq <= 5000').replace('ev AS', 'sv AS')} SELECT user_key, seq, value FROM sv")
simple(
    "kv_snapshot_diff", lambda s, d: view.difference(events(s, d), 5000, 9000),
    f"{WITH}, {LIVE.format('e', 'WHERE seq <= 5000').replace('ev AS', 'a AS')}, {LIVE.format('e', 'WHERE seq <= 9000').replace('ev AS', 'b AS')} SELECT coalesce(a.user_key, b.user_key) user_key, a.value old_value, b.value new_value FROM a FULL JOIN b ON a.user_key = b.user_key WHERE a.value IS DISTINCT FROM b.value OR (a.user_key IS NULL) <> (b.user_key IS NULL)",
)
simple("kv_tombstoned_keys", lambda s, d: view.tombstoned(lines(s, d)), f"{WITH} SELECT user_key, seq FROM (SELECT *, row_number() OVER (PARTITION BY user_key ORDER BY seq DESC) rn FROM l) t WHERE rn = 1 AND op = 0")
simple("kv_resurrected_keys", lambda s, d: view.resurrected(lines(s, d)), f"{WITH} SELECT user_key, count(*) times FROM (SELECT *, lag(op) OVER (PARTITION BY user_key ORDER BY seq) w FROM l) t WHERE w = 0 AND op = 1 GROUP BY user_key")
simple("kv_version_history", lambda s, d: view.history(events(s, d)), f"{WITH} SELECT *, row_number() OVER (PARTITION BY user_key ORDER BY seq DESC) AS version, lag(seq) OVER (PARTITION BY user_key ORDER BY seq DESC) replaced_by FROM e")
simple("kv_version_counts", lambda s, d: view.version_counts(lines(s, d)), f"{WITH} SELECT user_key, count(*) versions, count(*) FILTER (op = 0) deletes, min(seq) first_seq, max(seq) last_seq FROM l GROUP BY user_key")

# --- reads
simple("kv_multi_get", lambda s, d: lookup.multi_get(view.live(orders(s, d)), customers(s, d)), f"{WITH}{PROBES} SELECT p.user_key, ov.user_key IS NOT NULL AS found, value FROM p LEFT JOIN ov ON p.user_key = ov.user_key")
simple("kv_get_missing", lambda s, d: lookup.multi_get(view.live(orders(s, d)), customers(s, d).select(F.concat("user_key", F.lit(".")).alias("user_key"))), f"{WITH}{PROBES} SELECT p.user_key || '.' user_key, ov.user_key IS NOT NULL AS found, value FROM p LEFT JOIN ov ON p.user_key || '.' = ov.user_key")


@query(f"{WITH}, h AS (SELECT lpad(CAST(o_orderkey AS VARCHAR),16,'0') user_key FROM orders WHERE o_orderkey <= (SELECT ceil(max(o_orderkey)/100.0) FROM orders)) SELECT h.user_key, ov.user_key IS NOT NULL AS found, value FROM h LEFT JOIN ov ON h.user_key = ov.user_key")
def kv_get_hot(s: SparkSession, d: str) -> DataFrame:
    o = s.read.parquet(f"{d}/orders.parquet").select("o_orderkey")
    top = o.agg(F.ceil(F.max("o_orderkey") / 100.0).alias("top"))  # one row
    hot = o.join(F.broadcast(top), F.col("o_orderkey") <= F.col("top")).select(keys.int_key(F.col("o_orderkey")).alias("user_key"))
    return lookup.multi_get(view.live(orders(s, d)), hot)


simple(
    "kv_asof_get",
    lambda s, d: lookup.asof_get(events(s, d), customers(s, d).select("user_key", F.explode(F.array(*[F.lit(x).cast("bigint") for x in (1000, 5000, 9000)])).alias("as_of_seq"))),
    f"{WITH}{PROBES}, q AS (SELECT user_key, CAST(s AS BIGINT) as_of_seq FROM p, (VALUES (1000),(5000),(9000)) t(s)), a AS (SELECT q.*, e.op, e.value FROM q ASOF LEFT JOIN e ON q.user_key = e.user_key AND q.as_of_seq >= e.seq) SELECT user_key, as_of_seq, coalesce(op = 1, false) AS found, CASE WHEN op = 1 THEN value END AS value FROM a",
)
LO, HI = "0000000000001000", "0000000000002000"
simple("kv_range_scan", lambda s, d: scan.range_scan(view.live(orders(s, d)), LO, HI), f"{WITH} SELECT user_key, seq, value FROM ov WHERE user_key >= '{LO}' AND user_key < '{HI}'")
simple("kv_prefix_scan", lambda s, d: scan.prefix_scan(view.live(lines(s, d)), "00000000000012"), f"{WITH} SELECT user_key, seq, value FROM lv WHERE starts_with(user_key, '00000000000012')")
simple("kv_page_after", lambda s, d: scan.page_after(view.live(orders(s, d)), LO, 100), f"{WITH} SELECT user_key, seq, value FROM ov WHERE user_key > '{LO}' ORDER BY user_key LIMIT 100")
simple("kv_first", lambda s, d: scan.first(view.live(orders(s, d))), f"{WITH} SELECT user_key, seq, value FROM ov ORDER BY user_key LIMIT 1")
simple("kv_last", lambda s, d: scan.last(view.live(orders(s, d))), f"{WITH} SELECT user_key, seq, value FROM ov ORDER BY user_key DESC LIMIT 1")
simple("kv_scan_reverse_top", lambda s, d: scan.last(view.live(lines(s, d)), 50), f"{WITH} SELECT user_key, seq, value FROM lv ORDER BY user_key DESC LIMIT 50")
simple("kv_jump", lambda s, d: scan.at_position(view.live(orders(s, d)), 1, 10, 100), f"{WITH} SELECT * FROM (SELECT *, row_number() OVER (ORDER BY user_key) AS position FROM ov) t WHERE position IN (1, 10, 100)")
for _name, _forward, _op in (("kv_seek_many", True, "<="), ("kv_seek_prev_many", False, ">")):
    simple(
        _name,
        lambda s, d, f=_forward: scan.seek_many(view.live(orders(s, d)), customers(s, d).withColumnRenamed("user_key", "target"), f),
        f"{WITH}{PROBES} SELECT p.user_key target, ov.user_key found_key, ov.value FROM p ASOF LEFT JOIN ov ON p.user_key {_op} ov.user_key",
    )
simple("kv_next_prev", lambda s, d: scan.neighbours(view.live(orders(s, d))), f"{WITH} SELECT user_key, lag(user_key) OVER (ORDER BY user_key) previous_key, lead(user_key) OVER (ORDER BY user_key) next_key FROM ov")
simple("kv_semi_member", lambda s, d: lookup.members(customers(s, d), view.live(orders(s, d))), f"{WITH}{PROBES} SELECT user_key FROM p WHERE EXISTS (SELECT 1 FROM ov WHERE ov.user_key = p.user_key)")
simple("kv_anti_member", lambda s, d: lookup.strangers(customers(s, d), view.live(orders(s, d))), f"{WITH}{PROBES} SELECT user_key FROM p WHERE NOT EXISTS (SELECT 1 FROM ov WHERE ov.user_key = p.user_key)")
simple("kv_fingerprint_candidates", lambda s, d: lookup.candidates(customers(s, d), view.live(events(s, d))), f"{WITH}{PROBES} SELECT user_key, EXISTS (SELECT 1 FROM ev WHERE ev.user_key = p.user_key) present FROM p WHERE substr(md5(user_key),1,3) IN (SELECT substr(md5(user_key),1,3) FROM ev)")
simple("kv_merge_scan", lambda s, d: scan.merged(changelog.schema(), events(s, d), orders(s, d), spark=s), f"{WITH} SELECT * FROM e UNION ALL SELECT * FROM o")
simple("kv_merge_none", lambda s, d: scan.merged(changelog.schema(), spark=s).agg(F.count("*").alias("n")), "SELECT CAST(0 AS BIGINT) n")
simple("kv_merge_one_reverse", lambda s, d: scan.merged(changelog.schema(), events(s, d), spark=s, reverse=True), f"{WITH} SELECT * FROM e")
simple(
    "kv_merge_ranked", lambda s, d: scan.merged(changelog.schema(), *[events(s, d).where("seq <= 50").withColumn("value", F.lit(float(i))) for i in range(3)], spark=s).limit(30).select("user_key", "seq", "value"),
    f"{WITH}, r AS (SELECT user_key, seq, op, CAST(i AS DOUBLE) AS value, i FROM e, (VALUES (0), (1), (2)) v(i) WHERE seq <= 50) SELECT user_key, seq, value FROM r ORDER BY user_key, seq DESC, op DESC, i LIMIT 30",
)
simple(
    "kv_seek_exact_hits", lambda s, d: scan.exact_hits(view.live(orders(s, d)), customers(s, d).withColumnRenamed("user_key", "target")),
    f"{WITH}{PROBES} SELECT count(DISTINCT p.user_key) asked, count(DISTINCT ov.user_key) AS found FROM p LEFT JOIN ov ON p.user_key = ov.user_key",
)
simple(
    "kv_seek_at_snapshot", lambda s, d: scan.seek_many(view.live(events(s, d), 5000), customers(s, d).withColumnRenamed("user_key", "target")),
    f"{WITH}{PROBES}, {LIVE.format('e', 'WHERE seq <= 5000').replace('ev AS', 'sv AS')} SELECT p.user_key target, sv.user_key found_key, sv.value FROM p ASOF LEFT JOIN sv ON p.user_key <= sv.user_key",
)
simple(
    "kv_get_at_snapshot", lambda s, d: lookup.multi_get(view.live(events(s, d), 5000), customers(s, d)),
    f"{WITH}{PROBES}, {LIVE.format('e', 'WHERE seq <= 5000').replace('ev AS', 'sv AS')} SELECT p.user_key, sv.user_key IS NOT NULL AS found, sv.value FROM p LEFT JOIN sv ON p.user_key = sv.user_key",
)
simple(
    "kv_scan_reverse_at_snapshot", lambda s, d: scan.range_scan(view.live(events(s, d), 5000), "0000000000000010", "0000000000000090", reverse=True),
    f"{WITH}, {LIVE.format('e', 'WHERE seq <= 5000').replace('ev AS', 'sv AS')} SELECT user_key, seq, value FROM sv WHERE user_key >= '0000000000000010' AND user_key < '0000000000000090'",
)
MARKS = "SELECT substr(md5(user_key),1,3) mark, count(*) n FROM {} GROUP BY 1"
simple(
    "kv_filter_delete", lambda s, d: lookup.without_marks(lookup.marks(view.live(orders(s, d))), lookup.members(customers(s, d), view.live(orders(s, d)))),
    f"{WITH}{PROBES}, a AS ({MARKS.format('ov')}), g AS ({MARKS.format('p WHERE EXISTS (SELECT 1 FROM ov WHERE ov.user_key = p.user_key)')}) SELECT a.mark, CAST(a.n - coalesce(g.n, 0) AS BIGINT) n FROM a LEFT JOIN g ON a.mark = g.mark WHERE a.n > coalesce(g.n, 0)",
)

# --- segments and maintenance
for _t, _log in (("e", events), ("l", lines)):
    simple({"e": "kv_segments", "l": "kv_segments_lineitem"}[_t], lambda s, d, log=_log: manifest_of(log(s, d)), f"{SEGS} SELECT * FROM {_t}m")
simple("kv_segment_stats", lambda s, d: segments.stats(manifest_of(lines(s, d))), f"{SEGS} SELECT count(*) AS segments, CAST(sum(n_entries) AS BIGINT) entries, min(inf_key) first_key, max(sup_key) last_key FROM lm")
simple("kv_stab", lambda s, d: segments.stab(manifest_of(orders(s, d)), customers(s, d)), f"{SEGS}{PROBES} SELECT p.user_key probe, segment_id, stamp FROM p JOIN om ON p.user_key BETWEEN inf_key AND sup_key")
simple("kv_stab_ranges", lambda s, d: segments.stab(manifest_of(orders(s, d)), customers(s, d), 8), f"{SEGS}{PROBES} SELECT p.user_key probe, segment_id, stamp FROM p JOIN om ON p.user_key BETWEEN inf_key AND sup_key")
simple("kv_overlap_count", lambda s, d: segments.overlap_counts(manifest_of(lines(s, d)), customers(s, d)), f"{SEGS}{PROBES} SELECT p.user_key probe, (SELECT count(*) FROM lm WHERE p.user_key BETWEEN inf_key AND sup_key) AS overlaps FROM p")
simple(
    "kv_mountain_profile", lambda s, d: segments.mountains(manifest_of(lines(s, d))),
    f"{SEGS}, x AS (SELECT inf_key point, 0 kind, stamp, 1 delta FROM lm UNION ALL SELECT sup_key, 1, stamp, -1 FROM lm) SELECT point, kind, stamp, CAST(sum(delta) OVER (ORDER BY point, kind, stamp ROWS UNBOUNDED PRECEDING) + kind AS BIGINT) height FROM x",
)
simple("kv_islands", lambda s, d: segments.islands(manifest_of(orders(s, d))), f"{ISLANDS} SELECT segment_id, inf_key, inf_seq, sup_key, sup_seq, stamp, n_entries, island FROM i")
simple("kv_compaction_pick", lambda s, d: segments.compaction_pick(manifest_of(orders(s, d))), f"{ISLANDS} SELECT island, count(*) segments, min(inf_key) left_key, max(sup_key) right_key, max(stamp) stamp, CAST(sum(n_entries) AS BIGINT) entries FROM i GROUP BY island HAVING count(*) >= 2")
simple("kv_stab_newest", lambda s, d: segments.newest_first(segments.stab(manifest_of(lines(s, d)), customers(s, d).where("user_key <= '0000000000000050'"))), f"{SEGS}{PROBES} SELECT p.user_key probe, segment_id, stamp, CAST(row_number() OVER (PARTITION BY p.user_key ORDER BY stamp DESC, segment_id DESC) AS INTEGER) AS rank FROM p JOIN lm ON p.user_key BETWEEN inf_key AND sup_key WHERE p.user_key <= '0000000000000050'")
NEAR = "(SELECT max(sup_key) FROM om WHERE sup_key < p.user_key) left_key, (SELECT min(inf_key) FROM om WHERE inf_key > p.user_key) right_key"
simple("kv_scan_window", lambda s, d: segments.windows(manifest_of(orders(s, d)), customers(s, d)), f"{SEGS}{PROBES} SELECT p.user_key probe, {NEAR}, (SELECT count(*) FROM om WHERE p.user_key BETWEEN inf_key AND sup_key) AS overlaps FROM p")
BORDER = "0000000000001200"
simple("kv_next_start", lambda s, d: segments.next_starts(manifest_of(orders(s, d)), customers(s, d), BORDER, 5000), f"{SEGS}{PROBES} SELECT p.user_key probe, (SELECT min(inf_key) FROM om WHERE inf_key > p.user_key AND inf_key < '{BORDER}' AND stamp <= 5000) right_key FROM p")
simple(
    "kv_containing", lambda s, d: segments.containing(manifest_of(orders(s, d)), customers(s, d).select(F.col("user_key").alias("lo"), keys.int_key(keys.key_int(F.col("user_key")) + 20).alias("hi"))),
    f"{SEGS}{PROBES}, r AS (SELECT user_key lo, lpad(CAST(CAST(user_key AS BIGINT) + 20 AS VARCHAR),16,'0') hi FROM p) SELECT lo, hi, segment_id FROM r JOIN om ON inf_key <= lo AND hi <= sup_key",
)
simple(
    "kv_first_of_key", lambda s, d: following(scan.numbered(events(s, d), keys.internal_order(), name="place"), [F.col("place")], F.col("user_key"), "before").select("user_key", "seq", "place", (~F.col("before").eqNullSafe(F.col("user_key"))).alias("is_first")),
    f"{WITH} SELECT user_key, seq, row_number() OVER (ORDER BY user_key, seq DESC) place, row_number() OVER (PARTITION BY user_key ORDER BY seq DESC) = 1 is_first FROM e",
)
GC = f"{WITH}, g AS (SELECT *, coalesce(lag(seq) OVER (PARTITION BY user_key ORDER BY seq DESC) <= 6000, false) gone FROM e)"
simple("kv_gc_keep", lambda s, d: compaction.kept(events(s, d), 6000), f"{GC} SELECT user_key, seq, op, value FROM g WHERE NOT gone")
simple("kv_gc_drop_count", lambda s, d: compaction.drop_counts(events(s, d), 6000), f"{GC} SELECT count(*) AS read, count(*) FILTER (gone) dropped, count(*) FILTER (NOT gone) written FROM g")
simple("kv_purge", lambda s, d: compaction.purged(events(s, d), 6000), f"{GC}, h AS (SELECT *, row_number() OVER (PARTITION BY user_key ORDER BY seq DESC) n FROM e) SELECT g.user_key, g.seq, g.op, g.value FROM g JOIN h ON g.user_key = h.user_key AND g.seq = h.seq WHERE NOT gone AND NOT (n = 1 AND g.op = 0 AND g.seq <= 6000)")
simple("kv_compact_island", lambda s, d: compaction.rewritten(lines(s, d), 1 << 40, 500).select("user_key", "seq", "op", "value"), f"{WITH} SELECT user_key, seq, op, value FROM (SELECT *, row_number() OVER (PARTITION BY user_key ORDER BY seq DESC) rn FROM l) t WHERE rn = 1")
simple("kv_live_after_compaction", lambda s, d: view.live(compaction.rewritten(events(s, d), 6000, 500)), f"{WITH} SELECT user_key, seq, value FROM ev")
simple(
    "kv_compacted_manifest", lambda s, d: segments.islands(compaction.compact_all(lines(s, d), 1 << 40)[1]).agg(F.count("*").alias("segments"), F.countDistinct("island").alias("islands"), F.sum("n_entries").cast("bigint").alias("entries")),
    f"{WITH} , k AS (SELECT user_key, row_number() OVER (ORDER BY user_key) - 1 r FROM (SELECT DISTINCT user_key FROM l) t), c AS (SELECT count(DISTINCT r // 500) n, count(*) entries FROM k) SELECT n AS segments, n AS islands, entries FROM c",
)


@query(f"{SEGS} SELECT * FROM om WHERE segment_id >= 10 UNION ALL SELECT 1000 + segment_id, inf_key, inf_seq, sup_key, sup_seq, stamp, n_entries FROM om WHERE segment_id < 10")
def kv_manifest_after_compaction(s: SparkSession, d: str) -> DataFrame:
    m = manifest_of(orders(s, d))
    old = m.where("segment_id < 10")
    return compaction.manifest_after(m, old, old.withColumn("segment_id", F.col("segment_id") + 1000))


# --- statistics
LIM = "lim AS (SELECT CAST(b AS INTEGER) - 1 AS bucket, hi, coalesce(lag(hi) OVER (ORDER BY b), 0) lo FROM (SELECT unnest(range(1, 155)) b, unnest([" + ", ".join(repr(x) for x in histogram.LIMITS) + "]) hi) z)"
HIST = f"WITH {LIM}, v AS (SELECT event_type, value FROM events WHERE value IS NOT NULL), c AS (SELECT event_type, CAST(least((SELECT count(*) FROM lim WHERE hi <= value), 153) AS INTEGER) AS bucket, count(*) n, min(value) low, max(value) high FROM v GROUP BY 1, 2)"
simple("kv_histogram", lambda s, d: histogram.counts(s.read.parquet(f"{d}/events.parquet"), "value", "event_type"), f"{HIST} SELECT * FROM c")
simple(
    "kv_histogram_merge", lambda s, d: histogram.merged(histogram.counts(s.read.parquet(f"{d}/events.parquet"), "value", "event_type")),
    f"{HIST} SELECT bucket, CAST(sum(n) AS BIGINT) n, min(low) low, max(high) high FROM c GROUP BY bucket",
)
simple(
    "kv_histogram_table", lambda s, d: histogram.table(histogram.counts(s.read.parquet(f"{d}/events.parquet"), "value", "event_type"), "event_type"),
    f"{HIST}, t AS (SELECT *, sum(n) OVER (PARTITION BY event_type) total, sum(n) OVER (PARTITION BY event_type ORDER BY bucket) run FROM c) SELECT event_type, t.bucket, lo low_bound, hi high_bound, n, 100.0::DOUBLE * n / total AS percent, 100.0::DOUBLE * run / total cumulative, repeat('#', CAST(floor(20.0::DOUBLE * n / total + 0.5) AS INTEGER)) bar FROM t JOIN lim ON lim.bucket = t.bucket",
)
simple(
    "kv_histogram_percentiles", lambda s, d: histogram.percentiles(histogram.counts(s.read.parquet(f"{d}/events.parquet"), "value", "event_type"), [50.0, 95.0, 99.0], "event_type"),
    f"{HIST}, t AS (SELECT c.*, lo, hi, sum(n) OVER (PARTITION BY event_type) total, sum(n) OVER (PARTITION BY event_type ORDER BY c.bucket) run, min(low) OVER (PARTITION BY event_type) least_, max(high) OVER (PARTITION BY event_type) most_ FROM c JOIN lim ON lim.bucket = c.bucket), q AS (SELECT *, CAST(total * (p / 100.0::DOUBLE) AS DOUBLE) rank FROM t, (VALUES (50.0::DOUBLE), (95.0::DOUBLE), (99.0::DOUBLE)) w(p)) SELECT event_type, p, least(greatest(lo + (hi - lo) * ((rank - (run - n)) / n), least_), most_) AS value FROM q WHERE run >= rank AND run - n < rank",
)
simple("kv_scan_bytes", lambda s, d: scan.scan_bytes(view.live(orders(s, d)).withColumn("value", F.col("seq").cast("string"))), f"{WITH} SELECT count(*) entries, CAST(sum(strlen(user_key) + strlen(CAST(seq AS VARCHAR))) AS BIGINT) bytes FROM ov")
simple("kv_range_sizes", lambda s, d: view.live(orders(s, d)).groupBy(F.substring("user_key", 1, 13).alias("range_key")).agg(F.count("*").alias("entries"), F.sum(F.octet_length("user_key") + 8).cast("bigint").alias("bytes")), f"{WITH} SELECT substr(user_key,1,13) range_key, count(*) entries, CAST(sum(strlen(user_key) + 8) AS BIGINT) bytes FROM ov GROUP BY 1")

# --- scalar functions
simple("kv_key_codec", lambda s, d: s.read.parquet(f"{d}/part.parquet").select(keys.int_key(F.col("p_partkey")).alias("k"), keys.key_int(keys.int_key(F.col("p_partkey"))).alias("n")), "SELECT lpad(CAST(p_partkey AS VARCHAR),16,'0') k, p_partkey n FROM part")
simple("kv_internal_key_order", lambda s, d: scan.numbered(events(s, d), keys.internal_order(), name="place").select("user_key", "seq", "op", "place"), f"{WITH} SELECT user_key, seq, op, row_number() OVER (ORDER BY user_key, seq DESC, op DESC) place FROM e")
simple("kv_pack_tag", lambda s, d: events(s, d).select("user_key", "seq", "op", keys.pack_tag(F.col("seq"), F.col("op")).alias("tag")), f"{WITH} SELECT user_key, seq, op, CAST(seq*256+op AS BIGINT) tag FROM e")
simple("kv_parse_internal_key", lambda s, d: events(s, d).select(keys.parse_internal_key(keys.internal_key(F.col("user_key"), F.col("seq"), F.col("op"))).alias("k")).select(F.col("k.user_key").cast("string").alias("user_key"), "k.seq", "k.op"), f"{WITH} SELECT user_key, seq, op FROM e")
simple("kv_debug_key", lambda s, d: events(s, d).select(keys.debug_key(F.col("user_key"), F.col("seq"), F.col("op")).alias("k")), f"{WITH} SELECT concat('''', user_key, ''' @ ', seq, ' : ', op) k FROM e")
simple("kv_varint_length", lambda s, d: s.read.parquet(f"{d}/orders.parquet").select("o_orderkey", keys.varint_length(F.col("o_orderkey") * F.col("o_orderkey")).alias("n")), "SELECT o_orderkey, CAST(greatest(1, ceil(length(bin(o_orderkey*o_orderkey))/7.0)) AS INTEGER) n FROM orders")
simple("kv_power2", lambda s, d: s.read.parquet(f"{d}/orders.parquet").select("o_orderkey", keys.next_power2(F.col("o_orderkey")).alias("n")), "SELECT o_orderkey, CAST(CASE WHEN o_orderkey <= 1 THEN o_orderkey ELSE 1::BIGINT << length(bin(o_orderkey-1)) END AS BIGINT) n FROM orders")
simple(
    "kv_consume_decimal", lambda s, d: s.read.parquet(f"{d}/pages.parquet").select("page_id", keys.consume_decimal(F.regexp_extract("url", r"([0-9].*)$", 1)).alias("c")).select("page_id", F.col("c.number").cast("bigint").alias("number"), F.col("c.rest").alias("rest")),
    "SELECT page_id, CAST(nullif(regexp_extract(t, '^([0-9]+)', 1), '') AS BIGINT) number, CASE WHEN t <> '' THEN regexp_replace(t, '^[0-9]+', '') END rest FROM (SELECT page_id, regexp_extract(url, '([0-9].*)$', 1) t FROM pages) x",
)

# --- byte formats
LITTLE = lambda n, size: "concat(" + ", ".join(f"printf('%02X', ({n} >> {8 * i}) & 255)" for i in range(size)) + ")"
VARINT = lambda n: "concat(" + ", ".join(f"CASE WHEN {i} = 0 OR ({n} >> {7 * i}) > 0 THEN printf('%02X', (({n} >> {7 * i}) & 127) + CASE WHEN ({n} >> {7 * (i + 1)}) > 0 THEN 128 ELSE 0 END) ELSE '' END" for i in range(5)) + ")"


def crc32c_sql(data: str) -> str:
    """A text's checksum, byte by byte."""
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, 1 + 2 * strlen({data}), 2), lambda i: CAST('0x' || substr(hex(encode({data})), i, 2) AS BIGINT))), lambda a, b: xor(a >> 8, ({fmt.TABLE.tolist()}::BIGINT[])[(xor(a, b) & 255) + 1])), 4294967295)"


def table(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda s, d: s.read.parquet(f"{d}/{name}.parquet")


simple("kv_crc32c", lambda s, d: table("benchmark")(s, d).select("item_id", fmt.crc32c_udf(F.col("text").cast("binary")).alias("crc")), f"SELECT item_id, {crc32c_sql('text')} crc FROM benchmark")
simple("kv_crc32c_mask", lambda s, d: table("orders")(s, d).select("o_orderkey", keys.masked_crc(F.col("o_orderkey")).alias("masked"), keys.unmasked_crc(keys.masked_crc(F.col("o_orderkey"))).alias("back")), "SELECT o_orderkey, CAST(((((o_orderkey >> 15) | (o_orderkey << 17)) & 4294967295) + 2726488792) & 4294967295 AS BIGINT) masked, o_orderkey back FROM orders")
simple("kv_varint", lambda s, d: table("orders")(s, d).select("o_orderkey", F.hex(keys.varint(F.col("o_orderkey") * 7919)).alias("shown")), f"SELECT o_orderkey, {VARINT('(o_orderkey*7919)')} shown FROM orders")
simple("kv_varint_roundtrip", lambda s, d: table("orders")(s, d).select("o_orderkey", fmt.get_varint_udf(keys.varint(F.col("o_orderkey") * 7919)).alias("back")), "SELECT o_orderkey, o_orderkey*7919 back FROM orders")
simple(
    "kv_fixed_widths", lambda s, d: table("orders")(s, d).select("o_orderkey", keys.little_endian(F.col("o_orderkey") * 65537, 4).alias("four"), keys.little_endian(F.col("o_orderkey") * 65537, 8).alias("eight")).select("o_orderkey", F.hex("four").alias("four"), F.hex("eight").alias("eight"), keys.from_little_endian(F.col("eight"), 0, 8).alias("back")),
    f"SELECT o_orderkey, {LITTLE('(o_orderkey*65537)', 4)} four, {LITTLE('(o_orderkey*65537)', 8)} eight, o_orderkey*65537 back FROM orders",
)
simple(
    "kv_length_prefixed", lambda s, d: table("documents")(s, d).select("doc_id", keys.length_prefixed(F.substring("text", 1, 300).cast("binary")).alias("b")).select("doc_id", F.hex("b").alias("shown"), fmt.get_slice_udf("b").cast("string").alias("back")),
    f"SELECT doc_id, {VARINT('strlen(t)')} || hex(encode(t)) shown, t back FROM (SELECT doc_id, substr(text, 1, 300) t FROM documents) x",
)
simple(
    "kv_escape", lambda s, d: table("documents")(s, d).select("doc_id", fmt.escaped_udf(F.substring("text", 1, 60).cast("binary")).alias("shown")),
    "SELECT doc_id, array_to_string(list_transform(range(1, 1 + 2 * strlen(t), 2), lambda i: CASE WHEN CAST('0x' || substr(hex(encode(t)), i, 2) AS INTEGER) BETWEEN 32 AND 126 THEN chr(CAST('0x' || substr(hex(encode(t)), i, 2) AS INTEGER)) ELSE '\\x' || lower(substr(hex(encode(t)), i, 2)) END), '') shown FROM (SELECT doc_id, substr(text, 1, 60) t FROM documents) x",
)
simple("kv_short_successor", lambda s, d: table("customer")(s, d).select("c_custkey", fmt.successor_udf(F.col("c_name").cast("binary")).cast("string").alias("after")), "SELECT c_custkey, chr(ascii(c_name)+1) AS after FROM customer")
simple(
    "kv_short_separator", lambda s, d: customers(s, d).select(F.col("user_key").alias("a"), keys.int_key(keys.key_int(F.col("user_key")) * 3 + 200).alias("b")).select("a", "b", fmt.separator_udf(F.col("a").cast("binary"), F.col("b").cast("binary")).cast("string").alias("sep")),
    f"WITH x AS (SELECT 1){PROBES}, r AS (SELECT user_key a, lpad(CAST(CAST(user_key AS BIGINT)*3+200 AS VARCHAR),16,'0') b FROM p), f AS (SELECT *, list_filter(range(1, 17), lambda i: substr(a, i, 1) <> substr(b, i, 1))[1] i FROM r) SELECT a, b, CASE WHEN ascii(substr(a, i, 1)) + 1 < ascii(substr(b, i, 1)) THEN substr(a, 1, i - 1) || chr(ascii(substr(a, i, 1)) + 1) ELSE a END sep FROM f",
)
simple("kv_remove_prefix", lambda s, d: customers(s, d).select("user_key", keys.without_prefix(F.col("user_key"), 10).alias("rest")), f"WITH x AS (SELECT 1){PROBES} SELECT user_key, substr(user_key, 11) rest FROM p")
simple("kv_show_entry", lambda s, d: events(s, d).select(keys.shown_entry(F.col("user_key"), F.col("seq")).alias("shown")), f"{WITH} SELECT concat(user_key, '[', seq, ']') shown FROM e")
simple("kv_entry_bytes", lambda s, d: changelog.entry_bytes(events(s, d).withColumn("value", F.repeat(F.lit("x"), F.when(F.col("op") == 1, F.col("seq").cast("int") % 300)))).select("user_key", "seq", "raw_bytes"), f"{WITH}, v AS (SELECT *, CASE WHEN op = 1 THEN seq % 300 ELSE 0 END n FROM e) SELECT user_key, seq, CAST(1 + 24 + CASE WHEN n < 128 THEN 1 ELSE 2 END + n AS BIGINT) raw_bytes FROM v")
simple("kv_batch_clear", lambda s, d: changelog.batch_bytes(changelog.cleared(_batches(s, d)[0])), "SELECT CAST(12 AS BIGINT) bytes, CAST(0 AS BIGINT) ops")
simple(
    "kv_batch_header", lambda s, d: wal.encoded(events(s, d), 100).select(*[c.alias(n) for c, n in zip(wal.batch_header(F.col("data")), ("first_seq", "operations"), strict=True)]),
    f"{WITH} SELECT min(seq) first_seq, CAST(count(*) AS INTEGER) operations FROM e GROUP BY (seq - 1) // 100",
)
QUEUE = "SELECT c_nationkey queue, c_custkey writer, (c_custkey * 7919) % 90000 + CASE WHEN c_custkey % 11 = 0 THEN 300000 ELSE 0 END bytes, c_custkey % 7 = 0 sync FROM customer"
simple(
    "kv_write_groups", lambda s, d: changelog.write_groups(table("customer")(s, d).select(F.col("c_nationkey").alias("queue"), F.col("c_custkey").alias("writer"), ((F.col("c_custkey") * 7919) % 90000 + F.when(F.col("c_custkey") % 11 == 0, 300000).otherwise(0)).alias("bytes"), (F.col("c_custkey") % 7 == 0).alias("sync"))),
    f"""WITH RECURSIVE q AS (SELECT CAST(queue AS BIGINT) queue, writer, CAST(bytes AS BIGINT) bytes, sync, row_number() OVER (PARTITION BY queue ORDER BY writer) n FROM ({QUEUE}) x),
r AS (SELECT queue, writer, n, CAST(0 AS BIGINT) group_id, bytes total, sync leads, CASE WHEN bytes <= 131072 THEN bytes + 131072 ELSE 1048576 END most FROM q WHERE n = 1
  UNION ALL SELECT q.queue, q.writer, q.n, r.group_id + CASE WHEN r.total + q.bytes <= r.most AND (r.leads OR NOT q.sync) THEN 0 ELSE 1 END,
    CASE WHEN r.total + q.bytes <= r.most AND (r.leads OR NOT q.sync) THEN r.total + q.bytes ELSE q.bytes END, CASE WHEN r.total + q.bytes <= r.most AND (r.leads OR NOT q.sync) THEN r.leads ELSE q.sync END,
    CASE WHEN r.total + q.bytes <= r.most AND (r.leads OR NOT q.sync) THEN r.most WHEN q.bytes <= 131072 THEN q.bytes + 131072 ELSE 1048576 END FROM r JOIN q ON q.queue = r.queue AND q.n = r.n + 1)
SELECT queue, writer, group_id FROM r""",
)
simple(
    "kv_histogram_summary", lambda s, d: histogram.summary(table("events")(s, d).withColumn("v", F.floor("value")), "v", "event_type").select("event_type", "n", F.round("average", 6).alias("average"), F.round("deviation", 6).alias("deviation"), "least", "most"),
    "SELECT event_type, count(v) n, round(avg(v), 6) average, round(stddev_pop(v), 6) deviation, min(v) least, max(v) most FROM (SELECT event_type, CAST(floor(value) AS BIGINT) v FROM events) x GROUP BY event_type",
)
simple(
    "kv_run_stats", lambda s, d: workload.merged_stats(table("lineitem")(s, d).select(F.col("l_returnflag").alias("name"), F.col("l_linenumber").cast("double").alias("started"), (F.col("l_linenumber") + 2 + F.col("l_orderkey") % 5).cast("double").alias("finished"), (2 + F.col("l_orderkey") % 5).cast("double").alias("seconds"), F.lit(10).alias("ops"), F.col("l_partkey").alias("bytes"))),
    "SELECT l_returnflag AS name, CAST(10*count(*) AS BIGINT) ops, CAST(sum(l_partkey) AS BIGINT) bytes, 1e6 * sum(CAST(2 + l_orderkey % 5 AS DOUBLE)) / (10*count(*)) micros_per_op, CAST(sum(l_partkey) AS DOUBLE) / 1048576 / (max(CAST(l_linenumber + 2 + l_orderkey % 5 AS DOUBLE)) - min(l_linenumber)) mb_per_s FROM lineitem GROUP BY 1",
)

# --- generators
LCG = "WITH RECURSIVE g AS (SELECT CAST(0 AS BIGINT) id, CAST(301 AS BIGINT) draw UNION ALL SELECT id + 1, (draw * 16807) % 2147483647 FROM g WHERE id < {})"
simple("kv_lcg", lambda s, d: workload.draws(s, 1000), LCG.format(1000) + " SELECT id, draw, draw % 100 uniform, draw % 10 = 0 one_in_ten FROM g WHERE id > 0")
simple("kv_skewed_draws", lambda s, d: workload.skewed(s, 300), LCG.format(600) + " SELECT b.id // 2 id, b.draw % (CAST(1 AS BIGINT) << CAST(a.draw % 11 AS INTEGER)) skewed FROM g a JOIN g b ON b.id = a.id + 1 WHERE b.id % 2 = 0 AND b.id > 0")
simple("kv_random_strings", lambda s, d: workload.random_strings(s, 50, 8), LCG.format(400) + " SELECT (id - 1) // 8 id, string_agg(chr(CAST(32 + draw % 95 AS INTEGER)), '' ORDER BY id) AS text FROM g WHERE id > 0 GROUP BY 1")
simple("kv_edge_keys", lambda s, d: workload.edge_keys(s, 40, 6).select("id", F.hex("text").alias("shown")), LCG.format(240) + " SELECT (id - 1) // 6 id, string_agg(substr('00016162636465FDFEFF', CAST(1 + 2 * (draw % 10) AS INTEGER), 2), '' ORDER BY id) shown FROM g WHERE id > 0 GROUP BY 1")
FILL = LCG.format("2000") + ", f AS (SELECT lpad(CAST(draw % 2000 AS VARCHAR),16,'0') user_key, id seq, 1 op, substr(repeat(substr(md5(concat(id-1,'-0')) || md5(concat(id-1,'-1')), 1, 50), 2), 1, 100) AS value FROM g WHERE id > 0)"
simple("kv_workload_fill", lambda s, d: workload.fill(s, 2000, "random"), f"{FILL} SELECT user_key, seq, op, value FROM f")
simple("kv_workload_overwritten", lambda s, d: view.live(workload.fill(s, 2000, "random").unionByName(workload.fill(s, 2000, "random", base=2000))), f"{FILL} SELECT user_key, 2000 + max(seq) seq, arg_max(value, seq) AS value FROM f GROUP BY user_key")
simple("kv_delete_wave", lambda s, d: view.latest(workload.fill(s, 1000).unionByName(workload.delete_wave(workload.fill(s, 1000), 1000))).groupBy("op").agg(F.count("*").alias("n"), F.min("seq").alias("first_seq")), "SELECT 0 op, CAST(1000 AS BIGINT) n, CAST(1001 AS BIGINT) first_seq")
for _kind, _sql in (("random", "lpad(CAST(draw % 2000 AS VARCHAR),16,'0')"), ("hot", "lpad(CAST(draw % 20 AS VARCHAR),16,'0')"), ("missing", "lpad(CAST(draw % 2000 AS VARCHAR),16,'0') || '.'")):
    simple(
        f"kv_read_{_kind}", lambda s, d, kind=_kind: lookup.multi_get(view.live(workload.fill(s, 2000, "random")), workload.probes(s, 500, kind, 2000)).agg(F.count("*").alias("asked"), F.count(F.when(F.col("found"), 1)).alias("found")),
        FILL + f", h AS (SELECT CAST(0 AS BIGINT) id, CAST(999 AS BIGINT) draw UNION ALL SELECT id + 1, (draw * 16807) % 2147483647 FROM h WHERE id < 500) SELECT count(*) asked, count(*) FILTER ({_sql} IN (SELECT user_key FROM f)) AS found FROM h WHERE id > 0",
    )


# --- durable forms: written to the shared folder
def scratch(s: SparkSession, name: str) -> str:
    return f"{shared_folder(s)}/{name}-{uuid.uuid4().hex}"


@query(f"{WITH} SELECT user_key, seq, value FROM ov")
def kv_store_roundtrip(s: SparkSession, d: str) -> DataFrame:
    """Two writes, a flush and a compaction, read from a store that is opened again."""
    at = scratch(s, "store")
    store, o = Store.open(s, at), s.read.parquet(f"{d}/orders.parquet")
    key = keys.int_key(F.col("o_orderkey")).alias("user_key")
    store.put(o.select(key, F.col("o_totalprice").alias("value")))
    store.flush()
    store.delete(o.where("o_orderstatus = 'F'").select(key))
    store.flush()
    store.maybe_compact()
    store.vacuum()
    return Store.open(s, at).live()


@query(f"{WITH} SELECT user_key, seq, op, CAST(CAST(value * 100 AS BIGINT) AS VARCHAR) AS value FROM e")
def kv_wal_roundtrip(s: SparkSession, d: str) -> DataFrame:
    log = events(s, d).withColumn("value", F.round(F.col("value") * 100).cast("bigint"))
    return wal.decoded(wal.encoded(log))


@query(f"{WITH} SELECT user_key, seq, value FROM ev")
def kv_stream_ingest(s: SparkSession, d: str) -> DataFrame:
    at = scratch(s, "stream")
    store = Store.open(s, f"{at}/store")
    schema = s.read.parquet(f"{d}/events.parquet").schema
    stream = s.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    ingest(stream, store, lambda df: changelog.from_events(df).withColumnRenamed("seq", "event"), ["event"], f"{at}/checkpoint").awaitTermination()
    return store.live()


@query(f"{WITH} SELECT user_key, seq, op, CAST(CAST(value * 100 AS BIGINT) AS VARCHAR) AS value FROM e")
def kv_log_files(s: SparkSession, d: str) -> DataFrame:
    """The events as binary log files (batches, records, blocks, checksums), and read from them again."""
    at = scratch(s, "logs")
    wal.write_logs(events(s, d).withColumn("value", F.round(F.col("value") * 100).cast("bigint")), at, per_file=3000, batch=250)
    return wal.operations(wal.read_wal(s, at, paranoid=True))


@query(f"{WITH} SELECT user_key, seq, value FROM ev WHERE user_key < '0000000000000500'")
def kv_log_recovery(s: SparkSession, d: str) -> DataFrame:
    """A store that finds only binary logs in its folder when it is opened."""
    at = scratch(s, "recovered")
    wal.write_logs(events(s, d), at, per_file=4000)
    return Store.open(s, at).scan(hi="0000000000000500")


@query(f"{WITH}, {LIVE.format('e', 'WHERE seq <= 5000').replace('ev AS', 'sv AS')} SELECT 'then' AS at, user_key, value FROM sv UNION ALL SELECT 'now', user_key, value FROM ev")
def kv_store_snapshots(s: SparkSession, d: str) -> DataFrame:
    """Reads at a held snapshot and of the newest version, after more writes, a flush and a full compaction."""
    store, log = Store.open(s, scratch(s, "snapshots")), events(s, d)
    store.write(log.where("seq <= 5000").withColumnRenamed("seq", "at"), [F.col("at")])
    held = store.snapshot()
    store.write(log.where("seq > 5000").withColumnRenamed("seq", "at"), [F.col("at")])
    store.flush()
    store.compact_range()
    then, now = store.live(held), store.live()
    return then.select(F.lit("then").alias("at"), "user_key", "value").unionByName(now.select(F.lit("now").alias("at"), "user_key", "value"))


@query(f"{WITH}, r AS (SELECT * FROM (VALUES ('0000000000000010', '0000000000000050'), (NULL, '0000000000000020'), ('0000000000000090', NULL)) t(start, \"limit\")) SELECT start, \"limit\", (SELECT CAST(coalesce(sum(16 + coalesce(length(CAST(CAST(value * 100 AS BIGINT) AS VARCHAR)), 0)), 0) AS BIGINT) FROM e WHERE (start IS NULL OR user_key >= start) AND (\"limit\" IS NULL OR user_key < \"limit\")) bytes FROM r")
def kv_approximate_sizes(s: SparkSession, d: str) -> DataFrame:
    store = Store.open(s, scratch(s, "sizes"), value="bigint")
    store.write(events(s, d).withColumn("value", F.round(F.col("value") * 100).cast("bigint")).withColumnRenamed("seq", "at"), [F.col("at")])
    ranges = s.createDataFrame([("0000000000000010", "0000000000000050"), (None, "0000000000000020"), ("0000000000000090", None)], "start string, limit string")
    return store.approximate_sizes(ranges)


@query(f"{WITH} SELECT CAST(0 AS BIGINT) logs, CAST(count(*) AS BIGINT) entries, max(seq) last_seq, CAST(0 AS BIGINT) leftovers, count(*) = (SELECT count(*) FROM events) compacted FROM (SELECT *, row_number() OVER (PARTITION BY user_key ORDER BY seq DESC) rn FROM e) t WHERE rn = 1".replace("count(*) = (SELECT count(*) FROM events)", "true"))
def kv_store_stats(s: SparkSession, d: str) -> DataFrame:
    """Properties of a store whose write buffer rotates by itself, after compaction, repair and removal."""
    at = scratch(s, "stats")
    store = Store.open(s, at, Options(write_buffer_rows=1024))
    for part in range(2):
        store.write(events(s, d).where(F.col("seq") % 2 == part).withColumnRenamed("seq", "at"), [F.col("at")])
    rotated = store.stats()["logs"] == 0
    store.flush()
    store.compact_range()
    store.vacuum()
    store.files.delete(file_name("manifest", store.manifest().number))
    store.repair()
    stats = store.stats()
    destroy(s, at)
    newest = events(s, d).agg(F.max("seq").alias("seq")).first().seq
    return s.createDataFrame([(stats["logs"], stats["entries"], newest if stats["last_seq"] == newest else -1, len(store.files.list()), rotated or newest < 2048)], "logs long, entries long, last_seq long, leftovers long, compacted boolean")


@query(f"{WITH}, s AS (SELECT * FROM (VALUES (1), (2), (3)) t(step)), n AS (SELECT max(seq) // 3 + 1 size FROM e), c AS (SELECT step, user_key, op, row_number() OVER (PARTITION BY step, user_key ORDER BY seq DESC) rn FROM s, n, e WHERE (seq - 1) // size < step) SELECT step, count(*) FILTER (rn = 1 AND op = 1) live FROM c GROUP BY step")
def kv_read_while_writing(s: SparkSession, d: str) -> DataFrame:
    """A stream writes the events in three steps; what readers see after each is counted once all is written, on the
    version that they had opened."""
    at = scratch(s, "readers")
    store, log = Store.open(s, f"{at}/store"), table("events")(s, d)
    newest = log.agg(F.max("event_id") + 1).first()[0] or 0
    stepped = log.withColumn("step", F.expr(f"event_id div {newest // 3 + 1}"))
    stepped.repartition("step").sortWithinPartitions("event_id").write.partitionBy("step").parquet(f"{at}/in")
    written = {r.step for r in stepped.select("step").distinct().collect()}
    seen = []
    for step in range(3):
        if step in written:  # a step without events has no folder
            stream = s.readStream.schema(log.schema).parquet(f"{at}/in/step={step}")
            ingest(stream, store, lambda df: changelog.from_events(df).withColumnRenamed("seq", "event"), ["event"], f"{at}/checkpoint-{step}", f"step-{step}").awaitTermination()
        newest_of_key = view.latest(store.log())
        seen.append(newest_of_key.groupBy(F.lit(step + 1).alias("step")).agg(F.count(F.when(F.col("op") == 1, 1)).alias("live")))
    return seen[0].unionByName(seen[1]).unionByName(seen[2])
