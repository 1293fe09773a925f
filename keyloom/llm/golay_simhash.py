"""SimHash near-duplicates by Golay-code fuzzy hashing.

Fingerprints (64 bits, of word shingles) are cut into segments of 22, 21 and 21 bits, each a word of the binary Golay
code [23,12], which puts every word within three errors of one codeword. Four differing bits over three segments leave
either two segments with at most one error each, or one without any and two with two each. So each fingerprint gets
 - for each two segments, every pair of codewords that words within one error of its segments decode to, and
 - for each segment, its bits with every codeword that words within two errors of the next segment decode to,
and of two fingerprints that differ in four bits or fewer, one has a key that the other has from its own segments'
codewords. Nothing is missed for want of a key; candidates are verified bit by bit.

Only distinct fingerprints are keyed. Rows of a key lie next to each other after one shuffle; a run of them is linked
by a search that compares each reached fingerprint with those not yet reached, so a tight group of g fingerprints
costs about g comparisons and leaves g - 1 links, never all pairs. A run longer than RUN is first cut by sub-keys:
the six ranges of the third segment, of which four errors leave at least one exact; no pair is lost by that. Where more
than four bits may differ, no such cut is exact, and long runs are searched whole.
Components come from rounds of min-label propagation with shortcuts over these links, each round checkpointed.

Fingerprints of several words serve to find similar texts. Each word then has keys (pairs of segments only), and the
components are candidates: the distinct texts of each are compared by their sets of word shingles, exactly, and those
of a Jaccard similarity of `similar` or more are linked. A component's shingles are held by one task.

Cases: null texts have no words; texts without words have fingerprint zero and are linked like others; repeated rows
each keep a row; null ids never become a component's id unless it has no other; an empty table gives an empty result;
other columns are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import durable, kept_by_worker, scan_width, texts

SEED = 42
BITS = 4
#: First bit and number of bits of each segment.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Rows of one key that are searched together; longer runs are cut by sub-keys first.
RUN = 4096
SHINGLES = 4
#: Rounds that tie links to fewer members before components are searched.
TIES = 3
#: An odd constant that mixes hashes.
MIX = 0x9E3779B97F4A7C15
#: Candidates that are sent to all tasks to pick their texts; more are joined.
SENT = 500_000


def hashes(text: str | None, size: int) -> np.ndarray:
    """Hashes of a text's word shingles, in their order."""
    seq = (text or "").encode().lower().split()
    if not seq:
        return np.zeros(0, np.uint64)
    joined = b" ".join(seq)
    end = np.cumsum([len(w) + 1 for w in seq]).tolist()
    start = [0, *end[:-1]]
    n = max(1, len(seq) - size + 1)
    hashed = xxhash.xxh64_intdigest
    last = min(size, len(seq)) - 1
    return np.fromiter((hashed(joined[a : b - 1], SEED) for a, b in zip(start[:n], end[last:], strict=True)), np.uint64, n)


def digest(text: str | None) -> int:
    """A hash of a text's words as a signed long: texts of the same words have the same."""
    return xxhash.xxh64_intdigest(b" ".join((text or "").encode().lower().split()), SEED + 1) - (1 << 63)


def fingerprint(text: str | None, size: int = SHINGLES, words: int = 1) -> tuple[int, ...]:
    """Bit b is set if it is in over half of the hashes of the text's word shingles. Further words of the fingerprint
    are made likewise of the hashes mixed once more."""
    h = hashes(text, size)
    n = len(h)
    if not n:
        return (0,) * words
    out = []
    for _ in range(words):
        bits = np.zeros(64, np.int64)
        for at in range(0, n, 1 << 16):
            part = h[at : at + (1 << 16)]
            bits += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out.append(int(np.packbits(2 * bits > n, bitorder="little").view(np.uint64)[0]))
        h = (h ^ h >> np.uint64(31)) * np.uint64(MIX)
        h ^= h >> np.uint64(29)
    return tuple(out)


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLES, words: int = 1) -> DataFrame:
    """id and fp0, fp1, ... (the fingerprint's words as signed longs); several words come with the text's digest."""
    kind = df.schema[id_col].dataType.simpleString()
    names = [f"fp{i}" for i in range(words)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t, size, words) for t in b.column(1).to_pylist()], np.uint64).reshape(-1, words).view(np.int64)
            more = [pa.array([digest(t) for t in b.column(1).to_pylist()], pa.int64())] if words > 1 else []
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(fp[:, i].copy()) for i in range(words)), *more], [id_col, *names, *["digest"] * len(more)])

    return texts(df, id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, " + ", ".join(f"{n} long" for n in names) + ", digest long" * (words > 1))


class Golay:
    """Codeword numbers of 23-bit words, and those within one or two errors of them."""

    # Fixed value: the generator polynomial x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
    POLYNOMIAL = 0b101011100011

    def __init__(self):
        light = [0, *(1 << i for i in range(23)), *(1 << i | 1 << j for i in range(23) for j in range(i)), *(1 << i | 1 << j | 1 << k for i in range(23) for j in range(i) for k in range(j))]
        error = np.zeros(1 << 11, np.int32)
        for e in light:  # every syndrome belongs to one error of three bits or fewer
            error[self._remainder(e)] = e
        low = np.array([self._remainder(1 << i) for i in range(23)], np.int32)
        syndrome = np.zeros(1, np.int32)
        for r in low:
            syndrome = np.r_[syndrome, syndrome ^ r]
        self.number = ((np.arange(1 << 23, dtype=np.int32) ^ error[syndrome]) >> 11).astype(np.uint16)
        self.near = np.array(light[:24])
        self.nearer = np.array(light[: 24 + 253])

    def _remainder(self, word: int) -> int:
        for i in range(22, 10, -1):
            if word >> i & 1:
                word ^= self.POLYNOMIAL << (i - 11)
        return word

    def around(self, words: np.ndarray, errors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row of each word, and codeword number: each number of a word's surroundings once."""
        found = np.sort(self.number[words[:, None] ^ errors[None, :]], axis=1)
        new = np.c_[np.ones(len(words), bool), np.diff(found, axis=1) != 0]
        at, col = np.nonzero(new)
        return at, found[at, col].astype(np.int64)



def golay() -> Golay:
    return kept_by_worker("golay", Golay)


def keys_of(fp: np.ndarray, pairs_only: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Row and key of each fingerprint's keys; the six kinds of key are told apart by their lowest digit. Those of a
    segment without errors (pairs_only leaves them out) add little beyond BITS bits."""
    g = golay()
    seg = [(fp >> np.uint64(at) & np.uint64((1 << n) - 1)).astype(np.int64) for at, n in SEGMENTS]
    rows, keys = [], []
    near = [g.around(s, g.near) for s in seg]
    for k, (a, b) in enumerate(((0, 1), (0, 2), (1, 2))):
        # each pair of a row's codewords for the two segments
        (ra, ca), (rb, cb) = near[a], near[b]
        n = np.bincount(rb, minlength=len(fp))
        first = np.cumsum(n) - n
        times = n[ra]
        at = np.repeat(first[ra], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        rows.append(np.repeat(ra, times))
        keys.append((np.repeat(ca, times) << 12 | cb[at]) * 6 + k)
    for k, (a, b) in enumerate(() if pairs_only else ((0, 1), (1, 2), (2, 0))):
        r, c = g.around(seg[b], g.nearer)
        rows.append(r)
        keys.append((seg[a][r] << 12 | c) * 6 + 3 + k)
    return np.concatenate(rows), np.concatenate(keys)


def sub_keys(fp: np.ndarray, kind: int) -> list[np.ndarray]:
    """Six cuts of the segment that a kind of key leaves open: four errors leave one of the six, at least, alike."""
    at, n = SEGMENTS[{0: 2, 1: 1, 2: 0, 3: 2, 4: 0, 5: 1}[kind]]
    edges = np.linspace(0, n, 7).astype(int)
    return [fp >> np.uint64(at + a) & np.uint64((1 << (b - a)) - 1) for a, b in zip(edges, edges[1:], strict=False)]


def linked(fp: np.ndarray, bits: int = BITS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links that span the components of a set of fingerprints (a row of words each), as (from, to)."""
    left = fp
    while len(left) > 1:
        root, reached, left = left[:1], left[:1], left[1:]
        while len(reached) and len(left):
            at, reached = reached[:1], reached[1:]
            close = np.bitwise_count(left ^ at).sum(axis=1) <= bits
            if close.any():
                found = left[close]
                yield np.repeat(root, len(found), axis=0), found
                left, reached = left[~close], np.concatenate([reached, found])


def _run_links(fp: np.ndarray, kind: int, bits: int = BITS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    if len(fp) <= RUN or bits > BITS:
        yield from linked(fp, bits)
        return
    for cut in sub_keys(fp[:, 0], kind):
        order = np.argsort(cut, kind="stable")
        for part in np.split(fp[order], np.flatnonzero(np.diff(cut[order])) + 1):
            yield from linked(part, bits)


def links(distinct: DataFrame, names: list[str], partitions: int, bits: int = BITS) -> DataFrame:
    """a_, b_ and the names: fingerprints of which one leads to the other by steps of `bits` bits or fewer over all
    words. Up to BITS bits, keys are of the first word and miss no pair; beyond, every word has keys, and nearly all
    pairs of similar texts share one."""
    every = len(names) > 1 and bits > BITS

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.stack([c.to_numpy() for c in b.columns], axis=1)
            for at in range(0, len(fp), 2000):
                part = fp[at : at + 2000]
                for word in range(len(names) if every else 1):
                    row, key = keys_of(part[:, word].copy().view(np.uint64), every)
                    if every:
                        key = key * len(names) + word
                    yield pa.RecordBatch.from_arrays([pa.array(key), *(pa.array(part[row, i]) for i in range(len(names)))], ["key", *names])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def close(key: np.ndarray, signed: np.ndarray) -> Iterator[pa.RecordBatch]:
            fp = np.ascontiguousarray(signed).view(np.uint64)
            edges = np.flatnonzero(np.r_[True, np.diff(key) != 0, True])
            size = np.diff(edges)
            two = edges[:-1][size == 2]  # most runs: compared all at once
            near = two[np.bitwise_count(fp[two] ^ fp[two + 1]).sum(axis=1) <= bits]
            found = [(fp[near], fp[near + 1])]
            for lo, hi in zip(edges[:-1][size > 2].tolist(), edges[1:][size > 2].tolist(), strict=True):
                found += _run_links(np.unique(fp[lo:hi], axis=0), int(key[lo] % 6), bits)
            pairs = np.concatenate([np.concatenate(x) for x in zip(*found, strict=True)], axis=1).view(np.int64)
            if len(pairs):
                pairs = np.unique(pairs, axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, i].copy()) for i in range(pairs.shape[1])], [f"{x}_{n}" for x in "ab" for n in names])

        for batch in batches:
            key, fp = batch.column(0).to_numpy(), np.stack([c.to_numpy() for c in batch.columns[1:]], axis=1)
            if not len(key):
                continue
            held.append((key, fp))
            if key[-1] == held[0][0][0]:
                continue  # all of it is one run, which may go on in the next batch
            key, fp = (np.concatenate(x) for x in zip(*held, strict=True))
            cut = int(np.searchsorted(key, key[-1]))
            yield from close(key[:cut], fp[:cut])
            held = [(key[cut:], fp[cut:])]
        if held:
            yield from close(*(np.concatenate(x) for x in zip(*held, strict=True)))

    words = ", ".join(f"{n} long" for n in names)
    keyed = distinct.select(*names).mapInArrow(expand, f"key long, {words}").repartition(partitions, "key").sortWithinPartitions("key")
    return keyed.mapInArrow(search, ", ".join(f"{x}_{n} long" for x in "ab" for n in names)).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node and root (its component's least node) of every node of the links; edges: a, b.

    A tight group is linked once for each run that it shares, from that run's first member. So first each node is tied
    to the least of its links' first members, and those members to it: as many links as nodes, and a few between first
    members. (A node has a link for each of its keys at most, which bounds a window's group.)
    """
    least = F.min("a").over(Window.partitionBy("b"))
    edges = durable(edges)
    for _ in range(TIES):
        tied = edges.select("a", "b", least.alias("p"))
        edges = durable(tied.select(F.col("p").alias("a"), "b").unionByName(tied.select(F.col("p").alias("a"), F.col("a").alias("b"))).where("a != b").distinct())
    both = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("other")))
    labels = durable(both.groupBy("node").agg(F.least("node", F.min("other")).alias("root")))
    while True:
        # the least label next to a node, then that label's own label
        seen = both.join(labels.withColumnRenamed("node", "other"), "other").groupBy("node").agg(F.min("root").alias("near"))
        near = labels.join(seen, "node").select("node", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        hop = near.join(near.select(F.col("node").alias("root"), F.col("root").alias("far")), "root", "left")
        moved = durable(hop.select("node", "old", F.least("root", F.coalesce("far", "root")).alias("root")))
        labels = moved.select("node", "root")
        if moved.where("old != root").isEmpty():
            return labels


def alike(sets: list[np.ndarray], similar: float) -> np.ndarray:
    """The first member of each set's group: sets whose Jaccard similarity is `similar` or more are linked. Intersections
    are counted along the shingles' postings, and a set that was reached is not searched for again."""
    m, size = len(sets), np.array([len(x) for x in sets])
    _, token = np.unique(np.concatenate(sets), return_inverse=True)
    by_token = np.repeat(np.arange(m), size)[np.argsort(token, kind="stable")]
    edge, first = np.r_[0, np.cumsum(np.bincount(token))], np.r_[0, np.cumsum(size)]
    group, left = np.full(m, -1), m
    for root in range(m):
        if group[root] >= 0:
            continue
        group[root], reached, left = root, [root], left - 1
        while reached and left:
            at = reached.pop()
            lists = [by_token[edge[t] : edge[t + 1]] for t in token[first[at] : first[at + 1]].tolist()]
            if lists:
                both = np.bincount(np.concatenate(lists), minlength=m)
                found = np.flatnonzero((group < 0) & (both >= similar * (size + size[at] - both) - 1e-9))
                group[found] = root
                left -= len(found)
                reached += found.tolist()
    return group


def verified(df: DataFrame, wanted: DataFrame, partitions: int, id_col: str, text_col: str, size: int, similar: float) -> DataFrame:
    """digest and group (the digest of one member) of candidates: root, digest, least (an id that has the text)."""
    kind = df.schema[id_col].dataType.simpleString()

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([digest(t) for t in b.column(1).to_pylist()], pa.int64())], ["doc_id", "text", "digest"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, names, sets = None, [], []

        def close() -> tuple[list, list]:
            group = alike(sets, similar).tolist() if names else []
            return names, [names[g] for g in group]

        for b in batches:
            found, to = [], []
            for root, name, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if root != last:
                    for into, new in zip((found, to), close(), strict=True):
                        into += new
                    last, names, sets = root, [], []
                if not names or names[-1] != name:  # rows that repeat an id come once
                    names.append(name)
                    sets.append(np.unique(hashes(text, size)))
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(to, pa.int64())], ["digest", "group"])
        found, to = close()
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(to, pa.int64())], ["digest", "group"])

    wanted = durable(wanted)
    rows = texts(df, F.col(id_col), F.col(text_col)).mapInArrow(mark, f"doc_id {kind}, text string, digest long")
    chosen = (F.broadcast(wanted) if wanted.count() <= SENT else wanted).withColumnRenamed("digest", "wanted")
    rows = rows.join(chosen, (F.col("digest") == F.col("wanted")) & F.col("doc_id").eqNullSafe(F.col("least"))).select("root", "digest", "text")
    return rows.repartition(partitions, "root").sortWithinPartitions("root", "digest").mapInArrow(compare, "digest long, group long")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SHINGLES, bits: int = BITS, words: int = 1, similar: float = 0.8) -> DataFrame:
    """doc_id, fingerprint (hexadecimal, its first word), component_id (the least id of those reachable).

    With one word and bits up to BITS the links are complete. More words make the distance a sharper measure of the
    texts' similarity; what they and more bits find are candidates, and texts are linked that share `similar` of their
    shingles.
    """
    names = [f"fp{i}" for i in range(words)]
    # one word is its own node; several are known by a hash of them
    node = lambda x="": F.col(f"{x}fp0") if words == 1 else F.xxhash64(*[F.col(x + n) for n in names])
    marked = durable(fingerprints(df, id_col, text_col, size, words).withColumnRenamed(id_col, "doc_id").withColumn("node", node()))
    wide = max(scan_width(marked), int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    text = "node" if words == 1 else "digest"
    distinct = durable(marked.groupBy(*{"node": 0, text: 0}, *names).agg(F.min("doc_id").alias("least")))
    found = links(distinct if words == 1 else distinct.select(*names).distinct(), names, wide, bits)
    roots = components(found.select(node("a_").alias("a"), node("b_").alias("b")))
    joined = distinct.select(*{"node": 0, text: 0}, "least").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    if words > 1:
        joined = durable(joined)
        several = joined.groupBy("root").agg(F.count("*").alias("texts")).where("texts > 1").select("root")
        groups = verified(df, joined.join(several, "root").select("root", "digest", "least"), wide, id_col, text_col, size, similar)
        joined = durable(joined.join(groups, "digest", "left").select("digest", "least", F.coalesce("group", "digest").alias("root")))
    least = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    known = joined.join(least, "root").select(text, "component_id")
    return marked.join(known, text).select("doc_id", F.lpad(F.lower(F.hex("fp0")), 16, "0").alias("fingerprint"), "component_id")
