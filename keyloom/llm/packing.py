"""Lexical retrieval packing: windows filled with a seed document and its BM25 neighbours.

Documents are tokenised where they are read, and their token ids are dealt to tasks by content: in the order of
a sketch of the least places that a document's ids have in some fixed shufflings of the vocabulary, so that alike
documents lie together wherever the table has them. The bounds between tasks come from the sketches of a sample, so
that the table's tokens are shuffled once and stored nowhere; documents on a bound (the many copies of one) are dealt
to all tasks that it parts. Consecutive documents of a task make up index shards of about
`shard_tokens` tokens; each shard has its own inverted index over token ids (postings with BM25 weights), so an index
is bounded however large the table is. In a shard the first unused document, or the rest of one that was cut, is the
seed; all its terms retrieve the unused neighbours by score, and those that fit go into the seed's window in that
order, down to the last of them. The room left is filled with the beginning of the best document that did not fit,
whose rest seeds the next window; only without an unused neighbour is the next document taken. So all windows of a
shard are full but the last, whose documents are laid into windows of powers of two, which need no padding.

A task's result depends on its rows alone: a lost executor's task gives the same pieces again. Sequence ids have the
task's partition in the high bits.

Cases: null texts are empty and consist of the end id; repeated rows are packed each for itself; an empty table gives
an empty result; documents longer than a window take several; equal scores go by place in the shard; other columns,
whatever their names, are not carried.
"""

from __future__ import annotations

import os
import re
import unicodedata
import zlib
from array import array
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import kept_by_worker, let_go, scan_width, slices, texts
from .token_counts import byte_letters

# Fixed values of BM25.
K1, B = 1.2, 0.75
#: Shufflings of a document's sketch.
SKETCH, SEED = 8, 42
#: What the tokenizer does not treat as white space though str.split() does, or may treat as a special token.
ODD = ("\x1c", "\x1d", "\x1e", "\x1f", "<|")
#: Letters and ASCII marks behind them.
MARKED = re.compile(r"([^\W\d_]+)([!-/:-@\[-`{-~]+)")
#: Marks that end a word behind a lower-case Latin-1 letter; the search looks for marks first, which are few.
BEHIND = re.compile(r"[!-/:-@\[-`{-~](?<=[a-zß-öø-ÿ][!-/:-@\[-`{-~])[!-/:-@\[-`{-~]*(?!\S)")
#: Below the first, letters lower one by one, to letters; below the second and composed, only the first is lowered to
#: more than letters, which would join the marks behind a word.
PLAIN, SOUND = "\u0130", "\u0530"
#: Characters of texts that are tokenised together.
BATCH_CHARS = 2_000_000
#: Entries of each half of a Python worker's memo, and characters from which a word isn't remembered. When the younger
#: half is full, it becomes the older one, from which words that are met again come back; the rest is forgotten.
MEMO, LONG = 300_000, 64
#: Documents whose sketches are sampled for each task; a term's postings are a dense row from this share of a shard on.
SAMPLED, DENSE = 60, 1 / 8


def folded(text: str) -> str:
    """Lower case and marks behind letters apart, where that is certain to be the tokenizer's: fewer spellings to remember."""
    if not text.isascii():
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return text
    return BEHIND.sub(r" \g<0>", text.lower())


class Memo(dict):
    """Ids by word, where a word that isn't there is asked for: those that are cost one look-up."""

    def __init__(self, ask: Callable[[str], bytes]):
        self.ask = ask

    def __missing__(self, word: str) -> bytes:
        return self.ask(word)


class WordEncoder:
    """Token ids of texts for a tokenizer whose tokens never cross white space, memoised by word.

    Case is dropped by the tokenizer, and a word of letters and marks behind it falls into two, so most new words are
    spellings of known ones: where a text can be folded, they are made alike before it is split. Plain words go straight
    to the library's merges; all else is encoded by the library.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.merges = self.library.model
        shown = {b: c for c, b in byte_letters().items()}
        self.shown = {c: "".join(shown[b] for b in chr(c).encode()) for c in range(0x80, ord(PLAIN))}
        self.memo, self.older = Memo(self._unknown), {}
        self.long: dict[str, bytes] = {}  # of the texts at hand only

    def _encode(self, text: str) -> bytes:
        return array("H", self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids).tobytes()

    def _plain(self, word: str) -> bytes:
        """Ids of a lower-case word of plain letters."""
        return array("H", [t.id for t in self.merges.tokenize(word if word.isascii() else word.translate(self.shown))]).tobytes()

    @staticmethod
    def _parts(word: str) -> tuple[str, ...]:
        if word.isalpha():
            return (word.lower(),) if word.isascii() or max(word) < PLAIN else (word,)
        m = MARKED.fullmatch(word)
        if not m or not m[1].isalpha():
            return (word,)
        letters, top = m[1], max(m[1])
        if top < PLAIN:
            return (letters.lower(), m[2])
        return (letters, m[2]) if top < SOUND and PLAIN not in letters and unicodedata.is_normalized("NFC", letters) else (word,)

    def _unknown(self, word: str) -> bytes:
        """Ids of a word that the memo's younger half doesn't hold, which has it from now on unless it is long."""
        held = self.memo if len(word) < LONG else self.long
        if (ids := self.older.pop(word, None) if held is self.memo else held.get(word)) is None:
            parts = self._parts(word)
            if parts != (word,):
                ids = b"".join([self.memo[x] for x in parts])
            elif word.isalpha() and (word.isascii() or max(word) < PLAIN):
                ids = self._plain(word)
            else:
                ids = self._encode(word)
        held[word] = ids
        return ids

    def _ids(self, text: str) -> bytes:
        if any(x in text for x in ODD):
            return self._encode(text)
        if len(self.memo) > MEMO:
            self.memo, self.older = Memo(self._unknown), self.memo
        return b"".join(map(self.memo.__getitem__, folded(text).split()))

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        out = [np.frombuffer(self._ids(t), "<u2") for t in texts]
        self.long.clear()
        return out


def encoder(path: str) -> WordEncoder:
    return kept_by_worker(("word encoder", path), lambda: WordEncoder(path))


class Sketch:
    """Places of documents in an order by content: those that share most of their ids share their first least places."""

    def __init__(self):
        rng = np.random.default_rng(SEED)
        self.place = np.stack([rng.permutation(1 << 16) for _ in range(SKETCH)]).astype(np.uint16)

    def __call__(self, ids: np.ndarray) -> bytes:
        return self.place.take(ids, axis=1).min(axis=1).astype(">u2").tobytes() if len(ids) else b"\xff" * 2 * SKETCH


class Index:
    """BM25 postings of a shard's documents."""

    def __init__(self, docs: list[np.ndarray]):
        sizes = np.array([len(d) for d in docs])
        self.n = len(docs)
        key, tf = np.unique(np.repeat(np.arange(self.n) << 16, sizes) | np.concatenate(docs).astype(np.int64), return_counts=True)
        doc, term = key >> 16, key & 0xFFFF
        held = np.bincount(term, minlength=1 << 16)
        idf = np.log1p((self.n - held + 0.5) / (held + 0.5))
        weight = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * sizes[doc] / sizes.mean()))
        self.first = np.r_[0, np.cumsum(np.bincount(doc, minlength=self.n))]
        self.term, self.telling = term, np.where(held[term] > 1, weight, 0)
        order = np.argsort(term, kind="stable")
        self.at = np.r_[0, np.cumsum(held)]
        self.doc, self.weight = doc[order], weight[order]
        # terms that many documents have, as rows of a dense table of a few bytes a posting
        common = np.flatnonzero((held > max(1, DENSE * self.n)))
        self.row = np.full(1 << 16, -1, np.int32)
        self.row[common] = np.arange(len(common))
        self.dense = np.zeros((len(common), self.n), np.float32)
        at = self.row[term] >= 0
        self.dense[self.row[term[at]], doc[at]] = weight[at]

    def neighbours(self, seed: int) -> np.ndarray:
        """Documents that share terms with the seed, by falling score; ties to the earlier."""
        lo, hi = self.first[seed], self.first[seed + 1]
        terms = self.term[lo:hi][self.telling[lo:hi] > 0]
        rows = self.row[terms]
        score = self.dense[rows[rows >= 0]].sum(axis=0, dtype=np.float64)
        lists = [slice(self.at[t], self.at[t + 1]) for t in terms[rows < 0].tolist()]
        if lists:
            score += np.bincount(np.concatenate([self.doc[x] for x in lists]), np.concatenate([self.weight[x] for x in lists]), self.n)
        order = np.argsort(-score, kind="stable")
        return order[score[order] > 0]


def pack_shard(docs: list[np.ndarray], window: int) -> list[list[tuple[int, int, int]]]:
    """Sequences of pieces (document, start, length) that hold every token of the shard once."""
    index, size = Index(docs), [len(d) for d in docs]
    sizes = np.array(size)
    unused = np.ones(len(docs), bool)
    rest: tuple[int, int] | None = None  # a cut document and where its rest starts
    out, nxt = [], 0
    while True:
        if rest is None:
            while nxt < len(docs) and not unused[nxt]:
                nxt += 1
            if nxt == len(docs):
                break
            rest, unused[nxt] = (nxt, 0), False
        seed, start = rest
        take = min(window, size[seed] - start)
        pieces, room = [(seed, start, take)], window - take
        rest = (seed, start + take) if start + take < size[seed] else None
        if room:
            near = index.neighbours(seed)
            near, at = near[unused[near]], 0
            while room and len(fit := np.flatnonzero(sizes[near[at:]] <= room)):
                at += int(fit[0]) + 1
                d = int(near[at - 1])
                pieces.append((d, 0, size[d]))
                unused[d] = False
                room -= size[d]
            # the best neighbour that didn't fit
            left = next(iter(near[unused[near]][:1].tolist()), None)
            while room:
                if left is None:
                    while nxt < len(docs) and not unused[nxt]:
                        nxt += 1
                    if nxt == len(docs):
                        break
                    left = nxt
                take = min(room, size[left])
                pieces.append((left, 0, take))
                unused[left] = False
                room -= take
                rest = (left, take) if take < size[left] else None
                left = None
        out.append(pieces)
    if out and (total := sum(p[2] for p in out[-1])) < window:
        out += _powers(out.pop(), total)
    return out


def _powers(pieces: list[tuple[int, int, int]], total: int) -> list[list[tuple[int, int, int]]]:
    """A last, short sequence as sequences whose lengths are powers of two."""
    out, at = [], 0
    pieces = list(pieces)
    for bit in range(total.bit_length() - 1, -1, -1):
        room, here = total & 1 << bit, []
        while room:
            d, start, n = pieces[at]
            take = min(room, n)
            here.append((d, start, take))
            room -= take
            if take == n:
                at += 1
            else:
                pieces[at] = (d, start + take, n - take)
        if here:
            out.append(here)
    return out


def packed(df: DataFrame, tokenizer: str, window: int = 4096, end_id: int = 2, shard_tokens: int = 1 << 20, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of each piece; with_ids adds its token ids."""
    kind = df.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids binary" * with_ids

    def encoded(b: pa.RecordBatch, at: int) -> Iterator[tuple[int, int, list[np.ndarray]]]:
        values = [t or "" for t in b.column(at).to_pylist()]
        for lo, hi in slices(values, len, BATCH_CHARS):
            yield lo, hi, encoder(tokenizer)(values[lo:hi])

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = Sketch()
        for b in batches:
            seen = [(sketch(x), len(x) + 1) for _, _, found in encoded(b, 0) for x in found]
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in seen], pa.binary()), pa.array([n for _, n in seen], pa.int64())], ["place", "n"])

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, edges = Sketch(), bounds.value
        for b in batches:
            for lo, hi, found in encoded(b, 1):
                place, spread = [sketch(x) for x in found], b.column(2)[lo:hi].to_pylist()
                part = []
                for p, k in zip(place, spread, strict=True):
                    first = bisect_left(edges, p)
                    part.append(first + k % (bisect_right(edges, p, first) - first + 1))
                yield pa.RecordBatch.from_arrays([b.column(0)[lo:hi], pa.array([x.tobytes() for x in found], pa.binary()), pa.array(place, pa.binary()), pa.array(part, pa.int32())], ["doc_id", "tokens", "place", "part"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()  # the encoder: this is another stage, and an index takes its own room
        end, id_kind = np.array([end_id], "<u2"), None
        names, docs, tokens, sequence = [], [], 0, TaskContext.get().partitionId() << 32

        def flush() -> pa.RecordBatch:
            nonlocal sequence
            out = []
            for pieces in pack_shard(docs, window):
                offset = 0
                for d, start, n in pieces:
                    ids = docs[d][start : start + n].astype("<u4").tobytes()
                    out.append((names[d], start, n, zlib.crc32(ids), len(docs[d]), sequence, offset, ids))
                    offset += n
                sequence += 1
            names_, *numbers, ids = zip(*out, strict=True)
            cols = [pa.array(names_, id_kind), *(pa.array(x, pa.int64()) for x in numbers), *([pa.array(ids, pa.binary())] if with_ids else [])]
            return pa.RecordBatch.from_arrays(cols, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *["ids"] * with_ids])

        for b in batches:
            id_kind = b.column(0).type
            for name, found in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                names.append(name)
                docs.append(np.concatenate([np.frombuffer(found, "<u2"), end]))
                tokens += len(docs[-1])
                if tokens >= shard_tokens:
                    yield flush()
                    names, docs, tokens = [], [], 0
        if docs:
            yield flush()

    width = scan_width(df)
    share = min(1.0, SAMPLED * width / max(1, df.count()))
    drawn = sorted((bytes(r.place), r.n) for r in texts(df.sample(share, seed=SEED), F.col(text_col)).mapInArrow(places, "place binary, n long").collect()) if width > 1 else []
    # equal shares of the sampled tokens, as long documents lie together
    upto = np.cumsum([n for _, n in drawn])
    bounds = df.sparkSession.sparkContext.broadcast([drawn[int(np.searchsorted(upto, upto[-1] * i / width))][0] for i in range(1, width)] if drawn else [])
    rows = texts(df, F.col(id_col).alias("doc_id"), F.col(text_col), F.coalesce(F.pmod(F.xxhash64(F.col(id_col)), F.lit(1 << 20)), F.lit(0)).alias("spread"))
    rows = rows.mapInArrow(tokenise, f"doc_id {kind}, tokens binary, place binary, part int").repartitionById(width, "part")
    return rows.sortWithinPartitions("place", "doc_id", "tokens").select("doc_id", "tokens").mapInArrow(run, schema)
