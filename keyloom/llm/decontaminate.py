"""Benchmark decontamination with a generalised suffix automaton of the test items.

Items are normalised to words and added to one automaton over word numbers; a document's words run through it, and the
longest suffix that occurs in any item is known after each word. Where it reaches a window's length (`window` words, or
a whole shorter item), the words of that window are hit, and the items that hold it are those of the state that stands
for the window. Runs of words that no item has, or that are shorter than the shortest window, can't hold a window and
are passed over. Removal takes the words from the first to the last of each hit span and looks again at what has come
to stand together, until nothing is hit (by the automata sent together; all are sent once more); the whole document goes when the share of words taken reaches `coverage` or a
span reaches `longest` words.

The automata go to every task, so their size is bounded: items are added up to BLOCK_WORDS words to an automaton, and
up to PASS_WORDS words of automata (some 200 MB; 100 to 150 bytes a word) are sent at once. A larger benchmark is read
block after block, and the documents pass once for each PASS_WORDS words, what was found so far stored in between.

Cases: null texts have no words; null items, items without words and items without an id have no windows; equal items
count for each id; repeated documents each keep a row; very long texts are scanned word by word in memory linear in
their length; empty tables give empty or clean results; other columns, whatever their names, are kept by `cleaned` and
dropped by `contamination`.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import durable, texts

# Fixed value: a word, after lower-casing A-Z.
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
BLOCK_WORDS, PASS_WORDS = 250_000, 1_500_000


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").translate(FOLD))


class Automaton:
    """Suffix automaton of items, each a list of words under an id."""

    def __init__(self, items: list[tuple[object, list[str]]], window: int):
        self.window, self.number = window, {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        own: list[set] = [set()]
        ends: list[tuple[list[str], object]] = []  # whole short items
        for item, seq in items:
            state = 0
            for w in seq:
                state = self._add(state, self.number.setdefault(w, len(self.number)), own)
                own[state].add(item)
            if 0 < len(seq) < window:
                ends.append((seq, item))
        # what a state's strings occur in: its own items and those of the states that link to it
        self.items = own
        for s in sorted(range(1, len(own)), key=self.length.__getitem__, reverse=True):
            if self.link[s] > 0:
                own[self.link[s]] |= own[s]
        short: dict[int, dict[int, set]] = {}
        for seq, item in ends:
            state = 0
            for w in seq:
                state = self.next[state][self.number[w]]
            short.setdefault(state, {}).setdefault(len(seq), set()).add(item)
        self.short = short
        self.least = min([window, *(len(seq) for seq, _ in ends)])
        self._pack()

    def _pack(self) -> None:
        """Most states have one way on and share their items with others: flat arrays hold them."""
        self.word, self.to = array("i", [-1]) * len(self.next), array("i", [0]) * len(self.next)
        self.more: dict[int, dict[int, int]] = {}
        for s, ways in enumerate(self.next):
            if len(ways) == 1:
                ((self.word[s], self.to[s]),) = ways.items()
            elif ways:
                self.more[s] = ways
        known: dict[frozenset, int] = {}
        self.held = array("i", [known.setdefault(frozenset(x), len(known)) for x in self.items])
        self.items = list(known)
        self.link, self.length = array("i", self.link), array("i", self.length)
        del self.next

    def _add(self, last: int, c: int, own: list[set]) -> int:
        """The state of the current item's prefix with the word c added."""
        if c in self.next[last]:
            q = self.next[last][c]
            return q if self.length[q] == self.length[last] + 1 else self._split(last, c, q, own)
        cur = self._state(self.length[last] + 1, {}, own)
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = cur
            p = self.link[p]
        if p < 0:
            self.link[cur] = 0
        else:
            q = self.next[p][c]
            self.link[cur] = q if self.length[q] == self.length[p] + 1 else self._split(p, c, q, own)
        return cur

    def _state(self, length: int, follow: dict[int, int], own: list[set]) -> int:
        self.next.append(follow)
        self.link.append(0)
        self.length.append(length)
        own.append(set())
        return len(self.length) - 1

    def _split(self, p: int, c: int, q: int, own: list[set]) -> int:
        r = self._state(self.length[p] + 1, dict(self.next[q]), own)
        self.link[r], self.link[q] = self.link[q], r
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = r
            p = self.link[p]
        return r

    def spans(self, ids: list[int]) -> Iterator[tuple[int, int, set]]:
        """First word, one past the last, and items of each window that ends in these word numbers."""
        state = run = 0
        word, to, more, link, length, window = self.word, self.to, self.more, self.link, self.length, self.window
        none: dict[int, int] = {}
        for i, c in enumerate(ids):
            while True:
                found = to[state] if word[state] == c else more.get(state, none).get(c)
                if found is not None:
                    state = found
                    run += 1
                    break
                if not state:
                    break
                state = link[state]
                run = length[state]
            if run >= window:
                at = state
                while length[link[at]] >= window:
                    at = link[at]
                yield i + 1 - window, i + 1, self.items[self.held[at]]
            if self.short:
                at = state
                while at > 0:
                    for n, found in self.short.get(at, {}).items():
                        if n <= run:
                            yield i + 1 - n, i + 1, found
                    at = link[at]

    def search(self, ids: np.ndarray) -> Iterator[tuple[int, int, set]]:
        """spans() over the stretches of known words that are long enough."""
        known = np.flatnonzero(np.diff(np.r_[False, ids >= 0, False]))
        for lo, hi in known.reshape(-1, 2)[np.diff(known.reshape(-1, 2), axis=1)[:, 0] >= self.least].tolist():
            for a, b, found in self.spans(ids[lo:hi].tolist()):
                yield lo + a, lo + b, found


def automata(benchmark: DataFrame, window: int, item_col: str, text_col: str) -> Iterator[list[Automaton]]:
    """The benchmark as automata, as many at a time as are sent to the tasks together."""
    rows = benchmark.where(F.col(text_col).isNotNull() & F.col(item_col).isNotNull()).select(F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("text"))
    here, n, parts, total = [], 0, [], 0
    for item, text in rows.orderBy("item", "text").toLocalIterator():
        seq = words(text)
        if not seq:
            continue
        here.append((item, seq))
        n += len(seq)
        if n >= BLOCK_WORDS:
            parts.append(Automaton(here, window))
            total, here, n = total + n, [], 0
        if total >= PASS_WORDS:
            yield parts
            parts, total = [], 0
    if here:
        parts.append(Automaton(here, window))
    if parts:
        yield parts


def _in_passes(df: DataFrame, groups: Iterator[list[Automaton]], state: str, scan: Callable, finish: Callable, schema: str) -> DataFrame:
    """df through scan(batch, state columns, automata) for each group; each scan adds to the state columns, which are
    null at first, and the last one is finished where it is made. state and schema are DDL."""
    context, columns = df.sparkSession.sparkContext, df.columns
    kinds = T._parse_datatype_string(state)
    rows = df.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)], *[F.lit(None).cast(k.dataType).alias(f"_{k.name}") for k in kinds])
    between, width = rows.schema, len(columns)

    def step(parts: list[Automaton], last: bool) -> DataFrame:
        sent = context.broadcast(parts)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            scanner = Scanner(sent.value)
            for b in batches:
                data, old = b.columns[:width], [c.to_pylist() for c in b.columns[width:]]
                new = scan(data, old, scanner)
                yield finish(data, new) if last else pa.RecordBatch.from_arrays([*data, *(pa.array(x, b.columns[width + i].type) for i, x in enumerate(new))], b.schema.names)

        return rows.mapInArrow(run, schema if last else between)

    here = next(groups, [])
    while (following := next(groups, None)) is not None:
        rows, here = durable(step(here, False)), following
    return step(here, True)


class Scanner:
    """Hits of one text in all automata."""

    def __init__(self, parts: list[Automaton]):
        self.parts = parts

    def __call__(self, seq: list[str]) -> tuple[np.ndarray, set]:
        """Which words are hit, and the items found."""
        marks = np.zeros(len(seq) + 1, np.int32)
        items: set = set()
        for a in self.parts:
            get = a.number.get
            for lo, hi, found in a.search(np.array([get(w, -1) for w in seq], np.int32)):
                marks[lo] += 1
                marks[hi] -= 1
                items |= found
        return marks.cumsum()[:-1] > 0, items


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 8, least_items: int = 2, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """id, n_words, n_hit, n_items, items_sha256, contaminated of each document. One narrow pass over the documents."""

    def scan(data: list[pa.Array], old: list[list], scanner: Scanner) -> tuple[list, ...]:
        out = []
        for text, marks, items in zip(data[1].to_pylist(), old[1], old[2], strict=True):
            seq = words(text)
            hit, found = scanner(seq)
            if marks is not None:
                hit = hit | np.unpackbits(np.frombuffer(marks, np.uint8), count=len(seq)).astype(bool)
            out.append((len(seq), np.packbits(hit).tobytes(), sorted(found.union(items or ()))))
        return tuple(map(list, zip(*out, strict=True))) or ([], [], [])

    def finish(data: list[pa.Array], new: tuple[list, ...]) -> pa.RecordBatch:
        n_hit = [int(np.bitwise_count(np.frombuffer(m, np.uint8)).sum()) for m in new[1]]
        named = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in new[2]]
        cols = [(new[0], pa.int64()), (n_hit, pa.int64()), ([len(x) for x in new[2]], pa.int64()), (named, pa.string()), ([len(x) >= least_items for x in new[2]], pa.bool_())]
        return pa.RecordBatch.from_arrays([data[0], *(pa.array(x, t) for x, t in cols)], [id_col, "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
    return _in_passes(texts(docs, F.col(id_col), F.col(text_col)), automata(benchmark, window, item_col, item_text_col), "words long, marks binary, items array<string>", scan, finish, schema)


def without_spans(text: str, hit: np.ndarray) -> str:
    """The text without its hit words and what stands between them."""
    found = list(WORD.finditer(text.translate(FOLD)))
    edges = np.flatnonzero(np.diff(np.r_[False, hit, False])).reshape(-1, 2)
    out, at = [], 0
    for a, b in edges.tolist():
        out.append(text[at : found[a].start()])
        at = found[b - 1].end()
    return "".join([*out, text[at:]])


def cleaned(docs: DataFrame, benchmark: DataFrame, window: int = 8, coverage: float = 0.8, longest: int | None = None, text_col: str = "text", size_col: str = "n_chars", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The documents, all columns, with benchmark spans cut out of their texts; those of which at least `coverage` of
    the words were cut, or a span of `longest` words, go. size_col, if there, follows the text's length."""
    names = docs.columns
    at = names.index(text_col)

    def scan(data: list[pa.Array], old: list[list], scanner: Scanner) -> tuple[list, ...]:
        out = []
        for text, now, n, cut, run, round_ in zip(data[at].to_pylist(), *old, strict=True):
            now, first = (text, True) if n is None else (now, False)
            seq = words(now)
            n, cut, run, changed = len(seq) if first else n, cut or 0, run or 0, False
            while (hit := scanner(seq)[0]).any():
                cut, changed = cut + int(hit.sum()), True
                run = max(run, int(np.diff(np.flatnonzero(np.diff(np.r_[False, hit, False])).reshape(-1, 2), axis=1).max()))
                now = without_spans(now, hit)
                seq = words(now)
            out.append((now, n, cut, run, bool(round_) or changed))
        return tuple(map(list, zip(*out, strict=True))) or ([], [], [], [], [])

    def finish(data: list[pa.Array], new: tuple[list, ...]) -> pa.RecordBatch:
        cols = [*data]
        cols[at] = pa.array(new[0], cols[at].type)
        if size_col in names:
            k = names.index(size_col)
            old = cols[k].to_pylist()
            cols[k] = pa.array([len(t) if c else v for t, c, v in zip(new[0], new[4], old, strict=True)], cols[k].type)
        gone = [n > 0 and cut > 0 and (cut / n >= coverage or longest is not None and run >= longest) for _, n, cut, run, _ in zip(*new, strict=True)]
        return pa.RecordBatch.from_arrays(cols, names).filter(pa.array([not x for x in gone], pa.bool_()))

    groups = _in_rounds(lambda: automata(benchmark, window, item_col, item_text_col))
    return _in_passes(texts(docs, *[F.col(f"`{c}`") for c in names]), groups, "text string, n long, cut long, run long, changed boolean", scan, finish, docs.schema)


def _in_rounds(make: Callable[[], Iterator[list[Automaton]]]) -> Iterator[list[Automaton]]:
    """The groups, and where there are several, all of them once more: a cut may join words into another group's window."""
    n = 0
    for x in make():
        n += 1
        yield x
    if n > 1:
        yield from make()
