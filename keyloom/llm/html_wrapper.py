"""Main text of web pages by inferred wrappers: union-free regular expressions over a host's token streams.

A page's tokens form a tree of tags (with their classes) and texts. Pages of a host are aligned one after the other:
where both have the next tag it is matched and aligned inside, runs of like siblings, or of like short sequences of
siblings, become one repeated group, what only one has becomes an optional group, and texts that differ become slots.
The wrapper is the outcome: it says which texts never change over a host's pages (its template) and which container
holds most of the changing text.

A page's article is its article element, else its main element, else the container that the wrapper found. Out of it
(and of the page, where there is neither) go menus, headers, footers, sidebars, notices, adverts, forms, comments and
the like, told by tag, role and class, and the texts that the wrapper says never change, whatever their class. A host
has a wrapper for each branch of its pages: of the articles, of the main elements, and of the whole pages that mark
neither. Each is judged by its own pages; where nothing of a branch changes, template and text can't be told apart and
all of it stays.

Pages of one host, branch and skeleton (the tags, without the texts) merge without alignment and in any order, so they
are folded where they are read and then by hash. What is left, one wrapper a skeleton, is aligned in the order of the
skeletons' hashes, in up to FAN groups and then those with each other, so the outcome doesn't depend on how rows are
dealt, and a host with very many skeletons is no single task's work. Only hosts whose wrappers have something
to tell beyond the page's own marks become rules. Rules are broadcast below RULE_BYTES and joined by host above.

Cases: null and empty pages, and pages without an article's text, have empty text; a null url has the empty host;
broken and cut markup is read as far as it goes; elements nested more than DEEP levels below the branch are read like
others but are one slot to the wrapper, so no text there is template; long lists of children are aligned in linear
time (see _matches); repeated rows each keep a row and count as a page each; an empty table gives an empty result;
other columns, whatever their names, are not carried.
"""

from __future__ import annotations

import hashlib
import html
import pickle
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, texts
from .url_filter import host_of

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)>", re.S)
ATTRIBUTE = re.compile(r"([^\s=\"'/]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|(\bhidden\b)")
# Elements without an end, whose text is no markup, that start a block, and that are no article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
OUT = frozenset("script style noscript template nav header footer aside form iframe svg canvas object embed audio video button select textarea input dialog menu head title".split())
OUT_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
OUT_CLASS = re.compile(r"(?:^|[\s_-])(?:ad(?:s\w*|box|slot|unit|zone|block)?|advert\w*|sponsor\w*|promo\w*|banner|nav|navbar|navigation|menu|breadcrumbs?|side-?bar|widget|footer|site-?header|page-?header|masthead|notices?|cookies?|consent|gdpr|alert|pop-?up|modal|overlay|comments?|comment-?list|disqus\w*|discussion|reactions|replies|respond|share|sharing|social|related|recommend\w*|newsletter|subscribe|sign-?up|login|search|pagination|pager)(?:$|[\s_-])", re.I)
#: Classes that tell of a part elsewhere, not of this one: has-sidebar, with_ads.
ELSEWHERE = re.compile(r"(?:has|with|without|no|hide|show)[_-]\S*|\S+[_-](?:has|with|without|no)[_-]\S*", re.I)
#: Elements that an opening tag closes, if one of them is open.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = frozenset("ul ol dl table select article section div body html main nav aside form".split())
#: Pages of a host from which on an unchanging text is the template's, and an optional one; wrappers that a task holds;
#: bytes of rules sent.
LEAST_PAGES, OPTIONAL_PAGES, HELD, RULE_BYTES = 3, 5, 2000, 16 << 20
#: Levels that a wrapper has; siblings that make up a repeated sequence at most; cells of an alignment's table at most.
DEEP, SEQUENCE, CELLS = 100, 6, 40_000
#: Groups into which a host's skeletons are dealt.
FAN = 4096


class Node:
    __slots__ = ("tag", "key", "out", "children", "text")

    def __init__(self, tag: str, key: str, out: bool = False, text: str = ""):
        self.tag, self.key, self.out, self.text = tag, key, out, text
        self.children: list[Node] = []


def parse(page: str) -> Node:
    """The tree of a page's tokens."""
    root = Node("", "")
    stack, at, size = [root], 0, len(page)
    opened: Counter = Counter()

    def close(k: int) -> None:
        for x in stack[k:]:
            opened[x.tag] -= 1
        del stack[k:]

    def add_text(raw: str) -> None:
        if raw and not raw.isspace() or raw and stack[-1].children and stack[-1].children[-1].tag != "#":
            stack[-1].children.append(Node("#", "#", text=raw))

    while at < size:
        m = TOKEN.search(page, at)
        if not m:
            # a tag that the page's end cuts is no text
            cut = re.search(r"<(?:[a-zA-Z/!?][^<]*)?\Z", page[at:])
            add_text(page[at : at + cut.start()] if cut else page[at:])
            break
        add_text(page[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            if opened[tag]:
                close(next(k for k in range(len(stack) - 1, 0, -1) if stack[k].tag == tag))
            continue
        if tag in BLOCK and opened["p"]:  # an open p ends at a block, however deep its inline elements are
            k = next((k for k in range(len(stack) - 1, 0, -1) if stack[k].tag in BLOCK), 0)
            if stack[k].tag == "p":
                close(k)
        if any(opened[x] for x in CLOSES.get(tag, ())):
            k = next((k for k in range(len(stack) - 1, 0, -1) if stack[k].tag in CLOSES[tag] or stack[k].tag in SCOPE), 0)
            if stack[k].tag in CLOSES[tag]:
                close(k)
        attributes = {a[0].lower() or "hidden": html.unescape(a[1] or a[2] or a[3]) for a in ATTRIBUTE.findall(m[3])} if m[3].strip(" /") else {}
        names = " ".join(sorted(set((attributes.get("class", "") + " " + attributes.get("id", "")).split())))
        out = tag in OUT or bool(names and OUT_CLASS.search(ELSEWHERE.sub("", names))) or attributes.get("role", "").lower() in OUT_ROLES or "hidden" in attributes or attributes.get("aria-hidden") == "true" or "display:none" in attributes.get("style", "").replace(" ", "").lower()
        if tag == "header" and opened["article"]:  # the article's own head, with its title
            out = False
        if tag in ("html", "body", "article", "main"):
            out = False if tag != "article" else out and bool(re.search("comment|repl", names, re.I))
        node = Node("main" if attributes.get("role") == "main" else tag, f"{tag}.{re.sub(r'[0-9]+', '0', names)}" if names else tag, out)
        stack[-1].children.append(node)
        if tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else size
        elif tag not in VOID and not m[3].endswith("/"):
            stack.append(node)
            opened[tag] += 1
    return root


# A wrapper: [key, repeated, optional, pages, children] for tags; ["#", constant's hash or None, optional, pages, characters]
# for texts. A sequence of siblings that repeats is a tag of its own whose key starts with a bracket.


def wrapper_of(node: Node, with_out: bool = True, levels: int = DEEP) -> list:
    """The wrapper of one page, or of a part of it; with_out says if it has what is no article."""
    if node.tag == "#":
        text = " ".join(html.unescape(node.text).split())
        return ["#", zlib.crc32(text.encode("utf-8", "replace")), False, 1, len(text)]
    if not levels:
        return [node.key, False, False, 1, [["#", None, False, 1, sum(len(x.text) for x in _below(node))]]]
    return [node.key, False, False, 1, _grouped([wrapper_of(c, with_out, levels - 1) for c in node.children if c.tag not in ("script", "style") and (with_out or not c.out)])]


def _below(node: Node) -> Iterator[Node]:
    todo = [node]
    while todo:
        x = todo.pop()
        yield x
        todo += x.children


def branch_of(root: Node) -> tuple[str, list[Node]]:
    """The mark of a page's article and the elements that have it; no mark, and the page, if there is none."""
    for tag in ("article", "main"):
        if found := _find(root, lambda x, tag=tag: x.tag == tag and not x.out):
            return tag, found
    return "", [root]


def page_wrapper(root: Node) -> list:
    """The wrapper of a page's own branch, whose mark is its key."""
    branch, found = branch_of(root)
    return [branch, False, False, 1, _grouped([wrapper_of(x, False) for x in found])] if branch else wrapper_of(root)


def _grouped(items: list[list]) -> list[list]:
    """Runs of like siblings, then runs of like sequences of up to SEQUENCE siblings, as one repeated group each."""
    out: list[list] = []
    for w in items:
        if out and out[-1][0] == w[0]:
            out[-1] = _again(out[-1], w)
        else:
            out.append(w)
    for n in range(2, SEQUENCE + 1):
        if len(out) < 2 * n:
            break
        keys, found, i = [w[0] for w in out], [], 0
        while i < len(out):
            if keys[i : i + n] != keys[i + n : i + 2 * n] or "#" in keys[i : i + n] and n == 2 and keys[i] == keys[i + 1]:
                found.append(out[i])
                i += 1
                continue
            group, i, key = out[i : i + n], i + n, keys[i : i + n]
            while keys[i : i + n] == key:
                group = [_again(a, b, False) for a, b in zip(group, out[i : i + n], strict=True)]
                i += n
            found.append(["(" + " ".join(key) + ")", True, False, max(w[3] for w in group), group])
        out = found
    return out


def _again(a: list, b: list, alone: bool = True) -> list:
    """a's wrapper after another like sibling b, alone or in a sequence: pages are not added up."""
    w = aligned(a, b)
    w[3] = max(a[3], b[3])
    if alone and w[0] != "#":
        w[1] = True
    return w


def _matches(x: list, y: list) -> list[tuple[int, int]]:
    """Pairs of places of a common subsequence of two lists of keys: a longest one, by table, between their common
    ends; where that table would have more than CELLS cells, one found from left to right in linear time."""
    n = min(len(x), len(y))
    head = next((i for i in range(n) if x[i] != y[i]), n)
    tail = next((i for i in range(n - head) if x[-1 - i] != y[-1 - i]), n - head)
    a, b = x[head : len(x) - tail], y[head : len(y) - tail]
    found = []
    if len(a) * len(b) <= CELLS:
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a) - 1, -1, -1):
            for j in range(len(b) - 1, -1, -1):
                best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
        i = j = 0
        while i < len(a) and j < len(b):
            if a[i] == b[j]:
                found.append((i, j))
                i, j = i + 1, j + 1
            elif best[i + 1][j] >= best[i][j + 1]:
                i += 1
            else:
                j += 1
    else:
        # each next pair is the nearest one: the sides are read in turns until one has a key that the other has met
        i = j = 0
        while i < len(a) and j < len(b):
            seen_a, seen_b, k = {}, {}, 0
            while i + k < len(a) or j + k < len(b):
                if i + k < len(a):
                    seen_a.setdefault(a[i + k], i + k)
                if j + k < len(b):
                    seen_b.setdefault(b[j + k], j + k)
                hit = next((w for w in (a[i + k] if i + k < len(a) else None, b[j + k] if j + k < len(b) else None) if w in seen_a and w in seen_b), None)
                if hit is not None:
                    break
                k += 1
            else:
                break
            found.append((seen_a[hit], seen_b[hit]))
            i, j = seen_a[hit] + 1, seen_b[hit] + 1
    return [(i, i) for i in range(head)] + [(head + i, head + j) for i, j in found] + [(len(x) - tail + i, len(y) - tail + i) for i in range(tail)]


def aligned(a: list, b: list) -> list:
    """The wrapper of what either matches."""
    if a[0] == "#":
        return ["#", a[1] if a[1] == b[1] else None, a[2] or b[2], a[3] + b[3], a[4] + b[4]]
    x, y = a[4], b[4]
    inner, i, j = [], 0, 0
    pairs = _matches([w[0] for w in x], [w[0] for w in y])
    for p, q in [*pairs, (len(x), len(y))]:
        inner += [*map(_optional, x[i:p]), *map(_optional, y[j:q])]
        if p < len(x) and q < len(y):
            inner.append(aligned(x[p], y[q]))
        i, j = p + 1, q + 1
    return [a[0], a[1] or b[1], a[2] or b[2], a[3] + b[3], inner if len(pairs) == len(x) == len(y) else _grouped(inner)]


def skeleton(w: list) -> bytes:
    """A hash of the tags and groups of a page's wrapper, without its texts: wrappers that have the same one are equal
    but for constants and counts, so that aligning any number of them gives the same in every order."""
    h = hashlib.blake2b(digest_size=8)
    todo: list = [w]
    while todo:
        x = todo.pop()
        if x is None:
            h.update(b")")
            continue
        h.update(f"{x[0]}{x[1] if x[0] != '#' else ''}{x[2]}(".encode("utf-8", "replace"))
        if x[0] != "#":
            todo += [None, *reversed(x[4])]
    return h.digest()


def _optional(w: list) -> list:
    return [w[0], w[1], True, *w[3:]]


def expression(w: list) -> str:
    """The wrapper as a regular expression over tokens."""
    if w[0] == "#":
        return ("TEXT" if w[1] is None else f"'{w[1]:08x}'") + "?" * w[2]
    inner = " ".join(map(expression, w[4]))
    inner = inner if w[0].startswith("(") else f"<{w[0]}>{inner}</{w[0]}>"
    mark = "*" if w[1] and w[2] else "+" if w[1] else "?" if w[2] else ""
    return f"({inner}){mark}" if mark else inner


def _slots(w: list, path: str, pages: int, optional: bool = False) -> Iterator[tuple[str, list, int, bool]]:
    """Path, text, pages of each text (inside repeated groups counts are of repeats, so the least above it holds), and
    whether it or anything above it is optional."""
    pages, optional = min(pages, w[3]), optional or w[2]
    if w[0] == "#":
        yield path, w, pages, optional
    else:
        for c in w[4]:
            yield from _slots(c, path if c[0] == "#" or c[0].startswith("(") else f"{path}>{c[0]}", pages, optional)


def _size(w: list) -> int:
    """Characters of changing text."""
    return (w[4] if w[1] is None else 0) if w[0] == "#" else sum(map(_size, w[4]))


def rules_of(w: list) -> tuple[list[str], str]:
    """Paths (from the branch's mark) of the unchanging texts of a host's branch, and of the container with most of its
    changing text, if pages of the branch don't mark it; both empty if there are too few pages to tell."""
    slots = list(_slots(w, w[0], w[3]))
    if w[3] < LEAST_PAGES or all(s[1] is not None for _, s, *_ in slots):
        return [], ""
    fixed: dict[str, bool] = {}
    for p, s, pages, optional in slots:
        fixed[p] = fixed.get(p, True) and s[1] is not None and pages >= (OPTIONAL_PAGES if optional else LEAST_PAGES)
    at, path = w, ""
    while not w[0]:
        inner = [c for c in at[4] if c[0] != "#" and not c[1] and not c[0].startswith("(")]
        big = max(inner, key=_size, default=None)
        if big is None or 10 * _size(big) < 7 * _size(at) or big[0].split(".")[0] not in BLOCK or big[0] in ("p", "ul", "ol"):
            break
        at, path = big, f"{path}>{big[0]}"
    return sorted(p for p, v in fixed.items() if v), path


def _find(node: Node, test) -> list[Node]:
    """Topmost nodes that pass, outside what is no article."""
    found, todo = [], [node]
    while todo:
        x = todo.pop()
        if test(x):
            found.append(x)
        elif not x.out or x.tag in ("header", "form"):
            todo += reversed(x.children)
    return found


def blocks(nodes: list[tuple[Node, str]], fixed: frozenset[str]) -> list[str]:
    """Texts of the blocks in page order."""
    out, here = [], []

    def close() -> None:
        if text := " ".join(html.unescape("".join(here)).split()):
            out.append(text)
        here.clear()

    for node, path in nodes:
        # a node, its path (none where wrappers don't reach) and its level; a node left again is there as None
        todo: list[tuple[Node | None, str | None, int]] = [(c, path, 1) for c in reversed(node.children)]
        while todo:
            x, at, level = todo.pop()
            if x is None:
                close()
            elif x.tag == "#":
                if at is None or at not in fixed:
                    here.append(x.text)
            elif x.tag == "br":
                here.append(" ")
            elif not x.out:
                if x.tag in BLOCK:
                    close()
                    todo.append((None, None, 0))
                at = f"{at}>{x.key}" if at is not None and level <= DEEP else None
                todo += [(c, at, level + 1) for c in reversed(x.children)]
        close()
    return out


def main_text(page: str | None, rules: tuple[list[str], str] = ((), "")) -> str:
    root = parse(page or "")
    fixed, path = rules
    branch, found = branch_of(root)
    if branch:
        return "\n\n".join(blocks([(x, f"{branch}>{x.key}") for x in found], frozenset(fixed)))
    node = root
    for key in path.split(">")[1:]:
        node = next((c for c in node.children if c.key == key), None)
        if node is None:
            node, path = root, ""
            break
    return "\n\n".join(blocks([(node, path)], frozenset(fixed)))


def wrappers(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """host, branch and wrapper (pickled) of every host's branches."""
    schema = "host string, branch string, place long, wrapper binary"
    names = ["host", "branch", "place", "wrapper"]

    def sent(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True)) or [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.string(), pa.string(), pa.int64(), pa.binary()], strict=True)], names)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str, int], list] = {}
        for b in batches:
            for host, page in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if page:
                    w = page_wrapper(parse(page))
                    at = host, w[0], int.from_bytes(skeleton(w), "big", signed=True)
                    held[at] = aligned(held[at], w) if at in held else w
            if len(held) >= HELD:
                yield sent([(*at, pickle.dumps(w)) for at, w in held.items()])
                held.clear()
        yield sent([(*at, pickle.dumps(w)) for at, w in held.items()])

    def folded(df: DataFrame, groups: int | None) -> DataFrame:
        """Wrappers of a host and branch with the same place, or the same place modulo groups, as one."""

        def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            last, w = None, None
            for b in batches:
                done = []
                for *at, data in zip(*(c.to_pylist() for c in b.columns[:4]), strict=True):
                    at[2] = at[2] % groups if groups else at[2]
                    if at == last:
                        w = aligned(w, pickle.loads(data))
                    else:
                        done += [(*last, pickle.dumps(w))] if last else []
                        last, w = at, pickle.loads(data)
                yield sent(done)
            yield sent([(*last, pickle.dumps(w))] if last else [])

        group = F.pmod("place", F.lit(groups)) if groups else F.col("place")
        return df.repartition("host", "branch", group).sortWithinPartitions("host", "branch", group, "place").mapInArrow(meet, schema)

    found = texts(pages, host_of(F.col(url_col)).alias("host"), F.col(html_col)).mapInArrow(read, schema)
    for groups in (None, FAN, 1):
        found = folded(found, groups)
    return found.drop("place")


def main_texts(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id, url, text, n_chars of each page."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(h, *rules_of(pickle.loads(w))) for h, w in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True)]
            found = [x for x in found if x[1] or x[2]]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.list_(pa.string())), pa.array([x[2] for x in found], pa.string())], ["host", "fixed", "container"])

    rules = wrappers(pages, url_col, html_col).mapInArrow(judge, "host string, fixed array<string>, container string")
    # a host's branches together: their paths start with their marks, and one of them at most has a container
    rules = durable(rules.groupBy("host").agg(F.flatten(F.collect_list("fixed")).alias("fixed"), F.max("container").alias("container")))
    size = rules.agg(F.sum(F.length("host") + F.length("container") + F.length(F.array_join("fixed", ",")))).first()[0] or 0
    rows = texts(pages, F.col(id_col), F.col(url_col), F.col(html_col), host_of(F.col(url_col)).alias("host"))
    rows = rows.join(F.broadcast(rules) if size <= RULE_BYTES else rules, "host", "left").select(id_col, url_col, html_col, "fixed", "container")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [main_text(page, (fixed or (), container or "")) for page, fixed, container in zip(*(b.column(k).to_pylist() for k in (2, 3, 4)), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())], [id_col, url_col, "text", "n_chars"])

    kind = pages.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(extract, f"`{id_col}` {kind}, `{url_col}` string, text string, n_chars long")
