"""Main text of web pages by a recurrent block labeller.

A page becomes its sequence of leaf blocks: runs of text between the borders
of block elements, each with its path of tags, classes and ids. A
bidirectional LSTM in numpy reads a hashed vector of path and words for every
block and labels it with the whole page as context. It is trained here, on a
bounded sample of the pages, whose containers give the labels, on copies into
which boxes of other kinds have been put, and on copies whose containers have
lost their telling names, so that links, words, lengths and order have to do.
"""

from __future__ import annotations

import html
import pickle
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerweave.llm.base import slices

#: Elements by kind.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea select".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark math object q s samp small span strike strong sub sup svg time tt u var wbr img".split())
MAIN = frozenset("article main".split())
OTHER = frozenset(
    "nav menu header footer aside form button ad ads advert advertisement banner promo sponsor sponsored cookie cookies consent notice alert popup modal newsletter subscribe signup login sidebar widget related recommended share social breadcrumb breadcrumbs pagination comments comment replies respond disqus copyright legal skip toolbar navbar topbar".split()
)
#: Parts of a class name that say that its other parts name something of the article itself.
CONTENT = frozenset("article post entry content story main text body free".split())
NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
UNQUOTED = re.compile(r"""[^>"']*""")
ATTRIBUTE = re.compile(r"""\b(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
PATHS, WORDS, EXTRA = 64, 32, 5
WIDTH = PATHS + WORDS + EXTRA
HIDDEN = 20

#: Names of a path that are kept beside the telling ones.
NEAREST = 32

Path = tuple[str, ...]


def tags(page: str) -> Iterator[tuple[int, int, str, str, str]]:
    """(start, end, "/" or nothing, name, attributes) of tags; comments, declarations and the like have no name.

    One scan forward. A quote that is never closed is no quote: its tag ends
    at its first >, and from there on every tag of the page does so. A < that
    no > follows, or that begins no tag, is text.
    """
    at, last, quotes, unclosed = 0, page.rfind(">"), True, set()
    while 0 <= (i := page.find("<", at)) < last:
        if page.startswith("<!--", i):
            j = page.find("-->", i + 4)
            at = j + 3 if j >= 0 else len(page)
            yield i, at, "", "", ""
        elif m := NAME.match(page, i):
            first = page.find(">", m.end())
            end = m.end() if quotes else first
            while quotes:
                end = UNQUOTED.match(page, end).end()
                if end >= len(page):
                    end, quotes = first, False
                elif page[end] == ">":
                    break
                else:
                    end = page.find(page[end], end + 1) + 1
                    if not end:
                        end, quotes = first, False
            at, tag, attributes = end + 1, m[2].lower(), page[m.end() : end]
            if tag in RAW and not m[1] and tag not in unclosed and not attributes.endswith("/"):
                # The content is no text; a field or title that has no end has no content.
                stop = re.compile(rf"</{tag}[^>]*>", re.I).search(page, at)
                if stop:
                    at = stop.end()
                elif tag in ("script", "style"):
                    at = len(page)
                else:
                    unclosed.add(tag)
            yield i, at, m[1], tag, attributes
        elif page[i + 1 : i + 2] in ("!", "?", "/"):
            at = page.find(">", i) + 1
            yield i, at, "", "", ""
        else:
            at = i + 1


def named(attributes: str) -> list[str]:
    """The words of a tag's class, id and role; in names of parts of the article, without those of other boxes."""
    out: list[str] = []
    for value in ATTRIBUTE.findall(attributes):
        for token in value.strip("\"'").lower().split():
            parts = re.findall(r"[a-z]+", token)
            out += [x for x in parts if x not in OTHER] if CONTENT.intersection(parts) else parts
    return out


def longer(path: Path, tag: str, names: list[str]) -> Path:
    """The path with what is new; of names that tell nothing, the nearest ones stay."""
    new = [x for x in dict.fromkeys(("<" + tag, *names)) if x not in path]
    if not new:
        return path
    both = (*path, *new)
    plain = [x for x in both if x.lstrip("<") not in MAIN and x.lstrip("<") not in OTHER]
    gone = set(plain[:-NEAREST]) if len(plain) > NEAREST else ()
    return tuple(x for x in both if x not in gone) if gone else both


def blocks_of(page: str) -> list[tuple[Path, str, int]]:
    """(path, text, characters inside links) of the leaf blocks that have text; references decoded, white space single.

    A path has the names around a block, each once, outermost first, then its
    own tag; so it does not grow with containers that bring no new name. The
    time is in proportion to the page, whatever its markup.
    """
    out: list[tuple[Path, str, int]] = []
    stack: list[tuple[str, Path, str]] = []  # tag, path and leaf of what is open
    opened: Counter[str] = Counter()
    blocks: list[int] = []  # places of block elements in the stack
    inline: list[Counter[str]] = [Counter()]  # inline elements open above each of them
    parts: list[str] = []
    linked = at = 0

    def flush() -> None:
        nonlocal linked
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            _, path, leaf = stack[-1] if stack else ("", (), "")
            out.append(((*path, leaf) if leaf and path[-1:] != (leaf,) else path, text, linked))
        parts.clear()
        linked = 0

    def write(text: str) -> None:
        nonlocal linked
        if text:
            parts.append(text)
            linked += len(text) if opened["a"] > 0 else 0

    def push(tag: str, attributes: str) -> None:
        _, path, leaf = stack[-1] if stack else ("", (), "")
        if tag in INLINE:
            inline[-1][tag] += 1
        else:
            path, leaf = longer(path, tag, named(attributes) if attributes else []), "<" + tag
            blocks.append(len(stack))
            inline.append(Counter())
        stack.append((tag, path, leaf))
        opened[tag] += 1

    def pop(to: int) -> None:
        while len(stack) > to:
            tag, _, _ = stack.pop()
            opened[tag] -= 1
            if tag in INLINE:
                inline[-1][tag] -= 1
            else:
                blocks.pop()
                inline.pop()

    for start, end, closing, tag, attributes in tags(page):
        write(page[at:start])
        at = end
        if not tag or tag in RAW:
            continue
        if tag not in INLINE:
            flush()
        if tag in VOID:
            continue
        if closing:
            if inline[-1][tag] > 0 if tag in INLINE else opened[tag] > 0:
                while stack[-1][0] != tag:
                    pop(len(stack) - 1)
                pop(len(stack) - 1)
            continue
        if tag not in INLINE and blocks:  # a block ends an open paragraph, and an item the item before it
            around = stack[blocks[-1]][0]
            if around == "p" or around == tag and tag in ("li", "dt", "dd", "option", "tr", "td", "th"):
                pop(blocks[-1])
        push(tag, attributes)
    write(page[at:])
    flush()
    return out


def weak_labels(blocks: list[tuple[Path, str, int]]) -> np.ndarray:
    """1 for blocks inside a main container (if the page has one) and in no container of another kind."""
    names = [{x.lstrip("<") for x in p} for p, _, _ in blocks]
    some = any(n & MAIN for n in names)
    return np.array([(not some or bool(n & MAIN)) and not n & OTHER for n in names], np.float32)


class Features:
    """Hashed vectors of blocks; keeps those of the paths and words it has seen."""

    def __init__(self) -> None:
        self.paths: dict[Path, np.ndarray] = {}
        self.words: dict[str, int] = {}

    def path(self, p: Path) -> np.ndarray:
        if p not in self.paths:
            if len(self.paths) > 20000:
                self.paths.clear()
            v = np.zeros(PATHS, np.float32)
            for i, x in enumerate(p):
                for name in (x, x + ">" + p[i + 1] if i + 1 < len(p) else "$" + x):
                    h = zlib.crc32(name.encode("utf-8", "surrogatepass"))
                    v[h % PATHS] += 1 if h >> 16 & 1 else -1
            self.paths[p] = np.clip(v, -3, 3)
        return self.paths[p]

    def matrix(self, blocks: list[tuple[Path, str, int]]) -> np.ndarray:
        x = np.zeros((len(blocks), WIDTH), np.float32)
        known = self.words
        for i, (p, text, linked) in enumerate(blocks):
            words = text.split(" ")
            if len(known) > 300_000:
                known.clear()
            for w in words:
                if w not in known:
                    known[w] = zlib.crc32(w.lower().encode("utf-8", "surrogatepass")) % WORDS
            x[i, :PATHS] = self.path(p)
            x[i, PATHS : PATHS + WORDS] = np.bincount([known[w] for w in words], minlength=WORDS) / np.sqrt(len(words))
            x[i, PATHS + WORDS :] = np.log1p(len(words)) / 4, min(1, linked / len(text)), i / len(blocks), min(1, 5 * (text.count(".") + text.count(",")) / len(words)), 1
        return x


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """A bidirectional LSTM with one output per block; sequences of a batch are padded at the end."""

    def __init__(self, seed: int = 0):
        rng = np.random.default_rng(seed)
        init = lambda *s: rng.normal(0, 1 / np.sqrt(s[0]), s).astype(np.float32)
        self.w = [init(WIDTH, 4 * HIDDEN), init(WIDTH, 4 * HIDDEN), init(HIDDEN, 4 * HIDDEN), init(HIDDEN, 4 * HIDDEN), init(2 * HIDDEN, 1), init(WIDTH, 1), np.zeros(1, np.float32)]

    def run(self, x: np.ndarray, mask: np.ndarray, w: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, list]:
        """Hidden states for x (steps, batch, width), first step first; padding leaves the state as it is."""
        steps, batch = mask.shape
        z_all = (x.reshape(-1, WIDTH) @ w).reshape(steps, batch, -1)
        h, c = np.zeros((batch, HIDDEN), np.float32), np.zeros((batch, HIDDEN), np.float32)
        out, trace = np.zeros((steps, batch, HIDDEN), np.float32), []
        for t in range(steps):
            z = z_all[t] + h @ u
            gates = sigmoid(z[:, : 3 * HIDDEN])
            g = np.tanh(z[:, 3 * HIDDEN :])
            i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
            new = f * c + i * g
            tanh = np.tanh(new)
            m = mask[t][:, None]
            trace.append((h, c, i, f, o, g, tanh, m))
            c = m * new + (1 - m) * c
            h = m * (o * tanh) + (1 - m) * h
            out[t] = h
        return out, trace

    @staticmethod
    def back(grad: np.ndarray, trace: list, x: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        dz_all, du = np.zeros((*grad.shape[:2], 4 * HIDDEN), np.float32), np.zeros_like(u)
        dh = dc = np.zeros(grad.shape[1:], np.float32)
        for t in range(len(trace) - 1, -1, -1):
            h, c, i, f, o, g, tanh, m = trace[t]
            dh = dh + grad[t]
            live = dh * m
            dn = dc * m + live * o * (1 - tanh**2)
            dz = np.concatenate([dn * g * i * (1 - i), dn * c * f * (1 - f), live * tanh * o * (1 - o), dn * i * (1 - g**2)], 1)
            dz_all[t] = dz
            du += h.T @ dz
            dh, dc = dz @ u.T + dh * (1 - m), dn * f + dc * (1 - m)
        return x.reshape(-1, WIDTH).T @ dz_all.reshape(-1, 4 * HIDDEN), du

    def scores(self, x: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, tuple]:
        w1, w2, u1, u2, v, skip, b = self.w
        ahead, t1 = self.run(x, mask, w1, u1)
        behind, t2 = self.run(x[::-1], mask[::-1], w2, u2)
        both = np.concatenate([ahead, behind[::-1]], 2)
        return (both @ v + x @ skip + b)[..., 0], (both, t1, t2)

    def train(self, pages: list[tuple[np.ndarray, np.ndarray]], epochs: int = 12, batch: int = 32, rate: float = 0.02) -> None:
        rng = np.random.default_rng(1)
        first, second, n = [np.zeros_like(w) for w in self.w], [np.zeros_like(w) for w in self.w], 0
        for epoch in range(epochs):
            for part in np.array_split(rng.permutation(len(pages)), -(-len(pages) // batch)):
                x, mask = pad([pages[i][0] for i in part])
                y = np.zeros(mask.shape, np.float32)
                for j, i in enumerate(part):
                    y[: len(pages[i][1]), j] = pages[i][1]
                s, (both, t1, t2) = self.scores(x, mask)
                d = ((sigmoid(s) - y) * mask / mask.sum())[..., None].astype(np.float32)
                dv, db, ds = both.reshape(-1, 2 * HIDDEN).T @ d.reshape(-1, 1), d.sum((0, 1)), x.reshape(-1, WIDTH).T @ d.reshape(-1, 1)
                dh = d @ self.w[4].T
                dw1, du1 = self.back(dh[..., :HIDDEN], t1, x, self.w[2])
                dw2, du2 = self.back(dh[::-1, :, HIDDEN:], t2, x[::-1], self.w[3])
                n += 1
                for k, g in enumerate((dw1, dw2, du1, du2, dv, ds, db)):
                    g = g + 1e-4 * self.w[k]
                    first[k] = 0.9 * first[k] + 0.1 * g
                    second[k] = 0.99 * second[k] + 0.01 * g * g
                    self.w[k] = (self.w[k] - rate * 0.8**epoch * (first[k] / (1 - 0.9**n)) / (np.sqrt(second[k] / (1 - 0.99**n)) + 1e-8)).astype(np.float32)

    def labels(self, pages: list[np.ndarray]) -> list[np.ndarray]:
        """Which blocks of each page belong to its main text."""
        out: list[np.ndarray] = [np.zeros(0, bool)] * len(pages)
        order = [i for i in np.argsort([len(p) for p in pages], kind="stable") if len(pages[i])]
        for a, b in slices([len(pages[i]) for i in order], 1 << 12):
            x, mask = pad([pages[i] for i in order[a:b]])
            s, _ = self.scores(x, mask)
            for j, i in enumerate(order[a:b]):
                out[i] = s[: len(pages[i]), j] > 0
        return out


def pad(pages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    steps = max(len(p) for p in pages)
    x, mask = np.zeros((steps, len(pages), WIDTH), np.float32), np.zeros((steps, len(pages)), np.float32)
    for j, p in enumerate(pages):
        x[: len(p), j], mask[: len(p), j] = p, 1
    return x, mask


def with_boxes(blocks: list[tuple[Path, str, int]], rng: np.random.Generator, most: int = 40) -> list[tuple[Path, str, int]]:
    """A copy with boxes of other kinds put between and around the blocks, filled with up to so many of the page's own words; some are lists of links."""
    words = " ".join(t for _, t, _ in blocks).split(" ")
    kinds = sorted(OTHER)
    some = lambda n: " ".join(rng.choice(words, n))
    out = list(blocks)
    for _ in range(int(rng.integers(1, 5))):
        at = int(rng.integers(0, len(out) + 1))
        around = out[min(at, len(out) - 1)][0]
        inside = [x for x in around[: int(rng.integers(0, len(around) + 1))] if x.lstrip("<") not in OTHER]
        kind = kinds[int(rng.integers(len(kinds)))]
        tag = "<" + kind if kind in ("nav", "menu", "header", "footer", "aside", "form", "button") else ["<div", "<section", "<ul"][int(rng.integers(3))]
        box = (*inside, tag, *([] if tag[1:] == kind else [kind]))
        leaf = ["<p", "<li", "<div"][int(rng.integers(3))]
        links = rng.random() < 0.5
        texts = [some(int(rng.integers(1, 6 if links else most))) for _ in range(int(rng.integers(2, 8) if links else rng.integers(1, 4)))]
        out[at:at] = [((*box, leaf), t, len(t) if links else 0) for t in texts]
    if rng.random() < 0.3:  # other names for the main container
        to = ["<main", "<div"][int(rng.integers(2))]
        out = [(tuple(to if x == "<article" else x for x in p), t, n) for p, t, n in out] if to == "<main" else out
    return out


def renamed(blocks: list[tuple[Path, str, int]], rng: np.random.Generator) -> list[tuple[Path, str, int]]:
    """A copy in which most telling names of tags and classes are gone or others, and names that tell nothing are there, the same way all over the page."""
    new: dict[str, str] = {}
    more: dict[str, tuple[str, ...]] = {}
    for x in sorted({x for p, _, _ in blocks for x in p}):
        name = x.lstrip("<")
        if rng.random() < 0.5:
            more[x] = tuple("c" + str(rng.integers(1 << 30)) for _ in range(int(rng.integers(1, 3))))
        if (name in OTHER or name in MAIN or not x.startswith("<")) and rng.random() < 0.7:
            new[x] = ["<div", "<section"][int(rng.integers(2))] if x.startswith("<") else "c" + str(rng.integers(1 << 30))
    leaves = ["<p", "<p", "<div", "<blockquote", "<section", "<td", "<li", "<pre"]
    out = []
    for p, t, n in blocks:
        leaf = leaves[int(rng.integers(len(leaves)))] if p and p[-1] in leaves and rng.random() < 0.2 else None
        q = tuple(y for x in p for y in (new.get(x, x), *(more.get(x, ()) if x != p[-1] else ())))
        out.append(((*q[:-1], leaf) if leaf else q, t, n))
    return out


def wrapped(blocks: list[tuple[Path, str, int]], main: np.ndarray, rng: np.random.Generator) -> list[tuple[Path, str, int]]:
    """A copy in which runs of the main text's blocks stand in containers of their own, and headings and paragraphs are of other kinds."""
    out, around = [], None
    heading = "<h" + str(int(rng.integers(1, 5)))
    for (p, t, n), y in zip(blocks, main, strict=True):
        if rng.random() < 0.3:
            around = None if rng.random() < 0.5 else (["<div", "<section", "<article", "<table", "<ul"][int(rng.integers(5))], *(["c" + str(rng.integers(1 << 30))] if rng.random() < 0.5 else []))
        if p and y:
            leaf = heading if p[-1] in ("<h1", "<h2", "<h3") else p[-1]
            p = (*p[:-1], *[x for x in around or () if x not in p], leaf)
        out.append((p, t, n))
    return out


def fit(pages: list[str], seed: int = 0) -> Labeller:
    """A labeller from the pages and from copies of them.

    Half of the copies show the path of a block in part or not at all, alike
    for all blocks of a container; there, links, lengths, marks and the blocks
    around have to tell what it is.
    """
    rng = np.random.default_rng(7)
    features, data = Features(), []
    for page in pages:
        blocks = blocks_of(page)
        if not blocks:
            continue
        boxed = [with_boxes(blocks, rng) for _ in range(2)]
        data += [(features.matrix(b), weak_labels(b)) for b in (blocks, *boxed)]
        for version in (blocks, *[with_boxes(blocks, rng, 12) for _ in range(4)]):  # without names, long boxes can't be told from the main text
            labels = weak_labels(version)
            x = features.matrix(renamed(wrapped(version, labels, rng), rng))
            if rng.random() < 0.5:
                x[:, :PATHS] *= rng.random(PATHS) < rng.choice([0.0, 0.3, 0.7])
            if rng.random() < 0.5:
                x[:, PATHS : PATHS + WORDS] *= rng.random(WORDS) < rng.choice([0.0, 0.5])
            data.append((x, labels))
    model = Labeller(seed)
    if data:
        model.train(data)
    return model


def train(pages: DataFrame, sample: int = 120, longest: int = 1 << 16, id_col: str = "page_id", html_col: str = "html") -> Labeller:
    """A labeller from at most sample pages of at most longest bytes, in the order of a hash of the id.

    Ids and hashes are put in order; then the chosen pages go to one task,
    which fits the model. The driver gets its weights only.
    """
    small = pages.filter(F.octet_length(html_col) <= longest).select(F.col(id_col).cast("string").alias("id"), F.xxhash64(html_col).alias("h"), F.col(html_col).alias("html"))
    chosen = small.select("id", "h").orderBy(F.xxhash64("id"), "id", "h").limit(sample).distinct()
    chosen = F.broadcast(chosen.withColumnsRenamed({"id": "__id", "h": "__h"}))  # bounded by the parameter
    rows = small.join(chosen, F.col("id").eqNullSafe(F.col("__id")) & (F.col("h") == F.col("__h"))).select("id", "h", "html").dropDuplicates(["id", "h"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [(r["id"] or "", r["h"], r["html"]) for b in batches for r in b.to_pylist()]
        yield pa.RecordBatch.from_pydict({"weights": [pickle.dumps([w.tolist() for w in fit([x for _, _, x in sorted(found)]).w])]})

    model = Labeller()
    learnt = rows.repartition(1).mapInArrow(learn, "weights binary").first()
    if learnt:
        model.w = [np.array(w, np.float32) for w in pickle.loads(learnt["weights"])]
    return model


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", **bounds: int) -> DataFrame:
    """A row per page: id, url, text, n_chars (code points of text).

    text joins the blocks of the main text by newlines; it is empty where
    there is none, as for null, empty and blank pages. Whole pages are read,
    broken markup too. Null ids and urls stay null, repeated rows each get a
    row, an empty table gives no rows; other columns are not read.
    """
    model = train(pages, id_col=id_col, html_col=html_col, **bounds)
    kinds = [pages.schema[c].dataType.simpleString() for c in (id_col, url_col)]

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for batch in batches:
            for a, b in slices(pc.binary_length(batch.column(2)).to_numpy(), 2 << 20):
                part = batch.slice(a, b - a)
                blocks = [blocks_of(p) for p in part.column(2).to_pylist()]
                labels = model.labels([features.matrix(x) for x in blocks])
                texts = ["\n".join(t for (_, t, _), y in zip(x, ys, strict=True) if y) for x, ys in zip(blocks, labels, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[id_col, url_col, "text", "n_chars"])

    rows = pages.select(id_col, url_col, F.coalesce(F.col(html_col), F.lit("")).alias("__html"))
    return rows.mapInArrow(extract, f"`{id_col}` {kinds[0]}, `{url_col}` {kinds[1]}, text string, n_chars long")
