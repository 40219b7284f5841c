"""Main text of web pages: a linear-chain conditional random field over DOM leaf blocks, decoded by Viterbi.

A leaf block is the text between two block-level tags. Its features are its ancestors' tags and the words of their classes,
ids and roles, its length, links, punctuation, place in the page, and the words of short blocks. The field is trained
on the driver on TRAINING generated pages whose blocks are labelled (html_pages), a fixed number.

Defined results: null and empty html give an empty text; scripts, styles, templates, titles, frames, drawings (svg), what stands for missing scripts, form fields and comments are never text;
formulas (math) and what stands for missing objects are text like any other; a raw tag that closes itself holds nothing; quotes open an attribute's value only right after its equals sign; markup that
is cut off or not closed is read as far as it goes; white space (any, no-break space too) in a block becomes one space; a
`br` is white space; equal pages and repeated rows get equal texts; keys and urls may be null or repeat; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import html
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import prepare
from tessera.llm.html_pages import Pages

TRAINING, EPOCHS, BATCH, STEP = 1500, 6, 25, 0.3
#: A word counts as a cue if so many short blocks outside the article hold it.
CUE_BLOCKS = 8
SLOTS = 1 << 16
#: Tags that part blocks, hold raw text or nothing, and are never closed.
BLOCKS = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
RAW = frozenset("script style template title noscript iframe svg textarea".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An open tag of the first kind ends where one of the second begins, unless one of BARS is open in between.
CLOSES = {"p": BLOCKS, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option", "optgroup"}}
ENDED_BY = {tag: [i for i, k in enumerate(CLOSES) if tag in CLOSES[k]] for tag in BLOCKS}
KIND = {k: i for i, k in enumerate(CLOSES)}
BARS = frozenset("div article section table ul ol body".split())
VALUE = r"""=\s*(?:"[^"]*"|'[^']*'|[^\s"'>][^\s>]*)?"""
TOKEN = re.compile(rf"""(?s)<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]|{VALUE})*+)(?:>|\Z)""")
NAME = re.compile(r"""(?i)(?<![^\s"'/])(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""")
SELF = re.compile(r"""(?:^|[\s"'])/\s*\Z""")
END = {t: re.compile(f"(?i)</{t}(?![^\\s/>])[^>]*(?:>|\\Z)") for t in RAW}
PART = re.compile(r"[a-z]+")


def _slot(feature: str) -> int:
    return zlib.crc32(feature.encode()) & (SLOTS - 1)


class Node:
    """An open tag below its parents: the words of its names, the features of all, and the nearest block-level tag."""

    __slots__ = ("parent", "tag", "names", "near", "features", "slots", "below")

    def __init__(self, parent: Node | None, tag: str, names: tuple[str, ...]):
        self.parent, self.tag, self.names, self.below, self.slots = parent, tag, names, {}, None
        before = parent.features if parent else frozenset()
        own = {f"t:{tag}", *(f"n:{w}" for w in names)} if parent else set()
        self.features = before if own <= before else before | own  # deep pages share one set
        self.near = tag if tag in BLOCKS or not parent else parent.near

    def open(self, tag: str, names: tuple[str, ...]) -> Node:
        found = self.below.get((tag, names))
        if found is None:
            found = self.below[tag, names] = Node(self, tag, names)
        return found


class Block:
    __slots__ = ("node", "text", "linked")

    def __init__(self, node: Node, text: str, linked: int):
        self.node, self.text, self.linked = node, text, linked

    @property
    def path(self) -> list[tuple[str, tuple[str, ...]]]:
        """The open tags with the words of their names, outermost first."""
        out, node = [], self.node
        while node.parent:
            out.append((node.tag, node.names))
            node = node.parent
        return out[::-1]


class Stack:
    """Open tags. Each step costs the same however deep they are."""

    def __init__(self) -> None:
        #: Of each open tag: its node, the last place below it of each kind of CLOSES that no bar hides, and of a block-level tag.
        self.open: list[tuple[Node, tuple[int, ...], int]] = [(Node(None, "", ()), (-1,) * len(CLOSES), 0)]
        self.places: dict[str, list[int]] = {}

    @property
    def node(self) -> Node:
        return self.open[-1][0]

    def push(self, tag: str, names: tuple[str, ...]) -> None:
        node, reach, block = self.open[-1]
        at = len(self.open)
        if tag in BARS:
            reach = (-1,) * len(CLOSES)
        elif tag in KIND:
            reach = tuple(at if i == KIND[tag] else x for i, x in enumerate(reach))
        self.open.append((node.open(tag, names), reach, at if tag in BLOCKS else block))
        self.places.setdefault(tag, []).append(at)

    def cut(self, at: int) -> None:
        """Closes the tag at a place and all above it."""
        while len(self.open) > at:
            self.places[self.open.pop()[0].tag].pop()

    def begin(self, tag: str) -> None:
        """Closes what ends where a block-level tag begins."""
        _, reach, _ = self.open[-1]
        at = max((reach[i] for i in ENDED_BY[tag]), default=-1)
        if at > 0:
            self.cut(at)

    def close(self, tag: str) -> None:
        """Closes the last such tag, but no block-level one for the sake of an inline one."""
        places = self.places.get(tag)
        if places and (tag in BLOCKS or places[-1] > self.open[-1][2]):
            self.cut(places[-1])


@lru_cache(20_000)
def _names(attributes: str) -> tuple[str, ...]:
    return tuple(sorted({w for x in NAME.findall(attributes) for w in PART.findall("".join(x).lower())}))


def blocks(page: str) -> list[Block]:
    """Leaf blocks in page order."""
    out: list[Block] = []
    stack, parts, unclosed = Stack(), [], set()
    linked, inside, at, n = 0, 0, 0, len(page)

    def end() -> None:
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append(Block(stack.node, text, linked))
            parts.clear()
        linked = 0

    while at < n:
        m = TOKEN.search(page, at)
        text = page[at : m.start() if m else n]
        if text:
            parts.append(text)
            linked += len(text) if inside else 0
        if not m:
            break
        at = m.end()
        if not (tag := m[2]):
            continue
        tag = tag.lower()
        if m[1]:
            if tag in BLOCKS:
                end()
            stack.close(tag)
            if tag == "a":
                inside = max(0, inside - 1)
            continue
        itself = SELF.search(m[3]) is not None
        if tag in RAW:
            close = None if itself or tag in unclosed else END[tag].search(page, at)
            if close:
                at = close.end()
            elif not itself:
                unclosed.add(tag)
                at = n if tag in ("script", "style", "title", "textarea") else at
            continue
        if tag == "br":
            parts.append(" ")
        if tag in BLOCKS:
            end()
            inside = 0
            stack.begin(tag)
        if tag in VOID or itself:
            continue
        stack.push(tag, _names(m[3]) if m[3] else ())
        inside += tag == "a"
    end()
    return out


def _size(n: int) -> int:
    return min(7, n.bit_length())


def _of_path(node: Node) -> tuple[list[int], str]:
    """Features of the ancestors, and the nearest block-level tag."""
    if node.slots is None:
        last = [x for x in (node.parent, node) if x is not None]
        node.slots = [_slot(x) for x in sorted(node.features | {f"p:{node.near}"} | {f"pn:{w}" for x in last for w in x.names})]
    return node.slots, node.near


def features(found: list[Block], cues: frozenset[str]) -> list[list[int]]:
    """Slots of each block; cues: the words of short blocks that count."""
    out, n = [], len(found)
    for i, b in enumerate(found):
        slots, near = _of_path(b.node)
        words = b.text.split(" ")
        size, links = _size(len(words)), min(3, 4 * b.linked // max(1, len(b.text)))
        more = [
            "bias", f"s:{size}", f"l:{links}", f"sl:{size}:{links}", f"e:{b.text[-1] in '.!?…:'}", f"ps:{near}:{size}", f"pl:{near}:{links}",
            f"at:{4 * i // n}", f"first:{i}" if i < 3 else "later", f"last:{n - i}" if n - i < 3 else "sooner",
        ]
        if len(words) <= 12:
            more += [f"w:{w}" for w in cues.intersection(b.text.lower().split(" "))]
        out.append(slots + [_slot(x) for x in more])
    return out


class Field:
    """weights: slot x label (0: other, 1: article); moves: from x to; cues: words of short blocks."""

    def __init__(self, cues: frozenset[str] = frozenset()) -> None:
        self.cues = cues
        self.weights, self.moves, self.first = np.zeros((SLOTS, 2)), np.zeros((2, 2)), np.zeros(2)

    def emissions(self, rows: list[list[int]]) -> np.ndarray:
        return np.array([self.weights[r].sum(axis=0) for r in rows]).reshape(-1, 2)

    def viterbi(self, e: np.ndarray) -> np.ndarray:
        best, back = self.first + e[0], []
        for x in e[1:]:
            scores = best[:, None] + self.moves
            back.append(scores.argmax(axis=0))
            best = scores.max(axis=0) + x
        out = [int(best.argmax())]
        for b in reversed(back):
            out.append(int(b[out[-1]]))
        return np.array(out[::-1])

    def marginals(self, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of one page: label marginals, and summed ones of neighbours."""
        move, p = np.exp(self.moves), np.exp(e - e.max(axis=1, keepdims=True))
        alpha, beta = np.zeros_like(p), np.ones_like(p)
        alpha[0] = np.exp(self.first) * p[0]
        alpha[0] /= alpha[0].sum()
        for i in range(1, len(p)):
            alpha[i] = (alpha[i - 1] @ move) * p[i]
            alpha[i] /= alpha[i].sum()
        pair = np.zeros((2, 2))
        for i in range(len(p) - 2, -1, -1):
            right = p[i + 1] * beta[i + 1]
            both = alpha[i][:, None] * move * right
            pair += both / both.sum()
            beta[i] = move @ right
            beta[i] /= beta[i].sum()
        out = alpha * beta
        return out / out.sum(axis=1, keepdims=True), pair


def labelled(page: str, marks: list[str]) -> tuple[list[Block], np.ndarray]:
    """Blocks of a generated page and their labels, the marks taken out."""
    found, seen, labels = blocks(page), set(marks), []
    for b in found:
        head, _, rest = b.text.partition(" ")
        labels.append(int(head in seen))
        if head in seen:
            b.text = rest or "."
    return found, np.array(labels)


def fit(pages: int = TRAINING, seed: int = 11) -> Field:
    make = Pages(seed)
    made = [x for x in (labelled(*make.page()) for _ in range(pages)) if x[0]]
    count = Counter(w for found, y in made for b, k in zip(found, y, strict=True) if not k and b.text.count(" ") < 12 for w in set(b.text.lower().split(" ")))
    field = Field(frozenset(w for w, n in count.items() if n >= CUE_BLOCKS))
    data = [(features(found, field.cues), y) for found, y in made]
    rng, sums = np.random.default_rng(seed), [np.full(x.shape, 1e-2) for x in (field.weights, field.moves, field.first)]
    for _ in range(EPOCHS):
        order = rng.permutation(len(data))
        for lo in range(0, len(order), BATCH):
            cells, gaps, moves, first = [], [], np.zeros((2, 2)), np.zeros(2)
            for i in order[lo : lo + BATCH]:
                rows, y = data[i]
                p, pair = field.marginals(field.emissions(rows))
                gap = p.copy()
                gap[np.arange(len(y)), y] -= 1
                cells.append(np.concatenate(rows))
                gaps.append(np.repeat(gap, [len(r) for r in rows], axis=0))
                np.add.at(pair, (y[:-1], y[1:]), -1)
                moves += pair
                first += gap[0]
            cell, gap = np.concatenate(cells), np.concatenate(gaps)
            g = [np.stack([np.bincount(cell, gap[:, k], SLOTS) for k in (0, 1)], 1) / BATCH + 1e-5 * field.weights, moves / BATCH, first / BATCH]
            for x, s, d in zip((field.weights, field.moves, field.first), sums, g, strict=True):
                s += d * d
                x -= STEP * d / np.sqrt(s)
    field.weights = field.weights.astype(np.float32)
    return field


def extract(page: str, field: Field) -> str:
    found = blocks(page)
    if not found:
        return ""
    keep = field.viterbi(field.emissions(features(found, field.cues)))
    return "\n\n".join(b.text for b, k in zip(found, keep, strict=True) if k)


def _extract(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = sent.value
        for b in batches:
            texts = [extract(x, field) for x in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    return run


def main_text(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """(page_id, url, text) of every page."""
    spark = pages.sparkSession
    prepare(spark)
    sent = spark.sparkContext.broadcast(fit())
    rows = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(page), F.lit("")).alias("html"))
    return rows.mapInArrow(_extract(sent), "page_id long, url string, text string")


def digest(texts: DataFrame) -> DataFrame:
    return texts.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
