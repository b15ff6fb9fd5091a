"""Main text of web pages by a recurrent block labeller.

A page is a sequence of text blocks. Each enters a bidirectional LSTM as the mean vectors of its hashed tag path and of its hashed
words, with its length, link share and punctuation, so that every block is judged in the context of the whole page. The network is
trained in numpy on pages of the table itself: blocks whose path names their role (article, nav, ...) are the labels, and paths are
hidden at random, so that the rest is judged by words and neighbours.

Results: null, empty and text-less pages give an empty text. Unclosed and crossed tags are taken as browsers do: closing tags close what is
open inside them, others are ignored; text up to the end counts. Repeated rows give repeated results. If no page names roles of both
kinds, every block without a role of its own is kept. Extra columns are ignored.
"""

from __future__ import annotations

import html
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from zoneflow.llm import common

#: Bounds of the training sample: pages, and code points of each.
SAMPLE_PAGES, SAMPLE_CHARS = 400, 50_000
PATH_BITS, WORD_BITS = 10, 13
PATH_DIM, WORD_DIM, PLAIN, HIDDEN = 8, 8, 4, 12
STEPS, BATCH, RATE, HIDE, SEED = 150, 16, 0.01, 0.3, 3
INPUT = PATH_DIM + WORD_DIM + PLAIN

INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q ruby rt rp s samp small span strike strong sub sup time tt u var wbr math semantics mrow mi mn mo ms mtext mspace mfrac msqrt mroot msub msup msubsup munder mover munderover mmultiscripts mprescripts mstyle mpadded mphantom merror menclose mtable mtr mtd".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no text of the page.
SILENT = frozenset("script style noscript template svg iframe object select textarea button canvas audio video annotation annotation-xml".split())
#: Of these, what has no end reaches to the end of the page; the opening of others counts for nothing then.
RAW = frozenset("script style textarea".split())
#: What names a role, as tags and as parts of class and id.
AWAY_TAGS = frozenset("head title nav header footer aside form menu dialog".split())
MAIN_TAGS = frozenset("article main".split())
AWAY_WORDS = re.compile(r"(?:^|[-_ ])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|side-?bar|menu|nav\w*|footer|header|cookies?|consent|notices?|comments?|related|share|social|subscribe|newsletter|popup|modal|bread-?crumbs?|widget|pager|pagination|legal)(?:$|[-_ ])")
MAIN_WORDS = re.compile(r"(?:^|[-_ ])(?:article|content|entry|post|story|main|body|text)(?:$|[-_ ])")
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([A-Za-z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)>?", re.S)
NAMES = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
#: Opening one of these closes an open one of the same kind.
SAME = frozenset("p li dt dd tr td th option".split())


class Block:
    __slots__ = ("parts", "linked", "path", "role")

    def __init__(self, path: tuple[str, ...], role: int | None):
        self.parts: list[str] = []
        self.linked, self.path, self.role = 0, path, role

    def text(self) -> str:
        return " ".join(html.unescape("".join(self.parts)).split())


def role_of(tag: str, names: str, outer: int | None) -> int | None:
    """1 for the main text, 0 for what is around it, None if nothing tells; nothing inside of 0 is main."""
    if outer == 0 or tag in AWAY_TAGS or AWAY_WORDS.search(names):
        return 0
    return 1 if tag in MAIN_TAGS or MAIN_WORDS.search(names) else outer


def page_blocks(page: str) -> list[tuple[str, float, tuple[str, ...], int | None]]:
    """Text, share of linked text, tag path and role of each block with text."""
    stack: list[tuple[str, tuple[str, ...], int | None]] = [("", (), None)]
    blocks, links, at = [Block((), None)], 0, 0
    unclosed: set[str] = set()

    def fresh() -> None:
        blocks.append(Block(stack[-1][1], stack[-1][2]))

    def say(text: str) -> None:
        blocks[-1].parts.append(text)
        blocks[-1].linked += len(text) if links else 0

    while at < len(page):
        m = TOKEN.search(page, at)
        if m is None or m.start() > at:
            say(page[at : m.start() if m else len(page)])
        if m is None:
            break
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if tag == "a":
                links = max(0, links - 1)
            depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == tag), 0)
            if depth:
                del stack[depth:]
            if tag not in INLINE:
                links = 0
                fresh()
            continue
        if tag in SILENT:
            if tag == "svg" and m[3].endswith("/") or tag in unclosed:
                continue
            # a second button closes the first
            again = "/?" if tag in ("button", "select") else "/"
            end = re.compile(rf"<{again}{re.escape(tag)}(?![\w-])[^>]*>?", re.I).search(page, at)
            if end is None and tag not in RAW:
                unclosed.add(tag)
            elif end is None or end[0][1] == "/":
                at = end.end() if end else len(page)
            continue
        if tag == "br":
            say(" ")
            continue
        if tag in VOID:
            if tag == "hr":
                fresh()
            continue
        if tag in INLINE:
            links += tag == "a"
            continue
        if tag in SAME and stack[-1][0] == tag:
            stack.pop()
        names = " ".join(x for n in NAMES.findall(m[3]) for x in n if x).lower()
        path = (*stack[-1][1][-7:], tag, *(f"{tag}.{n}" for n in names.split()[:4]))
        stack.append((tag, path, role_of(tag, names, stack[-1][2])))
        links = 0
        fresh()
    found = [(b.text(), min(1.0, b.linked / max(1, sum(map(len, b.parts)))), b.path, b.role) for b in blocks if b.parts]
    return [b for b in found if b[0]]


class Inputs:
    """Hashed paths and words and plain numbers of all blocks of some pages."""

    def __init__(self, pages: list[list[tuple[str, float, tuple[str, ...], int | None]]]):
        blocks = [b for page in pages for b in page]
        self.sizes = np.array([len(page) for page in pages], np.int64)
        paths = [[zlib.crc32(x.encode()) >> (32 - PATH_BITS) for x in b[2]] or [0] for b in blocks]
        self.path_ends = np.cumsum([0, *map(len, paths)])
        self.paths = np.array([x for p in paths for x in p], np.int64)
        data, offsets = common.utf8(pa.array([b[0] for b in blocks], pa.string()))
        low = common.folded(data)
        hashes, ends = common.words(low, (low >= 128) | ((low >= 97) & (low <= 122)) | ((low >= 48) & (low <= 57)), offsets)
        counts = np.diff(ends)
        # a block without words has the one word 0
        self.word_ends = np.concatenate([[0], np.cumsum(np.maximum(counts, 1))])
        self.words = np.zeros(self.word_ends[-1], np.int64)
        slot = np.repeat(self.word_ends[:-1] - ends[:-1], counts) + np.arange(len(hashes))
        self.words[slot] = (hashes >> np.uint64(64 - WORD_BITS)).astype(np.int64)
        stops = common.per_row((data == 46) | (data == 44) | (data == 63) | (data == 33), offsets)
        size = np.diff(offsets)
        self.plain = np.stack([np.log1p(size) / 5, np.array([b[1] for b in blocks]), stops / np.maximum(counts, 1), np.ones(len(blocks))], axis=1).astype(np.float32).reshape(-1, PLAIN)
        self.roles = np.array([-1 if b[3] is None else b[3] for b in blocks], np.int64)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x.clip(-60, 60)))


class Labeller:
    """Parameters of the network by name."""

    def __init__(self) -> None:
        draw = np.random.default_rng(SEED)
        normal = lambda scale, *shape: (scale * draw.standard_normal(shape)).astype(np.float32)
        self.p = {
            "path": normal(0.3, 1 << PATH_BITS, PATH_DIM), "word": normal(0.3, 1 << WORD_BITS, WORD_DIM), "input": normal(0.3, INPUT, 8 * HIDDEN),
            "hidden": normal(0.3, 2, HIDDEN, 4 * HIDDEN), "out": normal(0.3, 2 * HIDDEN), "direct": normal(0.1, INPUT), "level": np.zeros(1, np.float32),
        }

    def vectors(self, x: Inputs, hidden_paths: np.ndarray | None = None) -> np.ndarray:
        mean = lambda table, items, ends: np.add.reduceat(table[items], ends[:-1], axis=0) / np.diff(ends)[:, None].astype(np.float32)
        paths = mean(self.p["path"], x.paths, x.path_ends)
        if hidden_paths is not None:
            paths = paths * ~hidden_paths[:, None]
        return np.concatenate([paths, mean(self.p["word"], x.words, x.word_ends), x.plain], axis=1)

    def forward(self, vectors: np.ndarray, sizes: np.ndarray, keep: list | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Logit of each block, and its states in both directions."""
        starts, order = np.cumsum(sizes) - sizes, np.argsort(-sizes, kind="stable")
        starts, sizes = starts[order], sizes[order]
        gates = (vectors @ self.p["input"]).reshape(-1, 2, 4 * HIDDEN)
        states = np.zeros((len(vectors), 2, HIDDEN), np.float32)
        h = c = np.zeros((2, len(sizes), HIDDEN), np.float32)
        for t in range(int(sizes[0]) if len(sizes) else 0):
            a = int(np.searchsorted(-sizes, -t, side="left"))
            at = np.stack([starts[:a] + t, starts[:a] + sizes[:a] - 1 - t])
            h, c = h[:, :a], c[:, :a]
            u = np.stack([gates[at[0], 0], gates[at[1], 1]]) + h @ self.p["hidden"]
            i, f, o = (sigmoid(u[..., k * HIDDEN : (k + 1) * HIDDEN] + (k == 1)) for k in range(3))
            g = np.tanh(u[..., 3 * HIDDEN :])
            new = f * c + i * g
            squashed = np.tanh(new)
            if keep is not None:
                keep.append((at, h, c, i, f, o, g, squashed))
            h, c = o * squashed, new
            states[at[0], 0], states[at[1], 1] = h[0], h[1]
        flat = states.reshape(-1, 2 * HIDDEN)
        return flat @ self.p["out"] + vectors @ self.p["direct"] + self.p["level"], flat

    def gradients(self, x: Inputs, hide: np.ndarray) -> dict[str, np.ndarray]:
        keep: list = []
        vectors = self.vectors(x, hide)
        logits, flat = self.forward(vectors, x.sizes, keep)
        told = x.roles >= 0
        error = (np.where(told, sigmoid(logits) - x.roles, 0) / max(1, told.sum())).astype(np.float32)
        grad = {"out": flat.T @ error, "direct": vectors.T @ error, "level": np.array([error.sum()], np.float32), "hidden": np.zeros_like(self.p["hidden"])}
        to_states = (error[:, None] * self.p["out"]).reshape(-1, 2, HIDDEN)
        to_gates = np.zeros((len(vectors), 2, 4 * HIDDEN), np.float32)
        carried_h = carried_c = np.zeros((2, 0, HIDDEN), np.float32)
        for at, h, c, i, f, o, g, squashed in reversed(keep):
            pad = np.zeros((2, at.shape[1] - carried_h.shape[1], HIDDEN), np.float32)
            dh = np.concatenate([carried_h, pad], axis=1) + np.stack([to_states[at[0], 0], to_states[at[1], 1]])
            dc = np.concatenate([carried_c, pad], axis=1) + dh * o * (1 - squashed**2)
            du = np.concatenate([dc * g * i * (1 - i), dc * c * f * (1 - f), dh * squashed * o * (1 - o), dc * i * (1 - g**2)], axis=2)
            to_gates[at[0], 0], to_gates[at[1], 1] = du[0], du[1]
            grad["hidden"] += h.transpose(0, 2, 1) @ du
            carried_h, carried_c = du @ self.p["hidden"].transpose(0, 2, 1), dc * f
        to_gates = to_gates.reshape(len(vectors), -1)
        grad["input"] = vectors.T @ to_gates
        to_vectors = to_gates @ self.p["input"].T + error[:, None] * self.p["direct"]
        for name, items, ends, part in (("path", x.paths, x.path_ends, to_vectors[:, :PATH_DIM] * ~hide[:, None]), ("word", x.words, x.word_ends, to_vectors[:, PATH_DIM : PATH_DIM + WORD_DIM])):
            grad[name] = np.zeros_like(self.p[name])
            np.add.at(grad[name], items, np.repeat(part / np.diff(ends)[:, None], np.diff(ends), axis=0))
        return grad

    def train(self, pages: list) -> None:
        draw = np.random.default_rng(SEED)
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        for step in range(1, STEPS + 1):
            x = Inputs([pages[i] for i in draw.integers(0, len(pages), BATCH)])
            fade = np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
            for k, g in self.gradients(x, draw.random(len(x.roles)) < HIDE).items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                self.p[k] = self.p[k] - (RATE * fade * first[k] / (np.sqrt(second[k]) + 1e-8)).astype(np.float32)

    def main(self, pages: list) -> np.ndarray:
        """Whether each block belongs to the main text."""
        x = Inputs(pages)
        return self.forward(self.vectors(x), x.sizes)[0] > 0 if len(x.roles) else np.zeros(0, bool)


def fit(pages: DataFrame, sample: int = SAMPLE_PAGES, chars: int = SAMPLE_CHARS) -> Labeller | None:
    """Learns from the first `chars` code points of the `sample` pages that come first in a hash order."""
    picked = pages.select(F.xxhash64("page_id", "url").alias("h"), "page_id", "url").orderBy("h", "page_id", "url").limit(sample).distinct()
    keyed = pages.select(F.xxhash64("page_id", "url").alias("h"), F.left("html", F.lit(chars)).alias("head"))
    rows = keyed.join(F.broadcast(picked.select("h").distinct()), "h").groupBy("h").agg(F.min("head").alias("head")).collect()
    found = [b for b in (page_blocks(r.head or "") for r in sorted(rows, key=lambda r: r.h)) if b]
    if len({b[3] for page in found for b in page} & {0, 1}) < 2:
        return None
    labeller = Labeller()
    labeller.train(found)
    return labeller


def extract(pages: DataFrame, labeller: Labeller | None) -> DataFrame:
    """page_id, url, text and n_chars of every row."""
    shared = pages.sparkSession.sparkContext.broadcast(vars(labeller) if labeller else None)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = common.restored(Labeller, shared.value) if shared.value else None
        for batch in common.blocks(batches, "html"):
            found = [page_blocks(page or "") for page in batch["html"].to_pylist()]
            kept = model.main(found) if model else np.array([b[3] != 0 for page in found for b in page], bool)
            texts, at = [], 0
            for page in found:
                texts.append("\n\n".join(b[0] for b, k in zip(page, kept[at : at + len(page)], strict=True) if k))
                at += len(page)
            sizes = pa.array([len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch["page_id"], batch["url"], pa.array(texts, pa.string()), sizes], ["page_id", "url", "text", "n_chars"])

    return pages.select("page_id", "url", "html").mapInArrow(read, "page_id bigint, url string, text string, n_chars bigint")


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = common.table(spark, sf_dir, "pages")
    return extract(pages, fit(pages))
