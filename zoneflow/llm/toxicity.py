"""Toxicity scores of a bidirectional gated recurrent network with attention pooling, trained in numpy.

Each word enters as its own vector (if the sample knew it) and as the mean vector of its four-byte pieces, so that inflected and
misspelt forms are met by their characters. Windows of WINDOW words overlap; a text scores as its worst window.

Learning reads the whole texts of a sample that is bounded by rows. Tasks count in how many texts of either label words and pieces
stand, and choose from all windows of each text those of the worst odds; only these windows reach the driver, where the network is
trained. A quarter of the sample is kept back: its whole texts are scored by tasks, and slope and level of the odds fitted to that.

Results: null, empty and wordless texts get the score of an empty window list, 0. Repeated rows give repeated results. Labels of
one id count as toxic if any of them is. Without labels of both kinds every score is 0. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from zoneflow.llm import common

#: Rows of each label that are learned from at most; windows of each of their texts that training may choose from.
SAMPLE_ROWS, CANDIDATES = 2000, 3
WINDOW, STRIDE = 64, 48
WORD_SLOTS, PIECE_BITS = 1 << 18, 17
WORD_DIM, PIECE_DIM, HIDDEN = 6, 4, 8
STEPS, BATCH, RATE, SEED = 300, 64, 0.01, 7
#: Texts added to each class when a word's odds are counted, least texts of a word with its own vector, share of words hidden in training.
PRIOR, LEAST_TEXTS, HIDE = 3, 4, 0.25
#: Tables of vectors start from counted odds and learn at a smaller rate.
TABLE_RATE = 0.002
BASE = np.uint64(0x9E3779B97F4A7C15)


class Words:
    """Words of some texts: hash of each, pieces of each, and where the words of each text begin."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        low = np.where((data >= 65) & (data <= 90), data | 32, data)
        before = np.concatenate([[0], low[:-1]]).astype(np.uint8)
        low = np.where((before == 0xC3) & (low >= 0x80) & (low <= 0x9E), low | 32, low)
        inside = (low >= 128) | ((low >= 97) & (low <= 122)) | ((low >= 48) & (low <= 57))
        follows = np.concatenate([[False], inside[:-1]])
        texts = offsets[:-1][offsets[:-1] < len(data)]
        follows[texts] = False
        starts = np.flatnonzero(inside & ~follows)
        self.starts, self.offsets = starts, np.searchsorted(starts, offsets)
        spaced = np.where(inside, low, 32).astype(np.uint32)
        padded = np.concatenate([[32], spaced, [32, 32]]).astype(np.uint32)
        grams = padded[:-3] | padded[1:-2] << 8 | padded[2:-1] << 16 | padded[3:] << 24
        self.pieces = (grams[inside] * np.uint32(0x9E3779B1)) >> np.uint32(32 - PIECE_BITS)
        first = np.cumsum(inside, dtype=np.int32) - inside
        self.firsts = np.append(first[starts], len(self.pieces)).astype(np.int32)
        powers = np.cumprod(np.full(int(np.diff(self.firsts).max(initial=0)), BASE, np.uint64))
        place = np.arange(len(self.pieces), dtype=np.int32) - np.repeat(self.firsts[:-1], np.diff(self.firsts))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((low[inside].astype(np.uint64) + np.uint64(1)) * powers[place], dtype=np.uint64)])
        self.hashes = sums[self.firsts[1:]] - sums[self.firsts[:-1]]

    def bytes_of(self, start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First byte and end of runs of words in the text."""
        last = start + length - 1
        return self.starts[start], self.starts[last] + self.firsts[last + 1] - self.firsts[last]

    def windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, first word and number of words of every window, longest first."""
        sizes = np.diff(self.offsets)
        count = np.where(sizes > 0, 1 + np.maximum(0, -(-(sizes - WINDOW) // STRIDE)), 0)
        row = np.repeat(np.arange(len(sizes)), count)
        start = self.offsets[row] + (np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)) * STRIDE
        length = np.minimum(self.offsets[row + 1] - start, WINDOW)
        order = np.argsort(-length, kind="stable")
        return row[order], start[order], length[order]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x.clip(-80, 80)))


class Network:
    """Parameters by name; `tags` and `slots` find the vector of a known word, 0 being that of all others."""

    def __init__(self, hashes: np.ndarray, odds: np.ndarray, piece_odds: np.ndarray):
        """Starts from the words that have a vector of their own, their odds and those of all pieces."""
        draw = np.random.default_rng(SEED)
        known = np.argsort(np.abs(odds), kind="stable")  # of words that share a slot the most telling one stays
        self.tags = np.zeros(WORD_SLOTS, np.uint32)
        self.slots = np.zeros(WORD_SLOTS, np.int32)
        slot, tag = self.place(hashes[known])
        self.tags[slot], self.slots[slot] = tag, np.arange(1, len(known) + 1)
        self.p = {
            "word": 0.1 * draw.standard_normal((len(known) + 1, WORD_DIM)),
            "piece": 0.1 * draw.standard_normal((1 << PIECE_BITS, PIECE_DIM)),
            "input": 0.5 * draw.standard_normal((WORD_DIM + PIECE_DIM, 2 * 3 * HIDDEN)),
            "bias": np.zeros(2 * 3 * HIDDEN),
            "hidden": 0.3 * draw.standard_normal((2, HIDDEN, 3 * HIDDEN)),
            "look": 0.1 * draw.standard_normal(2 * HIDDEN),
            "out": 0.3 * draw.standard_normal(2 * HIDDEN),
            "level": np.zeros(1),
        }
        self.p["word"][1:, 0] = odds[known]
        self.p["piece"][:, 0] = piece_odds
        self.p = {name: value.astype(np.float32) for name, value in self.p.items()}

    @staticmethod
    def place(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mixed = (hashes ^ (hashes >> np.uint64(29))) * BASE
        return (mixed >> np.uint64(46)).astype(np.int64), (mixed & np.uint64(0xFFFFFFFF)).astype(np.uint32) | np.uint32(1)

    def ids(self, words: Words) -> np.ndarray:
        slot, tag = self.place(words.hashes)
        return np.where(self.tags[slot] == tag, self.slots[slot], 0)

    def characters(self, words: Words) -> np.ndarray:
        """Mean vector of the pieces of each word."""
        if not len(words.hashes):
            return np.zeros((0, PIECE_DIM), np.float32)
        return np.add.reduceat(self.p["piece"][words.pieces], words.firsts[:-1], axis=0) / np.diff(words.firsts)[:, None].astype(np.float32)

    def inputs(self, words: Words) -> np.ndarray:
        """What each word adds to the gates of both directions."""
        by_word = self.p["word"] @ self.p["input"][:WORD_DIM] + self.p["bias"]
        return by_word[self.ids(words)] + self.characters(words) @ self.p["input"][WORD_DIM:]

    def forward(self, gates: np.ndarray, start: np.ndarray, length: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Logit of each window; windows come longest first. keep: gets what `backward` needs."""
        p, n = self.p, len(start)
        steps = int(length[0]) if n else 0
        active = np.searchsorted(-length, -np.arange(steps), side="left")
        gates = gates.reshape(-1, 2, 3 * HIDDEN)
        state = np.zeros((2, n, HIDDEN), np.float32)
        states = np.zeros((steps, 2, n, HIDDEN), np.float32)
        for t, a in enumerate(active):
            x = np.stack([gates[start[:a] + t, 0], gates[start[:a] + length[:a] - 1 - t, 1]])
            h = state[:, :a]
            u = h @ p["hidden"]
            rz = sigmoid(x[..., : 2 * HIDDEN] + u[..., : 2 * HIDDEN])
            r, z = rz[..., :HIDDEN], rz[..., HIDDEN:]
            c = np.tanh(x[..., 2 * HIDDEN :] + r * u[..., 2 * HIDDEN :])
            new = c + z * (h - c)
            if keep is not None:
                keep.setdefault("steps", []).append((h.copy(), u, r, z, c))
            state[:, :a] = new
            states[t, :, :a] = new
        at = np.arange(steps)[:, None]
        back = np.clip(length - 1 - at, 0, None)
        both = np.concatenate([states[:, 0], states[back, 1, np.arange(n)]], axis=2)
        look = np.where(at < length, both @ p["look"], -np.inf)
        weight = np.exp(look - look.max(axis=0, initial=-np.inf, keepdims=True)) if steps else look
        weight /= weight.sum(axis=0)
        pooled = np.einsum("tn,tnh->nh", weight, both)
        if keep is not None:
            keep |= {"active": active, "both": both, "weight": weight, "pooled": pooled, "back": back}
        return pooled @ p["out"] + p["level"][0]

    def backward(self, error: np.ndarray, keep: dict, start: np.ndarray, length: np.ndarray) -> tuple[dict, tuple]:
        """Gradients of the parameters above the inputs, and of the gates by word position."""
        p, both, weight = self.p, keep["both"], keep["weight"]
        grad = {"out": keep["pooled"].T @ error, "level": np.array([error.sum()])}
        to_pool = error[:, None] * p["out"]
        share = np.einsum("nh,tnh->tn", to_pool, both)
        to_look = weight * (share - (weight * share).sum(axis=0))
        grad["look"] = np.einsum("tn,tnh->h", to_look, both)
        to_both = weight[..., None] * to_pool + to_look[..., None] * p["look"]
        steps, n = weight.shape
        to_states = np.zeros((steps, 2, n, HIDDEN), np.float32)
        inside = np.arange(steps)[:, None] < length
        to_states[:, 0] = to_both[..., :HIDDEN]
        t, lane = np.nonzero(inside)
        to_states[keep["back"][t, lane], 1, lane] = to_both[t, lane, HIDDEN:]
        grad["hidden"] = np.zeros_like(p["hidden"])
        carried = np.zeros((2, n, HIDDEN), np.float32)
        where, what = [], []
        for t in range(steps - 1, -1, -1):
            a = keep["active"][t]
            h, u, r, z, c = keep["steps"][t]
            d = carried[:, :a] + to_states[t, :, :a]
            dc = d * (1 - z) * (1 - c * c)
            dz = d * (h - c) * z * (1 - z)
            dr = dc * u[..., 2 * HIDDEN :] * r * (1 - r)
            du = np.concatenate([dr, dz, dc * r], axis=2)
            grad["hidden"] += h.transpose(0, 2, 1) @ du
            carried[:, :a] = d * z + du @ p["hidden"].transpose(0, 2, 1)
            where.append(np.stack([start[:a] + t, start[:a] + length[:a] - 1 - t]))
            what.append(np.concatenate([dr, dz, dc], axis=2))
        return grad, (np.concatenate(where, axis=1), np.concatenate(what, axis=1))

    def first_scores(self, words: Words, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Summed odds of windows before anything is learned."""
        odds = np.concatenate([[0], np.cumsum(self.p["word"][self.ids(words), 0] + 2 * self.characters(words)[:, 0])])
        return odds[start + length] - odds[start]

    def train(self, words: Words, owner: np.ndarray, labels: np.ndarray) -> None:
        """Adam on the worst window of each text, chosen anew in every epoch. owner: text of each row of `words`."""
        draw = np.random.default_rng(SEED)
        row, start, length = words.windows()
        row = owner[row]
        ids = self.ids(words)
        first = {name: np.zeros_like(value) for name, value in self.p.items()}
        second = {name: np.zeros_like(value) for name, value in self.p.items()}
        score, step = self.first_scores(words, start, length), 0
        while step < STEPS:
            if step:
                score = self.scores(words, row, start, length)
            order = np.lexsort((-score, row))
            worst = order[np.concatenate([[True], np.diff(row[order]) > 0])]
            for batch in np.array_split(draw.permutation(worst), max(1, len(worst) // BATCH)):
                batch = batch[np.argsort(-length[batch], kind="stable")]
                s, n, y = start[batch], length[batch], labels[row[batch]]
                used = np.unique(np.concatenate([np.arange(a, a + b) for a, b in zip(s, n, strict=True)]))
                at = np.searchsorted(used, s)
                chars = self.char_rows(words, used)
                shown = np.where(draw.random(len(used)) < HIDE, 0, ids[used])
                x = np.concatenate([self.p["word"][shown], chars[0]], axis=1)
                keep: dict = {}
                logit = self.forward(x @ self.p["input"] + self.p["bias"], at, n, keep)
                error = ((sigmoid(logit) - y) / len(batch)).astype(np.float32)
                grad, (where, what) = self.backward(error, keep, at, n)
                to_gates = np.zeros((len(used), 2, 3 * HIDDEN), np.float32)
                for d in (0, 1):
                    np.add.at(to_gates[:, d], where[d], what[d])
                to_gates = to_gates.reshape(len(used), -1)
                grad["input"], grad["bias"] = x.T @ to_gates, to_gates.sum(axis=0)
                to_x = to_gates @ self.p["input"].T
                rows = {"word": (shown, to_x[:, :WORD_DIM]), "piece": (chars[1], np.repeat(to_x[:, WORD_DIM:] / chars[2][:, None], chars[2], axis=0))}
                step += 1
                fade = np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                for name, (index, value) in rows.items():
                    touched, at_row = np.unique(index, return_inverse=True)
                    total = np.zeros((len(touched), value.shape[1]), np.float32)
                    np.add.at(total, at_row, value)
                    first[name][touched] = 0.9 * first[name][touched] + 0.1 * total
                    second[name][touched] = 0.999 * second[name][touched] + 0.001 * total**2
                    self.p[name][touched] -= TABLE_RATE * fade * first[name][touched] / (np.sqrt(second[name][touched]) + 1e-8)
                for name, value in grad.items():
                    first[name] = 0.9 * first[name] + 0.1 * value
                    second[name] = 0.999 * second[name] + 0.001 * value**2
                    self.p[name] = (self.p[name] - RATE * fade * first[name] / (np.sqrt(second[name]) + 1e-8)).astype(np.float32)

    def char_rows(self, words: Words, used: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the used words: mean piece vectors, all pieces, and pieces of each."""
        sizes = words.firsts[used + 1] - words.firsts[used]
        ends = np.cumsum(sizes)
        pieces = words.pieces[np.repeat(words.firsts[used] - (ends - sizes), sizes) + np.arange(ends[-1])]
        return np.add.reduceat(self.p["piece"][pieces], ends - sizes, axis=0) / sizes[:, None].astype(np.float32), pieces, sizes

    def scores(self, words: Words, row: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Logit of every window, some thousand at a time."""
        found = np.zeros(len(row), np.float32)
        ids = self.ids(words)
        by_word = self.p["word"] @ self.p["input"][:WORD_DIM] + self.p["bias"]
        for i in range(0, len(row), 2048):
            s, n = start[i : i + 2048], length[i : i + 2048]
            at = np.cumsum(n) - n
            used = np.repeat(s - at, n) + np.arange(at[-1] + n[-1])
            gates = by_word[ids[used]] + self.char_rows(words, used)[0] @ self.p["input"][WORD_DIM:]
            found[i : i + 2048] = self.forward(gates, at, n)
        return found

    def calibrate(self, logits: np.ndarray, labels: np.ndarray, share: float) -> None:
        """Fits slope and level of the final odds on texts not trained on, weighted to the share of toxic rows among all labels."""
        weight = np.where(labels > 0, share / labels.mean(), (1 - share) / (1 - labels.mean()))
        a, b = 1.0, 0.0
        x = np.where(np.isfinite(logits), logits, logits[np.isfinite(logits)].min(initial=0))
        for _ in range(50):  # Newton steps, damped by a weak prior on the slope
            q = sigmoid(a * x + b)
            error, bend = weight * (q - labels), weight * q * (1 - q) + 1e-6
            gradient = np.array([(error * x).sum() + 0.1 * (a - 1), error.sum()])
            curve = np.array([[(bend * x * x).sum() + 0.1, (bend * x).sum()], [(bend * x).sum(), bend.sum()]])
            step = np.linalg.solve(curve, gradient).clip(-0.5, 0.5)
            a, b = min(max(a - step[0], 0.1), 3.0), min(max(b - step[1], -10.0), 10.0)
        self.slope, self.shift = float(a), float(b)

    def logits(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Logit of the worst window of each text, -inf for a text without words."""
        words = Words(data, offsets)
        row, start, length = words.windows()
        worst = np.full(len(offsets) - 1, -np.inf)
        np.maximum.at(worst, row, self.scores(words, row, start, length))
        return worst

    def predict(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        worst = self.logits(data, offsets)
        return np.where(np.isfinite(worst), sigmoid(self.slope * np.nan_to_num(worst) + self.shift), 0.0)


def log_odds(bad: np.ndarray, good: np.ndarray, toxic_texts: int, other_texts: int) -> np.ndarray:
    """Smoothed log ratio of the shares of toxic and other texts that hold an item."""
    return np.log((bad + PRIOR) / (good * max(1, toxic_texts) / max(1, other_texts) + PRIOR))


def sample_of(docs: DataFrame, labels: DataFrame, rows: int) -> tuple[DataFrame, dict]:
    """text, toxic and checked (kept back for calibration) of at most `rows` labelled documents of each class, and the rows of each label."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.select("doc_id", (F.col("toxic") > 0).cast("int").alias("toxic"))
    counts = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    place = F.xxhash64("doc_id") / F.lit(2.0**64) + 0.5
    reach = F.when(F.col("toxic") > 0, 2.0 * rows / counts.get(1, 1)).otherwise(2.0 * rows / counts.get(0, 1))
    rank = F.row_number().over(Window.partitionBy("toxic").orderBy(F.xxhash64("doc_id"), "doc_id"))
    picked = known.where(place <= reach).withColumn("rank", rank).where(F.col("rank") <= rows).withColumn("checked", F.col("rank") % 4 == 0)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(picked), "doc_id")
    found = texts.groupBy("doc_id").agg(F.max("text").alias("text"), F.max("toxic").alias("toxic"), F.max("checked").alias("checked"))
    return common.stored(found, "labelled"), counts


def holders(learned: DataFrame) -> DataFrame:
    """Toxic (`bad`) and other (`good`) texts that hold each word (`kind` 0, key: its hash) and piece (`kind` 1)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.blocks(batches, "text"):
            words = Words(*common.utf8(batch["text"]))
            text = np.repeat(np.arange(batch.num_rows), np.diff(words.offsets))
            for kind, keys, owner in ((0, words.hashes, text), (1, words.pieces.astype(np.uint64), np.repeat(text, np.diff(words.firsts)))):
                names, at = np.unique(keys, return_inverse=True)
                pair = np.unique(at * batch.num_rows + owner)
                toxic = batch["toxic"].to_numpy()[pair % batch.num_rows] > 0
                bad = np.bincount(pair[toxic] // batch.num_rows, minlength=len(names))
                good = np.bincount(pair[~toxic] // batch.num_rows, minlength=len(names))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(names), kind)), *map(pa.array, (names.view(np.int64), bad, good))], ["kind", "key", "bad", "good"])

    rows = learned.select("text", "toxic").mapInArrow(scan, "kind bigint, key bigint, bad bigint, good bigint")
    return rows.groupBy("kind", "key").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))


def worst_windows(learned: DataFrame, network: Network) -> DataFrame:
    """doc_id, toxic and words of the CANDIDATES windows of each text whose words have the worst odds."""
    shared = learned.sparkSession.sparkContext.broadcast(vars(network))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = common.restored(Network, shared.value)
        for batch in common.blocks(batches, "text"):
            data, offsets = common.utf8(batch["text"])
            words = Words(data, offsets)
            row, start, length = words.windows()
            order = np.lexsort((-model.first_scores(words, start, length), row))
            rank = np.arange(len(order)) - np.searchsorted(row[order], row[order])
            chosen = order[rank < CANDIDATES]
            begin, end = words.bytes_of(start[chosen], length[chosen])
            parts = [data[a:b].tobytes() for a, b in zip(begin, end, strict=True)]
            at = pa.array(row[chosen])
            yield pa.RecordBatch.from_arrays([batch["doc_id"].take(at), batch["toxic"].take(at), pa.array(parts, pa.binary())], ["doc_id", "toxic", "words"])

    return learned.select("doc_id", "toxic", "text").mapInArrow(scan, "doc_id bigint, toxic int, words binary")


def worst_logits(texts: DataFrame, network: Network) -> DataFrame:
    """toxic and the logit of the worst window of each whole text."""
    shared = texts.sparkSession.sparkContext.broadcast(vars(network))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = common.restored(Network, shared.value)
        for batch in common.blocks(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["toxic"], pa.array(model.logits(*common.utf8(batch["text"])))], ["doc_id", "toxic", "logit"])

    return texts.select("doc_id", "toxic", "text").mapInArrow(scan, "doc_id bigint, toxic int, logit double")


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Network | None:
    """Learns from the whole texts of at most `rows` labelled documents of each class."""
    sample, counts = sample_of(docs, labels, rows)
    n = {(r.checked, r.toxic): r.n for r in sample.groupBy("checked", "toxic").agg(F.count("*").alias("n")).collect()}
    if len(n) < 4:
        return None
    learned, checked = sample.where("not checked"), sample.where("checked")
    texts = n[False, 1], n[False, 0]
    # words of at least LEAST_TEXTS texts of the sample, and a fixed number of pieces
    table = holders(learned).where((F.col("kind") == 1) | (F.col("bad") + F.col("good") >= LEAST_TEXTS)).orderBy("kind", "key").toArrow()
    kind, key, bad, good = (table[name].to_numpy() for name in ("kind", "key", "bad", "good"))
    piece_bad, piece_good = np.zeros((2, 1 << PIECE_BITS))
    piece_bad[key[kind == 1]], piece_good[key[kind == 1]] = bad[kind == 1], good[kind == 1]
    word = kind == 0
    network = Network(key[word].view(np.uint64), log_odds(bad[word], good[word], *texts), log_odds(piece_bad, piece_good, *texts))
    windows = worst_windows(learned, network).orderBy("doc_id", "words").toArrow()
    ids, owner = np.unique(windows["doc_id"].to_numpy(), return_inverse=True)
    truth = np.zeros(len(ids), np.float32)
    truth[owner] = windows["toxic"].to_numpy()
    order = np.argsort(np.array([zlib.crc32(b"%d" % i) for i in ids.tolist()]), kind="stable")  # ids may follow a pattern
    place = np.empty(len(ids), np.int64)
    place[order] = np.arange(len(ids))
    network.train(Words(*common.utf8(windows["words"].combine_chunks().cast(pa.string()))), place[owner], truth[order])
    found = worst_logits(checked, network).orderBy("doc_id").toArrow()
    network.calibrate(found["logit"].to_numpy(), found["toxic"].to_numpy().astype(np.float32), counts[1] / (counts[0] + counts[1]))
    return network


def predict(docs: DataFrame, network: Network | None) -> DataFrame:
    """Adds score and predicted to the columns of docs, without `text`."""
    shared = docs.sparkSession.sparkContext.broadcast(vars(network) if network else None)
    names = docs.columns

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = common.restored(Network, shared.value) if shared.value else None
        for batch in common.blocks(batches, "text"):
            found = model.predict(*common.utf8(batch["text"])) if model else np.zeros(batch.num_rows)
            columns = [batch[name] for name in names if name != "text"]
            flags = pa.array((found >= 0.5).astype(np.int32))
            yield pa.RecordBatch.from_arrays([*columns, pa.array(found), flags], [*(n for n in names if n != "text"), "score", "predicted"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "text")
    return docs.mapInArrow(score, f"{schema}, score double, predicted int")


def without_toxic(docs: DataFrame, network: Network | None) -> DataFrame:
    """The rows of docs, with all their columns, that are not predicted to be toxic."""
    shared = docs.sparkSession.sparkContext.broadcast(vars(network) if network else None)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = common.restored(Network, shared.value) if shared.value else None
        for batch in common.blocks(batches, "text"):
            yield batch.filter(pa.array(model.predict(*common.utf8(batch["text"])) < 0.5)) if model else batch

    return docs.mapInArrow(keep, docs.schema)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels")
    network = fit(docs, labels.where(~common.is_held_out(F.col("doc_id"))))
    return predict(docs.select("doc_id", common.is_held_out(F.col("doc_id")).alias("held_out"), "text"), network)
