"""Language identification by cross-parsing entropy.

A suffix automaton of labelled text per language reads a text as a sequence of phrases, each the longest match from where the
last one ended. A text in the automaton's language falls into few long phrases. The language with the fewest phrases, each
counted at the bits that point at a place in its training text, wins.

Results: a null, an empty text or one without letters gives `und` with score 0. Equal bits: the alphabetically first language.
Repeated rows give repeated results. Without any training row every text is `und`. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from zoneflow.llm import common

#: Bounds of the training sample: texts per language and code points of each.
SAMPLE_TEXTS = 64
SAMPLE_CHARS = 512
#: Distinct characters that the automata tell apart; rarer ones share one symbol.
SYMBOLS = 512
#: A phrase ends at the latest after so many code points of a text.
PIECE = 1024

UNKNOWN = "und"


def suffix_automaton(symbols: np.ndarray) -> list[dict[int, int]]:
    """Transitions of the smallest automaton that accepts every substring; state 0 is the start."""
    moves: list[dict[int, int]] = [{}]
    link, longest, last = [-1], [0], 0
    for symbol in symbols.tolist():
        new = len(moves)
        moves.append({})
        longest.append(longest[last] + 1)
        link.append(0)
        state = last
        while state >= 0 and symbol not in moves[state]:
            moves[state][symbol] = new
            state = link[state]
        if state >= 0:
            target = moves[state][symbol]
            if longest[target] == longest[state] + 1:
                link[new] = target
            else:
                twin = len(moves)
                moves.append(dict(moves[target]))
                longest.append(longest[state] + 1)
                link.append(link[target])
                link[target] = link[new] = twin
                while state >= 0 and moves[state].get(symbol) == target:
                    moves[state][symbol] = twin
                    state = link[state]
        last = new
    return moves


def plain(text: str) -> str:
    """Lower-case letters; whatever stands between words becomes one space."""
    return " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split())


def letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


class Model:
    """Automata of all languages as one table: row of a state and symbol -> next row * 4 + phrases that end."""

    def __init__(self, texts: dict[str, list[str]]):
        self.languages = sorted(texts)
        texts = {language: [plain(text) for text in sample] for language, sample in texts.items()}
        counts = Counter(c for sample in texts.values() for text in sample for c in text if c != " ")
        self.symbols = {c: i + 1 for i, (c, _) in enumerate(sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:SYMBOLS])}
        self.width = len(self.symbols) + 2
        tables, self.roots, self.bits, rows = [], [], [], 0
        for language in self.languages:
            known = [self.symbols.get(c, self.width - 1 if c == " " else 0) for text in texts[language] for c in text + " "]
            moves = suffix_automaton(np.array(known, np.int64))
            target = np.zeros((len(moves), self.width), np.int64)
            ended = np.ones((len(moves), self.width), np.int64)
            for symbol, state in moves[0].items():
                target[:, symbol] = state
            unseen = [symbol for symbol in range(self.width) if symbol not in moves[0]]
            ended[1:, unseen] = 2
            for state, out in enumerate(moves):
                for symbol, to in out.items():
                    target[state, symbol] = to
                    ended[state, symbol] = 0
            tables.append((((target + rows) * self.width) << 2 | ended).ravel())
            self.roots.append(rows * self.width)
            self.bits.append(math.log2(len(known) + 1))
            rows += len(moves)
        joined = np.concatenate(tables) if tables else np.zeros(0, np.int64)
        self.table = joined.astype(np.int32) if len(joined) < 1 << 28 else joined

    def classes(self) -> np.ndarray:
        """Symbol of each code point, letter case folded; what is no letter separates words."""
        known = np.where(letters(), 0, self.width - 1).astype(np.uint16)
        for char, symbol in self.symbols.items():
            for form in (char, char.upper()):
                if len(form) == 1:
                    known[ord(form)] = symbol
        return known

    def phrases(self, symbols: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Phrases of each text (columns) in each language (rows)."""
        row, start, length = common.lanes(offsets, PIECE)
        roots = np.array(self.roots, self.table.dtype)[:, None]
        state = np.repeat(roots, len(row), axis=1)
        count = np.zeros(state.shape, np.int32)
        active = np.searchsorted(-length, -np.arange(length[0] if len(length) else 0), side="left")
        for step, n in enumerate(active):
            move = self.table[state[:, :n] + symbols[start[:n] + step]]
            state[:, :n] = move >> 2
            count[:, :n] += move & 3
        count += state != roots
        return np.stack([np.bincount(row, c, minlength=len(offsets) - 1) for c in count])


def fit(labelled: DataFrame, sample_texts: int = SAMPLE_TEXTS, sample_chars: int = SAMPLE_CHARS) -> Model:
    """Learns from the first `sample_chars` of the `sample_texts` rows per `lang` that come first in a hash order."""
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", "head"))
    heads = labelled.select("lang", "doc_id", F.left("text", F.lit(sample_chars)).alias("head"))
    rows = heads.where("lang is not null and head is not null").withColumn("rank", rank).where(F.col("rank") <= sample_texts)
    texts: dict[str, list[str]] = {}
    for r in sorted(rows.select("lang", "rank", "head").collect()):
        texts.setdefault(r.lang, []).append(r.head)
    return Model(texts)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """Adds `lang_pred` and `score`, the share of the winner in the probabilities that the bits stand for, to doc_id and held_out."""
    shared = docs.sparkSession.sparkContext.broadcast(vars(model))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = common.restored(Model, shared.value)
        classes = known.classes()
        is_letter = letters()
        names = np.array([*known.languages, UNKNOWN])
        for batch in common.blocks(batches, "text"):
            points, offsets = common.code_points(*common.utf8(batch["text"]))
            in_word = is_letter[points]
            n_letters = common.per_row(in_word, offsets)
            kept = in_word.copy()
            kept[1:] |= in_word[:-1]  # the first of the characters between two words
            kept[offsets[:-1][n_letters > 0]] &= in_word[offsets[:-1][n_letters > 0]]
            symbols, offsets = classes[points[kept]], np.concatenate([[0], np.cumsum(kept)])[offsets]
            best, share = np.full(batch.num_rows, len(names) - 1), np.zeros(batch.num_rows)
            if known.languages:
                bits = known.phrases(symbols, offsets) * np.array(known.bits)[:, None]
                best = np.argmin(bits, axis=0)
                share = 1 / np.exp2(np.maximum(bits.min(axis=0) - bits, -1000)).sum(axis=0)
            mute = n_letters == 0
            best[mute], share[mute] = len(names) - 1, 0.0
            yield pa.RecordBatch.from_arrays(
                [batch["doc_id"], batch["held_out"], pa.array(names[best].tolist(), pa.string()), pa.array(share)],
                ["doc_id", "held_out", "lang_pred", "score"],
            )

    rows = docs.select("doc_id", common.is_held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(score, "doc_id bigint, held_out boolean, lang_pred string, score double")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return predict(docs, fit(docs.where(~common.is_held_out(F.col("doc_id")))))
