"""Repetition inside a single text: linear-chain CRF labelling with Viterbi decoding.

A text is a sequence of short lines, here its words. Each is labelled content, or first, second or third and last word of a repeated
run. What is observed of a word is local: whether the run of three words that begins at it has begun earlier in the text, and whether
the word itself is new to the text. That the words after the beginning of a run are repeated too, until the last run has ended, is what
the chain knows: its weights are trained here by maximum likelihood on generated texts. The share of words that Viterbi decoding does not
label content is the measure, and decides.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cutloom.session import spread

RUN = 3
_WORD = re.compile(r"[^\W_]+")


def words(text: str) -> list[str]:
    """Words without case, punctuation and spacing."""
    return _WORD.findall(unicodedata.normalize("NFKC", text).casefold())


def seen_runs(tokens: list[str]) -> np.ndarray:
    """For each position, whether the run of RUN words that begins there has begun earlier in the text."""
    first: set[tuple[str, ...]] = set()
    out = np.zeros(len(tokens), dtype=bool)
    for i, run in enumerate(zip(*(tokens[k:] for k in range(RUN)), strict=False)):
        if run in first:
            out[i] = True
        else:
            first.add(run)
    return out


#: Labels: content, and the place of a word after the latest beginning of a seen run.
CONTENT, LABELS = 0, RUN + 1


def observations(tokens: list[str]) -> np.ndarray:
    """Columns: bias, whether the run that begins at the word has begun earlier, whether the word is new to the text."""
    out = np.ones((len(tokens), 3), np.float32)
    out[:, 1] = seen_runs(tokens)
    known: set[str] = set()
    for i, token in enumerate(tokens):
        out[i, 2] = token not in known
        known.add(token)
    return out


class LineCRF:
    """Unary weights per label and observation, and weights of the moves between labels."""

    def __init__(self, unary: np.ndarray, moves: np.ndarray) -> None:
        self.unary, self.moves = unary, moves

    @classmethod
    def train(cls, sequences: list[tuple[np.ndarray, np.ndarray]], steps: int = 200, rate: float = 5.0, decay: float = 1e-5) -> LineCRF:
        """Gradient ascent on the mean log-likelihood of (observations, labels) pairs."""
        longest, width = max(len(y) for _, y in sequences), sequences[0][0].shape[1]
        x = np.zeros((len(sequences), longest, width))
        y = np.zeros((len(sequences), longest), dtype=int)
        valid = np.zeros((len(sequences), longest), dtype=bool)
        for i, (a, b) in enumerate(sequences):
            x[i, : len(b)], y[i, : len(b)], valid[i, : len(b)] = a, b, True
        unary, moves = np.zeros((LABELS, width)), np.zeros((LABELS, LABELS))
        truth = np.eye(LABELS)[y] * valid[..., None]
        told = (valid[:, 1:, None, None] * (truth[:, :-1, :, None] * truth[:, 1:, None, :])).sum(axis=(0, 1))
        n = valid.sum()
        for _ in range(steps):
            score = x @ unary.T
            alpha, beta = np.zeros_like(score), np.zeros_like(score)
            alpha[:, 0] = score[:, 0]
            for t in range(1, longest):
                step = np.logaddexp.reduce(alpha[:, t - 1, :, None] + moves, axis=1) + score[:, t]
                alpha[:, t] = np.where(valid[:, t, None], step, alpha[:, t - 1])
            for t in range(longest - 2, -1, -1):
                step = np.logaddexp.reduce(moves + (score[:, t + 1] + beta[:, t + 1])[:, None, :], axis=2)
                beta[:, t] = np.where(valid[:, t + 1, None], step, 0.0)
            total = np.logaddexp.reduce(alpha[:, -1], axis=1)
            p = np.exp(alpha + beta - total[:, None, None]) * valid[..., None]
            both = valid[:, 1:, None, None] * np.exp(alpha[:, :-1, :, None] + moves + (score[:, 1:] + beta[:, 1:])[:, :, None, :] - total[:, None, None, None])
            unary += rate * (np.einsum("itl,itw->lw", truth - p, x) / n - decay * unary)
            moves += rate * ((told - both.sum(axis=(0, 1))) / n - decay * moves)
        return cls(unary, moves)

    def decode(self, texts: list[np.ndarray], cells: int = 1 << 19) -> list[np.ndarray]:
        """The most likely labels of each text (Viterbi). Texts of like length go through together, a long one by itself; all are whole."""
        out: list[np.ndarray] = [np.zeros(0, np.uint8)] * len(texts)
        order = sorted((i for i in range(len(texts)) if len(texts[i])), key=lambda i: len(texts[i]))
        while order:
            longest = len(texts[order[-1]])
            part, order = order[-max(1, cells // longest) :], order[: -max(1, cells // longest)]
            sizes = np.array([len(texts[i]) for i in part])
            score = np.zeros((longest, len(part), LABELS))
            for k, i in enumerate(part):
                score[: sizes[k], k] = texts[i] @ self.unary.T
            back = np.empty((longest, len(part), LABELS), np.uint8)
            best = score[0]
            for t in range(1, longest):
                ways = best[:, :, None] + self.moves
                going = (t < sizes)[:, None]
                back[t] = np.where(going, ways.argmax(1), np.arange(LABELS))
                best = np.where(going, ways.max(1) + score[t], best)
            labels = np.empty((longest, len(part)), np.uint8)
            labels[-1] = best.argmax(1)
            for t in range(longest - 1, 0, -1):
                labels[t - 1] = np.take_along_axis(back[t], labels[t, :, None], 1)[:, 0]
            for k, i in enumerate(part):
                out[i] = labels[: sizes[k], k]
        return out


def _labelled(tokens: list[str]) -> np.ndarray:
    """Labels of a training text by the definition: every earlier place is compared."""
    out = np.zeros(len(tokens), int)
    for i in range(len(tokens) - RUN + 1):
        if any(tokens[j : j + RUN] == tokens[i : i + RUN] for j in range(i)):
            out[i : i + RUN] = range(1, RUN + 1)
    return out


def _generated(count: int, seed: int, size: int = 40) -> list[tuple[np.ndarray, np.ndarray]]:
    """Texts of random words with copied passages of random length, with their labels."""
    rng, out = np.random.default_rng(seed), []
    for _ in range(count):
        tokens: list[str] = []
        while len(tokens) < size:
            if tokens and rng.random() < 0.4:
                start = int(rng.integers(len(tokens)))
                tokens += tokens[start : start + int(rng.integers(1, 9))]
            else:
                tokens += [f"w{w}" for w in rng.integers(0, 40, int(rng.integers(1, 9)))]
        out.append((observations(tokens[:size]), _labelled(tokens[:size])))
    return out


@lru_cache(maxsize=4)
def default_model(train_texts: int = 200, seed: int = 11) -> LineCRF:
    """The CRF of this module, trained on a bounded number of generated texts."""
    return LineCRF.train(_generated(train_texts, seed))


def repetition(df: DataFrame, *, id_col: str, text_col: str) -> DataFrame:
    """Share of repeated words of each text, as the decoder labels them: id, words, share.

    Texts that are null or without words have 0 words and a share of 0. Texts of any length are taken whole; repeated ids count once, with
    the largest share. An empty table gives none; other columns are ignored.
    """
    model = default_model()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            seen = [observations(words(text)) if text else np.ones((0, 3)) for text in batch["text"]]
            labels = model.decode(seen)
            shares = [float((x != CONTENT).mean()) if len(x) else 0.0 for x in labels]
            yield pd.DataFrame({"id": batch["id"], "words": [len(x) for x in labels], "share": shares})

    rows = df.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("string").alias("text")).filter("id is not null")
    out = spread(rows).mapInPandas(run, "id bigint, words int, share double")
    return out.groupBy("id").agg(F.max(F.struct("share", "words")).alias("m")).select("id", "m.words", "m.share")
