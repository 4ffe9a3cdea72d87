"""Quality rules with line labels by a conditional random field (operator 5).

Counts of words, symbols, repeated lines and repeated windows give the base rules. The lines of a text are
then labelled content or boilerplate by Viterbi decoding of a linear-chain conditional random field, whose state scores come from
features of the line and whose transition scores favour runs; the share of words in content lines decides.
The field is trained on lines of labelled documents: those of good ones are content; those of bad ones are boilerplate
where a logistic regression on the same features, fitted first, says so.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.llm.common import flat_utf8, mix, span_hashes, steps, words

#: Bound of the sample of labelled rows that the field is fitted on.
SAMPLE_ROWS = 1500
#: Least share of words in content lines; base rules: least number of words, greatest percentage of repeated ones.
LEAST_SHARE, LEAST_WORDS, MOST_REPEATED = 0.5, 50, 50
_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[list(b"#*$%&|<>")] = True
_KINDS = {"digit": b"0123456789", "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "loud": b"!?", "stop": b".,;:", "bar": b"|<>{}=_/\\"}


@dataclass
class Counts:
    n_words: np.ndarray
    word_chars: np.ndarray
    n_symbols: np.ndarray
    n_dup_lines: np.ndarray
    n_repeat_words: np.ndarray


def _lines(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and texts of the lines that aren't empty."""
    breaks = np.flatnonzero(buf == 10)
    full = np.flatnonzero(np.diff(offsets) > 0)
    starts, ends = np.sort(np.r_[offsets[full], breaks + 1]), np.sort(np.r_[breaks, offsets[full + 1]])
    inside = ends > starts
    starts, ends = starts[inside], ends[inside]
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def _repeats(hashes: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per item: whether its hash occurs in its text again, and whether it did before."""
    if not len(hashes):
        return np.zeros(0, bool), np.zeros(0, bool)
    _, first, each, count = np.unique(mix(hashes + text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True, return_inverse=True, return_counts=True)
    return count[each] > 1, first[each] != np.arange(len(hashes))


def measure(buf: np.ndarray, offsets: np.ndarray) -> tuple[Counts, np.ndarray, np.ndarray, np.ndarray]:
    """The counts of each text; and of its lines with a word: features, words, text."""
    n = len(offsets) - 1
    starts, ends, first = words(buf, offsets)
    text = np.repeat(np.arange(n), np.diff(first))
    points = np.r_[0, np.cumsum((buf & 0xC0) != 0x80)]
    per = lambda at, w=None: np.bincount(at, w, n).astype(np.int64)
    h = span_hashes(buf, starts, ends, lower=False)
    windows = np.flatnonzero(text[2:] == text[:-2]) if len(h) > 2 else np.empty(0, np.int64)
    again, _ = _repeats(mix(mix(h[windows] * np.uint64(3) + np.uint64(1)) + mix(h[windows + 1] * np.uint64(5)) * np.uint64(7) + h[windows + 2] if len(windows) else np.empty(0, np.uint64)), text[windows])
    covered = np.zeros(len(h) + 2, bool)
    for k in range(3):
        covered[windows[again] + k] = True
    a, b, line_text = _lines(buf, offsets)
    line_words = np.searchsorted(starts, b) - np.searchsorted(starts, a)
    a, b, line_text, line_words = a[line_words > 0], b[line_words > 0], line_text[line_words > 0], line_words[line_words > 0]
    _, before = _repeats(span_hashes(buf, a, b, lower=False), line_text)
    symbols = np.r_[0, np.cumsum(_IS_SYMBOL[buf])]
    counts = Counts(np.diff(first), per(text, points[ends] - points[starts]), symbols[offsets[1:]] - symbols[offsets[:-1]], per(line_text, before), per(text, covered[: len(h)]))
    size = np.maximum(points[b] - points[a], 1)
    share = lambda table: (lambda c: (c[b] - c[a]) / size)(np.r_[0, np.cumsum(table[buf])])
    columns = [np.ones(len(a)), np.minimum(np.log1p(line_words), 5) / 5, size / line_words / 10, before.astype(float), np.minimum((symbols[b] - symbols[a]) / size * 10, 3)]
    for chars in _KINDS.values():
        table = np.zeros(256, bool)
        table[list(chars)] = True
        columns.append(np.minimum(share(table) * 5, 3))
    reach = np.r_[0, np.cumsum(covered[: len(h)])]
    i, j = np.searchsorted(starts, a), np.searchsorted(starts, b)
    columns += [(reach[j] - reach[i]) / line_words, (buf[b - 1] == 46).astype(float) if len(b) else np.zeros(0)]
    # words equal to the one before them
    same = np.r_[0, np.cumsum(np.r_[False, h[1:] == h[:-1]])] if len(h) else np.zeros(1, np.int64)
    columns.append((same[j] - same[i]) / line_words)
    return counts, np.stack(columns, 1), line_words, line_text


@dataclass
class Field:
    """State scores are features @ states; moves[a, b] scores b after a. State 1 is content."""

    states: np.ndarray
    moves: np.ndarray

    def viterbi(self, features: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
        """The likeliest labels of all lines; the lines of a text stand together, in order."""
        label = np.zeros(len(text), np.int64)
        if not len(text):
            return label
        score, (at, length, active) = features @ self.states, _runs(text, n)
        best, back = score[at], []
        for t in range(1, len(active)):
            m = active[t]
            step = best[:m, :, None] + self.moves[None]
            back.append(step.argmax(1))
            best[:m] = step.max(1) + score[at[:m] + t]
        state = best.argmax(1)
        label[at + length - 1] = state
        for t in range(len(active) - 1, 0, -1):
            m = active[t]
            state[:m] = back[t - 1][np.arange(m), state[:m]]
            label[at[:m] + t - 1] = state[:m]
        return label


def _runs(text: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the texts with lines, those with most first: first line and number of lines; and how many texts have more than t lines, by t."""
    count = np.bincount(text, minlength=n)
    order = np.argsort(-count, kind="stable")[: np.count_nonzero(count)]
    return (np.cumsum(count) - count)[order], count[order], len(order) - np.cumsum(np.bincount(count[order]))[:-1]


def _train_field(features: np.ndarray, label: np.ndarray, text: np.ndarray, n: int, rounds: int = 80) -> Field:
    """Maximises the labels' conditional likelihood, by forward and backward sums and Adam steps."""
    at, length, active = _runs(text, n)
    w, moves = np.zeros((features.shape[1], 2)), np.zeros((2, 2))
    m = [np.zeros_like(w), np.zeros_like(moves), np.zeros_like(w), np.zeros_like(moves)]
    one = np.eye(2)[label]
    inner = np.flatnonzero(text[1:] == text[:-1])
    seen_moves = np.zeros((2, 2))
    np.add.at(seen_moves, (label[inner], label[inner + 1]), 1)
    for r in range(1, rounds + 1):
        score = features @ w
        forward, backward = np.empty_like(score), np.zeros_like(score)
        forward[at] = score[at]
        for t in range(1, len(active)):
            here = at[: active[t]] + t
            prior = here - 1
            forward[here] = np.logaddexp(forward[prior, 0:1] + moves[0], forward[prior, 1:2] + moves[1]) + score[here]
        for t in range(len(active) - 1, 0, -1):
            here = at[: active[t]] + t
            prior = here - 1
            later = score[here] + backward[here]
            backward[prior] = np.stack([np.logaddexp(later[:, 0] + moves[k, 0], later[:, 1] + moves[k, 1]) for k in (0, 1)], 1)
        last = at + length - 1
        of_text = np.zeros(n)
        of_text[text[at]] = np.logaddexp(forward[last, 0], forward[last, 1])
        total = of_text[text]
        chance = np.exp(forward + backward - total[:, None])
        pair = np.exp(forward[inner][:, :, None] + moves[None] + (score[inner + 1] + backward[inner + 1])[:, None, :] - total[inner][:, None, None])
        grads = [features.T @ (one - chance) / len(text) - 1e-4 * w, (seen_moves - pair.sum(0)) / len(text) - 1e-3 * moves]
        for k, x in enumerate((w, moves)):
            m[k] = 0.9 * m[k] + 0.1 * grads[k]
            m[k + 2] = 0.99 * m[k + 2] + 0.01 * grads[k] ** 2
            x += 0.2 * (m[k] / (1 - 0.9**r)) / (np.sqrt(m[k + 2] / (1 - 0.99**r)) + 1e-8)
    return Field(w, moves)


def fit(texts: list[str], good: list[int]) -> Field | None:
    """A field from whole texts and their labels; None if either label is missing."""
    if len(set(good)) < 2:
        return None
    buf, offsets = flat_utf8(pa.array(texts, pa.string()))
    parts = []
    for i, j in steps(offsets, 500_000):
        _, f, w, t = measure(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        parts.append((f, w, t + i))
    features, line_words, text = (np.concatenate(x) for x in zip(*parts))
    y = np.array(good)[text]
    weight = line_words / np.maximum(np.bincount(text, line_words, len(texts))[text], 1)  # every text counts the same
    w = np.zeros(features.shape[1])
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(features @ w, -30, 30)))
        hessian = (features * (weight * p * (1 - p))[:, None]).T @ features + 1e-2 * np.eye(len(w))
        w += np.linalg.solve(hessian, features.T @ (weight * (y - p)) - 1e-2 * w)
    label = np.where((y == 0) & (features @ w < 0), 0, 1)
    return _train_field(features, label, text, len(texts))


def train(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> Field | None:
    """Fits a field on at most SAMPLE_ROWS labelled rows, chosen by a hash of the id; an id with several texts gives each its label, within the bound."""
    sample = labels.select(F.col(key).alias("key"), F.col(label).alias("good")).where(F.col("key").isNotNull() & F.col("good").isin(0, 1))
    sample = sample.groupBy("key").agg(F.min("good").alias("good")).orderBy(F.xxhash64("key"), "key").limit(SAMPLE_ROWS)
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text")).join(F.broadcast(sample), "key").orderBy(F.xxhash64("key", "text"), "key").limit(SAMPLE_ROWS).collect()
    rows = sorted(((r.key, r.text or "", r.good) for r in rows), key=lambda r: r[:2])
    return fit([r[1] for r in rows], [int(r[2]) for r in rows])


def quality(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, content_share, kept), one row per row of df.

    kept: the base rules hold and at least LEAST_SHARE of the words stand in lines labelled content. A null or empty text has no
    words and fails the base rules. Without labels of both kinds all lines count as content. A very long text is measured whole, in a step of
    its own; rows that are equal have equal results. Columns of df besides key and text aren't read.
    """
    sent = df.sparkSession.sparkContext.broadcast(train(df, labels, key, text))
    names = [key, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "content_share", "kept"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = flat_utf8(batch.column(1))
            for i, j in steps(offsets):
                c, features, line_words, line_text = measure(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                label = np.ones(len(line_text)) if sent.value is None else sent.value.viterbi(features, line_text, j - i)
                share = np.bincount(line_text, line_words * label, j - i) / np.maximum(c.n_words, 1)
                failed = (c.n_words < LEAST_WORDS) | (100 * c.n_repeat_words > MOST_REPEATED * c.n_words)
                columns = [c.n_words, c.word_chars, c.n_symbols, c.n_dup_lines, c.n_repeat_words, failed, share, ~failed & (share >= LEAST_SHARE)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *map(pa.array, columns)], names=names)

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInArrow(run, f"{key} {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, content_share double, kept boolean")
