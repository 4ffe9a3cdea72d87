"""Toxicity by a subsequence string kernel and a support vector machine (operator 6).

Texts are cut into sentences, and each sentence is a bag of strings: its words, its windows of up to WORDS consecutive words with a mark
where a space was, runs of single letters without their spaces, and overlapping pieces of very long words. Two strings are compared by
the three-symbol subsequences that they share, each weighted by LAMBDA to the power of the symbols between (within SPAN places), so an
insult with inserted or separated characters stays close to the plain one. Landmark strings give Nystroem features; a linear support
vector machine on them is trained on labelled sentences, each of which counts by one string: a clean one by its worst, a toxic one by the
string that tells it from clean texts. A sentence scores by its worst string and a text by its worst sentence, calibrated to a
probability on rows apart.

As the kernel is a product of subsequence counts, landmarks and weights fold into one table of subsequence weights, and as the strings of
a sentence are ranges of one array, prefix sums of that table's entries score all of them without any kernel evaluation.

Texts stay on the executors. Labelled rows that are copies of others count once; n-grams and strings are counted by Spark; the
driver gets counted strings of bounded number, and solves for LANDMARKS weights.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.llm.common import crc32_mod, cut, flat_utf8, mix, span_hashes, steps, words

#: Bound of the sample of labelled rows that the model is fitted on; one in APART of them serves for calibration alone.
SAMPLE_ROWS, APART = 5000, 4
LANDMARKS = 256
LAMBDA, SPAN = 0.6, 7
#: Letters of the shortest string that can be an insult (shorter ones have too few subsequences), words of a window, and letters of the
#: pieces that longer words are cut into, which overlap by half.
SHORTEST, WORDS, PIECE = 4, 3, 24
#: Rows with crc32(id as text) modulo FOLDS equal to HELD_OUT are never learned from.
FOLDS, HELD_OUT = 4, 2
THRESHOLD = 0.3
#: Strings that the machine is fitted on: of toxic sentences, of clean ones at first, and those added in each of MINING rounds.
POSITIVES, NEGATIVES, MINED, MINING = 4000, 6000, 750, 6
#: Lengths of the n-grams that label sentences, and documents that one must be in.
GRAMS, SUPPORT = (4, 6, 8), 5
#: Deviations by which what tells is commoner in toxic texts than by chance; there are some hundred thousand strings and n-grams to be mistaken about.
SIGNIFICANT = 7
#: Hashes of a row by which copies are known: rows that share one with an earlier row of the same label are left out of the fit.
FINGERPRINTS = 4
_FLOOR, _CEILING = -2.0, 1.0

#: Symbols of 6 bits: letters (look-alike digits with them), the mark before a word, and 32 kinds of bytes beyond ASCII; all else is passed over.
_MARK, _BITS = 31, 6
_SYMBOL = np.zeros(256, np.uint8)
_SYMBOL[97:123] = np.arange(1, 27)
_SYMBOL[65:91] = np.arange(1, 27)
_SYMBOL[128:] = 32 + np.arange(128) % 32
for _a, _b in zip(b"013457@", b"oieasta"):
    _SYMBOL[_a] = _SYMBOL[_b]
_ENDS = np.zeros(256, bool)
_ENDS[list(b".!?")] = True
#: What a string of n symbols is divided by: the length of its vector if no subsequence occurs twice.
_NORMS = np.sqrt(np.maximum(sum(LAMBDA ** (2 * (far - 2)) * (far - 1) * np.maximum(np.arange(4096) - far, 0) for far in range(2, SPAN + 1)), 1e-9))


@dataclass
class Strings:
    """Strings of some texts as ranges of one array of symbols, each word with a mark before it."""

    flat: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    words: np.ndarray  # words in each
    first: np.ndarray  # its first word, as an index into the words, which come first among the strings
    sentence: np.ndarray
    text: np.ndarray
    of_flat: np.ndarray  # the sentence of each symbol, -1 for those of runs of letters


def strings(buf: np.ndarray, offsets: np.ndarray) -> Strings:
    """The strings of all sentences. A sentence ends at a line break or after a word that ends with a full stop or the like."""
    starts, ends, first = words(buf, offsets)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    symbol = _SYMBOL[buf]
    at = np.flatnonzero(symbol)
    a, b = np.searchsorted(at, starts), np.searchsorted(at, ends)
    lines = np.r_[0, np.cumsum(buf == 10)]
    stop = (_ENDS[buf[ends[:-1] - 1]] | (lines[starts[1:]] > lines[ends[:-1]]) | (text[1:] != text[:-1])) if len(starts) else np.empty(0, bool)
    sentence = np.r_[0, np.cumsum(stop)] if len(starts) else np.empty(0, np.int64)
    solid = b > a
    a, b, text, sentence = a[solid], b[solid], text[solid], sentence[solid]
    n, k = len(a), np.arange(len(a))
    flat = np.full(len(at) + n, _MARK, np.uint8)
    flat[np.arange(len(at)) + np.repeat(k + 1, b - a)] = symbol[at]
    s, e = a + k, b + k + 1
    of_flat = np.repeat(sentence, e - s)
    out = [(s, e, np.ones(n, np.int64), k)]
    for m in range(2, WORDS + 1):
        i = np.flatnonzero(sentence[m - 1 :] == sentence[: n - m + 1]) if n >= m else np.empty(0, np.int64)
        out.append((s[i], e[i + m - 1], np.full(len(i), m), i))
    for w in np.flatnonzero(e - s - 1 > PIECE).tolist():
        p = np.arange(s[w] + 1, e[w] - PIECE // 2, PIECE // 2)
        out.append((p, np.minimum(p + PIECE, e[w]), np.zeros(len(p), np.int64), np.full(len(p), w)))
    one = b - a == 1
    edge = sentence[1:] != sentence[:-1]
    i, j = np.flatnonzero(one & ~np.r_[False, one[:-1] & ~edge][:n]), np.flatnonzero(one & ~np.r_[one[1:] & ~edge, False][:n])
    i, j = i[j - i >= SHORTEST - 1], j[j - i >= SHORTEST - 1]
    parts, base = [flat], len(flat)
    for x, y in zip(i.tolist(), j.tolist()):
        parts.append(np.r_[np.uint8(_MARK), flat[s[x : y + 1] + 1]])
        size = y - x + 2
        p = np.arange(base, max(base + 1, base + size - PIECE // 2), PIECE // 2)
        out.append((p, np.minimum(p + PIECE + 1, base + size), np.zeros(len(p), np.int64), np.full(len(p), x)))
        base += size
    flat = np.concatenate(parts)
    s, e, m, w = (np.concatenate(x) for x in zip(*out))
    return Strings(flat, s, e, m, w, sentence[w], text[w], np.r_[of_flat, np.full(len(flat) - len(of_flat), -1)])


def _codes(flat: np.ndarray) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(places to the third symbol, codes by the place of the second one) of the subsequences that begin at each place."""
    wide = flat.astype(np.int32)
    for far in range(2, SPAN + 1):
        outer = (wide[:-far] << 2 * _BITS) + wide[far:]
        yield far, [outer + (wide[near : len(wide) - far + near] << _BITS) for near in range(1, far)]


def _sparse(one: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(string, code, weight) of the subsequences of some strings, normed; only for training, where strings are few."""
    flat, size = np.frombuffer(b"".join(one), np.uint8), np.array([len(x) for x in one])
    owner = np.repeat(np.arange(len(one)), size)
    rows, codes, weights = [], [], []
    for far, by_second in _codes(flat):
        i = np.flatnonzero(owner[:-far] == owner[far:])
        for code in by_second:
            rows.append(owner[i])
            codes.append(code[i])
            weights.append(LAMBDA ** (far - 2) / _NORMS[np.minimum(size[owner[i]], len(_NORMS) - 1)])
    return np.concatenate(rows), np.concatenate(codes), np.concatenate(weights)


@dataclass
class Landmarks:
    """The subsequences of the landmarks, in order, and the landmarks' weights of each."""

    codes: np.ndarray
    features: np.ndarray

    @staticmethod
    def of(marks: list[bytes]) -> Landmarks:
        row, code, weight = _sparse(marks)
        codes, at = np.unique(code, return_inverse=True)
        features = np.zeros((len(marks), len(codes)), np.float32)
        np.add.at(features, (row, at), weight.astype(np.float32))
        return Landmarks(codes, features)

    def kernel(self, of: list[bytes]) -> np.ndarray:
        """The kernel of strings with the landmarks."""
        out = np.zeros((len(of), len(self.features)))
        for i in range(0, len(of), 500):
            row, code, weight = _sparse(of[i : i + 500])
            at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
            there = self.codes[at] == code
            x = np.bincount(row[there] * len(self.codes) + at[there], weight[there], len(of[i : i + 500]) * len(self.codes)).astype(np.float32)
            out[i : i + 500] = x.reshape(-1, len(self.codes)) @ self.features.T
        return out


@dataclass
class Model:
    """Weights of subsequences in units of 2**-40, so that sums don't depend on what is scored together."""

    table: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0

    def margins(self, of: Strings) -> np.ndarray:
        """The margin of each string."""
        sums, size = np.zeros(len(of.starts)), of.ends - of.starts
        for far, by_second in _codes(of.flat) if len(of.flat) > SPAN else ():
            before = np.r_[0, np.cumsum(sum(self.table[code] for code in by_second))]
            inside = np.flatnonzero(size > far)
            sums[inside] += LAMBDA ** (far - 2) * (before[of.ends[inside] - far] - before[of.starts[inside]])
        out = sums * 2.0**-40 / _NORMS[np.minimum(size, len(_NORMS) - 1)] + self.bias
        return np.where(size - np.maximum(of.words, 1) >= SHORTEST, np.maximum(out, _FLOOR), _FLOOR)

    def texts(self, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The largest margin in each text; a text without strings has the lowest."""
        of = strings(buf, offsets)
        out = np.full(len(offsets) - 1, _FLOOR)
        np.maximum.at(out, of.text, self.margins(of))
        return np.minimum(out, _CEILING)

    def scores(self, margins: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margins + self.shift, -30, 30)))


def _machine(x: np.ndarray, y: np.ndarray, weight: np.ndarray, cost: float = 1e-4) -> tuple[np.ndarray, float]:
    """A linear support vector machine with squared hinge loss, by Newton steps on the strings within the margin."""
    x = np.c_[x, np.ones(len(x))]
    w, pull = np.zeros(x.shape[1]), np.r_[np.full(x.shape[1] - 1, cost), 1e-9]

    def loss(w: np.ndarray) -> float:
        return float((weight * np.maximum(0, 1 - y * (x @ w)) ** 2).sum() + (pull * w * w).sum())

    now = loss(w)
    for _ in range(50):
        active = np.flatnonzero(y * (x @ w) < 1)
        a = x[active] * weight[active, None]
        target = np.linalg.solve(a.T @ x[active] + np.diag(pull), a.T @ y[active])
        step = 1.0
        while step > 1e-3 and loss(w + step * (target - w)) >= now:
            step /= 2
        if step <= 1e-3:
            break
        w = w + step * (target - w)
        now = loss(w)
    return w[:-1], w[-1]


def _of_strings(marks: list[bytes], chosen: list[bytes], label: np.ndarray, weight: np.ndarray) -> Model:
    """A machine on the Nystroem features of strings, folded into one table."""
    own = Landmarks.of(marks)
    values, vectors = np.linalg.eigh((own.features @ own.features.T).astype(np.float64))
    values, vectors = values[values > 1e-6], vectors[:, values > 1e-6]
    root = vectors / np.sqrt(values)
    every = own.kernel(chosen) @ root
    for side in (1, -1):
        weight = np.where(label == side, weight / (2 * weight[label == side].sum()), weight)
    w, bias = _machine(every, label, weight)
    table = np.zeros(1 << 3 * _BITS, np.int64)
    table[own.codes] = np.rint(own.features.T.astype(np.float64) @ (root @ w) * 2.0**40)
    return Model(table, float(bias))


# --- what Spark counts over the sample ------------------------------------------------------


def _each(rows: DataFrame, schema: str, names: list[str], run: Callable[[Strings, np.ndarray], list[pa.Array]]) -> DataFrame:
    """rows (toxic, text) through run(strings, labels of the texts), a step at a time."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic = np.asarray(batch.column(0))
            buf, offsets = flat_utf8(batch.column(1))
            for i, j in steps(offsets):
                yield pa.RecordBatch.from_arrays(run(strings(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]), toxic[i:j]), names=names)

    return rows.select("toxic", "text").mapInArrow(go, schema)


def _grams(of: Strings) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(n, codes, places) of the n-grams within sentences; the code of a place is that of the symbols from it on."""
    wide = of.flat.astype(np.int64)
    for n in GRAMS:
        m = len(wide) - n + 1
        if m > 0:
            code = np.zeros(m, np.int64)
            for k in range(n):
                code = (code << _BITS) + wide[k : k + m]
            at = np.flatnonzero((of.of_flat[:m] == of.of_flat[n - 1 :]) & (of.of_flat[:m] >= 0))
            yield n, code[at], at


def _whole(of: Strings) -> np.ndarray:
    return span_hashes(of.flat, of.starts, of.ends, lower=False).astype(np.int64)


def _found(of: Strings) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(kind, code, text) of n-grams (kind n) and of whole strings (kind 0), each once a text."""
    text_of = np.zeros(int(of.sentence.max(initial=0)) + 1, np.int64)
    text_of[of.sentence] = of.text
    every = [(n, code, text_of[of.of_flat[at]]) for n, code, at in _grams(of)] + [(0, _whole(of), of.text)]
    for kind, code, text in every:
        order = np.lexsort((text, code))
        code, text = code[order], text[order]
        new = np.r_[True, (code[1:] != code[:-1]) | (text[1:] != text[:-1])][: len(code)]
        yield kind, code[new], text[new]


def _document_counts(rows: DataFrame, only: dict[int, np.ndarray] | None = None) -> DataFrame:
    """(kind, code, n): in how many of the rows each n-gram and string is; with ``only``, sorted codes by kind, those alone."""

    def run(of: Strings, _: np.ndarray) -> list[pa.Array]:
        out = []
        for kind, code, _ in _found(of):
            if only is not None:
                known = only.get(kind, np.empty(0, np.int64))
                code = code[np.isin(code, known)]
            code, n = np.unique(code, return_counts=True)
            out.append((np.full(len(code), kind, np.int32), code, n.astype(np.int64)))
        return [pa.array(np.concatenate(x)) for x in zip(*out)]

    return _each(rows, "kind int, code long, n long", ["kind", "code", "n"], run).groupBy("kind", "code").agg(F.sum("n").alias("n"))


def telling(rows: DataFrame, n_toxic: int, n_clean: int) -> dict[int, np.ndarray]:
    """The n-grams and whole strings, by kind, that are far commoner in toxic rows than in clean ones."""
    some = _document_counts(rows.where("toxic = 1")).where(F.col("n") >= SUPPORT).toArrow()
    kind, code, hits = (np.asarray(some.column(c)) for c in ("kind", "code", "n"))
    only = {k: np.sort(code[kind == k]) for k in (0, *GRAMS)}
    clean = {(r.kind, r.code): r.n for r in _document_counts(rows.where("toxic = 0"), only).toLocalIterator()}
    both = hits + np.array([clean.get(x, 0) for x in zip(kind.tolist(), code.tolist())], np.int64)
    rate = n_toxic / (n_toxic + n_clean)
    z = (hits - both * rate) / np.sqrt(np.maximum(both * rate * (1 - rate), 1e-9))
    says = (hits >= 0.85 * both) & (z > SIGNIFICANT)
    return {k: np.sort(code[says & (kind == k)]) for k in (0, *GRAMS)}


def _marked(of: Strings, tells: dict[int, np.ndarray]) -> np.ndarray:
    """Whether a string tells, by itself or by an n-gram; a window of words only by what none of its words has."""
    out = np.isin(_whole(of), tells[0])
    for n, code, at in _grams(of):
        here = np.zeros(len(of.flat) + 1, np.int64)
        here[at[np.isin(code, tells[n])] + 1] = 1
        before = np.cumsum(here)
        out |= (of.ends - of.starts >= n) & (before[np.maximum(of.ends - n + 1, of.starts)] > before[of.starts])
    single = np.r_[0, np.cumsum(out[: int(np.count_nonzero(of.words == 1))])]
    many = of.words > 1
    out[many] &= single[of.first[many] + of.words[many]] == single[of.first[many]]
    return out & (of.ends - of.starts - np.maximum(of.words, 1) >= SHORTEST)


def _pieces(of: Strings, at: np.ndarray) -> pa.Array:
    return pa.array([of.flat[a:b].tobytes() for a, b in zip(of.starts[at].tolist(), of.ends[at].tolist())], pa.binary())


def labelled_strings(rows: DataFrame, tells: dict[int, np.ndarray]) -> DataFrame:
    """(s, bad, clean): strings that tell, and one in 16 of those of clean rows, with the number of sentences of either kind they are in."""

    def run(of: Strings, toxic: np.ndarray) -> list[pa.Array]:
        bad = toxic[of.text] == 1 if len(of.text) else np.empty(0, bool)
        enough = of.ends - of.starts - np.maximum(of.words, 1) >= SHORTEST
        at = np.flatnonzero(_marked(of, tells) | (~bad & enough & (mix(_whole(of).view(np.uint64)) >> np.uint64(60) == 0)))
        return [_pieces(of, at), pa.array(bad[at].astype(np.int64)), pa.array((~bad[at]).astype(np.int64))]

    return _each(rows, "s binary, bad long, clean long", ["s", "bad", "clean"], run).groupBy("s").agg(F.sum("bad").alias("bad"), F.sum("clean").alias("clean"))


def worst_strings(rows: DataFrame, model: Model) -> DataFrame:
    """(s, margin, n): the worst strings of the sentences of clean rows, with the number of sentences, the worst MINED in all."""

    def run(of: Strings, _: np.ndarray) -> list[pa.Array]:
        margin = model.margins(of)
        order = np.lexsort((-margin, of.sentence))
        at = order[np.r_[True, of.sentence[order][1:] != of.sentence[order][:-1]][: len(order)]]
        at = at[np.argsort(-margin[at], kind="stable")][: 4 * MINED]
        return [_pieces(of, at), pa.array(margin[at])]

    found = _each(rows.where("toxic = 0"), "s binary, margin double", ["s", "margin"], run)
    return found.groupBy("s").agg(F.max("margin").alias("margin"), F.count("*").alias("n")).orderBy(F.desc("margin"), "s").limit(MINED)


# --- the fit --------------------------------------------------------------------------------


def sample(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """(id, toxic, text): at most SAMPLE_ROWS labelled rows, chosen by hashes, none of them held out, each text once, copies left out."""
    ids = labels.select(F.col(key).alias("key"), F.col(label).alias("toxic")).where(F.col("key").isNotNull() & F.col("toxic").isin(0, 1) & (crc32_mod("key", FOLDS) != HELD_OUT))
    ids = ids.groupBy("key").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("key"), "key").limit(SAMPLE_ROWS)
    rows = df.select(F.col(key).alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text")).join(F.broadcast(ids), "key")
    rows = rows.groupBy("text").agg(F.max("toxic").cast("int").alias("toxic"))
    rows = rows.orderBy(F.xxhash64("text"), "text").limit(SAMPLE_ROWS).repartition(max(2, df.sparkSession.sparkContext.defaultParallelism), "text")

    def fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = flat_utf8(batch.column(1))
            out = []
            for i, j in steps(offsets):
                part = buf[offsets[i] : offsets[j]]
                a, b, first = words(part, offsets[i : j + 1] - offsets[i])
                h = span_hashes(part, a, b)
                text_of = np.repeat(np.arange(j - i), np.diff(first))
                at = np.flatnonzero(text_of[2:] == text_of[:-2]) if len(h) > 2 else np.empty(0, np.int64)
                h = mix(h[at] * np.uint64(3) + mix(h[at + 1] * np.uint64(5) + mix(h[at + 2]))) if len(at) else np.empty(0, np.uint64)
                for k in range(FINGERPRINTS):
                    least = np.full(j - i, (1 << 63) - 1, np.int64)
                    np.minimum.at(least, text_of[at], (mix(h + np.uint64(k + 1)) >> np.uint64(1)).astype(np.int64))
                    out.append((i, k, least))
            columns = [np.concatenate([x for _, m, x in out if m == k]) if out else np.empty(0, np.int64) for k in range(FINGERPRINTS)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *map(pa.array, columns)], names=["toxic", "text", *[f"f{k}" for k in range(FINGERPRINTS)]])

    prints = ", ".join(f"f{k} long" for k in range(FINGERPRINTS))
    rows = cut(rows.select("toxic", "text").mapInArrow(fingerprints, f"toxic int, text string, {prints}").withColumn("id", F.xxhash64("text")))
    each = rows.select("id", "toxic", F.posexplode(F.array(*[f"f{k}" for k in range(FINGERPRINTS)])).alias("k", "f")).where(F.col("f") < (1 << 63) - 1)
    first = each.groupBy("toxic", "k", "f").agg(F.min("id").alias("first"))
    copies = each.join(first, ["toxic", "k", "f"]).where("id > first").select("id").distinct()
    return cut(rows.join(copies, "id", "left_anti").select("id", "toxic", "text"))


def fit(rows: DataFrame) -> Model | None:
    """A model from sample(); None if either label is missing or nothing tells them apart."""
    apart = F.pmod(F.xxhash64("id"), F.lit(APART)) == 0
    learn = rows.where(~apart)
    sizes = {r.toxic: r.n for r in learn.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return None
    tells = telling(learn, sizes[1], sizes[0])
    if not any(len(x) for x in tells.values()):
        return None
    counted = cut(labelled_strings(learn, tells))
    positive = {bytes(r.s): r.bad for r in counted.where("bad > 0 and clean <= 0.1 * bad").orderBy(F.desc("bad"), "s").limit(POSITIVES).collect()}
    negative = {bytes(r.s): r.clean for r in counted.where("clean > 0.1 * bad").orderBy(F.expr("bad > 0").desc(), F.xxhash64("s"), "s").limit(NEGATIVES).collect()}
    if not positive or not negative:
        return None
    marks = list(positive)[: LANDMARKS // 3] + sorted(negative, key=lambda s: (-negative[s], s))[: LANDMARKS // 3]
    wrong: dict[bytes, int] = {}
    for mined in range(MINING + 1):
        chosen = [*positive, *negative]
        weight = np.r_[np.sqrt(list(positive.values())), np.sqrt(list(negative.values())) * [4 if s in wrong else 1 for s in negative]]
        model = _of_strings(marks, chosen, np.r_[np.ones(len(positive)), -np.ones(len(negative))], weight)
        if mined < MINING:
            worst = [(bytes(r.s), r.n) for r in worst_strings(learn, model).collect()]
            wrong = {s: n for s, n in worst if s not in positive}
            negative |= {s: negative.get(s, n) for s, n in wrong.items()}
            marks += [s for s in wrong if s not in set(marks)][: LANDMARKS // (3 * MINING) + 1]
    own = rows.where(apart).select("toxic", "text").mapInArrow(_margins(model), "toxic int, margin double").collect()
    m, t = np.array([r.margin for r in own]), np.array([r.toxic for r in own])
    a = np.zeros(2)  # Platt's calibration, by Newton steps, with a small pull towards 0
    x = np.stack([m, np.ones(len(m))], 1)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ a, -30, 30)))
        hessian = (x * (p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(2)
        a -= np.linalg.solve(hessian, x.T @ (p - t) + 0.05 * a)
    model.slope, model.shift = float(a[0]), float(a[1])
    return model


def _margins(model: Model) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = flat_utf8(batch.column(1))
            margins = [np.empty(0), *(model.texts(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]) for i, j in steps(offsets))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(margins))], names=["toxic", "margin"])

    return run


def train(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Model | None:
    return fit(sample(df, labels, key, text, label))


def toxicity(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, held_out, score, predicted), one row per row of df.

    score: probability that the text is labelled toxic, by its worst string; predicted: 1 from THRESHOLD on. A null or
    empty text scores as one without strings. If the labels known hold only one kind or tell nothing, every score is 0.
    A very long text is scored whole, in a step of its own. Rows that are equal score alike; an id with several labels counts
    as toxic if one says so, and one with several texts gives each its label. Columns of df besides key and text aren't read.
    """
    model = train(df, labels, key, text)
    sent = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = flat_utf8(batch.column(1))
            scores = [np.empty(0)]
            for i, j in steps(offsets):
                if sent.value is None:
                    scores.append(np.zeros(j - i))
                else:
                    scores.append(sent.value.scores(sent.value.texts(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])))
            score = np.concatenate(scores)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))], names=[key, "held_out", "score", "predicted"])

    rows = df.select(key, text, (crc32_mod(key, FOLDS) == HELD_OUT).alias("held_out"))
    return rows.mapInArrow(run, f"{key} {df.schema[key].dataType.simpleString()}, held_out boolean, score double, predicted int")


def without_toxic(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of df whose text isn't predicted toxic, with df's columns, whatever their names."""
    model = train(df, labels, key, text)
    sent, place = df.sparkSession.sparkContext.broadcast(model), df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = flat_utf8(batch.column(place))
            for i, j in steps(offsets):
                if sent.value is None:
                    yield batch.slice(i, j - i)
                else:
                    score = sent.value.scores(sent.value.texts(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]))
                    yield batch.slice(i, j - i).filter(pa.array(score < THRESHOLD))

    return df.mapInArrow(run, df.schema)
