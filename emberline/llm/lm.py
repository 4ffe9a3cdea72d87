"""Language-model scores by deleted interpolation (operator 7).

The model mixes maximum-likelihood estimates of the pair (previous token, token), of the token alone and
of a uniform token. The mixture weights depend on how often the context was seen (buckets by powers of
two) and are learned by expectation-maximisation: one share of the training documents, DELETED, is
predicted from the counts of the others. The final estimates use all training counts.

Texts never shuffle by themselves: each task packs the documents that it reads into blocks of bounded bytes, compressed, which are
written once. A block asks once for every distinct token and pair that it holds, as sorted, difference-coded 64-bit hashes by
ranges of the hash, with its own counts; a range's task adds the counts up and answers each block in the order of its question. So counts
are summed before they are shuffled, a frequent token is one entry a block, equal documents are as good as any others, and no count table
is sent to every task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.llm.common import crc32_mod, cut, flat_utf8, mix, span_hashes, steps, words

#: Bytes of text of a block (a longer text is a block of its own), and blocks for each range of hashes.
BLOCK_BYTES, BLOCKS_A_RANGE = 4_000_000, 3
#: Training documents are those whose crc32 modulo FOLDS isn't HELD_OUT; those at DELETED serve to learn the weights.
FOLDS, HELD_OUT, DELETED = 7, 2, 3
#: Context-frequency buckets: the bit length of the context's count, up to this.
BUCKETS = 24
#: Steps, in parts of a power of 2, of the two estimates in the table that the weights are learned from: they are within 4.5 % and 9 % of
#: what they stand for. Scores use the exact estimates.
STEP_2, STEP_1 = 8, 4
ROUNDS = 60
END, BEGIN = np.uint64(0x1B873593CC9E2D51), np.uint64(0x85EBCA6BC2B2AE35)
WORD, PAIR = 0, 1


def _packed(values: np.ndarray) -> bytes:
    """Unsigned integers, byte by byte of their places, so that the zero bytes stand together."""
    values = values.astype(np.uint64)
    width = max(1, (int(values.max()).bit_length() + 7) // 8) if len(values) else 1
    return bytes([width]) + values.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    width = raw[0]
    n = (len(raw) - 1) // width
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(raw, np.uint8, n * width, 1).reshape(width, n).T
    return out.view(np.uint64).ravel()


class _Block:
    """Tokens and pairs of a block of documents, as indices into their sorted distinct hashes."""

    def __init__(self, row: dict):
        offsets = np.r_[0, np.cumsum(row["sizes"])].astype(np.int64)
        buf = np.frombuffer(pa.decompress(row["body"], int(offsets[-1]), "zstd") if offsets[-1] else b"", np.uint8)
        self.fold = np.array(row["folds"])
        parts, counts = [], []
        for i, j in steps(offsets):
            part = buf[offsets[i] : offsets[j]]
            starts, ends, first = words(part, offsets[i : j + 1] - offsets[i])
            parts.append(span_hashes(part, starts, ends))
            counts.append(np.diff(first))
        self.n = np.concatenate(counts) + 1
        stop = np.cumsum(self.n) - 1
        token = np.full(int(self.n.sum()), END)
        inner = np.ones(len(token), bool)
        inner[stop] = False
        token[inner] = np.concatenate(parts)
        before = np.r_[BEGIN, token[:-1]]
        before[np.r_[0, stop[:-1] + 1]] = BEGIN
        self.doc = np.repeat(np.arange(len(self.n)), self.n)
        self.words, self.word = np.unique(token, return_inverse=True)
        self.pairs, self.pair = np.unique(mix(before * np.uint64(0xD1342543DE82EF95) + token), return_inverse=True)
        self.context = np.r_[0, self.word[:-1]]
        self.context[np.r_[0, stop[:-1] + 1]] = np.searchsorted(self.words, END)  # as many beginnings as ends


def _ranges(hashes: np.ndarray, n: int) -> np.ndarray:
    """Where the hashes of each of n equal ranges begin (n + 1)."""
    return np.searchsorted((hashes >> np.uint64(32)) * np.uint64(n) >> np.uint64(32), np.arange(n + 1))


def _blocks(df: DataFrame, key: str, text: str) -> DataFrame:
    """(block, keys, folds, sizes, body): documents of a task in the order they come, packed; the deleted ones have blocks of their own, of odd numbers."""
    kind = df.schema[key].dataType
    names = ["block", "keys", "folds", "sizes", "body"]

    def packed(block: int, deleted: bool, parts: list[tuple]) -> pa.RecordBatch:
        keys = pa.concat_arrays([p[0] for p in parts])
        folds, sizes = (np.concatenate([p[k] for p in parts]).astype(np.int32) for k in (1, 2))
        one = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (keys, pa.array(folds), pa.array(sizes))]
        return pa.RecordBatch.from_arrays([pa.array([2 * block + deleted], pa.int64()), *one, pa.array([pa.compress(b"".join(p[3] for p in parts), "zstd", asbytes=True)], pa.binary())], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, waiting, held = TaskContext.get().partitionId() << 32, {False: [], True: []}, {False: 0, True: 0}
        for batch in batches:
            every = np.asarray(batch.column(2))
            for deleted in (False, True):
                mine = batch.filter(pa.array((every == DELETED) == deleted))
                buf, offsets = flat_utf8(mine.column(1))
                folds = np.asarray(mine.column(2))
                for i, j in steps(offsets, BLOCK_BYTES // 4):
                    waiting[deleted].append((mine.column(0).slice(i, j - i), folds[i:j], np.diff(offsets[i : j + 1]), buf[offsets[i] : offsets[j]].tobytes()))
                    held[deleted] += int(offsets[j] - offsets[i])
                    if held[deleted] >= BLOCK_BYTES:
                        yield packed(block, deleted, waiting[deleted])
                        block, waiting[deleted], held[deleted] = block + 1, [], 0
        for deleted, parts in waiting.items():
            if parts:
                yield packed(block, deleted, parts)
                block += 1

    rows = df.select(key, text, crc32_mod(key, FOLDS).cast("int").alias("fold"))
    return rows.mapInArrow(run, f"block long, keys array<{kind.simpleString()}>, folds array<int>, sizes array<int>, body binary")


def _answers(blocks: DataFrame, n_ranges: int) -> DataFrame:
    """(block, kind, range, kept, deleted, tokens, distinct): per block, the training counts of what it asked for, of the documents kept and deleted.

    A row of block -1 has the number of training tokens and of distinct ones, of the kept and of all documents.
    """

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (r for batch in batches for k in range(len(batch)) for r in batch.slice(k, 1).to_pylist()):
            block = _Block(row)
            kept, deleted = (block.fold != HELD_OUT) & (block.fold != DELETED), block.fold == DELETED
            rows = []
            for kind, hashes, each in ((WORD, block.words, block.word), (PAIR, block.pairs, block.pair)):
                a, b = (np.bincount(each, side[block.doc], len(hashes)).astype(np.uint64) for side in (kept, deleted))
                at = _ranges(hashes, n_ranges).tolist()
                for k, (i, j) in enumerate(zip(at, at[1:])):
                    if j > i:
                        h = hashes[i:j]
                        rows.append((kind, k, row["block"], int(h[0]).to_bytes(8, "little"), _packed(np.diff(h)), _packed(a[i:j]), _packed(b[i:j])))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], names=names)

    types, names = (pa.int32(), pa.int32(), pa.int64(), *[pa.binary()] * 4), ["kind", "range", "block", "first", "steps", "kept", "deleted"]

    def answer(table: pa.Table) -> pa.Table:
        kind, k = table.column("kind")[0].as_py(), table.column("range")[0].as_py()
        own = [np.cumsum(np.r_[np.frombuffer(f, "<u8"), _unpacked(s) if len(s) > 1 else np.empty(0, np.uint64)], dtype=np.uint64) for f, s in zip(table.column("first").to_pylist(), table.column("steps").to_pylist())]
        one, each = np.unique(np.concatenate(own), return_inverse=True)
        sums = [np.bincount(each, np.concatenate([_unpacked(x) for x in table.column(c).to_pylist()]).astype(np.float64)).astype(np.uint64) for c in ("kept", "deleted")]
        at = np.cumsum([0, *map(len, own)]).tolist()
        rows = [(b, kind, k, _packed(sums[0][each[i:j]]), _packed(sums[1][each[i:j]]), None) for b, i, j in zip(table.column("block").to_pylist(), at, at[1:])]
        if kind == WORD:
            total = sums[0] + sums[1]
            rows.append((-1, kind, k, None, None, [int(sums[0].sum()), int(np.count_nonzero(sums[0])), int(total.sum()), int(np.count_nonzero(total))]))
        return pa.table([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int64())))], names=["block", "kind", "range", "kept", "deleted", "totals"])

    asked = blocks.select("block", "folds", "sizes", "body").mapInArrow(ask, "kind int, range int, block long, first binary, steps binary, kept binary, deleted binary")
    return cut(asked.groupBy("kind", "range").applyInArrow(answer, "block long, kind int, range int, kept binary, deleted binary, totals array<long>"))


def _counts(answers: pa.Table) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """((words' kept, deleted), (pairs' kept, deleted)) counts, in the order of the block's sorted hashes."""
    kind, order = np.asarray(answers.column("kind")), np.asarray(answers.column("range"))
    out = []
    for k in (WORD, PAIR):
        rows = np.flatnonzero(kind == k)
        rows = rows[np.argsort(order[rows])]
        out.append(tuple(np.concatenate([_unpacked(answers.column(c)[i].as_py()) for i in rows.tolist()]).astype(np.float64) for c in ("kept", "deleted")))
    return out[0], out[1]


def _bucket(count: np.ndarray) -> np.ndarray:
    return np.minimum(np.frexp(count)[1], BUCKETS - 1)


def _weights(table: list[tuple[int, int, int, int]], uniform: float) -> np.ndarray:
    """Mixture weights (pair, token, uniform) of each bucket, by expectation-maximisation over counted estimates."""
    weights = np.tile([0.4, 0.4, 0.2], (BUCKETS, 1))
    if not table:
        return weights
    bucket, two, one, n = (np.array(x) for x in zip(*table))
    f = np.stack([np.where(two < 0, 0, 2.0 ** (-two / STEP_2)), np.where(one < 0, 0, 2.0 ** (-one / STEP_1)), np.full(len(n), uniform)], 1)
    for _ in range(ROUNDS):
        share = weights[bucket] * f
        share *= (n / share.sum(1))[:, None]
        for k in range(3):
            weights[:, k] = np.bincount(bucket, share[:, k], BUCKETS) + np.array([0, 1e-3, 1e-3])[k]
        weights /= weights.sum(1, keepdims=True)
    return weights


def score(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, held_out, n_tokens, n_known, train_tokens, base_score, score), one row per document.

    Tokens are words between ASCII white space, A-Z lower-cased, then one end. A null or empty text has the end alone.
    base_score: sum of log10((c + 1) / (N + V + 1)) with the training counts c; score: log10 of the mixture's probability of
    the text. Every row is scored; rows that are equal are scored alike, a very long text whole. Without training documents score
    equals that of a uniform token. Counts are over all training documents. Columns of df besides key and text aren't read.
    """
    blocks = cut(_blocks(df, key, text))
    n_ranges = max(1, -(-blocks.count() // BLOCKS_A_RANGE))
    answers = _answers(blocks, n_ranges)
    totals = answers.where("block = -1").agg(*[F.sum(F.col("totals")[k]) for k in range(4)]).first()
    kept_n, kept_v, all_n, all_v = (t or 0 for t in totals)
    own = answers.where("block >= 0").select("block", "kind", "range", "kept", "deleted")

    def estimates(block: _Block, word: np.ndarray, pair: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Per token: the context's count, and the estimates from the pair and from the token."""
        context = word[block.context]
        return context, pair[block.pair] / np.maximum(context, 1), word[block.word] / max(n, 1)

    def tally(docs: pa.Table, answered: pa.Table) -> pa.Table:
        """Counts the tokens of a block of deleted documents by bucket and by the logarithms of their estimates from the kept ones."""
        block = _Block(docs.drop_columns("keys").to_pylist()[0])
        (word, _), (pair, _) = _counts(answered)
        context, two, one = estimates(block, word, pair, kept_n)
        with np.errstate(divide="ignore"):
            cells = [_bucket(context), *(np.where(f > 0, np.rint(-np.log2(f) * s), -1) for f, s in ((two, STEP_2), (one, STEP_1)))]
        cells, n = np.unique(np.stack(cells, 1).astype(np.int32), axis=0, return_counts=True)
        return pa.table([*(pa.array(cells[:, k]) for k in range(3)), pa.array(n.astype(np.int64))], names=["bucket", "two", "one", "n"])

    def together(rows: str):
        return blocks.where(rows).groupBy("block").cogroup(own.where(rows).groupBy("block"))

    counted = together("block % 2 = 1").applyInArrow(tally, "bucket int, two int, one int, n long").groupBy("bucket", "two", "one").agg(F.sum("n"))
    weights = _weights([tuple(r) for r in counted.collect()], 1 / (kept_v + 1)) if all_n else np.tile([0.0, 0.0, 1.0], (BUCKETS, 1))

    def marks(docs: pa.Table, answered: pa.Table) -> pa.Table:
        block, keys = _Block(docs.drop_columns("keys").to_pylist()[0]), docs.column("keys").combine_chunks().flatten()
        (wa, wb), (pa_, pb) = _counts(answered)
        word, pair = wa + wb, pa_ + pb
        context, two, one = estimates(block, word, pair, all_n)
        w = weights[_bucket(context)]
        p = np.log10(w[:, 0] * two + w[:, 1] * one + w[:, 2] / (all_v + 1))
        count = word[block.word]
        base = np.log10((count + 1) / (all_n + all_v + 1))
        n = len(block.n)
        sums = [np.bincount(block.doc, x, n) for x in (base, p)]
        known = np.bincount(block.doc, count > 0, n).astype(np.int64)
        return pa.table([keys, pa.array(block.fold == HELD_OUT), pa.array(block.n), pa.array(known), pa.array(np.full(n, all_n, np.int64)), *map(pa.array, sums)], names=[key, "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    kind = df.schema[key].dataType.simpleString()
    return together("true").applyInArrow(marks, f"{key} {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
