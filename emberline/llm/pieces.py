"""SentencePiece encoding and decoding by vectorised merge rounds (operator 10).

A model of the BPE kind with byte fallback is read from its public file. Texts are cut into
words (white space belongs to the word it precedes; no piece of the vocabulary crosses such a cut),
and all distinct new words of a batch are merged together: one flat array of symbols, in each
round the best pair of each word (a segmented minimum over pair ranks), all its leftmost
occurrences joined at once, then compaction. A word leaves the arrays when no pair remains.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from emberline.llm.common import distinct_spans, flat_utf8, steps

#: Distinct words that a task remembers before it starts anew; bounds its memory.
REMEMBERED = 400_000
#: Bytes of text whose words are looked up, and new ones merged, together.
BATCH_BYTES = 3_000_000
_NONE = np.int64(1 << 40)


class PieceModel:
    """Encoder and decoder over the pieces of a model file."""

    def __init__(self, model_file: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = sp.get_piece_size()
        self.bos, self.eos = sp.bos_id(), sp.eos_id()
        self.text: list[bytes] = [b""] * n
        ids: dict[str, int] = {}
        self.bytes = np.zeros(256, np.int64)
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
                self.text[i] = bytes([int(piece[3:5], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                ids[piece] = i
                self.text[i] = piece.replace("▁", " ").encode()
        if any("▁" in p.lstrip("▁") for p in ids):
            raise ValueError("pieces that span words are not supported")
        self.char = np.full(0x110000, -1, np.int64)
        for piece, i in ids.items():
            if len(piece) == 1:
                self.char[ord(piece)] = i
        self.blob = np.frombuffer(b"".join(self.text), np.uint8)
        self.size = np.array([len(x) for x in self.text], np.int64)
        self.place = np.cumsum(self.size) - self.size
        scores = np.array([sp.get_score(i) for i in range(n)])
        self.rank = np.unique(-scores, return_inverse=True)[1].astype(np.int64)
        pairs = {}
        for piece, i in ids.items():
            for k in range(1, len(piece)):
                left, right = ids.get(piece[:k]), ids.get(piece[k:])
                if left is not None and right is not None:
                    pairs[left * n + right] = i
        self.n = n
        keys = np.array(sorted(pairs), np.int64)
        merged = np.array([pairs[int(k)] for k in keys], np.int64)
        self._bits = max(18, int(len(keys) * 4).bit_length())
        self._keys = np.full(1 << self._bits, -1, np.int64)
        self._merged = np.full(1 << self._bits, -1, np.int64)
        left = np.arange(len(keys))
        slot = self._slot(keys)
        while len(left):  # linear probing, one step for all keys at a time
            free = self._keys[slot] == -1
            self._keys[slot[free]] = keys[left[free]]
            done = self._keys[slot] == keys[left]
            self._merged[slot[done]] = merged[left[done]]
            left, slot = left[~done], (slot[~done] + 1) & ((1 << self._bits) - 1)
        self._forget()

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self._bits)).astype(np.int64)

    def _join(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The id of the piece that two symbols make together, -1 if there is none."""
        keys = left * self.n + right
        slot = self._slot(keys)
        out = np.full(len(keys), -1, np.int64)
        open_ = np.arange(len(keys))
        while len(open_):
            there = self._keys[slot]
            hit = there == keys[open_]
            out[open_[hit]] = self._merged[slot[hit]]
            more = ~hit & (there != -1)
            open_, slot = open_[more], (slot[more] + 1) & ((1 << self._bits) - 1)
        return out

    def merge(self, words: list[str], one_at_a_time: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, one after the other, and the n + 1 places where each word's ids begin."""
        code = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        word = np.repeat(np.arange(len(words)), np.fromiter(map(len, words), np.int64, len(words)))
        sym = self.char[code]
        if (rare := np.flatnonzero(sym < 0)).size:  # characters without a piece of their own become bytes
            raw = [self.bytes[np.frombuffer(chr(c).encode("utf-8", "replace"), np.uint8)] for c in code[rare].tolist()]
            sizes = np.ones(len(sym), np.int64)
            sizes[rare] = [len(x) for x in raw]
            word = np.repeat(word, sizes)
            starts = np.cumsum(sizes) - sizes
            wide = np.repeat(sym, sizes)
            wide[np.repeat(starts[rare] - np.r_[0, np.cumsum(sizes[rare])[:-1]], sizes[rare]) + np.arange(sizes[rare].sum())] = np.concatenate(raw)
            sym = wide
        out_sym, out_word, again = [], [], []
        while len(sym):
            rank = np.full(len(sym), _NONE)
            inside = np.flatnonzero(word[1:] == word[:-1])
            made = self._join(sym[inside], sym[inside + 1])
            rank[inside] = np.where(made >= 0, self.rank[made], _NONE)
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            best = np.minimum.reduceat(rank, first)
            was = np.repeat(best, np.diff(np.r_[first, len(sym)]))
            over = was == _NONE
            if over.any():
                out_sym.append(sym[over])
                out_word.append(word[over])
            chosen = (rank == was) & ~over
            at = np.flatnonzero(chosen)
            if one_at_a_time:
                at = at[np.r_[True, word[at[1:]] != word[at[:-1]]]] if len(at) else at
            elif len(at):  # of overlapping occurrences every second one goes, from the left
                start = np.r_[True, np.diff(at) != 1]
                run = np.cumsum(start) - 1
                at = at[(np.arange(len(at)) - np.flatnonzero(start)[run]) % 2 == 0]
            sym[at] = made[np.searchsorted(inside, at)]
            keep = ~over
            keep[at + 1] = False
            if not one_at_a_time and len(at):  # a pair made just now that ranks above those joined: the word is done anew in strict order
                new = np.zeros(len(sym), bool)
                new[at] = True
                s2, w2, n2, r2 = sym[keep], word[keep], new[keep], was[keep]
                beside = np.flatnonzero((w2[1:] == w2[:-1]) & (n2[1:] | n2[:-1]))
                m2 = self._join(s2[beside], s2[beside + 1])
                bad = (m2 >= 0) & (self.rank[m2] <= r2[beside])
                if bad.any():
                    lost = np.unique(w2[beside[bad]])
                    again.append(lost)
                    keep &= ~np.isin(word, lost)
            sym, word = sym[keep], word[keep]
        if again:
            lost = np.concatenate(again)
            ids, at = self.merge([words[k] for k in lost.tolist()], True)
            out_sym.append(ids)
            out_word.append(np.repeat(lost, np.diff(at)))
        flat, owner = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (out_sym, out_word))
        order = np.argsort(owner, kind="stable")
        return flat[order], np.searchsorted(owner[order], np.arange(len(words) + 1))

    def _spans(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of each word lie in self.known_ids: first place and number. Words not met before are merged now; words are known by their bytes."""
        at, each = distinct_spans(buf, starts, ends)
        raw = buf.tobytes()
        distinct = [raw[i:j] for i, j in zip(starts[at].tolist(), ends[at].tolist())]
        new = [w for w in distinct if w not in self.known]
        if len(self.known) + len(new) > REMEMBERED:
            self._forget()
            new = distinct
        if new:
            ids, begin = self.merge([w.decode("utf-8", "replace").replace(" ", "▁") for w in new])
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new))))
            self.known_first = np.concatenate([self.known_first, begin[:-1] + len(self.known_ids)])
            self.known_size = np.concatenate([self.known_size, np.diff(begin)])
            self.known_ids = np.concatenate([self.known_ids, ids.astype(np.int32)])
        place = np.fromiter(map(self.known.__getitem__, distinct), np.int64, len(distinct))[each]
        return self.known_first[place], self.known_size[place]

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.known_first = self.known_size = np.empty(0, np.int64)
        self.known_ids = np.empty(0, np.int32)

    def encode(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For runs of texts in their order: all ids, with begin and end ids, and the n + 1 places where each text's ids begin."""
        texts = pc.fill_null(texts, "")
        for i, j in steps(flat_utf8(texts)[1], BATCH_BYTES):
            part = pc.binary_join_element_wise("", pc.replace_substring(texts.slice(i, j - i), "▁", " "), " ")
            buf, at = flat_utf8(part)
            blank = buf == 32
            begins = blank.copy()
            begins[1:] &= ~blank[:-1]
            begins[at[:-1]] = True
            starts = np.flatnonzero(begins)
            ends = np.r_[starts[1:], len(buf)]
            doc = np.searchsorted(at, starts, "right") - 1
            real = np.diff(at)[doc] > 1  # an empty text has no word, not even the mark before it
            starts, ends, doc = starts[real], ends[real], doc[real]
            first, size = self._spans(buf, starts, ends)
            total = np.bincount(doc, size, j - i).astype(np.int64) + 2
            out_at = np.r_[0, np.cumsum(total)]
            ids = np.empty(out_at[-1], np.int32)
            ids[out_at[:-1]], ids[out_at[1:] - 1] = self.bos, self.eos
            middle = np.ones(len(ids), bool)
            middle[out_at[:-1]] = middle[out_at[1:] - 1] = False
            before = np.cumsum(size) - size
            ids[middle] = self.known_ids[np.repeat(first - before, size) + np.arange(size.sum())]
            yield ids, out_at

    def decode(self, ids: np.ndarray, at: np.ndarray) -> list[bytes]:
        """The text of each run of ids at[k]:at[k + 1], in UTF-8: what the pieces say, without the mark that encoding puts first."""
        size = self.size[ids]
        begin = np.r_[0, np.cumsum(size)]
        raw = self.blob[np.repeat(self.place[ids] - begin[:-1], size) + np.arange(begin[-1])].tobytes()
        return [raw[i + 1 : j] for i, j in zip(begin[at[:-1]].tolist(), begin[at[1:]].tolist())]


_models: dict[str, PieceModel] = {}


def model_of(model_file: str) -> PieceModel:
    """The model, read once in each Python worker; it keeps the words that it knows from task to task."""
    if model_file not in _models:
        _models[model_file] = PieceModel(model_file)
    return _models[model_file]


def encode(df: DataFrame, model_file: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """df with the ids of each whole text (array of int) and the text decoded from them.

    A null text counts as empty: begin and end ids alone, decoded as an empty text. All columns of df stay;
    columns named as the two new ones are replaced. Ids are exactly those of the sentencepiece library without sampling. A very long text is
    encoded whole, a step of its own; rows that are equal have equal ids; an empty table stays empty.
    """
    df = df.drop(ids, decoded)
    place = df.columns.index(text)
    schema = T.StructType([*df.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType())), T.StructField(decoded, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of(model_file)
        for batch in batches:
            done = 0
            for got, at in model.encode(batch.column(place)):
                said = pa.array([x.decode("utf-8", "replace") for x in model.decode(got, at)], pa.string())
                part = batch.slice(done, len(said))
                done += len(said)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(got)), said], names=schema.names)

    return df.mapInArrow(run, schema)


def encode_digests(df: DataFrame, model_file: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_tokens, ids_sha256 and decoded_sha256: the digests of what encode() gives, made where the ids are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of(model_file)
        for batch in batches:
            done = 0
            for got, at in model.encode(batch.column(1)):
                raw, n, ends = got.astype("<u4").tobytes(), np.diff(at), (at * 4).tolist()
                i = [hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(ends, ends[1:])]
                d = [hashlib.sha256(x).hexdigest() for x in model.decode(got, at)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(done, len(n)), pa.array(n, pa.int64()), pa.array(i, pa.string()), pa.array(d, pa.string())], names=[key, "n_tokens", "ids_sha256", "decoded_sha256"])
                done += len(n)

    return df.select(key, text).mapInArrow(run, f"{key} {df.schema[key].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
