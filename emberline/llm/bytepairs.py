"""Byte-level BPE encoding and decoding by segment trees over pair ranks (operator 12).

A text is cut into words by the vocabulary's pattern, and a word's bytes are its first symbols. The leaves of a segment tree hold the ranks of adjacent pairs with their places, so
the root is the leftmost of the pairs of lowest rank: it is merged, three leaves change, and so do their ancestors. A word of n bytes takes n times log n steps, also where it is
as long as its text. New words of up to 65 bytes are merged many at a time: the trees of one size are rows of one array.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Words that a task remembers before it starts anew; bounds its memory, as longer ones than MANY_BYTES aren't kept.
REMEMBERED = 400_000
#: Characters of text whose words are looked up, and new ones merged, together.
STEP_CHARS = 3_000_000
#: Words of more bytes are merged one by one.
MANY_BYTES = 65
# Characters that vocabularies of this kind count as neither letters nor digits, since they were assigned after Unicode 16.
LATER = """
558 58B-58C 88F C5C CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF 10940-10959 10EC5-10EC7 10ED9-10EEE 11B0A 11DB0-11DDB 11DE0-11DE9 11DF1 1246F
12475-1247F 12550-12686 16EA0-16EB8 16EBB-16ED3 16FF2-16FF6 187F8-187FF 18CD6-18CDA 18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2 1B123-1B128 1B168 1D6A6 1DF1F-1DF24 1DF2B-1DF81
1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED 1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F 2B81E 2CEA2-2CEAD 323B0-33479 3D000-3FC3F
"""
_NONE = 1 << 62


def _pattern(space: str, letter: str, digit: str, other: str) -> str:
    """How byte-level vocabularies cut texts: contractions, letters, digits and other characters, each with a blank before it, and white space."""
    return rf"'(?:[stmd]|re|ve|ll)| ?{letter}+| ?{digit}+| ?{other}+|{space}+(?={space}|\Z)|{space}+"


def _word_finders():
    """Two finders of words: for texts of characters under U+0250 (the faster), and for all texts."""
    later = "".join("-".join(f"\\U{int(x, 16):08X}" for x in span.split("-")) for span in LATER.split())
    all_texts = _pattern(r"\s", rf"[\p{{L}}--[{later}]]", rf"[\p{{N}}--[{later}]]", rf"[[^\s\p{{L}}\p{{N}}]||[{later}]]")
    # The letters, digits and white space among characters under U+0250.
    letters, digits, space = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼-¾", "\t-\r \x85\xa0"
    return re.compile(_pattern(f"[{space}]", f"[{letters}]", f"[{digits}]", f"[^{space}{letters}{digits}]")).findall, regex.compile(all_texts, regex.V1).findall


def byte_letters() -> list[str]:
    """The letter that stands for each byte in the vocabulary: printable Latin-1 for itself, the others from U+0100 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


class BytePairModel:
    """Encoder and decoder of a vocabulary file."""

    def __init__(self, vocabulary_file: str):
        with open(vocabulary_file, encoding="utf-8") as f:
            said = json.load(f)
        model, before = said["model"], said["pre_tokenizer"]
        plain = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        if not plain or said.get("normalizer") or before["type"] != "ByteLevel" or before["add_prefix_space"] or not before.get("use_regex", True):
            raise ValueError(f"{vocabulary_file} isn't a plain byte-level BPE vocabulary")
        vocabulary, letters = model["vocab"], byte_letters()
        byte_of = {c: b for b, c in enumerate(letters)}
        self.first = [vocabulary[c] for c in letters]
        self.ranks: dict[int, int] = {}
        self.merged: list[int] = []
        for pair in model["merges"]:
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.ranks[vocabulary[left] << 32 | vocabulary[right]] = len(self.merged)
            self.merged.append(vocabulary[left + right])
        self.special = {x["content"]: x["id"] for x in said.get("added_tokens", [])}
        if any(x.get(k) for x in said.get("added_tokens", []) for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError(f"{vocabulary_file} has added tokens that look at what is beside them")
        text = {i: bytes(byte_of[c] for c in piece) for piece, i in vocabulary.items() if piece not in self.special}
        text |= {i: piece.encode() for piece, i in self.special.items()}
        self.text = [text.get(i, b"") for i in range(max(text) + 1)]
        self.size = np.array([len(x) for x in self.text], np.int64)
        self.place = np.cumsum(self.size) - self.size
        self.blob = np.frombuffer(b"".join(self.text), np.uint8)
        self._latin, self._any = _word_finders()
        self._beyond = re.compile(r"[^\x00-\u024f]").search
        self.known: dict[str, bytes] = {}
        self._index_pairs()
        self.cuts = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None

    def merge(self, word: bytes) -> list[int]:
        """The ids of a word."""
        first, ranks, merged = self.first, self.ranks, self.merged
        sym = [first[b] for b in word]
        pairs = len(sym) - 1
        if pairs < 1:
            return sym
        size = 1 << (pairs - 1).bit_length()
        tree = [_NONE] * (2 * size)
        for i in range(pairs):
            if (rank := ranks.get(sym[i] << 32 | sym[i + 1])) is not None:
                tree[size + i] = rank << 32 | i
        for i in range(size - 1, 0, -1):
            a, b = tree[2 * i], tree[2 * i + 1]
            tree[i] = a if a < b else b
        after, before = list(range(1, pairs + 2)), list(range(-1, pairs))
        while (root := tree[1]) != _NONE:
            i = root & 0xFFFFFFFF
            j, h = after[i], before[i]
            k = after[j]
            sym[i], sym[j], after[i] = merged[root >> 32], -1, k
            changed = [(j, None), (i, ranks.get(sym[i] << 32 | sym[k]) if k <= pairs else None)]
            if k <= pairs:
                before[k] = i
            if h >= 0:
                changed.append((h, ranks.get(sym[h] << 32 | sym[i])))
            for at, rank in changed:
                if at == pairs:  # the last symbol begins no pair
                    continue
                node, value = size + at, _NONE if rank is None else rank << 32 | at
                while tree[node] != value:
                    tree[node] = value
                    if node == 1:
                        break
                    beside = tree[node ^ 1]
                    if beside < value:
                        value = beside
                    node >>= 1
        return [s for s in sym if s >= 0]

    def _index_pairs(self) -> None:
        """The pairs in an open-addressed table, for lookups of many at a time."""
        keys = np.array(list(self.ranks), np.int64)
        self._bits = max(18, int(len(keys) * 4).bit_length())
        self._keys, self._ranks = np.full(1 << self._bits, -1, np.int64), np.full(1 << self._bits, _NONE, np.int64)
        left, slot = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = self._keys[slot] == -1
            self._keys[slot[free]] = keys[left[free]]
            done = self._keys[slot] == keys[left]
            self._ranks[slot[done]] = left[done]
            left, slot = left[~done], (slot[~done] + 1) & ((1 << self._bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self._bits)).astype(np.int64)

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The ranks of pairs of symbols; no symbol is -1."""
        keys = np.where((left < 0) | (right < 0), -2, left << 32 | right)
        slot = self._slot(keys)
        out, open_ = np.full(len(keys), _NONE, np.int64), np.arange(len(keys))
        while len(open_):
            there = self._keys[slot]
            hit = there == keys[open_]
            out[open_[hit]] = self._ranks[slot[hit]]
            more = ~hit & (there != -1)
            open_, slot = open_[more], (slot[more] + 1) & ((1 << self._bits) - 1)
        return out

    def merge_many(self, words: list[bytes], leaves: int) -> list[bytes]:
        """The ids of words of 2 to leaves + 1 bytes, as little-endian unsigned 32-bit integers. A row of ``tree`` is the tree of a word; each round merges at every root."""
        merged, depth = np.array(self.merged, np.int64), leaves.bit_length() - 1
        size = np.fromiter(map(len, words), np.int64, len(words))
        row, wide = np.arange(len(words)), leaves + 2  # the last column of sym stays without a symbol: it is before the first and after the last
        sym = np.full((len(words), wide), -1, np.int64)
        sym[np.repeat(row, size), np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)] = np.array(self.first, np.int64)[np.frombuffer(b"".join(words), np.uint8)]
        after, before = np.tile(np.arange(1, wide + 1), (len(words), 1)), np.tile(np.arange(-1, wide - 1), (len(words), 1))
        after[row, size - 1] = before[:, 0] = wide - 1
        tree = np.full((len(words), 2 * leaves), _NONE, np.int64)
        rank = self._rank(sym[:, :leaves].ravel(), sym[:, 1 : leaves + 1].ravel()).reshape(-1, leaves)
        tree[:, leaves:] = np.where(rank == _NONE, _NONE, rank << 8 | np.arange(leaves))
        for node in range(leaves - 1, 0, -1):
            tree[:, node] = np.minimum(tree[:, 2 * node], tree[:, 2 * node + 1])
        while len(row := row[tree[row, 1] != _NONE]):
            root = tree[row, 1]
            i = root & 255
            j, h = after[row, i], before[row, i]
            k = after[row, j]
            new = merged[root >> 8]
            sym[row, i], sym[row, j], after[row, i] = new, -1, k
            before[row, k] = i
            before_rank, rank = np.split(self._rank(np.concatenate([sym[row, h], new]), np.concatenate([new, sym[row, k]])), 2)
            j, h_or_j = np.where(j < leaves, j, i), np.where(h < leaves, h, j)
            h_or_j = np.where(h_or_j < leaves, h_or_j, i)  # leaves that don't exist are written to one that is written again
            tree[row, leaves + j] = _NONE
            tree[row, leaves + h_or_j] = np.where(before_rank == _NONE, _NONE, before_rank << 8 | h_or_j)
            tree[row, leaves + i] = np.where(rank == _NONE, _NONE, rank << 8 | i)
            nodes = [leaves + i, leaves + j, leaves + h_or_j]
            for _ in range(depth):
                for which in range(3):
                    node = nodes[which] = nodes[which] >> 1
                    tree[row, node] = np.minimum(tree[row, 2 * node], tree[row, 2 * node + 1])
        there = sym >= 0
        end = (np.cumsum(there.sum(1)) * 4).tolist()
        raw = sym[there].astype("<u4").tobytes()
        return [raw[a:b] for a, b in zip([0, *end], end)]

    def _ids(self, words: set[str]) -> Iterator[tuple[str, bytes]]:
        """(word, ids) of distinct words: many short ones at a time, long ones by themselves."""
        by_leaves: dict[int, list[str]] = {}
        raw = {w: w.encode("utf-8", "replace") for w in words}
        for w, b in raw.items():
            if 1 < len(b) <= MANY_BYTES:
                by_leaves.setdefault(max(4, 1 << (len(b) - 2).bit_length()), []).append(w)
            else:
                yield w, np.array(self.merge(b), "<u4").tobytes()
        for leaves, some in by_leaves.items():
            yield from zip(some, self.merge_many([raw[w] for w in some], leaves))

    def words(self, text: str) -> list[str]:
        return (self._any if self._beyond(text) else self._latin)(text)

    def encode(self, texts: list[str | None]) -> Iterator[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit integers. Strings of added tokens get those tokens' ids, as in the library."""
        i = 0
        while i < len(texts):
            j, chars = i, 0
            while j < len(texts) and (j == i or chars + len(texts[j] or "") <= STEP_CHARS):
                chars += len(texts[j] or "")
                j += 1
            yield from self._encode_some([t or "" for t in texts[i:j]])
            i = j

    def _parts(self, text: str) -> list[tuple[list[str], bytes]]:
        """The words of a text between the strings of added tokens, each run of words with the id of the token after it."""
        out, done = [], 0
        for m in self.cuts.finditer(text) if self.cuts else ():
            out.append((self.words(text[done : m.start()]), self.special[m.group()].to_bytes(4, "little")))
            done = m.end()
        return [*out, (self.words(text[done:]), b"")]

    def _encode_some(self, texts: list[str]) -> Iterator[bytes]:
        parts = [self._parts(t) for t in texts]
        distinct = set().union(*[words for part in parts for words, _ in part])
        new = distinct - self.known.keys()
        if len(self.known) + len(new) > REMEMBERED:
            self.known.clear()
            new = distinct
        ids = self.known
        ids.update(self._ids(new))
        for part in parts:
            yield b"".join([b"".join(map(ids.__getitem__, words)) + token for words, token in part])
        for w in new:
            if len(w) > MANY_BYTES:
                del ids[w]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids, added tokens included."""
        size = self.size[ids]
        end = np.cumsum(size)
        raw = self.blob[np.repeat(self.place[ids] - end + size, size) + np.arange(size.sum())].tobytes()
        return raw.decode("utf-8", "replace")


_models: dict[str, BytePairModel] = {}


def model_of(vocabulary_file: str) -> BytePairModel:
    """The model, read once in each Python worker; it keeps the words that it knows from task to task."""
    if vocabulary_file not in _models:
        _models[vocabulary_file] = BytePairModel(vocabulary_file)
    return _models[vocabulary_file]


def encode(df: DataFrame, vocabulary_file: str, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """df with the ids of each whole text (array of int) and the text decoded from them.

    A null text counts as empty: no ids, decoded as an empty text. All columns of df stay; columns named as the two new ones are replaced. Ids are exactly those of the
    tokenizers library without special tokens put around a text, truncation or padding. A very long text, or word, is encoded whole; rows that are equal have equal ids; an
    empty table stays empty.
    """
    df = df.drop(ids, decoded)
    place = df.columns.index(text)
    schema = T.StructType([*df.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType())), T.StructField(decoded, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of(vocabulary_file)
        for batch in batches:
            got = [np.frombuffer(x, "<u4") for x in model.encode(batch.column(place).to_pylist())]
            at = np.cumsum([0] + [len(x) for x in got]).astype(np.int32)
            said = pa.array([model.decode(x) for x in got], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate([*got, np.empty(0, "<u4")]).astype(np.int32))), said], names=schema.names)

    return df.mapInArrow(run, schema)


def encode_digests(df: DataFrame, vocabulary_file: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_tokens, ids_sha256 and decoded_sha256: the digests of what encode() gives, made where the ids are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of(vocabulary_file)
        for batch in batches:
            n, i, d = [], [], []
            for raw in model.encode(batch.column(1).to_pylist()):
                n.append(len(raw) // 4)
                i.append(hashlib.sha256(raw).hexdigest())
                d.append(hashlib.sha256(model.decode(np.frombuffer(raw, "<u4")).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(i, pa.string()), pa.array(d, pa.string())], names=[key, "n_tokens", "ids_sha256", "decoded_sha256"])

    return df.select(key, text).mapInArrow(run, f"{key} {df.schema[key].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
