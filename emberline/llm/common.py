"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a vectorised step holds in numpy arrays at a time; a longer text is a step of its own.
STEP_BYTES = 1_500_000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which driver and executors share. Where the session names none, a temporary one is set on a local master; on a cluster it must be named."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """The rows of df, computed once and kept in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def free_name(df: DataFrame, name: str) -> str:
    """``name``, longer by underscores where df has a column of that name."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def crc32_mod(column: str, n: int):
    """crc32 of the id as text, modulo n; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % n


# --- texts as flat byte arrays ---------------------------------------------------------------


def flat_utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts and the n + 1 places where they begin; a null is empty."""
    texts = pc.fill_null(texts, "")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    wide = pa.types.is_large_string(texts.type)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    if data is None or at[-1] == at[0]:
        return np.empty(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def steps(offsets: np.ndarray, most: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of texts (first, end) that hold up to ``most`` bytes, at least one text each."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def mix(x: np.ndarray) -> np.ndarray:
    """Scatters 64-bit values (the finaliser of the splitmix64 generator)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
#: All bytes of UTF-8 but 0-9, a-z and those over 0x7F.
NOT_ALNUM = np.ones(256, bool)
NOT_ALNUM[48:58] = NOT_ALNUM[97:123] = NOT_ALNUM[128:] = False
#: Spans of more bytes are hashed one by one.
_LONG_SPAN = 256
_ODD = np.uint64(0x9E3779B97F4A7C15)


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of each buf[start:end], equal for equal bytes (with A-Z lower-cased).

    Eight bytes of all spans at a time are scattered into what the bytes before gave, so no combination of spans has known collisions; long spans go
    through XXH3.
    """
    buf = LOWER[buf] if lower else np.ascontiguousarray(buf)
    size = ends - starts
    out = mix(size.astype(np.uint64) + np.uint64(int(_ODD) * (2 * seed + 1) % (1 << 64)))
    eights = np.ndarray(len(buf), "<u8", np.r_[buf, np.zeros(8, np.uint8)].tobytes(), 0, (1,)) if len(buf) else np.empty(0, np.uint64)
    for i in np.flatnonzero(size > _LONG_SPAN).tolist():
        out[i] = xxhash.xxh3_64_intdigest(buf[starts[i] : ends[i]], seed)
    live = np.flatnonzero((size > 0) & (size <= _LONG_SPAN))
    at, left, h = starts[live], size[live], out[live]
    while len(live):
        rest = np.minimum(left, 8).astype(np.uint64)
        h = mix((h ^ (eights[at] & _REST[rest])) * _ODD)
        over = left <= 8
        out[live[over]] = h[over]
        live, at, left, h = live[~over], at[~over] + 8, left[~over] - 8, h[~over]
    return out


#: The bits of a word of eight bytes that its first k bytes hold.
_REST = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def distinct_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans that stand for all others, and for each span which of those has its bytes. Bytes are compared: should two unlike spans have one hash, they are hashed anew."""
    size, seed = ends - starts, 0
    while True:
        _, at, each = np.unique(span_hashes(buf, starts, ends, lower=False, seed=seed), return_index=True, return_inverse=True)
        like = at[each]
        if (size == size[like]).all():
            inside = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            if (buf[np.repeat(starts, size) + inside] == buf[np.repeat(starts[like], size) + inside]).all():
                return at, each
        seed += 1


def words(buf: np.ndarray, offsets: np.ndarray, outside: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of the texts in buf, runs of bytes that aren't ``outside`` (``[^\\x20\\x09-\\x0D]+``): starts, ends, and per text the index of its first word (n + 1)."""
    n = len(buf)
    if n == 0:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(offsets), np.int64)
    solid = ~outside[buf]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.empty(n, bool)
    before[0] = True
    before[1:] = ~solid[:-1]
    starts = np.flatnonzero(solid & (before | edge[:n]))
    after = np.empty(n, bool)
    after[-1] = True
    after[:-1] = ~solid[1:]
    ends = np.flatnonzero(solid & (after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)
