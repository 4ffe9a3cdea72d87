"""Line deduplication with two Bloom filters (operator 2).

A line's key is the line stripped of ASCII white space with A-Z lower-cased. Two filters are filled over all documents: one holds the
keys seen once, the other those that at least two documents seem to hold. The filters are sized by the number of lines and cut into
segments of SEGMENT_BITS, so their error doesn't grow with the input. Tasks send each segment the hashes of its keys, difference-coded;
what merges a segment holds that one alone. Filters of up to SENT_BYTES go to every task, and only suspected keys shuffle; larger
ones stay where they are and the keys' hashes meet them by segment, with the same suspects. Suspects are confirmed as
128-bit digests, and the smallest id that holds each is found.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberline.llm.common import LOWER, SPACE, cut, flat_utf8, free_name, mix, span_hashes, steps

#: Bits of a segment, bits of each filter for a line, and probes: below 1 in 80 of the keys seen once is suspected.
SEGMENT_BITS, LINE_BITS, PROBES = 1 << 19, 12, 3
#: Bytes of the filter of repeated keys that are sent to every task at most.
SENT_BYTES = 64 << 20
#: Parts that the rows of a segment are dealt to where keys meet the filter by segment.
SALT = 8
#: Keys that a task holds before it sends them.
HELD_KEYS = 500_000
#: A digest with more than one in HOT of all suspects is joined apart; there are fewer than HOT of them.
HOT = 1000
#: Shortest key, in code points, that counts as a repeated line.
MIN_CHARS = 10


def line_keys(buf: np.ndarray, offsets: np.ndarray, min_chars: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys of at least min_chars code points: starts, ends, the text and the number of the line within it."""
    n = len(buf)
    if n == 0:
        return (np.empty(0, np.int64),) * 4
    breaks = np.flatnonzero(buf == 10)
    full = np.flatnonzero(np.diff(offsets) > 0)
    starts = np.sort(np.r_[offsets[full], breaks + 1])
    ends = np.sort(np.r_[breaks, offsets[full + 1]])
    text = np.searchsorted(offsets, starts, "right") - 1
    # a text that ends with a line break has an empty last line, which begins where the next text does
    inside = ends > starts
    starts, ends = starts[inside], ends[inside]
    text = np.searchsorted(offsets, starts, "right") - 1
    number = np.searchsorted(breaks, starts) - np.searchsorted(breaks, offsets)[text]
    solid = ~SPACE[buf]
    before = np.r_[0, np.cumsum(solid)]
    place = np.flatnonzero(solid)
    full = before[ends] > before[starts]
    starts, ends, text, number = starts[full], ends[full], text[full], number[full]
    starts, ends = place[before[starts]], place[before[ends] - 1] + 1
    points = np.r_[0, np.cumsum((buf & 0xC0) != 0x80)]
    long = points[ends] - points[starts] >= min_chars
    return starts[long], ends[long], text[long], number[long]


def _segment(hashes: np.ndarray, n_segments: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(n_segments) >> np.uint64(32)).astype(np.int64)


def _bits(hashes: np.ndarray) -> list[np.ndarray]:
    """The bits of each key within its segment."""
    again = mix(hashes + np.uint64(0x9E3779B97F4A7C15))
    return [((again >> np.uint64(20 * k)) % np.uint64(SEGMENT_BITS)).astype(np.int64) for k in range(PROBES)]


def has(segment: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which of the hashes a segment of a filter holds."""
    return np.logical_and.reduce([(segment[b >> 3] >> (b & 7)) & 1 == 1 for b in _bits(hashes)])


class Segment:
    """A segment of the two filters."""

    def __init__(self) -> None:
        self.once, self.twice = np.zeros(SEGMENT_BITS // 8, np.uint8), np.zeros(SEGMENT_BITS // 8, np.uint8)

    @staticmethod
    def _set(side: np.ndarray, hashes: np.ndarray) -> None:
        for b in _bits(hashes):
            np.bitwise_or.at(side, b >> 3, (1 << (b & 7)).astype(np.uint8))

    def add(self, hashes: np.ndarray, again: np.ndarray) -> None:
        """Adds distinct keys; ``again``: those that two documents hold by themselves. A key that came before counts as one that two documents hold."""
        self._set(self.twice, hashes[again | has(self.once, hashes)])
        self._set(self.once, hashes)


def _by_segment(hashes: np.ndarray, n_segments: int) -> Iterator[tuple[int, int, int]]:
    """(segment, first, end) of runs of sorted hashes."""
    segment = _segment(hashes, n_segments)
    at = np.flatnonzero(np.r_[True, segment[1:] != segment[:-1], True]).tolist() if len(hashes) else []
    yield from ((int(segment[i]), i, j) for i, j in zip(at, at[1:]))


def suspected_keys(docs: DataFrame, n_segments: int, min_chars: int = MIN_CHARS) -> DataFrame:
    """(segment, twice): the filter of keys that two documents or more seem to hold. docs: id (a 64-bit hash of the document's), text."""

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def sent() -> pa.RecordBatch:
            h, d = (np.concatenate(x) for x in zip(*held)) if held else (np.empty(0, np.uint64), np.empty(0, np.int64))
            order = np.lexsort((d, h))
            h, d = h[order], d[order]
            new = np.r_[True, (h[1:] != h[:-1]) | (d[1:] != d[:-1])][: len(h)]
            keys, count = np.unique(h[new], return_counts=True)
            again = (count > 1).astype(np.uint8)
            rows = [(k, keys[i:j].tobytes(), again[i:j].tobytes()) for k, i, j in _by_segment(keys, n_segments)]
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), *(pa.array([r[k] for r in rows], pa.binary()) for k in (1, 2))], names=["segment", "keys", "again"])

        for batch in batches:
            key = np.asarray(batch.column(0))
            buf, offsets = flat_utf8(batch.column(1))
            for i, j in steps(offsets):
                part = buf[offsets[i] : offsets[j]]
                starts, ends, text, _ = line_keys(part, offsets[i : j + 1] - offsets[i], min_chars)
                held.append((span_hashes(part, starts, ends), key[i:j][text]))
                n += len(text)
                if n >= HELD_KEYS:
                    yield sent()
                    held, n = [], 0
        yield sent()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by segment."""
        now, own = None, Segment()

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([zlib.compress(own.twice.tobytes(), 1)], pa.binary())], names=["segment", "twice"])

        for batch in batches:
            for segment, keys, again in zip(*(c.to_pylist() for c in batch.columns)):
                if segment != now:
                    if now is not None:
                        yield done()
                    now, own = segment, Segment()
                own.add(np.frombuffer(keys, np.uint64), np.frombuffer(again, np.uint8) == 1)
        if now is not None:
            yield done()

    sent = docs.mapInArrow(fill, "segment long, keys binary, again binary").repartition("segment").sortWithinPartitions("segment")
    return sent.mapInArrow(merge, "segment long, twice binary")


def _suspects(docs: DataFrame, twice: DataFrame, n_segments: int, min_chars: int) -> DataFrame:
    """(digest, key, row, line): the lines whose keys the filter of repeated keys holds. docs: key, text, row, id."""
    lower, small = bytes(LOWER), n_segments * SEGMENT_BITS // 8 <= SENT_BYTES
    sent = docs.sparkSession.sparkContext.broadcast({r.segment: bytes(r.twice) for r in twice.collect()}) if small else None
    schema, names = f"digest binary, key {docs.schema['key'].dataType.simpleString()}, row long, line int", ["digest", "key", "row", "line"]

    def lines_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            buf, offsets = flat_utf8(batch.column(1))
            for i, j in steps(offsets):
                part = buf[offsets[i] : offsets[j]]
                starts, ends, text, number = line_keys(part, offsets[i : j + 1] - offsets[i], min_chars)
                yield batch, part.tobytes().translate(lower), starts, ends, text + i, number, span_hashes(part, starts, ends)

    def digests(raw: bytes, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
        return pa.array([hashlib.blake2b(raw[s:e], digest_size=16).digest() for s, e in zip(starts.tolist(), ends.tolist())], pa.binary())

    def where_sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        twice = {k: np.frombuffer(zlib.decompress(v), np.uint8) for k, v in sent.value.items()}
        for batch, raw, starts, ends, text, number, h in lines_of(batches):
            order = np.argsort(h)
            found = np.zeros(len(h), bool)
            for k, i, j in _by_segment(h[order], n_segments):
                if k in twice:
                    found[order[i:j]] = has(twice[k], h[order[i:j]])
            hit = np.flatnonzero(found)
            owner = pa.array(text[hit])
            yield pa.RecordBatch.from_arrays([digests(raw, starts[hit], ends[hit]), batch.column(0).take(owner), batch.column(2).take(owner), pa.array(number[hit], pa.int32())], names=names)

    def all_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, raw, starts, ends, text, number, h in lines_of(batches):
            owner = pa.array(text)
            yield pa.RecordBatch.from_arrays([pa.array(_segment(h, n_segments)), pa.array(h.astype(np.int64)), digests(raw, starts, ends), batch.column(0).take(owner), batch.column(2).take(owner), pa.array(number, pa.int32())], names=["segment", "hash", *names])

    def by_segment(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by segment, the filter's own first."""
        own = None
        for batch in batches:
            filters = np.flatnonzero(batch.column("twice").is_valid())
            begins = set(filters.tolist())
            edges = sorted({0, len(batch), *begins})
            for i, j in zip(edges, edges[1:]):
                if i in begins:
                    own = np.frombuffer(zlib.decompress(batch.column("twice")[i].as_py()), np.uint8)
                    i += 1
                part = batch.slice(i, j - i)
                if len(part):
                    yield pa.RecordBatch.from_arrays([part.column(n).filter(pa.array(has(own, np.asarray(part.column("hash")).astype(np.uint64)))) for n in names], names=names)

    if small:
        return docs.select("key", "text", "row").mapInArrow(where_sent, schema)
    keys = docs.select("key", "text", "row").mapInArrow(all_keys, f"segment long, hash long, {schema}")
    keys = keys.withColumn("salt", F.pmod(F.hash("key", "row", "line"), F.lit(SALT)))
    filters = twice.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    both = keys.unionByName(filters, allowMissingColumns=True)
    return both.repartition("segment", "salt").sortWithinPartitions("segment", "salt", F.col("twice").isNull()).mapInArrow(by_segment, schema)


def _drops(docs: DataFrame, min_chars: int) -> DataFrame:
    """(key, row, drop): the numbers of the lines that each document loses. docs: key (in the order of documents), text, row, id."""
    n_lines = docs.agg(F.sum(F.char_length("text") - F.char_length(F.translate("text", "\n", "")) + 1)).first()[0] or 0
    n_segments = max(1, -(-n_lines * LINE_BITS // SEGMENT_BITS))
    found = cut(_suspects(docs, suspected_keys(docs.select("id", "text"), n_segments, min_chars), n_segments, min_chars))
    seen = found.groupBy("digest").agg(F.min("key").alias("first"), F.max("key").alias("last"), F.count("*").alias("n")).where("first < last").drop("last")
    repeated, many = cut(seen), found.count() // HOT
    hot = repeated.where(F.col("n") > many).drop("n")  # fewer than HOT rows
    lost = found.join(F.broadcast(hot), "digest", "left")
    apart = lost.where("first is not null").select("key", "row", "line", "first")
    rest = lost.where("first is null").drop("first").join(repeated.where(F.col("n") <= many).drop("n"), "digest").select("key", "row", "line", "first")
    return apart.unionByName(rest).where("key > first").groupBy("key", "row").agg(F.collect_set("line").alias("drop"))


def _with_drops(df: DataFrame, key: str, text: str, min_chars: int) -> DataFrame:
    """df and, as its last column, the numbers of the lines that each row loses."""
    k, row, drop = (free_name(df, x) for x in ("key", "row", "drop"))
    docs = df.select("*", F.struct(F.col(key).isNull().alias("last"), F.col(key).alias("id")).alias(k), F.xxhash64(text).alias(row))
    drops = _drops(docs.select(F.col(k).alias("key"), F.col(text).alias("text"), F.col(row).alias("row"), F.xxhash64(k).alias("id")), min_chars)
    return docs.join(drops.toDF(k, row, drop), [k, row], "left").select(*df.columns, drop)


def _kept(text: bytes, drop: list[int] | None) -> bytes:
    if not drop:
        return text
    gone = set(drop)
    return b"\n".join([x for k, x in enumerate(text.split(b"\n")) if k not in gone])


def dedup_lines(df: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """df with repeated lines taken out of the texts, and n_lines (before) and n_dropped.

    Lines end at a line break. A key of at least min_chars code points that two documents or more hold
    loses all its lines but those in the document of the smallest id. A null or empty text has one empty
    line and stays as it is. Rows of one id are one document, and so are all rows without an id, which come last.
    Other columns stay, whatever their names; columns of df named n_lines or n_dropped are replaced. Ids may be numbers or texts. A
    very long text is read whole.
    """
    df = df.drop("n_lines", "n_dropped")
    schema = T.StructType([*df.schema.fields, T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
    place = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = batch.columns
            texts, drops = columns[place].to_pylist(), columns.pop().to_pylist()
            kept = [t if not d else _kept(t.encode(), d).decode() for t, d in zip(texts, drops)]
            columns[place] = pa.array(kept, columns[place].type)
            yield pa.RecordBatch.from_arrays([*columns, pa.array([(t or "").count("\n") + 1 for t in texts], pa.int64()), pa.array([len(d or ()) for d in drops], pa.int64())], names=schema.names)

    return _with_drops(df, key, text, min_chars).mapInArrow(run, schema)


def dedup_line_digests(df: DataFrame, key: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """key, n_lines, n_dropped and kept_sha256: digests of what dedup_lines() gives, with its rules, made where the lines are dropped."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, drops = (batch.column(k).cast(pa.binary()).to_pylist() if k == 1 else batch.column(k).to_pylist() for k in (1, 2))
            texts = [t or b"" for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([t.count(b"\n") + 1 for t in texts], pa.int64()), pa.array([len(d or ()) for d in drops], pa.int64()), pa.array([hashlib.sha256(_kept(t, d)).hexdigest() for t, d in zip(texts, drops)], pa.string())], names=[key, "n_lines", "n_dropped", "kept_sha256"])

    rows = _with_drops(df.select(key, text), key, text, min_chars)
    return rows.mapInArrow(run, f"{key} {df.schema[key].dataType.simpleString()}, n_lines long, n_dropped long, kept_sha256 string")


ORACLE = r"""
WITH t AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS place FROM t),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS line_key FROM l),
r AS (SELECT line_key, min(doc_id) AS first_doc FROM k WHERE length(line_key) >= 10 GROUP BY line_key HAVING min(doc_id) < max(doc_id)),
x AS (SELECT k.*, coalesce(doc_id > first_doc, false) AS gone FROM k LEFT JOIN r ON k.line_key = r.line_key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT gone), '')) AS kept_sha256
FROM x GROUP BY doc_id
"""
