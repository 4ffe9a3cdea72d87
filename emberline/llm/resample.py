"""Target-distribution importance resampling over hashed n-grams (operator 13).

Features are the runs of 1 to n words of a text, hashed by CRC-32 into buckets. What the target says more often than the corpus gains, and a
document's weight is the sum of its features' gains; Gumbel noise on top of weights and the best of those make a sample without replacement. The CRC of a word is
computed once, and those of longer runs are composed from it (``crc.of_runs``).
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.llm import crc
from emberline.llm.common import LOWER, NOT_ALNUM, cut, flat_utf8, free_name, steps, words


def _features(texts: pa.Array, most_words: int, buckets: int) -> Iterator[tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]]:
    """For runs of texts in their order: the words of each, and for n = 1 to most_words (the text, the bucket) of all its runs of n words."""
    buf, offsets = flat_utf8(texts)
    for i, j in steps(offsets):
        part = LOWER[buf[offsets[i] : offsets[j]]]
        starts, ends, first = words(part, offsets[i : j + 1] - offsets[i], NOT_ALNUM)
        n_words = np.diff(first)
        text = np.repeat(np.arange(j - i), n_words)
        runs = crc.of_runs(crc.of_spans(part, starts, ends), ends - starts, np.repeat(first[1:] - 1, n_words), most_words)
        yield n_words, [(text[at], (c % np.uint32(buckets)).astype(np.int64)) for at, c in runs]


def bucket_counts(df: DataFrame, text: str = "text", most_words: int = 1, buckets: int = 10_000) -> DataFrame:
    """bucket, n: the features of all texts in each bucket. A task adds up its own counts, so at most ``buckets`` rows a task shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, runs in _features(batch.column(0), most_words, buckets):
                for _, bucket in runs:
                    total += np.bincount(bucket, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    return df.select(text).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, buckets: int) -> np.ndarray:
    """What a feature of each bucket adds to a weight, from two tables of bucket_counts(); each has at most ``buckets`` rows."""
    s, t = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
    for counts, df in ((s, source), (t, target)):
        for bucket, n in df.collect():
            counts[bucket] = n
    all_s, all_t = float(s.sum() + buckets), float(t.sum() + buckets)
    return np.array([math.floor(1000 * math.log((float(b) + 1) * all_s / ((float(a) + 1) * all_t))) for a, b in zip(s.tolist(), t.tolist())], np.int64)


def weights(df: DataFrame, gain: np.ndarray, key: str = "doc_id", text: str = "text", most_words: int = 1) -> DataFrame:
    """key, n_words, n_features, weight of every row of df, in one pass over whole texts."""
    shared = df.sparkSession.sparkContext.broadcast(gain)  # one number a bucket

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = shared.value
        for batch in batches:
            done = 0
            for n_words, runs in _features(batch.column(1), most_words, len(gain)):
                n, weight = np.zeros(len(n_words), np.int64), np.zeros(len(n_words), np.int64)
                for text, bucket in runs:
                    n += np.bincount(text, minlength=len(n))
                    up_to = np.r_[0, np.cumsum(gain[bucket])]
                    at = np.searchsorted(text, np.arange(len(n) + 1))
                    weight += up_to[at[1:]] - up_to[at[:-1]]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(done, len(n)), pa.array(n_words.astype(np.int64)), pa.array(n), pa.array(weight)], names=[key, "n_words", "n_features", "weight"])
                done += len(n)

    return df.select(key, text).mapInArrow(run, f"{key} {df.schema[key].dataType.simpleString()}, n_words long, n_features long, weight long")


def importance_resample(docs: DataFrame, target: DataFrame, key: str = "doc_id", text: str = "text", most_words: int = 1, buckets: int = 10_000, percent: int = 10, least_words: int = 20, seed: int | str = 2024) -> DataFrame:
    """key, n_features, weight, score and rank of every document; rank numbers those drawn from 1, null for the others.

    Drawn are the ``percent`` percent, rounded down, of the documents with ``least_words`` words or more that have the highest scores, ties to the smaller key.
    The noise of a score depends on the seed and the key alone. A null text has no words, no features and weight 0; a null key counts as an empty
    text in the noise and comes before all others in ties; rows of one key get numbers of their own. Very long texts are taken whole, a step of their own. An empty table gives
    no rows, an empty target a weight by the corpus alone. Other columns don't matter.

    Ranks come from a partitioning by ranges of the score: each row's place in its range after the rows of the ranges before it, so no task sees all rows.
    """
    if key.lower() in ("n_words", "n_features", "weight", "score", "rank"):
        raise ValueError(f"{key} can't name the documents here")
    gain = gains(bucket_counts(docs, text, most_words, buckets), bucket_counts(target, text, most_words, buckets), buckets)
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.ln(-F.ln((h + 0.5) / F.lit(4294967296.0)))).cast("long")
    scored = cut(weights(docs, gain, key, text, most_words).withColumn("score", F.col("weight") + noise))
    row, part, begin = (free_name(scored, x) for x in ("row", "part", "begin"))
    enough = F.col("n_words") >= least_words
    ordered = [enough.desc(), F.col("score").desc(), F.col(key), F.col("n_features"), F.col("weight"), F.col(row)]
    lined_up = cut(scored.withColumn(row, F.monotonically_increasing_id()).repartitionByRange(*ordered).sortWithinPartitions(*ordered).drop(row))
    placed = lined_up.withColumn(row, F.monotonically_increasing_id()).withColumn(part, F.shiftright(row, 33))  # the partition, then the row within it
    sizes = placed.groupBy(part).agg(F.count("*").alias("n"), F.count_if(enough).alias("n_enough")).orderBy(part).collect()  # one row a partition
    drawn = sum(x.n_enough for x in sizes) * percent // 100
    begins = docs.sparkSession.createDataFrame([(x[part], b) for x, b in zip(sizes, np.cumsum([0] + [x.n for x in sizes]).tolist())], f"{part} long, {begin} long")
    rank = F.col(begin) + F.col(row).bitwiseAND((1 << 33) - 1) + 1
    return placed.join(F.broadcast(begins), part).select(key, "n_features", "weight", "score", F.when(rank <= drawn, rank).alias("rank"))  # begins has one row a partition


# The CRC of each distinct word goes through a table of 256 numbers, a byte at a time.
ORACLE = r"""
WITH crc_table AS (
  SELECT list(c ORDER BY b) AS t FROM (
    SELECT b, list_reduce(list_prepend(b, [0, 1, 2, 3, 4, 5, 6, 7]), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
    FROM (SELECT CAST(unnest(range(256)) AS BIGINT) AS b))),
texts AS (
  SELECT 'd' AS kind, row_number() OVER () AS k, doc_id, text FROM documents UNION ALL SELECT 'b', 0, NULL, text FROM benchmark),
w AS (
  SELECT kind, k, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM texts),
u AS (SELECT kind, k, unnest(w) AS word FROM w),
hashed AS (
  SELECT word, xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(CAST(length(x) / 2 AS BIGINT)), lambda i: CAST('0x' || substr(x, 2 * i + 1, 2) AS BIGINT))),
    lambda c, y: xor(t[(xor(c, y) & 255) + 1], c >> 8))) % 10000 AS bucket
  FROM (SELECT word, hex(encode(word)) AS x FROM (SELECT DISTINCT word FROM u)) CROSS JOIN crc_table),
f AS (SELECT kind, k, bucket FROM u JOIN hashed USING (word)),
c AS (SELECT bucket, count(*) FILTER (kind = 'd') AS s, count(*) FILTER (kind = 'b') AS t FROM f GROUP BY bucket),
g AS (
  SELECT bucket, CAST(floor(1000 * ln((CAST(t AS DOUBLE) + 1) * (sum(s) OVER () + 10000.0::DOUBLE) / ((CAST(s AS DOUBLE) + 1) * (sum(t) OVER () + 10000.0::DOUBLE)))) AS BIGINT) AS gain
  FROM c),
x AS (SELECT k, count(*) AS n, sum(gain) AS weight FROM f JOIN g USING (bucket) WHERE kind = 'd' GROUP BY k),
scored AS (
  SELECT doc_id, len(w.w) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
    CAST(coalesce(weight, 0) AS BIGINT) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score
  FROM w LEFT JOIN x USING (k) WHERE kind = 'd'),
ranked AS (SELECT *, CASE WHEN n_words >= 20 THEN row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) END AS r, count(*) FILTER (n_words >= 20) OVER () AS many FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN r <= 10 * many // 100 THEN r END AS rank FROM ranked
"""
