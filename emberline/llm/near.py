"""Near-duplicate documents by SetSketch (operator 3).

A document's set holds its distinct word shingles. Its sketch has REGISTERS registers; each is the
smallest of one exponentially distributed hash over the set, on an exponentially spaced scale and
truncated, so that sketches of parts merge by maximum and registers of similar sets agree. Bands of
register values bring candidates together; the joint likelihood of two sketches estimates their
similarity; what may reach the threshold is verified on the full sets.

Identical sets are one class from the start. In each bucket of a band all classes are compared with
the bucket's smallest and largest one (two stars, no pairs within the bucket); then, where the buckets still
hold several components, the members outside the largest are compared with the others. A bucket of
linked copies thus costs as many comparisons as it has members.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberline.llm.common import cut, flat_utf8, free_name, mix, span_hashes, steps, words

BANDS, ROWS = 40, 5
REGISTERS = BANDS * ROWS
#: Base of the register scale, its rate, and its largest value: 2 bytes a register.
BASE, RATE, LARGEST = 1.001, 20.0, (1 << 16) - 1
#: Register bits whose number of differences bounds the similarity before any register is compared.
PARITY_WORDS = 3
#: Bits that count, modulo 2, the shingles that fall to each: two sets differ in at least as many shingles as in bits.
ODD_WORDS = 16
_BITS = [f"p{k}" for k in range(PARITY_WORDS)] + [f"q{k}" for k in range(ODD_WORDS)]
#: An estimate has a standard deviation of 0.03 at a similarity of 0.8; pairs below the threshold less this are dropped.
MARGIN = 0.2
_FACTORS = mix(np.arange(1, REGISTERS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def shingles(buf: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of each text (repeats included), and the n + 1 places where each text's begin.

    With fewer words than size the whole sequence is the one shingle; without words there is none.
    """
    starts, ends, first = words(buf, offsets)
    h = span_hashes(buf, starts, ends)
    n = np.diff(first)
    count = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    at = np.r_[0, np.cumsum(count)]
    begin = np.repeat(first[:-1] - at[:-1], count) + np.arange(at[-1])
    left = np.repeat(np.minimum(n, size), count)
    out = h[begin] if len(h) else np.empty(0, np.uint64)
    for k in range(1, size):
        more = left > k
        out[more] = mix(out[more] * np.uint64(0xD1342543DE82EF95) + h[begin[more] + k] + np.uint64(k))
    return mix(out + left.astype(np.uint64)), at


def registers(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sketches of the non-empty sets hashes[at[k]:at[k + 1]], one row each."""
    out = np.empty((len(at) - 1, REGISTERS), np.float64)
    for j, factor in enumerate(_FACTORS):
        out[:, j] = np.minimum.reduceat(hashes * factor, at[:-1])
    least = -np.log1p(-(out + 0.5) * 2.0**-64)  # of uniform hashes to exponential ones
    return np.clip(np.floor(1 - np.log(np.maximum(least, 1e-300) / RATE) / np.log(BASE)), 0, LARGEST).astype(np.uint16)


def _print(own: np.ndarray, k: int) -> int:
    """One of the fingerprints of a set."""
    return int(mix(own ^ _FACTORS[k]).sum(dtype=np.uint64).view(np.int64))


def sketch(docs: DataFrame, size: int) -> DataFrame:
    """(key, n, f1, f2, regs, bands, p0.., q0..) of each document. docs: key, text.

    n: size of the set; f1, f2: a fingerprint of the set; p: the lowest bits of registers; q: odd counts of shingles.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = flat_utf8(batch.column(1))
            for i, j in steps(offsets):
                part, at = buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                h, at = shingles(part, at, size)
                sets = [np.unique(h[a:b]) for a, b in zip(at.tolist(), at[1:].tolist())]
                n = np.array([len(x) for x in sets], np.int64)
                flat, full = np.concatenate(sets), np.flatnonzero(n)
                begin = np.r_[0, np.cumsum(n[full])]
                regs = np.zeros((j - i, REGISTERS), np.uint16)
                prints = np.zeros((2, j - i), np.int64)
                if len(full):
                    regs[full] = registers(flat, begin)
                    for k in range(2):  # as _print(), for all sets at once
                        prints[k, full] = np.add.reduceat(mix(flat ^ _FACTORS[k]), begin[:-1]).view(np.int64)
                wide = regs.astype(np.uint64)
                band = np.zeros((j - i, BANDS), np.uint64)
                for k in range(ROWS):
                    band = mix(band * np.uint64(0xD1342543DE82EF95) + wide[:, k::ROWS] + np.uint64(1))
                band = mix(band + np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                bits = np.packbits((regs[:, : 64 * PARITY_WORDS] & 1).astype(np.uint8), axis=1).view(np.int64)
                of_bit = np.repeat(np.arange(j - i), n) * (64 * ODD_WORDS) + (mix(flat + np.uint64(7)) >> np.uint64(32)).astype(np.int64) % (64 * ODD_WORDS)
                odd = np.packbits((np.bincount(of_bit, minlength=(j - i) * 64 * ODD_WORDS) & 1).astype(np.uint8).reshape(j - i, -1), axis=1).view(np.int64)
                bits = np.concatenate([bits, odd], 1)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(i, j - i), pa.array(n), pa.array(prints[0]), pa.array(prints[1]), pa.array([x.tobytes() for x in regs], pa.binary()),
                        pa.ListArray.from_arrays(pa.array(np.arange(0, (j - i + 1) * BANDS, BANDS, dtype=np.int32)), pa.array(band.view(np.int64).ravel())),
                        *(pa.array(np.ascontiguousarray(bits[:, k])) for k in range(len(_BITS))),
                    ],
                    names=["key", "n", "f1", "f2", "regs", "bands", *_BITS],
                )

    return docs.mapInArrow(run, "key long, n long, f1 long, f2 long, regs binary, bands array<long>, " + ", ".join(f"{b} long" for b in _BITS))


def _gain(x: np.ndarray) -> np.ndarray:
    return -np.log1p(-x * (BASE - 1) / BASE) / np.log(BASE)


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """The Jaccard similarities that make the numbers of greater, smaller and equal registers likeliest, given the sets' sizes."""
    more, less = (a > b).sum(1), (a < b).sum(1)
    same = a.shape[1] - more - less
    u, v = na / (na + nb), nb / (na + nb)
    low, high = np.zeros(len(na)), np.minimum(u / v, v / u)

    def likely(j: np.ndarray) -> np.ndarray:
        p, q = (np.maximum(_gain(np.maximum(x, 0)), 1e-12) for x in (u - v * j, v - u * j))
        return more * np.log(p) + less * np.log(q) + same * np.log(np.maximum(1 - p - q, 1e-12))

    for _ in range(40):  # the likelihood is concave: ternary search
        x, y = low + (high - low) / 3, high - (high - low) / 3
        left = likely(x) < likely(y)
        low, high = np.where(left, x, low), np.where(left, high, y)
    return (low + high) / 2


def _possible(a: str, b: str, percent: int) -> Column:
    """Sizes and bits allow the similarity. Sizes and odd counts exclude it for sure.

    Bits of unequal registers differ half the time, so at 0.8 19 of 192 differ, with a deviation of 4.2; 7 deviations are allowed.
    """
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    differ = [F.bit_count(F.col(f"{a}.{k}").bitwiseXOR(F.col(f"{b}.{k}"))) for k in _BITS]
    mean = 64 * PARITY_WORDS * (100 - percent) / 200
    parity, odd = sum(differ[1:PARITY_WORDS], differ[0]), sum(differ[PARITY_WORDS + 1 :], differ[PARITY_WORDS])
    return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & (parity <= int(mean + 7 * max(1.0, mean) ** 0.5)) & ((100 + percent) * odd <= (100 - percent) * (n + m))


def _not_met(a: str, b: str) -> Column:
    """The member a is not one of the two that the bucket's members were compared with."""
    return (F.col(f"{a}.key") != F.col(f"{b}.hub")) & (F.col(f"{a}.key") != F.col(f"{b}.other"))


def _verified(pairs: DataFrame, sketches: DataFrame, docs: DataFrame, percent: int, size: int) -> DataFrame:
    """The pairs (a, b) of classes whose sets are similar enough: by estimate, then on the full sets."""
    regs = sketches.select("key", "n", "regs")
    wide = pairs.join(regs.toDF("a", "na", "ra"), "a").join(regs.toDF("b", "nb", "rb"), "b")

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                ra, rb = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint16).reshape(-1, REGISTERS) for k in ("ra", "rb"))
                j = estimate(ra, rb, np.asarray(batch.column("na")).astype(float), np.asarray(batch.column("nb")).astype(float))
                yield batch.select(["a", "b", "na", "nb"]).filter(pa.array(j >= percent / 100 - MARGIN))

    likely_pairs = cut(wide.select("a", "b", "na", "nb", "ra", "rb").mapInArrow(likely, "a long, b long, na long, nb long"))
    ends = likely_pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    wanted = sketches.select("key", "f1").join(ends, "key")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offsets = flat_utf8(batch.column(1))
            for i, j in steps(offsets):
                h, at = shingles(buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], size)
                own = [np.unique(h[a:b]) for a, b in zip(at.tolist(), at[1:].tolist())]
                meant = pa.array([_print(x, 0) == f for x, f in zip(own, batch.column(2).slice(i, j - i).to_pylist())], pa.bool_())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array([x.tobytes() for x in own], pa.binary())], names=["key", "set"]).filter(meant)

    full = cut(docs.join(wanted, "key").select("key", "text", "f1").mapInArrow(sets, "key long, set binary"))
    both = likely_pairs.join(full.toDF("a", "sa"), "a").join(full.toDF("b", "sb"), "b")

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("sa"), batch.column("sb")):
                x, y = (np.frombuffer(z.as_buffer(), np.uint64) for z in (x, y))
                at = np.searchsorted(x, y)
                common = int(np.count_nonzero(x[np.minimum(at, len(x) - 1)] == y))
                keep.append(100 * common >= percent * (len(x) + len(y) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "sa", "sb").mapInArrow(exact, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(key, label): of each end of a link (a, b) the smallest key that it is connected with.

    In each round every vertex's neighbours and itself join the smallest among them, and labels are followed one
    step further; the tables are cut after each round, and the number of rounds follows the logarithm of a component's width.
    """
    edges = cut(links.select("a", "b").union(links.select("b", "a")).distinct())
    labels = cut(edges.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")).withColumnRenamed("a", "key"))
    while True:
        seen = edges.join(labels.toDF("b", "near"), "b").groupBy("a").agg(F.min("near").alias("near"))
        low = labels.join(seen.toDF("key", "near"), "key", "left").select("key", "label", F.least("label", F.coalesce("near", "label")).alias("low"))
        low = cut(low)
        jumped = low.join(low.select(F.col("key").alias("low"), F.col("low").alias("next")), "low", "left").select("key", F.least("low", F.coalesce("next", "low")).alias("label"), F.col("label").alias("old"))
        # a label is also passed on to the vertex that named it before, so that long chains join early
        back = jumped.where("label < old").groupBy(F.col("old").alias("key")).agg(F.min("label").alias("down"))
        new = cut(jumped.join(back, "key", "left").select("key", F.least("label", F.coalesce("down", "label")).alias("label"), "old"))
        labels = new.select("key", "label")
        if new.where("label < old").isEmpty():
            return labels


def _components_of(df: DataFrame, key: str, text: str, size: int, percent: int) -> DataFrame:
    """(key, n, component) of every id; keys are integers."""
    docs = df.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    known = docs.where("key is not null")
    every = cut(sketch(known, size))
    one = every.groupBy("key").agg(F.max_by(F.struct("n", "f1", "f2"), F.struct("n", "f1", "f2")).alias("x")).select("key", "x.*")
    one = cut(one)
    classes = cut(one.where("n > 0").groupBy("n", "f1", "f2").agg(F.min("key").alias("class")))
    leads = every.join(classes.select(F.col("class").alias("key"), "n", "f1", "f2"), ["key", "n", "f1", "f2"]).dropDuplicates(["key"])
    leads = cut(leads)
    rows = leads.select(F.explode("bands").alias("band"), "key")
    shared = cut(rows.groupBy("band").agg(F.count("*").alias("size"), F.min("key").alias("hub"), F.max("key").alias("other")).where("size > 1").select("band", "hub", "other"))
    members = cut(rows.join(shared, "band"))
    bits = leads.select("key", "n", *_BITS)
    first = members.select("key", F.explode(F.array("hub", "other")).alias("hub")).where("key != hub").select(F.least("hub", "key").alias("hub"), F.greatest("hub", "key").alias("key")).distinct()
    first = first.alias("m").join(bits.alias("y"), F.col("m.key") == F.col("y.key")).join(bits.alias("x"), F.col("m.hub") == F.col("x.key")).where(_possible("x", "y", percent)).select(F.col("x.key").alias("a"), F.col("y.key").alias("b"))
    links = cut(_verified(first, leads, known, percent, size))
    labels = components(links)
    placed = members.join(labels, "key", "left").withColumn("label", F.coalesce("label", "key"))
    placed = cut(placed)
    # the component with most members in a bucket; buckets with no other are done
    per = placed.groupBy("band", "label").agg(F.count("*").alias("c")).groupBy("band").agg(F.max_by("label", F.struct("c", "label")).alias("main"), F.count("*").alias("several")).where("several > 1").select("band", "main")
    open_ = cut(placed.join(cut(per), "band").join(bits, "key"))
    x, y = open_.where("label != main").alias("x"), open_.alias("y")
    apart = (F.col("x.label") != F.col("y.label")) & ((F.col("y.label") == F.col("y.main")) | (F.col("x.key") < F.col("y.key"))) & _not_met("x", "y") & _not_met("y", "x")
    rest = x.join(y, (F.col("x.band") == F.col("y.band")) & apart & _possible("x", "y", percent)).select(F.least("x.key", "y.key").alias("a"), F.greatest("x.key", "y.key").alias("b")).distinct()
    more = _verified(rest, leads, known, percent, size)
    labels = components(cut(links.union(more)))
    named = cut(classes.join(labels.toDF("class", "label"), "class", "left").select("n", "f1", "f2", F.coalesce("label", "class").alias("component")))
    return one.join(named, ["n", "f1", "f2"], "left").select("key", "n", F.coalesce("component", "key").alias("component"))


def _placed(df: DataFrame, key: str, text: str, size: int, percent: int) -> DataFrame:
    """(id, n, component) of every id, the component being its smallest id; ids that aren't integers go by a 64-bit hash meanwhile."""
    if isinstance(df.schema[key].dataType, T.IntegralType):
        return _components_of(df, key, text, size, percent).withColumnRenamed("key", "id")
    some = df.select(F.col(key).alias("id"), F.col(text).alias("text")).where("id is not null").withColumn("key", F.xxhash64("id"))
    placed = cut(some.select("id", "key").distinct().join(_components_of(some, "key", "text", size, percent), "key"))
    least = placed.groupBy("component").agg(F.min("id").alias("first"))
    return placed.join(least, "component").select("id", "n", F.col("first").alias("component"))


def near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """(key, n_shingles, component_id, kept), one row per document.

    Documents are linked when 100 * intersection >= percent * union of their sets of shingles of ``size`` words
    (ASCII white space between words, A-Z lower-cased); component_id is the smallest id reachable over links, and the
    document of that id is kept. With fewer words than size the whole sequence is one shingle; texts without words, and null
    ones, have empty sets and no links. Of rows with one id the one with the larger set (then fingerprint) stands for the id,
    and rows without an id are left out of the search: each is a component of its own, with a null component_id, and kept. Ids may be
    numbers or texts. A very long text counts whole; columns of df besides key and text aren't read, whatever their names.
    A pair at the threshold shares a band with a probability of 1 - 1.2e-7.
    """
    out = df.select(F.col(key).alias("id")).join(_placed(df, key, text, size, percent), "id", "left")
    return out.select(F.col("id").alias(key), F.coalesce("n", F.lit(0)).alias("n_shingles"), F.col("component").alias("component_id"), F.coalesce(F.col("component") == F.col("id"), F.lit(True)).alias("kept"))


def without_near_duplicates(df: DataFrame, key: str = "doc_id", text: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """The rows of df that near_duplicates() keeps."""
    gone, name = _placed(df, key, text, size, percent).where("component != id"), free_name(df, "gone")
    return df.join(gone.select(F.col("id").alias(name)), F.col(key) == F.col(name), "left_anti")


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, shingle FROM (
    SELECT doc_id, unnest(CASE WHEN len(w) < 2 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS shingle FROM w)),
c AS (SELECT doc_id, count(*) AS n, md5(string_agg(shingle, chr(10) ORDER BY shingle)) AS print FROM s GROUP BY doc_id),
leads AS (SELECT min(doc_id) AS lead, any_value(n) AS n, print FROM c GROUP BY print),
own AS (SELECT lead, n, shingle FROM leads JOIN s ON s.doc_id = lead),
p AS (
  SELECT a.lead AS a, b.lead AS b, any_value(a.n + b.n) AS both_n, count(*) AS common FROM own a JOIN own b ON a.shingle = b.shingle AND a.lead < b.lead
  WHERE 100 * a.n >= 80 * b.n AND 100 * b.n >= 80 * a.n GROUP BY a.lead, b.lead),
e AS (SELECT a, b FROM p WHERE 100 * common >= 80 * (both_n - common)),
edges AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach(x, y) AS (SELECT lead, lead FROM leads UNION SELECT reach.x, edges.b FROM reach JOIN edges ON reach.y = edges.a),
comp AS (SELECT x AS lead, min(y) AS component FROM reach GROUP BY x)
SELECT d.doc_id, coalesce(c.n, 0) AS n_shingles, coalesce(component, d.doc_id) AS component_id, coalesce(component, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN c ON d.doc_id = c.doc_id LEFT JOIN leads ON c.print = leads.print LEFT JOIN comp ON leads.lead = comp.lead
"""
