"""Spelling variants: words one edit apart, from a positional inverted index of q-grams (operator 11).

Words are counted where they are read. A word of L letters, with m marks at each end, has L + 2m + 1 - q grams, of which one edit spoils at most q; so words one edit apart share all
others, at places that differ by at most one, and a word's q + 1 rarest grams hold one of those. Only under these is a word indexed, by gram, place and length, and looked up, at the places and
lengths that one inserted letter leaves. Words that meet are told apart by all their grams: posting lists are merged on a heap, and those words stay that reach the
overlap that one edit leaves at least. A comparison of letters confirms each.
"""

from __future__ import annotations

import heapq
import math
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.llm.common import cut

#: Words of one place of the index that a task holds at a time; a larger place is split into pairs of blocks of so many.
BLOCK = 2_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: The mark at both ends of a word, no letter of any.
_END = "\x01"


def word_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", slip: int = 199, least_letters: int = 6, least_count: int = 5) -> DataFrame:
    """word, n: words of whole texts with enough letters and occurrences; a run whose number is divisible by ``slip`` loses a letter first. Tasks count before they shuffle."""
    runs = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("k"), F.explode(F.regexp_extract_all(F.translate(text, _UPPER, _LOWER), F.lit("[a-zÀ-ÿ]+"), F.lit(0))).alias("w"))
    h = F.crc32(F.concat_ws(":", "k", "w").cast("binary"))
    n, at = F.char_length("w"), (F.col("h") % F.char_length("w")).cast("int")
    slipped = F.concat(F.col("w").substr(F.lit(1), at), F.col("w").substr(at + 2, n))
    words = runs.withColumn("h", h).select(F.when(F.col("h") % slip == 0, slipped).otherwise(F.col("w")).alias("word"))
    return words.where(F.char_length("word") >= least_letters).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


# --- the index ----------------------------------------------------------------------------------


def _grams(word: Column, q: int, marks: int) -> Column:
    """(place, gram) of all grams of a word with its marks."""
    marked = F.concat(F.lit(_END * marks), word, F.lit(_END * marks))
    return F.transform(F.sequence(F.lit(1), F.char_length(word) + 2 * marks + 1 - q), lambda i: F.struct(i.alias("place"), marked.substr(i, F.lit(q)).alias("gram")))


def _rarest(vocabulary: DataFrame, q: int, marks: int) -> DataFrame:
    """word, n, rare: the places of each word's q + 1 rarest grams, the rarest first; grams of one count by their letters, then by place."""
    grams = vocabulary.select("word", "n", F.explode(_grams(F.col("word"), q, marks)).alias("g")).select("word", "n", "g.place", "g.gram")
    ranked = grams.join(grams.groupBy("gram").agg(F.count("*").alias("often")), "gram")
    return ranked.groupBy("word", "n").agg(F.transform(F.slice(F.array_sort(F.collect_list(F.struct("often", "gram", "place"))), 1, q + 1), lambda x: x["place"]).alias("rare"))


def _units(rare: DataFrame, q: int, marks: int, block: int) -> DataFrame:
    """Units of work: an array ``held`` of indexed words, an array ``asking`` of words that look for them, and whether those held also meet each other (``inner``).

    A place of the index is a gram, its place and the length of the words. Words of the place's own length that meet there are a unit's ``held``, which also meet each
    other; ``asking`` are words one letter shorter, and in a split place the words of other blocks. An entry is a word, its n and its places, with blanks between.
    """
    length = F.char_length("word")
    marked = F.concat(F.lit(_END * marks), F.col("word"), F.lit(_END * marks))
    entry = F.concat_ws(" ", "word", "n", F.array_join("rare", " "))
    at = rare.select("word", entry.alias("entry"), length.alias("length"), F.explode("rare").alias("place")).withColumn("gram", marked.substr(F.col("place"), F.lit(q))).drop("word")
    held = at.withColumn("role", F.lit(0))
    asking = at.withColumn("length", F.col("length") + 1).withColumn("place", F.explode(F.array("place", F.col("place") + 1))).withColumn("role", F.lit(1))
    rows = held.unionByName(asking)
    place = ["gram", "place", "length"]
    crowded = rows.groupBy(*place).agg(F.count("*").alias("size")).where(F.col("size") > block).select(*place, F.ceil(F.col("size") / block).cast("int").alias("blocks"))
    rows = rows.join(crowded, place, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    mine, every = F.pmod(F.xxhash64("entry", "role"), F.col("blocks")).cast("int"), F.sequence(F.lit(0), F.col("blocks") - 1)
    # A unit (a, b) holds block b; its asking words are block a of the shorter words and, where a < b, block a of the held ones.
    as_held = F.transform(every, lambda a: F.struct(a.alias("a"), mine.alias("b"), F.lit(0).alias("side")))
    as_asking = F.transform(every, lambda b: F.struct(mine.alias("a"), b.alias("b"), F.lit(1).alias("side")))
    met = F.filter(as_asking, lambda u: (F.col("role") == 1) | (u["b"] > u["a"]))
    met = F.transform(met, lambda u: F.struct(u["a"].alias("a"), u["b"].alias("b"), F.lit(1).alias("side")))
    rows = rows.withColumn("u", F.explode(F.when(F.col("role") == 0, F.concat(as_held, met)).otherwise(met)))
    units = rows.groupBy(*place, "u.a", "u.b").agg(*[F.collect_list(F.when(F.col("u.side") == side, F.col("entry"))).alias(name) for side, name in ((0, "held"), (1, "asking"))])
    return units.where((F.size("held") > 0) & (F.size("held") + F.size("asking") > 1)).select(*place, "held", "asking", (F.col("a") == F.col("b")).alias("inner"))


def merge_postings(lists: list[list[int]], least: int) -> Iterator[int]:
    """Numbers in at least ``least`` of the sorted lists, in order.

    Such a number is in one of all lists but the ``least`` - 1 longest. Those others are merged on a heap, and what comes up is looked for in the longest by halving, as long as enough of
    them are left.
    """
    lists = sorted(filter(None, lists), key=len)
    several = len(lists) - least + 1
    if several < 1:
        return
    longest = lists[several:]
    for number, same in groupby(heapq.merge(*lists[:several]) if several > 1 else lists[0]):
        missing, left = least - len(list(same)), len(longest)
        for x in longest:
            if missing < 1 or missing > left:
                break
            at = bisect_left(x, number)
            missing -= at < len(x) and x[at] == number
            left -= 1
        if missing < 1:
            yield number


def one_edit(a: str, b: str) -> bool:
    """Whether the words differ by exactly one inserted, deleted or replaced letter."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


class _Word:
    __slots__ = ("word", "n", "grams", "places")

    def __init__(self, said: str, q: int, ends: str):
        self.word, self.n, *self.places = said.split(" ")
        marked = ends + self.word + ends
        self.grams = [(marked[i : i + q], i + 1) for i in range(len(marked) - q + 1)]

    def rare(self) -> list[tuple[str, int]]:
        return [self.grams[int(p) - 1] for p in self.places]


def _first_meeting(a: _Word, b: _Word) -> tuple[str, int] | None:
    """The first place of the index, by a's rarest grams, at which a meets b, which isn't shorter."""
    there = set(b.rare())
    for gram, place in a.rare():
        for p in (place,) if len(a.word) == len(b.word) else (place, place + 1):
            if (gram, p) in there:
                return gram, p
    return None


def _near_in_unit(here: tuple[str, int], length: int, inner: bool, held: list[str], asking: list[str], q: int, marks: int) -> Iterator[tuple[_Word, _Word]]:
    """Pairs of near words of a unit, each only where its words meet first."""
    ends = _END * marks
    indexed = [_Word(x, q, ends) for x in sorted(held)]
    postings = defaultdict(list)
    for k, x in enumerate(indexed):
        for g in x.grams:
            postings[g].append(k)
    least = max(1, length + 2 * marks + 1 - 2 * q)  # grams of the longer word that one edit leaves
    # a word asks twice at one place if its rarest grams hold one gram at two places in a row
    for a, below in [(_Word(x, q, ends), len(indexed)) for x in dict.fromkeys(asking)] + ([(x, k) for k, x in enumerate(indexed) if k] if inner else []):
        lists = [x for g in a.grams if (x := postings.get(g))]
        if len(a.word) < length:
            lists += [x for gram, place in a.grams if (x := postings.get((gram, place + 1)))]
        if len(lists) < least:
            continue
        for k in merge_postings(lists, least):
            if k >= below:
                break
            b = indexed[k]
            # of two words of one length the smaller asks, so that both orders name one place
            one, two = (a, b) if len(a.word) < len(b.word) or a.word < b.word else (b, a)
            if one_edit(one.word, two.word) and _first_meeting(one, two) == here:
                yield one, two


def near_words(vocabulary: DataFrame, least_letters: int = 0, q: int = 3, block: int = BLOCK) -> DataFrame:
    """word, n, other, other_n: all pairs of words of a table (word, n) that are one edit apart, each once. No word has fewer than ``least_letters``; the shorter they may be, the more marks."""
    marks = max(1, q - least_letters // 2)
    units = _units(cut(_rarest(vocabulary, q, marks)), q, marks, block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for i in range(0, batch.num_rows, 256):  # units hold at most two blocks each
                part = [c.to_pylist() for c in batch.slice(i, 256).columns]
                found += [(a.word, int(a.n), b.word, int(b.n)) for gram, place, length, held, asking, inner in zip(*part) for a, b in _near_in_unit((gram, place), length, inner, held, asking, q, marks)]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*found), (pa.string(), pa.int64()) * 2)], names=["word", "n", "other", "other_n"])

    return units.mapInArrow(run, "word string, n long, other string, other_n long")


def variants(vocabulary: DataFrame, times: int = 5, least_letters: int = 0, q: int = 3, block: int = BLOCK) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of a table (word, n) of distinct words of ``least_letters`` or more.

    A word's form is its commonest near word (ties: the first in code-point order) if that is ``times`` as common as the word; its root is where forms lead to at last. Words without near
    words have n_near 0 and are their own root. An empty table gives no rows; null words are dropped. Forms grow ``times`` as common at each step, so chains are short and have no
    cycle; they are followed in leaps that double.
    """
    vocabulary = cut(vocabulary.select("word", "n").where(F.col("word").isNotNull()))
    pairs = near_words(vocabulary, least_letters, q, block)
    both = pairs.unionByName(pairs.select(F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n")))
    best = F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("form")))
    near = cut(both.groupBy("word", "n").agg(F.count("*").alias("n_near"), best.alias("best")))
    formed = -F.col("best.less") >= times * F.col("n")
    near = near.select("word", "n_near", F.when(formed, F.col("best.form")).alias("form"), F.when(formed, -F.col("best.less")).alias("form_n"))
    links = near.where(F.col("form").isNotNull()).select("word", F.col("form").alias("root"))
    most = vocabulary.agg(F.max("n")).first()[0] or 1
    for _ in range(math.ceil(math.log2(max(2, math.log(max(most, 2), times) + 1)))):  # a chain has at most log(most) links
        on = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        links = cut(links.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root")))
    return vocabulary.join(near, "word", "left").join(links, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n"
    )


def spelling_variants(docs: DataFrame, key: str = "doc_id", text: str = "text", slip: int = 199, least_letters: int = 6, least_count: int = 5, times: int = 5) -> DataFrame:
    """variants() of the words of all whole texts.

    Runs of Latin letters (A to z, U+00C0 to U+00FF) are words, A-Z lower-cased; by a number of key and word, one of ``slip`` runs loses a letter. A null text has no words, a null key counts
    as an empty text, repeated rows count each, very long texts and words are taken whole, and other columns don't matter.
    """
    return variants(word_counts(docs, key, text, slip, least_letters, least_count), times, least_letters)


# Near words share what is left of them without one letter. The CRC of each run goes through a table of 256 numbers, a byte at a time.
ORACLE = r"""
WITH RECURSIVE crc_table AS (
  SELECT list(c ORDER BY b) AS t FROM (
    SELECT b, list_reduce(list_prepend(b, [0, 1, 2, 3, 4, 5, 6, 7]), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
    FROM (SELECT CAST(unnest(range(256)) AS BIGINT) AS b))),
runs AS (
  SELECT k, w, count(*) AS n FROM (
    SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS k, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS w FROM documents)
  GROUP BY k, w),
hashed AS (
  SELECT w, n, length(w) AS l, xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(CAST(length(x) / 2 AS BIGINT)), lambda i: CAST('0x' || substr(x, 2 * i + 1, 2) AS BIGINT))),
    lambda c, y: xor(t[(xor(c, y) & 255) + 1], c >> 8))) AS h
  FROM (SELECT w, n, hex(encode(k || ':' || w)) AS x FROM runs) CROSS JOIN crc_table),
v AS MATERIALIZED (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (SELECT n, CASE WHEN h % 199 = 0 THEN w[:h % l] || w[h % l + 2:] ELSE w END AS word FROM hashed)
  WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
d AS (SELECT word, n, i, word[:i - 1] || word[i + 1:] AS rest FROM (SELECT word, n, unnest(generate_series(1, length(word))) AS i FROM v)),
near AS MATERIALIZED (
  SELECT a.word, a.n, b.word AS other, b.n AS other_n FROM d a JOIN d b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT d.word, d.n, v.word, v.n FROM d JOIN v ON d.rest = v.word
  UNION SELECT v.word, v.n, d.word, d.n FROM d JOIN v ON d.rest = v.word),
f AS MATERIALIZED (
  SELECT word, n, count(*) AS n_near, max(other_n) AS most, min(other) FILTER (other_n = top) AS form
  FROM (SELECT *, max(other_n) OVER (PARTITION BY word) AS top FROM near) GROUP BY word, n),
links AS (SELECT word, form, most AS form_n FROM f WHERE most >= 5 * n),
chain AS (
  SELECT word, form AS root FROM links
  UNION ALL SELECT chain.word, links.form FROM chain JOIN links ON chain.root = links.word),
roots AS (SELECT word, root FROM chain WHERE root NOT IN (SELECT word FROM links))
SELECT v.word, links.form, coalesce(roots.root, v.word) AS root, v.n, CAST(coalesce(f.n_near, 0) AS BIGINT) AS n_near, links.form_n
FROM v LEFT JOIN f ON v.word = f.word LEFT JOIN links ON v.word = links.word LEFT JOIN roots ON v.word = roots.word
"""
