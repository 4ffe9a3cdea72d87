"""Benchmark decontamination with a positional inverted index (operator 1).

Only DataFrame functions. The index holds postings (document, position) of those training tokens that are the rarest
term of some benchmark phrase, by their frequency in the whole corpus; common words are never indexed. A posting
carries its neighbourhood, so that the lists of the phrase's other terms, shifted by their offsets, are intersected where the posting is:
the second rarest term first, then the others. A phrase with a term that the corpus lacks is dropped before any look-up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberline.llm.common import cut, free_name

WINDOW = 10
#: Phrases or terms that are sent to every task at most; beyond, the join shuffles.
SENT_ROWS = 200_000
#: Parts that the rows of a term are dealt to where a join by term shuffles.
SALT = 16
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def word_array(text: str) -> Column:
    """The words of a text, A-Z lower-cased: runs of digits, letters and whatever is beyond ASCII. A null has none."""
    t = F.coalesce(F.col(text), F.lit(""))
    lowered = F.when(F.octet_length(t) == F.char_length(t), F.lower(t)).otherwise(F.translate(t, _UPPER, _LOWER))
    return F.array_remove(F.split(lowered, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def _few(df: DataFrame) -> bool:
    return df.limit(SENT_ROWS + 1).count() <= SENT_ROWS


def _by_term(rows: DataFrame, own: list[str], terms: DataFrame, how: str = "inner") -> DataFrame:
    """rows joined with terms on ``term``. Few terms are sent to every task; beyond, rows of one term are dealt to SALT parts by their columns ``own``."""
    if _few(terms):
        return rows.join(F.broadcast(terms), "term", how)
    dealt = rows.withColumn("salt", F.pmod(F.xxhash64(*own), F.lit(SALT)).cast("int"))
    return dealt.join(terms.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1)))), ["term", "salt"], how).drop("salt")


def _small(df: DataFrame) -> DataFrame:
    """df, marked to be sent to every task if it has few rows."""
    return F.broadcast(df) if _few(df) else df


def phrases(items: DataFrame, key: str = "item_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """(phrase, item): each window of consecutive words of each item, as an array; an item of fewer words is one phrase.

    Items without an id or without words have none; equal phrases of an item count once.
    """
    w = items.select(F.col(key).cast("string").alias("item"), word_array(text).alias("w")).where("item is not null and size(w) > 0")
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - F.lit(window - 1), F.lit(1)))
    return w.select("item", F.explode(F.transform(starts, lambda i: F.slice("w", i, window))).alias("phrase")).distinct()


def inverted_index(docs: DataFrame, terms: DataFrame, reach: int) -> DataFrame:
    """(doc, row, term, pos, at, around): where the terms are in the documents; around: words up to ``reach`` before and after, the term is its at-th.

    docs: doc, row, words; terms: term, small or not.
    """
    tokens = docs.select("doc", "row", "words", F.posexplode("words").alias("pos", "term"))
    first = F.greatest(F.col("pos") - reach, F.lit(0))
    posting = ["doc", "row", "term", "pos", (F.col("pos") - first + 1).alias("at"), F.slice("words", first + 1, F.col("pos") - first + reach + 1).alias("around")]
    wanted = terms.select("term")
    if _few(wanted):  # the neighbourhood is cut out of the text for what is found alone
        return tokens.join(F.broadcast(wanted), "term").select(posting)
    return _by_term(tokens.select(posting), ["doc", "row", "pos"], wanted).select(posting[:4] + ["at", "around"])  # what shuffles is a neighbourhood a token, not a text a token


def frequencies(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, n): how often each of the terms is in the documents; terms that aren't have no row."""
    found = docs.select(F.explode("words").alias("term"))
    if _few(terms):
        return found.join(F.broadcast(terms), "term").groupBy("term").agg(F.count("*").alias("n"))
    return found.groupBy("term").agg(F.count("*").alias("n")).join(terms, "term")  # counted before they meet, so a common term is one row a task


def ranked(wanted: DataFrame, counts: DataFrame) -> DataFrame:
    """(id, phrase, order): of each phrase, if all its terms occur, the offsets (from 0) of its terms from the rarest on."""
    each = wanted.select("id", "phrase", F.posexplode("phrase").alias("offset", "term"))
    known = _by_term(each, ["id", "offset"], cut(counts), "left").groupBy("id").agg(F.first("phrase").alias("phrase"), F.sort_array(F.collect_list(F.struct("n", "offset"))).alias("by"), F.min(F.col("n").isNotNull()).alias("all"))
    return known.where("all").select("id", "phrase", F.col("by.offset").alias("order"))


def phrase_matches(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc, row, id, start, n): every exact occurrence of the phrases (id, phrase); start counts words from 0.

    docs: doc, row (tells apart rows of one document id), words.
    """
    terms = cut(wanted.select(F.explode("phrase").alias("term")).distinct())
    plan = cut(ranked(wanted, frequencies(docs, terms)))
    reach = plan.agg(F.max(F.size("phrase"))).first()[0] or 1
    lookup = plan.select("id", "phrase", "order", F.element_at("phrase", F.element_at("order", 1) + 1).alias("term"), F.element_at("order", 1).alias("offset"), F.element_at("order", F.least(F.lit(2), F.size("order"))).alias("second"))
    index = cut(inverted_index(docs, lookup.select("term").distinct(), reach - 1))
    begin = F.col("at") - F.col("offset")  # place of the phrase's first word within around
    second = F.try_element_at("around", begin + F.col("second")) == F.element_at("phrase", F.col("second") + 1)
    inside = (begin >= 1) & (begin + F.size("phrase") - 1 <= F.size("around"))
    whole = F.slice("around", F.greatest(begin, F.lit(1)), F.size("phrase")) == F.col("phrase")
    met = _by_term(index, ["doc", "row", "pos"], cut(lookup)).where(F.when(inside, second & whole).otherwise(False))
    return met.select("doc", "row", "id", (F.col("pos") - F.col("offset")).alias("start"), F.size("phrase").alias("n"))


def proximity_matches(docs: DataFrame, wanted: DataFrame, slop: int = 20) -> DataFrame:
    """(doc, row, id, start, n): places where all distinct terms of a phrase lie, in any order, within ``slop`` words.

    Each place is found from a posting of the phrase's rarest term; start and n give the words around it that were looked at.
    """
    terms = cut(wanted.select(F.explode("phrase").alias("term")).distinct())
    plan = cut(ranked(wanted, frequencies(docs, terms)))
    lookup = plan.select("id", F.array_distinct("phrase").alias("phrase"), F.element_at("phrase", F.element_at("order", 1) + 1).alias("term"))
    index = cut(inverted_index(docs, lookup.select("term").distinct(), slop - 1))
    views = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("around") - slop + 1)), lambda i: F.size(F.array_except(F.col("phrase"), F.slice("around", i, slop))) == 0)
    met = _by_term(index, ["doc", "row", "pos"], lookup).where(F.array_contains(views, True))
    return met.select("doc", "row", "id", (F.col("pos") - F.col("at") + 1).alias("start"), F.size("around").alias("n"))


def _rows(df: DataFrame, key: str, text: str) -> DataFrame:
    return df.select(F.col(key).alias("doc"), F.xxhash64(key, text).alias("row"), word_array(text).alias("words"))


def _matches(df: DataFrame, items: DataFrame, key: str, text: str, item_key: str, item_text: str, window: int) -> tuple[DataFrame, DataFrame]:
    """The items' phrases, and where they occur."""
    of_item = cut(phrases(items, item_key, item_text, window).select("phrase", "item"))
    wanted = of_item.select(F.sha2(F.array_join("phrase", " "), 256).alias("id"), "phrase").distinct()
    return of_item, cut(phrase_matches(_rows(df, key, text), wanted).distinct())


def without_contaminated(df: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """The rows of df in whose text no benchmark window occurs."""
    _, met = _matches(df, items, key, text, item_key, item_text, window)
    doc, row = free_name(df, "hit_doc"), free_name(df, "hit_row")
    hit = met.select(F.col("doc").alias(doc), F.col("row").alias(row)).distinct()
    return df.join(hit, F.col(key).eqNullSafe(F.col(doc)) & (F.xxhash64(F.col(key), F.col(text)) == F.col(row)), "left_anti")


def contamination(df: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """(key, n_words, n_hit, n_items, items_sha256, contaminated), one row per row of df.

    n_hit: words inside any occurrence of a benchmark window; n_items: items with an occurring window; items_sha256: digest of
    their ids, sorted as strings and joined by commas. A null or empty text has no words; a row without an id is judged like any other.
    Rows that are equal are one document with one result each. An empty benchmark hits nothing. A very long text is read whole: its words
    are one array. Columns of df besides key and text aren't read, whatever their names.
    """
    of_item, met = _matches(df, items, key, text, item_key, item_text, window)
    spans = met.groupBy("doc", "row").agg(F.sort_array(F.collect_set(F.struct("start", (F.col("start") + F.col("n")).alias("stop")))).alias("spans"))
    covered = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("upto")),
        lambda a, s: F.struct((a["n"] + F.greatest(F.lit(0), s["stop"] - F.greatest(a["upto"], s["start"]))).alias("n"), F.greatest(a["upto"], s["stop"]).alias("upto")),
    )["n"]
    named = of_item.select(F.sha2(F.array_join("phrase", " "), 256).alias("id"), "item")
    ids = met.select("doc", "row", "id").distinct().join(_small(named), "id").groupBy("doc", "row").agg(F.sort_array(F.collect_set("item")).alias("items"))
    hits = spans.select("doc", "row", covered.cast("long").alias("n_hit")).join(ids.withColumnsRenamed({"doc": "doc2", "row": "row2"}), F.col("doc").eqNullSafe(F.col("doc2")) & (F.col("row") == F.col("row2"))).select(F.col("doc").alias("doc2"), F.col("row").alias("row2"), "n_hit", "items")
    all_docs = _rows(df, key, text).select("doc", "row", F.size("words").cast("long").alias("n_words"))
    out = all_docs.join(hits, F.col("doc").eqNullSafe(F.col("doc2")) & (F.col("row") == F.col("row2")), "left")
    n_hit = F.coalesce("n_hit", F.lit(0))
    return out.select(F.col("doc").alias(key), "n_words", n_hit.alias("n_hit"), F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"), F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


ORACLE = r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM benchmark WHERE item_id IS NOT NULL),
p AS (
  SELECT DISTINCT item_id, array_to_string(w[i:i + 9], ' ') AS phrase, least(len(w), 10) AS n
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM p),
d AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS phrase
  FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM w CROSS JOIN sizes WHERE len(w) >= n)),
m AS (SELECT d.doc_id, d.i, d.n, p.item_id FROM d JOIN p ON d.phrase = p.phrase AND d.n = p.n),
h AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS k FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM m) GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN h ON w.doc_id = h.doc_id LEFT JOIN t ON w.doc_id = t.doc_id
"""
