"""Resolution of not-modified revisits in web archives (operator 8).

A revisit record (a 304 answer) has no body. It is joined to the latest earlier full response of the same canonical URL;
its validators must agree with that response's, and the headers that a 304 answer may update are merged into the stored ones.

The as-of join takes one pass of windows over (URL, slice of time) and a second over one row per slice, so that an
address with very many captures is spread over as many tasks as it has slices. Bodies don't take part; they
are fetched by record id when they are wanted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Width of the slices of time.
SLICE = 1 << 15
#: Headers that a not-modified answer may bring up to date.
UPDATED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
#: Query parameters that don't tell pages apart.
TRACKING = r"^(utm_[a-z]+|ref)="


def canonical_url(url: Column) -> Column:
    """Host in lower case without ``www.`` and default port, path without final slashes, sorted query without tracking; no scheme, no fragment."""
    rest = F.regexp_replace(F.regexp_replace(url, "#.*$", ""), "^[A-Za-z]+://", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(rest, "^([^/?]*)", 1)), r"^www\.", ""), ":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(rest, r"^[^/?]*([^?]*)", 1), "/+$", "")
    query = F.array_join(F.array_sort(F.filter(F.split(F.regexp_extract(rest, r"\?(.*)$", 1), "&"), lambda p: (p != "") & ~F.regexp_like(p, F.lit(TRACKING)))), "&")
    return F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def latest_before(left: DataFrame, right: DataFrame, value: str, by: str = "url", at: str = "ts", width: int = SLICE) -> DataFrame:
    """left with ``value`` of the row of right that has the same ``by`` and the largest ``at`` before left's, then the largest value; null without one.

    ``value`` is a struct column of right that begins with its ``at``. Rows of left without ``by`` or ``at`` find nothing.
    """
    slice_ = F.floor(F.col(at) / width)
    early = right.where(F.col(by).isNotNull() & F.col(at).isNotNull()).select(by, at, slice_.alias("__slice"), value)
    own = left.withColumn("__slice", slice_)
    kept = early.select(by, at, "__slice", F.col(value).alias("__right"), *[F.lit(None).cast(own.schema[c].dataType).alias(f"__{c}") for c in left.columns])
    asking = own.select(by, at, "__slice", F.lit(None).cast(right.schema[value].dataType).alias("__right"), *[F.col(c).alias(f"__{c}") for c in left.columns])
    both = kept.withColumn("__asks", F.lit(False)).unionByName(asking.withColumn("__asks", F.lit(True)))
    near = Window.partitionBy(by, "__slice").orderBy(at).rangeBetween(Window.unboundedPreceding, -1)
    found = both.withColumn("__near", F.max("__right").over(near)).where("__asks")
    # the latest of all slices before: one row per address and slice in use
    used = both.groupBy(by, "__slice").agg(F.max("__right").alias("__last"))
    carried = used.withColumn("__far", F.max("__last").over(Window.partitionBy(by).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1))).select(F.col(by).alias("__by"), F.col("__slice").alias("__of"), "__far").where("__far is not null")
    met = found.join(carried, (F.col(by) == F.col("__by")) & (F.col("__slice") == F.col("__of")), "left")
    return met.select(*[F.col(f"__{c}").alias(c) for c in left.columns], F.coalesce("__near", "__far").alias(value))


def _weak(tag: Column) -> Column:
    return F.regexp_replace(tag, "^W/", "")


def resolve(records: DataFrame) -> DataFrame:
    """Each revisit of records with what it stands for.

    records: record_id, kind ('response' or 'revisit'), url, ts (long), headers (map, names in lower case), digest (of the body; null in a
    revisit that doesn't name one). Result: record_id, url (canonical), ts, status, original_id, headers (merged), digest (the original's).

    status: ``resolved``; ``mismatch`` when the first validator that both sides have (entity tag compared weakly, digest, last-modified)
    differs; ``unchecked`` when there is none in common; ``no original``. Only resolved and unchecked revisits get headers and a digest.
    Of responses with one time the one with the largest id counts. Revisits without a URL or time have no original. Every row of a
    revisit gives a row, repeated ones too; equal responses count once; an empty log gives no rows. Texts aren't read, so their length is of no
    account. Other columns of the records aren't read, whatever their names.
    """
    r = records.select("record_id", "kind", canonical_url(F.col("url")).alias("url"), F.col("ts").cast("long").alias("ts"), F.coalesce("headers", F.create_map().cast("map<string,string>")).alias("headers"), "digest")
    plain = r.withColumn("pairs", F.array_sort(F.map_entries("headers"))).drop("headers")
    full = plain.where("kind = 'response'").select("url", "ts", F.struct("ts", F.col("record_id").alias("id"), "digest", "pairs").alias("original"))
    met = latest_before(plain.where("kind = 'revisit'"), full, "original")
    mine, theirs = F.map_from_entries("pairs"), F.map_from_entries(F.coalesce("original.pairs", F.array().cast(plain.schema["pairs"].dataType)))
    checks = F.filter(
        F.array(
            F.struct(_weak(mine["etag"]).alias("a"), _weak(theirs["etag"]).alias("b")),
            F.struct(F.col("digest").alias("a"), F.col("original.digest").alias("b")),
            F.struct(mine["last-modified"].alias("a"), theirs["last-modified"].alias("b")),
        ),
        lambda c: c["a"].isNotNull() & c["b"].isNotNull(),
    )
    first = F.try_element_at(checks, F.lit(1))
    status = F.when(F.col("original").isNull(), "no original").when(first.isNull(), "unchecked").when(first["a"] == first["b"], "resolved").otherwise("mismatch")
    met = met.withColumn("status", status)
    good = F.col("status").isin("resolved", "unchecked")
    merged = F.map_concat(F.map_filter(theirs, lambda k, v: ~(k.isin(*UPDATED) & F.map_contains_key(mine, k))), F.map_filter(mine, lambda k, v: k.isin(*UPDATED)))
    return met.select("record_id", "url", "ts", "status", F.col("original.id").alias("original_id"), F.when(good, merged).alias("headers"), F.when(good, F.col("original.digest")).alias("digest"))


def with_bodies(resolved: DataFrame, records: DataFrame, body: str = "body") -> DataFrame:
    """resolved with the body of each revisit's original; null where there is none."""
    bodies = records.where("kind = 'response'").select(F.col("record_id").alias("original_id"), body)
    return resolved.join(bodies, "original_id", "left")


def page_records(pages: DataFrame) -> DataFrame:
    """A crawl log of the pages: each page's full answer, and a later revisit of its address.

    Entity tags are digests of the page; every seventh revisit names another one, every eleventh none, so all outcomes occur. A revisit
    of every thirteenth page comes before any answer.
    """
    p = pages.select(F.col("page_id").cast("long").alias("n"), "url", F.sha2(F.coalesce("html", F.lit("")), 256).alias("digest"))
    day = F.concat(F.lit("day "), F.col("ts").cast("string"))
    tag = F.concat(F.lit('"'), F.substring("digest", 1, 16), F.lit('"'))
    response = p.withColumn("ts", F.col("n")).select(
        F.concat(F.lit("r"), F.col("n")).alias("record_id"), F.lit("response").alias("kind"), "url", "ts",
        F.create_map(F.lit("etag"), tag, F.lit("content-type"), F.lit("text/html"), F.lit("date"), day, F.lit("last-modified"), F.concat(F.lit("day "), F.col("n"))).alias("headers"), "digest",
    )
    named = F.when(F.col("n") % 7 == 3, F.lit('"changed"')).otherwise(F.concat(F.lit("W/"), tag))
    sent = F.map_filter(F.create_map(F.lit("etag"), F.when(F.col("n") % 11 == 5, F.lit(None)).otherwise(named), F.lit("date"), day, F.lit("cache-control"), F.lit("max-age=60"), F.lit("content-length"), F.lit("0")), lambda k, v: v.isNotNull())
    revisit = p.withColumn("ts", F.when(F.col("n") % 13 == 4, F.lit(-1)).otherwise(F.col("n") + 1_000_000)).select(
        F.concat(F.lit("v"), F.col("n")).alias("record_id"), F.lit("revisit").alias("kind"), "url", "ts", sent.alias("headers"), F.lit(None).cast("string").alias("digest")
    )
    return response.unionByName(revisit)


def report(resolved: DataFrame) -> DataFrame:
    """resolved with the merged headers as one line: name=value, sorted by name, joined by ``; ``."""
    line = F.array_join(F.transform(F.array_sort(F.map_entries("headers")), lambda x: F.concat_ws("=", x["key"], x["value"])), "; ")
    return resolved.select("record_id", "url", "ts", "status", "original_id", F.coalesce(line, F.lit("")).alias("headers"), F.coalesce("digest", F.lit("")).alias("digest"))


ORACLE = r"""
WITH p AS (
  SELECT page_id AS n, sha256(coalesce(html, '')) AS digest, regexp_replace(regexp_replace(url, '#.*$', ''), '^[A-Za-z]+://', '') AS rest FROM pages),
u AS (
  SELECT n, digest, '"' || digest[1:16] || '"' AS tag,
    regexp_replace(regexp_replace(lower(regexp_extract(rest, '^([^/?]*)', 1)), '^www\.', ''), ':(80|443)$', '') || regexp_replace(regexp_extract(rest, '^[^/?]*([^?]*)', 1), '/+$', '') AS path,
    array_to_string(list_sort(list_filter(string_split(regexp_extract(rest, '\?(.*)$', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[a-z]+|ref)='))), '&') AS q FROM p),
c AS (SELECT n, digest, tag, path || CASE WHEN q <> '' THEN '?' || q ELSE '' END AS url FROM u),
v AS (
  SELECT n, url, CASE WHEN n % 13 = 4 THEN -1 ELSE n + 1000000 END AS ts,
    CASE WHEN n % 11 = 5 THEN NULL WHEN n % 7 = 3 THEN '"changed"' ELSE tag END AS etag, n % 7 = 3 AS changed FROM c),
j AS (SELECT v.*, o.n AS original, o.tag AS original_tag, o.digest FROM v LEFT JOIN c o ON o.url = v.url AND o.n < v.ts),
a AS (SELECT * FROM j QUALIFY row_number() OVER (PARTITION BY n ORDER BY original DESC NULLS LAST) = 1),
s AS (SELECT *, CASE WHEN original IS NULL THEN 'no original' WHEN etag IS NULL THEN 'unchecked' WHEN etag = original_tag THEN 'resolved' ELSE 'mismatch' END AS status FROM a)
SELECT 'v' || n AS record_id, url, CAST(ts AS BIGINT) AS ts, status, 'r' || original AS original_id,
  CASE WHEN status IN ('resolved', 'unchecked') THEN 'cache-control=max-age=60; content-type=text/html; date=day ' || ts || '; etag=' ||
    CASE WHEN etag IS NULL THEN original_tag WHEN changed THEN etag ELSE 'W/' || etag END || '; last-modified=day ' || original ELSE '' END AS headers,
  CASE WHEN status IN ('resolved', 'unchecked') THEN digest ELSE '' END AS digest
FROM s
"""
