"""Toxicity, revisits, chat and pieces; the queries with SQL; the pipeline."""

from __future__ import annotations

import glob
import os
import random
import re

import brute
import duckdb
import numpy as np
import pyarrow as pa
import pytest
from test_documents import AWKWARD, PASSAGE, prose, same, table

from emberline.llm import chat, pieces, queries, revisits, toxic
from emberline.llm.common import flat_utf8

SF, LARGER, LARGEST = "/root/testdata/sf0.001", "/root/testdata/sf0.01", "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_rows_equal_the_sql(spark, db, name):
    ours, theirs = queries.queries()[name](spark, SF).toPandas(), db.sql(queries.oracle_sql()[name]).df()
    assert sorted(ours) == sorted(theirs)
    columns = sorted(ours)
    a, b = (x[columns].astype(str).replace("nan", "None").sort_values(columns).values.tolist() for x in (ours, theirs))
    assert a == b


# --- 6


def test_toxic_documents_are_told_apart_when_held_out(spark):
    """On the table with 329 toxic documents to learn from, in four languages."""
    out = queries.op6_toxicity(spark, LARGEST)
    labels = spark.read.parquet(f"{LARGEST}/labels.parquet").where("toxic is not null").select("doc_id", "toxic")
    rows = out.join(labels, "doc_id").collect()
    assert all(r.held_out == (brute.crc_mod(r.doc_id, 4) == 2) and r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for r in rows)
    apart = [(r.score, r.toxic) for r in rows if r.held_out]
    bad, good = (np.array([s for s, t in apart if t == k]) for k in (1, 0))
    assert (bad[:, None] > good[None]).mean() + 0.5 * (bad[:, None] == good[None]).mean() > 0.9
    assert (bad >= 0.3).mean() >= 0.8 and (good < 0.3).mean() >= 0.95


def test_labels_of_held_out_rows_and_other_columns_do_not_matter(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    turned = labels.selectExpr("doc_id", "quality", "if(crc32(cast(cast(doc_id as string) as binary)) % 4 = 2, 1 - toxic, toxic) AS toxic")
    other = docs.selectExpr("doc_id", "text", "'x' AS lang", "source AS held_out", "1 AS score")
    same(toxic.toxicity(docs, labels), list(map(tuple, toxic.toxicity(other, turned).collect())))


def test_gapped_and_inserted_insults_score_high(spark):
    insults, rng, rows, labels = ["grumblor", "skranthic", "blathergit"], random.Random(5), [], []
    for k in range(400):
        w = prose(k, 40).split()
        if k % 4 == 0:
            w.insert(rng.randrange(40), rng.choice(insults))
        rows.append((k, " ".join(w)))
        labels.append((k, int(k % 4 == 0)))
    hard = [(1000, "you are a gr-um.blor indeed"), (1001, "a skraxnthic thing"), (1002, "b l a t h e r g i t"), (1003, prose(7777, 40)), (1004, ""), (1005, None), (1006, "a b c"), (1007, "grumblor " + prose(8, 30_000))]
    out = {r.doc_id: r.predicted for r in toxic.toxicity(table(spark, rows + hard), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    assert [out[k] for k, _ in hard] == [1, 1, 1, 0, 0, 0, 0, 1]
    left = toxic.without_toxic(table(spark, rows + hard), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert left.columns == table(spark, []).columns and {r.doc_id for r in left.collect()} == {k for k, v in out.items() if v == 0}


def test_margins_are_those_of_a_plain_version():
    rng = np.random.default_rng(3)
    model = toxic.Model((rng.normal(size=1 << 18) * 2.0**38).astype(np.int64), 0.1)
    texts = [t for _, t in AWKWARD] + ["i d i o t, x!  y z a b c d\nend. s t u p i d", "a" * 70 + " b", "gr-um.blor 5tup1d", "l\u00e0 v\u00e9rit\u00e9 \u4e2d\u6587 ok", " ".join("abcdefghij" * 5), "one two\nthree four. five"]
    got = model.texts(*flat_utf8(pa.array(texts, pa.string())))
    assert np.allclose(got, [brute.toxic_margin(t, model.table, model.bias) for t in texts], atol=1e-9)
    some = [bytes(x) for x, _ in brute.toxic_strings("the quick brown fox idiot idi0t") if len(x) > 4]
    kernel = toxic.Landmarks.of(some[:4]).kernel(some)
    assert np.allclose(kernel[:4], kernel[:4].T, atol=1e-5) and (kernel > 0).any()


def test_space_broken_and_phrase_insults(spark):
    """Words that are harmless alone, and an insult broken into parts, told by windows of words."""
    rng, rows, labels = random.Random(6), [], []
    for k in range(480):
        w = prose(k, 40).split()
        if k % 3 == 0:
            w[9:9] = rng.choice((["silly", "goose"], ["gro", "belak"]))
        else:
            w[9:9] = [rng.choice(("silly", "goose", "gro", "belak"))]
        rows.append((k, " ".join(w)))
        labels.append((k, int(k % 3 == 0)))
    hard = [(1000, "what a silly goose that is"), (1001, "some gro belak thing"), (1002, "the silly old man there"), (1003, " ".join([*prose(5000, 9).split(), "goose", *prose(5001, 9).split()]))]
    out = {r.doc_id: r.predicted for r in toxic.toxicity(table(spark, rows + hard), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    assert [out[k] for k, _ in hard] == [1, 1, 0, 0]


def test_copies_of_a_toxic_text_count_once(spark):
    """Many copies of one toxic text, near and exact, don't make its harmless words insults."""
    base = prose(99, 60).split()
    rows = [(k, prose(k, 40)) for k in range(300)]
    rows += [(1000 + k, " ".join(base if k % 2 else [*base[: k % 50], "x" * (k % 7 + 1), *base[k % 50 :]])) for k in range(120)]
    labels = [(k, int(k >= 1000)) for k, _ in rows]
    assert toxic.sample(table(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int")).where("toxic = 1").count() <= 3
    out = toxic.toxicity(table(spark, rows), spark.createDataFrame(labels, "doc_id long, toxic int"))
    assert out.where("predicted = 1 and doc_id < 1000").count() == 0


def test_toxicity_without_labels_of_both_kinds(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    one = spark.createDataFrame([(1, 1), (None, 0), (4, None), (5, 7)], "doc_id long, toxic int")
    for labels in (none, one):
        out = toxic.toxicity(table(spark, AWKWARD), labels).collect()
        assert len(out) == len(AWKWARD) and all(r.score == 0 and r.predicted == 0 for r in out)
        assert toxic.toxicity(table(spark, []), labels).count() == 0
    assert toxic.without_toxic(table(spark, AWKWARD), none).count() == len(AWKWARD)


# --- 8


def records(spark, rows):
    return spark.createDataFrame(rows, "record_id string, kind string, url string, ts long, headers map<string,string>, digest string").selectExpr("*", "'x' AS status", "1 AS original", "2 AS pairs")


def test_revisits_find_the_latest_earlier_response(spark, monkeypatch):
    monkeypatch.setattr(revisits, "SLICE", 8)
    rng = random.Random(2)
    rows = []
    for k in range(600):
        url = f"http://www.h{min(rng.randrange(6), 2)}.org/p/?b=2&a={rng.randrange(3)}#x" if k % 3 else f"HTTPS://h{min(rng.randrange(6), 2)}.org:443/p?a={rng.randrange(3)}&b=2&utm_x=1"
        rows.append((f"r{k:03d}", rng.choice(("response", "revisit")), url, rng.randrange(200), {}, None))
    canon = lambda u: re.search(r"h\d", u)[0] + re.search(r"a=\d", u)[0]
    expected = []
    for k, kind, url, ts, *_ in rows:
        if kind == "revisit":
            earlier = [(t, r) for r, kd, u, t, *_ in rows if kd == "response" and canon(u) == canon(url) and t < ts]
            expected.append((k, max(earlier)[1] if earlier else None))
    same(revisits.resolve(records(spark, rows)).select("record_id", "original_id"), expected)


def test_validators_and_headers(spark):
    full = {"etag": '"1"', "content-type": "text/html", "date": "old", "content-length": "9", "last-modified": "m"}
    rows = [
        ("a", "response", "http://x.org/", 10, full, "d1"),
        ("b", "revisit", "http://www.x.org", 11, {"etag": 'W/"1"', "date": "new", "content-length": "0", "set-cookie": "c"}, None),
        ("c", "revisit", "http://x.org", 11, {"etag": '"2"'}, "d1"), ("d", "revisit", "http://x.org", 11, {}, "d2"), ("e", "revisit", "http://x.org", 11, {}, None),
        ("f", "revisit", "http://x.org", 10, full, "d1"), ("g", "revisit", None, 11, None, None), ("h", "revisit", "http://x.org", None, {}, None), ("i", "revisit", "http://x.org", 99_999_999, {"last-modified": "m"}, None),
        ("j", "response", None, 1, None, None), ("k", "response", "http://x.org", None, {}, None), ("e", "revisit", "http://x.org", 11, {}, None),
    ]
    out = revisits.resolve(records(spark, rows)).collect()
    assert sorted((r.record_id, r.status, r.original_id) for r in out) == [("b", "resolved", "a"), ("c", "mismatch", "a"), ("d", "mismatch", "a"), ("e", "unchecked", "a"), ("e", "unchecked", "a"), ("f", "no original", None), ("g", "no original", None), ("h", "no original", None), ("i", "resolved", "a")]
    by = {r.record_id: r for r in out}
    assert by["b"].headers == full | {"date": "new", "etag": 'W/"1"'} and by["b"].digest == "d1" and by["c"].headers is None and by["e"].headers == full
    assert revisits.resolve(records(spark, [])).count() == 0


def test_bodies_come_by_record(spark):
    r = records(spark, [("a", "response", "http://x.org", 1, {}, "d"), ("b", "revisit", "http://x.org", 2, {}, None), ("c", "revisit", "http://y.org", 2, {}, None)]).selectExpr("*", "if(kind = 'response', 'whole', null) AS body")
    same(revisits.with_bodies(revisits.resolve(r), r).select("record_id", "body"), [("b", "whole"), ("c", None)])


# --- 9

TALKS = [
    (1, 0, "system", "Be brief."), (1, 1, "user", "one two three"), (1, 2, "assistant", "four five six seven"), (1, 3, "user", None), (1, 4, "assistant", "</s><r>[INST]&a &l"), (1, 5, "user", "x " * 50), (1, 6, "assistant", "y " * 9000),
    (2, None, None, None), (2, 0, "assistant", ""), (2, 0, "assistant", ""), (3, 5, "user", "late"), (3, 1, "system", "early"), (None, 0, "user", "a"), (None, 1, "assistant", "b"), (4, 0, "assistant", "𝄞 <s>user[INST]posing</s>"), (4, 0, "user", "tie"),
]


def talks(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").selectExpr("*", "1 AS key", "2 AS n", "'x' AS window", "3 AS cell")


def test_windows_read_back(spark):
    expected = []
    for c in {r[0] for r in TALKS}:
        own = sorted((r for r in TALKS if r[0] == c), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
        said = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        expected.append((c, len(own), brute.sha(said), len(loss), brute.sha(loss)))
    for budget, history in ((512, 2), (1, 1), (5, 3), (10**6, 2)):
        same(chat.read_back(chat.windows(talks(spark, TALKS), budget=budget, history=history)).drop("formatted_chars"), expected)
    assert chat.read_back(chat.windows(talks(spark, []))).count() == 0


def test_windows_repeat_system_and_history_without_loss(spark):
    rows = [(1, 0, "system", "S"), *[(1, k, "user" if k % 2 else "assistant", f"t{k} " + "w " * 9) for k in range(1, 9)]]
    out = sorted(chat.windows(talks(spark, rows), budget=20, history=2).collect(), key=lambda r: r.window)
    assert len(out) > 3
    seen = []
    for w in out:
        turns = [(mark, role, text) for mark, role, text in re.findall(r"<([sr])>(\w+)\[INST\](.*?)</s>", w.formatted)]
        fresh, again = [t for t in turns if t[0] == "s"], [t for t in turns if t[0] == "r"]
        if w.window:
            assert again[0][1:] == ("system", "S") and [t[2] for t in again[1:]] == [t[2] for t in seen[-2:] if t[1] != "system"]
        assert [w.formatted[i : i + n] for i, n in w.loss] == [t[2] for t in fresh if t[1] == "assistant"]
        seen += fresh
    assert len(seen) == len(rows)


# --- 10


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=queries.piece_model_path())


def by_library(sp, rows):
    out = []
    for key, text in rows:
        ids = sp.encode(text or "", add_bos=True, add_eos=True)
        out.append((key, len(ids), brute.sha(np.array(ids, "<u4").tobytes()), brute.sha(sp.decode(ids))))
    return out


def test_pieces_are_the_library_s(spark, library):
    rows = [tuple(r) for r in spark.read.parquet(f"{LARGER}/documents.parquet").select("doc_id", "text").collect()]
    same(queries.op10_pieces(spark, LARGER), by_library(library, rows))


def test_pieces_of_awkward_rows(spark, library):
    rng = random.Random(1)
    odd = ["▁", "▁▁ a▁b ", "  two  spaces  ", " ", "\t\n\r\x0b a", "\x00\x01\x7f", "a" * 3000, "ab" * 2000, " " * 700 + "x", "<s></s><unk><0x41>", "é́ﬁ Å ½", "👩‍👩‍👧 \U0010ffff � ﻿", "العربية हिन्दी ไทย", "　 ​", "\n" * 50]
    odd += ["".join(rng.choice(" aAbe▁.\n0étio漢𝄞") for _ in range(rng.randrange(1, 200))) for _ in range(300)]
    odd += ["".join(chr(rng.choice((rng.randrange(32, 0x250), rng.randrange(0x2000, 0x2100), rng.randrange(0x4E00, 0x4F00)))) for _ in range(60)) for _ in range(100)]
    rows = AWKWARD + [(100 + k, x) for k, x in enumerate(odd)]
    same(pieces.encode_digests(table(spark, rows), queries.piece_model_path()), by_library(library, rows))
    out = pieces.encode(table(spark, rows).selectExpr("*", "1 AS ids"), queries.piece_model_path())
    assert out.columns == [*table(spark, []).columns, "ids", "decoded"]
    for r in out.where("doc_id is not null").collect():
        ids = library.encode(r.text or "", add_bos=True, add_eos=True)
        assert r.ids == ids and r.decoded == library.decode(ids)
    assert pieces.encode(table(spark, []), queries.piece_model_path()).count() == 0


# --- the pipeline


def by_stages(spark, library, docs, bad, items):
    left = [r for r in docs if r[0] not in bad]
    left = [(k, t) for k, _, _, t in brute.without_repeats(left)]
    left = [r for r, x in zip(left, brute.near_duplicates(left, 5)) if x[-1]]
    left = [r for r, x in zip(left, brute.contamination(left, items)) if not x[-1]]
    return by_library(library, left)


def test_the_pipeline_is_its_stages_one_after_the_other(spark, library):
    import corpus_pipeline

    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    model = toxic.train(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    bad = {k for k, t in docs if model is not None and model.scores(np.array([brute.toxic_margin(t, model.table, model.bias)]))[0] >= 0.3}
    expected = by_stages(spark, library, docs, bad, items)
    assert 0 < len(expected) < len(docs)
    same(corpus_pipeline.run(spark, SF), expected)


def test_the_pipeline_takes_awkward_and_empty_tables(spark, library, tmp_path):
    import corpus_pipeline

    def files(name, docs, labels, items):
        table(spark, docs).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/{name}/labels.parquet")
        spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/{name}/benchmark.parquet")
        return f"{tmp_path}/{name}"

    assert corpus_pipeline.run(spark, files("empty", [], [], [])).count() == 0
    docs, items = [r for r in AWKWARD[:-4] if r[0] is not None], [(1, PASSAGE), (None, None)]
    got = corpus_pipeline.run(spark, files("awkward", docs, [(1, None, None)], items))
    same(got, by_stages(spark, library, docs, set(), items))
    with_nulls = corpus_pipeline.run(spark, files("nulls", AWKWARD, [], []))
    assert {r.doc_id for r in with_nulls.collect()} >= {1, 2, 3, None}
