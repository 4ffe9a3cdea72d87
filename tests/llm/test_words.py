"""Spelling variants, byte-level BPE, importance resampling and the hash of words, against plain versions and the library."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import brute
import numpy as np
import pyarrow as pa
import pytest
from test_documents import AWKWARD, ITEMS, prose, same, table

from emberline.llm import bytepairs, common, crc, lm, near, pieces, quality, queries, resample, variants

SF = "/root/testdata/sf0.001"


def thue_morse(n: int) -> list[str]:
    """Two unlike words of n letters that polynomial hashes modulo a power of two confuse."""
    a = "a"
    while len(a) < n:
        a += a.translate(str.maketrans("ab", "ba"))
    return [a[:n], a[:n].translate(str.maketrans("ab", "ba"))]


# --- the hash of words, in the operators that use it


@pytest.mark.parametrize("n", [8, 256, 257, 1024, 2048, 65536])
def test_hash_tells_words_apart(n):
    a, b = thue_morse(n)
    buf = np.frombuffer(f"{a}{b}{a.upper()}".encode(), np.uint8)
    h = common.span_hashes(buf, np.array([0, n, 2 * n]), np.array([n, 2 * n, 3 * n]))
    assert h[0] == h[2] != h[1]
    at, each = common.distinct_spans(buf, np.array([0, n, 2 * n, n]), np.array([n, 2 * n, 3 * n, 2 * n]))
    assert len(at) == 3 and each[1] == each[3] and len(set(each.tolist())) == 3


def test_spans_of_one_hash_are_hashed_anew(monkeypatch):
    real = common.span_hashes
    monkeypatch.setattr(common, "span_hashes", lambda *a, seed=0, **k: real(*a, seed=seed, **k) & np.uint64(0 if seed < 2 else 2**64 - 1))
    buf = np.frombuffer(b"abcabd", np.uint8)
    assert len(common.distinct_spans(buf, np.array([0, 3, 0]), np.array([3, 6, 3]))[0]) == 2


def test_operators_tell_such_words_apart(spark):
    import sentencepiece

    a, b = thue_morse(2048)
    model = pieces.model_of(queries.piece_model_path())
    got = [x[i:j].tolist() for x, at in model.encode(pa.array([a, b])) for i, j in zip(at, at[1:])]
    assert got == sentencepiece.SentencePieceProcessor(model_file=queries.piece_model_path()).encode([a, b], add_bos=True, add_eos=True)
    docs = table(spark, [(1, a), (2, b), (3, f"{a}\n{b}")])
    assert {(r.doc_id, r.component_id) for r in near.near_duplicates(docs, size=2, percent=80).collect()} == {(1, 1), (2, 2), (3, 3)}
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    assert {r.doc_id: r.n_dup_lines for r in quality.quality(docs, labels).collect()} == {1: 0, 2: 0, 3: 0}
    held = next(k for k in range(100) if brute.crc_mod(k, 7) == 2)
    learned = next(k for k in range(100) if brute.crc_mod(k, 7) != 2)
    assert {r.doc_id: r.n_known for r in lm.score(table(spark, [(learned, a), (held, b)])).collect()} == {learned: 2, held: 1}


# --- 11


def plain_words(rows, slip=199):
    n = Counter()
    for key, text in rows:
        for w in re.findall("[a-zÀ-ÿ]+", (text or "").translate(brute.UPPER)):
            h = zlib.crc32(f"{'' if key is None else key}:{w}".encode())
            n[w[: h % len(w)] + w[h % len(w) + 1 :] if h % slip == 0 else w] += 1
    return {w: k for w, k in n.items() if len(w) >= 6 and k >= 5}


def plain_variants(n):
    out, form = [], {}
    edits = lambda w: {w[:i] + w[i + 1 :] for i in range(len(w))}
    near_of = {}
    by_hole = {}
    for w in n:
        for i in range(len(w)):
            by_hole.setdefault((i, w[:i] + w[i + 1 :]), set()).add(w)
    for w in n:
        near_of[w] = {x for i in range(len(w)) for x in by_hole[i, w[:i] + w[i + 1 :]] if x != w} | {x for x in edits(w) if x in n}
    for w in n:
        for x in edits(w) & n.keys():
            near_of[x].add(w)
    for w in n:
        best = min(near_of[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near_of[w]), n[form[w]] if form[w] else None))
    return out


def mangled(seed: int, n: int) -> list[str]:
    """Words with variants of variants."""
    rng, out = random.Random(seed), []
    for _ in range(n):
        w = "".join(rng.choice("aabcdé") for _ in range(rng.randrange(6, 12)))
        k = 600
        while k >= 5:
            out += [w] * k
            at = rng.randrange(len(w))
            w, k = w[:at] + rng.choice(["", "x", w[at] + "b"]) + w[at + 1 :], k // rng.choice([3, 6, 9])
    return out


def test_variants_are_those_of_all_pairs(spark):
    rows = [(k, t) for k, t in AWKWARD] + [(100 + k, " ".join(mangled(k, 12))) for k in range(4)] + [(None, "Résumé1resumé_" * 6)]
    expected = plain_variants(plain_words(rows))
    assert sum(r[1] is not None for r in expected) > 50 and any(r[2] not in (r[0], r[1]) for r in expected)
    same(variants.spelling_variants(table(spark, rows)), expected)


@pytest.mark.parametrize(("q", "block"), [(2, 3), (3, 1), (4, 7), (3, 2000)])
def test_split_places_and_other_grams_find_the_same(spark, q, block):
    n = Counter(mangled(7, 25))
    n = {w: k for w, k in n.items() if len(w) >= 6}
    vocabulary = spark.createDataFrame([*n.items()], "word string, n long")
    same(variants.variants(vocabulary, least_letters=6, q=q, block=block), plain_variants(n))


def test_variants_of_short_and_no_words(spark):
    n = {"a": 5, "b": 30, "ab": 200, "": 9, "abc": 1100, "abcd": 6000}
    same(variants.variants(spark.createDataFrame([*n.items(), (None, 3)], "word string, n long")), plain_variants(n))
    same(variants.spelling_variants(table(spark, [(1, None), (2, "")])), [])
    same(variants.spelling_variants(table(spark, [])), [])


def test_a_gram_at_two_places_in_a_row_counts_a_near_word_once(spark):
    """The rarest grams of the first word hold one that stands at two places in a row, so it comes twice to the place where it meets the second."""
    n = {"aaaacdefg": 5, "baaaacdefg": 40} | {f"{x}{x}aacdefg": 6 for x in "klmnopq"} | {"a" * k: 5 * 6 ** (k - 6) for k in range(6, 11)} | {"b" + "a" * k: 5 + k for k in range(5, 9)}
    vocabulary = spark.createDataFrame([*n.items()], "word string, n long")
    same(variants.variants(vocabulary.where("word like '%cdefg'"), least_letters=6), plain_variants({w: k for w, k in n.items() if w.endswith("cdefg")}))
    same(variants.variants(vocabulary, least_letters=6, block=1), plain_variants(n))


def test_merged_postings_are_counts():
    rng = random.Random(3)
    for _ in range(200):
        lists = [sorted(rng.sample(range(40), rng.randrange(0, 30))) for _ in range(rng.randrange(1, 9))]
        least = rng.randrange(1, 6)
        n = Counter(x for some in lists for x in some)
        assert list(variants.merge_postings(lists, least)) == sorted(x for x, k in n.items() if k >= least)


# --- 12


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.byte_vocabulary_path())


def odd_texts():
    rng = random.Random(5)
    pick = lambda: rng.choice([rng.randrange(32, 127), rng.randrange(0x80, 0x3000), rng.randrange(0x10000, 0x11000), 32, 10, 39, 115])
    said = ["".join(chr(pick()) for _ in range(70)) for _ in range(300)]
    marks = ["<|endoftext|>", "a<|endoftext|>b <|endoftext|><|endoftext|>\n", "<|endoftext", "I'M we'll it's 've''s", "a" * 20_000, "ab" * 33, "ab" * 32 + "c", " \t\n 　 x  \x1c\x85", "\U0003d000a՘bᲉ", *thue_morse(2048)]
    return [*marks, *said, *[t for _, t in AWKWARD if t]]


def test_ids_are_those_of_the_library(library):
    model = bytepairs.BytePairModel(queries.byte_vocabulary_path())
    texts = odd_texts()
    for text, raw in zip(texts, model.encode(texts)):
        ids = np.frombuffer(raw, "<u4")
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids, text[:60]
        assert model.decode(ids) == library.decode(ids.tolist(), skip_special_tokens=False)


def test_trees_of_many_words_and_of_one_agree():
    model, rng = bytepairs.BytePairModel(queries.byte_vocabulary_path()), random.Random(2)
    words = ["".join(rng.choice("abcdetion é") for _ in range(rng.randrange(1, 60))) for _ in range(800)]
    for w, ids in model._ids(set(words)):
        assert np.frombuffer(ids, "<u4").tolist() == model.merge(w.encode())


def test_a_full_memory_changes_nothing(library, monkeypatch):
    monkeypatch.setattr(bytepairs, "REMEMBERED", 50)
    monkeypatch.setattr(bytepairs, "STEP_CHARS", 300)
    model, texts = bytepairs.BytePairModel(queries.byte_vocabulary_path()), [prose(k, 40) for k in range(30)]
    assert [np.frombuffer(x, "<u4").tolist() for x in model.encode(texts)] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert len(model.known) < 200


def test_bytepair_queries_and_awkward_rows(spark, library):
    def expected(rows):
        out = []
        for key, text in rows:
            ids = library.encode(text or "", add_special_tokens=False).ids
            out.append((key, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), brute.sha(library.decode(ids, skip_special_tokens=False))))
        return out

    same(queries.op12_bytepairs(spark, SF), expected([tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]))
    rows = AWKWARD + [(30 + k, t) for k, t in enumerate(odd_texts()[:12])]
    same(bytepairs.encode_digests(table(spark, rows), queries.byte_vocabulary_path()), expected(rows))
    whole = bytepairs.encode(table(spark, rows).withColumnRenamed("doc", "ids"), queries.byte_vocabulary_path())
    assert [(r.text or "", r.ids) for r in whole.select("text", "ids").collect()] == [(t or "", library.encode(t or "", add_special_tokens=False).ids) for _, t in rows]
    assert all((r.text or "") == r.decoded for r in whole.collect())
    assert bytepairs.encode_digests(table(spark, []), queries.byte_vocabulary_path()).count() == 0


# --- 13


def test_crcs_compose():
    rng = random.Random(1)
    words = [bytes(rng.randrange(256) for _ in range(rng.randrange(0, 100))) for _ in range(300)]
    end = np.cumsum([len(w) for w in words])
    size = np.array([len(w) for w in words])
    own = crc.of_spans(np.frombuffer(b"".join(words), np.uint8), end - size, end)
    assert own.tolist() == [zlib.crc32(w) for w in words]
    last = np.repeat([99, 299], [100, 200])
    for n, (first, c) in enumerate(crc.of_runs(own, size, last, 5), 1):
        assert c.tolist() == [zlib.crc32(b" ".join(words[i : i + n])) for i in first.tolist()] and len(first) == 300 - 2 * (n - 1)
    assert crc.combine(own[:1], own[1:2], np.array([(1 << 31) - 1])).dtype == np.uint32


def plain_resample(docs, items, most_words=1, buckets=10_000, percent=10, least=20, seed=2024):
    def features(text):
        w = brute.letters(text)
        return [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, most_words + 1) for i in range(len(w) - n + 1)], len(w)

    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(features(text)[0])
    for _, text in items:
        t.update(features(text)[0])
    all_s, all_t = s.total() + buckets, t.total() + buckets
    gain = [math.floor(1000 * math.log((t[b] + 1) * all_s / ((s[b] + 1) * all_t))) for b in range(buckets)]
    rows = []
    for key, text in docs:
        f, n = features(text)
        h = int(brute.sha(f"{seed}:{'' if key is None else key}")[:8], 16)
        weight = sum(gain[b] for b in f)
        rows.append((key, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n))
    drawn = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], -math.inf if r[0] is None else r[0], r[1], r[2]))
    drawn = drawn[: percent * len(drawn) // 100]
    left = [r for r in rows]
    out = []
    for k, r in enumerate(drawn, 1):
        left.remove(r)
        out.append((*r[:4], k))
    return out + [(*r[:4], None) for r in left]


@pytest.mark.parametrize(("most_words", "buckets", "percent"), [(1, 10_000, 10), (3, 500, 60), (2, 7, 100)])
def test_resampling_is_that_of_a_plain_version(spark, most_words, buckets, percent):
    rows = AWKWARD + [(100 + k, prose(k, 15 + k)) for k in range(40)] + [(200, prose(3, 50))] * 7 + [(None, None)]
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    same(resample.importance_resample(table(spark, rows), items, most_words=most_words, buckets=buckets, percent=percent), plain_resample(rows, ITEMS, most_words, buckets, percent))


def test_resampling_of_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    rows = [(k, prose(k, 30)) for k in range(20)]
    same(resample.importance_resample(table(spark, rows), none), plain_resample(rows, []))
    assert resample.importance_resample(table(spark, []), none).count() == 0
    with pytest.raises(ValueError, match="can't name"):
        resample.importance_resample(table(spark, rows).withColumnRenamed("doc", "score"), none, key="score")


# --- 4: what the battery adds


def plain_apart(added, base):
    free = [x for x in added if not any(x[0] < y[1] and y[0] < x[1] for y in base)]
    return sorted(x for x in free if not any(y[0] <= x[0] and x[1] <= y[1] and y[1] - y[0] > x[1] - x[0] for y in free))


def test_added_spans_are_those_of_all_pairs(spark):
    from emberline.llm import secrets

    rng = random.Random(4)
    span = "struct<start: int, rank: int, stop: int, kind: string>"
    texts = {}
    for key in [*range(30), None]:
        pick = lambda n: list({(a, a + rng.randrange(1, 12)) for a in (rng.randrange(60) for _ in range(rng.randrange(n)))})
        texts[key] = (pick(12), pick(5))
    added = spark.createDataFrame([(k, 7, (a, 3, b, "random")) for k, (new, _) in texts.items() for a, b in new], f"doc long, row long, x {span}")
    base = spark.createDataFrame([(k, 7, [(a, 0, b, "assign") for a, b in own], [], []) for k, (_, own) in texts.items()], f"doc long, row long, k0 array<{span}>, k1 array<{span}>, k2 array<{span}>")
    got = {}
    for r in secrets.apart(added, base).collect():
        got.setdefault(r.doc, []).append((r.x.start, r.x.stop))
    assert {k: sorted(v) for k, v in got.items()} == {k: v for k, v in ((k, plain_apart(*x)) for k, x in texts.items()) if v}
