"""Secret scans with a randomness test battery (operator 4). Only DataFrame functions.

Patterns give the base spans. The battery adds spans that no pattern names: runs of an encoding's alphabet that look random. Three tests
measure how far a run is from random: a chi-squared test of the alphabet's uniformity (in classes that are expected three times or more), a
runs test about the alphabet's middle, and the correlation of neighbours. Their deviations add up to one distance.

What is reported is under false-discovery control, with ordinary strings as the null: for each run, decoys are made of words of its own text and
of common identifiers, joined in the way of its encoding, and measured alike. By encoding and class of length, the decoys' distances give the
chance that an ordinary string looks as random as the run does; Benjamini-Hochberg within the class of length then bounds the share of
ordinary strings among those reported. A run that the tests reject as random is never reported. Short runs, whose tests have little power, are
judged among themselves, and few of them pass unless they are clearly random.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emberline.llm.common import cut

#: Kinds in their order, with the pattern, the group that counts, and the least length of what counts.
KINDS = (
    ("assign", r"""(?:(?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]{16,}", 0, 16),
)
#: Alphabets whose longest runs the battery looks at: a run that mixes them, or has = inside, is tested in its parts.
ALPHABETS = ("A-Za-z0-9+/", "A-Za-z0-9_-", "A-Za-z0-9")
#: Least length of such a run; those under SHORT are judged among themselves. Share of ordinary strings among those reported, and the chance at which
#: a run is rejected as random.
LEAST, SHORT, ALPHA, REJECT = 12, 20, 0.05, 0.0005
#: Decoys of each run, further ones of each encoding and class of length, words of a run's text that decoys may begin at, and their greatest length;
#: ordinary words that decoys fall back on (fixed values).
DECOYS, CLASS_DECOYS, OWN_WORDS, DECOY_LENGTH = 4, 100, 64, 128
PLAIN = "user account config server index value number service manager default session request response message handler version release module package buffer string object factory builder client report window system record update archive history network storage process thread control balance".split()
PLAIN_HEX = "face dead beef cafe added fade decade facade bead feed babe deed bade ace bed dad fed cab".split()


def candidate(alphabet: str) -> str:
    """The runs of an alphabet, with padding at their end: of letters and digits, of mixed case inside, or as long capitals (base32)."""
    c = f"[{alphabet}]"
    return rf"(?<!{c})(?={c}*[A-Za-z])(?={c}*[0-9]|{c}*[a-z][A-Z]|{c}*[A-Z][A-Z][a-z]|[A-Z]{{{SHORT},}}(?!{c})){c}{{{LEAST},}}(?:=+(?![A-Za-z0-9+/_=-]))?"


#: Letters from the commonest in text on (fixed value). The alphabets stand in this order, so that ordinary strings crowd in few of the chi-squared
#: test's classes and on one side of the middle; to a random string all orders are alike.
COMMON = "etaoinsrhldcumfpgwybvkxjqz"
#: Encodings from the narrowest on: name, what a string of it looks like, its alphabet in order.
ENCODINGS = (
    ("hex", "^[0-9a-f]+$", "eadcfb0123456789"),
    ("upper hex", "^[0-9A-F]+$", "EADCFB0123456789"),
    ("base32", "^[A-Z2-7]+=*$", COMMON.upper() + "234567"),
    ("base36", "^[0-9a-z]+$", COMMON + "0123456789"),
    ("upper base36", "^[0-9A-Z]+$", COMMON.upper() + "0123456789"),
    ("base64", "^[A-Za-z0-9+/]+=*$", COMMON + COMMON.upper() + "0123456789+/"),
    ("base64url", "^[A-Za-z0-9_-]+=*$", COMMON + COMMON.upper() + "0123456789-_"),
)
_FOUND = "array<struct<span: struct<start: int, rank: int, stop: int, kind: string>, s: string>>"


def _starts(steps: Column) -> Column:
    """Where each step (gap, size) of a walk begins. Sums go over pieces of sqrt(n) steps, then over the pieces, as growing an array copies it."""
    wide = F.greatest(F.ceil(F.sqrt(F.size(steps))), F.lit(1)).cast("int")
    none = F.expr("cast(array() as array<int>)")

    def piece(c: Column) -> Column:
        add = lambda a, m: F.struct((a["at"] + m["gap"] + m["size"]).alias("at"), F.concat(a["starts"], F.array(a["at"] + m["gap"])).alias("starts"))
        return F.aggregate(F.slice(steps, c * wide + 1, wide), F.struct(F.lit(0).alias("at"), none.alias("starts")), add)

    pieces = F.transform(F.sequence(F.lit(0), F.greatest(F.floor((F.size(steps) - 1) / wide), F.lit(0)).cast("int")), piece)
    shift = lambda a, p: F.struct((a["at"] + p["at"]).alias("at"), F.concat(a["all"], F.array(F.transform(p["starts"], lambda x: x + a["at"]))).alias("all"))
    return F.flatten(F.aggregate(pieces, F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<array<int>>)").alias("all")), shift)["all"])


def _found(text: Column, rank: int, kind: str, pattern: str, group: int, least: int) -> Column:
    """(span, s) of the leftmost non-overlapping matches whose group is long enough: the span in code points from 0, and the match."""
    gaps, all_ = F.split(text, pattern), F.regexp_extract_all(text, F.lit(pattern), 0)
    part = F.regexp_extract_all(text, F.lit(pattern), group) if group else all_
    met = F.arrays_zip(F.slice(gaps, 1, F.size(all_)).alias("gap"), all_.alias("s"), part.alias("part"))
    steps = F.transform(met, lambda m: F.struct(F.char_length(m["gap"]).alias("gap"), F.char_length(m["s"]).alias("size"), F.char_length(m["part"]).alias("part"), m["s"].alias("s")))

    def kept(steps: Column) -> Column:
        walked = F.zip_with(steps, _starts(steps), lambda m, at: F.struct(F.struct(at.alias("start"), F.lit(rank).alias("rank"), (at + m["size"]).alias("stop"), F.lit(kind).alias("kind")).alias("span"), m["s"].alias("s"), m["part"].alias("part")))
        return F.transform(F.filter(walked, lambda x: x["part"] >= least), lambda x: F.struct(x["span"].alias("span"), x["s"].alias("s")))

    return F.when(F.regexp_like(text, F.lit(pattern)), _once(steps, kept)).otherwise(F.expr(f"cast(array() as {_FOUND})"))


def _once(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value computed once however often the body names it."""
    return F.get(F.transform(F.array(value), body), 0)


#: The longest runs of all alphabets together, and what one must hold to have a candidate inside.
RUN, MIXED = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{%d,}+(?:=+(?![A-Za-z0-9+/_=-]))?" % LEAST, "[0-9]|[a-z][A-Z]|[A-Z][A-Z][a-z]|[A-Z]{%d}" % SHORT


def _mixed_runs(text: Column) -> Column:
    """(start, s) of the mixed runs of a text: where each begins, in code points, and the run itself."""
    found = F.regexp_extract_all(text, F.lit(RUN), F.lit(0))

    def steps(found: Column) -> Column:
        met = F.arrays_zip(F.slice(F.split(text, RUN), 1, F.size(found)).alias("gap"), found.alias("s"))
        return F.transform(met, lambda m: F.struct(F.char_length(m["gap"]).alias("gap"), F.char_length(m["s"]).alias("size"), m["s"].alias("s")))

    def mixed(steps: Column) -> Column:
        runs = F.zip_with(steps, _starts(steps), lambda m, at: F.struct(at.alias("start"), m["s"].alias("s")))
        return F.filter(runs, lambda r: F.regexp_like(r["s"], F.lit(MIXED)))

    return _once(_once(found, steps), mixed)


def _parts(run: Column) -> Column:
    """(span, s) of the candidates of each alphabet inside a run."""
    inside = F.concat(*[_found(run["s"], len(KINDS), "random", candidate(a), 0, LEAST) for a in ALPHABETS])
    moved = lambda p: F.struct((p["span"]["start"] + run["start"]).alias("start"), p["span"]["rank"].alias("rank"), (p["span"]["stop"] + run["start"]).alias("stop"), p["span"]["kind"].alias("kind"))
    return F.transform(inside, lambda p: F.struct(moved(p).alias("span"), p["s"].alias("s")))


def _spans(*kind) -> Column:
    return F.transform(_found(*kind), lambda x: x["span"])


def _tail(z: Column) -> Column:
    """The chance that a standard normal value is above z, to about 1e-4."""
    z = F.least(F.greatest(z, F.lit(-30.0)), F.lit(30.0))
    return 1 / (1 + F.exp(F.least(1.5976 * z + 0.07056 * z * z * z, F.lit(600.0))))


def inferred(strings: DataFrame) -> DataFrame:
    """strings, a column ``s``, with the narrowest encoding that each fits; strings of no encoding go."""
    name = F.lit(None).cast("string")
    for n, looks, _ in reversed(ENCODINGS):
        name = F.when(F.regexp_like("s", F.lit(looks)), n).otherwise(name)
    return strings.withColumn("encoding", name).where("encoding is not null")


def battery(strings: DataFrame) -> DataFrame:
    """strings, columns ``s`` and ``encoding``, with ``p``, the combined chance of a random string to deviate as far, and ``distance``, the sum of the deviations."""
    alphabet = F.lit(None).cast("string")
    for n, _, letters in ENCODINGS:
        alphabet = F.when(F.col("encoding") == n, letters).otherwise(alphabet)
    x = strings.withColumn("alphabet", alphabet)
    codes = F.transform(F.split(F.regexp_replace("s", "=+$", ""), ""), lambda c: F.position(c, F.col("alphabet")).cast("double"))
    x = x.withColumn("codes", F.filter(codes, lambda c: c > 0))
    n, k = F.greatest(F.size("codes"), F.lit(2)).cast("double"), F.char_length("alphabet").cast("double")
    classes = F.least(F.greatest(F.floor(n / 3), F.lit(2)), k).cast("double")
    x = x.withColumn("classes", F.transform("codes", lambda c: F.floor((c - 1) * classes / k)))
    squares = F.aggregate(F.array_distinct("classes"), F.lit(0.0), lambda a, c: a + F.pow(F.size(F.filter("classes", lambda d: d == c)).cast("double"), F.lit(2.0)))
    free = classes - 1
    z_chi = (F.pow(F.greatest(squares * classes / n - n, F.lit(0.0)) / free, F.lit(1 / 3)) - (1 - 2 / (9 * free))) / F.sqrt(2 / (9 * free))
    next_ = F.slice("codes", 2, F.greatest(F.size("codes") - 1, F.lit(1)))
    high = F.size(F.filter("codes", lambda c: c > k / 2)).cast("double")
    changes = F.aggregate(F.zip_with(F.slice("codes", 1, F.size(next_)), next_, lambda a, b: ((a > k / 2) != (b > k / 2)).cast("int")), F.lit(0), lambda a, c: a + F.coalesce(c, F.lit(0))).cast("double")
    mean = 1 + 2 * high * (n - high) / n
    spread = F.sqrt(F.greatest((mean - 1) * (mean - 2) / (n - 1), F.lit(0.25)))
    few_runs = (mean - changes - 1) / spread  # ordinary strings keep to one side of the middle for long
    centre = (k + 1) / 2
    products = F.aggregate(F.zip_with(F.slice("codes", 1, F.size(next_)), next_, lambda a, b: (a - centre) * (b - centre)), F.lit(0.0), lambda a, c: a + F.coalesce(c, F.lit(0.0)))
    power = F.aggregate(F.transform("codes", lambda c: (c - centre) * (c - centre)), F.lit(0.0), lambda a, c: a + c)
    z_serial = F.abs(products / F.greatest(power, F.lit(1e-9))) * F.sqrt(n)
    p = F.least(F.lit(1.0), 3 * F.least(_tail(z_chi), 2 * _tail(F.abs(few_runs)), 2 * _tail(z_serial)))
    return x.withColumn("p", p).withColumn("distance", z_chi + few_runs + z_serial).drop("codes", "classes", "alphabet")


def _length_class(s: str) -> Column:
    size = F.char_length(s)
    return F.least(F.floor(F.log2(size) * 2), F.lit(14)).cast("int") - F.when(size < SHORT, 20).otherwise(0)


def decoys(strings: DataFrame) -> DataFrame:
    """(s, encoding): for each of strings (s, encoding, length_class, words), ordinary strings of its length (to DECOY_LENGTH), from its text's words and from plain ones."""
    of_class = strings.groupBy("encoding", "length_class").agg(F.min("s").alias("s")).select("s", "encoding", F.expr("cast(array() as array<string>)").alias("words"), F.explode(F.sequence(F.lit(DECOYS + 1), F.lit(DECOYS + CLASS_DECOYS))).alias("j"))
    each = strings.select("s", "encoding", "words", F.explode(F.sequence(F.lit(1), F.lit(DECOYS))).alias("j")).unionByName(of_class)
    draw = F.pmod(F.xxhash64("s", "j"), F.lit(1 << 30)).cast("int")
    plain, hexes = (F.array(*map(F.lit, x)) for x in (PLAIN, PLAIN_HEX))
    own = F.col("encoding").isin("hex", "upper hex")
    source = F.when(own, hexes).when((F.col("j") % 2 == 0) & (F.size("words") > 2), F.col("words")).otherwise(plain)
    each = each.withColumn("draw", draw).withColumn("source", source)
    number = F.substring(F.lpad((F.col("draw") % 9973).cast("string"), 4, "1"), 1, 4)
    lots = F.transform(F.sequence(F.lit(0), F.lit(DECOY_LENGTH // 3)), lambda i: F.get("source", F.pmod(F.col("draw") + i * (1 + F.col("draw") % 7), F.size("source"))))
    digits = F.regexp_like("s", F.lit("[0-9]"))
    cased = F.transform(lots, lambda w: F.when(F.col("encoding").isin("upper hex", "base32", "upper base36"), F.upper(w)).when(F.col("encoding") == "base64", F.initcap(w)).otherwise(F.lower(w)))
    joined = F.when(F.col("encoding") == "base64url", F.array_join(cased, "_")).otherwise(F.array_join(cased, ""))
    inside = 4 + F.col("draw") % 5
    joined = F.when(digits, F.concat(F.substring(joined, F.lit(1), inside), number, F.substring(joined, inside + 1, F.lit(DECOY_LENGTH)))).otherwise(joined)
    return each.select(F.substring(joined, F.lit(1), F.least(F.char_length("s"), F.lit(DECOY_LENGTH))).alias("s"), "encoding")


def random_bounds(tested: DataFrame, ordinary: DataFrame) -> DataFrame:
    """(encoding, length_class, centre, scale, bin_bound): of a class, how ordinary strings lie, and the bin of chances from which runs are reported.

    Bins are tenths of the decimal logarithm of the chance, so the corpus is judged from tables of bounded size.
    """
    lie = ordinary.groupBy("encoding", "length_class").agg(F.avg("distance").alias("centre"), F.greatest(F.coalesce(F.stddev("distance"), F.lit(0.0)), F.lit(0.5)).alias("scale"))
    bins = tested.join(F.broadcast(lie), ["encoding", "length_class"]).withColumn("bin", _bin()).groupBy("length_class", "bin").agg(F.count("*").alias("n"), F.sum((F.col("p") >= REJECT).cast("int")).alias("fit"))
    below = Window.partitionBy("length_class").orderBy(F.desc("bin"))
    ranked = bins.withColumn("most", F.sum("fit").over(below)).withColumn("all", F.sum("n").over(Window.partitionBy("length_class")))
    found = ranked.where(F.pow(F.lit(10.0), -F.col("bin") / 10) <= ALPHA * F.col("most") / F.col("all")).groupBy("length_class").agg(F.min("bin").alias("bin_bound"))
    return lie.join(F.broadcast(found), "length_class")


def _bin() -> Column:
    """The chance of an ordinary string to look as random, in tenths of its decimal logarithm."""
    return F.least(F.lit(300), F.floor(-10 * F.log10(F.greatest(_tail((F.col("centre") - F.col("distance")) / F.col("scale")), F.lit(1e-30))))).cast("int")


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["stop"].cast("string"))), ",")


def apart(added: DataFrame, base: DataFrame) -> DataFrame:
    """The spans (doc, row, x) that neither overlap a base span of their text (arrays k0, k1, ...) nor lie in a longer one of those that don't.

    A text's spans are swept twice in their order, so the time grows with their number alone, and a text of very many spans spills as any sort does.
    """
    texts = added.select("doc", "row").distinct().toDF("d", "r")
    held = base.join(texts, F.col("doc").eqNullSafe(F.col("d")) & (F.col("row") == F.col("r")), "left_semi")
    held = held.select("doc", "row", F.explode(F.concat(*[f"k{i}" for i in range(len(KINDS))])).alias("x")).distinct()
    both = added.select("doc", "row", "x", F.lit(True).alias("new")).unionByName(held.select("doc", "row", "x", F.lit(False).alias("new")))
    text = Window.partitionBy("doc", "row")
    sweep = text.orderBy("x.start", F.desc("x.stop"))
    upto, after = sweep.rowsBetween(Window.unboundedPreceding, -1), text.orderBy("x.start", F.desc("x.stop")).rowsBetween(1, Window.unboundedFollowing)
    stop, start = F.when(~F.col("new"), F.col("x.stop")), F.when(~F.col("new"), F.col("x.start"))
    met = both.withColumns({"before": F.coalesce(F.max(stop).over(upto), F.lit(0)), "next": F.min(start).over(after)})
    free = met.where(F.col("new") & (F.col("before") <= F.col("x.start")) & (F.col("next").isNull() | (F.col("next") >= F.col("x.stop"))))
    outer = free.withColumn("reach", F.max("x.stop").over(upto))
    return outer.where(F.col("reach").isNull() | (F.col("reach") < F.col("x.stop"))).select("doc", "row", "x")


def scan(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_assign, n_access, n_hex, base_sha256, spans), one row per row of df.

    spans: all spans as kind:start:stop (code points, end exclusive) by start, then kind, the battery's last as ``random``, joined by
    commas; base_sha256: digest of the base spans in that form. The battery adds no span that overlaps a base one, or lies in a longer
    one of its own. A null or empty text has none; rows that are equal have one result each. A very long text is scanned whole; the time
    for its n matches grows with n times log n. Columns of df besides key and text aren't read.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    docs = df.select(F.col(key).alias("doc"), F.xxhash64(key, text).alias("row"), t.alias("t"))
    kinds = [_spans(F.col("t"), i, *k) for i, k in enumerate(KINDS)]
    base = cut(docs.select("doc", "row", *[k.alias(f"k{i}") for i, k in enumerate(kinds)]))
    letters = F.regexp_extract_all("t", F.lit("[A-Za-z]{3,}"), F.lit(0))
    some = lambda x: F.slice(x, 1 + F.pmod("row", F.greatest(F.size(x) - OWN_WORDS, F.lit(1))).cast("int"), OWN_WORDS)
    held = _once(_mixed_runs(F.col("t")), lambda r: F.struct(r.alias("runs"), F.when(F.size(r) > 0, _once(letters, some)).alias("words")))
    mixed = cut(docs.select("doc", "row", held.alias("held"))).where(F.size("held.runs") > 0).select("doc", "row", "held.words", F.explode("held.runs").alias("run"))
    found = mixed.select("doc", "row", "words", F.explode(F.array_distinct(_parts(F.col("run")))).alias("part")).select("doc", "row", "words", F.col("part.span").alias("x"), F.col("part.s").alias("s"))
    runs = cut(inferred(found).withColumn("length_class", _length_class("s")))
    tested = battery(runs.drop("words")).select("doc", "row", "x", "encoding", "length_class", "p", "distance")
    ordinary = battery(decoys(runs)).withColumn("length_class", _length_class("s")).select("encoding", "length_class", "distance")
    tested = cut(tested)
    random = tested.join(F.broadcast(random_bounds(tested, ordinary)), ["encoding", "length_class"]).where((_bin() >= F.col("bin_bound")) & (F.col("p") >= REJECT))
    added = apart(random.select("doc", "row", "x").distinct(), base).groupBy("doc", "row").agg(F.collect_list("x").alias("added")).toDF("doc2", "row2", "added")
    all_ = base.join(added, F.col("doc").eqNullSafe(F.col("doc2")) & (F.col("row") == F.col("row2")), "left")
    own = F.array_sort(F.concat(*[f"k{i}" for i in range(len(KINDS))]))
    all_ = all_.select("doc", *[F.size(f"k{i}").cast("long").alias(f"n_{k[0]}") for i, k in enumerate(KINDS)], own.alias("own"), "added")
    every = F.when(F.col("added").isNull(), F.col("own")).otherwise(F.array_sort(F.concat("own", "added")))
    return all_.select(F.col("doc").alias(key), *[f"n_{k[0]}" for k in KINDS], F.sha2(_joined(F.col("own")), 256).alias("base_sha256"), _joined(every).alias("spans"))
