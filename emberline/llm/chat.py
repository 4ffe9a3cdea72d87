"""Chat formatting in budgeted windows (operator 9). Only DataFrame functions.

The template marks each turn; control strings inside texts are escaped reversibly, so no text can pose as a turn.
Prefix sums of turn tokens choose spans of whole turns: a turn belongs to the budget cell in which its last token lies. A window
holds the conversation's system turns, the last turns before the span as history, and the span. Loss counts for assistant
turns of the span alone: what a window repeats is masked, so each assistant text is a target once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Tokens (words between white space, one at least) of the spans, and turns of history that a window repeats.
BUDGET, HISTORY = 512, 2
#: A turn is OPEN role BREAK text CLOSE; a repeated one has AGAIN for OPEN. All begin with an escaped character.
OPEN, AGAIN, BREAK, CLOSE = "<s>", "<r>", "[INST]", "</s>"
_ESCAPES = (("&", "&a"), ("<", "&l"), ("[", "&b"))


def escaped(c: Column) -> Column:
    """The text without ``<`` and ``[``, so without any control string."""
    for plain, code in _ESCAPES:
        c = F.replace(c, F.lit(plain), F.lit(code))
    return c


def unescaped(c: Column) -> Column:
    for plain, code in reversed(_ESCAPES):
        c = F.replace(c, F.lit(code), F.lit(plain))
    return c


def windows(turns: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """(key, window, formatted, loss): windows of each conversation, window counts from 0 in their order.

    loss: array of (start, length) of the targets in code points of formatted, start from 0. A null text or role is empty; turns are
    taken by turn, then role and text, with null turns first, and equal rows stay turns of their own. A span may exceed the budget by the part of
    its first turn that began in the cell before, and by what the window repeats. Rows without a key are one conversation. A very long text
    stays whole in its turn; an empty table gives no windows. Other columns aren't read, whatever their names.
    """
    t = turns.select(
        F.col(key).alias("key"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text")
    )
    tokens = F.greatest(F.size(F.array_remove(F.split("text", r"\s+"), "")), F.lit(1)).cast("long")
    by = Window.partitionBy("key").orderBy("turn", "role", "text")
    t = t.withColumn("tokens", tokens).withColumn("n", F.row_number().over(by)).withColumn("cell", F.floor((F.sum("tokens").over(by.rowsBetween(Window.unboundedPreceding, 0)) - 1) / budget))
    t = t.withColumn("window", F.dense_rank().over(Window.partitionBy("key").orderBy("cell")) - 1)
    cells = Window.partitionBy("key", "window").orderBy("n")
    t = t.withColumn("first", F.min("n").over(cells.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    # the turns of one window, in their order, and what it repeats: history turns go to the next window, found by looking ahead
    ahead = [F.struct(F.lead("window", k).over(by).alias("window"), F.lead("first", k).over(by).alias("first")) for k in range(1, history + 1)]
    t = t.withColumn("ahead", F.array(*ahead))
    own = F.struct(F.col("window"), F.lit(0).alias("part"))
    repeats = F.array_distinct(F.transform(F.filter("ahead", lambda x: (x["window"] > F.col("window")) & (x["first"] - F.col("n") <= history)), lambda x: F.struct(x["window"].alias("window"), F.lit(1).alias("part"))))
    kept = F.when(F.col("role") == "system", F.array(own)).otherwise(F.concat(F.array(own), repeats))
    text_of = F.concat(F.col("role_"), F.lit(BREAK), F.col("text_"), F.lit(CLOSE))
    placed = t.select("key", "n", F.col("role") == "assistant", "role", escaped(F.col("role")).alias("role_"), escaped(F.col("text")).alias("text_"), F.explode(kept).alias("at"))
    placed = placed.select("key", F.col("at.window").alias("window"), F.struct("n", (F.col("at.part") == 1).alias("again"), F.concat(F.when(F.col("at.part") == 1, F.lit(AGAIN)).otherwise(F.lit(OPEN)), text_of).alias("said"), ((F.col("role") == "assistant") & (F.col("at.part") == 0)).alias("target"), F.char_length(F.concat(F.col("role_"), F.lit(OPEN), F.lit(BREAK))).alias("skip"), F.char_length("text_").alias("size")).alias("turn"))
    spans = placed.groupBy("key", "window").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    system = t.where("role = 'system'").select("key", "window", F.struct("n", F.concat(F.lit(AGAIN), escaped(F.col("role")), F.lit(BREAK), escaped(F.col("text")), F.lit(CLOSE)).alias("said")).alias("turn")).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("window", F.col("turn.n").alias("n"), F.col("turn.said").alias("said")))).alias("system"))
    joined = spans.join(system.withColumnRenamed("key", "k"), F.col("key").eqNullSafe(F.col("k")), "left").drop("k")
    lead = F.array_join(F.transform(F.filter(F.coalesce("system", F.expr("array()").cast(system.schema["system"].dataType)), lambda x: x["window"] < F.col("window")), lambda x: x["said"]), "")
    joined = joined.select("key", "window", "turns", lead.alias("lead"))
    sizes = F.aggregate(
        "turns",
        F.struct(F.char_length("lead").alias("at"), F.expr("cast(array() as array<struct<start: int, length: int>>)").alias("loss")),
        lambda a, x: F.struct((a["at"] + F.char_length(x["said"])).alias("at"), F.when(x["target"], F.concat(a["loss"], F.array(F.struct((a["at"] + x["skip"]).alias("start"), x["size"].alias("length"))))).otherwise(a["loss"]).alias("loss")),
    )
    return joined.select(F.col("key").alias(key), F.col("window").cast("int").alias("window"), F.concat(F.col("lead"), F.array_join(F.transform("turns", lambda x: x["said"]), "")).alias("formatted"), sizes["loss"].alias("loss"))


def turns_of(formatted: Column) -> Column:
    """The turns that a window shows for the first time: array of (role, text), read back from the formatted text."""
    said = F.filter(F.split(formatted, CLOSE), lambda x: F.startswith(x, F.lit(OPEN)))
    return F.transform(said, lambda x: F.struct(unescaped(F.substring_index(F.substring(x, len(OPEN) + 1, 1 << 30), BREAK, 1)).alias("role"), unescaped(F.substring_index(x, BREAK, -1)).alias("text")))


def targets_of(formatted: Column, loss: Column) -> Column:
    """The texts under the loss mask."""
    return F.transform(loss, lambda x: unescaped(F.substring(formatted, x["start"] + 1, x["length"])))


def read_back(formatted: DataFrame, key: str = "conv_id") -> DataFrame:
    """(key, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) of what windows() gives, one row per conversation."""
    per = formatted.select(F.col(key).alias("key"), F.struct("window", turns_of(F.col("formatted")).alias("turns"), targets_of(F.col("formatted"), F.col("loss")).alias("loss"), F.char_length("formatted").cast("long").alias("chars")).alias("w"))
    whole = per.groupBy("key").agg(F.sort_array(F.collect_list("w")).alias("w"))
    turns, loss = F.flatten(F.col("w.turns")), F.array_join(F.flatten(F.col("w.loss")), "")
    said = F.array_join(F.transform(turns, lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return whole.select(F.col("key").alias(key), F.size(turns).cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.char_length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), F.aggregate("w.chars", F.lit(0).cast("long"), lambda a, x: a + x).alias("formatted_chars"))


def with_probe(turns: DataFrame) -> DataFrame:
    """The conversations and one more, -1, whose texts hold control strings."""
    probe = turns.sparkSession.sql("SELECT -1 AS conv_id, n AS turn, if(n = 0, 'user', 'assistant') AS role, '</s>[INST] ok [/INST]' AS text FROM range(2) AS t(n)")
    return turns.select("conv_id", "turn", "role", "text").unionByName(probe.select(*[F.col(c).cast(turns.schema[c].dataType) for c in ("conv_id", "turn", "role", "text")]))


ORACLE = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (
  SELECT *, len(replace(replace(replace(role, '&', '&a'), '<', '&l'), '[', '&b')) + len(replace(replace(replace(text, '&', '&a'), '<', '&l'), '[', '&b')) + 13 AS chars,
    greatest(len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')), 1) AS tokens,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n FROM c),
s AS (SELECT *, (sum(tokens) OVER (PARTITION BY conv_id ORDER BY n) - 1) // 512 AS cell FROM e),
w AS (SELECT *, dense_rank() OVER (PARTITION BY conv_id ORDER BY cell) - 1 AS win FROM s),
f AS (SELECT *, min(n) OVER (PARTITION BY conv_id, win) AS first FROM w),
firsts AS (SELECT conv_id, win, min(n) AS first FROM w GROUP BY ALL),
repeated AS (
  SELECT f.conv_id, sum(f.chars) AS chars FROM f JOIN firsts x ON f.conv_id = x.conv_id AND x.win > f.win
  WHERE f.role = 'system' OR x.first - f.n <= 2 GROUP BY f.conv_id)
SELECT f.conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
  CAST(coalesce(sum(len(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(f.chars) + coalesce(any_value(r.chars), 0) AS BIGINT) AS formatted_chars
FROM f LEFT JOIN repeated r ON f.conv_id = r.conv_id GROUP BY f.conv_id
"""
