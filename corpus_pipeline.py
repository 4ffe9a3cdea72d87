"""A corpus from raw documents to token ids, in stages that each call one operator.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next stage's
docs. All but the last return the columns of documents.

In every stage a null text counts as empty, an empty text is never a reason to go, a text of any length is judged whole, rows that are equal meet the same fate unless the stage
says otherwise, an empty table stays empty, and other columns don't matter
(of clashing names, n_lines and n_dropped are those of line dedup).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.llm import leaks, lines, near, pieces, toxic
from emberline.llm.common import documents, shared_folder
from emberline.llm.queries import piece_model_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go, all rows of an id alike if their texts are. Without labels to learn from none goes. Rows without an id stay or go by their text."""
    return toxic.without_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document holds go; n_chars follows the text. Every document stays, and so does a null text's empty line. Of rows of one id each keeps its lines."""
    kept = lines.dedup_lines(docs)
    return kept.select(*[F.char_length("text").cast(docs.schema["n_chars"].dataType).alias(c) if c == "n_chars" else c for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked documents the one with the smallest id stays; repeated rows of that id all do. Texts of no words are linked with nothing and stay."""
    return near.without_near_duplicates(docs, size=5, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go. An empty benchmark, or one of null and empty texts, takes none."""
    return leaks.without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, and the text decoded from them, as digests: a row for each row, a null text as begin and end alone."""
    return pieces.encode_digests(docs, piece_model_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("near dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("pieces", encode),
]

#: The toxicity model is trained, which SQL can't express; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, place = documents(spark, sf_dir), f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{place}/{k}")
        docs = spark.read.parquet(f"{place}/{k}")
    return docs
