"""The corpus pipeline: toxic documents go, one document of each near-duplicate group stays, repeated passages are cut, contaminated documents go,
and what is left is packed. Each stage is (spark, docs, sf_dir) -> DataFrame over all that the stage before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspan.llm.core import checkpoint_dir, delete, matching, materialize, read, with_row_key
from larkspan.llm.minhash import near_duplicates
from larkspan.llm.packing import pack
from larkspan.llm.suffix_dedup import suffix_dedup
from larkspan.llm.toxicity import toxicity
from larkspan.llm.winnow import decontaminate
from larkspan.session import ship

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Bytes of a repeated passage that a later copy loses.
REPEAT_BYTES = 100


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier does not reject, each by its own verdict, whatever its id.

    Null, empty and repeated texts are judged as ``toxicity`` says (without windows: as ordinary); no labels: nothing is toxic unless most are. Empty
    table: empty result. Columns beside those of documents are left out."""
    return toxicity(docs, read(ship(spark), sf_dir, "labels"), carry=COLUMNS[2:]).where("predicted = 0").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates (five words, similarity 0.8): that of the smallest id; a row without an id only if the group has none
    with one; of rows with one id, the one that was read first.

    Rows have a key of their own, so those without an id or with a repeated one have a verdict of their own. Null texts and texts without words are
    in no group and stay. Empty table: empty result. Columns beside those of documents are left out."""
    rows = with_row_key(docs, COLUMNS)
    found = materialize(near_duplicates(rows, id_col="row").select(F.col("doc_id").alias("row"), F.col("component_id").alias("component")))
    # Only rows of groups of several are compared by id: those with another's component, and the rows that these components are named by.
    others = found.where("row <> component")
    grouped = others.union(others.select(F.col("component").alias("row"), "component").distinct())
    members = materialize(grouped.join(rows.select("row", "doc_id"), "row").select("row", "component", F.struct(F.col("doc_id").isNull(), "doc_id", "row").alias("place")))
    stays = members.groupBy("component").agg(F.min("place").alias("place")).select(F.col("place.row").alias("row"))
    return matching(rows, members.select("row").join(stays, "row", "left_anti"), "left_anti").select(*COLUMNS)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row, its text without the passages of ``REPEAT_BYTES`` bytes that also start earlier (smaller id, or same document); characters stay whole.
    n_chars is counted anew where something was cut.

    Null and empty texts stay as they are. Rows without an id stay uncut and are no source of copies; rows with one id and one text are one
    document. Empty table: empty result. Columns beside those of documents are left out."""
    ship(spark)
    cut = suffix_dedup(docs, REPEAT_BYTES, carry=["lang", "source", "n_chars"])
    n_chars = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return cut.select("doc_id", "text", "lang", "source", n_chars.alias("n_chars"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that are not contaminated by the benchmark, each by its own verdict, whatever its id.

    Null texts and texts without words are not contaminated. Empty table, or empty benchmark: as it was. Columns beside those of documents are left out."""
    return decontaminate(docs, read(ship(spark), sf_dir, "benchmark"), carry=COLUMNS[2:]).where("NOT contaminated").select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows as pieces in sequences of at most 1024 ids, as ``pack`` says. Null texts are empty documents; rows without an id have a null doc_id;
    repeated rows are packed each. Empty table: empty result."""
    ship(spark)
    return pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("suffix_dedup", cut_repeats),
    ("decontamination", drop_contaminated),
    ("packing", pack_sequences),
]

#: Compression distance and byte-pair encoding are not expressible in SQL; tests/llm/test_pipeline.py checks the stages on planted cases, and
#: tests/llm/test_exact.py the operators against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. Each result is written to the shared folder and read again, so a lost executor costs one stage at most; once the next
    one is written it is removed. What is returned reads the last one, whose folder stays."""
    from uuid import uuid4

    folder = f"{checkpoint_dir(spark)}/pipeline-{uuid4().hex}"
    docs, before = read(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            delete(spark, before)
        before = f"{folder}/{name}"
    return docs
