"""From documents to packed training sequences: five stages, each written and read again as the next one's input.

A stage takes (spark, docs, sf_dir) and works on every document that the one before kept.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fleetspan.llm import leakage, loading, repetition, similar, store, surrogates
from fleetspan.session import tune

#: Packing has no SQL form; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def _tuned(stage):
    """``stage`` under the library's session settings, whoever runs it."""

    @wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        return stage(tune(spark), docs, sf_dir)

    return run_stage


@_tuned
def drop_repetitive(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules on repetition."""
    (verdict,) = store.unused(docs.columns, "_verdict")
    return repetition.repetition_verdicts(docs, "text", as_column=verdict).where(F.col(f"{verdict}.kept")).drop(verdict)


@_tuned
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that with the smallest id; texts without words have no group and stay."""
    groups = store.stored(similar.similar_records(docs, "doc_id", "text").select("customer_id", "class_id", "component"), "groups").where("component is not null")
    sign, least, cls, place = store.unused(docs.columns, "_s", "_id", "_cls", "_r")
    first = groups.groupBy("component").agg(F.min(F.struct(F.col("customer_id").isNull(), F.col("customer_id").alias("id"), F.col("class_id").alias("cls"))).alias("k")).select(F.col("k.id").alias(least), F.col("k.cls").alias(cls))
    # the chosen row is found by id and fingerprint; rows that repeat it are told apart by their content's order
    marked = docs.withColumn(sign, similar.signature(5)(F.col("text")))
    keep = marked.where(F.col(f"{sign}.n") > 0).join(first, F.col("doc_id").eqNullSafe(F.col(least)) & (F.col(f"{sign}.f1") == F.col(cls)))
    one = keep.withColumn(place, F.row_number().over(Window.partitionBy(least, cls).orderBy("text", "source"))).where(F.col(place) == 1)
    return one.select(*docs.columns).unionByName(marked.where(F.col(f"{sign}.n") == 0).select(*docs.columns))


@_tuned
def remove_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages of benchmark items; those that are mostly such passages go."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    (leak,) = store.unused(docs.columns, "_leak")
    out = leakage.strip_leaks(docs, items, "text", as_column=leak).where(F.col(f"{leak}.kept"))
    return _with_text(out, docs, F.col(f"{leak}.clean"))


@_tuned
def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with surrogates for personal data."""
    (new,) = store.unused(docs.columns, "_new")
    out = surrogates.replace_entities(docs, "text", key="delivery-network", as_column=new)
    return _with_text(out, docs, F.col(f"{new}.text"))


@_tuned
def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in training sequences of at most 2048 tokens."""
    import public_tokenizers

    pieces = loading.token_pieces(docs, "doc_id", "text", public_tokenizers.path("byte_bpe_50k.tiktoken"))
    loads = loading.load_orders(pieces, units="length", capacity=2048)
    return loads.withColumnsRenamed({"key": "doc_id", "vehicle": "sequence_id", "load_offset": "offset"})


def _with_text(out: DataFrame, docs: DataFrame, text) -> DataFrame:
    return out.select(*[text.alias("text") if c == "text" else F.char_length(text).cast("long").alias("n_chars") if c == "n_chars" else F.col(c) for c in docs.columns])


STAGES = [("quality rules", drop_repetitive), ("n-gram Jaccard join", drop_near_copies), ("benchmark decontamination", remove_benchmark), ("PII", replace_personal_data), ("best-fit packing", pack_sequences)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = store.stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return stage_last(spark, docs, sf_dir)


def stage_last(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return store.stored(STAGES[-1][1](spark, docs, sf_dir), "sequences")
