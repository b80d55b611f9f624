"""The registered queries: each maps the given tables to an operator's records and its results back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import archive, blobs, bytepairs, crosswalk, dialogue, leakage, loading, passages, repetition, shards, similar, store, surrogates, voting
from .checks import SQL

KEY = "delivery-network"  # key of the surrogates


def _read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


def _records(spark: SparkSession, sf: str) -> DataFrame:
    """documents as the records of the operators."""
    return _read(spark, sf, "documents").select(F.col("doc_id").alias("customer_id"), F.col("text").alias("address"))


def op1_repetition(spark: SparkSession, sf: str) -> DataFrame:
    out = repetition.repetition_verdicts(_records(spark, sf))
    r = [F.col(f"repetition.{c}").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")]
    return out.select(F.col("customer_id").alias("doc_id"), *r)


def op2_histogram_shards(spark: SparkSession, sf: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    orders = _read(spark, sf, "documents").select(F.col("doc_id").alias("order_id"), (F.octet_length(text) + 16).cast("long").alias("package_bytes"), F.crc32(text.cast("binary")).alias("text_crc32"))
    out = shards.balanced_shards(orders, shards=40)
    return out.select(F.col("order_id").alias("doc_id"), F.col("package_bytes").alias("size"), "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard"))


def op3_ngram_join(spark: SparkSession, sf: str) -> DataFrame:
    out = similar.similar_records(_records(spark, sf), words=5, percent=75)
    return out.select(F.col("customer_id").alias("doc_id"), "n_shingles", "component_id")


def op4_secret_ledger(spark: SparkSession, sf: str) -> DataFrame:
    docs = _read(spark, sf, "documents").select(F.col("doc_id").alias("path"), "text")
    found, _ = blobs.scan_versions(docs)
    kinds = [r.kind for r in blobs.RULES]

    def tagged(i: int, k: str):
        return F.transform(F.col(k), lambda s: F.struct(s["start"].alias("start"), F.lit(i).alias("i"), F.lit(k).alias("kind"), s["end"].alias("end")))

    rows = F.flatten(F.array(*[tagged(i, k) for i, k in enumerate(kinds)]))
    spans = F.array_join(F.transform(F.array_sort(rows), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select(F.col("path").alias("doc_id"), *[F.size(k).cast("long").alias(f"n_{k}") for k in kinds], F.sha2(spans, 256).alias("base_sha256"), spans.alias("spans"))


def op5_neighbour_votes(spark: SparkSession, sf: str) -> DataFrame:
    held_out = F.crc32(F.col("customer_id").cast("string").cast("binary")) % 3 == 1
    ratings = _read(spark, sf, "labels").select(F.col("doc_id").alias("customer_id"), F.col("quality").alias("is_good")).where(~held_out)
    out = voting.vote_quality(_records(spark, sf), ratings)
    return out.select(F.col("customer_id").alias("doc_id"), held_out.alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= 0.5).cast("int").alias("predicted"))


def op6_leaked_items(spark: SparkSession, sf: str) -> DataFrame:
    out = leakage.strip_leaks(_records(spark, sf), _read(spark, sf, "benchmark"), window=10)
    hit = F.col("leak.n_hit")
    return out.select(F.col("customer_id").alias("doc_id"), F.col("leak.n_words").alias("n_words"), hit.alias("n_hit"), F.size("leak.items").cast("long").alias("n_items"), F.sha2(F.array_join("leak.items", ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


def op7_warc_chunks(spark: SparkSession, sf: str) -> DataFrame:
    folder = store.shared_path(spark, "archives")
    run = archive.write_archives(_read(spark, sf, "pages"), folder)
    out = archive.read_archives(spark, folder, run)
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact")


def op8_best_fit(spark: SparkSession, sf: str) -> DataFrame:
    import public_tokenizers

    docs = _read(spark, sf, "documents")
    pieces = loading.token_pieces(docs, "doc_id", "text", public_tokenizers.path("byte_bpe_50k.tiktoken"), capacity=2048)
    loads = loading.load_orders(pieces.withColumnsRenamed({"key": "order_id", "length": "items_count"}), units="items_count", capacity=2048)
    return loads.select(F.col("order_id").alias("doc_id"), "piece", "start", F.col("items_count").alias("length"), "ids_crc32", F.col("vehicle").alias("sequence_id"), F.col("load_offset").alias("offset"))


def op9_fuzzy_passages(spark: SparkSession, sf: str) -> DataFrame:
    out = passages.repeated_passages(_records(spark, sf), min_words=50)
    return out.withColumnsRenamed({"customer_id": "doc_id", "other_id": "other_doc_id"})


def op10_surrogates(spark: SparkSession, sf: str) -> DataFrame:
    out = surrogates.replace_entities(_records(spark, sf), key=KEY)
    return out.select(F.col("customer_id").alias("doc_id"), "surrogates.*")


def op11_dialogue_repair(spark: SparkSession, sf: str) -> DataFrame:
    turns = _read(spark, sf, "conversations")
    out = dialogue.repair_conversations(dialogue.damaged_turns(turns)).withColumnRenamed("conv_id", "repaired_id")
    # conversations of which nothing is left count as well
    every = turns.select("conv_id").distinct().join(out, F.col("conv_id").eqNullSafe(F.col("repaired_id")), "left")
    zero = [F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return every.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


def op12_byte_bpe(spark: SparkSession, sf: str) -> DataFrame:
    import public_tokenizers

    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    out = bytepairs.with_decoded(bytepairs.with_tokens(_records(spark, sf), ranks), ranks)
    return out.select(F.col("customer_id").alias("doc_id"), F.col("tokens.n_tokens").alias("n_tokens"), F.sha2("tokens.ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op13_token_crosswalk(spark: SparkSession, sf: str) -> DataFrame:
    import public_tokenizers

    files = [public_tokenizers.path(f) for f in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
    n = ["n_a", "n_b", "n_groups", "n_links"]
    groups = F.when(F.col("alignment.n_a") > 0, F.sha2("alignment.groups", 256)).otherwise("").alias("groups_sha256")
    aligned = crosswalk.align_tokens(_records(spark, sf), *files).select("customer_id", *[F.col(f"alignment.{c}").alias(c) for c in n], groups, F.col("alignment.links").alias("links"))
    out = crosswalk.with_link_counts(aligned, *files)
    return out.select(F.col("customer_id").alias("doc_id"), *n, F.col("linked.n_best").alias("n_best"), F.col("linked.count_sum").alias("count_sum"), "groups_sha256")


def pipeline(spark: SparkSession, sf: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf)


QUERIES = {f.__name__: f for f in (op1_repetition, op2_histogram_shards, op3_ngram_join, op4_secret_ledger, op5_neighbour_votes, op6_leaked_items, op7_warc_chunks, op8_best_fit, op9_fuzzy_passages, op10_surrogates, op11_dialogue_repair, op12_byte_bpe, op13_token_crosswalk, pipeline)}


def oracle_sql() -> dict[str, str]:
    import corpus_pipeline

    return SQL | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
