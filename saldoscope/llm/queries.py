"""Registered queries of the llm operators, and SQL that computes the same where SQL can."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, line_dedup, merkle, minhash, pieces, pii, quality, repair, shards, spelling, sql, token_counts, warc
from .base import table


def held_out() -> F.Column:
    """Rows that labels are never learnt from."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0


def op1_pii_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_spans(table(spark, sf_dir, "documents"))
    return found.select("doc_id", *[f"n_{k}" for k in pii.KINDS], F.sha2(pii.listed("base"), 256).alias("base_sha256"), pii.listed("spans").alias("spans"),
                        (F.size("spans") - F.size("base")).cast("long").alias("n_term"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


def op3_quality_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    learn = F.crc32(F.col("_id").cast("string").cast("binary")) % 5 != 0
    scored = quality.score(docs, quality.fit(docs, labels, allowed=learn))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    back = pieces.decode(pieces.encode(docs))
    return back.select("doc_id", F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_pieces"), "ids", F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"), F.col("decoded").eqNullSafe(F.col("text")).alias("round_trip"))


def op5_line_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.deduplicate_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_deleted", F.length("text").cast("long").alias("n_chars_kept"), F.sha2(F.encode("text", "UTF-8"), 256).alias("text_sha256"))


def op6_warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), percent=85).select("doc_id", "n_shingles", "component_id", "kept")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = decontaminate.judge(decontaminate.find_hits(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark")))
    names = F.array_sort(F.transform("items", lambda i: i.cast("string")))
    return hits.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(names, ","), 256).alias("items_sha256"), "contaminated")


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    text = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(text).alias("text"))
    return chat.read_back(chat.format_chats(turns.unionByName(extra)))


def op10_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = merkle.compare_with_next(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_chars", F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"), F.col("root").alias("fingerprint"), F.col("edited_root").alias("edited_fingerprint"), "near_edited", "near_next",
                      F.col("edited_at").alias("edited_paragraphs"))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.vocabulary(table(spark, sf_dir, "documents"), spoil=True)).select("word", "n", "n_near", "form", "form_n", "root")


def op12_slot_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shards.shard_documents(table(spark, sf_dir, "documents"), 8)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "map_version")


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    fixed = repair.repair(repair.damage(turns)).withColumnRenamed("conv_id", "_conv")
    every = turns.select(F.col("conv_id").cast("long").alias("conv_id")).distinct().join(fixed, F.col("conv_id").eqNullSafe(F.col("_conv")), "left")
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return every.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline
    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_pii_disclosure, op2_token_counts, op3_quality_knn, op4_sentencepiece, op5_line_winnowing, op6_warc_salvage,
                                   op7_minhash, op8_decontamination, op9_chat_format, op10_merkle,
                                   op11_spelling_variants, op12_slot_sharding, op13_conversation_repair, pipeline)}
SQL: dict[str, str] = {"op6_warc_salvage": sql.OP6, "op7_minhash": sql.OP7, "op8_decontamination": sql.OP8, "op9_chat_format": sql.OP9,
                       "op11_spelling_variants": sql.OP11, "op13_conversation_repair": sql.OP13}
