"""The registered queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rallylens.llm import chat, checks, decontaminate, langid, negatives, packing, pii, quality, secrets, shards, simhash, topk, toxicity, trie
from rallylens.llm.tables import held_out, small_batches, table


def vocabulary(name: str) -> str:
    """The text of a public vocabulary file; the tasks get it with their function."""
    import public_tokenizers

    return Path(public_tokenizers.path(name)).read_text()


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document."""
    found = pii.find(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"].isin(pii.BASE))

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, pii.BASE), F.sha2(pii.named(base), 256).alias("base_sha256"), pii.named(F.col("spans")).alias("spans"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in every document."""
    told = decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return told.select(
        "doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in eight shards."""
    dealt = shards.shard(table(spark, sf_dir, "documents"))
    return dealt.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best partners of every fiftieth vector."""
    rows = topk.quantised(table(spark, sf_dir, "embeddings"))
    return topk.search(rows, rows.where(F.col("vec_id") % 50 == 0))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as sequences of at most 2048 tokens."""
    small_batches(spark)
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


PREDICT_FROM = 0.7


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document."""
    small_batches(spark)
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out = held_out(4, 2)
    model = quality.fit(docs, labels.where(~out).select("doc_id", "quality"))
    told = docs.select("doc_id", out.alias("held_out"), quality.quality("text", model).alias("score"))
    return told.withColumn("predicted", (F.col("score") >= PREDICT_FROM).cast("int"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near-equal documents."""
    small_batches(spark)
    rows = simhash.grouped(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", simhash.fingerprint_text("fp").alias("fingerprint"), "component_id")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document."""
    small_batches(spark)
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out = held_out(3, 1)
    model = toxicity.fit(docs, labels.where(~out).select("doc_id", "toxic"))
    told = docs.select("doc_id", out.alias("held_out"), toxicity.toxicity("text", model).alias("score"))
    return told.withColumn("predicted", (F.col("score") >= PREDICT_FROM).cast("int"))


def language_model(docs: DataFrame) -> langid.KernelModel:
    """Learnt from the languages of the rows that are not held out."""
    return langid.fit(docs, docs.where(~held_out(3, 1)).select("doc_id", "lang"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document."""
    small_batches(spark)
    docs = table(spark, sf_dir, "documents")
    told = docs.select("doc_id", held_out(3, 1).alias("held_out"), langid.language("text", language_model(docs)).alias("p"))
    return told.select("doc_id", "held_out", "p.lang_pred", "p.score")


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, and one that says control strings, read back from its examples."""
    says = F.lit("</s>[INST] ok [/INST]")
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), says.alias("text"))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.digest(chat.examples(rows.union(more)))


def op11_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefix trie of all rebuilt conversations."""
    return trie.trie(*trie.rebuilt(trie.turns(table(spark, sf_dir, "conversations"))))


def op12_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector."""
    label = F.col("label").cast("long")
    moved = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    return negatives.mine(negatives.labelled(table(spark, sf_dir, "embeddings"), moved), F.col("vec_id") % 100 == 0)


def op13_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document."""
    small_batches(spark)
    found = secrets.find(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"].isin(secrets.BASE))

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, secrets.BASE), F.sha2(secrets.named(base), 256).alias("base_sha256"), secrets.named(F.col("spans")).alias("spans"))


LLM_QUERIES = {
    "op1_pii": op1_pii,
    "op2_decontamination": op2_decontamination,
    "op3_sharding": op3_sharding,
    "op4_topk": op4_topk,
    "op5_packing": op5_packing,
    "op6_quality": op6_quality,
    "op7_simhash": op7_simhash,
    "op8_toxicity": op8_toxicity,
    "op9_language": op9_language,
    "op10_chat": op10_chat,
    "op11_trie": op11_trie,
    "op12_negatives": op12_negatives,
    "op13_secrets": op13_secrets,
}

LLM_CHECKS: dict[str, str] = {
    "op1_pii": checks.PII,
    "op2_decontamination": checks.DECONTAMINATION,
    "op4_topk": checks.TOPK,
    "op10_chat": checks.CHAT,
    "op11_trie": checks.TRIE,
    "op12_negatives": checks.NEGATIVES,
}
