"""The registered queries: each applies one operator to its whole table and derives digest columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from careframe.llm import bpe, classifier, language_model, lines, mixing, near_duplicates, quality_rules, resampling, secrets, spelling, substrings, vectors, warc
from careframe.session import work_folder


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_mix(spark: SparkSession, folder: str) -> DataFrame:
    plan = mixing.schedule(mixing.entries(table(spark, folder, "documents")))
    rows = plan.withColumn("row", F.explode(F.sequence(F.lit(1).cast("long"), "times")))
    return rows.select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op2_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules.judge(table(spark, folder, "documents"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op4_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    found = secrets.per_path(docs, secrets.scan(docs, work_folder(spark, "secret-ledger")))

    def kind(name: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == name)).cast("long")

    base = F.filter("spans", lambda s: s["kind"].isin(*secrets.BASE_KINDS))
    return found.select(
        "doc_id", *[kind(k).alias(f"n_{k}") for k in secrets.BASE_KINDS],
        F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))


def op5_language_model(spark: SparkSession, folder: str) -> DataFrame:
    scored = language_model.score(table(spark, folder, "documents"), ~language_model.held_out())
    return scored.select(F.col("id").alias("doc_id"), (~F.col("learn")).alias("held_out"), "n_tokens", "n_known",
                         "train_tokens", "base_score", "score")


def op6_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    model = classifier.fit(docs, table(spark, folder, "labels"))
    scored = classifier.score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", classifier.held_out().alias("held_out"), "score",
                         (F.col("score") >= classifier.THRESHOLD).cast("int").alias("predicted"))


def op3_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    cut = lines.dedupe(docs, removed_col="n_removed")
    return cut.select("doc_id", "n_removed", F.size(F.split(F.coalesce("text", F.lit("")), "\n")).cast("long").alias("n_left"),
                      F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def op7_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    cut = substrings.remove(table(spark, folder, "documents"))
    return cut.select(F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op8_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    found = near_duplicates.classes(table(spark, folder, "documents"))
    return found.select(F.col("id").alias("doc_id"), "class_id")


def op9_vector_search(spark: SparkSession, folder: str) -> DataFrame:
    return vectors.search(table(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0)


def op10_bpe(spark: SparkSession, folder: str) -> DataFrame:
    path = tokenizer_path()
    encoded = bpe.encode(table(spark, folder, "documents").select("doc_id", "text"), path)
    return bpe.decode(encoded, path).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"))


def op11_importance_resampling(spark: SparkSession, folder: str) -> DataFrame:
    found = resampling.score_and_draw(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select(F.col("id").alias("doc_id"), "n_features", "weight", "score", "rank")


def op12_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.variants(table(spark, folder, "documents"), alter_every=97)


def op13_warc(spark: SparkSession, folder: str) -> DataFrame:
    place = work_folder(spark, "warc")
    warc.write_archives(table(spark, folder, "pages"), place)
    facts = warc.resolve(warc.read_archives(spark, place))
    return facts.select(F.col("id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
                        F.col("refers_to").cast("long").alias("refers_to"))


QUERIES = {
    "op1_mix": op1_mix,
    "op2_quality_rules": op2_quality_rules,
    "op3_line_dedup": op3_line_dedup,
    "op4_secret_scan": op4_secret_scan,
    "op5_language_model": op5_language_model,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_near_duplicates": op8_near_duplicates,
    "op9_vector_search": op9_vector_search,
    "op10_bpe": op10_bpe,
    "op11_importance_resampling": op11_importance_resampling,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_warc": op13_warc,
}
