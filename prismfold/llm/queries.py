"""The registered queries of the training-data operators, each over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prismfold.llm import classifier, collocations, decontamination, extraction, hard_negatives, hidden_markov, jaccard_join, licenses, line_dedup, oracles, packing, perplexity, personal_data, repeats
from prismfold.llm.shared import read_table


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = classifier.fit(docs, read_table(spark, sf_dir, "labels"))
    return classifier.score(docs.select("doc_id", "text"), model).select(
        "doc_id",
        (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0).alias("held_out"),
        F.col("quality_score").alias("score"),
        (F.col("quality_score") >= 0.3).cast("int").alias("predicted"),
    )


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return perplexity.digest(perplexity.judge(docs, keep_text=False))


def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return personal_data.digest(personal_data.find_personal_data(docs))


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.link_documents(read_table(spark, sf_dir, "documents"), shingle=4, percent=85)


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.digest(repeats.drop_repeats(read_table(spark, sf_dir, "documents")))


def op6_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files: a thousand to a directory under their source, a hundred to one below; a document with a
    licence statement, wherever it stands, is a licence file of its directory."""
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    states = F.coalesce(F.col("text").rlike(r"(?i)licen[cs]ed under|released under"), F.lit(False))
    name = F.when(states, F.concat(F.lit("LICENSE."), F.col("doc_id"))).otherwise(F.concat(F.col("doc_id"), F.lit(".txt")))
    path = F.concat_ws("/", "source", F.expr("doc_id div 1000").cast("string"), F.expr("doc_id div 100").cast("string"), name)
    found = licenses.scan_licenses(docs.withColumn("path", path), path_col="path", text_col="text")
    return found.drop("source")


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extraction.digest(extraction.extract(pages))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontamination.digest(decontamination.find_contamination(docs, read_table(spark, sf_dir, "benchmark")))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = line_dedup.drop_lines(docs)
    n_lines = F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).cast("long")
    return kept.select("doc_id", "lines_removed", n_lines.alias("lines_kept"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op11_markov_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    tenth = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 10
    return hidden_markov.score_texts(docs, tenth != 0)


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(read_table(spark, sf_dir, "documents").select("lang", "text"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every hundredth row as anchor; each seventh row carries a wrong label."""
    rows = read_table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")
    rows = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives.mine(rows, F.col("vec_id") % 100 == 0)


QUERIES = {
    f.__name__: f
    for f in (
        op1_quality_classifier,
        op2_quality_rules,
        op3_personal_data,
        op4_ngram_jaccard_join,
        op5_suffix_array_dedup,
        op6_license_scans,
        op7_best_fit_packing,
        op8_html_extraction,
        op9_decontamination,
        op10_line_dedup,
        op11_markov_scoring,
        op12_collocations,
        op13_hard_negatives,
    )
}
ORACLES = oracles.ORACLES
