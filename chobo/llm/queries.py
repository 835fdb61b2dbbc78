"""The registered queries of this subpackage: each applies its operator to the whole intended table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chobo.llm import decontam, line_dedup, mixing, ranked_search, sharding, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chobo.llm.line_dedup import dedup_lines

    out = dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", "n_spans", F.sha2("text", 256).alias("kept_sha256"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", mixing.word_count().alias("size"))
    return mixing.mix_sources(docs, size_col="size")[1]


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chobo.llm.decontam import contamination

    return contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark")).drop("text")


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chobo.llm.near_dup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chobo.llm.lm_score import score, train

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    docs = docs.select("doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False)).alias("held_out"), "text")
    return score(docs, train(docs.filter("not held_out"), order=3)).drop("text")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chobo.llm.quality_rules import apply_rules, fit

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    trusted = table(spark, sf_dir, "labels").filter("quality = 1")
    return apply_rules(docs, fit(docs, trusted)).drop("text")


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chobo.llm.quality_classifier import score, train

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = lambda c: F.coalesce(F.crc32(F.col(c).cast("string")) % 4 == 2, F.lit(False))
    model = train(docs, table(spark, sf_dir, "labels").filter(~held_out("doc_id")))
    return score(docs, model).select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted")


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chobo.llm.suffix_dedup import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"), keep_bytes=False)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from chobo.llm.token_count import token_counts

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts(docs, public_tokenizers.path("byte_bpe_50k.json")).drop("text")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chobo.llm.sharding import shard_documents

    return shard_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))[0].drop("text")


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from chobo.llm.periodic_runs import longest, looped, periodic_runs

    docs = table(spark, sf_dir, "documents").select("doc_id", looped(F.col("text"), F.col("doc_id")).alias("text"))
    out = periodic_runs(docs).withColumn("top", longest())
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r.start, r.length, r.period), F.lit("\n"))), "")
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), *[F.col(f"top.{c}").alias(c) for c in ("start", "length", "period")],
        F.floor(1000 * F.col("top.length") / F.col("top.period")).cast("long").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2(F.coalesce("collapsed", F.lit("")), 256).alias("collapsed_sha256"),
    )


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    archive = warc.write(pages)
    found = warc.look_up(pages.select(*warc.one_page(F.col("url"), F.col("page_id"))), archive)
    out = warc.read_records(found, archive, payloads=False)
    return out.select(F.col("record_id").try_cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_line_dedup": op1_line_dedup,
    "op2_mixing": op2_mixing,
    "op3_decontamination": op3_decontamination,
    "op4_near_duplicates": op4_near_duplicates,
    "op5_lm_score": op5_lm_score,
    "op6_quality_rules": op6_quality_rules,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_token_counts": op9_token_counts,
    "op10_sharding": op10_sharding,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_warc": op12_warc,
    "op13_ranked_search": op13_ranked_search,
}

ORACLES: dict[str, str] = {
    "op1_line_dedup": line_dedup.ORACLE,
    "op2_mixing": mixing.ORACLE,
    "op3_decontamination": decontam.ORACLE,
    "op10_sharding": sharding.ORACLE,
    "op12_warc": warc.ORACLE,
    "op13_ranked_search": ranked_search.ORACLE,
}
