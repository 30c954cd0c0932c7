"""The queries opN_<name>: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import table


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.decontaminate import contaminated

    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_mpeg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm import mpeg

    media = mpeg.stored(table(spark, sf_dir, "documents"))
    ids = media.select(F.struct("doc_id", "n_bytes").alias("id"), "media")
    found = mpeg.analysed(ids, id_col="id")
    return found.select("doc_id.doc_id", "doc_id.n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")


def op3_redirect_equivalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.redirects import judged

    return judged(table(spark, sf_dir, "pages"))


def op4_quadratic_discriminant(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm import quality

    fold = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    labels = table(spark, sf_dir, "labels").where(~fold).select("doc_id", F.col("quality").alias("label"))
    measures, model = quality.learned(table(spark, sf_dir, "documents"), labels)
    out = quality.scored(measures, model)
    return out.select("doc_id", fold.alias("held_out"), "score", (F.col("score") >= quality.KEEP).cast("int").alias("predicted"))


def _of_kind(kind: str):
    return lambda x: x["kind"] == kind


def op5_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm import pii

    found = pii.detected(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda x: x["ord"] < len(pii.BASE))
    text = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    counts = [F.size(F.filter("spans", _of_kind(k))).cast("long").alias(f"n_{k}") for k in pii.BASE]
    return found.select("doc_id", *counts, F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.jaccard_join import jaccard_components

    out = jaccard_components(table(spark, sf_dir, "documents"), width=4, percent=85)
    return out.select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


def op7_sainte_lague_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.apportion import mixed

    return mixed(table(spark, sf_dir, "documents"))


def op8_cross_entropy_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.lm_score import cross_entropy_difference

    good = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return cross_entropy_difference(table(spark, sf_dir, "documents"), good)


def op9_chat_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.chat import rendered

    return rendered(table(spark, sf_dir, "conversations"))


def op10_gear_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.llm.chunk_dedup import repeats

    return repeats(table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {name: f for name, f in globals().items() if name.startswith("op")}


def oracle_sql() -> dict:
    from lodestone.llm.oracles import by_query

    return by_query()
