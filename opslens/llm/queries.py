"""The corpus operators over the whole given tables."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    decontaminate,
    exact_dedup,
    langid,
    mixing,
    near_dedup,
    periodic_runs,
    pii,
    resampling,
    secrets,
    simhash,
    spans,
    sql,
    suffix_dedup,
    tokens,
    toxicity,
)
from .common import table
from .registry import QUERIES


@QUERIES.add("op1_language_id")
def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = langid.remainder("doc_id", 3) == 1
    model = langid.fit(docs.where(~held_out))
    found = langid.predictions(docs, model, doc_id="doc_id", held_out=held_out)
    return found.select("doc_id", "held_out", "lang_pred", "score")


@QUERIES.add("op2_suffix_dedup")
def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.without_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


@QUERIES.add("op3_secrets")
def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = secrets.fit([*secrets.labelled_samples(), *secrets.ordinary_words(docs)])
    return spans.digest(secrets.secret_spans(docs, model), secrets.KINDS, secrets.BASE_KINDS, kind_first=False)


@QUERIES.add("op4_mixing", sql.MIXING)
def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


@QUERIES.add("op5_decontamination", sql.DECONTAMINATION)
def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "n_shingles", "n_shared", "containment")


@QUERIES.add("op6_exact_dedup", sql.EXACT_DEDUP)
def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup.duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


@QUERIES.add("op7_toxicity")
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents"), langid.remainder("doc_id", 5) == 0
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").where(~held_out))
    return toxicity.toxicity(docs, model, doc_id="doc_id", held_out=held_out)


@QUERIES.add("op8_near_dedup")
def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size", "kept")


@QUERIES.add("op9_pii")
def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.pii_spans(table(spark, sf_dir, "documents"), pii.fit(pii.labelled_table()))
    return spans.digest(found, pii.KINDS, pii.KINDS, kind_first=True)


@QUERIES.add("op10_token_counts")
def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokens.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@QUERIES.add("op11_simhash_dedup")
def op11_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.simhash_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hexadecimal("fp").alias("fingerprint"), "component_id")


@QUERIES.add("op12_importance_resampling", sql.RESAMPLING)
def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


def planted(key: Column, text: Column) -> Column:
    """``text``, or for one key of ten its words with a repeated stretch: from a word on, all are those of the first period."""
    words = F.regexp_extract_all(text, F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))
    h = F.crc32(key.cast("string"))
    n, g = F.size(words), F.floor(h / 10)
    a = F.pmod(g, n)
    p = F.lit(1) + F.floor((n - a) / (F.lit(3) + F.pmod(g, F.lit(8))))

    def period(w: Column, i: Column) -> Column:
        """The words w with the repeated stretch; i: (a, p)."""
        at = lambda k: F.when(k < i["a"], k).otherwise(i["a"] + F.pmod(k - i["a"], i["p"]))
        return F.transform(w, lambda _, k: F.get(w, at(k).cast("int")))

    made = F.transform(F.array(F.struct(words.alias("w"), F.struct(a.alias("a"), p.alias("p")).alias("i"))), lambda x: F.array_join(period(x["w"], x["i"]), " "))
    return F.when((F.pmod(h, F.lit(10)) == 0) & (F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]")) > 0), F.get(made, F.lit(0))).otherwise(text)


@QUERIES.add("op13_periodic_runs")
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = periodic_runs.periodic_runs(docs, text=planted(F.col("doc_id"), F.col("text")))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    best = found.withColumn("best", periodic_runs.longest())
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(F.lit(1000) * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
