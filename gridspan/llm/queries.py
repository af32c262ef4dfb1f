"""The registered queries of this package: thin, over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without repeated 100-byte strings."""
    from .repeats import remove_repeats

    return remove_repeats(_read(spark, sf_dir, "documents"))


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item, with the item."""
    from .decontamination import contaminated

    return contaminated(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's near-duplicate component."""
    from .jaccard import near_duplicates

    return near_duplicates(_read(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's counts, votes, posterior quality and verdict."""
    from .quality_rules import quality

    found = quality(_read(spark, sf_dir, "documents"))
    first = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return found.select(*first, F.round("posterior", 6).alias("posterior"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's personal data."""
    from .pii import find_pii

    return find_pii(_read(spark, sf_dir, "documents"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to dictionary-compressed archives and read back."""
    from .warc import read_archives, write_archives

    return read_archives(write_archives(_read(spark, sf_dir, "pages")))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's token pieces, packed into sequences of 2048 tokens."""
    import public_tokenizers

    from .packing import pack

    return pack(_read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's calibrated probability of good quality."""
    from .quality_model import classify

    return classify(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op9_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's secrets, with how many look live and how many are examples."""
    from .secrets import scan

    return scan(_read(spark, sf_dir, "documents"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard of eight, by bytes, copies together."""
    from .sharding import shard

    return shard(_read(spark, sf_dir, "documents"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's runs of repeated words, some of them planted by its doc_id, and what is left without the repeats."""
    from .runs import find_runs, planted

    return digests(find_runs(planted(_read(spark, sf_dir, "documents"))))


def digests(found: DataFrame) -> DataFrame:
    """The longest run by exponent, and digests of all runs and of the collapsed text. found: see `runs.find_runs`."""
    longer = lambda best, r: F.when(r["length"] * best["period"] > best["length"] * r["period"], r).otherwise(best)
    best = F.aggregate("runs", F.get("runs", F.lit(0)), longer)
    line = lambda r: F.concat_ws(",", *(r[c].cast("string") for c in ("start", "length", "period")))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "")
    told = found.withColumn("best", best)
    parts = [F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")]
    milli = F.expr("1000 * best.length div best.period").cast("long")
    return told.select("doc_id", F.size("runs").cast("long").alias("n_runs"), *parts, milli.alias("exponent_milli"), F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))


def op12_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's component of near copies, and whether it stays."""
    from .odd_sketches import near_copies

    return near_copies(_read(spark, sf_dir, "documents"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every anchor's positives with their hard negatives."""
    from .negatives import mine

    rows = _read(spark, sf_dir, "embeddings")
    label, finite = F.col("label").cast("long"), F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    label = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    vector = F.transform("embedding", lambda x: F.floor(256 * x.cast("double")).cast("long"))
    return mine(rows.filter(finite).select("vec_id", label.alias("label"), vector.alias("vector")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_suffix_array_dedup": op1_suffix_array_dedup,
        "op2_benchmark_decontamination": op2_benchmark_decontamination,
        "op3_ngram_jaccard_join": op3_ngram_jaccard_join,
        "op4_quality_rules": op4_quality_rules,
        "op5_pii": op5_pii,
        "op6_warc": op6_warc,
        "op7_best_fit_packing": op7_best_fit_packing,
        "op8_quality_classifier": op8_quality_classifier,
        "op9_secret_scans": op9_secret_scans,
        "op10_sharding": op10_sharding,
        "op11_periodic_runs": op11_periodic_runs,
        "op12_minhash_near_dedup": op12_minhash_near_dedup,
        "op13_hard_negatives": op13_hard_negatives,
    }


def oracle_sql() -> dict[str, str]:
    from . import oracle

    return {"op2_benchmark_decontamination": oracle.OP2, "op3_ngram_jaccard_join": oracle.OP3, "op9_secret_scans": oracle.op9(), "op12_minhash_near_dedup": oracle.OP12, "op13_hard_negatives": oracle.OP13}
