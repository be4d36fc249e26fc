"""Reads to variant tables in one call."""

from __future__ import annotations

import os
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.functions.sequences import hex_key
from tidepool.operators.chimera import remove_chimeras
from tidepool.operators.denoise import DenoiseConfig, denoise, denoise_pooled, denoise_pseudo
from tidepool.operators.dereplicate import dereplicate
from tidepool.operators.error_fit import ErrorConfig, ErrorModel, learn_errors
from tidepool.operators.errors import first_of_each
from tidepool.operators.filtering import FilterConfig, filter_pairs, filter_reads
from tidepool.operators.merge import MergeConfig, merge_pairs
from tidepool.sources.fastq import per_file, read_fastq, stem, write_fastq
from tidepool.tables import stored


@dataclass(frozen=True)
class PipelineConfig:
    fwd: FilterConfig = FilterConfig()
    rev: FilterConfig = field(default_factory=lambda: FilterConfig(max_ee=5.0))
    errors: ErrorConfig = ErrorConfig()
    denoise: DenoiseConfig = DenoiseConfig()
    merge: MergeConfig = MergeConfig()
    pool: str = "many"  # many, pseudo or pooled
    least_reads: int = 5_000
    separate_errors: bool = False  # learn the reverse reads' model from themselves
    chimeras_first: bool = False  # judge each sample's copy of a variant by itself, before summing


#: The preset of the benchmark: a model for each mate, priors shared by all samples.
BENCH = PipelineConfig(
    fwd=FilterConfig(trunc_len=230, min_len=150, max_ee=3.0), rev=FilterConfig(trunc_len=210, min_len=150, max_ee=5.0), errors=ErrorConfig(n_reads=20_000),
    merge=MergeConfig(min_overlap=12), pool="pseudo", separate_errors=True,
)

_DENOISERS = {"many": denoise, "pseudo": denoise_pseudo, "pooled": denoise_pooled}


def learning_reads(reads: DataFrame, config: PipelineConfig) -> DataFrame:
    """The first filtered reads of each sample that errors are learned from."""
    if not config.errors.n_reads:
        return reads
    n = reads.select("sample").distinct().count()
    # A record's number may have gaps and need not count its sample's reads, so reads are counted.
    return first_of_each(reads, per_file(config.errors.n_reads, n, config.least_reads))


def _learn(reads: DataFrame, config: PipelineConfig) -> ErrorModel:
    return learn_errors(learning_reads(reads, config), config.errors)


def single(reads: DataFrame, config: PipelineConfig = PipelineConfig(), model: ErrorModel | None = None) -> DataFrame:
    """(seq, abundance) over all samples: filter, learn, denoise each sample, sum by sequence, remove
    chimeras."""
    kept = stored(filter_reads(reads, config.fwd).select("sample", "rec", "seq", "qual"), "filtered")  # read to learn from and to denoise
    asvs = stored(_DENOISERS[config.pool](dereplicate(kept), model or _learn(kept, config), config.denoise), "variants")
    if config.chimeras_first:
        rows = asvs.select(F.lit(1).alias("all"), F.concat("sample", F.lit("/"), "seq").alias("id"), "seq", "abundance")
        return remove_chimeras(rows, "all").groupBy("seq").agg(F.sum("abundance").alias("abundance"))
    return remove_chimeras(asvs.groupBy("seq").agg(F.sum("abundance").alias("abundance")).withColumn("all", F.lit(1)), "all").select("seq", "abundance")


def merged_variants(fwd: DataFrame, rev: DataFrame, config: PipelineConfig, model: ErrorModel | None = None) -> DataFrame:
    """(sample, seq, abundance) of mates: filter, learn (from the forward reads for both, or from each),
    denoise, merge."""
    pairs = stored(filter_pairs(fwd, rev, config.fwd, config.rev), "filtered")
    side = lambda s: pairs.select("sample", "rec", F.col(f"{s}_seq").alias("seq"), F.col(f"{s}_qual").alias("qual"))
    model = model or _learn(side("fwd"), config)
    other = _learn(side("rev"), config) if config.separate_errors else model
    run = _DENOISERS[config.pool]
    merged = merge_pairs(run(dereplicate(side("fwd")), model, config.denoise), run(dereplicate(side("rev")), other, config.denoise), config.merge)
    return stored(merged.groupBy("sample", "seq").agg(F.sum("abundance").alias("abundance")), "variants")


def samples(fwd: DataFrame, rev: DataFrame | None = None, config: PipelineConfig = PipelineConfig(), model: ErrorModel | None = None) -> DataFrame:
    """(sample, seq, abundance): variants of each sample without its chimeras."""
    if rev is None:
        kept = stored(filter_reads(fwd, config.fwd).select("sample", "rec", "seq", "qual"), "filtered")
        return remove_chimeras(stored(_DENOISERS[config.pool](dereplicate(kept), model or _learn(kept, config), config.denoise), "variants"))
    return remove_chimeras(merged_variants(fwd, rev, config, model))


def bench_pipeline(fwd: DataFrame, rev: DataFrame, config: PipelineConfig = BENCH) -> DataFrame:
    """(seq, abundance) over all samples, chimeras judged by the totals."""
    totals = merged_variants(fwd, rev, config).groupBy("seq").agg(F.sum("abundance").alias("abundance"))
    return remove_chimeras(totals.withColumn("all", F.lit(1)), "all").select("seq", "abundance")


def run_pipeline(spark: SparkSession, paths: list[str], output_dir: str | None = None, trunc_len: int = 0, max_ee: float = 2.0, omega_a: float = 1e-40) -> dict[str, int]:
    """{hex of the sequence: abundance} of FASTQ files; with output_dir the filtered reads are written."""
    config = PipelineConfig(fwd=FilterConfig(trunc_len=trunc_len, max_ee=max_ee), denoise=DenoiseConfig(omega_a=omega_a))
    reads = read_fastq(spark, paths, _names(paths))
    if output_dir:
        write_fastq(filter_reads(reads, config.fwd), os.path.join(output_dir, "filtered"))
    return {r["k"]: r["abundance"] for r in single(reads, config).select(hex_key(F.col("seq")).alias("k"), "abundance").collect()}


def run_pipeline_samples(spark: SparkSession, fwd_paths: list[str], rev_paths: list[str] | None = None, config: PipelineConfig = PipelineConfig()) -> dict[str, dict[str, int]]:
    """{sample: {hex: abundance}}; a sample's name is its file's stem and number."""
    if rev_paths is not None and len(rev_paths) != len(fwd_paths):
        raise ValueError("as many reverse as forward files are needed")
    names = _names(fwd_paths)
    fwd = read_fastq(spark, fwd_paths, names)
    rev = read_fastq(spark, rev_paths, names, mate=2) if rev_paths else None
    out: dict[str, dict[str, int]] = {n: {} for n in names}
    for r in samples(fwd, rev, config).select("sample", hex_key(F.col("seq")).alias("k"), "abundance").collect():
        out[r["sample"]][r["k"]] = r["abundance"]
    return out


def _names(paths: list[str]) -> list[str]:
    return [f"{stem(p)}_{i}" for i, p in enumerate(paths)]
