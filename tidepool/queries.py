"""One query for each operator, over the driver's tables. tidepool.sql has their SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.functions import sequences as S
from tidepool.operators import chimera, denoise, dereplicate, error_fit, errors, filtering, merge, primers, quality, seqtable, species, taxonomy
from tidepool.plans import pipelines, reads
from tidepool.sources import fasta, fastq
from tidepool.tables import new_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

FILTER = filtering.FilterConfig(trunc_q=2, min_len=20, max_ee=8.0)
TRIM = filtering.FilterConfig(trunc_q=2, trim_left=5, trim_right=3, trunc_len=40, min_len=20, max_ee=0.2)
PAIRS = (filtering.FilterConfig(max_ee=2.0), filtering.FilterConfig(max_ee=2.2))
PRIMERS = primers.PrimerConfig(fwd="TTAC", rev="GTA", max_mismatches=1, min_overlap=3)
OVERLAP = merge.MergeConfig(min_overlap=15, max_mismatches=1)


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _rounded(df: DataFrame, digits: int, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


@query
def derep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dereplicate.counts(reads.reads(spark, sf_dir))


@query
def derep_qual_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = dereplicate.dereplicate(reads.amplicons(spark, sf_dir))
    return u.select("sample", "seq", "cnt", F.posexplode("qual_sum").alias("at", "s")).select("sample", "seq", F.col("at").cast("long").alias("at"), F.col("s").cast("long").alias("qual_sum"), "cnt")


@query
def quality_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(quality.quality_profile(reads.reads(spark, sf_dir)), 6, "mean")


@query
def platform_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = lambda name, offset, levels: quality.detect_platform(reads.reads(spark, sf_dir, offset, levels)).select(F.lit(name).alias("profile"), "distinct_q", "mean_q", "max_q", "mean_len", "kind")
    return _rounded(one("full", 0, 41).union(one("binned", 20, 10)).union(one("fine", 36, 5)), 6, "mean_q", "mean_len")


@query
def filter_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(filtering.filter_reads(reads.reads(spark, sf_dir), FILTER).select("sample", "rec", "seq", "ee"), 6, "ee")


@query
def filter_trimmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(filtering.filter_reads(reads.reads(spark, sf_dir, 20, 21), TRIM).select("sample", "rec", "seq", "ee"), 6, "ee")


@query
def filter_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filtering.filter_stats(reads.reads(spark, sf_dir), FILTER)


@query
def filter_paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filtering.filter_pairs(*reads.mates(spark, sf_dir), *PAIRS).select("sample", "rec", "fwd_seq", "rev_seq")


@query
def filter_paired_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filtering.pair_stats(*reads.mates(spark, sf_dir), *PAIRS)


@query
def primer_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return primers.trim_primers(reads.reads(spark, sf_dir), PRIMERS).select("sample", "rec", "seq")


@query
def reverse_complement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.pieces(spark, sf_dir, reads.READ).select("rec", S.reverse_complement(F.col("raw")).alias("rc"))


@query
def sequence_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = reads.reads(spark, sf_dir).withColumns({"back": F.reverse("seq"), "q": S.phred(F.col("qual"))})
    seq, back, q = F.col("seq"), F.col("back"), F.col("q")
    out = r.select(
        "rec", S.hamming(seq, back).alias("hamming"), S.first_mismatch(seq, back).cast("int").alias("first_mismatch"), S.range_equal(seq, back, F.lit(5), F.lit(15)).alias("range_equal"),
        S.mean_quality(q).alias("mean_quality"), S.has_low_quality_window(q, 15.0, 10).alias("low_window"), S.base_index(F.substring("seq", 1, 1)).cast("long").alias("base_index"), S.hex_key(seq).alias("asv"),
    )
    return _rounded(out, 6, "mean_quality")


@query
def kmer_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reads.reads(spark, sf_dir).select(F.explode(S.kmers(F.col("seq"), 8)).alias("kmer")).groupBy("kmer").agg(F.count("*").alias("n"))


@query
def match_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return errors.match_counts(reads.reads(spark, sf_dir))


@query
def mismatch_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return errors.mismatch_counts(reads.amplicons(spark, sf_dir))


@query
def transition_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return errors.transition_counts(reads.amplicons(spark, sf_dir))


def _adjacent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transitions between neighbouring bases, as counts (t, o, q, n) for the fits."""
    r = reads.reads(spark, sf_dir)
    both = F.arrays_zip(S.letters(F.substring("seq", F.lit(1), F.length("seq") - 1)).alias("t"), S.letters(F.substring("seq", F.lit(2), F.length("seq") - 1)).alias("o"), S.phred(F.substring("qual", F.lit(1), F.length("qual") - 1)).alias("q"))
    x = r.select(F.explode(both).alias("x"))
    return x.groupBy(S.base_index(F.col("x.t")).alias("t"), S.base_index(F.col("x.o")).alias("o"), F.col("x.q").alias("q")).agg(F.count("*").alias("n"))


def _model(spark: SparkSession, matrix, digits: int = 6) -> DataFrame:
    return _rounded(error_fit.ErrorModel(matrix).table(spark), digits, "p")


@query
def lowess_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _model(spark, error_fit.fit_loess(error_fit.count_matrix(_adjacent(spark, sf_dir))))


@query
def binned_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every score counts for its bin: 2, 7, 12, ... 37."""
    binned = _adjacent(spark, sf_dir).withColumn("q", F.expr("least(q - q % 5 + 2, 37)")).groupBy("t", "o", "q").agg(F.sum("n").alias("n"))
    return _model(spark, error_fit.fit_binned(error_fit.count_matrix(binned)))


@query
def logistic_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _model(spark, error_fit.fit_logistic(error_fit.count_matrix(_adjacent(spark, sf_dir))))


@query
def pacbio_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _model(spark, error_fit.pacbio(), 9)


@query
def illumina_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _model(spark, error_fit.illumina(), 9)


@query
def plot_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(error_fit.rates_table(error_fit.ErrorModel(error_fit.illumina()).table(spark)), 9, "rate")


@query
def learn_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _model(spark, error_fit.learn_errors(reads.amplicons(spark, sf_dir)).matrix)


@query
def first_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return errors.first_reads(reads.amplicons(spark, sf_dir), 20_000).select("sample", "rec")


def _uniques(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dereplicate.dereplicate(reads.amplicons(spark, sf_dir))


DEFAULT = error_fit.ErrorModel(error_fit.illumina())


@query
def denoise_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    return denoise.denoise(_uniques(spark, sf_dir), DEFAULT)


@query
def denoise_many_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return denoise_many(spark, sf_dir).groupBy("sample").agg(F.sum("abundance").alias("reads"))


@query
def denoise_pseudo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return denoise.denoise_pseudo(_uniques(spark, sf_dir), DEFAULT)


@query
def denoise_pseudo_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return denoise_pseudo(spark, sf_dir).groupBy("sample").agg(F.sum("abundance").alias("reads"))


@query
def denoise_pooled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return denoise.denoise_pooled(_uniques(spark, sf_dir), DEFAULT)


@query
def pool_accumulate(spark: SparkSession, sf_dir: str) -> DataFrame:
    pool = dereplicate.pooled(_uniques(spark, sf_dir))
    per_sample = F.array_join(F.transform("per_sample", lambda x: F.concat(x["sample"], F.lit(":"), x["cnt"].cast("string"))), ",")
    return pool.select("seq", "cnt", per_sample.alias("per_sample"), F.aggregate("qual_sum", F.lit(0.0), lambda s, x: s + x).cast("long").alias("qual_total"))


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return tuple(dereplicate.counts(r).withColumnRenamed("cnt", "abundance") for r in reads.amplicon_mates(spark, sf_dir))


@query
def merge_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.merge_pairs(*_sides(spark, sf_dir), OVERLAP).select("sample", "seq", "abundance", "overlap", "mismatches")


@query
def just_concatenate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.merge_pairs(*_sides(spark, sf_dir), merge.MergeConfig(15, 1, True)).select("sample", "seq", "abundance")


def _counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dereplicate.counts(reads.amplicons(spark, sf_dir))


@query
def chimera_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chimera.remove_chimeras(_counted(spark, sf_dir).withColumnRenamed("cnt", "abundance"))


QUERIES["chimera"] = QUERIES.pop("chimera_removal")


@query
def chimera_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chimera.chimera_mask(_counted(spark, sf_dir))


@query
def taxonomy_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taxonomy.classify_best(reads.items(spark, sf_dir), reads.references(spark, sf_dir))


@query
def taxonomy_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    refs = reads.references(spark, sf_dir)
    got = taxonomy.assign_taxonomy(reads.items(spark, sf_dir).select("qid", "seq"), refs, fasta.lineage_from_headers(refs), taxonomy.TaxonomyConfig(threshold=0.5))
    return _rounded(got.select("qid", "kingdom", "phylum", "class", F.col("order").alias("order_"), "family", "genus", "confidence"), 6, "confidence")


@query
def taxonomy_try_rc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every other query comes turned; percentages, and names from half of the replicates on."""
    refs = reads.references(spark, sf_dir)
    own = reads.items(spark, sf_dir).select("qid", F.when(F.col("qid") % 2 == 0, S.reverse_complement(F.col("seq"))).otherwise(F.col("seq")).alias("seq"))
    got = taxonomy.TaxonomyDb.build(refs).assign(own, min_boot=50, try_rc=True, bootstraps=True)
    return _rounded(got.withColumnsRenamed({"order": "order_", "order_boot": "order_boot"}), 6, *(f"{x}_boot" for x in fasta.LEVELS))


def _species(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = reads.pieces(spark, sf_dir, reads.READ).where(F.length("raw") == reads.READ)
    return cut.select(F.concat_ws(" ", "lang", "sample").alias("description"), reads.bases(F.col("raw")).alias("seq"))


@query
def species_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return species.assign_species(reads.item_windows(spark, sf_dir), _species(spark, sf_dir))


@query
def species_hamming(spark: SparkSession, sf_dir: str) -> DataFrame:
    return species.assign_species(reads.item_windows(spark, sf_dir), _species(spark, sf_dir), species.SpeciesConfig(True, 2))


@query
def add_species(spark: SparkSession, sf_dir: str) -> DataFrame:
    genus = F.when(F.col("qid") % 3 == 1, "en").when(F.col("qid") % 3 == 2, "fr")
    return species.add_species(reads.item_windows(spark, sf_dir).select("qid", genus.alias("genus")), species_exact(spark, sf_dir))


@query
def sequence_table_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = seqtable.make_table(_counted(spark, sf_dir).withColumnRenamed("cnt", "abundance"))
    return t.select("sample", S.hex_key(F.col("seq")).alias("asv"), "cnt")


@query
def sequence_table_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    totals = seqtable.column_order(_counted(spark, sf_dir))
    return dereplicate.ranked(totals.withColumnRenamed("total", "cnt"), by=None).select("seq", F.col("cnt").alias("total"), F.col("rank").cast("long").alias("place"))


@query
def sequence_table_overwrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = _counted(spark, sf_dir).select("sample", F.substring("seq", 1, 30).alias("seq"), F.col("cnt").alias("abundance"), F.col("seq").alias("place"))
    return seqtable.make_table(u, overwrite=True)


@query
def merge_sequence_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = _counted(spark, sf_dir)
    other = one.select(F.concat(F.lit("x"), "sample").alias("sample"), S.reverse_complement(F.col("seq")).alias("seq"), "cnt")
    return seqtable.merge_tables([one, other], try_rc=True)


@query
def sequence_table_tsv(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _counted(spark, sf_dir).groupBy("sample", F.substring("seq", 1, 12).alias("seq")).agg(F.sum("cnt").alias("cnt"))
    return fasta.table_tsv(t)


@query
def uniques_fasta(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = _counted(spark, sf_dir).groupBy("seq").agg(F.sum("cnt").alias("cnt"))
    return fasta.uniques_fasta(dereplicate.ranked(total, by=None), 40)


@query
def fastq_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = reads.reads(spark, sf_dir)
    return r.select("rec", fastq.fastq_lines(r).alias("value"))


@query
def lineage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fasta.lineage_from_headers(reads.references(spark, sf_dir)).select("id", F.array_join("lineage", "|").alias("lineage"))


PIPELINE = pipelines.PipelineConfig(fwd=filtering.FilterConfig(max_ee=2.0), rev=filtering.FilterConfig(max_ee=2.0))


@query
def run_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipelines.single(reads.amplicons(spark, sf_dir), PIPELINE)


@query
def run_pipeline_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipelines.samples(*reads.amplicon_mates(spark, sf_dir), PIPELINE)


# Files: the tables are written to the shared folder and read back.


def _files(spark: SparkSession, sf_dir: str, compression: str) -> DataFrame:
    path = new_path(spark, "fastq")
    fastq.write_fastq(reads.reads(spark, sf_dir), path, compression)
    return fastq.read_fastq(spark, path)


@query
def fastq_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _files(spark, sf_dir, "none").select("id", "seq", "qual")


@query
def fastq_gzip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _files(spark, sf_dir, "gzip").select("id", "seq", "qual")


@query
def fastq_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "fastq")
    fastq.write_fastq(reads.reads(spark, sf_dir).coalesce(1), path)  # one file, to have a first record
    return fastq.read_fastq(spark, path, n=500).select("rec", "id", "seq")


@query
def fasta_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "fasta")
    fasta.write_fasta(dereplicate.ranked(_counted(spark, sf_dir).groupBy("seq").agg(F.sum("cnt").alias("cnt")), by=None), path, 25)
    return fasta.read_fasta(spark, path).select("id", "description", "seq")


@query
def lineage_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, own = new_path(spark, "lineages"), fasta.lineage_from_headers(reads.references(spark, sf_dir))
    own.select(fasta.lineage_lines(own).alias("value")).write.text(path)
    return fasta.read_lineage_tsv(spark, path).select("id", F.array_join("lineage", "|").alias("lineage"))


@query
def lineage_described(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without the fallback to ids, references without a description have no lineage."""
    refs = reads.references(spark, sf_dir).withColumn("description", F.when(F.col("ref_idx") % 3 > 0, F.col("description")))
    return fasta.lineage_from_headers(refs, id_fallback=False).select("id", F.array_join("lineage", "|").alias("lineage"))


@query
def sequence_table_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _counted(spark, sf_dir).groupBy("sample", F.substring("seq", 1, 12).alias("seq")).agg(F.sum("cnt").alias("cnt"))
    more = t.select("sample").union(spark.createDataFrame([("empty",)], "sample string"))
    return fasta.table_json(t, more)


@query
def sequence_table_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _counted(spark, sf_dir).where("sample <> 's3'")
    return seqtable.with_samples(t, _counted(spark, sf_dir).select("sample"))


@query
def model_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = error_fit.ErrorModel.loads(error_fit.ErrorModel(error_fit.pacbio(), 7, "pacbio").dumps())
    return spark.createDataFrame([(i, p, model.n_reads) for i, p in enumerate(model.flat())], "place long, p double, n_reads long").withColumn("p", F.round("p", 9))


@query
def read_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each read as a read of its own reverse."""
    pairs = reads.reads(spark, sf_dir).select("rec", F.reverse("seq").alias("true"), F.col("seq").alias("seen"), "qual")
    return _rounded(error_fit.likelihoods(pairs, DEFAULT), 6, "log_p").select("rec", "log_p")


@query
def learning_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    config = pipelines.PipelineConfig(errors=error_fit.ErrorConfig(n_reads=30_000), least_reads=1_000)
    kept = filtering.filter_reads(reads.amplicons(spark, sf_dir), filtering.FilterConfig(max_ee=0.08))
    return pipelines.learning_reads(kept, config).select("sample", "rec")


@query
def remove_primers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return primers.remove_primers(reads.reads(spark, sf_dir), "TTACGT", max_mismatches=2, min_overlap=4)[0].select("sample", "rec", "seq")


@query
def denoise_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return denoise.cluster(_uniques(spark, sf_dir), DEFAULT)


@query
def variant_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variants over all samples, by way of merged pairs under their stepwise names."""
    return seqtable.get_uniques(merge.merger_table(merge.merge_pairs(*_sides(spark, sf_dir), OVERLAP))).groupBy("seq").agg(F.sum("cnt").alias("cnt"))


@query
def bench_pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    short = filtering.FilterConfig(trunc_len=36, max_ee=2.0)
    config = replace(pipelines.BENCH, fwd=short, rev=replace(short, max_ee=3.0))
    return pipelines.bench_pipeline(*reads.amplicon_mates(spark, sf_dir), config)
