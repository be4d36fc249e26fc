"""Files in and out, streams, pipelines."""

import gzip
import json

import numpy as np
import pytest

from tidepool.operators import dereplicate, errors
from tidepool.operators.denoise import DenoiseConfig
from tidepool.operators.error_fit import ErrorConfig
from tidepool.operators.filtering import FilterConfig
from tidepool.plans import pipelines
from tidepool.sources import fasta, fastq


def write(path, records, packed=False):
    text = "".join(f"@{i} more\n{s}\n+\n{q}\n" for i, s, q in records)
    (gzip.open(path, "wt") if packed else open(path, "w")).write(text)
    return str(path)


def test_fastq_by_content_not_name(spark, tmp_path):
    a = write(tmp_path / "a.fastq.gz", [("x", "ACGT", "@III"), ("y", "AC", "II")])  # plain, in spite of its name
    with gzip.open(tmp_path / "b.fastq", "wt") as f:
        f.write("@z\nGG\n+\n!!\n")
    rows = fastq.read_fastq(spark, [a, str(tmp_path / "b.fastq")]).collect()
    assert sorted((r["sample"], r["rec"], r["id"], r["seq"], r["qual"]) for r in rows) == [("a", 0, "x", "ACGT", "@III"), ("a", 1, "y", "AC", "II"), ("b", 0, "z", "GG", "!!")]
    assert fastq.read_fastq(spark, str(tmp_path), n=1).count() == 2


def test_fastq_errors(spark, tmp_path):
    (tmp_path / "bad.fastq").write_text("@x\nACGT\n+\nII\n")
    with pytest.raises(Exception, match="4 bases and 2 qualities"):
        fastq.read_fastq(spark, str(tmp_path / "bad.fastq")).collect()
    assert fastq.per_file(100, 8, 20) == 20 and fastq.per_file(100, 0, 5) == 100


def test_fastq_round_trip(spark, tmp_path):
    src = write(tmp_path / "s.fastq", [(f"r{i}", "ACGT" * 3, "I" * 12) for i in range(7)])
    fastq.write_fastq(fastq.read_fastq(spark, src), str(tmp_path / "out"))
    parts = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*")))
    assert parts.count("@r") == 7 and parts.startswith("@r0\nACGT")


def test_fasta_and_lineages(spark, tmp_path):
    (tmp_path / "r.fasta").write_text(">a K;P; C \nACG\nTTT\n>K2;P2\nGG\n")
    refs = fasta.read_fasta(spark, str(tmp_path / "r.fasta"))
    assert [(r["ref_idx"], r["id"], r["description"], r["seq"]) for r in refs.orderBy("ref_idx").collect()] == [(0, "a", "K;P; C ", "ACGTTT"), (1, "K2;P2", None, "GG")]
    assert {r["id"]: r["lineage"] for r in fasta.lineage_from_headers(refs).collect()} == {"a": ["K", "P", "C"], "K2;P2": ["K2", "P2"]}
    assert {r["id"] for r in fasta.lineage_from_headers(refs, id_fallback=False).collect()} == {"a"}
    (tmp_path / "l.tsv").write_text("a\tk;p\n\nb\tx; y\na\tk2;p2\n")
    assert {r["id"]: r["lineage"] for r in fasta.read_lineage_tsv(spark, str(tmp_path / "l.tsv")).collect()} == {"a": ["k2", "p2"], "b": ["x", "y"]}
    (tmp_path / "bad.tsv").write_text("a\tk\nnone\n")
    with pytest.raises(Exception, match="line 2"):
        fasta.read_lineage_tsv(spark, str(tmp_path / "bad.tsv")).collect()


def test_tables_out(spark):
    t = spark.createDataFrame([("x", "AC", 1), ("y", "GG", 5)], "sample string, seq string, cnt long")
    assert [r["value"] for r in fasta.table_tsv(t).orderBy("place").collect()] == ["sample\t4747\t4143", "x\t0\t1", "y\t5\t0"]
    assert json.loads(fasta.table_json(t).first()[0]) == {"samples": ["x", "y"], "sequences": ["4747", "4143"], "counts": [[0, 1], [5, 0]]}
    u = dereplicate.ranked(t.groupBy("seq").agg({"cnt": "sum"}).toDF("seq", "cnt"), by=None)
    assert [r["value"] for r in fasta.uniques_fasta(u, 1).orderBy("rank").collect()] == [">seq1;size=5;\nG\nG", ">seq2;size=1;\nA\nC"]


def simulated(rng, n=400, size=80, k=4):
    truth = ["".join(rng.choice(list("ACGT"), size)) for _ in range(k)]
    out = []
    for i in range(n):
        s, scores = list(truth[i % k if i % 3 else 0]), rng.integers(28, 41, size)
        for j in np.flatnonzero(rng.random(size) < 10 ** (-scores / 10)):
            s[j] = "ACGT"[rng.integers(4)]
        out.append((f"r{i}", "".join(s), "".join(chr(33 + x) for x in scores)))
    return truth, out


def test_pipeline_finds_the_truth(spark, tmp_path):
    truth, rows = simulated(np.random.default_rng(7))
    paths = [write(tmp_path / f"s{i}.fastq", rows[i::2], packed=i == 1) for i in range(2)]
    got = pipelines.run_pipeline(spark, paths, str(tmp_path / "out"), omega_a=1e-10)
    assert {bytes.fromhex(h).decode() for h in got} == set(truth)
    per = pipelines.run_pipeline_samples(spark, paths, config=pipelines.PipelineConfig(denoise=DenoiseConfig(omega_a=1e-10), pool="pseudo"))
    assert set(per) == {"s0_0", "s1_1"} and {bytes.fromhex(h).decode() for v in per.values() for h in v} == set(truth)


def test_errors_are_learned_from_whole_samples(spark):
    """Records numbered with gaps, as filtered reads are: a sample within the limit is used whole."""
    rows = [(s, i * 8 + 1000, "ACGTACGTAC", "I" * 10) for s, n in (("a", 30), ("b", 50)) for i in range(n)]
    reads = spark.createDataFrame(rows, "sample string, rec bigint, seq string, qual string")
    used = lambda n: pipelines._learn(reads, pipelines.PipelineConfig(errors=ErrorConfig(n_reads=n, method="loess"), least_reads=5)).n_reads
    assert used(100) == 80 and used(80) == 30 + 40 and used(20) == 20
    cut = errors.first_of_each(reads, 40).groupBy("sample").agg({"rec": "max", "*": "count"}).toDF("sample", "last", "n")
    assert {tuple(sorted(r.asDict().items())) for r in cut.collect()} == {(("last", 1000 + 8 * 29), ("n", 30), ("sample", "a")), (("last", 1000 + 8 * 39), ("n", 40), ("sample", "b"))}


def test_paired_pipeline(spark, tmp_path):
    truth, rows = simulated(np.random.default_rng(8))
    turn = str.maketrans("ACGT", "TGCA")
    f = write(tmp_path / "a_R1.fastq", [(i, s[:50], q[:50]) for i, s, q in rows])
    r = write(tmp_path / "a_R2.fastq", [(i, s[30:].translate(turn)[::-1], q[30:][::-1]) for i, s, q in rows])
    got = pipelines.run_pipeline_samples(spark, [f], [r], pipelines.PipelineConfig(denoise=DenoiseConfig(omega_a=1e-10)))
    assert {bytes.fromhex(h).decode() for h in got["a_R1_0"]} == set(truth)


def test_stream(spark, tmp_path):
    from tidepool.streaming import ingest

    (tmp_path / "in").mkdir()
    write(tmp_path / "in" / "s.fastq", [("a", "ACGT" * 6, "I" * 24)] * 3 + [("b", "ACGT", "IIII")])
    q = ingest.start(ingest.running_uniques(ingest.read_stream(spark, str(tmp_path / "in")), FilterConfig()), "uniques_so_far", str(tmp_path / "cp"))
    q.processAllAvailable()
    q.stop()
    assert [(r["sample"], r["seq"], r["cnt"]) for r in spark.table("uniques_so_far").collect()] == [("s", "ACGT" * 6, 3)]
