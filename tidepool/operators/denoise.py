"""Denoising: which distinct sequences are real, and which are read errors of those.

The choice within a sample is sequential: sequences are tried in order of their numbers, and one becomes a
centre when it is too common to be made of errors of the best centre so far. That part is a numpy kernel
over one sample's distinct sequences; samples are the unit of parallelism.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.operators.dereplicate import pooled
from tidepool.operators.error_fit import ErrorModel
from tidepool.operators.quality import MAX_QUAL
from tidepool.tables import stored

OUT = "sample string, seq string, centre string, cnt bigint"
_CODE = np.zeros(256, np.int64)
for _i, _b in enumerate("CGT", 1):
    _CODE[ord(_b)] = _CODE[ord(_b.lower())] = _i


@dataclass(frozen=True)
class DenoiseConfig:
    """subtract: take the upper tail of the Poisson test as 1 minus a sum, which can't tell tails below
    1e-16 apart, in place of the tail itself."""

    omega_a: float = 1e-40
    max_iter: int = 16
    tol: float = 1e-6
    gap_log_p: float = math.log(1e-3)
    subtract: bool = False


def log_factorial(n: int) -> float:
    """Exact up to 20, by Stirling's formula above."""
    if n <= 20:
        return math.log(math.factorial(n))
    return n * math.log(n) - n + 0.5 * math.log(2 * math.pi * n)


def log_upper_tail(count: int, log_lambda: float) -> float:
    """Log of P(X >= count) for a Poisson variable."""
    lam = math.exp(log_lambda)
    if count > lam:  # the terms fall from the first on
        total = term = 1.0
        k = count
        while term > 1e-17 * total:
            k += 1
            term *= lam / k
            total += term
        return count * log_lambda - lam - math.lgamma(count + 1) + math.log(total)
    below = sum(math.exp(k * log_lambda - lam - math.lgamma(k + 1)) for k in range(count))
    return math.log(max(1 - below, 1e-300))


def significant(count: int, log_lambda: float, config: DenoiseConfig) -> bool:
    """Whether so many copies are too many for errors that are expected exp(log_lambda) times."""
    if count == 0:
        return False
    if log_lambda < math.log(1e-14):
        log_p = count * log_lambda - log_factorial(count)
    elif config.subtract:
        lam = math.exp(log_lambda)
        return 1 - sum(math.exp(k * log_lambda - lam - math.lgamma(k + 1)) for k in range(count)) < config.omega_a
    else:
        log_p = log_upper_tail(count, log_lambda)
    return log_p < math.log(config.omega_a)


class Sample:
    """One sample's distinct sequences, in order, against a growing list of centres. Each sequence's best
    centre is kept up to date as centres come, so none is scored against a centre twice."""

    def __init__(self, seqs: list[str], counts: np.ndarray, qual_sums: list, log_matrix: np.ndarray):
        self.seqs, self.counts = seqs, counts
        self.size = np.array([len(s) for s in seqs])
        n, width = len(seqs), int(self.size.max(initial=0))
        self.code = np.zeros((n, width), np.int16)  # 4 bytes a letter in all: the sequences of a sample are held at once
        self.cell = np.full((n, width), 16 * MAX_QUAL, np.int16)  # the last entry of the table: 0
        for i, s in enumerate(seqs):
            code = _CODE[np.frombuffer(s.encode("latin-1", "replace"), np.uint8)]
            q = np.zeros(len(s))
            sums = np.asarray(qual_sums[i] if qual_sums[i] is not None else [], float)[: len(s)]
            q[: len(sums)] = sums / counts[i]
            self.code[i, : len(s)] = code
            self.cell[i, : len(s)] = code * MAX_QUAL + np.minimum(q.astype(np.int64), MAX_QUAL - 1)
        # Entry (t * 4 + o) * 41 + q, and a block of zeros for places beyond a sequence's end.
        self.table = np.concatenate([log_matrix.astype(np.float32).reshape(-1), np.zeros(16 * MAX_QUAL, np.float32)])
        self.centres: list[int] = []
        self.best = np.zeros(n, np.int64)
        self.score = np.full(n, -np.inf)

    def entries(self, rows, shifted: np.ndarray) -> np.ndarray:
        """Log probabilities of the rows' letters if the true letters are `shifted`."""
        return self.table[self.cell[rows] + shifted * (4 * MAX_QUAL)].astype(np.float64)

    def promote(self, u: int) -> None:
        k = self.size[u]
        score = self.table[self.cell[:, :k] + self.code[u, :k] * (4 * MAX_QUAL)].sum(axis=1, dtype=np.float64)
        better = score >= self.score  # of equals the later centre
        self.best[better] = len(self.centres)
        self.score[better] = score[better]
        self.centres.append(u)

    def gap_score(self, u: int, gap_log_p: float) -> float:
        """The best score with one letter put in or left out at any place."""
        c = self.centres[self.best[u]]
        n = int(min(self.size[u], self.size[c]))
        if n < 2:
            return -math.inf
        true = self.code[c, :n]
        same = np.concatenate([[0.0], np.cumsum(self.entries(u, np.pad(true, (0, self.code.shape[1] - n)))[:n])])
        row = lambda t: self.table[self.cell[u, : len(t)] + t * (4 * MAX_QUAL)].astype(np.float64)
        inserted = np.zeros(n + 1)  # from p + 1 on, letter i stands against i - 1
        put = self.table[self.cell[u, 1:n] + true[:-1] * (4 * MAX_QUAL)].astype(np.float64)
        inserted[1:n] = np.cumsum(put[::-1])[::-1]
        deleted = np.zeros(n + 1)  # from p on, letter i stands against i + 1
        deleted[: n - 1] = np.cumsum(row(true[1:])[::-1])[::-1]
        return float((same[:n] + gap_log_p + np.maximum(inserted[1:], deleted[:n])).max())

    def run(self, priors: set[str], config: DenoiseConfig) -> np.ndarray:
        """The sequence number of each sequence's centre."""
        log_total = math.log(float(self.counts.sum()))
        self.promote(0)
        is_centre = np.zeros(len(self.seqs), bool)
        is_centre[0] = True
        assigned = np.zeros(len(self.seqs), np.int64)
        before = -math.inf
        for i in range(config.max_iter):
            had = len(self.centres)
            for u, s in enumerate(self.seqs):
                if is_centre[u]:
                    continue
                chosen = s in priors
                # A gap can only raise the expectation, so it matters only to what is significant without.
                if not chosen and significant(int(self.counts[u]), log_total + self.score[u], config):
                    gap = self.gap_score(u, config.gap_log_p)
                    chosen = gap <= self.score[u] or significant(int(self.counts[u]), log_total + gap, config)
                if chosen:
                    is_centre[u] = True
                    self.promote(u)
            value = float((self.score * self.counts).sum())
            stable = bool((self.best == assigned).all())
            assigned = self.best.copy()
            if (i > 0 and len(self.centres) == had and stable) or abs(value - before) < config.tol:
                break
            before = value
        return np.array(self.centres)[assigned]


def cluster(uniques: DataFrame, model: ErrorModel, config: DenoiseConfig = DenoiseConfig(), priors: DataFrame | None = None) -> DataFrame:
    """(sample, seq, centre, cnt): the centre of every distinct sequence of uniques(sample, seq, cnt,
    qual_sum). priors(seq) are centres wherever they occur; they are joined, not broadcast. A sample
    without sequences gives no rows."""
    log_matrix = model.log_matrix
    flagged = uniques.select("sample", "seq", "cnt", "qual_sum")
    known = F.lit(False)
    if priors is not None:
        flagged = flagged.join(priors.select("seq").distinct().withColumn("_prior", F.lit(True)), "seq", "left")
        known = F.coalesce("_prior", F.lit(False))
    flagged = flagged.select("sample", "seq", "cnt", "qual_sum", known.alias("prior"))

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["cnt", "seq"], ascending=[False, True], kind="stable").reset_index(drop=True)
        s = Sample(pdf["seq"].tolist(), pdf["cnt"].to_numpy(np.int64), pdf["qual_sum"].tolist(), log_matrix)
        centre = s.run(set(pdf["seq"][pdf["prior"].astype(bool)]), config)
        return pd.DataFrame({"sample": pdf["sample"], "seq": pdf["seq"], "centre": pdf["seq"].to_numpy()[centre], "cnt": pdf["cnt"]})

    return flagged.groupBy("sample").applyInPandas(kernel, OUT)


def variants(clusters: DataFrame) -> DataFrame:
    """asvs(sample, seq, abundance): the reads of each centre. Centres that ended without any are gone."""
    return clusters.groupBy("sample", F.col("centre").alias("seq")).agg(F.sum("cnt").alias("abundance"))


def denoise(uniques: DataFrame, model: ErrorModel, config: DenoiseConfig = DenoiseConfig(), priors: DataFrame | None = None) -> DataFrame:
    return variants(cluster(uniques, model, config, priors))


def denoise_pseudo(uniques: DataFrame, model: ErrorModel, config: DenoiseConfig = DenoiseConfig()) -> DataFrame:
    """Two passes: what any sample finds is a prior for all of them in the second."""
    own = stored(uniques.select("sample", "seq", "cnt", "qual_sum"), "uniques")  # read by both passes
    return denoise(own, model, config, denoise(own, model, config).select("seq").distinct())


def denoise_pooled(uniques: DataFrame, model: ErrorModel, config: DenoiseConfig = DenoiseConfig(), double_first: bool = False) -> DataFrame:
    """All samples as one, and each variant's reads dealt out again in proportion to the samples' copies of
    its centre; shares are rounded and those of 0 left out. The pool is one group by its nature: prefer
    denoise_pseudo for many samples."""
    pool = pooled(uniques, double_first)
    whole = denoise(pool.select(F.lit("all").alias("sample"), "seq", "cnt", "qual_sum"), model, config).drop("sample")
    shares = pool.select("seq", F.col("cnt").alias("total"), F.explode("per_sample").alias("x"))
    share = F.round(F.col("abundance") * F.col("x.cnt") / F.col("total")).cast("bigint")
    return whole.join(shares, "seq").select(F.col("x.sample").alias("sample"), "seq", share.alias("abundance")).where("abundance > 0")
