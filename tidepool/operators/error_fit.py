"""Error models from counts: small dense arithmetic on the driver.

A model is a 16 x 41 matrix; row 4 * t + o, column q: the probability that base t is read as o at score q.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tidepool.functions.kernels import codes
from tidepool.operators.errors import _BASE, first_reads, transition_counts
from tidepool.operators.quality import MAX_QUAL, detect_platform

Q = np.arange(MAX_QUAL)
PRIOR = 10.0 ** (-Q / 10)
#: Bounds of a rate that is pooled over directions.
LEAST_RATE, GREATEST_RATE = 1e-7, 0.25
SELF = [5 * b for b in range(4)]


@dataclass(frozen=True)
class ErrorConfig:
    n_reads: int = 1_000_000
    max_iter: int = 16
    tol: float = 1e-6
    method: str = "auto"  # auto, loess, binned, pacbio or logistic
    span: float = 0.95
    max_dist: int = 8
    guard: bool = True  # raise match rates to those of higher scores


@dataclass(frozen=True)
class ErrorModel:
    matrix: np.ndarray
    n_reads: int = 0
    kind: str = ""

    @property
    def log_matrix(self) -> np.ndarray:
        return np.log(np.maximum(self.matrix, 1e-300))

    def p_error(self, true: int, seen: int, q: int) -> float:
        return float(self.matrix[4 * true + seen, min(q, MAX_QUAL - 1)])

    def log_likelihood(self, true: str, seen: str, scores: list[int]) -> float:
        """Of a read given its template, over the shortest of the three."""
        rows = [(base(t), base(s), min(q, MAX_QUAL - 1)) for t, s, q in zip(true, seen, scores)]
        return float(sum(self.log_matrix[4 * t + s, q] for t, s, q in rows))

    def error_rates(self) -> np.ndarray:
        """Mean of the twelve mismatch rates at each score."""
        return self.matrix[[r for r in range(16) if r not in SELF]].mean(axis=0)

    def flat(self) -> list[float]:
        return self.matrix.reshape(-1).tolist()

    def dumps(self) -> str:
        return json.dumps({"matrix": self.matrix.tolist(), "n_reads": self.n_reads, "kind": self.kind})

    @classmethod
    def loads(cls, text: str) -> ErrorModel:
        d = json.loads(text)
        return cls(np.array(d["matrix"]), d["n_reads"], d["kind"])

    def table(self, spark: SparkSession) -> DataFrame:
        """(t, o, q, p), 656 rows."""
        return spark.createDataFrame([(r // 4, r % 4, q, float(self.matrix[r, q])) for r in range(16) for q in range(MAX_QUAL)], "t int, o int, q int, p double")


def base(letter: str) -> int:
    return max(0, "ACGT".find(letter.upper()))


def _square(p_error: np.ndarray) -> np.ndarray:
    """A model whose three mismatches are equally likely."""
    out = np.repeat((p_error / 3)[None], 16, axis=0)
    out[SELF] = 1 - p_error
    return out


def illumina() -> np.ndarray:
    return _square(PRIOR)


def pacbio() -> np.ndarray:
    return _square(np.clip(PRIOR, 1e-6, 0.5))


def guarded(rates: np.ndarray) -> np.ndarray:
    """Each rate raised to the greatest of those at higher scores."""
    return np.maximum.accumulate(rates[::-1])[::-1]


def lowess(y: np.ndarray, w: np.ndarray, span: float) -> np.ndarray:
    """Weighted local lines: at each score a line through the nearest span * 41 scores, by tricube weights
    of their distance times w. Without weight there the value itself stays."""
    n = len(y)
    k = min(max(int(np.floor(span * n + 0.5)), 3), n)
    x = np.arange(n)
    high = np.minimum(np.maximum(x - k // 2, 0) + k, n)
    low = np.maximum(high - k, 0)
    reach = np.maximum(np.maximum(x - low, high - 1 - x), 1)
    d = np.abs(x[None] - x[:, None]) / reach[:, None]
    inside = (x[None] >= low[:, None]) & (x[None] < high[:, None]) & (d < 1)
    kernel = np.where(inside, (1 - np.minimum(d, 1) ** 3) ** 3, 0) * w[None]
    s = kernel.sum(axis=1)
    safe = np.where(s > 0, s, 1)
    mean_x, mean_y = kernel @ x / safe, kernel @ y / safe
    var = kernel @ (x * x) / safe - mean_x**2
    cov = kernel @ (x * y) / safe - mean_x * mean_y
    slope = np.where(np.abs(var) < 1e-12, 0, cov / np.where(np.abs(var) < 1e-12, 1, var))
    return np.where(s > 0, mean_y + slope * (x - mean_x), y)


def fit_loess(counts: np.ndarray, span: float = 0.95, guard: bool = True) -> np.ndarray:
    out = np.zeros((16, MAX_QUAL))
    for t in range(4):
        total = counts[4 * t : 4 * t + 4].sum(axis=0)
        for o in range(4):
            r = 4 * t + o
            y = np.divide(counts[r], total, out=np.zeros(MAX_QUAL), where=total > 0)
            fitted = np.clip(lowess(y, total, span), 1e-12, 1)
            prior = 1 - PRIOR if t == o else PRIOR / 3
            out[r] = np.where(total > 0, fitted, prior)
        if guard:
            out[5 * t] = guarded(out[5 * t])
        sums = out[4 * t : 4 * t + 4].sum(axis=0)
        out[4 * t : 4 * t + 4] /= np.where(sums > 0, sums, 1)
    return out


def pooled_rates(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(scores with data, mismatch rate of one direction there)."""
    total = counts.sum(axis=0)
    bins = np.flatnonzero(total > 0)
    off = total - counts[SELF].sum(axis=0)
    return bins, np.clip(off[bins] / total[bins] / 3, LEAST_RATE, GREATEST_RATE)


def fit_binned(counts: np.ndarray, guard: bool = True) -> np.ndarray:
    bins, rates = pooled_rates(counts)
    rate = np.clip(np.interp(Q, bins, rates) if len(bins) else PRIOR / 3, LEAST_RATE, GREATEST_RATE)
    match = np.maximum(1 - 3 * rate, 1 - 3 * GREATEST_RATE)
    out = np.repeat(rate[None], 16, axis=0)
    out[SELF] = guarded(match) if guard else match
    return out


def fit_logistic(counts: np.ndarray, max_iter: int = 16, tol: float = 1e-6) -> np.ndarray:
    """Rows of sigmoid(a + b q), climbing the sum of count * log p; it has no term for the other outcome,
    so it is kept for comparison only."""
    out = np.zeros((16, MAX_QUAL))
    sigmoid = lambda x: 1 / (1 + np.exp(-np.clip(x, -700, 700)))
    for r in range(16):
        a, b = (5.0, -0.3) if r in SELF else (-5.0, 0.1)
        before = -np.inf
        for _ in range(max_iter if counts[r].sum() else 0):
            p = sigmoid(a + b * Q)
            value = float(counts[r] @ np.log(np.maximum(p, 1e-300)))
            rest = counts[r] * (1 - p)
            a, b = a + 1e-3 * rest.sum(), b + 1e-3 * float(rest @ Q)
            if not (np.isfinite(a) and np.isfinite(b)):
                raise ArithmeticError("the logistic fit diverges")
            if abs(value - before) < tol:
                break
            before = value
        out[r] = sigmoid(a + b * Q)
    return out


def fit(counts: np.ndarray, kind: str, config: ErrorConfig = ErrorConfig()) -> np.ndarray:
    if kind == "pacbio":
        return pacbio()
    if kind == "binned":
        return fit_binned(counts, config.guard)
    if kind == "logistic":
        return fit_logistic(counts, config.max_iter, config.tol)
    if kind == "loess":
        return fit_loess(counts, config.span, config.guard)
    raise ValueError(f"no such error function: {kind}")


def count_matrix(counts: DataFrame) -> np.ndarray:
    """A 16 x 41 matrix of transition_counts' rows (t, o, q, n)."""
    out = np.zeros((16, MAX_QUAL))
    for r in counts.collect():  # 656 rows at most
        out[4 * r["t"] + r["o"], r["q"]] += r["n"]
    return out


# Other names of the error functions.
ALIASES = {"loessErrfun": "loess", "makeBinnedQualErrfun": "binned", "binnedQualErrfun": "binned", "PacBioErrfun": "pacbio"}


def learn_errors(reads: DataFrame, config: ErrorConfig = ErrorConfig()) -> ErrorModel:
    """Learn from the first n_reads reads. `auto` chooses by the qualities; `pacbio` needs no counts."""
    some = first_reads(reads, config.n_reads).select("sample", "rec", "seq", "qual").persist()  # read for each kind of count
    n = some.count()
    if n == 0:
        raise ValueError("no reads to learn errors from")
    kind = ALIASES.get(config.method, config.method)
    if kind == "auto":
        kind = detect_platform(some).first()["kind"]
    counts = np.zeros((16, MAX_QUAL)) if kind == "pacbio" else count_matrix(transition_counts(some, config.max_dist))
    some.unpersist()
    return ErrorModel(fit(counts, kind, config), n, kind)


def rates_table(model: DataFrame) -> DataFrame:
    """(q, rate): mean mismatch probability at each score of a model's table."""
    return model.where("t <> o").groupBy("q").agg(F.avg("p").alias("rate"))


#: Bases that a read is taken to have, and the bounds of the number of reads that bases are turned into.
READ_BASES, LEAST_READS, MOST_READS = 150, 10_000, 10_000_000


def reads_of_bases(n_bases: float) -> int:
    return int(min(max(int(n_bases / READ_BASES + 0.5), LEAST_READS), MOST_READS))


def learn_errors_from_bases(reads: DataFrame, n_bases: float = 1e8, err_fun: str = "auto") -> ErrorModel:
    """learn_errors for a number of bases; a function that isn't known is an error, but where learning fails
    the model is the scores' own."""
    kind = ALIASES.get(err_fun, err_fun)
    if kind not in ("auto", "loess", "binned", "pacbio", "logistic"):
        raise ValueError(f"no such error function: {err_fun}")
    try:
        return learn_errors(reads, ErrorConfig(n_reads=reads_of_bases(n_bases), method=kind))
    except (ValueError, ArithmeticError):
        return ErrorModel(illumina(), 0, "illumina")


def likelihoods(pairs: DataFrame, model: ErrorModel) -> DataFrame:
    """pairs(true, seen, qual, ...) with `log_p`, the log probability of the read given its template, over
    the shortest of the three."""
    log_matrix, kind = model.log_matrix, StructType([*pairs.schema.fields, StructField("log_p", DoubleType())])

    def run(batches):
        for batch in batches:
            (t, n_t), (s, n_s), (q, n_q) = (codes(batch.column(c)) for c in ("true", "seen", "qual"))
            n = np.minimum(np.minimum(n_t, n_s), n_q)
            row = np.repeat(np.arange(len(n)), n)
            place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            letter = lambda x, m: x[np.repeat(np.cumsum(m) - m, n) + place].astype(np.int64)
            cell = _BASE[np.minimum(letter(t, n_t), 255)] * 4 + _BASE[np.minimum(letter(s, n_s), 255)]
            logs = log_matrix[cell, np.clip(letter(q, n_q) - 33, 0, MAX_QUAL - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.bincount(row, logs, len(n)))], kind.names)

    return pairs.mapInArrow(run, kind)
