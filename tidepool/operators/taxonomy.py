"""Taxonomy by shared k-mers, with bootstrap confidence."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tidepool.functions.kernels import codes
from tidepool.functions.sequences import hex_key, reverse_complement
from tidepool.sources.fasta import LEVELS, lineage_from_headers

REPLICATES, SHIFTS = 100, 8
#: The two bits of a base, by its letter's code; 4 is no base.
_CODE = np.full(256, 4, np.int64)
for _i, _b in enumerate("ACGT"):
    _CODE[ord(_b)] = _CODE[ord(_b.lower())] = _i
# The multiplier and increment of the generator whose states choose the replicates' k-mers.
MULTIPLIER, INCREMENT = 6364136223846793005, 1442695040888963407


@dataclass(frozen=True)
class TaxonomyConfig:
    k: int = 8
    threshold: float = 0.8
    seed: int = 42
    try_rc: bool = False


def states(seed: int) -> list[int]:
    """The generator's first states; it starts anew for every query, so they are constants."""
    out = []
    for _ in range(REPLICATES):
        seed = (seed * MULTIPLIER + INCREMENT) % (1 << 64)
        out.append(seed)
    return out


#: Queries that one scan of the references takes along, letters of references that are compared at a time.
QUERIES, _LETTERS = 2048, 1 << 16


def check_references(refs: DataFrame, k: int) -> None:
    if not 1 <= k <= 16:
        raise ValueError("k must be between 1 and 16")
    if refs.isEmpty():
        raise ValueError("no references")


def kmer_codes(data: np.ndarray, lens: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(code, string's number) of all k-mers of bases, in order, of strings that follow each other."""
    base = _CODE[np.minimum(data, 255)]
    n = len(base) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    code, valid = np.zeros(n, np.int64), np.ones(n, bool)
    for i in range(k):
        part = base[i : i + n]
        code = code * 4 + part
        valid &= part < 4
    owner = np.repeat(np.arange(len(lens)), lens)
    valid &= owner[:n] == owner[k - 1 :]
    return code[valid], owner[:n][valid]


def draws(n: int, seeds: list[int]) -> np.ndarray:
    """Places of the k-mers that each replicate draws of n: an eighth of them, one at least, but by 8 shifts
    of one state only, so 8 different ones at most."""
    used = min(max(n // 8, 1), SHIFTS)
    return np.array([[(s >> i) % n for i in range(used)] for s in seeds], np.int64)


class QueryBlock:
    """The k-mer sets of some queries: for each the whole set, and with seeds one for each replicate. A set
    is a list of numbers in the block's vocabulary; the last number, of a k-mer that nothing has, fills it."""

    def __init__(self, seqs: list[str], k: int, seeds: list[int]):
        self.k, self.seeds = k, seeds
        data, lens = codes(pa.array(seqs, pa.string()))
        code, owner = kmer_codes(data, lens, k)
        self.vocabulary, at = np.unique(code, return_inverse=True)
        bounds = np.searchsorted(owner, np.arange(len(seqs) + 1))
        self.kmers = [at[i:j] for i, j in zip(bounds, bounds[1:])]

    def sets(self, q: int) -> tuple[np.ndarray, np.ndarray]:
        """(the distinct k-mers, replicates x draws with repeats within a replicate filled)."""
        own, nothing = self.kmers[q], len(self.vocabulary)
        if not self.seeds or not len(own):
            return np.unique(own), np.zeros((0, 1), np.int64)
        drawn = np.sort(own[draws(len(own), self.seeds)], axis=1)
        drawn[:, 1:][drawn[:, 1:] == drawn[:, :-1]] = nothing
        return np.unique(own), drawn

    def best(self, batches) -> pa.RecordBatch:
        """(query, scores, references): for every set the reference with most of its k-mers, of equals the
        last; sets that no reference meets have the last reference of all, and score 0."""
        n, sets = len(self.kmers), 1 + len(self.seeds)
        score, ref = np.full((n, sets), -1, np.int64), np.full((n, sets), -1, np.int64)
        own = [self.sets(q) for q in range(n)]
        for ids, data, lens in batches:
            order = np.argsort(ids, kind="stable")
            place = np.empty(len(ids), np.int64)
            place[order] = np.arange(len(ids))
            has = np.zeros((len(self.vocabulary) + 1, len(ids)), np.uint8)
            code, owner = kmer_codes(data, lens, self.k)
            at = np.minimum(np.searchsorted(self.vocabulary, code), max(len(self.vocabulary) - 1, 0))
            known = self.vocabulary[at] == code if len(self.vocabulary) else np.zeros(len(code), bool)
            has[at[known], place[owner[known]]] = 1
            for q, (whole, drawn) in enumerate(own):
                got = np.zeros((sets, len(ids)), np.int32)
                got[0] = has[whole].sum(axis=0, dtype=np.int32)
                if len(drawn):
                    few = has[drawn[:, 0]]
                    for i in range(1, drawn.shape[1]):
                        few = few + has[drawn[:, i]]
                    got[1:] = few
                some = sets if len(drawn) else 1  # without k-mers there is nothing to draw
                last = got.shape[1] - 1 - got[:some, ::-1].argmax(axis=1)
                top, name = got[np.arange(some), last], ids[order[last]]
                better = np.flatnonzero((top > score[q, :some]) | ((top == score[q, :some]) & (name > ref[q, :some])))
                score[q, better], ref[q, better] = top[better], name[better]
        found = np.flatnonzero(ref[:, 0] >= 0)
        return pa.RecordBatch.from_arrays([pa.array(found), *(pa.array([x[q].tobytes() for q in found], pa.binary()) for x in (score, ref))], ["query", "score", "ref"])


def _reference_parts(batches) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ref_idx, letters, lengths) of some references at a time."""
    for batch in batches:
        data, lens = codes(batch.column("seq"))
        ids, ends = batch.column("ref_idx").to_numpy(), np.r_[0, np.cumsum(lens)]
        at = 0
        while at < len(ids):
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + _LETTERS, side="right")) - 1)
            to = min(to, len(ids), at + 4096)
            yield ids[at:to], data[ends[at] : ends[to]], lens[at:to]
            at = to


def best_references(queries: DataFrame, refs: DataFrame, k: int, seeds: list[int]) -> DataFrame:
    """(qid, rep, ref_idx, score) of queries(qid, seq): the best reference of each query's distinct k-mers
    (rep -1) and of each replicate's. A query without a valid k-mer has its row -1 only, with score 0.

    The queries go to the references in blocks of bounded size, and each block's best references of a task
    come back as one row for each query, so no pair of a query and a reference is ever a row.
    """
    spark = refs.sparkSession
    narrow = refs.select(F.col("ref_idx").cast("long").alias("ref_idx"), "seq")
    parts, names, held = [], [], []

    def add() -> None:
        block, first = spark.sparkContext.broadcast(QueryBlock([s for _, s in held], k, seeds)), len(names)
        names.extend(q for q, _ in held)

        def scan(batches):
            got = block.value.best(_reference_parts(batches))
            yield pa.RecordBatch.from_arrays([pa.array(got.column("query").to_numpy() + first), got.column("score"), got.column("ref")], ["query", "score", "ref"])

        parts.append(narrow.mapInArrow(scan, "query bigint, score binary, ref binary"))

    size = 0
    for r in queries.select("qid", "seq").toLocalIterator():
        held.append((r["qid"], r["seq"] or ""))
        size += len(held[-1][1])
        if len(held) == QUERIES or size > QUERIES << 11:
            add()
            held, size = [], 0
    if held or not parts:
        add()
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = reduce(DataFrame.union, parts).repartition(n, "query").sortWithinPartitions("query")

    def merge(batches):
        """The best of the tasks' best, query by query; they stand together."""
        now, best = None, None

        def rows():
            score, ref = best
            used = len(score) if ref[1:].max(initial=-1) >= 0 else 1
            return pa.RecordBatch.from_arrays([pa.array(np.full(used, now)), pa.array(np.arange(-1, used - 1, dtype=np.int32)), pa.array(ref[:used]), pa.array(score[:used])], ["query", "rep", "ref_idx", "score"])

        for batch in batches:
            for q, s, r in zip(*(batch.column(c).to_pylist() for c in ("query", "score", "ref"))):
                score, ref = np.frombuffer(s, np.int64), np.frombuffer(r, np.int64)
                if q != now:
                    if best:
                        yield rows()
                    now, best = q, (score, ref)
                else:
                    keep = (score > best[0]) | ((score == best[0]) & (ref > best[1]))
                    best = np.where(keep, score, best[0]), np.where(keep, ref, best[1])
        if best:
            yield rows()

    out = found.mapInArrow(merge, "query bigint, rep int, ref_idx bigint, score bigint")
    kind = queries.schema["qid"]
    known = spark.createDataFrame([(i, q) for i, q in enumerate(names)], StructType([StructField("query", LongType()), kind]))
    return out.join(known, "query").select("qid", "rep", "ref_idx", "score")


def classify_best(queries: DataFrame, refs: DataFrame, k: int = 8) -> DataFrame:
    """(qid, ref_idx, score) of queries(qid, seq). A query without a valid k-mer has score 0."""
    check_references(refs, k)
    return best_references(queries, refs, k, []).select("qid", "ref_idx", "score")


def _level(lineage: str, i: int) -> Column:
    return F.get(F.col(lineage), F.lit(i))


def bootstrap(queries: DataFrame, refs: DataFrame, lineages: DataFrame, config: TaxonomyConfig = TaxonomyConfig()) -> DataFrame:
    """(qid, ref_idx, lineage, bootstrap): the best reference, and for each of the 7 levels the share of
    replicates whose best reference has the same name there. Null shares where there is no valid k-mer."""
    check_references(refs, config.k)
    best = best_references(queries, refs, config.k, states(config.seed))
    # Only the references that were best of something get their lineages looked up.
    names = refs.select("ref_idx", "id").join(best.select("ref_idx").distinct(), "ref_idx", "left_semi").join(lineages, "id", "left").select("ref_idx", "lineage")
    named = best.join(names, "ref_idx", "left")
    own = named.where("rep < 0").select("qid", "ref_idx", "lineage")
    both = own.join(named.where("rep >= 0").select("qid", "rep", F.col("lineage").alias("other")), "qid", "left")
    same = lambda i: F.coalesce((_level("lineage", i) == _level("other", i)) & (_level("lineage", i) != ""), F.lit(False))
    shares = F.array(*(F.count_if(same(i)) / F.lit(float(REPLICATES)) for i in range(len(LEVELS))))
    got = both.groupBy("qid", "ref_idx", "lineage").agg(F.count("rep").alias("reps"), shares.alias("b"))
    return got.select("qid", "ref_idx", "lineage", F.when(F.col("reps") > 0, F.col("b")).alias("bootstrap"))


def assign_taxonomy(queries: DataFrame, refs: DataFrame, lineages: DataFrame, config: TaxonomyConfig = TaxonomyConfig()) -> DataFrame:
    """(qid, asv, kingdom...species, confidence, bootstrap) of queries(qid, seq). A level's name is given
    where its share reaches the threshold; species never is. With try_rc the reverse complement is taken
    where its genus is strictly more certain. A query without a valid k-mer gets nulls and confidence 0."""

    turns = [F.struct(F.lit(0).alias("turned"), F.col("seq").alias("seq"))]
    if config.try_rc:
        turns.append(F.struct(F.lit(1).alias("turned"), reverse_complement(F.col("seq")).alias("seq")))
    own = queries.select("qid", F.explode(F.array(*turns)).alias("x")).select(F.struct("qid", "x.turned").alias("qid"), "x.seq")
    both = bootstrap(own, refs, lineages, config).join(own, "qid")  # both directions in one scan of the references
    certain = F.coalesce(F.get(F.col("bootstrap"), F.lit(5)), F.lit(0.0))
    row = F.struct("seq", "lineage", "bootstrap")
    got = both.groupBy("qid.qid").agg(F.max_by(row, F.struct(certain, -F.col("qid.turned"))).alias("r")).select("qid", "r.seq", "r.lineage", "r.bootstrap")
    share = lambda i: F.get(F.col("bootstrap"), F.lit(i))
    name = lambda i: F.when((share(i) >= config.threshold) & (_level("lineage", i) != ""), _level("lineage", i))
    levels = [name(i).alias(x) for i, x in enumerate(LEVELS[:6])]
    zeros = F.array(*[F.lit(0.0)] * len(LEVELS))
    return got.select("qid", hex_key(F.col("seq")).alias("asv"), *levels, F.lit(None).cast("string").alias("species"), F.coalesce(share(5), F.lit(0.0)).alias("confidence"), F.coalesce("bootstrap", zeros).alias("bootstrap"))


def taxonomy_table(assigned: DataFrame, levels: list[str] = LEVELS, bootstraps: bool = False) -> DataFrame:
    """Names with "" and "NA" as null, and with `bootstraps` each level's percentage."""
    clean = [F.when(~F.col(x).isin("", "NA"), F.col(x)).alias(x) for x in levels]
    more = [(100 * F.get("bootstrap", F.lit(LEVELS.index(x)))).alias(f"{x}_boot") for x in levels] if bootstraps else []
    return assigned.select("qid", *clean, *more)


@dataclass(frozen=True)
class TaxonomyDb:
    """References with their lineages, made once and used for many tables of queries; `cached` keeps what
    its queries read in the executors' memory."""

    refs: DataFrame
    lineages: DataFrame
    k: int = 8

    @classmethod
    def build(cls, refs: DataFrame, lineages: DataFrame | None = None, k: int = 8) -> TaxonomyDb:
        """Lineages default to those of the headers. k is 2 at least; no references are an error."""
        k = max(k, 2)
        check_references(refs, k)
        return cls(refs, lineage_from_headers(refs) if lineages is None else lineages, k)

    def cached(self) -> TaxonomyDb:
        return TaxonomyDb(self.refs.select("ref_idx", "id", "seq").persist(), self.lineages.persist(), self.k)

    def assign(self, queries: DataFrame, min_boot: float = 50, try_rc: bool = False, bootstraps: bool = False, levels: list[str] = LEVELS) -> DataFrame:
        """(qid, levels...) and with `bootstraps` each level's percentage; min_boot is a percentage."""
        config = TaxonomyConfig(k=self.k, threshold=min_boot / 100, try_rc=try_rc)
        return taxonomy_table(assign_taxonomy(queries, self.refs, self.lineages, config), levels, bootstraps)
