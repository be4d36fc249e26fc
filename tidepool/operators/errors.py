"""Evidence for the error model: how often a base is read as itself and as another."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tidepool.functions.kernels import codes, histogram, letters
from tidepool.operators.dereplicate import dereplicate

TOP = 40
#: The number of a base, by its letter's code; what isn't a base counts as A.
_BASE = np.zeros(256, np.int64)
for _i, _b in enumerate("CGT", 1):
    _BASE[ord(_b)] = _BASE[ord(_b.lower())] = _i


def match_counts(reads: DataFrame) -> DataFrame:
    """(b, q, n): every base of every read, with scores capped at 40."""

    def place(batch):
        seq, n_seq = codes(batch.column("seq"))
        qual, n_qual = codes(batch.column("qual"))
        if not np.array_equal(n_seq, n_qual):  # a base without a score counts for nothing
            both = np.minimum(n_seq, n_qual)
            inside = lambda n: np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) < np.repeat(both, n)
            seq, qual = seq[inside(n_seq)], qual[inside(n_qual)]
        yield _BASE[np.minimum(seq, 255)] * (TOP + 1) + np.clip(qual.astype(np.int64) - 33, 0, TOP)

    return histogram(reads.select("seq", "qual"), "b int, q int", (4, TOP + 1), place)


def _dealt(rows: DataFrame, max_dist: int, block: int) -> DataFrame:
    """rows (seq, ...) under the keys (size, no, chunk, i, j) of the groups that they are compared in, with
    their own block; each group's rows stand together.

    Of max_dist + 1 chunks of two sequences that differ in max_dist places one at least is equal, so only
    rows with a common chunk meet. Sequences too short for that many chunks have one key for each length. A
    chunk of more than `block` rows is dealt in pairs of blocks, so a chunk that most sequences share is the
    work of many tasks.
    """
    k = max_dist + 1
    size = F.length("seq")
    bound = lambda i: F.floor(size * i / k).cast("int")
    chunks = F.array(*(F.substring(F.col("seq"), bound(i) + 1, bound(i + 1) - bound(i)) for i in range(k)))
    keyed = rows.select("*", size.alias("size"), F.posexplode(F.when(size >= k, chunks).otherwise(F.array(F.lit("")))).alias("no", "chunk"))
    key = ["size", "no", "chunk"]
    groups = keyed.groupBy(*key).agg(F.count("*").alias("rows")).where("rows > 1").select(*key, F.ceil(F.col("rows") / block).cast("int").alias("k"))
    own = F.pmod(F.xxhash64("seq"), F.col("k")).cast("int")
    placed = keyed.join(groups, key).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = placed.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")}).drop("k", "other")
    # A number of partitions that is asked for is kept, however small the keys are: comparing is the work.
    return out.repartition(parts, *key, "i", "j").sortWithinPartitions(*key, "i", "j")


class _Pack:
    """Rows of one length: one group, or several small ones. Comparing is done by matrix products."""

    def __init__(self, rows: list[tuple], max_dist: int):
        self.rows, self.most, n = rows, max_dist, len(rows)
        label, seq, self.cnt, self.own, self.no, self.cross = (list(x) for x in zip(*(r[:6] for r in rows)))
        order = sorted(range(n), key=lambda r: (-self.cnt[r], seq[r]))
        self.rank = np.empty(n, np.int64)
        self.rank[order] = np.arange(n)
        self.code = letters(seq, len(seq[0]))
        self.label, self.cnt, self.own, self.no, self.cross = (np.array(x) for x in (label, self.cnt, self.own, self.no, self.cross))
        self.alphabet = np.unique(self.code)

    def tiles(self, tile: int = 1024):
        """(parents, children, whether they are neighbours): numbers of rows, and a matrix."""
        n, width = self.code.shape
        k = self.most + 1
        edges = [width * c // k for c in range(k + 1)] if width >= k else [0, width]
        for a in range(0, n, tile):
            for b in range(a, n, tile):
                x, y = np.arange(a, min(a + tile, n)), np.arange(b, min(b + tile, n))
                if a != b and self.cross[x].all() and len({*self.own[x], *self.own[y]}) == 1 and len({*self.label[x], *self.label[y]}) == 1:
                    continue  # one block of a pair of blocks: its rows meet each other elsewhere
                ok = (self.label[x][:, None] == self.label[y]) & ~(self.cross[x][:, None] & (self.own[x][:, None] == self.own[y]))
                same = np.zeros(ok.shape, np.float32)
                hot = [((self.code[x] == c).astype(np.float32), (self.code[y] == c).astype(np.float32)) for c in self.alphabet]
                for c, (lo, hi) in enumerate(zip(edges, edges[1:])):
                    part = sum(p[:, lo:hi] @ q[:, lo:hi].T for p, q in hot)
                    # A pair is taken at its first equal chunk only.
                    if len(edges) > 2:
                        ok &= ~((part == hi - lo) & (self.no[x][:, None] > c))
                    same += part
                dist = width - same
                ok &= (dist >= 1) & (dist <= self.most)
                down = self.rank[x][:, None] < self.rank[y]
                yield x, y, ok & down, dist
                if a != b:
                    yield y, x, (ok & ~down).T, dist.T


def _packs(batches, max_dist: int, more: tuple[str, ...] = (), most: int = 1024):
    """Packs of a task's rows, which are sorted by group."""
    rows, group, now, size = [], 0, None, None
    names = ["size", "no", "chunk", "i", "j", "seq", "cnt", "own", *more]
    for batch in batches:
        for n, no, chunk, i, j, seq, cnt, own, *rest in zip(*(batch.column(c).to_pylist() for c in names)):
            if (key := (n, no, chunk, i, j)) != now:
                if rows and (n != size or len(rows) >= most):
                    yield _Pack(rows, max_dist)
                    rows = []
                now, size, group = key, n, group + 1
            rows.append((group, seq, cnt, own, no, i != j, *rest))
    if rows:
        yield _Pack(rows, max_dist)


def neighbours(uniques: DataFrame, max_dist: int = 8, block: int = 4096) -> DataFrame:
    """Pairs (parent, child, dist, parent_cnt, child_cnt) of sequences (id, seq, cnt) of equal length that
    differ in 1 to max_dist places; the parent is the commoner, of equals the first by sequence."""
    kind = dict(uniques.dtypes)["id"]

    def run(batches):
        for pack in _packs(batches, max_dist, ("id",)):
            ids = [r[6] for r in pack.rows]
            for x, y, ok, dist in pack.tiles():
                a, b = np.nonzero(ok)
                p, c = x[a], y[b]
                yield pa.RecordBatch.from_arrays([pa.array([ids[r] for r in p], id_type), pa.array([ids[r] for r in c], id_type), pa.array(dist[a, b].astype(np.int32)), pa.array(pack.cnt[p].astype(np.int64)), pa.array(pack.cnt[c].astype(np.int64))], ["parent", "child", "dist", "parent_cnt", "child_cnt"])

    id_type = to_arrow_type(uniques.schema["id"].dataType)
    return _dealt(uniques.select("id", "seq", "cnt"), max_dist, block).mapInArrow(run, f"parent {kind}, child {kind}, dist int, parent_cnt bigint, child_cnt bigint")


def mismatch_counts(reads: DataFrame, max_dist: int = 8, block: int = 4096) -> DataFrame:
    """(t, o, q, w): for every pair of neighbours, at each place where they differ, the smaller of their
    numbers as evidence that t was read as o at the child's mean score (cut to a whole number, capped).

    Pairs are summed where they are found, by matrix products over the parents, so a task sends no more than
    a row for each of the 656 cells, however many pairs it has.
    """
    whole = reads.where(F.length("seq") == F.length("qual")).withColumn("all", F.lit(1))
    scores = F.transform("qual_sum", lambda s: F.least(F.floor(s / F.col("cnt")), F.lit(TOP)).cast("int"))
    uniques = dereplicate(whole, "all").select("seq", "cnt", scores.alias("q"))

    def run(batches):
        out = np.zeros((4, 4 * (TOP + 1)))
        for pack in _packs(batches, max_dist, ("q",)):
            cell = _BASE[np.minimum(pack.code, 255)] * (TOP + 1) + np.array([r[6] for r in pack.rows], np.int64).reshape(pack.code.shape)
            for x, y, ok, _ in pack.tiles():
                if not ok.any():
                    continue
                w = np.where(ok, np.minimum(pack.cnt[x][:, None], pack.cnt[y]), 0).astype(np.float64)
                child, at = pack.code[y].T, cell[y].T
                for c in pack.alphabet:
                    sums = (pack.code[x] == c).T.astype(np.float64) @ w
                    differ = (child != c) & (sums > 0)
                    out[_BASE[min(int(c), 255)]] += np.bincount(at[differ], sums[differ], out.shape[1])
        t, at = np.nonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(t.astype(np.int32)), pa.array((at // (TOP + 1)).astype(np.int32)), pa.array((at % (TOP + 1)).astype(np.int32)), pa.array(out[t, at].astype(np.int64))], ["t", "o", "q", "w"])

    found = _dealt(uniques, max_dist, block).mapInArrow(run, "t int, o int, q int, w bigint")
    return found.groupBy("t", "o", "q").agg(F.sum("w").alias("w"))


def transition_counts(reads: DataFrame, max_dist: int = 8) -> DataFrame:
    """(t, o, q, n), at most 656 rows: matches and mismatches. Evidence that o was t by mistake is taken
    from o's matches, down to 0; evidence between two letters that count as the same base adds nothing."""
    found = mismatch_counts(reads, max_dist)
    matches = match_counts(reads).select(F.col("b").alias("t"), F.col("b").alias("o"), "q", F.col("n").cast("long").alias("n"))
    less = found.select(F.col("o").alias("t"), "o", "q", (-F.col("w")).alias("n"))
    own = matches.union(less).union(found.where("t = o").select("t", "o", "q", F.col("w").alias("n")))
    own = own.groupBy("t", "o", "q").agg(F.greatest(F.sum("n"), F.lit(0)).alias("n"))
    return own.union(found.where("t <> o").select("t", "o", "q", F.col("w").alias("n")))


def _up_to(reads: DataFrame, quotas: DataFrame) -> DataFrame:
    """The first reads of each sample by record, as many as quotas(sample, size, quota) says of the size
    that the sample has. Only samples that are cut are sorted, and of them the records' numbers only; the
    reads themselves are read once, against a limit for each sample."""
    cut = reads.select("sample", "rec").join(F.broadcast(quotas.where("quota > 0 and quota < size").select("sample", "quota")), "sample")
    last = cut.withColumn("_r", F.row_number().over(Window.partitionBy("sample").orderBy("rec"))).where("_r = quota").select("sample", F.col("rec").alias("_last"))
    whole = quotas.where("quota >= size").select("sample", F.lit((1 << 63) - 1).cast("long").alias("_last"))
    return reads.join(F.broadcast(whole.union(last)), "sample").where("rec <= _last").select([f"`{c}`" for c in reads.columns])


def first_reads(reads: DataFrame, n: int) -> DataFrame:
    """The first n reads in (sample, rec) order; a record's number stands once in its sample."""
    per = reads.groupBy("sample").agg(F.count("*").alias("size"))
    before = F.coalesce(F.sum("size").over(Window.orderBy("sample").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return _up_to(reads, per.select("sample", "size", F.greatest(F.lit(n) - before, F.lit(0)).alias("quota")))


def first_of_each(reads: DataFrame, n: int) -> DataFrame:
    """The first n reads of each sample by record."""
    return _up_to(reads, reads.groupBy("sample").agg(F.count("*").alias("size")).withColumn("quota", F.lit(n)))
