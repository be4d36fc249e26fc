"""Language-model scoring by context-tree weighting.

A text is a sequence of lower-cased bytes and an end mark. Each byte is eight binary decisions; a decision's
contexts are its earlier bits together with the last 0, 1, ... `depth` bytes, the nodes of a context tree.
Every node has a Krichevsky-Trofimov estimate from the training counts, and the weighting mixes the
estimates of all depths: w = (estimate + product of the children) / 2, bottom up.

What the corpus gives is the count of each run of depth + 1 bytes, gathered from all texts and dealt by the
two bytes before the last, so that a part holds whole subtrees from depth 2 on; only the 65,792 nodes of
depths 0 and 1 are shared. The trained model is one file of (run, log-probability) for each part, in the
shared folder; a task reads parts as it needs them into a cache of bounded size.

The unigram base needs the count of each word. Blocks of documents send their distinct words with counts,
Spark sums and joins them, and each block gets the counts back: no vocabulary is held as a whole.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.llm.common import CACHES, new_path, raw, slices, stored, using
from tidepool.llm.idstore import _get, _put

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: A byte that UTF-8 never has: before each text and after it.
MARK = b"\xff"
#: Bytes of text in a block of words, and in a step of byte counting; runs that a task gathers at a time.
BLOCK_BYTES, STEP_BYTES, HELD_RUNS = 6 << 20, 2 << 20, 2_000_000
#: Bytes of model parts that a worker keeps.
CACHE_BYTES = 64 << 20
_ONE, _EIGHT, _BYTE = np.uint64(1), np.uint64(8), np.uint64(255)


def runs(texts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the runs of depth + 1 bytes that end at each byte and at each text's end mark, and the
    number of runs of each text."""
    lens = np.array([len(t) + 1 for t in texts], np.int64)
    if not len(texts):
        return np.zeros(0, np.uint64), lens
    data = np.frombuffer(b"".join(MARK * depth + t + MARK for t in texts).translate(_LOWER), np.uint8)
    codes = np.zeros(len(data) - depth, np.uint64)
    for i in range(depth + 1):
        codes = (codes << _EIGHT) | data[i : len(data) - depth + i]
    own = np.ones(len(data), bool)  # runs that end in the marks before a text aren't its own
    starts = np.cumsum(lens + depth) - lens - depth
    for i in range(depth):
        own[starts + i] = False
    return codes[own[depth:]], lens


def counted(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    codes = np.sort(codes)
    first = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]]) if len(codes) else np.zeros(0, np.int64)
    return codes[first], np.diff(np.r_[first, len(codes)])


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the counts of equal codes."""
    codes = np.concatenate([c for c, _ in parts])
    order = np.argsort(codes, kind="stable")
    codes, n = codes[order], np.concatenate([n for _, n in parts])[order]
    first = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]]) if len(codes) else np.zeros(0, np.int64)
    return codes[first], np.add.reduceat(n, first) if len(first) else n


def part_of(codes: np.ndarray, parts: int) -> np.ndarray:
    near = (codes >> _EIGHT) & np.uint64(0xFFFF)
    return ((near * np.uint64(40503) & np.uint64(0xFFFF)) * np.uint64(parts) >> np.uint64(16)).astype(np.int64)


def _log_gamma(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, float)
    less = np.zeros_like(x)
    for _ in range(6):
        less += np.log(x)
        x = x + 1
    return (x - 0.5) * np.log(x) - x + 0.5 * np.log(2 * np.pi) + 1 / (12 * x) - 1 / (360 * x**3) - less


def log_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of a sequence with these counts."""
    return _log_gamma(n0 + 0.5) + _log_gamma(n1 + 0.5) - _log_gamma(n0 + n1 + 1) - np.log(np.pi)


class Level:
    """The nodes of one depth for one of a byte's bits."""

    def __init__(self, keys: np.ndarray, bit: np.ndarray, counts: np.ndarray):
        u, self.at = np.unique(keys, return_inverse=True)
        self.keys = u
        self.n1 = np.bincount(self.at, counts * bit, len(u))
        self.n0 = np.bincount(self.at, counts * (1 - bit), len(u))

    def next_bit(self, bit: np.ndarray) -> np.ndarray:
        own = np.where(bit == 1, self.n1[self.at], self.n0[self.at])
        return (own + 0.5) / (self.n0[self.at] + self.n1[self.at] + 1)

    def from_below(self, below: Level, log_below: np.ndarray) -> np.ndarray:
        parent = np.zeros(len(below.keys), np.int64)
        parent[below.at] = self.at
        return np.bincount(parent, log_below, len(self.keys))


def weigh(log_own: np.ndarray, log_children: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(weight of a node's own estimate in its mixture, log of its weighted probability)."""
    weight = 1 / (1 + np.exp(np.clip(log_children - log_own, -700, 700)))
    return weight, np.logaddexp(log_own, log_children) - np.log(2)


class Roots:
    """Depths 0 and 1, from sums over all parts: key = last byte * 256 + node -> n0, n1, log of the
    children's product."""

    def __init__(self, keys: np.ndarray, n0: np.ndarray, n1: np.ndarray, children: np.ndarray):
        size = 1 << 16
        self.n0, self.n1, below = (np.bincount(keys, x, size) for x in (n0, n1, children))
        self.weight, log_w = weigh(log_kt(self.n0, self.n1), below)
        log_w[(self.n0 + self.n1) == 0] = 0.0
        node = np.arange(size) & 255
        self.root0, self.root1 = np.bincount(node, self.n0, 256), np.bincount(node, self.n1, 256)
        self.root_weight, _ = weigh(log_kt(self.root0, self.root1), np.bincount(node, log_w, 256))

    def mix(self, last: np.ndarray, node: np.ndarray, bit: np.ndarray, p: np.ndarray) -> np.ndarray:
        key = last * 256 + node
        for n0, n1, w, at in ((self.n0, self.n1, self.weight, key), (self.root0, self.root1, self.root_weight, node)):
            own = (np.where(bit == 1, n1[at], n0[at]) + 0.5) / (n0[at] + n1[at] + 1)
            p = w[at] * own + (1 - w[at]) * p
        return p


def tree(codes: np.ndarray, counts: np.ndarray, depth: int):
    """For each bit of the predicted byte: (node, bit, last byte, probability mixed from `depth` to 2, the
    level of depth 2 and the log of its weighted probabilities)."""
    byte, context = (codes & _BYTE).astype(np.int64), codes >> _EIGHT
    last = (context & _BYTE).astype(np.int64)
    counts = counts.astype(float)
    for i in range(8):
        node, bit = (1 << i) | (byte >> (8 - i)), (byte >> (7 - i)) & 1
        level, p, log_w = None, None, None
        for d in range(depth, 1, -1):
            now = Level(((context & ((_ONE << np.uint64(8 * d)) - _ONE)) << _EIGHT) | node.astype(np.uint64), bit, counts)
            own, log_own = now.next_bit(bit), log_kt(now.n0, now.n1)
            if level is None:
                p, log_w = own, log_own
            else:
                w, log_w = weigh(log_own, now.from_below(level, log_w))
                p = w[now.at] * own + (1 - w[now.at]) * p
            level = now
        yield node, bit, last, p, level, log_w


def root_sums(codes: np.ndarray, counts: np.ndarray, depth: int) -> tuple[np.ndarray, ...]:
    """What a part adds to the roots: (key, n0, n1, log of the children's product)."""
    size, out = 1 << 16, [np.zeros(1 << 16) for _ in range(3)]
    for _, _, _, _, level, log_w in tree(codes, counts, depth):
        key = (((level.keys >> _EIGHT) & _BYTE) * np.uint64(256) + (level.keys & _BYTE)).astype(np.int64)
        for x, y in zip(out, (level.n0, level.n1, log_w)):
            x += np.bincount(key, y, size)
    keys = np.flatnonzero((out[0] + out[1] > 0) | (out[2] != 0))
    return keys, out[0][keys], out[1][keys], out[2][keys]


def log10_of(codes: np.ndarray, counts: np.ndarray, depth: int, roots: Roots) -> np.ndarray:
    out = np.zeros(len(codes))
    for node, bit, last, p, _, _ in tree(codes, counts, depth):
        out += np.log10(roots.mix(last, node, bit, p))
    return out


class Model:
    """Reads the parts of a model; the cache drops the part that was used least recently."""

    def __init__(self, uri: str, parts: int):
        self.uri, self.parts, self.cache, self.size = uri, parts, {}, 0

    def part(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        if k in self.cache:
            self.cache[k] = got = self.cache.pop(k)
            return got
        data = _get(self.uri, f"part-{k:05d}.ctw")
        n = len(data) // 12
        got = np.frombuffer(data, "<u8", n), np.frombuffer(data, "<f4", n, 8 * n)
        self.cache[k], self.size = got, self.size + len(data)
        while self.size > CACHE_BYTES and len(self.cache) > 1:
            self.size -= 12 * len(self.cache.pop(next(iter(self.cache)))[0])
        return got

    def scores(self, texts: list[bytes], depth: int) -> np.ndarray:
        """log10 probability of each text with its end mark."""
        codes, lens = runs(texts, depth)
        if not len(codes):
            return np.zeros(len(lens))
        at, seen = pd.factorize(codes.view(np.int64))
        seen = seen.view(np.uint64)
        order = np.argsort(part_of(seen, self.parts), kind="stable")
        bounds = np.searchsorted(part_of(seen, self.parts)[order], np.arange(self.parts + 1))
        value = np.zeros(len(seen))
        for k in range(self.parts):
            rows = order[bounds[k] : bounds[k + 1]]
            if len(rows):
                keys, logs = self.part(k)
                own = seen[rows]
                i = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
                if (keys[i] != own).any():
                    raise ValueError("a text was changed after the model was made")
                value[rows] = logs[i]
        return np.add.reduceat(value[at], np.cumsum(lens) - lens)


_MODELS: dict[str, Model] = {}
CACHES[__name__] = _MODELS.clear


def _model(uri: str, parts: int) -> Model:
    if uri not in _MODELS:
        _MODELS.clear()
        _MODELS[uri] = Model(uri, parts)
    return _MODELS[uri]


def train(docs: DataFrame, text_col: str, train_col: str, depth: int, parts: int) -> str:
    """Counts of all runs in rows whose train_col is true; runs of the others are there with count 0, so
    that their probability is made too. A null text is empty, a null in train_col is false, repeated rows
    count each, and an empty table makes a model without parts. Returns the model's URI."""
    spark = docs.sparkSession
    uri = new_path(spark, "ctw")
    narrow = docs.select(F.col(f"`{text_col}`").alias("text"), F.col(f"`{train_col}`").alias("train"))

    def gather(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def rows():
            codes, n = merged(held)
            part = part_of(codes, parts)
            order = np.argsort(part, kind="stable")
            bounds = np.searchsorted(part[order], np.arange(parts + 1))
            some = [k for k in range(parts) if bounds[k + 1] > bounds[k]]
            own = [order[bounds[k] : bounds[k + 1]] for k in some]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([codes[o].astype("<u8").tobytes() for o in own], pa.binary()), pa.array([n[o].astype("<i8").tobytes() for o in own], pa.binary())], ["part", "codes", "n"])

        for batch in batches:
            for step in slices(batch, "text", STEP_BYTES):
                texts, is_train = raw(step, "text"), step.column("train").to_pylist()
                seen = counted(runs([t for t, x in zip(texts, is_train) if x], depth)[0])
                other = np.unique(runs([t for t, x in zip(texts, is_train) if not x], depth)[0])
                held = [merged([*held, seen, (other, np.zeros(len(other), np.int64))])]
                if len(held[0][0]) > HELD_RUNS:
                    yield from rows()
                    held = []
        if held:
            yield from rows()

    def join(batches):
        held: dict[int, list] = {}
        for batch in batches:
            for k, c, n in zip(*(batch.column(x).to_pylist() for x in ("part", "codes", "n"))):
                held.setdefault(k, []).append((np.frombuffer(c, "<u8"), np.frombuffer(n, "<i8")))
                if len(held[k]) > 16:
                    held[k] = [merged(held[k])]
        for k, own in held.items():
            codes, n = merged(own)
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([codes.tobytes()], pa.binary()), pa.array([n.tobytes()], pa.binary())], ["part", "codes", "n"])

    schema = "part int, codes binary, n binary"
    whole = stored(narrow.mapInArrow(gather, schema).repartition(parts, "part").mapInArrow(join, schema), "runs")

    def arrays(batch):
        for i in range(batch.num_rows):
            k, c, n = (batch.column(x)[i].as_py() for x in ("part", "codes", "n"))
            yield k, np.frombuffer(c, "<u8"), np.frombuffer(n, "<i8")

    def sums(batches):
        for batch in batches:
            for _, codes, n in arrays(batch):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in root_sums(codes, n, depth)], ["key", "n0", "n1", "children"])

    # At most 65,536 rows come to the driver, and go to the tasks.
    got = whole.mapInArrow(sums, "key long, n0 double, n1 double, children double").groupBy("key").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"), F.sum("children").alias("children")).orderBy("key").toPandas()
    roots = Roots(got["key"].to_numpy(np.int64), *(got[c].to_numpy(float) for c in ("n0", "n1", "children")))
    shared = spark.sparkContext.broadcast(roots)

    def write(batches):
        for batch in batches:
            for k, codes, n in arrays(batch):
                logs = log10_of(codes, n, depth, shared.value)
                _put(uri, f"part-{k:05d}.ctw", [codes.tobytes(), logs.astype("<f4").tobytes()])
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([len(codes)], pa.int64())], ["part", "n"])

    whole.mapInArrow(write, "part int, n long").agg(F.sum("n")).collect()
    return uri


def _planes(ids: np.ndarray) -> bytes:
    """Ids below 2^32 as four planes of bytes, which compress well."""
    return np.ascontiguousarray(ids.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _of_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").reshape(-1)


def _packed(batches):
    """A task's (block, at, c) with one row for each block, or more where there are very many."""
    held, size = [], 0

    def rows():
        block, at, c = (np.concatenate([h[k] for h in held]) for k in range(3))
        order = np.argsort(block, kind="stable")
        block, at, c = block[order], at[order], c[order]
        first = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
        cuts = list(zip(first, [*first[1:], len(block)]))
        return pa.RecordBatch.from_arrays([pa.array(block[first]), pa.array(np.ones(len(first), np.int32)), pa.array([at[i:j].tobytes() for i, j in cuts], pa.binary()), pa.array([c[i:j].tobytes() for i, j in cuts], pa.binary())], ["block", "kind", "at", "c"])

    for batch in batches:
        if batch.num_rows:
            held.append([x.to_numpy() for x in batch.columns])
            size += batch.num_rows
        if size > 2_000_000:
            yield rows()
            held, size = [], 0
    if size:
        yield rows()


def score(docs: DataFrame, train_col: str, id_col: str = "doc_id", text_col: str = "text", depth: int = 5, parts: int | None = None) -> DataFrame:
    """For each row: id_col, n_tokens (words and the end), n_known (those seen in training), train_tokens,
    base_score (log10 probability by add-one unigrams), score (log10 probability of the text by
    context-tree weighting; bits_per_byte is its code length for each byte and the end).

    train_col: boolean column; the rows where it is true are learned from, all rows are scored. A null or
    empty text is its end alone. Without training rows every count is 0 and probabilities are uniform.
    Repeated rows are learned and scored each; other columns are ignored.
    """
    spark = docs.sparkSession
    parts = parts or max(4, int(spark.conf.get("spark.sql.shuffle.partitions")))
    key_type = dict(docs.dtypes)[id_col]
    narrow = docs.select(F.col(f"`{id_col}`").alias("key"), F.col(f"`{text_col}`").cast("string").alias("text"), F.coalesce(F.col(f"`{train_col}`"), F.lit(False)).alias("train"))
    uri = train(narrow, "text", "train", depth, parts)
    # Blocks: kind 0 holds the documents of a block, kind 1 one of its distinct words.
    schema = f"block long, kind int, keys array<{key_type}>, bytes binary, ctw binary, lens binary, ids binary, word binary, at int, n long"

    def blocks(batches):
        using(__name__)
        model, made = _model(uri, parts), 0
        for batch in batches:
            for part in slices(batch, "text", BLOCK_BYTES):
                texts, is_train = raw(part, "text"), part.column("train").to_pylist()
                number: dict[bytes, int] = {}
                lens, ids, seen = [], [], Counter()
                for t, x in zip(texts, is_train):
                    words = t.translate(_LOWER).split()
                    lens.append(len(words))
                    ids += [number.setdefault(w, len(number)) for w in words]
                    if x:
                        seen.update(words)
                done, at = [], 0
                for step in slices(part, "text", STEP_BYTES):
                    done.append(model.scores(texts[at : at + step.num_rows], depth))
                    at += step.num_rows
                block = (TaskContext.get().partitionId() << 32) + made
                made += 1
                yield from _block_rows(block, part, lens, np.array(ids, np.int64), texts, np.concatenate(done), number, seen)

    def _block_rows(block, part, lens, ids, texts, ctw, number, seen):
        n, keys = len(number), part.column("key")
        sizes = np.array([len(t) + 1 for t in texts], "<i8")
        blobs = [sizes.tobytes(), ctw.astype("<f8").tobytes(), np.array(lens, "<i8").tobytes(), _planes(ids)]
        listed = pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys)
        names = ["block", "kind", "keys", "bytes", "ctw", "lens", "ids", "word", "at", "n"]
        yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([0], pa.int32()), listed, *(pa.array([b], pa.binary()) for b in blobs), pa.array([None], pa.binary()), pa.array([None], pa.int32()), pa.array([None], pa.int64())], names)
        words = list(number)
        for i in range(0, n, 50_000):
            some = words[i : i + 50_000]
            k = len(some)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(k, block)), pa.array(np.ones(k, np.int32)), pa.nulls(k, listed.type), *(pa.nulls(k, pa.binary()) for _ in blobs), pa.array(some, pa.binary()), pa.array(np.arange(i, i + k, dtype=np.int32)), pa.array([seen.get(w, 0) for w in some], pa.int64())], names)

    table = stored(narrow.mapInArrow(blocks, schema), "blocks")
    words = table.where("kind = 1").select("block", "word", "at", "n")
    counts = stored(words.groupBy("word").agg(F.sum("n").alias("c")).where("c > 0"), "words")
    ends = narrow.where("train").count()
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    n_all, v_all = total["n"] + ends, total["v"] + (1 if ends else 0)
    known = words.join(counts, "word").select("block", "at", "c").mapInArrow(_packed, "block long, kind int, at binary, c binary")
    heads = table.where("kind = 0").select("block", "kind", "keys", "bytes", "ctw", "lens", "ids", F.lit(None).cast("binary").alias("at"), F.lit(None).cast("binary").alias("c"))
    both = heads.unionByName(known, allowMissingColumns=True)
    shuffled = both.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "block").sortWithinPartitions("block", "kind")

    def finish(batches):
        """A block's head comes first, then the counts of its words."""
        head, at, c = None, [], []

        def result():
            lens, sizes, ctw = (np.frombuffer(head[x].as_py(), d) for x, d in (("lens", "<i8"), ("bytes", "<i8"), ("ctw", "<f8")))
            ids = _of_planes(head["ids"].as_py())
            count = np.zeros(int(ids.max()) + 1 if len(ids) else 0)
            if at:
                count[np.concatenate(at)] = np.concatenate(c)
            log = np.log10((count + 1) / (n_all + v_all + 1))
            bounds = np.r_[0, np.cumsum(lens)]
            # Sums document by document, so that a score doesn't depend on its block.
            base = np.array([log[ids[i:j]].sum() for i, j in zip(bounds, bounds[1:])]) + np.log10((ends + 1) / (n_all + v_all + 1))
            known_sum = np.r_[0, np.cumsum(count[ids] > 0)]
            n_known = known_sum[bounds[1:]] - known_sum[bounds[:-1]] + (1 if ends else 0)
            k = len(lens)
            return pa.RecordBatch.from_arrays([head["keys"].values, pa.array(lens + 1), pa.array(n_known), pa.array(np.full(k, n_all, np.int64)), pa.array(base), pa.array(ctw), pa.array(-ctw * np.log2(10) / sizes)], ["key", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte"])

        for batch in batches:
            for i, kind in enumerate(batch.column("kind").to_pylist()):
                if kind == 0:
                    if head is not None:
                        yield result()
                    head, at, c = {x: batch.column(x)[i] for x in ("keys", "bytes", "ctw", "lens", "ids")}, [], []
                else:
                    at.append(np.frombuffer(batch.column("at")[i].as_py(), np.int32))
                    c.append(np.frombuffer(batch.column("c")[i].as_py(), np.int64))
        if head is not None:
            yield result()

    out = shuffled.mapInArrow(finish, f"key {key_type}, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double")
    return out.withColumnRenamed("key", id_col)
