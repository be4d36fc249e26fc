"""Near-duplicate groups by SuperMinHash.

1. Each text's set of word shingles gets a SuperMinHash signature, whose bands are hashed. Exact copies
   (equal words in order) are folded into the one with the smallest id before any comparing.
2. Documents with an equal band are joined into candidate units by union-find. A batch of documents sends
   each of its band hashes once, so a hash that very many documents share stays small on its way.
3. A unit is verified on the full sets, in blocks of bounded size: a task counts the common shingles of a
   pair of blocks by matrix products and passes on a spanning forest of the links, never the pairs.
4. Union-find joins the links, first in each task and then between tasks by rounds of stars.
Every step is a table in the shared folder.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.llm.common import CACHES, drop_stored, map_texts, raw, stored

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_GOLD, _A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Elements whose permutations are held at a time.
_CHUNK = 1 << 13
#: Shares of a hub's links.
SPLITS = 64


def mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * _A
        x = (x ^ (x >> np.uint64(27))) * _B
        return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 250_000:
            self.clear()
        got = self[word] = xxhash.xxh3_64_intdigest(word)
        return got


_WORDS = WordHashes()
CACHES[__name__] = _WORDS.clear


def shingles(text: bytes, n: int) -> tuple[np.ndarray, list[bytes]]:
    """Sorted distinct hashes of the runs of n words; fewer words are one shingle, none are an empty set."""
    words = text.translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64), words
    h = np.array([_WORDS[w] for w in words], np.uint64)
    k = min(n, len(h))
    out = np.full(len(h) - k + 1, k, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(k):
            out = mixed(out * _GOLD + h[i : len(h) - k + 1 + i])
    return np.unique(out), words


def super_minhash(sets: list[np.ndarray], m: int) -> np.ndarray:
    """Signatures of m values. Each element draws a random permutation of the m places; its j-th place gets
    j plus a random fraction, and the least value of a place stays. Once every place of a set is below j,
    its elements stop, mostly after two or three draws."""
    out = np.full((len(sets), m), np.iinfo(np.uint32).max, np.uint32)
    sizes = np.array([len(s) for s in sets])
    order = np.argsort(sizes, kind="stable")
    at = 0
    while at < len(order):  # sets of like size together, up to _CHUNK elements; larger sets in pieces
        to = at + 1
        total = sizes[order[at]]
        while to < len(order) and total + sizes[order[to]] <= _CHUNK:
            total += sizes[order[to]]
            to += 1
        rows = order[at:to]
        if total:
            elements, owner = np.concatenate([sets[r] for r in rows]), np.repeat(rows, sizes[rows])
            for i in range(0, total, _CHUNK):
                _draw(out, elements[i : i + _CHUNK], owner[i : i + _CHUNK], m)
        at = to
    return out


def _draw(out: np.ndarray, elements: np.ndarray, owner: np.ndarray, m: int) -> None:
    flat = out.reshape(-1)
    random = np.uint32(32 - (m - 1).bit_length())  # a value is a rank below m, then this many random bits
    mask = (np.uint64(1) << np.uint64(random)) - np.uint64(1)
    places = np.tile(np.arange(m, dtype=np.uint16), (len(elements), 1))
    live = np.arange(len(elements))
    for j in range(m):
        with np.errstate(over="ignore"):
            draw = mixed(elements[live] + _GOLD * np.uint64(j + 1))
        k = j + ((draw >> np.uint64(32)) * np.uint64(m - j) >> np.uint64(32)).astype(np.int64)
        place = places[live, k].astype(np.int64)
        places[live, k] = places[live, j]
        value = (np.uint32(j) << random) | (draw & mask).astype(np.uint32)
        np.minimum.at(flat, owner[live] * m + place, value)
        now = np.unique(owner[live])
        going = now[out[now].max(axis=1) >= np.uint32(j + 1) << random] if j + 1 < m else now[:0]
        if len(going) < len(now):
            if not len(going):
                return
            live = live[np.isin(owner[live], going)]


def band_hashes(signatures: np.ndarray, rows: int) -> np.ndarray:
    n, m = signatures.shape
    parts = signatures.reshape(n, m // rows, rows).astype(np.uint64)
    out = np.broadcast_to(np.arange(1, m // rows + 1, dtype=np.uint64), (n, m // rows)).copy()
    with np.errstate(over="ignore"):
        for r in range(rows):
            out = mixed(out * _GOLD + parts[:, :, r])
    return out.view(np.int64)


def _signed(docs: DataFrame, id_col: str, text_col: str, n: int, bands: int, rows: int) -> DataFrame:
    """(node, n_shingles, words: hash of all words in order, bands: their packed hashes), the last two null
    where there are no words."""

    def kernel(part: pa.RecordBatch) -> dict:
        got = [shingles(t, n) for t in raw(part, "text")]
        hashes = band_hashes(super_minhash([s for s, _ in got], bands * rows), rows)
        packed = [h.tobytes() if w else None for h, (_, w) in zip(hashes, got)]
        return {"n_shingles": pa.array([len(s) for s, _ in got], pa.int64()), "words": pa.array([xxhash.xxh3_128_digest(b" ".join(w)) if w else None for _, w in got], pa.binary()), "bands": pa.array(packed, pa.binary())}

    return map_texts(docs, id_col, text_col, "n_shingles long, words binary, bands binary", kernel).withColumnRenamed(id_col, "node")


def _local_union(batches):
    """Union-find over a task's links: each node with the smallest it is joined to."""
    root: dict = {}

    def find(x):
        while (p := root.setdefault(x, x)) != x:
            root[x] = root.setdefault(p, p)
            x = root[x]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = find(a), find(b)
            if a != b:
                root[max(a, b)] = min(a, b)
    nodes = [x for x in root if find(x) != x]
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([find(x) for x in nodes], pa.int64())], ["a", "b"])


def _with_least(rows: DataFrame, of: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """rows (u, v) with m, the least v of their u in `of` (rows themselves by default), and (u, m) alone. A
    hub's rows are dealt by u and one of SPLITS shares of v, in the sums as in the join, so that no task
    has them all; what a hub has in common is one row for each share."""
    share = F.pmod(F.xxhash64("v"), F.lit(SPLITS)).cast("int").alias("share")
    split = (rows if of is None else of).select("u", "v", share)
    least = split.groupBy("u", "share").agg(F.min("v").alias("m")).groupBy("u").agg(F.min("m").alias("m"), F.collect_list("share").alias("shares"))
    each = least.select("u", "m", F.explode("shares").alias("share"))
    return rows.select("u", "v", share).join(each, ["u", "share"]).select("u", "v", "m"), least.select("u", "m")


def components(links: DataFrame, joined: bool = False) -> DataFrame:
    """(node, component) of every node in links (a, b), both long: the smallest node reachable. Nodes that
    are their own component may be left out. Rounds of large and small stars, each stored, until nothing
    changes; a hub's rows are dealt in shares. joined: each task's links have been through _local_union, in
    the worker that made them; a second worker beside it would keep its memory for the stages to come."""
    links = links.select("a", "b").where("a <> b")
    edges = stored((links if joined else links.mapInArrow(_local_union, "a long, b long")).distinct(), "edges")
    before = None
    while True:
        both = edges.union(edges.select(F.col("b"), F.col("a"))).toDF("u", "v")
        larger, _ = _with_least(both.where("v > u"), both)
        large = stored(larger.select(F.col("v").alias("a"), F.least("m", "u").alias("b")).where("a <> b").distinct(), "edges")
        # Small star: each node's smaller neighbours and itself go to the smallest of them.
        down = large.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        smaller, lowest = _with_least(down)
        small = smaller.select(F.col("v").alias("a"), F.col("m").alias("b")).union(lowest).where("a <> b").distinct()
        after = stored(small, "edges")
        now = after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        drop_stored(edges, large)
        edges = after
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
        before = now


def _band_edges(signed: DataFrame, parts: int) -> DataFrame:
    """(a, b): documents that equal bands join, each with the smallest that it reaches in its task. signed:
    (node, bands)."""

    def first_of_runs(hashes: np.ndarray, nodes: np.ndarray):
        """Sorted hashes once each with their smallest node, and (node, smallest) of the others."""
        order = np.lexsort((nodes, hashes))
        hashes, nodes = hashes[order], nodes[order]
        first = np.r_[True, hashes[1:] != hashes[:-1]] if len(hashes) else np.zeros(0, bool)
        least = nodes[first][np.cumsum(first) - 1] if len(hashes) else nodes
        edges = np.unique(np.stack([nodes, least])[:, ~first & (nodes != least)], axis=1)
        return hashes[first], nodes[first], edges

    def send(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            blobs = batch.column("bands").to_pylist()
            hashes = np.frombuffer(b"".join(blobs), np.uint64)
            nodes = np.repeat(batch.column("node").to_numpy(), [len(b) // 8 for b in blobs])
            hashes, nodes, edges = first_of_runs(hashes, nodes)
            bounds = np.searchsorted(hashes, np.array([(k << 64) // parts for k in range(parts)], np.uint64))
            cuts = list(zip(range(parts), bounds, [*bounds[1:], len(hashes)]))
            rows = [(k, 0, hashes[i:j].tobytes(), nodes[i:j].tobytes()) for k, i, j in cuts if j > i]
            rows += [(int(edges[0][0]) % parts, 1, edges[0].tobytes(), edges[1].tobytes())] if edges.size else []
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.binary(), pa.binary()))], ["part", "kind", "x", "y"])

    def meet(batches):
        held: dict[int, list] = {}
        for batch in batches:
            for part, kind, x, y in zip(*(c.to_pylist() for c in batch.columns)):
                y = np.frombuffer(y, np.int64)
                if kind:
                    yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(x, np.int64)), pa.array(y)], ["a", "b"])
                else:
                    held.setdefault(part, []).append((np.frombuffer(x, np.uint64), y))
        for own in held.values():
            _, _, edges = first_of_runs(np.concatenate([x for x, _ in own]), np.concatenate([y for _, y in own]))
            yield pa.RecordBatch.from_arrays([pa.array(edges[0]), pa.array(edges[1])], ["a", "b"])

    return signed.select("node", "bands").mapInArrow(send, "part int, kind int, x binary, y binary").repartition(parts, "part").mapInArrow(lambda batches: _local_union(meet(batches)), "a long, b long")


def forest(nodes: np.ndarray, sets: list[np.ndarray], percent: int, columns: int = 4096) -> np.ndarray:
    """(node, smallest node that it reaches here) of the nodes that links join to a smaller one."""
    n = len(nodes)
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(n), sizes)
    _, at, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count > 1
    at, owner = (np.cumsum(shared) - 1)[at][shared[at]], owner[shared[at]]
    both = np.zeros((n, n), np.float32)  # exact: no set has 2^24 shingles of one slice of columns
    for c in range(0, int(shared.sum()), columns):
        own = (at >= c) & (at < c + columns)
        x = np.zeros((n, columns), np.float32)
        x[owner[own], at[own] - c] = 1
        both += x @ x.T
    linked = 100 * both.astype(np.float64) >= percent * (sizes[:, None] + sizes[None, :] - both)
    linked |= nodes[:, None] == nodes[None, :]
    label = nodes.copy()
    while True:
        least = np.where(linked, label[None, :], np.iinfo(np.int64).max).min(axis=1)
        if (least == label).all():
            moved = label != nodes
            return np.stack([nodes[moved], label[moved]])
        label = least


def _links(texts: DataFrame, units: DataFrame, n: int, percent: int, parts: int, block: int = 512) -> DataFrame:
    """Verified links inside units (node, unit), as forests (a, b). A unit of k blocks makes a group of
    rows for each pair of them, at most 2 * block texts or so."""
    sizes = units.groupBy("unit").agg(F.ceil(F.count("*") / block).cast("int").alias("k"))
    placed = units.join(sizes, "unit").withColumn("block", F.pmod(F.xxhash64("node"), F.col("k")).cast("int"))
    # The same plan for every size: both sides are dealt by node, whatever their size.
    own = texts.join(placed.hint("shuffle_hash"), "node").select(F.struct("node", "unit", "k", "block").alias("key"), "text")

    def kernel(part: pa.RecordBatch) -> dict:
        return {"shingles": pa.array([shingles(t, n)[0].tobytes() for t in raw(part, "text")], pa.binary())}

    sets = map_texts(own, "key", "text", "shingles binary", kernel)
    other = sets.select("key", "shingles", F.explode(F.sequence(F.lit(0), F.col("key.k") - 1)).alias("other"))
    rows = other.select("key.unit", F.least("key.block", "other").alias("i"), F.greatest("key.block", "other").alias("j"), "key.node", "shingles")
    rows = rows.repartition(parts, "unit", "i", "j").sortWithinPartitions("unit", "i", "j")

    def verify(batches):
        now, nodes, sets_ = None, [], []

        def done():
            if len(nodes) < 2:
                return []
            a, b = forest(np.array(nodes, np.int64), [np.frombuffer(s, np.uint64) for s in sets_], percent)
            return [pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])] if len(a) else []

        for batch in batches:
            for unit, i, j, node, blob in zip(*(c.to_pylist() for c in batch.columns)):
                if (unit, i, j) != now:
                    yield from done()
                    now, nodes, sets_ = (unit, i, j), [], []
                nodes.append(node)
                sets_.append(blob)
        yield from done()

    return rows.mapInArrow(verify, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 80, bands: int = 90, rows: int = 8) -> DataFrame:
    """For each row of docs: id_col (a whole number), n_shingles (size of its set of n-word shingles),
    component_id (smallest id that it reaches by links of at least percent % Jaccard similarity) and kept
    (id_col = component_id).

    With 90 bands of 8 values, a pair at exactly 80 % shares no band with probability 6.5e-8. A null
    or empty text has no shingles and is its own component; rows that share an id are one node; a null id
    has a null component and is kept. Ties don't arise: ids order everything. Other columns are ignored.
    """
    docs = docs.select(F.col(f"`{id_col}`").cast("long").alias("node"), F.col(f"`{text_col}`").cast("string").alias("text"))
    signed = stored(_signed(docs, "node", "text", n, bands, rows), "signatures")
    some = signed.where("words is not null and node is not null")
    copies = stored(some.groupBy("words").agg(F.min("node").alias("rep"), F.max("node").alias("last")).where("last > rep").select("words", "rep"), "copies")
    every = stored(some.select("words", "node").join(copies, "words").where("node <> rep").distinct(), "folded")
    # An id with several texts keeps its others; its folds are links like those that are found by comparing.
    several = stored(some.groupBy("node").agg(F.min("words").alias("least"), F.max("words").alias("most")).where("least <> most").select("node"), "several")
    folded = every.join(several, "node", "left_anti").select("node", "rep")
    folds = every.join(several, "node", "left_semi").select(F.col("node").alias("a"), F.col("rep").alias("b"))

    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    candidates = components(_band_edges(some.join(every, ["node", "words"], "left_anti"), parts), joined=True)
    units = candidates.toDF("node", "unit")
    units = stored(units.union(units.select("unit", "unit").distinct()), "units")
    found = components(stored(_links(docs, units, n, percent, parts), "links").union(folds))

    out = signed.select("node", "n_shingles").join(folded, "node", "left").withColumn("text_node", F.coalesce("rep", "node"))
    out = out.join(found.select(F.col("node").alias("text_node"), "component"), "text_node", "left")
    component = F.coalesce("component", "text_node")
    return out.select(F.col("node").alias(id_col), "n_shingles", component.alias("component_id"), F.col("node").eqNullSafe(component).alias("kept"))


def brute_force(docs: list[tuple], n: int = 4, percent: int = 80) -> list[tuple]:
    """(id, n_shingles, component, kept) from all pairs, for tests."""
    sets = {}
    for key, text in docs:
        w = (text or "").encode().translate(_LOWER).split()
        sets[key] = {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()
    root = {k: k for k in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    keys = sorted(sets, key=lambda k: len(sets[k]))
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if percent * len(sets[b]) > 100 * len(sets[a]):
                break
            if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return sorted((k, len(sets[k]), find(k), find(k) == k) for k in sets)
