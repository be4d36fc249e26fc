"""Benchmark decontamination by a distributed positional inverted index.

The index is dealt by document: a segment holds some megabytes of documents, its terms, and for each term
the sorted positions (postings) where it stands in the segment. Segments are rows of a table in the shared
folder. A phrase is found in a segment by taking the postings of its rarest term, adjusted by the term's
offset in the phrase, and intersecting them with the offset-adjusted postings of the next rarer terms.
Building and searching need no shuffle, and a task holds one segment at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.llm.common import bounded_batches, drop_stored, raw, release, slices, stored, using

#: Bytes of text in a segment, and of query text that is broadcast at a time.
SEGMENT_BYTES, BLOCK_BYTES = 2 << 20, 8 << 20

#: Lower-cases A-Z and blanks what isn't a digit, a letter or beyond ASCII.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


@dataclass
class Segment:
    """Postings of some documents. keys[i] = term * size + position, sorted."""

    starts: np.ndarray  # first position of each document, and the end
    terms: list[bytes]
    bounds: np.ndarray  # first posting of each term, and the end
    positions: np.ndarray
    _index: dict[bytes, int] | None = field(default=None, repr=False)
    _keys: np.ndarray | None = field(default=None, repr=False)

    @classmethod
    def build(cls, texts: list[bytes]) -> Segment:
        number: dict[bytes, int] = {}
        ids, lens = [], []
        for t in texts:
            w = words(t)
            lens.append(len(w))
            ids += [number.setdefault(x, len(number)) for x in w]
        n = len(ids)
        keys = np.sort(np.array(ids, np.uint64) * np.uint64(max(n, 1)) + np.arange(n, dtype=np.uint64))
        counts = np.bincount(np.array(ids, np.int64), minlength=len(number))
        return cls(np.cumsum([0, *lens]), list(number), np.r_[0, np.cumsum(counts)].astype(np.int64), (keys % np.uint64(max(n, 1))).astype(np.uint32))

    @property
    def size(self) -> int:
        return int(self.starts[-1])

    def term(self, word: bytes) -> int:
        if self._index is None:
            self._index = {t: i for i, t in enumerate(self.terms)}
        return self._index.get(word, -1)

    def postings(self, term: int) -> np.ndarray:
        return self.positions[self.bounds[term] : self.bounds[term + 1]]

    def holds(self, terms: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Whether each (term, position) is a posting."""
        if self._keys is None:
            self._keys = np.repeat(np.arange(len(self.terms), dtype=np.uint64), np.diff(self.bounds)) * np.uint64(self.size) + self.positions
        want = terms.astype(np.uint64) * np.uint64(self.size) + at.astype(np.uint64)
        i = np.minimum(np.searchsorted(self._keys, want), len(self._keys) - 1)
        return self._keys[i] == want

    def document(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, at, side="right") - 1

    def phrases(self, queries: Queries) -> tuple[np.ndarray, np.ndarray]:
        """(query, start) of every exact occurrence."""
        if not self.size:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        local = np.array([self.term(w) for w in queries.vocabulary] + [-1], np.int64)
        found_q, found_s = [], []
        counts = np.r_[np.diff(self.bounds), 0]
        for length, rows in queries.by_length.items():
            terms = local[queries.terms[rows, :length]]
            live = (terms >= 0).all(axis=1)
            rows, terms = rows[live], terms[live]
            if not len(rows):
                continue
            order = np.argsort(counts[terms], axis=1, kind="stable")  # rarest first
            rare = np.take_along_axis(terms, order[:, :1], 1)[:, 0]
            n = counts[rare]
            which = np.repeat(np.arange(len(rows)), n)
            step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            start = self.positions[self.bounds[rare][which] + step].astype(np.int64) - order[which, 0]
            ok = (start >= 0) & (start + length <= self.size)
            which, start = which[ok], start[ok]
            ok = self.document(start) == self.document(start + length - 1)
            which, start = which[ok], start[ok]
            for k in range(1, length):
                if not len(start):
                    break
                offset = order[which, k]
                ok = self.holds(terms[which, offset], start + offset)
                which, start = which[ok], start[ok]
            found_q.append(rows[which])
            found_s.append(start)
        join = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
        return join(found_q), join(found_s)

    def near(self, terms: list[bytes], within: int) -> np.ndarray:
        """Starts of runs of at most `within` words of one document that begin at one of the terms and
        hold them all; the postings of the rarest term bound the candidates."""
        local = [self.term(t) for t in dict.fromkeys(terms)]
        if not local or min(local) < 0:
            return np.zeros(0, np.int64)
        lists = sorted((self.postings(t).astype(np.int64) for t in local), key=len)
        rare, starts = lists[0], []
        for own in lists:  # left ends no further than `within` before a posting of the rarest term
            i = np.searchsorted(rare, own)
            ok = i < len(rare)
            own, i = own[ok], i[ok]
            starts.append(own[rare[i] - own < within])
        start = np.unique(np.concatenate(starts))
        for own in lists:
            i = np.searchsorted(own, start)
            ok = i < len(own)
            start, i = start[ok], i[ok]
            ok = (own[i] - start < within) & (self.document(own[i]) == self.document(start))
            start = start[ok]
        return start

    def row(self, keys: pa.Array) -> pa.RecordBatch:
        keys = keys.combine_chunks() if isinstance(keys, pa.ChunkedArray) else keys
        listed = pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys)
        blobs = [self.starts.astype("<i8").tobytes(), b"\n".join(self.terms), self.bounds.astype("<i8").tobytes(), self.positions.astype("<u4").tobytes()]
        return pa.RecordBatch.from_arrays([listed, *(pa.array([b], pa.large_binary() if len(b) >> 31 else pa.binary()) for b in blobs)], ["keys", "starts", "terms", "bounds", "positions"])

    @classmethod
    def of_row(cls, row: dict) -> Segment:
        terms = row["terms"].split(b"\n") if row["terms"] else []
        return cls(np.frombuffer(row["starts"], "<i8"), terms, np.frombuffer(row["bounds"], "<i8"), np.frombuffer(row["positions"], "<u4"))


@dataclass
class Queries:
    """Phrases over a vocabulary; items[q] are the items that phrase q stands in."""

    vocabulary: list[bytes]
    terms: np.ndarray
    by_length: dict[int, np.ndarray]
    items: list[list[str]]

    @classmethod
    def build(cls, phrases: dict[tuple[bytes, ...], list[str]]) -> Queries:
        number: dict[bytes, int] = {}
        width = max(map(len, phrases), default=1)
        terms = np.full((len(phrases), width), -1, np.int64)
        lengths = np.array([len(p) for p in phrases], np.int64)
        for q, p in enumerate(phrases):
            terms[q, : len(p)] = [number.setdefault(w, len(number)) for w in p]
        return cls(list(number), terms, {int(n): np.flatnonzero(lengths == n) for n in np.unique(lengths)}, list(phrases.values()))


def windows(text: bytes, n: int) -> set[tuple[bytes, ...]]:
    """Runs of n words; a text of fewer words, but not none, is one window."""
    w = words(text)
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def query_blocks(items: DataFrame, id_col: str, text_col: str, n: int, block_bytes: int = BLOCK_BYTES) -> Iterator[Queries]:
    """The items' windows in blocks of bounded size; the driver holds one block."""
    phrases: dict[tuple[bytes, ...], list[str]] = {}
    size = 0
    rows = items.select(F.col(f"`{id_col}`").cast("string").alias("item"), F.col(f"`{text_col}`").cast("string").alias("text")).where("text is not null")
    for r in rows.toLocalIterator():
        own, item = windows(r["text"].encode(), n), "null" if r["item"] is None else r["item"]
        for w in own:
            phrases.setdefault(w, []).append(item)
        size += len(r["text"])
        if size >= block_bytes:
            yield Queries.build(phrases)
            phrases, size = {}, 0
    yield Queries.build(phrases)


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """Write the postings of every word of every whole text; a row for each segment. A null or empty text
    has no words, but its key is kept; rows that share a key, null ones too, each stand for themselves; an
    empty table makes an index without rows; other columns are ignored."""
    bounded_batches(docs.sparkSession)
    key_type = dict(docs.dtypes)[id_col]
    narrow = docs.select(F.col(f"`{id_col}`").alias("key"), F.col(f"`{text_col}`").cast("string").alias("text"))

    def run(batches):
        using(__name__)
        for batch in batches:
            for part in slices(batch, "text", segment_bytes):
                yield Segment.build(raw(part, "text")).row(part.column("key"))
        release()

    return stored(narrow.mapInArrow(run, f"keys array<{key_type}>, starts binary, terms binary, bounds binary, positions binary"), "segments")


def _hits(row: dict, queries: Queries) -> tuple[Segment, np.ndarray, set[tuple[int, str]]]:
    """A row's segment, whether each word of it is hit, and (document, item), with what the row holds of
    earlier blocks."""
    segment = Segment.of_row(row)
    q, start = segment.phrases(queries)
    hit, pairs = np.zeros(segment.size, bool), set()
    if len(q):
        lengths = (queries.terms >= 0).sum(axis=1)[q]
        cover = np.bincount(start, minlength=segment.size + 1) - np.bincount(start + lengths, minlength=segment.size + 1)
        hit = np.cumsum(cover)[: segment.size] > 0
        pairs = {(d, item) for d, w in set(zip(segment.document(start).tolist(), q.tolist())) for item in queries.items[w]}
    if "hit" in row:
        hit |= np.unpackbits(np.frombuffer(row["hit"], np.uint8))[: segment.size].astype(bool)
        pairs |= {(p["d"], p["item"]) for p in row["pairs"]}
    return segment, hit, pairs


def _rows(batches) -> Iterator[tuple[pa.RecordBatch, dict]]:
    """Segments one by one, each with its columns but the keys."""
    using(__name__)
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1), {c: batch.column(c)[i].as_py() for c in batch.schema.names if c != "keys"}
    release()


def _searched(index: DataFrame, queries: Queries) -> DataFrame:
    """The index with what has been found so far: a bit for each word that is hit, and (document, item)."""
    shared = index.sparkSession.sparkContext.broadcast(queries)

    def run(batches):
        for own, row in _rows(batches):
            _, hit, pairs = _hits(row, shared.value)
            out = [pa.array([np.packbits(hit).tobytes()], pa.binary()), pa.array([[{"d": d, "item": x} for d, x in sorted(pairs)]], pa.list_(pa.struct([("d", pa.int64()), ("item", pa.string())])))]
            yield pa.RecordBatch.from_arrays([*(own.column(c) for c in ("keys", "starts", "terms", "bounds", "positions")), *out], ["keys", "starts", "terms", "bounds", "positions", "hit", "pairs"])

    base = [f for f in index.schema.fields if f.name not in ("hit", "pairs")]
    from pyspark.sql.types import StructType, _parse_datatype_string

    return index.mapInArrow(run, StructType([*base, *_parse_datatype_string("hit binary, pairs array<struct<d: long, item: string>>").fields]))


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", n: int = 13, share: int = 20, index: DataFrame | None = None) -> DataFrame:
    """For each document: n_words, n_hit (words inside any occurrence of an item's window), n_items and
    items (sorted ids of items with occurring windows), contaminated (n_hit > 0 and share * n_hit >=
    n_words).

    Null and empty texts have no words; repeated documents each get a row; a null item id is "null";
    items without words and an empty table of either kind hit nothing. Further columns are ignored. Items
    are searched in blocks of bounded size, each against the whole index.
    """
    found = build_index(docs, id_col, text_col) if index is None else index
    last = None
    for block in query_blocks(items, item_col, item_text_col, n):
        if last is not None:  # more than one block: what has been found so far is stored
            before, found = found, stored(_searched(found, last), "found")
            if before is not index:
                drop_stored(before)
        last = block
    key_type = dict(docs.dtypes)[id_col]
    shared = docs.sparkSession.sparkContext.broadcast(last)

    def run(batches):
        """The last block's search, and the verdicts in the same worker."""
        for batch, row in _rows(batches):
            segment, hit, pairs = _hits(row, shared.value)
            keys = batch.column("keys")[0].values
            sums = np.r_[0, np.cumsum(hit, dtype=np.int64)]
            n_hit, n_words = sums[segment.starts[1:]] - sums[segment.starts[:-1]], np.diff(segment.starts)
            own: list[list[str]] = [[] for _ in range(len(keys))]
            for d, item in sorted(pairs):
                own[d].append(item)
            yield pa.RecordBatch.from_arrays([keys, pa.array(n_words), pa.array(n_hit), pa.array([len(x) for x in own], pa.int64()), pa.array(own, pa.list_(pa.string())), pa.array((n_hit > 0) & (share * n_hit >= n_words))], ["key", "n_words", "n_hit", "n_items", "items", "contaminated"])

    return found.mapInArrow(run, f"key {key_type}, n_words long, n_hit long, n_items long, items array<string>, contaminated boolean").withColumnRenamed("key", id_col)


def near_matches(index: DataFrame, terms: str, within: int) -> DataFrame:
    """Proximity: documents in which some run of at most `within` words holds all words of `terms`, with
    the number of words at which such a run begins. No words find nothing, a repeated word counts once, and
    documents that hold no such run, as those without words, give no row."""
    wanted = words(terms.encode())
    key_type = index.schema["keys"].dataType.elementType.simpleString()

    def run(batches):
        for batch in batches:
            for i, row in enumerate(batch.select(["starts", "terms", "bounds", "positions"]).to_pylist()):
                segment = Segment.of_row(row)
                doc, n = np.unique(segment.document(segment.near(wanted, within)), return_counts=True)
                yield pa.RecordBatch.from_arrays([batch.column("keys")[i].values.take(pa.array(doc)), pa.array(n.astype(np.int64))], ["key", "n_starts"])

    return index.mapInArrow(run, f"key {key_type}, n_starts long")


def items_digest(col: str) -> F.Column:
    return F.sha2(F.concat_ws(",", F.col(col)).cast("binary"), 256)


def brute_force(docs: list[tuple], items: list[tuple], n: int = 13, share: int = 20) -> list[tuple]:
    """The same by scanning all windows, for tests: (id, n_words, n_hit, n_items, digest, contaminated)."""
    sought: dict[tuple[bytes, ...], set[str]] = {}
    for item, text in items:
        for w in windows((text or "").encode(), n):
            sought.setdefault(w, set()).add(str(item))
    sizes, out = {len(w) for w in sought}, []
    for key, text in docs:
        w = words((text or "").encode())
        hit, got = set(), set()
        for size in sizes:
            for i in range(len(w) - size + 1):
                if (x := tuple(w[i : i + size])) in sought:
                    hit.update(range(i, i + size))
                    got |= sought[x]
        out.append((key, len(w), len(hit), len(got), hashlib.sha256(",".join(sorted(got)).encode()).hexdigest(), len(hit) > 0 and share * len(hit) >= len(w)))
    return out
