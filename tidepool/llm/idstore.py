"""Token-id files with a minimal perfect hash index.

Layout of a store (a folder in the file system of its URI):
  shard-NNNNNN.ids   raw little-endian ids (16 or 32 bits wide), documents in ascending key order
  index-NNNNN.mph    index of one bucket of keys: minimal perfect hash, then for each of its slots the
                     stored fingerprint, shard, offset in ids and length, then the further documents of
                     repeated keys
  manifest.json      width, numbers of shards and buckets, and the ids before each shard
A key's 128-bit hash gives its bucket, its slot and its fingerprint. Bit arrays are stored with the rank of
each of their words beside it, so a lookup reads the file's head, one word at each level that it tries (two
on average) and one record, whatever the number of documents.
"""

from __future__ import annotations

import io
import json
import uuid
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tidepool.llm.bpe import byte_alphabet
from tidepool.llm.common import CACHES, new_path, slices, stored, strings, using

GAMMA, LEVELS, MAGIC = 2.0, 40, b"TPMPH002"
#: Documents that a bucket of the index is made for; a task holds one bucket.
BUCKET_KEYS = 250_000
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def key_hash(key) -> tuple[int, int]:
    """Two 64-bit halves; a null key has one of its own."""
    h = xxhash.xxh3_128_intdigest(b"\0null" if key is None else str(key).encode())
    return h >> 64, h & (1 << 64) - 1


def _mixed(h: np.ndarray, level: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = h + _MIX[0] * np.uint64(level + 1)
        x = (x ^ (x >> np.uint64(30))) * _MIX[1]
        x = (x ^ (x >> np.uint64(27))) * _MIX[2]
        return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Minimal perfect hash over distinct 64-bit hashes: at each level a bit array of GAMMA bits a key
    marks the keys that are alone at their place; the others go on to the next level. A key's slot is the
    rank of its bit."""

    def __init__(self, bits: list[np.ndarray], rest: np.ndarray):
        self.bits, self.rest = bits, rest
        self.before, n = [], 0
        for b in bits:
            ranks = np.zeros(len(b) + 1, np.int64)
            np.cumsum(b, out=ranks[1:])
            self.before.append(ranks[:-1] + n)
            n += int(ranks[-1])
        self.base = n

    @classmethod
    def build(cls, hashes: np.ndarray) -> PerfectHash:
        left, bits = hashes, []
        for level in range(LEVELS):
            if not len(left):
                break
            size = max(64, int(GAMMA * len(left)))
            at = (_mixed(left, level) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            bits.append(alone)
            left = left[~alone[at]]
        return cls(bits, np.sort(left))

    def slots(self, hashes: np.ndarray) -> np.ndarray:
        """Slot of each hash; of a hash that wasn't built in, any slot or -1."""
        out, left = np.full(len(hashes), -1, np.int64), np.arange(len(hashes))
        for level, (b, before) in enumerate(zip(self.bits, self.before)):
            at = (_mixed(hashes[left], level) % np.uint64(len(b))).astype(np.int64)
            hit = b[at]
            out[left[hit]] = before[at[hit]]
            left = left[~hit]
            if not len(left):
                return out
        if len(self.rest):
            i = np.minimum(np.searchsorted(self.rest, hashes[left]), len(self.rest) - 1)
            ok = self.rest[i] == hashes[left]
            out[left[ok]] = self.base + i[ok]
        return out

    def dump(self, to) -> None:
        """Numbers of levels and of the rest, sizes of the levels; for each level its words of 64 bits, each
        after the number of keys before it; the rest."""
        to.write(np.array([len(self.bits), len(self.rest), *map(len, self.bits)], "<i8").tobytes())
        for b, before in zip(self.bits, self.before):
            words = np.zeros((-(-len(b) // 64), 2), "<u8")
            words[:, 0] = before[::64]
            words[:, 1] = np.packbits(np.pad(b, (0, -len(b) % 64)), bitorder="little").view("<u8")
            to.write(words.tobytes())
        to.write(self.rest.astype("<u8").tobytes())

    @classmethod
    def load(cls, data: io.BytesIO) -> PerfectHash:
        n, rest = np.frombuffer(data.read(16), "<i8")
        sizes = np.frombuffer(data.read(8 * int(n)), "<i8")
        bits = []
        for s in sizes.tolist():
            words = np.frombuffer(data.read(16 * -(-s // 64)), "<u8").reshape(-1, 2)
            bits.append(np.unpackbits(np.ascontiguousarray(words[:, 1]).view(np.uint8), bitorder="little")[:s].astype(bool))
        return cls(bits, np.frombuffer(data.read(8 * int(rest)), "<u8"))


class BucketIndex:
    """One index file: slots of the perfect hash hold (fingerprint, shard, offset, length)."""

    RECORD = np.dtype([("print", "<u4"), ("shard", "<i4"), ("offset", "<i8"), ("n", "<i8")])
    #: A further document of the key in a slot.
    MORE = np.dtype([("slot", "<i8"), ("shard", "<i8"), ("offset", "<i8"), ("n", "<i8")])

    def __init__(self, table: PerfectHash, records: np.ndarray, more: np.ndarray):
        self.table, self.records, self.more = table, records, more

    @classmethod
    def build(cls, hi, lo, shard, offset, n) -> BucketIndex:
        """A slot has the first of equal keys in (shard, offset) order, and `more` the others."""
        order = np.lexsort((offset, shard, hi))
        hi, lo, shard, offset, n = (np.asarray(x)[order] for x in (hi, lo, shard, offset, n))
        first = np.r_[True, hi[1:] != hi[:-1]] if len(hi) else np.zeros(0, bool)
        if np.any(~first[1:] & (lo[1:] != lo[:-1])):
            raise ValueError("two keys share a 64-bit hash")
        table, records = PerfectHash.build(hi[first]), np.zeros(int(first.sum()), cls.RECORD)
        at = table.slots(hi)
        for name, x in (("print", (lo & np.uint64(0xFFFFFFFF)).astype("<u4")), ("shard", shard), ("offset", offset), ("n", n)):
            records[name][at[first]] = x[first]
        more = np.zeros(int((~first).sum()), cls.MORE)
        for name, x in (("slot", at), ("shard", shard), ("offset", offset), ("n", n)):
            more[name] = x[~first]
        return cls(table, records, more[np.argsort(more["slot"], kind="stable")])

    def find(self, hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(found, records); a fingerprint that differs means the key isn't there."""
        at = self.table.slots(hi)
        if not len(self.records):
            return np.zeros(len(hi), bool), np.zeros(len(hi), self.RECORD)
        got = self.records[np.maximum(at, 0)]
        return (at >= 0) & (got["print"] == (lo & np.uint64(0xFFFFFFFF)).astype("<u4")), got

    def further(self, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in hi, further documents) of keys that are there."""
        at = self.table.slots(hi)
        lo, up = (np.searchsorted(self.more["slot"], at, side=s) for s in ("left", "right"))
        n = up - lo
        return np.repeat(np.arange(len(hi)), n), self.more[np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]

    def dumps(self) -> bytes:
        to = io.BytesIO()
        to.write(MAGIC)
        to.write(np.array([len(self.records), len(self.more)], "<i8").tobytes())
        self.table.dump(to)
        to.write(self.records.tobytes())
        to.write(self.more.tobytes())
        return to.getvalue()

    @classmethod
    def loads(cls, data: bytes) -> BucketIndex:
        if data[:8] != MAGIC:
            raise ValueError("not an index file")
        stream = io.BytesIO(data[8:])
        n, more = np.frombuffer(stream.read(16), "<i8")
        table = PerfectHash.load(stream)
        return cls(table, np.frombuffer(stream.read(int(n) * cls.RECORD.itemsize), cls.RECORD), np.frombuffer(stream.read(int(more) * cls.MORE.itemsize), cls.MORE))


class BucketFile:
    """One index file that stays where it is: find() reads the words that a key needs. `read` counts bytes."""

    def __init__(self, fs: pafs.FileSystem, path: str):
        self.file, self.read = fs.open_input_file(path), 0
        head = self._at(0, 40 + 8 * LEVELS)
        if head[:8] != MAGIC:
            raise ValueError("not an index file")
        self.keys, _, levels, self.rest = (int(x) for x in np.frombuffer(head, "<i8", 4, 8))
        self.sizes = np.frombuffer(head, "<i8", levels, 40).tolist()
        self.starts = np.cumsum([40 + 8 * levels, *(16 * -(-s // 64) for s in self.sizes)]).tolist()

    def _at(self, offset: int, size: int) -> bytes:
        got = self.file.read_at(size, offset)
        self.read += len(got)
        return got

    def find(self, hi: int, lo: int) -> tuple[int, int, int] | None:
        """(shard, offset, length) of the first document with the key."""
        slot, one = -1, np.array([hi], np.uint64)
        for level, (size, start) in enumerate(zip(self.sizes, self.starts)):
            bit = int(_mixed(one, level)[0] % np.uint64(size))
            before, word = (int(x) for x in np.frombuffer(self._at(start + 16 * (bit // 64), 16), "<u8"))
            if word >> bit % 64 & 1:
                slot = before + (word & (1 << bit % 64) - 1).bit_count()
                break
        else:
            rest = np.frombuffer(self._at(self.starts[-1], 8 * self.rest), "<u8")  # none, but for some 2^-40 of the keys
            i = int(np.searchsorted(rest, one[0])) if len(rest) else 0
            if i < len(rest) and rest[i] == one[0]:
                slot = self.keys - self.rest + i
        if slot < 0:
            return None
        r = np.frombuffer(self._at(self.starts[-1] + 8 * self.rest + BucketIndex.RECORD.itemsize * slot, BucketIndex.RECORD.itemsize), BucketIndex.RECORD)[0]
        return (int(r["shard"]), int(r["offset"]), int(r["n"])) if int(r["print"]) == lo & 0xFFFFFFFF else None


def _open(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def _put(uri: str, name: str, parts: Iterable[bytes]) -> None:
    """Write a file under another name and then rename it: a lost or repeated task leaves no half file."""
    fs, folder = _open(uri)
    fs.create_dir(folder, recursive=True)
    draft = f"{folder}/.{name}-{uuid.uuid4().hex}"
    with fs.open_output_stream(draft) as out:
        for p in parts:
            out.write(p)
    fs.move(draft, f"{folder}/{name}")


def _get(uri: str, name: str) -> bytes:
    fs, folder = _open(uri)
    with fs.open_input_stream(f"{folder}/{name}") as f:
        return f.read()


class WordEncoder:
    """The tokenizers library's ids of whole texts, packed, with a bounded memo.

    Its normalizer and pre-tokenizer work between white space, so the ids of a text are those of its
    blank-separated pieces in order. A plain word goes to the library's model, any other piece to the
    whole library.
    """

    #: Pieces, and words, in each of the two generations of their memos.
    PIECES, WORDS = 400_000, 500_000

    def __init__(self, data: bytes, dtype: str, end_id: int):
        self.lib = Tokenizer.from_str(data.decode())
        self.lib.no_truncation()
        self.lib.no_padding()
        self.tokenize = self.lib.model.tokenize
        self.dtype = np.dtype(dtype)
        self.size, self.code = self.dtype.itemsize, {2: "H", 4: "I"}[self.dtype.itemsize]
        self.end = np.array([end_id], dtype).tobytes()
        self.memo: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.old_words: dict[str, bytes] = {}
        self.signs: dict[str, bytes] = {"": b""}
        # The model sees bytes as characters; Latin letters beyond ASCII are two of them.
        alphabet = byte_alphabet()
        self.as_bytes = {c: "".join(alphabet[b] for b in chr(c).encode()) for c in range(0x80, 0x180)}

    def _alone(self, text: str) -> bytes:
        return np.array(self.lib.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def _sign(self, text: str) -> bytes:
        if (got := self.signs.get(text)) is None:
            if len(self.signs) > 50_000:
                self.signs = {"": b""}
            got = self.signs[text] = self._alone(text)
        return got

    def _word(self, word: str) -> bytes:
        """A lower-case word goes to the library's model straight away."""
        if (got := self.words.get(word)) is None:
            if (got := self.old_words.get(word)) is None:
                got = array(self.code, [t.id for t in self.tokenize(word if word.isascii() else word.translate(self.as_bytes))]).tobytes()
            if len(self.words) >= self.WORDS:
                self.words, self.old_words = {}, self.words
            self.words[word] = got
        return got

    def _learn(self, pieces: set[str]) -> None:
        """A word of Latin letters and the ASCII signs on either side of it are apart for the pre-tokenizer
        too; other pieces go to the library whole."""
        memo = self.memo
        for p in pieces:
            w = p.strip(_SIGNS)
            if w.isalpha() and len(w) < 64 and (w.isascii() or max(w) < "\u0180") and (low := w.lower()).isalpha():
                if len(w) == len(p):
                    memo[p] = self._word(low)
                else:
                    i = p.find(w)
                    memo[p] = self._sign(p[:i]) + self._word(low) + self._sign(p[i + len(w) :])
            else:
                memo[p] = self._alone(p)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Packed ids of each text and the end id. A line's end is white space to the normalizer."""
        split = [t.replace("\n", " ").split(" ") for t in texts]
        new = set().union(*split).difference(self.memo)
        if new:
            if len(self.memo) + len(new) > self.PIECES:
                self.memo, self.old = {}, self.memo
                new = set().union(*split)
            known = {p: v for p in new if (v := self.old.get(p)) is not None}
            self.memo.update(known)
            self._learn(new.difference(known))
        get = self.memo.__getitem__
        return [b"".join(map(get, s)) + self.end for s in split]


# Fixed value: ASCII signs, without the apostrophe and the angle brackets, which have a meaning of their own.
_SIGNS = '!"#$%&()*+,-./:;=?@[\\]^_`{|}~'

_ENCODERS: dict[int, WordEncoder] = {}
CACHES[__name__] = _ENCODERS.clear


def _encoder(data: bytes, dtype: str, end_id: int) -> WordEncoder:
    key = hash((data, dtype, end_id))
    if key not in _ENCODERS:
        _ENCODERS[key] = WordEncoder(data, dtype, end_id)
    return _ENCODERS[key]


def write_ids(df: DataFrame, vocabulary: str, uri: str | None = None, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, shards: int | None = None, buckets: int | None = None) -> str:
    """Encode every whole text with the tokenizers library, append end_id, and write a store; its URI.

    Rows are dealt by ranges of id_col (equal ids by their text's hash, so that one id with very many rows
    is still split) and sorted; a null id comes first. A null text is empty and has the end id only.
    Repeated ids are all written, and the index finds them all. An empty table makes a store without shards.
    Other columns are ignored.
    """
    spark = df.sparkSession
    uri = uri or new_path(spark, "ids")
    with open(vocabulary, "rb") as f:
        data = f.read((64 << 20) + 1)
    if len(data) > 64 << 20:
        raise ValueError("the vocabulary is over 64 MB")
    dtype = "<u2" if max(Tokenizer.from_str(data.decode()).get_vocab_size() - 1, end_id) < 1 << 16 else "<u4"
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shards = shards or parts
    shared = spark.sparkContext.broadcast(data)
    key_type = dict(df.dtypes)[id_col]
    rows = df.select(F.col(f"`{id_col}`").alias("key"), F.col(f"`{text_col}`").cast("string").alias("text"))
    order = [F.col("key").asc_nulls_first(), F.xxhash64("text"), F.col("text")]
    rows = rows.repartitionByRange(shards, *order[:2]).sortWithinPartitions(*order)

    def shard_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        using(__name__)
        shard, at, found = TaskContext.get().partitionId(), 0, []
        encoder = _encoder(shared.value, dtype, end_id)

        def payload():
            nonlocal at
            for batch in batches:
                for part in slices(batch, "text"):
                    packed = encoder.encode(strings(part, "text"))
                    n = [len(p) // encoder.size for p in packed]
                    hashes = np.array([key_hash(k) for k in part.column("key").to_pylist()], np.uint64)
                    ends = np.cumsum([at, *n])
                    found.append((hashes[:, 0], hashes[:, 1], ends[:-1], np.array(n, np.int64)))
                    at = int(ends[-1])
                    yield b"".join(packed)

        stream = payload()
        first = next(stream, None)
        if first is None:
            return
        _put(uri, f"shard-{shard:06d}.ids", (x for y in ((first,), stream) for x in y))
        for hi, lo, offset, n in found:
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(hi), shard, np.int32)), *(pa.array(np.ascontiguousarray(x).view(np.int64)) for x in (hi, lo)), pa.array(offset), pa.array(n)], ["shard", "hi", "lo", "offset", "n"])

    entries = stored(rows.mapInArrow(shard_of, "shard int, hi long, lo long, offset long, n long"), "entries")
    # One row for each shard, a file of ids: the driver keeps the manifest only.
    sizes = entries.groupBy("shard").agg(F.sum("n").alias("ids"), F.count("*").alias("documents")).collect()
    totals = {r["shard"]: r["ids"] for r in sizes}
    buckets = buckets or max(1, -(-sum(r["documents"] for r in sizes) // BUCKET_KEYS))

    def index_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches), None) if (batches := [b for b in batches if b.num_rows]) else None
        for b in table.column("bucket").unique().to_pylist() if table else []:
            own = table.filter(pa.compute.equal(table.column("bucket"), b))
            col = {c: own.column(c).to_numpy() for c in ("hi", "lo", "shard", "offset", "n")}
            index = BucketIndex.build(col["hi"].view(np.uint64), col["lo"].view(np.uint64), col["shard"], col["offset"], col["n"])
            _put(uri, f"index-{b:05d}.mph", [index.dumps()])
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([len(index.records)], pa.int64())], ["bucket", "keys"])

    # The bucket is the upper half of `lo` without its sign, as _bucket has it.
    bucket = F.pmod(F.shiftrightunsigned("lo", 32), F.lit(buckets)).cast("int").alias("bucket")
    made = entries.select("*", bucket).repartition(buckets, "bucket").mapInArrow(index_of, "bucket int, keys long")
    keys = sum(r["keys"] for r in made.collect())
    starts, at = {}, 0
    for s in sorted(totals):
        starts[s] = at
        at += totals[s]
    _put(uri, "manifest.json", [json.dumps({"width": dtype, "shards": starts, "buckets": buckets, "ids": at, "keys": keys, "end_id": end_id}).encode()])
    return uri


def _bucket(lo: np.ndarray, buckets: int) -> np.ndarray:
    return ((lo >> np.uint64(32)) % np.uint64(buckets)).astype(np.int32)


class Store:
    """Keyed access to a store from one process."""

    def __init__(self, uri: str):
        self.uri, self.manifest = uri, json.loads(_get(uri, "manifest.json"))
        self.dtype = np.dtype(self.manifest["width"])
        self.starts = {int(k): v for k, v in self.manifest["shards"].items()}
        self.indexes: dict[int, BucketIndex | None] = {}
        self.files: dict[int, BucketFile | None] = {}

    def index(self, bucket: int) -> BucketIndex | None:
        if bucket not in self.indexes:
            try:
                self.indexes[bucket] = BucketIndex.loads(_get(self.uri, f"index-{bucket:05d}.mph"))
            except FileNotFoundError:
                self.indexes[bucket] = None
        return self.indexes[bucket]

    def find(self, keys: list) -> list[list[tuple[int, int, int]]]:
        """(shard, offset, length) of each key's documents, with whole buckets in memory: for many keys."""
        pairs = np.array([key_hash(k) for k in keys], np.uint64).reshape(-1, 2)
        hi, lo, out = pairs[:, 0], pairs[:, 1], [[] for _ in keys]
        buckets = _bucket(lo, self.manifest["buckets"])
        for b in np.unique(buckets):
            at = np.flatnonzero(buckets == b)
            if (index := self.index(int(b))) is not None:
                ok, got = index.find(hi[at], lo[at])
                for i, r in zip(at[ok], got[ok]):
                    out[i].append((int(r["shard"]), int(r["offset"]), int(r["n"])))
                for i, r in zip(*index.further(hi[at[ok]])):
                    out[at[ok][i]].append((int(r["shard"]), int(r["offset"]), int(r["n"])))
        return out

    def locate(self, key) -> tuple[int, int, int] | None:
        """(shard, offset, length) of the first document with the key, by reading its words of the index."""
        hi, lo = key_hash(key)
        b = int(_bucket(np.array([lo], np.uint64), self.manifest["buckets"])[0])
        if b not in self.files:
            fs, folder = _open(self.uri)
            try:
                self.files[b] = BucketFile(fs, f"{folder}/index-{b:05d}.mph")
            except FileNotFoundError:
                self.files[b] = None
        return self.files[b].find(hi, lo) if self.files[b] else None

    def read(self, spans: Iterable[tuple[int, int, int]]) -> Iterator[np.ndarray]:
        """Ids of (shard, offset, length) spans; the file of a shard stays open for spans in a row."""
        now, f, (fs, folder) = None, None, _open(self.uri)
        for shard, offset, n in spans:
            if shard != now:
                if f:
                    f.close()
                now, f = shard, fs.open_input_file(f"{folder}/shard-{shard:06d}.ids")
            yield np.frombuffer(f.read_at(n * self.dtype.itemsize, offset * self.dtype.itemsize), self.dtype)
        if f:
            f.close()

    def __getitem__(self, key) -> np.ndarray:
        found = self.locate(key)
        if found is None:
            raise KeyError(key)
        return next(self.read([found])).astype(np.int64)


def read_ids(spark: SparkSession, uri: str, keys: DataFrame, id_col: str = "doc_id", ids: bool = False) -> DataFrame:
    """Look every row of `keys` up in a store: id_col, start (ids of all documents before it), n_tokens,
    ids_crc32 (of the ids as little-endian 32-bit) and, with `ids`, the ids, a row for each document with the
    key. Keys that aren't stored, and an empty table, get no row; a repeated key gets its rows again; a null
    key is one like others; other columns are ignored."""
    key_type = dict(keys.dtypes)[id_col]
    manifest = json.loads(_get(uri, "manifest.json"))
    buckets, shards = manifest["buckets"], max(1, len(manifest["shards"]))

    def located(batches):
        for batch in batches:
            lo = np.array([key_hash(k)[1] for k in batch.column(0).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_bucket(lo, buckets))], ["key", "bucket"])

    def found(batches):
        store = Store(uri)
        for batch in batches:
            spans = store.find(batch.column("key").to_pylist())
            kept = batch.column("key").take(pa.array(np.repeat(np.arange(len(spans)), [len(s) for s in spans])))
            got = np.array([x for s in spans for x in s], np.int64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([kept, *(pa.array(got[:, i]) for i in range(3))], ["key", "shard", "offset", "n"])

    def payload(batches):
        store = Store(uri)
        for batch in batches:
            shard, offset, n = (batch.column(c).to_pylist() for c in ("shard", "offset", "n"))
            crc, lists = [], []
            for x in store.read(zip(shard, offset, n)):
                crc.append(zlib.crc32(x.astype("<u4").tobytes()))
                if ids:
                    lists.append(x.astype(np.int32))
            start = [store.starts[s] + o for s, o in zip(shard, offset)]
            arrays = [batch.column("key"), pa.array(start, pa.int64()), pa.array(n, pa.int64()), pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays([*arrays, *([pa.array(lists, pa.list_(pa.int32()))] if ids else [])], ["key", "start", "n_tokens", "ids_crc32", *["ids"] * ids])

    out = keys.select(F.col(f"`{id_col}`").alias("key")).mapInArrow(located, f"key {key_type}, bucket int")
    out = out.repartition(buckets, "bucket").select("key").mapInArrow(found, f"key {key_type}, shard long, offset long, n long")
    # A long shard is read by several tasks: each reads a run of spans.
    run = F.floor(F.col("offset") / F.lit(4_000_000)).alias("run")
    out = out.select("*", run).repartition(max(shards, 1), "shard", "run").sortWithinPartitions("shard", "offset").drop("run")
    return out.mapInArrow(payload, f"key {key_type}, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * ids).withColumnRenamed("key", id_col)
