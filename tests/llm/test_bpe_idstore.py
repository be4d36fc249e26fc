import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from tidepool.llm import idstore
from tidepool.llm.bpe import Decoder, Encoder, Merges, bpe_encode, decoded_parts, pack

BYTE, WORD = P.path("byte_bpe_50k.json"), P.path("word_bpe_49k.json")
PARTS = ["a", "b", "'s", "'re", "'", "  ", " ", "\n", "\t", "é", "ß", "1", "23", "!!", "<|endoftext|>", "<|end", "漢字", "🙂", "́", "​", "\xa0", "\x1c", "\x85", "x" * 50, "the", "ing", " the", "٣", "Ⅷ", "\r\n", "Σ", "İ", "É"]


@pytest.fixture(scope="module")
def merges():
    return Merges(open(BYTE, "rb").read())


@pytest.fixture(scope="module")
def lib():
    return Tokenizer.from_file(BYTE)


def texts(n, seed=1):
    rng = random.Random(seed)
    return ["", *("".join(rng.choice(PARTS) for _ in range(rng.randrange(40))) for _ in range(n))]


@pytest.mark.parametrize("block", [7, 1 << 16])
def test_same_as_library(merges, lib, block):
    encoder = Encoder(merges, block=block)
    for t in texts(600):
        assert encoder.encode(t) == pack(lib.encode(t, add_special_tokens=False).ids), t


@pytest.mark.parametrize("text", ["a" * 5000, "ab" * 4000, " " * 3000 + "x", "\n" * 3000, "é" * 3000, "!?" * 4000, "thethe" * 2000])
def test_long_pieces_stream(merges, lib, text):
    assert Encoder(merges, block=500).encode(text) == pack(lib.encode(text, add_special_tokens=False).ids)


def test_feeding_anywhere_gives_the_same(merges):
    rng, text = random.Random(3), "".join(texts(40, 5))
    encoder, out, at = Encoder(merges, block=64), [], 0
    while at < len(text):
        n = rng.randrange(1, 30)
        out.append(encoder.feed(text[at : at + n]))
        at += n
    assert b"".join([*out, encoder.close()]) == Encoder(merges).encode(text)


def test_lookahead_bounds_change(merges):
    """What stands `lookahead` bytes before the end never changes with what follows."""
    rng = random.Random(9)
    data = "".join(rng.choice("aeithsn") for _ in range(merges.lookahead + 200)).encode()
    stable = len(data) - merges.lookahead

    def before(ids):
        out, end = [], 0
        for i in ids:
            end += len(merges.text[i])
            if end > stable:
                return out
            out.append(i)

    want = before(merges.tokens(data))
    for tail in (b"a", b"ing", b"tion", b"sssss", b"e" * 50):
        assert before(merges.tokens(data + tail)) == want


def test_decoding_any_ids(merges, lib):
    rng = random.Random(4)
    for _ in range(100):
        ids = [rng.randrange(50257) for _ in range(rng.randrange(30))]
        machine = Decoder(merges)
        parts = [machine.feed(pack([i])) for i in ids]
        assert "".join([*parts, machine.close()]) == lib.decode(ids, skip_special_tokens=False)
        assert "".join(decoded_parts(merges, pack(ids), 3)) == lib.decode(ids, skip_special_tokens=False)


def test_operator(spark, lib):
    df = spark.createDataFrame([(1, "hello <|endoftext|>", "x"), (2, None, "x"), (2, None, "y"), (None, "", "z")], "key long, text string, n_tokens string")
    got = bpe_encode(df, BYTE, id_col="key", columns=("ids", "decoded", "ids_sha256", "decoded_sha256")).collect()
    assert len(got) == 4
    r = next(x for x in got if x["key"] == 1)
    want = lib.encode("hello <|endoftext|>", add_special_tokens=False).ids
    assert r["n_tokens"] == len(want) and np.frombuffer(r["ids"], "<u4").tolist() == want and r["decoded"] == "hello <|endoftext|>"
    assert r["ids_sha256"] == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
    assert all(x["n_tokens"] == 0 and x["decoded"] == "" for x in got if x["key"] != 1)
    assert bpe_encode(df.where("false"), BYTE, id_col="key").count() == 0


def test_word_encoder_same_as_library():
    data = open(WORD, "rb").read()
    encoder, lib = idstore.WordEncoder(data, "<u2", 2), Tokenizer.from_str(data.decode())
    encoder.PIECES, encoder.WORDS = 50, 20  # the memos turn over
    for t in texts(600, 2):
        assert encoder.encode([t])[0] == np.array([*lib.encode(t, add_special_tokens=False).ids, 2], "<u2").tobytes(), t


def test_perfect_hash():
    h = np.random.default_rng(0).integers(0, 2**63, 20_000).astype(np.uint64)
    table = idstore.PerfectHash.build(h)
    assert sorted(table.slots(h)) == list(range(len(h)))
    index = idstore.BucketIndex.loads(idstore.BucketIndex.build(h, h, np.zeros(len(h), int), np.arange(len(h)), np.ones(len(h), int)).dumps())
    ok, rows = index.find(h, h)
    assert ok.all() and (rows["offset"] == np.arange(len(h))).all()
    assert not index.find(h + np.uint64(1), h ^ np.uint64(5))[0].any()
    empty = idstore.BucketIndex.build(*(np.zeros(0, np.uint64) for _ in range(2)), *(np.zeros(0, int) for _ in range(3)))
    assert not idstore.BucketIndex.loads(empty.dumps()).find(h[:3], h[:3])[0].any()


@pytest.mark.parametrize("n", [50, 5_000, 200_000])
def test_a_lookup_reads_few_words(tmp_path, n):
    """The head of the file once, then some words for each key, however many keys there are."""
    h = np.random.default_rng(1).integers(0, 2**63, (n + 100, 2)).astype(np.uint64)
    hi, lo = h[:n, 0], h[:n, 1]
    (tmp_path / "index").write_bytes(idstore.BucketIndex.build(hi, lo, np.arange(n) % 7, np.arange(n), np.ones(n, int)).dumps())
    f = idstore.BucketFile(idstore.pafs.LocalFileSystem(), str(tmp_path / "index"))
    head, at = f.read, np.linspace(0, n - 1, 50).astype(int)
    assert head <= 40 + 8 * idstore.LEVELS
    for i in at:
        assert f.find(int(hi[i]), int(lo[i])) == (i % 7, i, 1)
    assert (f.read - head) / len(at) < 24 + 16 * 4
    assert all(f.find(int(a), int(b)) is None for a, b in h[n:])


def test_store(spark):
    rows = [(k, f"word{k} two " * (k % 5)) for k in range(40)] + [(7, "again"), (None, "no key"), (50, None)]
    df = spark.createDataFrame([(k, t, "x") for k, t in rows], "doc_id long, text string, shard string")
    uri = idstore.write_ids(df, WORD, shards=3, buckets=2)
    store, lib = idstore.Store(uri), Tokenizer.from_file(WORD)
    ids = lambda t: [*lib.encode(t or "", add_special_tokens=False).ids, 2]
    assert store[11].tolist() == ids(rows[11][1]) and store[50].tolist() == [2] and store[None].tolist() == ids("no key")
    with pytest.raises(KeyError):
        store[999]
    assert store.manifest["ids"] == sum(len(ids(t)) for _, t in rows) and store.manifest["keys"] == 42
    every = idstore.read_ids(spark, uri, df.select("doc_id").distinct(), ids=True).collect()
    assert len(every) == 43 and sorted(r["ids"] for r in every if r["doc_id"] == 7) == sorted([ids(rows[7][1]), ids("again")])
    starts = sorted((r["start"], r["n_tokens"]) for r in every)
    assert starts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:]))
    got = {r["doc_id"]: r for r in every if r["doc_id"] != 7 or r["ids"] == store[7].tolist()}
    assert len(got) == 42 and got[None]["start"] == 0
    at = len(ids("no key"))
    for k in range(7):
        assert got[k]["start"] == at and got[k]["ids"][-1] == 2
        at += len(ids(rows[k][1]))
    assert got[3]["ids_crc32"] == zlib.crc32(np.array(ids(rows[3][1]), "<u4").tobytes())
    empty = idstore.write_ids(df.where("false"), WORD)
    assert idstore.read_ids(spark, empty, df).count() == 0
