"""Reads that the driver's documents stand for: the letters of every whole text, mapped to bases and cut
into consecutive pieces. Everything is computed from whole numbers, so that SQL can do the same."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.functions.kernels import text_of
from tidepool.functions.sequences import reverse_complement

ALPHABET, AS_BASES = "abcdefghijklmnopqrstuvwxyz", "ACGTACGTACGTACGTACGTACGTAC"
READ, AMPLICON = 60, 100
#: rec = doc_id * PIECES + number of the piece.
PIECES = 1_000_000


def spread(df: DataFrame) -> DataFrame:
    """A table of one small file is one partition; the work on its rows is more than moving them."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df if df.rdd.getNumPartitions() >= n else df.repartition(n)


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "lang", "text"))


def _cut(batch: pa.RecordBatch, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document's row, number of the piece, letters, length) of the pieces of `size` letters of a batch's
    texts, the last one of each shorter."""
    text = pc.utf8_lower(pc.fill_null(batch.column("text"), "")).cast(pa.large_binary())
    ends = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
    data = np.frombuffer(text.buffers()[2], np.uint8)[ends[0] : ends[-1]] if ends[-1] > ends[0] else np.zeros(0, np.uint8)
    is_letter = (data >= 97) & (data <= 122)
    before = np.r_[0, np.cumsum(is_letter)][ends - ends[0]]
    lens = np.diff(before)
    n = -(-lens // size)
    row = np.repeat(np.arange(len(lens)), n)
    k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return row, k, data[is_letter], np.minimum(size, lens[row] - k * size)


def pieces(spark: SparkSession, sf_dir: str, size: int) -> DataFrame:
    """(sample, lang, doc_id, rec, raw): the letters of each text in pieces of `size`, the last one shorter."""

    def run(batches):
        for batch in batches:
            row, k, data, lens = _cut(batch, size)
            doc = batch.column("doc_id").to_numpy()[row]
            source, lang = (batch.column(c).take(pa.array(row)) for c in ("source", "lang"))
            yield pa.RecordBatch.from_arrays([source, lang, pa.array(doc), pa.array(doc * PIECES + k), text_of(data, lens)], ["sample", "lang", "doc_id", "rec", "raw"])

    return _texts(spark, sf_dir).mapInArrow(run, "sample string, lang string, doc_id bigint, rec bigint, raw string")


def bases(raw: Column) -> Column:
    return F.translate(raw, ALPHABET, AS_BASES)


_TO_BASE = np.array([ord(AS_BASES[ALPHABET.index(chr(b))]) if chr(b) in ALPHABET else b for b in range(256)], np.uint8)
_TURNED = np.frombuffer(bytes.maketrans(b"ACGT", b"TGCA"), np.uint8)
_READ = "sample string, mate int, rec bigint, id string, seq string, qual string"


def _rows(samples, mate: int, rec: pa.Array, prefix: str, seqs: pa.Array, quals: pa.Array) -> pa.RecordBatch:
    ids = pc.binary_join_element_wise(prefix, rec.cast(pa.string()), "")
    return pa.RecordBatch.from_arrays([samples, pa.array(np.full(len(rec), mate, np.int32)), rec, ids, seqs, quals], [c.split()[0] for c in _READ.split(", ")])


def _read(spark: SparkSession, sf_dir: str, size: int, first: int, mate: int, offset: int, levels: int) -> DataFrame:
    """Reads of letters [first, first + READ) of the pieces of `size`, turned for mate 2. Of pieces that are
    longer than a read only whole ones count. A base's score is offset + (its letter's code * 7 + its place
    * 3 + doc_id) % levels, places from 1."""

    def run(batches):
        for batch in batches:
            row, k, data, lens = _cut(batch, size)
            start = np.cumsum(lens) - lens + first
            whole = lens == size if size > READ else np.ones(len(lens), bool)
            row, k, start, n = row[whole], k[whole], start[whole], np.clip(lens[whole] - first, 0, READ)
            doc = batch.column("doc_id").to_numpy()[row]
            place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            code = data[np.repeat(start + n - 1, n) - place if mate == 2 else np.repeat(start, n) + place].astype(np.int64)
            score = offset + (code * 7 + (place + 1) * 3 + np.repeat(doc, n)) % levels
            seq = _TO_BASE[code]
            yield _rows(batch.column("source").take(pa.array(row)), mate, pa.array(doc * PIECES + k), "r", text_of(_TURNED[seq] if mate == 2 else seq, n), text_of(score + 33, n))

    return _texts(spark, sf_dir).mapInArrow(run, _READ)


def reads(spark: SparkSession, sf_dir: str, offset: int = 0, levels: int = 41) -> DataFrame:
    """reads(sample, mate, rec, id, seq, qual) of 60 bases."""
    return _read(spark, sf_dir, READ, 0, 1, offset, levels)


def mates(spark: SparkSession, sf_dir: str, offset: int = 20, levels: int = 21) -> tuple[DataFrame, DataFrame]:
    """Both mates of amplicons of 100 bases: the first 60, and the last 60 turned; they share 20."""
    return _read(spark, sf_dir, AMPLICON, 0, 1, offset, levels), _read(spark, sf_dir, AMPLICON, AMPLICON - READ, 2, offset, levels)


def references(spark: SparkSession, sf_dir: str, size: int = 200) -> DataFrame:
    """refs(ref_idx, id, description, seq): the pieces of 200 letters of all documents. The description is a
    lineage made of the document's language, source and id."""
    cut = pieces(spark, sf_dir, size)
    part = lambda letter, m: F.concat(F.lit(f";{letter}"), (F.col("doc_id") % m).cast("string"))
    lineage = F.concat(F.lit("Bacteria;"), F.col("lang"), F.lit(";"), F.col("sample"), part("o", 7), part("f", 11), part("g", 13), part("s", 17))
    return cut.select(F.col("rec").alias("ref_idx"), F.concat(F.lit("ref"), F.col("rec").cast("string")).alias("id"), lineage.alias("description"), bases(F.col("raw")).alias("seq"))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """queries(qid, raw, seq): the letters of each whole benchmark text."""
    raw = F.regexp_replace(F.lower("text"), "[^a-z]", "")
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").alias("qid"), raw.alias("raw")).select("qid", "raw", bases(F.col("raw")).alias("seq"))


def item_windows(spark: SparkSession, sf_dir: str, size: int = READ) -> DataFrame:
    """queries(qid, seq): all runs of 60 letters of the benchmark texts; qid = item_id * 100000 + start."""
    own = items(spark, sf_dir).where(F.length("seq") >= size)
    return own.select("seq", F.col("qid").alias("item"), F.explode(F.sequence(F.lit(0), F.length("seq") - size)).alias("start")).select((F.col("item") * 100_000 + F.col("start")).alias("qid"), F.substring(F.col("seq"), F.col("start") + 1, F.lit(size)).alias("seq"))


#: Upper bounds, of 100, of the part numbers that belong to each template; the last template is a chimera
#: of the first two, cut in the middle.
SHARES = [30, 50, 62, 70, 77, 83, 88, 92, 95, 97, 99, 100]
_FACTOR = 2654435761


def amplicons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """reads(sample, mate, rec, id, seq, qual) of 60 bases, one for each row of lineitem: a template chosen
    by the part, in a sample chosen by the supplier, a quarter of them with one wrong base of low score."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").selectExpr("l_orderkey AS o", "l_linenumber AS n", "l_partkey AS p", "l_suppkey AS s", "CAST(l_quantity AS bigint) AS quantity", "l_partkey % 100 AS share", "concat('s', l_suppkey % 8) AS sample")
    rows = spread(rows)
    template = "CASE " + " ".join(f"WHEN share < {s} THEN {v}" for v, s in enumerate(SHARES)) + " END"
    # Some rows share their order and line; with part, supplier and quantity the record's number is its own.
    rows = rows.selectExpr("sample", "(((o * 8 + n) * 1000000 + p) * 1000 + s) * 64 + quantity AS rec", "o", "(o * 31 + n * 17) % 240 AS wrong", f"{template} AS v")
    i = np.arange(60)
    templates = np.stack([(np.where(v < 11, v, i >= 30).astype(np.int64) + 1) * (i + 1) * _FACTOR // 65536 % 4 for v in range(len(SHARES))])
    letters = np.frombuffer(b"ACGT", np.uint8)

    def run(batches):
        for batch in batches:
            v, o, wrong = (batch.column(c).to_numpy().astype(np.int64) for c in ("v", "o", "wrong"))
            code, score = templates[v], 30 + (i[None] * 7 + o[:, None]) % 8
            bad = np.flatnonzero(wrong < 60)
            code[bad, wrong[bad]] = (code[bad, wrong[bad]] + 1 + o[bad] % 3) % 4
            score[bad, wrong[bad]] = 12
            lens = np.full(len(v), 60)
            yield _rows(batch.column("sample"), 1, batch.column("rec"), "a", text_of(letters[code], lens), text_of(score + 33, lens))

    return rows.mapInArrow(run, _READ)


def amplicon_mates(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The first 40 bases of each amplicon, and its last 40 turned; they share 20."""
    whole = amplicons(spark, sf_dir)
    fwd = whole.withColumns({"seq": F.substring("seq", 1, 40), "qual": F.substring("qual", 1, 40)})
    rev = whole.withColumns({"mate": F.lit(2), "seq": reverse_complement(F.substring("seq", 21, 40)), "qual": F.reverse(F.substring("qual", 21, 40))})
    return fwd, rev
