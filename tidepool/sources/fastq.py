"""FASTQ: a data source with one partition for each file, and a writer.

Files are read through pyarrow's file systems, so any URI that it knows will do; whether a file is
compressed is told by its first bytes and not by its name. A partition is read record by record.
"""

from __future__ import annotations

import gzip
import os
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

SCHEMA = "sample string, mate int, rec bigint, id string, seq string, qual string"
_BATCH = 4096


class FileReads(InputPartition):
    def __init__(self, path: str, sample: str, mate: int):
        super().__init__(path)
        self.path, self.sample, self.mate = path, sample, mate


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and its name there."""
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), os.path.abspath(path))


def open_plain(path: str):
    """A byte stream of a file, decompressed if it is gzip."""
    fs, name = file_system(path)
    with fs.open_input_stream(name, compression=None) as f:
        packed = f.read(2) == b"\x1f\x8b"
    stream = fs.open_input_stream(name, compression=None)
    return gzip.GzipFile(fileobj=stream) if packed else stream


def lines(path: str) -> Iterator[bytes]:
    with open_plain(path) as f:
        rest = b""
        while chunk := f.read(1 << 20):
            *whole, rest = (rest + chunk).split(b"\n")
            yield from whole
        if rest:
            yield rest


def records(path: str) -> Iterator[tuple[str, str, str]]:
    """(id, sequence, quality) of a FASTQ file, four lines a record; the id ends at white space."""
    source = (x.rstrip(b"\r") for x in lines(path))
    for head in source:
        if not head.strip():
            continue
        if head[:1] != b"@":
            raise ValueError(f"{path}: a record must begin with '@', found {head[:20]!r}")
        seq, plus, qual = next(source, None), next(source, None), next(source, b"")
        if seq is None or plus is None or plus[:1] != b"+":
            raise ValueError(f"{path}: record {head[1:].decode()!r} is cut short")
        if len(qual) != len(seq):
            raise ValueError(f"{path}: record {head[1:].decode()!r} has {len(seq)} bases and {len(qual)} qualities")
        yield (head[1:].split() or [b""])[0].decode(), seq.decode(), qual.decode()


class Reader(DataSourceReader):
    def __init__(self, options):
        self.paths = [p for p in options.get("paths", options.get("path", "")).split("\n") if p]
        self.samples = [s for s in options.get("samples", "").split("\n") if s]
        self.mate, self.most = int(options.get("mate", 1)), int(options.get("maxRecordsPerFile", 0))

    def partitions(self):
        return [FileReads(p, self.samples[i] if i < len(self.samples) else stem(p), self.mate) for i, p in enumerate(self.paths)]

    def read(self, part: FileReads):
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        held: list[tuple] = []
        for rec, (id_, seq, qual) in enumerate(records(part.path)):
            if self.most and rec >= self.most:
                break
            held.append((rec, id_, seq, qual))
            if len(held) == _BATCH:
                yield _batch(part, held, names)
                held = []
        if held:
            yield _batch(part, held, names)


def _batch(part: FileReads, held: list[tuple], names: list[str]) -> pa.RecordBatch:
    rec, id_, seq, qual = zip(*held)
    n = len(held)
    return pa.RecordBatch.from_arrays([pa.array([part.sample] * n), pa.array([part.mate] * n, pa.int32()), pa.array(rec, pa.int64()), *(pa.array(x, pa.string()) for x in (id_, seq, qual))], names)


class FastqSource(DataSource):
    @classmethod
    def name(cls):
        return "fastq"

    def schema(self):
        return SCHEMA

    def reader(self, schema: StructType):
        return Reader(self.options)


def stem(path: str) -> str:
    name = path.rstrip("/").rsplit("/", 1)[-1]
    for end in (".gz", ".fastq", ".fq"):
        name = name.removesuffix(end)
    return name


def listed(path: str, ends: tuple[str, ...] = (".fastq", ".fastq.gz", ".fq", ".fq.gz")) -> list[str]:
    """A file, or a folder's files of the kind and the part files that Spark wrote there, in order of their
    names; in any file system that pyarrow knows."""
    fs, name = file_system(path)
    if fs.get_file_info(name).type != pafs.FileType.Directory:
        return [path]
    found = [f for f in fs.get_file_info(pafs.FileSelector(name)) if f.type == pafs.FileType.File and (f.base_name.endswith(ends) or f.base_name.startswith("part-"))]
    return [f"{path.rstrip('/')}/{n}" for n in sorted(f.base_name for f in found)]


def read_fastq(spark: SparkSession, paths: str | list[str], samples: list[str] | None = None, mate: int = 1, n: int = 0) -> DataFrame:
    """reads(sample, mate, rec, id, seq, qual); rec is the record's place in its file. n > 0 stops each
    file's reading after n records. samples default to the files' stems."""
    spark.dataSource.register(FastqSource)
    files = [f for p in ([paths] if isinstance(paths, str) else paths) for f in listed(p)]
    return spark.read.format("fastq").options(paths="\n".join(files), samples="\n".join(samples or []), mate=mate, maxRecordsPerFile=n).load()


def fastq_lines(reads: DataFrame) -> Column:
    """The four lines of a record; only the id is written to the first."""
    return F.concat_ws("\n", F.concat(F.lit("@"), F.col("id")), F.col("seq"), F.lit("+"), F.col("qual"))


def write_fastq(reads: DataFrame, path: str, compression: str = "none") -> None:
    """A folder of FASTQ part files, plain or gzip, in the order of rec within each part."""
    reads.sortWithinPartitions("rec").select(fastq_lines(reads).alias("value")).write.mode("overwrite").option("compression", compression).text(path)


def per_file(n: int, files: int, least: int) -> int:
    """Reads to take of each file so that n come together, but `least` at least of each."""
    return max(n // files, least) if files else n
