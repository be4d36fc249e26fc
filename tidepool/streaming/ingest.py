"""FASTQ folders as streams: the per-read operators are the same, dereplication is a running count."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidepool.operators.filtering import FilterConfig, filter_reads
from tidepool.sources.fastq import stem

LINES = "sample string, rec bigint, id string, seq string, qual string"


def read_stream(spark: SparkSession, folder: str, files_per_trigger: int = 16) -> DataFrame:
    """reads(sample, rec, id, seq, qual) of the FASTQ files that come into a folder. A file is one row of
    the stream until it is cut into records, which keeps its order."""
    files = spark.readStream.format("text").option("wholetext", True).option("maxFilesPerTrigger", files_per_trigger).load(folder).withColumn("path", F.col("_metadata.file_path"))

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for text, path in zip(batch.column("value").to_pylist(), batch.column("path").to_pylist()):
                rows = text.splitlines()
                n = len(rows) // 4
                yield pa.RecordBatch.from_arrays([pa.array([stem(path)] * n), pa.array(range(n), pa.int64()), pa.array([(rows[4 * i][1:].split() or [""])[0] for i in range(n)], pa.string()), pa.array(rows[1 : 4 * n : 4], pa.string()), pa.array(rows[3 : 4 * n : 4], pa.string())], ["sample", "rec", "id", "seq", "qual"])

    return files.mapInArrow(run, LINES)


def running_uniques(reads: DataFrame, config: FilterConfig = FilterConfig()) -> DataFrame:
    """(sample, seq, cnt) of all reads that have passed so far."""
    return filter_reads(reads, config).groupBy("sample", "seq").agg(F.count("*").alias("cnt"))


def start(uniques: DataFrame, name: str, checkpoint: str) -> StreamingQuery:
    """Keep the counts in a table in memory; for other sinks use the frame itself."""
    return uniques.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).start()
