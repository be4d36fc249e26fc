"""FASTA references, lineages, and the text forms of variants and tables."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidepool.functions.sequences import hex_key
from tidepool.sources.fastq import lines, listed

LEVELS = ["kingdom", "phylum", "class", "order", "family", "genus", "species"]
REFERENCE = "ref_idx bigint, id string, description string, seq string"


def fasta_records(path: str) -> Iterator[tuple[str, str | None, str]]:
    """(id, description, sequence); the header is cut at its first blank, sequences may be wrapped."""
    head, parts = None, []

    def record():
        id_, blank, text = head.partition(" ")
        return id_, text if blank else None, "".join(parts)

    for raw in lines(path):
        text = raw.decode().rstrip("\r")
        if text.startswith(">"):
            if head is not None:
                yield record()
            head, parts = text[1:], []
        elif head is not None:
            parts.append(text.strip())
        elif text.strip():
            raise ValueError(f"{path}: a sequence before any header")
    if head is not None:
        yield record()


#: Records and letters that a reader hands on at a time.
_RECORDS, _LETTERS = 4096, 8 << 20


def _batches(rows: Iterator[tuple], types: list[pa.DataType], names: list[str]) -> Iterator[pa.RecordBatch]:
    """Batches of bounded size, so that a file is never held as a whole."""
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += len(r[-1] or "")
        if len(held) == _RECORDS or size > _LETTERS:
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*held), types)], names)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*held), types)], names)


def _files(spark: SparkSession, path: str, ends: tuple[str, ...]) -> DataFrame:
    """A row, and a task, for each file."""
    files = listed(path, ends)
    return spark.createDataFrame(list(enumerate(files)), "no long, path string").repartition(max(1, len(files)), "no")


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """refs(ref_idx, id, description, seq) of a file, or of a folder's files, a task for each; ref_idx is the
    place in the file, with the file's number before it (times 2^32)."""
    names = [x.split()[0] for x in REFERENCE.split(", ")]

    def run(batches):
        for batch in batches:
            for no, p in zip(*(c.to_pylist() for c in batch.columns)):
                yield from _batches((((no << 32) + i, *r) for i, r in enumerate(fasta_records(p))), [pa.int64(), pa.string(), pa.string(), pa.string()], names)

    return _files(spark, path, (".fasta", ".fasta.gz", ".fa", ".fa.gz")).mapInArrow(run, REFERENCE)


def cut_lineage(text: Column) -> Column:
    return F.transform(F.split(text, ";"), lambda x: F.trim(x))


def lineage_from_headers(refs: DataFrame, id_fallback: bool = True) -> DataFrame:
    """lineage(id, lineage) from a description with ';', or else (with id_fallback) from the id."""
    described = F.when(F.col("description").contains(";"), F.col("description"))
    source = F.coalesce(described, F.col("id")) if id_fallback else F.col("description")
    out = refs.where(F.lit(id_fallback) | F.col("description").contains(";"))
    return out.select("id", cut_lineage(source).alias("lineage"), "ref_idx").groupBy("id").agg(F.max_by("lineage", "ref_idx").alias("lineage"))


def lineage_from_lines(rows: DataFrame) -> DataFrame:
    """rows(line_no, value) of `id TAB k;p;c;o;f;g;s`: blank lines are skipped, of a repeated id the last
    line counts, a line without a TAB is an error that names its number."""
    text = F.trim("value")
    at = F.instr("value", "\t")
    id_ = F.when(at > 0, F.trim(F.substring_index("value", "\t", 1))).otherwise(F.raise_error(F.concat(F.lit("no tab in line "), F.col("line_no").cast("string"))))
    rest = F.expr("substring(value, instr(value, '\t') + 1)")
    return rows.where(F.length(text) > 0).select(id_.alias("id"), cut_lineage(F.trim(rest)).alias("lineage"), "line_no").groupBy("id").agg(F.max_by("lineage", "line_no").alias("lineage"))


def read_lineage_tsv(spark: SparkSession, path: str) -> DataFrame:
    """lineage(id, lineage) of a file, or of a folder's files; of a repeated id the last line of the last
    file counts."""

    def run(batches):
        for batch in batches:
            for no, p in zip(*(c.to_pylist() for c in batch.columns)):
                yield from _batches((((no << 32) + i, x.decode()) for i, x in enumerate(lines(p), 1)), [pa.int64(), pa.string()], ["line_no", "value"])

    return lineage_from_lines(_files(spark, path, (".tsv", ".tsv.gz", ".txt")).mapInArrow(run, "line_no bigint, value string"))


def uniques_fasta(uniques: DataFrame, width: int = 20_000, ids: Column | None = None, by: str = "rank") -> DataFrame:
    """(rank, value): `>id;size=N;` and the sequence wrapped at `width`, for rows (rank, seq, cnt)."""
    name = ids if ids is not None else F.concat(F.lit("seq"), F.col(by).cast("string"))
    wrapped = F.regexp_replace("seq", f"(.{{{width}}})(?=.)", "$1\n")
    return uniques.select(F.col(by), F.concat(F.lit(">"), name, F.lit(";size="), F.col("cnt").cast("string"), F.lit(";\n"), wrapped).alias("value"))


def write_fasta(uniques: DataFrame, path: str, width: int = 20_000, mode: str = "overwrite") -> None:
    uniques_fasta(uniques, width).sort("rank").select("value").write.mode(mode).text(path)


def _cells(table: DataFrame, samples: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """(one row with the columns' hex names, the commonest first; (sample, cells: counts by name))."""
    order = table.groupBy("seq").agg(F.sum("cnt").alias("n")).select(hex_key(F.col("seq")).alias("hex"), (-F.col("n")).alias("less"), "seq")
    names = order.agg(F.transform(F.array_sort(F.collect_list(F.struct("less", "seq", "hex"))), lambda x: x["hex"]).alias("names"))
    cells = table.groupBy("sample").agg(F.map_from_entries(F.collect_list(F.struct(hex_key(F.col("seq")), F.col("cnt")))).alias("cells"))
    if samples is not None:
        cells = samples.select("sample").distinct().join(cells, "sample", "left")
    return names, cells


def _counts() -> Column:
    """The counts of a row's cells in the order of its names."""
    own = F.coalesce(F.col("cells"), F.create_map().cast("map<string,bigint>"))
    return F.transform("names", lambda x: F.coalesce(F.try_element_at(own, x), F.lit(0)))


def table_tsv(table: DataFrame, samples: DataFrame | None = None) -> DataFrame:
    """(place, value): a header `sample TAB hex...` and a line for each sample, also for those of
    samples(sample) that the table lacks. Cells are gathered as a map for each sample instead of pivoted, so
    there is no limit to the columns but a line's length."""
    names, cells = _cells(table, samples)
    rows = cells.crossJoin(F.broadcast(names)).select(F.lit(1).alias("kind"), "sample", F.concat_ws("\t", F.col("sample"), F.transform(_counts(), lambda n: n.cast("string"))).alias("value"))  # names is one row
    head = names.select(F.lit(0).alias("kind"), F.lit("").alias("sample"), F.concat_ws("\t", F.lit("sample"), F.col("names")).alias("value"))
    place = F.row_number().over(Window.orderBy("kind", "sample"))
    return head.union(rows).select((place - 1).alias("place"), "value")


def table_json(table: DataFrame, samples: DataFrame | None = None) -> DataFrame:
    """(value): one object with samples, sequences (hex) and counts. It is one row by its nature, made where
    the rows are; nothing comes to the driver."""
    names, cells = _cells(table, samples)
    lines_ = cells.crossJoin(F.broadcast(names)).select(F.struct(F.col("sample"), _counts().alias("counts")).alias("line"), "names")  # names is one row
    whole = lines_.agg(F.array_sort(F.collect_list("line")).alias("lines"), F.first("names").alias("names"))
    field = lambda f: F.transform("lines", lambda x: x[f])
    return whole.select(F.to_json(F.struct(field("sample").alias("samples"), F.col("names").alias("sequences"), field("counts").alias("counts"))).alias("value"))


def lineage_lines(lineages: DataFrame) -> Column:
    return F.concat_ws("\t", F.col("id"), F.array_join("lineage", ";"))
