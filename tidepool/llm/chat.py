"""Chat formatting: conversations rendered by a compiled template, with the spans to train on."""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.llm.common import stored
from tidepool.llm.template import CHAT, END, START, Output, Template, TemplateError, unguard, unline

#: Code points of a part, unless one turn has more.
PART_CHARS = 1 << 18


def format_chats(rows: DataFrame, template: str = CHAT, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Render conversations: (conv_id, part, n_turns, formatted, spans), a row for each part of a
    conversation in the order of `part`; spans are (start, end) code points of the part that the loss is
    taken over.

    Turns go by turn, then role, text; null turns come first, and a null role or text is empty. Rows are
    dealt by ranges of (conversation, turn), so one conversation with very many turns is rendered by many
    tasks and its parts stay small. The template must be one loop over `messages`, with anything before
    and after it. With repeated turns, each equal to the first (last) one counts as first (last). Further
    columns are ignored; an empty table gives no parts.
    """
    program = Template(template)
    if not program.in_turns:
        raise TemplateError("the template must read `messages` in one loop only, without loop.index or loop.length")
    spark = rows.sparkSession
    key_type = dict(rows.dtypes)[conv_col]
    own = rows.select(F.col(f"`{conv_col}`").alias("conv"), F.col(f"`{turn_col}`").alias("turn"), F.coalesce(F.col(f"`{role_col}`").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    order = [F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text"]
    if program.uses_place:
        place = F.struct(F.col("turn").isNotNull().alias("has"), "turn", "role", F.xxhash64("text").alias("h"))
        ends = own.withColumn("place", place).groupBy("conv").agg(F.min("place").alias("lo"), F.max("place").alias("hi"))
        own = own.withColumn("place", place).join(ends.withColumnRenamed("conv", "c"), F.col("conv").eqNullSafe(F.col("c")))
        own = own.select("conv", "turn", "role", "text", (F.col("place") == F.col("lo")).alias("first"), (F.col("place") == F.col("hi")).alias("last"))
    else:
        own = own.select("*", F.lit(False).alias("first"), F.lit(False).alias("last"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = own.repartitionByRange(parts, *order[:2], F.xxhash64("role", "text")).sortWithinPartitions(*order)

    def run(batches):
        compiled, task, made = Template(template), TaskContext.get().partitionId(), 0
        out, conv, n = Output(), None, 0

        def row():
            nonlocal made
            made += 1
            return conv, (task << 32) + made, n, out.text, [{"start": a, "end": b} for a, b in out.spans]

        for batch in batches:
            done = []
            for c, role, text, first, last in zip(*(batch.column(x).to_pylist() for x in ("conv", "role", "text", "first", "last"))):
                if n and (c != conv or out.size >= PART_CHARS):
                    done.append(row())
                    out, n = Output(), 0
                conv = c
                compiled.turn({"role": role, "text": text}, first, last, out)
                n += 1
            yield _parts(done, batch.schema.field("conv").type)
            kind = batch.schema.field("conv").type
        if n:
            yield _parts([row()], kind)

    schema = f"conv {key_type}, part long, n_turns long, formatted string, spans array<struct<start: long, end: long>>"
    return stored(dealt.mapInArrow(run, schema), "chats").withColumnRenamed("conv", conv_col)


def _parts(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    types = [kind, pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
    columns = list(zip(*rows)) or [()] * 5
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], ["conv", "part", "n_turns", "formatted", "spans"])


_TURN = re.compile(re.escape(START) + r"(.*?)\n(.*?)" + re.escape(END) + r"\n", re.S)


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of the turns of what CHAT has rendered."""
    out, at = [], 0
    for m in _TURN.finditer(formatted):
        if m.start() != at:
            break
        out.append((unline(m[1]), unguard(m[2])))
        at = m.end()
    if at != len(formatted):
        raise ValueError(f"not a turn at {at}")
    return out


def chat_digests(parts: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """Read CHAT's parts back: conversation, n_turns, turns_sha256, loss_chars, loss_sha256,
    formatted_chars. Each task reads its conversations part by part and keeps the hashes' state only: a
    digest of a conversation is a chain, but needs no more than one part at a time. A null conversation is
    one like others; parts that are not what CHAT renders are an error; no parts give no rows."""
    key_type = dict(parts.dtypes)[conv_col]
    n = int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = parts.withColumnRenamed(conv_col, "conv").repartition(n, "conv").sortWithinPartitions(F.col("conv").asc_nulls_first(), "part")
    names = ["conv", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

    def run(batches):
        conv, state, kind = None, None, None
        row = lambda: (conv, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4])
        batch_of = lambda rows: pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(list(zip(*rows)) or [()] * 6, [kind, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()])], names)
        for batch in batches:
            kind, done = batch.schema.field("conv").type, []
            for c, text, spans in zip(*(batch.column(x).to_pylist() for x in ("conv", "formatted", "spans"))):
                if state is None or c != conv:
                    if state is not None:
                        done.append(row())
                    conv, state = c, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, said in read_turns(text):
                    state[0] += 1
                    state[1].update(f"{role}\n{said}\n".encode())
                for s in spans:
                    said = unguard(text[s["start"] : s["end"]])
                    state[2] += len(said)
                    state[3].update(said.encode())
                state[4] += len(text)
            yield batch_of(done)
        if state is not None:
            yield batch_of([row()])

    return own.mapInArrow(run, f"conv {key_type}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long").withColumnRenamed("conv", conv_col)
