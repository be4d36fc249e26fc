"""The corpus pipeline: what is left of `documents`, encoded.

Each stage takes the documents that its predecessor kept, written as Parquet and read again, and calls one
operator on all of them. Stages but the last return the columns that they got, whatever their names; a
table without rows stays one, and repeated rows are judged each by itself unless a stage says otherwise.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.llm import langid, rules
from tidepool.llm.bpe import bpe_encode
from tidepool.llm.common import own_columns, remainder, stored, table
from tidepool.llm.neardup import near_duplicates
from tidepool.llm.phrases import decontaminate

#: Languages are told apart by letters; a document is rejected if it has none or lies exactly as near to
#: another language as to its own, as one in letters that no language has. No score is below a tie's, and
#: letters in disorder mostly lie a little nearer to some language, which keeps them.
TIE = 0.5


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule and the learned decision list keep. A null or empty text has no words and
    goes; a null id matches no label and is judged all the same."""
    judged, at = rules.judge(docs, rules.fit(docs, table(spark, sf_dir, "labels")))
    return judged.where(F.col(f"`{at}`.kept")).drop(at)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the learned languages. Texts that are null, empty or without letters go, and those
    exactly as near to two languages; without any row to learn from all go. A null language isn't learned
    from."""
    told, at = langid.identify(docs, langid.fit(docs.where(remainder("doc_id", 5) != 0)))
    return told.where((F.col(f"`{at}`.lang_pred") != langid.UNKNOWN) & (F.col(f"`{at}`.score") > TIE)).drop(at)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id. Rows that share an id stay
    or go together; rows with a null id, and texts without words, are copies of nothing and stay."""
    gone = stored(near_duplicates(docs).where("not kept").select("doc_id").distinct(), "gone")
    return docs.join(gone, "doc_id", "left_anti").select(own_columns(docs))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without enough of any benchmark item. The verdict rests on the text alone and is joined by
    its hash, so each row has its own, whether its id is null or stands on other rows too. A null or empty
    text is clean; an empty benchmark contaminates nothing."""
    digest = F.unhex(F.sha2(F.col("text").cast("string"), 256))
    judged = decontaminate(docs.select(digest.alias("digest"), "text"), table(spark, sf_dir, "benchmark"), id_col="digest")
    gone = stored(judged.where("contaminated").select("digest").distinct(), "gone")
    return docs.join(gone, digest == gone["digest"], "left_anti").select(own_columns(docs))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, token ids (packed, with their digest) and the digest of the decoded text. A null text is
    empty and has no ids; every row gets its own."""
    return bpe_encode(docs, public_tokenizers.path("byte_bpe_50k.json"), columns=("ids", "ids_sha256", "decoded_sha256"), memo=80_000)


STAGES = [("quality", quality), ("language", language), ("near_copies", near_copies), ("decontaminated", decontaminated), ("encoded", encoded)]

#: Learned rules, profiles and tokens have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stored(docs, name)
    return docs
