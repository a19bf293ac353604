"""The corpus pipeline: language ID, near-duplicates, secrets, mixture, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each stage's rows to the shared folder as
Parquet and reads them again as the next stage's documents. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import byte_bpe, langid, mixing, secrets, simhash_dedup
from millrace.llm.common import fingerprint_of_row, materialise
from millrace.llm.queries import vocabulary

#: Models and seeded blocks are beyond SQL; the stages are tested against brute force instead.
ORACLE_SQL = None


def _whole(docs: DataFrame) -> Column:
    """A document as one value, so that no column of it can clash with a column that an operator adds."""
    return F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")


def _with(docs: DataFrame, **new: Column) -> list[Column]:
    """The columns of documents from that value, some of them new."""
    return [new.get(c, F.col(f"doc.`{c}`")).cast(docs.schema[c].dataType).alias(c) for c in docs.columns]


def _kept(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """The documents with the columns of ``rows`` (doc_id, row_hash and others) beside ``doc``; null ids match."""
    own = docs.select(_whole(docs), "doc_id", fingerprint_of_row(docs).alias("row_hash")).alias("d")
    return own.join(rows.alias("r"), F.col("d.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col("d.row_hash") == F.col("r.row_hash")))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the language model doesn't reject, with the predicted language as lang.

    Null texts and texts without letters are rejected; where no document is labelled, every one is. A null doc_id, ties
    and repeated rows are judged like any other row. An empty table gives no rows.
    """
    judged = langid.identify(docs.select(_whole(docs), "text"), langid.train(docs), ["doc"])
    return judged.where(~F.col("rejected")).select(*_with(docs, lang=F.col("lang_pred")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near-duplicates one document: that with the smallest id, null ids last.

    Where several rows have that id, the one with the least hash of the whole row stays, and of rows equal throughout
    one. A group of null ids keeps one of them too. Null and wordless texts are one group. An empty table gives no rows.
    """
    groups = simhash_dedup.near_duplicates(docs.select("doc_id", "text", fingerprint_of_row(docs).alias("row_hash")), keep=("row_hash",))
    one = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_hash")).alias("one")
    firsts = materialise(groups.groupBy("component").agg(one).select("one.doc_id", "one.row_hash"), "pipeline-firsts")
    kept = _kept(docs, firsts)
    repeated = materialise(groups.groupBy("doc_id", "row_hash").agg(F.count("*").alias("n")).where("n > 1").select("row_hash").distinct(), "pipeline-repeated")
    if repeated.isEmpty():
        return kept.select(*_with(docs))
    # Rows equal throughout are few ids' copies, so only those are brought together.
    own = kept.select("doc", F.col("d.row_hash").alias("row_hash"), F.col("d.doc_id").alias("id"))
    single = own.join(repeated, "row_hash", "left_anti").select("doc")
    return single.unionByName(own.join(repeated, "row_hash", "left_semi").groupBy("id", "row_hash").agg(F.first("doc").alias("doc")).select("doc")).select(*_with(docs))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced in their text and n_chars counted anew where it was. Null texts stay null."""
    clean = secrets.redacted(docs.select(_whole(docs), "text"))
    return clean.select(*_with(docs, text=F.col("text"), n_chars=F.when(F.size("secrets") > 0, F.char_length("text")).otherwise(F.col("doc.n_chars")) if "n_chars" in docs.columns else F.lit(None)))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: its taken words over its size, the fraction rounded by a seeded draw.

    Documents without words are taken by no mix and go. Rows equal throughout share what the mix takes of them. A null
    doc_id and a null source are values like others. An empty table gives no rows.
    """
    taken = mixing.mix(docs.select("doc_id", "source", "text", fingerprint_of_row(docs).alias("row_hash")), keep=("row_hash",)).where("size > 0")
    share = materialise(taken.groupBy("doc_id", "row_hash").agg(F.avg(F.col("taken") / F.col("size")).alias("share")), "pipeline-shares")
    draw = F.pmod(F.xxhash64(F.lit(23), "doc_id", "row_hash"), F.lit(1 << 20)) / F.lit(float(1 << 20))
    times = share.select("doc_id", "row_hash", (F.floor("share") + (draw < F.col("share") - F.floor("share")).cast("int")).cast("int").alias("times")).where("times > 0")
    return _kept(docs, times).select("doc", F.explode(F.sequence(F.lit(1), F.col("times")))).select(*_with(docs))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each document that is left. Null text counts as empty."""
    return byte_bpe.encode(docs, *vocabulary())


STAGES = [("language_id", language_id), ("simhash_dedup", near_duplicates), ("secret_scan", secret_scan), ("mixing", mixture), ("byte_bpe", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
