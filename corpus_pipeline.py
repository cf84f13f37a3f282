"""The corpus pipeline: toxicity, line dedup, near-dedup, benchmark decontamination, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from paneltide.llm import common, decontaminate, line_dedup, near_dedup, packing, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model scores below its threshold. Trained on the table's labels and these documents.

    Null and empty texts get the least score and stay where toxic documents are the rarer ones; repeated rows are judged
    alike; texts are read whole; other columns, of any name, stay; an empty table stays empty.
    """
    model = toxicity.train(docs, common.table(spark, sf_dir, "labels"))
    kept = toxicity.score(docs, model).filter(F.col("score") < toxicity.THRESHOLD)
    return kept.select(*[F.col("row").getField(n).alias(n) for n in docs.columns])


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that repeat across documents. ``n_chars``, where there, is counted anew.

    Null texts stay null; of tying ids all rows keep the line; an empty table stays empty; other columns, of any name, stay.
    """
    return _counted(line_dedup.dedup_lines(docs), docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: of the smallest id, null before all, one of repeated rows.

    Null and empty texts are one class. Texts are read whole; other columns, of any name, stay; an empty table stays empty.
    """
    return near_dedup.keep_one(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item. Null and empty texts have none; repeated rows are judged alike; texts are read
    whole; other columns, of any name, stay; an empty table on either side drops nothing."""
    return decontaminate.clean(docs, common.table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all remaining documents and their places in sequences. A null or empty text is its end token alone;
    repeated rows are packed each; long texts are cut into pieces; other columns go; an empty table gives none."""
    return packing.pack(docs)


def _counted(out: DataFrame, docs: DataFrame) -> DataFrame:
    kinds = dict(docs.dtypes)
    if kinds.get("n_chars") not in ("bigint", "int"):
        return out
    count = F.when(F.col("n_chars").isNotNull(), F.length("text")).cast(kinds["n_chars"])
    return out.select(*[count.alias(n) if n == "n_chars" else F.col(n) for n in docs.columns])


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_benchmark),
    ("packing", pack),
]

#: A trained model, signatures and tokens are not SQL; tests compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``, each on all that the one before kept, written and read again in between."""
    docs = common.table(spark, sf_dir, "documents")
    used: list[DataFrame] = []
    for name, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), name, used)
        used = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
