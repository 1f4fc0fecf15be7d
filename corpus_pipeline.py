"""The corpus pipeline: quality filter, line dedup, near-duplicate removal, decontamination, encoding.

Each stage takes (spark, docs, sf_dir) and returns the rows that go on; ``run`` writes each stage's
rows as Parquet in the shared folder and reads them back for the next one. What a stage wrote for itself,
and what the stage before returned, is deleted once its rows are written; the last stage's rows stay.

All stages take null or empty texts, null and repeated doc_ids, repeated rows, very long texts and empty
tables. Other columns than those of documents are left out by the first stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rastrel import shared
from rastrel.llm import decontaminate, line_dedup, ngram_join, pieces, quality

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the threshold.

    A null text is scored as an empty one; rows with one text have one score and stay or go together, whatever their ids.
    """
    model = quality.train(spark, docs, _table(spark, sf_dir, "labels"))
    return quality.score(spark, docs, model, carry=COLUMNS[1:]).where(F.col("score") >= quality.THRESHOLD).select(*COLUMNS)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that others repeat; n_chars is counted anew.

    A line stays in the largest doc_id that holds it, in all rows of that id. A null doc_id is smaller than all others, and each
    such row a document of its own. A null text stays null; a text may become empty, and stays as a row.
    """
    got = line_dedup.dedup(spark, docs, carry=("lang", "source"), digest=False)
    return got.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near copies: that with the least doc_id, of its rows the first by text.

    Rows are told apart by their place, not by doc_id: of a class whose rows have no id, or the same one, one stays, and a
    row with another text stays though its doc_id repeats. Rows without words link with nothing and stay.
    """
    return ngram_join.representatives(spark, docs, carry=COLUMNS[2:]).select(*COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. Null and empty texts hold none; rows with one text stay or go together."""
    return decontaminate.clean(spark, docs.select(*COLUMNS), _table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, the ids of the pieces, their number, and whether they decode to the text, for every row; a null text has no pieces."""
    import public_tokenizers

    got = pieces.encode_documents(spark, docs, public_tokenizers.path("piece_bpe_32k.model"))
    return got.select("doc_id", "ids", F.size("ids").cast("long").alias("n_pieces"), "round_trip")


STAGES = [
    ("quality classifier", quality_filter),
    ("line dedup", drop_lines),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("SentencePiece encoding", encode),
]

#: Training a classifier and encoding by a model's merges are beyond SQL; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = _table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        with shared.scope(spark) as keep:
            path = shared.new_path(spark, name.replace(" ", "-"))
            out = stage(spark, docs, sf_dir)
            with shared.tidy(spark):
                out.write.option("compression", "zstd").parquet(path)
            keep.append(path)
            docs = spark.read.schema(out.schema).parquet(path)
        if last:
            shared.remove(spark, last)
        last = path
    return docs
