"""From raw documents to packed sequences: the stages of a training corpus, each on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from washline.llm import boosting
from washline.llm.balance import cycled_targets, mix_sources
from washline.llm.common import free_name, located, shared_path, staging_scope
from washline.llm.forest import near_duplicates
from washline.llm.packing import pack
from washline.llm.queries import in_fold, tokenizer_path
from washline.llm.stream_dedup import exact_duplicates

#: No SQL states boosting, minhashing or Newton steps.
ORACLE_SQL = None


def _without(docs: DataFrame, place: str, gone: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of ``docs`` whose place is not the only column of ``gone``."""
    lost = gone.toDF(free_name(docs, "_gone"))
    return docs.join(lost, F.col(place) == F.col(lost.columns[0]), "left_anti").select(*columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores 0.7 or more; empty ones are scored too."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return boosting.accepted(docs, boosting.train(docs, labels.where(~in_fold(2, 4))), 0.7)


def _rank(docs: DataFrame, place: str) -> Column:
    """Text that orders rows by doc_id (null last), then by content; the place tells equal rows apart only.

    Places differ from run to run, what rows hold does not, so every run keeps the same.
    """
    hexed = lambda c: F.lpad(F.hex(c), 16, "0")
    number = hexed(F.col("doc_id").cast("long").bitwiseXOR(F.lit(-(2**63))))
    return F.concat(F.coalesce(number, F.lit("~")), F.lit("#"), hexed(F.xxhash64(*_content(docs))), F.lit("#"), F.col(place))


def _content(docs: DataFrame) -> list[str]:
    """Columns that a hash can take: all but maps."""
    return [f"`{f.name}`" for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text: that with most characters, then the smallest doc_id."""
    path = getattr(docs, "stage_path", None)
    if path is None:  # the stream reads files
        path = shared_path(spark, "arrived")
        docs.write.parquet(path)
    found = exact_duplicates(spark, path).where(~F.col("kept"))
    place = free_name(docs, "_place")
    gone = found.select(F.concat("file", F.lit("#"), F.col("row").cast("string")))
    return _without(located(spark.read.parquet(path), place), place, gone, docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: that with the smallest doc_id."""
    place, rank, own = (free_name(docs, n) for n in ("_place", "_rank", "_own"))
    rows = located(docs, place)
    ranked = rows.withColumn(rank, _rank(docs, place))
    classes = near_duplicates(ranked, id_col=rank, shingle=5, threshold=0.8)
    gone = classes.where(F.col(rank) != F.col("class_id")).select(F.substring_index(rank, "#", -2).alias(own))
    return _without(rows, place, gone, docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; sources weigh 5, 2, 1 and share 150 percent."""
    place, at, times, copy = (free_name(docs, n) for n in ("_place", "_taken", "_times", "_copy"))
    rows = located(docs, place)
    targets = cycled_targets((5, 2, 1), share=1.5, most=2)
    mix = mix_sources(rows, targets, most=2, id_col=place, deal_by=tuple(_content(docs)))
    taken = mix.where("copies > 0").select(F.col(place).alias(at), F.col("copies").alias(times))
    joined = rows.join(taken, F.col(place) == F.col(at))
    return joined.withColumn(copy, F.explode(F.sequence(F.lit(1).cast("long"), times))).select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 2048 ids."""
    return pack(docs, tokenizer_path(), size=2048, end_id=1)


STAGES = [
    ("quality classifier", quality),
    ("exact deduplication", exact),
    ("near duplicates", near),
    ("source mixing", mixture),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; each stage is written as Parquet to the shared folder and read again.

    What a stage stages on the way is deleted once it is written.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = shared_path(spark, name.replace(" ", "-"))
        with staging_scope(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        docs.stage_path = path
    return docs
