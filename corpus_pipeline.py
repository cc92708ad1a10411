"""documents -> language ID -> toxicity -> n-gram Jaccard join -> best-fit packing.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame; run() writes each stage's rows to the shared
folder and reads them again as the next one's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewright.llm import langid, ngram_join, packing, toxicity
from tidewright.llm._common import broadcast_if_small, materialise, table

TOXIC = 0.5
#: Trained models and the join's components have no SQL form; tests compare run() with a brute-force version.
ORACLE_SQL = None


def unused(docs: DataFrame, name: str) -> str:
    """A column name that docs doesn't have."""
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    return name


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is told: the text has a letter and the score is not below chance among the
    languages that were learned. Without any language to learn no document is told."""
    lang, score = unused(docs, "lang_pred"), unused(docs, "score")
    model = langid.fit(docs)
    chance = 1 / len(model.langs) if model else 1.0
    out = langid.predict(docs, model, carry=tuple(docs.columns), names=(lang, score))
    return out.where((F.col(lang) != langid.UNDETERMINED) & (F.col(score) >= chance)).select(*docs.columns)


def toxic_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that score below 0.5."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    score = unused(docs, "score")
    return toxicity.score(docs, model, carry=tuple(docs.columns), name=score).where(F.col(score) < TOXIC).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the row with the smallest doc_id of each group of similar rows, of equal doc_ids the one with the least
    text digest; rows whose doc_id is null stay."""
    if not docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty():
        return near_duplicate_rows(docs)
    groups = materialise(ngram_join.similar_groups(docs), "groups")
    removed = materialise(groups.where("doc_id <> component_id").select("doc_id").distinct(), "removed")
    return docs.join(broadcast_if_small(removed), "doc_id", "left_anti").select(*docs.columns)


def near_duplicate_rows(docs: DataFrame) -> DataFrame:
    """near_duplicates where doc_ids repeat: every row is a node of its own; of equal rows any one stays."""
    node = unused(docs, "node")
    rows = materialise(docs.withColumn(node, F.when(F.col("doc_id").isNotNull(), F.monotonically_increasing_id())), "rows")
    groups = ngram_join.similar_groups(rows.select(F.col(node).alias("doc_id"), "text"))
    groups = groups.where("doc_id is not null").select(F.col("doc_id").alias(node), F.col("component_id").alias("group"))
    rest = [F.col(f"`{f.name}`") for f in docs.schema.fields if f.name not in ("doc_id", "text") and not isinstance(f.dataType, T.MapType)]
    order = F.struct("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("digest"), F.xxhash64(F.lit(0), *rest).alias("rest"), F.col(node).alias("node"))
    groups = materialise(groups.join(rows.select(node, order.alias("order")), node), "groups")
    least = groups.groupBy("group").agg(F.min("order").alias("least")).select(F.col("least.node").alias(node))
    removed = materialise(groups.select(node).join(least, node, "left_anti"), "removed")
    return rows.join(broadcast_if_small(removed), node, "left_anti").select(*docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed_documents(docs)


STAGES = [("language_id", language_id), ("toxicity", toxic_language), ("ngram_jaccard_join", near_duplicates), ("best_fit_packing", best_fit_packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
