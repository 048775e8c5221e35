"""From raw documents to token ids: five stages, each on all that the one before it kept.

STAGES are (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame that
run() writes as Parquet in the shared folder and reads again as the next stage's docs. run() deletes what
it wrote itself, and a stage deletes nothing: its result can be read whenever it is wanted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import jaccard_join, language_id, mixing, quality_rules
from tessera.llm.common import numbered, stash
from tessera.llm.queries import op5_bpe_round_trip
from tessera.operators.shared import discard

#: Documents whose language is this unsure go, and those whose stated one is so surely contradicted.
LEAST_SCORE, SURE = 0.5, 0.9


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go, each row by itself: null and empty texts fail, an empty table stays empty."""
    return quality_rules.keep_good(docs)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language, between languages, or surely in another than they state, go.

    Each half of the documents, by hash of the id (null ids in the first), is judged by a model of the
    other half; only if that half taught nothing, by one of all. A stated language that the model does
    not know, or a null one, is not contradicted. Null and empty texts have no language and go;
    repeated ids are judged row by row; an empty table stays empty.
    """
    half = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 2, F.lit(0))
    kept = []
    for k in (0, 1):
        model = language_id.fit(docs, half != k)
        if not model.families:
            model = language_id.fit(docs, F.lit(True))
        mine = docs.where(half == k)
        found = language_id.identify(mine, model, keep=[F.struct(*docs.columns).alias("_doc")])
        known = sorted(x for langs in model.families.values() for x in langs)
        stated = F.coalesce(F.col("_doc.lang").isin(known), F.lit(False)) if known else F.lit(False)
        wrong = stated & (F.col("_doc.lang") != F.col("lang_pred")) & (F.col("score") >= SURE)
        kept.append(found.where((F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= LEAST_SCORE) & ~wrong).select("_doc.*"))
    return kept[0].unionByName(kept[1])


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of similar ones stays: the one with the smallest id, null last, and of its likes one.

    Texts without words are like nothing and stay, each row by itself; an empty table stays empty.
    """
    rows = numbered(docs, "near-copies-rows")
    found = jaccard_join.jaccard_components(rows.select("_number", "_doc.text"), id_col="_number").join(rows.select("_number", "_doc.doc_id"), "_number")
    best = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_number"))["_number"]
    return rows.join(found.groupBy("component_id").agg(best.alias("_number")), "_number", "left_semi").select("_doc.*")


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row stands as often as the mix takes it: never for a null or empty text, by its own size if its id is shared or null."""
    rows = numbered(docs, "mixing-rows")
    mixed = mixing.mix(rows.select("_number", "_doc.doc_id", "_doc.text", "_doc.source"), leaning=mixing.middling, row_col="_number")
    taken = mixed.where("copies > 0").select("_number", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("_copy"))
    return rows.join(taken, "_number").select("_doc.*")


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and of the decoded text of each remaining document, a row for each row."""
    return op5_bpe_round_trip(spark, sf_dir, docs)


STAGES = [("quality rules", quality), ("language id", language), ("n-gram jaccard join", near_copies), ("mixing", mixture), ("bpe encoding", encoding)]

#: Fitted models and tokenizers can't be put in SQL; tests compare run() with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from the documents table to the result of the last."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        docs = stash(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
        if last is not None:
            discard(last)  # what this stage has read
        last = docs
    return docs
