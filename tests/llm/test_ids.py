"""Ids keep their value whatever stands beside them in a batch."""

from __future__ import annotations

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tessera.llm import bpe, jaccard_join, language_id, license_scan, mixing, quality_classifier, quality_rules, queries, token_counts, topk_search
from tests.llm.test_operators import odd

BIG = 2**60 + 1


def _path():
    return public_tokenizers.path(queries.TOKENIZER)


RUNS = {
    "quality rules": lambda d: quality_rules.quality_rules(d),
    "token counts": lambda d: token_counts.token_counts(d, _path()),
    "encoding": lambda d: bpe.encode_documents(d, _path()),
    "language": lambda d: language_id.identify(d, language_id.fit(odd(d.sparkSession), F.lit(True)), keep=[F.col("doc_id")]),
    "components": lambda d: jaccard_join.jaccard_components(d),
    "mixing": lambda d: mixing.mix(d),
    "licenses": lambda d: license_scan.scan_licenses(d),
    "quality": lambda d: quality_classifier.score(d, quality_classifier.fit(odd(d.sparkSession), d.selectExpr("doc_id", "1 as quality"), F.lit(True))),
}


@pytest.mark.parametrize("name", RUNS)
def test_large_ids_beside_nulls(spark, name):
    docs = spark.createDataFrame([(BIG, "some text of words", "en", "a"), (None, "other text of words", "en", "a")], "doc_id long, text string, lang string, source string").coalesce(1)
    out = RUNS[name](docs)
    assert {r["doc_id"] for r in out.collect()} == {BIG, None}
    if name == "components":
        assert {r["component_id"] for r in out.collect()} == {BIG, None}


def test_large_ids_of_vectors(spark):
    rows = spark.createDataFrame([(BIG, [1.0]), (None, [1.0]), (BIG + 1, [0.5])], "vec_id long, embedding array<double>").coalesce(1)
    out = topk_search.top_k(rows, F.col("id") == BIG)
    assert [(r["query_id"], r["vec_id"]) for r in out.collect()] == [(BIG, BIG + 1)]
