"""Each stage of the pipeline against what brute force makes of its own input."""

from __future__ import annotations

import zlib
from collections import Counter

import corpus_pipeline
from pyspark.sql import functions as F

from tessera.llm import language_id, mixing, quality_rules
from tessera.llm.common import numbered
from tests.llm.test_operators import SMALL, base, brute_components, documents, library, odd  # noqa: F401


def bag(df):
    return Counter(tuple(r) for r in df.collect())


def stages(spark, docs):
    """(name, rows before, rows after) of all stages but the last, and the last one's result."""
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = corpus_pipeline.stash(stage(spark, docs, SMALL), "test-stage")
        assert after.columns == docs.columns
        yield name, docs, after
        docs = after
    yield "last", docs, corpus_pipeline.STAGES[-1][1](spark, docs, SMALL)


def test_stages(spark, library):  # noqa: F811
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "language id", "n-gram jaccard join", "mixing", "bpe encoding"]
    for name, before, after in stages(spark, documents(spark, SMALL)):
        rows = before.collect()
        if name == "quality rules":
            kept = {r["doc_id"] for r in quality_rules.quality_rules(before).where("kept").collect()}
            assert not any(base(r["text"])[-1] for r in rows if r["doc_id"] in kept)
            assert bag(after) == Counter(tuple(r) for r in rows if r["doc_id"] in kept)
            assert 0 < after.count() < len(rows)
        elif name == "language id":
            halves = [[r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 2 == k] for k in (0, 1)]
            half = F.crc32(F.col("doc_id").cast("string")) % 2
            want = Counter()
            for k, mine in enumerate(halves):
                model = language_id.fit(before, half != k)
                for r, (lang, sure) in zip(mine, model.predict([r["text"] or "" for r in mine]), strict=True):
                    wrong = r["lang"] is not None and r["lang"] != lang and sure >= corpus_pipeline.SURE
                    want[tuple(r)] += lang != language_id.UNKNOWN and sure >= corpus_pipeline.LEAST_SCORE and not wrong
            assert bag(after) == +want
            assert after.count() >= 0.95 * len(rows)
        elif name == "n-gram jaccard join":
            least = {i for i, _, c in brute_components([(r["doc_id"], r["text"]) for r in rows]) if i == c}
            assert bag(after) == Counter(tuple(r) for r in rows if r["doc_id"] in least)
        elif name == "mixing":
            copies = {r["doc_id"]: r["copies"] for r in mixing.mix(before, leaning=mixing.middling).collect()}
            assert bag(after) == +Counter({tuple(r): copies[r["doc_id"]] for r in rows})
        else:
            want = Counter((r["doc_id"], len(library.encode(r["text"] or "", add_special_tokens=False))) for r in rows)
            assert bag(after.select("doc_id", "n_tokens")) == want


def test_odd_rows_pass_through_every_stage(spark):
    for rows in (odd(spark), odd(spark, [])):
        every = bag(rows)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            after = stage(spark, rows, SMALL)
            assert after.columns == rows.columns
            most = 2 if name == "mixing" else 1
            assert all(n <= most * every[row] for row, n in bag(after).items())
        last = corpus_pipeline.STAGES[-1][1](spark, rows, SMALL)
        assert Counter(r["doc_id"] for r in last.select("doc_id").collect()) == Counter(r["doc_id"] for r in rows.select("doc_id").collect())


def test_decisions_hold_for_rows_not_ids(spark):
    rows = odd(spark).collect()
    # near copies: one row of each component, and every row without words
    parts = {}
    for k, _, c in brute_components([(k, r["text"]) for k, r in enumerate(rows)]):
        parts.setdefault(c, []).append(rows[k])
    got = corpus_pipeline.near_copies(spark, odd(spark), SMALL).collect()
    assert len(got) == len(parts) < len(rows)
    least = [min((r["doc_id"] is None, r["doc_id"] or 0) for r in part) for part in parts.values()]
    assert Counter((r["doc_id"] is None, r["doc_id"] or 0) for r in got) == Counter(least)
    # mixing: each row by its own copies
    want = Counter()
    for r in mixing.mix(odd(spark), leaning=mixing.middling).collect():
        want[r["doc_id"], r["size"]] += r["copies"]
    mixed = corpus_pipeline.mixture(spark, odd(spark), SMALL).withColumn("words", mixing.n_words(F.col("text")))
    assert Counter((r["doc_id"], r["words"]) for r in mixed.collect()) == +want
    # quality rules: rows without an id, or with a shared one, good and bad
    good = [r for r in documents(spark, SMALL).select("text", "lang", "source").collect() if not base(r["text"])[-1] and base(r["text"])[2] == 0][:20]
    for shared in (None, 5):
        mine = [(shared, r["text"], r["lang"], r["source"]) for r in good] + [(shared, "too short", "en", "a"), (shared, None, None, None)]
        docs = spark.createDataFrame(mine, "doc_id long, text string, lang string, source string")
        assert bag(corpus_pipeline.quality(spark, docs, SMALL)) == Counter(mine[:-2])


def test_stages_leave_what_others_read(spark, tmp_path):
    """Two stages over one table, the first one read last; rows of a file need no copy of it."""
    documents(spark, SMALL).limit(300).write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    first = corpus_pipeline.quality(spark, docs, SMALL)
    second = corpus_pipeline.mixture(spark, docs, SMALL)
    assert second.count() > 0 and first.count() > 0
    assert not any("quality-rows" in f for f in first.inputFiles())
    numbers = numbered(docs, "rows").select("_number")
    assert numbers.distinct().count() == docs.count()
    assert numbers.subtract(numbered(docs.select(*docs.columns), "rows").select("_number")).count() == docs.count()  # a copy's rows have numbers of their own
