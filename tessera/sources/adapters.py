"""Tables of the learning domain, as views over the warehouse tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.operators.shared import tasks_for


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def wiki_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, title, content, source, lang), one row for each document."""
    path = F.concat(F.lit("doc/"), F.col("doc_id").cast("string"), F.lit(".md"))
    return table(spark, sf_dir, "documents").select(path.alias("path"), F.substring("text", 1, 40).alias("title"), F.col("text").alias("content"), "source", "lang")


def attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, kc_id, score, confidence, hint_ladder, ts, event_id): each event as an attempt out of 1."""
    return attempts_of(table(spark, sf_dir, "events"))


def attempts_of(events: DataFrame) -> DataFrame:
    kc = F.get_json_object("props", "$.k").cast("int") % 20
    return events.select(
        "user_id", kc.alias("kc_id"), F.least(F.col("value") / 100, F.lit(1.0)).alias("score"), (1 + F.col("event_id") % 5).alias("confidence"), (F.col("event_id") % 3).alias("hint_ladder"), "ts", "event_id"
    )


def prerequisite_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source, target): parts on consecutive lines of an order, as often as they are.

    Orders are dealt to tasks by the number of lines, so what a task sorts doesn't grow with the table.
    """
    line = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").repartition(line_tasks(spark, sf_dir), "l_orderkey")
    return lines.select(F.col("l_partkey").alias("source"), F.lead("l_partkey").over(line).alias("target")).where("target is not null and source <> target")


def line_tasks(spark: SparkSession, sf_dir: str) -> int:
    """How many tasks share the lines of orders, or edges made of them."""
    return max(tasks_for(table(spark, sf_dir, "lineitem").count()), spark.sparkContext.defaultParallelism)


def prerequisite_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source, target, weight): parts on consecutive lines of an order, and how often they are."""
    return prerequisite_steps(spark, sf_dir).repartition(line_tasks(spark, sf_dir), "source", "target").groupBy("source", "target").agg(F.count(F.lit(1)).alias("weight"))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(session_id, number, part, score, status, day): lines of orders as graded questions out of 1."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("session_id"), F.col("o_orderstatus").alias("status"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))
    lines = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("session_id"), F.col("l_linenumber").alias("number"), F.col("l_partkey").alias("part"), F.least(F.col("l_discount") * 10, F.lit(1.0)).alias("score"))
    return lines.join(orders, "session_id")


#: What learners answer, and what was expected, in turn by event.
RESPONSES = ["I skip the step, it is obvious", "n+1 at the border, or -1", "I confuse both terms", "the angle in degree, not radian", "typo, I forgot the sign", "why is that", "the formula gives 4", "", "四是公式 不清楚"]
EXPECTED = ["the formula gives 4", "two steps, n+1", "radian", "the sign"]


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, user_id, kc_id, ts, response, expected): what was answered in each attempt."""
    pick = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), (F.col("event_id") % len(values) + 1).cast("int"))
    return attempts(spark, sf_dir).select("event_id", "user_id", "kc_id", "ts", pick(RESPONSES).alias("response"), pick(EXPECTED).alias("expected"))


#: Types that pages state; the last is none of the known ones.
PAGE_TYPES = ["concept", "formula", "principle", "source", "synthesis", "inquiry", "guide", "lecture"]


def markup_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, path, title, source, page): each document as a page with front matter, links, lists and references."""
    n = F.col("doc_id")
    m, k = ((n * 7 + 1) % 900).cast("string"), F.floor(n / 3).cast("string")
    kind = F.element_at(F.array(*[F.lit(t) for t in PAGE_TYPES]), (n % 8 + 1).cast("int"))
    head = F.translate(F.coalesce("text", F.lit("")), "\n#[]$()", " ")
    page = F.concat(
        F.lit("---\ntitle: Page "), n.cast("string"), F.lit("\ntype: "), kind, F.lit("\n---\n# Page "), n.cast("string"), F.lit("\n\n"), head, F.lit(" (p."), (n % 9 + 1).cast("string"), F.lit(")。See it [ref:src/a.md#p=3, 4] and [ref:b.md#p="), (n % 4).cast("string"), F.lit("]\n## Relationships\n- Page "),
        n.cast("string"), F.lit(" --[Derives]--> Page "), m, F.lit(": because of it\n* Page "), m, F.lit(" --[unknown]--> Page "), n.cast("string"), F.lit("\nno relation\n## 相关知识\n- Page "), k, F.lit("：reason\n- Page "), m, F.lit(": other\n- Page "), k, F.lit("\n- 待补充\n## Links\n[[doc/"), m,
        F.lit("]] and [[concepts/Page "), k, F.lit(".md|alias]], [[doc/"), m, F.lit("]]\n$$ a = \n  b $$ end\n"),
    )
    return table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("doc/"), n.cast("string"), F.lit(".md")).alias("path"), F.concat(F.lit("Page "), n.cast("string")).alias("title"), "source", page.alias("page"))


MARKUP_SQL = f"""
mp AS (SELECT doc_id, 'doc/' || doc_id || '.md' AS path, 'Page ' || doc_id AS title, source,
  '---\ntitle: Page ' || doc_id || '\ntype: ' || {PAGE_TYPES!r}[doc_id % 8 + 1] || '\n---\n# Page ' || doc_id || '\n\n' || translate(coalesce(text, ''), '\n#[]$()', ' ')
  || ' (p.' || (doc_id % 9 + 1) || ')。See it [ref:src/a.md#p=3, 4] and [ref:b.md#p=' || (doc_id % 4) || ']\n## Relationships\n- Page ' || doc_id || ' --[Derives]--> Page ' || ((doc_id * 7 + 1) % 900) || ': because of it\n* Page ' || ((doc_id * 7 + 1) % 900) || ' --[unknown]--> Page ' || doc_id
  || '\nno relation\n## 相关知识\n- Page ' || (doc_id // 3) || '：reason\n- Page ' || ((doc_id * 7 + 1) % 900) || ': other\n- Page ' || (doc_id // 3) || '\n- 待补充\n## Links\n[[doc/' || ((doc_id * 7 + 1) % 900) || ']] and [[concepts/Page ' || (doc_id // 3) || '.md|alias]], [[doc/' || ((doc_id * 7 + 1) % 900) || ']]\n$$ a = \n  b $$ end\n' AS page FROM documents)"""


#: Types that edges between pages state; some are other names for known ones.
EDGE_KINDS = ["direct", "source", "teaches", "derives", "mentions"]


def page_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source, target, kind, weight): two edges from each document to others, some of which are no pages."""
    n = F.col("doc_id")
    kind = F.element_at(F.array(*[F.lit(t) for t in EDGE_KINDS]), (n % len(EDGE_KINDS) + 1).cast("int"))
    there = F.struct(((n * 7 + 1) % 900).alias("target"), kind.alias("kind"), F.round(0.4 + (n % 10) / 10.0, 1).alias("weight"))
    back = F.struct(F.floor(n / 3).cast("long").alias("target"), F.lit("prerequisite").alias("kind"), F.round(0.3 + (n % 7) / 10.0, 1).alias("weight"))
    return table(spark, sf_dir, "documents").select(n.alias("source"), F.explode(F.array(there, back)).alias("e")).select("source", "e.*").where("source <> target")


PAGE_EDGES_SQL = f"""
pe AS (SELECT * FROM (SELECT doc_id AS source, (doc_id * 7 + 1) % 900 AS target, {EDGE_KINDS!r}[doc_id % {len(EDGE_KINDS)} + 1] AS kind, round(0.4::DOUBLE + (doc_id % 10) / 10.0::DOUBLE, 1) AS weight FROM documents
  UNION ALL SELECT doc_id, doc_id // 3, 'prerequisite', round(0.3::DOUBLE + (doc_id % 7) / 10.0::DOUBLE, 1) FROM documents) WHERE source <> target)"""
