"""Queries over stored records: manifests, caches, listings, one row of a table, graphs made safe to draw, names of pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import markup
from tessera.operators import learner
from tessera.plans import learners, readiness
from tessera.sources.adapters import MARKUP_SQL, PAGE_EDGES_SQL, PAGE_TYPES, attempts, markup_pages, page_edges, table

SQL: dict[str, str] = {}


def _pick(values: list, k: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (k % len(values) + 1).cast("int"))


def source_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source, n_pages, first, last, imported): the pages of each source; imported if it has ten or more."""
    pages = markup_pages(spark, sf_dir).where("source is not null").groupBy("source").agg(F.count_distinct("path").alias("n_pages"), F.min("path").alias("first"), F.max("path").alias("last"))
    return pages.withColumn("imported", F.col("n_pages") >= 10)


SQL["source_manifest"] = f"WITH {MARKUP_SQL} SELECT source, count(DISTINCT path) AS n_pages, min(path) AS first, max(path) AS last, count(DISTINCT path) >= 10 AS imported FROM mp WHERE source IS NOT NULL GROUP BY source"


def ingest_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, sha256, status): each text's digest beside a cached one: absent for odd ids, stale for every tenth, else valid."""
    digest = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    docs = table(spark, sf_dir, "documents").select("doc_id", digest.alias("sha256"))
    cached = docs.where("doc_id % 2 = 0").select("doc_id", F.when(F.col("doc_id") % 10 == 0, F.lit("old")).otherwise(F.col("sha256")).alias("had"))
    status = F.when(F.col("had").isNull(), "absent").when(F.col("had") == F.col("sha256"), "valid").otherwise("stale")
    return docs.join(cached, "doc_id", "left").select("doc_id", "sha256", status.alias("status"))


SQL["ingest_cache"] = "SELECT doc_id, sha256(coalesce(text, '')) AS sha256, CASE WHEN doc_id % 2 = 1 THEN 'absent' WHEN doc_id % 10 = 0 THEN 'stale' ELSE 'valid' END AS status FROM documents"


def mastery_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beliefs of learner 1 as nodes show them: (node_id, score, exposures, level)."""
    p = F.round("p_known", 9)
    level = F.when(p >= learner.MASTERED, "mastered").when(p >= learner.WEAK, "partial").otherwise("attempted")
    return learner.bkt(attempts(spark, sf_dir).where("user_id = 1")).select(F.col("kc_id").alias("node_id"), p.alias("score"), F.col("obs_n").alias("exposures"), level.alias("level"))


SQL["mastery_projection"] = f"{learners._BKT} SELECT kc_id AS node_id, round(p_known, 9) AS score, obs_n AS exposures, CASE WHEN round(p_known, 9) >= 0.85 THEN 'mastered' WHEN round(p_known, 9) >= 0.5 THEN 'partial' ELSE 'attempted' END AS level FROM b WHERE user_id = 1"


def event_tail_of_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last 50 purchases."""
    return table(spark, sf_dir, "events").where("event_type = 'purchase'").orderBy(F.desc("event_id")).limit(50).select("event_id", "user_id", "value")


SQL["event_tail_of_type"] = "SELECT event_id, user_id, value FROM events WHERE event_type = 'purchase' ORDER BY event_id DESC LIMIT 50"


def one_conversation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The messages of conversation 3."""
    return table(spark, sf_dir, "conversations").where("conv_id = 3").select("turn", "role", "text")


SQL["one_conversation"] = "SELECT turn, role, text FROM conversations WHERE conv_id = 3"


def communities_listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Communities by how they hold together: (place, community, member_count, cohesion)."""
    rows = readiness.cohesion(spark, sf_dir)
    return rows.select(F.row_number().over(Window.orderBy(F.desc("cohesion"), "community")).alias("place"), "community", "member_count", "cohesion")  # a row for each community


SQL["communities_listed"] = f"WITH c AS ({readiness.SQL['cohesion']}) SELECT row_number() OVER (ORDER BY cohesion DESC, community)::INT AS place, community, member_count, cohesion FROM c"


def page_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(type, n, first_titles): pages by the type they state, with the first five titles by path."""
    pages = markup_pages(spark, sf_dir).select("path", "title", markup.field(markup.front_matter(F.col("page")), "type").alias("type"))
    k = F.row_number().over(Window.partitionBy("type").orderBy("path"))
    first = pages.withColumn("k", k).where("k <= 5").groupBy("type").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "title"))), lambda x: x["title"]), "|").alias("first_titles"))
    return pages.groupBy("type").agg(F.count(F.lit(1)).alias("n")).join(first, "type")


SQL["page_tree"] = f"WITH {MARKUP_SQL}, t AS (SELECT path, title, {PAGE_TYPES!r}[doc_id % 8 + 1] AS type FROM mp), k AS (SELECT *, row_number() OVER (PARTITION BY type ORDER BY path) AS k FROM t) SELECT type, count(*) AS n, string_agg(title, '|' ORDER BY k) FILTER (k <= 5) AS first_titles FROM k GROUP BY type"


def drawn_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source, target, edge_type, weight): edges safe to draw, of types that are shown: trimmed ends that are nodes, no loops, types and weights filled in."""
    n = F.col("source")
    raw = page_edges(spark, sf_dir).select(F.concat(F.lit(" "), n.cast("string")).alias("source"), F.col("target").cast("string").alias("target"), F.when(n % 7 > 0, F.col("kind")).alias("edge_type"), F.when(n % 11 > 0, F.col("weight")).when(n % 2 == 0, float("nan")).alias("weight"))
    edges = raw.select(F.trim("source").alias("source"), F.trim("target").alias("target"), F.coalesce("edge_type", F.lit("related")).alias("edge_type"), F.when(F.isnan("weight") | F.col("weight").isNull(), 1.0).otherwise(F.col("weight")).alias("weight"))
    nodes = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("target"))
    return edges.where("source <> '' and target <> '' and source <> target and edge_type <> 'mentions'").join(nodes, "target", "left_semi").select("source", "target", "edge_type", "weight")


SQL["drawn_graph"] = f"""WITH {PAGE_EDGES_SQL} SELECT source::VARCHAR AS source, target::VARCHAR AS target, CASE WHEN source % 7 > 0 THEN kind ELSE 'related' END AS edge_type, CASE WHEN source % 11 > 0 THEN weight ELSE 1.0::DOUBLE END AS weight FROM pe
WHERE target IN (SELECT doc_id FROM documents) AND CASE WHEN source % 7 > 0 THEN kind ELSE 'related' END <> 'mentions'"""


def resolved_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, dst, node): the pages that relationship lines name, by file name or by title, whatever its case; null for none."""
    pages = markup_pages(spark, sf_dir)
    named = pages.select("doc_id", F.inline(markup.relationships(F.col("page")))).select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.upper("dst")).otherwise(F.concat(F.lit("doc/"), F.regexp_extract("dst", "([0-9]+)", 1), F.lit(".md"))).alias("dst"))
    keys = pages.select(F.explode(F.array(F.lower("title"), F.lower(F.regexp_replace("path", r"\.md$", "")))).alias("key"), F.col("doc_id").alias("node")).groupBy("key").agg(F.min("node").alias("node"))
    return named.withColumn("key", F.lower(F.regexp_replace("dst", r"\.md", ""))).join(keys, "key", "left").select("doc_id", "dst", "node")


SQL["resolved_ends"] = """
WITH e AS (SELECT doc_id, unnest([(doc_id * 7 + 1) % 900, doc_id]) AS d FROM documents), n AS (SELECT doc_id, d, CASE WHEN doc_id % 2 = 0 THEN 'PAGE ' || d ELSE 'doc/' || d || '.md' END AS dst FROM e)
SELECT n.doc_id, dst, x.doc_id AS node FROM n LEFT JOIN documents x ON x.doc_id = d"""


def scope_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, score): the first eight pages by path of one source, by its name in sources, title or path; 90 and one less each."""
    pages = markup_pages(spark, sf_dir).where((F.col("source") == "src5") | F.contains("title", F.lit("src5")) | F.contains("path", F.lit("src5")))
    best = pages.orderBy("path").limit(8)
    return best.select("path", (91.0 - F.row_number().over(Window.orderBy("path"))).alias("score"))  # eight rows


SQL["scope_seeds"] = f"WITH {MARKUP_SQL}, b AS (SELECT path FROM mp WHERE source = 'src5' OR contains(title, 'src5') OR contains(path, 'src5') ORDER BY path LIMIT 8) SELECT path, 91.0::DOUBLE - row_number() OVER (ORDER BY path) AS score FROM b"

#: Texts with pictures and what is left of them; labels and their variants; files and what tells their pages.
PICTURES = [("a ![x](y.png) b", "a  b"), ("<img src='z'/>text", "text"), ("see fig_1.JPG and\n( )\nmore", "see  and\n\nmore"), ("/api/media/a/b) end\n\n\n\nnext", ") end\n\nnext"), ("plain", "plain")]
LABELS = [("Fatigue (metal) Limit", "fatigue (metal) limit|fatigue limit"), ("Stress/Strain", "stress/strain|stress|strain"), (" A  b ", "a b"), ("拉伸、压缩", "拉伸、压缩|拉伸|压缩"), ("x/yy", "x/yy|yy")]
FILES = [("a/第3讲 晶体.pdf", "体|晶体|第3讲 晶体|讲 晶体"), ("steel-notes v2.docx", "notes|steel|steel-notes v2|v2"), ("课件.pptx", "")]


def text_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, text, variants, path): texts without pictures, labels' variants, and the files that pages of each type get."""
    n = F.col("doc_id")
    return table(spark, sf_dir, "documents").select("doc_id", markup.without_images(_pick([a for a, _ in PICTURES], n)).alias("text"), F.array_join(markup.label_variants(_pick([a for a, _ in LABELS], n)), "|").alias("variants"), markup.page_path(_pick(["formula", "synthesis", "learning_objective", "topic"], n), F.concat(F.lit("No "), n.cast("string"))).alias("path"))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


SQL["text_rules"] = f"""SELECT doc_id, [{', '.join(_quoted(b) for _, b in PICTURES)}][doc_id % {len(PICTURES)} + 1] AS text, [{', '.join(_quoted(b) for _, b in LABELS)}][doc_id % {len(LABELS)} + 1] AS variants,
  ['formulas', 'synthesis', 'objectives', 'topics'][doc_id % 4 + 1] || '/No_' || doc_id || '.md' AS path FROM documents"""


def evidence_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, file, page, known): the pages that references name, and whether that page of the file was read (its first three were)."""
    from tessera.plans.pages import cite_refs

    refs = cite_refs(spark, sf_dir).select("doc_id", "file", "page")
    read = refs.select("file").distinct().withColumn("page", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3)))).withColumn("known", F.lit(True))
    return refs.join(read, ["file", "page"], "left").select("doc_id", "file", "page", F.coalesce("known", F.lit(False)).alias("known"))


SQL["evidence_pages"] = "SELECT doc_id, file, page::INT AS page, page BETWEEN 1 AND 3 AS known FROM (SELECT doc_id, 'src/a.md' AS file, unnest([3, 4]) AS page FROM documents UNION ALL SELECT doc_id, 'b.md', doc_id % 4 FROM documents)"

QUERIES = {f.__name__: f for f in (source_manifest, ingest_cache, mastery_projection, event_tail_of_type, one_conversation, communities_listed, page_tree, drawn_graph, resolved_ends, scope_seeds, text_rules, evidence_pages)}
