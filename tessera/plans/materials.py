"""Queries over texts' atoms and found communities: labels of a table, relation candidates, repair, bridges, highlights, communities."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from tessera.functions import markup
from tessera.operators import bridging, candidates, communities, evidence, graph
from tessera.operators.labels import labels_in
from tessera.operators.ordering import positions
from tessera.operators.shared import written
from tessera.sources import adapters
from tessera.sources.adapters import table

SQL: dict[str, str] = {}


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(label, term): the words of nine letters or more of the benchmark's texts, and each two words that begin with such a one."""
    words = F.split(F.lower(F.regexp_replace(F.coalesce("text", F.lit("")), r"[^\p{L}]+", " ")), " ")
    items = table(spark, sf_dir, "benchmark").select(words.alias("w")).select("w", F.posexplode("w").alias("k", "word")).where(F.length("word") >= 9)
    two = F.concat_ws(" ", "word", F.get("w", F.col("k") + 1))
    return items.select(F.explode(F.array("word", two)).alias("label")).where("label <> ''").select(F.trim("label").alias("label")).distinct().withColumn("term", F.col("label"))


def table_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, n_labels, labels_md5): the labels of the table that stand in each document."""
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), "text")
    found = labels_in(texts, _labels(spark, sf_dir))
    return found.groupBy(F.col("doc").alias("doc_id")).agg(F.count(F.lit(1)).alias("n_labels"), F.md5(F.array_join(F.array_sort(F.collect_list("label")), ",").cast("binary")).alias("labels_md5"))


SQL["table_mentions"] = r"""
WITH w AS (SELECT string_split(lower(regexp_replace(coalesce(text, ''), '[^\p{L}]+', ' ', 'g')), ' ') AS w FROM benchmark),
k AS (SELECT w, unnest(range(1, len(w) + 1)) AS k FROM w),
l AS (SELECT DISTINCT trim(unnest([w[k], concat_ws(' ', w[k], w[k + 1])])) AS label FROM k WHERE length(w[k]) >= 9),
d AS (SELECT doc_id, lower(text) AS text FROM documents WHERE text IS NOT NULL)
SELECT doc_id, count(*) AS n_labels, md5(string_agg(label, ',' ORDER BY label)) AS labels_md5 FROM d JOIN l ON contains(text, label) GROUP BY doc_id"""


def _atoms(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(texts, nodes): documents, and as atoms of each the labels that stand in it, twenty at most by hash; types by hash."""
    texts = table(spark, sf_dir, "documents").where("doc_id IS NOT NULL").select(F.col("doc_id").alias("doc"), "text")
    found = labels_in(texts, _labels(spark, sf_dir))
    place = F.row_number().over(Window.partitionBy("doc").orderBy(F.crc32("label"), "label"))
    kind = F.element_at(F.array(*map(F.lit, candidates.NODE_TYPES)), (F.crc32(F.concat(F.lit("type "), "label")) % len(candidates.NODE_TYPES) + 1).cast("int"))
    nodes = found.withColumn("place", place).where("place <= 20").select("doc", "place", F.md5(F.col("label").cast("binary")).alias("node"), "label", kind.alias("node_type"), F.lit(None).cast("string").alias("source_term"))
    return texts, written(nodes, "atoms")


def relation_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hypotheses of each document about its atoms, up to 48, with what they rest on."""
    texts, nodes = _atoms(spark, sf_dir)
    return candidates.relation_candidates(texts, nodes).withColumnRenamed("doc", "doc_id")


def repaired_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges from statements: hypotheses as a careless model repeats them, every other one turned round, every third one plain, by label in capitals."""
    texts, nodes = _atoms(spark, sf_dir)
    found = written(candidates.relation_candidates(texts, nodes), "candidates")
    named = [nodes.select("doc", F.col("node").alias(c), F.upper("label").alias(f"{c}_label")) for c in ("source", "target")]
    said = found.join(named[0], ["doc", "source"]).join(named[1], ["doc", "target"])
    odd = F.col("place") % 2 == 1
    stated = said.select(
        "doc", "place", F.when(odd, F.col("target_label")).otherwise(F.col("source_label")).alias("source"), F.when(odd, F.col("source_label")).otherwise(F.col("target_label")).alias("target"),
        F.when(F.col("place") % 3 == 0, "related").otherwise(F.col("edge_type")).alias("edge_type"), "evidence", F.when(F.col("place") % 5 > 0, F.col("score")).alias("confidence"),
    )
    return candidates.repaired_relations(stated, nodes, found).withColumnRenamed("doc", "doc_id")


def component_bridges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges that join the components of parts ordered together twice, chosen among all that were ordered together; the nearer in price the better."""
    edges = written(adapters.prerequisite_edges(spark, sf_dir), "part-edges")  # read for the components and for what is offered
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_retailprice", "p_name")
    ends = [parts.select(F.col("p_partkey").alias(c), F.col("p_retailprice").cast("double").alias(f"{c}_price"), F.col("p_name").alias(f"{c}_name")) for c in ("source", "target")]
    near = F.round(1 / (1 + F.abs(F.col("source_price") - F.col("target_price")) / 100), 3)
    offered = edges.where("weight = 1").join(ends[0], "source").join(ends[1], "target")
    evidence = F.when(F.substring_index("source_name", " ", 1) == F.substring_index("target_name", " ", 1), F.concat_ws(" / ", "source_name", "target_name"))
    offered = offered.select("source", "target", F.lit("related").alias("edge_type"), evidence.alias("evidence"), near.alias("score"), F.lit("ordered together").alias("reason"))
    return bridging.bridges(parts.select(F.col("p_partkey").alias("node")), edges.where("weight > 1"), offered)


def question_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item_id, place, doc_id, origin, score, chars, cut, relations): pages read for each benchmark text as a question.

    Seeds are the documents that share most of its long words; with no model to ask, rounds follow the best edge.
    """
    items = table(spark, sf_dir, "benchmark")
    words = F.filter(F.split(F.lower(F.regexp_replace(F.coalesce("text", F.lit("")), r"[^\p{L}]+", " ")), " "), lambda w: F.length(w) >= 9)
    words = items.select("item_id", F.explode(words).alias("label")).distinct()
    docs = table(spark, sf_dir, "documents").where("doc_id IS NOT NULL").select(F.col("doc_id").alias("doc"), "text")
    held = labels_in(docs, words.select("label", F.col("label").alias("term")).distinct())
    shared = held.join(words, "label").groupBy("item_id", "doc").agg(F.count(F.lit(1)).cast("double").alias("score"))
    # a common word meets many pages, of which a question needs the eight best
    best = shared.withColumn("k", F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), "doc"))).where("k <= 8")
    seeds = written(best.select(F.col("item_id").alias("question"), F.col("doc").alias("node"), F.lit(False).alias("title_match"), "score"), "question-seeds")
    nodes = docs.select(F.col("doc").alias("node"), F.concat(F.lit("Page "), F.col("doc").cast("string")).alias("title"), F.length(markup.without_images(F.coalesce("text", F.lit("")))).alias("size"))
    edges = adapters.page_edges(spark, sf_dir).withColumnRenamed("kind", "edge_type")
    found = evidence.collect_evidence(items.select(F.col("item_id").alias("question")), seeds, nodes, edges)
    links = found.relations.groupBy("question").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(">", "source", "target"))), ",").alias("relations"))
    out = found.pages.join(links, "question", "left")
    return out.select(F.col("question").alias("item_id"), "place", F.col("node").alias("doc_id"), "origin", "score", "chars", "cut", F.coalesce("relations", F.lit("")).alias("relations"))


def places(text: str, query: str, most: int = 3) -> list[tuple[int, int]]:
    """(start, end) of a query in a text: exact places first, without overlaps, then places where only white space differs, ``most`` in all.

    The second kind repeats places of the first, and ends where the next character that is no white space begins.
    """
    out, at = [], text.find(query) if query else -1
    while at >= 0 and len(out) < most:
        out.append((at, at + len(query)))
        at = text.find(query, at + len(query))
    bare = [k for k, c in enumerate(text) if not c.isspace()] if query and len(out) < most else []
    held, wanted = "".join(text[k] for k in bare), "".join(query.split())
    at = held.find(wanted) if wanted else -1
    bare.append(len(text))
    while at >= 0 and len(out) < most:
        out.append((bare[at], bare[at + len(wanted)]))
        at = held.find(wanted, at + len(wanted))
    return out


def _stripped(text: str) -> str:
    return "".join(text.split())


def highlights(docs: DataFrame, queries: DataFrame) -> DataFrame:
    """(item_id, doc_id, places): where queries (item_id, query) stand in texts (doc_id, text), white space aside: struct start, end.

    Pairs of a text and a query it holds come of one reading of the texts, whatever the number of queries; only they are looked
    at again. Null and empty queries, and those of white space alone, stand nowhere. Rows of an id are rows of their own.
    """
    rows = written(docs.where("text IS NOT NULL").select(F.monotonically_increasing_id().alias("doc"), "doc_id", "text"), "texts")
    wanted = queries.where("query IS NOT NULL").select("item_id", "query")
    found = labels_in(rows.select("doc", "text"), wanted.select(F.col("item_id").alias("label"), F.regexp_replace("query", r"(?U)\s+", "").alias("term")), prepare=_stripped)
    pairs = found.join(wanted.withColumnRenamed("item_id", "label"), "label").join(rows, "doc").select(F.col("label").alias("item_id"), "doc_id", "text", "query")
    kinds = {f.name: f for f in pairs.schema.fields}
    schema = StructType([kinds["item_id"], kinds["doc_id"], *StructType.fromDDL("places array<struct<start:int,end:int>>").fields])

    def look(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame[["item_id", "doc_id"]].assign(places=[places(t, q) for t, q in zip(frame["text"], frame["query"], strict=True)])

    return pairs.mapInPandas(look, schema)


def page_highlights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item_id, doc_id, places): the benchmark's texts, as they are and with white space added or lost, in documents."""
    items = table(spark, sf_dir, "benchmark").where("text IS NOT NULL").select("item_id", "text")
    ways = [F.col("text"), F.regexp_replace("text", " ", "\n  "), F.regexp_replace("text", r"\. ", ".")]
    asked = items.select(F.posexplode(F.array(*ways)).alias("k", "query"), "item_id").select((F.col("item_id") * 3 + F.col("k")).alias("item_id"), "query")
    found = highlights(table(spark, sf_dir, "documents"), asked)
    return found.select("item_id", "doc_id", F.array_join(F.transform("places", lambda p: F.concat_ws("-", p["start"], p["end"])), ",").alias("places"))


SQL["page_highlights"] = r"""
WITH q AS (SELECT item_id * 3 + k AS item_id, [text, replace(text, ' ', chr(10) || '  '), replace(text, '. ', '.')][k + 1] AS query FROM benchmark, range(3) AS r(k) WHERE text IS NOT NULL),
n AS (SELECT item_id, query, regexp_replace(query, '\s+', '', 'g') AS nq FROM q),
d AS (SELECT doc_id, text, regexp_replace(text, '\s+', '', 'g') AS nt FROM documents WHERE text IS NOT NULL),
m AS (SELECT item_id, doc_id, query, nq, text, string_split(text, query) AS e, string_split(nt, nq) AS s FROM d JOIN n ON contains(nt, nq)),
p AS (SELECT *, list_transform(range(1, len(e)), lambda k: list_sum(list_transform(e[1:k], lambda x: length(x)))::BIGINT + (k - 1) * length(query)) AS ea,
  list_transform(range(1, len(s)), lambda k: list_sum(list_transform(s[1:k], lambda x: length(x)))::BIGINT + (k - 1) * length(nq)) AS sa,
  list_append(list_transform(list_filter(list_zip(string_split(text, ''), range(0, length(text))), lambda z: NOT regexp_matches(z[1], '^\s$')), lambda z: z[2]), length(text)) AS bare FROM m)
SELECT item_id, doc_id, array_to_string(list_concat(list_transform(ea[1:3], lambda a: a || '-' || (a + length(query))), list_transform(sa, lambda a: bare[a + 1] || '-' || bare[a + length(nq) + 1]))[1:3], ',') AS places FROM p"""


def louvain_communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(node, community): parts by what is ordered together, as communities of greatest modularity."""
    return _louvain(adapters.prerequisite_edges(spark, sf_dir), spark, sf_dir)


def _louvain(edges: DataFrame, spark: SparkSession, sf_dir: str) -> DataFrame:
    return communities.louvain(edges, table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node")))


def propagated_communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(node, community): parts by the label most of their neighbours have, weighted by how often they were ordered together."""
    return communities.label_propagation(adapters.prerequisite_edges(spark, sf_dir), table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node")), weight="weight")


def _found(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(members, edges, described) of the communities that are found, not given."""
    edges = written(adapters.prerequisite_edges(spark, sf_dir), "community-edges")  # four passes read it
    members = written(_louvain(edges, spark, sf_dir), "members")
    return members, edges, written(communities.described(members, edges, graph.degrees(edges)), "communities")


def found_communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Found communities, largest first: label, members, edges inside, how they hold together, and the node drawn largest."""
    _, _, rows = _found(spark, sf_dir)
    placed = positions(rows.withColumn("_less", -F.col("member_count")), ["_less", "community"]).drop("_less")
    return placed.select("community", F.concat(F.lit("Cluster "), F.col("position").cast("string")).alias("label"), "member_count", "internal", "cohesion", "top_node")


def community_insights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(insight_type, title, score), best first: nodes that nothing links, found communities that hold together badly, nodes between three or more of them."""
    members, edges, rows = _found(spark, sf_dir)
    pairs = written(graph.both_ways(edges), "community-pairs")
    few = members.join(pairs.groupBy(F.col("a").alias("node")).agg(F.count(F.lit(1)).alias("d")), "node", "left").agg(F.count_if(F.coalesce("d", F.lit(0)) <= 1).alias("n")).where("n > 0")
    few = few.select(F.lit("knowledge_gap").alias("insight_type"), F.concat(F.col("n").cast("string"), F.lit(" isolated knowledge points")).alias("title"), (F.col("n") * 0.5).alias("score"))
    sparse = rows.where("cohesion < 0.15 AND member_count >= 3").select(F.lit("knowledge_gap").alias("insight_type"), F.concat(F.lit("Sparse community: "), F.col("community").cast("string")).alias("title"), F.round((1 - F.col("cohesion")) * 2, 6).alias("score"))
    near = pairs.join(members.select(F.col("node").alias("b"), "community"), "b").groupBy("a").agg(F.count_distinct("community").alias("n")).where("n >= 3")
    bridges = near.select(F.lit("bridge").alias("insight_type"), F.concat(F.lit("Bridge concept: "), F.col("a").cast("string")).alias("title"), (F.col("n") * 1.5).alias("score"))
    every = written(few.unionByName(sparse).unionByName(bridges).where("score >= 1.5").withColumn("_less", -F.col("score")), "insights")  # a sort by ranges reads it twice
    return positions(every, ["_less", "insight_type", "title"]).select(F.col("position").alias("place"), "insight_type", "title", "score")


QUERIES = {f.__name__: f for f in (table_mentions, relation_candidates, repaired_relations, component_bridges, question_evidence, page_highlights, louvain_communities, propagated_communities, found_communities, community_insights)}
