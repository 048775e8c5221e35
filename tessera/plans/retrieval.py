"""Queries over pages: keyword and vector search, tokens, links, titles, quotes."""

from __future__ import annotations

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions import text
from tessera.operators.ordering import positions
from tessera.operators.shared import join_groups, small, written
from tessera.sources.adapters import table, wiki_pages

#: Words that queries pass over.
STOP_WORDS = (
    "的", "是", "了", "什么", "在", "有", "和", "与", "对", "从", "不", "也", "就", "都",
    "the", "is", "a", "an", "what", "how", "are", "was", "were",
    "do", "does", "did", "be", "been", "being", "have", "has", "had",
    "it", "its", "in", "on", "at", "to", "for", "of", "with", "by",
    "this", "that", "these", "those", "can", "will", "would", "could",
)
#: The words that the registered search looks for.
WANTED = ["license", "email", "water", "la"]
_PAGES = "SELECT 'doc/' || doc_id || '.md' AS path, substring(text, 1, 40) AS title, text AS content, source, lang FROM documents"


def keyword_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best pages by token places in title and body, with a snippet; ties by path.

    Texts are lowered once for the score; pages without a token leave only after the 20 best are taken,
    so no condition counts anew, and snippets are made for these alone.
    """
    pages = wiki_pages(spark, sf_dir).withColumns({"low_title": F.lower("title"), "low": F.lower("content")})
    pages = pages.withColumn("score", text.keyword_score(F.col("low_title"), F.col("low"), WANTED)).drop("low", "low_title")
    best = pages.orderBy(F.desc("score"), "path").limit(20).where("score > 0")
    in_title = F.greatest(*[F.contains(F.lower("title"), F.lit(t)) for t in WANTED])
    return best.select("path", "title", "score", in_title.alias("title_match"), text.snippet(F.col("content"), WANTED).alias("snippet"))


_SCORE = " + ".join(f"CASE WHEN contains(lower(title), '{t}') THEN 10.0::DOUBLE ELSE 0.0::DOUBLE END + least((length(body) - length(replace(body, '{t}', ''))) // {len(t)}, 5)::DOUBLE" for t in WANTED)
_AT = "least(" + ", ".join(f"nullif(instr(body, '{t}'), 0)" for t in WANTED) + ") - 1"
_ANY = " OR ".join(f"contains(lower(title), '{t}')" for t in WANTED)
SQL = {
    "keyword_search": f"""
WITH p AS ({_PAGES}), l AS (SELECT *, lower(content) AS body FROM p),
s AS (SELECT *, {_SCORE} AS score FROM l), b AS (SELECT *, {_AT} AS pos FROM s WHERE score > 0 ORDER BY score DESC, path LIMIT 20)
SELECT path, title, score, ({_ANY}) AS title_match, CASE WHEN pos IS NULL THEN substring(content, 1, 200)
  ELSE (CASE WHEN pos > 80 THEN '...' ELSE '' END) || substring(content, greatest(0, pos - 80) + 1, least(length(content), pos + 120) - greatest(0, pos - 80)) || (CASE WHEN pos + 120 < length(content) THEN '...' ELSE '' END) END AS snippet
FROM b""",
}


def tokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The distinct tokens of each whole page in order of their characters: how many, and a digest of them joined by spaces."""
    found = F.array_sort(text.tokens(F.col("content"), STOP_WORDS))
    return wiki_pages(spark, sf_dir).select("path", F.size(found).cast("long").alias("n_tokens"), F.md5(F.array_join(found, " ").cast("binary")).alias("tokens_md5"))


_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)
SQL["tokenize"] = f"""
WITH p AS ({_PAGES}), t AS (SELECT path, list_sort(list_distinct(list_filter(regexp_split_to_array(lower(content), '[\\s,，。！？、；：""（）()\\-_/·~～…]+'), lambda t: length(t) > 1 AND NOT list_contains([{_STOP}], t)))) AS t FROM p)
SELECT path, len(t) AS n_tokens, md5(array_to_string(t, ' ')) AS tokens_md5 FROM t"""


def page_scan_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = wiki_pages(spark, sf_dir)
    return pages.select("path", "title", "lang", F.substring("content", 1, 200).alias("summary"), F.length("content").cast("long").alias("n_chars"))


SQL["page_scan_summary"] = f"SELECT path, title, lang, substring(content, 1, 200) AS summary, length(content)::BIGINT AS n_chars FROM ({_PAGES})"


def title_resolver(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, path): lower-cased titles, paths and bare names lead to a page, the first by path where they are shared."""
    pages = wiki_pages(spark, sf_dir)
    bare = F.regexp_replace("path", r"\.md$", "")
    keys = F.explode(F.array(F.lower("title"), F.lower("path"), F.lower(bare), F.lower(F.regexp_replace(bare, "^.*/", ""))))
    return pages.select(keys.alias("key"), "path").where("key is not null").groupBy("key").agg(F.min("path").alias("path"))


SQL["title_resolver"] = f"""
WITH p AS ({_PAGES}), k AS (SELECT unnest([lower(title), lower(path), lower(regexp_replace(path, '\\.md$', '')), lower(regexp_replace(regexp_replace(path, '\\.md$', ''), '^.*/', ''))]) AS key, path FROM p)
SELECT key, min(path) AS path FROM k WHERE key IS NOT NULL GROUP BY key"""


def html_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    title = F.regexp_extract("html", "<title>([^<]*)</title>", 1)
    return table(spark, sf_dir, "pages").select("page_id", F.trim(title).alias("title"))


SQL["html_title"] = "SELECT page_id, trim(regexp_extract(html, '<title>([^<]*)</title>', 1)) AS title FROM pages"


def html_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, href, n): the links of each page."""
    links = F.explode(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1)))
    return table(spark, sf_dir, "pages").select("page_id", links.alias("href")).groupBy("page_id", "href").agg(F.count(F.lit(1)).alias("n"))


SQL["html_links"] = """SELECT page_id, href, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS href FROM pages) GROUP BY ALL"""


def link_graph_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(href, degree_in): pages that link to each target."""
    return html_links(spark, sf_dir).groupBy("href").agg(F.count(F.lit(1)).alias("degree_in"))


SQL["link_graph_degree"] = """SELECT href, count(DISTINCT page_id) AS degree_in FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"]+)"', 1)) AS href FROM pages) GROUP BY href"""


def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 vectors nearest to vector 0 by cosine; ties by id. The query is one row, hence broadcast."""
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    query = rows.where("vec_id = 0").agg(F.min("v").alias("q")).where("q is not null")  # one row, the least vector of that id
    near = rows.where("vec_id <> 0").join(F.broadcast(query))
    similarity = F.round(dot(F.col("v"), F.col("q")) / F.sqrt(dot(F.col("v"), F.col("v")) * dot(F.col("q"), F.col("q"))), 6)
    return near.select("vec_id", similarity.alias("similarity")).orderBy(F.desc("similarity"), "vec_id").limit(20)


SQL["vector_topk"] = """
WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings)
SELECT e.vec_id, round(list_cosine_similarity(e.v, q.v), 6) AS similarity FROM e, e q WHERE q.vec_id = 0 AND e.vec_id <> 0 ORDER BY similarity DESC, e.vec_id LIMIT 20"""


def shared_source_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of one source: each with the next three by path, or, in a source with pages of type source, these with all others.

    Which pages are of that type is stated by id here. Places come from a sort by ranges, so no source
    meets in one task; stars are as large as the sources that have such pages.
    """
    pages = wiki_pages(spark, sf_dir).where("source is not null").select("source", "path", F.endswith("path", F.lit("77.md")).alias("star"))
    placed = positions(pages, ["source", "path"])
    starred = small(placed.where("star").select("source").distinct(), "starred-sources")
    lone = placed.join(starred, "source", "left_anti")
    ahead = lone.select("source", F.col("path").alias("a"), F.explode(F.array(*[F.col("position") + k for k in (1, 2, 3)])).alias("position"))
    near = ahead.join(lone.select("source", F.col("path").alias("b"), "position"), ["source", "position"]).select("source", "a", "b")
    each = placed.join(starred, "source", "left_semi").select("source", "path", "star").distinct()
    met = join_groups(each, each.where("star").select("source", F.col("path").alias("hub")), "source")
    stars = met.where("path <> hub AND (NOT star OR path < hub)").select("source", F.least("path", "hub").alias("a"), F.greatest("path", "hub").alias("b"))
    return near.unionByName(stars)


SQL["shared_source_pairs"] = f"""
WITH p AS (SELECT source, path, row_number() OVER (PARTITION BY source ORDER BY path) AS k, ends_with(path, '77.md') AS star FROM ({_PAGES}) WHERE source IS NOT NULL), s AS (SELECT DISTINCT source FROM p WHERE star)
SELECT x.source, x.path AS a, y.path AS b FROM p x JOIN p y ON x.source = y.source AND y.k BETWEEN x.k + 1 AND x.k + 3 WHERE x.source NOT IN (FROM s)
UNION ALL SELECT DISTINCT x.source, least(x.path, y.path), greatest(x.path, y.path) FROM p x JOIN p y ON x.source = y.source AND x.path <> y.path WHERE y.star"""

#: Quotes that are broadcast at once.
QUOTES = 50_000


def quotes_found(docs: DataFrame, quotes: DataFrame, most: int = 5) -> DataFrame:
    """(item_id, doc_id, places): where quotes stand in texts, ``most`` places without overlaps from 1 on.

    Quotes go in groups of bounded size, which are broadcast as one automaton each; a text is read once
    for a group, however many quotes it has. Empty quotes stand nowhere.
    """
    quotes = written(quotes.where(F.length("quote") > 0).select("item_id", "quote"), "quotes")
    n_groups = max(1, -(-quotes.count() // QUOTES))
    out = None
    for group in range(n_groups):
        rows = quotes.where(F.pmod(F.xxhash64("item_id"), F.lit(n_groups)) == group).collect()  # about QUOTES rows
        wanted: dict[str, list[int]] = {}
        for r in rows:
            wanted.setdefault(r["quote"], []).append(r["item_id"])
        told = docs.sparkSession.sparkContext.broadcast(wanted)

        def find(frames, told=told):
            tree = ahocorasick.Automaton()
            for quote in told.value:
                tree.add_word(quote, quote)
            tree.make_automaton()
            for frame in frames:
                found = []
                for doc, text in zip(frame["doc_id"].tolist(), frame["text"].tolist(), strict=True):
                    places: dict[str, list[int]] = {}
                    for end, quote in tree.iter(text) if len(told.value) else ():
                        mine, start = places.setdefault(quote, []), end + 2 - len(quote)
                        if len(mine) < most and (not mine or start >= mine[-1] + len(quote)):
                            mine.append(start)
                    found += [(item, doc, at) for quote, at in places.items() for item in told.value[quote]]
                yield pd.DataFrame(found, columns=["item_id", "doc_id", "places"])

        part = docs.where("doc_id is not null and text is not null").select("doc_id", "text").mapInPandas(find, "item_id long, doc_id long, places array<int>")
        out = part if out is None else out.unionByName(part)
    return out


def quote_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item_id, doc_id, places): where benchmark texts, their first words and a few short quotes stand in documents."""
    full = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("quote"))
    short = full.where("item_id < 5").select((F.col("item_id") + 1000).alias("item_id"), F.substring_index("quote", " ", 2).alias("quote"))
    odd = spark.createDataFrame([(2000, "è"), (2001, "é d"), (2002, "no such words")], "item_id long, quote string")
    found = quotes_found(table(spark, sf_dir, "documents").where("text is not null").select("doc_id", "text"), full.unionByName(short).unionByName(odd))
    return found.select("item_id", "doc_id", F.array_join(F.transform("places", lambda x: x.cast("string")), ",").alias("places"))


SQL["quote_offsets"] = """
WITH q AS (SELECT item_id, text AS quote FROM benchmark UNION ALL SELECT item_id + 1000, string_split(text, ' ')[1] || ' ' || string_split(text, ' ')[2] FROM benchmark WHERE item_id < 5 UNION ALL VALUES (2000, 'è'), (2001, 'é d'), (2002, 'no such words')),
f AS (SELECT item_id, doc_id, quote, string_split(text, quote) AS parts FROM documents JOIN q ON contains(text, quote)),
g AS (SELECT *, list_transform(range(1, least(5, len(parts) - 1) + 1), lambda k: 1 + list_sum(list_transform(parts[1:k], lambda x: length(x)))::BIGINT + (k - 1) * length(quote)) AS places FROM f)
SELECT item_id, doc_id, array_to_string(places, ',') AS places FROM g"""


#: Where sentences end: at line breaks and at the ideographic and ASCII forms of full stops, exclamation and question marks and semicolons.
SENTENCE = r"[\n。！？；;!?]+"


def sentence_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, n_sentences, longest): sentences by SENTENCE."""
    parts = F.filter(F.transform(F.split("content", SENTENCE), lambda s: F.trim(s)), lambda s: s != "")
    return wiki_pages(spark, sf_dir).select("path", F.size(parts).cast("long").alias("n_sentences"), F.array_max(F.transform(parts, lambda s: F.length(s))).cast("long").alias("longest"))


SQL["sentence_counts"] = f"""
SELECT path, len(s) AS n_sentences, list_max(list_transform(s, lambda x: length(x))) AS longest
FROM (SELECT path, list_filter(list_transform(regexp_split_to_array(content, '[\\n。！？；;!?]+'), lambda x: trim(x)), lambda x: x <> '') AS s FROM ({_PAGES}))"""


def conversation_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, title, message_count): titles begin the first user message."""
    said = F.when(F.col("role") == "user", F.col("turn"))
    turns = table(spark, sf_dir, "conversations")
    return turns.groupBy("conv_id").agg(F.substring(F.min_by("text", said), 1, 50).alias("title"), F.count(F.lit(1)).alias("message_count"))


SQL["conversation_list"] = "SELECT conv_id, substring(arg_min(text, CASE WHEN role = 'user' THEN turn END), 1, 50) AS title, count(*) AS message_count FROM conversations GROUP BY conv_id"

QUERIES = {f.__name__: f for f in (keyword_search, tokenize, page_scan_summary, title_resolver, html_title, html_links, link_graph_degree, vector_topk, shared_source_pairs, quote_offsets, sentence_counts, conversation_list)}
