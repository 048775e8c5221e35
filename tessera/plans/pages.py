"""Queries over markdown pages: front matter, links, sections, relationships, citations, titles, page indexes and chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import markup
from tessera.sources.adapters import MARKUP_SQL, markup_pages, table

_P = rf"""{MARKUP_SQL}, mb AS (SELECT *, regexp_extract(page, '(?s)^---\n(.*?)\n---\n', 1) AS front, regexp_replace(page, '(?s)^---\n.*?\n---\n', '') AS body FROM mp),
ms AS (SELECT *, string_split(chr(10) || body, chr(10) || '## ') AS parts FROM mb)"""
_PART = "trim(coalesce(list_filter(parts, lambda x: starts_with(lower(x), '{0}' || chr(10)))[1][{1}:], ''), chr(10) || ' ')"
SQL: dict[str, str] = {}


def _bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markup_pages(spark, sf_dir).withColumns({"front": markup.front_matter(F.col("page")), "body": markup.body(F.col("page"))})


def frontmatter_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each page's title and type from its front matter, and a digest of the rest."""
    front = F.col("front")
    return _bodies(spark, sf_dir).select("doc_id", markup.field(front, "title").alias("title"), markup.field(front, "type").alias("type"), markup.field(front, "tags").alias("tags"), F.md5(F.col("body").cast("binary")).alias("body_md5"))


SQL["frontmatter_split"] = f"WITH {_P} SELECT doc_id, regexp_extract(front, 'title: (.*)', 1) AS title, regexp_extract(front, 'type: (.*)', 1) AS type, NULL::VARCHAR AS tags, md5(body) AS body_md5 FROM mb"


def pages_of_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose type, unknown ones counting as concepts, is concept."""
    kind = markup.node_type(markup.field(F.col("front"), "type"))
    return _bodies(spark, sf_dir).select("doc_id", "path", "title", kind.alias("node_type")).where("node_type = 'concept'")


SQL["pages_of_type"] = f"WITH {_P} SELECT doc_id, path, title, 'concept' AS node_type FROM mb WHERE regexp_extract(front, 'type: (.*)', 1) IN ('concept', 'lecture')"


def page_wikilinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, target): distinct links of each page, as names and as files."""
    links = _bodies(spark, sf_dir).select("doc_id", F.explode(markup.wikilinks(F.col("body"))).alias("target"))
    return links.withColumn("file", F.concat("target", F.lit(".md")))


SQL["page_wikilinks"] = rf"WITH {_P}, l AS (SELECT doc_id, unnest(regexp_extract_all(body, '\[\[([^\]|]+)(?:\|[^\]]+)?\]\]', 1)) AS t FROM mb), n AS (SELECT DISTINCT doc_id, replace(replace(t, 'concepts/', ''), '.md', '') AS target FROM l) SELECT doc_id, target, target || '.md' AS file FROM n"


def strip_wikilinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages that linked to page 8 once that page is deleted: digests of their texts without the links."""
    pages = markup_pages(spark, sf_dir).where("path <> 'doc/8.md'").withColumn("text", markup.without_links(F.col("page"), "doc/8"))
    return pages.where("text <> page").select("doc_id", F.md5(F.col("text").cast("binary")).alias("text_md5"))


SQL["strip_wikilinks"] = f"WITH {_P} SELECT doc_id, md5(replace(page, '[[doc/8]]', '')) AS text_md5 FROM mb WHERE doc_id <> 8 AND contains(page, '[[doc/8]]')"


def related_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bodies(spark, sf_dir).select("doc_id", F.array_join(markup.related_titles(F.col("body")), "|").alias("titles"))


SQL["related_titles"] = f"""WITH {_P}, l AS (SELECT doc_id, unnest(string_split({_PART.format('相关知识', 6)}, chr(10))) AS x, generate_subscripts(string_split({_PART.format('相关知识', 6)}, chr(10)), 1) AS i FROM ms),
n AS (SELECT doc_id, trim(string_split(string_split(trim(x, '-* '), '：')[1], ':')[1]) AS t, min(i) AS i FROM l WHERE x NOT LIKE '%待补充%' GROUP BY ALL) SELECT doc_id, string_agg(t, '|' ORDER BY i) AS titles FROM n GROUP BY doc_id"""


def page_relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, src, rel_type, dst, description) of the relationship lines, types that are unknown as related."""
    found = _bodies(spark, sf_dir).select("doc_id", F.inline(markup.relationships(F.col("body"))))
    return found.withColumn("rel_type", markup.relation(F.col("rel_type")))


SQL["page_relationships"] = rf"""WITH {_P}, l AS (SELECT doc_id, unnest(string_split({_PART.format('relationships', 15)}, chr(10))) AS x FROM ms), n AS (SELECT doc_id, trim(x, '-* ') AS x FROM l WHERE contains(x, ']-->'))
SELECT doc_id, trim(string_split(x, '--[')[1]) AS src, CASE WHEN lower(regexp_extract(x, '--\[(\w+)\]', 1)) IN ('prerequisite', 'derives', 'applies_to') THEN lower(regexp_extract(x, '--\[(\w+)\]', 1)) ELSE 'related' END AS rel_type,
  trim(string_split(string_split(x, ']-->')[2], ':')[1]) AS dst, trim(coalesce(string_split(string_split(x, ']-->')[2], ':')[2], '')) AS description FROM n"""


def page_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The section on links of each page, by any of two names."""
    return _bodies(spark, sf_dir).select("doc_id", markup.section(F.col("body"), "连接", "links").alias("section"))


SQL["page_section"] = f"WITH {_P} SELECT doc_id, {_PART.format('links', 7)} AS section FROM ms"


def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, hash, edge_id): digests of pages, and the key of the edge from each to the page it links first."""
    target = markup.wikilinks(F.col("page"))[0]
    return markup_pages(spark, sf_dir).select("doc_id", F.sha2(F.col("page").cast("binary"), 256).alias("hash"), F.substring(F.sha1(F.concat_ws("|", F.regexp_replace("path", r"\.md$", ""), target, F.lit("related")).cast("binary")), 1, 16).alias("edge_id"))


SQL["content_hash"] = f"WITH {_P} SELECT doc_id, sha256(page) AS hash, substring(sha1('doc/' || doc_id || '|doc/' || ((doc_id * 7 + 1) % 900) || '|related'), 1, 16) AS edge_id FROM mb"


def inline_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of pages with (p.N) written as references to their source's file."""
    text = markup.citations_inline(F.col("body"), F.concat(F.lit("in/"), F.coalesce("source", F.lit("none")), F.lit(".md")))
    return _bodies(spark, sf_dir).select("doc_id", F.md5(text.cast("binary")).alias("text_md5"))


SQL["inline_citations"] = f"WITH {_P} SELECT doc_id, md5(replace(body, '(p.' || (doc_id % 9 + 1) || ')', '[ref:' || coalesce(source, 'none') || '.md#p=' || (doc_id % 9 + 1) || ']')) AS text_md5 FROM mb"


def cite_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, file, page, quote): the references of each page, each file and page once.

    The quote is the end of the sentence before, out of the 60 characters there.
    """
    token = r"\[ref:([^\]\|#]+)#p=([\d,\s]+)\]"
    d = _bodies(spark, sf_dir).select("doc_id", "body", F.split("body", token).alias("parts"), F.regexp_extract_all("body", F.lit(r"(\[ref:[^\]\|#]+#p=[\d,\s]+\])"), F.lit(1)).alias("tokens"))
    d = d.select("doc_id", "body", "parts", "tokens", F.posexplode("tokens").alias("i", "token"))
    size = lambda c, n: F.aggregate(F.slice(c, 1, n), F.lit(0), lambda s, x: s + F.length(x))
    at = size("parts", F.col("i") + 1) + size("tokens", F.col("i"))
    head = F.expr("substring(body, greatest(1, at - 59), least(60, at))")
    d = d.withColumn("at", at).withColumn("head", F.when(F.col("at") > 0, head).otherwise(""))
    found = (F.instr("head", "。") > 0) | (F.instr("head", "\n") > 0)
    ends = F.greatest(*[F.when(F.instr("head", c) > 0, F.length("head") - F.instr(F.reverse("head"), c) + 1).otherwise(0) for c in ("。", "\n")])
    d = d.withColumn("quote", F.when(found, markup.trimmed(F.substring(F.col("head"), ends + 1, F.length("head")))).otherwise(markup.trimmed(F.col("head"))))
    d = d.select("doc_id", "i", markup.trimmed(F.regexp_extract("token", token, 1)).alias("file"), F.posexplode(F.split(F.regexp_extract("token", token, 2), r"\s*,\s*")).alias("j", "page"), "quote")
    rows = d.where("page <> ''").groupBy("doc_id", "file", F.col("page").cast("int").alias("page"))
    return rows.agg(F.min_by("quote", F.struct("i", "j")).alias("quote"))


SQL["cite_refs"] = f"""WITH {_P}, h AS (SELECT doc_id, body, instr(body, '[ref:src/a') - 1 AS a, instr(body, '[ref:b.md') - 1 AS b FROM mb),
r AS (SELECT doc_id, 'src/a.md' AS file, unnest([3, 4]) AS page, body[greatest(1, a - 59):a] AS head FROM h UNION ALL SELECT doc_id, 'b.md', (doc_id % 4)::INT, body[greatest(1, b - 59):b] FROM h),
q AS (SELECT *, list_last(regexp_split_to_array(head, '[。\n]')) AS tail FROM r) SELECT doc_id, file, page, trim(tail) AS quote FROM q"""


def citation_renumbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Responses with their marks numbered by first appearance, and the old numbers in that order."""
    n = F.col("doc_id")
    mark = lambda k: F.concat(F.lit("["), (n % k).cast("string"), F.lit("]"))
    text = F.when(n % 10 == 0, "no marks").otherwise(F.concat(F.lit("A "), mark(9), F.lit(" B "), mark(4), F.lit(" C "), mark(9), mark(5), F.lit(".")))
    return table(spark, sf_dir, "documents").select("doc_id", markup.renumbered(text).alias("r")).select("doc_id", "r.text", F.array_join("r.pages", ",").alias("pages"))


SQL["citation_renumbering"] = """
WITH d AS (SELECT doc_id, [doc_id % 9, doc_id % 4, doc_id % 9, doc_id % 5] AS m FROM documents WHERE doc_id % 10 <> 0),
u AS (SELECT doc_id, m, list_filter(m, lambda x, i: list_position(m, x) = i) AS o FROM d)
SELECT doc_id, 'A [' || list_position(o, m[1]) || '] B [' || list_position(o, m[2]) || '] C [' || list_position(o, m[3]) || '][' || list_position(o, m[4]) || '].' AS text, array_to_string(o, ',') AS pages FROM u
UNION ALL SELECT doc_id, 'no marks', '' FROM documents WHERE doc_id % 10 = 0"""

#: Titles that the rules for names are shown on, and what they make of them.
TITLES = ["## Page 12", "公式", "# a/b: c?  d", "E = mc^2", "热容：", "x + y - z", "Plain name", "", "  **.trimmed. ", "\\frac{a}{b}", "a very long title " * 6]
GENERIC = ["公式", "电学", "热学", "力学", "磁学", "光学", "上课形式", "基本原理", "① 基本原理", "formula", "page"]


def title_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, slug, clean, heading, formula, generic): what the rules for names make of titles."""
    title = F.element_at(F.array(*[F.lit(t) for t in TITLES]), (F.col("doc_id") % len(TITLES) + 1).cast("int"))
    d = table(spark, sf_dir, "documents").select("doc_id", title.alias("t")).withColumn("c", markup.clean_title(F.col("t")))
    formula, heading = markup.looks_like_formula(F.col("c")), markup.page_heading(F.col("c"))
    generic = (F.col("c") == "") | F.col("c").isin(GENERIC) | heading | formula | (F.length("c") > 50)
    return d.select("doc_id", markup.slug_title(F.col("t")).alias("slug"), F.col("c").alias("clean"), markup.page_heading(F.col("t")).alias("heading"), formula.alias("formula"), generic.alias("generic"))


_MADE = [
    ("Page_12", "Page 12", True, False, False), ("公式", "公式", False, False, True), ("a_b__c__d", "a/b: c?  d", False, False, False), ("E_=_mc^2", "E = mc^2", False, True, True), ("热容：", "热容", False, False, False), ("x_+_y_-_z", "x + y - z", False, True, True),
    ("Plain_name", "Plain name", False, False, False), ("untitled", "", False, False, True), ("trimmed", "**.trimmed.", False, True, True), ("frac{a}{b}", "\\frac{a}{b}", False, True, True), (("a_very_long_title_" * 6)[:80].strip("._ "), ("a very long title " * 6).strip(), False, False, True),
]


def title_rules_sql() -> str:
    rows = ", ".join(f"({k}, '{s}', '{c}', {h}, {f}, {g})" for k, (s, c, h, f, g) in enumerate(_MADE))
    return f"WITH v(k, slug, clean, heading, formula, generic) AS (VALUES {rows}) SELECT doc_id, slug, clean, heading, formula, generic FROM documents JOIN v ON k = doc_id % {len(TITLES)}"


def formula_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with display formulas set inline, and the formulas without dollars."""
    shown = F.regexp_extract("body", r"(?s)(\$\$.*?\$\$)", 1)
    return _bodies(spark, sf_dir).select("doc_id", F.md5(markup.inline_math(F.col("body")).cast("binary")).alias("text_md5"), markup.latex(shown).alias("latex"))


SQL["formula_text"] = f"WITH {_P} SELECT doc_id, md5(replace(body, '$$ a = \n  b $$', '$a = b$')) AS text_md5, 'a = \n  b' AS latex FROM mb"


def page_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, k, heading, size): pages cut at their headings."""
    found = _bodies(spark, sf_dir).select("doc_id", F.posexplode(markup.sections(F.col("body"))).alias("k", "s"))
    return found.select("doc_id", "k", "s.heading", F.length("s.body").cast("long").alias("size"))


SQL["page_sections"] = f"""WITH {_P}, l AS (SELECT doc_id, title, unnest(parts) AS x, generate_subscripts(parts, 1) - 1 AS k FROM ms)
SELECT doc_id, k::INT AS k, CASE WHEN k = 0 THEN title ELSE string_split(x, chr(10))[1] END AS heading, (CASE WHEN k = 0 THEN length(x) - length('# ' || title) - 1 + 1 ELSE length(x) - length(string_split(x, chr(10))[1]) + (k < 3)::INT END)::BIGINT AS size FROM l"""


def best_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The anchor of each page's section that holds most of the words of a question, the first of those even; the first without any."""
    wanted = ["alias", "because", "end"]
    score = lambda s: sum((((F.length(s) - F.length(F.replace(s, F.lit(w), F.lit("")))) / len(w)) for w in wanted[1:]), (F.length(s) - F.length(F.replace(s, F.lit(wanted[0]), F.lit("")))) / len(wanted[0]))
    named = F.filter(markup.sections(F.col("body")), lambda s: s["heading"] != "")
    scored = F.transform(named, lambda s, k: F.struct(score(F.lower(s["body"])).alias("n"), (-k).alias("k"), s["heading"].alias("heading")))
    return _bodies(spark, sf_dir).select("doc_id", markup.anchor(F.array_max(scored)["heading"]).alias("anchor"))


SQL["best_anchor"] = f"""WITH {_P}, l AS (SELECT doc_id, title, lower(unnest(parts)) AS x, generate_subscripts(parts, 1) - 1 AS k FROM ms),
n AS (SELECT *, CASE WHEN k = 0 THEN lower(title) ELSE string_split(x, chr(10))[1] END AS h FROM l),
s AS (SELECT *, (length(x[length(h) + 1:]) - length(replace(x[length(h) + 1:], 'alias', ''))) // 5 + (length(x[length(h) + 1:]) - length(replace(x[length(h) + 1:], 'because', ''))) // 7 + (length(x[length(h) + 1:]) - length(replace(x[length(h) + 1:], 'end', ''))) // 3 AS n FROM n)
SELECT doc_id, replace(arg_max(h, (n, -k)), ' ', '-') AS anchor FROM s GROUP BY doc_id"""


def _combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, md): the turns of a conversation as the pages of one file."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", F.struct("turn", F.concat(F.lit("## Page "), (F.col("turn") + 1).cast("string"), F.lit("\n\n"), F.coalesce("text", F.lit("")))).alias("t"))
    return turns.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("t")), lambda x: x["col2"]), "\n---\n").alias("md"))


def parsed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, page, start, stop, char_count, preview): a file's pages with their offsets, without their own headings."""
    d = _combined(spark, sf_dir).withColumn("parts", F.split("md", "\n---\n"))
    d = d.select("conv_id", "parts", F.posexplode("parts").alias("i", "chunk"))
    start = F.aggregate(F.slice("parts", 1, F.col("i")), F.lit(0), lambda s, x: s + F.length(x) + 5)
    inner = markup.trimmed(F.col("chunk"))
    own = F.startswith(inner, F.concat(F.lit("## Page "), (F.col("i") + 1).cast("string"))) & (F.instr(inner, "\n") > 0)
    text = F.when(own, F.ltrim(F.regexp_replace(inner, r"^[^\n]*\n\s*", ""))).otherwise(inner)
    return d.withColumn("text", text).select("conv_id", (F.col("i") + 1).cast("long").alias("page"), start.cast("long").alias("start"), (start + F.length("chunk")).cast("long").alias("stop"), F.length("text").cast("long").alias("char_count"), F.substring(F.regexp_replace("text", r"\s+", " "), 1, 140).alias("preview"))


_TURNS = "c AS (SELECT conv_id, turn, '## Page ' || (turn + 1) || '\n\n' || coalesce(text, '') AS chunk, coalesce(text, '') AS raw FROM conversations)"
SQL["parsed_pages"] = rf"""WITH {_TURNS}, o AS (SELECT *, row_number() OVER w AS page, coalesce(sum(length(chunk) + 5) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, page, start, start + length(chunk) AS stop, length(trim(raw, ' \n\t\r')) AS char_count, substring(regexp_replace(trim(raw, ' \n\t\r'), '\s+', ' ', 'g'), 1, 140) AS preview FROM o"""


def page_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(conv_id, chunk, first_page, last_page, n_chars): pages in order, a new chunk before 600 characters or three pages are passed.

    The pages of one file are folded in its row; a file's size bounds it.
    """
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.length(F.coalesce("text", F.lit(""))).alias("n")))).alias("pages"))
    start = F.struct(F.lit(0).alias("chunk"), F.lit(0).alias("chars"), F.lit(0).alias("held"), F.array().cast("array<struct<page: int, chunk: int, n: int>>").alias("out"))

    def step(s, x):
        full = (s["held"] > 0) & ((s["chars"] + x["n"] > 600) | (s["held"] >= 3))
        chunk = s["chunk"] + full.cast("int")
        page = F.struct((F.size(s["out"]) + 1).alias("page"), chunk.alias("chunk"), x["n"].alias("n"))
        return F.struct(chunk.alias("chunk"), (F.when(full, 0).otherwise(s["chars"]) + x["n"]).alias("chars"), (F.when(full, 0).otherwise(s["held"]) + 1).alias("held"), F.concat(s["out"], F.array(page)).alias("out"))

    found = turns.select("conv_id", F.inline(F.aggregate("pages", start, step)["out"]))
    return found.groupBy("conv_id", "chunk").agg(F.min("page").alias("first_page"), F.max("page").alias("last_page"), F.sum("n").alias("n_chars"))


SQL["page_chunks"] = """
WITH RECURSIVE p AS (SELECT conv_id, length(coalesce(text, '')) AS n, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS page FROM conversations),
f AS (SELECT conv_id, page, n, 0 AS chunk, n AS chars, 1 AS held FROM p WHERE page = 1
  UNION ALL SELECT p.conv_id, p.page, p.n, f.chunk + (f.chars + p.n > 600 OR held >= 3)::INT, CASE WHEN f.chars + p.n > 600 OR held >= 3 THEN p.n ELSE f.chars + p.n END, CASE WHEN f.chars + p.n > 600 OR held >= 3 THEN 1 ELSE held + 1 END FROM f JOIN p ON p.conv_id = f.conv_id AND p.page = f.page + 1)
SELECT conv_id, chunk, min(page)::INT AS first_page, max(page)::INT AS last_page, sum(n)::BIGINT AS n_chars FROM f GROUP BY conv_id, chunk"""


def page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, short, compact, stem): texts as labels of 80 characters, as bare letters, and file names without folder and ending."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", markup.shorten(F.col("text"), 80).alias("short"), F.md5(markup.compact(F.coalesce("text", F.lit(""))).cast("binary")).alias("compact_md5"), markup.source_stem(F.concat(F.lit("a/b/"), F.coalesce("source", F.lit("none")), F.lit(".v1.pdf"))).alias("stem"))


SQL["page_texts"] = r"""
WITH t AS (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) AS t, coalesce(text, '') AS text, source FROM documents)
SELECT doc_id, CASE WHEN length(t) <= 80 THEN t ELSE rtrim(substring(t, 1, 79)) || '…' END AS short, md5(regexp_replace(lower(text), '[^\p{L}\p{N}]+', '', 'g')) AS compact_md5, coalesce(source, 'none') || '.v1' AS stem FROM t"""


def context_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many characters a context of each size leaves for the answer, the index, all pages and one page."""
    most = F.coalesce(F.when(F.col("n_chars") > 0, F.col("n_chars") * 10), F.lit(204_800))
    d = table(spark, sf_dir, "documents").select("doc_id", most.cast("long").alias("max_ctx"))
    part = lambda c, share: F.floor(F.col(c) * share).cast("long")
    d = d.select("doc_id", "max_ctx", part("max_ctx", 0.15).alias("response_reserve"), part("max_ctx", 0.05).alias("index_budget"), part("max_ctx", 0.5).alias("page_budget"))
    return d.withColumn("max_page_size", F.least("page_budget", F.greatest(F.lit(5000).cast("long"), part("page_budget", 0.3))))


SQL["context_budgets"] = """
WITH m AS (SELECT doc_id, CASE WHEN n_chars > 0 THEN n_chars * 10 ELSE 204800 END AS max_ctx FROM documents),
b AS (SELECT *, floor(max_ctx * 0.15::DOUBLE)::BIGINT AS response_reserve, floor(max_ctx * 0.05::DOUBLE)::BIGINT AS index_budget, floor(max_ctx * 0.5::DOUBLE)::BIGINT AS page_budget FROM m)
SELECT *, least(page_budget, greatest(5000, floor(page_budget * 0.3::DOUBLE)::BIGINT)) AS max_page_size FROM b"""

SQL["title_rules"] = title_rules_sql()
QUERIES = {
    f.__name__: f
    for f in (
        frontmatter_split, pages_of_type, page_wikilinks, strip_wikilinks, related_titles, page_relationships, page_section, content_hash, inline_citations, cite_refs, citation_renumbering,
        title_rules, formula_text, page_sections, best_anchor, parsed_pages, page_chunks, page_texts, context_budgets,
    )
}
