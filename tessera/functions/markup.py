"""Column functions over markdown pages: front matter, links, sections, relationships, citations, slugs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_FRONT = r"(?s)^---\n(.*?)\n---\n?(.*)$"
_LINK = r"\[\[([^\]|]+)(?:\|[^\]]+)?\]\]"
#: Page types that nodes may have; others count as the first.
NODE_TYPES = ("concept", "formula", "principle", "source", "synthesis", "inquiry", "guide")
#: Relationship types; others count as the last.
RELATIONS = ("prerequisite", "derives", "applies_to", "related")
#: White space that is trimmed from lines and names.
BLANK = " \t\n\r\x0b\x0c"
#: Latex commands whose argument is plain text.
_TEXT_ONLY = r"\$\$\s*(.*?)\s*\$\$"


def trimmed(text: Column, chars: str = BLANK) -> Column:
    return F.btrim(text, F.lit(chars))


def front_matter(page: Column) -> Column:
    """What stands between the leading dashes; empty without them."""
    return F.regexp_extract(page, _FRONT, 1)


def body(page: Column) -> Column:
    """The page without its front matter."""
    return F.when(page.rlike(_FRONT), F.regexp_extract(page, _FRONT, 2)).otherwise(page)


def field(front: Column, name: str) -> Column:
    """A scalar field of front matter; null if it is not there."""
    return F.nullif(trimmed(F.regexp_extract(front, rf"(?m)^{name}:[ \t]*(.*)$", 1)), F.lit(""))


def node_type(found: Column) -> Column:
    return F.when(found.isin(*NODE_TYPES), found).otherwise(NODE_TYPES[0])


def wikilinks(text: Column) -> Column:
    """Distinct targets in order, without what follows a bar, a leading concepts/ and a trailing .md."""
    targets = F.transform(F.regexp_extract_all(text, F.lit(_LINK), F.lit(1)), lambda x: F.regexp_replace(F.regexp_replace(trimmed(x), "^concepts/", ""), r"\.md$", ""))
    return F.array_distinct(F.filter(targets, lambda x: x != ""))


def without_links(text: Column, target: str) -> Column:
    """The text with links to one page taken out, with or without another name."""
    return F.regexp_replace(text, rf"\[\[\Q{target}\E(?:\|[^\]]+)?\]\]", "")


def section(text: Column, *names: str) -> Column:
    """The body of the first second-level section with one of the names, whatever their case; empty without one."""
    pattern = "|".join(rf"\Q{n}\E" for n in names)
    return trimmed(F.regexp_extract(text, rf"(?i)##\s*(?:{pattern})\s*\n([\s\S]*?)(?=\n##\s+|\z)", 1))


def lines(text: Column) -> Column:
    """Lines without bullets and blanks at their ends, empty ones left out."""
    return F.filter(F.transform(F.split(text, "\n"), lambda x: F.btrim(x, F.lit("-* \t"))), lambda x: x != "")


def related_titles(text: Column) -> Column:
    """Distinct titles listed under the headings of related knowledge, without explanations after a colon."""
    listed = F.flatten(F.array(*[lines(section(text, name)) for name in ("相关知识", "相关概念")]))
    titles = F.transform(F.filter(listed, lambda x: x != "待补充"), lambda x: trimmed(F.split(F.split(x, "：")[0], ":")[0]))
    return F.array_distinct(F.filter(titles, lambda x: (x != "") & (x != "待补充")))


def relationships(text: Column) -> Column:
    """Structs (src, rel_type, dst, description) of the lines ``A --[type]--> B: why`` under relationships."""
    pattern = r"^([^\-\[>]+?)\s*--\[\s*(\w+)\s*\]\s*-->\s*([^\:]+?)(?::\s*(.*))?$"
    part = lambda x, k: trimmed(F.regexp_extract(x, pattern, k))
    found = F.filter(lines(section(text, "relationships")), lambda x: x.rlike(pattern))
    return F.transform(found, lambda x: F.struct(part(x, 1).alias("src"), F.lower(part(x, 2)).alias("rel_type"), part(x, 3).alias("dst"), part(x, 4).alias("description")))


def relation(found: Column) -> Column:
    return F.when(found.isin(*RELATIONS), found).otherwise(RELATIONS[-1])


def slug_title(title: Column) -> Column:
    """A file name of 80 characters at most: no heading marks, no characters that paths forbid, blanks as underscores."""
    t = F.regexp_replace(trimmed(F.coalesce(title, F.lit("untitled"))), r"^#+\s*", "")
    t = F.regexp_replace(F.regexp_replace(t, r'[\\/:*?"<>|]+', "_"), r"\s+", "_")
    t = F.btrim(F.substring(t, 1, 80), F.lit("._ "))
    return F.when(t == "", "untitled").otherwise(t)


def clean_title(title: Column) -> Column:
    return F.btrim(F.regexp_replace(trimmed(F.coalesce(title, F.lit(""))), r"^#+\s*", ""), F.lit(" ：:，,。"))


def looks_like_formula(title: Column) -> Column:
    """Whether a title is more of a formula than a name: commands, relations, indices, or operators among letters."""
    t = clean_title(title)
    symbols = F.size(F.regexp_extract_all(t, F.lit("([+\\-*/=≈≠≤≥<>α-ωΑ-ΩΩ℃°])"), F.lit(1)))
    letters = F.size(F.regexp_extract_all(t, F.lit("([A-Za-zα-ωΑ-Ω])"), F.lit(1)))
    spaced = t.rlike(r"\s[+\-*/=≈≠≤≥<>]\s")
    sign = t.rlike(r"\\[a-zA-Z]+|[=≈≠≤≥<>]|[_^{}]")
    return (t != "") & (sign | spaced | ((symbols >= 2) & (letters >= 1) & (F.length(t) <= 80)))


def page_heading(title: Column) -> Column:
    return trimmed(title).rlike(r"(?i)^#+?\s*Page\s+\d+\s*$")


def inline_math(text: Column) -> Column:
    """Display formulas as inline ones, their white space as single blanks."""
    parts = F.split(text, r"\$\$")
    inner = F.transform(parts, lambda x, k: F.when((k % 2 == 1) & (k < F.size(parts) - 1), F.concat(F.lit("$"), trimmed(F.regexp_replace(x, r"\s+", " ")), F.lit("$"))).when((k % 2 == 1), F.concat(F.lit("$$"), x)).otherwise(x))
    return F.array_join(inner, "")


def latex(text: Column) -> Column:
    """A formula without the dollars around it."""
    t = F.regexp_replace(trimmed(F.coalesce(text, F.lit(""))), r"^\$+\s*(?:\\n|\n)?", "")
    return trimmed(F.replace(F.regexp_replace(t, r"(?:\\n|\n)?\s*\$+$", ""), F.lit("$$"), F.lit("")))


def citations_inline(text: Column, file: Column) -> Column:
    """``(p.3, 4)`` as ``[ref:file#p=3,4]``."""
    name = F.regexp_replace(file, "^.*/", "")
    marked = F.regexp_replace(text, r"[(（]\s*p\.\s*(\d+)\s*[)）]", "[ref:\x00#p=$1]")
    return F.replace(marked, F.lit("\x00"), name)


def anchor(text: Column) -> Column:
    """A heading's anchor: lower case, blanks as dashes, nothing but word characters and ideographs."""
    t = F.regexp_replace(F.lower(trimmed(F.coalesce(text, F.lit("")))), r"\s+", "-")
    t = F.btrim(F.regexp_replace(F.regexp_replace(t, r"[^\p{L}\p{N}_\-]+", ""), "-+", "-"), F.lit("-"))
    return F.when(t == "", "section").otherwise(t)


def sections(text: Column) -> Column:
    """Structs (heading, body) of a page cut at headings of the first three levels; what stands before has none."""
    marked = F.regexp_replace(text, r"(?m)^(#{1,3})[ \t]+(.+?)[ \t]*#*[ \t]*$", "\x01$2\x02")
    parts = F.split(marked, "\x01")
    one = lambda x, k: F.when(k == 0, F.struct(F.lit("").alias("heading"), x.alias("body"))).otherwise(F.struct(trimmed(F.substring_index(x, "\x02", 1)).alias("heading"), F.substring(x, F.locate("\x02", x) + 1, F.length(x)).alias("body")))
    return F.filter(F.transform(parts, one), lambda s: (s["heading"] != "") | (trimmed(s["body"]) != ""))


def renumbered(text: Column) -> Column:
    """Struct (text, pages): visible [n] marks numbered by first appearance, and the old numbers in that order."""
    order = F.array_distinct(F.regexp_extract_all(text, F.lit(r"\[(\d+)\]"), F.lit(1)))
    marked = F.regexp_replace(text, r"\[(\d+)\]", "\x01$1\x02")
    out = F.aggregate(F.sequence(F.lit(1), F.size(order)), marked, lambda t, k: F.replace(t, F.concat(F.lit("\x01"), F.element_at(order, k), F.lit("\x02")), F.concat(F.lit("["), k.cast("string"), F.lit("]"))))
    return F.struct(F.when(F.size(order) > 0, out).otherwise(text).alias("text"), order.alias("pages"))


def source_stem(file: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(file, "^.*/", ""), r"\.[^.]*$", "")


def shorten(text: Column, most: int) -> Column:
    """At most so many characters with an ellipsis, white space as single blanks."""
    t = trimmed(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    return F.when(F.length(t) <= most, t).otherwise(F.concat(F.rtrim(F.substring(t, 1, most - 1)), F.lit("…")))


def compact(text: Column) -> Column:
    """Letters and digits only, in lower case."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", "")


#: Where pages of a type lie; other types lie in a folder named by their plural.
FOLDERS = {
    "concept": "concepts", "formula": "formulas", "principle": "principles", "procedure": "procedures", "example": "examples", "misconception": "misconceptions", "synthesis": "synthesis",
    "learning_path": "learning_paths", "learning_objective": "objectives", "rubric": "rubrics", "source": "sources", "inquiry": "inquiries", "guide": "guides",
}


def page_path(kind: Column, title: Column) -> Column:
    """The file of a page: its type's folder and its title as a name."""
    known = F.create_map(*[F.lit(x) for pair in FOLDERS.items() for x in pair])
    return F.concat(F.coalesce(known[kind], F.concat(kind, F.lit("s"))), F.lit("/"), slug_title(title), F.lit(".md"))


def without_images(text: Column) -> Column:
    """The text without pictures: marked, as tags, inline data, bare file names, media paths, and what empty brackets they leave."""
    for pattern in (r"!\[[^\]]*\]\([^)]+\)", r"<img[^>]*/?>", r"data:image/[a-zA-Z]+;base64,[A-Za-z0-9+/=]{50,}", r"(?i)\b[a-zA-Z0-9_-]+\.(?:png|jpe?g|gif|bmp|tiff?|webp|svg)\b", r"/api/media/[^\s)]+", r"(?m)^[ \t]*\(\s*\)[ \t]*$", r"(?m)^[ \t]*\[\s*\][ \t]*$"):
        text = F.regexp_replace(text, pattern, "")
    return F.regexp_replace(text, r"\n{3,}", "\n\n")


def label_variants(label: Column) -> Column:
    """How a label may stand in a text: in lower case, without what is in parentheses, and its parts between separators."""
    clean = F.lower(trimmed(F.regexp_replace(F.coalesce(label, F.lit("")), r"\s+", " ")))
    bare = trimmed(F.regexp_replace(clean, r"\s*[（(][^）)]*[）)]\s*", " "))
    parts = [F.when(F.contains(clean, F.lit(sep)), F.filter(F.transform(F.split(clean, sep), lambda x: trimmed(x)), lambda x: F.length(x) > 1)).otherwise(F.array().cast("array<string>")) for sep in ("、", "/", "／")]
    return F.array_distinct(F.concat(F.array(clean), F.when((bare != "") & (bare != clean), F.array(bare)).otherwise(F.array().cast("array<string>")), *parts))


def source_keywords(file: Column) -> Column:
    """What tells a source's pages: its name, without a lecture's number, its parts, and its ideographs two by two."""
    stem = source_stem(file)
    clean = F.regexp_replace(stem, "第[一二三四五六七八九十0-9]+讲", "")
    parts = F.filter(F.split(clean, r"[\s._\-]+"), lambda x: F.length(x) >= 2)
    phrases = F.regexp_extract_all(clean, F.lit("([一-鿿]{2,})"), F.lit(1))
    pairs = F.flatten(F.transform(phrases, lambda x: F.transform(F.sequence(F.lit(1), F.length(x) - 1), lambda k: F.substring(x, k, F.lit(2)))))
    every = F.concat(F.array(stem, clean), parts, phrases, pairs)
    return F.array_sort(F.array_distinct(F.filter(every, lambda x: (x != "") & ~x.isin("讲义", "课件", "性能"))))
