"""Column functions over tests: choices, blanks, constraints in plain words, folder names, intents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.markup import BLANK, trimmed

#: Numerals up to nine.
DIGITS = {"一": 1, "两": 2, "二": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9}
#: What question types are called.
TYPES = {
    "multiple_choice": ["选择题", "单选题", "多选题", "multiple choice", "choice"],
    "fill_blank": ["填空题", "填空", "fill blank", "fill_blank"],
    "short_answer": ["简答题", "简答", "short answer", "short_answer"],
}
#: What difficulties are called, in order of precedence.
DIFFICULTIES = {"basic": ["基础", "简单", "basic"], "understanding": ["理解", "understanding"], "application": ["应用", "计算", "案例", "application"]}
#: Words of each intent; of intents with as many words the first counts.
INTENTS = {
    "definition": ["什么是", "定义", "含义", "指什么", "意思", "概念", "definition", "means", "what is"],
    "comparison": ["对比", "比较", "区别", "不同", "差异", "vs", "versus", "compare", "difference", "区别于"],
    "mechanism": ["为什么", "原因", "机理", "机制", "原理", "如何发生", "怎么形成", "why", "how does", "mechanism"],
    "formula": ["公式", "推导", "equation", "formula", "如何计算", "求解", "等于"],
    "application": ["应用", "怎么用", "举例", "例子", "example", "use case", "应用场景"],
}


def any_of(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])


def numeral(text: Column) -> Column:
    """1 to 99 of Chinese numerals, or what digits say; null for anything else."""
    of = lambda c: F.create_map(*[F.lit(x) for pair in DIGITS.items() for x in pair])[c]
    tens, ones = F.substring_index(text, "十", 1), F.substring_index(text, "十", -1)
    both = F.coalesce(of(tens), F.lit(1)) * 10 + F.coalesce(of(ones), F.lit(0))
    return F.when(text == "十", 10).when(F.contains(text, F.lit("十")), both).otherwise(F.coalesce(of(text), F.when(text.rlike("^[0-9]+$"), text.cast("int"))))


def question_count(prompt: Column, default: int = 5) -> Column:
    """How many questions a request asks for, from 1 to 30."""
    n = numeral(F.regexp_extract(prompt, r"(\d+|[一两二三四五六七八九十]+)\s*(?:道|个|题)", 1))
    return F.when(n > 0, F.greatest(F.lit(1), F.least(F.lit(30), n))).otherwise(default)


def question_types(prompt: Column) -> Column:
    """The types that a request names and doesn't rule out; all but the ruled out if it names none to keep."""
    low = F.lower(prompt)
    barred = {t: reduce(lambda a, b: a | b, [low.rlike(rf"(?:不要|不含|排除)\s*[^，。；;]*\Q{w}\E") for w in words]) for t, words in TYPES.items()}
    named = {t: any_of(low, words) for t, words in TYPES.items()}
    keep = F.array_compact(F.array(*[F.when(named[t] & ~barred[t], F.lit(t)) for t in TYPES]))
    rest = F.array_compact(F.array(*[F.when(~barred[t], F.lit(t)) for t in TYPES]))
    left = F.when(F.size(keep) > 0, keep).when(F.size(rest) > 0, rest).otherwise(F.array(F.lit("short_answer")))
    return F.when(reduce(lambda a, b: a | b, named.values()), left).otherwise(F.array(*[F.lit(t) for t in TYPES]))


def difficulty(prompt: Column, default: str = "understanding") -> Column:
    low, out = F.lower(prompt), None
    for level, words in DIFFICULTIES.items():
        out = F.when(any_of(low, words), level) if out is None else out.when(any_of(low, words), level)
    return out.otherwise(default)


def topic(prompt: Column) -> Column:
    """What a request is about; the whole request where it doesn't say."""
    pattern = r"(?:关于|有关|针对|围绕)\s*([^，。；;,.?？!！]{2,60}?)(?:的)?(?:题|题目|测试题|应用题|基础题|内容|方面)"
    return F.when(prompt.rlike(pattern), trimmed(F.regexp_extract(prompt, pattern, 1))).otherwise(trimmed(prompt))


def folder(label: Column) -> Column:
    """A folder label with parts between slashes, without characters that paths forbid, 160 at most; null if nothing is left."""
    parts = F.split(F.btrim(trimmed(F.regexp_replace(label, r"\s+", " ")), F.lit("/")), "/")
    clean = F.filter(F.transform(parts, lambda x: F.btrim(F.regexp_replace(x, r'[\\/:*?"<>|]+', "-"), F.lit(" .-"))), lambda x: x != "")
    return F.nullif(F.substring(F.array_join(clean, "/"), 1, 160), F.lit(""))


def plain(text: Column) -> Column:
    """Lower case without punctuation, blanks single."""
    return F.lower(trimmed(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"[#*_`>$\\{}\[\]().,，。；;：:！？!?-]", " "), r"\s+", " ")))


def choice(answer: Column) -> Column:
    """The letter of a choice in upper case; empty without one."""
    return F.upper(F.regexp_extract(F.coalesce(answer, F.lit("")), "([A-Ha-h])", 1))


def blanks(answer: Column) -> Column:
    """What was filled in, between commas, semicolons and lines."""
    return F.filter(F.transform(F.split(F.coalesce(answer, F.lit("")), r"[,，;；\n]+"), lambda x: F.btrim(x, F.lit(BLANK))), lambda x: x != "")


def grade(kind: Column, answer: Column, given: Column) -> Column:
    """The share that is right: a choice as a whole, blanks by how many expected ones hold or are held by one filled in; null for open questions."""
    want, got = blanks(answer), F.transform(blanks(given), plain)
    same = lambda w, g: (g != "") & (w != "") & ((g == w) | F.contains(w, g) | F.contains(g, w))
    hits = F.size(F.filter(F.transform(want, plain), lambda w: F.exists(got, lambda g: same(w, g))))
    filled = F.when((F.size(got) == 0) | (F.size(want) == 0), 0.0).otherwise(hits / F.greatest(F.lit(1), F.size(want)))
    chosen = ((choice(answer) != "") & (choice(answer) == choice(given))).cast("double")
    return F.when(kind == "multiple_choice", chosen).when(kind == "fill_blank", filled)


def intent(question: Column) -> Column:
    """The intent most of whose words a question holds; general without any."""
    low = F.lower(F.coalesce(question, F.lit("")))
    hits = [F.struct(reduce(lambda a, b: a + b, [F.contains(low, F.lit(w)).cast("int") for w in words]).alias("n"), F.lit(-k).alias("k"), F.lit(name).alias("name")) for k, (name, words) in enumerate(INTENTS.items())]
    best = F.array_max(F.array(*hits))
    return F.when(best["n"] > 0, best["name"]).otherwise("general")


def options(text: Column) -> Column:
    """The lines that begin with a choice's letter."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: trimmed(x)), lambda x: x.rlike(r"^[A-Ha-h][.)、:：]\s+"))
