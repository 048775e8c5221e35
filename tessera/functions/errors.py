"""Column functions over answers: misconception tags."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The words of each misconception.
GROUPS = {
    "off_by_one": ["+1", "+2", "-1", "n+1", "边界", "越界"],
    "misread_sign": ["负", "正", "符号", "sign", "-"],
    "conflated_terms": ["混淆", "以为是", "其实不是", "confuse"],
    "missing_step": ["跳过", "直接得到", "skip", "obvious"],
    "wrong_unit": ["单位", "degree", "弧度", "radian", "米", "厘米"],
    "procedural_misuse": ["公式", "formula", "定理", "axiom"],
    "careless": ["忘了", "不小心", "手误", "typo"],
    "conceptual_gap": ["不知道", "不清楚", "不明白", "why"],
}


def _held(text: Column, words: list[str]) -> Column:
    """How many of the words a text holds."""
    return reduce(lambda a, b: a + b, [F.contains(text, F.lit(w)).cast("int") for w in words])


def misconceptions(response: Column, expected: Column) -> Column:
    """Tags, in their fixed order, of which a response holds more words than what was expected.

    None if either is null or empty, or if both agree but for white space at their ends.
    """
    said, meant = F.lower(response), F.lower(expected)
    found = F.array_compact(F.array(*[F.when(_held(said, words) > _held(meant, words), F.lit(tag)) for tag, words in GROUPS.items()]))
    wrong = (response != "") & (expected != "") & (F.btrim(response, F.lit(" \t\n\r")) != F.btrim(expected, F.lit(" \t\n\r")))
    return F.when(F.coalesce(wrong, F.lit(False)), found).otherwise(F.array().cast("array<string>"))
