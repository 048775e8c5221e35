"""Column functions over text: tokens, keyword scores, snippets, sentences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: characters that part tokens.
SEPARATORS = r'[\s,，。！？、；：""（）()\-_/·~～…]+'
_CJK = "[一-鿿㐀-䶿]"


def tokens(text: Column, stop_words: tuple[str, ...]) -> Column:
    """Distinct tokens in order: lower-cased parts of over one character that are no stop words.

    A part with ideographs and over two characters gives its bigrams, its characters that are no stop words, and
    itself. Null texts give null.
    """
    stop = F.array(*[F.lit(w) for w in stop_words]) if stop_words else F.array().cast("array<string>")
    parts = F.filter(F.split(F.lower(text), SEPARATORS), lambda t: (F.length(t) > 1) & ~F.array_contains(stop, t))

    def grow(t: Column) -> Column:
        n = F.length(t)
        pairs = F.transform(F.sequence(F.lit(1), n - 1), lambda k: F.substring(t, k, F.lit(2)))
        singles = F.filter(F.transform(F.sequence(F.lit(1), n), lambda k: F.substring(t, k, F.lit(1))), lambda c: ~F.array_contains(stop, c))
        return F.when(t.rlike(_CJK) & (n > 2), F.concat(pairs, singles, F.array(t))).otherwise(F.array(t))

    return F.array_distinct(F.flatten(F.transform(parts, grow)))


def occurrences(text: Column, token: str) -> Column:
    """How often a token stands in a text without overlaps."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(token), F.lit("")))) / len(token)).cast("long")


def keyword_score(title: Column, body: Column, wanted: list[str]) -> Column:
    """10 for each token in the title, and 1 for each place in the body, 5 for each token at most; both in lower case."""
    score = F.lit(0.0)
    for t in wanted:
        in_title = F.coalesce(F.contains(title, F.lit(t)), F.lit(False))
        score = score + F.when(in_title, 10.0).otherwise(0.0) + F.least(F.coalesce(occurrences(body, t), F.lit(0)), F.lit(5)).cast("double")
    return score


def snippet(body: Column, wanted: list[str], before: int = 80, after: int = 120, plain: int = 200) -> Column:
    """The text around the earliest token, with dots where it is cut; without a token its beginning."""
    places = [F.nullif(F.instr(F.lower(body), t), F.lit(0)) for t in wanted]
    at = (F.least(*places) if len(places) > 1 else places[0]) - 1
    start, end = F.greatest(F.lit(0), at - before), F.least(F.length(body), at + after)
    cut = F.concat(F.when(start > 0, "...").otherwise(""), F.substring(body, start + 1, end - start), F.when(end < F.length(body), "...").otherwise(""))
    return F.when(at.isNull(), F.substring(body, 1, plain)).otherwise(cut)
