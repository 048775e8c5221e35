"""Language identification: the family first, then one-versus-one machines within it.

A text's features are the shares of its hashed letter trigrams (A-Z in lower case, all that is no
letter one space). Families are told apart by one-versus-one linear support vector machines over
documents of whole families; the languages of a family by machines for each pair of them. Machines
are fitted on a bounded sample; predictions read whole texts.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import hash_sample, map_texts
from tessera.llm.linear import fit_hinge

#: Families of language codes; a language that is not listed is a family of its own.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "is"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl"),
    "slavic": ("ru", "uk", "pl", "cs", "sk", "bg", "sr", "hr", "sl"),
}
#: Training documents for each language at most: a bounded sample, drawn by hash of the id.
SAMPLE = 400
#: Hashed trigrams, and the scale of their shares.
SIZE, SCALE = 1 << 16, 20.0
_FOLD = np.full(256, 32, np.uint8)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)
UNKNOWN = "und"


def has_letter(text: str) -> bool:
    """Whether a character is of one of Unicode's letter categories; numerals, marks and circled letters are not."""
    return any(c.isalpha() and unicodedata.category(c)[0] == "L" for c in text)


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed trigrams of all texts one after the other, and where each text's begin."""
    raw = ["  " + t + " " for t in texts]
    data = _FOLD[np.frombuffer("".join(raw).encode("utf-8", "surrogatepass"), np.uint8)].astype(np.uint32)
    sizes = np.fromiter((len(t.encode("utf-8", "surrogatepass")) for t in raw), np.int64, len(raw))
    grams = ((data[:-2] * np.uint32(0x9E3779B1) + data[1:-1] * np.uint32(0x85EBCA77) + data[2:] * np.uint32(0xC2B2AE3D)) >> np.uint32(7)) & np.uint32(SIZE - 1)
    # the two trigrams that reach into the next text hold only its leading spaces
    return np.concatenate([grams, np.zeros(2, np.uint32)]), np.concatenate([[0], np.cumsum(sizes)])


@dataclass
class Hierarchy:
    """Fitted machines: for pairs of families, and for pairs of languages of one family."""

    families: dict[str, list[str]]
    top: dict[tuple[str, str], np.ndarray]
    inner: dict[tuple[str, str], np.ndarray]

    def predict(self, texts: list[str]) -> list[tuple[str, float]]:
        """(language, score) of each text; the score is the least sigmoid of the margins it won by."""
        if not texts or not self.families:
            return [(UNKNOWN, 0.0)] * len(texts)
        grams, at = trigrams(texts)
        sizes = np.diff(at)
        margins = {pair: np.add.reduceat(w[grams], at[:-1]) / sizes * SCALE + w[-1] for pair, w in (self.top | self.inner).items()}
        out = []
        for k, text in enumerate(texts):
            if not has_letter(text):
                out.append((UNKNOWN, 0.0))
                continue
            family, sure = _winner(sorted(self.families), margins, k)
            lang, most = _winner(self.families[family], margins, k)
            out.append((lang, min(sure, most)))
        return out


def _winner(names: list[str], margins: dict, k: int) -> tuple[str, float]:
    """The name with most won pairs, ties by sum of margins, then by name; and how surely it won."""
    if len(names) == 1:
        return names[0], 1.0
    won = {n: [0, 0.0, np.inf] for n in names}
    for a, b in combinations(names, 2):
        m = float(margins[a, b][k])
        for n, x in ((a, m), (b, -m)):
            won[n] = [won[n][0] + (x > 0), won[n][1] + x, min(won[n][2], x)]
    best = max(names, key=lambda n: (won[n][0], won[n][1], [-ord(c) for c in n]))
    return best, float(1 / (1 + np.exp(-4 * np.clip(won[best][2], -8, 8))))


def _pairs(groups: dict[str, list]) -> dict[tuple[str, str], np.ndarray]:
    out = {}
    for a, b in combinations(sorted(groups), 2):
        rows = groups[a] + groups[b]
        y = np.array([1.0] * len(groups[a]) + [-1.0] * len(groups[b]))
        share = {1.0: len(rows) / (2 * len(groups[a])), -1.0: len(rows) / (2 * len(groups[b]))}
        out[a, b] = fit_hinge(rows, y, SIZE, np.array([10 * share[v] for v in y])).astype(np.float32)
    return out


def fit(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Hierarchy:
    """Fit on at most SAMPLE documents of each language among the rows where ``train`` holds.

    Rows without a language or with an empty text are passed over. Ranking reads ids and languages
    only; of documents that share an id and a language one is taken. The texts of the sample, a bounded
    number, come to the driver, where the machines are small.
    """
    taught = docs.where(train & F.col(lang_col).isNotNull() & (F.length(text_col) > 0)).select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    chosen = F.broadcast(hash_sample(taught.select("id", "lang"), "lang", SAMPLE))  # SAMPLE rows for each language at most
    sample = taught.join(chosen, ["id", "lang"]).groupBy("id", "lang").agg(F.min("text").alias("text")).toPandas()
    by_lang: dict[str, list] = {}
    for lang, text in sample.sort_values("id")[["lang", "text"]].itertuples(index=False):
        grams, _ = trigrams([text])
        at, n = np.unique(grams[:-2], return_counts=True)
        by_lang.setdefault(lang, []).append((at.astype(np.int64), n / n.sum() * SCALE))
    families: dict[str, list[str]] = {}
    for lang in sorted(by_lang):
        families.setdefault(next((f for f, members in FAMILIES.items() if lang in members), f"={lang}"), []).append(lang)
    top = _pairs({f: [r for x in langs for r in by_lang[x]] for f, langs in families.items()})
    inner: dict = {}
    for langs in families.values():
        inner |= _pairs({x: by_lang[x] for x in langs})
    return Hierarchy(families, top, inner)


def identify(docs: DataFrame, model: Hierarchy, text_col: str = "text", keep: list[Column] | None = None) -> DataFrame:
    """Columns ``keep`` of ``docs`` with lang_pred and score (0 to 1).

    ``und`` with score 0 if the text is null or has no letter, or if nothing was learned. Whole texts
    are read; nothing but the text is an input. An empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # pairs of languages times SIZE floats

    def predict(texts):
        found = shared.value.predict(texts)
        return [pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())]

    return map_texts(docs, keep or [], F.col(text_col), "lang_pred string, score double", predict)
