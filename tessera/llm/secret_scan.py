"""Secrets in texts: three fixed patterns, and strings that a battery of randomness tests can't tell from random ones.

A candidate is a maximal run of characters of common encodings, outside the fixed patterns' spans. Its
encoding is the narrowest alphabet that holds it. Under the hypothesis that its characters are drawn from that alphabet
at random, three tests give p-values: chi-squared of the characters' counts, the number of runs of characters of one
class (lower case, upper case, digit, mark), and the serial correlation of neighbours' values. Fisher's method makes
one p-value of the three.

Names, paths and numbered words fail these tests, but of many random strings some fail too. Which failures count
is settled by false-discovery control over the whole corpus: among all candidates of one encoding and band of
lengths, p-values are rejected up to the largest threshold at which at most RATE of the rejected ones are expected
to be random (Benjamini and Hochberg's step-up rule, over bins of the logarithm of p). Longer candidates have their own
thresholds, as tests tell more of them. Each encoding has a least length, below which the tests tell too little.
What isn't rejected is a secret.
"""

from __future__ import annotations

import hashlib
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import map_texts, stash

#: The base patterns, by kind, in the order in which kinds are listed. Fixed values; letters are ASCII only.
ASSIGN = re.compile(r"(?:(?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
LEAST_ASSIGN, LEAST_ACCESS = 6, 20
#: One of these is in the lower-cased text wherever ASSIGN matches.
_GATES = ("passw", "secret", "token", "apikey", "api_key")
KINDS = ("assign", "access", "hex", "random")

_UPPER, _LOWER, _DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
#: Encodings from the narrowest on: alphabet, classes that a candidate must show, least length.
ENCODINGS = {
    "hex-lower": (_DIGITS + "abcdef", 2, 20),
    "hex-upper": (_DIGITS + "ABCDEF", 2, 20),
    "base32": (_UPPER + "234567", 2, 20),
    "base36-lower": (_DIGITS + _LOWER, 2, 24),
    "base36-upper": (_DIGITS + _UPPER, 2, 24),
    "base62": (_UPPER + _LOWER + _DIGITS, 3, 24),
    "base64": (_UPPER + _LOWER + _DIGITS + "+/", 3, 24),
    "base64url": (_UPPER + _LOWER + _DIGITS + "-_", 3, 24),
}
CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}")
#: Lengths at which bands begin, the width of a bin of -log10(p), and the expected share of random strings among rejected ones.
BANDS, BIN, BINS, RATE = (0, 24, 32, 48, 64, 128, 256), 0.1, 400, 0.05
_MADE = "n_assign long, n_access long, n_hex long, base_sha256 string, base array<struct<kind:int,start:long,end:long>>, candidates array<struct<start:long,end:long,stratum:int,bin:int>>"


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the fixed patterns, kinds by number; matches that are too short are dropped, not matched otherwise."""
    out = []
    low = text.lower()
    if any(g in low for g in _GATES):
        out += [(0, m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= LEAST_ASSIGN]
    if "AKIA" in text:
        out += [(1, m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    out += [(2, m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[1], s[0]))


def _class(c: str) -> int:
    return 0 if c in _LOWER else 1 if c in _UPPER else 2 if c in _DIGITS else 3


def infer(candidate: str) -> str | None:
    """The narrowest encoding whose alphabet holds a candidate (without padding) that shows enough classes and is long enough."""
    body = candidate.rstrip("=")
    held, classes = set(body), len({_class(c) for c in body if _class(c) < 3})
    for name, (alphabet, least_classes, least) in ENCODINGS.items():
        if held <= _SETS[name]:
            return name if classes >= least_classes and len(body) >= least else None
    return None


_SETS = {name: set(alphabet) for name, (alphabet, _, _) in ENCODINGS.items()}


def _tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def battery(body: str, encoding: str) -> tuple[float, float, float]:
    """p-values of the three tests, under the hypothesis of independent characters, all equally likely.

    The chi-squared statistic has its exact mean and variance for the length, met by a scaled chi-squared
    distribution (its cube root taken as normal); the numbers of class changes and the correlation are taken as normal.
    """
    alphabet = ENCODINGS[encoding][0]
    k, n = len(alphabet), len(body)
    at = {c: v for v, c in enumerate(alphabet)}
    values = np.array([at[c] for c in body])
    counts = np.bincount(values, minlength=k)
    chi = float((counts**2).sum()) * k / n - n
    mean, variance = k - 1.0, 2.0 * (k - 1) * (n - 1) / n
    scale = variance / (2 * mean)
    free = mean / scale
    cube = ((max(chi, 0.0) / scale / free) ** (1 / 3) - (1 - 2 / (9 * free))) / math.sqrt(2 / (9 * free))
    share = np.bincount([_class(c) for c in alphabet], minlength=4) / k
    kinds = np.array([_class(c) for c in body])
    changes = int((kinds[1:] != kinds[:-1]).sum())
    change, twice = 1 - float((share**2).sum()), float((share * (1 - share) ** 2).sum())
    spread = (n - 1) * change * (1 - change) + 2 * (n - 2) * (twice - change**2)
    runs = (abs(changes - (n - 1) * change) - 0.5) / math.sqrt(spread) if spread > 0 else 0.0
    off = values - (k - 1) / 2
    serial = float((off[1:] * off[:-1]).sum()) / ((k * k - 1) / 12 * math.sqrt(n - 1))
    return _tail(cube), min(1.0, 2 * _tail(max(runs, 0.0))), min(1.0, 2 * _tail(abs(serial)))


def combined(p: tuple[float, float, float]) -> float:
    """Fisher's method for three p-values: the upper tail of a chi-squared of six degrees, in closed form."""
    half = -sum(math.log(max(x, 1e-300)) for x in p)
    return math.exp(-half) * (1 + half + half * half / 2) if half < 700 else 0.0


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int]]:
    """(start, end, stratum, bin) of what the battery judges: strings of an encoding that no base span touches."""
    out = []
    for m in CANDIDATE.finditer(text):
        a, b = m.span()
        name = infer(m.group())
        if name is None or any(x < b and a < y for _, x, y in base):
            continue
        body = m.group().rstrip("=")
        band = sum(len(body) >= x for x in BANDS) - 1
        p = combined(battery(body, name))
        out.append((a, b, list(ENCODINGS).index(name) * len(BANDS) + band, min(BINS, int(-math.log10(max(p, 1e-300)) / BIN))))
    return out


def _named(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def _judge(texts: list[str]) -> list[pa.Array]:
    kinds = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64())]))
    tests = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("stratum", pa.int32()), ("bin", pa.int32())]))
    base = [base_spans(t) for t in texts]
    found = [candidates(t, b) for t, b in zip(texts, base, strict=True)]
    counts = [pa.array([sum(s[0] == k for s in b) for b in base], pa.int64()) for k in range(3)]
    sha = pa.array([hashlib.sha256(_named(b).encode()).hexdigest() for b in base])
    as_rows = [[{"kind": k, "start": a, "end": z} for k, a, z in b] for b in base]
    judged = [[dict(zip(("start", "end", "stratum", "bin"), c, strict=True)) for c in f] for f in found]
    return [*counts, sha, pa.array(as_rows, kinds), pa.array(judged, tests)]


def thresholds(tested: DataFrame, rate: float = RATE) -> dict[int, int]:
    """The least bin that is rejected, by stratum: where m * p / (number of p-values no larger) is ``rate`` or less.

    Counts by stratum and bin are a table of fixed size (encodings x bands x bins), whatever the corpus.
    """
    counts = tested.select(F.explode("candidates").alias("c")).groupBy(F.col("c.stratum").alias("stratum"), F.col("c.bin").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    by: dict[int, dict[int, int]] = {}
    for row in counts.collect():
        by.setdefault(row["stratum"], {})[row["bin"]] = row["n"]
    out = {}
    for stratum, bins in by.items():
        total, above = sum(bins.values()), 0
        for b in sorted(bins, reverse=True):
            above += bins[b]
            if total * 10 ** (-b * BIN) / above <= rate:  # the largest p of the bin
                out[stratum] = b
    return out


def scan_secrets(docs: DataFrame, rate: float = RATE, keep: list[Column] | None = None, text: Column | None = None) -> DataFrame:
    """Columns ``keep`` (doc_id by default) and n_assign, n_access, n_hex, base_sha256, spans, n_random for each row.

    spans: kind:start:end of all secrets, by start, then kind; code points, end exclusive. A null text is an empty
    one, without spans. Rows with equal or null ids are rows of their own; repeated texts count each time in the
    control, so copies of one candidate are as many p-values. An empty table gives no rows.
    """
    keep = [F.col("doc_id")] if keep is None else keep
    source = docs.select(F.struct(*keep).alias("_keep"), (F.col("text") if text is None else text).alias("_of"))
    tested = stash(map_texts(source, [F.col("_keep")], F.col("_of"), _MADE, _judge), "secret-tests")
    limit = thresholds(tested, rate)
    least = F.create_map(*[F.lit(x) for kv in limit.items() for x in kv]) if limit else F.create_map().cast("map<int,int>")
    random = F.filter("candidates", lambda c: F.coalesce(c["bin"] < F.try_element_at(least, c["stratum"]), F.lit(True)))
    every = F.array_sort(F.concat(
        F.transform("base", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))),
        F.transform(random, lambda c: F.struct(c["start"].alias("start"), F.lit(KINDS.index("random")).alias("kind"), c["end"].alias("end"))),
    ))
    names = F.array(*map(F.lit, KINDS))
    spans = F.array_join(F.transform(every, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")
    return tested.select("_keep.*", "n_assign", "n_access", "n_hex", "base_sha256", spans.alias("spans"), F.size(random).cast("long").alias("n_random"))
