"""The numbered operators against SQL, brute force, exact round trips or held-out accuracy."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.llm import bpe, jaccard_join, language_id, license_scan, mixing, pieces, quality_classifier, quality_rules, queries, token_counts, topk_search

SMALL, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"w{k % 977}x{k % 31}" for k in range(60_000))

ODD = [
    (1, "one two three four five six", "en", "a"),
    (1, "one two three four five six", "en", "a"),
    (2, "ONE two\tthree four\nfive six", "en", "a"),
    (3, "one two three four five six seven", "en", "b"),
    (4, "", "en", "b"),
    (5, None, None, None),
    (6, " \n\t ", "fr", "a"),
    (None, "one two three four five six", "en", None),
    (None, "no id here", None, "c"),
    (7, "short", "de", "c"),
    (8, "SHORT", "de", "c"),
    (9, LONG, "en", "a"),
    (10, LONG + " tail", "en", "a"),
    (11, "café naïve 中文 \U0001f600 ​ x <|endoftext|> y", "fr", "a"),
    (12, "!!! ### 123 $$$", "en", "a"),
    (13, "line a\nline a\nline b\n\n\nline a", "en", "a"),
    (14, "released under the GNU General Public License version 3. All rights reserved; CC-BY", "en", "a"),
]
CLASH = ["id", "node", "size", "kept", "score", "lang_pred", "rank", "block", "token", "label", "copies", "k", "n", "n_words", "text_", "_row", "_text", "_words", "_id", "_copies", "_doc", "_number", "_copy"]


def odd(spark, rows=ODD):
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    for c in CLASH:
        frame = frame.selectExpr("*", f"'clash' as `{c}`")
    return frame


def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def texts_of(spark, sf_dir):
    return [(r["doc_id"], r["text"]) for r in documents(spark, sf_dir).select("doc_id", "text").collect()]


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, same_as_sql, name):
    for sf_dir in (SMALL, MIDDLE):
        assert same_as_sql(queries.queries()[name](spark, sf_dir), queries.oracle_sql()[name], sf_dir) > 0


# 1 quality rules


def base(text):
    text = text or ""
    w = WORD.findall(text)
    windows = Counter(zip(w, w[1:], w[2:], strict=False))
    repeated = {k + d for k in range(len(w) - 2) if windows[tuple(w[k : k + 3])] > 1 for d in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    failed = len(w) < 50 or 100 * len(repeated) > 50 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(repeated), failed


BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def test_quality_rules_base(spark):
    got = queries.op1_quality_rules(spark, SMALL)
    assert rows_of(got, "doc_id", *BASE) == sorted(((i, *base(t)) for i, t in texts_of(spark, SMALL)), key=repr)
    made = quality_rules.quality_rules(odd(spark))
    assert rows_of(made, "doc_id", *BASE) == sorted(((i, *base(t)) for i, t, *_ in ODD), key=repr)
    assert not made.where("base_failed and kept").count()
    assert quality_rules.quality_rules(odd(spark, [])).count() == 0
    assert quality_rules.keep_good(odd(spark)).columns == odd(spark).columns


def test_quality_rules_reject_outliers_only(spark):
    draw = np.random.default_rng(1)
    word = lambda: "".join(draw.choice(list("abcdefghijklmnop"), draw.integers(2, 9)))
    rows = [(k, " ".join(word() for _ in range(draw.integers(80, 300))), "en", "s") for k in range(300)]
    rows += [(1000 + k, " ".join("#$%" + word() for _ in range(100)), "en", "s") for k in range(5)]
    got = dict(rows_of(quality_rules.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")), "doc_id", "kept"))
    assert all(got[k] for k in range(300)) and not any(got[1000 + k] for k in range(5))


def test_quality_rules_settle(spark):
    draw = np.random.default_rng(3)
    good, bad = draw.normal([1.5, 0.2, 0.1, 0.5], [0.2, 0.4, 0.3, 0.8], (700, 4)), draw.normal([2.5, 2.0, 1.0, 3.0], 0.2, (120, 4))
    points = {"a": np.vstack([good, bad]), "b": draw.exponential(0.6, (90, 4))}
    rows = [(k, g, *map(float, x)) for g, xs in points.items() for k, x in enumerate(xs)]
    judged = spark.createDataFrame(rows, "_row long, _group string, x_0 double, x_1 double, x_2 double, x_3 double")
    found = {r["_group"]: r for r in quality_rules.least_determinant(judged).collect()}
    assert set(found) == set(points)
    for g, xs in points.items():
        # one more step, with numpy: no determinant is smaller than the one found
        lower = np.zeros((4, 4))
        for i in range(4):
            for j in range(i + 1):
                lower[i, j] = found[g][f"L_{i}_{j}"]
        z = np.linalg.solve(lower, (xs - [found[g][f"m_{i}"] for i in range(4)]).T)
        place = np.floor(np.log((z * z).sum(axis=0) + 1e-6) * quality_rules.BINS)
        wanted, weight = quality_rules.SHARE * len(xs), np.zeros(len(xs))
        for b in np.unique(place):
            n = (place == b).sum()
            weight[place == b] = min(1.0, max(0.0, wanted - (place < b).sum()) / n)
        scatter = quality_rules.CONSISTENT * np.cov(xs.T, bias=True, aweights=weight) + np.diag(np.square(quality_rules.FLOOR))
        assert np.linalg.slogdet(scatter)[1] > found[g]["log_det"] - 1e-6
        assert weight.sum() == pytest.approx(wanted)
        if g == "a":  # what lies apart is no part of the core
            assert not weight[700:].any() and np.median(place[700:]) > place[:700].max()


# 2 exact top-k


def test_top_k_edges(spark):
    rows = [(0, [1.0, 0.5]), (50, [0.25, -1.0]), (3, [0.5, 0.5]), (4, [0.5, 0.5]), (5, None), (6, [1.0, None]), (7, [float("nan"), 1.0]), (8, [float("inf"), 1.0]), (None, [1.0, 1.0]), (9, []), (3, [0.5, 0.5]), (10, [0.3])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 as id", "'x' as v", "2 as rank")
    got = topk_search.top_k(table, F.col("id") % 50 == 0)
    valid = [(i, np.floor(256 * np.array(list(v) + [0.0] * (2 - len(v))))) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for q in (0, 50):
        mine = next(v for i, v in valid if i == q)
        best = sorted(((-int(mine @ v), i) for i, v in valid if i != q))[:5]
        want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    assert rows_of(got, "query_id", "rank", "vec_id", "score") == sorted(want, key=repr)
    empty = spark.createDataFrame([], "vec_id long, embedding array<double>")

    assert topk_search.top_k(empty, F.col("id") % 50 == 0).count() == 0


# 3 token counts, 5 BPE


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(queries.TOKENIZER))


def test_every_piece_is_one_token(library):
    """token_counts takes a pre-token that is a piece for one token."""
    import public_tokenizers

    p = pieces.load(public_tokenizers.path(queries.TOKENIZER))
    whole = [b.decode() for b in p.words if b.decode("utf-8", "ignore").encode() == b and len(p.pre_tokens(b.decode())) == 1]
    assert len(whole) > 45_000
    assert all(len(e) == 1 for e in library.encode_batch(whole, add_special_tokens=False))


def test_token_counts(spark, library):
    import public_tokenizers

    for docs, texts in ((documents(spark, MIDDLE), texts_of(spark, MIDDLE)), (odd(spark), [(i, t) for i, t, *_ in ODD])):
        got = token_counts.token_counts(docs, public_tokenizers.path(queries.TOKENIZER))
        counts = [len(e) for e in library.encode_batch([t or "" for _, t in texts], add_special_tokens=False)]
        want = [(i, len((t or "").encode()), n, n > 1024) for (i, t), n in zip(texts, counts, strict=True)]
        assert rows_of(got, "doc_id", "n_bytes", "n_tokens", "over_limit") == sorted(want, key=repr)
    assert token_counts.token_counts(odd(spark, []), public_tokenizers.path(queries.TOKENIZER)).count() == 0


def test_token_counts_of_long_lists(spark, library):
    """Long lists are dealt by block; counts stay the same."""
    import public_tokenizers

    texts = [(k, f"zqxv{k % 3}zqxv blorpified word{k}") for k in range(60)]
    got = token_counts.token_counts(spark.createDataFrame(texts, "doc_id long, text string").repartition(3), public_tokenizers.path(queries.TOKENIZER), block=300, long=2)
    assert rows_of(got, "doc_id", "n_tokens") == sorted(((i, len(library.encode(t, add_special_tokens=False))) for i, t in texts), key=repr)


def test_bpe_round_trip(spark, library):
    for docs, texts in ((documents(spark, MIDDLE), texts_of(spark, MIDDLE)), (odd(spark), [(i, t) for i, t, *_ in ODD])):
        got = queries.op5_bpe_round_trip(spark, MIDDLE, docs)
        want = []
        for i, t in texts:
            ids = library.encode(t or "", add_special_tokens=False).ids
            back = library.decode(ids, skip_special_tokens=False)
            want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
        assert rows_of(got, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == sorted(want, key=repr)
    assert queries.op5_bpe_round_trip(spark, MIDDLE, odd(spark, [])).count() == 0


def test_bpe_reuses_shared_chunks(spark):
    import public_tokenizers

    shared = " ".join(f"passage{k} stands here" for k in range(1500))
    docs = spark.createDataFrame([(k, f"head {k} " * 40 + shared + f" tail {k}") for k in range(20)], "doc_id long, text string")
    got = bpe.encode_documents(docs, public_tokenizers.path(queries.TOKENIZER)).toPandas()
    assert got["n_reused"].sum() > 0.6 * got["n_chunks"].sum()


# 6 language ID, 10 quality classifier


def test_language_id(spark):
    got = queries.op6_language_id(spark, MIDDLE).join(documents(spark, MIDDLE).select("doc_id", "lang"), "doc_id").toPandas()
    assert len(got) == documents(spark, MIDDLE).count() and got["score"].between(0, 1).all()
    held = got[got["held_out"] & got["lang"].notna() & (got["lang_pred"] != "und")]
    assert len(held) > 100 and (held["lang"] == held["lang_pred"]).mean() > 0.95

    model = language_id.fit(odd(spark), F.lit(True))
    out = language_id.identify(odd(spark), model, keep=[F.col("doc_id")])
    assert out.count() == len(ODD)
    assert {r["lang_pred"] for r in out.where("doc_id in (4, 5, 6, 12)").collect()} == {"und"}
    none = language_id.fit(odd(spark, []), F.lit(True))
    assert {r["lang_pred"] for r in language_id.identify(odd(spark), none).select("lang_pred").collect()} == {"und"}
    assert language_id.identify(odd(spark, []), model).count() == 0


def test_large_ids_beside_nulls_stay_exact(spark):

    big = 2**60 + 1
    docs = spark.createDataFrame([(big, "some text"), (None, "other text")], "doc_id long, text string").coalesce(1)
    model = language_id.fit(odd(spark), F.lit(True))
    assert {r["doc_id"] for r in language_id.identify(docs, model, keep=[F.col("doc_id")]).collect()} == {big, None}


def test_quality_classifier(spark):
    labels = spark.read.parquet(f"{MIDDLE}/labels.parquet").select("doc_id", "quality")
    got = queries.op10_quality_classifier(spark, MIDDLE)
    assert got.count() == documents(spark, MIDDLE).count()
    held = got.where("held_out").join(labels, "doc_id").toPandas()
    good, bad = held.loc[held["quality"] == 1, "score"].to_numpy(), held.loc[held["quality"] == 0, "score"].to_numpy()
    assert (good[:, None] > bad[None]).mean() > 0.85
    assert ((held["score"] >= 0.7).astype(int) == held["predicted"]).all()

    marks = spark.createDataFrame([(1, 1), (7, 0), (99, 1), (None, 0), (9, None), (10, 5)], "doc_id long, quality int")
    model = quality_classifier.fit(odd(spark), marks, F.lit(True))
    assert quality_classifier.score(odd(spark), model).count() == len(ODD)
    model = quality_classifier.fit(odd(spark), marks.limit(0), F.lit(True))
    assert {round(r["score"], 6) for r in quality_classifier.score(odd(spark), model).collect()} == {0.5}
    assert quality_classifier.score(odd(spark, []), model).count() == 0


def brute_language(model, text):
    """The prediction by plain loops over one text's bytes."""
    if not any(language_id.has_letter(c) for c in text):
        return "und", 0.0
    fold = [b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in ("  " + text + " ").encode()]
    grams = Counter((((a * 0x9E3779B1 + b * 0x85EBCA77 + c * 0xC2B2AE3D) % 2**32) >> 7) % language_id.SIZE for a, b, c in zip(fold, fold[1:], [*fold[2:], 32], strict=False))
    grams[(((fold[-1] * 0x9E3779B1 + 32 * 0x85EBCA77 + 32 * 0xC2B2AE3D) % 2**32) >> 7) % language_id.SIZE] += 1  # the next text's leading spaces follow
    total = len(fold)

    def winner(names, machines):
        if len(names) == 1:
            return names[0], 1.0
        best = None
        for n in sorted(names):
            mine = []
            for (a, b), w in machines.items():
                if n in (a, b) and a in names and b in names:
                    m = sum(float(w[g]) * k for g, k in grams.items()) / total * language_id.SCALE + float(w[-1])
                    mine.append(m if n == a else -m)
            key = (sum(x > 0 for x in mine), sum(mine))
            if best is None or key > best[0]:
                best = key, n, min(mine)
        return best[1], 1 / (1 + np.exp(-4 * np.clip(best[2], -8, 8)))

    family, sure = winner(list(model.families), model.top)
    lang, most = winner(model.families[family], model.inner)
    return lang, min(sure, most)


def test_language_against_plain_loops(spark):
    docs = documents(spark, SMALL)
    model = language_id.fit(docs, F.lit(True))
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.identify(docs, model, keep=[F.col("doc_id")]).collect()}
    some = [(i, t or "") for i, t in texts_of(spark, SMALL) if len(t or "") < 1500][:60]
    assert len(some) > 30
    for i, text in some:
        lang, score = brute_language(model, text)
        assert got[i][0] == lang and got[i][1] == pytest.approx(score, abs=0.02)


def test_quality_against_plain_counts(spark):
    docs, labels = documents(spark, SMALL), spark.read.parquet(f"{SMALL}/labels.parquet")
    known = {r["doc_id"]: r["quality"] for r in labels.collect() if r["quality"] in (0, 1)}
    texts = [(t, known[i]) for i, t in texts_of(spark, SMALL) if i in known and t is not None]
    counts = np.zeros((2, quality_classifier.SIZE))
    for t, y in texts:
        counts[y, quality_classifier.features([t])[0]] += 1
    rows = [sum(y == c for _, y in texts) for c in (0, 1)]
    want = np.log((counts[1] + 1) / (rows[1] + 2)) - np.log((counts[0] + 1) / (rows[0] + 2))
    got = quality_classifier.log_ratios(spark.createDataFrame(texts, "text string, label int").repartition(5))
    assert np.allclose(got, want)
    model = quality_classifier.fit(docs, labels, F.lit(True))
    scored = {r["doc_id"]: r["score"] for r in quality_classifier.score(docs, model).collect()}
    for i, t in texts_of(spark, SMALL)[:50]:
        found = quality_classifier.features([t or ""])[0]
        margin = sum(model.weights[k] for k in found) / np.sqrt(max(1, len(found))) + model.weights[-1]
        assert scored[i] == pytest.approx(1 / (1 + np.exp(-(model.slope * margin + model.shift))), abs=1e-9)


# 7 Jaccard join


def brute_components(texts, width=5):
    sets = []
    for _, t in texts:
        w = re.sub("[A-Z]+", lambda m: m[0].lower(), t or "")
        w = WORD.findall(w)
        sets.append({tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            if sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                    root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(texts):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return [(i, len(sets[k]), least.get(find(k), i)) for k, (i, _) in enumerate(texts)]


def test_jaccard_components(spark):
    draw = np.random.default_rng(5)
    made = []
    for g in range(12):
        words = [f"v{x}" for x in draw.integers(0, 400, int(draw.integers(5, 120)))]
        for _ in range(int(draw.integers(1, 12))):
            copy = list(words)
            for _ in range(int(draw.integers(0, 6))):
                copy[int(draw.integers(len(copy)))] = f"v{draw.integers(0, 400)}"
            made.append((int(len(made) * 7 % 1000 + 1000 * g), " ".join(copy), "en", "a"))
    for rows in (ODD, made):
        got = jaccard_join.jaccard_components(odd(spark, rows))
        assert rows_of(got, "doc_id", "n_shingles", "component_id") == sorted(brute_components([(i, t) for i, t, *_ in rows]), key=repr)
    assert jaccard_join.jaccard_components(odd(spark, [])).count() == 0


@pytest.mark.parametrize("task_rows", [7, 250_000])
def test_jaccard_links_are_joined_in_their_tasks(spark, monkeypatch, task_rows):
    """Components of random links, over several tasks and in one; links of one task take no rounds."""
    monkeypatch.setattr(jaccard_join.shared, "TASK_ROWS", task_rows)
    draw = np.random.default_rng(8)
    links = [(int(min(e)), int(max(e))) for e in draw.integers(0, 60, (40, 2)) if e[0] != e[1]] + [(100 + k, 101 + k) for k in range(30)]
    least = {x: x for e in links for x in e}
    for _ in least:
        for a, b in links:
            least[a] = least[b] = min(least[a], least[b])
    jobs = lambda: spark.sparkContext._jsc.sc().dagScheduler().numTotalJobs()
    table, began = spark.createDataFrame(links, "a long, b long").repartition(5), jobs()
    found = jaccard_join.components(table, len(links))
    assert task_rows == 7 or jobs() - began <= 3
    assert rows_of(found, "node", "component") == sorted(least.items(), key=repr)
    assert jaccard_join.components(table.limit(0), 0).count() == 0


def test_jaccard_lists_in_portions(spark, monkeypatch):
    """A list leaves in portions: x early, y last, similar to each other alone, meet in no other list."""
    one = lambda t: jaccard_join._sets([t], 5)[0]
    draw = np.random.default_rng(2)
    word = lambda: f"v{draw.integers(0, 10**9)}"
    shared = " ".join(word() for _ in range(5))
    while (top := one(shared)[0] | np.uint64(1 << 63)) < np.uint64(0xF800000000000000):
        shared = " ".join(word() for _ in range(5))
    of_four = []  # sets of four n-grams, all with the shared one as their last in the global order
    while len(of_four) < 6:
        t = shared + " " + " ".join(word() for _ in range(3))
        if (one(t) | np.uint64(1 << 63)).max() == top:
            of_four.append(t)
    of_four.sort(key=lambda t: jaccard_join._key(one(t)))
    y = of_four[0] + " " + word()
    while np.sort(one(y) | np.uint64(1 << 63))[-2] > top:
        y = of_four[0] + " " + word()
    made = list(enumerate([*of_four, y]))
    want = sorted(brute_components(made), key=repr)
    assert (6, 5, 0) in want and len({c for _, _, c in want}) == 6
    monkeypatch.setattr(jaccard_join, "FREQUENT", 0)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
        got = jaccard_join.jaccard_components(spark.createDataFrame(made, "doc_id long, text string"), portion=4)
        assert rows_of(got, "doc_id", "n_shingles", "component_id") == want
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_trie_search_is_exact():
    draw = np.random.default_rng(3)
    sets = [np.unique(draw.integers(0, 60, int(draw.integers(1, 50)))).astype(np.uint64) for _ in range(150)]
    for percent in (50, 80):
        trie = jaccard_join.Trie(sets)
        for probe in sets[:60]:
            want = {k for k, s in enumerate(sets) if 100 * (n := len(np.intersect1d(s, probe))) >= percent * (len(s) + len(probe) - n)}
            assert set(trie.search(probe, percent)) == want


# 8 mixing


def test_mixing(spark):
    got = mixing.mix(odd(spark))
    again = mixing.mix(odd(spark).repartition(3))
    assert rows_of(got, *got.columns) == rows_of(again, *got.columns)
    frame = got.toPandas()
    assert len(frame) == len(ODD) and (frame["taken"] <= 2 * frame["size"]).all()
    assert mixing.mix(odd(spark, [])).count() == 0
    whole = queries.op8_mixing(spark, MIDDLE).join(documents(spark, MIDDLE).select("doc_id", "source"), "doc_id").toPandas()
    for _, part in whole.groupby("source", dropna=False):
        assert abs(part["taken"].sum() - part["target"].iloc[0]) <= part["size"].max()
    assert abs(whole.groupby("source", dropna=False)["target"].first().sum() - 1.5 * whole["size"].sum()) < 1


# 9 license scans


def brute_base(text):
    low = re.sub("[A-Z]+", lambda m: m[0].lower(), text or "")
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    places = [(k, label) for phrase, label in license_scan.BASE.items() for p in [phrase.split()] for k in range(len(w)) if w[k : k + len(p)] == p]
    starts = [k for k, _ in places]
    return len(w), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


def test_license_scan(spark):
    columns = ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")
    assert rows_of(queries.op9_license_scan(spark, MIDDLE), *columns) == sorted(((i, *brute_base(t)) for i, t in texts_of(spark, MIDDLE)), key=repr)
    got = license_scan.scan_licenses(odd(spark))
    assert rows_of(got, *columns) == sorted(((i, *brute_base(t)) for i, t, *_ in ODD), key=repr)
    assert got.where("not (score between 0 and 1)").count() == 0
    assert license_scan.scan_licenses(odd(spark, [])).count() == 0


def test_license_rules_and_suppression():
    assert len(license_scan.rules()) > 300
    found = license_scan.scan_text("This is licensed under the GNU General Public License version 3.")
    assert [x["label"] for x in found["spans"]] == ["gpl-3.0"] and found["labels"] == "gpl,gpl-3.0"
    assert license_scan.scan_text("SPDX-License-Identifier: MIT")["labels"] == "mit"
    many = license_scan.scan_text("all rights reserved. MIT License. " * 20_000)  # suppression must not take quadratic time
    assert many["n_base"] == 20_000 and many["last_word"] == 5 * 19_999


def test_suppression_against_brute_force():
    draw = np.random.default_rng(2)
    for _ in range(200):
        found = [(int(a), int(a + draw.integers(1, 12))) for a in draw.integers(0, 40, 15)]
        kept = []
        for a, b in found:
            if not any(x <= a and b <= y for x, y in kept):
                kept.append((a, b))
        assert license_scan.uncovered(found) == [f in kept and found.index(f) == k for k, f in enumerate(found)]


def test_pandas_is_not_needed_for_native_operators():
    import inspect

    from tessera.llm import sharding

    for module in (quality_rules, sharding):
        source = inspect.getsource(module)
        assert not re.search(r"import (pandas|numpy|pyarrow)|mapIn|applyIn|\budf\b|\.rdd\b", source)
    assert pd.__version__


def brute_mix(rows, lean):
    """(id, size, copies) of rows (id, text, source): expected copies by bisection, then a sort for each source."""
    size = [len(WORD.findall(t or "")) for _, t, _ in rows]
    names = sorted({s for *_, s in rows if s is not None}) + [None] * any(s is None for *_, s in rows)
    total = {n: sum(k for k, r in zip(size, rows, strict=True) if r[2] == n) for n in names}
    weight = {n: mixing.WEIGHTS[k % 3] for k, n in enumerate(names)}

    def level(words, weights, goal, cap):
        low, high = 0.0, 1e9
        for _ in range(300):
            mid = (low + high) / 2
            low, high = (mid, high) if sum(min(cap * w, mid * x * w) for w, x in zip(words, weights, strict=True)) < goal else (low, mid)
        return high

    all_words = 1.5 * sum(total.values())
    low, high = 0.0, 1e9
    for _ in range(300):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(min(2 * total[n], mid * weight[n]) for n in names) < all_words else (low, mid)
    water = high
    out = []
    for n in names:
        mine = [k for k, r in enumerate(rows) if r[2] == n]
        target = min(2 * total[n], water * weight[n])
        factor = level([size[k] for k in mine], [lean(size[k]) for k in mine], target * (1 - 1e-12), 2)
        e = {k: min(2.0, factor * lean(size[k])) for k in mine}
        e = {k: round(x) if abs(x - round(x)) < 1e-9 else x for k, x in e.items()}
        left = target - sum(int(e[k]) * size[k] for k in mine)

        def odds(k, e=e):
            u = (int(hashlib.md5(f"mix-1:{'null' if rows[k][0] is None else rows[k][0]}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
            p = e[k] - int(e[k])
            return u / (1 - u) / (p / (1 - p))

        drawn = sorted((odds(k), rows[k][0] is not None, rows[k][0] or 0, size[k], k) for k in mine if e[k] > int(e[k]) and size[k])
        copies, before = {k: int(e[k]) if size[k] else 0 for k in mine}, 0
        for *_, n_words, k in drawn:
            copies[k] += before + n_words / 2 <= left
            before += n_words
        out += [(rows[k][0], size[k], copies[k]) for k in mine]
    return sorted(out, key=repr)


@pytest.mark.parametrize("lean", [lambda n: 1.0 + 0 * n, lambda n: 2.0 ** (n % 4)])
def test_mixing_with_unequal_inclusion(spark, lean):
    draw = np.random.default_rng(4)
    rows = [(k, " ".join(["w"] * int(draw.integers(0, 60))), ["a", "b", "c", None][int(draw.integers(0, 4)) if k % 3 else 0]) for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    column = (lambda n: F.lit(1.0)) if lean(3) == 1.0 else (lambda n: F.pow(F.lit(2.0), n % 4))
    assert rows_of(mixing.mix(docs, leaning=column), "doc_id", "size", "copies") == brute_mix(rows, lean)


def test_least_determinant_against_all_subsets(spark):
    """A core of 9 of 12 rows, against the least regularised determinant over all 220 subsets."""
    from itertools import combinations

    draw = np.random.default_rng(6)
    rows, groups = [], {}
    for g in range(4):
        x = draw.normal(size=(12, 4)) * [0.2, 0.4, 0.3, 0.6]
        x[:g] += draw.normal(size=4) * 3 + 5  # none to three of them far off
        groups[str(g)] = x
        rows += [(k, str(g), *map(float, r)) for k, r in enumerate(x)]
    found = quality_rules.least_determinant(spark.createDataFrame(rows, "_row int, _group string, x_0 double, x_1 double, x_2 double, x_3 double"))
    got = {r["_group"]: r for r in found.collect()}
    floor = np.diag(np.square(quality_rules.FLOOR))
    for g, x in groups.items():
        least = min(np.linalg.slogdet(np.cov(x[list(s)].T, bias=True) * quality_rules.CONSISTENT + floor)[1] for s in combinations(range(12), 9))
        assert least - 1e-9 <= got[g]["log_det"] <= least + 0.5
        assert abs(got[g]["m_0"]) < 1  # the far rows are not in the core


@pytest.mark.parametrize(
    "notice, label",
    [
        ("This work is licensed under CC BY-SA 4.0.", "cc-by-sa-4.0"),
        ("Released under CC BY-NC 4.0", "cc-by-nc"),
        ("Photo: CC BY-SA 3.0 by someone", "cc-by-sa-3.0"),
        ("See the Apache License for details.", "apache"),
        ("It uses the Mozilla Public License.", "mpl"),
        ("distributed under a BSD license", "bsd"),
        ("a Creative Commons Attribution license", "cc-by"),
        ("a Creative Commons Attribution-NonCommercial-ShareAlike license", "cc-by-nc-sa"),
        ("GNU Lesser General Public License", "lgpl"),
        ("Licensed under the Apache License, Version 2.0 (the License)", "apache-2.0"),
        ("The code is available under MIT.", "mit"),
        ("SPDX-License-Identifier: GPL-2.0-or-later", "gpl-2.0"),
        ("either version 3 of the License, or (at your option) any later version", "gpl-3.0"),
        ("The above copyright notice and this permission notice shall be included in all copies", "mit"),
        ("Redistributions of source code must retain the above copyright notice", "bsd"),
        ("This is free and unencumbered software released into the public domain.", "unlicense"),
        ("Altered source versions must be plainly marked as such", "zlib"),
        ("https://creativecommons.org/licenses/by-nc-nd/4.0/", "cc-by-nc-nd"),
        ("This material may not be published, broadcast, rewritten, or redistributed without permission", "proprietary"),
        ("Reproduction interdite", "proprietary"),
        ("sous licence Creative Commons", "cc"),
        ("Prohibida la reproducción total o parcial", "proprietary"),
        ("For non-commercial use only.", "non-commercial"),
        ("Vervielfältigung für gewerbliche Zwecke verboten", "proprietary"),
        ("Neither the name of Universität Zürich nor the names of its contributors may be used to endorse or promote products", "bsd-3-clause"),
    ],
)
def test_license_notices_are_found(notice, label):
    assert label in license_scan.scan_text("Some words before. " + notice + " And some after.")["labels"].split(",")


def test_keywords_are_in_every_match():
    """The gate of a rule never hides a match: scans without gates find the same."""
    notices = [n for mark in test_license_notices_are_found.pytestmark for n, _ in mark.args[1]]
    for text in [*notices, " ".join(notices), "nothing of that kind"]:
        line = license_scan.folded(text)[1]
        free = [license_scan.Rule(r.label, (b"",), r.pattern, r.priority, r.confidence) for r in license_scan.rules()]
        key = lambda d: (d[0], d[1], d[2].label, d[2].priority)
        assert sorted(map(key, license_scan.detections(line, license_scan.rules()))) == sorted(map(key, license_scan.detections(line, tuple(free))))
