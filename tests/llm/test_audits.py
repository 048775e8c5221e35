"""Operators 11 to 13: filter audits as a stream, tokens of two tokenizers, secrets."""

from __future__ import annotations

import hashlib
import itertools
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tessera.llm import filter_audit, queries, secret_scan, token_alignment

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, extra int"
LONG = " ".join(f"w{k}" for k in range(120))


def failed(text, copy):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    fails = (len(words) < 100, 100 * len(set(words)) < 80 * len(words), 100 * len(re.findall("[A-Z]", text)) > 10 * len(text), bool(re.search(r"[#$%&*|]", text)), copy)
    return {x for x, f in zip("ABCDE", fails, strict=True) if f}


def plain_audit(docs, labels):
    """Every order applied to every document, one by one."""
    rows = []
    for i, text, lang, *_ in docs:
        copy = i is not None and any(j is not None and j < i and (t or "") == (text or "") for j, t, *_ in docs)
        good = any(j == i and q == 1 for j, q, _ in labels if j is not None)
        toxic = any(j == i and x == 1 for j, _, x in labels if j is not None)
        rows.append((lang or "", failed(text, copy), good, toxic))
    out, shapley = {}, Counter()
    for part in {p for p, *_ in rows}:
        for order in map("".join, itertools.permutations("ABCDE")):
            for step, letter in enumerate(order, 1):
                c = Counter()
                for p, fails, good, toxic in rows:
                    if p == part:
                        gone = bool(fails & set(order[: step - 1]))
                        removed = letter in fails and not gone
                        c.update(kept=letter not in fails and not gone, removed=removed, redundant=letter in fails and gone, unique_fails=fails == {letter}, good_lost=removed and good, toxic_lost=removed and toxic)
                shapley[part, letter] += c["removed"]
                out[part, order, step] = [c[x] for x in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")]
    return {(*k, *v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def audited(spark, path, docs, labels, files=1, **more):
    for k in range(files):
        spark.createDataFrame(docs[k::files], DOCS).coalesce(1).write.mode("append").parquet(path)
    stream = filter_audit.document_stream(spark, path, batches=files)
    found = filter_audit.audit(stream, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), **more)
    return {tuple(r) for r in found.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley").collect()}


ODD = [
    (9, LONG, "en", 1), (5, LONG, "fr", 1), (7, LONG, "en", 1), (2, LONG, None, 1), (None, LONG, "en", 1), (None, LONG, None, 1),
    (3, "", "en", 1), (4, None, "en", 1), (4, None, "en", 1), (4, None, "fr", 1), (1, "SHOUT # x", "", 1), (8, "x " * 300, "de", 1), (10, LONG + " A" * 90, "de", 1),
]
MARKS = [(9, 1, 1), (9, 0, None), (5, None, 1), (None, 1, 1), (2, 1, 0), (77, 1, 1)]


@pytest.mark.parametrize("files", [1, 5, 13])
def test_audit_retracts_what_a_smaller_id_displaces(spark, tmp_path, files):
    assert audited(spark, str(tmp_path / "docs"), ODD, MARKS, files) == plain_audit(ODD, MARKS)


def test_audit_of_nothing(spark, tmp_path):
    assert audited(spark, str(tmp_path / "docs"), [], []) == set()


def test_audit_goes_on_where_it_stopped(spark, tmp_path):
    folder, place = str(tmp_path / "docs"), str(tmp_path / "run")
    assert audited(spark, folder, ODD[:4], MARKS, folder=place) == plain_audit(ODD[:4], MARKS)
    assert audited(spark, folder, ODD[4:], MARKS, 11, folder=place) == plain_audit(ODD, MARKS)
    # a batch that is done again finds only the batches before it
    assert filter_audit.state_before(spark, place, 1).count() == 4  # the text is held by three parts, one of them with and without labels


def test_audit_is_what_sql_says(spark, same_as_sql):
    same_as_sql(queries.op11_filter_audit(spark, SF), queries.OP11_SQL, SF)


# -- tokens of two tokenizers

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [
    "Plain words, and  two spaces.\n\tTabs", None, "", " ", "  a  b ", "a▁b", "<|endoftext|> x </s> <0x41>", "日本語 \U0001f600 é", "a\x00b", "x", "x", "Überraschung " * 40, "z" * 3000,
]


def plain_alignment(texts):
    """Columns of every text, from the libraries' own tokens and every pair of them."""
    import sentencepiece
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(A)
    tok.encode_special_tokens = True
    model, table = sentencepiece.SentencePieceProcessor(model_file=B), token_alignment.load_bytes(A).bytes
    rows, links = [], []
    for text in texts:
        text = text or ""
        a, b = tok.encode(" " + text, add_special_tokens=False).ids, model.encode(text)
        raw_a = [table[x] for x in a]
        raw_b = [bytes([int(p[3:5], 16)]) if model.is_byte(x) else p.replace("▁", " ").encode() for x in b for p in [model.id_to_piece(x)]]
        if not text or not b"".join(raw_a) == (" " + text).encode() == b"".join(raw_b):
            rows.append((0, 0, 0, 0, ""))
            links.append([])
            continue
        at_a, at_b = np.cumsum([0, *map(len, raw_a)]).tolist(), np.cumsum([0, *map(len, raw_b)]).tolist()
        both = sorted(set(at_a[1:]) & set(at_b[1:]))
        groups = ";".join(",".join(str(x) for x, e in zip(a, at_a[1:], strict=True) if lo < e <= hi) + "|" + ",".join(str(x) for x, e in zip(b, at_b[1:], strict=True) if lo < e <= hi) for lo, hi in zip([0, *both], both, strict=False))
        pairs = [(x, y) for i, x in enumerate(a) for j, y in enumerate(b) if at_a[i] < at_b[j + 1] and at_b[j] < at_a[i + 1]]
        rows.append((len(a), len(b), len(both), len(pairs), hashlib.sha256(groups.encode()).hexdigest()))
        links.append(pairs)
    total = Counter(p for pairs in links for p in pairs)
    highest: dict = {}
    for (_, y), n in total.items():
        highest[y] = max(n, highest.get(y, 0))
    return [(*r[:4], sum(total[p] == highest[p[1]] for p in pairs), sum(total[p] for p in pairs), r[4]) for r, pairs in zip(rows, links, strict=True)]


def test_galloping_is_a_search(hypothesis_seed=3):
    rng = np.random.default_rng(hypothesis_seed)
    for n, m, stride in [(1, 1, 2), (5, 400, 2), (300, 400, 8), (1000, 1000, 3), (64, 9000, 8)]:
        short, long = np.unique(rng.integers(0, 10_000, n)), np.unique(rng.integers(0, 10_000, m))
        long = np.append(long, 10_000)
        assert token_alignment.gallop(short, long, stride).tolist() == np.searchsorted(long, short).tolist()


@pytest.mark.parametrize("run", [1, 50, 10**6])
def test_alignment_is_that_of_all_pairs(spark, run):
    rows = [(k, t, 1) for k, t in enumerate(TEXTS)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, block int")
    found = token_alignment.align_documents(docs, A, B, run=run).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    assert sorted(map(tuple, found.collect())) == [(k, *r) for k, r in enumerate(plain_alignment(TEXTS))]


def test_alignment_of_odd_rows(spark):
    docs = spark.createDataFrame([(None, "same words"), (1, "same words"), (1, "same words"), (None, None)], "doc_id long, text string")
    found = token_alignment.align_documents(docs, A, B)
    one = plain_alignment(["same words"] * 3)[0]
    assert sorted(map(tuple, found.select("doc_id", "n_a", "count_sum").collect()), key=repr) == sorted([(None, one[0], one[5]), (1, one[0], one[5]), (1, one[0], one[5]), (None, 0, 0)], key=repr)
    assert token_alignment.align_documents(docs.limit(0), A, B).count() == 0


def test_alignment_query(spark):
    texts = [r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").where("n_chars < 1500").orderBy("doc_id").collect()][:40]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = token_alignment.align_documents(docs, A, B).orderBy("doc_id").drop("doc_id")
    assert list(map(tuple, found.collect())) == plain_alignment(texts)
    assert queries.op12_token_alignment(spark, SF).count() == spark.read.parquet(f"{SF}/documents.parquet").count()


# -- secrets


def plain_base(text):
    """The fixed patterns, spelled as the contract has them."""
    text, out = text or "", []
    for m in re.finditer(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m.group(2)) >= 6:
            out.append((m.start(), 0, f"assign:{m.start()}:{m.end()}"))
    for k, (kind, pattern, least) in enumerate((("access", "AKIA[A-Z0-9]+", 20), ("hex", "[0-9a-f]+", 24)), 1):
        out += [(m.start(), k, f"{kind}:{m.start()}:{m.end()}") for m in re.finditer(pattern, text) if len(m.group()) >= least]
    names = [x for *_, x in sorted(out)]
    return (*(sum(x.startswith(k) for x in names) for k in ("assign", "access", "hex")), hashlib.sha256(",".join(names).encode()).hexdigest(), names)


CASES = [
    None, "", "no secrets", "password = 'abc'", "PASSWORD:\"abcdef\"", "api_key=token=abcdef1", "apiKey : x.y=z", "ſecret=abcdefgh", "toKen=abcdefgh", "AKIA" + "A" * 15, "AKIA" + "B7" * 9, "AKIAAKIA" + "C" * 20,
    "a" * 23, "f0" * 12, "\U0001f600 é token=" + "0a" * 20 + " AKIA" + "X" * 16, "secret\n=abcdefgh", "passwd==abcdef", "İ token=abcdefg",
]


def test_base_secrets(spark):
    docs = spark.createDataFrame([(k, t, 0) for k, t in enumerate(CASES)], "doc_id long, text string, spans int")
    found = {r["doc_id"]: r for r in secret_scan.scan_secrets(docs).collect()}
    for k, text in enumerate(CASES):
        *counts, sha, names = plain_base(text)
        assert [found[k][c] for c in ("n_assign", "n_access", "n_hex", "base_sha256")] == [*counts, sha]
        assert [x for x in found[k]["spans"].split(",") if x and not x.startswith("random")] == names


def test_base_secrets_of_a_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = {r["doc_id"]: r for r in queries.op13_secret_scan(spark, SF).collect()}
    for r in docs.collect():
        *counts, sha, names = plain_base(r["text"])
        assert [found[r["doc_id"]][c] for c in ("n_assign", "n_access", "n_hex", "base_sha256")] == [*counts, sha]
        assert set(names) <= set(found[r["doc_id"]]["spans"].split(",")) | {""}


def test_tests_hold_their_level():
    rng = random.Random(5)
    for name, (alphabet, _, least) in secret_scan.ENCODINGS.items():
        for n in (least, 80):
            p = np.array([(*(tests := secret_scan.battery("".join(rng.choices(alphabet, k=n)), name)), secret_scan.combined(tests)) for _ in range(800)])
            assert ((p < 0.05).mean(0) < 0.09).all()
            assert (p[:, 3] < 0.001).mean() < 0.012


NAMES = ["camelCaseIdentifierName12", "org/apache/Spark4/sql/Functions", "lowercasewords1234567890", "my-file-Name-2024-10-version", "HTTPServerConnectionPoolManager2", "src/main/java/com/Example/App2"]


def test_random_strings_are_found_and_names_are_not(spark):
    rng = random.Random(7)
    keys = ["".join(rng.choices(secret_scan.ENCODINGS[e][0], k=n)) for e in ("base62", "base64", "base36-lower", "base32") for n in (32, 44, 60) for _ in range(25)]
    docs = spark.createDataFrame([(k, f"see {x} there") for k, x in enumerate(keys + NAMES)], "doc_id long, text string")
    found = {r["doc_id"]: r["spans"] for r in secret_scan.scan_secrets(docs).collect()}
    caught = sum(found[k] == f"random:4:{4 + len(x)}" for k, x in enumerate(keys))
    assert caught >= 0.97 * len(keys)
    assert [found[len(keys) + k] for k in range(len(NAMES))] == [""] * len(NAMES)


def test_control_is_the_step_up_rule(spark):
    """Thresholds from counts of bins are Benjamini and Hochberg's over p-values rounded up to their bin."""
    rng = random.Random(11)
    rows = [(0, rng.choice([0, 7]), min(secret_scan.BINS, int(rng.expovariate(0.25)))) for _ in range(500)]
    tested = spark.createDataFrame([([(0, 1, s, b)],) for _, s, b in rows], "candidates array<struct<start:long,end:long,stratum:int,bin:int>>")
    limit = secret_scan.thresholds(tested)
    for stratum in (0, 7):
        p = sorted(10 ** (-b * secret_scan.BIN) for _, s, b in rows if s == stratum)
        passing = [x for i, x in enumerate(p, 1) if len(p) * x / i <= secret_scan.RATE * (1 + 1e-12)]
        got = {10 ** (-b * secret_scan.BIN) for _, s, b in rows if s == stratum and b >= limit.get(stratum, 10**9)}
        assert got == {x for x in p if passing and x <= max(passing)}


def test_secrets_of_odd_rows(spark):
    docs = spark.createDataFrame([(None, "token=abcdefg"), (1, "token=abcdefg"), (1, "token=abcdefg")], "doc_id long, text string").withColumn("base", F.lit(1))
    assert [tuple(r)[0::5] for r in secret_scan.scan_secrets(docs).collect()] and secret_scan.scan_secrets(docs).where("spans = 'assign:0:13'").count() == 3
    assert secret_scan.scan_secrets(docs.limit(0)).count() == 0


# -- samples of ids


def test_samples_are_of_distinct_ids(spark):
    from tessera.llm.common import hash_sample

    def drawn(rows, limit):
        return Counter(r["g"] for r in hash_sample(rows, "g", limit).collect())

    ids = spark.range(400).select(F.lit("a").alias("g"), "id")
    many = ids.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(100)))).drop("k")
    hot = ids.where("id < 50").unionByName(spark.range(200_000).select(F.lit("a").alias("g"), F.lit(7).cast("long").alias("id")))
    assert drawn(many, 400) == {"a": 400} and drawn(many, 30) == {"a": 30} and drawn(hot, 400) == {"a": 50} and drawn(hot, 1) == {"a": 1}
    assert {tuple(r) for r in hash_sample(many, "g", 30).collect()} == {tuple(r) for r in hash_sample(ids, "g", 30).collect()}


def test_languages_are_learned_beside_a_hot_row(spark):
    """Each row 20 times, and one French row 30 000 times: accuracy as on the plain table, all languages learned."""
    from tessera.llm import language_id
    from tessera.llm.common import is_held_out

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("n_chars < 4000").select("doc_id", "text", "lang")
    train = ~is_held_out(F.col("doc_id"))
    one = docs.where(train & (F.col("lang") == "fr")).orderBy("n_chars" if "n_chars" in docs.columns else "doc_id").limit(1)
    repeated = docs.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(20)))).drop("k").unionByName(one.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(30_000)))).drop("k"))

    def accuracy(model):
        found = language_id.identify(docs.where(~train), model, keep=[F.col("lang")]).collect()
        return sum(r["lang"] == r["lang_pred"] for r in found) / len(found)

    plain, other = language_id.fit(docs, train), language_id.fit(repeated, train)
    assert other.families == plain.families
    assert accuracy(other) == accuracy(plain)
