"""Periodic runs, importance resampling and language identification against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import language, periodic, resample
from quillon.llm.queries import queries

BIG = 1 << 62
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
CLASHES = ("_id", "h", "n", "rank", "start", "period", "length", "runs", "collapsed", "weight", "score", "_at", "_range", "_tie", "place", "cut", "lang_pred", "held_out", "bucket", "_best")


def write(spark, folder, name, rows, schema):
    frame = spark.createDataFrame(rows, schema)
    frame.withColumns({c: F.lit("x") for c in CLASHES if c not in frame.columns}).write.parquet(f"{folder}/{name}.parquet")


def plain_runs(w):
    seen = {}
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            start = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i - start + q >= max(12, 2 * q):
                seen.setdefault((start, i - start + q), q)
    return sorted((s, n, q) for (s, n), q in seen.items())


def odd_sequence(rng):
    """Words in shapes that are hard for minimizers: constant, Fibonacci, touching runs, runs in runs."""
    n, letters = rng.randint(0, 300), rng.choice([1, 2, 3, 5, 50])
    base = [rng.randrange(letters) for _ in range(n)]
    kind = rng.randint(0, 7)
    if kind == 1 and n:
        p = rng.randint(1, max(1, n // 2))
        return [base[i % p] for i in range(n)]
    if kind == 2:
        return [0, 1] * rng.randint(5, 90) + [1, 0] * rng.randint(5, 90) + base[:40]
    if kind == 3:
        u = [rng.randrange(3) for _ in range(rng.randint(30, 120))]
        return base[:50] + u * 2 + base[50:90] + u * 3
    if kind == 4:
        r, k = [rng.randrange(4) for _ in range(rng.randint(2, 6))], rng.randrange(6)
        return (r * rng.randint(10, 30) + (r[k:] + r[:k]) * rng.randint(10, 30)) * rng.randint(1, 3)
    if kind == 5:
        x, y = [0], [0, 1]
        while len(y) < 250:
            x, y = y, y + x
        return y
    if kind == 6:
        return ([0] * rng.randint(1, 80) + [1] + [0] * rng.randint(1, 80)) * rng.randint(2, 3) + base[:20]
    return ([0, 1] * rng.randint(8, 40) + [1]) * 4


def test_runs_of_hard_sequences_equal_a_scan_of_all_lags():
    rng = random.Random(5)
    for _ in range(12):
        docs = [odd_sequence(rng) for _ in range(30)]
        offsets = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
        got = periodic.runs_of(np.array(sum(docs, []), np.int64), offsets)
        for k, d in enumerate(docs):
            assert [x[1:] for x in got if x[0] == k] == plain_runs(d), d


def test_long_runs_take_no_quadratic_work():
    n = 200_000
    for words, want in ((np.zeros(n, np.int64), [(0, 0, n, 1)]), (np.tile(np.arange(70_000), 3)[:n], [(0, 0, n, 70_000)])):
        assert periodic.runs_of(words, np.array([0, n])) == want
    halves = np.concatenate([np.tile([0, 1], 20_000), np.tile([1, 0], 20_000)])
    assert len(periodic.runs_of(halves, np.array([0, len(halves)]))) == len(plain_runs(halves[39_000:41_000].tolist())) + 19_500
    assert periodic.runs_of(halves[39_900:40_100], np.array([0, 200])) == [(0, *x) for x in plain_runs(halves[39_900:40_100].tolist())]


def test_periodic_query_on_odd_documents(spark, tmp_path):
    rng = random.Random(8)
    rows = [(BIG + k, " ".join(f"w{x}" for x in odd_sequence(rng)) + rng.choice(["", " ", "\n"])) for k in range(80)]
    rows += [(None, "a b " * 9), (None, None), (1, ""), (2, " \t\n"), (3, "é   " * 30), rows[0], (4, "x " * 60000), (5, "one two three")]
    write(spark, str(tmp_path), "documents", [(i, t, "en", "s", 0) for i, t in rows], DOCS)
    want = Counter()
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        h = zlib.crc32(str(i).encode()) if i is not None else 1
        if h % 10 == 0 and w:
            g = h // 10
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            w = w[:a] + [w[a + (j - a) % p] for j in range(a, len(w))]
        runs = plain_runs(w) if len(w) < 5000 else [(0, len(w), 1)]
        gone = {j for s, n, q in runs for j in range(s + q, s + n)}
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want[(i, len(runs), *best, 1000 * best[1] // best[2] if runs else None, digest("".join(f"{s},{n},{q}\n" for s, n, q in sorted(runs, key=lambda r: (r[0], r[2])))), digest(" ".join(x for j, x in enumerate(w) if j not in gone)))] += 1
    got = queries()["op12_periodic_runs"](spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert Counter(map(tuple, got.collect())) == want


def test_collapsed_text_and_spans_without_planted_repeats(spark):
    docs = spark.createDataFrame([(1, "go " + "ab cd ef " * 5 + "stop"), (2, "a b c")], "doc_id long, text string")
    got = {r.doc_id: r for r in periodic.find_runs(docs).collect()}
    assert [tuple(x) for x in got[1].runs] == [(1, 15, 3)] and got[1].collapsed == "go ab cd ef stop" and got[2].runs == [] and got[2].collapsed == "a b c"


def plain_resample(rows, target, max_n=1, n_buckets=10_000):
    def grams(t):
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        return w, [zlib.crc32(" ".join(w[i : i + n]).encode()) % n_buckets for n in range(1, max_n + 1) for i in range(len(w) - n + 1)]

    s, t = Counter(), Counter()
    for _, x in rows:
        s.update(grams(x)[1])
    for x in target:
        t.update(grams(x)[1])
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s_all + n_buckets) / ((s[b] + 1) * (t_all + n_buckets))))
    out = []
    for i, x in rows:
        w, g = grams(x)
        weight = sum(map(gain, g))
        h = int(hashlib.sha256(f"2024:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(g), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(w)])
    able = sorted((r for r in out if r[5] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(able[: len(able) * 10 // 100], 1):
        r[4] = k
    return out


@pytest.fixture(scope="module")
def mixed_rows():
    rng = random.Random(3)
    words = [f"Word{k}" for k in range(300)] + ["Ärger", "naïve", "漢字", "x-ray", "don't", "9a"]
    rows = [(BIG + k, " ".join(rng.choices(words[k % 7 * 40 :], k=rng.randint(0, 90)))) for k in range(700)]
    # A third of all rows are the same, and nulls of all kinds.
    rows += [(7, "same words " * 12)] * 350 + [(None, None), (None, "alpha beta " * 11), (None, "alpha beta " * 11), (1, ""), (2, "\x00 ! \x7f"), (3, "Long " * 40000)]
    return rows, [" ".join(rng.choices(words[:80], k=60)) for _ in range(30)] + [None, ""]


def test_resampling_query_equals_plain_formulas(spark, tmp_path, mixed_rows):
    rows, target = mixed_rows
    write(spark, str(tmp_path), "documents", [(i, t, "en", "s", 0) for i, t in rows], DOCS)
    write(spark, str(tmp_path), "benchmark", list(enumerate(target)), "item_id long, text string")
    got = Counter(map(tuple, queries()["op11_importance_resampling"](spark, str(tmp_path)).collect()))
    assert got == Counter(tuple(r[:5]) for r in plain_resample(rows, target))


def test_longer_features_are_hashed_as_their_text(spark, mixed_rows):
    rows, target = mixed_rows
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = resample.resample(docs, spark.createDataFrame([(t,) for t in target], "text string"), max_n=3, n_buckets=5000)
    want = plain_resample(rows, target, max_n=3, n_buckets=5000)
    assert Counter((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in got.collect()) == Counter(tuple(r[:5]) for r in want)


def test_numbers_are_gapless_over_ranges(spark):
    rows = spark.range(0, 5000, 1, 7).selectExpr("id", "cast(id % 3 as long) as k")
    got = resample.numbered(rows, [F.col("k").desc(), F.col("id")], "place").orderBy("place").collect()
    assert [r["place"] for r in got] == list(range(1, 5001)) and [(r.k, r.id) for r in got] == sorted(((r.k, r.id) for r in got), key=lambda x: (-x[0], x[1]))


def test_languages_of_held_out_documents(spark):
    folder = "/root/testdata/sf0.01"
    got = queries()["op13_language"](spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang", "text")
    rows = got.join(docs, "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert len(rows) == docs.count() and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in rows)
    assert sum(r.lang == r.lang_pred for r in held) >= 0.99 * len(held)


def test_language_query_of_odd_documents(spark, tmp_path):
    rng = random.Random(6)
    make = lambda letters: " ".join("".join(rng.choices(letters, k=rng.randint(2, 7))) for _ in range(40))
    kinds = {"xx": "abcdefg", "yy": "mnopqrs", "zz": "абвгде"}
    rows = [(BIG + 100 * j + k, make(letters), name) for k in range(60) for j, (name, letters) in enumerate(kinds.items())]
    rows += [(BIG + 1000 + k, "abc gfe", None) for k in range(5)] + [(None, make("mnopqrs"), "yy"), (1, None, "xx"), (2, "", "xx"), (3, "12 !?", "yy"), (4, "漢", "zz"), (5, make("абвгде") * 3000, "zz"), (6, "b", "xx"), rows[0], rows[0]]
    rows += [(BIG + 5000 + k, "all the same text mnopqrs", "yy") for k in range(300)]
    write(spark, str(tmp_path), "documents", [(i, t, n, "s", 0) for i, t, n in rows], DOCS)
    got = queries()["op13_language"](spark, str(tmp_path)).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, *_ in rows)
    by = {r.doc_id: r for r in got}
    assert all(by[i].lang_pred == "und" and by[i].score == 0 for i in (1, 2, 3)) and by[4].lang_pred in kinds and by[5].lang_pred == "zz" and by[6].lang_pred == "xx" and by[None].lang_pred == "yy"
    assert all(by[i].lang_pred == n for i, _, n in rows[:180]) and not by[None].held_out


def plain_pieces(text):
    low = "".join(c if c.isalpha() else " " for c in text.lower())
    return {x for w in low.split() for n in (1, 2, 3) for i in range(len(w) + 3 - n) if (x := f" {w} "[i : i + n]) != " "}


@pytest.mark.parametrize("table", [1 << 22, 0])
def test_presence_of_pieces_equals_plain_sets(monkeypatch, table):
    monkeypatch.setattr(language, "TABLE", table)
    number = lambda x: sum(ord(c) << (21 * (len(x) - 1 - k)) for k, c in enumerate(x))
    texts = ["Ab ab!", "a-b", "", "xyz", "ÉTÉ d'été 7 漢字", "  a  ", "b" * 50, "\x00a\x00"]
    known = sorted({x for t in texts[:5] for x in plain_pieces(t)} - {"xy", "字"}, key=number)
    there, has = language.Spectrum(np.array([number(x) for x in known])).presence(texts)
    for row, letter, t in zip(there, has, texts):
        assert {x for x, on in zip(known, row) if on} == plain_pieces(t) & set(known) and letter == bool(plain_pieces(t))
        assert len(language.pieces(language.coded([t])[0])) == len(plain_pieces(t))


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "some text", None), (2, None, None)], "doc_id long, text string, lang string")
    assert [(r.lang_pred, r.score) for r in language.predict(docs, language.train(docs)).collect()] == [("und", 0.0)] * 2


def test_line_dedup_with_one_line_in_a_third_of_all_rows(spark, monkeypatch):
    from quillon.llm import line_dedup

    rng = random.Random(12)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    run = "\n".join(" ".join(word() for _ in range(20)) for _ in range(4))
    texts = ["\n\n".join(" ".join(word() for _ in range(6)) for _ in range(rng.randint(1, 8))) + ("\n" + run if k % 9 == 0 else "") + "\n\n\n" for k in range(150)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    plain = {r.doc_id: r.text for r in line_dedup.delete_repeats(docs).collect()}
    monkeypatch.setattr(line_dedup, "HOT_LEAST", 20)
    monkeypatch.setattr(line_dedup, "HOT_KEYS", 50)
    hot = {r.doc_id: r.text for r in line_dedup.delete_repeats(docs).collect()}
    assert hot == plain and run in hot[0] and all(run not in hot[k] for k in range(9, 150, 9)) and all(hot[k] == texts[k] for k in range(150) if k % 9)


def test_nearest_neighbours_with_clashing_columns(spark, tmp_path):
    rng = np.random.RandomState(2)
    vectors = rng.randn(300, 8)
    rows = [(k, [float(x) for x in v], 0) for k, v in enumerate(vectors)] + [(1000, None, 0), (1001, [0.0] * 8, 0), (1020, [float("nan")] * 8, 0), (1040, [1.0, None] + [0.0] * 6, 0)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    frame.withColumns({c: F.lit("x") for c in ("id", "leaf", "part", "query_id", "rank", "score", "v", "h", "n", "norm", "item", "key", "neighbours")}).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = queries()["op2_nearest_neighbours"](spark, str(tmp_path)).collect()
    truth = {k: set(np.argsort(-(vectors @ vectors[k]), kind="stable")[:21].tolist()) - {k} for k in range(0, 300, 20)}
    assert {r.query_id for r in got} == set(truth) and all(r.vec_id < 300 for r in got)
    hits = sum(r.vec_id in truth[r.query_id] for r in got)
    assert hits >= 0.9 * 20 * len(truth) and all(abs(r.score - vectors[r.query_id] @ vectors[r.vec_id]) < 1e-5 for r in got)
