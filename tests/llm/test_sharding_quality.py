"""Sharding and quality rules against plain Python."""

import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillon.llm import quality, sharding

WS = " \t\n\x0b\x0c\r"
SCHEMA = "doc_id long, text string, source string"


def words(text):
    out, now = [], ""
    for c in text or "":
        if c in WS:
            out, now = out + [now] * bool(now), ""
        else:
            now += c
    return out + [now] * bool(now)


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, f"word{i} " * (i % 90), "a") for i in range(200)]
    rows += [(300, None, None), (301, "", "b"), (302, "the cat sat on the mat the cat sat\nx\nx\n\n y z", "b"), (None, "no id", "c"), (None, None, None), (303, "é" * 5000, "c"), (302, "again", "b"), (304, "same", "a"), (304, "same", "a")]
    rows += [(400 + i, " ".join(f"w{i}x{j}" for j in range(120)) + ".", "d") for i in range(30)]
    return spark.createDataFrame(rows, SCHEMA)


def test_shards_are_even_and_gapless(spark, docs):
    out = sharding.shard_documents(docs, n_shards=5, n_slots=64).collect()
    assert len(out) == docs.count()
    places = {}
    for r in out:
        places.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in places.values()) and set(places) <= set(range(5))
    by_key = {(r.doc_id, r.text_crc32): r for r in out}
    for r in docs.collect():
        data = (r.text or "").encode()
        assert by_key[(r.doc_id, zlib.crc32(data))].size == len(data) + 8
    sizes = Counter()
    for r in out:
        sizes[r.shard] += r.size
    slots = Counter()
    for r in out:
        slots[r.virtual_slot] += r.size
    assert max(sizes.values()) - min(sizes.values()) <= max(slots.values())


def test_rebalancing_moves_little_and_only_to_where_there_is_room(spark, docs, tmp_path):
    rows = sharding.digests(docs, n_slots=64).cache()
    loads = sharding.slot_loads(rows)
    path = str(tmp_path / "map")
    sharding.store_map(sharding.initial_map(loads, 4), path)
    sharding.store_map(sharding.rebalanced_map(sharding.load_map(spark, path), loads, 5), path)
    one, two = ({r.vslot: r.shard for r in sharding.load_map(spark, path, v).collect()} for v in (1, 2))
    assert sharding.load_map(spark, path).first().version == 2 and one.keys() == two.keys()
    moved = [k for k in one if one[k] != two[k]]
    assert moved and {two[k] for k in moved} == {4}


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert sharding.shard_documents(empty).count() == 0
    assert quality.judged(quality.measures(empty)).count() == 0


def test_measures_match_plain_python(docs):
    got = {(r.doc_id, r.n_words, r.word_chars): r for r in quality.measures(docs).collect()}
    for r in docs.collect():
        w = words(r.text)
        windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        covered = {j for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
        lines = [x for x in (r.text or "").split("\n") if words(x)]
        m = got[(r.doc_id, len(w), sum(map(len, w)))]
        assert m.n_repeat_words == len(covered) and m.n_dup_lines == len(lines) - len(set(lines))
        assert m.n_symbols == sum(c in "#*$%&|<>" for c in r.text or "")
        assert m.base_failed == (len(w) < 50 or 100 * len(covered) > 50 * len(w))


def test_clear_documents_stay_and_junk_goes(spark):
    good = [(i, " ".join(f"plain{i}t{j}" for j in range(80)) + ".\n" + " ".join(f"more{i}t{j}" for j in range(40)) + ".", "a") for i in range(150)]
    junk = [(1000 + i, " ".join("BUYNOW" + chr(65 + i) + chr(65 + j % 26) * (1 + j // 26) + "!!" for j in range(90)), "a") for i in range(8)] + [(2000 + i, " ".join(f"cell{i}t{j} |" for j in range(90)), "a") for i in range(8)]
    out = {r.doc_id: r.kept for r in quality.judged(quality.measures(spark.createDataFrame(good + junk, SCHEMA))).collect()}
    assert all(out[i] for i, *_ in good) and not any(out[i] for i, *_ in junk)


def test_expectation_maximisation_matches_plain_python(spark):
    import math

    counts = [(0, 30), (8, 500), (4, 20), (6, 10), (2, 5)]
    got = {r.pattern: r.p_good for r in quality.posterior(spark.createDataFrame(counts, "pattern int, n long"), n_rules=2, rounds=7).collect()}
    total, pg, bad, good, weight = sum(n for _, n in counts), quality.PRIOR_GOOD_SHARE, quality.PRIOR_BAD, quality.PRIOR_GOOD, quality.PRIOR_WEIGHT
    odds, tables = math.log(pg / (1 - pg)), [[math.log(g / b) for g, b in zip(good, bad)]] * 2
    post = lambda p: 1 / (1 + math.exp(-(odds + tables[0][p // 3] + tables[1][p % 3])))
    for _ in range(7):
        w = [(p, n * post(p), n * (1 - post(p))) for p, n in counts]
        g, b, extra = sum(x[1] for x in w), sum(x[2] for x in w), total * weight
        new = math.log((g + extra * pg) / (b + extra * (1 - pg)))
        pick = lambda j, k, i: sum(x[i] for x in w if (x[0] // 3, x[0] % 3)[j] == k)
        tables = [[math.log(((pick(j, k, 1) + extra * good[k]) / (g + extra)) / ((pick(j, k, 2) + extra * bad[k]) / (b + extra))) for k in range(3)] for j in range(2)]
        odds = new
    assert all(abs(got[p] - post(p)) < 1e-9 for p, _ in counts)


def test_estimates_settle_and_come_from_the_votes(spark):
    """Of two kinds of junk, each seen by other rules, and good texts that one rule rejects at times."""
    keep, code = [1] * 8, lambda v: sum((x + 1) * 3 ** (7 - j) for j, x in enumerate(v))
    drop = lambda *at: [-1 if j in at else 1 for j in range(8)]
    counts = [(code(keep), 42000), (code(drop(0, 1)), 3100), (code(drop(2, 3, 5)), 1150), (code(drop(5, 7)), 990), (code(drop(5)), 630), (code(drop(4)), 60), (code([1, 1, 1, 1, 0, 1, 1, 1]), 1180)]
    frame = spark.createDataFrame(counts, "pattern int, n long")
    some, more = ({r.pattern: r.p_good for r in quality.posterior(frame, rounds=k).collect()} for k in (quality.ROUNDS, 3 * quality.ROUNDS))
    assert all(abs(some[p] - more[p]) < 1e-3 for p in some)
    assert some[code(keep)] > 0.99 and some[code(drop(0, 1))] < 0.01 and some[code(drop(2, 3, 5))] < 0.01 and some[code([1, 1, 1, 1, 0, 1, 1, 1])] > 0.9


def test_extra_columns_do_not_clash(docs):
    odd = docs.withColumn("slot", F.lit(1)).withColumn("size", F.lit("x")).withColumn("n_words", F.lit(0)).withColumn("pattern", F.lit(0))
    assert sharding.shard_documents(odd, n_shards=3).count() == docs.count()
    assert quality.judged(quality.measures(odd, keep=["n_words", "pattern"])).count() == docs.count()
