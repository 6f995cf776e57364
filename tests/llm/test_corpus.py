"""Joins, line runs, archives, mixtures, neighbours and the pipeline against brute force."""

import gzip
import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import ann, line_dedup, mixing, ngram_join, warc

SCHEMA = "doc_id long, text string"


def text_of(rng, n, names=400):
    return " ".join(f"w{rng.randrange(names)}" for _ in range(n))


def edited(rng, text, share):
    return " ".join(f"e{rng.randrange(10**6)}" if rng.random() < share else w for w in text.split(" "))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    rows, n = [], 0
    for _ in range(25):
        base = text_of(rng, rng.choice([3, 6, 9, 20, 40, 120, 300]), 10**6)
        for share in rng.sample([0, 0, 0.005, 0.01, 0.02, 0.03, 0.05, 0.1], 6):
            rows.append((n, edited(rng, base, share)))
            n += 1
    shared = text_of(rng, 40, 10**6)
    rows += [(500 + i, shared + " " + text_of(rng, 60, 10**6)) for i in range(30)]
    rows += [(900, None), (901, ""), (902, " \n"), (903, "One two"), (904, "one\ttwo"), (905, "one two three"), (None, "one two"), (906, "É x y z q"), (907, "é x y z q")]
    return rows + [rows[0], rows[0]]


def shingles(text):
    w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_near_duplicates_match_brute_force(spark, corpus, monkeypatch):
    sets = {i: shingles(t) for i, t in corpus if i is not None}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    docs = spark.createDataFrame(corpus, SCHEMA).withColumn("sig", F.lit("x")).withColumn("n", F.lit(2))
    # Small bounds send the same rows through the plans of hot signatures and large clusters.
    for block, large, hot, times in ((ngram_join.BLOCK, ngram_join.LARGE, ngram_join.HOT, 8), (40, 100, 3, 0)):
        monkeypatch.setattr(ngram_join, "BLOCK", block)
        monkeypatch.setattr(ngram_join, "LARGE", large)
        monkeypatch.setattr(ngram_join, "HOT", hot)
        monkeypatch.setattr(ngram_join, "HOT_TIMES", times)
        out = ngram_join.similar_documents(docs).collect()
        assert len(out) == len(corpus)
        for r in out:
            assert (r.n_shingles, r.component_id) == ((len(sets[r.doc_id]), find(r.doc_id)) if r.doc_id is not None else (1, None))


def test_near_copies_of_repeated_rows_keep_their_links(spark):
    rng = random.Random(21)
    rows, sets = [], {}
    for base in range(0, 400, 10):
        words = text_of(rng, 200, 10**6).split(" ")
        near = []
        for k in range(2):
            other = list(words)
            for at in (20, 60, 120) if k else (40, 90, 160):
                other[at] = f"z{base}x{k}x{at}"
            near.append(" ".join(other))
        rows += [(base + 1, " ".join(words)), *[(base + 7, near[0])] * 2, *[(base + 9, near[1])] * 2]
    sets = {i: shingles(t) for i, t in rows}
    assert all(100 * len(sets[b + 1] & sets[b + k]) >= 80 * len(sets[b + 1] | sets[b + k]) for b in range(0, 400, 10) for k in (7, 9))
    out = ngram_join.similar_documents(spark.createDataFrame(rows, SCHEMA)).collect()
    assert Counter((r.doc_id, r.component_id) for r in out) == Counter((i, i // 10 * 10 + 1) for i, _ in rows)


def test_linked_sets_always_share_a_signature():
    rng = np.random.RandomState(5)
    for _ in range(3000):
        n = int(rng.choice([1, 2, 3, 4, 5, 6, 8, 10, 15, 20, 31, 32, 40, 63, 64, 100, 127, 128, 200]))
        a = np.unique(rng.randint(0, 2**62, n).astype(np.uint64))
        size = rng.randint(max(1, int(np.ceil(0.8 * n))), int(n / 0.8) + 1)
        common = int(np.ceil((n + size) * 0.8 / 1.8))
        if common > min(n, size):
            continue
        b = np.unique(np.concatenate([rng.choice(a, common, replace=False), rng.randint(0, 2**62, size - common).astype(np.uint64)]))
        if ngram_join.jaccard_links(a, b):
            for family in (0, 1):
                assert len(np.intersect1d(ngram_join.signatures(a, family), ngram_join.signatures(b, family)))


def lines_left(rows, least):
    """The definition: a line goes if it lies in a run that starts earlier too and has least words or more."""
    seen, out = {}, {}
    order = sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0))
    texts = {r: (r[1] or "").split("\n") for r in order}
    for r in order:
        mine, gone = texts[r], set()
        for i in range(len(mine)):
            best = 0
            for other, k in seen.get(mine[i], []):
                n = 0
                while i + n < len(mine) and k + n < len(texts[other]) and mine[i + n] == texts[other][k + n]:
                    n += 1
                best = max(best, n)
            if best and sum(len(x.encode().split()) for x in mine[i : i + best]) >= least:
                gone |= set(range(i, i + best))
            seen.setdefault(mine[i], []).append((r, i))
        out[r] = "\n".join(x for i, x in enumerate(mine) if i not in gone)
    return out


@pytest.mark.parametrize("least", [1, 4, 9])
def test_line_runs_match_the_definition(spark, least):
    rng = random.Random(least)
    rows = [(i, "\n".join(rng.choice("abcdef") + " x" * rng.randrange(3) for _ in range(rng.randrange(9)))) for i in range(60)]
    rows += [(70, "\n".join(["r s"] * 9)), (71, None), (72, ""), (73, "\n\n"), (74, "q"), (None, "a x\nb")]
    rows += [rows[5]]
    got = line_dedup.delete_repeats(spark.createDataFrame(rows, SCHEMA).withColumn("rank", F.lit(1)), least)
    assert {"doc_id", "text", "rank", "_n_lines", "_n_deleted"} == set(got.columns)
    expected = lines_left(rows, least)
    assert Counter((r.doc_id, r.text) for r in got.collect()) == Counter((r[0], expected[r]) for r in rows)


def test_a_long_row_repeated_is_one_document(spark):
    lines = [f"l{k} x y" for k in range(64)]
    rows = [(1, "\n".join(lines))] * 3 + [(None, "\n".join(lines[:40]))] * 3 + [(2, "\n".join(["q"] + lines[20:] + ["r"]))]
    docs = spark.createDataFrame(rows, SCHEMA)
    assert line_dedup.line_table(docs).count() == 64 + 40 + 46
    assert len(line_dedup.suffix_ranks(line_dedup.line_table(docs))) <= 7
    expected = lines_left(rows, 9)
    got = line_dedup.delete_repeats(docs, 9)
    assert Counter((r.doc_id, r.text) for r in got.collect()) == Counter((r[0], expected[r]) for r in rows)


def test_line_dedup_of_nothing(spark):
    assert line_dedup.delete_repeats(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.fixture(scope="module")
def pages(spark):
    big = "<p>" + "x" * 1200 + "</p>"
    rows = [(i, f"http://a/{i}", big) for i in range(40)] + [(100, "http://b/\n", "é" * 600), (101, None, "é" * 600), (102, "u", "short"), (103, "u", "short"), (104, "u", None), (105, "u", ""), (None, "n", big), (106, "u", "a\r\n\r\nb" * 300)]
    rows += [(200 + i, "v", "".join(random.Random(i).choice("abcdef ") for _ in range(20000))) for i in range(20)]
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_archives_give_back_every_record(spark, pages, tmp_path):
    index = warc.archive_pages(pages, f"file://{tmp_path}/w").cache()
    want = {r.page_id: (r.html or "").encode() for r in pages.collect()}
    groups = {}
    for i, data in want.items():
        groups.setdefault(data, []).append(i)
    got = warc.read_records(index).collect()
    assert Counter(r.page_id for r in got) == Counter(want.keys())
    for r in got:
        data = want[r.page_id]
        keep = max((i for i in groups[data] if i is not None), default=None) if len(data) >= 1000 else r.page_id
        kind = "response" if r.page_id == keep else "revisit"
        assert (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) == (len(data), hashlib.sha1(data).hexdigest(), kind, None if kind == "response" else keep)
        assert r.payload == (data if kind == "response" else b"")
    some = warc.read_records(index.where("page_id % 3 = 1")).collect()
    assert {r.page_id for r in some} == {i for i in want if i is not None and i % 3 == 1}
    one = index.where("page_id = 102").first()
    with open(one.file.removeprefix("file://"), "rb") as f:
        whole = gzip.decompress(f.read())
    assert whole.startswith(b"WARC/1.1\r\n") and whole.count(b"WARC-Record-ID") <= len(want)
    assert warc.read_records(warc.archive_pages(pages.limit(0), f"file://{tmp_path}/e")).count() == 0


def test_damage_is_noticed():
    member = warc.record(1, "u", b"hello", hashlib.sha1(b"other").hexdigest(), None)
    with pytest.raises(ValueError):
        warc.parse(member)


def filled(budget, children):
    """Water filling in whole numbers: children (name, capacity, weight)."""
    out, left = {}, budget
    order = sorted(children, key=lambda c: (c[1] / c[2], c[0]))
    weight = sum(c[2] for c in order)
    for k, (name, cap, w) in enumerate(order):
        if cap * weight <= left * w:
            out[name], left, weight = cap, left - cap, weight - w
        else:
            return out | {n: left * x // weight for n, _, x in order[k:]}
    return out


def test_budgets_fill_siblings_before_ancestors(spark):
    rng = random.Random(8)
    rows = [(d, a, f"s{k}", rng.choice([5, 50, 900, 4000])) for d in ("web", "books", "?") for a in ("en", "de", "xx") for k in range(rng.randint(1, 4))]
    supply = spark.createDataFrame(rows, "domain string, lang string, source string, supply long")
    got = {(r.domain, r.lang, r.source): r.tokens for r in mixing.budgets(supply, F.lit(9000), max_epochs=2).collect()}
    weight = lambda level, name: mixing.WEIGHTS[level].get(name, 1)
    cap = lambda d, a=None: sum(2 * r[3] for r in rows if r[0] == d and a in (None, r[1]))
    expected = {}
    for d, x in filled(min(9000, sum(cap(d) for d in ("web", "books", "?"))), [(d, cap(d), weight("domain", d)) for d in ("web", "books", "?")]).items():
        for a, y in filled(x, [(a, cap(d, a), weight("lang", a)) for a in ("en", "de", "xx")]).items():
            for s, z in filled(y, [(r[2], 2 * r[3], 1) for r in rows if r[:2] == (d, a)]).items():
                expected[(d, a, s)] = z
    assert got == expected


def test_prefixes_are_contiguous_and_spend_the_budget(spark):
    docs = spark.createDataFrame([(i, "w " * (i % 17), None if i % 13 == 0 else "en", f"src{i % 4}") for i in range(400)] + [(None, "a b", "en", None), (401, None, "en", "src1")], "doc_id long, text string, lang string, source string")
    counts = mixing.token_counts(docs).cache()
    leaves = mixing.budgets(counts.groupBy(*mixing.LEVELS).agg(F.sum("n_tokens").alias("supply")).where("supply > 0"), F.lit(3000), max_epochs=3).cache()
    rows = mixing.select_prefix(counts, leaves).collect()
    for leaf in leaves.collect():
        mine = [r for r in rows if (r.domain, r.lang, r.source) == (leaf.domain, leaf.lang, leaf.source)]
        assert sum(r.take for r in mine) == leaf.tokens
        for e in {r.epoch for r in mine}:
            at = 0
            for r in sorted((r for r in mine if r.epoch == e), key=lambda r: r.start):
                assert r.start == at and (r.take == r.n_tokens or at + r.take + e * leaf.supply == leaf.tokens)
                at += r.n_tokens
    assert mixing.mix(counts.limit(0)).count() == 0


def test_first_words(spark):
    row = spark.createDataFrame([(" a  b\nc d ", 3), ("x", 1), ("", 2)], "t string, n long").select(mixing.first_words(F.col("t"), F.col("n")).alias("t")).collect()
    assert [r.t for r in row] == [" a  b\nc", "x", ""]


VECTORS = "vec_id long, embedding array<float>"


def test_small_tables_are_searched_whole_with_ties_and_odd_rows(spark):
    rows = [(i, [float(i % 5), 1.0]) for i in range(40)] + [(50, None), (51, [0.0, 0.0]), (52, [None, 1.0]), (53, [float("nan"), 1.0]), (54, [float("inf"), 1.0]), (55, [1.0]), (None, [1.0, 1.0]), (60, [2.0, 1.0])]
    frame = spark.createDataFrame(rows, VECTORS).withColumns({c: F.lit(1) for c in ("v", "leaf", "bin", "q", "ids", "at")})
    usable = ann.usable(frame)
    got = ann.search(ann.build(usable, 6), usable.where("vec_id % 20 = 0"), 6).collect()
    good = {i: v for i, v in rows[:40] + rows[-1:]}
    for q in (0, 20, 60):
        expected = sorted(((-sum(a * b for a, b in zip(good[q], v)), i) for i, v in good.items() if i != q))[:6]
        assert [(-r.score, r.vec_id) for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)] == expected
    assert {r.query_id for r in got} == {0, 20, 60}
    empty = ann.usable(spark.createDataFrame([], VECTORS))
    assert ann.search(ann.build(empty, 6), empty, 6).count() == 0


def test_of_several_vectors_of_one_query_id_the_smallest_is_asked(spark):
    rows = [(20, [3.0, 0.0]), (20, [0.0, 3.0]), (20, [0.0, 3.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0])]
    for parts in (1, 3):
        usable = ann.usable(spark.createDataFrame(rows, VECTORS).repartition(parts))
        got = ann.search(ann.build(usable, 5), usable.where("vec_id % 20 = 0"), 5).orderBy("rank").collect()
        assert [(r.query_id, r.vec_id, r.score) for r in got] == [(20, 2, 3.0), (20, 1, 0.0)]


@pytest.mark.parametrize("cut_again", [False, True])
def test_recall_against_brute_force(spark, monkeypatch, cut_again):
    if cut_again:
        monkeypatch.setattr(ann, "PARTS", 4)
        monkeypatch.setattr(ann, "CUT_AGAIN", 128)
        monkeypatch.setattr(ann, "CANDIDATE_BLOCK", 60)
        monkeypatch.setattr(ann, "QUERY_BLOCK", 30)
    rng = np.random.RandomState(1)
    x = (rng.randn(40, 24)[rng.randint(0, 40, 3000)] + 0.7 * rng.randn(3000, 24)).astype(np.float32)
    x[1000:1900] = x[7]
    rows = ann.usable(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], VECTORS))
    index = ann.build(rows, 20)
    got = ann.search(index, rows.where("vec_id % 20 = 0"), 20).collect()
    found = {}
    for r in got:
        found.setdefault(r.query_id, {})[r.vec_id] = r.score
    hits = total = 0
    d = x.astype(float)
    for q in range(0, 3000, 20):
        score = (d * d[q]).sum(axis=1)
        score[q] = -np.inf
        near = sorted(range(3000), key=lambda i: (-score[i], i))[:20]
        total += 20
        hits += len(set(near) & set(found[q]))
        assert len(found[q]) == 20 and all(abs(s - score[i]) < 1e-9 for i, s in found[q].items())
    assert index.tree.leaves > 8 and (index.tree.sub > 1) == cut_again and index.share < 0.5 and hits >= 0.9 * total


def test_balanced_parts_are_balanced_and_follow_the_graph():
    rng = np.random.RandomState(2)
    x = rng.randn(8, 10)[np.repeat(np.arange(8), 100)] * 3 + 0.3 * rng.randn(800, 10)
    graph = ann.neighbour_graph(x, 8)
    part = ann.balanced_parts(graph, 8)
    assert np.bincount(part, minlength=8).max() <= 110
    assert (part[graph] == part[:, None]).mean() > 0.8


def test_pipeline_matches_a_plain_version(spark, tmp_path):
    import corpus_pipeline
    from quillon.llm import pieces, quality

    rng = random.Random(9)
    long_line = " ".join(f"p{i}" for i in range(60)) + "."
    rows = []
    for i in range(80):
        body = "\n".join(text_of(rng, 40, 10**6) + "." for _ in range(3))
        rows.append((i, body + ("\n" + long_line if i % 9 == 0 else ""), ("en", "de", None)[i % 3], f"src{i % 5}"))
    rows += [(200, rows[3][1], "en", "src1"), (201, edited(rng, rows[4][1].replace("\n", " "), 0.001), "en", "src1"), (202, None, "en", "src1"), (203, "", "de", "src2"), (204, " ".join("BUY NOW!!" for _ in range(60)), "en", "src0")]
    docs = [(i, t, a, s, len(t or "")) for i, t, a, s in rows]
    folder = str(tmp_path)
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, folder).collect()}
    measured = quality.judged(quality.measures(spark.read.parquet(f"{folder}/documents.parquet"))).where("kept")
    good = {r.doc_id for r in measured.collect()}
    assert good == set(range(80)) | {200, 201}
    kept = [(i, t) for i, t, *_ in docs if i in good]
    left = {r[0]: t for r, t in lines_left(kept, 50).items()}
    left = {i: t for i, t in left.items() if t}
    assert 200 not in left and long_line in left[0] and all(long_line not in left[i] for i in left if i)
    sets = {i: shingles(t) for i, t in left.items()}
    near = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    assert (4, 201) in near
    left = {i: t for i, t in left.items() if i not in {b for _, b in near}}
    assert set(got) <= set(left)
    spent = sum(len(t.split()) for i, t in left.items() if i in got)
    total = sum(len(t.split()) for t in left.values())
    assert 0.7 * total <= spent <= 0.95 * total
    codec = pieces.Codec(pieces.PieceModel.read(pieces.MODEL))
    for i, r in got.items():
        text = codec.decode(r.ids)
        assert left[i].startswith(text) and text
    assert sum(codec.decode(r.ids) == left[i] for i, r in got.items()) >= len(got) - 15
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder).columns == corpus_pipeline.COLUMNS


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_one_of_equal_rows_and_rows_without_id_stays(spark):
    import corpus_pipeline

    rng = random.Random(31)
    a, b, c, d = (text_of(rng, 60, 10**6) for _ in range(4))
    rows = [(5, a), (5, a), (5, a), (None, b), (None, b), (7, b), (None, c), (None, d), (8, d), (9, d + " more"), (3, None), (3, "")]
    docs = spark.createDataFrame([(i, t, "en", "src1", len(t or "")) for i, t in rows], DOCS)
    got = corpus_pipeline.near_duplicate_stage(spark, docs, "").collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter([(5, a), (None, b), (None, c), (None, d), (3, None), (3, "")])


def test_mixing_takes_and_cuts_row_by_row(spark):
    import corpus_pipeline

    rng = random.Random(32)
    rows = [(None if i % 2 else i % 10, text_of(rng, rng.randrange(20, 60), 10**6), ("en", "de")[i % 3 == 0], f"src{i % 7}") for i in range(200)]
    rows += [(None, None, "en", "src1"), (3, "", "de", "src1")]
    docs = spark.createDataFrame([(i, t, a, s, len(t or "")) for i, t, a, s in rows], DOCS)
    counts = mixing.token_counts(docs)
    supply = counts.groupBy(*mixing.LEVELS).agg(F.sum("n_tokens").alias("supply"))
    budget = {(r.lang, r.source): r.tokens for r in mixing.budgets(supply, F.expr(f"(all_tokens * {corpus_pipeline.BUDGET_PERCENT}) div 100"), max_epochs=1).collect()}
    spent, cuts, whole = Counter(), Counter(), Counter((i, t, a, s) for i, t, a, s in rows)
    for r in corpus_pipeline.mixing_stage(spark, docs, "").collect():
        spent[r.lang, r.source] += len(r.text.split())
        whole[r.doc_id, r.text, r.lang, r.source] -= 1
        cuts[r.lang, r.source] += whole[r.doc_id, r.text, r.lang, r.source] < 0
    assert spent == Counter(budget) and max(cuts.values()) == 1
