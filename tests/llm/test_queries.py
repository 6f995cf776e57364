"""The registered queries on small tables with odd rows, against plain versions of what they promise."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.llm import common, pieces, secret_crf, toxicity, warc
from quillon.llm.queries import queries

BIG = 1 << 62
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use inside, as extra columns of the tables.
CLASHES = ("_id", "_th", "_row", "id", "key", "sig", "n", "h", "k", "salt", "rank", "text_crc32", "size", "score", "spans", "digest", "keep", "refers_to", "range", "wide", "base", "epoch", "tokens", "supply", "pattern", "carried", "bucket", "_bucket")


def write(spark, folder, name, rows, schema, clashes=()):
    frame = spark.createDataFrame(rows, schema)
    frame.withColumns({c: F.lit("x") for c in clashes if c not in frame.columns}).write.parquet(f"{folder}/{name}.parquet")


def documents(spark, folder, rows, **more):
    write(spark, folder, "documents", [(i, t, "en", f"src{k % 4}", len(t or "")) for k, (i, t) in enumerate(rows)], DOCS, **more)


@pytest.fixture(scope="module")
def secrets():
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8)))
    hexes = lambda n: "".join(rng.choice("0123456789abcdef") for _ in range(n))
    parts = [word, word, word, lambda: f'PassWd="{hexes(8)}"', lambda: f"api_key: {hexes(5)}", lambda: f"token = {hexes(30)}", lambda: "AKIA" + "".join(rng.choice("ABCXYZ0189") for _ in range(rng.choice([15, 16, 22]))), lambda: hexes(rng.choice([23, 24, 40])), lambda: "secret secret=aaaaaa", lambda: "é\U0001f642", lambda: "\n"]
    rows = [(BIG + 2 * k + 1, " ".join(rng.choice(parts)() for _ in range(rng.randint(0, 60)))) for k in range(150)]
    return rows + [(None, None), (None, "token=abcdef12"), (BIG + 1, "again secret: xyzxyz"), (7, ""), rows[0], (8, "password=" + "a1" * 30000 + " x" * 30000)]


def plain_spans(text):
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    out = [("assign", *m.span()) for m in assign.finditer(text) if len(m[2]) >= 6]
    out += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out, key=lambda x: (x[1], ("assign", "access", "hex").index(x[0])))


def test_secret_query_equals_a_plain_scan(spark, secrets, tmp_path):
    documents(spark, str(tmp_path), secrets, clashes=CLASHES)
    got = queries()["op1_secret_scan"](spark, str(tmp_path)).collect()
    want = Counter()
    for i, t in secrets:
        base = plain_spans(t or "")
        written = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        want[(i, *(sum(x[0] == k for x in base) for k in ("assign", "access", "hex")), hashlib.sha256(written.encode()).hexdigest())] += 1
    assert Counter((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in got) == want
    for r in got:
        kinds = [x.split(":") for x in r.spans.split(",") if x]
        assert sum(k != "crf" for k, *_ in kinds) == r.n_assign + r.n_access + r.n_hex
        assert [int(a) for _, a, _ in kinds] == sorted(int(a) for _, a, _ in kinds)


def test_windows_find_what_one_chain_over_all_tokens_finds(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    field = secret_crf.train(docs)
    texts = [r.text or "" for r in docs.select("text").collect()]
    rng = random.Random(99)
    lines = ["auth: lower letters", "pass: swordfish then more", "key = abcdefgh", "the signature of access", "client_secret_key: Zx81kkQ9", "a: b c: d"]
    texts += [" ".join(rng.choice(t.split() or ["x"]) for t in texts[:60]) + " " + x for x in lines]
    assert all(field.spans(t) == field.spans(t, wide=True) for t in texts)


def held_out_lines(n=400):
    """Lines in wordings that training has not seen: other leads, other values, other neighbours."""
    rng = random.Random(2024)
    alnum = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    pick = lambda chars, a, b: "".join(rng.choice(chars) for _ in range(rng.randint(a, b)))
    leads = ["private key: ", "access token -> ", "bearer ", "client secret = ", "auth_key=", "credentials: '", "signature: "]
    plain = [lambda: f"release {rng.randint(1, 9)}.{rng.randint(1, 9)}", lambda: f"order no {rng.randint(10**5, 10**9)}", lambda: f"see {pick('abcdef', 4, 8)}.example/{pick('abcdef', 3, 9)}", lambda: f"{pick('abcdefgh', 3, 9)} = {pick('abcdefgh', 3, 9)}", lambda: "the auth service keeps a key of each client", lambda: f"room {rng.randint(1, 400)}b"]
    out = []
    for k in range(n):
        before = " ".join(pick("nopqrstuvwxyz", 3, 9) for _ in range(6)) + " "
        if k % 2:
            lead, value = rng.choice(leads), pick(alnum, 18, 36)
            out.append((before + lead + value + " and so on", (len(before + lead), len(before + lead) + len(value))))
        else:
            out.append((before + rng.choice(plain)() + " and so on", None))
    return out


def test_the_field_finds_secrets_in_wordings_it_has_not_seen(spark):
    field = secret_crf.train(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))
    hit = wrong = total = 0
    for text, secret in held_out_lines():
        found = field.spans(text)
        total += secret is not None
        hit += secret in found
        wrong += any(secret is None or x[1] <= secret[0] or secret[1] <= x[0] for x in found)
    print(f"held-out lines: recall {hit / total:.3f}, lines with a wrong span {wrong / 400:.3f}")
    assert hit >= 0.8 * total and wrong <= 0.05 * 400


def test_long_training_windows_are_cut_into_whole_sequences():
    tags = ([0] * 30 + [1] + [2] * 40) * 3 + [0] * 100
    cut = list(secret_crf.cut_sequence(list(range(len(tags))), tags))
    assert [x for rows, _ in cut for x in rows] == list(range(len(tags))) and all(len(t) >= secret_crf.SEQUENCE for _, t in cut[:-1])
    assert all(t[0] != 2 for _, t in cut)


def test_tokens_keep_marks_on_their_letters():
    assert toxicity.tokens_of("नमस्ते Café ÉTÉ it's 9x_y") == ["नमस्ते", "café", "été", "it", "s", "x", "y"]
    assert toxicity.tokens_of("Ab cd-EF 1") == ["ab", "cd", "ef"]


@pytest.fixture(scope="module")
def toxic(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("toxic"))
    rng = random.Random(13)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7)))
    bad = ["vilewort", "grimfoul", "rotmouth", "बुराशब्द"]
    docs, labels = [], []
    for k in range(400):
        text = [word() for _ in range(60)]
        if k % 4 == 0:
            at = rng.randint(0, 50)
            text[at : at + 4] = rng.choices(bad, k=4)
        docs.append((BIG + 2 * k + 1, " ".join(text)))
        labels.append((BIG + 2 * k + 1, 1, int(k % 4 == 0)))
    docs += [(None, None), (None, "vilewort vilewort vilewort"), (5, ""), (6, "word " * 50000 + "vilewort grimfoul rotmouth"), docs[0]]
    documents(spark, folder, docs, clashes=CLASHES)
    write(spark, folder, "labels", labels, "doc_id long, quality int, toxic int")
    return folder, docs, labels


def test_toxicity_query_keeps_ids_and_its_contract(spark, toxic):
    folder, docs, labels = toxic
    got = queries()["op5_toxicity"](spark, folder).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in docs)
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 3 == 1
    assert all(r.held_out == held(r.doc_id) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    score = {r.doc_id: r.score for r in got}
    unseen = [(i, t) for i, _, t in labels if held(i)]
    assert sum((score[i] >= 0.7) == bool(t) for i, t in unseen) >= 0.97 * len(unseen) and score[6] >= 0.7 > score[5]


def test_log_odds_calibration_and_scores_match_plain_formulas(spark, toxic):
    folder, docs, labels = toxic
    model = toxicity.train(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet"))
    label = {i: t for i, _, t in labels if zlib.crc32(str(i).encode()) % 3 != 1}
    seen = [(t, label[i]) for i, t in docs if i in label]
    counts = Counter((w, y) for t, y in set(seen) for w in set(toxicity.tokens_of(t)))
    total = [sum(n for (_, y), n in counts.items() if y == k) for k in (0, 1)]
    want = {}
    for w in {w for w, _ in counts}:
        good, bad = counts[w, 0], counts[w, 1]
        prior, mass = toxicity.PRIOR_SHARE * (good + bad), toxicity.PRIOR_SHARE * sum(total)
        odds = math.log((bad + prior) / (total[1] + mass)) - math.log((good + prior) / (total[0] + mass))
        if abs(odds / math.sqrt(1 / (bad + prior) + 1 / (good + prior))) >= toxicity.Z_LEAST and good + bad >= 3:
            want[w] = odds
    assert model.words.keys() == want.keys() and all(abs(model.words[w] - x) < 1e-9 for w, x in want.items())
    clean = Counter(round(s, 2) for t, y in seen if not y for s in model.scan(t)[2])
    assert abs(sum(n * math.exp(model.rate * s) for s, n in clean.items()) / sum(clean.values()) - 1) < 1e-6
    maxima = [(len(words), max(s for *_, s in found)) for found, words, _ in (model.scan(t) for t, y in seen if not y) if found]
    assert abs(model.scale - max(1e-6, len(maxima) / sum(n * math.exp(-model.rate * m) for n, m in maxima))) < 1e-9 * model.scale or not maxima
    for i, text in docs[:40] + docs[-4:]:
        words = toxicity.tokens_of(text or "")
        evidence = 0.0
        for a, b, s in model.scan(text or "")[0]:
            assert abs(sum(model.token(w) for w in words[a:b]) - s) < 1e-9
            p = -math.expm1(-model.scale * len(words) * math.exp(-model.rate * s))
            evidence += -math.log(max(p, 1e-300)) if p < toxicity.SIGNIFICANT else 0
        z = model.weight * math.log1p(min(evidence, 1000)) + model.offset
        assert abs(model.probability(model.evidence(model.scan(text or "")[0], len(words))[0]) - 1 / (1 + math.exp(-max(-50, min(50, z))))) < 1e-6


def test_warc_query_keeps_large_ids_and_reads_in_proportion_to_bytes(spark, tmp_path, monkeypatch):
    rng = random.Random(4)
    big = "<p>" + "x" * 1500 + "</p>"
    rows = [(BIG + 2 * k + 1, f"http://a/{k}", big) for k in range(30)] + [(None, None, big), (3, "u", None), (4, "u", ""), (BIG + 1, "again", big)]
    rows += [(1000 + k, "v", "".join(rng.choice("abcdefgh \n") for _ in range(9000))) for k in range(120)] + [(2000, "long", "é" * 400000)]
    write(spark, str(tmp_path), "pages", rows, "page_id long, url string, html string", clashes=CLASHES)
    monkeypatch.setattr(warc, "READ_BYTES", 50_000)
    out = queries()["op6_warc"](spark, str(tmp_path))
    parts = out.rdd.getNumPartitions()
    got = out.collect()
    keep = max(i for i, _, h in rows if i is not None and h == big)
    want = Counter()
    for i, _, h in rows:
        data = (h or "").encode()
        copy = h == big and i != keep
        want[(i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if copy else "response", keep if copy else None)] += 1
    assert Counter(map(tuple, got)) == want and parts >= 8


def test_queries_of_empty_tables(spark, tmp_path):
    documents(spark, str(tmp_path), [])
    write(spark, str(tmp_path), "labels", [], "doc_id long, quality int, toxic int")
    write(spark, str(tmp_path), "pages", [], "page_id long, url string, html string")
    write(spark, str(tmp_path), "embeddings", [], "vec_id long, embedding array<float>, label int")
    write(spark, str(tmp_path), "benchmark", [], "item_id long, text string")
    for name, query in queries().items():
        assert query(spark, str(tmp_path)).count() == 0, name


LONG = [(1, None), (2, ""), (None, "alpha beta " * 30), (None, "alpha beta " * 30), (3, " ".join(f"w{k}" for k in range(60000))), (4, " ".join(f"w{k}" for k in range(60000)) + " end"), (5, "z" * 300000), (6, "\n" * 20000), (7, "a b\n" * 9000), (7, "a b\n" * 9000), (BIG + 1, "same text here for ever and ever"), (BIG + 3, "Same text here for ever and ever")]


def test_queries_of_long_odd_and_repeated_documents_with_clashing_columns(spark, tmp_path):
    rows = LONG + [(100 + k, " ".join(f"d{k}x{j}" for j in range(70)) + ".") for k in range(30)]
    documents(spark, str(tmp_path), rows, clashes=CLASHES)
    ids = Counter(i for i, _ in rows)
    known = queries()
    got = {name: known[name](spark, str(tmp_path)).collect() for name in ("op3_quality_rules", "op4_ngram_join", "op7_mixing", "op8_line_dedup", "op9_sharding", "op10_sentencepiece")}
    for name in ("op3_quality_rules", "op4_ngram_join", "op8_line_dedup", "op9_sharding", "op10_sentencepiece"):
        assert Counter(r.doc_id for r in got[name]) == ids, name
    assert {r.doc_id: r.n_words for r in got["op3_quality_rules"]}[3] == 60000
    component = {r.doc_id: r.component_id for r in got["op4_ngram_join"]}
    assert component[4] == 3 and component[BIG + 3] == BIG + 1 and component[None] is None and component[5] == 5
    assert {r.doc_id: r.n_tokens > 0 and r.round_trip for r in got["op10_sentencepiece"]}[5]
    assert {r.doc_id: r.size for r in got["op9_sharding"]}[5] == 300008
    left = {r.doc_id: r.text for r in got["op8_line_dedup"]}
    assert left[3] == LONG[4][1] and left[7].count("\n") < 30
    # Shares are rounded down, at most by a word for each child of a node.
    budget = sum(len((t or "").split()) for _, t in rows) * 60 // 100
    assert budget - 8 <= sum(r["take"] for r in got["op7_mixing"]) <= budget


def test_pipeline_of_odd_and_of_no_documents(spark, tmp_path):
    import corpus_pipeline

    rows = LONG + [(100 + k, " ".join(f"d{k}x{j}" for j in range(70)) + ".") for k in range(30)] + [(None, " ".join(f"n{k}x{j}" for j in range(70)) + ".") for k in range(5)]
    documents(spark, str(tmp_path / "a"), rows, clashes=CLASHES)
    got = corpus_pipeline.run(spark, str(tmp_path / "a")).collect()
    whole = {i for i, t in rows if t and len(t.split()) >= 50}
    assert {r.doc_id for r in got} <= whole and 4 not in {r.doc_id for r in got} and len(got) >= 25
    documents(spark, str(tmp_path / "b"), [])
    assert corpus_pipeline.run(spark, str(tmp_path / "b")).count() == 0


def test_a_cluster_without_a_shared_folder_is_refused():
    class Session:
        class conf:
            get = staticmethod(lambda name, default: default)

        class sparkContext:
            master, applicationId = "spark://host:7077", "app"

    with pytest.raises(ValueError):
        common.shared_root(Session)


def test_models_that_change_the_text_are_refused(tmp_path):
    with open(pieces.MODEL, "rb") as f:
        data = f.read()
    pieces.PieceModel.read(pieces.MODEL)
    pb = pytest.importorskip("sentencepiece.sentencepiece_model_pb2")
    for change in (lambda m: setattr(m.normalizer_spec, "remove_extra_whitespaces", True), lambda m: setattr(m.normalizer_spec, "precompiled_charsmap", b"x"), lambda m: setattr(m.trainer_spec, "treat_whitespace_as_suffix", True), lambda m: setattr(m.pieces[500], "type", 4)):
        proto = pb.ModelProto()
        proto.ParseFromString(data)
        change(proto)
        (tmp_path / "m").write_bytes(proto.SerializeToString())
        with pytest.raises(ValueError):
            pieces.PieceModel.read(str(tmp_path / "m"))


def test_a_worker_keeps_its_trie(spark):
    model = pieces.PieceModel.read(pieces.MODEL)
    assert model.codec() is model.codec()
    import pickle

    assert not hasattr(pickle.loads(pickle.dumps(model)), "_codec")
    codec = model.codec()
    texts = [f"word{k} again" for k in range(50)]
    first = [codec.encode(t).tolist() for t in texts]
    old = pieces.REMEMBERED
    try:
        pieces.REMEMBERED = 8
        assert [codec.encode(t).tolist() for t in texts] == first and np.all([codec.decode(x) == t for x, t in zip(first, texts)])
    finally:
        pieces.REMEMBERED = old
