"""Secrets in texts: fixed patterns, and a linear-chain conditional random field decoded by Viterbi.

The field tags tokens (runs of letters and digits, single other marks) as secret begin, inside or outside from their
shape, the shapes and key words around them, and features of the whole text. It is trained here, on at most
MAX_SEQUENCES sequences of at most LONGEST_SEQUENCE tokens, labelled by the fixed patterns, and on made-up lines of kinds
that the patterns do not know. The sequences are those of smallest hash among all windows of SAMPLE_DOCS documents; they
are cut and picked by tasks, so what comes to the driver has a fixed size whatever the texts. The field adds spans; those
of the patterns stay.

Most tokens need no tagging: a plain word among plain words scores so much higher for "outside" than for other tags that
no best path stays away from it, so the chain falls apart into windows around unusual tokens and key words. How much
higher follows from the fitted weights (plain_margin): it says how many words a secret can reach into plain text, which
the windows then hold, and where it is not positive whole texts are tagged. Tests compare the windows' spans with
those of one chain over all tokens, over all texts of a table.

Defined results: a null text is empty, an empty text has no spans; offsets are code points, the end not included.
"""

from __future__ import annotations

import hashlib
import heapq
import random
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import cache
from itertools import accumulate, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import SPACES, stash, text_or_empty

SAMPLE_DOCS = 2000
#: Longer training windows become several sequences, cut where a token outside precedes.
SEQUENCE = 60
#: Sequences that training takes at most; longer ones than LONGEST_SEQUENCE are left out of training (not of the scan).
MAX_SEQUENCES, LONGEST_SEQUENCE, PIECE = 1500, 240, 2000
SEED, STEPS, L2 = 7, 100, 0.003
KINDS = ("assign", "access", "hex", "crf")
SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
#: The patterns that results must hold.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
MARKS = ("password", "passwd", "secret", "token", "api")
#: Words that often stand before a secret.
KEYS = frozenset("password passwd passphrase pwd pass secret secrets token tokens apikey api key keys credential credentials auth authorization bearer private access client cred sk pk ghp akia signature".split())

TOKEN = re.compile(r"[^\W_]+|_|[^\w\s]")
#: Where a token may be other than plain: by a mark, digit or odd capital, or by a word that hints at a secret.
UNUSUAL = re.compile(r"[0-9=_A-Z](?:(?<=[0-9=_])|(?<=[a-z][A-Z])|(?<=[A-Z])[A-Z]{15})", re.ASCII)
HINTED = re.compile(rf"(?<![^\W_])(?:{'|'.join(sorted(KEYS))})(?![^\W_])", re.IGNORECASE)
REACH = 4


def base_spans(text: str) -> list[tuple[str, int, int, int]]:
    """(kind, start, end, start of the value) of the fixed patterns, by start, then kind."""
    out = []
    low = text.lower()
    if any(m in low for m in MARKS):
        out += [("assign", *m.span(), m.start(2)) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [("access", *m.span(), m.start()) for m in ACCESS.finditer(text)]
    out += [("hex", *m.span(), m.start()) for m in HEX.finditer(text)]
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0])))


@cache
def _length(n: int) -> int:
    return next((i for i, m in enumerate((2, 4, 8, 12, 16, 24)) if n < m), 6)


#: Marks that stand for one another before a value.
_ALIKE = {":": "=", ">": "=", "'": '"', "`": '"'}


def _shape(t: str) -> str:
    if not t[0].isalnum():
        return _ALIKE.get(t, t)
    digits = sum(c.isdigit() for c in t)
    kind = "9" if digits == len(t) else "x" if digits else "a" if t.islower() else "A" if t.isupper() else "Aa" if t[1:].islower() else "aA"
    if kind == "x":
        kind += "h" if all(c in "0123456789abcdef" for c in t) else "A" if t.isupper() else "a" if t.islower() else "m"
    return f"{kind}{_length(len(t))}"


def file_features(text: str) -> str:
    """Of the whole text: how much of it looks like settings or code."""
    n = len(text) + 1
    return f"{min(3, 400 * (text.count('=') + text.count('{') + text.count(';')) // n)}{min(3, 200 * text.count(chr(10)) // n)}"


def features(shapes: list[str], keys: list[bool], glued: list[bool], file: str) -> list[list[str]]:
    """Of each token: its shape, those of its neighbours, key words up to four tokens before, and the file's."""
    n, out = len(shapes), []
    for i in range(n):
        s, p, q = shapes[i], shapes[i - 1] if i else "^", shapes[i - 2] if i > 1 else "^"
        f = shapes[i + 1] if i + 1 < n else "$"
        near = next((d for d in range(1, 5) if i >= d and keys[i - d]), 0)
        mark = p if p in '="' else "."
        given = "=" in shapes[max(0, i - 3) : i]
        g = "g" if glued[i] else "s"
        out.append(["*", f"s{s}", f"p{p}", f"q{q}", f"f{f}", f"g{g}{s}", f"g{g}{p}{s[:1]}", f"k{near}", f"k{near}{s}", f"m{mark}{s}", f"km{near > 0}{mark}{s[:2]}", f"d{file}{s[:2]}", f"w{keys[i]}", f"a{given}{s[:2]}", f"ka{near > 0}{given}{s}"])
    return out


FAR_BREAK = 400


def _break_before(text: str, at: int) -> int:
    """Start of the word that holds or precedes at; at most FAR_BREAK characters at a time are looked through."""
    while True:
        low = max(0, at - 1 - FAR_BREAK)
        k = max(text.rfind(c, low, max(at - 1, 0)) for c in SPACES)
        if k >= 0 or low == 0:
            return k + 1
        at = low + 1


def _break_after(text: str, at: int) -> int:
    while True:
        ends = [x for c in SPACES if (x := text.find(c, at, at + FAR_BREAK)) >= 0]
        if ends or at + FAR_BREAK >= len(text):
            return min(ends, default=len(text))
        at += FAR_BREAK


def windows(text: str, reach: int = REACH) -> Iterator[tuple[int, int]]:
    """(start, end) of the pieces of a text around unusual tokens and key words, with reach words on each side, that need tagging."""
    places = sorted([m.span() for m in UNUSUAL.finditer(text)] + [m.span() for m in HINTED.finditer(text)])
    last = None
    for a, b in places:
        if last and b <= last[2]:
            continue  # in the same word as the last
        word_end = None
        for k in range(reach + 1):
            a, b = _break_before(text, a), _break_after(text, b + (k > 0))
            word_end = b if word_end is None else word_end
        if last and a <= last[1]:
            last = (last[0], max(b, last[1]), word_end)
        else:
            if last:
                yield last[:2]
            last = (a, b, word_end)
    if last:
        yield last[:2]


def tokens(text: str, a: int, b: int) -> tuple[list[tuple[int, int]], list[str], list[bool], list[bool]]:
    spans = [m.span() for m in TOKEN.finditer(text, a, b)]
    words = [text[x:y] for x, y in spans]
    glued = [i > 0 and spans[i - 1][1] == spans[i][0] for i in range(len(spans))]
    return spans, [_shape(w) for w in words], [w.lower() in KEYS for w in words], glued


def _tags(spans: list[tuple[int, int]], secrets: list[tuple[int, int]]) -> list[int]:
    """0 outside, 1 begin, 2 inside. secrets by start; a token belongs to the first that holds it whole."""
    starts = [a for a, _ in secrets]
    reach = list(accumulate((b for _, b in secrets), max))
    out, inside = [], None
    for a, b in spans:
        # The first secret that ends at b or later, if it starts at a or before.
        k = bisect_left(reach, b)
        hit = k if k < bisect_right(starts, a) else None
        out.append(0 if hit is None else 2 if hit == inside else 1)
        inside = hit
    return out


def _made_up(rng: random.Random) -> list[tuple[list[list[str]], list[int]]]:
    """Made-up lines: values after key words that the patterns do not know, and harmless ones that look alike."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    word = lambda: "".join(rng.choice(letters) for _ in range(rng.randint(2, 9)))
    pick = lambda chars, a, b: "".join(rng.choice(chars) for _ in range(rng.randint(a, b)))
    alnum = letters + letters.upper() + "0123456789"
    values = [lambda: pick("0123456789abcdef", 16, 40), lambda: pick(alnum, 16, 40), lambda: f"{pick(alnum, 8, 14)}-{pick(alnum, 8, 14)}", lambda: f"{pick(alnum, 12, 20)}_{pick(alnum, 6, 12)}"]
    leads = ["credential: ", "credentials=", "auth = ", "Authorization: Bearer ", "private_key: ", 'access_key="', "pwd=", "passphrase: ", "client_key = ", "sk_live_", "ghp_", "signature=", "passphrase ", "my pass is "]
    plain = [lambda: f"version = {rng.randint(1, 9)}.{rng.randint(0, 20)}", lambda: f"id={rng.randint(1, 10**6)}", lambda: f"{word()}.{rng.randint(1, 99)}@{word()}{rng.randint(1, 9)}.example", lambda: f"{word()}: {word()}", lambda: f"+{pick('0123456789', 10, 12)}", lambda: f"{word()} = {word()}", lambda: pick("0123456789", 13, 16), lambda: f"{rng.randint(1, 255)}.{rng.randint(1, 255)}.{rng.randint(1, 255)}.{rng.randint(1, 255)}", lambda: f"({pick('0123456789', 3, 3)}) {pick('0123456789', 3, 3)}-{pick('0123456789', 4, 4)}", lambda: f"the key {word()} of access {word()}", lambda: f"{word()}{rng.randint(1, 99)}"]
    out = []
    for k in range(1000):
        before, after = " ".join(word() for _ in range(4)) + " ", " " + " ".join(word() for _ in range(4))
        if k % 2:
            lead, value = rng.choice(leads), rng.choice(values)()
            text, at = before + lead + value + ('"' if lead.endswith('"') else "") + after, len(before + lead)
            secret = [(at, at + len(value))]
        else:
            text, secret = before + rng.choice(plain)() + after, []
        spans, shapes, keys, glued = tokens(text, 0, len(text))
        out.append((features(shapes, keys, glued, file_features(text)), _tags(spans, secret)))
    return out


class Field:
    """Weights of features by tag, and of steps from tag to tag; a chain begins as if after "outside"."""

    def __init__(self, weights: dict[str, tuple[float, float, float]], steps: list[list[float]]):
        self.weights, self.steps = weights, steps
        self.reach = self._reach()

    def plain_margin(self) -> float:
        """By how much "outside" is ahead of any other tag, at least, on a lower-case word among such words, full stops and commas."""
        words = [f"a{n}" for n in range(7)]
        around = [*words, ".", ","]
        empty = (0.0, 0.0, 0.0)
        lead = lambda f, y: self.weights.get(f, empty)[0] - self.weights.get(f, empty)[y]
        low = float("inf")
        for y, s in product((1, 2), words):
            own = sum(lead(f, y) for f in ("*", f"s{s}", "k0", f"k0{s}", f"m.{s}", f"kmFalse.{s[:2]}", "wFalse", f"aFalse{s[:2]}", f"kaFalseFalse{s}"))
            own += min(lead(f"d{a}{b}{s[:2]}", y) for a in range(4) for b in range(4)) + min(lead(f"q{x}", y) for x in (*around, "^")) + min(lead(f"f{x}", y) for x in (*around, "$"))
            own += min(lead(f"p{x}", y) + min(lead(f"g{g}{s}", y) + lead(f"g{g}{x}{s[:1]}", y) for g in "gs") for x in (*around, "^"))
            # A step on within other tags against one within "outside".
            low = min(low, own + self.steps[0][0] - max(self.steps[x][y] for x in (1, 2)))
        return low

    def _reach(self) -> int | None:
        """How many plain words beside an unusual one a path may tag otherwise; None if there is no bound."""
        margin = self.plain_margin()
        if margin <= 0:
            return None
        flat = [x for row in self.steps for x in row]
        return max(REACH, int((max(flat) - min(flat)) * 2 / margin) + 1)

    def viterbi(self, rows: list[list[str]]) -> list[int]:
        get, steps = self.weights.get, self.steps
        best, back = [0.0, -1e9, -1e9], []
        for row in rows:
            e = [0.0, 0.0, 0.0]
            for f in row:
                if w := get(f):
                    e[0] += w[0]
                    e[1] += w[1]
                    e[2] += w[2]
            came = [max(range(3), key=lambda x: best[x] + steps[x][y]) for y in range(3)]
            best = [best[came[y]] + steps[came[y]][y] + e[y] for y in range(3)]
            back.append(came)
        tag = max(range(3), key=lambda y: best[y] + steps[y][0])
        out = []
        for came in reversed(back):
            out.append(tag)
            tag = came[tag]
        return out[::-1]

    def spans(self, text: str, wide: bool = False) -> list[tuple[int, int]]:
        """Spans that the field finds in a text; wide: tag every token, not only windows (for checking)."""
        out = []
        file = None
        for a, b in [(0, len(text))] if wide or self.reach is None else windows(text, self.reach):
            file = file or file_features(text)
            places, shapes, keys, glued = tokens(text, a, b)
            last = 0
            for (x, y), tag in zip(places, self.viterbi(features(shapes, keys, glued, file))):
                if tag == 1 or tag == 2 and last == 0:
                    out.append((x, y))
                elif tag == 2:
                    out[-1] = (out[-1][0], y)
                last = tag
        return out

    def all_spans(self, text: str) -> list[tuple[str, int, int]]:
        """Those of the patterns, and those of the field that touch none of them, by start, then kind."""
        base = base_spans(text)
        starts, reach = [], []
        for _, a, b, _ in base:
            starts.append(a)
            reach.append(max(b, reach[-1]) if reach else b)

        def taken(a: int, b: int) -> bool:
            """Whether the last pattern's span that starts before b, or one before it, ends after a."""
            k = bisect_right(starts, b - 1)
            return k > 0 and reach[k - 1] > a

        added = [("crf", a, b) for a, b in self.spans(text) if not taken(a, b)]
        return sorted([x[:3] for x in base] + added, key=lambda x: (x[1], KINDS.index(x[0])))


def cut_sequence(rows: list, tags: list[int]) -> Iterator[tuple[list, list[int]]]:
    """A sequence in pieces of SEQUENCE tokens, each a little longer if a secret would be cut."""
    at = 0
    while at < len(tags):
        end = min(at + SEQUENCE, len(tags))
        while end < len(tags) and tags[end - 1]:
            end += 1
        yield rows[at:end], tags[at:end]
        at = end


def fit(sequences: list[tuple[list[list[str]], list[int]]]) -> Field:
    """Maximum likelihood with an L2 penalty: full-batch Adam over padded sequences, gradients by forward-backward."""
    sequences = [piece for f, t in sequences for piece in cut_sequence(f, t)]
    names = {f: i for i, f in enumerate(sorted({f for rows, _ in sequences for row in rows for f in row}))}
    size, width = len(names), len(sequences[0][0][0])
    order = sorted(range(len(sequences)), key=lambda k: len(sequences[k][1]))
    blocks = []
    for at in range(0, len(order), 512):
        part = [sequences[k] for k in order[at : at + 512]]
        longest = max(len(t) for _, t in part)
        idx, tag, mask = np.full((len(part), longest, width), size), np.zeros((len(part), longest), int), np.zeros((len(part), longest))
        for r, (rows, t) in enumerate(part):
            idx[r, : len(t)] = [[names[f] for f in row] for row in rows]
            tag[r, : len(t)] = t
            mask[r, : len(t)] = 1
        blocks.append((idx, tag, mask))
    count = sum(m.sum() for _, _, m in blocks)
    w, steps = np.zeros((size + 1, 3)), np.zeros((3, 3))
    m1 = [np.zeros_like(w), np.zeros_like(steps)]
    m2 = [np.zeros_like(w), np.zeros_like(steps)]

    def lse(x, axis):
        top = x.max(axis=axis, keepdims=True)
        return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)

    for round_ in range(1, STEPS + 1):
        gw, gs = L2 * w * count / 100, L2 * steps * count / 100
        for idx, tag, mask in blocks:
            n, longest = tag.shape
            e = w[idx].sum(axis=2)
            alpha = np.zeros((n, longest, 3))
            alpha[:, 0] = e[:, 0] + steps[0]
            for i in range(1, longest):
                new = lse(alpha[:, i - 1, :, None] + steps, 1) + e[:, i]
                alpha[:, i] = np.where(mask[:, i, None] > 0, new, alpha[:, i - 1])
            z = lse(alpha[:, -1], 1)
            beta = np.zeros((n, longest, 3))
            pair = np.zeros((3, 3))
            for i in range(longest - 1, 0, -1):
                on = mask[:, i, None] > 0
                ahead = e[:, i] + beta[:, i]
                both = np.exp(alpha[:, i - 1, :, None] + steps + ahead[:, None, :] - z[:, None, None]) * mask[:, i, None, None]
                pair += both.sum(axis=0)
                beta[:, i - 1] = np.where(on, lse(steps + ahead[:, None, :], 2), beta[:, i])
            p = np.exp(alpha + beta - z[:, None, None]) * mask[..., None]
            d = p - np.eye(3)[tag] * mask[..., None]
            for y in range(3):
                gw[:, y] += np.bincount(idx.ravel(), np.repeat(d[..., y].ravel(), width), size + 1)
            np.add.at(pair, (tag[:, :-1].ravel(), tag[:, 1:].ravel()), -mask[:, 1:].ravel())
            gs += pair
            gs[0] += d[:, 0].sum(axis=0)
        w_g = (gw / count, gs / count)
        for k, (x, g) in enumerate(zip((w, steps), w_g)):
            m1[k] = 0.9 * m1[k] + 0.1 * g
            m2[k] = 0.99 * m2[k] + 0.01 * g * g
            x -= 0.3 * (m1[k] / (1 - 0.9**round_)) / (np.sqrt(m2[k] / (1 - 0.99**round_)) + 1e-8)
        w[size] = 0
    return Field({f: tuple(map(float, w[i])) for f, i in names.items()}, steps.tolist())


def _pieces(text: str) -> Iterator[tuple[int, int]]:
    """The text in pieces of about PIECE characters that end with a line, or at a space, or where they must."""
    at = 0
    while at < len(text):
        end = min(at + PIECE, len(text))
        if end < len(text):
            end = max(text.rfind("\n", at + PIECE // 2, end), -1) + 1 or max(text.rfind(" ", at + PIECE // 2, end), -1) + 1 or end
        yield at, end
        at = end


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Field:
    key = F.xxhash64(F.col(id_col).cast("string"), F.xxhash64(text_or_empty(text_col)))
    ids = docs.select(F.col(id_col).alias("doc_id")).where(F.col("doc_id").isNotNull()).distinct().orderBy(F.xxhash64(F.col("doc_id").cast("string")), "doc_id").limit(SAMPLE_DOCS)
    # SAMPLE_DOCS ids at most: small enough to broadcast.
    sample = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"), key.alias("key")).join(F.broadcast(stash(ids, "crf-ids")), "doc_id")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The MAX_SEQUENCES sequences of smallest hash so far, the largest hash on top. A piece of text whose hash is
        # larger than that is passed over before anything is looked for in it.
        best: list[tuple[int, str, list[str], list[int]]] = []
        for batch in batches:
            for key_, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                file, number = file_features(text), 0
                for x, y in _pieces(text):
                    piece = text[x:y]
                    h = int.from_bytes(hashlib.blake2b(piece.encode("utf-8", "replace"), digest_size=7).digest(), "big")
                    if len(best) == MAX_SEQUENCES and h >= -best[0][0]:
                        continue
                    secrets = sorted((v, b) for _, _, b, v in base_spans(piece))
                    for a, b in windows(piece):
                        places, shapes, keys, glued = tokens(piece, a, b)
                        for rows, tags in cut_sequence(features(shapes, keys, glued, file), _tags(places, secrets)):
                            number += 1
                            if len(tags) <= LONGEST_SEQUENCE:
                                (heapq.heappushpop if len(best) == MAX_SEQUENCES else heapq.heappush)(best, (-h, f"{key_}:{number}", ["\t".join(r) for r in rows], tags))
        for at in range(0, len(best), 500):
            part = best[at : at + 500]
            yield pa.RecordBatch.from_arrays([pa.array([-x[0] for x in part], pa.int64()), pa.array([x[1] for x in part], pa.string()), pa.array([x[2] for x in part], pa.list_(pa.string())), pa.array([x[3] for x in part], pa.list_(pa.int32()))], ["h", "place", "rows", "tags"])

    pieces = sample.select("key", "text").mapInArrow(cut, "h long, place string, rows array<string>, tags array<int>").orderBy("h", "place").limit(MAX_SEQUENCES)
    table = pieces.select("rows", "tags").toPandas()
    sequences = [([x.split("\t") for x in r], list(map(int, t))) for r, t in zip(table["rows"], table["tags"])]
    return fit(sequences + _made_up(random.Random(SEED)))


def scan(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans): array of (kind, start, end) of each whole text."""
    shared = docs.sparkSession.sparkContext.broadcast((field.weights, field.steps))
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Field(*shared.value)
        for batch in batches:
            spans = [[{"kind": k, "start": a, "end": b} for k, a, b in own.all_spans(t)] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, SPANS)], ["doc_id", "spans"])

    return docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text")).mapInArrow(run, f"doc_id {id_type}, spans array<struct<kind:string,start:int,end:int>>")


def op1_query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = scan(docs, train(docs))
    written = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    base = F.filter("spans", lambda x: x["kind"] != "crf")
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count(k) for k in KINDS[:3]], F.sha2(written(base), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"), count("crf"))
