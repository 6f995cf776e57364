"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of scored pieces.

The model file is read on the driver, at a path that is a parameter, and only its table of pieces (its size is fixed by
the file) goes to the executors. Encoding marks spaces with U+2581, puts one before the text, and finds for each run of
the text the pieces of largest total score; characters that no piece covers become their UTF-8 bytes. No piece crosses
from another character to a marker, so the best path of a text is that of its marker-led runs, each of which is solved
once and remembered in a table of bounded size. A worker process builds the trie once and keeps it for later tasks.

Defined results: null and empty texts have no pieces and decode to the empty text; U+2581 in a text decodes to a space,
as it does in the published scheme; ties go to the longest last piece. Models that change the text before it is cut (a
normaliser table, extra white space removed, spaces not marked or marked behind) or that hold user-defined pieces, which
are cut out before all others, are refused.
"""

from __future__ import annotations

import re
import struct
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import text_or_empty

MARK = "▁"
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Piece types of the model format, and what an unknown character scores below the smallest score.
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNKNOWN_PENALTY = 10.0
NOWHERE = float("-inf")
#: Solved runs that are remembered before the older half is forgotten.
REMEMBERED = 300_000
#: Characters up to which runs are solved together and remembered.
SHORT = 64


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """(number, value) of each field of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        elif kind == 1:
            at += 8
            yield key >> 3, data[at - 8 : at]
        elif kind == 5:
            at += 4
            yield key >> 3, struct.unpack("<f", data[at - 4 : at])[0]
        else:
            n = varint()
            at += n
            yield key >> 3, data[at - n : at]


@dataclass
class DoubleArray:
    """A byte trie in two arrays: the child of s by byte b is base[s] + b if check there is s; value is a piece id or -1."""

    base: list[int] = field(default_factory=list)
    check: list[int] = field(default_factory=list)
    value: list[int] = field(default_factory=list)

    @classmethod
    def build(cls, keys: list[tuple[bytes, int]]) -> DoubleArray:
        keys = sorted(keys)
        size = 1 << 16
        base, check, value = np.zeros(size, np.int64), np.full(size, -1, np.int64), np.full(size, -1, np.int64)
        check[0] = 0
        # Where the search for room starts, by number of children: it only moves on, so building takes linear time.
        hints: dict[int, int] = {}
        todo = [(0, 0, len(keys), 0)]
        while todo:
            state, lo, hi, depth = todo.pop()
            if lo < hi and len(keys[lo][0]) == depth:
                value[state] = keys[lo][1]
                lo += 1
            if lo >= hi:
                continue
            starts = [lo] + [i for i in range(lo + 1, hi) if keys[i][0][depth] != keys[i - 1][0][depth]]
            labels = np.array([keys[i][0][depth] for i in starts])
            at = hints.get(min(len(labels), 8), 1)
            while True:
                while at + 512 >= len(check):
                    base, value = np.concatenate([base, np.zeros(size, np.int64)]), np.concatenate([value, np.full(size, -1, np.int64)])
                    check = np.concatenate([check, np.full(size, -1, np.int64)])
                room = (check[np.arange(at, at + 256)[:, None] + labels] < 0).all(axis=1)
                if room.any():
                    at += int(room.argmax())
                    break
                at += 256
            hints[min(len(labels), 8)] = at
            base[state] = at
            check[at + labels] = state
            for label, i, j in zip(labels, starts, [*starts[1:], hi]):
                todo.append((at + int(label), i, j, depth + 1))
        # Room beyond every base, so that a step never leaves the arrays.
        return cls(base.tolist() + [0] * 256, check.tolist() + [-1] * 256, value.tolist() + [-1] * 256)


@dataclass
class PieceModel:
    """Pieces with scores and kinds; the trie is built where it is used and kept there."""

    pieces: list[bytes]
    scores: list[float]
    kinds: list[int]
    dummy_prefix: bool = True

    @classmethod
    def read(cls, path: str) -> PieceModel:
        with open(path, "rb") as f:
            data = f.read()
        pieces, scores, kinds, prefix = [], [], [], True
        for number, value in _fields(data):
            if number == 1:
                x = dict(_fields(value))
                pieces.append(bytes(x.get(1, b"")))
                scores.append(x.get(2, 0.0))
                kinds.append(x.get(3, NORMAL))
            elif number == 2 and dict(_fields(value)).get(24, 0):
                raise ValueError("models that mark spaces behind words are not supported")
            elif number == 3:
                rules = dict(_fields(value))
                if rules.get(2) or rules.get(4, 1) or not rules.get(5, 1):
                    raise ValueError("models that normalise the text are not supported")
                prefix = bool(rules.get(3, 1))
        if USER in kinds:
            raise ValueError("user-defined pieces are not supported")
        return cls(pieces, scores, kinds, prefix)

    def codec(self) -> Codec:
        if not hasattr(self, "_codec"):
            self._codec = Codec(self)
        return self._codec

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_codec"}


class Codec:
    def __init__(self, model: PieceModel):
        self.model = model
        keys = [(p, i) for i, (p, k) in enumerate(zip(model.pieces, model.kinds)) if k == NORMAL]
        trie = DoubleArray.build(keys)
        self.base, self.check, self.value = trie.base, trie.check, trie.value
        self.arrays = tuple(np.array(x) for x in (trie.base, trie.check, trie.value, model.scores or [0.0]))
        self.unknown = min((model.scores[i] for _, i in keys), default=0.0) - UNKNOWN_PENALTY
        self.byte_ids = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(model.pieces, model.kinds)) if k == BYTE}
        self.first_unknown = next((i for i, k in enumerate(model.kinds) if k == UNKNOWN), 0)
        self.by_byte = np.array([self.byte_ids.get(b, self.first_unknown) for b in range(256)])
        crossing = any(MARK in p.decode("utf-8", "ignore").lstrip(MARK) for p, _ in keys)
        newline = any(b"\n" in p for p, _ in keys)
        self.runs = re.compile("(?s).+" if crossing else f"{MARK}*[^{MARK}]+|{MARK}+" if newline else f"\n|{MARK}*[^{MARK}\n]+|{MARK}+")
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        #: What each id decodes to, as bytes.
        self.spelled = [bytes([int(p[3:5], 16)]) if k == BYTE else b"" if k == CONTROL else p.replace(MARK.encode(), b" ") for p, k in zip(model.pieces, model.kinds)]
        self.is_byte = np.array([k == BYTE for k in model.kinds] or [False])

    def best(self, run: str) -> list[int]:
        """The ids of the path of largest score through one run."""
        data = run.encode("utf-8", "replace")
        n = len(data)
        base, check, value, scores = self.base, self.check, self.value, self.model.scores
        score, back = [NOWHERE] * (n + 1), [(0, -1)] * (n + 1)
        score[0] = 0.0
        i = 0
        while i < n:
            lead = data[i]
            width = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
            here, state, j, single = score[i], 0, i, False
            i += width
            while j < n:
                to = base[state] + data[j]
                if check[to] != state:
                    break
                state = to
                j += 1
                k = value[to]
                if k >= 0:
                    if j == i:
                        single = True
                    s = here + scores[k]
                    if s > score[j]:
                        score[j] = s
                        back[j] = (i - width, k)
            if not single:
                s = here + self.unknown
                if s > score[i]:
                    score[i] = s
                    back[i] = (i - width, -1)
        out, j = [], n
        while j:
            i, k = back[j]
            if k >= 0:
                out.append(k)
            else:
                out.extend(self.byte_ids.get(b, self.first_unknown) for b in reversed(data[i:j])) if self.byte_ids else out.append(self.first_unknown)
            j = i
        return out[::-1]

    def best_many(self, runs: list[str]) -> list[bytes]:
        """best() of many short runs at once, as bytes of 32-bit ids: the trie is walked from all places in step, and each
        place of all runs is then decided together, nearer places first."""
        coded = [r.encode("utf-8", "replace") for r in runs]
        data = np.frombuffer(b"".join(coded), np.uint8)
        lengths = np.array([len(c) for c in coded])
        ends = np.cumsum(lengths)
        begin = np.flatnonzero((data & 0xC0) != 0x80)
        run = np.searchsorted(ends, begin, "right")
        width = np.diff(np.append(begin, len(data)))
        base, check, value, scores = self.arrays
        # Pieces that begin at each place: (number of the place, end, id).
        who, state, at, alone = np.arange(len(begin)), np.zeros(len(begin), np.int64), begin.copy(), np.zeros(len(begin), bool)
        found = []
        while len(who):
            to = base[state] + data[at]
            ok = check[to] == state
            who, state, at = who[ok], to[ok], at[ok] + 1
            k = value[state]
            hit = k >= 0
            found.append((who[hit], at[hit], k[hit]))
            alone[who[hit & (at == begin[who] + width[who])]] = True
            ok = at < ends[run[who]]
            who, state, at = who[ok], state[ok], at[ok]
        bare = np.flatnonzero(~alone)
        found.append((bare, begin[bare] + width[bare], np.full(len(bare), -1)))
        who, end, k = (np.concatenate(x) for x in zip(*found))
        # By place in the run, then by run, then longer pieces first, which win ties.
        first = ends - lengths
        place = end - first[run[who]]
        order = np.lexsort((begin[who], place))
        who, end, k, place = who[order], end[order], k[order], place[order]
        gain = np.where(k >= 0, scores[k], self.unknown)
        score, chosen = np.full(len(data) + 1, NOWHERE), np.zeros(len(data) + 1, np.int64)
        # score[x] is that of the path up to place x; the ends of one run are the next one's beginning, which counts as 0.
        came, starts = begin[who], begin[who] == first[run[who]]
        cuts = np.flatnonzero(np.diff(place, prepend=-1, append=-1))
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            total = np.where(starts[lo:hi], 0.0, score[came[lo:hi]]) + gain[lo:hi]
            heads = np.flatnonzero(np.diff(end[lo:hi], prepend=-1))
            best = np.maximum.reduceat(total, heads)
            same = np.flatnonzero(total == np.repeat(best, np.diff(np.append(heads, hi - lo))))
            same = same[np.diff(end[lo:hi][same], prepend=-1) != 0]
            score[end[lo:hi][heads]], chosen[end[lo:hi][heads]] = best, lo + same
        # Back from the ends, all runs in step.
        here, owner, steps = ends.copy(), np.arange(len(runs)), []
        while len(here):
            m = chosen[here]
            steps.append((owner, m))
            here = came[m]
            ok = here > first[owner]
            here, owner = here[ok], owner[ok]
        owner, m, depth = np.concatenate([o for o, _ in steps]), np.concatenate([m for _, m in steps]), np.repeat(np.arange(len(steps)), [len(o) for o, _ in steps])
        order = np.lexsort((-depth, owner))
        owner, m = owner[order], m[order]
        size = np.where((k[m] >= 0) | (not self.byte_ids), 1, end[m] - came[m])
        out = np.repeat(np.where(k[m] >= 0, k[m], self.first_unknown), size)
        if self.byte_ids:
            lone = np.repeat(k[m] < 0, size)
            within = np.arange(len(out)) - np.repeat(np.cumsum(size) - size, size)
            out[lone] = self.by_byte[data[(np.repeat(came[m], size) + within)[lone]]]
        stops = [0, *np.cumsum(4 * np.bincount(owner, size, len(runs)).astype(np.int64)).tolist()]
        raw = out.astype(np.int32).tobytes()
        return [raw[x:y] for x, y in zip(stops, stops[1:])]

    def encode_all(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text. Runs that are not known are solved together, long ones alone."""
        prefix, cut = MARK if self.model.dummy_prefix else "", self.runs.findall
        listed = [cut(prefix + t.replace(" ", MARK)) if t else [] for t in texts]
        if len(self.known) >= REMEMBERED // 2:
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        new = sorted(set().union(*listed).difference(known))
        known.update((r, older[r]) for r in new if r in older)
        short, long = [r for r in new if len(r) <= SHORT and r not in older], [r for r in new if len(r) > SHORT]
        if short:
            known.update(zip(short, self.best_many(short)))
        known.update((r, array("i", self.best(r)).tobytes()) for r in long)
        out = [np.frombuffer(b"".join(map(known.__getitem__, runs)), np.int32) for runs in listed]
        for r in long:
            del known[r]
        return out

    def encode(self, text: str | None) -> np.ndarray:
        return self.encode_all([text])[0]

    def decode(self, ids) -> str:
        spelled = self.spelled
        text = b"".join([spelled[i] for i in ids]).decode("utf-8", "replace")
        return text[1:] if self.model.dummy_prefix and text[:1] == " " else text


def encode_column(docs: DataFrame, model_path: str = MODEL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, n_bytes, round_trip, ids): the pieces of each text, and whether decoding them gives it back."""
    model = docs.sparkSession.sparkContext.broadcast(PieceModel.read(model_path))
    id_type = docs.schema[id_col].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = model.value.codec()
        for batch in batches:
            for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                texts = part.column(1).to_pylist()
                ids = codec.encode_all(texts)
                ends = np.cumsum([0, *map(len, ids)])
                flat = np.concatenate([*ids, np.zeros(0, np.int32)])
                is_byte = np.concatenate([[0], np.cumsum(codec.is_byte[flat])])
                same = [codec.decode(x.tolist()) == t.replace(MARK, " ") for x, t in zip(ids, texts)]
                columns = [part.column(0), pa.array(np.diff(ends)), pa.array(is_byte[ends[1:]] - is_byte[ends[:-1]]), pa.array(same, pa.bool_()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "n_bytes", "round_trip", "ids"])

    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    return rows.mapInArrow(encode, f"doc_id {id_type}, n_tokens long, n_bytes long, round_trip boolean, ids array<int>")


def decode_column(encoded: DataFrame, model_path: str = MODEL) -> DataFrame:
    """(doc_id, text) from (doc_id, ids)."""
    model = encoded.sparkSession.sparkContext.broadcast(PieceModel.read(model_path))
    id_type = encoded.schema["doc_id"].dataType.simpleString()

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = model.value.codec()
        for batch in batches:
            texts = [codec.decode(x or ()) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(decode, f"doc_id {id_type}, text string")


def op10_query(spark, sf_dir: str) -> DataFrame:
    return encode_column(spark.read.parquet(f"{sf_dir}/documents.parquet"))
