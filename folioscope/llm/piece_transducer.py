"""Piece encoding and decoding; a weighted transducer normalises for models that drop blanks.

Only that normaliser is composed with a text and its shortest path taken. Other models replace
blanks in the text, and pieces and byte fallback are looked up. Unigram models take the cheapest
path by piece scores. Merge models (BPE), the registered one among them, are searched depth first
and without weights, over neighbouring pieces: two pieces may follow each other just if merging
their characters gives these two. A sequence all of whose neighbours may follow each other is the
one that merging produces, so there is exactly one.
"""

from __future__ import annotations

import math
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioscope.llm.registry import query
from folioscope.llm.shared import table
from folioscope.llm.transducers import ANY, Transducer
from folioscope.llm.vectext import slices

BLANK = "▁"
UNIGRAM, MERGES = 1, 2
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Stretches and pairs of pieces a task remembers; characters of the longest stretch among them.
REMEMBERED, LONG_STRETCH = 1_000_000, 64


class Spec(NamedTuple):
    """What a model file says."""

    pieces: list[tuple[str, float, int]]
    kind: int
    byte_fallback: bool
    charsmap: bytes
    dummy_prefix: bool
    drop_blanks: bool
    escape: bool


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Numbers and values of the fields of a protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        else:
            size = {1: 8, 2: -1, 5: 4}[key & 7]
            size = varint() if size < 0 else size
            yield key >> 3, data[at : at + size]
            at += size


def read_model(data: bytes) -> Spec:
    pieces, trainer, normaliser = [], {}, {}
    for field, value in _fields(data):
        if field == 1:
            own = dict(_fields(value))
            score = struct.unpack("<f", own[2])[0] if 2 in own else 0.0
            pieces.append((own.get(1, b"").decode(), score, own.get(3, NORMAL)))
        elif field == 2:
            trainer = dict(_fields(value))
        elif field == 3:
            normaliser = dict(_fields(value))
    spec = Spec(
        pieces, trainer.get(3, UNIGRAM), bool(trainer.get(35, 0)), normaliser.get(2, b""),
        bool(normaliser.get(3, 1)), bool(normaliser.get(4, 1)), bool(normaliser.get(5, 1)),
    )
    if spec.charsmap or spec.kind not in (UNIGRAM, MERGES) or any(p[2] == USER for p in pieces):
        raise ValueError("models with a character map, user-defined symbols or of other kinds are not compiled")
    return spec


def normaliser(spec: Spec) -> Transducer:
    """Blanks to the blank sign, runs of them to one where the model says so; all else as it is."""
    blank = BLANK if spec.escape else " "
    t = Transducer("text")
    if spec.drop_blanks:
        for s in (" ", BLANK):
            t.add("text", s, blank, 0.0, "blank")
            t.add("blank", s, "", 0.0, "blank")
        t.add("blank", ANY, ANY, 0.0, "text")
    else:
        t.add("text", " ", blank, 0.0, "text")
    t.add("text", ANY, ANY, 0.0, "text")
    return t


class Encoder:
    """Composes texts with a compiled model and reads off cheapest paths."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.spec = spec = read_model(f.read())
        self._normaliser = normaliser(spec)
        self._id = {p: i for i, (p, _, kind) in enumerate(spec.pieces) if kind == NORMAL}
        self._score = np.array([s for _, s, _ in spec.pieces])
        self._longest = max(map(len, self._id), default=1)
        self._beginnings = {p[:n] for p in self._id for n in range(2, len(p) + 1)}
        self._byte = {int(p[3:-1], 16): i for i, (p, _, kind) in enumerate(spec.pieces) if kind == BYTE}
        self._unknown = next((i for i, p in enumerate(spec.pieces) if p[2] == UNKNOWN), 0)
        self._worst = float(self._score.min()) - 10.0 if len(self._score) else -10.0
        # Pieces that hold a blank behind another character would reach from one stretch into the next.
        self._cut = not any(BLANK in p.lstrip(BLANK) for p in self._id) and spec.escape
        self._stretch = re.compile(f"{BLANK}+[^{BLANK}]+|{BLANK}+|[^{BLANK}]+")
        self._known: dict[str, bytes] = {}
        self._neighbours: dict[tuple[str, str], bool] = {}
        self._split: dict[str, tuple[str, str] | None] = {}
        self._scores = self._score.tolist()

    def normalised(self, text: str) -> str:
        if not text:
            return ""
        if self.spec.drop_blanks:
            text = text.strip(" ")
            text = "".join(self._normaliser.shortest(text)[1]) if text else ""
        elif self.spec.escape:
            # The normaliser has one state here, so composing with it maps each character.
            text = text.replace(" ", BLANK)
        return (BLANK if self.spec.dummy_prefix and text else "") + text

    def _halves(self, piece: str) -> tuple[str, str] | None:
        """The two parts that merging joins last to get this piece, None if it never gets it.

        Neighbouring characters are merged, the best-scored result first, the leftmost of equals.
        """
        if piece not in self._split:
            parts, last = list(piece), None
            while len(parts) > 1:
                best, at = None, -1
                for i in range(len(parts) - 1):
                    found = self._id.get(parts[i] + parts[i + 1])
                    if found is not None and (best is None or self._score[found] > best):
                        best, at = self._score[found], i
                if at < 0:
                    last = None
                    break
                last = parts[at], parts[at + 1]
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            self._split[piece] = last
        return self._split[piece]

    def _turn(self, piece: str) -> float:
        """When merging makes a piece: the worse its score, the later; a character is there at once."""
        return -self._scores[self._id[piece]] if len(piece) > 1 else -math.inf

    def _may_follow(self, a: str, b: str) -> bool:
        """Whether merging leaves two pieces side by side.

        The merges that made them are undone, the latest first. In between, the two parts at the
        boundary stand side by side, and must not have a merge of their own that comes sooner
        than the one just undone. Of equals, the leftmost comes first.
        """
        key = (a, b)
        known = self._neighbours.get(key)
        if known is None:
            if len(self._neighbours) > REMEMBERED:
                self._neighbours.clear()
            known = self._neighbours[key] = self._stay_apart(a, b)
        return known

    def _stay_apart(self, a: str, b: str) -> bool:
        limit, equal_too = math.inf, False
        left, right = self._turn(a), self._turn(b)
        while True:
            if a + b in self._id:
                joint = self._turn(a + b)
                if joint < limit or equal_too and joint == limit:
                    return False
            if left > right:
                limit, equal_too = left, False
                a = self._halves(a)[1]
                left = self._turn(a)
            elif right > -math.inf:
                limit, equal_too = right, True
                b = self._halves(b)[0]
                right = self._turn(b)
            else:
                return True

    def path(self, text: str) -> list[str]:
        """Pieces of a normalised text on the cheapest path; unknown characters stand alone."""
        n, ids, longest = len(text), self._id, self._longest
        if self.spec.kind == UNIGRAM:
            cost, back = [0.0] + [np.inf] * n, [0] * (n + 1)
            for end in range(1, n + 1):
                for begin in range(max(0, end - longest), end):
                    piece = ids.get(text[begin:end])
                    if piece is not None:
                        total = cost[begin] - self._score[piece]
                    elif end - begin == 1:
                        total = cost[begin] - self._worst
                    else:
                        continue
                    if total < cost[end]:
                        cost[end], back[end] = total, begin
        else:
            return self._only_path(text)
        out, end = [], n
        while end:
            out.append(text[back[end] : end])
            end = back[end]
        return out[::-1]

    def _starts(self, text: str, at: int) -> list[str]:
        """Pieces that begin at a place, the longest last."""
        found = [text[at]]
        beginnings, ids, split = self._beginnings, self._id, self._split
        for end in range(at + 2, len(text) + 1):
            piece = text[at:end]
            if piece not in beginnings:
                break
            if piece in ids and (split.get(piece) or self._halves(piece)):
                found.append(piece)
        return found

    def _only_path(self, text: str) -> list[str]:
        """The one path of finite cost: longest pieces first, back from where no piece may follow."""
        pieces: list[str] = []
        place, open_ = [0], [self._starts(text, 0)] if text else []
        dead: set[tuple[int, str]] = set()
        while place[-1] < len(text):
            while open_[-1]:
                piece = open_[-1].pop()
                to = place[-1] + len(piece)
                if (not pieces or self._may_follow(pieces[-1], piece)) and (to, piece) not in dead:
                    pieces.append(piece)
                    place.append(to)
                    open_.append(self._starts(text, to) if to < len(text) else [])
                    break
            else:
                open_.pop()
                dead.add((place.pop(), pieces.pop()))
        return pieces

    def _ids(self, text: str) -> bytes:
        out, unknown = [], False
        for piece in self.path(text):
            i = self._id.get(piece)
            if i is not None:
                out.append(i)
                unknown = False
            elif self.spec.byte_fallback:
                out.extend(self._byte[b] for b in piece.encode())
            elif not unknown:
                out.append(self._unknown)
                unknown = True
        return np.array(out, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian 32-bit words."""
        text = self.normalised(text)
        if not self._cut:
            return self._ids(text)
        if len(self._known) > REMEMBERED:
            self._known.clear()
        parts, known, out = self._stretch.findall(text), self._known, []
        for s in parts:
            ids = known.get(s)
            if ids is None:
                ids = self._ids(s)
                if len(s) <= LONG_STRETCH:
                    known[s] = ids
            out.append(ids)
        return b"".join(out)


@lru_cache(maxsize=1)
def loaded(path: str) -> Encoder:
    """The encoder of a model, kept by the process with what it has remembered."""
    return Encoder(path)


class Decoder:
    """The inverse transducer: ids to pieces, pieces and bytes to text."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self._spec = spec = read_model(f.read())
        self._bytes = []
        for piece, _, kind in spec.pieces:
            if kind == BYTE:
                self._bytes.append(bytes([int(piece[3:-1], 16)]))
            elif kind == CONTROL:
                self._bytes.append(b"")
            elif kind == UNKNOWN:
                self._bytes.append(" ⁇ ".encode())
            else:
                self._bytes.append((piece.replace(BLANK, " ") if spec.escape else piece).encode())

    def decode(self, ids: bytes) -> str:
        data = b"".join(map(self._bytes.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        text = data.decode("utf-8", "replace")
        return text[1:] if self._spec.dummy_prefix and text.startswith(" ") else text


def encode(docs: DataFrame, model: str) -> DataFrame:
    """(doc_id, ids) for every row of (doc_id, text): ids is an array of int.

    A null or empty text has no ids. Texts are encoded whole, without begin, end or added
    special tokens. Repeated rows give a row each; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = loaded(model)
        for batch in batches:
            for part in slices(batch, "text"):
                ids = [np.frombuffer(encoder.encode(t or ""), "<i4") for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"]
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """(doc_id, text) for every row of (doc_id, ids); null or empty ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(model)
        for batch in batches:
            texts = [decoder.decode(np.array(x or [], "<u4").tobytes()) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, text string")


def digests(docs: DataFrame, model: str) -> DataFrame:
    """(doc_id, n_pieces, ids_crc32, round_trip): encoding and decoding again, in one pass.

    ``round_trip`` holds if decoding gives the text, a null text counting as empty; the blank
    sign itself comes back as a blank, which is the one difference it allows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = loaded(model), Decoder(model)
        for batch in batches:
            for part in slices(batch, "text"):
                texts = [t or "" for t in part.column("text").to_pylist()]
                ids = [encoder.encode(t) for t in texts]
                same = [decoder.decode(i) == t.replace(BLANK, " ") for i, t in zip(ids, texts, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array([len(i) // 4 for i in ids], pa.int64()),
                        pa.array([zlib.crc32(i) for i in ids], pa.int64()),
                        pa.array(same, pa.bool_()),
                    ],
                    ["doc_id", "n_pieces", "ids_crc32", "round_trip"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, n_pieces long, ids_crc32 long, round_trip boolean"
    )


@query("op6_piece_transducer")
def op6_piece_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of every document by the 32k piece model, and whether they decode to the text."""
    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
