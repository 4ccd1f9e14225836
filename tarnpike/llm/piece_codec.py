"""SentencePiece encoding and decoding: Unigram Viterbi over a double-array trie of scored pieces.

Segments between spaces and line feeds are independent (see ``segments``), so each worker encodes a distinct
segment once: a batch of new segments goes through the lattice together, one numpy step for each place and piece
length, and lands in a bounded cache. Texts are never cut otherwise, and a character without a piece falls back to its bytes.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import ready
from .piece_model import BYTE, NORMAL, SPACE, UNKNOWN, USER, PieceModel, read_model
from .segments import segments

#: segments that a worker keeps before it starts anew; bytes in one lattice batch; characters of texts encoded together
CACHED, LATTICE, BATCH = 200_000, 1 << 19, 1 << 21


@dataclass
class Trie:
    """A double-array trie: the child of state s by byte c is t = base[s] + c if check[t] == s."""

    base: np.ndarray
    check: np.ndarray
    value: np.ndarray  #: piece id of a final state, else -1
    scores: np.ndarray
    unknown_score: float
    longest: int
    byte_id: np.ndarray  #: by byte; -1 without byte fallback
    unknown_id: int
    pieces: list[bytes]  #: what each id decodes to, spaces unescaped
    splits: bool


def _double_array(keys: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """base, check and value of the trie of ``keys``, parents placed before children, each at the first fit."""
    children: list[dict[int, int]] = [{}]
    final = [-1]
    for key, number in keys.items():
        node = 0
        for c in key:
            if c not in children[node]:
                children[node][c] = len(children)
                children.append({})
                final.append(-1)
            node = children[node][c]
        final[node] = number
    size = 4 * len(children) + 1024
    free = bytearray(b"\1") * size
    free[0] = 0
    base, check, value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
    queue, lowest, top = [(0, 0)], 1, 0
    for node, at in queue:
        value[at] = final[node]
        codes = sorted(children[node])
        if not codes:
            continue
        lowest = free.find(1, lowest)
        slot = max(lowest, codes[0] + 1) if len(codes) < 8 else max(top, codes[0] + 1)  # wide states go to open space
        slot = free.find(1, slot)
        while not all(free[slot - codes[0] + c] for c in codes):
            slot = free.find(1, slot + 1)
        base[at] = slot - codes[0]
        for c in codes:
            t = base[at] + c
            free[t], check[t] = 0, at
            top = max(top, int(t))
            queue.append((children[node][c], int(t)))
    return base[: top + 257], check[: top + 257], value[: top + 257]


def _scores(model: PieceModel) -> np.ndarray:
    """Log scores: the file's for a Unigram model; for merge ranks, Zipf's law over the ranks."""
    if model.unigram:
        return np.array(model.scores, np.float32)
    return np.array([-np.log(2.0 - min(s, 0.0)) if k == NORMAL else 0.0 for s, k in zip(model.scores, model.kinds, strict=True)], np.float32)


def build_trie(model: PieceModel) -> Trie:
    scores = _scores(model)
    keys = {p.encode(): i for i, (p, k) in enumerate(zip(model.pieces, model.kinds, strict=True)) if k in (NORMAL, USER)}
    base, check, value = _double_array(keys)
    byte_id = np.full(256, -1, np.int32)
    out = []
    for i, (p, k) in enumerate(zip(model.pieces, model.kinds, strict=True)):
        if k == BYTE:
            byte_id[int(p[1:-1], 16)] = i
        out.append(bytes([int(p[1:-1], 16)]) if k == BYTE else p.replace(SPACE, " ").encode() if k in (NORMAL, USER) else " \u2047 ".encode() if k == UNKNOWN else b"")
    normal = [float(scores[i]) for i in keys.values()]
    if USER in model.kinds:  # the library lets user-defined pieces win over all others
        for p, i in keys.items():
            if model.kinds[i] == USER:
                scores[i] = len(p.decode()) * max(normal) - 0.1
    return Trie(base, check, value, scores, min(normal, default=0.0) - 10.0, max(map(len, keys), default=0), byte_id, model.kinds.index(UNKNOWN), out, model.splits())


def _lattice(trie: Trie, found: list[bytes]) -> list[tuple[int, ...]]:
    """The best path of each byte string, all of about one length: ids, bytes for what has no piece."""
    n, width = len(found), max(map(len, found))
    length = np.array([len(x) for x in found])
    text = np.frombuffer(b"".join(x.ljust(width, b"\0") for x in found), np.uint8).reshape(n, width)
    best = np.full((n, width + 1), -np.inf, np.float32)
    best[:, 0] = 0
    start, piece = np.zeros((n, width + 1), np.int32), np.full((n, width + 1), -1, np.int32)
    size = np.where(text < 0x80, 1, np.where(text < 0xC0, 0, np.where(text < 0xE0, 2, np.where(text < 0xF0, 3, 4))))
    for i in range(width):
        rows = np.flatnonzero((length > i) & (size[:, i] > 0))
        at, single = rows, np.zeros(n, bool)
        state = np.zeros(len(rows), np.int64)
        for j in range(i, min(width, i + trie.longest)):
            t = trie.base[state] + text[at, j].astype(np.int64)
            ok = (trie.check[t] == state) & (j < length[at])
            at, state = at[ok], t[ok]
            if not len(at):
                break
            ends = trie.value[state]
            done = ends >= 0
            r, e = at[done], ends[done]
            single[r[size[r, i] == j + 1 - i]] = True
            score = best[r, i] + trie.scores[e]
            better = score > best[r, j + 1]
            r, e = r[better], e[better]
            best[r, j + 1], start[r, j + 1], piece[r, j + 1] = score[better], i, e
        r = rows[~single[rows]]
        end = np.minimum(i + size[r, i], length[r])
        score = best[r, i] + np.float32(trie.unknown_score)
        better = score > best[r, end]
        r, end = r[better], end[better]
        best[r, end], start[r, end], piece[r, end] = score[better], i, -1
    out = []
    for k in range(n):
        ids, j = [], int(length[k])
        while j > 0:
            i, p = int(start[k, j]), int(piece[k, j])
            if p >= 0:
                ids.append(p)
            elif trie.byte_id[0] >= 0:
                ids.extend(int(trie.byte_id[c]) for c in reversed(found[k][i:j]))
            else:
                ids.append(trie.unknown_id)
            j = i
        out.append(tuple(reversed(ids)))
    return out


class Codec:
    """Encoding and decoding in one worker."""

    _kept: tuple[str, Codec] | None = None

    def __init__(self, trie: Trie):
        self.trie, self.known = trie, {}

    @classmethod
    def of_worker(cls, key: str, shared) -> Codec:
        """The worker's codec of this query, with the segments that its earlier tasks met."""
        if cls._kept is None or cls._kept[0] != key:
            cls._kept = key, cls(shared.value)
        return cls._kept[1]

    def _new(self, missed: list[str]) -> dict[str, tuple[int, ...]]:
        mark = SPACE.encode()
        raw = [x.replace(" ", SPACE).encode() if x[:1] == "\n" else mark + x.replace(" ", SPACE).encode() for x in missed]
        order = sorted(range(len(raw)), key=lambda i: len(raw[i]))
        found: dict[str, tuple[int, ...]] = {}
        while order:  # from the longest: batches of like lengths and bounded size
            width = len(raw[order[-1]])
            take = min(len(order), max(1, LATTICE // width))
            part = [i for i in order[-take:] if 2 * len(raw[i]) >= width or width <= 24]
            del order[-len(part) :]
            found.update(zip([missed[i] for i in part], _lattice(self.trie, [raw[i] for i in part]), strict=True))
        return found

    def encode(self, text: str) -> list[int]:
        return next(self.encode_all([text]))

    def encode_all(self, found: list[str]) -> Iterator[list[int]]:
        """The ids of each text; new segments of about BATCH characters of texts meet the lattice together."""
        if not self.trie.splits:
            yield from (list(self._new([x])[x]) if x else [] for x in found)
            return
        a = 0
        while a < len(found):
            b, size = a, 0
            while b < len(found) and (b == a or size + len(found[b]) <= BATCH):
                size += len(found[b])
                b += 1
            cut = [segments(x) for x in found[a:b]]
            if len(self.known) > CACHED:
                self.known = {}
            missed = set(chain.from_iterable(cut)).difference(self.known)
            if missed:
                self.known.update(self._new(list(missed)))
            get = self.known.__getitem__
            yield from (list(chain.from_iterable(map(get, x))) for x in cut)
            a = b

    def decode(self, ids: list[int]) -> str:
        """Pieces joined; the space that encoding put before goes; bytes that are no UTF-8 become U+FFFD."""
        pieces = self.trie.pieces
        raw = b"".join(pieces[i if i is not None and 0 <= i < len(pieces) else self.trie.unknown_id] for i in ids)
        return raw.removeprefix(b" ").decode("utf-8", "replace")


def _encoded(key, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of_worker(key, shared)
        for batch in batches:
            for a in range(0, batch.num_rows, 1000):
                part = batch.slice(a, 1000)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(list(codec.encode_all([x or "" for x in part.column(1).to_pylist()])), pa.list_(pa.int32()))], ["doc_id", "ids"])

    return run


def _decoded(key, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of_worker(key, shared)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([codec.decode(x or []) for x in batch.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    return run


def _digests(key, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of_worker(key, shared)
        is_byte = np.zeros(len(shared.value.pieces), bool)
        is_byte[shared.value.byte_id[shared.value.byte_id >= 0]] = True
        for batch in batches:
            rows = []
            text = [x or "" for x in batch.column(1).to_pylist()]
            for x, ids in zip(text, codec.encode_all(text), strict=True):
                flat = np.array(ids, "<i4")
                rows.append((len(ids), int(is_byte[flat].sum()), hashlib.sha256(flat.tobytes()).hexdigest(), codec.decode(ids) == x))
            cols = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["doc_id", "n_tokens", "n_byte_tokens", "ids_sha256", "round_trip"])

    return run


def _shared_trie(df: DataFrame, model_path: str):
    with open(model_path, "rb") as f:
        return uuid.uuid4().hex, ready(df.sparkSession).sparkContext.broadcast(build_trie(read_model(f.read())))


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def encode_pieces(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids): the most likely pieces of each whole text under the model's log scores.

    The first best path counts on ties: the piece that starts earlier. Null and empty texts have no ids.
    Null ids of rows and repeated rows stay as they came; other columns are ignored; an empty table gives an
    empty result. The file may hold a Unigram model; of a BPE model the pieces are taken, scored by Zipf's law over their ranks.
    """
    return _rows(docs, id_col, text_col).mapInArrow(_encoded(*_shared_trie(docs, model_path)), "doc_id long, ids array<int>")


def decode_pieces(encoded: DataFrame, model_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text): the inverse of encoding. Null lists give an empty text; null and unknown ids read as the unknown piece. Repeated rows stay.

    Exact for every text without U+2581, which reads as a space.
    """
    rows = encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids"))
    return rows.mapInArrow(_decoded(*_shared_trie(encoded, model_path)), "doc_id long, text string")


def piece_digests(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, n_byte_tokens, ids_sha256, round_trip): encodes, decodes and compares every whole text.

    ids_sha256 is over the ids as little-endian 32-bit integers; round_trip tells whether decoding gives the text back.
    """
    return _rows(docs, id_col, text_col).mapInArrow(_digests(*_shared_trie(docs, model_path)), "doc_id long, n_tokens long, n_byte_tokens long, ids_sha256 string, round_trip boolean")
