"""Reading SentencePiece model files: the few fields that splitting and scoring need."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protobuf message: varints as int, the rest as bytes."""
    i = 0

    def varint() -> int:
        nonlocal i
        value = shift = 0
        while True:
            byte = raw[i]
            i += 1
            value |= (byte & 0x7F) << shift
            shift += 7
            if byte < 0x80:
                return value

    while i < len(raw):
        tag = varint()
        if tag & 7 == 0:
            yield tag >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(tag & 7) or varint()
            yield tag >> 3, raw[i : i + size]
            i += size


@dataclass
class PieceModel:
    pieces: list[str]
    scores: list[float]
    kinds: list[int]
    unigram: bool
    plain: bool  #: texts are only escaped: no normalisation, one space put before, white space kept

    def splits(self) -> bool:
        """Whether no piece goes on past a space or a line feed, so that segments can be encoded alone."""
        return self.plain and USER not in self.kinds and not any(SPACE in p.lstrip(SPACE) or "\n" in p for p in self.pieces)


def read_model(raw: bytes) -> PieceModel:
    pieces, scores, kinds, trainer, normalizer = [], [], [], {}, {}
    for number, value in _fields(raw):
        if number == 1:
            x = dict(_fields(value))
            pieces.append(x.get(1, b"").decode())
            scores.append(struct.unpack("<f", x.get(2, b"\0\0\0\0"))[0])
            kinds.append(x.get(3, NORMAL))
        elif number == 2:
            trainer = dict(_fields(value))
        elif number == 3:
            normalizer = dict(_fields(value))
    plain = not normalizer.get(2) and normalizer.get(3, 1) == 1 and normalizer.get(4, 1) == 0 and normalizer.get(5, 1) == 1 and trainer.get(24, 0) == 0
    return PieceModel(pieces, scores, kinds, trainer.get(3, 1) == 1, plain)
