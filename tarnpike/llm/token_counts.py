"""Token counts: a map-side lookup in two tiers, so that no pre-token is shuffled.

The first tier is a broadcast table of the token counts of frequent pre-tokens: FREQUENT entries at most,
whatever the input. They are picked from a sample of about SAMPLE_BYTES of texts, counted on the driver. The second tier is a bounded cache in
each worker, kept for its later tasks, which encodes what the table lacks with the tokenizer's library. Which pre-tokens are in a tier
changes the speed alone; all texts are counted whole.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import ready
from .piece_model import read_model
from .segments import segments

#: entries of the broadcast table; bytes of the texts that they are picked from, about
FREQUENT, SAMPLE_BYTES = 40_000, 8 << 20
#: pre-tokens in a worker's cache, and the longest that it keeps
CACHED, LONGEST = 400_000, 64
#: texts longer than so many characters are cut into segments a part at a time
SLICE = 1 << 20


def _parts(text: str) -> Iterator[list[str]]:
    if len(text) <= SLICE:
        yield segments(text)
        return
    at = 0
    while at < len(text):  # cut before a line feed, where any two parts are apart
        end = text.find("\n", at + SLICE)
        end = len(text) if end < 0 else end
        part = segments(text[at:end])
        yield part[1:] if at else part  # a later part opens with its line feed; the empty segment before it is not in the text
        at = end


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of a task's sampled pre-tokens that come more than once."""
    counts: Counter[str] = Counter()
    for batch in batches:
        for text in batch.column(0).to_pylist():
            for part in _parts(text or ""):
                counts.update(part)
    often = [(x, n) for x, n in counts.items() if n > 1 and len(x) <= LONGEST]
    yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in often], pa.string()), pa.array([n for _, n in often], pa.int64())], ["pre_token", "times"])


def _frequent(texts_: DataFrame) -> list[str]:
    """The most frequent pre-tokens of a sample that is bounded in bytes, however large the table."""
    size = texts_.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    sample = texts_ if size <= SAMPLE_BYTES else texts_.sample(SAMPLE_BYTES / size, seed=1)
    counts: Counter[str] = Counter()
    for r in sample.mapInArrow(_sampled, "pre_token string, times long").collect():
        counts[r.pre_token] += r.times
    return [x for x, _ in sorted(counts.items(), key=lambda e: (-e[1], e[0]))[:FREQUENT]]


class _Worker:
    """The tokenizer and the tiers of one worker process; the second one goes on from task to task."""

    _kept: tuple[str, _Worker] | None = None

    def __init__(self, raw: bytes, pre_tokens: str, sizes: bytes):
        self.lengths, self.whole = _encoder(raw)
        self.frequent = dict(zip(pre_tokens.split("\0"), np.frombuffer(sizes, np.uint16).tolist(), strict=True)) if sizes else {}
        self.known = dict(self.frequent)

    @classmethod
    def of(cls, key: str, raw, table) -> _Worker:
        if cls._kept is None or cls._kept[0] != key:
            cls._kept = key, cls(raw.value, *table.value)
        return cls._kept[1]


def _encoder(raw: bytes):
    """Function from segments to token counts."""
    sp = sentencepiece.SentencePieceProcessor(model_proto=raw)

    def lengths(found: list[str]) -> list[int]:
        # the library puts a space before; a segment that opens with a line feed has none, an empty one is the space alone
        return [1 if not x else len(ids) - (x[0] == "\n") for x, ids in zip(found, sp.encode(found, num_threads=1), strict=True)]

    return lengths, lambda text: len(sp.encode(text))


def _counted(key: str, raw, table, splits: bool, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker = _Worker.of(key, raw, table)

        def count(text: str) -> int:
            if not splits:
                return worker.whole(text)
            total = 0
            for part in _parts(text):
                sizes = list(map(worker.known.get, part))
                if None in sizes:
                    missed = {x for x, n in zip(part, sizes, strict=True) if n is None}
                    new = dict(zip(missed, worker.lengths(list(missed)), strict=True))
                    total += sum(n if n is not None else new[x] for x, n in zip(part, sizes, strict=True))
                    if len(worker.known) > CACHED:
                        worker.known = dict(worker.frequent)
                    worker.known.update((x, n) for x, n in new.items() if len(x) <= LONGEST)
                else:
                    total += sum(sizes)
            return total

        for batch in batches:
            text = pc.fill_null(batch.column(1), "")
            n_bytes = pc.binary_length(text.cast(pa.large_binary()))
            n = [count(x) for x in text.to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), n_bytes.cast(pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return run


def token_counts(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 4096) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row: tokens as the SentencePiece library gives them
    for the whole text with the model file at ``model_path``, without begin or end tokens.

    A null text counts as empty: 0 bytes, 0 tokens. Rows with null ids and repeated rows come back as they came.
    Other columns are ignored. An empty table gives an empty result. A model that normalises texts, or with
    pieces across spaces, is applied to whole texts without the two tiers.
    """
    spark = ready(docs.sparkSession)
    with open(model_path, "rb") as f:
        proto = f.read()
    model = read_model(proto)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    table = "", b""
    if model.splits():
        found = [x for x in _frequent(rows.select("text")) if "\0" not in x]
        if found:
            table = "\0".join(found), np.array(_encoder(proto)[0](found), np.uint16).tobytes()
    share = spark.sparkContext.broadcast
    return rows.mapInArrow(_counted(uuid.uuid4().hex, share(proto), share(table), model.splits(), limit), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
