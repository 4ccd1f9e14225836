"""Benchmark decontamination by winnowing.

Texts are cut into words; of every WINDOW - K + 1 consecutive K-gram hashes the smallest is a fingerprint. Any WINDOW words that a
document shares with a benchmark item hold one such run in both, so they share its fingerprint: no window is missed. Documents'
fingerprints are joined with the benchmark's, and each hit is extended word by word to the windows around it.
Items of fewer than WINDOW words are one window each; the smallest of their n-grams is sought among all of a document's.

The benchmark is the stated query set: it is broadcast in blocks of at most BLOCK_BYTES of text, and documents pass
each block where they are. Documents are never shuffled.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import ready, written
from .words import ALNUM, chunks, grams, texts, words

WINDOW, K = 13, 5
BLOCK_BYTES = 16 << 20
_SIEVE = 1 << 22


def winnowed(rows: np.ndarray, g: np.ndarray, size: int) -> np.ndarray:
    """Indexes of the grams that are smallest, the last of equals, in some run of ``size`` grams of one row."""
    n = len(g) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    low, at = g[size - 1 :].copy(), np.arange(size - 1, len(g))
    for i in range(size - 2, -1, -1):  # from the last to the first, strictly smaller ones win
        x = g[i : i + n]
        less = x < low
        low[less] = x[less]
        at[less] = np.flatnonzero(less) + i
    return np.unique(at[rows[:n] == rows[size - 1 :]])


class Index:
    """The items of one block: their words, and fingerprints by length of gram."""

    _kept: tuple[str, Index] | None = None

    @classmethod
    def of_worker(cls, key: str, shared) -> Index:
        """The worker's index of this block, built for its first task."""
        if cls._kept is None or cls._kept[0] != key:
            cls._kept = key, cls(*shared.value)
        return cls._kept[1]

    def __init__(self, ids: list[int], items: list[str], window: int, k: int):
        data, offsets = texts(pa.array(items, pa.string()))
        rows, _, _, self.words = words(data, offsets, ALNUM)
        self.ids, self.window, self.k = np.array(ids, np.int64), window, k
        self.count = np.bincount(rows, minlength=len(items))
        self.first = np.cumsum(self.count) - self.count
        found: dict[tuple[int, bool], list] = {}
        of, at, g = grams(rows, self.words, k, short=False)
        full = self.count[of] >= window
        keep = winnowed(of[full], g[full], window - k + 1)
        found[k, True] = [g[full][keep], of[full][keep], at[full][keep]]
        for n in np.unique(self.count[(self.count > 0) & (self.count < window)]).tolist():
            own = np.flatnonzero(self.count == n)
            size = min(k, n)
            of, at, g = grams(rows, self.words, size, short=False)
            sel = np.isin(of, own)
            of, at, g = of[sel], at[sel], g[sel]
            order = np.lexsort((g, of))
            head = np.append(True, of[order][1:] != of[order][:-1]) if len(order) else np.zeros(0, bool)
            pick = order[head]
            a, b, c = found.setdefault((size, False), [np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)])
            found[size, False] = [np.concatenate([a, g[pick]]), np.concatenate([b, of[pick]]), np.concatenate([c, at[pick]])]
        self.prints = []
        for (size, long), (g, of, at) in found.items():
            order = np.argsort(g, kind="stable")
            sieve = np.zeros(_SIEVE, bool)
            sieve[(g & np.uint64(_SIEVE - 1)).astype(np.int64)] = True
            if len(g):
                self.prints.append((size, long, g[order], of[order], at[order], sieve))

    def windows(self, rows: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first word, length, item) of every place where a window of an item stands in the words h of rows."""
        out = [(np.zeros(0, np.int64),) * 3]
        n = len(h)
        if not n:
            return out[0]
        row_first = np.searchsorted(rows, rows, side="left")
        row_end = np.searchsorted(rows, rows, side="right")
        for size, long, prints, of, at, sieve in self.prints:
            r, place, g = grams(rows, h, size, short=False)
            if long:
                keep = winnowed(r, g, self.window - self.k + 1)
                place, g = place[keep], g[keep]
            maybe = sieve[(g & np.uint64(_SIEVE - 1)).astype(np.int64)]
            place, g = place[maybe], g[maybe]
            lo, hi = np.searchsorted(prints, g, "left"), np.searchsorted(prints, g, "right")
            times = hi - lo
            for a, b in _parts(times):  # hits in bounded numbers
                t = times[a:b]
                p = np.repeat(place[a:b], t)
                which = np.arange(t.sum()) - np.repeat(np.cumsum(t) - t, t) + np.repeat(lo[a:b], t)
                item, q = of[which], at[which]
                if long:
                    out.append(self._extended(h, row_first, row_end, p, item, q))
                else:
                    start = p - (q - self.first[item])
                    length = self.count[item]
                    fits = (start >= row_first[p]) & (start + length <= row_end[p])
                    start, length, item = start[fits], length[fits], item[fits]
                    same = np.ones(len(start), bool)
                    for i in range(int(length.max(initial=0))):
                        on = i < length
                        same[on] &= h[start[on] + i] == self.words[self.first[item[on]] + i]
                    out.append((start[same], length[same], item[same]))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def _extended(self, h, row_first, row_end, p, item, q):
        reach = self.window - self.k  # words before and after the gram that a window around it can have
        shift = np.arange(-reach, self.k + reach)
        d, w = p[:, None] + shift, q[:, None] + shift
        inside = (d >= row_first[p][:, None]) & (d < row_end[p][:, None])
        inside &= (w >= self.first[item][:, None]) & (w < (self.first + self.count)[item][:, None])
        same = inside & (h[np.clip(d, 0, len(h) - 1)] == self.words[np.clip(w, 0, len(self.words) - 1)])
        total = np.concatenate([np.zeros((len(p), 1), np.int64), np.cumsum(same, axis=1)], axis=1)
        whole = total[:, self.window :] - total[:, : -self.window] == self.window
        hit, s = np.nonzero(whole)
        return p[hit] + s - reach, np.full(len(hit), self.window), item[hit]


def _parts(times: np.ndarray, most: int = 100_000) -> Iterator[tuple[int, int]]:
    ends, a = np.cumsum(times), 0
    while a < len(times):
        base = ends[a - 1] if a else 0
        b = max(a + 1, int(np.searchsorted(ends, base + most, side="right")))
        if ends[b - 1] > base:
            yield a, b
        a = b


def _found(index: Index, column) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Per chunk: first row, end, words by row, spans (row, start, end; merged, words counted from 0), pairs (row, item id)."""
    data, offsets = texts(column)
    for a, b, d, o in chunks(data, offsets):
        rows, _, _, h = words(d, o, ALNUM)
        n = np.bincount(rows, minlength=b - a)
        start, length, item = index.windows(rows, h)
        edge = np.bincount(start, minlength=len(h) + 1) - np.bincount(start + length, minlength=len(h) + 1)
        on = np.cumsum(edge)[: len(h)] > 0
        before = np.append(False, on[:-1] & (rows[1:] == rows[:-1])) if len(h) else on
        after = np.append(on[1:] & (rows[1:] == rows[:-1]), False) if len(h) else on
        opens, closes = np.flatnonzero(on & ~before), np.flatnonzero(on & ~after) + 1
        of = rows[opens]
        base = (np.cumsum(n) - n)[of]
        pairs = np.unique(np.stack([rows[start], index.ids[item]]), axis=1) if len(start) else np.zeros((2, 0), np.int64)
        yield a, b, n, np.stack([of, opens - base, closes - base]), pairs


def _lists(of: np.ndarray, n: int) -> pa.Array:
    return pa.array(np.concatenate([[0], np.cumsum(np.bincount(of, minlength=n))]).astype(np.int32))


_SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])
_SPANS = "doc_id long, n_words long, spans array<struct<start:long,end:long>>, items array<long>"


def _marks(key: str, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index.of_worker(key, shared)
        for batch in batches:
            for a, b, n, spans, pairs in _found(index, batch.column(1)):
                span = pa.StructArray.from_arrays([pa.array(spans[1], pa.int64()), pa.array(spans[2], pa.int64())], fields=list(_SPAN))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array(n, pa.int64()), pa.ListArray.from_arrays(_lists(spans[0], b - a), span), pa.ListArray.from_arrays(_lists(pairs[0], b - a), pa.array(pairs[1], pa.int64()))],
                    ["doc_id", "n_words", "spans", "items"],
                )

    return run


def _blocks(docs: DataFrame, benchmark: DataFrame, item_col: str, text_col: str, window: int, k: int) -> list:
    """The benchmark as (key, broadcast block). Each holds BLOCK_BYTES of text at most, but for an item that alone has more."""
    spark = ready(docs.sparkSession)
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(text_col).cast("string").alias("text")).where("item_id is not null and text is not null")
    total = items.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    n = 1 if total <= BLOCK_BYTES else -(-2 * total // BLOCK_BYTES)
    out = []
    for b in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == b)
        rows = part.collect()
        out.append((uuid.uuid4().hex, spark.sparkContext.broadcast(([r.item_id for r in rows], [r.text for r in rows], window, k))))
    return out


def contaminated_spans(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, k: int = K) -> DataFrame:
    """(doc_id, n_words, spans, items) for every row of ``docs``.

    Words are runs of [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F] with A-Z lower-cased. A window is ``window`` consecutive words of an item, or all of
    an item of fewer words. spans are the merged word ranges [start, end) inside any occurrence of a window; items are the sorted distinct
    ids of items with occurring windows. Null texts have no words and no spans. Items with a null id or text, or without words, are ignored;
    repeated items count once. Null doc_ids and repeated rows stay; other columns are ignored; empty tables give no spans or an empty result.
    """
    blocks = _blocks(docs, benchmark, item_col, item_text_col, window, k)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    if len(blocks) == 1:
        return rows.mapInArrow(_marks(*blocks[0]), _SPANS)
    # one pass over the documents for each block; spans of the blocks meet row by row
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()))
    parts = [rows.select("row", "text").mapInArrow(_marks(*b), _SPANS) for b in blocks]
    all_ = parts[0]
    for p in parts[1:]:
        all_ = all_.unionByName(p)
    step = lambda out, s: F.when((F.size(out) > 0) & (F.element_at(out, -1)["end"] >= s["start"]), F.concat(F.slice(out, 1, F.size(out) - 1), F.array(F.struct(F.element_at(out, -1)["start"].alias("start"), F.greatest(F.element_at(out, -1)["end"], s["end"]).alias("end"))))).otherwise(F.concat(out, F.array(s)))
    joined = all_.groupBy(F.col("doc_id").alias("row")).agg(F.max("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("s"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    merged = joined.select("row", "n_words", F.aggregate("s", F.array().cast("array<struct<start:bigint,end:bigint>>"), step).alias("spans"), "items")
    return rows.select("row", "doc_id").join(merged, "row").select("doc_id", "n_words", "spans", "items")


def contamination(spans: DataFrame, percent: int = 5) -> DataFrame:
    """From ``contaminated_spans``: (doc_id, n_words, n_hit, n_items, items_sha256, contaminated); contaminated with hits on ``percent`` of the words or more."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    listed = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return spans.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(listed, 256).alias("items_sha256")).withColumn("contaminated", (F.col("n_hit") > 0) & (100 * F.col("n_hit") >= percent * F.col("n_words")))


def decontaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", percent: int = 5) -> DataFrame:
    """The rows of ``docs``, all columns whatever their names, that are not contaminated (see ``contamination``). Rows without words stay, null texts
    too; null ids and repeated rows are judged like all others; an empty table gives an empty result, an empty benchmark all rows."""
    schema = docs.schema
    place = docs.columns.index(text_col)
    blocks = _blocks(docs, benchmark, item_col, item_text_col, WINDOW, K)
    if len(blocks) > 1:
        row = f"_row_{uuid.uuid4().hex}"
        rows = written(docs.withColumn(row, F.monotonically_increasing_id()))
        bad = contamination(contaminated_spans(rows, benchmark, row, text_col, item_col, item_text_col), percent).where("contaminated")
        return rows.join(bad.select(F.col("doc_id").alias(row)), row, "left_anti").select(*docs.columns)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index.of_worker(*blocks[0])
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            for a, b, n, spans, _ in _found(index, batch.column(place)):
                hit = np.bincount(spans[0], weights=spans[2] - spans[1], minlength=b - a)
                keep[a:b] = ~((hit > 0) & (100 * hit >= percent * n))
            yield batch.filter(pa.array(keep))

    return docs.mapInArrow(clean, schema)
