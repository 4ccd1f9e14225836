"""LM scoring: a hierarchical Pitman-Yor model whose contexts are the words before, sampled by Gibbs.

The root restaurant serves words; below it, one restaurant for each previous word (and for the begin of a text) serves the words that
follow it. All share the root as parent: every table of a context's restaurant is a customer of the root's.

*Placement.* A bucket holds whole restaurants: contexts are dealt by hash, so customers and tables of a restaurant meet in one place. The
root is dealt by word. Between the two go messages: a bucket tells how many tables it has of each of its words, a root part answers with
the word's share. Lists of words travel once; later messages are numbers in the same order. A restaurant holds one number for
each distinct word that follows, so its size is bounded by the vocabulary, however often its context occurs.

*Sampling.* A dish with one customer has one table; the others are drawn again in every sweep from their conditional distribution given
the tables of the rest of the restaurant and the parent's share: generalised Stirling numbers for up to EXACT customers, beyond that one
customer after another, in runs. Strengths of both levels are drawn from a grid given the seating; discounts follow from
how many are seen once and twice. Random numbers depend on sweep and bucket alone, so a lost task repeats itself exactly.

*Scoring.* Tokens are packed by the bucket of their context. Known pairs, and known words after any context, are scored there; words that
the bucket does not have go on to their root part with the weight that backs off. Sums by text come back in packs of one flush of texts.
A bucket with many tokens is scored by several tasks, each with the bucket's model.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import ready, released, written
from .words import CHUNK_BYTES, SPACED, chunks, mix, texts, words

#: sweeps, of which the first BURN_IN do not count in averages; parts of a sweep between which restaurants' totals are taken anew
SWEEPS, BURN_IN, PARTS = 4, 1, 4
#: customers of a dish up to which its tables are drawn from the exact conditional distribution
EXACT = 64
#: bytes of text for each bucket of contexts, about; the fewest buckets; buckets for each part of the root
BUCKET_BYTES, LEAST_BUCKETS, PER_ROOT = 16 << 20, 32, 4
#: frequent words that messages name by number, picked from about so many bytes of texts; they change the size of messages alone
COMMON, COMMON_BYTES = 65_536, 16 << 20
#: strengths to draw from
STRENGTHS = np.logspace(-2, 4, 49)
#: bytes of text and tokens that a task packs at once
FLUSH, FLUSH_TOKENS = 12 * CHUNK_BYTES, 3 << 20
END = np.uint64(0x3C6EF372FE94F82B)  # the token after a text's last word
BEGIN = np.uint64(0x6A09E667F3BCC909)  # the context of its first

_ID = 22  # bits of a word's number within a flush
_MESSAGE = "key long, kind int, sender long, payload binary"
_NAMES = ["key", "kind", "sender", "payload"]
PAIRS, SHARED, SEATS, STATE, LISTED, TABLES, SHARES, OFTEN, WORDS, ROOT, SUMS, TOKENS, DOCS, SENT_ON, SCORED = range(15)


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays in one compressed run of byte planes; whole numbers in as few bytes as the largest needs."""
    head, body = [np.uint32(len(arrays)).tobytes()], []
    for a in arrays:
        if a.dtype.kind in "iu" and a.dtype != np.uint64:
            top = int(a.max(initial=0))
            a = a.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.int64)
        head.append(a.dtype.str.encode().ljust(4) + np.int64(len(a)).tobytes())
        body.append(np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes())
    return zstandard.ZstdCompressor(level=1).compress(b"".join(head + body))


def _unpack(raw: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(raw)
    n = int(np.frombuffer(raw, np.uint32, 1)[0])
    at, out = 4 + 12 * n, []
    for i in range(n):
        kind = np.dtype(raw[4 + 12 * i : 8 + 12 * i].decode().strip())
        size = int(np.frombuffer(raw[8 + 12 * i : 16 + 12 * i], np.int64)[0])
        planes = np.frombuffer(raw, np.uint8, size * kind.itemsize, at).reshape(kind.itemsize, size)
        a = np.ascontiguousarray(planes.T).view(kind).ravel()
        out.append(a.astype(np.int64) if kind.kind in "iu" and kind != np.uint64 else a)
        at += size * kind.itemsize
    return out


def _steps(a: np.ndarray) -> np.ndarray:
    return np.diff(a, prepend=a.dtype.type(0))


def _coded(h: np.ndarray, common: np.ndarray) -> list[np.ndarray]:
    """Hashes as numbers of common words and steps between the others; smallest if ``h`` is sorted."""
    at = _find(common, h)
    is_common = at >= 0
    return [is_common.astype(np.uint8), _steps(at[is_common]) & 0xFFFFFF, _steps(h[~is_common])]


def _decoded(coded: list[np.ndarray], common: np.ndarray) -> np.ndarray:
    is_common = coded[0] > 0
    out = np.empty(len(is_common), np.uint64)
    out[is_common] = common[np.cumsum(coded[1]) & 0xFFFFFF]
    out[~is_common] = np.cumsum(coded[2], dtype=np.uint64)
    return out


def _message(key: int, kind: int, sender: int, *arrays: np.ndarray) -> tuple:
    return key, kind, sender, _pack(*arrays)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [(), (), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.binary()), strict=True)], _NAMES)


def _grouped(step):
    """Messages of one key, by kind and in the order of their senders, to further messages."""

    def run(table: pa.Table) -> pa.Table:
        got: dict[int, list[tuple[int, list[np.ndarray]]]] = defaultdict(list)
        order = np.argsort(np.asarray(table.column("sender")), kind="stable")
        kinds, senders, raw = (table.column(c) for c in ("kind", "sender", "payload"))
        for i in order.tolist():
            got[kinds[i].as_py()].append((senders[i].as_py(), raw[i].as_py()))
        return pa.Table.from_batches([_batch(list(step(table.column("key")[0].as_py(), got)))])

    return run


def _stepped(messages: DataFrame, step) -> DataFrame:
    return messages.groupBy("key").applyInArrow(_grouped(step), _MESSAGE)


def _tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, token, whether it is the first of its row): the words of each text and the end after them."""
    n = len(offsets) - 1
    rows, _, _, h = words(data, offsets, SPACED)
    h = h + (h == END) + (h == BEGIN)
    last = np.cumsum(np.bincount(rows, minlength=n) + 1) - 1  # where the ends go
    token, of = np.empty(len(h) + n, np.uint64), np.empty(len(h) + n, np.int64)
    is_end = np.zeros(len(token), bool)
    is_end[last] = True
    token[is_end], token[~is_end] = END, h
    of[is_end], of[~is_end] = np.arange(n), rows
    first = np.zeros(len(token), bool)
    first[0 if n else slice(0)] = n > 0
    first[1:] = is_end[:-1]
    return of, token, first


def _part_of(h: np.ndarray, salt: int, parts: int) -> np.ndarray:
    return (mix(h ^ np.uint64(salt)) % np.uint64(parts)).astype(np.int64)


def _bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    return _part_of(h, 0x243F6A8885A308D3, buckets)


def _root_of(h: np.ndarray, roots: int) -> np.ndarray:
    return _part_of(h, 0x13198A2E03707344, roots)


def _numbered(held: list, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, keys): the words of held tokens and the begin; for each token bucket, context and word in one number."""
    token, first = np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held])
    kinds, w = np.unique(token, return_inverse=True)
    u = np.empty(len(w), np.int64)
    u[1:] = w[:-1]
    u[first] = len(kinds)
    hashes = np.append(kinds, BEGIN)
    bucket = _bucket_of(hashes, buckets)
    return hashes, (bucket[u] << (2 * _ID)) | (u << _ID) | w


def _by_bucket(hashes: np.ndarray, keys: np.ndarray) -> Iterator[tuple[int, slice, np.ndarray, np.ndarray, np.ndarray]]:
    """Of sorted keys: (bucket, where, hashes used, contexts, words) with contexts and words as numbers among those used."""
    bucket = keys >> (2 * _ID)
    starts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(keys) else []
    place = np.zeros(len(hashes), np.int64)
    mask = (1 << _ID) - 1
    for a, b in zip(starts, np.append(starts[1:], len(keys)) if len(keys) else [], strict=True):
        u, w = (keys[a:b] >> _ID) & mask, keys[a:b] & mask
        on = np.zeros(len(hashes), bool)
        on[u], on[w] = True, True
        used = np.flatnonzero(on)
        place[used] = np.arange(len(used))
        yield int(bucket[a]), slice(a, b), hashes[used], place[u], place[w]


def _counted(buckets: int, common):
    """Training texts to counts of (context, word), by bucket."""

    def out(held: list) -> Iterator[pa.RecordBatch]:
        hashes, keys = _numbered(held, buckets)
        keys.sort()
        new = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        count = np.diff(np.append(new, len(keys)))
        for b, where, used, u, w in _by_bucket(hashes, keys[new]):
            yield _batch([_message(b, PAIRS, 0, *_coded(used, common.value), _steps(u), w, count[where])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, many = [], 0, 0
        for batch in batches:
            data, offsets = texts(batch.column(0))
            for _, _, d, o in chunks(data, offsets):
                _, token, first = _tokens(d, o)
                if held and many + len(token) > FLUSH_TOKENS:
                    yield from out(held)
                    held, size, many = [], 0, 0
                held.append((token, first))
                size, many = size + len(d), many + len(token)
                if size > FLUSH:
                    yield from out(held)
                    held, size, many = [], 0, 0
        if held:
            yield from out(held)

    return run


@dataclass
class Restaurants:
    """The restaurants of one bucket: pairs sorted by context and word."""

    words: np.ndarray  #: hashes, by part of the root and hash
    by_root: np.ndarray  #: how many words each part of the root has
    contexts: np.ndarray  #: hashes, sorted
    follow: np.ndarray  #: how many words each context has
    word: np.ndarray  #: of each pair, as a place in ``words``
    count: np.ndarray

    @property
    def context(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.contexts)), self.follow)

    def packed(self, common: np.ndarray) -> list[np.ndarray]:
        return [*_coded(self.words, common), self.by_root, *_coded(self.contexts, common), self.follow, self.word, self.count]

    @staticmethod
    def unpacked(raw: bytes, common: np.ndarray) -> Restaurants:
        a = _unpack(raw)
        return Restaurants(_decoded(a[:3], common), a[3], _decoded(a[4:7], common), *a[7:])


def _merged(roots: int, common):
    """Counts of a bucket's pairs: its restaurants, the seats of dishes with several customers, and lists of words for the root."""

    def step(bucket: int, got: dict) -> Iterator[tuple]:
        parts = [_unpack(raw) for _, raw in got[PAIRS]]
        kinds, place = np.unique(np.concatenate([_decoded(p[:3], common.value) for p in parts]), return_inverse=True)
        base = np.cumsum([0] + [len(p[0]) for p in parts])
        u = np.concatenate([place[b : b + len(p[0])][np.cumsum(p[3])] for b, p in zip(base, parts, strict=False)])
        w = np.concatenate([place[b : b + len(p[0])][p[4]] for b, p in zip(base, parts, strict=False)])
        count = np.concatenate([p[5] for p in parts])
        key = (u << 32) | w
        order = np.argsort(key)
        new = np.flatnonzero(np.append(True, key[order][1:] != key[order][:-1]))
        count, u, w = np.add.reduceat(count[order], new), u[order][new], w[order][new]
        follows = np.zeros(len(kinds), bool)
        follows[w] = True
        listed = np.flatnonzero(follows)
        root = _root_of(kinds[listed], roots)
        listed = listed[np.argsort(root, kind="stable")]
        at = np.zeros(len(kinds), np.int64)
        at[listed] = np.arange(len(listed))
        order = np.argsort((u << 32) | at[w])
        u, w, count = u[order], at[w[order]], count[order]
        first = np.flatnonzero(np.append(True, u[1:] != u[:-1]))
        by_root = np.bincount(root, minlength=roots)
        r = Restaurants(kinds[listed], by_root, kinds[u[first]], np.diff(np.append(first, len(u))), w, count)
        yield _message(bucket, SHARED, bucket, *r.packed(common.value))

        context = r.context
        size, several = np.bincount(context, weights=count).astype(np.int64), count > 1
        alone = np.bincount(context, weights=~several).astype(np.int64)
        use = np.flatnonzero(alone < r.follow)  # contexts with a dish to draw
        to = np.zeros(len(size), np.int64)
        to[use] = np.arange(len(use))
        others = np.bincount(size[alone == r.follow]) if len(use) < len(size) else np.zeros(0, np.int64)
        tables = np.bincount(w[~several], minlength=len(listed))
        yield _message(bucket, SEATS, bucket, size[use], alone[use], others, to[context[several]], w[several], count[several], tables, by_root)
        yield _message(bucket, STATE, bucket, np.ones(int(several.sum()), np.int64))
        often, held = np.bincount(w, weights=count, minlength=len(listed)).astype(np.int64), np.bincount(w, minlength=len(listed))
        ends = np.cumsum(by_root)
        for i in np.flatnonzero(by_root):
            part = slice(ends[i] - by_root[i], ends[i])
            yield _message(int(i), LISTED, bucket, *_coded(r.words[part], common.value), often[part], held[part])
        once, twice = int((count == 1).sum()), int((count == 2).sum())
        yield _message(-1, SUMS, bucket, np.array([once, twice, count.sum()], np.float64))

    return step


def _log_gamma(x: np.ndarray) -> np.ndarray:
    shift = np.log(np.prod([x + i for i in range(8)], axis=0))
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - shift


def _stirling(discount: float) -> np.ndarray:
    """Logs of the generalised Stirling numbers S(c, t) up to EXACT: how seatings of c customers at t tables weigh."""
    out = np.full((EXACT + 1, EXACT + 1), -np.inf)
    out[0, 0] = 0.0
    for c in range(1, EXACT + 1):
        stay = c - 1 - discount * np.arange(EXACT + 1)
        with np.errstate(divide="ignore", invalid="ignore"):
            grown = np.where(stay > 0, out[c - 1] + np.log(np.maximum(stay, 1e-300)), -np.inf)
        out[c] = np.logaddexp(grown, np.append(-np.inf, out[c - 1][:-1]))
    return out


def _drawn(rng, count: np.ndarray, others: np.ndarray, share: np.ndarray, strength: float, discount: float, stirling: np.ndarray) -> np.ndarray:
    """Tables of each dish, drawn given the tables of its restaurant's other dishes and the parent's share of the dish."""
    out = np.ones(len(count), np.int64)
    uniform = rng.random(len(count))
    for c in np.unique(count[(count > 1) & (count <= EXACT)]).tolist():
        every = np.flatnonzero(count == c)
        t = np.arange(c)
        for a in range(0, len(every), max(1, (1 << 20) // c)):
            own = every[a : a + max(1, (1 << 20) // c)]
            log = np.cumsum(np.log(strength + discount * (others[own][:, None] + t)), axis=1)
            log += stirling[c, 1 : c + 1] + (t + 1) * np.log(share[own])[:, None]
            up = np.cumsum(np.exp(log - log.max(axis=1, keepdims=True)), axis=1)
            out[own] = 1 + (up[:, :-1] < uniform[own][:, None] * up[:, -1:]).sum(axis=1)
    on = np.flatnonzero(count > EXACT)
    tables, seated = np.ones(len(on)), np.ones(len(on))
    while True:  # customers one after another, beyond 16 in runs of a sixteenth
        left = np.flatnonzero(seated < count[on])
        if not len(left):
            break
        run = np.minimum(count[on[left]] - seated[left], np.maximum(1, np.floor(seated[left] / 16)))
        weight = (strength + discount * (others[on[left]] + tables[left])) * share[on[left]]
        fresh = weight / (weight + seated[left] - discount * tables[left])
        tables[left] += np.minimum(run, np.floor(run * fresh + rng.random(len(left))))
        seated[left] += run
    out[on] = tables.astype(np.int64)
    return out


def _strength_logs(customers: np.ndarray, tables: np.ndarray, times: np.ndarray, discount: float) -> np.ndarray:
    """For each of STRENGTHS the log likelihood of restaurants with so many customers at so many tables."""
    s = STRENGTHS[:, None]
    open_ = (tables - 1) * np.log(discount) + _log_gamma(s / discount + tables) - _log_gamma(s / discount + 1)
    return ((open_ - _log_gamma(s + customers) + _log_gamma(s + 1)) * times).sum(axis=1)


@dataclass
class Level:
    """What one sweep knows of both levels."""

    strength: float
    root_strength: float
    customers: float  #: of the root
    tables: float


@dataclass
class Setting:
    tokens: int
    kinds: int
    discount: float
    root_discount: float
    levels: list[Level] = field(default_factory=list)  #: one for the start and one after each sweep

    @property
    def counted(self) -> list[Level]:
        return self.levels[1 + BURN_IN :]

    def share(self, x: np.ndarray, level: Level) -> np.ndarray:
        """The root's probability of words with customers less discounted tables ``x``."""
        fresh = level.root_strength + self.root_discount * level.tables
        return (x + fresh / (self.kinds + 1)) / (level.root_strength + level.customers)


def _seated(setting: Setting, sweep: int):
    """One sweep over the restaurants of a bucket."""
    level, d = setting.levels[-1], setting.discount

    def step(bucket: int, got: dict) -> Iterator[tuple]:
        size, alone, others, context, word, count, tables, by_root = _unpack(got[SEATS][0][1])
        seats = _unpack(got[STATE][0][1])[0]
        share = setting.share(np.concatenate([_unpack(raw)[0] for _, raw in got[SHARES]] or [np.zeros(0)]).astype(np.float64), level)
        rng = np.random.default_rng([sweep, bucket, 1])
        stirling, turn = _stirling(d), rng.integers(0, PARTS, len(count))
        for i in range(PARTS):
            own = np.flatnonzero(turn == i)
            total = alone + np.bincount(context, weights=seats, minlength=len(size))
            seats[own] = _drawn(rng, count[own], total[context[own]] - seats[own], share[word[own]], level.strength, d, stirling)
        yield _message(bucket, STATE, sweep, seats)
        now = tables + np.bincount(word, weights=seats, minlength=len(tables)).astype(np.int64)
        ends = np.cumsum(by_root)
        for i in np.flatnonzero(by_root):
            yield _message(int(i), TABLES, bucket, now[ends[i] - by_root[i] : ends[i]])
        total = (alone + np.bincount(context, weights=seats, minlength=len(size))).astype(np.int64)
        pairs, times = np.unique((size << 32) | total, return_counts=True)
        single = np.flatnonzero(others)
        logs = _strength_logs(pairs >> 32, pairs & 0xFFFFFFFF, times, d) + _strength_logs(single, single, others[single], d)
        yield _message(-1, SUMS, bucket, logs)

    return step


def _opened(common):
    """A part of the root: its words, and for each bucket where the bucket's words are."""

    def step(root: int, got: dict) -> Iterator[tuple]:
        parts = [(b, _decoded(a[:3], common.value), *a[3:]) for b, a in ((b, _unpack(raw)) for b, raw in got[LISTED])]
        kinds, place = np.unique(np.concatenate([p[1] for p in parts]), return_inverse=True)
        often = np.bincount(place, weights=np.concatenate([p[2] for p in parts])).astype(np.int64)
        customers = np.bincount(place, weights=np.concatenate([p[3] for p in parts])).astype(np.int64)
        lengths = np.array([len(p[1]) for p in parts])
        starts = np.cumsum(lengths) - lengths
        steps = _steps(place)
        steps[starts] = place[starts]
        yield _message(root, WORDS, root, *_coded(kinds, common.value), often)
        yield _message(root, ROOT, root, np.array([p[0] for p in parts]), lengths, steps & 0xFFFFFFFF)
        yield _message(root, STATE, root, np.ones(len(kinds), np.int64))
        for b, a, n in zip([p[0] for p in parts], starts, lengths, strict=True):
            at = place[a : a + n]
            yield _message(b, OFTEN, root, often[at])
            yield _message(b, SHARES, root, (customers[at] - 0.5).astype(np.float32))  # a table each; the discount is not yet known
        yield _message(-1, SUMS, root, np.array([len(kinds), (customers == 1).sum(), (customers == 2).sum(), customers.sum()], np.float64))

    return step


def _places(lengths: np.ndarray, steps: np.ndarray) -> list[np.ndarray]:
    ends = np.cumsum(lengths)
    return [np.cumsum(steps[e - n : e]) & 0xFFFFFFFF for n, e in zip(lengths, ends, strict=True)]


def _rooted(setting: Setting, sweep: int):
    """One sweep over a part of the root."""
    level, d = setting.levels[-1], setting.root_discount

    def step(root: int, got: dict) -> Iterator[tuple]:
        buckets, lengths, steps = _unpack(got[ROOT][0][1])
        tables = _unpack(got[STATE][0][1])[0]
        place = _places(lengths, steps)
        customers = np.zeros(len(tables))
        for at, (_, raw) in zip(place, got[TABLES], strict=True):  # both in the order of buckets; a bucket has a word once
            customers[at] += _unpack(raw)[0]
        rng = np.random.default_rng([sweep, root, 2])
        base = np.full(len(tables), 1.0 / (setting.kinds + 1))
        tables = _drawn(rng, customers.astype(np.int64), level.tables - tables, base, level.root_strength, d, _stirling(d))
        x = (customers - d * tables).astype(np.float32)
        yield _message(root, STATE, sweep, tables, x)
        for b, at in zip(buckets.tolist(), place, strict=True):
            yield _message(b, SHARES, (sweep << 32) + root, x[at])
        yield _message(-1, SUMS, root, np.array([customers.sum(), tables.sum()], np.float64))

    return step


def _summed(messages: DataFrame) -> np.ndarray:
    """The sum of all SUMS messages: added up within partitions, then on the driver. Empty without any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for x in batch.column(0):
                a = _unpack(x.as_py())[0]
                total = a if total is None else total + a
        yield pa.RecordBatch.from_arrays([pa.array([] if total is None else [total.tolist()], pa.list_(pa.float64()))], ["sums"])

    rows = messages.where(F.col("kind") == SUMS).select("payload").mapInArrow(run, "sums array<double>").collect()
    return np.sum([r.sums for r in sorted(rows, key=lambda r: r.sums)], axis=0) if rows else np.zeros(0)


def _discount(once: float, twice: float) -> float:
    """The usual estimate from how many are seen once and twice."""
    return float(np.clip(once / (once + 2 * twice), 0.05, 0.95)) if once + twice > 0 else 0.5


def _of_kind(messages: DataFrame, *kinds: int) -> DataFrame:
    return messages.where(F.col("kind").isin(*kinds))


@dataclass
class Sampled:
    setting: Setting
    buckets: DataFrame  #: by bucket: SHARED, OFTEN, and STATE and SHARES of the sweeps that count
    root: DataFrame  #: by part of the root: WORDS, and STATE of these sweeps


def _strength(logs: np.ndarray, seed: list[int]) -> float:
    p = np.exp(logs - logs.max())
    return float(np.random.default_rng(seed).choice(STRENGTHS, p=p / p.sum()))


def sample_model(counts: DataFrame, roots: int, common) -> Sampled:
    """Gibbs sampling over buckets and root parts; the driver gets sums alone."""
    merged = written(_stepped(counts, _merged(roots, common)))
    opened = written(_stepped(_of_kind(merged, LISTED), _opened(common)))
    a, b = _summed(merged), _summed(opened)
    once, twice, tokens = a if len(a) else (0, 0, 0)
    kinds, root_once, root_twice, customers = b if len(b) else (0, 0, 0, 0)
    setting = Setting(int(tokens), int(kinds), _discount(once, twice), _discount(root_once, root_twice))
    setting.levels.append(Level(1.0, 1.0, float(customers), float(kinds)))
    buckets, root = _of_kind(merged, SHARED).unionByName(_of_kind(opened, OFTEN)), _of_kind(opened, WORDS)
    seats, lists = _of_kind(merged, SEATS), _of_kind(opened, ROOT)
    state, root_state, shares = _of_kind(merged, STATE), _of_kind(opened, STATE), _of_kind(opened, SHARES)
    last = ()
    for sweep in range(SWEEPS if tokens else 0):
        seated = written(_stepped(seats.unionByName(state).unionByName(shares), _seated(setting, sweep)))
        rooted = written(_stepped(lists.unionByName(root_state).unionByName(_of_kind(seated, TABLES)), _rooted(setting, sweep)))
        customers, tables = _summed(rooted)
        root_logs = _strength_logs(np.array([customers]), np.array([tables]), np.ones(1), setting.root_discount)
        setting.levels.append(Level(_strength(_summed(seated), [sweep, 3]), _strength(root_logs, [sweep, 4]), customers, tables))
        state, root_state, shares = _of_kind(seated, STATE), _of_kind(rooted, STATE), _of_kind(rooted, SHARES)
        if last and sweep <= BURN_IN:
            released(*last)  # what the sweep before wrote does not count, and this one has read it
        last = seated, rooted
        if sweep >= BURN_IN:
            buckets, root = buckets.unionByName(state).unionByName(shares), root.unionByName(root_state)
    if not tokens:
        setting.levels += [setting.levels[0]] * SWEEPS
    return Sampled(setting, buckets, root)


def _turn(flush: int) -> int:
    return flush ^ (flush >> 32)


def _crowded(buckets: DataFrame, number: int) -> dict[int, int]:
    """How many tasks score the tokens of a bucket, for those of more than twice the average."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens = [int(_unpack(x.as_py())[-1].sum()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(tokens, pa.int64())], ["key", "tokens"])

    rows = _of_kind(buckets, SHARED).select("key", "payload").mapInArrow(run, "key long, tokens long").collect()
    fair = max(1.0, sum(r.tokens for r in rows) / number)
    return {r.key: int(np.ceil(r.tokens / fair)) for r in rows if r.tokens > 2 * fair}


def _packed_texts(buckets: int, parts: dict[int, int], common):
    """Texts (doc_id, text) to packed tokens by bucket, and a list of each flush's texts. A bucket has ``parts`` keys, b, b + buckets, ..."""

    def out(held: list, ids: list, flush: int) -> Iterator[pa.RecordBatch]:
        hashes, keys = _numbered(held, buckets)
        base = np.cumsum([0] + [len(x) for x in ids])
        of = np.concatenate([x[2] + b for x, b in zip(held, base, strict=False)])
        tokens = np.bincount(of, minlength=base[-1])
        order = np.argsort(keys)
        keys, of = keys[order], of[order]
        new = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        ends = np.append(new, len(keys))
        for b, where, used, u, w in _by_bucket(hashes, keys[new]):
            times, own = np.diff(ends[where.start : where.stop + 1]), of[ends[where.start] : ends[where.stop]]
            yield _batch([_message(b + buckets * (_turn(flush) % parts.get(b, 1)), TOKENS, flush, *_coded(used, common.value), _steps(u), w, times, own)])
        column = pa.concat_arrays(ids)
        yield _batch([_message(_turn(flush) % buckets, DOCS, flush, np.asarray(column.fill_null(0)).view(np.uint64), np.asarray(column.is_null()).astype(np.uint8), tokens)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flush = TaskContext.get().partitionId() << 32
        held, ids, size, many = [], [], 0, 0
        for batch in batches:
            data, offsets = texts(batch.column(1))
            for a, b, d, o in chunks(data, offsets):
                of, token, first = _tokens(d, o)
                if held and many + len(token) > FLUSH_TOKENS:
                    yield from out(held, ids, flush)
                    held, ids, size, many, flush = [], [], 0, 0, flush + 1
                held.append((token, first, of))
                ids.append(batch.column(0).slice(a, b - a))
                size, many = size + len(d), many + len(token)
                if size > FLUSH:
                    yield from out(held, ids, flush)
                    held, ids, size, many, flush = [], [], 0, 0, flush + 1
        if held:
            yield from out(held, ids, flush)

    return run


class _Bucket:
    """A bucket's restaurants with averaged probabilities."""

    def __init__(self, setting: Setting, got: dict, common: np.ndarray):
        none, no_words = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        r = Restaurants.unpacked(got[SHARED][0][1], common) if got[SHARED] else Restaurants(no_words, none, no_words, none, none, none)
        seats = [_unpack(raw)[0] for _, raw in got[STATE]]  # in the order of sweeps; answers of a sweep in the order of the root's parts
        answers = [_unpack(raw)[0] for _, raw in got[SHARES]]
        parts = len(answers) // max(1, len(seats))
        d, levels = setting.discount, setting.counted
        self.context, self.word = r.contexts, np.sort(r.words)
        self.place = np.argsort(r.words)
        context = r.context
        self.key = (context << 32) | r.word
        several = r.count > 1
        size = np.bincount(context, weights=r.count, minlength=len(r.contexts))
        self.back, self.share = [], []
        own = np.zeros(len(r.count))
        for s, level in enumerate(levels if got[SHARED] else []):
            tables = np.ones(len(r.count))
            tables[several] = seats[s]
            x = np.concatenate(answers[s * parts : (s + 1) * parts]).astype(np.float64)
            share = setting.share(x, level)
            back = (level.strength + d * np.bincount(context, weights=tables, minlength=len(size))) / (level.strength + size)
            own += (r.count - d * tables) / (level.strength + size[context]) + back[context] * share[r.word]
            self.back.append(back)
            self.share.append(share)
        self.log = np.log10(own / max(1, len(levels)))


def _bucket_scores(setting: Setting, roots: int, common):
    floor = np.log10(setting.tokens + setting.kinds + 1)
    many = len(setting.counted)

    def step(key: int, got: dict) -> Iterator[tuple]:
        for flush, raw in got[DOCS]:
            yield flush, DOCS, flush, raw
        if not got[TOKENS]:
            return
        bucket = _Bucket(setting, got, common.value)
        often = np.concatenate([_unpack(raw)[0] for _, raw in got[OFTEN]]) if got[OFTEN] else np.zeros(0, np.int64)
        base_log = np.log10(often + 1.0) - floor
        for flush, raw in got[TOKENS]:
            *used, u, w, times, of = _unpack(raw)
            used, u = _decoded(used, common.value), np.cumsum(u)
            as_context, as_word = (_find(found, used) for found in (bucket.context, bucket.word))
            as_word = np.where(as_word >= 0, bucket.place[as_word], -1) if len(bucket.place) else as_word
            c, x = as_context[u], as_word[w]  # of each pair, as often as it comes
            here = x >= 0
            score, base = np.zeros(len(c)), np.zeros(len(c))
            pair = np.where(here & (c >= 0), _find(bucket.key, (c << 32) | x), -1)
            seen = pair >= 0
            score[seen] = bucket.log[pair[seen]]
            weight = np.ones((many, len(c)), np.float32)
            for s, back in enumerate(bucket.back):
                weight[s, c >= 0] = back[c[c >= 0]]
            back_off = here & ~seen
            if back_off.any():
                score[back_off] = np.log10(sum(weight[s, back_off] * bucket.share[s][x[back_off]] for s in range(many)) / many)
            base[here] = base_log[x[here]]
            texts_, of_text = np.unique(of, return_inverse=True)
            known, base, score = (np.bincount(of_text, weights=np.repeat(v, times), minlength=len(texts_)) for v in (here, base, score))
            yield _message(flush, SCORED, key, texts_, known.astype(np.int64), base, score.astype(np.float32))
            pair = np.repeat(np.arange(len(w)), times)
            away = np.flatnonzero(~here[pair])
            pair = pair[away]
            part = _root_of(used[w[pair]], roots)
            for r in np.unique(part).tolist():
                on = part == r
                kinds, at = np.unique(used[w[pair[on]]], return_inverse=True)
                yield _message(r, SENT_ON, flush, *_coded(kinds, common.value), at, of[away[on]], *weight[:, pair[on]])

    return step


def _find(sorted_: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Where each of ``x`` is in ``sorted_``, or -1."""
    if not len(sorted_):
        return np.full(len(x), -1)
    at = np.minimum(np.searchsorted(sorted_, x), len(sorted_) - 1)
    return np.where(sorted_[at] == x, at, -1)


def _root_scores(setting: Setting, common):
    floor, levels = np.log10(setting.tokens + setting.kinds + 1), setting.counted

    def step(root: int, got: dict) -> Iterator[tuple]:
        *kinds, often = _unpack(got[WORDS][0][1]) if got[WORDS] else [*_coded(np.zeros(0, np.uint64), common.value), np.zeros(0, np.int64)]
        kinds, kept = _decoded(kinds, common.value), [_unpack(raw)[1] for _, raw in got[STATE]]
        for flush, raw in got[SENT_ON]:
            a, b, c, h, of, *weight = _unpack(raw)
            at = _find(kinds, _decoded([a, b, c], common.value))[h]
            known = at >= 0
            p = np.zeros(len(h))
            for s, level in enumerate(levels):
                x = np.zeros(len(h))
                if len(kinds):
                    x[known] = kept[s][at[known]]
                p += weight[s] * setting.share(x, level)
            count = np.zeros(len(h))
            count[known] = often[at[known]]
            texts_, of_text = np.unique(of, return_inverse=True)
            sums = (np.bincount(of_text, weights=v, minlength=len(texts_)) for v in (np.log10(count + 1) - floor, np.log10(p / len(levels))))
            yield _message(flush, SCORED, -1 - root, texts_, np.bincount(of_text, weights=known, minlength=len(texts_)).astype(np.int64), *sums)

    return step


def _by_text(table: pa.Table) -> pa.Table:
    """All messages of a flush: one row for each of its texts."""
    kinds, senders, payload = (table.column(c).to_pylist() for c in ("kind", "sender", "payload"))
    ids, null, tokens = _unpack(payload[kinds.index(DOCS)])
    known, base, score = np.zeros(len(ids), np.int64), np.zeros(len(ids)), np.zeros(len(ids))
    for _, i in sorted((s, i) for i, (k, s) in enumerate(zip(kinds, senders, strict=True)) if k == SCORED):
        at, *sums = _unpack(payload[i])
        known[at] += sums[0]
        base[at] += sums[1]
        score[at] += sums[2]
    return pa.table({"doc_id": pa.array(ids.view(np.int64), mask=null.astype(bool)), "n_tokens": tokens, "n_known": known, "base_score": base, "score": score})


def _common(texts_: DataFrame, size: int) -> np.ndarray:
    """Sorted hashes of frequent words of a sample of texts, COMMON at most: numbers for messages, of no effect on scores."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = []
        for batch in batches:
            data, offsets = texts(batch.column(0))
            found += [np.unique(_tokens(d, o)[1], return_counts=True) for _, _, d, o in chunks(data, offsets)]
        kinds, place = np.unique(np.concatenate([x[0] for x in found] or [np.zeros(0, np.uint64)]), return_inverse=True)
        times = np.bincount(place, weights=np.concatenate([x[1] for x in found] or [np.zeros(0)]), minlength=len(kinds))
        on = times > 1
        yield pa.RecordBatch.from_arrays([pa.array(kinds[on].view(np.int64)), pa.array(times[on].astype(np.int64))], ["word", "times"])

    share = COMMON_BYTES / max(size, 1)
    sample = texts_ if share >= 1 else texts_.sample(share, seed=1)
    rows = sample.mapInArrow(run, "word long, times long").groupBy("word").agg(F.sum("times").alias("times")).orderBy(F.desc("times"), "word").limit(COMMON).collect()
    return np.sort(np.array([r.word for r in rows], np.int64).view(np.uint64))


def language_model_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 7, held: int = 2) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row.

    Tokens are words (runs of bytes other than space and 09-0D, A-Z lower-cased) and one end for each text. The model learns from rows
    whose CRC-32 of the id as text, modulo ``folds``, is not ``held``. score is the text's log10 probability under the hierarchical
    Pitman-Yor model, averaged over Gibbs sweeps; base_score that of the unigram with one added to each count; n_known counts tokens
    that training texts have. Perplexity is 10 ** (-score / n_tokens).

    Null and blank texts have the end alone. Rows with a null id are scored and neither held out nor learned from. Repeated rows stay and count
    as often as they come. Other columns are ignored; an empty table gives an empty result; without training rows every probability is 1.
    Words are held as 64-bit hashes.
    """
    ready(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == held, F.lit(False))
    size = rows.agg(F.sum(F.octet_length("text") + 8)).first()[0] or 0
    buckets = max(LEAST_BUCKETS, size // BUCKET_BYTES)
    roots = max(1, buckets // PER_ROOT)
    common = docs.sparkSession.sparkContext.broadcast(_common(rows.select("text"), size))
    model = sample_model(rows.where("doc_id is not null").where(~out).select("text").mapInArrow(_counted(buckets, common), _MESSAGE), roots, common)
    setting, parts = model.setting, _crowded(model.buckets, buckets)
    times = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for pair in parts.items() for x in pair)), F.col("key")), F.lit(1)) if parts else F.lit(1)
    copies = model.buckets.select(F.explode(F.transform(F.sequence(F.lit(0), times - 1), lambda i: F.col("key") + buckets * i)).alias("key"), "kind", "sender", "payload")
    packed = rows.mapInArrow(_packed_texts(buckets, parts, common), _MESSAGE)
    scored = written(_stepped(packed.unionByName(copies), _bucket_scores(setting, roots, common)))
    at_root = _stepped(model.root.unionByName(_of_kind(scored, SENT_ON)), _root_scores(setting, common))
    every = _of_kind(scored, DOCS, SCORED).unionByName(at_root)
    summed = every.groupBy("key").applyInArrow(_by_text, "doc_id long, n_tokens long, n_known long, base_score double, score double")
    return summed.select("doc_id", out.alias("held_out"), "n_tokens", "n_known", F.lit(setting.tokens).cast("long").alias("train_tokens"), "base_score", "score")
