"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence matrix.

The join is exact: every pair of texts at or above the threshold ends up linked. Work that cannot matter
is taken away first, by bounds that follow from set sizes alone:

1.  Texts with equal n-gram sets form one class; the rest works on one document of each class.
2.  *Bounds by block.* With |x & y| >= t * max(|x|, |y|), two linked sets share at least l n-grams within
    the first |x| - ceil(t |x|) + l of each in any common order. These postings, sorted and packed, are
    dealt over blocks of n-grams; each block tells how many of a class's postings another class of
    compatible size has too. A class with too few cannot be linked and leaves.
3.  The rest lists its n-grams that occur in more than one class, the rarest first, and leaves unless
    they are enough. Prefixes of these lists give buckets.
4.  In every bucket all members meet one leader (pairs linear in the bucket). Leaders' links give first components.
5.  *Product.* Buckets that still hold several components name pairs of row blocks (about BLOCK rows of similar
    set size each); pairs whose sizes rule out a link are left out. For each other pair of blocks the product of
    their incidence matrices gives all overlap counts at once, and counts below the size-derived bound are discarded.

What is not in a bucket with two components is never multiplied, so groups of copies cost rows, not pairs.
Keys with very many rows (frequent n-grams, large classes) are joined by broadcast, see ``_split_join``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import ready, released, written
from .components import components
from .words import CHUNK_BYTES, chunks, gram_sets, grams, mix, texts, words

#: n-gram postings that one block of step 2 holds, about; and the fewest blocks
BLOCK_POSTINGS, LEAST_BLOCKS = 1_000_000, 96
#: rows of the incidence matrix in one block of step 5
BLOCK = 192
#: keys that hold more than one in so many rows are joined by broadcast
HOT = 100_000
#: spots of one n-gram that meet in one task, about
SPOTS = 64
#: survivors of step 2 up to this many are broadcast to the texts (8 bytes each); beyond, Spark joins by shuffle
BROADCAST_IDS = 2_000_000


def _least(n, t: int):
    """The smallest overlap that a set of n can have with a linked one: ceil(t n / 100)."""
    return (n * t + 99) // 100


def _share(n, t: int):
    """l of step 2: how many common n-grams the prefix must show."""
    return n - _least(n, t) + 1


def _sets(data: np.ndarray, offsets: np.ndarray, k: int):
    """Sorted distinct grams of each row: (rows, grams, sizes)."""
    rows, _, _, h = words(data, offsets)
    rows, _, g = grams(rows, h, k)
    rows, g = gram_sets(rows, g)
    return rows, g, np.bincount(rows, minlength=len(offsets) - 1)


def _signature(rows: np.ndarray, g: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit sums over each row's set."""
    out = []
    for salt in (0x51ED270B2F6A3C1D, 0xA24BAED4963EE407):
        s = np.zeros(n, np.uint64)
        if len(g):
            first = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
            with np.errstate(over="ignore"):
                s[rows[first]] = np.add.reduceat(mix(g ^ np.uint64(salt)), first)
        out.append(s.view(np.int64))
    return out[0], out[1]


def _signatures(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = texts(batch.column(1))
            for a, b, d, o in chunks(data, offsets):
                rows, g, n = _sets(d, o, k)
                s1, s2 = _signature(rows, g, b - a)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(n, pa.int64()), pa.array(s1), pa.array(s2)], ["doc_id", "n_shingles", "s1", "s2"])

    return run


def _packed(block: int, h: np.ndarray, doc: np.ndarray, s1: np.ndarray, n: np.ndarray) -> bytes:
    """Postings of one block: sorted 40-bit hashes in byte planes, with their rows' class and size."""
    order = np.argsort(h)
    used, local = np.unique(doc[order], return_inverse=True)
    planes = h[order].view(np.uint8).reshape(-1, 8)[:, 4::-1].T
    head = np.array([len(h), len(used)], np.int64)
    return head.tobytes() + planes.tobytes() + local.astype(np.uint16).tobytes() + s1[used].tobytes() + n[used].astype(np.int32).tobytes()


def _unpacked(payload: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    m, u = np.frombuffer(payload, np.int64, 2)
    planes = np.frombuffer(payload, np.uint8, 5 * m, 16).reshape(5, m)
    h = np.zeros((m, 8), np.uint8)
    h[:, 4::-1] = planes.T
    local = np.frombuffer(payload, np.uint16, m, 16 + 5 * m)
    s1 = np.frombuffer(payload[16 + 7 * m : 16 + 7 * m + 8 * u], np.int64)
    n = np.frombuffer(payload[16 + 7 * m + 8 * u :], np.int32)
    return h.view(np.uint64).ravel(), s1[local], n[local]


def _postings(k: int, t: int, blocks: int, flush: int = 10 * CHUNK_BYTES):
    def out(held: list) -> Iterator[pa.RecordBatch]:
        if not held:
            return
        base = np.cumsum([0] + [len(x[2]) for x in held])
        h = np.concatenate([x[0] for x in held])
        doc = np.concatenate([x[1] + p for x, p in zip(held, base, strict=False)])
        s1, n = np.concatenate([x[2] for x in held]), np.concatenate([x[3] for x in held])
        block = (h >> np.uint64(40)) % np.uint64(blocks)
        h = h & np.uint64((1 << 40) - 1)
        order = np.argsort(block, kind="stable")
        ends = np.searchsorted(block[order], np.arange(blocks + 1))
        for b in range(blocks):
            part = order[ends[b] : ends[b + 1]]
            if len(part):
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([_packed(b, h[part], doc[part], s1, n)], pa.binary())], ["block", "payload"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, count = [], 0, 0
        for batch in batches:
            data, offsets = texts(batch.column(0))
            for a, b, d, o in chunks(data, offsets):
                if held and (size + len(d) > flush or count + b - a > 60_000):
                    yield from out(held)
                    held, size, count = [], 0, 0
                rows, g, n = _sets(d, o, k)
                s1, _ = _signature(rows, g, b - a)
                starts = np.cumsum(n) - n
                lim = n - _least(n, t) + _share(n, t)
                lim[np.setdiff1d(np.arange(b - a), np.unique(s1, return_index=True)[1])] = 0  # of copies in a chunk, one emits
                keep = np.arange(len(g)) - starts[rows] < lim[rows]
                kept = 0
                while kept < b - a:  # payloads number their rows with 16 bits
                    top = min(b - a, kept + 60_000)
                    own = keep & (rows >= kept) & (rows < top)
                    held.append((mix(g[own] ^ np.uint64(0x2545F4914F6CDD1D)), rows[own] - kept, s1[kept:top], n[kept:top]))
                    count += top - kept
                    kept = top
                    if kept < b - a:
                        yield from out(held)
                        held, count = [], 0
                size += len(d)
        yield from out(held)

    return run


def _compatible(t: int):
    """Of each class, the postings in this block that another class of compatible size has too."""

    def run(table: pa.Table) -> pa.Table:
        parts = [_unpacked(x.as_py()) for x in table.column("payload")]
        h, s, n = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((s, n, h))
        h, s, n = h[order], s[order], n[order].astype(np.int64)
        keep = np.append(True, (h[1:] != h[:-1]) | (s[1:] != s[:-1]))
        h, s, n = h[keep], s[keep], n[keep]
        near = (h[1:] == h[:-1]) & (100 * n[:-1] >= t * n[1:])
        hit = np.zeros(len(h), bool)
        hit[1:] |= near
        hit[:-1] |= near
        found, count = np.unique(s[hit], return_counts=True)
        return pa.table({"s1": found, "hits": count.astype(np.int64)})

    return run


def _exploded(k: int, named: bool):
    """(rep, n, own, gram): the grams of each row. own: its signature if ``named``, which tells apart the texts of one id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = texts(batch.column(1))
            for a, b, d, o in chunks(data, offsets):
                rows, g, n = _sets(d, o, k)
                own = _signature(rows, g, b - a)[0] if named else np.zeros(b - a, np.int64)
                ids = np.asarray(batch.column(0))[a:b]
                for i in range(0, len(g), 200_000):
                    r = rows[i : i + 200_000]
                    yield pa.RecordBatch.from_arrays([pa.array(ids[r]), pa.array(n[r], pa.int64()), pa.array(own[r]), pa.array(g[i : i + 200_000].view(np.int64))], ["rep", "n", "own", "gram"])

    return run


def _product(t: int):
    """All links between the rows of two blocks, as merges only: a spanning forest over components."""

    def run(table: pa.Table) -> pa.Table:
        side = np.asarray(table.column("side"))
        rep, n, comp = (np.asarray(table.column(c)) for c in ("rep", "n", "component"))
        lists = table.column("grams").combine_chunks()
        flat, offs = np.asarray(lists.values), np.asarray(lists.offsets)
        length = np.diff(offs)
        row = np.repeat(np.arange(len(rep)), length)
        columns, col, count = np.unique(flat[offs[0] : offs[-1]], return_inverse=True, return_counts=True)
        useful = count > 1
        number = np.cumsum(useful) - 1
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        if not len(right):
            right = left  # a block with itself
        place = np.zeros(len(rep), np.int64)
        overlap = np.zeros((len(left), len(right)), np.float32)
        width, total = 8192, int(useful.sum())
        own = useful[col]
        r, c = row[own], number[col[own]]
        order = np.argsort(c, kind="stable")
        r, c = r[order], c[order]
        of = np.searchsorted(c, np.arange(0, total + width, width))
        is_left, is_right = np.zeros(len(rep), bool), np.zeros(len(rep), bool)
        is_left[left], is_right[right] = True, True
        for i in range(len(of) - 1):  # the common dimension in slices, so that memory stays bounded
            rr, cc = r[of[i] : of[i + 1]], c[of[i] : of[i + 1]] - i * width
            m = min(width, total - i * width)
            a, b = np.zeros((len(left), m), np.float32), np.zeros((len(right), m), np.float32)
            place[left] = np.arange(len(left))
            on = is_left[rr]
            a[place[rr[on]], cc[on]] = 1
            place[right] = np.arange(len(right))
            on = is_right[rr]
            b[place[rr[on]], cc[on]] = 1
            overlap += a @ b.T
        linked = (100 + t) * overlap.astype(np.int64) >= t * (n[left][:, None] + n[right][None, :])
        linked &= comp[left][:, None] != comp[right][None, :]
        parent: dict[int, int] = {}  # merges so far

        def root(x: int) -> int:
            while parent.get(x, x) != x:
                parent[x] = parent.get(parent[x], parent[x])
                x = parent[x]
            return x

        edges = []
        for i, j in zip(*np.nonzero(linked), strict=True):
            x, y = root(int(comp[left[i]])), root(int(comp[right[j]]))
            if x != y:
                parent[max(x, y)] = min(x, y)
                edges.append((int(rep[left[i]]), int(rep[right[j]])))
        return pa.table({"a": pa.array([e[0] for e in edges], pa.int64()), "b": pa.array([e[1] for e in edges], pa.int64())})

    return run


def _split_join(rows: DataFrame, stats: DataFrame, keys: list[str], weight: str, total: int) -> DataFrame:
    """Inner join with ``stats``, one row a key, which tells in ``weight`` how many of the ``total`` rows have the key. Keys with more than
    total / HOT rows are fewer than HOT: they come by broadcast, so that no task gets all rows of one. Spark shuffles the rest."""
    often = F.col(weight) > total // HOT
    hot = F.broadcast(stats.where(often))
    return rows.join(hot, keys).unionByName(rows.join(F.broadcast(stats.where(often).select(keys)), keys, "left_anti").join(stats.where(~often), keys))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """One row per input row: (doc_id, n_shingles, component_id), exactly.

    Words are runs of bytes other than space and 09-0D, with A-Z lower-cased; a row's set is its distinct
    k-word shingles, or its whole sequence if it has fewer words. Rows link when
    100 * |x & y| >= percent * |x | y|; component_id is the smallest id reachable by links, itself included.

    Null or blank texts have n_shingles 0 and their own id. Rows with a null id come back with their
    n_shingles and a null component_id and link nothing. Repeated rows come back as often as they came;
    different texts under one id are one node with the links of all of them.
    Other columns are ignored, whatever their names. An empty table gives an empty result.
    Sets are held as 64-bit hashes of their shingles.
    """
    spark = ready(docs.sparkSession)
    t = percent
    working: list[DataFrame] = []

    def kept(df: DataFrame) -> DataFrame:
        working.append(written(df))
        return working[-1]

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    signed = written(rows.mapInArrow(_signatures(k), "doc_id long, n_shingles long, s1 long, s2 long"))
    classes = kept(signed.where("n_shingles > 0 and doc_id is not null").groupBy("n_shingles", "s1", "s2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")))
    # every copy of a text emits its postings, so blocks are as many as all of them need
    total = classes.agg(F.sum(F.col("n_shingles") * F.col("copies"))).first()[0] or 0
    blocks = max(LEAST_BLOCKS, int(total * 2 * (100 - t) / 100) // BLOCK_POSTINGS)

    hits = (
        rows.where("doc_id is not null").select("text").mapInArrow(_postings(k, t, blocks), "block int, payload binary")
        .groupBy("block").applyInArrow(_compatible(t), "s1 long, hits long")
        .groupBy("s1").agg(F.sum("hits").alias("hits"))
    )
    smallest = F.floor((F.col("n_shingles") * t + 99) / 100)  # of a partner, at least
    need = smallest - F.floor((smallest * t + 99) / 100) + 1
    maybe = kept(classes.join(hits, "s1").where(F.col("hits") >= need).select(F.col("rep").alias("doc_id")))
    few = maybe.count() <= BROADCAST_IDS
    of_class = rows.join(F.broadcast(maybe) if few else maybe, "doc_id", "left_semi").select("doc_id", "text")
    repeats = _repeats(rows)
    postings = of_class.mapInArrow(_exploded(k, repeats), "rep long, n long, own long, gram long")
    postings = kept(postings.distinct() if repeats else postings)

    often = kept(postings.groupBy("gram").agg(F.count("*").alias("times")).where("times > 1"))
    listed = (
        _split_join(postings, often, ["gram"], "times", postings.count()).groupBy("rep", "n", "own").agg(F.sort_array(F.collect_list(F.struct("times", "gram"))).alias("grams"))
        .where((F.size("grams") * 100 >= F.col("n") * t))
        .select("rep", "n", F.col("grams.gram").alias("grams"))
    )
    listed = kept(listed)
    single = F.col("n") - F.size("grams")
    prefix = (F.col("n") - F.floor((F.col("n") * t + 99) / 100) + 1 - single).cast("int")
    buckets = kept(listed.where(prefix > 0).select("rep", "n", F.explode(F.slice("grams", 1, prefix)).alias("gram")))
    spread = buckets.count()

    leaders = kept(buckets.groupBy("gram").agg(F.min("rep").alias("leader"), F.count("*").alias("members")).where("members > 1"))
    stars = _split_join(buckets, leaders, ["gram"], "members", spread).where("rep <> leader").select("rep", "leader").distinct()
    left = listed.select(F.col("rep"), F.col("n").alias("n1"), F.col("grams").alias("g1"))
    right = listed.select(F.col("rep").alias("leader"), F.col("n").alias("n2"), F.col("grams").alias("g2"))
    sized = stars.join(left, "rep").join(right, "leader").where(F.least("n1", "n2") * 100 >= F.greatest("n1", "n2") * t)
    starred = kept(sized.where((100 + t) * F.size(F.array_intersect("g1", "g2")) >= t * (F.col("n1") + F.col("n2"))).select(F.col("rep").alias("a"), F.col("leader").alias("b")))
    first = components(starred)
    working.append(first)

    marked = buckets.join(first.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    mixed = marked.groupBy("gram").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.min("rep").alias("leader"), F.count("*").alias("members")).where("low <> high")
    mixed = kept(mixed.select("gram", "leader", "members"))
    open_ = kept(_split_join(marked, mixed, ["gram"], "members", spread).select("gram", "leader", "members", "rep", "n", "component"))
    # a row's family is its smallest leader; a large family is cut by set size, then into blocks of rows alike in number
    alike = F.floor(F.log("n") / F.log(F.lit(max(100 / t, 1.01)))).cast("int")
    family = kept(open_.groupBy("rep", "n", "component").agg(F.min("leader").alias("family")).withColumn("alike", alike))
    sizes = family.groupBy("family", "alike").agg(F.count("*").alias("rows"))
    sizes = kept(sizes.join(sizes.groupBy("family").agg(F.sum("rows").alias("whole")), "family"))
    large = F.col("whole") > BLOCK
    part = F.when(large, F.pmod(F.xxhash64("rep"), F.ceil(F.col("rows") / BLOCK).cast("long"))).otherwise(0)
    block = F.struct("family", F.when(large, F.col("alike")).otherwise(-1).alias("alike"), part.alias("part"))
    placed = kept(_split_join(family, sizes, ["family", "alike"], "rows", family.count()).select("rep", "n", "component", block.alias("block")))
    of = [F.min("component").alias("low"), F.max("component").alias("high"), F.min("n").alias("least"), F.max("n").alias("most"), F.first("members").alias("members")]
    spots = kept(open_.select("gram", "members", "rep", "n").join(placed, ["rep", "n"]).groupBy("gram", "block").agg(*of))
    # blocks of one n-gram meet in several tasks: its spots on one side are dealt, on the other repeated
    deal = F.ceil(F.col("members") / (BLOCK * SPOTS)).cast("long")
    one = spots.withColumn("dealt", F.pmod(F.xxhash64("block"), deal)).drop("members")
    other = spots.withColumn("dealt", F.explode(F.sequence(F.lit(0).cast("long"), deal - 1))).select("gram", "dealt", *(F.col(x).alias(f"{x}2") for x in ("block", "low", "high", "least", "most")))
    sizes_fit = (F.col("most") * 100 >= F.col("least2") * t) & (F.col("most2") * 100 >= F.col("least") * t)
    pairs = one.join(other, ["gram", "dealt"]).where("block <= block2").where("low <> high or low2 <> high2 or low <> low2").where(sizes_fit)
    pairs = kept(pairs.select("block", "block2").distinct())
    member = placed.join(listed, ["rep", "n"])
    sides = pairs.join(member, "block").select("block", "block2", F.lit(0).alias("side"), "rep", "n", "component", "grams").unionByName(
        pairs.where("block <> block2").join(member.withColumnRenamed("block", "block2"), "block2").select("block", "block2", F.lit(1).alias("side"), "rep", "n", "component", "grams")
    )
    merged = kept(sides.groupBy("block", "block2").applyInArrow(_product(t), "a long, b long"))
    linked = components(starred.unionByName(merged))
    working.append(linked)

    label = written(classes.join(linked.withColumnRenamed("node", "rep"), "rep", "left").select("n_shingles", "s1", "s2", "copies", F.coalesce("component", "rep").alias("component_id")))
    released(*working)
    has = F.coalesce((F.col("n_shingles") > 0) & F.col("doc_id").isNotNull(), F.lit(False))
    found = _split_join(signed.where(has), label, ["n_shingles", "s1", "s2"], "copies", signed.count())
    # texts without words and rows without an id are linked with nothing
    return found.select("doc_id", "n_shingles", "component_id").unionByName(signed.where(~has).withColumn("component_id", F.col("doc_id")).select("doc_id", "n_shingles", "component_id"))


def _repeats(rows: DataFrame) -> bool:
    """Whether any id occurs twice."""
    return bool(rows.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").limit(1).count())


def near_duplicates_dropped(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs``, all columns, with one row of each group of near duplicates: that of the smallest id.

    Rows without words or with a null id are groups of their own; repeated rows of one id all stay; columns may have any names; an empty table stays empty.
    """
    gone = jaccard_components(docs, id_col, text_col, k, percent).where("component_id < doc_id").select(F.col("doc_id").alias("_dropped")).distinct()
    gone = written(gone)
    few = gone.count() <= BROADCAST_IDS
    return docs.join(F.broadcast(gone) if few else gone, docs[id_col].cast("long") == gone["_dropped"], "left_anti")
