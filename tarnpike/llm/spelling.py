"""Spelling variants: words one edit apart, by merging the subtrees of a trie with one character skipped or replaced.

Two words one edit apart part at one node of the trie of all words: beyond it they agree once a character of one is skipped, or the
characters of both are replaced. So at every node its children's subtrees are merged with that one error, and words that end in the same
place are a pair.

*Below the cut*, subtrees are small. A task sorts their words, finds the branching nodes and their heavy children by common prefixes, and
merges the light children into the heavy one: each word of a light subtree is looked up with its character skipped, replaced by the heavy
one, or with the heavy one put before it; light subtrees that agree with their characters replaced coincide with each other. A word
is in at most log2(n) light subtrees, so that this is O(n log n) lookups by hashes of prefixes and suffixes, each then compared in full.

*Above the cut*, a subtree has too many words for a task and the merge is a shuffle: by the word with one place left open, which at most one
word for each character of the alphabet has, and by the word with a character skipped.

Nodes above the cut are those of more than ``most`` words, and ``most`` grows with the number of words, so that at each depth there are no more than
ABOVE of them, whatever the input; they go to all tasks.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import ready, released, written

#: words in a subtree below the cut, at least allowed; nodes above the cut at one depth, at most; depth of the cut, at least
MOST, ABOVE, SHALLOW = 2_000, 20_000, 2
#: distinct words that a counting task holds; words that one numpy pass merges, about
HELD, TOGETHER = 300_000, 20_000
#: roots that are told to all tasks; beyond, they are joined by shuffle
BROADCAST_FORMS = 200_000

_LOWER = bytes(range(0x41)) + bytes(range(0x61, 0x7B)) + bytes(range(0x5B, 0x100))
_OPEN = "\0"  # no letter


def _counted(letters: str, least: int, modulus: int):
    """(word, n): how often each word occurs, with a run's character deleted where its checksum says so."""
    runs = re.compile(f"[{letters}]{{{least},}}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, int] = {}

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not text:
                    continue
                seed = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                for word, n in Counter(runs.findall(text.encode().translate(_LOWER).decode())).items():
                    h = zlib.crc32(word.encode(), seed)
                    if h % modulus == 0:
                        at = h % len(word)
                        word = word[:at] + word[at + 1 :]
                        if len(word) < least:
                            continue
                    counts[word] = counts.get(word, 0) + n
                if len(counts) > HELD:
                    yield out()
                    counts.clear()
        yield out()

    return run


def word_counts(docs: DataFrame, least_length: int = 5, least_count: int = 3, modulus: int = 97, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n) of the words that occur ``least_count`` times or more.

    Words are whole runs of A-Z, a-z and U+00C0 to U+00FF, A-Z lower-cased, of ``least_length`` characters or more. Where ``modulus`` divides the crc32 of
    ``<id>:<run>``, the run has first lost its character number crc32 % length. Null texts have no words; a null id is an empty one; repeated rows count each.
    """
    ready(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    found = rows.mapInArrow(_counted("a-zÀ-ÿ", least_length, modulus), "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


# the trie below the cut ---------------------------------------------------------------------------------------------


_B = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_B), -1, 1 << 64))


def _mixed(h: np.ndarray, length: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = h + length.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
        return x ^ (x >> np.uint64(29))


class _Words:
    """Sorted distinct words with hashes of all their prefixes: the sum of (c + 1) B^i over characters c at places i."""

    def __init__(self, words: list[str]):
        self.words = words
        self.length = np.array([len(w) for w in words], np.int64)
        self.at = np.cumsum(self.length) - self.length
        self.codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        place = np.arange(len(self.codes)) - np.repeat(self.at, self.length)
        with np.errstate(over="ignore"):
            self.powers = np.cumprod(np.append(np.uint64(1), np.full(int(self.length.max(initial=0)) + 1, _B)), dtype=np.uint64)
            self.sums = np.append(np.uint64(0), np.cumsum((self.codes.astype(np.uint64) + np.uint64(1)) * self.powers[place], dtype=np.uint64))
            self.whole = self.sums[self.at + self.length] - self.sums[self.at]
        keys = _mixed(self.whole, self.length)
        self.order = np.argsort(keys)
        self.keys = keys[self.order]

    def prefix(self, word: np.ndarray, d: np.ndarray) -> np.ndarray:
        return self.sums[self.at[word] + d] - self.sums[self.at[word]]

    def code(self, word: np.ndarray, d: np.ndarray) -> np.ndarray:
        """The character at place d, 0 beyond the end."""
        inside = d < self.length[word]
        return np.where(inside, self.codes[np.minimum(self.at[word] + d, len(self.codes) - 1)], 0)

    def find(self, h: np.ndarray, length: np.ndarray) -> np.ndarray:
        """The number of the word of a hash and length, -1 for none."""
        key = _mixed(h, length)
        i = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[i] == key, self.order[i], -1)

    def common(self) -> np.ndarray:
        """The length of the common prefix of each word and the one before; 0 for the first."""
        out = np.zeros(len(self.words), np.int64)
        n = np.minimum(self.length[1:], self.length[:-1])
        total = int(n.sum())
        if total:
            start = np.cumsum(n) - n
            step = np.arange(total) - np.repeat(start, n)
            differs = self.codes[np.repeat(self.at[1:], n) + step] != self.codes[np.repeat(self.at[:-1], n) + step]
            has = np.flatnonzero(n)
            out[1:][has] = np.minimum.reduceat(np.where(differs, step, np.repeat(n, n)), start[has])
        return out


def _branching(common: np.ndarray) -> Iterator[tuple[int, list[int]]]:
    """(depth, bounds of the children) of the trie's branching nodes; a word that ends at a node is its first child."""
    stack: list[tuple[int, list[int]]] = []
    heights = common.tolist()
    for i in range(1, len(heights) + 1):
        h = heights[i] if i < len(heights) else -1
        left = i - 1
        while stack and stack[-1][0] > h:
            d, bounds = stack.pop()
            bounds.append(i)
            yield d, bounds
            left = bounds[0]
        if stack and stack[-1][0] == h:
            stack[-1][1].append(i)
        elif h >= 0:
            stack.append((h, [left, i]))


def _light(w: _Words, cut: np.ndarray) -> tuple[np.ndarray, ...]:
    """(word, node, depth, heavy child's character) for every word of every light subtree below the cut."""
    first, last, node, depth, heavy = [], [], [], [], []
    for number, (d, bounds) in enumerate(_branching(w.common())):
        if d < cut[bounds[0]]:
            continue
        ends_here = int(w.length[bounds[0]] == d)
        sizes = [b - a for a, b in zip(bounds, bounds[1:], strict=False)]
        chosen = max(range(ends_here, len(sizes)), key=sizes.__getitem__)
        for i in range(len(sizes)):
            if i != chosen:
                first.append(bounds[i])
                last.append(bounds[i + 1])
                node.append(number)
                depth.append(d)
                heavy.append(bounds[chosen])
    first, n = np.array(first, np.int64), np.array(last, np.int64) - np.array(first, np.int64)
    spread = lambda x: np.repeat(np.array(x, np.int64), n)
    word = np.repeat(first, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    d = spread(depth)
    return word, spread(node), d, w.code(spread(heavy), d).astype(np.uint64)


def _edited(word: str, d: int, take: int, put: str) -> str:
    return word[:d] + put + word[d + take :]


def merged_pairs(words: list[str], cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pairs (a, b) of sorted distinct words one edit apart that part at or below the cut of their words, each once."""
    if len(words) < 2:
        none = np.zeros(0, np.int64)
        return none, none
    w = _Words(words)
    x, node, d, heavy = _light(w, cut)
    n, h = w.length[x], w.whole[x]
    ends = d == n
    own = w.code(x, d).astype(np.uint64)
    found = []
    with np.errstate(over="ignore"):
        one = np.uint64(1)
        before, power = w.prefix(x, d), w.powers[d]
        upto = np.where(ends, before, before + (own + one) * power)  # with the character at d
        put = (heavy + one) * power
        # skipped: the last one of equal characters, which is where the two words part
        tries = [(before + (h - upto) * _INVERSE, n - 1, ~ends & (own != w.code(x, d + 1)), 1, False)]
        tries.append((before + put + (h - upto), n, ~ends, 1, True))
        tries.append((before + put + (h - before) * _B, n + 1, np.ones(len(x), bool), 0, True))
        for key, length, on, take, with_heavy in tries:
            hit = np.where(on, w.find(key, length), -1)
            for i in np.flatnonzero(hit >= 0).tolist():
                if words[hit[i]] == _edited(words[x[i]], d[i], take, chr(heavy[i]) if with_heavy else ""):
                    found.append((x[i], hit[i]))
        # light subtrees of one node that agree beyond the replaced characters
        rest = np.where(ends, 0, h - upto)
        order = np.lexsort((rest, n, node))
        order = order[~ends[order]]
    same = (node[order[1:]] == node[order[:-1]]) & (n[order[1:]] == n[order[:-1]]) & (rest[order[1:]] == rest[order[:-1]])
    groups = np.cumsum(np.append(True, ~same)) if len(order) else np.zeros(0, np.int64)
    for g in np.unique(groups[1:][same]).tolist():
        members = order[np.searchsorted(groups, g) : np.searchsorted(groups, g, "right")].tolist()
        for i, a in enumerate(members):  # at most one for each character of the alphabet
            for b in members[i + 1 :]:
                if words[x[a]][d[a] + 1 :] == words[x[b]][d[b] + 1 :]:
                    found.append((x[a], x[b]))
    pairs = np.array(found, np.int64).reshape(-1, 2)
    return pairs[:, 0], pairs[:, 1]


def _nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n_near, best) from pairs below the cut: rows (head, cut, word, n) sorted by word, whole subtrees at a time."""
    heads: list[str] = []
    rows: list[tuple[int, str, int]] = []

    def out(upto: int) -> pa.RecordBatch:
        cut, words, n = zip(*rows[:upto], strict=True)
        a, b = merged_pairs(list(words), np.array(cut))
        counts = np.array(n, np.int64)
        own, near = np.concatenate([a, b]), np.concatenate([b, a])
        order = np.lexsort((near, -counts[near], own))  # words are sorted, so their numbers are their order
        own, near = own[order], near[order]
        first = np.flatnonzero(np.append(True, own[1:] != own[:-1])) if len(own) else np.zeros(0, np.int64)
        best = near[first]
        return pa.RecordBatch.from_arrays(
            [pa.array([words[i] for i in own[first]], pa.string()), pa.array(np.diff(np.append(first, len(own))), pa.int64()), pa.array(-counts[best], pa.int64()), pa.array([words[i] for i in best], pa.string())],
            ["word", "n_near", "less", "form"],
        )

    for batch in batches:
        for head, cut, word, n in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if len(rows) >= TOGETHER and head != heads[-1]:
                yield out(len(rows))
                heads, rows = [], []
            heads.append(head)
            rows.append((cut, word, n))
    if rows:
        yield out(len(rows))


# above the cut ------------------------------------------------------------------------------------------------------


def _above(words: DataFrame, most: int) -> list[str]:
    """The prefixes, shorter than all others at least SHALLOW, with more than ``most`` words."""
    nodes: list[str] = []
    depth, at = SHALLOW, words
    while True:
        prefix = F.substring("word", 1, depth)
        large = at.where(F.char_length("word") >= depth).groupBy(prefix.alias("p")).agg(F.count("*").alias("n")).where(F.col("n") > most)
        found = [r.p for r in large.collect()]  # fewer than ABOVE, as most > words / ABOVE
        if not found:
            return nodes
        nodes += found
        at = at.where(prefix.isin(found)) if len(found) < 100 else at.join(F.broadcast(words.sparkSession.createDataFrame([(p,) for p in found], "p string")), prefix == F.col("p"), "left_semi")
        depth += 1


def _cut(word: str, above) -> int:
    """The depth of the first node on the way of a word that is below the cut; one more than its length if there is none."""
    d = SHALLOW
    while d <= len(word) and word[:d] in above:
        d += 1
    return d


def _dealt(nodes):
    """(head, cut, word, n): the subtree that each word is in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        above = frozenset(nodes.value)
        for batch in batches:
            words = batch.column(0).to_pylist()
            cuts = [_cut(w, above) for w in words]
            yield pa.RecordBatch.from_arrays([pa.array([w[:d] for w, d in zip(words, cuts, strict=True)], pa.string()), pa.array(cuts, pa.int32()), *batch.columns], ["head", "cut", "word", "n"])

    return run


def _upper(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, skips, word, n): a word with each place above its cut left open, and skipped where the word parts from what is left."""
    for batch in batches:
        key, skips, word, n = [], [], [], []
        for cut, w, m in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
            for d in range(min(cut, len(w))):
                rest = w[d + 1 :]
                key.append(w[:d] + _OPEN + rest)
                skips.append(False)
                if rest[:1] != w[d]:
                    key.append(w[:d] + rest)
                    skips.append(True)
            word += [w] * (len(key) - len(word))
            n += [m] * (len(key) - len(n))
        yield pa.RecordBatch.from_arrays([pa.array(key, pa.string()), pa.array(skips, pa.bool_()), pa.array(word, pa.string()), pa.array(n, pa.int64())], ["key", "skips", "word", "n"])


def near_words(counted: DataFrame, most: int | None = None) -> DataFrame:
    """(word, n_near, form, form_n) of the words in ``counted`` (word, n; distinct) that have any word one character inserted, deleted or
    replaced away: how many, and the one of largest n, of equal ones the first in order of code points.

    Null words are left out; an empty table gives an empty result.
    """
    spark = ready(counted.sparkSession)
    words = written(counted.where("word is not null").select("word", F.col("n").cast("long").alias("n")))
    total = words.count()
    most = max(MOST, total // ABOVE) if most is None else most
    nodes = spark.sparkContext.broadcast(_above(words, most))
    dealt = written(words.mapInArrow(_dealt(nodes), "head string, cut int, word string, n long"))
    below = dealt.repartition("head").sortWithinPartitions("word").mapInArrow(_nearest, "word string, n_near long, less long, form string")
    below = below.select("word", "n_near", F.struct("less", "form").alias("best"))

    upper = written(dealt.mapInArrow(_upper, "key string, skips boolean, word string, n long"))
    # an open place: at most one word for each character; a word's best one is the group's first, or its second for the first itself
    best = lambda n, word: F.struct((-F.col(n)).alias("less"), F.col(word).alias("form"))
    alike = upper.where("not skips").groupBy("key").agg(F.sort_array(F.collect_list(best("n", "word"))).alias("members")).where(F.size("members") > 1)
    replaced = alike.select("members", F.explode("members").alias("own")).select(
        F.col("own.form").alias("word"), (F.size("members") - 1).cast("long").alias("n_near"),
        F.when(F.col("own") == F.col("members")[0], F.col("members")[1]).otherwise(F.col("members")[0]).alias("best"),
    )
    links = written(upper.where("skips").join(words.select(F.col("word").alias("key"), F.col("n").alias("key_n")), "key"))
    skipped = links.select("word", F.lit(1).cast("long").alias("n_near"), best("key_n", "key").alias("best")).unionByName(links.select(F.col("key").alias("word"), F.lit(1).cast("long").alias("n_near"), best("n", "word").alias("best")))
    found = below.unionByName(replaced).unionByName(skipped).groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))
    out = written(found.select("word", "n_near", F.col("best.form").alias("form"), (-F.col("best.less")).alias("form_n")))
    released(words, dealt, upper, links)
    return out


def spelling_groups(docs: DataFrame, ratio: int = 2, **options) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of ``word_counts``; ``options`` are its.

    ``form`` is the near word of ``near_words`` if it occurs ``ratio`` times as often or more, else null, as is its n; ``root`` is the last word that forms lead
    to, the word itself if it has none. Forms occur more often than their words, so that they never lead in a circle, and only log2 of the largest n
    of them follow each other. An empty table gives an empty result.
    """
    counted = written(word_counts(docs, **options))
    near = near_words(counted)
    known = counted.join(near, "word", "left")
    taken = F.col("form_n") >= ratio * F.col("n")
    forms = written(known.select("word", F.when(taken, F.col("form")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(taken, F.col("form_n")).alias("form_n")))
    roots = written(forms.where("form is not null").select("word", F.col("form").alias("root")))
    few = roots.count() <= BROADCAST_FORMS
    while True:  # each round doubles the way
        up = roots.select(F.col("word").alias("root"), F.col("root").alias("up"))
        further = written(roots.join(F.broadcast(up) if few else up, "root", "left").select("word", F.coalesce("up", "root").alias("root"), F.col("up").isNotNull().alias("moved")))
        moved = further.where("moved").limit(1).count()
        released(roots)
        roots = further
        if not moved:
            break
    ends = further.select("word", "root")
    return forms.join(F.broadcast(ends) if few else ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
