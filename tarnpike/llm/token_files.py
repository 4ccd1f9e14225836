"""Token ids as binary files: documents in order of id, coded with Simple-8b, in blocks that decode on their own.

``write_tokens`` deals documents by ranges of their ids and sorts them; a task encodes and codes its documents in order and joins their
words into blocks. Files are Parquet, which Spark's committer writes once even if executors are lost, on any
file system that Spark knows; a row is a block:

    shard int, block int      shards and their blocks in order are the order of the documents
    first long                ids of the shard before this block
    n_ids long                ids in the block
    payload binary            little-endian: b"S8B1", counts of documents, words, escapes (3 x uint32); then
                              ids of documents (int64), flags of null ids (uint8, filled up to 8), tokens, words and escapes of documents (uint32 each, filled up to 8),
                              offsets: ids and escapes before each run of STRIDE words (2 x uint32), words (uint64), escapes (uint64)

A document's ids are found from its counts of words; the offsets give any run of words without those before it.
"""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from itertools import chain, compress, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import simple8b
from ._shared import own_folder, ready

MAGIC = b"S8B1"
#: words between two offsets of a block; bytes of words in a block, about
STRIDE, BLOCK_BYTES = 1_024, 1 << 20
#: words, and runs between spaces, that a worker keeps, and the longest of them; texts whose runs are looked up together, in characters, and runs coded at once
CACHED, LONGEST, TOGETHER, AT_ONCE = 600_000, 64, 1 << 23, 1 << 18

#: words, digits and other signs of lower-cased texts below U+0100: what the tokenizer's own pattern finds there
_LATIN = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼½¾]|[^\\t-\\r \\x85\\xa0a-zªµºß-öø-ÿ0-9²³¹¼½¾]+")
#: signs that often end a word, and are a pre-token of their own there
_SIGNS = frozenset(",.;:!?|)")
#: the code point that byte-level models have for each byte: its own if it prints, else the next from 256 on
_SIGN_OF = np.arange(256, dtype="<u4")
_unprinted = [*range(0x21), *range(0x7F, 0xA1), 0xAD]
_SIGN_OF[_unprinted] = 256 + np.arange(len(_unprinted))
_SIGN_OF[0x20] = 0x20
#: fixed values: the normaliser and the splitter that this pattern stands for
_NORMAL = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
_SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


def splits_into_words(definition: dict) -> bool:
    """Whether a tokenizer encodes words apart: lower-cased, without white space, each with a mark at its end."""
    normal, pre, model = (definition.get(x) or {} for x in ("normalizer", "pre_tokenizer", "model"))
    first, *rest = pre.get("pretokenizers", [{}])
    split = first.get("type") == "Split" and first.get("pattern") == {"Regex": _SPLIT} and first.get("behavior") == "Removed" and first.get("invert") is True
    bytes_ = [x.get("type") for x in rest] == ["ByteLevel"] and not rest[0].get("add_prefix_space") and not rest[0].get("use_regex", True)
    added = all(not re.search(r"\s", x["content"]) and not (x["lstrip"] or x["rstrip"] or x["single_word"]) for x in definition.get("added_tokens", []))
    return normal.get("normalizers") == _NORMAL and split and bytes_ and added and model.get("type") == "BPE" and model.get("end_of_word_suffix") == "</w>" and not model.get("dropout")


class _Encoder:
    """The ids of whole texts by the tokenizer's library. Where words are encoded apart, the library sees each distinct word once while a worker keeps it."""

    _kept: tuple[str, _Encoder] | None = None

    def __init__(self, raw: str, by_word: bool, special: list[str]):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are what runs side by side
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        self.tokenizer, self.by_word, self.special = Tokenizer.from_str(raw), by_word, special
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.known: dict[str, int] = {}  #: rows of words, and of runs of some between spaces, in the arrays below
        self.pieces, self.starts, self.lengths, self.met = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        if by_word:
            # words that are split, in lower case and in the signs for bytes already need the model alone
            self.plain = Tokenizer(self.tokenizer.model)
            self.plain.pre_tokenizer = WhitespaceSplit()
            vocabulary = self.tokenizer.get_vocab()
            self.ends = np.zeros(1 + max(vocabulary.values(), default=0), bool)
            self.ends[[i for x, i in vocabulary.items() if x.endswith("</w>")]] = True

    @classmethod
    def of(cls, key: str, shared) -> _Encoder:
        if cls._kept is None or cls._kept[0] != key:
            cls._kept = key, cls(*shared.value)
        return cls._kept[1]

    def _whole(self, texts: list[str], tokenizer=None) -> list[np.ndarray]:
        encode = (tokenizer or self.tokenizer).encode_batch_fast
        return [np.array(x.ids, np.uint32) for i in range(0, len(texts), 64) for x in encode(texts[i : i + 64], add_special_tokens=False)]

    def _apart(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids one after another, ids of each) of distinct words, many encoded in one text that is cut after the pieces that end words."""
        ids, sizes = [], []
        parts = [words[i : i + 300] for i in range(0, len(words), 300)]
        texts = [" ".join(p) for p in parts]
        for part, held in zip(parts, self._whole([x if x.isascii() and x.isprintable() else _as_signs(x) for x in texts], self.plain), strict=True):
            cuts = np.flatnonzero(self.ends[held]) + 1
            if len(cuts) == len(part) and cuts[-1] == len(held):
                ids.append(held)
                sizes.append(np.diff(cuts, prepend=0))
            else:  # a word with a piece that ends words inside it
                held, n = self._joined(self._whole(part))
                ids.append(held)
                sizes.append(n)
        return (np.concatenate(ids), np.concatenate(sizes)) if ids else self._joined([])

    def _keep(self, names: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        """New rows of names that are not known."""
        self.known.update(zip(names, range(len(self.starts), len(self.starts) + len(names)), strict=True))
        self.starts = np.append(self.starts, len(self.pieces) + np.cumsum(sizes) - sizes)
        self.pieces, self.lengths, self.met = np.append(self.pieces, ids), np.append(self.lengths, sizes), np.append(self.met, np.zeros(len(names), np.int64))

    def _of_rows(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids one after another, ids of each) of rows."""
        starts, sizes = self.starts[rows], self.lengths[rows]
        before = np.cumsum(sizes) - sizes
        return self.pieces[np.repeat(starts - before, sizes) + np.arange(int(sizes.sum()))], sizes

    def _rows(self, names: Iterable[str]) -> np.ndarray:
        return np.fromiter(map(self.known.__getitem__, names), np.int64)

    def _learn(self, runs: list[str]) -> list[str]:
        """Keep the ids of runs between spaces, of their words if they are plain, else of the whole run; and of those words. Returns what is new."""
        words, other = [], []
        compound, parts, sizes = [], [], []  # runs, their words one after another, words of each
        for x in runs:
            if not (x.isascii() or _below(x)):
                other.append(x)
            elif x.isalpha() and x.islower():
                words.append(x)
            elif x[-1:] in _SIGNS and x[:-1].isalpha() and x[:-1].islower():
                compound.append(x)
                parts.append(x[:-1])
                parts.append(x[-1])
                sizes.append(2)
            elif (found := _LATIN.findall(x.lower())) == [x]:
                words.append(x)
            else:
                compound.append(x)
                parts.extend(found)
                sizes.append(len(found))
        words.extend(set(parts).difference(self.known, words))
        self._keep(words, *self._apart(words))
        ids, n = self._of_rows(self._rows(parts))
        self._keep(compound, ids, np.diff(np.append(0, np.cumsum(n))[np.cumsum([0, *sizes])]))
        self._keep(other, *self._joined(self._whole(other)))
        return words + compound + other

    def _forget(self) -> None:
        """Where much is kept, keep what was met in most batches of texts, at most half of it."""
        if len(self.known) <= CACHED and len(self.pieces) <= 16 * CACHED:
            return
        names, rows = list(self.known), np.fromiter(self.known.values(), np.int64, len(self.known))
        met, least = self.met[rows], 2
        while (stays := met >= least).sum() > CACHED // 2:
            least *= 2
        ids, sizes = self._of_rows(rows[stays])
        if len(ids) > 8 * CACHED:
            stays[:], ids, sizes = False, ids[:0], sizes[:0]
        names = list(compress(names, stays.tolist()))
        self.known, self.pieces, self.starts, self.lengths, self.met = {}, *(x[:0] for x in (self.pieces, self.starts, self.lengths, self.met))
        self._keep(names, ids, sizes)
        self.met = met[stays] // 2  # of late counts more

    def ids(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(ids one after another, ids of each text) of some texts at a time, in order."""
        if not self.by_word:
            yield self._joined(self._whole(texts))
            return
        # plain texts in lower case; others keep theirs: the library lowers each run, which may have marks to be composed first
        special = [i for i, t in enumerate(texts) if any(x in t for x in self.special)]
        held = [t.lower() if t.isascii() or _below(t) else t for t in texts]
        for i in special:
            held[i] = ""
        split = pc.split_pattern(pc.replace_substring(pa.array(held, pa.string()), "\n", " "), " ")
        coded = split.flatten().dictionary_encode()
        runs, place = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), np.asarray(coded.indices)
        self._forget()
        rows = np.fromiter(map(self.known.get, runs, repeat(-1)), np.int64, len(runs))
        if len(new := np.flatnonzero(rows < 0)):
            unknown = [runs[i] for i in new.tolist()]
            learnt = self._learn(unknown)
            rows[new] = self._rows(unknown)
            for x in learnt:
                if len(x) > LONGEST:
                    self.known.pop(x, None)
        self.met[rows] += 1
        edges = np.asarray(split.offsets) - split.offsets[0].as_py()
        a = 0
        while a < len(texts):
            b = max(a + 1, int(np.searchsorted(edges, edges[a] + AT_ONCE, side="right")) - 1)
            ids, lengths = self._of_rows(rows[place[edges[a] : edges[b]]])
            sizes = np.diff(np.append(0, np.cumsum(lengths))[edges[a : b + 1] - edges[a]])
            if own := [i for i in special if a <= i < b]:
                parts = np.split(ids, np.cumsum(sizes)[:-1])
                for i in own:
                    parts[i - a] = self._whole([texts[i]])[0]
                ids, sizes = self._joined(parts)
            yield ids, sizes
            a = b

    @staticmethod
    def _joined(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        return np.concatenate([np.zeros(0, np.uint32), *parts]), np.array(list(map(len, parts)), np.int64)


def _as_signs(text: str) -> str:
    """A text's bytes as the signs that byte-level models have for them; spaces stay."""
    return _SIGN_OF[np.frombuffer(text.encode(), np.uint8)].tobytes().decode("utf-32-le")


def _below(text: str) -> bool:
    """Whether all characters are below U+0100, where normal forms compose nothing and lower case stays in place."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[str]]]:
    """Ids and texts of about TOGETHER characters, across batches."""
    ids, texts, size = [], [], 0
    for batch in batches:
        for i, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            ids.append(i)
            texts.append(x or "")
            size += len(texts[-1])
            if size > TOGETHER:
                yield ids, texts
                ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def _filled(x: bytes) -> bytes:
    return x + bytes(-len(x) % 8)


def _payload(ids: list, n_ids: list[int], words: list[bytes], escapes: list[bytes]) -> bytes:
    all_words = np.frombuffer(b"".join(words), np.uint64)
    held = simple8b.counts(all_words)
    is_escape = all_words == (np.uint64(15) << np.uint64(60)) | simple8b.ESCAPE
    before = np.stack([np.cumsum(held) - held, np.cumsum(is_escape) - is_escape], 1)[::STRIDE]
    per = np.array([n_ids, [len(x) // 8 for x in words], [len(x) // 8 for x in escapes]], "<u4")
    parts = [
        MAGIC, np.array([len(ids), len(all_words), is_escape.sum()], "<u4").tobytes(), np.array([x or 0 for x in ids], "<i8").tobytes(), _filled(bytes(x is None for x in ids)),
        _filled(per.tobytes()), before.astype("<u4").tobytes(), all_words.astype("<u8").tobytes(), *escapes,
    ]
    return b"".join(parts)


class Block:
    """A block's payload: documents, and their ids wholly or by runs of words."""

    def __init__(self, payload: bytes):
        if payload[:4] != MAGIC:
            raise ValueError("no block of token ids")
        n, m, e = (int(x) for x in np.frombuffer(payload, "<u4", 3, 4))
        at = 16
        self.doc_ids = np.frombuffer(payload, "<i8", n, at)
        at += 8 * n
        self.null = np.frombuffer(payload, np.uint8, n, at).astype(bool)
        at += n + -n % 8
        self.n_ids, self.n_words, self.n_escapes = np.frombuffer(payload, "<u4", 3 * n, at).reshape(3, n).astype(np.int64)
        at += 12 * n + -(12 * n) % 8
        runs = -(-m // STRIDE)
        self.offsets = np.frombuffer(payload, "<u4", 2 * runs, at).reshape(runs, 2).astype(np.int64)
        at += 8 * runs
        self.words = np.frombuffer(payload, "<u8", m, at)
        self.escapes = np.frombuffer(payload, "<u8", e, at + 8 * m)

    def ids(self) -> np.ndarray:
        """All ids of the block."""
        return simple8b.unpack(self.words, self.escapes)

    def run(self, number: int) -> tuple[int, np.ndarray]:
        """(ids of the block before, ids) of one run of STRIDE words, from its offset alone."""
        first, escaped = self.offsets[number]
        return int(first), simple8b.unpack(self.words[number * STRIDE : (number + 1) * STRIDE], self.escapes[escaped : self.offsets[number + 1][1] if number + 1 < len(self.offsets) else None])

    def document(self, number: int) -> np.ndarray:
        """The ids of one document, without decoding others."""
        a, b = (int(self.n_words[: number + i].sum()) for i in (0, 1))
        c, d = (int(self.n_escapes[: number + i].sum()) for i in (0, 1))
        return simple8b.unpack(self.words[a:b], self.escapes[c:d])


def _blocks(key: str, shared, end_id: int | None, block_bytes: int):
    """Sorted documents of a task, encoded, coded and joined into blocks of about ``block_bytes`` of words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _Encoder.of(key, shared)
        shard, block, first = TaskContext.get().partitionId(), 0, 0
        held: list[tuple] = []
        size = 0

        def out() -> pa.RecordBatch:
            ids, n_ids, words, escapes = zip(*held, strict=True)
            return pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int32()), pa.array([block], pa.int32()), pa.array([first], pa.int64()), pa.array([sum(n_ids)], pa.int64()), pa.array([_payload(ids, n_ids, words, escapes)], pa.binary())],
                ["shard", "block", "first", "n_ids", "payload"],
            )

        for doc_ids, texts in _together(batches):
            at = 0
            for ids, sizes in encoder.ids(texts):
                own = doc_ids[at : at + len(sizes)]
                at += len(sizes)
                if end_id is not None:
                    ids = np.insert(ids, np.cumsum(sizes), end_id)
                    sizes = sizes + 1
                words, n_words, escapes, n_escapes = simple8b.pack(ids, sizes)
                cut = lambda x, n: [x[j - m : j].tobytes() for j, m in zip(np.cumsum(n).tolist(), n.tolist(), strict=True)]
                for row in zip(own, sizes.tolist(), cut(words, n_words), cut(escapes, n_escapes), strict=True):
                    held.append(row)
                    size += len(row[2])
                    if size >= block_bytes or len(held) >= 1 << 16:
                        done = out()
                        yield done
                        block, first = block + 1, first + done.column(3)[0].as_py()
                        held, size = [], 0
        if held:
            yield out()

    return run


def write_tokens(docs: DataFrame, tokenizer_path: str, folder: str, end_id: int | None = None, id_col: str = "doc_id", text_col: str = "text", shards: int | None = None, block_bytes: int = BLOCK_BYTES) -> None:
    """Write the ids of every text, as the tokenizers library gives them for the whole text without special tokens, followed by ``end_id``,
    to ``folder`` in ascending order of ids, in ``shards`` ranges (by default those of a shuffle). Rows with one id follow each other in order of a hash of
    their texts; null ids come last.

    A null text counts as empty. Other columns are ignored. An empty table gives files without blocks. The folder must not exist.
    Repeated rows of one id and text are told apart by their places in the table, so that they are no group of their own; each attempt of a task has to read them in the same
    order, as from files: write a table down that comes from a shuffle.
    """
    spark = ready(docs.sparkSession)
    with open(tokenizer_path, encoding="utf-8") as f:
        raw = f.read()
    definition = json.loads(raw)
    shared = spark.sparkContext.broadcast((raw, splits_into_words(definition), [x["content"] for x in definition.get("added_tokens", [])]))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.monotonically_increasing_id().alias("_row"))
    order = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text"), F.col("_row")]
    dealt = rows.repartitionByRange(*([shards] if shards else []), *order).sortWithinPartitions(*order).select("doc_id", "text")
    blocks = dealt.mapInArrow(_blocks(uuid.uuid4().hex, shared, end_id, block_bytes), "shard int, block int, first long, n_ids long, payload binary")
    blocks.write.parquet(folder)


def token_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """Blocks of written files with ``start``, the ids of all blocks before."""
    files = ready(spark).read.schema("shard int, block int, first long, n_ids long, payload binary").parquet(folder)
    totals = files.groupBy("shard").agg(F.sum("n_ids").alias("n")).collect()  # one row a shard, as many as the writer had tasks
    before, starts = 0, []
    for r in sorted(totals, key=lambda r: r.shard):
        starts.append((r.shard, before))
        before += r.n
    return files.join(F.broadcast(spark.createDataFrame(starts, "shard int, base long")), "shard").select("shard", "block", (F.col("base") + F.col("first")).alias("start"), "n_ids", "payload")


def _documents(with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                block = Block(payload)
                ids = block.ids()
                ends = np.cumsum(block.n_ids)
                found = [pa.array(block.doc_ids, pa.int64(), mask=block.null), pa.array(start + ends - block.n_ids), pa.array(block.n_ids)]
                if with_ids:
                    offsets = pa.array(np.append(0, ends), pa.int32())
                    yield pa.RecordBatch.from_arrays([*found, pa.ListArray.from_arrays(offsets, pa.array(ids.astype(np.int64)))], ["doc_id", "start", "n_tokens", "ids"])
                else:
                    plain = ids.astype("<u4").tobytes()
                    crc = [zlib.crc32(plain[4 * (b - n) : 4 * b]) for b, n in zip(ends.tolist(), block.n_ids.tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([*found, pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return run


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document in written files."""
    return token_blocks(spark, folder).select("start", "payload").mapInArrow(_documents(True), "doc_id long, start long, n_tokens long, ids array<long>")


def token_digests(docs: DataFrame, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every row, from files written to the shared folder and read back.

    ``start`` counts the ids of all documents before in ascending order of ids; the checksum is over 32-bit little-endian ids. See ``write_tokens``
    for nulls, repeated rows and empty tables.
    """
    spark = ready(docs.sparkSession)
    folder = own_folder(spark)
    write_tokens(docs, tokenizer_path, folder, end_id, id_col, text_col)
    return token_blocks(spark, folder).select("start", "payload").mapInArrow(_documents(False), "doc_id long, start long, n_tokens long, ids_crc32 long")
