"""Media columns: ISO base media files (ISO/IEC 14496-12) as binary columns.

``media_columns`` walks the nested boxes of each file, decodes the sample tables of its tracks and keeps codec,
duration and the byte ranges of keyframes; payload bytes are skipped, never decoded. ``texts_to_media`` stores texts
losslessly as such files, 8-bit samples in one track, and ``stored_payload`` reads the samples back by the tables.
"""

from __future__ import annotations

import bisect
import hashlib
import json
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import ready

#: bytes of a sample; samples in a chunk; each so many samples one is marked as a keyframe
SAMPLE, CHUNK, KEY_EVERY = 192, 16, 8
TIMESCALE, PER_SAMPLE = 8000, 192  #: 8-bit mono at 8 kHz: one byte is one tick
DEEPEST = 32  #: levels of boxes that are followed
CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"mvex", b"moof", b"traf"}


def _box(kind: bytes, *body: bytes) -> bytes:
    size = 8 + sum(map(len, body))
    if size >> 32:
        return struct.pack(">I4sQ", 1, kind, size + 8) + b"".join(body)
    return struct.pack(">I4s", size, kind) + b"".join(body)


def _full(kind: bytes, *body: bytes, flags: int = 0, version: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", version << 24 | flags), *body)


_MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
_FTYP = _box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2")
_DINF = _box(b"dinf", _full(b"dref", struct.pack(">I", 1), _full(b"url ", flags=1)))
_STSD = _full(b"stsd", struct.pack(">I", 1), _box(b"raw ", bytes(6), struct.pack(">H8xHHHHI", 1, 1, 8, 0, 0, TIMESCALE << 16)))
_HDLR = _full(b"hdlr", struct.pack(">I4s12x", 0, b"soun"), b"samples\0")


def write_media(payload: bytes) -> bytes:
    """A file with ``payload`` (a positive multiple of SAMPLE bytes) as 8-bit samples of one raw audio track."""
    n = len(payload) // SAMPLE
    chunks = -(-n // CHUNK)
    last = n - (chunks - 1) * CHUNK
    runs = [(1, CHUNK), (chunks, last)] if chunks > 1 and last != CHUNK else [(1, last if chunks == 1 else CHUNK)]
    keys = range(1, n + 1, KEY_EVERY)
    ticks = n * PER_SAMPLE
    head = b""
    first = 0
    for _ in range(2):  # the offsets of chunks follow from the size of what stands before
        offsets = [first + i * CHUNK * SAMPLE for i in range(chunks)]
        wide = first + len(payload) >= 1 << 32
        stbl = _box(
            b"stbl", _STSD,
            _full(b"stts", struct.pack(">III", 1, n, PER_SAMPLE)),
            _full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", a, b, 1) for a, b in runs)),
            _full(b"stsz", struct.pack(">II", SAMPLE, n)),
            _full(b"co64" if wide else b"stco", struct.pack(">I", chunks), struct.pack(f">{chunks}{'Q' if wide else 'I'}", *offsets)),
            _full(b"stss", struct.pack(">I", len(keys)), struct.pack(f">{len(keys)}I", *keys)),
        )
        minf = _box(b"minf", _full(b"smhd", bytes(4)), _DINF, stbl)
        mdhd = _full(b"mdhd", struct.pack(">QQIQHH", 0, 0, TIMESCALE, ticks, 0x55C4, 0), version=1)
        tkhd = _full(b"tkhd", struct.pack(">QQIIQ8xHHHH", 0, 0, 1, 0, ticks, 0, 0, 0x100, 0), _MATRIX, bytes(8), version=1, flags=7)
        mvhd = _full(b"mvhd", struct.pack(">QQIQIH10x", 0, 0, TIMESCALE, ticks, 0x10000, 0x100), _MATRIX, bytes(24), struct.pack(">I", 2), version=1)
        moov = _box(b"moov", mvhd, _box(b"trak", tkhd, _box(b"mdia", mdhd, _HDLR, minf)))
        head = _FTYP + moov + (struct.pack(">I4s", len(payload) + 8, b"mdat") if len(payload) < (1 << 32) - 8 else struct.pack(">I4sQ", 1, b"mdat", len(payload) + 16))
        first = len(head)
    return head + payload


def boxes(raw: bytes) -> Iterator[tuple[str, int, int]]:
    """(path, first byte of the body, end) of every box, outer ones first. ValueError where sizes do not fit or boxes are nested beyond DEEPEST."""
    open_ = [(0, len(raw), "", 0)]
    while open_:
        start, end, path, depth = open_.pop()
        if start >= end:
            continue
        if end - start < 8:
            raise ValueError("bytes after the last box")
        size, kind = struct.unpack_from(">I4s", raw, start)
        body = start + 8
        if size == 1:
            if end - start < 16:
                raise ValueError("a box is cut off")
            size, body = struct.unpack_from(">Q", raw, body)[0], body + 8
        elif size == 0:
            size = end - start
        if size < body - start or start + size > end:
            raise ValueError("a box is larger than its parent")
        name = f"{path}/{kind.decode('latin-1')}"
        yield name, body, start + size
        open_.append((start + size, end, path, depth))  # what follows, after what is inside
        if kind in CONTAINERS:
            if depth >= DEEPEST:
                raise ValueError("boxes are nested too deep")
            open_.append((body, start + size, name, depth + 1))


def _table(raw: bytes, at: int, end: int, fmt: str) -> list[tuple]:
    """Rows of a full box that counts them first."""
    n = struct.unpack_from(">I", raw, at + 4)[0]
    width = struct.calcsize(">" + fmt)
    if at + 8 + n * width > end:
        raise ValueError("a table is cut off")
    return list(struct.iter_unpack(">" + fmt, raw[at + 8 : at + 8 + n * width]))


def _sizes(raw: bytes, at: int, end: int, packed: bool) -> np.ndarray:
    """Sample sizes of a stsz or stz2 box."""
    size, n = struct.unpack_from(">II", raw, at + 4)
    if n > len(raw):
        raise ValueError("more samples than bytes")
    if not packed and size:
        return np.full(n, size, np.int64)
    bits = size & 0xFF if packed else 32
    if bits not in (4, 8, 16, 32) or packed and bits == 32:
        raise ValueError("sizes of no known width")
    if at + 12 + (n * bits + 7) // 8 > end:
        raise ValueError("a table is cut off")
    if bits == 4:
        both = np.frombuffer(raw, np.uint8, (n + 1) // 2, at + 12)
        return np.stack([both >> 4, both & 15], 1).ravel()[:n].astype(np.int64)
    return np.frombuffer(raw, {8: ">u1", 16: ">u2", 32: ">u4"}[bits], n, at + 12).astype(np.int64)


def _in_chunks(t: dict) -> np.ndarray:
    """Rows (offset, size) of the samples that the tables of a track place in chunks."""
    sizes, chunks = t["sizes"], np.array(t["chunks"], np.uint64)
    firsts = [first for first, _, _ in t["runs"]]
    untils = [*firsts[1:], len(chunks) + 1][: len(firsts)]
    if any(not 0 < a or b > len(chunks) + 1 for a, b in zip(firsts, untils, strict=True)):
        raise ValueError("a chunk without an offset")
    used = np.concatenate([np.arange(a, b) for a, b in zip(firsts, untils, strict=True)] or [np.zeros(0, np.int64)])
    per = np.repeat(np.array([per for _, per, _ in t["runs"]], np.int64), [max(0, b - a) for a, b in zip(firsts, untils, strict=True)])
    ends = np.minimum(np.cumsum(per), len(sizes))  # the last chunks may promise more samples than there are
    if (ends[-1] if len(ends) else 0) != len(sizes):
        raise ValueError("samples outside the file")
    of = np.repeat(np.arange(len(used)), np.diff(np.append(0, ends)))
    before = np.cumsum(sizes) - sizes
    first = np.append(0, ends[:-1])[of] if len(ends) else of
    starts = chunks[used - 1].astype(np.int64) if len(used) else np.zeros(0, np.int64)  # offsets beyond 2^63 turn negative, which is outside
    return np.stack([starts[of] + before - before[first], sizes], 1) if len(sizes) else np.zeros((0, 2), np.int64)


def _starts(deltas: list[tuple[int, int]], places: list[int]) -> list[int]:
    """Decoding times of samples by a table of (count, duration); its runs are never written out."""
    ends, total = [0], [0]
    for n, d in deltas:
        ends.append(ends[-1] + n)
        total.append(total[-1] + n * d)
    out = []
    for k in places:
        i = min(max(0, bisect.bisect_right(ends, k) - 1), len(deltas) - 1)
        out.append(total[i] + (k - ends[i]) * deltas[i][1] if deltas else 0)
    return out


def _fragment(raw: bytes, at: int, end: int, f: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(offset, size), duration and whether it can be decoded alone, of the samples of one trun box; ``f`` has the defaults and where data goes on."""
    flags, n = struct.unpack_from(">I", raw, at)[0] & 0xFFFFFF, struct.unpack_from(">I", raw, at + 4)[0]
    p = at + 8
    if flags & 0x1:
        f["next"] = f["base"] + struct.unpack_from(">i", raw, p)[0]
        p += 4
    first = None
    if flags & 0x4:
        first = struct.unpack_from(">I", raw, p)[0]
        p += 4
    fields = [k for k in (0x100, 0x200, 0x400, 0x800) if flags & k]
    if n > len(raw):
        raise ValueError("more samples than bytes")
    if p + 4 * len(fields) * n > end:
        raise ValueError("a run of samples is cut off")
    rows = np.frombuffer(raw, ">u4", n * len(fields), p).reshape(n, len(fields)).astype(np.int64) if fields else None
    column = lambda k, usual: rows[:, fields.index(k)] if k in fields else np.full(n, usual, np.int64)
    sizes, own = column(0x200, f["size"]), column(0x400, f["flags"])
    if 0x400 not in fields and first is not None and n:
        own[0] = first
    offsets = f["next"] + np.cumsum(sizes) - sizes
    f["next"] += int(sizes.sum())
    return np.stack([offsets, sizes], 1), column(0x100, f["duration"]), (own & 0x10000) == 0


def tracks(raw: bytes) -> list[dict]:
    """Per track: track_id, handler, codec, timescale, duration, n_samples, samples (an array of offsets and sizes), keyframes (indexes from 0) and their times.

    Samples are those of the track's tables and, after them, those of movie fragments. A file that claims more samples in all than it has bytes is an error,
    so that memory is bounded by its size.
    """
    found: list[dict] = []
    defaults: dict[int, tuple[int, int, int]] = {}  # by track: duration, size and flags of a fragment's samples
    moof, f, claimed = 0, None, 0
    for path, at, end in boxes(raw):
        name = path.rsplit("/", 1)[1]
        if path == "/moov/trak":
            found.append({"track_id": None, "handler": None, "codec": None, "timescale": 0, "duration": 0, "sizes": np.zeros(0, np.int64), "chunks": [], "runs": [], "keys": None, "delta": [], "more": ([], [], [])})
        elif path == "/moov/mvex/trex":
            track, _, *rest = struct.unpack_from(">IIIII", raw, at + 4)
            defaults[track] = tuple(rest)
        elif path == "/moof":
            moof = at - (16 if raw[at - 16 : at - 12] == b"\0\0\0\1" and raw[at - 12 : at - 8] == b"moof" else 8)
            f = None
        elif path == "/moof/traf/tfhd":
            flags, track = struct.unpack_from(">I", raw, at)[0] & 0xFFFFFF, struct.unpack_from(">I", raw, at + 4)[0]
            duration, size, own = defaults.get(track, (0, 0, 0))
            # without an own base data begins with the fragment, or goes on after the track before in it
            p, base = at + 8, moof if flags & 0x20000 or f is None else f["next"]
            if flags & 0x1:
                base, p = struct.unpack_from(">Q", raw, p)[0], p + 8
            p += 4 * bool(flags & 0x2)
            if flags & 0x8:
                duration, p = struct.unpack_from(">I", raw, p)[0], p + 4
            if flags & 0x10:
                size, p = struct.unpack_from(">I", raw, p)[0], p + 4
            if flags & 0x20:
                own = struct.unpack_from(">I", raw, p)[0]
            owner = next((t for t in found if t["track_id"] == track), None)
            if owner is None:
                raise ValueError("a fragment of no track")
            f = {"of": owner, "base": base, "next": base, "duration": duration, "size": size, "flags": own}
        elif path == "/moof/traf/trun":
            if f is None:
                raise ValueError("a run of samples without a header")
            new = _fragment(raw, at, end, f)
            claimed += len(new[0])
            if claimed > len(raw):
                raise ValueError("more samples than bytes")
            for kept, x in zip(f["of"]["more"], new, strict=True):
                kept.append(x)
        if not found or "/trak/" not in path:
            continue
        t = found[-1]
        if name == "tkhd":
            t["track_id"] = struct.unpack_from(">I", raw, at + (20 if raw[at] else 12))[0]
        elif name == "mdhd":
            t["timescale"], t["duration"] = struct.unpack_from(">IQ", raw, at + 20) if raw[at] else struct.unpack_from(">II", raw, at + 12)
        elif name == "hdlr":
            t["handler"] = raw[at + 8 : at + 12].decode("latin-1")
        elif name == "stsd":
            t["codec"] = raw[at + 12 : at + 16].decode("latin-1")
        elif name == "stts":
            t["delta"] = _table(raw, at, end, "II")
        elif name == "stsc":
            t["runs"] = _table(raw, at, end, "III")
        elif name in ("stsz", "stz2"):
            claimed -= len(t["sizes"])
            t["sizes"] = _sizes(raw, at, end, name == "stz2")
            claimed += len(t["sizes"])
            if claimed > len(raw):
                raise ValueError("more samples than bytes")
        elif name in ("stco", "co64"):
            t["chunks"] = [x[0] for x in _table(raw, at, end, "I" if name == "stco" else "Q")]
        elif name == "stss":
            t["keys"] = [x[0] - 1 for x in _table(raw, at, end, "I")]
    out = []
    for t in found:
        samples = _in_chunks(t)
        keys = t["keys"] if t["keys"] is not None else list(range(len(samples)))  # without a table all are
        if any(not 0 <= k < len(samples) for k in keys):
            raise ValueError("a keyframe that is no sample")
        times = _starts(t["delta"], keys)
        clock = sum(n * d for n, d in t["delta"])
        keys, times = list(keys), list(times)
        for more, durations, alone in zip(*t["more"], strict=True):
            at = np.cumsum(durations) - durations + clock
            keys += (len(samples) + np.flatnonzero(alone)).tolist()
            times += at[alone].tolist()
            clock += int(durations.sum())
            samples = np.concatenate([samples, more])
        if ((samples[:, 0] < 0) | (samples.sum(1) > len(raw))).any():
            raise ValueError("samples outside the file")
        out.append({k: t[k] for k in ("track_id", "handler", "codec", "timescale")} | {"duration": t["duration"] or clock, "n_samples": len(samples), "samples": samples, "keyframes": keys, "times": times})
    return out


def stored_payload(raw: bytes) -> bytes:
    """The samples of the first track, in order."""
    return b"".join(raw[a : a + n] for a, n in tracks(raw)[0]["samples"].tolist())


_COLUMNS = "media_bytes long, media_error string, handler string, codec string, timescale long, duration long, seconds double, n_samples long, keyframes array<struct<offset:long,length:long>>, tracks array<struct<track_id:long,handler:string,codec:string,timescale:long,duration:long,seconds:double,n_samples:long,keyframes:array<struct<offset:long,length:long,seconds:double>>>>"


def _described(raw: bytes | None) -> dict:
    row = dict.fromkeys(("media_bytes", "media_error", "handler", "codec", "timescale", "duration", "seconds", "n_samples", "keyframes", "tracks"))
    if raw is None:
        return row
    row["media_bytes"] = len(raw)
    try:
        every = tracks(raw)
        t = next(iter(every), None)
    except (ValueError, struct.error, IndexError) as e:
        return row | {"media_error": str(e) or "cut off"}
    if t is None:
        return row | {"media_error": "no track"}
    row["tracks"] = [
        {k: x[k] for k in ("track_id", "handler", "codec", "timescale", "duration", "n_samples")}
        | {"seconds": x["duration"] / x["timescale"] if x["timescale"] else None}
        | {"keyframes": [{"offset": int(x["samples"][k][0]), "length": int(x["samples"][k][1]), "seconds": at / x["timescale"] if x["timescale"] else None} for k, at in zip(x["keyframes"], x["times"], strict=True)]}
        for x in every
    ]
    row |= {k: t[k] for k in ("handler", "codec", "timescale", "duration", "n_samples")}
    return row | {"seconds": t["duration"] / t["timescale"] if t["timescale"] else None, "keyframes": [{"offset": int(t["samples"][k][0]), "length": int(t["samples"][k][1])} for k in t["keyframes"]]}


_KEYS = pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int64()), ("seconds", pa.float64())]))
_TRACK = pa.struct([("track_id", pa.int64()), ("handler", pa.string()), ("codec", pa.string()), ("timescale", pa.int64()), ("duration", pa.int64()), ("seconds", pa.float64()), ("n_samples", pa.int64()), ("keyframes", _KEYS)])
_ARROW = pa.struct([("media_bytes", pa.int64()), ("media_error", pa.string()), ("handler", pa.string()), ("codec", pa.string()), ("timescale", pa.int64()), ("duration", pa.int64()), ("seconds", pa.float64()), ("n_samples", pa.int64()), ("keyframes", pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int64())]))), ("tracks", pa.list_(_TRACK))])


def media_columns(files: DataFrame, id_col: str, media_col: str) -> DataFrame:
    """(id, media_bytes, media_error, handler, codec, timescale, duration, seconds, n_samples, keyframes, tracks).

    tracks has all tracks, with keyframes' byte ranges and times; the columns before it are those of the first. Samples of movie fragments count.
    Null files have nulls; empty, cut off or contradictory ones, those nested beyond DEEPEST and those that claim more samples than they have bytes, have media_error and nulls. Rows come back as often as they came;
    columns beside the two are ignored; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = pa.array([_described(x) for x in batch.column(1).to_pylist()], _ARROW)
            yield pa.RecordBatch.from_arrays([batch.column(0), *got.flatten()], ["id", *(f.name for f in _ARROW)])

    ready(files.sparkSession)
    rows = files.select(F.col(id_col).alias("id"), F.col(media_col).cast("binary").alias("media"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, {_COLUMNS}")


def padded(text: bytes) -> bytes:
    """Spaces up to a positive multiple of SAMPLE bytes."""
    return text + b" " * (max(1, -(-len(text) // SAMPLE)) * SAMPLE - len(text))


def texts_to_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, media): each text's UTF-8 bytes, padded with spaces, as an ISO media file. Null texts count as empty; null ids and repeated rows
    stay as they came; other columns are ignored; an empty table gives an empty result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = pc.fill_null(batch.column(1).cast(pa.large_binary()), b"").to_pylist()
            for a in range(0, len(raw), 500):
                part = raw[a : a + 500]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, len(part)), pa.array([write_media(padded(x)) for x in part], pa.binary())], ["doc_id", "media"])

    ready(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, media binary")


def _digest(text: bytes) -> tuple:
    media = write_media(padded(text))
    t = tracks(media)[0]
    payload = b"".join(media[a : a + n] for a, n in t["samples"].tolist())
    ranges = t["samples"][t["keyframes"]].tolist()
    feature = {"codec": t["codec"], "handler": t["handler"], "seconds": t["duration"] / t["timescale"], "samples": t["n_samples"], "keyframes": len(ranges), "first_key": ranges[0], "last_key": ranges[-1], "keys_sha256": hashlib.sha256(json.dumps(ranges).encode()).hexdigest()}
    return len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), json.dumps(feature, sort_keys=True)


def media_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stores every whole text as a media file, walks that file, reads its samples back and returns digests.

    (doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature); feature is JSON with
    codec, handler, seconds, sample and keyframe counts and the first, last and hash of all keyframe byte ranges. Null texts count as
    empty; equal texts give equal values; null ids and repeated rows stay; other columns are ignored, whatever their names; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        for batch in batches:
            raw = pc.fill_null(batch.column(1).cast(pa.large_binary()), b"")
            cols = list(zip(*(_digest(x.as_py()) for x in raw), strict=True)) or [[]] * 7
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["doc_id", *names])

    ready(docs.sparkSession)
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)
