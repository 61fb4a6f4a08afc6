"""Matroska media columns: payloads stored as laced audio packets, and any Matroska bytes parsed into packet tables.

`write` stores each text's UTF-8 bytes, padded with byte 255 to a positive multiple of 576, as 8-bit PCM in a Matroska file of its
own. `packets` turns a column of Matroska bytes into a packet table; `features` reads the payload back from the stored bytes
and describes it. Parsing knows variable-length ids and sizes, unknown sizes, SimpleBlock and BlockGroup, the three lacings and cues.

A null or empty text is stored as one packet of padding. Equal texts get equal bytes, so equal rows get equal results. Null media has no
packets and null features; bytes that break off end the packet list before the broken element (and `features` reports what is whole).
Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

FRAME = 576
RATE = 8000
FRAME_MS = FRAME * 1000 // RATE
LACED = 8  # frames of a block
BLOCKS = 32  # blocks of a cluster

# Element ids of the Matroska format.
EBML, SEGMENT, INFO, TRACKS, TRACK, AUDIO = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0xAE, 0xE1
CLUSTER, CLUSTER_TIME, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1
CUES, CUE_POINT, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
TRACK_NUMBER, CODEC, TIMESTAMP_SCALE, SAMPLING = 0xD7, 0x86, 0x2AD7B1, 0xB5
INSIDE = {SEGMENT, CLUSTER, BLOCK_GROUP, TRACKS, CUES, INFO}
#: Elements that end a segment or cluster of unknown size.
TOP = {EBML, SEGMENT}
LEVEL_1 = {INFO, TRACKS, CLUSTER, CUES, 0x114D9B74, 0x1941A469, 0x1043A770, 0x1254C367}


class Packet(NamedTuple):
    track: int
    timestamp_ns: int
    offset: int
    size: int
    keyframe: bool
    lacing: str
    cluster: int  # the byte at which its cluster begins
    cued: bool


class Media(NamedTuple):
    packets: list[Packet]
    tracks: list[tuple[int, str, float]]
    clusters: int
    cues: list[tuple[int, int, int]]  # time, track, cluster's byte


def size_bytes(n: int, width: int = 0) -> bytes:
    """n as a variable-length size, in the fewest bytes or in width bytes."""
    width = width or next(w for w in range(1, 9) if n < (1 << 7 * w) - 1)
    return ((1 << 7 * width) | n).to_bytes(width, "big")


def element(ident: int, body: bytes) -> bytes:
    return ident.to_bytes((ident.bit_length() + 7) // 8, "big") + size_bytes(len(body)) + body


def number(n: int) -> bytes:
    return n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big")


def lace(frames: list[bytes], how: str) -> tuple[int, bytes]:
    """(the block's lacing bits, its bytes from the lacing head on)."""
    if how == "none" or len(frames) == 1:
        return 0, b"".join(frames)
    head = bytes([len(frames) - 1])
    sizes = [len(f) for f in frames]
    if how == "xiph":
        head += b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1])
    elif how == "ebml":
        head += size_bytes(sizes[0])
        for a, b in zip(sizes, sizes[1:-1], strict=False):
            width = next(w for w in range(1, 9) if abs(b - a) < (1 << 7 * w - 1) - 1)
            head += size_bytes(b - a + (1 << 7 * width - 1) - 1, width)
    return {"xiph": 2, "fixed": 4, "ebml": 6}[how], head + b"".join(frames)


# Parts that are the same in every file.
_HEAD = element(EBML, element(0x4286, b"\1") + element(0x42F7, b"\1") + element(0x42F2, b"\4") + element(0x42F3, b"\x08") + element(0x4282, b"matroska") + element(0x4287, b"\4") + element(0x4285, b"\2"))
_INFO = element(INFO, element(TIMESTAMP_SCALE, number(1_000_000)) + element(0x4D80, b"tidewater") + element(0x5741, b"tidewater"))
_AUDIO = element(AUDIO, element(SAMPLING, struct.pack(">d", RATE)) + element(0x9F, b"\1") + element(0x6264, b"\x08"))
_TRACKS = element(TRACKS, element(TRACK, element(TRACK_NUMBER, b"\1") + element(0x73C5, b"\1") + element(0x83, b"\2") + element(0x9C, b"\1") + element(0x23E383, number(FRAME_MS * 1_000_000)) + element(CODEC, b"A_PCM/INT/LIT") + _AUDIO))


def encode(payload: bytes, lacing: str = "fixed") -> bytes:
    """A Matroska file whose one audio track's packets are payload in steps of FRAME bytes."""
    clusters, cues, at = [], [], len(_INFO) + len(_TRACKS)
    step, wide = FRAME * LACED, FRAME * LACED * BLOCKS
    for begin in range(0, len(payload), wide):
        time = begin // FRAME * FRAME_MS
        blocks = [element(CLUSTER_TIME, number(time))]
        for k in range(begin, min(begin + wide, len(payload)), step):
            own = payload[k : min(k + step, begin + wide)]
            bits, body = lace([own[i : i + FRAME] for i in range(0, len(own), FRAME)], lacing) if lacing != "fixed" else ((4, bytes([len(own) // FRAME - 1]) + own) if len(own) > FRAME else (0, own))
            blocks.append(element(SIMPLE_BLOCK, b"\x81" + struct.pack(">hB", k // FRAME * FRAME_MS - time, 0x80 | bits) + body))
        clusters.append(element(CLUSTER, b"".join(blocks)))
        cues.append(element(CUE_POINT, element(CUE_TIME, number(time)) + element(CUE_POSITIONS, element(CUE_TRACK, b"\1") + element(CUE_CLUSTER, number(at)))))
        at += len(clusters[-1])
    return _HEAD + element(SEGMENT, _INFO + _TRACKS + b"".join(clusters) + element(CUES, b"".join(cues)))


def vint(data: bytes, at: int, keep: bool = False) -> tuple[int, int]:
    """(value, bytes) of the variable-length number at a byte; -1 for an unknown size; keep: with its length bits, as ids have it."""
    first = data[at]
    width = 9 - first.bit_length()
    if width > 8 or at + width > len(data):
        raise ValueError("no variable-length number")
    value = int.from_bytes(data[at : at + width], "big")
    if keep:
        return value, width
    value &= (1 << 7 * width) - 1
    return (-1 if value == (1 << 7 * width) - 1 else value), width


def unlace(data: bytes, at: int, end: int, flags: int) -> tuple[str, list[tuple[int, int]]]:
    """(lacing, (offset, size) of each frame) of a block's bytes after its flags."""
    kind = flags & 6
    if not kind:
        return "none", [(at, end - at)]
    n = data[at] + 1
    at += 1
    sizes: list[int] = []
    if kind == 4:
        sizes = [(end - at) // n] * n
    elif kind == 2:
        for _ in range(n - 1):
            size = 0
            while data[at] == 255:
                size, at = size + 255, at + 1
            sizes.append(size + data[at])
            at += 1
    else:
        for k in range(n - 1):
            value, width = vint(data, at)
            sizes.append(value if not k else sizes[-1] + value - ((1 << 7 * width - 1) - 1))
            at += width
    if kind != 4:
        sizes.append(end - at - sum(sizes))
    if min(sizes) < 0 or at + sum(sizes) > end:
        raise ValueError("lacing beyond its block")
    frames = []
    for size in sizes:
        frames.append((at, size))
        at += size
    return {2: "xiph", 4: "fixed", 6: "ebml"}[kind], frames


def children(data: bytes, at: int, end: int) -> Iterator[tuple[int, int, int]]:
    """(id, begin, end) of each element between two bytes."""
    while at < end:
        ident, width = vint(data, at, keep=True)
        size, more = vint(data, at + width)
        begin = at + width + more
        if size < 0 or begin + size > end:
            raise ValueError("element beyond its parent")
        yield ident, begin, begin + size
        at = begin + size


def parse(data: bytes) -> Media:
    """Everything whole that Matroska bytes hold."""
    found: list[tuple[int, int, int, int, bool, str, int]] = []
    tracks, cues, scale = [], [], 1_000_000
    clusters, cluster, cluster_time, segment = 0, 0, 0, 0
    stack: list[tuple[int, int]] = []  # open parents: id, end or -1
    at = 0
    try:
        while at < len(data):
            while stack and stack[-1][1] >= 0 and at >= stack[-1][1]:
                stack.pop()
            ident, width = vint(data, at, keep=True)
            size, more = vint(data, at + width)
            begin = at + width + more
            while stack and stack[-1][1] < 0 and (ident in TOP or ident in LEVEL_1 and stack[-1][0] != SEGMENT):
                stack.pop()
            end = len(data) if size < 0 else begin + size
            if end > len(data) and ident not in (SEGMENT, CLUSTER):
                break
            if ident == SEGMENT:
                segment = begin
            elif ident == CLUSTER:
                clusters, cluster = clusters + 1, at
            elif ident == CLUSTER_TIME:
                cluster_time = int.from_bytes(data[begin:end], "big")
            elif ident == TIMESTAMP_SCALE:
                scale = int.from_bytes(data[begin:end], "big")
            elif ident in (SIMPLE_BLOCK, BLOCK):
                track, n = vint(data, begin)
                offset, flags = struct.unpack_from(">hB", data, begin + n)
                lacing, frames = unlace(data, begin + n + 3, end, flags)
                found += [(track, cluster_time + offset, k, f, s, bool(flags & 0x80), lacing, cluster) for k, (f, s) in enumerate(frames)]
            elif ident == TRACK:
                own = {i: data[b:e] for i, b, e in children(data, begin, end)}
                sound = own.get(AUDIO, b"")
                audio = {i: sound[b:e] for i, b, e in children(sound, 0, len(sound))}
                each = int.from_bytes(own.get(0x23E383, b""), "big")
                rate = audio.get(SAMPLING, b"")
                tracks.append((int.from_bytes(own.get(TRACK_NUMBER, b""), "big"), own.get(CODEC, b"").decode("ascii", "replace"), struct.unpack(">d" if len(rate) == 8 else ">f", rate)[0] if len(rate) in (4, 8) else 0.0, each))
            elif ident == CUE_POINT:
                time = 0
                for i, b, e in children(data, begin, end):
                    if i == CUE_TIME:
                        time = int.from_bytes(data[b:e], "big")
                    elif i == CUE_POSITIONS:
                        own = {j: int.from_bytes(data[x:y], "big") for j, x, y in children(data, b, e)}
                        cues.append((time * scale, own.get(CUE_TRACK, 0), segment + own.get(CUE_CLUSTER, 0)))
            if ident in INSIDE:
                stack.append((ident, -1 if size < 0 else end))
                at = begin
            else:
                at = end
    except (ValueError, IndexError, struct.error):
        pass
    cued = {(track, c) for _, track, c in cues}
    lasts = {t[0]: t[3] for t in tracks}
    first: set[tuple[int, int]] = set()
    packets = []
    for track, time, k, offset, size, key, lacing, c in found:
        packets.append(Packet(track, time * scale + k * lasts.get(track, 0), offset, size, key, lacing, c, (track, c) in cued and (track, c) not in first))
        first.add((track, c))
    return Media(packets, [t[:3] for t in tracks], clusters, cues)


def pad(payload: bytes) -> bytes:
    return payload + b"\xff" * (-len(payload) % FRAME or (0 if payload else FRAME))


def _write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        texts = [(t or "").encode() for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array([encode(pad(t)) for t in texts], pa.binary())], ["doc_id", "n_bytes", "media"])


def write(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes (of the text), media (the Matroska bytes) of docs (doc_id, text)."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_write, "doc_id long, n_bytes long, media binary")


PACKETS = "doc_id long, track int, packet int, timestamp_ns long, byte_offset long, size long, keyframe boolean, lacing string, cluster_offset long, cued boolean"


def _packets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "media"):
        rows = [(i, p.track, k, p.timestamp_ns, p.offset, p.size, p.keyframe, p.lacing, p.cluster, p.cued) for i, m in zip(batch.column("doc_id").to_pylist(), batch.column("media").to_pylist(), strict=True) if m is not None for k, p in enumerate(parse(m).packets)]
        types = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.string(), pa.int64(), pa.bool_()]
        columns = list(zip(*rows, strict=True)) or [[]] * len(types)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], [c.split()[0] for c in PACKETS.split(", ")])


def packets(media: DataFrame) -> DataFrame:
    """The packet table of media (doc_id, media): one row a frame, with its track, time and byte range."""
    return media.select(F.col("doc_id").cast("long").alias("doc_id"), "media").mapInArrow(_packets, PACKETS)


def describe(data: bytes) -> tuple[bytes, str]:
    """(payload read back, feature) of Matroska bytes."""
    media = parse(data)
    payload = b"".join([data[p.offset : p.offset + p.size] for p in media.packets])
    signal = np.frombuffer(payload, np.uint8).astype(np.float64) - 128
    loud = float(np.sqrt(np.mean(signal * signal))) if len(signal) else 0.0
    crossings = int(np.count_nonzero(np.diff(signal < 0)))
    end = media.packets[-1].timestamp_ns // 1_000_000 + FRAME_MS if media.packets else 0
    return payload, f"{len(media.packets)} packets, {media.clusters} clusters, {len(media.cues)} cues, {end} ms, mean {float(signal.mean()) if len(signal) else 0:.4f}, rms {loud:.4f}, {crossings} crossings"


FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "media"):
        out: list[tuple] = []
        for media in batch.column("media").to_pylist():
            if media is None:
                out.append((None,) * 6)
                continue
            payload, feature = describe(media)
            out.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature))
        types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *columns], [c.split()[0] for c in FEATURES.split(", ")])


def features(media: DataFrame) -> DataFrame:
    """What the stored bytes of media (doc_id, n_bytes, media) hold: digests of the payload read back and of the file, and the feature."""
    return media.select("doc_id", "n_bytes", "media").mapInArrow(_features, FEATURES)
