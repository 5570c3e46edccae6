"""Media columns: a small Matroska writer and a parser of its elements into packet tables.

A text's UTF-8 bytes, padded with zero bytes to a positive multiple of 64, are stored as one track of 8-bit PCM samples.
The parser reads variable-length EBML ids and sizes, clusters, simple blocks and block groups with all four lacings, and
cues, and gives one row per packet: track, timestamp in milliseconds, keyframe flag, and byte range in the file.

Defined cases: a null text is an empty one (64 zero bytes); a null media column has no packets; elements of unknown size
end with their parent; bytes that are no Matroska raise ValueError.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from fabula.llm.common import documents, materialize

# Fixed values of the format: element ids.
EBML, DOC_TYPE = 0x1A45DFA3, 0x4282
SEGMENT, INFO, TIMESTAMP_SCALE, TRACKS, TRACK_ENTRY = 0x18538067, 0x1549A966, 0x2AD7B1, 0x1654AE6B, 0xAE
TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC_ID, AUDIO = 0xD7, 0x73C5, 0x83, 0x86, 0xE1
SAMPLING_FREQUENCY, CHANNELS, BIT_DEPTH = 0xB5, 0x9F, 0x6264
CLUSTER, TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1
CUES, CUE_POINT, CUE_TIME, CUE_TRACK_POSITIONS, CUE_TRACK, CUE_CLUSTER_POSITION = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
MASTERS = {SEGMENT, INFO, TRACKS, TRACK_ENTRY, AUDIO, CLUSTER, BLOCK_GROUP, CUES, CUE_POINT, CUE_TRACK_POSITIONS}
CODEC = b"A_PCM/INT/LIT"

RATE = 8000
UNIT = 64
#: Samples of a frame, frames of a laced block, blocks of a cluster.
FRAME, LACE, BLOCKS = 1024, 8, 16


def vint(value: int, width: int = 0) -> bytes:
    """A size as an EBML variable-length integer; the all-ones pattern of a width is kept for "unknown"."""
    width = width or next(w for w in range(1, 9) if value < (1 << 7 * w) - 1)
    return (value | 1 << 7 * width).to_bytes(width, "big")


def element(ident: int, body: bytes) -> bytes:
    return ident.to_bytes((ident.bit_length() + 7) // 8, "big") + vint(len(body)) + body


def unsigned(ident: int, value: int) -> bytes:
    return element(ident, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


def laced_block(track: int, relative: int, frames: list[bytes], lacing: str) -> bytes:
    """A simple block of frames; lacing is none, xiph, fixed or ebml."""
    kind = {"none": 0, "xiph": 1, "fixed": 2, "ebml": 3}[lacing]
    head = vint(track) + relative.to_bytes(2, "big", signed=True) + bytes([0x80 | kind << 1])
    sizes = [len(f) for f in frames]
    if kind:
        head += bytes([len(frames) - 1])
    if kind == 1:
        head += b"".join(b"\xff" * (s // 255) + bytes([s % 255]) for s in sizes[:-1])
    elif kind == 3:
        head += vint(sizes[0])
        for before, now in zip(sizes, sizes[1:-1], strict=False):
            step = now - before
            width = next(w for w in range(1, 9) if abs(step) < (1 << 7 * w - 1))
            head += vint(step + (1 << 7 * width - 1) - 1, width)
    return head + b"".join(frames)


def write_matroska(payload: bytes) -> bytes:
    """The payload as one track of 8-bit samples: info, track, clusters of laced blocks, cues."""
    head = element(EBML, element(DOC_TYPE, b"matroska"))
    audio = element(SAMPLING_FREQUENCY, np.array(RATE, ">f4").tobytes()) + unsigned(CHANNELS, 1) + unsigned(BIT_DEPTH, 8)
    body = [
        element(INFO, unsigned(TIMESTAMP_SCALE, 1_000_000)),
        element(TRACKS, element(TRACK_ENTRY, unsigned(TRACK_NUMBER, 1) + unsigned(TRACK_UID, 1) + unsigned(TRACK_TYPE, 2) + element(CODEC_ID, CODEC) + element(AUDIO, audio))),
    ]
    place, cues, step = sum(map(len, body)), [], FRAME * LACE * BLOCKS
    for at in range(0, len(payload), step):
        begun = at * 1000 // RATE
        parts = [unsigned(TIMESTAMP, begun)]
        for b in range(at, min(at + step, len(payload)), FRAME * LACE):
            frames = [payload[f : f + FRAME] for f in range(b, min(b + FRAME * LACE, len(payload)), FRAME)]
            lacing = "none" if len(frames) == 1 else "fixed" if len(frames[-1]) == FRAME else ("ebml", "xiph")[b // (FRAME * LACE) % 2]
            parts.append(element(SIMPLE_BLOCK, laced_block(1, b * 1000 // RATE - begun, frames, lacing)))
        cluster = element(CLUSTER, b"".join(parts))
        cues.append(element(CUE_POINT, unsigned(CUE_TIME, begun) + element(CUE_TRACK_POSITIONS, unsigned(CUE_TRACK, 1) + unsigned(CUE_CLUSTER_POSITION, place))))
        body.append(cluster)
        place += len(cluster)
    return head + element(SEGMENT, b"".join(body) + element(CUES, b"".join(cues)))


def _vint(data: bytes, at: int, marker: bool = False) -> tuple[int | None, int]:
    """Value and next place of a variable-length integer; ids keep their marker; None for an unknown size."""
    if at >= len(data) or not data[at]:
        raise ValueError(f"no EBML integer at byte {at}")
    width = 9 - data[at].bit_length()
    value = int.from_bytes(data[at : at + width], "big")
    if len(data) < at + width:
        raise ValueError("the file ends inside an integer")
    if not marker:
        value &= (1 << 7 * width) - 1
        if value == (1 << 7 * width) - 1:
            return None, at + width
    return value, at + width


def elements(data: bytes, at: int, end: int):
    """(id, body start, body end) of the elements of a range; unknown sizes reach to its end."""
    while at < end:
        ident, at = _vint(data, at, True)
        size, at = _vint(data, at)
        stop = end if size is None else at + size
        if stop > end:
            raise ValueError(f"element {ident:X} is longer than its parent")
        if size is None and ident == CLUSTER:  # ends where the next top element begins
            stop = _unknown_end(data, at, end)
        yield ident, at, stop
        at = stop


def _unknown_end(data: bytes, at: int, end: int) -> int:
    while at < end:
        ident, body = _vint(data, at, True)
        if ident in (CLUSTER, CUES, INFO, TRACKS):
            return at
        size, body = _vint(data, body)
        at = end if size is None else body + size
    return end


def frame_ranges(data: bytes, at: int, end: int):
    """Track, relative time, keyframe flag and (start, end) of each frame of a block."""
    track, at = _vint(data, at)
    relative = int.from_bytes(data[at : at + 2], "big", signed=True)
    flags = data[at + 2]
    at += 3
    kind = flags >> 1 & 3
    if not kind:
        return track, relative, bool(flags & 0x80), [(at, end)]
    n = data[at] + 1
    at += 1
    sizes: list[int] = []
    if kind == 1:
        for _ in range(n - 1):
            size = 0
            while data[at] == 255:
                size += 255
                at += 1
            sizes.append(size + data[at])
            at += 1
    elif kind == 3:
        size, at = _vint(data, at)
        sizes.append(size)
        for _ in range(n - 2):
            step, after = _vint(data, at)
            if step is None:  # all ones is a step here
                step = (1 << 7 * (after - at)) - 1
            size += step - ((1 << 7 * (after - at) - 1) - 1)
            sizes.append(size)
            at = after
        sizes = sizes[: n - 1]
    else:
        if (end - at) % n:
            raise ValueError("fixed lacing of unequal frames")
        sizes = [(end - at) // n] * (n - 1)
    ranges = []
    for size in sizes:
        ranges.append((at, at + size))
        at += size
    ranges.append((at, end))
    if at > end or any(b < a for a, b in ranges):
        raise ValueError("laces are longer than their block")
    return track, relative, bool(flags & 0x80), ranges


def read_matroska(data: bytes) -> dict:
    """Tracks, cues and packets (track, time_ms, keyframe, start, end) of a file."""
    top = list(elements(data, 0, len(data)))
    if not top or top[0][0] != EBML:
        raise ValueError("no EBML header")
    number = lambda a, b: int.from_bytes(data[a:b], "big")
    found: dict = {"scale": 1_000_000, "tracks": [], "packets": [], "cues": [], "clusters": 0}
    for ident, a, b in top:
        if ident != SEGMENT:
            continue
        for kind, x, y in elements(data, a, b):
            if kind == INFO:
                found["scale"] = next((number(p, q) for i, p, q in elements(data, x, y) if i == TIMESTAMP_SCALE), found["scale"])
            elif kind == TRACKS:
                for _, p, q in elements(data, x, y):
                    own = {i: (s, t) for i, s, t in elements(data, p, q)}
                    found["tracks"].append({"number": number(*own[TRACK_NUMBER]), "codec": data[slice(*own[CODEC_ID])].decode()})
            elif kind == CLUSTER:
                found["clusters"] += 1
                begun = 0
                for i, p, q in elements(data, x, y):
                    if i == TIMESTAMP:
                        begun = number(p, q)
                        continue
                    blocks = [(p, q)] if i == SIMPLE_BLOCK else [(s, t) for j, s, t in elements(data, p, q) if j == BLOCK] if i == BLOCK_GROUP else []
                    for s, t in blocks:
                        track, relative, key, ranges = frame_ranges(data, s, t)
                        time = (begun + relative) * found["scale"] / 1e6
                        found["packets"] += [(track, time, key, u, v) for u, v in ranges]
            elif kind == CUES:
                for _, p, q in elements(data, x, y):
                    own = {i: (s, t) for i, s, t in elements(data, p, q)}
                    place = {i: number(s, t) for i, s, t in elements(data, *own[CUE_TRACK_POSITIONS])}
                    found["cues"].append((number(*own[CUE_TIME]), place[CUE_TRACK], a + place[CUE_CLUSTER_POSITION]))
    return found


def padded(text: str | None) -> bytes:
    raw = (text or "").encode()
    return raw + b"\0" * (-len(raw) % UNIT or (0 if raw else UNIT))


def _store(batches):
    for batch in batches:
        texts = batch.column("text").to_pylist()
        sizes = [len((t or "").encode()) for t in texts]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array([write_matroska(padded(t)) for t in texts], pa.binary())], ["doc_id", "n_bytes", "media"])


def media_column(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): every whole text as a Matroska file."""
    return docs.select("doc_id", "text").mapInArrow(_store, "doc_id long, n_bytes long, media binary")


PACKETS = "doc_id long, packet int, track int, time_ms double, keyframe boolean, start long, length long"


def packet_table(media: DataFrame) -> DataFrame:
    """One row per packet of a media column: track, timestamp, keyframe flag and byte range."""

    def parsed(batches):
        for batch in batches:
            for doc, data in zip(batch.column("doc_id").to_pylist(), batch.column("media").to_pylist(), strict=True):
                rows = [(doc, i, t, at, k, a, b - a) for i, (t, at, k, a, b) in enumerate(read_matroska(data)["packets"] if data is not None else [])]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, p) for c, p in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.bool_(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "packet", "track", "time_ms", "keyframe", "start", "length"])

    return media.select("doc_id", "media").mapInArrow(parsed, PACKETS)


def _features(found: dict, payload: bytes) -> str:
    """Packets, clusters, duration, mean, spread and zero crossings of the samples, as text."""
    samples = np.frombuffer(payload, np.uint8)
    centred = samples >= 128
    low = found["packets"][0][1] if found["packets"] else 0
    return f"packets={len(found['packets'])};clusters={found['clusters']};cues={len(found['cues'])};first_ms={low:g};samples={len(samples)};mean={samples.mean():.6f};sd={samples.std():.6f};crossings={int((centred[1:] != centred[:-1]).sum())}"


def _read(batches):
    for batch in batches:
        rows = []
        for doc, n, data in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n_bytes", "media")), strict=True):
            found = read_matroska(data)
            payload = b"".join(data[a:b] for track, _, _, a, b in found["packets"] if track == 1)
            rows.append((doc, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(data), hashlib.sha256(data).hexdigest(), _features(found, payload)))
        columns = list(zip(*rows, strict=True)) or [()] * 8
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])


def read_back(media: DataFrame) -> DataFrame:
    """What the stored files hold, from their packet tables: the payload's digests and features of its samples."""
    return media.select("doc_id", "n_bytes", "media").mapInArrow(_read, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_back(materialize(media_column(documents(spark, sf_dir)), "media"))
