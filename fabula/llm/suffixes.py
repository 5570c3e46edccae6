"""Suffix-array dedup: bytes of strings of 50 that also start in a document with a smaller doc_id.

Every string of 50 bytes has one anchor: of its 31 strings of 20 bytes the one with the least hash, the first if several
have it. Equal strings have equal anchors, so an anchor's strings can be judged alone. Neighbouring strings with one anchor
are a stretch, and only stretches travel, by hash. A stretch that a smaller document has too repeats as a whole; such
copies collapse to their first document, first inside a batch, then across batches. What is left is one stretch per
different text; those whose anchor has several documents go, as bytes, into shards by anchor. Each shard builds a suffix
array by Larsson-Sadakane refinement, takes common prefixes of neighbours in the array by Kasai's scan, and finds for
every string of 50 the smallest document that has it. An anchor with more stretches than a shard holds goes through
several shards in doc_id order, and each looks its strings up in the sorted strings of the earlier ones by binary search.

Defined cases: a null text is empty; texts under 50 bytes lose nothing; rows that repeat a doc_id don't match each other
and answer each for itself (told apart by a number that each further text of a doc_id gets); a null doc_id matches nothing. Stretches are told
apart by 64-bit hashes beside those of their anchors, strings in shards by their bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fabula.llm.common import _BASE, _BYTES, documents, materialize, mix64, pieces, release, segment_sums, shuffle_partitions, utf8

SPAN = 50
ANCHOR = 20
WINDOW = SPAN - ANCHOR + 1
PIECE = 2_000_000
#: Bytes of a shard: positions fit in 21 bits, so a rank pair and a position are one 64-bit sort key.
SHARD = 1 << 21
BUCKETS_A_PARTITION = 8
#: ``size`` is the bytes of a stretch, 80 at most.
RECORD = np.dtype([("anchor", "<u8"), ("around", "<u8"), ("doc", "<u4"), ("place", "<u4"), ("tag", "<u4"), ("size", "u1")])
ASKED = np.dtype([("place", "<u4"), ("size", "u1"), ("anchor", "<i8")])
PLACE = np.dtype([("place", "<u4"), ("size", "u1")])
LANE = 64


def _window_min(h: np.ndarray, width: int) -> np.ndarray:
    """Least value of each window: running minima forwards and backwards inside blocks of the window's width."""
    n = len(h)
    x = np.full(-(-n // width) * width, np.iinfo(h.dtype).max, h.dtype)
    x[:n] = h
    blocks = x.reshape(-1, width)
    forward = np.minimum.accumulate(blocks, 1).ravel()
    backward = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(backward[: n - width + 1], forward[width - 1 : n])


def anchors(raw: np.ndarray, at: np.ndarray):
    """Row, place in the row, size, hash of the anchor, and hash of every stretch of a batch."""
    if len(raw) <= SHARD:
        return _stretches(raw, at)
    found = []  # one long text, in parts that overlap by a string less a byte
    for a in range(0, len(raw) - SPAN + 1, SHARD - SPAN + 1):
        row, place, *rest = _stretches(raw[a : a + SHARD], np.clip(at - a, 0, min(SHARD, len(raw) - a)))
        found.append((row, place + np.maximum(a - at[row], 0), *rest))  # places count from the row's start
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _stretches(raw: np.ndarray, at: np.ndarray):
    n = len(raw)
    none = np.zeros(0, np.int64)
    if n < SPAN:
        return none, none, none, none.view(np.uint64), none.view(np.uint64)
    power = np.ones(n + 1, np.uint64)
    power[1:] = np.uint64(_BASE)
    power = np.cumprod(power, dtype=np.uint64)
    back = np.ones(n + 1, np.uint64)
    back[1:] = np.uint64(pow(_BASE, -1, 1 << 64))
    back = np.cumprod(back, dtype=np.uint64)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTES[raw] * power[:n], dtype=np.uint64, out=total[1:])
    h = mix64((total[ANCHOR:] - total[:-ANCHOR]) * back[: n - ANCHOR + 1])
    low = np.uint64(SHARD - 1)
    least = _window_min(h & ~low | np.arange(len(h), dtype=np.uint64), WINDOW)  # hash, then place
    whole = np.ones(len(least), bool)
    for back_by in range(1, SPAN):  # strings that cross the end of a row
        edge = at[1:-1] - back_by
        whole[edge[(edge >= 0) & (edge < len(whole))]] = False
    first = whole.copy()
    first[1:] &= (least[1:] != least[:-1]) | ~whole[:-1]
    start = np.flatnonzero(first)
    last = whole.copy()
    last[:-1] &= (least[1:] != least[:-1]) | ~whole[1:]
    end = np.flatnonzero(last) + SPAN
    place = (least[start] & low).astype(np.int64)
    row = np.searchsorted(at, start, "right") - 1
    around = mix64((total[end] - total[start]) * back[start] + ((end - start) * 64 + place - start).astype(np.uint64))
    return row, start - at[row], end - start, h[place], around


def _groups(*columns: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal rows of sorted columns."""
    change = np.zeros(len(columns[0]), bool)
    change[:1] = True
    for c in columns:
        change[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(change)


def _first_documents(records: np.ndarray):
    """Records sorted by (anchor, around, doc), and whether each belongs to the first document of its stretch."""
    records = records[np.lexsort((records["doc"], records["around"], records["anchor"]))]
    starts = _groups(records["anchor"], records["around"])
    sizes = np.diff(np.concatenate((starts, [len(records)])))
    return records, records["doc"] == np.repeat(records["doc"][starts], sizes), starts


_SENT = "bucket int, base long, tag int, data binary"


def _send(buckets: int):
    """A batch's anchors by bucket; what repeats a smaller document of the batch is answered here, under bucket -1 - b."""

    def sent(batches):
        for batch in batches:
            raw, at = utf8(batch.column("text"))
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            tags = batch.column("tag").to_numpy(zero_copy_only=False)
            if not len(ids):
                continue
            wide = int(ids.max()) - int(ids.min()) >= 1 << 32
            groups = _near(ids) if wide else [np.arange(len(ids))]
            for rows in groups:
                yield from _send_rows(raw, at, ids, tags, rows, buckets)

    return sent


def _near(ids: np.ndarray):
    """Rows in groups whose ids differ by less than 2**32."""
    order = np.argsort(ids, kind="stable")
    a = 0
    while a < len(order):
        b = int(np.searchsorted(ids[order], ids[order[a]] + (1 << 32) - 1, "right"))
        yield order[a:b]
        a = b


def _send_rows(raw, at, ids, tags, rows, buckets):
    base = int(ids[rows].min())
    found = []
    keep = np.zeros(len(ids), bool)
    keep[rows] = True
    for a, b in pieces(at, PIECE):
        row, place, size, anchor, around = anchors(raw[at[a] : at[b]], at[a : b + 1] - at[a])
        row += a
        own = keep[row]
        made = np.empty(int(own.sum()), RECORD)
        made["anchor"], made["around"], made["place"], made["size"] = anchor[own], around[own], place[own], size[own]
        made["doc"], made["tag"] = ids[row[own]] - base, tags[row[own]]
        found.append(made)
    records = np.concatenate(found)
    if not len(records):
        return
    records, first, _ = _first_documents(records)
    yield from _answers(records[~first], base, lambda doc: -1 - doc % buckets)
    records = records[first]
    bucket = (records["anchor"] >> np.uint64(40)).astype(np.int64) % buckets
    order = np.argsort(bucket, kind="stable")
    records, bucket = records[order], bucket[order]
    starts = _groups(bucket) if len(bucket) else np.zeros(0, int)
    ends = np.concatenate((starts[1:], [len(bucket)]))
    if len(starts):
        yield pa.RecordBatch.from_arrays([pa.array(bucket[starts], pa.int32()), pa.array([base] * len(starts), pa.int64()), pa.array([0] * len(starts), pa.int32()), pa.array([_columns(records[a:b]) for a, b in zip(starts, ends, strict=True)], pa.binary())], ["bucket", "base", "tag", "data"])


def _columns(records: np.ndarray) -> bytes:
    """Records column by column, which compresses better than row by row."""
    return b"".join(np.ascontiguousarray(records[c]).tobytes() for c in RECORD.names)


def _records(data: bytes) -> np.ndarray:
    n = len(data) // RECORD.itemsize
    out, at = np.empty(n, RECORD), 0
    for c in RECORD.names:
        out[c] = np.frombuffer(data, RECORD[c], n, at)
        at += n * RECORD[c].itemsize
    return out


def _by_document(records: np.ndarray):
    """Records sorted by (doc, tag) and the starts of the documents."""
    records = records[np.lexsort((records["tag"], records["doc"]))]
    return records, _groups(records["doc"], records["tag"]) if len(records) else np.zeros(0, int)


def _places(records: np.ndarray) -> bytes:
    made = np.empty(len(records), PLACE)
    made["place"], made["size"] = records["place"], records["size"]
    return made.tobytes()


def _answers(records: np.ndarray, base: int, bucket):
    """Places that repeat, one row per document."""
    records, starts = _by_document(records)
    if len(starts):
        ends = np.concatenate((starts[1:], [len(records)]))
        docs = records["doc"][starts].astype(np.int64) + base
        yield pa.RecordBatch.from_arrays([pa.array([bucket(int(d)) for d in docs], pa.int32()), pa.array(docs), pa.array(records["tag"][starts].astype(np.int32)), pa.array([_places(records[a:b]) for a, b in zip(starts, ends, strict=True)], pa.binary())], ["bucket", "base", "tag", "data"])


_FOUND = "doc_id long, tag int, places binary, asked binary"


def _compare(batches):
    """Bucket by bucket: copies of a stretch point to its first document, different stretches of an anchor are asked."""
    held: list[np.ndarray] = []
    current = None

    def row_batch(docs, tags, places, asked):
        return pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(tags, pa.int32()), pa.array(places, pa.binary()), pa.array(asked, pa.binary())], ["doc_id", "tag", "places", "asked"])

    def close():
        if not held:
            return
        low = min(int(b) for b, _ in held)
        wide = np.concatenate([np.rec.fromarrays([r[c] if c != "doc" else r["doc"].astype(np.int64) + (b - low) for c in RECORD.names], names=",".join(RECORD.names)) for b, r in held])
        records, first, starts = _first_documents(wide)
        again = records[~first]
        reps = records[starts]
        by_anchor = _groups(reps["anchor"])
        sizes = np.diff(np.concatenate((by_anchor, [len(reps)])))
        several = np.repeat(np.minimum.reduceat(reps["doc"], by_anchor) != np.maximum.reduceat(reps["doc"], by_anchor), sizes)
        length = np.diff(np.concatenate((starts, [len(records)])))
        asked = records[np.repeat(several, length) & first]
        for part, is_asked in ((again, False), (asked, True)):
            part, at = _by_document(part)
            if not len(at):
                continue
            ends = np.concatenate((at[1:], [len(part)]))
            blobs = []
            for a, b in zip(at, ends, strict=True):
                if is_asked:
                    blob = np.empty(b - a, ASKED)
                    blob["place"], blob["size"], blob["anchor"] = part["place"][a:b], part["size"][a:b], part["anchor"][a:b].view(np.int64)
                    blobs.append(blob.tobytes())
                else:
                    blobs.append(_places(part[a:b]))
            empty = [None] * len(blobs)
            yield row_batch(part["doc"][at] + low, part["tag"][at].astype(np.int32), empty if is_asked else blobs, blobs if is_asked else empty)

    for batch in batches:
        buckets = batch.column("bucket").to_numpy()
        done = buckets < 0
        if done.any():
            answered = batch.filter(pa.array(done))
            yield row_batch(answered.column("base"), answered.column("tag"), answered.column("data"), pa.nulls(answered.num_rows, pa.binary()))
        for i in np.flatnonzero(~done):
            if buckets[i] != current:
                yield from close()
                held, current = [], buckets[i]
            held.append((batch.column("base")[int(i)].as_py(), _records(batch.column("data")[int(i)].as_py())))
    yield from close()


_NEAR = "anchor long, doc_id long, tag int, start long, near binary"


def _gather(raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bytes of ranges, one after the other."""
    end = np.cumsum(size)
    return raw[np.repeat(start - (end - size), size) + np.arange(int(size.sum()))]


def _binary(raw: np.ndarray, size: np.ndarray) -> pa.Array:
    """A binary column out of its bytes and the sizes of its values."""
    return pa.BinaryArray.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(np.concatenate(([0], np.cumsum(size))).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(raw))])


def _neighbourhoods(batches):
    """The bytes of the asked stretches of each document."""
    for batch in batches:
        raw, at = utf8(batch.column("text"))
        docs, tags = batch.column("doc_id").to_numpy(), batch.column("tag").to_numpy()
        for a, b in pieces(at, PIECE):
            lists = [np.concatenate([np.frombuffer(x, ASKED) for x in blobs]) for blobs in batch.column("asked").slice(a, b - a).to_pylist()]
            ask = np.concatenate(lists)
            row = np.repeat(np.arange(a, b), [len(x) for x in lists])
            place, size = ask["place"].astype(np.int64), ask["size"].astype(np.int64)
            for c in range(0, len(ask), 500_000):
                d = slice(c, c + 500_000)
                near = _binary(_gather(raw, at[row[d]] + place[d], size[d]), size[d])
                yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(ask["anchor"][d])), pa.array(docs[row[d]]), pa.array(tags[row[d]]), pa.array(place[d]), near], ["anchor", "doc_id", "tag", "start", "near"])


def suffix_array(text: np.ndarray, depth: int = SPAN) -> np.ndarray:
    """Suffixes of up to 2**21 bytes sorted by at least their first ``depth`` bytes, by Larsson-Sadakane refinement.

    The first five bytes give the first ranks. A round sorts only the groups that are still of one rank, by the rank of
    the suffix that starts where the known prefix ends, and doubles the known prefix.
    """
    n = len(text)
    if n > SHARD:
        raise ValueError("a shard holds 2**21 bytes at most")
    if not n:
        return np.zeros(0, np.int64)
    padded = np.concatenate((text.astype(np.uint64), np.zeros(5, np.uint64)))
    key = np.zeros(n, np.uint64)
    for i in range(5):
        key = key << np.uint64(8) | padded[i : i + n]
    mask = np.uint64(SHARD - 1)
    packed = np.sort(key << np.uint64(21) | np.arange(n, dtype=np.uint64))
    order = (packed & mask).astype(np.int64)
    head = packed >> np.uint64(21)
    # a suffix that ends early comes before those its padding ties with, as does its shorter rest
    new = np.concatenate(([True], head[1:] != head[:-1]))
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    begun = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank[order] = begun
    known = 5
    while known < depth:
        last = np.concatenate((new[1:], [True]))
        open_ = np.flatnonzero(~(new & last))  # slots of groups of two or more
        if not len(open_):
            break
        suffix = order[open_]
        after = rank[np.minimum(suffix + known, n)] + 1
        packed = np.sort(rank[suffix].astype(np.uint64) << np.uint64(43) | after.astype(np.uint64) << np.uint64(21) | suffix.astype(np.uint64))
        order[open_] = (packed & mask).astype(np.int64)
        pair = packed >> np.uint64(21)
        fresh = np.concatenate(([True], pair[1:] != pair[:-1]))
        new[open_] = fresh
        begun = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        rank[order[open_]] = begun[open_]
        known *= 2
    return order


def common_prefixes(text: np.ndarray, order: np.ndarray, cap: int = SPAN) -> np.ndarray:
    """Common prefix of each suffix with the one before it in the array, up to ``cap``, by Kasai's scan.

    The scan goes through the text in its order: a place's prefix is at most one byte shorter than that of the place
    before, so each place only reads on from there. After a prefix of ``cap`` a place reads afresh, since suffixes equal
    that far are not in order. Lanes of ``LANE`` places are scanned side by side, eight bytes a step.
    """
    n = len(text)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    padded = np.concatenate((text, np.zeros(8, np.uint8)))
    word = np.zeros(n + 1, np.uint64)
    for i in range(8):
        word |= padded[i : n + 1 + i].astype(np.uint64) << np.uint64(8 * i)
    out = np.zeros(n, np.int64)
    lanes = np.arange(0, n, LANE)
    length = np.zeros(len(lanes), np.int64)
    for turn in range(min(LANE, n)):
        at = lanes + turn
        if at[-1] >= n:
            lanes, at, length = lanes[:-1], at[:-1], length[:-1]
        other = before[at]
        length = np.where((other < 0) | (length == cap), 0, np.maximum(length - 1, 0))
        alive = np.flatnonzero((other >= 0) & (length < cap))
        while len(alive):
            differ = word[np.minimum(at[alive] + length[alive], n)] ^ word[np.minimum(other[alive] + length[alive], n)]
            low = differ & (~differ + np.uint64(1))
            step = np.where(differ == 0, 8, np.bitwise_count(low - np.uint64(1)).astype(np.int64) // 8)
            length[alive] += step
            alive = alive[(step == 8) & (length[alive] < cap)]
        length = np.minimum(np.minimum(length, n - np.maximum(at, other)), cap)
        out[at] = length
    return out[order]


class Merged:
    """Sorted strings of the earlier shards of an anchor with the smallest document of each, searched by halving."""

    def __init__(self):
        self.runs: list[tuple[np.ndarray, np.ndarray]] = []

    def smallest(self, strings: np.ndarray) -> np.ndarray:
        least = np.full(len(strings), np.iinfo(np.int64).max)
        for known, docs in self.runs:
            at = np.minimum(np.searchsorted(known, strings), len(known) - 1)
            least = np.where(known[at] == strings, np.minimum(least, docs[at]), least)
        return least

    def add(self, strings: np.ndarray, docs: np.ndarray) -> None:
        self.runs.append((strings, docs))
        if len(self.runs) > 8:  # two-way merges keep the number of searches small
            joined, every = np.concatenate([r[0] for r in self.runs]), np.concatenate([r[1] for r in self.runs])
            order = np.argsort(joined, kind="stable")
            joined, every = joined[order], every[order]
            starts = _groups(joined)
            self.runs = [(joined[starts], np.minimum.reduceat(every, starts))]


def repeated_windows(text: np.ndarray, at: np.ndarray, docs: np.ndarray, merged: Merged | None = None, keep: bool = False):
    """(stretch, offset) of the strings of 50 that a smaller document of this shard, or of the merged ones, holds.

    The stretches are ``text[at[i] : at[i + 1]]``."""
    order = suffix_array(text)
    group = np.cumsum(common_prefixes(text, order) < SPAN)
    owner = np.searchsorted(at, order, "right") - 1
    whole = order + SPAN <= at[owner + 1]
    order, group, owner = order[whole], group[whole], owner[whole]
    starts = _groups(group) if len(group) else np.zeros(0, int)
    if not len(starts):
        return np.zeros(0, int), np.zeros(0, int)
    least = np.minimum.reduceat(docs[owner], starts)
    sizes = np.diff(np.concatenate((starts, [len(group)])))
    if merged is not None and (merged.runs or keep):
        strings = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(text, SPAN)[order[starts]]).view(f"S{SPAN}").ravel()
        own, least = least, np.minimum(least, merged.smallest(strings)) if merged.runs else least
        if keep:
            merged.add(strings, own)
    repeats = docs[owner] > np.repeat(least, sizes)
    return owner[repeats], order[repeats] - at[owner[repeats]]


_SPANS = "doc_id long, tag int, spans binary"


def _shards(batches):
    """Stretches come sorted by (anchor, doc_id): shards of whole anchors, or of a part of an anchor too large for one."""
    names = ("anchor", "doc_id", "tag", "start")
    held: list[tuple] = []  # columns, the bytes, and their sizes
    size = 0
    merged, of = None, None

    def run(columns, text, at, keep):
        nonlocal merged, of
        anchor, docs, tags, base = columns
        if not (merged is not None and of == anchor[0]):
            merged, of = (Merged(), anchor[0]) if keep else (None, None)
        owner, offset = repeated_windows(text, at, docs, merged, keep)
        if not len(owner):
            return
        start = base[owner] + offset
        sort = np.lexsort((start, tags[owner], docs[owner]))
        doc, tag, start = docs[owner][sort], tags[owner][sort], start[sort]
        new = np.ones(len(doc), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1]) | (start[1:] > start[:-1] + SPAN)
        heads = np.flatnonzero(new)
        pairs = np.column_stack((start[heads], start[np.concatenate((heads[1:] - 1, [len(doc) - 1]))] + SPAN)).astype("<i8")
        rows = _groups(doc[heads], tag[heads])
        ends = np.concatenate((rows[1:], [len(heads)]))
        yield pa.RecordBatch.from_arrays([pa.array(doc[heads][rows]), pa.array(tag[heads][rows], pa.int32()), _binary(pairs.view(np.uint8).ravel(), (ends - rows) * 16)], ["doc_id", "tag", "spans"])

    def close(final: bool):
        """Runs what is held, all of it or up to its last anchor."""
        nonlocal held, size
        if not held:
            return
        columns = [np.concatenate([h[0][i] for h in held]) for i in range(len(names))]
        text, sizes = np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held])
        at = np.concatenate(([0], np.cumsum(sizes)))
        heads = _groups(columns[0])
        cuts = [0]
        if of is not None and columns[0][0] == of and len(heads) > 1:  # the first anchor goes on from the shard before
            cuts.append(int(heads[1]))
        rest = len(sizes)
        if not final and len(heads) > 1:
            rest = int(heads[-1])
        cuts = [c for c in cuts if c < rest] + [rest]
        for a, b in zip(cuts, cuts[1:], strict=False):
            whole = final and not (of is not None and columns[0][a] == of) or b < len(sizes)
            keep = not whole or (of is not None and columns[0][a] == of)
            yield from run([c[a:b] for c in columns], text[at[a] : at[b]], at[a : b + 1] - at[a], keep)
        held = [([c[rest:] for c in columns], text[at[rest] :], sizes[rest:])] if rest < len(sizes) else []
        size = len(text) - int(at[rest])

    for batch in batches:
        if not batch.num_rows:
            continue
        near = batch.column("near")
        offsets = np.frombuffer(near.buffers()[1], np.int32)[near.offset : near.offset + len(near) + 1].astype(np.int64)
        raw = np.frombuffer(near.buffers()[2], np.uint8)
        columns = [batch.column(c).to_numpy() for c in names]
        for a, b in pieces(offsets, SHARD // 4):
            more = int(offsets[b] - offsets[a])
            if held and size + more > SHARD:
                yield from close(False)
                if held and size + more > SHARD:
                    yield from close(False)
            held.append(([c[a:b].copy() for c in columns], raw[offsets[a] : offsets[b]].copy(), np.diff(offsets[a : b + 1])))
            size += more
    yield from close(True)


def _keep(batches):
    for batch in batches:
        every, offsets = utf8(batch.column("text"))
        for a, b in pieces(offsets, PIECE):
            raw, at = every[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
            starts, ends = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            own = batch.slice(a, b - a)
            for base, places, spans in zip(at[:-1], own.column("places").to_pylist(), own.column("spans").to_pylist(), strict=True):
                for place in places or ():
                    p = np.frombuffer(place, PLACE)
                    first = p["place"].astype(np.int64) + base
                    starts.append(first)
                    ends.append(first + p["size"])
                for span in spans or ():
                    pair = np.frombuffer(span, "<i8").reshape(-1, 2) + base
                    starts.append(pair[:, 0])
                    ends.append(pair[:, 1])
            n = len(raw)
            depth = np.bincount(np.concatenate(starts), minlength=n + 1) - np.bincount(np.concatenate(ends), minlength=n + 1)
            gone = np.cumsum(depth[:-1]) > 0
            begun = gone.copy()
            begun[1:] &= ~gone[:-1]
            begun[at[:-1][at[:-1] < n]] = gone[at[:-1][at[:-1] < n]]
            removed, heads = segment_sums(gone.astype(np.int64), at), segment_sums(begun.astype(np.int64), at)
            size = np.diff(at)
            yield pa.RecordBatch.from_arrays([own.column("doc_id"), pa.array(size), pa.array(removed), pa.array(heads), _binary(raw[~gone], size - removed)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])


def _tagged(docs: DataFrame) -> DataFrame:
    """(doc_id, text, tag): 0, and 1, 2, ... for the further texts of a doc_id (by a 64-bit hash of the text)."""
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("hash"))
    number = F.row_number().over(W.partitionBy("doc_id").orderBy("hash")) - 1
    further = rows.where(F.col("doc_id").isNotNull()).select("doc_id", "hash").distinct().withColumn("tag", number).where("tag > 0")
    further = materialize(further, "further-texts")  # written, so Spark knows its size: mostly nothing, which it sends to all tasks
    return rows.join(further, ["doc_id", "hash"], "left").select("doc_id", "text", F.coalesce("tag", F.lit(0)).alias("tag"))


def dedup_substrings(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept): every document without the bytes it repeats, as bytes."""
    spark = docs.sparkSession
    tagged = _tagged(docs)
    long = tagged.where(F.col("doc_id").isNotNull() & (F.octet_length("text") >= SPAN))
    buckets = shuffle_partitions(spark) * BUCKETS_A_PARTITION
    sent = long.mapInArrow(_send(buckets), _SENT).repartition("bucket").sortWithinPartitions("bucket")
    found = materialize(sent.mapInArrow(_compare, _FOUND), "anchors-found")
    del sent
    release(spark)
    asked = found.where(F.col("asked").isNotNull()).groupBy("doc_id", "tag").agg(F.collect_list("asked").alias("asked"))
    near = long.join(asked, ["doc_id", "tag"]).mapInArrow(_neighbourhoods, _NEAR)
    shards = near.repartition("anchor").sortWithinPartitions("anchor", "doc_id")
    spans = materialize(shards.mapInArrow(_shards, _SPANS), "repeated-spans")
    del near, shards
    release(spark)
    places = found.where(F.col("places").isNotNull()).select("doc_id", "tag", "places", F.lit(None).cast("binary").alias("spans"))
    every = places.unionByName(spans.select("doc_id", "tag", F.lit(None).cast("binary").alias("places"), "spans"))
    lists = every.groupBy("doc_id", "tag").agg(F.collect_list("places").alias("places"), F.collect_list("spans").alias("spans"))
    return tagged.join(lists, ["doc_id", "tag"], "left").mapInArrow(_keep, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def op2_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = dedup_substrings(documents(spark, sf_dir))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
