"""Token ids as files of directly addressable codes.

Texts are encoded by a public tokenizer, an end id is appended to each document, and the ids of documents in ascending
doc_id order go into binary files. An id is split into 8-bit chunks: level 0 holds everybody's lowest chunk, a bitmap says
whose id continues, and a rank directory (set bits before each 512) finds an id's next chunk in level 1, and so on. Any
token is read with one byte and one rank per level, without decoding a block.

File: ``DAC2``, then u64 documents, ids and levels; i64 doc_ids; u8 whether a document has an id; u64 ends of documents; for each level u64 chunks, the
chunks, the bitmap padded to 64 bytes, and u64 rank directory; little-endian throughout.

Defined cases: a null or empty text is its end id alone; a null doc_id comes first and reads
back as null; rows that repeat a doc_id follow each other, by text; an empty table gives no file. Files are written under names of their own, and a table of the files of finished tasks says which
count, so a task that runs twice does no harm.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fabula.llm.common import documents, fresh_path, materialize, pieces, shuffle_partitions, utf8

VOCABULARY = "word_bpe_49k.json"
END_ID = 2
FILE_IDS = 1 << 22
CHUNK = 8
BLOCK = 512
MAGIC = b"DAC2"
BATCH_BYTES = 4_000_000
READ_IDS = 1 << 18


class WordEncoder(dict):
    """Encodes texts with a tokenizer file, keeping the ids of the words it has met (twice ``KEPT`` at most).

    The tokenizer lower-cases, splits at white space and into pieces, and encodes each piece alone. For texts of the
    characters in ``PLAIN``, whose case and pieces Python's ``re`` sees as the tokenizer does, words are split here and
    only new pieces go to the tokenizer's model; other texts go to the tokenizer whole. So do texts that hold an added token:
    ``added`` gives these their one id, as a tokenizer's default has it; else special ones are ordinary text.
    """

    PLAIN = re.compile("[\\t\\n\\r\\x20-\\x7e\\xa1-\\xac\\xae-\\xb1\\xb4-\\xb8\\xba\\xbb\\xbf-\\u012f\\u0132-\\u0148\\u014a-\\u017e\\u0410-\\u044f\\u2010-\\u2027]*")
    PIECE = re.compile(r"[^\W\d_]+|'(?:s|t|re|ve|m|ll|d)|\d|(?:[^\s\w]|_)+")
    STOPS = ".,;:!?"
    KEPT = 300_000

    def __init__(self, path: str, added: bool = False):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not added
        self.names = {t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values() if added or not t.special}
        self.model = self.tokenizer.model
        self.older: dict[str, bytes] = {}
        alphabet = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        shown = {b: alphabet.pre_tokenize_str(chr(b))[0][0] for b in range(33, 127)}
        shown |= {b: alphabet.pre_tokenize_str(c)[0][0][-1] for c in map(chr, range(128, 2048)) for b in c.encode()[-1:]}
        shown |= {c.encode()[0]: alphabet.pre_tokenize_str(c)[0][0][0] for c in map(chr, (*range(128, 2048, 64), *range(2048, 0xD800, 4096), *range(0xE000, 0x10000, 4096)))}
        self.shown = {k: v for k, v in shown.items() if chr(k) != v}

    def __missing__(self, word: str) -> bytes:
        made = self.older.get(word)
        if made is None:
            letters = word.rstrip(self.STOPS)
            if letters and letters != word and letters.isalpha():
                made = self[letters] + self[word[len(letters) :]]
            else:
                found: list[int] = []
                for piece in (word,) if word.isascii() and word.isalpha() else self.PIECE.findall(word):
                    if not piece.isascii():
                        piece = piece.encode().decode("latin-1").translate(self.shown)
                    found += [t.id for t in self.model.tokenize(piece)]
                made = struct.pack(f"={len(found)}I", *found)
        self[word] = made
        return made

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self) > self.KEPT:  # words met of late are still at hand
            self.older = dict(self)
            self.clear()
        get, plain, names = self.__getitem__, self.PLAIN.fullmatch, self.names
        made = []
        for t in texts:
            low = t.lower()
            if plain(t) and not any(n in low for n in names):
                made.append(np.frombuffer(b"".join(map(get, low.split())), np.uint32))
            else:
                made.append(np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, np.uint32))
        return made


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder for each Python worker and file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path, added=True)
    return _ENCODERS[path]


class DirectCodes:
    """Random access to unsigned ids held as levels of chunks."""

    def __init__(self, levels):
        self.levels = levels  # (chunks, bitmap words as bytes, rank directory)

    @classmethod
    def of(cls, ids: np.ndarray) -> DirectCodes:
        levels, rest = [], ids.astype(np.uint64)
        while True:
            more = rest >> np.uint64(CHUNK)
            goes_on = more > 0
            bits = np.packbits(goes_on, bitorder="little")
            bits = np.concatenate((bits, np.zeros(-len(bits) % (BLOCK // 8), np.uint8)))
            ones = np.bitwise_count(bits.view(np.uint64)).astype(np.uint64).reshape(-1, BLOCK // 64).sum(1)
            levels.append(((rest & np.uint64(255)).astype(np.uint8), bits, np.concatenate(([0], np.cumsum(ones)))[:-1].astype(np.uint64)))
            if not goes_on.any():
                return cls(levels)
            rest = more[goes_on]

    def __len__(self) -> int:
        return len(self.levels[0][0])

    def at(self, places: np.ndarray) -> np.ndarray:
        """The ids at any places."""
        out = np.zeros(len(places), np.uint64)
        alive, at = np.arange(len(places)), np.asarray(places, np.int64)
        for depth, (chunks, bits, ranks) in enumerate(self.levels):
            out[alive] |= chunks[at].astype(np.uint64) << np.uint64(CHUNK * depth)
            goes_on = (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
            alive, at = alive[goes_on], at[goes_on]
            if not len(alive):
                break
            # set bits before a place: those of its 512-bit block's start, of the whole words between, of its own word
            words = bits.view(np.uint64)
            word, block = at >> 6, at >> 9
            rank = ranks[block].astype(np.int64)
            for k in range(BLOCK // 64 - 1):
                full = (block << 3) + k < word
                rank += np.where(full, np.bitwise_count(words[np.minimum((block << 3) + k, word)]), 0)
            below = words[word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1))
            at = rank + np.bitwise_count(below)
        return out.astype(np.uint32)


def pack(doc_ids: list[int | None], ends: np.ndarray, codes: DirectCodes) -> bytes:
    known = np.array([d is not None for d in doc_ids], np.uint8)
    parts = [MAGIC, struct.pack("<3Q", len(doc_ids), len(codes), len(codes.levels)), np.array([d or 0 for d in doc_ids], "<i8").tobytes(), known.tobytes(), ends.astype("<u8").tobytes()]
    for chunks, bits, ranks in codes.levels:
        parts += [struct.pack("<Q", len(chunks)), chunks.tobytes(), bits.tobytes(), ranks.astype("<u8").tobytes()]
    return b"".join(parts)


def unpack(data: bytes) -> tuple[pa.Array, np.ndarray, DirectCodes]:
    if data[:4] != MAGIC:
        raise ValueError("not a file of direct codes")
    docs, _, depth = struct.unpack_from("<3Q", data, 4)
    at = 28

    def take(kind: str, n: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(data, kind, n, at).copy()
        at += out.nbytes
        return out

    doc_ids, known, ends = take("<i8", docs), take("u1", docs), take("<u8", docs)
    levels = []
    for _ in range(depth):
        (n,) = struct.unpack_from("<Q", data, at)
        at += 8
        blocks = -(-n // BLOCK)
        levels.append((take("u1", n), take("u1", blocks * BLOCK // 8), take("<u8", blocks)))
    return pa.array(doc_ids, mask=known == 0), ends, DirectCodes(levels)


FILES = "part int, seq int, path string, n_docs long, n_ids long"


def write_files(docs: DataFrame, folder: str, vocabulary: str, end_id: int = END_ID, file_ids: int = FILE_IDS, order: tuple = ("doc_id", "text")) -> DataFrame:
    """Encode documents in ascending doc_id order (or another) into files; returns the table of files (written, so fixed)."""

    def written(batches):
        fs, base = pafs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        part, seq = TaskContext.get().partitionId(), 0
        ids, doc_ids, held = [], [], 0

        def flush():
            nonlocal seq, ids, doc_ids, held
            ends = np.cumsum([len(x) for x in ids])
            name = f"part-{part:05d}-{seq:05d}-{uuid.uuid4().hex}.dac"
            with fs.open_output_stream(f"{base}/{name}") as out:
                out.write(pack(doc_ids, ends, DirectCodes.of(np.concatenate(ids))))
            row = [part, seq, f"{folder}/{name}", len(ids), int(ends[-1])]
            seq, ids, doc_ids, held = seq + 1, [], [], 0
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["part", "seq", "path", "n_docs", "n_ids"])

        for batch in batches:
            for a, b in pieces(utf8(batch.column("text"))[1], BATCH_BYTES):
                own = batch.slice(a, b - a)
                for doc, made in zip(own.column("doc_id").to_pylist(), encoder(vocabulary).encode([t or "" for t in own.column("text").to_pylist()]), strict=True):
                    ids.append(np.append(made, np.uint32(end_id)))
                    doc_ids.append(doc)
                    held += len(made) + 1
                    if held >= file_ids:
                        yield flush()
        if ids:
            yield flush()

    ordered = docs.repartitionByRange(*[c for c in order if c != "text"]).sortWithinPartitions(*order).select("doc_id", "text")
    return materialize(ordered.mapInArrow(written, FILES), "token-files")


def read_files(files: DataFrame, end_id: int = END_ID) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from the files; the running start is over one row per file."""
    based = files.withColumn("base", F.sum("n_ids").over(W.orderBy("part", "seq")) - F.col("n_ids"))

    def read(batches):
        for batch in batches:
            for path, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist(), strict=True):
                fs, place = pafs.FileSystem.from_uri(path)
                with fs.open_input_stream(place) as source:
                    doc_ids, ends, codes = unpack(source.read())
                ends = ends.astype(np.int64)
                starts, crcs = np.concatenate(([0], ends[:-1])), []
                for a, b in pieces(np.concatenate(([0], ends)), READ_IDS):
                    ids = codes.at(np.arange(starts[a], ends[b - 1])).astype("<u4")
                    crcs += [zlib.crc32(ids[x:y]) for x, y in zip(starts[a:b] - starts[a], ends[a:b] - starts[a], strict=True)]
                yield pa.RecordBatch.from_arrays([doc_ids, pa.array(starts + base), pa.array(ends - starts), pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    # a number given outright, or adaptive execution would put these few small rows, and so all files, into one task
    spread = based.select("path", "base").repartition(max(1, min(files.count(), 8 * shuffle_partitions(files.sparkSession))))
    return spread.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def token_output(docs: DataFrame, vocabulary: str | None = None, order: tuple = ("doc_id", "text")) -> DataFrame:
    """Write the files in the shared folder, read them back, and return each document's place and checksum."""
    folder = fresh_path(docs.sparkSession, "token-ids")
    return read_files(write_files(docs, folder, vocabulary or vocabulary_path(), order=order))


def op3_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output(documents(spark, sf_dir).select("doc_id", "text"))
