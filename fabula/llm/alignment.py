"""Cross-tokenizer alignment: which tokens of one vocabulary stand for which of another.

Both tokenizers cover the same bytes. Where a token of each ends at one byte, the text can be cut, and between two cuts
stands a group. Groups are found by divide and conquer: a common end near the middle of an interval is located by bisection,
outward from the middle token, both halves are treated likewise, and an interval without a common end is a group.

White space that begins after another character starts a new token in both vocabularies, so a text's words with the blanks
before them are intervals whose ends are common; a word's tokens, groups and links are worked out once in a worker and kept
(twice ``KEPT`` words at most). A group of m and n tokens has m + n - 1 overlapping pairs, since no two of its inner ends meet.

Texts are encoded once: each document's distinct pairs of ids are written with it. How often a pair is linked is added up over
the corpus in every task and then by a grouping, and so is the highest count of each B id. These counts go to all tasks while
there are at most ``SHARED_PAIRS`` of them; beyond that the documents' pairs are joined to them, with the same sums.

Defined cases: null and empty texts, and texts whose joined bytes differ from space + text (a text that holds U+2581 itself),
have zeros and an empty ``groups_sha256``; repeated rows are rows of their own; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from array import array
from bisect import bisect_left
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fabula.llm.common import documents, materialize, pieces, segment_sums, utf8

VOCABULARY_A, VOCABULARY_B = "byte_bpe_50k.json", "piece_bpe_32k.model"
KEPT = 300_000
#: Pairs of ids (24 bytes each) that every worker may hold.
SHARED_PAIRS = 4_000_000
PIECE = 2_000_000
#: A word with the blanks before it: it ends where a space or line end follows a character that is not white space.
WORD = re.compile(r"[ \n]*+[^ \n]++(?<=\S)(?=[ \n])|.*?\S(?=[ \n])|.+", re.S)
#: The same, ending also between a letter and closing marks, for a vocabulary that has no piece across them.
LETTER = "[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u017e]"
WORD_OR_MARKS = re.compile(rf"[ \n]*+{LETTER}++(?=[.,;:!?]++(?:[ \n]|$))|[.,;:!?]++(?=[ \n])|" + WORD.pattern, re.S)


def groups(ends_a: list[int], ends_b: list[int]) -> list[tuple[int, int, int, int]]:
    """Groups (a from, a to, b from, b to), in order, of two token sequences by the byte ends of their tokens."""
    found, open_ = [], [(0, len(ends_a), 0, len(ends_b))]
    while open_:
        a, b, c, d = interval = open_.pop()
        if b - a > 1 and d - c > 1:
            low = high = (a + b) // 2 - 1
            while True:
                if low >= a:
                    end = ends_a[low]
                    j = bisect_left(ends_b, end, c, d - 1)
                    if j < d - 1 and ends_b[j] == end:
                        open_.append((low + 1, b, j + 1, d))
                        open_.append((a, low + 1, c, j + 1))  # the left half is taken first
                        break
                    low -= 1
                high += 1
                if high < b - 1:
                    end = ends_a[high]
                    j = bisect_left(ends_b, end, c, d - 1)
                    if j < d - 1 and ends_b[j] == end:
                        open_.append((high + 1, b, j + 1, d))
                        open_.append((a, high + 1, c, j + 1))
                        break
                elif low < a:
                    found.append(interval)
                    break
        else:
            found.append(interval)
    return found


def overlaps(ends_a: list[int], ends_b: list[int], group: tuple[int, int, int, int]) -> list[tuple[int, int]]:
    """The pairs (a, b) of a group's tokens whose bytes overlap: from pair to pair the token that ends first is passed."""
    i, b, j, d = group
    pairs = [(i, j)]
    while i < b - 1 or j < d - 1:
        if j == d - 1 or i < b - 1 and ends_a[i] < ends_b[j]:
            i += 1
        else:
            j += 1
        pairs.append((i, j))
    return pairs


class Vocabularies:
    """The two tokenizers, with the bytes of their tokens."""

    #: Words of these characters are one piece (or letters and a run of marks) for A's splitter, whatever engine runs it.
    SIMPLE = re.compile(r" ?(?:[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u017e]+|[.,;:!?]+)")

    def __init__(self, path_a: str, path_b: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        import sentencepiece
        from tokenizers import Tokenizer, pre_tokenizers

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True  # their strings in a text are plain text
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        byte_of = {}
        for point in (*range(0x80), *range(0x80, 0x800), *range(0x800, 0xD800, 0x800), *range(0xE000, 0x10000, 0x800), *range(0x10000, 0x110000, 0x8000)):  # how the byte level writes each byte
            byte_of |= dict(zip(level.pre_tokenize_str(chr(point))[0][0], chr(point).encode(), strict=True))
        for byte in set(range(256)) - set(byte_of.values()):  # no text has these; they are written as the character of the same number
            byte_of[chr(byte)] = byte
        tokens = [self.a.id_to_token(i) for i in range(self.a.get_vocab_size(with_added_tokens=False))]
        self.bytes_a = [bytes([byte_of[c] for c in t]) for t in tokens]
        self.bytes_b = [self._piece(i) for i in range(self.b.vocab_size())]
        self.blank = self.b.piece_to_id("\u2581")
        if any(re.search(r"[^ ][ \n]|\n[^\n]", t.decode("utf-8", "replace")) for t in self.bytes_b):
            raise ValueError("a piece of the second vocabulary goes on behind white space")
        self.ranked = self._ranked(path_a)

    def _ranked(self, path: str):
        """The first vocabulary's merges, if they stand in the order of the ids they make, for an engine that is quick on short words."""
        import tiktoken

        with open(path, encoding="utf-8") as f:
            merges = json.load(f)["model"]["merges"]
        joined = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in merges]
        if [self.a.token_to_id(m) for m in joined] != list(range(256, 256 + len(merges))):
            return None
        ranks = {t: i for i, t in enumerate(self.bytes_a[: 256 + len(merges)])}
        return tiktoken.Encoding("own", pat_str=r" ?\p{L}+| ?[^\s\p{L}]+|\s+", mergeable_ranks=ranks, special_tokens={})

    def _piece(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("\u2581", " ").encode()

    def encode(self, words: list[str]) -> list[tuple[list[int], list[int]]]:
        """Ids of both for each word (with its blanks). B adds a space of its own: for a word's first space, or to be dropped."""
        simple = self.SIMPLE.fullmatch
        quick = [self.ranked is not None and simple(w) is not None for w in words]
        rest = iter(self.a.encode_batch([w for w, q in zip(words, quick, strict=True) if not q], add_special_tokens=False))
        one = self.ranked.encode_ordinary if self.ranked else None
        ids_a = [one(w) if q else next(rest).ids for w, q in zip(words, quick, strict=True)]
        ids_b = self.b.encode([w[1:] if w[0] == " " else w for w in words], num_threads=1)
        blank = self.blank
        for k, w in enumerate(words):
            if w == " ":
                ids_b[k] = [blank]
            elif w[0] != " ":  # where the added space went into a piece, the word is encoded behind a character that joins nothing
                ids_b[k] = ids_b[k][1:] if ids_b[k][0] == blank else self.b.encode("\n" + w)[2:]
        return list(zip(ids_a, ids_b, strict=True))


class Aligner(dict):
    """Words, with the blanks before them, to (tokens of A, of B, groups, groups as text, links as bytes) or None where bytes differ."""

    def __init__(self, path_a: str, path_b: str):
        self.both = Vocabularies(path_a, path_b)
        marks = any(re.search(LETTER + "[.,;:!?]", t.decode("utf-8", "replace")) for t in self.both.bytes_b)
        self.split = (WORD if marks else WORD_OR_MARKS).findall
        self.text = [str(i) for i in range(max(len(self.both.bytes_a), len(self.both.bytes_b)))]
        self.older: dict = {}

    def _made(self, word: str, a: list[int], b: list[int]):
        both, text = self.both, self.text
        parts_a, parts_b, raw = [both.bytes_a[i] for i in a], [both.bytes_b[i] for i in b], word.encode()
        if b"".join(parts_a) != raw or b"".join(parts_b) != raw:
            return None
        if len(a) == 1 or len(b) == 1:  # no cut inside
            links = [i << 32 | j for i in a for j in b]
            return len(a), len(b), 1, ",".join([text[i] for i in a]) + "|" + ",".join([text[i] for i in b]), array("q", links).tobytes()
        ends_a, ends_b = list(accumulate(map(len, parts_a))), list(accumulate(map(len, parts_b)))
        found, links, shown = groups(ends_a, ends_b), [], []
        for i, j, k, m in found:
            if j - i == 1 and m - k == 1:
                links.append(a[i] << 32 | b[k])
                shown.append(text[a[i]] + "|" + text[b[k]])
            else:
                links += [a[x] << 32 | b[y] for x, y in overlaps(ends_a, ends_b, (i, j, k, m))]
                shown.append(",".join([text[x] for x in a[i:j]]) + "|" + ",".join([text[y] for y in b[k:m]]))
        return len(a), len(b), len(found), ";".join(shown), array("q", links).tobytes()

    def learn(self, words: set[str]) -> None:
        if len(self) > KEPT:
            self.older = dict(self)
            self.clear()
        new = words.difference(self)
        if self.older:
            old = self.older
            met = {w: old[w] for w in new if w in old}
            self.update(met)
            new.difference_update(met)
        new = list(new)
        for w, (a, b) in zip(new, self.both.encode(new) if new else [], strict=True):
            self[w] = self._made(w, a, b)


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def aligner(paths: tuple[str, str]) -> Aligner:
    """One for each Python worker and pair of files."""
    if paths not in _ALIGNERS:
        _ALIGNERS[paths] = Aligner(*paths)
    return _ALIGNERS[paths]


def _aligned(batch: pa.RecordBatch, paths: tuple[str, str]):
    """For pieces of a batch: first row, and for each of its rows the entries of its words, or None."""
    own = aligner(paths)
    for a, b in pieces(utf8(batch.column("text"))[1], PIECE):
        split = [own.split(" " + t) if t else [] for t in batch.column("text").slice(a, b - a).to_pylist()]
        own.learn({w for words in split for w in words})
        rows = []
        for words in split:
            entries = [own[w] for w in words]
            rows.append(entries if entries and None not in entries else None)
        yield a, rows


FIELDS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]


def aligned_documents(docs: DataFrame, paths: tuple[str, str]) -> DataFrame:
    """FIELDS of every row with the distinct pairs of ids it links (A id times 2^32 plus B id) and how often; written, so texts are read once."""

    def aligned(batches):
        for batch in batches:
            for start, rows in _aligned(batch, paths):
                sums = np.array([tuple(map(sum, zip(*[e[:3] for e in entries], strict=True))) if entries else (0, 0, 0) for entries in rows], np.int64).reshape(-1, 3)
                sha = [hashlib.sha256(";".join([e[3] for e in entries]).encode()).hexdigest() if entries else "" for entries in rows]
                links = [np.unique(np.frombuffer(b"".join([e[4] for e in entries or ()]), np.int64), return_counts=True) for entries in rows]
                at = pa.array(np.cumsum([0, *[len(x) for x, _ in links]]), pa.int32())
                lists = [pa.ListArray.from_arrays(at, pa.array(np.concatenate([x[i] for x in links]), kind)) for i, kind in ((0, pa.int64()), (1, pa.int32()))]
                made = [pa.array(x) for x in (sums[:, 0], sums[:, 1], sums[:, 2], sums[:, 0] + sums[:, 1] - sums[:, 2], sha)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(start, len(rows)), *made, *lists], [*FIELDS, "pair", "times"])

    made = docs.select("doc_id", "text").mapInArrow(aligned, "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pair array<long>, times array<int>")
    return materialize(made, "aligned")


def _flat(batch: pa.RecordBatch):
    """The pairs, the times and the n + 1 offsets of a batch's lists."""
    size = batch.column("pair").value_lengths().to_numpy(zero_copy_only=False)
    return batch.column("pair").flatten().to_numpy(), batch.column("times").flatten().to_numpy().astype(np.int64), np.concatenate(([0], np.cumsum(size, dtype=np.int64)))


def corpus_pairs(rows: DataFrame) -> DataFrame:
    """(pair, n, best): how many links of the corpus hold each pair of ids, and whether that is its B id's highest, ties included."""

    def counted(batches):
        keys = n = np.zeros(0, np.int64)
        for batch in batches:
            pair, times, _ = _flat(batch)
            keys, at = np.unique(np.concatenate([keys, pair]), return_inverse=True)
            n = np.bincount(at, np.concatenate([n, times]), minlength=len(keys)).astype(np.int64)
            if len(keys) > SHARED_PAIRS:  # a task passes its counts on when it holds many
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], ["pair", "n"])
                keys = n = np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], ["pair", "n"])

    part = rows.select("pair", "times").mapInArrow(counted, "pair long, n long")
    counts = materialize(part.groupBy("pair").agg(F.sum("n").alias("n")), "pair-counts")
    b_id = F.col("pair").bitwiseAND(F.lit((1 << 32) - 1))
    highest = counts.groupBy(b_id.alias("b")).agg(F.max("n").alias("most"))  # a row for each B id
    return materialize(counts.join(highest, b_id == F.col("b")).select("pair", "n", (F.col("n") == F.col("most")).alias("best")), "pairs")


def align(docs: DataFrame, path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every whole text."""
    rows = aligned_documents(docs, (path_a or vocabulary_path(VOCABULARY_A), path_b or vocabulary_path(VOCABULARY_B)))
    pairs = corpus_pairs(rows)
    if pairs.limit(SHARED_PAIRS + 1).count() > SHARED_PAIRS:
        return _joined(rows, pairs)
    got = pairs.toArrow()  # SHARED_PAIRS rows at most
    order = np.argsort(got.column("pair").to_numpy())
    shared = docs.sparkSession.sparkContext.broadcast([got.column(c).to_numpy()[order] for c in ("pair", "n", "best")])

    def told(batches):
        keys, n, best = shared.value
        for batch in batches:
            pair, times, offsets = _flat(batch)
            at = np.searchsorted(keys, pair)
            sums = [pa.array(segment_sums(x[at] * times, offsets)) for x in (best, n)]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in FIELDS[:5]], *sums, batch.column("groups_sha256")], [*FIELDS[:5], "n_best", "count_sum", "groups_sha256"])

    return rows.mapInArrow(told, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


def _joined(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """The same where the counts are many: each row's distinct pairs are joined to them."""
    rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()), "aligned")  # numbers are fixed once written
    each = rows.select("row", F.inline(F.arrays_zip("pair", "times"))).join(pairs, "pair")
    sums = each.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    zero = F.lit(0).cast("long")
    return rows.join(sums, "row", "left").select(*FIELDS[:5], F.coalesce("n_best", zero).alias("n_best"), F.coalesce("count_sum", zero).alias("count_sum"), "groups_sha256")


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(documents(spark, sf_dir).select("doc_id", "text"))
