"""Reversible line dedup: sharded cuckoo filters in front of exact reference counts.

A line's key is the line stripped of ``[\\x20\\x09-\\x0D]`` with A-Z lower-cased. The state is three written tables: references
(key, doc_id), exact counts per key, and for each shard of the key space the cuckoo filter of its repeated keys. A reference
asks the stored filter first, and only hits are looked up in the exact counts. Inserting documents adds their new references
to the counts and the keys that become repeated to the filters; deleting them takes theirs away, recounts the touched keys
from the references left, and takes keys that are repeated no more out of the filters, so a deletion gives the state without
them. Only a filter that runs full is built anew, from its shard's exact counts.

Defined cases: a null or empty text is one empty line; rows that repeat a doc_id are one document for the counts and
lose the same lines; a null doc_id holds no references, so its lines stay.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fabula.llm.common import LOWER, TRIM, UPPER, documents, materialize, mix64, new_name, shuffle_partitions

MIN_CHARS = 20
MIN_DOCS = 3
SALTS = 16
#: A key with more than 1 / HEAVY of all references is salted; there are fewer than HEAVY such keys, which bounds the broadcast.
HEAVY = 2000
#: Repeated keys of a shard, at most, when a state is begun.
SHARD_KEYS = 1_000_000
#: Filters of up to this many bytes together go to all tasks, so that only hits are shuffled; larger ones are met shard by shard.
FILTER_BYTES = 32 << 20


class CuckooFilter:
    """16-bit fingerprints, four slots a bucket, of 64-bit keys; inserts, lookups and deletions on whole arrays."""

    SLOTS = 4

    def __init__(self, capacity: int):
        buckets = 1
        while buckets * self.SLOTS * 0.8 < max(capacity, 1):
            buckets *= 2
        self.table = np.zeros((buckets, self.SLOTS), np.uint16)

    def _places(self, keys: np.ndarray):
        h = mix64(keys)
        prints = (h & np.uint64(0xFFFF)).astype(np.uint16)
        prints[prints == 0] = 1
        mask = np.uint64(len(self.table) - 1)
        first = (h >> np.uint64(32)) & mask
        return prints, first, first ^ (mix64(prints.astype(np.uint64)) & mask)

    def contains(self, keys: np.ndarray) -> np.ndarray:
        prints, first, second = self._places(keys)
        return (self.table[first] == prints[:, None]).any(1) | (self.table[second] == prints[:, None]).any(1)

    def insert(self, keys: np.ndarray) -> None:
        """Adds distinct keys; the table doubles when a key finds no place (its fingerprints are then set anew by the caller)."""
        prints, at, other = self._places(keys)
        mask = np.uint64(len(self.table) - 1)
        rng = np.random.default_rng(len(keys))
        for turn in range(500):
            if not len(prints):
                return
            for _ in range(self.SLOTS):  # one key a bucket and pass, into its first free slot
                _, one = np.unique(at, return_index=True)
                free = self.table[at[one]] == 0
                fits = free.any(1)
                one = one[fits]
                self.table[at[one], free[fits].argmax(1)] = prints[one]
                left = np.ones(len(prints), bool)
                left[one] = False
                prints, at, other = prints[left], at[left], other[left]
                if not len(prints):
                    return
            if turn % 2 == 0:
                at, other = other, at
            else:  # kick out one fingerprint of each full bucket
                _, one = np.unique(at, return_index=True)
                slot = rng.integers(0, self.SLOTS, len(one))
                out = self.table[at[one], slot].copy()
                self.table[at[one], slot] = prints[one]
                live = out != 0
                moved = at[one][live] ^ (mix64(out[live].astype(np.uint64)) & mask)
                left = np.ones(len(prints), bool)
                left[one] = False
                prints = np.concatenate((prints[left], out[live]))
                at, other = np.concatenate((at[left], moved)), np.concatenate((other[left], at[one][live]))
        raise OverflowError("cuckoo filter is full")

    def delete(self, keys: np.ndarray) -> None:
        """Takes away one fingerprint of each key, which must have been inserted."""
        for p, a, b in zip(*self._places(keys), strict=True):
            for bucket in (a, b):
                hit = np.flatnonzero(self.table[bucket] == p)
                if len(hit):
                    self.table[bucket, hit[0]] = 0
                    break

    def dumps(self) -> bytes:
        return self.table.tobytes()

    @classmethod
    def loads(cls, data: bytes) -> CuckooFilter:
        made = cls(0)
        made.table = np.frombuffer(data, np.uint16).reshape(-1, cls.SLOTS).copy()
        return made

    @classmethod
    def of(cls, keys: np.ndarray, room: int = 1) -> CuckooFilter:
        """A filter of the keys, with room for ``room`` times as many."""
        capacity = len(keys) * room
        while True:
            made = cls(capacity)
            try:
                made.insert(keys)
                return made
            except OverflowError:
                capacity = capacity * 2 + 8


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(TRIM)), UPPER, LOWER)


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def references(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """Distinct (h1, h2, doc_id) of the documents' keys of at least ``min_chars`` code points: the exact state's rows."""
    keys = F.filter(F.transform(_lines(F.col("text")), line_key), lambda k: F.length(k) >= min_chars)
    rows = docs.where(F.col("doc_id").isNotNull()).select("doc_id", F.explode(F.array_distinct(keys)).alias("k"))
    return rows.select(F.xxhash64("k").alias("h1"), F.xxhash64(F.lit(7), "k").alias("h2"), "doc_id").distinct()


def insert_documents(refs: DataFrame, docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """The references with those of more documents."""
    return refs.unionByName(references(docs, min_chars)).distinct()


def delete_documents(refs: DataFrame, doc_ids: DataFrame) -> DataFrame:
    """The references without those of the given documents."""
    return refs.join(doc_ids.select("doc_id").distinct(), "doc_id", "left_anti").select("h1", "h2", "doc_id")


def reference_counts(refs: DataFrame) -> DataFrame:
    """Exact counts per key: n_docs and the largest doc_id that holds it."""
    return refs.groupBy("h1", "h2").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("max_doc"))


class LineState(NamedTuple):
    """What is kept of the documents seen: refs (h1, h2, doc_id), counts (h1, h2, n_docs, max_doc, before), filters (shard, filter)."""

    refs: DataFrame
    counts: DataFrame
    filters: DataFrame
    shards: int
    min_docs: int
    min_chars: int

    def repeated(self) -> DataFrame:
        return self.counts.where(F.col("n_docs") >= self.min_docs).select("h1", "h2", "n_docs", "max_doc")


FILTERS = "shard int, filter binary"


def _shard(shards: int) -> Column:
    return F.pmod("h1", F.lit(shards)).cast("int").alias("shard")


def _keys(frame: pd.DataFrame) -> np.ndarray:
    return frame["h1"].to_numpy(np.int64).view(np.uint64)


def _built(frame: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"shard": frame["shard"].iloc[:1].to_numpy(), "filter": [CuckooFilter.of(_keys(frame), room=2).dumps()]})


def _changed(key: tuple, held: pd.DataFrame, steps: pd.DataFrame) -> pd.DataFrame:
    """A shard's stored filter with keys taken out and put in; null if there is none or it runs full."""
    if not len(steps):
        return held
    made = CuckooFilter.loads(held["filter"].iat[0]) if len(held) else None
    try:
        if made:
            made.delete(_keys(steps[~steps["added"]]))
            made.insert(_keys(steps[steps["added"]]))
    except OverflowError:
        made = None
    return pd.DataFrame({"shard": [key[0]], "filter": [made.dumps() if made else None]})


def _with_filters(state: LineState, changes: DataFrame) -> LineState:
    """The state with its filters brought up to its counts by ``changes`` (h1, added)."""
    steps = changes.select(_shard(state.shards), "h1", "added")
    made = materialize(state.filters.groupBy("shard").cogroup(steps.groupBy("shard")).applyInPandas(_changed, FILTERS), "line-filters")
    full = made.where(F.col("filter").isNull()).select("shard")
    if full.isEmpty():
        return state._replace(filters=made)
    anew = state.repeated().select(_shard(state.shards), "h1").join(full, "shard", "left_semi").groupBy("shard").applyInPandas(_built, FILTERS)
    return state._replace(filters=materialize(made.where(F.col("filter").isNotNull()).unionByName(anew), "line-filters"))


def insert_lines(docs: DataFrame, state: LineState | None = None, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> LineState:
    """The state with more documents; a document that it holds already changes nothing but for its new lines. Without a
    state, one is begun with the given limits."""
    if state is None:
        refs = materialize(references(docs, min_chars), "line-refs")
        counts = materialize(reference_counts(refs).withColumn("before", F.lit(0).cast("long")), "line-counts")
        repeated = counts.where(F.col("n_docs") >= min_docs)
        shards = max(shuffle_partitions(docs.sparkSession) * 4, -(-repeated.count() // SHARD_KEYS))
        filters = materialize(repeated.select(_shard(shards), "h1").groupBy("shard").applyInPandas(_built, FILTERS), "line-filters")
        return LineState(refs, counts, filters, shards, min_docs, min_chars)
    new = materialize(references(docs, state.min_chars).join(state.refs, ["h1", "h2", "doc_id"], "left_anti"), "line-refs")
    known = state.counts.withColumn("before", F.col("n_docs"))
    both = known.unionByName(reference_counts(new).withColumn("before", F.lit(0).cast("long")))
    counts = both.groupBy("h1", "h2").agg(F.sum("n_docs").alias("n_docs"), F.max("max_doc").alias("max_doc"), F.sum("before").alias("before"))
    state = state._replace(refs=state.refs.unionByName(new), counts=materialize(counts, "line-counts"))
    risen = state.counts.where((F.col("n_docs") >= state.min_docs) & (F.col("before") < state.min_docs))
    return _with_filters(state, risen.select("h1", F.lit(True).alias("added")))


def delete_lines(state: LineState, doc_ids: DataFrame) -> LineState:
    """The state without the given documents: only keys that they hold are counted again."""
    touched = materialize(state.refs.join(doc_ids.select("doc_id").distinct(), "doc_id", "left_semi").select("h1", "h2").distinct(), "line-touched")
    refs = materialize(delete_documents(state.refs, doc_ids), "line-refs")
    known = state.counts.withColumn("before", F.col("n_docs"))
    again = reference_counts(refs.join(touched, ["h1", "h2"], "left_semi"))
    recounted = known.select("h1", "h2", "before").join(touched, ["h1", "h2"], "left_semi").join(again, ["h1", "h2"], "left")
    recounted = materialize(recounted.withColumn("n_docs", F.coalesce("n_docs", F.lit(0).cast("long"))), "line-recounted")
    counts = known.join(touched, ["h1", "h2"], "left_anti").unionByName(recounted.where("n_docs > 0"))
    state = state._replace(refs=refs, counts=materialize(counts, "line-counts"))
    fallen = recounted.where((F.col("before") >= state.min_docs) & (F.col("n_docs") < state.min_docs))
    return _with_filters(state, fallen.select("h1", F.lit(False).alias("added")))


def _probe(batches):
    """Rows come sorted by (shard, salt, kind): a shard's stored filter, its exact counts, then the references that ask them."""
    shard, sieve, keys, counts = None, None, [], None
    for batch in batches:
        if not len(batch):
            continue
        change = np.flatnonzero(np.diff(batch["shard"].to_numpy()) | np.diff(batch["salt"].to_numpy()) | np.diff(batch["kind"].to_numpy())) + 1
        for a, b in zip([0, *change], [*change, len(batch)], strict=True):
            part = batch.iloc[a:b]
            here, kind = (part["shard"].iat[0], part["salt"].iat[0]), part["kind"].iat[0]
            if here != shard:
                shard, sieve, keys, counts = here, None, [], None
            if kind == 0:
                sieve = CuckooFilter.loads(part["filter"].iat[0])
            elif kind == 1:
                keys.append(part[["h1", "h2", "max_doc"]])
            elif sieve is not None:
                hits = part[sieve.contains(_keys(part))]
                if len(hits) and keys:
                    counts = pd.concat(keys) if counts is None else counts
                    exact = hits[["h1", "h2", "doc_id"]].merge(counts, on=["h1", "h2"])
                    yield exact.loc[exact["doc_id"] != exact["max_doc"], ["doc_id", "h1"]]


def _sieved(state: LineState, filter_bytes: int) -> DataFrame:
    """The references that hit the filters, if those fit in every task; else all references."""
    size = state.filters.agg(F.sum(F.octet_length("filter")), F.count("*")).first()
    if (size[0] or 0) + 200 * size[1] > filter_bytes:
        return state.refs
    stored = state.refs.sparkSession.sparkContext.broadcast({r.shard: bytes(r.filter) for r in state.filters.toLocalIterator()})
    shards = state.shards

    def hits(batches):
        sieves = {k: CuckooFilter.loads(v) for k, v in stored.value.items()}
        for batch in batches:
            keys, shard = _keys(batch), batch["h1"].to_numpy(np.int64) % shards
            order = np.argsort(shard, kind="stable")
            hit = np.zeros(len(batch), bool)
            for own in np.split(order, np.flatnonzero(np.diff(shard[order])) + 1):
                if len(own) and shard[own[0]] in sieves:
                    hit[own] = sieves[shard[own[0]]].contains(keys[own])
            yield batch[hit]

    return state.refs.mapInPandas(hits, state.refs.schema)


def dropped_references(state: LineState, filter_bytes: int = FILTER_BYTES) -> DataFrame:
    """(doc_id, h1) of the references whose lines go: keys in at least ``min_docs`` documents, all holders but the last."""
    repeated = state.repeated()
    floor = state.refs.count() / HEAVY
    heavy = repeated.where(F.col("n_docs") > floor).select("h1", "h2", F.lit(True).alias("heavy"))
    shard, none = _shard(state.shards), F.lit(None).cast("long")
    kind = lambda n: F.lit(n).alias("kind")
    salts = F.when(F.col("n_docs") > floor, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    known = repeated.select(shard, F.explode(salts).alias("salt"), kind(1), "h1", "h2", none.alias("doc_id"), "max_doc", F.lit(None).cast("binary").alias("filter"))
    salt = F.when(F.col("heavy"), F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).otherwise(0).alias("salt")
    asked = _sieved(state, filter_bytes).join(F.broadcast(heavy), ["h1", "h2"], "left")
    asked = asked.select(shard, salt, kind(2), "h1", "h2", "doc_id", none.alias("max_doc"), F.lit(None).cast("binary").alias("filter"))
    # only shards of heavy keys are asked with a salt
    salted = heavy.select(shard).distinct().withColumn("salted", F.lit(True))
    every = F.when(F.col("salted"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    zero = F.lit(0).cast("long")
    sieves = state.filters.join(F.broadcast(salted), "shard", "left").select("shard", F.explode(every).alias("salt"), kind(0), zero.alias("h1"), zero.alias("h2"), none.alias("doc_id"), none.alias("max_doc"), "filter")
    # nulls would turn whole numbers to floats in pandas
    rows = sieves.unionByName(known).unionByName(asked).na.fill(-1, ["doc_id", "max_doc"])
    return rows.repartition("shard", "salt").sortWithinPartitions("shard", "salt", "kind").mapInPandas(_probe, "doc_id long, h1 long")


def apply_drops(docs: DataFrame, drops: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """Each document with its lines left, joined by a line feed: adds n_lines, n_dropped, kept_text, in place of columns of
    these names."""
    gone, kept_lines = new_name("drop_keys", docs), new_name("kept_lines", docs)
    lists = drops.groupBy("doc_id").agg(F.collect_set("h1").alias(gone))
    lines = _lines(F.col("text"))
    stays = F.filter(lines, lambda x: ~F.array_contains(F.col(gone), F.xxhash64(line_key(x))) | (F.length(line_key(x)) < min_chars))
    kept = F.when(F.col(gone).isNull(), lines).otherwise(stays)
    out = docs.join(lists, "doc_id", "left").withColumn(kept_lines, kept).withColumn("n_lines", F.size(lines).cast("long"))
    out = out.withColumn("n_dropped", F.col("n_lines") - F.size(kept_lines)).withColumn("kept_text", F.array_join(kept_lines, "\n"))
    return out.drop(gone, kept_lines)


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """Insert all documents, then drop their repeated lines."""
    state = insert_lines(docs, min_chars=min_chars, min_docs=min_docs)
    return apply_drops(docs, dropped_references(state), min_chars)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


OP4_SQL = r"""
WITH l AS (
  SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents
), e AS (
  SELECT rid, doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS n FROM l
), k AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM e
), r AS (
  SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
)
SELECT k.doc_id, count(*)::BIGINT AS n_lines,
       (count(*) - count(*) FILTER (WHERE r.key IS NULL OR r.last = k.doc_id))::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (WHERE r.key IS NULL OR r.last = k.doc_id), '')) AS kept_sha256
FROM k LEFT JOIN r ON r.key = k.key GROUP BY k.rid, k.doc_id
"""
