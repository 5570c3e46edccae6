"""N-gram Jaccard join by vertical partitioning of the global n-gram order.

A document is the set of its distinct five-word shingles. Equal sets are one class. Documents that share under four
fifths of their shingles with any others can have no link and leave at once (a count over buckets of all shingles); the
sets of the others are written once, one row a class.

The global order of shingles puts rare ones first, by the number of classes that use them. Classes that reach the
similarity share a shingle among the first fifth of their sets (plus one), so only that part is cut into fragments of the
order. Each fragment is one task's share of the shingles: the classes of a shared shingle are a run, and equal runs of a
fragment count once, with a weight. The partial overlaps of the fragments are summed per pair, and the sum bounds what
the whole overlap can still be. The pairs that stay are checked on whole sets.

Only components are asked for, so pairs inside a component need no check. Each class is first checked against one other:
the class of its runs whose shingles are used most, the likely original of a group of edited copies. Pairs of different
components are then counted in full, inside the fragments, where a pair must pass three exact bounds before it becomes a
row: its sizes, the shingles that each side shares with anyone, and the parity bits of both sets, whose distance is
never more than that of the sets. Runs over ``CHUNK`` classes are dealt as cells of two chunks. Nothing is capped.

Defined cases: null or wordless texts have no shingles and are linked with nothing (component_id is their doc_id); fewer
than five words are one shingle; repeated rows are in one class; a null doc_id is a member that never names a component.
Shingles are told apart by 64-bit hashes, classes by 128 bits and their size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fabula.llm.common import documents, materialize, mix64, new_name, pieces, release, shuffle_partitions, utf8, words_of
from fabula.llm.components import components

WORDS = 5
LONG_RUN = 1_000_000
PIECE = 2_000_000
BATCH_BYTES = 16_000_000
BUCKETS_A_PARTITION = 8
PARITY_BITS = 512
#: A cell of a long run holds two chunks, so a task has twice as many classes in memory at most.
CHUNK = 4096


def shingle_sets(raw: np.ndarray, at: np.ndarray):
    """The sorted distinct shingle hashes of each text."""
    _, _, row, h = words_of(raw, at)
    bounds = np.searchsorted(row, np.arange(len(at)))
    mul = np.uint64(0x9E3779B97F4A7C15)
    total = np.zeros(max(0, len(h) - WORDS + 1), np.uint64)
    for i in range(WORDS):
        total = mix64(total * mul + h[i : len(h) - WORDS + 1 + i]) if len(total) else total
    for a, b in zip(bounds, bounds[1:], strict=False):
        if b - a >= WORDS:
            yield np.unique(total[a : b - WORDS + 1])
        elif b > a:
            short = np.uint64(b - a)
            for x in h[a:b]:
                short = mix64(np.array([short * mul + x], np.uint64))[0]
            yield np.array([short], np.uint64)
        else:
            yield total[:0]


def _sets(raw: np.ndarray, at: np.ndarray):
    for a, b in pieces(at, PIECE):
        yield from shingle_sets(raw[at[a] : at[b]], at[a : b + 1] - at[a])


def class_key(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a set."""
    return int(mix64(s).sum(dtype=np.uint64).view(np.int64)), int(mix64(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64).view(np.int64))


_FACTS = "kind int, bucket int, batch long, place int, doc_id long, n long, low long, high long, text_key long, data binary"
_KINDS = (pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
DOCUMENT, TOKENS, SHARED = range(3)


def _facts(rows: int, **columns) -> pa.RecordBatch:
    names = [x.split()[0] for x in _FACTS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(columns[c], k) if c in columns else pa.nulls(rows, k) for c, k in zip(names, _KINDS, strict=True)], names)


def _describe(buckets: int):
    """Rows of two kinds: documents with their size and class, and all shingles, by bucket.

    A shingle travels as 32 bits beside its bucket, with its document's place in the batch: that is enough to see whether
    other documents have it (a rare clash only lets a document through to the exact steps).
    """

    def described(batches):
        part, turn = TaskContext.get().partitionId(), 0
        for whole in batches:
            for begun in range(0, whole.num_rows, 1 << 16):
                rows = whole.slice(begun, 1 << 16)
                raw, at = utf8(rows.column("text"))
                for a, b in pieces(at, BATCH_BYTES):
                    number, turn = part << 32 | turn, turn + 1
                    yield from one(rows.slice(a, b - a), raw[at[a] : at[b]], at[a : b + 1] - at[a], number)

    def one(batch, raw, at, number):
        with np.errstate(over="ignore"):
            sets = list(_sets(raw, at))
            keys = [class_key(x) for x in sets]
        n = batch.num_rows
        yield _facts(n, kind=[DOCUMENT] * n, bucket=(np.arange(n) % buckets).tolist(), batch=[number] * n, place=np.arange(n, dtype=np.int32), doc_id=batch.column("doc_id"), n=[len(x) for x in sets], low=[k[0] for k in keys], high=[k[1] for k in keys], text_key=batch.column("text_key"))
        every = np.concatenate(sets)
        if not len(every):
            return
        place = np.repeat(np.arange(n, dtype=np.uint64), [len(x) for x in sets])
        sent = np.sort(every & ~np.uint64(0xFFFF) | place)
        owner = ((sent >> np.uint64(44)) * np.uint64(buckets) >> np.uint64(20)).astype(np.int64)
        cuts = np.concatenate(([0], np.flatnonzero(owner[1:] != owner[:-1]) + 1, [len(owner)]))
        blobs = [(sent[a:b] >> np.uint64(16)).astype("<u4").tobytes() + sent[a:b].astype("<u2").tobytes() for a, b in zip(cuts, cuts[1:], strict=False)]
        yield _facts(len(blobs), kind=[TOKENS] * len(blobs), bucket=owner[cuts[:-1]].tolist(), batch=[number] * len(blobs), data=blobs)

    return described


def _count_shared(batches):
    """Bucket by bucket: how many shingles of each document others have too, as (place, count) lists per batch."""
    held: list[tuple[int, bytes]] = []
    current = None

    def close():
        if not held:
            return
        size = [len(d) // 6 for _, d in held]
        token = np.concatenate([np.frombuffer(d, "<u4", k) for (_, d), k in zip(held, size, strict=True)])
        place = np.concatenate([np.frombuffer(d, "<u2", k, 4 * k) for (_, d), k in zip(held, size, strict=True)])
        order = np.sort(token.astype(np.uint64) << np.uint64(32) | np.arange(len(token), dtype=np.uint64))
        equal = (order[1:] >> np.uint64(32)) == (order[:-1] >> np.uint64(32))
        shared = np.zeros(len(token), bool)
        at = (order & np.uint64(0xFFFFFFFF)).astype(np.int64)
        shared[at[1:][equal]] = True
        shared[at[:-1][equal]] = True
        numbers, blobs, start = [], [], 0
        for (number, _), k in zip(held, size, strict=True):
            count = np.bincount(place[start : start + k][shared[start : start + k]])
            start += k
            some = np.flatnonzero(count)
            if len(some):
                numbers.append(number)
                blobs.append(some.astype("<u4").tobytes() + count[some].astype("<u4").tobytes())
        if numbers:
            yield _facts(len(numbers), kind=[SHARED] * len(numbers), batch=numbers, data=blobs)

    for batch in batches:
        kinds = batch.column("kind").to_numpy()
        others = kinds != TOKENS
        if others.any():
            yield batch.filter(pa.array(others))
        tokens = batch.filter(pa.array(~others))
        for bucket, number, data in zip(*(tokens.column(c).to_pylist() for c in ("bucket", "batch", "data")), strict=True):
            if bucket != current:
                yield from close()
                held, current = [], bucket
            held.append((number, data))
    yield from close()


def _sum_shared(batches):
    """Lists of one batch come together: (batch, place, shared)."""
    current, total = None, np.zeros(0, np.int64)

    def out():
        some = np.flatnonzero(total)
        if current is not None and len(some):
            yield pa.RecordBatch.from_arrays([pa.array([current] * len(some), pa.int64()), pa.array(some, pa.int32()), pa.array(total[some], pa.int64())], ["batch", "place", "shared"])

    for batch in batches:
        for number, data in zip(batch.column("batch").to_pylist(), batch.column("data").to_pylist(), strict=True):
            if number != current:
                yield from out()
                current, total = number, np.zeros(1 << 16, np.int64)
            k = len(data) // 8
            total[np.frombuffer(data, "<u4", k)] += np.frombuffer(data, "<u4", k, 4 * k)
    yield from out()


def parity(s: np.ndarray) -> bytes:
    """One bit for each of ``PARITY_BITS`` groups of shingles: whether the set holds an odd number of the group.

    Two sets' bits differ in no more places than the sets have elements that only one of them holds.
    """
    return np.packbits(np.bincount((s >> np.uint64(20)).astype(np.int64) % PARITY_BITS, minlength=PARITY_BITS).astype(np.uint8) & 1).tobytes()


def _class_sets(batches):
    """(low, high, n, parity, shingles) of each text that has words."""
    for batch in batches:
        raw, at = utf8(batch.column("text"))
        for a, b in pieces(at, PIECE):
            with np.errstate(over="ignore"):
                sets = [s for s in _sets(raw[at[a] : at[b]], at[a : b + 1] - at[a]) if len(s)]
                keys = [class_key(s) for s in sets]
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0] + [len(s) for s in sets]), pa.int32()), pa.array(np.concatenate(sets or [np.zeros(0, np.uint64)]).view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([parity(s) for s in sets], pa.binary()), lists], ["low", "high", "n", "parity", "shingles"])


def _runs(batches):
    """Rows (shingle, node) come sorted: the classes of a shared shingle are a run; equal runs of a task become one with a weight."""
    held: dict[bytes, int] = {}
    size = 0
    token, carry, long = None, [], False

    def rows(run, nodes, weight):
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(nodes), run)), pa.array(nodes), pa.array(np.full(len(nodes), weight))], ["run", "node", "weight"])

    def flush():
        nonlocal held, size
        for blob, weight in held.items():
            nodes = np.frombuffer(blob, np.int64)
            yield rows(int(mix64(nodes.view(np.uint64) ^ np.uint64(len(nodes))).sum(dtype=np.uint64).view(np.int64)), nodes, weight)
        held, size = {}, 0

    def close():
        nonlocal size
        if carry and not long:
            nodes = np.concatenate(carry)
            if len(nodes) > 1:
                blob = nodes.tobytes()
                if blob not in held:
                    size += len(nodes)
                held[blob] = held.get(blob, 0) + 1

    for batch in batches:
        tokens, nodes = batch.column("token").to_numpy(), batch.column("node").to_numpy()
        if not len(tokens):
            continue
        cuts = np.flatnonzero(tokens[1:] != tokens[:-1]) + 1
        starts, ends = np.concatenate(([0], cuts)), np.concatenate((cuts, [len(tokens)]))
        # runs of one class inside the batch need no look
        look = (ends - starts > 1) | (np.arange(len(starts)) == 0) | (np.arange(len(starts)) == len(starts) - 1)
        for a, b in zip(starts[look], ends[look], strict=True):
            if tokens[a] != token:
                close()
                token, carry, long = tokens[a], [], False
            if long:
                yield rows(int(mix64(np.array([token]).view(np.uint64)).view(np.int64)[0]), nodes[a:b], 1)
                continue
            carry.append(nodes[a:b])
            if sum(map(len, carry)) > LONG_RUN:  # streamed from here on, under an id of the shingle's own
                yield rows(int(mix64(np.array([token]).view(np.uint64)).view(np.int64)[0]), np.concatenate(carry), 1)
                carry, long = [], True
        if size > 2 * LONG_RUN:
            yield from flush()
    close()
    yield from flush()


def can_link(a: str, b: str) -> Column:
    """Whether sizes and shared shingles allow classes a and b the similarity: the overlap is at least 4/9 of both sizes
    together, and at most what either side shares with anyone."""
    size = F.col(f"{a}.n") + F.col(f"{b}.n")
    return (F.least(f"{a}.n", f"{b}.n") * 5 >= F.greatest(f"{a}.n", f"{b}.n") * 4) & (size * 4 <= F.least(f"{a}.s", f"{b}.s") * 9)


def _pairs_across(batches):
    """Cells of runs come sorted by (run, i, j, n): pairs of different roots that pass the exact bounds."""
    held: list[pa.RecordBatch] = []
    current = None

    def close():
        if not held:
            return
        columns = {c: np.concatenate([h.column(c).to_numpy() for h in held]) for c in ("node", "root", "n", "s", "chunk")}
        node, root, n, s, chunk = columns.values()
        bits = np.frombuffer(b"".join(x for h in held for x in h.column("parity").to_pylist()), np.uint64).reshape(len(node), -1)
        weight, one_chunk = int(held[0].column("weight")[0].as_py()), current[1] == current[2]
        most = np.searchsorted(n, np.minimum(n * 5 // 4, s * 9 // 4 - n), "right")
        found = []
        for x in np.flatnonzero(most > np.arange(len(n)) + 1):
            y = np.arange(x + 1, most[x])
            y = y[(root[y] != root[x]) & (4 * (n[x] + n[y]) <= 9 * s[y]) & (one_chunk | (chunk[y] != chunk[x]))]
            y = y[9 * np.bitwise_count(bits[y] ^ bits[x]).sum(1, dtype=np.int64) <= n[x] + n[y]]
            if len(y):
                found.append((np.full(len(y), node[x]), node[y], np.full(len(y), n[x]), n[y]))
        if found:
            a, b, na, nb = (np.concatenate(c) for c in zip(*found, strict=True))
            swap = a > b
            a, b, na, nb = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, nb, na), np.where(swap, na, nb)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (a, b, na, nb, np.full(len(a), weight))], ["a", "b", "na", "nb", "weight"])

    for batch in batches:
        run, i, j = (batch.column(c).to_numpy() for c in ("run", "i", "j"))
        if not len(run):
            continue
        cuts = np.flatnonzero((run[1:] != run[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
        for a, b in zip([0, *cuts], [*cuts, len(run)], strict=True):
            key = (run[a], i[a], j[a])
            if key != current:
                yield from close()
                held, current = [], key
            held.append(batch.slice(a, b - a))
    yield from close()


class JaccardJoin:
    """Links between classes of ``docs`` (doc_id, text) at similarity 0.8, and the components they make."""

    def __init__(self, docs: DataFrame):
        self.docs = docs.select("doc_id", "text", F.xxhash64("text").alias("text_key"))
        self.spark = docs.sparkSession

    def classes(self) -> None:
        """The documents with their classes, and the sets of the classes that can have a link at all.

        A link needs four fifths of a document's shingles in another one, so a document with fewer that any other has is
        out of it. Copies of one class count for each other.
        """
        buckets = shuffle_partitions(self.spark) * BUCKETS_A_PARTITION
        sent = self.docs.mapInArrow(_describe(buckets), _FACTS).repartition("bucket").sortWithinPartitions("bucket")
        told = materialize(sent.mapInArrow(_count_shared, _FACTS), "shingle-facts")
        del sent
        release(self.spark)
        self.members = told.where(F.col("kind") == DOCUMENT).select("batch", "place", "doc_id", "n", "low", "high", "text_key")
        shared = told.where(F.col("kind") == SHARED).select("batch", "data").repartition("batch").sortWithinPartitions("batch").mapInArrow(_sum_shared, "batch long, place int, shared long")
        linkable = self.members.join(shared, ["batch", "place"]).where("shared * 5 >= n * 4 AND n > 0")
        pick = F.coalesce("doc_id", "text_key").alias("pick")
        wanted = linkable.groupBy("low", "high", "n").agg(F.min(F.struct(pick, "text_key")).alias("w")).select("w.pick", "w.text_key")
        texts = self.docs.select(pick, "text_key", "text").join(wanted, ["pick", "text_key"], "left_semi").select("text")
        made = texts.mapInArrow(_class_sets, "low long, high long, n long, parity binary, shingles array<long>")
        one = made.groupBy("low", "high", "n").agg(F.any_value("parity").alias("parity"), F.any_value("shingles").alias("shingles"))
        self.sets = materialize(one.withColumn("node", F.monotonically_increasing_id()), "class-sets")
        release(self.spark)

    def order(self) -> None:
        """(node, n, s, common, prefix) of the classes that can still have a link: the number of shingles shared with any
        class, the mean use of all, and the shared shingles of the prefix in the global order."""
        tokens = self.sets.select("node", "n", F.explode("shingles").alias("token"))
        uses = tokens.groupBy("token").agg(F.count("*").alias("uses")).where("uses > 1")
        late = tokens.join(uses, "token").groupBy("node", "n").agg(F.sort_array(F.collect_list(F.struct("uses", "token"))).alias("late"), F.sum("uses").alias("used"))
        known = late.withColumn("s", F.size("late").cast("long")).where("s * 5 >= n * 4").withColumn("common", F.col("used") / F.col("n"))
        # n - ceil(4 n / 5) + 1 places, of which the shingles that no other class has take the first
        known = known.withColumn("first", F.expr("s + 1 - (4 * n + 4) div 5")).where("first > 0")
        self.known = materialize(known.select("node", "n", "s", "common", F.expr("slice(late, 1, int(first))")["token"].alias("prefix")), "class-order")

    def runs(self) -> DataFrame:
        """(run, node, weight): which classes share a shingle of their prefixes, and how many shingles a run stands for."""
        tokens = self.known.select("node", F.explode("prefix").alias("token")).repartition("token").sortWithinPartitions("token", "node")
        made = tokens.mapInArrow(_runs, "run long, node long, weight long")
        return materialize(made.groupBy("run", "node").agg(F.sum("weight").alias("weight")), "runs")

    def verified(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) whose whole sets reach the similarity."""
        left = self.sets.select(F.col("node").alias("a"), F.col("shingles").alias("of_a"))
        right = self.sets.select(F.col("node").alias("b"), F.col("shingles").alias("of_b"))
        joined = pairs.select("a", "b").join(left, "a").join(right, "b")
        same = F.size(F.array_intersect("of_a", "of_b"))
        return materialize(joined.where(same * 9 >= (F.size("of_a") + F.size("of_b")) * 4).select("a", "b"), "links")

    def likely(self, runs: DataFrame) -> DataFrame:
        """One pair for each class a: with the most used class b of its runs that its bounds allow. Work to do first, not a
        filter: the full count comes back to every pair of different components."""
        level = F.floor(F.log(1.25, F.col("n"))).cast("int")  # a link's sizes differ by one level at most
        own = F.struct("common", "node", "n", "s")
        placed = runs.join(self.known.drop("prefix"), "node").select("run", level.alias("level"), own.alias("own"))
        most = placed.groupBy("run", "level").agg(F.max("own").alias("top"))
        asked = placed.select("run", "own", F.explode(F.array(F.col("level") - 1, F.col("level"), F.col("level") + 1)).alias("level"))
        better = asked.join(most, ["run", "level"]).where((F.col("top") > F.col("own")) & can_link("own", "top"))
        return better.groupBy(F.col("own.node").alias("a")).agg(F.max("top").alias("top")).select("a", F.col("top.node").alias("b"))

    def across(self, runs: DataFrame, links: DataFrame) -> DataFrame:
        """Pairs of different components whose overlaps, summed over the fragments, still allow the similarity."""
        known = self.known.drop("prefix", "common").join(components(links), "node", "left").withColumn("root", F.coalesce("root", "node"))
        placed = materialize(runs.join(known, "node"), "runs-placed")
        mixed = placed.groupBy("run").agg(F.min("root").alias("least"), F.max("root").alias("greatest"), F.count("*").alias("size")).where("least <> greatest")
        chunks = F.ceil(F.col("size") / CHUNK)
        entries = placed.join(mixed, "run").withColumn("chunk", F.pmod(F.xxhash64("node"), chunks).cast("int")).join(self.sets.select("node", "parity"), "node")
        cells = entries.withColumn("other", F.explode(F.sequence(F.lit(0), chunks.cast("int") - 1))).withColumn("i", F.least("chunk", "other")).withColumn("j", F.greatest("chunk", "other"))
        dealt = cells.select("run", "i", "j", "node", "root", "n", "s", "chunk", "weight", "parity").repartition("run", "i", "j").sortWithinPartitions("run", "i", "j", "n")
        pairs = dealt.mapInArrow(_pairs_across, "a long, b long, na long, nb long, weight long")
        summed = pairs.groupBy("a", "b", "na", "nb").agg(F.sum("weight").alias("partial"))
        # beyond the prefixes there is at most the longer of what the sets have after them
        return summed.where("partial >= (4 * (na + nb) + 8) div 9 - greatest((4 * na + 4) div 5, (4 * nb + 4) div 5) + 1").select("a", "b")

    def links(self) -> DataFrame:
        """Links that connect every component, checked on whole sets."""
        self.classes()
        self.order()
        release(self.spark)
        runs = self.runs()
        first = self.verified(self.likely(runs))
        release(self.spark)
        rest = self.verified(self.across(runs, first))
        release(self.spark)
        return first.unionByName(rest)

    def result(self) -> DataFrame:
        """(doc_id, n_shingles, component_id, text_key): the smallest doc_id that links, or equal sets, reach."""
        roots = components(self.links())
        key = ["low", "high", "n"]
        named = self.sets.select(*key, "node").join(roots, "node", "left").select(*key, F.coalesce("root", "node").alias("root"))
        least = self.members.where("n > 0").groupBy(*key).agg(F.min("doc_id").alias("least"))
        placed = materialize(named.join(least, key), "classes-placed")
        names = placed.groupBy("root").agg(F.min("least").alias("component_id"))
        linked = placed.join(names, "root").select(*key, "component_id")
        joined = self.members.join(linked.withColumn("in_class", F.lit(True)), key, "left")  # a document without a class that can link is alone
        return joined.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("in_class"), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), "text_key")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The documents without near copies: of each component the row of the smallest doc_id stays, and of equal rows one.

    A row with a null id goes if its component has a document with an id."""
    key, gone_id = new_name("text_key", docs), new_name("gone_id", docs)
    keyed = docs.withColumn(key, F.xxhash64("text"))
    result = materialize(JaccardJoin(docs).result(), "near-copies")
    gone = result.where(F.col("component_id").isNotNull() & ~F.col("component_id").eqNullSafe(F.col("doc_id"))).select(F.col("doc_id").alias(gone_id), F.col("text_key").alias(key + "_")).distinct()
    kept = keyed.join(gone, keyed["doc_id"].eqNullSafe(gone[gone_id]) & (keyed[key] == gone[key + "_"]), "left_anti")
    if result.groupBy("doc_id", "text_key").count().where("count > 1").limit(1).count():
        kept = kept.dropDuplicates(["doc_id", key])
    return kept.drop(key)


def op5_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return JaccardJoin(documents(spark, sf_dir)).result().select("doc_id", "n_shingles", "component_id")


OP5_SQL = r"""
WITH RECURSIVE w AS (
  SELECT row_number() OVER () AS rid, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), s AS (
  SELECT DISTINCT rid, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))
    WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS sh FROM w
), n AS (SELECT rid, count(*) AS n FROM s GROUP BY 1
), p AS (SELECT a.rid AS a, b.rid AS b, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.rid < b.rid GROUP BY 1, 2
), l AS (SELECT a, b FROM p JOIN n x ON x.rid = a JOIN n y ON y.rid = b WHERE 100 * c >= 80 * (x.n + y.n - c)
), e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l
), r(rid, root) AS (SELECT rid, rid FROM w UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.rid
)
SELECT w.doc_id, coalesce(max(n.n), 0)::BIGINT AS n_shingles, min(o.doc_id) AS component_id
FROM w JOIN r ON r.rid = w.rid JOIN w o ON o.rid = r.root LEFT JOIN n ON n.rid = w.rid GROUP BY w.rid, w.doc_id
"""
