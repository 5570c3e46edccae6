"""Training-data operators against brute force, round trips and awkward inputs."""

import collections
import hashlib
import io
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from fabula.llm import decontam, jaccard, langid, linededup, media, mixing, quality, suffixes, tokens, warc
from fabula.llm.common import words_of

WORDS = re.compile("[^\x20\x09-\x0d]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, key int, node string, tag string"


def corpus():
    """Copies, near copies, shared passages and lines, nulls, empty, short and long texts, repeated rows."""
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage, line = say(60), "A common line of more than twenty signs"
    base, texts = [say(rng.randint(30, 120)) for _ in range(12)], []
    for b in base:
        texts += [b, b.upper() if len(b) % 2 else b]
        words = b.split()
        for _ in range(3):
            w = list(words)
            w[rng.randrange(len(w))] = "changed"
            texts.append(" ".join(w))
    texts += [say(40) + "\n" + passage + "\n" + say(20) for _ in range(6)]
    texts += [say(5) + "\n " + (line.upper() if i % 2 else line) + " \n" + say(3) for i in range(5)]
    texts += [None, "", " ", "a", "a b c d", "a b c d", "x" * 60, "x" * 60, "x y " * 3000, "\n\n\n", "日本語 " * 30, passage, passage + " " + say(2)]
    rows = [(i * 3, t) for i, t in enumerate(texts)]
    rows += [rows[4], (6, "another text of a repeated id " + say(30)), (None, base[0])]
    return [(d, t, ("en", "de", None)[i % 3], ("s1", "s0", None)[i % 3], 0, "clash", 1, "clash", "clash") for i, (d, t) in enumerate(rows)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def multiset(rows):
    return collections.Counter(tuple(r) for r in rows)


def test_word_hashes_do_not_depend_on_place():
    a, b = "x Yz é a".encode(), "a yz  x é".encode()
    ha = words_of(np.frombuffer(a, np.uint8), np.array([0, len(a)]))[3]
    hb = words_of(np.frombuffer(b, np.uint8), np.array([0, len(b)]))[3]
    assert set(ha) == set(hb) and len(set(ha)) == 4


def shingles(text):
    w = WORDS.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_jaccard_is_brute_force(spark, rows, docs, empty):
    sets = [shingles(r[1]) for r in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and 100 * common >= 80 * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(r[0], least.get(find(i), r[0]))
    want = collections.Counter((r[0], len(sets[i]), least.get(find(i)) if sets[i] else r[0]) for i, r in enumerate(rows))
    got = jaccard.JaccardJoin(docs).result().select("doc_id", "n_shingles", "component_id").collect()
    assert multiset(got) == want
    assert jaccard.JaccardJoin(empty).result().count() == 0
    kept = jaccard.one_of_each(docs.select("doc_id", "text")).collect()
    assert len({(r.doc_id, r.text) for r in kept}) == len(kept)
    assert {r.doc_id for r in kept if shingles(r.text)} >= {least[find(i)] for i in range(len(rows)) if sets[i] and find(i) in least}


def test_suffixes_are_brute_force(rows, docs, empty):
    seen, want = {}, collections.Counter()
    raws = [(r[0], (r[1] or "").encode()) for r in rows]
    for d, raw in raws:
        for i in range(len(raw) - 49):
            if d is not None:
                seen[raw[i : i + 50]] = min(d, seen.get(raw[i : i + 50], d))
    for d, raw in raws:
        mask = bytearray(len(raw))
        for i in range(len(raw) - 49):
            if d is not None and seen[raw[i : i + 50]] < d:
                mask[i : i + 50] = b"\1" * 50
        spans = sum(mask[i] and not (i and mask[i - 1]) for i in range(len(mask)))
        want[(d, len(raw), sum(mask), spans, bytes(b for b, m in zip(raw, mask, strict=True) if not m))] += 1
    got = collections.Counter((r[0], r[1], r[2], r[3], bytes(r[4])) for r in suffixes.dedup_substrings(docs).collect())
    assert got == want
    assert suffixes.dedup_substrings(empty).count() == 0


def test_suffix_array_and_shards():
    rng = np.random.default_rng(1)
    text = np.concatenate([rng.integers(97, 100, 3000), np.tile([97, 98], 200), np.zeros(70), np.tile(rng.integers(97, 123, 90), 5), rng.integers(97, 99, 500)]).astype(np.uint8)
    order, raw = suffixes.suffix_array(text), text.tobytes()
    assert sorted(order) == list(range(len(raw)))
    heads = [raw[i : i + 50] for i in order]
    assert all(a <= b or b.startswith(a) or a.rstrip(b"\0") == b.rstrip(b"\0") for a, b in zip(heads, heads[1:], strict=False))
    common = suffixes.common_prefixes(text, order)
    for k in range(1, len(order)):
        a, b = raw[order[k - 1] :][:50], raw[order[k] :][:50]
        assert common[k] == next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    near = [bytes(rng.integers(97, 99, 80).astype(np.uint8)) for _ in range(30)]
    near += [near[3], near[7][:60]]
    docs = np.sort(rng.integers(0, 20, len(near)))
    joined = lambda parts: (np.frombuffer(b"".join(parts), np.uint8), np.cumsum([0] + [len(p) for p in parts]))
    whole = set(zip(*suffixes.repeated_windows(*joined(near), docs), strict=True))
    merged, parts = suffixes.Merged(), set()
    for a in range(0, len(near), 7):
        owner, at = suffixes.repeated_windows(*joined(near[a : a + 7]), docs[a : a + 7], merged, keep=True)
        parts |= set(zip(owner + a, at, strict=True))
    assert parts == whole


def test_lines_are_brute_force(rows, docs, empty):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    holders = collections.defaultdict(set)
    for r in rows:
        for x in (r[1] or "").split("\n"):
            if len(key(x)) >= 20 and r[0] is not None:
                holders[key(x)].add(r[0])
    want = collections.Counter()
    for r in rows:
        lines = (r[1] or "").split("\n")
        kept = [x for x in lines if r[0] is None or len(holders[key(x)]) < 3 or max(holders[key(x)]) == r[0]]
        want[(r[0], len(lines), len(lines) - len(kept), "\n".join(kept))] += 1
    got = linededup.dedup_lines(docs.select("doc_id", "text")).select("doc_id", "n_lines", "n_dropped", "kept_text").collect()
    assert multiset(got) == want
    assert linededup.dedup_lines(empty).count() == 0


def test_line_deletion_is_reversible(spark, docs):
    refs = linededup.references(docs)
    gone = docs.where("doc_id % 2 = 0").select("doc_id")
    back = linededup.insert_documents(linededup.delete_documents(refs, gone), docs.where("doc_id % 2 = 0"))
    assert multiset(back.collect()) == multiset(refs.collect())


def test_line_state_is_incremental(spark, docs):
    """Inserts and deletions give the state and the drops of the documents left; the filters hold their repeated keys,
    stored in tasks or met by shard."""
    docs = docs.select("doc_id", "text").where("doc_id IS NOT NULL")
    most, some = docs.where("doc_id % 3 <> 0"), docs.where("doc_id % 3 = 0")
    state = linededup.insert_lines(most)
    for step, left in (
        (lambda s: linededup.insert_lines(some, s), docs),
        (lambda s: linededup.insert_lines(docs, s), docs),
        (lambda s: linededup.delete_lines(s, docs.where("doc_id % 5 < 3")), docs.where("doc_id % 5 >= 3")),
        (lambda s: linededup.delete_lines(s, docs), docs.limit(0)),
        (lambda s: linededup.insert_lines(most, s), most),
    ):
        state, want = step(state), linededup.insert_lines(left)
        assert multiset(state.refs.collect()) == multiset(want.refs.collect())
        counts = lambda s: multiset(s.counts.select("h1", "h2", "n_docs", "max_doc").collect())
        assert counts(state) == counts(want)
        drops = multiset(linededup.dropped_references(want).collect())
        assert multiset(linededup.dropped_references(state).collect()) == multiset(linededup.dropped_references(state, 0).collect()) == drops
        sieves = {r.shard: linededup.CuckooFilter.loads(r.filter) for r in state.filters.collect()}
        keys = [r.h1 for r in state.repeated().collect()]
        assert all(sieves[k % state.shards].contains(np.array([k]).view(np.uint64)).all() for k in keys)
        assert sum(int((f.table > 0).sum()) for f in sieves.values()) == len(keys)


def test_cuckoo_filter():
    rng = np.random.default_rng(0)
    keys = rng.integers(0, 1 << 63, 5000).astype(np.uint64)
    made = linededup.CuckooFilter.of(keys)
    assert made.contains(keys).all()
    assert made.contains(rng.integers(0, 1 << 63, 20000).astype(np.uint64)).mean() < 0.01
    made.delete(keys[:2500])
    assert made.contains(keys[2500:]).all() and made.contains(keys[:2500]).mean() < 0.02


def test_tokens_round_trip(rows, docs, empty):
    from tokenizers import Tokenizer

    path = tokens.vocabulary_path()
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    own = tokens.WordEncoder(path)
    texts = ["It's can't ''s !!'s 'S x_y_z 12a3 ½", "ÀÉÎ ß ǅ Σας ΟΔΟΣ", "<|endoftext|> a", "İstanbul", "áb", "a\x1cb\x85c d", "naïve—“q” … ‘s", "''ll 'll'S\t'RE"]
    for text, made in zip(texts, own.encode(texts), strict=True):
        assert list(made) == tokenizer.encode(text, add_special_tokens=False).ids
    want, start = [], 0
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = np.array([*tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((r[0], start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    got = tokens.token_output(docs).orderBy("start").collect()
    assert [tuple(r) for r in got] == want
    assert tokens.token_output(empty).count() == 0


def test_direct_codes():
    rng = np.random.default_rng(0)
    for ids in (np.array([5]), rng.integers(0, 49408, 10001), rng.integers(0, 200, 1000), rng.integers(0, 2**32 - 1, 5000)):
        _, _, codes = tokens.unpack(tokens.pack([1], np.array([len(ids)]), tokens.DirectCodes.of(ids)))
        places = rng.permutation(len(ids))
        assert (codes.at(places) == ids[places]).all()


def test_media_round_trip(docs, rows, empty):
    for n in (0, 1, 64, 100, 8192, 8193, 17000, 131073):
        payload = media.padded("é" * n)
        data = media.write_matroska(payload)
        found = media.read_matroska(data)
        assert b"".join(data[a:b] for *_, a, b in found["packets"]) == payload
        assert all(data[c[2] : c[2] + 4] == b"\x1f\x43\xb6\x75" for c in found["cues"])
    for lacing, sizes in (("none", [5]), ("xiph", [300, 1, 255, 0, 510, 3]), ("fixed", [7, 7, 7]), ("ebml", [300, 1, 255, 70000, 3, 0, 510])):
        frames = [b"x" * k for k in sizes]
        block = media.laced_block(1, -3, frames, lacing)
        track, time, key, ranges = media.frame_ranges(block, 0, len(block))
        assert [block[a:b] for a, b in ranges] == frames and (track, time, key) == (1, -3, True)
    with pytest.raises(ValueError):
        media.read_matroska(b"RIFF....")
    got = media.read_back(media.media_column(docs)).collect()
    want = collections.Counter(hashlib.sha256(media.padded(r[1])).hexdigest() for r in rows)
    assert collections.Counter(r.payload_sha256 for r in got) == want
    assert media.packet_table(media.media_column(docs)).agg(F.sum("length")).first()[0] == sum(len(media.padded(r[1])) for r in rows)
    assert media.read_back(media.media_column(empty)).count() == 0


def test_warc_round_trip(spark):
    pages = [(3, "http://a.b/x y", "same"), (1, "https://A.b:80/Q?z=1#f", "same"), (2, None, None), (5, "http://b.a/\r\nX: y", ""), (4, "x", "é\r\n\r\nWARC/1.1"), (7, "http://a.b/", "same"), (None, "u", "same"), (1, "https://A.b:80/Q?z=1#f", "same")]
    df = spark.createDataFrame([(*p, "clash") for p in pages], "page_id long, url string, html string, sha1 string")
    folder = warc.fresh_path(spark, "warc")
    warc.write_archives(df, folder)
    rows = warc.merge_index(warc.read_archives(spark, folder)).collect()
    first = {}
    for i, _, h in pages:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    want = collections.Counter((i, len((h or "").encode()), "response" if i == first[h or ""] else "revisit", None if i == first[h or ""] else first[h or ""]) for i, _, h in pages)
    assert collections.Counter((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in rows) == want
    order = [(r.surt, r.capture) for r in rows]
    assert order == sorted(order)
    runs = [sorted(random.Random(i).choices(range(50), k=i)) for i in range(9)]
    assert [k for k, _ in warc.LoserTree(runs)] == sorted(sum(runs, []))


def test_warc_files_can_be_sought(spark):
    """Files are bounded by bytes, a record by nothing; every index row finds its record; frequent payloads or not, one answer."""
    rng = random.Random(7)
    long = "".join(rng.choices("абвabc <>\r\n", k=400_000))
    pages = [(i, f"http://h{i % 7}.org/{i % 11}", ["", long, f"page {i % 40} " * (i % 50)][min(i % 5, 2)]) for i in range(300)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").repartition(3)
    first = {}
    for i, _, h in pages:
        first.setdefault(h, i)
    want = sorted((i, None if first[h] == i else first[h]) for i, _, h in pages)
    for heavy, file_bytes, range_rows in ((1, 1 << 27, 10), (10, 20_000, 1000), (10**6, 1, 1000)):
        folder = warc.fresh_path(spark, "warc")
        warc.write_archives(df, folder, file_bytes, heavy)
        files = spark.read.parquet(f"{folder}/files").collect()
        assert sum(f.n_records for f in files) == 300 and all(f.n_bytes <= file_bytes or f.n_records == 1 for f in files)
        rows = warc.merge_index(warc.read_archives(spark, folder), range_rows).collect()
        assert sorted((r.page_id, r.refers_to) for r in rows) == want
        order = [(r.surt, r.capture, r.page_id) for r in rows]
        assert order == sorted(order)
        for r in rng.sample(rows, 20):
            headers, block = warc.record_at(r.run, r.place, r.length)
            html = block.partition(b"\r\n\r\n")[2].decode()
            assert headers["warc-record-id"] == f"<urn:page:{r.page_id}>" and html == ("" if r.refers_to is not None else pages[r.page_id][2])
    folder = warc.fresh_path(spark, "warc")
    warc.write_archives(df.limit(0), folder)
    assert warc.merge_index(warc.read_archives(spark, folder)).count() == 0
    whole = warc.gzip_member(b"WARC/1.1\r\nContent-Length: 1\r\n\r\nx\r\n\r\n")
    assert [x[:2] for x in warc.gzip_members(io.BytesIO(whole * 3))] == [(i * len(whole), len(whole)) for i in range(3)]
    for broken in (whole[:-5], whole + whole[:9]):
        with pytest.raises(ValueError):
            list(warc.gzip_members(io.BytesIO(broken)))
    for broken in (b"WARC/1.1\r\nContent-Length: 9\r\n\r\nx\r\n\r\n", b"HTTP/1.1 200\r\n\r\n", b""):
        with pytest.raises(ValueError):
            warc.parse_record(broken)


def test_decontamination_is_brute_force(spark, rows, docs, empty):
    items = [(1, rows[0][1]), (2, " ".join(rows[10][1].split()[:20])), (3, "a b c d"), (4, None), (5, " "), (6, "no such words in any of the documents here"), (7, " ".join(rows[61][1].split()[-30:]))]
    split = lambda t: [w for w in re.split("[\x20\x09-\x0d]+", (t or "").lower()) if w]
    want = {}
    for item, text in items:
        w = split(text)
        k = min(5, len(w))
        if not k:
            continue
        own = [tuple(w[i : i + k]) for i in range(len(w) - k + 1)]
        for d, t, *_ in rows:
            words = split(t)
            all_ = [tuple(words[i : i + k]) for i in range(len(words) - k + 1)]
            for a in range(1 - len(own), len(all_)):
                cut = collections.Counter(all_[max(0, a) : a + len(own)])
                shared = sum((cut & collections.Counter(own)).values())
                j = shared / (sum(cut.values()) + len(own) - shared)
                if j >= 0.8 and d is not None:
                    want[d, item] = max(j, want.get((d, item), 0))
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.similarity for r in decontam.contaminated(docs, benchmark).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in got) and want
    assert decontam.contaminated(empty, benchmark).count() == 0 and decontam.contaminated(docs, benchmark.limit(0)).count() == 0


def test_mix_meets_targets(docs, rows, empty):
    mixed = mixing.weighted_fair_mix(mixing.sized(docs.select("doc_id", "source", "text"))).collect()
    size = lambda t: len(WORDS.findall(t or ""))
    own = collections.Counter()
    for r in rows:
        own[r[3]] += size(r[1])
    weight = {"s0": 3.0, "s1": 1.0, None: 2.0}
    left, budget, target, open_ = dict(own), 1.5 * sum(own.values()), {}, set(own)
    while open_:
        share = {s: budget * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 2 * left[s]}
        for s in over or open_:
            target[s] = min(share[s], 2 * left[s]) if not over else 2 * left[s]
        budget -= sum(target[s] for s in (over or open_))
        open_ -= over or open_
    taken = collections.Counter()
    for r in mixed:
        taken[r.source] += r.taken
        assert r.source_size == own[r.source] and abs(r.target - target[r.source]) < 1e-6 and 0 <= r.taken <= 2 * r["size"]
    assert all(abs(taken[s] - target[s]) <= 1 for s in own) and len(mixed) == len(rows)
    whole = mixing.weighted_fair_mix(mixing.sized(docs.select("doc_id", "source", "text")), whole=True).collect()
    assert all(r.taken in (0, r["size"], 2 * r["size"]) for r in whole)
    assert mixing.weighted_fair_mix(mixing.sized(empty.drop("size"))).count() == 0


def test_quality_learns(spark, empty):
    rng = random.Random(0)
    say = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(20, 90)))
    rows = [(i, say().capitalize() + "." if i % 3 else " ".join(w + "$$$" for w in say().split()), int(i % 3 > 0)) for i in range(400)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(900, None), (901, ""), (None, "x " * 30000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i % 2], "doc_id long, y int")
    stats = quality.document_statistics(docs)
    model = quality.fit(stats, labels)
    got = {r.doc_id: r.score for r in quality.score(stats, model).collect()}
    assert len(got) == 403 and all(0 <= s <= 1 for s in got.values())
    assert np.mean([(got[i] >= 0.5) == (y == 1) for i, _, y in rows if i % 2 == 0]) > 0.95
    kept = quality.good_documents(docs, model)
    assert {r.doc_id for r in kept.collect()} == {d for d, s in got.items() if s >= 0.5}
    assert quality.fit(stats, labels.limit(0)).score(np.zeros((1, len(quality.NAMES))))[0] == 0.5
    assert quality.document_statistics(empty).count() == 0
    x, y = quality.pool_adjacent_violators(np.arange(5.0), np.array([0, 1, 0, 1, 1.0]), np.ones(5))
    assert (np.diff(y) > 0).all() and len(x) == 3


def test_language_learns(spark, empty):
    rng = random.Random(0)
    parts = {"xx": ["foo", "bar", "qua"], "yy": ["ñam", "zil", "ött"]}
    rows = [(i, " ".join("".join(rng.choices(parts[lang], k=2)) for _ in range(20)), lang) for i in range(120) for lang in [("xx", "yy")[i % 2]]]
    docs = spark.createDataFrame(rows + [(500, None, "xx"), (501, "12 !", "yy"), (502, "ÑAMZIL Öttzil", None)], "doc_id long, text string, lang string")
    model = langid.fit(docs.where("doc_id < 60"))
    got = {r.doc_id: r for r in langid.identify(docs, model).collect()}
    assert all(got[i].lang_pred == lang for i, _, lang in rows)
    assert got[500].lang_pred == "und" and got[501].lang_pred == "und" and got[502].lang_pred == "yy"
    assert all(0 <= r.score <= 1 for r in got.values())
    nobody = langid.fit(docs.limit(0))
    assert {r.lang_pred for r in langid.identify(docs, nobody).collect()} == {"und"} and langid.identify(empty, model).count() == 0
    keys = np.arange(1000, dtype=np.uint64)
    made = langid.LanguageFilter(["a", "b"], 1000)
    made.add(keys[:600], 0)
    made.add(keys[400:], 1)
    mask = made.languages(keys)
    assert (mask[:600] & 1).all() and (mask[400:] & 2).all()


def test_pipeline_is_brute_force(spark, tmp_path):
    """Each stage against a plain version of it, on what the stage before kept: nulls, empty texts, repeated rows and ids."""
    import corpus_pipeline
    from tokenizers import Tokenizer

    folder = str(tmp_path)
    rng = random.Random(9)
    base = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").limit(160).collect()]
    base += [base[3], base[3], (None, base[5][1], "en", None, 1), (9001, None, "en", "a", 0), (9002, "", None, "a", 0), (base[7][0], base[8][1], "de", "b", 3)]
    rng.shuffle(base)
    spark.createDataFrame(base, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{folder}/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet").write.parquet(f"{folder}/{t}.parquet")
    docs, seen = corpus_pipeline.documents(spark, folder), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        out.write.parquet(f"{folder}/{name}")
        seen[name] = ([tuple(r) for r in docs.collect()], out.columns, [tuple(r) for r in spark.read.parquet(f"{folder}/{name}").collect()])
        assert name == "tokens" or out.columns == docs.columns
        docs = spark.read.parquet(f"{folder}/{name}")

    given, _, kept = seen["quality"]
    model = quality.fit(quality.document_statistics(spark.createDataFrame(given, docs_schema := "doc_id long, text string, lang string, source string, n_chars long").join(quality.learning_labels(spark, folder).select("doc_id").distinct(), "doc_id", "left_semi")), quality.learning_labels(spark, folder))
    assert not collections.Counter(kept) - collections.Counter(given) and 0 < len(kept) < len(given)
    good = {r.doc_id for r in quality.good_documents(spark.createDataFrame(given, docs_schema), model).collect()}
    assert {r[0] for r in kept} == good

    given, _, kept = seen["jaccard"]
    sets = [shingles(r[1]) for r in given]
    group = list(range(len(given)))
    find = lambda i: i if group[i] == i else find(group[i])
    for i in range(len(given)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and 100 * common >= 80 * len(sets[i] | sets[j]) or given[i] == given[j]:
                group[find(i)] = find(j)
    least = {}
    for i, r in enumerate(given):
        if r[0] is not None:
            least[find(i)] = min(r[0], least.get(find(i), r[0]))
    want = {r for i, r in enumerate(given) if find(i) not in least or r[0] == least[find(i)]}
    assert {r for r in kept} == want and len(kept) == len({(r[0], r[1]) for r in kept})

    given, _, kept = seen["decontamination"]
    items = spark.read.parquet(f"{folder}/benchmark.parquet")
    leaks = {(r.doc_id, r.item_id) for r in decontam.contaminated(spark.createDataFrame(given, docs_schema), items).collect()}
    exact = {r[0] for r in given for i in items.collect() if i.text and len(i.text.split()) >= 5 and " ".join(i.text.lower().split()) in " ".join((r[1] or "").lower().split())}
    assert exact <= {d for d, _ in leaks} | {None}
    assert collections.Counter(kept) == collections.Counter(r for r in given if r[0] not in {d for d, _ in leaks})

    given, _, kept = seen["mixing"]
    size = lambda t: len(WORDS.findall(t or ""))
    taken = collections.Counter(r[:2] for r in kept)
    assert set(taken) <= {r[:2] for r in given} and max(taken.values()) <= 2
    assert abs(sum(size(r[1]) for r in kept) - 1.5 * sum(size(r[1]) for r in given)) <= 3 * max(size(r[1]) for r in given)

    given, _, kept = seen["tokens"]
    tokenizer, start = Tokenizer.from_file(tokens.vocabulary_path()), 0
    served = [tuple(r) for r in spark.read.parquet(f"{folder}/mixing").selectExpr("doc_id", "text", "_metadata.file_name f", "_metadata.row_index i").orderBy("f", "i").collect()]
    for (d, text, *_), row in zip(served, sorted(kept, key=lambda r: r[1]), strict=True):
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        assert row == (d, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_decontamination_finds_moved_words(spark):
    """Every window by brute force: halves swapped, a sentence or options moved, at an end, cut off, repeated."""
    rng = random.Random(5)
    say = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    item, short, beat = say(104).split(), say(40).split(), "to be or not to be that is".split() * 5
    swapped = item[52:] + item[:52]
    moved = item[:20] + item[35:90] + item[20:35] + item[90:]
    texts = [swapped, moved, item, item[:99], item[9:], short[25:] + short[:25], beat[3:] + beat[:3], beat * 3, item[60:] + item[:60] + say(9).split() + swapped, item[:30] + say(40).split() + item[30:]]
    texts = [" ".join(x) for w in texts for x in (w, say(70).split() + w + say(50).split(), w + say(30).split())]
    items = [(1, " ".join(item)), (2, " ".join(short)), (3, " ".join(beat)), (4, "to be or not")]
    want = {}
    for n, text in items:
        k = min(5, len(text.split()))
        cut = lambda t, k=k: [tuple(t.split()[i : i + k]) for i in range(len(t.split()) - k + 1)]
        own = cut(text)
        for d, t in enumerate(texts):
            for a in range(1 - len(own), len(cut(t))):
                part = cut(t)[max(0, a) : a + len(own)]
                shared = sum((collections.Counter(part) & collections.Counter(own)).values())
                found = (shared / (len(part) + len(own) - shared), -a)
                if found[0] >= 0.8:
                    want[d, n] = max(found, want.get((d, n), found))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r.doc_id, r.item_id): (r.similarity, -r.window_start) for r in decontam.contaminated(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == want and (0, 1) in want and (1, 1) in want


def test_added_tokens_are_the_librarys(spark):
    """Against a tokenizer as it comes from its file, without a switch."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokens.vocabulary_path())
    texts = ["a <|endoftext|> b", "x<|startoftext|>y", "<|ENDOFTEXT|> <|endoftext |>", "日本 <|endoftext|><|endoftext|>", "plain words", "<|endoftext|>"]
    want, start = [], 0
    for d, t in enumerate(texts):
        ids = np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 2], "<u4")
        want.append((d, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert 49407 in tokenizer.encode(texts[0], add_special_tokens=False).ids
    assert [tuple(r) for r in tokens.token_output(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("start").collect()] == want


def test_more_languages_than_a_word_has_bits(spark):
    rng = random.Random(1)
    parts = {f"l{i:03d}": ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(4)) for _ in range(5)] for i in range(130)}
    rows = [(i, " ".join(rng.choice(own) for _ in range(15)), lang) for i, (lang, own) in enumerate(2 * list(parts.items()))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs.where("doc_id < 130"))
    assert model.langs == sorted(parts) and model.slots.shape[0] == 3
    assert {r.doc_id: r.lang_pred for r in langid.identify(docs, model).collect()} == {i: lang for i, _, lang in rows}
    keys = np.arange(650, dtype=np.uint64)
    made = langid.LanguageFilter([str(i) for i in range(65)], 650)
    for i in range(65):
        made.add(keys[10 * i : 10 * i + 10], i)
    mask = made.languages(keys)
    assert all(made.has(mask[10 * i : 10 * i + 10], i).all() for i in range(65)) and made.has(mask, 64).sum() < 20


def test_long_texts_and_hot_anchors(monkeypatch):
    """Parts of a long text, and several shards of one anchor, give what one part and one shard give."""
    import pyarrow as pa

    rng = np.random.default_rng(4)
    raw = rng.integers(97, 99, 9000).astype(np.uint8)
    at = np.array([0, 10, 10, 5000, 9000])
    batch = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()), strict=True)], ["anchor", "doc_id", "tag", "start", "near"])
    rows = [(int(rng.integers(0, 3)) if i % 2 else 5, int(rng.integers(0, 40)), 0, i * 100, bytes(rng.integers(97, 99, 57).astype(np.uint8))) for i in range(400)]
    rows = sorted(rows + [(a, d, 1, 7 * i, near) for i, (a, _, _, _, near) in enumerate(rows[:60:7]) for d in (0, 20, 41, 42)])

    def strings():
        row, place, size, anchor, _ = suffixes.anchors(raw, at)
        return sorted((int(at[r]) + int(p) + k, int(h)) for r, p, z, h in zip(row, place, size, anchor, strict=True) for k in range(int(z) - 49))

    def bytes_gone():
        out = set()
        for made in suffixes._shards(iter([batch(rows[:150]), batch(rows[150:])])):
            for d, tag, spans in zip(*(made.column(c).to_pylist() for c in ("doc_id", "tag", "spans")), strict=True):
                out |= {(d, tag, i) for a, b in np.frombuffer(spans, "<i8").reshape(-1, 2) for i in range(a, b)}
        return out

    whole, gone = strings(), bytes_gone()
    assert [x for x, _ in whole] == [i for a, b in zip(at, at[1:], strict=False) for i in range(a, b - 49)] and gone
    for shard in (1 << 11, 1 << 12):
        monkeypatch.setattr(suffixes, "SHARD", shard)
        assert bytes_gone() == gone
        assert [x for x, _ in strings()] == [x for x, _ in whole]
