"""Sources and text exports: package and page blocks, lexicon lines, part folders."""

from __future__ import annotations

import io
import posixpath
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser
from typing import TYPE_CHECKING
from urllib.parse import unquote
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

if TYPE_CHECKING:  # workers that need no pandas don't load it
    import pandas as pd

LEAVES = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "blockquote", "dt", "dd"}
_CLOSE_P = LEAVES | {"div", "ul", "ol", "dl", "table", "section", "article", "hr", "pre", "form"}
_SKIP = {"script", "style", "head", "title", "template"}
_VOID = {"br", "hr", "img", "meta", "link", "input", "source", "wbr", "area", "base", "col", "embed", "track", "param"}


class Blocks(HTMLParser):
    """Leaf blocks of a page in order: a block whose element holds no other block. Text outside of blocks is in ``shown`` only."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found: list[tuple[str, str | None, str]] = []
        self.open: list[dict] = []
        self.quiet = 0
        self.visible: list[str] = []
        self.shown: list[str] = []

    def _close(self, upto: int) -> None:
        while len(self.open) > upto:
            b = self.open.pop()
            text = " ".join("".join(b["text"]).split())
            if text:
                self.found.append((b["tag"], b["id"], text))

    def handle_starttag(self, tag, attrs):
        if tag in _SKIP:
            self.quiet += tag not in _VOID
            return
        if tag == "br" and self.open:
            self.open[-1]["text"].append(" ")
        if tag in _CLOSE_P and self.open and self.open[-1]["tag"] == "p":
            self._close(len(self.open) - 1)
        if tag in LEAVES:
            if self.open:  # what stands before an inner block is a block of its own
                outer = self.open[-1]
                text = " ".join("".join(outer["text"]).split())
                if text:
                    self.found.append((outer["tag"], outer["id"], text))
                outer["text"] = []
            self.open.append({"tag": tag, "id": dict(attrs).get("id"), "text": []})

    def handle_endtag(self, tag):
        if tag in _SKIP:
            self.quiet = max(0, self.quiet - 1)
        elif tag in LEAVES:
            at = next((i for i in range(len(self.open) - 1, -1, -1) if self.open[i]["tag"] == tag), None)
            if at is not None:
                self._close(at)
        elif tag in _CLOSE_P or tag in ("body", "html"):
            if self.open and self.open[-1]["tag"] == "p":
                self._close(len(self.open) - 1)

    def handle_data(self, data):
        if self.quiet:
            return
        self.shown.append(data)
        if self.open:
            self.visible.append(data)
            self.open[-1]["text"].append(data)


def blocks_of(html: str | None) -> tuple[list[tuple[str, str | None, str]], str]:
    """(tag, element id, text) of the blocks, and the visible text of all block elements."""
    parser = Blocks()
    parser.feed(html or "")
    parser.close()
    parser._close(0)
    return parser.found, "".join(parser.visible)


def shown_text(html: str | None) -> str:
    """All the text that a page shows, inside of block elements or not."""
    parser = Blocks()
    parser.feed(html or "")
    parser.close()
    return "".join(parser.shown)


#: Pages that a task holds as Python objects at a time.
PAGES_AT_ONCE = 32


def _few(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches in slices, so that what a task holds of them doesn't grow with a batch."""
    for batch in batches:
        for at in range(0, batch.num_rows, PAGES_AT_ONCE):
            yield batch.slice(at, PAGES_AT_ONCE)


def html_blocks(pages: DataFrame, html: str = "html", key: str = "page_id") -> DataFrame:
    """SRC-2: (key, block_order, tag, element_id, text), a few pages at a time out of Arrow batches."""
    kind = pages.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _few(batches):
            rows = [(n, i, *block) for n, h in enumerate(batch.column(html).to_pylist()) for i, block in enumerate(blocks_of(h)[0])]
            n, i, *block = zip(*rows, strict=True) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(n, pa.int32())), pa.array(i, pa.int32()), *[pa.array(c, pa.string()) for c in block]], [key, "block_order", "tag", "element_id", "text"])

    schema = T.StructType([T.StructField(key, kind), T.StructField("block_order", T.IntegerType()), T.StructField("tag", T.StringType()), T.StructField("element_id", T.StringType()), T.StructField("text", T.StringType())])
    return pages.select(key, html).mapInArrow(run, schema)


def visible_text(pages: DataFrame, html: str = "html", key: str = "page_id") -> DataFrame:
    """The text that SRC-4 holds the blocks against."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _few(batches):
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array([shown_text(h) for h in batch.column(html).to_pylist()], pa.string())], [key, "visible"])

    return pages.select(key, html).mapInArrow(run, T.StructType([T.StructField(key, pages.schema[key].dataType), T.StructField("visible", T.StringType())]))


XHTML = "application/xhtml+xml"


def spine_documents(data: bytes) -> list[tuple[str, str]]:
    """(href, markup) of a package's reading order."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        local = lambda e: e.tag.rpartition("}")[2]
        root = next(e.get("full-path") for e in ElementTree.fromstring(z.read("META-INF/container.xml")).iter() if local(e) == "rootfile")
        package = ElementTree.fromstring(z.read(root))
        # other media in the reading order have no blocks; hrefs are escaped and may point into a document
        items = {e.get("id"): unquote((e.get("href") or "").partition("#")[0]) for e in package.iter() if local(e) == "item" and e.get("media-type", XHTML) == XHTML}
        names = [posixpath.normpath(posixpath.join(posixpath.dirname(root), items[e.get("idref")])) for e in package.iter() if local(e) == "itemref" and e.get("idref") in items]
        return [(n, z.read(n).decode("utf-8", "replace")) for n in names]


BLOCKS = "doc_id string, block_order int, block_id string, chapter_id string, text string, source struct<href:string,block_index:int,element_id:string,tag:string>"


def epub_blocks(files: DataFrame) -> DataFrame:
    """SRC-1: blocks of packages read with Spark's ``binaryFile`` source, one package at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pandas as pd

        for pdf in batches:
            for path, data in zip(pdf["path"], pdf["content"], strict=True):
                rows, n = [], 0
                doc = posixpath.basename(path)
                for c, (href, markup) in enumerate(spine_documents(data)):
                    for i, (tag, eid, text) in enumerate(blocks_of(markup)[0]):
                        rows.append((doc, n, f"p{n + 1:07d}", f"ch{c + 1:03d}", text, {"href": href, "block_index": i, "element_id": eid, "tag": tag}))
                        n += 1
                yield pd.DataFrame(rows, columns=["doc_id", "block_order", "block_id", "chapter_id", "text", "source"])

    return files.select("path", "content").mapInPandas(run, BLOCKS)


def chapter_titles(blocks: DataFrame, keys: list[str], fallback: Column) -> DataFrame:
    """SRC-3: the first heading of a chapter, else a fallback."""
    first = F.min_by("text", F.when(F.col("tag").rlike("^h[1-6]$"), F.col("block_order")))
    return blocks.groupBy(*keys).agg(first.alias("_t")).withColumn("title", F.coalesce("_t", fallback)).drop("_t")


def pick_asset(items: DataFrame, rules: list[Column], key: str, order: str) -> DataFrame:
    """SRC-5: of each key the item of the first rule that any meets."""
    rank = F.lit(None).cast("int")
    for i, rule in reversed(list(enumerate(rules))):
        rank = F.when(rule, i).otherwise(rank)
    ranked = items.withColumn("_p", rank).where("_p IS NOT NULL")
    return ranked.withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy("_p", order))).where("_n = 1").drop("_n").withColumnRenamed("_p", "rule")


MANIFEST = T.StructType([
    T.StructField("title", T.StringType()), T.StructField("author", T.StringType()),
    T.StructField("segments", T.ArrayType(T.StructType([T.StructField("id", T.StringType()), T.StructField("paragraph_id", T.StringType()), T.StructField("chapter_id", T.StringType()), T.StructField("speaker", T.StringType()), T.StructField("text", T.StringType()), T.StructField("pause_after_ms", T.IntegerType())]))),
])


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """SRC-6: (path, seg_order, id, ...) of nested JSON manifests."""
    raw = spark.read.schema(MANIFEST).option("multiLine", True).json(path).withColumn("path", F.input_file_name())
    return raw.select("path", F.posexplode("segments").alias("seg_order", "s")).select("path", "seg_order", "s.*")


def read_lexicon(spark: SparkSession, paths: list[str], layer: str) -> DataFrame:
    """SRC-7: ``key=value`` or two fields a line, ``#`` comments; a later file wins; values of other letters are left out."""
    from fabula.functions.text import letters

    out = None
    for n, path in enumerate(paths):
        lines = spark.read.text(path).select(F.trim(F.regexp_replace("value", "#.*$", "")).alias("line")).where("line <> ''")
        pair = F.split("line", r"\s*=\s*|\s+", 2)
        rows = lines.select(F.lower(pair[0]).alias("key"), pair[1].alias("value"), F.lit(n).alias("ord")).where("value IS NOT NULL")
        out = rows if out is None else out.unionByName(rows)
    good = out.where(~F.col("key").endswith("-*") & (letters(F.col("key")) == letters(F.col("value"))))
    return good.groupBy("key").agg(F.max_by("value", F.struct("ord", "value")).alias("value"), F.max("ord").alias("ord")).select(F.lit(layer).alias("layer"), "key", "value", "ord")


def read_prefixes(spark: SparkSession, path: str) -> DataFrame:
    """SRC-8: ``key-*=value-*`` rules."""
    pair = F.split(F.trim("value"), "=")
    rows = spark.read.text(path).select(pair[0].alias("k"), pair[1].alias("v")).where(F.col("k").endswith("-*") & F.col("v").endswith("-*"))
    return rows.select(F.lower(F.expr("substring(k, 1, length(k) - 2)")).alias("key"), F.expr("substring(v, 1, length(v) - 2)").alias("value"))


def discover_parts(paths: DataFrame, required: list[str], expect: int | None = None, doc: str = "doc_id") -> DataFrame:
    """SRC-9: (doc, part, missing, hole): numbered parts, the members each lacks, and holes in the numbering."""
    named = paths.withColumn("part", F.nullif(F.regexp_extract("path", r"part[-_]?(\d+)", 1), F.lit("")).cast("int")).withColumn("member", F.regexp_extract("path", r"([^/]+)$", 1)).where("part IS NOT NULL")
    parts = named.groupBy(doc, "part").agg(F.collect_set("member").alias("_m"))
    w = W.partitionBy(doc).orderBy("part")
    got = parts.withColumn("missing", F.array_sort(F.array_except(F.array(*map(F.lit, required)), F.col("_m")))).withColumn("hole", F.col("part") - F.coalesce(F.lag("part").over(w), F.lit(0)) > 1)
    short = F.lit(False) if expect is None else F.lead("part").over(w).isNull() & (F.col("part") < expect)
    return got.withColumn("short", short).drop("_m")


def export_text(segments: DataFrame, doc="doc_id", order="seg_order", block="block_id", text="text") -> DataFrame:
    """SRC-10: a document's text: rows of one block in a row joined by a blank, blocks by a line feed."""
    from fabula.operators.windows import islands

    runs = islands(segments, block, doc, order).groupBy(doc, "island").agg(F.array_sort(F.collect_list(F.struct(order, text))).alias("_t"))
    lines = runs.select(doc, "island", F.array_join(F.transform("_t", lambda x: x[text]), " ").alias("_line"))
    whole = lines.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct("island", "_line"))).alias("_l"))
    return whole.select(doc, F.array_join(F.transform("_l", lambda x: x["_line"]), "\n").alias("text"))


def write_segments(segments: DataFrame, path: str, doc: str = "doc_id") -> None:
    """SNK-1, SNK-2: JSON lines by document, published whole by Spark's commit protocol."""
    segments.write.partitionBy(doc).json(path)
