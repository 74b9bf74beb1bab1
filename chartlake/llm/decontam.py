"""Benchmark decontamination by Wu-Manber search over words.

Every run of 13 consecutive words of a benchmark item is a test string; an item of fewer words, but not none, is one.
Test strings of one length share a matcher: a shift table over blocks of two words says how far the search may jump
(blocks that no test string holds allow the longest jump), a suffix table maps the block that ends test strings to
their places among the items' words, and those are compared word by word. Items come in blocks of at most about
BLOCK_BYTES, each block a scan of all documents, so what a worker holds stays bounded however many items there are:
2 MB of random text make tables of about 130 MB. A worker builds the tables of a block once. What later blocks hit is
joined to the documents by their texts' hashes (128 bits).

Words are runs of 0-9, a-z (A-Z lower-cased) and characters beyond ASCII. Null and empty texts have no words; texts
are searched whole, one at a time, whatever their length; items without words are ignored; items that repeat an id
count once and a null item id reads as an empty string. Repeated documents each get their row, judged on its own text.
Empty tables give empty or clean results. Columns other than those named are ignored.
"""

from __future__ import annotations

import re
import uuid
from collections import defaultdict
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lean

WINDOW = 13
BLOCK_BYTES = 2_000_000
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")

SPAN = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType())])
_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))


def words_of(raw: bytes | None) -> list[bytes]:
    return _WORD.findall(raw.lower()) if raw else []


class WuManber:
    """Searches sequences of words for test strings of one length.

    corpus holds the words of all items one after another; a test string is known by its places in it.
    """

    def __init__(self, length: int, corpus: list[bytes], places: dict[int, str]):
        self.length, self.corpus, self.items = length, corpus, places
        self.block = min(2, length)
        self.jump = length - self.block + 1
        self.shift: dict[tuple[bytes, ...], int] = {}
        self.suffix: dict[tuple[bytes, ...], list[int]] = defaultdict(list)
        for at in places:
            for end in range(self.block, length + 1):
                part = tuple(corpus[at + end - self.block : at + end])
                if length - end < self.shift.get(part, self.jump):
                    self.shift[part] = length - end
            self.suffix[part].append(at)

    def find(self, words: list[bytes]) -> Iterable[tuple[int, int]]:
        """(start, place of the test string) of every occurrence."""
        shift, jump, back, length, corpus = self.shift.get, self.jump, self.block - 1, self.length, self.corpus
        end, n = length - 1, len(words)
        while end < n:
            part = tuple(words[end - back : end + 1])
            step = shift(part, jump)
            if step:
                end += step
                continue
            start = end - length + 1
            window = words[start : end + 1]
            for at in self.suffix[part]:
                if corpus[at : at + length] == window:
                    yield start, at
            end += 1


def matchers(items: Iterable[tuple[str, bytes]], window: int) -> list[WuManber]:
    corpus: list[bytes] = []
    known: dict[bytes, bytes] = {}
    by_length: dict[int, dict[int, str]] = defaultdict(dict)
    for item, raw in items:
        words = [known.setdefault(w, w) for w in words_of(raw)]
        size = min(window, len(words))
        for i in range(len(words) - size + 1 if size else 0):
            by_length[size][len(corpus) + i] = item
        corpus += words
    return [WuManber(size, corpus, places) for size, places in sorted(by_length.items())]


def merged(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for start, stop in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(stop, out[-1][1]))
        else:
            out.append((start, stop))
    return out


#: The matchers of the block that a worker searched last.
_built: dict[str, list[WuManber]] = {}


def _search(block, name: str, window: int, every: bool):
    """A mapInArrow function over columns ending with raw; it puts n_words, spans and items in its place.

    every: gives rows without a hit too.
    """

    def run(batches):
        if name not in _built:
            _built.clear()
            _built[name] = matchers(block.value, window)
        for batch in batches:
            keep, counts, spans, items = [], [], [], []
            for row, raw in enumerate(batch.column(batch.num_columns - 1)):
                words = words_of(raw.as_py())
                found, hit = [], set()
                for matcher in _built[name]:
                    for start, at in matcher.find(words):
                        found.append((start, start + matcher.length))
                        hit.add(matcher.items[at])
                if every or found:
                    keep.append(row), counts.append(len(words))
                    spans.append([{"start": a, "stop": b} for a, b in merged(found)])
                    items.append(sorted(hit))
            rest = batch.select(batch.schema.names[:-1]).take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(counts, pa.int64()), pa.array(spans, _SPANS), pa.array(items, pa.list_(pa.string()))], [*rest.schema.names, "n_words", "spans", "items"])

    return lean(run)


def _united(batches):
    """Merges the spans and items that several blocks found, the last column."""
    for batch in batches:
        spans, items = [], []
        for parts in batch.column(batch.num_columns - 1):
            parts = parts.as_py() or ()
            spans.append([{"start": a, "stop": b} for a, b in merged((s["start"], s["stop"]) for p in parts for s in p["spans"])])
            items.append(sorted({x for p in parts for x in p["items"]}))
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(spans, _SPANS), pa.array(items, pa.list_(pa.string()))], [*batch.schema.names[:-1], "spans", "items"])


FOUND = [T.StructField("n_words", T.LongType()), T.StructField("spans", T.ArrayType(SPAN)), T.StructField("items", T.ArrayType(T.StringType()))]


def with_leaks(docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs with n_words, spans (merged word ranges that are hit) and items (sorted ids as text), judged row by row.

    docs has no columns of these names. Each block of items is a scan of docs; only the first carries its columns.
    """
    texts = items.where(F.col(item_text).isNotNull()).select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), F.col(item_text).cast("binary").alias("raw"))
    total = texts.agg(F.sum(F.length("raw"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    texts = texts.withColumn("block", F.pmod(F.xxhash64("item", "raw"), F.lit(blocks)))
    raw = F.col(text_col).cast("binary").alias("__raw")

    def searched(rows: DataFrame, block: int, every: bool) -> DataFrame:
        held = [(r["item"], bytes(r["raw"])) for r in texts.where(F.col("block") == block).collect()]
        schema = T.StructType([T.StructField(f.name, f.dataType) for f in rows.schema.fields[:-1]] + FOUND)
        return rows.mapInArrow(_search(docs.sparkSession.sparkContext.broadcast(held), uuid.uuid4().hex, window, every), schema)

    if blocks == 1:
        return searched(docs.select("*", raw), 0, True)

    def keys() -> list[Column]:
        return [F.xxhash64("__raw").alias("__k1"), F.xxhash64(F.lit(1), "__raw").alias("__k2")]

    rows = docs.select("*", raw).select("*", *keys()).select(*docs.columns, "__k1", "__k2", "__raw")
    out = searched(rows, 0, True)
    parts = None
    for block in range(1, blocks):
        hits = searched(docs.select(raw).select(*keys(), "__raw"), block, False)
        hits = hits.groupBy("__k1", "__k2").agg(F.first("spans").alias("spans"), F.first("items").alias("items"))  # copies hit alike
        parts = hits if parts is None else parts.unionByName(hits)
    parts = parts.groupBy("__k1", "__k2").agg(F.collect_list(F.struct("spans", "items")).alias("__more"))
    out = out.join(parts, ["__k1", "__k2"], "left")
    both = F.concat(F.array(F.struct("spans", "items")), F.coalesce("__more", F.array().cast(parts.schema["__more"].dataType)))
    out = out.select(*docs.columns, "n_words", both.alias("__all"))
    return out.mapInArrow(lean(_united), T.StructType([T.StructField(f.name, f.dataType) for f in out.schema.fields[:-1]] + FOUND[1:]))


def find_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """One row per document: id, n_words, spans and items, as with_leaks finds them."""
    rows = with_leaks(docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")), items, "__text", **how)
    return rows.select(F.col("__id").alias(id_col), "n_words", "spans", "items")


def judged(leaks: DataFrame) -> DataFrame:
    """Adds n_hit, n_items, items_sha256 and contaminated (at least one word in twenty is hit)."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + (s["stop"] - s["start"]))
    out = leaks.withColumn("n_hit", hit).withColumn("n_items", F.size("items").cast("long"))
    out = out.withColumn("items_sha256", F.sha2(F.array_join("items", ","), 256))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * 20 >= F.col("n_words")))


def drop_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", **how) -> DataFrame:
    """docs without contaminated rows, each judged on its own text; all columns stay as they are."""
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("__row"), F.col(text_col).alias("__text"))
    kept = judged(with_leaks(rows, items, "__text", **how)).where("not contaminated")
    return kept.select("__row.*")
