"""MinHash near-dedup: banded MinHash candidates, odd sketches, exact confirmation on full shingle sets.

Copies (same word sequence) are folded first. For each distinct text 128 MinHash values make 32 bands of 4 (a pair at
similarity 0.75 shares no band with probability 5e-6), and its bottom-k MinHash sample (the 1024 smallest shingle
hashes) is folded into a 1024-bit odd sketch: each sampled hash flips one bit, so the XOR of two sketches counts the
hashes that only one sample holds. Where both samples are whole sets this count is at most the sets' difference, so
the test loses nothing; beyond that it allows 4.5 deviations. Within a bucket only pairs of different components whose
sketches are close enough become candidates, best first, and each is confirmed on its full sets. Rounds go on, with
ever more partners each, until no untested candidate between different components is left; so nothing is capped and
pairs inside a component are never spelled out. A bucket of more than HOT texts is never joined with itself: its texts
are compared block by block in tasks, and a round returns no more than each text's closest partners beyond those that
it has tested, so the rows of a round grow with the texts and not with the square of a bucket.

Nulls, empty texts and texts of white space alone have no shingles and are linked with nothing. What is linked are
texts: repeated rows are copies of each other, and different texts of one id are judged apart. Texts whose rows all
lack an id link others, but are never a component's id. An empty table gives an empty result; columns other than the
id and the text are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import SMALL_IDS, checkpointed, if_small, keys64, lean, lean_group, merged_labels, mix64, shingle_set, word_hashes

BANDS, ROWS, SAMPLE, BITS, WORDS = 32, 4, 1024, 1024, 5
LANES = BITS // 64
#: Buckets of more texts are compared in blocks of about BLOCK texts each; of their pairs a round tests at most PARTNERS
#: for each text on average, and MOST_PARTNERS for one text. What a round leaves, the next ones test.
HOT, BLOCK, PARTNERS, MOST_PARTNERS = 64, 2048, 64, 4096


def minima(shingles: np.ndarray, samples: int = BANDS * ROWS) -> np.ndarray:
    best = np.full(samples, np.iinfo(np.uint64).max, np.uint64)
    factors = keys64(samples, 21)[:, None]
    for at in range(0, len(shingles), 2048):
        np.minimum(best, (factors * shingles[None, at : at + 2048]).min(axis=1), out=best)
    return best


def odd_sketch(grams: np.ndarray) -> np.ndarray:
    """Parity bitmap, as 64-bit lanes, of the bottom-k sample of a sorted set of hashes."""
    flips = mix64(grams[:SAMPLE]) % np.uint64(BITS)
    parity = (np.bincount(flips.astype(np.int64), minlength=BITS) & 1).astype(np.uint8)
    return np.packbits(parity).view(np.uint64)


def most_flips(n: Column, m: Column, percent: int, sigmas: float = 4.5) -> Column:
    """Largest XOR population count that sets of n and m shingles reach at the given similarity.

    The sampled share f of the union is whole for small sets; there the difference itself is the bound.
    """
    k, l = F.least(n, F.lit(SAMPLE)), F.least(m, F.lit(SAMPLE))
    f = F.least(k / n, l / m)
    shared = (n + m) * (percent / (100 + percent))
    both = f * shared - sigmas * F.sqrt(f * (1 - f) * shared)
    differ = k + l - 2 * both
    odd = 0.5 * (1 - F.exp(-2 * differ / BITS))
    deviating = BITS * odd + sigmas * F.sqrt(BITS * odd * (1 - odd))
    return F.when((n <= SAMPLE) & (m <= SAMPLE), differ).otherwise(F.least(differ, deviating)) + 1e-6


def flip_limits(n: np.ndarray, m: np.ndarray, percent: int, sigmas: float = 4.5) -> np.ndarray:
    """most_flips for arrays."""
    k, l = np.minimum(n, SAMPLE), np.minimum(m, SAMPLE)
    f = np.minimum(k / n, l / m)
    shared = (n + m) * (percent / (100 + percent))
    differ = k + l - 2 * (f * shared - sigmas * np.sqrt(f * (1 - f) * shared))
    odd = 0.5 * (1 - np.exp(-2 * differ / BITS))
    deviating = BITS * odd + sigmas * np.sqrt(BITS * odd * (1 - odd))
    return np.where((n <= SAMPLE) & (m <= SAMPLE), differ, np.minimum(differ, deviating)) + 1e-6


def _signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)


def signatures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """(id, hash, n_shingles, key, bands, sketch) of every row; hash is the text's, key that of its word sequence (128 bits)."""

    def run(batches):
        for batch in batches:
            counts, keys, bands, sketches = [], [], [], []
            for text in batch.column(2):
                hashed = word_hashes((text.as_py() or b"").lower())
                grams = shingle_set(hashed, words)
                counts.append(len(grams))
                if not len(grams):
                    keys.append(None), bands.append([]), sketches.append([])
                    continue
                keys.append(text_key(hashed))
                best = minima(grams)
                rows = (best.reshape(BANDS, ROWS) * keys64(ROWS, 23)[None, :]).sum(axis=1, dtype=np.uint64)
                bands.append(_signed(mix64(rows + keys64(BANDS, 24))))
                sketches.append(_signed(odd_sketch(grams)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(counts, pa.int64()), pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sketches, pa.list_(pa.int64()))],
                ["id", "hash", "n_shingles", "key", "bands", "sketch"],
            )

    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("hash"), F.col(text_col).cast("binary").alias("text"))
    schema = T.StructType(
        [rows.schema["id"], rows.schema["hash"], T.StructField("n_shingles", T.LongType()), T.StructField("key", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType())), T.StructField("sketch", T.ArrayType(T.LongType()))]
    )
    return rows.mapInArrow(lean(run), schema)


def text_key(hashed: np.ndarray) -> bytes:
    """Identifies a sequence of word hashes by 128 bits and its length."""
    place = np.arange(1, len(hashed) + 1, dtype=np.uint64)
    pair = [mix64(hashed + place * np.uint64(f)).sum(dtype=np.uint64) for f in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)]
    return np.array([*pair, len(hashed)], np.uint64).tobytes()


def shingle_sets(texts: DataFrame, words: int) -> DataFrame:
    """(key, grams) of the texts, the only column: the key and the full sorted shingle set."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                hashed = [word_hashes((t.as_py() or b"").lower()) for t in batch.column(0).slice(at, 256)]
                sets = [_signed(shingle_set(h, words)) for h in hashed]
                yield pa.RecordBatch.from_arrays([pa.array([text_key(h) for h in hashed], pa.binary()), pa.array(sets, pa.list_(pa.int64()))], ["key", "grams"])

    return texts.mapInArrow(lean(run), "key binary, grams array<long>")


def _confirmed(pairs: DataFrame, reps: DataFrame, docs: DataFrame, id_col: str, text_col: str, words: int, percent: int) -> DataFrame:
    """(lx, ly, linked) for pairs of nodes (a, b, lx, ly): the exact test on both full sets.

    reps has (node, rep), rep being the id of a row with the node's text.
    """
    ends = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    needed = checkpointed(ends.join(reps, "node").select(F.col("rep").alias("__id")).distinct())
    texts = docs.select(F.col(id_col).alias("__doc"), F.col(text_col).cast("binary").alias("__text"))
    chosen = texts.join(if_small(needed, needed.count(), SMALL_IDS), F.col("__doc").eqNullSafe(F.col("__id")), "left_semi")
    sets = shingle_sets(chosen.select("__text"), words).groupBy(F.xxhash64("key").alias("node")).agg(F.first("grams").alias("grams"))
    sets = checkpointed(sets)
    left = sets.select(F.col("node").alias("a"), F.col("grams").alias("ga"))
    right = sets.select(F.col("node").alias("b"), F.col("grams").alias("gb"))
    shared = F.size(F.array_intersect("ga", "gb"))
    test = shared * 100 >= (F.size("ga") + F.size("gb") - shared) * percent
    return pairs.join(left, "a").join(right, "b").select("lx", "ly", test.alias("linked"))


def _lists(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """Lists of one width as the unsigned rows of a matrix, one for each place in the lists."""
    values = pa.concat_arrays(column.chunks).flatten().to_numpy(zero_copy_only=False)
    return np.ascontiguousarray(values.reshape(-1, width).T).view(np.uint64)


def closest(percent: int, partners: int):
    """Function of two tables: for each left text of a bucket's block its closest right texts of other components.

    Only pairs whose sketches are near, that come after the left text's mark (d, y) and that share no earlier band; so
    a pair is found once, and each left text has at most `partners` rows.
    """
    schema = pa.schema([("x", pa.int64()), ("y", pa.int64()), ("lx", pa.int64()), ("ly", pa.int64()), ("d", pa.float64())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        parts = []
        if left.num_rows and right.num_rows:
            x, lx, xn, md, my = (left[c].to_numpy() for c in ("node", "label", "n", "mark", "mark_y"))
            y, ly, yn = (right[c].to_numpy() for c in ("node", "label", "n"))
            xs, ys, xb, yb = _lists(left["sketch"], LANES), _lists(right["sketch"], LANES), _lists(left["bands"], BANDS), _lists(right["bands"], BANDS)
            own = int(np.argmax(_signed(xb[:, 0].copy()) == left["band"][0].as_py()))
            for at in range(0, len(x), 128):
                rows = slice(at, at + 128)
                flips = np.zeros((len(x[rows]), len(y)), np.int32)
                for p, q in zip(xs, ys, strict=True):
                    flips += np.bitwise_count(p[rows, None] ^ q[None, :])
                near = (lx[rows, None] != ly[None, :]) & (flips <= flip_limits(xn[rows, None], yn[None, :], percent))
                i, j = np.nonzero(near)
                d, i = flips[i, j] / (xn[rows][i] + yn[j]), i + at
                keep = (d > md[i]) | ((d == md[i]) & (y[j] > my[i]))
                for p, q in zip(xb[:own], yb[:own], strict=True):
                    keep &= p[i] != q[j]
                i, j, d = i[keep], j[keep], d[keep]
                order = np.lexsort((y[j], d, i))
                i, j, d = i[order], j[order], d[order]
                keep = np.arange(len(i)) - np.searchsorted(i, i) < partners
                parts.append((x[i[keep]], y[j[keep]], lx[i[keep]], ly[j[keep]], d[keep]))
        columns = [np.concatenate(c) for c in zip(*parts, strict=True)] or [[]] * len(schema)
        return pa.table([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    return run


def _partners(hot: DataFrame, traits: DataFrame, labels: DataFrame, live: DataFrame, percent: int, partners: int) -> DataFrame:
    """(x, y, lx, ly, d, __r): the `partners` closest candidates of each live text, in one order by distance and node.

    hot is (band, node, blocks, outside); texts outside a bucket's largest component are compared with the whole bucket.
    live is (node, mark, mark_y), the mark being the last candidate tested. What comes before it was tested or joined
    already, and components only grow, so a text is done once it has fewer candidates than a round takes.
    """
    own = hot.join(traits, "node").join(labels, "node").join(live, "node", "left")
    own = own.withColumn("__s", F.explode(F.sequence(F.lit(0), 2 * F.col("blocks") - 1))).withColumn("left", F.col("__s") >= F.col("blocks"))
    mine, other = F.pmod("node", "blocks"), F.col("__s") % F.col("blocks")
    own = own.where(~F.col("left") | (F.col("outside") & F.col("mark").isNotNull()))
    own = own.withColumn("i", F.when(F.col("left"), mine).otherwise(other)).withColumn("j", F.when(F.col("left"), other).otherwise(mine))
    own = own.select("band", "i", "j", "left", "node", "label", "n", "bands", "sketch", "mark", "mark_y")
    run = closest(percent, partners)
    found = lean_group(lambda rows: run(rows.filter(rows["left"]), rows.filter(pa.compute.invert(rows["left"]))))
    pairs = own.groupBy("band", "i", "j").applyInArrow(found, "x long, y long, lx long, ly long, d double")
    return pairs.withColumn("__r", F.row_number().over(Window.partitionBy("x").orderBy("d", "y"))).where(F.col("__r") <= partners)


def _ordered(pairs: DataFrame) -> DataFrame:
    """(a, b, lx, ly): each pair of texts once, with the labels in order."""
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), F.least("lx", "ly").alias("lx"), F.greatest("lx", "ly").alias("ly")).distinct()


def _components(docs: DataFrame, id_col: str, text_col: str, words: int, percent: int) -> DataFrame:
    """(id, hash, n_shingles, component, kept) of every row. Nodes are texts, named by a hash of their key."""
    signed = checkpointed(signatures(docs, id_col, text_col, words))
    texts = signed.where("key is not null").groupBy("key").agg(F.min("id").alias("rep"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    texts = checkpointed(texts.withColumn("node", F.xxhash64("key")))
    slots = texts.select("node", F.explode("bands").alias("band"))
    shared = slots.groupBy("band").agg(F.count("*").alias("n"), F.min("node").alias("pivot")).where("n > 1").select("band", "pivot")
    members = checkpointed(slots.join(shared, "band"))
    lanes = [F.col("sketch")[i].alias(f"s{i}") for i in range(LANES)]
    sketches = checkpointed(texts.join(members.select("node").distinct(), "node", "left_semi").select("node", "rep", "n", *lanes))
    reps = sketches.select("node", "rep")

    def side(name: str, prefix: str) -> DataFrame:
        return sketches.select(F.col("node").alias(name), F.col("n").alias(f"{prefix}n"), *[F.col(f"s{i}").alias(f"{prefix}{i}") for i in range(LANES)])

    def flips(p: str, q: str) -> Column:
        first, *rest = (F.bit_count(F.col(f"{p}{i}").bitwiseXOR(F.col(f"{q}{i}"))) for i in range(LANES))
        return sum(rest, first)

    near = flips("p", "q") <= most_flips(F.col("pn"), F.col("qn"), percent)
    apart = flips("p", "q") / (F.col("pn") + F.col("qn"))

    # First every text against the closest pivot of its buckets.
    stars = members.where("node <> pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct()
    stars = stars.join(side("a", "p"), "a").join(side("b", "q"), "b").where(near).select("a", "b", apart.alias("d"))
    pairs = checkpointed(stars.groupBy("b").agg(F.min(F.struct("d", "a")).alias("best")).select(F.col("best.a").alias("a"), "b"))
    labels = sketches.select("node", F.col("node").alias("label"))

    def merge(labels: DataFrame, pairs: DataFrame) -> DataFrame:
        """Labels after the links among the pairs, which come with the labels of their ends as lx and ly."""
        result = checkpointed(_confirmed(pairs, reps, docs, id_col, text_col, words, percent))
        moved = merged_labels(result.where("linked").select(F.col("lx").alias("u"), F.col("ly").alias("v")))
        return checkpointed(labels.join(moved, "label", "left").select("node", F.coalesce("root", "label").alias("label")))

    labels = merge(labels, pairs.select("a", "b", F.col("a").alias("lx"), F.col("b").alias("ly")))
    # Buckets that still hold several components: texts of all but the largest one against the whole bucket.
    placed = members.select("band", "node").join(labels, "node")
    sizes = placed.groupBy("band", "label").agg(F.count("*").alias("n"))
    several = sizes.groupBy("band").agg(F.max(F.struct("n", "label")).alias("top"), F.sum("n").alias("c"), F.count("*").alias("k")).where("k > 1")
    placed = checkpointed(placed.join(several.select("band", F.col("top.label").alias("main"), "c"), "band"))
    small, hot = placed.where(F.col("c") <= HOT), placed.where(F.col("c") > HOT)
    left = small.where("label <> main").select("band", F.col("node").alias("x"), F.col("label").alias("lx")).join(side("x", "p"), "x")
    right = small.select("band", F.col("node").alias("y"), F.col("label").alias("ly")).join(side("y", "q"), "y")
    close = left.join(right, "band").where((F.col("lx") != F.col("ly")) & near)
    close = close.groupBy("x", "y", "lx", "ly").agg(F.min(apart).alias("d"))
    hot = hot.select("band", "node", F.ceil(F.col("c") / BLOCK).alias("blocks"), (F.col("label") != F.col("main")).alias("outside"))
    traits = checkpointed(texts.join(hot.select("node").distinct(), "node", "left_semi").select("node", "n", "bands", "sketch"))
    live = hot.where("outside").select("node", F.lit(-1.0).alias("mark"), F.lit(0).cast("long").alias("mark_y")).distinct()
    nodes, partners = traits.count(), 1
    while True:
        order = Window.partitionBy("x", "ly").orderBy("d", "y")
        close = checkpointed(close.withColumn("__r", F.row_number().over(order)))
        waiting = live.count() if nodes else 0
        if not waiting and not close.head(1):
            break
        chosen = close.where(F.col("__r") <= partners).select("x", "y", "lx", "ly")
        if waiting:
            few = max(1, min(partners, PARTNERS * nodes // waiting, MOST_PARTNERS))
            pairs = checkpointed(_partners(hot, traits, labels, live, percent, few))
            chosen = chosen.union(pairs.select("x", "y", "lx", "ly"))
            live = pairs.where(F.col("__r") == few).select(F.col("x").alias("node"), F.col("d").alias("mark"), F.col("y").alias("mark_y"))
        labels = merge(labels, checkpointed(_ordered(chosen)))
        for end, name in (("x", "lx"), ("y", "ly")):
            close = close.drop(name).join(labels.toDF(end, name), end)
        close = close.where((F.col("__r") > partners) & (F.col("lx") != F.col("ly"))).drop("__r")
        partners *= 16
    low = labels.join(reps, "node").groupBy("label").agg(F.min("rep").alias("low"))
    keyed = texts.select("key", "node", "rep").join(labels.join(low, "label").select("node", "low"), "node", "left")
    keyed = keyed.select("key", F.coalesce("low", "rep").alias("component"))
    own = F.coalesce("component", "id")
    return signed.join(keyed, "key", "left").select("id", "hash", "n_shingles", own.alias("component"), F.coalesce(F.col("id") == own, own.isNull()).alias("kept"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = 75) -> DataFrame:
    """(id_col, n_shingles, component_id, kept) for every row: the transitive closure of links of `percent` or more."""
    found = _components(docs, id_col, text_col, words, percent)
    return found.select(F.col("id").alias(id_col), "n_shingles", F.col("component").alias("component_id"), "kept")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = 75) -> DataFrame:
    """docs without the rows whose id is not their component's; rows without id stay, all columns are as they were."""
    found = _components(docs, id_col, text_col, words, percent)
    copies = found.where(F.col("id").isNotNull() & ~F.col("kept")).select(F.col("id").alias("__copy_id"), F.col("hash").alias("__copy_hash"))
    copies = checkpointed(copies.distinct())
    same = docs[id_col].eqNullSafe(F.col("__copy_id")) & (F.xxhash64(docs[text_col]) == F.col("__copy_hash"))
    return docs.join(if_small(copies, copies.count(), SMALL_IDS), same, "left_anti")
