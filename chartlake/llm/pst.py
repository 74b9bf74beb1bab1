"""LM scoring by a probabilistic suffix tree.

A text is a sequence of words, then one end; the symbols are the training words, the end and one unknown word. The
tree's states are contexts of up to DEPTH preceding words that (1) occur together with a next symbol at least MIN_COUNT
times in the training texts, however large they are, and (2) pass a divergence test: the Kullback-Leibler divergence of
their next-symbol distribution from that of the longest retained suffix, times their count, is at least GAIN nats.
Distributions are smoothed: what absolute discounting takes from the counts of a state goes to its suffix state's
distribution, at the root to the unknown word. Each token is scored in the state of the longest suffix of its context.

Corpus statistics cover all training texts and grow with them; none comes to the driver and none is broadcast. Texts are
read once: they become chunks of bounded size with their own vocabulary. Level by level, as every part of a repeated
sequence is repeated, each chunk asks for the counts of its distinct sequences, then for the states among its distinct
contexts; questions are 64-bit keys, dealt in buckets of the key's range, and answers go back to the chunk. So a frequent
word or sequence costs one key per chunk. Two words or two sequences of one key would be taken for one (2^-64 a pair).

Null and empty texts have the end as their only token. Null ids are training rows. Repeated rows each get a row.
Without training texts every token is unknown, which is then certain. Empty tables give empty results; other columns
are ignored.
"""

from __future__ import annotations

import contextlib
import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACE, checkpointed, keys64, lean, lean_cogroup, lean_group, mix64, word_hashes

DEPTH, MIN_COUNT, GAIN, DISCOUNT = 3, 2, 12.0, 0.5
#: No share of the training tokens is asked of a sequence, as that would ask for more in larger corpora.
MIN_PROB = 0.0
#: A bucket of keys is answered in one task; there are as many as chunks, but not fewer than this.
BUCKETS = 64
CHUNK_BYTES = 16_000_000
BYTES_AT_ONCE = 2_000_000
END = b"\n"  # cannot be part of a word
END_KEY = keys64(1, 43)[0]


def _pack(data) -> bytes:
    raw = bytes(data)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unpack(data: bytes) -> bytes:
    return pa.decompress(data[8:], decompressed_size=int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)


class _Words:
    """A chunk's texts as they come: their words' bytes one after another, lengths and numbers of words."""

    def __init__(self):
        self.ids, self.held, self.texts, self.size, self.waiting = [], [], [], 0, 0
        self.letters, self.lengths, self.per_text = [], [], []

    def add(self, id_, held: bool, raw: bytes | None) -> None:
        raw = raw or b""
        self.ids.append(id_), self.held.append(held), self.texts.append(raw)
        self.size += len(raw) + 64
        self.waiting += len(raw)
        if self.waiting >= BYTES_AT_ONCE:
            self._split()

    def _split(self) -> None:
        data = np.frombuffer(b"\n".join([x.lower() for x in self.texts]) + b"\n", np.uint8)
        word = ~SPACE[data]
        edges = np.flatnonzero(np.diff(word, prepend=False))  # the last byte is a space
        starts = edges[::2]
        ends = np.cumsum([len(x) + 1 for x in self.texts])
        self.letters.append(data[word]), self.lengths.append(edges[1::2] - starts)
        self.per_text.append(np.diff(np.searchsorted(starts, ends), prepend=0))
        self.texts, self.waiting = [], 0

    def row(self) -> list:
        """ids, held, body, names, train of to_chunks."""
        self._split()
        offsets = np.concatenate([np.zeros(1, np.int64), *self.lengths]).cumsum()
        coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.concatenate(self.letters))]).dictionary_encode()
        sizes = np.concatenate(self.per_text).astype(np.int32) + np.int32(1)
        keys = np.append(word_hashes(END.join(coded.dictionary.to_pylist())), END_KEY)
        order = np.argsort(keys, kind="stable")
        place = np.empty(len(order), np.int32)
        place[order] = np.arange(len(order), dtype=np.int32)
        tokens, inner = np.full(int(sizes.sum()), place[-1]), np.ones(int(sizes.sum()), bool)
        inner[np.cumsum(sizes) - 1] = False
        tokens[inner] = place[coded.indices.to_numpy()]
        train = np.bincount(tokens[np.repeat(~np.array(self.held, bool), sizes)], minlength=len(keys))
        body = np.concatenate([sizes, tokens]).view(np.uint8).reshape(-1, 4).T.tobytes()  # byte by byte
        return [self.ids, self.held, _pack(body), _pack_keys(keys[order]), _pack_counts(train)]


def to_chunks(docs: DataFrame, id_col: str, text_col: str, held_out: Column, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """One row per chunk: ids, held-out marks, packed token sequences, the vocabulary's keys and training counts.

    The vocabulary, with the end, is in the order of its keys.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(held_out, F.lit(False)).alias("held"), F.col(text_col).cast("binary").alias("raw"))
    id_type = rows.schema["id"].dataType
    schema = T.StructType([T.StructField("chunk", T.LongType()), T.StructField("ids", T.ArrayType(id_type)), T.StructField("held", T.ArrayType(T.BooleanType())), T.StructField("body", T.BinaryType()), T.StructField("names", T.BinaryType()), T.StructField("train", T.BinaryType())])

    def run(batches):
        part, number, chunk = TaskContext.get().partitionId(), 0, _Words()
        names = [f.name for f in schema]
        for batch in batches:
            kind = batch.schema.field(0).type
            kinds = [pa.int64(), pa.list_(kind), pa.list_(pa.bool_()), *[pa.binary()] * 3]
            for i in range(batch.num_rows):
                chunk.add(*(c[i].as_py() for c in batch.columns))
                if chunk.size >= chunk_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip([(part << 24) + number, *chunk.row()], kinds, strict=True)], names)
                    number, chunk = number + 1, _Words()
        if chunk.ids:
            yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip([(part << 24) + number, *chunk.row()], kinds, strict=True)], names)

    return rows.mapInArrow(lean(run), schema)


def _planes(values: np.ndarray) -> bytes:
    """The lowest bytes of all numbers, then the next ones, eight for each number."""
    used = (int(values.max()).bit_length() + 7) // 8 if len(values) else 0
    return b"".join([(values >> np.uint64(8 * k)).astype(np.uint8).tobytes() for k in range(used)]) + bytes((8 - used) * len(values))


def _from_planes(data: bytes) -> np.ndarray:
    parts = np.frombuffer(data, np.uint8).reshape(8, -1)
    out = parts[0].astype(np.uint64)
    for k in range(1, 8):
        if parts[k].any():
            out |= parts[k].astype(np.uint64) << np.uint64(8 * k)
    return out


def _pack_keys(keys: np.ndarray) -> bytes:
    """Sorted keys as differences, byte by byte, as their high bytes are mostly 0."""
    return _pack(_planes(np.diff(keys, prepend=np.uint64(0))))


def _unpack_keys(data: bytes) -> np.ndarray:
    return np.cumsum(_from_planes(_unpack(data)), dtype=np.uint64)


def _pack_counts(values: np.ndarray) -> bytes:
    """Mostly small whole numbers, with a sign, byte by byte."""
    folded = (np.abs(values) * 2 + (values < 0)).astype(np.uint64)
    return _pack(_planes(folded))


def _unpack_counts(data: bytes) -> np.ndarray:
    folded = _from_planes(_unpack(data))
    sign = (folded & np.uint64(1)).view(np.int64)
    return ((folded >> np.uint64(1)).view(np.int64) ^ -sign) + sign


def _packed(values: np.ndarray) -> bytes:
    return _pack(np.ascontiguousarray(values).tobytes())


def _array(data: bytes, kind) -> np.ndarray:
    return np.frombuffer(_unpack(data), kind)


def _key_order(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stable order of the keys, and the keys in it.

    Sorting the high bits with the place below them is quicker than sorting places. Where keys differ in lower bits alone
    and come out in the wrong order, those of the same high bits are sorted once more.
    """
    bits = np.uint64(len(keys).bit_length())
    low = (np.uint64(1) << bits) - np.uint64(1)
    order = keys & ~low
    order |= np.arange(len(keys), dtype=np.uint64)
    order.sort()
    order &= low
    order = order.view(np.int64)
    ordered = keys.take(order)
    wrong = np.flatnonzero(ordered[1:] < ordered[:-1])
    if len(wrong):
        high = ordered & ~low
        mixed = np.unique(high[wrong])
        for lo, hi in zip(np.searchsorted(high, mixed), np.searchsorted(high, mixed, "right"), strict=True):
            own = np.argsort(ordered[lo:hi], kind="stable")
            order[lo:hi], ordered[lo:hi] = order[lo:hi][own], ordered[lo:hi][own]
    return order, ordered


class Level:
    """The distinct sequences of depth + 1 repeated words in a chunk, by the spots at which they end."""

    def __init__(self, spots: np.ndarray, keys: np.ndarray):
        order, ordered = _key_order(keys)
        new = np.ones(len(keys), bool)
        new[1:] = ordered[1:] != ordered[:-1]
        self.spots, self.keys = spots, ordered[new]
        self.place = np.empty(len(keys), np.int32)  # among the sorted keys
        self.place[order] = np.cumsum(new, dtype=np.int32) - np.int32(1)


class ChunkText:
    """The tokens of a chunk with what was answered so far.

    at[d] has, by token, the place of the sequence of depth d that ends there, or -1 if it is not repeated; counts[d] the
    counts by place. Places are in the order of the keys.
    """

    def __init__(self, row: dict, counts: np.ndarray, cut: float, total: int, unknown: float):
        planes = np.frombuffer(_unpack(row["body"]), np.uint8).reshape(4, -1)
        lists = planes[0].astype(np.int32)
        for k in range(1, 4):
            lists |= planes[k].astype(np.int32) << np.int32(8 * k)
        n_docs = len(row["held"])
        self.sizes = lists[:n_docs].astype(np.int64)
        self.places = lists[n_docs:]
        self.doc = np.repeat(np.arange(n_docs, dtype=np.int32), self.sizes)
        self.inside = np.arange(len(self.places), dtype=np.int32) - np.repeat((np.cumsum(self.sizes) - self.sizes).astype(np.int32), self.sizes)
        self.train = ~np.array(row["held"], bool)[self.doc]
        self.names = _unpack_keys(row["names"])
        self.followed: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.counts, self.keys = [counts], [self.names]
        self.at = [np.where(counts[self.places] >= MIN_COUNT, self.places, np.int32(-1))]
        self.ends = self.names[self.places]  # key of the sequence of the current depth that ends at a token
        self.probs = np.where(counts > 0, (counts - cut) / max(total, 1), unknown)[self.places]

    def next_level(self) -> Level:
        """The sequences one deeper whose two parts are repeated."""
        depth, repeated = len(self.at), self.at[-1] >= 0
        here = np.zeros(len(repeated), bool)
        here[depth:] = repeated[depth:] & repeated[depth - 1 : -1] & (self.inside[depth:] >= depth)
        spots = np.flatnonzero(here)
        first = mix64(self.names * keys64(DEPTH + 2, 41)[depth])  # by word, as there are fewer words than spots
        keys = mix64(self.ends[here] + first.take(self.places.take(spots - depth)))
        self.ends = np.zeros(len(self.ends), np.uint64)
        self.ends[spots] = keys
        return Level(spots, keys)

    def counted(self, level: Level, counts: np.ndarray) -> None:
        at = np.full(len(self.places), -1, np.int32)
        here = (counts >= MIN_COUNT).take(level.place)
        at[level.spots[here]] = level.place[here]
        self.at.append(at), self.counts.append(counts), self.keys.append(level.keys)

    def contexts(self, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """The spots that follow a repeated context of `depth` words, and its place at depth - 1."""
        if depth not in self.followed:
            context = np.append(np.int32(-1), self.at[depth - 1][:-1])
            context[self.inside < depth] = -1
            spots = np.flatnonzero(context >= 0).astype(np.int32)
            self.followed[depth] = spots, context[spots]
        return self.followed[depth]

    def stated(self, depth: int, left: np.ndarray) -> None:
        """Probabilities in the states of a depth; left has the mass by context, or NaN if it is no state."""
        spots, context = self.contexts(depth)
        state = (~np.isnan(left)).take(context)
        spots, context = spots[state], context[state]
        probs, place = self.probs.take(spots) * left.take(context), self.at[depth].take(spots)
        here = place >= 0
        context, place = context[here], place[here]
        probs[here] += (self.counts[depth].take(place) - DISCOUNT) / self.counts[depth - 1].take(context)
        self.probs[spots] = probs


def _in_buckets(keys: np.ndarray, n_buckets: int):
    """(bucket, slice) of sorted keys by equal parts of their range."""
    width = np.uint64(2**64 // n_buckets)
    inner = np.arange(1, n_buckets, dtype=np.uint64) * width
    ends = [0, *np.searchsorted(keys, inner).tolist(), len(keys)]
    return [(b, slice(lo, hi)) for b, (lo, hi) in enumerate(zip(ends, ends[1:], strict=False)) if hi > lo]


ASKED = "kind string, depth int, bucket int, chunk long, keys binary, numbers binary"
TOTALS = ("n", "v", "n1", "n2")
ANSWERED = f"kind string, depth int, bucket int, chunk long, data binary, {', '.join(f'{x} long' for x in TOTALS)}"
#: Contexts are asked for by their keys without so many low bits; the answer has the whole keys of the states.
HIGH, LOW = np.uint64(24), np.uint64((1 << 24) - 1)


def _asked_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=[x.split()[0] for x in ASKED.split(", ")])


def _words_asked(chunks: DataFrame, n_buckets: int) -> DataFrame:
    """The question for the counts of each chunk's words, as for sequences of depth 0."""

    def ask(batches):
        for batch in batches:
            for row in batch.to_pylist():
                counts, keys = _unpack_counts(row["train"]), _unpack_keys(row["names"])
                yield _asked_batch([("count", 0, b, row["chunk"], _pack_keys(keys[part]), _pack_counts(counts[part])) for b, part in _in_buckets(keys, n_buckets)])

    return chunks.select("chunk", "names", "train").mapInArrow(lean(ask), ASKED)


def _count_answers(keys: np.ndarray, n: np.ndarray, least: int) -> tuple[np.ndarray, list[int]]:
    """By asked key the count in all chunks (0: below least), negative for one of the chunks that ask, and totals:
    sum, kinds, and kinds that occur once and twice."""
    order, ordered = _key_order(keys)
    first = np.flatnonzero(np.diff(ordered, prepend=~ordered[:1]) != 0)
    sums = np.add.reduceat(n[order], first)
    sums[sums < least] = 0
    out = np.empty(len(keys), np.int64)
    signed = np.repeat(sums, np.diff(first, append=len(keys)))
    signed[first] *= -1
    out[order] = signed
    return out, [int(x) for x in (sums.sum(), (sums > 0).sum(), (sums == 1).sum(), (sums == 2).sum())]


def _state_answers(asked: list[np.ndarray], given: list[np.ndarray], gain: float) -> list[np.ndarray]:
    """For each chunk the states that it may ask for: place among its contexts, low bits of the key, and number and kinds
    of the repeated sequences that the state begins.

    asked has the sorted high bits of each chunk's contexts; given the place of the first of them among all that the
    chunk asks for, then what it adds to some contexts: key, count, and sums over the sequences that they begin and that
    the chunk speaks for: n log(n / below), n, below and 1.
    """
    parts = np.concatenate([x[1:].reshape(6, -1) for x in given], axis=1)
    keys, added = parts[0], parts[1:].view(float)
    order = np.argsort(keys, kind="stable")
    first = np.flatnonzero(np.diff(keys[order], prepend=~keys[order][:1]) != 0)
    if not len(first):
        return [np.zeros(0, np.int64)] * len(asked)
    total = added[0][order][first]
    logs, n, below, kinds = (np.add.reduceat(x[order], first) for x in added[1:])
    rest, rest_below = np.maximum(0.0, 1 - n / total), np.maximum(1e-12, 1 - below)
    with np.errstate(divide="ignore", invalid="ignore"):
        divergence = logs - n * np.log(total) + np.where(rest > 0, total * rest * np.log(rest / rest_below), 0.0)
    state = divergence >= gain
    names, n, kinds = keys[order][first][state], n[state].astype(np.int64), kinds[state].astype(np.int64)
    high, low = names >> HIGH, (names & LOW).astype(np.int64)
    out = []
    for own, x in zip(asked, given, strict=True):
        at = np.searchsorted(own, high)
        here = np.append(own, ~own[-1:])[at] == high
        places = np.diff(at[here] + int(x[0]), prepend=0)
        out.append(np.concatenate([places, low[here], n[here], kinds[here]]))
    return out


def _answer(asked: DataFrame, gain: float) -> DataFrame:
    """The answers; n, v, n1 and n2 of a bucket's first row are the totals of its words or sequences."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("chunk")
        keys = [_unpack_keys(x) for x in table.column("keys").to_pylist()]
        numbers, totals = table.column("numbers").to_pylist(), [0] * 4
        if table.column("kind")[0].as_py() == "count":
            least = MIN_COUNT if table.column("depth")[0].as_py() else 1
            counts, totals = _count_answers(np.concatenate(keys), np.concatenate([_unpack_counts(x) for x in numbers]), least)
            data = [_pack_counts(x) for x in np.split(counts, np.cumsum([len(k) for k in keys])[:-1])]
        else:
            data = [_pack_counts(x) for x in _state_answers(keys, [_array(x, np.uint64) for x in numbers], gain)]
        table = table.select(["kind", "depth", "bucket", "chunk"]).append_column("data", pa.array(data, pa.binary()))
        for name, x in zip(TOTALS, totals, strict=True):
            table = table.append_column(name, pa.array([x, *[0] * (len(data) - 1)], pa.int64()))
        return table

    return checkpointed(asked.groupBy("kind", "depth", "bucket").applyInArrow(lean_group(run), ANSWERED))


@contextlib.contextmanager
def _shuffles_removed(spark):
    """Spark removes the shuffles of each step in here as soon as its checkpoint is written."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def _with_answers(chunk: pa.Table, answers: pa.Table) -> tuple[dict, dict]:
    """The packed chunk, and the answers by kind and depth in the order of the buckets."""
    row = {n: chunk.column(n)[0].as_py() for n in ("held", "body", "names")}
    parts: dict = {}
    for a in sorted(answers.select(["kind", "depth", "bucket", "data"]).to_pylist(), key=lambda a: (a["kind"], a["depth"], a["bucket"])):
        data = _unpack_counts(a["data"])
        if a["kind"] == "state":
            data = data.reshape(4, -1)
            data[0] = np.cumsum(data[0])
        parts.setdefault((a["kind"], a["depth"]), []).append(data)
    got = {k: np.concatenate(v, axis=-1) for k, v in parts.items()}
    return row, got


def _text(row: dict, got: dict, levels: int, states: int, cut: float, total: int, unknown: float) -> ChunkText:
    """The text with `levels` levels of counts and the probabilities of `states` levels of states."""
    text = ChunkText(row, np.abs(got["count", 0]), cut, total, unknown)
    for depth in range(1, levels + 1):
        level = text.next_level()
        text.counted(level, np.abs(got.get(("count", depth), np.zeros(0, np.int64))))
    for depth in range(1, states + 1):
        left = np.full(len(text.keys[depth - 1]), np.nan)
        places, low, n, kinds = got.get(("state", depth), np.zeros((4, 0), np.int64))
        asked = text.keys[depth - 1][_asked_contexts(text, depth)]
        names = asked[places] & ~LOW | low.astype(np.uint64)  # another context may have the same high bits
        place = np.searchsorted(text.keys[depth - 1], names)
        here = np.append(text.keys[depth - 1], np.uint64(0))[place] == names
        place = place[here]
        left[place] = 1 - (n[here] - DISCOUNT * kinds[here]) / text.counts[depth - 1][place]
        text.stated(depth, left)
    return text


def _asked_contexts(text: ChunkText, depth: int) -> np.ndarray:
    """Places of the contexts that a chunk asks for, by their keys."""
    asked = np.zeros(len(text.keys[depth - 1]), bool)
    asked[text.contexts(depth)[1]] = True
    return np.flatnonzero(asked)


def _questions(text: ChunkText, got: dict, depth: int, n_buckets: int):
    """(kind, depth, bucket, packed keys, packed numbers) that a chunk asks after `depth` levels of counts."""
    if depth:
        asked = _asked_contexts(text, depth)
        place = text.at[depth]
        spots = np.flatnonzero(place >= 0)
        mine = got.get(("count", depth), np.zeros(0, np.int64)) < 0
        one = np.full(len(mine), -1, np.int64)
        one[place[spots]] = spots  # some spot of each sequence
        one = one[mine]
        context = text.at[depth - 1][one - 1]
        order = np.argsort(context, kind="stable")
        one, context = one[order], context[order]
        n, below = text.counts[depth][place[one]].astype(float), text.probs[one]
        first = np.flatnonzero(np.diff(context, prepend=-1))
        sums = [np.add.reduceat(x, first) for x in (n * np.log(n / below), n, below, np.ones(len(one)))] if len(one) else [np.zeros(0)] * 4
        context = context[first]
        names, counts = text.keys[depth - 1][context], text.counts[depth - 1][context].astype(float)
        keys = text.keys[depth - 1][asked]
        for b, part in _in_buckets(keys, n_buckets):
            here = slice(*np.searchsorted(context, [asked[part.start], asked[part.stop - 1] + 1]))
            added = np.concatenate([np.array([part.start], np.uint64), names[here], *[x[here].view(np.uint64) for x in (counts, *sums)]])
            yield "state", depth, b, _pack_keys(keys[part] >> HIGH), _packed(added)
    if depth < DEPTH:
        level = text.next_level()
        numbers = np.bincount(level.place[text.train[level.spots]], minlength=len(level.keys))
        for b, part in _in_buckets(level.keys, n_buckets):
            yield "count", depth + 1, b, _pack_keys(level.keys[part]), _pack_counts(numbers[part])


class SuffixTree:
    """Per depth the retained contexts with the mass they leave to their suffix, and their next-symbol shares.

    counts: sequences of numbers of frequent words -> count; unigrams: number -> count; root: smoothed P(number).
    """

    def __init__(self, counts: dict[tuple, int], unigrams: dict[int, int], root: dict[int, float], gain: float = GAIN, discount: float = DISCOUNT):
        nexts: dict[tuple, dict[int, int]] = {}
        for sequence, n in counts.items():
            nexts.setdefault(sequence[:-1], {})[sequence[-1]] = n
        self.root, self.states = root, {}
        for context in sorted(nexts, key=lambda c: (len(c), c)):
            total = counts.get(context) or unigrams[context[0]]
            below = {x: self.prob(context[1:], x) for x in nexts[context]}
            rest, rest_below = max(0.0, 1 - sum(nexts[context].values()) / total), max(1e-12, 1 - sum(below.values()))
            divergence = sum(n / total * math.log(n / total / below[x]) for x, n in nexts[context].items()) + (rest * math.log(rest / rest_below) if rest > 0 else 0.0)
            if total * divergence >= gain:
                shares = {x: (n - discount) / total for x, n in nexts[context].items()}
                self.states[context] = (1 - sum(shares.values()), shares)

    def prob(self, context: tuple, symbol: int) -> float:
        """P(symbol) in the state of the longest suffix of the context."""
        while context and context not in self.states:
            context = context[1:]
        if not context:
            return self.root[symbol]
        left, shares = self.states[context]
        return shares.get(symbol, 0.0) + left * self.prob(context[1:], symbol)


def score_corpus(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES, gain: float = GAIN) -> DataFrame:
    """One row per text: id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10)."""
    spark = docs.sparkSession
    with _shuffles_removed(spark):
        chunks = checkpointed(to_chunks(docs, id_col, text_col, held_out, chunk_bytes))
        n_buckets = max(BUCKETS, chunks.count())
        answers = _answer(_words_asked(chunks, n_buckets), gain)
    got = answers.agg(*[F.sum(x).alias(x) for x in TOTALS]).first()
    total, kinds = got["n"] or 0, got["v"] or 0
    cut = ((got["n1"] or 0) + 1) / ((got["n1"] or 0) + 2 * (got["n2"] or 0) + 2)  # absolute discount at the root
    unknown = cut * kinds / total if total else 1.0
    norm = math.log10(total + kinds + 1)
    body = chunks.select("chunk", "ids", "held", "body", "names")

    def ask(depth: int):
        def run(answered: pa.Table, chunk: pa.Table) -> pa.Table:
            row, known = _with_answers(chunk, answered)
            text = _text(row, known, depth, max(0, depth - 1), cut, total, unknown)
            number = chunk.column("chunk")[0].as_py()
            rows = [(kind, d, b, number, keys, numbers) for kind, d, b, keys, numbers in _questions(text, known, depth, n_buckets)]
            return pa.Table.from_batches([_asked_batch(rows)])

        return run

    with _shuffles_removed(spark):
        for depth in range(DEPTH + 1):
            asked = answers.groupBy("chunk").cogroup(body.drop("ids").groupBy("chunk")).applyInArrow(lean_cogroup(ask(depth)), ASKED)
            answers = answers.unionByName(_answer(asked, gain))

    id_type = chunks.schema["ids"].dataType.elementType
    fields = (("held_out", T.BooleanType()), ("n_tokens", T.LongType()), ("n_known", T.LongType()), ("train_tokens", T.LongType()), ("base_score", T.DoubleType()), ("score", T.DoubleType()))
    schema = T.StructType([T.StructField("id", id_type), *[T.StructField(n, t) for n, t in fields]])

    def finish(answered: pa.Table, chunk: pa.Table) -> pa.Table:
        ids = chunk.column("ids").combine_chunks().flatten()
        held = chunk.column("held").combine_chunks().flatten()
        row, known = _with_answers(chunk, answered)
        text = _text(row, known, DEPTH, DEPTH, cut, total, unknown)
        n = text.counts[0]
        base = np.log10(n + 1.0) - norm
        sums = [np.bincount(text.doc, weights=x, minlength=len(ids)) for x in ((n > 0)[text.places], base[text.places], np.log10(text.probs))]
        columns = [ids, held, pa.array(text.sizes), pa.array(sums[0].astype(np.int64)), pa.array(np.full(len(ids), total, np.int64)), pa.array(sums[1]), pa.array(sums[2])]
        return pa.Table.from_arrays(columns, names=[f.name for f in schema])

    out = answers.groupBy("chunk").cogroup(body.groupBy("chunk")).applyInArrow(lean_cogroup(finish), schema)
    return out.withColumnRenamed("id", id_col)
