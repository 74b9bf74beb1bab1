"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Texts become code points with A-Z lower-cased and runs of ASCII punctuation and white space as one space; the features
are which 4- and 5-grams of them occur, hashed into 2**20 slots. On labelled training rows each feature gets its naive
Bayes log-count ratio (smoothed share among toxic rows over that among others); a logistic regression on the features
scaled by these ratios is fitted over all of them, with an L1 term that makes most weights 0 (follow-the-regularised-
leader, EPOCHS times over the rows). Scoring looks at whole texts of any length, one at a time.

Fitting takes at most MAX_TRAIN labelled rows, those with the smallest hash of their id; which labels count is the
caller's choice. The rows' features stay in a checkpoint; one task streams them for the ratios and one, EPOCHS times,
for the weights, and these two arrays by slot are all that reaches the driver. Null and empty texts get the score of a text without features.
Repeated labels of an id count as toxic if one does; null labels and labels without a document are ignored. With labels
of one kind only the score is their smoothed share, without any labels it is 1/3. An empty table gives an empty result;
other columns are kept as they are, but one with the score's name is replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import checkpointed, keys64, lean

SLOT_BITS, GRAMS, MAX_TRAIN = 20, (4, 5), 6000
#: L1 is per training row; RATE and the start of 1 in the square root set the steps by slot.
EPOCHS, L1, L2, RATE, BIAS_RATE = 8, 0.0125, 0.1, 0.3, 0.1

_FOLD = np.arange(128, dtype=np.uint64)
_FOLD[65:91] += np.uint64(32)
for _i in range(128):
    if not chr(_i).isalnum():
        _FOLD[_i] = 32


@dataclass
class Model:
    weights: np.ndarray  # by slot
    bias: float

    def score(self, raw: bytes | None) -> float:
        slots = gram_slots(raw)
        total = self.bias
        if len(slots):
            used = np.unique(slots[self.weights[slots] != 0])
            total += float(self.weights[used].sum(dtype=np.float64))
        return 1 / (1 + np.exp(-total)) if total > -700 else 0.0


def gram_slots(raw: bytes | None) -> np.ndarray:
    """The slot of every n-gram occurrence, a space standing before and after the text."""
    points = np.frombuffer(f" {raw.decode('utf-8', 'replace')} ".encode("utf-32-le"), np.uint32) if raw else np.empty(0, np.uint32)
    data = np.where(points < 128, _FOLD[points & 127], points)
    space = data == 32
    data = data[~(space & np.concatenate([[False], space[:-1]]))] if len(data) else data
    factors, out = keys64(max(GRAMS) + 1, 31), []
    total, shift = np.zeros(len(data), np.uint64), np.uint64(64 - SLOT_BITS)
    for j in range(max(GRAMS)):
        total = total[: max(0, len(data) - j)] + data[j:] * factors[j]
        if j + 1 in GRAMS:
            out.append((total + factors[j + 1]) >> shift)
    return np.concatenate(out).astype(np.int64)


def log_ratios(seen: np.ndarray) -> np.ndarray:
    """By slot the log of its smoothed share among toxic rows (seen[1]) over that among others (seen[0])."""
    smooth = seen + 1.0
    return np.log(smooth[1] / smooth[1].sum()) - np.log(smooth[0] / smooth[0].sum())


@dataclass
class Leader:
    """The state of follow-the-regularised-leader: sums of shifted gradients and of squared gradients by slot."""

    z: np.ndarray
    squares: np.ndarray
    bias: float
    bias_squares: float
    l1: float

    def weights(self, slots=slice(None)) -> np.ndarray:
        z = self.z[slots]
        return np.where(np.abs(z) > self.l1, (np.sign(z) * self.l1 - z) / ((1 + np.sqrt(self.squares[slots])) / RATE + L2), 0.0)

    def step(self, slots: np.ndarray, y: int, ratio: np.ndarray) -> None:
        x, w = ratio[slots], self.weights(slots)
        error = 1 / (1 + np.exp(-np.clip((w * x).sum() + self.bias, -30, 30))) - y
        g, old = error * x, self.squares[slots]
        new = old + g * g
        self.z[slots] += g - (np.sqrt(new) - np.sqrt(old)) / RATE * w
        self.squares[slots] = new
        self.bias_squares += error * error
        self.bias -= BIAS_RATE * error / np.sqrt(1 + self.bias_squares)


def _packed(slots: np.ndarray) -> bytes:
    """Distinct slots as compressed differences, byte by byte as the high ones are mostly 0, after their number."""
    gaps = np.diff(slots.astype(np.uint32), prepend=np.uint32(0)).view(np.uint8).reshape(-1, 4).T
    return len(slots).to_bytes(4, "little") + pa.compress(np.ascontiguousarray(gaps).tobytes(), codec="zstd", asbytes=True)


def _unpacked(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:4], "little")
    gaps = np.frombuffer(pa.decompress(data[4:], decompressed_size=4 * n, codec="zstd", asbytes=True), np.uint8).reshape(4, n)
    return np.cumsum(np.ascontiguousarray(gaps.T).view(np.uint32).ravel(), dtype=np.uint32)


def _made(rows: DataFrame, make) -> np.ndarray:
    """The array that make(rows) gives in a single task."""

    def run(batches):
        held = ((_unpacked(slots.as_py()), y.as_py()) for batch in batches for slots, y in zip(batch.column(0), batch.column(1), strict=True))
        yield pa.RecordBatch.from_arrays([pa.array([make(held).astype(np.float32).tobytes()], pa.binary())], ["made"])

    return np.frombuffer(rows.coalesce(1).mapInArrow(lean(run), "made binary").toArrow().column(0)[0].as_py(), np.float32)


def fit(rows: DataFrame, n_rows: int, n_toxic: int) -> Model:
    """rows: the distinct slots (packed) of a text and its label, in one partition and a fixed order."""
    size = 1 << SLOT_BITS
    if not 0 < n_toxic < n_rows:
        share = (n_toxic + 1) / (n_rows + 2) if n_rows else 1 / 3
        return Model(np.zeros(size, np.float32), float(np.log(share / (1 - share))))

    def count(held):
        seen = np.zeros((2, size))
        for slots, y in held:
            seen[y][slots] += 1
        return log_ratios(seen)

    ratio = _made(rows, count)
    sent = rows.sparkSession.sparkContext.broadcast(ratio)
    start, l1 = float(np.log(n_toxic / (n_rows - n_toxic))), L1 * n_rows

    def learn(held):
        state = Leader(np.zeros(size), np.zeros(size), start, 0.0, l1)
        for slots, y in held:
            state.step(slots, y, sent.value)
        return np.append(state.weights() * sent.value, state.bias)

    again = rows
    for _ in range(1, EPOCHS):
        again = again.unionAll(rows)
    learnt = _made(again, learn)
    sent.destroy()
    return Model(learnt[:-1], float(learnt[-1]))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_train: int = MAX_TRAIN) -> Model:
    """Fits on at most max_train of the given labelled ids."""
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("__id")).agg(F.max(F.col(label_col).cast("int")).alias("__y"))
    known = known.orderBy(F.xxhash64("__id"), "__id").limit(max_train)
    rows = docs.select(F.col(id_col).alias("__doc"), F.col(text_col).cast("binary").alias("__raw"))
    rows = rows.join(F.broadcast(known), F.col("__doc") == F.col("__id"))  # at most max_train rows
    rows = rows.select("__raw", "__y", F.xxhash64("__id", "__raw").alias("__order"))

    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                slots = _packed(np.unique(gram_slots(batch.column(0)[row].as_py())))
                y = int(batch.column(1)[row].as_py() > 0)
                yield pa.RecordBatch.from_arrays([pa.array([slots], pa.binary()), pa.array([y], pa.int32()), batch.column(2).slice(row, 1)], ["slots", "y", "order"])

    packed = rows.mapInArrow(lean(run), "slots binary, y int, order long")
    packed = checkpointed(packed.repartition(1).sortWithinPartitions("order", "y", "slots").select("slots", "y"))
    total = packed.agg(F.count("*").alias("n"), F.coalesce(F.sum("y"), F.lit(0)).alias("toxic")).first()
    return fit(packed, total["n"], total["toxic"])


def score_texts(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """docs with the score."""
    docs = docs.drop(score_col)
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            k = batch.schema.names.index("__raw")
            scores = pa.array([float(held.value.score(x.as_py())) for x in batch.column(k)], pa.float64())
            rest = [i for i in range(batch.num_columns) if i != k]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in rest], scores], [*[batch.schema.names[i] for i in rest], score_col])

    schema = T.StructType([T.StructField(f.name, f.dataType) for f in docs.schema] + [T.StructField(score_col, T.DoubleType())])
    return docs.withColumn("__raw", F.col(text_col).cast("binary")).mapInArrow(lean(run), schema)
