"""Quality classifier: hashed word n-gram logistic regression, trained by follow-the-regularised-leader (FTRL-proximal) updates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainloom.llm.common import blocks, give_back, hash_words, mix, small_batches, tidy

#: At most so many labelled rows are trained on, chosen by a hash of their id: a bound on the one task that trains.
SAMPLE = 20_000
BITS = 18
EPOCHS = 3

_class = np.full(256, ord("l"), np.uint8)
_class[:128] = np.arange(128)
_class[ord("a") : ord("z") + 1] = ord("l")
_class[ord("A") : ord("Z") + 1] = ord("u")
_class[ord("0") : ord("9") + 1] = ord("d")
_shape = np.random.default_rng(11).integers(1, 2**63, 256, dtype=np.uint64)[_class]


def features(data: np.ndarray, offsets: np.ndarray):
    """(feature, row) of a block's word n-grams: each word and pair of words, each word's shape (its runs of lower, upper, digit and every sign) and pair of shapes. A pair of
    equal words is one n-gram whatever the word."""
    words, _, _, first, shapes = hash_words(data, offsets, _shape)
    row = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(first))
    pair = row[1:] == row[:-1]
    a, b = words[:-1][pair], words[1:][pair]
    pairs = np.where(a == b, np.uint64(99), mix(a * np.uint64(3) + b))
    s = mix(shapes[:-1][pair] * np.uint64(5) + shapes[1:][pair])
    shift = np.uint64(64 - BITS)
    return np.concatenate([(x >> shift).astype(np.int32) for x in (words, mix(pairs), shapes, s)]), np.concatenate([row, row[1:][pair], row, row[1:][pair]])


def train(examples, bits: int = BITS, epochs: int = EPOCHS, alpha: float = 0.5, beta: float = 1.0, l1: float = 1e-3, l2: float = 1e-3) -> tuple[np.ndarray, float]:
    """Weights and bias from [(features, shares, label)], or a function that gives them anew for each epoch, one FTRL-proximal update per example. The bias is a coordinate without
    penalty."""
    z, n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)
    bias = 1 << bits
    for _ in range(epochs):
        for f, x, y in examples() if callable(examples) else examples:
            f, x = np.append(f, bias), np.append(x, 1.0)
            zi, ni = z[f], n[f]
            w = np.where(np.abs(zi) > l1, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2), 0.0)
            w[-1] = -zi[-1] / ((beta + np.sqrt(ni[-1])) / alpha)
            g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - y) * x
            z[f] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha * w
            n[f] = ni + g * g
    w = np.where(np.abs(z) > l1, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2), 0.0)
    return w[:-1], float(-z[-1] / ((beta + np.sqrt(n[-1])) / alpha))


#: Shares of a document's n-grams are small; as much larger they learn at a good rate.
SCALE = 30.0


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE) -> tuple[np.ndarray, float]:
    """Weights and bias learnt from at most `sample` labelled documents.

    The texts are hashed where they lie, each task sending its share of the sample's hashed n-grams to one task that trains on them in an order by hash; only the weights (2**18
    of them) come to the driver.

    Cases: label rows without id or label, or whose document is missing, teach nothing; without any, all scores are 0.5. Null or empty texts teach the bias. Repeated rows, and
    several labels or texts of an id, teach once each. Ties in the order are broken by label and n-grams. Texts of any length are hashed whole. Other columns are ignored."""
    small_batches(docs.sparkSession)
    chosen = labels.select(F.col(doc_id).alias("_id"), F.col(label).cast("int").alias("_y")).where("_id IS NOT NULL AND _y IS NOT NULL")
    chosen = chosen.withColumn("_o", F.xxhash64("_id", F.lit(5))).orderBy("_o", "_id", "_y").limit(sample)
    rows = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_t")).join(F.broadcast(chosen), "_id")  # `sample` rows at most

    small = lambda n: n.astype("u1" if not len(n) or n.max() < 256 else "<i4")

    def hashed(batches):
        for batch in batches:
            ids, y, o = (batch.column(k) for k in ("_o", "_y", "_o"))
            for i, n, data, offsets in blocks(batch.column("_t")):
                f, row = features(data, offsets)
                order = np.argsort(row, kind="stable")
                f, ends = f[order], np.searchsorted(row[order], np.arange(n + 1))
                got = [np.unique(f[ends[r] : ends[r + 1]], return_counts=True) for r in range(n)]
                yield pa.RecordBatch.from_arrays([o.slice(i, n), y.slice(i, n), pa.array([g[0].astype("<i4").tobytes() for g in got], pa.binary()), pa.array([small(g[1]).tobytes() for g in got], pa.binary())], names=["o", "y", "f", "c"])

    def learn(batches):
        rows = sorted(r for b in batches for r in zip(*(b.column(k).to_pylist() for k in ("o", "y", "f", "c"))))

        def examples():  # unpacked one by one: the sample is held as packed bytes
            for _, y, f, c in rows:
                count = np.frombuffer(c, "u1" if len(c) * 4 == len(f) else "<i4")
                yield np.frombuffer(f, "<i4"), SCALE * count / max(1, count.sum(dtype=np.int64)), y

        w, b = train(examples)
        yield pa.RecordBatch.from_arrays([pa.array([w.astype("<f8").tobytes()], pa.binary()), pa.array([b])], names=["w", "b"])

    model = rows.mapInArrow(tidy(hashed), "o long, y int, f binary, c binary").repartition(1).mapInArrow(tidy(learn), "w binary, b double").collect()
    return (np.frombuffer(model[0]["w"], "<f8"), model[0]["b"]) if model else (np.zeros(1 << BITS), 0.0)


def score(docs: DataFrame, model: tuple[np.ndarray, float], text: str = "text") -> DataFrame:
    """`docs` with all their columns and _score (0 to 1): the sparse dot product of a text's n-gram shares with the weights, through the logistic function. Only texts go to
    Python, and only scores come back.

    Cases: an older column _score is replaced. Null or empty text: the bias alone. Texts of any length are scored whole. Repeated rows: scored alike. Empty table: no rows."""
    small_batches(docs.sparkSession)
    docs = docs.drop("_score")
    weights = docs.sparkSession.sparkContext.broadcast((model[0].astype(np.float32), model[1]))  # 2**18 floats, whatever the input

    def scored(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        w, b = weights.value
        for column in columns:
            out = np.empty(len(column))
            for i, n, data, offsets in blocks(column):
                f, row = features(data, offsets)
                out[i : i + n] = SCALE * np.bincount(row, w[f], minlength=n) / np.maximum(np.bincount(row, minlength=n), 1) + b
            yield pa.array(1 / (1 + np.exp(-np.clip(out, -35, 35))))
        give_back()

    return docs.withColumn("_score", F.arrow_udf(scored, "double")(F.col(text).cast("string")))


def held_out(doc_id):
    """Column: rows that never teach."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))
