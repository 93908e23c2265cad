"""Language identification: averages of hashed subword embeddings and a linear softmax.

A text's UTF-8 bytes, with ASCII letters lower-cased and other ASCII as spaces, give subwords of 1 to 4
bytes that hold no space but at an end, where it marks the border of a word. Each is hashed to one of
2^BITS embeddings; a text is the average of its subwords' embeddings over its whole length, and a linear
layer with softmax turns that into probabilities. All weights are trained by stochastic gradient descent in
numpy on the driver, on at most PER_LANG texts of each language, the ones with the smallest hashes of id and
text, as long as their counted subwords take TRAIN_BYTES at most over all languages (one text of each at
least); these bounds are the only sample. The subwords are counted by the executors, so a long text is at most
2^BITS counts. A fifth of these texts is kept out of the training: on it a temperature is fitted, so that
scores are probabilities, and a threshold below which at most REJECTED of the rightly predicted texts fall,
and never above HALF. A text with a lower score is rejected.

The model is broadcast: 2^BITS embeddings of at most WIDTH numbers, and a column of WIDTH numbers a language.
With up to WIDTH languages both layers are multiplied beforehand. All languages are learned, in any number.

Only text is an input of a prediction. Learned are rows with text, lang and doc_id of which crc32(doc_id as
text) mod 5 isn't 0; rows that agree in lang, id and text are learned once. Null texts and texts without a
letter give `und`, score 0, and are rejected; so is everything if no row can be learned from. Of languages
with equal scores the first by name is predicted. Very long texts are read whole. Rows with a null doc_id are
predicted, and not held out. Rows stay as they are, in any number; a table without rows gives none. identify()
passes all columns, whatever their names, but those named like the three it adds, which it replaces.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, plain, quoted, small_batches, trimmed
from .token_counts import slices, texts_of
from .words import differences, pack, unpack

BITS, WIDTH, EPOCHS, RATE, PER_LANG, TRAIN_BYTES, REJECTED, HALF = 16, 16, 6, 8.0, 1200, 64 << 20, 0.0005, 0.5
#: Texts are read so many characters at a time.
SLICE = 1 << 18
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[:128] = 32
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_PRIMES = tuple(np.uint32(p) for p in (2654435761, 2246822519, 3266489917, 668265263))


def _buckets(texts: list[str]):
    """For each subword length: the bucket at each byte (2^BITS for none); and where each text starts."""
    raw = [t.encode() for t in texts]
    x = _FOLD[np.frombuffer(b" " + b" ".join(raw) + b" " * 5, np.uint8)]
    start = np.cumsum([0, *(len(r) + 1 for r in raw[:-1])]) if raw else np.zeros(0, np.int64)
    n = len(x) - 4
    four = np.lib.stride_tricks.as_strided(x, (n, 4), (1, 1))
    word = np.ascontiguousarray(four).view("<u4").ravel()
    gap = x == 32
    inner = np.zeros(n, bool)
    for k in range(1, 5):
        if k > 2:
            inner |= gap[k - 2 : k - 2 + n]
        gram = word & np.uint32((1 << (8 * k)) - 1)
        b = ((gram * _PRIMES[k - 1]) >> np.uint32(32 - BITS)).astype(np.int32)
        b[inner | (gap[:n] & gap[k - 1 : k - 1 + n])] = 1 << BITS
        yield b, start


Bag = tuple[np.ndarray, np.ndarray]  # buckets, and how often each is there


@dataclass
class Model:
    langs: list[str]
    table: np.ndarray  # a row for each bucket, and zeros for none
    bias: np.ndarray
    head: np.ndarray | None = None  # what a row is multiplied by; None if that was done beforehand
    temperature: float = 1.0
    threshold: float = HALF

    def logits(self, texts: list[str]) -> np.ndarray:
        if len(texts) == 1 and len(texts[0]) > SLICE:
            return self.of_bags([bag(texts[0])])
        total, count = np.zeros((len(texts), self.table.shape[1])), np.zeros(len(texts))
        for b, start in _buckets(texts):
            total += np.add.reduceat(self.table[b], start, axis=0)
            count += np.add.reduceat(b < 1 << BITS, start)
        return self._of(total / np.maximum(count, 1)[:, None])

    def of_bags(self, bags: list[Bag]) -> np.ndarray:
        mean = [(c / max(1, c.sum())) @ self.table[b] for b, c in bags]
        return self._of(np.array(mean).reshape(len(bags), -1))

    def _of(self, mean: np.ndarray) -> np.ndarray:
        return (mean if self.head is None else mean @ self.head) + self.bias

    def predict(self, texts: list[str]) -> tuple[list[str], list[float]]:
        if not self.langs or not texts:
            return ["und"] * len(texts), [0.0] * len(texts)
        p = _softmax(self.logits(texts) / self.temperature)
        best = p.argmax(1)
        langs, scores = [self.langs[k] for k in best], p[np.arange(len(best)), best].tolist()
        for k, t in enumerate(texts):
            if not any(map(str.isalpha, t[:64])) and not any(map(str.isalpha, t)):
                langs[k], scores[k] = "und", 0.0
        return langs, scores


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def bag(text: str) -> Bag:
    b = np.concatenate([b for b, _ in _buckets([text])])
    return np.unique(b[b < 1 << BITS], return_counts=True)


def fit(bags: list[Bag], langs: list[str], seed: int = 7) -> Model:
    names = sorted(set(langs))
    if not names:
        return Model([], np.zeros((0, 0), np.float32), np.zeros(0))
    rng = np.random.default_rng(seed)
    y = np.array(list(map({x: k for k, x in enumerate(names)}.__getitem__, langs)))
    aside = np.arange(len(y)) % 5 == 4
    shares = [(b, (c / max(1, c.sum())).astype(np.float32)) for b, c in bags]
    e = rng.uniform(-1 / WIDTH, 1 / WIDTH, ((1 << BITS), WIDTH)).astype(np.float32)
    w, bias = rng.normal(0, 1, (WIDTH, len(names))).astype(np.float32), np.zeros(len(names), np.float32)
    train = np.flatnonzero(~aside)
    for epoch in range(EPOCHS):
        for step, k in enumerate(rng.permutation(train)):
            rate = RATE * (1 - (epoch + step / len(train)) / EPOCHS)
            b, c = shares[k]
            if not len(b):
                continue
            hidden = c @ e[b]
            g = _softmax(hidden @ w + bias)
            g[y[k]] -= 1
            back = w @ g
            w -= (0.1 * rate) * np.outer(hidden, g)
            bias -= (0.002 * rate) * g
            e[b] -= rate * np.outer(c, back)
    table, head = (e @ w, None) if len(names) <= WIDTH else (e, w)
    model = Model(names, np.vstack([table, np.zeros((1, table.shape[1]), np.float32)]).astype(np.float32), bias.astype(float), head)
    held = np.flatnonzero(aside)
    if len(held) > 20:
        z, t = model.of_bags([bags[k] for k in held]), y[held]
        loss = lambda s: -np.log(_softmax(z / s)[np.arange(len(t)), t] + 1e-12).mean()
        model.temperature = float(min(np.geomspace(0.25, 20, 60), key=loss))
        p = _softmax(z / model.temperature)
        right = p.max(1)[p.argmax(1) == t]
        if len(right):
            model.threshold = float(min(HALF, np.quantile(right, REJECTED)))
    return model


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _count(batches):
    """A row's subwords, packed."""
    for b in batches:
        found = [bag(t) for t in texts_of(b)]
        size = pa.array([len(x) for x, _ in found], pa.int64())
        buckets = pa.array([pack(differences(x.astype(np.uint16))) for x, _ in found], pa.binary())
        counts = pa.array([pack(c.astype(np.uint32)) for _, c in found], pa.binary())
        yield pa.RecordBatch.from_arrays([b.column("lang"), b.column("luck"), size, buckets, counts], ["lang", "luck", "n", "buckets", "counts"])


def train(docs: DataFrame, per_lang: int = PER_LANG, most_bytes: int = TRAIN_BYTES) -> Model:
    spark = docs.sparkSession
    known = docs.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.select("lang", "text", F.pmod(F.xxhash64("doc_id", "text", F.lit(11)), F.lit(1 << 40)).alias("luck"))
    counts = known.groupBy("lang").agg(F.approx_count_distinct("luck", 0.02).alias("n")).collect()
    if not counts:
        return fit([], [])
    # Half as many again as asked for are read, by their hash; then the smallest hashes are taken. A row for each language.
    least = spark.createDataFrame([(r.lang, int((1 << 40) * min(1.0, 1.5 * per_lang / r.n))) for r in counts], "lang string, least long")
    rows = known.join(F.broadcast(least), "lang").where("luck < least").groupBy("lang", "luck").agg(F.min("text").alias("text"))
    bags = Scratch(spark, "lang").write(rows.mapInArrow(trimmed(_count), "lang string, luck long, n long, buckets binary, counts binary"))
    by_luck = Window.partitionBy("lang").orderBy("luck")
    size = F.length("buckets") + F.length("counts")
    few = bags.select("lang", "luck", F.row_number().over(by_luck).alias("k"), (F.sum(size).over(by_luck) - size).alias("before"))
    few = few.where(((F.col("before") < most_bytes // len(counts)) | (F.col("k") == 1)) & (F.col("k") <= per_lang)).select("lang", "luck")
    got = bags.join(F.broadcast(few), ["lang", "luck"]).toPandas().sort_values(["lang", "luck"])
    unpacked = [(np.cumsum(unpack(b, n, np.uint16), dtype=np.int64), unpack(c, n, np.uint32)) for n, b, c in zip(got["n"], got["buckets"], got["counts"])]
    return fit(unpacked, got["lang"].tolist())


ADDED = ("lang_pred", "score", "rejected")


def identify(docs: DataFrame, model: Model, names: tuple[str, str, str] = ADDED) -> DataFrame:
    """All columns of docs, and lang_pred, score, rejected, or what names calls them."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    cols = [c for c in docs.columns if c not in names]

    rows = docs.select(*quoted(cols))
    kinds = (T.StringType(), T.DoubleType(), T.BooleanType())
    schema = T.StructType([*plain(rows).schema, *(T.StructField(f"o{k}", kind) for k, kind in enumerate(kinds))])

    def run(batches):
        m = sent.value
        for b in batches:
            langs, scores = [], []
            for texts in slices(texts_of(b), SLICE):
                x, y = m.predict(texts)
                langs += x
                scores += y
            gone = [x == "und" or s < m.threshold for x, s in zip(langs, scores)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(gone, pa.bool_())], schema.names)

    return small_batches(plain(rows)).mapInArrow(trimmed(run), schema).toDF(*cols, *names)


def predictions(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected for each row."""
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    return identify(rows, train(docs)).drop("text")
