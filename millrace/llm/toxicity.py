"""Toxicity: subword-bag embeddings averaged into a linear softmax.

A text is the mean of the vectors of its character n-grams (hashed to buckets), each as often as it occurs and weighted by
how rare it is in the training texts; buckets of fewer than `LEAST` training texts weigh nothing. A linear softmax over that
mean gives the class. Vectors and softmax are trained jointly in numpy by AdaGrad. A misspelling that was never seen still
shares most n-grams with its known forms. As the head is linear, a bucket's whole effect is one number, so that
scoring is a lookup and a mean over whole texts.

The model is fitted in one task on at most `PER_CLASS` rows of each class (the rows with the smallest hashes, of those
whose document is there), with equal weight for both classes. Training and scoring read every text in full: tasks turn texts
of any length into bags, with at most one entry of 8 bytes for each bucket. The driver gets the sample's labels and the model.

Defined cases: null and empty texts, and texts without letters or digits, have no n-grams and score as the intercept;
without training rows of both classes every score is the share of label 1 among them (0 if there are none); null
labels are left out; a document that has several labels is a training row for each; an empty table gives an empty result; columns of
the input that have the names of results are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from millrace.llm import subwords
from millrace.llm.common import table
from millrace.stages import cut

PER_CLASS = 2000
#: Training texts that a bucket must occur in to weigh anything.
LEAST = 4
DIMENSIONS = 8
EPOCHS = 6
STEPS = 600  # a small sample is gone through more often
RATE = 1.0
BATCH = 32


def _bags(texts):
    """The distinct n-grams of each text, as buckets, and how often each occurs."""
    at, held = 0, []

    def merged():
        ids, place = np.unique(np.concatenate([h[0] for h in held]), return_inverse=True)
        return ids, np.bincount(place, np.concatenate([h[1] for h in held])).astype(np.int32)

    for block in subwords.blocks(texts):
        buckets, counts = subwords.ngrams([piece for _, piece in block])
        parts = np.split(buckets.astype(np.int32), np.cumsum(counts.ravel())[:-1])
        for k, (text, _) in enumerate(block):
            if text != at:
                yield held[0] if len(held) == 1 else merged()
                at, held = text, []
            held.append(np.unique(np.concatenate(parts[k :: len(block)]), return_counts=True))
            if len(held) > 8:
                held = [merged()]
    if held:
        yield held[0] if len(held) == 1 else merged()


@dataclass(frozen=True)
class SubwordModel:
    effect: np.ndarray  # per bucket: log-odds of label 1 that its n-gram adds, before the mean is taken
    weight: np.ndarray  # per bucket: what one occurrence counts in the mean
    intercept: float

    def scores(self, texts) -> np.ndarray:
        logit = []
        for ids, counts in _bags(texts):
            share = self.weight[ids] * counts
            logit.append((self.effect[ids] * share).sum() / share.sum() if share.any() else 0.0)
        return 1 / (1 + np.exp(-np.clip(np.array(logit, float) + self.intercept, -50, 50)))


def train(texts, labels: np.ndarray, share: float, seed: int = 7) -> SubwordModel:
    """Joint training on texts; both classes weigh the same. `share`, that of label 1, is only used if one class is missing."""
    return train_bags(_bags(texts), labels, share, seed)


def train_bags(found, labels: np.ndarray, share: float, seed: int = 7) -> SubwordModel:
    """`train` on the (buckets, counts) of each text, which are gone through once."""
    vectors = np.zeros((1 << subwords.BUCKET_BITS, DIMENSIONS), np.float32)
    if len(set(labels)) < 2:
        edge = 1e-6
        return SubwordModel(vectors[:, 0], vectors[:, 1], float(np.log(max(share, edge) / max(1 - share, edge))))
    seen_in, bags = np.zeros(len(vectors), np.int32), []
    for ids, counts in found:
        seen_in[ids] += 1
        bags.append((ids, counts.astype(np.float32)))
    rarity = np.where(seen_in >= LEAST, np.log((len(bags) + 1) / np.maximum(seen_in, 1)), 0).astype(np.float32)
    for k, (ids, counts) in enumerate(bags):
        ids, counts = ids[rarity[ids] > 0], counts[rarity[ids] > 0] * rarity[ids[rarity[ids] > 0]]
        bags[k] = ids, counts / max(counts.sum(), np.float32(1e-9))
    rng = np.random.default_rng(seed)
    vectors += rng.standard_normal(vectors.shape).astype(np.float32) * 0.01
    head, bias = (rng.standard_normal((DIMENSIONS, 2)) * 0.5).astype(np.float32), np.zeros(2, np.float32)
    # AdaGrad with one scale for all vectors: a scale for each would let n-grams of a single text weigh as much as common ones
    seen, seen_head = 1e-12, np.full(head.shape, 1e-8, np.float32)
    weight = np.where(labels == 1, 0.5 / labels.mean(), 0.5 / (1 - labels.mean())).astype(np.float32)
    for _ in range(max(EPOCHS, min(40, -(-STEPS * BATCH // len(bags))))):
        order = rng.permutation(len(bags))
        for chosen in np.split(order, range(BATCH, len(order), BATCH)):
            size = np.array([len(bags[i][0]) for i in chosen])
            ids, part = (np.concatenate([bags[i][k] for i in chosen]) for k in (0, 1))
            row = np.repeat(np.arange(len(chosen)), size)
            used, local = np.unique(ids, return_inverse=True)
            own = vectors[ids] * part[:, None]
            mean = np.stack([np.bincount(row, own[:, k], minlength=len(chosen)) for k in range(DIMENSIONS)], 1)
            logit = mean @ head + bias
            miss = np.exp(logit - logit.max(1, keepdims=True))
            miss /= miss.sum(1, keepdims=True)
            miss[np.arange(len(chosen)), labels[chosen]] -= 1
            miss *= weight[chosen][:, None]
            pull = ((miss @ head.T)[row] * part[:, None]).astype(np.float32)
            step = np.stack([np.bincount(local, pull[:, k], minlength=len(used)) for k in range(DIMENSIONS)], 1)
            slope = mean.T @ miss / len(chosen)
            seen_head += slope**2
            head -= (0.1 * slope / np.sqrt(seen_head)).astype(np.float32)
            bias -= (0.1 * miss.mean(0)).astype(np.float32)
            seen += (step**2).sum() / max(1, len(used))
            vectors[used] -= (RATE * step / np.sqrt(seen)).astype(np.float32)
    return SubwordModel(vectors @ (head[:, 1] - head[:, 0]), rarity, float(bias[1] - bias[0]))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", *, per_class: int = PER_CLASS) -> SubwordModel:
    """Fits on documents of a bounded sample of `labels` (doc_id and `label`), whatever the number of either.

    Labels are first joined with the ids of the documents that can be taken, so that a class is only missing from the
    sample if it has none. The sample is small by its bound, so that it is broadcast and no text moves.
    """
    rows = labels.select("doc_id", F.col(label).cast("int").alias("_y")).where("_y in (0, 1)")
    shares = {r["_y"]: r["n"] for r in rows.groupBy("_y").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(shares.values())
    share = shares.get(1, 0) / total if total else 0.0
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("_text"))
    rows = rows.join(texts.select("doc_id"), "doc_id", "left_semi")
    order = [F.xxhash64(F.col("doc_id").cast("string")), F.col("doc_id")]
    sample = [rows.where(F.col("_y") == y).orderBy(*order).limit(per_class) for y in (0, 1)]
    chosen = texts.join(F.broadcast(sample[0].unionByName(sample[1])), "doc_id").select(F.col("doc_id").cast("string").alias("id"), "_y", "_text")

    def bagged(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 64):
                part = batch.slice(k, 64)
                made = list(_bags(part.column(2).to_pylist()))
                binary = [pa.array([bag[i].astype(np.int32).tobytes() for bag in made], pa.binary()) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([*part.columns[:2], *binary], names=["id", "y", "ids", "counts"])

    got = cut(chosen.mapInArrow(bagged, "id string, y int, ids binary, counts binary"), "toxicity-bags")
    order = ["id", "y", "ids"]
    y = np.array([r["y"] for r in got.orderBy(*order).select("y").collect()], np.int64)
    if len(set(y.tolist())) < 2:
        return train_bags((), y, share)

    def trained(batches):
        bags = (tuple(np.frombuffer(c[k].as_buffer(), np.int32) for c in batch.columns[2:]) for batch in batches for k in range(batch.num_rows))
        model = train_bags(bags, y, share)
        yield pa.RecordBatch.from_arrays([pa.array([model.effect.tobytes()]), pa.array([model.weight.tobytes()]), pa.array([model.intercept])], names=["effect", "weight", "intercept"])

    (made,) = got.repartition(1).sortWithinPartitions(*order).mapInArrow(trained, "effect binary, weight binary, intercept double").collect()
    return SubwordModel(np.frombuffer(made["effect"], np.float32), np.frombuffer(made["weight"], np.float32), made["intercept"])


def score(docs: DataFrame, model: SubwordModel, *, text: str = "text", out: str = "score") -> DataFrame:
    """Adds `out`, the probability of label 1 for each whole text."""
    docs = docs.drop(out) if out in docs.columns else docs
    schema = StructType([*docs.schema.fields, StructField(out, DoubleType())])
    spot = docs.columns.index(text)

    def run(batches):
        for batch in batches:
            values = model.scores(batch.column(spot).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, pa.float64())], names=[*batch.schema.names, out])

    return docs.mapInArrow(run, schema)


def fold(folds: int) -> Column:
    """crc32 of the id's text modulo `folds`."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % folds


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels").where(fold(5) != 0))
    scored = score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", (fold(5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {"op5_toxicity": op5_toxicity}
#: Training isn't SQL; tests/llm holds the query to held-out accuracy.
SQL: dict[str, str] = {}
