"""Quality classifier by importance resampling.

Two generative models over hashed tokens and token pairs (a token is a run of
letters and digits, or of other visible characters, A-Z lower-cased): one of target
text (labelled good, a bounded sample of the labels), one of raw text (all documents).
A document's log weight is the sum over its n-grams of log p_target - log p_raw.
Gumbel noise is added and the ``k`` documents with the largest sums are sampled
(Gumbel top-k, without replacement).

``k`` follows from the data: a fifth of the labels is kept out of the target
model; the cut of the log weight that keeps ``keep_good`` of its good rows is
found, and k is the number of documents above that cut. The noise depends on
doc_id and seed only, so runs repeat.

Both models are bounded tables (one number a bucket). The k-th place is found
from a global order with one total a partition, not in one task.

Defined cases: null or wordless texts have log weight 0; rows without label
train nothing, an id labelled twice is good if all its labels are; without good labels on both sides every document is kept; ties go to the smaller doc_id; repeated rows are sampled
as separate rows; extra columns are ignored; empty tables work.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import cut_lineage
from .ranks import in_order
from .textkit import SPACE_WORDS, ngram_hashes, small_batches, texts_as_bytes

BUCKETS = 1 << 14
#: 0: white space, 1: letters and digits (and all beyond ASCII), 2: other characters.
_CLASS = np.array([0 if c == 32 or 9 <= c <= 13 else 1 if c >= 128 or chr(c).isalnum() else 2
                   for c in range(256)], dtype=np.int8)


def _grams(text: bytes | None, buckets: int) -> np.ndarray:
    lower = (text or b"").translate(SPACE_WORDS)
    kind = np.zeros(len(lower) + 2, dtype=np.int8)
    kind[1:-1] = _CLASS[np.frombuffer(lower, dtype=np.uint8)]
    change = kind[1:] != kind[:-1]
    starts, ends = np.flatnonzero(change & (kind[1:] > 0)), np.flatnonzero(change & (kind[:-1] > 0))
    both = np.concatenate([ngram_hashes(lower, starts, ends, n) for n in (1, 2)])
    return (both % np.uint64(buckets)).astype(np.int64)


def _log_rate(counts: np.ndarray, alpha: float) -> np.ndarray:
    return np.log((counts + alpha) / (counts.sum() + alpha * len(counts)))


def fit(docs: DataFrame, good: dict[int, bool], buckets: int = BUCKETS, alpha: float = 0.1) -> np.ndarray:
    """log p_target - log p_raw for each bucket. ``good``: labelled doc_ids."""
    shared = docs.sparkSession.sparkContext.broadcast({d for d, ok in good.items() if ok})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target, chosen = np.zeros((2, buckets), dtype=np.int64), shared.value
        for b in batches:
            for doc, text in zip(b.column("doc_id").to_pylist(), texts_as_bytes(b.column("text"))):
                n = np.bincount(_grams(text, buckets), minlength=buckets)
                target[0] += n
                if doc in chosen:
                    target[1] += n
        at = np.flatnonzero(target[0])
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(target[0][at]), pa.array(target[1][at])],
                                         names=["bucket", "raw", "target"])

    got = (docs.select("doc_id", "text").mapInArrow(count, "bucket bigint, raw bigint, target bigint")
               .groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toPandas())
    raw, target = np.zeros(buckets), np.zeros(buckets)
    raw[got["bucket"].astype(int)], target[got["bucket"].astype(int)] = got["raw"], got["target"]
    if not target.sum():
        return np.zeros(buckets, dtype=np.float32)
    return (_log_rate(target, alpha) - _log_rate(raw, alpha)).astype(np.float32)


def log_weights(docs: DataFrame, ratio: np.ndarray) -> DataFrame:
    """doc_id, n_grams and log_weight of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(ratio)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for b in batches:
            n, weight = [], []
            for text in texts_as_bytes(b.column("text")):
                g = _grams(text, len(table))
                n.append(len(g))
                weight.append(float(table[g].sum(dtype=np.float64)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(weight, pa.float64())],
                                             names=["doc_id", "n_grams", "log_weight"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n_grams bigint, log_weight double")


def resample(docs: DataFrame, labels: DataFrame, keep_good: float = 0.995, label_rows: int = 20_000,
             seed: int = 17, noise: float = 1.0) -> DataFrame:
    """doc_id, n_grams, log_weight, sample_key (with Gumbel noise), kept.

    ``labels``: (doc_id, good boolean); at most about ``label_rows`` of them are used.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    labels = labels.where("doc_id IS NOT NULL AND good IS NOT NULL").select(F.col("doc_id").cast("long"), "good")
    labels = labels.groupBy("doc_id").agg(F.min("good").alias("good"))
    # the hash cut keeps what each task sends near the number wanted
    key, n = F.xxhash64("doc_id", F.lit(seed)), labels.count()
    share = min(1.0, (1.2 * label_rows + 1000) / max(1, n))
    cut = min((1 << 63) - 1, int(share * (1 << 64)) - (1 << 63))
    used = labels.where(key <= F.lit(cut)).orderBy(key, "doc_id").limit(label_rows)
    good = {r["doc_id"]: r["good"] for r in used.collect()}          # bounded by label_rows
    ordered_ids = sorted(good)
    held_out = {d for i, d in enumerate(ordered_ids) if i % 5 == 0}  # sets the cut
    ratio = fit(docs, {d: ok for d, ok in good.items() if d not in held_out})
    uniform = (F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    scored = log_weights(docs, ratio).withColumn(
        "sample_key", F.col("log_weight") - noise * F.log(-F.log(F.coalesce(uniform, F.lit(0.5)))))
    # texts are scored once: range partitioning samples its input, so it gets the narrow rows
    ordered, _ = in_order(cut_lineage(scored), [F.desc("sample_key"), F.asc("doc_id")])
    calibration = [(d,) for d in held_out if good[d]]                # at most a fifth of label_rows
    rows = docs.sparkSession.createDataFrame(calibration, "doc_id bigint")
    seen = sorted(r["log_weight"] for r in ordered.join(F.broadcast(rows), "doc_id").select("log_weight").collect())
    floor = seen[int((1 - keep_good) * len(seen))] if seen and ratio.any() else -np.inf
    k = ordered.where(F.col("log_weight") >= F.lit(float(floor))).count()
    return ordered.select("doc_id", "n_grams", "log_weight", "sample_key", (F.col("_row") < k).alias("kept"))
