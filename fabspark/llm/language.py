"""Language identification by error-correcting output codes over n-gram classifiers.

Each learned language has a codeword; one binary naive Bayes classifier per bit,
over hashed byte 2- and 3-grams, predicts that bit. A text goes to the codeword
with the smallest weighted loss; bits that the classifier gets wrong more often
on a language weigh less for it. Close calls are flagged as ambiguous.

Training gathers one count per (language, n-gram bucket) over all training rows
(bounded by languages x buckets, so it fits the driver at any corpus size);
bit weights come from a bounded sample of the training rows.

Codewords: all 2**(L-1) - 1 splits for up to 7 languages, else a fixed-seed random
code of about 10 log2(L) bits. Ties take the first language in sorted order.

Defined cases: texts that are null or have no letter get ``und``, score 0, not
ambiguous; rows with null lang or text train nothing; without training rows
every prediction is ``und``; a single learned language is always predicted;
repeated rows train as often as they occur; extra columns are ignored.
"""
from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .textkit import small_batches

_BLOCK = 1 << 20                  # bytes of a text scored at once
_NOT_LETTERS = bytes(c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))


def grams(text: str, buckets: int) -> Iterator[np.ndarray]:
    """Hashed bucket ids of the byte 2- and 3-grams of a whole text, in blocks."""
    raw = b" " + b" ".join(text.lower().encode(errors="replace").translate(_NOT_LETTERS).split()) + b" "
    for i in range(0, max(1, len(raw) - 2), _BLOCK):
        a = np.frombuffer(raw[i:i + _BLOCK + 2], dtype=np.uint8).astype(np.uint32)
        pair = a[:-1] * np.uint32(257) + a[1:]
        triple = pair[:-1] * np.uint32(263) + a[2:] + np.uint32(0x10000)
        for g in (pair, triple):
            yield ((g * np.uint32(2654435761)) >> np.uint32(8)) % np.uint32(buckets)


def codebook(n: int) -> np.ndarray:
    """Codewords of +1 / -1, one row a language."""
    if n <= 1:
        return np.ones((n, 1), dtype=np.int8)
    if n <= 7:
        return np.array([[1 if (c >> r) & 1 else -1 for c in range(1, 2 ** n, 2)][:2 ** (n - 1) - 1]
                         for r in range(n)], dtype=np.int8)
    rng, width = np.random.default_rng(7), math.ceil(10 * math.log2(n))
    tries = []
    for _ in range(64):
        code = rng.choice(np.array([-1, 1], dtype=np.int8), size=(n, width))
        apart = (width - code.astype(int) @ code.T.astype(int)) // 2 + width * np.eye(n, dtype=int)
        tries.append((int(apart.min()), -len(tries), code))
    return max(tries, key=lambda t: t[:2])[2]


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray              # L x bits
    log_odds: np.ndarray          # buckets x bits, float32
    weights: np.ndarray           # L x bits, rows sum to 1
    temperature: float = 12.0
    close: float = 0.6            # ambiguous when the winner's share is below this

    def margins(self, text: str) -> np.ndarray:
        total, n = np.zeros(self.log_odds.shape[1]), 0
        for g in grams(text, len(self.log_odds)):
            total += self.log_odds[g].sum(axis=0, dtype=np.float64)
            n += len(g)
        return total / max(1, n)

    def decode(self, text: str | None) -> tuple[str, float, bool]:
        if not self.languages or not text or not any(map(str.isalpha, text)):
            return "und", 0.0, False
        # logistic loss of each bit against each codeword
        loss = (self.weights * np.logaddexp(0.0, -self.temperature * self.code * self.margins(text))).sum(axis=1)
        share = np.exp(-(loss - loss.min()))
        share /= share.sum()
        best = int(np.argmax(share))
        return self.languages[best], float(share[best]), bool(share[best] < self.close)


def learn(rows: DataFrame, buckets: int = 1 << 14, alpha: float = 0.5, weight_rows: int = 5000) -> Model:
    """Fit on (text, lang); ``weight_rows`` bounds the rows that set the bit weights."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for b in batches:
            for text, lang in zip(b.column("text"), b.column("lang").to_pylist()):
                mine = held.setdefault(lang, np.zeros(buckets + 1, dtype=np.int64))
                mine[buckets] += 1                                    # rows
                for g in grams(text.as_py(), buckets):
                    mine[:buckets] += np.bincount(g, minlength=buckets)
        for lang, mine in held.items():
            at = np.flatnonzero(mine)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at), pa.array(mine[at])],
                                             names=["lang", "bucket", "n"])

    small_batches(rows.sparkSession)
    rows = rows.where("text IS NOT NULL AND lang IS NOT NULL").select("text", "lang")
    counted = (rows.mapInArrow(count, "lang string, bucket bigint, n bigint")
                   .groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas())
    languages = sorted(counted["lang"].unique())
    totals = np.zeros((len(languages), buckets + 1))
    totals[np.searchsorted(languages, counted["lang"]), counted["bucket"].astype(int)] = counted["n"]
    seen, totals = totals[:, buckets].sum(), totals[:, :buckets]
    code = codebook(len(languages))
    # every language counts alike within its side of a bit
    rate = totals / np.maximum(1, totals.sum(axis=1, keepdims=True))
    smooth = alpha / max(1.0, totals.sum() / max(1, len(languages)))
    log_odds = np.zeros((buckets, code.shape[1]), dtype=np.float32)
    for bit in range(code.shape[1]):
        up, down = code[:, bit] > 0, code[:, bit] < 0
        if up.any() and down.any():
            log_odds[:, bit] = np.log(rate[up].mean(axis=0) + smooth) - np.log(rate[down].mean(axis=0) + smooth)
    model = Model(languages, code, log_odds, np.full(code.shape, 1 / max(1, code.shape[1])))
    if len(languages) > 1:
        model.weights = _bit_weights(rows, model, min(1.0, weight_rows / max(1.0, seen)))
    return model


def _bit_weights(rows: DataFrame, model: Model, share: float) -> np.ndarray:
    """How often each bit is right on each language, over a sample of the training rows."""
    place = {lang: i for i, lang in enumerate(model.languages)}

    def right(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hits = np.zeros(model.code.shape, dtype=np.int64)
        n = np.zeros(len(place), dtype=np.int64)
        for b in batches:
            for text, lang in zip(b.column("text"), b.column("lang").to_pylist()):
                i = place[lang]
                hits[i] += model.code[i] * model.margins(text.as_py()) > 0
                n[i] += 1
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(at, hits.shape[1])), pa.array(np.tile(np.arange(hits.shape[1]), len(at))),
             pa.array(hits[at].ravel()), pa.array(np.repeat(n[at], hits.shape[1]))], names=["lang", "bit", "hits", "n"])

    sample = rows.where(F.pmod(F.xxhash64("text"), F.lit(1 << 50)) < int(share * (1 << 50)))
    got = (sample.mapInArrow(right, "lang bigint, bit bigint, hits bigint, n bigint")
                 .groupBy("lang", "bit").agg(F.sum("hits").alias("hits"), F.sum("n").alias("n")).collect())
    accuracy = np.full(model.code.shape, 0.5)
    for r in got:
        accuracy[r["lang"], r["bit"]] = (r["hits"] + 1) / (r["n"] + 2)
    return accuracy / accuracy.sum(axis=1, keepdims=True)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score (share of the winner), ambiguous, and passed-on columns but text."""
    docs = docs.drop("lang_pred", "score", "ambiguous")        # an input column named like a result is replaced
    shared = docs.sparkSession.sparkContext.broadcast(model)     # buckets x bits, bounded by the languages
    small_batches(docs.sparkSession)
    passed = [c for c in docs.columns if c != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = shared.value.decode
        for b in batches:
            got = list(zip(*(decode(t.as_py()) for t in b.column("text")))) or [(), (), ()]
            yield pa.RecordBatch.from_arrays(
                [*[b.column(c) for c in passed], pa.array(got[0], pa.string()), pa.array(got[1], pa.float64()),
                 pa.array(got[2], pa.bool_())], names=[*passed, "lang_pred", "score", "ambiguous"])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name != "text")
    return docs.mapInArrow(run, f"{kept}, lang_pred string, score double, ambiguous boolean")
