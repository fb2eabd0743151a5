"""Quality rules with cross-document line frequency, in DataFrame functions only.

Base rules look at one text: word and symbol counts, repeated lines, words inside
repeated 3-word windows. Then every line is normalised (lower-cased, white space
collapsed) and hashed; documents are counted per (host, line). Lines in more than
``max_documents`` documents of a host are removed, and a document that loses more
than half of its words that way is depleted and rejected.

A line seen in every document is counted with partial aggregates and joined back
under ``SALTS`` salts, so no task gets all of its rows.

Defined cases: null text has no words (base_failed); null hosts form one host;
a null doc_id counts as one document; a document repeated under one doc_id counts once;
empty tables and extra columns are fine.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .columns import let

SPACES = "[ \\t-\\r]+"
NOT_SPACE = "[^ \\t-\\r]"
SALTS = 8


def _words(text: Column) -> Column:
    return F.filter(F.split(text, SPACES, -1), lambda w: w != "")


def _lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n", -1), lambda line: line.rlike(NOT_SPACE))


def _normal(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(line), SPACES, " "))


def repeated_window_words(words: Column) -> Column:
    """Words inside 3-word windows that occur twice or more in the same text."""
    def covered(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        again = let(pairs, lambda s: F.filter(
            s, lambda x, k: F.coalesce(F.get(s, k - 1)["h"] == x["h"], F.lit(False))
            | F.coalesce(F.get(s, k + 1)["h"] == x["h"], F.lit(False))))
        places = F.sort_array(F.transform(again, lambda x: x["i"]))
        # a window covers 3 words, less where the next repeated window begins earlier
        widths = let(places, lambda p: F.transform(p, lambda x, k: F.least(F.lit(3), F.get(p, k + 1) - x)))
        return F.aggregate(widths, F.lit(0).cast("long"), lambda a, x: a + x)

    def windows(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(w) - 3),
                           lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))

    def count(w: Column) -> Column:
        return F.when(F.size(w) < 4, F.lit(0).cast("long")).otherwise(let(windows(w), lambda h: F.when(
            F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(covered(h))))
    return let(words, count)


def base_rules(docs: DataFrame) -> DataFrame:
    """doc_id, _text (hash), n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    text = F.coalesce(F.col("text"), F.lit(""))
    measured = docs.select(
        F.col("doc_id").cast("long"), F.xxhash64(text).alias("_text"),
        let(_words(text), lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.char_length(F.array_join(w, "")).cast("long").alias("word_chars"),
            repeated_window_words(w).alias("n_repeat_words"))).alias("m"),
        F.char_length(F.regexp_replace(text, "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        let(_lines(text), lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))
    return measured.select("doc_id", "_text", "m.n_words", "m.word_chars", "n_symbols", "n_dup_lines", "m.n_repeat_words",
                           ((F.col("m.n_words") < 50) | (100 * F.col("m.n_repeat_words") > 50 * F.col("m.n_words")))
                           .alias("base_failed"))


def line_rows(docs: DataFrame, host: str) -> DataFrame:
    """One row a line that has a word: hash of the normalised line, and its words."""
    text = F.coalesce(F.col("text"), F.lit(""))
    hashed = F.transform(_lines(text), lambda line: let(_normal(line), lambda n: F.struct(
        F.xxhash64(n).alias("line"), F.size(F.split(n, " ", -1)).alias("words"))))
    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64(text).alias("_text"),
                       F.coalesce(F.col(host).cast("string"), F.lit("")).alias("host"), F.explode(hashed).alias("x"))
    return rows.select("doc_id", "_text", "host", "x.line", "x.words")


def frequent_lines(rows: DataFrame, max_documents: int) -> DataFrame:
    """(host, line) held by more than ``max_documents`` documents."""
    return (rows.groupBy("host", "line").agg(F.countDistinct(F.coalesce("doc_id", F.lit(-(1 << 62)))).alias("n"))
                .where(F.col("n") > max_documents).select("host", "line"))


def removed_lines(docs: DataFrame, host: str = "source", max_documents: int = 20) -> DataFrame:
    """doc_id, _text, removed_words and the removed lines' hashes, for documents that lose any."""
    rows = line_rows(docs, host)
    salted = frequent_lines(rows, max_documents).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    # a line standing several times in a document loses all its places; copies of a row lose the same
    mine = (rows.withColumn("salt", F.pmod(F.xxhash64("doc_id", "_text"), F.lit(SALTS)).cast("int"))
                .join(salted, ["host", "line", "salt"]))
    per_line = mine.groupBy("doc_id", "_text", "host", "line").agg(F.sum("words").alias("words"))
    return per_line.groupBy("doc_id", "_text").agg(
        F.sum("words").alias("removed_words"), F.collect_set("line").alias("removed"))


def _joined(left: DataFrame, right: DataFrame) -> DataFrame:
    right = right.withColumnsRenamed({"doc_id": "_id", "_text": "_t"})
    return left.join(right, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_t")), "left").drop("_id", "_t")


def apply_rules(docs: DataFrame, host: str = "source", max_documents: int = 20) -> DataFrame:
    """The base measures with removed_words and the verdict ``kept``, one row a document."""
    base = base_rules(docs)
    lost = removed_lines(docs, host, max_documents).drop("removed")
    copies = docs.select(F.col("doc_id").cast("long"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("_text")).groupBy("doc_id", "_text").agg(F.count(F.lit(1)).alias("_copies"))
    lost = _joined(lost, copies)        # rows repeated under one doc_id were summed together
    judged = _joined(base, lost.withColumn("removed_words", F.floor(F.col("removed_words") / F.col("_copies"))).drop("_copies"))
    removed = F.coalesce("removed_words", F.lit(0)).cast("long")
    return judged.drop("_text").withColumn("removed_words", removed).withColumn(
        "kept", ~F.col("base_failed") & (2 * removed <= F.col("n_words")))


def clean(docs: DataFrame, host: str = "source", max_documents: int = 20) -> DataFrame:
    """``docs`` that are kept, their frequent lines taken out of the text."""
    plain = docs.toDF(*[c if c in ("doc_id", "text") else f"c{i}" for i, c in enumerate(docs.columns)])
    host = plain.columns[docs.columns.index(host)]
    text = F.coalesce(F.col("text"), F.lit(""))
    kept = apply_rules(plain, host, max_documents).where("kept").select(F.col("doc_id").alias("_kept")).distinct()
    lost = removed_lines(plain, host, max_documents).drop("removed_words")
    rows = _joined(plain.withColumn("_text", F.xxhash64(text)), lost)
    rows = rows.join(kept, F.col("doc_id").eqNullSafe(F.col("_kept")), "left_semi")
    left = F.filter(F.split(text, "\n", -1),
                    lambda line: ~F.coalesce(F.array_contains("removed", F.xxhash64(_normal(line))), F.lit(False)))
    rows = rows.withColumn("text", F.when(F.col("removed").isNull(), F.col("text")).otherwise(F.array_join(left, "\n")))
    return rows.select(*[F.col(a).alias(b) for a, b in zip(plain.columns, docs.columns)])
