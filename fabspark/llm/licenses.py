"""Licence scan: Aho-Corasick over normalised words, expressions by shunting-yard.

One automaton holds the base phrases, further notice phrases and the identifier
tag. The words after a tag are parsed as a licence expression (identifiers,
parentheses, with > and > or); the longest prefix of the line that is a whole
expression counts, and ``permits`` evaluates it against a set of identifiers.

Labels are the base labels, the labels of notice phrases found, and the lower-cased
identifiers of tagged expressions. score is 1 - prod(1 - weight) over the distinct
phrases found, or 1 when a tagged expression parses; 0 without any finding.

Defined cases: null text counts as empty (0 words, empty labels, null places);
repeated rows are scanned each; empty tables and extra columns are fine.
"""
from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .textkit import ALNUM_WORDS, small_batches, split_words, texts_as_bytes, word_starts

# Base phrases and labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
# Notice phrases of this scan: label and weight as evidence.
NOTICES = {
    "mit license": ("mit", 0.9), "apache license version 2 0": ("apache-2.0", 0.95),
    "apache license": ("apache", 0.8), "bsd license": ("bsd", 0.8),
    "bsd 2 clause": ("bsd-2-clause", 0.9), "bsd 3 clause": ("bsd-3-clause", 0.9),
    "gnu general public license version 2": ("gpl-2.0", 0.95),
    "gnu general public license version 3": ("gpl-3.0", 0.95),
    "general public license version 2": ("gpl-2.0", 0.9), "general public license version 3": ("gpl-3.0", 0.9),
    "lesser general public license": ("lgpl", 0.9), "affero general public license": ("agpl", 0.9),
    "mozilla public license": ("mpl", 0.9), "eclipse public license": ("epl", 0.9),
    "cc by sa": ("cc-by-sa", 0.9), "cc by nc": ("cc-by-nc", 0.9), "cc by nd": ("cc-by-nd", 0.9),
    "creative commons attribution": ("cc", 0.8), "public domain": ("public-domain", 0.5),
    "isc license": ("isc", 0.9), "boost software license": ("bsl-1.0", 0.9), "unlicense": ("unlicense", 0.7),
}
BASE_WEIGHT = 0.6
#: Identifiers that may be met by default.
ALLOWED = ("0bsd", "apache-2.0", "bsd-2-clause", "bsd-3-clause", "cc-by-4.0", "cc0-1.0", "isc", "mit", "unlicense", "zlib")
TAG = "spdx license identifier"
_TOKEN = re.compile(r"[ \t]*([()]|[A-Za-z0-9][A-Za-z0-9.+-]*)")
_RANK = {"or": 1, "and": 2, "with": 3}


def parse_expression(line: str) -> list[str] | None:
    """Postfix form of the longest prefix of ``line`` that is a whole expression."""
    out: list[str] = []
    stack: list[str] = []
    best: list[str] | None = None
    at, operand_next, depth = 0, True, 0
    while m := _TOKEN.match(line, at):
        token, at = m[1], m.end()
        word = token.lower()
        if token == "(" and operand_next:
            stack.append("(")
            depth += 1
            continue
        if token == ")" and not operand_next and depth:
            while stack[-1] != "(":
                out.append(stack.pop())
            stack.pop()
            depth -= 1
        elif word in _RANK and not operand_next:
            while stack and stack[-1] != "(" and _RANK[stack[-1]] >= _RANK[word]:
                out.append(stack.pop())
            stack.append(word)
            operand_next = True
            continue
        elif operand_next and token not in "()" and word not in _RANK:
            out.append(word)
            operand_next = False
        else:
            break
        if not depth and not operand_next:
            best = out + stack[::-1]
    return best


def permits(postfix: list[str], allowed: set[str]) -> bool:
    """Whether the licence may be taken: or = either side, and = both; an exception
    (with) only adds rights, so its licence decides."""
    held: list[bool] = []
    for token in postfix:
        if token in _RANK:
            b, a = held.pop(), held.pop()
            held.append(a or b if token == "or" else a and b if token == "and" else a)
        else:
            held.append(token in allowed)
    return held[-1]


def identifiers(postfix: list[str]) -> set[str]:
    """The licence identifiers of an expression, without exceptions."""
    held: list[set[str]] = []
    for token in postfix:
        if token in _RANK:
            b, a = held.pop(), held.pop()
            held.append(a if token == "with" else a | b)
        else:
            held.append({token})
    return held[-1]


def _machine() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for phrase in {*BASE, *NOTICES, TAG}:
        found.add_word(f" {phrase} ", phrase)
    found.make_automaton()
    return found


def scan(batches: Iterator[pa.RecordBatch], passed: list[str], allowed: set[str]) -> Iterator[pa.RecordBatch]:
    machine = _machine()
    for b in batches:
        rows = []
        for text in texts_as_bytes(b.column("text")):
            joined, starts, _ = split_words(text, ALNUM_WORDS)
            places: list[int] = []
            base, labels, miss, expressions, verdicts = set(), set(), {}, [], []
            for end, phrase in machine.iter(f" {joined.decode('latin-1')} "):
                if phrase == TAG:
                    first, last = word_starts(text, ALNUM_WORDS)
                    word = int(np.searchsorted(starts, end - len(phrase) - 1)) + 2     # "identifier"
                    line = text[last[word]:].split(b"\n", 1)[0].decode(errors="replace")
                    postfix = parse_expression(line.lstrip(" \t:\"'"))
                    if postfix:
                        expressions.append(" ".join(postfix))
                        verdicts.append(permits(postfix, allowed))
                        labels |= identifiers(postfix)
                        miss[TAG] = 0.0
                    continue
                if phrase in BASE:
                    places.append(int(np.searchsorted(starts, end - len(phrase) - 1)))
                    base.add(BASE[phrase])
                    miss[phrase] = 1 - BASE_WEIGHT
                if phrase in NOTICES:
                    label, weight = NOTICES[phrase]
                    labels.add(label)
                    miss[phrase] = 1 - weight
            rows.append((len(starts), len(places), min(places, default=None), max(places, default=None),
                         ",".join(sorted(base)), ",".join(sorted(base | labels)),
                         1.0 - float(np.prod(list(miss.values()) or [1.0])), expressions, all(verdicts) if verdicts else None))
        cols = list(zip(*rows)) or [()] * 9
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.list_(pa.string()), pa.bool_())
        names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "expressions", "permitted"]
        yield pa.RecordBatch.from_arrays([*[b.column(c) for c in passed], *[pa.array(c, t) for c, t in zip(cols, kinds)]],
                                         names=[*passed, *names])


def scan_licenses(docs: DataFrame, allowed: Iterable[str] = ALLOWED) -> DataFrame:
    """doc_id with word count, base places, labels, score, tagged expressions (postfix) and ``permitted``: whether
    all of its expressions may be met with the ``allowed`` identifiers (null without an expression)."""
    small_batches(docs.sparkSession)
    allowed = {a.lower() for a in allowed}
    slim = docs.select(F.col("doc_id").cast("long"), "text")
    return slim.mapInArrow(
        lambda batches: scan(batches, ["doc_id"], allowed),
        "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, "
        "labels string, score double, expressions array<string>, permitted boolean")
