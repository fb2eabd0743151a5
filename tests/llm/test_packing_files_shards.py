import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer
from llm_conftest import SF001, edge_texts, edges, empty  # noqa: F401

from fabspark.llm import bpe, packing, sharding, token_files


def direct(name, text):
    return np.array(bpe.encoder(name).tokenizer.encode(text or "", add_special_tokens=False).ids + [2], dtype="<u4")


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_of_mixed_white_space(name):
    e, rng = bpe.encoder(name), np.random.default_rng(11)
    letters = [*"aB1.,'", "can't", "É", "中", "Σ", "<|endoftext|>", *[" ", "\n", "\t", "\r", "\xa0", "\u3000", "\u0301"] * 2]
    for _ in range(5000):
        text = "".join(rng.choice(letters, size=rng.integers(1, 9)))
        assert e.ids(text) == e.whole(text), repr(text)
    assert e.ids(" \xa0 \xa0\tB") == e.whole(" \xa0 \xa0\tB")


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_piecewise_ids_equal_whole_text_ids(name):
    odd = ["a  b", " a", "a ", "\n\na", "a\n b", "a\r\nb", "a \xa0b\xa0 c", "a\t\tb", "it's we'll  x", "", "  ", "\n", "x\n",
           "<|endoftext|> x", "Éa é ΣΑΣ ΣΑΣ. ς", "x\x1cb \x85c", "a   b\n\n\nc", "İ ŉ ſ Å é. ,, a., straße Dž ª µ.", " ́x áb",
           *[t for t in edge_texts() if t]]
    e = bpe.encoder(name)
    for text in odd * 2:                   # the second time from the memo
        assert np.array_equal(np.frombuffer(e.ids(text), "<u4"), direct(name, text)[:-1]), text


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids_of_added_tokens(name):
    """By the file alone: no tokenizer of the package's own making."""
    plain, e = Tokenizer.from_file(public_tokenizers.path(name)), bpe.encoder(name)
    special = plain.token_to_id("<|endoftext|>")
    for text in ["end <|endoftext|> x", "<|endoftext|>", "a<|endoftext|>b c", "x <|startoftext|> y", "<|ENDOFTEXT|> z", "<| endoftext |>",
                 "end\n<|endoftext|><|endoftext|> x\n y", *[t for t in edge_texts() if t]] * 2:
        want = plain.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(e.ids(text), "<u4").tolist() == want, text[:80]
        assert (special in want) == ("<|endoftext|>" in text)


def check_packing(docs, rows, capacity):
    texts = defaultdict(list)
    for r in docs.select("doc_id", "text").collect():
        texts[r["doc_id"]].append(direct("byte_bpe_50k.json", r["text"]))
    want = sorted(((d, k, s, n, zlib.crc32(ids[s:s + n].tobytes()))
                   for d, all_ids in texts.items() for ids in all_ids
                   for k, (s, n) in enumerate(packing.cut_points(len(ids), capacity))), key=str)
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows), key=str) == want
    bins = defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for held in bins.values():
        held.sort()
        assert [o for o, _ in held] == list(np.cumsum([0, *[n for _, n in held]])[:-1])
        assert sum(n for _, n in held) <= capacity
    return len(bins)


def test_packing_edges(edges, empty):
    for capacity in (64, 1024):
        check_packing(edges, packing.pack(edges, capacity).collect(), capacity)
    assert packing.pack(empty).count() == 0


def test_packing_is_tight(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    rows = packing.pack(docs).collect()
    used = check_packing(docs, rows, 1024)
    assert used <= 1.02 * sum(r["length"] for r in rows) / 1024 + 1


def test_plan_places_every_piece_once():
    rng = np.random.default_rng(0)
    for _ in range(30):
        histogram = {int(s): int(rng.integers(1, 40)) for s in rng.integers(1, 65, size=rng.integers(1, 40))}
        plan = packing.Plan(histogram, 64)
        fill, places = defaultdict(int), defaultdict(set)
        for size, first, n, per, base, offset in plan.runs:
            for i in range(n):
                assert first + i not in places[size]
                places[size].add(first + i)
                fill[base + i // per] += size
                assert offset + i % per * size + size <= 64
        assert {s: len(p) for s, p in places.items()} == histogram and max(fill.values()) <= 64
        total = sum(s * c for s, c in histogram.items())
        assert len(fill) == plan.sequences <= max(1.25 * total / 64 + 1, sum(c for s, c in histogram.items() if 3 * s > 64))


@pytest.mark.parametrize("bits", [1, 7, 8, 13, 16, 17, 24, 31, 32])
def test_bit_packing_round_trip(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, size=5000).astype("<u4")
    assert np.array_equal(token_files.unpack_bits(token_files.pack_bits(ids, bits), len(ids), bits), ids)
    content = token_files.build_file([(7, ids[:1234].tobytes()), (None, b""), (9, ids[1234:].tobytes())], bits, 512, 0, 0)
    f = token_files.TokenFile(content + b"\n")
    assert f.doc_ids == [7, None, 9] and np.array_equal(f.document(2), ids[1234:])
    assert np.array_equal(f.tokens(700, 2000), ids[700:2700]) and len(f.document(1)) == 0
    assert token_files.bits_for(49408) == 16 and token_files.bits_for(2) == 1


def test_token_files_round_trip(edges, empty):
    got = sorted(((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"])
                  for r in token_files.round_trip(edges, file_tokens=1000, block=100).collect()))
    at, last = 0, None
    rows = sorted(edges.select("doc_id", "text").collect(), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0))
    want = sorted((r["doc_id"] is not None, r["doc_id"] or 0, zlib.crc32(direct("word_bpe_49k.json", r["text"]).tobytes())) for r in rows)
    assert sorted((d is not None, d or 0, c) for _, d, _, c in got) == want
    for start, doc, n, _ in got:
        assert start == at and (last is None or doc >= last)
        at, last = at + n, doc
    assert token_files.round_trip(empty).count() == 0


def test_shards(spark, edges, empty):
    for docs in (edges, spark.read.parquet(f"{SF001}/documents.parquet")):
        rows = sharding.shard_by_bytes(docs).collect()
        texts = [(r["doc_id"], (r["text"] or "").encode()) for r in docs.select("doc_id", "text").collect()]
        assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in rows) == sorted(
            (str(d), len(t) + 1, zlib.crc32(t)) for d, t in texts)
        total, largest = sum(r["size"] for r in rows), max(r["size"] for r in rows)
        by = defaultdict(list)
        for r in rows:
            by[r["shard"]].append(r)
        for shard, held in by.items():
            assert 0 <= shard < 8 and sorted(r["slot"] for r in held) == list(range(len(held)))
            assert abs(sum(r["size"] for r in held) - total / 8) <= largest + 1
        order = sorted(rows, key=lambda r: (r["shard"], r["slot"]))
        ids = [-1 if r["doc_id"] is None else r["doc_id"] for r in order]
        assert ids == sorted(ids)           # contiguous in doc_id order
    assert sharding.shard_by_bytes(empty).count() == 0
