import math
import random
from fractions import Fraction
from itertools import combinations, permutations

import numpy as np
import pytest
import xxhash
from llm_conftest import SF001, edges, empty, prose  # noqa: F401
from pyspark.sql import functions as F

import corpus_pipeline
from fabspark.llm import decontaminate, exact_eigen, filter_audit, hot_join, language, licenses, simhash, whitening
from fabspark.llm import queries as Q
from fabspark.llm.components import components


def brute_fingerprint(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = "".join(" " if c in "\t\n\v\f\r" else c for c in lower).split(" ")
    words = [w for w in words if w]
    if not words:
        return 0
    runs = [" ".join(words[i:i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64(r.encode(), seed=42).intdigest() for r in runs]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes))


def brute_components(fps, ids, bits=4):
    label = list(range(len(fps)))
    for i, j in combinations(range(len(fps)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= bits and label[i] != label[j]:
            lo, hi = sorted((label[i], label[j]))
            label = [lo if x == hi else x for x in label]
    least = {}
    for x, i in zip(label, ids):
        least[x] = min((v for v in (least.get(x), i) if v is not None), default=None)
    return [least[x] for x in label]


def near_texts():
    """Copies, near copies at many distances, short texts whose fingerprints hold few bits."""
    rng, out = random.Random(5), []
    for k in range(12):
        words = prose(100 + k, 150).split()
        for _ in range(8):
            w = list(words)
            for _ in range(rng.randrange(6)):
                w[rng.randrange(len(w))] = rng.choice(["Xu", "yo", "zed"])
            out.append(" ".join(w))
    return out + ["a", "A", "b c", "b  C", "", None]


def test_spark_hash_is_the_digest(spark):
    row = spark.sql("SELECT xxhash64('the ship sails over') AS h").first()
    assert row["h"] % (1 << 64) == xxhash.xxh64_intdigest(b"the ship sails over", 42)


@pytest.mark.parametrize("bucket", [simhash.BUCKET, 3])
def test_simhash_equals_brute_force(spark, bucket):
    texts = near_texts()
    ids = [7 * i % 1009 for i in range(len(texts))]
    got = {r["doc_id"]: r for r in simhash.near_duplicates(
        spark.createDataFrame(list(zip(ids, texts)), "doc_id bigint, text string"), bucket=bucket).collect()}
    fps = [brute_fingerprint(t) for t in texts]
    assert [int(got[i]["fingerprint"], 16) for i in ids] == fps
    assert all(len(r["fingerprint"]) == 16 and r["fingerprint"] == r["fingerprint"].lower() for r in got.values())
    assert [got[i]["component_id"] for i in ids] == brute_components(fps, ids)


@pytest.mark.parametrize("bits, bucket", [(4, 4), (4, 10_000), (2, 5), (6, 40)])
def test_links_of_dense_and_scattered_fingerprints(spark, bits, bucket):
    rng = random.Random(bits * bucket)
    fps = [rng.getrandbits(64) for _ in range(120)]
    centre = rng.getrandbits(64)                    # a ball with many members, chains of steps out of it
    for _ in range(150):
        fps.append(centre ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 6))))
    for f in fps[:40]:
        fps.append(f ^ sum(1 << b for b in rng.sample(range(64), rng.choice([bits, bits + 1]))))
    fps = sorted(set(fps))
    signed = np.array(fps, dtype=np.uint64).view(np.int64).tolist()
    nodes = spark.createDataFrame([(f,) for f in signed], "fp bigint").repartition(5)
    root = {r["node"]: r["root"] for r in components(simhash.links(nodes, bits, bucket)).collect()}
    want = brute_components(fps, signed, bits)
    assert [root.get(f, f) for f in signed] == want


def test_simhash_defined_cases(spark, edges, empty):  # noqa: F811
    rows = simhash.near_duplicates(edges).collect()
    assert len(rows) == edges.count()
    zero = [r for r in rows if r["doc_id"] in (0, 1, 2)]
    assert {(r["fingerprint"], r["component_id"]) for r in zero} == {("0" * 16, 0)}
    assert {r["component_id"] for r in rows if r["doc_id"] in (5, 6)} == {5}
    long = edges.where("doc_id = 8").first()["text"]
    assert {r["fingerprint"] for r in rows if r["doc_id"] == 8} == {f"{brute_fingerprint(long):016x}"}
    assert [r["component_id"] for r in rows if r["doc_id"] is None] == [None]
    assert simhash.near_duplicates(empty).collect() == []


def test_op11_whole_table(spark):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF001}/documents.parquet").collect()]
    got = {r["doc_id"]: r for r in Q.QUERIES["op11_simhash_neardup"](spark, SF001).collect()}
    fps, ids = [brute_fingerprint(t) for _, t in docs], [i for i, _ in docs]
    assert [int(got[i]["fingerprint"], 16) for i in ids] == fps
    assert [got[i]["component_id"] for i in ids] == brute_components(fps, ids)


def test_components_with_hubs(spark):
    rng = random.Random(1)
    pairs = [(0, i) for i in range(1, 400)] + [(1000, i) for i in range(1001, 1300)] + [(399, 1001)]
    pairs += [(rng.randrange(2000, 2100), rng.randrange(2000, 2100)) for _ in range(60)] + [(5, 5), (7, 0)]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x
    for a, b in pairs:
        lo, hi = sorted((root(a), root(b)))
        up[hi] = lo
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    assert got == {x: root(x) for a, b in pairs if a != b for x in (a, b)}


def test_attach_keeps_hot_null_and_cold_rows(spark):
    rows = spark.createDataFrame([(1, i) for i in range(300)] + [(None, 1), (2, 5), (9, 6)], "k bigint, v bigint")
    table = spark.createDataFrame([(1, "a"), (2, "b")], "k bigint, t string")
    counts = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    hot = hot_join.hot_keys(counts, "k", "n")
    assert [r["k"] for r in hot.collect()] == [1]
    assert hot_join.attach(rows, table, "k", hot).groupBy("t").count().collect().__len__() == 2
    left = hot_join.attach(rows, table, "k", hot, "left")
    assert {(r["t"], r["count"]) for r in left.groupBy("t").count().collect()} == {("a", 300), ("b", 1), (None, 2)}


def brute_audit(docs, labels):
    seen, firsts = [], {}
    for i, _, t in docs:
        if i is not None:
            firsts[t or ""] = min(i, firsts.get(t or "", i))
    for i, part, t in docs:
        t = t or ""
        w = [x for x in "".join(" " if c in "\t\n\v\f\r" else c for c in t).split(" ") if x]
        mask = [len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * sum("A" <= c <= "Z" for c in t) > 3 * len(t),
                any(c in "#$%&*|" for c in t), i is not None and i > firsts[t]]
        said = [x for x in labels if x[0] == i and i is not None]
        seen.append((part or "", mask, any(x[1] == 1 for x in said), any(x[2] == 1 for x in said)))
    out = {}
    for part in {s[0] for s in seen}:
        mine = [s for s in seen if s[0] == part]
        total = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = list(mine)
            for step, f in enumerate(order, 1):
                k = "ABCDE".index(f)
                gone = [s for s in left if s[1][k]]
                left = [s for s in left if not s[1][k]]
                total[f] += len(gone)
                out[part, "".join(order), step] = [
                    len(left), len(gone), sum(s[1][k] for s in mine) - len(gone),
                    sum(s[1][k] and sum(s[1]) == 1 for s in mine), sum(s[2] for s in gone), sum(s[3] for s in gone)]
        for order in permutations("ABCDE"):
            for step, f in enumerate(order, 1):
                out[part, "".join(order), step].append(total[f])
    return out


def as_rows(df):
    return {(r["part"], r["filter_order"], r["step"]): [r[c] for c in (
        "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")] for r in df.collect()}


def test_audit_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(filter_audit, "RANGE_ROWS", 37)
    rng = random.Random(2)
    docs = []
    for i in range(160):
        text = rng.choice([prose(i, 250), prose(i, 30), " ".join(["one"] * 260), prose(i, 230).upper(), prose(3, 220), "£ # " + prose(i, 210),
                           None, "", "Ünï中 ABC", prose(4, 205) + " & X"])
        docs.append((rng.choice([i, i, i, 5, None]), rng.choice(["en", "de", None, ""]), text))
    labels = [(rng.choice([rng.randrange(160), 5, None]), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(90)]
    got = filter_audit.audit(spark.createDataFrame(docs, "doc_id bigint, lang string, text string").repartition(3),
                             spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"))
    assert as_rows(got) == brute_audit(docs, labels)


def test_audit_defined_cases(spark, edges, empty):  # noqa: F811
    labels = spark.createDataFrame([(5, 1, None)], "doc_id bigint, quality int, toxic int")
    rows = [(r["doc_id"], r["lang"], r["text"]) for r in edges.collect()]
    assert as_rows(filter_audit.audit(edges, labels)) == brute_audit(rows, [(5, 1, None)])
    assert filter_audit.audit(empty, labels).collect() == []
    assert filter_audit.audit(edges, labels.limit(0)).where("good_lost > 0").count() == 0


def test_merges():
    rng = np.random.default_rng(0)
    for _ in range(50):
        a, b = (np.unique(rng.integers(0, 60, rng.integers(0, 40))) for _ in range(2))
        assert filter_audit.union(a, b).tolist() == sorted({*a.tolist(), *b.tolist()})
        assert filter_audit.minus(a, b).tolist() == sorted({*a.tolist()} - {*b.tolist()})


def brute_whitening(rows, most=32):
    """By numpy's own eigensolver, from exact sums."""
    kept = [(i, v) for i, v in rows if v is not None and all(e is not None and math.isfinite(e) for e in v)]
    x = np.array([[math.floor(64 * float(e)) + 1000000 for e in v] for _, v in kept], dtype=object)
    n, total = len(x), x.sum(axis=0)
    off = x * n - total
    cov = (off.T @ off).astype(float) / n ** 3
    value, vector = np.linalg.eigh(cov)
    value, vector = value[::-1][:most], vector[:, ::-1][:, :most]
    return kept, n, [int(s) for s in (off ** 2).sum(axis=1)], value / np.trace(cov), (off / n).astype(float) @ vector / np.sqrt(value)


def test_op12_equals_numpy(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF001}/embeddings.parquet").collect()]
    kept, n, deviation, explained, white = brute_whitening(rows)
    got = {(r["vec_id"], r["component"]): r for r in Q.QUERIES["op12_embedding_whitening"](spark, SF001).collect()}
    assert len(got) == 32 * len(kept)
    assert {r["n"] for r in got.values()} == {n}
    errors = {r["identity_error"] for r in got.values()}
    assert len(errors) == 1 and errors.pop() < 1e-9
    mine = np.array([[got[i, c]["whitened"] for c in range(1, 33)] for i, _ in kept])
    for c in range(32):
        sign = np.sign((mine[:, c] * white[:, c]).sum())
        assert np.allclose(mine[:, c] * sign, white[:, c], atol=1e-6)
    assert [got[i, 1]["deviation"] for i, _ in kept] == deviation
    assert np.allclose([got[kept[0][0], c]["explained"] for c in range(1, 33)], explained, rtol=1e-9)
    assert np.abs(mine.T @ mine / n - np.eye(32)).max() < 1e-9


def test_whitening_defined_cases(spark):
    schema = "label int, vec_id bigint, embedding array<float>, w string, component string"
    odd = [(0, None, [1.5, 2.0, 0.25], "w", "c"), (0, 1, None, None, None), (0, 2, [1.0, None, 2.0], None, None), (0, 3, [float("nan"), 1.0, 1.0], None, None),
           (0, 4, [1.0, float("-inf"), 1.0], None, None), (0, 5, [-3.5, 1.0, 0.25], None, None), (0, 5, [-3.5, 1.0, 0.25], None, None), (0, 6, [0.0, 7.0, 0.25], None, None)]
    got = whitening.whiten(spark.createDataFrame(odd, schema)).collect()
    assert len(got) == 4 * 2 and {r["component"] for r in got} == {1, 2}         # the third dimension is constant
    assert {r["n"] for r in got} == {4} and got[0]["identity_error"] < 1e-12
    assert sum(r["explained"] for r in got if r["vec_id"] == 6) == pytest.approx(1)
    frame = lambda rows: spark.createDataFrame([(0, i, v, "", "") for i, v in rows], schema)
    for rows in ([], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, None)], [(1, []), (2, [])]):
        assert whitening.whiten(frame(rows)).collect() == []
    # equal eigenvalues: a cross in three dimensions
    axes = [(i, [s * 2.0 * (i == j) for j in range(3)]) for i in range(3) for s in (1, -1)]
    got = whitening.whiten(frame(axes)).collect()
    assert len(got) == 18 and got[0]["identity_error"] < 1e-12 and all(r["explained"] == pytest.approx(1 / 3) for r in got)
    with pytest.raises(Exception, match="entries"):
        whitening.whiten(frame([(1, [1.0, 2.0]), (2, [1.0])]))


def test_whitening_of_large_entries_is_exact(spark):
    rng = random.Random(3)
    rows = [(i, [rng.uniform(-1, 1) * 10.0 ** rng.randrange(12) for _ in range(4)]) for i in range(50)]
    fit = whitening.Scatter(whitening.finite_rows(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), "vec_id", "embedding"))
    x = np.array([[math.floor(64 * e) for e in v] for _, v in rows], dtype=object)
    assert fit.n == 50 and fit.matrix == (50 * (x.T @ x) - np.outer(x.sum(axis=0), x.sum(axis=0))).tolist()
    top = whitening.whiten(spark.createDataFrame([(1, [3e300, 0.0]), (2, [-3e300, 1.0]), (3, [0.0, 2.0])], "vec_id bigint, embedding array<double>"))
    assert top.count() == 6 and top.where("whitened IS NULL OR isnan(whitened)").count() == 0


def test_polynomial_and_roots_are_exact():
    rng = np.random.default_rng(4)
    a = rng.integers(-9, 9, (5, 3))
    m = (a @ a.T).tolist()                                                # rank 3: root zero is double
    moduli = exact_eigen.primes_for(m)
    poly = exact_eigen.remainder(exact_eigen.polynomials(m, moduli).tolist(), moduli)
    assert np.allclose(poly, np.poly(np.array(m, dtype=float)), rtol=1e-9, atol=1e-3) and poly[4:] == [0, 0]
    assert exact_eigen.roots_above(poly, 0, 0) == 3
    for i, (at, e, inside) in enumerate(exact_eigen.isolate(poly, int(np.trace(m)), 5)):
        root = Fraction(exact_eigen.refine(poly, at, e, inside, 200), 1 << 200)
        assert float(root) == pytest.approx(np.linalg.eigvalsh(m)[::-1][i])
    # two roots 2 apart near 2^60: vectors that doubles cannot tell apart
    big = [[1 << 60, 1, 0], [1, 1 << 60, 0], [0, 0, (1 << 60) - 3]]
    moduli = exact_eigen.primes_for(big)
    poly = exact_eigen.remainder(exact_eigen.polynomials(big, moduli).tolist(), moduli)
    bits = exact_eigen.fraction_bits(3 << 60)
    roots = [exact_eigen.refine(poly, *p, bits) for p in exact_eigen.isolate(poly, 3 << 60, 3)]
    assert [round(Fraction(r, 1 << bits)) - (1 << 60) for r in roots] == [1, -1, -3]
    assert np.allclose(np.abs(exact_eigen.null_vectors(big, roots[0], bits, 1)), [[0.5 ** 0.5, 0.5 ** 0.5, 0]], atol=1e-15)


def test_numerals_are_no_letters(spark):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    odd = spark.createDataFrame([(1, "½ ² ① 12"), (2, "_ 3"), (3, "é")], "doc_id bigint, text string")
    got = {r["doc_id"]: r["lang_pred"] for r in language.predict(odd, language.learn(docs)).collect()}
    assert got[1] == got[2] == "und" and got[3] != "und"


def test_expressions_are_judged(spark):
    tag = "x\n# SPDX-License-Identifier: "
    docs = [(1, tag + "MIT OR GPL-2.0"), (2, tag + "MIT AND GPL-2.0"), (3, "mit license"), (4, None), (5, tag + "MIT" + tag + "GPL-3.0"),
            (6, tag + "(Apache-2.0 WITH e OR GPL-2.0) AND ISC")]
    frame = spark.createDataFrame(docs, "doc_id bigint, text string")
    verdict = lambda **k: {r["doc_id"]: r["permitted"] for r in licenses.scan_licenses(frame, **k).collect()}
    assert verdict() == {1: True, 2: False, 3: None, 4: None, 5: False, 6: True}
    assert verdict(allowed=["GPL-2.0", "MIT"]) == {1: True, 2: True, 3: None, 4: None, 5: False, 6: False}


def test_pipeline_stages_keep_clashing_columns_and_differing_rows(spark):
    long = prose(1, 200)
    rows = [(1, long, "en", "a", 5, "KEEPME", "r"), (1, long, "de", "a", 5, "KEEPME", "r"), (2, long, "en", "a", 5, "x", "r"), (1, long, "en", "a", 5, "KEEPME", "r"),
            (3, "token = abcdefghijkl99", "en", "b", 5, "y", "r")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, _before string, root string")
    kept = corpus_pipeline.near_duplicates(spark, docs, SF001)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"], r["lang"]) for r in kept.collect()) == [(1, "de"), (1, "en"), (3, "en")]
    clean = corpus_pipeline.secret_scan(spark, docs, SF001)
    assert clean.columns == docs.columns
    got = {(r["doc_id"], r["lang"]): r for r in clean.collect()}
    assert got[1, "en"]["_before"] == "KEEPME" and got[1, "de"]["n_chars"] == 5
    assert "abcdefghijkl99" not in got[3, "en"]["text"] and got[3, "en"]["n_chars"] == len(got[3, "en"]["text"])


def test_repeated_benchmark_rows_count_once(spark):
    text = prose(11, 40)
    docs = spark.createDataFrame([(1, "so " + text)], "doc_id bigint, text string")
    items = spark.createDataFrame([("a", text)] * 50 + [("b", prose(12, 40))], "item_id string, text string")
    got = decontaminate.find_leaks(docs, items, max_item_bytes=2 * len(text)).first()
    assert got["n_hit"] == 40 and got["items"] == ["a"]
