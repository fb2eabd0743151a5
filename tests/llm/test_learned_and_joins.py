import random

import numpy as np
from llm_conftest import SF001, edges, empty, prose  # noqa: F401

import corpus_pipeline
from fabspark.llm import jaccard_join, language, resampling
from fabspark.llm import queries as Q


def test_codebook_is_apart():
    for n in (2, 3, 4, 7, 20):
        code = language.codebook(n).astype(int)
        assert len({tuple(r) for r in code}) == n
        if n >= 4:
            apart = (code.shape[1] - code @ code.T) // 2 + code.shape[1] * np.eye(n, dtype=int)
            assert apart.min() >= code.shape[1] // 4


def test_language_held_out_accuracy(spark, edges, empty):
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    rows = Q.QUERIES["op8_ecoc_language_id"](spark, SF001).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r["held_out"]]
    assert held and np.mean([r["lang"] == r["lang_pred"] for r in held]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in rows)
    got = {r["doc_id"]: r for r in language.predict(edges, language.learn(docs)).collect()}
    assert [got[i]["lang_pred"] for i in range(3)] == ["und"] * 3 and got[8]["lang_pred"] == "en"
    nothing = language.learn(empty)
    assert {r["lang_pred"] for r in language.predict(edges, nothing).collect()} == {"und"}
    assert language.predict(empty, nothing).count() == 0
    assert {r["lang_pred"] for r in language.predict(edges, language.learn(edges.where("doc_id = 5"))).collect()} == {"und", "en"}


def test_resampling_keeps_good_and_drops_junk(spark, edges, empty):
    rng = random.Random(0)
    junk = lambda i: " ".join(w + rng.choice(["$$$", "%%%"]) for w in prose(i, 80).split())
    rows = [(i, prose(i, 80) if i % 4 else junk(i)) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, bool(i % 4)) for i in range(0, 400, 2)], "doc_id bigint, good boolean")
    got = resampling.resample(docs, labels).collect()
    assert np.mean([r["kept"] == bool(r["doc_id"] % 4) for r in got]) > 0.98
    again = {r["doc_id"]: r["sample_key"] for r in resampling.resample(docs, labels).collect()}
    assert all(again[r["doc_id"]] == r["sample_key"] for r in got)            # the noise repeats
    kept = sorted((r["sample_key"] for r in got if r["kept"]))
    assert kept[0] >= max(r["sample_key"] for r in got if not r["kept"])      # a top k of the noisy weights
    assert resampling.resample(edges, labels).count() == edges.count()
    assert resampling.resample(edges, labels.limit(0)).where("kept").count() == edges.count()
    assert resampling.resample(empty, labels).count() == 0


def test_resampling_equals_plain_version(spark):
    """Weights from tokens found by a pattern and counted one by one; the cut and the top k by sorting."""
    import re
    from collections import Counter
    rng = random.Random(5)
    texts = [prose(i, 40) + rng.choice(["", " a$b %% C-3", "\tx\x0by\n\u00e9t\u00e9", " !!" * 9]) for i in range(90)] + [None, "", "  "]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    label = [(i, i % 3 > 0) for i in range(0, 90, 2)] + [(4, False)]            # id 4 is labelled twice
    labels = spark.createDataFrame(label, "doc_id bigint, good boolean")
    got = {r["doc_id"]: r for r in resampling.resample(docs, labels, keep_good=0.9).collect()}
    buckets, token = resampling.BUCKETS, re.compile(rb"[a-z0-9\x80-\xff]+|[^a-z0-9\x80-\xff\x20\x09-\x0d]+")

    def grams(text):
        raw = bytes(c + 32 if 65 <= c <= 90 else 32 if 9 <= c <= 13 else c for c in (text or "").encode())
        at = [m.span() for m in token.finditer(raw)]
        runs = [raw[a:b] for a, b in at] + [raw[a[0]:b[1]] for a, b in zip(at, at[1:])]
        return [int(resampling.ngram_hashes(r, np.array([0]), np.array([len(r)]), 1)[0] % np.uint64(buckets)) for r in runs]
    bags = {i: grams(t) for i, t in enumerate(texts)}
    good = {}
    for i, ok in label:
        good[i] = good.get(i, True) and ok
    held = [d for j, d in enumerate(sorted(good)) if j % 5 == 0]
    raw, target = Counter(), Counter()
    for i, bag in bags.items():
        raw.update(bag)
        if good.get(i) and i not in held:
            target.update(bag)
    rate = lambda c, b: np.log((c[b] + 0.1) / (sum(c.values()) + 0.1 * buckets))
    weight = {i: sum(rate(target, b) - rate(raw, b) for b in bag) for i, bag in bags.items()}
    for i, r in got.items():
        assert r["n_grams"] == len(bags[i]) and abs(r["log_weight"] - weight[i]) < 1e-4
    seen = sorted(got[d]["log_weight"] for d in held if good[d])
    k = sum(r["log_weight"] >= seen[int(0.1 * len(seen))] for r in got.values())
    best = sorted(got, key=lambda i: (-got[i]["sample_key"], i))[:k]
    assert 0 < k < len(texts) and {i for i in got if got[i]["kept"]} == set(best)
    few = resampling.resample(docs, labels, label_rows=10)                       # a bounded sample of the labels
    assert few.count() == len(texts)


def test_language_equals_plain_version(spark):
    """Counts, bits, weights and decoding of a small corpus, one n-gram at a time."""
    import math
    from collections import Counter
    rows = [(i, f"{w} {prose(i, 6) if lang == 'en' else w * 2}", lang) for i, (w, lang) in enumerate(
        [("the cat and", "en"), ("der hund und", "de"), ("le chat et", "fr"), ("el perro y", "es")] * 5)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    buckets = 1 << 10
    model = language.learn(docs, buckets=buckets)

    def grams(text):
        raw = b" " + b" ".join(bytes(c if c >= 128 or 97 <= c <= 122 else 32 for c in text.lower().encode()).split()) + b" "
        pair = [raw[j] * 257 + raw[j + 1] for j in range(len(raw) - 1)]
        triple = [(p * 263 + raw[j + 2] + 65536) % 2 ** 32 for j, p in enumerate(pair[:-1])]
        return [((g * 2654435761 % 2 ** 32) >> 8) % buckets for g in pair + triple]
    langs = ["de", "en", "es", "fr"]
    assert model.languages == langs
    counts = {a: Counter() for a in langs}
    for _, text, lang in rows:
        counts[lang].update(grams(text))
    smooth = 0.5 / (sum(sum(c.values()) for c in counts.values()) / 4)
    rate = {a: {b: n / sum(c.values()) for b, n in c.items()} for a, c in counts.items()}
    code, bits = model.code, model.code.shape[1]
    side = lambda b, bit, sign: [rate[a].get(b, 0.0) for a, c in zip(langs, code) if c[bit] == sign]
    odds = lambda b, bit: math.log(np.mean(side(b, bit, 1)) + smooth) - math.log(np.mean(side(b, bit, -1)) + smooth)

    def margins(text):
        g = grams(text)
        return [sum(odds(b, bit) for b in g) / len(g) for bit in range(bits)]
    hits = {(a, bit): [] for a in langs for bit in range(bits)}
    for _, text, lang in rows:
        for bit, m in enumerate(margins(text)):
            hits[lang, bit].append(code[langs.index(lang)][bit] * m > 0)
    acc = np.array([[(sum(hits[a, bit]) + 1) / (len(hits[a, bit]) + 2) for bit in range(bits)] for a in langs])
    acc /= acc.sum(axis=1, keepdims=True)
    for r in language.predict(docs.select("doc_id", "text"), model).collect():
        m = margins(rows[r["doc_id"]][1])
        loss = [sum(acc[i][bit] * math.log1p(math.exp(-12.0 * code[i][bit] * m[bit])) for bit in range(bits)) for i in range(4)]
        share = [math.exp(min(loss) - v) for v in loss]
        best = share.index(max(share))
        assert r["lang_pred"] == langs[best] and abs(r["score"] - share[best] / sum(share)) < 1e-4
        assert r["ambiguous"] == (share[best] / sum(share) < 0.6)


def brute_components(docs, n, percent):
    lower = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
    sets = []
    for _, text in docs:
        w = (text or "").encode().translate(lower).replace(b"\x0b", b" ").replace(b"\x0c", b" ").split()
        sets.append({tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    label = list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = sorted((label[i], label[j]))
                label = [a if x == b else x for x in label]
    names = [min(docs[j][0] for j in range(len(docs)) if label[j] == x) for x in label]
    return sorted((docs[i][0], len(sets[i]), names[i]) for i in range(len(docs)))


def near_copies(seed):
    """Sets of all small sizes and of larger ones, each with copies that lose or change some words."""
    r, docs = random.Random(seed), []
    for k in range(60):
        base = prose(1000 * seed + k, r.choice([1, 3, 5, 8, 9, 10, 14, 17, 20, 25, 40, 80, 200]))
        for _ in range(r.choice([1, 2, 4])):
            w = base.split()
            for _ in range(r.randrange(0, 1 + len(w) // 25 + 1)):
                w[r.randrange(len(w))] = r.choice(["zebra", "yak", "xenon"])
            docs.append((len(docs), " ".join(w[: len(w) - r.randrange(0, 2)]) if len(w) > 4 else base))
    return docs


def test_join_equals_brute_force(spark):
    for seed, (n, percent) in enumerate([(4, 85), (5, 80), (1, 60)]):
        docs = near_copies(seed) + [(9000, None), (9001, ""), (9002, " \n")]
        df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
        want = brute_components(docs, n, percent)
        for grams in (4_000_000, 300):               # 300: clusters are compared block against block
            got = jaccard_join.join_components(df, n, percent, cluster_grams=grams).collect()
            assert sorted(tuple(r) for r in got) == want


def test_join_of_texts_under_one_id(spark):
    """Several texts under one doc_id, and under null: each is compared by its own n-grams."""
    texts = [prose(500 + k, 60) for k in range(6)]
    near = [t + " zebra" for t in texts]
    docs = [(1, texts[0]), (1, texts[1]), (2, near[0]), (3, near[1]), (1, texts[1]),
            *[(None, t) for t in texts[2:] + near[4:]], (4, near[2]), (5, near[3]), (None, texts[2]), (None, "")]
    want = [(i, n, c) for i, n, c in brute_components([(99 if i is None else i, t) for i, t in docs], 4, 85)]
    none = lambda v: None if v == 99 else v
    want = sorted(((none(i), n, none(c)) for i, n, c in want), key=repr)
    for parts in (1, 5):
        df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(parts)
        for grams in (4_000_000, 60):
            got = jaccard_join.join_components(df, 4, 85, cluster_grams=grams).collect()
            assert sorted((tuple(r) for r in got), key=repr) == want
    # the chosen sets come once a node, whatever the copies
    sets = jaccard_join._candidate_sets(df, df, 4)
    assert sets.count() == sets.select("node").distinct().count() == len({t for _, t in docs if t})


def test_linked_sets_share_a_key():
    rng = np.random.default_rng(3)
    for percent in (60, 80, 85):
        for _ in range(1500):
            size = int(rng.integers(5, 400))
            a = np.unique(rng.integers(0, 2 ** 63, size=size, dtype=np.uint64))
            b = np.unique(np.concatenate([a[rng.random(size) > rng.random() * 0.25], rng.integers(0, 2 ** 63, size=int(rng.integers(0, 2 + size // 8)), dtype=np.uint64)]))
            inter = len(np.intersect1d(a, b))
            if 100 * inter >= percent * (len(a) + len(b) - inter):
                assert len(np.intersect1d(jaccard_join.keys_of(a, percent), jaccard_join.keys_of(b, percent)))


def test_large_sizes_use_common_schemes():
    for size in (4096, 5000, 20_000):
        for p in jaccard_join.partners(size, 85):
            k = jaccard_join.parts_for(h := size + p - 2 * jaccard_join.need(size, p, 85))
            for s in (size, p):
                assert dict(jaccard_join.schemes(s, 85))[k] >= h


def test_join_edges(spark, edges, empty):
    got = jaccard_join.join_components(edges).collect()
    assert len(got) == edges.count()
    by = {r["doc_id"]: r["component_id"] for r in got}
    assert by[6] == 5 and by[0] == 0 and by[1] == 1 and by[None] is None
    kept = jaccard_join.keep_one(edges)
    ids = [r["doc_id"] for r in kept.collect()]
    assert kept.columns == edges.columns and 6 not in ids and ids.count(5) == 1 and {0, 1, 2, None} <= set(ids)
    assert jaccard_join.join_components(empty).count() == 0 and jaccard_join.keep_one(empty).count() == 0


def test_pipeline_stages(spark, edges, empty):
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    for docs in (edges, empty, spark.read.parquet(f"{SF001}/documents.parquet")):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, SF001)
            assert out.columns == docs.columns
            if docs is edges or docs is empty:
                assert out.count() <= docs.count()
    rows = corpus_pipeline.run(spark, SF001).collect()
    assert rows and {"doc_id", "piece", "sequence_id", "offset", "length"} <= set(rows[0].asDict())
