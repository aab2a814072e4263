import random
import re
import time
from collections import Counter

import numpy as np

from sparkwell.llm import near_dedup as nd

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lcs(x, y):
    row = [0] * (len(y) + 1)
    for a in x:
        new = [0]
        for j, b in enumerate(y):
            new.append(row[j] + 1 if a == b else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def alike(a, b):
    """Words or first occurrences of shingles, aligned, are 0.8 of their union."""
    def first(w):
        return list(dict.fromkeys(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))))

    x, y = WORD.findall(a), WORD.findall(b)
    for p, q in ((x, y), (first(x), first(y))):
        if len(set(p) & set(q)) and min(len(p), len(q)) >= 0.8 * max(len(p), len(q)):
            both = sum((Counter(p) & Counter(q)).values())
            if both >= 0.8 * (len(p) + len(q) - both):
                m = lcs(p, q)
                if m >= 0.8 * (len(p) + len(q) - m) - 1e-9:
                    return True
    return False


def corpus(seed=1):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(3000)]
    passage = [rng.choice(vocab) for _ in range(60)]
    docs = []
    for _ in range(40):
        docs.append([rng.choice(vocab) for _ in range(rng.choice([8, 30, 120, 400]))])
    for _ in range(60):  # all share one passage and little else
        docs.append(passage + [rng.choice(vocab) for _ in range(rng.choice([20, 40, 80]))])
    for d in list(docs[:40]):
        for k in (1, 2, 5, max(1, len(d) // 20)):
            e = list(d)
            for _ in range(k):
                e[rng.randrange(len(e))] = rng.choice(vocab)
            docs.append(e)
    base = [rng.choice(vocab) for _ in range(200)]
    for _ in range(70):  # one large family of near copies
        e = list(base)
        for _ in range(3):
            e[rng.randrange(len(e))] = rng.choice(vocab)
        docs.append(e)
    return [" ".join(d) for d in docs]


def classes(spark, texts):
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], SCHEMA)
    return {r.doc_id: r.class_id for r in nd.classes(df).collect()}


def union(texts):
    up = list(range(len(texts)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if alike(texts[i], texts[j]):
                a, b = top(i), top(j)
                up[max(a, b)] = min(a, b)
    return {i: top(i) for i in range(len(texts))}


def test_same_classes_as_brute_force(spark):
    texts = corpus()
    assert classes(spark, texts) == union(texts)


def test_large_mixed_buckets_use_the_prefix_filter(spark, monkeypatch):
    monkeypatch.setattr(nd, "PAIR_BUCKET", 2)
    texts = corpus(2)
    assert classes(spark, texts) == union(texts)


def test_edge_cases(spark):
    long = " ".join(f"v{i}" for i in range(30_000))
    rows = [(1, None), (2, ""), (3, " \n"), (4, "a b c"), (5, "a  b\nc"), (None, "a b c"), (6, "a b d"), (7, long), (8, long + " tail"), (9, "x y z q r s"), (9, "x y z q r s"), (9, "other words here now ok then")]
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], SCHEMA).withColumnRenamed("lang", "root")
    got = nd.classes(df).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, set()).add((r.class_id, r.class_size))
    assert by[1] == by[2] == by[3] == {(1, 3)} and by[4] == by[5] == by[None] == {(4, 3)} and by[6] == {(6, 1)}
    assert by[7] == by[8] == {(7, 2)} and by[9] == {(9, 2), (9, 1)}


def test_stage_keeps_one_of_each(spark):
    rows = [(1, "a b c d e f"), (2, "a b c d e f"), (2, "a b c d e f"), (None, "n n n"), (None, "n n n"), (5, None), (6, ""), (7, "only one"), (7, "only two")]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA)
    out = nd.stage(spark, df, "")
    assert out.columns == df.columns
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == sorted([(1, "a b c d e f"), (None, "n n n"), (5, None), (7, "only one"), (7, "only two")], key=str)


def test_empty_table(spark):
    assert nd.classes(spark.createDataFrame([], SCHEMA)).count() == 0


def test_alignment_is_order_sensitive():
    a, b = [f"a{i}" for i in range(100)], [f"b{i}" for i in range(100)]
    same, swapped = nd.profile(" ".join(a + b)), nd.profile(" ".join(b + a))
    assert nd.similarity(same, same) == 1.0 and nd.similarity(same, swapped) == 0.0
    assert nd.similarity(nd.profile(""), nd.profile("")) == 0.0


def test_components_of_chains_and_stars(spark):
    edges = [(bytes([i]), bytes([i + 1])) for i in range(30)] + [(bytes([100]), bytes([k])) for k in range(101, 120)]
    got = {r.node: r.root for r in nd.components(spark.createDataFrame(edges, "a binary, b binary")).collect()}
    assert {bytes(got[bytes([i])]) for i in range(31)} == {bytes([0])} and {bytes(got[bytes([k])]) for k in range(100, 120)} == {bytes([100])}


def test_word_hash_sees_whole_words():
    assert len(np.unique(nd.word_hashes("ab ba a b abab baba " + "q" * 5000 + " " + "q" * 5001))) == 8


def test_repeated_passages_as_brute_force(spark):
    rng = random.Random(4)
    texts = []
    for _ in range(12):
        def words(n):
            return [f"w{rng.randrange(10**6)}" for _ in range(n)]

        body, line, small = words(300), words(10), words(104)
        texts += [body, body * 2, body * 3, body + line * 40, body + line * 100, small + line[:8] * 20, small + line[:8] * 60]
    texts = [" ".join(t) for t in texts]
    assert classes(spark, texts) == union(texts)


def test_samples_of_repeats_are_those_of_the_distinct_shingles():
    a = [f"a{i}" for i in range(300)]
    assert len(set(nd.sketch(" ".join(a))[3]) & set(nd.sketch(" ".join(a * 3))[3])) > 20


def test_alignments_agree_with_a_plain_one():
    rng = random.Random(3)
    for _ in range(120):
        n = rng.randrange(1, 60)
        x = [rng.randrange(12) for _ in range(n)]
        y = [w if rng.random() > 0.1 else rng.randrange(12) for w in x if rng.random() > 0.1] or [1]
        a, b = np.array(x, np.uint64), np.array(y, np.uint64)
        want = lcs(x, y)
        assert nd._by_bits(a, b, 99) == nd._by_rows(a, b, 99, 0) == nd.common_words(a, b, 99) == want
        assert nd._by_bits(a, b, 3) == nd._by_rows(a, b, 3, 0) <= want


def test_planted_edits_are_found(spark):
    """Copies with 1 to 5 of a hundred words changed, dropped or added, by edit similarity."""
    rng = random.Random(12)
    vocab = [f"w{i}" for i in range(4000)]
    texts, pairs = [], []
    for share in (0.01, 0.03, 0.05):
        for n in (40, 120, 250, 600):
            for _ in range(8):
                base = [rng.choice(vocab) for _ in range(n)]
                edited = []
                for w in base:
                    x = rng.random() / share
                    edited += [rng.choice(vocab)] if x < 0.5 else [] if x < 0.75 else [w, rng.choice(vocab)] if x < 1 else [w]
                pairs.append((len(texts), len(texts) + 1))
                texts += [" ".join(base), " ".join(edited)]
    got = classes(spark, texts)
    want = [(a, b) for a, b in pairs if alike(texts[a], texts[b])]
    assert len(want) >= 0.95 * len(pairs)
    assert sum(got[a] == got[b] for a, b in want) >= 0.98 * len(want)
    assert len(set(got.values())) >= len(pairs)  # nothing else is joined


def test_clashing_names(spark):
    names = "_id _h _rows _key node root n w h key keys token at alone members least".split()
    df = spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f"), (None, None)], "doc_id long, text string")
    for c in names:
        df = df.withColumn(c, nd.F.lit(c))
    out = nd.stage(spark, df, "")
    assert out.columns == df.columns and out.count() == 2 and out.filter("_id = '_id' and _rows = '_rows'").count() == 2


def test_prefix_pairs_meet_across_classes_only(spark):
    rng = random.Random(4)
    rows = []
    for node in range(120):
        root = 0 if node < 80 else rng.randrange(4) + 1
        n = rng.choice([10, 11, 14])
        rows += [(bytes([node]), bytes([root]), n, 0, at, t) for at, t in enumerate(rng.sample(range(12), 3))]
    rare = spark.createDataFrame(rows, "node binary, root binary, n int, alone int, at int, token long")
    want = set()
    for a in rows:
        for b in rows:
            if a[0] < b[0] and a[1] != b[1] and a[5] == b[5] and min(a[2], b[2]) >= 0.8 * max(a[2], b[2]):
                if min(a[2] - a[4], b[2] - b[4]) >= 0.8 / 1.8 * (a[2] + b[2]) - 1e-9:
                    want.add((a[0], b[0]))
    got = [(bytes(r.a), bytes(r.b)) for r in nd._prefix_pairs(rare).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 100


def passage_pairs():
    """Thirty pairs in one large bucket: a passage of all texts, then words of which every fifth
    differs inside the pair. Each pair is similar by words, not by shingles."""
    rng = random.Random(8)
    passage = [f"p{i}" for i in range(140)]
    texts = []
    for k in range(30):
        tail = [f"t{k}_{rng.randrange(10**6)}" for _ in range(60)]
        texts += [passage + tail, passage + [f"e{k}_{i}" if i % 5 == 2 else w for i, w in enumerate(tail)]]
    return [" ".join(t) for t in texts]


def test_large_buckets_lose_no_pair_similar_by_words(spark):
    texts = passage_pairs()
    want = union(texts)
    assert len(set(want.values())) == 30
    assert classes(spark, texts) == want


def test_stage_keeps_one_of_each_pair_similar_by_words(spark):
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(passage_pairs())]
    out = nd.stage(spark, spark.createDataFrame(rows, SCHEMA), "")
    assert sorted(r.doc_id for r in out.collect()) == list(range(0, 60, 2))


def spread_edits():
    """Pairs of texts with a change at every ninth word, or one word more in five: similar by words
    to just 0.8, with few common shingles or none."""
    rng = random.Random(9)
    texts = []
    for n in (4, 9, 18, 27, 45, 90, 270):
        for _ in range(12):
            words = [f"w{rng.randrange(10**6)}" for _ in range(n)]
            edited = [f"e{rng.randrange(10**6)}" if i % 9 == 4 else w for i, w in enumerate(words)]
            texts += [words, words[:2] + ["more"] + words[2:] if n == 4 else edited]
    return [" ".join(t) for t in texts]


def test_pairs_similar_by_words_share_a_sample(spark):
    texts = spread_edits()
    assert all(alike(a, b) for a, b in zip(texts[::2], texts[1::2], strict=True))
    assert classes(spark, texts) == {i: i - i % 2 for i in range(len(texts))}


def test_stage_keeps_one_of_each_pair_with_spread_edits(spark):
    texts = spread_edits()
    out = nd.stage(spark, spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], SCHEMA), "")
    assert sorted(r.doc_id for r in out.collect()) == list(range(0, len(texts), 2))


def test_samples_are_as_by_partition():
    rng = np.random.default_rng(6)
    for n in (1, 3, 4, 50, 70_000):
        kmers = rng.integers(0, 2**63, n, dtype=np.uint64)
        for ell in (2, 3):
            if n <= ell:
                continue
            seeds = nd._SEEDS[:50]
            h = kmers[None, :] * seeds[:, None]
            h = (h ^ (h >> np.uint64(29))) * nd._M
            picked = kmers[np.sort(np.argpartition(h, ell - 1, axis=1)[:, :ell], axis=1)]
            key = np.zeros(len(seeds), np.uint64)
            for i in range(ell):
                key = nd.mix(key * nd._BASE + picked[:, i])
            assert (nd._samples(kmers, ell, seeds) == nd.mix(key + seeds)).all()


def test_keys_are_exchanged_once(spark):
    """Each exchange of the keys is the operator's largest use of disk."""
    rows = [(bytes([i]), 1, 1, [i, i // 2 + 100, 999]) for i in range(40)]
    made = nd._buckets(spark.createDataFrame(rows, "node binary, n int, w int, keys array<long>"))
    assert made._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(key") == 1
    got = {(bytes(r.node), r.key, r.members, bytes(r.least)) for r in made.collect()}
    assert got == {(bytes([i]), i // 2 + 100, 2, bytes([i // 2 * 2])) for i in range(40)} | {(bytes([i]), 999, 40, bytes([0])) for i in range(40)}


def test_shuffles_are_deleted_with_their_step(spark):
    def shuffles():
        return spark._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker().shuffleStatuses().size()

    for k in range(5):
        nd._written(spark.range(1000).groupBy((nd.F.col("id") % 7).alias("k")).count(), "counts")
    for _ in range(20):  # deleted in the background
        if shuffles() <= 2:
            break
        time.sleep(0.1)
    assert shuffles() <= 2  # the last step's may be late
