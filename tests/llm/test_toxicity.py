import zlib

from sparkwell.llm import toxicity as tx

DOCS, LABELS = "doc_id long, text string, score double", "doc_id long, quality int, toxic int"


def data(spark, n=400):
    docs = [(i, f"plain words number n{i} of a calm text." + (f" what {chr(97 + i // 5 % 25)}{chr(97 + i // 125)} zork you {chr(97 + i // 5 % 25)}u{chr(97 + i // 125)} blarg." if i % 5 == 0 else ""), 9.0) for i in range(n)]
    labels = [(i, 1, int(i % 5 == 0)) for i in range(n)]
    return spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)


def test_learns_words_and_separates_held_out(spark):
    docs, labels = data(spark)
    got = {r.doc_id: r.score for r in tx.judge(docs, labels).collect()}
    held = [i for i in got if zlib.crc32(str(i).encode()) % 3 == 1]
    assert held and all((got[i] >= 0.7) == (i % 5 == 0) for i in held)


def test_held_out_labels_are_never_read(spark):
    docs, labels = data(spark)
    flipped = labels.withColumn("toxic", tx.F.when(tx.held_out(), 1 - tx.F.col("toxic")).otherwise(tx.F.col("toxic")))
    a, b = tx.train(docs, labels), tx.train(docs, flipped)
    assert a[0] == b[0] and (a[1] == b[1]).all()


def test_edge_cases(spark):
    docs = spark.createDataFrame([(1, None, 1.0), (1, None, 1.0), (None, "x", 1.0), (3, "", 1.0), (4, "idiot " * 50_000, 1.0)], DOCS)
    none = spark.createDataFrame([(None, None, None), (7, 1, None)], LABELS)
    rows = tx.judge(docs, none).collect()
    assert len(rows) == 5 and all(0 <= r.score <= 1 for r in rows)
    assert [r.score >= 0.7 for r in rows] == [False] * 4 + [True]
    assert tx.judge(docs.limit(0), none).count() == 0


def test_grammar_scores_clauses():
    g = tx.Grammar({"fool": 3.0})
    m = g.matches
    assert m("a fool")["insult"] == 3.0
    assert m("you are a fool")["targeted"] == 3.0
    assert m("not a fool")["negated"] == 3.0
    assert m("they never went. a fool")["insult"] == 3.0  # the clause ended
    assert m("it was said a fool")["reported"] == 3.0
    assert m("kill you")["threat"] > 0 and m("kill time")["threat"] == 0
    assert m("a fool you are") == dict.fromkeys(tx.KINDS, 0.0) | {"insult": 3.0, "targeted": 3.0}
    assert m("she said he would kill you")["reported threat"] > 0 and m("never kill him")["negated threat"] > 0
    assert m("he said so. kill him")["threat"] > 0
    assert sum(m("calm words").values()) == sum(m(None).values()) == 0


def test_fit_settles_on_separable_and_skewed_data():
    import numpy as np

    rng = np.random.default_rng(1)
    for n, share, size in ((50, 0.1, 1.5), (5_000, 0.1, 4.0), (20_000, 0.5, 8.0), (20_000, 0.01, 0.5)):
        y = (rng.random(n) < share).astype(float)
        y[:2] = 0, 1
        x = np.zeros((n, len(tx.KINDS)))
        x[y == 1, 0] = size + rng.random(int(y.sum()))
        x[y == 1, 2] = rng.random(int(y.sum()))
        w = tx.fit_weights(x, y)
        p = 1 / (1 + np.exp(-(w[0] + x @ w[1:])))
        assert np.isfinite(w).all() and p[y == 1].min() > p[y == 0].max()


def test_chance_words_of_near_copies_stay_out_of_the_lexicon(spark):
    import random

    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(3))
    toxic = [f"{word()} {word()} zork {word()} {word()}" for _ in range(120)]
    toxic += [f"the quib went zork home {word()} {word()}" for _ in range(60)]
    clean = [" ".join(word() for _ in range(8)) for _ in range(400)]
    rows = [(t, 1) for t in toxic] + [(t, 0) for t in clean]
    docs = spark.createDataFrame([(i, t, 0.0) for i, (t, _) in enumerate(rows)], DOCS)
    labels = spark.createDataFrame([(i, 1, y) for i, (_, y) in enumerate(rows)], LABELS)
    lexicon, _ = tx.train(docs, labels)
    assert "zork" in lexicon and "quib" not in lexicon


def test_product_reads_like_its_machines_side_by_side():
    import random

    rng = random.Random(8)
    parts = [tx.within("N"), tx.within("T", 2), tx.seen("R"), tx.meets("V", "T")]
    both = tx.compose(*parts)
    for _ in range(200):
        text = "".join(rng.choice(tx.CLASSES) for _ in range(30))
        assert both.read(text) == list(zip(*(m.read(text) for m in parts)))

    def plain(text):  # a target within three words behind a threat verb, the first of them
        out = []
        for i, c in enumerate(text):
            back = text[max(0, i - 3) : i]
            back = back[max(back.rfind("."), back.rfind("T")) + 1 :]
            out.append(c == "T" and "V" in back)
        return out

    for _ in range(200):
        text = "".join(rng.choice(tx.CLASSES) for _ in range(30))
        assert tx.meets("V", "T").read(text) == plain(text)


def test_clauses_change_the_verdict(spark, monkeypatch):
    rows, labels = [], []
    for i in range(600):
        toxic = i % 2
        w = f"q{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}{'uvwxyz'[i // 100]}"
        text = f"you are {w} zork {w[::-1]} today." if toxic else f"she said you are {w} zork {w[::-1]}."
        rows.append((i, text, 0.0))
        labels.append((i, 1, toxic))
    plain = [(1000 + i, f"calm day w{i} of w{i + 1}", 0.0) for i in range(600)]
    docs = spark.createDataFrame(rows + plain, DOCS)
    known = spark.createDataFrame(labels + [(i, 1, 0) for i, *_ in plain], LABELS)
    monkeypatch.setattr(tx, "MIN_LOG_ODDS", 0.5)
    got = {r.doc_id: r.score for r in tx.judge(docs, known).collect()}
    assert all((got[i] >= 0.7) == bool(i % 2) for i in range(600))
