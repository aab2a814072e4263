import os
import random
import re
from collections import Counter

import pytest

from sparkwell.llm import quality

W = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, extra string, kept string"


def brute(text):
    ws = W.findall(text or "")
    win = Counter(tuple(ws[i : i + 8]) for i in range(len(ws) - 7))
    hit = set()
    for i in range(len(ws) - 7):
        if win[tuple(ws[i : i + 8])] > 1:
            hit |= set(range(i, i + 8))
    lines = [x for x in (text or "").split("\n") if W.search(x)]
    base = len(ws) < 20 or 100 * len(hit) > 30 * len(ws)
    return len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit), base


def texts():
    rng = random.Random(5)
    words = ["the", "of", "alpha", "beta", "gamma", "délta", "x|", "#y", "z.", "q\x0bq"]
    out = [None, "", "   \n\t ", "one", " lead and trail \n", "a\r\nb\r\nb", "  nbsp em"]
    for n in (7, 8, 9, 19, 20, 21, 60, 300):
        out.append(" ".join(rng.choice(words) for _ in range(n)))
        s = " ".join(rng.choice(words) for _ in range(n))
        out.append(s + "\n" + s + "\n\n" + s)
    out.append("same line here\n" * 50)
    out.append("w " * 3000)
    return out


def test_counts_match_brute_force(spark):
    rows = [(i, t, "e", "clash") for i, t in enumerate(texts())]
    rows += [(None, "null id", None, None), (3, "one", "e", "clash")]
    got = quality.score(spark.createDataFrame(rows, SCHEMA)).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    want = Counter((i, *brute(t)) for i, t, *_ in rows)
    assert Counter((r.doc_id, *(r[c] for c in names)) for r in got) == want
    assert all(not r.kept for r in got if r.base_failed)


def test_em_finds_the_bad_class():
    hist = [((1, 1, 1), 800), ((-1, 1, -1), 60), ((-1, 0, -1), 20), ((1, 0, 1), 100), ((1, -1, 1), 5)]
    m = quality.fit(hist)

    def odds(v):
        return m["bias"] + sum(y if x > 0 else n if x < 0 else 0 for x, y, n in zip(v, m["yes"], m["no"]))

    assert odds((1, 1, 1)) > 0 > odds((-1, 1, -1))
    assert quality.fit([])["prior"] > 0.5


def test_empty_table(spark):
    assert quality.score(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_verdict_agrees_with_labels_at_every_size(spark, sf):
    data = f"/root/testdata/{sf}"
    if not os.path.isdir(data):
        pytest.skip("no test tables")
    read = lambda n: spark.read.parquet(f"{data}/{n}.parquet")
    got = quality.score(read("documents")).filter("not base_failed").join(read("labels").filter("quality is not null"), "doc_id")
    n = {(r.quality, r.kept): r["count"] for r in got.groupBy("quality", "kept").count().collect()}
    bad, good = (n.get((q, False), 0) + n.get((q, True), 0) for q in (0, 1))
    assert n.get((0, False), 0) >= 0.9 * bad and n.get((1, False), 0) <= 0.01 * good


def test_rare_junk_is_the_bad_class_at_any_size():
    clean, noisy = (1,) * 9, (-1, 1, 1, 1, 1, 1, 1, -1, 1)
    for n in (100, 200, 2_000, 200_000):
        m = quality.fit([(clean, n), (noisy, n // 10)])
        odds = lambda v: m["bias"] + sum(y if x > 0 else z for x, y, z in zip(v, m["yes"], m["no"]))
        assert odds(clean) > 0 > odds(noisy)
