import random
import struct
import zlib

import numpy as np
import pytest

from sparkwell.llm import packing

public_tokenizers = pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string, length int"


def reference(text):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return t.encode(text, add_special_tokens=False).ids if text else []


TEXTS = [None, "", "a", "Hello  world\n\n it's fine ", "naïve café — “quotes” 你好 \U0001f600", "<|endoftext|> mid <|endoftext|>", "tab\tand\x0bvt 123456 don't", "ẞ ẞ ͸"]


def test_fast_ids_equal_tokenizers():
    encode = packing.encoder(*packing.default_vocabulary())
    rng = random.Random(1)
    more = ["".join(rng.choice("abcé ß\n\t.,'12  |$") for _ in range(300)) for _ in range(60)]
    for t in TEXTS[2:] + more:
        assert encode(t) == reference(t)


def test_pieces_and_places(spark):
    rng = random.Random(2)
    rows = [(i, t, 1) for i, t in enumerate(TEXTS)] + [(100 + i, " ".join(rng.choice(["the", "cat", "xyz"]) for _ in range(rng.randrange(1, 300))), 1) for i in range(120)]
    rows += [(500, "word " * 9000, 1), (None, "null id", 1), (700, "again", 1), (700, "again", 1), (600, "w" * 60_000, 1)]
    out = packing.pack(spark.createDataFrame(rows, SCHEMA)).collect()
    ids = {i: [*reference(t), 0] for i, t, _ in rows}
    seqs, seen = {}, {}
    for r in out:
        piece = ids[r.doc_id][r.start : r.start + r.length]
        assert len(piece) == r.length and r.ids_crc32 == zlib.crc32(struct.pack(f"<{len(piece)}I", *piece))
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
        seen.setdefault(r.doc_id, []).append((r.piece, r.start, r.length))
    for places in seqs.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 2048
    for i, parts in seen.items():
        if i == 700:
            continue
        parts.sort()
        assert [p for p, *_ in parts] == list(range(len(parts))) and sum(n for *_, n in parts) == len(ids[i])
        assert all(n == 2048 for _, _, n in parts[1:]) and [s for _, s, _ in parts] == list(np.cumsum([0] + [n for *_, n in parts[:-1]]))
    assert len(seen[700]) == 2 and len(out) == sum(-(-len(ids[i]) // 2048) for i, *_ in rows)


def test_plan_places_all_and_is_tight():
    rng = np.random.default_rng(1)
    for hist in (np.bincount(np.clip(rng.lognormal(6, 0.9, 20_000).astype(int), 1, 2048), minlength=2049), np.bincount([2048] * 3 + [1] * 5000 + [1025] * 40, minlength=2049), np.zeros(2049, int)):
        plan = packing.make_plan(hist, 2048)
        got = np.zeros(2049, int)
        for p, n in plan:
            assert sum(p) <= 2048
            np.add.at(got, list(p), n)
        assert (got == hist).all()
    big = np.bincount(np.clip(rng.lognormal(6, 0.9, 20_000).astype(int), 1, 2048), minlength=2049)
    used = sum(n for _, n in packing.make_plan(big, 2048))
    assert used <= 1.01 * (big * np.arange(2049)).sum() / 2048 + 1


def test_empty(spark):
    assert packing.pack(spark.createDataFrame([], SCHEMA)).count() == 0


def test_short_pieces_fill_their_sequences():
    rng = np.random.default_rng(3)
    for hist in (np.bincount([100] * 100_000, minlength=2049), np.bincount(np.clip(rng.lognormal(4.5, 0.6, 60_000).astype(int), 1, 300), minlength=2049)):
        plan = packing.make_plan(hist, 2048)
        got = np.zeros(2049, int)
        for p, n in plan:
            np.add.at(got, list(p), n)
        whole = 2048 // np.flatnonzero(hist)[0] * np.flatnonzero(hist)[0] if np.count_nonzero(hist) == 1 else 2048
        assert (got == hist).all() and sum(n for _, n in plan) <= 1.005 * (hist * np.arange(2049)).sum() / whole + 2


def test_hot_repeated_rows_and_clashing_names(spark):
    df = spark.createDataFrame([(None, "same text")] * 3000 + [(i, "word " * (i % 5)) for i in range(50)], "doc_id long, text string")
    for c in ("length", "m", "g", "k", "b", "rank", "first", "_l", "_g", "count", "piece"):
        df = df.withColumn(c, packing.F.lit(1))
    out = packing.pack(df).collect()
    places = {(r.sequence_id, r.offset) for r in out}
    assert len(out) == 3050 == len(places)
