"""Packing by length patterns and non-negative least squares.

Documents become token sequences (a separator id after each); longer ones than ``capacity``
are cut into full pieces behind a first piece that takes the rest. What is packed is the
histogram of piece lengths, at most ``capacity`` numbers whatever the corpus: patterns of one
to three lengths that fill a sequence are enumerated, non-negative least squares fits how often
each is used so that the histogram is met, the counts are rounded down and fitted into what is
left, and the residual is packed best-fit, whole multiples at a time. The plan so is as large
for any corpus; pieces look up their place in it by their rank among pieces of their length,
which is counted in groups by hash of the id, so that a common length is no hot group.

Cases: a null text is an empty one: a piece with only the separator; null ids, repeated rows
and equal texts are documents of their own; a text of any length is tokenized whole; extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import array
import base64
import sys
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

CAPACITY = 2048
SEPARATOR = 0
GROUPS_PER_MILLION = 64
#: Patterns of three lengths are made for lengths on a grid of this many values.
TRIPLE_GRID = 96
ITERATIONS = 400
#: Patterns that leave more of a sequence empty than this are left to the best-fit.
MAX_WASTE = 0.01
#: Numbers of equal pieces are made in blocks of this many.
BLOCK = 10_000


def default_vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def encoder(json_path: str, ranks_path: str | None):
    """text -> list of ids, as the tokenizers library gives them.

    Where a file of the same vocabulary as ranks is given, texts of Latin letters without
    special strings go through the faster byte-pair library, whose ids are equal there (a
    test compares them); all other texts, and all texts without that file, go through
    tokenizers itself."""
    import os
    import re

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import tokenizers

    # Functions come here by value, so what a worker keeps between tasks hangs on a module.
    made = tokenizers.__dict__.setdefault("_made_encoders", {})
    key = (json_path, ranks_path)
    if key in made:
        return made[key]
    slow = tokenizers.Tokenizer.from_file(json_path)
    special = [t.content for t in slow.get_added_tokens_decoder().values()]
    if ranks_path is None:
        made[key] = lambda text: slow.encode(text, add_special_tokens=False).ids
        return made[key]
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    fast = tiktoken.Encoding("bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    odd = re.compile("[^\\x09-\\x0D\\x20-\\x7E\\u00A1-\\u024F]|" + "|".join(map(re.escape, special)))

    def encode(text: str) -> list[int]:
        if odd.search(text):
            return slow.encode(text, add_special_tokens=False).ids
        return fast(text)

    made[key] = encode
    return encode


def pieces(docs: DataFrame, capacity: int = CAPACITY, vocabulary: tuple[str, str | None] | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document."""
    paths = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(*paths)
        for b in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids = array.array("I", encode(text) if text else ())
                ids.append(SEPARATOR)
                if sys.byteorder == "big":
                    ids.byteswap()
                raw, n = memoryview(ids).cast("B"), len(ids)
                start, end, k = 0, n % capacity or min(n, capacity), 0
                while start < n:
                    row = (doc_id, k, start, end - start, zlib.crc32(raw[4 * start : 4 * end]))
                    for c, v in zip(out, row):
                        c.append(v)
                    start, end, k = end, end + capacity, k + 1
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(out, types)], ["doc_id", "piece", "start", "length", "ids_crc32"]
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def patterns(hist: np.ndarray, capacity: int) -> np.ndarray:
    """Rows of up to three lengths (0: none) whose sum is at most the capacity: every length
    with its exact complement, or the largest length present below it; and for lengths on a
    grid over those present, pairs completed by the best third length."""
    have = np.flatnonzero(hist)
    have = have[have > 0]
    if not len(have):
        return np.zeros((0, 3), int)
    below = np.zeros(capacity + 1, int)  # largest present length <= x, 0 if none
    below[have] = have
    np.maximum.accumulate(below, out=below)
    one = np.stack([have, below[capacity - have], np.zeros_like(have)], 1)
    grid = have if len(have) <= TRIPLE_GRID else have[np.unique(np.linspace(0, len(have) - 1, TRIPLE_GRID).astype(int))]
    # Each present length with each grid length, completed by the best third.
    a, b = (x.ravel() for x in np.meshgrid(have, grid, indexing="ij"))
    ok = a + b <= capacity
    a, b = a[ok], b[ok]
    two = np.stack([a, b, below[capacity - a - b]], 1)
    return np.unique(np.sort(np.concatenate([one, two]), 1), axis=0)


def nnls(pats: np.ndarray, hist: np.ndarray, capacity: int, rounds: int = ITERATIONS) -> np.ndarray:
    """Non-negative x that makes the patterns' length counts meet the histogram in the least
    squares sense, weighted towards long pieces and full sequences: accelerated projected
    gradient, on index arrays instead of a matrix."""
    n = len(hist)
    weight = np.sqrt(np.arange(n) / capacity)  # long pieces are the hard ones
    weight[0] = 0
    scale = max(hist.max(), 1)
    goal = hist / scale
    w2 = weight**2
    waste = (capacity - pats.sum(1)) / capacity  # a small price on unfilled room
    used = np.bincount(pats.ravel(), minlength=n).astype(float)
    lipschitz = 3 * max(float((w2 * used)[1:].max()), 1e-9)
    x = np.zeros(len(pats))
    y, t = x.copy(), 1.0
    for _ in range(rounds):
        got = sum(np.bincount(pats[:, k], weights=y, minlength=n) for k in range(3))
        grad = (w2 * (got - goal))[pats].sum(1) + 1e-3 * waste
        new = np.maximum(y - grad / lipschitz, 0)
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y = new + (t - 1) / t2 * (new - x)
        x, t = new, t2
    return x * scale


def make_plan(hist: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths, how often) so that every piece of the histogram is placed exactly once."""
    left = hist.astype(np.int64).copy()
    left[0] = 0
    out: list[tuple[tuple[int, ...], int]] = []

    def use(p: tuple[int, ...], times: int) -> None:
        if times > 0:
            out.append((p, int(times)))
            for v in p:
                left[v] -= times

    full = int(left[capacity])
    use((capacity,), full)
    pats = patterns(left, capacity)
    pats = pats[pats.sum(1) >= (1 - MAX_WASTE) * capacity]
    if len(pats):
        x = nnls(pats, left.astype(float), capacity)
        for i in np.argsort(pats.sum(1), kind="stable")[::-1]:  # the fullest first
            times = int(x[i] + 1e-6)
            if not times:
                continue
            p = tuple(int(v) for v in pats[i] if v)
            need = defaultdict(int)
            for v in p:
                need[v] += 1
            use(p, min([times, *(left[v] // c for v, c in need.items())]))
    # The residual: the longest piece first, then always the longest that still fits.
    while True:
        have = np.flatnonzero(left)
        if not len(have):
            break
        room, p, avail = capacity, [], left.copy()
        while True:
            fit = have[(have <= room) & (avail[have] > 0)]
            if not len(fit):
                break
            v = int(fit[-1])
            if room - v > 0 and len(p):
                # of two, better one that together with a third fills the room
                both = _best_pair(fit, avail, room)
                v = both if both else v
            p.append(v)
            avail[v] -= 1
            room -= v
        need = defaultdict(int)
        for v in p:
            need[v] += 1
        use(tuple(p), min(left[v] // c for v, c in need.items()))
    return out


def _best_pair(fit: np.ndarray, avail: np.ndarray, room: int) -> int:
    """The larger of the two lengths that together fill most of the room, 0 if one alone does."""
    below = np.searchsorted(fit, room - fit, side="right") - 1
    ok = below >= 0
    total = np.where(ok, fit + np.where(ok, fit[np.maximum(below, 0)], 0), fit)
    same = ok & (fit[np.maximum(below, 0)] == fit) & (avail[fit] < 2)
    total = np.where(same, fit, total)
    best = total.max()
    if fit[-1] == best:
        return 0
    return int(fit[np.flatnonzero(total == best)[-1]])


def lookup(plan: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: first ranks, first sequence ids and offsets of its runs of places."""
    runs: dict[int, list] = defaultdict(list)
    rank: dict[int, int] = defaultdict(int)
    seq = 0
    for p, times in plan:
        offset = 0
        for v in p:
            runs[v].append((rank[v], seq, offset))
            rank[v] += times
            offset += v
        seq += times
    return {v: tuple(np.array(c, np.int64) for c in zip(*r)) for v, r in runs.items()}


def pack(docs: DataFrame, capacity: int = CAPACITY, vocabulary: tuple[str, str | None] | None = None) -> DataFrame:
    """All pieces of all documents with their sequence and offset."""
    cut = common.materialize(pieces(docs, capacity, vocabulary), "pieces")
    counts = cut.groupBy("length").count().collect()  # at most ``capacity`` rows
    hist = np.zeros(capacity + 1, np.int64)
    for r in counts:
        hist[r["length"]] = r["count"]
    groups = max(8, int(hist.sum() * GROUPS_PER_MILLION // 1_000_000))
    places = lookup(make_plan(hist, capacity))
    # Ranks: the place of a group among the groups of a length, plus the place inside it. Equal
    # pieces of equal ids are one row with their number, so that they are no hot group.
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    cut = common.materialize(cut.groupBy(*key).agg(F.count("*").alias("m")), "pieces-alike")
    cut = cut.withColumn("g", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.lit(3)), F.lit(groups)))
    before = W.partitionBy("length").orderBy("g").rowsBetween(W.unboundedPreceding, -1)
    offsets = cut.groupBy("length", "g").agg(F.sum("m").alias("m")).select(
        F.col("length").alias("_l"), F.col("g").alias("_g"), F.coalesce(F.sum("m").over(before), F.lit(0)).alias("base"))
    inside = W.partitionBy("length", "g").orderBy("doc_id", "piece", "ids_crc32").rowsBetween(W.unboundedPreceding, -1)
    first = cut.withColumn("k", F.coalesce(F.sum("m").over(inside), F.lit(0))).join(
        offsets, (F.col("length") == F.col("_l")) & (F.col("g") == F.col("_g"))
    ).select(*key, "m", (F.col("base") + F.col("k")).cast("long").alias("first"))
    blocks = first.withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("m") - 1) / BLOCK))))
    low = F.col("b") * BLOCK
    ranks = F.sequence(F.col("first") + low, F.col("first") + F.least(low + BLOCK, "m") - 1)
    ranked = blocks.select(*key, F.explode(ranks).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = b.column(3).to_numpy(), b.column(5).to_numpy()
            seq, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            order = np.argsort(length, kind="stable")
            cuts = np.flatnonzero(np.diff(length[order])) + 1
            for at in np.split(order, cuts):
                if len(at):
                    first, ids, offs = places[int(length[at[0]])]
                    i = np.searchsorted(first, rank[at], side="right") - 1
                    seq[at], offset[at] = ids[i] + rank[at] - first[i], offs[i]
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:5], pa.array(seq), pa.array(offset)],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return ranked.mapInArrow(
        place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(common.table(spark, sf_dir, "documents").select("doc_id", "text"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the packed pieces of the mixed corpus."""
    return pack(docs.select("doc_id", "text"))
