"""Near-duplicates by order MinHash, verified by banded alignment.

1. Sketch. The k-mers of a text are its five-word shingles, each labelled with its occurrence
   number. A sample is the ELL labelled k-mers with the least values of one hash function, in
   text order; texts that share most of their words in the same order share samples. BANDS
   samples are taken, and for texts of few shingles SMALL_BANDS of two k-mers as well.
   Texts similar by words may share few shingles (a change at every ninth word leaves less than
   half) or none, so texts are sampled by word pairs as well, and short ones by words.
   A text that repeats shingles is sampled by its distinct ones in order of first occurrence
   too, so texts may differ in how often a passage is repeated.
2. Exact copies (the same words) become one class by a 128-bit hash before anything else, so a
   group of any number of copies is one row from there on.
3. Candidates are texts with an equal sample. A first round links each text of a bucket to the
   bucket's least text only: as many pairs as rows, however large the bucket. A second round
   takes the buckets whose texts then still lie in several classes: small ones pair across
   classes; the texts of larger ones meet by two prefix filters instead, one on distinct shingles and
   one on words with their occurrence: two texts whose shingles (or words) have similarity 0.8 share
   one of their rarest fifth. There, too, each token's texts are first linked to one of them, then
   paired across what classes are left. Of the pairs so met those are left out whose sets differ in
   more than similarity 0.8 allows, by a lower bound; so no similar pair is dropped, whether it is
   similar by shingles or by words alone.
4. Verification is exact: the words of both texts are aligned (longest common subsequence) inside
   the band that similarity 0.8 leaves room for, and the aligned ones must be at least 0.8 of the
   union: one changed word costs one word, wherever it stands. A text whose repeated words or
   shingles go beyond that is held against the other by its distinct shingles in order of first
   occurrence, too, and the better of the two counts.
5. Classes are the connected components of the verified links, by alternating stars with a
   table written each round; nothing of it reaches the driver but counts.

A text of fewer than five words is one shingle of all its words.

Cases: null and wordless texts have the same (empty) words and form one class; rows with null
or repeated ids are classified by their text; ``class_id`` is the least non-null id of the
class (null if it has none); extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

SHINGLE = 5
SIMILARITY = 0.8
ELL, BANDS = 3, 40
SMALL_ELL, SMALL_BANDS, SMALL_TEXT = 2, 20, 80
#: Texts up to this many words are sampled by words as well, those from SIMILARITY of it by word pairs.
SHORT_TEXT = 30
#: Buckets up to this many classes pair all of them; larger ones go through the prefix filters.
PAIR_BUCKET = 24
#: Longs of 64 bits that hold the parities of a text's tokens.
PARITIES = 4

_M = np.uint64(0xFF51AFD7ED558CCD)
_N = np.uint64(0xC4CEB9FE1A85EC53)
_S = np.uint64(33)
_MOST = np.uint64(2**64 - 1)


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> _S)
    x = x * _M
    x = x ^ (x >> _S)
    x = x * _N
    return x ^ (x >> _S)


_RNG = np.random.default_rng(7)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SEEDS = _RNG.integers(1, 2**63, 4 * (BANDS + SMALL_BANDS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _powers(n: int) -> np.ndarray:
    return np.concatenate([[np.uint64(1)], np.cumprod(np.full(max(n - 1, 0), _BASE, np.uint64))]).astype(np.uint64)[:n]


_POW = _powers(256)


def word_hashes(text: str | None) -> np.ndarray:
    """A 64-bit hash of each word, computed over all bytes at once."""
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    at = np.flatnonzero(~_SPACE[raw])
    if not len(at):
        return np.zeros(0, np.uint64)
    first = np.concatenate([[True], np.diff(at) > 1])
    starts = np.flatnonzero(first)
    place = np.arange(len(at)) - np.repeat(starts, np.diff(np.append(starts, len(at))))
    longest = int(place.max()) + 1
    power = _POW if longest <= len(_POW) else _powers(longest)
    return mix(np.add.reduceat(_BYTE[raw[at]] * power[place], starts))


def shingles(words: np.ndarray, k: int = SHINGLE) -> np.ndarray:
    """Hashes of all runs of k words; of all words where there are fewer."""
    n = len(words)
    if n == 0:
        return words
    k = min(k, n)
    out = np.zeros(n - k + 1, np.uint64)
    for i in range(k):
        out = out * _BASE + words[i : n - k + 1 + i]
    return mix(out)


def labelled(sh: np.ndarray) -> np.ndarray:
    """Shingle hashes with their occurrence number mixed in."""
    order = np.argsort(sh, kind="stable")
    s = sh[order]
    new = np.concatenate([[True], s[1:] != s[:-1]])
    if new.all():
        return mix(sh)
    index = np.arange(len(s))
    occurrence = np.empty(len(s), np.uint64)
    occurrence[order] = (index - np.maximum.accumulate(np.where(new, index, 0))).astype(np.uint64)
    return mix(sh + occurrence * _BASE)


def _samples(kmers: np.ndarray, ell: int, seeds: np.ndarray) -> np.ndarray:
    """One key a seed: the ``ell`` k-mers of least hash, in text order."""
    if len(kmers) <= ell:
        picked = np.broadcast_to(kmers, (len(seeds), len(kmers)))
    else:
        step = max(1, 2_000_000 // len(kmers))  # bounds the memory of a very long text
        parts = []
        for i in range(0, len(seeds), step):
            h = kmers[None, :] * seeds[i : i + step, None]
            h = (h ^ (h >> np.uint64(29))) * _M
            at = np.empty((len(h), ell), np.int64)
            for j in range(ell):  # faster than a partition
                at[:, j] = h.argmin(axis=1)
                h[np.arange(len(h)), at[:, j]] = _MOST
            parts.append(np.sort(at, axis=1))
        picked = kmers[np.concatenate(parts)]
    key = np.zeros(len(seeds), np.uint64)
    for i in range(picked.shape[1]):
        key = mix(key * _BASE + picked[:, i])
    return mix(key + seeds)


def _keys(kmers: np.ndarray, n: int) -> np.ndarray:
    """The sample keys of a text of n k-mers."""
    keys = _samples(kmers, ELL, _SEEDS[:BANDS])
    if n <= SMALL_TEXT:
        keys = np.concatenate([keys, _samples(kmers, SMALL_ELL, _SEEDS[BANDS : BANDS + SMALL_BANDS])])
    return keys


def _short_kmers(n: int) -> list[int]:
    """The lengths of the other k-mers that a text of n words is sampled by: of two texts that may be
    similar both have words, or both have word pairs."""
    return [1] * (n <= SHORT_TEXT) + [2] * (n >= SIMILARITY * SHORT_TEXT)


def node_of(words: np.ndarray) -> bytes:
    """128-bit hash of a word sequence."""
    n = len(words)
    a = b = np.uint64(n)
    if n:
        at = np.arange(1, n + 1, dtype=np.uint64)
        a = mix(words + at * _BASE).sum(dtype=np.uint64) + a
        b = mix((words ^ _N) * _M + at * _N).sum(dtype=np.uint64) + b
    return np.array([a, b], np.uint64).tobytes()


def sketch(text: str | None) -> tuple[bytes, int, int, np.ndarray]:
    """(hash of the words, number of distinct shingles, of words, sample keys) of a text."""
    words = word_hashes(text)
    sh = shingles(words)
    distinct = sh[np.sort(np.unique(sh, return_index=True)[1])]
    keys = np.zeros(0, np.uint64)
    if len(sh):
        keys = _keys(labelled(sh), len(sh))
        if len(distinct) < len(sh):  # else the two are the same
            keys = np.concatenate([keys, _keys(labelled(distinct), len(distinct))])
        # Texts similar by words may have few shingles in common, or none.
        for k in _short_kmers(len(words)):
            keys = np.concatenate([keys, _keys(labelled(shingles(words, k)), len(words))])
        keys = np.unique(keys)
    return node_of(words), len(distinct), len(words), keys


def _sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, h, node, n, w, keys): h is a hash of the text as it stands, node of its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [sketch(t) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.int32()),
                 pa.array([r[2] for r in rows], pa.int32()), pa.array([r[3].view(np.int64) for r in rows], pa.list_(pa.int64()))],
                ["doc_id", "h", "node", "n", "w", "keys"],
            )

    return docs.select(F.col("doc_id").cast("long"), _text_hash(), "text").mapInArrow(
        run, "doc_id long, h long, node binary, n int, w int, keys array<long>")


def _written(df: DataFrame, tag: str) -> DataFrame:
    """``df`` as a table in the shared folder, rid of the shuffles behind it."""
    out = common.materialize(df, tag)
    common.release(df.sparkSession)
    return out


def _text_hash():
    return F.xxhash64("text").alias("h")


class Profile:
    """What a comparison needs of a text, made once."""

    def __init__(self, text: str | None):
        self.words = word_hashes(text)
        sh = shingles(self.words)
        #: Distinct shingles sorted, and the rank of each by first occurrence.
        self.shingles, first = np.unique(sh, return_index=True)
        self.rank = np.empty(len(first), np.int64)
        self.rank[np.argsort(first, kind="stable")] = np.arange(len(first))
        #: Words labelled with their occurrence, sorted.
        self.labelled = np.sort(labelled(self.words)) if len(self.words) else self.words


profile = Profile


def _increasing(x: np.ndarray) -> int:
    """Length of the longest increasing subsequence."""
    if len(x) < 2 or (np.diff(x) > 0).all():
        return len(x)
    from bisect import bisect_left

    tails: list[int] = []
    for v in x.tolist():
        i = bisect_left(tails, v)
        if i == len(tails):
            tails.append(v)
        else:
            tails[i] = v
    return len(tails)


def _need(n1: int, n2: int, least: float) -> float:
    """How many of n1 and n2 must be aligned for ``least`` of the union."""
    return least / (1 + least) * (n1 + n2) - 1e-9


#: Texts up to this many words are aligned by bits (memory grows with the square: 25 MB here),
#: longer ones by rows of the band; both give the same number.
BIT_WORDS = 20_000


def common_words(a: np.ndarray, b: np.ndarray, band: int, need: float = 0) -> int:
    """Length of the longest common subsequence inside the band, or less than ``need``."""
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    head = int(differ[0]) if len(differ) else n
    differ = np.flatnonzero(a[::-1][: n - head] != b[::-1][: n - head])
    tail = int(differ[0]) if len(differ) else n - head
    a, b = a[head : len(a) - tail], b[head : len(b) - tail]
    if not len(a) or not len(b):
        return head + tail
    rest = _by_bits(a, b, band) if len(a) <= BIT_WORDS else _by_rows(a, b, band, need - head - tail)
    return head + tail + rest


def _by_bits(a: np.ndarray, b: np.ndarray, band: int) -> int:
    """Bit-parallel: a bit of ``v`` is 0 where the length of the best alignment steps up."""
    places: dict[int, int] = {}
    for i, w in enumerate(a.tolist()):
        places[w] = places.get(w, 0) | (1 << i)
    full = (1 << len(a)) - 1
    v, inside = full, band < max(len(a), len(b))
    for j, w in enumerate(b.tolist()):
        m = places.get(w, 0)
        if m and inside:
            low = max(0, j - band)
            m = m >> low << low & ((1 << (j + band + 1)) - 1)
        if m:
            u = v & m
            v = (v + u) | (v - u)
            v &= full
    return len(a) - v.bit_count()


def _by_rows(a: np.ndarray, b: np.ndarray, band: int, need: float) -> int:
    """Row by row of b; cells that left the band keep their value."""
    best = np.zeros(len(a) + 1, np.int32)
    for j in range(len(b)):
        low, high = max(0, j - band), min(len(a), j + band + 1)
        if low >= high:
            continue
        step = np.where(a[low:high] == b[j], best[low:high] + 1, best[low + 1 : high + 1])
        best[low + 1 : high + 1] = np.maximum.accumulate(np.maximum(step, best[low]))
        if best[high] + len(b) - 1 - j < need:
            return int(best[high])
    return int(best.max())


def _word_similarity(a: Profile, b: Profile, least: float) -> float:
    n1, n2 = len(a.words), len(b.words)
    if not n1 or not n2 or min(n1, n2) < least * max(n1, n2):
        return 0.0
    need = _need(n1, n2, least)
    if len(np.intersect1d(a.labelled, b.labelled, assume_unique=True)) < need:
        return 0.0
    m = common_words(a.words, b.words, int(n1 + n2 - 2 * need) + 1, need)
    return m / (n1 + n2 - m)


def _shingle_similarity(a: Profile, b: Profile, least: float) -> float:
    n1, n2 = len(a.shingles), len(b.shingles)
    if not n1 or not n2 or min(n1, n2) < least * max(n1, n2):
        return 0.0
    both, i, j = np.intersect1d(a.shingles, b.shingles, assume_unique=True, return_indices=True)
    need = _need(n1, n2, least)
    if len(both) < need:
        return 0.0
    x, y = a.rank[i], b.rank[j]
    inside = np.abs(x - y) <= int(n1 + n2 - 2 * need) + 1
    m = _increasing(y[inside][np.argsort(x[inside])])
    return m / (n1 + n2 - m)


def similarity(a: Profile, b: Profile, least: float = SIMILARITY) -> float:
    """Aligned words over the union, or aligned distinct shingles if that is more; 0 where both are
    below ``least``.

    With m aligned of n1 and n2, m >= least/(1+least) * (n1+n2) is asked for, so at most
    n1+n2-2m are unmatched and no aligned pair lies further off the diagonal."""
    s = _shingle_similarity(a, b, least)
    if s < least - 1e-12:
        s = max(s, _word_similarity(a, b, least))
    return s if s >= least - 1e-12 else 0.0


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes whose texts are similar. Every pair fetches two texts; the
    exchange of the texts is the same for both joins."""
    left = pairs.join(texts.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
    both = left.join(texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a").select("a", "b", "text_a", "text_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[bytes | None, Profile | None] = (None, None)
        for batch in batches:
            a, b, ok = batch.column(0).to_pylist(), batch.column(1).to_pylist(), []
            ta, tb = batch.column(2), batch.column(3)
            for k in range(len(a)):
                if last[0] != a[k]:
                    last = a[k], profile(ta[k].as_py())
                ok.append(similarity(last[1], profile(tb[k].as_py())) > 0)
            keep = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])

    return both.mapInArrow(run, "a binary, b binary")


def components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(node, root) of every node of the undirected edges (a, b), by alternating large and
    small stars (each round at least shortens the longest chain by a constant factor)."""
    edges = common.materialize(edges.filter("a <> b").distinct(), "edges")
    mark = None
    for _ in range(max_rounds):
        # Large star: neighbours above a node hang below its least neighbour.
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        # Small star: neighbours below a node hang below the least of them.
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        edges = common.materialize(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "stars")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).head()
        if mark == tuple(now):
            break
        mark = tuple(now)
    else:
        raise RuntimeError("components did not settle")
    tops = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return common.materialize(edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(tops), "roots")


def _lonely(tokens: DataFrame) -> DataFrame:
    """Nodes with too many shingles of their own for a partner of SIMILARITY: one row a token is
    aggregated, nothing is joined. Without them more shingles have one text only."""
    once = tokens.groupBy("token").agg(F.count("*").alias("df"), F.min(F.struct("node", "n")).alias("x")).filter("df = 1")
    alone = once.groupBy(F.col("x.node").alias("node"), F.col("x.n").alias("n")).agg(F.count("*").alias("alone"))
    return alone.filter(F.col("n") - F.col("alone") < F.ceil(F.col("n") * SIMILARITY - 1e-9)).select("node")


def _secluded(tokens: DataFrame) -> DataFrame:
    """Nodes with too many shingles that only their own class has for a partner of SIMILARITY in
    another class. The rows of those shingles alone are joined."""
    own = tokens.groupBy("token").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo = hi").select("token")
    alone = tokens.join(own, "token").groupBy("node", "n").agg(F.count("*").alias("alone"))
    return alone.filter(F.col("n") - F.col("alone") < F.ceil(F.col("n") * SIMILARITY - 1e-9)).select("node")


def _prefixes(members: DataFrame, texts: DataFrame, by: str = "shingles") -> DataFrame:
    """(node, root, n, alone, odd, at, token): the first tokens, in order of rarity, of each of
    ``members`` (node, root, n), as many as its partners in other classes must have one of.
    Tokens are a profile's ``shingles`` or ``labelled`` words, n is their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                values = getattr(profile(b.column(3)[k].as_py()), by).view(np.int64)
                same = [pa.array([b.column(c)[k].as_py()] * len(values), b.schema.field(c).type) for c in range(3)]
                yield pa.RecordBatch.from_arrays([*same, pa.array(values)], ["node", "root", "n", "token"])

    tokens = _written(
        members.join(texts, "node").select("node", "root", "n", "text").mapInArrow(run, "node binary, root binary, n int, token long"), "tokens")
    # The cheap rule first; with the texts gone that it finds, more shingles are of one class only.
    # Few texts have so many words of their own, which the places kept below show as well.
    for unfit in (_lonely, _secluded) if by == "shingles" else ():
        tokens = _written(tokens.join(unfit(tokens), "node", "left_anti"), "tokens")
    # Tokens of one class only come first in the order of rarity: no pair across classes has
    # them. How many a text has follows from its others, so they needn't be joined or sorted.
    each = W.partitionBy("token")
    counted = tokens.select("*", F.count("*").over(each).alias("df"), F.min("root").over(each).alias("lo"), F.max("root").over(each).alias("hi")).filter("lo <> hi")
    odd = [F.bit_xor(F.when(F.shiftright("token", 6).bitwiseAND(PARITIES - 1) == k, F.expr("shiftleft(1L, int(token & 63))")).otherwise(F.lit(0).cast("long")))
           .alias(f"p{k}") for k in range(PARITIES)]
    mine = counted.groupBy("node", "root", "n").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("t"), F.struct(*odd).alias("odd"))
    alone = F.col("n") - F.size("t")
    keep = (F.col("n") - F.ceil(F.col("n") * SIMILARITY - 1e-9) + 1 - alone).cast("int")
    mine = mine.withColumns({"alone": alone, "keep": keep}).filter("keep > 0")
    rare = mine.select("node", "root", "n", "alone", "odd", F.posexplode(F.slice("t", F.lit(1), F.col("keep"))).alias("at", "x"))
    rare = rare.select("node", "root", "n", "alone", "odd", (F.col("alone") + F.col("at")).alias("at"), F.col("x.token").alias("token"))
    return _written(rare, "prefixes")


def _room():
    """A first common shingle at these places leaves room for the overlap that SIMILARITY asks
    for: behind it lie all others that the two texts share."""
    need = SIMILARITY / (1 + SIMILARITY) * (F.col("na") + F.col("nb")) - 1e-9
    return F.least(F.col("na") - F.col("ia"), F.col("nb") - F.col("ib")) >= need


def _differ_little():
    """The two token sets differ in no more than SIMILARITY allows, as far as counts show: in each
    text's tokens of its own class alone, and in one token at least for each bit of parity that
    differs among the others."""
    bits = sum((F.bit_count(F.col(f"oa.p{k}").bitwiseXOR(F.col(f"ob.p{k}"))) for k in range(PARITIES)), F.col("la") + F.col("lb"))
    return bits <= (1 - 2 * SIMILARITY / (1 + SIMILARITY)) * (F.col("na") + F.col("nb")) + 1e-6


def _prefix_stars(rare: DataFrame) -> DataFrame:
    """The pairs of each token's texts with the one of them that has the least share of
    tokens of its own: at most one pair a row. In a family of near copies that text is close
    to most others, so that few of them are still in other classes afterwards."""
    centre = F.struct((F.col("alone") / F.col("n")).alias("share"), F.col("node").alias("b"), F.col("root").alias("rb"), F.col("n").alias("nb"), F.col("at").alias("ib"), F.col("alone").alias("lb"), F.col("odd").alias("ob"))
    centres = rare.groupBy("token").agg(F.count("*").alias("df"), F.min(centre).alias("x")).filter("df > 1").select("token", "x.*")
    a = rare.select("node", "root", "n", "at", "token", "alone", "odd").toDF("a", "ra", "na", "ia", "token", "la", "oa")
    apart = (F.col("ra") != F.col("rb")) & (F.least("na", "nb") >= SIMILARITY * F.greatest("na", "nb"))
    return a.join(centres, "token").filter(apart & _room() & _differ_little()).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _prefix_pairs(rare: DataFrame) -> DataFrame:
    """All pairs across classes with a common token in their prefixes that may be similar; every pair
    of SIMILARITY or more that isn't in one class is among them.

    Of each token's classes the largest is paired with the others only: two texts of one large
    class never meet, and a token of one class is left out."""
    more = ["alone", "odd"] if "odd" in rare.columns else []
    rare = rare.select("node", "root", "n", "at", "token", *more)
    each = W.partitionBy("token")
    rare = rare.select("*", F.min("root").over(each).alias("lo"), F.max("root").over(each).alias("hi")).filter("lo <> hi")
    rare = rare.withColumn("df", F.count("*").over(W.partitionBy("token", "root"))).withColumn("largest", F.max(F.struct("df", "root")).over(each)["root"])
    others = rare.filter("root <> largest").select("node", "root", "n", "at", "token", *more).toDF("a", "ra", "na", "ia", "token", *["la", "oa"][: len(more)])
    b = rare.select("node", "root", "n", "at", "token", "largest", *more).toDF("b", "rb", "nb", "ib", "token", "largest", *["lb", "ob"][: len(more)])
    apart = (F.col("ra") != F.col("rb")) & (F.least("na", "nb") >= SIMILARITY * F.greatest("na", "nb"))
    once = (F.col("rb") == F.col("largest")) | (F.col("a") < F.col("b"))
    near = _room() & _differ_little() if more else _room()
    return others.join(b, "token").filter(apart & once & near).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _pairable():
    alike = lambda a, b: F.least(a, b) >= SIMILARITY * F.greatest(a, b)
    return (F.col("a") < F.col("b")) & (F.col("ra") != F.col("rb")) & (alike("na", "nb") | alike("wa", "wb"))


def classify(docs: DataFrame) -> DataFrame:
    """(doc_id, h, node, root) of every row: node is the same for equal words, root the same
    for one class. ``docs`` needs doc_id and text."""
    docs = docs.select("doc_id", "text")
    made = common.materialize(_sketches(docs), "sketches")
    rows = made.select("doc_id", "h", "node").join(_roots(made, docs), "node", "left")
    return common.materialize(rows.withColumn("root", F.coalesce("root", "node")), "classified")


def _pick(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """One row of ``docs`` for each row of ``chosen`` (_key, _id, _h, _rows): the row with that
    id and text hash, of _rows equal ones. Adds a last column, the key."""
    key, i, h, n = common.fresh(docs.columns, "_key", "_id", "_h", "_rows")
    chosen = chosen.toDF(key, i, h, n)
    hit = docs.join(chosen, F.col("doc_id").eqNullSafe(F.col(i)) & (F.xxhash64("text") == F.col(h))).select(*docs.columns, key, n)
    return hit.filter(F.col(n) == 1).unionByName(hit.filter(F.col(n) > 1).dropDuplicates([key])).drop(n)


def _choice(rows: DataFrame, key: str) -> DataFrame:
    """For each key its row with the least id (null last) and hash, and how many such rows."""
    order = F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "h", "_rows")
    each = rows.groupBy(key, "doc_id", "h").agg(F.count("*").alias("_rows"))
    return each.groupBy(key).agg(F.min(order).alias("x")).select(
        F.col(key).alias("_key"), F.col("x.doc_id").alias("_id"), F.col("x.h").alias("_h"), F.col("x._rows").alias("_rows"))


def _buckets(nodes: DataFrame) -> DataFrame:
    """(node, n, w, key, members, least) of each key of two nodes or more. The keys are the most rows
    of all steps; by a window they are exchanged once, a join with their counts would exchange them twice."""
    each = W.partitionBy("key")
    spread = nodes.select("node", "n", "w", F.explode("keys").alias("key"))
    return spread.select("*", F.count("*").over(each).alias("members"), F.min("node").over(each).alias("least")).filter("members > 1")


def _roots(made: DataFrame, docs: DataFrame) -> DataFrame:
    """(node, root) of the nodes that have a similar other node."""
    # One row a node: equal nodes have equal sketches.
    nodes = made.groupBy("node").agg(F.first("n").alias("n"), F.first("w").alias("w"), F.first("keys").alias("keys"))
    shared = _written(_buckets(nodes), "buckets")
    # Texts are fetched for the nodes that share a bucket only.
    wanted = made.select("node", "doc_id", "h").join(shared.select("node").distinct(), "node", "left_semi")
    texts = _written(_pick(docs, _choice(wanted, "node")).select(F.col("_key").alias("node"), "text"), "texts")
    first = common.materialize(
        shared.filter("node <> least").select(F.col("least").alias("a"), F.col("node").alias("b")).distinct(), "stars0")
    links = _written(_verified(first, texts), "links")
    roots = components(links)
    # Second round: buckets that still hold several classes.
    state = common.materialize(_rooted(shared, roots).select("key", "node", "n", "w", "root", "members"), "state")
    mixed = state.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("key")
    mixed = common.materialize(state.join(mixed, "key"), "mixed")
    seen, found = first, links
    many = mixed.filter(F.col("members") > PAIR_BUCKET).select("node", "root", "n", "w").distinct()
    rares = []
    if many.head(1):
        rares = [_prefixes(many.select("node", "root", "n"), texts),
                 _prefixes(many.select("node", "root", F.col("w").alias("n")), texts, "labelled")]
        # Stars first: classes that they join need no pairs across.
        stars = _prefix_stars(rares[0]).unionByName(_prefix_stars(rares[1])).distinct()
        stars = common.materialize(stars.join(seen, ["a", "b"], "left_anti"), "stars1")
        near = _written(_verified(stars, texts), "links")
        seen = seen.unionByName(stars)
        if near.head(1):
            found = found.unionByName(near)
            roots = components(found)
            mixed, rares = _rooted(mixed.drop("root"), roots), [_rooted(r.drop("root"), roots) for r in rares]
    few = mixed.filter(F.col("members") <= PAIR_BUCKET).select("key", "node", "root", "n", "w")
    a, b = few.toDF("key", "a", "ra", "na", "wa"), few.toDF("key", "b", "rb", "nb", "wb")
    pairs = a.join(b, "key").filter(_pairable()).select("a", "b").distinct()
    for rare in rares:
        pairs = pairs.unionByName(_prefix_pairs(rare))
    pairs = pairs.distinct()
    # Pairs that failed needn't be looked at again.
    pairs = _written(pairs.join(seen, ["a", "b"], "left_anti"), "pairs")
    if not pairs.head(1):
        return roots
    more = _written(_verified(pairs, texts), "links")
    return components(found.unionByName(more)) if more.head(1) else roots


def _rooted(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """``rows`` (node, ...) with the root of each node, itself where it has none."""
    return rows.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def classes(docs: DataFrame) -> DataFrame:
    """(doc_id, class_id, class_size): class_id is the least id of the class."""
    rows = classify(docs)
    per = rows.groupBy("root").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size"))
    return rows.join(per, "root").select("doc_id", "class_id", "class_size")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(common.table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each class the row with the least id stays (null ids last; of equal
    rows one)."""
    names = docs.columns
    return _pick(docs, _choice(classify(docs), "root")).select(*names)
