"""Toxicity by a weighted finite-state pattern grammar.

A text becomes a string over word classes: insult (I), threat verb (V), target (T), negation
(N), reported speech (R), clause end (.) and any other word (o). Five small transducers, each
built on its own, read it: whether a negation still reaches, whether a target stood near, whether
the clause reports someone's words, whether a threat verb meets its target, and whether an insult
does. ``compose`` makes their product, one transition table whose outputs are matched clauses by
kind: bare, targeted, negated or reported insult, and threats bare, negated or reported. Every
match carries the weight of its word. The document's score is a logistic function of the summed
weights of each kind, so an isolated word counts only as its clause lets it.

The insult words and their weights, and the weight of each kind, are learned from labelled rows:
at most ``MAX_LABELLED`` of them (a sample by hash of the id; all rows below that number); the
other classes are closed ones, listed below. Everything else reads all documents. Built-in insults
join the learned ones where no labelled text has them.

Cases: null and empty texts get the score of a text without matches; null ids are scored
(they carry no label) with ``held_out`` false; repeated rows give repeated results; several
labels of one id count as toxic if any says so, null labels are ignored; without labels of
both classes the built-in words and weights are used; extra columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

MAX_LABELLED = 20_000
MIN_LOG_ODDS = 2.5
MIN_SUPPORT = 3
MIN_PLACES = 0.5  # distinct pairs of neighbours for each toxic text with the word
THRESHOLD = 0.7
REACH = 3  # words over which a negation or a target reaches

SEED_INSULTS = {w: 3.0 for w in "idiot moron stupid loser scum worthless pathetic dumb".split()}
#: Closed word classes in English, German, French and Spanish.
THREATS = frozenset((
    "kill hurt destroy beat stab shoot murder strangle hang burn crush smash punch choke slaughter bury drown poison "
    "töten umbringen schlagen erschießen erstechen vernichten verprügeln verbrennen "
    "tuer frapper détruire étrangler poignarder abattre brûler écraser "
    "matar golpear destruir apuñalar disparar estrangular quemar aplastar").split())
TARGETS = frozenset((
    "you your yours yourself he him his she her they them their theirs us everyone these those people guys "
    "du dich dir dein deine ihr euch ihn ihm sie ihnen eure tu te toi ton ta tes vous votre vos lui leur eux elle "
    "tú ti usted ustedes vosotros él ella ellos ellas le les su sus tus").split())
NEGATIONS = frozenset((
    "not never no isn't aren't wasn't weren't don't doesn't didn't won't wouldn't can't cannot without nobody none neither nor "
    "nicht kein keine keinen keiner nie niemals ohne ne pas jamais aucun aucune sans ni nunca jamás sin ningún ninguna").split())
REPORTS = frozenset((
    "said says say saying claimed claims wrote writes called calls quoted quotes reported reports told tells according alleged stated "
    "sagte sagt sagen schrieb schreibt nannte zitierte laut dit disait écrit affirme selon cité appelé "
    "dijo dice decía escribió llamó según citó afirmó").split())

KINDS = ("insult", "targeted", "negated", "reported", "threat", "negated threat", "reported threat")
CLASSES = "IVTNRo."
TOKEN = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?|[.!?;\n]")


class Transducer:
    """States with, for every class, the next state and an output."""

    def __init__(self, start, step: Callable):
        self.start, self.table, todo = start, {}, [start]
        while todo:
            state = todo.pop()
            for c in CLASSES:
                if (state, c) not in self.table:
                    self.table[state, c] = step(state, c)
                    todo.append(self.table[state, c][0])

    def read(self, classes: str) -> list:
        state, out = self.start, []
        for c in classes:
            state, x = self.table[state, c]
            out.append(x)
        return out


def within(cls: str, reach: int = REACH) -> Transducer:
    """Outputs whether one of ``cls`` stood at most ``reach`` words before, in the clause."""
    return Transducer(0, lambda s, c: (0 if c == "." else reach if c == cls else max(s - 1, 0), s > 0))


def seen(cls: str) -> Transducer:
    """Outputs whether one of ``cls`` stood before in the clause."""
    return Transducer(False, lambda s, c: (c != "." and (s or c == cls), s))


def meets(first: str, second: str, reach: int = REACH) -> Transducer:
    """Outputs true at the first of ``second`` within ``reach`` words behind one of ``first``."""
    return Transducer(0, lambda s, c: (0 if c == "." or c == second else reach if c == first else max(s - 1, 0), c == second and s > 0))


def compose(*machines: Transducer) -> Transducer:
    """The product: all machines read the same classes, its output is the tuple of theirs."""

    def step(states: tuple, c: str) -> tuple:
        moves = [m.table[s, c] for m, s in zip(machines, states)]
        return tuple(s for s, _ in moves), tuple(x for _, x in moves)

    return Transducer(tuple(m.start for m in machines), step)


def relabel(machine: Transducer, f: Callable) -> Transducer:
    """The same machine with outputs f(class, output)."""
    return Transducer(machine.start, lambda s, c: (machine.table[s, c][0], f(c, machine.table[s, c][1])))


def _kind(c: str, out: tuple) -> str | None:
    negated, near, reported, threat, late = out
    if c == "I":
        return "reported" if reported else "negated" if negated else "targeted" if near else "insult"
    if threat:
        return "reported threat" if reported else "negated threat" if negated else "threat"
    return "targeted" if late and not (reported or negated) else None


#: Negation, target before, report, threat meets target, insult meets target behind it.
CLAUSES = relabel(compose(within("N", 2 * REACH), within("T"), seen("R"), meets("V", "T"), meets("I", "T")), _kind)
THREAT_WEIGHT = 3.0


class Grammar:
    """The composed machine with its word weights."""

    def __init__(self, insults: dict[str, float]):
        self.insults = insults
        self.classes = {w: "R" for w in REPORTS} | {w: "N" for w in NEGATIONS} | {w: "T" for w in TARGETS}
        self.classes |= {w: "V" for w in THREATS} | {w: "I" for w in insults}
        self.classes |= {x: "." for x in ".!?;\n"}
        self.emitting = frozenset(insults) | THREATS

    def matches(self, text: str | None) -> dict[str, float]:
        """Summed weights of the matched clauses, by kind."""
        out = dict.fromkeys(KINDS, 0.0)
        tokens = TOKEN.findall(text.lower()) if text else ()
        if self.emitting.isdisjoint(tokens):
            return out
        state, table, get, last = CLAUSES.start, CLAUSES.table, self.classes.get, 0.0
        for tok in tokens:
            c = get(tok, "o")
            if c == "I":
                last = self.insults[tok]
            state, kind = table[state, c]
            if kind:
                out[kind] += THREAT_WEIGHT if kind.endswith("threat") else last
        return out

    def features(self, text: str | None) -> list[float]:
        return [math.log1p(x) for x in self.matches(text).values()]


#: Bias and a weight for each kind: the centre of the prior of the fit.
PRIOR = np.array([-3.0, 2.5, 3.0, 1.0, 1.0, 2.0, 0.5, 0.5])


def fit_weights(x: np.ndarray, y: np.ndarray, strength: float = 1.0) -> np.ndarray:
    """Logistic regression with a Gaussian prior about PRIOR, by Newton steps."""
    w = PRIOR.copy()
    if len(y) == 0 or y.min() == y.max():
        return w
    a = np.column_stack([np.ones(len(x)), x])

    def loss(v: np.ndarray) -> float:
        z = a @ v
        return float(np.logaddexp(0, z).sum() - y @ z + strength / 2 * ((v - PRIOR) ** 2).sum())

    best = loss(w)
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -500, 500)))
        grad = a.T @ (p - y) + strength * (w - PRIOR)
        hess = (a * (p * (1 - p))[:, None]).T @ a + strength * np.eye(len(w))
        move = np.linalg.solve(hess, grad)
        step = 1.0
        # The loss is convex: a step that is short enough lowers it, a full one may overshoot.
        while step > 1e-9 and not loss(w - step * move) < best:
            step /= 2
        if step <= 1e-9:
            break
        w = w - step * move
        now = loss(w)
        if best - now < 1e-9 * max(1.0, abs(best)):
            break
        best = now
    return w


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          max_labelled: int = MAX_LABELLED) -> tuple[dict[str, float], np.ndarray]:
    """Word weights and kind weights from labelled rows that aren't held out."""
    known = (
        labels.filter(F.col("toxic").isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
        .groupBy(id_col).agg((F.max("toxic") > 0).cast("int").alias("_y"))
    )
    n = known.count()
    if n > max_labelled:  # a share below the bound, so that the sample is bounded
        known = known.filter(F.pmod(F.xxhash64(id_col, F.lit(17)), F.lit(1_000_003)) < int(0.9 * max_labelled / n * 1_000_003))
    sample = common.materialize(
        docs.select(F.col(id_col), F.col(text_col).alias("_t")).join(F.broadcast(known), id_col).select("_t", "_y"), "toxic-sample"
    )
    # Equal texts count once. Words of near copies stand between the same neighbours in each of
    # them, so a word needs several pairs of neighbours for each toxic text that has it.
    ws = F.regexp_extract_all(F.lower("_t"), F.lit(r"[\p{L}]+(?:'[\p{L}]+)?"), F.lit(0))
    once = sample.filter(F.col("_t").isNotNull()).groupBy("_t").agg(F.max("_y").alias("_y")).select("_y", ws.alias("ws"))
    size = once.agg(F.count("*"), F.sum("_y")).head()
    n_all, n_pos = size[0], int(size[1] or 0)
    if not n_pos or n_pos == n_all:
        return dict(SEED_INSULTS), PRIOR.copy()
    support = max(MIN_SUPPORT, math.ceil(0.005 * n_pos))
    counted = (
        once.select("_y", F.explode(F.array_distinct("ws")).alias("w")).groupBy("w")
        .agg(F.sum("_y").alias("pos"), F.sum(1 - F.col("_y")).alias("neg")).filter(F.col("pos") >= support)
        .withColumn("odds", F.log((F.col("pos") + 0.5) / (n_pos + 1)) - F.log((F.col("neg") + 0.5) / (n_all - n_pos + 1)))
        .filter(F.col("odds") >= MIN_LOG_ODDS)
    )
    edge, n = F.array(F.lit("")), F.size("ws")
    around = F.arrays_zip(
        F.concat(edge, F.slice("ws", F.lit(1), n - 1)).alias("before"), F.col("ws").alias("w"),
        F.concat(F.slice("ws", F.lit(2), n), edge).alias("after"))
    places = (
        once.filter((F.col("_y") == 1) & (n > 0)).select(F.explode(around).alias("x")).select("x.before", "x.w", "x.after")
        .groupBy("w").agg(F.countDistinct("before", "after").alias("places"))
    )
    counted = counted.join(places, "w")
    # Bounded by the words that ``support`` texts of the bounded sample share.
    learned = {r["w"]: r["odds"] for r in counted.filter(F.col("places") >= MIN_PLACES * F.col("pos")).collect()}
    known_seeds = once.select(F.explode("ws").alias("w")).filter(F.col("w").isin(list(SEED_INSULTS))).distinct()
    met = {r["w"] for r in known_seeds.collect()}
    lexicon = {w: x for w, x in SEED_INSULTS.items() if w not in met} | learned
    grammar = Grammar(lexicon)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [grammar.features(t) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), b.column(1).cast(pa.int32())], ["x", "y"])

    # Bounded by max_labelled rows of six numbers.
    got = sample.mapInArrow(features, "x array<double>, y int").collect()
    return lexicon, fit_weights(np.array([r["x"] for r in got]), np.array([r["y"] for r in got], float))


def score(docs: DataFrame, lexicon: dict[str, float], weights: np.ndarray, text_col: str = "text",
          score_col: str = "score") -> DataFrame:
    """All columns of ``docs`` and a column ``score_col`` (one of that name is replaced)."""
    grammar, w = Grammar(lexicon), [float(x) for x in weights]

    def rate(text: str | None) -> float:
        z = w[0] + sum(a * b for a, b in zip(w[1:], grammar.features(text)))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))

    docs = docs.drop(score_col)
    at = docs.columns.index(text_col)
    schema = T.StructType([*docs.schema.fields, T.StructField(score_col, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = pa.array([rate(t) for t in b.column(at).to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([*b.columns, s], [*b.schema.names, score_col])

    return docs.mapInArrow(run, schema)


def judge(docs: DataFrame, labels: DataFrame, score_col: str = "score") -> DataFrame:
    """Train on the labels and score all of ``docs``."""
    lexicon, weights = train(docs.select("doc_id", "text"), labels)
    return score(docs, lexicon, weights, score_col=score_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    out = judge(docs, common.table(spark, sf_dir, "labels"))
    return out.select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that score at least THRESHOLD go."""
    name, = common.fresh(docs.columns, "score")
    out = judge(docs, common.table(spark, sf_dir, "labels"), name)
    return out.filter(F.col(name) < THRESHOLD).drop(name)
