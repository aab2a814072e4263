"""Quality rules by weak supervision (native: DataFrame functions only).

Every rule looks at a few counts of a text and votes good (+1), bad (-1) or abstains (0).
Expectation-maximisation over the votes estimates, without labels, how often each rule is
right on good and on bad texts; the posterior probability of "good" replaces a filter that
wants all rules to pass. EM starts from several guesses and the likeliest end is taken. The model sees the corpus only as a histogram of vote patterns, at
most 3**len(RULES) rows whatever the input, so the fit is the same work at any size. Rules are
believed as far as others vote with them: a rule that alone says "bad" of texts all others call
good is taken to be wrong there.

Cases: a null or empty text has no words and fails the base rule; null ids and repeated rows
are kept, one output row for each input row; extra columns are ignored; an empty table gives
an empty result; ties at a posterior of exactly ``threshold`` are kept.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

WINDOW = 8  # a power of two
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
FUNCTION_WORDS = (
    "the of and to in is a that for it on with as are was "
    "der die das und ist in zu den mit von nicht ein eine für auf "
    "le la les de des et en un une que pour dans est qui sur "
    "el los las que y en por con para se una no del al"
).split()


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts of every whole text. One pass, no shuffle."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    n = F.size("w")
    step = docs.select(F.col(id_col), text.alias("t"), common.words(F.col(text_col)).alias("w"))
    step = step.select(
        id_col,
        "w",
        n.cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.regexp_count("t", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count("t", F.lit(r"\p{Lu}")).alias("n_upper"),
        F.regexp_count("t", F.lit("!")).alias("n_shouts"),
        F.filter(F.split("t", "\n"), lambda x: x.rlike(common.WORD)).alias("lines"),
        F.transform("w", lambda x: F.xxhash64(x)).alias("h"),
        F.when(n > 1, F.size(F.filter(F.sequence(F.lit(1), n - 1), lambda i: F.get("w", i) == F.get("w", i - 1))))
        .otherwise(0).alias("n_stutter"),
        F.size(F.array_distinct("w")).alias("n_distinct"),
        F.size(F.filter("w", lambda x: x.isin(FUNCTION_WORDS))).alias("n_function"),
    )
    # Hashes of runs of 2, 4, ... words from those of their halves.
    width = 1
    while width < WINDOW:
        rest = F.slice("h", width + 1, F.greatest(F.size("h"), F.lit(1)))
        step = step.withColumn("h", F.zip_with("h", rest, lambda a, b: F.xxhash64(a, b)))
        width *= 2
    step = step.withColumn("h", F.when(n >= WINDOW, F.slice("h", F.lit(1), n - (WINDOW - 1))))
    # Only texts with a repeated window pay for sorting their windows.
    step = step.select(
        *[c for c in step.columns if c not in ("w", "lines", "h")],
        F.size("lines").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size(F.filter("lines", lambda x: x.rlike(r"[.!?][\x20\x09-\x0D]*$"))).alias("n_ended"),
        F.when(
            F.size(F.array_distinct("h")) < F.size("h"),
            F.sort_array(F.transform("h", lambda x, i: F.struct(x.alias("h"), i.alias("i")))),
        ).alias("s"),
    )
    repeated = F.transform(
        "s",
        lambda x, k: F.when(
            (F.get("s", k - 1).h == x.h) | (F.get("s", k + 1).h == x.h), x.i
        ),
    )
    starts = F.sort_array(F.filter(repeated, lambda x: x.isNotNull()))
    step = step.withColumn("starts", starts)
    covered = F.aggregate(
        "starts",
        F.struct(F.lit(0).alias("end"), F.lit(0).alias("n")),
        lambda a, x: F.struct(
            (x + WINDOW).alias("end"), (a.n + x + WINDOW - F.greatest(a.end, x)).alias("n")
        ),
        lambda a: a.n,
    )
    return step.select(
        *[c for c in step.columns if c not in ("s", "starts")],
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
    )


def _share(a: str, b: str) -> Column:
    return F.col(a) / F.greatest(F.col(b), F.lit(1))


def rule_votes() -> dict[str, Column]:
    """The rules: +1 good, -1 bad, 0 abstains."""

    def vote(good: Column, bad: Column) -> Column:
        return F.when(bad, -1).when(good, 1).otherwise(0).cast("int")

    symbols, repeat = _share("n_symbols", "n_words"), _share("n_repeat_words", "n_words")
    lines, stutter = _share("n_dup_lines", "n_lines"), _share("n_stutter", "n_words")
    length, distinct = _share("word_chars", "n_words"), _share("n_distinct", "n_words")
    ended, function = _share("n_ended", "n_lines"), _share("n_function", "n_words")
    upper, shouts = _share("n_upper", "word_chars"), _share("n_shouts", "n_words")
    return {
        "symbols": vote(symbols < 0.03, symbols > 0.1),
        "repeat": vote(repeat < 0.05, repeat > 0.2),
        "dup_lines": vote((F.col("n_lines") > 2) & (lines < 0.1), lines > 0.3),
        "stutter": vote(stutter < 0.05, stutter > 0.2),
        "word_length": vote(length.between(3, 9), (length < 2) | (length > 14)),
        "diversity": vote(distinct > 0.35, (distinct < 0.25) & (F.col("n_words") < 1000)),
        "ended": vote(ended > 0.6, ended < 0.1),
        "function_words": vote(function > 0.08, function < 0.03),
        "shouting": vote((upper < 0.2) & (shouts < 0.1), (upper > 0.6) | (shouts > 0.3)),
    }


#: Beta priors (good votes, bad votes) of the share of good votes a rule gives: on good texts it
#: seldom says "bad"; on bad ones it may well say "good", as each rule knows one kind of junk.
GOOD_PRIOR, BAD_PRIOR = (38.0, 2.0), (2.0, 2.0)
#: Prior (good, bad) of the share of good texts.
SHARE_PRIOR = (4.0, 1.0)


def _expect(histogram: list, share: float, yes: dict) -> tuple[list[float], float]:
    """Posterior of "good" for every pattern, and the log-likelihood of the histogram."""
    post, total = [], 0.0
    for votes, n in histogram:
        g, b = math.log(share), math.log(1 - share)
        for r, v in enumerate(votes):
            if v:
                g += math.log(yes["good"][r] if v > 0 else 1 - yes["good"][r])
                b += math.log(yes["bad"][r] if v > 0 else 1 - yes["bad"][r])
        top = max(g, b)
        both = top + math.log(math.exp(g - top) + math.exp(b - top))
        post.append(math.exp(g - both))
        total += n * both
    return post, total


def _maximise(histogram: list, post: list[float], k: int) -> tuple[float, dict]:
    """The most probable share of good texts and vote shares by class, given the posteriors."""
    good = sum(p * n for p, (_, n) in zip(post, histogram))
    total = sum(n for _, n in histogram)
    share = (good + SHARE_PRIOR[0]) / (total + sum(SHARE_PRIOR))
    yes: dict = {"good": [], "bad": []}
    for name, prior in (("good", GOOD_PRIOR), ("bad", BAD_PRIOR)):
        weight = post if name == "good" else [1 - p for p in post]
        for r in range(k):
            up = sum(w * n for w, (v, n) in zip(weight, histogram) if v[r] > 0) + prior[0]
            down = sum(w * n for w, (v, n) in zip(weight, histogram) if v[r] < 0) + prior[1]
            yes[name].append(up / (up + down))
    # No rule may say "good" more often of bad texts than of good ones.
    yes["bad"] = [min(b, g) for g, b in zip(yes["good"], yes["bad"])]
    return share, yes


def _log_prior(share: float, yes: dict) -> float:
    def beta(p: float, ab: tuple[float, float]) -> float:
        return ab[0] * math.log(p) + ab[1] * math.log(1 - p)

    return beta(share, SHARE_PRIOR) + sum(beta(p, GOOD_PRIOR) for p in yes["good"]) + sum(beta(p, BAD_PRIOR) for p in yes["bad"])


def fit(histogram: list[tuple[tuple[int, ...], int]], rounds: int = 200) -> dict:
    """EM over (vote pattern, count) rows. Returns the log-odds weights of every vote.

    For each class the model has, by rule, the chance of a good vote among its votes; an
    abstention tells nothing. EM climbs to the nearest optimum, which in a small corpus may take
    the rarest kind of text for the bad class; so it starts once for each number of bad votes
    that may make a text bad, and the end of highest likelihood times prior is taken. The priors
    are of the rules' accuracies, not of how many texts are bad."""
    k = len(histogram[0][0]) if histogram else len(rule_votes())
    best: tuple | None = None
    for least in range(1, k + 1) if histogram else (1,):
        post = [0.05 if sum(v < 0 for v in votes) >= least else 0.95 for votes, _ in histogram]
        before = -math.inf
        for _ in range(rounds):
            share, yes = _maximise(histogram, post, k)
            post, likelihood = _expect(histogram, share, yes)
            now = likelihood + _log_prior(share, yes)
            if now - before < 1e-9 * max(1.0, abs(now)):
                break
            before = now
        if best is None or now > best[0] + 1e-9 * abs(now):
            best = now, share, yes
    _, share, yes = best
    return {
        "bias": math.log(share / (1 - share)),
        "yes": [math.log(g / b) for g, b in zip(yes["good"], yes["bad"])],
        "no": [math.log((1 - g) / (1 - b)) for g, b in zip(yes["good"], yes["bad"])],
        "accuracy": yes,
        "prior": share,
    }


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """Counts, base rule, votes and posterior of every text."""
    rules = rule_votes()
    names = list(rules)
    rated = common.materialize(
        measures(docs, id_col, text_col).select("*", *[c.alias(f"vote_{n}") for n, c in rules.items()]), "quality"
    )
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    votes = [f"vote_{n}" for n in names]
    # At most 3**len(rules) rows. The base rule already settles its own cases.
    rows = rated.filter(~base).groupBy(*votes).count().collect()
    model = fit(sorted((tuple(r[v] for v in votes), r["count"]) for r in rows))
    logit = F.lit(model["bias"])
    for v, yes, no in zip(votes, model["yes"], model["no"]):
        logit = logit + F.when(F.col(v) > 0, F.lit(yes)).when(F.col(v) < 0, F.lit(no)).otherwise(F.lit(0.0))
    return (
        rated.withColumn("base_failed", base)
        .withColumn("posterior", 1 / (1 + F.exp(-logit)))
        .withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= threshold))
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(common.table(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        F.round("posterior", 6).alias("posterior"),
    )
