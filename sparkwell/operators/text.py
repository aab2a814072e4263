"""Full-text search over (id, text): BM25, phrases, boolean queries, headlines, chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import checkpoint

K1, B = 1.2, 0.75


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda x: x != "")


def _times(tokens_col: str, term: str) -> Column:
    return F.size(F.filter(tokens_col, lambda x: x == term))


def bm25(docs: DataFrame, id_col: str, text_col: str, terms: list[str], k1: float = K1, b: float = B) -> DataFrame:
    """(id, score) of the documents that have any of the terms. Texts are read once: the length
    and the counts of the query's terms are written, a few numbers a document, and the totals and
    scores come from them; nothing but one total row is shuffled."""
    rows = docs.select(F.col(id_col), tokens(F.col(text_col)).alias("_t"))
    rows = rows.select(
        id_col, F.size("_t").alias("_dl"),
        *[_times("_t", t).alias(f"_tf{i}") for i, t in enumerate(terms)])
    rows = checkpoint(rows)
    total = rows.agg(
        F.count("*").alias("_n"), F.avg("_dl").alias("_avg"), *[F.sum((F.col(f"_tf{i}") > 0).cast("long")).alias(f"_df{i}") for i in range(len(terms))])
    both = rows.crossJoin(F.broadcast(total))  # one row
    score = F.lit(0.0)
    for i in range(len(terms)):
        idf = F.log((F.col("_n") - F.col(f"_df{i}") + 0.5) / (F.col(f"_df{i}") + 0.5) + 1)
        tf = F.col(f"_tf{i}")
        score = score + idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("_dl") / F.col("_avg")))
    any_term = F.greatest(*[F.col(f"_tf{i}") for i in range(len(terms))], F.lit(0)) > 0
    return both.filter(any_term).select(id_col, score.alias("score"))


def phrase(text: Column, words: list[str]) -> Column:
    """Whether the words stand next to each other in this order. Tokens hold no spaces, so the
    joined tokens contain the phrase exactly where it stands."""
    joined = F.concat(F.lit(" "), F.array_join(tokens(text), " "), F.lit(" "))
    return joined.contains(" " + " ".join(words) + " ")


def boolean(text: Column, must: list[str] = (), any_of: list[str] = (), none_of: list[str] = ()) -> Column:
    t = tokens(text)
    out = F.lit(True)
    for w in must:
        out = out & F.array_contains(t, w)
    if any_of:
        out = out & F.arrays_overlap(t, F.array(*[F.lit(w) for w in any_of]))
    if none_of:
        out = out & ~F.arrays_overlap(t, F.array(*[F.lit(w) for w in none_of]))
    return out


def headline(text: Column, words: list[str], start: str = "<b>", stop: str = "</b>") -> Column:
    pattern = r"(?iu)\b(" + "|".join(words) + r")\b"
    return F.regexp_replace(text, pattern, f"{start}$1{stop}")


def snippet(text: Column, word: str, width: int = 40) -> Column:
    """About ``width`` characters round the first place of the word; null if it has none."""
    at = F.instr(F.lower(text), word.lower())
    return F.when(at > 0, F.substring(text, F.greatest(at - width // 2, F.lit(1)), F.lit(width)))


def postings(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(term, id, tf, positions): the inverted index as a table."""
    rows = docs.select(id_col, F.posexplode(tokens(F.col(text_col))).alias("pos", "term"))
    return rows.groupBy("term", id_col).agg(F.count("*").alias("tf"), F.sort_array(F.collect_list("pos")).alias("positions"))


def chunk_words(docs: DataFrame, id_col: str, text_col: str, size: int = 512, overlap: int = 50) -> DataFrame:
    """(id, chunk, body): windows of ``size`` words, each ``overlap`` words into the one before."""
    step = max(size - overlap, 1)
    w = F.array_remove(F.split(F.coalesce(F.col(text_col), F.lit("")), r"[ \t\n\x0B\f\r]+"), "")
    rows = docs.select(id_col, w.alias("_w")).filter(F.size("_w") > 0)
    rows = rows.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.floor((F.size("_w") - 1) / step).cast("int"))))
    return rows.select(id_col, "chunk", F.array_join(F.slice("_w", F.col("chunk") * step + 1, F.lit(size)), " ").alias("body"))


def chunk_paragraphs(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    parts = F.filter(F.split(F.col(text_col), r"\n\s*\n"), lambda x: F.trim(x) != "")
    return docs.select(id_col, F.posexplode(parts).alias("chunk", "body"))


def chunk_sentences(docs: DataFrame, id_col: str, text_col: str, per_chunk: int = 5) -> DataFrame:
    s = F.filter(F.split(F.col(text_col), r"(?<=[.!?])\s+"), lambda x: F.trim(x) != "")
    rows = docs.select(id_col, s.alias("_s")).filter(F.size("_s") > 0)
    rows = rows.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.floor((F.size("_s") - 1) / per_chunk).cast("int"))))
    return rows.select(id_col, "chunk", F.array_join(F.slice("_s", F.col("chunk") * per_chunk + 1, F.lit(per_chunk)), " ").alias("body"))


def to_tsquery(query: str, tokens_col: Column) -> Column:
    """``&``, ``|``, ``!`` and brackets over words, as a condition on an array of tokens."""
    import re

    parts, at = re.findall(r"[&|!()]|[^\s&|!()]+", query.lower()), 0

    def either() -> Column:
        nonlocal at
        out = both()
        while at < len(parts) and parts[at] == "|":
            at += 1
            out = out | both()
        return out

    def both() -> Column:
        nonlocal at
        out = one()
        while at < len(parts) and parts[at] == "&":
            at += 1
            out = out & one()
        return out

    def one() -> Column:
        nonlocal at
        if at >= len(parts):
            raise ValueError(f"a word is missing in {query!r}")
        part, at = parts[at], at + 1
        if part == "!":
            return ~one()
        if part != "(":
            return F.array_contains(tokens_col, part)
        out = either()
        if at >= len(parts) or parts[at] != ")":
            raise ValueError(f"a bracket is open in {query!r}")
        at += 1
        return out

    out = either()
    if at < len(parts):
        raise ValueError(f"{parts[at]!r} is out of place in {query!r}")
    return out


def plainto_tsquery(query: str, tokens_col: Column) -> Column:
    """All words of a plain text."""
    import re

    return to_tsquery(" & ".join(re.findall(r"\w+", query)), tokens_col)


def websearch_to_tsquery(query: str, tokens_col: Column) -> Column:
    """Words, ``-word`` for none of it, ``or`` between alternatives."""
    import re

    sides = re.split(r"\s+or\s+", query.lower().strip())
    return to_tsquery(" | ".join("(" + " & ".join(("!" if w[0] == "-" else "") + w.lstrip("-") for w in s.split()) + ")" for s in sides), tokens_col)


def trigrams(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(gram, id): every run of three characters of every text, once."""
    n = F.length(text_col)
    grams = F.array_distinct(F.transform(F.sequence(F.lit(1), n - 2), lambda i: F.substring(F.col(text_col), i, F.lit(3))))
    return docs.filter(n >= 3).select(F.explode(grams).alias("gram"), id_col)


def like_by_trigrams(index: DataFrame, docs: DataFrame, id_col: str, text_col: str, part: str) -> DataFrame:
    """Rows whose text contains ``part`` (three characters or more)."""
    want = list(dict.fromkeys(part[i : i + 3] for i in range(len(part) - 2)))
    ids = index.filter(F.col("gram").isin(want)).groupBy(id_col).agg(F.count("*").alias("n")).filter(F.col("n") == len(want)).select(id_col)
    return docs.join(ids, id_col, "left_semi").filter(F.col(text_col).contains(part))
