"""Quality measures of texts and rules whose cutoffs bound false rejections. DataFrame functions only."""

from __future__ import annotations

from math import exp, lgamma, log, log1p

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import SPACE_CLASS, cut

WINDOW = 5
#: Rules: measure, and cutoffs from the strictest to the mildest; a greater value rejects.
RULES = {
    "symbol_share": (0.05, 0.1, 0.2, 0.3, 0.5),
    "dup_line_share": (0.1, 0.2, 0.3, 0.5, 0.7),
    "repeat_share": (0.02, 0.05, 0.1, 0.15, 0.2),
    "long_words": (9.0, 11.0, 13.0, 16.0, 24.0),
    "short_words": (-3.0, -2.5, -2.0, -1.5),
}


def measures(docs: DataFrame) -> DataFrame:
    """``docs`` (its doc_id and lang) with the measures of each whole text, and a digest of it.

    n_words; word_chars (code points in words); n_symbols (of ``#*$%&|<>``); n_dup_lines (lines with
    a word that equal an earlier line); n_repeat_words (words in 5-word windows found twice or more
    in the text, the first included; windows are told apart by a 64-bit hash of their words).
    Null texts have no words and no lines. Rows are measured one by one, without a shuffle.
    """
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = docs.select(F.col("doc_id").cast("long"), F.coalesce(lang, F.lit("")).alias("lang"), text.alias("t"))
    words = F.filter(F.split("t", rf"[{SPACE_CLASS}]+"), lambda w: w != "")
    lines = F.filter(F.split("t", "\n"), lambda x: x.rlike(rf"[^{SPACE_CLASS}]"))
    counted = base.select(
        "doc_id",
        "lang",
        F.sha2("t", 256).alias("digest"),
        words.alias("w"),
        (F.char_length("t") - F.char_length(F.regexp_replace("t", rf"[^{SPACE_CLASS}]+", ""))).cast("long").alias("word_chars"),
        F.char_length(F.regexp_replace("t", "[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
    )
    n = F.size("w")
    starts = F.sequence(F.lit(1), n - (WINDOW - 1))
    hashes = F.when(n >= WINDOW, F.transform(starts, lambda i: F.xxhash64(*(F.get("w", i - 1 + k) for k in range(WINDOW))))).otherwise(F.array().cast("array<long>"))
    hashed = counted.withColumn("n_words", n.cast("long")).withColumn("h", hashes).drop("w")
    # most texts repeat no window; the others sort theirs with their places
    pairs = F.when(F.size(F.array_distinct("h")) < F.size("h"), F.array_sort(F.arrays_zip(F.col("h"), F.sequence(F.lit(0), F.size("h") - 1).alias("i"))))
    paired = hashed.withColumn("p", pairs).drop("h")
    last = F.size("p")
    neighbours = F.arrays_zip(
        F.col("p").alias("a"),
        F.concat(F.array(F.lit(None).cast("struct<h:bigint,i:int>")), F.slice("p", 1, last - 1)).alias("b"),
        F.concat(F.slice("p", 2, last - 1), F.array(F.lit(None).cast("struct<h:bigint,i:int>"))).alias("c"),
    )
    twice = F.filter(neighbours, lambda x: x["a"]["h"].eqNullSafe(x["b"]["h"]) | x["a"]["h"].eqNullSafe(x["c"]["h"]))
    found = paired.withColumn("s", F.when(F.col("p").isNotNull(), F.sort_array(F.transform(twice, lambda x: x["a"]["i"])))).drop("p")
    gaps = F.zip_with(F.slice("s", 2, F.size("s") - 1), F.slice("s", 1, F.size("s") - 1), lambda b, a: F.least(b - a, F.lit(WINDOW)))
    covered = F.aggregate(gaps, F.lit(WINDOW), lambda a, x: a + x).cast("long")
    return found.withColumn("n_repeat_words", F.when(F.col("s").isNotNull(), covered).otherwise(F.lit(0).cast("long"))).drop("s")


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def shares() -> dict[str, Column]:
    """The rules' measures from the counts."""
    words, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    return {
        "symbol_share": F.col("n_symbols") / chars,
        "dup_line_share": F.col("n_dup_lines") / words * 10,
        "repeat_share": F.col("n_repeat_words") / words,
        "long_words": F.col("word_chars") / words,
        "short_words": -(F.col("word_chars") / words),
    }


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(at most k of n) for chance p, summed from k down to where terms stop counting.

    From a share k / n of ``p`` on it is 1, which no level reaches.
    """
    if k >= n * p:
        return 1.0
    term = total = exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) + k * log(p) + (n - k) * log1p(-p))
    for i in range(k, 0, -1):
        term *= i * (1 - p) / ((n - i + 1) * p)
        total += term
        if term < 1e-17 * total:
            break
    return min(1.0, total)


def holm(p_values: dict, level: float) -> set:
    """Hypotheses that Holm's step-down procedure rejects at a family-wise ``level``."""
    out, left = set(), len(p_values)
    for key, p in sorted(p_values.items(), key=lambda x: (x[1], str(x[0]))):
        if p > level / left:
            break
        out.add(key)
        left -= 1
    return out


def rule_sets(rules: dict = RULES) -> list[dict[str, float]]:
    """What a stratum may be given: any rule at any cutoff, or all rules at their strictest, second, ... cutoffs."""
    single = [{rule: cutoff} for rule, cutoffs in rules.items() for cutoff in cutoffs]
    levels = max((len(c) for c in rules.values()), default=0)
    return single + [{rule: cutoffs[min(i, len(cutoffs) - 1)] for rule, cutoffs in rules.items()} for i in range(levels)]


def rejects(rule_set: dict[str, float]) -> Column:
    """Whether one of the rules rejects a row, from its counts."""
    out, measured = F.lit(False), shares()
    for rule, cutoff in rule_set.items():
        out = out | (measured[rule] > cutoff)
    return out


def certified_cutoffs(labelled: DataFrame, limit: float = 0.01, level: float = 0.05, rules: dict = RULES) -> dict[str, dict[str, float]]:
    """The rules and cutoffs of each stratum that reject good documents rarely, for sure.

    ``labelled`` has ``lang`` (the stratum), the counts, ``base_failed`` and ``quality``. Of each
    stratum and rule set (see ``rule_sets``) the hypothesis is that it rejects more than ``limit`` of
    the good documents; an exact binomial test on the stratum's labelled documents rejects it, and
    Holm's correction covers all strata and sets. A stratum gets one set, so with confidence
    1 - level none loses more than ``limit`` of its good documents. Among the certified sets the one
    that rejects most labelled bad documents is taken (ties: fewer good ones, fewer rules, higher
    cutoffs), none if none rejects any. Every stratum takes part; only counts reach the driver.
    """
    good, bad = (F.col("quality") == 1) & ~F.col("base_failed"), (F.col("quality") == 0) & ~F.col("base_failed")
    sets = rule_sets(rules)
    counts = [F.count_if(good).alias("n")]
    for i, rule_set in enumerate(sets):
        counts += [F.count_if(good & F.col(f"r{i}")).alias(f"g{i}"), F.count_if(bad & F.col(f"r{i}")).alias(f"b{i}")]
    judged = labelled.select("lang", "quality", "base_failed", *(rejects(x).alias(f"r{i}") for i, x in enumerate(sets)))
    strata = judged.groupBy("lang").agg(*counts).orderBy("lang").collect()
    tests = {(r["lang"], i): binomial_tail(r[f"g{i}"], r["n"], limit) for r in strata if r["n"] for i in range(len(sets))}
    sure, chosen = holm(tests, level), {}
    for r in strata:
        ranked = [(r[f"b{i}"], -r[f"g{i}"], -len(x), sum(x.values()), i) for i, x in enumerate(sets) if (r["lang"], i) in sure and r[f"b{i}"]]
        if ranked:
            chosen[r["lang"]] = sets[max(ranked)[-1]]
    return dict(sorted(chosen.items()))


def quality_verdicts(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """Measures of each document with base_failed and kept.

    ``kept`` is false if ``base_failed``, else whether no certified rule of the document's stratum
    rejects it. ``labels`` (doc_id, quality) is the holdout; rows that are null or without a
    document don't count. Equal texts of a stratum are one trial, good if any label says so, as
    copies are not independent; near copies count apart. A null lang is a stratum of its own, with the
    empty one. Null texts have no words and fail the base rule. Long texts are measured whole.
    Empty tables work: without labels nothing but the base rule rejects.
    """
    # measured once, as labels and verdicts both need it; only the numbers are kept, not the texts
    measured = cut(measures(docs).withColumn("base_failed", base_failed()))
    held = labels.select(F.col("doc_id").cast("long").alias("label_id"), F.col("quality").cast("int")).where("label_id is not null and quality is not null")
    labelled = measured.join(held, F.col("doc_id") == F.col("label_id"))
    numbers = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    trials = labelled.groupBy("lang", "digest").agg(F.max("quality").alias("quality"), *(F.first(c).alias(c) for c in numbers))
    cutoffs = certified_cutoffs(trials, **options)
    rejected = F.lit(False)
    for lang, found in cutoffs.items():
        rejected = rejected | ((F.col("lang") == lang) & rejects(found))
    return measured.drop("digest").withColumn("kept", ~F.col("base_failed") & ~rejected)
