"""Quality rules as weak supervision, with built-in functions only.

Each rule votes for (1) or against (-1) a text, or abstains (0). Texts are good or one of
a few kinds of junk (`KINDS`). How often a rule is right on each, and the shares, come
from expectation-maximisation over the counts of vote patterns: at most 3 ** (number of
rules) rows, summed on the executors, whatever the size of the table. A text is kept if
its posterior probability of being good reaches `KEEP`.

Defined results: a null or empty text has no words and fails; ties and repeated rows
are judged alike, each row on its own; further columns pass through `judge` untouched
(a column named like one of its own is replaced); an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leadspark.llm import common as C

KEEP = 0.5
ROUNDS = 50
#: Bounds of every estimate; they only keep it from 0 and 1.
BOUNDS = (0.01, 0.99)
#: Votes that each estimate begins with, half of them right, so that a few texts don't settle it.
PRIOR = 2.0
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞ"
SYMBOLS = "#*$%&|<>"
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
DIGITS = "0123456789"
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MORE = ["n_lines", "n_upper", "n_exclaim", "n_marks", "n_digits", "n_symbol_words", "n_kinds"]


#: Rules that see the same kind of junk; none is alone on its kind.
KINDS = {
    "symbols": ("symbols", "marks", "symbol_words"),
    "repetition": ("repeats", "lines", "variety"),
    "shouting": ("capitals", "shouting"),
    "dumps": ("word_length", "digits", "marks"),
}


def _without(text: Column, chars: str) -> Column:
    return F.length(F.translate(text, chars, ""))


def features(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The columns `keep` of the input, and counts over each whole text."""
    t = F.coalesce(F.col("text").cast("string"), F.lit(""))
    has_word = lambda x: F.translate(x, C.SPACE, "") != ""
    rows = docs.select(*keep, t.alias("_t"))
    rows = rows.select(
        *keep,
        F.filter(F.split("_t", r"[\x20\x09-\x0D]+"), lambda w: w != "").alias("_words"),
        F.filter(F.split("_t", "\n"), has_word).alias("_lines"),
        F.length("_t").alias("_chars"),
        _without(F.col("_t"), C.SPACE).cast("long").alias("word_chars"),
        (F.length("_t") - _without(F.col("_t"), SYMBOLS)).cast("long").alias("n_symbols"),
        (F.length("_t") - _without(F.col("_t"), UPPER)).cast("long").alias("n_upper"),
        (F.length("_t") - F.length(F.replace("_t", F.lit("!"), F.lit("")))).cast("long").alias("n_exclaim"),
        (F.length("_t") - _without(F.col("_t"), MARKS)).cast("long").alias("n_marks"),
        (F.length("_t") - _without(F.col("_t"), DIGITS)).cast("long").alias("n_digits"),
    )
    rows = rows.withColumn(
        "_grams",
        F.expr("if(size(_words) < 3, array(), transform(sequence(0, size(_words) - 3), i -> xxhash64(_words[i], _words[i + 1], _words[i + 2])))").cast("array<bigint>"),
    )
    rows = rows.withColumn("_again", F.size(F.array_distinct("_grams")) < F.size("_grams"))
    rows = rows.withColumn(
        "_sorted",
        F.expr("if(_again, array_sort(transform(_grams, (h, i) -> struct(h as h, i as i))), cast(array() as array<struct<h:bigint,i:int>>))"),
    )
    rows = rows.withColumn(
        "_twice",
        F.expr("filter(_sorted, (s, k) -> (k > 0 and get(_sorted, k - 1).h = s.h) or coalesce(get(_sorted, k + 1).h = s.h, false))"),
    )
    return rows.select(
        *keep,
        F.size("_words").cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.expr("cast(size(array_distinct(flatten(transform(_twice, s -> array(s.i, s.i + 1, s.i + 2))))) as bigint)").alias("n_repeat_words"),
        F.size("_lines").cast("long").alias("n_lines"),
        "n_upper",
        "n_exclaim",
        "n_marks",
        "n_digits",
        F.size(F.filter("_words", lambda w: F.translate(w, SYMBOLS, "") != w)).cast("long").alias("n_symbol_words"),
        F.size(F.array_distinct("_words")).cast("long").alias("n_kinds"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _vote(against: str, favour: str) -> Column:
    return F.expr(f"case when {against} then -1 when {favour} then 1 else 0 end")


def votes() -> dict[str, Column]:
    """Name of each rule and its vote."""
    return {
        "symbols": _vote("10 * n_symbols > n_words", "50 * n_symbols <= n_words"),
        "repeats": _vote("10 * n_repeat_words > 3 * n_words", "10 * n_repeat_words <= n_words"),
        "lines": _vote("10 * n_dup_lines > 6 * n_lines and n_lines > 5", "n_dup_lines = 0 and n_lines > 5"),
        "capitals": _vote("10 * n_upper > 4 * word_chars", "10 * n_upper <= 2 * word_chars and word_chars > 0"),
        "shouting": _vote("4 * n_exclaim > n_words", "50 * n_exclaim <= n_words and n_words > 0"),
        "word_length": _vote("word_chars < 2 * n_words or word_chars > 12 * n_words or n_words = 0", "word_chars between 3 * n_words and 10 * n_words"),
        "marks": _vote("100 * n_marks > 10 * word_chars", "100 * n_marks <= 7 * word_chars and word_chars > 0"),
        "symbol_words": _vote("10 * n_symbol_words > 3 * n_words", "5 * n_symbol_words <= n_words and n_words > 0"),
        "variety": _vote("10 * n_kinds < n_words", "3 * n_kinds >= n_words and n_words > 0"),
        "digits": _vote("10 * n_digits > 3 * word_chars", "10 * n_digits <= word_chars and word_chars > 0"),
    }


#: Log odds of good against a kind of junk before any vote, and what each vote adds for each rule.
Odds = tuple[float, list[dict[int, float]]]


def fit(patterns: list[tuple[tuple[int, ...], int]], rules: int) -> tuple[float, list[Odds]]:
    """Share of good texts, and the odds of good against each kind of junk. A rule that
    votes is right on good texts with one chance and on each kind of junk with another;
    these and the shares come from EM, which starts from the votes against. Labels can't
    switch: no vote against speaks for a text, nor one in favour against it, and on its
    own kind of junk a rule is right at least as often as not."""
    total = sum(n for _, n in patterns)
    if not total:
        return 0.9, [(math.log(0.9 / 0.1), [{v: 0.0 for v in (-1, 0, 1)}] * rules)]
    low, high = BOUNDS
    names = list(votes())
    own = np.array([[n in kind for n in names] for kind in KINDS.values()])[:, :rules]
    vote = np.array([v for v, _ in patterns]).reshape(-1, rules)
    n = np.array([n for _, n in patterns], float)
    against, voted = (vote < 0).astype(float), (vote != 0).astype(float)
    alike = own.astype(float) @ against.T  # kinds x patterns
    junk = np.where(against.sum(1) == 0, 0.02, np.where(alike.max(0) < 2, 0.3, 0.98))
    resp = junk * (alike + 1e-3) / (alike + 1e-3).sum(0)
    for _ in range(ROUNDS):
        good = n * (1 - resp.sum(0))
        share = min(max(good.sum() / total, low), high)
        said, no = good @ voted + PRIOR, good @ against + PRIOR * low
        wrong = np.clip(no / said, low, high)
        odds = []
        for k in range(len(resp)):
            w = n * resp[k]
            part = max(w.sum(), low) / total
            right = (w @ against + PRIOR / 2) / (w @ voted + PRIOR)
            right = np.clip(right, np.where(own[k], 0.5, low), high)
            no_odds, yes_odds = np.minimum(0, np.log(wrong / right)), np.maximum(0, np.log((1 - wrong) / (1 - right)))
            odds.append((math.log(share / part), [{-1: float(x), 0: 0.0, 1: float(y)} for x, y in zip(no_odds, yes_odds, strict=True)]))
        s = np.array([start + np.where(vote < 0, [o[-1] for o in each], np.where(vote > 0, [o[1] for o in each], 0.0)).sum(1) for start, each in odds])
        resp = np.exp(-np.clip(s, -500, 500))
        resp /= 1 + resp.sum(0)
    return float(share), odds


def posterior(vote: tuple[int, ...], share: float, odds: list[Odds]) -> float:
    s = (start + sum(o[v] for v, o in zip(vote, each, strict=True)) for start, each in odds)
    return 1 / (1 + sum(math.exp(-min(max(x, -500), 500)) for x in s))


def judge(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` (all but text if not given) with the counts, `posterior`,
    `base_failed` and `kept`."""
    own = {*BASE, *MORE, "posterior", "base_failed", "kept"}
    keep = [c for c in docs.columns if c not in own and c != "text"] if keep is None else keep
    rows = C.settle(features(docs, keep))
    rules = votes()
    counts = rows.groupBy(*(v.alias(f"_v_{k}") for k, v in rules.items())).count()
    # Bounded by the number of patterns, 3 ** len(rules), not by the rows.
    patterns = [(tuple(r[:-1]), r[-1]) for r in counts.collect()]
    share, odds = fit(patterns, len(rules))
    rows = rows.withColumns({f"_v_{k}": v for k, v in rules.items()})
    junk = F.lit(0.0)
    for start, each in odds:
        score = F.lit(start)
        for k, o in zip(rules, each, strict=True):
            score = score + F.when(F.col(f"_v_{k}") == -1, o[-1]).when(F.col(f"_v_{k}") == 1, o[1]).otherwise(o[0])
        junk = junk + F.exp(-score)
    rows = rows.withColumn("posterior", F.round(1 / (1 + junk), 6)).drop(*(f"_v_{k}" for k in rules)).withColumn("base_failed", base_failed())
    return rows.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= KEEP))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(C.documents(spark, sf_dir), ["doc_id"]).select("doc_id", *BASE, "base_failed", "kept", "posterior")


QUERIES = {"op9_quality_rules": op9_quality_rules}
ORACLES: dict[str, str] = {}
