"""Fuzzy names of one table against texts of another, as a join.

A pair is a hit if its token-set ratio or its partial ratio reaches the
threshold. Both are ratios of an edit distance of insertions and deletions, so
a hit bounds the number of edits, and every edit spoils few parts of a string:

* two-letter grams: an edit spoils at most two, so with k edits all but 2k of a
  string's distinct grams stand in the other, and of the rarest 2k + 1 at least
  one does;
* where that leaves no gram (short strings, low thresholds), letters numbered by
  occurrence: an edit spoils one, so of the rarest k + 1 one stands in the other;
* words, for the token-set ratio: it is high without a like remainder only if
  the shared words make up most of one side, so of that side's rarest words, as
  many as cannot all be missing, one is shared.

Each string so has a few probe keys, its rarest, and the other side is joined
with all of its keys; which side probes follows from the lengths. What is left
after bounds on lengths and counts of shared letters is scored exactly. Strings
are made distinct before, and hot keys are dealt out.
"""

from __future__ import annotations

from math import floor

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.cluster import grams, join_groups, merging, ship, stored
from veilframe.functions import fuzzy

#: Roundings of a threshold must not lose a pair.
SLACK = 1e-9


def edits(length: Column, threshold: float) -> Column:
    """Edits that a window as long as the string can be away at the threshold."""
    return F.least(length, F.floor(length * (2 * (1 - threshold)) + SLACK)).cast("int")


def words_of(text: Column) -> Column:
    return F.array_distinct(F.filter(F.split(text, r"\s+"), lambda w: w != ""))


def set_sizes(term: Column, text: Column) -> tuple[Column, Column, Column]:
    """The numbers of distinct words that both have, that only the text has, and that only the term has."""
    x, y = words_of(term), words_of(text)
    return F.size(F.array_intersect(x, y)), F.size(F.array_except(y, x)), F.size(F.array_except(x, y))


def letter_keys(text: Column) -> Column:
    """Each letter but blanks, numbered by occurrence."""
    letters = F.array_sort(F.split(F.regexp_replace(text, r"\s+", ""), ""))
    first = F.transform(letters, lambda c, i: F.concat(F.lit("1"), c, (i + 2 - F.array_position(letters, c)).cast("string")))
    return F.when(F.length(F.regexp_replace(text, r"\s+", "")) > 0, first).otherwise(F.array().cast("array<string>"))


def gram_keys(text: Column) -> Column:
    return F.array_distinct(F.transform(grams(text, 2), lambda g: F.concat(F.lit("2"), g)))


def word_grams(text: Column) -> Column:
    """Grams that lie within a word."""
    return F.array_distinct(F.flatten(F.transform(words_of(text), lambda w: F.transform(grams(w, 2), lambda g: F.concat(F.lit("2"), g)))))


def all_keys(text: Column) -> Column:
    return F.array_distinct(F.concat(gram_keys(text), letter_keys(text), F.transform(words_of(text), lambda w: F.concat(F.lit("w"), w))))


def chosen_rarest(strings: DataFrame, counts: DataFrame, keys: Column, needed: Column, weight: Column | None = None) -> DataFrame:
    """(text, key): of each string's keys the rarest, as many as `needed`, or until their weights exceed it."""
    each = strings.select("text", keys.alias("keys"), needed.alias("needed")).select("text", "needed", F.explode("keys").alias("key"))
    weighed = each.join(merging(counts), "key", "left").groupBy("text").agg(F.first("needed").alias("needed"), F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "key"))).alias("keys"))
    if weight is None:
        return weighed.select("text", F.explode(F.slice("keys", F.lit(1), F.greatest(F.col("needed"), F.lit(1)))).alias("k")).select("text", "k.key")
    # A word counts while the rarer ones before it could all be missing.
    before = lambda i: F.aggregate(F.slice("keys", F.lit(1), i), F.lit(0), lambda a, k: a + F.length(k["key"]))
    kept = F.filter(F.transform("keys", lambda k, i: F.struct(k["key"].alias("key"), before(i).alias("before"))), lambda k: k["before"] <= F.col("needed"))
    return weighed.select("text", F.explode(kept).alias("k")).select("text", "k.key")


def probes(strings: DataFrame, counts: DataFrame, threshold: float, *, sets: bool) -> DataFrame:
    """(text, key): keys of which every string that the text fits has one; `sets` also for pairs alike in their whole sets of words."""
    text, size = F.col("text"), F.length("text")
    k = edits(size, threshold)
    whole = F.size(gram_keys(text)) > 2 * k
    out = chosen_rarest(strings.where(whole), counts, gram_keys(text), 2 * k + 1).unionByName(chosen_rarest(strings.where(~whole), counts, letter_keys(text), k + 1))
    joined = F.length(F.array_join(words_of(text), " "))
    # The shared words are `t / (2 - t)` of one side at least, so what misses, a blank with each word, is not more than the rest.
    allowed = F.floor(joined * ((2 - 2 * threshold) / (2 - threshold)) + SLACK).cast("int")
    out = out.unionByName(chosen_rarest(strings, counts, F.transform(words_of(text), lambda w: F.concat(F.lit("w"), w)), allowed, F.lit(1)))
    if sets:
        longest = F.floor(joined * ((2 - threshold) / threshold) + SLACK) if threshold > 0 else F.lit(1 << 30)
        e = F.least(joined, F.floor((joined + longest) * (1 - threshold) + SLACK)).cast("int")
        able = F.size(word_grams(text)) > 2 * e
        out = out.unionByName(chosen_rarest(strings.where(able), counts, word_grams(text), 2 * e + 1)).unionByName(chosen_rarest(strings.where(~able), counts, letter_keys(text), e + 1))
    return out.distinct()


def candidates(terms: DataFrame, texts: DataFrame, threshold: float, *, heavy: int | None = None) -> DataFrame:
    """(term, text): pairs of distinct strings that hold every hit. Columns `text` on both sides."""
    keyed = lambda df: df.select("text", F.explode(all_keys(F.col("text"))).alias("key"))
    counts = stored(keyed(texts).groupBy("key").agg(F.count("*").alias("n")))
    own = stored(keyed(terms).groupBy("key").agg(F.count("*").alias("n")))
    by_term = probes(terms, counts, threshold, sets=True).withColumnRenamed("text", "term")
    by_text = probes(texts, own, threshold, sets=False)
    one = join_groups(keyed(texts), by_term.join(merging(counts), "key"), ["key"], "n", ["text"], heavy=heavy).select("term", "text")
    two = join_groups(keyed(terms).withColumnRenamed("text", "term"), by_text.join(merging(own), "key"), ["key"], "n", ["term"], heavy=heavy).select("term", "text")
    pairs = one.unionByName(two).distinct()
    term, text = F.col("term"), F.col("text")
    long_enough = F.length(F.trim(text)) >= F.greatest(F.length(term) * 0.5, F.lit(3.0))
    # Letters of the shorter string that the other lacks are edits of any window.
    short = F.when(F.length(term) <= F.length(text), term).otherwise(text)
    partial = F.size(F.array_except(letter_keys(short), F.when(F.length(term) <= F.length(text), letter_keys(text)).otherwise(letter_keys(term)))) <= edits(F.length(short), threshold)
    x, y = words_of(term), words_of(text)
    line = lambda words: F.array_join(words, " ")
    both = F.array_intersect(x, y)
    one, two, common = F.length(line(x)), F.length(line(y)), F.length(line(both))
    n_both, n_text, n_term = set_sizes(term, text)
    subset = (n_both > 0) & ((n_text == 0) | (n_term == 0))
    cover = (F.size(both) > 0) & (common * (2 - threshold) >= threshold * F.least(one, two) - SLACK)
    shared = F.size(F.array_intersect(letter_keys(line(x)), letter_keys(line(y)))) + F.least(F.size(x), F.size(y))
    alike = 2 * F.least(one, two, shared) >= threshold * (one + two) - SLACK
    return pairs.where(long_enough & (partial | subset | cover | alike))


def similar(terms: DataFrame, texts: DataFrame, threshold: float = 0.85, *, heavy: int | None = None) -> DataFrame:
    """(term, text, token_set, partial) of every pair of distinct lower-case strings of the columns `text` that reaches the threshold.

    As in detection, a text shorter than half its term or than three letters is no hit. Nulls and blank strings are left out.
    """
    if not 0 < threshold <= 1:
        raise ValueError("a threshold lies over 0 and up to 1")
    ship(terms.sparkSession)
    clean = lambda df: stored(df.select(F.lower("text").alias("text")).where("trim(text) <> ''").distinct())
    pairs = candidates(clean(terms), clean(texts), threshold, heavy=heavy)

    @F.pandas_udf("struct<token_set:double,partial:double>")
    def scored(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        needles: dict[str, fuzzy.Needle] = {}
        rows = []
        for x, y in zip(a, b, strict=True):
            if (needle := needles.get(x)) is None:
                needle = needles[x] = fuzzy.Needle(x, threshold)
            # Exact scores only where one reaches the threshold by the bit-parallel scan.
            hit = needle.same_words(y) or needle.partial(y) >= 100 * threshold
            rows.append((fuzzy.token_set_ratio(x, y), fuzzy.partial_ratio(x, y)) if hit else (None, None))
        return pd.DataFrame(rows, columns=["token_set", "partial"])

    found = pairs.select("term", "text", scored("term", "text").alias("s"))
    return found.select("term", "text", "s.*").where(F.greatest("token_set", "partial") >= 100 * threshold)
