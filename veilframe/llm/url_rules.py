"""URL filtering by listed rules and by mined association rules, in DataFrame functions only.

A URL's tokens are the runs of letters and digits of its lower-cased host and
path and the names of its query. Labelled URLs are transactions of tokens and a
label. A rule needs bad URLs that hold its tokens, so Spark's FP-growth mines
the combinations of those; the good URLs that hold one are counted then, and
rules are pruned by support, confidence and lift, and where a shorter one is as
sure. An inverted index from each rule's rarest token to the rules finds those
whose tokens a URL holds. Up to `max_rules` rules it is a literal, so judging is
one projection of the scan: no shuffle, whatever url is repeated however often.
More rules are a table, joined with the distinct sets of tokens.

A listed rule (host, path) fits its host and all subdomains if the url's path
starts with the rule's; of those that fit, the longest wins over any mined rule.
URLs that a listed rule fits are labelled by it (`listed_labels`); other labels
can be joined by id (`mine`).

No token, combination or rule is cut. What need not be looked at is left out: of
tokens that always occur together the least stands for all, and a token that bad
URLs alone hold is a rule by itself, which no longer one betters. Items are at
most the mean number of a URL's tokens over `min_support`; combinations are as
many as bad URLs have in common, in stored tables and never on the driver.

Defined results: a null url or one without `://` has an empty host and path, no
rule and no tokens, so it is allowed; without labels nothing is mined; rows are
independent, so repeated or null ids give a row each; an empty table gives an
empty table; other columns are ignored.
"""

from __future__ import annotations

import json
from math import ceil

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.cluster import merging
from veilframe.llm.common import checkpoint, col, join_groups, stored

#: (verdict, host, path)
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
#: A rule's tokens and label stand together in at least MIN_PAGES labelled pages, and this share of them.
MIN_SUPPORT = 0.0005
MIN_PAGES = 20
MIN_CONFIDENCE = 0.9
MIN_LIFT = 1.5
#: Rules up to which the index is a literal.
MAX_RULES = 500
#: Digits of the number before an item.
DIGITS = 12
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def after_scheme(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(after_scheme(url), r"^[^/?#]*", 0), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def listed(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as struct(length, rule, verdict); null if none fits."""
    fits = []
    for verdict, rule_host, rule_path in rules:
        name = rule_host + rule_path
        fit = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        fits.append(F.when(fit, F.struct(F.lit(len(name)).alias("length"), F.lit(name).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.array_max(F.array(*fits)) if fits else F.lit(None).cast("struct<length:int,rule:string,verdict:string>")


def tokens_of(url: Column) -> Column:
    """Distinct tokens in order; digits alone count as the token of their number of digits."""
    rest = F.lower(after_scheme(url))
    names = F.regexp_replace(rest, r"=[^&#]*", "")
    parts = F.filter(F.split(names, r"[^\p{L}\p{N}]+"), lambda t: t != "")
    return F.coalesce(F.array_distinct(F.transform(parts, lambda t: F.when(t.rlike(r"^[0-9]+$"), F.concat(F.lit("#"), F.length(t).cast("string"))).otherwise(t))), F.array().cast("array<string>"))


def listed_labels(pages: DataFrame, *, url_col: str = "url", rules=RULES) -> DataFrame:
    """(tokens, bad) of the pages that a listed rule judges."""
    urls = pages.select(col(url_col).alias("url")).select(tokens_of(F.col("url")).alias("tokens"), listed(host_of(F.col("url")), path_of(F.col("url")), rules).alias("best"))
    return urls.where(F.col("best").isNotNull()).select("tokens", (F.col("best.verdict") == "block").alias("bad"))


def mine(pages: DataFrame, labels: DataFrame, *, id_col: str = "page_id", url_col: str = "url", label_id: str = "doc_id", label_col: str = "quality", **bounds) -> DataFrame:
    """The rules mined from labels of the pages: a page is bad if its label is 0, or with several labels if all are."""
    known = labels.select(col(label_id).alias("lid"), (col(label_col) == 0).alias("bad")).where("lid IS NOT NULL AND bad IS NOT NULL").groupBy("lid").agg(F.min("bad").alias("bad"))
    rows = pages.select(col(id_col).alias("pid"), tokens_of(col(url_col)).alias("tokens"))
    return mine_labelled(rows.join(known, F.col("pid") == F.col("lid")).select("tokens", "bad"), **bounds)


def items_of(baskets: DataFrame, least: float) -> DataFrame:
    """(token, item, n, n_bad) of the tokens that at least `least` bad URLs hold; of tokens with one set of transactions the least stands for all.

    An item is its token behind its number of transactions, so items sort by rarity.
    """
    rows = baskets.select("bad", F.xxhash64("tokens").cast("decimal(20,0)").alias("h"), F.explode("tokens").alias("token"))
    counts = rows.groupBy("token").agg(F.count("*").alias("n"), F.sum(F.col("bad").cast("int")).alias("n_bad"), F.sum("h").alias("h")).where(F.col("n_bad") >= least)
    items = counts.groupBy("n", "n_bad", "h").agg(F.min("token").alias("token"))
    return items.select("token", F.concat(F.lpad(F.col("n").cast("string"), DIGITS, "0"), "token").alias("item"), "n", "n_bad")


def patterns(baskets: DataFrame, items: DataFrame, max_items: int | None) -> DataFrame:
    """(items, good, bad): the distinct sets of items of transactions, rarest first, and how many URLs of each label have them."""
    bad = F.col("bad").cast("int")
    urls = baskets.groupBy("tokens").agg(F.sum(1 - bad).alias("good"), F.sum(bad).alias("bad"))
    # At most the mean number of tokens over `min_support` items, so a broadcast stays small; their tokens are in very many URLs.
    each = urls.select("tokens", "good", "bad", F.explode("tokens").alias("token")).join(F.broadcast(items.select("token", "item")), "token")
    own = F.array_sort(F.collect_list("item"))
    sets = each.groupBy("tokens").agg((own if max_items is None else F.slice(own, 1, max_items)).alias("items"), F.first("good").alias("good"), F.first("bad").alias("bad"))
    return sets.groupBy("items").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"))


def frequent(sets: DataFrame, least: float) -> DataFrame:
    """(items, n_bad, n_good): the combinations of items that at least `least` bad URLs hold, and the numbers of URLs that do."""
    rows = sets.where("bad > 0").select("items", F.explode(F.sequence(F.lit(1), F.col("bad").cast("int"))).alias("_")).select("items")
    n = sets.agg(F.sum("bad")).first()[0]
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, (ceil(least - 1e-6) - 0.5) / n)).fit(rows)
    found = stored(model.freqItemsets.select(F.array_sort("items").alias("items"), F.col("freq").alias("n_bad")))
    good = sets.where("good > 0").select(F.explode("items").alias("item"), F.col("items").alias("held"), "good")
    met = good.join(merging(found.select(F.col("items")[0].alias("item"), "items")), "item").where(F.size(F.array_except("items", "held")) == 0)
    return found.join(merging(met.groupBy("items").agg(F.sum("good").alias("n_good"))), "items", "left").select("items", "n_bad", F.coalesce("n_good", F.lit(0)).alias("n_good"))


def mine_labelled(
    labelled: DataFrame,
    *,
    min_support: float = MIN_SUPPORT,
    min_pages: int = MIN_PAGES,
    min_confidence: float = MIN_CONFIDENCE,
    min_lift: float = MIN_LIFT,
    max_items: int | None = None,
) -> DataFrame:
    """(tokens, confidence, support, lift) of all rules that imply block, from (tokens, bad); rarest tokens first.

    `max_items` is for callers that want rules of each URL's rarest items only.
    """
    baskets = checkpoint(labelled.where(F.size("tokens") > 0))
    n, base = baskets.agg(F.count("*"), F.avg(F.col("bad").cast("double"))).first()
    least = max(min_pages, min_support * n, 1)
    # Where even a sure rule has too little lift there is none.
    items = stored(items_of(baskets.where(F.lit(bool(n and base and 1 / base >= min_lift))), least - 1e-6))
    # No longer rule is surer than a token that bad URLs alone hold.
    found = items.where("n_bad = n").select(F.array("item").alias("items"), "n_bad", F.lit(0).cast("long").alias("n_good"))
    sets = stored(patterns(baskets, items.where("n_bad < n"), max_items))
    if not sets.where("bad > 0").isEmpty():
        found = found.unionByName(frequent(sets.where("size(items) > 0"), least))
    confidence = F.col("n_bad") / (F.col("n_bad") + F.col("n_good"))
    found = found.select("items", confidence.alias("confidence"), (F.col("n_bad") / F.lit(n)).alias("support"), (confidence / F.lit(base)).alias("lift"))
    found = stored(found.where((F.col("confidence") >= min_confidence) & (F.col("lift") >= min_lift)))
    # A rule goes if one with a token fewer is as sure.
    parts = found.select("items", "confidence", F.explode("items").alias("out")).select("items", "confidence", F.array_except("items", F.array("out")).alias("part")).where(F.size("part") > 0)
    shorter = found.select(F.col("items").alias("part"), F.col("confidence").alias("sure"))
    redundant = parts.join(merging(shorter), "part").where("sure >= confidence").select("items")
    rules = found.join(merging(redundant), "items", "left_anti")
    return stored(rules.select(F.transform("items", lambda i: F.substr(i, F.lit(DIGITS + 1), F.length(i))).alias("tokens"), "confidence", "support", "lift"))


def matched(tokens: Column, rules: list[list[str]]) -> Column:
    """Whether the tokens hold all tokens of some rule: each token's rules stand under it in an index by first, rarest token."""
    if not rules:
        return F.lit(False)
    index: dict[str, list[list[str]]] = {}
    for r in rules:
        index.setdefault(r[0], []).append(r)
    below = F.from_json(F.lit(json.dumps(index)), "map<string,array<array<string>>>")
    holds = lambda need: F.size(F.array_except(need, tokens)) == 0
    return F.exists(tokens, lambda t: F.coalesce(F.exists(F.try_element_at(below, t), holds), F.lit(False)))


def matched_many(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """(tokens): the distinct sets of tokens that hold all tokens of some rule; the index is a table, joined by each rule's rarest token."""
    index = stored(rules.select(F.col("tokens")[0].alias("token"), F.col("tokens").alias("need")))
    each = rows.select("tokens").distinct().select(F.explode("tokens").alias("token"), "tokens").join(merging(index.select("token").distinct()), "token", "left_semi")
    each = stored(each)
    sizes = each.groupBy("token").agg(F.count("*").alias("rows"))
    met = join_groups(each, index.join(merging(sizes), "token"), ["token"], "rows", ["tokens"])
    return met.where(F.size(F.array_except("need", "tokens")) == 0).select("tokens").distinct()


def judge(pages: DataFrame, rules: DataFrame, *, id_col: str = "page_id", url_col: str = "url", listed_rules=RULES, max_rules: int = MAX_RULES) -> DataFrame:
    """(id, host, path, rule, verdict, mined): mined tells whether a mined rule speaks for blocking; up to `max_rules` rules are a literal, more are joined."""
    first = [r["tokens"] for r in rules.select("tokens").limit(max_rules + 1).collect()]
    rows = pages.select(col(id_col).alias("pid"), col(url_col).alias("url"), tokens_of(col(url_col)).alias("tokens"))
    if len(first) <= max_rules:
        rows = rows.withColumn("mined", matched(F.col("tokens"), first))
    else:
        hits = matched_many(rows, rules).withColumn("_hit", F.lit(True))
        rows = rows.join(merging(hits), "tokens", "left").withColumn("mined", F.col("_hit").isNotNull())
    out = rows.select("pid", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "mined")
    out = out.withColumn("best", listed(F.col("host"), F.col("path"), listed_rules))
    verdict = F.coalesce(F.col("best.verdict"), F.when(F.col("mined"), "block").otherwise("allow"))
    return out.select(F.col("pid").alias(id_col), "host", "path", F.col("best.rule").alias("rule"), verdict.alias("verdict"), "mined")
