"""Exact terms of very many subjects against spans.

The terms of all profiles make one dictionary, in which a term that several
subjects share stands once. A term is looked up by keys: its words, or runs of
letters of it where it may lie inside a word or be broken by blanks, dashes and
dots. Keys of spans are counted against the dictionary; each term is then
joined by its rarest key alone, a term with a key that no span holds is not
joined at all, and the whole term is checked on what is left. All joins are on
equal keys, hot keys are dealt out, and all of it is built-in expressions.

Subjects that share a term are a class: `find_classes` gives each hit once, with
the class, and `members` says who is in it, so a name that very many share in
very many spans is not multiplied out. `find_terms` gives a row for each subject.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.cluster import grams, join_groups, merging, stored
from veilframe.functions import text as X
from veilframe.operators.detect import detections, empty, hidden_box, hit

#: How a term is searched: whole words in a row, letters and digits with separators between, or as it is in either case.
WORDS, SPACED, LITERAL = "words", "spaced", "literal"
KEY = ["doc_id", "page_num", "ord"]
TERM = ["entity", "kind", "norm"]


@dataclass
class Dictionary:
    """`terms` (entity, kind, norm, pattern, keys), each once, and `owners` (entity, kind, norm, subject_id, keep)."""

    terms: DataFrame
    owners: DataFrame


def letters(text: Column) -> Column:
    return F.lower(X.alphanumerics(text))


def entries(subjects: DataFrame, id_col: str, least: int) -> DataFrame:
    """(subject_id, entity, kind, value, keep) of every exact value in a subject struct."""
    s = F.col("subject")
    of = lambda entity, kind, value, keep=0: F.struct(
        F.lit(entity).alias("entity"), F.lit(kind).alias("kind"), value.alias("value"), (F.lit(keep) if isinstance(keep, int) else keep).cast("int").alias("keep")
    )
    each = lambda name, entity, kind: F.transform(F.coalesce(s[name], F.array().cast("array<string>")), lambda v: of(entity, kind, v))
    names = F.filter(F.concat(F.array(s["display_name"]), F.coalesce(s["aliases"], F.array().cast("array<string>"))), lambda n: X.has_full_token(n, least))
    accounts = F.coalesce(s["account_numbers"], F.array().cast("array<struct<value:string,preserve_last:int>>"))
    every = F.concat(
        F.transform(names, lambda n: of("PERSON", WORDS, n)), each("phones", "PHONE_NUMBER", SPACED), each("ssns", "US_SSN", SPACED), each("emails", "EMAIL_ADDRESS", LITERAL),
        F.transform(accounts, lambda a: of("ACCOUNT_NUMBER", SPACED, a["value"], a["preserve_last"])),
    )
    return subjects.select(F.col(id_col).alias("subject_id"), F.explode(every).alias("e")).select("subject_id", "e.*").where("value IS NOT NULL AND (entity NOT IN ('PHONE_NUMBER', 'US_SSN') OR value RLIKE '[0-9]')")


def term_keys(kind: Column, value: Column) -> Column:
    """Keys of which a span with the term has every one."""
    squeezed = letters(value)
    runs = F.regexp_extract_all(squeezed, F.lit("[0-9]+"), F.lit(0))
    run = F.coalesce(F.array_max(F.transform(runs, lambda r: F.struct(F.length(r).alias("n"), r.alias("r"))))["r"], F.lit(""))
    n = F.length(run)
    parts = lambda mark, text, size: F.transform(grams(text, size), lambda g: F.concat(F.lit(mark), g))
    short = F.when(F.length(squeezed) >= 3, parts("3", squeezed, 3)).when(F.length(squeezed) == 2, parts("2", squeezed, 2)).otherwise(parts("1", squeezed, 1))
    words = F.transform(X.tokens(value), lambda t: F.concat(F.lit("w"), t))
    # The first and last word of a literal may be parts of longer ones.
    inner = F.slice(words, F.lit(2), F.greatest(F.size(words) - 2, F.lit(0)))
    spaced = F.when(n >= 8, parts("D", run, 8)).when(n >= 4, parts("d", run, 4)).otherwise(short)
    return F.array_distinct(F.when(kind == WORDS, words).when(kind == SPACED, spaced).when(F.size(inner) > 0, inner).otherwise(short))


def span_keys(text: Column, marks: set[str]) -> Column:
    """The keys of a text, of the kinds that the dictionary has."""
    runs = F.transform(F.regexp_extract_all(text, F.lit(r"[0-9](?:[\s\-.()]*[0-9])*"), F.lit(0)), lambda r: F.regexp_replace(r, "[^0-9]", ""))
    tagged = lambda mark, parts: F.transform(parts, lambda g: F.concat(F.lit(mark), g))
    own = {
        "w": lambda: X.tokens(text), "D": lambda: F.flatten(F.transform(runs, lambda r: grams(r, 8))), "d": lambda: F.flatten(F.transform(runs, lambda r: grams(r, 4))),
        "3": lambda: grams(letters(text), 3), "2": lambda: grams(letters(text), 2), "1": lambda: grams(letters(text), 1),
    }
    return F.array_distinct(F.concat(F.array().cast("array<string>"), *[tagged(m, own[m]()) for m in sorted(marks)]))


def dictionary(subjects: DataFrame, *, id_col: str = "subject_id", least: int = 2) -> Dictionary:
    """The exact terms of subjects (id, `subject` struct); names have a word of `least` letters, values without a letter or digit are no terms."""
    rows = entries(subjects, id_col, least)
    value, kind = F.col("value"), F.col("kind")
    chars = F.split(X.alphanumerics(value), "")
    between = F.when(F.col("entity") == "ACCOUNT_NUMBER", r"[\s\-.]*").otherwise(r"[\s\-.()]*")
    # array_join takes no column as its separator.
    spaced = F.concat(F.lit("(?i)"), F.replace(F.array_join(chars, "\x00"), F.lit("\x00"), between))
    pattern = F.when(kind == SPACED, spaced).when(kind == LITERAL, F.concat(F.lit("(?i)"), F.regexp_replace(value, r"([^\w\s])", r"\\$1")))
    norm = F.when(kind == WORDS, F.array_join(X.tokens(value), " ")).when(kind == SPACED, letters(value)).otherwise(F.lower(value))
    # Read several times, and made of few files where subjects are narrow.
    rows = rows.select("subject_id", "entity", "kind", norm.alias("norm"), pattern.alias("pattern"), "keep", term_keys(kind, value).alias("keys")).where("size(keys) > 0")
    rows = stored(rows)
    terms = stored(rows.groupBy(*TERM).agg(F.min("pattern").alias("pattern"), F.min("keys").alias("keys")))
    return Dictionary(terms, rows.select(*TERM, "subject_id", "keep").distinct())


def located(spans: DataFrame, marks: set[str]) -> DataFrame:
    return spans.select(*KEY, F.explode(span_keys(F.col("text"), marks)).alias("key"))


def rarest(spans: DataFrame, terms: DataFrame, marks: set[str]) -> DataFrame:
    """(entity, kind, norm, pattern, key, n): each term that spans may hold, by its rarest key and the number of spans with it."""
    each = terms.select(*TERM, "pattern", F.size("keys").alias("needs"), F.explode("keys").alias("key"))
    known = each.select("key").distinct()
    counts = stored(located(spans, marks).join(merging(known), "key", "left_semi").groupBy("key").agg(F.count("*").alias("n")))
    best = each.join(merging(counts), "key").groupBy(*TERM).agg(F.min("pattern").alias("pattern"), F.min("needs").alias("needs"), F.count("*").alias("has"), F.min(F.struct("n", "key")).alias("best"))
    return best.where("has = needs").select(*TERM, "pattern", F.col("best.key").alias("key"), F.col("best.n").alias("n"))


def classes(book: Dictionary) -> DataFrame:
    """(entity, kind, norm, keep, term, representative, subjects): subjects that share a term and how much of it stays."""
    return book.owners.groupBy(*TERM, "keep").agg(F.first("norm").alias("term"), F.min("subject_id").alias("representative"), F.count("*").alias("subjects"))


def members(book: Dictionary) -> DataFrame:
    """(entity_type, term, preserve_last, representative, subjects, subject_id): every subject of each class."""
    each = book.owners.join(merging(classes(book)), [*TERM, "keep"])
    return each.select(F.col("entity").alias("entity_type"), "term", F.col("keep").alias("preserve_last"), "representative", "subjects", "subject_id")


def located_terms(spans: DataFrame, book: Dictionary, owners: DataFrame, *, heavy: int | None = None) -> DataFrame | None:
    """Detections of the dictionary's terms with the columns of `owners`, a row for each of a term's; none without terms."""
    marks = {r["m"] for r in book.terms.select(F.explode("keys").alias("k")).select(F.substring("k", 1, 1).alias("m")).distinct().collect()}
    if not marks:
        return None
    chosen = stored(rarest(spans, book.terms, marks))
    candidates = join_groups(located(spans, marks), chosen, ["key"], "n", KEY, heavy=heavy).select(*KEY, *TERM, "pattern", "n")
    text = F.col("text")
    padded = F.concat(F.lit(" "), F.array_join(X.tokens(text), " "), F.lit(" "))
    held = F.contains(padded, F.concat(F.lit(" "), F.col("norm"), F.lit(" "))) & ~X.is_corporate(text)
    whole = F.array(F.struct(F.lit(0).alias("start"), text.alias("match")))
    none = F.array().cast(X.MATCHES)
    met = spans.join(merging(candidates), KEY)
    found = F.when(F.col("kind") == WORDS, F.when(held, whole).otherwise(none)).otherwise(X.matches(text, F.col("pattern")))
    hits = met.withColumn("hit", F.explode(found))
    owned = join_groups(hits, owners.join(merging(chosen.select(*TERM, F.col("n").alias("spans"))), TERM), TERM, "spans", KEY, heavy=heavy)
    keep = F.col("keep")
    hidden = X.hidden_length(F.col("hit.match"), keep)
    box = F.when(hidden.isNotNull(), hidden_box(F.col("bbox"), text, F.col("hit.start"), hidden)).otherwise(F.col("bbox"))
    one = hit(F.col("entity"), F.col("hit.match"), F.col("hit.start"), bbox=box, keep=keep)
    return detections(owned.withColumn("_hits", F.array(one)), *[c for c in owners.columns if c not in (*TERM, "keep")])


def find_classes(spans: DataFrame, book: Dictionary, *, heavy: int | None = None) -> DataFrame:
    """Detections of the dictionary's terms, one a match and class: with its `term`, its least subject as `representative` and the number of its `subjects`.

    The class is (entity_type, term, preserve_last), as in `members`. Subjects reached by several names in one span are in a class of each.
    """
    own = classes(book)
    found = located_terms(spans, book, own, heavy=heavy)
    return empty(spans).select("*", *[F.lit(None).cast(own.schema[c].dataType).alias(c) for c in ("term", "representative", "subjects")]) if found is None else found


def find_terms(spans: DataFrame, book: Dictionary, *, heavy: int | None = None) -> DataFrame:
    """Detections of every subject's exact terms, with `subject_id`: a name hides its span, a value its match.

    As for one profile, a span gives a subject one PERSON at most and spans that end like a company none.
    """
    out = located_terms(spans, book, book.owners, heavy=heavy)
    if out is None:
        return empty(spans).withColumn("subject_id", F.lit(None).cast("string"))
    # One PERSON a span and subject, however many of its names are there.
    people = out.where("entity_type = 'PERSON'").dropDuplicates([*KEY, "subject_id"])
    return out.where("entity_type <> 'PERSON'").unionByName(people)
