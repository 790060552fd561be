"""Scalar expressions over span text, all of them Spark built-ins."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]+"

#: Last words that mark a company.
CORPORATE = "inc corp llc ltd co company corporation industries group associates partners holdings enterprises services solutions".split()


def tokens(text: Column) -> Column:
    """Lower-cased words."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def is_corporate(text: Column) -> Column:
    """Whether the last word marks a company."""
    edge = r"[^\p{L}\p{N}_]"
    return F.coalesce(F.lower(text).rlike(rf"(?:^|{edge})(?:{'|'.join(CORPORATE)}){edge}*\z"), F.lit(False))


def has_full_token(text: Column, least: int) -> Column:
    return F.exists(tokens(text), lambda t: F.length(t) >= least)


def is_single_token(text: Column) -> Column:
    return F.size(tokens(text)) == 1


def quote(term: str) -> str:
    """A literal as a regex that Java and RE2 read alike."""
    return re.sub(r"([^\w\s])", r"\\\1", term)


def word_pattern(term: str) -> str:
    """The term between edges of words, in either case; word characters are those of WORD."""
    return rf"(?i)(?:^|[^\p{{L}}\p{{N}}_]){quote(term.lower())}(?:$|[^\p{{L}}\p{{N}}_])"


def has_word(text: Column, term: str) -> Column:
    return F.lower(text).rlike(word_pattern(term))


def long_enough(text: Column, term: str) -> Column:
    return F.length(F.trim(F.lower(text))) >= max(0.5 * len(term), 3.0)


def is_numeric_token(text: Column) -> Column:
    return F.translate(text, "-., ", "").rlike("^[0-9]+$")


def alphanumerics(text: Column) -> Column:
    return F.regexp_replace(text, "[^A-Za-z0-9]", "")


def account_pattern(value: str) -> str:
    """Letters and digits of the value with blanks, dashes and dots between, in either case."""
    return r"(?i)" + r"[\s\-.]*".join(re.sub("[^A-Za-z0-9]", "", value))


def account_matches(text: Column, value: str) -> Column:
    """array<struct<start, match>>: all occurrences, start counted from 0."""
    if not re.sub("[^A-Za-z0-9]", "", value):
        return F.array().cast(MATCHES)
    return matches(text, account_pattern(value))


MATCHES = "array<struct<start:int,match:string>>"


def matches(text: Column, pattern: str | Column) -> Column:
    """array<struct<start, match>> of every match: the lengths of the parts between give the starts.

    The text is searched only where it matches at all, and its parts are bound to a variable, so they are made once.
    """
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    parts = F.struct(F.regexp_extract_all(text, pattern, F.lit(0)).alias("found"), F.split(text, pattern, -1).alias("between"))
    state = F.struct(F.lit(0).alias("at"), F.array().cast(MATCHES).alias("out"))

    def placed(p):
        def step(s, f):
            start = s["at"] + F.length(f["between"])
            hit = F.array(F.struct(start.alias("start"), f["found"].alias("match")))
            return F.struct((start + F.length(f["found"])).alias("at"), F.concat(s["out"], hit).alias("out"))

        pairs = F.zip_with(p["found"], F.slice(p["between"], F.lit(1), F.size(p["found"])), lambda f, b: F.struct(f.alias("found"), b.alias("between")))
        return F.aggregate(pairs, state, step, lambda s: s["out"])

    return F.when(F.rlike(text, pattern), F.transform(F.array(parts), placed)[0]).otherwise(F.array().cast(MATCHES))


def hidden_length(match: Column, keep: int | Column) -> Column:
    """Characters to hide at the match's start so that `keep` digits stay; null where all of it goes.

    Letters are not counted: what is hidden ends with the (keep + 1)-th digit from the end.
    """
    keep = F.lit(keep) if isinstance(keep, int) else keep
    digits = F.filter(F.sequence(F.lit(1), F.greatest(F.length(match), F.lit(1))), lambda i: F.substr(match, i, F.lit(1)).rlike("[0-9]"))
    return F.when(keep > 0, F.try_element_at(digits, -(keep + 1)))


def mask_account(value: Column, keep: int = 4) -> Column:
    """X for all digits but the last `keep`; other characters as they are."""
    chars = F.split(value, "")
    total = F.length(F.regexp_replace(value, "[^0-9]", ""))

    def shown(c, i):
        before = F.length(F.regexp_replace(F.substr(value, F.lit(1), i), "[^0-9]", ""))
        return F.when(c.rlike("[0-9]") & (before < total - keep), "X").otherwise(c)

    return F.when(value == "", value).otherwise(F.array_join(F.transform(chars, shown), ""))


def mask_tail(value: Column, keep: int = 4) -> Column:
    return F.concat(F.repeat(F.lit("*"), F.greatest(F.length(value) - keep, F.lit(0))), F.right(value, F.lit(keep)))


def mask_name(name: Column) -> Column:
    parts = F.filter(F.split(F.trim(name), r"\s+"), lambda p: p != "")
    return F.array_join(F.transform(parts, lambda p: F.when(F.length(p) > 1, F.concat(F.left(p, F.lit(1)), F.lit("***"))).otherwise(p)), " ")


def mask_subject(subject: Column) -> Column:
    """A subject struct for display: names to initials, other values to their last four characters."""
    tails = lambda c: F.transform(subject[c], lambda v: mask_tail(v))
    account = lambda a: F.struct(mask_tail(a["value"]).alias("value"), a["preserve_last"].alias("preserve_last"))
    return F.struct(
        mask_name(subject["display_name"]).alias("display_name"), F.transform(subject["aliases"], lambda a: mask_name(a)).alias("aliases"), tails("addresses").alias("addresses"), tails("phones").alias("phones"),
        tails("emails").alias("emails"), tails("ssns").alias("ssns"), F.transform(subject["account_numbers"], account).alias("account_numbers"), subject["custom_patterns"].alias("custom_patterns"),
    )


#: Error classes, what their messages hold, and the way out.
ERROR_CLASSES = (
    ("no_text", None, "OCR_REQUIRED", "Re-run without --no-ocr (OCR is on by default)"),
    ("extraction", "encrypted", "ENCRYPTED", "Decrypt the PDF first, then re-run"),
    ("extraction", "permission|access", "PERMISSION", "Check file permissions (needs read access)"),
    ("extraction", None, "CORRUPT", "File may be corrupt; try re-exporting from source"),
)
UNKNOWN_ERROR = ("UNKNOWN", "Run with --debug for full stack trace")


def error_class(kind: Column, message: Column) -> tuple[Column, Column]:
    """(category, mitigation) from the kind of failure and its message."""
    category = mitigation = None
    for k, pattern, c, m in ERROR_CLASSES:
        fits = (kind == k) & (F.lower(F.coalesce(message, F.lit(""))).rlike(pattern) if pattern else F.lit(True))
        category = F.when(fits, c) if category is None else category.when(fits, c)
        mitigation = F.when(fits, m) if mitigation is None else mitigation.when(fits, m)
    return category.otherwise(UNKNOWN_ERROR[0]), mitigation.otherwise(UNKNOWN_ERROR[1])


def status_icon(passed: Column, detections: Column) -> Column:
    return F.when(passed == F.lit(False), "✗").when(detections == 0, "⚪").otherwise("✓")


def verification_icon(passed: Column) -> Column:
    return F.when(passed.isNull(), "—").when(passed, "✅").otherwise("❌")


def vault_id(path: Column) -> Column:
    return F.substring(F.sha2(path, 256), 1, 16)


def iso(ts: Column) -> Column:
    """A UTC timestamp as 2024-01-31T12:34:56+00:00."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
