"""Detectors: spans against a profile.

The profile is tens of values validated on the driver, so its terms are literals
in expressions over the spans: there is no join to plan, and each pattern is
compiled once a task. A detector is an expression that gives a span's hits as an
array, behind cheap conditions; detectors run together are one array, exploded
once, over one scan. Fuzzy names are the one Python stage of it and get only
spans that no built-in test has settled. Addresses look at neighbouring lines,
so they are a plan of their own.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilframe.cluster import merging, ship, stored
from veilframe.functions import address as A
from veilframe.functions import fuzzy
from veilframe.functions import text as X
from veilframe.operators.tagger import ENTITIES as TAGGED
from veilframe.operators.tagger import Tagger
from veilframe.profile import AccountNumber, CustomPattern, Profile, name_terms

COLUMNS = ["doc_id", "page_num", "ord", "text", "entity_type", "score", "bbox", "preserve_last", "detector", "start", "size"]

#: Rule recognisers: the entity, its pattern, and whether a Luhn check follows. Patterns mean the same in Java and RE2.
RECOGNISERS = {
    "EMAIL_ADDRESS": r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}",
    "PHONE_NUMBER": r"\+?[0-9]{1,2}[ .\-]?\([0-9]{3}\)[ .\-]?[0-9]{3}[ .\-][0-9]{4}|\([0-9]{3}\)[ .\-]?[0-9]{3}[ .\-][0-9]{4}|\b[0-9]{3}[.\-][0-9]{3}[.\-][0-9]{4}\b",
    "US_SSN": r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b",
    "CREDIT_CARD": r"\b[0-9]{13,16}\b",
    "IP_ADDRESS": r"\b[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b",
    "DATE_TIME": r"\b[0-9]{4}-[0-9]{2}-[0-9]{2}\b|\b[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}\b",
    "URL": r"https?://[^\s<>\"]+",
}
DEFAULT_ENTITIES = list(RECOGNISERS)
#: By name only: persons behind a form of address, and house numbers with a street.
RECOGNISERS |= {
    "PERSON": r"\b(?:Mr|Mrs|Ms|Dr|Prof)\.? [A-Z][A-Za-z]+(?: [A-Z][A-Za-z]+){0,2}",
    "LOCATION": r"\b[0-9]+ [A-Z][a-z]+(?: [A-Z][a-z]+){0,2} (?:Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Drive|Dr|Boulevard|Blvd)\b",
}
#: What a text needs for a match at all: letters that it holds, and a run of so many digits.
GATES = {"EMAIL_ADDRESS": ("@", 0), "PHONE_NUMBER": ("", 4), "US_SSN": ("-", 4), "CREDIT_CARD": ("", 13), "IP_ADDRESS": (".", 1), "DATE_TIME": ("", 4), "URL": ("://", 0), "PERSON": (" ", 0), "LOCATION": (" ", 1)}

#: Texts whose score a task remembers, so an address that many documents have is scored once a task.
KNOWN_TEXTS = 50_000

BOX = "struct<x0:double,y0:double,x1:double,y1:double>"
HITS = f"array<struct<entity:string,text:string,score:double,bbox:{BOX},keep:int,detector:string,start:int,size:int>>"


def hit(entity: Column | str, match: Column, start: Column, *, score: Column | float = 1.0, bbox: Column | None = None, keep: Column | int = 0, detector: str = "profile") -> Column:
    """One element of a hit array: the matched text, its place in the span, and the box to paint."""
    lit = lambda v, t: (v if isinstance(v, Column) else F.lit(v)).cast(t)
    box = F.col("bbox") if bbox is None else bbox
    return F.struct(
        lit(entity, "string").alias("entity"), match.alias("text"), lit(score, "double").alias("score"), box.alias("bbox"), lit(keep, "int").alias("keep"),
        F.lit(detector).alias("detector"), start.cast("int").alias("start"), F.length(match).alias("size"),
    )


def no_hits() -> Column:
    return F.array().cast(HITS)


def together(hits: list[Column]) -> Column:
    return F.concat(no_hits(), *hits)


def detections(found: DataFrame, *more: str) -> DataFrame:
    """A row for each element of a span's `_hits`, with the columns `more`.

    An inner explode would be preceded by a filter on the array's size, which would work all hits out twice.
    """
    each = found.withColumn("_hit", F.explode_outer("_hits")).where("_hit IS NOT NULL")
    h = F.col("_hit")
    return each.select(
        "doc_id", "page_num", "ord", h["text"].alias("text"), h["entity"].alias("entity_type"), h["score"].alias("score"), h["bbox"].alias("bbox"), h["keep"].alias("preserve_last"),
        h["detector"].alias("detector"), h["start"].alias("start"), h["size"].alias("size"), *more,
    )


def empty(spans: DataFrame) -> DataFrame:
    return detections(spans.where("false").withColumn("_hits", no_hits()))


# Hits of one span.


def pattern_hits(text: Column, patterns: list[CustomPattern]) -> Column:
    def named(p: CustomPattern) -> Column:
        return F.transform(X.matches(text, p.regex), lambda m: hit(p.name, m["match"], m["start"]))

    return together([named(p) for p in patterns])


def hidden_box(bbox: Column, text: Column, start: Column, hidden: Column) -> Column:
    """The part of a span's box over the hidden characters."""
    width = (bbox["x1"] - bbox["x0"]) / F.greatest(F.length(text), F.lit(1))
    left = bbox["x0"] + width * start
    return F.struct(left.alias("x0"), bbox["y0"].alias("y0"), (left + width * hidden).alias("x1"), bbox["y1"].alias("y1"))


def account_hits(text: Column, bbox: Column, accounts: list[AccountNumber]) -> Column:
    """Every match; the box covers what has to be hidden, or the whole span where no suffix can stay."""

    def placed(a: AccountNumber) -> Column:
        def one(m: Column) -> Column:
            hidden = X.hidden_length(m["match"], a.preserve_last)
            box = F.when(hidden.isNotNull(), hidden_box(bbox, text, m["start"], hidden)).otherwise(bbox)
            return hit("ACCOUNT_NUMBER", m["match"], m["start"], bbox=box, keep=a.preserve_last)

        return F.transform(X.account_matches(text, a.value), one)

    found = together([placed(a) for a in accounts])
    digits = [re.sub("[^A-Za-z0-9]", "", a.value) for a in accounts]
    least = min((len(d) for d in digits if d), default=0)
    # Where all accounts are numbers, a span needs that many digits in a row.
    return F.when(text.rlike(rf"[0-9](?:[\s\-.]*[0-9]){{{least - 1}}}"), found).otherwise(no_hits()) if least > 1 and all(d.isdigit() for d in digits if d) else found


def contact_patterns(profile: Profile) -> list[CustomPattern]:
    """Phones, e-mails and SSNs of the profile: digits with separators between, or the value in either case."""
    s = profile.subject
    patterns = [(e, X.account_pattern(v)) for e, vs in (("PHONE_NUMBER", s.phones), ("US_SSN", s.ssns)) for v in vs if re.search("[0-9]", v)]
    patterns = [(e, p.replace(r"[\s\-.]*", r"[\s\-.()]*")) for e, p in patterns] + [("EMAIL_ADDRESS", f"(?i){X.quote(v)}") for v in s.emails]
    return [CustomPattern.model_construct(name=e, regex=p) for e, p in patterns]


def luhn(number: Column) -> Column:
    return F.call_function("luhn_check", number)


def entity_hits(text: Column, entities: list[str], threshold: float, recognise=None, tagged=None) -> Column:
    """Rule recognisers. `tagged`, a function from text to array<struct<entity, match, score, start>>, takes the place of the rules for
    the entities that it knows; `recognise`, one without starts, adds to them and hides what it matched first."""

    def recognised(e: str) -> Column:
        letters, digits = GATES[e]
        able = text.contains(letters) if letters else F.lit(True)
        able = able & text.rlike(f"[0-9]{{{digits}}}") if digits else able
        found = X.matches(text, RECOGNISERS[e])
        found = F.filter(found, lambda m: luhn(m["match"])) if e == "CREDIT_CARD" else found
        score = 0.6 if e in ("DATE_TIME", "IP_ADDRESS", "LOCATION") else 1.0
        return F.when(able, F.transform(found, lambda m: hit(e, m["match"], m["start"], score=score, detector="entity"))).otherwise(no_hits())

    hits = [recognised(e) for e in entities if e in RECOGNISERS and not (tagged is not None and e in TAGGED)]
    if tagged is not None and (own := [e for e in TAGGED if e in entities]):
        learned = F.filter(tagged(text), lambda m: m["entity"].isin(own))
        hits.append(F.transform(learned, lambda m: hit(m["entity"], m["match"], m["start"], score=m["score"], detector="entity")))
    if recognise is not None:
        learned = F.filter(recognise(text), lambda m: F.instr(text, m["match"]) > 0)
        hits.append(F.transform(learned, lambda m: hit(m["entity"], m["match"], F.instr(text, m["match"]) - 1, score=m["score"], detector="entity")))
    return F.filter(together(hits), lambda h: h["score"] >= threshold)


def name_condition(text: Column, terms: list[str]) -> tuple[Column, list[str]]:
    """(exact, several): whether a one-token term is in the text as a whole word, and the lower-cased terms of several tokens."""
    exact = F.lit(False)
    for t in terms:
        if len(re.findall(r"\w+", t)) == 1:
            exact = exact | X.has_word(text, t)
    return exact, [t.lower() for t in terms if len(re.findall(r"\w+", t)) > 1]


def with_hits(spans: DataFrame, hits: list[Column], names: Profile | None = None) -> DataFrame:
    """Spans with `_hits`; the names of a profile are the one part that may need Python."""
    ship(spans.sparkSession)
    text, terms = F.col("text"), name_terms(names) if names else []
    if not terms:
        return spans.withColumn("_hits", together(hits))
    threshold = names.detection.match_threshold
    exact, several = name_condition(text, terms)
    able = (F.trim(text) != "") & ~X.is_corporate(text)
    named = exact & able
    if several:
        # The function gets the text only of spans that no built-in test has settled, else null.
        spans = spans.withColumn("_asked", F.when(~exact & fuzzy.may_fit(F.lower(text), several, threshold) & able, F.lower(text)))
        spans = spans.withColumn("_near", fuzzy.fuzzy_hit(F.col("_asked"), several, threshold))
        named = named | F.coalesce(F.col("_near"), F.lit(False))
    person = F.when(named, F.array(hit("PERSON", text, F.lit(0)))).otherwise(no_hits())
    return spans.withColumn("_hits", together([*hits, person]))


# One detector over spans.


def detect_names(spans: DataFrame, profile: Profile) -> DataFrame:
    """At most one PERSON a span, the whole span, score 1."""
    return detections(with_hits(spans, [], profile))


def detect_patterns(spans: DataFrame, patterns: list[CustomPattern]) -> DataFrame:
    """Every match of every pattern; the type is the pattern's name, the box the span's."""
    return detections(with_hits(spans, [pattern_hits(F.col("text"), patterns)]))


def detect_accounts(spans: DataFrame, accounts: list[AccountNumber]) -> DataFrame:
    return detections(with_hits(spans, [account_hits(F.col("text"), F.col("bbox"), accounts)]))


def detect_contacts(spans: DataFrame, profile: Profile) -> DataFrame:
    return detect_patterns(spans, contact_patterns(profile))


def detect_entities(spans: DataFrame, entities: list[str] | None = None, threshold: float = 0.5, recognise=None, tagger: Tagger | None = None) -> DataFrame:
    tagged = tagger.found(spans.sparkSession) if tagger is not None else None
    return detections(with_hits(spans, [entity_hits(F.col("text"), entities or DEFAULT_ENTITIES, threshold, recognise, tagged)]))


# Addresses over several lines.


def address_groups(spans: DataFrame, window: int, column_aware: bool = True) -> DataFrame:
    """(doc_id, lines): the lines of each address that a candidate line opens, in document order.

    A group is its first line and the lines right after it, `window` at most, that go on with an address in the same column:
    a bounded look ahead. A candidate that an earlier group has taken opens none; candidates are followed through only as
    far as one's group reaches the next. Blank lines are passed over. Documents without a candidate are not read on.
    """
    text, box = F.col("text"), F.col("bbox")
    able = spans.where(A.is_candidate(text)).select("doc_id").distinct()
    own = F.struct("page_num", "ord", "text", "bbox")
    lines = spans.join(merging(able), "doc_id", "left_semi").where(F.trim("text") != "").select("doc_id", "page_num", "ord", own.alias("line"), text.alias("text"), box.alias("bbox"))
    goes = A.is_continuation(text) & ~A.is_prose(text)
    lines = lines.withColumn("candidate", A.is_candidate(text)).withColumn("goes", goes).withColumn("centre", (box["x0"] + box["x1"]) / 2).withColumn("reach", F.greatest(box["x1"] - box["x0"], F.lit(50.0)))
    order = Window.partitionBy("doc_id").orderBy("page_num", "ord")
    next_lines = [F.lead(F.struct("line", "goes", "centre"), i).over(order) for i in range(1, window + 1)]
    kind = f"array<struct<line:struct<page_num:int,ord:int,text:string,bbox:{BOX}>,goes:boolean,centre:double>>"
    ahead = F.array(*next_lines).cast(kind) if next_lines else F.array().cast(kind)
    lines = lines.select("doc_id", "line", "candidate", "centre", "reach", F.row_number().over(order).alias("at"), ahead.alias("ahead")).where("candidate")

    def fits(n):
        near = F.abs(n["centre"] - F.col("centre")) <= F.col("reach") if column_aware else F.lit(True)
        return F.coalesce(n["goes"] & near, F.lit(False))

    taken = F.aggregate("ahead", F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda s, n: F.struct((s["n"] + (s["on"] & fits(n)).cast("int")).alias("n"), (s["on"] & fits(n)).alias("on")), lambda s: s["n"])
    lines = lines.withColumn("taken", taken).withColumn("end", F.col("at") + F.col("taken"))
    seeds = lines.select("doc_id", "at", "end", F.concat(F.array("line"), F.transform(F.slice("ahead", F.lit(1), F.col("taken")), lambda n: n["line"])).alias("lines"))
    by_place = Window.partitionBy("doc_id").orderBy("at")
    before = F.max("end").over(by_place.rowsBetween(Window.unboundedPreceding, -1))
    chained = seeds.withColumn("new", F.coalesce(before < F.col("at"), F.lit(True)).cast("int")).withColumn("chain", F.sum("new").over(by_place))
    chains = chained.groupBy("doc_id", "chain").agg(F.array_sort(F.collect_list(F.struct("at", "end", "lines"))).alias("c"))
    start = F.struct(F.lit(0).alias("end"), F.slice("c", 1, 0).alias("kept"))
    step = lambda s, c: F.when(c["at"] > s["end"], F.struct(c["end"].alias("end"), F.concat(s["kept"], F.array(c)).alias("kept"))).otherwise(s)
    return chains.select("doc_id", F.explode(F.aggregate("c", start, step, lambda s: s["kept"])).alias("g")).select("doc_id", "g.lines")


def first_fits(texts: list[str], needles: list[fuzzy.Needle]) -> dict[str, float | None]:
    """The score of each text by the first needle that it fits; exact scores only where the scan of all texts leaves one open."""
    out: dict[str, float | None] = dict.fromkeys(texts)
    for needle in needles:
        left = [t for t in texts if out[t] is None]
        near = fuzzy.scan(left, needle).tolist() if left else ()
        for t, maybe in zip(left, near, strict=True):
            if (maybe or len(t) <= len(needle.term)) and (score := needle.partial(t)) >= 100 * needle.threshold:
                out[t] = score / 100
    return out


def detect_addresses(spans: DataFrame, profile: Profile) -> DataFrame:
    """LOCATION for each line of a group that fits an address, by the first that does."""
    addresses = [a for a in profile.subject.addresses if a.strip()]
    if not addresses:
        return empty(spans)
    ship(spans.sparkSession)
    d = profile.detection
    threshold = d.match_threshold
    groups = address_groups(spans, d.address_line_bridge_window, d.column_aware)
    groups = groups.withColumn("joined", A.normalize(F.array_join(F.transform("lines", lambda x: F.trim(x["text"])), " "))).where(~X.is_numeric_token(F.col("joined")))

    @F.pandas_udf("double")
    def first_fit(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        needles: list[fuzzy.Needle] = []
        known: dict[str, float | None] = {}
        for texts, wanted in batches:
            if not needles and len(wanted):
                needles = [fuzzy.Needle(w, threshold) for w in wanted.iloc[0]]
            if len(known) > KNOWN_TEXTS:
                known.clear()
            known |= first_fits([t for t in texts.unique().tolist() if t not in known], needles)
            yield texts.map(known).astype("float64")

    wanted = F.array(*[A.normalize(F.lit(a)) for a in addresses])
    found = groups.withColumn("score", first_fit("joined", wanted)).where("score IS NOT NULL")
    each = found.select("doc_id", "score", F.explode("lines").alias("s")).select("doc_id", "s.*", "score")
    return detections(each.withColumn("_hits", F.array(hit("LOCATION", F.col("text"), F.lit(0), score=F.col("score")))))


# All detectors.


def line_hits(spans: DataFrame, profile: Profile, contacts: bool = False, entities: list[str] | None = None, threshold: float = 0.5, tagger: Tagger | None = None) -> DataFrame:
    """Hits of all detectors that look at one span: one scan, one explode."""
    text, s = F.col("text"), profile.subject
    patterns = [*s.custom_patterns, *(contact_patterns(profile) if contacts else [])]
    hits = [account_hits(text, F.col("bbox"), s.account_numbers)] if s.account_numbers else []
    hits += [pattern_hits(text, patterns)] if patterns else []
    hits += [entity_hits(text, entities, threshold, tagged=tagger.found(spans.sparkSession) if tagger is not None else None)] if entities else []
    return detections(with_hits(spans, hits, profile))


def every_hit(spans: DataFrame, profile: Profile, contacts: bool = False, entities: list[str] | None = None, threshold: float = 0.5, documents: DataFrame | None = None, tagger: Tagger | None = None) -> DataFrame:
    """Hits before any are merged; addresses are looked for in `documents`, the spans themselves if none."""
    out = line_hits(spans, profile, contacts, entities, threshold, tagger)
    return out.unionByName(detect_addresses(spans if documents is None else documents, profile)) if any(a.strip() for a in profile.subject.addresses) else out


def detect_profile(spans: DataFrame, profile: Profile, contacts: bool = False) -> DataFrame:
    """All profile detectors, duplicates kept."""
    return every_hit(spans, profile, contacts)


#: Height of the bands in which boxes of a page meet.
BAND = 32.0


def overlaps(x: Column, y: Column) -> Column:
    """Whether two boxes share an area; touching edges do not."""
    return (x["x0"] < y["x1"]) & (x["x1"] > y["x0"]) & (x["y0"] < y["y1"]) & (x["y1"] > y["y0"])


def banded(hits: DataFrame, name: str) -> DataFrame:
    """(doc, page, band, name): the distinct boxes of each page, in every band that they touch."""
    b = F.col("bbox")
    distinct = hits.select(F.col("doc_id").alias("doc"), F.col("page_num").alias("page"), "bbox").distinct()
    band = lambda y: F.floor(y / BAND)
    return distinct.select("doc", "page", F.col("bbox").alias(name), F.explode(F.sequence(band(b["y0"]), band(b["y1"]))).alias("band"))


def merged(hits: DataFrame) -> DataFrame:
    """Of a table of hits, which is read more than once: profile hits, all of them, and the entity hits that overlap none on their page.

    Distinct boxes meet in bands of the page, so a page with very many hits is no group of its own and a box with very many
    hits is compared once.
    """
    profile_hits, entity_hits = hits.where("detector <> 'entity'"), hits.where("detector = 'entity'")
    met = banded(entity_hits, "own").join(merging(banded(profile_hits, "other")), ["doc", "page", "band"])
    covered = met.where(overlaps(F.col("own"), F.col("other"))).select("doc", "page", "own").distinct()
    same = (F.col("doc_id") == F.col("doc")) & (F.col("page_num") == F.col("page")) & (F.col("bbox") == F.col("own"))
    return profile_hits.unionByName(entity_hits.join(merging(covered), same, "left_anti"))


def merge(profile_hits: DataFrame, entity_hits: DataFrame) -> DataFrame:
    """Profile hits win over entity hits whose boxes overlap; the hits are stored first."""
    return merged(stored(profile_hits.unionByName(entity_hits)))


def wanted_entities(profile: Profile) -> list[str]:
    """The recognisers that the profile switches on with a list."""
    d = profile.detection
    return d.presidio_entities if d.use_presidio else []


def detect_all(spans: DataFrame, profile: Profile, threshold: float = 0.5, contacts: bool = False, tagger: Tagger | None = None) -> DataFrame:
    """Profile detectors, entity recognisers if switched on, merged; merging reads the hits more than once, so they are stored."""
    entities = wanted_entities(profile)
    hits = every_hit(spans, profile, contacts, entities, threshold, tagger=tagger)
    return merged(stored(hits)) if entities else hits


def dry_run(spans: DataFrame, profile: Profile, threshold: float = 0.5) -> DataFrame:
    """All detections without merging, in five columns."""
    hits = every_hit(spans, profile, entities=wanted_entities(profile), threshold=threshold)
    return hits.select(F.col("doc_id").alias("file"), F.col("page_num").alias("page"), "entity_type", "text", "score")
