"""Plans made of the operators: run, dry run, verify, batch.

A run repeats detection until nothing is found, semi-naively: a detector that
looks at one span gives the same hits on the same text, so a later pass searches
only the spans on which the pass before had hits, hidden or not; addresses look
at neighbours, so they are looked for in all lines of documents in which a line
has changed. Hits carry their ranges and redaction keeps lengths, so the spans
are rewritten once, from the hits of all passes.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from veilframe.cluster import checkpoint, merging, stored
from veilframe.errors import NoTextLayerError, RedactionError, VerificationError
from veilframe.operators import detect, ocr, redact, summaries, verify
from veilframe.operators.redact import KEY
from veilframe.operators.tagger import Tagger
from veilframe.profile import Profile
from veilframe.sources import spans as sources

MAX_PASSES = 3


@dataclass
class Run:
    """What a run gives: redacted spans, detections of all passes, survivors and a row a document."""

    spans: DataFrame
    detections: DataFrame
    survivors: DataFrame
    results: DataFrame
    errors: DataFrame | None = None
    unsettled: DataFrame | None = field(default=None)
    #: Spans that each pass searched.
    searched: list[int] = field(default_factory=list)


@dataclass
class Engine:
    """Options of the command line, as they apply to frames."""

    profile: Profile
    threshold: float = 0.5
    contacts: bool = False
    guards: bool = False
    granularity: str = "span"
    force_ocr: bool = False
    tagger: Tagger | None = None

    def found(self, delta: DataFrame, documents: DataFrame | None, n: int) -> tuple[DataFrame, int]:
        """(hits of a pass before merging, stored; the spans searched)."""
        seen = Observation(f"pass {n}")
        every = detect.every_hit(delta.observe(seen, F.count(F.lit(1)).alias("spans")), self.profile, self.contacts, detect.wanted_entities(self.profile), self.threshold, documents, self.tagger)
        every = stored(every)
        return every, seen.get["spans"]

    def kept(self, every: DataFrame, heights: DataFrame | None, spans: DataFrame) -> DataFrame:
        """The hits of a pass that hide something: merged, and let through by the guards."""
        hits = detect.merged(every) if detect.wanted_entities(self.profile) else every
        return redact.guarded(hits, spans, heights=heights).where("rejected IS NULL").drop("rejected") if self.guards else hits

    def settle(self, spans: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, list[int]]:
        """(spans at rest, detections with pass_num, documents that a third pass still finds things in, spans searched by pass)."""
        heights = stored(redact.median_heights(spans)) if self.guards else None
        looks_around = any(a.strip() for a in self.profile.subject.addresses)
        delta, documents, every, unsettled, searched = spans, spans, None, None, []
        for n in range(1, MAX_PASSES + 1):
            found, read = self.found(delta, documents, n)
            searched.append(read)
            hits = stored(self.kept(found, heights, spans).withColumn("pass_num", F.lit(n)))
            every = hits if every is None else every.unionByName(hits)
            if hits.isEmpty():
                break
            if n == MAX_PASSES:
                unsettled = hits.select("doc_id").distinct()
                break
            touched = found.select(*KEY).distinct()
            if looks_around:
                changed = spans.join(merging(every.select("doc_id").distinct()), "doc_id", "left_semi")
                documents = stored(redact.redact_spans(changed, every, self.granularity).drop("hits"))
                delta = documents.join(merging(touched), KEY, "left_semi")
                # A line outside may be hit by an address alone, and then has no hits of its own.
            else:
                delta = stored(redact.redact_spans(delta.join(merging(touched), KEY, "left_semi"), hits, self.granularity).drop("hits"))
        settled = checkpoint(redact.redact_spans(spans, every, self.granularity).drop("hits"))
        return settled, every, unsettled if unsettled is not None else every.where("false").select("doc_id"), searched

    def run(self, spans: DataFrame, ocr_raw: DataFrame | None = None, check: bool = True) -> Run:
        settled, hits, unsettled, searched = self.settle(spans)
        ranged = hits
        if ocr_raw is not None:
            text = settled.groupBy("doc_id", "page_num").agg(F.sum(F.length(F.trim("text"))).alias("n"))
            textual = text.where("n >= 50").select("doc_id", "page_num")
            pages = ocr_raw.select("doc_id", "page_num").distinct().join(merging(textual), ["doc_id", "page_num"], "left_anti")
            words = ocr.matches(ocr.ocr_words(ocr.restricted(ocr_raw, pages, self.force_ocr)), self.profile)
            hits = hits.unionByName(ocr.detections(words).withColumn("pass_num", F.lit(0)))
        # Totals, reports and the audit log all read the survivors, so they are looked for once.
        survivors = hits.where("false").drop("pass_num")
        if check:
            again = checkpoint(verify.verify(settled, self.profile, hits, self.threshold, self.tagger))
            # What a hit was to hide and still shows, on spans where a second search finds nothing.
            shown = redact.exposed(settled, ranged.drop("pass_num"), self.granularity).dropDuplicates([*KEY, "start", "size"]).join(merging(again), KEY, "left_anti")
            survivors = checkpoint(again.unionByName(shown))
        return Run(settled, hits, survivors, self.results(spans, hits, survivors, check), unsettled=unsettled, searched=searched)

    def results(self, spans: DataFrame, hits: DataFrame, survivors: DataFrame, check: bool = True) -> DataFrame:
        """(doc_id, detections, safety_passes, verification_passed or null, survivors)."""
        found = hits.groupBy("doc_id").agg(F.count("*").alias("detections"), F.greatest(F.max("pass_num") - 1, F.lit(0)).alias("safety_passes"))
        left = survivors.groupBy("doc_id").agg(F.count("*").alias("left"))
        out = spans.select("doc_id").distinct().join(merging(found), "doc_id", "left").join(merging(left), "doc_id", "left")
        passed = F.col("left").isNull() if check else F.lit(None).cast("boolean")
        return out.select(
            "doc_id", F.coalesce("detections", F.lit(0)).cast("long").alias("detections"), F.coalesce("safety_passes", F.lit(0)).cast("int").alias("safety_passes"),
            passed.alias("verification_passed"), F.coalesce("left", F.lit(0)).cast("long").alias("survivors"),
        )

    def run_strict(self, spans: DataFrame) -> Run:
        """Like run, but what is left over raises."""
        out = self.run(spans)
        if not out.unsettled.isEmpty():
            raise RedactionError(f"not at rest after {MAX_PASSES} passes")
        if not out.survivors.isEmpty():
            raise VerificationError("personal data survived")
        return out

    def run_batch(self, opened: DataFrame, allow_ocr: bool = True, ocr_raw: DataFrame | None = None, check: bool = True) -> Run:
        """From (doc_id, path, text, has_images, error_kind, error): a bad document becomes a row of errors, the others go on."""
        blank = (F.length(F.coalesce("text", F.lit(""))) < 50) & F.col("has_images") & F.col("error_kind").isNull()
        kind = F.when(blank, "no_text").otherwise(F.col("error_kind")) if not allow_ocr else F.col("error_kind")
        rows = opened.withColumn("error_kind", kind)
        good = rows.where("error_kind IS NULL")
        out = self.run(sources.document_spans(good), ocr_raw if allow_ocr else None, check)
        out.errors = summaries.failures(rows)
        return out

    def dry_run(self, spans: DataFrame) -> DataFrame:
        return detect.dry_run(spans, self.profile, self.threshold)

    def verify(self, spans: DataFrame) -> DataFrame:
        return verify.summary(spans, verify.verify(spans, self.profile, threshold=self.threshold))


def require_text(pages: DataFrame) -> None:
    """Raise if a document has pictures and next to no text."""
    if not sources.preflight(pages).where("needs_ocr").isEmpty():
        raise NoTextLayerError("a document has no text layer")
