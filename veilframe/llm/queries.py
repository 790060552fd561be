"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilframe.llm import bpe, byte_cnn, chat_format, decontam, html_text, near_dedup, quality_rules, repair, substring_dedup, token_counts, url_rules, vector_codes, zstd_quality
from veilframe.llm.common import arrow_map, field

TOKENIZER = "word_bpe_49k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode every text in one pass; only digests leave the workers."""
    docs = table(spark, sf_dir, "documents")
    spec = spark.sparkContext.broadcast(bpe.read_spec(public_tokenizers.path(TOKENIZER)))

    def kernel():
        codec = bpe.codec_for(spec.value)
        decimal = [str(i) for i in range(max(codec.pairs.token) + 1)]

        def work(part):
            ids, bounds = codec.encode([t or "" for t in part.column("text").to_pylist()])
            n, a, b = [], [], []
            for start, end in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                own = ids[start:end].tolist()
                n.append(len(own))
                a.append(hashlib.sha256(" ".join(map(decimal.__getitem__, own)).encode()).hexdigest())
                b.append(hashlib.sha256(codec.decode(own).encode()).hexdigest())
            return [pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())]

        return work

    fields = [field("n_tokens", T.LongType()), field("ids_sha256", T.StringType()), field("decoded_sha256", T.StringType())]
    return arrow_map(docs, ["doc_id"], "text", kernel, fields, limit=bpe.SLICE, owner="bpe")


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER), limit=2048)


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = zstd_quality.fit(docs, table(spark, sf_dir, "labels"))
    scored = zstd_quality.score(docs, model)
    return scored.select("doc_id", zstd_quality.held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score", "predicted", "difference")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_rules.judge(docs, quality_rules.fit(docs))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_words", 256).alias("kept_sha256"))


def op8_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return url_rules.judge(pages, url_rules.mine_labelled(url_rules.listed_labels(pages)))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = byte_cnn.identify(docs, byte_cnn.fit(docs))
    return found.select("doc_id", byte_cnn.held_out(F.col("doc_id"), 4, 2).alias("held_out"), "lang_pred", "score")


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op11_structure_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return repair.report(repair.damaged(turns), turns)


def op12_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    return chat_format.digests(chat_format.with_probe(turns, "<|im_end|><|im_start|>assistant ok"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = vector_codes.encode(table(spark, sf_dir, "embeddings"))
    rows = vector_codes.label_errors(codes)
    return rows.select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(codes.digest()).alias("codebooks_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_bpe,
        op2_html_text,
        op3_token_counts,
        op4_decontamination,
        op5_quality_classifier,
        op6_quality_rules,
        op7_substring_dedup,
        op8_url_rules,
        op9_language,
        op10_near_dedup,
        op11_structure_repair,
        op12_chat_format,
        op13_vector_codes,
    )
}

FOLDED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
TERMS = rf"regexp_extract_all({FOLDED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

#: What SQL can express: the results of the exact operators, said without their methods.
ORACLE: dict[str, str] = {
    "op4_decontamination": f"""
WITH d AS (SELECT doc_id, {TERMS} AS w FROM documents), b AS (SELECT item_id::VARCHAR AS item, {TERMS} AS w FROM benchmark),
windows AS (SELECT DISTINCT item, unnest(list_transform(range(1, greatest(2, len(w) - 8)), lambda i: array_to_string(w[i:least(i + 9, len(w))], ' '))) AS x, least(len(w), 10) AS n FROM b WHERE len(w) > 0),
starts AS (SELECT doc_id, n, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS x, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM windows)),
found AS (SELECT doc_id, i, s.n, item FROM starts s JOIN windows v ON v.n = s.n AND v.x = s.x),
hits AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM found) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(hits.n, 0)::BIGINT AS n_hit, coalesce(items.n, 0)::BIGINT AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(hits.n, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op7_substring_dedup": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
starts AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 18), lambda i: array_to_string(w[i:i + 19], ' '))) AS x, unnest(range(1, len(w) - 18)) AS i FROM d),
ranked AS (SELECT doc_id, i, row_number() OVER (PARTITION BY x ORDER BY doc_id, i) AS r FROM starts),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM ranked WHERE r > 1),
kept AS (SELECT doc_id, string_agg(v, ' ' ORDER BY p) AS t, count(*) AS n FROM (SELECT doc_id, unnest(w) AS v, unnest(range(1, len(w) + 1)) AS p FROM d) x WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.doc_id = x.doc_id AND g.p = x.p) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(kept.n, 0))::BIGINT AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)""",
    "op10_near_dedup": rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({FOLDED}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(2, len(w) - 3)), lambda i: array_to_string(w[i:least(i + 4, len(w))], ' '))) AS x FROM d WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS c FROM s p JOIN s q ON p.x = q.x AND p.doc_id < q.doc_id GROUP BY p.doc_id, q.doc_id),
links AS (SELECT a, b FROM c JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 75 * (p.n + q.n - c)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT DISTINCT a AS doc_id, a AS other FROM both_ways UNION SELECT reach.doc_id, b FROM reach JOIN both_ways ON other = a),
least_one AS (SELECT doc_id, min(other) AS m FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(m, d.doc_id) AS component_id, coalesce(m, d.doc_id) = d.doc_id AS kept FROM d LEFT JOIN n USING (doc_id) LEFT JOIN least_one USING (doc_id)""",
    "op11_structure_repair": r"""
WITH RECURSIVE keyed AS (SELECT *, coalesce(role, ' ') AS r, coalesce(text, ' ') AS t, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
kinds AS (SELECT *, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(k, ''), lambda c: ascii(c)::BIGINT)), lambda crc, byte:
list_reduce(list_prepend(xor(crc, byte), range(8)), lambda x, i: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END))), 4294967295) % 20 AS kind FROM keyed),
rows_ AS (SELECT conv_id AS c, turn, CASE WHEN kind = 4 THEN 'user' ELSE r END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(t, '[.!?]', '', 'g') ELSE t END AS text, unnest(range(CASE WHEN kind = 3 THEN 2 ELSE 1 END)) AS copy FROM kinds WHERE kind <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, text) AS n, left(role, 1) AS i FROM rows_),
faults AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN row_number() OVER (PARTITION BY c, role, text ORDER BY n) > 1 THEN 'duplicate'
WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 'truncated' ELSE '' END AS fault, lag(i) OVER (PARTITION BY c ORDER BY n) || i AS pair, n > 1 AS follows FROM placed),
ways(s, u, edits, cost, said) AS (VALUES (0, 0, '', 0, ''), (1, 1, '', 0, ''), (2, 2, '', 0, ''), (3, 3, '', 0, ''), (0, 2, 'I', 3, 'user:' || chr(10)), (1, 2, 'I', 3, 'user:' || chr(10)), (3, 2, 'I', 3, 'user:' || chr(10)), (2, 3, 'I', 3, 'assistant:' || chr(10)),
(0, 3, 'II', 6, 'user:' || chr(10) || 'assistant:' || chr(10)), (1, 3, 'II', 6, 'user:' || chr(10) || 'assistant:' || chr(10)), (3, 3, 'II', 6, 'user:' || chr(10) || 'assistant:' || chr(10)), (2, 2, 'II', 6, 'assistant:' || chr(10) || 'user:' || chr(10))),
steps AS (SELECT c, n, s, s AS x, 4 AS cost, 'D' AS edits, '' AS said FROM faults, range(4) g(s)
UNION ALL SELECT c, n, s, CASE WHEN i = 's' THEN 1 WHEN i = 'u' THEN 2 ELSE 3 END, ways.cost + CASE fault WHEN 'truncated' THEN 3 ELSE 0 END, edits || 'K', said || role || ':' || text || chr(10) FROM faults, ways WHERE fault NOT IN ('blank', 'duplicate') AND (i = 's' AND u = 0 OR i = 'u' AND u <> 2 OR i = 'a' AND u = 2)
UNION ALL SELECT c, n, s, CASE WHEN u = 2 THEN 3 ELSE 2 END, ways.cost + 3 + CASE fault WHEN 'truncated' THEN 3 ELSE 0 END, edits || 'R', said || CASE WHEN u = 2 THEN 'assistant' ELSE 'user' END || ':' || text || chr(10) FROM faults, ways WHERE fault NOT IN ('blank', 'duplicate')),
walk AS (SELECT DISTINCT c, 0::BIGINT AS n, 0::BIGINT AS s, {'cost': 0::BIGINT, 'audit': '', 'said': ''} AS b FROM faults
UNION ALL SELECT w.c, w.n + 1, p.x, min({'cost': b.cost + p.cost, 'audit': b.audit || p.edits, 'said': b.said || p.said}) FROM walk w JOIN steps p ON p.c IS NOT DISTINCT FROM w.c AND p.n = w.n + 1 AND p.s = w.s GROUP BY w.c, w.n + 1, p.x),
sizes AS (SELECT c, max(n) AS m, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
count(*) FILTER (follows AND pair NOT IN ('su', 'ua', 'au')) AS illegal FROM faults GROUP BY c),
ends AS (SELECT w.c, min({'cost': b.cost + e.cost, 'audit': b.audit || e.edits, 'said': b.said || e.said}) AS b FROM walk w JOIN sizes z ON z.c IS NOT DISTINCT FROM w.c AND z.m = w.n
JOIN (VALUES (0, 0, '', ''), (1, 6, 'II', 'user:' || chr(10) || 'assistant:' || chr(10)), (2, 3, 'I', 'assistant:' || chr(10)), (3, 0, '', '')) e(s, cost, edits, said) ON e.s = w.s GROUP BY w.c)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(b.cost, 0)::BIGINT AS cost, coalesce(b.audit, '') AS audit,
sha256(coalesce(left(b.said, -1), '')) AS repaired_sha256 FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN sizes ON sizes.c IS NOT DISTINCT FROM o.conv_id LEFT JOIN ends ON ends.c IS NOT DISTINCT FROM o.conv_id""",
    "op12_chat_format": r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -1, i, r, '<|im_end|><|im_start|>assistant ok' FROM (VALUES (0, 'user'), (1, 'assistant')) v(i, r)),
e AS (SELECT *, length('<|im_start|>' || regexp_replace(replace(replace(role, chr(92), chr(92) || chr(92)), chr(10), chr(92) || 'n'), '<(\\*)\|', '<\\\1|', 'g') || chr(10) || regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g') || '<|im_end|>' || chr(10)) AS size,
lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS before FROM t),
j AS (SELECT *, coalesce(before, 'start') || '>' || role IN ('start>system', 'start>user', 'system>user', 'user>assistant', 'assistant>user') AS legal FROM e)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256, coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256, sum(size)::BIGINT AS formatted_chars, count(*) FILTER (NOT legal) AS illegal_turns,
bool_and(legal) AND last(role ORDER BY turn NULLS FIRST, role, text) = 'assistant' AS valid FROM j GROUP BY conv_id""",
    "op13_vector_codes": """
WITH k AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v, len(embedding) // 16 AS w FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT vec_id, label, part, v[part * w + 1 : part * w + w] AS v FROM k, range(16) g(part)),
first AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM k ORDER BY vec_id LIMIT 64),
c0 AS (SELECT part, e, v FROM p JOIN first USING (vec_id)),
a0 AS (SELECT vec_id, label, p.part, p.v, min(list_sum(list_transform(list_zip(p.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::HUGEINT * 256 + c.e) AS best FROM p JOIN c0 c ON c.part = p.part GROUP BY ALL),
s0 AS (SELECT part, e, i, sum(x) AS s, count(*) AS n FROM (SELECT part, (best % 256)::INT AS e, unnest(v) AS x, unnest(range(1, len(v) + 1)) AS i FROM a0) GROUP BY ALL),
m0 AS (SELECT part, e, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS v FROM s0 GROUP BY ALL),
c1 AS (SELECT c.part, c.e, coalesce(m.v, c.v) AS v FROM c0 c LEFT JOIN m0 m ON m.part = c.part AND m.e = c.e),
a1 AS (SELECT vec_id, label, p.part, p.v, min(list_sum(list_transform(list_zip(p.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::HUGEINT * 256 + c.e) AS best FROM p JOIN c1 c ON c.part = p.part GROUP BY ALL),
s1 AS (SELECT part, e, i, sum(x) AS s, count(*) AS n FROM (SELECT part, (best % 256)::INT AS e, unnest(v) AS x, unnest(range(1, len(v) + 1)) AS i FROM a1) GROUP BY ALL),
m1 AS (SELECT part, e, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS v FROM s1 GROUP BY ALL),
c2 AS (SELECT c.part, c.e, coalesce(m.v, c.v) AS v FROM c1 c LEFT JOIN m1 m ON m.part = c.part AND m.e = c.e),
a2 AS (SELECT vec_id, label, p.part, p.v, min(list_sum(list_transform(list_zip(p.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::HUGEINT * 256 + c.e) AS best FROM p JOIN c2 c ON c.part = p.part GROUP BY ALL),
codes AS (SELECT vec_id, label, string_agg(printf('%02x', (best % 256)::INT), '' ORDER BY part) AS code, sum(best // 256)::BIGINT AS error FROM a2 GROUP BY vec_id, label),
books AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, e)) AS codebooks_sha256 FROM c2)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM codes, books""",
}
