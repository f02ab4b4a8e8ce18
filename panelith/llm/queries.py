"""The queries of this subpackage, by name, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from panelith.llm import bpe, decontaminate, filter_audit, html_content, language, mpeg_audio, neardup, packing, secrets, sharding, substring, vector_codes, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_mpeg_audio": mpeg_audio.op1_mpeg_audio,
        "op2_markov_secrets": secrets.op2_markov_secrets,
        "op3_feistel_sharding": sharding.op3_feistel_sharding,
        "op4_wrapper_induction": html_content.op4_wrapper_induction,
        "op5_language_svm": language.op5_language_svm,
        "op6_bag_minhash": neardup.op6_bag_minhash,
        "op7_best_fit_packing": packing.op7_best_fit_packing,
        "op8_warc_zstd": warc.op8_warc_zstd,
        "op9_spaced_seeds": decontaminate.op9_spaced_seeds,
        "op10_debruijn_spans": substring.op10_debruijn_spans,
        "op11_mask_histogram": filter_audit.op11_mask_histogram,
        "op12_elkan_codes": vector_codes.op12_elkan_codes,
        "op13_overlap_bpe": bpe.op13_overlap_bpe,
    }


WARC_SQL = """WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS digest FROM pages),
k AS (SELECT *, CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY digest) END AS kept FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, digest AS payload_digest, CASE WHEN kept <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN kept <> page_id THEN kept END AS refers_to FROM k"""

#: All pairs of texts that share a shingle, and their components: for small tables only.
CLASSES_SQL = """WITH RECURSIVE t AS (SELECT min(doc_id) AS rep, text FROM documents WHERE text IS NOT NULL GROUP BY text),
w AS (SELECT rep, regexp_extract_all(lower(text), '[^\\x20\\x09-\\x0D]+') AS w FROM t),
i AS (SELECT rep, w, unnest(range(greatest(len(w) - 4, least(len(w), 1)))) AS i FROM w),
b AS (SELECT rep, array_to_string(w[i + 1:i + 5], ' ') AS s, count(*) AS c FROM i GROUP BY ALL),
n AS (SELECT rep, sum(c) AS n FROM b GROUP BY 1),
p AS (SELECT x.rep AS a, y.rep AS b, sum(least(x.c, y.c)) AS o FROM b x JOIN b y ON x.s = y.s AND x.rep < y.rep GROUP BY ALL),
l AS (SELECT p.a, p.b FROM p JOIN n na ON na.rep = p.a JOIN n nb ON nb.rep = p.b WHERE o >= 0.8 * (na.n + nb.n - o)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT rep AS id, rep AS root FROM t UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.id WHERE r.root < e.b),
c AS (SELECT text, (SELECT min(root) FROM r WHERE r.id = t.rep) AS class_id FROM t)
SELECT doc_id, coalesce(class_id, doc_id) AS class_id FROM documents LEFT JOIN c USING (text)"""

SPANS_SQL = """WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(len(w) - 19)) AS i FROM d WHERE len(w) >= 20),
k AS (SELECT doc_id, i, md5(array_to_string(w[i + 1:i + 20], ' ')) AS h FROM p),
f AS (SELECT doc_id, i, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS r FROM k),
c AS (SELECT DISTINCT doc_id, i + j AS pos FROM f, (SELECT unnest(range(20)) AS j) WHERE r > 1),
x AS (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS pos FROM d),
kept AS (SELECT x.doc_id, string_agg(word, ' ' ORDER BY x.pos) AS t, count(*) AS n FROM x ANTI JOIN c ON x.doc_id = c.doc_id AND x.pos = c.pos GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)"""


AUDIT_SQL = r"""WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, part, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY t) AS m FROM d),
f AS (SELECT doc_id, part, (len(w) < 100)::INT + 2 * (100 * len(list_distinct(w)) < 80 * len(w))::INT + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t))::INT
+ 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(doc_id > m, false)::INT AS mask FROM w),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY 1),
c AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f LEFT JOIN l USING (doc_id) GROUP BY 1, 2),
b AS (SELECT unnest(string_split('ABCDE', '')) AS x, unnest([1, 2, 4, 8, 16]) AS bit),
o AS (SELECT b1.x || b2.x || b3.x || b4.x || b5.x AS filter_order, [b1.bit, b2.bit, b3.bit, b4.bit, b5.bit] AS bits FROM b b1 JOIN b b2 ON b2.x <> b1.x JOIN b b3 ON b3.x NOT IN (b1.x, b2.x) JOIN b b4 ON b4.x NOT IN (b1.x, b2.x, b3.x) JOIN b b5 ON b5.x NOT IN (b1.x, b2.x, b3.x, b4.x)),
s AS (SELECT filter_order, step, bits[step] AS bit, coalesce(list_sum(bits[:step - 1]), 0)::INT AS before FROM o, (SELECT unnest(range(1, 6))::INT AS step)),
r AS (SELECT part, filter_order, step, bit, sum(n) FILTER (mask & (bit | before) = 0) AS kept, sum(n) FILTER (mask & bit <> 0 AND mask & before = 0) AS removed, sum(n) FILTER (mask & bit <> 0 AND mask & before <> 0) AS redundant,
sum(n) FILTER (mask = bit) AS unique_fails, sum(good) FILTER (mask & bit <> 0 AND mask & before = 0) AS good_lost, sum(toxic) FILTER (mask & bit <> 0 AND mask & before = 0) AS toxic_lost FROM c, s GROUP BY 1, 2, 3, 4)
SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails,
coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost, coalesce(sum(removed) OVER (PARTITION BY part, bit), 0)::BIGINT AS shapley FROM r"""


def _codes_sql(rounds: int = 6) -> str:
    """Lloyd's rounds one after the other; every distance is computed."""
    nearest = "SELECT p.id, p.part, min(list_sum(list_transform(range(1, len(p.s) + 1), lambda i: (p.s[i] - c.s[i]) * (p.s[i] - c.s[i])))::BIGINT * 16 + c.entry) AS best FROM p JOIN c{r} c ON c.part = p.part GROUP BY 1, 2"
    steps = []
    for r in range(rounds):
        steps.append(f"a{r} AS MATERIALIZED ({nearest.format(r=r)})")
        steps.append(f"u{r} AS (SELECT part, best % 16 AS entry, pos, sum(s[pos])::BIGINT AS t, count(*) AS n FROM (SELECT a.part, a.best, p.s, unnest(range(1, len(p.s) + 1)) AS pos FROM a{r} a JOIN p ON p.id = a.id AND p.part = a.part) GROUP BY 1, 2, 3)")
        steps.append(f"v{r} AS (SELECT part, entry, list((t - ((t % n + n) % n)) // n ORDER BY pos) AS s FROM u{r} GROUP BY 1, 2)")
        steps.append(f"c{r + 1} AS MATERIALIZED (SELECT c.part, c.entry, coalesce(v.s, c.s) AS s FROM c{r} c LEFT JOIN v{r} v ON v.part = c.part AND v.entry = c.entry)")
    return f"""WITH q AS (SELECT vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS q, row_number() OVER (ORDER BY vec_id) - 1 AS id FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT id, part, q[part * (len(q) // 8) + 1:(part + 1) * (len(q) // 8)] AS s FROM (SELECT id, q, unnest(range(8)) AS part FROM q)),
c0 AS MATERIALIZED (SELECT part, id AS entry, s FROM p WHERE id < 16),
{", ".join(steps)},
z AS MATERIALIZED ({nearest.format(r=rounds)}),
e AS (SELECT id, string_agg(format('{{:02x}}', best % 16), '' ORDER BY part) AS code, sum(best // 16)::BIGINT AS error FROM z GROUP BY 1),
k AS (SELECT sha256(string_agg(array_to_string(s, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM c{rounds})
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM e JOIN q USING (id), k"""


def oracle_sql() -> dict[str, str]:
    return {"op6_bag_minhash": CLASSES_SQL, "op8_warc_zstd": WARC_SQL, "op10_debruijn_spans": SPANS_SQL, "op11_mask_histogram": AUDIT_SQL, "op12_elkan_codes": _codes_sql()}
