"""The registered queries of this subpackage and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import compaction, langid, mixing, mpegts, neardup, packing, pii, quality, secrets, sstable


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_pii_bootstrapped_context": pii.op1_pii_bootstrapped_context,
        "op2_secret_blob_ledger": secrets.op2_secret_blob_ledger,
        "op3_minmax_near_dedup": neardup.op3_minmax_near_dedup,
        "op4_token_sstable": sstable.op4_token_sstable,
        "op5_media_transport_stream": mpegts.op5_media_transport_stream,
        "op6_best_fit_packing": packing.op6_best_fit_packing,
        "op7_size_tiered_shards": compaction.op7_size_tiered_shards,
        "op8_quality_isolation_forest": quality.op8_quality_isolation_forest,
        "op9_language_kneser_ney": langid.op9_language_kneser_ney,
        "op10_pfair_mixture": mixing.op10_pfair_mixture,
    }


_FOUND = """SELECT r, {kind} AS kind, unnest(range(1, len(m) + 1)) AS i, m, g, s FROM (
    SELECT r, regexp_extract_all(t, '{p}') AS m, regexp_extract_all(t, '{p}', 1) AS g, string_split_regex(t, '{p}') AS s FROM d)"""


def _secrets_sql() -> str:
    found = " UNION ALL ".join(_FOUND.format(kind=i, p=rule.pattern.replace("'", "''")) for i, rule in enumerate(secrets.RULES))
    names = ", ".join(f"'{r.kind}'" for r in secrets.RULES)
    counts = ", ".join(f"count(kind) FILTER (kind = {i}) AS n_{r.kind}" for i, r in enumerate(secrets.RULES))
    return f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents), f AS ({found}),
    p AS (SELECT r, kind, list_sum(list_transform(s[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) AS a, length(m[i]) AS n FROM f WHERE kind <> 0 OR length(g[i]) >= 12),
    o AS (SELECT d.r, d.doc_id, {counts}, coalesce(string_agg([{names}][kind + 1] || ':' || CAST(a AS BIGINT) || ':' || CAST(a + n AS BIGINT), ',' ORDER BY a, kind), '') AS spans FROM d LEFT JOIN p ON p.r = d.r GROUP BY d.r, d.doc_id)
    SELECT * EXCLUDE (r), sha256(spans) AS base_sha256 FROM o"""


#: Shared shingles give exact intersections, closures give components; doc_id is taken as unique.
_NEAR_SQL = r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^ 	-]+') AS w FROM documents),
    sh AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w),
    n AS (SELECT doc_id, count(*) AS n, md5(string_agg(s, chr(10) ORDER BY s)) AS sig FROM sh GROUP BY doc_id),
    pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
    links AS MATERIALIZED (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
    reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.o FROM reach r JOIN (SELECT a AS k, b AS o FROM links UNION ALL SELECT b, a FROM links) l ON l.k = r.b)
    SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.c AS component_id, d.doc_id = m.c AS kept, CASE WHEN n.n IS NULL THEN d.doc_id ELSE min(d.doc_id) OVER (PARTITION BY n.sig) END AS class_id
    FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT a, min(b) AS c FROM reach GROUP BY a) m ON m.a = d.doc_id"""


def oracle_sql() -> dict[str, str]:
    """Of the other operators, results hang on float models, file layouts, hashes or searches; tests/llm has their brute-force versions."""
    return {"op2_secret_blob_ledger": _secrets_sql(), "op3_minmax_near_dedup": _NEAR_SQL}
