"""Queries of the training-data operators, with their DuckDB counterparts where SQL can express them."""

from __future__ import annotations

from . import bpe, decontaminate, hamerly, html, pii, quality, ranked, repair, simhash, tokengroups, topk, toxicity, warc

QUERIES = {
    "op1_warc": warc.op1,
    "op2_decontamination": decontaminate.op2,
    "op3_toxicity": toxicity.op3,
    "op4_bpe": bpe.op4,
    "op5_personal_data": pii.op5,
    "op6_html": html.op6,
    "op7_simhash": simhash.op7,
    "op8_token_ids": repair.op8,
    "op9_quality": quality.op9,
    "op10_topk": topk.op10,
    "op11_jaccard": tokengroups.op11,
    "op12_clusters": hamerly.op12,
    "op13_ranked": ranked.op13,
}

ORACLES = {
    "op1_warc": """
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
        d AS (SELECT page_id, octet_length(b) AS payload_bytes, sha256(b) AS payload_digest FROM p),
        f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to,
               cast(greatest(1, ceil(CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 0 ELSE payload_bytes END / 262144.0)) AS INTEGER) AS n_chunks
        FROM f""",
    "op10_topk": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
                   WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
        s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
              FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10""",
    "op11_jaccard": tokengroups.SQL,
    "op12_clusters": hamerly.sql(),
    "op13_ranked": ranked.SQL,
}
