"""Queries and SQL of the training-data operators."""

from __future__ import annotations

from quillon.llm import corpus_queries

OP4_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""


def _op11_sql(rounds: int = 4) -> str:
    """Plain Lloyd rounds over parts; distances are whole numbers, which doubles hold exactly."""
    steps = [
        "kept AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS q FROM embeddings WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        "parts AS MATERIALIZED (SELECT vec_id, p, q[p * (len(q) // 4) + 1 : (p + 1) * (len(q) // 4)] AS v FROM kept, range(4) t(p))",
        "book0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, v AS c FROM parts QUALIFY e < 256)",
    ]
    for r in range(rounds + 1):
        steps.append(
            f"near{r} AS MATERIALIZED (SELECT vec_id, p, b.e, list_dot_product(v, v) - 2 * list_dot_product(v, c) + list_dot_product(c, c) AS d, v FROM parts JOIN book{r} b USING (p)"
            f" QUALIFY row_number() OVER (PARTITION BY vec_id, p ORDER BY d, b.e) = 1)"
        )
        if r < rounds:
            steps += [
                f"flat{r} AS (SELECT p, e, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM near{r})",
                f"mean{r} AS (SELECT p, e, list(x ORDER BY i) AS c FROM (SELECT p, e, i, floor(sum(x) / count(*)) AS x FROM flat{r} GROUP BY p, e, i) GROUP BY p, e)",
                f"book{r + 1} AS MATERIALIZED (SELECT p, e, coalesce(m.c, b.c) AS c FROM book{r} b LEFT JOIN mean{r} m USING (p, e))",
            ]
    last = rounds
    steps += [
        f"codes AS (SELECT vec_id, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM near{last} GROUP BY vec_id)",
        f"numbers AS (SELECT p, e, unnest(c) AS x, generate_subscripts(c, 1) AS i FROM book{last})",
        "digest AS (SELECT sha256(string_agg(CAST(CAST(x AS BIGINT) AS VARCHAR), ',' ORDER BY p, e, i)) AS h FROM numbers)",
    ]
    return f"WITH {', '.join(steps)} SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256 FROM codes JOIN kept USING (vec_id), digest"


def pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return corpus_queries.queries() | {"pipeline": pipeline}


def oracle_sql() -> dict[str, str]:
    return {"op4_exact_dedup": OP4_SQL, "op11_vector_codes": _op11_sql()}
