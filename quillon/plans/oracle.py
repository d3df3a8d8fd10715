"""The catalog's queries in SQL, for an independent engine to run on the same tables."""

from __future__ import annotations

GAPS = {
    "euclidean": "list_distance({a}, {b})",
    "manhattan": "list_sum(list_transform(list_zip({a}, {b}), lambda z: abs(z[1] - z[2])))",
    "chebyshev": "list_max(list_transform(list_zip({a}, {b}), lambda z: abs(z[1] - z[2])))",
    "minkowski": "pow(list_sum(list_transform(list_zip({a}, {b}), lambda z: pow(abs(z[1] - z[2]), 3.0::DOUBLE))), 1.0::DOUBLE / 3)",
}
STRATIFIED = "(row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1) % 5"
LABELS = "labels_s AS (SELECT DISTINCT CAST(label AS VARCHAR) AS s FROM embeddings)"
GRADED = "SELECT d.doc_id AS row_idx, d.n_chars, l.quality, CAST(l.quality AS VARCHAR) AS label_s FROM documents d JOIN labels l USING (doc_id)"


def vectors(fold: str) -> str:
    return f"e AS (SELECT vec_id AS row_idx, CAST(label AS VARCHAR) AS s, CAST(embedding AS DOUBLE[]) AS x, {fold} AS fold FROM embeddings)"


def holdout(source: str, size: float, seed: int) -> str:
    """Fold of each row; ``source`` has row_idx, label (natural order) and label_s. Repairs of at most one row a class."""
    return f"""
        src AS ({source}),
        total AS (SELECT least(greatest(CAST(round_even(count(*) * CAST({size} AS DOUBLE), 0) AS BIGINT), 1), count(*) - 1) AS test_n FROM src),
        cls AS (SELECT label_s, min(label) AS label, count(*) AS m FROM src GROUP BY label_s),
        raw AS (SELECT label_s, row_number() OVER (ORDER BY label) - 1 AS ord, least(greatest(CAST(round_even(m * CAST({size} AS DOUBLE), 0) AS BIGINT), CASE WHEN m = 1 THEN 0 ELSE 1 END), CASE WHEN m = 1 THEN 0 ELSE m - 1 END) AS k FROM cls),
        gap AS (SELECT (SELECT test_n FROM total) - sum(k) AS diff FROM raw),
        quota AS (SELECT label_s, k + CASE WHEN ord < abs(diff) THEN sign(diff) ELSE 0 END AS k FROM raw, gap),
        dealt AS (SELECT row_idx, label_s, row_number() OVER (PARTITION BY label_s ORDER BY md5('{seed}:' || row_idx), row_idx) AS rk FROM src),
        folded AS (SELECT row_idx, label_s, CASE WHEN rk <= k THEN 0 ELSE -1 END AS fold_id FROM dealt JOIN quota USING (label_s))"""


def knn(k: int, gap: str = "euclidean", test: str = "TRUE") -> str:
    return f"""
        near AS (SELECT t.fold, t.row_idx, t.s AS true_s, r.s, r.row_idx AS r, {GAPS[gap].format(a="t.x", b="r.x")} AS d FROM e t JOIN e r ON t.fold <> r.fold WHERE {test}
                 QUALIFY row_number() OVER (PARTITION BY t.row_idx ORDER BY d, r.row_idx) <= {k}),
        votes AS (SELECT fold, row_idx, true_s, s, count(*) AS n, sum(d) AS sd FROM near GROUP BY ALL),
        pred AS (SELECT fold, row_idx, true_s, s AS pred_s FROM votes QUALIFY row_number() OVER (PARTITION BY row_idx ORDER BY n DESC, sd, s) = 1)"""


CENTROID = f"""
        {vectors(STRATIFIED)},
        long AS (SELECT fold, s, unnest(x) AS v, generate_subscripts(x, 1) AS i FROM e),
        folds AS (SELECT DISTINCT fold FROM e),
        mean AS (SELECT f.fold, s, i, avg(v) AS v FROM folds f JOIN long l ON f.fold <> l.fold GROUP BY ALL),
        cent AS (SELECT fold, s, list(v ORDER BY i) AS c FROM mean GROUP BY ALL),
        pred AS (SELECT t.fold, t.row_idx, t.s AS true_s, m.s AS pred_s FROM e t JOIN cent m ON t.fold = m.fold
                 QUALIFY row_number() OVER (PARTITION BY t.row_idx ORDER BY list_distance(t.x, m.c), m.s) = 1)"""
MATRIX = f"""
        {LABELS},
        cm AS (SELECT a.s AS true_label, b.s AS pred_label, count(p.row_idx) AS n FROM labels_s a CROSS JOIN labels_s b
               LEFT JOIN pred p ON p.true_s = a.s AND p.pred_s = b.s GROUP BY ALL)"""
RATED = """
        tot AS (SELECT CAST(sum(n) AS DOUBLE) AS total FROM cm),
        hits AS (SELECT true_label AS label_s, CAST(sum(n) AS DOUBLE) AS r, CAST(sum(CASE WHEN true_label = pred_label THEN n ELSE 0 END) AS DOUBLE) AS tp FROM cm GROUP BY 1),
        cols AS (SELECT pred_label AS label_s, CAST(sum(n) AS DOUBLE) AS c FROM cm GROUP BY 1),
        cnt AS (SELECT label_s, tp, r - tp AS fn, c - tp AS fp, total - r - c + tp AS tn FROM hits JOIN cols USING (label_s), tot),
        pr AS (SELECT *, CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END AS p, CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END AS q, CASE WHEN tn + fp = 0 THEN 0 ELSE tn / (tn + fp) END AS sp FROM cnt),
        rated AS (SELECT *, CASE WHEN p + q = 0 THEN 0 ELSE 2 * p * q / (p + q) END AS f FROM pr)"""
OVERALL = """
        sums AS (SELECT sum(r) AS s, sum(tp) AS c, sum(r * k) AS tp, sum(r * r) AS tt, sum(k * k) AS pp FROM (SELECT h.r, h.tp, c.c AS k FROM hits h JOIN cols c USING (label_s)))"""
OVERALL_ROW = "SELECT round(CASE WHEN s = 0 THEN 0 ELSE c / s END, 6) AS accuracy, round(CASE WHEN (s * s - pp) * (s * s - tt) = 0 THEN 0 ELSE (c * s - tp) / sqrt((s * s - pp) * (s * s - tt)) END, 6) AS mcc FROM sums"
PER_CLASS_ROW = "SELECT label_s, tp, fn, fp, tn, round(p, 6) AS precision, round(q, 6) AS recall, round(q, 6) AS sensitivity, round(sp, 6) AS specificity, round(f, 6) AS f1 FROM rated"
PREDICTED = "SELECT CAST(fold AS BIGINT) AS fold, row_idx, true_s, pred_s FROM pred"
#: Customers by market segment in stratified folds, and each fold's predictions.
SEGMENTS = """
        c AS (SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS row_idx, c_acctbal AS v, c_mktsegment AS s, (row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) - 1) % 5 AS fold FROM customer),
        cent AS (SELECT f.fold, c.s, avg(c.v) AS m FROM c JOIN (SELECT DISTINCT fold FROM c) f ON f.fold <> c.fold GROUP BY ALL),
        pred AS (SELECT t.fold, t.row_idx, t.s AS true_s, m.s AS pred_s FROM c t JOIN cent m ON t.fold = m.fold QUALIFY row_number() OVER (PARTITION BY t.row_idx ORDER BY abs(t.v - m.m), m.s) = 1)"""
SEGMENT_MATRIX = """
        labels_s AS (SELECT DISTINCT s FROM c),
        cm AS (SELECT a.s AS true_label, b.s AS pred_label, count(p.row_idx) AS n FROM labels_s a CROSS JOIN labels_s b LEFT JOIN pred p ON p.true_s = a.s AND p.pred_s = b.s GROUP BY ALL)"""
NUMBERED = "SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS row_idx, c_mktsegment AS label, c_mktsegment AS label_s, c_acctbal AS v FROM customer"
SEGMENT_SPLIT = f"""
        {holdout(NUMBERED, 0.2, 42)},
        c AS (SELECT f.row_idx, f.label_s AS s, x.v, f.fold_id FROM folded f JOIN ({NUMBERED}) x USING (row_idx)),
        cent AS (SELECT s, avg(v) AS m FROM c WHERE fold_id < 0 GROUP BY 1),
        pred AS (SELECT t.row_idx, t.s AS true_s, m.s AS pred_s FROM c t CROSS JOIN cent m WHERE t.fold_id = 0 QUALIFY row_number() OVER (PARTITION BY t.row_idx ORDER BY abs(t.v - m.m), m.s) = 1)"""
LINES = """
        cent AS (SELECT l_returnflag AS s, count(*) AS n, avg(l_quantity) AS c0, avg(l_extendedprice) AS c1, avg(l_discount) AS c2, avg(l_tax) AS c3 FROM lineitem GROUP BY 1),
        num AS (SELECT *, row_number() OVER () AS row_idx FROM lineitem),
        pred AS (SELECT row_idx, l_returnflag AS true_s, (SELECT arg_min(s, {'d': sqrt((l_quantity - c0) ** 2 + (l_extendedprice - c1) ** 2 + (l_discount - c2) ** 2 + (l_tax - c3) ** 2), 's': s}) FROM cent) AS pred_s FROM num),
        labels_s AS (SELECT s FROM cent),
        cm AS (SELECT a.s AS true_label, b.s AS pred_label, count(p.row_idx) AS n FROM labels_s a CROSS JOIN labels_s b LEFT JOIN pred p ON p.true_s = a.s AND p.pred_s = b.s GROUP BY ALL)"""

NATIONS = """
        cent AS (SELECT CAST(s_nationkey AS VARCHAR) AS s, avg(s_acctbal) AS c FROM supplier GROUP BY 1),
        pred AS (SELECT c_custkey AS row_idx, CAST(c_nationkey AS VARCHAR) AS true_s, s AS pred_s FROM customer CROSS JOIN cent QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY abs(c_acctbal - c), s) = 1),
        labels_s AS (SELECT DISTINCT CAST(k AS VARCHAR) AS s FROM (SELECT s_nationkey AS k FROM supplier UNION ALL SELECT c_nationkey FROM customer)),
        cm AS (SELECT a.s AS true_label, b.s AS pred_label, count(p.row_idx) AS n FROM labels_s a CROSS JOIN labels_s b LEFT JOIN pred p ON p.true_s = a.s AND p.pred_s = b.s GROUP BY ALL)"""
CLASHING = "p_brand || ',' || chr(10) || '\"' || right(p_brand, 1) || '\" ' AS label_s, CAST(p_partkey AS DOUBLE) AS f0, CAST(p_size AS DOUBLE) AS f1, CAST(p_partkey * 2 AS DOUBLE) AS f2, CAST(p_size * 3 AS DOUBLE) AS f3, CAST(p_retailprice AS DOUBLE) AS f4 FROM part"


def statements() -> dict[str, str]:
    cust = "SELECT c_custkey AS row_idx, c_mktsegment AS label, c_mktsegment AS label_s FROM customer"
    found = {
        "feature_scan": "SELECT p_partkey AS row_idx, p_brand AS label_s, CAST(p_size AS DOUBLE) AS f0, CAST(p_retailprice AS DOUBLE) AS f1 FROM part",
        "row_numbers": "SELECT count(*) AS n, CAST(0 AS BIGINT) AS low, count(*) - 1 AS high, count(*) AS distinct_n FROM lineitem",
        "class_counts": "SELECT c_mktsegment AS label_s, count(*) AS n FROM customer GROUP BY 1",
        "class_dictionary": "SELECT row_number() OVER (ORDER BY label_s) - 1 AS position, label_s FROM (SELECT DISTINCT event_type AS label_s FROM events)",
        "kfold_plain_assign": "SELECT c_custkey AS row_idx, (row_number() OVER (ORDER BY c_custkey) - 1) % 5 AS fold_id FROM customer",
        "kfold_plain_shuffled": "SELECT c_custkey AS row_idx, (row_number() OVER (ORDER BY md5('42:' || c_custkey), c_custkey) - 1) % 5 AS fold_id FROM customer",
        "kfold_strat_assign": "SELECT c_custkey AS row_idx, (row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) - 1) % 5 AS fold_id FROM customer",
        "kfold_strat_shuffled": "SELECT c_custkey AS row_idx, (row_number() OVER (PARTITION BY c_mktsegment ORDER BY md5('42:' || c_custkey), c_custkey) - 1) % 5 AS fold_id FROM customer",
        "holdout_plain": "SELECT c_custkey AS row_idx, CASE WHEN row_number() OVER (ORDER BY md5('42:' || c_custkey), c_custkey) <= round_even(count(*) OVER () * CAST(0.2 AS DOUBLE), 0) THEN 0 ELSE -1 END::BIGINT AS fold_id FROM customer",
        "holdout_strat": f"WITH {holdout(cust, 0.2, 42)} SELECT row_idx, CAST(fold_id AS BIGINT) AS fold_id FROM folded",
        "holdout_strat_imbalanced": f"WITH {holdout(f'SELECT row_idx, quality AS label, label_s FROM ({GRADED})', 0.25, 7)} SELECT row_idx, CAST(fold_id AS BIGINT) AS fold_id FROM folded",
        "kfold_fold_stats": """
            WITH o AS (SELECT o_orderstatus AS label_s, (row_number() OVER (PARTITION BY o_orderstatus ORDER BY md5('42:' || o_orderkey), o_orderkey) - 1) % 10 AS fold_id FROM orders),
            grid AS (SELECT fold_id, label_s FROM (SELECT DISTINCT fold_id FROM o) CROSS JOIN (SELECT DISTINCT label_s FROM o))
            SELECT fold_id, label_s, (SELECT count(*) FROM o WHERE o.fold_id = grid.fold_id AND o.label_s = grid.label_s) AS n_test,
                   (SELECT count(*) FROM o WHERE o.fold_id <> grid.fold_id AND o.label_s = grid.label_s) AS n_train FROM grid""",
        "loo_fold_stats": f"""
            WITH g AS ({GRADED}), c AS (SELECT label_s, count(*) AS n FROM g GROUP BY 1)
            SELECT g.row_idx AS fold_id, c.label_s, CAST(g.label_s = c.label_s AS BIGINT) AS n_test, c.n - CAST(g.label_s = c.label_s AS BIGINT) AS n_train FROM g CROSS JOIN c""",
        "partition_export_rows": f"""
            WITH g AS (SELECT row_idx, label_s, (row_number() OVER (PARTITION BY label_s ORDER BY row_idx) - 1) % 5 AS fold_id FROM ({GRADED}))
            SELECT f.fold, CASE WHEN f.fold = g.fold_id THEN 'test' ELSE 'train' END AS role, row_idx, label_s FROM g CROSS JOIN (SELECT DISTINCT fold_id AS fold FROM g) f""",
        "knn_neighbors_topk": f"WITH {vectors('vec_id')} SELECT t.row_idx, row_number() OVER (PARTITION BY t.row_idx ORDER BY list_distance(t.x, r.x), r.row_idx) AS nth, r.row_idx AS neighbour, round(list_distance(t.x, r.x), 6) AS d FROM e t JOIN e r ON t.fold <> r.fold QUALIFY nth <= 5",
        "knn_kfold_predict": f"WITH {vectors(STRATIFIED)}, {knn(3)} {PREDICTED}",
        "knn_blocked_predict": f"WITH {vectors(STRATIFIED)}, {knn(3)} {PREDICTED}",
        "knn_pruned_predict": f"WITH {vectors(STRATIFIED)}, {knn(3)} {PREDICTED}",
        "knn_pruned_manhattan_predict": f"WITH {holdout('SELECT c_custkey AS row_idx, c_nationkey AS label, CAST(c_nationkey AS VARCHAR) AS label_s FROM customer', 0.25, 7)}, e AS (SELECT row_idx, label_s AS s, [CAST(c_acctbal AS DOUBLE)] AS x, fold_id AS fold FROM folded JOIN customer ON c_custkey = row_idx), {knn(5, 'manhattan', test='t.fold >= 0')} {PREDICTED}",
        "knn_pruned_topk": "WITH e AS (SELECT p_partkey AS row_idx, [CAST(p_size AS DOUBLE), CAST(p_retailprice AS DOUBLE)] AS x FROM part) SELECT t.row_idx, row_number() OVER (PARTITION BY t.row_idx ORDER BY list_distance(t.x, r.x), r.row_idx) AS nth, r.row_idx AS neighbour, round(list_distance(t.x, r.x), 6) AS d FROM e t JOIN e r ON t.row_idx <> r.row_idx QUALIFY nth <= 5",
        "knn_loo_1nn_predict": f"WITH {vectors('vec_id')}, {knn(1)} {PREDICTED}",
        "knn_manhattan_predict": f"WITH {vectors(STRATIFIED)}, {knn(3, 'manhattan')} {PREDICTED}",
        "knn_chebyshev_predict": f"WITH {vectors(STRATIFIED)}, {knn(3, 'chebyshev')} {PREDICTED}",
        "knn_minkowski_predict": f"WITH {vectors(STRATIFIED)}, {knn(3, 'minkowski')} {PREDICTED}",
        "knn_holdout_predict": f"WITH {holdout('SELECT vec_id AS row_idx, label, CAST(label AS VARCHAR) AS label_s FROM embeddings', 0.25, 7)}, e AS (SELECT row_idx, label_s AS s, CAST(embedding AS DOUBLE[]) AS x, fold_id AS fold FROM folded JOIN embeddings ON vec_id = row_idx), {knn(5, test='t.fold >= 0')} {PREDICTED}",
        "knn_vote_tiebreak": f"WITH e AS (SELECT p_partkey AS row_idx, p_brand AS s, [CAST(p_size AS DOUBLE)] AS x, (row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1) % 5 AS fold FROM part), {knn(4)} {PREDICTED}",
        "centroid_fit": f"WITH {LINES} SELECT s AS label_s, n, round(c0, 6) AS c0, round(c1, 6) AS c1, round(c2, 6) AS c2, round(c3, 6) AS c3 FROM cent",
        "centroid_train_test_predict": """
            WITH cent AS (SELECT CAST(s_nationkey AS VARCHAR) AS s, avg(s_acctbal) AS c FROM supplier GROUP BY 1)
            SELECT CAST(0 AS BIGINT) AS fold, c_custkey AS row_idx, CAST(c_nationkey AS VARCHAR) AS true_s, s AS pred_s FROM customer CROSS JOIN cent
            QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY abs(c_acctbal - c), s) = 1""",
        "knn_train_test_predict": f"""
            WITH e AS (SELECT c_custkey AS row_idx, CAST(c_nationkey AS VARCHAR) AS s, [CAST(c_acctbal AS DOUBLE)] AS x, 0 AS fold FROM customer
                       UNION ALL SELECT s_suppkey, CAST(s_nationkey AS VARCHAR), [CAST(s_acctbal AS DOUBLE)], -1 FROM supplier), {knn(3, test='t.fold >= 0')} {PREDICTED}""",
        "centroid_kfold_predict": f"WITH {CENTROID} {PREDICTED}",
        "centroid_loo_predict": f"""
            WITH {vectors('vec_id')},
            long AS (SELECT s, unnest(x) AS v, generate_subscripts(x, 1) AS i FROM e),
            part AS (SELECT s, i, sum(v) AS v FROM long GROUP BY ALL),
            whole AS (SELECT s, list(v ORDER BY i) AS v FROM part GROUP BY ALL),
            tot AS (SELECT w.s, w.v, c.n FROM whole w JOIN (SELECT s, count(*) AS n FROM e GROUP BY 1) c USING (s)),
            met AS (SELECT t.fold, t.row_idx, t.s AS true_s, m.s, t.x, CASE WHEN t.s = m.s THEN list_transform(list_zip(m.v, t.x), lambda z: (z[1] - z[2]) / (m.n - 1)) ELSE list_transform(m.v, lambda z: z / m.n) END AS c FROM e t CROSS JOIN tot m WHERE t.s <> m.s OR m.n > 1),
            pred AS (SELECT fold, row_idx, true_s, s AS pred_s FROM met QUALIFY row_number() OVER (PARTITION BY row_idx ORDER BY list_distance(x, c), s) = 1)
            {PREDICTED}""",
        "centroid_lineitem_confusion": f"WITH {LINES} SELECT true_label, pred_label, n FROM cm",
        "lineitem_metrics": f"WITH {LINES}, {RATED} {PER_CLASS_ROW}",
        "confusion_long": f"WITH {CENTROID}, {MATRIX} SELECT true_label, pred_label, n FROM cm",
        "confusion_wide": f"WITH {CENTROID}, {MATRIX} SELECT 'true_' || true_label AS label, {', '.join(f'''max(n) FILTER (pred_label = '{i}') AS pred_{i}''' for i in range(10))} FROM cm GROUP BY true_label",
        "confusion_norm_rows": f"WITH {CENTROID}, {MATRIX} SELECT true_label, pred_label, round(n / greatest(sum(n) OVER (PARTITION BY true_label), 1), 6) AS share FROM cm",
        "confusion_norm_cols": f"WITH {CENTROID}, {MATRIX} SELECT true_label, pred_label, round(n / greatest(sum(n) OVER (PARTITION BY pred_label), 1), 6) AS share FROM cm",
        "metrics_per_class": f"WITH {CENTROID}, {MATRIX}, {RATED} {PER_CLASS_ROW}",
        "metrics_macro": f"WITH {CENTROID}, {MATRIX}, {RATED} SELECT round(avg(p), 6) AS macro_precision, round(avg(q), 6) AS macro_recall, round(avg(q), 6) AS macro_sensitivity, round(avg(sp), 6) AS macro_specificity, round(avg(f), 6) AS macro_f1, round(avg(q), 6) AS balanced_accuracy FROM rated",
        "metrics_mcc": f"WITH {CENTROID}, {MATRIX}, {RATED}, {OVERALL} {OVERALL_ROW}",
        "support": "SELECT CAST(label AS VARCHAR) AS label_s, count(*) AS support FROM embeddings GROUP BY 1",
        "merged_labels": "SELECT DISTINCT CAST(k AS VARCHAR) AS label_s, CAST(k AS VARCHAR) AS label FROM (SELECT s_nationkey AS k FROM supplier UNION ALL SELECT c_nationkey FROM customer)",
        "pooled_run_summary": f"WITH {vectors(STRATIFIED)}, {knn(3)}, {MATRIX}, {RATED}, {OVERALL} {OVERALL_ROW}",
    }
    shares = ", ".join(f"max(n) FILTER (pred_label = '{x}') AS pred_{x}" for x in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"))
    found |= {
        "csv_scan": "SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS row_idx, p_brand AS label_s, CAST(p_size AS DOUBLE) AS f0, CAST(p_retailprice AS DOUBLE) AS f1 FROM part",
        "stream_confusion": f"WITH e AS (SELECT event_id AS row_idx, event_type AS s, [CAST(value AS DOUBLE)] AS x, CASE WHEN event_id % 5 = 0 THEN -1 ELSE 0 END AS fold FROM events), {knn(3, test='t.fold >= 0')} SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS start, true_s AS true_label, pred_s AS pred_label, count(*) AS n FROM pred JOIN events ON event_id = row_idx GROUP BY ALL",
        "confusion_sparse": f"WITH {NATIONS} SELECT true_label, pred_label, n FROM cm WHERE n > 0",
        "metrics_sparse_per_class": f"WITH {NATIONS}, {RATED} {PER_CLASS_ROW}",
        "metrics_sparse_summary": f"WITH {NATIONS}, {RATED}, {OVERALL} SELECT m.*, o.* FROM ({OVERALL_ROW}) o, (SELECT round(sum(p) / (count(*) + 1), 6) AS macro_precision, round(sum(q) / (count(*) + 1), 6) AS macro_recall, round(sum(q) / (count(*) + 1), 6) AS macro_sensitivity, round((sum(sp) + 1) / (count(*) + 1), 6) AS macro_specificity, round(sum(f) / (count(*) + 1), 6) AS macro_f1, round(sum(q) / (count(*) + 1), 6) AS balanced_accuracy FROM rated) m",
        "holdout_joined_quotas": f"WITH {holdout('SELECT p_partkey AS row_idx, p_brand AS label, p_brand AS label_s FROM part', 0.333, 42)} SELECT label_s, CAST(k AS BIGINT) AS k FROM quota",
        "csv_quoted_scan": f"SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS row_idx, {CLASHING}",
        "clashing_columns": f"SELECT p_partkey AS row_idx, {CLASHING}",
        "float_labels": "SELECT p_partkey AS row_idx, CAST(CAST(CAST(p_size AS VARCHAR) || 'e' || CAST(p_partkey % 25 - 7 AS VARCHAR) AS DOUBLE) AS VARCHAR) AS label_s FROM part",
        "csv_columns": "SELECT CAST(i AS BIGINT) AS position, f AS feature, (SELECT count(*) FROM customer) AS n FROM (VALUES (0, 'c_custkey'), (1, 'c_acctbal')) x(i, f)",
        "run_predictions_file": f'WITH {SEGMENTS} SELECT fold, row_idx AS "index", true_s AS y_true, pred_s AS y_pred FROM pred',
        "classify_predictions_file": f'WITH {SEGMENT_SPLIT} SELECT row_idx AS "index", true_s AS y_true, pred_s AS y_pred FROM pred',
        "run_metrics_file": f"WITH {SEGMENTS}, {SEGMENT_MATRIX}, {RATED}, {OVERALL} SELECT o.accuracy, m.balanced_accuracy, o.mcc, m.macro_f1, m.n_labels FROM ({OVERALL_ROW}) o, (SELECT round(avg(q), 6) AS balanced_accuracy, round(avg(f), 6) AS macro_f1, count(*) AS n_labels FROM rated) m",
        "run_matrix_file": f"WITH {SEGMENTS}, {SEGMENT_MATRIX} SELECT 'true_' || true_label AS label, {shares} FROM cm GROUP BY true_label",
        "run_meta_file": "SELECT 'run' AS mode, 'run' AS run_name, CAST(5 AS BIGINT) AS n_folds, count(*) AS n_samples, CAST(1 AS BIGINT) AS n_features FROM customer",
        "classify_meta_file": f"WITH {SEGMENT_SPLIT} SELECT 'classify_dataset_split' AS mode, (SELECT count(*) FROM folded WHERE fold_id < 0) AS n_train, (SELECT count(*) FROM folded WHERE fold_id = 0) AS n_test, (SELECT count(DISTINCT s) FROM c) AS n_labels",
        "validate_meta_file": f"WITH {SEGMENTS} SELECT fold, (SELECT count(*) FROM c) - count(*) AS train_size, count(*) AS test_size, count(*) FILTER (s = 'BUILDING') AS building FROM c GROUP BY fold",
        "classify_pair_predictions_file": f"""
            WITH e AS (SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS row_idx, CAST(c_nationkey AS VARCHAR) AS s, [CAST(c_acctbal AS DOUBLE)] AS x, 0 AS fold FROM customer
                       UNION ALL SELECT row_number() OVER (ORDER BY s_suppkey) - 1, CAST(s_nationkey AS VARCHAR), [CAST(s_acctbal AS DOUBLE)], -1 FROM supplier), {knn(3, test='t.fold >= 0')}
            SELECT row_idx AS "index", true_s AS y_true, pred_s AS y_pred FROM pred""",
        "classify_pair_meta_file": "SELECT 'classify_train_test' AS mode, (SELECT count(*) FROM supplier) AS n_train, (SELECT count(*) FROM customer) AS n_test, (SELECT count(*) FROM (SELECT s_nationkey FROM supplier UNION SELECT c_nationkey FROM customer)) AS n_labels",
        "validate_loo_meta_file": """
            WITH c AS (SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS fold, c_mktsegment AS s, count(*) OVER () AS n FROM customer)
            SELECT fold, n - 1 AS train_size, CAST(1 AS BIGINT) AS test_size, CAST(s = 'BUILDING' AS BIGINT) AS building FROM c WHERE fold < 50""",
        "run_overridden_file": f'WITH {SEGMENTS.replace("% 5", "% 4")} SELECT fold, row_idx AS "index", true_s AS y_true, pred_s AS y_pred FROM pred',
        "exported_partition_files": f"WITH {SEGMENTS} SELECT f.fold, CASE WHEN f.fold = c.fold THEN 'test' ELSE 'train' END AS role, count(*) AS n, round(sum(v), 6) AS total FROM c CROSS JOIN (SELECT DISTINCT fold FROM c) f GROUP BY 1, 2",
        "confusion_of_some": f"WITH {CENTROID}, listed AS (SELECT unnest(['0', '3', '7', 'none']) AS s) SELECT a.s AS true_label, b.s AS pred_label, count(p.row_idx) AS n FROM listed a CROSS JOIN listed b LEFT JOIN pred p ON p.true_s = a.s AND p.pred_s = b.s GROUP BY ALL",
        "matrix_drawing": f"WITH {CENTROID}, {MATRIX} SELECT true_label, pred_label, round(n / greatest(sum(n) OVER (PARTITION BY true_label), 1), 6) AS value, 'Confusion Matrix (Normalized by Rows)' AS title FROM cm",
        "row_numbers_of_join": "SELECT count(*) AS n, CAST(0 AS BIGINT) AS low, count(*) - 1 AS high, count(*) AS distinct_n, count(*) AS known_n FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
        "centroid_loo_small_predict": """
            WITH c AS (SELECT c_custkey AS row_idx, c_mktsegment AS s, c_acctbal AS v FROM customer),
            tot AS (SELECT s, sum(v) AS v, count(*) AS n FROM c GROUP BY 1)
            SELECT t.row_idx AS fold, t.row_idx, t.s AS true_s, m.s AS pred_s FROM c t CROSS JOIN tot m WHERE t.s <> m.s OR m.n > 1
            QUALIFY row_number() OVER (PARTITION BY t.row_idx ORDER BY abs(t.v - CASE WHEN t.s = m.s THEN (m.v - t.v) / (m.n - 1) ELSE m.v / m.n END), m.s) = 1""",
    }
    means = f"WITH {vectors('0')}, long AS (SELECT s, unnest(x) AS v, generate_subscripts(x, 1) AS i FROM e), mean AS (SELECT s, i, avg(v) AS v FROM long GROUP BY ALL), cent AS (SELECT s, list(v ORDER BY i) AS c FROM mean GROUP BY ALL)"
    for name, gap in GAPS.items():
        found[f"dist_{name}"] = f"{means} SELECT e.row_idx, cent.s AS to_class, round({gap.format(a='e.x', b='cent.c')}, 6) AS d FROM e CROSS JOIN cent"
    return found
