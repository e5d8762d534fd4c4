"""DuckDB statements equal to the registered queries (``oracle_sql()``).

Written as plain SQL over the pre-registered views. Rules: every computed
column aliased as on the Spark side; doubles rounded to 6 places; integer
aggregates cast to BIGINT; no division by a possibly zero divisor
(``nullif``). Keys with no entry here (model fits) get the rows-only check.
"""

from __future__ import annotations

from cohortlab.operators.models import MANY_ROUNDS, MODEL_NAMES, ONE_ROUND
from cohortlab.plans.catalog import LI_FEATURES, LI_KEYS
from cohortlab.plans.model_data import TEXT_FEATURES
from cohortlab.plans.queries import (BASELINE_CLASS, CUT_RULE, LI_FAMILIES, PCA_COLS, POSITIVE_CLASS,
                                     PRICE_RULE, RULES, SALT, TREE_DEPTH, TREE_FEATURES)

D = 6
KEYS = ", ".join(LI_KEYS)
LI_COLS = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
           "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus")
LI_DOUBLES = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")
LI_NUMERIC = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", *LI_DOUBLES)


def _r(expr: str, alias: str) -> str:
    return f"round({expr}, {D}) AS {alias}"


def _li_select(cols=LI_COLS) -> str:
    return ", ".join(_r(c, c) if c in LI_DOUBLES else c for c in cols)


def _bucket(keys: str, salt: str) -> str:
    return f"substr(md5(concat_ws(':', '{salt}', {keys})), 1, 8)"


def _split2(keys: str, salt: str = SALT) -> str:
    return f"CASE WHEN {_bucket(keys, salt)} < 'cccccccc' THEN 'train' ELSE 'test' END"


def _split3(keys: str, salt: str = SALT) -> str:
    digest = f"md5(concat_ws(':', '{salt}', {keys}))"
    return (f"CASE WHEN substr({digest}, 1, 8) >= 'cccccccc' THEN 'test' "
            f"WHEN substr({digest}, 9, 8) < 'cccccccc' THEN 'train' ELSE 'val' END")


def _label() -> str:
    return f"CASE WHEN l_returnflag = '{POSITIVE_CLASS}' THEN 1 ELSE 0 END"


def _scored_cte() -> str:
    return (f"s AS (SELECT *, {_label()} AS label, "
            f"(l_extendedprice > {PRICE_RULE}::DOUBLE)::DOUBLE "
            f"AS prediction, l_extendedprice AS score, {_split3(KEYS)} AS split FROM lineitem)")


def _customer_nulls_cte() -> str:
    rule = [("c_custkey", 0), ("c_name", 1000), ("c_nationkey", 2500),
            ("c_mktsegment", 5000), ("c_acctbal", 7500)]
    cols = ", ".join(f"CASE WHEN c_acctbal < {t}.0::DOUBLE THEN NULL ELSE {c} END AS {c}"
                     for c, t in rule)
    return f"c AS (SELECT {cols} FROM customer)"


_NULLS = ("(c_custkey IS NULL)::INT + (c_name IS NULL)::INT + (c_nationkey IS NULL)::INT"
          " + (c_mktsegment IS NULL)::INT + (c_acctbal IS NULL)::INT")


def _stats_cte() -> str:
    parts = [f"SELECT l_returnflag, '{c}' AS attribute, count({c}) AS n, "
             f"avg({c}::DOUBLE) AS avg_value, min({c})::DOUBLE AS min_value, "
             f"max({c})::DOUBLE AS max_value FROM lineitem GROUP BY l_returnflag"
             for c in LI_FEATURES]
    return "st AS (" + " UNION ALL ".join(parts) + ")"


def _scaled(v: str, lo: str, hi: str) -> str:
    return f"({v} - {lo}) / nullif({hi} - {lo}, 0)"


def _records_cte() -> str:
    order = ", ".join(f"{k} NULLS FIRST" for k in LI_KEYS)
    rec = (f"rec AS (SELECT * FROM (SELECT *, rank() OVER (PARTITION BY l_returnflag "
           f"ORDER BY {order}) AS rk FROM lineitem) WHERE rk = 1)")
    long = "lng AS (" + " UNION ALL ".join(
        f"SELECT {KEYS}, l_returnflag, '{c}' AS attribute, {c}::DOUBLE AS value FROM rec"
        for c in LI_FEATURES) + ")"
    prof = (f"prof AS (SELECT lng.*, st.min_value, st.max_value, "
            f"{_scaled('value', 'st.min_value', 'st.max_value')} AS scaled FROM lng "
            f"LEFT JOIN st ON lng.l_returnflag IS NOT DISTINCT FROM st.l_returnflag "
            f"AND lng.attribute = st.attribute)")
    return f"{rec}, {long}, {prof}"


def _std_scaled(x: str, sd: str) -> str:
    """x / sd as the scaler does it: 0 where the deviation is 0 or undefined."""
    return f"CASE WHEN coalesce({sd}, 0) = 0 THEN 0.0 ELSE {x} / ({sd}) END"


def _cm_cols(pred: str = "prediction", label: str = "label") -> str:
    return (f"count(*)::BIGINT AS n, count_if({pred} = {label})::BIGINT AS correct, "
            f"count_if(NOT coalesce({pred} = {label}, false))::BIGINT AS wrong, "
            f"count_if({pred} = 1 AND {label} = 1)::BIGINT AS tp, "
            f"count_if({pred} <> 1 AND {label} <> 1)::BIGINT AS tn, "
            f"count_if({pred} = 1 AND {label} <> 1)::BIGINT AS fp, "
            f"count_if({pred} <> 1 AND {label} = 1)::BIGINT AS fn")


def _hard_auc() -> str:
    return "(tp::DOUBLE / nullif(tp + fn, 0) + tn::DOUBLE / nullif(tn + fp, 0)) / 2"


def _pca_cte() -> str:
    a, b = PCA_COLS

    def tr(c):
        return f"CASE WHEN split = 'train' THEN {c} END"
    return (f"s AS (SELECT *, {_split3(KEYS)} AS split, {_label()} AS label, "
            f"l_extendedprice * (1.0::DOUBLE - l_discount) AS disc_price FROM lineitem), "
            f"w AS (SELECT *, {_std_scaled(a, f'stddev_samp({tr(a)}) OVER ()')} AS a, "
            f"{_std_scaled(b, f'stddev_samp({tr(b)}) OVER ()')} AS b, "
            f"corr({tr(a)}, {tr(b)}) OVER () AS r FROM s), "
            f"p AS (SELECT *, CASE WHEN r >= 0 THEN a + b ELSE a - b END / sqrt(2) AS pc1, "
            f"CASE WHEN r >= 0 THEN a - b ELSE a + b END / sqrt(2) AS pc2 FROM w)")


_WS = r"[\x20\x09-\x0D]"


def _share(pattern: str) -> str:
    return f"coalesce((length(t) - length(regexp_replace(t, '{pattern}', '', 'g')))::DOUBLE / nullif(length(t), 0), 0)"


def build() -> dict[str, str]:
    q: dict[str, str] = {}
    q["csv_scan"] = "SELECT * FROM customer"
    q["csv_text"] = ("SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN NULL WHEN 1 THEN '' "
                     "WHEN 2 THEN '\"' || text || ' \"\", ' || chr(13) || chr(10) || ' x' || chr(92) "
                     "ELSE text END AS text, lang FROM documents")
    q["view_sql"] = ("SELECT l_returnflag, count(*)::BIGINT AS n, "
                     f"{_r('avg(l_quantity)', 'avg_qty')}, {_r('max(l_extendedprice)', 'max_price')} "
                     "FROM lineitem WHERE l_discount >= 0.05::DOUBLE GROUP BY l_returnflag")
    q["drop_null_heavy_rows"] = (f"WITH {_customer_nulls_cte()} SELECT c_custkey, c_name, "
                                 f"c_nationkey, c_mktsegment, {_r('c_acctbal', 'c_acctbal')} "
                                 f"FROM c WHERE NOT ({_NULLS} >= 4.5)")
    q["row_null_count"] = (f"WITH {_customer_nulls_cte()} SELECT c_custkey, c_name, c_nationkey, "
                           f"c_mktsegment, {_r('c_acctbal', 'c_acctbal')}, {_NULLS} AS null_count "
                           f"FROM c")
    q["encode_label"] = f"SELECT {KEYS}, l_returnflag, {_label()} AS label FROM lineitem"
    q["cast_label"] = f"SELECT {KEYS}, ({_label()})::DOUBLE AS label FROM lineitem"
    q["project_mean"] = "SELECT l_returnflag, l_orderkey, l_partkey, l_suppkey FROM lineitem"
    q["project_se"] = f"SELECT {_r('l_extendedprice', 'l_extendedprice')} FROM lineitem"
    q["project_worst"] = "SELECT l_linestatus FROM lineitem"
    q["class_subset"] = (f"SELECT {_li_select()}, l_shipdate::VARCHAR AS l_shipdate FROM lineitem "
                         f"WHERE contains(l_returnflag, '{POSITIVE_CLASS}')")
    q["str_contains"] = ("SELECT o_orderkey, o_orderpriority, "
                         "contains(o_orderpriority, 'URGENT') AS is_urgent FROM orders")
    q["logical_not"] = ("SELECT o_orderkey, o_orderpriority FROM orders "
                        "WHERE NOT contains(o_orderpriority, 'URGENT')")
    q["point_lookup"] = ("SELECT o_orderkey, o_custkey, o_orderstatus, "
                         f"{_r('o_totalprice', 'o_totalprice')}, o_orderpriority FROM orders "
                         "WHERE o_orderkey IN (SELECT min(o_orderkey) FROM orders "
                         "GROUP BY o_orderpriority)")
    q["point_lookup_ntz"] = ("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderdate IN "
                             "(SELECT min(o_orderdate) FROM orders GROUP BY o_orderpriority)")
    q["point_lookup_many"] = ("SELECT l_orderkey, l_linenumber, l_returnflag FROM lineitem WHERE l_orderkey IN "
                              "(SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')")
    q["select_columns"] = (f"SELECT l_orderkey, {_r('l_quantity', 'l_quantity')}, l_returnflag "
                           "FROM lineitem")
    q["drop_column"] = (f"SELECT {_li_select([c for c in LI_COLS if c != 'l_linestatus'])} "
                        "FROM lineitem")

    st = _stats_cte()
    q["class_profile"] = (f"WITH {st} SELECT l_returnflag, attribute, n, "
                          f"{_r('avg_value', 'avg_value')}, {_r('min_value', 'min_value')}, "
                          f"{_r('max_value', 'max_value')}, "
                          f"{_r(_scaled('avg_value', 'min_value', 'max_value'), 'scaled_avg')} "
                          "FROM st")
    q["describe_table"] = " UNION ALL ".join(
        f"SELECT '{c}' AS attribute, count({c})::BIGINT AS n, "
        f"{_r(f'avg({c}::DOUBLE)', 'mean')}, {_r(f'stddev_samp({c}::DOUBLE)', 'stddev')}, "
        f"{_r(f'min({c})::DOUBLE', 'min_value')}, {_r(f'max({c})::DOUBLE', 'max_value')}, "
        "NULL::VARCHAR AS min_text, NULL::VARCHAR AS max_text "
        "FROM lineitem" for c in LI_NUMERIC) + "".join(
        f" UNION ALL SELECT '{c}', count({c})::BIGINT, NULL, NULL, NULL, NULL, "
        f"min({c})::VARCHAR, max({c})::VARCHAR FROM lineitem"
        for c in ("l_returnflag", "l_linestatus", "l_shipdate"))
    for key, col in (("class_avg", "avg_value"), ("class_min", "min_value"),
                     ("class_max", "max_value")):
        q[key] = f"WITH {st} SELECT l_returnflag, attribute, {_r(col, col)} FROM st"
    q["row_count"] = "SELECT l_returnflag, count(*)::BIGINT AS n FROM lineitem GROUP BY l_returnflag"

    rng = ", ".join(f"min({c}) AS lo{i}, max({c}) AS hi{i}" for i, c in enumerate(LI_FEATURES))
    sc = ", ".join(_r(_scaled(f"li.{c}", f"lo{i}", f"hi{i}"), f"{c}_scaled")
                   for i, c in enumerate(LI_FEATURES))
    q["min_max_scale"] = (f"WITH r AS (SELECT l_returnflag, {rng} FROM lineitem "
                          f"GROUP BY l_returnflag) SELECT "
                          f"{', '.join('li.' + k for k in LI_KEYS)}, li.l_returnflag, {sc} "
                          "FROM lineitem li LEFT JOIN r "
                          "ON li.l_returnflag IS NOT DISTINCT FROM r.l_returnflag")
    q["baseline_profile"] = (
        f"WITH {st}, b AS (SELECT attribute, min_value AS bmin, max_value AS bmax FROM st "
        f"WHERE l_returnflag = '{BASELINE_CLASS}') "
        f"SELECT st.l_returnflag, st.attribute, {_r('avg_value', 'avg_value')}, "
        f"{_r('bmin', 'min_value')}, {_r('bmax', 'max_value')}, "
        f"{_r(_scaled('avg_value', 'bmin', 'bmax'), 'scaled_avg')} "
        "FROM st LEFT JOIN b ON st.attribute = b.attribute")
    q["record_profile"] = (
        f"WITH {st}, {_records_cte()} SELECT {KEYS}, l_returnflag, attribute, "
        f"{_r('value', 'value')}, {_r('min_value', 'min_value')}, "
        f"{_r('max_value', 'max_value')}, {_r('scaled', 'scaled')} FROM prof")
    classes = ("A", "N", "R")
    piv = ", ".join(f"avg(CASE WHEN l_returnflag = '{c}' THEN scaled END) AS record_{c}"
                    for c in classes)
    order = " UNION ALL ".join(f"SELECT '{f}' AS family, {i + 1} AS pos, '{a}' AS attribute"
                               for f, attrs in LI_FAMILIES.items() for i, a in enumerate(attrs))
    q["radar_table"] = (
        f"WITH {st}, {_records_cte()}, "
        f"base AS (SELECT attribute, {_scaled('avg_value', 'min_value', 'max_value')} "
        f"AS baseline FROM st WHERE l_returnflag = '{BASELINE_CLASS}'), "
        f"rp AS (SELECT attribute, {piv} FROM prof GROUP BY attribute), ord AS ({order}) "
        f"SELECT ord.family, ord.pos, ord.attribute, {_r('baseline', 'baseline')}, "
        + ", ".join(_r(f"record_{c}", f"record_{c}") for c in classes)
        + " FROM ord LEFT JOIN base ON ord.attribute = base.attribute "
        "LEFT JOIN rp ON ord.attribute = rp.attribute")

    q["row_index"] = (f"SELECT o_orderkey, {_r('o_totalprice', 'o_totalprice')}, "
                      "(row_number() OVER (ORDER BY o_orderkey NULLS FIRST) - 1)::BIGINT AS index "
                      "FROM orders")
    q["positional_join"] = (f"SELECT o_orderkey, o_custkey, {_r('o_totalprice', 'o_totalprice')}, "
                            "o_orderpriority FROM orders")
    q["ranked_join"] = q["positional_join"]
    q["split_train_test"] = f"SELECT o_orderkey, {_split2('o_orderkey')} AS split FROM orders"
    q["split_train_val"] = f"SELECT o_orderkey, {_split3('o_orderkey')} AS split FROM orders"

    s = _scored_cte()
    q["prediction_match"] = (f"WITH {s} SELECT {KEYS}, prediction, label, "
                             "CASE WHEN prediction = label THEN 1 ELSE 0 END AS equal FROM s")
    q["filter_chain"] = (f"WITH {s} SELECT {KEYS}, split, prediction, label FROM s "
                         "WHERE prediction = 1.0 AND NOT (label = prediction)")
    q["confusion_matrix"] = f"WITH {s} SELECT split, {_cm_cols()} FROM s GROUP BY split"
    q["precision_recall"] = (
        f"WITH {s}, cm AS (SELECT split, {_cm_cols()} FROM s GROUP BY split) "
        f"SELECT split, {_r('tp::DOUBLE / nullif(tp + fp, 0)', 'precision')}, "
        f"{_r('tp::DOUBLE / nullif(tp + fn, 0)', 'recall')}, "
        f"{_r('correct::DOUBLE / nullif(n, 0)', 'accuracy')} FROM cm")
    q["auroc_hard"] = (f"WITH {s}, cm AS (SELECT split, {_cm_cols()} FROM s GROUP BY split) "
                       f"SELECT split, {_r(_hard_auc(), 'auroc')} FROM cm")
    q["auroc_exact"] = (
        f"WITH {s}, g AS (SELECT split, score, count_if(label = 1)::BIGINT AS p, "
        "count_if(label <> 1)::BIGINT AS n FROM s WHERE score IS NOT NULL AND label IS NOT NULL "
        "GROUP BY split, score), "
        "c AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY split ORDER BY score "
        "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS nb FROM g) "
        "SELECT split, "
        + _r("sum(p::DOUBLE * (nb::DOUBLE + n::DOUBLE / 2.0::DOUBLE)) / "
             "nullif(sum(p)::DOUBLE * sum(n)::DOUBLE, 0)", "auroc")
        + " FROM c GROUP BY split")
    rules = " UNION ALL ".join(
        f"SELECT split, label, '{n}' AS model, ({c} > {t}::DOUBLE)::DOUBLE AS prediction FROM s"
        for n, (c, t) in RULES.items())
    q["model_leaderboard"] = (
        f"WITH {s}, m AS ({rules}), cm AS (SELECT model, {_cm_cols()} FROM m "
        "WHERE split = 'test' GROUP BY model), "
        f"b AS (SELECT model, {_hard_auc()} AS auroc, correct::DOUBLE / nullif(n, 0) AS accuracy "
        "FROM cm) SELECT model, " + _r("auroc", "auroc") + ", " + _r("accuracy", "accuracy")
        + ", (row_number() OVER (ORDER BY auroc DESC NULLS LAST, model))::INTEGER AS rank FROM b")

    q["assemble_features"] = (f"WITH {_customer_nulls_cte()} SELECT c_custkey, c_name, "
                              f"{_r('c_nationkey::DOUBLE', 'x_0')}, {_r('c_acctbal', 'x_1')} FROM c "
                              "WHERE c_nationkey IS NOT NULL AND c_acctbal IS NOT NULL")
    q["vector_to_array"] = (f"SELECT {KEYS}, {len(LI_FEATURES)} AS n_dims, "
                            + _r(" + ".join(LI_FEATURES), "x_sum") + ", concat_ws(',', "
                            + ", ".join(f"round({c} * 100)::BIGINT" for c in LI_FEATURES)
                            + ") AS x_hundredths FROM lineitem")
    q["array_to_columns"] = (f"SELECT {KEYS}, "
                             + ", ".join(_r(c, f"x_{i}") for i, c in enumerate(LI_FEATURES))
                             + " FROM lineitem")
    q["standard_scale"] = (f"SELECT {KEYS}, "
                           + ", ".join(_r(_std_scaled(c, f"stddev_samp({c}) OVER ()"),
                                          f"{c}_scaled") for c in LI_FEATURES)
                           + " FROM lineitem")
    q["feature_pipeline"] = (
        f"WITH s AS (SELECT *, {_split3(KEYS)} AS split FROM lineitem) SELECT {KEYS}, split, "
        + ", ".join(_r(_std_scaled(c, f"stddev_samp(CASE WHEN split = 'train' THEN {c} END) "
                                      "OVER ()"), f"{c}_scaled") for c in LI_FEATURES)
        + " FROM s")
    pca = _pca_cte()
    q["pca_project"] = (f"WITH {pca} SELECT {KEYS}, split, {_r('pc1', 'PCA_1')}, "
                        f"{_r('pc2', 'PCA_2')} FROM p")
    q["pca_table"] = (f"WITH {pca} SELECT label, {_r('pc1', 'PCA_1')}, {_r('pc2', 'PCA_2')} "
                      "FROM p WHERE split = 'train'")
    q["pca_explained"] = (
        f"WITH {pca}, rr AS (SELECT DISTINCT r FROM w) "
        f"SELECT 1 AS component, {_r('(1 + abs(r)) / 2', 'explained_variance')}, "
        f"{_r('(1 + abs(r)) / 2', 'cumulative')} FROM rr UNION ALL "
        f"SELECT 2 AS component, {_r('(1 - abs(r)) / 2', 'explained_variance')}, "
        f"{_r('1.0::DOUBLE', 'cumulative')} FROM rr")
    feats = {
        "n_chars": "length(t)::DOUBLE",
        "n_words": "len(ws)::DOUBLE",
        "n_distinct": "len(list_distinct(lw))::DOUBLE",
        "type_token_ratio": "coalesce(len(list_distinct(lw))::DOUBLE / nullif(len(ws), 0), 0)",
        "digit_share": _share("[0-9]"), "upper_share": _share(r"\p{Lu}"), "punct_share": _share(r"\p{P}"),
        "mean_word_len": (f"coalesce(length(regexp_replace(t, '{_WS}+', '', 'g'))::DOUBLE "
                          "/ nullif(len(ws), 0), 0)"),
    }
    docs = ("d AS (SELECT doc_id, coalesce(text, '') AS t, trim(coalesce(text, ''), ' ') AS u FROM documents "
            "WHERE doc_id IN (SELECT doc_id FROM labels)), "
            f"w AS (SELECT doc_id, t, CASE WHEN u = '' THEN [] ELSE string_split_regex(u, '{_WS}+') END AS ws, "
            f"CASE WHEN u = '' THEN [] ELSE string_split_regex(lower(u), '{_WS}+') END AS lw FROM d), "
            "f AS (SELECT w.doc_id, quality AS label, " + _split3("w.doc_id") + " AS split, "
            + ", ".join(f"{e} AS {n}" for n, e in feats.items())
            + " FROM w JOIN labels ON labels.doc_id = w.doc_id)")
    sd = "sd AS (SELECT " + ", ".join(f"stddev_samp({n}) AS {n}" for n in feats) + " FROM f WHERE split = 'train')"
    q["model_features"] = (f"WITH {docs}, {sd} SELECT doc_id, split, label, "
                           + ", ".join(_r(f"f.{n}", n) for n in feats) + ", "
                           + ", ".join(_r(_std_scaled(f"f.{n}", f"sd.{n}"), f"{n}_scaled") for n in feats)
                           + " FROM f CROSS JOIN sd")
    names = ", ".join(f"('{m}')" for m in MODEL_NAMES)
    scored = (f"m(model) AS (VALUES {names}), l AS (SELECT labels.doc_id, quality AS label, "
              f"{_split3('labels.doc_id')} AS split FROM labels JOIN documents USING (doc_id))")
    q["score_rows"] = f"WITH {scored} SELECT model, split, doc_id, label FROM l CROSS JOIN m"
    zero = ", ".join(f"0::BIGINT AS {c}" for c in ("bad_score", "bad_prediction", "bad_equal"))
    q["score_consistency"] = (f"WITH {scored} SELECT model, split, count(*)::BIGINT AS n, "
                              f"sum(label)::BIGINT AS n_positive, {zero} FROM l CROSS JOIN m GROUP BY model, split")
    terms = ", ".join(f"('{t}', 0.0::DOUBLE)" for t in ("intercept", *LI_FEATURES))
    q["logistic_optimum"] = f"SELECT * FROM (VALUES {terms}) AS v(term, mean_gradient)"
    return q


ORACLE = build()


# ------------------------------------------------------------------ tree audits

def _tree_ctes(levels: int, gain: str, allowed: str, best_first: bool) -> str:
    """A tree grown in SQL over the distinct values of TREE_FEATURES: level by level, or one
    split at a time, the best of all leaves. ``s<d>`` holds the splits of step d. In ``gain``
    and ``allowed``, nl/pl, nr/pr and nt/pt are rows and positives left, right and in all."""
    k = len(TREE_FEATURES)
    xs = ", ".join(f"x{i}" for i in range(k))
    out = [f"""r0 AS MATERIALIZED (SELECT {", ".join(f"CAST({c} AS DOUBLE) AS x{i}" for i, c in enumerate(TREE_FEATURES))},
  CAST(l_quantity * (l_discount + l_tax) > {CUT_RULE}::DOUBLE AS INTEGER) AS y, CAST(1 AS BIGINT) AS path FROM lineitem)""",
           f"""vals AS MATERIALIZED (SELECT f, v, (v + lead(v) OVER (PARTITION BY f ORDER BY v)) / 2 AS cut FROM (
  SELECT DISTINCT unnest(range({k})) AS f, unnest([{xs}]) AS v FROM r0))"""]
    order = "ORDER BY gain DESC, f, v"
    for d in range(levels):
        pick = (f"SELECT * FROM c{d} WHERE gain > 0 ORDER BY gain DESC, path, f, v LIMIT 1" if best_first else
                f"SELECT * FROM c{d} WHERE gain > 0 QUALIFY row_number() OVER (PARTITION BY path {order}) = 1")
        stay = "r.path" if best_first else "NULL"
        out += [f"""u{d} AS MATERIALIZED (SELECT path, f, v, count(*) AS n, sum(y) AS p FROM (
  SELECT path, y, unnest(range({k})) AS f, unnest([{xs}]) AS v FROM r{d} WHERE path IS NOT NULL) GROUP BY path, f, v)""",
                f"""w{d} AS MATERIALIZED (SELECT u.path, u.f, u.v, cut, CAST(sum(n) OVER a AS DOUBLE) AS nl, CAST(sum(p) OVER a AS DOUBLE) AS pl,
  CAST(sum(n) OVER b AS DOUBLE) AS nt, CAST(sum(p) OVER b AS DOUBLE) AS pt
  FROM u{d} u JOIN vals ON vals.f = u.f AND vals.v = u.v
  WINDOW a AS (PARTITION BY u.path, u.f ORDER BY u.v), b AS (PARTITION BY u.path, u.f))""",
                f"""c{d} AS MATERIALIZED (SELECT *, {gain} AS gain FROM (SELECT *, nt - nl AS nr, pt - pl AS pr FROM w{d})
  WHERE cut IS NOT NULL AND nl > 0 AND nr > 0 AND {allowed})""",
                f"s{d} AS MATERIALIZED ({pick})",
                f"""r{d + 1} AS MATERIALIZED (SELECT {", ".join(f"r.x{i}" for i in range(k))}, r.y, CASE WHEN s.path IS NULL THEN {stay}
  ELSE 2 * r.path + CAST(list_extract([{", ".join(f"r.x{i}" for i in range(k))}], s.f + 1) >= s.cut AS BIGINT) END AS path
  FROM r{d} r LEFT JOIN s{d} s ON s.path = r.path)"""]
    return "WITH " + ",\n".join(out)


def _newton(l2: float) -> str:
    """Gain at p = 1/2: the gradient of n rows with p positives is n/2 - p, the hessian n/4."""
    def part(n: str, p: str) -> str:
        return f"(0.5::DOUBLE * {n} - {p}) * (0.5::DOUBLE * {n} - {p}) / (0.25::DOUBLE * {n} + {l2}::DOUBLE)"
    return f"{part('nl', 'pl')} + {part('nr', 'pr')} - {part('nt', 'pt')}"


def _gini(n: str, p: str) -> str:
    return f"(1 - ({p} / {n}) * ({p} / {n}) - (({n} - {p}) / {n}) * (({n} - {p}) / {n}))"


def _split_rows(tables: list[str], where: str = "") -> str:
    names = ", ".join(f"'{c}'" for c in TREE_FEATURES)
    rows = "\nUNION ALL ".join(f"SELECT path, f, cut, nt, gain FROM {t}" for t in tables)
    return f"""SELECT path, list_extract([{names}], f + 1) AS feature, round(cut, {D}) AS cut, CAST(nt AS BIGINT) AS n,
  round(gain, {D}) AS gain FROM ({rows}) {where}"""


_ONE = ONE_ROUND["depth"]
ORACLE["boost_leaves"] = f"""{_tree_ctes(_ONE, _newton(ONE_ROUND["l2"]), "nl / 4 >= 1 AND nr / 4 >= 1", False)},
leaf AS ({" UNION ALL ".join(f"SELECT r.path, r.y FROM r{d} r LEFT JOIN s{d} s ON s.path = r.path WHERE r.path IS NOT NULL AND s.path IS NULL"
                             for d in range(_ONE))} UNION ALL SELECT path, y FROM r{_ONE} WHERE path IS NOT NULL),
g AS (SELECT path, count(*) AS n, sum(0.5::DOUBLE - y) AS g, 0.25::DOUBLE * count(*) AS h FROM leaf GROUP BY path)
SELECT path, n, round(g, {D}) AS g, round(h, {D}) AS h,
  round(-{ONE_ROUND["step"]}::DOUBLE * g / (h + {ONE_ROUND["l2"]}::DOUBLE), {D}) AS weight FROM g"""

_ROWS = MANY_ROUNDS["min_rows"]
ORACLE["boost_splits"] = (_tree_ctes(7, _newton(0.0), f"nl >= {_ROWS} AND nr >= {_ROWS}", True) + "\n"
                          + _split_rows([f"s{d}" for d in range(7)]))


def _forest_sql() -> str:
    """The Gini tree with the fit's pruning: a node whose children are both leaves of one
    prediction is a leaf."""
    gain = f"{_gini('nt', 'pt')} - nl / nt * {_gini('nl', 'pl')} - nr / nt * {_gini('nr', 'pr')}"
    out = [_tree_ctes(TREE_DEPTH, gain, "TRUE", False)]
    for d in range(TREE_DEPTH, -1, -1):        # k<d>: prediction of each node of a level, and whether it stays split
        node = f"SELECT path, sum(y) * 2 > count(*) AS pred FROM r{d} WHERE path IS NOT NULL GROUP BY path"
        if d == TREE_DEPTH:
            out.append(f"k{d} AS MATERIALIZED (SELECT path, pred, FALSE AS split FROM ({node}))")
        else:
            out.append(f"""k{d} AS MATERIALIZED (SELECT n.path, n.pred, s.path IS NOT NULL AND (a.split OR b.split OR a.pred <> b.pred) AS split
  FROM ({node}) n LEFT JOIN s{d} s ON s.path = n.path
  LEFT JOIN k{d + 1} a ON a.path = 2 * n.path LEFT JOIN k{d + 1} b ON b.path = 2 * n.path + 1)""")
    kept = " UNION ALL ".join(f"SELECT path FROM k{d} WHERE split" for d in range(TREE_DEPTH))
    return ",\n".join(out) + "\n" + _split_rows([f"s{d}" for d in range(TREE_DEPTH)], f"WHERE path IN ({kept})")


ORACLE["forest_splits"] = _forest_sql()

ORACLE["svc_optimum"] = f"""
WITH t AS (SELECT count(*) AS n FROM documents JOIN labels USING (doc_id) WHERE {_split3("doc_id")} = 'train')
SELECT unnest([{", ".join(f"'{c}'" for c in (*TEXT_FEATURES, "intercept"))}]) AS term, n, TRUE AS holds_zero FROM t"""

ORACLE["split_exact"] = f"""
SELECT o_orderkey, o_orderpriority, CASE WHEN row_number() OVER (PARTITION BY o_orderpriority
  ORDER BY md5(concat_ws(':', '{SALT}', o_orderkey))) <= floor(0.8 * count(*) OVER (PARTITION BY o_orderpriority))
  THEN 'train' ELSE 'test' END AS split FROM orders"""
ORACLE["pca_wide"] = ORACLE["pca_explained"]
