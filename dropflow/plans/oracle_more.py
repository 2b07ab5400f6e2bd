"""DuckDB oracle SQL for the queries in ``plans.more_queries``."""

from __future__ import annotations

from ..sources.testdata import course_view_sql
from .oracle import (COUNT_COLS, COURSES, DENOM, FEATURE_SQL, FILTERED, R1_EXPR, R2_EXPR, RATED,
                     ROOT, feature_select, r6, sd, with_ctes)

NUMERIC_FEATURES = [f for f in FEATURE_SQL if f != "FEAT_DOMINANCIA_MODALIDADE"]


def _box(long_cte: str) -> str:
    return with_ctes(*long_cte) + f"""
, q AS (SELECT variable, category, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS median,
        quantile_cont(v, 0.75) AS q3 FROM long GROUP BY variable, category),
f AS (SELECT *, q3 - q1 AS iqr, q1 - 1.5 * (q3 - q1) AS lower_fence, q3 + 1.5 * (q3 - q1) AS upper_fence FROM q)
SELECT f.variable, f.category, count(*) AS n, {r6('f.q1')} AS q1, {r6('f.median')} AS median, {r6('f.q3')} AS q3,
  {r6('f.iqr')} AS iqr, {r6('f.lower_fence')} AS lower_fence, {r6('f.upper_fence')} AS upper_fence,
  {r6('min(v) FILTER (WHERE v >= f.lower_fence AND v <= f.upper_fence)')} AS whisker_low,
  {r6('max(v) FILTER (WHERE v >= f.lower_fence AND v <= f.upper_fence)')} AS whisker_high,
  count(*) FILTER (WHERE NOT (v >= f.lower_fence AND v <= f.upper_fence)) AS n_outliers
FROM long JOIN f ON long.variable = f.variable AND long.category = f.category
GROUP BY f.variable, f.category, f.q1, f.median, f.q3, f.iqr, f.lower_fence, f.upper_fence"""


YEAR_COURSES = f"ycourses AS ({course_view_sql('CAST(year(l_shipdate) AS VARCHAR)', 'ANO_BASE')})"
YEAR_FEAT = (f"yfilt AS (SELECT * FROM ycourses WHERE TP_GRAU_ACADEMICO = 2 AND lower(NO_CURSO) LIKE '%widget%' AND QT_ING > 10), "
             f"yfeat AS (SELECT *, {R2_EXPR} AS TX_EVASAO, {feature_select(False)} FROM yfilt)")


def _auc_sql(src: str, label_pos: str, score: str, group: list[str]) -> str:
    g = ", ".join(group)
    gsel = (g + ", ") if group else ""
    part = f"PARTITION BY {g} " if group else ""
    return f"""SELECT {gsel}CASE WHEN sum(pos) > 0 AND sum(neg) > 0
    THEN CAST(sum(pos * (below + 0.5::DOUBLE * neg)) AS DOUBLE) / (CAST(sum(pos) AS DOUBLE) * sum(neg)) END AS roc_auc,
  CAST(sum(pos) AS BIGINT) AS n_pos, CAST(sum(neg) AS BIGINT) AS n_neg
FROM (SELECT {gsel}s, pos, neg, coalesce(sum(neg) OVER ({part}ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below
      FROM (SELECT {gsel}CAST({score} AS DOUBLE) AS s, sum(CASE WHEN {label_pos} THEN 1 ELSE 0 END) AS pos,
                   sum(CASE WHEN {label_pos} THEN 0 ELSE 1 END) AS neg
            FROM {src} WHERE {score} IS NOT NULL GROUP BY {gsel}s) h) c
{('GROUP BY ' + g) if group else ''}"""


SCORE_BY_CLASS = {"muito baixo risco": "FEAT_PCT_ING_FEM", "baixo risco": "FEAT_PCT_ING_JOVEM",
                  "alto risco": "FEAT_PCT_ING_BRANCA", "muito alto risco": "FEAT_PCT_VG_NOTURNO"}
QUART_LAB = f"""feat AS (SELECT *, {feature_select(False)} FROM rated),
quart AS (SELECT quantile_cont(TX_EVASAO, 0.25) FILTER (WHERE TX_EVASAO > 0 AND QT_ING >= 10) AS q1,
  quantile_cont(TX_EVASAO, 0.5) FILTER (WHERE TX_EVASAO > 0 AND QT_ING >= 10) AS q2,
  quantile_cont(TX_EVASAO, 0.75) FILTER (WHERE TX_EVASAO > 0 AND QT_ING >= 10) AS q3 FROM rated),
lab AS (SELECT feat.*, CASE WHEN TX_EVASAO <= q1 THEN 'muito baixo risco' WHEN TX_EVASAO <= q2 THEN 'baixo risco'
  WHEN TX_EVASAO <= q3 THEN 'alto risco' ELSE 'muito alto risco' END AS NIVEL_RISCO FROM feat, quart)"""


def _argmax_sql() -> str:
    names = list(SCORE_BY_CLASS)
    whens = []
    for i, cls in enumerate(names):
        v = SCORE_BY_CLASS[cls]
        conds = []
        for j, other in enumerate(names):
            if j != i:
                o = SCORE_BY_CLASS[other]
                conds.append(f"{v} > {o}" if j < i else f"{v} >= {o}")
        whens.append(f"WHEN {' AND '.join(conds)} THEN '{cls}'")
    return f"(CASE {' '.join(whens)} ELSE '{names[0]}' END)"


REG = f"""reg AS (SELECT TX_EVASAO AS y, {sd('QT_SIT_DESVINCULADO', 'QT_ING')} AS p FROM rated)"""


def _reg_metrics(src: str, y: str, p: str, group: str | None = None) -> str:
    gsel = f"{group}, " if group else ""
    e = f"({y} - {p})"
    sst = f"(var_pop({y}) * count({y}))"
    return f"""SELECT {gsel}CASE WHEN {sst} > 0 THEN 1.0 - sum({e} * {e}) / {sst}
  WHEN sum({e} * {e}) = 0 THEN 1.0 ELSE 0.0 END AS R2,
  avg(abs({e})) AS MAE, sqrt(avg({e} * {e})) AS RMSE FROM {src}{(' GROUP BY ' + group) if group else ''}"""


def more_oracles() -> dict[str, str]:
    q = {}
    rated_all = f"r AS (SELECT *, {R2_EXPR} AS v FROM courses)"
    long_c = "long AS (" + " UNION ALL ".join(
        f"SELECT '{c}' AS variable, CAST({c} AS VARCHAR) AS category, v FROM r WHERE v IS NOT NULL"
        for c in ["TP_GRAU_ACADEMICO", "TP_REDE", "CO_REGIAO"]) + ")"
    q["q_box_stats"] = _box([COURSES, rated_all, long_c])
    long_e = ("long AS (SELECT 'event_type' AS variable, CAST(event_type AS VARCHAR) AS category, "
              "CAST(value AS DOUBLE) AS v FROM events WHERE value IS NOT NULL AND NOT isnan(value))")
    q["q_box_stats_events"] = _box([long_e])
    q["q_union_years"] = f"""SELECT o_orderkey, {r6('o_totalprice')} AS o_totalprice,
  CASE WHEN year(o_orderdate) % 2 = 0 THEN o_orderstatus END AS o_orderstatus,
  CASE WHEN year(o_orderdate) % 2 = 1 THEN o_orderpriority END AS o_orderpriority,
  CAST(year(o_orderdate) AS VARCHAR) AS ANO_BASE FROM orders"""
    q["q_mega_dataset"] = with_ctes(YEAR_COURSES, YEAR_FEAT) + (
        f"SELECT ANO_BASE, CO_CURSO, QT_ING, {r6('TX_EVASAO')} AS TX_EVASAO, {feature_select()} "
        f"FROM (SELECT *, {R2_EXPR} AS TX_EVASAO FROM yfilt) t")
    keep = ", ".join(["CO_CURSO", "TP_GRAU_ACADEMICO", "CO_REGIAO", "TP_REDE"] + COUNT_COLS)
    q["q_root_filter"] = with_ctes(COURSES, ROOT) + (
        f"SELECT {keep}, {r6('QT_INSCRITO_TOTAL')} AS QT_INSCRITO_TOTAL, {r6(R1_EXPR)} AS TX_EVASAO "
        f"FROM root WHERE {DENOM} >= 10")
    q["q_analysis_table"] = with_ctes(COURSES, ROOT) + (
        f"SELECT CO_REGIAO, TP_REDE, TP_GRAU_ACADEMICO, QT_ING, {r6(R1_EXPR)} AS TX_EVASAO "
        f"FROM root WHERE {DENOM} >= 10")
    q["q_clean_categories"] = """SELECT doc_id, coalesce(CAST(lang AS VARCHAR), 'nan') AS lang_cat,
  coalesce(trim(replace(' "' || source || '" ', '"', '')), 'nan') AS source_cat,
  coalesce(CASE WHEN n_chars % 7 <> 0 THEN lang END, 'VALOR_AUSENTE') AS lang_or_missing FROM documents"""
    q["q_ordinal_encode"] = """SELECT doc_id,
  CAST(dense_rank() OVER (ORDER BY coalesce(lang, 'nan')) - 1 AS INTEGER) AS lang_code,
  CAST(dense_rank() OVER (ORDER BY coalesce(source, 'nan')) - 1 AS INTEGER) AS source_code FROM documents"""
    q["q_ordinal_unseen"] = """WITH vocab AS (
  SELECT s, CAST(row_number() OVER (ORDER BY s) - 1 AS INTEGER) AS code
  FROM (SELECT DISTINCT coalesce(source, 'nan') AS s FROM documents WHERE NOT source IN ('src1', 'src2', 'src3')) v)
SELECT d.doc_id, coalesce(vocab.code, -1) AS source_code
FROM documents d LEFT JOIN vocab ON coalesce(d.source, 'nan') = vocab.s"""
    q["q_onehot"] = """SELECT doc_id, CAST(dense_rank() OVER (ORDER BY coalesce(lang, 'nan')) AS INTEGER) AS hot_position,
  CAST((SELECT count(DISTINCT coalesce(lang, 'nan')) FROM documents) AS INTEGER) AS width FROM documents"""
    nn = ("nn AS (SELECT CO_CURSO, CO_REGIAO, TP_REDE, nullif(QT_ING_PRETA, 0) AS QT_ING_PRETA, "
          "nullif(QT_ING_60_MAIS, 0) AS QT_ING_60_MAIS, QT_INSCRITO_TOTAL, QT_ING FROM courses)")
    cols = ["QT_ING_PRETA", "QT_ING_60_MAIS", "QT_INSCRITO_TOTAL", "QT_ING"]
    q["q_impute_median"] = with_ctes(COURSES, nn) + " UNION ALL ".join(
        f"SELECT '{c}' AS variable, {r6(f'quantile_cont({c}, 0.5)')} AS median FROM nn" for c in cols)
    long_m = "long AS (" + " UNION ALL ".join([
        "SELECT 'CO_REGIAO' AS variable, CAST(CO_REGIAO AS VARCHAR) AS value FROM nn",
        "SELECT 'TP_REDE' AS variable, CAST(TP_REDE AS VARCHAR) AS value FROM nn",
        "SELECT 'QT_ING_PRETA' AS variable, lpad(CAST(CAST(QT_ING_PRETA AS INTEGER) AS VARCHAR), 3, '0') AS value FROM nn"]) + ")"
    q["q_impute_mode"] = with_ctes(COURSES, nn, long_m) + """, c AS (SELECT variable, value, count(*) AS n FROM long
  WHERE value IS NOT NULL GROUP BY variable, value), b AS (SELECT variable, max(n) AS n FROM c GROUP BY variable)
SELECT c.variable, c.n AS count, min(c.value) AS mode FROM c JOIN b ON c.variable = b.variable AND c.n = b.n
GROUP BY c.variable, c.n"""
    med = ", ".join(f"quantile_cont({c}, 0.5) AS m_{c}" for c in cols)
    fill = ", ".join(f"coalesce(CAST({c} AS DOUBLE), m_{c}) AS {c}" for c in cols)
    st = ", ".join(f"avg({c}) AS a_{c}, stddev_pop({c}) AS s_{c}" for c in cols)
    z = ", ".join(f"{r6(f'({c} - a_{c}) / CASE WHEN s_{c} = 0 OR s_{c} IS NULL THEN 1.0 ELSE s_{c} END')} AS z_{c}" for c in cols)
    q["q_scale"] = with_ctes(COURSES, nn, f"m AS (SELECT {med} FROM nn)",
                             f"f AS (SELECT CO_CURSO, {fill} FROM nn, m)",
                             f"s AS (SELECT {st} FROM f)") + f"SELECT CO_CURSO, {z} FROM f, s"
    q["q_scale_only"] = with_ctes(COURSES, f"f AS (SELECT CO_CURSO, {', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in cols)} FROM courses)",
                                  f"s AS (SELECT {st} FROM f)") + f"SELECT CO_CURSO, {z} FROM f, s"
    zero = ", ".join(f"coalesce(CAST({c} AS DOUBLE), 0.0) AS {c}" for c in cols)
    q["q_scale_zero"] = with_ctes(COURSES, nn, f"f AS (SELECT CO_CURSO, {zero} FROM nn)",
                                  f"s AS (SELECT {st} FROM f)") + f"SELECT CO_CURSO, {z} FROM f, s"
    q["q_split_sizes"] = with_ctes(COURSES) + """SELECT 'test' AS side, CAST(ceil(count(*) * 0.2::DOUBLE) AS BIGINT) AS n FROM courses
UNION ALL SELECT 'train' AS side, count(*) - CAST(ceil(count(*) * 0.2::DOUBLE) AS BIGINT) AS n FROM courses"""
    q["q_stratified_sizes"] = with_ctes(COURSES, FILTERED, RATED, QUART_LAB) + """, cnt AS (SELECT NIVEL_RISCO, count(*) AS n FROM lab GROUP BY NIVEL_RISCO)
SELECT NIVEL_RISCO, 'test' AS side, CAST(ceil(n * 0.2::DOUBLE) AS BIGINT) AS n FROM cnt
UNION ALL SELECT NIVEL_RISCO, 'train' AS side, n - CAST(ceil(n * 0.2::DOUBLE) AS BIGINT) AS n FROM cnt"""
    q["q_split_repeated_keys"] = """SELECT l_returnflag, count(*) AS n_rows, count(*) AS n_with_side,
  count(DISTINCT (l_orderkey, l_linenumber)) AS n_lines, CAST(ceil(count(*) * 0.2::DOUBLE) AS BIGINT) AS n_test
FROM lineitem GROUP BY l_returnflag"""
    q["q_union_complete"] = f"""SELECT o_orderkey, {r6('o_totalprice')} AS gap, CAST(year(o_orderdate) AS VARCHAR) AS ANO_BASE
FROM orders WHERE year(o_orderdate) IN (1995, 1996) AND o_orderkey % 3 <> 0 AND o_totalprice IS NOT NULL"""
    docs = ("j AS (SELECT d.doc_id, d.n_chars, d.lang, l.quality, CASE WHEN d.n_chars > 2000 THEN 1 ELSE 0 END AS prediction "
            "FROM documents d JOIN labels l ON d.doc_id = l.doc_id)")
    tp = "count(*) FILTER (WHERE quality = 1 AND prediction = 1)"
    fp = "count(*) FILTER (WHERE quality <> 1 AND prediction = 1)"
    fn = "count(*) FILTER (WHERE quality = 1 AND prediction <> 1)"
    q["q_cls_metrics"] = with_ctes(docs) + f"""SELECT {r6('avg(CASE WHEN quality = prediction THEN 1.0 ELSE 0.0 END)')} AS accuracy,
  {r6(f'coalesce(CAST({tp} AS DOUBLE) / NULLIF({tp} + {fp}, 0), 0.0)')} AS precision,
  {r6(f'coalesce(CAST({tp} AS DOUBLE) / NULLIF({tp} + {fn}, 0), 0.0)')} AS recall,
  {r6(f'coalesce(CAST(2 * {tp} AS DOUBLE) / NULLIF(2 * {tp} + {fp} + {fn}, 0), 0.0)')} AS f1,
  (SELECT {r6('roc_auc')} FROM ({_auc_sql('j', 'quality = 1', 'n_chars', [])}) a) AS roc_auc FROM j"""
    q["q_roc_auc"] = with_ctes(docs) + f"SELECT lang, {r6('roc_auc')} AS roc_auc, n_pos, n_neg FROM ({_auc_sql('j', 'quality = 1', 'n_chars', ['lang'])}) a"
    pred = f"pred AS (SELECT NIVEL_RISCO, {_argmax_sql()} AS prediction FROM lab)"
    q["q_weighted_metrics"] = with_ctes(COURSES, FILTERED, RATED, QUART_LAB, pred) + f""",
pairs AS (SELECT NIVEL_RISCO AS y, prediction AS p, count(*) AS c FROM pred GROUP BY 1, 2),
cls AS (SELECT y AS k FROM pairs UNION SELECT p FROM pairs),
per AS (SELECT k, coalesce((SELECT sum(c) FROM pairs WHERE y = k), 0) AS sup,
               coalesce((SELECT sum(c) FROM pairs WHERE p = k), 0) AS prd,
               coalesce((SELECT sum(c) FROM pairs WHERE y = k AND p = k), 0) AS tp FROM cls)
SELECT {r6('CAST(sum(tp) AS DOUBLE) / sum(sup)')} AS accuracy,
  {r6('sum(coalesce(CAST(tp AS DOUBLE) / NULLIF(prd, 0), 0.0) * sup) / sum(sup)')} AS precision_weighted,
  {r6('sum(coalesce(CAST(tp AS DOUBLE) / NULLIF(sup, 0), 0.0) * sup) / sum(sup)')} AS recall_weighted,
  {r6('sum(coalesce(CAST(2 * tp AS DOUBLE) / NULLIF(sup + prd, 0), 0.0) * sup) / sum(sup)')} AS f1_weighted FROM per"""
    per_cls = " UNION ALL ".join(
        f"SELECT '{cls}' AS cls, * FROM ({_auc_sql('lab', f'NIVEL_RISCO = {chr(39)}{cls}{chr(39)}', col, [])}) a{i}"
        for i, (cls, col) in enumerate(SCORE_BY_CLASS.items()))
    q["q_roc_auc_ovr"] = with_ctes(COURSES, FILTERED, RATED, QUART_LAB) + \
        f"SELECT {r6('sum(roc_auc * n_pos) / sum(n_pos)')} AS roc_auc_ovr_weighted FROM ({per_cls}) u"
    q["q_reg_metrics"] = with_ctes(COURSES, FILTERED, RATED, REG) + \
        f"SELECT {r6('R2')} AS R2, {r6('MAE')} AS MAE, {r6('RMSE')} AS RMSE FROM ({_reg_metrics('reg', 'y', 'p')}) m"
    back = "reg2 AS (SELECT y, CASE WHEN exp(ln(1 + p) - 0.05) - 1 > 0 THEN exp(ln(1 + p) - 0.05) - 1 ELSE 0.0 END AS p FROM reg)"
    q["q_reg_metrics_log"] = with_ctes(COURSES, FILTERED, RATED, REG, back) + \
        f"SELECT {r6('R2')} AS R2, {r6('MAE')} AS MAE, {r6('RMSE')} AS RMSE FROM ({_reg_metrics('reg2', 'y', 'p')}) m"
    long_f = "longf AS (" + " UNION ALL ".join(
        f"SELECT ANO_BASE, TX_EVASAO, '{f}' AS Feature, CAST({f} AS DOUBLE) AS value FROM yfeat" for f in NUMERIC_FEATURES) + ")"
    imp = f"""{long_f},
st AS (SELECT ANO_BASE, Feature, abs(covar_pop(value, TX_EVASAO)) AS cov, avg(value) AS mean FROM longf GROUP BY ANO_BASE, Feature),
tall AS (SELECT ANO_BASE, Feature, 'cov' AS Modelo, cov AS raw FROM st UNION ALL SELECT ANO_BASE, Feature, 'mean', mean FROM st),
imp AS (SELECT ANO_BASE AS Arquivo, Modelo, Feature,
  {r6('CASE WHEN sum(raw) OVER (PARTITION BY ANO_BASE, Modelo) > 0 THEN raw / sum(raw) OVER (PARTITION BY ANO_BASE, Modelo) ELSE 0.0 END')} AS Importance FROM tall)"""
    q["q_topk_importance"] = with_ctes(YEAR_COURSES, YEAR_FEAT) + "," + imp + """
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY Arquivo, Modelo ORDER BY Importance DESC NULLS LAST, Feature) AS INTEGER) AS rank FROM imp) t
WHERE rank <= 5"""
    proxy = "proxy AS (SELECT ANO_BASE, TX_EVASAO, FEAT_PCT_ING_JOVEM * 0.5 AS pj, 0.0 AS pz FROM yfeat)"
    mt = f"""mt AS ({_reg_metrics('proxy', 'TX_EVASAO', 'pj', 'ANO_BASE').replace('SELECT ANO_BASE, ', "SELECT ANO_BASE, 'jovem' AS modelo, ", 1)}
  UNION ALL {_reg_metrics('proxy', 'TX_EVASAO', 'pz', 'ANO_BASE').replace('SELECT ANO_BASE, ', "SELECT ANO_BASE, 'zero' AS modelo, ", 1)})"""
    q["q_collect_metrics"] = with_ctes(YEAR_COURSES, YEAR_FEAT, proxy, mt) + """SELECT fonte, arquivo, modelo, metrica, round_even(valor, 4) + 0.0 AS valor FROM (
  SELECT 'tabelas_analise/metricas_' || ANO_BASE || '.csv' AS fonte, ANO_BASE AS arquivo, modelo, 'R2' AS metrica, R2 AS valor FROM mt
  UNION ALL SELECT 'tabelas_analise/metricas_' || ANO_BASE || '.csv', ANO_BASE, modelo, 'MAE', MAE FROM mt
  UNION ALL SELECT 'tabelas_analise/metricas_' || ANO_BASE || '.csv', ANO_BASE, modelo, 'RMSE', RMSE FROM mt) u"""
    each = " UNION ALL ".join(f"SELECT ANO_BASE, modelo, '{m}' AS metrica, {m} AS valor FROM mt" for m in ("R2", "MAE", "RMSE"))
    q["q_metric_report"] = with_ctes(YEAR_COURSES, YEAR_FEAT, proxy, mt) + f"""SELECT
  'tabelas/metricas_cursos_' || ANO_BASE || '.csv' AS tabela, 'cursos_' || ANO_BASE AS arquivo, modelo, metrica,
  round_even(valor, 4) + 0.0 AS valor FROM ({each}) u"""
    q["q_eligibility"] = with_ctes(YEAR_COURSES, YEAR_FEAT) + """SELECT ANO_BASE, count(*) AS n,
  count(DISTINCT FEAT_DOMINANCIA_MODALIDADE) AS n_classes,
  CASE WHEN count(*) = 0 THEN 'empty' WHEN count(*) < 50 THEN 'fewer than 50 rows'
       WHEN count(DISTINCT FEAT_DOMINANCIA_MODALIDADE) < 2 THEN 'fewer than 2 classes' ELSE 'ok' END AS reason,
  (count(*) >= 50 AND count(DISTINCT FEAT_DOMINANCIA_MODALIDADE) >= 2) AS eligible
FROM yfeat GROUP BY ANO_BASE"""
    return q
