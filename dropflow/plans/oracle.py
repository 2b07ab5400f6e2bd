"""ANSI SQL (DuckDB dialect) equivalents of the registered queries.

These strings are the correctness oracle only: the driver runs them on the
same Parquet tables in DuckDB and compares them with the Spark results. The
course view is inlined as a CTE; floating outputs are rounded to 6 decimals
with ``round_even`` (same rounding as the Spark side).
"""

from __future__ import annotations

from ..functions.features import RESERVE_NUMERATORS
from ..sources.testdata import COURSE_VIEW_SQL

R6 = "round_even({x}, 6) + 0.0"


def r6(x: str) -> str:
    return f"(round_even(CAST({x} AS DOUBLE), 6) + 0.0)"


def sd(num: str, den: str) -> str:
    """safe_divide: num/den, den 0 -> 0, negative -> 0."""
    q = f"coalesce(CAST(({num}) AS DOUBLE) / NULLIF(CAST({den} AS DOUBLE), 0), 0.0)"
    return f"(CASE WHEN {q} > 0 THEN {q} ELSE 0.0 END)"


COURSES = f"courses AS ({COURSE_VIEW_SQL})"
FILTERED = ("filtered AS (SELECT * FROM courses WHERE TP_GRAU_ACADEMICO = 2 "
            "AND lower(NO_CURSO) LIKE '%widget%' AND QT_ING > 10)")
ROOT = "root AS (SELECT * FROM courses WHERE TP_GRAU_ACADEMICO = 2 AND lower(NO_CURSO) LIKE '%widget%')"
NUMER = "(QT_SIT_DESVINCULADO + QT_SIT_TRANSFERIDO)"
DENOM = "(QT_ING - QT_SIT_FALECIDO)"
R2_EXPR = sd(NUMER, DENOM)
R1_EXPR = f"(CASE WHEN {DENOM} > 0 THEN round_even(CAST({NUMER} AS DOUBLE) * 100.0 / {DENOM}, 2) ELSE 0.0 END)"
R4_EXPR = f"(CASE WHEN {DENOM} > 0 AND {DENOM} >= 1 THEN CAST({NUMER} AS DOUBLE) / {DENOM} * 100.0 END)"
R5_EXPR = f"(CASE WHEN QT_MAT <> 0 AND QT_MAT >= 1 THEN CAST({NUMER} AS DOUBLE) / QT_MAT END)"
RATED = f"rated AS (SELECT *, {R2_EXPR} AS TX_EVASAO FROM filtered)"


def with_ctes(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


BASE = with_ctes(COURSES, FILTERED)
BASE_RATED = with_ctes(COURSES, FILTERED, RATED)

AGE = [("QT_ING_0_17", 17), ("QT_ING_18_24", 21), ("QT_ING_25_29", 27), ("QT_ING_30_34", 32),
       ("QT_ING_35_39", 37), ("QT_ING_40_49", 45), ("QT_ING_50_59", 55), ("QT_ING_60_MAIS", 65)]
RACES = ["QT_ING_BRANCA", "QT_ING_PRETA", "QT_ING_PARDA", "QT_ING_AMARELA", "QT_ING_INDIGENA"]

FEATURE_SQL = {
    "FEAT_RATIO_CANDIDATO_VAGA": sd("QT_INSCRITO_TOTAL", "QT_VG_TOTAL"),
    "FEAT_TAXA_OCUPACAO_VAGAS": sd("QT_ING", "QT_VG_TOTAL"),
    "FEAT_PCT_ING_FEM": sd("QT_ING_FEM", "QT_ING"),
    "FEAT_IDADE_MEDIA_ING": sd(" + ".join(f"{w}.0 * {c}" for c, w in AGE), " + ".join(c for c, _ in AGE)),
    "FEAT_PCT_ING_JOVEM": sd("QT_ING_0_17 + QT_ING_18_24", "QT_ING"),
    "FEAT_PCT_ING_IDOSO": sd("QT_ING_50_59 + QT_ING_60_MAIS", "QT_ING"),
    "FEAT_PCT_ING_PRETA_PARDA": sd("QT_ING_PRETA + QT_ING_PARDA", "QT_ING"),
    "FEAT_PCT_ING_BRANCA": sd("QT_ING_BRANCA", "QT_ING"),
    "FEAT_INDICE_DIVERSIDADE": "(1.0 - (" + " + ".join(f"pow({sd(c, 'QT_ING')}, 2.0)" for c in RACES) + "))",
    "FEAT_PCT_ING_DEFICIENTE": "0.0",
    "FEAT_PCT_ING_RESERVA_SOCIAL": "0.0",
    "FEAT_PCT_ING_FINANC": "0.0",
    "FEAT_PCT_ING_COM_FIES": "0.0",
    "FEAT_PCT_ING_PROUNI": sd("0.0", "QT_ING"),
    "FEAT_PCT_VG_EAD": sd("QT_VG_TOTAL_EAD", "QT_VG_TOTAL"),
    "FEAT_PCT_VG_NOTURNO": sd("QT_VG_TOTAL_NOTURNO", "QT_VG_TOTAL"),
    "FEAT_DOMINANCIA_MODALIDADE": (
        "(CASE WHEN QT_VG_TOTAL_DIURNO >= QT_VG_TOTAL_NOTURNO AND QT_VG_TOTAL_DIURNO >= QT_VG_TOTAL_EAD THEN 'DIURNO' "
        "WHEN QT_VG_TOTAL_NOTURNO > QT_VG_TOTAL_DIURNO AND QT_VG_TOTAL_NOTURNO >= QT_VG_TOTAL_EAD THEN 'NOTURNO' "
        "WHEN QT_VG_TOTAL_EAD > QT_VG_TOTAL_DIURNO AND QT_VG_TOTAL_EAD > QT_VG_TOTAL_NOTURNO THEN 'EAD' "
        "ELSE 'DIURNO' END)"),
    "FEAT_REGIAO_NORTE_NORDESTE": "(CASE WHEN CO_REGIAO IN (1, 2) THEN 1 ELSE 0 END)",
    "FEAT_PUBLICA": "(CASE WHEN TP_REDE = 1 THEN 1 ELSE 0 END)",
}
STRING_OR_INT_FEATURES = {"FEAT_DOMINANCIA_MODALIDADE", "FEAT_REGIAO_NORTE_NORDESTE", "FEAT_PUBLICA"}


def feature_select(rounded: bool = True) -> str:
    parts = []
    for name, expr in FEATURE_SQL.items():
        if rounded and name not in STRING_OR_INT_FEATURES:
            expr = r6(expr)
        parts.append(f"{expr} AS {name}")
    return ", ".join(parts)


FEATURES_CTE = f"feat AS (SELECT *, {feature_select(False)} FROM rated)"
COUNT_COLS = ["QT_ING", "QT_MAT", "QT_ING_FEM", "QT_ING_0_17", "QT_ING_18_24", "QT_ING_25_29",
              "QT_ING_30_34", "QT_ING_35_39", "QT_ING_40_49", "QT_ING_50_59", "QT_ING_60_MAIS",
              "QT_ING_BRANCA", "QT_ING_PRETA", "QT_ING_PARDA", "QT_ING_AMARELA", "QT_ING_INDIGENA",
              "QT_VG_TOTAL_DIURNO", "QT_VG_TOTAL_NOTURNO", "QT_VG_TOTAL_EAD", "QT_VG_TOTAL"]


def _num_sql(s: str) -> str:
    pat = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
    return f"(CASE WHEN regexp_matches({s}, '{pat}') THEN TRY_CAST(trim({s}) AS DOUBLE) END)"


def _to_numeric_sql() -> str:
    size = "CAST(p_size AS VARCHAR)"
    texts = {"plain": size, "padded": f"(' ' || {size} || ' ')", "suffixed": f"({size} || 'd')",
             "scientific": f"({size} || 'e1')", "decimal_comma": f"({size} || ',5')", "word": "p_name"}
    cols = ", ".join(f"{r6(_num_sql(t))} AS n_{k}" for k, t in texts.items())
    return (f"SELECT p_partkey, {cols}, {r6('coalesce(' + _num_sql(texts['suffixed']) + ', 0.0)')} "
            f"AS n_suffixed_filled FROM part")


def _quantile(x: str, p: float, where: str) -> str:
    return f"coalesce(quantile_cont({x}, {p}) FILTER (WHERE {where}), 0.0)"


QUART = f"""quart AS (SELECT {_quantile('TX_EVASAO', 0.25, 'TX_EVASAO > 0 AND QT_ING >= 10')} AS q1,
  {_quantile('TX_EVASAO', 0.5, 'TX_EVASAO > 0 AND QT_ING >= 10')} AS q2,
  {_quantile('TX_EVASAO', 0.75, 'TX_EVASAO > 0 AND QT_ING >= 10')} AS q3 FROM rated)"""
LABELLED = """labelled AS (SELECT rated.*, CASE WHEN TX_EVASAO <= q1 THEN 'muito baixo risco'
  WHEN TX_EVASAO <= q2 THEN 'baixo risco' WHEN TX_EVASAO <= q3 THEN 'alto risco'
  ELSE 'muito alto risco' END AS NIVEL_RISCO FROM rated, quart)"""
LABEL_CODE = ("(CASE NIVEL_RISCO WHEN 'alto risco' THEN 0 WHEN 'baixo risco' THEN 1 "
              "WHEN 'muito alto risco' THEN 2 WHEN 'muito baixo risco' THEN 3 END)")
BIN_GT = f"""bin AS (SELECT rated.CO_CURSO, CASE WHEN TX_EVASAO > thr THEN 1 ELSE 0 END AS NIVEL_RISCO
  FROM rated, (SELECT {_quantile('TX_EVASAO', 0.5, 'TX_EVASAO > 0 AND QT_ING >= 10')} AS thr FROM rated) t)"""


def course_oracles() -> dict[str, str]:
    q = {}
    q["q_filter_courses"] = BASE + "SELECT * FROM filtered"
    q["q_filter_audit"] = with_ctes(COURSES) + """SELECT count(*) AS rows_in,
  count(*) AS rows_complete, count(*) AS rows_coercible,
  count(*) FILTER (WHERE TP_GRAU_ACADEMICO = 2 AND lower(NO_CURSO) LIKE '%widget%') AS rows_course,
  count(*) FILTER (WHERE TP_GRAU_ACADEMICO = 2 AND lower(NO_CURSO) LIKE '%widget%' AND QT_ING > 10) AS rows_volume
FROM courses"""
    q["q_rate_r1"] = with_ctes(COURSES, ROOT) + f"SELECT CO_CURSO, {r6(R1_EXPR)} AS TX_EVASAO FROM root WHERE {DENOM} >= 10"
    q["q_rate_r2"] = BASE + f"SELECT CO_CURSO, {r6(R2_EXPR)} AS TX_EVASAO FROM filtered"
    q["q_rate_r3"] = q["q_rate_r2"]
    q["q_rate_r4"] = with_ctes(COURSES, ROOT) + f"SELECT CO_CURSO, {r6(R4_EXPR)} AS TX_EVASAO FROM root WHERE {R4_EXPR} IS NOT NULL"
    q["q_rate_r5"] = with_ctes(COURSES, ROOT) + f"SELECT CO_CURSO, {r6(R5_EXPR)} AS TX_EVASAO FROM root WHERE {R5_EXPR} IS NOT NULL"
    q["q_to_numeric"] = _to_numeric_sql()
    q["q_features"] = BASE_RATED + f"SELECT CO_CURSO, {r6('TX_EVASAO')} AS TX_EVASAO, {feature_select()} FROM rated"
    keep = ", ".join(["CO_CURSO", "TP_GRAU_ACADEMICO", "CO_REGIAO", "TP_REDE"] + COUNT_COLS)
    q["q_feature_table"] = BASE_RATED + (f"SELECT {keep}, {r6('QT_INSCRITO_TOTAL')} AS QT_INSCRITO_TOTAL, "
                                         f"{r6('TX_EVASAO')} AS TX_EVASAO, {feature_select()} FROM rated")
    q["q_simple_table"] = BASE_RATED + (f"SELECT {keep}, {r6('QT_INSCRITO_TOTAL')} AS QT_INSCRITO_TOTAL, "
                                        f"{r6('TX_EVASAO')} AS TX_EVASAO FROM rated")
    q["q_share_by_region"] = with_ctes(COURSES, FILTERED, RATED, FEATURES_CTE) + f"""SELECT CO_REGIAO,
  count(*) AS n_courses, {r6('sum(FEAT_PCT_ING_JOVEM)')} AS sum_pct_jovem,
  {r6('sum(FEAT_PCT_ING_PRETA_PARDA)')} AS sum_pct_preta_parda,
  {r6('sum(FEAT_INDICE_DIVERSIDADE)')} AS sum_diversidade,
  {r6('avg(FEAT_IDADE_MEDIA_ING)')} AS avg_idade_media FROM feat GROUP BY CO_REGIAO"""
    bands = ["QT_ING_0_17", "QT_ING_25_29", "QT_ING_30_34", "QT_ING_35_39", "QT_ING_40_49"]
    reserve = " + ".join(bands[i % len(bands)] for i in range(len(RESERVE_NUMERATORS)))
    q["q_social_features"] = with_ctes(COURSES) + f"""SELECT CO_CURSO, {r6(sd('QT_ING_0_17', 'QT_ING'))} AS FEAT_PCT_ING_DEFICIENTE,
  {r6(sd(reserve, 'QT_ING_FEM'))} AS FEAT_PCT_ING_RESERVA_SOCIAL, {r6(sd('QT_ING_18_24', 'QT_ING'))} AS FEAT_PCT_ING_FINANC,
  {r6(sd('QT_ING_BRANCA', 'QT_ING_18_24'))} AS FEAT_PCT_ING_COM_FIES,
  {r6(sd('QT_ING_PRETA + QT_ING_PARDA', 'QT_ING'))} AS FEAT_PCT_ING_PROUNI FROM courses"""
    r1 = f"r1 AS (SELECT *, {R1_EXPR} AS TX_EVASAO FROM root WHERE {DENOM} >= 10)"
    r4 = f"r4 AS (SELECT *, {R4_EXPR} AS TX_EVASAO FROM root WHERE {R4_EXPR} IS NOT NULL)"
    q["q_threshold_median"] = with_ctes(COURSES, FILTERED, RATED, ROOT, r1, r4) + f"""SELECT
  (SELECT {r6(_quantile('TX_EVASAO', 0.5, 'TX_EVASAO > 0 AND QT_ING >= 10'))} FROM rated) AS threshold_gt,
  (SELECT {r6(_quantile('TX_EVASAO', 0.5, 'TX_EVASAO > 0 AND QT_ING >= 1'))} FROM r1) AS threshold_ge,
  (SELECT {r6('coalesce(quantile_cont(TX_EVASAO, 0.5), 0.0)')} FROM r4) AS threshold_all"""
    q["q_label_binary_gt"] = with_ctes(COURSES, FILTERED, RATED, BIN_GT) + "SELECT CO_CURSO, NIVEL_RISCO FROM bin"
    q["q_label_binary_ge"] = with_ctes(COURSES, ROOT, r1) + f"""SELECT CO_CURSO,
  CASE WHEN TX_EVASAO >= thr THEN 1 ELSE 0 END AS ALTO_RISCO
FROM r1, (SELECT {_quantile('TX_EVASAO', 0.5, 'TX_EVASAO > 0 AND QT_ING >= 1')} AS thr FROM r1) t"""
    q["q_label_binary_median"] = with_ctes(COURSES, ROOT, r4) + """SELECT CO_CURSO,
  CASE WHEN TX_EVASAO > thr THEN 1 ELSE 0 END AS ALTO_RISCO
FROM r4, (SELECT coalesce(quantile_cont(TX_EVASAO, 0.5), 0.0) AS thr FROM r4) t"""
    q["q_quartiles"] = BASE_RATED + f"""SELECT {r6("quantile_cont(TX_EVASAO, 0.25)")} AS q1,
  {r6("quantile_cont(TX_EVASAO, 0.5)")} AS q2, {r6("quantile_cont(TX_EVASAO, 0.75)")} AS q3
FROM rated WHERE TX_EVASAO > 0 AND QT_ING >= 10"""
    q["q_label_quartile"] = with_ctes(COURSES, FILTERED, RATED, QUART, LABELLED) + \
        f"SELECT CO_CURSO, NIVEL_RISCO, {LABEL_CODE} AS label_code FROM labelled"
    q["q_class_counts"] = with_ctes(COURSES, FILTERED, RATED, QUART, LABELLED) + \
        "SELECT NIVEL_RISCO, count(*) AS n FROM labelled GROUP BY NIVEL_RISCO"
    q["q_class_weights"] = with_ctes(COURSES, FILTERED, RATED, BIN_GT) + f"""SELECT b.CO_CURSO, b.NIVEL_RISCO,
  {r6('w.weight')} AS weight, {r6('r.pos_ratio')} AS pos_ratio
FROM bin b
JOIN (SELECT NIVEL_RISCO, (SELECT count(*) FROM bin) * 1.0 / ((SELECT count(DISTINCT NIVEL_RISCO) FROM bin) * count(*)) AS weight
      FROM bin GROUP BY NIVEL_RISCO) w ON b.NIVEL_RISCO = w.NIVEL_RISCO,
     (SELECT CASE WHEN sum(NIVEL_RISCO) = 0 THEN 1.0
             ELSE CAST(count(*) FILTER (WHERE NIVEL_RISCO = 0) AS DOUBLE) / count(*) FILTER (WHERE NIVEL_RISCO = 1) END AS pos_ratio FROM bin) r"""
    nn = "nn AS (SELECT * REPLACE (nullif(QT_ING_PRETA, 0) AS QT_ING_PRETA, nullif(QT_ING_60_MAIS, 0) AS QT_ING_60_MAIS) FROM courses)"
    q["q_complete_cases"] = with_ctes(COURSES, nn) + """SELECT CO_CURSO, 'all' AS rule FROM nn
WHERE QT_ING_PRETA IS NOT NULL AND QT_ING_60_MAIS IS NOT NULL AND NO_CURSO IS NOT NULL
UNION ALL SELECT CO_CURSO, 'subset' AS rule FROM nn WHERE QT_ING_PRETA IS NOT NULL AND QT_ING_0_17 IS NOT NULL"""
    return q
