"""Study parameters and the fixed column lists of the course census.

The reference scripts vary these constants between scripts, so every job takes
a ``StudyConfig`` instead of hard-coding them.
"""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class StudyConfig:
    degree_code: int = 2                 # TP_GRAU_ACADEMICO kept (teaching degree)
    course_name: str = "LETRAS"          # case-insensitive substring of NO_CURSO
    min_volume: int = 10                 # volume threshold tied to the rate kind
    rate_kind: str = "R2"                # see functions.rates
    threshold_op: str = ">"              # binary label comparison
    threshold_min_volume: int = 10       # QT_ING floor for the threshold population
    test_size: float = 0.2
    seed: int = 42
    min_rows: int = 50                   # dataset eligibility guard
    extra: dict = field(default_factory=dict)


# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's for equal results.
# ---------------------------------------------------------------------------

# Rate sources: dropouts, transfers, entrants, deaths, enrolled.
DESV = "QT_SIT_DESVINCULADO"
TRANS = "QT_SIT_TRANSFERIDO"
ING = "QT_ING"
FALEC = "QT_SIT_FALECIDO"
MAT = "QT_MAT"
RATE = "TX_EVASAO"

# Columns whose null makes a row useless (feature build, subset dropna).
CRITICAL_COLUMNS = [
    "TP_GRAU_ACADEMICO", "NO_CURSO", "QT_SIT_DESVINCULADO",
    "QT_SIT_TRANSFERIDO", "QT_ING", "QT_SIT_FALECIDO",
    "QT_CONC", "QT_MAT", "QT_ING_FEM", "QT_MAT_FEM", "QT_CONC_FEM",
    "QT_ING_0_17", "QT_ING_18_24", "QT_ING_25_29", "QT_ING_30_34", "QT_ING_35_39",
    "QT_ING_40_49", "QT_ING_50_59", "QT_ING_60_MAIS",
]

# Identifier columns dropped before features (feature build / simple filter).
INITIAL_DROP = ["NU_ANO_CENSO", "SG_UF", "CO_IES"]

# Rate sources dropped after the rate is computed (target leakage).
LEAKAGE_DROP = ["QT_SIT_TRANCADA", "QT_SIT_DESVINCULADO", "QT_SIT_TRANSFERIDO", "QT_SIT_FALECIDO"]

# Root filter: ids and situation counts dropped from the full filtered table.
ROOT_DROP = ["NU_ANO_CENSO", "SG_UF", "CO_IES", "QT_SIT_TRANCADA",
             "QT_SIT_DESVINCULADO", "QT_SIT_TRANSFERIDO", "QT_SIT_FALECIDO"]

# Root filter: code columns of the analysis table, in order, then the counts.
ANALYSIS_CODES = [
    "CO_REGIAO", "CO_UF", "CO_MUNICIPIO", "IN_CAPITAL",
    "TP_DIMENSAO", "TP_ORGANIZACAO_ACADEMICA", "TP_REDE",
    "TP_CATEGORIA_ADMINISTRATIVA", "IN_COMUNITARIA", "IN_CONFESSIONAL",
    "CO_CINE_ROTULO", "CO_CINE_AREA_GERAL", "CO_CINE_AREA_ESPECIFICA",
    "CO_CINE_AREA_DETALHADA", "TP_GRAU_ACADEMICO", "IN_GRATUITO",
    "TP_MODALIDADE_ENSINO", "TP_NIVEL_ACADEMICO",
]
ANALYSIS_COUNTS = ["QT_ING", "QT_SIT_DESVINCULADO", "QT_SIT_TRANSFERIDO", "QT_SIT_FALECIDO"]

# Reduced feature set: 30 predictors (selected by mean importance) + the rate.
REDUCED_FEATURES = [
    "CO_MUNICIPIO", "CO_CURSO", "QT_SIT_TRANCADA", "QT_MAT", "QT_MAT_NACBRAS",
    "CO_UF", "CO_CINE_ROTULO", "QT_MAT_PROCESCPUBLICA", "QT_MAT_FEM", "QT_MAT_BRANCA",
    "CO_REGIAO", "QT_ING_PROCESCPUBLICA", "TP_ORGANIZACAO_ACADEMICA", "QT_ING_FEM",
    "QT_ING_VESTIBULAR", "QT_ING_BRANCA", "QT_ING_VG_NOVA", "QT_MAT_MASC",
    "QT_MAT_PARDA", "QT_MAT_18_24", "QT_ING", "QT_ING_NACBRAS", "QT_ING_18_24",
    "QT_ING_PARDA", "QT_MAT_FINANC", "QT_ING_MASC", "QT_MAT_25_29", "QT_MAT_40_49",
    "QT_MAT_CORND", "QT_MAT_FINANC_NREEMB",
    "TX_EVASAO",
]

# Unrestricted evaluation: every column except these ids / descriptions.
UNRESTRICTED_EXCLUDE = [
    "CO_UF_IES", "CO_MUNICIPIO_IES", "CO_IES", "CO_CINE_AREA", "CO_OCDE_AREA",
    "NO_REGIAO_IES", "NO_UF_IES", "NO_MUNICIPIO_IES", "NO_REGIAO", "NO_UF",
    "NO_MUNICIPIO", "SG_UF_IES", "SG_UF",
    "ANO_BASE", "DS_ORGANIZACAO_ACADEMICA", "DS_CATEGORIA_ADMINISTRATIVA",
    "NO_CINE_ROTULO", "DS_GRAU_ACADEMICO", "DS_MODALIDADE_ENSINO",
]

# G3 model scripts: engineered columns that are categorical, and ignored ids.
KNOWN_CATEGORICAL = ["FEAT_DOMINANCIA_MODALIDADE"]
MODEL_IGNORE = ["CO_MUNICIPIO", "CO_CURSO", "CO_IES"]

# 2021 cleaning: name columns meant to be dropped (the drop is overwritten upstream).
CLEAN_2021_DROP = [
    "NU_ANO_CENSO", "NO_REGIAO", "NO_UF", "SG_UF", "NO_MUNICIPIO",
    "NO_CURSO", "NO_CINE_ROTULO", "NO_CINE_AREA_GERAL",
    "NO_CINE_AREA_ESPECIFICA", "NO_CINE_AREA_DETALHADA",
]

# Age bands and the representative age of each band (mean entrant age).
AGE_BANDS = [
    ("QT_ING_0_17", 17), ("QT_ING_18_24", 21), ("QT_ING_25_29", 27),
    ("QT_ING_30_34", 32), ("QT_ING_35_39", 37), ("QT_ING_40_49", 45),
    ("QT_ING_50_59", 55), ("QT_ING_60_MAIS", 65),
]

# Five declared colour/race groups entering the diversity index.
RACE_GROUPS = ["QT_ING_BRANCA", "QT_ING_PRETA", "QT_ING_PARDA", "QT_ING_AMARELA", "QT_ING_INDIGENA"]

# Reserved-seat numerators (social reserve share).
RESERVE_NUMERATORS = ["QT_ING_RVREDEPUBLICA", "QT_ING_RVPPI", "QT_ING_RVPOVT",
                      "QT_ING_RVPDEF", "QT_ING_RVSOCIAL_RF"]

# Modality seat columns and their labels, in tie-break order.
MODALITY_SEATS = [("QT_VG_TOTAL_DIURNO", "DIURNO"), ("QT_VG_TOTAL_NOTURNO", "NOTURNO"),
                  ("QT_VG_TOTAL_EAD", "EAD")]

# Quartile risk classes, low to high; label codes are their alphabetical ranks.
QUARTILE_LABELS = ["muito baixo risco", "baixo risco", "alto risco", "muito alto risco"]

# Tokens read as missing by the reference's CSV reader.
NA_TOKENS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
             "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
             "nan", "null"]

# Box-plot categories, in the reference's order.
BOX_CATEGORIES = ["TP_GRAU_ACADEMICO", "TP_MODALIDADE_ENSINO", "TP_ORGANIZACAO_ACADEMICA",
                  "TP_CATEGORIA_ADMINISTRATIVA", "TP_REDE", "IN_CAPITAL", "CO_REGIAO", "CO_UF"]
