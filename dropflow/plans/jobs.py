"""End-to-end jobs over census files (the reference's script entry points).

Each job builds lazy per-file plans, isolates per-file failures into a status
table (file, status, reason) and writes Parquet (or CSV when asked). Only
status rows, thresholds and metric rows reach the driver.
"""

from __future__ import annotations

import json
import posixpath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import (ANALYSIS_CODES, ANALYSIS_COUNTS, CLEAN_2021_DROP, INITIAL_DROP, RATE,
                      REDUCED_FEATURES, ROOT_DROP, UNRESTRICTED_EXCLUDE, StudyConfig)
from ..functions.categories import MISSING_TOKEN, UNKNOWN_YEAR
from ..functions.features import add_features
from ..functions.rates import with_rate
from ..functions.numeric import is_numeric_type
from ..operators.columns import (drop_leakage, drop_prefix, drop_present, keep_except, keep_present,
                                 roles_by_prefix, roles_by_type, roles_table)
from ..operators.filters import check_eligible, complete_cases, course_predicate, filter_courses
from ..operators.labels import DuplicateEdges, label_binary, label_quartile
from ..operators.union import union_by_name
from ..sources.csv import list_tables, read_table, scan_csv, split_by_role, write_table
from ..session import for_wide_tables
from .evaluate import train_classifiers, train_regressors

STATUS_SCHEMA = "file string, status string, reason string, rows_in long, rows_out long"


def _year_of(path: str) -> str:
    digits = "".join(ch for ch in posixpath.basename(path) if ch.isdigit())
    return digits or UNKNOWN_YEAR


def _status(spark, rows) -> DataFrame:
    return spark.createDataFrame(rows, STATUS_SCHEMA)


# --- Entry A: feature build (and the simple variant) ----------------------------------

def build_course_features(raw: DataFrame, cfg: StudyConfig = StudyConfig(), simple: bool = False) -> DataFrame:
    """Filters -> id/name drops -> R2 rate -> 19 features (unless simple) -> leakage drop."""
    for required in ("TP_GRAU_ACADEMICO", "NO_CURSO", "QT_ING"):
        if required not in raw.columns:
            raise ValueError(f"missing required column {required}")
    df = filter_courses(raw, cfg.degree_code, cfg.course_name, cfg.min_volume)
    df = drop_present(drop_prefix(df, "NO_"), INITIAL_DROP)
    df = with_rate(df, "R3" if simple else "R2")
    if not simple:
        df = add_features(df)
    return drop_leakage(df)


@for_wide_tables
def build_features(spark: SparkSession, input_dir: str, output_dir: str,
                   cfg: StudyConfig = StudyConfig(), simple: bool = False,
                   fmt: str = "parquet"):
    """Per yearly file: feature table written under ``ANO_BASE=<year>``; the
    partitioned dataset read back is the "mega" table. Returns (mega, status)."""
    files = list_tables(spark, input_dir, "*.csv", case_insensitive=True)
    target = posixpath.join(output_dir, "tables")
    rows, done = [], []
    for path in files:
        try:
            raw = scan_csv(spark, path, sep=";", encoding="ISO-8859-1")
            n_out = write_feature_file(raw, path, target, cfg, simple, fmt)
            if n_out == 0:
                rows.append((path, "skipped", "no rows after filters", raw.count(), 0))
                continue
            done.append((_year_of(path), file_key(path)))
            rows.append((path, "ok", "", raw.count(), n_out))
        except Exception as e:  # noqa: BLE001 - one bad file must not stop the others
            rows.append((path, "failed", f"{type(e).__name__}: {e}", None, None))
    status = _status(spark, rows)
    if not done:
        return None, status
    spark.createDataFrame(done, "ANO_BASE string, arquivo_base string").write.mode("overwrite").parquet(
        posixpath.join(output_dir, RUN_FILES))
    return read_mega(spark, target, fmt), status


RUN_FILES = "run_files"


def file_key(path: str) -> str:
    """The file's name as a partition value (two files of a year stay apart)."""
    return posixpath.basename(path)


def write_feature_file(raw: DataFrame, path: str, target: str, cfg: StudyConfig, simple: bool, fmt: str = "parquet") -> int:
    """Write one file's feature rows under (year, file), replacing only what that file wrote before; the row count."""
    out = build_course_features(raw, cfg, simple).withColumns(
        {"ANO_BASE": F.lit(_year_of(path)), "arquivo_base": F.lit(file_key(path))})
    if out.limit(1).count() == 0:
        return 0
    write_table(out, target, fmt=fmt, partition_by=["ANO_BASE", "arquivo_base"], mode="overwrite")
    return read_table(out.sparkSession, target, fmt).filter(
        (F.col("ANO_BASE") == _year_of(path)) & (F.col("arquivo_base") == file_key(path))).count()


def read_mega(spark: SparkSession, target: str, fmt: str = "parquet") -> DataFrame:
    """All rows of the last run's files, with their year. Files of earlier runs that are gone stay out."""
    table = read_table(spark, target, fmt)
    listed = _listed(spark, posixpath.join(posixpath.dirname(target.rstrip("/")), RUN_FILES))
    if listed:
        table = table.filter(F.concat_ws("/", "ANO_BASE", "arquivo_base").isin([f"{y}/{f}" for y, f in listed]))
    return table.drop("arquivo_base")


def _listed(spark: SparkSession, path: str) -> list:
    """(year, file) rows of the last run (a row for each input file); none if no run was recorded."""
    if not list_tables(spark, path, "*.parquet"):
        return []
    rows = spark.read.parquet(path).select("ANO_BASE", "arquivo_base").collect()
    return [(r[0], r[1]) for r in rows]


# --- G2 root filter -----------------------------------------------------------------------

@for_wide_tables
def root_filter(spark: SparkSession, input_dir: str, output_dir: str, fmt: str = "parquet",
                cfg: StudyConfig = StudyConfig(), encoding: str = "ISO-8859-1"):
    """Per ``*.CSV``: complete cases, degree+name, R1 percent rate with den >= 10,
    drops; writes the full table and the analysis table. Returns status."""
    files = list_tables(spark, input_dir, "*.CSV")
    rows = []
    for path in files:
        name = posixpath.basename(path)
        try:
            raw = complete_cases(scan_csv(spark, path, sep=";", encoding="ISO-8859-1", infer=True))
            if "TP_GRAU_ACADEMICO" not in raw.columns or "NO_CURSO" not in raw.columns:
                rows.append((path, "skipped", "degree or name column missing", raw.count(), 0))
                continue
            f = raw.filter(course_predicate(raw, cfg.degree_code, cfg.course_name))
            full = drop_present(drop_prefix(with_rate(f, "R1", min_volume=cfg.min_volume), "NO_"), ROOT_DROP)
            n_out = full.count()
            if n_out == 0:
                rows.append((path, "skipped", "no rows after filters", raw.count(), 0))
                continue
            write_table(full, posixpath.join(output_dir, f"COMPLETO_LETRAS_LIC_{name}"), fmt=fmt, encoding=encoding)
            keep = ANALYSIS_CODES + [c for c in ANALYSIS_COUNTS if c not in ANALYSIS_CODES] + [RATE]
            write_table(keep_present(full, keep),
                        posixpath.join(output_dir, "tabelas_analise", f"ANALISE_EVASAO_{name}"), fmt=fmt, encoding=encoding)
            rows.append((path, "ok", "", raw.count(), n_out))
        except Exception as e:  # noqa: BLE001
            rows.append((path, "failed", f"{type(e).__name__}: {e}", None, None))
    return _status(spark, rows)


# --- Entry B and relatives: evaluation over tables -------------------------------------------

@for_wide_tables
def evaluate_tables(spark: SparkSession, tables: dict, task: str = "quartile", profile: str = "g3",
                    min_rows: int = 50, only=None, binary_op: str = ">", binary_min_volume: int | None = 10,
                    keep=None, exclude=None, complete: bool = False, output_dir: str | None = None):
    """Label, guard and train on every table; returns (metrics, importances, thresholds, status).

    ``keep``/``exclude`` restrict columns per table (reduced / unrestricted
    variants) and ``complete`` drops incomplete rows first. The root scripts'
    rule is ``profile='g2', binary_op='>=', binary_min_volume=1``. With
    ``output_dir`` the metric, importance and threshold tables are also written
    there as ``;``-separated files, which ``collect_metrics`` reads.
    """
    metrics, imps, thr_rows, rows = [], [], [], []
    for name, df in tables.items():
        try:
            if keep is not None:
                df = keep_present(df, keep)
            if exclude is not None:
                df = keep_except(df, exclude)
            if complete:
                df = complete_cases(df)
            df = df.persist()
            n_in = df.count()
            if task == "quartile":
                labelled, (q1, q2, q3) = label_quartile(df)
                thr_rows.append((name, float(q1), float(q2), float(q3)))
                target = "NIVEL_RISCO"
            elif task == "binary":
                target = "NIVEL_RISCO" if binary_op == ">" else "ALTO_RISCO"
                labelled, t = label_binary(df, target, op=binary_op, min_volume=binary_min_volume)
                thr_rows.append((name, float(t), None, None))
            else:
                labelled, target = df, RATE
            ok, reason, _ = check_eligible(labelled, None if task == "regression" else target, min_rows)
            if not ok:
                rows.append((name, "skipped", reason, n_in, 0))
                continue
            roles = None
            if profile != "g3":
                roles = roles_by_prefix(labelled, ("QT_",), exclude=[target, RATE])
            if task == "regression":
                m, imp = train_regressors(labelled, RATE, name, profile, only=only, roles=roles)
            else:
                m, imp = train_classifiers(labelled, target, name, task, profile, only=only, roles=roles)
            metrics.append(m)
            if imp is not None:
                imps.append(imp)
            rows.append((name, "ok", "", n_in, labelled.count()))
        except DuplicateEdges as e:
            rows.append((name, "skipped", str(e), None, None))
        except Exception as e:  # noqa: BLE001
            rows.append((name, "failed", f"{type(e).__name__}: {e}", None, None))
        finally:
            df.unpersist()
    order_col = "R2" if task == "regression" else ("ROC-AUC (weighted, ovr)" if task == "quartile" else "ROC-AUC")
    file_col = "arquivo" if task == "regression" else "Arquivo"
    m_all = union_by_name(metrics).orderBy(F.asc(file_col), F.desc_nulls_last(order_col)) if metrics else None
    i_all = union_by_name(imps) if imps else None
    thr = spark.createDataFrame(thr_rows, "Arquivo string, `Q1 (25%)` double, `Q2 (50%)` double, `Q3 (75%)` double")
    if output_dir:
        write_results(output_dir, task, m_all, i_all, thr)
    return m_all, i_all, thr, _status(spark, rows)


def write_results(output_dir: str, task: str, metrics: DataFrame | None, importances: DataFrame | None,
                  thresholds: DataFrame | None = None) -> None:
    """Write the result tables that exist: metrics, importances and thresholds of a task."""
    kinds = {"metricas": metrics, "importancias": importances, "limiares": thresholds}
    for kind, table in kinds.items():
        if table is not None:
            write_table(table.coalesce(1), posixpath.join(output_dir, f"{kind}_{task.upper()}"), fmt="csv")


def tables_from_dir(spark: SparkSession, directory: str, fmt: str = "parquet") -> dict:
    """Feature tables per year plus the union of all years ("mega")."""
    mega = read_mega(spark, directory, fmt)
    years = [r[0] for r in mega.select("ANO_BASE").distinct().orderBy("ANO_BASE").collect()]
    tables = {y: mega.filter(F.col("ANO_BASE") == y).drop("ANO_BASE") for y in years}
    tables["mega"] = mega
    return tables


def tables_from_files(spark: SparkSession, directory: str, patterns=("COMPLETO_*", "ANALISE_*"),
                      rename=None, prefix: str = "", recursive: bool = True) -> dict:
    """Evaluation tables written by ``root_filter`` (one per input file), found
    by several name patterns (S6c) and named after their file (E21): an
    optional ``rename=(old, new)`` rewrite of the name, then ``prefix``."""
    paths = set()
    for pat in patterns:
        paths.update(_dirs_matching(spark, directory, pat, recursive))
    out = {}
    for p in sorted(paths):
        name = posixpath.basename(p.rstrip("/"))
        if rename:
            name = name.replace(*rename)
        out[prefix + name] = read_table(spark, p)
    return out


def _dirs_matching(spark: SparkSession, directory: str, pattern: str, recursive: bool):
    """Table directories (Parquet output folders) whose name matches ``pattern``."""
    import fnmatch
    files = list_tables(spark, directory, "*.parquet", recursive=recursive)
    dirs = {posixpath.dirname(f) for f in files}
    return [d for d in dirs if fnmatch.fnmatchcase(posixpath.basename(d), pattern)]


@for_wide_tables
def evaluate_union(spark: SparkSession, frames: dict, keep=None, exclude=None,
                   profile: str = "g2", only=None, output_dir: str | None = None):
    """Concatenate years (reduced keep-list or all-but-exclude), drop incomplete
    rows, label rate >= median (volume >= 1), train (V11)."""
    parts = []
    for year, df in frames.items():
        if keep is not None:
            df = keep_present(df, keep)
        if exclude is not None:
            df = keep_except(df, exclude)
        parts.append(df)
    union = union_by_name(parts)
    union = complete_cases(union, [RATE, "QT_ING"]) if exclude is not None else complete_cases(union)
    labelled, t = label_binary(union, "ALTO_RISCO", op=">=", min_volume=1)
    num, cat = roles_by_prefix(labelled, ("QT_",), exclude=["ALTO_RISCO"])
    # the unrestricted variant imputes medians and replaces missing categories by a token of their own
    prep = dict(numeric="median+scale", strip_quotes=True, null_token=MISSING_TOKEN) if exclude is not None else {}
    m, imp = train_classifiers(labelled, "ALTO_RISCO", "concatenado", "binary", profile, only=only, roles=(num, cat), **prep)
    m = m.orderBy(F.desc_nulls_last("ROC-AUC"))
    if output_dir:
        write_results(output_dir, "concatenado", m, imp)
    return m, imp, t


REDUCED = REDUCED_FEATURES
UNRESTRICTED = UNRESTRICTED_EXCLUDE


# --- Entry C: one-file predictor --------------------------------------------------------------

@for_wide_tables
def predictor(spark: SparkSession, path: str, model_dir: str | None = None, sep: str = ";",
              only_reg=None, only_cls=None, cfg: StudyConfig = StudyConfig(), rate_kind: str = "R4",
              roles: str = "prefix"):
    """Scan -> degree+name -> rate -> drops -> roles -> regressors and median-label
    classifiers (median imputation + scaling, one-hot categories) -> saved models.

    The 2021 form is ``sep=',', rate_kind='R5', roles='type'``: it decides the roles by column type and
    writes the role table and the two value blocks before the rate is computed.
    """
    raw = scan_csv(spark, path, sep=sep, encoding="ISO-8859-1", infer=True)
    df = raw.filter(course_predicate(raw, cfg.degree_code, cfg.course_name))
    df = drop_present(df, ["NO_CURSO", "TP_GRAU_ACADEMICO"])
    typed = None
    if roles == "type":
        typed = roles_by_type(drop_present(drop_prefix(df, "NO_"), ["NU_ANO_CENSO", "SG_UF"]))
        if model_dir:
            write_table(roles_table(spark, *typed), posixpath.join(model_dir, "roles"))
            for kind, block in zip(("numeric", "categorical"), split_by_role(df, *typed)):
                write_table(block, posixpath.join(model_dir, f"values_{kind}"))
    df = with_rate(df, rate_kind, out="taxa_evasao")
    df = drop_present(drop_prefix(df, "NO_"), ["NU_ANO_CENSO", "SG_UF"])
    num, cat = typed or roles_by_prefix(df, ("QT_",), exclude=["taxa_evasao"])
    num, cat = [c for c in num if c in df.columns], [c for c in cat if c in df.columns]
    saved = {}
    reg, _ = train_regressors(df.withColumnRenamed("taxa_evasao", RATE), RATE, "predictor", "g1",
                              only=only_reg, roles=(num, cat), fitted=saved)
    labelled, thr = label_binary(df, "label_bin", rate="taxa_evasao", op=">", min_volume=None,
                                 positive_only=False)
    cls, _ = train_classifiers(labelled, "label_bin", "predictor", "binary", "g1", only=only_cls,
                               roles=(num, cat), fitted=saved)
    if model_dir:
        write_table(reg, posixpath.join(model_dir, "metrics_regression"))
        write_table(cls, posixpath.join(model_dir, "metrics_classification"))
        save_models(saved, posixpath.join(model_dir, "models"))
        with open_text(spark, posixpath.join(model_dir, "threshold.json")) as fh:
            fh.write(json.dumps({"threshold": thr, "numeric": num, "categorical": cat}))
    return reg, cls, thr


class open_text:
    """Write a small text file through Spark (works on any Hadoop file system)."""

    def __init__(self, spark, path):
        self.spark, self.path, self.buf = spark, path, []

    def __enter__(self):
        return self

    def write(self, s):
        self.buf.append(s)

    def __exit__(self, *exc):
        self.spark.createDataFrame([("".join(self.buf),)], "value string").coalesce(1) \
            .write.mode("overwrite").text(self.path)


# --- reports ------------------------------------------------------------------------------------

REPORT_SCHEMA = "tabela string, arquivo string, modelo string, metrica string, valor double, texto string"


@for_wide_tables
def collect_metrics(spark: SparkSession, start_dir: str,
                    exclude_dirs=(".git", "__pycache__", "venv", ".venv", "microdados")):
    """Every ``metricas*.csv`` file, or part of a written ``metricas*`` table, under ``start_dir`` in long
    form with its relative path, numbers to 4 decimals, and further text columns as ``texto`` (V13).
    Empty tables produce a notice row."""
    found = list_tables(spark, start_dir, "*.csv", case_insensitive=True, recursive=True, exclude_dirs=exclude_dirs)
    files = {}
    for p in found:  # a table that Spark wrote is a folder of parts
        folder = posixpath.basename(posixpath.dirname(p))
        if posixpath.basename(p).startswith("part-") and folder.lower().startswith("metricas"):
            files[posixpath.dirname(p)] = True
        elif posixpath.basename(p).lower().startswith("metricas"):
            files[p] = True
    parts = []
    base = start_dir.rstrip("/")
    for p in sorted(files):
        rel = p.split(base, 1)[-1].lstrip("/") if base in p else posixpath.basename(p)
        df = scan_csv(spark, p, sep=";", encoding="auto", infer=True)
        if df.limit(1).count() == 0:
            parts.append(spark.createDataFrame([(rel, None, None, "(Tabela vazia)", None, None)], REPORT_SCHEMA))
            continue
        num = [f.name for f in df.schema.fields if is_numeric_type(f.dataType)]
        text = [c for c in df.columns if c not in num]
        # the first two text columns name the row; further ones are reported as text values
        keys = [F.lit(rel).alias("tabela"),
                (F.col(f"`{text[0]}`") if text else F.lit(None)).cast("string").alias("arquivo"),
                (F.col(f"`{text[1]}`") if len(text) > 1 else F.lit(None)).cast("string").alias("modelo")]
        values = [F.struct(F.lit(c).alias("metrica"), (F.rint(F.col(f"`{c}`").cast("double") * 1e4) / 1e4).alias("valor"),
                           F.lit(None).cast("string").alias("texto")) for c in num]
        values += [F.struct(F.lit(c).alias("metrica"), F.lit(None).cast("double").alias("valor"),
                            F.col(f"`{c}`").cast("string").alias("texto")) for c in (text[2:] if num else text)]
        parts.append(df.select(*keys, F.explode(F.array(*values)).alias("v")).select("tabela", "arquivo", "modelo", "v.*"))
    if not parts:
        return spark.createDataFrame([], REPORT_SCHEMA)
    return union_by_name(parts).orderBy("tabela")


@for_wide_tables
def clean_2021(spark: SparkSession, path: str, out: str | None = None, drop_names: bool = False,
               cfg: StudyConfig = StudyConfig()):
    """2021 extract: name contains 'letras', degree == 2, complete cases; the
    reference's column drop is overwritten, so names are kept unless asked."""
    raw = scan_csv(spark, path, sep=";", encoding="UTF-8", infer=True)
    f = raw.filter(course_predicate(raw, cfg.degree_code, cfg.course_name))
    res = complete_cases(drop_present(f, CLEAN_2021_DROP) if drop_names else f)
    if out:
        write_table(res, out, fmt="csv", sep=",")
    return res


def save_models(models: dict, directory: str) -> None:
    """Persist fitted pipelines (S15) as Spark ML stores them; ``PipelineModel.load(path).transform(raw rows)`` scores."""
    for name, m in models.items():
        m.write().overwrite().save(posixpath.join(directory, name))


__all__ = ["build_course_features", "build_features", "root_filter", "evaluate_tables", "evaluate_union",
           "tables_from_dir", "tables_from_files", "predictor", "collect_metrics", "clean_2021", "save_models"]
