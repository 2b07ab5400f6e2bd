"""End-to-end jobs on census-like CSV files generated from the course view."""

import os

import pandas as pd
import pytest
from pyspark.sql import functions as F

from dropflow.config import StudyConfig
from dropflow.plans.jobs import (build_features, clean_2021, collect_metrics, evaluate_tables,
                                 root_filter)
from dropflow.plans.course_queries import feature_table
from dropflow.sources.csv import list_tables, scan_csv
from dropflow.sources.testdata import course_view

from paths import SF001

CFG = StudyConfig(course_name="widget")


@pytest.fixture(scope="module")
def census_dir(spark):
    base = os.path.join(__import__("tempfile").mkdtemp(prefix="dropflow-census-"), "microdados")
    os.makedirs(base)
    pdf = course_view(spark, SF001).toPandas()
    pdf["NO_REGIAO"] = "Região " + pdf["CO_REGIAO"].astype(str)   # non-ASCII text
    pdf["QT_CONC"] = 1
    y22 = pdf.copy()
    y22["QT_ING_RVPPI"] = 0                                        # column only in 2022
    y23 = pdf.drop(columns=["QT_VG_TOTAL_EAD"]).copy()             # column dropped in 2023
    y23["QT_ING_FEM"] = y23["QT_ING_FEM"].astype(object)
    y23.loc[y23.index[:3], "QT_ING_FEM"] = "NA"                    # missing tokens
    y22.to_csv(os.path.join(base, "MICRODADOS_CADASTRO_CURSOS_2022.CSV"), sep=";", index=False, encoding="latin-1")
    y23.to_csv(os.path.join(base, "microdados_cursos_2023.csv"), sep=";", index=False, encoding="latin-1")
    pdf.drop(columns=["QT_ING"]).to_csv(os.path.join(base, "QUEBRADO_2024.csv"), sep=";", index=False,
                                        encoding="latin-1")
    return base


def test_listing_and_scan(spark, census_dir):
    all_csv = list_tables(spark, census_dir, "*.csv", case_insensitive=True)
    assert len(all_csv) == 3
    assert len(list_tables(spark, census_dir, "*.CSV")) == 1
    df = scan_csv(spark, os.path.join(census_dir, "microdados_cursos_2023.csv"), sep=";", encoding="latin-1")
    assert "NO_REGIAO" in df.columns
    assert df.filter(F.col("NO_REGIAO").startswith("Região")).count() == df.count()
    assert df.filter(F.col("QT_ING_FEM").isNull()).count() == 3


def test_build_features_isolates_bad_file_and_unions_years(spark, census_dir, tmp_dir):
    mega, status = build_features(spark, census_dir, tmp_dir, CFG)
    st = {os.path.basename(r["file"]): r["status"] for r in status.collect()}
    assert st["QUEBRADO_2024.csv"] == "failed"
    assert st["MICRODADOS_CADASTRO_CURSOS_2022.CSV"] == "ok"
    years = {r["ANO_BASE"]: r["n"] for r in mega.groupBy("ANO_BASE").agg(F.count("*").alias("n")).collect()}
    expected = feature_table(spark, SF001).count()
    assert years["2022"] == expected
    assert years["2023"] <= expected  # rows with NA in a critical column drop out
    assert "QT_ING_RVPPI" in mega.columns and "FEAT_INDICE_DIVERSIDADE" in mega.columns
    assert mega.filter((F.col("ANO_BASE") == "2023") & F.col("QT_ING_RVPPI").isNotNull()).count() == 0
    assert not any(c.startswith("NO_") for c in mega.columns)
    assert "QT_SIT_DESVINCULADO" not in mega.columns
    # re-running overwrites the year partitions instead of duplicating them
    n_first = mega.count()
    mega2, _ = build_features(spark, census_dir, tmp_dir, CFG)
    assert mega2.count() == n_first


def test_files_of_one_year_or_none_keep_all_rows_and_stale_files_stay_out(spark, census_dir, tmp_dir):
    source = os.path.join(census_dir, "MICRODADOS_CADASTRO_CURSOS_2022.CSV")
    inbox = os.path.join(tmp_dir, "inbox")
    os.makedirs(inbox)
    text = open(source, encoding="latin-1").read()
    for name in ("cursos_a.csv", "cursos_b.csv", "parte1_2022.csv"):
        with open(os.path.join(inbox, name), "w", encoding="latin-1") as fh:
            fh.write(text)
    expected = feature_table(spark, SF001).count()
    out = os.path.join(tmp_dir, "out")
    mega, status = build_features(spark, inbox, out, CFG)
    assert mega.count() == 3 * expected
    assert {(r["status"], r["rows_out"]) for r in status.collect()} == {("ok", expected)}
    years = {r["ANO_BASE"]: r["n"] for r in mega.groupBy("ANO_BASE").agg(F.count("*").alias("n")).collect()}
    assert years == {"desconhecido": 2 * expected, "12022": expected}
    os.remove(os.path.join(inbox, "cursos_a.csv"))
    mega, _ = build_features(spark, inbox, out, CFG)
    assert mega.count() == 2 * expected


def test_listing_prunes_below_the_start_folder_only(spark, tmp_dir):
    base = os.path.join(tmp_dir, "microdados", "x y")
    os.makedirs(os.path.join(base, "venv"))
    for d in (base, os.path.join(base, "venv")):
        pd.DataFrame({"a": [1]}).to_csv(os.path.join(d, "t.csv"), index=False)
    assert len(list_tables(spark, base, "*.csv", recursive=True, exclude_dirs=("microdados", "venv"))) == 1
    assert list_tables(spark, os.path.join(base, "missing"), "*.csv") == []


def test_auto_encoding_keeps_a_real_replacement_character(spark, tmp_dir):
    path = os.path.join(tmp_dir, "t.csv")
    with open(path, "w", encoding="utf-8") as fh:
        fh.write("a;b\né\ufffd;1\n")
    assert scan_csv(spark, path, encoding="auto").first()["a"] == "é\ufffd"


def test_root_filter_writes_full_and_analysis(spark, census_dir, tmp_dir):
    status = root_filter(spark, census_dir, tmp_dir, cfg=CFG)
    assert [r["status"] for r in status.collect()] == ["ok"]
    full = spark.read.parquet(os.path.join(tmp_dir, "COMPLETO_LETRAS_LIC_MICRODADOS_CADASTRO_CURSOS_2022.CSV"))
    assert "TX_EVASAO" in full.columns and "QT_SIT_FALECIDO" not in full.columns
    ana = spark.read.parquet(os.path.join(tmp_dir, "tabelas_analise", "ANALISE_EVASAO_MICRODADOS_CADASTRO_CURSOS_2022.CSV"))
    assert ana.columns == ["CO_REGIAO", "TP_REDE", "TP_GRAU_ACADEMICO", "QT_ING", "TX_EVASAO"]


def test_collect_metrics_report(spark, tmp_dir):
    d = os.path.join(tmp_dir, "tabelas", "sub")
    os.makedirs(d)
    pd.DataFrame({"arquivo": ["2022", "mega"], "modelo": ["RandomForest", "MLP"], "R2": [0.123456, -0.5],
                  "MAE": [0.3, 0.2], "nota": ["boa", "má"]}).to_csv(os.path.join(d, "metricas_REGRESSAO.csv"), sep=";", index=False)
    pd.DataFrame({"Arquivo": ["ano ção"], "Modelo": ["LR"], "Accuracy": [0.71]}).to_csv(
        os.path.join(tmp_dir, "metricas_latin.csv"), sep=";", index=False, encoding="latin-1")
    os.makedirs(os.path.join(tmp_dir, "microdados"))
    pd.DataFrame({"a": [1]}).to_csv(os.path.join(tmp_dir, "microdados", "metricas_skip.csv"), sep=";", index=False)
    rep = collect_metrics(spark, tmp_dir).collect()
    tables = {r["tabela"] for r in rep}
    assert tables == {"tabelas/sub/metricas_REGRESSAO.csv", "metricas_latin.csv"}
    assert {r["texto"] for r in rep if r["metrica"] == "nota"} == {"boa", "má"}  # a third text column stays
    vals = {(r["arquivo"], r["metrica"]): r["valor"] for r in rep}
    assert vals[("2022", "R2")] == 0.1235 and vals[("ano ção", "Accuracy")] == 0.71


def test_evaluate_tables_guard_and_metrics(spark, tmp_dir):
    from dropflow.plans.model_queries import model_table
    tables = {"all": model_table(spark, SF001), "tiny": model_table(spark, SF001).limit(20)}
    metrics, imps, thr, status = evaluate_tables(spark, tables, task="binary", only=["LogisticRegression"],
                                                 output_dir=tmp_dir)
    st = {r["file"]: (r["status"], r["reason"]) for r in status.collect()}
    assert st["all"][0] == "ok" and st["tiny"] == ("skipped", "fewer than 50 rows")
    m = metrics.collect()
    assert len(m) == 1 and 0.0 <= m[0]["ROC-AUC"] <= 1.0
    written = {r["metrica"]: r["valor"] for r in collect_metrics(spark, tmp_dir).collect()}
    assert written["ROC-AUC"] == pytest.approx(m[0]["ROC-AUC"], abs=1e-4) and "Accuracy" in written
    assert {"metricas_BINARY", "importancias_BINARY", "limiares_BINARY"} <= set(os.listdir(tmp_dir))
    assert imps.filter(F.col("Modelo") == "LogisticRegression").count() > 0


def test_clean_2021(spark, census_dir, tmp_dir):
    path = os.path.join(census_dir, "MICRODADOS_CADASTRO_CURSOS_2022.CSV")
    utf = os.path.join(tmp_dir, "L_T_2021.csv")
    pd.read_csv(path, sep=";", encoding="latin-1").to_csv(utf, sep=";", index=False, encoding="utf-8")
    res = clean_2021(spark, utf, cfg=CFG)
    assert "NO_CURSO" in res.columns  # the reference keeps names (its drop is overwritten)
    assert res.count() == res.dropna().count()


def test_predictor_and_union_evaluation(spark, census_dir, tmp_dir):
    from dropflow.config import REDUCED_FEATURES
    from dropflow.plans.jobs import evaluate_union, predictor
    from dropflow.plans.model_queries import model_table
    path = os.path.join(census_dir, "MICRODADOS_CADASTRO_CURSOS_2022.CSV")
    cfg = StudyConfig(course_name="")  # every course: the widget subset is below the 50-row guard
    reg, cls, thr = predictor(spark, path, os.path.join(tmp_dir, "models"), only_reg=["RandomForest"],
                              only_cls=["LogisticRegression"], cfg=cfg)
    assert [r["modelo"] for r in reg.collect()] == ["RandomForest"]
    assert [r["Modelo"] for r in cls.collect()] == ["LogisticRegression"] and thr > 0
    assert spark.read.parquet(os.path.join(tmp_dir, "models", "metrics_regression")).count() == 1
    from pyspark.ml import PipelineModel
    saved = os.path.join(tmp_dir, "models", "models")
    assert sorted(os.listdir(saved)) == ["classifier_LogisticRegression", "regressor_RandomForest"]
    loaded = PipelineModel.load(os.path.join(saved, "regressor_RandomForest"))
    assert loaded.stages[-1].getNumTrees == 100
    raw = scan_csv(spark, path, sep=";", encoding="ISO-8859-1", infer=True).limit(20)
    assert loaded.transform(raw).filter("prediction >= 0").count() == 20  # raw rows, with unseen names and all
    frames = {"2022": model_table(spark, SF001), "2023": model_table(spark, SF001)}
    m, imp, t = evaluate_union(spark, frames, keep=REDUCED_FEATURES, only=["LogisticRegression"])
    assert m.count() == 1 and imp.count() > 0


def test_evaluate_tables_root_profile_reduced(spark):
    from dropflow.config import REDUCED_FEATURES
    from dropflow.plans.model_queries import model_table
    tables = {"2022": model_table(spark, SF001)}
    metrics, imps, thr, status = evaluate_tables(spark, tables, task="binary", profile="g2",
                                                 binary_op=">=", binary_min_volume=1,
                                                 keep=REDUCED_FEATURES, only=["LogisticRegression"])
    assert [r["status"] for r in status.collect()] == ["ok"]
    feats = {r["Feature"] for r in imps.collect()}
    assert "QT_ING" in feats and "CO_REGIAO" in feats
    assert any(f == "CO_CURSO" or f.startswith("CO_CURSO=") for f in feats)  # one of the reduced predictors
    assert not any(f.startswith("FEAT_") for f in feats)  # outside the reduced keep-list


def test_tables_from_files_after_root_filter(spark, census_dir, tmp_dir):
    from dropflow.plans.jobs import tables_from_files
    root_filter(spark, census_dir, tmp_dir, cfg=CFG)
    tabs = tables_from_files(spark, tmp_dir, rename=("ANALISE_EVASAO_", "REDUZIDO_"))
    assert sorted(tabs) == ["COMPLETO_LETRAS_LIC_MICRODADOS_CADASTRO_CURSOS_2022.CSV",
                            "REDUZIDO_MICRODADOS_CADASTRO_CURSOS_2022.CSV"]
    assert all(t.count() > 0 for t in tabs.values())
