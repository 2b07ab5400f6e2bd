"""The incremental feature build processes each arriving file exactly once."""

import os
import shutil

import pytest
from pyspark.sql import functions as F

from dropflow.config import StudyConfig
from dropflow.sources.csv import read_table
from dropflow.sources.testdata import course_view
from dropflow.streaming.census_stream import start_feature_stream

from paths import SF001


def test_stream_processes_new_files_once(spark, tmp_dir):
    inbox = os.path.join(tmp_dir, "inbox")
    out = os.path.join(tmp_dir, "out")
    ckpt = os.path.join(tmp_dir, "ckpt")
    os.makedirs(inbox)
    pdf = course_view(spark, SF001).toPandas()
    pdf.to_csv(os.path.join(inbox, "CURSOS_2022.csv"), sep=";", index=False, encoding="latin-1")
    cfg = StudyConfig(course_name="widget")
    q = start_feature_stream(spark, inbox, out, ckpt, cfg)
    q.awaitTermination(300)
    first = read_table(spark, os.path.join(out, "tables"))
    assert {r[0] for r in first.select("ANO_BASE").distinct().collect()} == {"2022"}
    n2022 = first.count()
    # a new year arrives; the old file is not reprocessed
    pdf.to_csv(os.path.join(inbox, "CURSOS_2023.csv"), sep=";", index=False, encoding="latin-1")
    q = start_feature_stream(spark, inbox, out, ckpt, cfg)
    q.awaitTermination(300)
    status = spark.read.parquet(os.path.join(out, "_status")).collect()
    assert sorted(os.path.basename(r["file"]) for r in status) == ["CURSOS_2022.csv", "CURSOS_2023.csv"]
    both = read_table(spark, os.path.join(out, "tables"))
    counts = {r["ANO_BASE"]: r["n"] for r in both.groupBy("ANO_BASE").agg(F.count("*").alias("n")).collect()}
    assert counts == {"2022": n2022, "2023": n2022}
