"""A small set of tables with every awkward case, and helpers to compare with brute force."""

from __future__ import annotations

import random
import re

import duckdb
from pyspark.sql import types as T

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

DOCUMENTS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                          T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                          T.StructField("n_chars", T.LongType()),
                          # names that results use
                          T.StructField("n_words", T.StringType()), T.StructField("copies", T.StringType()),
                          T.StructField("ids", T.LongType())])
BENCHMARK = T.StructType([T.StructField("item_id", T.LongType()), T.StructField("text", T.StringType())])
CONVERSATIONS = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()),
                              T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])
SCHEMAS = {"documents": DOCUMENTS, "benchmark": BENCHMARK, "conversations": CONVERSATIONS}

EN = "the of and that hein thou ering eder onan thre blean esha andion stere whoun therea".split()
FR = "le des éaux pour ça être quelle menté où leurè vaux même dans étoil oire".split()


def sentence(rng: random.Random, words: list[str], n: int) -> str:
    return " ".join(rng.choice(words) for _ in range(n)).capitalize() + "."


def prose(rng: random.Random, words: list[str], lines: int) -> str:
    return "\n".join(sentence(rng, words, rng.randint(6, 14)) for _ in range(lines))


def documents() -> list[tuple]:
    rng = random.Random(5)
    wide = [a + b for a in EN for b in EN]
    rows = []
    for i in range(60):
        words, lang = (wide, "en") if i % 3 else (FR, "fr")
        rows.append([i, prose(rng, words, rng.randint(4, 12)), lang, f"s{i % 5}" if i % 4 else "s0"])
    passage = "the quick brown fox jumps over the lazy dog and then sleeps"
    base = rows[1][1]
    rows += [
        [100, None, "en", "s1"], [101, "", "en", "s1"], [102, " \t\n\x0b\x0c\r ", None, None],
        [103, base, "en", "s2"], [104, base + " extra", "en", None],                       # copies
        [105, "\n".join(base.split("\n")[:2] + ["A new line of words that is only here for us."]), "en", "s3"],
        [106, rows[4][1].replace(rows[4][1].split()[20], "changed"), "en", "s3"],
        [107, f"Intro. The QUICK, brown fox: jumps over the lazy dog and then sleeps! Out {passage}", "en", "s0"],
        [108, "one two", "en", "s0"], [109, "%%% *** ### $$$ &&& ||| <<<", "en", "s0"],
        [110, "same words here again " * 40, "en", "s4"], [111, "Line a b c d e f g\n" * 30, "en", "s4"],
        [112, "日本語 テキスト です　と İstanbul ΣΑΣ é", "ja", "s4"],
        [113, "x" * 5000, "en", "s4"], [114, prose(rng, wide, 4000), "en", "s1"],           # very long
        [115, "It's 'sun we're !'s <|endoftext|>x a.b,c 4.0 .. ok", "en", "s1"],
        [116, "Intro text\nReleased under the MIT License.\nLicensed under the Apache License, Version 2.0.", "en", "s1"],
        [200, rows[2][1], "en", "s2"], [200, rows[2][1], "en", "s2"],                       # repeated rows
        [None, "no id at all " * 20, "en", "s2"], [None, None, None, None],
        [-5, "negative id " * 30, "en", "s2"],
    ]
    return [(i, t, lang, s, len(t) if t is not None else None, "x", "y", 1) for i, t, lang, s in rows]


def benchmark() -> list[tuple]:
    return [(1, "The quick brown fox jumps over the lazy dog, and then sleeps"), (2, "lazy dog and then"), (3, None),
            (4, ""), (10, "lazy dog and then"), (None, "negative id negative"), (5, "unseen item of words")]


def conversations() -> list[tuple]:
    rows = [(1, 0, "user", "hi <|turn|> \\ there"), (1, 1, "assistant", "<|end|>ok\\|<|"), (1, 2, "assistant", "  again \n"),
            (2, 0, "system", None), (2, 1, "assistant", None), (3, 5, None, "é日本 <|says|>"), (3, 4, "assistant", "é \U0001f600"),
            (4, 0, "user", "only a user"), (None, 0, "user", "no id"), (None, None, "assistant", "no turn"),
            (5, 0, "assistant", "twice"), (5, 0, "assistant", "twice"), (6, 0, "assistant", "long " * 30000)]
    return rows + [(7, t, "assistant" if t % 2 else "user", f"turn {t} <|") for t in range(200)]


ROWS = {"documents": documents, "benchmark": benchmark, "conversations": conversations}


def write_tables(spark, folder: str, empty: bool = False) -> str:
    for name, schema in SCHEMAS.items():
        spark.createDataFrame([] if empty else ROWS[name](), schema).write.parquet(f"{folder}/{name}.parquet")
    return folder


def sql_rows(folder: str, sql: str) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    for name in SCHEMAS:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet/*.parquet')")
    found = con.execute(sql)
    return [d[0] for d in found.description], found.fetchall()


def comparable(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    tidy = lambda v: round(v, 6) + 0.0 if isinstance(v, float) else list(v) if isinstance(v, (list, tuple)) else v
    return sorted(tuple(repr(tidy(r[i])) for i in order) for r in rows)


def text_words(text: str | None) -> list[str]:
    return WORD.findall((text or "").translate(LOWER))
