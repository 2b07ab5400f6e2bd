"""Documents without an id, or with the same one, keep their own lines."""

from dropflow.llm.lines import dedup_lines, summary


def test_lines_of_documents_without_an_id_stay_apart(spark):
    rows = [(1, "first a b\nsecond c d"), (None, "x one\nx two\nsecond c d"), (None, "y one\ny two\ny unique three"),
            (None, "y one\ny two\ny unique three"), (2, "p\nq\nfirst a b"), (2, "r\ns\nonly here too"), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = [r["text"] for r in dedup_lines(docs).collect()]
    assert sorted(kept, key=str) == sorted(["first a b\nsecond c d", "x one\nx two", "y one\ny two\ny unique three",
                                            "y one\ny two\ny unique three", "p\nq", "r\ns\nonly here too", None], key=str)
    assert sorted(tuple(r["dropped"]) for r in summary(docs).collect()) == [(), (), (), (), (), (2,), (2,)]
