"""Field extraction over all deliveries and whole texts."""

from datetime import datetime

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"


def test_what_is_missing_is_blank(spark, tmp_path):
    at = datetime(1996, 1, 5, 12)
    docs = [
        (1, "A", "first  title", "german", None, at), (2, "A", None, "ENGLISH", "Oslo", at), (3, "B", "no\tlanguage", None, " ", at), (4, "C", "blank language", " ", "Oslo", at),
        (5, "D", "no date", "French", None, None), (6, "E", "no date, no story", "The", "Oslo", None), (7, "F", None, None, None, None),
    ]
    texts = [("A", "all of\n it <b>is</b> May 5 1997 there"), ("A", "all of\n it <b>is</b> May 5 1997 there"), ("B", "b"), ("C", " "), ("D", "long " * 500), ("F", None)]
    spark.createDataFrame(docs, "rec_id long, doc_id string, title string, doc_lang string, city string, received_at timestamp").write.parquet(f"{tmp_path}/docs.parquet")
    spark.createDataFrame(texts, "doc_id string, text string").write.parquet(f"{tmp_path}/doc_text.parquet")
    got = {tuple(r) for r in entry.queries()["sgml_documents"](spark, str(tmp_path)).collect()}
    assert got == {
        ("A", "", "English", "1996-01-05", "all of it b is /b May 5 1997 there"), ("B", "no language", "", "1996-01-05", "b"), ("C", "blank language", "", "1996-01-05", ""),
        ("D", "no date", "French", "", " ".join(["long"] * 500)), ("E", "no date, no story", "", "", ""), ("F", "", "", "", ""),
    }


def test_no_story_is_left_out(spark):
    ids = {r[0] for r in spark.read.parquet(f"{FOLDER}/docs.parquet").select("doc_id").distinct().collect()}
    rows = entry.queries()["sgml_documents"](spark, FOLDER).collect()
    assert len(rows) == len(ids) and {r["doc_id"] for r in rows} == ids
