"""Rows that no limit and no null may leave out."""

import duckdb
from test_text_ops import same_rows

from simloom.llm import decontaminate, language_id
from simloom.llm.oracles import ORACLES


def test_items_without_id_are_searched(spark):
    words = "one two three four five six seven eight nine ten"
    items = [(None, words), (None, "lone pair"), (1, words + " eleven")]
    docs = [(1, f"x {words} y"), (2, "a lone pair here"), (3, "clean"), (4, f"{words} eleven")]
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR); CREATE TABLE benchmark (item_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", docs)
    con.executemany("INSERT INTO benchmark VALUES (?, ?)", items)
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    same_rows(decontaminate.decontamination_report(d, b), con, ORACLES["op8_decontamination"])
    assert [r.doc_id for r in decontaminate.keep_clean(d, b).collect()] == [3]


def test_all_languages_are_learned(spark):
    rows = [(i, f"text number {i}", f"l{i % 210:03d}") for i in range(2100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    _, labels, languages = language_id.sample_windows(docs, "doc_id", "text", "lang", 10, 1)
    assert languages == sorted({r[2] for r in rows}) and len(set(labels.tolist())) == 210
