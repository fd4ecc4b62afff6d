"""Small tables of hard cases, shared by the tests of the corpus operators."""

import re

PROSE = ("Over the hills the small river ran down to a quiet town where people met each morning to trade bread, "
         "cloth and news of far places before the long road took them home again under a wide and pale evening sky. ")
LONG = " ".join(f"word{k % 997} of{k % 31} line{k}" for k in range(120_000))
DOCS = [
    (1, PROSE * 3, "en"), (1, PROSE * 3, "en"), (2, None, "en"), (3, "", None), (4, " \n\t ", "de"),
    (None, PROSE * 3, "en"), (None, None, None), (5, LONG, "en"), (6, PROSE * 3 + "tail", None), (7, "Été ñandú", "fr"),
    (8, "one two", "en"), (9, "!!! ??? 123", "en"), (10, PROSE.upper(), "en"), (11, "a\nb\na\n\nb\na", "en"),
]
CLASHES = ("key", "fp", "h", "t", "n", "salt", "kind", "spans", "shard", "piece", "u", "v", "root", "header", "turn_key")


def docs_frame(spark, rows=DOCS):
    """(doc_id, text, lang) with further columns whose names operators might use themselves."""
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for k, name in enumerate(CLASHES):
        df = df.selectExpr("*", f"{k} AS `{name}`")
    return df


def empty_docs(spark):
    return docs_frame(spark).filter("false")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def small_table(spark, name):
    return spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet")
