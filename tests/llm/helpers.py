"""Small tables with the cases that every operator must bear."""

import re

import duckdb

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, key string, size int, k int, rn int, row string, lines string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.001"


def table(spark, rows):
    """Documents from (doc_id, text, lang, source) with further columns whose names are also used inside operators."""
    return spark.createDataFrame([(*r, len(r[1] or ""), "x", "y", 1, 2, 3, "z", "w") for r in rows], SCHEMA)


LONG = "\n".join(f"line {i} of a very long text with the words alpha beta gamma {i * 7919 % 1013} and {i * 104729 % 7919}" for i in range(3000))
ODD = [
    (1, "the quick brown fox jumps over the lazy dog near the river bank", "en", "web"),
    (2, "the quick brown fox jumps over the lazy dog near the river bank", "en", "web"),
    (2, "the quick brown fox jumps over the lazy dog near the river bank", "en", "web"),
    (3, None, None, None),
    (4, "", "en", "web"),
    (5, " \t\n\x0b\x0c\r ", None, "web"),
    (6, LONG, "en", None),
    (None, "a text without an id but with some words in it", "en", "web"),
    (7, "ÄÖÜ ß 漢字 かな \u0000 \U0001f600 é ﻿", "de", "böok"),
    (8, "one", "en", "tiny"),
    (9, "!!! ### 123 ...", None, "tiny"),
    (10, LONG, "en", "web"),
]


def digest(df, *columns):
    return sorted(df.select(*columns).collect(), key=str)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def documents(spark, sf=SF):
    return spark.read.parquet(f"{sf}/documents.parquet")


def oracle(sql, rows=None, sf=SF):
    """Rows of a DuckDB query as sets of texts, with the columns' names in order."""
    con = duckdb.connect()
    if rows is None:
        con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    else:
        con.execute("create table documents (doc_id bigint, text varchar, lang varchar, source varchar)")
        con.executemany("insert into documents values (?, ?, ?, ?)", [list(r) for r in rows])
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(names), sorted(tuple(str(r[i]) for i in order) for r in got.fetchall())


def same(df, sql, rows=None):
    names, want = oracle(sql, rows)
    assert sorted(df.columns) == names
    assert sorted(tuple(str(r[c]) for c in names) for r in df.collect()) == want
