"""The registered queries of the subpackage: names, SQL where there is any, and columns."""

import os

import duckdb
import pytest

import __spark_entry__
from sluicebox.llm import queries

SF = "/root/testdata/sf0.001"
COLUMNS = {
    1: ["doc_id", "n_shingles", "component_id"],
    2: ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
    3: ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    4: ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
    5: ["doc_id", "size", "source_size", "target", "taken"],
    6: ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "tree_nodes", "tree_chars"],
    7: ["doc_id", "text", "n_entities"],
    8: ["doc_id", "keep_id", "group_size", "kept", "text_sha256"],
    9: ["doc_id", "quality", "kept"],
    10: ["doc_id", "held_out", "lang_pred", "score"],
}


def test_one_query_each():
    found = {int(n[2:].split("_")[0]): n for n in queries.QUERIES}
    assert sorted(found) == list(range(1, 11)) and "pipeline" in __spark_entry__.queries()


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_whole_table(spark, name):
    number = int(name[2:].split("_")[0])
    got = queries.QUERIES[name](spark, SF)
    assert got.columns[: len(COLUMNS[number])] == COLUMNS[number] or set(COLUMNS[number]) <= set(got.columns)
    table, key = ("conversations", "conv_id") if number == 6 else ("documents", "doc_id")
    want = {r[0] for r in spark.read.parquet(f"{SF}/{table}.parquet").select(key).collect()} | ({-1} if number == 6 else set())
    rows = got.collect()
    assert {r[key] for r in rows} == want and len(rows) == len(want)
    if name in queries.ORACLE_SQL:
        con = duckdb.connect()
        for file in os.listdir(SF):
            con.sql(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{SF}/{file}'")
        names = sorted(got.columns)
        sql = con.sql(queries.ORACLE_SQL[name]).df()
        assert sorted(sql.columns) == names
        assert sorted(tuple(str(v) for v in r) for r in sql[names].astype(object).itertuples(index=False)) == sorted(tuple(str(r[n]) for n in names) for r in rows)
