"""Queries with an exact SQL form against DuckDB at sf0.01, and what is registered."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as E
from oracle_check import compare, duck
from tessera.llm import queries as Q

SF01 = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(Q.ORACLE))
def test_query_matches_oracle(spark, name):
    r = compare(spark, name, Q.REGISTRY[name], Q.ORACLE[name], SF01, duck(SF01))
    assert r["ok"], r


def test_all_operators_and_the_pipeline_are_registered():
    names = E.queries()
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)] == [1] * 13
    assert "pipeline" in names


def test_returned_columns(spark):
    want = {"op1": "doc_id bigint, n_shingles bigint, component_id bigint",
            "op2": "doc_id bigint, held_out boolean, lang_pred string, score double",
            "op4": "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean",
            "op5": "page_id bigint, url string, text string, n_chars bigint",
            "op6": "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string",
            "op7": "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, "
                   "base_failed boolean, kept boolean",
            "op8": "doc_id bigint, held_out boolean, score double, predicted int",
            "op11": "word string, form string, root string, n bigint, n_near bigint, form_n bigint",
            "op12": "item_id bigint, rank int, doc_id bigint, score bigint",
            "op13": "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"}
    for key, columns in want.items():
        name = next(n for n in Q.REGISTRY if n.startswith(key + "_"))
        got = dict(Q.REGISTRY[name](spark, "/root/testdata/sf0.001").dtypes)
        for c in columns.split(", "):
            column, kind = c.split(" ")
            assert got[column] == kind, (name, column)
