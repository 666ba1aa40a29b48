"""Physical plans: what is read, what is shuffled, and that Python stays out."""

import re

import pytest

from sparkmask.operators import keyset, queries, sweep
from tests.conftest import DATA, needs_data

pytestmark = needs_data


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["mask_customer", "scramble_text", "strategy_email", "scramble_unique_composite", "mask_all_columns_supplier"])
def test_masks_are_one_projection(spark, name):
    text = plan(queries.QUERIES[name](spark, DATA))
    assert "Exchange" not in text and "Python" not in text and "Join" not in text and text.count("FileScan") == 1


def test_overwritten_columns_are_not_read(spark):
    text = plan(queries.QUERIES["mask_customer"](spark, DATA))
    assert "ReadSchema: struct<c_custkey:bigint,c_name:string,c_nationkey:int>" in text
    assert "ReadSchema: struct<s_suppkey:bigint>" in plan(queries.QUERIES["mask_all_columns_supplier"](spark, DATA))


def test_a_sweep_scans_a_table_once_and_sends_one_row_a_task(spark):
    text = plan(sweep.counts(queries.table(spark, DATA, "documents")))
    assert text.count("FileScan") == 1 and "ReadSchema: struct<text:string,lang:string,source:string>" in text
    assert len(re.findall("Exchange", text)) == 1 and "partial_" in text and "Python" not in text


def test_key_pages_take_few_rows_and_push_their_bound_down(spark):
    text = plan(queries.QUERIES["keyset_page"](spark, DATA))
    assert "TakeOrderedAndProject" in text and "Exchange" not in text
    assert "PushedFilters: [IsNotNull(c_custkey), GreaterThan(c_custkey,40)]" in text
    assert "GreaterThanOrEqual(conv_id,3)" in plan(queries.QUERIES["keyset_page_composite"](spark, DATA))
    assert "LessThanOrEqual(conv_id,9)" in plan(queries.table(spark, DATA, "conversations").where(keyset.upto(["conv_id", "turn"], [9, 2])))


def test_reconciling_shuffles_keys_alone(spark):
    text = plan(queries.QUERIES["reconcile_rows"](spark, DATA))
    assert set(re.findall(r"ReadSchema: (\S+)", text)) == {"struct<c_custkey:bigint>"} and "Join" not in text


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.RULE_QUERIES)))
def test_no_query_runs_python(spark, name):
    text = plan(queries.QUERIES[name](spark, DATA))
    assert not re.search("Python|Pandas|InArrow|Cartesian|NestedLoop", text)
