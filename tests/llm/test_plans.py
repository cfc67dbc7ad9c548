"""Plans of the operators that must stay in expressions, and of joins everywhere."""

import re

import pytest

from ledgersift.llm import chat_format, line_dedup, quality_rules, secret_scan, source_mixing, url_filters

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("query", [quality_rules.quality_rules, secret_scan.secret_spans, chat_format.chat_digest, line_dedup.line_dedup])
def test_expressions_only(spark, query):
    text = plan(query(spark, SF))
    assert not re.search("Python|Pandas|Arrow|Cartesian|NestedLoop", text)


@pytest.mark.parametrize("query", [url_filters.url_verdicts, source_mixing.source_mixing])
def test_no_cross_join(spark, query):
    assert not re.search("Cartesian|NestedLoop", plan(query(spark, SF)))


def test_columns_reach_the_scan(spark):
    """Only what an operator needs is read; the pages' html never is."""
    text = plan(url_filters.url_verdicts(spark, SF))
    assert "ReadSchema" in text and "html" not in text
