"""How often a query reads its files, and that few bytes are not worked on by one task."""

import pytest

from lodestone.plans import code_queries, registry

DATA = "/root/testdata/sf0.001"


def test_made_files_are_dealt(spark):
    assert code_queries.tree(spark, DATA).where("path like '%.py'").rdd.getNumPartitions() >= int(spark.conf.get("spark.sql.shuffle.partitions"))


# of each query: how many times its plan parses the files at most
PASSES = {
    "security_rules": 1,
    "findings_summary": 2,
    "structure_rules": 4,
    "duplicate_candidates": 4,
    "import_graph": 3,
}


@pytest.mark.parametrize("name", PASSES)
def test_files_are_parsed_few_times(spark, name):
    plan = code_queries.QUERIES[name](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert 1 <= plan.count("MapInArrow") <= PASSES[name]


@pytest.mark.parametrize("name", ["call_arguments", "source_masking"])
def test_rows_of_a_small_table_are_dealt(spark, name):
    assert registry.QUERIES[name](spark, DATA).rdd.getNumPartitions() >= int(spark.conf.get("spark.sql.shuffle.partitions"))
