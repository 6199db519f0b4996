"""Small files of many rows do not make one long task."""

import pytest
from pyspark.sql import functions as F

from expodex import catalog
from expodex.operators import frontier


@pytest.mark.parametrize("name", ["external_links", "region_detect"])
def test_the_long_step_has_a_task_for_every_core(spark, data, name):
    plan = catalog.QUERIES[name](spark, data)._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [c_custkey#" in plan and f"], {4 * spark.sparkContext.defaultParallelism}" in plan


@pytest.mark.parametrize("name", ["pdf_numbered", "pdf_tables"])
def test_documents_are_shuffled_once(spark, data, name):
    plan = catalog.QUERIES[name](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(") == 1 and "Window" not in plan


def test_edges_of_a_crawl_are_made_once(spark):
    made = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    n = F.col("id")
    edges = spark.range(6).select(F.concat(F.lit("p"), n).alias("src"), F.concat(F.lit("p"), n + 1).alias("dst"), F.lit("page").alias("kind"), F.lit(0).alias("score"))
    out = frontier.crawl(spark.createDataFrame([("p0",)], "url string"), edges.mapInArrow(counted, edges.schema))
    assert sorted((r.url, r.round) for r in out.collect()) == [(f"p{k}", k) for k in range(7)] and made.value == 6
