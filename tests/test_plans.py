"""Plans: what is read, what is cut before a shuffle, what adaptive execution drops."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as registry
from corpusloom.catalog import samples
from corpusloom.operators import report, scale
from corpusloom.sources.tables import read_spread


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["included_files", "count_files", "by_directory", "tech_stack", "progress", "neighbours", "toc", "deduped_paths", "path_tree"])
def test_path_queries_never_read_the_texts(spark, sf_dir, name):
    plan = plan_of(registry.queries()[name](spark, sf_dir))
    scans = [line for line in plan.splitlines() if "FileScan parquet" in line]
    assert scans and all("text:string" not in line.split("ReadSchema:")[1] for line in scans)


def test_first_n_is_cut_before_the_shuffle(spark, sf_dir):
    plan = plan_of(registry.queries()["key_files"](spark, sf_dir))
    assert "row_number(), 5, Partial" in plan


def test_filters_reach_the_scan(spark, sf_dir):
    df = read_spread(spark, sf_dir, "documents", "doc_id").filter(F.col("source") == "src1").select("doc_id")
    assert "EqualTo(source,src1)" in plan_of(df)


def test_no_hot_key_costs_no_join(spark):
    rows = spark.range(1000).select("id", (F.col("id") % 7).alias("k"))
    lookup = spark.range(7).select(F.col("id").alias("k"), F.lit(1).alias("v"))
    joined = scale.lookup_join(rows, lookup, ["k"], "id")
    joined.collect()
    final = plan_of(joined).split("== Initial Plan ==")[0]
    assert final.count("Join") == 1


def test_text_queries_are_dealt_out(spark, sf_dir):
    assert read_spread(spark, sf_dir, "documents", "doc_id").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


@pytest.mark.parametrize(("name", "most"), [("progress", 3), ("batches", 3), ("toc", 3), ("neighbours", 3), ("deduped_paths", 3), ("architecture_report", 10), ("codebase_summary", 10)])
def test_numbering_costs_few_exchanges(spark, sf_dir, name, most):
    plan = plan_of(registry.queries()[name](spark, sf_dir))
    assert plan.count("Exchange hashpartitioning") + plan.count("Exchange rangepartitioning") + plan.count("Exchange SinglePartition") <= most


def test_report_texts_are_moved_once(spark, sf_dir):
    """From the scan to the sink, texts and sections pass one exchange."""
    rows = samples.described(spark, sf_dir).withColumn("explanation", F.lit("why"))
    plan = plan_of(report.report_lines(rows))
    assert len([line for line in plan.splitlines() if "Exchange" in line and "Broadcast" not in line]) == 1
