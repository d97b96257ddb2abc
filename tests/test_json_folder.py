"""The files that the JSON queries read are written by many tasks."""

import re
from pathlib import Path


def test_json_files_are_written_by_many_tasks(spark, tmp_path):
    from cloakframe.plans import QUERIES, store_queries

    customers = spark.range(0, 60_000, 500).selectExpr("id AS c_custkey", "CAST(id % 7 AS INT) AS c_nationkey", "'AUTO' AS c_mktsegment")
    customers.coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    written = [f.name for f in Path(store_queries._json_folder(spark, str(tmp_path))).glob("n=*/b=*/part-*")]
    assert len(written) == 120  # keys 500 apart lie in blocks of a thousand, in two nations each
    tasks = {re.match(r"part-(\d+)", name).group(1) for name in written}
    assert len(tasks) == spark.sparkContext.defaultParallelism
    found = QUERIES["json_file_counts"](spark, str(tmp_path)).first()
    assert tuple(found) == (120 - 17, 17)
