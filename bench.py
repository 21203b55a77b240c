"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one JSON line."""

from __future__ import annotations

import contextlib
import json
import os
import shutil
import sys
import tempfile
import time

DIRECTORY = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")

#: name: registered query. Each is run once to warm up and then timed, its whole result written to a sink that drops it.
QUERIES = {
    "flagship": "flagship_pricing", "keyed_upsert_orders": "n03_merge_by_key", "keyed_diff_orders": "r02_keyed_diff", "digest_diff_orders": "r05_digest_diff",
    "rollup": "e29_rollup", "windows": "f07_frames", "asof": "c06_asof_lookup", "abc": "mart_abc_classes", "sessions": "s03_sessions", "quarters": "mart_quarters",
}


def lineitem_loads(spark, folder: str) -> dict[str, float]:
    """Bulk copy, keyed upsert of a tenth, and digest diff of two versions, all of lineitem."""
    from pyspark.sql import functions as F

    from sparkloom.plans import compare, loads
    from sparkloom.sources import files

    base = spark.read.parquet(f"{DIRECTORY}/lineitem.parquet").withColumn("id", F.monotonically_increasing_id())
    out = {}
    begun = time.time()
    files.bulk_copy(base, f"{folder}/copy", base.schema)
    out["bulk_copy_lineitem"] = time.time() - begun
    copy = spark.read.parquet(f"{folder}/copy")
    table = loads.Table(spark, f"{folder}/table")
    begun = time.time()
    loads.merge_by_key(table, copy, ["id"])
    out["first_load_lineitem"] = time.time() - begun
    stage = copy.where("id % 10 = 3").withColumn("l_quantity", F.col("l_quantity") + 1)
    begun = time.time()
    loads.merge_by_key(table, stage, ["id"])
    out["keyed_upsert_lineitem"] = time.time() - begun
    begun = time.time()
    found = compare.digest_diff(copy, table.read().withColumn("l_tax", F.when(F.col("id") % 1000 == 7, F.col("l_tax") + 1).otherwise(F.col("l_tax"))), ["id"]).count()
    out["digest_diff_lineitem"] = time.time() - begun
    assert found
    return out


def main() -> None:
    sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
    from sparkloom import queries
    from sparkloom.session import session

    folder = tempfile.mkdtemp(prefix="loom-bench-")
    spark = session(
        "bench", f"local[{CPUS}]", **{"spark.sql.shuffle.partitions": CPUS, "spark.driver.memory": "8g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.checkpoint.dir": f"{folder}/shared"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds: dict[str, float] = {}
    for name, key in QUERIES.items():
        for _ in range(2):
            begun = time.time()
            queries.QUERIES[key](spark, DIRECTORY).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.time() - begun, 3)
    seconds |= {k: round(v, 3) for k, v in lineitem_loads(spark, folder).items()}
    spark.stop()
    with contextlib.suppress(OSError):
        shutil.rmtree(folder)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(DIRECTORY.rstrip("/"))}))


if __name__ == "__main__":
    main()
