"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) say where and how wide.
Each query is run once cold and then WARM times; the figure is the warm median."""

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from sparkwell.plans import catalog  # noqa: E402
from sparkwell.session import build  # noqa: E402

WARM = 3
#: The shapes of the published baseline, then joins, windows and the engine's own operators.
HEADLINES = {
    "count_all": "SELECT count(*) AS n FROM lineitem",
    "count_key_range": "SELECT count(*) AS n FROM lineitem WHERE l_orderkey BETWEEN 1000 AND 50000",
    "count_equal": "SELECT count(*) AS n FROM lineitem WHERE l_returnflag = 'R'",
    "count_float": "SELECT count(*) AS n FROM lineitem WHERE l_discount > 0.095",
    "group_one_key": "SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY l_returnflag",
    "sum_by_key": "SELECT l_returnflag, sum(l_quantity) AS q FROM lineitem GROUP BY l_returnflag",
    "group_two_keys": "SELECT l_returnflag, l_linestatus, count(*) AS n, avg(l_quantity) AS a, max(l_extendedprice) AS m FROM lineitem GROUP BY l_returnflag, l_linestatus",
}
NAMED = ["flagship_segment_revenue", "d_basic", "c_asof_backward", "e_aggregates", "d_cube", "d_replacing", "c_range_join_cells", "o_ts_moving_average", "m_bm25"]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = build(f"local[{cpus}]", 8, **{"spark.driver.memory": "8g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").createOrReplaceTempView("lineitem")
    runs = {n: (lambda q=q: spark.sql(q)) for n, q in HEADLINES.items()}
    runs |= {n: (lambda f=catalog.queries()[n]: f(spark, sf_dir)) for n in NAMED}
    times, cold = {}, {}
    for name, make in runs.items():
        took = []
        for _ in range(1 + WARM):
            start = time.time()
            make().write.format("noop").mode("overwrite").save()
            took.append(time.time() - start)
        cold[name], times[name] = round(took[0], 4), round(statistics.median(took[1:]), 4)
    print(json.dumps({
        "metric": "warm median of headline queries, summed", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "cold": cold, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
