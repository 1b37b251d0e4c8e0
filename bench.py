"""Headline jobs at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each job runs once on a small table set first, so that times are of the job and
not of class loading. ``rates`` holds rows or postings per second of the jobs
that process a whole table.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from sealdex.functions.uid import uid_pos  # noqa: E402
from sealdex.operators.boolean import find  # noqa: E402
from sealdex.operators.index import SealedIndex  # noqa: E402
from sealdex.operators.index_store import ParquetIndexStore  # noqa: E402
from sealdex.plans import tables as tb  # noqa: E402
from sealdex.plans.queries import DEMO  # noqa: E402
from sealdex.plans.vault import Vault  # noqa: E402
from sealdex.session import build_session, scratch_path  # noqa: E402
from sealdex.sources.lines import read_lines  # noqa: E402
from sealdex.sources.records import record_lines  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
WARM_DIR = os.environ.get("BENCH_WARM_DIR", os.path.join(os.path.dirname(SF_DIR.rstrip("/")), "sf0.001"))
CPUS = os.environ.get("BENCH_CPUS", str(os.cpu_count()))


def drain(df) -> None:
    df.write.format("noop").mode("overwrite").save()


class Bench:
    def __init__(self, spark, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self.seconds: dict[str, float] = {}
        self.rates: dict[str, float] = {}

    def timed(self, name: str, job, rows: int | None = None):
        start = time.perf_counter()
        out = job()
        took = time.perf_counter() - start
        self.seconds[name] = round(took, 3)
        if rows:
            self.rates[name] = round(rows / took, 1)
        return out

    def run(self) -> Bench:
        spark, sf = self.spark, self.sf_dir
        rules = tb.region_rules()
        reader = DEMO.reader()

        people = Vault(spark, scratch_path(spark, "bench-people"), tb.DIRECTORY)
        path = scratch_path(spark, "bench-lines")
        record_lines(tb.on_all_cores(tb.directory(spark, sf)), tb.DIRECTORY).write.text(path)
        rows = tb.directory(spark, sf).count()
        self.timed("ingest_directory_lines", lambda: people.ingest_lines(read_lines(spark, path), DEMO), rows)

        orders = Vault(spark, scratch_path(spark, "bench-orders"), tb.ORDER_RECORDS)
        rows = tb.table(spark, sf, "orders").count()
        self.timed("ingest_orders", lambda: orders.ingest(tb.order_records(spark, sf), DEMO), rows)

        super_keys = self.timed("unlock", lambda: orders.unlock(orders.user_keys(DEMO, rules["super"])))
        asia_keys = orders.unlock(orders.user_keys(DEMO, rules["asia_marketing"]))
        self.timed("open_all_orders", lambda: drain(orders.open_all(super_keys)), rows)
        self.timed("open_asia_marketing_orders", lambda: drain(orders.open_all(asia_keys)))
        self.timed(
            "search_open_month_and_status",
            lambda: drain(orders.search(["month=1997-05", "status=f"], reader, super_keys).records),
        )
        self.timed(
            "search_open_region_frequent",
            lambda: drain(orders.search(["region=asia"], reader, asia_keys).records),
        )
        self.timed("search_found_opened", lambda: orders.search(["status=o"], reader, asia_keys).counts().collect())

        store = ParquetIndexStore(spark, scratch_path(spark, "bench-documents"))
        store.create()
        words = tb.document_words(spark, sf)
        report = self.timed("index_documents", lambda: SealedIndex(store, DEMO.writer()).upsert(words))
        self.rates["index_documents"] = round(report.postings / self.seconds["index_documents"], 1)

        index = SealedIndex(store, reader)
        searches = {
            "search_docs_rare": (["aantiin"], False),
            "search_docs_rare_and_frequent": (["aantiin", "the"], False),
            "search_docs_unknown_or_frequent": (["no-document-has-this", "the"], True),
            "search_docs_frequent": (["the"], False),
            "search_docs_and3": (["the", "in", "that"], False),
            "search_docs_or3": (["the", "in", "that"], True),
        }
        for name, (query, disjunction) in searches.items():
            self.timed(name, lambda: drain(find(index, query, disjunction).select(uid_pos(F.col("uid")))))
        return self


def main() -> None:
    spark = build_session(
        "sealdex-bench",
        master=f"local[{CPUS}]",
        **{
            "spark.sql.shuffle.partitions": str(2 * int(CPUS)),
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g"),
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    if os.path.isdir(WARM_DIR):
        Bench(spark, WARM_DIR).run()
    bench = Bench(spark, SF_DIR).run()
    print(
        json.dumps(
            {
                "metric": "sealed_ingest_index_search_total",
                "value": round(sum(bench.seconds.values()), 3),
                "unit": "sec",
                "queries": bench.seconds,
                "rates_per_sec": bench.rates,
                "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
                "cpus": int(CPUS),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
