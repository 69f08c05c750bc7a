"""Time the headline queries; prints one JSON line."""

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "melt_cells", "shuffle_remap", "provenance_tile", "slicing_confusion", "precision_pivot", "slice_rowwise",
    "tileset_overlap", "retrieval_confusion", "merge_closure", "embed_table_cells", "tile_embedding", "retrieve_cosine",
    "retrieve_topk", "retrieve_perfect", "rank_documents", "pack_greedy", "pack_closure", "linearize_tiles",
    "build_requests", "rolling_rate", "slice_divisive",
]


def main() -> None:
    from tessera.plans import QUERIES
    from tessera.session import build_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    wanted = os.environ.get("BENCH_QUERIES")
    spark = build_session(
        "bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__ui__enabled="false",
        spark__driver__memory="16g", spark__checkpoint__dir=tempfile.mkdtemp(prefix="bench-"),
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").groupBy("l_returnflag").count().collect()  # start-up
    times = {}
    for name in wanted.split(",") if wanted else HEADLINE:
        start = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline queries, total wall time", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")),
    }))


if __name__ == "__main__":
    main()
