"""Time the queries on one machine; prints one JSON line.

Graphs are loaded into their table layout before the queries are timed; the time of
each load is reported on its own.
"""

import json
import os
import sys
import time

from braidgraph.session import local_session
from braidgraph.workload import QUERIES, fixtures
from braidgraph.workload import governance, streams, vectors

HEADLINE = (
    "triples_history", "triples_current", "triples_as_of", "entities_by_attribute",
    "relations_history", "entities_by_type", "entities_by_relation", "entities_ordered_page",
    "entities_hydrated", "relations_by_filter", "relations_with_attributes",
    "relation_targets", "traverse_two_hops", "entity_versions", "space_parents",
    "triple_nearest_down", "inherited_triple", "inherited_relations", "schema_report",
    "shortest_paths", "shortest_path_counts", "vector_topk", "vector_prefiltered", "vector_traverse", "text_search",
    "typed_wide", "wide_to_triples", "typed_find", "proposals", "votes", "space_members",
    "op_routing", "entity_profile", "triples_with_names", "stream_ops_replay",
)
LOADS = {
    "load_trade": fixtures.graph,
    "load_schema": fixtures.schema_graph,
    "load_vectors": fixtures.vector_graph,
    "load_documents": vectors.doc_graph,
    "load_governance": governance.governance_graph,
    "load_stream": streams.ingested,
}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", "8"))
    names = sys.argv[1:] or HEADLINE
    if names == ["all"]:
        names = list(QUERIES)
    spark = local_session("bench", cores)
    spark.range(1000).selectExpr("sum(id)").collect()
    loads, seconds = {}, {}
    for name, load in LOADS.items():
        started = time.perf_counter()
        load(spark, sf_dir)
        loads[name] = round(time.perf_counter() - started, 3)
        print(name, loads[name], file=sys.stderr, flush=True)
    for name in names:
        started = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    result = {
        "metric": "total_query_seconds",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "loads": loads,
        "sf": os.path.basename(sf_dir.rstrip("/")),
        "cpus": cores,
    }
    spark.stop()
    print(json.dumps(result), flush=True)


if __name__ == "__main__":
    main()
