"""Benchmark of the headline operators.

Runs on local[$BENCH_CPUS] over $BENCH_SF_DIR (default /root/testdata/sf0.1)
and prints one JSON line. Each measurement forces the whole result with the
``noop`` sink (no collect to the driver).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from pyspark.sql import functions as F

    from litsearch.catalog import queries as Q
    from litsearch.plans.search import SearchConfig, search
    from litsearch.session import local_session
    from litsearch.sources import fixtures as FX

    spark = local_session(cpus, shuffle_partitions=max(8, int(cpus)))
    times: dict[str, float] = {}
    extra: dict[str, object] = {}

    def run(name, fn):
        t0 = time.time()
        df = fn()
        if df is not None:
            df.write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)

    d = FX.load(spark, sf_dir)
    corpus_box = {}

    def build():
        # the same prepared corpus the registered queries reuse
        corpus_box["c"] = Q.corpus_for(spark, sf_dir)
        return None

    run("postings_build", build)
    corpus = corpus_box["c"]
    n_docs = corpus.lexical.n_docs
    extra["documents"] = n_docs
    extra["documents_per_sec"] = round(n_docs / max(times["postings_build"], 1e-9), 1)

    run("candidates_topk", lambda: Q.q_candidates_topk(spark, sf_dir))
    run("similarity_tf_top20", lambda: Q.q_similarity_tf(spark, sf_dir))
    run("similarity_embedding_top20", lambda: Q.q_similarity_embedding(spark, sf_dir))

    def one_round():
        out = search(d["queries"], d["query_terms"], corpus=corpus, config=SearchConfig(rounds=1))
        return out.ranked

    run("one_round", one_round)

    box = {}

    def iterative():
        box["out"] = search(d["queries"], d["query_terms"], corpus=corpus)
        return box["out"].ranked

    run("search_iterative", iterative)
    out = box["out"]
    n_q = out.queries.count()
    extra["questions"] = n_q
    extra["rounds_used"] = out.rounds_run
    extra["active_per_round"] = out.active_per_round
    extra["questions_per_sec"] = round(n_q / max(times["search_iterative"], 1e-9), 3)

    run("xml_ingest", lambda: Q.q_xml_papers(spark, sf_dir))
    extra["articles_per_sec"] = round(n_docs / max(times["xml_ingest"], 1e-9), 1)

    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({
        "metric": "total_sec", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": sf, "cpus": int(cpus), "details": extra,
        "spark": {"master": spark.sparkContext.master,
                  "shuffle_partitions": spark.conf.get("spark.sql.shuffle.partitions"),
                  "aqe": spark.conf.get("spark.sql.adaptive.enabled")},
    }))
    spark.stop()


if __name__ == "__main__":
    main()
