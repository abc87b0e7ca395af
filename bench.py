"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

(high: the tenth most frequent on, medium, low).  The index is built once (``index_build``); each query runs twice and the
second time counts.
"""

from __future__ import annotations

import json
import os
import sys
import time

REPO = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, REPO)
os.environ["PYTHONPATH"] = os.pathsep.join(x for x in (REPO, os.environ.get("PYTHONPATH", "")) if x)

from pyspark.sql import DataFrame, SparkSession  # noqa: E402

from quern import queries as engine  # noqa: E402
from quern.operators.filters import And, Filter, Fuzzy, NGramSimilarity, Or, Phrase, Prefix, Term, Terms, Wildcard  # noqa: E402
from quern.operators.scorers import BM25  # noqa: E402
from quern.plans.planner import Search  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
TOP = 100


def categories(index) -> dict[str, Filter]:
    rows = [r.term for r in index.term_dict.filter("field = 'text' AND df > 2").orderBy("df", ascending=False).select("term").collect()]
    high, med, low = rows[10:20], rows[len(rows) // 50 :][:10], rows[len(rows) // 2 :][:10]
    t = lambda w: Term("text", w)
    return {
        "HighTerm": t(high[0]), "MedTerm": t(med[0]), "LowTerm": t(low[0]),
        "HighPhrase": Phrase.of("text", high[0], high[1]), "MedPhrase": Phrase.of("text", high[0], med[0]), "LowPhrase": Phrase.of("text", high[0], low[0]),
        "AndHighHigh": And((t(high[0]), t(high[1]))), "AndHighMed": And((t(high[0]), t(med[0]))), "AndHighLow": And((t(high[0]), t(low[0]))),
        "OrHighHigh": Or((t(high[0]), t(high[1]))), "OrHighMed": Or((t(high[0]), t(med[0]))), "OrHighLow": Or((t(high[0]), t(low[0]))),
        "Prefix3": Prefix("text", med[0][:3], 16), "Wildcard": Wildcard("text", f"{med[1][:2]}%{med[1][-1]}", 16),
        "Or4High": Or(tuple(map(t, high[:4]))), "Or6High4Med2Low": Or(tuple(map(t, high[:6] + med[:4] + low[:2]))), "MinMatch2High2Med": Terms("text", tuple((w, 1.0) for w in high[:2] + med[:2]), 2),
        "Fuzzy1": Fuzzy("text", med[2], 1, max_terms=50), "Fuzzy2": Fuzzy("text", med[2], 2, max_terms=50), "NGram": NGramSimilarity("text", (high[0], high[1], med[0]), 0.6, False),
    }


def done(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    spark = SparkSession.builder.master(f"local[{CPUS}]").appName("bench").config("spark.sql.shuffle.partitions", CPUS).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    took: dict[str, float] = {}

    def timed(name: str, run) -> None:
        began = time.time()
        run()
        took[name] = round(time.time() - began, 3)

    timed("index_build", lambda: engine.documents_index(spark, SF_DIR))
    index = engine.documents_index(spark, SF_DIR)
    for name, f in categories(index).items():
        query = Search(index, BM25(b=0.0))
        for _ in range(2):
            timed(name, lambda f=f, query=query: query.top(f, TOP).collect())
    try:
        from quern.llm.queries import QUERIES
    except ImportError:
        QUERIES = {}
    for name, query in QUERIES.items():
        timed(name, lambda query=query: done(query(spark, SF_DIR)))
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(SF_DIR.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
