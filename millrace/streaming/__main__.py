"""python -m millrace.streaming el|dedup|documents [settings file]: runs a pipeline until it is stopped."""

from __future__ import annotations

import logging
import sys

from pyspark.sql import SparkSession

from millrace.config import DedupApp, ElApp, load
from millrace.streaming.nodes import start_dedup, start_documents, start_el

PIPELINES = {"el": (ElApp, start_el), "dedup": (DedupApp, start_dedup), "documents": (ElApp, start_documents)}


def main(args: list[str]) -> int:
    if not args or args[0] not in PIPELINES:
        print(__doc__, file=sys.stderr)
        return 2
    logging.basicConfig(level=logging.INFO)
    kind, start = PIPELINES[args[0]]
    app = load(kind, file=args[1] if len(args) > 1 else None)
    spark = SparkSession.builder.appName(f"millrace-{args[0]}").getOrCreate()
    query = start(spark, app)
    try:
        query.awaitTermination()
    finally:
        query.stop()
        spark.stop()
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
