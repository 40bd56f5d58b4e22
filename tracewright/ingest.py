"""python -m tracewright.ingest RAW OUT: raw recordings to canonical Parquet and artifact tables. Exit status 1 if groups leak between splits or nothing was read."""

from __future__ import annotations

import argparse
import sys

from .plans import views
from .session import build
from .sources import raw, sinks


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("raw")
    p.add_argument("out")
    p.add_argument("--glob", default="*.csv")
    a = p.parse_args(args)
    spark = build()
    sinks.write_canonical(raw.canonical(spark, a.raw, a.glob), f"{a.out}/canonical")
    rows = raw.load_segments(spark, f"{a.out}/canonical")
    made = views.ingest_views(rows)
    sinks.write_views(made, f"{a.out}/artifacts")
    return int(rows.isEmpty() or not spark.read.parquet(f"{a.out}/artifacts/leakage").isEmpty())


if __name__ == "__main__":
    sys.exit(main())
