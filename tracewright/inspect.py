"""python -m tracewright.inspect RAW OUT: canonical rows of a folder of recordings and the seventeen tables on what it holds. Exit status 1 if its integrity fails."""

from __future__ import annotations

import argparse
import sys

from .plans import forensics
from .session import build


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("raw")
    p.add_argument("out")
    a = p.parse_args(args)
    spark = build()
    forensics.run(spark, a.raw, a.out)
    return int(spark.read.parquet(f"{a.out}/artifacts/integrity_report").first()["integrity_status"] == "FAIL")


if __name__ == "__main__":
    sys.exit(main())
