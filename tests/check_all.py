"""Run all registered queries against their SQL: python tests/check_all.py DIR [name ...]."""

from __future__ import annotations

import sys
import time

sys.path.insert(0, __file__.rsplit("/", 2)[0])

from merchantry.catalog import ORACLES, QUERIES  # noqa: E402
from merchantry.session import build_session  # noqa: E402
from tests.oracle import connect, differences  # noqa: E402


def main(directory: str, names: list[str]) -> int:
    spark = build_session("check", "local[8]", 8, "8g")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(directory)
    failed = 0
    for name in names or list(QUERIES):
        started = time.time()
        try:
            df = QUERIES[name](spark, directory)
            found = differences(df, con, ORACLES[name]) if name in ORACLES else [f"no SQL, {df.count()} rows"]
        except Exception as error:  # report and go on with the rest
            found = [f"{type(error).__name__}: {str(error)[:600]}"]
        failed += bool(found)
        print(f"{'ok  ' if not found else 'FAIL'} {time.time() - started:6.2f}s {name} {' | '.join(found)}", flush=True)
    print(f"{failed} failed of {len(names or QUERIES)}")
    return failed


if __name__ == "__main__":
    sys.exit(bool(main(sys.argv[1], sys.argv[2:])))
