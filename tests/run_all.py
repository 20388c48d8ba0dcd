"""Run every registered query against its SQL: ``python tests/run_all.py [sf_dir] [name part]``."""

import sys
import time
from pathlib import Path

sys.path[:0] = [str(Path(__file__).parent.parent), str(Path(__file__).parent)]

from conftest import make_session  # noqa: E402
from oracle import connect, differences  # noqa: E402

import __spark_entry__ as contract  # noqa: E402


def main(sf_dir: str, part: str) -> int:
    spark, db, bad = make_session(), connect(sf_dir), 0
    oracles = contract.oracle_sql()
    for name, run in contract.queries().items():
        if part not in name:
            continue
        start = time.time()
        try:
            df = run(spark, sf_dir)
            said = differences(df, db, oracles[name]) if name in oracles else f"rows only: {df.count()}"
        except Exception as error:  # report and go on
            said = f"{type(error).__name__}: {str(error)[:600]}"
        ok = said is None or said.startswith("rows only")
        bad += not ok
        print(f"{'ok ' if ok else 'BAD'} {name} {time.time() - start:.1f}s {said or ''}", flush=True)
    return bad


if __name__ == "__main__":
    sys.exit(main(sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01", sys.argv[2] if len(sys.argv) > 2 else ""))
