"""Run every registered query against its check SQL: python tests/check_all.py [sf] [key ...]."""

import sys
import time
from pathlib import Path

sys.path[:0] = [str(Path(__file__).resolve().parents[1]), str(Path(__file__).resolve().parent)]

from compare import connect, differences  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from quayline.session import build_session  # noqa: E402


WATCHED = ["CartesianProduct", "BroadcastNestedLoopJoin", "SinglePartition", "BatchEvalPython", "ArrowEvalPython"]


def plan_notes(df) -> str:
    """Operators in the plan that do not spread over tasks."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return " ".join(name for name in WATCHED if name in plan)


def main() -> None:
    scale = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    folder = f"/root/testdata/sf{scale}"
    spark = build_session("check", "local[8]", spark__sql__shuffle__partitions="8",
                          spark__ui__enabled="false", spark__driver__memory="16g",
                          spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    checks = entry.oracle_sql()
    bad = 0
    for key, run in entry.queries().items():
        if sys.argv[2:] and key not in sys.argv[2:]:
            continue
        start, notes = time.time(), ""
        try:
            df = run(spark, folder)
            notes = plan_notes(df)
            verdict = differences(df, con, checks[key]) if key in checks else f"rows only: {df.count()}"
        except Exception as error:
            verdict = f"FAILED {type(error).__name__}: {str(error)[:600]}"
        ok = verdict is None or verdict.startswith("rows only")
        bad += not ok
        print(f"{'ok ' if ok else 'BAD'} {key} {time.time() - start:.2f}s {notes} {verdict or ''}", flush=True)
    print("bad:", bad)


main()
