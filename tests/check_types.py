"""List columns whose type differs between a query and its check SQL."""

import sys
from pathlib import Path

sys.path[:0] = [str(Path(__file__).resolve().parents[1]), str(Path(__file__).resolve().parent)]

from compare import connect  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from quayline.session import build_session  # noqa: E402

NAMES = {"VARCHAR": "string", "INTEGER": "int", "BIGINT": "bigint", "DOUBLE": "double", "DATE": "date",
         "BOOLEAN": "boolean", "TIMESTAMP": "timestamp_ntz"}

FOLDER = "/root/testdata/sf0.001"
spark = build_session("types", "local[8]", spark__sql__shuffle__partitions="4", spark__ui__enabled="false",
                      spark__ui__showConsoleProgress="false")
spark.sparkContext.setLogLevel("ERROR")
con = connect(FOLDER)
checks = entry.oracle_sql()
for key, run in entry.queries().items():
    ours = dict(run(spark, FOLDER).dtypes)
    theirs = {r[0]: NAMES.get(r[1], r[1]) for r in con.execute(f"DESCRIBE {checks[key]}").fetchall()}
    wrong = {c: (ours[c], theirs.get(c)) for c in ours if ours[c] != theirs.get(c)}
    if wrong:
        print(key, wrong, flush=True)
