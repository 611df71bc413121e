"""The entry module's contract."""

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"


def test_names():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 50


def test_flagship(spark):
    assert entry.entry(spark).count() == 5


@pytest.mark.parametrize("name", ["rational_arith", "rescale_near", "interleave_dts", "seek_keyframe", "sample_table", "srt_parse", "adts_header", "image_sizes", "wav_roundtrip"])
def test_against_sql(spark, name):
    import glob

    import duckdb

    db = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        db.execute(f"create view {path.rsplit('/', 1)[1][:-8]} as select * from '{path}'")
    rows = entry.queries()[name](spark, DATA)
    cols = sorted(rows.columns)
    want = db.execute(f"select {', '.join(chr(34) + c + chr(34) for c in cols)} from ({entry.oracle_sql()[name]})").fetchall()
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in rows.select(*cols).collect())


def test_import_needs_no_session():
    """Importing the entry and listing its queries works before a session is there."""
    import subprocess
    import sys

    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    subprocess.run([sys.executable, "-c", code], check=True, capture_output=True, cwd=str(entry.ROOT))
