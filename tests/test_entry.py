"""The driver's contract: the entry imports, every oracle belongs to a query, and queries agree with their SQL."""

import math
import shutil
import subprocess
import sys
from datetime import date, datetime
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
CHECKED = ["b3_classify_gaps", "c8_forward_return", "d7_select_top_n", "e4_turnover", "f4_fifo_match", "g6_asof_return", "h6_concept_series", "i2_canonical_url", "j2_position_greeks", "k1_trailing_returns"]


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else v + 0.0
    if isinstance(v, datetime):
        return v.replace(tzinfo=None).isoformat()
    return v.isoformat() if isinstance(v, date) else v


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    if DATA.exists():
        assert entry.entry(spark).columns


def test_without_the_llm_folders(tmp_path):
    shutil.copytree(ROOT / "marketloom", tmp_path / "marketloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()))"], cwd=tmp_path, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
    assert said.returncode == 0 and int(said.stdout.split()[-1]) > 90, said.stderr


@pytest.mark.skipif(not DATA.exists(), reason="the test tables are not here")
@pytest.mark.parametrize("name", CHECKED)
def test_oracle(spark, name):
    duckdb = pytest.importorskip("duckdb")
    import __spark_entry__ as entry

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    got = entry.queries()[name](spark, str(DATA))
    cursor = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(got.columns)
    want = {tuple(plain(r[names.index(c)]) for c in sorted(names)) for r in cursor.fetchall()}
    assert {tuple(plain(r[c]) for c in sorted(names)) for r in got.collect()} == want
