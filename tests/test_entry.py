"""The registry, and that the engine stands without the training-data operators."""

import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
SF = Path("/root/testdata/sf0.001")


def test_registry():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_stands_alone(tmp_path):
    code = (
        "import sys\nclass Block:\n    def find_spec(self, name, path=None, target=None):\n        if name == 'corpus_pipeline' or name.startswith('threadmill.llm'):\n            raise ImportError(name)\n"
        "sys.meta_path.insert(0, Block())\nimport __spark_entry__ as e\nassert len(e.queries()) > 30 and 'pipeline' not in e.queries()\nassert not any(k.startswith('op') and k[2].isdigit() for k in e.oracle_sql())\n"
    )
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


@pytest.mark.skipif(not SF.exists(), reason="no test tables here")
def test_entry_has_rows(spark):
    import __spark_entry__ as entry

    if str(SF) in Path(entry.__file__).read_text():
        assert entry.entry(spark).count() > 0


@pytest.mark.skipif(not SF.exists(), reason="no test tables here")
def test_queries_agree_with_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    from threadmill import queries, record_queries

    con = duckdb.connect()
    for t in ("documents", "pages", "labels", "conversations", "events", "nation"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    plain = lambda v: round(v, 6) if isinstance(v, float) else v
    order = lambda r: tuple((v is None, str(v)) for v in r)
    known = queries.QUERIES | record_queries.QUERIES
    for name, sql in (queries.ORACLE_SQL | record_queries.ORACLE_SQL).items():
        frame, relation = known[name](spark, str(SF)), con.sql(sql)
        columns = sorted(frame.columns)
        assert columns == sorted(relation.columns), name
        got = sorted((tuple(map(plain, r)) for r in frame.select(columns).collect()), key=order)
        want = sorted((tuple(plain(r[relation.columns.index(c)]) for c in columns) for r in relation.fetchall()), key=order)
        assert got == want, name
    assert set(known) == set(queries.ORACLE_SQL | record_queries.ORACLE_SQL)


def test_only_missing_parts_are_left_out(tmp_path):
    """A part that is there but fails to import is an error."""
    code = "import sys\nclass Block:\n    def find_spec(self, name, path=None, target=None):\n        if name == 'xxhash':\n            raise ModuleNotFoundError(name, name=name)\nsys.meta_path.insert(0, Block())\nimport __spark_entry__\n"
    if (ROOT / "threadmill" / "llm").exists():
        assert subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True).returncode
