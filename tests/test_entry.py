import subprocess
import sys

import __spark_entry__ as e


def test_entry(spark):
    assert e.entry(spark).columns == ["qid", "rank", "id", "dist"]


def test_every_sql_has_a_query():
    assert set(e.oracle_sql()) <= set(e.queries())


def test_library_does_not_import_the_training_operators():
    code = "import nearfield.catalog, nearfield.sources, nearfield.session, sys; assert not any('llm' in m for m in sys.modules if m.startswith('nearfield'))"
    subprocess.run([sys.executable, "-c", code], check=True)
