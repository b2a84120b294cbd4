import __spark_entry__ as entry


def test_entry_runs(spark):
    assert entry.entry(spark).count() == 20


def test_sql_names_are_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_import_needs_no_session():
    import subprocess
    import sys

    done = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()) >= len(e.oracle_sql()) > 100)"], capture_output=True, text=True, cwd=entry.__file__.rpartition("/")[0], check=False)
    assert done.stdout.strip().endswith("True"), done.stderr
