import os

import pytest

import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SMALL), reason="given tables not present")


def test_every_check_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(entry.queries()) > 60


@needs_data
def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def _compare(spark, name):
    import duckdb

    con = duckdb.connect()
    for table in ("documents", "labels", "conversations", "events", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SMALL}/{table}.parquet'")
    df = entry.queries()[name](spark, SMALL)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(r)) for r in df.select(*columns).collect())
    result = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert got == sorted(repr(tuple(row[i] for i in order)) for row in result.fetchall())


@needs_data
@pytest.mark.parametrize("name", [
    "clean_tokens", "vocabulary", "sentiment_polarity", "turn_valence", "sentiment_trend_minute", "negative_top_words",
    "coherence_window_counts", "confusion_counts", "overlap_report", "last_n_summary", "payload_normalise", "form_body_parse",
    "link_entries", "captured_once", "dedupe_text", "new_messages", "label_encode",
])
def test_results_match_sql(spark, name):
    pytest.importorskip("duckdb")
    _compare(spark, name)


def test_stop_words_equal_the_lists_of_spark_ml(spark):
    from pyspark.ml.feature import StopWordsRemover

    from chatloom.functions import fixed

    assert list(fixed.ENGLISH_STOP_WORDS) == list(StopWordsRemover.loadDefaultStopWords("english"))
    assert list(fixed.TURKISH_STOP_WORDS) == list(StopWordsRemover.loadDefaultStopWords("turkish"))


def test_entry_imports_without_any_jar_or_session(tmp_path):
    import os
    import pathlib
    import subprocess
    import sys

    code = (
        "import pathlib\n"
        "old = pathlib.Path.glob\n"
        "pathlib.Path.glob = lambda self, pattern, *a, **k: iter(()) if 'jar' in str(pattern) else old(self, pattern, *a, **k)\n"
        "import __spark_entry__ as e\n"
        "from pyspark.sql import SparkSession\n"
        "assert SparkSession.getActiveSession() is None\n"
        "print(len(e.queries()), len(e.oracle_sql()))\n"
    )
    repo = pathlib.Path(__file__).resolve().parent.parent
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(repo)},
                          capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr
    queries, sqls = map(int, done.stdout.split())
    assert 0 < sqls <= queries
