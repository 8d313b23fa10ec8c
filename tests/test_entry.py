import os
import shutil
import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parent.parent


def test_entry(spark):
    import __spark_entry__ as e

    out = e.entry(spark)
    assert out.count() > 0 and "chunk_id" in out.columns
    assert set(e.oracle_sql()) <= set(e.queries())


def test_library_stands_without_the_training_data_operators(tmp_path):
    """In a copy without them everything imports, and queries and tests run."""
    shutil.copytree(REPO, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__", ".pytest_cache"))
    code = "import __spark_entry__ as e; names = e.queries(); assert 'chunk_documents' in names and not any(n.startswith('op') and n[2].isdigit() for n in names); print(len(names))"
    run = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path / "r", capture_output=True, text=True, timeout=60)
    assert run.returncode == 0, run.stderr
    assert int(run.stdout.split()[-1]) > 100
    some = "test_entry.py::test_entry", "test_pairs.py", "test_queries.py::test_query[error_codes]", "test_queries.py::test_query[chunk_coverage]"
    run = subprocess.run([sys.executable, "-B", "-m", "pytest", "-q", "-x", "-p", "no:cacheprovider", *[f"tests/{t}" for t in some]], cwd=tmp_path / "r", capture_output=True, text=True, timeout=300)
    assert run.returncode == 0, run.stdout[-3000:]


def test_a_missing_library_leaves_the_other_queries(tmp_path):
    """Where a library of the training-data operators can't be imported, the rest stands."""
    (tmp_path / "xxhash.py").write_text("raise ImportError('not there')")
    code = "import __spark_entry__ as e; print(len(e.queries()), 'op1_simhash' in e.queries())"
    run = subprocess.run([sys.executable, "-B", "-c", code], cwd=REPO, capture_output=True, text=True, timeout=60, env={**os.environ, "PYTHONPATH": f"{tmp_path}:{REPO}"})
    assert run.returncode == 0 and run.stdout.split()[-1] == "False", run.stderr
