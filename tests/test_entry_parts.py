"""queries() without the optional subpackage, and without the Spark jars on disk."""

import os
import shutil
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
CODE = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), [k for k in e.queries() if k.startswith('op') or k == 'pipeline'])"


def run(cwd, code=CODE):
    return subprocess.run([sys.executable, "-B", "-c", code], cwd=cwd, env=os.environ | {"PYTHONPATH": str(cwd)},
                          capture_output=True, text=True, timeout=120)


def test_import_without_llm(tmp_path):
    shutil.copy(f"{REPO}/__spark_entry__.py", tmp_path)
    shutil.copytree(f"{REPO}/shopfloor", tmp_path / "shopfloor", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    done = run(tmp_path)
    assert done.returncode == 0, done.stderr
    assert done.stdout.strip().endswith("[]") and int(done.stdout.split()[0]) > 100


def test_import_reads_no_jar():
    code = "import glob, zipfile\nglob.glob = lambda *a, **k: []\nzipfile.ZipFile = None\n" + CODE
    done = run(REPO, code)
    assert done.returncode == 0, done.stderr
    assert int(done.stdout.split()[0]) > 100
