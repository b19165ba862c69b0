"""The library without the corpus operators."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
CODE = """
import __spark_entry__ as driver
from balance_spark.verify.queries import QUERIES
assert set(driver.queries()) == set(QUERIES), set(driver.queries()) ^ set(QUERIES)
assert set(driver.oracle_sql()) <= set(QUERIES)
"""


def test_entry_points_without_the_corpus_operators(tmp_path):
    """With or without ``corpus_pipeline.py`` beside it."""
    for kept in (["__spark_entry__.py"], ["__spark_entry__.py", "corpus_pipeline.py"]):
        folder = tmp_path / str(len(kept))
        for file in ROOT.glob("balance_spark/**/*.py"):
            if "llm" not in file.relative_to(ROOT).parts:
                copy = folder / file.relative_to(ROOT)
                copy.parent.mkdir(parents=True, exist_ok=True)
                copy.write_text(file.read_text())
        for name in kept:
            if (ROOT / name).exists():
                (folder / name).write_text((ROOT / name).read_text())
        ran = subprocess.run([sys.executable, "-c", CODE], cwd=folder, capture_output=True, text=True)
        assert ran.returncode == 0, ran.stderr
