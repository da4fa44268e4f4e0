"""The entry module with and without the training-data subpackage."""

import os
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SAY = "import __spark_entry__ as e; print(*sorted(e.queries())); assert set(e.oracle_sql()) <= set(e.queries())"


def names(folder, expect=0):
    run = subprocess.run([sys.executable, "-B", "-c", SAY], cwd=folder, env=os.environ | {"PYTHONPATH": str(folder)}, capture_output=True, text=True, timeout=120)
    assert (run.returncode == 0) == (expect == 0), run.stderr
    return run.stdout.split() if expect == 0 else run.stderr


def test_the_rest_works_without_the_subpackage(tmp_path):
    for part in ("sievework", "__spark_entry__.py", "corpus_pipeline.py"):
        source = os.path.join(ROOT, part)
        if os.path.isdir(source):
            shutil.copytree(source, tmp_path / part, ignore=shutil.ignore_patterns("__pycache__"))
        elif os.path.exists(source):
            shutil.copy(source, tmp_path / part)
    whole = names(tmp_path)
    if "pipeline" in whole:
        assert sum(n.startswith("op") for n in whole) == 13
        broken = tmp_path / "sievework" / "llm" / "common.py"
        broken.write_text("import a_module_that_is_not_there\n" + broken.read_text().replace("from __future__ import annotations", ""))
        assert "a_module_that_is_not_there" in names(tmp_path, expect=1)  # what fails within it is no absence
        shutil.rmtree(tmp_path / "sievework" / "llm")
        os.remove(tmp_path / "corpus_pipeline.py")
    rest = names(tmp_path)
    assert len(rest) > 80 and not any(n.startswith("op") or n == "pipeline" for n in rest)
