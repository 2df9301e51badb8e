"""The entry point without the optional parts, in a fresh interpreter and a copy of the repository."""

import os
import shutil
import subprocess
import sys

import pytest

from tessera.plans import queries as Q

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
LIST = "import __spark_entry__ as E; print(','.join(sorted(E.queries()))); assert set(E.oracle_sql()) <= set(E.queries())"


def _names(folder: str, before: str = "") -> set[str]:
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    got = subprocess.run([sys.executable, "-c", before + LIST], cwd=folder, env=env, capture_output=True, text=True, timeout=300)
    assert got.returncode == 0, got.stderr
    return set(got.stdout.split()[-1].split(","))


@pytest.mark.parametrize("pipeline", [True, False])
def test_entry_without_the_optional_folders(tmp_path, pipeline):
    shutil.copytree(os.path.join(ROOT, "tessera"), tmp_path / "tessera", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ["__spark_entry__.py"] + ["corpus_pipeline.py"] * pipeline:
        if os.path.exists(os.path.join(ROOT, name)):
            shutil.copy(os.path.join(ROOT, name), tmp_path)
    assert _names(str(tmp_path)) == set(Q.REGISTRY)


def test_entry_without_the_tokenizers():
    assert _names(ROOT, "import sys; sys.modules['public_tokenizers'] = None; ") == set(Q.REGISTRY)
