"""The driver's entry without the optional part."""

import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent


@pytest.mark.parametrize("missing", ["corpus_pipeline", "barweave.llm", "public_tokenizers", "xxhash", "ahocorasick"])
def test_entry_without_optional_modules(missing):
    code = f"""
import sys, warnings
sys.modules[{missing!r}] = None
with warnings.catch_warnings(record=True) as said:
    warnings.simplefilter("always")
    import __spark_entry__ as e
names = set(e.queries())
assert "c12_rotation_snapshot" in names and len(names) > 200 and not any(n.startswith("op") or n == "pipeline" for n in names)
assert set(e.oracle_sql()) <= names
assert any("no training-data operators" in str(w.message) for w in said)
"""
    run = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert run.returncode == 0, run.stderr[-2000:]
