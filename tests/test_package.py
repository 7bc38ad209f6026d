"""Rules of the package: what imports what, and what never appears."""

from __future__ import annotations

import ast
import subprocess
import sys
from pathlib import Path

import __spark_entry__

ROOT = Path(__file__).resolve().parent.parent
CORE = [p for p in (ROOT / "tidemark").rglob("*.py") if "llm" not in p.relative_to(ROOT).parts]


def test_core_never_imports_the_training_part():
    for p in CORE:
        for node in ast.walk(ast.parse(p.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any("llm" in n.split(".") for n in names), p


def test_no_local_checkpoints_or_row_loops():
    for p in (ROOT / "tidemark").rglob("*.py"):
        text = p.read_text()
        assert "localCheckpoint" not in text and ".rdd." not in text, p


def test_everything_imports_without_a_session():
    code = "import __spark_entry__ as e, tidemark.sources.readers, tidemark.streaming.streams; q = e.queries(); assert len(q) > 80 and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)


def test_entry(spark):
    df = __spark_entry__.entry(spark)
    assert df.count() > 0 and "fwd_status" in df.columns
