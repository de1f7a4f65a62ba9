"""Rules that the operators keep at any size."""

from __future__ import annotations

import ast
from pathlib import Path

ROOT = Path(__file__).resolve().parents[2]


def test_nothing_else_imports_the_subpackage():
    for path in [*ROOT.glob("skylattice/**/*.py"), *ROOT.glob("tests/*.py")]:
        if "llm" not in path.parts:
            for node in ast.walk(ast.parse(path.read_text())):
                names = [node.module or ""] if isinstance(node, ast.ImportFrom) else [a.name for a in node.names] if isinstance(node, ast.Import) else []
                assert not any("skylattice.llm" in n or n == "corpus_pipeline" for n in names), path


def test_no_local_checkpoints_and_native_line_dedup():
    for path in [*ROOT.glob("skylattice/**/*.py"), ROOT / "corpus_pipeline.py"]:
        assert "localCheckpoint(" not in path.read_text()
    native = (ROOT / "skylattice/llm/line_dedup.py").read_text()
    assert not any(x in native for x in ("pandas", "pyarrow", "udf", ".rdd", "mapIn"))
