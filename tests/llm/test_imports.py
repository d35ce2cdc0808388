"""The rest does without this subpackage."""

import re
from pathlib import Path

ROOT = Path(__file__).resolve().parents[2]


def test_nothing_else_imports_it():
    for path in [*ROOT.glob("tessella/**/*.py"), ROOT / "bench.py", *ROOT.glob("tests/*.py")]:
        if "llm" not in path.parts:
            assert not re.search(r"(import|from)\s+[\w.]*\bllm\b|corpus_pipeline", path.read_text()), path
