"""The core works without the subpackage llm, and nothing but the entry names it."""

import re
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]


def test_core_does_not_import_llm():
    for p in (ROOT / "claimloom").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT / "claimloom").parts:
            assert not re.search(r"claimloom\.llm|from \.llm|import llm", p.read_text()), p


def test_entry_without_llm():
    code = "import sys; sys.modules['claimloom.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert 'p2_found' in q and 'p1_found' not in q"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)
