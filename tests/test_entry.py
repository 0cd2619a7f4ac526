"""The entry module stands without the corpus operators and without what they need."""

import subprocess
import sys
from pathlib import Path

HERE = Path(__file__).resolve().parent.parent


def counted(code: str) -> list[int]:
    out = subprocess.run([sys.executable, "-c", code + "\nimport __spark_entry__ as e\nprint(len(e.queries()), len(e.oracle_sql()), sum(n.startswith('op') and n[2].isdigit() or n == 'pipeline' for n in e.queries()))"], cwd=HERE, capture_output=True, text=True, check=True)
    return [int(x) for x in out.stdout.split()]


def test_entry_without_the_corpus_operators():
    gone = counted("import sys; sys.modules['cohortflow.llm'] = None; sys.modules['corpus_pipeline'] = None")
    broken = counted("import sys; sys.modules['public_tokenizers'] = None")
    assert gone[0] == broken[0] > 100 and gone[1] == broken[1] > 90 and gone[2] == broken[2] == 0
