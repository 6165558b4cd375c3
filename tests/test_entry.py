"""The entry module stands without the optional training-data subpackage."""

import subprocess
import sys
import textwrap
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_entry_without_the_subpackage():
    code = """
        import sys
        class Block:
            def find_spec(self, name, path=None, target=None):
                if name.split(".")[:2] == ["spindle", "llm"] or name == "corpus_pipeline":
                    raise ModuleNotFoundError(f"No module named {name!r}", name=".".join(name.split(".")[:2]))
        sys.meta_path.insert(0, Block())
        import __spark_entry__ as e
        print(len(e.queries()), sum(k.startswith("op") and k[2].isdigit() for k in e.queries()), "enrich_documents" in e.oracle_sql())
    """
    out = subprocess.run([sys.executable, "-c", textwrap.dedent(code)], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    n, numbered, oracle = out.stdout.split()
    assert int(n) >= 45 and numbered == "0" and oracle == "True"
