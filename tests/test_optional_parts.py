"""The library stands without the optional training-data folder."""

import os
import re
import subprocess
import sys

from conftest import ROOT


def test_nothing_else_imports_the_optional_folder():
    for top, _, names in os.walk(os.path.join(ROOT, "innlytics")):
        if os.path.basename(top) in ("llm", "__pycache__"):
            continue
        for n in names:
            if n.endswith(".py"):
                with open(os.path.join(top, n)) as f:
                    assert not re.search(r"innlytics\.llm|corpus_pipeline", f.read()), n


def test_entry_works_without_the_optional_folder():
    code = (
        "import sys\n"
        "class Gone:\n"
        "    def find_spec(self, name, path=None, target=None):\n"
        "        if name.startswith('innlytics.llm') or name == 'corpus_pipeline':\n"
        "            raise ModuleNotFoundError(name, name='innlytics.llm')\n"
        "sys.meta_path.insert(0, Gone())\n"
        "import __spark_entry__ as e\n"
        "q = e.queries()\n"
        "assert 'r1_occupancy_by_month' in q and not any(k.startswith('op') for k in q)\n"
        "assert set(e.oracle_sql()) <= set(q)\n")
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)
