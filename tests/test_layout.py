"""The subpackage llm can be left out."""

import os
import re
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def sources(skip):
    for folder, _, names in os.walk(os.path.join(ROOT, "sidforge")):
        if skip not in folder.split(os.sep):
            yield from (os.path.join(folder, n) for n in names if n.endswith(".py"))


def test_nothing_imports_llm():
    for path in sources("llm"):
        with open(path, encoding="utf-8") as f:
            assert not re.search(r"^\s*(from|import) sidforge\.llm", f.read(), re.M), path


def test_entry_works_without_llm():
    code = "import sys; sys.modules['sidforge.llm'] = None; import __spark_entry__ as e; assert 'p1_found' in e.queries() and 'p7_ids' not in e.queries()"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


def test_no_local_checkpoints():
    for path in sources("none"):
        with open(path, encoding="utf-8") as f:
            text = f.read()
        assert "localCheckpoint(" not in text and ".crossJoin(" not in text, path
