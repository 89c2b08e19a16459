import subprocess
import sys

import __spark_entry__ as entry


def test_all_operators_are_registered():
    names = list(entry.queries())
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 14)) and "pipeline" in names
    assert all(k in names for k in entry.oracle_sql())


def test_nothing_else_imports_the_subpackage():
    code = (
        "import sys, importlib, pathlib, textcluster\n"
        "root = pathlib.Path(textcluster.__file__).parent\n"
        "for f in root.rglob('*.py'):\n"
        "    name = '.'.join(f.relative_to(root.parent).with_suffix('').parts)\n"
        "    name.startswith('textcluster.llm') or importlib.import_module(name.removesuffix('.__init__'))\n"
        "assert not any(m.startswith('textcluster.llm') for m in sys.modules)\n"
    )
    subprocess.run([sys.executable, "-c", code], check=True, timeout=120)
