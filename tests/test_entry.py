import os
import re
import shutil
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_entry_without_the_llm_folders(tmp_path):
    """The rest works when the subpackage, its tests and the pipeline are gone."""
    shutil.copytree(os.path.join(ROOT, "siltstone"), tmp_path / "siltstone", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(ROOT, "__spark_entry__.py"), tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'tpch_q1' in q and not any(n.startswith('op') and n[2:3].isdigit() or n == 'pipeline' for n in q); assert set(e.oracle_sql()) == set(q)"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, check=True)


def test_nothing_else_imports_the_subpackage():
    for d, _, names in os.walk(os.path.join(ROOT, "siltstone")):
        if os.path.basename(d) in ("llm", "__pycache__"):
            continue
        for name in names:
            if name.endswith(".py"):
                with open(os.path.join(d, name)) as f:
                    assert not re.search(r"\bllm\b", f.read()), name
