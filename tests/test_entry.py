"""The driver contract."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_works_without_the_text_subpackage():
    code = "import sys; sys.modules['voxelweave.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert len(q) > 90 and not any(k.startswith('op') and k[2].isdigit() for k in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)


def test_entry_query(spark):
    from voxelweave.plans import registry

    rows = registry.queries()["dedup_merge"](spark, "/root/testdata/sf0.001").collect()
    assert rows and set(registry.oracle_sql()) <= set(registry.queries())
