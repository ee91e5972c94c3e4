import os
import subprocess
import sys

import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"


def test_every_query_with_sql_is_registered():
    q, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(q) and len(q) > 100


def test_core_does_not_need_the_text_operators():
    code = "import sys; sys.modules['tessella.llm'] = None; import __spark_entry__ as e; assert not [n for n in e.queries() if n.startswith(('p1_', 'p7_', 'p8_', 'p9_'))] and 'p2_found' in e.queries()"
    root = os.path.dirname(os.path.abspath(entry.__file__))
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True)
    for folder, _, files in os.walk(os.path.join(root, "tessella")):
        if not folder.endswith("llm"):
            for f in files:
                if f.endswith(".py"):
                    assert "tessella.llm" not in open(os.path.join(folder, f)).read()


def test_flagship(spark):
    if os.path.isdir(SMALL):
        assert entry.entry(spark).count() > 0
