import os
import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parent.parent
CODE = """
import sys
sys.path.insert(0, {repo!r})
from tallyloom.operators import invindex
from tallyloom.session import local_session
spark = local_session(2, 2)
index = spark.createDataFrame([("a", 1, 2)], "term string, docno bigint, tf bigint")
print(invindex.decompressed(invindex.compressed(index)).collect())
"""


def test_workers_need_no_path(tmp_path):
    """Python workers run this package's code even if only the driver has it on its path."""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", CODE.format(repo=str(REPO))], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "Row(term='a', docno=1, tf=2)" in done.stdout, done.stderr[-2000:]
