import subprocess
import sys

from pyspark import cloudpickle

from loadspark.operators.capacity import _pool_pools, _pool_rows
from loadspark.operators.models import _add_sums
from loadspark.operators.rolling import Roll, _roll_block


def test_worker_functions_need_no_package(tmp_path):
    """Executors have no copy of this package: what runs there must unpickle without it."""
    parts = [_pool_rows, _pool_pools, _add_sums, _roll_block([Roll("x", "y")], 3, 1, 0, ["_idx"])]
    code = "import sys, pickle; [pickle.loads(p) for p in pickle.load(sys.stdin.buffer)]; assert 'loadspark' not in sys.modules"
    payload = cloudpickle.dumps([cloudpickle.dumps(p) for p in parts])
    done = subprocess.run([sys.executable, "-c", code], input=payload, cwd=tmp_path, capture_output=True, timeout=60)
    assert done.returncode == 0, done.stderr.decode()[-500:]
