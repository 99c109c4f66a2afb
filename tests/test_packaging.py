"""What runs inside tasks must not need this package there."""

import subprocess
import sys

from pyspark import cloudpickle

from quotelake.streaming.pattern_state import OpenStart


def test_processor_is_pickled_with_its_code(tmp_path):
    path = tmp_path / "processor.pkl"
    path.write_bytes(cloudpickle.dumps(OpenStart()))
    code = ("import pickle, sys; p = pickle.load(open(sys.argv[1], 'rb')); "
            "assert 'quotelake' not in sys.modules; print(p.start)")
    done = subprocess.run([sys.executable, "-c", code, str(path)], cwd=tmp_path, capture_output=True, text=True, timeout=60)
    assert done.returncode == 0, done.stderr
    assert done.stdout.strip() == "0.7"
