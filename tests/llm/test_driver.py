"""What the driver loads."""

import subprocess
import sys


def test_registering_the_queries_loads_no_pandas():
    code = "import __spark_entry__ as e, sys; e.queries(); sys.exit('pandas' in sys.modules)"
    assert subprocess.run([sys.executable, "-c", code], cwd=__file__.rpartition("/tests/")[0]).returncode == 0
