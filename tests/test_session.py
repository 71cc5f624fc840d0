"""The entry file and the shared folder on bare installations."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def run(code, **env):
    return subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True,
                          env={**os.environ, **env}, timeout=300)


def test_shared_folder_without_settings(tmp_path):
    """A local session whose configuration folder is empty keeps one folder per application."""
    done = run(
        "from palisade import session\n"
        "spark = session.local_session('2')\n"
        "a = session.shared_folder(spark)\n"
        "assert a == session.shared_folder(spark.newSession())\n"
        "assert session.materialize(spark.range(5), 'x').count() == 5\n"
        "print('kept', a == spark.conf.get('spark.checkpoint.dir', a))\n", SPARK_CONF_DIR=str(tmp_path))
    assert "kept True" in done.stdout, done.stderr[-2000:]


def test_entry_without_optional_modules():
    """Without a module that only the document operators need, the other queries stay."""
    done = run(
        "import sys\n"
        "sys.modules['tiktoken'] = None\n"
        "import __spark_entry__ as entry\n"
        "names = entry.queries()\n"
        "assert 'fusion_alerts' in names and 'pipeline' not in names\n"
        "assert not any(n.startswith('op1_') for n in entry.oracle_sql())\n"
        "print('imported')\n")
    assert "imported" in done.stdout, done.stderr[-2000:]
