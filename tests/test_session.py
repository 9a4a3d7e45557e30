"""Shared folders: none of this machine's on a cluster, and what was written there goes."""

import os
import subprocess
import sys

import pytest

from sievework import session


def test_no_local_folder_on_a_cluster():
    assert session.own_folder("local[4]")
    for master in ("spark://host:7077", "yarn", "k8s://https://host"):
        with pytest.raises(RuntimeError):
            session.own_folder(master)


def test_stored_rows_and_removal(spark):
    df = session.stored(spark.range(10).selectExpr("id", "struct(id as a, cast(null as string) as `b c`) as s"))
    assert df.where("s.a > 4").count() == 5 and df.where("s.`b c` is null").count() == 10
    at = os.path.dirname(df.inputFiles()[0]).removeprefix("file://").removeprefix("file:")
    assert os.path.isdir(at)
    session.remove_folder(spark, at)
    assert not os.path.exists(at)


def test_entry_without_a_library():
    """A library that only the training-data operators need is missing: all other queries stay."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = "import sys; sys.modules['zstandard'] = None; import __spark_entry__ as e; q = e.queries(); assert 'compact_all' in q and not any(n.startswith('op') for n in q)"
    subprocess.run([sys.executable, "-W", "ignore", "-c", code], cwd=root, check=True, timeout=120)
