"""The driver's entry: names can be read without Spark, and the flagship query runs."""

import subprocess
import sys

import __spark_entry__
from tests.conftest import ROOT


def test_names_without_spark():
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert len(q) > 50 and set(o) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
