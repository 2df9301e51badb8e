"""The command line takes the reference's arguments and prints its report."""

import io
import tempfile
from contextlib import redirect_stdout

from conftest import SF001
from tessera.plans import cli
from tessera.plans.fixtures import PART
from tessera.sources.points import write_points_text


def test_cli_report(spark):
    d = tempfile.mkdtemp(prefix="tessera-cli-")
    write_points_text(PART.load(spark, SF001), d + "/in")
    buf = io.StringIO()
    with redirect_stdout(buf):
        assert cli.main(["local[4]", d + "/in", "4", "20", "3", "2", "--out", d + "/out"], spark=spark) == 0
    text = buf.getvalue()
    assert "result for: " + d + "/in k:3 tau: 20" in text
    assert "ug done, cell count: " in text and "adaptive gridding done, num cells:" in text
    assert "sample size: " in text and "total cost after phase 1:" in text
    assert text.count("total cost after phase 2 iteration:") == 2
    assert spark.read.parquet(d + "/out/centers").count() == 3
