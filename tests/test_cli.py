import json

import pytest

from leitmotiv.__main__ import main
from test_search import planted


@pytest.mark.parametrize("method", ["hash", "exact", "symbols"])
def test_cli(spark, tmp_path, capsys, method):
    x = planted(n=200, dims=3, w=20, at=(30, 120))
    (tmp_path / "a.csv").write_text("Time,x,y,z\n" + "".join(f"{t}," + ",".join(map(str, row)) + "\n" for t, row in enumerate(x)))
    found = main(["csv", str(tmp_path / "a.csv"), "20", "2", "-K", "4", "-L", "20", "-r", "8", "--segment", "5", "--method", method, "--drop", "Time", "--points", str(tmp_path / "out"), "--log", str(tmp_path / "log")])
    assert (found[0]["a"], found[0]["b"]) == (30, 120) and json.loads(capsys.readouterr().out.splitlines()[-1])["b"] == 120
    assert spark.read.csv(str(tmp_path / "out"), header=True).count() == 2 * 2 * 20 and (tmp_path / "log").exists()
