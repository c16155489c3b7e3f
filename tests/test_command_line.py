"""The command line."""

import pytest

from quorumlake.__main__ import main


def test_commands(spark, tmp_path, capsys):
    assert main(["list"]) == 0 and "union_merge (SQL)" in capsys.readouterr().out
    assert main(["sql", "union_merge"]) == 0 and "distinct l_partkey" in capsys.readouterr().out
    assert main(["sql", "latent_truth"]) == 1
    assert main(["run", "job_poll", "--dir", "/root/testdata/sf0.001", "--out", f"{tmp_path}/out"]) == 0
    assert spark.read.parquet(f"{tmp_path}/out").count() == 10
    with pytest.raises(SystemExit):
        main(["run", "no_such_query", "--dir", "x"])
