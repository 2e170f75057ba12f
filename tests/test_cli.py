"""The command line runs the jobs and reports the upload contract's exit codes."""

from conftest import SF_SMALL
from wardstat.__main__ import main
from wardstat.sources import files as FS
from wardstat.sources import fixtures as fx


def test_cli_exit_codes_and_outputs(spark, tmp_out, capsys):
    csv = FS.write_csv(fx.admissions(spark, SF_SMALL), f"{tmp_out}/adm.csv")
    assert main(["upload", csv, f"{tmp_out}/gold"]) == 0
    assert "gold_kpis" in capsys.readouterr().out
    assert main(["upload", csv, f"{tmp_out}/gold2", "--require", "patient_id", "discharge_date"]) == 2
    assert main(["upload", f"{tmp_out}/adm.txt", f"{tmp_out}/gold3"]) == 1
    assert main(["rates", csv, "--show", "2"]) == 0
    assert main(["batch", csv, f"{tmp_out}/daily", "--no-train"]) == 0
    assert "disease_frequency" in capsys.readouterr().out
    from wardstat.sources import lake as LK
    lake = LK.write_lake(fx.admissions(spark, SF_SMALL), f"{tmp_out}/lake", fmt="csv")
    for job in ["frequency", "rates", "yearly", "weekend"]:
        assert main(["lines", job, lake, f"{tmp_out}/{job}"]) == 0
    with open(sorted(__import__("glob").glob(f"{tmp_out}/weekend/part-*"))[0]) as fh:
        key, value = fh.readline().rstrip("\n").split("\t")
    assert "|" in key and value.count(",") == 2
    assert main([]) == 1
    assert spark.range(1).count() == 1   # the shared session is still alive
