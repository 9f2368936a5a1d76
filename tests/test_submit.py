import pytest

from gaugeworks.submit import main

LINES = [f"{k % 3};BME280;1;0.0;0.0;2024-01-01T00:0{k % 5}:00;1.0;1.0;1.0;{k}.0;50.0,{k}" for k in range(30)]


@pytest.mark.parametrize("arguments", [[], ["other"], ["windows-file"], ["windows-stream", "in"], ["batches", "in", "--size", "x"]])
def test_wrong_arguments_end_with_usage(arguments, capsys):
    with pytest.raises(SystemExit) as end:
        main(arguments)
    assert end.value.code == 2
    assert "usage: gaugeworks" in capsys.readouterr().err


def test_jobs_from_arguments(spark, tmp_path):
    at = lambda name: str(tmp_path / name)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("\n".join(["sensor_id;h", *LINES]) + "\n")
    main(["windows-file", at("in"), "--sink", at("out")])
    results = spark.read.text(at("out"))
    assert results.count() == 15
    with pytest.raises(Exception, match="(?i)exists"):
        main(["windows-file", at("in"), "--sink", at("out")])
    main(["windows-stream", at("in"), at("live"), at("state"), "--once", "--max-bytes", "1000000"])
    live = {r.value for r in spark.read.text(at("live")).collect()}
    assert 0 < len(live) < 15 and live <= {r.value for r in results.collect()}
    main(["latency-log", at("out"), at("log")])
    main(["latency-report", at("log"), at("report")])
    assert spark.read.parquet(at("report/series")).count() == 15
    assert spark.read.parquet(at("report/summary")).first().tuples == 15
    main(["batches", at("in"), "--size", "7", "--sink", at("batches"), "--kind", "bme280"])
    assert spark.read.parquet(at("batches")).count() == 5
