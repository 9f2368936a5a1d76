from types import SimpleNamespace

import pytest

from gaugeworks.session import forget, run_folder, scratch_path, settle, shared_folder


def stub(master, named=None):
    return SimpleNamespace(
        conf=SimpleNamespace(
            get=lambda key, default=None: named if named and key == "spark.checkpoint.dir" else default
        ),
        sparkContext=SimpleNamespace(master=master, applicationId="app"),
    )


def test_the_cluster_names_the_folder():
    assert shared_folder(stub("spark://host:1", "s3a://team/scratch")) == "s3a://team/scratch"
    assert scratch_path(stub("yarn", "hdfs:///x/"), "points").startswith("hdfs:///x/points-")


def test_no_machine_local_folder_on_a_cluster():
    with pytest.raises(RuntimeError):
        shared_folder(stub("yarn"))
    assert shared_folder(stub("local[2]")) == shared_folder(stub("local[2]"))


def test_settled_tables_lie_in_the_shared_folder(spark):
    settled = settle(spark.range(5), "points")
    assert settled.count() == 5
    assert spark.conf.get("spark.checkpoint.dir") in settled.inputFiles()[0]


def test_a_run_leaves_its_folder_empty(spark):
    from pathlib import Path

    from gaugeworks.operators.scans import number_rows

    with run_folder(spark, "numbering") as folder:
        assert number_rows(spark.range(50), "id").count() == 50
        assert list(Path(folder).iterdir())
    assert not Path(folder).exists()
    assert not scratch_path(spark, "x").startswith(folder)


def test_forgotten_tables_are_gone(spark):
    from pathlib import Path

    settled = settle(spark.range(3), "points")
    assert Path(settled.settled_path).exists()
    forget(settled)
    assert not Path(settled.settled_path).exists()
