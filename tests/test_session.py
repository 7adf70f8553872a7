import tempfile

import pytest

from strandline.scratch import scratch_dir, stored
from strandline.session import SETTINGS, build_session


def test_settings_are_in_force(spark):
    for name, value in SETTINGS.items():
        if name.startswith("spark.sql."):
            assert spark.conf.get(name) == value
    assert build_session() is spark


def test_scratch_goes_below_the_checkpoint_folder(spark):
    base = spark.conf.get("spark.checkpoint.dir", None)
    path = scratch_dir(spark, "x")
    assert path.startswith(base or tempfile.gettempdir())
    assert path != scratch_dir(spark, "x")
    assert stored(spark.range(3), "x").count() == 3


class OnMaster:
    """As much of a session as a scratch folder needs, without a checkpoint folder."""

    def __init__(self, master):
        self.sparkContext = type("Context", (), {"master": master})
        self.conf = type("Conf", (), {"get": staticmethod(lambda name, default: default)})


@pytest.mark.parametrize("master", ["yarn", "spark://host:7077", "local-cluster[2,1,1024]", "k8s://host"])
def test_no_local_scratch_on_a_cluster(master):
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch_dir(OnMaster(master), "x")


@pytest.mark.parametrize("master", ["local", "local[4]", "local[*]"])
def test_a_local_master_gets_local_scratch(master):
    assert scratch_dir(OnMaster(master), "x").startswith(tempfile.gettempdir())
