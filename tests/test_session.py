"""The checkpoint folder: read from the session, local fallback only in local mode."""

import pytest

from wardbook import session


class _Conf:
    def __init__(self, value=None, settable=True):
        self.value, self.settable = value, settable

    def get(self, key, default=None):
        return self.value if self.value is not None else default

    def set(self, key, value):
        if not self.settable:
            raise RuntimeError("read-only")
        self.value = value


class _Ctx:
    def __init__(self, master, conf_value=None):
        self.master, self.applicationId, self._dir = master, f"app-{master}-{conf_value}", None
        self._conf = _Conf(conf_value)

    def getConf(self):
        return self._conf

    def getCheckpointDir(self):
        return self._dir

    def setCheckpointDir(self, d):
        self._dir = d


class _Session:
    def __init__(self, master, value=None, settable=True):
        self.conf = _Conf(value, settable)
        self.sparkContext = _Ctx(master)


def test_cluster_setting_is_used():
    s = _Session("yarn", value="hdfs://shared/ckpt")
    assert session.checkpoint_root(s) == "hdfs://shared/ckpt"
    assert s.sparkContext.getCheckpointDir() == "hdfs://shared/ckpt"


def test_cluster_without_setting_is_refused():
    with pytest.raises(ValueError):
        session.checkpoint_root(_Session("spark://host:7077"))


def test_local_fallback_is_stable_even_if_conf_is_read_only():
    s = _Session("local[2]", settable=False)
    first = session.checkpoint_root(s)
    assert first == session.checkpoint_root(s)
    assert session.scratch_path(s, "x").startswith(first + "/x-")


def test_submitted_settings_are_left_alone(tmp_path):
    """A session built under submit arguments keeps them; gaps are filled."""
    import os
    import subprocess
    import sys
    code = ("from wardbook.session import get_spark\n"
            "s = get_spark('local[2]')\n"
            "print('GOT', s.conf.get('spark.sql.shuffle.partitions'), s.conf.get('spark.sql.autoBroadcastJoinThreshold'),"
            " s.sparkContext.getConf().get('spark.driver.memory'), s.conf.get('spark.sql.adaptive.forceOptimizeSkewedJoin'))")
    env = os.environ | {"PYSPARK_SUBMIT_ARGS": "--conf spark.sql.shuffle.partitions=500 --conf spark.sql.autoBroadcastJoinThreshold=-1 --driver-memory 1g --conf spark.ui.enabled=false pyspark-shell",
                        "PYTHONPATH": os.path.dirname(os.path.dirname(os.path.abspath(__file__)))}
    env.pop("PYSPARK_GATEWAY_PORT", None)
    out = subprocess.run([sys.executable, "-c", code], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=120).stdout
    assert "GOT 500 -1 1g true" in out, out
