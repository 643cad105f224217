import logging

import pytest

from geoview.util import TimeTracker, incomplete, step


def test_steps(caplog):
    log = logging.getLogger("steps")
    with caplog.at_level(logging.INFO):
        with step(log, "one"):
            pass
        with pytest.raises(ValueError), step(log, "two"):
            raise ValueError
    assert "one took" in caplog.text and "two failed" in caplog.text


def test_tracker_and_marks():
    t = TimeTracker()
    for _ in range(2):
        with t.track("a"):
            pass
    assert list(t.times) == ["a"] and t.total >= 0
    with pytest.warns(UserWarning, match="no distortion"):
        assert incomplete("no distortion")(lambda x: x)(3) == 3
