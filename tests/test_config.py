import logging

import pytest

from simloom.config import FILE_NAME, Settings, env_values, load_settings, write_template
from simloom.errors import ConfigError, RangeError


def test_defaults():
    s = Settings()
    assert (s.threshold, s.min_block_tokens, s.frequency_penalty, s.max_file_size) == (0.85, 3, 2.0, 1_048_576)
    assert len(s.extensions) == 16


def test_precedence(tmp_path):
    (tmp_path / FILE_NAME).write_text("threshold = 0.5\nmin_block_lines = 9\nfrequency_penalty = 1.0\n")
    s = load_settings({"frequency_penalty": 4.0}, env={"SIMLOOM_THRESHOLD": "70"}, start=str(tmp_path))
    assert (s.threshold, s.min_block_tokens, s.frequency_penalty) == (0.7, 9, 4.0)


def test_bad_files(tmp_path, caplog):
    (tmp_path / FILE_NAME).write_text("threshold = ")
    with caplog.at_level(logging.WARNING):
        assert load_settings(env={}, start=str(tmp_path)).threshold == 0.85
    assert "ignored" in caplog.text
    with pytest.raises(ConfigError):
        load_settings(env={}, config_path=str(tmp_path / FILE_NAME))


def test_search_stops_at_a_project_root(tmp_path):
    (tmp_path / FILE_NAME).write_text("threshold = 0.5\n")
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "setup.py").write_text("")
    assert load_settings(env={}, start=str(tmp_path / "p")).threshold == 0.85


def test_ranges_and_environment():
    with pytest.raises(RangeError):
        Settings(threshold=1.01)
    with pytest.raises(ValueError):
        Settings(frequency_penalty=10.5)
    assert env_values({"SIMLOOM_THRESHOLD": "170", "SIMLOOM_QUIET": "yes", "SIMLOOM_JOBS": "x"}) == {"quiet": True}
    assert Settings().with_values({"color": "ALWAYS"}).color == "always"


def test_template_is_readable(tmp_path):
    write_template(tmp_path / FILE_NAME)
    assert load_settings(env={}, config_path=str(tmp_path / FILE_NAME)).threshold == 0.9
