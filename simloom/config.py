"""Settings: defaults, TOML file, environment, keyword arguments; later ones win."""

from __future__ import annotations

import logging
import os
import tomllib
from collections.abc import Mapping
from dataclasses import dataclass, fields, replace
from pathlib import Path

from simloom.errors import ConfigError, RangeError

log = logging.getLogger("simloom")

ENV_PREFIX = "SIMLOOM_"
FILE_NAME = "simloom.toml"
# What marks a project root, where the search for a file stops; extensions scanned.
PROJECT_MARKERS = (".git", "Cargo.toml", "package.json", "pom.xml", "go.mod", "Gemfile", "pyproject.toml", "setup.py", "composer.json")
EXTENSIONS = ("c", "cpp", "cc", "cxx", "hpp", "h", "hxx", "go", "java", "js", "mjs", "cjs", "php", "rs", "ts", "tsx")
FORMATS = ("human", "json", "sarif")
COLORS = ("auto", "always", "never")
TRUE_WORDS = {"1", "true", "yes"}

TEMPLATE = """\
# Settings of the duplicate scan. Command line and environment override them.

# Least similarity that is reported, 0.0 to 1.0 (-t takes percent).
threshold = 0.90

# What to scan where the command line names nothing.
paths = ["src"]

# Least number of tokens of a block.
min_block_tokens = 3

# Path patterns that are left out.
ignore = ["vendor/**", "build/**", "**/build/**", "third_party/**", "target/**", "node_modules/**"]

# Duplicates within one file.
check_intra_file = true

# human, json or sarif.
output_format = "human"

# Extensions of the files that are scanned.
extensions = ["c", "cpp", "cc", "cxx", "hpp", "h", "hxx", "go", "java", "js", "mjs", "cjs", "php", "rs", "ts", "tsx"]

# Largest file in bytes.
max_file_size = 1048576

# Worker threads of a local session; 0 takes all.
jobs = 0

# How much frequent tokens are held down, 0.0 to 10.0; 0 is the plain cosine.
frequency_penalty = 2.0

# Match renamed identifiers through a synonym dictionary.
fuzzy_identifiers = false
fuzzy_identifier_threshold = 0.6

# Colour of the text report: auto, always or never.
color = "auto"

# Only the findings, no head line and summary.
quiet = false
"""


def checked_threshold(value: float) -> float:
    value = float(value)
    if not 0.0 <= value <= 1.0:
        raise RangeError(f"threshold must lie between 0.0 and 1.0, not {value}")
    return value


def checked_penalty(value: float) -> float:
    value = float(value)
    if not 0.0 <= value <= 10.0:
        raise RangeError(f"frequency penalty must lie between 0.0 and 10.0, not {value}")
    return value


@dataclass(frozen=True)
class Settings:
    """One scan's settings. ``min_block_tokens`` also goes by ``min_block_lines``."""

    paths: tuple[str, ...] = ()
    threshold: float = 0.85
    min_block_tokens: int = 3
    ignore: tuple[str, ...] = ()
    check_intra_file: bool = True
    output_format: str = "human"
    extensions: tuple[str, ...] = EXTENSIONS
    max_file_size: int = 1_048_576
    jobs: int | None = None
    frequency_penalty: float = 2.0
    fuzzy_identifiers: bool = False
    fuzzy_identifier_threshold: float = 0.6
    color: str = "auto"
    quiet: bool = False
    glob_mode: str = "compat"
    simhash_max_distance: int | None = 10
    intra_file_extension: bool = False

    def __post_init__(self):
        checked_threshold(self.threshold)
        checked_penalty(self.frequency_penalty)
        if self.output_format not in FORMATS:
            raise RangeError(f"output format must be one of {', '.join(FORMATS)}, not {self.output_format}")
        if self.color.lower() not in COLORS:
            raise RangeError(f"color must be one of {', '.join(COLORS)}, not {self.color}")

    def with_values(self, values: Mapping) -> Settings:
        """A copy with the given values; None leaves a setting as it is."""
        known = {f.name for f in fields(self)}
        new = {}
        for key, value in values.items():
            key = "min_block_tokens" if key == "min_block_lines" else key
            if key not in known:
                raise ConfigError(f"unknown setting: {key}")
            if value is None:
                continue
            new[key] = tuple(value) if isinstance(value, (list, tuple)) else value.lower() if key == "color" else value
        return replace(self, **new)


def read_file(path: str | Path) -> dict:
    try:
        return tomllib.loads(Path(path).read_text("utf-8"))
    except (OSError, UnicodeDecodeError, tomllib.TOMLDecodeError) as e:
        raise ConfigError(f"{path}: {e}") from e


def discover_file(start: str | Path = ".") -> Path | None:
    """The nearest file in an ancestor up to the project root, or in the home folders."""
    here = Path(start).resolve()
    for folder in (here, *here.parents):
        if (folder / FILE_NAME).is_file():
            return folder / FILE_NAME
        if any((folder / m).exists() for m in PROJECT_MARKERS):
            break
    for path in (Path.home() / ".config/simloom/config.toml", Path.home() / f".{FILE_NAME}"):
        if path.is_file():
            return path
    return None


def env_values(env: Mapping[str, str]) -> dict:
    """Settings from the environment; those that cannot be read are skipped with a warning."""
    truth = lambda s: s.strip().lower() in TRUE_WORDS
    readers = {
        "THRESHOLD": ("threshold", lambda s: checked_threshold(float(s) / 100)),
        "MIN_LINES": ("min_block_tokens", int),
        "OUTPUT_FORMAT": ("output_format", lambda s: FORMATS[FORMATS.index(s.lower())]),
        "JOBS": ("jobs", int),
        "FREQUENCY_PENALTY": ("frequency_penalty", lambda s: checked_penalty(float(s))),
        "FUZZY_IDENTIFIERS": ("fuzzy_identifiers", truth),
        "FUZZY_THRESHOLD": ("fuzzy_identifier_threshold", float),
        "COLOR": ("color", lambda s: COLORS[COLORS.index(s.lower())]),
        "QUIET": ("quiet", truth),
    }
    out = {}
    for name, (key, read) in readers.items():
        if (raw := env.get(ENV_PREFIX + name)) is not None:
            try:
                out[key] = read(raw)
            except ValueError:
                log.warning("%s%s=%r is ignored", ENV_PREFIX, name, raw)
    return out


def load_settings(arguments: Mapping | None = None, config_path: str | None = None, env: Mapping[str, str] | None = None, start: str = ".") -> Settings:
    """Defaults, then file, then environment, then arguments.

    A file that was named must be good; one that was found is skipped with a
    warning where it is not.
    """
    settings = Settings()
    if config_path is not None:
        settings = settings.with_values(read_file(config_path))
    elif (found := discover_file(start)) is not None:
        try:
            settings = settings.with_values(read_file(found))
        except (ConfigError, RangeError, TypeError) as e:
            log.warning("%s is ignored: %s", found, e)
    settings = settings.with_values(env_values(os.environ if env is None else env))
    return settings.with_values(arguments or {})


def write_template(path: str | Path = FILE_NAME) -> None:
    Path(path).write_text(TEMPLATE, "utf-8")
