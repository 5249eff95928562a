"""Path predicates: extension, language, hidden entries, ignore patterns."""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

LANGUAGES = {
    "c": ("c", "h"),
    "cpp": ("cpp", "cc", "cxx", "hpp", "hxx"),
    "go": ("go",),
    "java": ("java",),
    "javascript": ("js", "mjs", "cjs"),
    "php": ("php",),
    "rust": ("rs",),
    "typescript": ("ts", "tsx"),
}


def extension(path: Column) -> Column:
    """Lower-cased, empty where there is none; a bare dotfile has none."""
    return F.translate(F.regexp_extract(path, r"[^/]\.([^./]+)$", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def supported(path: Column, extensions: Iterable[str]) -> Column:
    return extension(path).isin(*(e.lower() for e in extensions))


def language(path: Column) -> Column:
    out = F
    for name, extensions in LANGUAGES.items():
        out = out.when(extension(path).isin(*extensions), name)
    return out.otherwise(F.lit(None).cast("string"))


def language_of(path: str) -> str | None:
    ext = re.search(r"[^/]\.([^./]+)$", path)
    return next((n for n, e in LANGUAGES.items() if ext and ext[1].lower() in e), None)


def hidden(relative_path: Column) -> Column:
    """Whether any entry below the root begins with a dot."""
    return relative_path.rlike(r"(^|/)\.[^/]+")


def _rewritten(pattern: str) -> str:
    """The pattern with its wild cards spelled out as the compatible mode expects."""
    out, i = "", 0
    while i < len(pattern):
        if pattern.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif pattern.startswith("**", i):
            out, i = out + ".*", i + 2
        else:
            ch = pattern[i]
            out += {"*": "[^/]*", "?": "."}.get(ch, "\\" + ch if ch in ".+^$()[]{}|\\" else ch)
            i += 1
    return out


def _strict_regex(pattern: str) -> str:
    return "^" + _rewritten(pattern) + "$"


def has_wild_card(pattern: str) -> bool:
    return "*" in pattern or "?" in pattern


def glob_rule(pattern: str, mode: str = "compat") -> tuple[str, ...]:
    """How a wild card pattern is tested: ('ends', prefix, suffix), ('has', text) or ('regex', r).

    The compatible mode compares literal text only: a rewritten pattern with one
    ``.*`` gives a prefix and a suffix, any other one is searched for without its stars.
    """
    if mode == "strict":
        return ("regex", _strict_regex(pattern))
    parts = _rewritten(pattern).split(".*")
    return ("ends", *parts) if len(parts) == 2 else ("has", pattern.replace("*", ""))


def ignored(path: Column, patterns: Iterable[str], mode: str = "compat") -> Column:
    tests = []
    for p in patterns:
        tests += [path == p, path.startswith(p + "/")]
        if not has_wild_card(p):
            continue
        kind, *args = glob_rule(p, mode)
        if kind == "ends":
            tests.append(path.startswith(args[0]) & path.endswith(args[1]))
        else:
            tests.append(path.contains(args[0]) if kind == "has" else path.rlike(args[0]))
    return reduce(lambda a, b: a | b, tests, F.lit(False))


def is_ignored(path: str, patterns: Iterable[str], mode: str = "compat") -> bool:
    """The same for one path on the driver."""
    for p in patterns:
        if path == p or path.startswith(p + "/"):
            return True
        if not has_wild_card(p):
            continue
        kind, *args = glob_rule(p, mode)
        by_glob = (
            path.startswith(args[0]) and path.endswith(args[1])
            if kind == "ends"
            else args[0] in path
            if kind == "has"
            else re.search(args[0], path) is not None
        )
        if by_glob:
            return True
    return False
