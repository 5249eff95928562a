"""Tokens of prose and the filter that all tokens pass."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words and signs that never count as tokens.
IGNORED_WORDS = (
    "auto const constexpr inline namespace using typedef public private protected class struct enum union virtual "
    "override final mutable static extern void bool char int float double unsigned signed size_t uint8_t uint16_t "
    "uint32_t uint64_t int8_t int16_t int32_t int64_t return if else for while do switch case default break continue "
    "goto try catch throw noexcept nullptr template typename concept requires true false"
).split()
IGNORED_SIGNS = "{ } ( ) [ ] ; : , . < > + - * / % ^ & | ! ~ = += -= *= /= %= ^= &= |= == != <= >= && || ++ -- -> .* ? ::".split()
IGNORED = (*IGNORED_WORDS, *IGNORED_SIGNS)
MIN_BYTES = 2

#: A token of prose.
TEXT_TOKEN = r"[\p{L}_][\p{L}\p{N}_]*"


def keep_token(token: Column, ignored: tuple[str, ...] = IGNORED) -> Column:
    """Two bytes or more, not only ASCII digits, not ignored; case counts."""
    return (F.octet_length(token) >= MIN_BYTES) & ~token.rlike(r"^[0-9]+$") & ~token.isin(*ignored)


def text_tokens(text: Column, ignored: tuple[str, ...] = IGNORED) -> Column:
    """The tokens of a text, in order; of a null none."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TEXT_TOKEN), F.lit(0))
    return F.filter(found, lambda t: keep_token(t, ignored))


def token_allowed(token: str, ignored: frozenset[str] = frozenset(IGNORED)) -> bool:
    """The same filter for the lexer."""
    token = token.strip()
    return len(token.encode()) >= MIN_BYTES and token not in ignored and not (token.isascii() and token.isdigit())
