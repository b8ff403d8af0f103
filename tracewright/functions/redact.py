"""Redaction of secrets and terminal controls, as Column expressions."""

from __future__ import annotations

import os
from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, functions as F

from ..fixed import ANY_CONTROL, SECRETS, TERMINAL_CONTROLS
from .kept import built_once


def _let(text: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is computed once, however often ``then`` names it."""
    return F.element_at(F.transform(F.array(text), then), 1)


def _replaced(text: Column, may: Callable[[Column], Column], pattern: str, to: str) -> Column:
    """The pattern's replacement where ``may``, a cheap condition that every match needs, holds."""
    return _let(text, lambda t: F.when(may(t), F.regexp_replace(t, pattern, to)).otherwise(t))


def _holds(*literals: str) -> Callable[[Column], Column]:
    return lambda t: reduce(or_, (t.contains(x) for x in literals))


#: What a match of each of SECRETS must contain, in their order.
_KEYWORD = _holds(*(f(w) for f in (str.lower, str.upper) for w in ("key", "token", "secret", "passw", "authorization", "cookie")))
_NEEDED: list[Callable[[Column], Column]] = [
    _holds("PRIVATE KEY-----"), _holds("Bearer", "bearer", "BEARER"), _holds("Basic", "basic", "BASIC"), _holds("eyJ"),
    _holds("sk-", "github_pat_", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "xox", "npm_", "AIza", "AKIA"),
    lambda t: t.contains('"') & t.contains(":") & _KEYWORD(t), lambda t: t.contains("=") & _KEYWORD(t), lambda t: (t.contains(":") | t.contains("=")) & _KEYWORD(t),
]


def strip_terminal_controls(text: Column) -> Column:
    return _replaced(text, lambda t: t.rlike(ANY_CONTROL), TERMINAL_CONTROLS, "")


def redact_secrets(text: Column) -> Column:
    for (pattern, to), needed in zip(SECRETS, _NEEDED, strict=True):
        text = _replaced(text, needed, pattern, to)
    return text


def elide_home(text: Column, home: str | None = None) -> Column:
    home = os.path.expanduser("~") if home is None else home
    return F.replace(text, F.lit(home), F.lit("~")) if home and home != "~" else text


def redact(text: Column, home: str | None = None) -> Column:
    """Controls first, then secrets in their fixed order, then the home directory."""
    return elide_home(redact_secrets(strip_terminal_controls(text)), home)


@built_once
def redacted(name: str) -> Column:
    """``redact`` of a column by its name."""
    return redact(F.col(name))


def safe_display_path(path: Column, home: str | None = None) -> Column:
    return F.translate(redact(path, home), "\\", "/")


@built_once
def shown_path(name: str) -> Column:
    """``safe_display_path`` of a column by its name."""
    return F.translate(redacted(name), "\\", "/")
