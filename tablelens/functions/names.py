"""Driver-side helpers over column *names* (never over data)."""

from __future__ import annotations

import itertools
import re

_ALNUM_RUN = re.compile(r"[0-9a-zA-Z]+")


def normalize_name(name: str) -> str:
    """The alphanumeric runs of a name, lower-cased and joined by single underscores."""
    return "_".join(_ALNUM_RUN.findall(name)).lower()


def safe_table_name(name: str) -> str:
    """Clean a (possibly `db.table`) name part by part; empty -> `uploaded`."""
    parts = [normalize_name(p) for p in name.split(".")]
    parts = [p for p in parts if p]
    if not parts:
        return "uploaded"
    return ".".join(parts[-2:])


def tokens(name: str) -> set[str]:
    """The distinct alphanumeric runs of a name, lower-cased."""
    return set(_ALNUM_RUN.findall(name.lower()))


def dedupe_names(names: list[str], sep: str = "_") -> list[str]:
    """Later occurrences of a name get the smallest free number: `c`, `c_1`, `c_2` ..."""
    where: dict[str, list[int]] = {}
    for i, n in enumerate(names):
        where.setdefault(n, []).append(i)
    out, used = list(names), set(names)
    for n, (_, *repeats) in where.items():
        free = (f"{n}{sep}{k}" for k in itertools.count(1) if f"{n}{sep}{k}" not in used)
        for i in repeats:
            out[i] = next(free)
            used.add(out[i])
    return out


def quote(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"
