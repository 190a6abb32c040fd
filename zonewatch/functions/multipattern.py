"""Many texts looked for at once: one pass over each name, however many there are; and which texts a
regular expression can't match without."""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def holding(text: Column, meaning: Mapping[str, Sequence[str]]) -> Column:
    """The meanings of all the texts that this one holds somewhere, each once and in order; none for null.

    `meaning` is part of the program (rules, brands); its automaton is built once a task."""
    if not meaning:
        return F.array().cast("array<string>")
    shared = SparkSession.active().sparkContext.broadcast({k: tuple(v) for k, v in meaning.items()})

    @F.pandas_udf("array<string>")
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import ahocorasick

        machine = ahocorasick.Automaton()
        for part, values in shared.value.items():
            machine.add_word(part, values)
        machine.make_automaton()
        for names in batches:
            yield pd.Series([sorted({v for _, values in machine.iter(x) for v in values}) if x else [] for x in names], dtype=object)

    return find(text)


class _Unknown(Exception):
    """Syntax that isn't read here; such an expression is tried on every name."""


def required(regex: str, least: int = 2) -> frozenset[str] | None:
    """Lower-case texts of at least `least` ASCII characters, one of which stands in the lower-case form of
    whatever the (Java) expression matches; None where it can't be told. Errs on the side of None."""
    if regex.startswith("(?i)"):
        regex = regex[4:]
    try:
        found, at = _alternatives(regex, 0, least)
    except (_Unknown, IndexError):
        return None
    return found if at == len(regex) else None


def _best(choices: list[frozenset[str]]) -> frozenset[str] | None:
    return max(choices, key=lambda c: (min(map(len, c)), -len(c)), default=None)


def _alternatives(regex: str, at: int, least: int) -> tuple[frozenset[str] | None, int]:
    """What one of the alternatives up to the group's end needs, and where that end is."""
    parts, end = [], False
    while not end:
        part, at = _sequence(regex, at, least)
        parts.append(part)
        end = at >= len(regex) or regex[at] == ")"
        at += not end
    return (None if None in parts else frozenset().union(*parts)), at


def _quantifier(regex: str, at: int) -> tuple[str, int]:
    """("", "optional" or "repeated") of what stands before, and where it goes on."""
    if at >= len(regex) or regex[at] not in "?*+{":
        return "", at
    kind = "repeated" if regex[at] == "+" else "optional"
    if regex[at] == "{":
        end = regex.index("}", at) if "}" in regex[at:] else len(regex)
        kind = "optional" if not regex[at + 1:end].split(",")[0].strip("0") else "repeated"
        at = end
    at += 1
    return kind, at + (at < len(regex) and regex[at] in "?+")


def _class_end(regex: str, at: int) -> int:
    """Behind a character class, nested ones too."""
    at += 1 + (regex[at + 1] == "^")
    if regex[at] in "[]&":
        raise _Unknown
    while regex[at] != "]":
        if regex[at] == "[":
            at = _class_end(regex, at)
        else:
            at += 2 if regex[at] == "\\" else 1
    return at + 1


def _sequence(regex: str, at: int, least: int) -> tuple[frozenset[str] | None, int]:
    choices, run = [], ""

    def close() -> None:
        nonlocal run
        if len(run) >= least:
            choices.append(frozenset([run.lower()]))
        run = ""

    while at < len(regex) and regex[at] not in "|)":
        c, group, literal = regex[at], None, ""
        if c in "^$":
            at += 1
            continue
        if c in "?*+{":
            raise _Unknown
        if c == "(":
            at += 1
            if regex[at] == "?":
                name = re.match(r"\?(:|<[A-Za-z][A-Za-z0-9]*>)", regex[at:])
                if not name:
                    raise _Unknown
                at += name.end()
            group, at = _alternatives(regex, at, least)
            if regex[at] != ")":
                raise _Unknown
            at += 1
        elif c == "[":
            at = _class_end(regex, at)
        elif c == "\\":
            c = regex[at + 1]
            at += 2
            if c in "pP":
                at = regex.index("}", at) + 1 if regex[at] == "{" else at + 1
            elif not c.isalnum():
                literal = c
            elif c not in "dDwWsSbBAzZGRhHvV":
                raise _Unknown
        else:
            at += 1
            literal = "" if c == "." else c
        kind, at = _quantifier(regex, at)
        if literal and literal.isascii() and kind != "optional":
            run += literal
            if kind:
                close()
        else:
            close()
            if group and kind != "optional":
                choices.append(group)
    close()
    return _best(choices), at
