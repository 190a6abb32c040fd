"""Rules from YAML. Everything wrong with them is found here, before any data is read."""

from __future__ import annotations

import re

import yaml
from pyspark.sql import SparkSession

from ..operators.diff import EVENT_TYPES, RESERVED_TYPES
from ..operators.rules import RegexRule, Rule, TypoRule
from ..operators.watchlist import LAYOUTS, METHODS, OPTIONAL_METHODS, Watchlist


class ConfigError(ValueError):
    """A rule file that can't be used, with the rule it fails on."""


def _listed(value) -> list[str]:
    values = [value] if isinstance(value, str) else list(value or [])
    return [str(v).strip() for v in values if str(v).strip()]


def java_pattern(pattern: str, spark: SparkSession | None = None) -> str:
    """The pattern as Spark will run it: named groups in Java's spelling; compiled by both engines."""
    re.compile(pattern)
    translated = pattern.replace("(?P<", "(?<")
    if spark is not None:
        spark._jvm.java.util.regex.Pattern.compile(translated)
    return translated


def _rule(entry, spark: SparkSession | None) -> Rule:
    if not isinstance(entry, dict) or not str(entry.get("name") or "").strip():
        raise ConfigError("every rule is a mapping with a name")
    name = str(entry["name"]).strip()

    def need(ok, what):
        if not ok:
            raise ConfigError(f"rule {name!r}: {what}")

    description = str(entry.get("description") or "").strip()
    need(description, "a description is required; it explains every match")
    events = tuple(e.upper() for e in _listed(entry.get("events")))
    need(events, "events are required; without any it never fires")
    unknown = sorted(set(events) - {*EVENT_TYPES, *RESERVED_TYPES})
    need(not unknown, f"unknown events {unknown}")
    enabled, kind = bool(entry.get("enabled", True)), str(entry.get("type", "regex")).strip().lower()
    need(kind in ("regex", "typosquat"), f"unknown type {kind!r}")
    if kind == "regex":
        need(entry.get("regex"), "a regex is required")
        try:
            return RegexRule(name, description, java_pattern(str(entry["regex"]), spark), events, enabled)
        except Exception as wrong:
            raise ConfigError(f"rule {name!r}: {entry['regex']!r} doesn't compile: {wrong}") from None
    need(_listed(entry.get("brands")), "brands are required")
    most = int(entry.get("max_distance", 1))
    need(most >= 1, "max_distance is at least 1")
    methods = tuple(m.lower() for m in _listed(entry.get("methods", METHODS)))
    unknown = sorted(set(methods) - {*METHODS, *OPTIONAL_METHODS})
    need(not unknown, f"unknown methods {unknown}")
    form = str(entry.get("match_form", "stored")).strip().lower()
    need(form in ("stored", "unicode"), f"unknown match_form {form!r}")
    layouts = tuple(x.lower() for x in _listed(entry.get("keyboard_layouts", list(LAYOUTS))))
    return TypoRule(name, description, Watchlist.of(
        _listed(entry["brands"]), max_distance=most, methods=methods, layouts=layouts,
        min_length=int(entry.get("min_length_for_distance", 5)), home_tlds=dict(entry.get("home_tlds") or {}), match_form=form), events, enabled)


def load_rules(text: str, spark: SparkSession | None = None) -> list[Rule]:
    """The rules of a YAML text with a top-level `rules` list."""
    try:
        raw = yaml.safe_load(text)
    except yaml.YAMLError as wrong:
        raise ConfigError(f"not valid YAML: {wrong}") from None
    entries = raw.get("rules") if isinstance(raw, dict) else None
    if not isinstance(entries, list) or not entries:
        raise ConfigError("a non-empty list under `rules` is required")
    rules = [_rule(e, spark) for e in entries]
    names = [r.name for r in rules]
    repeated = sorted({n for n in names if names.count(n) > 1})
    if repeated:
        raise ConfigError(f"rule names are used twice: {repeated}")
    return rules
