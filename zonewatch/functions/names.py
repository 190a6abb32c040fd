"""Names as columns: canonical form, display form, TLD and label.

ASCII names never leave the JVM's expressions; only names with other characters (or `xn--` labels,
for display) reach the two small IDNA helpers, and every other row passes null there. Most of those names
have letters that IDNA leaves alone, and are only coded; the others go through all of its rules.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_NAME = 253

#: Names that are in normal form: ASCII signs but capitals, with no dot at the end.
_NORMAL = r"^[!-@\[-~]*[!--/-@\[-~]$"
#: Labels of letters that IDNA neither maps nor refuses: no capital, no mark, no other direction, one hyphen at a time.
_PLAIN = "[a-z0-9ß-öø-ÿ]+(?:-[a-z0-9ß-öø-ÿ]+)*"
_PLAIN_LABEL, _PLAIN_NAME = re.compile(_PLAIN), re.compile(rf"{_PLAIN}(?:\.{_PLAIN})*")
_DIGITS = "abcdefghijklmnopqrstuvwxyz0123456789"


def punycode(label: str) -> str:
    """RFC 3492, a character to insert at a time: one pass over those beyond ASCII in order of code and place."""
    basic = [c for c in label if c < "\x80"]
    out, done, bias, last, begin = [*basic, "-"] if basic else [], len(basic), 72, 128, 0
    beyond = sorted((ord(c), i) for i, c in enumerate(label) if c >= "\x80")
    for code, place in beyond:
        at = place - sum(1 for v, i in beyond if i < place and v > code)  # how many of those before it are there
        delta = (code - last) * (done + 1) + at - begin
        rest, k = delta, 36
        while rest >= (limit := min(max(k - bias, 1), 26)):
            rest, digit = divmod(rest - limit, 36 - limit)
            out.append(_DIGITS[limit + digit])
            k += 36
        out.append(_DIGITS[rest])
        delta = delta // (700 if done == len(basic) else 2)
        done += 1
        delta, k = delta + delta // done, 0
        while delta > 455:
            delta, k = delta // 35, k + 36
        bias, last, begin = k + 36 * delta // (delta + 38), code, at + 1
    return "".join(out)


def _plain_ascii(name: str) -> str | None:
    """The name with A-labels if all its labels are plain and none gets too long."""
    if not _PLAIN_NAME.fullmatch(name):
        return None
    coded = [x if x.isascii() else f"xn--{punycode(x)}" for x in name.split(".")]
    return ".".join(coded) if max(map(len, coded)) <= 63 and sum(map(len, coded)) + len(coded) <= MAX_NAME else None


def _plain_unicode(name: str) -> str | None:
    """The name with its A-labels decoded if all of them are plain, and coded as they should be."""
    out = []
    for x in name.split("."):
        if x.startswith("xn--") and x.isascii():
            try:
                y = x[4:].encode("ascii").decode("punycode")
            except UnicodeError:
                return None
            if y.isascii() or punycode(y) != x[4:]:
                return None
            x = y
        elif not x.isascii():
            return None
        if not _PLAIN_LABEL.fullmatch(x) or len(x) > 63:
            return None
        out.append(x)
    return ".".join(out) if len(name) <= MAX_NAME else None


@F.pandas_udf(T.StringType())
def _to_ascii(names: pd.Series) -> pd.Series:
    import idna

    def label(x: str) -> str:
        try:
            return idna.encode(x, uts46=True).decode("ascii")
        except idna.IDNAError:
            return x

    def whole(x):
        if x is None:
            return None
        if (plain := _plain_ascii(x)) is not None:
            return plain
        try:
            return idna.encode(x, uts46=True).decode("ascii")
        except idna.IDNAError:  # one label that can't be encoded stays as it is
            return ".".join(map(label, x.split(".")))

    return names.map(whole, na_action="ignore")


@F.pandas_udf(T.StringType())
def _to_unicode(names: pd.Series) -> pd.Series:
    import idna

    def whole(x):
        if x is None:
            return None
        if (plain := _plain_unicode(x)) is not None:
            return plain
        try:
            return idna.decode(x)
        except (idna.IDNAError, UnicodeError):
            return x

    return names.map(whole, na_action="ignore")


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def normalise_ascii(c: Column) -> Column:
    """Stripped, lower case, without trailing dots. `www.` stays: www.ch is a name of its own."""
    return F.when(c.rlike(_NORMAL), c).otherwise(F.regexp_replace(F.lower(strip(c)), r"\.+$", ""))


def normalise(c: Column) -> Column:
    """The stored form: as normalise_ascii, with other scripts as A-labels."""
    base = normalise_ascii(c)
    other = ~c.rlike(_NORMAL) & base.rlike(r"[^\x00-\x7F]")
    return F.when(other, _to_ascii(F.when(other, base))).otherwise(base)


def display(c: Column) -> Column:
    """For people to read: A-labels decoded, the input where that fails."""
    coded = F.contains(c, F.lit("xn--"))
    return F.when(coded, _to_unicode(F.when(coded, c))).otherwise(c)


def tld_of(c: Column) -> Column:
    return F.when(F.contains(c, F.lit(".")), F.substring_index(c, ".", -1)).otherwise("")


def label_of(c: Column) -> Column:
    """The name without its last label."""
    return F.regexp_replace(c, r"\.[^.]*$", "")


def plausible(c: Column) -> Column:
    return F.length(c).between(1, MAX_NAME) & ~c.rlike(r"(?U)\s")
