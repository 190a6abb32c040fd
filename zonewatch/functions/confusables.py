"""Homoglyph skeletons: characters that look alike fold to one."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .names import display

#: Sequences that read as one letter.
SEQUENCES = {"rn": "m", "vv": "w", "cl": "d"}

#: ASCII characters that read as a letter.
ASCII_LOOKALIKES = {"0": "o", "1": "l", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g",
                    "$": "s", "@": "a", "!": "i", "|": "l"}

#: Other characters that read as the letter: Cyrillic, Greek, fullwidth, accented Latin.
LOOKALIKES = {
    "а": "a", "α": "a", "ａ": "a", "à": "a", "á": "a", "â": "a", "ã": "a", "ä": "a", "å": "a", "ā": "a", "в": "b", "β": "b", "ｂ": "b",
    "с": "c", "ｃ": "c", "ç": "c", "ԁ": "d", "ｄ": "d", "е": "e", "ε": "e", "ｅ": "e", "è": "e", "é": "e", "ê": "e", "ë": "e", "ē": "e",
    "ｆ": "f", "ｇ": "g", "н": "h", "η": "h", "ｈ": "h",
    "і": "i", "ⅰ": "i", "ι": "i", "ｉ": "i", "ì": "i", "í": "i", "î": "i", "ï": "i", "ī": "i", "ј": "j", "ｊ": "j",
    "к": "k", "κ": "k", "ｋ": "k", "ｌ": "l", "м": "m", "ｍ": "m", "ｎ": "n", "ñ": "n",
    "о": "o", "ο": "o", "ｏ": "o", "ò": "o", "ó": "o", "ô": "o", "õ": "o", "ö": "o", "ø": "o", "ō": "o", "р": "p", "ρ": "p", "ｐ": "p",
    "ԛ": "q", "ｑ": "q", "ｒ": "r", "ѕ": "s", "ｓ": "s", "т": "t", "τ": "t", "ｔ": "t",
    "υ": "u", "ｕ": "u", "ù": "u", "ú": "u", "û": "u", "ü": "u", "ū": "u", "ν": "v", "ｖ": "v", "ѡ": "w", "ｗ": "w",
    "х": "x", "χ": "x", "ｘ": "x", "у": "y", "ｙ": "y", "ý": "y", "ÿ": "y", "ｚ": "z",
}


def fold(text: Column) -> Column:
    """Fold a lower-case text. Sequences go first; no folded character begins a new one."""
    for seq, letter in SEQUENCES.items():
        text = F.replace(text, F.lit(seq), F.lit(letter))
    single = {**ASCII_LOOKALIKES, **LOOKALIKES}
    return F.replace(F.translate(text, "".join(single), "".join(single.values())), F.lit("ß"), F.lit("ss"))


def first_label(name: Column) -> Column:
    return F.substring_index(name, ".", 1)


def skeleton(name: Column, decode: bool = True) -> Column:
    """The folded first label; `decode` reads A-labels as what they display."""
    label = first_label(name)
    return fold(F.lower(display(label) if decode else label))


def is_homograph(name: Column) -> Column:
    """Whether the first label, decoded, holds a character outside ASCII."""
    return display(first_label(name)).rlike(r"[^\x00-\x7F]")
