"""Small documents with everything awkward: nulls, empties, ties, repeats, odd characters."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, extra string, id long, rank long"

WORDS = {
    "en": "the of and house river green stone letter walking morning window paper bread light under winter".split(),
    "de": "der die und haus fluss grün stein brief gehen morgen fenster papier brot licht unter winter straße schön".split(),
}


def prose(rng: random.Random, lang: str, n: int) -> str:
    words = [rng.choice(WORDS[lang]) + rng.choice(["", "", "s", "en", "ig"]) + rng.choice("abcdefgh") for _ in range(n)]
    return " ".join(words) + "."


def documents(spark, n: int = 60, seed: int = 1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = "en" if i % 2 else "de"
        text = "\n".join(prose(rng, lang, rng.randint(5, 40)) for _ in range(rng.randint(1, 4)))
        rows.append((i, text, lang, f"s{i % 3}"))
    base = rows[3][1]
    rows += [(100, base, "en", "s0"), (101, base, "en", None), (102, base + " tail", "en", "s0"), (103, base.upper(), "en", "s1"),
             (104, None, "en", "s1"), (105, "", None, "s1"), (106, " \t\n ", "de", "s1"), (107, "12 34 !!", "de", "s2"),
             (108, "one two", "en", "s2"), (109, "one two", "en", "s2"), (109, "one two", "en", "s2"), (None, "no id here at all, really", "en", "s2"),
             ((1 << 60) + 1, "an id that no double can hold", "en", "s2"),
             (110, "İstanbul ΑΣ naïve é \x1c x <|endoftext|> 'll it's \U0001F600", "en", "s2"), (111, "x" * 5000 + " " + "word " * 9000, "en", "s2"),
             (112, "\n\n\n", "en", "s2"), (113, rows[5][1] + "\n  " + base + "\t", "de", "s2")]
    full = [(i, t, lang, s, None if t is None else len(t), "e", 7, 8) for i, t, lang, s in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
