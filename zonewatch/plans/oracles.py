"""SQL for DuckDB: what each registered query returns, written independently of the library."""

from __future__ import annotations

import unicodedata

from ..functions.confusables import ASCII_LOOKALIKES, LOOKALIKES
from ..operators.watchlist import KEYWORDS, LAYOUTS
from .wordzone import BRANDS, IDN_SQUATS, SQUATS


def _values(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


#: Words and pairs of neighbours, by source.
_FOUND = r"""
WITH t AS (
  SELECT coalesce(source, '') AS source,
         list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'),
                     lambda w: length(w) BETWEEN 3 AND 63) AS a
  FROM documents),
l0 AS (
  SELECT source, unnest(a) AS label FROM t
  UNION ALL
  SELECT source, unnest(list_transform(list_zip(a[:-2], a[2:]), lambda p: p[1] || '-' || p[2])) FROM t WHERE len(a) > 1)"""

_DAYS = "bool_or(source <> 'src9') AS known, bool_or(source NOT IN ('src8', 'src9')) AS in_zone, bool_or(source <> 'src0') AS staged"

#: Labels as they are written.
_WRITTEN = f""",
l1 AS (
  SELECT label, label AS shown, {_DAYS} FROM l0 GROUP BY label
  UNION ALL
  SELECT label, label, contains(label, '-'), contains(label, '-'), true FROM (SELECT unnest({_values(SQUATS)}) AS label))"""

#: Labels as A-labels: Punycode (RFC 3492), a row a label and a step of the recursion a digit. The next letter
#: to insert is the smallest left; `place` is how many of those `present` stand before it. A label that would
#: be longer than 63 stays as it is written. Of what IDNA maps first, SQL says nothing: words are lower case.
_CODED = rf""",
sq AS (SELECT unnest({_values(unicodedata.normalize("NFKC", x) for x in SQUATS + IDN_SQUATS)}) AS label),
u0 AS (
  SELECT label, list_transform(range(1, length(label) + 1), lambda i: unicode(substr(label, i, 1))) AS c
  FROM (SELECT label FROM l0 UNION SELECT label FROM sq) WHERE regexp_matches(label, '[^\x00-\x7F]')),
u1 AS (
  SELECT label, pos, cp, len(list_filter(c[:pos - 1], lambda v: v <= cp)) AS place,
         len(list_filter(c, lambda v: v < cp)) + len(list_filter(c[:pos - 1], lambda v: v = cp)) AS present
  FROM (SELECT label, c, pos, c[pos] AS cp FROM (SELECT label, c, unnest(range(1, len(c) + 1)) AS pos FROM u0)) WHERE cp > 127),
u2 AS (
  SELECT label, list(delta ORDER BY cp, pos) AS deltas FROM (
    SELECT label, cp, pos, (cp - lag(cp, 1, 128) OVER w) * (present + 1) + place - lag(place + 1, 1, 0) OVER w AS delta
    FROM u1 WINDOW w AS (PARTITION BY label ORDER BY cp, pos)) GROUP BY label),
u3 AS (
  SELECT label, deltas, length(label) - len(deltas) AS basic, 1 AS j, deltas[1] AS rest, 72 AS bias, 36 AS k,
         CASE WHEN length(label) > len(deltas) THEN regexp_replace(label, '[^\x00-\x7F]', '', 'g') || '-' ELSE '' END AS coded FROM u2
  UNION ALL
  SELECT label, deltas, basic, CASE WHEN rest < lim THEN j + 1 ELSE j END, CASE WHEN rest < lim THEN deltas[j + 1] ELSE (rest - lim) // (36 - lim) END,
         CASE WHEN rest >= lim THEN bias WHEN d <= 455 THEN 36 * d // (d + 38) WHEN d // 35 <= 455 THEN 36 + 36 * (d // 35) // (d // 35 + 38)
              ELSE 72 + 36 * (d // 1225) // (d // 1225 + 38) END,
         CASE WHEN rest < lim THEN 36 ELSE k + 36 END,
         coded || substr('abcdefghijklmnopqrstuvwxyz0123456789', (CASE WHEN rest < lim THEN rest ELSE lim + (rest - lim) % (36 - lim) END + 1)::BIGINT, 1)
  FROM (SELECT *, greatest(1, least(26, k - bias)) AS lim, half + half // (basic + j) AS d
        FROM (SELECT *, deltas[j] // (CASE WHEN j = 1 THEN 700 ELSE 2 END) AS half FROM u3 WHERE j <= len(deltas)))),
al AS (SELECT label, CASE WHEN length(coded) <= 59 THEN 'xn--' || coded ELSE label END AS a_label FROM u3 WHERE j > len(deltas)),
l1 AS (
  SELECT coalesce(a_label, label) AS label, label AS shown, known, in_zone, staged FROM (SELECT label, {_DAYS} FROM l0 GROUP BY label) LEFT JOIN al USING (label)
  UNION ALL
  SELECT coalesce(a_label, label), label, a_label IS NULL AND contains(label, '-'), a_label IS NULL AND contains(label, '-'), true FROM sq LEFT JOIN al USING (label))"""

ZONE = _FOUND + _WRITTEN + """,
s AS (
  SELECT label, min(shown) AS shown, bool_or(known) AS known, bool_or(in_zone) AS in_zone, bool_or(staged) AS staged,
         CASE WHEN length(label) % 10 = 0 THEN 'li' ELSE 'ch' END AS tld
  FROM l1 GROUP BY label),
z AS (
  SELECT *, label || '.' || tld AS name, shown || '.' || tld AS reads,
         CASE WHEN staged AND NOT known THEN 'ADDED_TO_ZONE' WHEN staged AND NOT in_zone THEN 'RETURNED_TO_ZONE'
              WHEN known AND in_zone AND NOT staged THEN 'REMOVED_FROM_ZONE' END AS e1,
         CASE WHEN staged AND NOT (known AND in_zone) THEN 'REMOVED_FROM_ZONE'
              WHEN NOT staged AND known AND in_zone THEN 'RETURNED_TO_ZONE' END AS e2
  FROM s WHERE known OR staged)"""


def whole(sql: str) -> str:
    """The same on labels as A-labels, with the squats in other scripts."""
    return sql.replace(_WRITTEN, _CODED).replace("WITH RECURSIVE", "WITH").replace("WITH", "WITH RECURSIVE", 1)


_CONSONANT = "[^bcdfghjklmnpqrstvwxyz]"

LEXICAL = f""",
lex AS (
  SELECT label, tld, length(label) AS length,
    list_sum(list_transform(list_distinct(regexp_extract_all(label, '.')), lambda c:
      -((length(label) - length(replace(label, c, ''))) / length(label)) * log2((length(label) - length(replace(label, c, ''))) / length(label)))) AS entropy,
    length(regexp_replace(label, '[^0-9]', '', 'g')) / length(label) AS digit_ratio,
    length(regexp_replace(label, '[^aeiou]', '', 'g')) / length(label) AS vowel_ratio,
    length(regexp_replace(label, '{_CONSONANT}', '', 'g')) / length(label) AS consonant_ratio,
    length(label) - length(replace(label, '-', '')) AS hyphen_count,
    list_max(list_transform(regexp_split_to_array(label, '{_CONSONANT}+'), lambda x: length(x))) AS max_consonant_run,
    len(list_distinct(regexp_extract_all(label, '.'))) / length(label) AS unique_char_ratio,
    starts_with(label, 'xn--') OR regexp_matches(label, '[^\\x00-\\x7F]') AS is_idn
  FROM s),
three AS (
  SELECT label, tld, 0.30 * least(1.0, entropy / 4.8) + 0.20 * least(1.0, max_consonant_run / 5.0) + 0.15 * greatest(0.0, 0.35 - vowel_ratio) / 0.35 AS r
  FROM lex)"""

NGRAM = """,
zl AS (SELECT label, tld FROM s WHERE known AND in_zone),
g AS (
  SELECT tld, substr('^^' || label || '^^', i, 3) AS ngram FROM (SELECT label, tld, unnest(range(1, length(label) + 3)) AS i FROM zl)),
c AS (SELECT tld, ngram, count(*) AS cnt FROM g GROUP BY tld, ngram),
tot AS (
  SELECT tld, 3 AS "order", sum(cnt)::BIGINT AS total_ngrams, count(*) AS vocab_size, (SELECT count(*) FROM zl WHERE zl.tld = c.tld) AS sample_count
  FROM c GROUP BY tld),
ag AS (
  SELECT label, tld, substr('^^' || label || '^^', i, 3) AS ngram FROM (SELECT label, tld, unnest(range(1, length(label) + 3)) AS i FROM s)),
lp AS (
  SELECT ag.label, ag.tld, avg(ln((coalesce(cnt, 0) + 1) / (total_ngrams + vocab_size))) AS lp
  FROM ag JOIN tot USING (tld) LEFT JOIN c ON c.tld = ag.tld AND c.ngram = ag.ngram GROUP BY ag.label, ag.tld),
fit AS (
  SELECT tld, avg(lp) AS mean_log_prob, stddev_pop(lp) AS std_log_prob
  FROM lp JOIN (SELECT * FROM zl QUALIFY row_number() OVER (PARTITION BY tld ORDER BY md5(label), label) <= 50000) USING (label, tld) GROUP BY tld),
like_ AS (
  SELECT s.label, s.tld, coalesce(1 / (1 + exp(-greatest(-50.0, least(50.0, (lp - mean_log_prob) / greatest(std_log_prob, 1e-9))))), 0.5) AS likelihood
  FROM s LEFT JOIN lp USING (label, tld) LEFT JOIN fit USING (tld))"""


#: All single look-alikes and their letters.
_SINGLE = "".join((*ASCII_LOOKALIKES, *LOOKALIKES))
_LETTER = "".join((*ASCII_LOOKALIKES.values(), *LOOKALIKES.values()))


def _fold(x: str) -> str:
    return f"replace(translate(replace(replace(replace({x}, 'rn', 'm'), 'vv', 'w'), 'cl', 'd'), '{_SINGLE}', '{_LETTER}'), 'ß', 'ss')"


#: The label with one ASCII sign, which no brand has, for each other character: distances here count bytes.
_BYTES = "regexp_replace(label, '[^\\x00-\\x7F]', '~', 'g')"


#: A pattern takes its first alternative, so longer words come before their beginnings.
_WORDS = "|".join(sorted(KEYWORDS, key=lambda k: (-len(k), k)))

#: Hits on the labels and TLDs of the relation n.
HITS = f""",
b AS (SELECT unnest({_values(BRANDS)}) AS brand, unnest(range({len(BRANDS)})) AS ord),
flips AS (
  SELECT arg_min(brand, ord) AS brand, key FROM (
    SELECT brand, ord, substr(brand, 1, i - 1) || f || substr(brand, i + 1) AS key FROM (
      SELECT brand, ord, i, lower(chr(xor(ascii(substr(brand, i, 1)), (1 << bit)::INTEGER))) AS f
      FROM (SELECT brand, ord, unnest(range(1, length(brand) + 1)) AS i FROM b), (SELECT unnest(range(0, 7)) AS bit))
    WHERE regexp_full_match(f, '[a-z0-9-]')) WHERE key <> brand GROUP BY key),
krows AS (
  SELECT DISTINCT unnest({_values(row for rows in LAYOUTS.values() for row in rows)}) AS r),
kpairs AS (
  SELECT DISTINCT substr(r, i, 1) AS x, substr(r, i + d, 1) AS y
  FROM (SELECT r, unnest(range(1, length(r) + 1)) AS i FROM krows), (SELECT unnest([-1, 1]) AS d) WHERE i + d BETWEEN 1 AND length(r)),
slips AS (
  SELECT DISTINCT brand, substr(brand, 1, i - 1) || y || substr(brand, i + 1) AS key
  FROM (SELECT brand, unnest(range(1, length(brand) + 1)) AS i FROM b WHERE length(brand) >= 5) JOIN kpairs ON x = substr(brand, i, 1)),
beside AS (
  SELECT label, tld, brand, substr(label, 1, strpos(label, brand) - 1) AS bef, substr(label, strpos(label, brand) + length(brand)) AS aft
  FROM n JOIN b ON contains(label, brand) AND label <> brand),
hits AS (
  SELECT label, tld, 'homoglyph' AS method, brand, 0 AS distance
  FROM n JOIN (SELECT {_fold('brand')} AS k, arg_min(brand, ord) AS brand FROM b GROUP BY 1) ON {_fold('shown')} = k WHERE label <> brand
  UNION ALL SELECT label, tld, 'bitsquat', brand, 1 FROM n JOIN flips ON label = key WHERE label <> brand
  UNION ALL SELECT label, tld, 'keyboard', brand, 1 FROM n JOIN slips ON label = key WHERE label <> brand
  UNION ALL SELECT label, tld, CASE WHEN length(label) > length(brand) THEN 'insertion' WHEN length(label) < length(brand) THEN 'omission'
                               WHEN hamming({_BYTES}, brand) = 1 THEN 'replacement' ELSE 'transposition' END, brand, 1
    FROM n JOIN b ON CASE WHEN length(brand) >= 5 AND abs(length(label) - length(brand)) <= 1 AND label <> brand
                          THEN damerau_levenshtein({_BYTES}, brand) = 1 ELSE false END
  UNION ALL SELECT label, tld, 'combosquat', brand, NULL FROM beside
    WHERE regexp_matches(aft, '^-?({_WORDS})') OR regexp_matches(bef, '({_WORDS})-?$')
       OR ((starts_with(aft, '-') OR ends_with(bef, '-')) AND length(brand) >= 5)
  UNION ALL SELECT label, tld, 'hyphenation', brand, NULL FROM n JOIN b ON replace(label, '-', '') = brand WHERE label <> brand)"""

ALL_LABELS = ",\nn AS (SELECT label, tld, shown FROM s)"
EVENT_LABELS = ",\nn AS (SELECT label, tld, shown FROM z WHERE e1 IN ('ADDED_TO_ZONE', 'RETURNED_TO_ZONE'))"
IN_ZONE_LABELS = ",\nn AS (SELECT label, tld, shown FROM z WHERE known AND in_zone)"

_WEIGHT = ("CASE method WHEN 'homoglyph' THEN 1.0 WHEN 'bitsquat' THEN 0.9 WHEN 'combosquat' THEN 0.8 WHEN 'keyboard' THEN 0.7 "
           "WHEN 'hyphenation' THEN 0.5 ELSE 0.6 END::DOUBLE")

#: Matches of today's events.
MATCHES = ZONE + EVENT_LABELS + HITS + LEXICAL + f""",
m AS (
  SELECT name, reads, e1 AS event_type, 'short' AS rule_name, 'Three to seven letters' AS rule_description, name AS matched_value, NULL::VARCHAR AS method, NULL::VARCHAR AS brand, NULL::DOUBLE AS score
  FROM z WHERE e1 IN ('ADDED_TO_ZONE', 'REMOVED_FROM_ZONE') AND regexp_matches(name, '^[a-z]{{3,7}}\\.ch$')
  UNION ALL
  SELECT name, reads, e1, 'text', 'A brand''s text anywhere', regexp_extract(name, '(thanedble|orantion|coop)'), NULL, NULL, NULL
  FROM z WHERE e1 IS NOT NULL AND regexp_matches(name, '(thanedble|orantion|coop)')
  UNION ALL
  SELECT name, reads, e1, 'watch', 'Squats of our brands', label, method, brand, round(round_even({_WEIGHT} + 0.1 * r / 0.65, 4)::DECIMAL(9, 4), 3)::DOUBLE
  FROM hits JOIN z USING (label, tld) JOIN three USING (label, tld))"""


def _squat(where: str) -> str:
    return ZONE + ALL_LABELS + HITS + f"\nSELECT label, tld, method, brand, coalesce(distance, -1) AS distance FROM hits WHERE {where}"


#: Today's names with a dot, between blanks, with a word behind, and too long; in normal form.
RAW = """,
raw AS (
  SELECT kind, tld, CASE kind WHEN 'space' THEN name || ' x' WHEN 'long' THEN name || '.' || repeat('x', 250) ELSE name END AS name
  FROM z, (SELECT unnest(['dot', 'blank', 'space', 'long']) AS kind) WHERE staged)"""

#: Statistics after today's transfer of one TLD.
STATS = """,
st AS (
  SELECT tld, count(*) FILTER (WHERE CASE WHEN tld = 'ch' THEN staged ELSE known AND in_zone END) AS name_count,
         CASE WHEN tld = 'ch' THEN '2026-01-02' ELSE '2026-01-01' END AS transferred_at
  FROM z GROUP BY tld)"""

#: Labels of n within two edits of the brands of b. What is at most as far in the unrestricted distance is
#: measured again, row by row of the plain table: a character that was swapped isn't edited once more.
TWO_EDITS = f"""
near AS MATERIALIZED (
  SELECT label, tld, brand, string_split(label, '') AS x, string_split(brand, '') AS y FROM n JOIN b ON
    CASE WHEN length(brand) >= 5 AND abs(length(label) - length(brand)) <= 2 AND label <> brand THEN damerau_levenshtein({_BYTES}, brand) <= 2 ELSE false END),
plain AS (
  SELECT label, tld, brand, x, y, 0 AS i, range(0, len(y) + 1) AS now, NULL::BIGINT[] AS before FROM near
  UNION ALL
  SELECT label, tld, brand, x, y, i + 1, list_transform(step, lambda v, j: list_min(list_transform(range(1, j + 1), lambda k: step[k] + j - k))), now
  FROM (
    SELECT *, list_transform(range(0, len(y) + 1), lambda j: CASE WHEN j = 0 THEN i + 1 ELSE least(now[j + 1] + 1, now[j] + (x[i + 1] <> y[j])::BIGINT,
             CASE WHEN i > 0 AND j > 1 AND x[i + 1] = y[j - 1] AND x[i] = y[j] THEN before[j - 1] + 1 ELSE 99 END) END) AS step
    FROM plain WHERE i < len(x))),
d AS (SELECT label, tld, brand, x, y, now[len(y) + 1] AS distance FROM plain WHERE i = len(x))
SELECT label, tld, CASE len(x) - len(y) WHEN 1 THEN 'insertion' WHEN -1 THEN 'omission' WHEN 0 THEN
         CASE WHEN distance = 1 AND len(list_filter(range(1, len(x) + 1), lambda k: x[k] <> y[k])) = 2 THEN 'transposition' ELSE 'replacement' END
         ELSE 'typo' END AS method, brand, distance::INTEGER AS distance
FROM d WHERE distance <= 2"""

ORACLES: dict[str, str] = {
    "zone_diff_counts": ZONE + """
SELECT count(*) FILTER (WHERE e1 = 'ADDED_TO_ZONE') AS added, count(*) FILTER (WHERE e1 = 'REMOVED_FROM_ZONE') AS removed,
       count(*) FILTER (WHERE e1 = 'RETURNED_TO_ZONE') AS returned, count(e1) AS total FROM z""",
    "zone_diff_events": ZONE + """
SELECT name, tld, e1 AS event_type, '2026-01-02' AS detected_at, 1::BIGINT AS run_id FROM z WHERE e1 IS NOT NULL""",
    "zone_new_state": ZONE + """
SELECT name, tld, CASE WHEN known THEN '2026-01-01' ELSE '2026-01-02' END AS first_seen_at,
       CASE WHEN staged THEN '2026-01-02' ELSE '2026-01-01' END AS last_seen_at, staged AS currently_in_zone,
       CASE WHEN staged OR e1 IS NOT NULL THEN '2026-01-02' ELSE '2026-01-01' END AS updated_at FROM z""",
    "zone_validation": ZONE + """,
v AS (SELECT tld, count(*) FILTER (WHERE staged) AS name_count, count(*) FILTER (WHERE known AND in_zone) AS previous_count FROM z GROUP BY tld)
SELECT tld, name_count, previous_count, round(name_count / previous_count, 6) AS ratio,
       name_count > 0 AND name_count / previous_count >= 0.5 AS accepted,
       CASE WHEN name_count = 0 THEN 'empty' WHEN name_count / previous_count < 0.5 THEN 'shrunk' ELSE 'ok' END AS reason FROM v""",
    "zone_stage_dedup": ZONE + "\nSELECT name, tld FROM z WHERE staged",
    "zone_text_ns_owners": ZONE + "\nSELECT name, tld, 2::BIGINT AS n_lines FROM z WHERE staged",
    "event_history": ZONE + """
SELECT name, concat_ws(',', '1:' || e1, '2:' || e2) AS events FROM z WHERE e1 IS NOT NULL OR e2 IS NOT NULL""",
    "state_from_log": ZONE + """
SELECT name, tld, coalesce(e2, e1, '') <> 'REMOVED_FROM_ZONE' AS in_zone,
       (coalesce(e2, e1, '') <> 'REMOVED_FROM_ZONE') = (known AND in_zone) AS agrees FROM z""",
    "lexical_features": ZONE + LEXICAL + """
SELECT label, length, round(entropy, 6) AS entropy, round(digit_ratio, 6) AS digit_ratio, round(vowel_ratio, 6) AS vowel_ratio,
       round(consonant_ratio, 6) AS consonant_ratio, hyphen_count, max_consonant_run, round(unique_char_ratio, 6) AS unique_char_ratio, is_idn FROM lex""",
    "randomness_score": ZONE + LEXICAL + NGRAM + """
SELECT label, tld, round(greatest(0.0, least(1.0, r + 0.35 * (1 - likelihood))), 6) AS randomness FROM three JOIN like_ USING (label, tld)""",
    "ngram_counts": ZONE + NGRAM + "\nSELECT tld, ngram, cnt FROM c",
    "ngram_stats": ZONE + NGRAM + """
SELECT tld, "order", total_ngrams, vocab_size, sample_count, round(mean_log_prob, 6) AS mean_log_prob, round(std_log_prob, 6) AS std_log_prob
FROM tot JOIN fit USING (tld)""",
    "ngram_likelihood": ZONE + NGRAM + "\nSELECT label, tld, round(likelihood, 6) AS likelihood FROM like_",
    "skeleton_fold": ZONE + f"\nSELECT label, {_fold('shown')} AS skeleton FROM s",
    "squat_homoglyph": _squat("method = 'homoglyph'"),
    "squat_bitsquat": _squat("method = 'bitsquat'"),
    "squat_keyboard": _squat("method = 'keyboard'"),
    "squat_typo": _squat("method IN ('insertion', 'omission', 'replacement', 'transposition')"),
    "squat_combosquat": _squat("method = 'combosquat'"),
    "squat_hyphenation": _squat("method = 'hyphenation'"),
    "squat_tld_variant": ZONE + f"""
SELECT label, tld, 'tld_variant' AS method, label AS brand, -1 AS distance FROM s WHERE list_contains({_values(BRANDS)}, label) AND tld <> 'li'""",
    "squat_all": _squat("true"),
    "assess_scores": ZONE + ALL_LABELS + HITS + LEXICAL + f"""
SELECT s.label, s.tld, count(method) AS n_watchlist, round(any_value(r) / 0.65, 6) AS randomness,
       round(round_even(coalesce(sum({_WEIGHT}) FILTER (WHERE method IS NOT NULL), 0) + 0.1 * any_value(r) / 0.65, 4)::DECIMAL(9, 4), 3)::DOUBLE AS score, count(method) > 0 AS fires,
       count(method) + (any_value(r) > 0)::INTEGER AS n_signals
FROM s JOIN three USING (label, tld) LEFT JOIN hits USING (label, tld) GROUP BY s.label, s.tld""",
    "rule_regex_events": MATCHES + r"""
SELECT name, event_type, rule_name, CASE rule_name WHEN 'short' THEN '^[a-z]{3,7}\.ch$' ELSE '(thanedble|orantion|coop)' END AS rule_pattern, matched_value
FROM m WHERE rule_name <> 'watch'""",
    "rule_typo_events": MATCHES + """
SELECT name, event_type, rule_name, matched_value, method, brand, score FROM m WHERE rule_name = 'watch'""",
    "rule_backfill": ZONE + IN_ZONE_LABELS + HITS + r"""
SELECT name, NULL AS event_type, 'short' AS rule_name, name AS matched_value, NULL AS method, NULL AS brand
FROM z WHERE known AND in_zone AND regexp_matches(name, '^[a-z]{3,7}\.ch$')
UNION ALL SELECT name, NULL, 'text', regexp_extract(name, '(thanedble|orantion|coop)'), NULL, NULL
FROM z WHERE known AND in_zone AND regexp_matches(name, '(thanedble|orantion|coop)')
UNION ALL SELECT label || '.' || tld, NULL, 'watch', label, method, brand FROM hits""",
    "match_by_rule": MATCHES + "\nSELECT rule_name, min(rule_description) AS rule_description, count(*) AS n_matches FROM m GROUP BY rule_name",
    "match_by_brand": MATCHES + """
SELECT brand, count(*) AS n_matches, count(DISTINCT reads) AS n_domains, array_to_string(list_sort(list(DISTINCT reads))[1:100], ',') AS domains,
       string_agg(DISTINCT method, ',' ORDER BY method) AS methods FROM m WHERE brand IS NOT NULL GROUP BY brand""",
    "match_ranked": MATCHES + """
SELECT rule_name, place, name, method, brand FROM (
  SELECT *, row_number() OVER (PARTITION BY rule_name ORDER BY coalesce(score, 0) DESC, name, method NULLS FIRST, brand NULLS FIRST)::INTEGER AS place FROM m)
WHERE place <= 20""",
    "run_digest": MATCHES + """
SELECT 1::BIGINT AS run_id, count(*) AS n_matches,
       CASE WHEN count(*) = 1 THEN 'zone watch: ' || min(name) || ' ' || min(event_type)
            WHEN count(DISTINCT rule_name) = 1 THEN 'zone watch: rule ' || min(rule_name) || ' matched ' || count(*) || ' times'
            ELSE 'zone watch: ' || count(DISTINCT rule_name) || ' rules matched ' || count(*) || ' times' END AS subject
FROM m""",
    "feature_export": MATCHES + """,
a AS (
  SELECT name, coalesce(string_agg(DISTINCT method, ';' ORDER BY method), '') AS methods, max(score) AS max_score, bool_or(brand IS NOT NULL) AS brand_fired
  FROM m GROUP BY name)
SELECT z.name AS domain, z.tld, e1 AS event_type, length, hyphen_count, max_consonant_run, a.name IS NOT NULL AS watchlist_fired,
       coalesce(brand_fired, false) AS brand_fired, coalesce(methods, '') AS methods, max_score
FROM z JOIN lex USING (label, tld) LEFT JOIN a ON a.name = z.name WHERE e1 IS NOT NULL""",
    "status_totals": MATCHES + """
SELECT count(*) FILTER (WHERE known) AS known, count(*) FILTER (WHERE known AND in_zone) AS in_zone,
       count(*) FILTER (WHERE known AND NOT in_zone) AS out_of_zone, count(e1) AS events, (SELECT count(*) FROM m) AS matches FROM z""",
    "recent_runs": ZONE + """
SELECT replace(source, 'src', '')::BIGINT AS run_id, strftime(DATE '1970-01-01' + replace(source, 'src', '')::INTEGER, '%Y-%m-%d') AS started,
       count(DISTINCT label) FILTER (WHERE length(label) % 10 <> 0) AS ch, nullif(count(DISTINCT label) FILTER (WHERE length(label) % 10 = 0), 0) AS li
FROM l0 WHERE source <> '' GROUP BY source ORDER BY 1 DESC LIMIT 5""",
    "availability_candidates": MATCHES + """
SELECT 1::BIGINT AS run_id, name, tld FROM z WHERE e1 = 'REMOVED_FROM_ZONE' AND name IN (SELECT name FROM m)""",
    "zone_text_awkward": ZONE + "\nSELECT name, tld, 1::BIGINT AS n_lines FROM z WHERE staged AND length(label) % 4 <> 3",
    "name_parts": ZONE + RAW + r"""
SELECT kind, name, CASE WHEN contains(name, '.') THEN regexp_extract(name, '[^.]*$') ELSE '' END AS last, regexp_replace(name, '\.[^.]*$', '') AS label,
       length(name) BETWEEN 1 AND 253 AND NOT regexp_matches(name, '\s') AS plausible FROM raw""",
    "zone_rejected": ZONE + RAW + "\nSELECT tld, count(*) FILTER (WHERE kind IN ('space', 'long')) AS malformed FROM raw GROUP BY tld",
    "snapshot_stats": ZONE + STATS + "\nSELECT tld, name_count, transferred_at FROM st",
    "due_tlds": ZONE + STATS + "\nSELECT tld FROM st WHERE transferred_at = '2026-01-01'",
    "zone_baseline": ZONE + """
SELECT name, tld, '2026-01-02' AS first_seen_at, '2026-01-02' AS last_seen_at, true AS currently_in_zone, true AS first_of_none, false AS first_of_state
FROM z WHERE staged""",
    "lexical_rounded": ZONE + LEXICAL + """
SELECT label, length, round_even(entropy, 4)::DOUBLE AS entropy, round_even(digit_ratio, 4)::DOUBLE AS digit_ratio, round_even(vowel_ratio, 4)::DOUBLE AS vowel_ratio,
       round_even(consonant_ratio, 4)::DOUBLE AS consonant_ratio, hyphen_count, max_consonant_run, round_even(unique_char_ratio, 4)::DOUBLE AS unique_char_ratio, is_idn
FROM lex""",
    "ngram_merged": ZONE + NGRAM + "\nSELECT tld, ngram, cnt FROM c",
    "ngram_updated": ZONE + NGRAM.replace("known AND in_zone", "staged") + """
SELECT tld, "order", total_ngrams, vocab_size, sample_count, round(mean_log_prob, 6) AS mean_log_prob, round(std_log_prob, 6) AS std_log_prob
FROM tot JOIN fit USING (tld)""",
    "ngram_from_labels": ZONE + NGRAM.replace("WHERE known AND in_zone", "") + """
SELECT tld, "order", total_ngrams, vocab_size, sample_count, round(mean_log_prob, 6) AS mean_log_prob, round(std_log_prob, 6) AS std_log_prob
FROM tot JOIN fit USING (tld)""",
    "word_skeletons": rf"""
WITH w AS (
  SELECT DISTINCT unnest(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{N}}]+')) AS label FROM documents)
SELECT label, {_fold('label')} AS skeleton,
       regexp_matches(label, '[^\x00-\x7F]') AS is_homograph
FROM w WHERE label <> ''""",
    # the distance here is the unrestricted one; it parts from the restricted one only where a swap's letters are parted again
    "squat_typo_two": ZONE.replace("WITH", "WITH RECURSIVE", 1) + ALL_LABELS + f""",
b AS (SELECT unnest({_values(BRANDS)}) AS brand),""" + TWO_EDITS,
    "squat_many_two": ZONE.replace("WITH", "WITH RECURSIVE", 1) + ALL_LABELS + """,
b AS (
  SELECT word AS brand FROM (SELECT unnest(a) AS word FROM t) WHERE regexp_full_match(word, '[a-z]{6,63}')
  GROUP BY word ORDER BY count(*) DESC, word LIMIT 1000),""" + TWO_EDITS,
    "backfill_updated": ZONE + IN_ZONE_LABELS.replace("known AND in_zone", "staged") + HITS + r"""
SELECT *, '2026-01-02' AS detected_at, 7::BIGINT AS run_id FROM (
  SELECT name, NULL AS event_type, 'short' AS rule_name, name AS matched_value, NULL AS method, NULL AS brand
  FROM z WHERE staged AND regexp_matches(name, '^[a-z]{3,7}\.ch$')
  UNION ALL SELECT name, NULL, 'text', regexp_extract(name, '(thanedble|orantion|coop)'), NULL, NULL
  FROM z WHERE staged AND regexp_matches(name, '(thanedble|orantion|coop)')
  UNION ALL SELECT label || '.' || tld, NULL, 'watch', label, method, brand FROM hits)""",
    "rule_many_patterns": ZONE + """,
b AS (
  SELECT word FROM (SELECT unnest(a) AS word FROM t) WHERE regexp_full_match(word, '[a-z]{6,63}')
  GROUP BY word ORDER BY count(*) DESC, word LIMIT 500),
p AS (SELECT DISTINCT name, unnest(string_split(label, '-')) AS word FROM z WHERE known AND in_zone)
SELECT name, word AS rule_name, regexp_extract(name, '(^|-)' || word || '(-|\\.)') AS matched_value FROM p JOIN b USING (word)""",
    "analyse_names": ZONE + ALL_LABELS + HITS + LEXICAL + NGRAM + f""",
f AS (SELECT label, tld, greatest(0.0, least(1.0, r + 0.35 * (1 - likelihood))) AS random, likelihood FROM three JOIN like_ USING (label, tld)),
rl AS (SELECT unnest(['all', 'near']) AS rule),
hr AS (
  SELECT label, tld, rule, count(*) AS k, sum({_WEIGHT}) AS weights
  FROM hits JOIN rl ON rule = 'all' OR method IN ('insertion', 'omission', 'replacement', 'transposition') GROUP BY label, tld, rule)
SELECT label, tld, rule, length, hyphen_count, max_consonant_run, is_idn, round(likelihood, 6) AS likelihood, coalesce(k, 0) AS n_watchlist,
       round(random, 6) AS randomness, round(round_even(coalesce(weights, 0) + 0.1 * random, 4)::DECIMAL(9, 4), 3)::DOUBLE AS score,
       k IS NOT NULL AS fires, coalesce(k, 0) + (random > 0)::INTEGER AS n_signals
FROM f JOIN lex USING (label, tld) CROSS JOIN rl LEFT JOIN hr USING (label, tld, rule)""",
    "assess_signals": ZONE + ALL_LABELS + HITS + LEXICAL + f"""
SELECT label, tld, method AS signal, 'watchlist' AS category, {_WEIGHT} AS weight, brand, coalesce(distance, -1) AS distance FROM hits
UNION ALL SELECT label, tld, 'randomness', 'lexical', round(r / 0.65, 6), '', -1 FROM three WHERE r > 0""",
    "backfill_one": ZONE + """
SELECT name, 'text' AS rule_name, regexp_extract(name, '(thanedble|orantion|coop)') AS matched_value
FROM z WHERE known AND in_zone AND regexp_matches(name, '(thanedble|orantion|coop)')""",
    "rule_patterns": MATCHES + r"""
SELECT rule_name, CASE rule_name WHEN 'short' THEN '^[a-z]{3,7}\.ch$' WHEN 'text' THEN '(thanedble|orantion|coop)'
         ELSE 'watchlist of 10 brands within distance 1 by bitsquat, combosquat, homoglyph, hyphenation, keyboard, typo' END AS rule_pattern,
       count(*) AS n_matches FROM m GROUP BY rule_name""",
    "match_lines": MATCHES + """
SELECT rule_name, reads AS display_name, event_type AS event, CASE WHEN name LIKE '%.li' THEN '2026-07-02 08:00 CEST' ELSE '2026-01-02 07:00 CET' END AS seen,
       method, brand FROM m""",
}

#: What is said of each hit of a watchlist and of randomness, in d, with the letters of the label as they are read.
DETAILS = f""",
kl AS (
  SELECT x, y, arg_min(layout, ord) AS layout FROM (
    SELECT layout, ord, substr(r, i, 1) AS x, substr(r, i + step, 1) AS y
    FROM (SELECT layout, ord, r, unnest(range(1, length(r) + 1)) AS i
          FROM (VALUES {", ".join(f"('{n}', {i}, '{r}')" for i, (n, rows) in enumerate(LAYOUTS.items()) for r in rows)}) AS v(layout, ord, r)),
         (SELECT unnest([-1, 1]) AS step) WHERE i + step BETWEEN 1 AND length(r)) GROUP BY x, y),
kslips AS (
  SELECT brand, substr(brand, 1, i - 1) || y || substr(brand, i + 1) AS label, layout
  FROM (SELECT brand, unnest(range(1, length(brand) + 1)) AS i FROM b) JOIN kl ON x = substr(brand, i, 1)),
d AS (
  SELECT hits.*, CASE
      WHEN method = 'homoglyph' THEN 'reads as ''' || {_fold('shown')} || ''', like ''' || brand || '''' ||
        CASE WHEN regexp_matches(shown, '[^\\x00-\\x7F]') THEN ', with letters beyond ASCII' ELSE '' END
      WHEN method = 'bitsquat' THEN 'one flipped bit away from ''' || brand || ''''
      WHEN method = 'keyboard' THEN 'a neighbouring key of ' || layout || ' in ''' || brand || ''''
      WHEN method = 'hyphenation' THEN '''' || brand || ''' once its hyphens are gone'
      WHEN method = 'combosquat' THEN 'holds ''' || brand || '''; ' || CASE
        WHEN regexp_matches(aft, '^-?({_WORDS})')
        THEN CASE WHEN starts_with(aft, '-') THEN 'behind a hyphen ' ELSE '' END || 'the word ''' || regexp_extract(aft, '^-?({_WORDS})', 1) || ''' comes straight after it'
        WHEN regexp_matches(bef, '({_WORDS})-?$')
        THEN CASE WHEN ends_with(bef, '-') THEN 'behind a hyphen ' ELSE '' END || 'the word ''' || regexp_extract(bef, '({_WORDS})-?$', 1) || ''' comes straight before it'
        ELSE 'a hyphen sets it apart' END
      ELSE 'distance ' || distance || ' to ''' || brand || ''', by ' || method END AS detail
  FROM hits JOIN n USING (label, tld) LEFT JOIN beside USING (label, tld, brand)
  LEFT JOIN kslips USING (brand, label)),
said AS (
  SELECT label, tld, r / 0.65 AS randomness, printf('%.2f bits a character, %d consonants in a row, %.2f vowels',
           round(entropy, 2), coalesce(max_consonant_run, 0)::INTEGER, round(vowel_ratio, 2)) AS sentence
  FROM lex JOIN three USING (label, tld))"""

ORACLES |= {
    "signal_texts": ZONE + ALL_LABELS + HITS + LEXICAL + DETAILS + """
SELECT label, tld, method AS signal, brand, 'squats on ''' || brand || ''' (' || method || ')' AS reason, detail FROM d
UNION ALL SELECT label, tld, 'randomness', NULL, printf('looks random: %.2f', round(randomness, 2)), sentence FROM said WHERE randomness > 0""",
    "match_signals": ZONE + EVENT_LABELS + HITS + LEXICAL + DETAILS + """
SELECT label || '.' || tld AS name, method, brand, distance, detail, label, length, round_even(entropy, 4)::DOUBLE AS entropy, hyphen_count, is_idn,
       CASE WHEN randomness > 0 THEN round(randomness, 6) END AS randomness, CASE WHEN randomness > 0 THEN sentence END AS sentence
FROM d JOIN lex USING (label, tld) JOIN said USING (label, tld)""",
}

#: Of the queries on the whole zone.
WHOLE_ORACLES: dict[str, str] = {
    "whole_display_names": whole(ZONE + "\nSELECT name, reads AS display, regexp_matches(reads, '[^\\x00-\\x7F]') AS is_homograph FROM z WHERE staged"),
    **{f"whole_{k}": whole(q) for k, q in ORACLES.items()}}

#: Matches of the names that run 2 of a store takes out.
_TAKEN_OUT = r""",
m2 AS (
  SELECT name, 'short' AS rule_name, name AS matched_value FROM z WHERE known AND NOT in_zone AND regexp_matches(name, '^[a-z]{3,7}\.ch$')
  UNION ALL
  SELECT name, 'text', regexp_extract(name, '(thanedble|orantion|coop)') FROM z WHERE known AND NOT in_zone AND regexp_matches(name, '(thanedble|orantion|coop)'))"""


def _run(number: int, status: str, started: str, added: str, removed: str, returned: str, matched: str, inside: str) -> str:
    """A row of the log of runs, counted from z; the counts of TLDs are null where no name is inside."""
    return (f"SELECT {number}::BIGINT AS run_id, '{status}' AS status, '{started}' AS started, count(*) FILTER (WHERE {added}) AS added, "
            f"count(*) FILTER (WHERE {removed}) AS removed, count(*) FILTER (WHERE {returned}) AS returned, {matched} AS matched, "
            f"nullif(count(*) FILTER (WHERE {inside} AND tld = 'ch'), 0) AS ch, nullif(count(*) FILTER (WHERE {inside} AND tld = 'li'), 0) AS li, "
            f"false AS stale, {str(status == 'FAILED').lower()} AS failed FROM z")


#: Of the queries on stores and files.
STORED_ORACLES: dict[str, str] = {k: whole(q) for k, q in {
    "monitor_runs": MATCHES + _TAKEN_OUT + "\n" + "\nUNION ALL ".join((
        _run(1, "SUCCESS", "2026-01-01", "false", "false", "false", "0", "known"),
        _run(2, "SUCCESS", "2026-01-02", "false", "known AND NOT in_zone", "false", "(SELECT count(*) FROM m2)", "known AND in_zone"),
        _run(3, "SUCCESS", "2026-01-03", "e1 = 'ADDED_TO_ZONE'", "e1 = 'REMOVED_FROM_ZONE'", "e1 = 'RETURNED_TO_ZONE'", "(SELECT count(*) FROM m)", "staged"),
        _run(4, "FAILED", "2026-01-04", "false", "false", "false", "0", "false"),
        _run(5, "SKIPPED", "2026-01-03", "false", "false", "false", "0", "false"))),
    "monitor_rerun": ZONE + """
SELECT name, tld, CASE WHEN known THEN '2026-01-01' ELSE '2026-01-03' END AS first_seen_at, CASE WHEN staged THEN '2026-01-03' ELSE '2026-01-02' END AS last_seen_at,
       staged AS currently_in_zone, '2026-01-03' AS updated_at, CASE WHEN NOT known THEN '3:ADDED_TO_ZONE' WHEN NOT staged THEN '3:REMOVED_FROM_ZONE' END AS event
FROM z""",
    "stream_matches": MATCHES + _TAKEN_OUT + """
SELECT 2::BIGINT AS run_id, name, 'REMOVED_FROM_ZONE' AS event_type, rule_name, matched_value, NULL::VARCHAR AS method, NULL::VARCHAR AS brand, NULL::DOUBLE AS score FROM m2
UNION ALL SELECT 3, name, event_type, rule_name, matched_value, method, brand, score FROM m""",
    "stored_backfill": ORACLES["backfill_updated"].replace("'2026-01-02' AS detected_at, 7::", "'2026-01-05' AS detected_at, 5::"),
    "stored_model": ORACLES["ngram_updated"],
    "rule_file": MATCHES + r"""
SELECT name, event_type, rule_name, rule_description, CASE rule_name WHEN 'short' THEN '^[a-z]{3,7}\.ch$' WHEN 'text' THEN '(?<brand>thanedble|orantion|coop)'
         ELSE 'watchlist of 10 brands within distance 1 by bitsquat, combosquat, homoglyph, hyphenation, keyboard, typo' END AS rule_pattern,
       matched_value, method, brand FROM m""",
    "feature_file": ORACLES["feature_export"],
}.items()}
