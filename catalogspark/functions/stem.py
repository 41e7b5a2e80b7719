"""English words to stems, as SQL text over an array of lower-case words; no Python at run time.

The rules are those of M. F. Porter's algorithm (1980).  Each step is one CASE over a word, put into the array function of
the engine that runs it: Spark's `transform`, or DuckDB's `list_transform` for the SQL twins.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Endings and what they become, in the order in which they are tried.
STEP_2 = [("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"), ("alli", "al"),
          ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"),
          ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"), ("logi", "log")]
STEP_3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
STEP_4 = ["ement", "ment", "ance", "ence", "able", "ible", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic", "ou"]
# Words that say nothing about a title.
STOP_WORDS = """i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself
they them their theirs themselves what which who whom this that these those am is are was were be been being have has had having do does did
doing a an the and but if or because as until while of at by for with about against between into through during before after above below to
from up down in out on off over under again further then once here there when where why how all any both each few more most other some such
no nor not only own same so than too very s t can will just don should now""".split()

# Of a stem: it has a vowel and a consonant behind it, once, just once, or twice; it has a vowel; it ends short.
_START = "^([^aeiou][^aeiouy]*)?"
_PAIR = "[aeiouy][aeiou]*[^aeiou][^aeiouy]*"
_ONE, _JUST_ONE, _TWO = _START + _PAIR, f"{_START}{_PAIR}([aeiouy][aeiou]*)?$", _START + _PAIR + _PAIR
_VOWEL, _SHORT = _START + "[aeiouy]", "^[^aeiou][^aeiouy]*[aeiouy][^aeiouwxy]$"


def _cut(word: str, n: int) -> str:
    return f"left({word}, length({word}) - {n})"


def _steps(match: str) -> list[str]:
    """The steps as SQL about a word w; `match` names the engine's test of a pattern."""
    has = lambda text, pattern: f"{match}({text}, '{pattern}')"
    ends = lambda *endings: " OR ".join(f"w LIKE '%{e}'" for e in endings)

    def replaced(rules: list[tuple[str, str]]) -> str:
        cases = "".join(f" WHEN w LIKE '%{old}' THEN CASE WHEN {has(_cut('w', len(old)), _ONE)} THEN {_cut('w', len(old))} || '{new}' ELSE w END"
                        for old, new in rules)
        return f"CASE{cases} ELSE w END"

    # A first y is a consonant, which the capital says; + marks a word that has lost its ending.
    removed = "".join(f" WHEN w LIKE '%{e}' THEN CASE WHEN {has(_cut('w', len(e)), _TWO)}"
                      + (f" AND right({_cut('w', 3)}, 1) IN ('s', 't')" if e == "ion" else "") + f" THEN {_cut('w', len(e))} ELSE w END" for e in STEP_4)
    last = _cut("w", 1)
    return [
        "CASE WHEN w LIKE 'y%' THEN 'Y' || substr(w, 2) ELSE w END",
        f"CASE WHEN w LIKE '_%sses' OR w LIKE '_%ies' THEN {_cut('w', 2)} WHEN w LIKE '_%s' AND w NOT LIKE '%ss' THEN {last} ELSE w END",
        f"CASE WHEN w LIKE '_%eed' THEN CASE WHEN {has(_cut('w', 3), _ONE)} THEN {last} ELSE w END "
        f"WHEN w LIKE '_%ed' AND {has(_cut('w', 2), _VOWEL)} THEN {_cut('w', 2)} || '+' "
        f"WHEN w LIKE '_%ing' AND {has(_cut('w', 3), _VOWEL)} THEN {_cut('w', 3)} || '+' ELSE w END",
        f"CASE WHEN w NOT LIKE '%+' THEN w WHEN {ends('at+', 'bl+', 'iz+')} THEN {last} || 'e' "
        f"WHEN substr(w, length(w) - 1, 1) = substr(w, length(w) - 2, 1) AND {has('w', '[^aeiouylsz][+]$')} THEN {_cut('w', 2)} "
        f"WHEN {has(last, _SHORT)} THEN {last} || 'e' ELSE {last} END",
        f"CASE WHEN w LIKE '_%y' AND {has(last, _VOWEL)} THEN {last} || 'i' ELSE w END",
        replaced(STEP_2),
        replaced(STEP_3),
        f"CASE{removed} ELSE w END",
        f"CASE WHEN w LIKE '_%e' AND ({has(last, _TWO)} OR ({has(last, _JUST_ONE)} AND NOT {has(last, _SHORT)})) THEN {last} ELSE w END",
        f"CASE WHEN w LIKE '%ll' AND {has('w', _TWO)} THEN {last} ELSE w END",
        "lower(w)",
    ]


def stems_sql(words: str, duck: bool = False) -> str:
    """SQL for the stems of an array of lower-case words; words of one or two letters stay as they are."""
    for step in _steps("regexp_matches" if duck else "regexp_like"):
        guarded = step if step == "lower(w)" else f"CASE WHEN length(w) > 2 THEN {step} ELSE w END"
        words = f"list_transform({words}, lambda w: {guarded})" if duck else f"transform({words}, w -> {guarded})"
    return words


def words_sql(text: str, duck: bool = False) -> str:
    """SQL for the lower-case words of a text: runs of letters and digits."""
    if duck:
        return f"list_filter(regexp_split_to_array(lower({text}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')"
    return f"filter(split(lower({text}), '[^\\\\p{{L}}\\\\p{{N}}]+'), w -> w <> '')"


def stems(words: str) -> Column:
    return F.expr(stems_sql(words))
