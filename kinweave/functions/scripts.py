"""Transliteration of the scripts of India, as column expressions: syllables are matched as a whole and rewritten by tables.

Nine scripts have their letters at the same places of their blocks, so one table, that of Devanagari, serves them all. A consonant
has a vowel of its own unless a vowel sign or a virama follows; in the northern scripts it has none at the end of a word.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters of Devanagari and their plain Latin ones.
CONSONANTS = dict(zip("कखगघङचछजझञटठडढणतथदधनपफबभमयरलळवशषसह", "k kh g gh n ch chh j jh n t th d dh n t th d dh n p ph b bh m y r l l v sh sh s h".split(), strict=True))
DOTTED = dict(zip("कखगजडढफ", "q kh g z r rh f".split(), strict=True))
VOWELS = dict(zip("अआइईउऊऋऌएऐओऔ", "a a i i u u ri li e ai o au".split(), strict=True))
SIGNS = dict(zip("ािीुूृेैोौ", "a i i u u ri e ai o au".split(), strict=True))
OTHERS = {"ं": "n", "ँ": "n", "ः": "h", "ऽ": "", "ॐ": "om", "।": " ", "॥": " ", **{chr(0x966 + i): str(i) for i in range(10)}}
NASALS = ("ੰੱ", "ं")  # of Gurmukhi; the second, which doubles a consonant, goes
VIRAMA, DOT, EMPTY = "्", "़", ""
BLOCK, FIRST, SCRIPTS, NORTHERN = 0x80, 0x900, 9, 5
# By rule: the letters of the other blocks, and those of Devanagari at their places.
PLACES = [i for i in range(BLOCK) if i not in (0x64, 0x65)]
OWN = "".join(chr(FIRST + s * BLOCK + i) for s in range(1, SCRIPTS) for i in PLACES)
DEVANAGARI = "".join(chr(FIRST + i) for s in range(1, SCRIPTS) for i in PLACES)
# Letters that Unicode has with their dot, and vowels that other scripts have short and long.
WHOLE = {0x958 + i: c + DOT for i, c in enumerate("कखगजडढफ")}
SAME = str.maketrans({"ऎ": "ए", "ऒ": "ओ", "ॆ": "े", "ॊ": "ो", "ऩ": "न", "ऱ": "र", "ऴ": "ळ"})


def blocks(first: int, last: int, scripts: int) -> str:
    """A class of the letters from first to last of so many scripts."""
    return "".join(f"{chr(FIRST + s * BLOCK + first)}-{chr(FIRST + s * BLOCK + last)}" for s in range(scripts))


INDIC = f"[{blocks(0, BLOCK - 1, SCRIPTS)}]"
#: A consonant of a northern script with nothing behind it at the end of a word of several letters.
LAST = rf"(?<=[\p{{L}}\p{{M}}])([{blocks(0x15, 0x39, NORTHERN)}{blocks(0x58, 0x5F, NORTHERN)}][{''.join(chr(FIRST + s * BLOCK + 0x3C) for s in range(NORTHERN))}]?)(?![\p{{L}}\p{{M}}])"
SYLLABLE = rf"[{''.join(CONSONANTS)}]{DOT}?[{''.join(SIGNS)}{VIRAMA}]?|(?s)."


def latin(text: Column) -> Column:
    """text with its Indian letters in plain Latin ones; all others stay, and so do texts without any."""
    closed = F.regexp_replace(text, LAST, f"$1{VIRAMA}")
    plain = F.translate(F.translate(closed, *NASALS), OWN, DEVANAGARI)
    for code, parts in WHOLE.items():
        plain = F.replace(plain, F.lit(chr(code)), F.lit(parts))
    plain = F.translate(plain, "".join(map(chr, SAME)), "".join(SAME.values()))
    table = F.create_map(*(F.lit(x) for pair in {**CONSONANTS, **{c + DOT: x for c, x in DOTTED.items()}, **VOWELS, **SIGNS, **OTHERS, VIRAMA: EMPTY, DOT: EMPTY}.items() for x in pair))
    ends = F.create_map(*(F.lit(x) for pair in {**SIGNS, VIRAMA: EMPTY, EMPTY: "a"}.items() for x in pair))

    def rewritten(part: Column) -> Column:
        head = F.regexp_extract(part, f"^[{''.join(CONSONANTS)}]{DOT}?", 0)
        consonant = F.coalesce(F.try_element_at(table, head), F.try_element_at(table, F.substring(head, 1, 1)))
        tail = F.substr(part, F.length(head) + 1)
        return F.when(head != "", F.concat(consonant, F.try_element_at(ends, tail))).otherwise(F.coalesce(F.try_element_at(table, part), part))

    changed = F.array_join(F.transform(F.regexp_extract_all(plain, F.lit(SYLLABLE), F.lit(0)), rewritten), "")
    return F.when(text.rlike(INDIC), changed).otherwise(text)
