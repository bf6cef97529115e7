"""Hangul syllables, keyboard layouts and keys for comparing names."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Initial, medial and final letters in the order of the syllable block.
INITIALS = "ㄱㄲㄴㄷㄸㄹㅁㅂㅃㅅㅆㅇㅈㅉㅊㅋㅌㅍㅎ"
MEDIALS = "ㅏㅐㅑㅒㅓㅔㅕㅖㅗㅘㅙㅚㅛㅜㅝㅞㅟㅠㅡㅢㅣ"
FINALS = ["", *"ㄱㄲㄳㄴㄵㄶㄷㄹㄺㄻㄼㄽㄾㄿㅀㅁㅂㅄㅅㅆㅇㅈㅊㅋㅌㅍㅎ"]
#: Letters that are typed as two.
PAIRS = {"ㄳ": "ㄱㅅ", "ㄵ": "ㄴㅈ", "ㄶ": "ㄴㅎ", "ㄺ": "ㄹㄱ", "ㄻ": "ㄹㅁ", "ㄼ": "ㄹㅂ", "ㄽ": "ㄹㅅ", "ㄾ": "ㄹㅌ", "ㄿ": "ㄹㅍ", "ㅀ": "ㄹㅎ", "ㅄ": "ㅂㅅ", "ㅘ": "ㅗㅏ", "ㅙ": "ㅗㅐ", "ㅚ": "ㅗㅣ", "ㅝ": "ㅜㅓ", "ㅞ": "ㅜㅔ", "ㅟ": "ㅜㅣ", "ㅢ": "ㅡㅣ"}
#: The letter of each key of the two-set layout.
LAYOUT = {**dict(zip("qwertyuiopasdfghjklzxcvbnm", "ㅂㅈㄷㄱㅅㅛㅕㅑㅐㅔㅁㄴㅇㄹㅎㅗㅓㅏㅣㅋㅌㅊㅍㅠㅜㅡ", strict=True)), **dict(zip("QWERTOP", "ㅃㅉㄸㄲㅆㅒㅖ", strict=True))}
JOINED = {v: k for k, v in PAIRS.items()}
FIRST = 0xAC00


def split(ch: str) -> tuple[str, str, str] | None:
    """Initial, medial and final letter of a syllable; None for other characters."""
    n = ord(ch) - FIRST
    if not 0 <= n < 11172:
        return None
    return INITIALS[n // 588], MEDIALS[n % 588 // 28], FINALS[n % 28]


def join(initial: str, medial: str, final: str = "") -> str:
    return chr(FIRST + (INITIALS.index(initial) * 21 + MEDIALS.index(medial)) * 28 + FINALS.index(final))


def letters(ch: str) -> str:
    """A syllable as it is typed, letter by letter."""
    parts = split(ch)
    return "".join(PAIRS.get(p, p) for p in parts) if parts else ch


def initials(text: str) -> str:
    return "".join(p[0] if (p := split(c)) else c for c in text)


def skipped(ch: str) -> bool:
    """Space and punctuation, which comparisons ignore."""
    return ch in "+=|^`~<>$" or ch.isspace() or unicodedata.category(ch)[0] in "PZ" or ch in "·ㆍ"


def key_chars(text: str) -> list[tuple[str, int, bool]]:
    """(character, place in the text, starts a word) of the comparison key: lower case, half width, Roman numerals as digits."""
    out: list[tuple[str, int, bool]] = []
    fresh, last = True, ""
    for i, ch in enumerate(unicodedata.normalize("NFC", text)):
        wide = unicodedata.normalize("NFKC", ch) if "！" <= ch <= "～" else ch
        if skipped(wide):
            fresh = True
            continue
        if "Ⅰ" <= wide <= "Ⅹ" or "ⅰ" <= wide <= "ⅹ":
            wide = str(int(unicodedata.numeric(wide)))
        elif wide in PAIRS and wide in FINALS:
            wide = PAIRS[wide]
        for c in wide.lower():
            kind = "h" if split(c) or "ㄱ" <= c <= "ㅣ" else "d" if c.isdigit() else "a" if c.isascii() and c.isalpha() else "o"
            out.append((c, i, fresh or (last != "" and kind != last)))
            fresh, last = False, kind
    return out


def norm_key(text: str | None) -> str:
    return "".join(c for c, _, _ in key_chars(text or ""))


def mask(key: str) -> int:
    """One bit per initial, digit and Latin letter of a key: a text can only match where it has all bits of the query."""
    bits = 0
    for c in initials(key):
        at = INITIALS.find(c)
        if at >= 0:
            bits |= 1 << at
        elif c.isdigit() and c.isascii():
            bits |= 1 << (19 + int(c))
        elif "a" <= c <= "z":
            bits |= 1 << (29 + ord(c) - 97)
    return bits


def from_qwerty(text: str | None) -> str | None:
    """What keys typed in the wrong layout were meant to be; None where no syllable comes out.

    Letters are first read one by one; then a pass over them fills syllable blocks, a consonant before a vowel always
    starting a new block.
    """
    if not text or not any(c.isascii() and c.isalpha() for c in text):
        return None
    typed = [LAYOUT.get(c) or LAYOUT.get(c.lower()) or c for c in text]
    out, i, n = [], 0, len(typed)

    def vowel(k: int) -> bool:
        return k < n and typed[k] in MEDIALS and len(typed[k]) == 1

    def consonant(k: int) -> bool:
        return k < n and typed[k] in INITIALS

    while i < n:
        first = ""
        if consonant(i) and vowel(i + 1):
            first, i = typed[i], i + 1
        if not vowel(i):
            out.append(typed[i])
            i += 1
            continue
        middle, i = typed[i], i + 1
        if vowel(i) and middle + typed[i] in JOINED:
            middle, i = JOINED[middle + typed[i]], i + 1
        if not first:
            out.append(middle)
            continue
        last = ""
        if consonant(i) and not vowel(i + 1) and typed[i] in FINALS:
            last, i = typed[i], i + 1
            if consonant(i) and not vowel(i + 1) and last + typed[i] in JOINED:
                last, i = JOINED[last + typed[i]], i + 1
        out.append(join(first, middle, last))
    result = "".join(out)
    return result if any(split(c) for c in result) else None


def loose_readings(word: str, cap: int = 12, before_letter: bool = False) -> list[str]:
    """Readings with final consonants taken off as letters of their own, fewest changes first, at most cap.

    before_letter: only of syllables that a lone consonant follows.
    """
    options: list[list[str]] = []
    for i, ch in enumerate(word):
        own = [ch]
        parts = split(ch)
        nxt = word[i + 1 : i + 2]
        if parts and parts[2] and (not before_letter or nxt and (nxt in INITIALS or nxt in PAIRS)):
            pair = PAIRS.get(parts[2])
            if pair:
                own += [join(parts[0], parts[1], pair[0]) + pair[1], join(parts[0], parts[1]) + pair]
            elif parts[2] in INITIALS:
                own.append(join(parts[0], parts[1]) + parts[2])
        options.append(own)
    level = [("", 0)]
    for own in options:
        level = [(head + o, n + (k > 0)) for head, n in level for k, o in enumerate(own) if n + (k > 0) <= 4]
    return [t for t, n in sorted(level, key=lambda x: x[1]) if n][:cap]


@F.pandas_udf(T.StringType())
def norm_key_udf(text: pd.Series) -> pd.Series:
    return text.map(norm_key)


@F.pandas_udf(T.StringType())
def initials_udf(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else initials(t))


@F.pandas_udf(T.StringType())
def from_qwerty_udf(text: pd.Series) -> pd.Series:
    return text.map(from_qwerty)


@F.pandas_udf(T.ArrayType(T.StringType()))
def loose_readings_udf(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else loose_readings(t))


@F.pandas_udf(T.LongType())
def mask_udf(key: pd.Series) -> pd.Series:
    return key.map(lambda t: None if t is None else mask(t))
