"""Ranked course search.

A query word compiles on the driver to regular expressions over an index of marked keys, so the candidates and the
places of whole matches are found in the JVM: a lone initial stands for every syllable it begins, and the last syllable
of a word that is still being typed for every syllable that continues it. A key has HEAD before its first character and
WORD before each other character that starts a word. Only abbreviations with gaps need a Python pass, over rows that a
bit mask and a subsequence pattern let through.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waymark.functions import hangul as H
from waymark.operators.catalog import ranked

HEAD, WORD = "\u0001", "\u0002"
MARK = f"[{HEAD}{WORD}]?"
TAG = re.compile(r"^\s*[(\[][^)\]]{1,8}[)\]]\s*")
#: Scores of the kinds of match, and what an inside match that looks like an abbreviation loses.
INITIALS_SCORE, HEAD_GAP, DEPT, GAP, ID, PROF, SPECIAL, LATE = 3.0, 3.2, 3.4, 4.0, 5.0, 7.0, 8.0, 1.8
#: Whole-match scores (typed out, still typing) at the head, at a word, inside.
PLACES = ((0.0, 1.5), (1.0, 2.5), (2.0, 4.5))
#: A course's number may be typed without its dots, from so many characters on, at so much more.
BARE_LENGTH, BARE_EXTRA = 6, 0.3
ALIAS_EXTRA, LAYOUT_EXTRA, LOOSE_EXTRA, WORD_EXTRA = 0.2, 0.5, 1.5, 0.01


def marked_key(text: str | None, tag: bool = False) -> str:
    """A name's key with its marks; a tag in brackets before the name starts no word, and the head comes after it."""
    text = text or ""
    skip = len(m[0]) if tag and (m := TAG.match(text)) else 0
    out, seen = [], False
    for c, i, word in H.key_chars(text):
        if i >= skip and not seen:
            out.append(HEAD)
            seen = True
        elif word and i >= skip:
            out.append(WORD)
        out.append(c)
    return "".join(out)


@F.pandas_udf(T.StringType())
def _marked(text: pd.Series) -> pd.Series:
    return text.map(lambda t: marked_key(t, tag=True))


def build_index(courses: DataFrame) -> DataFrame:
    """courses (id, name, dept, profs array, section_nos array): marked keys, masks, and `place`, the order of names."""
    bare = F.regexp_replace("name", r"^\s*[(\[][^)\]]{1,8}[)\]]\s*", "")
    out = courses.withColumn("name_key", _marked("name")).withColumn("dept_key", _marked("dept"))
    # A search ranks one campus's courses; their order is a property of the index.
    out = out.withColumn("prof_keys", F.transform("profs", lambda p: F.lower(F.regexp_replace(p, r"\s", ""))))
    out = out.withColumn("mask", H.mask_udf(F.regexp_replace("name_key", f"[{HEAD}{WORD}]", "")))
    return ranked(out, [bare, F.col("id")], "place")


def _class(ch: str) -> str:
    """Pattern of the characters that a typed one stands for."""
    at = H.INITIALS.find(ch)
    if at >= 0:
        lo = chr(H.FIRST + at * 588)
        return f"[{ch}{lo}-{chr(ord(lo) + 587)}]"
    return re.escape(ch)


def _typing_class(ch: str) -> str | None:
    """Syllables whose letters begin with those of ch, without ch itself."""
    if not H.split(ch):
        return None
    typed = H.letters(ch)
    block = H.FIRST + (ord(ch) - H.FIRST) // 588 * 588
    more = [c for c in map(chr, range(block, block + 588)) if c != ch and H.letters(c).startswith(typed)]
    return f"[{''.join(more)}]" if more else None


@dataclass
class Pattern:
    """Ways that a word may stand whole in a key."""

    key: str
    whole: str
    typing: list[str] = field(default_factory=list)
    gapped: str = ""
    mask: int = 0


def compile_word(word: str, typing: bool) -> Pattern | None:
    key = H.norm_key(word)
    if not key:
        return None
    parts = [_class(c) for c in key]
    partial = []
    if typing and (more := _typing_class(key[-1])):
        partial.append(MARK.join([*parts[:-1], more]))
    if typing and (s := H.split(key[-1])) and s[2]:
        # The last consonant may begin the next syllable.
        pair = H.PAIRS.get(s[2])
        stem, rest = (H.join(s[0], s[1], pair[0]), pair[1]) if pair else (H.join(s[0], s[1]), s[2])
        if rest in H.INITIALS:
            partial.append(MARK.join([*parts[:-1], stem, _class(rest)]))
    return Pattern(key, MARK.join(parts), partial, ".*".join([_class(c) for c in key]), H.mask(key))


def _bare_length(text: Column) -> Column:
    return F.length(F.regexp_replace(text, f"[{HEAD}{WORD}]", ""))


def whole_match(key: Column, p: Pattern) -> Column:
    """struct(score, edge, partial): the best place of a word in a key, or null."""
    options = []
    for partial, patterns in ((0, [p.whole]), (1, p.typing)):
        for pattern in patterns:
            for (scores, lead, edge) in ((PLACES[0], HEAD, True), (PLACES[1], WORD, True), (PLACES[2], "", False)):
                found = F.regexp_instr(key, F.lit(f"{lead}{pattern}"))
                at = _bare_length(F.substring(key, F.lit(1), found - 1))
                score = F.lit(scores[partial]) + at * 0.001 + _bare_length(key) * 0.0001
                options.append(F.when(found > 0, F.struct(score.alias("score"), F.lit(edge).alias("edge"), F.lit(bool(partial)).alias("partial"))))
    return F.least(*options) if len(options) > 1 else options[0]


#: What a place is worth at a word's start, more at the head, directly behind the last one, behind a gap,
#: and how much less the first place is worth for each character before it.
GAP_START, GAP_HEAD, GAP_RUN, GAP_JUMP, GAP_LATE = 3.0, 2.0, 4.0, -1.0, 0.05


def _behind(values: np.ndarray, by: int) -> np.ndarray:
    """Each place's value `by` places before it; none (minus infinity) before the first."""
    return np.concatenate([np.full(min(by, len(values)), -np.inf), values[: max(0, len(values) - by)]])


def gapped_alignment(query: list[re.Pattern[str]], key: str) -> tuple[list[int], list[bool], list[bool]] | None:
    """Places of the query's characters in a key in order, preferring word starts and runs; None if they aren't in it.

    One pass over all places for each character of the query: a place follows directly on the one before it, or jumps
    from the best place further back, which a running maximum has; of equal values the direct one, then the earlier.
    """
    bare = [i for i, c in enumerate(key) if c not in (HEAD, WORD)]
    if not bare:
        return None
    chars, at = [key[i] for i in bare], np.arange(len(bare))
    led = [key[:i][len(key[:i].rstrip(HEAD + WORD)) :] for i in bare]
    word, head = np.array([bool(x) for x in led]), np.array([HEAD in x for x in led])
    start = GAP_START * word
    fits = [np.array([bool(q.fullmatch(c)) for c in chars]) for q in query]
    value, came = np.where(fits[0], start + GAP_HEAD * head - GAP_LATE * at, -np.inf), []
    for fit in fits[1:]:
        top = np.maximum.accumulate(value)
        leader = np.maximum.accumulate(np.where(top > _behind(top, 1), at, 0))
        run, jump = _behind(value, 1) + GAP_RUN, _behind(top, 2) + GAP_JUMP + start
        came.append(np.where(run >= jump, at - 1, np.concatenate([[0, 0], leader])[: len(at)]))
        value = np.where(fit, np.maximum(run, jump), -np.inf)
    if value.max() == -np.inf:
        return None
    places = [int(value.argmax())]
    for before in reversed(came):
        places.insert(0, int(before[places[0]]))
    return places, word.tolist(), head.tolist()


def gapped_score(query: list[re.Pattern[str]], key: str) -> float | None:
    found = gapped_alignment(query, key)
    if not found:
        return None
    places, word, head = found
    pieces = [i for k, i in enumerate(places) if k == 0 or i != places[k - 1] + 1]
    at_words = all(word[i] or head[i] for i in pieces)
    tier = INITIALS_SCORE + (0.0 if head[places[0]] else 0.2) if at_words else HEAD_GAP if head[places[0]] else GAP
    spread = places[-1] - places[0] - (len(places) - 1)
    return tier + 0.1 * (len(pieces) - 1) + min(0.1 * spread, 1.0) + 0.002 * places[0] + 0.0001 * len(word)


def _gapped_udf(key: str):
    query = [re.compile(_class(c)) for c in key]

    @F.pandas_udf(T.DoubleType())
    def score(keys: pd.Series) -> pd.Series:
        return keys.map(lambda k: gapped_score(query, k)).astype(float)

    return score


def match_word(index: DataFrame, word: str, typing: bool, special: Column | None = None) -> DataFrame:
    """(id, place, score, late, edge): courses that a word matches, and their score if inside matches count as abbreviations."""
    p = compile_word(word, typing)
    if special is not None:
        return index.where(special).select("id", "place", F.lit(SPECIAL).alias("score"), F.lit(SPECIAL).alias("late"), F.lit(True).alias("edge"))
    if p is None:
        return index.limit(0).select("id", "place", F.lit(0.0).alias("score"), F.lit(0.0).alias("late"), F.lit(True).alias("edge"))
    has_hangul = any(H.split(c) or c in H.INITIALS for c in p.key)
    whole = whole_match(F.col("name_key"), p)
    rows = index.withColumn("name_hit", whole)
    inside = F.col("name_hit").isNotNull() & ~F.col("name_hit.edge") & ~F.col("name_hit.partial")
    gap = F.lit(None).cast("double")
    if has_hangul and len(p.key) > 1:
        fits = (F.col("mask").bitwiseAND(F.lit(p.mask)) == p.mask) & F.col("name_key").rlike(p.gapped) & (F.col("name_hit").isNull() | inside)
        gap = F.when(fits, _gapped_udf(p.key)(F.when(fits, F.col("name_key")).otherwise(F.lit(""))))
    dept = F.when(F.lit(len(p.key) >= 2 and not word.endswith("학")), F.regexp_instr("dept_key", F.lit(f"[{HEAD}{WORD}]{p.whole}")))
    dept_score = F.when(dept > 0, DEPT + 0.001 * _bare_length(F.substring(F.col("dept_key"), F.lit(1), dept - 1)))
    full, begins, has = _prof_hits(p)
    prof = F.when(F.lit(len(p.key) >= 2), F.when(full, 1.5).when(begins, PROF - 0.2).when(has, PROF))
    low, bare = word.lower(), word.lower().replace(".", "")
    by_id = F.when(F.lit(not has_hangul and len(p.key) >= 3), _id_score(F.lower("id"), low, 0.0))
    if not has_hangul and len(bare) >= BARE_LENGTH:
        by_id = F.coalesce(by_id, _id_score(F.regexp_replace(F.lower("id"), r"\.", ""), bare, BARE_EXTRA))
    by_no = F.when(F.lit(bool(re.fullmatch(r"\d{3}", word))) & F.array_contains("section_nos", word), 4.5)
    name = F.col("name_hit.score")
    other = [gap, dept_score, prof, by_id, by_no]
    score = F.least(name, *other)
    late = F.least(F.when(inside & F.lit(has_hangul and len(p.key) > 1), name + LATE).otherwise(name), *other)
    out = rows.select("id", "place", score.alias("score"), late.alias("late"), F.coalesce("name_hit.edge", F.lit(False)).alias("edge"))
    return out.where("score IS NOT NULL")


def _id_score(key: Column, word: str, extra: float) -> Column:
    """A course's number: whole, at the begin of a part (or behind a letter that begins it), or inside; null elsewhere."""
    at = F.instr(key, word)
    part = (at == 1) | (F.substring(key, at - 1, F.lit(1)) == ".") | ((at == 2) & key.rlike("^[a-z]"))
    return F.when(at > 0, F.when(key == word, 0.5).when(part, ID).otherwise(ID + 0.5) + extra)


def _prof_hits(p: Pattern) -> list[Column]:
    def some(pattern: str) -> Column:
        return F.exists("prof_keys", lambda k: F.rlike(k, F.lit(pattern)))

    return [some(f"^{p.whole}$"), some(f"^{p.whole}"), some(p.whole)]


def special_filter(word: str, classes: tuple[str, ...] = ("교양", "전선", "전필", "교직", "일선", "공통")) -> Column | None:
    """Words that filter: a class, '<n>학점' credits, '<n>동' buildings. Needs columns cls, credit, buildings."""
    if word in classes:
        return F.col("cls") == word
    if word == "전공":
        return F.col("cls").isin("전선", "전필")
    if m := re.fullmatch(r"(\d+(?:\.\d+)?)학점", word):
        return F.col("credit") == float(m[1])
    if m := re.fullmatch(r"[#*]?(\d+(?:-\d+)?)동", word):
        return F.array_contains("buildings", m[1])
    return None


def _best(a: DataFrame, b: DataFrame, extra: float) -> DataFrame:
    """Both matches' better scores per course, b's later by extra."""
    b = b.withColumn("score", F.col("score") + extra).withColumn("late", F.col("late") + extra)
    return a.unionByName(b).groupBy("id", "place").agg(F.min("score").alias("score"), F.min("late").alias("late"), F.max("edge").alias("edge"))


def search(index: DataFrame, text: str, aliases: dict[str, str] | None = None) -> DataFrame:
    """(id, score, place) of the courses that match every word; order by score, place. Blank text: none.

    A trailing space ends the last word. The whole phrase in a name beats its words. An inside match counts as an
    abbreviation unless the word stands at a word's start in some result. Words read with detached final consonants
    count only where nothing else is found.
    """
    words = text.split()
    typing = bool(text) and not text[-1].isspace()
    if not words:
        return index.limit(0).select("id", F.lit(0.0).alias("score"), "place")

    def one(word: str, last: bool, extra_words: list[tuple[str, float]]) -> DataFrame:
        special = special_filter(word) if {"cls", "credit", "buildings"} <= set(index.columns) else None
        out = match_word(index, word, last, special)
        for other, extra in extra_words:
            out = _best(out, match_word(index, other, last), extra)
        return out

    def run(loose: bool) -> DataFrame:
        both = None
        for i, w in enumerate(words):
            last = typing and i == len(words) - 1
            more = [(aliases[w], ALIAS_EXTRA)] if aliases and w in aliases else []
            if q := H.from_qwerty(w):
                more.append((q, LAYOUT_EXTRA))
            more += [(x, LOOSE_EXTRA) for x in H.loose_readings(w, 12 if loose else 4, not loose)]
            hit = one(w, last, more)
            # Whether some result has the word at a word's start decides for all of them.
            hit = hit.crossJoin(F.broadcast(hit.agg(F.max("edge").alias("any_edge"))))
            hit = hit.withColumn("s", F.when(F.col("any_edge"), F.col("score")).otherwise(F.col("late"))).select("id", "place", F.col("s").alias(f"s{i}"))
            both = hit if both is None else both.join(hit, ["id", "place"])
        total = sum(F.col(f"s{i}") for i in range(len(words))) / len(words) + WORD_EXTRA * (len(words) - 1)
        return both.select("id", total.alias("score"), "place")

    out = run(False)
    if len(words) > 1 and (p := compile_word("".join(words), typing)):
        phrase = index.withColumn("hit", whole_match(F.col("name_key"), p)).where("hit IS NOT NULL").select("id", F.col("hit.score").alias("score"), "place")
        out = out.join(phrase.select("id"), "id", "left_anti").select("id", "score", "place").unionByName(phrase)
    if out.isEmpty() and any(H.loose_readings(w) for w in words):
        out = run(True)
    return out


def merge_ranges(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Half-open ranges without overlaps or touching neighbours, in order."""
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        elif a < b:
            out.append([a, b])
    return [(a, b) for a, b in out]


def split_marks(text: str, ranges: list[tuple[int, int]]) -> list[tuple[str, bool]]:
    """The text in pieces, marked or not."""
    out, at = [], 0
    for a, b in merge_ranges(ranges):
        out += [(text[at:a], False)] * (a > at) + [(text[a:b], True)]
        at = b
    return out + [(text[at:], False)] * (at < len(text))


def highlights(text: str, word: str, typing: bool = False) -> list[tuple[int, int]]:
    """Places in the original text of a word's first best match."""
    p = compile_word(word, typing)
    chars = H.key_chars(text)
    if not p or not chars:
        return []
    key, places = "", []
    for c, i, word_start in chars:
        if word_start:
            key += WORD
            places.append(i)
        key += c
        places.append(i)
    for pattern in [p.whole, *p.typing]:
        m = re.search(WORD + pattern, key) or re.search(pattern, key)
        if m:
            return merge_ranges([(i, i + 1) for k, i in enumerate(places) if m.start() <= k < m.end() and key[k] != WORD])
    return []
