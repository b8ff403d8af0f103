"""Tokens, hashes and names, as Column expressions; stems, over distinct words only."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType

from ..fixed import MAX_TERM_CHARS, MAX_TERMS, MAX_TEXT_BYTES, STOPWORDS, TRUNCATION_MARK

_BREAKS = r"(?<=\p{IsLowercase})(?=\p{IsUppercase})|(?<=\p{IsUppercase})(?=\p{IsUppercase}\p{IsLowercase})|(?<=\p{IsAlphabetic})(?=\p{N})|(?<=\p{N})(?=\p{IsAlphabetic})"


def tokenize(text: Column) -> Column:
    """Words of a question: cut at other characters, between camel-case words and between letters and digits; lower case."""
    apart = F.regexp_replace(text, _BREAKS, " ")
    words = F.filter(F.split(apart, r"[^\p{IsAlphabetic}\p{N}]+"), lambda w: w != "")
    return F.transform(words, lambda w: F.substring(F.lower(F.translate(w, "Σ", "σ")), 1, MAX_TERM_CHARS))


def is_stopword(word: Column) -> Column:
    return word.isin(STOPWORDS)


def select_terms(tokens: Column) -> Column:
    """Search terms: first occurrences, without stopwords and single letters, limited."""
    kept = F.filter(tokens, lambda t: ((F.length(t) >= 2) | t.rlike(r"^\p{N}+$")) & ~is_stopword(t))
    return F.slice(F.array_distinct(kept), 1, MAX_TERMS)


def match_expression(terms: Column) -> Column:
    """The terms as quoted literals joined by OR."""
    some = F.slice(F.filter(terms, lambda t: t != ""), 1, MAX_TERMS)
    return F.array_join(F.transform(some, lambda t: F.concat(F.lit('"'), F.replace(t, F.lit('"'), F.lit('""')), F.lit('"'))), " OR ")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def content_hash(role: Column, kind: Column, text: Column) -> Column:
    """First 16 bytes, in hex, of the SHA-256 of role, kind and text with zero bytes between."""
    zero = F.unhex(F.lit("00"))
    return F.substring(F.sha2(F.concat(F.encode(role, "UTF-8"), zero, F.encode(kind, "UTF-8"), zero, F.encode(text, "UTF-8")), 256), 1, 32)


def repo_name(cwd: Column) -> Column:
    """Last component of a path that is neither empty nor ``~``."""
    parts = F.filter(F.split(F.translate(cwd, "\\", "/"), "/"), lambda p: (p != "") & (p != "~"))
    return F.try_element_at(parts, F.lit(-1))


def single_line(text: Column) -> Column:
    return F.translate(text, "\r\n`", "   ")


def bound_text(text: Column, most: int = MAX_TEXT_BYTES) -> tuple[Column, Column]:
    """Text of at most ``most`` bytes, cut before a character's end and marked, and whether it was cut."""
    end = most - len(TRUNCATION_MARK.encode())
    raw = F.encode(text, "UTF-8")
    cuts = [F.try_validate_utf8(F.substring(raw, 1, end - i).cast("string")) for i in range(4)]
    long = F.octet_length(text) > most
    return F.when(long, F.concat(F.coalesce(*cuts), F.lit(TRUNCATION_MARK))).otherwise(text), long


def document_tokens(text: Column) -> Column:
    """Words as the inverted index has them: runs of letters and digits, lower case.  Marks belong to their letters."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}\p{M}\p{Co}]+"), lambda w: w != "")


_VOWEL = re.compile(r"[aeiou]")


def _consonants(word: str) -> str:
    """The word as a string of c and v; y after a consonant is a vowel."""
    out: list[str] = []
    for i, ch in enumerate(word):
        out.append("v" if ch in "aeiou" or ch == "y" and i and out[-1] == "c" else "c")
    return "".join(out)


def _measure(stem: str) -> int:
    return len(re.findall("v+c", _consonants(stem)))


def _short(stem: str) -> bool:
    return len(stem) >= 3 and _consonants(stem)[-3:] == "cvc" and stem[-1] not in "wxy"


# The suffixes of Porter's algorithm (1980), step by step, longest first where one ends another
_STEP2 = "ational:ate tional:tion enci:ence anci:ance izer:ize logi:log bli:ble alli:al entli:ent eli:e ousli:ous ization:ize ation:ate ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble"
_STEP3 = "icate:ic ative: alize:al iciti:ic ical:ic ful: ness:"
_STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize"
_RULES = [sorted((r.split(":") for r in step.split()), key=lambda r: -len(r[0])) for step in (_STEP2, _STEP3)]
_ENDINGS = sorted(_STEP4.split(), key=lambda s: -len(s))
_RULED, _ENDED = [tuple(r[0] for r in rules) for rules in _RULES], tuple(_ENDINGS)  # one call tells that none of them fits


def porter(word: str) -> str:
    """Porter's stem of a lower-case word, byte by byte; words of other than 3 to 64 bytes stay as they are."""
    w = word.encode().decode("latin-1")
    return _porter(w).encode("latin-1").decode() if 3 <= len(w) <= 64 else word


def _porter(w: str) -> str:
    if w.endswith("sses") or w.endswith("ies") and len(w) > 3:
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    cut = None
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) else w
    elif w.endswith("ed") and "v" in _consonants(w[:-2]):
        cut = w[:-2]
    elif w.endswith("ing") and "v" in _consonants(w[:-3]):
        cut = w[:-3]
    if cut is not None:
        if cut.endswith(("at", "bl", "iz")):
            w = cut + "e"
        elif len(cut) > 1 and cut[-1] == cut[-2] and _consonants(cut)[-1] == "c" and cut[-1] not in "lsz":
            w = cut[:-1]
        else:
            w = cut + "e" if _measure(cut) == 1 and _short(cut) else cut
    if w.endswith("y") and "v" in _consonants(w[:-1]):
        w = w[:-1] + "i"
    for rules, ruled in zip(_RULES, _RULED):
        for rule in rules if w.endswith(ruled) else ():
            if w.endswith(rule[0]):
                if _measure(w[: -len(rule[0])]):
                    w = w[: -len(rule[0])] + rule[1]
                break
    for suffix in _ENDINGS if w.endswith(_ENDED) else ():
        if w.endswith(suffix):
            stem = w[: -len(suffix)]
            if _measure(stem) > 1 and (suffix != "ion" or stem.endswith(("s", "t"))):
                w = stem
            break
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or m == 1 and not _short(w[:-1]):
            w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w


def fold(word: str) -> str:
    """Without diacritics."""
    if word.isascii():
        return word.lower()
    return "".join(c for c in unicodedata.normalize("NFD", word.lower()) if unicodedata.category(c) != "Mn")


@F.pandas_udf(StringType())
def stem(words: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Folded Porter stems; meant for columns of distinct words."""
    for series in words:
        yield series.map(lambda w: None if w is None else porter(fold(w)))
