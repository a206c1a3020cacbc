"""Query and index tokens for full-text search."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def fts_tokens(query: Column, autocomplete: Column | bool = True) -> Column:
    """An array of (text, prefix): what is no letter, digit, space or hyphen splits; the last token is a prefix if asked for."""
    flag = F.lit(autocomplete) if isinstance(autocomplete, bool) else F.coalesce(autocomplete, F.lit(True))
    words = F.filter(F.split(F.lower(F.regexp_replace(query, r"[^\p{L}\p{N}\s-]", " ")), r"\s+"), lambda t: t != "")
    return F.transform(words, lambda t, i: F.struct(t.alias("text"), (flag & (i == F.size(words) - 1)).alias("prefix")))


@lru_cache(maxsize=1)
def fold_table() -> tuple[str, str]:
    """Letters of one base letter a-z and one mark, in the composed Latin blocks, and their base letters; letters with two marks stay."""
    pairs = []
    for code in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        low = chr(code).lower()
        parts = unicodedata.normalize("NFD", low)
        if len(low) == 1 and len(parts) == 2 and "a" <= parts[0] <= "z" and unicodedata.combining(parts[1]):
            pairs.append((low, parts[0]))
    pairs = sorted(set(pairs))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def index_terms(text: Column) -> Column:
    """The text's terms in order: lower case, single marks folded, split at anything but letters and digits."""
    return F.filter(F.split(F.translate(F.lower(text), *fold_table()), r"[^\p{L}\p{N}\p{Co}]+"), lambda t: t != "")


class Porter:
    """The stemmer of Porter's 1980 paper, by its measure of vowel-consonant sequences.

    Rules are data: (suffix, replacement) pairs in the order in which the longest match is taken.
    """

    # The rule tables of the paper.
    STEP2 = [("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"), ("logi", "log")]
    STEP3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", "")]
    STEP4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize"]

    @staticmethod
    def vowel(w: str, i: int) -> bool:
        return w[i] in "aeiou" or w[i] == "y" and i > 0 and not Porter.vowel(w, i - 1)

    @classmethod
    def measure(cls, w: str) -> int:
        kinds = [cls.vowel(w, i) for i in range(len(w))]
        return sum(a and not b for a, b in zip(kinds, kinds[1:], strict=False))

    @classmethod
    def has_vowel(cls, w: str) -> bool:
        return any(cls.vowel(w, i) for i in range(len(w)))

    @classmethod
    def short_end(cls, w: str) -> bool:
        """Consonant, vowel, consonant other than w, x, y."""
        n = len(w)
        return n >= 3 and not cls.vowel(w, n - 1) and cls.vowel(w, n - 2) and not cls.vowel(w, n - 3) and w[-1] not in "wxy"

    @classmethod
    def double_end(cls, w: str) -> bool:
        return len(w) >= 2 and w[-1] == w[-2] and w[-1] not in "aeiou"

    @classmethod
    def _longest(cls, w: str, rules: list[tuple[str, str]]) -> str:
        for suffix, new in sorted(rules, key=lambda r: -len(r[0])):
            if w.endswith(suffix):
                stem = w[: -len(suffix)]
                return stem + new if cls.measure(stem) > 0 else w
        return w

    @classmethod
    def stem(cls, w: str) -> str:
        if len(w.encode()) < 3:
            return w
        if w.endswith(("sses", "ies")) and w not in ("sses", "ies"):
            w = w[:-2]
        elif w.endswith("s") and not w.endswith("ss"):
            w = w[:-1]
        if w.endswith("eed") and len(w) > 3:
            w = w[:-1] if cls.measure(w[:-3]) > 0 else w
        else:
            for suffix in ("ed", "ing"):
                if w.endswith(suffix):
                    if cls.has_vowel(w[: -len(suffix)]):
                        w = w[: -len(suffix)]
                        if w.endswith(("at", "bl", "iz")):
                            w += "e"
                        elif cls.double_end(w) and w[-1] not in "lsz":
                            w = w[:-1]
                        elif cls.measure(w) == 1 and cls.short_end(w):
                            w += "e"
                    break
        if w.endswith("y") and cls.has_vowel(w[:-1]):
            w = w[:-1] + "i"
        w = cls._longest(w, cls.STEP2)
        w = cls._longest(w, cls.STEP3)
        for suffix in sorted(cls.STEP4, key=len, reverse=True):
            if w.endswith(suffix):
                stem = w[: -len(suffix)]
                if cls.measure(stem) > 1 and (suffix != "ion" or stem.endswith(("s", "t"))):
                    w = stem
                break
        if w.endswith("e"):
            m = cls.measure(w[:-1])
            if m > 1 or m == 1 and not cls.short_end(w[:-1]):
                w = w[:-1]
        if w.endswith("ll") and cls.measure(w[:-1]) > 1:
            w = w[:-1]
        return w


def porter(term: Column | str) -> Column:
    """The stem of a term; apply it to distinct terms and join the result back."""

    @F.pandas_udf("string")
    def run(batch: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else Porter.stem(t) for t in batch], dtype=object)

    return run(term)
