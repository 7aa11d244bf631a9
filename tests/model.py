"""Plain Python versions of the definitions, by tables and sets rather than by columns."""

import re
from collections import Counter
from itertools import chain

from leafmark.functions.vocabulary import common_words

GARBAGE = {*range(0xE000, 0xF900), *range(0xFFF0, 0x10000)}
#: Mean lengths of words and what they are worth, the first row that holds.
LENGTHS = ((lambda x: not 2.5 <= x <= 9, 0.3), (lambda x: not 3 <= x <= 7, 0.7), (lambda x: True, 1.0))
RULES = (("rn", "m"), ("cl", "d"), ("vv", "w"), ("0", "o"), ("1", "l"))


def score(text):
    """(score, words, share of common ones, share of garbage, mean length, reason)."""
    n = len(text.split())
    letters = Counter(filter(None, ("".join(c for c in w if c.isascii() and c.isalpha()).lower() for w in text.split())))
    if not letters:
        return 0.0, n, 0.0, 1.0, 0.0, "no alpha tokens" if n else "empty"
    known, size = sum(k for w, k in letters.items() if w in common_words()), letters.total()
    ratio, mean = known / size, sum(len(w) * k for w, k in letters.items()) / size
    garbage = sum(ord(c) in GARBAGE for c in text) / len(text)
    worth = next(value for holds, value in LENGTHS if holds(mean))
    points = 60 * ratio + 20 * worth - 100 * garbage + min(20.0, 5 * (n / 50))
    scrambled = n > 30 and mean < 3 and ratio < 0.15
    return sorted((0.0, points * 0.1 if scrambled else points, 100.0))[1], n, ratio, garbage, mean, ""


def meant(word):
    """What a word was misread from, or None."""
    if word in common_words():
        return None
    return next((fixed for fixed in (word.replace(*rule) for rule in RULES) if fixed != word and fixed in common_words()), None)


def correct(text):
    out = re.split(r"(\S+)", text)
    for i, token in enumerate(out[1::2]):
        bare = token.lower().strip(".,;:!?\"'()-")
        fixed = meant(bare) if token[0].isalpha() else None
        if fixed:
            shape = str.upper if token.isupper() else str.capitalize if token[0].isupper() else str
            out[2 * i + 1] = shape(fixed) + token[len(bare) :]
    return "".join(out)


def boilerplate(pages):
    found = Counter(chain.from_iterable({x.strip() for x in p.split("\n")} for p in pages))
    return {x for x, n in found.items() if len(pages) >= 20 and n >= 5 and n >= len(pages) // 5 and len(x) in range(3, 81)}


def strip_lines(text, lines):
    def stays(x):
        return x not in lines and not (len(x) in range(1, 5) and x.isdecimal())

    return "\n".join(x for x in text.split("\n") if stays(x.strip()))
