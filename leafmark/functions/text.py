"""Text columns: encoding, garbage, tokens, lines, slugs, formats. Nulls are empty text."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What Python's str.split and str.strip take as white space, as the inside of a character class.
WS = r"\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
#: The same class and its complement for Java, which tests members one after another: the common case is decided first.
SPACE = rf"[\x{{0}}-\x{{20}}\x{{85}}-\x{{3000}}&&[{WS}]]"
INK = rf"[\x{{21}}-\x{{84}}[^{WS}]]"
#: White space but the blank, and white space within a line.
NO_BLANK = rf"[\x{{9}}-\x{{1f}}\x{{85}}-\x{{3000}}&&[{WS}]]"
IN_LINE = rf"[\x{{0}}-\x{{9}}\x{{b}}-\x{{20}}\x{{85}}-\x{{3000}}&&[{WS}]]"
#: The members of the class, to trim by.
WS_CHARS = "".join(chr(c) for a, b in re.findall(r"\\x\{(\w+)\}(?:-\\x\{(\w+)\})?", WS) for c in range(int(a, 16), int(b or a, 16) + 1))
GARBAGE = r"[\x{E000}-\x{F8FF}\x{FFF0}-\x{FFFF}]"

#: Private-use and Unicode ligatures, controls and marks.
LIGATURES = {
    "\uE000": "fi",
    "\uE001": "fl",
    "\uE002": "ff",
    "\uE003": "ffi",
    "\uE004": "ffl",
    "\uE005": "ft",
    "\uE006": "st",
    "\uE007": "ct",
    "\uE062": "Th",
    "\uE0BB": "Th",
    "\uE09D": "ft",
    "\uE117": "ft",
    "\uFB00": "ff",
    "\uFB01": "fi",
    "\uFB02": "fl",
    "\uFB03": "ffi",
    "\uFB04": "ffl",
    "\uFB05": "st",
    "\uFB06": "st",
}
ONE_TO_ONE = {
    "\u00A0": " ",
    "\u2028": "\n",
    "\uF0B7": "•",
    "\uF0A7": "•",
    "\uF0D8": "•",
    "\uF020": " ",
    "\u2018": "'",
    "\u2019": "'",
    "\u201C": '"',
    "\u201D": '"',
    "\u2013": "-",
    "\u0091": "'",
    "\u0092": "'",
    "\u0093": '"',
    "\u0094": '"',
    "\u0096": "-",
    "\u0097": "—",
}
DELETED = "\u00AD\uFEFF"
LONGER = {"\u2029": "\n\n", "\u2026": "...", "\u0085": "..."}


def text_of(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def once(c: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, however often f names it."""
    return F.get(F.transform(F.array(c), f), 0)


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WS_CHARS))


def _any_of(chars: str) -> str:
    """A class of characters beyond ASCII, which is left out first."""
    return rf"[\x{{80}}-\x{{FFFF}}&&[{''.join(f'\\x{{{ord(c):x}}}' for c in chars)}]]"


def normalize_encoding(c: Column | str) -> Column:
    """Ligatures and marks in plain form; then glyph references, which a deletion can make. Each step is taken only by texts that hold
    something for it; one look tells those that hold nothing for the first two."""
    several = LIGATURES | LONGER
    moved = "".join(ONE_TO_ONE) + DELETED

    def longer(x: Column) -> Column:
        out = x
        for seen, meant in several.items():
            out = F.replace(out, F.lit(seen), F.lit(meant))
        return F.when(x.rlike(_any_of("".join(several))), out).otherwise(x)

    def marks(x: Column) -> Column:
        return F.when(x.rlike(_any_of(moved)), F.translate(x, moved, "".join(ONE_TO_ONE.values()))).otherwise(x)

    plain = once(text_of(c), lambda x: F.when(x.rlike(_any_of("".join(several) + moved)), once(longer(x), marks)).otherwise(x))
    return once(plain, lambda x: F.when(F.contains(x, F.lit("(cid:")), F.regexp_replace(x, r"(?U)\(cid:\d+\)", "")).otherwise(x))


def strip_garbage(c: Column | str) -> Column:
    return F.regexp_replace(text_of(c), GARBAGE, "")


def tokens(c: Column | str) -> Column:
    return F.filter(F.split(text_of(c), f"{SPACE}+"), lambda x: x != "")


def blanks(c: Column | str) -> Column:
    """The text with a blank for each white space: what is split at blanks needs no regular expression."""
    return F.regexp_replace(text_of(c), NO_BLANK, " ")


def n_parts(c: Column) -> Column:
    """How many of the parts between blanks are not empty."""
    return F.size(F.array_remove(F.split(c, " "), ""))


def n_tokens(c: Column | str) -> Column:
    """The number of tokens(c)."""
    return n_parts(blanks(c))


def letters(c: Column) -> Column:
    """ASCII letters of a text whose white space is blanks, in lower case, and the blanks. One replacement over the text, not one for
    each token. The class names what goes: Java takes six times as long for the complement of what stays."""
    return F.lower(F.regexp_replace(c, r"[\x{0}-\x{1f}\x{21}-\x{40}\x{5b}-\x{60}\x{7b}-\x{10ffff}]+", ""))


def alpha_tokens(c: Column | str) -> Column:
    """ASCII letters of the tokens of a text, in lower case."""
    return F.array_remove(F.split(letters(blanks(c)), " "), "")


def collapse_blank_lines(c: Column) -> Column:
    return strip(once(c, lambda x: F.when(F.contains(x, F.lit("\n\n\n")), F.regexp_replace(x, r"\n{3,}", "\n\n")).otherwise(x)))


def drop_lines(c: Column, lines: Column) -> Column:
    """Without lines that, stripped, are among `lines` or a number of one to four digits; others keep their indentation. Texts are
    taken apart only if there are `lines` or one of theirs is such a number."""
    gone = lambda x: once(strip(x), lambda s: F.array_contains(lines, s) | s.rlike(r"(?U)\A\d{1,4}\z"))
    number = rf"(?U)(?:\A|\n){IN_LINE}*+\d{{1,4}}{IN_LINE}*+(?:\n|\z)"
    left = lambda x: F.array_join(F.filter(F.split(x, "\n"), lambda y: ~gone(y)), "\n")
    return once(c, lambda x: F.when((F.size(lines) > 0) | x.rlike(number), left(x)).otherwise(x))


def stem(name: Column) -> Column:
    """A file's name without its last suffix (a leading dot begins no suffix)."""
    return F.regexp_replace(name, r"(?s)(?<=.)\.[^.]+\z", "")


def slugify(name: Column) -> Column:
    """Output name of a file. Names without ASCII letters or digits collide, as do names that differ by suffix."""
    s = F.regexp_replace(F.lower(stem(name)), rf"[^a-z0-9\-{WS}]", "")
    s = F.regexp_replace(strip(s), f"[{WS}]+", "-")
    return F.concat(F.regexp_replace(s, "-+", "-"), F.lit(".md"))


def package_slug(name: Column) -> Column:
    s = F.regexp_replace(strip(F.lower(text_of(name))), rf"(?U)[^\w\-{WS}]", "")
    s = F.regexp_replace(F.regexp_replace(s, f"[{WS}_]+", "-"), "-+", "-")
    s = F.regexp_replace(s, r"\A-+|-+\z", "")
    return F.when(s == "", "skill").otherwise(s)


def format_eta(seconds: Column) -> Column:
    s = seconds.cast("long")
    return (
        F.when(seconds.isNull() | F.isnan(seconds) | (seconds < 0), "…")
        .when(seconds < 60, F.concat(s.cast("string"), F.lit("s")))
        .when(seconds < 3600, F.concat((s / 60).cast("long").cast("string"), F.lit("m "), (s % 60).cast("string"), F.lit("s")))
        .otherwise(F.concat((s / 3600).cast("long").cast("string"), F.lit("h "), (s % 3600 / 60).cast("long").cast("string"), F.lit("m")))
    )


def whole(x: Column) -> Column:
    """A number without decimals, halves to even, as text."""
    return F.bround(x, 0).cast("long").cast("string")


def thousands(n: Column) -> Column:
    return F.format_number(n, 0)
