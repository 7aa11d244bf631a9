"""Conservative correction of misread words: a lookup in a closed map, token by token, white space untouched."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from leafmark.functions import text as T
from leafmark.functions.vocabulary import CONFUSIONS, common_words, corrections

MARKS = ".,;:!?\"'()-"


def either(words: Iterable[str]) -> str:
    """A pattern of words of a to z, 0 and 1 in any case, by their common beginnings."""
    rest = defaultdict(list)
    for w in words:
        rest[w[:1]].append(w[1:])
    end = "?" if rest.pop("", None) else ""
    # \x{212a} is the other capital of k
    ways = [f"[{c}{c.upper()}{chr(92) + 'x{212a}' if c == 'k' else ''}]{either(after) if any(after) else ''}" for c, after in sorted(rest.items())]
    return f"(?:{'|'.join(ways)}){end}"


def correct_misread_words(c: Column | str, words: Iterable[str] | None = None) -> Column:
    """The text is cut before each token that may stand in the map, marks behind it left out (few texts have one at all; the others
    pass whole); of each piece only the first token is looked up, what follows it passes whole. Tokens that begin with a digit are none."""
    fixes = corrections(common_words() if words is None else frozenset(words))
    keys = sorted(fixes)
    table = F.create_map(*[F.lit(x) for k in keys for x in (k, fixes[k])])

    def fix(piece: Column) -> Column:
        token = F.regexp_extract(piece, f"\\A({T.INK}*)", 1)
        clean = F.btrim(F.lower(token), F.lit(MARKS))
        meant = table[clean]
        upper = (token == F.upper(token)) & (token != F.lower(token))
        first = F.substring(token, 1, 1)
        capital = (first == F.upper(first)) & (first != F.lower(first))
        cased = F.when(upper, F.upper(meant)).when(capital, F.concat(F.upper(F.substring(meant, 1, 1)), F.substr(meant, F.lit(2)))).otherwise(meant)
        return F.when(clean.isin(keys) & token.rlike(r"^\p{L}"), F.concat(cased, F.substr(piece, F.length(clean) + 1))).otherwise(piece)

    found = [k for k in keys if not k[0].isdigit()]
    if not found:
        return T.text_of(c)
    if all(re.fullmatch("[a-z0-9]+", k) for k in found):
        misread = f"{either(found)}[{re.escape(MARKS)}]*+(?:{T.SPACE}|\\z)"
        # confusions are few, so they are looked for first and the token's beginning behind them
        any_seen = "|".join("".join(f"[{c}{c.upper()}]" for c in seen) for seen, _ in CONFUSIONS)
        some = rf"(?:{any_seen})(?<=(?:\A|{T.SPACE})(?={misread})[a-zA-Z0-9\x{{212a}}]{{1,{max(map(len, found))}}})"
    else:  # other letters have cases of their own
        misread = some = f"{T.INK}*?(?i:{'|'.join(seen for seen, _ in CONFUSIONS)})"
    pieces = lambda x: F.split(x, f"(?:(?<={T.SPACE})|\\A)(?={misread})")
    return T.once(T.text_of(c), lambda x: F.when(x.rlike(some), F.array_join(F.transform(pieces(x), fix), "")).otherwise(x))
