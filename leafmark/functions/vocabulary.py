"""The default common-word vocabulary and the closed map of confusion corrections that follows from it."""

from __future__ import annotations

from functools import cache
from itertools import combinations

#: The words that count as common unless a caller gives others.
COMMON_WORDS = """
a about above across ad ads advertisement advertisements advertising after against all along already also always an
and any anybody anything are around article articles as ask asked asks at audience audiences back be because been
before being below between body book books both business but buyer buyers buying by call called calls came campaign
campaigns can chapter chapters child children client clients come comes coming company copy cost costs could customer
customers day days did do does doing during each even every everybody everything eye eyes false family feel feels felt
few find finds first for found from get gets give go goes gone good got gotten had hand hands has have having he head
headline headlines hello her here hey hi him his home house how i if in into is it its just knew know known knows lead
leads leave leaves left less letter letters life like list lists little look looked looking looks loss losses made
make makes making man many market marketing markets maybe me media men message mind money month months more most much
my name names never new no nobody not nothing now of offer offers often okay on once one only onto or order orders
other our out over page pages people person plan planning plans please price prices product products profit profitable
profits promote promotion promotional promotions prospect prospects purchase purchases quite rarely rather read
reading reads really response responses result results right said sale sales same saw say saying says see seem seemed
seems seen sees sell seller selling send sending sends sent service services she so some somebody something sometimes
sorry still stories story strategies strategy take taken takes target targets test tested testing tests than thank
thanks that the their them then there these they thing things think thinks this those thought through time to too took
toward tried tries true try trying two up upon us use used uses using usually value values very want wanted wanting
wants was way we week weeks well went were what when where which who whom whose why will with within without woman
women word words work working world would write writes written wrong wrote year years yes yet you your
"""

#: What is misread as what, in the order in which they are tried.
CONFUSIONS = (("rn", "m"), ("cl", "d"), ("vv", "w"), ("0", "o"), ("1", "l"))


@cache
def common_words() -> frozenset[str]:
    return frozenset(COMMON_WORDS.split())


def corrections(words: frozenset[str] | None = None) -> dict[str, str]:
    """Every string that the confusion rules turn into a common word: a rule replaces all its occurrences in a word that is
    not common, and the first rule that gives a common word wins. Found backwards from the words, so it is complete."""
    words = common_words() if words is None else words
    out = {}
    for word in words:
        for seen, meant in CONFUSIONS:
            at = [i for i in range(len(word)) if word.startswith(meant, i)]
            for n in range(1, len(at) + 1):
                for chosen in combinations(at, n):
                    misread = "".join(seen if i in chosen else c for i, c in enumerate(word))
                    if misread in words or misread in out:
                        continue
                    for s, m in CONFUSIONS:
                        fixed = misread.replace(s, m)
                        if fixed != misread and fixed in words:
                            out[misread] = fixed
                            break
    return out
