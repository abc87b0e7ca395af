"""The English Snowball stemmer (Porter2), written from its published description.  Other languages pass unchanged."""

from __future__ import annotations

from functools import lru_cache

_VOWELS = frozenset("aeiouy")
_DOUBLES = ("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")
_EXCEPTIONS = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"} | {w: w for w in ("sky", "news", "howe", "atlas", "cosmos", "bias", "andes")}
_AFTER_1A = frozenset(("inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"))
_STEP2 = (("ization", "ize"), ("ational", "ate"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"), ("tional", "tion"), ("biliti", "ble"), ("lessli", "less"), ("entli", "ent"), ("ation", "ate"), ("alism", "al"), ("aliti", "al"), ("ousli", "ous"), ("iviti", "ive"), ("fulli", "ful"), ("enci", "ence"), ("anci", "ance"), ("abli", "able"), ("izer", "ize"), ("ator", "ate"), ("alli", "al"), ("bli", "ble"), ("ogi", "og"), ("li", ""))
_STEP3 = (("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ative", ""), ("ical", "ic"), ("ness", ""), ("ful", ""))
_STEP4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic")


def _vowel(c: str) -> bool:
    return c in _VOWELS


def _regions(w: str) -> tuple[int, int]:
    def after(start: int) -> int:
        for k in range(start + 1, len(w)):
            if not _vowel(w[k]) and _vowel(w[k - 1]):
                return k + 1
        return len(w)

    r1 = next((len(p) for p in ("gener", "commun", "arsen") if w.startswith(p)), None)
    r1 = after(0) if r1 is None else r1
    return r1, after(r1)


def _short_end(w: str) -> bool:
    if len(w) == 2:
        return _vowel(w[0]) and not _vowel(w[1])
    return len(w) > 2 and not _vowel(w[-1]) and w[-1] not in "wxY" and _vowel(w[-2]) and not _vowel(w[-3])


@lru_cache(maxsize=65536)
def stem_english(word: str) -> str:
    """Expects lower case; returns what it gets where it is shorter than three letters."""
    if len(word) <= 2:
        return word
    w = word.replace("’", "'").lstrip("'") if word[0] in "'’" else word.replace("’", "'")
    if w in _EXCEPTIONS:
        return _EXCEPTIONS[w]
    w = "".join("Y" if c == "y" and (k == 0 or _vowel(w[k - 1])) else c for k, c in enumerate(w))
    r1, r2 = _regions(w)
    for s in ("'s'", "'s", "'"):
        if w.endswith(s):
            w = w[: -len(s)]
            break
    # 1a
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and any(_vowel(c) for c in w[:-2]):
        w = w[:-1]
    if w in _AFTER_1A:
        return w
    # 1b
    for s in ("eedly", "ingly", "edly", "eed", "ing", "ed"):
        if w.endswith(s):
            if s in ("eed", "eedly"):
                if len(w) - len(s) >= r1:
                    w = w[: -len(s)] + "ee"
            elif any(_vowel(c) for c in w[: -len(s)]):
                w = w[: -len(s)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif w.endswith(_DOUBLES):
                    w = w[:-1]
                elif _short_end(w) and r1 >= len(w):
                    w += "e"
            break
    # 1c
    if len(w) > 2 and w[-1] in "yY" and not _vowel(w[-2]):
        w = w[:-1] + "i"
    for s, r in _STEP2:
        if w.endswith(s):
            at = len(w) - len(s)
            if at >= r1:
                if s == "ogi":
                    w = w[:at] + r if w[at - 1 : at] == "l" else w
                elif s == "li":
                    w = w[:at] if w[at - 1 : at] in tuple("cdeghkmnrt") else w
                else:
                    w = w[:at] + r
            break
    for s, r in _STEP3:
        if w.endswith(s):
            at = len(w) - len(s)
            if at >= r1 and (s != "ative" or at >= r2):
                w = w[:at] + r
            break
    for s in _STEP4:
        if w.endswith(s):
            at = len(w) - len(s)
            if at >= r2 and (s != "ion" or w[at - 1 : at] in ("s", "t")):
                w = w[:at]
            break
    # 5
    if w.endswith("e"):
        if len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not _short_end(w[:-1])):
            w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.replace("Y", "y")
