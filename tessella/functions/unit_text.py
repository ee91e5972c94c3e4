"""Unit texts taken apart by dynamic programming over tries of prefixes, roots and exponents.

A text is cut into tokens ``[prefix] root [exponent]`` between separators; several cuts are often
possible ("mil" the angle, or milli-inch-less "m" + "il"; "Grad" the degree or the gradian). Each
cut has a score: the log weight of its roots and prefixes, plus the prior of the dimension that
the field suggests. Numbers next to roots are evidence of the length of a full circle.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Mapping
from functools import lru_cache

#: The circular units, by code, and the length of a full circle in each.
PERIODS = {"rad": 2 * math.pi, "deg": 360.0, "gon": 400.0, "turn": 1.0, "hour": 24.0, "mil": 6400.0}

#: Roots with (unit, dimension, weight). A root may stand under several units.
ROOTS: dict[str, list[tuple[str, str, float]]] = {
    "rad": [("rad", "angle", 1.0)],
    "rads": [("rad", "angle", 1.0)],
    "radian": [("rad", "angle", 1.0)],
    "radians": [("rad", "angle", 1.0)],
    "radianes": [("rad", "angle", 1.0)],
    "radiant": [("rad", "angle", 1.0)],
    "bogenmaß": [("rad", "angle", 1.0)],
    "deg": [("deg", "angle", 1.0)],
    "degs": [("deg", "angle", 1.0)],
    "degree": [("deg", "angle", 1.0)],
    "degrees": [("deg", "angle", 1.0)],
    "degré": [("deg", "angle", 1.0)],
    "degrés": [("deg", "angle", 1.0)],
    "grado": [("deg", "angle", 1.0)],
    "grados": [("deg", "angle", 1.0)],
    "°": [("deg", "angle", 1.0)],
    "º": [("deg", "angle", 0.9)],
    "grad": [("deg", "angle", 0.5), ("gon", "angle", 0.5)],
    "grads": [("gon", "angle", 0.8)],
    "grade": [("gon", "angle", 0.6)],
    "grades": [("gon", "angle", 0.8)],
    "gradian": [("gon", "angle", 1.0)],
    "gradians": [("gon", "angle", 1.0)],
    "gon": [("gon", "angle", 1.0)],
    "gons": [("gon", "angle", 1.0)],
    "neugrad": [("gon", "angle", 1.0)],
    "turn": [("turn", "angle", 0.9)],
    "turns": [("turn", "angle", 1.0)],
    "rev": [("turn", "angle", 0.9)],
    "revs": [("turn", "angle", 0.9)],
    "revolution": [("turn", "angle", 1.0)],
    "revolutions": [("turn", "angle", 1.0)],
    "cycle": [("turn", "angle", 0.8)],
    "cycles": [("turn", "angle", 0.8)],
    "umdrehung": [("turn", "angle", 1.0)],
    "umdrehungen": [("turn", "angle", 1.0)],
    "tour": [("turn", "angle", 1.0)],
    "tours": [("turn", "angle", 1.0)],
    "vuelta": [("turn", "angle", 1.0)],
    "vueltas": [("turn", "angle", 1.0)],
    "h": [("hour", "clock", 0.8)],
    "hr": [("hour", "clock", 0.9)],
    "hrs": [("hour", "clock", 0.9)],
    "hour": [("hour", "clock", 1.0)],
    "hours": [("hour", "clock", 1.0)],
    "stunde": [("hour", "clock", 1.0)],
    "stunden": [("hour", "clock", 1.0)],
    "heure": [("hour", "clock", 1.0)],
    "heures": [("hour", "clock", 1.0)],
    "hora": [("hour", "clock", 1.0)],
    "horas": [("hour", "clock", 1.0)],
    "mil": [("mil", "angle", 0.8), ("thou", "length", 0.2)],
    "mils": [("mil", "angle", 0.8), ("thou", "length", 0.2)],
    "nato mil": [("mil", "angle", 1.0)],
    "m": [("m", "length", 0.8)],
    "s": [("s", "time", 0.8)],
    "sec": [("s", "time", 0.9)],
    "g": [("g", "mass", 0.6)],
    "hz": [("hz", "rate", 1.0)],
    "c": [("c", "temperature", 0.3)],
    "f": [("f", "temperature", 0.2)],
    "k": [("k", "temperature", 0.2)],
    "deg c": [("celsius", "temperature", 3.0)],
    "deg f": [("fahrenheit", "temperature", 3.0)],
    "°c": [("celsius", "temperature", 3.0)],
    "°f": [("fahrenheit", "temperature", 3.0)],
    "deg up": [("elevation", "elevation", 3.0)],
    "a.u.": [("none", "none", 1.0)],
    "%": [("percent", "none", 1.0)],
    "v": [("v", "voltage", 0.6)],
    "px": [("px", "length", 0.9)],
}

#: Prefixes with weight.
PREFIXES = {"m": 0.2, "c": 0.2, "k": 0.2, "u": 0.1, "µ": 0.2, "n": 0.1, "d": 0.05, "milli": 0.5, "centi": 0.5, "kilo": 0.5, "micro": 0.5, "nano": 0.5}

#: Exponents.
EXPONENTS = ["^-1", "^2", "^-2", "^3", "-1", "-2", "2", "3", "^1"]

#: Dimension priors of a field; the first word found in its name decides.
FIELD_WORDS = {
    "direction": "angle", "angle": "angle", "bearing": "angle", "phase": "angle", "heading": "angle", "azimuth": "angle", "orientation": "angle",
    "time": "clock", "clock": "clock", "cycle": "clock", "day": "clock", "circadian": "clock",
    "temp": "temperature", "dist": "length", "pos": "length", "speed": "rate", "rate": "rate", "lift": "elevation", "pitch": "elevation",
}
PRIOR = {True: math.log(0.6), False: math.log(0.1)}
SKIP_COST = math.log(1e-3)
SEPARATORS = " /*·.,;:()[]=-+_"


def _trie(words: Mapping[str, object] | list[str]) -> dict:
    root: dict = {}
    for w in words:
        node = root
        for ch in w:
            node = node.setdefault(ch, {})
        node["$"] = w
    return root


def _matches(trie: dict, text: str, at: int) -> list[str]:
    out, node = [], trie
    for ch in text[at:]:
        node = node.get(ch)
        if node is None:
            break
        if "$" in node:
            out.append(node["$"])
    return out


_ROOTS, _PREFIXES, _EXPONENTS = _trie(ROOTS), _trie(PREFIXES), _trie(EXPONENTS)
_NUMBER = re.compile(r"\d{1,3}(?:[   ]\d{3})+(?:[.,]\d+)?|\d+(?:[.,]\d+)?")


def plain(text: str) -> str:
    text = unicodedata.normalize("NFC", text).lower().replace(" ", " ").replace(" ", " ").replace("π", "pi").replace("×", "*")
    return re.sub(r"\s+", " ", text).strip()


def spans(text: str) -> tuple[list[float], str]:
    """The numbers that may be the length of a circle, and the text without them."""
    found: list[float] = []

    def pi(m: re.Match) -> str:
        found.append((float(m[1].replace(",", ".")) if m[1] else 1.0) * math.pi)
        return " "

    rest = re.sub(r"(?:(\d+(?:[.,]\d+)?) ?\*? ?)?(?<![a-z])pi(?![a-z])", pi, text)

    def between(m: re.Match) -> str:
        found.append(float(m[2].replace(",", ".")) - float(m[1].replace(",", ".")))
        return " "

    rest = re.sub(r"(-?\d+(?:[.,]\d+)?) ?(?:\.\.+|…|–|to|bis) ?(-?\d+(?:[.,]\d+)?)", between, rest)

    def number(m: re.Match) -> str:
        found.append(float(m[0].replace(" ", "").replace(",", ".")))
        return " "

    return found, re.sub(r" +", " ", _NUMBER.sub(number, rest)).strip()


def dimension_of(field: str | None) -> str | None:
    low = (field or "").lower()
    return next((d for w, d in FIELD_WORDS.items() if w in low), None)


def segment(text: str, dimension: str | None = None) -> dict[str, float]:
    """The best score of a cut of the text for each unit that occurs in one."""
    n = len(text)
    best: list[dict[str, float]] = [{} for _ in range(n + 1)]
    best[0] = {"": 0.0}

    def put(at: int, unit: str, score: float) -> None:
        if score > best[at].get(unit, -math.inf):
            best[at][unit] = score

    def boundary(i: int) -> bool:
        return i in (0, n) or not (text[i - 1].isalpha() and text[i].isalpha())

    for i in range(n):
        for unit, score in list(best[i].items()):
            if text[i] in SEPARATORS:
                put(i + 1, unit, score)
            else:
                j = i + 1  # a word that is no unit is passed over at a cost
                while j < n and text[j].isalpha():
                    j += 1
                put(j, unit, score + SKIP_COST / 2)
            if not boundary(i):
                continue
            for p in ["", *_matches(_PREFIXES, text, i)]:
                a = i + len(p)
                for r in _matches(_ROOTS, text, a):
                    b = a + len(r)
                    for e in ["", *_matches(_EXPONENTS, text, b)]:
                        end = b + len(e)
                        if not boundary(end):
                            continue
                        for code, dim, weight in ROOTS[r]:
                            gain = math.log(weight) + (math.log(PREFIXES[p]) if p else 0.0) + (math.log(0.2) if e else 0.0) + (PRIOR[dim == dimension] if dimension else 0.0)
                            # prefixed or raised units are no longer the unit itself
                            name = code if not p and not e else "other"
                            put(end, name if not unit or unit == name else "other", score + gain)
    return {u: s for u, s in best[n].items() if u}


@lru_cache(maxsize=100_000)
def circle_scores(text: str | None, field: str | None) -> tuple[float, ...]:
    """For each code of PERIODS a log score of the text; zeros if it says nothing."""
    codes = list(PERIODS)
    if text is None or not text.strip():
        return (0.0,) * len(codes)
    numbers, rest = spans(plain(text))
    cut = segment(rest, dimension_of(field))
    scores = dict.fromkeys(codes, -12.0)
    for unit, s in cut.items():
        if unit in scores:
            scores[unit] = max(scores[unit], s)
    for code, period in PERIODS.items():
        if any(abs(x / period - 1) < 0.005 for x in numbers if x > 0) and (period != 1.0 or scores[code] > -12):
            scores[code] += 6.0
    if max(scores.values()) <= -12.0:
        return (0.0,) * len(codes)
    return tuple(scores[c] for c in codes)
