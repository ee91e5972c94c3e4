"""Words of a text in a form that typography, case, scanning errors and numbers don't change."""

from __future__ import annotations

import re
import unicodedata

_TOKEN = re.compile(r"[^\W_]+")
#: A word broken at a line's end.
_BROKEN = re.compile(r"(?<=\w)[-‐‑­]\s*\n\s*(?=\w)")
#: Characters that scanning takes for one another, each written as the one it is taken for.
_SCAN = str.maketrans({"0": "o", "1": "l", "i": "l", "ı": "l", "|": "l", "e": "c", "h": "ll", "m": "rn"})


def fold(token: str) -> str:
    """A token's folded form; empty for numbers."""
    digits = sum(ch.isdigit() for ch in token)
    if digits and digits * 2 >= len(token):
        return ""
    bare = "".join(ch for ch in unicodedata.normalize("NFKD", token.lower()) if not unicodedata.combining(ch))
    return bare.translate(_SCAN)


class Folder:
    """Folds the tokens of many texts; each distinct token is worked out once."""

    def __init__(self, most: int = 500_000) -> None:
        self.cache: dict[str, str] = {}
        self.most = most

    def words(self, text: str | None) -> list[str]:
        if not text:
            return []
        cache, out = self.cache, []
        if len(cache) > self.most:
            cache.clear()
        text = text.replace("­", "")
        if "\n" in text:
            text = _BROKEN.sub("", text)
        for token in _TOKEN.findall(text):
            word = cache.get(token)
            if word is None:
                word = cache[token] = fold(token)
            if word:
                out.append(word)
        return out

    def spans(self, text: str) -> list[tuple[int, int]]:
        """Character spans of words(text) in the text itself."""
        holes = [(m.start(), m.end()) for m in _BROKEN.finditer(text)] + [(m.start(), m.end()) for m in re.finditer("­", text)]
        if not holes:
            return [m.span() for m in _TOKEN.finditer(text) if self.words(m[0])]
        skip = {i for a, b in holes for i in range(a, b)}
        place = [i for i in range(len(text)) if i not in skip]
        joined = "".join(text[i] for i in place)
        return [(place[m.start()], place[m.end() - 1] + 1) for m in _TOKEN.finditer(joined) if self.words(m[0])]
