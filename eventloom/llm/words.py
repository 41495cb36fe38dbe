"""Texts as plain words: markup, layout, encoding damage and look-alike characters removed."""

from __future__ import annotations

import html
import re
import unicodedata

#: Cyrillic and Greek letters that look like Latin ones.
LOOKALIKES = str.maketrans("аеорсухікмтвнАЕОРСУХІКМТВНοαερικντυχ", "aeopcyxikmtbhAEOPCYXIKMTBHoaepikvtux")
_HIDDEN = re.compile("[­​-‏‪-‮⁠-⁤﻿]")
_TAG = re.compile(r"</?[A-Za-z][^<>]*>|<!--.*?-->|&nbsp;?|\\[nrt]", re.S)
_BROKEN = re.compile("[ÃÂâ][\u0080-¿Œ-™€]{1,2}")
_WORD = re.compile(r"[^\W_]+")
_SPLIT_WORD = re.compile(r"(?<=[a-z])-\s*\n\s*(?=[a-z])")


def _mend(m: re.Match) -> str:
    """UTF-8 that was read as a single-byte code page."""
    try:
        return m.group().encode("cp1252").decode("utf-8")
    except (UnicodeEncodeError, UnicodeDecodeError):
        try:
            return m.group().encode("latin-1").decode("utf-8")
        except (UnicodeEncodeError, UnicodeDecodeError):
            return m.group()


def plain(text: str) -> str:
    """Lower case without marks, tags, entities, hidden characters and look-alikes."""
    t = text
    if not t.isascii():
        t = _HIDDEN.sub("", _BROKEN.sub(_mend, t))
    if "&" in t:
        t = html.unescape(t)
    if "<" in t or "&" in t or "\\" in t:
        t = _TAG.sub(" ", t)
    if "\n" in t:
        t = _SPLIT_WORD.sub("", t)
    if not t.isascii():
        t = unicodedata.normalize("NFKD", t.translate(LOOKALIKES))
        t = "".join(c for c in t if not unicodedata.combining(c))
        t = t.replace("’", "'").replace("ʼ", "'")
    return t.lower().replace("'s ", "s ").replace("'", "")


def words(text: str | None) -> list[str]:
    return _WORD.findall(plain(text)) if text else []


def close(a: str, b: str) -> bool:
    """Equal but for a slip of the keys: one edit or swap in words of four letters, two from nine. Figures must be equal."""
    if a == b:
        return True
    la, lb = len(a), len(b)
    if min(la, lb) < 4 or abs(la - lb) > 2 or a.isdigit() or b.isdigit():
        return False
    return distance_within(a, b, 2 if min(la, lb) >= 9 else 1)


def distance_within(a: str, b: str, k: int) -> bool:
    """Whether at most k edits or swaps of neighbours lead from a to b."""
    if abs(len(a) - len(b)) > k:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    a, b = a[i:], b[i:]
    j = 0
    while j < min(len(a), len(b)) and a[-1 - j] == b[-1 - j]:
        j += 1
    if j:
        a, b = a[:-j], b[:-j]
    if max(len(a), len(b)) <= 1:
        return max(len(a), len(b)) <= k
    if k == 1:
        return len(a) == len(b) == 2 and a[0] == b[1] and a[1] == b[0]
    before, last = None, list(range(len(b) + 1))
    for x in range(1, len(a) + 1):
        row = [x] + [0] * len(b)
        for y in range(1, len(b) + 1):
            d = min(last[y] + 1, row[y - 1] + 1, last[y - 1] + (a[x - 1] != b[y - 1]))
            if x > 1 and y > 1 and a[x - 1] == b[y - 2] and a[x - 2] == b[y - 1]:
                d = min(d, before[y - 2] + 1)
            row[y] = d
        before, last = last, row
    return last[-1] <= k
