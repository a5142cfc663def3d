"""Cuts texts into the pieces that byte-level vocabularies merge within."""

from __future__ import annotations

import re

import regex

# Characters for which the classes of letters, digits and white space below are complete.
_LATIN = "A-Za-zÀ-ÖØ-öø-ÿ"
_OTHER = re.compile("[^\t\n\r\x20-\x7eÀ-ÿ]")


class Pieces:
    """``Pieces(pattern).of(text)``: all matches of a pattern with Unicode classes.

    A text of common Latin characters only is matched by the same pattern with these classes spelled out, which is faster.
    """

    def __init__(self, pattern: str):
        self._any = regex.compile(pattern).findall
        plain = pattern.replace(r"[^\s\p{L}\p{N}]", rf"[^\s{_LATIN}0-9]").replace(r"\p{L}", f"[{_LATIN}]").replace(r"\p{N}", "[0-9]")
        self._latin = None if r"\p" in plain else re.compile(plain).findall

    def of(self, text: str) -> list[str]:
        if self._latin is None or _OTHER.search(text):
            return self._any(text)
        return self._latin(text)
