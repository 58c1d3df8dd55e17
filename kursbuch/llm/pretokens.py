"""Splitting text into pre-tokens: the exact pattern, and a faster equal one for Latin-1 text."""

from __future__ import annotations

import re

import regex

# The letters, numbers and white space among the first 256 code points.
_L = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff"
_N = "0-9\xb2\xb3\xb9\xbc-\xbe"
_S = "\\x09-\\x0d\\x20\x85\xa0"


class Splitter:
    """findall of a pattern made of \\p{L}, \\p{N} and \\s.

    Text below U+0100 goes through the standard library's engine with the classes written
    out, which gives the same matches in less time; any other text through ``regex``.
    """

    def __init__(self, pattern: str):
        self._pattern = pattern
        self._full = None
        narrow = pattern.replace("[\\p{L}]", f"[{_L}]").replace("[\\p{N}]", f"[{_N}]")
        narrow = narrow.replace("[^\\s\\p{L}\\p{N}]", f"[^{_S}{_L}{_N}]")
        narrow = narrow.replace("\\p{L}", f"[{_L}]").replace("\\p{N}", f"[{_N}]")
        narrow = narrow.replace("\\S", f"[^{_S}]").replace("\\s", f"[{_S}]")
        self._narrow = re.compile(narrow).findall

    def _make_full(self):
        # Unicode's White_Space, which leaves out U+001C to U+001F.
        p = self._pattern
        p = p.replace("[^\\s\\p{L}\\p{N}]", "[^\\p{White_Space}L_N_]").replace("\\S", "\\P{White_Space}").replace("\\s", "\\p{White_Space}")
        p = p.replace("[\\p{L}]", "[L_]").replace("[\\p{N}]", "[N_]").replace("\\p{L}", "[L_]").replace("\\p{N}", "[N_]")
        self._full = regex.compile(p.replace("L_", "\\p{L}").replace("N_", "\\p{N}")).findall
        return self._full

    def __call__(self, text: str) -> list[str]:
        return self._narrow(text) if is_latin(text) else (self._full or self._make_full())(text)


def is_latin(text: str) -> bool:
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True

