"""Folded text: what is left of a text when layout, case and marks are taken off.

HTML tags removed, entities decoded, NFKC, lower case, and only letters and
digits (Unicode L and N) kept.
"""

from __future__ import annotations

import html
import re
import unicodedata

_TAG = re.compile(r"</?[A-Za-z][^<>]*>")
_COMMENT = re.compile(r"<!--.*?-->", re.S)
# \w is exactly L, N and the underscore
_OTHER = re.compile(r"[\W_]+")


def fold(text: str) -> str:
    if "<" in text:
        if "<!--" in text and "-->" in text:
            text = _COMMENT.sub("", text)
        text = _TAG.sub("", text)
    if "&" in text:
        text = html.unescape(text)
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    return _OTHER.sub("", text.lower())
