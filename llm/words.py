"""Letter runs of a text, lower-cased: the words that classifiers read."""

from __future__ import annotations

import re

_runs = re.compile(r"[^\W\d_]+").findall


def letter_words(text: str) -> list[str]:
    return _runs(text.lower())
