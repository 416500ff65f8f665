"""Derivations of a word by the endings of its language (light suffix stripping)."""

from __future__ import annotations

# Endings by language, longest first where one contains another; an empty ending is the bare stem.
ENDINGS = {
    "en": ["", "s", "es", "ed", "ing", "er", "ers", "ly"],
    "de": ["", "e", "en", "er", "es", "em", "n", "s"],
    "fr": ["", "s", "e", "es", "x", "ment"],
    "es": ["", "s", "es", "a", "as", "o", "os", "mente"],
    "it": ["", "a", "e", "i", "o", "mente"],
    "pt": ["", "s", "es", "a", "as", "o", "os", "mente"],
    "nl": ["", "e", "en", "s", "er"],
    "ru": ["", "а", "ы", "у", "ом", "е", "ов", "ами", "ах", "ой"],
}


def derivations(word: str, language: str | None, least: int = 5) -> list[str]:
    """The word and its forms; words shorter than ``least`` and unknown languages have only themselves.

    ``simple`` counts as English.
    """
    endings = ENDINGS.get("en" if language == "simple" else language or "", [])
    if len(word) < least or not endings:
        return [word]
    cut = next((e for e in sorted(endings, key=len, reverse=True) if e and word.endswith(e) and len(word) - len(e) >= 3), "")
    stem = word[: len(word) - len(cut)]
    return list(dict.fromkeys([word, *(stem + e for e in endings)]))
