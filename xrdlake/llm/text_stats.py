"""Statistics of whole texts, as quality rules and classifiers read them."""

from __future__ import annotations

import operator
import re

from xrdlake.llm.common import SPACES

SYMBOLS = "#*$%&|<>"

#: Counts of a text; ``statistics`` returns them in this order.
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_digits", "n_punct", "n_lines", "n_word_kinds",
          "n_long_words", "n_single_chars", "n_same_neighbours", "n_marked_words", "n_stops", "longest_line_words", "n_dup_line_chars")

_UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]")
_DIGIT = re.compile(r"[0-9]")
_PUNCT = re.compile(r"[!?;:.,\"'()\[\]{}=/\\_@+~`^-]")


def repeated_words(words: list) -> int:
    """Words inside three-word windows that the text holds twice or more."""
    n = len(words) - 2
    if n < 2:
        return 0
    seen: dict = {}
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) == n:
        return 0
    for w in windows:
        seen[w] = seen.get(w, 0) + 1
    covered, last = 0, -1  # last: the last word counted
    for i, w in enumerate(windows):
        if seen[w] > 1:
            covered += i + 2 - max(last, i - 1)
            last = i + 2
    return covered


def words_of(text: str) -> list[bytes]:
    """Words between ASCII white space, as UTF-8."""
    return text.encode().split()


def base_counts(text: str, words: list[bytes]) -> tuple[int, int, int, int, int]:
    """Words, code points in words, symbols, repeated lines, words in repeated windows."""
    lines, dup = set(), 0
    if "\n" in text:
        for line in text.split("\n"):
            if line.strip(SPACES):
                if line in lines:
                    dup += 1
                else:
                    lines.add(line)
    return len(words), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), dup, repeated_words(words)


def statistics(text: str | None) -> tuple[int, ...]:
    """``COUNTS`` of a text; a null text counts as empty."""
    text = text or ""
    words = words_of(text)
    base = base_counts(text, words)
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    kinds = set(words)
    seen: set = set()
    dup_chars = 0
    for x in lines:
        if x in seen:
            dup_chars += len(x)
        seen.add(x)
    ends, sizes = bytes(w[-1] for w in words), list(map(len, words))
    marked = sum(ends.count(c) for c in b"#*$%&|<>!")
    return (*base, len(_UPPER.findall(text)), len(_DIGIT.findall(text)), len(_PUNCT.findall(text)), len(lines), len(kinds),
            sum(map((24).__lt__, sizes)), sizes.count(1), sum(map(operator.eq, words, words[1:])), marked,
            ends.count(46), max((len(x.split()) for x in lines), default=0), dup_chars)


#: Ratios of the counts that models learn from.
FEATURES = ("n_words", "word_length", "symbols", "dup_lines", "repeat_words", "upper", "digits", "punct", "line_words", "word_kinds",
            "long_words", "single_chars", "same_neighbours", "marked_words", "stops", "longest_line", "dup_line_chars")


def features(c: dict):
    """``FEATURES`` from counts by name: numbers, numpy arrays or columns alike."""
    words, chars, lines = c["n_words"] + 1e-9, c["word_chars"] + 1e-9, c["n_lines"] + 1e-9
    return (c["n_words"] * 1.0, c["word_chars"] / words, c["n_symbols"] / chars, c["n_dup_lines"] / lines, c["n_repeat_words"] / words, c["n_upper"] / chars,
            c["n_digits"] / chars, c["n_punct"] / chars, c["n_words"] / lines, c["n_word_kinds"] / words, c["n_long_words"] / words,
            c["n_single_chars"] / words, c["n_same_neighbours"] / words, c["n_marked_words"] / words, c["n_stops"] / words, c["longest_line_words"] / words,
            c["n_dup_line_chars"] / chars)
