"""Figures of one text. All of it is read: no prefix, no sample."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import regex

_INVISIBLE = re.compile(r"[\u00ad\u200b-\u200f\u2060\ufeff]")
_WORD = regex.compile(r"[\p{L}\p{M}]+(?:['’\-][\p{L}\p{M}]+)*")
_LETTERS, _DIGITS = regex.compile(r"[\p{L}\p{M}]+"), re.compile(r"\d+")
#: The same for ASCII texts, by the faster standard library.
_ASCII_WORD, _ASCII_LETTERS = re.compile(r"[A-Za-z]+(?:['\-][A-Za-z]+)*"), re.compile(r"[A-Za-z]+")
_HAN = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Hangul}\p{Thai}]")
_NO_LETTER = bytes(b for b in range(256) if not chr(b).isalpha() or b > 127)
_NO_DIGIT = bytes(b for b in range(256) if not 48 <= b <= 57)
_LINE_ENDS, _ASCII_SEPARATORS = b"\n\r\v\f\x1c\x1d\x1e", b".!?;,|\t"
_ONE_SEPARATOR = bytes.maketrans(_LINE_ENDS + _ASCII_SEPARATORS, b"\n" * 14)
_NO_LETTER_NOR_SEPARATOR = bytes(b for b in _NO_LETTER if b not in _LINE_ENDS + _ASCII_SEPARATORS)
_STOPS, _CLOSING = frozenset(".!?…。！？"), "\"'”’»)]*_"
_STOP = re.compile(r"[.!?…。！？]+[\"'”’»)\]]*(?:\s|$)|[。！？]")
_MARKER = regex.compile(r"^\s*(?:[-*•·‣◦▪●○■□–—+>☐☑☒✓✔✗→]+|\[[ xX✓]?\]|\(?\p{Nd}{1,3}[.)]|\(?\p{L}[.)]|\p{Nd}{1,3}\s*[-–:])\s+\S")
_HASHTAG = regex.compile(r"(?<!\S)#[\p{L}\p{Nd}]\S*")
_MARKUP = regex.compile(r"</?[a-zA-Z][^<>]*>|&\p{L}{2,8};|\{\{[^{}]*\}\}")
_CELL = regex.compile(r"</?(?:t[drh]|table|tbody|thead)\b", regex.I)
_GAP = re.compile(r"(?<=\S) {2,}(?=\S)")
_WIDE_GAP = re.compile(r"(?<=\S) {3,}(?=\S)")
_PAIR = regex.compile(r"^\s*[\p{L}\p{M}][\p{L}\p{M}\p{Nd}_ .\-]{0,28}\s*(?:=|:=|:|\t|->|=>)\s*\S.{0,80}$")
_FIELD = re.compile(r"[|;,]")
_NAMED = regex.compile(r"^\s*[\p{L}\p{M}][\p{L}\p{M}\p{Nd}_ .\-]{0,28}(?:[:=]\s|=)")
_RULE = regex.compile(r"^[\s|+\-=_:*#~<>.\p{S}]+$")
_SEGMENT = re.compile(r"[.!?…。！？;,；，、|•·\t\n]+| {2,}| - | – | / ")
_SEPARATED, _COMMAS = re.compile(r"[;|•·；]| / | - "), re.compile(r"[,，、;|•·；]| / | - ")
_SEPARATORS = ",，、;|•·；/-"
_VOWEL = re.compile(r"[aeiouyàâäáãåæèéêëìîïíòôöóõøùûüúœ]", re.I)


@dataclass
class Figures:
    n_chars: int
    n_words: int
    mean_word_length: float
    symbol_ratio: float
    digit_ratio: float
    n_lines: int
    ended_lines: float  # share of lines that end in punctuation
    common_share: float
    list_share: float  # share of characters in lines with a list's marker, hashtags or short separated items
    table_share: float  # share of characters in lines of cells or fields
    markup_share: float
    odd_share: float  # share of words no language has: no vowel, very long, letters and digits mixed
    distinct_share: float
    segment_words: float  # words between two separators or line ends
    sentence_words: float  # words between two sentence ends
    short_lines: float  # share of lines of fewer than five words that end without punctuation
    longest_rare: float  # words of the longest run without a common one; 6 for fewer than 12 words or without blanks
    common_kinds: float  # different common words; 2 for fewer than 12 words or without blanks


def blank(text: str | None) -> bool:
    return text is None or not _INVISIBLE.sub("", text).strip()


def han(text: str) -> int:
    return 0 if text.isascii() else len(_HAN.findall(text))


def figures(text: str, common: dict[str, frozenset[str]]) -> Figures:
    """``common``: words of each language, lower case. The language that fits best counts, whatever the row says."""
    plain = text.isascii()
    t = text if plain else _INVISIBLE.sub("", text).replace("\u00a0", " ").replace("\u3000", " ")
    tokens = t.split()
    solid = sum(map(len, tokens))
    lines = [x for x in t.splitlines() if x.strip()]  # line ends of all sorts
    wide = han(t)
    cjk = wide > 0.3 * max(1, solid)
    rare, kinds = 6, 2
    low = t.lower()
    by_line = [(_ASCII_WORD if x.isascii() else _WORD).findall(x) for x in low.splitlines() if x.strip()]
    words = by_line[0] if len(by_line) == 1 else [*chain.from_iterable(by_line)]
    if plain:
        raw = t.encode()
        alnum, digits = len(raw.translate(None, _NO_LETTER)), len(raw.translate(None, _NO_DIGIT))
    else:
        alnum = digits = 0
        for x in lines:
            if x.isascii():
                raw = x.encode()
                alnum, digits = alnum + len(raw.translate(None, _NO_LETTER)), digits + len(raw.translate(None, _NO_DIGIT))
            else:
                alnum, digits = alnum + sum(map(len, _LETTERS.findall(x))), digits + sum(map(len, _DIGITS.findall(x)))
    if cjk:
        # no blanks between words: two characters make a word, common words are looked for anywhere
        n_words = max(1, wide // 2) + sum(1 for w in words if not _HAN.search(w))
        hits = 0
        for ws in common.values():
            hits = max(hits, sum(low.count(w) for w in ws if _HAN.search(w)))
        share = hits / n_words
    else:
        n_words = len(words)
        by_word = _languages(common)
        seen = Counter(chain.from_iterable(filter(None, map(by_word.get, words))))
        best, hits = max(((k, seen[k]) for k in sorted(seen)), key=lambda x: x[1], default=("", 0))
        share = hits / max(1, len(tokens), n_words)
        if n_words >= 12:
            own = common.get(best, frozenset())
            rare, kinds = max(map(len, bytes(map(own.__contains__, words)).split(b"\1"))), len(own.intersection(words))
    size = max(1, sum(map(len, lines)))
    in_list = in_table = ended = short = 0
    for x, own_words in zip(lines, by_line):
        lw = (len(_HAN.findall(x)) + 1) // 2 if cjk else len(own_words)
        end = _ends(x)
        ended += end
        short += lw < 5 and not end
        kind = _line_kind(x, lw)
        in_list += len(x) * (kind == 1)
        in_table += len(x) * (kind == 2)
    if _regular(lines):
        in_table = size
    odd = sum(map(_is_odd, tokens)) / max(1, len(tokens)) if not cjk else 0.0
    has_words = (_HAN if cjk else _ASCII_LETTERS if plain else _LETTERS).search
    if plain:  # the same on bytes: separators become one sign, everything else that is no letter goes
        flat = raw.replace(b"  ", b"\n").replace(b" - ", b"\n").replace(b" / ", b"\n").translate(_ONE_SEPARATOR, _NO_LETTER_NOR_SEPARATOR)
        segments = len([*filter(None, flat.split(b"\n"))])
    else:
        segments = sum(1 for x in _SEGMENT.split("\n".join(lines)) if x and has_words(x))
    sentences = sum(1 for x in _STOP.split(" ".join(lines)) if x and has_words(x))
    units = _HAN.findall(t) if cjk else low.split()
    return Figures(
        len(text), n_words, sum(map(len, words)) / max(1, len(words)), (solid - alnum - digits) / max(1, solid),
        digits / max(1, solid), len(lines), ended / max(1, len(lines)), share, in_list / size, in_table / size,
        sum(len(m) for m in _MARKUP.findall(t)) / max(1, len(t)) if "<" in t or "&" in t or "{{" in t else 0.0, odd, len(set(units)) / max(1, len(units)),
        n_words / max(1, segments), n_words / max(1, sentences), short / max(1, len(lines)),
        rare, kinds,
    )


_KNOWN: dict[int, tuple[dict, dict]] = {}


def _languages(common: dict[str, frozenset[str]]) -> dict[str, tuple[str, ...]]:
    """The languages of each common word; made once for each table of words."""
    known = _KNOWN.get(id(common))
    if known is None or known[0] is not common:
        by: dict[str, tuple[str, ...]] = {}
        for lang in sorted(common):
            for w in common[lang]:
                by[w] = by.get(w, ()) + (lang,)
        _KNOWN.clear()
        known = _KNOWN[id(common)] = (common, by)
    return known[1]


def _ends(x: str) -> bool:
    """Whether a line ends in punctuation, closing marks aside."""
    return x.rstrip().rstrip(_CLOSING)[-1:] in _STOPS


def _regular(lines: list[str]) -> bool:
    """Whether nearly all lines have the same number of fields, or a field's name in front."""
    if len(lines) < 4:
        return False
    for sep in ",;\t|":
        n = [x.count(sep) for x in lines]
        most = max(set(n), key=n.count)
        if most >= 2 and n.count(most) >= 0.8 * len(lines):
            return True
    return sum(1 for x in lines if (":" in x or "=" in x) and _NAMED.match(x)) >= 0.8 * len(lines)


def _line_kind(x: str, words: int) -> int:
    """0 none, 1 item of a list, 2 row of fields."""
    cells = len(_CELL.findall(x)) if "<" in x else 0
    bars, tabs, semis = x.count("|"), x.strip().count("\t"), x.count(";")
    spaced = "  " in x.strip()
    gaps, wide = (len(_GAP.findall(x)), len(_WIDE_GAP.findall(x))) if spaced else (0, 0)
    if (wide and words / (wide + 1) < 4.5) or cells >= 2 or tabs >= 2 or (gaps >= 2 and words / (gaps + 1) < 4) or (bars >= 2 and len(x) > 3 and _RULE.match(x)):
        return 2
    if x.lstrip().startswith("|") and bars >= 3 or ('";"' in x) or ('","' in x):
        return 2
    fields = max(bars, semis, x.count(","))
    if fields >= 2 and words / (fields + 1) < 3:
        if sum(1 for f in _FIELD.split(x) if _DIGITS.search(f)) >= (fields + 1) / 2:
            return 2
    if "#" in x and len(_HASHTAG.findall(x)) * 2 > len(x.split()):
        return 1
    lead = x.lstrip()[:2]
    if words <= 14 and not (lead[0].isalpha() and lead[1:] not in ".)") and _MARKER.match(x):
        return 1
    if words <= 9 and (":" in x or "=" in x or "\t" in x or "->" in x) and _PAIR.match(x) and not _ends(x):
        return 2
    if sum(map(x.count, _SEPARATORS)) < 3:
        return 0
    for pattern, most in ((_SEPARATED, 4.8), (_COMMAS, 3.6)):
        parts = sum(1 for p in pattern.split(x) if p.strip())
        if parts >= 4 and words / parts < most:
            return 1
    return 0


@lru_cache(maxsize=200_000)
def _is_odd(w: str) -> bool:
    letters = [c for c in w if c.isalpha()]
    if not letters:
        return not any(c.isdigit() for c in w)
    if len(w) > 30:
        return True
    core = w.strip(".,;:!?\"'()[]«»“”‘’…-")
    if any(c.isdigit() for c in core) and "/" not in core and "_" not in core:
        return True
    inside = sum(1 for c in core if not c.isalnum() and c not in "'’-/_.") > 0
    return inside or (len(letters) > 3 and not _VOWEL.search(w) and max(map(ord, letters)) < 0x250)
