"""What a path and a hash say, as a person would read them."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache
from urllib.parse import unquote

_DATES = (
    (re.compile(r"(?<!\d)(\d{4})[-_. ](\d{2})[-_. ](\d{2})(?!\d)"), (1, 2, 3)),
    (re.compile(r"(?<!\d)(\d{4})(\d{2})(\d{2})(?!\d)"), (1, 2, 3)),
    (re.compile(r"(?<!\d)(\d{2})[-_. ](\d{2})[-_. ](\d{4})(?!\d)"), (3, 2, 1)),
)
_DATE_DIRS = re.compile(r"(?:^|/)(\d{4})/(\d{2})/(\d{2})/[^/]*$")
_FILE = re.compile(r"^\s*([a-z]{2,5})[ _\-]?(\d{2,})(?!\d*[a-z]*\d*[0-9a-f]{9})", re.I)
_BREAK = re.compile(r"(?<=[a-z])(?=[A-Z])")
_WORD = re.compile(r"[^\W\d_]+")
_ALGORITHM = re.compile(r"^(?:b3|blake3|sha-?256|sha-?1|md5|xxh)\s*[:\-_= ]\s*")


@lru_cache(maxsize=100_000)
def fold(s: str) -> str:
    """Without accents."""
    if s.isascii():
        return s
    return "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c))


def content_hash(value: str | None, size: int | None) -> str | None:
    """The hash in one notation: lower case, without the algorithm's name, separators and blanks. None says nothing."""
    if value is None or size == 0:
        return None
    h = _ALGORITHM.sub("", value.strip().lower())
    return re.sub(r"[\s:\-_]", "", h) or None


def _day(y: str, m: str, d: str) -> str | None:
    return f"{y}{m}{d}" if "1800" <= y <= "2199" and "01" <= m <= "12" and "01" <= d <= "31" else None


@lru_cache(maxsize=50_000)
def _album(folder: str) -> tuple[str | None, str]:
    """Day and words (sorted, folded, lower case) of the directories of a shot."""
    last = folder.rsplit("/", 1)[-1]
    day, rest = None, last
    for pattern, (y, m, d) in _DATES:
        for hit in pattern.finditer(last):
            day = _day(hit[y], hit[m], hit[d])
            if day:
                rest = last[: hit.start()] + " " + last[hit.end() :]
                break
        if day:
            break
    if not day:
        hit = _DATE_DIRS.search(folder)
        day = _day(*hit.groups()) if hit else None
    text = _BREAK.sub(" ", fold(rest))
    return day, " ".join(sorted(w.lower() for w in _WORD.findall(text)))


def shot(path: str | None) -> tuple[str, str] | None:
    """(day|camera prefix|number, words) of a path that names a shot of an album, else None."""
    if path is None:
        return None
    p = path.replace("\\", "/")
    if "%" in p:
        p = unquote(p)
    p = re.sub(r"/(?:\./|/)+", "/", unicodedata.normalize("NFC", p))
    folder, _, name = p.rpartition("/")
    f = _FILE.match(name)
    if not f or not folder:
        return None
    day, words = _album(folder)
    if not day or not words:
        return None
    return f"{day}|{fold(f[1]).upper()}|{int(f[2])}", words


def _near(a: str, b: str) -> bool:
    """Equal but for one slip of the pen: a letter left out, doubled or wrong, or two neighbours swapped."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1 or min(len(a), len(b)) < 3:
        return False
    k = 0
    while k < min(len(a), len(b)) and a[k] == b[k]:
        k += 1
    if len(a) == len(b):
        return a[k + 1 :] == b[k + 1 :] or (a[k : k + 2] == b[k : k + 2][::-1] and a[k + 2 :] == b[k + 2 :])
    if len(a) > len(b):
        a, b = b, a
    return a[k:] == b[k + 1 :]


def same_words(a: str, b: str) -> bool:
    """Whether two sets of words (each sorted, separated by blanks) are the same as a person would read them.

    Each word has its own partner that is equal but for one slip. Words run together are taken apart along the other
    side's words, in any order.
    """
    if a == b:
        return True
    x, y = a.split(" "), b.split(" ")
    if len(x) == len(y):
        return _pair_up(x, y)
    if len(x) > len(y):
        x, y = y, x
    return _spells(x, y)


def _pair_up(x: list[str], y: list[str]) -> bool:
    if not x:
        return True
    w, rest = x[0], x[1:]
    return any(_near(w, v) and _pair_up(rest, y[:k] + y[k + 1 :]) for k, v in enumerate(y))


def _spells(x: list[str], y: list[str]) -> bool:
    """Whether the longer list's words, put together in groups in some order, give the shorter list's words."""
    if not x:
        return not y
    w = x[0]

    def spend(left: str, free: tuple[str, ...], slips: int) -> bool:
        if not left:
            return _spells(x[1:], list(free))
        for k, v in enumerate(free):
            others = free[:k] + free[k + 1 :]
            if left.startswith(v):
                if spend(left[len(v) :], others, slips):
                    return True
            elif not slips:
                for n in (len(v) - 1, len(v), len(v) + 1):
                    if 0 < n <= len(left) and _near(left[:n], v) and spend(left[n:], others, 1):
                        return True
        return False

    return spend(w, tuple(y), 0)
