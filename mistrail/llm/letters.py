"""Texts as streams of letters: what is left apart from case, punctuation, spacing, numerals, markup and character forms."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

import numpy as np

#: A tag by its grammar: a name, then attributes with values or ones that stand alone in HTML. A "<" in a formula is none.
_TAG = re.compile(
    rb"""</?[A-Za-z][\w:.-]*(?:\s+[A-Za-z_:][\w:.-]*\s*=\s*(?:"[^"<>\x00]*"|'[^'<>\x00]*'|[^\s"'<>\x00]+)|\s+(?:nowrap|noshade|compact|checked|disabled|selected|readonly|multiple|hidden)\b)*\s*/?>|<[!?][A-Za-z][^<>\x00]*>""",
    re.IGNORECASE,
)
_COMMENT = re.compile(rb"<!--.*?-->", re.DOTALL)
_ENTITY = re.compile(rb"&(?:#\d{1,7}|#[xX][0-9A-Fa-f]{1,6}|[A-Za-z]\w{1,8});")
#: Lead bytes of the blocks that hold other forms of letters (letterlike symbols, number forms, enclosed letters,
#: ligatures, full-width and mathematical letters) and of combining marks.
_FORMS = (b"\xcc", b"\xcd", b"\xe2\x84", b"\xe2\x85", b"\xe2\x92", b"\xe2\x93", b"\xef", b"\xf0\x9d", b"\xf0\x9f\x84")
#: Lead bytes of scripts other than Latin.
_OTHER_SCRIPT = re.compile(rb"[\xce-\xdf\xe0\xe1\xe3-\xee\xf0-\xf4]|\xe2[\xb0-\xbf]")
#: Blocks of Latin letters beyond ASCII, first and last code point: fixed values.
_LATIN = ((0xAA, 0xAA), (0xBA, 0xBA), (0xC0, 0x2FF), (0x1D00, 0x1DBF), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF), (0xAB30, 0xAB6F))
_GREEK = ((0x370, 0x3FF), (0x1F00, 0x1FFF))
_LOWER = bytes(i + 32 if 65 <= i <= 90 else i for i in range(256))
_IS_LETTER = np.array([65 <= i <= 90 or 97 <= i <= 122 for i in range(256)])
_DROP = bytes(i for i in range(1, 256) if not _IS_LETTER[i])


def plain(text: bytes) -> bytes:
    """A UTF-8 text without tags, comments and entities and with plain letters for other forms of them (NFKC)."""
    if b"<" in text:
        if b"<!--" in text and (end := text.rfind(b"-->")) >= 0:
            text = _COMMENT.sub(b" ", text[: end + 3]) + text[end + 3 :]
        text = _TAG.sub(b" ", text)
    if b"&" in text:
        text = _ENTITY.sub(b" ", text)
    if any(form in text for form in _FORMS):
        # The trade mark sign isn't the word "TM".
        text = unicodedata.normalize("NFKC", text.decode("utf-8", "ignore").replace("™", " ")).encode()
    return text.replace(b"\x00", b" ")


@lru_cache(1)
def _classes() -> np.ndarray:
    """For each code point: 1 for a letter that counts, 2 for a Greek one (a letter only beside another), 0 for the rest."""
    table = np.fromiter((chr(i).isalpha() for i in range(0x110000)), np.uint8, 0x110000)
    for first, last in _LATIN:
        table[first : last + 1] = 0
    for first, last in _GREEK:
        table[first : last + 1] *= 2
    return table


def _wide(text: bytes) -> tuple[bytes, np.ndarray]:
    """The lower-case text, and whether each of its bytes belongs to a letter, where there are scripts other than Latin."""
    lower = text.decode("utf-8", "ignore").lower()
    points = np.frombuffer(lower.encode("utf-32-le"), np.uint32)
    kind = _classes()[points]
    greek = np.concatenate([[False], kind == 2, [False]])
    letter = (kind == 1) | (greek[1:-1] & (greek[:-2] | greek[2:]))
    size = 1 + (points >= 0x80).astype(np.int8) + (points >= 0x800) + (points >= 0x10000)
    return lower.encode(), np.repeat(letter, size)


def spelled(text: bytes) -> tuple[bytes, np.ndarray]:
    """The plain text and the positions in it of the bytes of ``letters(text)``."""
    raw = plain(text)
    if _OTHER_SCRIPT.search(raw):
        raw, letter = _wide(raw)
        return raw, np.flatnonzero(letter)
    return raw, np.flatnonzero(_IS_LETTER[np.frombuffer(raw, np.uint8)])


def letters(text: bytes) -> bytes:
    """The letters of a UTF-8 text in lower case, as UTF-8.

    Latin letters beyond ASCII are dropped in both the corpus and the passages, which makes wrong encodings of them
    alike; those of other scripts are kept. A single Greek letter is a symbol, which goes lost in wrong encodings, too.
    """
    raw = plain(text)
    if _OTHER_SCRIPT.search(raw):
        raw, letter = _wide(raw)
        return np.frombuffer(raw, np.uint8)[letter].tobytes()
    return raw.translate(_LOWER, _DROP)


def joined(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """The letters of many texts in one array, with a zero after each; position at which each begins."""
    whole = np.frombuffer(b"\x00".join(letters(t) if t else b"" for t in texts) + b"\x00", np.uint8)
    ends = np.flatnonzero(whole == 0)
    return whole, np.concatenate([[0], ends[:-1] + 1])
