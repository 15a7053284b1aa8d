"""From a page's markup to the sentences of its prose."""

from __future__ import annotations

import html
import re
import unicodedata

_COMMENT = re.compile(r"<!--.*?(?:-->|\Z)", re.S)
_REFERENCE = re.compile(r"<ref[^<>]*/>|<ref[^<>]*>.*?(?:</ref>|(?=\n\n)|\Z)", re.S | re.I)
_TABLE = re.compile(r"\{\|(?:(?!\{\|).)*?\|\}", re.S)
_TEMPLATE = re.compile(r"\{\{[^{}]*\}\}")
_PARAMETER = re.compile(r"\{\{\{[^{}]*\}\}\}")
_NAMESPACE = re.compile(r"\[\[\s*[^\[\]|:\s]+\s*:[^\[\]]*\]\]")
_LINK = re.compile(r"\[\[(?:[^\[\]|]*\|)?([^\[\]|]*)\]\]")
_EXTERNAL = re.compile(r"\[(?:https?|ftp)://[^\s\]]*\s*([^\]]*)\]|(?:https?|ftp)://\S+")
_TAG = re.compile(r"</?[a-zA-Z][^<>\n]*>")
_BROKEN = re.compile(r"(?m)^[ \t]*(?:[|!*#;:]|\{\||\{\{|\}\}|==).*$")
_WRAPPED = re.compile(r"(\w)(?:-|­)\n(\w)")
_QUOTES = re.compile(r"'{2,}")
_END = re.compile(r"(?<=[.!?])[\"')\]]*\s+|\n[ \t]*\n\s*")
_WORD = re.compile(r"[^\W\d_]+(?:[-'’][^\W\d_]+)*")
_GARBLED = re.compile("[ÂÃâ][\u0080-¿ŒœŠšŸŽžƒˆ˜–-…‰‹›€™]")


def _byte(c: str) -> bytes:
    try:
        return c.encode("cp1252")
    except UnicodeEncodeError:
        return c.encode("latin-1")


def mended(text: str) -> str:
    """Text that was read in a wrong encoding (UTF-8 as Windows-1252), put right where that gives valid text."""
    for _ in range(2):
        if not _GARBLED.search(text):
            break
        try:
            text = b"".join(map(_byte, text)).decode("utf-8")
        except (UnicodeEncodeError, UnicodeDecodeError):
            break
    return text


def _emptied(pattern: re.Pattern, text: str) -> str:
    """Matches taken out, from the innermost on."""
    while True:
        text, n = pattern.subn(" ", text)
        if not n:
            return text


def prose(text: str | None) -> str:
    """The running text: without tables, templates, references, comments, headings, lists and categories; links by what
    they show. Null gives an empty text."""
    if not text:
        return ""
    text = mended(text)
    if "&" in text:
        text = html.unescape(html.unescape(text))
    text = text.replace(" ", " ").replace("\r", "")
    if "-\n" in text or "­" in text:
        text = _WRAPPED.sub(r"\1\2", text)
    if "<" in text:
        text = _REFERENCE.sub(" ", _COMMENT.sub(" ", text))
    if "{" in text:
        text = _emptied(_TEMPLATE, _PARAMETER.sub(" ", _emptied(_TABLE, text)))
    if "[" in text:
        text = _LINK.sub(r"\1", _NAMESPACE.sub(" ", text))
        text = _EXTERNAL.sub(lambda m: m.group(1) or " ", text)
    if "<" in text:
        text = _TAG.sub(" ", text)
    return _QUOTES.sub("", _BROKEN.sub("\n", text))


def sentences(text: str | None) -> list[str]:
    """Sentences of the running text, in order."""
    return [s for s in _END.split(prose(text)) if s and not s.isspace()]


def words(sentence: str) -> list[str]:
    """Words without digits, lower case, composed."""
    if not sentence.isascii():
        sentence = unicodedata.normalize("NFC", sentence)
    return _WORD.findall(sentence.lower())
