"""The text a reader sees of a raw e-mail: one string per text part.

Transfer encodings are undone, characters decoded, HTML tags and comments removed. Only
``text/*`` parts count, attachments included; nested multiparts and attached messages are
followed. A multipart without its closing boundary, with other line ends or without any
boundary is read as far as it goes. A text that does not begin with a header is one part.
Reply marks, rules and other signs stay: words are runs of letters and digits, so that
signs never belong to one.
"""

from __future__ import annotations

import binascii
import html
import re
import unicodedata

_HEADER = re.compile(r"[!-9;-~]+[ \t]*:")
_UNFOLD = re.compile(r"\n[ \t]+")
_FIELD = re.compile(r"^(content-type|content-transfer-encoding)[ \t]*:[ \t]*([^\n]*)", re.I | re.M)
_BOUNDARY = re.compile(r'boundary\s*=\s*(?:"([^"]*)"|([^\s;]+))', re.I)
_CHARSET = re.compile(r'charset\s*=\s*"?([^"\s;]+)', re.I)
_NOT_BASE64 = re.compile(r"[^A-Za-z0-9+/]")
_UNSEEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|head|title)\b.*?(?:</\1\s*>|\Z)", re.I | re.S)
_BLOCK = re.compile(r"</?(?:p|div|br|hr|li|ul|ol|dl|dt|dd|table|tr|td|th|thead|tbody|h[1-6]|blockquote|pre|body|html|section|article|header|footer|center|form|option|address)\b[^>]*>", re.I)
_TAG = re.compile(r"</?[a-z!?][^>]*>", re.I)
#: Signs that a reader does not see; removed so that they do not break words.
_INVISIBLE = re.compile("[­​‌‍⁠﻿]")
_WORD = re.compile(r"[^\W_]+")


def _decoded(data: bytes, content_type: str) -> str:
    named = _CHARSET.search(content_type)
    for charset in (named[1] if named else "utf-8", "utf-8", "cp1252"):
        try:
            return data.decode(charset)
        except (LookupError, ValueError):
            continue
    return data.decode("latin-1")


def _without_encoding(body: str, encoding: str, content_type: str) -> str:
    if encoding == "base64":
        kept = _NOT_BASE64.sub("", body)
        kept = kept[: len(kept) - 1] if len(kept) % 4 == 1 else kept
        return _decoded(binascii.a2b_base64(kept + "=" * (-len(kept) % 4)), content_type)
    if encoding == "quoted-printable":
        return _decoded(binascii.a2b_qp(body.encode("utf-8", "replace")), content_type if body.isascii() else "")
    return body


def _seen(text: str) -> str:
    """HTML as text: block elements end a line, other tags leave nothing."""
    text = _UNSEEN.sub(" ", text)
    return html.unescape(_TAG.sub("", _BLOCK.sub("\n", text)))


def parts(text: str) -> list[str]:
    """The text parts in reading order; a work list, so that no depth of nesting is too deep."""
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    found: list[str] = []
    waiting = [(text, False)]
    while waiting:
        text, inside = waiting.pop()
        head, body = "", text
        if _HEADER.match(text):
            head, _, body = text.partition("\n\n")
        elif inside and text.startswith("\n"):
            body = text[1:]
        fields = {}
        for name, value in _FIELD.findall(_UNFOLD.sub(" ", head)):
            fields.setdefault(name.lower(), value)
        content_type = fields.get("content-type", "text/plain")
        kind = content_type.split(";")[0].strip().lower()
        encoding = fields.get("content-transfer-encoding", "").split(";")[0].strip().lower()
        if kind.startswith("multipart/"):
            boundary = _BOUNDARY.search(content_type)
            mark = boundary and (boundary[1] if boundary[1] is not None else boundary[2]).rstrip()
            pieces = re.split(rf"(?m)^--{re.escape(mark)}(--)?[ \t]*(?:\n|\Z)", body) if mark else [body]
            if len(pieces) == 1:
                found.append(body)
            inner = []
            for closed, piece in zip(pieces[1::2], pieces[2::2]):
                if closed:
                    break
                inner.append((piece, True))
            waiting += inner[::-1]
        elif kind == "message/rfc822":
            waiting.append((_without_encoding(body, encoding, content_type).lstrip("\n"), True))
        elif kind.startswith("text") or "/" not in kind:
            body = _without_encoding(body, encoding, content_type)
            found.append(_seen(body) if kind == "text/html" else body)
    return found


def words(text: str) -> list[str]:
    """Runs of letters and digits, without regard to case."""
    if not text.isascii():
        text = _INVISIBLE.sub("", text)
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        return _WORD.findall(text.casefold())
    return _WORD.findall(text.lower())
