"""Literal rewriting: wildcards, encodings, dash variants. Driver-side."""

from __future__ import annotations

import base64
import itertools
import re

DASHES = "-/–—―"


def wildcard_parts(text: str) -> list[str | None]:
    """Tokens of a pattern: text for literals, None for *, Ellipsis for ?. A backslash escapes * ? and itself."""
    out: list = []
    run, i = "", 0
    while i < len(text):
        c = text[i]
        if c == "\\" and i + 1 < len(text) and text[i + 1] in "*?\\":
            run += text[i + 1]
            i += 2
            continue
        if c in "*?":
            if run:
                out.append(run)
                run = ""
            out.append(None if c == "*" else ...)
        else:
            run += c
        i += 1
    if run or not out:
        out.append(run)
    return out


def wildcard_regex(parts: list, start: bool = True, end: bool = True, fold: bool = True) -> str:
    """A Java regular expression: Unicode case folding, . over line ends, anchored where asked."""
    body = "".join(".*" if p is None else "." if p is ... else quote(p) for p in parts)
    return ("(?siu)" if fold else "(?s)") + ("^" if start else "") + body + (r"\z" if end else "")


def quote(text: str) -> str:
    return re.sub(r"([\\.^$|?*+()\[\]{}])", r"\\\1", text)


def utf16(text: str, kind: str) -> bytes:
    return {"wide": text.encode("utf-16-le"), "utf16le": text.encode("utf-16-le"), "utf16be": text.encode("utf-16-be"), "utf16": b"\xff\xfe" + text.encode("utf-16-le")}[kind]


def base64_text(raw: bytes) -> str:
    return base64.b64encode(raw).decode()


def base64_offsets(raw: bytes) -> list[str]:
    """The three encodings of raw at byte offsets 0, 1, 2, without the characters that neighbours decide."""
    out = []
    for shift, skip in ((0, 0), (1, 2), (2, 3)):
        encoded = base64.b64encode(b"\0" * shift + raw).decode()
        tail = (len(raw) + shift) % 3
        out.append(encoded[skip : len(encoded) - (0 if tail == 0 else 3 if tail == 1 else 2)])
    return out


def dash_variants(text: str) -> list[str]:
    """Every replacement of each dash by any dash; up to 8 dashes."""
    parts = text.split("-")
    if len(parts) > 9:
        raise ValueError("more than 8 dashes")
    return ["".join(a + b for a, b in itertools.zip_longest(parts, combo, fillvalue="")) for combo in itertools.product(DASHES, repeat=len(parts) - 1)]
