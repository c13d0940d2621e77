"""Feature locations (S24-S26): positions, simple and compound locations, origin repair, and what is refused."""

from __future__ import annotations

import re

_RANGE = re.compile(r"(\d+)\.\.(\d+)\Z")
_ONE_OF = r"one-of\(\d+(?:,\d+)*\)"
_WITHIN = r"\(\d+\.\d+\)"
_POS = rf"(?:[<>?]?\d+|\?|{_WITHIN}|{_ONE_OF})"
_PAIR = re.compile(rf"{_POS}\.\.{_POS}")
_BOND = re.compile(rf"bond\({_POS}\)")
_BETWEEN = re.compile(r"\d+\^\d+")
_SOLO = re.compile(_POS)
MOST = 2**63 - 1


class Refused(ValueError):
    """Input that the reader declines to guess at."""


class Broken(ValueError):
    """Input that no reading allows."""


def _pos(kind: str, value: int = 0, left: int = 0, right: int = 0, choices: list[int] | None = None) -> dict:
    return {"kind": kind, "value": value, "left": left, "right": right, "choices": choices or []}


def parse_position(text: str, offset: int) -> dict:
    """A position; offset -1 for starts and 0 for ends. Compare positions by value, not by kind."""
    if offset not in (0, -1):
        raise Refused("offset must be 0 for end positions or -1 for start positions")

    def number(x: str) -> int:
        if not re.fullmatch(r"[+-]?\d+", x):
            raise Refused(f"Could not parse feature position '{text}'")
        v = int(x)
        if abs(v) > MOST:
            raise Refused(f"feature position out of range in '{text}'")
        return v

    if text == "?":
        return _pos("unknown")
    if text[:1] in ("?", "<", ">"):
        return _pos({"?": "uncertain", "<": "before", ">": "after"}[text[0]], number(text[1:]) + offset)
    if re.match(_WITHIN, text):
        left, right = (number(x) + offset for x in text[1 : text.index(")")].split("."))
        return _pos("within", left if offset == -1 else right, left, right)
    if m := re.match(_ONE_OF, text):
        choices = [number(x) + offset for x in text[7 : m.end() - 1].split(",")]
        return _pos("one_of", min(choices) if offset == -1 else max(choices), choices=choices)
    return _pos("exact", number(text) + offset)


def _part(start: dict, end: dict, strand: int, ref: str = "") -> dict:
    return {"start": start, "end": end, "strand": strand, "ref": ref}


def _simple(text: str, length: int | None, circular: bool, warnings: list) -> tuple[str, list[dict]]:
    strand = 0
    if text.startswith("complement("):
        text, strand = text[11:-1], -1
    if m := _RANGE.match(text):
        a, b = int(m[1]) - 1, int(m[2])
        if max(a, b) > MOST:
            raise Refused(f"feature position out of range in '{text}'")
        if 0 <= a < b:
            return "simple", [_part(_pos("exact", a), _pos("exact", b), strand)]
    ref = ""
    if text.count(":") == 1:
        ref, text = text.split(":")
    for kind, pattern in (("pair", _PAIR), ("bond", _BOND), ("between", _BETWEEN), ("solo", _SOLO)):
        if m := pattern.match(text):
            break
    else:
        raise Broken(f"Couldn't parse feature location: '{text}'")
    if m.end() != len(text):
        raise Refused(f"feature location '{text}' has text after the location")
    if kind in ("bond", "solo"):
        if kind == "bond":
            warnings.append({"kind": "bond", "text": ""})
            text = text[5:-1]
        start, end = parse_position(text, -1), parse_position(text, 0)
    elif kind == "between":
        s, e = map(int, text.split("^"))
        if s + 1 != e and not (length is not None and s == length and e == 1):
            raise Broken(f"invalid feature location '{text}'")
        start = end = _pos("exact", s)
    else:
        a, b = text.split("..")
        start, end = parse_position(a, -1), parse_position(b, 0)
        if end["value"] <= start["value"] and length and start["value"] < length:
            if not circular:
                raise Broken(f"it appears that '{text}' is a feature that spans the origin, but the sequence topology is undefined")
            if end["value"] < 0:
                raise Refused(f"End location ({end['value']}) must be greater than or equal to start location (0)")
            warnings.append({"kind": "origin_wrap", "text": text})
            parts = [_part(start, _pos("exact", length), strand), _part(_pos("exact", 0), end, strand)]
            return "join", parts[::-1] if strand == -1 else parts
    if start["value"] < 0:
        raise Broken(f"negative starting position in feature location '{text}'")
    if start["value"] > end["value"]:
        raise Refused(f"End location ({end['value']}) must be greater than or equal to start location ({start['value']})")
    return "simple", [_part(start, end, strand, ref)]


def _pieces(text: str) -> list[str]:
    """Top-level comma-separated pieces; empty ones vanish."""
    out, depth, piece = [], 0, ""
    for c in text:
        if c == "," and depth == 0:
            out.append(piece)
            piece = ""
            continue
        depth += (c == "(") - (c == ")")
        piece += c
    return [p for p in [*out, piece] if p]


def parse_location(text: str, length: int | None = None, circular: bool = False, stranded: bool = True) -> dict:
    """{operator, parts, status, message, warnings}; status is ok, parser_error or refused."""
    warnings: list[dict] = []
    try:
        op, parts = _parse(text, length, circular, 1 if stranded else 0, warnings)
        return {"operator": op, "parts": parts, "status": "ok", "message": "", "warnings": warnings}
    except Broken as e:
        return {"operator": None, "parts": None, "status": "parser_error", "message": str(e), "warnings": warnings}
    except Refused as e:
        return {"operator": None, "parts": None, "status": "refused", "message": str(e), "warnings": warnings}


def _parse(text: str, length: int | None, circular: bool, strand: int, warnings: list) -> tuple[str, list[dict]]:
    body = text
    if body.startswith("complement("):
        if body[-1] != ")":
            raise Refused(f"closing bracket missing in '{text}'")
        body, strand = body[11:-1], -1
    op = next((k for k in ("join", "order", "bond") if body.startswith(k + "(")), None)
    if op is None or (op == "bond" and _BOND.fullmatch(body) and "," not in body):
        op, parts = _simple(body, length, circular, warnings)
        for p in parts:
            p["strand"] = strand
        return op, parts[::-1] if strand == -1 else parts
    parts = []
    for piece in _pieces(body[len(op) + 1 : -1]):
        _, found = _simple(piece, length, circular, warnings)
        if found[0]["strand"] == -1:
            if strand == -1:
                raise Broken("double complement in '{text}'?")
        else:
            for p in found:
                p["strand"] = strand
        parts += found
    if not parts:
        raise Refused(f"CompoundLocation should have at least 2 parts, not [] in '{text}'")
    if len(parts) == 1:
        return "simple", parts
    return op, parts[::-1] if strand == -1 else parts


def clean_location(raw: str) -> str:
    """White space removed; replace(..., ...) is cut to what it replaces."""
    text = re.sub(r"\s", "", raw)
    if "replace" in text:
        comma = text.find(",")
        text = text[8 : comma if comma >= 0 else max(len(text) - 1, 0)]
    return text
