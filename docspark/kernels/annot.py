r"""Annotations: s-expressions and what they say.

Syntax errors fail a stream; forms that are known but not well-formed are passed over. If any string of a stream has an escape that the
modern syntax doesn't know, all strings of the stream are read the old way, where a backslash escapes the quote only.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from docspark.kernels.core import LIMITS, Limits, exceeded, invalid
from docspark.kernels.geometry import Transform, transform
from docspark.kernels.iff import Info
from docspark.kernels.text import is_utf8, repair

SPACE = b" \t\n\r\x0b\x0c"
#: Escapes of one character. Fixed values of the syntax.
ESCAPES = {ord("a"): 7, ord("b"): 8, ord("t"): 9, ord("n"): 10, ord("v"): 11, ord("f"): 12, ord("r"): 13, ord("\\"): ord("\\"), ord('"'): ord('"')}
#: Values of the view options, shapes and borders. Fixed values of the syntax.
ZOOMS = ("stretch", "one2one", "width", "page")
MODES = ("color", "bw", "fore", "back")
HORIZONTAL = ("left", "center", "right", "default")
VERTICAL = ("top", "center", "bottom", "default")
SHAPES = ("rect", "oval", "text", "poly", "line")
SHADOWS = ("shadow_in", "shadow_out", "shadow_ein", "shadow_eout")

_OCTAL = re.compile(rb"[0-7]{1,3}")
_SYMBOL = re.compile(rb'[^ \t\n\r\x0b\x0c()"]+')


class Node:
    """A list, symbol or string with its place in the source."""

    __slots__ = ("end", "exact", "items", "kind", "start", "value")

    def __init__(self, kind: str, start: int, end: int, value: str = "", exact: bool = True):
        self.kind, self.start, self.end, self.value, self.exact = kind, start, end, value, exact
        self.items: list[Node] = []


def legacy_strings(data: bytes) -> bool:
    """Whether some escape inside a string is none of the modern ones."""
    at, quoted = 0, False
    while at < len(data):
        c = data[at]
        at += 1
        if c == 0x22:
            quoted = not quoted
        elif quoted and c == 0x5C:
            if at == len(data):
                return False
            if data[at] in ESCAPES:
                at += 1
            elif m := _OCTAL.match(data, at):
                if int(m[0], 8) > 255:
                    return True
                at = m.end()
            else:
                return True
    return False


def _string(data: bytes, at: int, legacy: bool) -> tuple[bytes, int]:
    """(value, place behind the closing quote) of a string whose opening quote was read."""
    out = bytearray()
    while True:
        stop = min((x for x in (data.find(b'"', at), data.find(b"\\", at)) if x >= 0), default=-1)
        if stop < 0:
            raise invalid("unterminated string")
        out += data[at:stop]
        at = stop + 1
        if data[stop] == 0x22:
            return bytes(out), at
        if at == len(data):
            raise invalid("unterminated string")
        if legacy:
            if data[at] == 0x22:
                out.append(0x22)
                at += 1
            else:
                out.append(0x5C)
        elif data[at] in ESCAPES:
            out.append(ESCAPES[data[at]])
            at += 1
        else:
            m = _OCTAL.match(data, at)
            if not m or int(m[0], 8) > 255:
                raise invalid("escape")
            out.append(int(m[0], 8))
            at = m.end()


def parse(data: bytes, legacy: bool, limits: Limits = LIMITS) -> tuple[list[Node], bool]:
    """(top-level expressions, whether some string had to be repaired)."""
    top: list[Node] = []
    open_: list[Node] = []
    count, repaired = 0, False
    at = 3 if data.startswith(b"\xef\xbb\xbf") else 0
    while at < len(data):
        c = data[at]
        if c in SPACE:
            at += 1
            continue
        if c == 0x29:
            if not open_:
                raise invalid("unbalanced")
            at += 1
            open_.pop().end = at
            continue
        count += 1
        if count > limits.annotation_nodes:
            raise exceeded("annotation nodes")
        into = open_[-1].items if open_ else top
        if c == 0x28:
            if len(open_) >= min(64, limits.annotation_depth):
                raise exceeded("annotation depth")
            node = Node("list", at, 0)
            open_.append(node)
            at += 1
        elif c == 0x22:
            value, end = _string(data, at + 1, legacy)
            node = Node("string", at, end, repair(value), is_utf8(value))
            repaired |= not node.exact
            at = end
        else:
            m = _SYMBOL.match(data, at)
            node = Node("symbol", at, m.end(), repair(m[0]), is_utf8(m[0]))
            at = m.end()
        into.append(node)
    if open_:
        raise invalid("unbalanced")
    return top, repaired


def symbol(n: Node | None) -> str | None:
    return n.value if n is not None and n.kind == "symbol" and n.exact else None


def string(n: Node | None) -> str | None:
    return n.value if n is not None and n.kind == "string" else None


def exact_string(n: Node | None) -> str | None:
    """A string that was not repaired: one that was could point elsewhere."""
    return n.value if n is not None and n.kind == "string" and n.exact else None


def integer(n: Node | None) -> int | None:
    s = symbol(n)
    if s is None or not re.fullmatch(r"[+-]?[0-9]+", s, re.ASCII):
        return None
    v = int(s)
    return v if -(2**31) <= v < 2**31 else None


def color(n: Node | None) -> int | None:
    s = symbol(n)
    return int(s[1:], 16) if s is not None and re.fullmatch(r"#[0-9A-Fa-f]{6}", s) else None


def _nth(items: list[Node], k: int) -> Node | None:
    return items[k] if k < len(items) else None


def metadata_entry(n: Node) -> tuple[str, str] | None:
    """(key, value) of a list of a symbol and a string."""
    if len(n.items) != 2:
        return None
    key, value = symbol(n.items[0]), string(n.items[1])
    return None if key is None or value is None else (key, value)


def valid_zoom(s: str) -> bool:
    return s in ZOOMS or bool(re.fullmatch(r"d[0-9]+", s, re.ASCII)) and 1 <= int(s[1:]) <= 999


def _style(option: Node, style: dict) -> None:
    name, value = symbol(_nth(option.items, 0)), _nth(option.items, 1)
    if name is None or len(option.items) > 2:
        return
    if value is None:
        if name in ("none", "xor"):
            style["border"] = {"kind": name, "color": None, "width": None}
        flags = {"border_avis": "always_visible", "arrow": "arrow", "pushpin": "pushpin"}
        if name in flags:
            style[flags[name]] = True
    if (c := color(value)) is not None:
        if name == "border":
            style["border"] = {"kind": "solid", "color": c, "width": 1}
        colors = {"hilite": "highlight", "lineclr": "line_color", "backclr": "background", "textclr": "text_color"}
        if name in colors:
            style[colors[name]] = c
    n = integer(value)
    if n is not None and name == "opacity" and 0 <= n <= 200:
        style["opacity"] = n
    if n is not None and name == "width" and n >= 1:
        style["line_width"] = n
    if name in SHADOWS and (value is None or n is not None and 1 <= n <= 32):
        style["border"] = {"kind": name, "color": None, "width": n}


def empty_style() -> dict:
    return {
        "border": None, "always_visible": False, "highlight": None, "opacity": None, "arrow": False, "line_width": None, "line_color": None,
        "background": None, "text_color": None, "pushpin": False,
    }


def area(form: Node, expression: int, t: Transform) -> dict | None:
    """A map area in unrotated top-left pixels, or None if it isn't well-formed."""
    args = form.items[1:]
    if len(args) < 3:
        return None
    target = None
    href = exact_string(args[0])
    if href is None:
        parts = args[0].items
        if len(parts) != 3 or symbol(parts[0]) != "url":
            return None
        href, target = exact_string(parts[1]), exact_string(parts[2])
        if href is None or target is None:
            return None
    comment = string(args[1])
    shape = args[2].items
    kind = symbol(_nth(shape, 0))
    numbers = [integer(n) for n in shape[1:]]
    if comment is None or kind not in SHAPES or None in numbers or len(numbers) % 2:
        return None
    points = [(float(x), float(y)) for x, y in zip(numbers[::2], numbers[1::2], strict=True)]
    if len(points) < 3 if kind == "poly" else len(points) != 2:
        return None
    if kind not in ("poly", "line"):
        (x, y), (w, h) = points
        if w < 0 or h < 0:
            return None
        points[1] = x + w, y + h
    points = [t.unmap(x, t.page_height - y) for x, y in points]
    xs, ys = [p[0] for p in points], [p[1] for p in points]
    style = empty_style()
    for option in args[3:]:
        _style(option, style)
    return {
        "expression": expression, "href": href, "target": target, "comment": comment, "shape": kind,
        "bounds": {"x": min(xs), "y": min(ys), "width": max(xs) - min(xs), "height": max(ys) - min(ys)},
        "points": [{"x": x, "y": y} for x, y in points] if kind in ("poly", "line") else [], "style": style,
    }


def decode_annotations(data: bytes, info: Info, limits: Limits = LIMITS) -> dict:
    """Everything a page's annotation stream says. Of repeated view options the last valid one counts."""
    if len(data) > limits.annotation_bytes:
        raise exceeded("annotations")
    legacy = legacy_strings(data)
    top, repaired = parse(data, legacy, limits)
    t = transform(info)
    out = {
        "source": repair(data), "bytes": data, "has_replacements": repaired or not is_utf8(data), "legacy_escapes": legacy,
        "expressions": [{"start": n.start, "length": n.end - n.start} for n in top],
        "view": {"background": None, "zoom": None, "mode": None, "alignment": None}, "areas": [], "metadata": [], "xmp": None,
        "header": {"left": None, "center": None, "right": None}, "footer": {"left": None, "center": None, "right": None},
    }
    view = out["view"]
    for k, form in enumerate(top):
        name, arg = symbol(_nth(form.items, 0)), _nth(form.items, 1)
        if name is None or arg is None:
            continue
        only = arg if len(form.items) == 2 else None
        if name == "maparea":
            if found := area(form, k, t):
                out["areas"].append(found)
        elif name == "metadata":
            out["metadata"] += [{"key": e[0], "value": e[1], "expression": k} for n in form.items[1:] if (e := metadata_entry(n))]
        elif name in ("phead", "pfoot"):
            into = out["header" if name == "phead" else "footer"]
            for n in form.items[1:]:
                side, mark, value = (string(n) or "").partition("::")
                if mark and side in into:
                    into[side] = value
        elif name == "align":
            h, v = symbol(arg), symbol(_nth(form.items, 2))
            if len(form.items) == 3 and h in HORIZONTAL and v in VERTICAL:
                view["alignment"] = {"horizontal": h, "vertical": v}
        elif name == "xmp" and string(only) is not None:
            out["xmp"] = string(only)
        elif name == "background" and color(only) is not None:
            view["background"] = color(only)
        elif name == "zoom" and symbol(only) is not None and valid_zoom(symbol(only)):
            view["zoom"] = symbol(only)
        elif name == "mode" and symbol(only) in MODES:
            view["mode"] = symbol(only)
    return out


class Field(NamedTuple):
    """A metadata entry or an XMP packet, and the source bytes that say it."""

    xmp: bool
    key: str
    value: str
    start: int
    end: int


def metadata_fields(data: bytes, limits: Limits = LIMITS) -> list[Field]:
    """Metadata entries, then XMP packets, of a stream; no page information is needed and all packets count."""
    if len(data) > limits.annotation_bytes:
        raise exceeded("annotations")
    top, _ = parse(data, legacy_strings(data), limits)
    entries, packets = [], []
    for form in top:
        name = symbol(_nth(form.items, 0))
        if name == "metadata":
            entries += [Field(False, *e, n.start, n.end) for n in form.items[1:] if (e := metadata_entry(n))]
        elif name == "xmp" and len(form.items) == 2 and string(form.items[1]) is not None:
            packets.append(Field(True, "", string(form.items[1]), form.start, form.end))
    return entries + packets
