"""Rendering of one page from its expanded chunks: layers are planned and decoded once, then composed for every request."""

from __future__ import annotations

import hashlib
from collections import OrderedDict

import numpy as np

from docspark.kernels import iw44
from docspark.kernels.compose import Layer, Page, compose, preview_reduction
from docspark.kernels.core import LIMITS, Bad, Limits, exceeded, invalid, unsupported
from docspark.kernels.geometry import Options, transform
from docspark.kernels.iff import WAVELET_FORMS, Info
from docspark.kernels.jb2 import Image, decode_jb2, rasterize
from docspark.kernels.jpeg import decode_jpeg
from docspark.kernels.mmr import decode_mmr
from docspark.kernels.palette import parse_palette, reduction

#: Pages up to this version place copied symbols by their stored size.
LEGACY = 18


class Part:
    """A chunk of an expanded page: its component, and for an include the component it names."""

    __slots__ = ("comp", "form_hash", "id", "payload", "target")

    def __init__(self, comp: int, id_: str, payload: bytes, target: int | None, form_hash: str | None):
        self.comp, self.id, self.payload, self.target, self.form_hash = comp, id_, payload, target, form_hash


class _Wavelet:
    """A wavelet layer; coefficients are decoded once and reconstructed for each grid asked for."""

    def __init__(self, chunks: list[bytes], limits: Limits):
        self.header = iw44.parse_header(chunks[0])
        self.coefficients = None
        self.chunks, self.limits, self.grids = chunks, limits, {}

    def layer(self, info: Info, options: Options) -> Layer:
        r = preview_reduction(info, options, self.header.width, self.header.height)
        if r not in self.grids:
            self.grids[r] = self._grid(r)
        return Layer(self.grids[r], 0 if r == 1 else r * reduction(info.width, info.height, self.header.width, self.header.height))


    def _grid(self, r: int) -> np.ndarray:
        """The grid of a reduction; small ones are kept, so equal pictures of other pages are decoded once a worker."""
        small = self.header.width * self.header.height <= SMALL_PIXELS
        key = (r, self.limits, *(hashlib.sha256(c).digest() for c in self.chunks)) if small else None
        if key in _grids:
            _grids.move_to_end(key)
            return _grids[key]
        if self.coefficients is None:
            self.coefficients = iw44.decode_coefficients(self.chunks, self.limits)
        out = iw44.reconstruct(self.coefficients, r)
        if small:
            out.setflags(write=False)
            _grids[key] = out
            while len(_grids) > KEPT_GRIDS:
                _grids.popitem(last=False)
        return out


#: Pixels up to which a wavelet layer is small, and the small grids that a worker keeps: 24 MB at most.
SMALL_PIXELS, KEPT_GRIDS = 4096, 2048
_grids: OrderedDict[tuple, np.ndarray] = OrderedDict()

#: Dictionaries that a worker keeps, and their pixels in all: a document's pages follow each other, so each is decoded once a document.
KEPT, KEPT_PIXELS = 32, 32 << 20
_kept: OrderedDict[tuple, tuple[Image, int]] = OrderedDict()


def _dictionary(payload: bytes, inherited: tuple | None, limits: Limits) -> tuple[tuple, Image]:
    """(key, symbols) of a dictionary that inherits from another one, which is given in the same way."""
    key = (hashlib.sha256(payload).digest(), inherited and inherited[0], limits)
    if key in _kept:
        _kept.move_to_end(key)
        return key, _kept[key][0]
    image = decode_jb2(payload, inherited and inherited[1], True, limits=limits)
    _kept[key] = image, sum(x.width * x.height for x in image.symbols[image.inherited :])
    while len(_kept) > 1 and (len(_kept) > KEPT or sum(n for _, n in _kept.values()) > KEPT_PIXELS):
        _kept.popitem(last=False)
    return key, image


def dictionary_of(comp: int, parts: list[Part], limits: Limits) -> Image | None:
    """The symbols a component's image inherits: its own dictionary if it has one, else that of its includes.

    Includes may lead to two dictionaries only if their forms are equal.
    """
    by: dict[int, list[Part]] = {}
    for p in parts:
        by.setdefault(p.comp, []).append(p)
    done: dict[int, int | None] = {}
    images: dict[int, tuple[tuple, Image]] = {}

    def owner(c: int, depth: int) -> int | None:
        if depth >= limits.include_depth:
            raise exceeded("include depth")
        if c in done:
            return done[c]
        found = None
        own = None
        for p in by.get(c, ()):
            if p.id == "INCL" and p.target is not None:
                inherited = owner(p.target, depth + 1)
                if inherited is None:
                    continue
                if found is None:
                    found = inherited
                elif found != inherited and by[found][0].form_hash != by[inherited][0].form_hash:
                    raise unsupported("two dictionaries")
            elif p.id == "Djbz":
                if own is not None:
                    raise invalid("two dictionaries in a component")
                own = p
        if own is not None:
            images[c] = _dictionary(own.payload, images.get(found), limits)
            found = c
        done[c] = found
        return found

    found = owner(comp, 0)
    return images[found][1] if found in images else None


class Decoded:
    """A page's mask and layers."""

    def __init__(self, info: Info, form: str, parts: list[Part], limits: Limits = LIMITS, thumbnail: bool = False):
        self.info, self.wavelets, self.images = info, [None, None], [None, None]
        self.mask = self.palette = None
        if form in WAVELET_FORMS or form == "THUM" or thumbnail:
            tag = "TH44" if form == "THUM" or thumbnail else form
            chunks = [p.payload for p in parts if p.id == tag]
            if not thumbnail and any(p.id in WAVELET_FORMS and p.id != tag for p in parts):
                raise invalid("wavelet chunk")
            self.wavelets[0] = _Wavelet(chunks, limits)
            return
        masks = [p for p in parts if p.id in ("Sjbz", "Smmr")]
        jpegs = [[p for p in parts if p.id == i] for i in ("BGjp", "FGjp")]
        waves = [[p for p in parts if p.id == i] for i in ("BG44", "FG44")]
        colors = [p for p in parts if p.id == "FGbz"]
        known = ("BG44", "FG44", "BGjp", "FGjp", "FGbz")
        if any(p.id in WAVELET_FORMS or p.id[:2] in ("BG", "FG") and p.id not in known for p in parts):
            raise unsupported("layer")
        if len(masks) > 1 or len(colors) > 1 or len(waves[1]) > 1 or any(len(j) > 1 or j and w for j, w in zip(jpegs, waves, strict=True)):
            raise invalid("layers")
        foreground = bool(jpegs[1] or waves[1])
        if foreground and colors or not masks and (foreground or colors):
            raise invalid("foreground")
        for k in (0, 1):
            if len(waves[k]) > limits.iw_chunks:
                raise exceeded("wavelet chunks")
            if waves[k]:
                self.wavelets[k] = _Wavelet([p.payload for p in waves[k]], limits)
                h = self.wavelets[k].header
                reduction(info.width, info.height, h.width, h.height)
        blits = None
        symbols = None
        if masks and masks[0].id == "Sjbz":
            m = masks[0]
            symbols = decode_jb2(m.payload, dictionary_of(m.comp, parts, limits), False, info.version <= LEGACY, limits)
            if (symbols.width, symbols.height) != (info.width, info.height):
                raise invalid("mask size")
            blits = len(symbols.blits)
        elif masks:
            self.mask = decode_mmr(masks[0].payload, limits)
            if self.mask.shape != (info.height, info.width):
                raise invalid("mask size")
        table = index = None
        if colors:
            table, index = parse_palette(colors[0].payload, blits, limits)
        if symbols is not None:
            with_colors = index is not None and len(index) > 0
            self.mask, picked = rasterize(symbols, info.width, info.height, index if with_colors else None)
            if with_colors:
                self.palette = table, picked
        for k in (0, 1):
            if jpegs[k]:
                self.images[k] = decode_jpeg(jpegs[k][0].payload, limits)
                reduction(info.width, info.height, self.images[k].shape[1], self.images[k].shape[0])

    def render(self, options: Options):
        """(RGBA pixels, transform)."""
        layers = [w.layer(self.info, options) if w is not None else Layer(i) if i is not None else None for w, i in zip(self.wavelets, self.images, strict=True)]
        return compose(Page(self.info, self.mask, layers[0], layers[1], self.palette), options)


def options_of(request: dict) -> Options:
    size = None if request.get("box_width") is None else (request["box_width"], request["box_height"])
    region = None if request.get("x") is None else tuple(request[k] for k in ("x", "y", "width", "height"))
    return Options(request.get("subsample") or 1, size, (request.get("rotation") or 0) & 3, region)


def render_requests(info: Info, form: str, parts: list[Part], requests: list[dict], limits: Limits = LIMITS, thumbnail: bool = False):
    """(request, transform, RGBA bytes, status) for every request; a bad request doesn't touch the others."""
    decoded, failure = None, None
    for r in requests:
        try:
            options = options_of(r)
            transform(info, options)
            if decoded is None:
                if failure is not None:
                    raise failure
                try:
                    decoded = Decoded(info, form, parts, limits, thumbnail)
                except Bad as e:
                    failure = e
                    raise
            pixels, t = decoded.render(options)
            yield r, t, np.ascontiguousarray(pixels).tobytes(), "ok"
        except Bad as e:
            yield r, None, None, e.code
