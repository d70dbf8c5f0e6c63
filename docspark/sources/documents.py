"""Document files as tables of containers, forms and pages.

A file is read once by Spark's binary reader, or by ranges (``ranges``) if its path stands for its content. ``containers`` has a row for each document with the entries of its directory; ``forms`` has
a row for each FORM with its chunks. Damage becomes a status, never a failed job.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.functions.arrow import flat_map
from docspark.kernels import iff, iw44
from docspark.kernels.annot import metadata_fields
from docspark.kernels.bzz import bzz_decode
from docspark.kernels.core import LIMITS, Bad, Limits, exceeded, invalid, unsupported
from docspark.operators.includes import walk
from docspark.sources.ranges import content_of

ENTRY = "struct<comp:int,id:string,name:string,title:string,kind:string,size:long,offset:long>"
CONTAINERS = f"doc_id string, size long, form_type string, indirect boolean, entries array<{ENTRY}>, status string, error string"
CHUNK = "struct<ord:int,chunk_id:string,offset:long,length:long,payload:binary>"
FORMS = f"doc_id string, offset long, form string, length long, chunks array<{CHUNK}>, status string, error string"


def read_files(spark: SparkSession, path: str, glob: str = "*", ranges: bool = False) -> DataFrame:
    """doc_id (the path) and content of all files under a path; with ``ranges`` the path stands for the content, and nothing is read yet."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return files.select(F.col("path").alias("doc_id"), (F.col("path") if ranges else F.col("content")).alias("content"))


INFO = "struct<width:int,height:int,dpi:int,rotation:int,gamma_tenths:int,version:int>"
PART = "struct<place:array<int>,comp:int,ord:int,chunk_id:string,payload:binary,dst:int,form_hash:string>"
PAGES = f"doc_id string, page int, comp int, form_type string, image int, info {INFO}, status string, expanded string, parts array<{PART}>"


def leans_on_others(content) -> Column:
    """Whether a file may need other files: an indirect index, or a stand-alone page with includes. Native, so it filters before Python."""
    kind = F.substring(content, 13, 4)
    indirect = (kind == F.lit(b"DJVM")) & (F.conv(F.hex(F.substring(content, 25, 1)), 16, 10).cast("int") < 128)
    return F.coalesce(indirect | ((kind == F.lit(b"DJVU")) & F.contains(content, F.lit(b"INCL"))), F.lit(False))


def leaning_files(files: DataFrame, limits: Limits) -> DataFrame:
    """doc_id of files by ranges that may need other files; only their headers are read."""

    def call(doc_id, content):
        with content_of(content) as data:
            try:
                root = iff.root(data, limits)
                first = next(iff.chunks(root.data[4:]), None)
                leans = root.form == "DJVM" and first is not None and first.id == "DIRM" and len(first.data) > 0 and bytes(first.data[:1])[0] < 128
                if leans or root.form == "DJVU" and any(c.id == "INCL" for c in iff.chunks(root.data[4:])):
                    yield (doc_id,)
            except Bad:
                return

    return flat_map(files.select("doc_id", "content"), "doc_id string", call)


def _text(raw: bytes) -> str:
    return raw.decode("utf-8", "replace")


def directory_of(root: iff.Chunk, limits: Limits) -> tuple[bool, list[tuple]]:
    """(indirect, entries) of a document's root FORM, checked against the FORMs that are there."""
    kind = root.form
    if kind == "DJVM":
        children = root.children()
        if not children or children[0].id != "DIRM":
            raise invalid("no directory")
        if len(children) > limits.chunks:
            raise exceeded("chunks")
        indirect, entries = iff.parse_directory(bytes(children[0].data), limits)
        forms = {c.offset: c for c in children[1:] if c.id == "FORM"}
        if len(forms) > limits.components:
            raise exceeded("components")
        if indirect and forms:
            raise invalid("components in an indirect document")
        for e in entries:
            if e.offset is None:
                continue
            there = forms.get(e.offset)
            if there is None:
                raise invalid("no component at an offset")
            if e.size and e.size != len(there.data) + 8 or there.form != iff.KIND_FORMS[e.kind]:
                raise invalid("component differs from its entry")
        return indirect, [(k, _text(e.id), _text(e.name), _text(e.title), e.kind, e.size, e.offset) for k, e in enumerate(entries)]
    if kind == "DJVU" or kind in iff.WAVELET_FORMS:
        out = [(0, "", "", "", "page", 0, root.offset)]
        seen = {""}
        for c in root.children() if kind == "DJVU" else ():
            if c.id == "INCL":
                id_ = include_id(bytes(c.data))
                if id_ not in seen:
                    seen.add(id_)
                    out.append((len(out), id_, id_, id_, "shared", 0, None))
        return False, out
    if kind == "THUM":
        return False, [(0, "", "", "", "thumbnail", 0, root.offset)]
    raise unsupported(f"form {kind}")


def include_id(raw: bytes) -> str:
    """Name of a component that a stand-alone page includes."""
    id_ = raw.rstrip(b"\0\r\n")
    if not id_ or b"\0" in id_:
        raise invalid("include")
    try:
        return id_.decode("utf-8")
    except UnicodeDecodeError as e:
        raise invalid("include") from e


def containers(files: DataFrame, limits: Limits = LIMITS) -> DataFrame:
    """One row a file (doc_id, content): form type, directory entries and status."""

    def call(doc_id, content):
        form = None
        with content_of(content) as data:
            try:
                root = iff.root(data, limits)
                form = root.form
                indirect, entries = directory_of(root, limits)
                yield doc_id, len(data), form, indirect, entries, "ok", None
            except Bad as e:
                yield doc_id, len(data), form, None, [], e.code, e.why or None

    return flat_map(files.select("doc_id", "content"), CONTAINERS, call)


def forms(files: DataFrame, limits: Limits = LIMITS, wanted=None) -> DataFrame:
    """One row for each FORM of a file: the root, and in a bundled document each component. A damaged one has a status and no chunks.

    Only chunks whose id is ``wanted`` bring their payload along; without it all do.
    """

    def row(doc_id, form: iff.Chunk):
        try:
            children = form.children()
            if len(children) > limits.chunks:
                raise exceeded("chunks")
            # Components are rows of their own; the root of a bundle keeps only its other chunks.
            data = lambda c: bytes(c.data) if wanted is None or wanted(c.id) else None
            kept = [(k, c.id, c.offset, len(c.data), data(c)) for k, c in enumerate(children) if not (form.form == "DJVM" and c.id == "FORM")]
            return (doc_id, form.offset, form.form, len(form.data) + 8, kept, "ok", None), children
        except Bad as e:
            return (doc_id, form.offset, None, len(form.data) + 8, [], e.code, e.why or None), []

    def call(doc_id, content):
        with content_of(content) as data:
            try:
                root = iff.root(data, limits)
            except Bad:
                return
            out, children = row(doc_id, root)
            yield out
            if root.form == "DJVM":
                yield from (row(doc_id, c)[0] for c in children if c.id == "FORM")

    return flat_map(files.select("doc_id", "content"), FORMS, call)


def whole_pages(files: DataFrame, wanted, limits: Limits = LIMITS) -> DataFrame:
    """One row for each page of files that lean on no others, with its expanded chunks whose id is ``wanted``.

    One pass over the file and no shuffle: directory, includes and page information are all inside it.
    """

    def call(doc_id, content):
        with content_of(content) as data:
            try:
                root = iff.root(data, limits)
                _, entries = directory_of(root, limits)
            except Bad:
                return
            yield from ((doc_id, *row) for row in _pages_of(root, entries, wanted, limits))

    return flat_map(files.select("doc_id", "content"), PAGES, call)


class Opened:
    """A parsed file that leans on no others: chunks, kinds and include edges of its components."""

    def __init__(self, root: iff.Chunk, entries: list[tuple], limits: Limits):
        self.forms = {c.offset: c for c in root.children() if c.id == "FORM"} if root.form == "DJVM" else {root.offset: root}
        self.children: dict[int, list[iff.Chunk]] = {}
        self.broken: dict[int, str] = {}
        for comp, *_, offset in entries:
            try:
                found = self.forms[offset].children()
                if len(found) > limits.chunks:
                    raise exceeded("chunks")
                self.children[comp] = found
            except Bad as e:
                self.broken[comp] = e.code
        self.kind = {e[0]: e[4] for e in entries}
        ids = {e[1].encode(): e[0] for e in entries}
        follow = root.form not in iff.WAVELET_FORMS
        target = lambda raw: ids.get(raw, ids.get(raw.rstrip(b"\0\r\n")))
        self.edges = {c: [(k, target(bytes(x.data))) for k, x in enumerate(found) if follow and x.id == "INCL"] for c, found in self.children.items()}

    def walk(self, comp: int, limits: Limits) -> list[tuple]:
        """(comp, path, status, missing) of the components that a root's expansion visits; a damaged one ends it with its own status."""
        visits = walk(comp, self.kind, set(self.children), self.edges, limits.include_depth)
        if visits[0][2] == "MissingComponent" and visits[0][3] in self.broken:
            return [(None, None, self.broken[visits[0][3]], None)]
        return visits


def _pages_of(root: iff.Chunk, entries: list[tuple], wanted, limits: Limits):
    doc = Opened(root, entries, limits)
    forms, children, broken, kind, edges = doc.forms, doc.children, doc.broken, doc.kind, doc.edges
    hashes: dict[int, str] = {}

    def part(place, comp, k, chunk):
        target = dict(edges[comp]).get(k) if chunk.id == "INCL" else None
        if kind[comp] != "page" and comp not in hashes:
            hashes[comp] = hashlib.sha256(bytes(forms[entries[comp][6]].data)).hexdigest()
        return [*place, k], comp, k, chunk.id, bytes(chunk.data), target, hashes.get(comp)

    def info_of(data: bytes | None, dpi: int | None) -> tuple[tuple | None, str]:
        try:
            if data is None:
                raise invalid("no page information")
            if dpi is None:
                found = iff.parse_info(data)
            else:
                head = iw44.parse_header(data)
                found = iff.Info(head.width, head.height, dpi, 0)
            if found.width * found.height > limits.page_pixels:
                raise exceeded("page pixels")
            return tuple(found), "ok"
        except Bad as e:
            return None, e.code

    if root.form == "THUM":
        images = [(k, c) for k, c in enumerate(children.get(0, ())) if c.id == "TH44"]
        for page, (k, c) in enumerate(images):
            info, status = info_of(bytes(c.data[:16]), 300)
            yield page, 0, "THUM", k, info, status, "ok", [part([], 0, k, c)] if wanted(c.id) else []
        return
    for page, comp in enumerate(c for c, k in kind.items() if k == "page"):
        if root.form in iff.WAVELET_FORMS:
            first = next((bytes(c.data[:16]) for c in children.get(comp, ()) if c.id == root.form), None)
            info, status = info_of(first, 100)
        else:
            named = [bytes(c.data) for c in children.get(comp, ()) if c.id == "INFO"]
            info, status = info_of(named[0] if len(named) == 1 else None, None)
        if comp in broken:
            info, status = None, broken[comp]
        visits = doc.walk(comp, limits)
        expanded = visits[0][2]
        found = []
        if expanded == "ok":
            for c, path, _, _ in visits:
                for k, chunk in enumerate(children[c]):
                    if c != comp and chunk.id == "INFO":
                        expanded = "InvalidData"
                    if wanted(chunk.id):
                        found.append(part(path, c, k, chunk))
            found.sort(key=lambda p: p[0])
        yield page, comp, root.form, None, info, status, expanded, found if expanded == "ok" else []


RECORDS = "doc_id string, root int, seq int, xmp boolean, key string, value string, page int, status string"


def whole_records(files: DataFrame, limits: Limits = LIMITS) -> DataFrame:
    """Metadata entries and XMP packets of files that lean on no others, in one pass.

    As in ``operators.metadata``: roots are pages and components that nothing includes, an entry belongs to the first page-owned fragment it
    overlaps, a physical entry counts once, and streams of one contributor are parsed once.
    """

    def call(doc_id, content):
        with content_of(content) as opened:
            try:
                root = iff.root(opened, limits)
                _, entries = directory_of(root, limits)
            except Bad:
                return
            try:
                yield from ((doc_id, *r, "ok") for r in _records_of(Opened(root, entries, limits), limits))
            except Bad as e:
                yield doc_id, None, None, None, None, None, None, e.code

    return flat_map(files.select("doc_id", "content"), RECORDS, call)


def _records_of(doc: Opened, limits: Limits) -> list[tuple]:
    plain: dict[int, list[tuple[int, bytes, int]]] = {}  # component: (place, bytes, place among its own)
    total = 0
    for comp, found in doc.children.items():
        at = 0
        for k, c in enumerate(found):
            if c.id in ("ANTa", "ANTz") and doc.kind[comp] != "thumbnail":
                data = bytes(c.data)
                if c.id == "ANTz" and data:
                    data = bzz_decode(data, min(limits.annotation_bytes - total, limits.bzz_bytes), limits)
                total += len(data)
                if total > limits.annotation_bytes:
                    raise exceeded("annotations")
                plain.setdefault(comp, []).append((k, data, at))
                at += len(data)
    included = {t for targets in doc.edges.values() for _, t in targets}
    owner = {c: page for page, c in enumerate(c for c, kind in doc.kind.items() if kind == "page")}
    out, seen, alone = [], set(), set()
    for root in doc.children:
        if doc.kind[root] == "thumbnail" or root not in owner and root in included:
            continue
        visits = doc.walk(root, limits)
        if visits[0][2] != "ok":
            raise Bad(visits[0][2])
        pieces = sorted(([*path, k], comp, data, own) for comp, path, _, _ in visits for k, data, own in plain.get(comp, ()) if data)
        if not pieces:
            continue
        contributors = {p[1] for p in pieces}
        sole = pieces[0][1] if len(contributors) == 1 else None
        if sole in alone:
            continue
        if sole is not None:
            alone.add(sole)
        starts, at = [], 0
        for _, comp, data, own in pieces:
            starts.append((at, at + len(data), comp, own))
            at += len(data)
        for seq, f in enumerate(metadata_fields(b"".join(p[2] for p in pieces), limits)):
            touched = [s for s in starts if s[0] < f.end and s[1] > f.start]
            page = next((owner[s[2]] for s in touched if s[2] in owner), None)
            identity = f.xmp, f.key, f.value, touched[0][2], touched[0][3] + f.start - touched[0][0], page
            if identity not in seen:
                seen.add(identity)
                out.append((root, seq, f.xmp, f.key, f.value, page))
        if len(out) > limits.annotation_nodes:
            raise exceeded("metadata records")
    return out
