import hashlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docspark.encode import pack
from docspark.encode.pack import Component
from docspark.kernels.iw44 import encode_iw44
from docspark.kernels.jb2 import encode_jb2
from docspark.kernels.mmr import encode_mmr
from docspark.plans.document_set import DocumentSet

INFO = pack.info(12, 10)
IMAGE, OCR, BOOK = pack.chunk("Sjbz", b"not an image"), pack.chunk("TXTz", b"not compressed text"), pack.chunk("Djbz", b"not a dictionary")


def page(*chunks, info=INFO):
    return pack.form("DJVU", info, *chunks)


def shared(*chunks):
    return pack.form("DJVI", *chunks)


@pytest.fixture(scope="module")
def make(spark):
    def files(docs: dict[str, bytes]):
        return spark.createDataFrame([(k, bytearray(v)) for k, v in docs.items()], "doc_id string, content binary")

    return files


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def book():
    """Entries shared by pages, repeated includes, an unreferenced component; image, text and dictionary that no question may touch."""
    said = rb'(metadata (Title "Shared") (Creator "Scanner") (Unknown "A\nB") (Title "Shared"))(xmp "packet-one")(xmp "packet-two")'
    return [
        Component("shared.djvi", "shared_annotations", shared(BOOK, pack.annotations(said, True))),
        Component("first.djvu", "page", page(pack.include("shared.djvi"), IMAGE, OCR)),
        Component("second.djvu", "page", page(pack.include("shared.djvi"), pack.include("shared.djvi\n"), IMAGE)),
        Component("late.djvu", "page", page(IMAGE, pack.annotations(b'(metadata (Title "Late") (title "lower") (Extra "same") (Extra "same"))'))),
        Component("orphan.djvi", "shared", shared(pack.annotations(b'(metadata (Unreferenced "kept"))'))),
    ]


BOOK_ROWS = [
    ("Title", "Shared", None), ("Creator", "Scanner", None), ("Unknown", "A\nB", None), ("Title", "Shared", None), ("Title", "Late", 2), ("title", "lower", 2),
    ("Extra", "same", 2), ("Extra", "same", 2), ("Unreferenced", "kept", None),
]


def context():
    """Entries and escapes that span includes."""
    tail = [pack.include("prefix"), pack.annotations(b'end"))'), pack.include("shared-prefix"), pack.include("shared-suffix")]
    return [
        Component("fragment", "shared", shared(pack.annotations(b"middle"))), Component("escaped", "shared", shared(pack.annotations(rb'(metadata (Title "A\nB"))'))),
        Component("split", "page", page(pack.annotations(b'(metadata (Title "start-'), pack.include("fragment"), pack.annotations(b'-end"))', True))),
        Component("modern", "page", page(pack.include("escaped"))), Component("legacy", "page", page(pack.include("escaped"), pack.annotations(rb'(metadata (Path "C:\query"))'))),
        Component("prefix", "shared", shared(pack.annotations(b'(metadata (Title "Common-'))), Component("shared-prefix", "shared", shared(pack.annotations(b'(metadata (Title "Shared-'))),
        Component("shared-suffix", "shared", shared(pack.annotations(b'end"))'))), Component("joined-first", "page", page(*tail)), Component("joined-second", "page", page(*tail)),
    ]


def test_metadata(make, spark):
    cycle = [Component("a", "shared", shared(pack.include("b"))), Component("b", "shared", shared(pack.include("a"))), Component("p", "page", page(pack.include("a")))]
    docs = {"book": pack.bundle(book()), "context": pack.bundle(context()), "none": pack.document(page(IMAGE, OCR)), "cycle": pack.bundle(cycle)}
    index, parts = pack.indirect(book())
    d = DocumentSet(make(docs))
    joined = DocumentSet(make({"indirect": index}), spark.createDataFrame([("indirect", n, bytearray(c)) for n, c in parts.items()], "doc_id string, name string, content binary"))
    got = {}
    for doc, _, key, value, p in rows(d.metadata(), "doc_id", "seq") + rows(joined.metadata(), "doc_id", "seq"):
        got.setdefault(doc, []).append((key, value, p))
    assert got["book"] == got["indirect"] == BOOK_ROWS
    assert [(v, p) for _, v, p in got["context"]] == [
        ("start-middle-end", 0), ("A\nB", None), (r"A\nB", None), (r"C:\query", 2), ("Common-end", 3), ("Shared-end", None), ("Common-end", 4),
    ]
    assert set(got) == {"book", "indirect", "context"}
    assert [r[2:] for r in rows(d.xmp().where("doc_id = 'book'"), "seq")] == [("packet-one", None), ("packet-two", None)]


def test_documents_and_components(make):
    whole = pack.bundle(book())
    d = DocumentSet(make({"book": whole, "cut": whole[:-30], "junk": b"nothing at all", "odd": pack.document(pack.form("ABCD")), "page": pack.document(page())}))
    by = {r.doc_id: r for r in d.documents().collect()}
    assert {k: (r.form_type, r.page_count, r.status) for k, r in by.items()} == {
        "book": ("DJVM", 3, "ok"), "cut": (None, None, "InvalidData"), "junk": (None, None, "InvalidData"), "odd": ("ABCD", None, "Unsupported"), "page": ("DJVU", 1, "ok"),
    }
    c = d.components().where("doc_id = 'book'").orderBy("comp").collect()
    assert [(r.id, r.kind, r.loaded) for r in c] == [(x.id, x.kind, True) for x in book()]
    assert all(whole[r.range_offset : r.range_offset + 4] == b"FORM" and r.range_length == r.size for r in c)


def test_missing_components_and_late_arrival(make, spark):
    index, parts = pack.indirect(book())

    def with_parts(*names):
        given = spark.createDataFrame([("d", n, bytearray(parts[n])) for n in names], "doc_id string, name string, content binary")
        return DocumentSet(make({"d": index}), given)

    assert [r[1:] for r in rows(with_parts().missing("page"), "page")] == [(0, 1, "first.djvu"), (1, 2, "second.djvu"), (2, 3, "late.djvu")]
    some = with_parts("first.djvu", "late.djvu")
    assert [r[1:] for r in rows(some.missing("includes"), "page")] == [(0, 0, "shared.djvi"), (1, 2, "second.djvu")]
    assert {(r.page, r.status) for r in some.pages().collect()} == {(0, "ok"), (1, "MissingComponent"), (2, "ok")}
    assert rows(with_parts(*parts).missing("includes"), "page") == []


def test_includes_expand_in_place_once(make):
    parts = [
        Component("c", "shared", shared(pack.chunk("AAAA", b"c"))), Component("a", "shared", shared(pack.chunk("AAAA", b"a1"), pack.include("c"), pack.chunk("AAAA", b"a2"))),
        Component("b", "shared", shared(pack.include("c"), pack.include("a"), pack.chunk("AAAA", b"b"))),
        Component("p", "page", page(pack.chunk("AAAA", b"p"), pack.include("a\r\n"), pack.include("b"), pack.chunk("AAAA", b"q"))), Component("q", "page", page(pack.include("p"))), Component("r", "page", page(pack.include("x"))),
    ]
    index, files = pack.indirect(parts)
    for d in (DocumentSet(make({"d": pack.bundle(parts)})),):
        c = d.page_chunks().where("chunk_id = 'AAAA'")
        assert [bytes(r[-1]).decode() for r in rows(c.where("page = 0"), "seq")] == ["p", "a1", "c", "a2", "b", "q"]
        assert rows(c.where("page > 0"), "seq") == []
        assert {(r.page, r.status) for r in d.text().collect()} == {(1, "InvalidData"), (2, "InvalidData")}


def test_bundled_equals_indirect(make, spark):
    parts = [Component("s", "shared", shared(pack.text(b"shared words"))), Component("p", "page", page(pack.include("s"))), Component("q", "page", page(pack.text("zwei \u00fc".encode(), compressed=True)))]
    index, files = pack.indirect(parts)
    given = spark.createDataFrame([("i", n, bytearray(c)) for n, c in files.items()], "doc_id string, name string, content binary")
    d = DocumentSet(make({"b": pack.bundle(parts), "i": index, "v0": pack.bundle(parts, version=0), "z": pack.bundle(parts, zero_sizes=True)}), given)
    got = {}
    for r in d.text().collect():
        got.setdefault(r.doc_id, set()).add((r.page, r.text, r.status))
    assert set(got) == {"b", "i", "v0", "z"} and all(v == {(0, "shared words", "ok"), (1, "zwei \u00fc", "ok")} for v in got.values())


def test_text_damage_stays_on_its_page(make):
    parts = [Component("p", "page", page(OCR)), Component("q", "page", page(pack.text(b"a"), pack.text(b"b"))), Component("r", "page", page(pack.text(b"\xffok")))]
    t = rows(DocumentSet(make({"d": pack.bundle(parts)})).text().select("page", "text", "has_replacements", "status"), "page")
    assert t[0][:3] == (0, None, None) and t[0][3] in ("InvalidData", "LimitExceeded")
    assert t[1:] == [(1, None, None, "InvalidData"), (2, "\ufffdok", True, "ok")]


def test_annotations_are_parsed_after_joining_chunks(make):
    d = DocumentSet(make({"d": pack.document(page(pack.annotations(b'(maparea "#1" "a'), pack.annotations(b'b" (rect 1 2 3 4))', True), pack.chunk("ANTz", b""), info=pack.info(12, 10)))}))
    r = d.annotations().first()
    assert r.status == "ok" and [(c.start, c.length) for c in r.chunks] == [(0, 16), (16, 18), (34, 0)]
    a = d.areas().first()
    assert (a.href, a.comment, tuple(a.bounds)) == ("#1", "ab", (1.0, 4.0, 3.0, 4.0))


def test_outline(make):
    navm = pack.outline([("A", "#1", 1), ("B", "#x", 0)])
    parts = [Component("p", "page", page())]
    d = DocumentSet(make({"d": pack.bundle(parts, navm), "two": pack.bundle(parts, navm + navm), "bad": pack.bundle(parts, pack.chunk("NAVM", b"??"))}))
    got = rows(d.outline(), "doc_id", "idx")
    assert [r for r in got if r[0] == "d"] == [("d", 0, "A", "#1", None, 2, "ok"), ("d", 1, "B", "#x", 0, 2, "ok")]
    failed = {r[0]: r[-1] for r in got if r[0] != "d"}
    assert failed["two"] == "InvalidData" and failed["bad"] in ("InvalidData", "LimitExceeded")


def _links_document():
    forms = [("page-a", "sheet a.djvu", "Repeat"), ("page-b", "sheet b.djvu", "3"), ("2", "sheet c.djvu", "Repeat"), ("+1", "sheet d.djvu", "Last"), ("page e", "file e.djvu", "Приложение α"), ("page%20e", "dup.djvu", "Repeat"), ("page-g", "dup.djvu", "Appendix")]
    return pack.bundle([Component("shared", "shared", shared(), "shared.iff", "Shared"), *(Component(i, "page", page(), n, t) for i, n, t in forms)])


LINKS = [
    ("", None, "none", None), ("#", None, "unresolved", None), ("#1", None, "page", 0), ("#2", None, "page", 2), ("#3", None, "page", 1), ("#003", None, "page", 2), ("#7", None, "page", 6),
    ("#0", None, "unresolved", None), ("#8", None, "unresolved", None), ("#+1", None, "page", 3), ("#+1", 6, "page", 3), ("#+2", None, "unresolved", None), ("#+2", 4, "page", 6),
    ("#+2", 5, "unresolved", None), ("#-1", 3, "page", 2), ("#-1", 0, "unresolved", None), ("#-0", 2, "page", 2), ("#+0002", 0, "page", 2), ("#" + "9" * 36, None, "unresolved", None),
    ("#+" + "9" * 36, 1, "unresolved", None), ("#Repeat", None, "page", 0), ("#Repeat", 2, "page", 2), ("#Repeat", 3, "page", 5), ("#Repeat", 6, "page", 0), ("#repeat", None, "unresolved", None),
    ("#Приложение α", None, "page", 4), ("#sheet b.djvu", None, "page", 1), ("#dup.djvu", None, "unresolved", None), ("#shared", None, "unresolved", None), ("#page e", None, "page", 4),
    ("#page%20e", None, "page", 5), ("#file%20e.djvu", None, "unresolved", None), ("#2_0", None, "unresolved", None), ("#1\0", None, "unresolved", None), ("?page=2&zoom=width", None, "options", None),
    ("https://example.invalid/α#2", None, "url", None), ("javascript:alert(1)", None, "url", None), ("other.djvu#3", None, "url", None), ("#1", 7, "InvalidArgument", None),
]


def test_links(make, spark):
    asked = spark.createDataFrame([("d", k, h, f) for k, (h, f, _, _) in enumerate(LINKS)], "doc_id string, k int, href string, from_page int")
    got = DocumentSet(make({"d": _links_document()})).resolve_links(asked)
    assert [(r.link.kind, r.link.page) for r in got.orderBy("k").collect()] == [(k, p) for _, _, k, p in LINKS]


def _gray(v, h=10, w=12):
    return np.full((h, w), v, np.uint8)


def _wave(id_, pixels, **more):
    return b"".join(pack.chunk(id_, c) for c in encode_iw44(pixels, **more))


def test_render_layers(make, spark):
    ink = np.zeros((10, 12), np.uint8)
    ink[2:5, 3:9] = 1
    symbols = [(np.ones((3, 6), np.uint8), 3, 5)]
    book_ = encode_jb2(0, 0, symbols)
    docs = {
        "mask": page(pack.chunk("Smmr", encode_mmr(ink))), "back": page(pack.chunk("Smmr", encode_mmr(ink)), _wave("BG44", _gray(200, 5, 6))),
        "fore": page(pack.chunk("Sjbz", encode_jb2(12, 10, symbols)), _wave("FG44", _gray(40, 2, 2)), _wave("BG44", _gray(200), slices=(40, 60))),
        "colors": page(pack.chunk("Sjbz", encode_jb2(12, 10, symbols)), pack.palette([(9, 8, 7), (1, 2, 3)], [1])), "two": page(pack.chunk("Smmr", encode_mmr(ink)), pack.chunk("Sjbz", encode_jb2(12, 10, symbols))),
        "orphan": page(_wave("FG44", _gray(1))), "unknown": page(pack.chunk("BG2k", b"?")), "damaged": page(pack.chunk("Smmr", b"MMR\0")), "empty": page(),
    }
    dictionary = [Component("d", "shared", shared(pack.chunk("Djbz", book_))), Component("p", "page", page(pack.include("d"), pack.chunk("Sjbz", encode_jb2(12, 10, symbols, [symbols[0][0]]))))]
    files = {k: pack.document(v) for k, v in docs.items()} | {"shared": pack.bundle(dictionary), "photo": pack.document(pack.form("PM44", _wave("PM44", _gray(77))))}
    got = {r.doc_id: r for r in DocumentSet(make(files)).render().collect()}

    def colors(k):
        p = np.frombuffer(got[k].rgba, np.uint8).reshape(got[k].height, got[k].width, 4)[..., :3]
        if p.shape[0] != 10:
            return None
        return set(map(tuple, p[ink > 0].tolist())), set(map(tuple, p[ink == 0].tolist()))

    black, white = (0, 0, 0), (255, 255, 255)
    assert colors("mask") == colors("shared") == ({black}, {white})
    assert colors("back") == ({black}, {(200,) * 3}) and colors("fore") == ({(40,) * 3}, {(200,) * 3}) and colors("colors") == ({(1, 2, 3)}, {white})
    assert colors("empty") == ({white}, {white}) and colors("photo") == ({(77,) * 3}, {(77,) * 3})
    assert {k: got[k].status for k in ("two", "orphan", "unknown", "damaged")} == {"two": "InvalidData", "orphan": "InvalidData", "unknown": "Unsupported", "damaged": "InvalidData"}


def test_requests_share_a_page_and_tiles_are_crops(make, spark):
    rng = np.random.default_rng(0)
    doc = pack.document(page(pack.chunk("Smmr", encode_mmr((rng.random((10, 12)) < 0.4).astype(np.uint8))), info=pack.info(12, 10, rotation=1)))
    asked = [("full", None, None, 0, None), ("tile", None, None, 0, (2, 3, 4, 5)), ("fit", 7, 30, 1, None), ("bad", None, None, 0, (0, 0, 99, 1))]
    schema = "doc_id string, page int, request_id string, box_width int, box_height int, rotation int, x int, y int, width int, height int"
    requests = spark.createDataFrame([("d", 0, n, a, b, r, *(c or (None,) * 4)) for n, a, b, r, c in asked], schema)
    got = {r.request_id: r for r in DocumentSet(make({"d": doc})).render(requests).collect()}
    assert got["bad"].status == "InvalidArgument" and (got["fit"].page_width, got["fit"].page_height) == (7, 5)
    full = np.frombuffer(got["full"].rgba, np.uint8).reshape(12, 10, 4)
    assert (np.frombuffer(got["tile"].rgba, np.uint8).reshape(5, 4, 4) == full[3:8, 2:6]).all()


def test_reduced_layers_are_used_where_a_fit_is_small(make, spark):
    g = np.clip(np.add.outer(np.arange(64) * 3, np.arange(64)), 0, 255).astype(np.uint8)
    doc = pack.document(pack.form("DJVU", pack.info(64, 64), _wave("BG44", g)))
    requests = spark.createDataFrame([("d", 0, "a", 16, 16), ("d", 0, "b", 40, 40)], "doc_id string, page int, request_id string, box_width int, box_height int")
    got = {r.request_id: np.frombuffer(r.rgba, np.uint8).reshape(r.height, r.width, 4) for r in DocumentSet(make({"d": doc})).render(requests).collect()}
    from docspark.kernels.iw44 import decode_iw44

    small = decode_iw44(encode_iw44(g), 4)
    assert (got["a"][..., :3] == small).all()  # each output pixel is one cell of the reduced grid
    assert got["b"].shape == (40, 40, 4)


def test_thumbnails(make):
    stored = pack.form("THUM", _wave("TH44", _gray(10, 3, 4)), _wave("TH44", _gray(20, 3, 4)))
    local = b"".join(pack.chunk("TH44", c) for c in encode_iw44(_gray(30, 5, 5), (40, 60)))
    parts = [
        Component("p0", "page", page(local)), Component("t", "thumbnail", stored), Component("p1", "page", page()), Component("p2", "page", page(local)),
        Component("p3", "page", page(local)), Component("t2", "thumbnail", pack.form("THUM")), Component("p4", "page", page()),
    ]
    d = DocumentSet(make({"d": pack.bundle(parts), "alone": pack.document(stored)}))
    got = {(r.doc_id, r.page): (r.width, r.height, r.rgba[0]) for r in d.thumbnails().collect()}
    assert got == {("d", 0): (5, 5, 30), ("d", 1): (4, 3, 10), ("d", 2): (4, 3, 20), ("d", 3): (5, 5, 30), ("alone", 0): (4, 3, 10), ("alone", 1): (4, 3, 20)}


def test_results_do_not_depend_on_partitions(make, spark):
    files = make({f"d{k}": pack.bundle(book()) for k in range(6)})
    one, many = DocumentSet(files.coalesce(1)), DocumentSet(files.repartition(5))
    assert rows(one.metadata(), "doc_id", "seq") == rows(many.metadata(), "doc_id", "seq")
    assert rows(one.pages(), "doc_id", "page") == rows(many.pages(), "doc_id", "page")


def test_a_changed_byte_never_raises_and_shows(make):
    good = pack.document(page(pack.text(b"some words", compressed=True)))
    docs = {f"{k}": good[:k] + bytes([good[k] ^ 0x41]) + good[k + 1 :] for k in range(4, len(good))}
    d = DocumentSet(make(docs | {"good": good}))
    told = {r.doc_id: (r.text, r.status) for r in d.text().collect()}
    assert told["good"] == ("some words", "ok")
    changed = [k for k in range(len(good) - 20, len(good) - 2) if told.get(str(k)) != ("some words", "ok")]
    assert len(changed) > 9


def test_read_from_files_and_chunk_source(spark, tmp_path):
    from docspark.plans.document_set import read_documents
    from docspark.sources import datasource

    index, parts = pack.indirect(book())
    folder = tmp_path / "set"
    folder.mkdir()
    (folder / "index.djvu").write_bytes(index)
    for name, content in parts.items():
        (folder / name).write_bytes(content)
    d = read_documents(spark, str(folder))
    assert [(r.key, r.value, r.page) for r in d.metadata().where("doc_id LIKE '%index.djvu'").orderBy("seq").collect()] == BOOK_ROWS
    (tmp_path / "book.djvu").write_bytes(pack.bundle(book()))
    datasource.register(spark)
    c = spark.read.format("layered_chunks").load(str(tmp_path / "book.djvu"))
    assert c.where("chunk_id = 'INCL'").count() == 3
    assert {r.chunk_id for r in c.collect()} == {"DIRM", "Djbz", "ANTz", "INFO", "INCL", "Sjbz", "TXTz", "ANTa"}
    pushed = spark.read.format("layered_chunks").option("pushdown", "true").load(str(tmp_path / "book.djvu")).where("chunk_id IN ('INCL', 'DIRM')")
    assert pushed.count() == 4 and spark.read.format("layered_chunks").option("chunk_ids", "ANTa, ANTz").load(str(tmp_path / "book.djvu")).count() == 3
    assert spark.read.format("layered_chunks").option("payload", "false").load(str(tmp_path / "book.djvu")).where("payload IS NOT NULL").count() == 0


def test_assembled_stream(spark, tmp_path):
    from docspark.streaming.assemble import arrivals_of, assemble

    index, parts = pack.indirect([Component("p", "page", page(pack.text(b"late words"))), Component("q", "page", page())])
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")  # else a bounded run waits for the timeout
    source = tmp_path / "in"
    whole, lacking = source / "whole", source / "lacking"
    for folder in (whole, lacking):
        folder.mkdir(parents=True)
        (folder / "index.djvu").write_bytes(index)
    (whole / "p").write_bytes(parts["p"])

    def run():
        files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", "true").load(str(source))
        q = assemble(arrivals_of(files)).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.read.parquet(str(tmp_path / "out")).collect()

    assert run() == []
    (whole / "q").write_bytes(parts["q"])
    got = run()
    assert [(r.doc_id.rsplit("/", 1)[1], r.status, sorted(f.name for f in r.files)) for r in got] == [("whole", "ok", ["p", "q"])]
    supplied = spark.createDataFrame([("w", f.name, bytearray(f.content)) for f in got[0].files], "doc_id string, name string, content binary")
    files = spark.createDataFrame([("w", bytearray(got[0].content))], "doc_id string, content binary")
    assert [(r.page, r.text) for r in DocumentSet(files, supplied).text().collect()] == [(0, "late words")]
    (whole / "q2").write_bytes(parts["q"])  # a late repeat of a document that has left
    assert [r.doc_id.rsplit("/", 1)[1] for r in run()] == ["whole"]


def test_sql_functions(spark):
    from docspark.functions import sql
    from docspark.kernels.bzz import bzz_encode

    sql.register(spark)
    spark.createDataFrame([(bytearray(bzz_encode(b"abc")), bytearray(pack.bundle(book())), bytearray(b'(a "b" (c))'))], "z binary, d binary, s binary").createOrReplaceTempView("t")
    assert bytes(spark.sql("SELECT bzz_decode(z) AS b FROM t").first().b) == b"abc"
    assert spark.sql("SELECT bzz_decode(d) AS b FROM t").first().b is None
    assert [r.chunk_id for r in spark.sql("SELECT c.* FROM t, LATERAL iff_chunks(d) c ORDER BY ord").collect()] == ["DIRM"] + ["FORM"] * 5
    assert [(r.depth, r.kind, r.value) for r in spark.sql("SELECT n.* FROM t, LATERAL sexpr_nodes(s) n ORDER BY idx").collect()] == [(0, "list", ""), (1, "symbol", "a"), (1, "string", "b"), (1, "list", ""), (2, "symbol", "c")]
    assert [tuple(r) for r in spark.sql("SELECT w.at, w.weight FROM axis_weights(0, 11, 4) w").collect()] == [(0, 4), (1, 4), (2, 3)]
    assert spark.sql("SELECT link_kind('?a') AS a, link_kind('#b') AS b").first() == ("options", "page")
    picture = encode_iw44(_gray(9, 4, 5))[0]
    spark.createDataFrame([(bytearray(picture),)], "w binary").createOrReplaceTempView("u")
    r = spark.sql("SELECT iw44_decode(w) AS p, iw44_header(w) AS h, jpeg_decode(w) AS j FROM u").first()
    assert (r.p.width, r.p.height, set(r.p.rgb)) == (5, 4, {9}) and not r.h.color and r.j.width is None


def test_sql_functions_of_pages(spark):
    from docspark.functions import sql

    sql.register(spark)
    ink = np.eye(10, 12, dtype=np.uint8)
    masks = [encode_mmr(ink), encode_mmr(np.fliplr(ink))]
    content = pack.document(page(pack.chunk("Smmr", masks[0])))
    spark.createDataFrame([(bytearray(content), bytearray(m)) for m in masks], "d binary, m binary").createOrReplaceTempView("pages_of_masks")
    r = spark.sql("SELECT render_page(d, 0, 1) AS a, render_page(d, 1, 1) AS b, render_page(m, 0, 1) AS c FROM pages_of_masks").first()
    assert (r.a.width, r.a.height, r.a.status, r.b.status, r.c.status) == (12, 10, "ok", "InvalidArgument", "InvalidData")
    assert (np.frombuffer(r.a.rgba, np.uint8)[::4].reshape(10, 12) == 255 - 255 * ink).all()
    u = spark.sql("SELECT union_mask(mmr_decode(m).mask) AS u FROM pages_of_masks").first().u
    assert bytes(u) == np.packbits((ink | np.fliplr(ink)).ravel(), bitorder="little").tobytes()
    g = spark.sql("SELECT geometry_of(12, 10, 1, 1, CAST(NULL AS INT), CAST(NULL AS INT), 0) AS g, geometry_of(12, 10, 0, 0, 5, 5, 0) AS h").first()
    assert (g.g.page_width, g.g.page_height, g.g.rotation) == (10, 12, 1)
    spark.createDataFrame([(bytearray(encode_iw44(_gray(9, 4, 5))[0]),)], "w binary").createOrReplaceTempView("thumbs")
    assert spark.sql("SELECT thumbnail_decode(w).width AS w FROM thumbs").first().w == 5


def test_a_dictionary_is_decoded_once(monkeypatch):
    """Pages that share a dictionary decode it once in a worker, whatever else they inherit; what is kept stays bounded."""
    from docspark.functions import render
    from docspark.kernels.iff import Info

    square = np.ones((3, 3), np.uint8)
    book = [encode_jb2(0, 0, [(square * (k % 2), 0, 0)], comment=bytes([k])) for k in range(40)]
    calls = []
    real = render.decode_jb2
    monkeypatch.setattr(render, "decode_jb2", lambda data, *a, **k: calls.append(data) or real(data, *a, **k))
    render._kept.clear()
    mask = encode_jb2(9, 9, [(square, 1, 1)], [square])
    for _ in range(5):
        parts = [render.Part(1, "Djbz", book[1], None, "h"), render.Part(0, "INCL", b"", 1, None), render.Part(0, "Sjbz", mask, None, None)]
        (_, _, rgba, status), = render.render_requests(Info(9, 9, 300, 0), "DJVU", parts, [{}])
        assert status == "ok" and (np.frombuffer(rgba, np.uint8)[::4] == 0).sum() == 9
    assert calls.count(book[1]) == 1
    for b in book:
        render.dictionary_of(0, [render.Part(0, "Djbz", b, None, None)], render.LIMITS)
    assert len(render._kept) <= render.KEPT


@pytest.mark.parametrize("progressive", [False, True])
@pytest.mark.parametrize("shape", [(9, 13), (40, 33)])
def test_jpeg_against_the_jvm(spark, progressive, shape):
    """Pictures written by the JVM's encoder come back within a few levels of the JVM's own decoder."""
    from docspark.kernels.jpeg import decode_jpeg

    jvm, (h, w) = spark.sparkContext._jvm, shape
    y, x = np.mgrid[:h, :w]
    rgb = np.stack([128 + 100 * np.sin(x / 9), 128 + 90 * np.cos(y / 7), 128 + 60 * np.sin((x + y) / 11)], 2).astype(np.uint8)
    image = jvm.java.awt.image.BufferedImage(w, h, 1)
    for j in range(h):
        for i in range(w):
            image.setRGB(i, j, int(rgb[j, i, 0]) << 16 | int(rgb[j, i, 1]) << 8 | int(rgb[j, i, 2]))
    writer = jvm.javax.imageio.ImageIO.getImageWritersByFormatName("jpeg").next()
    param = writer.getDefaultWriteParam()
    if progressive:
        param.setProgressiveMode(1)
    stream = jvm.java.io.ByteArrayOutputStream()
    writer.setOutput(jvm.javax.imageio.ImageIO.createImageOutputStream(stream))
    writer.write(None, jvm.javax.imageio.IIOImage(image, None, None), param)
    writer.getOutput().flush()
    data = bytes(stream.toByteArray())
    back = jvm.javax.imageio.ImageIO.read(jvm.java.io.ByteArrayInputStream(data))
    other = np.array([[back.getRGB(i, j) & 0xFFFFFF for i in range(w)] for j in range(h)])
    other = np.stack([other >> 16, other >> 8 & 255, other & 255], 2)
    ours = decode_jpeg(data).astype(int)
    assert ours.shape == (h, w, 3) and np.abs(ours - other).max() <= 6 and np.abs(ours - other).mean() < 1.5


def test_repaired_text_matches_python(spark):
    from docspark.functions import native

    cases = [b"\x80A\xffB", b"\xed\xa0\x80", b"\xf0\x9f\x98", b"\xe2(\xa1", "α🙂".encode(), b"\xef\xbb\xbfA"]
    df = spark.createDataFrame([(k, bytearray(c)) for k, c in enumerate(cases)], "k int, b binary").withColumn("t", native.repaired(F.col("b"))).withColumn("s", native.span_text(F.col("b"), F.lit(1), F.lit(2)))
    for r in df.collect():
        assert r.t == cases[r.k].decode("utf-8", "replace") and r.s == cases[r.k][1:3].decode("utf-8", "replace")


def test_documents_by_ranges(spark, tmp_path):
    """The same answers whether files are read whole or by ranges; a gigabyte of image data that a question does not need stays unread."""
    from docspark.plans.document_set import read_documents

    index, parts = pack.indirect([Component("p", "page", page(pack.include("s"), pack.text(b"one"))), Component("s", "shared", shared(pack.annotations(b'(metadata (k "v"))')))])
    folder = tmp_path / "docs"
    folder.mkdir()
    for name, data in {"index.djvu": index, **parts, "book.djvu": pack.bundle(book()), "alone.djvu": pack.document(page(pack.text(b"two"))), "damaged.djvu": b"AT&TFORM"}.items():
        (folder / name).write_bytes(data)
    whole, ranged = (read_documents(spark, str(folder), ranges=r) for r in (False, True))
    for ask in (lambda d: d.documents(), lambda d: d.components(), lambda d: d.pages(), lambda d: d.metadata()):
        assert sorted(map(repr, ask(whole).collect())) == sorted(map(repr, ask(ranged).collect()))

    large = tmp_path / "large"
    large.mkdir()
    notes = pack.annotations(b'(metadata (Title "of a large page"))')
    size, head = 1 << 30, b"DJVU" + pack.info(10, 10)
    total = len(head) + 8 + size + len(notes)
    with open(large / "scan.djvu", "wb") as f:  # a hole in the file, so the test needs no disk
        f.write(b"AT&TFORM" + total.to_bytes(4, "big") + head + b"BG44" + size.to_bytes(4, "big"))
        f.seek(size, 1)
        f.write(notes)
    d = read_documents(spark, str(large), ranges=True)
    assert [(r.key, r.value, r.page) for r in d.metadata().collect()] == [("Title", "of a large page", 0)]
    assert [(r.width, r.status) for r in d.pages().collect()] == [(10, "ok")]


def test_spans():
    import io

    from docspark.sources.ranges import Span

    data = bytes(range(100))
    s = Span(io.BytesIO(data), 0, 100)
    for a, b in ((0, 100), (3, 50), (-10, None), (90, 400), (60, 20)):
        assert bytes(s[a:b]) == data[a:b] and len(s[a:b]) == len(data[a:b]) and bytes(s[a:b][2:5]) == data[a:b][2:5]
    assert s.startswith(b"\0\1") and s[65:70].decode() == "ABCDE"


def test_hash_of_a_page_is_stable(make):
    doc = pack.document(page(pack.chunk("Smmr", encode_mmr(np.eye(10, 12, dtype=np.uint8)))))
    r = DocumentSet(make({"d": doc})).render().first()
    assert hashlib.sha256(bytes(r.rgba)).hexdigest() == hashlib.sha256(np.concatenate([np.repeat(255 - 255 * np.eye(10, 12, dtype=np.uint8)[:, :, None], 3, 2), np.full((10, 12, 1), 255, np.uint8)], 2).tobytes()).hexdigest()


def test_viewport_questions(spark):
    from docspark.functions import native
    from docspark.operators import zones

    z = [("d", 0, k, kind, x, 0, w, 10, n, e) for k, (kind, x, w, n, e) in enumerate([("page", 0, 99, 9, 6), ("word", 0, 10, 3, 3), ("character", 0, 5, 1, 3), ("line", 20, 10, 2, 4), ("word", 40, 10, 0, 5), ("word", 60, 10, 2, 6)])]
    table = spark.createDataFrame(z, "doc_id string, page int, idx int, kind string, x int, y int, width int, height int, text_length int, subtree_end int").withColumn("text_start", F.col("idx") * 2)
    chosen = zones.selectable(table)
    assert sorted(r.idx for r in chosen.collect()) == [1, 3, 5]
    points = spark.createDataFrame([("d", 0, "in", 62, 5), ("d", 0, "near", 33, 5), ("d", 0, "far", 200, 90)], "doc_id string, page int, point_id string, px int, py int")
    assert {r.point_id: r.idx for r in zones.hit(chosen, points).collect()} == {"in": 5}
    assert {r.point_id: r.idx for r in zones.hit(chosen, points, nearest=True).collect()} == {"in": 5, "near": 3, "far": 5}
    assert [tuple(r) for r in zones.selection(chosen).collect()] == [("d", 0, 2, 12)]
    page_ = table.groupBy("doc_id", "page").agg(F.sort_array(F.collect_list(F.struct("idx", "kind", "x", "y", "width", "height", "text_start", F.col("text_length"), "subtree_end"))).alias("zones"))
    assert sorted(map(tuple, zones.descendants_in(page_, "character", "word").collect())) == sorted(map(tuple, zones.descendants(table, "character", "word").select("doc_id", "page", "ancestor", "idx").collect())) == [("d", 0, 1, 2)]
    few = page_.withColumn("zones", F.filter("zones", lambda z: z["idx"].isin(1, 3, 5)))
    for at, hit, near in (((62, 5), 5, 5), ((33, 5), None, 3), ((200, 90), None, 5)):
        x, y = map(F.lit, at)
        got = few.select(zones.hit_in(F.col("zones"), x, y), zones.hit_in(F.col("zones"), x, y, nearest=True), zones.selection_in(F.col("zones"), F.lit(5), F.lit(3)))
        assert tuple(got.first()) == (hit, near, (6, 12))
    view = spark.createDataFrame([(1300, 700, 500, -40, 600, 560)], "page_width int, page_height int, vx int, vy int, vw int, vh int")
    tiles = zones.visible_tiles(view).orderBy("distance").collect()
    assert {(r.x, r.y, r.width, r.height) for r in tiles} == {(0, 0, 512, 512), (512, 0, 512, 512), (1024, 0, 276, 512), (0, 512, 512, 188), (512, 512, 512, 188), (1024, 512, 276, 188)}
    assert (tiles[0].x, tiles[0].y) == (512, 0)
    s = spark.createDataFrame([(100000, 100000, 0.05, 1000, 800, 1.0), (100, 100, 2.0, 100, 100, 1.0)], "w int, h int, z double, vw int, vh int, r double")
    assert [r[0] for r in s.select(native.subsample_for(*map(F.col, ("w", "h", "z", "vw", "vh", "r")))).collect()] == [20, 1]


def test_json_and_pictures(make, tmp_path):
    import json

    from docspark.sources import sinks

    doc = pack.bundle([Component("p", "page", page(pack.text(b"a\xff"), pack.annotations(b'(maparea "#1" "c" (rect 1 2 3 4) (opacity 7))(metadata (k "v"))')))], pack.outline([("T", "", 0)]))
    d = DocumentSet(make({"d": doc}))
    t = json.loads(sinks.text_json(d.text()).first().json)
    assert t == {"text": "a�", "bytes": [97, 255], "hasReplacements": True, "zones": []}
    a = json.loads(sinks.annotations_json(d.annotations()).first().json)
    assert a["bytes"] is None and a["areas"][0]["style"]["opacity"] == 7 and a["areas"][0]["style"]["alwaysVisible"] is False and a["view"]["zoom"] is None
    assert json.loads(sinks.outline_json(d.outline()).first().json) == {"entries": [{"title": "T", "href": "", "parent": None, "subtreeEnd": 1}]}
    assert json.loads(sinks.metadata_json(d.metadata(), d.xmp()).first().json) == {"metadata": [{"key": "k", "value": "v", "page": 0}], "xmp": []}
    twice = DocumentSet(make({"a/d": doc, "b/d": doc}))
    sinks.write_ppm(twice.render(), str(tmp_path))
    pictures = sorted(tmp_path.iterdir())  # one base name, two documents
    assert [p.name for p in pictures] == sorted(f"d-{hashlib.sha256(n.encode()).hexdigest()[:12]}-0.ppm" for n in ("a/d", "b/d"))
    assert all(p.read_bytes() == b"P6\n12 10\n255\n" + b"\xff" * 360 for p in pictures)


def test_geometry_equals_the_renderer(make, spark):
    from docspark.kernels import geometry as g
    from docspark.kernels.core import Bad
    from docspark.kernels.iff import Info

    files = {f"r{r}": pack.document(page(info=pack.info(12, 10, rotation=r))) for r in range(4)}
    rng = np.random.default_rng(0)
    asked = []
    for k in range(60):
        box = (int(rng.integers(0, 40)), int(rng.integers(0, 40))) if k % 2 else (None, None)
        region = tuple(int(v) for v in rng.integers(0, 5, 4)) if k % 3 == 0 else (None,) * 4
        asked.append((f"r{k % 4}", int(k == 59), k, 1 if k % 2 else int(rng.integers(0, 6)), *box, int(rng.integers(0, 4)), *region))
    schema = "doc_id string, page int, k int, subsample int, box_width int, box_height int, rotation int, x int, y int, width int, height int"
    got = {r.k: r for r in DocumentSet(make(files)).geometry(spark.createDataFrame(asked, schema)).collect()}
    for d, p, k, ss, bw, bh, turn, *region in asked:
        r = got[k]
        try:
            if p:
                raise Bad("InvalidArgument")
            t = g.transform(Info(12, 10, 300, int(d[1])), g.Options(ss, None if bw is None else (bw, bh), turn, None if region[0] is None else tuple(region)))
        except Bad as e:
            assert (r.status, r.g, r.t) == (e.code, None, None)
            continue
        assert (r.status, r.g.page_width, r.g.page_height, r.g.rotation, r.g.base_width, r.g.base_height, r.g.padding_top) == ("ok", t.page_width, t.page_height, t.rotation, t.base_width, t.base_height, t.padding_top)
        assert r.t.matrix == pytest.approx(list(t.matrix)) and r.t.inverse == pytest.approx(list(t.inverse))


def test_cancel_tags(spark):
    from docspark.plans.control import cancel, cancellable

    with cancellable(spark, "render"):
        assert "render" in spark.getTags() and spark.range(3).count() == 3
    assert "render" not in spark.getTags() and cancel(spark, "nothing") == []


def test_batches_are_bounded_by_bytes(spark):
    """64 results of 1 MB leave a few at a time, and the JVM sends no batch of 64 MB."""
    from docspark.functions import arrow

    out = arrow.flat_map(spark.range(1), "n int, data binary", lambda _: ((k, bytes(1 << 20)) for k in range(64)), 1024)
    seen = arrow.flat_map(out.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.num_rows]}) for b in batches), "n long"), "n long", lambda n: [(n,)])
    rows = [r.n for r in seen.collect()]
    assert sum(rows) == 64 and max(rows) <= 5
    assert int(spark.conf.get(arrow._BATCH_CONF)) == arrow.BATCH_BYTES


def test_equal_wavelet_layers_are_decoded_once(monkeypatch):
    from docspark.functions import render
    from docspark.kernels import iw44

    calls = []
    decode = iw44.decode_coefficients
    monkeypatch.setattr(iw44, "decode_coefficients", lambda *a: calls.append(1) or decode(*a))
    monkeypatch.setattr(render, "KEPT_GRIDS", 2)
    render._grids.clear()
    made = [encode_iw44(np.full((6, 5), g, np.uint8), (20, 20)) for g in (10, 90, 200)]
    show = lambda c: next(render.render_requests(render.Info(5, 6, 100, 0), "PM44", [render.Part(0, "PM44", x, None, None) for x in c], [{}]))[2]
    first = [show(c) for c in (*made, made[2], made[1])]
    assert len(calls) == 3 and len(render._grids) == 2 and first[3:] == first[2:0:-1] and len(set(first)) == 3
    assert show(made[0]) == first[0] and show(made[0][:1]) != first[0] and len(calls) == 5  # let go and decoded again; fewer chunks are another picture
