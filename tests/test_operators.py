import io
import re
import zipfile
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from inkveil.functions import patterns as P
from inkveil.functions import text as T
from inkveil.operators import detect, geometry, selection
from inkveil.sinks import archives, exports, rasters
from inkveil.sinks import documents as redacted
from inkveil.sources import documents as sources
from inkveil.sources import providers
from inkveil.streaming import tagging

VECTORS = {
    "1234/5678/9012/3456": ["nik"],
    "1234.5678.9012.3456": ["nik"],
    "32O1O12345678901": ["nik", "bank"],
    "08123456789": ["phone", "bank"],
    "+6281234567890": ["phone", "bank"],
    "021-5551234": ["phone"],
    "021/5551234": ["phone"],
    "0812-3456-7890": [],
    "555-3824": [],
    "12.345.678": [],
    "0001234567890": ["phone", "bpjs", "bank"],
    "12.345.678.9-012.345": ["npwp"],
    "123456789012345": ["bank"],
    "A1234567": ["id"],
    "Al234567": ["id"],
    "user@ex.com": ["email"],
    "09/11/2002": ["dob"],
    "31.02.2020": ["dob"],
    "9/Nov/2002": ["dob"],
    "9-Nov-2002": [],
    "JAKARTA,18-02-1985": ["dob", "ttl"],
    "IllIllIllI": ["bank"],
    "4785380592391139$$$": ["nik", "bank"],
    "é08123456789": ["phone", "bank"],
    "08123456789é": ["phone", "bank"],
    "---": [],
    "": [],
}


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column).first()[0]


def test_pattern_vectors(spark):
    rows = spark.createDataFrame([(k,) for k in VECTORS], "t string").select("t", P.categories(F.col("t")).alias("c"), P.worth_matching(F.col("t")).alias("w")).collect()
    for r in rows:
        assert r["c"] == VECTORS[r["t"]], r["t"]
        assert r["w"] or not r["c"]


def test_null_token_is_nothing(spark):
    df = spark.createDataFrame([(None,)], "t string").select(P.categories(F.col("t")), detect.is_sensitive(F.col("t")))
    assert tuple(df.first()) == ([], False)


def test_clean_text_keeps_hyphens(spark):
    assert one(spark, T.clean_text(F.col("t")), t="a.b/c-d_e]f^g\\h“i") == "a b c-d e f g h i"


def test_scrub_is_longest_first_and_keeps_length(spark):
    df = spark.createDataFrame([("abc ab abcd", ["ab", "abcd", " ", "ab"])], "t string, s array<string>").select(T.scrub(F.col("t"), F.col("s")))
    assert df.first()[0] == "  c" + " " * 8


def test_document_form_agrees_with_the_word_form(spark):
    text = "born 9 Nov 2002 here\n31 mei 1999 1 jan\n2001 5 may 2010"
    docs = spark.createDataFrame([(1, text), (2, ""), (3, None)], "doc_id long, text string")
    words = detect.document_words(docs).select("doc_id", F.lit(1).alias("page_index"), "word_index", "text", (F.col("line") * 22.0).alias("y"), F.lit(18.0).alias("height"))
    a = {tuple(r) for r in detect.word_categories(words).collect()}
    b = {tuple(r) for r in detect.document_word_categories(docs).collect()}
    assert a == b and {x[1] for x in a} == {1, 2, 3, 5, 6, 7, 11, 12, 13}


def test_four_turns_are_none(spark):
    b = spark.createDataFrame([(3.0, 5.0, 20.0, 10.0)], "x double, y double, width double, height double")
    assert tuple(geometry.rotate(geometry.rotate(b, F.lit(700.0), 3, F.lit(500.0)), F.lit(500.0)).first()) == (3.0, 5.0, 20.0, 10.0)


def test_suppression_leaves_no_duplicates(spark):
    rows = [(1, i, float(i % 5 * 15), float(i // 5 * 15), 40.0, 40.0, (i * 7 % 10) / 10) for i in range(25)]
    c = spark.createDataFrame(rows, "page int, cand_index int, x double, y double, w double, h double, score double")
    kept = geometry.suppress_duplicates(c, ["page"])
    again = geometry.suppress_duplicates(kept, ["page"])
    assert 0 < kept.count() == again.count() < 25


def test_latest_override_decides(spark):
    words = spark.createDataFrame([(1, 1, 0, "08123456789", 0.0, 18.0), (1, 1, 1, "plain", 0.0, 18.0)], "doc_id long, page_index int, word_index int, text string, y double, height double")
    o = spark.createDataFrame([(1, 0, 1, "redact"), (1, 0, 2, "unredact"), (1, 1, 3, "redact")], "doc_id long, word_index int, seq long, action string")
    for mode, first in (("reference", True), ("honour", False)):
        got = {r["word_index"]: (r["auto"], r["redacted"], r["effective"]) for r in selection.decide(words, o, mode=mode).collect()}
        assert got == {0: (True, False, first), 1: (False, True, True)}


def test_scrubbed_documents_leak_nothing(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("secrets", detect.secrets(F.col("text"))).filter("size(secrets) > 0")
    out = redacted.scrub_documents(docs)
    assert docs.count() and out.filter(F.exists("secrets", lambda s: F.col("text").contains(s))).count() == 0


def test_rows_without_an_id_are_scrubbed_too(spark):
    rows = [(None, "call 08123456789 now"), (None, "mail a@b.co or a@b.co"), (1, "A1234567"), (1, "plain"), (2, None), (3, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [r["text"] for r in redacted.scrub_documents(docs).collect()]
    assert got == ["call             now", "mail        or       ", "        ", "plain", None, ""]
    own = redacted.scrub_documents(docs, secrets=F.array(F.lit("plain"), F.lit("now")))
    assert [r["text"] for r in own.collect()][:4] == ["call 08123456789    ", "mail a@b.co or a@b.co", "A1234567", "     "]
    assert sorted((str(r["doc_id"]), r["category"], r["n_words"]) for r in detect.document_report(docs).collect()) == [("1", "id", 1), ("None", "bank", 1), ("None", "email", 2), ("None", "phone", 1)]
    assert {r["category"]: (r["n_words"], r["n_docs"]) for r in detect.corpus_report(detect.document_report(docs)).collect()}["email"] == (2, 1)


def test_hits_need_no_exchange(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "str")).withColumns({"vx": F.lit(0.0), "top": F.lit(0.0), "line_height": F.lit(9.0), "item_width": F.lit(70.0)})
    for rows in (detect.document_hits(docs), detect.document_report(docs), redacted.scrub_documents(docs), detect.document_words(docs), geometry.word_boxes(lines, ["doc_id", "line"])):
        assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()


def test_unicode_space_parts_words(spark):
    spaces = "\u00a0\u2009\u3000\u1680\u202f\ufeff"
    docs = spark.createDataFrame([(k, f"born{c}12{c}Jan{c}2020{c}x{c}4785{c}3805") for k, c in enumerate(spaces)], "doc_id long, text string")
    assert {tuple(r) for r in detect.document_word_categories(docs).collect()} == {(k, i, "dob") for k in range(len(spaces)) for i in (1, 2, 3)}
    for c in spaces:
        assert one(spark, T.clean_text(F.col("t")), t=f"a{c}{c}.b") == "a b"
        assert one(spark, P.categories(F.col("t")), t=f"4785{c}3805{c}9239{c}1139") == ["nik"]
        assert one(spark, P.categories(F.col("t")), t=f"9{c}Nov{c}2002") == ["dob"]
        assert one(spark, P.categories(F.col("t")), t=f"JAKARTA,{c}18-02-1985") == ["dob", "ttl"]
        assert one(spark, P.categories(F.col("t")), t=f"62{c}812345678") == ["phone"]
    assert one(spark, P.categories(F.col("t")), t="a\u017f1234567") == []


def test_word_places_are_prefix_sums(spark):
    rng = np.random.default_rng(3)
    lines = ["", "x", *[" ".join("w" * int(k) for k in rng.integers(1, 9, n)) for n in (2, 31, 32, 33, 64, 65, 2100, 9000)]]
    items = spark.createDataFrame([(i, t, 0.0, 5.0, 10.0, float(len(t))) for i, t in enumerate(lines)], "i int, str string, vx double, top double, line_height double, item_width double")
    got = {(r["i"], r["char_offset"], r["text"]) for r in geometry.word_boxes(items, ["i"]).collect()}
    assert got == {(i, m.start(), m[0]) for i, t in enumerate(lines) for m in re.finditer(r"\S+", t)}


def test_neighbours_are_those_of_the_page(spark):
    box = "page_index int, rect_id int, {}rx double, ry double, rw double, rh double"
    rects = spark.createDataFrame([(p, 0, 100.0, 10.0, 50.0, 20.0) for p in (1, 2)], box.format(""))
    words = spark.createDataFrame([(1, 80.0, 9.0, 10.0, 20.0), (2, 80.0, 11.0, 10.0, 40.0)], "page_index int, x double, y double, width double, height double")
    scanned = spark.createDataFrame([(p, 0, 0, "w", 0.0, 1.0, 5.0, 30.0) for p in (1, 2)], "page_index int, rect_id int, word_index int, text string, x double, y double, width double, height double")
    got = {r["page_index"]: (r["height"], r["y"]) for r in geometry.align_to_neighbours(scanned, rects, words, ["page_index"]).collect()}
    assert got == {1: (30.0, 11.0), 2: (40.0, 11.0)}


def test_stored_zip_reads_back():
    entries = [("a.txt", b"one"), ("b.bin", bytes(range(256)))]
    raw = archives.stored_zip(entries)
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        assert [(i.filename, z.read(i)) for i in z.infolist()] == entries
        assert all(i.compress_type == zipfile.ZIP_STORED for i in z.infolist())


def test_archive_offsets(spark):
    files = spark.createDataFrame([(1, 0, "a", bytearray(b"xyz")), (1, 1, "bb", bytearray(b"")), (1, 2, "c", bytearray(b"q"))], "k long, o int, name string, content binary")
    got = [(r["offset"], r["crc32"]) for r in archives.zip_entries(files, ["k"], "o").orderBy("o").collect()]
    raw = archives.archives(files, "k", "o").first()["content"]
    with zipfile.ZipFile(io.BytesIO(bytes(raw))) as z:
        assert got == [(i.header_offset, i.CRC) for i in z.infolist()]


def test_redacted_raster_is_a_png_with_a_filled_box(spark, tmp_path):
    white = np.full((20, 30, 3), 255, np.uint8)
    pages = spark.createDataFrame([(1, 1, 30, 20, bytearray(white.tobytes()))], "doc_id long, page_index int, width int, height int, data binary")
    boxes = spark.createDataFrame([(1, 1, 5.0, 6.0, 10.0, 4.0)], "doc_id long, page_index int, x double, y double, width double, height double")
    content = rasters.redact_rasters(pages, boxes).first()["content"]
    (tmp_path / "p.png").write_bytes(bytes(content))
    image = spark.read.format("image").load(str(tmp_path / "p.png")).select("image.*").first()
    pixels = np.frombuffer(bytes(image["data"]), np.uint8).reshape(20, 30, 3)
    assert (pixels[6:10, 5:15] == 0).all() and int((pixels == 0).all(2).sum()) == 40


def test_merged_pdf_has_all_pages(spark):
    data = [bytearray(np.full((4, 6, 3), c, np.uint8).tobytes()) for c in (10, 20)]
    pages = spark.createDataFrame([(1, 2, 6, 4, data[1]), (1, 1, 6, 4, data[0])], "doc_id long, page_index int, width int, height int, data binary")
    raw = bytes(rasters.merge_pdf(pages).first()["content"])
    assert raw.startswith(b"%PDF") and b"/Count 2" in raw
    streams = [zlib.decompress(x.split(b"\nendstream")[0]) for x in raw.split(b"stream\n")[1:] if x[:1] == b"x"]
    assert streams == [bytes(d) for d in data]


def test_files_are_taken_by_content(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"%PDF-1.4 x")
    (tmp_path / "b.dat").write_bytes(rasters.png(np.zeros((2, 2, 3), np.uint8)))
    (tmp_path / "c.pdf").write_bytes(b"not one")
    assert sorted(r["kind"] for r in sources.read_files(spark, str(tmp_path)).collect()) == ["pdf", "png"]


def test_stream_equals_table(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    docs.repartition(3).write.parquet(str(tmp_path / "in"))
    q = tagging.tag_stream(tagging.read_documents(spark, str(tmp_path / "in"), 1)).writeStream.format("memory").queryName("tagged").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {tuple(r) for r in spark.table("tagged").collect()}
    assert got == {tuple(r) for r in detect.tagged_tokens(docs).collect()} and got


def test_stream_reports_are_files(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    docs.write.parquet(str(tmp_path / "in"))
    q = tagging.write_reports(tagging.read_documents(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).select("doc_id", "word_index", "category").count() == detect.document_word_categories(docs).count()


WORDS = "doc_id long, page_index int, word_index int, text string, x double, y double, width double, height double, effective boolean"
REGIONS = "doc_id long, page_index int, region_index int, kind string, x double, y double, w double, h double"
PAGES = "doc_id long, page_index int, width int, height int, data binary"


def made(spark, choice=None):
    white = bytearray(np.full((20, 30, 3), 255, np.uint8).tobytes())
    documents = spark.createDataFrame([(1, "a.pdf", "text-pdf"), (2, "b.pdf", "image-pdf"), (3, "c.jpg", "image"), (4, "", "image")], "doc_id long, name string, document_type string")
    pages = spark.createDataFrame([(1, 1, 200, 100, None), (2, 1, 30, 20, white), (2, 2, 30, 20, white), (3, 1, 30, 20, white), (4, 1, 30, 20, white), (4, 2, 30, 20, white)], PAGES)
    items = spark.createDataFrame([(1, 1, 0, "call 08123456789 (now)", 10.0, 80.0, 9.0)], "doc_id long, page_index int, item_index int, str string, tx double, ty double, height double")
    words = spark.createDataFrame([(1, 1, 1, "08123456789", 60.0, 15.0, 90.0, 14.0, True), (1, 1, 0, "call", 15.0, 15.0, 20.0, 14.0, False), (2, 0, 0, "w", 10.0, 10.0, 10.0, 10.0, True), (3, 1, 0, "w", 5.0, 6.0, 10.0, 4.0, True)], WORDS)
    regions = spark.createDataFrame([(4, 2, 0, "face", 0.0, 0.0, 3.0, 3.0)], REGIONS)
    return {r["doc_id"]: r for r in exports.export_documents(documents, pages, items, words, regions, choice).collect()}


def streams(raw):
    return [zlib.decompress(x.split(b"\nendstream")[0]) for x in raw.split(b"stream\n")[1:] if x[:1] == b"x"]


def test_documents_are_exported_by_type(spark):
    got = made(spark)
    assert {k: (r["filename"], r["n_pages"]) for k, r in got.items()} == {1: ("a.pdf", 1), 2: ("b.pdf", 2), 3: ("c.png", 1), 4: ("redacted-images.pdf", 2)}
    assert all(r["n_bytes"] == len(r["content"]) for r in got.values())
    drawn = streams(bytes(got[1]["content"]))
    assert b"08123456789" not in b"".join(drawn) and b"call" in drawn[0] and b"\\(now\\)" in drawn[0] and drawn[0].count(b" re f") == 1
    first, second = (np.frombuffer(x, np.uint8).reshape(20, 30, 3) for x in streams(bytes(got[2]["content"])))
    assert (first[9:18, 9:18] == 0).all() and int((first == 0).all(2).sum()) == 81 and (second == 255).all()
    pages = [np.frombuffer(x, np.uint8).reshape(20, 30, 3) for x in streams(bytes(got[4]["content"]))]
    assert [int((x == 0).all(2).sum()) for x in pages] == [0, 9]
    assert bytes(got[3]["content"]).startswith(b"\x89PNG")


def test_images_are_exported_by_choice(spark, tmp_path):
    got = made(spark, "multi-zip")
    assert got[4]["filename"] == "redacted-images.zip"
    with zipfile.ZipFile(io.BytesIO(bytes(got[4]["content"]))) as z:
        assert z.namelist() == ["redacted-image-1.png", "redacted-image-2.png"]
    assert made(spark, "single-pdf-optimal")[3]["filename"] == "c.pdf" and made(spark, "image-max")[3]["filename"] == "c.png"
    files = spark.createDataFrame([(7, "x.pdf", bytearray(b"abc"))], "doc_id long, filename string, content binary")
    exports.save(files, str(tmp_path / "out"))
    assert (tmp_path / "out/7/x.pdf").read_bytes() == b"abc"


def test_archives_that_the_format_cannot_hold_are_refused():
    with pytest.raises(ValueError, match="too many"):
        archives.stored_zip([(str(k), b"") for k in range(65_536)])


def test_enhanced_pixels_are_grey_with_more_contrast():
    pixels = np.array([[[0, 0, 0], [255, 255, 255], [100, 100, 100], [140, 140, 140]]], np.uint8)
    assert rasters.enhance(pixels).tolist() == [[0, 255, int(((100 - 127.5) * 1.35 + 127.5) * 1.05), int(((140 - 127.5) * 1.35 + 127.5) * 1.05)]]


def test_unknown_exports_are_refused():
    with pytest.raises(ValueError):
        rasters.export_extension("gif")


def test_broken_pages_are_reported_and_others_read(spark):
    class Decoder:
        """A stand-in for a raster or recognition library: the page's number in words; page 3 is broken."""

        def __call__(self, page):
            n = page.column("page_index")[0].as_py()
            if n == 3:
                raise OSError("broken page")
            rows = [{"doc_id": page.column("doc_id")[0].as_py(), "page_index": n, "word_index": k, "text": t, "confidence": 90.0, "x0": 0.0, "y0": 0.0, "x1": 9.0, "y1": 9.0} for k, t in enumerate(["page", str(n), "-"])]
            yield pa.RecordBatch.from_pylist(rows)

    pages = spark.createDataFrame([(1, 1), (1, 3), (2, 2)], "doc_id long, page_index int")
    rows = providers.from_decoder(pages, "ocr_words", "stand-in", Decoder).cache()
    assert [tuple(r) for r in providers.unreadable(rows).collect()] == [(1, 3, "OSError: broken page")]
    words = sources.recognised_words(providers.readable(rows))
    assert sorted((r["doc_id"], r["page_index"], r["text"]) for r in words.collect()) == [(1, 1, "1"), (1, 1, "page"), (2, 2, "2"), (2, 2, "page")]
    assert providers.from_table(pages.limit(1), words).count() == 2


def test_detection_scans_only_documents_without_faces(spark):
    pages = spark.createDataFrame([(1, 1, 500.0, 500.0), (2, 1, 500.0, 500.0)], "doc_id long, page_index int, width double, height double")
    faces = spark.createDataFrame([(1, 1, 0)], "doc_id long, page_index int, region_index int")
    assert [r["doc_id"] for r in sources.pages_without_faces(pages, faces).collect()] == [2]
    kinds = "doc_id long, page_index int, cand_index int, scan string, x double, y double, w double, h double, score double"
    found = spark.createDataFrame([(2, 1, 0, "global", 100.0, 100.0, 50.0, 60.0, None), (2, 1, 1, "2x2", 105.0, 100.0, 50.0, 60.0, 0.9), (2, 1, 2, "2x2", 5.0, 5.0, 5.0, 5.0, 0.9)], kinds)
    assert [tuple(r) for r in sources.detected_faces(found, pages).collect()] == [(2, 1, 1, "face", 101.0, 92.8, 58.0, pytest.approx(70.8))]


def test_faces_all_none_and_toggle(spark):
    key = "doc_id long, page_index int, region_index int"
    faces = spark.createDataFrame([(1, 1, k) for k in range(4)], key)
    off, chosen = faces.filter("region_index = 0"), faces.filter("region_index < 2")
    left = lambda *a: sorted(r["region_index"] for r in selection.change_faces(faces, off, *a).collect())
    assert (left("all"), left("none"), left("toggle", chosen)) == ([], [0, 1, 2, 3], [1])
    assert selection.delete_faces(faces, chosen).count() == 2


def test_removed_words_stay_removed_whatever_others_did(spark):
    o = spark.createDataFrame([(1, 0, 5, "redact"), (2, 0, 900, "redact"), (1, 1, 1, "redact")], "doc_id long, word_index int, seq long, action string")
    groups = spark.createDataFrame([(1, [0])], "doc_id long, word_indices array<int>")
    got = {(r["doc_id"], r["word_index"]): r["action"] for r in selection.latest_overrides(selection.remove_manual(o, groups)).collect()}
    assert got == {(1, 0): "unredact", (2, 0): "redact", (1, 1): "redact"}


def test_pages_turn_with_their_boxes(spark):
    pages = spark.createDataFrame([(1, 600, 800, 270)], "page_index int, width int, height int, rotation int")
    assert tuple(geometry.rotate_pages(pages).first()) == (1, 800, 600, 0)
    assert tuple(geometry.rotate_pages(pages, 2).first()) == (1, 600, 800, 90)


def test_events_are_counted_by_window(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    assert tagging.counts_by_window(events).agg(F.sum("n")).first()[0] == events.count()
