"""The registered queries, each over its whole tables.

Tables without the wanted kind of content are turned into it by fixed expressions (identifiers from keys, boxes from
embeddings, taps from events), which oracle.py repeats in SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkveil.functions import patterns as P
from inkveil.functions import text as T
from inkveil.operators import detect, geometry, report, selection
from inkveil.sinks import archives, exports, rasters
from inkveil.sinks import documents as redacted
from inkveil.sources import documents as sources

Query = Callable[[SparkSession, str], DataFrame]


#: Tables with work in every row.
HEAVY = {"documents", "lineitem", "orders", "pages"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(rows) if name in HEAVY else rows


def spread(rows: DataFrame) -> DataFrame:
    """Deals out the rows of a file that is read in fewer tasks than there are cores; larger inputs stay as they are."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


# Detection.


def pii_category_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.corpus_report(detect.document_report(table(spark, sf_dir, "documents")))


def pii_document_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = detect.document_report(table(spark, sf_dir, "documents"))
    return rows.withColumn("word_indices", F.array_join(F.transform("word_indices", lambda x: x.cast("string")), ","))


def pii_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.tagged_tokens(table(spark, sf_dir, "documents"))


def pii_by_lang_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detect.tagged_tokens(table(spark, sf_dir, "documents"), keep=("lang", "source"))
    per_doc = found.groupBy("doc_id", "lang", "source", "category").agg(F.count("*").alias("n"))
    return per_doc.groupBy("lang", "source", "category").agg(F.sum("n").alias("n_tokens"), F.count("*").alias("n_docs"))


def pii_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detect.tagged_tokens(table(spark, sf_dir, "pages"), "page_id", "html")
    return found.groupBy(F.col("doc_id").alias("page_id"), "category").agg(F.count("*").alias("n"))


def token_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("token")
    rows = detect.tokens(table(spark, sf_dir, "documents")).select(T.fuzzy_digits(t).alias("fuzzy"), T.clean_text(t).alias("clean"), T.is_noise(t).alias("noise"))
    return rows.groupBy("fuzzy", "clean", "noise").agg(F.count("*").alias("n"))


def custom_keyword(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = detect.tokens(table(spark, sf_dir, "documents")).filter(detect.is_sensitive(F.col("token"), ["custom"], " ErTh "))
    return rows.groupBy("doc_id").agg(F.count("*").alias("n"), F.min("pos").alias("first_pos"))


def _synthetic(rows: DataFrame, key: str, token: Column) -> DataFrame:
    made = rows.select(F.col(key).alias("key"), token.alias("token"))
    found = F.array_join(P.categories(F.col("token")), ",")
    return made.select("key", "token", found.alias("categories"), detect.is_sensitive(F.col("token"), ["nik", "dob"]).alias("nik_or_dob"))


def _padded(c: str, n: int) -> Column:
    return F.lpad(F.col(c).cast("string"), n, "0")


def synthetic_phone(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("c_custkey") % 3
    digits = _padded("c_custkey", 9)
    token = F.when(n == 0, F.concat(F.lit("08"), digits)).when(n == 1, F.concat(F.lit("+628"), digits)).otherwise(F.concat(F.lit("021-5"), F.substring(digits, 4, 6)))
    return _synthetic(table(spark, sf_dir, "customer"), "c_custkey", token)


def synthetic_nik(spark: SparkSession, sf_dir: str) -> DataFrame:
    digits = F.lpad((F.col("o_orderkey") * 7919 + 3171000000000000).cast("string"), 16, "0")
    mark = F.element_at(F.array(*map(F.lit, ("", "-", ".", "/"))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    token = F.concat_ws("", *[x for k in range(4) for x in ((mark, F.substring(digits, 4 * k + 1, 4)) if k else (F.substring(digits, 1, 4),))])
    return _synthetic(table(spark, sf_dir, "orders"), "o_orderkey", token)


def synthetic_bpjs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _synthetic(table(spark, sf_dir, "customer"), "c_custkey", F.concat(F.lit("000"), _padded("c_custkey", 10)))


def synthetic_npwp(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    part = lambda m: F.lpad((k % m).cast("string"), 3, "0")
    return _synthetic(table(spark, sf_dir, "customer"), "c_custkey", F.concat(F.lit("01."), part(1000), F.lit(".345.6-012."), part(997)))


def synthetic_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _synthetic(table(spark, sf_dir, "part"), "p_partkey", F.concat(F.when(F.col("p_partkey") % 2 == 0, "A").otherwise("al"), _padded("p_partkey", 7)))


def synthetic_dob(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("o_orderdate")
    token = F.when(F.col("o_orderkey") % 2 == 0, F.date_format(d, "dd/MM/yyyy")).otherwise(F.date_format(d, "d/MMM/yyyy"))
    return _synthetic(table(spark, sf_dir, "orders"), "o_orderkey", token)


def synthetic_ttl(spark: SparkSession, sf_dir: str) -> DataFrame:
    region = table(spark, sf_dir, "region")
    orders = table(spark, sf_dir, "orders").withColumn("r", (F.col("o_orderkey") % 5).cast("int"))
    rows = orders.join(region, orders["r"] == region["r_regionkey"])
    return _synthetic(rows, "o_orderkey", F.concat("r_name", F.lit(","), F.date_format("o_orderdate", "dd-MM-yyyy")))


def synthetic_email(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _synthetic(table(spark, sf_dir, "supplier"), "s_suppkey", F.concat(F.lit("info"), F.col("s_suppkey").cast("string"), F.lit("@Example.co.id")))


def synthetic_ocr_noise(spark: SparkSession, sf_dir: str) -> DataFrame:
    digits = F.concat(F.lit("08"), _padded("c_custkey", 9))
    return _synthetic(table(spark, sf_dir, "customer"), "c_custkey", F.translate(digits, "0158", "OISB"))


def _date_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order as a document of five words: a filler, day, month, year, a filler; every third breaks the line before the year."""
    o = table(spark, sf_dir, "orders")
    d = F.col("o_orderdate")
    texts = F.array(F.lit("on"), F.date_format(d, "d"), F.date_format(d, "MMM"), F.date_format(d, "yyyy"), F.lit("12"))
    words = o.select(F.col("o_orderkey").alias("doc_id"), F.posexplode(texts).alias("word_index", "text"))
    late = (F.col("doc_id") % 3 == 0) & (F.col("word_index") >= 3)
    page = F.when((F.col("doc_id") % 5 == 0) & (F.col("word_index") >= 2), 2).otherwise(F.when(F.col("word_index") == 1, 0))
    return words.select("doc_id", page.cast("int").alias("page_index"), "word_index", "text", F.when(late, 22.0).otherwise(0.0).alias("y"), F.lit(18.0).alias("height"))


def multi_token_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.mark_split_dates(_date_words(spark, sf_dir)).filter("split_date").select("doc_id", "word_index", "text")


def contextual_indices(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = detect.sensitive_words(_date_words(spark, sf_dir), ["date", "nik", "custom"], "ON")
    return words.filter("sensitive").groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_list("word_index")), ",").alias("word_indices"))


def unicode_space_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as texts whose words are parted by spaces other than ASCII's."""
    d, k = F.col("o_orderdate"), F.col("o_orderkey")
    space = F.element_at(F.array(*map(F.lit, "\u00a0\u2009\u3000\u202f\ufeff")), (k % 5 + 1).cast("int"))
    text = F.concat_ws(" ", F.concat(F.lit("on"), space, F.date_format(d, "d"), space, F.date_format(d, "MMM"), space, F.date_format(d, "yyyy")), k.cast("string"))
    rows = detect.document_report(table(spark, sf_dir, "orders").select(k.alias("doc_id"), text.alias("text")))
    return rows.select("doc_id", "category", "n_words", F.array_join(F.transform("word_indices", lambda x: x.cast("string")), ",").alias("word_indices"))


def label_proximity(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.element_at(F.array(*map(F.lit, ("Nama:", "budi", "ALAMAT", "12", "d.o.b", "x", "y"))), F.col("word_index"))
    words = _boxes(spark, sf_dir).withColumn("text", said)
    return detect.label_neighbours(words, reach=70.0)


# Geometry.


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents as text items: 12 pixels a code point, 22 pixels a line."""
    docs = table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "str")).filter(T.wide_trim(F.col("str")) != "")
    return rows.withColumns({"vx": F.lit(10.0), "top": F.col("line") * 22.0 + 0.25, "line_height": F.lit(16.0), "item_width": F.length("str") * 7.25})


def word_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geometry.word_boxes(_lines(spark, sf_dir), ["doc_id", "line"]).drop("piece")


def text_item_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("l_linenumber")
    items = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", F.col("l_quantity").alias("a"), (k * 1.5).alias("b"), F.col("l_tax").alias("tx"), (F.col("l_quantity") * 8).alias("ty"), (k + 3.0).alias("height"), F.col("l_quantity").alias("width"), F.lit(842.0).alias("page_height")
    )
    out = geometry.item_bounds(items)
    return out.select("l_orderkey", "l_linenumber", *[F.round(c, 6).alias(c) for c in ("vx", "vy", "font_height", "top", "line_height", "item_width")])


def pixel_to_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    rects = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") * 17).alias("x"), (F.col("l_quantity") * 25).alias("y"), (F.col("l_linenumber") * 30.0).alias("width"), F.lit(18.0).alias("height"))
    out = geometry.to_points(rects, F.lit(595.0), F.lit(842.0))
    return out.select("l_orderkey", "l_linenumber", *[F.round(c, 6).alias(c) for c in ("pdf_x", "pdf_y", "pdf_w", "pdf_h")])


def _ocr_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = detect.tokens(table(spark, sf_dir, "documents"))
    pos, n = F.col("pos"), F.length("token")
    return t.select("doc_id", pos.alias("word_index"), F.col("token").alias("text"), F.when(pos % 50 != 0, ((F.col("doc_id") * 31 + pos * 17) % 101).cast("double")).alias("confidence"), (pos % 40 * 20.0).alias("x0"), (F.floor(pos / 40) * 22.0).alias("y0"), (pos % 40 * 20.0 + n * 2.5).alias("x1"), (F.floor(pos / 40) * 22.0 + pos % 9).alias("y1"))


def ocr_word_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geometry.filter_ocr_words(_ocr_words(spark, sf_dir))


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as word boxes: a page per order of up to seven words in one row."""
    k = F.col("l_linenumber")
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.lit(1).alias("page_index"), k.alias("word_index"), (k * 60.0).alias("x"), (F.col("l_quantity") * 0.5).alias("y"), (F.col("l_quantity") + 10.0).alias("width"), (F.lit(14.0) + k).alias("height"))


def region_neighbour_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = _boxes(spark, sf_dir)
    orders = table(spark, sf_dir, "orders")
    rects = orders.select(F.col("o_orderkey").alias("doc_id"), F.lit(1).alias("page_index"), F.col("o_orderkey").alias("rect_id"), F.lit(200.0).alias("rx"), (F.col("o_orderkey") % 40).cast("double").alias("ry"), F.lit(60.0).alias("rw"), F.lit(20.0).alias("rh"))
    scanned = rects.select("doc_id", "page_index", "rect_id", F.explode(F.sequence(F.lit(0), F.lit(1))).alias("word_index")).withColumns({"text": F.concat(F.lit("w"), F.col("word_index").cast("string")), "x": F.col("word_index") * 25.0, "y": F.lit(2.0), "width": F.lit(20.0), "height": F.lit(12.0) + F.col("word_index") * 14})
    out = geometry.align_to_neighbours(scanned, rects, words, ["doc_id", "page_index"])
    return out.select("doc_id", "word_index", "text", "x", F.round("y", 6).alias("y"), "width", F.round("height", 6).alias("height"))


def _paged_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As _boxes, with four pages in a document."""
    rows = _boxes(spark, sf_dir).withColumns({"page_index": (F.col("doc_id") % 4 + 1).cast("int"), "doc_id": F.floor(F.col("doc_id") / 4)})
    return rows.withColumn("text", F.concat(F.lit("w"), F.col("word_index").cast("string")))


def _paged_rects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One region on every page, the first of its page."""
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(F.floor(k / 4).alias("doc_id"), (k % 4 + 1).cast("int").alias("page_index"), (k % 40).cast("double").alias("ry"))
    return rows.withColumns({"rect_id": F.lit(0), "rx": F.lit(200.0), "rw": F.lit(60.0), "rh": F.lit(20.0)})


def _rescanned(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = _paged_rects(spark, sf_dir).select("doc_id", "page_index", "rect_id", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("word_index"))
    i = F.col("word_index")
    text, confidence = F.element_at(F.array(*map(F.lit, ("alpha", "-", "2020"))), i + 1), F.when(i == 2, 30.0).otherwise((F.col("doc_id") % 100).cast("double"))
    return words.withColumns({"text": text, "confidence": confidence, "x0": i * 25.0, "y0": F.lit(2.0), "x1": i * 25.0 + 20, "y1": F.lit(14.0) + i * 7})


def region_neighbour_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = geometry.filter_ocr_words(_rescanned(spark, sf_dir))
    out = geometry.align_to_neighbours(raw, _paged_rects(spark, sf_dir), _paged_boxes(spark, sf_dir), ["doc_id", "page_index"])
    return out.select("doc_id", "page_index", "word_index", "text", "x", F.round("y", 6).alias("y"), "width", F.round("height", 6).alias("height"))


def region_rescan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = selection.rescan_region(_paged_boxes(spark, sf_dir), _rescanned(spark, sf_dir), _paged_rects(spark, sf_dir))
    return out.filter("text not like 'w%'").select("doc_id", "page_index", "text", "x", F.round("y", 6).alias("y"), "width", F.round("height", 6).alias("height"))


def ocr_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    def word(t: Column, i: Column) -> Column:
        box = F.struct((i * 50.0).alias("x0"), F.lit(0.0).alias("y0"), (i * 50.0 + F.length(t) * 3).alias("x1"), F.lit(10.0).alias("y1"))
        return F.struct(t.alias("text"), (20 + (F.col("p_partkey") * 7 + i * 13) % 80).cast("double").alias("confidence"), box.alias("bbox"))

    half = lambda words, k: F.array(F.struct(F.array(F.struct(F.filter(words, lambda w, i: i % 2 == k).alias("words"))).alias("lines")))
    words = F.transform(F.split("p_name", " "), word)
    blocks = F.array(F.struct(half(words, 0).alias("paragraphs")), F.struct(half(words, 1).alias("paragraphs")))
    pages = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("doc_id"), F.lit(0).alias("page_index"), blocks.alias("blocks"))
    return sources.recognised_words(geometry.flatten_ocr_blocks(pages, ["doc_id", "page_index"]))


def region_scan_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = _boxes(spark, sf_dir)
    fresh = words.select("doc_id", "page_index", "word_index", (F.col("x") + F.col("word_index") * 7).alias("x"), (F.col("y") + F.col("doc_id") % 13).alias("y"), "width", "height")
    return geometry.drop_covered(fresh, words, ["doc_id", "page_index"]).drop("page_index")


def rotate_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = geometry.rotate(_boxes(spark, sf_dir), F.lit(1000.0)).select("doc_id", "word_index", F.lit(1).alias("turns"), "x", "y", "width", "height")
    four = _boxes(spark, sf_dir)
    for k in range(4):
        four = geometry.rotate(four, F.lit(1000.0 if k % 2 == 0 else 800.0))
    return one.unionByName(four.select("doc_id", "word_index", F.lit(4).alias("turns"), "x", "y", "width", "height"))


def face_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 13 + 150).alias("img_w"), (F.col("p_partkey") % 900 + 150).alias("img_h"))
    return geometry.tile_grid(images, ["p_partkey"])


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = lambda i: F.abs(F.element_at("embedding", i + 1)).cast("double")
    return table(spark, sf_dir, "embeddings").select(F.col("label").alias("page"), F.col("vec_id").alias("cand_index"), (e(0) * 1000).alias("x"), (e(1) * 1000).alias("y"), (e(2) * 400 + 40).alias("w"), (e(3) * 400 + 40).alias("h"), e(4).alias("score"))


def face_candidates_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _candidates(spark, sf_dir).filter(geometry.plausible_face(F.lit(1000.0), F.lit(1000.0)))
    return rows.select("page", "cand_index")


def face_nms(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _candidates(spark, sf_dir).filter(geometry.plausible_face(F.lit(1000.0), F.lit(1000.0)))
    return geometry.suppress_duplicates(rows, ["page"]).select("page", "cand_index")


def detected_faces(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _candidates(spark, sf_dir).select(F.lit(0).alias("doc_id"), F.col("page").alias("page_index"), "cand_index", F.lit("global").alias("scan"), "x", "y", "w", "h", "score")
    pages = rows.select("doc_id", "page_index").distinct().withColumns({"width": F.lit(1000.0), "height": F.lit(1000.0)})
    out = sources.detected_faces(rows, pages)
    return out.select("page_index", "region_index", "kind", *[F.round(c, 6).alias(c) for c in ("x", "y", "w", "h")])


def face_padding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = geometry.pad_faces(_candidates(spark, sf_dir), F.lit(1000.0), F.lit(1000.0))
    return out.select("page", "cand_index", *[F.round(c, 6).alias(c) for c in ("x", "y", "w", "h")])


def face_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scans = F.element_at(F.array(*map(F.lit, geometry.FACE_SCORES)), (F.col("cand_index") % 3 + 1).cast("int"))
    rows = _candidates(spark, sf_dir).withColumn("score", F.when(F.col("cand_index") % 4 == 0, F.lit(None)).when(F.col("cand_index") % 4 == 1, 0.0).otherwise(0.75))
    return rows.select("cand_index", geometry.default_score(F.col("score"), scans).alias("score"))


def hit_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, page = table(spark, sf_dir, "events"), F.lit(1)
    taps = e.select(F.col("event_id").alias("tap_id"), (F.col("user_id") % 50).alias("doc_id"), page.alias("page_index"), (F.col("event_id") * 7 % 500).cast("double").alias("px"), (F.col("event_id") * 3 % 60).cast("double").alias("py"))
    some = spark.range(50).select(F.col("id").alias("doc_id"), page.alias("page_index"), F.explode(F.sequence(F.lit(0), F.lit(8))).alias("box_index"))
    i = F.col("box_index")
    boxes = some.select("doc_id", "page_index", F.when(i < 2, "face").when(i < 4, "manual").otherwise("word").alias("kind"), i, (i * 45.0 + F.col("doc_id")).alias("x"), (i % 2 * 20.0).alias("y"), F.lit(50.0).alias("w"), F.lit(22.0).alias("h"), ((i + F.col("doc_id")) % 2 == 0).alias("enabled"))
    return geometry.hit_test(taps, boxes, ["doc_id", "page_index"])


def selection_rect(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("event_id")
    zoomed = lambda c: geometry.to_page(c.cast("double"), F.lit(10.0), F.lit(2.0))
    drags = table(spark, sf_dir, "events").select("event_id", zoomed(i % 200).alias("x1"), zoomed(i * 3 % 160).alias("y1"), zoomed(i * 7 % 220).alias("x2"), zoomed(i * 5 % 180).alias("y2"))
    return geometry.selection_rect(drags).select("event_id", "x", "y", "w", "h")


def clamped_dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, h = geometry.clamp_dimensions(F.col("p_size") * 100.0, F.col("p_partkey") % 5000 + 100.0)
    return table(spark, sf_dir, "part").select("p_partkey", w.alias("width"), h.alias("height"))


def filled_rects(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = geometry.fill_rects(_boxes(spark, sf_dir), F.lit(rasters.OUTPUT_SCALE / 2))
    return out.select("doc_id", "word_index", *[F.round(c, 6).alias(c) for c in ("x", "y", "width", "height")])


# Selection and decisions.


def _review_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _date_words(spark, sf_dir)


def _overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select((F.col("event_id") % 1000 + 1).alias("doc_id"), (F.col("user_id") % 5).cast("int").alias("word_index"), F.col("event_id").alias("seq"), F.when(F.col("event_id") % 3 == 0, "unredact").otherwise("redact").alias("action"))


def _decided(spark: SparkSession, sf_dir: str, mode: str) -> DataFrame:
    rows = selection.decide(_review_words(spark, sf_dir), _overrides(spark, sf_dir), mode=mode)
    return rows.select("doc_id", "word_index", "auto", "redacted", "effective")


def effective_redaction_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decided(spark, sf_dir, "reference")


def effective_redaction_honour(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decided(spark, sf_dir, "honour")


def toggled_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    auto = detect.sensitive_words(_review_words(spark, sf_dir)).withColumnRenamed("sensitive", "auto")
    return selection.toggles_to_overrides(_overrides(spark, sf_dir).select("doc_id", "word_index"), auto)


def checked_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words hidden for one type, or for the categories that are checked after some changes."""
    token = F.concat(F.lit("08"), _padded("c_custkey", 9)), F.concat(F.lit("A"), _padded("c_custkey", 7)), F.concat(F.lit("3171"), _padded("c_custkey", 12))
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.element_at(F.array(*token), (F.col("c_custkey") % 3 + 1).cast("int")).alias("token"))
    names = lambda *x: F.array(*map(F.lit, x))
    checked = selection.change_categories(selection.change_categories(selection.change_categories(names("dob"), "select", names("nik", "id")), "toggle", names("id", "bank")), "deselect", names("nik"))
    rows = rows.withColumns({"checked": checked, "auto": detect.is_sensitive(F.col("token"), ["nik"])})
    return rows.select("c_custkey", F.array_join("checked", ",").alias("checked"), selection.with_categories(F.col("auto"), P.categories(F.col("token")), F.col("checked")).alias("hidden"))


def manual_cleared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.latest_overrides(selection.clear_manual(_review_words(spark, sf_dir), _overrides(spark, sf_dir)))


def manual_word_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = selection.manual_groups(_review_words(spark, sf_dir), _overrides(spark, sf_dir))
    return out.select("doc_id", "text", "n", *[F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c) for c in ("word_indices", "pages")])


def indexed_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    words = F.transform(F.filter(F.split("text", T.WHITE + "+"), lambda t: t != ""), lambda t: F.struct(t.alias("text")))
    pages = turns.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page_pos"), F.col("turn").cast("int").alias("page_index"), words.alias("words"))
    return selection.index_words(pages)


def _faces(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    c = _candidates(spark, sf_dir).select((F.col("cand_index") % 100).alias("doc_id"), F.col("page").alias("page_index"), F.col("cand_index").alias("region_index"), *[F.round(x, 6).alias(x) for x in ("x", "y", "w", "h")])
    off = c.filter("region_index % 7 = 0").select("doc_id", "page_index", "region_index")
    return c.filter("region_index % 3 != 0"), c.filter("region_index % 3 = 0"), off


def active_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.active_regions(*_faces(spark, sf_dir))


def face_toggles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faces left after deleting some and toggling others."""
    faces, _, off = _faces(spark, sf_dir)
    left = selection.delete_faces(faces, faces.filter("region_index % 11 = 0"))
    disabled = selection.change_faces(left, off, "toggle", left.filter("region_index % 2 = 0"))
    return left.join(disabled, ["doc_id", "page_index", "region_index"], "left_anti").select("doc_id", "page_index", "region_index")


def removed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    faces, manual, off = _faces(spark, sf_dir)
    gone = off.select("doc_id", "page_index").distinct()
    return selection.remove_pages(faces.unionByName(manual), gone).select("doc_id", "page_index", "region_index")


def appended_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("page_pos"))
    pages = turns.withColumn("page_index", F.col("page_pos") + 1)
    more = table(spark, sf_dir, "labels").select("doc_id").withColumns({"page_pos": F.lit(0), "page_index": F.lit(0)})
    return selection.append_pages(pages, more)


# Reports, scrubbing and packaging.


def redacted_word_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = selection.decide(_review_words(spark, sf_dir), _overrides(spark, sf_dir), mode="honour").filter("effective")
    return report.word_frequencies(rows)


def redacted_word_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.ranked_words(selection.decide(_review_words(spark, sf_dir), _overrides(spark, sf_dir)).filter("effective"))


def export_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = selection.decide(_review_words(spark, sf_dir), _overrides(spark, sf_dir))
    pages = words.select("doc_id", T.page_or_first(F.col("page_index")).alias("page_index")).distinct()
    documents = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.when(F.col("o_orderkey") % 2 == 0, "image").otherwise("text-pdf").alias("document_type"), F.lit("#B91C1C").alias("colour"))
    out = report.export_report(words, selection.active_regions(*_faces(spark, sf_dir)), pages, documents)
    return out.withColumn("redacted_words", F.array_join("redacted_words", " "))


def exported_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as documents of one to three small white pages; the files are made, and their pages counted in their bytes."""
    k = F.col("p_partkey")
    kind = F.element_at(F.array(*map(F.lit, ("text-pdf", "image-pdf", "image"))), (k % 3 + 1).cast("int"))
    docs = table(spark, sf_dir, "part").select(k.alias("doc_id"), F.when(k % 5 != 0, F.concat(F.col("p_name"), F.lit(".bin"))).otherwise("").alias("name"), kind.alias("document_type"))
    pages = docs.select("doc_id", F.explode(F.sequence(F.lit(1), (F.col("doc_id") % 4 % 3 + 1).cast("int"))).alias("page_index"))
    pages = pages.withColumns({"width": F.lit(30), "height": F.lit(20), "data": F.unhex(F.lit("FF" * 1800))})
    items = docs.select("doc_id", F.lit(1).alias("page_index"), F.lit(0).alias("item_index"), F.col("name").alias("str"), F.lit(2.0).alias("tx"), F.lit(5.0).alias("ty"), F.lit(9.0).alias("height"))
    words = docs.select("doc_id", F.lit(0).alias("page_index"), F.split_part("name", F.lit(" "), F.lit(1)).alias("text"), F.lit(3.0).alias("x"), F.lit(4.0).alias("y"), F.lit(10.0).alias("width"), F.lit(5.0).alias("height"), F.lit(True).alias("effective"))
    regions = docs.select("doc_id", F.lit(2).alias("page_index"), F.lit(0).alias("region_index"), F.lit("manual").alias("kind"), *[F.lit(v).alias(c) for c, v in (("x", 1.0), ("y", 1.0), ("w", 4.0), ("h", 4.0))])
    out = exports.export_documents(docs, pages, items, words, regions)
    raw = F.decode("content", "ISO-8859-1")
    shown = F.when(raw.startswith("%PDF"), F.size(F.split(raw, "/MediaBox")) - 1).otherwise(F.when(F.hex(F.substring("content", 1, 4)) == "89504E47", 1))
    return out.select("doc_id", "document_type", "filename", "n_pages", shown.cast("long").alias("pages_in_file"))


def export_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = selection.decide(_review_words(spark, sf_dir), _overrides(spark, sf_dir))
    pages = words.select("doc_id", T.page_or_first(F.col("page_index")).alias("page_index")).distinct()
    return report.export_stats(words, selection.active_regions(*_faces(spark, sf_dir)), pages)


def page_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    pages = p.select((F.col("page_id") % 100).alias("doc_id"), F.when(F.col("page_id") % 3 != 0, F.length("url") * 10).alias("width"), (F.col("page_id") % 4 * 300).alias("height"), "html")
    return report.page_extent(pages).join(report.original_size(pages, "html"), "doc_id")


def scrub_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redacted.scrub_documents(table(spark, sf_dir, "documents")).select("doc_id", "text")


def redaction_rects(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = _boxes(spark, sf_dir).withColumn("effective", F.col("word_index") % 2 == 0)
    pages = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.lit(1).alias("page_index"), F.lit(595.0).alias("width"), F.lit(842.0).alias("height"))
    faces, manual, off = _faces(spark, sf_dir)
    regions = selection.active_regions(faces, manual, off).withColumn("page_index", F.lit(0))
    out = redacted.redaction_rects(words, regions, pages)
    return out.select("doc_id", "page_index", "kind", *[F.round(c, 6).alias(c) for c in ("pdf_x", "pdf_y", "pdf_w", "pdf_h")])


def inspect_text_dominant(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "str")).withColumn("page_num", F.floor(F.col("i") / 10) + 1)
    pages = items.groupBy("doc_id", "page_num").agg(F.bool_or(F.col("str").contains("!")).alias("has_image"))
    return sources.inspect(pages, items)


def routed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 4 == 0, "png").otherwise("pdf").alias("kind"))
    return sources.route(files, inspect_text_dominant(spark, sf_dir).select("doc_id", "is_text_dominant"))


def image_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages")
    return sources.image_pages(p.select((F.col("page_id") % 120).alias("batch_id"), F.col("page_id").alias("file_order"), F.col("url").alias("name"), (F.col("page_id") % 3 * 400).alias("width"), F.when(F.col("page_id") % 5 != 0, 700).alias("height")))


def assembled_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = _boxes(spark, sf_dir).withColumns({"text": F.concat(F.lit("w"), F.col("word_index").cast("string")), "confidence": F.lit(100.0)})
    pages = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.lit(1).alias("page_index"))
    out = sources.pages_with_words(pages, words)
    return out.select("doc_id", "page_index", F.array_join(F.col("words.text"), " ").alias("text"), F.size("words").alias("n_words"))


def hex_to_rgb(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    body = F.lower(F.lpad(F.conv((k * 7919 % 16777216).cast("string"), 10, 16), 6, "0"))
    colour = F.when(k % 5 == 0, F.concat(F.lit("#"), F.substring(body, 1, 3))).when(k % 5 == 1, F.lit("zz")).otherwise(F.concat(F.lit("#"), body))
    rows = table(spark, sf_dir, "part").select("p_partkey", colour.alias("colour"))
    return rows.select("p_partkey", "colour", *[F.round(T.hex_channel(F.col("colour"), i), 6).alias(c) for i, c in enumerate("rgb")])


def format_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("o_orderkey")
    size = F.when(n % 4 == 0, n % 1025).when(n % 4 == 1, n * 1000).when(n % 4 == 2, n * 1048576).otherwise(n * 40000000)
    return table(spark, sf_dir, "orders").select("o_orderkey", T.format_bytes(size).alias("label"))


def clean_filename(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.element_at(F.array(*map(F.lit, ("image", "text-pdf", "image-pdf"))), (F.col("page_id") % 3 + 1).cast("int"))
    name = F.when(F.col("page_id") % 7 == 0, F.lit("")).when(F.col("page_id") % 7 == 1, F.lit(" .pdf")).otherwise(F.col("url"))
    rows = table(spark, sf_dir, "pages").select("page_id", kind.alias("kind"), name.alias("name"), F.col("page_id") % 2 + 1)
    return rows.select("page_id", T.final_name(F.col("name"), F.col("kind"), F.lit(2)).alias("filename"), T.final_name(F.col("name"), F.col("kind"), F.lit(1), F.lit("zip")).alias("archive"))


def colour_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    pool = [*T.COLOURS, "#1E3A8A", "#123456", ""]
    c = F.element_at(F.array(*map(F.lit, pool)), (F.col("p_partkey") % len(pool) + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", T.colour_name(c).alias("colour"))


def savings(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", T.savings_percent((k % 50 * 10).cast("double"), (k % 37 * 11).cast("double")).alias("percent"))


def labels_and_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = T.page_or_first(F.when(F.col("l_linenumber") > 2, F.col("l_linenumber")).when(F.col("l_linenumber") == 2, 0))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", T.face_id(page, F.col("l_orderkey")).alias("face_id"), T.page_id(page).alias("page_id"), T.page_label(page).alias("label"))


def zip_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    files = d.select((F.col("doc_id") % 40).alias("archive"), "doc_id", F.concat(F.lit("redacted-"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("name"), F.coalesce("text", F.lit("")).cast("binary").alias("content"))
    return archives.zip_entries(files, ["archive"], "doc_id").drop("crc32")


def zip_checksums(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    files = d.select((F.col("doc_id") % 40).alias("archive"), "doc_id", F.concat(F.lit("redacted-"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("name"), F.coalesce("text", F.lit("")).cast("binary").alias("content"))
    return archives.zip_entries(files, ["archive"], "doc_id").select("archive", "doc_id", "crc32")


def page_boxes_mm(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, h, orientation = rasters.page_box(F.col("p_size") * 40.0, F.col("p_partkey") % 1500 + 200.0, rasters.OUTPUT_SCALE)
    return table(spark, sf_dir, "part").select("p_partkey", F.round(w, 6).alias("width_mm"), F.round(h, 6).alias("height_mm"), orientation.alias("orientation"))


def export_qualities(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [(sink, preset, q) for sink, presets in rasters.QUALITY.items() for preset, q in presets.items()]
    return spark.createDataFrame(rows, "sink string, preset string, quality double")


def queries() -> dict[str, Query]:
    found = [
        pii_category_report, pii_document_report, pii_tokens, pii_by_lang_source, pii_pages, token_forms, custom_keyword,
        synthetic_phone, synthetic_nik, synthetic_bpjs, synthetic_npwp, synthetic_id, synthetic_dob, synthetic_ttl, synthetic_email, synthetic_ocr_noise,
        multi_token_date, contextual_indices, unicode_space_dates, label_proximity, word_geometry, text_item_bounds, pixel_to_point, ocr_word_filter, region_neighbour_align, region_neighbour_pages, region_rescan, region_scan_dedupe, ocr_blocks,
        rotate_boxes, face_tiles, face_candidates_filter, face_nms, detected_faces, face_padding, face_scores, hit_test, selection_rect, clamped_dimensions, filled_rects,
        effective_redaction_reference, effective_redaction_honour, toggled_words, checked_categories, manual_word_groups, manual_cleared, indexed_words, active_regions, face_toggles, removed_pages, appended_pages,
        redacted_word_freq, redacted_word_ranking, export_stats, export_report, exported_files, page_totals, scrub_text, redaction_rects, inspect_text_dominant, routed_files, image_pages, assembled_pages,
        hex_to_rgb, format_bytes, clean_filename, colour_names, savings, labels_and_ids, zip_entries, zip_checksums, page_boxes_mm, export_qualities,
    ]
    return {f.__name__: f for f in found}
