"""Two-dimensional operators on word, region and candidate boxes. Pixels, origin at the top left of each page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkveil.functions import text as T

TEXT_SCALE = 1.5

# Thresholds and default scores.
FACE_SCORES = {"global": 0.6, "2x2": 0.55, "3x3": 0.5}


def item_bounds(items: DataFrame) -> DataFrame:
    """Text items (a, b, tx, ty, width, height, page_height in points) to pixels: vx, vy, font_height, top, line_height, item_width."""
    s = TEXT_SCALE
    size = F.hypot("a", "b") * s
    out = items.withColumn("vx", F.col("tx") * s).withColumn("vy", (F.col("page_height") - F.col("ty")) * s)
    out = out.withColumn("font_height", F.greatest(F.col("height") * s, size, F.lit(10.0)))
    return out.withColumns({"top": F.col("vy") - F.col("font_height") * 0.82, "line_height": F.col("font_height") * 1.08, "item_width": F.col("width") * s})


def _before(lengths: Column, block: int = 16) -> Column:
    """For each entry of an array of numbers the sum of those before it: within blocks, and over the sums of blocks of blocks, so a line of a hundred
    thousand pieces costs some dozens of additions for each."""

    def total(x: Column) -> Column:
        return F.aggregate(x, F.lit(0), lambda acc, n: acc + n)

    def blocks(x: Column) -> Column:
        return F.when(F.size(x) > 0, F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / block).cast("int")), lambda b: F.slice(x, b * block + 1, F.lit(block)))).otherwise(F.array().cast("array<array<int>>"))

    def sums(parts: Column, base: Column) -> Column:
        return F.flatten(F.transform(parts, lambda part, b: F.transform(part, lambda _, i: F.get(base, b) + total(F.slice(part, 1, i)))))

    def of(parts: Column) -> Column:
        def over(totals: Column) -> Column:
            outer = T.let(blocks(totals), lambda pp: sums(pp, F.transform(pp, lambda _, k: F.aggregate(F.slice(pp, 1, k), F.lit(0), lambda acc, x: acc + total(x)))))
            return T.let(outer, lambda base: sums(parts, base))

        return T.let(F.transform(parts, total), over)

    return T.let(blocks(lengths), of)


def word_boxes(items: DataFrame, keys: list[str]) -> DataFrame:
    """Words of text items with boxes: item (keys, str, vx, top, line_height, item_width) to word rows.

    Characters share the item's width evenly (no font metrics here). Boxes get a margin of 1.5 pixels at the
    sides and 1 above and below, and are rounded half up. Blank and noise tokens are left out, but count for places.
    """
    white = F.lit(f"{T.WHITE}+|[^{T.WHITE_CLASS}]+")
    found = F.regexp_extract_all("str", white, F.lit(0))
    placed = T.let(found, lambda p: T.let(_before(F.transform(p, F.length)), lambda at: F.zip_with(p, at, lambda t, n: F.struct(t.alias("text"), n.alias("at")))))
    cut = items.select(*keys, "vx", "top", "line_height", (F.col("item_width") / F.length("str")).alias("each"), F.posexplode(placed).alias("piece", "p"))
    cut = cut.select(*keys, "vx", "top", "line_height", "each", "piece", "p.text", "p.at")
    some = cut.filter(~F.col("text").rlike(T.WHITE) & ~T.is_noise(F.col("text")))
    return some.select(
        *keys,
        "piece",
        F.col("at").cast("long").alias("char_offset"),
        "text",
        T.half_up(F.col("vx") + F.col("at") * F.col("each") - 1.5).cast("double").alias("x"),
        F.greatest(F.lit(0.0), T.half_up(F.col("top") - 1.0).cast("double")).alias("y"),
        T.half_up(F.length("text") * F.col("each") + 3.0).cast("double").alias("width"),
        T.half_up(F.col("line_height") + 2.0).cast("double").alias("height"),
        F.lit(100.0).alias("confidence"),
    )


def valid_ocr_word(text: Column, confidence: Column, width: Column, height: Column) -> Column:
    """Whether a recognised word is kept. text is trimmed first; a missing confidence is 0."""
    t, c = T.wide_trim(F.coalesce(text, F.lit(""))), F.coalesce(confidence, F.lit(0.0))
    delimiter = t.isin(":", "=")
    number = t.rlike(r"\A\d{2,16}\z") | t.rlike(r"\d{1,2}[/.-]\d{1,2}[/.-]\d{2,4}")
    return (
        F.when(t == "", False)
        .when(~t.rlike("[A-Za-z0-9]") & ~delimiter, False)
        .when((width < 4) | (height < 4), False)
        .when(number, c >= 25)
        .when(F.length(t) <= 2, delimiter | (c >= 50))
        .otherwise(c >= 35)
    )


def filter_ocr_words(raw: DataFrame) -> DataFrame:
    """Raw words (text, confidence, x0, y0, x1, y1 and keys) to word boxes; the confidence stays as it came."""
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    kept = raw.filter(valid_ocr_word(F.col("text"), F.col("confidence"), w, h))
    keys = [c for c in raw.columns if c not in ("text", "confidence", "x0", "y0", "x1", "y1")]
    return kept.select(*keys, T.wide_trim(F.col("text")).alias("text"), F.col("x0").alias("x"), F.col("y0").alias("y"), w.alias("width"), h.alias("height"), "confidence")


def flatten_ocr_blocks(pages: DataFrame, keys: list[str]) -> DataFrame:
    """blocks -> paragraphs -> lines -> words, nested in a column `blocks`, to raw word rows in reading order."""
    words = F.flatten(F.flatten(F.flatten(F.transform("blocks", lambda b: F.transform(b["paragraphs"], lambda p: F.transform(p["lines"], lambda n: n["words"]))))))
    return pages.select(*keys, F.posexplode(words).alias("word_index", "w")).select(*keys, "word_index", "w.text", "w.confidence", "w.bbox.x0", "w.bbox.y0", "w.bbox.x1", "w.bbox.y1")


def align_to_neighbours(scanned: DataFrame, rects: DataFrame, words: DataFrame, keys: list[str]) -> DataFrame:
    """Words of a re-scanned region, moved into page space. keys name the page; rects: rect_id (of the page), rx, ry, rw, rh; scanned: rect_id, word_index,
    text, x, y, width, height (in region space).

    Where existing words beside the region have a mean height within 0.65 to 1.35 of a word's, it takes their mean height and y. Both are
    rounded to a millionth of a pixel: whether another box covers just half of a word is decided on the box as it is returned.
    """
    near = (F.abs(F.col("w.y") - F.col("r.ry")) < F.greatest(F.col("r.rh") * 1.5, F.lit(50.0))) & (
        (F.abs(F.col("w.x") - (F.col("r.rx") + F.col("r.rw"))) < 80) | (F.abs(F.col("r.rx") - (F.col("w.x") + F.col("w.width"))) < 80)
    )
    pages = [F.col(f"w.{k}") == F.col(f"r.{k}") for k in keys]
    means = words.alias("w").join(rects.alias("r"), [*pages, near]).groupBy(*[f"r.{k}" for k in keys], "r.rect_id").agg(F.avg("w.height").alias("mean_h"), F.avg("w.y").alias("mean_y"))
    placed = scanned.join(rects, [*keys, "rect_id"]).join(means, [*keys, "rect_id"], "left")
    snap = F.coalesce((F.col("mean_h") != 0) & (F.col("height") / F.col("mean_h")).between(0.65, 1.35), F.lit(False))
    return placed.select(
        *keys,
        "rect_id",
        "word_index",
        "text",
        (F.col("rx") + F.col("x")).alias("x"),
        F.round(F.when(snap, F.col("mean_y")).otherwise(F.col("ry") + F.col("y")), 6).alias("y"),
        "width",
        F.round(F.when(snap, F.col("mean_h")).otherwise(F.col("height")), 6).alias("height"),
    )


def drop_covered(fresh: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of fresh that no existing box on the page covers by more than half of their area."""
    over = lambda a, b, s: F.greatest(F.lit(0.0), F.least(F.col(f"n.{a}") + F.col(f"n.{s}"), F.col(f"e.{b}") + F.col(f"e.{s}")) - F.greatest(F.col(f"n.{a}"), F.col(f"e.{b}")))
    shared = over("x", "x", "width") * over("y", "y", "height")
    covered = shared > F.col("n.width") * F.col("n.height") * 0.5
    return fresh.alias("n").join(existing.alias("e"), [*[F.col(f"n.{k}") == F.col(f"e.{k}") for k in keys], covered], "left_anti")


def rotate(boxes: DataFrame, page_height: Column, turns: int = 1, page_width: Column | None = None) -> DataFrame:
    """Boxes (x, y, width, height) after quarter turns clockwise of their page."""
    out, high, wide = boxes, page_height, page_width
    for k in range(turns % 4):
        dims = high if k % 2 == 0 else wide
        if dims is None:
            raise ValueError("more than one turn needs page_width")
        out = out.withColumns({"x": dims - (F.col("y") + F.col("height")), "y": F.col("x"), "width": F.col("height"), "height": F.col("width")})
    return out


def rotate_pages(pages: DataFrame, turns: int = 1) -> DataFrame:
    """Page rows with width and height swapped at odd turns and the rotation advanced."""
    swap = turns % 2 == 1
    return pages.withColumns({"width": F.col("height" if swap else "width"), "height": F.col("width" if swap else "height"), "rotation": (F.col("rotation") + 90 * turns) % 360})


def tile_grid(images: DataFrame, keys: list[str]) -> DataFrame:
    """Scan tiles of images (img_w, img_h): 2x2 from 200 pixels in both directions, 3x3 from 400, overlapping by a quarter."""
    grids = F.array_compact(F.array(*[F.when((F.col("img_w") >= least) & (F.col("img_h") >= least), F.lit(n)) for n, least in ((2, 200), (3, 400))]))
    side = lambda dim, n: F.ceil(F.col(dim) / n * 1.25)
    rows = images.select(*keys, "img_w", "img_h", F.explode(grids).alias("n")).withColumns({"tile_w": side("img_w", F.col("n")), "tile_h": side("img_h", F.col("n"))})
    for c in ("row", "col"):
        rows = rows.withColumn(c, F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    offset = lambda dim, tile, i: T.half_up(F.col(i) * (F.col(dim) - F.col(tile)) / (F.col("n") - 1))
    return rows.select(*keys, "n", "row", "col", "tile_w", "tile_h", offset("img_w", "tile_w", "col").alias("offset_x"), offset("img_h", "tile_h", "row").alias("offset_y"))


def default_score(score: Column, scan: Column) -> Column:
    """A missing or zero score is the scan's default."""
    pairs = [F.lit(x) for item in FACE_SCORES.items() for x in item]
    return F.coalesce(F.when(score != 0, score), F.create_map(*pairs)[scan])


def plausible_face(img_w: Column, img_h: Column) -> Column:
    w, h = F.col("w"), F.col("h")
    return (w >= 10) & (h >= 10) & (w <= img_w * 0.95) & (h <= img_h * 0.95) & (w / h >= 0.45) & (w / h <= 1.9)


def suppress_duplicates(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """Greedy suppression per page: by score (null as 0) descending, then cand_index; a candidate goes if it intersects an accepted one and
    covers over half of either, has an IoU over 0.2 or a near centre. One fold per page, in Catalyst."""
    box = F.struct((-F.coalesce("score", F.lit(0.0))).alias("s"), F.col("cand_index").alias("cand_index"), "x", "y", "w", "h")
    ranked = candidates.groupBy(*keys).agg(F.array_sort(F.collect_list(box)).alias("b"))

    def duplicate(c: Column, e: Column) -> Column:
        across = F.greatest(F.lit(0.0), F.least(c["x"] + c["w"], e["x"] + e["w"]) - F.greatest(c["x"], e["x"]))
        down = F.greatest(F.lit(0.0), F.least(c["y"] + c["h"], e["y"] + e["h"]) - F.greatest(c["y"], e["y"]))
        inter, ca, ea = across * down, c["w"] * c["h"], e["w"] * e["h"]
        gap = F.hypot(c["x"] + c["w"] / 2 - (e["x"] + e["w"] / 2), c["y"] + c["h"] / 2 - (e["y"] + e["h"] / 2))
        size = (F.greatest(c["w"], c["h"]) + F.greatest(e["w"], e["h"])) / 4
        return (inter > 0) & ((inter / ca > 0.5) | (inter / ea > 0.5) | (inter / (ca + ea - inter) > 0.2) | (gap < size * 0.65))

    kept = F.aggregate("b", F.slice("b", 1, 0), lambda acc, c: F.when(F.exists(acc, lambda e: duplicate(c, e)), acc).otherwise(F.concat(acc, F.array(c))))
    return ranked.select(*keys, F.explode(kept).alias("k")).select(*keys, "k.cand_index", "k.x", "k.y", "k.w", "k.h", (-F.col("k.s")).alias("score"))


def pad_faces(faces: DataFrame, img_w: Column, img_h: Column) -> DataFrame:
    """Boxes widened by 8 % at the sides, 12 % above and 6 % below, inside the image; without score."""
    x = F.greatest(F.lit(0.0), F.col("x") - F.col("w") * 0.08)
    y = F.greatest(F.lit(0.0), F.col("y") - F.col("h") * 0.12)
    keys = [c for c in faces.columns if c not in ("x", "y", "w", "h", "score")]
    return faces.select(*keys, x.alias("x"), y.alias("y"), F.least(img_w - x, F.col("w") + F.col("w") * 0.08 * 2).alias("w"), F.least(img_h - y, F.col("h") + F.col("h") * 0.12 + F.col("h") * 0.06).alias("h"))


def to_points(rects: DataFrame, page_w: Column, page_h: Column, margin: bool = True) -> DataFrame:
    """Pixel rectangles (x, y, width, height at 1.5) to points with the origin at the bottom left; words get a margin of a point."""
    s = TEXT_SCALE
    px, py, pw, ph = F.col("x") / s, page_h - (F.col("y") + F.col("height")) / s, F.col("width") / s, F.col("height") / s
    m = 1 if margin else 0
    out = {"pdf_x": F.greatest(F.lit(0.0), px - m), "pdf_y": F.greatest(F.lit(0.0), py - m), "pdf_w": pw, "pdf_h": ph}
    if margin:
        out |= {"pdf_w": F.least(page_w - px + 2, pw + 2), "pdf_h": F.least(page_h - py + 2, ph + 2)}
    return rects.withColumns(out)


def hit_test(taps: DataFrame, boxes: DataFrame, keys: list[str]) -> DataFrame:
    """What each tap (tap_id, px, py) hits: faces (margin 4, enabled only), then manual regions (4), the last one first; then the word (5)
    with the nearest centre, the later one at a tie. boxes: kind, box_index, x, y, w, h, enabled."""
    margin = F.when(F.col("b.kind") == "word", 5).otherwise(4)
    inside = F.col("t.px").between(F.col("b.x") - margin, F.col("b.x") + F.col("b.w") + margin) & F.col("t.py").between(F.col("b.y") - margin, F.col("b.y") + F.col("b.h") + margin)
    usable = (F.col("b.kind") != "face") | F.coalesce(F.col("b.enabled"), F.lit(True))
    met = taps.alias("t").join(boxes.alias("b"), [*[F.col(f"t.{k}") == F.col(f"b.{k}") for k in keys], inside & usable])
    order = F.when(F.col("b.kind") == "face", 0).when(F.col("b.kind") == "manual", 1).otherwise(2)
    gap = F.when(F.col("b.kind") == "word", F.hypot(F.col("t.px") - (F.col("b.x") + F.col("b.w") / 2), F.col("t.py") - (F.col("b.y") + F.col("b.h") / 2))).otherwise(0.0)
    best = F.min(F.struct(order.alias("o"), gap.alias("g"), (-F.col("b.box_index")).alias("i"), F.col("b.kind").alias("kind"))).alias("best")
    return met.groupBy("t.tap_id").agg(best).select("tap_id", F.col("best.kind").alias("kind"), (-F.col("best.i")).alias("box_index"))


def selection_rect(drags: DataFrame) -> DataFrame:
    """Rectangles of drags (x1, y1, x2, y2), from 12 x 12 pixels."""
    out = drags.withColumns({"x": F.least("x1", "x2"), "y": F.least("y1", "y2"), "w": F.abs(F.col("x2") - F.col("x1")), "h": F.abs(F.col("y2") - F.col("y1"))})
    return out.filter("w >= 12 and h >= 12")


def to_page(client: Column, origin: Column, zoom: Column) -> Column:
    """Screen to page coordinates."""
    return (client - origin) / zoom


def fill_rects(boxes: DataFrame, scale: Column) -> DataFrame:
    """Boxes in the raster's scale."""
    return boxes.withColumns({c: F.col(c) * scale for c in ("x", "y", "width", "height")})


def clamp_dimensions(width: Column, height: Column, longest: int = 2400) -> tuple[Column, Column]:
    """Image dimensions with the longer side limited."""
    ratio = F.least(F.lit(1.0), F.lit(float(longest)) / F.greatest(width, height))
    return T.half_up(width * ratio).cast("int"), T.half_up(height * ratio).cast("int")
