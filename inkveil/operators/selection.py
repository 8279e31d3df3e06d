"""Review state: selections, overrides and the decision for each word."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkveil.functions import text as T
from inkveil.operators.detect import sensitive_words
from inkveil.operators.geometry import align_to_neighbours, drop_covered, filter_ocr_words


def index_words(pages: DataFrame) -> DataFrame:
    """Pages (doc_id, page_pos, page_index, words array) to words with a document-wide word_index in list order."""
    flat = pages.select("doc_id", "page_pos", T.page_or_first(F.col("page_index")).alias("page_index"), F.posexplode("words").alias("word_pos", "w"))
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("page_pos", "word_pos")) - 1
    return flat.withColumn("word_index", place).select("doc_id", "page_index", "word_index", "w.*")


def latest_overrides(overrides: DataFrame) -> DataFrame:
    """The last action (redact or unredact) of each word by seq."""
    return overrides.groupBy("doc_id", "word_index").agg(F.max_by("action", "seq").alias("action"))


def toggles_to_overrides(toggles: DataFrame, auto: DataFrame) -> DataFrame:
    """Toggles (doc_id, word_index, one row each) against the automatic state: an odd number inverts it."""
    odd = toggles.groupBy("doc_id", "word_index").agg((F.count("*") % 2 == 1).alias("odd")).filter("odd")
    state = F.when(F.coalesce(F.col("auto"), F.lit(False)), "unredact").otherwise("redact")
    return odd.join(auto.select("doc_id", "word_index", "auto"), ["doc_id", "word_index"], "left").select("doc_id", "word_index", state.alias("action"))


def decide(words: DataFrame, overrides: DataFrame, types: list[str] | None = None, custom: str | None = None, mode: str = "reference") -> DataFrame:
    """words with auto (detected), redacted (the reviewer's view) and effective (what an export hides).

    mode "reference": detection is run again on export and added to the reviewer's choice, so an un-redacted detected word is
    hidden all the same. mode "honour": the reviewer's choice stands.
    """
    detected = sensitive_words(words, types, custom).withColumnRenamed("sensitive", "auto")
    state = detected.join(latest_overrides(overrides), ["doc_id", "word_index"], "left")
    redacted = F.when(F.col("action") == "unredact", False).when(F.col("action") == "redact", True).otherwise(F.col("auto"))
    out = state.withColumn("redacted", redacted).drop("action")
    return out.withColumn("effective", F.col("redacted") | F.col("auto") if mode == "reference" else F.col("redacted"))


def with_categories(auto: Column, found: Column, checked: Column) -> Column:
    """Detected, or in one of the checked categories (an array)."""
    return auto | F.coalesce(F.arrays_overlap(found, checked), F.lit(False))


def manual_groups(words: DataFrame, overrides: DataFrame) -> DataFrame:
    """Words redacted by hand, grouped by trimmed text: n, first_index and pages (distinct, ascending)."""
    by_hand = latest_overrides(overrides).filter("action = 'redact'")
    rows = words.join(by_hand, ["doc_id", "word_index"], "left_semi").withColumn("text", T.wide_trim(F.col("text"))).filter("text != ''")
    page = T.page_or_first(F.col("page_index"))
    return rows.groupBy("doc_id", "text").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("word_index")).alias("word_indices"), F.array_sort(F.collect_set(page)).alias("pages"))


def remove_manual(overrides: DataFrame, groups: DataFrame) -> DataFrame:
    """Overrides after removing groups (doc_id, word_indices): their words become un-redacted by an action after the word's last one."""
    gone = groups.select("doc_id", F.explode("word_indices").alias("word_index")).distinct()
    last = overrides.groupBy("doc_id", "word_index").agg(F.max("seq").alias("__seq"))
    kind = overrides.schema["seq"].dataType
    more = gone.join(last, ["doc_id", "word_index"], "left").select("doc_id", "word_index", (F.coalesce("__seq", F.lit(0)) + 1).cast(kind).alias("seq"), F.lit("unredact").alias("action"))
    return overrides.select("doc_id", "word_index", "seq", "action").unionByName(more)


def clear_manual(words: DataFrame, overrides: DataFrame) -> DataFrame:
    """Overrides after removing all groups of words redacted by hand."""
    return remove_manual(overrides, manual_groups(words, overrides).select("doc_id", "word_indices"))


def change_categories(checked: Column, action: str, categories: Column) -> Column:
    """Checked categories (an array) after selecting, deselecting or toggling some."""
    if action == "select":
        return F.array_union(checked, categories)
    left = F.array_except(checked, categories)
    if action == "deselect":
        return left
    if action == "toggle":
        return F.array_union(left, F.array_except(categories, checked))
    raise ValueError(f"no such action: {action}")


def change_faces(faces: DataFrame, disabled: DataFrame, action: str, chosen: DataFrame | None = None) -> DataFrame:
    """The disabled faces (doc_id, page_index, region_index) after an action: "all" enables every face, "none" disables every face, "toggle" inverts the
    chosen ones. Faces keep their region_index when others are deleted (delete_faces)."""
    keys = ["doc_id", "page_index", "region_index"]
    if action == "all":
        return disabled.select(*keys).limit(0)
    if action == "none":
        return faces.select(*keys).distinct()
    if action == "toggle" and chosen is not None:
        some, off = chosen.select(*keys).distinct(), disabled.select(*keys).distinct()
        return off.join(some, keys, "left_anti").unionByName(some.join(off, keys, "left_anti"))
    raise ValueError(f"no such action: {action}")


def delete_faces(faces: DataFrame, chosen: DataFrame) -> DataFrame:
    return faces.join(chosen, ["doc_id", "page_index", "region_index"], "left_anti")


def rescan_region(words: DataFrame, raw: DataFrame, rects: DataFrame) -> DataFrame:
    """words (doc_id, page_index, word_index, text, x, y, width, height) of pages with what a new recognition of regions found added.

    raw: doc_id, page_index, rect_id, word_index, text, confidence, x0, y0, x1, y1 in region space; rects as for align_to_neighbours. Invalid words and
    those that existing ones cover are left out; new ones follow the document's last word, by page, region and place.
    """
    keys, box = ["doc_id", "page_index"], ["text", "x", "y", "width", "height"]
    fresh = align_to_neighbours(filter_ocr_words(raw), rects, words, keys)
    fresh = drop_covered(fresh, words, keys)
    last = words.groupBy("doc_id").agg(F.max("word_index").alias("__last"))
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("page_index", "rect_id", "word_index"))
    added = fresh.withColumn("__n", place).join(last, "doc_id", "left").select(*keys, (F.coalesce("__last", F.lit(-1)) + F.col("__n")).cast(words.schema["word_index"].dataType).alias("word_index"), *box)
    return words.select(*keys, "word_index", *box).unionByName(added)


def active_regions(faces: DataFrame, manual: DataFrame, disabled: DataFrame) -> DataFrame:
    """Faces that are not disabled (by doc_id, page_index, region_index), and all manual regions."""
    on = faces.join(disabled, ["doc_id", "page_index", "region_index"], "left_anti")
    keep = ["doc_id", "page_index", "region_index", "kind", "x", "y", "w", "h"]
    return on.withColumn("kind", F.lit("face")).select(*keep).unionByName(manual.withColumn("kind", F.lit("manual")).select(*keep))


def remove_pages(rows: DataFrame, pages: DataFrame) -> DataFrame:
    """Rows of pages that stay; page numbers are not changed."""
    return rows.join(pages, ["doc_id", "page_index"], "left_anti")


def append_pages(pages: DataFrame, more: DataFrame) -> DataFrame:
    """More pages (doc_id, page_pos from 0) after the last page of each document."""
    last = pages.groupBy("doc_id").agg(F.max("page_pos").alias("__p"), F.max("page_index").alias("__i"))
    placed = more.join(last, "doc_id", "left").withColumns({"page_index": F.coalesce(F.col("__i"), F.lit(0)) + F.col("page_pos") + 1, "page_pos": F.coalesce(F.col("__p") + 1, F.lit(0)) + F.col("page_pos")})
    return pages.unionByName(placed.drop("__p", "__i").select(*pages.columns))
