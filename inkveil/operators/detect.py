"""Detection over the word relation: doc_id, page_index, word_index, text, y, height and more."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkveil.functions import patterns as P
from inkveil.functions import text as T

#: Height below which words on one line may differ in y all the same.
LINE_SLACK = 22


#: A token with four digits, which every year is once other characters are dropped.
FOUR_DIGITS = "[0-9]" + f"[^0-9{T.WHITE_CLASS}]*[0-9]" * 3


def _words(text: Column) -> Column:
    """The words of a plain text, without blank and noise tokens: an array of line, place (among the parts of the line) and text."""

    def of_line(line: Column, number: Column) -> Column:
        return F.transform(F.split(line, T.WHITE + "+"), lambda t, place: F.struct(number.alias("line"), place.alias("place"), t.alias("text")))

    return F.filter(F.flatten(F.transform(F.split(text, "\n"), of_line)), lambda w: (w["text"] != "") & ~T.is_noise(w["text"]))


def document_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Words of plain-text documents: doc_id, word_index (from 0), line, place, text. Narrow."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.posexplode(_words(F.col(text_col))).alias("word_index", "w"))
    return rows.select("doc_id", "word_index", "w.line", "w.place", "w.text")


def _split_dates(words: Column) -> Column:
    """Places in an array of words at which a date of three words begins. Lines are LINE_SLACK apart, so its words are on one line."""

    def head(i: Column) -> Column:
        w = [F.get(words, i + k) for k in range(3)]
        parts = T.is_year(w[2]["text"]) & T.is_day(w[0]["text"]) & T.is_month(w[1]["text"])
        return (w[0]["line"] == w[2]["line"]) & parts

    none = F.array().cast("array<int>")
    return F.when(F.size(words) >= 3, F.filter(F.sequence(F.lit(0), F.size(words) - 3), head)).otherwise(none)


def hits(text: Column) -> Column:
    """The sensitive words of a plain text: an array of word_index, line, place, text, own (the word's categories) and categories (also dob, if it is
    part of a split date). It is one expression on the row, so documents are never taken apart and put together."""

    def of_words(words: Column) -> Column:
        none = F.array().cast("array<int>")
        return T.let(F.when(text.rlike(FOUR_DIGITS), _split_dates(words)).otherwise(none), lambda heads: tagged(words, heads))

    def tagged(words: Column, heads: Column) -> Column:
        def tag(w: Column, i: Column) -> Column:
            part = F.exists(heads, lambda h: (i >= h) & (i <= h + 2))
            dated = F.when(part, F.array(F.lit("dob"))).otherwise(F.array().cast("array<string>"))
            of = lambda own: F.struct(i.alias("word_index"), w["line"].alias("line"), w["place"].alias("place"), w["text"].alias("text"), own.alias("own"), in_order(F.array_union(own, dated)).alias("categories"))
            return T.let(P.categories(w["text"]), of)

        some = lambda w, i: P.worth_matching(w["text"]) | F.exists(heads, lambda h: (i >= h) & (i <= h + 2))
        maybe = F.filter(F.transform(words, lambda w, i: F.when(some(w, i), tag(w, i))), lambda x: x.isNotNull())
        return F.filter(maybe, lambda x: F.size(x["categories"]) > 0)

    def in_order(found: Column) -> Column:
        return F.filter(F.array(*[F.lit(k) for k, _ in P.CATEGORIES]), lambda k: F.array_contains(found, k))

    return F.when(P.worth_reading(text) | text.rlike(FOUR_DIGITS), T.let(_words(text), of_words))


def secrets(text: Column) -> Column:
    """The distinct sensitive words of a plain text in order of their first occurrence; null if there cannot be any."""
    return F.array_distinct(F.transform(F.filter(hits(text), lambda x: F.size(x["own"]) > 0), lambda x: T.wide_trim(x["text"])))


def tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """All non-blank tokens: doc_id, the columns to keep, pos (place among the parts between white space), token."""
    parts = F.posexplode(F.split(F.col(text_col), T.WHITE + "+")).alias("pos", "token")
    return docs.select(F.col(id_col).alias("doc_id"), *keep, parts).filter("token != ''")


def tagged_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per token and category. The prefilter, necessary for every pattern, leaves few texts and tokens to match."""
    some = tokens(docs.filter(P.worth_reading(F.col(text_col))), id_col, text_col, keep).filter(P.worth_matching(F.col("token")))
    return some.select("doc_id", *keep, "pos", "token", F.explode(P.categories(F.col("token"))).alias("category"))


def is_sensitive(token: Column, types: list[str] | None = None, custom: str | None = None) -> Column:
    """Whether the token alone is sensitive for the active types."""
    active = P.ALL_TYPES if types is None else types
    wanted = [k for k, _ in P.CATEGORIES if k in active or (k == "dob" and "date" in active)]
    found = F.arrays_overlap(P.categories(token), F.array(*map(F.lit, wanted))) if wanted else F.lit(False)
    own = T.contains_query(token, custom) if "custom" in active else F.lit(False)
    usable = token.isNotNull() & (token != "") & ~T.is_noise(token)
    return F.coalesce(usable & (found | own), F.lit(False))


def same_line(first: str, other_y: Column) -> Column:
    return F.abs(other_y - F.col(f"{first}y")) < F.greatest(F.col(f"{first}height"), F.lit(LINE_SLACK))


def mark_split_dates(words: DataFrame) -> DataFrame:
    """Adds split_date: the word is the day, month or year of a date written as three neighbouring words on one
    page and line. Neighbours are neighbours by word_index within the document."""
    w = Window.partitionBy("doc_id").orderBy("word_index")
    page = T.page_or_first(F.col("page_index"))
    usable = lambda c: F.coalesce(c, F.lit(False))
    parts = usable(T.is_day(F.col("text"))) & usable(T.is_month(F.lead("text", 1).over(w))) & usable(T.is_year(F.lead("text", 2).over(w)))
    place = usable((F.lead(page, 1).over(w) == page) & (F.lead(page, 2).over(w) == page))
    line = usable(same_line("", F.lead("y", 1).over(w)) & same_line("", F.lead("y", 2).over(w)))
    headed = words.withColumn("__head", parts & place & line)
    before = lambda n: F.coalesce(F.lag("__head", n).over(w), F.lit(False))
    return headed.withColumn("split_date", F.col("__head") | before(1) | before(2)).drop("__head")


def word_categories(words: DataFrame) -> DataFrame:
    """doc_id, word_index, category: of single words and of split dates (as dob). Expects a words relation."""
    marked = mark_split_dates(words)
    own = F.array_union(P.categories(F.col("text")), F.when(F.col("split_date"), F.array(F.lit("dob"))).otherwise(F.array().cast("array<string>")))
    return marked.select("doc_id", "word_index", F.explode(own).alias("category"))


def document_hits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, word_index, line, place, category of plain-text documents: of single words, and of split dates (as dob). Narrow; each row is
    a document of its own, also where ids are null or repeat."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.explode(hits(F.col(text_col))).alias("x"))
    return rows.select("doc_id", "x.word_index", "x.line", "x.place", F.explode("x.categories").alias("category"))


def document_word_categories(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """document_hits without places: doc_id, word_index, category."""
    return document_hits(docs, id_col, text_col).select("doc_id", "word_index", "category")


def document_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs and category present: doc_id, ord, category, label, n_words, word_indices (ascending). Narrow."""

    def of(found: Column) -> Column:
        def entry(k: int, kind: str, label: str) -> Column:
            at = F.transform(F.filter(found, lambda x: F.array_contains(x["categories"], kind)), lambda x: x["word_index"])
            return F.struct(F.lit(k).alias("ord"), F.lit(kind).alias("category"), F.lit(label).alias("label"), at.alias("word_indices"))

        return F.filter(F.array(*[entry(k, *c) for k, c in enumerate(P.CATEGORIES)]), lambda e: F.size(e["word_indices"]) > 0)

    rows = docs.select(F.col(id_col).alias("doc_id"), F.explode(T.let(hits(F.col(text_col)), of)).alias("e"))
    return rows.select("doc_id", "e.ord", "e.category", "e.label", F.size("e.word_indices").cast("long").alias("n_words"), "e.word_indices")


#: Words that announce a value beside or below them.
LABELS = ("nama", "alamat", "tempat", "name", "address", "dob")


def label_neighbours(words: DataFrame, labels: tuple[str, ...] = LABELS, reach: float = 300.0, line: float = 22.0) -> DataFrame:
    """Words (doc_id, page_index, word_index, text, x, y, width) right of a label on its line, up to `reach` pixels away, or in its columns
    within two lines below: doc_id, word_index, label_index, side. An addition that only the documentation of such tools describes.

    Pages are cut into bands of three lines, and a label looks into its own and the next ones, so the join has equal keys.
    """
    band = F.floor(F.col("y") / (3 * line))
    keys = ["doc_id", "page_index"]
    own = words.withColumn("page_index", T.page_or_first(F.col("page_index"))).withColumn("band", band)
    said = own.filter(T.letters_only(F.col("text")).isin(*labels)).select(*keys, F.col("word_index").alias("label_index"), F.col("x").alias("lx"), F.col("y").alias("ly"), F.col("width").alias("lw"), F.explode(F.array(band - 1, band, band + 1)).alias("band"))
    met = own.join(said, [*keys, "band"]).filter("word_index != label_index")
    drop, gap = F.col("y") - F.col("ly"), F.col("x") - (F.col("lx") + F.col("lw"))
    right = (F.abs(drop) <= line / 2) & (gap >= 0) & (gap <= reach)
    below = (drop > line / 2) & (drop <= 2 * line) & (F.col("x") < F.col("lx") + F.col("lw")) & (F.col("x") + F.col("width") > F.col("lx"))
    side = F.when(right, "right").when(below, "below")
    return met.withColumn("side", side).filter("side is not null").select("doc_id", "word_index", "label_index", "side")


def sensitive_words(words: DataFrame, types: list[str] | None = None, custom: str | None = None) -> DataFrame:
    """Adds sensitive: single-word detection, or a split date if dates or dates of birth are active."""
    active = P.ALL_TYPES if types is None else types
    out = mark_split_dates(words).withColumn("sensitive", is_sensitive(F.col("text"), active, custom))
    if {"dob", "date"} & set(active):
        out = out.withColumn("sensitive", F.col("sensitive") | F.col("split_date"))
    return out.drop("split_date")


def category_report(found: DataFrame) -> DataFrame:
    """Per document and category present: ord, category, label, n_words, word_indices (ascending)."""
    spark = found.sparkSession
    names = spark.createDataFrame([(k, kind, label) for k, (kind, label) in enumerate(P.CATEGORIES)], "ord int, category string, label string")
    rows = found.groupBy("doc_id", "category").agg(F.countDistinct("word_index").alias("n_words"), F.array_sort(F.collect_set("word_index")).alias("word_indices"))
    return rows.join(F.broadcast(names), "category").select("doc_id", "ord", "category", "label", "n_words", "word_indices")  # nine rows


def corpus_report(reports: DataFrame) -> DataFrame:
    """Per category present in the corpus: ord, category, label, n_words, n_docs; from document_report or category_report, pre-aggregated."""
    return reports.groupBy("ord", "category", "label").agg(F.sum("n_words").alias("n_words"), F.count("*").alias("n_docs"))
