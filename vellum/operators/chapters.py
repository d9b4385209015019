"""Chapters from a table of contents, texts split at their headings, and pages joined to chapter ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellum.functions.markdown import localise_images, slug


def is_book(toc: DataFrame, key: str = "book_id") -> DataFrame:
    """(key, is_book): a level below the first and three entries at least."""
    return toc.groupBy(key).agg((F.bool_or(F.col("level") >= 2) & (F.count("*") >= 3)).alias("is_book"))


def chapter_bounds(toc: DataFrame, books: DataFrame) -> DataFrame:
    """(book_id, ord, id, title, start, end, header_re) from toc (book_id, ord, level, title, page) and books (book_id, n_pages).

    Level-2 titles that begin with a number are chapters, up to the page before the next; before the first lies the front
    matter; level-1 titles that begin with Appendix, then bibliography and index, follow, and the last chapter ends before the first of them.
    """
    number = F.regexp_extract("title", r"^(\d+)\s+(.+)$", 1)
    name = F.regexp_extract("title", r"^(\d+)\s+(.+)$", 2)
    numbered = toc.where((F.col("level") == 2) & (number != "")).select("book_id", "ord", "page", number.cast("int").alias("num"), name.alias("name"))
    lower = F.lower("title")
    appendix = F.startswith(F.col("title"), F.lit("Appendix"))
    extra = toc.where((F.col("level") == 1) & (appendix | lower.isin("bibliography", "index"))).select("book_id", "ord", "page", "title", F.when(appendix, 0).otherwise(1).alias("class"))
    by_toc, by_class = Window.partitionBy("book_id").orderBy("ord"), Window.partitionBy("book_id").orderBy("class", "ord")
    firsts = extra.groupBy("book_id").agg(F.min(F.struct("class", "ord", "page"))["page"].alias("first_extra"))
    chapters = numbered.join(books, "book_id").join(firsts, "book_id", "left").withColumns({"next": F.lead("page").over(by_toc)})
    end = F.when(F.col("next").isNotNull(), F.col("next") - 1).otherwise(F.coalesce(F.col("first_extra") - 1, F.col("n_pages")))
    num = F.col("num").cast("string")
    two = F.when(F.length(num) < 2, F.concat(F.lit("0"), num)).otherwise(num)  # larger numbers stay whole
    place = lambda group: F.concat(group, F.lpad(F.col("ord").cast("string"), 8, "0"))
    main = chapters.select(
        "book_id", place(F.lit("1")).alias("ord"), F.concat(two, F.lit("_"), slug(F.col("name"))).alias("id"), F.concat(num, F.lit(". "), F.col("name")).alias("title"),
        F.col("page").alias("start"), end.alias("end"), F.concat(F.lit(r"^#+\s+"), num, F.lit(r"\s+\S")).alias("header_re"),
    )
    front = numbered.groupBy("book_id").agg(F.min(F.struct("ord", "page"))["page"].alias("page")).where("page > 1").select(
        "book_id", F.lit("0").alias("ord"), F.lit("00_front_matter").alias("id"), F.lit("Front Matter").alias("title"),
        F.lit(1).cast("long").alias("start"), (F.col("page") - 1).alias("end"), F.lit(None).cast("string").alias("header_re"),
    )
    tail = extra.join(books, "book_id").withColumn("next", F.lead("page").over(by_class))
    number_of = F.nullif(F.regexp_extract("title", r"Appendix\s+(\d+)", 1), F.lit(""))
    # an appendix without a number is any heading that begins with the word
    appendix_re = F.concat(F.lit(r"^#+\s+Appendix"), F.coalesce(F.concat(F.lit(r"\s+"), number_of), F.lit(r"\s+?")), F.lit(r"\b"))
    heading = F.when(F.col("class") == 0, appendix_re).otherwise(F.concat(F.lit(r"^#+\s+"), F.col("title"), F.lit(r"\s*$")))
    last = tail.select(
        "book_id", place((F.col("class") + 2).cast("string")).alias("ord"), F.concat(F.lit("app_"), slug(F.col("title"))).alias("id"), "title",
        F.col("page").alias("start"), F.coalesce(F.col("next") - 1, F.col("n_pages")).alias("end"), heading.alias("header_re"),
    )
    return front.unionByName(main).unionByName(last)


def split_by_headers(texts: DataFrame, chapters: DataFrame, key: str = "book_id") -> DataFrame:
    """(key, id, start_line, chunk): each chapter's lines from the first that its pattern matches up to the next chapter's.

    Chapters without a pattern begin with the text if they come first; those whose heading isn't found have no row. A text stays one row, which meets the short
    list of its book's chapters; its lines are sliced there, so no text is repeated for each chapter or shuffled with it.
    """
    listed = chapters.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("ord", "id", "header_re"))).alias("_chapters"))
    rows = texts.select(key, F.split(F.col("text"), "(?<=\n)").alias("_lines")).join(listed, key)

    def start(c):
        match = F.array_position(F.transform("_lines", lambda line: F.regexp_like(line, c["header_re"])), True).cast("int") - 1
        return F.when(c["header_re"].isNull(), F.when(c["ord"] == "0", F.lit(0))).when(match >= 0, match)

    starts = F.transform("_chapters", lambda c: F.struct(start(c).alias("start"), c["ord"].alias("ord"), c["id"].alias("id")))
    rows = rows.withColumn("_found", F.array_sort(F.filter(starts, lambda f: f["start"].isNotNull())))

    def chunk(f, i):
        end = F.coalesce(F.get("_found", i + 1)["start"], F.size("_lines"))
        text = F.array_join(F.slice("_lines", f["start"] + 1, F.greatest(end - f["start"], F.lit(0))), "")
        return F.struct(f["id"].alias("id"), f["start"].cast("long").alias("start_line"), text.alias("chunk"))

    return rows.select(key, F.explode(F.transform("_found", chunk)).alias("c")).select(key, "c.*")


def book_header(title, author, path):
    """(title, subtitle) columns of a book's index: the declared title or the file's name with blanks, and the author in bold or nothing."""
    said = lambda c: F.nullif(F.trim(F.coalesce(c, F.lit(""))), F.lit(""))
    stem = F.regexp_replace(F.regexp_extract(path, r"([^/]+)$", 1), r"(?<=.)\.[^.]*$", "")
    named = F.coalesce(F.nullif(F.trim(F.replace(stem, F.lit("_"), F.lit(" "))), F.lit("")), stem)
    return F.coalesce(said(title), named), F.coalesce(F.concat(F.lit("**"), said(author), F.lit("**")), F.lit(""))


def chapter_page(chapters: DataFrame, chunks: DataFrame, counts: DataFrame, key: str = "book_id") -> DataFrame:
    """(key, id, md): each found chapter under a heading of its own, with its pages and images told; the heading that its text began with goes, and images are local."""
    rows = chapters.join(chunks, [key, "id"]).join(counts, [key, "id"], "left")
    body = F.regexp_replace(localise_images(F.col("chunk")), r"\A#\s+[^\n]*\n?", "")
    told = F.format_string("*Pages %s to %s of the source, %s images.*", F.col("start").cast("string"), F.col("end").cast("string"), F.coalesce("images", F.lit(0)).cast("string"))
    return rows.select(key, "id", F.concat(F.lit("# "), F.col("title"), F.lit("\n\n"), told, F.lit("\n\n---\n\n"), body).alias("md"))


def images_in_chapters(images: DataFrame, chapters: DataFrame, key: str = "book_id") -> DataFrame:
    """(key, id, images): images counted for the first chapter whose pages hold theirs, chapters without images included.

    Chapter ranges become page rows, so that the range join is an equi-join; the first chapter in order wins a shared page.
    """
    page = F.regexp_extract("name", r"(?i)_page_(\d+)_(?:Picture|Figure|Table)_\d+\.[\p{L}\p{N}_]+", 1)
    placed = images.where(page != "").select(key, "name", (page.cast("int") + 1).alias("page"))
    pages = chapters.where(F.col("start") <= F.col("end")).select(key, "id", "ord", F.explode(F.sequence("start", "end").cast("array<int>")).alias("page"))
    owner = pages.groupBy(key, "page").agg(F.min(F.struct("ord", "id"))["id"].alias("id"))
    counts = placed.join(owner, [key, "page"]).groupBy(key, "id").agg(F.count("*").alias("n"))
    return chapters.select(key, "id").join(counts, [key, "id"], "left").select(key, "id", F.coalesce("n", F.lit(0)).alias("images"))


def index_page(chapters: DataFrame, counts: DataFrame, key: str = "book_id") -> DataFrame:
    """(key, index_md): one line a chapter in order, and totals."""
    rows = chapters.join(counts, [key, "id"], "left").withColumn("line", F.concat(F.lit("| ["), F.col("title"), F.lit("](./"), F.col("id"), F.lit("/"), F.col("id"), F.lit(".md) | "), F.col("start").cast("string"), F.lit("-"), F.col("end").cast("string"), F.lit(" | "), F.coalesce("images", F.lit(0)).cast("string"), F.lit(" |")))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "line"))), lambda r: r["line"]), "\n")
    return rows.groupBy(key).agg(F.concat(body, F.lit("\n\n"), F.count("*").cast("string"), F.lit(" chapters, "), F.coalesce(F.sum("images"), F.lit(0)).cast("string"), F.lit(" images")).alias("index_md"))
