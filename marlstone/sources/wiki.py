"""Reading and writing wikis: page scans, index and log sinks, caches."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marlstone.functions import markup

#: Parts of a path that are no page of the wiki.
NO_PAGES = ("/index.md", "/log.md", "/schema/", "/contradictions/")
TEXT_CHARS = 2000
REF_COLUMNS = ("path", "title", "display_title", "aliases", "tags", "ctime", "text")
SUMMARY_CHARS, NO_SUMMARY = 100, "No summary"


def markdown(spark: SparkSession, folder: str) -> DataFrame:
    """All markdown files below a folder as (path, modificationTime, length, content); content is read only where it is selected."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.md").option("recursiveFileLookup", "true").load(folder)


def below(path: Column, folder: str) -> Column:
    """A file's address as a path relative to a folder that it lies in."""
    return F.regexp_replace(F.regexp_replace(path, "^[a-z]+:/*", "/"), "^" + re.escape("/" + folder.split(":", 1)[-1].strip("/") + "/"), "")


def decoded(content: Column) -> Column:
    """Bytes as UTF-8 text; those that are none become replacement characters, where decode would fail."""
    return F.make_valid_utf8(content.cast("string"))


def scan(spark: SparkSession, folder: str) -> DataFrame:
    """(path, content, mtime, size) of all markdown files below a folder, paths relative to it."""
    return markdown(spark, folder).select(below(F.col("path"), folder).alias("path"), decoded(F.col("content")).alias("content"), F.col("modificationTime").alias("mtime"), F.col("length").alias("size"))


def is_page(path: Column, wiki_folder: str) -> Column:
    out = path.startswith(wiki_folder.rstrip("/") + "/")
    for part in NO_PAGES:
        out = out & ~F.contains(path, F.lit(part))
    return out


def parsed(files: DataFrame) -> DataFrame:
    """files (path, content, ...) with kind (the type in the front matter) and the page's reference: REF_COLUMNS."""
    body = markup.body(F.col("content"))
    read = files.withColumn("fm", markup.front_matter(F.col("content")))
    return read.withColumns({
        "kind": F.col("fm.type"), "title": F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.md$", ""),
        "display_title": F.nullif(F.trim(F.regexp_extract(body, r"(?m)^#\s+(.+)$", 1)), F.lit("")), "aliases": F.col("fm.aliases"), "tags": F.col("fm.tags"),
        "ctime": F.to_timestamp("fm.created"), "text": F.left(F.lower(body), F.lit(TEXT_CHARS)),
    }).drop("fm")


def page_refs(files: DataFrame, wiki_folder: str) -> DataFrame:
    """(path, title, display_title, aliases, tags, ctime, text) of a wiki's pages; welcome pages are left out, text is the lower-case beginning of the body."""
    pages = parsed(files.where(is_page(F.col("path"), wiki_folder)))
    return pages.where(~F.coalesce(F.col("kind") == "welcome", F.lit(False))).select(*REF_COLUMNS)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """Page references of an index file, see markup.index_lines."""
    return markup.index_lines(spark.read.text(path).withColumnRenamed("value", "line"))


def first_body_line(content: Column, stub: Column | None = None) -> Column:
    """The first line that is neither blank, heading nor rule (for stubs, nor quote), cut short; a fixed text without one."""
    good = lambda x: (F.trim(x) != "") & ~x.rlike(r"^\s*(#{1,6}\s|---+\s*$|\*\*\*+\s*$)") & ~(F.coalesce(stub, F.lit(False)) & x.startswith(">")) if stub is not None else (F.trim(x) != "") & ~x.rlike(r"^\s*(#{1,6}\s|---+\s*$|\*\*\*+\s*$)")
    found = F.try_element_at(F.filter(F.split(markup.body(content), "\n"), good), F.lit(1))
    return F.coalesce(F.left(F.trim(found), F.lit(SUMMARY_CHARS)), F.lit(NO_SUMMARY))


def primary_source(sources: Column) -> Column:
    """The slug of the first link to a source page, null without one."""
    hits = F.filter(F.transform(sources, lambda s: F.regexp_extract(s, r"sources/([^\]|#]+)", 1)), lambda s: s != "")
    return F.regexp_replace(F.try_element_at(hits, F.lit(1)), r"\.md$", "")


def index_text(pages: DataFrame) -> DataFrame:
    """(line) of the index, in order: a heading for each folder and a bullet for each page of (folder, path, title, aliases, source_slug, summary)."""
    aliases = F.when(F.size("aliases") > 0, F.concat(F.lit(" `aliases: "), F.array_join("aliases", ", "), F.lit("`"))).otherwise("")
    source = F.when(F.col("source_slug").isNotNull(), F.concat(F.lit(" `source: "), "source_slug", F.lit("`"))).otherwise("")
    bullets = pages.select("folder", F.lit(1).alias("kind"), "path", F.concat(F.lit("- [["), "path", F.lit("|"), "title", F.lit("]]"), aliases, source, F.lit(" - "), "summary").alias("line"))
    heads = pages.select("folder").distinct().select("folder", F.lit(0).alias("kind"), F.lit("").alias("path"), F.concat(F.lit("## "), "folder").alias("line"))
    return heads.unionByName(bullets).orderBy("folder", "kind", "path").select("line")


def write_index(pages: DataFrame, path: str) -> None:
    index_text(pages).write.mode("overwrite").text(path)


def append_log(entries: DataFrame, path: str) -> None:
    """Append entries (date, operation, title, created, updated) as rows of a log table."""
    entries.write.mode("append").parquet(path)


def upsert(cache: DataFrame, fresh: DataFrame, key: str = "key", most_bytes: int = 10 << 20) -> DataFrame:
    """The cache with fresh rows in place of those of equal key; rows above the size cap are not taken."""
    fine = fresh.where(F.col("size") <= most_bytes)
    return cache.join(fine.select(key), key, "left_anti").unionByName(fine)


def cache_key(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("\0", *parts), 256)


def image_packages(images: DataFrame, most_bytes: int, most_images: int) -> DataFrame:
    """images (source, pos, bytes) with package: a new one opens when the next image would break a cap; an ordered fold for each source."""
    import pandas as pd

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos")
        packages, package, held, count = [], 0, 0, 0
        for size in rows["bytes"]:
            if count and (count >= most_images or held + size > most_bytes):
                package, held, count = package + 1, 0, 0
            held, count = held + size, count + 1
            packages.append(package)
        return rows.assign(package=packages)

    return images.select("source", "pos", "bytes").groupBy("source").applyInPandas(fold, "source string, pos int, bytes long, package int")


def embedded_images(notes: DataFrame, files: DataFrame, most_bytes: int = 10 << 20) -> DataFrame:
    """(path, pos, image, reason) of the images that notes (path, content) embed; reason is why one is skipped, null if it is taken.

    files is (image, bytes).
    """
    embeds = notes.select("path", F.posexplode(F.regexp_extract_all("content", F.lit(r"!\[\[([^\]|]+)(?:\|[^\]]*)?\]\]|!\[[^\]]*\]\(([^)]+)\)"), 0)).alias("pos", "raw"))
    named = embeds.withColumn("image", F.trim(F.coalesce(F.nullif(F.regexp_extract("raw", r"!\[\[([^\]|]+)", 1), F.lit("")), F.regexp_extract("raw", r"\(([^)]+)\)", 1))))
    sized = named.join(files, "image", "left").withColumn("nth", F.row_number().over(Window.partitionBy("path", "image").orderBy("pos")))
    reason = (
        F.when(F.col("image").rlike("^https?://"), "remote").when(F.col("bytes").isNull(), "missing").when(F.col("nth") > 1, "duplicate")
        .when(~F.lower("image").rlike(r"\.(png|jpe?g|gif|webp)$"), "unsupported").when(F.col("bytes") > most_bytes, "oversized")
    )
    return sized.select("path", "pos", "image", reason.alias("reason"))


def pdf_info(head: Column) -> Column:
    """struct<title, author, encrypted> from the raw text of a PDF's dictionaries."""
    text = lambda k: F.nullif(F.regexp_extract(head, rf"/{k}\s*\(([^)]*)\)", 1), F.lit(""))
    return F.struct(text("Title").alias("title"), text("Author").alias("author"), F.contains(head, F.lit("/Encrypt")).alias("encrypted"))


def in_folder(path: Column, folder: str) -> Column:
    """Inside a folder; the empty folder is the root, which has everything."""
    return F.lit(True) if not folder.strip("/") else path.startswith(folder.rstrip("/") + "/")


def at_or_in_folder(path: Column, folder: str) -> Column:
    return in_folder(path, folder) | (path == folder.rstrip("/"))


def ingestable(path: Column, folder: str, wiki_folder: str, config_folder: str) -> Column:
    return in_folder(path, folder) & ~at_or_in_folder(path, wiki_folder) & ~at_or_in_folder(path, config_folder)


def rejection(extension: Column, content: Column, allowed: list[str]) -> Column:
    """The first reason to refuse a source, null if there is none."""
    return F.when(markup.is_blank(content), "empty").when(~F.lower(extension).isin(*allowed), "incompatible-type")
