"""Pages of a folder as they were last read: files whose time and size are unchanged are not opened again.

A refresh lists the files (names, times, sizes; no contents), compares the list with the last one and reads what differs. Files newer than all that
was seen are read by a filter on the time, which the file source takes; other files with a difference (restored or copied with an
old time) are read by their names as long as these are few, and beyond that by one pass over all files. What is read is mended
once, as it is read (doubly nested links, source entries in another than their one form), parsed once, and kept.

Kept are two relations: `files`, the list, and `pages`, one row for each time a file was read, which counts as long as the list holds its stamp.
A file that changes between the list and the read is met as it is read: its row and its entry in the list come from the same look at it. Files without a byte are no pages (file sources pass them over), so a file that is
emptied counts as gone. Bytes that are no UTF-8 become replacement characters.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions import frontedit, markup
from marlstone.operators import lint, pages
from marlstone.sources import wiki
from marlstone.sources.versioned import Relation, Store
from marlstone.sources.workspace import materialize

FILES = Relation("files", "path string, mtime timestamp, size long, stamp string", "path")
PAGES = Relation(
    "pages",
    "path string, mtime timestamp, size long, stamp string, content string, links_fixed int, sources_fixed int, kind string, title string, display_title string, aliases array<string>, tags array<string>, ctime timestamp, text string",
    "path",
)
#: Changed files with an old time that are read by their names; more take one pass over all files.
NAMED_FILES = 10_000


def mended(content: Column, sources: Column, wiki_folder: str) -> tuple[Column, Column, Column]:
    """(text, links made single, source entries rewritten) of a page; sources is what its front matter lists."""
    single, nested = lint.nested_links(content)
    entries = F.coalesce(sources, F.array().cast("array<string>"))
    bare = lambda s: F.regexp_replace(F.regexp_replace(s, r"^\[\[", ""), r"\]\]$", "")
    odd = F.size(F.filter(entries, lambda s: pages.source_path(s, wiki_folder) != bare(s)))
    text = F.when(odd > 0, frontedit.replace_list(single, "sources", pages.source_list(entries, wiki_folder))).otherwise(single)
    return text, nested, odd


@dataclass(frozen=True)
class Snapshot:
    """The kept pages of `folder`, whose wiki lies in `wiki_folder` below it; `root` is a folder of its own that all executors share."""

    spark: SparkSession
    root: str
    folder: str
    wiki_folder: str = "wiki"
    named_files: int = NAMED_FILES
    buckets: int = 64

    @property
    def store(self) -> Store:
        return Store(self.spark, self.root, self.buckets)

    def listed(self) -> DataFrame:
        """(path, file, mtime, size) of the files as they are now; file is the whole address."""
        files = wiki.markdown(self.spark, self.folder)
        return files.select(wiki.below(F.col("path"), self.folder).alias("path"), F.col("_metadata.file_path").alias("file"), F.col("modificationTime").alias("mtime"), F.col("length").alias("size"))

    def _read(self, differ: DataFrame, newest) -> DataFrame:
        """The files that differ, with contents. differ is (path, file, mtime, size)."""
        files = wiki.markdown(self.spark, self.folder)
        if newest is None:
            return files
        old = differ.where(F.col("mtime") <= newest).select("file", "path")
        fresh = files.where(F.col("modificationTime") > newest)
        few = [r.file for r in old.select("file").limit(self.named_files + 1).collect()]  # bounded by the parameter
        if not few:
            return fresh
        if len(few) > self.named_files:
            again = files.withColumn("file", F.col("_metadata.file_path")).where(F.col("modificationTime") <= newest).join(old.select("file"), "file", "left_semi")
        else:
            again = files.where(F.col("_metadata.file_path").isin(few) & (F.col("modificationTime") <= newest))
        return fresh.unionByName(again.select(*fresh.columns))

    def refresh(self) -> dict:
        """Bring the snapshot up to date; gives how many files were read, gone, and mended."""
        store = self.store
        kept = store.read(FILES).select("path", F.col("mtime").alias("old_mtime"), F.col("size").alias("old_size"))
        both = self.listed().join(kept, "path", "full")
        same = F.col("mtime").eqNullSafe(F.col("old_mtime")) & F.col("size").eqNullSafe(F.col("old_size"))
        differ = materialize(both.where(~same).select("path", "file", "mtime", "size"), "differ")
        if store.last() and differ.isEmpty():
            return {"read": 0, "gone": 0, "mended": 0}
        newest = store.read(FILES).agg(F.max("mtime").alias("t")).first().t
        stamp = uuid.uuid4().hex
        seen = self._read(differ.where("file IS NOT NULL"), newest)
        seen = seen.select(wiki.below(F.col("path"), self.folder).alias("path"), wiki.decoded(F.col("content")).alias("raw"), F.col("modificationTime").alias("mtime"), F.col("length").alias("size"))
        text, links, sources = mended(F.col("raw"), F.col("fm.sources"), self.wiki_folder)
        page = wiki.is_page(F.col("path"), self.wiki_folder)
        whole = seen.withColumn("fm", markup.front_matter("raw")).select(
            "path", "mtime", "size", F.when(page, text).otherwise(F.col("raw")).alias("content"),
            F.when(page, links).otherwise(0).cast("int").alias("links_fixed"), F.when(page, sources).otherwise(0).cast("int").alias("sources_fixed"),
        )
        rows = store.write(PAGES, wiki.parsed(whole).withColumns({"stamp": F.lit(stamp), "n": F.lit(1)}), stamp)
        gone = differ.where("file IS NULL").select("path")
        away = store.read(FILES, rows.select("path").unionByName(gone)).select(*FILES.names, (-F.col("n")).alias("n"))
        told = rows.agg(F.count("*").alias("read"), F.count_if(F.col("links_fixed") + F.col("sources_fixed") > 0).alias("mended")).first()
        said = {"read": told["read"], "gone": gone.count(), "mended": told["mended"]}
        store.commit({FILES: rows.select(*FILES.names, "n").unionByName(away), PAGES: None}, said, stamp)
        return said

    def held(self) -> DataFrame:
        """All files as they were read last: the columns of PAGES without the stamp."""
        rows, _ = self.store.rows(PAGES)
        return rows.drop("n").join(self.store.read(FILES).select("path", "stamp"), ["path", "stamp"], "left_semi").drop("stamp")

    def refs(self) -> DataFrame:
        """The wiki's pages as wiki.page_refs gives them, from what is kept; no text is parsed again."""
        own = self.held().where(wiki.is_page(F.col("path"), self.wiki_folder) & ~F.coalesce(F.col("kind") == "welcome", F.lit(False)))
        return own.select(*wiki.REF_COLUMNS)

    def fixes(self) -> DataFrame:
        """(path, content) of the files that the last refresh mended, to be written over them by the host."""
        last = self.store.last()
        if last is None:
            return self.held().select("path", "content")
        rows, _ = self.store.rows(PAGES)
        return rows.where((F.col("stamp") == last["folder"]) & (F.col("links_fixed") + F.col("sources_fixed") > 0)).select("path", "content")
