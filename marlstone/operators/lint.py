"""Data-quality rules over pages, links, sources and tags; each gives rows of findings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions.text import body_hash, link_reduced, normalize_quote, normalize_statement

LINK = r"\[\[([^\]|#]+)(?:[|#][^\]]+)?\]\]"
#: Fixed values of the page format.
STUB_MARK = "Auto-generated stub page"
MARKUP = r"[#*\-_>\s\[\]|—]"
LEAST_SUBSTANCE = 50
STATEMENT_WORDS = 6
TYPES = ("entity", "concept", "source")


def mask_code(content: Column) -> Column:
    """Fenced lines and inline code blanked, lengths kept; the work is in proportion to the text.

    The text is cut before each fence line: every second piece is inside a fence, and a later piece outside begins with the fence that closes.
    Inline code lies between two backticks of a line; a last backtick without a partner stays.
    """
    blank = lambda s: F.regexp_replace(s, r"[^\n]", " ")

    def inline(line: Column) -> Column:
        bits = F.split(line, "`")
        one = lambda p, i: F.when(i % 2 == 0, p).when(i < F.size(bits) - 1, F.concat(F.lit(" "), blank(p), F.lit(" "))).otherwise(F.concat(F.lit("`"), p))
        return F.array_join(F.transform(bits, one), "")

    def outside(text: Column) -> Column:
        return F.array_join(F.transform(F.split(text, "\n"), inline), "\n")

    def piece(p: Column, i: Column) -> Column:
        fence_end = F.locate("\n", p)
        after = F.concat(blank(F.left(p, fence_end)), outside(F.substring(p, fence_end + 1, F.length(p))))
        return F.when((i % 2 == 1) | ((i > 0) & (fence_end == 0)), blank(p)).when(i == 0, outside(p)).otherwise(after)

    pieces = F.split(F.concat(F.lit("\n"), content), r"(?<=\n)(?=[^\S\n]*(?:```|~~~))")
    return F.substring(F.array_join(F.transform(pieces, piece), ""), F.lit(2), F.length(content))


def known_targets(files: DataFrame) -> DataFrame:
    """(target): every suffix of every file's path, with and without extension, and its lower-case form.  files is (path)."""
    bare = F.regexp_replace("path", r"\.md", "")
    parts = F.split(bare, "/")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))
    forms = files.select(F.explode(F.flatten(F.transform(suffixes, lambda s: F.array(s, F.concat(s, F.lit(".md")))))).alias("t"))
    return forms.select(F.explode(F.array("t", F.lower("t"))).alias("target")).distinct()


def page_links(pages: DataFrame) -> DataFrame:
    """(source, target): the trimmed link targets of each page outside code, once each.  pages is (path, content)."""
    return pages.select(F.col("path").alias("source"), F.explode(F.regexp_extract_all(mask_code(F.col("content")), F.lit(LINK), 1)).alias("t")).select("source", F.trim("t").alias("target")).distinct()


def dead_links(links: DataFrame, known: DataFrame) -> DataFrame:
    """links (source, target) whose target is unknown as it is, in lower case, and with dashes for spaces in its last name."""
    slugged = F.concat(F.regexp_extract("target", r"^(.*/)?", 0), F.regexp_replace(F.regexp_extract("target", r"[^/]*$", 0), r"\s+", "-"))
    forms = F.array_distinct(F.array("target", F.lower("target"), slugged, F.lower(slugged)))
    wanted = links.select("target").distinct().select("target", F.explode(forms).alias("form"))
    resolved = wanted.join(known.select(F.col("target").alias("form")), "form", "left_semi").select("target").distinct()
    return links.join(resolved, "target", "left_anti")


def orphans(pages: DataFrame, links: DataFrame) -> DataFrame:
    """pages (path, aliases, stub) that no link names by path, suffix or alias, whatever the case; stubs are exempt."""
    bare = F.regexp_replace("path", r"\.md", "")
    parts = F.split(bare, "/")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))
    forms = F.concat(suffixes, F.transform(suffixes, lambda s: F.concat(s, F.lit(".md"))), F.coalesce("aliases", F.array().cast("array<string>")))
    named = pages.where("NOT coalesce(stub, false)").select("path", F.explode(F.array_distinct(F.concat(forms, F.transform(forms, lambda f: F.lower(f))))).alias("target"))
    linked = named.join(links.select("target").distinct(), "target", "left_semi").select("path").distinct()
    return pages.where("NOT coalesce(stub, false)").join(linked, "path", "left_anti")


def substantive(content: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(content, r"(?s)^---.*?---", ""), MARKUP, "")


def is_empty_page(content: Column) -> Column:
    return F.contains(content, F.lit(STUB_MARK)) | (F.char_length(substantive(content)) < LEAST_SUBSTANCE)


def polluted_titles(pages: DataFrame) -> DataFrame:
    """(path, title, clean_title) of titles that begin with a folder name glued to a letter beyond ASCII."""
    bad = F.col("title").rlike(r"^(entities|concepts|sources)[^\s\-_a-zA-Z0-9]")
    return pages.where(bad).select("path", "title", F.regexp_replace("title", "^(entities|concepts|sources)", "").alias("clean_title"))


def nested_links(content: Column) -> tuple[Column, Column]:
    """(fixed text, how many): doubly bracketed links made single."""
    pattern = r"\[\[\[\[([^\]|#]+)(?:[|#]([^\]]+))?\]\]\]\]"
    shown = F.regexp_replace(content, r"\[\[\[\[([^\]|#]+)[|#]([^\]]+)\]\]\]\]", r"[[$1|$2]]")
    return F.regexp_replace(shown, r"\[\[\[\[([^\]|#]+)\]\]\]\]", r"[[$1]]"), F.regexp_count(content, F.lit(pattern))


def tag_violations(pages: DataFrame, allowed: DataFrame) -> DataFrame:
    """(path, type, invalid): typed pages with a tag outside their type's vocabulary, or without any tag.

    pages is (path, type, tags); allowed is (type, tags), one row for each type.
    """
    own = F.filter(F.transform(F.coalesce("tags", F.array().cast("array<string>")), lambda t: F.trim(t)), lambda t: t != "")
    vocab = allowed.select("type", F.col("tags").alias("valid"))
    judged = pages.where(F.col("type").isin(*TYPES)).join(F.broadcast(vocab), "type", "left").withColumn("own", own)  # three rows
    judged = judged.withColumn("invalid", F.filter("own", lambda t: ~F.array_contains(F.coalesce("valid", F.array().cast("array<string>")), t)))
    return judged.where((F.size("invalid") > 0) | (F.size("own") == 0)).select("path", "type", "invalid")


def source_drift(pages: DataFrame, notes: DataFrame) -> DataFrame:
    """(page, note, kind): source pages none of whose readable origin notes matches the stored hash.

    pages is (path, stored_hash, stored_links_hash, origins); notes (path, content).  The first mismatch is named;
    it is links-only when the text matches once links are reduced to their names.
    """
    wanted = pages.where(F.col("stored_hash").isNotNull()).select(F.col("path").alias("page"), "stored_hash", "stored_links_hash", F.posexplode("origins").alias("pos", "note"))
    read = wanted.join(notes.select(F.col("path").alias("note"), body_hash(F.col("content")).alias("now"), body_hash(link_reduced(F.col("content"))).alias("now_links")), "note")
    kind = F.when(F.col("now_links") == F.col("stored_links_hash"), "links-only").otherwise("edited")
    by_page = read.groupBy("page").agg(F.max(F.col("now") == F.col("stored_hash")).alias("same"), F.min_by(F.struct("note", kind.alias("kind")), "pos").alias("first"))
    return by_page.where("NOT same").select("page", "first.note", "first.kind")


def _short_quotes(quotes: DataFrame, bodies: DataFrame) -> DataFrame:
    """(quote_id, source_id) of sources that may contain a quote (quote_id, q) of one or two words.

    One word is a part of a word of the source: it begins some suffix of it, met by its first three characters. Of two the first ends a word:
    it is a suffix. So quotes meet suffixes of distinct words, not sources, and sources come by the words that were hit.
    """
    held = bodies.select("source_id", F.explode(F.array_distinct(F.split("b", " "))).alias("word")).where("word <> ''")
    suffixes = held.select("word").distinct().select("word", F.explode(F.transform(F.sequence(F.lit(1), F.char_length("word")), lambda i: F.substring("word", i, F.char_length("word")))).alias("suffix"))
    words = quotes.select("quote_id", F.split("q", " ").alias("w"))
    ones = words.where(F.size("w") == 1).select("quote_id", F.element_at("w", 1).alias("one")).withColumn("start", F.left("one", F.lit(3)))
    starts = suffixes.select("word", "suffix", F.explode(F.transform(F.sequence(F.lit(1), F.least(F.lit(3), F.char_length("suffix"))), lambda n: F.left("suffix", n))).alias("start"))
    within = ones.join(starts, "start").where(F.startswith("suffix", F.col("one"))).select("quote_id", "word")
    ends = words.where(F.size("w") == 2).select("quote_id", F.element_at("w", 1).alias("suffix")).join(suffixes, "suffix").select("quote_id", "word")
    return within.unionByName(ends).distinct().join(held, "word").select("quote_id", "source_id").distinct()


def grounded(quotes: DataFrame, sources: DataFrame) -> DataFrame:
    """(quote_id, source_id): the sources that contain a quote after folding case, punctuation and space.

    Quotes and sources meet on the quote's rarest word of the fold, so no quote is tried on every source;
    a quote without a word matches nothing. Quotes of one or two words meet the sources by parts of the sources' distinct words.
    """
    folded = quotes.select("quote_id", normalize_quote(F.col("quote")).alias("q")).where("q <> ''")
    bodies = sources.select("source_id", normalize_quote(F.col("body")).alias("b"))
    words = folded.select("quote_id", F.explode(F.array_distinct(F.split("q", " "))).alias("word"))
    held = bodies.select("source_id", F.explode(F.array_distinct(F.split("b", " "))).alias("word")).join(words.select("word").distinct(), "word", "left_semi")
    # a quote's first and last words may be parts of longer ones in the source: only inner words are sure to stand alone
    inner = folded.select("quote_id", F.explode(F.array_distinct(F.when(F.size(F.split("q", " ")) > 2, F.slice(F.split("q", " "), 2, F.size(F.split("q", " ")) - 2)).otherwise(F.array().cast("array<string>")))).alias("word"))
    df = held.groupBy("word").agg(F.count("*").alias("df"))
    rarest = inner.join(df, "word", "left").groupBy("quote_id").agg(F.min_by("word", F.struct(F.coalesce("df", F.lit(0)), "word")).alias("word"))
    by_word = rarest.join(held, "word").select("quote_id", "source_id")
    tried = by_word.unionByName(_short_quotes(folded.join(rarest, "quote_id", "left_anti"), bodies)).distinct()
    return tried.join(folded, "quote_id").join(bodies, "source_id").where(F.contains("b", F.col("q"))).select("quote_id", "source_id")


def statement_match(statements: DataFrame, bodies: DataFrame, words: int = STATEMENT_WORDS) -> DataFrame:
    """(statement_id, body_id, match): exact where the folded statement stands on the page, partial where any six of its words in a row do.

    Word runs meet by hash; a statement of fewer words matches nothing.
    """
    def runs(rows: DataFrame, key: str, c: str) -> DataFrame:
        hashes = F.transform(F.filter(F.split(c, " "), lambda x: x != ""), lambda x: F.xxhash64(x))
        at = [F.slice(hashes, F.lit(k + 1), F.greatest(F.size(hashes) - k, F.lit(0))).alias(f"w{k}") for k in range(words)]
        laid = rows.where(F.size(hashes) >= words).select(key, F.explode(F.arrays_zip(*at)).alias("r"))
        return laid.where(F.col(f"r.w{words - 1}").isNotNull()).select(key, F.xxhash64(*[F.col(f"r.w{k}") for k in range(words)]).alias("run")).distinct()

    said = statements.select("statement_id", normalize_statement(F.col("statement")).alias("s")).where("s <> ''")
    text = bodies.select("body_id", normalize_statement(F.col("body")).alias("t"))
    hits = runs(said, "statement_id", "s").join(runs(text, "body_id", "t"), "run").select("statement_id", "body_id").distinct()
    both = hits.join(said, "statement_id").join(text, "body_id")
    return both.select("statement_id", "body_id", F.when(F.contains("t", F.col("s")), "exact").otherwise("partial").alias("match"))


def count_findings(findings: dict[str, DataFrame]) -> DataFrame:
    """(kind, n): how many rows each named finding has, zeros included."""
    out = None
    for kind, rows in findings.items():
        one = rows.agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "n")
        out = one if out is None else out.unionByName(one)
    return out
