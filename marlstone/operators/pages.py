"""Maintenance of wiki pages: sources, domains, links, sections, claims and usage."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions import markup
from marlstone.functions.text import canonical_page_path, fold_key, slug
from marlstone.functions.udf import arrow_udf

FOLDERS = ("entities", "concepts", "sources")
KEEP_SHARE, KEEP_WORDS = 0.5, 4
SHRUNK_SHARE, SHRUNK_CHARS = 0.5, 400
LINK = re.compile(r"\[\[([^\]|#]+)(#[^\]|]*)?(?:\|([^\]]+))?\]\]")
FOOTNOTE = re.compile(r"\^\[[^\[\]\n]*\[\[([^\]|\n]+)(?:\|[^\]\n]*)?\]\][^\[\]\n]*\]")

# sources and vocabularies


def source_path(raw: Column, wiki_folder: str) -> Column:
    """A source entry in its one form: no brackets, display or extension; a path outside the wiki's folders becomes sources/ and its slug."""
    bare = F.trim(F.regexp_replace(F.trim(raw), r"^\[\[(.*)\]\]$", "$1"))
    bare = F.regexp_replace(F.trim(F.regexp_extract(bare, r"^([^|]*)", 1)), r"\.md$", "")
    inside = F.substring(bare, F.lit(len(wiki_folder) + 2), F.length(bare))
    own = F.lit(False)
    for f in FOLDERS:
        own = own | bare.startswith(f + "/")
    return F.when(bare == "", "").when(bare.startswith(wiki_folder + "/"), inside).when(own, bare).otherwise(F.concat(F.lit("sources/"), slug(F.element_at(F.split(bare, "/"), -1), True)))


def source_list(raw: Column, wiki_folder: str) -> Column:
    found = F.filter(F.transform(raw, lambda s: source_path(s, wiki_folder)), lambda s: s != "")
    return F.transform(F.array_distinct(found), lambda s: F.concat(F.lit("[["), s, F.lit("]]")))


def polluted_sources(raw: Column, wiki_folder: str) -> Column:
    """Whether any entry differs from its one form."""
    return F.exists(raw, lambda s: source_path(s, wiki_folder) != F.regexp_replace(F.regexp_replace(s, r"^\[\[", ""), r"\]\]$", ""))


def vocabulary(pages: DataFrame, *, slashed: bool = False) -> DataFrame:
    """(fold, tag): distinct tags of pages (path, pos, tags) whatever their case, spelled as first met; slashed keeps only tags of the form a/b."""
    tags = pages.select("path", "pos", F.posexplode("tags").alias("at", "tag")).withColumn("tag", F.trim("tag")).where("tag <> ''")
    tags = tags.where(F.contains("tag", F.lit("/"))) if slashed else tags
    return tags.groupBy(F.lower("tag").alias("fold")).agg(F.min_by("tag", F.struct("pos", "at")).alias("tag"))


def active_vocabulary(watched: DataFrame, wiki: DataFrame) -> DataFrame:
    """The watched folders' tags, and the wiki's that are not among them."""
    return watched.unionByName(wiki.join(watched.select("fold"), "fold", "left_anti"))


def select_domains(chosen: DataFrame, allowed: DataFrame) -> DataFrame:
    """chosen (id, tag) with the vocabulary's spelling, by equality or by the only tag with that value part; null if rejected."""
    vocab = allowed.select("tag", "fold", F.nullif(F.regexp_extract("fold", "/(.+)$", 1), F.lit("")).alias("part"))
    parts = vocab.where("part IS NOT NULL").groupBy("part").agg(F.min("tag").alias("by_part"), F.count("*").alias("n")).where("n = 1").select("part", "by_part")
    asked = chosen.withColumn("key", F.lower(F.trim("tag"))).withColumn("key_part", F.coalesce(F.nullif(F.regexp_extract("key", "/(.*)$", 1), F.lit("")), F.col("key")))
    exact = vocab.select(F.col("fold").alias("key"), F.col("tag").alias("exact"))
    return asked.join(exact, "key", "left").join(parts, F.col("key_part") == F.col("part"), "left").select("id", "tag", F.coalesce("exact", "by_part").alias("domain"))


def fold_to_vocabulary(values: DataFrame, allowed: DataFrame) -> DataFrame:
    """values (value) with the allowed tag that is equal, else equal but for case and accents; null without one."""
    keyed = allowed.select("tag", fold_key(F.col("tag")).alias("k")).groupBy("k").agg(F.min("tag").alias("folded"))
    out = values.withColumn("k", fold_key(F.col("value"))).join(keyed, "k", "left").join(allowed.select(F.col("tag").alias("same")), F.trim("value") == F.col("same"), "left")
    return out.select("value", F.coalesce("same", "folded").alias("tag"))


def provenance_marks(text: Column) -> Column:
    """Malformed source footnotes in the form ^[label: [[name]]]."""
    label, name = r"([^\[\]\n:]+)", r"([^\[\]\n]+?)"
    for pattern in (rf"(?:\^\[\[?|\[\^){label}:\s*\[\[{name}\]\]\]*", rf"\^\[\[{label}:\s*{name}\s*\]\]\]*", rf"\[\[{label}:\s*\[\[{name}\s*\]\]\]*\^*(?!\[)", rf"\[\[{label}:\s*{name}\s*\]\]\^+(?!\[)"):
        text = F.regexp_replace(text, pattern, r"^[$1: [[$2]]]")
    return text


# links


def same_page(a: Column, b: Column) -> Column:
    """Equal paths, or one the tail of the other, whatever the case."""
    x, y = canonical_page_path(a), canonical_page_path(b)
    return (a != "") & (b != "") & ((x == y) | x.endswith(F.concat(F.lit("/"), y)) | y.endswith(F.concat(F.lit("/"), x)))


def dead_link_targets(dead: DataFrame, pages: DataFrame) -> DataFrame:
    """dead (source, target) with the page that is meant: by title, alias, slug of the title or of an alias, first page in order, not the source itself if another fits.

    pages is (path, title, aliases, pos).
    """
    name = F.element_at(F.split("target", "/"), -1)
    titles = pages.select("path", "pos", F.col("title").alias("n"), F.lit(0).alias("kind"))
    aliases = pages.select("path", "pos", F.explode("aliases").alias("n"), F.lit(1).alias("kind"))
    names = titles.unionByName(aliases)
    keys = names.select("path", "pos", "kind", F.lower("n").alias("key")).unionByName(names.select("path", "pos", (F.col("kind") + 2).alias("kind"), F.concat(F.lit("slug:"), slug(F.col("n"))).alias("key")))
    asked = dead.select("source", "target", F.explode(F.array(F.lower(name), F.concat(F.lit("slug:"), slug(name)))).alias("key"))
    hits = asked.join(keys, "key").withColumn("own", same_page(F.col("source").cast("string"), F.col("path").cast("string")).cast("int"))
    best = hits.groupBy("source", "target").agg(F.min_by("path", F.struct("own", "kind", "pos")).alias("path"))
    return dead.join(best, ["source", "target"], "left")


def retarget(text: str, moves: dict[str, str]) -> tuple[str, int]:
    """A text whose links to a key of moves point to its value, and how many did; heading and display text stay."""
    count = 0

    def move(m: re.Match) -> str:
        nonlocal count
        to = moves.get(m[1].strip())
        if to is None:
            return m[0]
        count += 1
        return f"[[{to}{m[2] or ''}{'|' + m[3] if m[3] else ''}]]"

    return LINK.sub(move, text), count


@arrow_udf("struct<text:string,moved:int>")
def retargeted(text: pd.Series, moves: pd.Series) -> pd.DataFrame:
    """retarget for columns; moves is a map column."""
    return pd.DataFrame([retarget(t or "", dict(m or {})) for t, m in zip(text, moves)], columns=["text", "moved"])


def retarget_pages(pages: DataFrame, moves: DataFrame) -> DataFrame:
    """pages (path, content) with every link to an old target rewritten; moves is (old, new).  Pages without such links pass unread."""
    links = pages.select("path", F.explode(F.regexp_extract_all("content", F.lit(r"\[\[([^\]|#]+)"), 1)).alias("raw")).select("path", F.trim("raw").alias("old")).distinct()
    asked = links.join(moves, "old").groupBy("path").agg(F.map_from_entries(F.collect_list(F.struct("old", "new"))).alias("moves"))
    joined = pages.join(asked, "path", "left")
    changed = joined.where("moves IS NOT NULL").withColumn("r", retargeted(F.col("content"), F.col("moves"))).select("path", F.col("r.text").alias("content"), F.col("r.moved").alias("moved"))
    return changed.unionByName(joined.where("moves IS NULL").select("path", "content", F.lit(0).alias("moved")))


def folder_repoints(links: DataFrame, pages: DataFrame) -> DataFrame:
    """(old, new) of links whose folder disagrees with the only page of that name.  links is (target), pages (path)."""
    typed = links.select("target").distinct().where(F.col("target").rlike(r"^(entities|concepts|sources)/"))
    names = pages.select("path", slug(F.element_at(F.split("path", "/"), -1)).alias("key")).groupBy("key").agg(F.min("path").alias("path"), F.count("*").alias("n")).where("n = 1")
    return typed.withColumn("key", slug(F.element_at(F.split("target", "/"), -1))).join(names, "key").where("target <> path").select(F.col("target").alias("old"), F.col("path").alias("new"))


# sections


def sections(text: str) -> list[tuple[str, str]]:
    """(header, block) of a text's H2 sections; what precedes them has the header ''."""
    parts = re.split(r"(?m)^(?=##\s)", text)
    return [((re.match(r"##\s+(.+?)\s*$", p.split("\n", 1)[0]) or [None, ""])[1], p) for p in parts if p]


def snap(header: str, labels: list[str], most: int = 3) -> str | None:
    """The label of a header (an added parenthesis apart), or the only nearest within so many edits."""
    base = re.sub(r"\s*[(（][^()（）]*[)）]\s*$", "", header)
    if base in labels:
        return base

    def edits(a: str, b: str) -> int:
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    near = sorted((edits(base, x), x) for x in labels)
    return near[0][1] if near and near[0][0] <= most and (len(near) == 1 or near[1][0] > near[0][0]) else None


def canonical_headers(text: str, labels: list[str]) -> str:
    out = []
    for header, block in sections(text):
        label = snap(header, labels) if header else None
        out.append(block.replace(header, label + header[len(re.sub(r"\s*[(（][^()（）]*[)）]\s*$", "", header)) :], 1) if label else block)
    return "".join(out)


def known_sections(text: str, labels: list[str]) -> str:
    """The text without sections that are no label's."""
    return "".join(b for h, b in sections(text) if not h or snap(h, labels))


def preserve_sections(old: str, new: str, labels: list[str]) -> str:
    """new, with old sections that it lacks appended, and those it shrank below half (of 400 characters or more) put back."""
    before = {s: b for h, b in reversed(sections(old)) if h and (s := snap(h, labels))}
    body = lambda b: b.split("\n", 1)[1].strip() if "\n" in b else ""
    out, seen = [], set()
    for h, b in sections(new):
        label = snap(h, labels) if h else None
        if label and label not in seen:
            seen.add(label)
            was = before.get(label)
            if was and len(body(was)) >= SHRUNK_CHARS and len(body(b)) < SHRUNK_SHARE * len(body(was)):
                b = was if was.endswith("\n") else was + "\n"
        out.append(b)
    text = "".join(out)
    for label in labels:
        if label in before and label not in seen and body(before[label]):
            text = text.rstrip("\n") + "\n\n" + before[label].rstrip("\n") + "\n"
    return text


def first_heading_kept(old: str, new: str) -> str:
    """new with old's first H1 in place of its own, or in front."""
    def find(t: str) -> re.Match | None:
        bare = re.sub(r"(?ms)\A---\n.*?\n---|^(```|~~~).*?^\1", lambda m: re.sub(r"[^\n]", " ", m[0]), t)
        return re.search(r"(?m)^# .+$", bare)

    was, now = find(old), find(new)
    if not was:
        return new
    return new[: now.start()] + was[0] + new[now.end() :] if now else was[0] + "\n\n" + new


def preserve_paragraphs(old: str, new: str, current: str) -> str:
    """new with old's footnoted paragraphs of other sources that it lost put back after the paragraph they followed.

    A paragraph survives if one of the same section shares half of its words; those under four words are not guarded.
    """
    words = lambda p: set(re.findall(r"[^\W_]+", FOOTNOTE.sub("", p).lower()))
    named = lambda s: s.strip().split("/")[-1].removesuffix(".md").lower()
    split = lambda t: [(h, p) for h, b in sections(t) for p in re.split(r"\n\s*\n", b)]
    out = split(new)
    anchor = None
    for header, p in split(old):
        same = [k for k, (h, q) in enumerate(out) if h == header and (q == p or (words(p) and len(words(p) & words(q)) >= KEEP_SHARE * len(words(p))))]
        if same:
            anchor = same[0]
            continue
        others = {named(s) for s in FOOTNOTE.findall(p)} - {named(current)}
        if others and len(words(p)) >= KEEP_WORDS:
            at = anchor + 1 if anchor is not None else len(out)
            out.insert(at, (header, p.strip("\n")))
            anchor = at
    return "\n\n".join(p.strip("\n") for _, p in out) + "\n"


@arrow_udf("string")
def preserved(old: pd.Series, new: pd.Series, current: pd.Series) -> pd.Series:
    return pd.Series([preserve_paragraphs(*r) for r in zip(old.fillna(""), new.fillna(""), current.fillna(""))])


def mentions_block(mentions: DataFrame, most: int = 500) -> DataFrame:
    """(page, block): distinct quotes of mentions (page, quote, path, at) by time and path, as bullets within a size; a first one that is too long is cut."""
    once = mentions.groupBy("page", "quote").agg(F.min(F.struct("at", "path")).alias("m"))
    bullet = F.concat(F.lit('- "'), "quote", F.lit('" — [['), F.col("m.path"), F.lit("]]"))
    placed = once.select("page", "m", "quote", bullet.alias("b")).withColumn("n", F.row_number().over(Window.partitionBy("page").orderBy("m.at", "m.path", "quote")))
    used = F.sum(F.char_length("b") + 1).over(Window.partitionBy("page").orderBy("n")) - 1
    kept = placed.withColumn("used", used).where((F.col("used") <= most) | (F.col("n") == 1)).withColumn("b", F.when(F.char_length("b") > most, F.left("b", F.lit(most))).otherwise(F.col("b")))
    return kept.groupBy("page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "b"))), lambda s: s["b"]), "\n").alias("block"))


# pages and claims


def merge_front(old: DataFrame, incoming: DataFrame, today: Column) -> DataFrame:
    """Pages (path, fm) updated by incoming (path, source, tags): sources and tags united, created kept, updated today."""
    joined = old.join(incoming, "path")
    fm = F.col("fm")
    bare = F.transform(F.coalesce(fm["sources"], F.array().cast("array<string>")), lambda s: F.trim(F.regexp_replace(s, r"^\[\[(.*)\]\]$", "$1")))
    sources = F.transform(F.array_distinct(F.filter(F.concat(bare, F.array("source")), lambda s: s != "")), lambda s: F.concat(F.lit("[["), s, F.lit("]]")))
    changed = fm.withField("sources", sources).withField("tags", markup.folded_union(fm["tags"], joined["tags"])).withField("created", F.coalesce(fm["created"], today)).withField("updated", today)
    return joined.select("path", changed.alias("fm"))


def is_stub(fm: Column) -> Column:
    return F.lower(F.coalesce(fm["extra"]["stub"], F.lit("false"))) == "true"


def is_incomplete(fm: Column) -> Column:
    return F.lower(F.coalesce(fm["extra"]["generation_complete"], F.lit("true"))) == "false"


def deletable_stubs(pages: DataFrame) -> DataFrame:
    """Empty pages that nobody reviewed and that are no sources; pages is (path, fm, empty)."""
    return pages.where(F.col("empty") & ~F.coalesce(F.col("fm.reviewed"), F.lit(False)) & ~F.contains("path", F.lit("/sources/")))


def alias_deficient(pages: DataFrame) -> DataFrame:
    """Entity and concept pages with front matter but no alias, stubs apart; pages is (path, fm)."""
    named = F.contains("path", F.lit("/entities/")) | F.contains("path", F.lit("/concepts/"))
    return pages.where(named & F.col("fm").isNotNull() & (F.coalesce(F.size("fm.aliases"), F.lit(0)) <= 0) & ~is_stub(F.col("fm")))


def gate_claims(claims: DataFrame, matches: DataFrame) -> DataFrame:
    """claims (claim_id, statement) with verdict: a quoted statement that is not on the page is demoted, a partial one loses its quote."""
    out = claims.join(matches.select(F.col("statement_id").alias("claim_id"), "match"), "claim_id", "left")
    return out.select("claim_id", F.when(F.col("match") == "partial", F.lit(None).cast("string")).otherwise(F.col("statement")).alias("statement"), F.when(F.col("match").isNull(), "demoted").otherwise("kept").alias("verdict"))


def evidence_holds(evidence: Column, excerpt: Column, least: int = 4) -> Column:
    """A refusal counts only with evidence of four words or more that stands in the excerpt."""
    from marlstone.functions.text import normalize_quote

    return (F.size(F.split(normalize_quote(evidence), " ")) >= least) & F.contains(normalize_quote(excerpt), normalize_quote(evidence))


# usage and histories


def usage(calls: DataFrame) -> DataFrame:
    """(task, calls, millis) of calls (task, millis); a call without a task is untagged."""
    return calls.groupBy(F.coalesce("task", F.lit("untagged")).alias("task")).agg(F.count("*").alias("calls"), F.sum("millis").alias("millis"))


def usage_since(now: DataFrame, before: DataFrame) -> DataFrame:
    was = before.select("task", F.col("calls").alias("c"), F.col("millis").alias("m"))
    out = now.join(was, "task", "left").select("task", (F.col("calls") - F.coalesce("c", F.lit(0))).alias("calls"), (F.col("millis") - F.coalesce("m", F.lit(0))).alias("millis"))
    return out.where("calls > 0").orderBy(F.col("millis").desc(), "task")


def stale_folders(history: DataFrame, current: str) -> DataFrame:
    """One row (folders) of the wiki folders that answers (text) link to, if any is not the current one; else none."""
    found = history.select(F.explode(F.regexp_extract_all("text", F.lit(r"\[\[([^\]|/]+)/(?:entities|concepts|sources)/"), 1)).alias("folder"))
    seen = found.agg(F.array_sort(F.collect_set("folder")).alias("folders"))
    return seen.where(F.exists("folders", lambda f: f != current))


def wiki_counts(pages: DataFrame) -> DataFrame:
    return pages.agg(*[F.count_if(F.contains("path", F.lit(f"/{f}/"))).alias(f) for f in FOLDERS])


# constraints and related sections

RELATED_HEADINGS = ("related", "see also", "related pages", "related entities", "related concepts")


def constrained(fm: Column, page_type: str, allowed: list[str] | None, today: Column) -> Column:
    """Front matter as its type asks: the type set, tags once each and, given a vocabulary, only from it, dates stamped.

    A reviewed page only has its dates stamped.  A created date that is no date becomes today.
    """
    created = F.when(fm["created"].rlike(r"^\d{4}-\d{2}-\d{2}$"), fm["created"]).otherwise(today)
    dated = fm.withField("created", created).withField("updated", today)
    tags = markup.folded_union(fm["tags"], F.array().cast("array<string>"))
    if allowed is not None:
        tags = F.filter(tags, lambda t: t.isin(*allowed))
    aliases = F.filter(F.array_distinct(F.coalesce(fm["aliases"], F.array().cast("array<string>"))), lambda a: F.char_length(F.trim(a)) >= 2)
    full = dated.withField("type", F.lit(page_type)).withField("tags", tags).withField("aliases", aliases)
    return F.when(F.coalesce(fm["reviewed"], F.lit(False)), dated).otherwise(full)


def without_related(text: str, targets: set[str], wiki_folder: str = "wiki", headings: tuple[str, ...] = RELATED_HEADINGS) -> tuple[str, int]:
    """A text without the lines of its related sections that link to a target, and how many there were."""
    out, removed = [], 0
    for header, block in sections(text):
        if header.lower() not in headings:
            out.append(block)
            continue
        kept = []
        for line in block.split("\n"):
            if any(m[1].strip().removeprefix(wiki_folder + "/") in targets for m in LINK.finditer(line)):
                removed += 1
            else:
                kept.append(line)
        out.append("\n".join(kept))
    return "".join(out), removed


def display_restores(links: DataFrame, pages: DataFrame) -> DataFrame:
    """(source, target, display) of links that may be written as their display text alone: it is the last name or the title of the only page of that name.

    links is (source, target, display), pages (path, title).
    """
    by_name = pages.select(F.element_at(F.split("path", "/"), -1).alias("name"), "path").union(pages.select("title", "path")).distinct()
    only = by_name.groupBy("name").agg(F.min("path").alias("path"), F.count_distinct("path").alias("n")).where("n = 1").select("name", "path")
    return links.where("display IS NOT NULL").join(only, (F.col("display") == F.col("name")) & (F.col("target") == F.col("path"))).select("source", "target", "display")


def related_section(text: str, label: str, entries: list[str], most: int) -> str:
    """A text whose section of a label lists its own links and then new ones, each name once, at most so many; the section is added if it is missing."""
    own = next((b for h, b in sections(text) if h == label), "")
    names: dict[str, str] = {}
    for raw in [m[0] for m in LINK.finditer(own)] + [f"[[{e}]]" for e in entries]:
        names.setdefault(LINK.match(raw)[1].strip().split("/")[-1].lower(), raw)
    block = f"## {label}\n" + "".join(f"- {x}\n" for x in list(names.values())[:most])
    if not own:
        return text.rstrip("\n") + "\n\n" + block if names else text
    return "".join(block + ("\n" if own.endswith("\n\n") else "") if h == label else b for h, b in sections(text))
