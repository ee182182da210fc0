"""Reports, histories, model replies as side tables, related lists and parameter grids."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions import markup
from marlstone.functions.text import slug
from marlstone.operators import evaluation, retrieval
from marlstone.operators.corpus import FIELDS

#: Fixed values of the report format: what a section is about, by its heading; the first that fits.
SECTION_KINDS = (
    ("llmAnalysis", r"(?i)LLM\s*(分析|Analysis)"), ("tagViolation", r"(?i)标签越界|tag\s*(violations?|issues?)"), ("orphan", r"(?i)孤立页面?|orphan"), ("empty", r"(?i)空洞页面?|empty\s*(pages?|stubs?)"),
    ("duplicate", r"(?i)重复|duplicate"), ("deadLinks", r"(?i)断链|dead\s*links?"),
)
DEAD_BULLET = r"\[\[[^\]]+\]\][^\[]*→\s*\*\*[^*]+\*\*"
KEYWORDS, KEYWORD_WORDS = 10, 5
SHOWN = 20
SIBLINGS = 3
#: Schemas of model replies; a reply is parsed by them and never made up.
REPLY_SCHEMAS = {
    "keywords": "keywords array<string>",
    "seeds": "paths array<string>",
    "verdicts": "duplicates array<struct<target:string,source:string,reason:string>>",
    "analysis": "source_title string, summary string, entities array<struct<name:string,type:string,summary:string,aliases:array<string>,mentions:array<string>,coverage:string>>, concepts array<struct<name:string,type:string,summary:string,aliases:array<string>,mentions:array<string>,coverage:string>>, key_points array<string>",
    "triage": "strategy string, items array<string>",
    "stance": "verdict string, evidence string",
    "suggestion": "title string, rationale string, changes array<struct<section:string,text:string>>",
}


def section_kind(heading: Column, bullets: Column) -> Column:
    """Kind by heading, else dead links if four fifths of the bullets look like them."""
    out = None
    for kind, pattern in SECTION_KINDS:
        out = F.when(heading.rlike(pattern), kind) if out is None else out.when(heading.rlike(pattern), kind)
    hits = F.size(F.filter(bullets, lambda b: b.rlike(DEAD_BULLET)))
    return out.when((F.size(bullets) > 0) & (hits / F.greatest(F.size(bullets), F.lit(1)) >= 0.8), "deadLinks").otherwise("unknown")


def detail_row(line: Column) -> Column:
    """struct<is_bullet, links, text, raw> of a detail line."""
    raw = F.trim(line)
    text = F.trim(F.regexp_replace(F.regexp_replace(raw, markup.LINK.pattern, ""), r"\s{2,}", " "))
    return F.struct(raw.rlike(r"^\s*[-*+]\s+").alias("is_bullet"), markup.links(raw).alias("links"), text.alias("text"), raw.alias("raw"))


def history(entries: DataFrame, *, kind: str = "all", search: str = "", limit: int = 50) -> tuple[DataFrame, DataFrame]:
    """(the first `limit` entries of a kind that contain a text, newest first; one row with how many more there are).

    entries is (pos, kind, title, operation, pages, details); contradictions are ingests.
    """
    kept = entries if kind == "all" else entries.where(F.col("kind") == ("ingest" if kind == "contradictions" else kind))
    needle = F.lit(search.strip().lower())
    has = lambda c: F.contains(F.lower(F.coalesce(c, F.lit(""))), needle)
    kept = kept.where(has(F.col("title")) | has(F.col("operation")) | F.exists("pages", has) | F.exists("details", has)) if search.strip() else kept
    shown = kept.orderBy(F.col("pos").desc()).limit(limit)
    return shown, kept.agg(F.greatest(F.count("*") - limit, F.lit(0)).alias("more"))


def insight(kpi: Column) -> Column:
    """Severity of a maintenance entry from its counters."""
    n = lambda k: F.coalesce(kpi[k], F.lit(0))
    return F.when(n("dead_links") > 10, "high").when((n("dead_links") > 0) | (n("tag_violations") > 0) | (n("empty_pages") > 0), "medium").otherwise("low")


def shown_list(items: Column, most: int = SHOWN) -> Column:
    """The first items and, if there are more, a line that says how many."""
    more = F.size(items) - most
    return F.when(more > 0, F.concat(F.slice(items, 1, most), F.array(F.concat(F.lit("… "), more.cast("string"), F.lit(" more"))))).otherwise(items)


def lint_report(findings: DataFrame, duplicates: DataFrame) -> DataFrame:
    """findings (kind, path, detail) with flagged: whether the path is part of a duplicate pair (target, source)."""
    pairs = duplicates.select(F.explode(F.array("target", "source")).alias("path")).distinct().withColumn("flagged", F.lit(True))
    return findings.join(pairs, "path", "left").fillna(False, ["flagged"])


def report_counts(report: DataFrame) -> DataFrame:
    return report.groupBy("kind").agg(F.count("*").alias("n"), F.count_if("flagged").alias("in_duplicates"))


def parse_reply(reply: Column, name: str) -> Column:
    """A model reply by its schema: salvaged JSON; null fields where the reply lacks them."""
    return F.from_json(markup.salvaged(reply)["json"], REPLY_SCHEMAS[name])


def keywords(words: Column) -> Column:
    """Keywords of a reply: trimmed, of at most five words, each once whatever its case, ten at most."""
    good = F.filter(F.transform(words, lambda w: F.trim(w)), lambda w: (w != "") & (F.size(F.split(w, r"\s+")) <= KEYWORD_WORDS))
    low = F.transform(good, lambda w: F.lower(w))
    return F.slice(F.filter(good, lambda w, i: F.array_position(low, F.lower(w)) == i + 1), 1, KEYWORDS)


def verdict_pairs(verdicts: DataFrame, paths: DataFrame) -> DataFrame:
    """Distinct (target, source) of duplicate verdicts between known, different pages, whichever way round."""
    known = paths.select("path")
    fine = verdicts.where("target <> source").join(known.withColumnRenamed("path", "target"), "target", "left_semi").join(known.withColumnRenamed("path", "source"), "source", "left_semi")
    return fine.withColumn("a", F.least("target", "source")).withColumn("b", F.greatest("target", "source")).groupBy("a", "b").agg(F.min("target").alias("target")).select("target", F.when(F.col("target") == F.col("a"), F.col("b")).otherwise(F.col("a")).alias("source"))


def related_names(items: DataFrame, pages: DataFrame, *, siblings: int = SIBLINGS) -> DataFrame:
    """(source, name, related, how, place): each related name of extracted items resolved.

    items is (source, pos, name, related); a name is another item of its source, else the only page of that slug
    (path, title), else unanswered.  An item without any resolved name gets up to three siblings of its source.
    """
    own = items.select("source", F.col("name").alias("sibling"), slug(F.col("name")).alias("key"), F.col("pos").alias("at"))
    names = pages.select(slug(F.col("title")).alias("key"), "path").groupBy("key").agg(F.min("path").alias("path"), F.count("*").alias("n")).where("n = 1").select("key", "path")
    asked = items.select("source", "pos", "name", F.posexplode("related").alias("place", "r")).withColumn("key", slug(F.col("r"))).where(F.col("key") != slug(F.col("name")))
    found = asked.join(own.groupBy("source", "key").agg(F.min("sibling").alias("sibling")), ["source", "key"], "left").join(names, "key", "left")
    resolved = found.select("source", "pos", "name", F.coalesce("sibling", "path", "r").alias("related"), F.when(F.col("sibling").isNotNull(), "item").when(F.col("path").isNotNull(), "page").otherwise("unanswered").alias("how"), "place")
    resolved = resolved.dropDuplicates(["source", "name", "related"])
    lonely = items.select("source", "pos", "name").join(resolved.where("how <> 'unanswered'").select("source", "name"), ["source", "name"], "left_anti")
    near = lonely.join(own, "source").where("sibling <> name").withColumn("place", F.row_number().over(Window.partitionBy("source", "name").orderBy(F.abs(F.col("at") - F.col("pos")), "at")))
    return resolved.select("source", "name", "related", "how", "place").unionByName(near.where(F.col("place") <= siblings).select("source", "name", F.col("sibling").alias("related"), F.lit("sibling").alias("how"), "place"))


def weight_grid(terms: DataFrame, queries: DataFrame, truth: DataFrame, values: dict[str, tuple[float, ...]]) -> list[tuple[dict[str, float], float]]:
    """(field weights, mean reciprocal rank) of every combination, best first; one ranking for each of the few combinations."""
    out = []
    for combination in product(*(values.get(f, (1.0,)) for f in FIELDS)):
        weights = dict(zip(FIELDS, combination))
        ranked = retrieval.top_k(retrieval.bm25f(terms, queries, weights=weights, out_of_vocabulary=False), 50)
        out.append((weights, evaluation.summary(evaluation.recall_and_rank(ranked, truth)).first().mrr or 0.0))
    return sorted(out, key=lambda x: (-x[1], sorted(x[0].items())))


def pool_report(ranked: DataFrame, sources: DataFrame, window: int = 50, loaded: int = 10) -> DataFrame:
    """(query_id, window_sources, loaded_sources): how many sources the window holds and how many are loaded."""
    both = [evaluation.source_diversity(ranked, sources, k).select("query_id", F.col("sources").alias(n)) for k, n in ((window, "window_sources"), (loaded, "loaded_sources"))]
    return both[0].join(both[1], "query_id")


def contradiction_record(claims: DataFrame) -> DataFrame:
    """(file, text) of claims (page, claim, statement, source, date): a file name from page and date, and its text."""
    name = F.concat(F.col("date"), F.lit("-"), slug(F.col("page")), F.lit("-"), F.substring(F.sha2("claim", 256), 1, 6), F.lit(".md"))
    quote = F.when(F.col("statement").isNotNull(), F.concat(F.lit("\n> "), "statement")).otherwise("")
    return claims.select(name.alias("file"), F.concat(F.lit("# "), "page", F.lit("\n\n"), "claim", quote, F.lit("\n\nSource: [["), "source", F.lit("]]\n")).alias("text"))


def ordered_union(existing: Column, addition: Column) -> Column:
    """existing with the addition at its end, unless it is there whatever the case."""
    low = F.transform(existing, lambda x: F.lower(F.trim(x)))
    return F.when(F.array_contains(low, F.lower(F.trim(addition))), existing).otherwise(F.concat(existing, F.array(addition)))
