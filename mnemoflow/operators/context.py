"""Text for a prompt out of a bounded result list: grouped by kind of node, as detailed as the room allows, cut with its closing.

Items are cut to `most` before they meet in one row; everything after that is an expression over their list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S

#: The groups of nodes in their order, with title and tag, and the words that begin and end each form.
GROUPS = (
    ("semantic", "Semantic Knowledge", "knowledge"),
    ("episodic", "Episodes", "episode"),
    ("procedural", "Procedures", "procedure"),
    ("prospective", "Plans & Intentions", "plan"),
    ("emotional", "Emotional Context", "emotion"),
    ("hub", "Key Concepts (Hubs)", "hub"),
    ("other", "Other", "memory"),
)
RECALLED = {
    "xml": "The following memories were recalled through associative anchor activation. These are not keyword-search results — they were retrieved because semantic anchors in your memory network were activated by the current context.",
    "markdown": "The following memories were recalled through associative anchor activation.",
    "plain": "Recalled memories:",
}
RETRIEVED = "The following memory context was retrieved from previous conversations and may be relevant to the current query."
CLOSING = {"xml": "\n</memory_context>", "markdown": "\n\n*[Memory context truncated]*"}

#: Columns of items beside id, score and content, and what stands in where one is missing.
OPTIONAL = {"node_type": "string", "node_role": "string", "frontmatter": "string", "summary": "string", "depth": "string", "category": "string", "entities": "array<string>", "via": "array<string>", "source": "string"}


def escape_xml(s: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        s = F.replace(s, F.lit(a), F.lit(b))
    return s


def _list(items: DataFrame, most: int, least: float) -> DataFrame:
    """One row with `items`, the best ones of at least `least` that have content, in order, each with its place and group."""
    own = items.select("id", "score", "content", *(F.col(c).cast(k).alias(c) if c in items.columns else F.lit(None).cast(k).alias(c) for c, k in OPTIONAL.items()))
    names = [g for g, *_ in GROUPS[:-2]]
    group = F.when((F.col("node_role") == "hub") | (F.col("node_type") == "hub"), "hub").when(F.col("node_type").isin(*names), F.col("node_type")).otherwise("other")
    top = own.where((F.col("score") >= least) & (F.trim("content") != "")).orderBy(F.col("score").desc(), "id").limit(most)
    every = F.collect_list(F.struct((-F.col("score")).alias("o"), "id", "score", "content", *OPTIONAL, group.alias("group")))
    return top.withColumn("depth", F.coalesce("depth", F.lit("L2"))).agg(F.array_sort(every).alias("items"))


def detail_level(items: Column, threshold: int) -> Column:
    """full while all contents together are no longer than the threshold, summary up to twice that, else frontmatter."""
    total = F.aggregate(items, F.lit(0).cast("long"), lambda s, x: s + F.length(x["content"]))
    return F.when(total <= threshold, "full").when(total <= 2 * threshold, "summary").otherwise("frontmatter")


def _shown(x: Column, level: Column) -> Column:
    front = F.coalesce(x["frontmatter"], x["content"])
    named = F.when(F.size(x["entities"]) > 0, F.concat(F.lit("entities: "), F.array_join(x["entities"], ", ")))
    extra = F.concat_ws("; ", F.when(x["category"] != "", x["category"]), named)
    brief = F.when((level == "frontmatter") | (extra == ""), front).otherwise(F.concat(front, F.lit(" ("), extra, F.lit(")")))
    full = F.when(level == "frontmatter", F.coalesce(x["frontmatter"], x["summary"], x["content"])).when(level == "summary", F.coalesce(x["summary"], x["content"])).otherwise(x["content"])
    return F.when(x["depth"] == "L0", front).when(x["depth"] == "L1", brief).otherwise(full)


def _by_depth(x: Column) -> Column:
    """What the depth alone shows: frontmatter (with the metadata for L1), summary, or all."""
    front = F.coalesce(x["frontmatter"], x["content"])
    extra = _metadata(x)
    return F.when(x["depth"] == "L0", front).when(x["depth"] == "L1", F.when(extra == "", front).otherwise(F.concat(front, F.lit(" — "), extra))).when(x["depth"] == "L2", F.coalesce(x["summary"], x["content"])).otherwise(x["content"])


def _metadata(x: Column) -> Column:
    return F.concat_ws("; ", F.when(x["category"] != "", x["category"]), F.when(F.size(x["entities"]) > 0, F.concat(F.lit("entities: "), F.array_join(x["entities"], ", "))))


def _grouped(items: Column, head, line, tail) -> Column:
    """The lines of each group that has items: its head, a line for each, its tail."""
    lines = lambda g: F.filter(items, lambda x: x["group"] == g[0])
    parts = [F.when(F.size(lines(g)) > 0, F.concat(F.array(F.lit(head(g))), F.transform(lines(g), _line(line, g)), F.array(F.lit(tail(g))))).otherwise(F.array().cast("array<string>")) for g in GROUPS]
    return F.concat(*parts)


def _line(line, g):
    return lambda x: line(x, g)


def cut(text: Column, most: int, style: str, spare: int = 0) -> Column:
    """The text, or as much of it as fits with the closing of its form and `spare` places that stay free."""
    closing = CLOSING.get(style, "")
    closing = closing if most > len(closing) else ""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - len(closing) - spare), F.lit(closing))).otherwise(text)


def _finished(rows: DataFrame, text: Column, level: Column, most: int, style: str, spare: int) -> DataFrame:
    none = F.size("items") == 0
    return rows.select(F.when(none, "").otherwise(cut(text, most, style, spare)).alias("text"), F.size("items").alias("n_items"), (~none & (F.length(text) > most)).alias("truncated"), level.alias("detail"))


def recall_context(items: DataFrame, anchors: DataFrame | None = None, style: str = "xml", detail: str = "adaptive", most: int = 15, chars: int = 4000, threshold: int = 2000, least: float = 0.0, scores: bool = False, spare: int = 0) -> DataFrame:
    """One row (text, n_items, truncated, detail) of recalled items(id, score, content[, node_type, node_role, frontmatter, summary, depth, category,
    entities, via]) in the form xml, markdown or plain. anchors(label, similarity) are those that were activated, a bounded list; `via` holds
    the labels by which an item was found."""
    rows = _list(items, most, least)
    labels = anchors.orderBy(F.col("similarity").desc(), "label").limit(most).agg(F.array_sort(F.collect_list(F.struct((-F.col("similarity")).alias("o"), "label", "similarity"))).alias("anchors")) if anchors is not None else None
    rows = rows.join(F.broadcast(labels)) if labels is not None else rows.withColumn("anchors", F.array().cast("array<struct<o:double,label:string,similarity:double>>"))
    level = detail_level(F.col("items"), threshold) if detail == "adaptive" else F.lit(detail)
    rows = rows.withColumn("level", level)
    level, own, named = F.col("level"), F.col("items"), F.col("anchors")
    via = lambda x: F.array_join(x["via"], ", ")
    some = lambda x: F.coalesce(F.size(x["via"]) > 0, F.lit(False))
    fixed = lambda c, digits=3: S.fixed(c, digits)
    if style == "xml":
        def line(x: Column, g: tuple) -> Column:
            attrs = F.concat(F.lit(' depth="'), x["depth"], F.lit('"'), F.concat(F.lit(' score="'), fixed(x["score"]), F.lit('"')) if scores else F.lit(""), F.when(x["category"] != "", F.concat(F.lit(' category="'), escape_xml(x["category"]), F.lit('"'))).otherwise(""))
            shown = escape_xml(_shown(x, level))
            plain = F.concat(F.lit(f"  <{g[2]}"), attrs, F.lit(">"), shown, F.lit(f"</{g[2]}>"))
            wide = F.concat(F.lit(f"  <{g[2]}"), attrs, F.lit(">\n    <text>"), shown, F.lit("</text>\n    <via_anchors>"), escape_xml(via(x)), F.lit(f"</via_anchors>\n  </{g[2]}>"))
            return F.when(some(x), wide).otherwise(plain)

        one = lambda a: F.concat(F.lit('  <anchor label="'), escape_xml(a["label"]), F.lit('"'), F.concat(F.lit(' similarity="'), fixed(a["similarity"]), F.lit('"')) if scores else F.lit(""), F.lit(" />"))
        head = F.when(F.size(named) > 0, F.concat(F.array(F.lit("<activated_anchors>")), F.transform(named, one), F.array(F.lit("</activated_anchors>")))).otherwise(F.array().cast("array<string>"))
        lines = F.concat(F.array(F.lit("<memory_context>"), F.concat(F.lit("<preamble>"), escape_xml(F.lit(RECALLED["xml"])), F.lit("</preamble>"))), head, _grouped(own, lambda g: f"<{g[0]}>", line, lambda g: f"</{g[0]}>"), F.array(F.lit("</memory_context>")))
    elif style == "markdown":
        def line(x: Column, g: tuple) -> Column:
            marks = F.concat_ws(" | ", x["depth"], F.concat(F.lit("score: "), fixed(x["score"])) if scores else F.lit(None).cast("string"), F.when(some(x), F.concat(F.lit("via: "), via(x))))
            return F.concat(F.lit("- "), _shown(x, level), F.lit(" _("), marks, F.lit(")_"))

        one = lambda a: F.concat(a["label"], F.concat(F.lit(" ("), fixed(a["similarity"] * 100, 0), F.lit("%)"))) if scores else a["label"]
        head = F.when(F.size(named) > 0, F.array(F.concat(F.lit("**Activated anchors:** "), F.array_join(F.transform(named, one), ", ")), F.lit(""))).otherwise(F.array().cast("array<string>"))
        lines = F.concat(F.array(*map(F.lit, ("## Memory Context", "", RECALLED["markdown"], ""))), head, _grouped(own, lambda g: f"### {g[1]}", line, lambda g: ""))
    else:
        head = F.when(F.size(named) > 0, F.array(F.concat(F.lit("Anchors: "), F.array_join(F.transform(named, lambda a: a["label"]), ", ")), F.lit(""))).otherwise(F.array().cast("array<string>"))
        kind = lambda x: F.coalesce(x["node_type"], F.lit("other"))
        each = F.transform(own, lambda x, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] ("), F.upper(F.substring(kind(x), 1, 1)), F.substring(kind(x), 2, 1 << 20), F.lit("/"), x["depth"], F.lit(") "), _shown(x, level), F.concat(F.lit(" ["), fixed(x["score"] * 100, 0), F.lit("%]")) if scores else F.lit(""), F.when(some(x), F.concat(F.lit(" (via: "), via(x), F.lit(")"))).otherwise("")))
        lines = F.concat(F.array(F.lit(RECALLED["plain"]), F.lit("")), head, each)
    return _finished(rows, F.array_join(lines, "\n"), F.when(F.size(own) == 0, F.lit("full" if detail == "adaptive" else detail)).otherwise(level), chars, style, spare)


def node_context(items: DataFrame, style: str = "xml", most: int = 15, chars: int = 4000, least: float = 0.0, scores: bool = False, metadata: bool = False, spare: int = 0) -> DataFrame:
    """One row (text, n_items, truncated, detail) of merged items in the form xml, markdown or json: each item shows what its own depth holds."""
    rows, own = _list(items, most, least), F.col("items")
    fixed = lambda c: S.fixed(c, 3)
    has = lambda x: (_metadata(x) != "") if metadata else F.lit(False)
    if style == "xml":
        def line(x: Column, g: tuple) -> Column:
            attrs = F.concat(F.lit(' depth="'), x["depth"], F.lit('"'), F.concat(F.lit(' score="'), fixed(x["score"]), F.lit('"')) if scores else F.lit(""))
            shown = escape_xml(_by_depth(x))
            extra = F.concat(F.when(F.size(x["entities"]) > 0, F.concat(F.lit("\n      <entities>"), escape_xml(F.array_join(x["entities"], ", ")), F.lit("</entities>"))).otherwise(""), F.when(x["category"] != "", F.concat(F.lit("\n      <category>"), escape_xml(x["category"]), F.lit("</category>"))).otherwise(""))
            wide = F.concat(F.lit(f"  <{g[2]}"), attrs, F.lit(">\n    <text>"), shown, F.lit("</text>\n    <metadata>"), extra, F.lit(f"\n    </metadata>\n  </{g[2]}>"))
            return F.when(has(x) & (x["depth"] != "L0"), wide).otherwise(F.concat(F.lit(f"  <{g[2]}"), attrs, F.lit(">"), shown, F.lit(f"</{g[2]}>")))

        lines = F.concat(F.array(F.lit("<memory_context>"), F.concat(F.lit("<preamble>"), F.lit(RETRIEVED), F.lit("</preamble>"))), _grouped(own, lambda g: f"<{g[0]}>", line, lambda g: f"</{g[0]}>"), F.array(F.lit("</memory_context>")))
    elif style == "markdown":
        line = lambda x, g: F.concat(F.lit("- "), _by_depth(x), F.concat(F.lit(" (score: "), fixed(x["score"]), F.lit(")")) if scores else F.lit(""), F.lit(" `"), x["depth"], F.lit("`"), F.when(has(x), F.concat(F.lit("\n  > "), _metadata(x))).otherwise(""))
        lines = F.concat(F.array(*map(F.lit, ("## Memory Context", "", RETRIEVED, ""))), _grouped(own, lambda g: f"### {g[1]}", line, lambda g: ""))
    else:
        entry = lambda x: F.struct(_by_depth(x).alias("content"), x["depth"].alias("depthLevel"), x["node_type"].alias("nodeType"), F.when(x["frontmatter"] != "", x["frontmatter"]).alias("frontmatter"), F.when((x["depth"] != "L0") & (x["summary"] != ""), x["summary"]).alias("summary"), *([x["score"].alias("score")] if scores else []))
        group = lambda g: F.filter(own, lambda x: x["group"] == g)
        lines = F.array(F.to_json(F.struct(F.struct(*(F.when(F.size(group(g)) > 0, F.transform(group(g), entry)).alias(g) for g, *_ in GROUPS)).alias("memoryContext"))))
    return _finished(rows, F.array_join(lines, "\n"), F.lit("depth"), chars, style, spare)
