"""Tolerant parsing of model answers: JSON within fences or braces, read as VARIANT value by value; nothing raises.

A value of another kind than is wanted counts as missing, and an item that is no object is left out: neither touches the items beside it.
What an answer cannot be read as is null; a null or blank answer has no items.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Categories of facts, types of nodes, episodes and anchors, grades of importance, and the fence of an answer.
CATEGORIES = ("preference", "technical", "requirement", "decision", "context", "instruction", "knowledge", "relationship", "other")
NODE_TYPES = ("semantic", "episodic", "procedural", "prospective", "emotional")
ANCHOR_TYPES = ("entity", "topic", "temporal", "composite")
IMPORTANCE = ("high", "medium", "low")
FENCE = r"(?s)```(?:json)?\s*\n?(.*?)\n?\s*```"

#: What separates words and is trimmed: the white space of JSON's home language.
WHITE = "\t\n\x0b\x0c\r \xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
#: Metadata by type of node: texts, lists and shares.
METADATA = {
    "semantic": {"subject": "string", "predicate": "string", "object": "string"},
    "episodic": {"episodeType": "string", "actors": "array<string>", "outcome": "string"},
    "procedural": {"steps": "array<string>", "prerequisites": "array<string>"},
    "prospective": {"dueDate": "string", "priority": "string", "status": "string"},
    "emotional": {"emotion": "string", "trigger": "string", "intensity": "double"},
}


def trim(s: Column) -> Column:
    return F.btrim(s, F.lit(WHITE))


def blank(s: Column) -> Column:
    return s.isNull() | (trim(s) == "")


def once(value: Column, made: Callable[[Column], Column]) -> Column:
    """`made` of a value that is worked out once, however often it is named: within lambdas Spark shares no common parts."""
    return F.transform(F.array(value), made)[0]


def filled(s: Column) -> Column:
    """The trimmed text, or null where nothing is left."""
    return once(trim(s), lambda t: F.when(t != "", t))


# Values of an answer: a VARIANT is read by the kind that it has, so that a value of another kind spoils itself alone.
def at(v: Column, path: str) -> Column:
    return F.try_variant_get(v, f"$.{path}", "variant")


def kind(v: Column) -> Column:
    """STRING, BOOLEAN, VOID (null), BIGINT, DOUBLE, DECIMAL(..), ARRAY<..> or OBJECT<..>; null where there is no value."""
    return F.schema_of_variant(v)


def is_object(v: Column) -> Column:
    """Only an object is read as a map; its kind would name the kinds of all that is in it."""
    return F.try_variant_get(v, "$", "map<string,variant>").isNotNull()


def is_number(v: Column) -> Column:
    return F.coalesce(kind(v).rlike("^(BIGINT|DOUBLE|DECIMAL|FLOAT)"), F.lit(False))


def text(v: Column) -> Column:
    """A text; null for a value of another kind."""
    return once(v, lambda x: F.when(kind(x) == "STRING", F.try_variant_get(x, "$", "string")))


def number(v: Column) -> Column:
    return once(v, lambda x: F.when(is_number(x), F.try_variant_get(x, "$", "double")))


def scalar(v: Column) -> Column:
    """A text, number or truth value as text; null for what is missing, null or made of parts."""
    return F.when(~kind(v).rlike("^(OBJECT|ARRAY|VOID)"), F.try_variant_get(v, "$", "string"))


def as_number(v: Column) -> Column:
    """A number, or what a text, truth value or null counts as: a blank text, false and null 0, true 1; null for anything else."""
    s = trim(text(v))
    return F.when(is_number(v), number(v)).when(kind(v) == "VOID", 0.0).when(kind(v) == "BOOLEAN", F.try_variant_get(v, "$", "boolean").cast("double")).when(s == "", 0.0).otherwise(s.try_cast("double"))


def truthy(v: Column) -> Column:
    """Everything but false, null, 0, an empty text and what is missing."""
    k = kind(v)
    own = F.when(k == "BOOLEAN", F.try_variant_get(v, "$", "boolean")).when(k == "STRING", text(v) != "").when(k == "VOID", False).when(is_number(v), number(v) != 0).otherwise(True)
    return F.coalesce(F.when(k.isNotNull(), own), F.lit(False))


def each(v: Column) -> Column:
    """array<variant>: the items of a list; null for a value of another kind."""
    return F.try_variant_get(v, "$", "array<variant>")


def texts(v: Column, whole: bool = False) -> Column:
    """The texts of a list that are not blank, trimmed (`whole`: as they are); other items are left out, no list is an empty one."""
    own = F.filter(F.transform(each(v), text), lambda e: ~blank(e))
    return F.coalesce(own if whole else F.transform(own, trim), F.array().cast("array<string>"))


def fenced(raw: Column) -> Column:
    """What a fence holds, else the whole answer."""
    s, inner = trim(raw), trim(F.regexp_extract(trim(raw), FENCE, 1))
    return F.when(s.rlike(FENCE), inner).otherwise(s)


def json_part(raw: Column) -> Column:
    """The JSON of an answer: what a fence holds, else from the first brace or bracket to its last partner."""
    s, some = trim(raw), lambda c: F.when(c != "", c)
    braces, brackets = (some(F.regexp_extract(s, p, 0)) for p in (r"(?s)\{.*\}", r"(?s)\[.*\]"))
    list_first = F.regexp_extract(s, r"[\[{]", 0) == "["
    return F.when(s.rlike(FENCE), fenced(raw)).otherwise(F.coalesce(F.when(list_first, brackets), braces, brackets, s))


def unfenced(raw: Column) -> Column:
    """The answer without the fence that begins and that ends a line."""
    return trim(F.regexp_replace(F.regexp_replace(raw, r"(?m)^```(?:json)?\s*", ""), r"(?m)\s*```\s*$", ""))


def items(raw: Column, key: str) -> Column:
    """array<variant>: the answer's array, or the array under `key` of its object; null where it is neither or no JSON, empty where the
    answer is blank. Of an object that names a key twice nothing is read."""
    v = F.try_parse_json(json_part(raw))
    return F.when(blank(raw), F.array().cast("array<variant>")).otherwise(F.coalesce(F.when(is_object(v), each(at(v, key))), each(v)))


def one_of(s: Column, known: tuple[str, ...], other: str | None) -> Column:
    return once(F.lower(trim(s)), lambda own: F.when(own.isin(*known), own).otherwise(F.lit(other)))


def share(x: Column, other: float | None) -> Column:
    """x between 0 and 1; `other` for what is no number."""
    return once(x, lambda x: F.when(x.isNull() | F.isnan(x), F.lit(other).cast("double")).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))))


def _each(found: Column, keep: Callable[[Column], Column], made: Callable[[Column], Column]) -> Column:
    """`made` of the objects of a list that `keep` holds for; items that are no objects are left out."""
    return F.transform(F.filter(found, lambda x: is_object(x) & F.coalesce(keep(x), F.lit(False))), made)


def facts(raw: Column) -> Column:
    """array<struct> of the facts of an answer. A fact without content is left out; an unknown category is `other`, a missing
    confidence 0.5, entities are trimmed."""
    made = lambda f: F.struct(
        trim(text(at(f, "content"))).alias("content"), one_of(text(at(f, "category")), CATEGORIES, "other").alias("category"), share(number(at(f, "confidence")), 0.5).alias("confidence"),
        texts(at(f, "entities")).alias("entities"), *(filled(text(at(f, c))).alias(c) for c in ("subject", "predicate", "object")),
    )
    return _each(items(raw, "facts"), lambda f: ~blank(text(at(f, "content"))), made)


def nodes(raw: Column) -> Column:
    """array<struct> of the memory nodes of an answer: type (semantic if unknown), frontmatter and summary (each stands in for the
    other), keywords, and the metadata of its type; related entities join those of the metadata. One without both texts is left out."""
    front, summary = (lambda n, c=c: filled(text(at(n, c))) for c in ("frontmatter", "summary"))

    def made(n: Column) -> Column:
        return once(F.struct(one_of(text(at(n, "nodeType")), NODE_TYPES, "semantic").alias("kind"), at(n, "metadata").alias("m")), lambda own: node(n, own["kind"], own["m"]))

    def node(n: Column, kind_: Column, m: Column) -> Column:
        there = is_object(m)
        read = {"string": lambda v: filled(text(v)), "array<string>": texts, "double": lambda v: share(number(v), None)}
        own = [F.when((kind_ == t) & there, read[k](at(m, c))).alias(c) for t, fields in METADATA.items() for c, k in fields.items()]
        category = F.when(truthy(at(m, "category")), one_of(text(at(m, "category")), CATEGORIES, "other"))
        confidence = F.when(kind(at(m, "confidence")).isNotNull(), share(number(at(m, "confidence")), 0.5))
        named, related = texts(at(m, "entities")), texts(at(n, "relatedEntities"))
        entities = F.when(F.size(related) > 0, F.array_union(named, related)).otherwise(named)
        return F.struct(
            kind_.alias("node_type"), F.coalesce(front(n), F.substring(summary(n), 1, 80)).alias("frontmatter"), F.coalesce(summary(n), front(n)).alias("summary"), F.array_join(texts(at(n, "searchKeywords")), " ").alias("keywords"),
            F.struct(category.alias("category"), confidence.alias("confidence"), entities.alias("entities"), share(number(at(m, "salience")), None).alias("salience"), *own).alias("metadata"),
        )

    return _each(items(raw, "nodes"), lambda n: front(n).isNotNull() | summary(n).isNotNull(), made)


def episodes(raw: Column, last_turn: Column, kinds: tuple[str, ...]) -> Column:
    """array<struct> of the episodes of an answer, an array alone, by their first turn. One is left out whole unless its type is of
    `kinds`, title, description and an actor are given, and its turns are whole numbers in order, from 0 to last_turn."""
    start, end = (lambda e, c=c: number(at(e, c)) for c in ("startTurnIndex", "endTurnIndex"))
    whole = lambda x: (F.floor(x) == x) & (x >= 0)
    actors = lambda e: texts(at(e, "actors"), True)
    keep = lambda e: text(at(e, "type")).isin(*kinds) & ~blank(text(at(e, "title"))) & ~blank(text(at(e, "description"))) & whole(start(e)) & whole(end(e)) & (start(e) <= end(e)) & (end(e) <= last_turn) & (F.size(actors(e)) > 0)
    made = lambda e: F.struct(start(e).cast("long").alias("start_turn"), end(e).cast("long").alias("end_turn"), text(at(e, "type")).alias("type"), *(trim(text(at(e, c))).alias(c) for c in ("title", "description")), actors(e).alias("actors"), filled(text(at(e, "outcome"))).alias("outcome"))
    part = F.regexp_replace(F.regexp_replace(trim(raw), r"^```(?:json)?\s*\n?", ""), r"\n?```\s*$", "")
    return F.array_sort(_each(each(F.try_parse_json(part)), keep, made), lambda a, b: F.when(a["start_turn"] < b["start_turn"], -1).when(a["start_turn"] > b["start_turn"], 1).otherwise(0))


def summaries(raw: Column) -> Column:
    """array<struct<id, frontmatter, summary>>: texts stand in for each other; one without an id or both texts is left out."""
    own = lambda s, c: filled(text(at(s, c)))
    made = lambda s: F.struct(own(s, "id").alias("id"), F.coalesce(own(s, "frontmatter"), own(s, "summary")).alias("frontmatter"), F.coalesce(own(s, "summary"), own(s, "frontmatter")).alias("summary"))
    return _each(items(raw, "summaries"), lambda s: own(s, "id").isNotNull() & (own(s, "frontmatter").isNotNull() | own(s, "summary").isNotNull()), made)


def frontmatter(raw: Column, content: Column) -> Column:
    """struct of label (80 characters at most), category, keywords (10 at most, each once), domain, importance and summary; what is
    missing or of another kind comes from the fact's content."""
    v = F.try_parse_json(json_part(raw))
    f = at(v, "frontmatter")
    label = F.substring(F.coalesce(filled(text(at(f, "label"))), F.when(content != "", content), F.lit("Untitled fact")), 1, 80)
    keywords = F.slice(F.array_distinct(F.transform(texts(at(f, "keywords")), F.lower)), 1, 10)
    return F.struct(label.alias("label"), one_of(text(at(f, "category")), CATEGORIES, "other").alias("category"), keywords.alias("keywords"), F.lower(filled(text(at(f, "domain")))).alias("domain"), one_of(text(at(f, "importance")), IMPORTANCE, None).alias("importance"), F.coalesce(filled(text(at(v, "summary"))), content, F.lit("")).alias("summary"))


def decision(raw: Column, known: Column) -> Column:
    """struct<connect, create>: links to known anchor ids only (weight 0.5 if none is given), and new anchors with label and description
    (type `topic` if unknown). Both are empty where the answer, fenced or whole, is no object."""
    v = F.try_parse_json(fenced(raw))
    connect = _each(each(at(v, "connect")), lambda c: F.array_contains(known, text(at(c, "anchorId"))), lambda c: F.struct(text(at(c, "anchorId")).alias("anchor_id"), share(number(at(c, "weight")), 0.5).alias("weight"), text(at(c, "reason")).alias("reason")))
    own = lambda c, n: filled(text(at(c, n)))
    aliases = lambda c: F.filter(F.transform(each(at(c, "aliases")), text), lambda a: a.isNotNull())
    create = _each(each(at(v, "create")), lambda c: own(c, "label").isNotNull() & own(c, "description").isNotNull(), lambda c: F.struct(own(c, "label").alias("label"), own(c, "description").alias("description"), _anchor_type(text(at(c, "anchorType"))).alias("anchor_type"), F.when(F.size(aliases(c)) > 0, aliases(c)).alias("aliases"), share(number(at(c, "weight")), None).alias("weight")))
    return F.struct(F.coalesce(connect, F.array()).alias("connect"), F.coalesce(create, F.array()).alias("create"))


def _anchor_type(s: Column) -> Column:
    return F.when(s.isin(*ANCHOR_TYPES), s).otherwise("topic")


def judgment(raw: Column, known: Column) -> Column:
    """struct<isolated, decisions> with links to known anchors only and new anchors that have a label; strengths between 0 and 1, 0.5
    for what counts as no number. Null where the answer, without its fence, is neither object nor list."""
    v = F.try_parse_json(unfenced(raw))
    action = lambda d: text(at(d, "action"))
    link = lambda d: F.coalesce((action(d) == "connect") & F.array_contains(known, scalar(at(d, "anchorId"))), F.lit(False))
    new = lambda d: F.coalesce((action(d) == "create") & ~blank(scalar(at(d, "label"))), F.lit(False))
    made = lambda d: F.struct(action(d).alias("action"), F.when(link(d), scalar(at(d, "anchorId"))).alias("anchor_id"), F.when(new(d), trim(scalar(at(d, "label")))).alias("label"), F.when(new(d), _anchor_type(scalar(at(d, "anchorType")))).alias("anchor_type"), share(as_number(at(d, "strength")), 0.5).alias("strength"))
    decisions = F.coalesce(_each(each(at(v, "decisions")), lambda d: link(d) | new(d), made), F.array())
    return F.when(kind(v).rlike("^(OBJECT|ARRAY)"), F.struct(truthy(at(v, "isolated")).alias("isolated"), decisions.alias("decisions")))


def rerank_scores(raw: Column, known: Column) -> Column:
    """array<struct<id, relevance>> of the candidates that an answer scores; what is no number counts 0, unknown ids are left out. Null
    where the answer, without its fence, is neither object nor list."""
    v = F.try_parse_json(unfenced(raw))
    made = lambda s: F.struct(scalar(at(s, "id")).alias("id"), share(as_number(at(s, "relevance")), 0.0).alias("relevance"))
    found = _each(each(at(v, "scores")), lambda s: F.array_contains(known, scalar(at(s, "id"))), made)
    return F.when(kind(v).rlike("^(OBJECT|ARRAY)"), F.coalesce(found, F.array()))


#: Categories of concepts.
CONCEPT_CATEGORIES = ("technology", "architecture", "domain", "methodology", "preference", "project", "platform", "standard", "other")


def concepts(raw: Column) -> Column:
    """array<struct<name, description, aliases, category, relevance, related>> of the concepts of an answer, in its order; empty where it
    cannot be read. One without name, description (a text, blank even) or relevance is left out."""
    v = F.try_parse_json(fenced(raw))
    keep = lambda c: ~blank(text(at(c, "name"))) & text(at(c, "description")).isNotNull() & number(at(c, "relevance")).isNotNull()
    category = lambda c: F.when(text(at(c, "category")).isin(*CONCEPT_CATEGORIES), text(at(c, "category"))).otherwise("other")
    made = lambda c: F.struct(trim(text(at(c, "name"))).alias("name"), trim(text(at(c, "description"))).alias("description"), texts(at(c, "aliases")).alias("aliases"), category(c).alias("category"), share(number(at(c, "relevance")), 0.0).alias("relevance"), texts(at(c, "relatedConcepts")).alias("related"))
    return F.coalesce(_each(each(at(v, "concepts")), keep, made), F.array())


def heuristic_judgment(candidates: Column, label: Column, least: float = 0.6, strength: float = 0.5) -> Column:
    """struct<isolated, decisions> without a model, of candidates array<struct<anchor_id, similarity>>: links to all that are similar
    enough, else a new anchor of that label, if there is one."""
    links = F.transform(F.filter(candidates, lambda c: c["similarity"] >= least), lambda c: F.struct(F.lit("connect").alias("action"), c["anchor_id"].cast("string").alias("anchor_id"), F.lit(None).cast("string").alias("label"), F.least(c["similarity"].cast("double"), F.lit(1.0)).alias("strength")))
    new = F.array(F.struct(F.lit("create").alias("action"), F.lit(None).cast("string").alias("anchor_id"), filled(label).alias("label"), F.lit(strength).alias("strength")))
    made = F.when(F.size(links) > 0, links).when(~blank(label), new).otherwise(F.slice(new, 1, 0))
    return F.struct((F.size(made) == 0).alias("isolated"), made.alias("decisions"))
