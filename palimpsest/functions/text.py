"""Text functions as Columns: keys, gates, taggers and set similarities. No Python runs per row."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from palimpsest.functions import lexicon as L


def _any(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def statement_key(c: Column) -> Column:
    """Trimmed, lower case, white space collapsed, closing punctuation stripped."""
    return F.rtrim(F.regexp_replace(F.trim(F.lower(c)), r"\s+", " "), F.lit(" .!?,;:"))


def mention_key(c: Column) -> Column:
    return F.regexp_replace(F.trim(F.lower(c)), r"\s+", " ")


def alnum_key(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def slug(c: Column, fallback: str = "untitled", size: int = 48) -> Column:
    s = F.regexp_replace(F.lower(F.trim(c)), "[^a-z0-9]+", "-")
    s = F.trim(s, F.lit("-"))
    return F.coalesce(F.nullif(F.rtrim(F.substring(s, 1, size), F.lit("-")), F.lit("")), F.lit(fallback))


def source_system(c: Column) -> Column:
    return F.coalesce(F.nullif(F.split_part(F.coalesce(c, F.lit("")), F.lit(":"), F.lit(1)), F.lit("")), F.lit("unknown"))


def source_not_in(c: Column, systems: Sequence[str]) -> Column:
    """Whether the source system is none of these; null (so not kept by a filter) without a source."""
    return ~F.split_part(c, F.lit(":"), F.lit(1)).isin(*systems)


def lacks_prefix(c: Column, prefix: str) -> Column:
    return ~F.startswith(F.coalesce(c, F.lit("")), F.lit(prefix))


def differs(a: Column, b: Column) -> Column:
    """Whether two values differ, null being a value."""
    return ~a.eqNullSafe(b)


def short_type(c: Column, prefix: str) -> Column:
    """An event type without its prefix."""
    return F.when(F.startswith(c, F.lit(prefix)), F.substring(c, F.lit(len(prefix) + 1), F.length(c))).otherwise(c)


def event_group(c: Column, groups: dict[str, str], prefix: str = "") -> Column:
    """The group of an event type, short or with its prefix, from a closed catalogue; an error for a type that isn't in it, null for null."""
    known = F.create_map(*[F.lit(x) for pair in groups.items() for x in pair])
    short = short_type(c, prefix)
    found = F.try_element_at(known, short)
    return F.when(c.isNotNull() & found.isNull(), F.raise_error(F.concat(F.lit("event type not in the catalogue: "), short)).cast("string")).otherwise(found)


def nested_prefix(c: Column, skip: int = 5) -> Column:
    return F.split_part(F.substring(c, skip + 1, 1 << 20), F.lit("/"), F.lit(1))


def scope_level(c: Column) -> Column:
    return F.when(F.contains(c, F.lit(":")), F.split_part(c, F.lit(":"), F.lit(1))).otherwise(F.lit("user"))


def scope_ident(c: Column) -> Column:
    return F.when(F.contains(c, F.lit(":")), F.substring(c, F.instr(c, ":") + 1, F.length(c))).otherwise(c)


def predicate_name(c: Column, aliases: dict[str, str] | None = None) -> Column:
    """In snake case, without has_ and is_, renamed by `aliases`."""
    s = F.replace(F.replace(F.lower(F.trim(c)), F.lit(" "), F.lit("_")), F.lit("-"), F.lit("_"))
    s = F.replace(F.replace(s, F.lit("has_"), F.lit("")), F.lit("is_"), F.lit(""))
    if not aliases:
        return s
    table = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair])
    return F.coalesce(F.try_element_at(table, s), s)


def predicate_class(c: Column, identity: Sequence[str] = ()) -> Column:
    """identity for the names given, else the first class with a part of the name, else fact."""
    p = F.lower(F.coalesce(c, F.lit("")))
    out = F.when(p.isin(*identity), "identity") if identity else F
    for name, parts in L.PREDICATE_CLASSES:
        out = out.when(_any(F.contains(p, F.lit(x)) for x in parts), name)
    return out.otherwise("fact")


def entity_label(c: Column) -> Column:
    table = F.create_map(*[F.lit(x) for label in L.ENTITY_LABELS for x in (label.lower(), label)])
    return F.coalesce(F.try_element_at(table, F.lower(F.trim(F.coalesce(c, F.lit(""))))), F.lit("Other"))


def strip_scaffolding(c: Column, tags: Sequence[str] = L.SCAFFOLD_TAGS) -> Column:
    names = "|".join(map(re.escape, tags))
    s = F.regexp_replace(c, rf"(?is)<({names})\b[^>]*>.*?</\1\s*>", "")
    return F.trim(F.regexp_replace(s, rf"(?i)</?({names})\b[^>]*>", ""))


def is_trivial_turn(c: Column, least: int = 12, most: int = 120) -> Column:
    s = F.regexp_replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"^\s+", ""), r"\s+$", "")
    only = s.rlike(rf"(?i)^[\s\W]*(?:(?:{L.ACKNOWLEDGEMENTS})[\s\W]*)+$")
    return (F.length(s) < least) | ((F.length(s) <= most) & only)


def is_entity_shaped(c: Column) -> Column:
    s = F.trim(c)
    return (F.length(s) > 2) & (F.length(s) <= 40) & (F.size(F.split(s, r"\s+")) <= 4)


def tokens(c: Column, least: int = 1, stop: Sequence[str] = ()) -> Column:
    """Words of a-z of at least `least` letters, in order; other characters part them."""
    words = F.split(F.lower(F.coalesce(c, F.lit(""))), "[^a-z]+")
    kept = F.filter(words, lambda w: F.length(w) >= least)
    return F.filter(kept, lambda w: ~w.isin(*stop)) if stop else kept


def word_set(c: Column, least: int = 1, stop: Sequence[str] = ()) -> Column:
    return F.array_distinct(tokens(c, least, stop))


def top_words(c: Column, n: int = 5, least: int = 3, stop: Sequence[str] = ()) -> Column:
    """The n most frequent words, ties by first occurrence."""
    words = tokens(c, least, stop)
    counted = F.transform(F.array_distinct(words), lambda w: F.struct((-F.size(F.filter(words, lambda x: x == w))).alias("n"), F.array_position(words, w).alias("at"), w.alias("w")))
    return F.transform(F.slice(F.array_sort(counted), 1, n), lambda s: s["w"])


def has_any(c: Column, keywords: Sequence[str]) -> Column:
    """Whether any keyword is a substring of the lower-case text."""
    text = F.lower(F.coalesce(c, F.lit("")))
    return _any(F.contains(text, F.lit(k)) for k in keywords)


def hits(c: Column, keywords: Sequence[str]) -> Column:
    """How many of the keywords occur as substrings."""
    text = F.lower(F.coalesce(c, F.lit("")))
    return reduce(lambda a, b: a + b, (F.contains(text, F.lit(k)).cast("int") for k in keywords))


def mood(c: Column, positive=L.POSITIVE_WORDS, negative=L.NEGATIVE_WORDS, high=L.HIGH_ENERGY_WORDS, low=L.LOW_ENERGY_WORDS) -> Column:
    """Struct of mood, valence and energy."""
    p, n, h, l = (hits(c, words).cast("double") for words in (positive, negative, high, low))
    valence = F.when(p + n > 0, F.round((p - n) / (p + n), 2)).otherwise(0.0)
    energy = F.when(h + l > 0, F.round(0.5 + (h - l) / (h + l) * 0.4, 2)).otherwise(0.5)
    valence, energy = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), valence)), F.greatest(F.lit(0.0), F.least(F.lit(1.0), energy))
    label = (
        F.when((valence >= 0.3) & (energy >= 0.6), "energetic")
        .when((valence >= 0.3) & (energy < 0.4), "calm")
        .when((valence <= -0.3) & (energy >= 0.6), "anxious")
        .when((valence <= -0.3) & (energy < 0.4), "tired")
        .when(valence <= -0.3, "sad")
        .when(energy >= 0.7, "focused")
        .when(energy < 0.3, "sleepy")
        .otherwise("neutral")
    )
    return F.struct(label.alias("mood"), valence.alias("valence"), energy.alias("energy"))


def has_keyword(c: Column, keyword: str) -> Column:
    """As a whole word; phrases and hyphenated keywords as substrings."""
    text = F.lower(F.coalesce(c, F.lit("")))
    if " " in keyword or "-" in keyword:
        return F.contains(text, F.lit(keyword))
    return text.rlike(rf"(?<![\p{{L}}\p{{N}}_]){re.escape(keyword)}(?![\p{{L}}\p{{N}}_])")


def route(c: Column, areas: Sequence[tuple[str, str, Sequence[str]]] = L.LIFE_AREAS, default: str = L.DEFAULT_AREA[1]) -> Column:
    """The slug of the first area with a keyword in the text."""
    out = F
    for _, name, keywords in areas:
        out = out.when(_any(has_keyword(c, k) for k in keywords), name)
    return out.otherwise(default)


def route_project(area: Column, title: Column, text: Column) -> Column:
    """The theme project of the area that the text matches, else one named after the title."""
    out = F
    for a, _, name, keywords in L.PROJECT_THEMES:
        out = out.when((area == a) & _any(has_keyword(text, k) for k in keywords), name)
    return out.otherwise(slug(title))


def intent(c: Column) -> Column:
    out = F
    for name, phrases in L.INTENTS:
        out = out.when(has_any(F.concat(F.lit(" "), c, F.lit(" ")), phrases), name)
    return out.otherwise("none")


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets; 1 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def overlap_of_first(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.greatest(F.size(a), F.lit(1))


def overlap_of_least(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b)) / F.greatest(F.least(F.size(a), F.size(b)), F.lit(1))


def share_contained(response: Column, expected: Column) -> Column:
    """Share of the expected strings that the response contains, whatever the case."""
    text = F.lower(F.coalesce(response, F.lit("")))
    found = F.size(F.filter(expected, lambda x: F.contains(text, F.lower(x))))
    return F.when(F.size(expected) == 0, 0.0).otherwise(found / F.size(expected))


def decisions(c: Column, verbs: str = L.DECISION_VERBS, least: int = 3) -> Column:
    """What was decided: array of the spans behind a decision verb."""
    found = F.transform(F.regexp_extract_all(c, F.lit(rf"(?i)(?:{verbs})\s+(.+?)(?:\.|,|;|$)"), F.lit(1)), lambda x: F.trim(x))
    return F.filter(found, lambda x: F.length(x) >= least)


def triples(c: Column) -> Column:
    """Array of subject, predicate, object by the two patterns for "uses" and "is"; spans that aren't entity-shaped are dropped."""

    def found(pattern: str, predicate: str, last: int) -> Column:
        pairs = F.arrays_zip(F.regexp_extract_all(c, F.lit(pattern), F.lit(1)).alias("s"), F.regexp_extract_all(c, F.lit(pattern), F.lit(last)).alias("o"))
        return F.transform(pairs, lambda x: F.struct(F.trim(x["s"]).alias("subject"), F.lit(predicate).alias("predicate"), F.trim(x["o"]).alias("object")))

    good = lambda x: is_entity_shaped(x["subject"]) & is_entity_shaped(x["object"])
    return F.concat(F.filter(found(L.USES_PATTERN, "uses", 3), good), F.filter(found(L.IS_PATTERN, "is", 2), lambda x: good(x) & ~F.lower(x["subject"]).isin(*L.NO_SUBJECTS)))


def self_facts(c: Column, patterns: Sequence[tuple[str, str, str]] = L.SELF_PATTERNS) -> Column:
    """What a speaker says of themselves: array of predicate, object, tag; of objects that are equal but for case the first of a predicate."""

    def found(pattern: str, predicate: str, tag: str) -> Column:
        fact = lambda x: F.struct(F.lit(predicate).alias("predicate"), x.alias("object"), F.lit(tag).alias("tag"))
        if predicate == "has_property":
            pairs = F.arrays_zip(F.regexp_extract_all(c, F.lit(pattern), F.lit(1)).alias("k"), F.regexp_extract_all(c, F.lit(pattern), F.lit(2)).alias("v"))
            return F.transform(pairs, lambda x: fact(F.concat(F.lower(F.trim(x["k"])), F.lit(": "), F.trim(x["v"]))))
        return F.transform(F.regexp_extract_all(c, F.lit(pattern), F.lit(1)), lambda x: fact(F.rtrim(F.trim(x), F.lit("."))))

    every = F.filter(F.concat(*[found(*p) for p in patterns]), lambda x: F.length(x["object"]) > 1)
    key = lambda x: F.concat(x["predicate"], F.lit(":"), F.lower(x["object"]))
    keys = F.transform(every, key)
    return F.filter(every, lambda x, k: F.array_position(keys, key(x)) == k + 1)


def reported_facts(c: Column, most: int = 3, patterns: Sequence[tuple[str, str]] = L.REPORT_PATTERNS) -> Column:
    """What a delegated run reports: array of kind, statement, the first `most` of more than five characters."""

    def found(pattern: str, kind: str) -> Column:
        return F.transform(F.regexp_extract_all(c, F.lit(pattern), F.lit(1)), lambda x: F.struct(F.lit(kind).alias("kind"), F.substring(F.rtrim(F.trim(x), F.lit(".")), 1, 300).alias("statement")))

    return F.slice(F.filter(F.concat(*[found(*p) for p in patterns]), lambda x: F.length(x["statement"]) > 5), 1, most)


def turn_text(n: Column, user: Column, assistant: Column) -> Column:
    """A turn as an episode; null if both sides are too short to keep."""
    u, a = F.coalesce(user, F.lit("")), F.coalesce(assistant, F.lit(""))
    said = F.concat(F.lit("[turn "), n.cast("string"), F.lit("] User: "), F.substring(u, 1, 800), F.lit("\n\nAssistant: "), F.substring(a, 1, 1200))
    return F.when((F.length(u) >= 20) | (F.length(a) >= 50), F.substring(said, 1, 3000))


def title_of(words: Column) -> Column:
    """A title from a text's most frequent words."""
    return F.initcap(F.array_join(words, " "))


def label_keywords(c: Column, stop: Sequence[str] = L.GOAL_STOP_WORDS) -> Column:
    """What a label is about: its words of at least four letters that aren't generic."""
    return word_set(c, 4, stop)


def snippets(c: Column, verbs: Sequence[str] = L.GOAL_VERBS, size: int = 60) -> Column:
    """For each verb that the text has, what stands from its first place on."""
    low = F.lower(F.coalesce(c, F.lit("")))
    every = F.array(*[F.when(F.contains(low, F.lit(v)), F.trim(F.substring(low, F.instr(low, v), F.lit(size)))) for v in verbs])
    return F.filter(every, lambda x: F.length(x) > 0)


def is_transcript(c: Column) -> Column:
    """Whether what should be a short value is a piece of a transcript."""
    return _any(F.contains(c, F.lit(m)) for m in L.TRANSCRIPT_MARKS) | (F.length(c) > L.LONGEST_VALUE)


def is_counted_principle(c: Column) -> Column:
    """Whether a principle only says how often a word occurs."""
    return c.rlike(L.COUNTED_PRINCIPLE)


def exact_match(response: Column, expected: Column) -> Column:
    """1 if the response equals one of the expected strings, but for white space at the ends."""
    return F.when(F.array_contains(F.transform(expected, lambda x: F.trim(x)), F.trim(F.coalesce(response, F.lit("")))), 1.0).otherwise(0.0)


def web_match(c: Column, query: str) -> Column:
    """Whether a text matches a query as people type them: words and "phrases" that must occur, `or` between alternatives, - before what must not."""
    words = F.concat(F.lit(" "), F.array_join(F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), "[^a-z]+"), lambda w: F.length(w) > 0), " "), F.lit(" "))
    groups: list[list[Column]] = []
    join = False
    for minus, phrase, word in re.findall(r'(-?)(?:"([^"]*)"|(\S+))', query):
        if word.lower() == "or" and not minus:
            join = bool(groups)
            continue
        wanted = " ".join(re.findall("[a-z]+", (phrase or word).lower()))
        if not wanted:
            continue
        has = F.contains(words, F.lit(f" {wanted} "))
        has = ~has if minus else has
        if join:
            groups[-1].append(has)
        else:
            groups.append([has])
        join = False
    return reduce(lambda a, b: a & b, (_any(g) for g in groups), F.lit(True)) if groups else F.lit(False)


def ellipsis(c: Column, most: int = 120) -> Column:
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most - 3), F.lit("..."))).otherwise(c)


def token_estimate(c: Column) -> Column:
    return (F.floor(F.length(c) / 4) + 1).cast("long")
