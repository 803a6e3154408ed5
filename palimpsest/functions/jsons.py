"""JSON held as text, as Columns: Spark's variants parse it, nothing is parsed in Python."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from palimpsest.functions import lexicon as L


def canonical(c: Column) -> Column:
    """Compact, keys in order; null if it isn't JSON."""
    return F.to_json(F.try_parse_json(c))


def content_hash(c: Column) -> Column:
    """SHA-256 in hex of the canonical form: equal for objects that differ in order and white space only."""
    return F.sha2(canonical(c), 256)


def merge(a: Column, b: Column) -> Column:
    """Two objects as one, the second one's values first; null objects are empty."""
    kind = "map<string,variant>"
    one, two = (F.coalesce(F.from_json(x, kind), F.from_json(F.lit("{}"), kind)) for x in (a, b))
    return canonical(F.to_json(F.map_concat(F.map_filter(one, lambda k, _: ~F.map_contains_key(two, k)), two)))


def path_is(c: Column, path: str, value: str) -> Column:
    """Whether the text at a path is the value; false where there is none."""
    return F.coalesce(F.get_json_object(c, path) == value, F.lit(False))


def empty_or_has(c: Column, key: str, value: str) -> Column:
    """Conditions that always hold, or hold for this value of the key."""
    return F.coalesce(canonical(c) == "{}", F.lit(False)) | path_is(c, f"$.{key}", value)


def _balanced(c: Column) -> Column:
    """From the first bracket to the one that closes it; brackets inside strings don't count."""
    first = F.regexp_instr(c, F.lit(r"[\{\[]"))
    text = F.when(first > 0, F.substring(c, first, F.length(c)))
    start = F.struct(F.lit(0).alias("depth"), F.lit(False).alias("inside"), F.lit(False).alias("escaped"), F.lit(0).alias("at"), F.lit(0).alias("end"))

    def step(s: Column, x: Column) -> Column:
        quote, free = (x == '"') & ~s["escaped"], ~s["inside"]
        depth = s["depth"] + F.when(free & x.isin("{", "["), 1).when(free & x.isin("}", "]"), -1).otherwise(0)
        closed = free & x.isin("}", "]") & (depth == 0)
        return F.when(s["end"] > 0, s).otherwise(
            F.struct(depth.alias("depth"), F.when(quote, free).otherwise(s["inside"]).alias("inside"), (s["inside"] & (x == "\\") & ~s["escaped"]).alias("escaped"), (s["at"] + 1).alias("at"), F.when(closed, s["at"] + 1).otherwise(0).alias("end"))
        )

    end = F.aggregate(F.split(text, ""), start, step)["end"]
    return F.when(end > 0, F.substring(text, F.lit(1), end))


def salvage(c: Column) -> Column:
    """The JSON in a text that should be JSON, in canonical form: the whole, what a fence holds, the first balanced value, or the first flat object."""
    fenced = F.nullif(F.regexp_extract(c, r"(?s)```(?:json)?\s*(.*?)```", 1), F.lit(""))
    flat = F.filter(F.transform(F.regexp_extract_all(c, F.lit(r"\{[^{}]*\}"), F.lit(0)), canonical), lambda x: x.isNotNull())
    return F.coalesce(canonical(F.trim(c)), canonical(fenced), canonical(_balanced(c)), F.get(flat, F.lit(0)))


def expected_strings(c: Column) -> Column:
    """What a case expects, as an array of strings: of a list its items, of an object its `items`, of a scalar itself."""
    v = F.try_parse_json(c)
    of = lambda path, kind: F.try_variant_get(v, path, kind)
    return F.coalesce(of("$", "array<string>"), of("$.items", "array<string>"), F.array(of("$", "string")), F.array().cast("array<string>"))


def answer(c: Column, keys: Sequence[str] = L.ANSWER_KEYS) -> Column:
    """The first of the keys whose text isn't blank, else the whole; what isn't an object stays as it is."""
    found = [F.get_json_object(c, f"$.{k}") for k in keys]
    return F.coalesce(*[F.when(F.length(F.trim(x)) > 0, x) for x in found], canonical(c), c)


def artifact_summary(tool: Column, args: Column) -> Column:
    """The argument of a call that says what it was about; blank for tools that have none."""
    table = [(t, F.get_json_object(args, f"$.{k}")) for t, k in L.SUMMARY_ARGUMENTS.items()]
    out = F
    for t, value in table:
        out = out.when(tool == t, value)
    chosen = F.when(tool == "record_decision", F.get_json_object(args, "$.chosen")).when(tool == "git_commit", "commit")
    return F.substring(F.coalesce(F.nullif(out, F.lit("")), chosen, F.lit("")), 1, 400)


def artifact_ref(result: Column) -> Column:
    """What a call made, by the first key that names it."""
    return F.coalesce(*[F.nullif(F.get_json_object(result, f"$.{k}"), F.lit("")) for k in L.PRODUCT_KEYS])


def coerce(kind: Column, raw: Column) -> Column:
    """A setting's text in the canonical form of its kind (bool, int, float, else text); null if it has none."""
    low = F.lower(raw)
    flag = F.when(low.isin("true", "1", "yes", "on"), "true").when(low.isin("false", "0", "no", "off"), "false")
    return F.when(kind == "bool", flag).when(kind == "int", raw.try_cast("bigint").cast("string")).when(kind == "float", raw.try_cast("double").cast("string")).otherwise(raw)
