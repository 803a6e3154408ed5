"""Queries over scalar functions: JSON held as text, keys and names, what texts say, and predicates that SQL's nulls make hard.

The inputs are put together from columns of the supplied tables in both engines, so that every branch of a function has rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.functions import jsons as J
from palimpsest.functions import lexicon as L
from palimpsest.functions import scalars as S
from palimpsest.functions import text as X
from palimpsest.operators import relational as R
from palimpsest.operators import words as O
from palimpsest.plans.registry import query
from palimpsest.runtime import read_table
from palimpsest.sources import roles
from palimpsest.sources.roles import EPISODES


def _in(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


def _words(c: str, least: int = 1, stop=()) -> str:
    kept = f"length(w) >= {least}" + (f" AND w NOT IN ({_in(stop)})" if stop else "")
    return f"list_filter(string_split_regex(lower({c}), '[^a-z]+'), lambda w: {kept})"


# JSON ---------------------------------------------------------------------------------------------------------------


@query("SELECT event_id, '{\"k\":' || CASE WHEN event_id % 4 = 0 THEN 'null' WHEN event_id % 3 = 0 THEN '\"over\"' ELSE json_extract_string(props, '$.k') END || ',\"type\":\"' || event_type || '\"}' AS merged FROM events")
def json_merge(spark, d):
    """Properties of events and what came later: later values win, also nulls."""
    e = roles.events(spark, d)
    later = F.concat(F.lit('{"type": "'), "event_type", F.lit('"'), F.when(F.col("event_id") % 4 == 0, ', "k": null').when(F.col("event_id") % 3 == 0, ',"k":"over"').otherwise(""), F.lit("}"))
    return e.select("event_id", J.merge(F.col("props"), later).alias("merged"))


@query("SELECT o_orderkey AS id, sha256('{\"a\":' || o_custkey || ',\"b\":[1,{\"x\":\"' || o_orderpriority || '\",\"y\":true}],\"c\":null}') AS content_hash FROM orders")
def json_content_hash(spark, d):
    """Objects that are written in two orders have one hash."""
    o = read_table(spark, d, "orders")
    inner = F.concat(F.lit('{"y": true, "x":"'), "o_orderpriority", F.lit('"}'))
    one = F.concat(F.lit('{"c":null, "b": [1, '), inner, F.lit('], "a": '), F.col("o_custkey").cast("string"), F.lit("}"))
    two = F.concat(F.lit('{"a":'), F.col("o_custkey").cast("string"), F.lit(', "c" : null,"b":[1,'), inner, F.lit("]}"))
    return o.select(F.col("o_orderkey").alias("id"), J.content_hash(F.when(F.col("o_orderkey") % 2 == 0, one).otherwise(two)).alias("content_hash"))


@query("SELECT event_type, count(*) FILTER (WHERE json_extract_string(props, '$.k') = '3') AS k_is_3, count(*) FILTER (WHERE event_id % 5 = 0 OR json_extract_string(props, '$.k') = '2') AS applies FROM events GROUP BY 1")
def json_predicates(spark, d):
    """A path's text, and conditions that are empty or have the value."""
    e = roles.events(spark, d)
    conditions = F.when(F.col("event_id") % 5 == 0, "{ }").otherwise(F.col("props"))
    return e.groupBy("event_type").agg(F.count_if(J.path_is(F.col("props"), "$.k", "3")).alias("k_is_3"), F.count_if(J.empty_or_has(conditions, "k", "2")).alias("applies"))


@query("""SELECT o_orderkey AS id, CASE o_orderkey % 6 WHEN 0 THEN '{"a":' || o_custkey || '}' WHEN 1 THEN '[1,{"b":"}' || o_custkey || '\\"{"}]' WHEN 2 THEN '{"a":{"b":[' || o_custkey || ']}}' WHEN 3 THEN '{"c":' || o_custkey || '}' WHEN 4 THEN NULL ELSE '"' || o_orderpriority || '"' END AS found FROM orders""")
def json_salvage(spark, d):
    """JSON that comes in fences, among prose, cut off, or not at all."""
    o = read_table(spark, d, "orders")
    n, k = F.col("o_custkey").cast("string"), F.col("o_orderkey") % 6
    text = (
        F.when(k == 0, F.concat(F.lit('Here you are:\n```json\n{"a": '), n, F.lit("}\n```\nas asked")))
        .when(k == 1, F.concat(F.lit('It is [1, {"b": "}'), n, F.lit('\\"{"}] I think [2]')))
        .when(k == 2, F.concat(F.lit('{"a": {"b": ['), n, F.lit("]}} trailing")))
        .when(k == 3, F.concat(F.lit('{"cut": [1, 2, {"c": '), n, F.lit("} and no more")))
        .when(k == 4, F.concat(F.lit("nothing of the kind "), n))
        .otherwise(F.concat(F.lit(' "'), "o_orderpriority", F.lit('" ')))
    )
    return o.select(F.col("o_orderkey").alias("id"), J.salvage(text).alias("found"))


@query("""SELECT o_orderkey AS id, CASE o_orderkey % 5 WHEN 0 THEN o_orderpriority || '|x' WHEN 1 THEN o_orderpriority WHEN 2 THEN o_custkey::VARCHAR WHEN 3 THEN 'y|' || o_orderstatus ELSE '' END AS expected FROM orders""")
def json_expected(spark, d):
    """What cases expect: a list, a string, a number, an object with items, nothing."""
    o = read_table(spark, d, "orders")
    k, q = F.col("o_orderkey") % 5, lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    said = (
        F.when(k == 0, F.concat(F.lit("["), q("o_orderpriority"), F.lit(', "x"]')))
        .when(k == 1, q("o_orderpriority"))
        .when(k == 2, F.col("o_custkey").cast("string"))
        .when(k == 3, F.concat(F.lit('{"items": ["y", '), q("o_orderstatus"), F.lit("]}")))
    )
    return o.select(F.col("o_orderkey").alias("id"), F.array_join(J.expected_strings(said), "|").alias("expected"))


@query("""SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN 's' || o_custkey WHEN 1 THEN 't' || o_custkey WHEN 2 THEN '{"n":' || o_custkey || '}' ELSE 'plain ' || o_custkey END AS said FROM orders""")
def json_answers(spark, d):
    """What a run answered: the first key that isn't blank, the whole object, or plain text."""
    o = read_table(spark, d, "orders")
    n, k = F.col("o_custkey").cast("string"), F.col("o_orderkey") % 4
    result = F.when(k == 0, F.concat(F.lit('{"answer": "later", "summary": "s'), n, F.lit('"}'))).when(k == 1, F.concat(F.lit('{"summary": "  ", "text": "t'), n, F.lit('"}'))).when(k == 2, F.concat(F.lit('{ "n" : '), n, F.lit(" }"))).otherwise(F.concat(F.lit("plain "), n))
    return o.select(F.col("o_orderkey").alias("id"), J.answer(result).alias("said"))


_TOOLS = ("write_file", "run_command", "git_commit", "remember", "record_decision", "look")


@query(f"""SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'p' || user_id WHEN 1 THEN 'ls ' || user_id WHEN 2 THEN 'commit' WHEN 3 THEN 's' || user_id WHEN 4 THEN 'c' || user_id ELSE '' END AS summary,
  CASE WHEN event_id % 3 = 0 THEN 'p' || user_id WHEN event_id % 3 = 1 THEN 'm' || user_id END AS ref FROM events""")
def call_artifacts(spark, d):
    """What calls made, from their arguments and results."""
    e, u = roles.events(spark, d), F.col("user_id").cast("string")
    tool = F.element_at(F.array(*map(F.lit, _TOOLS)), (F.col("event_id") % 6 + 1).cast("int"))
    args = F.concat(F.lit('{"path": "p'), u, F.lit('", "command": "ls '), u, F.lit('", "statement": "s'), u, F.lit('", "title": "", "chosen": "c'), u, F.lit('"}'))
    result = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('{"id": "i", "path": "p'), u, F.lit('"}'))).when(F.col("event_id") % 3 == 1, F.concat(F.lit('{"path": "", "mem_id": "m'), u, F.lit('"}'))).otherwise("{}")
    return e.select("event_id", J.artifact_summary(tool, args).alias("summary"), J.artifact_ref(result).alias("ref"))


@query("""SELECT o_orderkey AS id, CASE o_orderkey % 7 WHEN 0 THEN 'true' WHEN 1 THEN 'false' WHEN 2 THEN NULL WHEN 3 THEN o_custkey::VARCHAR WHEN 4 THEN NULL WHEN 5 THEN (o_custkey + 0.5)::DOUBLE::VARCHAR ELSE o_orderpriority END AS value FROM orders""")
def settings_coerced(spark, d):
    """Settings as text in the form of their kinds; null where they have none."""
    o, k, n = read_table(spark, d, "orders"), F.col("o_orderkey") % 7, F.col("o_custkey").cast("string")
    kind = F.element_at(F.array(*map(F.lit, ("bool", "bool", "bool", "int", "int", "float", "text"))), (k + 1).cast("int"))
    raw = F.when(k == 0, "Yes").when(k == 1, "0").when(k == 2, "maybe").when(k == 3, n).when(k == 4, F.concat(n, F.lit("x"))).when(k == 5, F.concat(n, F.lit(".50"))).otherwise(F.col("o_orderpriority"))
    return o.select(F.col("o_orderkey").alias("id"), J.coerce(kind, raw).alias("value"))


@query("""SELECT key, coalesce(own, preset) AS value, CASE WHEN preset IS NULL THEN 'free' WHEN own IS NULL THEN 'default' ELSE 'set' END AS origin FROM
  (SELECT 'k' || (n_nationkey % 20) AS key, min(n_name) AS preset FROM nation WHERE n_nationkey < 15 GROUP BY 1) FULL JOIN (SELECT 'k' || n_nationkey AS key, n_name AS own FROM nation WHERE n_nationkey % 2 = 0) USING (key)""")
def settings_registry(spark, d):
    """The registry's defaults under what is stored; keys that aren't registered are free."""
    n = read_table(spark, d, "nation")
    preset = n.where("n_nationkey < 15").groupBy(F.concat(F.lit("k"), (F.col("n_nationkey") % 20).cast("string")).alias("key")).agg(F.min("n_name").alias("value"))
    return R.with_defaults(n.where("n_nationkey % 2 = 0").select(F.concat(F.lit("k"), F.col("n_nationkey").cast("string")).alias("key"), F.col("n_name").alias("value")), preset, ["key"])


# Keys, ids, clocks --------------------------------------------------------------------------------------------------


@query("""SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN 'brand_new' WHEN 1 THEN lower(replace(replace(p_type, ' ', '_'), '-', '_')) ELSE 'size' END AS name,
  CASE p_partkey % 3 WHEN 0 THEN 'project' WHEN 1 THEN 'identity' ELSE 'skill' END AS class, CASE WHEN p_partkey % 2 = 0 THEN 'Tool' ELSE 'Other' END AS label FROM part""")
def predicate_names(spark, d):
    p = read_table(spark, d, "part")
    k = F.col("p_partkey") % 3
    raw = F.when(k == 0, " Has Brand-New").when(k == 1, F.col("p_type")).otherwise("is_measured")
    own = F.when(k == 0, "main_PROJECT").when(k == 1, "Name").otherwise("tool_x")
    label = F.when(F.col("p_partkey") % 2 == 0, " tOOL ").otherwise("gadget")
    return p.select(F.col("p_partkey").alias("id"), X.predicate_name(raw, {"measured": "size"}).alias("name"), X.predicate_class(own, ("name", "age")).alias("class"), X.entity_label(label).alias("label"))


@query("""SELECT o_orderkey AS id, o_custkey * 1000003 AS millis, 'mem' AS prefix, o_orderkey % 2 = 0 AS valid FROM orders""")
def typed_ids(spark, d):
    """Ids with a time in their first ten characters, written here digit by digit."""
    o = read_table(spark, d, "orders")
    t = F.col("o_custkey") * 1000003
    digit = lambda k: F.substring(F.lit(L.CROCKFORD), F.shiftright(t, 5 * k).bitwiseAND(31).cast("int") + 1, F.lit(1))
    typed = F.concat(F.lit("mem_"), *[digit(k) for k in range(9, -1, -1)], F.when(F.col("o_orderkey") % 2 == 0, "0123456789ABCDEF").otherwise("0123456789ABCDEU"))
    return o.select(F.col("o_orderkey").alias("id"), S.id_millis(typed).alias("millis"), S.id_prefix(typed).alias("prefix"), S.is_typed_id(typed).alias("valid"))


@query("""WITH o AS (SELECT *, o_orderkey % 4 AS k, o_orderdate::DATE::TIMESTAMP AS day FROM orders) SELECT o_orderkey AS id,
  CASE k WHEN 0 THEN o_orderdate + INTERVAL 5 MINUTE
    WHEN 1 THEN CASE WHEN day + INTERVAL 450 MINUTE > o_orderdate THEN day + INTERVAL 450 MINUTE ELSE day + INTERVAL 1 DAY + INTERVAL 450 MINUTE END
    WHEN 2 THEN (SELECT min(c) FROM (SELECT unnest([day + to_days(i) + INTERVAL 450 MINUTE FOR i IN range(8)]) AS c) WHERE c > o_orderdate AND isodow(c) IN (1, 5))
    ELSE CASE WHEN date_trunc('month', day) + INTERVAL 14 DAY + INTERVAL 450 MINUTE > o_orderdate THEN date_trunc('month', day) + INTERVAL 14 DAY + INTERVAL 450 MINUTE ELSE date_trunc('month', day) + INTERVAL 1 MONTH + INTERVAL 14 DAY + INTERVAL 450 MINUTE END END AS due FROM o""")
def jobs_due(spark, d):
    """When jobs of each cadence are next due; an interval below the floor of five minutes is five."""
    o, k = read_table(spark, d, "orders"), F.col("o_orderkey") % 4
    kind = F.element_at(F.array(*map(F.lit, ("every", "daily", "weekly", "monthly"))), (k + 1).cast("int"))
    return o.select(F.col("o_orderkey").alias("id"), S.next_due(kind, F.col("o_orderdate"), F.col("o_orderdate"), F.lit(2), F.lit("07:30"), F.array(F.lit(0), F.lit(4)), F.lit(15)).alias("due"))


@query("""SELECT o_orderkey AS id, CASE o_orderkey % 5 WHEN 0 THEN NULL WHEN 1 THEN 'bad_time' WHEN 2 THEN 'bad_weekdays' WHEN 3 THEN 'bad_day' ELSE 'unknown_cadence' END AS error FROM orders""")
def cadence_errors(spark, d):
    o, k = read_table(spark, d, "orders"), F.col("o_orderkey") % 5
    kind = F.element_at(F.array(*map(F.lit, ("every", "daily", "weekly", "monthly", "yearly"))), (k + 1).cast("int"))
    hhmm = F.when(k == 1, "24:00").otherwise("07:30")
    return o.select(F.col("o_orderkey").alias("id"), S.cadence_error(kind, hhmm, F.array(F.lit(7)), F.lit(29)).alias("error"))


@query("""SELECT c_custkey AS id, round(CASE WHEN c_custkey % 3 = 0 THEN c_acctbal WHEN c_custkey % 3 = 1 THEN (c_acctbal + c_custkey) / 2 END, 4) AS score, CASE WHEN c_custkey % 3 = 2 THEN 'detected' ELSE 'scored' END AS status FROM customer""")
def opportunity_scores(spark, d):
    """The mean of what components a chance has; none: it is only detected."""
    c = read_table(spark, d, "customer")
    parts = F.array(F.when(F.col("c_custkey") % 3 < 2, F.col("c_acctbal")), F.when(F.col("c_custkey") % 3 == 1, F.col("c_custkey").cast("double")), F.lit(None).cast("double"))
    return c.select(F.col("c_custkey").alias("id"), S.mean_of_known(parts).alias("score"), F.when(S.mean_of_known(parts).isNull(), "detected").otherwise("scored").alias("status"))


@query("""SELECT p_partkey AS id, round(sqrt(sum(x * x)), 6) AS norm, round(min(x), 6) AS least FROM (SELECT p_partkey, unnest(v) AS x FROM (SELECT p_partkey, list_transform(w, lambda x: x / sqrt(list_sum(list_transform(w, lambda y: y * y)))) AS v FROM
  (SELECT p_partkey, list_transform(range(16), lambda k: ('0x' || substr(sha256(p_name || ':' || (k // 8)), ((k % 8) * 8 + 1)::BIGINT, 8))::BIGINT / 2147483648.0::DOUBLE - 1) AS w FROM part))) GROUP BY 1""")
def hash_embeddings(spark, d):
    p = read_table(spark, d, "part").select(F.col("p_partkey").alias("id"), S.hash_embedding(F.col("p_name"), 16).alias("v"))
    return p.select("id", F.round(F.sqrt(S.dot(F.col("v"), F.col("v"))), 6).alias("norm"), F.round(F.array_min("v"), 6).alias("least"))


@query("SELECT p_partkey AS id, lower(hex(encode(p_name))) AS digits, 'ev.' || lower(p_brand) AS short FROM part")
def hex_and_types(spark, d):
    p = read_table(spark, d, "part")
    full = F.concat(F.lit("org.example.ev."), F.lower("p_brand"))
    return p.select(F.col("p_partkey").alias("id"), S.hex_of(F.col("p_name")).alias("digits"), X.short_type(full, "org.example.").alias("short"))


@query("SELECT o_orderkey AS id, len(CASE WHEN length(t) > 40 THEN substr(t, 1, 37) || '...' ELSE t END)::BIGINT AS n, CASE WHEN length(t) > 40 THEN substr(t, 1, 37) || '...' ELSE t END AS shown FROM (SELECT o_orderkey, repeat(o_orderpriority || ' ', (o_orderkey % 7)::INT) AS t FROM orders)")
def shown_short(spark, d):
    o = read_table(spark, d, "orders")
    shown = X.ellipsis(F.repeat(F.concat("o_orderpriority", F.lit(" ")), (F.col("o_orderkey") % 7).cast("int")), 40)
    return o.select(F.col("o_orderkey").alias("id"), F.length(shown).cast("long").alias("n"), shown.alias("shown"))


# What texts say -----------------------------------------------------------------------------------------------------


@query("""SELECT c_custkey AS id, f.p AS predicate, f.o AS object, f.t AS tag FROM (SELECT c_custkey, unnest([{'p': 'name', 'o': 'N' || c_custkey, 't': 'identity'}, {'p': 'is_a', 'o': lower(c_mktsegment) || ' maker', 't': 'identity'}, {'p': 'likes', 'o': 'tea', 't': 'preference'},
  {'p': 'uses_tool', 'o': 'hammer now', 't': 'preference'}, {'p': 'has_property', 'o': 'name: N' || c_custkey, 't': 'semantic'}, {'p': 'has_property', 'o': 'city: Town ' || c_nationkey, 't': 'semantic'}]) AS f FROM customer)""")
def self_reported_facts(spark, d):
    c = read_table(spark, d, "customer")
    said = F.concat(F.lit("My name is N"), F.col("c_custkey").cast("string"), F.lit(". I am a "), F.lower("c_mktsegment"), F.lit(" maker. I like tea. I LIKE Tea. I use hammer now. My City is Town "), F.col("c_nationkey").cast("string"), F.lit("."))
    rows = c.select(F.col("c_custkey").alias("id"), F.explode(X.self_facts(said)).alias("f"))
    return rows.select("id", "f.predicate", "f.object", "f.tag")


@query("""SELECT c_custkey AS id, f.k AS kind, f.s AS statement FROM (SELECT c_custkey, unnest([{'k': 'found', 's': 'part ' || c_custkey || ' fits'}, {'k': 'result', 's': 'as good as ' || c_nationkey}, {'k': 'insight', 's': 'look twice'}]) AS f FROM customer)""")
def delegation_reports(spark, d):
    c = read_table(spark, d, "customer")
    said = F.concat(F.lit("We found that part "), F.col("c_custkey").cast("string"), F.lit(" fits. I found it. The result was as good as "), F.col("c_nationkey").cast("string"), F.lit(". Key insight: look twice. Key takeaway: a fourth one."))
    return c.select(F.col("c_custkey").alias("id"), F.explode(X.reported_facts(said)).alias("f")).select("id", "f.kind", "f.statement")


@query("""SELECT c_custkey AS id, f.s AS subject, f.p AS predicate, f.o AS object FROM (SELECT c_custkey, unnest([{'s': 'Ann ' || c_custkey, 'p': 'uses', 'o': lower(c_mktsegment) || ' tools'}, {'s': 'Bob', 'p': 'uses', 'o': 'good maker'}, {'s': 'This', 'p': 'uses', 'o': 'pity'}, {'s': 'Bob', 'p': 'is', 'o': 'good maker'}]) AS f FROM customer)""")
def text_triples(spark, d):
    c = read_table(spark, d, "customer")
    said = F.concat(F.lit("Ann "), F.col("c_custkey").cast("string"), F.lit(" uses "), F.lower("c_mktsegment"), F.lit(" tools, Bob is a good maker. This is a pity."))
    return c.select(F.col("c_custkey").alias("id"), F.explode(X.triples(said)).alias("f")).select("id", "f.subject", "f.predicate", "f.object")


@query("""SELECT c_custkey AS id, d, n FROM (SELECT c_custkey, unnest([lower(c_mktsegment) || ' first', 'to go home']) AS d, 2 AS n FROM customer)""")
def text_decisions(spark, d):
    """What was decided; spans that are too short don't count, nor do verbs of the other list."""
    c = read_table(spark, d, "customer")
    said = F.concat(F.lit("We chose "), F.lower("c_mktsegment"), F.lit(" first. They picked it. Bo decided to go home, then moved to X"))
    found = X.decisions(said)
    return c.select(F.col("c_custkey").alias("id"), F.explode(found).alias("d"), F.size(X.decisions(said, L.GOAL_DECISION_VERBS, 5)).alias("n"))


_BEFORE = "coalesce(before, '')"


@query(f"""WITH {roles.TURNS} SELECT conv_id, turn, length(said)::BIGINT AS n, substr(said, 1, 30) AS head FROM (SELECT *, substr('[turn ' || turn || '] User: ' || substr({_BEFORE}, 1, 800) || chr(10) || chr(10) || 'Assistant: ' || substr(text, 1, 1200), 1, 3000) AS said FROM turns) WHERE length({_BEFORE}) >= 20 OR length(text) >= 50""")
def turn_episodes(spark, d):
    """Turns as episodes, each side cut to its length; short ones aren't kept."""
    said = X.turn_text(F.col("turn"), F.col("before"), F.col("text"))
    return roles.turns(spark, d).select("conv_id", "turn", said.alias("said")).where("said is not null").select("conv_id", "turn", F.length("said").cast("long").alias("n"), F.substring("said", 1, 30).alias("head"))


@query(f"""WITH w AS (SELECT doc_id, unnest({_words('text', 4, L.CHAPTER_STOP_WORDS)}) AS w, generate_subscripts({_words('text', 4, L.CHAPTER_STOP_WORDS)}, 1) AS pos FROM documents),
n AS (SELECT doc_id, w, count(*) AS n, min(pos) AS pos FROM w GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, pos) AS k FROM n)
SELECT doc_id AS id, string_agg(upper(w[1]) || w[2:], ' ' ORDER BY k) AS title FROM r WHERE k <= 3 GROUP BY 1""")
def chapter_titles(spark, d):
    rows = O.top_word_lists(read_table(spark, d, "documents"), "doc_id", "text", 3, 4, L.CHAPTER_STOP_WORDS)
    return rows.select("id", X.title_of(F.col("words")).alias("title")).where("title <> ''")


@query(f"SELECT item_id AS id, list_sort(list_distinct({_words('text', 4, L.GOAL_STOP_WORDS)})) AS w FROM benchmark".replace("list_sort(", "array_to_string(list_sort(").replace(" AS w FROM", ", ' ') AS words FROM"))
def label_words(spark, d):
    return read_table(spark, d, "benchmark").select(F.col("item_id").alias("id"), F.array_join(F.array_sort(X.label_keywords(F.col("text"))), " ").alias("words"))


@query("""SELECT CASE WHEN k = 0 THEN 'long' WHEN k = 1 THEN 'turn' WHEN k = 2 THEN 'counted' ELSE 'kept' END AS what, count(*) AS n FROM (SELECT o_orderkey % 4 AS k FROM orders) GROUP BY 1""")
def junk_values(spark, d):
    o, k = read_table(spark, d, "orders"), F.col("o_orderkey") % 4
    said = F.when(k == 0, F.repeat(F.lit("x"), 121)).when(k == 1, "so [turn 3] User: hi").when(k == 2, "'use' Appears  4 times").otherwise(F.col("o_orderpriority"))
    what = F.when(F.length(said) > L.LONGEST_VALUE, "long").when(X.is_transcript(said), "turn").when(X.is_counted_principle(said), "counted").otherwise("kept")
    return o.groupBy(what.alias("what")).agg(F.count("*").alias("n"))


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 'status' WHEN c_custkey % 3 = 1 THEN 'dispatch' ELSE 'none' END AS intent, CASE WHEN c_custkey % 2 = 0 THEN 'writing' ELSE 'some-title-' || c_custkey END AS project FROM customer")
def chat_routes(spark, d):
    c, k = read_table(spark, d, "customer"), F.col("c_custkey")
    said = F.when(k % 3 == 0, "What is the progress of it?").when(k % 3 == 1, "kick off the work").otherwise("hm")
    text = F.when(k % 2 == 0, "a draft of my newsletter").otherwise("something else")
    project = X.route_project(F.lit("content"), F.concat(F.lit("Some Title! "), k.cast("string")), text)
    return c.select(k.alias("id"), X.intent(said).alias("intent"), project.alias("project"))


@query("SELECT item_id AS id, CASE WHEN item_id % 2 = 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS score FROM benchmark")
def exact_matches(spark, d):
    b = read_table(spark, d, "benchmark")
    said = F.when(F.col("item_id") % 2 == 0, F.concat(F.lit("  "), F.trim("text"), F.lit(" "))).otherwise(F.upper(F.concat("text", F.lit("q"))))
    return b.select(F.col("item_id").alias("id"), X.exact_match(said, F.array(F.lit("other"), F.col("text"))).alias("score"))


_PADDED = "' ' || array_to_string(list_filter(string_split_regex(lower(text), '[^a-z]+'), lambda w: length(w) > 0), ' ') || ' '"


@query(f"""SELECT doc_id AS id FROM (SELECT doc_id, {_PADDED} AS t FROM documents) WHERE (contains(t, ' the ') OR contains(t, ' der ')) AND contains(t, ' a ') AND NOT contains(t, ' this ')""")
def web_search(spark, d):
    """The syntax of search boxes: alternatives, words that must and that must not occur."""
    return read_table(spark, d, "documents").where(X.web_match(F.col("text"), "the or der a -this")).select(F.col("doc_id").alias("id"))


@query(f"""WITH w AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^a-z]+'), lambda w: length(w) > 0) AS w FROM documents WHERE doc_id % 40 = 0), p AS (SELECT w[1] || ' ' || w[2] AS phrase FROM w WHERE len(w) > 2 ORDER BY doc_id LIMIT 1)
SELECT doc_id AS id FROM (SELECT doc_id, {_PADDED} AS t FROM documents), p WHERE contains(t, ' ' || phrase || ' ')""")
def phrase_search(spark, d):
    """A phrase in quotes: the first two words of a document."""
    docs = read_table(spark, d, "documents")
    w = docs.where("doc_id % 40 = 0").select("doc_id", X.tokens(F.col("text")).alias("w")).where("size(w) > 2").orderBy("doc_id").first()["w"]
    return docs.where(X.web_match(F.col("text"), f'"{w[0]} {w[1]}"')).select(F.col("doc_id").alias("id"))


# Predicates with nulls ----------------------------------------------------------------------------------------------


@query(f"WITH {EPISODES}, e AS (SELECT *, CASE WHEN id % 7 = 0 THEN NULL ELSE source_ref END AS ref FROM episodes) SELECT scope, count(*) AS n FROM e WHERE split_part(ref, ':', 1) <> ALL(['src1', 'src2']) GROUP BY 1")
def sources_left_out(spark, d):
    """Rows of sources that aren't in a list; rows without a source go too, as SQL's nulls have it."""
    e = roles.episodes(spark, d).withColumn("ref", F.when(F.col("id") % 7 != 0, F.col("source_ref")))
    return e.where(X.source_not_in(F.col("ref"), ("src1", "src2"))).groupBy("scope").agg(F.count("*").alias("n"))


@query(f"WITH {EPISODES}, e AS (SELECT *, CASE WHEN id % 7 = 0 THEN NULL ELSE source_ref END AS ref FROM episodes) SELECT scope, count(*) AS n, count(*) FILTER (WHERE lang IS DISTINCT FROM CASE WHEN id % 5 = 0 THEN NULL ELSE 'en' END) AS differs FROM e WHERE NOT starts_with(coalesce(ref, ''), 'src1:') GROUP BY 1")
def not_prefixed(spark, d):
    """What doesn't begin with a prefix, with rows that have no reference; and values that differ, nulls compared as values."""
    e = roles.episodes(spark, d).withColumn("ref", F.when(F.col("id") % 7 != 0, F.col("source_ref")))
    wanted = F.when(F.col("id") % 5 != 0, F.lit("en"))
    return e.where(X.lacks_prefix(F.col("ref"), "src1:")).groupBy("scope").agg(F.count("*").alias("n"), F.count_if(X.differs(F.col("lang"), wanted)).alias("differs"))


@query("""SELECT 'without' AS nulls, count(*) AS n FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey < 10) UNION ALL SELECT 'with', count(*) FROM orders WHERE o_custkey NOT IN (SELECT CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE c_custkey END FROM customer WHERE c_nationkey < 10)""")
def not_in_with_nulls(spark, d):
    """NOT IN as SQL has it: one null among the others and nothing is left."""
    o, c = read_table(spark, d, "orders"), read_table(spark, d, "customer").where("c_nationkey < 10")
    a = R.not_in(o, "o_custkey", c.select("c_custkey")).agg(F.count("*").alias("n")).select(F.lit("without").alias("nulls"), "n")
    b = R.not_in(o, "o_custkey", c.select(F.when(F.col("c_custkey") % 11 != 0, F.col("c_custkey")).alias("c"))).agg(F.count("*").alias("n")).select(F.lit("with").alias("nulls"), "n")
    return a.unionByName(b)


@query("""SELECT o_custkey, o_orderkey AS id FROM (SELECT *, rank() OVER (PARTITION BY o_custkey ORDER BY date_trunc('year', o_orderdate) DESC) AS k FROM orders) WHERE k = 1""")
def latest_with_ties(spark, d):
    """All rows of the latest year of each customer."""
    o = read_table(spark, d, "orders").withColumn("year", F.date_trunc("year", "o_orderdate"))
    return R.latest_with_ties(o, ["o_custkey"], "year").select("o_custkey", F.col("o_orderkey").alias("id"))


@query("""SELECT * FROM (SELECT 'order' AS kind, o_orderkey AS id, o_orderdate AS made_at FROM orders UNION ALL SELECT 'event', event_id, ts FROM events) ORDER BY made_at DESC, kind, id LIMIT 200""")
def newest_of_all(spark, d):
    """The newest rows of several tables as one list; the limit that was asked for is above what is allowed."""
    o, e = read_table(spark, d, "orders"), roles.events(spark, d)
    rows = R.tagged_union({"order": o.select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("made_at")), "event": e.select(F.col("event_id").alias("id"), F.col("ts").alias("made_at"))})
    return rows.orderBy(F.desc("made_at"), "kind", "id").limit(R.capped(5000, 200))


@query("""SELECT id, p FROM (SELECT p_partkey AS id, row_number() OVER (ORDER BY (p_name ILIKE '%a%') DESC, p_partkey) AS p FROM part) WHERE p <= 50""")
def priority_first(spark, d):
    """Rows that match a word first, the others after them."""
    rows = R.matching_first(read_table(spark, d, "part"), "p_name", "a", ["p_partkey"], 50)
    return rows.select(F.col("p_partkey").alias("id"), F.col("place").alias("p"))


@query("""SELECT o_orderpriority AS name, coalesce(max(o_custkey), 0) + 1 AS next_version FROM orders GROUP BY 1 UNION ALL SELECT 'nobody', 1""")
def next_versions(spark, d):
    o = read_table(spark, d, "orders").select(F.col("o_orderpriority").alias("name"), F.col("o_custkey").alias("version"))
    names = o.select("name").distinct().unionByName(spark.range(1).select(F.lit("nobody").alias("name")))
    return R.next_version(names, o, "name", "version")
