"""Queries over attention: what is said of goals and entities, what isn't, and the reports on it."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.functions import lexicon as L
from palimpsest.functions import text as X
from palimpsest.operators import attention as A
from palimpsest.plans.registry import query
from palimpsest.plans.scalars import _words
from palimpsest.runtime import read_table
from palimpsest.sources import roles
from palimpsest.sources.roles import EPISODES

#: Mentions from which on a label isn't neglected.
_LOW = 400
_LABELS = f"""lab AS (SELECT item_id AS id, CASE WHEN item_id % 2 = 0 THEN 'goal' ELSE 'value' END AS kind, list_distinct({_words("substr(text, 1, 60)", 4, L.GOAL_STOP_WORDS)}) AS k FROM benchmark),
said AS (SELECT w AS word, count(*) AS n FROM (SELECT unnest({_words('text')}) AS w FROM documents) GROUP BY 1),
men AS (SELECT id, any_value(kind) AS kind, coalesce(max(n), 0) AS mentions FROM (SELECT id, kind, unnest(k) AS word FROM lab) LEFT JOIN said USING (word) GROUP BY 1)"""


def _labels(spark, d):
    b = read_table(spark, d, "benchmark")
    return b.select(F.col("item_id").alias("id"), F.when(F.col("item_id") % 2 == 0, "goal").otherwise("value").alias("kind"), F.substring("text", 1, 60).alias("label"))


@query(f"WITH {_LABELS} SELECT id, mentions::BIGINT AS mentions FROM men")
def label_mentions(spark, d):
    """How often what is said lately mentions each label, by its most frequent keyword."""
    return A.mentions(_labels(spark, d), roles.episodes(spark, d))


@query(f"WITH {_LABELS} SELECT id, mentions::BIGINT AS mentions, round(least(CASE kind WHEN 'goal' THEN 0.7 ELSE 0.5 END + 0.1 * ({_LOW} - mentions), 0.95)::DOUBLE, 2) AS severity FROM men WHERE mentions < {_LOW}")
def attention_gaps(spark, d):
    return A.alignment_gaps(_labels(spark, d), roles.episodes(spark, d), _LOW)


@query(f"""WITH said AS (SELECT ' ' || array_to_string({_words('text')}, ' ') || ' ' AS t FROM documents), n AS (SELECT doc_id AS id, array_to_string(list_reverse({_words('text')}[1:(doc_id % 3 + 1)::INT]), ' ') AS name FROM documents),
met AS (SELECT DISTINCT name FROM (SELECT DISTINCT name FROM n WHERE name <> '') JOIN said ON contains(t, ' ' || name || ' ')) SELECT id FROM n WHERE name NOT IN (SELECT name FROM met)""")
def unsaid_names(spark, d):
    """Names of one to three words that nobody says: here the first words of documents, the other way round."""
    docs = read_table(spark, d, "documents")
    names = docs.select(F.col("doc_id").alias("id"), F.array_join(F.reverse(F.slice(X.tokens(F.col("text")), 1, (F.col("doc_id") % 3 + 1).cast("int"))), " ").alias("name"))
    return A.unmentioned(names, roles.episodes(spark, d)).select("id")


@query("SELECT item_id AS id, CASE WHEN EXISTS (SELECT 1 FROM documents WHERE contains(lower(documents.text), lower(substr(b.text, 1, 20)))) THEN 'active' ELSE 'stale' END AS status FROM (SELECT item_id, CASE WHEN item_id % 3 = 0 THEN 'Zz' || text ELSE text END AS text FROM benchmark) b")
def goals_mentioned(spark, d):
    b = read_table(spark, d, "benchmark")
    goals = b.select(F.col("item_id").alias("id"), F.when(F.col("item_id") % 3 == 0, F.concat(F.lit("Zz"), "text")).otherwise(F.col("text")).alias("statement"))
    return A.mentioned_goals(goals, roles.episodes(spark, d))


_TOOLS = ("the", "with", "und", "que", "worthless")


@query(f"SELECT tool, n, round(least(0.5 + 0.1 * n, 0.95)::DOUBLE, 2) AS confidence, round(least(0.6 + 0.05 * n, 0.9)::DOUBLE, 2) AS finding FROM (SELECT w AS tool, count(*) AS n FROM (SELECT unnest(list_distinct({_words('text')})) AS w FROM documents) WHERE w IN ('the', 'with', 'und', 'que', 'worthless') GROUP BY 1 HAVING count(*) >= 2 ORDER BY 2 DESC, 1 LIMIT 3)")
def tools_in_use(spark, d):
    return A.mentioned_tools(roles.episodes(spark, d), list(_TOOLS))


@query("""SELECT snippet, count(*) AS n FROM (SELECT unnest(CASE WHEN o_orderkey % 3 = 0 THEN ['build a house of ' || lower(o_orderpriority)] WHEN o_orderkey % 3 = 1 THEN ['learn to read and write', 'write'] ELSE [] END) AS snippet FROM orders) WHERE snippet <> 'write' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 2""")
def latent_goals(spark, d):
    """What people mean to do, from the verbs that they say it with; what is a goal already is none."""
    o = read_table(spark, d, "orders")
    said = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("We Build a house of "), "o_orderpriority")).when(F.col("o_orderkey") % 3 == 1, "I learn to read and write").otherwise("nothing")
    known = spark.createDataFrame([("Write",)], "title string")
    return A.latent_goals(o.select(said.alias("content")), known, top=3)


@query("""SELECT d AS decision, min(id) AS id FROM (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 2 = 0 THEN lower(o_orderpriority) || ' first' ELSE 'plan ' || o_orderstatus END AS d FROM orders) WHERE d <> 'plan F' GROUP BY 1""")
def decisions_unrecorded(spark, d):
    """Decisions that texts tell of, as far as they aren't recorded."""
    o = read_table(spark, d, "orders")
    said = F.concat(F.lit("So we chose "), F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lower("o_orderpriority"), F.lit(" first"))).otherwise(F.concat(F.lit("plan "), "o_orderstatus")), F.lit(". Then lunch."))
    return A.audited_decisions(o.select(F.col("o_orderkey").alias("id"), said.alias("content")), spark.createDataFrame([("Plan f",)], "title string"))


_REPORT = f"""{EPISODES}, s AS (SELECT scope, count(*) AS episodes_scanned FROM (SELECT scope, row_number() OVER (PARTITION BY scope ORDER BY created_at DESC, id) AS k FROM episodes WHERE created_at >= TIMESTAMP '2024-01-03') WHERE k <= 50 GROUP BY 1),
f AS (SELECT scope, 1 AS o, 'finding' AS kind, 'says ' || lang AS statement, 0.65 AS confidence FROM (SELECT DISTINCT scope, lang FROM episodes) UNION ALL
SELECT scope, 2, 'theme', 'Recurring theme: ' || lang || ' (' || n || ' links)', least(0.5 + 0.05 * n, 0.9) FROM (SELECT scope, lang, count(*) % 10 AS n FROM episodes GROUP BY 1, 2) UNION ALL
SELECT scope, 3, 'goal', 'Goal ''' || 'read ' || scope || ''' is active', 0.7 FROM (SELECT DISTINCT scope FROM episodes WHERE scope <> 'user:src1'))"""


@query(f"""WITH {_REPORT}, l AS (SELECT scope, count(*) AS n, string_agg(kind || ' ' || round(confidence::DOUBLE, 2) || ': ' || statement, '; ' ORDER BY o, kind, statement) AS t FROM f GROUP BY 1)
SELECT scope, episodes_scanned, n AS n_findings, t AS findings, n || ' findings of ' || episodes_scanned || ' episodes' AS summary FROM s LEFT JOIN l USING (scope)""")
def reflection_reports(spark, d):
    """A report for each scope: what was looked at, findings, themes and goals, each with how sure it is."""
    e = roles.episodes(spark, d)
    themes = e.groupBy("scope", F.col("lang").alias("phrase")).agg((F.count("*") % 10).alias("n"))
    goals = e.where("scope <> 'user:src1'").select("scope").distinct().select("scope", F.concat(F.lit("read "), "scope").alias("statement"), F.lit("active").alias("status"))
    findings = e.select("scope", "lang").distinct().select("scope", F.concat(F.lit("says "), "lang").alias("statement"), F.lit(0.65).alias("confidence"))
    return A.report(e, themes, goals, findings, F.lit("2024-01-03").cast("timestamp_ntz"), 50)


@query(f"""WITH {_LABELS}, g AS (SELECT round(least(CASE kind WHEN 'goal' THEN 0.7 ELSE 0.5 END + 0.1 * ({_LOW} - mentions), 0.95)::DOUBLE, 2) AS severity FROM men WHERE mentions < {_LOW}), b AS (SELECT round(count(*) / (SELECT count(*) FROM embeddings), 2) AS share FROM embeddings GROUP BY label),
n AS (SELECT p_partkey, count(*) AS degree FROM part JOIN lineitem ON l_partkey = p_partkey WHERE p_size > 40 GROUP BY 1 HAVING count(*) >= 5)
SELECT 'gaps' AS aspect, count(*) AS n, round(max(severity), 4) AS worst FROM g UNION ALL SELECT 'neglected', count(*), max(degree)::DOUBLE FROM n UNION ALL SELECT 'breadth', count(*), max(share) FROM b UNION ALL SELECT 'load', count(*), max(user_id % 7)::DOUBLE FROM (SELECT DISTINCT user_id FROM events)""")
def attention_view(spark, d):
    """All of it in one view."""
    from palimpsest.plans.graphs import breadth

    gaps = A.alignment_gaps(_labels(spark, d), roles.episodes(spark, d), _LOW)
    neglected = read_table(spark, d, "part").where("p_size > 40").join(read_table(spark, d, "lineitem"), F.col("l_partkey") == F.col("p_partkey")).groupBy("p_partkey").agg(F.count("*").alias("degree")).where("degree >= 5")
    load = roles.events(spark, d).select("user_id").distinct().select((F.col("user_id") % 7).alias("score"))
    return A.attention_view(gaps, neglected, breadth(spark, d), load)
