"""Queries over text, turns and the event log."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from palimpsest.functions import lexicon as L
from palimpsest.functions import scalars as S
from palimpsest.functions import text as X
from palimpsest.operators import decisions as D
from palimpsest.operators import relational as R
from palimpsest.operators import words as O
from palimpsest.plans.registry import query
from palimpsest.runtime import read_table
from palimpsest.sources import roles
from palimpsest.sources.roles import EPISODES, TURNS


def _in(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


def _contains_any(c: str, words) -> str:
    return "(" + " OR ".join(f"contains(lower({c}), '{w}')" for w in words) + ")"


def _hits(c: str, words) -> str:
    return "(" + " + ".join(f"contains(lower({c}), '{w}')::INT" for w in words) + ")"


_TRIM = "regexp_replace(text, '^\\s+|\\s+$', '', 'g')"


@query(f"SELECT role, count(*) AS n, count(*) FILTER (WHERE length({_TRIM}) < 12 OR (length({_TRIM}) <= 120 AND regexp_matches({_TRIM}, '(?i)^[\\s\\W]*(?:(?:{L.ACKNOWLEDGEMENTS})[\\s\\W]*)+$'))) AS trivial FROM conversations GROUP BY role")
def trivial_turns(spark, d):
    return read_table(spark, d, "conversations").groupBy("role").agg(F.count("*").alias("n"), F.count_if(X.is_trivial_turn(F.col("text"))).alias("trivial"))


@query(f"SELECT word, count(*) AS frequency FROM (SELECT unnest(string_split_regex(lower(text), '[^a-z]+')) AS word FROM documents) WHERE length(word) >= 3 AND word NOT IN ({_in(L.THEME_STOP_WORDS)}) GROUP BY 1 HAVING count(*) >= 2 ORDER BY 2 DESC, 1 LIMIT 10")
def keyword_themes(spark, d):
    words = read_table(spark, d, "documents").select(F.explode(X.tokens(F.col("text"), 3, L.THEME_STOP_WORDS)).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("frequency")).where("frequency >= 2").orderBy(F.desc("frequency"), "word").limit(10)


_TOP = """w AS (SELECT id, scope, created_at, unnest(string_split_regex(lower(content), '[^a-z]+')) AS word, generate_subscripts(string_split_regex(lower(content), '[^a-z]+'), 1) AS pos FROM episodes),
c AS (SELECT id, word, count(*) AS n, min(pos) AS pos FROM w WHERE length(word) >= 3 AND word NOT IN ({stop}) GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC, pos) AS rank FROM c)"""


@query(f"WITH {EPISODES}, {_TOP.format(stop=_in(L.CHAPTER_STOP_WORDS))} SELECT id, word, n, rank FROM r WHERE rank <= 5")
def doc_keywords(spark, d):
    return O.word_counts(roles.episodes(spark, d), "id", "content", 3, L.CHAPTER_STOP_WORDS, 5).select("id", "word", "n", "rank")


def _similarity_to_previous(spark, d, stop):
    """Episodes with the similarity of their top words to those of the episode before in their scope."""
    eps = roles.episodes(spark, d)
    tops = O.top_word_lists(eps, "id", "content", 5, 3, stop).withColumnRenamed("words", "top")
    rows = R.previous(eps.select("id", "scope", "created_at").join(tops, "id"), ["scope"], ["created_at", "id"], "top", "before")
    return rows.withColumn("similarity", F.when(F.col("before").isNotNull(), X.jaccard(F.col("top"), F.col("before"))))


_PREV = """s AS (SELECT id, list(word) FILTER (WHERE rank <= 5) AS top FROM r GROUP BY 1), e AS (SELECT episodes.id, scope, created_at, coalesce(top, []) AS top FROM episodes LEFT JOIN s ON s.id = episodes.id),
p AS (SELECT *, lag(top) OVER (PARTITION BY scope ORDER BY created_at, id) AS before FROM e),
j AS (SELECT *, CASE WHEN before IS NULL THEN NULL WHEN len(list_distinct(list_concat(top, before))) = 0 THEN 1.0 ELSE len(list_intersect(top, before)) / len(list_distinct(list_concat(top, before))) END AS similarity FROM p)"""


@query(f"WITH {EPISODES}, {_TOP.format(stop=_in(L.SWITCH_STOP_WORDS))}, {_PREV} SELECT scope, count(*) AS n, count(*) FILTER (WHERE similarity < 0.3) AS switches, round(0.4 * least(count(*) / 140, 1) + 0.6 * coalesce(count(*) FILTER (WHERE similarity < 0.3) / nullif(count(*) - 1, 0), 0), 3) AS score FROM j GROUP BY 1")
def cognitive_load(spark, d):
    rows = _similarity_to_previous(spark, d, L.SWITCH_STOP_WORDS)
    out = rows.groupBy("scope").agg(F.count("*").alias("n"), F.count_if(F.col("similarity") < 0.3).alias("switches"))
    density = F.least(F.col("n") / 140, F.lit(1.0))
    switching = F.when(F.col("n") > 1, F.col("switches") / (F.col("n") - 1)).otherwise(0.0)
    return out.withColumn("score", F.round(0.4 * density + 0.6 * switching, 3))


@query(f"""WITH RECURSIVE {EPISODES}, {_TOP.format(stop=_in(L.CHAPTER_STOP_WORDS))}, {_PREV}, o AS (SELECT id, scope, coalesce(similarity < 0.3, false) AS shift, row_number() OVER (PARTITION BY scope ORDER BY created_at, id) AS k FROM j),
f AS (SELECT id, scope, k, 1 AS n, 0::BIGINT AS segment FROM o WHERE k = 1 UNION ALL SELECT o.id, o.scope, o.k, CASE WHEN shift AND n >= 3 THEN 1 ELSE n + 1 END, segment + CASE WHEN shift AND n >= 3 THEN 1 ELSE 0 END FROM f JOIN o ON o.scope = f.scope AND o.k = f.k + 1)
SELECT id, scope, segment FROM f""")
def topic_segments(spark, d):
    rows = _similarity_to_previous(spark, d, L.CHAPTER_STOP_WORDS)
    return R.segments(rows, ["scope"], "id", F.col("similarity") < 0.3).select("id", "scope", "segment")


@query(" UNION ALL ".join(f"SELECT '{k}' AS category, count(*) FILTER (WHERE {_contains_any('text', w)} AND doc_id < (SELECT max(doc_id) + 1 FROM documents) / 2) AS first_half, count(*) FILTER (WHERE {_contains_any('text', w)} AND doc_id >= (SELECT max(doc_id) + 1 FROM documents) / 2) AS second_half, round(count(*) FILTER (WHERE {_contains_any('text', w)}) / count(*) * 100, 1) AS percentage FROM documents" for k, w in L.CATEGORY_KEYWORDS.items()))
def category_allocation(spark, d):
    docs = read_table(spark, d, "documents")
    tags = F.explode(F.array(*[F.struct(F.lit(k).alias("category"), X.has_any(F.col("text"), w).alias("hit")) for k, w in L.CATEGORY_KEYWORDS.items()]))
    rows = docs.select("doc_id", tags.alias("t")).select("doc_id", "t.*")
    half = (docs.agg(F.max("doc_id")).first()[0] or 0) / 2 + 0.5
    return rows.groupBy("category").agg(F.count_if(F.col("hit") & (F.col("doc_id") < half)).alias("first_half"), F.count_if(F.col("hit") & (F.col("doc_id") >= half)).alias("second_half"), F.round(F.count_if("hit") / F.count("*") * 100, 1).alias("percentage"))


@query(" UNION ALL ".join(f"SELECT '{k}' AS signal, count(*) FILTER (WHERE {_contains_any('text', w)}) AS mentions, count(*) FILTER (WHERE {_contains_any('text', w)}) > 0 AS active FROM conversations" for k, w in L.HEALTH_KEYWORDS.items()))
def health_signals(spark, d):
    tags = F.explode(F.array(*[F.struct(F.lit(k).alias("signal"), X.has_any(F.col("text"), w).alias("hit")) for k, w in L.HEALTH_KEYWORDS.items()]))
    rows = read_table(spark, d, "conversations").select(tags.alias("t")).select("t.*")
    return rows.groupBy("signal").agg(F.count_if("hit").alias("mentions")).withColumn("active", F.col("mentions") > 0)


# The synthetic words of the tables stand in for the lexicon's, which they never hold.
_MOOD = {"positive": ("with", "this", "tion"), "negative": ("worthless", "idiot", "from"), "high": ("ing", "ment"), "low": ("heit", "ción", "the")}


@query(f"""WITH h AS (SELECT doc_id AS id, {_hits('text', _MOOD['positive'])}::DOUBLE AS p, {_hits('text', _MOOD['negative'])}::DOUBLE AS n, {_hits('text', _MOOD['high'])}::DOUBLE AS h, {_hits('text', _MOOD['low'])}::DOUBLE AS l FROM documents),
v AS (SELECT id, CASE WHEN p + n > 0 THEN round((p - n) / (p + n), 2) ELSE 0 END AS valence, CASE WHEN h + l > 0 THEN round(0.5 + (h - l) / (h + l) * 0.4, 2) ELSE 0.5 END::DOUBLE AS energy FROM h)
SELECT id, valence, energy, CASE WHEN valence >= 0.3 AND energy >= 0.6 THEN 'energetic' WHEN valence >= 0.3 AND energy < 0.4 THEN 'calm' WHEN valence <= -0.3 AND energy >= 0.6 THEN 'anxious' WHEN valence <= -0.3 AND energy < 0.4 THEN 'tired' WHEN valence <= -0.3 THEN 'sad' WHEN energy >= 0.7 THEN 'focused' WHEN energy < 0.3 THEN 'sleepy' ELSE 'neutral' END AS mood FROM v""")
def mood_of_documents(spark, d):
    m = X.mood(F.col("text"), **_MOOD)
    return read_table(spark, d, "documents").select(F.col("doc_id").alias("id"), m.alias("m")).select("id", "m.valence", "m.energy", "m.mood")


@query("""WITH e AS (SELECT user_id, value / 250 - 1 AS valence, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k, count(*) OVER (PARTITION BY user_id) AS n FROM events),
h AS (SELECT user_id, max(n) AS n, round(avg(valence), 3) AS mean, avg(valence) FILTER (WHERE k <= n // 2) AS recent, avg(valence) FILTER (WHERE k > n // 2) AS older FROM e GROUP BY 1)
SELECT user_id, n, mean, CASE WHEN round(recent - older, 9) > 0.1 THEN 'improving' WHEN round(recent - older, 9) < -0.1 THEN 'declining' ELSE 'stable' END AS trend FROM h""")
def mood_trend(spark, d):
    w = Window.partitionBy("user_id")
    e = roles.events(spark, d).select("user_id", (F.col("value") / 250 - 1).alias("valence"), F.row_number().over(w.orderBy(F.desc("ts"), F.desc("event_id"))).alias("k"), F.count("*").over(w).alias("n"))
    half = F.floor(F.col("n") / 2)
    h = e.groupBy("user_id").agg(F.max("n").alias("n"), F.round(F.avg("valence"), 3).alias("mean"), F.avg(F.when(F.col("k") <= half, F.col("valence"))).alias("recent"), F.avg(F.when(F.col("k") > half, F.col("valence"))).alias("older"))
    gap = F.round(F.col("recent") - F.col("older"), 9)
    return h.select("user_id", "n", "mean", F.when(gap > 0.1, "improving").when(gap < -0.1, "declining").otherwise("stable").alias("trend"))


@query("SELECT isodow(ts) AS day, hour(ts) AS hour, count(*) AS n FROM events GROUP BY 1, 2")
def hour_day_heatmap(spark, d):
    return roles.events(spark, d).groupBy((F.weekday("ts") + 1).cast("long").alias("day"), F.hour("ts").cast("long").alias("hour")).agg(F.count("*").alias("n"))


@query(f"WITH {EPISODES} SELECT e.lang, split_part(e.source_ref, ':', 1) AS system, count(*) AS episodes, count(DISTINCT l.doc_id) AS facts, coalesce(sum(l.quality), 0)::BIGINT AS good FROM episodes e LEFT JOIN labels l ON l.doc_id = e.id GROUP BY 1, 2")
def source_composition(spark, d):
    rows = roles.episodes(spark, d).join(read_table(spark, d, "labels"), F.col("id") == F.col("doc_id"), "left")
    return rows.groupBy("lang", X.source_system(F.col("source_ref")).alias("system")).agg(F.count("*").alias("episodes"), F.countDistinct("doc_id").alias("facts"), F.coalesce(F.sum("quality"), F.lit(0)).cast("long").alias("good"))


@query("SELECT event_type, max(ts) AS last_at, count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-30') AS day, count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-24') AS week, count(*) FILTER (WHERE json_extract_string(props, '$.k')::INT >= 50) AS high FROM events GROUP BY 1")
def engine_activity(spark, d):
    since = lambda t: F.count_if(F.col("ts") >= F.lit(t).cast("timestamp_ntz"))
    return roles.events(spark, d).groupBy("event_type").agg(F.max("ts").alias("last_at"), since("2024-01-30").alias("day"), since("2024-01-24").alias("week"), F.count_if(F.get_json_object("props", "$.k").cast("int") >= 50).alias("high"))


@query("WITH m AS (SELECT user_id, max(event_id) AS mark FROM events WHERE ts < TIMESTAMP '2024-01-20' GROUP BY 1) SELECT e.user_id, min(event_id) AS first_seq, max(ts) AS last_at, count(*) FILTER (WHERE event_id > coalesce(mark, -1)) AS pending, CASE WHEN count(*) FILTER (WHERE event_id > coalesce(mark, -1)) = 0 THEN 'idle' ELSE 'stale' END AS status FROM events e LEFT JOIN m ON m.user_id = e.user_id GROUP BY 1")
def projection_status(spark, d):
    e = roles.events(spark, d)
    marks = e.where("ts < timestamp_ntz '2024-01-20'").groupBy("user_id").agg(F.max("event_id").alias("mark"))
    pending = F.count_if(F.col("event_id") > F.coalesce("mark", F.lit(-1)))
    out = e.join(marks, "user_id", "left").groupBy("user_id").agg(F.min("event_id").alias("first_seq"), F.max("ts").alias("last_at"), pending.alias("pending"))
    return out.withColumn("status", F.when(F.col("pending") == 0, "idle").otherwise("stale"))


@query("WITH k AS (SELECT *, CASE event_type WHEN 'error' THEN 'invalidated' WHEN 'view' THEN 'other' ELSE 'stored' END AS kind FROM events), m AS (SELECT user_id, 2000 AS mark FROM (SELECT DISTINCT user_id FROM events WHERE user_id % 2 = 0)) SELECT user_id, event_id % 7 AS id, max(event_id) AS seq, max_by(kind, event_id) = 'invalidated' AS tombstone FROM k LEFT JOIN m USING (user_id) WHERE event_id > coalesce(mark, -1) AND kind <> 'other' GROUP BY 1, 2")
def event_projection(spark, d):
    from palimpsest.operators.consolidation import project_events

    e = roles.events(spark, d)
    kind = F.when(F.col("event_type") == "error", "invalidated").when(F.col("event_type") == "view", "other").otherwise("stored")
    log = e.select(F.col("user_id").alias("scope"), F.col("event_id").alias("seq"), kind.alias("kind"), (F.col("event_id") % 7).alias("id"), F.col("props").alias("body"))
    marks = e.where("user_id % 2 = 0").select(F.col("user_id").alias("scope")).distinct().withColumn("seq", F.lit(2000).cast("long"))
    state, _ = project_events(log, marks)
    return state.select(F.col("scope").alias("user_id"), "id", "seq", "tombstone")


@query("SELECT user_id, session, count(*) AS n, min(ts) AS started, max(ts) AS ended FROM (SELECT *, count(*) FILTER (WHERE gap >= INTERVAL 12 HOUR) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM (SELECT *, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events)) GROUP BY 1, 2")
def gap_chapters(spark, d):
    rows = R.gap_sessions(roles.events(spark, d), ["user_id"], "ts", "12 HOURS", ["ts", "event_id"])
    return rows.groupBy("user_id", "session").agg(F.count("*").alias("n"), F.min("ts").alias("started"), F.max("ts").alias("ended"))


@query("SELECT user_id, min(ts) AS started, count(*) AS n FROM (SELECT *, count(*) FILTER (WHERE gap >= INTERVAL 6 HOUR) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events)) GROUP BY user_id, s")
def session_windows(spark, d):
    rows = roles.events(spark, d).groupBy("user_id", F.session_window("ts", "6 hours").alias("w")).agg(F.min("ts").alias("started"), F.count("*").alias("n"))
    return rows.select("user_id", "started", "n")


@query(f"WITH {TURNS} SELECT conv_id, turn, round(coalesce(len(list_intersect(list_distinct(list_filter(string_split_regex(lower(text), '[^a-z]+'), lambda x: x <> '')), list_distinct(list_filter(string_split_regex(lower(before), '[^a-z]+'), lambda x: x <> '')))) / greatest(len(list_distinct(list_filter(string_split_regex(lower(text), '[^a-z]+'), lambda x: x <> ''))), 1), 0)::DOUBLE, 6) AS overlap FROM turns WHERE before IS NOT NULL")
def turn_overlap(spark, d):
    rows = roles.turns(spark, d).where("before is not null")
    return rows.select("conv_id", "turn", F.round(X.overlap_of_first(X.word_set(F.col("text")), X.word_set(F.col("before"))), 6).alias("overlap"))


_TRI = "SELECT conv_id, turn, lower(substring({c}, i::INT, 3)) AS g, count(*) AS n FROM turns, generate_series(1, 20000) s(i) WHERE before IS NOT NULL AND i <= length({c}) - 2 GROUP BY ALL"


@query(f"""WITH {TURNS}, a AS ({_TRI.format(c='text')}), b AS ({_TRI.format(c='before')}), na AS (SELECT conv_id, turn, sqrt(sum(n * n)) AS n FROM a GROUP BY ALL), nb AS (SELECT conv_id, turn, sqrt(sum(n * n)) AS n FROM b GROUP BY ALL),
x AS (SELECT a.conv_id, a.turn, sum(a.n * b.n) AS dot FROM a JOIN b USING (conv_id, turn, g) GROUP BY ALL)
SELECT t.conv_id, t.turn, round(coalesce(dot / (na.n * nb.n), 0), 6) AS similarity FROM turns t LEFT JOIN x USING (conv_id, turn) LEFT JOIN na USING (conv_id, turn) LEFT JOIN nb USING (conv_id, turn) WHERE before IS NOT NULL""")
def eval_trigram(spark, d):
    rows = O.gram_products(roles.turns(spark, d).where("before is not null"), ["conv_id", "turn"], "text", "before")
    # A null key equals none, not even itself.
    alike = F.when(F.col("conv_id").isNotNull() & F.col("turn").isNotNull(), F.col("dot") / F.nullif(F.sqrt("a") * F.sqrt("b"), F.lit(0.0)))
    return rows.select("conv_id", "turn", F.round(F.coalesce(alike, F.lit(0.0)), 6).alias("similarity"))


@query(f"WITH {TURNS}, s AS (SELECT role, CASE WHEN length(text) > 300 THEN 1.0 WHEN length(text) > 60 THEN 0.75 ELSE 0.25 END AS score FROM turns) SELECT role AS dataset, count(*) AS n, round(avg(score), 6) AS pass_rate, count(*) FILTER (WHERE score < 0.5) AS regressions, CASE WHEN round(avg(score), 6) >= 0.8 AND count(*) FILTER (WHERE score < 0.5) = 0 THEN 'promote' WHEN round(avg(score), 6) >= 0.5 THEN 'hold' ELSE 'rollback' END AS decision FROM s GROUP BY 1")
def gate_verdict(spark, d):
    score = F.when(F.length("text") > 300, 1.0).when(F.length("text") > 60, 0.75).otherwise(0.25)
    return D.gate(read_table(spark, d, "conversations").select(F.col("role").alias("dataset"), score.alias("score")))


@query("SELECT user_id AS task_id, count(*) AS n_calls, count(*) FILTER (WHERE event_type = 'error') AS n_bad, CASE WHEN bool_or(event_type = 'error') THEN 'fail' ELSE 'pass' END AS verdict FROM events GROUP BY 1")
def task_verdict(spark, d):
    calls = roles.events(spark, d).select(F.col("user_id").alias("task_id"), F.when(F.col("event_type") == "error", "failed").alias("error"), F.lit(0).alias("exit_code"))
    return D.task_verdicts(calls)


@query("SELECT conv_id, count(*) AS n, string_agg(role || ':' || length(text), ' ' ORDER BY turn) AS trace FROM conversations GROUP BY 1")
def run_trace(spark, d):
    item = F.struct("turn", F.concat("role", F.lit(":"), F.length("text").cast("string")).alias("s"))
    rows = read_table(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(item)).alias("l"))
    return rows.select("conv_id", "n", F.array_join(F.transform("l", lambda x: x["s"]), " ").alias("trace"))


_PAGE_TAGS = ("script", "style", "nav")


@query("SELECT page_id, length(t) AS n_left FROM (SELECT page_id, trim(regexp_replace(" + "regexp_replace(" * 3 + "html" + "".join(f", '(?is)<{t}\\b[^>]*>.*?</{t}\\s*>', '', 'g')" for t in _PAGE_TAGS) + ", '(?i)</?(script|style|nav)\\b[^>]*>', '', 'g')) AS t FROM pages)")
def strip_blocks(spark, d):
    rows = read_table(spark, d, "pages").select("page_id", X.strip_scaffolding(F.col("html"), _PAGE_TAGS).alias("t"))
    return rows.select("page_id", F.length("t").cast("long").alias("n_left"))


@query("SELECT lang, count(*) AS n, sum(length(text) // 4 + 1)::BIGINT AS tokens, max(CASE WHEN length(text) > 120 THEN 117 + 3 ELSE length(text) END)::BIGINT AS longest_shown FROM documents GROUP BY 1")
def token_estimates(spark, d):
    return read_table(spark, d, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.sum(X.token_estimate(F.col("text"))).alias("tokens"), F.max(F.length(X.ellipsis(F.col("text")))).cast("long").alias("longest_shown"))


_AREAS = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(t, '{k}')" if " " in k or "-" in k else f"list_contains(w, '{k}')" for k in ks) + f" THEN '{slug}'" for _, slug, ks in L.LIFE_AREAS) + " ELSE 'personal' END"


@query(f"WITH x AS (SELECT conv_id, turn, lower(text) AS t, string_split_regex(lower(text), '[^\\p{{L}}\\p{{N}}_]+') AS w FROM conversations) SELECT {_AREAS} AS area, count(*) AS n FROM x GROUP BY 1")
def route_area(spark, d):
    return read_table(spark, d, "conversations").groupBy(X.route(F.col("text")).alias("area")).agg(F.count("*").alias("n"))


@query("SELECT conv_id, turn, length(text) AS n_user, n_next FROM (SELECT *, lead(length(text)) OVER w AS n_next, lead(role) OVER w AS next_role FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND next_role = 'assistant' AND NOT (length(text) < 20 AND n_next < 50)")
def turn_gate(spark, d):
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = read_table(spark, d, "conversations").withColumn("n_next", F.lead(F.length("text")).over(w)).withColumn("next_role", F.lead("role").over(w)).withColumn("n_user", F.length("text"))
    rows = rows.where("role = 'user' and next_role = 'assistant' and not (n_user < 20 and n_next < 50)")
    return rows.select("conv_id", "turn", F.col("n_user").cast("long").alias("n_user"), F.col("n_next").cast("long").alias("n_next"))


@query("SELECT conv_id, turn, substring(text, 1, 300) AS insight FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations WHERE role = 'user' AND length(text) > 20) WHERE k <= 5")
def session_insights(spark, d):
    rows = read_table(spark, d, "conversations").where("role = 'user' and length(text) > 20")
    return R.top_per_key(rows, ["conv_id"], ["turn"], 5).select("conv_id", "turn", F.substring("text", 1, 300).alias("insight"))


# Generic, not from the reference --------------------------------------------------------------------------------


@query("SELECT coalesce(event_type, '*') AS event_type, coalesce(day::VARCHAR, '*') AS day, count(*) AS n FROM (SELECT event_type, dayofmonth(ts) AS day FROM events) GROUP BY CUBE (event_type, day)")
def event_cube(spark, d):
    rows = roles.events(spark, d).select("event_type", F.dayofmonth("ts").alias("day")).cube("event_type", "day").agg(F.count("*").alias("n"))
    return rows.select(F.coalesce("event_type", F.lit("*")).alias("event_type"), F.coalesce(F.col("day").cast("string"), F.lit("*")).alias("day"), "n")


@query("SELECT coalesce(l_returnflag, '*') AS flag, coalesce(l_linestatus, '*') AS status, count(*) AS n, round(sum(l_extendedprice), 2) AS price FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def line_rollup(spark, d):
    rows = read_table(spark, d, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")), 2).cast("double").alias("price"))
    return rows.select(F.coalesce("l_returnflag", F.lit("*")).alias("flag"), F.coalesce("l_linestatus", F.lit("*")).alias("status"), "n", "price")


@query("SELECT o_custkey AS id, 'both' AS side FROM (SELECT o_custkey FROM orders INTERSECT SELECT user_id FROM events) UNION ALL SELECT o_custkey, 'orders' FROM (SELECT o_custkey FROM orders EXCEPT SELECT user_id FROM events)")
def set_operations(spark, d):
    a, b = read_table(spark, d, "orders").select(F.col("o_custkey").alias("id")), roles.events(spark, d).select(F.col("user_id").alias("id"))
    return a.intersect(b).withColumn("side", F.lit("both")).unionByName(a.subtract(b).withColumn("side", F.lit("orders")))


@query("SELECT coalesce(a.id, b.id) AS id, coalesce(a.n, 0) AS n_orders, coalesce(b.n, 0) AS n_events FROM (SELECT o_custkey AS id, count(*) AS n FROM orders GROUP BY 1) a FULL JOIN (SELECT user_id AS id, count(*) AS n FROM events GROUP BY 1) b ON a.id = b.id")
def merged_counts(spark, d):
    a = read_table(spark, d, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.count("*").alias("a"))
    b = roles.events(spark, d).groupBy(F.col("user_id").alias("id")).agg(F.count("*").alias("b"))
    return a.join(b, "id", "full").select("id", F.coalesce("a", F.lit(0)).alias("n_orders"), F.coalesce("b", F.lit(0)).alias("n_events"))


@query("SELECT w AS started, event_type, count(*) AS n FROM events, LATERAL (SELECT unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS w) GROUP BY 1, 2")
def sliding_windows(spark, d):
    rows = roles.events(spark, d).groupBy(F.window("ts", "1 hour", "30 minutes").alias("w"), "event_type").agg(F.count("*").alias("n"))
    return rows.select(F.col("w.start").alias("started"), "event_type", "n")


@query("SELECT user_id, count(*) FILTER (WHERE event_type = 'click') AS click, count(*) FILTER (WHERE event_type = 'error') AS error, count(*) FILTER (WHERE event_type = 'purchase') AS purchase FROM events GROUP BY 1")
def event_pivot(spark, d):
    rows = roles.events(spark, d).groupBy("user_id").pivot("event_type", ["click", "error", "purchase"]).agg(F.count("event_id"))
    return rows.select("user_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("click", "error", "purchase")])


@query("SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(stddev_samp(value), 6) AS sd FROM events GROUP BY 1")
def value_quantiles(spark, d):
    return roles.events(spark, d).groupBy("event_type").agg(F.round(F.expr("percentile(value, 0.5)"), 6).alias("p50"), F.round(F.stddev_samp("value"), 6).alias("sd"))
