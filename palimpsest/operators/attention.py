"""What gets attention and what doesn't: mentions of labels in what is said, gaps, neglect, latent goals, and reports.

What is said is cut into words once; labels meet it by equal words or runs of words, never by looking through every text for every label."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions import text as X
from palimpsest.operators import needles as N
from palimpsest.operators.relational import top_per_key
from palimpsest.operators.words import word_counts

#: Mentions from which on a label isn't neglected, severity a mention short of it and at most, and what kinds of labels begin with.
LOW_ATTENTION = 8
GAP_STEP, GAP_MOST = 0.1, 0.95
GAP_BASE = {"goal": 0.7, "value": 0.5}


def mentions(labels: DataFrame, said: DataFrame, id_col: str = "id", text_col: str = "content") -> DataFrame:
    """id, mentions: of a label's keywords the one that is said most often. labels: id, label; labels without a keyword are left out."""
    words = labels.select("id", F.explode(X.label_keywords(F.col("label"))).alias("word"))
    counts = word_counts(said, id_col, text_col).groupBy("word").agg(F.sum("n").alias("n"))
    return words.join(counts, "word", "left").groupBy("id").agg(F.coalesce(F.max("n"), F.lit(0)).alias("mentions"))


def alignment_gaps(labels: DataFrame, said: DataFrame, low: int = LOW_ATTENTION, id_col: str = "id", text_col: str = "content") -> DataFrame:
    """id, mentions, severity of labels (id, kind, label) that are mentioned less than `low` times; the fewer, the more severe."""
    base = F.create_map(*[F.lit(x) for pair in GAP_BASE.items() for x in pair])
    rows = labels.join(mentions(labels, said, id_col, text_col), "id").where(F.col("mentions") < low)
    return rows.select("id", "mentions", severity(F.try_element_at(base, F.col("kind")), F.col("mentions"), low).alias("severity"))


def severity(base: Column, mentions: Column, low: int = LOW_ATTENTION) -> Column:
    return F.round(F.least(base + GAP_STEP * (low - mentions), F.lit(GAP_MOST)), 2)


def unmentioned(names: DataFrame, said: DataFrame, name: str = "name", text_col: str = "content") -> DataFrame:
    """Rows whose name, as a run of whole words, isn't said; names without a word count as not said."""
    key = F.array_join(X.tokens(F.col(name)), " ")
    rows = names.withColumn("__name", F.when(key != "", F.concat(F.lit(" "), key, F.lit(" "))))
    met = N.said(said.select(N.word_line(F.col(text_col)).alias("text")), rows.select("__name")).select(F.col("needle").alias("__name"))
    return rows.join(met, "__name", "left_anti").drop("__name")


def mentioned_goals(goals: DataFrame, said: DataFrame, text_col: str = "content", chars: int = 20) -> DataFrame:
    """id, status: active if any text contains the first characters of the goal's statement, else stale. goals: id, statement."""
    heads = goals.select("id", F.lower(F.substring("statement", 1, chars)).alias("needle"))
    seen = N.said(said.select(F.lower(text_col).alias("text")), heads.select("needle")).withColumn("__seen", F.lit(True))
    return heads.join(seen, "needle", "left").select("id", F.when(F.col("__seen"), "active").otherwise("stale").alias("status"))


def mentioned_tools(said: DataFrame, tools: list[str], top: int = 3, id_col: str = "id", text_col: str = "content") -> DataFrame:
    """tool, n, confidence, finding: how many texts name each tool, the `top` of at least two; how sure that makes us of it as a trait and as a finding."""
    counts = word_counts(said, id_col, text_col).where(F.col("word").isin(*tools)).groupBy(F.col("word").alias("tool")).agg(F.count("*").alias("n")).where("n >= 2")
    rows = counts.orderBy(F.desc("n"), "tool").limit(top)
    return rows.select("tool", "n", F.round(F.least(0.5 + 0.1 * F.col("n"), F.lit(0.95)), 2).alias("confidence"), F.round(F.least(0.6 + 0.05 * F.col("n"), F.lit(0.9)), 2).alias("finding"))


def latent_goals(said: DataFrame, known: DataFrame, text_col: str = "content", least: int = 3, top: int = 4) -> DataFrame:
    """snippet, n: what stands behind verbs of intent in at least so many texts, the `top` most frequent, and is no goal yet (title)."""
    counts = said.select(F.explode(X.snippets(F.col(text_col))).alias("snippet")).groupBy("snippet").agg(F.count("*").alias("n"))
    best = counts.orderBy(F.desc("n"), "snippet").limit(top).where(F.col("n") >= least)
    return best.join(known.select(F.lower("title").alias("__t")), F.col("snippet") == F.col("__t"), "left_anti")


def audited_decisions(said: DataFrame, known: DataFrame, id_col: str = "id", text_col: str = "content", **options) -> DataFrame:
    """decision, id: what texts say was decided, each once with the first text that says so, as far as it isn't recorded (title)."""
    rows = said.select(F.col(id_col).alias("id"), F.explode(X.decisions(F.col(text_col), **options)).alias("decision"))
    new = rows.join(known.select(F.lower("title").alias("__t")).distinct(), F.lower("decision") == F.col("__t"), "left_anti")
    return new.groupBy("decision").agg(F.min("id").alias("id"))


def report(episodes: DataFrame, themes: DataFrame, goals: DataFrame, findings: DataFrame, since: Column, most: int) -> DataFrame:
    """scope, episodes_scanned, n_findings, findings (kind and statement, one after the other), summary: a reflection's report of each scope, of at most its `most` newest episodes.

    themes: scope, phrase, n; goals: scope, statement, status; findings: scope, statement, confidence. Scopes without an episode have no report."""
    scanned = top_per_key(episodes.where(F.col("created_at") >= since), ["scope"], [F.desc("created_at"), F.asc("id")], most).groupBy("scope").agg(F.count("*").alias("episodes_scanned"))
    row = lambda order, kind, statement, confidence: F.struct(F.lit(order).alias("order"), F.lit(kind).alias("kind"), statement.alias("statement"), F.round(confidence, 2).alias("confidence"))
    themed = F.concat(F.lit("Recurring theme: "), "phrase", F.lit(" ("), F.col("n").cast("string"), F.lit(" links)"))
    aimed = F.concat(F.lit("Goal '"), F.substring("statement", 1, 60), F.lit("' is "), "status")
    every = findings.select("scope", row(1, "finding", F.col("statement"), F.col("confidence")).alias("f"))
    every = every.unionByName(themes.select("scope", row(2, "theme", themed, F.least(0.5 + 0.05 * F.col("n"), F.lit(0.9))).alias("f")))
    every = every.unionByName(goals.select("scope", row(3, "goal", aimed, F.lit(0.7)).alias("f")))
    lists = every.groupBy("scope").agg(F.array_sort(F.collect_list("f")).alias("f"))
    out = scanned.join(lists, "scope", "left")
    n = F.coalesce(F.size("f"), F.lit(0))
    n = F.when(F.col("f").isNull(), 0).otherwise(n)
    said = F.array_join(F.transform("f", lambda x: F.concat(x["kind"], F.lit(" "), x["confidence"].cast("string"), F.lit(": "), x["statement"])), "; ")
    return out.select("scope", "episodes_scanned", n.cast("long").alias("n_findings"), F.coalesce(said, F.lit("")).alias("findings"), F.concat(n.cast("string"), F.lit(" findings of "), F.col("episodes_scanned").cast("string"), F.lit(" episodes")).alias("summary"))


def attention_view(gaps: DataFrame, neglected: DataFrame, breadth: DataFrame, load: DataFrame) -> DataFrame:
    """aspect, n, worst: one row for each part of the view. gaps: severity; neglected: degree; breadth: share; load: score."""
    part = lambda df, name, c: df.agg(F.count("*").alias("n"), F.round(F.max(c).cast("double"), 4).alias("worst")).select(F.lit(name).alias("aspect"), "n", "worst")
    return part(gaps, "gaps", "severity").unionByName(part(neglected, "neglected", "degree")).unionByName(part(breadth, "breadth", "share")).unionByName(part(load, "load", "score"))
