"""Queries over files: each writes some of the supplied rows in the shared folder in a source's format, and returns what the reader makes of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.plans.registry import query
from palimpsest.runtime import cut, read_table, shared_path
from palimpsest.sources import readers, roles, sinks
from palimpsest.streaming import projections as P


@query("SELECT 'shelf=' || (item_id % 3) AS top, count(*) AS n, sum(length(text))::BIGINT AS chars FROM (SELECT item_id, 'item ' || item_id || ' of ' || item_id % 7 AS text FROM benchmark) WHERE item_id % 3 <> 1 GROUP BY 1")
def vault_files(spark, d):
    """A tree of text files, of which one folder is left out."""
    b = read_table(spark, d, "benchmark")
    text = F.concat(F.lit("item "), F.col("item_id").cast("string"), F.lit(" of "), (F.col("item_id") % 7).cast("string"))
    b.select(text.alias("value"), (F.col("item_id") % 3).alias("shelf"), F.col("item_id").alias("item")).write.partitionBy("shelf", "item").text(path := shared_path(spark, "vault"))
    rows = readers.vault(spark, path, exclude=("shelf=1",), pattern="*.txt").withColumn("text", F.rtrim(F.col("text"), F.lit("\n")))
    return rows.groupBy("top").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("chars"))


@query("""WITH p AS (SELECT c_custkey AS id, c_custkey % 8 + 1 AS k FROM customer) SELECT id, CASE WHEN id % 2 = 0 THEN (k + 2) // 3 ELSE 2 * k END AS n_chunks, CASE WHEN id % 2 = 0 THEN least(k, 3) * 30 + (least(k, 3) - 1) * 2 ELSE 100 END AS longest FROM p""")
def paragraph_chunks(spark, d):
    """Texts of some paragraphs, packed: three short ones to a chunk, and long ones cut in two."""
    c = read_table(spark, d, "customer")
    k = (F.col("c_custkey") % 8 + 1).cast("int")
    short, long = F.array_repeat(F.repeat(F.lit("s"), 30), k), F.array_repeat(F.repeat(F.lit("l"), 190), k)
    text = F.when(F.col("c_custkey") % 2 == 0, F.array_join(short, "\n\n")).otherwise(F.array_join(long, "\n \n"))
    rows = c.select(F.col("c_custkey").alias("id"), readers.chunks(text, 100).alias("c"))
    return rows.select("id", F.size("c").cast("long").alias("n_chunks"), F.array_max(F.transform("c", lambda x: F.length(x))).cast("long").alias("longest"))


@query("""SELECT 'f' || (o_custkey % 5) AS source_file, count(*) AS n, count(DISTINCT o_orderpriority) AS objects, min('works_on') AS predicate, min('project') AS class FROM orders WHERE o_orderkey % 10 >= 5 GROUP BY 1""")
def triples_imported(spark, d):
    """Triples of several files by their file; those that are too uncertain are dropped."""
    o = read_table(spark, d, "orders")
    t = F.struct(F.col("o_custkey").cast("string").alias("subject"), F.lit("Works-On").alias("predicate"), F.col("o_orderpriority").alias("object"), (F.col("o_orderkey") % 10 / 10).alias("confidence"), F.concat(F.lit("f"), (F.col("o_custkey") % 5).cast("string")).alias("source_file"))
    # One JSON array a file, of a hundredth of the orders each.
    o.groupBy((F.col("o_orderkey") % 100).alias("k")).agg(F.to_json(F.collect_list(t)).alias("value")).write.partitionBy("k").text(path := shared_path(spark, "triples"))
    rows = readers.by_source(readers.triples(spark, path)).select("source_file", F.explode("triples").alias("t"))
    return rows.groupBy("source_file").agg(F.count("*").alias("n"), F.countDistinct("t.object").alias("objects"), F.min("t.predicate").alias("predicate"), F.min("t.class").alias("class"))


@query("SELECT vec_id AS id, vec_id % 3 = 0 AS had, round(embedding[1]::DOUBLE, 5) AS first FROM embeddings WHERE vec_id % 4 <> 1 OR vec_id % 3 = 0")
def vectors_filled(spark, d):
    """Vectors from lines of text for the items that have none; a job that is resumed writes only those that are left."""
    v = read_table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("id"), "embedding", F.lit("x").alias("text"))
    path = shared_path(spark, "vectors")
    asked = v.where("cast(id as long) % 4 <> 1")
    sinks.write_vectors_tsv(asked.where("cast(id as long) % 4 = 0"), path)
    sinks.write_vectors_tsv(cut(readers.not_done(asked, readers.vectors_tsv(spark, path))), path)
    items = v.select("id", F.when(F.col("id").cast("long") % 3 == 0, F.col("embedding")).alias("embedding"), (F.col("id").cast("long") % 3 == 0).alias("had"))
    rows = readers.fill_vectors(items, readers.vectors_tsv(spark, path)).where("embedding is not null")
    return rows.select(F.col("id").cast("long").alias("id"), "had", F.round(F.col("embedding")[0].cast("double"), 5).alias("first"))


@query("SELECT line FROM (SELECT 'line ' || event_id AS line, row_number() OVER (ORDER BY event_id DESC) AS k FROM events) WHERE k <= 25")
def last_log_lines(spark, d):
    """The end of a log of several files, each of a range of events."""
    e = roles.events(spark, d).repartitionByRange(4, "event_id").sortWithinPartitions("event_id")
    e.select(F.concat(F.lit("line "), F.col("event_id").cast("string")).alias("value")).write.text(path := shared_path(spark, "lines"))
    return readers.log_tail(spark, path, 25)


@query("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS scopes FROM events WHERE value > 200 GROUP BY 1")
def events_beside_rows(spark, d):
    """The events that are staged beside rows: one each, whose id says what it tells."""
    rows = roles.events(spark, d).where("value > 200").select(F.col("event_id").alias("id"), F.col("user_id").alias("scope"), "event_type")
    _, staged = sinks.with_events(rows.unionByName(rows), "fact.stored")
    told = staged.dropDuplicates(["id"]).select(F.get_json_object("data", "$.event_type").alias("event_type"), "scope")
    return told.groupBy("event_type").agg(F.count("*").alias("n"), F.countDistinct("scope").alias("scopes"))


@query("SELECT DISTINCT l_orderkey AS run_id FROM lineitem WHERE l_orderkey % 3 <> 0")
def delivered_once(spark, d):
    """Runs that wait for delivery, each once, without those that had theirs."""
    runs = read_table(spark, d, "lineitem").select(F.col("l_orderkey").alias("run_id"))
    return sinks.deliver_once(runs, read_table(spark, d, "orders").where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("run_id")))


@query("""WITH g AS (SELECT user_id, ts, coalesce(ts - lag(ts) OVER w >= INTERVAL 6 HOUR, true)::INT AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g),
x AS (SELECT user_id, min(ts) AS started, max(ts) + INTERVAL 6 HOUR AS ended, count(*) AS n FROM s GROUP BY user_id, k) SELECT user_id, started, n FROM x WHERE ended < (SELECT max(ts) - INTERVAL 2 DAY FROM events)""")
def stream_sessions(spark, d):
    """Sessions of a stream, as far as the watermark has closed them; those near it are left to the next run."""
    log = P.read_log(spark, P.write_log(roles.events(spark, d), shared_path(spark, "log")))
    out = P.append_table(P.sessions(log), shared_path(spark, "sessions"), shared_path(spark, "offsets"))
    last = roles.events(spark, d).agg(F.max("ts")).first()[0]
    rows = out.select("user_id", F.col("started").cast("timestamp_ntz").alias("started"), F.col("ended").cast("timestamp_ntz").alias("ended"), "n")
    return rows.where(F.col("ended") < F.lit(last) - F.expr("interval 2 days")).select("user_id", "started", "n")
