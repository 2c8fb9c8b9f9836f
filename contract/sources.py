"""Sources, sinks and streams (survey 2.1, 2.9). Files are derived from the tables and read back."""

from pyspark.sql import functions as F

from contract import views
from contract.base import query
from contract.registry import candidate_batch, registry_table
from contract.views import table, with_views
from mediaquery.operators import filters
from mediaquery.session import scratch_path
from mediaquery.sources import tables
from mediaquery.streaming import streams

C = F.col


@query("scan_manifest", "A01 A06", with_views("material", body="""SELECT CASE WHEN video_id % 19 = 5 THEN NULL ELSE video_id::VARCHAR END AS video_id,
 CASE WHEN video_id % 4 = 1 THEN 'first "line",' || chr(10) || path ELSE path END AS path, 'c' || category AS category, CASE WHEN video_id % 13 = 0 OR video_id % 11 = 0 THEN '' ELSE lpad(video_id::VARCHAR, 24, '0') END AS note_id,
 CASE video_id % 17 WHEN 3 THEN NULL WHEN 4 THEN NULL WHEN 5 THEN true WHEN 6 THEN false ELSE enabled END AS enabled,
 nullif(concat_ws('; ', CASE WHEN video_id % 19 = 5 THEN 'video_id: missing' END, CASE video_id % 17 WHEN 3 THEN 'enabled: not a flag: maybe' WHEN 4 THEN 'enabled: not a flag: ' END), '') AS error FROM material"""))
def _(s, sf):
    m = filters.parse_material_names(views.material(s, sf)).withColumn("category", F.concat(F.lit("c"), C("category").cast("string"))).fillna("", ["note_id", "author"])
    # quoted line breaks, missing ids, and flags that are unknown, empty or in another spelling
    flag = F.expr("case video_id % 17 when 3 then 'maybe' when 4 then '' when 5 then 'YES' when 6 then 'Off' else cast(enabled as string) end")
    m = m.withColumns({"path": F.expr("""if(video_id % 4 = 1, concat('first "line",\n', path), path)"""), "enabled": flag, "video_id": F.expr("if(video_id % 19 = 5, null, video_id)")})
    path = scratch_path(s, "manifest")
    tables.write_manifest(m, path)
    return tables.scan_manifest(s, path).select("video_id", "path", "category", "note_id", "enabled", "error")


@query("scan_media_listing", "A02")
def _(s, sf):
    return tables.scan_media_listing(s, sf, ["parquet"]).select(F.substring_index("path", "/", -1).alias("name"), "length")


@query("content_fingerprint", "H15")
def _(s, sf):
    listing = tables.scan_media_listing(s, sf, ["parquet"])
    return tables.content_fingerprints(listing).select(F.substring_index("path", "/", -1).alias("name"), "length", "fingerprint")


@query("scan_candidate_pool", "A03 A07", with_views("cand", more={
    "d": "SELECT *, category || '-' || candidate_id // 1000 AS doc, (category + candidate_id // 1000) % 5 AS k FROM cand"}, body="""
SELECT CASE WHEN k = 3 THEN 'other' ELSE 'c' || category END AS category, candidate_id::VARCHAR AS candidate_id, video_id::VARCHAR AS video_id, event, start_ms / 1000 AS start, end_ms / 1000 AS "end",
 aesthetic, confidence, NULL::VARCHAR AS error FROM d WHERE k NOT IN (1, 2)
UNION ALL SELECT 'other', NULL, NULL, NULL, NULL, NULL, NULL, NULL, 'not a JSON object' FROM (SELECT DISTINCT doc FROM d WHERE k IN (1, 2))"""))
def _(s, sf):
    c = views.cand(s, sf)
    window = F.struct((C("start_ms") / 1000).alias("start"), (C("end_ms") / 1000).alias("end"))
    rows = c.select(C("category").alias("g"), C("candidate_id").cast("string").alias("candidate_id"), C("video_id").cast("string").alias("video_id"), "event",
                    window.alias("source_window"), window.alias("preferred_trim"), F.create_map(F.lit("aesthetic"), C("aesthetic")).alias("scores"), "confidence", C("candidate_id").alias("n"))
    documents = tables.pool_documents(rows, F.floor(C("n") / 1000), ("g",))
    # indented documents in files of their own: some cut short, some in a list, some without a category
    kind = (C("g") + C("page")) % 5
    body = F.to_json(F.struct(F.when(kind != 3, F.concat(F.lit("c"), C("g").cast("string"))).alias("category"), "candidates"), {"pretty": "true"})
    value = F.when(kind == 1, F.expr("left(body, cast(length(body) * 0.7 as int))")).when(kind == 2, F.concat(F.lit("[\n"), C("body"), F.lit("\n]"))).otherwise(C("body"))
    path = scratch_path(s, "pool")
    documents.withColumn("body", body).select(value.alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    return tables.scan_candidate_pool(s, path, "other").select(
        "category", "candidate_id", "video_id", "event", C("source_window.start").alias("start"), C("source_window.end").alias("end"), C("scores")["aesthetic"].alias("aesthetic"), "confidence", "error")


@query("scan_pool_lines", "A03 A07", with_views("cand", body="""SELECT 'c' || category AS category, candidate_id::VARCHAR AS candidate_id, start_ms / 1000 AS start, aesthetic, confidence FROM cand"""))
def _(s, sf):
    window = F.struct((C("start_ms") / 1000).alias("start"), (C("end_ms") / 1000).alias("end"))
    rows = views.cand(s, sf).select(F.concat(F.lit("c"), C("category").cast("string")).alias("category"), C("candidate_id").cast("string").alias("candidate_id"), window.alias("source_window"),
                                    F.create_map(F.lit("aesthetic"), C("aesthetic")).alias("scores"), "confidence", C("candidate_id").alias("n"))
    path = scratch_path(s, "pool")
    tables.write_documents(tables.pool_documents(rows, F.floor(C("n") / 1000)), path)
    return tables.scan_candidate_pool(s, path, layout="lines").select("category", "candidate_id", C("source_window.start").alias("start"), C("scores")["aesthetic"].alias("aesthetic"), "confidence")


DOCUMENTS = """WITH d AS (SELECT user_id // 10 AS g, user_id // 10 % 7 AS k, count(*) AS n, sum(event_id)::BIGINT AS ids FROM events GROUP BY ALL)
SELECT CASE WHEN k IN (1, 2, 3) THEN NULL ELSE 'v' || g END AS video_id, k NOT IN (1, 2) AS valid, CASE WHEN k NOT IN (1, 2) THEN n END AS events, CASE WHEN k NOT IN (1, 2) THEN ids END AS ids,
 CASE WHEN k IN (1, 2) THEN 'not a JSON object' END AS error FROM d"""


def analysis_documents(s, sf):
    """One document for ten users with all their events; some cut short, some lists, some without an id."""
    rows = table(s, sf, "events").groupBy(F.floor(C("user_id") / 10).alias("g")).agg(F.collect_list(F.struct("event_id", "event_type")).alias("events")).withColumn("k", C("g") % 7)
    body = F.to_json(F.struct(F.when(C("k") != 3, F.concat(F.lit("v"), C("g").cast("string"))).alias("video_id"), "events"), {"pretty": "true"})
    value = F.when(C("k") == 1, F.expr("left(body, length(body) - 2)")).when(C("k") == 2, F.concat(F.lit("["), C("body"), F.lit("]"))).otherwise(C("body"))
    return rows.withColumn("body", body).select("g", value.alias("value"))


def analysis_rows(docs):
    named = F.when(C("valid") & C("video_id").startswith("v"), C("video_id"))  # else the name of a file that Spark wrote
    return docs.select(named.alias("video_id"), "valid", F.when(C("valid"), F.size("events")).cast("long").alias("events"), F.when(C("valid"), F.aggregate("events", F.lit(0).cast("long"), lambda a, x: a + x["event_id"])).alias("ids"), "error")


@query("scan_analysis_documents", "A04", DOCUMENTS)
def _(s, sf):
    path = scratch_path(s, "raw")
    analysis_documents(s, sf).write.partitionBy("g").text(path)
    return analysis_rows(tables.scan_analysis_documents(s, path, "video_id string, events array<struct<event_id: bigint, event_type: string>>"))


@query("scan_document_lines", "A04", DOCUMENTS)
def _(s, sf):
    path = scratch_path(s, "raw")
    analysis_documents(s, sf).select(F.regexp_replace("value", r"\n\s*", "").alias("value")).write.text(path)
    return analysis_rows(tables.scan_analysis_documents(s, path, "video_id string, events array<struct<event_id: bigint, event_type: string>>", layout="lines"))


@query("asset_index", "A05", """WITH u AS (SELECT 'as' || p_partkey % 700 AS asset_id, 'product_openpages' AS section, p_name AS path, 0 AS o, p_partkey AS ordinal FROM part UNION ALL
 SELECT 'as' || s_suppkey, 'brand_assets', s_name, 2, s_suppkey FROM supplier UNION ALL SELECT 'as' || c_custkey * 3, 'product_recordings', c_name, 1, c_custkey FROM customer UNION ALL
 SELECT 'as' || n_nationkey, 'fonts', n_name, 4, n_nationkey FROM nation UNION ALL SELECT 'as' || r_regionkey * 40, 'overlay_assets', r_name, 3, r_regionkey FROM region)
SELECT asset_id, section, path FROM u QUALIFY row_number() OVER (PARTITION BY asset_id ORDER BY o DESC, ordinal DESC) = 1""")
def _(s, sf):
    part = lambda t, e: table(s, sf, t).selectExpr(*e)
    sections = {
        "product_openpages": part("part", ["concat('as', p_partkey % 700) asset_id", "p_name path", "cast(p_partkey as bigint) ordinal"]),
        "product_recordings": part("customer", ["concat('as', c_custkey * 3) asset_id", "c_name path", "cast(c_custkey as bigint) ordinal"]),
        "brand_assets": part("supplier", ["concat('as', s_suppkey) asset_id", "s_name path", "cast(s_suppkey as bigint) ordinal"]),
        "overlay_assets": part("region", ["concat('as', r_regionkey * 40) asset_id", "r_name path", "cast(r_regionkey as bigint) ordinal"]),
        "fonts": part("nation", ["concat('as', n_nationkey) asset_id", "n_name path", "cast(n_nationkey as bigint) ordinal"]),
    }
    return tables.asset_index(sections).select("asset_id", "section", "path")


@query("registry_tables", "A08", """SELECT p_partkey AS candidate_id, p_brand AS category, p_size * 10 + 1 AS start_ms FROM part""")
def _(s, sf):
    store = tables.SnapshotTable(s, scratch_path(s, "registry"), ["category"])
    rows = registry_table(s, sf).select("candidate_id", "category", "start_ms")
    store.write(rows)
    store.write(store.read().withColumn("start_ms", C("start_ms") + 1))
    return store.read().select("candidate_id", C("category").cast("string").alias("category"), "start_ms")


UPSERTED = """WITH b AS (SELECT user_id * 17 AS id, count(*) AS n, max(event_id) * 3 AS pk FROM events GROUP BY 1)
SELECT id AS candidate_id, n AS analysis_count, pk AS peak_ms FROM b"""


@query("stream_register", "S01", UPSERTED)
def _(s, sf):
    root = scratch_path(s, "stream")
    candidate_batch(s, sf).repartitionByRange(4, "seq").write.parquet(f"{root}/in")
    source = s.readStream.schema(candidate_batch(s, sf).schema).option("maxFilesPerTrigger", 2).parquet(f"{root}/in")
    empty = registry_table(s, sf).limit(0)
    streams.stream_register(source, f"{root}/registry", empty, f"{root}/checkpoint", buckets=8).awaitTermination()
    kept = empty.withColumns({"first_seq": C("peak_ms"), "last_seq": C("peak_ms")})
    return streams.read_buckets(s, f"{root}/registry", kept).select("candidate_id", "analysis_count", "peak_ms")


LEDGER = """SELECT l_partkey AS candidate_id, o_custkey AS run_id, l_orderkey AS creative_id, bool_or(o_orderstatus = 'F') AS f, bool_or(o_orderstatus = 'P') AS p FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1, 2, 3"""


@query("stream_usage_state", "S02", f"""SELECT candidate_id, count(*) AS selected_count, count(*) FILTER (f) AS exported_count FROM ({LEDGER}) GROUP BY 1""")
def _(s, sf):
    root = scratch_path(s, "usage")
    lines = table(s, sf, "lineitem").join(table(s, sf, "orders"), C("o_orderkey") == C("l_orderkey")).selectExpr("l_partkey candidate_id", "o_custkey run_id", "l_orderkey creative_id", "o_orderstatus st")
    # a reservation for every line and a decision for those of closed orders, out of one join; a row group is read by one task, so they are small
    events = lines.selectExpr("*", "explode(if(st <> 'O', array(1, 2), array(1))) seq").selectExpr(
        "candidate_id", "run_id", "creative_id", "case when seq = 1 then 'reserved' when st = 'F' then 'committed' else 'released' end action", "seq")
    events.repartition(32).write.option("parquet.block.size", 16 << 20).parquet(f"{root}/in")
    source = s.readStream.schema("candidate_id long, run_id long, creative_id long, action string, seq int").option("maxFilesPerTrigger", 16).parquet(f"{root}/in")
    buckets = int(s.conf.get("spark.sql.shuffle.partitions"))
    source.writeStream.foreachBatch(lambda df, n: streams.stream_usage_state(df, f"{root}/out", n, buckets)).option(
        "checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    latest = streams.read_usage_state(s, f"{root}/out")
    return streams.usage_counts(latest)


@query("stream_run_monitor", "S03", """SELECT user_id AS run_id, epoch_us(ts) // 15000000 * 15 AS window_start, count(*) AS events, count(*) FILTER (event_type = 'error') AS failed, count(*) FILTER (event_type = 'purchase') AS committed,
 bool_or(event_type = 'error') AS alert FROM events GROUP BY 1, 2""")
def _(s, sf):
    root = scratch_path(s, "monitor")
    table(s, sf, "events").selectExpr("user_id run_id", "cast(ts as timestamp) at", "case event_type when 'error' then 'failed' when 'purchase' then 'committed' else 'open' end status").write.parquet(f"{root}/in")
    source = s.readStream.schema("run_id long, at timestamp, status string").parquet(f"{root}/in")
    seen = streams.stream_run_monitor(source)
    # Update mode: each refresh rewrites a window's row, the last batch of a window is its final value.
    seen.writeStream.foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{root}/out/batch={n}")).outputMode("update").option(
        "checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    out = s.read.parquet(f"{root}/out").groupBy("run_id", "window_start").agg(F.max_by(F.struct("events", "failed", "committed", "alert"), "batch").alias("x"))
    return out.select("run_id", F.unix_seconds("window_start").alias("window_start"), "x.*")
