"""Queries through files, folders and streams: what is written is read back, and DuckDB computes it from the tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crowdweave.functions import records, scores, times
from crowdweave.operators import growth, merge
from crowdweave.plans.queries import query
from crowdweave.plans.roles import Roles
from crowdweave.sources import readers, sinks
from crowdweave.sources.shared import fresh_folder, written
from crowdweave.streaming import ingest

_SNAPSHOT = ["channel_id", "video_id", "viewer_id", "source_type", "first_seen", "last_seen", "appearances"]


@query("snapshots", """
    SELECT channel_id, video_id, viewer_id, source_type, CAST(first_seen AS TIMESTAMP) AS first_seen, CAST(CASE WHEN source_type = 'comment' THEN first_seen ELSE last_seen END AS TIMESTAMP) AS last_seen,
        CASE WHEN source_type = 'comment' THEN 1 ELSE appearances END AS appearances FROM snapshots""")
def presence_layouts(r: Roles) -> DataFrame:
    """Files of an old layout (viewer_hash, one timestamp, no count) for comments, of the new one for live chat."""
    path = fresh_folder(r.spark)
    rows = r.snapshots
    old = rows.where("source_type = 'comment'").select(F.col("channel_id").alias("creator_id"), "video_id", F.col("viewer_id").alias("viewer_hash"), "source_type", F.col("first_seen").cast("timestamp").alias("timestamp"))
    old.write.parquet(f"{path}/old/deep")
    new = rows.where("source_type <> 'comment'").withColumns({c: F.col(c).cast("timestamp") for c in ("first_seen", "last_seen")})
    new.write.parquet(f"{path}/new")
    found = readers.presence_files(r.spark, path).unionByName(readers.presence_files(r.spark, None))
    return readers.require_valid(found).select(*_SNAPSHOT)


@query("", """
    SELECT 'c' || s_suppkey AS creator_id, 'a' || s_suppkey AS account_id, CASE WHEN s_acctbal > 0 THEN s_name END AS display_name, 'e' || s_nationkey AS evidence_id, s_nationkey % 3 = 0 AS listed FROM supplier""")
def nested_registry(r: Roles) -> DataFrame:
    """Suppliers as a nested document of creators, accounts and evidence, joined again after it was read."""
    path = fresh_folder(r.spark)
    key = F.col("s_suppkey")
    evidence = F.concat(F.lit("e"), "s_nationkey")
    rows = r.table("supplier").select(
        F.struct(F.concat(F.lit("c"), key).alias("creator_id"), F.when(F.col("s_acctbal") > 0, F.col("s_name")).alias("display_name"), F.array(evidence).alias("evidence_ids")).alias("creator"),
        F.struct(F.concat(F.lit("a"), key).alias("account_id"), F.concat(F.lit("c"), key).alias("creator_id"), F.lit("youtube").alias("platform")).alias("account"),
        F.when(F.col("s_nationkey") % 3 == 0, F.struct(evidence.alias("evidence_id"))).alias("evidence"),
    )
    whole = rows.agg(F.collect_list("creator").alias("creators"), F.collect_list("account").alias("accounts"), F.collect_set("evidence").alias("evidence"))
    whole.select(F.to_json(F.struct("*")).alias("value")).write.text(path)
    doc = readers.creator_registry(r.spark, path)
    creators = doc["creators"].select("creator_id", "display_name", F.explode("evidence_ids").alias("evidence_id"))
    known = doc["evidence"].select("evidence_id", F.lit(True).alias("listed"))
    joined = doc["accounts"].select("account_id", "creator_id").join(creators, "creator_id").join(known, "evidence_id", "left")
    return joined.select("creator_id", "account_id", "display_name", "evidence_id", F.coalesce("listed", F.lit(False)).alias("listed"))


@query("snapshots", """
    SELECT channel_id, video_id, viewer_id, source_type, CAST(first_seen AS TIMESTAMP) AS timestamp, CASE WHEN channel_id < '000030' THEN 0 WHEN source_type = 'comment' THEN 1 ELSE 3 END AS tier
    FROM snapshots WHERE viewer_id <> ''""")
def archived_events(r: Roles) -> DataFrame:
    """Records of an archive and of an expanded collection, united; where both hold an event, the expanded one stays."""
    rows = r.snapshots.where("viewer_id <> ''")
    at = F.date_format("first_seen", "yyyy-MM-dd'T'HH:mm:ss'Z'")

    def archive(rows: DataFrame, path, viewer: str) -> DataFrame:
        record = F.to_json(F.struct("channel_id", "video_id", F.col("viewer_id").alias(viewer), "source_type", at.alias("timestamp")))
        return rows.select(path.alias("source_path"), F.lit("t").alias("source_table"), F.lit(1).alias("row_number"), record.alias("record_json"))

    old = archive(rows, F.when(F.col("source_type") == "comment", "deep/x").otherwise("live/x"), "viewer_hash")
    new = archive(rows.where("channel_id < '000030'"), F.lit("expanded-v1/x"), "viewer_id")
    broken = r.spark.range(5).select(F.lit("deep/x").alias("source_path"), F.lit("t").alias("source_table"), F.lit(1).alias("row_number"), F.lit("no json").alias("record_json"))
    both = readers.unified(readers.archive_events(old.unionByName(broken)), readers.archive_events(new))
    return both.where("viewer_id IS NOT NULL").select("channel_id", "video_id", "viewer_id", "source_type", "timestamp", "tier")


@query("", "SELECT DISTINCT 'UC' || lpad(CAST(page_id % 700 AS VARCHAR), 22, '0') AS channel_id FROM pages WHERE page_id % 3 <> 0")
def directory_links(r: Roles) -> DataFrame:
    """Pages with a link to a channel, or to something that is none."""
    good = F.concat(F.lit("https://www.youtube.com/channel/UC"), F.lpad((F.col("page_id") % 700).cast("string"), 22, "0"))
    link = F.when(F.col("page_id") % 3 != 0, good).otherwise("https://www.youtube.com/channel/UCshort")
    return readers.directory_channels(r.table("pages").select(F.concat("html", F.lit("<a href='"), link, F.lit("'>x</a>")).alias("html")))


@query("", "SELECT page_id AS id, url, i AS n FROM pages, range(0, 2) AS s(i) WHERE page_id % 4 <> 0 AND i <= page_id % 2")
def embedded_rows(r: Roles) -> DataFrame:
    """Rows that pages assign to a variable of their script."""
    rows = F.transform(F.sequence(F.lit(0), F.col("page_id") % 2), lambda i: F.struct(F.col("page_id").alias("id"), F.col("url").alias("url"), i.alias("n")))
    script = F.concat(F.lit("<script>var talents = "), F.to_json(rows), F.lit("; next();</script>"))
    html = F.when(F.col("page_id") % 4 != 0, F.concat("html", script)).otherwise(F.col("html"))
    return readers.embedded_json(r.table("pages").select(html.alias("html")), "talents", "id: bigint, url: string, n: bigint")


def _source(r: Roles, rows: DataFrame, batches: int = 2) -> DataFrame:
    """Rows as a stream of about so many batches, of many files each; ``_n`` deals the rows out."""
    folder = fresh_folder(r.spark)
    for n in range(batches):
        rows.where(F.pmod(F.col("_n"), F.lit(batches)) == n).drop("_n").write.mode("append").parquet(folder)
    files = len(r.spark.read.schema(rows.drop("_n").schema).parquet(folder).inputFiles())
    return r.spark.readStream.schema(rows.drop("_n").schema).option("maxFilesPerTrigger", max(1, -(-files // batches))).parquet(folder)


def _streamed(r: Roles, stream: DataFrame, write: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    """Send a stream to a foreachBatch function, to its end."""
    query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", fresh_folder(r.spark)).trigger(availableNow=True).start()
    query.awaitTermination()


@query("interactions", "SELECT creator_id, video_id, viewer_id, source_type FROM interactions")
def streamed_inserts(r: Roles) -> DataFrame:
    """All sightings, with repeats and rows of unknown sources, streamed into a table of unique keys."""
    path = fresh_folder(r.spark)
    rows = r.sightings.select("creator_id", "video_id", "viewer_id", "source_type", F.col("observed_at").cast("timestamp").alias("observed_at"))
    odd = rows.where("creator_id < '000010'").withColumn("source_type", F.lit("other"))
    numbered = rows.unionByName(odd).withColumn("_n", F.dayofmonth("observed_at"))
    _streamed(r, _source(r, numbered), ingest.insert_interactions(r.spark, path))
    return ingest.inserted(r.spark, path).select("creator_id", "video_id", "viewer_id", "source_type")


@query("snapshots", """
    SELECT channel_id, video_id, viewer_id, source_type, CAST(CASE WHEN appearances > 1 THEN first_seen - INTERVAL 1 DAY ELSE first_seen END AS TIMESTAMP) AS first_seen, CAST(last_seen AS TIMESTAMP) AS last_seen,
        CASE WHEN appearances > 1 THEN appearances + 3 ELSE appearances END AS appearances FROM snapshots WHERE viewer_id <> ''""")
def written_presence(r: Roles) -> DataFrame:
    """A presence table, and a second batch that saw some viewers earlier and more often, others less."""
    path = fresh_folder(r.spark)
    rows = written(r.snapshots.where("viewer_id <> ''").withColumns({c: F.col(c).cast("timestamp") for c in ("first_seen", "last_seen")}).select(*_SNAPSHOT))
    sinks.merge_presence(r.spark, path, rows)
    more = F.col("appearances") > 1
    later = rows.where("appearances > 1 OR video_id LIKE '%1'").withColumns({
        "first_seen": F.when(more, F.col("first_seen") - F.expr("INTERVAL 1 DAY")).otherwise(F.col("first_seen")), "last_seen": F.col("first_seen"),
        "appearances": F.when(more, F.col("appearances") + 3).otherwise(0),
    })
    sinks.merge_presence(r.spark, path, later)
    return r.spark.read.schema(rows.schema).parquet(path).select(*_SNAPSHOT)


@query("videos", """
    SELECT channel_id, video_id, CASE WHEN status = 'F' THEN comments + 1 ELSE comments END AS n FROM videos""")
def written_observations(r: Roles) -> DataFrame:
    """Observations of all videos, some of which were observed again."""
    path = fresh_folder(r.spark)
    rows = r.videos.select("channel_id", "video_id", F.col("comments").alias("n"), "status")
    sinks.write_observations(rows.drop("status"), path)
    sinks.write_observations(rows.where("status = 'F'").select("channel_id", "video_id", (F.col("n") + 1).alias("n")), path)
    return r.spark.read.parquet(path).select("channel_id", "video_id", "n")


@query("", """
    SELECT n_nationkey AS a, r_regionkey AS b, CASE WHEN n_regionkey = r_regionkey THEN 'live' ELSE 'seed' END AS source FROM nation, region WHERE n_regionkey = r_regionkey OR n_nationkey % 2 = 0""")
def derived_edges(r: Roles) -> DataFrame:
    """Seed edges stay where no edge was derived."""
    regions = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(4).cast("long")))
    seed = r.table("nation").where("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("a"), regions.alias("b"), F.lit("seed").alias("source"))
    live = r.table("nation").select(F.col("n_nationkey").alias("a"), F.col("n_regionkey").cast("long").alias("b"), F.lit("live").alias("source"))
    return merge.replace_derived(seed, live, ["a", "b"])


@query("", """
    WITH e AS (SELECT 'c' || user_id AS channel_id, strftime(min(ts), '%Y-%m-%d') AS first_date, strftime(max(ts), '%Y-%m-%d') AS last_date, count(*) AS history_points FROM events GROUP BY user_id)
    SELECT channel_id, CASE WHEN old AND NOT long THEN 'old' ELSE first_date END AS first_date, CASE WHEN old AND NOT long THEN 'old' ELSE last_date END AS last_date, CASE WHEN old AND NOT long THEN 1 ELSE history_points END AS history_points
    FROM (SELECT *, history_points % 2 = 0 AS old, CAST(last_date AS DATE) - CAST(first_date AS DATE) >= 25 AS long FROM e)""")
def merged_growth(r: Roles) -> DataFrame:
    """Growth rows replaced once their history is long enough."""
    new = r.table("events").groupBy(F.concat(F.lit("c"), "user_id").alias("channel_id")).agg(
        F.date_format(F.min("ts"), "yyyy-MM-dd").alias("first_date"), F.date_format(F.max("ts"), "yyyy-MM-dd").alias("last_date"), F.count(F.lit(1)).alias("history_points")
    )
    old = new.where("history_points % 2 = 0").select("channel_id", F.lit("old").alias("first_date"), F.lit("old").alias("last_date"), F.lit(1).cast("long").alias("history_points"))
    return growth.merge_growth(old, new, 25)


@query("", """
    SELECT CASE WHEN c_acctbal > 0 THEN 'intake' ELSE 'quarantine' END AS place, c_custkey AS id, CASE WHEN c_mktsegment <> 'BUILDING' THEN c_mktsegment ELSE CASE WHEN c_acctbal > 0 THEN 'none' END END AS segment FROM customer""")
def intake_files(r: Roles) -> DataFrame:
    """Confirmed rows as JSON, the others as CSV, read back from both."""
    path = fresh_folder(r.spark)
    rows = r.table("customer").select(F.col("c_custkey").alias("id"), F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment")).alias("segment"), F.when(F.col("c_acctbal") > 0, "CONFIRMED").alias("status"))
    sinks.write_intake(rows, path, F.col("status") == "CONFIRMED", ["id", "segment"])
    sure = r.spark.read.schema("id long, segment string").json(f"{path}/intake").select(F.lit("intake").alias("place"), "id", F.coalesce("segment", F.lit("none")).alias("segment"))
    rest = r.spark.read.option("header", True).csv(f"{path}/quarantine").select(F.lit("quarantine").alias("place"), F.col("id").cast("long").alias("id"), "segment")
    return sure.unionByName(rest)


@query("", "SELECT p_partkey AS id, p_name AS name, CASE WHEN p_size > 25 THEN p_size END AS n FROM part")
def catalog_files(r: Roles) -> DataFrame:
    """A catalogue written twice; its CSV form is read back."""
    path = fresh_folder(r.spark)
    table = sinks.write_catalog(r.table("part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.when(F.col("p_size") > 25, F.col("p_size")).alias("n")), path)
    return r.spark.read.schema(table.schema).option("header", True).csv(f"{path}/csv")


@query("videos", """
    SELECT video_id, 'UC' || lpad(substr(video_id, 2), 22, '0') AS channel_id, CASE WHEN seconds % 3 = 0 THEN '@name' || seconds ELSE '' END AS handle,
        CASE WHEN status = 'F' THEN 'Polygon' WHEN status = 'O' THEN 'Lumina' ELSE 'Independent' END AS agency, comments % 2 = 0 AS graduated FROM videos""")
def wiki_entries(r: Roles) -> DataFrame:
    """Pages of a wiki about channels: infoboxes with a group, a state, and links."""
    number = F.substring("video_id", 2, 20)
    text = F.concat(
        F.lit("{{Infobox\n|status = "), F.when(F.col("comments") % 2 == 0, "Retired 2020").otherwise("Active"), F.lit("\n|affiliation= "),
        F.when(F.col("status") == "F", "ex polygon (2nd)").when(F.col("status") == "O", "LUMINA").otherwise("none"), F.lit("\n}} [https://www.youtube.com/channel/UC"), F.lpad(number, 22, "0"), F.lit(" x] "),
        F.when(F.col("seconds") % 3 == 0, F.concat(F.lit("https://youtube.com/@name"), "seconds")).otherwise(""),
    )
    return r.videos.select("video_id", records.wiki_entry(text).alias("w")).select("video_id", "w.channel_id", "w.handle", "w.agency", F.coalesce("w.graduated", F.lit(False)).alias("graduated"))


@query("", """
    SELECT c_custkey AS id, CASE WHEN c_nationkey % 3 = 0 THEN 'B ' || c_custkey || '|s' || c_nationkey WHEN c_nationkey % 3 = 1 THEN 's' || c_nationkey ELSE '' END AS names,
        CASE WHEN c_custkey % 2 = 0 THEN 'UU' || c_custkey END AS playlist, CASE WHEN c_acctbal >= 0 THEN CAST(round(c_acctbal * 1000) AS BIGINT) END AS number,
        least(3600, CAST(60 * pow(2, c_nationkey) AS BIGINT)) AS wait FROM customer""")
def small_texts(r: Roles) -> DataFrame:
    """Earlier names in notes, playlists of uploads, numbers with separators, waiting times."""
    nation = F.col("c_nationkey")
    note = F.when(nation % 3 < 2, F.concat(F.lit("x; renamed_from_slug=s"), nation, F.when(nation % 3 == 0, F.concat(F.lit("; renamed_from=B "), "c_custkey", F.lit(" (2020); renamed_from_slug=s"), nation)).otherwise("")))
    channel = F.concat(F.when(F.col("c_custkey") % 2 == 0, "UC").otherwise("XX"), "c_custkey")
    number = F.when(F.col("c_acctbal") >= 0, F.concat(F.lit(" "), F.format_number(F.round(F.col("c_acctbal") * 1000), 0))).otherwise("n/a")
    return r.table("customer").select(
        F.col("c_custkey").alias("id"), F.array_join(records.earlier_names(note), "|").alias("names"), records.uploads_playlist(channel).alias("playlist"),
        scores.lenient_int(number).alias("number"), times.backoff(nation + 1).alias("wait"),
    )


@query("", """
    SELECT 'v' || l_orderkey AS video_id, 'u' || l_suppkey AS viewer_id, CAST(min(l_shipdate) AS TIMESTAMP) AS first_at, CAST(max(l_shipdate) AS TIMESTAMP) AS last_at, count(*) AS appearances FROM lineitem GROUP BY 1, 2""")
def streamed_viewers(r: Roles) -> DataFrame:
    """First and last time and count of each viewer and video, kept over the batches of a stream."""
    path = fresh_folder(r.spark)
    rows = r.table("lineitem").select(
        F.concat(F.lit("v"), "l_orderkey").alias("video_id"), F.concat(F.lit("u"), "l_suppkey").alias("viewer_id"), F.col("l_shipdate").cast("timestamp").alias("interaction_at"), F.col("l_linenumber").alias("_n")
    )

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    _streamed(r, ingest.viewer_state(_source(r, rows)), write, "update")
    newest = r.spark.read.parquet(path).groupBy("video_id", "viewer_id").agg(F.max_by(F.struct("first_at", "last_at", "appearances"), "batch").alias("s"))
    return newest.select("video_id", "viewer_id", "s.first_at", "s.last_at", F.col("s.appearances").alias("appearances"))


@query("", """
    WITH c AS (SELECT p_partkey AS k, p_size AS n, p_brand AS b FROM part)
    SELECT batch_id, id, action FROM (
        SELECT 0 AS batch_id, 'p' || k AS id, CASE WHEN n > 40 THEN 'added' WHEN n % 2 = 0 THEN 'updated' ELSE 'unchanged' END AS action FROM c
        UNION ALL SELECT 1, 'p' || k, 'unchanged' FROM c WHERE n > 20)""")
def streamed_changes(r: Roles) -> DataFrame:
    """Change files as two batches of a stream, the first sent twice; the ledger says what each row did."""
    table, ledger = sinks.Table(r.spark, fresh_folder(r.spark)), sinks.Table(r.spark, fresh_folder(r.spark))
    key = F.concat(F.lit("p"), "p_partkey").alias("id")
    parts = r.table("part")
    table.write(parts.where("p_size <= 40").select(key, F.when(F.col("p_size") % 2 == 0, "old").otherwise(F.col("p_brand")).alias("brand")))
    change = ingest.change_files(table, ledger, "id")
    first, second = parts.select(key, F.col("p_brand").alias("brand")), parts.where("p_size > 20").select(key, F.col("p_brand").alias("brand"))
    for number, rows in ((0, first), (0, first), (1, second)):
        change(rows, number)
    return ledger.read().select(F.col("batch_id").cast("int").alias("batch_id"), "id", "action")
