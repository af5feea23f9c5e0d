"""The domain's tables, derived from the synthetic star schema: as DataFrames, and as DuckDB SQL for the oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Roles:
    """Tables of one folder. Each property is a lazy DataFrame; nothing is read before a query needs it."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @property
    def _seen(self) -> DataFrame:
        """Lines with their orders, beside the columns of sightings; ``l_orderkey`` tells the video."""
        items = self.table("lineitem").select("l_orderkey", "l_suppkey", "l_returnflag", "l_shipdate")
        joined = items.join(self.table("orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
        return joined.select(
            "l_orderkey", F.lpad(F.col("l_suppkey").cast("string"), 6, "0").alias("creator_id"), F.concat(F.lit("v"), F.col("l_orderkey")).alias("video_id"),
            F.when(F.col("o_custkey") % 97 == 0, " ").otherwise(F.concat(F.lit("u"), F.col("o_custkey"))).alias("viewer_id"),
            F.when(F.col("l_returnflag") == "R", "comment").otherwise("live_chat").alias("source_type"), F.col("l_shipdate").alias("observed_at"),
        )

    @property
    def sightings(self) -> DataFrame:
        """Raw presence rows, with repeats; every 97th viewer is blank."""
        return self._seen.drop("l_orderkey")

    @property
    def dealt(self) -> DataFrame:
        """Sightings by creator and viewer: later groups by both need no other shuffle. Enough where repeats do not count."""
        return self.sightings.repartition("creator_id", "viewer_id")

    @property
    def interactions(self) -> DataFrame:
        """Presence facts, unique by creator, video, viewer and source."""
        return self.dealt.groupBy("creator_id", "video_id", "viewer_id", "source_type").agg(F.min("observed_at").alias("observed_at"))

    @property
    def facts(self) -> DataFrame:
        """Creator, viewer and source of each interaction. Told apart by the key of the join, by which rows are already dealt,
        so that counting interactions deals nothing anew."""
        return self._seen.select("l_orderkey", "creator_id", "viewer_id", "source_type").distinct().drop("l_orderkey")

    @property
    def snapshots(self) -> DataFrame:
        """Presence with first and last time and appearances."""
        trimmed = self.sightings.withColumn("viewer_id", F.trim("viewer_id")).repartition("creator_id", "viewer_id")
        grouped = trimmed.groupBy("creator_id", "video_id", "viewer_id", "source_type")
        out = grouped.agg(F.min("observed_at").alias("first_seen"), F.max("observed_at").alias("last_seen"), F.count(F.lit(1)).alias("appearances"))
        return out.select(F.col("creator_id").alias("channel_id"), "video_id", "viewer_id", "source_type", "first_seen", "last_seen", "appearances")

    @property
    def accounts(self) -> DataFrame:
        key = F.col("c_custkey")
        platform = F.when(F.col("c_mktsegment").isin("BUILDING", "FURNITURE"), "youtube").when(F.col("c_mktsegment") == "AUTOMOBILE", "twitch").when(F.col("c_mktsegment") == "MACHINERY", "tiktok").otherwise("x")
        return self.table("customer").select(
            F.concat(F.lit("acc"), key).alias("id"), platform.alias("platform"), F.when(key % 13 != 0, F.lpad(key.cast("string"), 6, "0")).alias("platform_id"),
            F.when(key % 7 == 0, "").when(key % 11 == 0, None).otherwise(F.concat(F.lit("@H"), key)).alias("handle"), F.col("c_name").alias("name"),
            F.concat(F.lit("https://example.org/"), key).alias("url"), F.lit("2024-01-01").alias("first_discovered_at"),
        )

    @property
    def personas(self) -> DataFrame:
        key = F.col("s_suppkey")
        status = F.when(F.col("s_acctbal") > 4000, "verified").when(F.col("s_acctbal") > 0, "pending").otherwise("rejected")
        return self.table("supplier").select(F.concat(F.lit("per"), key).alias("id"), F.when(key % 5 != 0, F.col("s_name")).alias("canonical_name"), status.alias("review_status"))

    @property
    def links(self) -> DataFrame:
        key = F.col("o_orderkey")
        status = F.when(F.col("o_orderstatus") == "F", "verified").when(F.col("o_orderstatus") == "O", "pending").otherwise("rejected")
        return self.table("orders").select(
            F.concat(F.lit("lnk"), key).alias("id"), F.concat(F.lit("acc"), F.col("o_custkey")).alias("account_id"), F.concat(F.lit("per"), key % 97).alias("persona_id"),
            status.alias("review_status"), F.when(key % 9 != 0, F.date_format("o_orderdate", "yyyy-MM-dd")).alias("reviewed_at"),
        )

    @property
    def legacy(self) -> DataFrame:
        key = F.col("o_orderkey")
        claims = self.table("orders").where("o_orderpriority = '1-URGENT' and o_orderstatus = 'P'")
        return claims.select(
            F.concat(F.lit("leg"), key).alias("id"), F.concat(F.lit("acc"), F.col("o_custkey")).alias("account_id"),
            F.when(key % 4 == 0, "").otherwise(F.concat(F.lit("agency"), key % 6)).alias("source_agency"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("source_checked_at"),
        )

    @property
    def affiliations(self) -> DataFrame:
        joined = self.table("supplier").join(F.broadcast(self.table("nation")), F.col("s_nationkey") == F.col("n_nationkey"))
        return joined.select(
            F.concat(F.lit("aff"), F.col("s_suppkey")).alias("id"), F.concat(F.lit("per"), F.col("s_suppkey")).alias("persona_id"), F.col("n_name").alias("organization"),
            F.when(F.col("s_suppkey") % 3 != 0, "verified").otherwise("pending").alias("review_status"),
        )

    @property
    def channel_metrics(self) -> DataFrame:
        """Running totals per channel and day; subscribers are hidden on days that 7 divides."""
        from pyspark.sql import Window

        days = self.table("events").groupBy(F.concat(F.lit("c"), F.col("user_id")).alias("channel_id"), F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(
            F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents")
        )
        so_far = Window.partitionBy("channel_id").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
        return days.select(
            "channel_id", "day", F.when(F.substring("day", 9, 2).cast("int") % 7 != 0, F.sum("n").over(so_far)).alias("subscribers"), F.sum("cents").over(so_far).alias("views")
        )

    @property
    def videos(self) -> DataFrame:
        """Videos with channel, date, length and comments, from orders."""
        key = F.col("o_orderkey")
        return self.table("orders").select(
            F.concat(F.lit("v"), key).alias("video_id"), F.concat(F.lit("c"), F.col("o_custkey") % 50).alias("channel_id"),
            F.when(key % 17 != 0, F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("published_at"), F.year("o_orderdate").alias("year"),
            (key % 400).cast("int").alias("seconds"), F.round("o_totalprice").cast("long").alias("comments"), F.col("o_orderpriority").alias("title"), F.col("o_orderstatus").alias("status"),
        )


#: The same tables in DuckDB SQL.
ROLE_SQL = {
    "sightings": """
        SELECT lpad(CAST(l_suppkey AS VARCHAR), 6, '0') AS creator_id, 'v' || l_orderkey AS video_id,
            CASE WHEN o_custkey % 97 = 0 THEN ' ' ELSE 'u' || o_custkey END AS viewer_id,
            CASE WHEN l_returnflag = 'R' THEN 'comment' ELSE 'live_chat' END AS source_type, l_shipdate AS observed_at
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "interactions": """
        SELECT creator_id, video_id, viewer_id, source_type, min(observed_at) AS observed_at FROM sightings GROUP BY ALL""",
    "snapshots": """
        SELECT creator_id AS channel_id, video_id, trim(viewer_id) AS viewer_id, source_type, min(observed_at) AS first_seen,
            max(observed_at) AS last_seen, count(*) AS appearances FROM sightings GROUP BY ALL""",
    "accounts": """
        SELECT 'acc' || c_custkey AS id,
            CASE WHEN c_mktsegment IN ('BUILDING', 'FURNITURE') THEN 'youtube' WHEN c_mktsegment = 'AUTOMOBILE' THEN 'twitch'
                WHEN c_mktsegment = 'MACHINERY' THEN 'tiktok' ELSE 'x' END AS platform,
            CASE WHEN c_custkey % 13 <> 0 THEN lpad(CAST(c_custkey AS VARCHAR), 6, '0') END AS platform_id,
            CASE WHEN c_custkey % 7 = 0 THEN '' WHEN c_custkey % 11 = 0 THEN NULL ELSE '@H' || c_custkey END AS handle,
            c_name AS name, 'https://example.org/' || c_custkey AS url, '2024-01-01' AS first_discovered_at
        FROM customer""",
    "personas": """
        SELECT 'per' || s_suppkey AS id, CASE WHEN s_suppkey % 5 <> 0 THEN s_name END AS canonical_name,
            CASE WHEN s_acctbal > 4000 THEN 'verified' WHEN s_acctbal > 0 THEN 'pending' ELSE 'rejected' END AS review_status
        FROM supplier""",
    "links": """
        SELECT 'lnk' || o_orderkey AS id, 'acc' || o_custkey AS account_id, 'per' || (o_orderkey % 97) AS persona_id,
            CASE o_orderstatus WHEN 'F' THEN 'verified' WHEN 'O' THEN 'pending' ELSE 'rejected' END AS review_status,
            CASE WHEN o_orderkey % 9 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS reviewed_at
        FROM orders""",
    "legacy": """
        SELECT 'leg' || o_orderkey AS id, 'acc' || o_custkey AS account_id,
            CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE 'agency' || (o_orderkey % 6) END AS source_agency,
            strftime(o_orderdate, '%Y-%m-%d') AS source_checked_at
        FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'P'""",
    "affiliations": """
        SELECT 'aff' || s_suppkey AS id, 'per' || s_suppkey AS persona_id, n_name AS organization,
            CASE WHEN s_suppkey % 3 <> 0 THEN 'verified' ELSE 'pending' END AS review_status
        FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
    "channel_days": """
        SELECT 'c' || user_id AS channel_id, strftime(ts, '%Y-%m-%d') AS day, count(*) AS n,
            sum(CAST(round(value * 100) AS BIGINT)) AS cents FROM events GROUP BY ALL""",
    "channel_metrics": """
        SELECT channel_id, day,
            CASE WHEN CAST(substr(day, 9, 2) AS INTEGER) % 7 <> 0 THEN CAST(sum(n) OVER so_far AS BIGINT) END AS subscribers,
            CAST(sum(cents) OVER so_far AS BIGINT) AS views
        FROM channel_days WINDOW so_far AS (PARTITION BY channel_id ORDER BY day ROWS UNBOUNDED PRECEDING)""",
    "videos": """
        SELECT 'v' || o_orderkey AS video_id, 'c' || (o_custkey % 50) AS channel_id,
            CASE WHEN o_orderkey % 17 <> 0 THEN strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') END AS published_at,
            CAST(year(o_orderdate) AS INTEGER) AS year, CAST(o_orderkey % 400 AS INTEGER) AS seconds,
            CAST(round(o_totalprice) AS BIGINT) AS comments, o_orderpriority AS title, o_orderstatus AS status
        FROM orders""",
}
_NEEDS = {"interactions": ["sightings"], "snapshots": ["sightings"], "channel_metrics": ["channel_days"]}


def with_roles(names: str, body: str) -> str:
    """A DuckDB statement whose WITH clause defines the named roles; further common tables may follow in ``body``."""
    wanted: list[str] = []
    for name in names.split():
        wanted += [n for n in (*_NEEDS.get(name, []), name) if n not in wanted]
    roles = ", ".join(f"{n} AS ({ROLE_SQL[n]})" for n in wanted)
    body = body.strip()
    return f"WITH {roles}, {body[5:]}" if body.upper().startswith("WITH ") else f"WITH {roles} {body}"
