"""Readers: presence files of mixed schemas, registry JSON, tabs, API pages, HTML."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crowdweave.sources.shared import written

PRESENCE = "channel_id string, video_id string, viewer_id string, source_type string, first_seen timestamp, last_seen timestamp, appearances long"


def presence_files(spark: SparkSession, path: str | None) -> DataFrame:
    """Presence Parquet files of old and new layouts under a folder, as one typed frame.

    Columns are united by name; an old viewer_hash stands in for viewer_id, a single timestamp for both ends, and one
    appearance for a missing count. Without a path the frame is empty, with the same schema.
    """
    if path is None:
        return spark.createDataFrame([], PRESENCE)
    raw = spark.read.option("mergeSchema", True).option("recursiveFileLookup", True).parquet(path)
    has = set(raw.columns)

    def first_of(*names: str) -> Column:
        found = [F.col(n) for n in names if n in has]
        return F.coalesce(*found) if found else F.lit(None)

    return raw.select(
        first_of("channel_id", "creator_id").cast("string").alias("channel_id"), first_of("video_id").cast("string").alias("video_id"),
        first_of("viewer_id", "viewer_hash").cast("string").alias("viewer_id"), first_of("source_type").cast("string").alias("source_type"),
        first_of("first_seen", "timestamp").cast("timestamp").alias("first_seen"), first_of("last_seen", "timestamp").cast("timestamp").alias("last_seen"),
        F.coalesce(first_of("appearances").cast("long"), F.lit(1)).alias("appearances"),
    )


def require_valid(events: DataFrame) -> DataFrame:
    """The rows, failing while they are read if a source is unknown or a video is blank: no extra pass."""
    bad = ~F.col("source_type").isin("live_chat", "comment") | (F.trim("video_id") == "") | F.col("video_id").isNull()
    return events.withColumn("source_type", F.when(F.coalesce(bad, F.lit(True)), F.raise_error(F.lit("invalid presence row"))).otherwise(F.col("source_type")))


def require_one_layout(spark: SparkSession, path: str, canonical: str = "/channel_id=") -> None:
    """Fail if a folder mixes partitioned and plain files; only the files' names are looked at."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(path).select("path")
    kinds = files.select(F.col("path").contains(canonical).alias("k")).distinct().count()
    if kinds > 1:
        raise ValueError(f"{path} mixes partitioned and plain presence files")


def registry_tables(spark: SparkSession, path: str, table: str, fields: str) -> DataFrame:
    """One table of a registry snapshot: a JSON object with schema_version and tables of rows."""
    doc = spark.read.option("multiLine", True).schema(f"schema_version int, tables struct<{table}: array<struct<{fields}>>>").json(path)
    checked = doc.select(F.when(F.col("schema_version").isin(1, 2), F.col(f"tables.{table}")).otherwise(F.raise_error(F.lit("unknown schema_version"))).alias("rows"))
    return checked.select(F.inline("rows"))


SEED = "channel_id string, id string, handle string, name string, title string, subscriber_count string, subscribers string, agency string, source string, description string"


def seeds(spark: SparkSession, path: str) -> DataFrame:
    """Raw candidates of seed files, each a JSON array, also in folders below; fields that a file does not have are null."""
    return spark.read.option("multiLine", True).option("recursiveFileLookup", True).schema(SEED).json(path)


def fetch(rows: DataFrame, **equal) -> DataFrame:
    """Rows whose columns have the given values (None: null)."""
    for column, value in equal.items():
        rows = rows.where(F.col(f"`{column}`").eqNullSafe(F.lit(value)))
    return rows


CREATORS = (
    "creators array<struct<creator_id: string, display_name: string, aliases: array<string>, evidence_ids: array<string>, metadata: map<string, string>>>, "
    "accounts array<struct<account_id: string, creator_id: string, platform: string, platform_id: string, handle: string, url: string, evidence_ids: array<string>>>, "
    "evidence array<struct<evidence_id: string, source_url: string, subject_ids: array<string>>>"
)


def creator_registry(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """creators, accounts and evidence of a nested registry document."""
    doc = spark.read.option("multiLine", True).schema(CREATORS).json(path)
    return {name: doc.select(F.inline(name)) for name in ("creators", "accounts", "evidence")}


def tab(spark: SparkSession, path: str, header: list[str]) -> DataFrame:
    """A sheet tab saved as CSV: all text, missing cells '', failing if the header differs."""
    found = spark.read.option("header", True).csv(path)
    if found.columns[: len(header)] != header:
        raise ValueError(f"header of {path} is {found.columns}")
    return found.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) for c in header])


def guarded(spark: SparkSession, path: str, header: list[str]) -> tuple[DataFrame, DataFrame]:
    """CSV files of text with a known header: (rows, quarantine).

    A row with fewer cells than the header is padded with '', as a missing cell is; blank rows at any place are left
    out. Quarantine has file, raw and problem: ``header`` for all rows of a file whose first row is not the header,
    ``long`` for rows with more cells, ``broken`` for rows whose quotes do not close. Files are read as streams of
    records, cells may hold line feeds; a file is one task. All rows are in one of the two, but headers and blank rows.
    """
    columns = [f"c{i}" for i in range(len(header))]
    schema = ", ".join(f"{c} string" for c in columns) + ", raw string"
    cells = spark.read.schema(schema).option("columnNameOfCorruptRecord", "raw").option("multiLine", True).option("quote", '"').option("escape", '"')
    rows = cells.option("mode", "PERMISSIVE").option("recursiveFileLookup", True).csv(path).select("*", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("at"))
    rows = written(rows)  # Spark reads all cells of a row, or its raw form alone, so both are kept before one is chosen
    top = rows.groupBy("file").agg(F.min_by(F.struct(*columns, "raw"), "at").alias("top"), F.min("at").alias("first"), F.max("at").alias("final"))
    # quotes that never close run to the end of a file, into its last row
    lines = spark.read.option("recursiveFileLookup", True).text(path).select(F.col("_metadata.file_path").alias("file"), "value")
    quoted = lines.groupBy("file").agg((F.sum(F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))) % 2 == 1).alias("open"))
    top = top.join(quoted, "file", "left")
    first = [F.regexp_replace(F.coalesce(F.col(f"top.{c}"), F.lit("")), "^\ufeff", "") if i == 0 else F.coalesce(F.col(f"top.{c}"), F.lit("")) for i, c in enumerate(columns)]
    headed = F.col("top.raw").isNull()
    for found, wanted in zip(first, header, strict=True):
        headed = headed & (found == wanted)
    named = rows.join(top.select("file", "first", "final", "open", headed.alias("headed")), "file").where(~F.col("headed") | (F.col("at") != F.col("first")))
    raw = F.col("raw")
    cells_of = F.size(F.split(raw, ',(?=(?:[^"]*"[^"]*")*[^"]*$)'))
    problem = (
        F.when(~F.col("headed"), "header").when(F.col("open") & (F.col("at") == F.col("final")), "broken").when(raw.isNull(), F.lit(None).cast("string"))
        .when(cells_of > len(header), "long")
    )
    told = named.withColumn("problem", problem)
    blank = F.coalesce(*columns, F.lit("")) == ""
    for c in columns:
        blank = blank & (F.coalesce(c, F.lit("")) == "")
    good = told.where(F.col("problem").isNull() & ~blank).select(*[F.coalesce(c, F.lit("")).alias(h) for c, h in zip(columns, header, strict=True)], "file")
    bad = told.where("problem IS NOT NULL").select("file", F.coalesce(raw, F.concat_ws(",", *columns)).alias("raw"), "problem")
    return good, bad


def by_time(rows: DataFrame, path: str, at: str) -> None:
    """Write rows laid out by time: a folder per year, files of each sorted by time, so that both can be skipped."""
    dealt = rows.withColumn("year", F.year(at)).repartitionByRange("year", at).sortWithinPartitions("year", at)
    dealt.write.mode("overwrite").partitionBy("year").parquet(path)


def since(spark: SparkSession, path: str, at: str, start: str) -> DataFrame:
    """Rows of a table laid out by ``by_time`` from ``start`` (a date) on: older years are not opened, and in the year of
    ``start`` Parquet's statistics skip older row groups."""
    return spark.read.parquet(path).where((F.col("year") >= int(start[:4])) & (F.col(at) >= F.lit(start).cast("timestamp"))).drop("year")


def archive_events(records: DataFrame) -> DataFrame:
    """Archive records (source_path, source_table, row_number, record_json) to typed presence events with their tier."""
    path = F.col("source_path")
    tier = F.when(path.startswith("expanded-v1/"), 0).when(path.startswith("deep/"), 1).when(path.startswith("historical/"), 2).when(path.startswith("live/"), 3).otherwise(4)
    record = F.from_json("record_json", "channel_id string, video_id string, viewer_id string, viewer_hash string, source_type string, timestamp string")
    parsed = records.withColumn("r", record).where("r is not null")
    return parsed.select(
        "r.channel_id", "r.video_id", F.coalesce("r.viewer_id", "r.viewer_hash").alias("viewer_id"), "r.source_type",
        F.try_to_timestamp("r.timestamp").alias("timestamp"), tier.alias("tier"), "source_path", "row_number",
    )


def unified(*parts: DataFrame) -> DataFrame:
    """Events of several sources under one schema; of equal events the one of the best (lowest) tier stays."""
    from functools import reduce

    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    key = ["channel_id", "video_id", "viewer_id", "source_type", "timestamp"]
    rest = [c for c in both.columns if c not in key]
    return both.groupBy(*key).agg(F.min_by(F.struct(*rest), "tier").alias("r")).select(*key, "r.*")


def directory_channels(pages: DataFrame, html: str = "html") -> DataFrame:
    """Distinct channel ids that directory pages link to."""
    ids = F.regexp_extract_all(F.col(html), F.lit(r"youtube\.com/channel/(UC[0-9A-Za-z_-]{22})"), 1)
    return pages.select(F.explode(ids).alias("channel_id")).distinct()


def embedded_json(pages: DataFrame, marker: str, schema: str, html: str = "html") -> DataFrame:
    """Rows of a JSON array that a page assigns to a variable."""
    text = F.regexp_extract(F.col(html), rf"(?s){marker}\s*=\s*(\[.*?\]);", 1)
    return pages.select(F.inline(F.from_json(text, f"array<struct<{schema}>>")))


def comment_threads(pages: DataFrame, body: str = "body") -> tuple[DataFrame, DataFrame]:
    """API pages of comment threads: (comments with their parents, threads whose replies are not all there)."""
    author = "authorDisplayName: string, authorChannelId: struct<value: string>, publishedAt: string, likeCount: int"
    comment = f"struct<id: string, snippet: struct<{author}>>"
    schema = f"items array<struct<snippet: struct<videoId: string, totalReplyCount: int, topLevelComment: {comment}>, replies: struct<comments: array<{comment}>>>>, nextPageToken string"
    items = pages.select(F.explode(F.from_json(body, schema)["items"]).alias("i"))
    top = F.col("i.snippet.topLevelComment")
    inline = F.coalesce(F.col("i.replies.comments"), F.array().cast(f"array<{comment}>"))

    def row(c: Column, parent: Column) -> Column:
        s = c["snippet"]
        return F.struct(c["id"].alias("comment_id"), parent.alias("parent_id"), s["authorChannelId"]["value"].alias("viewer_id"), s["publishedAt"].alias("published_at"), s["likeCount"].alias("likes"))

    rows = F.concat(F.array(row(top, F.lit(None).cast("string"))), F.transform(inline, lambda c: row(c, top["id"])))
    comments = items.select(F.col("i.snippet.videoId").alias("video_id"), F.inline(rows))
    more = items.where(F.col("i.snippet.totalReplyCount") > F.size(inline)).select(top["id"].alias("parent_id"), F.col("i.snippet.videoId").alias("video_id"))
    return comments, more


def sample_presence(spark: SparkSession, rows: int, channels: int = 12, viewers: int = 500, seed: int = 7) -> DataFrame:
    """Deterministic presence events: viewers stay within a group of three channels, every tenth one bridges groups;
    85 of 100 events are live chat."""
    draw = [F.pmod(F.xxhash64(F.lit(seed), F.lit(k), "id"), F.lit(1_000_000)) for k in range(5)]
    viewer = draw[0] % viewers
    channel = F.when(viewer % 10 == 0, draw[1] % channels).otherwise((viewer % (channels // 3)) * 3 + draw[1] % 3)
    return spark.range(rows).select(
        F.concat(F.lit("UC"), channel).alias("channel_id"), F.concat(F.lit("v"), channel, F.lit("_"), draw[2] % 20).alias("video_id"), F.concat(F.lit("viewer"), viewer).alias("viewer_id"),
        F.when(draw[3] % 100 < 85, "live_chat").otherwise("comment").alias("source_type"), F.timestamp_seconds(F.lit(1_700_000_000) + draw[4]).alias("timestamp"),
    )
