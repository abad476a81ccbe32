"""Session logs of four formats as one canonical table of messages.

Each adapter turns raw lines (path, line) into session, agent, seq, role, text, at, cwd, branch, model.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MESSAGE = ["agent", "session", "path", "seq", "role", "text", "at", "cwd", "branch", "model"]
# How messages begin that a tool put in, not the user.
INJECTED = (
    r"(?s)^\s*(?:<system-reminder>|<environment_context>|<user_instructions>|<(?i:INSTRUCTIONS)>|#\s*(?i:AGENTS\.md instructions)|#\s*(?i:CLAUDE\.md)"
    r"|Caveat:|<command-name>|<local-command-stdout>|\[Request interrupted|<budget_status>)"
)


def raw_lines(spark: SparkSession, root: str, since: str | None = None, exclude: tuple[str, ...] = ()) -> DataFrame:
    """path, modified, seq, line of all .jsonl files below root (changed after since), but for those whose path begins with an excluded prefix."""
    reader = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl")
    if since:
        reader = reader.option("modifiedAfter", since)
    rows = reader.text(root, lineSep="\n").select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("modified"),
        F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")).alias("seq"), F.col("value").alias("line"),
    )
    for prefix in exclude:
        rows = rows.filter(~F.startswith(F.regexp_replace("path", "^file:/*", "/"), F.lit(prefix)) & ~F.startswith("path", F.lit(prefix)))
    return rows


def read_lines(spark: SparkSession, root: str, since: str | None = None, exclude: tuple[str, ...] = ()) -> DataFrame:
    """Raw lines without the blank ones."""
    return raw_lines(spark, root, since, exclude).filter(F.trim("line") != "")


def parsed(lines: DataFrame) -> DataFrame:
    """Lines with their JSON as a variant; those that do not parse have none."""
    return lines.withColumn("v", F.try_parse_json("line"))


def corrupt(lines: DataFrame) -> DataFrame:
    """Unparsable lines: the last of a file is still being written (torn), any other is quarantined."""
    last = F.max("seq").over(W.partitionBy("path"))
    rows = parsed(lines).withColumn("torn", F.col("seq") == last)
    return rows.filter("v is null").select("path", "seq", "line", "torn")


def get(path: str, kind: str = "string") -> Column:
    return F.try_variant_get(F.col("v"), path, kind)


def flat(path: str) -> Column:
    """Text of a message: a string, or its parts joined; tool calls show their name, tool results 500 characters, thinking nothing."""
    parts = F.from_json(get(path), "array<struct<type string, text string, name string, content string, thinking string>>")
    shown = F.transform(parts, lambda p: F.when(p["type"].isin("text", "input_text", "output_text"), p["text"])
                        .when(p["type"].isin("tool_use", "toolCall"), F.concat(F.lit("[tool: "), F.coalesce(p["name"], F.lit("?")), F.lit("]")))
                        .when(p["type"] == "tool_result", F.left(F.coalesce(p["content"], F.lit("")), F.lit(500)))
                        .when(p["type"] == "image", F.lit("[image]")))
    joined = F.array_join(F.filter(shown, lambda t: t.isNotNull() & (t != "")), "\n")
    return F.when(F.schema_of_variant(F.try_variant_get(F.col("v"), path, "variant")) == "STRING", get(path)).otherwise(joined)


def real(rows: DataFrame) -> DataFrame:
    """User and assistant messages with a text of their own."""
    return rows.filter(F.col("role").isin("user", "assistant") & (F.trim("text") != "") & ~F.col("text").rlike(INJECTED))


def project_log(lines: DataFrame, agent: str = "project") -> DataFrame:
    """Format 1: a line a message; side chains and meta lines are dropped."""
    rows = parsed(lines).filter(F.col("v").isNotNull() & ~F.coalesce(get("$.isSidechain", "boolean"), F.lit(False)) & ~F.coalesce(get("$.isMeta", "boolean"), F.lit(False)))
    rows = rows.select(
        F.lit(agent).alias("agent"), F.coalesce(get("$.sessionId"), F.regexp_extract("path", r"([^/]+)\.jsonl$", 1)).alias("session"), "path", "seq",
        get("$.type").alias("role"), flat("$.message.content").alias("text"), F.try_to_timestamp(get("$.timestamp")).alias("at"), get("$.cwd").alias("cwd"), get("$.gitBranch").alias("branch"), get("$.message.model").alias("model"),
    )
    return real(rows)


def rollout_log(lines: DataFrame, agent: str = "rollout") -> DataFrame:
    """Format 2: response items are messages (event messages repeat them); metadata stands in lines of its own and is carried forward."""
    uuid = r"([0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12})\.jsonl$"
    before = W.partitionBy("path").orderBy("seq").rowsBetween(W.unboundedPreceding, 0)
    rows = parsed(lines).filter(F.col("v").isNotNull()).withColumn("type", get("$.type"))
    carried = {
        "cwd": F.last(F.when(F.col("type").isin("session_meta", "turn_context"), get("$.payload.cwd")), ignorenulls=True).over(before),
        "branch": F.last(F.when(F.col("type") == "session_meta", get("$.payload.git.branch")), ignorenulls=True).over(before),
        "model": F.last(F.when(F.col("type") == "turn_context", get("$.payload.model")), ignorenulls=True).over(before),
    }
    rows = rows.withColumns(carried).filter((F.col("type") == "response_item") & (get("$.payload.type") == "message"))
    rows = rows.select(F.lit(agent).alias("agent"), F.regexp_extract("path", uuid, 1).alias("session"), "path", "seq", get("$.payload.role").alias("role"), flat("$.payload.content").alias("text"), F.try_to_timestamp(get("$.timestamp")).alias("at"), "cwd", "branch", "model")
    return real(rows)


def event_log(lines: DataFrame, agent: str = "events") -> DataFrame:
    """Format 3: session, model_change and message records."""
    before = W.partitionBy("path").orderBy("seq").rowsBetween(W.unboundedPreceding, 0)
    rows = parsed(lines).filter(F.col("v").isNotNull()).withColumn("type", get("$.type"))
    carried = {
        "session": F.last(F.when(F.col("type") == "session", get("$.id")), ignorenulls=True).over(before),
        "cwd": F.last(F.when(F.col("type") == "session", get("$.cwd")), ignorenulls=True).over(before),
        "model": F.last(F.when(F.col("type") == "model_change", get("$.modelId")), ignorenulls=True).over(before),
    }
    rows = rows.withColumns(carried).filter(F.col("type") == "message")
    rows = rows.select(F.lit(agent).alias("agent"), "session", "path", "seq", get("$.message.role").alias("role"), flat("$.message.content").alias("text"), F.try_to_timestamp(get("$.timestamp")).alias("at"), "cwd", F.lit(None).cast("string").alias("branch"), "model")
    return real(rows)


def database_log(spark: SparkSession, sessions: DataFrame, messages: DataFrame, parts: DataFrame, agent: str = "database") -> DataFrame:
    """Format 4: session, message and part tables (read by JDBC or from exports); parts join into a message in time order."""
    texts = parts.groupBy("message_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("time", "text"))), lambda p: p["text"]), "\n").alias("text"))
    live = sessions.filter(F.col("time_archived").isNull()).select(F.col("id").alias("session"), F.col("directory").alias("cwd"))
    rows = messages.join(texts, messages["id"] == texts["message_id"], "left").join(live, messages["session_id"] == live["session"])
    rows = rows.select(F.lit(agent).alias("agent"), "session", F.lit(None).cast("string").alias("path"), F.struct(F.col("time_created").cast("long").alias("block"), F.lit(0).cast("long").alias("row")).alias("seq"), "role", F.coalesce("text", F.lit("")).alias("text"), F.timestamp_millis("time_created").alias("at"), "cwd", F.lit(None).cast("string").alias("branch"), "model")
    return real(rows)


def sessions_of(messages: DataFrame) -> DataFrame:
    """A row a session: size, first and last time, last metadata, title (first user text, 80 characters)."""
    return messages.groupBy("agent", "session").agg(
        F.count(F.lit(1)).alias("messages"), F.min("at").alias("started"), F.max("at").alias("ended"),
        F.max_by("cwd", F.when(F.col("cwd").isNotNull(), F.col("seq"))).alias("cwd"), F.max_by("branch", F.when(F.col("branch").isNotNull(), F.col("seq"))).alias("branch"),
        F.max_by("model", F.when(F.col("model").isNotNull(), F.col("seq"))).alias("model"),
        F.left(F.min_by("text", F.when(F.col("role") == "user", F.col("seq"))), F.lit(80)).alias("title"),
    )


def slug_path(c: Column) -> Column:
    """-Users-a-b -> /Users/a/b; a dash inside a name cannot be told from a separator."""
    return F.translate(c, "-", "/")


def read_folder(spark: SparkSession, root: str, extensions: tuple[str, ...] = ("md", "txt"), exclude: tuple[str, ...] = (), most_kb: int = 512) -> DataFrame:
    """key (path below root), hash, content of the text files of a folder; dot files, excluded names and larger files are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    name = F.element_at(F.split("path", "/"), -1)
    rows = files.filter(~F.startswith(name, F.lit(".")) & F.element_at(F.split(name, "[.]"), -1).isin(*extensions) & (F.col("length") <= most_kb * 1024))
    for part in exclude:
        rows = rows.filter(~F.contains("path", F.lit(part)))
    base = F.regexp_replace("path", r"^file:/*", "/")
    return rows.select(F.replace(base, F.lit(root.rstrip("/") + "/"), F.lit("")).alias("key"), F.sha2("content", 256).alias("hash"), F.decode("content", "UTF-8").alias("content"), F.col("modificationTime").alias("modified"))
