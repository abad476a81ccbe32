"""The store's logical tables over the driver's parquet tables, in Spark and (for the oracles) in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import release, stored

NOW_MS = 1_706_745_600_000  # 2024-02-01 00:00:00 UTC
SEMANTIC = 0.35


class Store:
    """memories, documents, vectors, entity links, conversations and edges of one folder of tables."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def files(self, name: str) -> tuple:
        """Name, size and time of every file of a table."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        paths = [jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(f)) for f in self.table(name).inputFiles()]
        found = [p.getFileSystem(conf).getFileStatus(p) for p in paths]
        return tuple(sorted((f.getPath().toString(), f.getLen(), f.getModificationTime()) for f in found))

    def memories(self) -> DataFrame:
        k = F.get_json_object("props", "$.k").cast("long") % 10
        who, day = F.col("user_id").cast("string"), F.dayofmonth("ts").cast("string")
        number = F.col("event_id")
        return self.table("events").select(
            number.alias("id"), F.col("event_type").alias("kind"), F.concat_ws(" ", "event_type", number.cast("string")).alias("title"),
            F.concat(F.lit("p"), (F.col("user_id") % 12).cast("string")).alias("project"), F.concat(F.lit("a"), (F.col("user_id") % 4).cast("string")).alias("agent"),
            F.concat(F.lit("s"), who, F.lit("-"), day).alias("session"), F.col("ts").alias("created"),
            F.round(F.least(F.col("value") / 100.0, F.lit(1.0)), 4).alias("importance"), (number % 50 == 0).alias("pinned"),
            F.when(F.col("event_type") == "error", "pending").when(number % 20 == 0, "archived").otherwise("active").alias("status"),
            F.when(number % 17 == 0, "secret").when(number % 5 == 0, "private").otherwise("public").alias("sensitivity"),
            (number % 7).alias("access_count"),
            F.array(F.col("event_type"), F.concat(F.col("event_type"), F.lit("/k"), k.cast("string")), F.concat(F.lit("user/u"), (F.col("user_id") % 10).cast("string")), F.concat(F.lit("ses/"), who, F.lit("-"), day)).alias("tags"),
        )

    def documents(self) -> DataFrame:
        labels = self.table("labels").select("doc_id", "quality")
        docs = self.table("documents").join(labels, "doc_id", "left")
        return docs.select(
            F.col("doc_id").alias("id"), F.concat_ws(" ", "source", F.col("doc_id").cast("string")).alias("title"), F.col("text").alias("content"),
            F.array(F.col("lang"), F.concat_ws("/", "lang", "source")).alias("tags"), "lang", "source", F.coalesce(F.col("quality").cast("double"), F.lit(0.5)).alias("confidence"),
        )

    def vectors(self) -> DataFrame:
        return self.table("embeddings").select(F.col("vec_id").alias("id"), "embedding", "label", F.concat(F.lit("m"), (F.col("vec_id") % 2).cast("string")).alias("model"))

    def links(self) -> DataFrame:
        return self.table("lineitem").select(F.col("l_orderkey").alias("memory"), F.col("l_partkey").alias("entity")).distinct()

    def mentions(self) -> DataFrame:
        return self.table("lineitem").groupBy(F.col("l_partkey").alias("entity")).agg(F.count(F.lit(1)).alias("mentions"))

    def turns(self) -> DataFrame:
        return self.table("conversations").select("conv_id", "turn", "role", "text")

    def conversations(self) -> DataFrame:
        sizes = self.turns().groupBy("conv_id").agg(F.count(F.lit(1)).alias("messages"))
        start = F.timestamp_seconds(F.lit(1_704_067_200) + F.col("conv_id") * 3600)
        return sizes.select(
            F.col("conv_id").alias("id"), F.concat(F.lit("a"), (F.col("conv_id") % 4).cast("string")).alias("agent"), "messages",
            start.cast("timestamp_ntz").alias("started"), (F.timestamp_seconds(F.lit(1_704_067_200) + F.col("conv_id") * 3600 + F.col("messages") * 60)).cast("timestamp_ntz").alias("ended"),
        )

    def edges(self, threshold: float = SEMANTIC) -> DataFrame:
        """Semantic edges above the threshold, and tag edges between neighbours of one label.

        The similarity join is stored once for each state of the vectors' files, by their sizes and times; a table of an
        earlier state is deleted.
        """
        from ..operators.graph import similar_pairs

        v = self.vectors()
        key, state = (self.spark.sparkContext.applicationId, self.folder, threshold), self.files("embeddings")
        known = SEMANTIC_TABLES.get(key)
        if known is None or known[0] != state:
            SEMANTIC_TABLES[key] = state, stored(similar_pairs(v, threshold), "semantic-edges")
            if known is not None:
                release(known[1])
        semantic = SEMANTIC_TABLES[key][1].select("source", "target", F.lit("semantic").alias("kind"), F.col("score").alias("weight"))
        a, b = v.select(F.col("id").alias("source"), "label"), v.select(F.col("id").alias("target"), F.col("label").alias("other"))
        tag = a.join(b, (F.col("target") == F.col("source") + 1) & (F.col("label") == F.col("other"))).select("source", "target", F.lit("tag").alias("kind"), F.lit(0.4).alias("weight"))
        return semantic.unionByName(tag)


#: Stored similarity joins, and the state of the files that they are of, by application, folder and threshold.
SEMANTIC_TABLES: dict[tuple, tuple[tuple, DataFrame]] = {}
#: The same views as SQL, to be put after WITH.
SQL = {
    "mem": """mem AS (SELECT event_id AS id, event_type AS kind, event_type || ' ' || event_id AS title, 'p' || (user_id % 12) AS project, 'a' || (user_id % 4) AS agent,
 's' || user_id || '-' || day(ts) AS session, ts AS created, round(least(value / 100.0, 1.0), 4) AS importance, event_id % 50 = 0 AS pinned,
 CASE WHEN event_type = 'error' THEN 'pending' WHEN event_id % 20 = 0 THEN 'archived' ELSE 'active' END AS status,
 CASE WHEN event_id % 17 = 0 THEN 'secret' WHEN event_id % 5 = 0 THEN 'private' ELSE 'public' END AS sensitivity, event_id % 7 AS access_count,
 [event_type, event_type || '/k' || (CAST(regexp_extract(props, '[0-9]+') AS BIGINT) % 10), 'user/u' || (user_id % 10), 'ses/' || user_id || '-' || day(ts)] AS tags FROM events)""",
    "doc": """doc AS (SELECT d.doc_id AS id, source || ' ' || d.doc_id AS title, text AS content, lang, source, coalesce(CAST(quality AS DOUBLE), 0.5) AS confidence FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)""",
    "vec": """vec AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS e, label, 'm' || (vec_id % 2) AS model FROM embeddings)""",
    "lnk": """lnk AS (SELECT DISTINCT l_orderkey AS memory, l_partkey AS entity FROM lineitem), men AS (SELECT l_partkey AS entity, count(*) AS mentions FROM lineitem GROUP BY 1)""",
    "conv": """conv AS (SELECT conv_id AS id, 'a' || (conv_id % 4) AS agent, count(*) AS messages, TIMESTAMP '2024-01-01' + to_hours(conv_id) AS started,
 TIMESTAMP '2024-01-01' + to_hours(conv_id) + to_minutes(count(*)) AS ended FROM conversations GROUP BY conv_id)""",
    "edge": f"""edge AS (SELECT a.id AS source, b.id AS target, 'semantic' AS kind, list_dot_product(a.e, b.e) AS weight FROM vec a JOIN vec b ON a.id < b.id AND list_dot_product(a.e, b.e) >= {SEMANTIC}
 UNION ALL SELECT a.id, b.id, 'tag', 0.4 FROM vec a JOIN vec b ON b.id = a.id + 1 AND a.label = b.label)""",
}


def with_views(*names: str) -> str:
    return "WITH " + ",\n".join(SQL[n] for n in names)
