"""Rule-based extraction of memories from sessions, duplicates, merging, admission."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import clamp
from .graph import blocked_pairs
from .security import has_secrets

# What introduces a directive and the memory that it makes (kind, confidence, importance, tag), commands that
# are worth keeping, and headings of assignments.
DIRECTIVES = (
    (r"(?:记住|请记住|要记得|以后都?|从今以后|下次|每次都?|一定要|务必|必须)\s*[：:，,]?\s*(.{6,200})", "preference", 0.72, 0.8, "user/preference"),
    (r"(?:不要|别|禁止|严禁|不准|不能)\s*(.{6,200})", "preference", 0.65, 0.75, "user/preference"),
    (r"(?:我(?:们)?(?:的)?习惯|我(?:们)?(?:都|一般|通常)(?:是|用|会))\s*(.{6,200})", "preference", 0.6, 0.6, "user/preference"),
    (r"(?:原因是|因为|之所以.{2,20}是因为|理由是)\s*(.{10,200})", "decision", 0.5, 0.55, "dev/decision"),
    (r"(?:问题(?:出)?在|根因是|原来是|罪魁祸首是|坑在)\s*(.{6,200})", "issue", 0.6, 0.65, "dev/troubleshooting"),
    (r"(?:学到了|明白了|原来|涨知识|第一次知道)\s*(.{8,200})", "learning", 0.5, 0.5, "learning"),
)
COMMAND = r"\b((?:docker(?:\s+compose)?|kubectl|systemctl|pm2|ssh|scp|rsync|pnpm|npm|yarn|make|cargo|go|python3?|uv|psql|mysql|redis-cli|nginx|certbot)\s+[^\n`'\"]{6,160})"
QUERYING = r"\b(?:--help|-h|--version|status|list|ls|ps)\b\s*$"
BRIEF_HEADING = r"(?im)^\s*(?:##?\s*)?(?:Goal|Task|Context|Symptom|Acceptance|Deliverable|Constraints|目标|任务|背景|验收|约束)\s*[:：]?\s*$"

#: A brief by its form, how a directive may not begin, and the signs that it may not be made of.
BRIEF_CHARS, BRIEF_HEADLINE, BRIEF_FENCE = 900, r"(?m)^#{1,3}\s", "```"
LOOSE_START, SIGNS, SIGN_SHARE = r"^[，,。、；;：:）)\]】>|·—-]", r"[|`{}<>\[\]$#*_~]", 0.08


def task_brief(text: Column) -> Column:
    """Assignments, which hold no lasting facts: any long text, and any with a heading, a fenced block or an assignment's section."""
    fenced = F.size(F.regexp_extract_all(text, F.lit(BRIEF_FENCE), F.lit(0))) >= 2
    return (F.length(text) > BRIEF_CHARS) | text.rlike(BRIEF_HEADLINE) | fenced | text.rlike(BRIEF_HEADING)


def well_formed(c: Column) -> Column:
    symbols = F.length(c) - F.length(F.regexp_replace(c, SIGNS, ""))
    return F.length(c).between(8, 200) & ~c.rlike(LOOSE_START) & (symbols <= SIGN_SHARE * F.length(c))


def extract(turns: DataFrame) -> DataFrame:
    """conv_id, turn, kind, title, content, confidence, importance, tag, sensitivity of what rules find in sessions.

    Directives come from user turns that are no task briefs, commands from every turn. Rules understand nothing, so a
    directive's confidence is lowered by 0.1. Of finds with the same first 40 characters a session keeps the first:
    directives before commands, then by turn, rule and place. Anything that holds a secret becomes secret, and a directive
    with one a credential.
    """
    def finds(pattern: str, phase: int, rule: int, kind: str, confidence: float, importance: float, tag: str) -> Column:
        values = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(pattern), F.lit(1))
        here = F.lit(True) if phase else (F.col("role") == "user") & ~task_brief(F.col("text"))

        def one(v: Column, i: Column) -> Column:
            what = {"phase": F.lit(phase), "rule": F.lit(rule), "place": i, "kind": F.lit(kind), "content": F.trim(F.regexp_replace(v, r"\s+", " ") if not phase else v),
                    "confidence": F.lit(confidence), "importance": F.lit(importance), "tag": F.lit(tag)}
            return F.struct(*[c.alias(n) for n, c in what.items()])

        return F.when(here, F.transform(values, one)).otherwise(F.array().cast("array<struct<phase:int,rule:int,place:int,kind:string,content:string,confidence:double,importance:double,tag:string>>"))

    parts = [finds(p, 0, i, k, round(c - 0.1, 2), w, t) for i, (p, k, c, w, t) in enumerate(DIRECTIVES)]
    parts.append(finds(COMMAND, 1, 0, "howto", 0.4, 0.4, "ops/command"))
    rows = turns.select("conv_id", "turn", F.explode(F.concat(*parts)).alias("m")).select("conv_id", "turn", "m.*")
    worth = F.when(F.col("phase") == 0, well_formed(F.col("content"))).otherwise((F.length("content") >= 12) & ~F.col("content").rlike(QUERYING))
    rows = rows.filter(worth).withColumn("title", F.left("content", F.lit(40)))
    nth = F.row_number().over(W.partitionBy("conv_id", "title").orderBy("phase", "turn", "rule", "place"))
    rows = rows.withColumn("nth", nth).filter("nth = 1").withColumn("secret", has_secrets(F.col("content"), 0.0))
    kind = F.when(F.col("secret") & (F.col("phase") == 0), "credential").otherwise(F.col("kind"))
    return rows.select("conv_id", "turn", kind.alias("kind"), "title", "content", "confidence", "importance", "tag", F.when(F.col("secret"), "secret").otherwise("private").alias("sensitivity"))


def activity(turns: DataFrame, least: int = 6, projects: DataFrame | None = None) -> DataFrame:
    """One memory a session of `least` turns or more; sessions with the same first 40 characters count once.

    projects (conv_id, project): where given, only sessions with a project count.
    """
    if projects is not None:
        turns = turns.join(projects.filter("trim(project) <> ''").select("conv_id").distinct(), "conv_id", "left_semi")
    first = F.left(F.min_by("text", F.when(F.col("role") == "user", F.col("turn"))), F.lit(40))
    sessions = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("messages"), first.alias("title")).filter((F.col("messages") >= least) & F.col("title").isNotNull())
    nth = F.row_number().over(W.partitionBy("title").orderBy("conv_id"))
    return sessions.withColumn("nth", nth).filter("nth = 1").drop("nth")


def exact_duplicates(rows: DataFrame) -> DataFrame:
    """id, first: rows whose content equals that of an earlier id."""
    hashed = rows.select("id", F.sha2(F.coalesce("content", F.lit("")).cast("binary"), 256).alias("h"))
    first = hashed.groupBy("h").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    return hashed.join(first, "h").filter("id <> first").select("id", "first")


def semantic_duplicates(vectors: DataFrame, threshold: float = 0.92) -> DataFrame:
    """id, twin, score: the most similar earlier vector of the same label at or above the threshold."""
    pairs = blocked_pairs(vectors, threshold, best=1, earlier=True, within="label")
    place = F.row_number().over(W.partitionBy("source").orderBy(F.desc("score"), "target"))
    return pairs.withColumn("place", place).filter("place = 1").select(F.col("source").alias("id"), F.col("target").alias("twin"), "score")


def merge(pairs: DataFrame) -> DataFrame:
    """Merges candidate (c) into existing (m): tags united, importance +0.08, the surer confidence, much longer content, secrecy only up."""
    longer = F.length("c.content") > 1.2 * F.length("m.content")
    return pairs.select(
        F.col("m.id").alias("id"), F.array_union("m.tags", "c.tags").alias("tags"), clamp(F.col("m.importance") + 0.08).alias("importance"),
        F.greatest("m.confidence", "c.confidence").alias("confidence"), F.when(longer, F.col("c.content")).otherwise(F.col("m.content")).alias("content"),
        F.when(F.col("c.sensitivity") == "secret", "secret").otherwise(F.col("m.sensitivity")).alias("sensitivity"),
    )


def route(confidence: Column, accept: float = 0.75) -> Column:
    return F.when(confidence >= accept, "active").otherwise("pending")


def admit(content: Column, best: Column, force: Column, judge: bool = False, least: int = 24, screen: float = 0.88, certain: float = 0.97, worth: Column | None = None, queue: bool = True) -> Column:
    """accept, review, merge or reject; best is the similarity of the nearest stored memory (null: none).

    Without a judge only near certain twins merge and the rest is accepted. With one, best tells that the judge confirmed
    a twin above the screen, and worth is its verdict on the content; what it turns down waits for review or is rejected.
    """
    twin = F.coalesce(best, F.lit(0.0)) >= (screen if judge else certain)
    last = F.when(F.coalesce(worth, F.lit(True)), "accept").otherwise("review" if queue else "reject") if judge and worth is not None else F.lit("accept")
    return F.when(force, "accept").when(F.length(F.trim(content)) < least, "reject").when(twin, "merge").otherwise(last)


def normalized(raw: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """Raw model output brought into bounds: unknown kinds become facts, unknown sensitivities private; 6 tags, title of 1..120."""
    title = F.trim("title")
    rows = raw.withColumn("title", title).filter((F.length("title") > 0) & (F.length("title") <= 120))
    return rows.withColumns({
        "kind": F.when(F.col("kind").isin(*kinds), F.col("kind")).otherwise("fact"),
        "sensitivity": F.when(F.col("sensitivity").isin("public", "private", "secret"), F.col("sensitivity")).otherwise("private"),
        "tags": F.slice(F.coalesce("tags", F.array().cast("array<string>")), 1, 6),
        "confidence": clamp(F.coalesce("confidence", F.lit(0.5))),
        "importance": clamp(F.coalesce("importance", F.lit(0.5))),
    })
