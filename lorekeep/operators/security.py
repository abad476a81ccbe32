"""Secret detection and redaction, sensitivity, encryption."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StringType, StructType


# Forms of well-known secrets, key words and their values, what may decorate an assignment, and values that
# are none.
PASSWORD_WORDS = ("password", "passwd", "pwd", "密码", "口令", "登录密码")
TOKEN_WORDS = ("api[_-]?key", "apikey", "secret", "token", "access[_-]?key", "密钥", "令牌")
PASSWORD_LETTER, TOKEN_LETTER = r"[^\s'\"`，,;|）)】\]>*]", r"[A-Za-z0-9\-_./+=]"
DECORATION = (r"\s*", r"\**", r"\s*", "[=:：]?", r"\s*", r"\**", r"\s*", "[\"'`「]?")
NO_WORD_BEFORE = "(?<![A-Za-z0-9_])"
NO_SECRET = r"x{3,}|\*{3,}|<[^>]*>?|\$\{[^}]+\}?|your[_-]?\w+|placeholder|example|changeme|todo|redacted|null|none|test"
OPENS, CLOSES = r"[<'\"`「（(\[{]*", r"[>'\"`」）)\]}]*"
#: A whole value that is a placeholder, whatever brackets or quotes are around it.
PLACEHOLDER = rf"(?i)^{OPENS}(?:{NO_SECRET}){CLOSES}$"


@dataclass(frozen=True)
class Secret:
    """A rule, in Java's regular expressions: a secret value between what stands before and after it.

    The value is `letter` taken `times` ('': it is one expression). words: the value is assigned to one of these key words.
    """

    kind: str
    confidence: float
    letter: str
    times: str = ""
    before: str = ""
    after: str = ""
    words: tuple[str, ...] = ()
    fold: bool = False

    def lead(self, greedy: str = "") -> str:
        """What stands before the value; with "+" the decoration gives nothing back, so it is never taken for a part of the value."""
        assigned = f"{NO_WORD_BEFORE}(?:{'|'.join(self.words)})" + "".join(part + greedy for part in DECORATION)
        return assigned if self.words else self.before

    @property
    def group(self) -> int:
        """The number of the part to hide; 0: all of it."""
        return 1 if self.lead() else 0

    @property
    def pattern(self) -> str:
        value = f"({self.letter}{self.times})" if self.group else self.letter + self.times
        return ("(?i)" if self.fold else "") + self.lead() + value + self.after


RULES = (
    Secret("private-key", 1.0, r"-----BEGIN\s+(?:[A-Z]+\s+)*PRIVATE KEY-----[\s\S]*?(?:-----END (?:[A-Z]+ )*PRIVATE KEY-----|\z)"),
    Secret("certificate", 0.8, r"-----BEGIN CERTIFICATE-----[\s\S]*?(?:-----END CERTIFICATE-----|\z)"),
    Secret("ssh", 0.9, r"\bssh-(?:rsa|ed25519|dss)\s+AAAA[0-9A-Za-z+/=]{20,}"),
    Secret("api-key", 1.0, r"\bsk-ant-[A-Za-z0-9\-_]{20,}"),
    Secret("api-key", 0.95, r"\bsk-[A-Za-z0-9]{32,}"),
    Secret("api-key", 1.0, r"\bgh[pousr]_[A-Za-z0-9]{30,}"),
    Secret("api-key", 0.95, r"\bxox[baprs]-[A-Za-z0-9-]{10,}"),
    Secret("aws", 1.0, r"\bAKIA[0-9A-Z]{16}\b"),
    Secret("aws", 1.0, "[A-Za-z0-9/+=]", "{40}", before=r"\baws_secret_access_key\s*[=:]\s*['\"]?", fold=True),
    Secret("jwt", 0.85, r"\beyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Secret("connection-string", 0.95, r"[^\s@/]", "+", before=r"\b(?:postgres(?:ql)?|mysql|mongodb(?:\+srv)?|redis|amqp|rediss)://[^\s:@/]+:", after="@", fold=True),
    Secret("password", 0.7, PASSWORD_LETTER, "{6,}", words=PASSWORD_WORDS, fold=True),
    Secret("token", 0.75, TOKEN_LETTER, "{16,}", words=TOKEN_WORDS, fold=True),
    Secret("ssh", 0.9, r"\S", "+", before=r"\bsshpass\s+-p\s*"),
    Secret("token", 0.9, r"[^\s'\"`,;]", "{8,}", before=r"\b[A-Z][A-Z0-9_]*_(?:SECRET|TOKEN|KEY|PASSWORD|PASSWD|CREDENTIAL)\s*=\s*['\"]?"),
)


def hits(text: Column) -> Column:
    """array of (rule, kind, confidence, value): all rules' matches, placeholders left out, by rule and place in the text."""
    parts = []
    for i, r in enumerate(RULES):
        values = F.filter(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r.pattern), F.lit(r.group)), lambda v: ~v.rlike(PLACEHOLDER))
        parts.append(F.transform(values, hit_of(i, r)))
    return F.concat(*parts)


def hit_of(place: int, rule: Secret):
    """A function from a matched value to a hit."""
    return lambda v: F.struct(F.lit(place).alias("rule"), F.lit(rule.kind).alias("kind"), F.lit(rule.confidence).alias("confidence"), v.alias("value"))


def detect(rows: DataFrame, column: str = "content") -> DataFrame:
    found = rows.select("id", F.explode(hits(F.col(column))).alias("h"))
    return found.select("id", "h.rule", "h.kind", "h.confidence", "h.value")


def has_secrets(text: Column, least: float = 0.7) -> Column:
    return F.exists(hits(text), lambda h: h["confidence"] >= least)


def redact(text: Column, least: float = 0.0) -> Column:
    """Every secret's value becomes a tagged mask, rule after rule; placeholders and what stands around a value stay.

    A value is a placeholder only as a whole: the guard before it looks up to where the value's own characters end. A mask
    itself is never taken for a value.
    """
    out = text
    for r in RULES:
        if r.confidence < least:
            continue
        mask = f"[redacted:{r.kind}]"
        if r.group == 0:
            out = F.regexp_replace(out, r.pattern, mask)
        else:
            guard = rf"(?!{OPENS}(?i:{NO_SECRET}){CLOSES}(?!{r.letter}))(?!\[redacted:)"
            out = F.regexp_replace(out, f"{'(?i)' if r.fold else ''}({r.lead('+')}){guard}{r.letter}{r.times}({r.after})", f"$1{mask}$2")
    return out


def scrubbed(value: Column, kind: DataType) -> Column:
    """A value of any type with every string in it redacted, however deep it lies."""
    if isinstance(kind, StringType):
        return redact(value)
    if isinstance(kind, ArrayType) and holds_text(kind):
        return F.transform(value, lambda x: scrubbed(x, kind.elementType))
    if isinstance(kind, MapType) and holds_text(kind):
        return F.transform_values(value, lambda _, x: scrubbed(x, kind.valueType))
    if isinstance(kind, StructType) and holds_text(kind):
        return F.when(value.isNotNull(), F.struct(*[scrubbed(value[f.name], f.dataType).alias(f.name) for f in kind]))
    return value


def holds_text(kind: DataType) -> bool:
    if isinstance(kind, StructType):
        return any(holds_text(f.dataType) for f in kind)
    inner = kind.elementType if isinstance(kind, ArrayType) else kind.valueType if isinstance(kind, MapType) else None
    return isinstance(kind, StringType) or inner is not None and holds_text(inner)


def scrub(rows: DataFrame) -> DataFrame:
    """Redacts every string of every column, also inside arrays, structs and the values of maps."""
    return rows.select(*[scrubbed(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in rows.schema])


def sql_hits() -> str:
    """id, rule, kind, confidence, value of all rules as SQL over documents, for engines without look-behind."""
    quoted = lambda x: x.replace("'", "''")
    parts = [
        f"SELECT doc_id AS id, {i} AS rule, '{r.kind}' AS kind, {r.confidence} AS confidence, unnest(regexp_extract_all(text, '{quoted(r.pattern.replace(NO_WORD_BEFORE, '(?:^|[^A-Za-z0-9_])'))}', {r.group})) AS value FROM documents"
        for i, r in enumerate(RULES)
    ]
    return f"SELECT * FROM ({' UNION ALL '.join(parts)}) WHERE NOT regexp_matches(value, '{quoted(PLACEHOLDER)}')"


def enforce(rows: DataFrame, column: str = "content", strong: float = 0.75) -> DataFrame:
    """Strong secrets make a row secret; credentials always are; the body of a secret row is hidden."""
    level = F.when((F.col("kind") == "credential") | has_secrets(F.col(column), strong), "secret").otherwise(F.col("sensitivity"))
    return rows.withColumn("sensitivity", level).withColumn("shown", F.when(level == "secret", "••••••").otherwise(F.col(column)))


def encrypt(c: Column, key_hex: str) -> Column:
    return F.base64(F.aes_encrypt(c, F.unhex(F.lit(key_hex)), F.lit("GCM")))


def decrypt(c: Column, key_hex: str) -> Column:
    """Null where the key is wrong."""
    return F.try_aes_decrypt(F.unbase64(c), F.unhex(F.lit(key_hex)), F.lit("GCM")).cast("string")


def derive_key(passphrase: str, salt: bytes, n: int = 1 << 15) -> str:
    """scrypt on the driver, as hexadecimal text."""
    import hashlib

    return hashlib.scrypt(passphrase.encode(), salt=salt, n=n, r=8, p=1, dklen=32, maxmem=1 << 27).hex()
