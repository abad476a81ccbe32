"""Envelope encryption: one data key for all bodies, wrapped by any number of key-encryption keys.

Bodies are encrypted with the data key by Spark; a wrapper (a passphrase or a given key) only encrypts the data key, so
wrappers come, go and change without a body being touched. Keys are hexadecimal texts on the driver and are never logged.
"""

from __future__ import annotations

import os
import time
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .security import derive_key

#: What a data key encrypts to prove itself; how a sealed body begins.
CHECK, SEALED = "lorekeep-vault", "sealed:"


@dataclass(frozen=True)
class Wrapper:
    name: str
    salt: str
    rounds: int
    wrapped: str


@dataclass(frozen=True)
class Vault:
    """What may be stored: wrappers and the check value, never a key."""

    check: str
    wrappers: tuple[Wrapper, ...]


@dataclass
class Unlocked:
    """A data key in memory, which locks itself a while after its last use."""

    key: str = field(repr=False)
    ttl: float = 900.0
    used: float = field(default_factory=time.monotonic)

    def get(self) -> str:
        now = time.monotonic()
        if not self.key or now - self.used > self.ttl:
            self.key = ""
            raise PermissionError("the vault is locked")
        self.used = now
        return self.key

    def lock(self) -> None:
        self.key = ""


def crypted(spark: SparkSession, text: str, key: str) -> str:
    return spark.range(1).select(F.base64(F.aes_encrypt(F.lit(text), F.unhex(F.lit(key)), F.lit("GCM")))).first()[0]


def plain(spark: SparkSession, text: str, key: str) -> str | None:
    """None where the key is wrong."""
    return spark.range(1).select(F.try_aes_decrypt(F.unbase64(F.lit(text)), F.unhex(F.lit(key)), F.lit("GCM")).cast("string")).first()[0]


def wrapper(spark: SparkSession, name: str, passphrase: str, key: str, rounds: int) -> Wrapper:
    salt = os.urandom(16)
    return Wrapper(name, salt.hex(), rounds, crypted(spark, key, derive_key(passphrase, salt, rounds)))


def create(spark: SparkSession, name: str, passphrase: str, rounds: int = 1 << 15) -> tuple[Vault, Unlocked]:
    key = os.urandom(32).hex()
    return Vault(crypted(spark, CHECK, key), (wrapper(spark, name, passphrase, key, rounds),)), Unlocked(key)


def unlock(spark: SparkSession, vault: Vault, passphrase: str, name: str | None = None) -> Unlocked:
    """The data key by any wrapper (or the named one) that the passphrase opens; the check value must agree."""
    for w in vault.wrappers:
        if name in (None, w.name):
            key = plain(spark, w.wrapped, derive_key(passphrase, bytes.fromhex(w.salt), w.rounds))
            if key and plain(spark, vault.check, key) == CHECK:
                return Unlocked(key)
    raise PermissionError("no wrapper opens with this passphrase")


def add_wrapper(spark: SparkSession, vault: Vault, unlocked: Unlocked, name: str, passphrase: str, rounds: int = 1 << 15) -> Vault:
    """vault with one more wrapper, or another one of that name; bodies stay as they are."""
    others = tuple(w for w in vault.wrappers if w.name != name)
    return replace(vault, wrappers=(*others, wrapper(spark, name, passphrase, unlocked.get(), rounds)))


def remove_wrapper(vault: Vault, name: str) -> Vault:
    left = tuple(w for w in vault.wrappers if w.name != name)
    if not left:
        raise ValueError("the last wrapper must stay")
    return replace(vault, wrappers=left)


def seal(body: Column, key: str) -> Column:
    return F.concat(F.lit(SEALED), F.base64(F.aes_encrypt(body, F.unhex(F.lit(key)), F.lit("GCM"))))


def unseal(body: Column, key: str) -> Column:
    """Null where the key is wrong."""
    return F.try_aes_decrypt(F.unbase64(F.substring(body, len(SEALED) + 1, 1 << 30)), F.unhex(F.lit(key)), F.lit("GCM")).cast("string")


def levelled(rows: DataFrame, unlocked: Unlocked, column: str = "content") -> DataFrame:
    """rows whose bodies are sealed where sensitivity is secret and plain elsewhere, whatever they were: what agrees already is left as it is."""
    key, sealed, secret = unlocked.get(), F.startswith(F.col(column), F.lit(SEALED)), F.col("sensitivity") == "secret"
    return rows.withColumn(column, F.when(secret & ~sealed, seal(F.col(column), key)).when(~secret & sealed, unseal(F.col(column), key)).otherwise(F.col(column)))


def opened(rows: DataFrame, unlocked: Unlocked, column: str = "content") -> DataFrame:
    return rows.withColumn(column, F.when(F.startswith(F.col(column), F.lit(SEALED)), unseal(F.col(column), unlocked.get())).otherwise(F.col(column)))


def rekeyed(spark: SparkSession, rows: DataFrame, unlocked: Unlocked, name: str, passphrase: str, column: str = "content", rounds: int = 1 << 15) -> tuple[DataFrame, Vault, Unlocked]:
    """Another data key for all sealed bodies, with one wrapper: for when the key itself may be known."""
    vault, new = create(spark, name, passphrase, rounds)
    sealed = F.startswith(F.col(column), F.lit(SEALED))
    return rows.withColumn(column, F.when(sealed, seal(unseal(F.col(column), unlocked.get()), new.get())).otherwise(F.col(column))), vault, new
