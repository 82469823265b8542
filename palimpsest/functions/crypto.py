"""Encryption of documents at rest: AES-256-GCM columns whose associated data binds a document to its row, and wrapped table keys."""

from __future__ import annotations

import base64
import secrets

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..errors import DecryptionError


def encrypt(text: Column, key: Column, aad: Column) -> Column:
    """Base 64 of nonce, ciphertext and tag; a fresh random nonce for each value."""
    return F.base64(F.aes_encrypt(text, key, F.lit("GCM"), F.lit("DEFAULT"), F.lit("").cast("binary"), aad))


def decrypt(text: Column, key: Column, aad: Column) -> Column:
    """The plain text; the job fails where key, row or data differ from what was encrypted."""
    return F.aes_decrypt(F.unbase64(text), key, F.lit("GCM"), F.lit("DEFAULT"), aad).cast("string")


class NoCipher:
    """Leaves columns as they are."""

    def encrypted(self, text: Column, table: str, aad: Column) -> Column:
        return text

    decrypted = encrypted


class KeyStore:
    """A data key for each table, wrapped by a master key of 32 bytes. Rotating the master key wraps anew and touches no data."""

    def __init__(self, spark: SparkSession, master: bytes, wrapped: dict[str, str] | None = None):
        if len(master) != 32:
            raise DecryptionError("a master key has 32 bytes")
        self._spark, self._master, self.wrapped = spark, master, dict(wrapped or {})
        self._plain: dict[str, bytes] = {}
        for table in self.wrapped:
            self.key(table)

    def _run(self, expression: Column):
        return self._spark.range(1).select(expression.alias("x")).first()["x"]

    def key(self, table: str) -> bytes:
        """The table's data key."""
        if table not in self._plain:
            if table not in self.wrapped:
                raise DecryptionError(f"{table} has no key")
            try:
                self._plain[table] = base64.b64decode(self._run(decrypt(F.lit(self.wrapped[table]), F.lit(self._master), F.lit(table.encode()))))
            except Exception as e:
                raise DecryptionError(f"the key of {table} doesn't open with this master key") from e
        return self._plain[table]

    def make(self, table: str) -> None:
        """Makes the table's data key, unless it has one."""
        if table not in self.wrapped:
            self._plain[table] = secrets.token_bytes(32)
            self.wrapped[table] = self._run(encrypt(F.lit(base64.b64encode(self._plain[table]).decode()), F.lit(self._master), F.lit(table.encode())))

    def merge(self, wrapped: dict[str, str]) -> None:
        """Takes the keys that another driver has added."""
        for table, key in wrapped.items():
            if self.wrapped.get(table) != key:
                self.wrapped[table] = key
                self._plain.pop(table, None)

    def rotate(self, master: bytes) -> None:
        keys = {table: self.key(table) for table in self.wrapped}
        self._master = master
        for table, key in keys.items():
            self.wrapped[table] = self._run(encrypt(F.lit(base64.b64encode(key).decode()), F.lit(master), F.lit(table.encode())))

    def encrypted(self, text: Column, table: str, aad: Column) -> Column:
        return F.when(text.isNotNull(), encrypt(text, F.lit(self.key(table)), aad))

    def decrypted(self, text: Column, table: str, aad: Column) -> Column:
        return F.when(text.isNotNull(), decrypt(text, F.lit(self.key(table)), aad))
