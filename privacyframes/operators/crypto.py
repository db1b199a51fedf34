"""Envelope encryption of file bodies: a random data key per file, wrapped by a master key."""

from __future__ import annotations

import os

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed

NONCE, TAG = 12, 16


def random_bytes(n: int, per_row: Column) -> Column:
    """``n`` bytes from the operating system per row (SQL random functions are not cryptographic)."""

    @F.pandas_udf("binary")
    def draw(rows: pd.Series) -> pd.Series:
        return pd.Series([os.urandom(n) for _ in range(len(rows))])

    return draw.asNondeterministic()(per_row)


def b64url(data: Column) -> Column:
    return F.translate(F.base64(data), "+/\r\n", "-_")


def from_b64url(text: Column) -> Column:
    return F.try_to_binary(F.translate(text, "-_", "+/"), F.lit("base64"))


def _body(sealed: Column) -> Column:
    """Cipher text and tag without the leading nonce."""
    return F.substring(sealed, F.lit(NONCE + 1), F.octet_length(sealed))


def _nonce(sealed: Column) -> Column:
    return F.substring(sealed, 1, NONCE)


def encrypt(files: DataFrame, master_key: Column, content: str = "content") -> DataFrame:
    """Replace ``content`` by ``stored`` (packed envelope) plus key and hash columns. Narrow.

    Keys and nonces are random: write the result before using it twice.
    """
    drawn = files.withColumn("__r", random_bytes(32 + 2 * NONCE, F.octet_length(content)))
    dek, data_nonce, wrap_nonce = (
        F.substring("__r", 1, 32),
        F.substring("__r", 33, NONCE),
        F.substring("__r", 33 + NONCE, NONCE),
    )
    gcm, padding = F.lit("GCM"), F.lit("DEFAULT")
    sealed = drawn.withColumn("__sealed", F.aes_encrypt(F.col(content), dek, gcm, padding, data_nonce)).withColumn(
        "__wrapped", F.aes_encrypt(dek, master_key, gcm, padding, wrap_nonce)
    )
    return sealed.select(
        *[c for c in files.columns if c != content],
        pack(b64url(_nonce(F.col("__sealed"))), b64url(_nonce(F.col("__wrapped"))), _body(F.col("__sealed"))).alias("stored"),
        b64url(_body(F.col("__wrapped"))).alias("encrypted_dek"),
        F.lit(fixed.ENVELOPE_VERSION).alias("encryption_version"),
        F.sha2(F.col(content), 256).alias("file_sha256"),
        F.sha2(_body(F.col("__sealed")), 256).alias("cipher_sha256"),
    )


def pack(data_nonce: Column, wrap_nonce: Column, cipher: Column) -> Column:
    """``ENC2:<data nonce>:<wrap nonce>:<cipher>`` as bytes, all parts base64url."""
    return F.concat_ws(":", F.lit(fixed.ENVELOPE_PREFIX), data_nonce, wrap_nonce, b64url(cipher)).cast("binary")


def unpack(stored: Column) -> Column:
    """``struct<data_nonce, wrap_nonce, cipher>``, or null when the bytes are no envelope."""
    parts = F.split(stored.cast("string"), ":", 4)
    cipher = from_b64url(F.get(parts, F.lit(3)))
    ok = stored.cast("string").startswith(f"{fixed.ENVELOPE_PREFIX}:") & (F.size(parts) == 4) & cipher.isNotNull()
    return F.when(
        ok,
        F.struct(
            F.get(parts, F.lit(1)).alias("data_nonce"),
            F.get(parts, F.lit(2)).alias("wrap_nonce"),
            cipher.alias("cipher"),
        ),
    )


def decrypt(files: DataFrame, master_key: Column, legacy_key: Column | None = None) -> DataFrame:
    """Add ``content`` and ``status``: ok, cipher_mismatch, plain_mismatch or undecryptable. Narrow.

    Hashes are compared only where they are recorded. Records that are no envelope (or have no wrapped
    key) are tried as legacy tokens when ``legacy_key`` (a column of 32 bytes) is given. Keys from a joined table stay out of the plan.
    """
    env = F.col("__env")
    opened = files.withColumn("__env", unpack(F.col("stored")))
    wrapped = F.concat(from_b64url(env["wrap_nonce"]), from_b64url(F.col("encrypted_dek")))
    dek = F.try_aes_decrypt(wrapped, master_key, F.lit("GCM"))
    plain = F.try_aes_decrypt(F.concat(from_b64url(env["data_nonce"]), env["cipher"]), F.col("__dek"), F.lit("GCM"))
    is_env = env.isNotNull() & F.col("encrypted_dek").isNotNull() & (F.col("encrypted_dek") != "")
    staged = opened.withColumn("__dek", F.when(is_env, dek)).withColumn("__plain", F.when(is_env, plain))
    if legacy_key is not None:
        staged = staged.withColumn("__plain", F.when(is_env, F.col("__plain")).otherwise(open_legacy(F.col("stored"), legacy_key)))

    def differs(recorded: Column, actual: Column) -> Column:
        return F.coalesce((recorded != "") & (recorded != actual), F.lit(False))

    status = (
        F.when(is_env & differs(F.col("cipher_sha256"), F.sha2(env["cipher"], 256)), "cipher_mismatch")
        .when(F.col("__plain").isNull(), "undecryptable")
        .when(differs(F.col("file_sha256"), F.sha2(F.col("__plain"), 256)), "plain_mismatch")
        .otherwise("ok")
    )
    checked = staged.withColumn("status", status)
    content = F.when(F.col("status") == "ok", F.col("__plain"))
    return checked.withColumn("content", content).drop("__env", "__dek", "__plain")


def hmac_sha256(key: Column, message: Column) -> Column:
    """HMAC-SHA256 by built-in functions: the hash of a hash, each behind the padded key. Keys of up to 64 bytes."""

    def padded(byte: int) -> Column:
        # Each byte of the key, filled up with zeros, against a constant.
        whole = F.hex(F.rpad(key, F.lit(64), F.unhex(F.lit("00"))))
        pairs = F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.conv(F.substring(whole, i * 2 + 1, F.lit(2)), 16, 10).cast("int").bitwiseXOR(F.lit(byte)))
        return F.unhex(F.array_join(F.transform(pairs, lambda b: F.lpad(F.hex(b.cast("long")), 2, "0")), ""))

    inner = F.unhex(F.sha2(F.concat(padded(0x36), message), 256))
    return F.unhex(F.sha2(F.concat(padded(0x5C), inner), 256))


def open_legacy(stored: Column, key: Column) -> Column:
    """Plain bytes of a legacy token (version, time, iv, AES-CBC cipher, HMAC-SHA256), or null.

    ``key``: 32 bytes, the signing key and the encryption key; a column, so that it need not stand in the plan. All of it is built in.
    """
    signing, secret = F.substring(key, 1, 16), F.substring(key, 17, 16)
    token = from_b64url(stored.cast("string"))
    n = F.octet_length(token)
    whole = (n >= 73) & (F.substring(token, 1, 1) == F.unhex(F.lit("80")))
    signed = hmac_sha256(signing, F.substring(token, F.lit(1), n - 32)) == F.substring(token, n - 31, F.lit(32))
    plain = F.try_aes_decrypt(F.substring(token, F.lit(10), n - 41), secret, F.lit("CBC"), F.lit("PKCS"))
    return F.when(whole & signed, plain)
