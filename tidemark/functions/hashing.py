"""Deterministic hashing: tenants, hold-out split, samples, content hashes and fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

TENANTS, HELD_OUT_MOD = 50, 10


def digest(seed: Column) -> Column:
    """The first 8 bytes of SHA-256, unsigned and big-endian."""
    return F.conv(F.substring(F.sha2(seed.cast("binary"), 256), 1, 16), 16, 10).cast("decimal(20,0)")


def _seeded(prefix: str, number: Column) -> Column:
    return digest(F.concat(F.lit(f"{prefix}:"), number.cast("string")))


def tenant_of(number: Column, tenants: int = TENANTS) -> Column:
    return (_seeded("tenant", number) % tenants).cast("int")


def is_held_out(number: Column, mod: int = HELD_OUT_MOD) -> Column:
    return _seeded("heldout", number) % mod == 0


def hash_sample(df: DataFrame, key: str, n: int = 30, salt: str = "spot") -> DataFrame:
    """The n rows that come first by a salted hash of the key, sorted by key. Only n rows pass the top-k."""
    draw = F.sha2(F.concat(F.lit(f"{salt}:"), F.col(key).cast("string")), 256)
    return df.withColumn("_draw", draw).orderBy("_draw").limit(n).drop("_draw").orderBy(key)


def content_hashes(chunks: DataFrame, page: str, order: str, text: str) -> DataFrame:
    """md5 of each page's chunk texts, joined by line breaks in order."""
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text]), "\n")
    return chunks.where(F.col(text).isNotNull()).groupBy(page).agg(F.md5(joined).alias("content_hash"))


def fingerprint(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(n_rows, fingerprint) that changes with any row. Order-free, so it needs neither a sort nor one long string.

    Two 28-bit parts of each row's md5 are summed, which keeps repeated rows apart where an exclusive or would cancel them.
    """
    row = F.md5(F.concat_ws("|", F.col(key).cast("string"), F.md5(F.coalesce(F.col(text), F.lit("")))))
    part = lambda at: F.conv(F.substring(row, at, 7), 16, 10).cast("bigint")
    sums = rows.agg(F.count("*").alias("n_rows"), F.coalesce(F.sum(part(1)), F.lit(0)).alias("a"), F.coalesce(F.sum(part(8)), F.lit(0)).alias("b"))
    return sums.select("n_rows", F.substring(F.md5(F.concat_ws("|", *(F.col(c).cast("string") for c in ("n_rows", "a", "b")))), 1, 12).alias("fingerprint"))


def check_fingerprint(rows: DataFrame, key: str, text: str, baseline: tuple[int, str] | None) -> tuple[int, str]:
    """The fingerprint; fails if it differs from the baseline, which the first run records."""
    got = tuple(fingerprint(rows, key, text).first())
    if baseline is not None and got != tuple(baseline):
        raise ValueError(f"corpus drifted: {got} instead of {tuple(baseline)}")
    return got
