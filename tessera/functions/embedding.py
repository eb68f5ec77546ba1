"""Hashed embeddings: each term adds its sign to one of ``dim`` places; vectors have unit length."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf


def md5_code(terms: list[str], dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Place and sign of each term: first 8 hex digits of its MD5 modulo dim; sign by the tenth."""
    digests = np.frombuffer(b"".join(hashlib.md5(t.encode()).digest() for t in terms), np.uint8).reshape(-1, 16)
    return digests[:, :4].astype(np.int64) @ (256 ** np.arange(3, -1, -1)) % dim, 1 - 2 * (digests[:, 4] & 1).astype(np.int64)


def blake2b_code(terms: list[str], dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Place and sign of each term: the first four bytes of its 8-byte digest, big-endian, modulo dim; sign by the fifth byte's parity."""
    digests = np.frombuffer(b"".join(hashlib.blake2b(t.encode(), digest_size=8).digest() for t in terms), np.uint8).reshape(-1, 8)
    return digests[:, :4].astype(np.int64) @ (256 ** np.arange(3, -1, -1)) % dim, 1 - 2 * (digests[:, 4] & 1).astype(np.int64)


def md5_sparse(sums: DataFrame) -> DataFrame:
    """(id, place, value) of the places that are not zero, from sums (id, place, v) of which an id may have several; one shuffle by id."""
    whole = sums.repartition("id").groupBy("id", "place").agg(F.sum("v").alias("v")).filter("v <> 0")
    norm = F.sqrt(F.sum(F.col("v") * F.col("v")).over(W.partitionBy("id")))
    return whole.select("id", "place", (F.col("v") / norm).alias("value"))


def blake2b(terms: Column, dim: int) -> Column:
    """Dense vector of an array of terms; Spark has no BLAKE2b, so Python hashes each distinct term of an Arrow batch once.

    No terms, or null, give zeros. A task holds a batch of lists: whole corpora go through ``counts.hashed``.
    """

    @pandas_udf("array<double>")
    def embed(column: pd.Series) -> pd.Series:
        sizes = column.map(lambda t: 0 if t is None else len(t)).to_numpy(np.int64)
        if not sizes.sum():
            return pd.Series([np.zeros(dim)] * len(column))
        code, distinct = pd.factorize(np.concatenate([t for t in column if t is not None and len(t)]))
        place, sign = blake2b_code(distinct, dim)
        row = np.repeat(np.arange(len(column)), sizes)
        grid = np.bincount(row * dim + place[code], sign[code], len(column) * dim).reshape(-1, dim)
        norm = np.linalg.norm(grid, axis=1, keepdims=True)
        return pd.Series(list(grid / np.where(norm > 0, norm, 1.0)))

    return embed(terms)
