"""Best-fit packing of token sequences under several capacities at once.

Which bin an item goes to depends on its length alone, so the plan is made from the histogram of lengths, whose size
the capacity bounds, and bins of equal content are kept as one entry with a multiplicity. Documents then look up
their place by their rank among the pieces of their length.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import map_arrow, save

END = 0


@dataclass(frozen=True)
class Limits:
    """Capacities of a sequence. Attention cost is the sum of squared lengths of its documents."""

    tokens: int = 2048
    documents: int = 2048
    attention: int = 2048 * 2048


@dataclass(frozen=True)
class Weights:
    """Weights of the residual capacities, as shares of the whole, in a bin's score."""

    tokens: float = 1.0
    documents: float = 0.0
    attention: float = 0.25


def plan(histogram: dict[int, int], limits: Limits, rule: str = "norm", weights: Weights = Weights()) -> tuple[np.ndarray, int]:
    """Vector best-fit of ``histogram`` (length: pieces), longest first.

    Open bins of equal residuals are one entry (first sequence, how many, residual tokens, documents, attention). An
    item goes to the feasible entry with the smallest weighted norm of what remains after it ('norm'), or with the
    smallest weighted dot product of its demand and the residuals ('dot', so that the tightest dimensions decide); a bin once
    chosen takes items of the length while they fit. Returns rows (length, first rank, first sequence, items a bin,
    first offset), by length and rank, and the number of sequences. Deterministic.
    """
    cap = np.array([limits.tokens, limits.documents, limits.attention], np.float64)
    w = np.array([weights.tokens, weights.documents, weights.attention])
    size = 1024
    first, many, left = np.zeros(size, np.int64), np.zeros(size, np.int64), np.zeros((size, 3), np.int64)
    n, made, slots = 0, 0, []

    def push(seq: int, count: int, rest: tuple[int, int, int]) -> None:
        nonlocal n, size, first, many, left
        if count == 0 or min(rest[0], rest[1], rest[2]) <= 0:
            return
        same = np.flatnonzero((left[:n] == rest).all(1) & (first[:n] + many[:n] == seq))
        if len(same):
            many[same[0]] += count
            return
        if n == size:
            first, many, left, size = np.concatenate([first, first * 0]), np.concatenate([many, many * 0]), np.concatenate([left, left * 0]), 2 * size
        first[n], many[n], left[n] = seq, count, rest
        n += 1

    def fits(rest: np.ndarray, length: int) -> int:
        return int(min(rest[0] // length, rest[1], rest[2] // (length * length)))

    for length in sorted(histogram, reverse=True):
        todo, rank = histogram[length], 0
        need = np.array([length, 1, length * length], np.int64)
        if (need > cap).any():
            raise ValueError(f"a piece of {length} tokens fits no sequence")
        while todo:
            ok = np.flatnonzero((left[:n] >= need).all(1))
            if len(ok):
                rest = left[ok]
                score = (((rest - need) / cap) ** 2) @ w if rule == "norm" else (rest / cap * (need / cap)) @ w
                at = ok[np.lexsort((first[ok], score))[0]]
                seq, bins, rest = int(first[at]), int(many[at]), left[at].copy()
                n -= 1
                first[at], many[at], left[at] = first[n], many[n], left[n]
            else:
                rest = cap.astype(np.int64)
                seq, bins = made, -(-todo // fits(rest, length))
                made += bins
            each = fits(rest, length)
            offset = int(limits.tokens - rest[0])
            full = min(bins, todo // each)
            after = lambda k: tuple(int(x) for x in rest - k * need)  # noqa: B023, E731
            if full:
                slots.append((length, rank, seq, each, offset))
                push(seq, full, after(each))
                rank, todo, seq, bins = rank + full * each, todo - full * each, seq + full, bins - full
            if bins and todo:  # the last items of the length
                slots.append((length, rank, seq, each, offset))
                push(seq, 1, after(todo))
                seq, bins, todo = seq + 1, bins - 1, 0
            push(seq, bins, tuple(int(x) for x in rest))
    table = np.array(slots, np.int64).reshape(-1, 5)
    return table[np.lexsort((table[:, 1], table[:, 0]))], made


def place(pieces: DataFrame, limits: Limits = Limits(), rule: str = "norm", weights: Weights = Weights()) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to saved ``pieces``, which have length, part and rank (see ``tokenize``).

    The histogram has at most limits.tokens rows, the only thing that reaches the driver; the plan's slots, bounded by the
    capacity too and not by the rows, go to the executors with the function. A piece's rank among those of its length is
    its rank in its part plus the counts of the parts before. Empty table: no rows.
    """
    counts = save(pieces.groupBy("part", "length").agg(F.count("*").alias("n")))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots, _ = plan(histogram, limits, rule, weights)
    before = counts.select("part", "length", (F.sum("n").over(W.partitionBy("length").orderBy("part")) - F.col("n")).alias("before"))
    # ``before`` grows with the parts, so it meets the pieces, which are small rows, in a shuffle and is not broadcast.
    ranked = pieces.join(before.hint("merge"), ["part", "length"]).withColumn("rank", F.col("rank") + F.col("before")).drop("before", "part")
    key = (slots[:, 0].astype(np.int64) << 44) + slots[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = (b.column(b.schema.get_field_index(c)).to_numpy() for c in ("length", "rank"))
            at = slots[np.searchsorted(key, (length << 44) + rank, side="right") - 1]
            k = rank - at[:, 1]
            cols = [b.column(i) for i, c in enumerate(b.schema.names) if c != "rank"]
            names = [c for c in b.schema.names if c != "rank"]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(at[:, 2] + k // at[:, 3]), pa.array(at[:, 4] + k % at[:, 3] * length)], names=[*names, "sequence_id", "offset"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema if f.name != "rank")
    return map_arrow(ranked, run, f"{fields}, sequence_id long, offset long")


_ENCODERS: dict = {}
#: Fixed value: the pattern that a ByteLevel pre-tokenizer with use_regex cuts texts by.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _fast(spec: dict) -> bool:
    """Whether the file asks for nothing but byte-level merges after PATTERN."""
    cut, model = spec.get("pre_tokenizer") or {}, spec.get("model") or {}
    plain = cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space")
    odd = [spec.get(k) for k in ("normalizer", "truncation", "padding")] + [model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")]
    return plain and model.get("type") == "BPE" and not any(odd) and not any(t.get(k) for t in spec["added_tokens"] for k in ("lstrip", "rstrip", "single_word", "normalized"))


def encoder(path: str):
    """An encoder of the vocabulary in a tokenizers JSON file: text to ids, special tokens' strings included.

    Ids are those of the tokenizers library for that file (the tests hold them together); tiktoken merges the same
    ranks several times faster. Files that ask for more than byte-level merges after PATTERN, and texts that tiktoken's
    pattern matcher gives up on, such as those with a run of a million blanks, go to the library itself.
    """
    if path not in _ENCODERS:
        import tiktoken
        from tokenizers import Tokenizer

        spec = json.loads(open(path, encoding="utf-8").read())
        library = Tokenizer.from_file(path)
        if not _fast(spec):
            _ENCODERS[path] = lambda text: library.encode(text, add_special_tokens=False).ids
            return _ENCODERS[path]
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in set(plain)]
        byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(byte[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        own = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)

        def encode(text: str) -> list[int]:
            try:
                return own.encode(text, allowed_special="all")
            except ValueError:  # the matcher's stack is full
                return library.encode(text, add_special_tokens=False).ids

        _ENCODERS[path] = encode
    return _ENCODERS[path]


def tokenize(docs: DataFrame, tokenizer: str, limit: int = 2048, with_ids: bool = False) -> DataFrame:
    """The saved pieces of every document: doc_id, piece, start, length, ids_crc32 (and ids), part, rank.

    A document's ids are followed by END. Only documents over ``limit`` are cut, into pieces of ``limit`` of which the
    first may be shorter. Null texts are empty ones, of one token. ``rank`` counts the pieces of a length within ``part``,
    the task that wrote them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, seen = encoder(tokenizer), np.zeros(limit + 1, np.int64)
        for b in batches:
            for at in range(0, b.num_rows, 500):
                out = []
                for doc_id, part, text in zip(*(c.to_pylist() for c in b.slice(at, 500).columns), strict=True):
                    ids = np.array([*encode(text or ""), END], "<u4")
                    cut = [0, *range((len(ids) - 1) % limit + 1, len(ids) + 1, limit)]
                    for piece, (i, j) in enumerate(zip(cut, cut[1:], strict=False)):
                        out.append((doc_id, piece, i, j - i, zlib.crc32(ids[i:j].tobytes()), part, int(seen[j - i]), *([ids[i:j]] if with_ids else [])))
                        seen[j - i] += 1
                types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), *([pa.list_(pa.int64())] if with_ids else [])]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "rank", *(["ids"] if with_ids else [])]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.spark_partition_id().alias("part"), "text")
    return save(map_arrow(rows, run, "doc_id long, piece int, start long, length long, ids_crc32 long, part int, rank long" + ", ids array<long>" * with_ids))


def pack(docs: DataFrame, tokenizer: str, limits: Limits = Limits(), rule: str = "norm", weights: Weights = Weights(), with_ids: bool = False) -> DataFrame:
    """Every piece of every document (see ``tokenize``) with its sequence and place there (see ``place``).

    Null and empty texts are documents of one token, END. Very long texts are cut as a whole, never at a prefix. Repeated rows
    are documents each; ties between bins go to the one opened first, and which of the documents of one length gets which of its places is
    open. An empty table gives no rows. Columns other than doc_id and text may have any name.
    """
    return place(tokenize(docs, tokenizer, limits.tokens, with_ids), limits, rule, weights)


def _packed(spark: SparkSession, sf_dir: str, **how) -> DataFrame:
    import public_tokenizers

    packed = pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"), **how)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op4_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2048 tokens, the only limit that binds here; see ``pack``."""
    return _packed(spark, sf_dir)


#: Limits that bind: sequences of at most four documents whose attention costs three quarters of one long document's.
TIGHT = Limits(tokens=2048, documents=4, attention=2048 * 2048 * 3 // 4)


def packed_in_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents under TIGHT, bins chosen by weighted dot product; pieces are as long as the attention cost lets one be."""
    import public_tokenizers

    longest = int(TIGHT.attention**0.5)
    pieces = tokenize(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"), longest)
    packed = place(pieces, TIGHT, "dot", Weights(1.0, 0.5, 0.5))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
