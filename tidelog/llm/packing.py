"""Best-fit packing by minimum bin slack.

Documents are tokenised where they are read; a document longer than a sequence is cut
into full pieces, its first piece taking the remainder. What the packer sees is only
the histogram of piece lengths (at most ``size`` rows, whatever the input). For each
bin it seeds the longest length left and finds, by a subset-sum dynamic programme on
integers used as bit sets over the available lengths, the combination that fills the
bin fullest. That combination is then removed as often as the counts allow, so every
step exhausts a length and there are at most ``size`` steps.

A combination is a row of the plan: lengths, how many of each, and how many bins. The
pieces of one length are numbered 0, 1, 2, ... (per salt, plus the salt's offset, so a
hot length is never one task's), and a number decides the bin and the place in it.

Defined results: null text is empty: its document is the end-of-text id alone; an empty
table packs into no sequence; repeated rows are packed each; doc_id may be null.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

SIZE, END = 2048, 0
PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long"


class Encoder:
    """Token ids as ``tokenizers`` gives them; the faster ``tiktoken`` runs the same
    vocabulary where the two agree by construction (no special token in the text)."""

    def __init__(self, tokenizer: str):
        from tokenizers import Tokenizer

        self.plain = Tokenizer.from_file(tokenizer)
        self.special = [t.content for t in self.plain.get_added_tokens_decoder().values()]
        self.fast = None
        ranks = tokenizer.removesuffix(".json") + ".tiktoken"
        try:
            import base64

            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
        except (ImportError, FileNotFoundError):
            self.fast = None

    def ids(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, "<u4")
        if self.fast is None or any(t in text for t in self.special):
            return np.array(self.plain.encode(text, add_special_tokens=False).ids, "<u4")
        return self.fast.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False)


def cut_points(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n ids; the first may be shorter."""
    head = n % size or min(n, size)
    return [(0, head)] + [(at, size) for at in range(head, n, size)]


def _tokenise(tokenizer: str, size: int, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tokenizer)
        for b in common.steps(batches):
            rows: list[tuple] = []
            for i, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                ids = np.append(encoder.ids(text), np.array([end], "<u4")).astype("<u4", copy=False)
                rows += [(i, k, at, n, zlib.crc32(ids[at : at + n].tobytes())) for k, (at, n) in enumerate(cut_points(len(ids), size))]
            cols = list(zip(*rows))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64()))], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def fullest(counts: np.ndarray, room: int) -> list[int]:
    """Lengths, longest first, of a combination with the largest sum up to ``room``;
    ``counts[l]`` pieces of length l are available. Bit i of a set: sum i is reachable."""
    reach, mask, trail = 1, (1 << (room + 1)) - 1, []
    for length in np.flatnonzero(counts[: room + 1])[::-1]:
        length, left, part = int(length), min(int(counts[length]), room // int(length)), 1
        if not length:
            continue
        while left:  # binary splitting of the available pieces
            n = min(part, left)
            trail.append((length, n, reach))
            reach |= (reach << (length * n)) & mask
            left -= n
            part *= 2
        if reach >> room:
            break
    total, out = reach.bit_length() - 1, []
    for length, n, before in reversed(trail):
        if not before >> total & 1:
            out += [length] * n
            total -= length * n
    return sorted(out, reverse=True)


def plan_bins(counts: np.ndarray, size: int = SIZE) -> list[tuple[int, list[tuple[int, int]]]]:
    """Minimum bin slack over the histogram: [(bins, [(length, pieces of it in a bin)])]."""
    counts = counts.astype(np.int64).copy()
    plan = []
    while len(left := np.flatnonzero(counts)):
        seed = int(left[-1])
        counts[seed] -= 1
        chosen = [seed, *fullest(counts, size - seed)]
        counts[seed] += 1
        each = {n: chosen.count(n) for n in dict.fromkeys(chosen)}
        bins = min(int(counts[n]) // k for n, k in each.items())
        for n, k in each.items():
            counts[n] -= k * bins
        plan.append((bins, list(each.items())))
    return plan


def _places(plan, size: int) -> dict[str, np.ndarray]:
    """By length and first number: what a piece needs to find its bin; (length, base) ascend."""
    used, rows, first = np.zeros(size + 1, np.int64), [], 0
    for bins, each in plan:
        offset = 0
        for n, k in each:
            rows.append((n, used[n], k, first, offset))
            used[n] += k * bins
            offset += n * k
        first += bins
    rows.sort()
    cols = np.array(rows, np.int64).reshape(-1, 5).T
    return dict(zip(("length", "base", "k", "first", "offset"), cols))


def _place(places: dict[str, np.ndarray]):
    key = (places["length"].astype(np.uint64) << np.uint64(50)) | places["base"].astype(np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, number = (b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "number"))
            at = np.searchsorted(key, (n.astype(np.uint64) << np.uint64(50)) | number.astype(np.uint64), "right") - 1
            j, k = number - places["base"][at], places["k"][at]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("piece"), b.column("start"), pa.array(n), b.column("ids_crc32"), pa.array(places["first"][at] + j // k), pa.array(places["offset"][at] + j % k * n)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, tokenizer: str, size: int = SIZE, end: int = END, rows_per_salt: int = 10_000) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset), a row per piece."""
    pieces = common.stored(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_tokenise(tokenizer, size, end), PIECES), "pieces")
    n = pieces.count()
    salts = max(1, n // rows_per_salt)
    pieces = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)).cast("int"))
    cells = pieces.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    cells = common.stored(cells.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))).fillna(0, ["before"]), "cells")
    counts = np.zeros(size + 1, np.int64)
    for r in cells.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most ``size`` rows
        counts[r["length"]] = r["n"]
    places = _places(plan_bins(counts, size), size)
    numbered = pieces.withColumn("local", F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32")))
    numbered = numbered.join(cells.select("length", "salt", "before"), ["length", "salt"]).withColumn("number", F.col("before") + F.col("local") - 1)
    return numbered.mapInArrow(_place(places), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
