"""Packing of tokenised documents into fixed windows by Karmarkar-Karp multiway differencing.

A document's tokens (and an end token) are cut into whole windows and a remainder, and the remainder into
pieces of nearly equal size, `piece` at most.  Whole windows are sequences of their own.  The other
pieces meet in units of `unit` pieces, dealt by a hash; in a unit, partial partitions (sorted sums of k windows)
are merged two at a time, those with the widest imbalance first, the largest window of one with the
smallest of the other, so that opposing imbalances cancel.  k starts at the least count that could hold the unit and
rises by one as long as a window exceeds its capacity.

A unit is one bounded chunk of a sorted partition, so no task holds more than one unit whatever the group sizes;
sequence_id is (task's partition << 32) + a running number.  Each id of a document lies in one piece.

Remainders are cut to pieces of `piece` tokens because small pieces are what differencing evens out; the price is that a document
of some hundred tokens lies in several sequences.  `piece` is a parameter: with the window's size a remainder stays whole.

Null text counts as empty (only the end token).  Repeated rows are packed as often as they come; a null id
is packed like any other.  Very long texts are tokenised whole and handed on in frames of about a million tokens.  Pieces of equal
length are taken in the order of their keys' hashes.  An empty table gives no sequences.  `tokenise` ignores other columns; `pack`
carries them along, but for columns named sequence_id and offset, which it replaces by its own.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import wide_rows
from .hashing import encode


# ---------------------------------------------------------------- tokens


@lru_cache(4)
def load_tokenizer(path: str):
    """text -> ids for a byte-level BPE file of the `tokenizers` library.

    If the file's ids follow its merges, the same merges run in tiktoken, which is several times
    as fast; texts that may hold a special token go through `tokenizers` itself."""
    import tiktoken
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    as_byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
    pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
    pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
    same = norm is None and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
    same = same and all(vocab.get(a + b) == 256 + i for i, (a, b) in enumerate(pairs))

    def ids(text: str) -> np.ndarray:
        return np.array(slow.encode(text, add_special_tokens=False).ids, np.uint32)

    if not same:
        return ids
    added = {t["content"] for t in spec.get("added_tokens", [])}
    ranks = {bytes(as_byte[c] for c in token): i for token, i in vocab.items() if token not in added}
    # fixed value: the pattern that byte-level pre-tokenisation splits texts by
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    fast = tiktoken.Encoding("lattica", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return lambda text: ids(text) if any(t in text for t in added) else np.array(fast.encode_ordinary(text), np.uint32)


def cuts(n: int, window: int, piece: int) -> list[int]:
    """Lengths of the pieces of n tokens: whole windows, then nearly equal parts of the rest."""
    out, rest = [window] * (n // window), n % window
    if rest:
        k = -(-rest // piece)
        out += [rest * (i + 1) // k - rest * i // k for i in range(k)]
    return out


def tokenise(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", window: int = 1024, piece: int = 128, end: int = 0) -> DataFrame:
    """id_col, start, length, ids (little-endian unsigned 32-bit), doc_tokens: a row for each piece."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids_of = load_tokenizer(tokenizer)
        for pdf in batches:
            rows, size = [], 0
            for key, text in zip(pdf["id"], pdf["text"], strict=True):
                ids = np.append(ids_of(encode(text).decode("utf-8", "replace")), np.uint32(end)).astype("<u4")
                at = 0
                for n in cuts(len(ids), window, piece):
                    rows.append((key, at, n, ids[at : at + n].tobytes(), len(ids)))
                    at += n
                size += len(ids)
                if size > 1 << 20:
                    yield pd.DataFrame(rows, columns=columns).astype({"id": pdf["id"].dtype})
                    rows, size = [], 0
            yield pd.DataFrame(rows, columns=columns).astype({"id": pdf["id"].dtype})

    wide_rows(docs.sparkSession)
    columns = ["id", "start", "length", "ids", "doc_tokens"]
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = slim.schema["id"].dataType.simpleString()
    out = slim.mapInPandas(run, f"id {kind}, start long, length long, ids binary, doc_tokens long")
    return out.withColumnRenamed("id", id_col)


# ---------------------------------------------------------------- differencing


def karmarkar_karp(sizes: list[int], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Window of each size, and the windows' sums, by multiway differencing into k windows.

    A partial partition keeps its non-empty windows by falling sum, each a chain of sizes."""
    n = len(sizes)
    follow = np.full(n, -1)
    parts: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
    heap = []
    for i, s in enumerate(sizes):
        parts[i] = (np.array([s]), np.array([i]), np.array([i]))
        heap.append((-s if k > 1 else 0, i))
    heapq.heapify(heap)
    turn = n
    while len(heap) > 1:
        (_, a), (_, b) = heapq.heappop(heap), heapq.heappop(heap)
        (sa, ha, ta), (sb, hb, tb) = parts.pop(a), parts.pop(b)
        both = len(sa) + len(sb) - k  # windows in which something of either lies
        if both > 0:
            # the smallest windows of a take the smallest-but-largest-first of b: sums of opposite ends
            xa, xb = slice(len(sa) - both, len(sa)), slice(len(sb) - both, len(sb))
            s2, h2, t2 = sa[xa] + sb[xb][::-1], ha[xa], tb[xb][::-1]
            follow[ta[xa]] = hb[xb][::-1]
            s = np.concatenate([sa[: xa.start], s2, sb[: xb.start]])
            h = np.concatenate([ha[: xa.start], h2, hb[: xb.start]])
            t = np.concatenate([ta[: xa.start], t2, tb[: xb.start]])
        else:
            s, h, t = np.concatenate([sa, sb]), np.concatenate([ha, hb]), np.concatenate([ta, tb])
        order = np.argsort(-s, kind="stable")
        s, h, t = s[order], h[order], t[order]
        parts[turn] = (s, h, t)
        heapq.heappush(heap, (-int(s[0] - (s[-1] if len(s) == k else 0)), turn))
        turn += 1
    window, sums = np.zeros(n, np.int64), np.zeros(k, np.int64)
    if n:
        s, h, _ = parts.popitem()[1]
        sums[: len(s)] = s
        for w, i in enumerate(h.tolist()):
            while i >= 0:
                window[i] = w
                i = int(follow[i])
    return window, sums


def pack_unit(sizes: list[int], capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows of a unit; their count rises until none exceeds the capacity."""
    k = max(1, -(-sum(sizes) // capacity))
    while True:
        window, sums = karmarkar_karp(sizes, k)
        if sums.max(initial=0) <= capacity:
            return window, sums
        k += 1


def pack(pieces: DataFrame, keys: list[str], size_col: str = "length", window: int = 1024, unit: int = 2048) -> DataFrame:
    """pieces with sequence_id and offset.  keys tell rows apart as far as they can (rows that they
    don't may be exchanged)."""
    if clash := {"sequence_id", "offset"} & set(pieces.columns):
        pieces = pieces.drop(*clash)
    schema = pieces.schema

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made, rest = TaskContext.get().partitionId() << 32, None
        for pdf in batches:
            whole = pdf[size_col].to_numpy() == window
            if whole.any():
                own = pdf[whole].copy()
                own["sequence_id"], own["offset"] = np.arange(made, made + len(own)), 0
                made += len(own)
                yield own
            rest = pdf[~whole] if rest is None else pd.concat([rest, pdf[~whole]], ignore_index=True)
            while len(rest) >= unit:
                out, made = place(rest.iloc[:unit], made)
                yield out
                rest = rest.iloc[unit:]
        if rest is not None and len(rest):
            yield place(rest, made)[0]

    def place(pdf: pd.DataFrame, made: int) -> tuple[pd.DataFrame, int]:
        sizes = pdf[size_col].to_numpy()
        slot, sums = pack_unit(sizes.tolist(), window)
        order = np.argsort(slot, kind="stable")
        before = np.cumsum(sizes[order]) - sizes[order]
        first = np.zeros(len(sums), np.int64)
        first[slot[order][::-1]] = before[::-1]
        pdf = pdf.iloc[order].copy()
        pdf["sequence_id"] = made + slot[order]
        pdf["offset"] = before - first[slot[order]]
        return pdf, made + len(sums)

    out = _with(schema, "sequence_id long, offset long")
    dealt = F.xxhash64(*keys)
    return pieces.repartition(dealt).sortWithinPartitions(dealt, *keys).mapInPandas(run, out)


def _with(schema, more: str) -> str:
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields), more])
