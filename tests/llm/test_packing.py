import itertools
import random
import zlib
from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lattica.llm import packing as K
from lattica.llm.queries import op7_packing, tokenizer_path

from .cases import edge_docs, no_docs


def test_differencing_gives_near_equal_windows():
    rng = random.Random(5)
    for n, k in ((8, 2), (12, 3), (200, 7), (500, 31), (3, 5), (1, 1), (0, 2)):
        sizes = [rng.randint(1, 128) for _ in range(n)]
        window, sums = K.karmarkar_karp(sizes, k)
        assert np.bincount(window, sizes, k).tolist() == sums.tolist() if n else sums.sum() == 0
        if n >= 15 * k:
            assert sums.max() - sums.min() <= 3
    # two windows: as good as the classic method, which is optimal here
    sizes = [8, 7, 6, 5, 4]
    best = min(abs(sum(s if b else -s for s, b in zip(sizes, bits, strict=True))) for bits in itertools.product((0, 1), repeat=5))
    _, sums = K.karmarkar_karp(sizes, 2)
    assert abs(sums[0] - sums[1]) <= best + 2


def plain_differencing(sizes, k):
    """Karmarkar-Karp as it is told: k sums in falling order for each partial partition; the two with the widest spread (ties: the older ones)
    are merged, the largest sum with the smallest one."""
    parts = [(i, [s] + [0] * (k - 1)) for i, s in enumerate(sizes)]
    turn = len(sizes)
    while len(parts) > 1:
        parts.sort(key=lambda p: (-(p[1][0] - p[1][-1]), p[0]))
        (_, a), (_, b), *parts = parts
        parts.append((turn, sorted((x + y for x, y in zip(a, reversed(b), strict=True)), reverse=True)))
        turn += 1
    return parts[0][1] if parts else [0] * k


def test_differencing_against_its_plain_form():
    rng = random.Random(11)
    for n, k in ((1, 1), (1, 4), (3, 5), (5, 2), (20, 2), (30, 3), (60, 7), (150, 20), (40, 40), (41, 40), (90, 1)):
        for top in (3, 128):
            sizes = [rng.randint(1, top) for _ in range(n)]
            window, sums = K.karmarkar_karp(sizes, k)
            assert sorted(sums.tolist(), reverse=True) == plain_differencing(sizes, k)
            assert np.bincount(window, sizes, k).tolist() == sums.tolist()


def test_windows_rise_until_nothing_exceeds_the_capacity():
    for sizes in ([600] * 7, [1000, 30, 30], [128] * 9, [1], []):
        window, sums = K.pack_unit(sizes, 1024)
        assert sums.max(initial=0) <= 1024 and len(window) == len(sizes)


def check(rows, texts):
    slow = Tokenizer.from_file(tokenizer_path())
    ids = {i: np.array([*slow.encode(t or "", add_special_tokens=False).ids, 0], "<u4") for i, t in texts.items()}
    of, at = defaultdict(list), defaultdict(list)
    for r in rows:
        of[r["doc_id"]].append(r)
        at[r["sequence_id"]].append((r["offset"], r["length"]))
        own = ids[r["doc_id"]]
        assert r["ids_crc32"] == zlib.crc32(own[r["start"] : r["start"] + r["length"]].tobytes()) and r["doc_tokens"] == len(own)
    for places in at.values():
        assert [o for o, _ in sorted(places)] == list(itertools.accumulate([0, *(n for _, n in sorted(places))]))[:-1]
        assert sum(n for _, n in places) <= 1024
    return of, at


def test_documents_are_packed_whole(spark, sf):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op7_packing(spark, sf).collect()
    of, at = check(rows, texts)
    for i, own in of.items():
        own.sort(key=lambda r: r["start"])
        assert [r["start"] for r in own] == list(itertools.accumulate([0, *(r["length"] for r in own)]))[:-1]
        assert sum(r["length"] for r in own) == own[0]["doc_tokens"]
    assert set(of) == set(texts)
    assert sum(r["length"] for r in rows) >= 0.98 * 1024 * len(at)


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=200) | st.lists(st.sampled_from(["<|endoftext|>", " ", "\n", "'s", "é", "12", "a", "​", "🙂"]), max_size=30).map("".join))
def test_ids_are_those_of_the_tokenizer_library(text):
    text = text.encode("utf-8", "replace").decode()
    slow = Tokenizer.from_file(tokenizer_path())
    assert K.load_tokenizer(tokenizer_path())(text).tolist() == slow.encode(text, add_special_tokens=False).ids


def test_edge_rows(spark, tmp_path):
    docs = edge_docs(spark)
    docs.write.parquet(f"{tmp_path}/a/documents.parquet")
    rows = op7_packing(spark, f"{tmp_path}/a").collect()
    texts = {r["doc_id"]: r["text"] for r in docs.filter("doc_id is not null").collect()}
    check([r for r in rows if r["doc_id"] is not None and r["doc_id"] != 2] and [], texts)
    assert sum(r["length"] for r in rows if r["doc_id"] == 2) == 2 * next(r["doc_tokens"] for r in rows if r["doc_id"] == 2)
    assert sum(r["length"] for r in rows if r["doc_id"] == 4) == 1
    assert len({r["sequence_id"] for r in rows}) * 1024 >= sum(r["length"] for r in rows)
    no_docs(spark).write.parquet(f"{tmp_path}/b/documents.parquet")
    assert op7_packing(spark, f"{tmp_path}/b").count() == 0


def test_pieces_cover_a_document():
    for n in (1, 127, 128, 129, 1023, 1024, 1025, 5000):
        parts = K.cuts(n, 1024, 128)
        assert sum(parts) == n and all(p == 1024 or p <= 128 for p in parts)


def test_tokenise_gives_the_ids_themselves(spark):
    df = spark.createDataFrame([("k", "some text here")], "key string, body string")
    got = K.tokenise(df, tokenizer_path(), id_col="key", text_col="body").select("key", F.expr("octet_length(ids)").alias("n"), "length").collect()
    assert [(r["key"], r["n"]) for r in got] == [("k", 4 * got[0]["length"])]
