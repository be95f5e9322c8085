import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lattica.llm import simhash as S

from .cases import edge_docs, no_docs


def plain_fingerprint(text, n=3):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes))


def plain_groups(pairs, near):
    """Least id reachable, for (id, key) rows whose keys are linked by near(a, b)."""
    keys = sorted({k for _, k in pairs})
    parent = {k: k for k in keys}

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if near(a, b):
                parent[find(a)] = find(b)
    least = {}
    for i, k in pairs:
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return [(i, least.get(find(k))) for i, k in pairs]


def test_fingerprint_is_the_definition():
    for t in ["", "one", "one two", "A b C d e", "x\x0by\x0cz w q", "ÄÖ äö Ä"]:
        assert S.fingerprint_bytes(t.encode()) == plain_fingerprint(t)


def test_bk_tree_finds_all_within_radius():
    rng = random.Random(1)
    values = [rng.getrandbits(12) for _ in range(300)]
    for radius in (0, 1, 2, 3):
        tree, seen = S.BKTree(), []
        for v in values:
            assert sorted(set(tree.near_then_add(v, radius))) == sorted({u for u in seen if (u ^ v).bit_count() <= radius})
            seen.append(v)


def clustered(n, rng):
    """Fingerprints with many within two bits, in chains, and hot blocks."""
    out = []
    for _ in range(n):
        f = rng.getrandbits(64)
        for _ in range(rng.randint(1, 6)):
            out.append(f)
            for _ in range(rng.randint(1, 3)):
                f ^= 1 << rng.randrange(64)
    base = rng.getrandbits(64)
    return out + [base ^ rng.getrandbits(10) for _ in range(150)] + [base ^ rng.getrandbits(9) << 40 for _ in range(80)]


@pytest.mark.parametrize("radius", [1, 2, 3])
def test_links_connect_what_all_pairs_connect(spark, radius):
    rng = random.Random(7)
    values = sorted(set(clustered(60, rng)))
    fps = spark.createDataFrame([(int(np.uint64(v).astype(np.int64)),) for v in values], "fp long")
    rows = [(i, v) for i, v in enumerate(values)]
    want = {v: c for (_, v), (_, c) in zip(rows, plain_groups(rows, lambda a, b: (a ^ b).bit_count() <= radius), strict=True)}
    for split in (512, 4):  # with and without hot shards
        groups = {r["node"]: r["component"] for r in S.components(S.near_links(fps, radius, split_above=split)).collect()}
        got = {}
        for v in values:
            s = int(np.uint64(v).astype(np.int64))
            got.setdefault(groups.get(s, s), set()).add(v)
        other = {}
        for v in values:
            other.setdefault(want[v], set()).add(v)
        assert sorted(map(sorted, got.values())) == sorted(map(sorted, other.values()))


def test_groups_on_documents_match_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r["doc_id"], plain_fingerprint(r["text"])) for r in docs.collect()]
    want = dict(plain_groups(rows, lambda a, b: (a ^ b).bit_count() <= 2))
    got = {r["doc_id"]: r["component_id"] for r in S.simhash_groups(docs).collect()}
    assert got == want


def test_edge_rows(spark):
    docs = edge_docs(spark)
    rows = [(r["doc_id"], plain_fingerprint(r["text"])) for r in docs.collect()]
    want = sorted(plain_groups(rows, lambda a, b: (a ^ b).bit_count() <= 2), key=str)
    assert sorted(((r["doc_id"], r["component_id"]) for r in S.simhash_groups(docs).collect()), key=str) == want
    assert S.simhash_groups(no_docs(spark)).count() == 0
    assert S.similar_groups(docs).count() == docs.count()
    assert S.similar_groups(no_docs(spark)).count() == 0


def test_similar_groups_catch_near_copies_and_leave_others(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(4000)]
    rows, copies = [], {}
    for d in range(120):
        text = [rng.choice(words) for _ in range(rng.randint(60, 500))]
        rows.append((d * 10, " ".join(text)))
        if d % 3 == 0:  # up to one edit in fifty words: a similarity of 0.8 or more for five-word shingles
            near = list(text)
            for _ in range(max(1, len(text) // 60)):
                near[rng.randrange(len(near))] = "changed"
            rows.append((d * 10 + 1, " ".join(near)))
            copies[d * 10 + 1] = d * 10
    license_line = " ".join(f"license{i}" for i in range(30))
    rows = [(i, f"{t} {license_line}" if i % 2 == 0 and i not in copies.values() else t) for i, t in rows]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for split in (512, 3):
        got = {r["doc_id"]: r["component_id"] for r in S.similar_groups(df, split_above=split).collect()}
        caught = sum(got[c] == o for c, o in copies.items())
        assert caught >= 0.9 * len(copies)
        assert all(got[i] == i for i, _ in rows if i not in copies)


def test_blocks_of_a_large_shard_are_bounded_and_miss_no_two(spark):
    hot = spark.createDataFrame([(7, 3000, i * 2**40 + i) for i in range(3000)], "shard long, n long, node long")
    pairs = {}
    for r in S.block_pairs(hot, "shard", F.ceil(F.col("n") * 2 / 400)).collect():
        pairs.setdefault((r["first"], r["second"]), set()).add(r["node"])
    assert max(map(len, pairs.values())) <= 600
    met = {}
    for fps in pairs.values():
        for f in fps:
            met.setdefault(f, set()).update(fps)
    assert all(len(m) == 3000 for m in met.values())


def jaccard(a, b):
    a, b = (set(h for c in S.shingle_hashes(t.encode(), 5) for h in c.tolist()) for t in (a, b))
    return len(a & b) / max(len(a | b), 1)


def test_links_are_exact(spark):
    """Short documents around one passage stay apart; a family whose members are near some of it only is one group."""
    rng = random.Random(2)
    passage = " ".join(f"p{i}" for i in range(50))
    texts = [f"{passage} " + " ".join(f"w{rng.randrange(10**6)}" for _ in range(20)) for _ in range(300)]
    base = [f"b{i}" for i in range(400)]
    for _ in range(60):
        near = list(base)
        for _ in range(rng.randint(4, 10)):
            near[rng.randrange(400)] = f"e{rng.randrange(10**6)}"
        texts.append(" ".join(near))
    rows = list(enumerate(texts))
    want = dict(plain_groups(rows, lambda a, b: jaccard(a, b) >= 0.8))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for split in (4096, 16):
        got = {r["doc_id"]: r["component_id"] for r in S.similar_groups(df, split_above=split).collect()}
        assert got == want


def test_recall_in_each_class_of_length(spark):
    """Pairs whose index is 0.8 or a little more, at every length, beside a passage that all of them hold: none is missed, and no
    other pair is joined."""
    rng, rows, want = random.Random(5), [], {}
    for length in (5, 6, 8, 12, 20, 40, 80, 128, 132, 160, 200, 400, 1500, 20000):
        passage = [f"p{i}" for i in range(min(30, length // 3))]
        pairs = 6 if length > 2000 else 40
        for _ in range(pairs):
            base = passage + [f"w{rng.randrange(10**9)}" for _ in range(length - len(passage))]
            kind = rng.randrange(3)
            near = list(base)
            if kind == 0:  # words are added: 0.8 exactly, if the count allows it
                near += [f"a{rng.randrange(10**9)}" for _ in range(max(1, (length - 4) // 4))]
            elif kind == 1:  # the end is another one
                change = max(1, round((length - 4) / 9))
                near[-change:] = [f"e{rng.randrange(10**9)}" for _ in range(change)]
            else:  # scattered changes
                for _ in range(max(1, length // 60)):
                    near[rng.randrange(len(passage), length)] = f"c{rng.randrange(10**9)}"
            a, b = len(rows), len(rows) + 1
            rows += [(a, " ".join(base)), (b, " ".join(near))]
            want |= {a: a, b: a if jaccard(rows[a][1], rows[b][1]) >= 0.8 else b}
    assert sum(want[i] != i for i in want) > 300
    got = {r["doc_id"]: r["component_id"] for r in S.similar_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


def test_groups_do_not_depend_on_the_size_of_blocks(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r["doc_id"], r["text"] or "") for r in docs.collect()]
    want = dict(plain_groups(rows, lambda a, b: jaccard(a, b) >= 0.8))
    for split in (1024, 2, 7):
        assert {r["doc_id"]: r["component_id"] for r in S.similar_groups(docs, split_above=split).collect()} == want


def test_dense_family_is_linked_exactly(spark):
    """A family with indices on both sides of the limit: its single-link groups, whatever the blocks."""
    rng = random.Random(6)
    base = [f"b{i}" for i in range(150)]
    texts = []
    for _ in range(160):
        near = list(base)
        for _ in range(rng.randint(1, 9)):
            near[rng.randrange(150)] = f"e{rng.randrange(10**6)}"
        texts.append(" ".join(near))
    rows = list(enumerate(texts))
    want = dict(plain_groups(rows, lambda a, b: jaccard(a, b) >= 0.8))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for split in (1024, 20):
        assert {r["doc_id"]: r["component_id"] for r in S.similar_groups(df, split_above=split).collect()} == want
    assert 1 < len(set(want.values())) < len(rows)
