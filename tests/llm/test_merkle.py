import hashlib
import random
import zlib
from collections import defaultdict

import duckdb
import pytest

from lattica.llm import merkle as M
from lattica.llm import queries as Q

from . import cases


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def part(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree(leaves, arity=3):
    levels = [leaves]
    while len(levels[-1]) > 1:
        low = levels[-1]
        levels.append([digest(*low[i : i + arity]) for i in range(0, len(low), arity)])
    return levels


def siblings(levels, i, arity=3):
    out = []
    for low in levels[:-1]:
        at = i // arity * arity
        out.append((low[at:i], low[i + 1 : at + arity]))
        i //= arity
    return out


def folded(seen, way):
    for a, b in way:
        seen = digest(*a, seen, *b)
    return seen


def plain(rows, arity=3):
    """rows: group, key, leaf, seen -> the manifest, as sorted rows."""
    groups = defaultdict(list)
    for g, k, leaf, seen in rows:
        groups[g].append((k is not None, k or 0, leaf, seen))
    trees = {g: tree([x[2] for x in sorted(v)], arity) for g, v in groups.items()}
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    top = tree([trees[g][-1][0] for g in names], arity)
    out = []
    for place, g in enumerate(names):
        for i, (known, k, leaf, seen) in enumerate(sorted(groups[g])):
            way = siblings(trees[g], i, arity) + siblings(top, place, arity)
            out.append((str(k if known else None), str(g), leaf, i, trees[g][-1][0], top[-1][0], digest(*(x for a, b in way for x in a + b)), folded(seen, way)))
    return sorted(out)


def made(spark, rows, **more):
    df = spark.createDataFrame(rows, "source string, doc_id long, leaf string, seen string")
    got = M.manifest(df, "source", "doc_id", "leaf", "seen", **more)
    return sorted((str(r["key"]), str(r["group"]), r["leaf"], r["rank"], r["subroot"], r["root"], r["proof"], r["folded"]) for r in got.collect())


@pytest.mark.parametrize("arity,deep", [(3, 4), (3, 1), (2, 3)])
def test_trees_of_every_size(spark, arity, deep):
    rng = random.Random(arity * 10 + deep)
    sizes = {None: 5, "": 1, "a": 1, "b": 2, "c": 3, "d": 4, "e": 9, "f": 10, "g": 27, "h": 28, "ä": 81, "z": 82, "🙂": 130, "hot": 300}
    rows = [(g, rng.randrange(10**6), digest(str(g), str(i)), digest("other", str(i)) if i % 3 else digest(str(g), str(i))) for g, n in sizes.items() for i in range(n)]
    rng.shuffle(rows)
    assert made(spark, rows, arity=arity, deep=deep) == plain(rows, arity)


def test_many_groups_make_a_deep_last_tree(spark):
    rows = [(f"s{i % 250:03d}", i, digest(str(i)), digest(str(i))) for i in range(700)]
    assert made(spark, rows) == plain(rows)


def test_one_row_and_none(spark):
    assert made(spark, [("a", 1, digest("x"), digest("x"))]) == [("1", "a", digest("x"), 0, digest("x"), digest("x"), digest(), digest("x"))]
    assert M.manifest(spark.createDataFrame([], "source string, doc_id long, leaf string, seen string"), "source", "doc_id", "leaf", "seen").count() == 0


def test_ties(spark):
    rows = [("a", 7, digest("x"), digest("x"))] * 5 + [("a", 7, digest("y"), digest("z")), ("a", None, digest("y"), digest("y"))]
    assert made(spark, rows) == plain(rows)


def test_field(spark):
    got = spark.createDataFrame([(None, 12), ("", None), ("é", -3)], "a string, b int").select(M.field(M.F.col("a")), M.field(M.F.col("b"))).collect()
    assert [tuple(r) for r in got] == [("-", "2:12"), ("0:", "-"), ("2:é", "2:-3")]


def expected(docs):
    rows = []
    for r in docs:
        of = lambda text, r=r: digest(*map(part, (r["doc_id"], r["source"], r["lang"], r["n_chars"], text)))
        cut = r["doc_id"] is not None and r["text"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 2 == 0
        rows.append((r["source"], r["doc_id"], of(r["text"]), of(r["text"].replace("\n", "") if cut else r["text"])))
    return sorted((k, leaf, sub, root, proof, fold, str(fold == root)) for k, _, leaf, _, sub, root, proof, fold in plain(rows))


def test_query(spark, sf):
    got = sorted(tuple(map(str, r)) for r in Q.op12_merkle(spark, sf).collect())
    assert got == expected(spark.read.parquet(f"{sf}/documents.parquet").collect())
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{sf}/documents.parquet'")
    assert got == sorted(tuple(map(str, r)) for r in con.execute(Q.SQL["op12_merkle"]).fetchall())
    assert {r[-1] for r in got} == {"True", "False"}


def test_edge_rows(spark, tmp_path):
    for df in (cases.edge_docs(spark), cases.no_docs(spark)):
        df.write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
        got = sorted(tuple(map(str, r)) for r in Q.op12_merkle(spark, str(tmp_path)).collect())
        assert got == expected(df.collect())
