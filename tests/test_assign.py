import random

import pytest

from lattica.operators import assign as A


def one_loop(links, lengths, iden, clips, cutoff, least, share):
    """The rules, read once over all links, with everything looked up anew at each of them."""
    same = lambda a, b: iden.get(frozenset((a, b)), 0)
    order = sorted(links, key=lambda x: (-x[2], x[0], x[1]))
    accepted, out = [], set()
    for m, g, n in order:
        if n < least:
            continue
        ties = {}
        for h in {x[1] for x in order}:
            counts = [x for x in order if x[1] == h and x[2] >= n]
            if counts:
                ties[h] = [x[0] for x in counts if x[2] == counts[0][2]]
        clash = {h for h, ms in ties.items() if len(ms) > 1 and min(same(a, b) for a in ms for b in ms if a != b) <= cutoff}
        shadow = {x for h in clash for b in ties[h] for x in lengths if x != b and same(x, b) >= cutoff}
        done = [x[0] for x in accepted]
        if done:
            s, near = max((same(m, d), d) for d in done)
            if lengths[near] - lengths[m] >= 200 and s >= 99 and min(clips[m, g]) >= 60:
                out.add(m)
        if m in shadow or g in clash or m in done or m in out:
            continue
        own = [x for x in accepted if x[1] == g]
        if not own or (min(same(m, x[0]) for x in own) >= cutoff and n * 100 / own[0][2] >= share):
            accepted.append((m, g, n))
        elif min(same(m, x[0]) for x in own) >= cutoff:
            out.add(m)
    return sorted(accepted)


@pytest.mark.parametrize("seed", range(4))
def test_rounds_give_what_one_loop_gives(spark, seed):
    rng = random.Random(seed)
    markers, genomes = [f"m{i:02d}" for i in range(30)], [f"g{i:02d}" for i in range(18)]
    lengths = {m: rng.choice([1200, 1350, 1500, 1700]) for m in markers}
    links = [(m, g, rng.randint(5, 14)) for m in markers for g in rng.sample(genomes, rng.randint(0, 3))]
    iden = {frozenset((a, b)): float(rng.choice([97, 98.5, 99, 99.5, 100])) for a in markers for b in markers if a < b and a[-1] == b[-1]}
    clips = {(m, g): (rng.choice([10.0, 80.0]), rng.choice([20.0, 90.0])) for m, g, _ in links}
    got = A.greedy_assign(
        spark.createDataFrame(links, "marker string, genome string, n long"), spark.createDataFrame(list(lengths.items()), "marker string, ref_len int"),
        spark.createDataFrame([(*sorted(k), v) for k, v in iden.items()], "a string, b string, iden double"),
        spark.createDataFrame([(*k, *v) for k, v in clips.items()], "marker string, genome string, clip_l double, clip_r double"),
        min_links=7,
    )
    assert sorted(tuple(r) for r in got.collect()) == one_loop(links, lengths, iden, clips, 99.0, 7, 80.0)


def test_simple_rule(spark):
    links = [("a", "g", 20), ("b", "g", 17), ("c", "g", 10), ("d", "g", 18), ("d", "h", 4), ("e", "h", 3), ("f", "h", 2)]
    iden = [("a", "b", 99.5), ("a", "c", 99.9), ("a", "d", 90.0), ("d", "e", 99.0)]
    got = A.greedy_assign_simple(spark.createDataFrame(links, "marker string, genome string, n long"), spark.createDataFrame(iden, "a string, b string, iden double"), min_unique=3)
    # c has half of the best count; d differs from a, and its second link is under the higher minimum for markers with several genomes
    assert sorted((r["marker"], r["genome"]) for r in got.collect()) == [("a", "g"), ("b", "g"), ("e", "h")]


def test_clusters_by_falling_size(spark):
    members = spark.createDataFrame([("a", 10), ("b", 9), ("c", 8), ("d", 7), ("e", 1)], "id string, size long")
    similar = spark.createDataFrame([("a", "b", 0.9), ("b", "c", 0.95), ("c", "d", 0.99), ("a", "d", 0.5)], "a string, b string, sim double")
    got = {r["id"]: r["centroid"] for r in A.similarity_cluster(members, similar, 0.8).collect()}
    assert got == {"a": "a", "b": "a", "c": "c", "d": "c", "e": "e"}


@pytest.mark.parametrize("seed", range(3))
def test_one_component_that_holds_everything(spark, seed):
    """A few markers link nearly all genomes, and many are short near-copies of them."""
    rng = random.Random(100 + seed)
    markers, genomes = [f"m{i:02d}" for i in range(40)], [f"g{i:02d}" for i in range(25)]
    lengths = {m: rng.choice([1200, 1300, 1500, 1700]) for m in markers}
    links = [(m, g, rng.randint(5, 40)) for m in markers for g in rng.sample(genomes, 20 if m < "m06" else rng.randint(1, 4))]
    iden = {frozenset((a, b)): float(rng.choice([98.5, 99, 99.5, 100])) for a in markers for b in markers if a < b and rng.random() < 0.4}
    clips = {(m, g): (rng.choice([10.0, 80.0, 90.0]), rng.choice([60.0, 90.0])) for m, g, _ in links}
    got = A.greedy_assign(
        spark.createDataFrame(links, "marker string, genome string, n long"), spark.createDataFrame(list(lengths.items()), "marker string, ref_len int"),
        spark.createDataFrame([(*sorted(k), v) for k, v in iden.items()], "a string, b string, iden double"),
        spark.createDataFrame([(*k, *v) for k, v in clips.items()], "marker string, genome string, clip_l double, clip_r double"),
        cutoff=98.5 if seed else 99.0, min_links=7,
    )
    assert sorted(tuple(r) for r in got.collect()) == one_loop(links, lengths, iden, clips, 98.5 if seed else 99.0, 7, 80.0)


def one_simple_loop(links, iden, cutoff, least, share, unique):
    done, best, out = set(), {}, []
    for m, g, n in sorted(links, key=lambda x: (-x[2], x[0], x[1])):
        several = len({x[1] for x in links if x[0] == m and x[2] > 1}) > 1
        if n < (least if several else unique) or m in done:
            continue
        if g in best:
            if iden.get(frozenset((m, best[g][0])), 0) < cutoff:
                continue
            done.add(m)
            if n * 100 / best[g][1] >= share:
                out.append((m, g, n))
        else:
            best[g] = (m, n)
            done.add(m)
            out.append((m, g, n))
    return sorted(out)


@pytest.mark.parametrize("seed", range(3))
def test_simple_rule_against_one_loop(spark, seed):
    rng = random.Random(seed)
    markers, genomes = [f"m{i:02d}" for i in range(40)], [f"g{i:02d}" for i in range(12)]
    links = [(m, g, rng.randint(1, 30)) for m in markers for g in rng.sample(genomes, rng.randint(0, 9))]
    iden = {frozenset((a, b)): float(rng.choice([97, 99, 99.5])) for a in markers for b in markers if a < b and rng.random() < 0.6}
    got = A.greedy_assign_simple(spark.createDataFrame(links, "marker string, genome string, n long"), spark.createDataFrame([(*sorted(k), v) for k, v in iden.items()], "a string, b string, iden double"))
    assert sorted(tuple(r) for r in got.collect()) == one_simple_loop(links, iden, 99.0, 9, 80.0, 3)


@pytest.mark.parametrize("seed", range(3))
def test_clusters_against_one_loop(spark, seed):
    rng = random.Random(seed)
    sizes = {f"s{i:02d}": rng.randint(1, 12) for i in range(60)}
    sims = {frozenset(rng.sample(sorted(sizes), 2)): rng.choice([0.5, 0.8, 0.9, 0.95]) for _ in range(140)}
    place, want = {}, {}
    for i in sorted(sizes, key=lambda i: (-sizes[i], i)):
        found = max(((sims[frozenset((i, c))], -place[c], c) for c in place if sims.get(frozenset((i, c)), 0) >= 0.8), default=None)
        if found is None:
            place[i] = len(place)
        want[i] = found[2] if found else i
    similar = spark.createDataFrame([(*sorted(k), v) for k, v in sims.items()], "a string, b string, sim double")
    got = A.similarity_cluster(spark.createDataFrame(list(sizes.items()), "id string, size long"), similar, 0.8)
    assert {r["id"]: r["centroid"] for r in got.collect()} == want and got.count() == len(want)


def test_nothing_to_assign(spark):
    links, ident = spark.createDataFrame([], "marker string, genome string, n long"), spark.createDataFrame([], "a string, b string, iden double")
    assert A.greedy_assign_simple(links, ident).count() == 0
    assert A.similarity_cluster(spark.createDataFrame([], "id string, size long"), spark.createDataFrame([], "a string, b string, sim double"), 0.5).count() == 0
