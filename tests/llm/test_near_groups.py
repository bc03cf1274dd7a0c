"""Large families of near copies: what the second pass walks, compares and links."""

from itertools import combinations

import numpy as np

from memloom.llm import components, minhash, scratch


def family(n, changed):
    """n texts of one base, each with so many words of its own, and their shingle sets."""
    base = [f"w{k}" for k in range(300)]
    out = []
    for i in range(n):
        at = np.random.default_rng(i).choice(300, changed, replace=False)
        out.append([f"x{i}y{k}" if k in at else w for k, w in enumerate(base)])
    return out


def shingles(x):
    return {tuple(x[j : j + 5]) for j in range(len(x) - 4)}


def groups(sets):
    """Smallest index that links of at least 85 % reach from each."""
    forest = components.Forest()
    for a, b in combinations(range(len(sets)), 2):
        if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
            forest.join(a, b)
    return [forest.find(i) for i in range(len(sets))]


def recorded(spark, monkeypatch, texts):
    """Result and (name, rows, has nodes) of each written table, in order."""
    written, save = [], scratch.save

    def saving(df, name):
        out = save(df, name)
        written.append((name, out.count(), "node" in out.columns))
        return out

    monkeypatch.setattr(scratch, "save", saving)
    rows = [(i, " ".join(x)) for i, x in enumerate(texts)]
    got = {r.doc_id: r.component_id for r in minhash.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    return [got[i] for i in range(len(texts))], written


def test_linked_family_walks_once(spark, monkeypatch):
    """The nodes of a family that the first pass has linked have no rows in the second."""
    monkeypatch.setattr(minhash, "NODE", 32)
    texts = family(300, 2)
    got, written = recorded(spark, monkeypatch, texts)
    assert got == groups([shingles(x) for x in texts]) == [0] * 300
    after = [x[0] for x in written].index("links")
    assert sum(rows for _, rows, nodes in written[after:] if nodes) == 0


def test_second_pass_links_across_components_alone(spark, monkeypatch):
    """Copies that are near a linked family but below the threshold make no links, and the family's own are not made again."""
    monkeypatch.setattr(minhash, "NODE", 64)
    texts = [*family(240, 2), *family(300, 8)[240:]]
    sets = [shingles(x) for x in texts]
    want = groups(sets)
    assert want[:240] == [0] * 240 and want[240:] == list(range(240, 300))
    assert min(len(sets[0] & s) / len(sets[0] | s) for s in sets[240:]) > 0.65
    got, written = recorded(spark, monkeypatch, texts)
    assert got == want
    assert [rows for name, rows, _ in written if name == "more-links"] == [0]


def test_links_of_sets():
    """The links of each group join the same components as all pairs do, and are links themselves."""
    rng = np.random.default_rng(1)
    for n in (1, 2, 5, 30, 60):
        base = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
        sets = [np.unique(np.concatenate([rng.permutation(base)[: rng.integers(40, 61)], rng.integers(0, 1 << 63, rng.integers(0, 6), dtype=np.uint64)])) for _ in range(n)]
        comp = rng.integers(0, n, n)
        near = lambda s, t: 100 * len(np.intersect1d(s, t)) >= 85 * len(np.union1d(s, t))
        want, got = components.Forest(), components.Forest()
        for a, b in combinations(range(n), 2):
            if comp[a] != comp[b] and near(sets[a], sets[b]):
                want.join(int(comp[a]), int(comp[b]))
        for a, b in minhash._links(sets, comp, 85, 100):
            assert got.join(a, b) and any(near(s, t) for s, p in zip(sets, comp) for t, q in zip(sets, comp) if (p, q) == (a, b))
        assert [got.find(x) for x in range(n)] == [want.find(x) for x in range(n)]


def test_few_links_need_no_rounds(spark, monkeypatch):
    """A small table of links is joined in one more step, with the result of the rounds."""
    rng = np.random.default_rng(2)
    links = spark.createDataFrame([(int(a), int(b)) for a, b in rng.integers(0, 900, (600, 2))] + [(i, i + 1) for i in range(1000, 1300)] + [(None, 3)], "u long, v long").repartition(7)
    want = sorted(map(tuple, components.components(links).collect()))
    names, save = [], scratch.save
    monkeypatch.setattr(scratch, "save", lambda df, name: names.append(name) or save(df, name))
    assert sorted(map(tuple, components.components(links, at_once=10_000).collect())) == want
    assert names == ["links", "small"]
    assert sorted(map(tuple, components.components(links, at_once=10).collect())) == want
