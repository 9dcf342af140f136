import itertools
import random
from collections import defaultdict


from quillstone.llm import neardup

from .conftest import HARD


def corpus(seed=3):
    rng = random.Random(seed)
    words = [f"word{i}" for i in range(3000)]
    docs = []
    for _ in range(60):
        base = rng.choices(words, k=rng.randint(20, 200))
        for _ in range(rng.choice((1, 1, 2, 4))):
            own = [rng.choice(words) if rng.random() < rng.choice((0, 0.02, 0.06)) else w for w in base]
            docs.append(" ".join(own))
    return docs


def jaccard(a, b):
    runs = lambda t: {tuple(t.split()[i : i + 3]) for i in range(max(1, len(t.split()) - 2))}
    x, y = runs(a), runs(b)
    return len(x & y) / len(x | y)


def groups_of(spark, docs):
    return {r["doc_id"]: r["group_id"] for r in neardup.near_duplicates(spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")).collect()}


def test_recall_and_precision_against_brute_force(spark):
    """No pair below the threshold is linked: groups are exactly components of pairs at or above it, less what banding misses."""
    docs = corpus()
    got = groups_of(spark, docs)
    alike = {(i, j): jaccard(docs[i], docs[j]) for i, j in itertools.combinations(range(len(docs)), 2)}
    true = [p for p, s in alike.items() if s >= neardup.THRESHOLD]
    assert len(true) > 50 and sum(got[i] == got[j] for i, j in true) >= 0.9 * len(true)
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in true:
        root[find(j)] = find(i)
    assert not [(i, j) for i, j in alike if got[i] == got[j] and find(i) != find(j)]


def test_pairs_round_the_threshold(spark):
    """Pairs alike by 0.5 to 0.6 are found, pairs alike by 0.4 to 0.5 never linked."""
    rng = random.Random(11)
    docs, want = [], []
    for k in range(400):
        n = rng.randint(60, 240)
        own = rng.uniform(0.25, 0.42)  # of each side's words
        base = [f"b{k}x{i}" for i in range(n)]
        for side in "lr":
            docs.append(" ".join(base[: int(n * (1 - own))] + [f"{side}{k}x{i}" for i in range(n - int(n * (1 - own)))]))
        want.append(jaccard(docs[-2], docs[-1]))
    got = groups_of(spark, docs)
    near = [got[2 * k] == got[2 * k + 1] for k, s in enumerate(want) if 0.5 <= s <= 0.6]
    assert len(near) > 80 and sum(near) >= 0.9 * len(near)
    far = [k for k, s in enumerate(want) if 0.35 <= s < 0.5]
    assert len(far) > 80 and not [k for k in far if got[2 * k] == got[2 * k + 1]]


def licensed(n, seed=5):
    """Documents that share a passage of 60 words and have 80 of their own; every tenth has a near copy."""
    rng = random.Random(seed)
    passage = [f"licence{i}" for i in range(60)]
    docs = []
    while len(docs) < n:
        own = [f"w{rng.randrange(200_000)}" for _ in range(80)]
        docs.append(" ".join(own[:40] + passage + own[40:]))
        if len(docs) % 10 == 0:
            own[3] = "changed"
            docs.append(" ".join(own[:40] + passage + own[40:]))
    return docs


def test_a_passage_that_all_share(spark, monkeypatch):
    """Pairs compared grow with the documents, not with their square, and near copies inside the large buckets are found."""
    made, real = [], neardup._estimated

    def counted(pairs, *rest):
        made.append(pairs.count())
        return real(pairs, *rest)

    monkeypatch.setattr(neardup, "_estimated", counted)
    for n in (500, 2000):
        docs = licensed(n)
        got = groups_of(spark, docs)
        copies = [i for i in range(1, len(docs)) if docs[i].split()[:3] == docs[i - 1].split()[:3]]
        assert len(copies) > n // 12 and sum(got[i] == got[i - 1] for i in copies) >= 0.98 * len(copies)
        assert len(set(got.values())) >= len(docs) - len(copies)
    assert len(made) == 6 and sum(made[3:]) <= 5 * sum(made[:3])


def test_rare_items_lose_no_pair(spark):
    """The prefix filter against all pairs, over sets of many sizes that share frequent items."""
    from quillstone.cluster import Scratch

    rng = random.Random(2)
    all_sets = []
    for k in range(250):
        common = rng.sample(range(40), rng.randint(0, 40))
        own = [1000 * (k // 2 if rng.random() < 0.5 else k) + i for i in range(rng.randint(1, 25))]
        all_sets.append(sorted(set(common + own)))
    held = spark.createDataFrame(list(enumerate(all_sets)), "node long, set array<long>")
    ends = spark.createDataFrame([(k, k, len(s)) for k, s in enumerate(all_sets)], "node long, root long, n int")
    for t in (0.5, 0.7):
        scratch = Scratch(spark)
        got = {(r["a"], r["b"]) for r in neardup.rare_pairs(ends, held, t, scratch).collect()}
        scratch.close()
        like = lambda x, y: len(set(x) & set(y)) / len(set(x) | set(y))
        want = {(i, j) for i, j in itertools.combinations(range(len(all_sets)), 2) if like(all_sets[i], all_sets[j]) >= t}
        assert len(want) > 20 and want <= got


def test_signatures_estimate_jaccard():
    a, b = " ".join(f"a{i}" for i in range(400)), " ".join(f"a{i}" for i in range(100, 500))
    h, t = neardup.shingles([a, b])
    x, y = neardup.signatures(h, t, 2)
    assert abs((x == y).mean() - jaccard(a, b)) < 0.12
    one = neardup.signatures(*[v for v in neardup.shingles([a])], 1)
    assert (one[0] == x).all()  # whatever shares its batch


def test_components_of_a_long_chain(spark):
    n = 300
    ids = list(range(n))
    random.Random(1).shuffle(ids)
    edges = spark.createDataFrame([(ids[i], ids[i + 1]) for i in range(n - 1)] + [(1000, 1001), (7, 7)], "a long, b long")
    groups = defaultdict(set)
    for r in neardup.components(edges).collect():
        groups[r["root"]].add(r["node"])
    assert {k: len(v | {k}) for k, v in groups.items()} == {0: n, 1000: 2}


def test_hard_rows(hard, none):
    rows = neardup.near_duplicates(hard).collect()
    assert len(rows) == len(HARD)
    assert sorted((r["doc_id"], r["group_id"], r["group_size"]) for r in rows if r["doc_id"] in (7, 8)) == [(7, 7, 3), (7, 7, 3), (8, 7, 3)]
    assert sum(r["kept"] for r in rows if r["group_id"] == 7) == 1
    assert {r["doc_id"]: (r["kept"], r["links"]) for r in rows if r["doc_id"] in (2, 3, 5)} == {2: (True, 0), 3: (True, 0), 5: (True, 0)}
    assert {r["links"] for r in rows if r["group_id"] == 7} == {2}
    kept = neardup.deduplicated(hard)
    assert kept.columns == hard.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(k) for k in [1, 2, 3, None, 5, 6, 7, 9, 10, 11, 12])
    assert neardup.near_duplicates(none).count() == 0 and neardup.deduplicated(none).count() == 0


def test_deduplicated_keeps_what_near_duplicates_keeps(spark):
    df = spark.createDataFrame(list(enumerate(corpus(8))), "doc_id long, text string")
    a = {r["doc_id"] for r in neardup.near_duplicates(df).where("kept").collect()}
    assert {r["doc_id"] for r in neardup.deduplicated(df).collect()} == a


def test_empty_batch():
    h, t = neardup.shingles(["", "\n"])
    assert len(h) == 0 and neardup.signatures(h, t, 2).shape == (2, neardup.PLACES)
