import random
import re
from contextlib import contextmanager

import numpy as np
import pytest

from rastrel.llm import ngram_join as J
from rastrel.llm._components import components

LOW = {i: i + 32 for i in range(65, 91)}


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows):
    sets = [shingles(r[1]) for r in rows]
    comp = list(range(len(rows)))

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                comp[root(i)] = root(j)
    group = {}
    for i, r in enumerate(rows):
        group.setdefault(root(i), []).append(r[0])
    least = {k: min((x for x in v if x is not None), default=None) for k, v in group.items()}
    return sorted(((r[0], len(sets[i]), least[root(i)]) for i, r in enumerate(rows)), key=str)


@pytest.mark.parametrize("part", [512, 4])
def test_matches_brute_force(spark, docs, corpus, part):
    got = J.classes(spark, docs, block_bytes=6000, part=part)
    assert sorted(map(tuple, got.collect()), key=str) == brute(corpus)


def test_empty(spark, empty):
    assert J.classes(spark, empty).collect() == []


@pytest.mark.parametrize("seed", range(8))
def test_search_against_all_pairs(seed):
    rng = random.Random(seed)
    base = rng.sample(range(10_000), 60)
    sets = []
    for _ in range(120):
        s = set(base[: rng.choice([60, 40])])
        for _ in range(rng.randint(0, 20)):
            s.discard(rng.choice(base))
            s.add(rng.randrange(10_000))
        sets.append(np.array(sorted(s), np.uint64))
    lists = J.Lists(sets, np.arange(len(sets)))
    for s in sets[::7]:
        want = [i for i, x in enumerate(sets) if 100 * len(np.intersect1d(s, x)) >= 75 * len(np.union1d(s, x))]
        assert sorted(lists.search(s, 75, np.ones(len(sets), bool)).tolist()) == want


def test_components(spark):
    rng = random.Random(3)
    e = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 440)]
    got = {r.node: r.label for r in components(spark.createDataFrame(e, "a long, b long")).collect()}
    lab = {x: x for p in e for x in p}
    for _ in range(500):
        for a, b in e:
            lab[a] = lab[b] = min(lab[a], lab[b])
    assert got == {k: v for k, v in lab.items() if any(k in p and p[0] != p[1] for p in e)}


def test_large_class_without_links_and_with_few(spark):
    """A chain of texts that share a few rare words each: one candidate class, of which only some pairs link."""
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(8))
    texts = [[word() for _ in range(30)] for _ in range(240)]
    for a, b in zip(texts, texts[1:], strict=False):
        b[:6] = a[-6:]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    rows += [(1000 + i, " ".join([*texts[i], word()])) for i in range(0, 240, 17)]  # these link with their originals
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows)
    assert sorted(map(tuple, J.classes(spark, df, block_bytes=5000, part=8).collect()), key=str) == want
    kept = {r.doc_id for r in J.representatives(spark, df, block_bytes=5000, part=8).collect()}
    assert kept == {c for _, _, c in want}


def test_main_groups_are_found_in_levels(spark):
    """Near copies in more parts than one task takes."""
    rng = random.Random(2)
    base = [f"w{i}" for i in range(80)]
    rows = []
    for i in range(200):
        w = list(base)
        for _ in range(rng.randint(0, 2)):
            w[rng.randrange(80)] = f"x{rng.randrange(9)}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, J.classes(spark, df, block_bytes=3000, part=4).collect()), key=str) == brute(rows)


def test_representatives(spark, docs, corpus, empty):
    got = J.representatives(spark, docs, carry=("lang", "block", "shard"), block_bytes=6000)
    assert got.columns == ["doc_id", "text", "lang", "block", "shard"]
    kept = [(r.doc_id, r.text) for r in got.collect()]
    groups = {}
    sets = [shingles(r[1]) for r in corpus]
    comp = list(range(len(corpus)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                comp = [comp[j] if c == comp[i] else c for c in comp]
    for i, r in enumerate(corpus):
        groups.setdefault(comp[i], []).append(r)
    assert len(kept) == len(groups)
    assert sorted(str(k[0]) for k in kept) == sorted(str(min((r[0] for r in g if r[0] is not None), default=None)) for g in groups.values())
    assert J.representatives(spark, empty).collect() == []


def test_a_task_writes_one_file_of_prefixes(spark, docs, corpus, monkeypatch):
    # the executor's JVM starts three processes (chmod) for each task that writes and each further file of it
    made, bucketed = [], J.B.bucketed

    @contextmanager
    def counted(spark, df, name, key, n):
        with bucketed(spark, df, name, key, n) as (found, plain):
            made.append((len(plain.inputFiles()), n))
            yield found, plain

    monkeypatch.setattr(J.B, "bucketed", counted)
    old = {k: spark.conf.get(k, None) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        for k, v in zip(old, ("7", "false"), strict=True):
            spark.conf.set(k, v)
        got = J.classes(spark, docs, block_bytes=1000).collect()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    files, n = made[0]
    assert n > 8 and files <= n
    assert sorted(map(tuple, got), key=str) == brute(corpus)
