"""Hot groups whose members are mostly no links: their rarest shingles say which pairs to read."""

import random

import pytest
from test_near_dedup import brute, edited

from outlyer.llm import near_dedup as N


def template(rng, n):
    """Texts of one base, most of them too far from it and from each other, with pairs of links among these."""
    base = [f"w{rng.randrange(500)}" for _ in range(120)]
    texts = [edited(rng, base, rng.choice([1, 2, 3])) for _ in range(n // 4)]
    for _ in range(n // 2):
        far = edited(rng, base, rng.choice([5, 6, 7, 8]))
        texts += [far, edited(rng, far.split(), 1)] if rng.random() < 0.3 else [far]
    return texts + [" ".join(base[:40] * 3)] * 2 + [" ".join(base[:40] * 3 + ["end"])]


@pytest.mark.parametrize("outright, placed", [(N.OUTRIGHT, N.OUTRIGHT_PLACED), (0, N.OUTRIGHT_PLACED), (0, 0)])
def test_hot_group_of_texts_that_are_no_links(make, monkeypatch, outright, placed):
    monkeypatch.setattr(N, "OUTRIGHT", outright)
    monkeypatch.setattr(N, "OUTRIGHT_PLACED", placed)
    texts = template(random.Random(11), 160)
    got = {r.doc_id: r.class_id for r in N.groups(make(texts)).collect()}
    assert got == brute(dict(enumerate(texts)))


def test_pairs_read_do_not_grow_with_the_square_of_a_group(make, monkeypatch):
    read, verify = [], N.verify

    def counted(pairs, texts):
        read.append(pairs.count())
        return verify(pairs, texts)

    monkeypatch.setattr(N, "verify", counted)
    texts = template(random.Random(12), 600)
    got = {r.doc_id: r.class_id for r in N.groups(make(texts)).collect()}
    assert got == brute(dict(enumerate(texts)))
    assert sum(read) < 25 * len(texts), read


def test_linked_texts_share_one_of_their_rarest_shingles(spark):
    texts = template(random.Random(13), 120)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc long, text string")
    kept = {}
    for r in N.by_rarest(docs.select("doc"), docs, 0.8).collect():
        kept.setdefault(r.doc, {})[r.key] = r.at, r["size"]
    own = [N.bag(N.word_hashes(t, N.WordHash())) for t in texts]
    met = 0
    for a in range(len(texts)):
        for b in range(a):
            if N.overlap(own[a], own[b]) >= 0.8:
                met += 1
                shared = kept[a].keys() & kept[b].keys()
                assert any(min(s - k for k, s in (kept[a][x], kept[b][x])) >= 0.8 / 1.8 * (kept[a][x][1] + kept[b][x][1]) - 1e-9 for x in shared)
    assert met > 40


def test_shingles_are_counted_without_a_row_each(spark, monkeypatch):
    texts = template(random.Random(14), 120)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc long, text string")
    plan = N.by_rarest(docs.select("doc"), docs, 0.8)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Generate" not in plan
    monkeypatch.setattr(N, "COUNTERS", 8)  # most shingles share a counter: another order, the same groups
    monkeypatch.setattr(N, "OUTRIGHT", 0)
    assert {r.doc_id: r.class_id for r in N.groups(docs.withColumnRenamed("doc", "doc_id")).collect()} == brute(dict(enumerate(texts)))


def test_tasks_hand_over_blocks_of_counters_however_large_a_group(spark):
    texts = template(random.Random(15), 600)
    words = N.WordHash()
    own = [N.levels(N.bag(N.word_hashes(t, words))) for t in texts]
    rows = spark.createDataFrame([(t.view("int64").tolist(),) for t in own], "t array<long>").repartition(3)
    for counters in (1 << 12, 1000):
        rows_out = N.counter_sums(rows, counters).collect()
        assert len(rows_out) <= N.COUNTER_BLOCKS
        got = {at: n for r in rows_out for at, n in zip(r.at, r.n, strict=True)}
        want = {}
        for t in own:
            for k, at in enumerate(N.counters_of(t, counters)):
                for a in at.tolist():
                    want[k * counters + a] = want.get(k * counters + a, 0) + 1
        assert got == want
        often = N.broadcast_counts(rows, counters).value
        assert all(often[at // counters][at % counters] == n for at, n in want.items()) and sum(map(int, map(sum, often))) == sum(want.values())


def test_links_are_followed_once_and_not_again_in_each_step(make, monkeypatch):
    followed, found, components, linked = [], [], N.components, N.linked

    def counted(links):
        followed.append(links.count())
        return components(links)

    def kept(*args):
        out = linked(*args)
        found.extend(f.count() for f in out[0])
        return out

    monkeypatch.setattr(N, "components", counted)
    monkeypatch.setattr(N, "linked", kept)
    texts = template(random.Random(12), 300)
    got = {r.doc_id: r.class_id for r in N.groups(make(texts)).collect()}
    assert got == brute(dict(enumerate(texts)))
    assert len(followed) > 1 and sum(followed) <= sum(found), (followed, found)


def test_hot_group_with_many_members_apart_is_not_dealt_by_differences(make, monkeypatch):
    """Texts near to a common one, and more that are changed in too many places for a link: the places of shingles tell them apart by numbers."""
    rng, base = random.Random(4), [f"w{k}" for k in range(200)]

    def changed(own, blocks):
        words = list(base)
        for k in rng.sample(range(6), blocks):
            words[33 * k + 4 + rng.randrange(25)] = f"x{own}y{k}"
        return " ".join(words)

    texts = [changed(k, 1) for k in range(300)] + [changed(k, 6) for k in range(300, 1600)]
    monkeypatch.setattr(N, "told_apart", None)
    monkeypatch.setattr(N, "OUTRIGHT", 0)
    got = {r.doc_id: r.class_id for r in N.groups(make(texts)).collect()}
    assert got == {k: 0 if k < 300 else k for k in range(1600)}


def test_members_of_a_bucket_meet_without_the_pairs_of_its_largest_component(spark):
    rng = random.Random(2)
    rows = [(key, doc, rng.choice([0] * size + list(range(1, 9))), None, 10, rng.choice([0, 1, 2])) for key, size in ((1, 30), (2, 4), (3, 0)) for doc in rng.sample(range(100), 40)]
    members = spark.createDataFrame(rows, "key long, doc long, label long, s double, size int, at int")
    found = N.inside(N.parted(members), 0.8)
    near = lambda x, y: 10 - max(x[5], y[5]) >= 0.8 / 1.8 * 20 - 1e-9
    want = {(min(x[1], y[1]), max(x[1], y[1])) for x in rows for y in rows if x[0] == y[0] and x[2] != y[2] and near(x, y)}
    pairs = [(min(r.a, r.b), max(r.a, r.b)) for r in found.collect()]
    assert set(pairs) == want
    # each once in each bucket, and no pair of the largest component is looked at
    assert len(pairs) == sum(x[0] == y[0] and x[1] < y[1] and x[2] != y[2] and near(x, y) for x in rows for y in rows)
