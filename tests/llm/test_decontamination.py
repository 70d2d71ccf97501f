import re

import pytest

from outlyer.llm import decontamination as D


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame(
        [
            (1, "Maria has 12 apples and gives 5 apples to her friend Tom in the park today"),
            (2, "A train runs 300 km in 4 hours, so how far does it run in 10 hours at that speed"),
            (3, "the quick brown fox jumps over the lazy dog while seven small cats look on from the wall"),
            (4, "too xshort"), (5, None), (6, ""),
        ],
        "item_id long, text string",
    )


D_WORD = re.compile(r"[^\W\d]+|\d+")


def found(docs, benchmark):
    return {r.doc_id: (r.contaminated, r["items"]) for r in D.judge(docs, benchmark).collect() if r.doc_id is not None}


def test_planted(make, benchmark):
    texts = [
        "some words first. the quick brown fox jumps over the lazy dog while seven small cats look on from the wall and more",
        "THE QUICK BROWN FOX JUMPS OVER THE LAZY DOG WHILE SEVEN SMALL CATS LOOK ON FROM THE WALL",
        "intro text here, a train runs 450 miles in 6 days, so how far does it run in 9 days at that speed",
        "intro text here, a train runs 450 miles in 6 days, so how far does it run in 9 weeks at that speed",
        "the quick brown fox jumps over a fence and then it sleeps all day in the sun with the lazy dog",
        "clean text that has nothing to do with any of it at all, and is long enough to be seen",
        None,
    ]
    got = found(make(texts), benchmark)
    assert got[0] == (True, [3]) and got[1] == (True, [3])
    assert got[2] == (True, [2])
    assert got[3] == (False, []), "the item's hours stand for days and for weeks"
    assert got[4] == got[5] == got[6] == (False, [])


def test_tokens_stay_in_step(make):
    texts = ["It cost 3.50 dollars, said John Smith. 5kg or 12:30, x_1 Ünal", "a1b2 3km4 É É", None, ""]
    from pyspark.sql import functions as F

    from outlyer.llm.common import text_of

    for names in (True, False):
        rows = make(texts).select(F.size(D.raw_tokens(text_of())).alias("a"), D.template_tokens(text_of(), names).alias("t")).collect()
        assert all(r.a == len(r.t) for r in rows)
        name = (lambda w: "nameslot") if names else str.lower
        assert rows[0].t == [name("It"), "cost", "numberslot", "unitslot", "said", name("John"), name("Smith"), "numberslot", "unitslot", "or", "numberslot", "x_", "numberslot", name("Ünal")]


def test_case_names_and_slots(make, benchmark, spark):
    item = "Maria has 12 apples and gives 5 apples to her friend Tom in the park today"
    texts = [
        item.lower(), item.upper(), item.replace("Maria", "Alice").replace("Tom", "Bob").replace("12", "7").replace("5", "3"),
        item.replace("12", "7").replace("5", "7"), "First words here. " + item.replace("Tom", "Eve") + " Last words.",
    ]
    got = found(make(texts), benchmark)
    assert [got[k][0] for k in range(5)] == [True, True, True, False, True]
    leading = spark.createDataFrame([(1, "Alice has 3 apples. Alice gives 2 of them to Bob, and then Bob eats one")], "item_id long, text string")
    got = found(make(["well then. Carol has 8 apples. Carol gives 4 of them to Dave, and then Dave eats one", "Carol has 8 apples. Alice gives 4 of them to Dave, and then Eve eats one"]), leading)
    assert got == {0: (True, [1]), 1: (False, [])}


def test_short_items(make, spark):
    items = spark.createDataFrame([(1, "What is 3"), (2, "alpha beta gamma delta"), (3, "?!")], "item_id long, text string")
    got = found(make(["so, what is 3 then", "what is 4", "Alpha, beta: gamma delta", "alpha beta delta gamma", "?!"]), items)
    assert [got[k][1] for k in range(5)] == [[1], [], [2], [], []]


def test_tables_of_numbers(make, spark, monkeypatch):
    """A table of numbers costs no more rows than an item has windows and places near its own."""
    import random

    rng = random.Random(1)
    numbers = [str(rng.randrange(10)) for _ in range(3000)]
    items = spark.createDataFrame([(1, " ".join(numbers[500:800])), (2, " ".join(str(rng.randrange(10)) for _ in range(300)))], "item_id long, text string")
    sizes = {}
    plain = D.scratch
    monkeypatch.setattr(D, "scratch", lambda df, tag, *rest: sizes.__setitem__(tag, (out := plain(df, tag, *rest)).count()) or out)
    assert found(make([" ".join(numbers), "7 " * 3000]), items) == {0: (True, [1]), 1: (False, [])}
    assert sizes["hits"] < 10_000


def brute(text, item):
    """Containment over all alignments, for a text that holds the item in one piece, words changed but none moved."""
    words = lambda t: D_WORD.findall(t.lower())
    x, y = words(text), words(item)
    grams = {tuple(x[i : i + 5]) for i in range(len(x) - 4)}
    return sum(tuple(y[i : i + 5]) in grams for i in range(len(y) - 4)) / max(1, len(y) - 4)


def test_random_items(make, spark):
    """Items word for word, with a word changed, or cut: found just where enough of their windows are left."""
    import random

    rng = random.Random(2)
    word = lambda: f"{rng.choice('bcdfg')}{rng.choice('aeiou')}{rng.choice('klmnp')}{rng.choice('aeiou')}{rng.choice('rst')}"
    items = [" ".join(word() for _ in range(rng.randrange(5, 60))) for _ in range(40)]
    texts, want = [], []
    for k, item in enumerate(items):
        w = item.split()
        for _ in range(rng.randrange(0, 3)):
            w[rng.randrange(len(w))] = word() + "x"
        w = w[: rng.randrange(len(w) * 3 // 4, len(w) + 1)]
        texts.append(" ".join([word() for _ in range(rng.randrange(0, 30))] + [rng.choice((str.upper, str.lower))(x) for x in w] + [word() for _ in range(10)]))
        want.append([k] if brute(texts[-1], item) >= D.CONTAINMENT else [])
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = found(make(texts), bench)
    assert [got[k][1] for k in range(len(texts))] == want and sum(map(bool, want)) > 8


def test_odd_rows(odd, empty, benchmark, make):
    assert not any(c for c, _ in found(odd, benchmark).values())
    assert D.judge(odd, benchmark).count() == odd.count()
    assert D.judge(empty, benchmark).count() == 0
    assert not any(c for c, _ in found(make(["some text"]), benchmark.limit(0)).values())
    bad = make(["the quick brown fox jumps over the lazy dog while seven small cats look on from the wall", "ok"])
    out = D.clean(bad, benchmark)
    assert [r.doc_id for r in out.collect()] == [1] and sorted(out.columns) == sorted(bad.columns)


def test_exact_items_of_the_tables(spark):
    sf = "/root/testdata/sf0.01"
    docs, bench = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    items = [(r.item_id, r.text) for r in bench.collect()]
    want = {(r.doc_id, i) for r in docs.collect() for i, q in items if q.lower() in (r.text or "").lower()}
    got = {(r.doc, r.item) for r in D.leaks(docs, bench).collect()}
    assert want <= got and len(got) <= len(want) + 3


def test_a_copy_beside_bad_variants(make, benchmark):
    """One steady copy is enough, wherever it stands among texts that only look alike."""
    import random

    rng = random.Random(4)
    good = lambda: f"a train runs {rng.randrange(100, 900)} km in {rng.randrange(2, 9)} hours, so how far does it run in {rng.randrange(11, 40)} hours at that speed"
    bad = lambda: "a train runs 450 miles in 6 days, so how far does it run in 9 weeks at that speed"
    filler = lambda: " ".join(rng.choice(["so", "then", "well", "green", "hill"]) for _ in range(rng.randrange(0, 25)))
    plans = [["bad", "good", "bad"], ["bad", "bad"], ["good", "bad"], ["bad"] * 5 + ["good"] + ["bad"] * 5, ["bad"] * 8] + [[rng.choice(["good", "bad", "bad"]) for _ in range(rng.randrange(1, 5))] for _ in range(25)]
    texts = [f" {filler()} . ".join((good if p == "good" else bad)() for p in plan) for plan in plans]
    got = found(make(texts), benchmark)
    assert [got[k][1] for k in range(len(plans))] == [[2] if "good" in plan else [] for plan in plans]
