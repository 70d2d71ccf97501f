import hashlib
import re

from outlyer.llm import exact_dedup

WS = re.compile("[\x20\x09-\x0d]+")


def brute(rows):
    norm = [(i, WS.sub(" ", t or "")) for i, t in rows]
    groups = {}
    for i, t in norm:
        groups.setdefault(t, []).append(i)
    return sorted((str(i), str(min((x for x in groups[t] if x is not None), default=None)), len(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for i, t in norm)


def check(df, threshold=exact_dedup.BROADCAST_KEYS):
    got = exact_dedup.classes(df, broadcast_keys=threshold).collect()
    assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.text_sha256) for r in got) == brute([(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()])
    kept = {}
    for r in got:
        kept[r.text_sha256] = kept.get(r.text_sha256, 0) + r.kept
    assert set(kept.values()) <= {1}
    return got


def test_against_brute_force(make):
    texts = [f"text {k % 7}" + " " * (k % 3) + "end" for k in range(60)] + ["hot  copy"] * 30 + ["hot\tcopy"] * 10
    check(make(texts))
    check(make(texts), threshold=0)


def test_odd_rows(odd, empty):
    check(odd)
    assert check(empty) == []


def test_deduplicate_keeps_columns(make):
    df = make(["a  b", "a b", "c"])
    out = exact_dedup.deduplicate(df)
    assert sorted(out.columns) == sorted(df.columns) and {r.doc_id for r in out.collect()} == {0, 2}


def test_deduplicate_rows_that_share_an_id(make):
    df = make([(1, "a b"), (1, "a b"), (2, "c"), (3, "zz"), (3, "c"), (None, "c"), (None, "n"), (None, "n"), (9, None), (8, "")])
    out = sorted((str(r.doc_id), r.text or "") for r in exact_dedup.deduplicate(df).collect())
    assert out == [("1", "a b"), ("2", "c"), ("3", "zz"), ("8", ""), ("None", "n")]
