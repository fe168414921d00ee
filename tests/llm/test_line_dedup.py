import random

import pytest

from quillspark.llm import line_dedup as ld
from tests.llm.helpers import docs_of


def long(n, seed):
    rng = random.Random(seed)
    return " ".join("w%d" % rng.randint(0, 10**6) for _ in range(n))


def test_patience_is_a_common_subsequence():
    rng = random.Random(4)
    for _ in range(300):
        a, b = ([rng.randint(0, rng.choice([3, 30])) for _ in range(rng.randint(0, 25))] for _ in range(2))
        pairs = ld.patience(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:]))
        assert bool(pairs) == bool(set(a) & set(b))
    assert ld.patience([1, 2, 3, 4], [1, 9, 3, 4]) == [(0, 0), (2, 2), (3, 3)]


def plain_runs(a, b, words, min_words):
    """Lines of b in any common run of lines with min_words words, by trying all pairs of positions."""
    out = set()
    for i in range(len(a)):
        for j in range(len(b)):
            n = 0
            while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                n += 1
            if sum(words[j : j + n]) >= min_words:
                out |= set(range(j, j + n))
    return sorted(out)


def test_a_long_run_across_short_shared_lines():
    long_run = ["p1", "p2", "p3"]
    a = [*long_run, "h1", "x", "h2", "y", "h3"]
    b = ["h1", "u", "h2", "v", "h3", *long_run]
    words = [20 if x in long_run else 2 for x in b]
    assert ld.common_blocks(a, b, words, 20) == [5, 6, 7]
    assert ld.common_blocks(b, a, [20 if x in long_run else 2 for x in a], 20) == [0, 1, 2]


def test_all_common_runs_are_found():
    rng = random.Random(8)
    for _ in range(1500):
        kinds = rng.choice([3, 8, 30])
        weight = [rng.choice([0, 1, 2, 5, 12, 25]) for _ in range(kinds)]
        a, b = ([rng.randrange(kinds) for _ in range(rng.randint(0, 20))] for _ in range(2))
        for _ in range(rng.randint(0, 3)):  # planted runs
            at, n = rng.randint(0, len(a)), rng.randint(1, 6)
            to = rng.randint(0, len(b))
            b[to:to] = a[at : at + n]
        words = [weight[x] for x in b]
        assert ld.common_blocks(a, b, words, 20) == plain_runs(a, b, words, 20)


def plain(rows, min_words):
    """Every later document against every earlier one, over all pairs of distinct ids."""
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        words = [len(x.split()) for x in lines]
        gone = set()
        for k, other in rows:
            if k is not None and (i is None or k < i):
                gone |= set(ld.common_blocks([x.strip() for x in (other or "").split("\n")], [x.strip() for x in lines], words, min_words))
        out.append((str(i), t if not gone else "\n".join(x for n, x in enumerate(lines) if n not in gone), len(gone)))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", range(3))
def test_against_all_pairs(spark, seed):
    rng = random.Random(seed)
    passages = ["\n".join(long(rng.randint(3, 9), (seed, p, x).__hash__()) for x in range(rng.randint(4, 9))) for p in range(6)]
    rows = []
    for i in range(30):
        parts = [long(rng.randint(1, 8), (seed, i, n).__hash__()) for n in range(5)] + rng.sample(passages, rng.randint(0, 2))
        rng.shuffle(parts)
        rows.append((i, "\n".join(parts)))
    got = sorted(((str(r["doc_id"]), r["text"], r["removed_lines"]) for r in ld.dedupe_lines(docs_of(spark, rows), 20).collect()), key=str)
    assert got == plain(rows, 20)


def test_edges(spark):
    text = "\n".join([long(12, 1), "", long(12, 2) + " ", "tail"])
    rows = [(4, text), (4, text), (2, "own\n" + text.replace(" \n", "\n")), (9, None), (8, ""), (None, text), (7, "short line\nshort line"), (6, "short line\nshort line"), (11, long(25, 3)), (12, long(25, 3) + "\nmore")]
    got = {}
    for r in ld.dedupe_lines(docs_of(spark, rows)).collect():
        got.setdefault(r["doc_id"], []).append((r["text"], r["removed_lines"], r["earlier"]))
    assert got[2] == [("own\n" + text.replace(" \n", "\n"), 0, [])]
    assert got[4] == [("", 4, [2])] * 2 and got[None] == [("", 4, [2])]
    assert got[9] == [(None, 0, [])] and got[8] == [("", 0, [])]
    assert got[6] == got[7] == [("short line\nshort line", 0, [])]
    assert got[12] == [("more", 1, [11])]
    assert ld.dedupe_lines(docs_of(spark, [])).count() == 0
    clash = docs_of(spark, rows[:3]).selectExpr("*", "1 as removed_lines", "2 as gone", "3 as h")
    assert ld.dedupe_lines(clash).columns == ["doc_id", "text", "lang", "source", "n_chars", "gone", "h", "removed_lines", "earlier"]
