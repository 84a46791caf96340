import random
import re

import numpy as np
import pytest

from tessera.llm import jaccard
from tests.llm.helpers import AWKWARD, documents, table


def brute(rows, n=3, percent=90):
    sets = []
    for _, text in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        w = re.findall("[^\x20\x09-\x0d]+", low)
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} or ({tuple(w)} if w else set()))
    root = {i: i for i, _ in rows if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    index = {}
    for k, s in enumerate(sets):
        for x in s:
            index.setdefault(x, []).append(k)
    for a, s in enumerate(sets):
        for b in {k for x in s for k in index[x] if k > a}:
            t = sets[b]
            i, j = rows[a][0], rows[b][0]
            if i is not None and j is not None and 100 * len(s & t) >= percent * len(s | t):
                i, j = find(i), find(j)
                root[max(i, j)] = min(i, j)
    return sorted(((i if i is not None else -1), len(s), (-1 if i is None else find(i) if s else i)) for (i, _), s in zip(rows, sets, strict=True))


def run(df):
    return sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_shingles"], -1 if r["component_id"] is None else r["component_id"]) for r in jaccard.join(df).collect())


def near_copies(count, words, edits, seed):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(400)}" for _ in range(words)]
    out = []
    for _ in range(count):
        w = list(base)
        for _ in range(rng.randrange(edits + 1)):
            w[rng.randrange(words)] = f"e{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("small,side", [(32, 512), (2, 3)])
def test_against_brute_force(spark, monkeypatch, small, side):
    monkeypatch.setattr(jaccard, "SMALL", small)
    monkeypatch.setattr(jaccard, "SIDE", side)
    texts = near_copies(60, 120, 5, 1) + near_copies(4, 30, 1, 2) + ["A b C", "a B c", "a b", "A B", "one", "x y z x y z x y z"]
    rows = AWKWARD + [(100 + i, t) for i, t in enumerate(texts)] + [(100, texts[0])]
    assert run(table(spark, rows)) == brute(rows)


def test_copies_that_share_many_buckets_are_sent_once(spark, monkeypatch):
    """Sixty near copies share dozens of large buckets: each set goes to one task, not to one for each bucket."""
    sent, plain = [], jaccard._block_links
    monkeypatch.setattr(jaccard, "_block_links", lambda rows, percent: (sent.append(rows.select("rep").collect()), plain(rows, percent))[1])
    rows = list(enumerate(near_copies(60, 400, 4, 5)))
    assert run(table(spark, rows)) == brute(rows)
    assert len(sent[0]) == len({r["rep"] for r in sent[0]}) > 40


@pytest.mark.parametrize("chain", [range(0, 40, 8), range(40)])
def test_buckets_become_one_if_that_sends_less(spark, monkeypatch, chain):
    """Buckets of twelve members, linked in a chain: far apart they stay, close together each member is sent for each block of one bucket."""
    monkeypatch.setattr(jaccard, "SIDE", 12)
    rows = [(10_000 + first, m, m * 1000 + 7, 12) for first in chain for m in range(first, first + 12)]
    got = jaccard._merged(spark.createDataFrame(rows, "token long, rep long, key long, n long")).collect()
    apart, members = len(rows), len({r[1] for r in rows})
    together = members * -(-members // 12)
    assert sum(r["blocks"] for r in got) == min(apart, together)
    assert {r["rep"] for r in got} == {r[1] for r in rows}


def test_chance_meetings_send_no_sets(spark, monkeypatch):
    """Texts that share one rare shingle and nothing else, far more of them than a small bucket has: none is sent whole, and links among them are found."""
    monkeypatch.setattr(jaccard, "HEAVY", 0)  # as if the table of frequent shingles were full of others
    sent, plain = [], jaccard._block_links
    monkeypatch.setattr(jaccard, "_block_links", lambda rows, percent: (sent.append(rows.select("rep").collect()), plain(rows, percent))[1])
    rng = random.Random(7)
    common = min((f"p{i} q r" for i in range(3000)), key=lambda t: int(jaccard.shingles(t, 3)[0]))  # the first of nearly every prefix
    texts = [f"{' '.join(f'w{rng.randrange(10**9)}' for _ in range(rng.randrange(60, 400)))} {common}" for _ in range(120)]
    texts += [f"{texts[3]} more", f"{texts[50]} and more"]
    rows = list(enumerate(texts))
    assert run(table(spark, rows)) == brute(rows)
    assert len(sent[0]) == 0


def test_fitting_groups_every_pair():
    rng = np.random.default_rng(3)
    parts = rng.integers(0, 6, (90, 64)).astype(np.int16)
    parts[60:] = parts[:30] + (rng.random((30, 64)) < 0.15)
    sizes = parts.sum(axis=1).astype(np.int64)
    order = np.argsort(sizes, kind="stable")
    sizes, parts = sizes[order], parts[order]
    near = lambda i, j: i != j and 90 * max(sizes[i], sizes[j]) <= 100 * min(sizes[i], sizes[j]) and 190 * abs(parts[i] - parts[j]).sum() <= 10 * (sizes[i] + sizes[j])
    expected = list(range(90))
    for _ in range(90):
        expected = [min([expected[i], *(expected[j] for j in range(90) if near(i, j))]) for i in range(90)]
    assert 20 < len(set(expected)) < 90
    for step in (4, 7, 256):
        assert jaccard.fitting(sizes, parts, 90, step).tolist() == expected


def test_whole_table_against_brute_force(spark):
    rows = [(r["doc_id"], r["text"]) for r in documents(spark).collect()]
    assert run(documents(spark)) == brute(rows)


def test_empty_table(spark):
    assert jaccard.join(table(spark, [])).count() == 0


def test_prefix_choice():
    assert jaccard.prefix_length(100, 90) == 11
    import numpy as np

    assert jaccard.choose(np.ones(20), 11, 4) == 4
    assert jaccard.choose(np.array([1.0] * 11 + [1000.0] * 3), 11, 4) == 1
