"""Collocations, repeated passages and hard negatives against brute force on small tables."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetspan.llm import collocations as phrases
from fleetspan.llm import substring_dedup as passages
from fleetspan.llm.bitmaps import bitmap_of, passes
from fleetspan.llm.collocations import HatTrie, Words, collocations
from fleetspan.llm.hard_negatives import Goal, Tree, _packed_tree, best_first, best_of_block, hard_negatives, packed_trees, scaled_rows
from fleetspan.llm.substring_dedup import super_kmers, without_repeated_passages

# --- bitmap ------------------------------------------------------------------


def test_bitmap_passes_all_keys_and_few_others(spark):
    rng = np.random.default_rng(1)
    keys, others = (rng.integers(-(1 << 63), 1 << 63, 3000, dtype=np.int64) for _ in range(2))
    bits = np.frombuffer(bitmap_of(spark.createDataFrame([(int(k),) for k in keys], "k long"), "k", len(keys)), np.uint8)
    assert passes(bits, keys.view(np.uint64)).all()
    assert passes(bits, others.view(np.uint64)).mean() < 0.05
    empty = np.frombuffer(bitmap_of(spark.createDataFrame([], "k long"), "k", 0), np.uint8)
    assert not passes(empty, keys.view(np.uint64)).any()


# --- collocations ------------------------------------------------------------


def phrases_by_hand(rows, at_least, top):
    f, n = Counter(), Counter()
    for _, text, lang in rows:
        lang = lang or "und"
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            f.update((lang, tuple(words[i : i + k])) for k in range(1, 6) for i in range(len(words) - k + 1))
    candidates = {(lang, p): c for (lang, p), c in f.items() if len(p) >= 2 and c >= at_least}
    inside = {
        (lang, p[i:j]): True
        for (lang, p), c in candidates.items() for i in range(len(p)) for j in range(i + 2, len(p) + 1)
        if j - i < len(p) and (lang, p[i:j]) in candidates and c >= candidates[lang, p[i:j]]
    }
    out = defaultdict(list)
    for (lang, p), a in candidates.items():
        if (lang, p) not in inside:
            score, _, left, right = min((1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p)))
            out[lang].append((-score, -a, " ".join(p).encode(), left, right))
    rows = set()
    for lang, found in out.items():
        for rank, (score, a, p, left, right) in enumerate(sorted(found)[:top], 1):
            rows.add((lang, rank, p.decode(), -a, left, right, n[lang], -score))
    return rows


@pytest.fixture(scope="module")
def wordy():
    rng = random.Random(2)
    words = ["the", "The", "old", "cat", "sat", "émile", "日本", "on", "mat", "x-y", "\x1f", "rare"]
    rows = [(k, " ".join(rng.choices(words, weights=range(12, 0, -1), k=rng.randint(0, 40))) + rng.choice([".", "\n", " ; a,b", "", "\t\tend"]), rng.choice(["en", "en", "fr", None])) for k in range(120)]
    rows += [(200 + k, "Once upon a time there was. " * 3, "en") for k in range(20)]  # repeated rows and passages
    rows += [(None, None, "en"), (1, "", None), (2, " \t ", "fr"), (3, "the old cat " * 4000, "fr"), (4, "no.end,of;pieces:at!all?" * 50, "en")]
    return rows


def test_collocations_equal_brute_force(docs_from, wordy):
    docs = docs_from([(*r, "s") for r in wordy])
    got = [tuple(r) for r in collocations(docs, at_least=6, top=25).collect()]
    assert len(got) == len(set(got)) > 40
    assert set(got) == phrases_by_hand(wordy, 6, 25)


def test_small_tries_chunks_and_memories_change_nothing(monkeypatch, wordy):
    """The tasks' functions alone, with every bound at its least."""
    import pandas as pd

    frame = pd.DataFrame([(lang or "und", text or "") for _, text, lang in wordy], columns=["lang", "text"])
    everything = [np.full(8192, 255, np.uint8)] * phrases.SIFTED

    def counted():
        out = Counter()
        for part in phrases._runs(iter([frame]), everything):
            for row in part.itertuples(index=False):
                for phrase, n in zip(row.phrases, row.counts):
                    out[row.lang, phrase] += n
        return out

    wanted = counted()
    hashes = Counter()
    for part in phrases._hash_runs(iter([frame]), 2, everything[:1]):
        hashes.update(dict(zip(part["hash"], part["n"])))
    assert sum(hashes.values()) == sum(n for (_, p), n in wanted.items() if p.count(" ") == 1)
    for name, value in (("CHUNK", 300), ("ENTRIES", 40), ("KNOWN_WORDS", 5), ("BURST", 3), ("HELD", 10), ("OUT_ROWS", 7)):
        monkeypatch.setattr(phrases, name, value)
    assert counted() == wanted
    again = Counter()
    for part in phrases._hash_runs(iter([frame]), 2, everything[:1]):
        for h, n in zip(part["hash"], part["n"]):
            again[h] += n
    assert again == hashes


def test_words_with_one_hash_are_told_apart(monkeypatch, wordy):
    import pandas as pd

    frame = pd.DataFrame([(lang or "und", text or "") for _, text, lang in wordy[:40]], columns=["lang", "text"])
    everything = [np.full(8192, 255, np.uint8)] * phrases.SIFTED
    count = lambda: sorted((r.lang, p, n) for part in phrases._runs(iter([frame]), everything) for r in part.itertuples(index=False) for p, n in zip(r.phrases, r.counts))
    wanted = count()
    make = Words.__init__

    def same_hashes(self, *args):
        make(self, *args)
        self.hashes = self.hashes % np.uint64(5)

    monkeypatch.setattr(Words, "__init__", same_hashes)
    assert count() == wanted


def test_trie_bursts_and_spills_whole_subtrees():
    trie, want, got = HatTrie(burst=4), Counter(), Counter()
    rng = random.Random(4)
    for _ in range(3000):
        key = b"".join(rng.choice([b"aaaa", b"bbbb", b"cccc", b"dddd"]) for _ in range(rng.randint(1, 5)))
        trie.add(key, 2)
        want[key] += 2
        if trie.entries > 200:
            before = trie.entries
            run = list(trie.spill(100))
            assert trie.entries <= 100 and len(run) == before - trie.entries
            heads = {k[:4] for k, _ in run}
            assert not heads & set(trie.root)  # nothing of a spilled subtree stays
            got.update(dict(run))
    last = list(trie.spill())
    assert [k for k, _ in last] == sorted(k for k, _ in last)
    for key, n in last:
        got[key] += n
    assert got == want


def test_collocations_of_nothing(docs_from):
    assert collocations(docs_from([])).count() == 0
    assert collocations(docs_from([(1, "a b c", "en", "s")])).count() == 0
    assert collocations(docs_from([(1, None, "en", "s"), (2, "", None, "s")]), at_least=1).count() == 0


# --- repeated passages -------------------------------------------------------


def passages_by_hand(rows, window):
    """One result per row; rows with the same key and text are one document."""
    docs = sorted({(key is None, key or 0, text or "") for key, text in rows})
    # Of one key, the texts are in the order of a hash that the caller avoids by giving keys one text.
    seen, removed = set(), {}
    for name in docs:
        words = re.findall(r"[^\x20\x09-\x0D]+", name[2])
        gone = set()
        for i in range(len(words) - window + 1):
            run = tuple(words[i : i + window])
            if run in seen:
                gone.update(range(i, i + window))
            seen.add(run)
        removed[name] = (len(words), len(gone), " ".join(w for i, w in enumerate(words) if i not in gone))
    return Counter((key, *removed[key is None, key or 0, text or ""]) for key, text in rows)


def copied_texts(window):
    rng = random.Random(6)
    word = lambda: f"w{rng.randint(0, 400)}"
    shared = [" ".join(word() for _ in range(window + extra)) for extra in (0, 1, 7, 30)]
    rows = []
    for k in range(90):
        parts = [" ".join(word() for _ in range(rng.randint(0, 30)))]
        if k % 3:
            parts += [rng.choice(shared), word()]
        if k % 7 == 0:
            parts += [rng.choice(shared), rng.choice(shared)]
        rows.append((k, "  \n".join(parts)))
    rows += [(500, rows[4][1]), (501, rows[4][1]), (501, rows[4][1])]  # copies, one row given twice
    rows += [(600, "a " * 200), (601, "a b " * 100), (602, "é日 " * (window + 3)), (603, None), (604, ""), (605, " \t"), (None, shared[3]), (None, shared[3])]
    return rows


@pytest.mark.parametrize("window,minimiser,bucket", [(20, 4, 40_000), (20, 4, 8), (5, 2, 3), (6, 6, 5), (3, 1, 40_000)])
def test_passages_equal_brute_force(docs_from, monkeypatch, window, minimiser, bucket):
    monkeypatch.setattr(passages, "BUCKET_WINDOWS", bucket)
    rows = copied_texts(window)
    got = without_repeated_passages(docs_from(rows), window, minimiser).collect()
    assert Counter(tuple(r) for r in got) == passages_by_hand(rows, window)


def test_long_texts_and_small_chunks(docs_from, monkeypatch):
    monkeypatch.setattr(passages, "CHUNK_WORDS", 50)
    monkeypatch.setattr(passages, "KNOWN_WORDS", 20)
    rng = random.Random(8)
    long = " ".join(f"v{rng.randint(0, 3000)}" for _ in range(9000))
    rows = [(2, long), (1, " ".join(long.split()[4000:4100])), (3, long + " tail")]
    got = without_repeated_passages(docs_from(rows)).collect()
    assert Counter(tuple(r) for r in got) == passages_by_hand(rows, 20)


def test_unlike_texts_with_one_key(docs_from):
    same = " ".join(f"w{k}" for k in range(30))
    got = {r.n_removed for r in without_repeated_passages(docs_from([(1, same), (1, same + " more")])).collect()}
    assert got == {0, 30}


def test_passages_of_nothing(docs_from):
    assert without_repeated_passages(docs_from([])).count() == 0


@pytest.mark.parametrize("window,minimiser", [(20, 4), (5, 2), (4, 4), (3, 1)])
def test_super_kmers_cover_every_window_once(window, minimiser):
    rng = np.random.default_rng(9)
    for values in (50, 3, 1):
        hashes = rng.integers(0, values, 400).astype(np.uint64)
        doc = np.repeat(np.arange(8), 50)
        first, sizes, value, places = super_kmers(hashes, doc, window, minimiser)
        windows = [i for a, n in zip(first, sizes) for i in range(a, a + n)]
        assert windows == [i for i in range(400 - window + 1) if doc[i] == doc[i + window - 1]]
        assert sizes.max() <= window - minimiser + 1
        # Equal windows have equal minimisers, and one that is met twice is counted twice.
        of, met = {}, Counter()
        for a, n, v, p in zip(first, sizes, value, places):
            met[v] += p
            for i in range(a, a + n):
                assert of.setdefault(tuple(hashes[i : i + window]), v) == v
        seen = Counter(tuple(hashes[i : i + window]) for i in windows)
        assert all(met[of[w]] > 1 for w, n in seen.items() if n > 1)


# --- hard negatives ----------------------------------------------------------


def negatives_by_hand(rows, k=5, m=10):
    known = {}
    for key, label, vector in rows:
        if key is None or label is None or vector is None or any(x is None or not np.isfinite(x) for x in vector):
            continue
        v = tuple(float(np.floor(256 * x)) for x in vector)
        known[key] = min(known.get(key, (str(label), v)), (str(label), v))
    out = set()
    dot = lambda a, b: int(sum(int(x) * int(y) for x, y in zip(a, b)))
    for anchor, (label, v) in known.items():
        if anchor % 100:
            continue
        ranked = sorted((-dot(v, w), key, other) for key, (other, w) in known.items() if key != anchor)
        for score, positive, _ in [r for r in ranked if r[2] == label][:k]:
            found = [r for r in ranked if r[2] != label and 30 * -score <= 100 * -r[0] <= 90 * -score][:m]
            out |= {(anchor, positive, rank, key, -score, -s) for rank, (s, key, _) in enumerate(found, 1)}
    return out


def vectors(seed, n, width, clustered=False):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(3, width)) * 0.4
    rows = []
    for key in range(n):
        label = int(rng.integers(0, 3))
        v = centres[label] * clustered + rng.normal(size=width) * 0.2
        rows.append((key, label, [float(x) for x in v]))
    rows += [(1000 + 100 * k, k % 3, [0.5] * width) for k in range(4)] + [(5000 + k, k % 2, [0.25] * width) for k in range(300)]  # one common vector
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, label int, embedding array<double>, rank string, tree int")


@pytest.mark.parametrize("clustered", [False, True])
def test_negatives_equal_brute_force(spark, clustered):
    rows = vectors(3, 600, 8, clustered)
    odd = [(7000, None, [0.1] * 8), (7100, 1, None), (None, 1, [0.1] * 8), (7200, 1, [0.1, None] * 4), (7300, 1, [float("nan")] * 8), (7400, 2, [float("inf")] * 8)]
    odd += [(7500, 1, []), (7600, 1, [0.9, 0.9]), (100, 0, [9.0] * 8), rows[200], rows[200]]
    rows += odd
    assert {tuple(r) for r in hard_negatives(frame(spark, rows)).collect()} == negatives_by_hand(rows)


def test_large_components_are_exact(spark):
    rng = np.random.default_rng(5)
    rows = [(k, k % 2, [float(x) for x in rng.integers(1, 1 << 40, 3) / 256.0 * 3]) for k in range(0, 400, 20)]
    with pytest.raises(Exception, match="does not fit a long"):
        hard_negatives(frame(spark, rows)).collect()
    rows = [(k, k % 2, [float(x) for x in rng.integers(1 << 26, 1 << 29, 3) / 256.0 + 0.001]) for k in range(50, 450, 25)]
    assert {tuple(r) for r in hard_negatives(frame(spark, rows)).collect()} == negatives_by_hand(rows)


def test_negatives_of_nothing(spark):
    for rows in ([], [(1, 1, [0.1])], [(100, 1, [0.1])], [(100, None, None)]):
        assert hard_negatives(frame(spark, rows)).count() == 0


def test_trees_hold_every_row_once_and_are_small(spark):
    rows = vectors(4, 700, 5)
    taken = scaled_rows(frame(spark, rows), "vec_id", F.col("label"), "embedding", 256)
    trees = packed_trees(taken, tree_rows=100).collect()
    ids = [k for t in trees for k in np.frombuffer(t.ids, np.int64).tolist()]
    assert sorted(ids) == sorted(r[0] for r in rows)
    assert max(len(t.ids) // 8 for t in trees) <= 100
    assert len({t.tree for t in trees}) == len(trees)


def test_best_first_prunes_boxes():
    rng = np.random.default_rng(7)
    data = np.floor(np.concatenate([rng.normal(size=(500, 4)) * 5 + c * 200 for c in (-1, 0, 1)]))
    row = _packed_tree(1, "a", list(range(len(data))), list(data))
    names = ("tree", "label", "width", "ids", "data", "starts", "low", "high")
    tree = Tree(type("Row", (), dict(zip(names, row)))(), 4)
    query = np.array([3.0, 1.0, 2.0, 1.0])
    scores = data @ query
    for low, high in ((-np.inf, np.inf), (-200, 300), (1e9, 2e9)):
        visited = []
        (found,) = best_first(tree, query, [Goal(low, high, 10)], True, visited=visited)
        wanted = sorted((-s, k) for k, s in enumerate(scores.tolist()) if low <= s <= high)[:10]
        assert found == [(int(-s), k) for s, k in wanted]
        assert len(visited) < len(tree.levels[0][2]) / 2


def test_a_block_finds_what_each_query_finds():
    """All queries at once against tree after tree, with floors: nothing of the best is lost, ties go to the smaller key."""
    rng = np.random.default_rng(11)
    names = ("tree", "label", "width", "ids", "data", "starts", "low", "high")
    keys = rng.permutation(2000)
    data = np.floor(rng.normal(size=(2000, 6)) * 4)
    data[::3] = data[0]  # many equal rows
    trees = [Tree(type("Row", (), dict(zip(names, _packed_tree(n, "a", keys[c].tolist(), list(data[c])))))(), 6) for n, c in enumerate(np.split(np.arange(2000), 4))]
    queries, ids = data[:40].copy(), keys[:40]
    low, high = np.stack([np.full(40, -np.inf), np.arange(40.0) - 20]), np.stack([np.full(40, np.inf), np.arange(40.0) + 15])
    floor, found, given = np.full(low.shape, -np.inf), {}, 0
    for tree in trees:
        for goal, query, key, score in best_of_block(tree, queries, low, high, floor, 7, leave_out=ids):
            given += len(query)
            for q, k, s in zip(query.tolist(), key.tolist(), score.tolist()):
                found.setdefault((goal, q), []).append((-s, k))
    for q in range(40):
        goals = [Goal(low[g, q], high[g, q], 7) for g in range(2)]
        each = [best_first(tree, queries[q], goals, True, leave_out=int(ids[q])) for tree in trees]
        for g in range(2):
            best = sorted((-s, k) for one in each for s, k in one[g])[:7]
            assert sorted(found.get((g, q), []))[:7] == best
    assert given < 40 * 2 * 7 * len(trees)
