"""Exact dedup, SimHash components, mixing and URL rules against brute force on small tables."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from fleetspan.llm.exact_dedup import exact_duplicates
from fleetspan.llm.mixing import OTHER, MixTargets, cell_rates, mixed_sample, mixing_decisions
from fleetspan.llm.simhash import covering_positions, fingerprint_links, simhash_components
from fleetspan.llm.url_filter import Rule, bloom_blocks, canonical_url, judge_urls, may_be_listed


def dedup_by_hand(rows):
    groups = defaultdict(list)
    for key, text in rows:
        groups[hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", text or "").encode()).hexdigest()].append(key)
    out = []
    for digest, keys in groups.items():
        known = [k for k in keys if k is not None]
        keep = min(known) if known else None
        stays = False
        for key in keys:
            kept = key == keep and not stays
            stays = stays or kept
            out.append((key, keep, len(keys), kept, digest))
    return Counter(out)


@pytest.mark.parametrize("tracked,share", [(1024, 1 / 256), (16, 0.5), (1024, 0.9)])
def test_exact_dedup_equals_brute_force(awkward, docs_from, tracked, share):
    hot = [(100 + i, "hot  text" if i % 3 == 0 else f"text {i // 2}") for i in range(300)]
    docs = awkward.unionAll(docs_from(hot))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert Counter(tuple(r) for r in exact_duplicates(docs, tracked=tracked, heavy_share=share).collect()) == dedup_by_hand(rows)


def test_exact_dedup_of_nothing(docs_from):
    assert exact_duplicates(docs_from([])).count() == 0


def fingerprint_by_hand(text, width=4):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components_by_hand(rows, distance=4):
    fps = [fingerprint_by_hand(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= distance:
                root[find(i)] = find(j)
    least = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            least[find(i)] = min(key, least.get(find(i), key))
    return Counter((key, f"{fps[i]:016x}", least.get(find(i))) for i, (key, _) in enumerate(rows))


@pytest.mark.parametrize("block", [1024, 3])
def test_simhash_equals_brute_force(sample, awkward, block):
    docs = sample.select("doc_id", "text").unionAll(awkward.select("doc_id", "text"))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert Counter(tuple(r) for r in simhash_components(docs, block=block).collect()) == components_by_hand(rows)


def test_simhash_of_nothing(docs_from):
    assert simhash_components(docs_from([])).count() == 0


def test_positions_cover_every_choice_of_shared_bytes():
    from itertools import combinations

    for distance in (1, 2, 3, 4, 5):
        sets = covering_positions(distance)
        assert all(any(set(s) <= set(shared) for s in sets) for shared in combinations(range(8), 8 - distance))


def test_links_connect_all_near_fingerprints(spark):
    rng = random.Random(3)
    fps = {rng.getrandbits(64) for _ in range(60)}
    for base in list(fps)[:20]:
        for _ in range(8):
            one = base
            for b in rng.sample(range(64), rng.randint(1, 5)):
                one ^= 1 << b
            fps.add(one)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    edges = {(r.a, r.b) for r in fingerprint_links(spark.createDataFrame([(f,) for f in signed], "fp long"), 4, block=4).collect()}
    near = {(min(a, b), max(a, b)) for a in signed for b in signed if a != b and bin((a ^ b) & ((1 << 64) - 1)).count("1") <= 4}
    assert edges <= near
    root = {f: f for f in signed}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        root[find(a)] = find(b)
    assert all(find(a) == find(b) for a, b in near)


TARGETS = MixTargets({"a": 0.5, "b": 0.5}, {"en": 0.7, "fr": 0.3}, {"code": 0.2, "prose": 0.8}, {"code": ("def ",)}, rounds=60)


def test_raking_meets_the_marginals(docs_from):
    rng = random.Random(1)
    rows = [
        (i, ("def f " if rng.random() < 0.4 else "plain ") + "w " * rng.randint(1, 9), rng.choice(["en", "en", "fr", None]), rng.choice("aaabz"))
        for i in range(600)
    ]
    cells = cell_rates(docs_from(rows), TARGETS).collect()
    total, tokens = sum(c.mix_weight for c in cells), sum(c.mix_tokens for c in cells)
    for level, shares in zip(("mix_source", "mix_lang", "mix_topic"), TARGETS.dimensions()):
        other = sum(c.mix_tokens for c in cells if c[level] == OTHER) / tokens
        for value, share in shares.items():
            got = sum(c.mix_weight for c in cells if c[level] == value) / total
            assert got == pytest.approx(share * (1 - other), abs=1e-3)
    assert max(c.mix_probability for c in cells) == pytest.approx(1.0)


def test_mixing_keeps_columns_and_awkward_rows(awkward, docs_from):
    decisions = mixing_decisions(awkward, TARGETS)
    assert decisions.count() == awkward.count()
    kept = mixed_sample(awkward, TARGETS)
    assert kept.columns == awkward.columns
    assert kept.count() == decisions.where("kept").count()
    assert mixing_decisions(docs_from([]), TARGETS).count() == 0
    assert mixed_sample(docs_from([]), TARGETS).count() == 0


def test_mixing_is_one_scan_without_windows(sample):
    """The plan of the decisions reads what one scan has written; raking is no chain of windows."""
    plan = mixing_decisions(sample, TARGETS)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("documents.parquet") == 0
    assert plan.count("Window") + plan.count("Sort ") <= 3


def test_rows_without_a_key_are_drawn_by_themselves(docs_from):
    kept = mixed_sample(docs_from([(None, f"text {k} " * (k % 5 + 1), "en", "a" if k % 4 else "b") for k in range(400)]), TARGETS).count()
    assert 0 < kept < 400


def test_targets_out_of_reach_leave_a_residual(docs_from):
    rows = [(k, "plain words", "en", "a") for k in range(50)] + [(100 + k, "def f", "fr", "b") for k in range(50)]
    assert cell_rates(docs_from(rows), TARGETS).agg(F.max("mix_residual")).first()[0] > 0.1
    rows = [(k, t, lang, s) for k, (t, lang, s) in enumerate((t, lang, s) for t in ("plain", "def f") for lang in ("en", "fr") for s in "ab")]
    assert cell_rates(docs_from(rows), TARGETS).agg(F.max("mix_residual")).first()[0] < 1e-6


def test_words_are_counted_without_arrays(docs_from):
    from fleetspan.llm.mixing import token_weight

    texts = ["", None, " ", "a", " a ", "a\tb\n\n c", "é\x0bß  日本\x0c", "\u00a0 x", "w " * 5000]
    docs = docs_from(list(enumerate(texts)))
    got = {r[0]: r[1] for r in docs.select("doc_id", token_weight("text")).collect()}
    assert got == {k: max(1, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for k, t in enumerate(texts)}


def test_native_operators_use_no_python(awkward):
    for frame in (exact_duplicates(awkward), mixing_decisions(awkward, TARGETS), mixed_sample(awkward, TARGETS)):
        plan = frame._jdf.queryExecution().toString()
        assert not re.search(r"Python|Arrow|MapInPandas|Cartesian|NestedLoop", plan)


RULES = [Rule("allow", "com", "/"), Rule("block", "example.com", "/en/"), Rule("allow", "www.example.com", "/en/")]


def test_url_rules_and_list(spark):
    urls = [
        "http://Example.COM/en/x", "http://www.example.com/en/x", "http://badexample.com/en/x", "http://a.net/p/?utm_source=q&b=2&a=1#f",
        "https://www.a.net/p?a=1&b=2", "http://a.net/p", "no scheme", None, "", "://", "http://com", "http://x://y/z",
    ]
    pages = spark.createDataFrame([(i, u, "h", "c") for i, u in enumerate(urls)] + [(0, urls[0], "h", "c")], "page_id long, url string, host string, canonical string")
    listed = spark.createDataFrame([("a.net/p?a=1&b=2",), ("a.net/p?a=1&b=2",), (None,)], "canonical string")
    got = {r.page_id: r for r in judge_urls(pages, listed, RULES).collect()}
    assert judge_urls(pages, listed, RULES).count() == pages.count()
    assert [got[i].rule for i in range(3)] == ["example.com/en/", "www.example.com/en/", "com/"]
    assert [got[i].verdict for i in range(12)] == ["block", "allow", "allow", "block", "block"] + ["allow"] * 7
    assert (got[6].host, got[6].path, got[7].host, got[10].host, got[10].path) == ("", "", "", "com", "")
    assert got[10].rule is None
    assert judge_urls(pages.limit(0), listed, RULES).count() == 0
    assert judge_urls(pages, listed.limit(0), RULES).where("listed").count() == 0


def test_other_spellings_of_a_reported_address_are_blocked(spark):
    from fleetspan.llm.queries import REPORTED_EVERY, listed_urls

    long = "x" * 300_000
    urls = {
        0: "http://a.net/p/?b=2&a=1", 1: "https://www.a.net/p?a=1&b=2&utm_source=m#top", 2: "http://a.net/p", 3: "http://b.net/p?a=1&b=2",
        4: f"http://a.net/{long}/", 5: f"http://a.net/{long}y", REPORTED_EVERY: f"https://WWW.a.net/{long}#top",
        2 * REPORTED_EVERY: None, 3 * REPORTED_EVERY: "no scheme", 6: "no scheme", 7: "", 8: "http://spam-farm.net/any", 4 * REPORTED_EVERY: "http:///p",
    }
    pages = spark.createDataFrame([*urls.items(), (None, "http://c.net/")], "page_id long, url string")
    got = {r.page_id: r for r in judge_urls(pages, listed_urls(pages), RULES).collect()}
    assert {k for k, r in got.items() if r.listed} == {0, 1, 4, 8, REPORTED_EVERY}
    assert {k for k, r in got.items() if r.verdict == "block"} == {0, 1, 4, 8, REPORTED_EVERY}
    assert len(got) == len(urls) + 1


def test_filter_passes_all_listed_and_few_others(spark):
    listed = spark.range(2000).selectExpr("concat('in', id) as canonical")
    blocks = 1 + 2000 * 16 // 512
    table = bloom_blocks(listed, "canonical", blocks)
    assert may_be_listed(listed, "canonical", table, blocks).count() == 2000
    assert may_be_listed(spark.range(5000).selectExpr("concat('out', id) as canonical"), "canonical", table, blocks).count() < 150


def test_canonical_urls_agree(spark):
    same = ["http://WWW.a.org/x/?b=1&a=2&ref=z", "https://a.org/x?a=2&b=1#top"]
    rows = spark.createDataFrame([(u,) for u in same], "url string").select(canonical_url(F.col("url")))
    assert len({r[0] for r in rows.collect()}) == 1
