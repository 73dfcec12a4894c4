"""Archives with version lines inside payloads, chains of records, and the pipeline from end to end."""

import hashlib
from collections import Counter

import pytest

import corpus_pipeline
from fleetspan.llm.queries import QUERIES, TWINS
from fleetspan.llm.warc import read_warc, reachable, warc_round_trip, write_warc

INNER = "WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:77>\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
PAGES = [
    (1, "http://a", None), (2, "http://a", "x" * 120), (3, "b\r\nx", "x" * 120), (3, "b", "x" * 120), (None, None, "x" * 120),
    (4, "u", INNER), (5, "u", INNER + INNER + "WARC/1.1\r\n"), (6, "u", "WARC/1.1\r\n"), (7, "u", ""), (8, "u", "é\r\n\r\nWARC/1.1\r\n\r\n"),
    (8, "u", "é" * 70), (9, "u", "é" * 70), (10, "u", INNER * 40), (11, "u", INNER * 40), (12, "u", "y" * 300_000), (13, "u", "small"), (14, "u", "small"),
]


def pages_by_hand(rows):
    first = {}
    for key, _, html in rows:
        if key is not None:
            first[html or ""] = min(key, first.get(html or "", key))
    out = []
    for key, _, html in rows:
        body = (html or "").encode()
        least = first.get(html or "")
        again = len(body) >= 100 and (key is None or key > least)
        out.append((key, len(body), hashlib.sha256(body).hexdigest(), "revisit" if again else "response", least if again else None))
    return Counter(out)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "f", 1) for r in rows], "page_id long, url string, html string, file string, offset int")


def test_archives_round_trip(spark):
    assert Counter(tuple(r) for r in warc_round_trip(frame(spark, PAGES)).collect()) == pages_by_hand(PAGES)


def test_line_ends_in_addresses(spark):
    """What any reader takes for the end of a line, followed by what looks like a header."""
    signs = ["\r\n", "\n", "\r", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x85", "\u2028", "\u2029"]
    pages = [(k, f"http://a{sign}Content-Length: 5{sign}WARC-Type: x", "payload" * k) for k, sign in enumerate(signs)]
    assert Counter(tuple(r) for r in warc_round_trip(frame(spark, pages)).collect()) == pages_by_hand(pages)


@pytest.mark.parametrize("damage", ["cut", "length", "start"])
def test_damaged_archives_raise(spark, tmp_path, damage):
    write_warc(frame(spark, PAGES).coalesce(1), str(tmp_path / "w"))
    (part,) = (tmp_path / "w").glob("part-*")
    data = part.read_bytes()
    if damage == "cut":
        data = data[:-40]
    elif damage == "length":
        at = data.index(b"Content-Length: ", len(data) // 3)
        data = data[:at] + b"Content-Length: 9" + data[at + 17 :]
    else:
        data = data.replace(b"WARC-Type: ", b"WARC-Kind: ", 1)
    (tmp_path / "w" / f".{part.name}.crc").unlink(missing_ok=True)
    part.write_bytes(data)
    with pytest.raises(ValueError, match="damaged archive"):
        read_warc(spark, str(tmp_path / "w")).collect()


def test_no_pages(spark):
    assert warc_round_trip(frame(spark, [])).count() == 0


@pytest.mark.parametrize("split", ["64", "1000"])
def test_files_read_in_small_parts(spark, tmp_path, split):
    write_warc(frame(spark, PAGES).coalesce(1), str(tmp_path / "w"))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split if split == "1000" else "4096")
    try:
        assert Counter(tuple(r) for r in read_warc(spark, str(tmp_path / "w")).collect()) == pages_by_hand(PAGES)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_chain_from_the_start_only(spark):
    rows = [(1, 0, 10), (1, 10, 35), (1, 20, 30), (1, 30, 35), (1, 35, 50), (1, 36, 50), (1, 50, 60), (2, 5, 9), (2, 9, 12)]
    got = {tuple(r) for r in reachable(spark.createDataFrame(rows, "file long, offset long, next long")).select("file", "offset").collect()}
    assert got == {(1, 0), (1, 10), (1, 35), (1, 50)}


def test_every_operator_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert set(TWINS) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(TWINS))
def test_queries_equal_their_sql(spark, name):
    from checks.compare import connection, difference

    d = "/root/testdata/sf0.001"
    assert not difference(QUERIES[name](spark, d), connection(d).sql(TWINS[name]))


def test_pipeline_stages_keep_columns_and_take_effect(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    first, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written_table(stage(spark, docs, d))
        assert docs.columns == first, name
        counts.append(docs.count())
    assert counts == sorted(counts, reverse=True)
    assert counts[1] > 0.95 * counts[0]
    tokens = corpus_pipeline.STAGES[-1][1](spark, docs, d)
    assert tokens.count() == docs.count()


def test_stages_take_awkward_and_empty_tables(spark, awkward, docs_from):
    d = "/root/testdata/sf0.001"
    for docs in (awkward, docs_from([])):
        for _, stage in corpus_pipeline.STAGES:
            assert stage(spark, docs, d).count() <= docs.count()


def test_one_of_each_near_group_stays(spark, docs_from):
    long = " ".join(f"w{k}" for k in range(300))
    docs = docs_from([(3, long), (3, long), (5, long + " end"), (9, "another text of few words"), (None, long)])
    kept = corpus_pipeline.near_duplicate_stage(spark, docs, "").collect()
    assert Counter(r.doc_id for r in kept) == Counter([3, 9, None])


def test_unlike_texts_of_one_key_are_different_documents(spark, docs_from):
    one, two = (" ".join(f"{c}{k}" for k in range(300)) for c in "ab")
    docs = docs_from([(3, one), (3, two), (3, two), (4, two + " end"), (None, two)])
    kept = corpus_pipeline.near_duplicate_stage(spark, docs, "").collect()
    assert Counter((r.doc_id, r.text) for r in kept) == Counter([(3, one), (3, two), (None, two)])


def pipeline_by_hand(rows, items, predicted, marks):
    """Which keys stay, and where their ids are, from plain versions of the stages that can be told apart by key."""
    from test_pairs_and_groups import components_by_hand
    from test_texts import hits_by_hand, shards_by_hand

    rows = [(k, t) for k, t in rows if predicted[k] != "und"]
    stays = {k for k, _, c in components_by_hand(rows) if k == c}
    rows = [(k, t) for k, t in rows if k in stays]
    dirty = {k for k, _ in hits_by_hand(rows, items)}
    rows = [(k, t) for k, t in rows if k not in dirty and k in marks]
    return rows, shards_by_hand(rows)


def test_pipeline_equals_brute_force(spark, docs_from, tmp_path):
    import random

    from fleetspan.llm.language import fitted, language_column
    from fleetspan.llm.mixing import mixed_sample
    from fleetspan.llm.queries import MIX
    from pyspark.sql import functions as F

    rng = random.Random(12)
    english = "the cat and a dog went over old hills while rain fell on grey stone roofs in every town we saw".split()
    french = "le chat et un chien sont partis sur les collines quand la pluie tombait dans toutes les villes grises".split()
    items = [(1, " ".join(f"q{k}" for k in range(12))), (2, " ".join(rng.choices(english, k=15)))]
    rows = []
    for k in range(70):
        words = rng.choices(french if k % 3 == 0 else english, k=rng.randint(40, 90))
        if k % 11 == 5:
            words[20:20] = items[0][1].split()
        rows.append((k, " ".join(words), "fr" if k % 3 == 0 else "en", f"src{k % 4}"))
    rows += [(100 + k, rows[k][1] + " end", rows[k][2], "src1") for k in (1, 2, 3)] + [(200, "12 34", "en", "src0"), (201, None, "en", "src0")]
    docs = docs_from(rows)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}

    languages, model = fitted(docs)
    predicted = {r.doc_id: r.p.lang_pred for r in docs.select("doc_id", language_column(languages, model, "text").alias("p")).collect()}
    texts = [(r[0], r[1]) for r in rows]
    clean, _ = pipeline_by_hand(texts, items, predicted, {r[0] for r in rows})
    chosen = mixed_sample(docs.where(F.col("doc_id").isin([k for k, _ in clean])), MIX)
    _, wanted = pipeline_by_hand(texts, items, predicted, {r.doc_id for r in chosen.collect()})
    assert got == wanted and got and 5 not in got and 101 not in got and 200 not in got
