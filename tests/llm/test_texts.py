"""Token counts, token shards, personal data, language and decontamination against plain versions and round trips."""

import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer, models, pre_tokenizers

from fleetspan.llm.decontaminate import Decontamination, contaminated, edit_distances, without_benchmark, words_of
from fleetspan.llm.language import UNKNOWN, identify_language
from fleetspan.llm.pii import find_identifiers, luhn
from fleetspan.llm.queries import COUNT_VOCABULARY, ENCODER, END_ID
from fleetspan.llm.token_count import UnigramVocabulary, token_counts, unigram_from_pieces
from fleetspan.llm.token_shards import WaveletMatrix, count_token, encoded_documents, find_token, shard_documents, write_token_shards


def texts_of(*frames):
    return [(r.doc_id, r.text) for f in frames for r in f.select("doc_id", "text").collect()]


def test_token_counts_equal_the_unigram_model(spark, sample, awkward):
    vocabulary = unigram_from_pieces(public_tokenizers.path(COUNT_VOCABULARY))
    plain = Tokenizer(models.Unigram(list(vocabulary.pieces), unk_id=0, byte_fallback=True))
    plain.pre_tokenizer = pre_tokenizers.Metaspace()
    docs = sample.select("doc_id", "text").unionAll(awkward.select("doc_id", "text"))
    expected = Counter((key, len(plain.encode(text, add_special_tokens=False).ids) if text else 0) for key, text in texts_of(docs))
    assert Counter(tuple(r) for r in token_counts(docs, vocabulary).collect()) == expected
    assert token_counts(docs.limit(0), vocabulary).count() == 0


def test_ties_take_the_first_candidate(docs_from):
    pieces = (("u", 0.0), ("▁a", -1.0), ("b", -1.0), ("▁ab", -2.0), ("c", -1.0), ("bc", -2.0), ("▁", -3.0), ("a", -3.0))
    plain = Tokenizer(models.Unigram(list(pieces), unk_id=0, byte_fallback=True))
    plain.pre_tokenizer = pre_tokenizers.Metaspace()
    texts = ["ab", "abc", "abcb", "a b", "cba", "bcbc"]
    got = {r.doc_id: r.n_tokens for r in token_counts(docs_from(list(enumerate(texts))), UnigramVocabulary(pieces)).collect()}
    assert got == {i: len(plain.encode(t).ids) for i, t in enumerate(texts)}


def shards_by_hand(rows):
    plain = Tokenizer.from_file(public_tokenizers.path(ENCODER))
    out, start = {}, 0
    for key, text in sorted(rows):
        ids = plain.encode(text or "", add_special_tokens=False).ids + [END_ID]
        out[key] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    return out


def test_shards_hold_what_the_tokenizer_gives(sample, docs_from):
    extra = docs_from([(10**9, None), (10**9 + 1, ""), (10**9 + 2, "a\tb\n\n c  "), (10**9 + 3, "ß 日本 \u200b🙂 é"), (-5, "word " * 30_000)])
    docs = sample.select("doc_id", "text").unionAll(extra.select("doc_id", "text"))
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in encoded_documents(docs, public_tokenizers.path(ENCODER), END_ID).collect()}
    assert got == shards_by_hand(texts_of(docs))


def test_words_with_signs_equal_the_tokenizer():
    import random

    from fleetspan.llm.token_shards import UNUSUAL, encoder_for, is_unusual

    path, rng = public_tokenizers.path(ENCODER), random.Random(3)
    with open(path, encoding="utf-8") as file:
        words = encoder_for(file.read())
    plain = Tokenizer.from_file(path)
    signs = "abcXYZÉß'.,<|_ \t\n\x1c\x85\xa0²½01-’é日́ﬁ"
    texts = ["".join(rng.choices(signs, k=rng.randint(0, 14))) for _ in range(5000)] + ["it's", "word.", "word_", "word\x1c", "A<", "<|", "²", "é."]
    for text in texts:
        assert np.frombuffer(words.text(text), "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids, text
        assert is_unusual(text) == bool(UNUSUAL.search(text))


def test_shards_of_awkward_tables(awkward, docs_from):
    path = public_tokenizers.path(ENCODER)
    assert encoded_documents(awkward, path, END_ID).count() == awkward.count()
    assert encoded_documents(docs_from([]), path, END_ID).count() == 0


def test_search_in_shards(spark, sample, tmp_path):
    plain = Tokenizer.from_file(public_tokenizers.path(ENCODER))
    shards = write_token_shards(sample, public_tokenizers.path(ENCODER), str(tmp_path / "shards"), END_ID)
    ids = []
    for _, text in sorted(texts_of(sample)):
        ids += plain.encode(text or "", add_special_tokens=False).ids + [END_ID]
    ids = np.array(ids)
    for token in (END_ID, int(ids[17]), int(np.bincount(ids).argmax())):
        where = [r[0] for r in find_token(shards, token).select("start").collect()]
        assert sorted(where) == np.flatnonzero(ids == token).tolist()
        assert sum(r[-1] for r in count_token(shards, token).collect()) == (ids == token).sum()
    assert shard_documents(shards).count() == sample.count()


@pytest.mark.parametrize("size", [0, 1, 63, 64, 65, 1000, 5000])
def test_wavelet_matrix_equals_its_sequence(size):
    ids = np.random.default_rng(size).zipf(1.3, size).astype(np.int64) % 500
    matrix = WaveletMatrix.from_bytes(WaveletMatrix.build(ids.astype(np.uint16), 9).to_bytes())
    assert matrix.decode().tolist() == ids.tolist()
    for place in range(0, size, max(1, size // 20)):
        token = int(ids[place])
        assert matrix.access(place) == token
        assert matrix.rank(token, place) == int((ids[:place] == token).sum())
        assert matrix.select(token, int((ids[:place] == token).sum())) == place
    assert matrix.rank(501) == 0


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def base_by_hand(text):
    out = []
    for order, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            fits = {
                "email": True, "ip": all(int(p) <= 255 for p in m.group().split(".")) if kind == "ip" else True,
                "card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15,
            }[kind]
            if fits:
                out.append((m.start(), order, f"{kind}:{m.start()}:{m.end()}"))
    return ",".join(s for *_, s in sorted(out))


NASTY = [
    "1.2.3.4.5.6.7.8 300.1.1.1.1 1..2.3.4 01.002.3.255", "a@b.c@d.e x@y @z.q %@-.-", "4111 1111 1111 1111 4111-1111-1111-1112 4  1",
    "+1 (555) 123-4567 ++49.30.1234567 +1 2 +12345678901234567890", "a@b a@b.c. .@.a", "+4111111111111111", "ü@ü.de 1.2.3.4é",
]


def test_base_spans_equal_the_patterns(sample, awkward, docs_from):
    docs = sample.select("doc_id", "text").unionAll(awkward.select("doc_id", "text")).unionAll(docs_from(list(enumerate(NASTY))).select("doc_id", "text"))
    got = find_identifiers(docs).collect()
    assert Counter((r.doc_id, r.base_spans) for r in got) == Counter((k, base_by_hand(t)) for k, t in texts_of(docs))
    for r in got:
        assert set(filter(None, r.base_spans.split(","))) <= set(r.spans.split(","))
    assert find_identifiers(docs.limit(0)).count() == 0


@pytest.mark.parametrize("text", ["write to jane dot doe at example dot com today", "jane (at) example (dot) org", "jаne@exаmple.com"])
def test_disguised_mail_is_found_in_the_source(docs_from, text):
    (row,) = find_identifiers(docs_from([(1, text)])).collect()
    mails = [s.split(":") for s in row.spans.split(",") if s.startswith("email")]
    assert any(text[int(a) : int(b)].startswith(("jane", "jаne")) and text[int(a) : int(b)].endswith(("com", "org")) for _, a, b in mails)


def found_kinds(text):
    from fleetspan.llm.pii import base_spans, disguised_spans

    return {kind: [text[a:b] for a, b in spans] for kind, spans in disguised_spans(text, base_spans(text)).items()}


@pytest.mark.parametrize("text,kind,span", [
    ("call plus four nine three zero one two three four five six seven now", "phone", "plus four nine three zero one two three four five six seven"),
    ("call +４９ ３０ １２３４５６７８ now", "phone", "+４９ ３０ １２３４５６７８"),
    ("host one nine two dot one six eight dot one dot seven up", "ip", "one nine two dot one six eight dot one dot seven"),
    ("host １０.０.０.２５５ up", "ip", "１０.０.０.２５５"),
    ("card four one one one 1111 1111 one one one one now", "card", "four one one one 1111 1111 one one one one"),
    ("card 4111\u200b111111111111 now", "card", "4111\u200b111111111111"),
    ("mail bob [at] example [dot] com now", "email", "bob [at] example [dot] com"),
    ("mail bob { AT }  example\n( dot )\tcom now", "email", "bob { AT }  example\n( dot )\tcom"),
    ("mail bob dot lee at mail dot example dot com", "email", "bob dot lee at mail dot example dot com"),
    ("mail bob＠example.com now", "email", "bob＠example.com"),
    ("mail bob arroba example punto com", "email", "bob arroba example punto com"),
])
def test_every_disguise_is_found_with_its_span(text, kind, span):
    assert found_kinds(text).get(kind) == [span]


@pytest.mark.parametrize("text", [
    "look at the end. dot your i", "one two three", "he was one of ten at work", "we met at noon", "( at ) [dot]", "a dot a dot a", "..a at", "at dot at dot",
    "four one one one 1111 1111 one one one two is no card number", "one nine nine nine dot one dot one dot one",
])
def test_ordinary_words_are_no_identifiers(text):
    assert found_kinds(text) == {}


@pytest.mark.parametrize("text", [
    "a dot " * 170_000, "a at b " * 150_000, "x (at) y" + " " * 1_000_000, " " * 1_000_000 + "(dot)", "one " * 250_000, "+1 " * 330_000,
    "( " * 500_000, "joe at x dot com " * 60_000, "1" * 1_000_000, "a." * 500_000, "a@" * 500_000, "a@b." * 250_000, "1." * 500_000, "[at] " * 200_000,
], ids=lambda t: t[:9])
def test_time_is_linear_in_the_text(text):
    """Twice the text may take three times the time at most; a quadratic step takes four."""
    import time

    from fleetspan.llm.pii import base_spans, disguised_spans

    def seconds(t):
        start = time.process_time()
        disguised_spans(t, base_spans(t))
        return time.process_time() - start

    half = seconds(text[: len(text) // 2])
    assert seconds(text) < 3 * half + 0.5
    assert half < 15


@pytest.mark.parametrize("texts", [["axyzb", "éé", "a b", "xyz", "日本b", "bab"]])
@pytest.mark.parametrize("some_bytes", [(), (0x78, 0x79)])
def test_unknown_characters_without_byte_pieces(docs_from, texts, some_bytes):
    pieces = (("u", 0.0), ("▁a", -1.0), ("b", -1.0), ("▁", -2.0), *((f"<0x{b:02X}>", -9.0) for b in some_bytes))
    plain = Tokenizer(models.Unigram(list(pieces), unk_id=0, byte_fallback=True))
    plain.pre_tokenizer = pre_tokenizers.Metaspace()
    got = {r.doc_id: r.n_tokens for r in token_counts(docs_from(list(enumerate(texts))), UnigramVocabulary(pieces)).collect()}
    assert got == {i: len(plain.encode(t).ids) for i, t in enumerate(texts)}


def test_shards_of_another_tokenizer(sample):
    path = public_tokenizers.path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    start, wanted = 0, {}
    for key, text in sorted(texts_of(sample)):
        ids = plain.encode(text or "", add_special_tokens=False).ids + [END_ID]
        wanted[key] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in encoded_documents(sample, path, END_ID).collect()} == wanted


@pytest.mark.parametrize("words", [5, 10, 30, 50, 120])
def test_recall_on_fresh_pairs(words):
    from fleetspan.llm.decontaminate import Items, Walks, edited_pairs, repetitions_for

    settings = Decontamination()
    rows = np.random.default_rng(words).integers(1, 5000, (20, words)).astype(np.uint64)
    a, b = edited_pairs(rows, settings, 2500, seed=99)
    found = np.zeros(len(a), bool)
    for repetition in range(repetitions_for(rows, settings)):
        walk = Walks(repetition, words, settings)
        found |= walk.keys(a) == walk.keys(b)
    assert found.mean() >= settings.recall - 0.005
    assert repetitions_for(rows, Decontamination(repetitions=2)) is None
    exhaustive = Items([(k, [f"w{x}" for x in row]) for k, row in enumerate(rows.tolist())], Decontamination(repetitions=2))
    text = " ".join(f"w{x}" if x < 1 << 39 else f"new{x}" for x in b[0][:-1].tolist())
    item = rows.tolist().index(a[0][:-1].tolist())
    assert [hit[1] for hit in exhaustive.matches([f"before {text} after"])] == [item]


def test_short_items_are_found_exactly(spark):
    docs = spark.createDataFrame([(1, "here is the secret word again"), (2, "no such thing"), (3, "alone")], "doc_id long, text string")
    bench = spark.createDataFrame([(7, "secret word"), (8, "alone"), (9, "such other thing")], "item_id long, text string")
    got = {(r.doc_id, r.item_id, r.start_word) for r in contaminated(docs, bench, Decontamination(min_words=1)).collect()}
    assert got == {(1, 7, 3), (3, 8, 0)}


def test_no_letter_is_no_language(docs_from):
    labelled = [(i, "the cat and the dog", "en", "s") for i in range(20)]
    odd = [(100 + k, t, "en", "s") for k, t in enumerate(["½ ²", "Ⅷ", "12", "_-_", "\u0301"])]
    got = {r.doc_id: r.lang_pred for r in identify_language(docs_from(labelled + odd)).collect()}
    assert {got[100 + k] for k in range(5)} == {UNKNOWN}


def small_model(width=4, languages=3, seed=0):
    rng = np.random.default_rng(seed)
    shapes = (("table_f", (3 * width, 256)), ("inner_f", (3 * width, width)), ("table_b", (3 * width, 256)), ("inner_b", (3 * width, width)),
              ("out_f", (languages, width)), ("out_b", (languages, width)), ("bias", (languages, 1)))
    return {name: (rng.normal(size=shape) * 0.6).astype(np.float32) for name, shape in shapes}


def states_by_hand(table, inner, data):
    """A gated recurrent unit, byte by byte; the tables of the gates hold halves."""
    width = inner.shape[1]
    sigmoid = lambda v: 1 / (1 + np.exp(-2 * v))
    h, out = np.zeros(width), []
    for byte in data:
        x, g = table[:, byte].astype(float), inner.astype(float) @ h
        z, r = sigmoid(x[:width] + g[:width]), sigmoid(x[width : 2 * width] + g[width : 2 * width])
        c = np.tanh(x[2 * width :] + r * g[2 * width :])
        h = c + z * (h - c)
        out.append(h)
    return out


def test_pooled_probabilities_equal_the_recurrence():
    from fleetspan.llm.language import MARGIN, WIDTH, pooled

    model = small_model()
    texts = [b"abc", bytes(range(1, 200)), b"x" * 300, b"hello world " * 25]
    sums, counts = pooled(model, texts)
    for text, total, count in zip(texts, sums, counts):
        wanted, labels = np.zeros(3), np.zeros(3, int)
        padded = b"\0" * MARGIN + text + b"\0" * (2 * WIDTH + MARGIN)
        for at in range(0, len(text), WIDTH):
            window = padded[at : at + WIDTH + 2 * MARGIN]
            ahead = states_by_hand(model["table_f"], model["inner_f"], window[: MARGIN + WIDTH])[MARGIN:]
            back = states_by_hand(model["table_b"], model["inner_b"], window[MARGIN:][::-1])[MARGIN:][::-1]
            for f, b in list(zip(ahead, back))[: len(text) - at]:
                logits = model["out_f"] @ f + model["out_b"] @ b + model["bias"][:, 0]
                p = np.exp(logits) / np.exp(logits).sum()
                wanted += p
                labels[p.argmax()] += 1
        assert np.allclose(total, wanted, rtol=1e-3)
        assert count.sum() == len(text) and np.abs(count - labels).sum() <= 2


def test_gradients_equal_differences():
    from fleetspan.llm.language import _backward, _forward

    model = small_model(seed=3)
    table, inner = model["table_f"].astype(np.float64), model["inner_f"].astype(np.float64)
    steps = np.random.default_rng(1).integers(0, 6, (7, 5))
    weights = np.random.default_rng(2).normal(size=(7, 4, 5))
    loss = lambda t, i: float((_forward(t, i, steps)[0] * weights).sum())
    _, seen = _forward(table, inner, steps)
    d_table, d_inner = _backward(table, inner, steps, seen, weights)
    half = np.ones(12)
    half[:8] = 1.0
    for array, grad, places in ((inner, d_inner, [(0, 0), (5, 2), (9, 3), (11, 1)]), (table, d_table, [(0, 1), (6, 3), (10, 5), (3, 200)])):
        for place in places:
            kept, step = array[place], 1e-5
            array[place] = kept + step
            above = loss(table, inner)
            array[place] = kept - step
            below = loss(table, inner)
            array[place] = kept
            assert grad[place] == pytest.approx((above - below) / (2 * step), rel=2e-2, abs=2e-3)


def test_language_is_learnt_and_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = identify_language(docs).join(docs.select("doc_id", "lang", "text"), "doc_id").collect()
    tested = [r for r in rows if r.held_out and r.lang is not None and r.lang_pred != UNKNOWN]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert sum(r.lang == r.lang_pred for r in tested) / len(tested) > 0.9
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_of_awkward_rows(docs_from, awkward):
    got = [(r.doc_id, r.lang_pred, r.score) for r in identify_language(awkward).collect()]
    assert {p for _, p, _ in got} == {UNKNOWN}  # nothing is labelled
    labelled = [(i, "the cat and the dog", "en", "s") for i in range(20)] + [(30, "12 34", "en", "s"), (31, None, "en", "s"), (32, "le chat", None, "s")]
    got = {r.doc_id: r.lang_pred for r in identify_language(docs_from(labelled)).collect()}
    assert (got[30], got[31], got[32], got[0]) == (UNKNOWN, UNKNOWN, "en", "en")
    assert identify_language(docs_from([])).count() == 0


def distance_by_hand(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_edit_distances():
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 4, (80, 9)), rng.integers(0, 4, (80, 9))
    assert edit_distances(a, b).tolist() == [distance_by_hand(x, y) for x, y in zip(a.tolist(), b.tolist())]


def hits_by_hand(rows, items, settings=Decontamination()):
    out = set()
    for key, text in rows:
        words = words_of(text)
        for item, target in items:
            goal = words_of(target)
            n = len(goal)
            if n >= settings.min_words and any(distance_by_hand(words[i : i + n], goal) <= settings.edits(n) for i in range(len(words) - n + 1)):
                out.add((key, item))
    return out


def test_decontamination_finds_what_brute_force_finds(spark, sample):
    import random

    rng = random.Random(5)
    words = [f"w{k}" for k in range(40)]
    items = [(k, " ".join(rng.choices(words, k=rng.choice([3, 5, 10, 20])))) for k in range(12)] + [(50, None), (51, ""), (0, "one two")]
    rows = []
    for k in range(60):
        filler = " ".join(rng.choices(words, k=20))
        target = (rng.choice(items[:12])[1]).split()
        for _ in range(rng.randint(0, 3)):
            target[rng.randrange(len(target))] = "edited"
        rows.append((k, f"{filler} {' '.join(target)}. {filler}" if k % 4 else filler))
    rows += [(90, None), (91, ""), (1, rows[1][1])]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, found int, item_id int")
    bench = spark.createDataFrame(items + items[:2], "item_id long, text string")
    expected = hits_by_hand(rows, items)
    for block in (5000, 4):
        got = {(r.doc_id, r.item_id) for r in contaminated(docs, bench, Decontamination(block_items=block)).collect()}
        assert got <= expected
        assert len(got) >= 0.9 * len(expected)
        clean = without_benchmark(docs, bench, Decontamination(block_items=block))
        assert clean.columns == docs.columns
        assert {r.doc_id for r in clean.collect()} == {k for k, _ in rows} - {k for k, _ in got}
    assert contaminated(docs.limit(0), bench).count() == 0
    assert contaminated(docs, bench.limit(0)).count() == 0
    assert without_benchmark(docs, bench.limit(0)).count() == docs.count()
