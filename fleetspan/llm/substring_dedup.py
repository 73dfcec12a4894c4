"""Substring deduplication by super-k-mer partitioning.

A window is a fixed number of consecutive words. Its minimiser is the smallest hash of
the short word sequences in it, so equal windows have equal minimisers wherever they
lie. Consecutive windows that share a minimiser travel as one packed string, a
super-k-mer, to the bucket of the minimiser, where sorting brings equal windows
together and shows every one that is not the first.

* A minimiser met at one place only belongs to windows that do not repeat; they stay at
  home. A bitmap of the others, bounded in size and without false negatives, decides.
* The bucket of a minimiser with very many windows is split. Each part finds its own
  first windows; those are merged by window, and the ones that are not first of all are
  repeated too.

Text is never cut: a window is compared by its words, not by its hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetspan.llm.bitmaps import bitmap_of, passes
from fleetspan.operators.sizing import written_table

WINDOW = 20
MINIMISER = 4  # words of the sequences a minimiser is chosen from
BUCKET_WINDOWS = 40_000  # windows of one minimiser that are compared in one place
MOST_HOT = 500_000  # minimisers with a split bucket; beyond that, buckets grow
CHUNK_WORDS = 200_000
KNOWN_WORDS = 400_000
OUT_ROWS = 20_000
WIDE = 32  # a range of words is packed in a long: first word, then end

_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], dtype=np.uint64)


class _Hashes(dict):
    """Hash of each word, computed once."""

    def __missing__(self, word: bytes) -> int:
        out = self[word] = xxhash.xxh64_intdigest(word)
        return out


def _sequence_hashes(hashes: np.ndarray, length: int) -> np.ndarray:
    n = hashes.size - length + 1
    out = np.zeros(n, dtype=np.uint64)
    for k in range(length):
        out += hashes[k : k + n] * _FACTORS[k % _FACTORS.size]
        out ^= out >> np.uint64(31)
        out *= _FACTORS[0]
    return out ^ (out >> np.uint64(29))


def _sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    out, reach = values, 1
    while reach * 2 <= width:
        out = np.minimum(out[: out.size - reach], out[reach:])
        reach *= 2
    rest = width - reach
    return np.minimum(out[: out.size - rest], out[rest:]) if rest else out


def super_kmers(hashes: np.ndarray, doc: np.ndarray, window: int, minimiser: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Super-k-mers of words in a row: first window, number of windows, minimiser, places of the minimiser (one, or two for more).

    ``doc`` numbers the text each word is of; no window crosses texts. A super-k-mer
    has at most as many windows as a window has sequences, so one that holds a single
    place of its minimiser is never cut.
    """
    none = np.zeros(0, dtype=np.int64)
    if hashes.size < window:
        return none, none, none.astype(np.uint64), none
    inner = window - minimiser + 1
    sequences = _sequence_hashes(hashes, minimiser)
    least = _sliding_min(sequences, inner)
    at = np.flatnonzero(doc[: least.size] == doc[window - 1 :])
    if not at.size:
        return none, none, none.astype(np.uint64), none
    value = least[at]
    fresh = np.ones(at.size, dtype=bool)
    fresh[1:] = (at[1:] != at[:-1] + 1) | (value[1:] != value[:-1])
    begin = np.flatnonzero(fresh)
    place = np.arange(at.size) - np.repeat(begin, np.diff(np.append(begin, at.size)))
    begin = np.flatnonzero(place % inner == 0)
    sizes = np.diff(np.append(begin, at.size))
    first, value = at[begin], value[begin]
    view = np.lib.stride_tricks.sliding_window_view(sequences, inner)
    left, right = view[first] == value[:, None], view[first + sizes - 1] == value[:, None]
    single = (left.sum(axis=1) == 1) & (right.sum(axis=1) == 1) & (left.argmax(axis=1) == right.argmax(axis=1) + sizes - 1)
    return first, sizes, value, np.where(single, 1, 2)


def _chunks(batches: Iterator[pd.DataFrame], window: int) -> Iterator[tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray, list[tuple]]]:
    """Words of several texts in a row, their hashes, the text each is of, its place there, and the other columns of the texts."""
    known, words, sizes, rows = _Hashes(), [], [], []

    def chunk():
        counts = np.array(sizes, dtype=np.int64)
        doc = np.repeat(np.arange(counts.size), counts)
        place = np.arange(doc.size) - np.repeat(np.cumsum(counts) - counts, counts)
        return words, np.fromiter(map(known.__getitem__, words), np.uint64, len(words)), doc, place, rows

    for batch in batches:
        others = [c for c in batch.columns if c != "text"]
        for row in zip(batch["text"], *[batch[c] for c in others]):
            found = row[0].encode("utf-8", "surrogatepass").split()
            if len(found) < window:
                continue
            words += found
            sizes.append(len(found))
            rows.append(row[1:])
            if len(words) >= CHUNK_WORDS:
                yield chunk()
                words, sizes, rows = [], [], []
                if len(known) > KNOWN_WORDS:
                    known = _Hashes()
    if words:
        yield chunk()


def _minimisers(texts: DataFrame, window: int, minimiser: int) -> DataFrame:
    """(bucket, places, windows) of every minimiser met at more than one place."""

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for _, hashes, doc, _, _ in _chunks(batches, window):
            _, sizes, value, places = super_kmers(hashes, doc, window, minimiser)
            kept, inverse = np.unique(value, return_inverse=True)
            yield pd.DataFrame({
                "bucket": kept.view(np.int64),
                "places": np.bincount(inverse, weights=places, minlength=kept.size).astype(np.int64),
                "windows": np.bincount(inverse, weights=sizes, minlength=kept.size).astype(np.int64),
            })

    found = texts.select("text").mapInPandas(task, "bucket long, places long, windows long")
    return found.groupBy("bucket").agg(F.sum("places").alias("places"), F.sum("windows").alias("windows")).where("places > 1")


def _hot_buckets(repeated: DataFrame, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Minimisers whose bucket is split, sorted, and into how many parts; at most MOST_HOT of them."""
    most = max(BUCKET_WINDOWS, total // MOST_HOT)
    rows = repeated.where(F.col("windows") > most).select("bucket", "windows").collect()
    buckets = np.array([r["bucket"] for r in rows], dtype=np.int64)
    parts = np.array([-(-r["windows"] // most) for r in rows], dtype=np.int64)
    order = np.argsort(buckets)
    return buckets[order], parts[order]


def _packed(rows: DataFrame, window: int, minimiser: int, bits: bytes, hot: tuple[np.ndarray, np.ndarray], schema: str) -> DataFrame:
    """One row per super-k-mer that may repeat: bucket, parts, part, identity of the document, first word and packed words."""
    shared = rows.sparkSession.sparkContext.broadcast((bits, hot))

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        raw, (hot_buckets, hot_parts) = shared.value
        bitmap = np.frombuffer(raw, dtype=np.uint8)
        for words, hashes, doc, place, texts in _chunks(batches, window):
            first, sizes, value, _ = super_kmers(hashes, doc, window, minimiser)
            kept = passes(bitmap, value)
            first, sizes, bucket = first[kept], sizes[kept], value[kept].view(np.int64)
            parts = np.ones(first.size, dtype=np.int64)
            if hot_buckets.size:
                found = np.minimum(np.searchsorted(hot_buckets, bucket), hot_buckets.size - 1)
                parts = np.where(hot_buckets[found] == bucket, hot_parts[found], 1)
            for k in range(0, first.size, OUT_ROWS):
                starts, ends = first[k : k + OUT_ROWS].tolist(), (first + sizes + window - 1)[k : k + OUT_ROWS].tolist()
                of = doc[first[k : k + OUT_ROWS]].tolist()
                at = place[first[k : k + OUT_ROWS]]
                spread = np.array([texts[d][-1] for d in of], dtype=np.int64).view(np.uint64) + at.astype(np.uint64) * _FACTORS[1]
                n = parts[k : k + OUT_ROWS]
                yield pd.DataFrame({
                    "bucket": bucket[k : k + OUT_ROWS], "parts": n, "part": (spread >> np.uint64(20)).astype(np.int64) % n,
                    "unnamed": [texts[d][0] for d in of], "doc_id": [texts[d][1] for d in of], "text_hash": [texts[d][2] for d in of],
                    "first": at, "packed": [b" ".join(words[a:b]) for a, b in zip(starts, ends)],
                })

    return rows.mapInPandas(task, f"bucket long, parts long, part long, {schema}, first long, packed binary")


def _windows(packed: bytes, window: int) -> list[bytes]:
    sizes = np.fromiter(map(len, packed.split(b" ")), np.int64)
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    return [packed[a:b] for a, b in zip(starts.tolist(), ends[window - 1 :].tolist())]


def _sorted_bucket(rows: list[tuple], window: int, split: bool, out: list[tuple]) -> None:
    """Sort the windows of a bucket whose super-k-mers are in document order; add ranges of repeated words and, of a split bucket, the first windows."""
    windows, owner, offset = [], [], []
    for k, row in enumerate(rows):
        found = _windows(row[-1], window)
        windows += found
        owner += [k] * len(found)
        offset += range(len(found))
    order = sorted(range(len(windows)), key=windows.__getitem__)  # stable: equal windows stay in document order
    places = [(*rows[owner[i]][:3], rows[owner[i]][3] + offset[i]) for i in order]
    repeated: dict[int, list[int]] = {}
    first = -1
    for k, i in enumerate(order):
        if first < 0 or windows[i] != windows[order[first]]:
            first = k
            if split:
                out.append((*places[k][:3], places[k][3], -1, windows[i]))
        elif places[k] != places[first]:  # the same row given twice is not a repetition
            repeated.setdefault(owner[i], []).append(offset[i])
    for k, offsets in repeated.items():
        offsets.sort()
        begin = last = offsets[0]
        for j in [*offsets[1:], 1 << 40]:
            if j != last + 1:
                out.append((*rows[k][:3], rows[k][3] + begin, rows[k][3] + last + window, None))
                begin = j
            last = j


def _sorted_buckets(kmers: DataFrame, window: int, schema: str) -> DataFrame:
    """Ranges (first word, end) of repeated words; of split buckets also the first windows of each part, with end -1."""
    names = ["unnamed", "doc_id", "text_hash", "first", "end", "window"]

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, rows, out = None, [], []
        for batch in batches:
            columns = [batch[c].tolist() for c in ("bucket", "part", "parts", "unnamed", "doc_id", "text_hash", "first", "packed")]
            for bucket, part, parts, *row in zip(*columns):
                if group != (bucket, part, parts):
                    if rows:
                        _sorted_bucket(rows, window, group[2] > 1, out)
                    group, rows = (bucket, part, parts), []
                    if len(out) >= OUT_ROWS:
                        yield pd.DataFrame(out, columns=names)
                        out.clear()
                rows.append(tuple(row))
        if rows:
            _sorted_bucket(rows, window, group[2] > 1, out)
        yield pd.DataFrame(out, columns=names)

    dealt = kmers.repartition("bucket", "part").sortWithinPartitions("bucket", "part", "unnamed", "doc_id", "text_hash", "first")
    return dealt.mapInPandas(task, f"{schema}, first long, end long, window binary")


def repeated_ranges(docs: DataFrame, window: int = WINDOW, minimiser: int = MINIMISER, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(unnamed, doc_id, text_hash, first, end): ranges of words covered by a window that also starts earlier; ranges may overlap."""
    rows = _identified(docs, key, text)
    kind = dict(rows.dtypes)["doc_id"]
    schema = f"unnamed boolean, doc_id {kind}, text_hash long"
    repeated = written_table(_minimisers(rows, window, minimiser))
    size = repeated.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("windows"), F.lit(0)).alias("windows")).first()
    bits = bitmap_of(repeated, "bucket", size["n"])
    kmers = _packed(rows, window, minimiser, bits, _hot_buckets(repeated, size["windows"]), schema)
    found = written_table(_sorted_buckets(kmers, window, schema))
    identity = ["unnamed", "doc_id", "text_hash", "first"]
    firsts = found.where("end < 0")
    place = F.struct(*identity)
    best = firsts.groupBy("window").agg(F.min(place).alias("best"))
    later = firsts.join(best, "window").where(~place.eqNullSafe(F.col("best"))).withColumn("end", F.col("first") + window)
    return found.where("end >= 0").select(*identity, "end").unionAll(later.select(*identity, "end"))


def _identified(docs: DataFrame, key: str, text: str) -> DataFrame:
    """The text and what names its document, without nulls: ``unnamed`` stands for a null key and sorts last."""
    whole = F.coalesce(F.col(text), F.lit(""))
    kind = docs.schema[key].dataType
    rows = docs.select(
        whole.alias("text"), F.col(key).isNull().alias("unnamed"), F.coalesce(F.col(key), F.lit("0").cast(kind)).alias("doc_id"),
        F.xxhash64(whole).alias("text_hash"),
    )
    return rows.withColumn("mix", F.xxhash64("unnamed", "doc_id", "text_hash"))


def _cleaned(text: Column, ranges: Column) -> Column:
    @F.pandas_udf("n_words long, n_removed long, kept_text string")
    def clean(texts: pd.Series, covered: pd.Series) -> pd.DataFrame:
        out = []
        for value, marks in zip(texts, covered):
            words = value.encode("utf-8", "surrogatepass").split()
            n = len(words)
            if marks is not None and len(marks):
                marks = np.asarray(marks, dtype=np.int64)
                depth = np.zeros(n + 1, dtype=np.int64)
                np.add.at(depth, marks >> WIDE, 1)
                np.add.at(depth, marks & ((1 << WIDE) - 1), -1)
                words = [words[i] for i in np.flatnonzero(np.cumsum(depth)[:n] == 0).tolist()]
            out.append((n, n - len(words), b" ".join(words).decode("utf-8", "surrogatepass")))
        return pd.DataFrame(out, columns=["n_words", "n_removed", "kept_text"])

    return clean(text, ranges)


def without_repeated_passages(docs: DataFrame, window: int = WINDOW, minimiser: int = MINIMISER, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_text.

    A word goes when a window of ``window`` words around it has the same words as one
    that starts earlier: in a document with a smaller key, or before it in the same
    one. Windows are judged on the input. Keys are numbers or strings; null keys come last. Rows with the same key
    and different texts are different documents, in the order of a hash of the text;
    rows with the same key and text are one document given several times and get the
    same result. Null and empty texts have no words; texts shorter than the window stay
    whole. An empty table gives an empty result; other columns of ``docs`` play no part.
    """
    ranges = repeated_ranges(docs, window, minimiser, key, text)
    packed = F.shiftleft(F.col("first"), WIDE) + F.col("end")
    identity = ["unnamed", "doc_id", "text_hash"]
    marks = ranges.groupBy(*identity).agg(F.collect_list(packed).alias("ranges"))
    name = F.when(~F.col("unnamed"), F.col("doc_id")).alias("doc_id")
    joined = _identified(docs, key, text).join(marks, identity, "left").select(name, _cleaned(F.col("text"), F.col("ranges")).alias("clean"))
    return joined.select("doc_id", "clean.n_words", "clean.n_removed", "clean.kept_text")
