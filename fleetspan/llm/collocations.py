"""Phrase collocations by HAT-trie counting.

Every task counts word sequences in a HAT-trie: hash containers under a shallow trie
of word ids. A container that grows too large bursts into a trie node with one
container per next word. Beyond a bound on the entries the largest subtrees are
spilled whole, each as a sorted run, and the runs of all tasks are merged per prefix
partition by Spark.

Only phrases that may be frequent enter the trie. Four passes before it sum the
occurrences of the hashes of phrases of one to four words; the hashes that are
frequent make a bitmap, bounded in size and without false negatives. A pass looks at
a phrase only where the shorter ones inside it passed, as what holds a rare phrase is
rare. What passes by mistake is removed by the exact counts of the trie.

Tasks read texts as arrays of bytes: words are runs between separators, hashed by
sums over their bytes. In the trie a word is what its bytes are: equal hashes are
compared byte by byte.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fleetspan.llm.bitmaps import LEAST_BITS, bitmap_of, passes
from fleetspan.operators.sizing import join_dimension, settle, written_table

MOST_WORDS = 5
SIFTED = 4  # phrase lengths with a pass and a bitmap of their own

BURST = 4096  # entries of a container
ENTRIES = 600_000  # of a task's trie, before subtrees are spilled
KNOWN_WORDS = 400_000  # word ids of a task, before it starts anew
CHUNK = 1 << 20  # bytes read at once; a longer piece is read whole
HELD = 1_000_000  # hashes a task holds before it passes them on
OUT_ROWS = 50_000
PREFIXES = 1024  # prefix partitions
SPREAD = 64  # parts in which the phrases of a language are ranked first

UNKNOWN_LANG = "und"
# Fixed values of the contract: what separates words, and what also ends a piece.
BLANKS, PIECE_ENDS = b" \t", b".,;:!?\n\x0b\x0c\r"
_KIND = np.zeros(256, dtype=np.uint8)
_KIND[list(BLANKS)], _KIND[list(PIECE_ENDS)] = 1, 2
_CUT = bytes.maketrans(PIECE_ENDS, b"." * len(PIECE_ENDS))
_STEP, _BASE = np.uint64(0x9E3779B97F4A7C15), 0xD6E8FEB86659FD93


class Container(dict):
    """Hash container: rest of the key -> count."""


class HatTrie:
    """Counts of byte keys made of four-byte word ids."""

    def __init__(self, burst: int = BURST):
        self.burst = burst
        self.root: dict = Container()
        self.entries = 0

    def add(self, key: bytes, count: int) -> None:
        node, at, above = self.root, 0, None
        while type(node) is not Container:
            word = key[at : at + 4]
            above = (node, word)
            if word not in node:
                node[word] = Container()
            node = node[word]
            at += 4
        rest = key[at:]
        if rest in node:
            node[rest] += count
            return
        node[rest] = count
        self.entries += 1
        if len(node) > self.burst and len(rest) > 0:
            grown = self._burst(node)
            if above is None:
                self.root = grown
            else:
                above[0][above[1]] = grown

    @staticmethod
    def _burst(container: Container) -> dict:
        node: dict = {}
        for rest, count in container.items():
            node.setdefault(rest[:4], Container())[rest[4:]] = count
        return node

    def _run(self, node: dict, prefix: bytes) -> Iterator[tuple[bytes, int]]:
        for rest in sorted(node):
            if type(node) is Container:
                yield prefix + rest, node[rest]
            else:
                yield from self._run(node[rest], prefix + rest)

    def _size(self, node: dict) -> int:
        return len(node) if type(node) is Container else sum(map(self._size, node.values()))

    def spill(self, keep: int = 0) -> Iterator[tuple[bytes, int]]:
        """The largest subtrees, each as a sorted run, until at most ``keep`` entries are left."""
        if type(self.root) is Container or keep == 0:
            root, self.root, self.entries = self.root, Container(), 0
            yield from self._run(root, b"")
            return
        for size, word in sorted(((self._size(child), word) for word, child in self.root.items()), reverse=True):
            if self.entries <= keep:
                break
            self.entries -= size
            yield from self._run(self.root.pop(word), word)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse, modulo 2 ** 64."""
    out = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        steps = np.full(n, np.uint64(base), dtype=np.uint64)
        steps[0] = 1
        out.append(np.multiply.accumulate(steps))
    return out[0], out[1]


def _mixed(values: np.ndarray) -> np.ndarray:
    out = (values ^ (values >> np.uint64(32))) * _STEP
    return out ^ (out >> np.uint64(29))


def phrase_hashes(hashes: np.ndarray, length: int) -> np.ndarray:
    """Hash of the phrase of ``length`` words at every place, from the hashes of the words."""
    n = hashes.size - length + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    out = hashes[:n].copy()
    for k in range(1, length):
        out ^= out >> np.uint64(29)
        out *= _STEP
        out += hashes[k : k + n]
    return _mixed(out)


class Words:
    """The words of some texts in order: where they are in ``data``, their hash with the language, language and piece."""

    def __init__(self, parts: list[tuple[int, bytes]], languages: list[str], powers: tuple[np.ndarray, np.ndarray]):
        self.passed: dict[int, np.ndarray] = {}
        joined = b"\n".join(p for _, p in parts)
        self.data = np.frombuffer(joined.lower(), dtype=np.uint8)  # bytes.lower acts on A-Z only
        kind = _KIND[self.data]
        inside = np.concatenate([[False], kind == 0, [False]])
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        self.starts, self.ends = edges[::2], edges[1::2]
        self.pieces = np.cumsum(kind == 2, dtype=np.int32)[self.starts]
        begins = np.cumsum([0, *(len(p) + 1 for _, p in parts)])[:-1]
        owner = np.searchsorted(begins, self.starts, "right") - 1
        self.lang = np.array([lang for lang, _ in parts], dtype=np.int64)[owner]
        sums = np.zeros(self.data.size + 1, dtype=np.uint64)
        np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * powers[0][: self.data.size], out=sums[1:])
        own = np.array([xxhash.xxh64_intdigest(name.encode("utf-8", "surrogatepass")) for name in languages], dtype=np.uint64)
        self.hashes = _mixed((sums[self.ends] - sums[self.starts]) * powers[1][self.starts] ^ own[self.lang])

    def whole(self, length: int) -> np.ndarray:
        """At which places a phrase of ``length`` words lies within one piece."""
        n = max(self.pieces.size - length + 1, 0)
        return self.pieces[:n] == self.pieces[length - 1 :][:n]

    def open_at(self, length: int, sieves: list[np.ndarray]) -> np.ndarray:
        """At which places a phrase of ``length`` words may be frequent, going by the bitmaps of the phrases inside it."""
        out = self.whole(length)
        inner = min(length, len(sieves))
        if inner and out.any():
            fits = self.sifted(inner, sieves)
            for k in range(length - inner + 1):
                out &= fits[k : k + out.size]
        return out

    def sifted(self, length: int, sieves: list[np.ndarray]) -> np.ndarray:
        """At which places the phrase of ``length`` words passes its own bitmap and those of the phrases inside it."""
        if length not in self.passed:
            out = self.open_at(length, sieves[: length - 1])
            at = np.flatnonzero(out)
            out[at] = passes(sieves[length - 1], phrase_hashes(self.hashes, length)[at])
            self.passed[length] = out
        return self.passed[length]


def _parts(text: str) -> Iterator[bytes]:
    """The text in parts of about a chunk, cut behind the end of a piece; a piece is never cut."""
    data, at = text.encode("utf-8", "surrogatepass"), 0
    if len(data) > CHUNK:
        ends = data.translate(_CUT)
        while len(data) - at > CHUNK:
            cut = ends.rfind(b".", at, at + CHUNK)
            cut = ends.find(b".", at + CHUNK) if cut < 0 else cut
            if cut < 0:
                break
            yield data[at : cut + 1]
            at = cut + 1
    yield data[at:]


def _chunks(batches: Iterator[pd.DataFrame], languages: list[str]) -> Iterator[Words]:
    """The texts of a task in chunks of words; ``languages`` gets the languages met."""
    known: dict[str, int] = {}
    parts: list[tuple[int, bytes]] = []
    size, powers = 0, _powers(CHUNK)

    def words() -> Words:
        nonlocal powers
        if size > powers[0].size:
            powers = _powers(size)
        return Words(parts, languages, powers)

    for batch in batches:
        for lang, text in zip(batch["lang"], batch["text"]):
            if lang not in known:
                known[lang] = len(languages)
                languages.append(lang)
            for part in _parts(text):
                if parts and size + len(part) + 1 > CHUNK:
                    yield words()
                    parts, size = [], 0
                parts.append((known[lang], part))
                size += len(part) + 1
    if parts:
        yield words()


def _summed(held: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = (np.concatenate(x) for x in zip(*held))
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if keys.size else np.zeros(0, dtype=np.int64)
    return keys[first], (np.add.reduceat(counts, first) if first.size else counts)


def _hash_runs(batches: Iterator[pd.DataFrame], length: int, sieves: list[np.ndarray]) -> Iterator[pd.DataFrame]:
    """(hash, n): occurrences in a task of the hashes of phrases of ``length`` words that may be frequent."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def frame() -> pd.DataFrame:
        return pd.DataFrame({"hash": held[0][0].view(np.int64), "n": held[0][1].astype(np.int64)})

    for words in _chunks(batches, []):
        found = phrase_hashes(words.hashes, length)[words.open_at(length, sieves)]
        held.append(np.unique(found, return_counts=True))
        size += held[-1][0].size
        if size > HELD:
            held = [_summed(held)]
            size = held[0][0].size
            if size > HELD // 2:
                yield frame()
                held, size = [], 0
    if held:
        held = [_summed(held)]
        yield frame()


class _Ids:
    """Ids of the words a task has met; id 0 is a word that is not frequent."""

    def __init__(self):
        self.by_hash: dict[int, int] = {}
        self.by_name: dict[tuple[int, bytes], int] | None = None  # made when two words have one hash
        self.names: list[tuple[int, bytes]] = [(0, b"")]

    def _id(self, name: tuple[int, bytes]) -> int:
        if self.by_name is not None and name in self.by_name:
            return self.by_name[name]
        self.names.append(name)
        if self.by_name is not None:
            self.by_name[name] = len(self.names) - 1
        return len(self.names) - 1

    def of(self, words: Words, good: np.ndarray) -> np.ndarray:
        """An id per word, the same for the same bytes and language: by hash, then compared."""
        out = np.zeros(words.hashes.size, dtype=np.uint32)
        at = np.flatnonzero(good)
        if not at.size:
            return out
        hashes, first, which = np.unique(words.hashes[at], return_index=True, return_inverse=True)
        found = np.zeros(hashes.size, dtype=np.uint32)
        for k, (h, place) in enumerate(zip(hashes.tolist(), at[first].tolist())):
            known = self.by_hash.get(h)
            if known is None:
                name = (int(words.lang[place]), words.data[words.starts[place] : words.ends[place]].tobytes())
                known = self.by_hash[h] = self._id(name)
            found[k] = known
        out[at] = found[which]
        if not self._same(words, at, found, which):  # two words with one hash
            if self.by_name is None:
                self.by_name = {name: k for k, name in enumerate(self.names) if k}
            names = zip(words.lang[at].tolist(), words.starts[at].tolist(), words.ends[at].tolist())
            out[at] = [self._id((lang, words.data[a:b].tobytes())) for lang, a, b in names]
        return out

    def _same(self, words: Words, at: np.ndarray, found: np.ndarray, which: np.ndarray) -> bool:
        """Are all words byte for byte what the names of their ids are?"""
        names = [self.names[k] for k in found.tolist()]
        sizes = np.array([len(name) for _, name in names], dtype=np.int64)
        lengths = words.ends[at] - words.starts[at]
        if (sizes[which] != lengths).any() or (np.array([lang for lang, _ in names])[which] != words.lang[at]).any():
            return False
        text = np.frombuffer(b"".join(name for _, name in names), dtype=np.uint8)
        begins = np.cumsum(sizes) - sizes
        inside = np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        return bool((words.data[np.repeat(words.starts[at], lengths) + inside] == text[np.repeat(begins[which], lengths) + inside]).all())

    def phrase(self, key: bytes, languages: list[str]) -> tuple[str, str]:
        ids = np.frombuffer(key, dtype=">u4").tolist()
        return languages[self.names[ids[0]][0]], b" ".join([self.names[i][1] for i in ids]).decode("utf-8", "surrogatepass")


def _distinct(ids: np.ndarray, places: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct phrases at the given places, as rows of ids, and their counts; exact by ranking pairs again and again."""
    rank = ids[places].astype(np.uint64)
    _, first, counts = np.unique(rank, return_index=True, return_counts=True)
    for k in range(1, length):
        pair = (rank << np.uint64(32)) | ids[places + k]
        _, first, inverse, counts = np.unique(pair, return_index=True, return_inverse=True, return_counts=True)
        rank = inverse.astype(np.uint64)
    return np.stack([ids[places[first] + k] for k in range(length)], axis=1), counts


def prefix_of(lang: str, phrase: str) -> int:
    """The prefix partition of a phrase: by its first two words, so that one frequent word is dealt out too."""
    head = " ".join(phrase.split(" ", 2)[:2])
    return xxhash.xxh64_intdigest(f"{lang} {head}".encode("utf-8", "surrogatepass")) % PREFIXES


def _runs(batches: Iterator[pd.DataFrame], sieves: list[np.ndarray]) -> Iterator[pd.DataFrame]:
    """Spilled runs of a task, one row per prefix partition and language: prefix, lang, phrases and their counts.

    The number of all words of a language comes under the empty phrase.
    """
    languages: list[str] = []
    ids, trie = _Ids(), HatTrie()
    totals = np.zeros(0, dtype=np.int64)

    def frame(runs: dict[tuple[int, str], tuple[list[str], list[int]]]) -> pd.DataFrame:
        return pd.DataFrame([(*key, *run) for key, run in runs.items()], columns=["prefix", "lang", "phrases", "counts"])

    def emit(keep: int) -> Iterator[pd.DataFrame]:
        runs: dict[tuple[int, str], tuple[list[str], list[int]]] = {}
        head, at, size = None, (0, ""), 0
        for key, count in trie.spill(keep):
            lang, phrase = ids.phrase(key, languages)
            if key[:8] != head:  # keys of a run that begin with the same two words follow each other
                head = key[:8]
                at = (prefix_of(lang, phrase), lang)
            phrases, counts = runs.setdefault(at, ([], []))
            phrases.append(phrase)
            counts.append(count)
            size += 1
            if size >= OUT_ROWS:
                yield frame(runs)
                runs, size = {}, 0
        yield frame(runs)

    for words in _chunks(batches, languages):
        seen = np.bincount(words.lang, minlength=len(languages))
        seen[: totals.size] += totals
        totals = seen
        number = ids.of(words, words.sifted(1, sieves))
        for length in range(1, MOST_WORDS + 1):
            fits = words.sifted(length, sieves) if length <= SIFTED else words.open_at(length, sieves)
            places = np.flatnonzero(fits)
            if not places.size:
                break
            phrases, counts = _distinct(number, places, length)
            packed, width = phrases.astype(">u4").tobytes(), 4 * length
            for i, count in enumerate(counts.tolist()):
                trie.add(packed[i * width : i * width + width], count)
        if len(ids.names) > KNOWN_WORDS:
            yield from emit(0)
            ids = _Ids()
        elif trie.entries > ENTRIES:
            yield from emit(ENTRIES // 2)
    yield from emit(0)
    yield frame({(0, name): ([""], [n]) for name, n in zip(languages, totals.tolist())})


def _sieve(texts: DataFrame, length: int, sieves: list[bytes], at_least: int) -> bytes | None:
    """Bitmap of the hashes of phrases of ``length`` words that occur often enough; None where there are none."""
    shared = texts.sparkSession.sparkContext.broadcast(sieves)

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from _hash_runs(batches, length, [np.frombuffer(b, dtype=np.uint8) for b in shared.value])

    summed = texts.mapInPandas(task, "hash long, n long").groupBy("hash").agg(F.sum("n").alias("n"))
    frequent = written_table(summed.where(F.col("n") >= at_least).select("hash"))
    n = frequent.count()
    return bitmap_of(frequent, "hash", n) if n else None


def _merged(batches: Iterator[pd.DataFrame], at_least: int) -> Iterator[pd.DataFrame]:
    """(lang, phrase, n) of the frequent phrases, and the totals; the runs come by prefix partition, one of which is held at a time."""
    names = ["lang", "phrase", "n"]
    at, sums = None, {}

    def frame() -> pd.DataFrame:
        return pd.DataFrame([(*key, n) for key, n in sums.items() if n >= at_least or not key[1]], columns=names)

    for batch in batches:
        for prefix, lang, phrases, counts in zip(batch["prefix"].tolist(), batch["lang"], batch["phrases"], batch["counts"]):
            if prefix != at:
                if sums:
                    yield frame()
                at, sums = prefix, {}
            for phrase, n in zip(phrases, counts.tolist()):
                key = (lang, phrase)
                sums[key] = sums.get(key, 0) + n
    yield frame()


def _counted(texts: DataFrame, sieves: list[bytes], at_least: int) -> DataFrame:
    """(lang, phrase, n): exact counts of the frequent phrases, the runs of all tasks merged by prefix partition."""
    shared = texts.sparkSession.sparkContext.broadcast(sieves)

    def task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from _runs(batches, [np.frombuffer(b, dtype=np.uint8) for b in shared.value])

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from _merged(batches, at_least)

    runs = texts.mapInPandas(task, "prefix int, lang string, phrases array<string>, counts array<bigint>")
    return runs.repartition("prefix").sortWithinPartitions("prefix").mapInPandas(merge, "lang string, phrase string, n long")


def frequent_phrases(docs: DataFrame, at_least: int, text: str = "text", lang: str = "lang") -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, words, f) of all phrases of 1 to 5 words with f >= at_least, and (lang, n) with the words of each language."""
    texts = docs.select(
        F.coalesce(F.col(lang).cast("string"), F.lit(UNKNOWN_LANG)).alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text")
    )
    sieves: list[bytes] = []
    for length in range(1, SIFTED + 1):
        found = _sieve(texts, length, sieves, at_least)
        # An empty bitmap lets nothing through: nothing longer can be frequent.
        sieves.append(found or bytes((1 << LEAST_BITS) // 8))
        if found is None:
            sieves += [sieves[-1]] * (SIFTED - length)
            break
    counted = written_table(_counted(texts, sieves, at_least))
    found = counted.where("phrase <> ''").select("lang", "phrase", F.size(F.split("phrase", " ")).alias("words"), F.col("n").alias("f"))
    return found, counted.where("phrase = ''").select("lang", "n")


def _part(words: Column, start: Column, length: Column) -> Column:
    return F.array_join(F.slice(words, start, length), " ")


def collocations(docs: DataFrame, at_least: int = 100, top: int = 2000, text: str = "text", lang: str = "lang") -> DataFrame:
    """The ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score.

    Texts are lower-cased (A-Z), cut into pieces and words; a null text is empty, a
    null language is ``und``. Every row counts, repeated rows and null keys too.
    Candidates have two to five words and occur at least ``at_least`` times. The
    score of a candidate is that of its worst cut, ``floor(1000 * a * n / (l * r))``,
    exact; of cuts with the same score the first counts. A candidate inside a longer
    one that is as frequent is dropped; it is enough to look one word further, as a
    phrase is never rarer than a longer one around it. Ties of score are settled by a
    and the bytes of the phrase. An empty table, or one without candidates, gives an
    empty result; other columns of ``docs`` play no part.
    """
    found, totals = frequent_phrases(docs, at_least, text, lang)
    phrases, totals = settle(found, totals)
    of = phrases.table.select(F.col("lang").alias("of_lang"), F.col("phrase").alias("of"), F.col("f").alias("of_f"))
    side = type(phrases)(of, phrases.n_rows, phrases.n_bytes)

    candidates = phrases.table.where("words >= 2").select("lang", "phrase", "words", F.col("f").alias("a"))
    part = F.split("phrase", " ")
    inner = candidates.where("words >= 3").select(
        "lang", "a", F.explode(F.array(_part(part, F.lit(1), F.col("words") - 1), _part(part, F.lit(2), F.col("words") - 1))).alias("phrase")
    )
    around = inner.groupBy("lang", "phrase").agg(F.max("a").alias("around"))
    open_ones = candidates.join(around, ["lang", "phrase"], "left").where("around is null or around < a").drop("around")

    cuts = open_ones.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = cuts.withColumns({
        "first": _part(part, F.lit(1), F.col("cut")), "rest": _part(part, F.col("cut") + 1, F.col("words") - F.col("cut")),
    })
    for name, value in (("first", "l"), ("rest", "r")):
        joined = join_dimension(cuts, side, [("lang", "of_lang"), (name, "of")], spread_by="phrase")
        cuts = joined.withColumn(value, F.col("of_f")).drop("of_lang", "of", "of_f")
    of_lang = totals.table.select(F.col("lang").alias("of_lang"), F.col("n"))
    cuts = join_dimension(cuts, type(totals)(of_lang, totals.n_rows, totals.n_bytes), [("lang", "of_lang")], spread_by="phrase").drop("of_lang")
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    over, under = (F.lit(1000).cast("decimal(38,0)") * wide("a")).cast("decimal(38,0)") * wide("n"), wide("l") * wide("r")
    cuts = cuts.withColumns({"over": over.cast("decimal(38,0)"), "under": under.cast("decimal(38,0)")}).withColumn("score", F.expr("over div under"))
    worst = F.min(F.struct("score", "cut", "l", "r")).alias("worst")
    scored = cuts.groupBy("lang", "phrase", "a", "n").agg(worst).select("lang", "phrase", "a", "worst.l", "worst.r", "n", "worst.score")

    # The best of every part of a language first, so that no task ranks all candidates of a large language.
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    parts = scored.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(SPREAD)))
    parts = parts.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    ranked = parts.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
