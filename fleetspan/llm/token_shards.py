"""Token ids as wavelet-matrix shards: succinct bit planes with rank and select.

Documents are laid out in ascending key order by a range partitioning; each task
tokenizes its range and writes shards, one row of a Parquet file each: the bit
planes of a wavelet matrix over the ids, the counts for rank and select, and the
index of the documents in it. Everything is read back from these files: single
ids, counts and places of an id without decoding, or whole shards.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fleetspan.llm.workers import kept
from fleetspan.operators.sizing import join_dimension, new_folder, settle

SHARD_IDS = 1 << 19  # a shard ends with the document that passes this many ids
PARTITION_BYTES = 24 << 20  # text per task
RANK_BITS = 512  # ones are counted up to each block of so many bits
# Below U+0300 no characters combine or decompose; the superscripts and fractions are numbers but no digits.
UNUSUAL = re.compile("[^\x00-\u02ff]|[²³¹¼½¾]")
RARE_NUMBERS = "²³¹¼½¾"  # those of the above that Latin-1 holds
# Fixed value: the pieces into which the tokenizer cuts usual lower-case text.
PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\w \t\n\x0b\x0c\r\x85\xa0]|_)+")
# The steps of a tokenizer for which words can be encoded one by one.
NORMALIZER = {
    "type": "Sequence",
    "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}],
}
PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {
            "type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"},
            "behavior": "Removed", "invert": True,
        },
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


def is_unusual(text: str) -> bool:
    """Does ``UNUSUAL`` match? Text within Latin-1, which encodes at the speed of a copy, is searched for six characters only."""
    if text.isascii():
        return False
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return UNUSUAL.search(text) is not None
    return any(c in text for c in RARE_NUMBERS)


MEMO_WORDS = 800_000
MEMO_BYTES = 48
SHARD_SCHEMA = "part int, shard int, start_in_part long, n_ids long, doc_ids array<bigint>, doc_starts array<bigint>, doc_sizes array<bigint>, wavelet binary"
DOC_SCHEMA = "part int, doc_id bigint, start_in_part long, n_tokens long, ids_crc32 long"


class WaveletMatrix:
    """Bit planes of a sequence, highest bit first; each plane is ordered by the bits above it."""

    HEAD = "<4sQB"  # mark, ids, planes

    def __init__(self, size: int, zeros: list[int], planes: list[np.ndarray], ranks: list[np.ndarray]):
        self.size, self.zeros, self.planes, self.ranks = size, zeros, planes, ranks

    @classmethod
    def build(cls, ids: np.ndarray, bits: int) -> WaveletMatrix:
        at = ids.astype(np.uint16 if bits <= 16 else np.uint32)
        zeros, planes, ranks = [], [], []
        for bit in range(bits - 1, -1, -1):
            ones = (at >> at.dtype.type(bit)) & at.dtype.type(1) != 0
            plane = np.packbits(ones, bitorder="little")
            zeros.append(int(len(at) - np.count_nonzero(ones)))
            planes.append(plane)
            ranks.append(cls._ranks(plane))
            at = np.concatenate([np.compress(~ones, at), np.compress(ones, at)])
        return cls(len(ids), zeros, planes, ranks)

    @staticmethod
    def _ranks(plane: np.ndarray) -> np.ndarray:
        width = RANK_BITS // 8
        padded = np.zeros(-(-len(plane) // width) * width, np.uint8)
        padded[: len(plane)] = plane
        ones = np.bitwise_count(padded.view(np.uint64)).reshape(-1, width // 8).sum(axis=1, dtype=np.int64)
        return np.concatenate([[0], np.cumsum(ones)]).astype(np.uint32)

    def to_bytes(self) -> bytes:
        head = struct.pack(self.HEAD, b"WVM1", self.size, len(self.planes)) + np.array(self.zeros, "<u4").tobytes()
        return head + b"".join(p.tobytes() + r.astype("<u4").tobytes() for p, r in zip(self.planes, self.ranks))

    @classmethod
    def from_bytes(cls, data: bytes) -> WaveletMatrix:
        magic, size, bits = struct.unpack_from(cls.HEAD, data)
        if magic != b"WVM1":
            raise ValueError("not a wavelet shard")
        at = struct.calcsize(cls.HEAD)
        zeros = np.frombuffer(data, "<u4", bits, at).tolist()
        at += 4 * bits
        width, counts = -(-size // 8), -(-size // RANK_BITS) + 1
        planes, ranks = [], []
        for _ in range(bits):
            planes.append(np.frombuffer(data, np.uint8, width, at))
            ranks.append(np.frombuffer(data, "<u4", counts, at + width))
            at += width + 4 * counts
        return cls(size, zeros, planes, ranks)

    def decode(self) -> np.ndarray:
        """All ids in order: the planes are undone from the last to the first."""
        kind = np.uint16 if len(self.planes) <= 16 else np.uint32
        at = np.zeros(self.size, kind)
        for level in range(len(self.planes) - 1, -1, -1):
            ones = np.unpackbits(self.planes[level], count=self.size, bitorder="little").view(bool)
            before = np.empty_like(at)
            before[np.flatnonzero(~ones)] = at[: self.zeros[level]]
            before[np.flatnonzero(ones)] = at[self.zeros[level] :] | kind(1 << (len(self.planes) - 1 - level))
            at = before
        return at

    def _bit(self, level: int, place: int) -> int:
        return int(self.planes[level][place >> 3]) >> (place & 7) & 1

    def _ones(self, level: int, place: int) -> int:
        """Ones of a plane before a place."""
        block = place // RANK_BITS
        first, last = block * RANK_BITS // 8, place >> 3
        rest = int(np.bitwise_count(self.planes[level][first:last]).sum())
        if place & 7:
            rest += (int(self.planes[level][last]) & ((1 << (place & 7)) - 1)).bit_count()
        return int(self.ranks[level][block]) + rest

    def access(self, place: int) -> int:
        if not 0 <= place < self.size:
            raise IndexError(place)
        found = 0
        for level, zeros in enumerate(self.zeros):
            bit, ones = self._bit(level, place), self._ones(level, place)
            found = found << 1 | bit
            place = zeros + ones if bit else place - ones
        return found

    def _range(self, token: int, end: int) -> tuple[int, int]:
        """Where the last plane's order holds the occurrences of an id before ``end``."""
        if token >> len(self.planes):
            return 0, 0
        low, high = 0, end
        for level, zeros in enumerate(self.zeros):
            a, b = self._ones(level, low), self._ones(level, high)
            one = token >> (len(self.planes) - 1 - level) & 1
            low, high = (zeros + a, zeros + b) if one else (low - a, high - b)
        return low, high

    def rank(self, token: int, end: int | None = None) -> int:
        """Occurrences of an id before a place; all of them without one."""
        low, high = self._range(token, self.size if end is None else end)
        return high - low

    def _place(self, level: int, bit: int, nth: int) -> int:
        """Place of the nth one (or zero) of a plane: a search in the counts, then within a block."""
        ranks = self.ranks[level].astype(np.int64)
        counts = ranks if bit else np.minimum(np.arange(len(ranks), dtype=np.int64) * RANK_BITS, self.size) - ranks
        block = int(np.searchsorted(counts, nth, "right")) - 1
        first = block * RANK_BITS
        part = self.planes[level][first // 8 : (first + RANK_BITS) // 8]
        bits = np.unpackbits(part, bitorder="little")[: self.size - first]
        return first + int(np.flatnonzero(bits == bit)[nth - int(counts[block])])

    def select(self, token: int, nth: int) -> int:
        """Place of the nth occurrence of an id, from zero."""
        low, high = self._range(token, self.size)
        if not 0 <= nth < high - low:
            raise IndexError(nth)
        place = low + nth
        for level in range(len(self.planes) - 1, -1, -1):
            one = token >> (len(self.planes) - 1 - level) & 1
            place = self._place(level, one, place - self.zeros[level] if one else place)
        return place


class WordEncoder(dict):
    """Ids of words as little-endian bytes, encoded when first asked for; a bounded memo.

    The tokenizer drops white space and never joins across it, so that a text is
    the sequence of its words, which are cut at ASCII white space.
    """

    def __init__(self, tokenizer_json: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.model = self.tokenizer.model
        # Byte-level alphabet: printable bytes stand for themselves, the others for characters from 256 on.
        plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
        other = iter(range(256, 512))
        self.alphabet = {b: b if b in plain else next(other) for b in range(256)}

    def _piece(self, piece: str) -> bytes:
        letters = piece if piece.isascii() and piece.isprintable() else piece.encode().decode("latin-1").translate(self.alphabet)
        return array("I", [t.id for t in self.model.tokenize(letters)]).tobytes()

    def __missing__(self, word: bytes) -> bytes:
        if word.isalpha() and word.islower():
            found = self._piece(word.decode())
        elif word[:-1].isalpha() and word[-1] < 128 and not word[-1:].isalnum():  # letters and one sign: two pieces, kept by themselves
            return self[word[:-1]] + self[word[-1:]]
        else:
            text = word.decode("utf-8", "surrogatepass")
            if is_unusual(text) or "<|" in text:
                found = array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
            else:
                pieces = PIECE.findall(text.lower())
                found = self._piece(pieces[0]) if len(pieces) == 1 else b"".join([self[p.encode()] for p in pieces])
        if len(word) <= MEMO_BYTES:
            self[word] = found
        return found

    def text(self, text: str | None) -> bytes:
        if not text:
            return b""
        data = text.encode("utf-8", "surrogatepass")
        # Lower case is the tokenizer's own first step; alike only where no mark can combine and no special token is meant.
        if b"<|" not in data and not is_unusual(text):
            data = data.lower()
        if len(self) > MEMO_WORDS:
            self.clear()
        return b"".join(map(self.__getitem__, data.split()))


class PlainEncoder:
    """Ids of whole texts by the tokenizer itself, whatever its steps are."""

    def __init__(self, tokenizer_json: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)

    def text(self, text: str | None) -> bytes:
        return array("I", self.tokenizer.encode(text or "", add_special_tokens=False).ids).tobytes()


def encoder_for(tokenizer_json: str) -> WordEncoder | PlainEncoder:
    """Word by word for a tokenizer with exactly the steps that ``WordEncoder`` stands for; any other encodes whole texts."""
    steps = json.loads(tokenizer_json)
    model = steps["model"]
    by_word = (
        steps["normalizer"] == NORMALIZER and steps["pre_tokenizer"] == PRE_TOKENIZER and model.get("type", "BPE") == "BPE"
        and not model.get("dropout") and all(t["content"].startswith("<|") for t in steps["added_tokens"])
    )
    return WordEncoder(tokenizer_json) if by_word else PlainEncoder(tokenizer_json)


def write_token_shards(
    docs: DataFrame, tokenizer_path: str, path: str, end_id: int, key: str = "doc_id", text: str = "text",
    shard_ids: int = SHARD_IDS, partition_bytes: int = PARTITION_BYTES,
) -> DataFrame:
    """Encode every whole text, append ``end_id``, write the shards to ``path`` and return them as read back.

    Ids are in ascending order of the key, a null key first; rows with the same key
    are in the order of a hash of their texts, so that one key does not make one range. Null and empty texts hold the end id only. An
    empty table writes a folder without shards. Other columns play no part.
    """
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as file:
        tokenizer_json = file.read()
    from tokenizers import Tokenizer

    bits = max(Tokenizer.from_str(tokenizer_json).get_vocab_size(with_added_tokens=True) - 1, end_id, 1).bit_length()
    shared = spark.sparkContext.broadcast({"tokenizer": tokenizer_json})  # a tokenizer file: its size does not follow the data
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text")).alias("n_bytes"), F.count(F.lit(1)).alias("n_rows")).first()
    parts = 1 + ((size["n_bytes"] or 0) + 16 * size["n_rows"]) // partition_bytes

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        encoder = kept(shared.value, lambda: encoder_for(shared.value["tokenizer"]))
        end = struct.pack("<I", end_id)
        part, shard, written = TaskContext.get().partitionId(), 0, 0
        keys: list[int | None] = []
        sizes: list[int] = []
        held: list[bytes] = []
        total = 0

        def flush() -> pd.DataFrame:
            ids = np.frombuffer(b"".join(held), "<u4")
            n = np.array(sizes, np.int64)
            row = (part, shard, written, len(ids), keys, np.cumsum(n) - n, n, WaveletMatrix.build(ids, bits).to_bytes())
            return pd.DataFrame([row], columns=[c.split()[0] for c in SHARD_SCHEMA.split(", ")])

        for batch in batches:
            for doc_id, body in zip(batch["doc_id"], batch["text"]):
                data = encoder.text(body) + end
                keys.append(None if pd.isna(doc_id) else int(doc_id))
                sizes.append(len(data) // 4)
                held.append(data)
                total += sizes[-1]
                if total >= shard_ids:
                    yield flush()
                    shard, written = shard + 1, written + total
                    keys, sizes, held, total = [], [], [], 0
        if keys:
            yield flush()

    (
        rows.withColumn("spread", F.xxhash64("text"))
        .repartitionByRange(parts, "doc_id", "spread")
        .sortWithinPartitions("doc_id", "spread", "text")
        .select("doc_id", "text")
        .mapInPandas(encode, SHARD_SCHEMA)
        .write.option("compression", "zstd")
        .parquet(path)
    )
    return read_token_shards(spark, path)


def read_token_shards(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SHARD_SCHEMA).parquet(path)


def part_starts(shards: DataFrame) -> DataFrame:
    """Ids before each part: a running sum over one row per written part."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = shards.groupBy("part").agg(F.sum("n_ids").alias("n"))
    return totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_start"))


def _with_starts(rows: DataFrame, shards: DataFrame, spread_by: str) -> DataFrame:
    """Add ``part_start``. There is a row per written part; its size is measured before it is broadcast."""
    starts = part_starts(shards).select(F.col("part").alias("of_part"), "part_start")
    return join_dimension(rows, settle(starts)[0], [("part", "of_part")], spread_by).drop("of_part")


def shard_documents(shards: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, decoded from the shards."""

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                data = memoryview(WaveletMatrix.from_bytes(row.wavelet).decode().astype("<u4").tobytes())
                starts, sizes = np.asarray(row.doc_starts, np.int64), np.asarray(row.doc_sizes, np.int64)
                yield pd.DataFrame(
                    {
                        "part": row.part,
                        "doc_id": pd.array(list(row.doc_ids), dtype="Int64"),
                        "start_in_part": row.start_in_part + starts,
                        "n_tokens": sizes,
                        "ids_crc32": [zlib.crc32(data[4 * a : 4 * (a + n)]) for a, n in zip(starts.tolist(), sizes.tolist())],
                    }
                )

    documents = _with_starts(shards.mapInPandas(decode, DOC_SCHEMA), shards, "start_in_part")
    return documents.select("doc_id", (F.col("part_start") + F.col("start_in_part")).alias("start"), "n_tokens", "ids_crc32")


def find_token(shards: DataFrame, token: int) -> DataFrame:
    """start of every occurrence of an id, in the numbering of ``shard_documents``: by select, without decoding."""

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                matrix = WaveletMatrix.from_bytes(row.wavelet)
                places = [row.start_in_part + matrix.select(token, k) for k in range(matrix.rank(token))]
                yield pd.DataFrame({"part": row.part, "place": np.array(places, np.int64)})

    found = shards.select("part", "start_in_part", "wavelet").mapInPandas(find, "part int, place long")
    return _with_starts(found, shards, "place").select((F.col("part_start") + F.col("place")).alias("start"))


def count_token(shards: DataFrame, token: int) -> DataFrame:
    """Occurrences of an id per shard: by rank, without decoding."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            n = [WaveletMatrix.from_bytes(w).rank(token) for w in batch["wavelet"]]
            yield pd.DataFrame({"part": batch["part"], "shard": batch["shard"], "n": n})

    return shards.select("part", "shard", "wavelet").mapInPandas(count, "part int, shard int, n long")


def encoded_documents(docs: DataFrame, tokenizer_path: str, end_id: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Write the shards to the shared folder and return their documents as read back."""
    return shard_documents(write_token_shards(docs, tokenizer_path, new_folder(docs.sparkSession, "shards"), end_id, key, text))
