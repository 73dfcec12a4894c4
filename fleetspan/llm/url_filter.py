"""URL filtering: rules by host and path, then a blocked Bloom filter over listed URLs, then an exact join.

The filter is a table of 512-bit blocks, built by one aggregate and bounded in
size whatever the list. It lets through every listed URL and a few others; what
it lets through is joined with the list itself, which removes the false ones.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetspan.operators.sizing import join_dimension, settle, written_table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORDS = 8  # of 64 bits in a block
PROBES = 6
BITS_PER_URL = 16
MAX_BLOCKS = 1 << 19  # 32 MB; a longer list fills the blocks further, which costs false hits but no true one
TRACKING = r"^(utm_[^=]*|ref)(=|$)"  # query parameters that do not name the page


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


def url_host(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z in lower case; else empty."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """After the host up to ?, # or the end; else empty."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def url_query(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^?#]*\?([^#]*)", 1)


def canonical_url(url: Column) -> Column:
    """Host without www., path without closing slashes, other parameters in order; no scheme, tracking or fragment."""
    host = F.regexp_replace(url_host(url), r"^www\.", "")
    path = F.regexp_replace(url_path(url), r"/+$", "")
    kept = F.array_sort(F.filter(F.split(url_query(url), "&"), lambda p: (p != "") & ~p.rlike(TRACKING)))
    return F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(F.lit("")))


def rule_of(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits the host or a parent of it and begins the path; else null."""
    text = verdict = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.text), r.text)):  # the longest is asked first
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        text = F.when(fits, F.lit(rule.text)).otherwise(text)
        verdict = F.when(fits, F.lit(rule.verdict)).otherwise(verdict)
    return text, verdict


def _block(url: str, blocks: int) -> Column:
    return F.pmod(F.xxhash64(F.col(url), F.lit(1)), F.lit(blocks))


def _places(url: str) -> list[Column]:
    """Bits of a URL within its block."""
    h = F.xxhash64(F.col(url), F.lit(2))
    return [F.shiftrightunsigned(h, 9 * k).bitwiseAND(F.lit(64 * WORDS - 1)).cast("int") for k in range(PROBES)]


def _bit(place: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(F.lit(63)))


def bloom_blocks(listed: DataFrame, url: str, blocks: int) -> DataFrame:
    """(block, words): the blocked Bloom filter of the listed URLs; at most ``blocks`` rows of eight words."""
    masks = []
    for w in range(WORDS):
        mask = F.lit(0).cast("long")
        for place in _places(url):
            own = F.shiftright(place, 6) == w
            mask = mask.bitwiseOR(F.when(own, _bit(place)).otherwise(F.lit(0).cast("long")))
        masks.append(F.bit_or(mask).alias(f"w{w}"))
    return listed.groupBy(_block(url, blocks).alias("block")).agg(*masks).select("block", F.array(*[f"w{w}" for w in range(WORDS)]).alias("words"))


def mark_maybe(urls: DataFrame, url: str, filter_table: DataFrame, blocks: int) -> DataFrame:
    """Add ``maybe``: does the URL pass the filter? The table is broadcast, its size is bounded, so the rows stay where they are."""
    hit = F.lit(True)
    for place in _places(url):
        word = F.element_at("words", F.shiftright(place, 6) + 1)
        hit = hit & (word.bitwiseAND(_bit(place)) != 0)
    joined = urls.withColumn("block", _block(url, blocks)).join(F.broadcast(filter_table), "block", "left")
    return joined.withColumn("maybe", F.coalesce(hit, F.lit(False)) & F.col(url).isNotNull()).drop("block", "words")


def may_be_listed(urls: DataFrame, url: str, filter_table: DataFrame, blocks: int) -> DataFrame:
    """Rows whose URL passes the filter."""
    return mark_maybe(urls, url, filter_table, blocks).where("maybe").drop("maybe")


def judge_urls(pages: DataFrame, listed: DataFrame, rules: list[Rule], key: str = "page_id", url: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict and ``listed`` of every row.

    ``listed`` has a column ``canonical``. A rule decides where one fits; otherwise
    a listed URL is blocked and any other allowed. A null URL, or one without ://,
    has an empty host and path, fits no rule, is never listed and so is allowed.
    Repeated rows give equal rows; an empty list or table is no special case. Only
    rows that pass the filter are joined with the list, which is measured; where it is
    large, adaptive execution splits a hot URL, as it meets a single row. URLs may be of any
    length. Other columns of ``pages`` play no part.
    """
    address = F.col(url)
    judged = pages.select(
        F.col(key).alias("page_id"), url_host(address).alias("host"), url_path(address).alias("path"),
        F.when(url_host(address) != "", canonical_url(address)).alias("canonical"),
    )
    rule, ruled = rule_of(F.col("host"), F.col("path"), rules)
    judged = judged.withColumns({"rule": rule, "ruled": ruled})
    listing = listed.select("canonical").where("canonical is not null").distinct().select(F.col("canonical").alias("entry"))
    (entries,) = settle(listing)
    blocks = min(MAX_BLOCKS, 1 + entries.n_rows * BITS_PER_URL // (64 * WORDS))
    table = written_table(bloom_blocks(entries.table, "entry", blocks))
    # A ruled URL is not looked up.
    asked = judged.withColumn("asked", F.when(F.col("ruled").isNull(), F.col("canonical"))).drop("canonical")
    marked = written_table(mark_maybe(asked, "asked", table, blocks))
    others = marked.where("not maybe").withColumn("listed", F.lit(False))
    checked = join_dimension(marked.where("maybe"), entries, [("asked", "entry")], spread_by="page_id")
    settled = others.unionByName(checked.withColumn("listed", F.col("entry").isNotNull()).drop("entry"))
    return settled.select(
        "page_id", "host", "path", "rule",
        F.coalesce("ruled", F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"), "listed",
    )
