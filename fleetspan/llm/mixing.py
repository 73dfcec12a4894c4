"""Mixing sources to target weights: raking (iterative proportional fitting) in DataFrame operations.

Token weights are summed into cells (source, language, topic). The values that
have a target form one level each and all others one level together, so there
are at most (sources + 1) x (languages + 1) x (topics + 1) cells whatever the
data are. They become one row of arrays, and the rounds of raking are one fold
over that row. Each document is then kept with the calibrated probability of its
cell. One scan of the texts gives a narrow table with what cells and decisions need.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fleetspan.operators.sizing import written_table

OTHER = "(other)"
LEVELS = ("mix_source", "mix_lang", "mix_topic")
WORD = r"[^\x20\x09-\x0D]+"
WHITE = "\t\n\x0b\x0c\r "


@dataclass(frozen=True)
class MixTargets:
    """Shares of tokens by level; shares of one dimension are scaled to what the other level leaves."""

    source: dict[str, float]
    lang: dict[str, float]
    topic: dict[str, float]
    # A text belongs to the first topic one of whose terms occurs in it (lower case), else to the last topic.
    terms: dict[str, tuple[str, ...]] = field(default_factory=dict)
    rounds: int = 20
    seed: int = 42

    def dimensions(self) -> tuple[dict[str, float], ...]:
        return self.source, self.lang, self.topic


def topic_of(text: str, targets: MixTargets) -> Column:
    lower = F.lower(F.coalesce(F.col(text), F.lit("")))
    out = F.lit(list(targets.topic)[-1])
    for topic, terms in reversed(targets.terms.items()):
        hit = None
        for term in terms:
            hit = lower.contains(term) if hit is None else hit | lower.contains(term)
        out = F.when(hit, F.lit(topic)).otherwise(out)
    return out


def _level(value: Column, shares: dict[str, float]) -> Column:
    return F.when(value.isin(list(shares)), value).otherwise(F.lit(OTHER))


def level_columns(targets: MixTargets, text: str = "text", source: str = "source", lang: str = "lang") -> dict[str, Column]:
    return {
        "mix_source": _level(F.col(source), targets.source),
        "mix_lang": _level(F.col(lang), targets.lang),
        "mix_topic": topic_of(text, targets),
    }


def token_weight(text: str = "text") -> Column:
    """Words of the text; an empty or null text weighs one, so that every cell has a weight."""
    # Words are the gaps between single blanks and one; no array of words is built.
    spaced = F.btrim(F.translate(F.coalesce(F.col(text), F.lit("")), WHITE, " " * len(WHITE)))
    single = F.regexp_replace(spaced, " +", " ")
    return (F.octet_length(single) - F.octet_length(F.replace(single, F.lit(" "))) + 1).cast("long")


def _targets(cells: DataFrame, targets: MixTargets) -> DataFrame:
    """One row: the cells (``c``) in order, and per dimension each cell's level number and the goal of every level.

    The other level of a dimension keeps its natural share; levels without documents
    have no cells and play no part.
    """
    row = cells.agg(F.array_sort(F.collect_list(F.struct(*LEVELS, "mix_tokens"))).alias("c"))  # one row per combination of target levels
    tokens = F.transform("c", lambda x: x["mix_tokens"].cast("double"))
    places, goals = [], []
    for level, shares in zip(LEVELS, targets.dimensions()):
        listed = F.array(*[F.lit(v) for v in (*shares, OTHER)])
        places.append(F.transform("c", lambda x: F.array_position(listed, x[level]).cast("int")))
        own = F.aggregate(F.filter("c", lambda x: x[level] == OTHER), F.lit(0.0), lambda a, x: a + x["mix_tokens"])
        other = own / F.aggregate(tokens, F.lit(0.0), lambda a, x: a + x)
        total = sum(shares.values())
        goals.append(F.array(*[F.lit(share / total) * (F.lit(1.0) - other) for share in shares.values()], other))
    # A written row: the fold that follows reads its arrays and computes none of them again.
    return written_table(row.where(F.size("c") > 0).select("c", tokens.alias("tokens"), F.array(*places).alias("places"), F.array(*goals).alias("goals")))


def _pairs(left: Column, right: Column) -> Column:
    return F.zip_with(left, right, lambda a, b: F.named_struct(F.lit("a"), a, F.lit("b"), b))


def _margins(weights: Column, places: Column) -> Column:
    """Sums of the weights by level number."""
    pairs = _pairs(weights, places)
    levels = F.sequence(F.lit(1), F.array_max(places))
    return F.transform(levels, lambda k: F.aggregate(F.filter(pairs, lambda x: x["b"] == k), F.lit(0.0), lambda a, x: a + x["a"]))


def rake(cells: DataFrame, targets: MixTargets) -> DataFrame:
    """The cells with ``mix_weight``: their tokens raked to the marginals in turn, for a fixed number of rounds.

    ``mix_residual`` is the largest difference between a marginal and its goal that is
    left, as a share. It stays large where targets cannot be met because cells are
    empty, and where fewer rounds were made than needed.
    """

    def both(weights: Column, margins: Column) -> Column:
        return F.named_struct(F.lit("w"), weights, F.lit("m"), margins)

    def step(state: Column, turn: Column) -> Column:
        """Turns come in pairs: first the margins of a dimension, then the weights that follow from them."""
        at = F.pmod(F.floor(turn / 2), F.lit(len(LEVELS))).cast("int") + 1
        place, goal = F.element_at("places", at), F.element_at("goals", at)
        scaled = F.zip_with(state["w"], place, lambda w, p: w * F.element_at(goal, p) / F.element_at(state["m"], p))
        return F.when(F.pmod(turn, F.lit(2)) == 0, both(state["w"], _margins(state["w"], place))).otherwise(both(scaled, state["m"]))

    turns = F.sequence(F.lit(0), F.lit(2 * len(LEVELS) * targets.rounds - 1))
    first = both(F.col("tokens"), F.array(F.lit(0.0)))
    raked = written_table(_targets(cells, targets).select("*", F.aggregate(turns, first, step, lambda x: x["w"]).alias("weights")))
    whole = F.aggregate("weights", F.lit(0.0), lambda a, x: a + x)

    def distance(k: int) -> Column:
        met = _pairs(_margins(F.col("weights"), F.element_at("places", k)), F.element_at("goals", k))
        return F.aggregate(F.filter(met, lambda x: x["a"] > 0), F.lit(0.0), lambda a, x: F.greatest(a, F.abs(x["a"] / whole - x["b"])))

    residual = reduce(F.greatest, [distance(k + 1) for k in range(len(LEVELS))])
    rows = _pairs(F.col("c"), F.col("weights"))
    out = raked.select(residual.alias("mix_residual"), F.explode(rows).alias("r"))
    return out.select(*[F.col(f"r.a.{n}").alias(n) for n in (*LEVELS, "mix_tokens")], F.col("r.b").alias("mix_weight"), "mix_residual")


def _cells(marked: DataFrame, targets: MixTargets) -> DataFrame:
    cells = marked.groupBy(*LEVELS).agg(F.sum("mix_tokens").alias("mix_tokens"))
    raked = written_table(rake(cells, targets).withColumn("mix_rate", F.col("mix_weight") / F.col("mix_tokens")))
    top = raked.agg(F.max("mix_rate")).scalar()
    return written_table(raked.select(*LEVELS, "mix_tokens", "mix_weight", "mix_residual", (F.col("mix_rate") / top).alias("mix_probability")))


def cell_rates(docs: DataFrame, targets: MixTargets, text: str = "text", source: str = "source", lang: str = "lang") -> DataFrame:
    """One row per cell with its probability: the largest rate is one, so the mix is met without repeating documents."""
    levels = level_columns(targets, text, source, lang)
    return _cells(docs.select(token_weight(text).alias("mix_tokens"), *[c.alias(n) for n, c in levels.items()]), targets)


def draw(key: str, seed: int, text: str = "text") -> Column:
    """A number in [0, 1) from a hash of the key, of the text where there is no key: the same on every run and engine."""
    name = F.coalesce(F.col(key).cast("string"), F.md5(F.coalesce(F.col(text), F.lit(""))))
    digest = F.md5(F.concat(F.lit(f"{seed}:"), name))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") / F.lit(float(1 << 32))


def mixing_decisions(
    docs: DataFrame, targets: MixTargets, key: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang"
) -> DataFrame:
    """One row per document: key, levels, tokens, probability and ``kept``.

    Null sources and languages are on the other level, null and empty texts weigh
    one token. Repeated rows of a key get the same decision; a row without a key is
    drawn by its text. Other columns of ``docs`` play no part; an empty table gives an
    empty result.
    """
    marked = written_table(
        docs.select(
            F.col(key).alias("doc_id"), draw(key, targets.seed, text).alias("drawn"), token_weight(text).alias("mix_tokens"),
            *[c.alias(n) for n, c in level_columns(targets, text, source, lang).items()],
        )
    )
    # As many rows as there are cells: bounded by the targets.
    rates = _cells(marked, targets).select(*LEVELS, "mix_probability")
    return marked.join(F.broadcast(rates), list(LEVELS)).select(
        "doc_id", *LEVELS, F.col("mix_tokens").alias("tokens"), F.col("mix_probability").alias("probability"),
        (F.col("drawn") < F.col("mix_probability")).alias("kept"),
    )


def mixed_sample(
    docs: DataFrame, targets: MixTargets, key: str = "doc_id", text: str = "text", source: str = "source", lang: str = "lang"
) -> DataFrame:
    """The sampled documents with their own columns only; same rules as ``mixing_decisions``."""
    inner = [f"__mix_{n}" for n in range(3)]
    rates = cell_rates(docs, targets, text, source, lang).select(
        *[F.col(n).alias(i) for n, i in zip(LEVELS, inner)], F.col("mix_probability").alias("__mix_p")
    )
    levels = level_columns(targets, text, source, lang)
    marked = docs.withColumns({i: levels[n] for n, i in zip(LEVELS, inner)})
    return marked.join(F.broadcast(rates), inner).where(draw(key, targets.seed, text) < F.col("__mix_p")).select(*docs.columns)
