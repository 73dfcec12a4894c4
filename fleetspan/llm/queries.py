"""Queries of the corpus operators over whole tables, and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetspan.llm.collocations import collocations
from fleetspan.llm.decontaminate import contaminated
from fleetspan.llm.exact_dedup import exact_duplicates
from fleetspan.llm.hard_negatives import hard_negatives
from fleetspan.llm.language import identify_language
from fleetspan.llm.mixing import LEVELS, OTHER, WORD, MixTargets, mixing_decisions
from fleetspan.llm.pii import find_identifiers
from fleetspan.llm.simhash import simhash_components
from fleetspan.llm.substring_dedup import without_repeated_passages
from fleetspan.llm.token_count import token_counts, unigram_from_pieces
from fleetspan.llm.token_shards import encoded_documents
from fleetspan.llm.url_filter import TRACKING, Rule, canonical_url, judge_urls, url_host
from fleetspan.llm.warc import REVISIT_BYTES, warc_round_trip

# Production parameters.
COUNT_VOCABULARY = "piece_bpe_32k.model"
ENCODER = "word_bpe_49k.json"
END_ID = 2
MIX = MixTargets(
    source={f"src{k}": 1.0 for k in range(20)},
    lang={"en": 0.55, "fr": 0.16, "de": 0.16, "es": 0.13},
    topic={"license": 0.05, "code": 0.03, "prose": 0.92},
    terms={"license": ("license", "rights reserved"), "code": ("token", "api_key", "password")},
)
URL_RULES = [
    Rule("allow", "com", "/"), Rule("block", "example.com", "/en/"), Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"), Rule("block", "net", "/fr/"),
]
# The list of URLs: pages on hosts with these labels, and pages reported one by one (every fiftieth), so that the
# list is more than a pattern of hosts and other spellings of a reported address must meet it.
LISTED_HOSTS = r"(^|\.)(spam-farm|cheap-pills)\."
REPORTED_EVERY = 50

PHRASE_LEAST, PHRASES_A_LANG = 100, 2000
REPEAT_WORDS = 20

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
TWINS: dict[str, str] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


@query
def op1_token_counts(spark: SparkSession, d: str) -> DataFrame:
    return token_counts(table(spark, d, "documents"), unigram_from_pieces(public_tokenizers.path(COUNT_VOCABULARY)))


@query
def op2_mixing(spark: SparkSession, d: str) -> DataFrame:
    return mixing_decisions(table(spark, d, "documents"), MIX).withColumn("probability", F.round("probability", 6))


@query
def op3_pii(spark: SparkSession, d: str) -> DataFrame:
    found = find_identifiers(table(spark, d, "documents"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base_spans", 256).alias("base_sha256"), "spans", "n_added")


@query
def op4_warc(spark: SparkSession, d: str) -> DataFrame:
    return warc_round_trip(table(spark, d, "pages"))


@query
def op5_decontamination(spark: SparkSession, d: str) -> DataFrame:
    return contaminated(table(spark, d, "documents"), table(spark, d, "benchmark"))


@query
def op6_language(spark: SparkSession, d: str) -> DataFrame:
    return identify_language(table(spark, d, "documents"))


def listed_urls(pages: DataFrame) -> DataFrame:
    host = url_host(F.col("url"))
    chosen = host.rlike(LISTED_HOSTS) | (F.col("page_id") % REPORTED_EVERY == 0)
    return pages.where((host != "") & chosen).select(canonical_url(F.col("url")).alias("canonical"))


@query
def op7_url_filter(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "pages")
    return judge_urls(pages, listed_urls(pages), URL_RULES)


@query
def op8_simhash(spark: SparkSession, d: str) -> DataFrame:
    return simhash_components(table(spark, d, "documents"), shingle=4, distance=4)


@query
def op9_token_shards(spark: SparkSession, d: str) -> DataFrame:
    return encoded_documents(table(spark, d, "documents"), public_tokenizers.path(ENCODER), END_ID)


@query
def op10_exact_dedup(spark: SparkSession, d: str) -> DataFrame:
    return exact_duplicates(table(spark, d, "documents"))


@query
def op11_collocations(spark: SparkSession, d: str) -> DataFrame:
    return collocations(table(spark, d, "documents"), at_least=PHRASE_LEAST, top=PHRASES_A_LANG)


@query
def op12_substring_dedup(spark: SparkSession, d: str) -> DataFrame:
    cleaned = without_repeated_passages(table(spark, d, "documents"), window=REPEAT_WORDS)
    return cleaned.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@query
def op13_hard_negatives(spark: SparkSession, d: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, d, "embeddings"), label=moved)


def _mixing_twin(targets: MixTargets) -> str:
    names = dict(zip(LEVELS, ("source", "lang", "topic")))
    level = lambda c, shares: f"case when {c} in ({', '.join(repr(v) for v in shares)}) then {c} else '{OTHER}' end"
    topic = "case " + " ".join(
        f"when {' or '.join(f'contains(lower(coalesce(text, {chr(39) * 2})), {t!r})' for t in terms)} then {name!r}" for name, terms in targets.terms.items()
    ) + f" else {list(targets.topic)[-1]!r} end"
    sql = [
        f"m as (select doc_id, coalesce(doc_id::varchar, md5(coalesce(text, ''))) as name, {level('source', targets.source)} as mix_source, {level('lang', targets.lang)} as mix_lang, {topic} as mix_topic, "
        f"greatest(len(regexp_extract_all(coalesce(text, ''), '{WORD}')), 1) as tokens from documents)",
        f"c as (select {', '.join(LEVELS)}, sum(tokens)::bigint as n from m group by all)",
    ]
    goals = []
    for name, shares in zip(names, targets.dimensions()):
        total = sum(shares.values())
        other = f"(sum(case when {name} = '{OTHER}' then n else 0 end) over () / sum(n) over ())"
        cases = " ".join(f"when {value!r} then {share / total!r}::double" for value, share in shares.items())
        goals.append(f"case when {name} = '{OTHER}' then {other} else (case {name} {cases} end) * (1.0::double - {other}) end as {name}_goal")
    sql.append(f"w0 as (select *, n::double as w, {', '.join(goals)} from c)")
    step = 0
    for _ in range(targets.rounds):
        for name in names:
            sql.append(f"w{step + 1} as (select * replace (w * {name}_goal / sum(w) over (partition by {name}) as w) from w{step})")
            step += 1
    sql.append(f"r as (select {', '.join(LEVELS)}, (w / n) / max(w / n) over () as p from w{step})")
    draw = f"('0x' || substr(md5('{targets.seed}:' || name), 1, 8))::bigint / 4294967296.0::double"
    return (
        f"with {', '.join(sql)} select doc_id, {', '.join(LEVELS)}, tokens::bigint as tokens, round(p, 6) as probability, {draw} < p as kept "
        f"from m join r using ({', '.join(LEVELS)})"
    )


TWINS["op2_mixing"] = _mixing_twin(MIX)

TWINS["op4_warc"] = f"""
with p as (select page_id, strlen(coalesce(html, ''))::bigint as payload_bytes, sha256(coalesce(html, '')) as payload_digest from pages),
g as (select *, min(page_id) over (partition by payload_digest) as first_id from p)
select page_id, payload_bytes, payload_digest,
    case when payload_bytes >= {REVISIT_BYTES} and page_id > first_id then 'revisit' else 'response' end as record_type,
    case when payload_bytes >= {REVISIT_BYTES} and page_id > first_id then first_id end as refers_to
from g
"""


def _url_twin() -> str:
    fits = lambda r: f"(host = '{r.host}' or ends_with(host, '.{r.host}')) and starts_with(path, '{r.path}')"
    longest = sorted(URL_RULES, key=lambda r: -len(r.text))
    rule = " ".join(f"when {fits(r)} then '{r.text}'" for r in longest)
    ruled = " ".join(f"when {fits(r)} then '{r.verdict}'" for r in longest)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
with u as (select page_id, translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'), '{upper}', '{lower}') as host,
    regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') as path,
    regexp_extract(coalesce(url, ''), '^.*?://[^?#]*\\?([^#]*)', 1, 's') as parameters from pages),
k as (select *, list_sort(list_filter(string_split(parameters, '&'), lambda x: x <> '' and not regexp_matches(x, '{TRACKING}'))) as kept from u),
c as (select page_id, host, path, case {rule} end as rule, case {ruled} end as ruled,
    case when host <> '' then regexp_replace(host, '^www\\.', '') || regexp_replace(path, '/+$', '')
        || case when len(kept) > 0 then '?' || array_to_string(kept, '&') else '' end end as canonical from k),
listed as (select distinct canonical from c where host <> '' and (regexp_matches(host, '{LISTED_HOSTS}') or page_id % {REPORTED_EVERY} = 0))
select page_id, host, path, rule,
    coalesce(ruled, case when canonical in (select canonical from listed) then 'block' else 'allow' end) as verdict,
    coalesce(ruled is null and canonical in (select canonical from listed), false) as listed
from c
"""


TWINS["op7_url_filter"] = _url_twin()

TWINS["op10_exact_dedup"] = r"""
with t as (select doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) as text_sha256 from documents)
select doc_id, min(doc_id) over g as keep_id, count(*) over g as group_size,
    row_number() over (partition by text_sha256 order by doc_id nulls last) = 1 as kept, text_sha256
from t window g as (partition by text_sha256)
"""

TWINS["op11_collocations"] = rf"""
with d as (select coalesce(lang, 'und') as lang,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents),
p as (select lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) as piece from d),
w as (select lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') as ws from p),
g as (select lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i + k - 1], ' '))) as phrase
    from w, (select unnest([1, 2, 3, 4, 5]) as k) where len(ws) >= k),
f as (select lang, k, phrase, count(*) as f from g group by all),
n as (select lang, sum(f) as n from f where k = 1 group by lang),
c as (select lang, k, phrase, f as a, string_split(phrase, ' ') as ws from f where k >= 2 and f >= {PHRASE_LEAST}),
i as (select lang, k, a, s, m, array_to_string(ws[s:s + m - 1], ' ') as phrase
    from c, (select unnest([1, 2, 3, 4]) as s), (select unnest([2, 3, 4]) as m) where m < k and s + m - 1 <= k),
o as (select c.* from c where not exists (select 1 from i where i.lang = c.lang and i.phrase = c.phrase and 100 * i.a >= 100 * c.a)),
u as (select o.lang, o.phrase, o.a, cut, array_to_string(ws[1:cut], ' ') as head, array_to_string(ws[cut + 1:k], ' ') as rest
    from o, (select unnest([1, 2, 3, 4]) as cut) where cut < k),
x as (select u.lang, u.phrase, u.a, cut, h.f as l, r.f as r, n.n, (1000::hugeint * u.a * n.n) // (h.f::hugeint * r.f) as score
    from u join f h on h.lang = u.lang and h.phrase = u.head join f r on r.lang = u.lang and r.phrase = u.rest join n on n.lang = u.lang),
y as (select * from x qualify row_number() over (partition by lang, phrase order by score, cut) = 1)
select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a::bigint as a, l::bigint as l, r::bigint as r,
    n::bigint as n, score::bigint as score
from y qualify rank <= {PHRASES_A_LANG}
"""

TWINS["op12_substring_dedup"] = rf"""
with w as (select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from documents),
s as (select doc_id, unnest(range(1, len(ws) - {REPEAT_WORDS - 2})) as i, ws from w where len(ws) >= {REPEAT_WORDS}),
k as (select doc_id, i, array_to_string(ws[i:i + {REPEAT_WORDS - 1}], ' ') as words from s),
r as (select doc_id, i from k qualify row_number() over (partition by words order by doc_id, i) > 1),
c as (select distinct doc_id, unnest(range(i, i + {REPEAT_WORDS})) as j from r),
a as (select doc_id, unnest(ws) as word, generate_subscripts(ws, 1) as j from w),
h as (select doc_id, string_agg(word, ' ' order by j) as kept, count(*) as n from a anti join c using (doc_id, j) group by doc_id)
select doc_id, len(ws)::bigint as n_words, (len(ws) - coalesce(n, 0))::bigint as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from w left join h using (doc_id)
"""

TWINS["op13_hard_negatives"] = """
with e as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    list_transform(embedding, lambda x: floor(256 * x::double)) as v from embeddings
    where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.vec_id as anchor_id, b.vec_id as other, a.label = b.label as same, list_inner_product(a.v, b.v)::bigint as score
    from e a, e b where a.vec_id % 100 = 0 and a.vec_id <> b.vec_id),
p as (select anchor_id, other as positive_id, score as positive_score from s where same
    qualify row_number() over (partition by anchor_id order by score desc, other) <= 5)
select anchor_id, positive_id, (row_number() over (partition by anchor_id, positive_id order by score desc, other))::integer as rank,
    other as negative_id, positive_score, score as negative_score
from p join s using (anchor_id) where not same and 30 * positive_score <= 100 * score and 100 * score <= 90 * positive_score
qualify rank <= 10
"""
