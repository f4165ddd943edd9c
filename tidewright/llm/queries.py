"""Driver queries of the training-data operators, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

import string

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, html_extraction, line_dedup, media_copies, ngram_jaccard_join, quality_classifier, sharding, source_mixing, suffix_dedup, url_filter

# The rule list of the URL filter query (verdict, host, path).
URL_RULES = [
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark, sf_dir):
    report = decontamination.contamination_report(
        _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")
    )
    return report.drop("hit_words")


def op2_sharding(spark, sf_dir):
    return sharding.assign_shards(_table(spark, sf_dir, "documents")).drop("bucket")


def op3_media_copies(spark, sf_dir):
    return media_copies.image_copies(media_copies.pictures(_table(spark, sf_dir, "embeddings"), "vec_id", "embedding"))


def op4_source_mixing(spark, sf_dir):
    return source_mixing.sample_mix(_table(spark, sf_dir, "documents")).withColumn(
        "probability", F.round("probability", 6)
    )


def op5_url_filter(spark, sf_dir):
    rules = spark.createDataFrame(URL_RULES, "verdict string, host string, path string")
    return url_filter.url_verdicts(_table(spark, sf_dir, "pages"), rules)


def op6_line_dedup(spark, sf_dir):
    return line_dedup.line_dedup_counts(_table(spark, sf_dir, "documents"), min_bytes=0)


def op7_ngram_jaccard(spark, sf_dir):
    return ngram_jaccard_join.ngram_jaccard_groups(_table(spark, sf_dir, "documents")).drop("set_id")


def op8_suffix_dedup(spark, sf_dir):
    return suffix_dedup.remove_repeats(_table(spark, sf_dir, "documents"), texts=False)


HELD_OUT = "pmod(crc32(cast(cast(doc_id as string) as binary)), 3) = 1"


def fitted_quality(spark, docs, sf_dir):
    return quality_classifier.train(docs, _table(spark, sf_dir, "labels"), learn_from=F.expr(f"not ({HELD_OUT})"))


def op9_quality(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents")
    scored = quality_classifier.score(docs, fitted_quality(spark, docs, sf_dir))
    return scored.select(
        "doc_id",
        F.coalesce(F.expr(HELD_OUT), F.lit(False)).alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"),
    )


def op10_html_text(spark, sf_dir):
    return html_extraction.extract_main_text(_table(spark, sf_dir, "pages"))


QUERIES = {
    f.__name__: f for f in (
        op1_decontamination,
        op2_sharding,
        op3_media_copies,
        op4_source_mixing,
        op5_url_filter,
        op6_line_dedup,
        op7_ngram_jaccard,
        op8_suffix_dedup,
        op9_quality,
        op10_html_text,
    )
}

_LOWER = f"translate({{}}, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
_WORDS = rf"regexp_extract_all({_LOWER.format('coalesce(text, chr(0))')}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP1_SQL = rf"""
with d as (select doc_id, {_WORDS} as w from documents),
b as (select item_id, {_WORDS} as w from benchmark),
bw as (select item_id, least(13, len(w)) as n, w, unnest(generate_series(1, len(w) - least(13, len(w)) + 1)) as i from b where len(w) > 0),
grams as (select distinct item_id, n, list_aggregate(list_slice(w, i, i + n - 1), 'string_agg', ' ') as gram from bw),
sizes as (select distinct n from grams),
dw as (select doc_id, n, w, unnest(generate_series(1, len(w) - n + 1)) as i from d, sizes where len(w) >= n),
met as (select doc_id, i, g.n, item_id from dw join grams g on g.n = dw.n and list_aggregate(list_slice(w, i, i + dw.n - 1), 'string_agg', ' ') = g.gram),
hit as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(generate_series(i, i + n - 1)) as p from met) group by doc_id),
items as (select doc_id, count(*) as n_items, sha256(string_agg(item, ',' order by item)) as s from (select distinct doc_id, cast(item_id as varchar) as item from met) group by doc_id)
select d.doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items,
 coalesce(s, sha256('')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from d left join hit using (doc_id) left join items using (doc_id)
"""


def _op4_sql(rounds: int = 30, moves: int = 2) -> str:
    """Raking as a chain of window sums, far past convergence."""
    names, kinds = list(source_mixing.SHAPES), range(len(source_mixing.SHAPES))

    shares = ", ".join(
        f"(length(text) - length(regexp_replace(text, '{p}', '', 'g'))) / greatest(length(text), 1) as s{k}" for k, p in enumerate(source_mixing.SHAPES.values())
    )

    def best(scores: list[str]) -> str:
        return "case " + " ".join(
            f"when {scores[k]} = greatest({', '.join(scores)}) then '{names[k]}'" for k in kinds
        ) + " end"

    parts = [
        f"d as (select doc_id, coalesce(source, '?') as source, coalesce(lang, '?') as language, cast(case when text = '' then 0 else length(text) - length(regexp_replace(text, '{source_mixing.SHAPES["blanks"]}', '', 'g')) + 1 end as bigint) as tokens, {shares} from (select doc_id, source, lang, coalesce(text, '') as text from documents))",
        "spread as (select " + ", ".join(f"round(avg(s{k}), 9) as m{k}, round(stddev_pop(s{k}), 9) as d{k}" for k in kinds) + " from d)",
        "z as (select doc_id, source, language, tokens, " + ", ".join(f"case when d{k} > 0 then (s{k} - m{k}) / d{k} else 0e0 end as z{k}" for k in kinds) + " from d, spread)",
        f"t0 as (select *, {best([f'z{k}' for k in kinds])} as topic from z)",
    ]
    for r in range(moves):
        parts.append(
            f"c{r} as (select topic, " + ", ".join(
                f"round(avg(z{k}), 9) as c{k}" for k in kinds
            ) + f" from t{r} group by topic)"
        )
        wide = ", ".join(f"max(case when topic = '{n}' then c{k} end) as {n}{k}" for n in names for k in kinds)
        parts.append(f"w{r} as (select {wide} from c{r})")
        far = [
            f"coalesce(-({' + '.join(f'pow(z{k} - {n}{k}, 2)' for k in kinds)}), '-infinity'::double)" for n in names
        ]
        parts.append(f"t{r + 1} as (select z.*, {best(far)} as topic from z, w{r})")
    parts += [
        f"c as (select source, language, topic, cast(sum(tokens) as bigint) as tokens, cast(sum(tokens) as double) as fitted from t{moves} group by all)",
        "whole as (select cast(sum(tokens) as double) as everything from c)",
    ]
    for m, t in source_mixing.TEMPER.items():
        parts.append(
            f"p_{m} as (select {m}, pow(sum(tokens) / everything, {t}e0) as part from c, whole group by {m}, everything)"
        )
        parts.append(
            f"g_{m} as (select {m}, part / (select sum(part) from p_{m}) * everything as goal from p_{m}, whole)"
        )
    last = "c"
    for k in range(rounds):
        for m in source_mixing.TEMPER:
            parts.append(
                f"{m}_{k} as materialized (select source, language, topic, tokens, case when sum(fitted) over (partition by {m}) > 0 then fitted * (goal / sum(fitted) over (partition by {m})) else 0 end as fitted from {last} join g_{m} using ({m}))"
            )
            last = f"{m}_{k}"
    parts.append(f"r as (select *, case when tokens > 0 then fitted / tokens end as rate from {last})")
    parts.append(
        "q as (select source, language, topic, coalesce(least(1e0, rate * (1e0 / max(rate) over ())), 1e0) as probability from r)"
    )
    kept = "cast(concat('0x', substr(md5(concat('11:', coalesce(cast(doc_id as varchar), ''))), 1, 8)) as bigint) / 4294967296e0 < probability"
    return "with " + ",\n".join(
        parts
    ) + f"\nselect doc_id, source, language, topic, t{moves}.tokens, round(probability, 6) as probability, {kept} as kept from t{moves} join q using (source, language, topic)"


OP5_SQL = (
    "with rules(verdict, host, path) as (values "
    + ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in URL_RULES)
    + rf"""),
r as (select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
u as (select page_id, {_LOWER.format("regexp_extract(rest, '^[^/?#]*', 0)")} as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from r),
m as (select page_id, x.host || x.path as rule, verdict, row_number() over (partition by page_id order by length(x.host || x.path) desc, length(x.host) desc, verdict desc) as k
 from u join rules x on (u.host = x.host or suffix(u.host, '.' || x.host)) and starts_with(u.path, x.path))
select u.page_id, u.host, u.path, m.rule, coalesce(m.verdict, 'allow') as verdict from u left join m on m.page_id = u.page_id and m.k = 1"""
)

OP7_SQL = rf"""
with recursive d as (select doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '[^\x20\x09-\x0D]+') as w from documents),
s as (select distinct doc_id, sh from (select doc_id, unnest(case when len(w) = 0 then [] when len(w) < 3 then [list_aggregate(w, 'string_agg', ' ')] else list_transform(generate_series(1, len(w) - 2), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) end) as sh from d)),
n as (select d.doc_id, count(sh) as n from d left join s using (doc_id) group by d.doc_id),
p as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.sh = b.sh and a.doc_id < b.doc_id group by all),
l as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 90 * (x.n + y.n - c)),
e as (select a, b from l union select b, a from l),
reach(id, spot) as (select doc_id, doc_id from n union select id, b from reach join e on spot = a)
select n.doc_id, cast(n.n as bigint) as n_shingles, min(spot) as component_id from n join reach on id = n.doc_id group by n.doc_id, n.n
"""

SQL = {
    "op1_decontamination": OP1_SQL,
    "op4_source_mixing": _op4_sql(),
    "op5_url_filter": OP5_SQL,
    "op7_ngram_jaccard": OP7_SQL,
}
