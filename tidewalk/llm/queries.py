"""The registered queries over the text and vector tables: thin digests of the operators."""

from __future__ import annotations

import functools
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from . import additive, common, impact, langid, language_model, mixing, pieces, secrets, simhash, toxicity

TOKENIZER = public_tokenizers.path("piece_bpe_32k.model")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_documents(spark, sf_dir))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_documents(spark, sf_dir)).select("doc_id", "source", F.col("_block").alias("block"), F.col("_place").alias("place"))


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(secrets.scan(_documents(spark, sf_dir)))


def _every_fiftieth(vec_id: Column) -> Column:
    return vec_id % 50 == 0


def op4_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return impact.top_inner_products(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), _every_fiftieth)


def op5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trip(_documents(spark, sf_dir), pieces.read_model(TOKENIZER))


def op6_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.evaluate(_documents(spark, sf_dir))


def op7_additive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return additive.nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), _every_fiftieth)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cache is first filled from an eighth of the rows, as a run over an older table leaves it, then asked for all."""
    docs, model, cache = _documents(spark, sf_dir), pieces.read_model(TOKENIZER), common.table_path(spark, "token-counts")
    pieces.token_counts(docs.where(common.fold(F.col("doc_id"), 8) == 0), model, cache)
    return pieces.token_counts(docs, model, cache)


def op9_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.evaluate(_documents(spark, sf_dir))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.evaluate(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def _importable(query):
    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        common.importable(spark)
        return query(spark, sf_dir)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_simhash, op2_mixing, op3_secrets, op4_impact, op5_pieces, op6_langid, op7_additive, op8_token_counts, op9_language_model, op10_toxicity)
    return {f.__name__: _importable(f) for f in own}


_QUOTED = [x.replace("'", "''") for x in (secrets.ASSIGN, secrets.ACCESS, r"[0-9a-f]{32,}", r"[A-Za-z0-9+/_-]{24,}", secrets.PLACEHOLDER)]

_SECRETS = (
    """
with d as (select row_number() over () as uid, doc_id, coalesce(text, '') as t, coalesce(source, '') as src from documents),
m as ("""
    + " union all ".join(f"select uid, src, {k} as kind, string_split_regex(t, '{p}') as gaps, regexp_extract_all(t, '{p}') as hits from d" for k, p in enumerate(_QUOTED[:4]))
    + f"""),
x as (select uid, src, kind, gaps, hits, unnest(range(1, len(hits) + 1)) as n from m),
y as (select uid, src, kind, hits[n] as hit, sum(length(gaps[n]) + length(hits[n])) over (partition by uid, kind order by n)::bigint as e from x),
z as (select uid, src, kind, e - length(hit) as b, e, case when kind = 0 then regexp_extract(hit, '{_QUOTED[0]}', 2) else hit end as v from y),
l as (select *, regexp_matches(v, '[0-9]') and regexp_matches(v, '[A-Za-z]') and len(list_distinct(string_split(v, ''))) >= 10 and not regexp_matches(v, '{_QUOTED[4]}') as looks from z),
c as (select * from l where kind in (1, 2) or (kind = 0 and length(v) >= 8) or (kind = 3 and looks)),
o as (select v, count(distinct src) as owners from c group by v),
w as (select c.*, case when owners > 2 then 'example' when looks then 'live' else 'weak' end as verdict from c join o using (v)),
k as (select * from w where kind < 3 or (verdict = 'live' and not exists (select 1 from c as s where s.uid = w.uid and s.kind < 3 and s.e > w.b and s.b < w.e))),
g as (select uid, count(*) filter (kind = 0) as n0, count(*) filter (kind = 1) as n1, count(*) filter (kind = 2) as n2, count(*) filter (verdict = 'live') as live, count(*) filter (verdict = 'example') as example,
        string_agg(case when kind < 3 then ['assign', 'access', 'hex'][kind + 1] || ':' || b || ':' || e end, ',' order by b, kind, e) as base,
        string_agg(['assign', 'access', 'hex', 'owned'][kind + 1] || ':' || b || ':' || e, ',' order by b, kind, e) as spans from k group by uid)
select doc_id, coalesce(n0, 0) as n_assign, coalesce(n1, 0) as n_access, coalesce(n2, 0) as n_hex, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans,
  coalesce(live, 0) as n_live, coalesce(example, 0) as n_example from d left join g using (uid)"""
)

_IMPACT = """
with v as (select vec_id, list_transform(embedding, lambda x: floor(256*x::double)) as e from embeddings
           where embedding is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, c.vec_id, list_dot_product(q.e, c.e)::bigint as score from v q join v c on q.vec_id % 50 = 0 and c.vec_id <> q.vec_id),
r as (select query_id, row_number() over (partition by query_id order by score desc, vec_id)::int as rank, vec_id, score from s)
select * from r where rank <= 5"""


def oracle_sql() -> dict[str, str]:
    """SQL of those that SQL can express; the others are tested against brute force, the libraries or held-out rows."""
    return {"op3_secrets": _SECRETS, "op4_impact": _IMPACT}
