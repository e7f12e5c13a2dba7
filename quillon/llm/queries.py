"""The queries of this subpackage, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillon.llm import gru_lm
from quillon.llm.bpe import bpe_encode
from quillon.llm.decontaminate import contamination
from quillon.llm.hnsw_dedup import near_duplicates
from quillon.llm.html_extract import extract_html
from quillon.llm.langid import identify, train
from quillon.llm.ngram_join import near_duplicate_classes
from quillon.llm.suffix_dedup import repeated_passages
from quillon.llm.toxicity import learn, toxicity
from quillon.llm.url_filter import oracle_sql as url_filter_sql
from quillon.llm.url_filter import rules_table, url_filter


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return gru_lm.lm_score(docs, *gru_lm.train(docs))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_encode(_table(spark, sf_dir, "documents"))


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return identify(docs, train(docs))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), width=8)


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_classes(_table(spark, sf_dir, "documents"), n=3, threshold=0.5)


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(_table(spark, sf_dir, "pages"), rules_table(spark))


def op2_hnsw_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "embeddings"), threshold=0.9)


def op3_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_html(_table(spark, sf_dir, "pages"), min_words=8)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity(docs, learn(docs, _table(spark, sf_dir, "labels")))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(_table(spark, sf_dir, "documents"), min_words=50)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filter": op1_url_filter,
    "op2_hnsw_dedup": op2_hnsw_dedup,
    "op3_html_extract": op3_html_extract,
    "op4_toxicity": op4_toxicity,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_lm_score": op6_lm_score,
    "op7_bpe": op7_bpe,
    "op8_langid": op8_langid,
    "op9_decontaminate": op9_decontaminate,
    "op10_ngram_join": op10_ngram_join,
}

_WORDS = r"""words as (
  select doc_id, list_transform(regexp_extract_all(text, '[A-Za-z0-9\x{80}-\x{10FFFF}]+'), lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) as w
  from documents where doc_id is not null and text is not null)"""

_PASSAGES = f"""
with {_WORDS},
places as (select doc_id, w, unnest(range(1, len(w) - 48)) as k from words where len(w) >= 50),
windows as (select doc_id, k, min(doc_id) over (partition by array_to_string(w[k:k + 49], ' ')) as first_doc from places),
runs as (select doc_id, first_doc, k, k - row_number() over (partition by doc_id, first_doc order by k) as run from windows where first_doc <> doc_id)
select doc_id, first_doc, cast(min(k) - 1 as int) as start_word, cast(count(*) + 49 as int) as n_words from runs group by doc_id, first_doc, run
"""

_CLASSES = f"""
with recursive {_WORDS},
sets as (
  select doc_id, list_sort(list_distinct(case when len(w) < 3 then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) end)) as s
  from words where len(w) > 0),
heads as (select s, row_number() over () as h, min(doc_id) as doc_id, count(distinct doc_id) as m, len(s) as n from sets group by s),
grams as (select h, n, unnest(s) as g from heads),
shared as (select a.h as a, b.h as b, count(*)::double / (a.n + b.n - count(*))::double as j from grams a join grams b on a.g = b.g and a.h <> b.h group by a.h, b.h, a.n, b.n),
near as (select a, b, j from shared where j >= 0.5),
linked as (select h, m - 1 + coalesce(sum(o), 0) as links, greatest(case when m > 1 then 1.0 else 0.0 end, coalesce(max(j), 0)) as best from (select h.h, h.m, o.m as o, j from heads h left join near on a = h.h left join heads o on o.h = b) group by h, m having links > 0),
reach(h, r) as (select h, h from linked union select reach.h, near.b from reach join near on near.a = reach.r),
classes as (select reach.h, min(doc_id) as class_id from reach join heads on heads.h = r group by reach.h)
select distinct s.doc_id, c.class_id, l.links::bigint as n_links, l.best::double as jaccard from sets s join heads h on h.s = s.s join linked l on l.h = h.h join classes c on c.h = h.h
"""

_NEAR = """
with recursive v as (select vec_id as id, min(embedding::double[]) as v from embeddings where vec_id is not null and len(embedding) > 0 group by vec_id),
near as (select a.id as a, b.id as b, list_cosine_similarity(a.v, b.v) as c from v a join v b on a.id <> b.id where list_cosine_similarity(a.v, b.v) >= 0.9),
reach(id, r) as (select distinct a, a from near union select reach.id, near.b from reach join near on near.a = reach.r),
groups as (select id, min(r) as group_id from reach group by id),
ranked as (select *, row_number() over (partition by a order by c desc, b) as place, count(*) over (partition by a) as n from near)
select a as vec_id, group_id, b as nearest_id, round(c, 6) as cosine, n as n_links from ranked join groups on id = a where place = 1
"""

ORACLE_SQL: dict[str, str] = {
    "op2_hnsw_dedup": _NEAR,
    "op1_url_filter": url_filter_sql(),
    "op5_suffix_dedup": _PASSAGES,
    "op10_ngram_join": _CLASSES,
}
