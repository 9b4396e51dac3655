"""Queries of the ten operators, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, chat_format, decontaminate, knn, near_dedup, quality, token_files, toxicity, url_filter
from .shared import table
from .substring_dedup import remove_repeats


URL_RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.top_k(table(spark, sf_dir, "embeddings"), "vec_id % 50 = 0")


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digests(decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_path("byte_bpe_50k.json")
    return bpe.digests(bpe.encode(table(spark, sf_dir, "documents"), path), path)


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), url_filter.rule_table(spark, URL_RULES))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.write_and_read(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.render(table(spark, sf_dir, "conversations"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), digest=True)


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.select(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_knn, op2_near_dedup, op3_decontamination, op4_bpe, op5_url_filter, op6_toxicity, op7_token_files, op8_chat_format, op9_substring_dedup, op10_quality)}


SQL = {
    "op1_knn": """
with v as (select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as e from embeddings
  where embedding is not null and vec_id is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, x.vec_id as vec_id, cast(list_sum(list_transform(list_zip(q.e, x.e), lambda p: p[1] * p[2])) as bigint) as score
  from v q join v x on x.vec_id <> q.vec_id where q.vec_id % 50 = 0),
r as (select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank, vec_id, score from s)
select * from r where rank <= 5
""",
    "op2_near_dedup": r"""
with recursive w as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as words from documents),
s as (select distinct doc_id, unnest(case when len(words) = 0 then [] when len(words) < 3 then [array_to_string(words, ' ')] else list_transform(range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2]) end) as shingle from w),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as a, b.doc_id as b, count(*) as both from s a join s b on a.shingle = b.shingle and a.doc_id < b.doc_id group by 1, 2),
l as (select p.a, p.b from p join n x on x.doc_id = p.a join n y on y.doc_id = p.b where 100 * p.both >= 85 * (x.n + y.n - p.both)),
e as (select a, b from l union select b, a from l),
reach as (select doc_id as a, doc_id as b from documents union select reach.a, e.b from reach join e on e.a = reach.b),
c as (select a as doc_id, min(b) as component_id from reach group by a)
select d.doc_id, cast(coalesce(n.n, 0) as bigint) as n_shingles, c.component_id, d.doc_id = c.component_id as kept, coalesce(k.class_id, d.doc_id) as class_id
from documents d join c on c.doc_id = d.doc_id left join n on n.doc_id = d.doc_id
left join (select doc_id, min(doc_id) over (partition by shingles) as class_id from (select doc_id, list_sort(list(shingle)) as shingles from s group by doc_id)) k on k.doc_id = d.doc_id
""",
    "op3_decontamination": r"""
with dw as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words from documents),
bw as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words from benchmark),
win as (select item_id, least(10, len(words)) as size, unnest(range(1, greatest(2, len(words) - 8))) as j, unnest(list_transform(range(1, greatest(2, len(words) - 8)), lambda i: array_to_string(words[i:i + 9], ' '))) as w from bw where len(words) > 0),
pos as (select doc_id, size, unnest(range(1, len(words) - size + 2)) as i, words from dw, (select distinct size from win) z where len(words) >= size),
occ as (select pos.doc_id, pos.i, pos.size, win.item_id, win.j from pos join win on win.size = pos.size and win.w = array_to_string(pos.words[pos.i:pos.i + pos.size - 1], ' ')),
hit as (select doc_id, count(distinct i) as n from (select doc_id, unnest(range(i, i + size)) as i from occ) group by doc_id),
items as (select doc_id, count(*) as n, string_agg(id, ',' order by id) as ids from (select distinct doc_id, cast(item_id as varchar) as id from occ) group by doc_id),
runs as (select doc_id, count(*) + min(size) - 1 as n from (select *, i - row_number() over (partition by doc_id, item_id, i - j order by i) as island from occ) group by doc_id, item_id, i - j, island),
long as (select doc_id, max(n) as n from runs group by doc_id)
select dw.doc_id, cast(len(words) as bigint) as n_words, cast(coalesce(hit.n, 0) as bigint) as n_hit, cast(coalesce(items.n, 0) as bigint) as n_items, sha256(coalesce(ids, '')) as items_sha256, coalesce(hit.n, 0) > 0 as contaminated, cast(coalesce(long.n, 0) as bigint) as longest
from dw left join hit using (doc_id) left join items using (doc_id) left join long using (doc_id)
""",
    "op5_url_filter": r"""
with u as (select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
h as (select page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from u),
r(h, p, v) as (values ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
m as (select page_id, h || p as rule, v, row_number() over (partition by page_id order by length(h || p) desc, length(h) desc) as k from h join r on (host = r.h or ends_with(host, '.' || r.h)) and starts_with(path, r.p))
select h.page_id, h.host, h.path, m.rule, coalesce(m.v, 'allow') as verdict from h left join m on m.page_id = h.page_id and m.k = 1
""",
    "op8_chat_format": chat_format.SQL,
    "op9_substring_dedup": r"""
with w as (select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as words from documents),
win as (select doc_id, i, array_to_string(words[i:i + 12], ' ') as s from (select doc_id, words, unnest(range(1, len(words) - 11)) as i from w where len(words) >= 13)),
low as (select s, min(doc_id) as m from win group by s having min(doc_id) <> max(doc_id)),
bad as (select distinct doc_id, unnest(range(i, i + 13)) as i from win join low using (s) where doc_id > m),
b as (select doc_id, list(i) as gone from bad group by doc_id),
k as (select w.doc_id, words, coalesce(gone, []) as gone from w left join b using (doc_id))
select doc_id, cast(len(words) as bigint) as n_words, cast(len(gone) as bigint) as n_removed,
  sha256(coalesce(array_to_string(list_transform(list_filter(range(1, len(words) + 1), lambda i: not list_contains(gone, i)), lambda i: words[i]), ' '), '')) as kept_sha256 from k
""",
}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
