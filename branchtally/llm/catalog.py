"""The queries of this package, each over its whole table, and SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, centroids, infill, licenses, mixing, ngram_join, pieces, pii, quality, secrets, sharding, topk, toxicity
from .common import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(run):
    QUERIES[run.__name__] = run
    return run


@query
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.assess(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(pii.scan(table(spark, sf_dir, "documents").select("doc_id", "text")))


@query
def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return topk.top_k(rows, rows.where(F.col("vec_id") % 100 == 0), "vec_id", "embedding")


@query
def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


@query
def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.groups(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_rows(table(spark, sf_dir, "documents"))


@query
def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return secrets.report(secrets.scan(docs, secrets.train(docs)))


@query
def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.assess(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.kmeans(table(spark, sf_dir, "embeddings"))


@query
def op12_infill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infill.digests(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query
def op13_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digests(table(spark, sf_dir, "documents").select("doc_id", "text"))


ORACLES["op4_topk"] = """
with v as (select vec_id, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as (select q.vec_id as query_id, r.vec_id,
    cast(list_sum(list_transform(list_zip(q.v, r.v), lambda p: p[1] * p[2])) as bigint) as score
  from v q join v r on q.vec_id % 100 = 0 and r.vec_id <> q.vec_id),
ranked as (select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank from scored)
select query_id, rank, vec_id, score from ranked where rank <= 10
"""

ORACLES["op6_ngram_join"] = """
with recursive w as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w from documents),
s as (select distinct doc_id, unnest(case when len(w) >= 4
    then list_transform(range(1, len(w) - 2), lambda i: array_to_string(list_slice(w, i, i + 3), ' '))
    when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as g from w),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as a, b.doc_id as b, count(*) as o from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by all),
l as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * o >= 85 * (x.n + y.n - o)),
r as (select doc_id as node, doc_id as seen from documents union select r.node, l.b from r join l on l.a = r.seen)
select d.doc_id, coalesce(n.n, 0) as n_shingles, m.component_id from documents d left join n on n.doc_id = d.doc_id
join (select node, min(seen) as component_id from r group by node) m on m.node = d.doc_id
"""

ORACLES["op5_mixing"] = """
with s as (select source, cast(sum(coalesce(length(text), 0)) as double) as size from documents group by source),
w as (select source, size, case when size > 0 then pow(size, 0.7) else 0 end as weight from s),
r as (select source, case when size > 0 then weight / (select sum(weight) from w) * (select sum(size) from w) / size else 1.0 end as rate from w),
p as (select source, k, exp(-rate + k * ln(rate) - lgamma(k + 1)) as p from r, (select unnest(range(0, 300)) as k) where k <= ceil(rate + 12 * sqrt(rate) + 40)),
c as (select source, k, sum(p) over (partition by source order by k) as upto from p),
d as (select *, cast(cast('0x' || substr(md5('20265|' || coalesce(cast(doc_id as varchar), '') || '|' || coalesce(text, '')), 1, 13) as ubigint) as double)
  / 4503599627370496.0 as u from documents),
n as (select d.doc_id, d.text, d.lang, d.source, d.n_chars,
  (select count(*) from c where c.source is not distinct from d.source and c.upto <= d.u) as n from d),
e as (select * exclude n, unnest(range(0, n)) as c from n)
select doc_id, text, lang, source, n_chars, cast(c as integer) as copy,
  cast(cast('0x' || substr(md5('20266|' || coalesce(cast(doc_id as varchar), '') || '|' || c || '|' || coalesce(length(text), 0)), 1, 13) as ubigint) as bigint) as mix_order
from e
"""


def _rounds(n: int) -> str:
    """The rounds of the clustering as common tables: assignments a0.. and centroids c1.. ."""
    nearest = """a{r} as (select vec_id, v, arg_min(c, (d, c)) as cluster, min(d) as d from (select k.vec_id, k.v, m.c,
    list_sum(list_transform(list_zip(k.v, m.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) as d from k, c{r} m) group by vec_id, v)"""
    moved = """s{r} as (select cluster, i, cast(floor(sum(x) / count(*)) as bigint) as x from
    (select cluster, unnest(v) as x, unnest(range(1, 65)) as i from a{r}) group by cluster, i),
  c{next} as (select m.c, coalesce(n.v, m.v) as v from c{r} m left join
    (select cluster, list(x order by i) as v from s{r} group by cluster) n on n.cluster = m.c)"""
    steps = [part for r in range(n) for part in (nearest.format(r=r), moved.format(r=r, next=r + 1))]
    return ",\n  ".join([*steps, nearest.format(r=n)])


ORACLES["op11_centroids"] = f"""
with k as (select vec_id, list_transform(embedding, lambda x: cast(floor(64 * cast(x as double)) as bigint)) as v from embeddings
    where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
  c0 as (select row_number() over (order by sha256('1:' || vec_id)) - 1 as c, v from k order by sha256('1:' || vec_id) limit 16),
  {_rounds(3)},
  t as (select cluster, sum(d) as s from a3 group by cluster)
select a.vec_id, cast(a.cluster as integer) as cluster, cast(a.d as bigint) as distance, cast(t.s as bigint) as cluster_inertia,
  cast((select sum(d) from a3) as bigint) as inertia, sha256(array_to_string(c.v, ',')) as centroid_sha256
from a3 a join t on t.cluster = a.cluster join c3 c on c.c = a.cluster
"""

ORACLES["op12_infill"] = """
with t as (select doc_id, coalesce(text, '') as text, sha256('42:' || coalesce(cast(doc_id as varchar), '')) as h,
    regexp_extract_all(coalesce(text, ''), '[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+') as u from documents),
h as (select *, len(u) as n, list_transform([1, 9, 17, 25], lambda i: cast('0x' || substr(h, i, 8) as bigint)) as h4 from t),
f as (select *, least(h4[1] % (n + 1), h4[2] % (n + 1)) as a, greatest(h4[1] % (n + 1), h4[2] % (n + 1)) as b,
    case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or h4[3] % 100 >= 50 then 'plain'
      when h4[4] % 100 < 80 then 'spm' else 'psm' end as form from h),
p as (select *, array_to_string(list_slice(u, 1, a), '') as prefix, array_to_string(list_slice(u, a + 1, b), '') as middle,
    array_to_string(list_slice(u, b + 1, n), '') as suffix from f)
select doc_id, n, form, case when form <> 'plain' then length(prefix) end as prefix_chars, case when form <> 'plain' then length(middle) end as middle_chars,
  sha256(case form when 'plain' then text when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) as output_sha256, sha256(text) as restored_sha256
from p
"""
