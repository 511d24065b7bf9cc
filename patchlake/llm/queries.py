"""Queries over the driver's tables, one for each operator, and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import language as lang
from . import html as pages_html
from . import alignment, decontaminate, maxscore, mixing, packing
from . import phrases as collocations
from . import quality as qual
from . import simhash
from . import toxicity as tox
from . import urlfilter, warc
from .common import fresh_path, table


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(table(spark, sf_dir, "documents"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tox.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_path(spark, "warc")
    warc.write(table(spark, sf_dir, "pages"), folder)
    return warc.read(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages_html.extract(table(spark, sf_dir, "pages"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"))
    length = F.expr("cast(octet_length(ids) / 4 as long)")
    return pieces.select("doc_id", "start", length.alias("length"), F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "sequence_tokens", "step_group")


def op7_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge(table(spark, sf_dir, "pages"))


def op8_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxscore.top_k(table(spark, sf_dir, "embeddings"), F.coalesce(F.col("vec_id") % 100 == 0, F.lit(False)))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lang.language(table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qual.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.phrases(table(spark, sf_dir, "documents"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents")).drop("groups")


def op13_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return told.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


OP8_SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) as c
  from embeddings
  where vec_id is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select q.vec_id as query_id, v.vec_id,
         cast(list_sum(list_transform(range(1, least(len(q.c), len(v.c)) + 1), lambda i: q.c[i] * v.c[i])) as bigint) as score
  from v as q join v on v.vec_id <> q.vec_id where q.vec_id % 100 = 0
)
select query_id, cast(rank as integer) as rank, vec_id, score
from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
where rank <= 10
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_simhash": op1_simhash,
        "op2_toxicity": op2_toxicity,
        "op3_mixing": op3_mixing,
        "op4_warc": op4_warc,
        "op5_html": op5_html,
        "op6_packing": op6_packing,
        "op7_urls": op7_urls,
        "op8_maxscore": op8_maxscore,
        "op9_language": op9_language,
        "op10_quality": op10_quality,
        "op11_phrases": op11_phrases,
        "op12_alignment": op12_alignment,
        "op13_decontaminate": op13_decontaminate,
    }


OP3_SQL = r"""
with d as (
  select doc_id, source, coalesce(cast(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) as bigint), 0) as size,
    coalesce(cast('0x' || substr(md5(cast(doc_id as varchar)), 1, 12) as bigint), 0) as h
  from documents
), n as (
  select source, cast(sum(size) as bigint) as source_size, ([3.0, 1.0, 2.0])[cast((row_number() over (order by source nulls last) - 1) % 3 + 1 as integer)]::double as w
  from d group by source
), c as (
  select *, source_size * 2.0::double as cap, sum(source_size) over () * 1.5::double as whole_mix from n
), l as (
  select *, (whole_mix - coalesce(sum(cap) over (order by cap / w, source nulls last rows between unbounded preceding and 1 preceding), 0))
    / sum(w) over (order by cap / w, source nulls last rows between current row and unbounded following) as level from c
), o as (
  select *, first_value(case when level * w <= cap then level end ignore nulls) over (order by cap / w, source nulls last rows between unbounded preceding and unbounded following) as top from l
), t as (
  select source, source_size, least(cap, coalesce(top * w, cap)) as target from o
), g as (
  select *, case when source_size > 0 then cast(floor(target / source_size + 1e-9) as bigint) else 0 end as whole from t
), r as (
  select *, greatest(target - whole * source_size, 0.0) as rest from g
), c1 as (
  select source, h, sum(own) over (partition by source order by h) - own as below, sum(own) over (partition by source order by h) as upto
  from (select source, h, sum(size) as own from d group by source, h)
), e1 as (
  select r.source, min(c1.h) filter (c1.upto > r.rest) as edge, coalesce(arg_min(c1.below, c1.h) filter (c1.upto > r.rest), max(c1.upto)) as below
  from r join c1 on r.source is not distinct from c1.source group by r.source
), p1 as (
  select r.*, coalesce(e1.edge, 281474976710656) as edge1, r.rest - e1.below as lack from r join e1 on r.source is not distinct from e1.source
), c2 as (
  select source, h, sum(own) over (partition by source order by h) - own as below, sum(own) over (partition by source order by h) as upto
  from (select d.source, d.h, sum(d.size) as own from d join p1 on d.source is not distinct from p1.source where d.h >= p1.edge1 and d.size <= p1.lack and d.size > 0 group by d.source, d.h having sum(d.size) <= any_value(p1.lack))
), heavy as (
  select d.source, d.h from d join p1 on d.source is not distinct from p1.source where d.h >= p1.edge1 and d.size <= p1.lack and d.size > 0 group by d.source, d.h having sum(d.size) > any_value(p1.lack)
), e2 as (
  select p1.source, min(c2.h) filter (c2.upto > p1.lack) as edge, arg_min(case when c2.upto - p1.lack < p1.lack - c2.below then 1 else 0 end, c2.h) filter (c2.upto > p1.lack) as up
  from p1 join c2 on p1.source is not distinct from c2.source group by p1.source
), p2 as (
  select p1.*, coalesce(e2.edge + e2.up, 281474976710656) as edge2 from p1 left join e2 on p1.source is not distinct from e2.source
)
select d.doc_id, d.size, p2.source_size, p2.target, cast(d.size * (p2.whole + case when d.h < p2.edge1 or (heavy.h is null and d.size <= p2.lack and d.h < p2.edge2) then 1 else 0 end) as bigint) as taken
from d join p2 on d.source is not distinct from p2.source left join heavy on d.source is not distinct from heavy.source and d.h = heavy.h
"""

OP4_SQL = """
with p as (
  select page_id, cast(octet_length(encode(coalesce(html, ''))) as bigint) as payload_bytes, sha1(coalesce(html, '')) as hex,
    min(page_id) over (partition by coalesce(html, '')) as first,
    row_number() over (partition by coalesce(html, '') order by page_id nulls last, url nulls first) as place from pages
)
select page_id, payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', cast(1 + ((cast('0x' || substr(hex, 5 * (i // 4) + 1, 5) as bigint) >> (15 - 5 * (i % 4))) & 31) as integer), 1)), '') as payload_digest,
  case when place = 1 or first is null then 'response' else 'revisit' end as record_type, case when place > 1 then first end as refers_to
from p
"""

OP11_SQL = r"""
with t as (
  select coalesce(lang, 'und') as lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as s from documents
), p as (
  select lang, unnest(list_transform(regexp_split_to_array(s, '[.,;:!?\x0A-\x0D]'), lambda x: regexp_extract_all(x, '[^\x20\x09]+'))) as w from t
), whole as (
  select lang, cast(sum(len(w)) as bigint) as n from p group by lang
), f as (
  select lang, x, count(*) as f from (
    select lang, unnest(w) as x from p
    union all select lang, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) from p
    union all select lang, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) from p
  ) group by lang, x
), c as (
  select lang, x as phrase, f as a, string_split(x, ' ') as w from f where f >= 10 and contains(x, ' ')
), cut as (
  select lang, phrase, a, w, k, array_to_string(w[1:k], ' ') as one, array_to_string(w[k + 1:], ' ') as two from (select *, unnest(range(1, len(w))) as k from c)
), scored as (
  select cut.lang, phrase, a, w, k, fl.f as l, fr.f as r, cast((1000000::hugeint * a * a) // (fl.f::hugeint * fr.f) as bigint) as score
  from cut join f as fl on fl.lang = cut.lang and fl.x = one join f as fr on fr.lang = cut.lang and fr.x = two
), best as (
  select * from scored qualify row_number() over (partition by lang, phrase order by score, k) = 1
), longer as (
  select lang, x, max(a) as a from (select lang, a, unnest([w[1] || ' ' || w[2], w[2] || ' ' || w[3]]) as x from c where len(w) = 3) group by lang, x
), kept as (
  select best.* from best left join longer on longer.lang = best.lang and longer.x = best.phrase where longer.a is null or 100 * longer.a < 50 * best.a
), ranked as (
  select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from kept
)
select lang, cast(rank as bigint) as rank, phrase, a, l, r, n, score from ranked join whole using (lang) where rank <= 2000
"""

OP13_SQL = r"""
with d as (
  select row_number() over () as row, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) as w from documents
), b as (
  select item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark where text is not null
), i as (
  select distinct item_id, least(len(w), 10) as n, unnest(list_transform(range(1, greatest(len(w) - 8, 2)), lambda k: w[k:k + 9])) as x from b where len(w) > 0
), o as (
  select row, n, unnest(range(1, len(w) - n + 2)) as k, w from d cross join (select distinct n from i)
), h as (
  select row, k, o.n, item_id from o join i on i.n = o.n and i.x = o.w[k:k + o.n - 1]
), hit as (
  select row, count(distinct place) as n_hit from (select row, unnest(range(k, k + n)) as place from h) group by row
), items as (
  select row, count(distinct item_id) as n_items, string_agg(distinct cast(item_id as varchar), ',' order by cast(item_id as varchar)) as ids from h group by row
)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join hit using (row) left join items using (row)
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_mixing": OP3_SQL, "op4_warc": OP4_SQL, "op8_maxscore": OP8_SQL, "op11_phrases": OP11_SQL, "op13_decontaminate": OP13_SQL}
