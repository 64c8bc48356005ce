"""The registered queries of this subpackage, each over whole tables, and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterlake.llm import bpe, exact_dedup, hard_negatives, html_text, license_scan, mixing, ngram_join, pii, quality_fm, quality_rules, resampling, substring_dedup, toxicity

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), RANKS, public_tokenizers.PATTERN)


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def op3_quality_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_fm.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(table(spark, sf_dir, "documents"), k=3, percent=90).drop("text_hash")


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    model = html_text.fit(html_text.labelled_pages(pages, table(spark, sf_dir, "documents")))
    return html_text.extract(pages, model)


def op8_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.apply_rules(table(spark, sf_dir, "documents"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "times", "weight")


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).cast("int")
    return hard_negatives.mine(rows.withColumn("label", label)).drop("blocks_read")


def queries() -> dict:
    return {"op1_bpe": op1_bpe, "op2_exact_dedup": op2_exact_dedup, "op3_quality_fm": op3_quality_fm, "op4_ngram_jaccard": op4_ngram_jaccard, "op5_license_scan": op5_license_scan, "op6_pii": op6_pii, "op7_html_text": op7_html_text, "op8_host_rules": op8_host_rules, "op9_substring_dedup": op9_substring_dedup, "op10_mixing": op10_mixing, "op11_toxicity": op11_toxicity, "op12_resampling": op12_resampling, "op13_hard_negatives": op13_hard_negatives}


OP2_SQL = r"""
with d as (select doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) as h from documents),
g as (select h, min(doc_id) as keep_id, count(*) as group_size from d group by h)
select doc_id, keep_id, cast(group_size as bigint) as group_size, doc_id = keep_id as kept, h as text_sha256
from d join g using (h)
"""

OP10_SQL = r"""
with d as (
  select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as size,
    round(greatest(0.05, coalesce(length(regexp_replace(text, '[\x21-\x40\x5B-\x60\x7B-\x7E]+', '', 'g')) / nullif(length(text), 0), 0.05)), 6) as weight,
    (cast(cast('0x' || substr(md5('42:' || cast(doc_id as varchar)), 1, 13) as bigint) as double) + 1) / 4503599627370496.0 as u
  from documents),
k as (select doc_id, source, size, weight, round(-ln(u) / weight, 9) as sample_key from d),
s as (select source, cast(sum(size) as bigint) as source_size from k group by source),
w as (select *, list_extract([5.0::double, 2.0, 1.0], cast((row_number() over (order by source nulls last) - 1) % 3 + 1 as int)) as w, 2.0::double * source_size as cap from s),
f as (select *, sum(source_size) over () * 1.5::double as total,
    coalesce(sum(cap) over (order by cap / w, source nulls last rows between unbounded preceding and 1 preceding), 0) as full_,
    sum(w) over () - coalesce(sum(w) over (order by cap / w, source nulls last rows between unbounded preceding and 1 preceding), 0) as open_ from w),
l as (select *, max((total - full_) / open_) over () as level from f),
t as (select source, source_size, least(cap, level * w) as target from l),
e as (select *, cast(coalesce(floor(target / nullif(source_size, 0)), 0) as bigint) as epochs from t),
r as (select k.*, e.source_size, e.target, e.epochs, e.target - e.epochs * e.source_size as rest,
    coalesce(sum(size) over (partition by k.source order by sample_key, doc_id, size rows between unbounded preceding and 1 preceding), 0) as before_
  from k join e on k.source is not distinct from e.source)
select doc_id, size, source_size, target, size * times as taken, times, weight
from (select *, epochs + case when before_ + size / 2 <= rest then 1 else 0 end as times from r)
"""


OP5_SQL = r"""
with d as (select doc_id, coalesce(text, '') as text from documents),
n as (select doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w from d),
p as (select doc_id, w, len(w) as n_words,
    list_filter(range(len(w)), lambda i: w[i + 1] = 'mit' and w[i + 2] = 'license') as mit,
    list_filter(range(len(w)), lambda i: w[i + 1] = 'apache' and w[i + 2] = 'license') as apache,
    list_filter(range(len(w)), lambda i: w[i + 1] = 'general' and w[i + 2] = 'public' and w[i + 3] = 'license') as gpl from n),
t(label, notice) as (values """ + ", ".join(f"('{k}', '{' '.join(license_scan._ascii_words(v))}')" for k, v in license_scan.TEMPLATES) + r"""),
tt as (select label, list_distinct(string_split(notice, ' ')) as tokens from t),
b as (select doc_id, list_distinct(list_filter(regexp_split_to_array(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')) as w
  from (select doc_id, unnest(string_split(text, chr(10))) as line from d)),
m as (select doc_id, label, len(list_intersect(w, tokens)) as common, len(tokens) as size from b, tt where len(w) >= ceil(0.8 * len(tokens) - 1e-9)),
f as (select doc_id, list(distinct label) as found, max(common::double / size) as best from m where common >= ceil(0.8 * size - 1e-9) group by doc_id)
select p.doc_id, cast(n_words as bigint) as n_words, cast(len(mit) + len(apache) + len(gpl) as bigint) as n_base,
  list_min(mit || apache || gpl) as first_word, list_max(mit || apache || gpl) as last_word,
  concat_ws(',', case when len(apache) > 0 then 'apache' end, case when len(gpl) > 0 then 'gpl' end, case when len(mit) > 0 then 'mit' end) as base_labels,
  array_to_string(list_sort(list_distinct(coalesce(found, []::varchar[]) || list_filter([case when len(apache) > 0 then 'apache' end, case when len(gpl) > 0 then 'gpl' end, case when len(mit) > 0 then 'mit' end], lambda x: x is not null))), ',') as labels,
  case when len(mit) + len(apache) + len(gpl) > 0 then 1.0::double else coalesce(best, 0.0) end as score
from p left join f on p.doc_id = f.doc_id
"""

OP8_SQL = r"""
with d as (select doc_id, source, coalesce(text, '') as text from documents),
w as (select doc_id, source, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as w,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines from d),
g as (select doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as g from (select doc_id, w, unnest(range(1, len(w) - 1)) as i from w)),
r as (select doc_id, unnest([i, i + 1, i + 2]) as i from (select *, count(*) over (partition by doc_id, g) as c from g) where c > 1),
n as (select doc_id, count(distinct i) as n from r group by doc_id),
m as (select w.doc_id, source, cast(len(w) as bigint) as n_words, cast(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) as bigint) as word_chars,
    cast(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) as bigint) as n_symbols, cast(len(lines) - len(list_distinct(lines)) as bigint) as n_dup_lines,
    cast(coalesce(n.n, 0) as bigint) as n_repeat_words from w left join n on w.doc_id = n.doc_id),
v as (select *, n_words < 50 or n_repeat_words * 100 > n_words * 50 as base_failed,
    n_words = 0 or n_symbols * 10 > n_words or n_dup_lines * 20 > n_words or n_repeat_words * 100 > n_words * 30 or word_chars > n_words * 12 or word_chars < n_words * 2 as poor from m),
h as (select source, count(*)::double as n, sum(case when base_failed or poor then 1 else 0 end)::double as f from v group by source),
q as (select avg(f / n) as mean, coalesce(var_samp(f / n), 0) as var from h),
s as (select mean, sqrt(v) as sd, top / v - 1 as strength from (select mean, top, least(greatest(var, 1e-4), top * 0.999) as v from (select mean, var, greatest(mean * (1 - mean), 1e-9) as top from q))),
x as (select source, (f + mean * strength) / (n + strength) as rate, mean + sd as bar from h, s)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and not (rate > bar and poor) as kept, round(rate, 9) as host_rate
from v join x on v.source is not distinct from x.source
"""


OP9_SQL = r"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
s as (select doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) as h from (select doc_id, w, unnest(range(1, len(w) - 48)) as i from d where len(w) >= 50)),
m as (select doc_id, i from (select doc_id, i, min(doc_id) over (partition by h) as least from s) where least < doc_id),
p as (select distinct doc_id, unnest(range(i, i + 50)) as i from m),
r as (select doc_id, list(i) as gone, count(*) as n_removed from p group by doc_id)
select d.doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_removed, 0) as bigint) as n_removed,
  sha256(array_to_string(case when gone is null then w else list_filter(w, lambda x, j: not list_contains(gone, j)) end, ' ')) as kept_sha256
from d left join r on d.doc_id = r.doc_id
"""


#: CRC-32 by its table of 256 remainders, which the SQL makes.
OP12_SQL = r"""
with crc as (select list(c order by i) as t from (select i, list_reduce([i]::bigint[] || range(8), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as c from (select unnest(range(256)) as i))),
d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
b as (select regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
f as (select doc_id, unnest(w) as w from d),
g as (select unnest(w) as w from b),
v as (select w, hex(encode(w)) as h from (select w from f union select w from g)),
k as (select w, xor(list_reduce([4294967295]::bigint[] || list_transform(range(len(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::bigint), lambda c, x: xor(c >> 8, t[xor(c & 255, x) + 1])), 4294967295) % 10000 as bucket from v, crc),
s as (select bucket, count(*) as s from f join k using (w) group by bucket),
t as (select bucket, count(*) as t from g join k using (w) group by bucket),
big as (select coalesce((select sum(s) from s), 0)::double as s, coalesce((select sum(t) from t), 0)::double as t),
gain as (select x.bucket, floor(1000 * ln((coalesce(t.t, 0)::double + 1) * (big.s + 10000.0::double) / ((coalesce(s.s, 0)::double + 1) * (big.t + 10000.0::double))))::bigint as gain
  from (select distinct bucket from k) x left join s on s.bucket = x.bucket left join t on t.bucket = x.bucket, big),
w as (select doc_id, sum(gain)::bigint as weight from f join k using (w) join gain using (bucket) group by doc_id),
r as (select d.doc_id, len(d.w)::bigint as n_words, coalesce(weight, 0)::bigint as weight, coalesce(weight, 0)::bigint
    + floor(-1000::double * ln(-ln((('0x' || substr(sha256('2024:' || d.doc_id::varchar), 1, 8))::bigint::double + 0.5::double) / 4294967296.0::double)))::bigint as score from d left join w on w.doc_id = d.doc_id),
o as (select doc_id, row_number() over (order by score desc, doc_id) as rank from r where n_words >= 20)
select r.doc_id, n_words, n_words as n_features, weight, score, case when rank <= (select 10 * count(*) // 100 from o) then rank end as rank from r left join o on o.doc_id = r.doc_id
"""


OP13_SQL = r"""
with e as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as q from embeddings
    where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as materialized (select a.vec_id as a, a.label as al, b.vec_id as b, b.label as bl, list_sum(list_transform(range(1, len(a.q) + 1), lambda i: a.q[i] * b.q[i]))::bigint as score from e a join e b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id),
p as (select a, al, b, score, row_number() over (partition by a order by score desc, b) as nth from s where al = bl),
n as (select p.a, p.b as p, p.score as ps, s.b as n, s.score as ns, row_number() over (partition by p.a, p.b order by s.score desc, s.b) as rank
  from p join s on p.nth <= 5 and s.a = p.a and s.bl <> p.al and 30 * p.score <= 100 * s.score and 100 * s.score <= 90 * p.score)
select a as anchor_id, p as positive_id, rank::int as rank, n as negative_id, ps as positive_score, ns as negative_score from n where rank <= 10
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_exact_dedup": OP2_SQL, "op5_license_scan": OP5_SQL, "op8_host_rules": OP8_SQL, "op9_substring_dedup": OP9_SQL, "op10_mixing": OP10_SQL, "op12_resampling": OP12_SQL, "op13_hard_negatives": OP13_SQL}
