"""The registered queries ``opN_*`` over the whole intended tables, their SQL, and the pipeline's query."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeward.llm import exact_dedup, html_main, maxent_lm, mixing, packing, phrases, prefix_trie, quality, rule_ensemble, secrets, simhash, substring_dedup, toxicity
from lakeward.sources.tables import read_table

WS_SQL = r"[\x20\x09-\x0D]+"


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.plan(read_table(spark, sf_dir, "documents"))
    return rows.select(
        F.col("_id").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken")
    )


OP1_SQL = rf"""
with sized as (
  select doc_id, source, len(list_filter(regexp_split_to_array(coalesce(text, ''), '{WS_SQL}'), lambda x: x <> '')) as size
  from documents),
total as (select source, sum(size)::bigint as source_size from sized group by source),
weighed as (
  select *, (2 * source_size)::double as cap,
         ([5.0, 2.0, 1.0])[((row_number() over (order by source nulls last) - 1) % 3 + 1)::int]::double as w
  from total),
full_first as (
  select *, (sum(source_size) over ())::double as s,
         coalesce(sum(cap) over (order by cap / w, source nulls last rows between unbounded preceding and 1 preceding), 0) as filled,
         sum(w) over (order by cap / w desc, source desc nulls first rows between unbounded preceding and current row) as open
  from weighed),
level as (select max((1.5::double * s - filled) / open) as l from full_first where (1.5::double * s - filled) / open <= cap / w),
goal as (select source, source_size, least(cap, w * (select l from level)) as target from weighed),
placed as (
  select d.*, g.source_size, g.target, case when g.source_size > 0 then g.target / g.source_size else 0 end as rate,
         row_number() over (partition by d.source order by d.size, d.doc_id nulls last) - 1 as p
  from sized d join goal g on d.source is not distinct from g.source)
select doc_id, size::bigint as size, source_size, target,
       ((floor(rate * (p + 1) + {mixing.offset()!r}::double) - floor(rate * p + {mixing.offset()!r}::double)) * size)::bigint as taken
from placed
"""


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.assess(read_table(spark, sf_dir, "documents"))
    return rows.withColumnRenamed("_id", "doc_id").drop("_key")


OP3_SQL = rf"""
with d as (select doc_id, source, coalesce(text, '') as t from documents),
b as (
  select doc_id, source, t, list_filter(regexp_split_to_array(t, '{WS_SQL}'), lambda x: x <> '') as w,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l
  from d),
win as (
  select doc_id, unnest(range(1, len(w) - 6)) as i, w from b where len(w) >= 8),
win2 as (select doc_id, i, md5(array_to_string(w[i:i + 7], ' ')) as g from win),
twice as (select doc_id, i from (select *, count(*) over (partition by doc_id, g) as n from win2) where n > 1),
rep as (
  select doc_id, sum(least(8, nxt - i))::bigint as n_repeat_words
  from (select doc_id, i, coalesce(lead(i) over (partition by doc_id order by i), i + 8) as nxt from twice) group by doc_id),
nl as (
  select doc_id, source, list_filter(list_transform(string_split(lower(t), chr(10)),
         lambda x: trim(regexp_replace(x, '[\x20\x09\x0B-\x0D]+', ' ', 'g'), ' ')), lambda x: x <> '') as lines
  from d),
ln as (select doc_id, source, unnest(lines) as line from nl),
held as (select source, unnest(list_distinct(lines)) as line, md5(array_to_string(lines, chr(10))) as whole from nl),
freq as (select source, line, count(distinct whole) as n from held group by source, line),
host as (select source, count(*) as docs from documents group by source),
frequent as (
  select f.source, line from freq f join host h on f.source is not distinct from h.source
  where n > greatest({quality.MIN_DOCS}, {quality.HOST_SHARE} * docs)),
gone as (
  select ln.doc_id, sum(len(ln.line) - len(replace(ln.line, ' ', '')) + 1)::bigint as removed
  from ln join frequent f on ln.line = f.line and ln.source is not distinct from f.source group by ln.doc_id),
s as (
  select b.doc_id, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::bigint as n_symbols,
         (len(l) - len(list_distinct(l)))::bigint as n_dup_lines, coalesce(r.n_repeat_words, 0) as n_repeat_words,
         coalesce(g.removed, 0) as removed_words
  from b left join rep r using (doc_id) left join gone g using (doc_id))
select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed,
       not (n_words < 20 or 100 * n_repeat_words > 30 * n_words) and removed_words <= n_words * {quality.DEPLETED} as kept
from s
"""


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = exact_dedup.decide(read_table(spark, sf_dir, "documents"))
    return rows.select(
        F.col("_id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256")
    )


OP4_SQL = rf"""
with n as (select doc_id, sha256(regexp_replace(coalesce(text, ''), '{WS_SQL}', ' ', 'g')) as text_sha256 from documents)
select doc_id, min(doc_id) over (partition by text_sha256) as keep_id,
       count(*) over (partition by text_sha256) as group_size,
       row_number() over (partition by text_sha256 order by doc_id nulls last) = 1 as kept, text_sha256
from n
"""


def op2_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents")).withColumnRenamed("_id", "doc_id").drop("_key")


def op5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = html_main.extract(read_table(spark, sf_dir, "pages"))
    return rows.withColumn("n_chars", F.length("text").cast("bigint"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash.group(read_table(spark, sf_dir, "documents"))
    return rows.select(
        F.col("_id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = toxicity.classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    return rows.withColumnRenamed("_id", "doc_id").drop("_key")


def op8_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = substring_dedup.remove_repeats(read_table(spark, sf_dir, "documents"))
    return rows.select(
        F.col("_id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")
    )


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxent_lm.score(read_table(spark, sf_dir, "documents")).withColumnRenamed("_id", "doc_id")


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = secrets.find_secrets(read_table(spark, sf_dir, "documents"))
    base = [r.kind for r in secrets.BASE]
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return rows.select(
        F.col("_id").alias("doc_id"),
        *[count(kind) for kind in base],
        F.sha2(secrets.spans_text(F.col("spans"), tuple(base)), 256).alias("base_sha256"),
        secrets.spans_text(F.col("spans")).alias("spans"),
    )


def op11_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rule_ensemble.classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    return rows.withColumnRenamed("_id", "doc_id").drop("_key")


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(read_table(spark, sf_dir, "conversations"))


OP12_SQL = f"""
with placed as (
  select conv_id, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) - 1 as place,
         coalesce(role, '') as role, coalesce(text, '') as text
  from conversations where conv_id is not null),
own as (
  select conv_id, place, concat_ws(':', length(role), role, text) as turn_id,
         len(list_filter(regexp_split_to_array(text, '{WS_SQL}'), lambda x: x <> ''))::bigint as words
  from placed),
convs as (
  select conv_id, conv_id - conv_id % {prefix_trie.SHARED_EVERY} as opener,
         xor(list_reduce(
           list_prepend(4294967295::bigint, flatten(list_transform(string_split(conv_id::varchar, ''), lambda x: [ascii(x)::bigint, 0, 0, 0, 0, 0, 0, 0]))),
           lambda a, x: xor(xor(a, x) >> 1, case when xor(a, x) & 1 = 1 then 3988292384 else 0 end)), 4294967295) % 4 as h
  from (select distinct conv_id from own)),
lent as (select c.conv_id, o.place, o.turn_id, o.words from convs c join own o on o.conv_id = c.opener and o.place < c.h),
parts as (
  select conv_id, place, turn_id, words from lent
  union all
  select o.conv_id, place + 100, turn_id, words from own o join convs c on c.conv_id = o.conv_id where place >= h),
paths as (select conv_id, list(md5(turn_id) order by place) as ids, list(words order by place) as words from parts group by conv_id),
full_paths as (select c.conv_id, coalesce(ids, []::varchar[]) as ids, coalesce(words, []::bigint[]) as words from convs c left join paths using (conv_id)),
steps as (
  select conv_id, d as depth, len(ids) = d as ends, coalesce(words[d], 0) as w, array_to_string(ids[1:d], ',') as key,
         case when d > 0 then array_to_string(ids[1:d - 1], ',') end as parent
  from (select *, unnest(range(0, len(ids) + 1)) as d from full_paths)),
nodes as (
  select key, depth, any_value(parent) as parent, min(conv_id) as conv_id, count(*) as n_convs, (count(*) - 1) * any_value(w) as cost,
         sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (ends), '')) as ends_sha256
  from steps group by key, depth),
children as (select parent as key, count(*) as n_children from nodes where depth > 0 group by parent),
counted as (select n.*, coalesce(n_children, 0) as n_children from nodes n left join children using (key)),
subtree as (
  select s.key, sum(c.cost)::bigint as saved_tokens, count(*) filter (c.n_children = 0) as n_leaves
  from counted c join steps s on s.conv_id = c.conv_id and s.depth <= c.depth group by s.key)
select c.conv_id, c.depth, p.conv_id as parent_conv_id, c.n_convs, c.n_children, n_leaves, saved_tokens, c.ends_sha256
from counted c join subtree using (key) left join nodes p on p.key = c.parent
"""


def op13_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.ranked(phrases.collocations(read_table(spark, sf_dir, "documents")))


OP13_SQL = rf"""
with pieces as (
  select coalesce(lang, '{phrases.UNKNOWN}') as lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece
  from documents),
w as (select lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') as w from pieces),
total as (select lang, sum(len(w))::bigint as n from w group by lang),
sized as (select lang, w, unnest(range(1, {phrases.LONGEST + 1})) as size from w),
placed as (select lang, w, size, unnest(range(1, len(w) - size + 2)) as i from sized where len(w) >= size),
f as (
  select lang, w[i:i + size - 1] as p, size, count(*)::bigint as a from placed group by all having count(*) >= {phrases.THRESHOLD}),
inner_part as (
  select lang, p[k:k + m - 1] as p, max(a) as most
  from (select lang, p, a, size, unnest(range(1, size)) as m from f) join (select unnest(range(1, {phrases.LONGEST + 1})) as k) on k + m - 1 <= size
  group by all),
kept as (
  select f.* from f left join inner_part using (lang, p) where size > 1 and not coalesce({phrases.INSIDE_PERCENT} * a <= 100 * most, false)),
cut as (select *, unnest(range(1, size)) as k from kept),
scored as (
  select c.lang, c.p, c.a, x.a as l, y.a as r, n, c.k, (1000::hugeint * c.a * n) // (x.a::hugeint * y.a) as score
  from cut c join f x on x.lang = c.lang and x.p = c.p[1:k] join f y on y.lang = c.lang and y.p = c.p[k + 1:c.size] join total t on t.lang = c.lang),
lowest as (
  select lang, array_to_string(p, ' ') as phrase, a, l, r, n::bigint as n, score::bigint as score
  from scored qualify row_number() over (partition by lang, p order by score, k) = 1),
places as (select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r, n, score from lowest)
select * from places where rank <= {phrases.TOP}
"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mix": op1_mix,
    "op2_pack": op2_pack,
    "op3_quality": op3_quality,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_main_text": op5_main_text,
    "op6_simhash": op6_simhash,
    "op7_toxicity": op7_toxicity,
    "op8_substrings": op8_substrings,
    "op9_lm_score": op9_lm_score,
    "op10_secrets": op10_secrets,
    "op11_rule_ensemble": op11_rule_ensemble,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_phrases": op13_phrases,
}
ORACLES: dict[str, str] = {
    "op1_mix": OP1_SQL,
    "op3_quality": OP3_SQL,
    "op4_exact_dedup": OP4_SQL,
    "op12_prefix_trie": OP12_SQL,
    "op13_phrases": OP13_SQL,
}
