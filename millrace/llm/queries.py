"""The registered queries of this folder: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontam, html_extract, license_scan, lm, neardup, pii, quality, toxicity, warc
from .common import table


def tokenizer_path() -> str:
    """The public vocabulary file; the driver reads it and broadcasts what it holds."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.detect(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), tokenizer_path())


def op5_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.scored(table(spark, sf_dir, "documents"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(table(spark, sf_dir, "pages"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


def op8_license(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.find_licenses(table(spark, sf_dir, "documents")).drop("notices")


def op9_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.judged(table(spark, sf_dir, "documents"))


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extracted(table(spark, sf_dir, "pages"))


def pii_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op2 that SQL can express."""
    return op2_pii(spark, sf_dir).select("doc_id", *(f"n_{k}" for k in pii.BASE))


def quality_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op7 that SQL can express."""
    return op7_quality(spark, sf_dir).select("doc_id", *quality.FIGURES, "base_failed")


def license_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op8 that SQL can express."""
    return op8_license(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op5, scores rounded: sums of logarithms differ in their last digits."""
    out = op5_lm_score(spark, sf_dir)
    return out.withColumns({c: F.round(c, 3) for c in ("base_score", "score")})


#: crc32 of an id as text, by its definition bit by bit
_CRC = """xor(list_reduce(list_prepend(4294967295, list_transform(list_filter(string_split(coalesce(cast(doc_id as varchar), ''), ''), lambda x: x <> ''), lambda x: cast(ascii(x) as bigint))),
    lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda a, i: case when a & 1 = 1 then xor(a >> 1, 3988292384) else a >> 1 end)), 4294967295)"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontaminate": op1_decontaminate,
    "op2_pii": op2_pii,
    "op3_toxicity": op3_toxicity,
    "op4_bpe": op4_bpe,
    "op5_lm_score": op5_lm_score,
    "op6_warc": op6_warc,
    "op7_quality": op7_quality,
    "op8_license": op8_license,
    "op9_near_dup": op9_near_dup,
    "op10_html": op10_html,
    "pii_counts": pii_counts,
    "quality_figures": quality_figures,
    "license_places": license_places,
    "lm_scores": lm_scores,
}

#: DuckDB SQL for the same rows
ORACLE_SQL: dict[str, str] = {
    "op1_decontaminate": decontam.SQL,
    "op6_warc": """
with p as (
  select page_id, strlen(coalesce(html, '')) as payload_bytes, sha256(coalesce(html, '')) as payload_digest from pages
), f as (
  select payload_digest, min(page_id) as first from p where payload_bytes >= 100 group by payload_digest having count(*) > 1
)
select p.page_id, p.payload_bytes, p.payload_digest,
  case when f.first is not null and p.page_id is distinct from f.first then 'revisit' else 'response' end as record_type,
  case when p.page_id is distinct from f.first then f.first end as refers_to
from p left join f using (payload_digest)
""",
    "pii_counts": r"""
with m as (
  select doc_id,
    len(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+')) as n_email,
    list_transform(regexp_extract_all(coalesce(text, ''), '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)'), lambda x: string_split(x, '.')) as ips,
    list_transform(regexp_extract_all(coalesce(text, ''), '[0-9]([\x20-]?[0-9])+'), lambda x: regexp_replace(x, '[^0-9]', '', 'g')) as cards,
    list_transform(regexp_extract_all(coalesce(text, ''), '\+[0-9][\x20().0-9-]+[0-9]'), lambda x: regexp_replace(x, '[^0-9]', '', 'g')) as phones
  from documents
)
select doc_id, n_email,
  len(list_filter(ips, lambda p: len(list_filter(p, lambda x: length(ltrim(x, '0')) > 3 or cast('0' || right(ltrim(x, '0'), 3) as int) > 255)) = 0)) as n_ip,
  len(list_filter(cards, lambda d: length(d) between 16 and 19 and list_sum(list_transform(range(length(d)),
    lambda i: (1 + i % 2) * cast(substring(d, length(d) - i, 1) as int) - case when i % 2 = 1 and substring(d, length(d) - i, 1) > '4' then 9 else 0 end)) % 10 = 0)) as n_card,
  len(list_filter(phones, lambda d: length(d) between 8 and 15)) as n_phone
from m
""",
    "quality_figures": r"""
with d as (
  select row_number() over () as r, doc_id, coalesce(text, '') as t, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as l
  from documents
), g as (
  select r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as g from d, unnest(range(1, len(w) - 1)) as u(i)
), again as (
  select r, i from (select r, i, count(*) over (partition by r, g) as c from g) where c > 1
), n as (
  select r, count(distinct p) as n from (select r, unnest([i, i + 1, i + 2]) as p from again) group by r
)
select doc_id, len(w) as n_words, cast(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) as bigint) as word_chars,
  length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as n_symbols, len(l) - len(list_distinct(l)) as n_dup_lines, coalesce(n, 0) as n_repeat_words,
  len(w) < 50 or 100 * coalesce(n, 0) > 50 * len(w) as base_failed
from d left join n using (r)
""",
    "license_places": r"""
with d as (
  select row_number() over () as r, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') as w from documents
), p(phrase, n, label) as (
  values ('cc by', 2, 'cc-by'), ('general public license', 3, 'gpl'), ('all rights reserved', 3, 'reserved')
), hit as (
  select r, i - 1 as place, label from d, p, unnest(range(1, len(w) - n + 2)) as u(i) where w[i] = split_part(phrase, ' ', 1) and array_to_string(w[i : i + n - 1], ' ') = phrase
), f as (
  select r, count(*) as n_base, min(place) as first_word, max(place) as last_word, string_agg(distinct label, ',' order by label) as base_labels from hit group by r
)
select doc_id, len(w) as n_words, coalesce(n_base, 0) as n_base, first_word, last_word, coalesce(base_labels, '') as base_labels from d left join f using (r)
""",
    "lm_scores": rf"""
with d as (
  select row_number() over () as r, doc_id, {_CRC} % 7 = 2 as held_out,
    list_concat([' start'], list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> ''), [' end']) as w
  from documents
), t as (
  select r, held_out, w[i] as c, w[i - 1] as b, case when i > 2 then w[i - 2] end as a from d, unnest(range(2, len(w) + 1)) as u(i)
), one as (
  select c, count(*) as n1 from t where not held_out group by c
), history as (
  select b, count(*) as after from t where not held_out group by b
), two as (
  select b, c, count(*) as n2 from t where not held_out group by b, c
), three as (
  select a, b, c, count(*) as n3 from t where not held_out and a is not null group by a, b, c
), k as (
  select coalesce(sum(n1), 0) as total, count(*) as kinds from one
), p as (
  select r, a, n1, (coalesce(n1, 0) + 1) / (total + kinds + 1) as p1, coalesce(two.n2, 0) as n2, coalesce(after, 0) as after, coalesce(n3, 0) as n3, coalesce(ab.n2, 0) as before
  from t cross join k left join one using (c) left join history using (b) left join two using (b, c) left join three using (a, b, c)
    left join two ab on ab.b = t.a and ab.c = t.b
), q as (
  select *, (n2 + {lm.K2} * p1) / (after + {lm.K2}) as p2 from p
), s as (
  select r, count(*) as n_tokens, count(n1) as n_known, sum(log10(p1)) as base, sum(log10(case when a is null then p2 else (n3 + {lm.K3} * p2) / (before + {lm.K3}) end)) as score from q group by r
)
select doc_id, held_out, n_tokens, n_known, cast(total as bigint) as train_tokens, round(base, 3) as base_score, round(score, 3) as score from d join s using (r) cross join k
""",
    "op9_near_dup": r"""
with recursive d as (
  select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents
), s as (
  select distinct doc_id, array_to_string(w[i : i + 2], ' ') as g from d, unnest(range(1, greatest(len(w) - 2, least(len(w), 1)) + 1)) as t(i)
), n as (
  select doc_id, count(*) as n from s group by doc_id
), shared as (
  select a.doc_id as a, b.doc_id as b, count(*) as k from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by all
), links as (
  select a, b from shared join n na on na.doc_id = a join n nb on nb.doc_id = b where 100 * k >= 85 * (na.n + nb.n - k)
), reach as (
  select doc_id as x, doc_id as y from documents
  union
  select r.x, case when l.a = r.y then l.b else l.a end from reach r join links l on l.a = r.y or l.b = r.y
), c as (
  select x, min(y) as component_id from reach group by x
)
select d.doc_id, coalesce(n.n, 0) as n_shingles, component_id, d.doc_id = component_id as kept
from d left join n using (doc_id) join c on c.x = d.doc_id
""",
}
