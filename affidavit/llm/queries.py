"""The registered queries of this subpackage, each over its whole table, and SQL for the same rows."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .byte_bpe import digests
from .common import new_folder, table
from .embedding_dedup import near_vectors
from .html_extract import extract
from .license_scan import TEMPLATES, license_scan
from .mixing import mix
from .quality_classifier import score, train
from .quality_rules import quality_rules
from .simhash_dedup import simhash_components
from .token_store import read_tokens, write_tokens
from .url_filter import url_filter
from .vector_codes import compress, digest
from .whitening import whiten
from .word_bpe import encode as encode_words

#: Target weights of the registered mix; every other source has weight 1.
MIX_WEIGHTS = {"src0": 3.0, "src1": 2.0, "src2": 0.5, "src3": 0.25}


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = quality_rules(table(spark, sf_dir, "documents"))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    more = ("kept", "n_removed_lines", "n_removed_words")
    return rules.select("doc_id", *[F.col("rules")[k].alias(k) for k in names + more])


OP1_SQL = r"""
with d as (select doc_id, coalesce(text, '') as t, coalesce(source, '<null>') as host, row_number() over () as r from documents),
w as (
    select r, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws,
           list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as ls
    from d
),
windows as (
    select r, k, ws[k] || ' ' || ws[k + 1] || ' ' || ws[k + 2] as g
    from (select r, ws, unnest(range(1, len(ws) - 1)) as k from w where len(ws) >= 3)
),
twice as (select r, k from (select r, k, count(*) over (partition by r, g) as n from windows) where n > 1),
covered as (select r, count(distinct p) as n from (select r, unnest([k, k + 1, k + 2]) as p from twice) group by r),
base as (
    select d.r, d.doc_id, d.host, d.t, cast(len(ws) as bigint) as n_words,
           cast(length(list_aggregate(list_append(ws, ''), 'string_agg', '')) as bigint) as word_chars,
           cast(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
           cast(len(ls) - len(list_distinct(ls)) as bigint) as n_dup_lines,
           coalesce(c.n, 0) as n_repeat_words
    from d join w using (r) left join covered c using (r)
),
lines as (
    select r, host, t, l, length(l) - length(replace(l, ' ', '')) + 1 as n
    from (select r, host, t, trim(lower(regexp_replace(unnest(string_split(t, chr(10))), '[\x20\x09-\x0D]+', ' ', 'g'))) as l from d)
    where l <> ''
),
hosts as (select host, count(distinct t) as n_host from d group by host),
often as (
    select host, l from (select host, l, count(distinct t) as n from lines group by host, l) join hosts using (host)
    where n > 20 and n > n_host * 0.02
),
removed as (select r, count(*) as n_lines, sum(n) as n_words from lines join often using (host, l) group by r),
judged as (
    select base.*, base.n_words < 50 or 100 * n_repeat_words > 50 * base.n_words as base_failed,
           coalesce(x.n_lines, 0) as n_removed_lines, coalesce(x.n_words, 0) as n_removed_words
    from base left join (select r, n_lines, n_words from removed) x using (r)
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       not base_failed and n_removed_words <= n_words * 0.5 as kept,
       cast(n_removed_lines as bigint) as n_removed_lines, cast(n_removed_words as bigint) as n_removed_words
from judged
"""


def op2_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_components(table(spark, sf_dir, "documents"), span=3, radius=2, least=None)
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return found.select("doc_id", hexed.alias("fingerprint"), "component_id")


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter(pages).select("page_id", "host", "path", "rule", "verdict", "pattern_rule")


OP3_SQL = r"""
with u as (
    select page_id, coalesce(url, '') as url,
           translate(regexp_extract(coalesce(url, ''), '^(?s).*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
           regexp_extract(coalesce(url, ''), '^(?s).*?://[^/?#]*([^?#]*)', 1) as path
    from pages
),
rules(host, start, rule, verdict) as (
    values ('net', '/', 'net/', 'block'), ('example.net', '/en/', 'example.net/en/', 'allow'),
           ('example.com', '/de/', 'example.com/de/', 'block'), ('org', '/fr/', 'org/fr/', 'allow')
),
patterns(id, pattern) as (
    values ('adult-host', '://([^/?#]*[.-])?adult([.-][^/?#]*)?([/?#]|$)'),
           ('bets-host', '://([^/?#]*[.-])?free[.-]bets([.-][^/?#]*)?([/?#]|$)'),
           ('casino-host', '://([^/?#]*[.-])?casino([.-][^/?#]*)?([/?#]|$)'),
           ('pills-host', '://([^/?#]*[.-])?cheap[.-]pills([.-][^/?#]*)?([/?#]|$)'),
           ('porn-host', '://([^/?#]*[.-])?porn([.-][^/?#]*)?([/?#]|$)'),
           ('spam-host', '://([^/?#]*[.-])?spam[.-]farm([.-][^/?#]*)?([/?#]|$)'),
           ('click-track', '[?&]adclick=[0-9]+'),
           ('warez-path', '://[^?#]*/warez/')
),
fits as (
    select u.*,
           (select max({'n': length(r.rule), 'rule': r.rule, 'verdict': r.verdict}) from rules r
            where (u.host = r.host or ends_with(u.host, '.' || r.host)) and starts_with(u.path, r.start)) as r,
           (select min(p.id) from patterns p where regexp_matches(lower(u.url), p.pattern)) as pattern_rule
    from u
)
select page_id, host, path, r.rule as rule,
       coalesce(r.verdict, case when pattern_rule is not null then 'block' else 'allow' end) as verdict, pattern_rule
from fits
"""


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files ``source/lang/thousand/hundred/doc_id``.

    Those that open or close with a notice are licence files, every other one of its hundred, the rest of its thousand.
    """
    ends = F.lower(F.concat_ws("\n", F.substring_index("text", "\n", 1), F.substring_index("text", "\n", -1)))
    whole = lambda n: F.floor(F.col("doc_id") / n).cast("string")
    thousand = F.concat_ws("/", F.coalesce("source", F.lit("none")), F.coalesce("lang", F.lit("none")), whole(1000))
    notice = F.coalesce(F.rlike(ends, F.lit("licensed|license|rights reserved")), F.lit(False))
    name = F.concat(F.lit("LICENSE."), F.col("doc_id"))
    path = F.when(notice & (F.col("doc_id") % 2 == 1), F.concat_ws("/", thousand, name)).otherwise(
        F.concat_ws("/", thousand, whole(100), F.when(notice, name).otherwise(F.col("doc_id").cast("string")))
    )
    files = table(spark, sf_dir, "documents").select("doc_id", path.alias("path"), "text")
    return license_scan(files).select("doc_id", "path", "own_licence", "score", "licence", "licence_of")


_TEMPLATE_ROWS = ",\n           ".join("({}, '{}', '{}')".format(k, name, notice.replace("'", "''")) for k, (name, notice) in enumerate(TEMPLATES))
OP4_SQL = r"""
with templates(template, licence, notice) as (
    values TEMPLATE_ROWS
),
named as (
    select doc_id, coalesce(text, '') as text, coalesce(source, 'none') || '/' || coalesce(lang, 'none') || '/' || cast(floor(doc_id / 1000) as bigint) as thousand,
           coalesce(regexp_matches(lower(string_split(text, chr(10))[1] || chr(10) || string_split(text, chr(10))[-1]), 'licensed|license|rights reserved'), false) as notice
    from documents
),
files as (
    select doc_id, text, notice, thousand || '/' || case when notice and doc_id % 2 = 1 then 'LICENSE.' || doc_id
        else cast(floor(doc_id / 100) as bigint) || '/' || case when notice then 'LICENSE.' || doc_id else cast(doc_id as varchar) end end as path
    from named
),
t_tokens as (
    select template, licence, token, count(*) as tf
    from (select template, licence, unnest(regexp_extract_all(lower(notice), '[a-z0-9]+(?:[.][0-9]+)*')) as token from templates)
    group by all
),
n_files as (select count(*) as n from files),
d_tokens as (select distinct r, token from (select row_number() over () as r, unnest(regexp_extract_all(lower(text), '[a-z0-9]+(?:[.][0-9]+)*')) as token from files)),
idf as (
    select token, ln((1.0 + n) / (1 + k)) + 1 as idf
    from (select t.token, count(d.r) as k from (select distinct token from t_tokens) t left join d_tokens d using (token) group by t.token), n_files
),
t_w as (select template, licence, token, tf * idf as w from t_tokens join idf using (token)),
t_q as (select template, licence, token, w / sqrt(sum(w * w) over (partition by template)) as q from t_w),
split as (select path, text, notice, string_split(text, chr(10)) as ls from files),
lines as (
    select path, array_to_string(ls[i:i + n - 1], chr(10)) as line
    from (select path, ls, i, unnest([1, 2, 3]) as n from (select path, ls, unnest(range(1, len(ls) + 1)) as i from split))
    union
    select path, array_to_string(ls[1:coalesce(nullif(list_position(list_transform(ls, lambda x: not regexp_matches(x, '^\s*(#|//|/[*]|[*]|--|;|%|<!--)')), true), 0) - 1, len(ls))], chr(10)) from split
    union
    select path, text from split where notice
),
l_tokens as (
    select line, token, count(*) as tf
    from (select line, unnest(regexp_extract_all(lower(line), '[a-z0-9]+(?:[.][0-9]+)*')) as token from (select distinct line from lines)) group by all
),
l_w as (select line, token, tf * coalesce(idf, ln(1.0 + n) + 1) as w from l_tokens cross join n_files left join idf using (token)),
norms as (select line, sqrt(sum(w * w)) as norm from l_w group by line),
scores as (
    select line, licence, round(sum(w * q) / any_value(norm), 6) as score
    from l_w join t_q using (token) join norms using (line) group by line, template, licence
),
own as (
    select path, licence, score from lines join scores using (line) where score >= 0.8
    qualify row_number() over (partition by path order by score desc, licence) = 1
),
votes as (
    select dir, licence from (select regexp_extract(path, '^(.*)/[^/]*$', 1) as dir, licence, count(*) as n from own
                              where regexp_matches(path, '(^|/)LICENSE[.][^/]*$') group by all)
    qualify row_number() over (partition by dir order by n desc, licence) = 1
)
select f.doc_id, f.path, o.licence as own_licence, o.score,
       coalesce(o.licence, v.licence) as licence, case when o.licence is null then v.dir end as licence_of
from files f left join own o using (path)
left join lateral (select dir, licence from votes where starts_with(f.path, dir || '/') order by length(dir) desc limit 1) v on true
""".replace("TEMPLATE_ROWS", _TEMPLATE_ROWS)


def held_out(key: str = "doc_id") -> Column:
    """Rows that no label is learned from."""
    return F.crc32(F.col(key).cast("string")) % 5 == 0


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels").where(~held_out()))
    scored = score(docs, model, keep=["doc_id"])
    return scored.select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op6_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return read_tokens(spark, folder, value=("ids_crc32", "long", lambda ids: zlib.crc32(ids.tobytes())))


def op7_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(table(spark, sf_dir, "documents"), MIX_WEIGHTS)
    return mixed.select("doc_id", "source", "lang", "n_copies", "copy", "place", "text")


OP10_SQL = """
with d as (select *, coalesce(cast(doc_id as varchar), 'null') as id from documents),
s as (
    select source, sum(greatest(length(coalesce(text, '')), 1)) as n_chars,
           case source when 'src0' then 3.0 when 'src1' then 2.0 when 'src2' then 0.5 when 'src3' then 0.25 else 1.0 end::double as weight
    from d group by source
),
rate as (
    select source, weight / (select sum(weight) from s) * (select sum(n_chars)::double from s) / n_chars as rate from s
),
drawn as (
    select d.doc_id, d.source, d.lang, d.text, d.id, r.rate,
           ('0x' || substr(md5('42:' || d.id), 1, 13))::ubigint::double / 4503599627370496.0 as u
    from d join rate r on d.source is not distinct from r.source
),
steps as (select k from range(0, 81) t(k)),
cumulated as (
    select source, rate, k, sum(exp(-rate + case when k = 0 then 0 else k * ln(rate) end - lgamma(k + 1)))
           over (partition by source order by k) as c
    from rate cross join steps
),
counted as (
    select drawn.*, cast((select count(*) from cumulated x where x.source is not distinct from drawn.source and x.c <= drawn.u) as int) as n_copies
    from drawn
),
copies as (select *, cast(unnest(range(0, n_copies)) as int) as copy from counted where n_copies > 0)
select doc_id, source, lang, n_copies, copy,
       ('0x' || substr(md5('42:place:' || id || ':' || copy), 1, 13))::ubigint::double / 4503599627370496.0 as place, text
from copies
"""


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = whiten(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return found.withColumn("deviation", F.col("deviation").cast("long"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, codebooks = compress(table(spark, sf_dir, "embeddings"))
    code = F.lower(F.hex("codes"))
    return found.select("vec_id", code.alias("code"), "error", "label_error", F.lit(digest(codebooks)).alias("codebooks_sha256"))


_OP12_ROUND = """
near{k} as (
    select r, part, entry, dist from (
        select a.r, a.part, b.entry, sum((a.v - b.v) * (a.v - b.v)) as dist
        from parts a join book{k} b using (part, place) group by all
    ) qualify row_number() over (partition by r, part order by dist, entry) = 1
),
sums{k} as (
    select part, entry, place, cast(sum(v) as bigint) as s, count(*) as n from parts join near{k} using (r, part) group by all
),
book{next} as (
    select b.part, b.entry, b.place, case when n is null then v else (s - ((s % n) + n) % n) // n end as v
    from book{k} b left join sums{k} using (part, entry, place)
)"""
OP12_SQL = (
    """
with kept as (
    select row_number() over (order by vec_id, embedding) as r, vec_id, label, embedding
    from embeddings
    where len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
),
cells as (select r, unnest(range(0, len(embedding))) as i, len(embedding) // 16 as size, embedding from kept),
parts as (
    select r, i // size as part, i % size as place, cast(floor(256 * cast(embedding[i + 1] as double)) as bigint) as v from cells
),
book0 as (select part, r - 1 as entry, place, v from parts where r <= 64),"""
    + ",".join(_OP12_ROUND.format(k=k, next=k + 1) for k in (0, 1))
    + """,
near as (
    select r, part, entry, dist from (
        select a.r, a.part, b.entry, sum((a.v - b.v) * (a.v - b.v)) as dist
        from parts a join book2 b using (part, place) group by all
    ) qualify row_number() over (partition by r, part order by dist, entry) = 1
),
coded as (
    select r, string_agg(printf('%02x', entry), '' order by part) as code, cast(sum(dist) as bigint) as error from near group by r
)
select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) as label_error,
       (select sha256(string_agg(cast(v as varchar), ',' order by part, entry, place)) from book2) as codebooks_sha256
from coded join kept using (r)
"""
)


def op13_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = encode_words(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    ids = F.concat_ws(" ", F.col("ids").cast("array<string>"))
    return found.select("doc_id", "n_tokens", F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_rules": op1_quality_rules,
        "op2_simhash_dedup": op2_simhash_dedup,
        "op3_url_filter": op3_url_filter,
        "op4_license_scan": op4_license_scan,
        "op5_quality_classifier": op5_quality_classifier,
        "op6_token_store": op6_token_store,
        "op7_html_extract": op7_html_extract,
        "op8_embedding_dedup": op8_embedding_dedup,
        "op9_byte_bpe": op9_byte_bpe,
        "op10_mixing": op10_mixing,
        "op11_whitening": op11_whitening,
        "op12_vector_codes": op12_vector_codes,
        "op13_word_bpe": op13_word_bpe,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_quality_rules": OP1_SQL, "op3_url_filter": OP3_SQL, "op4_license_scan": OP4_SQL, "op10_mixing": OP10_SQL, "op12_vector_codes": OP12_SQL}
