"""The queries of the training-data operators, with production parameters, and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_cnn, chat, decontaminate, minhash, outliers, pfair, substring, toxicity, url_reputation, warc
from .common import held_out, table


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    nearest = F.get("evidence", F.lit(0))
    return out.select("doc_id", held_out().alias("held_out"), "score", "predicted", "neighbours", nearest.alias("nearest_id"), "similarity")


def op3_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes: the label table read by page_id, bad where quality is 0."""
    outcomes = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), (1 - F.col("quality")).alias("bad"))
    return url_reputation.judge(table(spark, sf_dir, "pages"), outcomes)


def op4_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outliers.judge(table(spark, sf_dir, "documents")).drop("distance")


def op5_byte_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = byte_cnn.score(docs, byte_cnn.fit(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op6_pfair_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pfair.mix(table(spark, sf_dir, "documents"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), words=2, percent=80)


def op9_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.deduplicate(table(spark, sf_dir, "documents"), size=13)


def op10_chat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotate(table(spark, sf_dir, "conversations"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_warc, op2_toxicity, op3_url_reputation, op4_outliers, op5_byte_cnn, op6_pfair_mix, op7_decontaminate, op8_minhash, op9_substring, op10_chat_rotation, pipeline)}

_WORDS = r"list_filter(regexp_split_to_array({}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL = {
    "op1_warc": """
        with p as (select page_id, coalesce(html, '') h, sha256(coalesce(html, '')) d, octet_length(encode(coalesce(html, ''))) n from pages),
        g as (select d, min(page_id) f from p where n >= 100 group by d)
        select p.page_id, cast(n as bigint) payload_bytes, p.d payload_digest,
          case when f is not null and f <> p.page_id then 'revisit' else 'response' end record_type,
          case when f <> p.page_id then f end refers_to
        from p left join g on p.d = g.d
    """,
    "op3_url_reputation": r"""
        with u as (select page_id, coalesce(url, '') url from pages),
        r as (select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end rest from u),
        s as (select page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host,
          regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1) path from r),
        rules(verdict, rule, h, p) as (values ('allow', 'com/', 'com', '/'), ('block', 'example.com/en/', 'example.com', '/en/'),
          ('allow', 'www.example.com/en/', 'www.example.com', '/en/'), ('block', 'net/es/', 'net', '/es/'), ('block', 'net/fr/', 'net', '/fr/')),
        m as (select page_id, host, path, arg_max(rule, length(rule)) rule, arg_max(verdict, length(rule)) listed
          from s join rules on (host = h or ends_with(host, '.' || h)) and starts_with(path, p) group by all),
        l as (select doc_id page_id, max(1 - quality) bad from labels where quality is not null group by all),
        o as (select host, bad from s join l using (page_id) where host <> ''),
        hosts as (select host, case when regexp_matches(array_to_string(string_split(host, '.')[-2:], '.'), '^(ac|asso|co|com|edu|go|gob|gov|gouv|gv|info|ltd|me|mil|ne|net|nhs|nom|or|org|plc|sch)[.][a-z][a-z]$')
            then array_to_string(string_split(host, '.')[-3:], '.') else array_to_string(string_split(host, '.')[-2:], '.') end dom,
          case when regexp_matches(array_to_string(string_split(host, '.')[-2:], '.'), '^(ac|asso|co|com|edu|go|gob|gov|gouv|gv|info|ltd|me|mil|ne|net|nhs|nom|or|org|plc|sch)[.][a-z][a-z]$')
            then array_to_string(string_split(host, '.')[-2:], '.') else string_split(host, '.')[-1] end suf,
          count(*)::double n, sum(bad)::double bad from o group by all),
        doms as (select dom, suf, sum(n) n, sum(bad) bad from hosts group by all),
        sufs as (select suf, sum(n) n, sum(bad) bad from doms group by all),
        s1 as (select *, (select sum(bad) / sum(n) from sufs) prior from sufs),
        sm as (select sum((bad - n * prior) * (bad - n * prior) - n * prior * (1 - prior)) a, sum(n * (n - 1) * prior * (1 - prior)) b from s1 where n > 1),
        sx as (select round(case when b > 0 then case when a / b <= 0.001 then 1000.0 else greatest(1.0, b / a - 1) end else 10.0 end, 6) m from sm),
        s2 as (select suf, (bad + m * prior) / (n + m) rate from s1, sx),
        d1 as (select dom, n, bad, rate prior from doms join s2 using (suf)),
        dm as (select sum((bad - n * prior) * (bad - n * prior) - n * prior * (1 - prior)) a, sum(n * (n - 1) * prior * (1 - prior)) b from d1 where n > 1),
        dx as (select round(case when b > 0 then case when a / b <= 0.001 then 1000.0 else greatest(1.0, b / a - 1) end else 10.0 end, 6) m from dm),
        d2 as (select dom, (bad + m * prior) / (n + m) rate from d1, dx),
        h1 as (select host, n, bad, rate prior from hosts join d2 using (dom)),
        hm as (select sum((bad - n * prior) * (bad - n * prior) - n * prior * (1 - prior)) a, sum(n * (n - 1) * prior * (1 - prior)) b from h1 where n > 1),
        hx as (select round(case when b > 0 then case when a / b <= 0.001 then 1000.0 else greatest(1.0, b / a - 1) end else 10.0 end, 6) m from hm),
        h2 as (select host, bad + m * prior a, n - bad + m * (1 - prior) b from h1, hx),
        h3 as (select host from h2 where round(a / (a + b) - 1.645 * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))), 9) > 0.5)
        select s.page_id, s.host, s.path, m.rule, coalesce(listed, case when h3.host is not null then 'block' end, 'allow') verdict
        from s left join (select distinct page_id, host, path, rule, listed from m) m on s.page_id = m.page_id and s.host = m.host and s.path = m.path
        left join h3 on s.host = h3.host
    """,
    "op8_minhash": f"""
        with recursive w as (select doc_id, {_WORDS.format(_LOWER)} ws from documents),
        s as (select distinct doc_id, unnest(case when len(ws) > 1 then list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]) else ws end) s from w),
        n as (select doc_id, count(*) n from s group by doc_id),
        l as (select a.doc_id a, b.doc_id b from s a join s b on a.s = b.s and a.doc_id < b.doc_id join n x on x.doc_id = a.doc_id join n y on y.doc_id = b.doc_id
          group by a.doc_id, b.doc_id, x.n, y.n having 100 * count(*) >= 80 * (x.n + y.n - count(*))),
        e as (select a, b from l union all select b, a from l),
        r as (select doc_id a, doc_id b from documents union select r.a, e.b from r join e on r.b = e.a),
        c as (select a doc_id, min(b) component_id from r group by a)
        select d.doc_id, coalesce(n.n, 0) n_shingles, c.component_id, d.doc_id = c.component_id kept
        from documents d left join n using (doc_id) left join c using (doc_id)
    """,
    "op9_substring": f"""
        with w as (select doc_id, {_WORDS.format("coalesce(text, '')")} ws from documents),
        win as (select doc_id, i, array_to_string(ws[i : i + 12], ' ') x from (select doc_id, ws, unnest(range(1, len(ws) - 11)) i from w where len(ws) >= 13)),
        f as (select x, min(doc_id) m from win group by x),
        gone as (select distinct doc_id, unnest(range(i, i + 13)) p from win join f using (x) where m < doc_id),
        pos as (select doc_id, unnest(ws) t, unnest(range(1, len(ws) + 1)) p from w),
        kept as (select pos.doc_id, count(*) k, string_agg(t, ' ' order by pos.p) t from pos left join gone on pos.doc_id = gone.doc_id and pos.p = gone.p where gone.p is null group by pos.doc_id)
        select w.doc_id, len(ws) n_words, len(ws) - coalesce(k, 0) n_removed, sha256(coalesce(t, '')) kept_sha256 from w left join kept using (doc_id)
    """,
    "op10_chat_rotation": r"""
        with t as (select conv_id, turn, translate(replace(replace(coalesce(role, 'unknown'), '<|im_start|>', '<\|im_start|>'), '<|im_end|>', '<\|im_end|>'), chr(13) || chr(10), '  ') speaker,
          replace(replace(coalesce(text, ''), '<|im_start|>', '<\|im_start|>'), '<|im_end|>', '<\|im_end|>') text, count(*) copies from conversations
          where conv_id is not null and turn is not null group by all),
        who as (select distinct conv_id, speaker perspective from t where speaker <> 'system'),
        b as (select *, case when speaker = 'system' then speaker when speaker = perspective then 'assistant' else 'user' end as r from t join who using (conv_id)),
        h as (select *, '<|im_start|>' || r || case when r = 'user' then ' name=' || speaker else '' end || chr(10) head from b),
        s as (select *, head || text || '<|im_end|>' || chr(10) segment from h),
        p as (select *, coalesce(sum(length(segment)) over (partition by conv_id, perspective order by turn, speaker, text rows between unbounded preceding and 1 preceding), 0)::bigint as start from s)
        select conv_id, perspective, turn, r as role, case when r = 'user' then speaker end as name, segment, start, (start + length(segment))::bigint as stop,
          case when speaker <> 'system' and speaker = perspective then start + length(head) end as mask_start,
          case when speaker <> 'system' and speaker = perspective then start + length(segment) - 1 end as mask_stop, copies from p
    """,
}
