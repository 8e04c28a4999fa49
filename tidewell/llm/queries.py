"""Queries on the corpus tables, one for each operator, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, collocations, decon, documents, extract, knn, lines, negatives, passages, quality, secrets, shard


def tokenizer(name: str = "word_bpe_49k.json") -> str:
    """The vocabulary file, where public_tokenizers has it; read by the driver alone."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer())


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard.shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op4_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn.top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)


def op5_near_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.near_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), width=3, percent=85)


def op6_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("kept")


def op7_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decon.find_items(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op9_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(secrets.scan_documents(spark.read.parquet(f"{sf_dir}/documents.parquet")))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op12_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    noisy = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(rows.withColumn("label", noisy), F.col("vec_id") % 100 == 0)


def op13_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    odd = spark.sql("select conv_id, turn, role, '</s>[INST] ok [/INST]' as text from values (-7L, 0L, 'user'), (-7L, 1L, 'assistant') as t(conv_id, turn, role)")
    return chat.digests(chat.formatted(rows.unionByName(odd)))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "pipeline": pipeline,
    "op1_bpe": op1_bpe,
    "op2_quality": op2_quality,
    "op3_sharding": op3_sharding,
    "op4_knn": op4_knn,
    "op5_near_documents": op5_near_documents,
    "op6_passages": op6_passages,
    "op7_lines": op7_lines,
    "op8_decontamination": op8_decontamination,
    "op9_extract": op9_extract,
    "op10_secrets": op10_secrets,
    "op11_collocations": op11_collocations,
    "op12_negatives": op12_negatives,
    "op13_chat": op13_chat,
}
SQL: dict[str, str] = {
    "op4_knn": """
with v as (
    select vec_id, list_transform(embedding, lambda x: cast(floor(64 * cast(x as double)) as bigint)) as e
    from embeddings
    where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
    select q.vec_id as query_id, d.vec_id, cast(list_sum(list_transform(list_zip(q.e, d.e), lambda p: p[1] * p[2])) as bigint) as score
    from v q join v d on q.vec_id % 20 = 0 and q.vec_id <> d.vec_id
), r as (
    select query_id, cast(row_number() over (partition by query_id order by score desc, vec_id) as integer) as rank, vec_id, score from s
)
select * from r where rank <= 20
""",
    "op11_collocations": r"""
with pieces as (
    select coalesce(lang, 'und') as lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece
    from documents
), p as (
    select lang, list_filter(string_split_regex(piece, '[ \t]+'), lambda x: x <> '') as w from pieces
), one as (
    select lang, x, count(*) as f from (select lang, unnest(w) as x from p) group by all
), two as (
    select lang, x, y, count(*) as f from (select lang, w[i] as x, w[i + 1] as y from (select lang, w, unnest(range(1, len(w))) as i from p)) group by all
), three as (
    select lang, x, y, z, count(*) as f from (select lang, w[i] as x, w[i + 1] as y, w[i + 2] as z from (select lang, w, unnest(range(1, len(w) - 1)) as i from p)) group by all having count(*) >= 10
), n as (
    select lang, sum(f) as n from one group by lang
), longer as (
    select lang, x, y, max(f) as longer from (select lang, x, y, f from three union all select lang, y, z, f from three) group by all
), c2 as (
    select t.lang, t.x || ' ' || t.y as phrase, t.f as a, p.f as l, q.f as r, cast(1000000 as hugeint) * t.f * t.f // (cast(p.f as hugeint) * q.f) as score
    from two t join one p on p.lang = t.lang and p.x = t.x join one q on q.lang = t.lang and q.x = t.y
    left join longer g on g.lang = t.lang and g.x = t.x and g.y = t.y
    where t.f >= 10 and (g.longer is null or 100 * g.longer < 50 * t.f)
), cuts as (
    select t.lang, t.x || ' ' || t.y || ' ' || t.z as phrase, t.f as a, p.f as l1, yz.f as r1, xy.f as l2, q.f as r2,
        cast(1000000 as hugeint) * t.f * t.f // (cast(p.f as hugeint) * yz.f) as s1, cast(1000000 as hugeint) * t.f * t.f // (cast(xy.f as hugeint) * q.f) as s2
    from three t join one p on p.lang = t.lang and p.x = t.x join one q on q.lang = t.lang and q.x = t.z
    join two xy on xy.lang = t.lang and xy.x = t.x and xy.y = t.y join two yz on yz.lang = t.lang and yz.x = t.y and yz.y = t.z
), scored as (
    select * from c2
    union all
    select lang, phrase, a, if(s1 <= s2, l1, l2), if(s1 <= s2, r1, r2), least(s1, s2) from cuts
), ranked as (
    select *, row_number() over (partition by lang order by score desc, a desc, phrase) as rank from scored
)
select lang, rank, phrase, a, l, r, cast(n as bigint) as n, cast(score as bigint) as score from ranked join n using (lang) where rank <= 2000
""",
    "op12_negatives": """
with v as (
    select vec_id, if(vec_id % 7 = 0, (label + 1) % 10, label) as label, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as e
    from embeddings
    where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
    select a.vec_id as anchor_id, d.vec_id, a.label = d.label as same, cast(list_sum(list_transform(list_zip(a.e, d.e), lambda p: p[1] * p[2])) as bigint) as score
    from v a join v d on a.vec_id % 100 = 0 and a.vec_id <> d.vec_id
), p as (
    select anchor_id, vec_id as positive_id, score as positive_score from s where same qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5
)
select anchor_id, positive_id, cast(row_number() over (partition by anchor_id, positive_id order by score desc, vec_id) as integer) as rank, vec_id as negative_id, positive_score, score as negative_score
from p join s using (anchor_id)
where not same and 80 * positive_score <= 100 * score and score <= positive_score
qualify rank <= 5
""",
    "op13_chat": r"""
with c as (
    select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
    union all
    select -7, i, if(i = 0, 'user', 'assistant'), '</s>[INST] ok [/INST]' from range(2) t(i)
), t as (
    select *, role || chr(10) || text || chr(10) as said, len(role) + len(text) + len('<|im_start|><|im_sep|><|im_end|>')
        + len(regexp_extract_all(role || chr(10) || text, '<\\*(\|(im_start|im_sep|im_end|start_header_id|end_header_id|eot_id|begin_of_text|endoftext)\|>|/?s>|</?SYS>>)|\[\\*/?INST\]')) as chars
    from c
)
select conv_id, count(*) as n_turns, sha256(string_agg(said, '' order by turn, role, text)) as turns_sha256,
    cast(coalesce(sum(len(text)) filter (role = 'assistant'), 0) as bigint) as loss_chars, sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
    cast(sum(chars) as bigint) as formatted_chars
from t group by conv_id
""",
}
