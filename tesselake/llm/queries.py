"""One query for each operator, over its whole table, with the parameters meant for production."""

from __future__ import annotations

import hashlib

from tesselake.llm.common import shared_dir, table


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_neighbours(spark, sf_dir):
    from tesselake.llm import neighbours

    vectors = table(spark, sf_dir, "embeddings")
    return neighbours.nearest(vectors, vectors.where("vec_id % 20 = 0"))


def op2_toxicity(spark, sf_dir):
    from tesselake.llm import toxicity

    docs = table(spark, sf_dir, "documents")
    return toxicity.score_toxicity(docs, toxicity.train(*toxicity.training_sample(docs, table(spark, sf_dir, "labels"))))


def op3_substring_dedup(spark, sf_dir):
    from pyspark.sql import functions as F

    from tesselake.llm import substring

    kept = substring.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(substring.kept_words(), 256).alias("kept_sha256"))


def op4_decontamination(spark, sf_dir):
    from tesselake.llm import decontaminate

    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_token_counts(spark, sf_dir):
    from tesselake.llm import tokens

    return tokens.token_counts(table(spark, sf_dir, "documents"), _tokenizer("piece_bpe_32k.model"))


def op6_byte_bpe(spark, sf_dir):
    import public_tokenizers

    from tesselake.llm import tokens

    return tokens.byte_bpe(table(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op7_sharding(spark, sf_dir):
    from tesselake.llm import sharding

    return sharding.shard_documents(table(spark, sf_dir, "documents"), store=f"{shared_dir(spark)}/slot-maps/{hashlib.sha256(sf_dir.encode()).hexdigest()[:16]}")


def op8_main_text(spark, sf_dir):
    from tesselake.llm import html

    return html.main_text(table(spark, sf_dir, "pages"))


def op9_near_duplicates(spark, sf_dir):
    from tesselake.llm import neardup

    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op10_language(spark, sf_dir):
    from tesselake.llm import langid

    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.training_sample(docs))


QUERIES = {f.__name__: f for f in (op1_neighbours, op2_toxicity, op3_substring_dedup, op4_decontamination, op5_token_counts, op6_byte_bpe, op7_sharding, op8_main_text, op9_near_duplicates, op10_language)}
#: The queries whose rows SQL can tell. The others need trained models, tokenizers, markup, hashes or checksums that DuckDB's SQL
#: lacks, or are approximate (op1); they are tested against brute force instead.
ORACLE_SQL: dict[str, str] = {
    "op3_substring_dedup": r"""
with docs as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as l from documents),
places as (select doc_id, unnest(range(1, greatest(1, len(l) - 11))) as i, l from docs),
windows as (select doc_id, i, array_to_string(l[i:i + 12], ' ') as w from places),
firsts as (select w, min(doc_id) as f from windows group by w),
hit as (select doc_id, i from windows join firsts using (w) where f < doc_id),
gone as (select distinct doc_id, i + k as pos from hit, (select unnest(range(0, 13)) as k)),
words as (select doc_id, unnest(l) as word, unnest(range(1, len(l) + 1)) as pos from docs),
kept as (select doc_id, string_agg(word, ' ' order by pos) as t, count(*) as n from words anti join gone using (doc_id, pos) group by doc_id)
select doc_id, len(l) as n_words, len(l) - coalesce(n, 0) as n_removed, sha256(coalesce(t, '')) as kept_sha256 from docs left join kept using (doc_id)""",
    "op9_near_duplicates": r"""
with recursive docs as (select doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\x20\x09-\x0D]+') as l from documents),
shingles as (
  select doc_id, array_to_string(l[i:i + 4], ' ') as s, count(*) as tf from (select doc_id, l, unnest(range(1, len(l) - 3)) as i from docs where len(l) >= 5) group by all
  union all select doc_id, array_to_string(l, ' '), 1 from docs where len(l) between 1 and 4),
known as (select s, count(*) as df from shingles group by s),
weighed as (select doc_id, s, tf * (1 + ln(n / df) / ln(greatest(2, n))) as w from shingles join known using (s), (select count(*)::double as n from documents)),
sums as (select doc_id, sum(w) as t from weighed group by doc_id),
shared as (select a.doc_id as u, b.doc_id as v, sum(least(a.w, b.w)) as m from weighed a join weighed b on a.s = b.s and a.doc_id < b.doc_id group by all),
links as (select u, v from shared join sums x on x.doc_id = u join sums y on y.doc_id = v where m >= 0.8 * (x.t + y.t - m)),
both_ways as (select u, v from links union all select v, u from links),
reach(doc_id, c) as (select doc_id, doc_id from docs union select v, c from reach join both_ways on u = reach.doc_id)
select doc_id, min(c) as class_id from reach group by doc_id""",
}
