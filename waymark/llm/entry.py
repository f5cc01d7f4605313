"""The dealt queries: each applies one operator to its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.llm import byte_bpe, circulant, compress_lang, curriculum, nn_graph, packing, png_media, preferences, prefix_trie, token_counts, token_store, toxic_crf, whitening
from waymark.llm.folds import held_out
from waymark.llm.scratch import bounded_batches

BYTE_BPE, WORD_BPE, BYTE_RANKS = "byte_bpe_50k.json", "word_bpe_49k.json", "byte_bpe_50k.tiktoken"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE))


def op2_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.read_digests(token_store.write_ids(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE)))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curriculum.plan_mix(table(spark, sf_dir, "documents")).drop("reads")


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = compress_lang.fit_languages(docs, ~held_out())
    rows = compress_lang.classify(docs.withColumns({"doc_id": F.col("doc_id").cast("long"), "held_out": held_out()}), model, keep=["doc_id", "held_out"])
    return rows.select("doc_id", "held_out", "lang_pred", F.col("lang_score").alias("score"), F.col("lang_margin").alias("margin"), F.col("lang_rejected").alias("rejected"))


def op5_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations 2 i (chosen) and 2 i + 1 (rejected) are the pair i."""
    conv = F.col("conv_id").cast("long")
    pairs = preferences.format_pairs(table(spark, sf_dir, "conversations"), F.call_function("shiftright", conv, F.lit(1)), conv.bitwiseAND(F.lit(1)) == 1)
    spans = {c: preferences.spans_text(F.col(c)) for c in ("chosen_spans", "rejected_spans")}
    return pairs.withColumns(spans)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxic_crf.fit_toxicity(docs, table(spark, sf_dir, "labels"), ~held_out())
    rows = toxic_crf.score_toxicity(docs.withColumns({"doc_id": F.col("doc_id").cast("long"), "held_out": held_out()}), model, keep=["doc_id", "held_out"])
    return rows.select("doc_id", "held_out", F.col("toxic_score").alias("score"), F.col("toxic_pred").alias("predicted"), F.size("toxic_spans").alias("n_spans"))


def op7_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nn_graph.nearest_neighbours(table(spark, sf_dir, "embeddings"), lambda i: i % 50 == 0)


def op8_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_BPE), with_ids=False).drop("ids")


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = png_media.store_media(png_media.to_media(table(spark, sf_dir, "documents")))
    return png_media.media_features(media).drop("hash")


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return circulant.near_duplicates(table(spark, sf_dir, "documents"), k=3, share=(85, 100))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations take up to eight first turns from the one with which their group of five begins."""
    own = prefix_trie.number_turns(table(spark, sf_dir, "conversations"))
    rebuilt = prefix_trie.with_heads(own, lambda c: c - c % 5, lambda c: F.crc32(c.cast("string").cast("binary")) % 9, most=8)
    return prefix_trie.prefix_trie(rebuilt)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened_components(whitening.on_grid(table(spark, sf_dir, "embeddings")))


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids and of the bytes that the ids decode to."""
    path = public_tokenizers.path(BYTE_RANKS)
    rows = byte_bpe.encode_texts(table(spark, sf_dir, "documents"), path, decoded=True)
    joined = F.array_join(F.col("ids").cast("array<string>"), " ")
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def _bounded(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: query(bounded_batches(spark), sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: _bounded(f) for f in (op1_token_counts, op2_token_ids, op3_mix_sources, op4_language, op5_preferences, op6_toxicity, op7_neighbours, op8_pack, op9_media, op10_near_duplicates, op11_prefix_trie, op12_whitening, op13_byte_bpe)
}
ORACLE_SQL: dict[str, str] = {
    "op5_preferences": r"""
with t as (select conv_id >> 1 as pair_id, conv_id & 1 as side, coalesce(role, '') as role, coalesce(text, '') as text,
                  row_number() over (partition by conv_id order by turn, coalesce(role, ''), coalesce(text, '')) as i
           from conversations where conv_id is not null),
b as (select coalesce(x.pair_id, y.pair_id) as pair_id, coalesce(x.i, y.i) as i,
             x.role is not distinct from y.role and x.text is not distinct from y.text as same
      from (from t where side = 0) x full join (from t where side = 1) y on x.pair_id = y.pair_id and x.i = y.i),
n as (select pair_id, coalesce(min(i) filter (where not same) - 1, max(i)) as n from b group by 1),
r as (select t.*, n.n, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) as s from t join n using (pair_id)),
p as (select *, coalesce(sum(length(s)) over (partition by pair_id, side, i > n order by i rows between unbounded preceding and 1 preceding), 0)::bigint as ofs from r),
q as (select *, (ofs + length(role) + 5) || '-' || (ofs + length(s)) as span from p)
select pair_id, any_value(n)::int as n_shared,
       coalesce(string_agg(s, '' order by i) filter (where i <= n and side = 0), '') as prompt,
       coalesce(string_agg(s, '' order by i) filter (where i > n and side = 0), '') as chosen,
       coalesce(string_agg(s, '' order by i) filter (where i > n and side = 1), '') as rejected,
       coalesce(string_agg(span, ',' order by i) filter (where i > n and side = 0 and role = 'assistant'), '') as chosen_spans,
       coalesce(string_agg(span, ',' order by i) filter (where i > n and side = 1 and role = 'assistant'), '') as rejected_spans
from q group by 1
""",
    "op11_prefix_trie": r"""
with o as (select conv_id, row_number() over (partition by conv_id order by turn nulls first, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) as i,
                  sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) as t, strlen(coalesce(text, '')) as b
           from conversations where conv_id is not null),
c as (select conv_id, conv_id - conv_id % 5 as head,
             xor(list_reduce([4294967295::bigint] || list_transform(string_split(conv_id::varchar, ''), lambda s: ascii(s)::bigint),
                             lambda a, x: list_reduce([xor(a, x)] || range(8), lambda y, k: xor(y >> 1, 3988292384 * (y & 1)))), 4294967295) % 9 as h
      from (select distinct conv_id from o)),
r as (select c.conv_id, o.i, o.t, o.b from c join o on o.conv_id = c.head and o.i <= c.h
      union all select c.conv_id, o.i + 100, o.t, o.b from c join o on o.conv_id = c.conv_id and o.i > c.h),
-- Each conversation's prefixes, the empty one with them, and the bytes from a depth on.
p as (select conv_id, row_number() over w as d, sha256(string_agg(t, ',') over w) as p, b,
             sum(b) over (partition by conv_id order by i desc) as rest from r window w as (partition by conv_id order by i)
      union all select c.conv_id, 0, '', 0, coalesce((select sum(b) from r where r.conv_id = c.conv_id), 0) from c),
m as (select *, min(conv_id) over (partition by p, d) as owner, max(d) over (partition by conv_id) as len from p),
k as (select q.p, q.d, count(distinct n.p) as n_children from m q left join m n on n.conv_id = q.conv_id and n.d = q.d + 1 group by 1, 2),
-- Bytes of the distinct nodes from a depth on that a conversation owns, and whether it owns a leaf.
w as (select m.*, k.n_children, sum(case when m.owner = m.conv_id then m.b else 0 end) over (partition by m.conv_id order by m.d desc) as owned,
             max((m.owner = m.conv_id and k.n_children = 0)::int) over (partition by m.conv_id) as leaf from m join k on m.p = k.p and m.d = k.d)
select any_value(w.owner) as conv_id, w.d::bigint as depth, any_value(u.owner) as parent_conv_id, count(*)::bigint as n_convs, any_value(w.n_children)::bigint as n_children,
       sum(w.leaf)::bigint as n_leaves, (sum(w.rest) - sum(w.owned))::bigint as saved_tokens,
       sha256(coalesce(string_agg(case when w.d = w.len then w.conv_id::varchar end, ',' order by w.conv_id), '')) as ends_sha256
from w left join m u on u.conv_id = w.conv_id and u.d = w.d - 1 group by w.p, w.d
""",
    "op3_mix_sources": r"""
with d as (select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
                  md5(coalesce(doc_id::varchar, 'null' || coalesce(text, ''))) as k
           from documents),
s as (select source, sum(size)::bigint as source_size from d group by source),
w as (select *, ((row_number() over (order by source nulls last)) - 1) % 3 as class, [5.0::double, 2.0::double, 1.0::double][class + 1] as w from s),
r as (select *, (3 * source_size)::double as cap, (3 * source_size)::double / w as ratio from w),
l as (select *, (sum(source_size) over ())::double as total, sum(w) over () as all_w,
             coalesce(sum(cap) over o, 0) as capped, coalesce(sum(w) over o, 0) as capped_w
      from r window o as (order by ratio, source nulls last rows between unbounded preceding and 1 preceding)),
v as (select *, (total - capped) / (all_w - capped_w) as lv from l),
t as (select source, source_size, class, least(cap, coalesce((select arg_min(lv, (ratio, source)) from v where lv <= ratio), 0) * w) as target from v),
c as (select d.doc_id, d.size, t.source_size, t.target, t.class, floor(t.target + 0.5)::bigint as goal,
             (coalesce(sum(d.size) over (partition by d.source order by d.k, d.doc_id, d.size
                       rows between unbounded preceding and 1 preceding), 0))::bigint as start
      from d join t on d.source is not distinct from t.source),
-- Rates at times 0, 1/2 and 1: 1.5, 1, 0.5; 1, 1, 1; 0.5, 1, 1.5. By 1/2 they have asked for x; p solves a p + b p^2 / 2 = share - asked.
k as (select *, (start + greatest(0, least(size, goal - start)) / 2.0::double) / nullif(target, 0) as share,
             [0.625::double, 0.5::double, 0.375::double][class + 1] as x, [1.5::double, 1.0::double, 0.5::double][class + 1] as a,
             [-2.0::double, 0.0::double, 2.0::double][class + 1] as b2 from c),
e as (select *, share <= x as early, case when share <= x then share else share - x end as area, case when share <= x then a else 1.0::double end as rate from k)
select doc_id, size, source_size, target,
       case when size > 0 and goal > start
            then least(case when early then 0.5::double else 1.0::double end, case when early then 0.0::double else 0.5::double end
                       + coalesce((2 * area) / (rate + sqrt(greatest(rate * rate + b2 * area, 0.0::double))), 0.0::double)) end as position,
       (greatest(0, least(size, goal - start)) + greatest(0, least(size, goal - start - source_size))
        + greatest(0, least(size, goal - start - 2 * source_size)))::bigint as taken
from e
""",
}
