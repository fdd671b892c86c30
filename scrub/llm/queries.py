"""The registered queries of this subpackage, with production parameters over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scrub.llm import alignment, bpe, embeddings, exact_dedup, minhash, mixing, pii, quality, search, secrets, sharding, substring, token_file
from scrub.session import read_table

#: Places of the public tokenizers' files; None asks the public_tokenizers package.
VOCABULARY: str | None = None
PIECES: str | None = None


def public_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def vocabulary_path() -> str:
    return VOCABULARY or public_file("byte_bpe_50k.json")


def pieces_path() -> str:
    return PIECES or public_file("piece_bpe_32k.model")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(read_table(spark, sf_dir, "documents"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard_documents(read_table(spark, sf_dir, "documents"), shards=16)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_digests(read_table(spark, sf_dir, "documents"))


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_components(read_table(spark, sf_dir, "documents"), k=4, percent=80)


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_digests(read_table(spark, sf_dir, "documents"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encoded_documents(read_table(spark, sf_dir, "documents"), vocabulary_path())


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.repeated_passages(read_table(spark, sf_dir, "documents"))


def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.embedding_links(read_table(spark, sf_dir, "embeddings"))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = search.search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"), k=10)
    return out.select("item_id", "rank", "doc_id", "score")


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.alignment_digests(read_table(spark, sf_dir, "documents"), vocabulary_path(), pieces_path())


def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_file.token_digests(read_table(spark, sf_dir, "documents"), vocabulary_path(), end_id=2)


QUERIES = {
    f.__name__: f
    for f in (
        op1_exact_dedup, op2_quality_classifier, op3_sharding, op4_secret_scan, op5_minhash_near_dedup, op6_pii, op7_bpe, op8_mixing,
        op9_substring_dedup, op10_embedding_near_dedup, op11_ranked_search, op12_alignment, op13_token_files,
    )
}

ORACLE_SQL = {
    "op1_exact_dedup": r"""
        with d as (select doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) as text_sha256 from documents)
        select doc_id, min(doc_id) over w as keep_id, count(*) over w as group_size,
               row_number() over (partition by text_sha256 order by doc_id nulls last) = 1 as kept, text_sha256
        from d window w as (partition by text_sha256)""",
    # Every pair of sets that share a shingle, then the closure of the links.
    "op5_minhash_near_dedup": r"""
        with recursive w as (
            select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                          '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from documents),
        s as (select doc_id, list_distinct(case when len(ws) = 0 then [] when len(ws) < 4 then [array_to_string(ws, ' ')]
                   else list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')) end) as sh from w),
        e as (select doc_id, unnest(sh) as g from s),
        c as (select a.doc_id as a, b.doc_id as b, count(*) as n from e a join e b on a.g = b.g and a.doc_id < b.doc_id group by all),
        l as (select a, b from c join s x on x.doc_id = a join s y on y.doc_id = b where 100 * n >= 80 * (len(x.sh) + len(y.sh) - n)),
        u as (select a, b from l union select b, a from l),
        r as (select doc_id as id, doc_id as o from s union select u.b, r.o from r join u on u.a = r.id),
        m as (select id, min(o) as component_id from r group by id)
        select doc_id, len(sh)::bigint as n_shingles, component_id, doc_id = component_id as kept from s join m on id = doc_id""",
    # Each source's queue in MD5 order, the water level of the targets, and one stream by finish time.
    "op8_mixing": r"""
        with d as (select row_number() over () as rid, doc_id, coalesce('s' || source, 'z') as source,
                          len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size,
                          md5('20240817:' || coalesce(doc_id::varchar, '') || ':' || md5(coalesce(text, ''))) as draw from documents),
        s as (select source, sum(size) as source_size, [3, 1, 2][((row_number() over (order by source)) - 1) % 3 + 1] as weight from d group by source),
        b as (select 1.5::double * sum(size) as budget from d),
        r as (select *, 2 * source_size / weight::double as ratio from s),
        l as (select *, coalesce(sum(2 * source_size) over (order by ratio, source rows between unbounded preceding and 1 preceding), 0) as capped,
                     sum(weight) over (order by ratio, source rows between current row and unbounded following) as open_weight from r),
        v as (select arg_min((budget - capped::double) / open_weight, capped) as level from l, b
              where (budget - capped::double) / open_weight <= ratio),
        t as (select source, source_size, least(source_size * 2.0::double, weight * coalesce(level, 1e300)) as target from s, v),
        q as (select d.*, source_size, target, sum(size) over (partition by d.source order by draw, rid rows unbounded preceding) as sent from d join t using (source)),
        i as (select rid, size, (k * source_size + sent)::double / greatest(target, 1e-300) as f from q, (values (0), (1)) as p(k) where size > 0),
        c as (select rid, sum(size) over (order by f range unbounded preceding) as total from i),
        n as (select rid, count(*) as copies from c, b where total <= budget group by rid)
        select doc_id, size::bigint as size, source_size::bigint as source_size, target, (size * coalesce(copies, 0))::bigint as taken
        from q left join n using (rid)""",
    "op10_embedding_near_dedup": r"""
        with recursive v as (select vec_id, label, embedding::double[] as e from embeddings),
        l as (select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id
              where list_cosine_similarity(a.e, b.e) >= 0.93),
        r as (select vec_id as id, vec_id as o from v union select l.b, r.o from r join l on l.a = r.id),
        m as (select id, min(o) as component_id from r group by id),
        n as (select a, count(*) as n from l group by a)
        select vec_id, coalesce(n, 0)::bigint as n_links, component_id, vec_id = component_id as kept
        from v join m on id = vec_id left join n on a = vec_id""",
    # Every document's score for every item that shares a term with it.
    "op11_ranked_search": r"""
        with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                     '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as ts from documents),
        c as (select doc_id, len(ts)::bigint as n, unnest(ts) as t from d where len(ts) > 0),
        g as (select count(*)::bigint as docs, sum(len(ts))::bigint as terms from d where len(ts) > 0),
        f as (select doc_id, any_value(n) as n, t, count(*)::bigint as tf from c group by doc_id, t),
        q as (select distinct item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                                '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as t from benchmark),
        w as (select t, floor(1000 * ln((2 * any_value(docs) + 2)::double / (2 * count(*) + 1)::double))::bigint as w from f, g group by t),
        s as (select item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // terms))))::bigint as score
              from q join f using (t) join w using (t), g group by item_id, doc_id),
        r as (select item_id, (row_number() over (partition by item_id order by score desc, doc_id))::int as rank, doc_id, score from s where score > 0)
        select item_id, rank, doc_id, score from r where rank <= 10""",
}
