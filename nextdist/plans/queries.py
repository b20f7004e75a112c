"""The registered queries over the given tables, and their SQL.

Two token streams are made from the tables: ``events``, five types, one sequence per user; and
``documents``, words split at single blanks, ids by frequency.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import abbreviated, joined, r6
from ..operators import counts as C
from ..operators import growth as G
from ..operators import lookup as L
from ..operators import shards as S
from ..operators import support as U
from ..operators import tokens as K
from ..operators import windows as P
from ..operators.sorted_stats import context_next_counts_sorted, level_stats_sorted
from ..sources.shared import saved

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]
T = 3
VOCAB = 500


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# --- bases -----------------------------------------------------------------------------------------


def event_tokens(spark: SparkSession, d: str) -> DataFrame:
    """``(pos, doc_id, token)``: all users' events one after the other; positions by a two-level prefix sum.

    A user's events are ranked within days, and days by their sizes, so a user with a third of all
    events is no task of its own.
    """
    from pyspark.sql import Window as W

    e = table(spark, d, "events").select("user_id", "ts", "event_id", "event_type")
    e = e.withColumn("day", F.to_date("ts"))
    per = e.groupBy("user_id", "day").agg(F.count("*").alias("n"))
    users = per.groupBy("user_id").agg(F.sum("n").alias("n"))
    at = K.exclusive_offsets(users, "user_id", "n")
    w = W.partitionBy("user_id").orderBy("day").rowsBetween(W.unboundedPreceding, -1)
    per = per.join(at, "user_id").select("user_id", "day", (F.col("offset") + F.coalesce(F.sum("n").over(w), F.lit(0))).alias("at"))
    rank = F.row_number().over(W.partitionBy("user_id", "day").orderBy("ts", "event_id")) - 1
    ids = F.coalesce(*[F.when(F.col("event_type") == t, i) for i, t in enumerate(EVENT_TYPES)])
    e = e.withColumn("r", rank).join(per, ["user_id", "day"])
    return e.select((F.col("at") + F.col("r")).alias("pos"), F.col("user_id").alias("doc_id"), ids.alias("token"))


def event_windows(spark: SparkSession, d: str, T: int = T, stride: int = 1) -> DataFrame:
    """Windows inside one user's events; ``start`` is the place in the whole stream. Written once, as most queries read them more than once."""
    return saved(P.sliding_windows(event_tokens(spark, d), T, stride, by_document=True), "event-windows")


def event_counts(spark: SparkSession, d: str, T: int = T) -> DataFrame:
    return C.context_next_counts(event_windows(spark, d, T), T)


def documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents")


def doc_tokens(spark: SparkSession, d: str, size: int = VOCAB) -> DataFrame:
    docs = documents(spark, d)
    return K.encode_words(docs, K.word_vocab(docs, size), size, size=size)


def doc_sequences(spark: SparkSession, d: str, size: int = VOCAB, vocab: DataFrame | None = None, spread: bool = True) -> DataFrame:
    docs = documents(spark, d)
    seqs = K.encode_sequences(docs, vocab or K.word_vocab(docs, size), size, size)
    return saved(K.spread(docs, seqs) if spread else seqs, "doc-sequences")


def doc_windows(spark: SparkSession, d: str, T: int = T, stride: int = 1) -> DataFrame:
    return P.windows_within_documents(doc_sequences(spark, d), T, stride)


def doc_stream(spark: SparkSession, d: str) -> DataFrame:
    return K.flatten_stream(doc_sequences(spark, d, spread=False))  # which deals them out by their place


def text(df: DataFrame, *names: str) -> DataFrame:
    """Array columns as text, so that both engines agree on their type."""
    return df.select(*[joined(c).alias(c) if c in names else F.col(c) for c in df.columns])


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*[r6(F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


# --- SQL of the bases ------------------------------------------------------------------------------

ETOK = """etok as (select user_id as doc_id, case event_type when 'click' then 0 when 'error' then 1 when 'purchase' then 2 when 'signup' then 3 else 4 end as token,
 row_number() over (order by user_id, ts, event_id) - 1 as pos from events)"""


def windows_sql(src: str, T: int, where: str = "true", by_doc: bool = True) -> str:
    part = "partition by doc_id " if by_doc else ""
    leads = ", ".join(f"lead(token, {k}) over w as t{k}" for k in range(1, T + 1))
    return f"win as (select doc_id, start, {', '.join(f't{k}' for k in range(T + 1))} from (select doc_id, pos as start, token as t0, {leads} from {src} window w as ({part}order by pos)) where t{T} is not null and {where})"


def counts_sql(T: int, win: str = "win", name: str = "cn") -> str:
    parts = []
    for k in range(1, T + 1):
        ctx = " || '-' || ".join(f"t{i}" for i in range(k))
        parts.append(f"select {k} as level, ({ctx})::varchar as context, t{k} as next, count(*) as cnt from {win} group by all")
    return f"{name} as ({' union all '.join(parts)})"


TOTALS = """tot as (select level, context, sum(cnt)::bigint as n, count(*) as support, case when count(*) = 1 then 0.0 else ln(sum(cnt)) - sum(cnt * ln(cnt)) / sum(cnt) end as h, sum(cnt * cnt)::double as sq from cn group by level, context)"""
STATS = """st as (select level, sum(n * h) as total_entropy, coalesce(sum(case when support > 1 then n * h / ln(support) end), 0.0) as total_uniformity, sum(n)::bigint as total_visits, count(*) as unique_nodes,
 sum(support)::bigint as total_support, count(*) filter (support = 1) as onehot_contexts, coalesce(sum(n) filter (support = 1), 0)::bigint as onehot_visits, sum(support * n)::bigint as visit_support from tot group by level)"""
STATS_OUT = """select level, round(total_entropy, 6) + 0.0 as total_entropy, round(total_uniformity, 6) + 0.0 as total_uniformity, total_visits, unique_nodes, total_support, onehot_contexts, onehot_visits, visit_support,
 round(total_entropy / total_visits, 6) + 0.0 as avg_entropy, round(total_uniformity / total_visits, 6) + 0.0 as avg_uniformity, round(total_support / unique_nodes, 6) + 0.0 as avg_support_per_context, round(visit_support / total_visits, 6) + 0.0 as avg_support_per_visit from st"""
DTOK = f"""words as (select doc_id, unnest(string_split(text, ' ')) as piece, generate_subscripts(string_split(text, ' '), 1) - 1 as pos from documents),
vocab as (select piece, freq, row_number() over (order by freq desc, piece) - 1 as token from (select piece, count(*) as freq from words group by piece) qualify token < {VOCAB}),
dtok as (select doc_id, pos, coalesce(token, {VOCAB}) as token from words left join vocab using (piece))"""
DSTREAM = "dstream as (select doc_id, row_number() over (order by doc_id, pos) - 1 as pos, token from dtok)"
EWIN = f"with {ETOK}, {windows_sql('etok', T)}"
ECN = f"{EWIN}, {counts_sql(T)}"
DWIN = f"with {DTOK}, {windows_sql('dtok', T)}"
DCN = f"{DWIN}, {counts_sql(T)}"
PAIRS = "pc as (select t0, t1, count(*) as cnt from win group by t0, t1)"


# --- text and tokens (K, S) ------------------------------------------------------------------------


@register("k1_normalize", r"select doc_id, regexp_replace(text, '^[\s\x0b]+|[\s\x0b]+$', '', 'g') as text from documents")
def k1(spark, d):
    return K.normalize(documents(spark, d)).select("doc_id", "text")


@register("k2_drop_blank", r"select doc_id from documents where regexp_replace(coalesce(text, ''), '^[\s\x0b]+|[\s\x0b]+$', '', 'g') <> ''")
def k2(spark, d):
    return K.drop_blank(documents(spark, d)).select("doc_id")


@register("k3_word_vocab", f"with {DTOK} select token::integer as token, piece, freq from vocab")
def k3(spark, d):
    return K.word_vocab(documents(spark, d), VOCAB)


@register("k5_encode_words", f"with {DTOK}, n as (select doc_id, count(*) as n from dtok group by doc_id) select doc_id, pos + 1 as pos, token::integer as token from dtok union all select doc_id, 0, {VOCAB + 1} from n union all select doc_id, n + 1, {VOCAB + 2} from n")
def k5(spark, d):
    docs = documents(spark, d)
    return K.encode_words(docs, K.word_vocab(docs, VOCAB), VOCAB, VOCAB + 1, VOCAB + 2, size=VOCAB)


@register("k6_decode_words", f"with {DTOK} select doc_id, string_agg(coalesce(v.piece, '<unk>'), ' ' order by pos) as text from dtok left join vocab v using (token) group by doc_id")
def k6(spark, d):
    docs = documents(spark, d)
    vocab = saved(K.word_vocab(docs, VOCAB), "vocab")
    return K.decode_words(K.encode_words(docs, vocab, VOCAB, size=VOCAB), vocab)


@register("k7_append_separator", f"with {DTOK} select doc_id, string_agg(token::varchar, '-' order by pos) || '-{2 * VOCAB}' as tokens, (count(*) + 1)::integer as length from dtok group by doc_id")
def k7(spark, d):
    return text(K.append_separator(doc_sequences(spark, d), 2 * VOCAB), "tokens")


@register("k8_truncate", f"with {DTOK} select doc_id, string_agg(token::varchar, '-' order by pos) as tokens, count(*)::integer as length from dtok where pos < 128 group by doc_id")
def k8(spark, d):
    return text(K.truncate(doc_sequences(spark, d), 128), "tokens")


@register("k9_flatten_stream", f"with {DTOK}, {DSTREAM} select pos, doc_id, token::integer as token from dstream")
def k9(spark, d):
    return doc_stream(spark, d)


@register("k10_avg_sequence_length", f"with {DTOK} select round((count(*) + count(distinct doc_id)) / count(distinct doc_id), 6) + 0.0 as avg_length from dtok")
def k10(spark, d):
    docs = documents(spark, d)
    return rounded(K.avg_sequence_length(K.encode_words(docs, K.word_vocab(docs, VOCAB), VOCAB, bos=VOCAB + 1, size=VOCAB), VOCAB + 1))


@register("k11_effective_vocab_size", f"with {DTOK} select (max(token) + 1)::integer as vocab_size from dtok")
def k11(spark, d):
    return K.effective_vocab_size(doc_tokens(spark, d))


@register(
    "k12_corpus_summary",
    f"with {DTOK}, n as (select count(*) as n from dtok group by doc_id), c as (select n, case when n >= 33 then (n - 33) // 16 + 1 else 0 end as c from n) select count(*) as stories, sum(c)::bigint as chunks, sum(n)::bigint as tokens, round(avg(n), 6) + 0.0 as avg_length, (sum(c) * 33)::bigint as effective_tokens, (sum(c) // 512)::bigint as steps_per_epoch from c",
)
def k12(spark, d):
    return rounded(K.corpus_summary(doc_sequences(spark, d), 32, 16))


@register("s3_corpus_splits", "select 'documents' as split, 0 as split_order, text from documents union all select 'benchmark', 1, text from benchmark")
def s3(spark, d):
    from ..sources.readers import read_corpus_splits

    return read_corpus_splits(spark, d, ("documents.parquet", "benchmark.parquet")).select(F.regexp_replace("split", "[.]parquet", "").alias("split"), "split_order", "text")


@register("s5_token_bin_parts", f"with {DTOK}, {DSTREAM} select pos // 100000 as part, min(pos) as first_pos, count(*) as n, (count(*) * 2) as bytes from dstream group by pos // 100000")
def s5(spark, d):
    from ..sources.writers import token_bin_parts

    return token_bin_parts(doc_stream(spark, d), 100_000).select("part", "first_pos", "n", F.length("data").cast("long").alias("bytes"))


@register(
    "s6_padded_sequences",
    f"with {DTOK}, s as (select doc_id, list(token order by pos) as l, count(*) as n from dtok group by doc_id), m as (select max(n) as m, count(*) as k from s) select doc_id, n::integer as length, k as num_stories, m::integer as max_length, {VOCAB + 3} as pad_id, {VOCAB + 1} as bos_id, {VOCAB + 2} as eos_id, (list_sum(l) + (m - n) * {VOCAB + 3})::bigint as id_sum from s, m",
)
def s6(spark, d):
    from ..sources.writers import padded_sequences

    x = padded_sequences(doc_sequences(spark, d), VOCAB + 3, VOCAB + 1, VOCAB + 2)
    return x.withColumn("id_sum", F.aggregate("tokens", F.lit(0).cast("long"), lambda a, b: a + b)).drop("tokens")


@register(
    "s11_context_json",
    f"{ECN} select level, context, '{{' || string_agg('\"' || next || '\":' || cnt, ',' order by next::varchar) || '}}' as counts from cn group by level, context",
)
def s11(spark, d):
    from ..sources.writers import context_json

    return context_json(text(event_counts(spark, d), "context"), "level")


@register(
    "s12_sparse_matrix",
    f"{DCN}, {TOTALS}, top as (select level, context, row_number() over (order by n desc, context) - 1 as id from tot where level = 2 qualify id < 200) select id as \"row\", next::integer as token, 1 as support, cnt from cn join top using (level, context)",
)
def s12(spark, d):
    cn = doc_counts_text(spark, d)
    return U.sparse_matrix(cn, numbered_top(cn, 200)).select("row", "token", "support", "cnt")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    import uuid

    from ..sources.shared import shared_dir

    return f"{shared_dir(spark)}/nextdist/{name}-{uuid.uuid4().hex}"


@register("s1_json_docs", "select text from documents where text is not null")
def s1(spark, d):
    """Documents as files of JSON arrays, about a hundred in each, and read again."""
    from ..sources.readers import read_json_docs

    docs, path = documents(spark, d).where("text is not null"), scratch(spark, "json")
    files = max(1, docs.count() // 100)
    arrays = docs.groupBy(F.pmod(F.xxhash64("doc_id"), F.lit(files)).alias("file")).agg(F.to_json(F.collect_list(F.struct(F.col("text").alias("story")))).alias("value"))
    arrays.repartition("file").select("value", F.concat(F.lit("a"), F.col("file").cast("string")).alias("file")).write.partitionBy("file").text(f"{path}/data.json")
    return read_json_docs(spark, path)


@register("s2_jsonl_docs", r"select text from documents where regexp_replace(coalesce(text, ''), '^[\s\x0b]+|[\s\x0b]+$', '', 'g') <> ''")
def s2(spark, d):
    from ..sources.readers import read_jsonl_docs

    path = scratch(spark, "jsonl")
    documents(spark, d).select("text").write.json(path)
    return read_jsonl_docs(spark, path)


@register("s4_token_bin", f"with {DTOK}, {DSTREAM} select pos, token::integer as token from dstream")
def s4(spark, d):
    """The stream as flat files and read again; a file's first position comes from the index."""
    from ..sources.readers import read_token_bin
    from ..sources.writers import write_token_bin

    path = scratch(spark, "tokens").removeprefix("file://")
    index = write_token_bin(K.placed_sequences(doc_sequences(spark, d, spread=False)), path, 50_000)
    return read_token_bin(spark, path, index=index)


@register("s4_token_data_source", f"with {DTOK}, {DSTREAM} select pos, token from dstream")
def s4b(spark, d):
    """The stream through the data source ``tokenbin``, written in parts and read in ranges of bytes that don't keep to them."""
    from ..sources.token_files import read_token_files, write_token_files

    path = scratch(spark, "tokens")
    write_token_files(doc_stream(spark, d), path, 50_000)
    return read_token_files(spark, path, span=30_001).select("pos", "token")


@register("s7_transitions", f"{ECN} select level, context, next::integer as next, cnt from cn where level = 2")
def s7(spark, d):
    from ..sources.readers import read_counts
    from ..sources.writers import write_counts

    path = scratch(spark, "transitions")
    write_counts(event_counts(spark, d), path)
    return text(read_counts(spark, path, 2), "context").select("level", "context", "next", "cnt")


@register("s8_pair_shards", f"{DWIN}, pc as (select t0, t1, count(*) as cnt from win group by t0, t1) select t0::integer as t0, t1::integer as t1, cnt, ((row_number() over (order by cnt desc, t0, t1) - 1) % 8)::integer as bin from pc")
def s8(spark, d):
    from ..sources.readers import read_pair_shards
    from ..sources.writers import write_pair_shards

    path = scratch(spark, "pairs")
    write_pair_shards(S.round_robin_bins(C.start_pair_counts(doc_windows(spark, d)), 8), path)
    return read_pair_shards(spark, path)


@register("s9_shards", f"{EWIN}, pc as (select t0, t1, count(*) as cnt from win group by t0, t1), b as (select t0, t1, (row_number() over (order by cnt desc, t0, t1) - 1) % 4 as bin from pc) select bin::integer as shard, start from win join b using (t0, t1)")
def s9(spark, d):
    from ..sources.writers import write_shards

    path = scratch(spark, "shards")
    w = event_windows(spark, d).select("start", "tokens")
    write_shards(S.assign_shard(w, S.round_robin_bins(C.start_pair_counts(w), 4)), path)
    return spark.read.parquet(path).select(F.col("shard").cast("int").alias("shard"), "start")


@register("s10_level_stats", f"{ECN}, {TOTALS}, {STATS} select run, x.* from ({STATS_OUT}) x, (values ('first'), ('second')) as r(run)")
def s10(spark, d):
    """Statistics of two runs, appended as JSON and read again."""
    from ..sources.readers import read_level_stats
    from ..sources.writers import write_level_stats

    path, stats = scratch(spark, "stats"), rounded(C.level_stats(event_counts(spark, d)))
    for run in ("first", "second"):
        write_level_stats(stats, path, run)
    return read_level_stats(spark, path).select("run", *[F.col(c).cast(t).alias(c) for c, t in stats.dtypes])


# --- windows (P) -----------------------------------------------------------------------------------


@register("p1_take_percentage", f"with {DTOK}, {DSTREAM} select pos, doc_id, token::integer as token from dstream where pos < (select floor(count(*) * 37 / 100) from dtok)")
def p1(spark, d):
    return P.take_percentage(doc_stream(spark, d), 37)


@register("p2_take_tokens", f"with {DTOK}, {DSTREAM} select pos, doc_id, token::integer as token from dstream where pos < 100000")
def p2(spark, d):
    return P.take_tokens(doc_stream(spark, d), 100_000)


@register("p3_head_tail_docs", "select doc_id, case when r <= 100 then 'head' else 'tail' end as part from (select doc_id, row_number() over (order by doc_id) as r, count(*) over () as n from documents) where r <= 100 or r > n - 100")
def p3(spark, d):
    docs = documents(spark, d)
    return P.head_docs(docs, 100).select("doc_id", F.lit("head").alias("part")).unionByName(P.tail_docs(docs, 100).select("doc_id", F.lit("tail").alias("part")))


@register("p4_sample_docs")
def p4(spark, d):
    return P.sample_docs(documents(spark, d), 20, 1, "source").select("doc_id", "source")


@register(
    "p4_sample_files",
    "with f as (select source, count(*) as n, row_number() over (order by md5('7|' || source), source) as r from documents group by source), k as (select greatest(1, floor(count(*) * 30 / 100)) as k from f), d as (select doc_id, source, row_number() over (partition by source order by md5('7|' || doc_id), doc_id) as r from documents) select doc_id, d.source from d join f using (source), k where f.r <= k and d.r <= floor(n * 30 / 100)",
)
def p4b(spark, d):
    return P.sample_files(documents(spark, d).select("doc_id", "source"), 30, "source", 7)


def win_sql(base: str, T: int) -> str:
    return f"{base} select start, {' || '.join(f't{i}' + (chr(32) + '|| ' + repr('-') if i < T else '') for i in range(T + 1))} as tokens from win"


@register("p5_sliding_windows", win_sql(f"with {DTOK}, {DSTREAM}, {windows_sql('dstream', 4, 'start % 3 = 0', False)}", 4))
def p5(spark, d):
    return text(P.sliding_windows(doc_stream(spark, d), 4, 3), "tokens")


@register("p5_event_windows", win_sql(EWIN, T))
def p5e(spark, d):
    return text(event_windows(spark, d).select("start", "tokens"), "tokens")


@register("p6_windows_within_documents", win_sql(f"with {DTOK}, {windows_sql('dtok', 4, 'start % 3 = 0')}", 4).replace("select start, t0", "select doc_id, start, t0"))
def p6(spark, d):
    return text(doc_windows(spark, d, 4, 3), "tokens")


@register(
    "p7_windows_padded",
    f"with {DTOK}, s as (select doc_id, list(token order by pos) as l, count(*) as n from dtok group by doc_id having count(*) > 2), g as (select doc_id, l, n, unnest(generate_series(0, n - 2, 6)) as start from s), f as (select *, list_slice(l, start + 1, start + 9) as p from g where start = 0 or start - 6 + 9 < n) select doc_id, start, array_to_string(p || list_transform(range(9 - len(p)), lambda x: {VOCAB + 3}), '-') as tokens, len(p)::integer as length from f",
)
def p7(spark, d):
    return text(P.windows_padded(doc_sequences(spark, d), 8, 6, VOCAB + 3), "tokens")


@register("p8_root_windows", win_sql(EWIN, 2))
def p8(spark, d):
    return text(P.root_windows(event_windows(spark, d).select("start", "tokens"), 2), "tokens")


@register("p9_input_target", f"{EWIN} select start, t0 || '-' || t1 || '-' || t2 as x, t1 || '-' || t2 || '-' || t3 as y from win")
def p9(spark, d):
    return text(P.input_target(event_windows(spark, d).select("start", "tokens")), "x", "y")


@register("p9_last_token_target", f"{EWIN} select start, t0 || '-' || t1 || '-' || t2 as x, t3::integer as y from win")
def p9b(spark, d):
    return text(P.input_target(event_windows(spark, d).select("start", "tokens"), "last"), "x")


@register("p10_windows_by_pairs", win_sql(EWIN, T) + " where (t0, t1) in ((0, 1), (2, 2), (4, 0))")
def p10(spark, d):
    pairs = spark.createDataFrame([(0, 1), (2, 2), (4, 0)], "t0 int, t1 int")
    return text(P.windows_by_pairs(event_windows(spark, d).select("start", "tokens"), pairs), "tokens")


@register("p11_windows_by_starts", win_sql(f"with {DTOK}, {DSTREAM}, {windows_sql('dstream', T, 'true', False)}", T) + " where start % 997 = 5")
def p11(spark, d):
    stream = doc_stream(spark, d)
    starts = stream.where("pos % 997 = 5").select(F.col("pos").alias("start"))
    return text(P.windows_by_starts(P.sliding_windows(stream, T), starts), "tokens")


@register("p12_quarter_stride_windows", win_sql(f"with {DTOK}, {DSTREAM}, {windows_sql('dstream', 9, 'start % 2 = 0', False)}", 9))
def p12(spark, d):
    return text(P.quarter_stride_windows(doc_stream(spark, d), 9), "tokens")


@register("p13_prefixes", f"{EWIN} select start, 1 as level, t0::varchar as context, t1::integer as next from win union all select start, 2, t0 || '-' || t1, t2 from win union all select start, 3, t0 || '-' || t1 || '-' || t2, t3 from win")
def p13(spark, d):
    return text(P.prefixes(event_windows(spark, d).select("start", "tokens"), T), "context")


def doc_pieces(spark: SparkSession, d: str) -> DataFrame:
    return documents(spark, d).select("doc_id", F.split("text", " ", -1).alias("tokens"))


FLC = f"""{DTOK}, flc as (select doc_id, pos + 2 as pos, piece || ' ' || lead(piece) over w as context, lead(piece, 2) over w as next from words window w as (partition by doc_id order by pos) qualify next is not null)"""


@register("p14_fixed_length_contexts", f"with {FLC} select doc_id, pos, context, next from flc")
def p14(spark, d):
    return P.fixed_length_contexts(doc_pieces(spark, d), 2).drop("ids")


# --- counts and statistics (A) ---------------------------------------------------------------------


def doc_counts(spark: SparkSession, d: str, vocab: DataFrame | None = None) -> DataFrame:
    return C.context_next_counts(P.windows_within_documents(doc_sequences(spark, d, vocab=vocab), T), T)


def doc_counts_text(spark: SparkSession, d: str) -> DataFrame:
    return text(doc_counts(spark, d), "context")


def numbered_top(cn: DataFrame, k: int, level: int = 2) -> DataFrame:
    """The ``k`` most frequent contexts of a level with numbers from 0."""
    from pyspark.sql import Window as W

    top = U.top_contexts(C.context_totals(cn.where(F.col("level") == level)), k)
    return top.select((F.row_number().over(W.orderBy(F.desc("n"), "context")) - 1).cast("long").alias("id"), "level", "context", "n")


@register("a1_context_next_counts", f"{ECN} select level, context, next::integer as next, cnt from cn")
def a1(spark, d):
    return text(event_counts(spark, d), "context")


@register("a1_document_counts", f"{DCN} select level, context, next::integer as next, cnt from cn")
def a1d(spark, d):
    return doc_counts_text(spark, d)


@register("a2_unigram_transitions", f"{DWIN} select t0::integer as t0, t1::integer as t1, count(*) as cnt from win group by all")
def a2(spark, d):
    return C.unigram_transitions(doc_windows(spark, d))


@register("a3_bigram_transitions", f"{DWIN} select t0::integer as t0, t1::integer as t1, t2::integer as t2, count(*) as cnt from win group by all")
def a3(spark, d):
    return C.bigram_transitions(doc_windows(spark, d))


@register("a4_start_pair_counts", f"{EWIN} select t0::integer as t0, t1::integer as t1, count(*) as cnt from win group by all")
def a4(spark, d):
    return C.start_pair_counts(event_windows(spark, d))


@register("a5_start_prefix_counts", f"{EWIN} select t0 || '-' || t1 || '-' || t2 as prefix, count(*) as cnt from win group by all")
def a5(spark, d):
    return text(C.start_prefix_counts(event_windows(spark, d), 3), "prefix")


@register("a6_pair_locations", f"{EWIN} select t0::integer as t0, t1::integer as t1, start from win")
def a6(spark, d):
    return C.pair_locations(event_windows(spark, d))


@register("a7_first_token_counts", f"{DWIN} select t0::integer as t0, count(*) as cnt from win group by all")
def a7(spark, d):
    return C.first_token_counts(doc_windows(spark, d))


@register("a8_context_totals", f"{DCN}, {TOTALS} select level, context, n, support, round(h, 6) + 0.0 as entropy, support = 1 as onehot, sq as sum_sq from tot")
def a8(spark, d):
    return rounded(C.context_totals(doc_counts_text(spark, d)))


@register("a9_level_stats", f"{ECN}, {TOTALS}, {STATS} {STATS_OUT}")
def a9(spark, d):
    return rounded(C.level_stats(event_counts(spark, d)))


@register("a9_document_level_stats", f"{DCN}, {TOTALS}, {STATS} {STATS_OUT}")
def a9d(spark, d):
    return rounded(C.level_stats(doc_counts(spark, d)))


@register("h1_level_stats_sorted", f"with {DTOK}, {windows_sql('dtok', 6)}, {counts_sql(6)}, {TOTALS}, {STATS} {STATS_OUT}")
def h1(spark, d):
    return rounded(level_stats_sorted(doc_windows(spark, d, 6), 6, rows_per_partition=250_000))


@register("h1_counts_sorted", f"{ECN} select level, context, next::integer as next, cnt from cn")
def h1b(spark, d):
    return text(context_next_counts_sorted(event_windows(spark, d).select("tokens"), T, rows_per_partition=2000), "context")


@register("a10_corpus_entropy", f"{DCN}, {TOTALS} select round(sum(n * h) / sum(n), 6) + 0.0 as corpus_entropy, sum(n)::bigint as observations, count(*) as contexts from tot")
def a10(spark, d):
    return rounded(C.corpus_entropy(C.context_totals(doc_counts(spark, d))))


@register("a11_entropy_share_per_level", f"{DCN}, {TOTALS} select level, round(sum(n * h) / (select sum(n) from tot), 6) + 0.0 as entropy_share from tot group by level")
def a11(spark, d):
    return rounded(C.entropy_share_per_level(C.level_stats(doc_counts(spark, d))))


@register("a12_context_entropy_contribution", f"{ECN}, {TOTALS} select level, context, round(h / sum(n) over (partition by level), 9) + 0.0 as contribution from tot")
def a12(spark, d):
    x = C.context_entropy_contribution(C.context_totals(text(event_counts(spark, d), "context")))
    return x.withColumn("contribution", F.round("contribution", 9) + F.lit(0.0))


@register("a13_context_counts", f"{DCN}, {TOTALS} select count(*) as unique_contexts, sum(n)::bigint as total_contexts from tot")
def a13(spark, d):
    return C.context_counts(C.context_totals(doc_counts(spark, d)))


@register("a13_approx_unique_contexts")
def a13b(spark, d):
    return C.approx_unique_contexts(doc_windows(spark, d), T)


@register("a13_sketched_contexts", f"{DCN}, {TOTALS} select level, sum(n)::bigint as windows, count(*) as exact, true as close from tot group by level")
def a13c(spark, d):
    """Distinct contexts from sketches per source, stored and merged, beside the exact number: within three standard errors."""
    from ..operators.sketches import context_sketches, merge_sketches, sketched_contexts

    w = saved(doc_windows(spark, d).join(documents(spark, d).select("doc_id", "source"), "doc_id"), "sketched-windows")
    got = sketched_contexts(merge_sketches(saved(context_sketches(w, T, "source"), "context-sketches")))
    exact = C.context_next_counts(w, T).select("level", "context").distinct().groupBy("level").agg(F.count("*").alias("exact"))
    return got.join(exact, "level").select("level", "windows", "exact", (F.abs(F.col("contexts") - F.col("exact")) <= 0.025 * F.col("exact")).alias("close"))


@register("a14_merge_level_stats", f"{ECN}, {TOTALS}, {STATS} {STATS_OUT}")
def a14(spark, d):
    """Root statistics for levels 1-2 and shards by start pair beyond; equal to the statistics of the whole."""
    w = event_windows(spark, d).select("start", "tokens")
    root = C.level_stats(C.context_next_counts(P.root_windows(w, 2), 2))
    sharded = S.assign_shard(w, S.round_robin_bins(C.start_pair_counts(w), 4))
    cn = P.prefixes(sharded.select("shard", "tokens"), T).groupBy("shard", "level", "context", "next").agg(F.count("*").alias("cnt"))
    tot = cn.groupBy("shard", "level", "context").agg(F.sum("cnt").alias("n"), F.count("*").alias("support"), F.sum(F.col("cnt") * F.ln("cnt")).alias("s"))
    tot = tot.withColumn("entropy", F.when(F.col("support") == 1, 0.0).otherwise(F.ln("n") - F.col("s") / F.col("n")))
    shards = C.level_sums(tot, "shard")
    return rounded(C.merge_level_stats(root, shards))


def stats_by(spark: SparkSession, d: str, key: str) -> DataFrame:
    w = doc_windows(spark, d).join(documents(spark, d).select("doc_id", key), "doc_id")
    cn = P.prefixes(w.select(key, "tokens"), T).groupBy(key, "level", "context", "next").agg(F.count("*").alias("cnt"))
    tot = cn.groupBy(key, "level", "context").agg(F.sum("cnt").alias("n"), F.count("*").alias("support"), F.sum(F.col("cnt") * F.ln("cnt")).alias("s"))
    tot = tot.withColumn("entropy", F.when(F.col("support") == 1, 0.0).otherwise(F.ln("n") - F.col("s") / F.col("n")))
    return C.with_averages(C.level_sums(tot, key))


LWIN = DWIN + ", lw as (select lang, win.* from win join documents using (doc_id))"
LCN = LWIN + ", cn as (" + " union all ".join(f"select lang, {k} as level, ({' || chr(45) || '.join(f't{i}' for i in range(k))})::varchar as context, t{k} as next, count(*) as cnt from lw group by all" for k in range(1, T + 1)) + ")"
LSTATS = TOTALS.replace("select level, context", "select lang, level, context").replace("group by level, context", "group by lang, level, context") + ", " + STATS.replace("select level", "select lang, level").replace("group by level", "group by lang, level")


@register(
    "a15_aggregate_metrics",
    f"{LCN}, {LSTATS} select lang, round(sum(total_entropy) / sum(total_visits), 6) + 0.0 as entropy, round(sum(total_uniformity) / sum(total_visits), 6) + 0.0 as uniformity, round(sum(visit_support) / sum(total_visits), 6) + 0.0 as support, round(sum(onehot_contexts) / sum(total_visits), 6) + 0.0 as onehot_ratio, round(sum(unique_nodes) / sum(total_visits), 6) + 0.0 as unique_per_visit, sum(total_visits)::bigint as visits, sum(unique_nodes)::bigint as contexts from st group by lang",
)
def a15(spark, d):
    return rounded(C.aggregate_metrics(stats_by(spark, d, "lang"), "lang"))


@register("a16_onehot_ratio", f"{DCN}, {TOTALS}, {STATS} select level, round(onehot_contexts / total_visits, 6) + 0.0 as onehot_ratio, round(onehot_visits / total_visits, 6) + 0.0 as onehot_visit_ratio from st")
def a16(spark, d):
    return rounded(C.onehot_ratio(C.level_stats(doc_counts(spark, d))))


@register(
    "a17_combine_growth_logs",
    f"{LCN}, {LSTATS} select level as milestone, level, round(sum(total_entropy) / sum(total_visits), 6) + 0.0 as entropy, sum(total_visits)::bigint as total_ctx from st group by level",
)
def a17(spark, d):
    logs = stats_by(spark, d, "lang").select(F.col("level").alias("milestone"), "level", F.col("avg_entropy").alias("entropy"), F.col("total_visits").alias("total_ctx"))
    return rounded(S.combine_growth_logs(logs))


@register("a18_support_sets", f"{ECN} select level, context, array_to_string(list(next order by next), '-') as support, sum(cnt)::bigint as n from cn group by level, context")
def a18(spark, d):
    return text(U.support_sets(event_counts(spark, d)), "context", "support")


SETS = "sets as (select level, context, array_to_string(list(next order by next), '-') as support, count(*) as size, sum(cnt)::bigint as n from cn group by level, context)"


@register("a18_contexts_per_support", f"{DCN}, {SETS} select level, support, count(*) as contexts from sets group by level, support")
def a18b(spark, d):
    return text(U.contexts_per_support(U.support_sets(doc_counts(spark, d))), "support")


@register("a19_support_size_histogram", f"{DCN}, {SETS} select level, size::integer as size, count(*) as contexts from sets group by level, size")
def a19(spark, d):
    return U.support_size_histogram(U.support_sets(doc_counts(spark, d)))


@register("a20_compare_runs", f"{LCN}, {LSTATS} select level, " + ", ".join(f"round(max(total_entropy / total_visits) filter (lang = '{x}'), 6) + 0.0 as {x}" for x in ("de", "en", "es", "fr")) + " from st group by level")
def a20(spark, d):
    return rounded(C.compare_runs(stats_by(spark, d, "lang"), "lang", "avg_entropy", ["de", "en", "es", "fr"]))


@register(
    "a20_vocabulary_sizes",
    "with words as (select doc_id, unnest(string_split(text, ' ')) as piece, generate_subscripts(string_split(text, ' '), 1) - 1 as pos from documents), vocab as (select piece, row_number() over (order by freq desc, piece) - 1 as token from (select piece, count(*) as freq from words group by piece)), "
    + ", ".join(
        f"dtok{v} as (select doc_id, pos, case when token < {v} then token else {v} end as token from words join vocab using (piece)), "
        + windows_sql(f"dtok{v}", 1).replace("win as", f"win{v} as", 1)
        + f", cn{v} as (select t0, t1, count(*) as cnt from win{v} group by all), tot{v} as (select t0, sum(cnt) as n, ln(sum(cnt)) - sum(cnt * ln(cnt)) / sum(cnt) as h from cn{v} group by t0)"
        for v in (128, 512)
    )
    + " select "
    + ", ".join(f"(select round(sum(n * h) / sum(n), 6) + 0.0 from tot{v}) as v{v}" for v in (128, 512))
    + ", 1 as level",
)
def a20b(spark, d):
    out = None
    for v in (128, 512):
        seqs = doc_sequences(spark, d, v)
        x = C.level_stats(C.context_next_counts(P.windows_within_documents(seqs, 1), 1)).withColumn("run", F.lit(f"v{v}"))
        out = x if out is None else out.unionByName(x)
    return rounded(C.compare_runs(out, "run", "avg_entropy", ["v128", "v512"]))


def _tokenizer_sql(name: str, pieces: str) -> str:
    return (
        f"w{name} as (select doc_id, unnest({pieces}) as piece, generate_subscripts({pieces}, 1) - 1 as pos from documents), v{name} as (select piece, row_number() over (order by count(*) desc, piece) - 1 as token from w{name} group by piece qualify token < {VOCAB}), "
        f"d{name} as (select doc_id, pos, coalesce(token, {VOCAB}) as token from w{name} left join v{name} using (piece)), " + windows_sql(f"d{name}", 2).replace("win as", f"win{name} as", 1) + ", " + counts_sql(2, f"win{name}", f"cn{name}") + ", " + TOTALS.replace("tot as", f"tot{name} as").replace("from cn", f"from cn{name}")
    )


@register(
    "a20_tokenizers",
    "with " + _tokenizer_sql("word", "string_split(text, ' ')") + ", " + _tokenizer_sql("char", "regexp_extract_all(translate(text, ' ', '_'), '(?s).')")
    + " select level, max(h) filter (k = 'word') as word, max(h) filter (k = 'char') as char from (" + " union all ".join(f"select '{k}' as k, level, round(sum(n * h) / sum(n), 6) + 0.0 as h from tot{k} group by level" for k in ("word", "char")) + ") group by level",
)
def a20e(spark, d):
    """Entropy per level of the same texts cut into words and into letters."""
    out = None
    for name, body in (("word", F.col("text")), ("char", F.btrim(F.regexp_replace(F.translate("text", " ", "_"), "(?s)(.)", "$1 "), F.lit(" ")))):
        docs = documents(spark, d).select("doc_id", body.alias("text"))
        seqs = K.encode_sequences(docs, K.word_vocab(docs, VOCAB), VOCAB, VOCAB)
        x = C.level_stats(C.context_next_counts(P.windows_within_documents(seqs, 2), 2)).withColumn("run", F.lit(name))
        out = x if out is None else out.unionByName(x)
    return rounded(C.compare_runs(out, "run", "avg_entropy", ["word", "char"]))


BUDGETS = [1_000, 10_000, 100_000]
GRID = "with words as (select doc_id, unnest(string_split(text, ' ')) as piece, generate_subscripts(string_split(text, ' '), 1) - 1 as pos from documents), vocab as (select piece, row_number() over (order by freq desc, piece) - 1 as token from (select piece, count(*) as freq from words group by piece)), " + ", ".join(
    f"dtok{v} as (select doc_id, pos, case when token < {v} then token else {v} end as token from words join vocab using (piece)), ds{v} as (select row_number() over (order by doc_id, pos) - 1 as pos, token from dtok{v}), "
    + ", ".join(
        windows_sql(f"(select 0 as doc_id, pos, token from ds{v} where pos < {b})", 2, by_doc=False).replace("win as", f"win{v}_{b} as", 1) + ", " + counts_sql(2, f"win{v}_{b}", f"cn{v}_{b}") + ", "
        + TOTALS.replace("tot as", f"tot{v}_{b} as").replace("from cn", f"from cn{v}_{b}") for b in BUDGETS
    )
    for v in (128, 512)
)


def budget_stats(spark: SparkSession, d: str, v: int) -> DataFrame:
    """Entropy per level of the first tokens of the stream, for a ladder of token budgets."""
    stream, out = saved(K.flatten_stream(doc_sequences(spark, d, v)), "budget-stream"), None
    for b in BUDGETS:
        w = P.sliding_windows(P.take_tokens(stream, b), 2)
        x = C.level_stats(C.context_next_counts(w, 2)).select("level", F.col("avg_entropy").alias("entropy"), F.lit(b).alias("milestone"), F.lit(v).alias("vocab"))
        out = x if out is None else out.unionByName(x)
    return out


@register("a20_token_budgets", f"{GRID} select level, " + ", ".join(f"max(h) filter (b = {b}) as b{b}" for b in BUDGETS) + " from (" + " union all ".join(f"select {b} as b, level, round(sum(n * h) / sum(n), 6) + 0.0 as h from tot512_{b} group by level" for b in BUDGETS) + ") group by level")
def a20c(spark, d):
    x = budget_stats(spark, d, 512).withColumn("run", F.concat(F.lit("b"), F.col("milestone").cast("string")))
    return rounded(C.compare_runs(x, "run", "entropy", [f"b{b}" for b in BUDGETS]))


@register("a20_final_grid", f"{GRID} select vocab, max(h) filter (level = 1) as \"1\", max(h) filter (level = 2) as \"2\" from (" + " union all ".join(f"select {v} as vocab, level, round(sum(n * h) / sum(n), 6) + 0.0 as h from tot{v}_{BUDGETS[-1]} group by level" for v in (128, 512)) + ") group by vocab")
def a20d(spark, d):
    growth = budget_stats(spark, d, 128).unionByName(budget_stats(spark, d, 512))
    return rounded(C.compare_final(growth, "vocab", "level", len(BUDGETS)))


@register("a21_doc_context_counts", f"with {FLC} select doc_id, context, next, count(*) as cnt, 0 as whole from flc group by doc_id, context, next union all select null, context, next, count(*), 1 from flc group by context, next")
def a21(spark, d):
    return C.doc_context_counts(P.fixed_length_contexts(doc_pieces(spark, d), 2).drop("ids"))


@register("a22_first_encoding", f"with {FLC}, f as (select context, doc_id, pos from flc qualify row_number() over (partition by context order by doc_id, pos) = 1) select context, replace(context, ' ', '-') as ids from f")
def a22(spark, d):
    return C.first_encoding(P.fixed_length_contexts(doc_pieces(spark, d), 2)).select("context", F.array_join("ids", "-").alias("ids"))


# --- lookups (J) -----------------------------------------------------------------------------------

ASKED = [[0], [4, 4], [1, 2, 3], [3, 3, 3], [9], [0, 9]]
ASKED_SQL = "asked as (select unnest(['0', '4-4', '1-2-3', '3-3-3', '9', '0-9']) as context, unnest([1, 2, 3, 3, 1, 2]) as lv)"


def asked(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(x,) for x in ASKED], "context array<int>")


@register("j1_next_distribution", f"{ECN}, {ASKED_SQL} select level, context, next::integer as next, round(cnt / sum(cnt) over (partition by level, context), 6) + 0.0 as prob from cn where context in (select context from asked)")
def j1(spark, d):
    return rounded(text(L.next_distribution(event_counts(spark, d), asked(spark)), "context"))


@register("j2_context_count", f"{ECN}, {TOTALS}, {ASKED_SQL} select context, coalesce(n, 0)::bigint as n from asked left join tot using (context)")
def j2(spark, d):
    return text(L.context_count(C.context_totals(event_counts(spark, d)), asked(spark)), "context")


@register("j3_context_level", f"{ECN}, {TOTALS}, {ASKED_SQL} select context, case when n is null then -1 else lv end::integer as depth from asked left join tot using (context)")
def j3(spark, d):
    return text(L.context_level(C.context_totals(event_counts(spark, d)), asked(spark)), "context")


PREF = "pref as (" + " union all ".join(f"select start, {k - 1} as pos, {k} as level, ({' || chr(45) || '.join(f't{i}' for i in range(k))})::varchar as context, t{k} as hard from win" for k in range(1, T + 1)) + ")"


@register("j4_soft_labels", f"{ECN}, {PREF} select start, pos, next::integer as next, round(cnt / sum(cnt) over (partition by start, pos), 6) + 0.0 as prob from pref join cn using (level, context)")
def j4(spark, d):
    w = event_windows(spark, d).select("start", "tokens")
    return rounded(L.soft_labels(w, C.context_next_counts(w, T), T))


@register("j4_soft_labels_l2", f"{ECN}, {PREF} select start, pos, next::integer as next, round(cnt / sqrt(sum(cnt * cnt) over (partition by start, pos)), 6) + 0.0 as prob from pref join cn using (level, context)")
def j4b(spark, d):
    w = event_windows(spark, d).select("start", "tokens")
    return rounded(L.soft_labels(w, C.context_next_counts(w, T), T, "l2"))


@register("j1_stored_distribution", f"{DCN}, asked as (select unnest(['0', '1-2', '0-0-0', '7-7-7', '500']) as context) select level, context, next::integer as next, round(cnt / sum(cnt) over (partition by level, context), 6) + 0.0 as prob from cn where context in (select context from asked)")
def j1s(spark, d):
    """Distributions of some contexts from a bucketed store of all counts of the documents."""
    from ..sources.count_store import open_count_store, stored_distribution, write_count_store

    path = scratch(spark, "count-store")
    write_count_store(doc_counts(spark, d), path, 16)
    return rounded(text(stored_distribution(open_count_store(spark, path), [[0], [1, 2], [0, 0, 0], [7, 7, 7], [500]]), "context"))


@register("j4_stored_soft_labels", f"{ECN}, {PREF} select start, pos, next::integer as next, round(cnt / sum(cnt) over (partition by start, pos), 6) + 0.0 as prob from pref join cn using (level, context)")
def j4s(spark, d):
    """Soft labels from a bucketed store of the counts, whose rows are not shuffled."""
    from ..sources.count_store import stored_soft_labels, write_count_store

    w = event_windows(spark, d).select("start", "tokens")
    return rounded(stored_soft_labels(w, write_count_store(C.context_next_counts(w, T), scratch(spark, "count-store"), 8), T))


@register(
    "j5_training_batch",
    f"{ECN}, {PREF}, g as (select level, context, string_agg(next || ':' || cnt, ',' order by next) as soft from (select level, context, next, cnt from cn) group by level, context) select start, t0 || '-' || t1 || '-' || t2 || '-' || t3 as tokens, pos, hard::integer as hard, soft from pref join g using (level, context) join win using (start)",
)
def j5(spark, d):
    w = event_windows(spark, d).select("start", "tokens")
    cn = C.context_next_counts(w, T)
    x = text(L.training_batch(w, cn, T), "tokens")
    # the probabilities times the context's visits are its counts again; as whole numbers both engines agree
    n = C.context_totals(cn).select("level", "context", "n")
    key = P.prefixes(w, T).select("start", (F.col("level") - 1).alias("pos"), "level", "context").join(n, ["level", "context"]).select("start", "pos", "n")
    pairs = F.transform(F.array_sort(F.map_entries("soft")), lambda e: F.concat_ws(":", e["key"].cast("string"), F.round(e["value"] * F.col("n")).cast("long").cast("string")))
    return x.join(key, ["start", "pos"]).select("start", "tokens", "pos", "hard", F.array_join(pairs, ",").alias("soft"))


@register("j6_assign_shard", f"{EWIN}, {PAIRS}, b as (select t0, t1, (row_number() over (order by cnt desc, t0, t1) - 1) % 4 as bin from pc) select start, t0 || '-' || t1 || '-' || t2 || '-' || t3 as tokens, bin::integer as shard from win join b using (t0, t1)")
def j6(spark, d):
    w = event_windows(spark, d).select("start", "tokens")
    return text(S.assign_shard(w, S.round_robin_bins(C.start_pair_counts(w), 4)), "tokens")


def benchmark_windows(spark: SparkSession, d: str, vocab: DataFrame) -> DataFrame:
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"), "text")
    return P.windows_within_documents(K.encode_sequences(items, vocab, VOCAB, VOCAB), T)


BWIN = f"bw as (select item_id as doc_id, unnest(string_split(text, ' ')) as piece, generate_subscripts(string_split(text, ' '), 1) - 1 as pos from benchmark), btok as (select doc_id, pos, coalesce(token, {VOCAB}) as token from bw left join vocab using (piece)), " + windows_sql("btok", T).replace("win as", "bwin as", 1) + ", " + PREF.replace("pref as", "bpref as", 1).replace("from win", "from bwin")


@register(
    "j7_cross_corpus_entropy",
    f"{DCN}, {TOTALS}, {BWIN} select level, count(h) as num_true, count(*) - count(h) as num_false, round(coalesce(sum(h), 0.0), 6) + 0.0 as sum_entropy, round(avg(h), 6) + 0.0 as mean_entropy from bpref left join tot using (level, context) group by level",
)
def j7(spark, d):
    vocab = saved(K.word_vocab(documents(spark, d), VOCAB), "vocab")
    return rounded(L.cross_corpus_entropy(benchmark_windows(spark, d, vocab), doc_counts(spark, d, vocab), T))


@register("j7_unknown_contexts", f"{DCN}, {BWIN} select level, context, count(*) as visits from bpref where (level, context) not in (select (level, context) from cn) group by level, context")
def j7b(spark, d):
    vocab = saved(K.word_vocab(documents(spark, d), VOCAB), "vocab")
    return text(L.unknown_contexts(benchmark_windows(spark, d, vocab), doc_counts(spark, d, vocab), T), "context")


@register("j8_docs_with_contexts", f"with {FLC}, t as (select context from flc group by context order by count(*) desc, context limit 50) select distinct doc_id, context from flc where context in (select context from t)")
def j8(spark, d):
    x = P.fixed_length_contexts(doc_pieces(spark, d), 2)
    top = x.groupBy("context").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "context").limit(50)
    return L.docs_with_contexts(x, top)


CONTAINED = ["the ", "tion", "ing and", "der", "zzz", "la "]


@register("j8_docs_containing", "select doc_id, t.context from documents, (values " + ", ".join(f"('{t}')" for t in CONTAINED) + ") as t(context) where contains(text, t.context)")
def j8b(spark, d):
    return L.docs_containing(documents(spark, d), CONTAINED)


@register("j8_docs_containing_many", f"with {FLC}, t as (select context from flc group by context order by count(*) desc, context limit 2000) select doc_id, t.context from documents, t where contains(text, t.context)")
def j8c(spark, d):
    """The 2,000 most frequent pairs of words, searched as substrings of all texts in one reading."""
    from ..operators.contain import docs_containing_any

    x = P.fixed_length_contexts(doc_pieces(spark, d), 2)
    return docs_containing_any(documents(spark, d), x.groupBy("context").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "context").limit(2000))


TOP2 = "top as (select level, context, n, row_number() over (order by n desc, context) - 1 as id from tot where level = 2 qualify id < 200)"
OVER = "m as (select id, next from cn join top using (level, context)), ov as (select x.id as a, y.id as b, count(*) as shared from m x join m y on x.next = y.next and x.id < y.id group by all)"


@register("j9_support_overlap", f"{DCN}, {TOTALS}, {TOP2}, {OVER} select a, b, shared from ov")
def j9(spark, d):
    cn = doc_counts_text(spark, d)
    return U.support_overlap(cn, numbered_top(cn, 200))


@register("j10_soft_hard_distance", f"{ECN}, {TOTALS} select level, round(sum(2 * n * (1 - sq / (n::double * n))) / sum(n), 6) + 0.0 as l1, round(sum(n * (1 - sq / (n::double * n))) / sum(n), 6) + 0.0 as l2 from tot group by level")
def j10(spark, d):
    return rounded(L.soft_hard_distance(C.context_totals(event_counts(spark, d))))


@register(
    "j11_diff_distributions",
    f"{LCN}, a as (select context, sum(cnt) as c from cn where lang = 'en' and level = 1 group by context), b as (select context, sum(cnt) as c from cn where lang = 'de' and level = 1 group by context) select coalesce(a.context, b.context) as context, a.c::bigint as a, b.c::bigint as b, case when b.c is null then 'only_a' when a.c is null then 'only_b' else 'differs' end as side from a full join b on a.context = b.context where a.c is null or b.c is null or abs(a.c - b.c) > 5",
)
def j11(spark, d):
    w = doc_windows(spark, d).join(documents(spark, d).select("doc_id", "lang"), "doc_id")
    n = w.groupBy("lang", F.col("tokens")[0].cast("string").alias("context")).agg(F.count("*").alias("n"))
    return L.diff_distributions(n.where("lang = 'en'"), n.where("lang = 'de'"), ["context"], "n", 5)


# --- shards and ranking (O) ------------------------------------------------------------------------


@register("o1_top_pairs", f"{DWIN}, {PAIRS} select t0::integer as t0, t1::integer as t1, cnt from pc order by cnt desc, t0, t1 limit 10")
def o1(spark, d):
    return S.top_pairs(C.start_pair_counts(doc_windows(spark, d)))


@register("o2_round_robin_bins", f"{DWIN}, {PAIRS} select t0::integer as t0, t1::integer as t1, cnt, ((row_number() over (order by cnt desc, t0, t1) - 1) % 16)::integer as bin from pc")
def o2(spark, d):
    return S.round_robin_bins(C.start_pair_counts(doc_windows(spark, d)), 16)


@register("o3_greedy_bins")
def o3(spark, d):
    return S.greedy_bins(C.start_pair_counts(doc_windows(spark, d)), 16)


@register(
    "o3_greedy_event_bins",
    f"{EWIN}, {PAIRS}, p as (select *, row_number() over (order by cnt desc, t0, t1) as r from pc), g as (with recursive g(r, t0, t1, cnt, bin, loads) as (select 0::bigint, null::integer, null::integer, 0::bigint, -1, [0, 0, 0, 0]::bigint[] union all"
    " select p.r, p.t0, p.t1, p.cnt, (list_position(loads, list_min(loads)) - 1)::integer, list_transform(loads, lambda x, i: case when i = list_position(loads, list_min(loads)) then x + p.cnt else x end) from g join p on p.r = g.r + 1) select * from g) select t0, t1, cnt, bin from g where r > 0",
)
def o3b(spark, d):
    return S.greedy_bins(C.start_pair_counts(event_windows(spark, d)), 4)


@register("o4_bin_loads", f"{DWIN}, {PAIRS}, b as (select cnt, (row_number() over (order by cnt desc, t0, t1) - 1) % 16 as bin from pc) select bin::integer as bin, sum(cnt)::bigint as load, count(*) as members from b group by bin")
def o4(spark, d):
    return S.bin_loads(S.round_robin_bins(C.start_pair_counts(doc_windows(spark, d)), 16))


@register("o5_top_contexts", f"{DCN}, {TOTALS} select level, context, n, support from tot order by n desc, level, context limit 1000")
def o5(spark, d):
    return U.top_contexts(C.context_totals(doc_counts_text(spark, d))).select("level", "context", "n", "support")


@register(
    "o6_top_overlap_contexts",
    f"{DCN}, {TOTALS}, {TOP2}, {OVER}, e as (select a as id, shared, a, b from ov union all select b, shared, a, b from ov), k as (select id, shared, a, b from e qualify row_number() over (partition by id order by shared desc, a, b) = 1) select id, shared from k order by shared desc, a, b, id limit 50",
)
def o6(spark, d):
    cn = doc_counts_text(spark, d)
    return U.top_overlap_contexts(U.support_overlap(cn, numbered_top(cn, 200)), 50)


@register(
    "o7_top_shared_support_groups",
    f"{DCN}, {SETS}, top as (select * from sets where level = 2 order by n desc, context limit 1000), g as (select support, count(*) as contexts, row_number() over (order by count(*) desc, support) as rank from top group by support qualify rank <= 10) select rank, contexts, level, context, support from top join g using (support)",
)
def o7(spark, d):
    sets = text(U.support_sets(doc_counts(spark, d).where("level = 2")), "context", "support")
    top = sets.orderBy(F.desc("n"), "context").limit(1000).drop("n")
    return U.top_shared_support_groups(top)


@register(
    "o8_sample_shared_support",
    f"{DCN}, sets as (select context, list(next order by next) as support from cn where level = 2 group by context), g as (select support, count(*) as k, len(support) as size from sets group by support), walk as (select support, size from g where k >= 10 order by size, support limit 10), r as (select size, array_to_string(support, '-') as support, context, row_number() over (partition by support order by context) as i from sets join walk using (support)) select size::integer as size, support, context from r where i <= 10",
)
def o8(spark, d):
    sets = U.support_sets(doc_counts_text(spark, d).where("level = 2"))
    return text(U.sample_shared_support(sets), "support")


@register("o9_milestones", f"with {ETOK}, {windows_sql('etok', T)}, n as (select count(*) as n from win) select distinct case when i = 39 then n else round_even(i * (n / 39), 0)::bigint end as milestone from n, range(1, 40) as r(i) where round_even(i * (n / 39), 0) > 0")
def o9(spark, d):
    return G.milestones(spark, event_windows(spark, d).count(), 40)


GROW = f"""{EWIN}, n as (select count(*) as n from win), ms as (select distinct case when i = 19 then n else round_even(i * (n / 19), 0)::bigint end as milestone from n, range(1, 20) as r(i) where round_even(i * (n / 19), 0) > 0),
o as (select *, row_number() over (order by start) as seen from win), {PREF.replace("from win", "from o").replace("select start", "select seen")},
c as (select milestone, level, context, hard, count(*) as cnt from ms join pref on seen <= milestone group by all),
t as (select milestone, level, context, sum(cnt) as n, sum(cnt) * ln(sum(cnt)) - sum(cnt * ln(cnt)) as nh from c group by all)
select milestone, level, round(sum(nh) / sum(n), 6) + 0.0 as entropy, sum(n)::bigint as total_ctx, count(*) as unique_ctx from t group by all"""


@register("o10_growth_curve", GROW)
def o10(spark, d):
    w = event_windows(spark, d)
    # a window's number among all: its start less the starts that no window has before it, three per user
    ends = K.exclusive_offsets(w.groupBy("doc_id").agg(F.count("*").alias("n")), "doc_id", "n")
    first = w.groupBy("doc_id").agg(F.min("start").alias("s0")).join(ends, "doc_id")
    w = w.join(first, "doc_id").withColumn("idx", F.col("start") - F.col("s0") + F.col("offset"))
    return rounded(G.growth_curve(w, T, 20, w.count()))


@register("o11_online_target_probability", f"{EWIN}, {PREF} select start, pos, round(row_number() over (partition by level, context, hard order by start) / row_number() over (partition by level, context order by start), 6) + 0.0 as prob from pref")
def o11(spark, d):
    return rounded(G.online_target_probability(event_windows(spark, d), T))


@register(
    "o11_online_soft_labels",
    f"{EWIN}, {PREF}, p as (select start, context, hard from pref where level = 3), s as (select distinct context, hard from p), x as (select p.start, p.context, s.hard as next, count(*) filter (p.hard = s.hard) over w as c, count(*) over w as n from p join s using (context) window w as (partition by p.context, s.hard order by p.start)) select start, 2 as pos, next::integer as next, round(c / n, 6) + 0.0 as prob from x where c > 0",
)
def o11b(spark, d):
    return rounded(G.online_soft_labels(event_windows(spark, d), T, 3))


@register(
    "o11_online_soft_labels_all_levels",
    f"{EWIN}, {PREF}, s as (select distinct level, context, hard from pref), x as (select p.start, p.pos, p.context, s.hard as next, count(*) filter (p.hard = s.hard) over w as c, count(*) over w as n from pref p join s using (level, context) window w as (partition by level, p.context, s.hard order by p.start)) select start, pos, next::integer as next, round(c / n, 6) + 0.0 as prob from x where c > 0",
)
def o11c(spark, d):
    return rounded(G.online_soft_labels(event_windows(spark, d), T, block=4096))


@register("o12_support_count_sorted", f"{ECN}, {SETS} select level, support, count(*) as contexts from sets group by level, support")
def o12(spark, d):
    return text(U.support_count_sorted(U.support_sets(event_counts(spark, d))), "support")


@register("o13_enumerate_contexts", f"{DCN}, {TOTALS} select level, context, n from tot where level >= 2")
def o13(spark, d):
    return C.enumerate_contexts(C.context_totals(doc_counts_text(spark, d)), 2)


# --- set operations, formats ---------------------------------------------------------------------


@register("u2_merge_counts", f"{ECN} select level, context, next::integer as next, cnt from cn")
def u2(spark, d):
    w = event_windows(spark, d)
    parts = [C.context_next_counts(w.where(F.col("start") % 3 == i), T) for i in range(3)]
    return text(C.merge_counts(*parts), "context")


@register("u3_only_on_one_side", f"{DWIN}, a as (select t0, t1 from win where doc_id % 2 = 0), b as (select t0, t1 from win where doc_id % 2 = 1), x as (select *, 'only_a' as side from (select distinct * from a except select distinct * from b) union all select *, 'only_b' from (select distinct * from b except select distinct * from a)) select t0::integer as t0, t1::integer as t1, side from x")
def u3(spark, d):
    w = doc_windows(spark, d).select("doc_id", F.col("tokens")[0].alias("t0"), F.col("tokens")[1].alias("t1"))
    a, b = w.where("doc_id % 2 = 0").drop("doc_id").distinct(), w.where("doc_id % 2 = 1").drop("doc_id").distinct()
    return L.only_on_one_side(a, b)


@register("u5_distinct_supports", f"{DCN}, {SETS} select level, count(distinct support) as supports from sets group by level")
def u5(spark, d):
    return U.distinct_supports(U.support_sets(doc_counts(spark, d)))


@register("u5_token_groups", f"{DCN}, g as (select level, next, count(*) as n, list(context order by context) as cs from cn group by level, next) select level, n as contexts, array_to_string(list(next order by next), '-') as tokens from g group by level, n, cs")
def u5b(spark, d):
    return text(U.token_groups(doc_counts_text(spark, d)), "tokens")


@register("f1_run_labels", "select source, case when n >= 1000000 then (case when round(n / 1000000, 1) = floor(round(n / 1000000, 1)) then floor(round(n / 1000000, 1))::bigint::varchar else round(n / 1000000, 1)::varchar end) || 'M' when n >= 1000 then (case when round(n / 1000, 1) = floor(round(n / 1000, 1)) then floor(round(n / 1000, 1))::bigint::varchar else round(n / 1000, 1)::varchar end) || 'K' else n::varchar end as label from (select source, sum(n_chars) as n from documents group by source)")
def f1(spark, d):
    return documents(spark, d).groupBy("source").agg(F.sum("n_chars").alias("n")).select("source", abbreviated(F.col("n")).alias("label"))


@register("k4_bpe")
def k4(spark, d):
    from ..operators.bpe import encode_bpe, train_bpe

    docs = documents(spark, d)
    vocab, merges = train_bpe(docs, 400)
    return encode_bpe(docs, vocab, merges, -1).select("doc_id", F.size("tokens").alias("n_tokens"), F.array_max("tokens").alias("largest"))


#: The words of a text between white space, as the subword vocabularies take them.
WORDS_SQL = r"regexp_extract_all(text, '[^ \t\n\x0b\f\r]+')"


@register("k4_byte_bpe_round_trip", "select doc_id, coalesce(text, '') as text from documents")
def k4b(spark, d):
    """Every text encoded with a byte-level vocabulary learnt from all of them, and decoded to the very text."""
    from ..operators.bpe import decode_byte_bpe, encode_byte_bpe, train_byte_bpe

    docs = documents(spark, d)
    pieces, merges = train_byte_bpe(docs, VOCAB)
    return decode_byte_bpe(saved(encode_byte_bpe(docs, pieces, merges), "byte-sequences"), pieces)


@register("k3_unigram_decode", f"select doc_id, coalesce(array_to_string({WORDS_SQL}, ' '), '') as text from documents")
def k3u(spark, d):
    """Every text cut by a unigram vocabulary learnt from all of them; all its letters are pieces, so its words come back."""
    from ..operators.unigram import decode_unigram, encode_unigram, train_unigram

    docs = documents(spark, d)
    logp = train_unigram(docs, VOCAB)
    return decode_unigram(encode_unigram(docs, logp, len(logp)), logp)


@register("k3_wordpiece_decode", f"select doc_id, coalesce(array_to_string({WORDS_SQL}, ' '), '') as text from documents")
def k3w(spark, d):
    """Every text cut by longest match with a wordpiece vocabulary learnt from all of them, and joined again."""
    from ..operators.wordpiece import decode_wordpiece, encode_wordpiece, train_wordpiece

    docs = documents(spark, d)
    pieces = train_wordpiece(docs, VOCAB)
    return decode_wordpiece(encode_wordpiece(docs, pieces, len(pieces)), pieces)


@register("a20_four_tokenizers")
def a20f(spark, d):
    """Statistics of the same texts under four vocabularies of one size: bpe, unigram, word and wordpiece, a column for each run's entropy."""
    return rounded(C.compare_runs(tokenizer_stats(spark, documents(spark, d), VOCAB), "run", "avg_entropy", ["bpe", "unigram", "word", "wordpiece"]))


def tokenizer_stats(spark: SparkSession, docs: DataFrame, size: int, T: int = 2) -> DataFrame:
    """Level statistics with ``run`` for each of the four tokenizers, learnt from and applied to ``docs``."""
    from ..operators import bpe, unigram, wordpiece

    def sequences(run: str) -> DataFrame:
        if run == "word":
            return K.encode_sequences(docs, K.word_vocab(docs, size), size, size)
        if run == "bpe":
            vocab, merges = bpe.train_bpe(docs, size)
            return bpe.encode_bpe(docs, vocab, merges, size)
        if run == "unigram":
            return unigram.encode_unigram(docs, unigram.train_unigram(docs, size), size)
        return wordpiece.encode_wordpiece(docs, wordpiece.train_wordpiece(docs, size), size)

    out = None
    for run in ("bpe", "unigram", "word", "wordpiece"):
        w = P.windows_within_documents(saved(sequences(run), "tokenizer-sequences"), T)
        x = C.level_stats(C.context_next_counts(w, T)).withColumn("run", F.lit(run))
        out = x if out is None else out.unionByName(x)
    return out


@register("w2_cross_entropy_by_turn", """with words as (select conv_id as doc_id, row_number() over (partition by conv_id order by turn, i) - 1 as pos, piece from (select conv_id, turn, unnest(string_split(text, ' ')) as piece, generate_subscripts(string_split(text, ' '), 1) as i from conversations)),
w as (select doc_id, piece as t0, lead(piece) over (partition by doc_id order by pos) as t1 from words), c as (select t0, t1, count(*) as cnt from w where t1 is not null group by all),
t as (select t0, sum(cnt) as n, count(*) as support, case when count(*) = 1 then 0.0 else ln(sum(cnt)) - sum(cnt * ln(cnt)) / sum(cnt) end as h from c group by t0) select round(sum(n * h) / sum(n), 6) + 0.0 as entropy, sum(n)::bigint as visits, count(*) as contexts from t""")
def w2(spark, d):
    """Pair entropy of conversations read as one sequence each, in turn order; turns stay separate rows."""
    from pyspark.sql import Window as W

    x = table(spark, d, "conversations").select("conv_id", "turn", F.split("text", " ", -1).alias("p")).where("p is not null")
    inside = x.select(F.inline(F.transform(F.sequence(F.lit(0), F.size("p") - 2), lambda i: F.struct(F.get("p", i).alias("t0"), F.get("p", i + 1).alias("t1"))))).where("t0 is not null and t1 is not null")
    ends = x.select("conv_id", "turn", F.get("p", F.size("p") - 1).alias("t0"), F.get("p", F.lit(0)).alias("first"))
    across = ends.withColumn("t1", F.lead("first").over(W.partitionBy("conv_id").orderBy("turn"))).where("t1 is not null").select("t0", "t1")
    cn = inside.unionByName(across).groupBy(F.lit(1).alias("level"), F.col("t0").alias("context"), F.col("t1").alias("next")).agg(F.count("*").alias("cnt"))
    t = C.context_totals(cn)
    return rounded(t.agg((F.sum(F.col("n") * F.col("entropy")) / F.sum("n")).alias("entropy"), F.sum("n").alias("visits"), F.count("*").alias("contexts")))


# --- streams ---------------------------------------------------------------------------------------

SWIN = """with words as (select doc_id, unnest(string_split(text, ' ')) as piece, generate_subscripts(string_split(text, ' '), 1) as pos from documents),
win as (select doc_id, piece as t0, lead(piece) over w as t1, lead(piece, 2) over w as t2 from words window w as (partition by doc_id order by pos) qualify t2 is not null),
cn as (select 1 as level, t0 as context, t1 as next, count(*) as cnt from win group by all union all select 2, t0 || ' ' || t1, t2, count(*) from win group by all)"""


def streamed(spark: SparkSession, d: str) -> str:
    """Count the documents' word windows as a stream; returns where the deltas are."""
    import uuid

    from ..sources.shared import shared_dir
    from ..streaming.counts import start_growth

    docs = spark.readStream.schema(documents(spark, d).schema).parquet(f"{d}/documents.parque[t]")  # a pattern, so that it may be one file or a folder
    w = P.windows_within_documents(docs.select("doc_id", F.split("text", " ", -1).alias("tokens")), 2)
    path = f"{shared_dir(spark)}/nextdist/stream-{uuid.uuid4().hex}"
    start_growth(w, 2, f"{path}/out", f"{path}/progress").awaitTermination()
    return f"{path}/out"


@register("st1_stream_context_counts", f"{SWIN} select level, context, next, cnt from cn")
def st1(spark, d):
    from ..streaming.counts import read_counts_so_far

    return read_counts_so_far(spark, streamed(spark, d)).select("level", F.array_join("context", " ").alias("context"), "next", "cnt")


@register("st2_stream_growth", f"{SWIN}, {TOTALS} select level, round(sum(n * h) / sum(n), 6) + 0.0 as entropy, sum(n)::bigint as total_ctx, count(*) as unique_ctx from tot group by level")
def st2(spark, d):
    from ..streaming.counts import read_growth

    g = read_growth(spark, streamed(spark, d))
    last = g.groupBy("level").agg(F.max_by(F.struct("entropy", "total_ctx", "unique_ctx"), "batch").alias("g"))
    return rounded(last.select("level", "g.*"))


@register("st3_resume", f"{SWIN} select level, context, next, cnt from cn")
def st3(spark, d):
    """A stream that is stopped after a part of its files and started again when the rest has come: nothing is counted twice or left out."""
    from ..streaming.counts import read_counts_so_far, start_growth

    path, docs = scratch(spark, "resume"), documents(spark, d)
    part = F.pmod(F.xxhash64("doc_id"), F.lit(3))
    for i in range(3):
        docs.where(part == i).write.mode("append").parquet(f"{path}/in")
        w = spark.readStream.schema(docs.schema).parquet(f"{path}/in").select("doc_id", F.split("text", " ", -1).alias("tokens"))
        start_growth(P.windows_within_documents(w, 2), 2, f"{path}/out", f"{path}/progress").awaitTermination()
    return read_counts_so_far(spark, f"{path}/out").select("level", F.array_join("context", " ").alias("context"), "next", "cnt")


@register("st4_stream_online_labels", f"{EWIN}, {PREF} select start, pos, round(row_number() over (partition by level, context, hard order by start) / row_number() over (partition by level, context order by start), 6) + 0.0 as prob from pref")
def st4(spark, d):
    """Labels at insertion, windows arriving in three batches in the order of their starts."""
    from ..streaming.counts import online_labels

    path, w = scratch(spark, "online"), event_windows(spark, d).select("start", "tokens")
    third = (w.agg(F.max("start")).first()[0] or 0) // 3 + 1
    for i in range(3):
        w.where((F.col("start") >= i * third) & (F.col("start") < (i + 1) * third)).write.mode("append").parquet(f"{path}/in")
        stream = spark.readStream.schema(w.schema).parquet(f"{path}/in")
        q = online_labels(stream, T).writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/progress").trigger(availableNow=True).start()
        q.awaitTermination()
    return rounded(spark.read.parquet(f"{path}/out").select("start", "pos", "prob"))


@register("st1_stream_updates", f"{SWIN} select level, context, next, cnt from cn")
def st1u(spark, d):
    """Running counts in output mode ``update`` on the RocksDB state store, stopped and started again when the rest of the documents has come."""
    from ..streaming.stateful import latest_counts, start_updates

    path, docs = scratch(spark, "updates"), documents(spark, d)
    for i in range(2):
        docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == i).write.mode("append").parquet(f"{path}/in")
        w = spark.readStream.schema(docs.schema).parquet(f"{path}/in").select("doc_id", F.split("text", " ", -1).alias("tokens"))
        start_updates(P.windows_within_documents(w, 2), 2, f"{path}/out", f"{path}/progress").awaitTermination()
    return latest_counts(spark, f"{path}/out").select("level", F.array_join("context", " ").alias("context"), "next", "cnt")


@register("st4_stateful_labels", f"{EWIN}, {PREF} select start, pos, round(row_number() over (partition by level, context, hard order by start) / row_number() over (partition by level, context order by start), 6) + 0.0 as prob from pref")
def st4b(spark, d):
    """Labels at insertion from a stateful processor with a map per context, windows arriving in three batches in the order of their starts."""
    from ..streaming.stateful import start_labels

    path, w = scratch(spark, "labels"), event_windows(spark, d).select("start", "tokens")
    third = (w.agg(F.max("start")).first()[0] or 0) // 3 + 1
    for i in range(3):
        w.where((F.col("start") >= i * third) & (F.col("start") < (i + 1) * third)).write.mode("append").parquet(f"{path}/in")
        start_labels(spark.readStream.schema(w.schema).parquet(f"{path}/in"), T, f"{path}/out", f"{path}/progress").awaitTermination()
    return rounded(spark.read.parquet(f"{path}/out").select("start", "pos", "prob"))


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Level statistics of user event sequences."""
    return a9(spark, d)
