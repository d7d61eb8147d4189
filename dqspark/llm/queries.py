"""The operators over whole tables with production parameters, and the same questions in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from dqspark.llm import (
    chat, decontam, hamming, lines, mixing, neardup, packing, repeats, resampling, secrets, sharding, toxicity, trie)
from dqspark.llm.common import table


def secrets_query(spark, sf):
    found = secrets.scan(table(spark, sf, "documents"))
    return found.select(F.col("key").alias("doc_id"), "nth", F.sha2("candidate", 256).alias("sha256"), "length", "score", "secret")


def sharding_query(spark, sf):
    d = table(spark, sf, "documents")
    text = F.coalesce("text", F.lit(""))
    digests = d.select("doc_id", "source", (sharding.text_bytes(d["text"]) + 1).alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"))
    return sharding.interleave(digests).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source")


def hamming_query(spark, sf):
    e = table(spark, sf, "embeddings")
    codes = e.select("vec_id", hamming.sign_code(e["embedding"]).alias("code"))
    return hamming.top_k(codes, codes.where("vec_id % 50 = 0"), k=10)


HAMMING_SQL = """
with c as (select vec_id, list_transform(embedding, lambda x: x > 0) as code from embeddings),
d as (
    select q.vec_id as query_id, r.vec_id as neighbour_id,
        len(list_filter(list_zip(q.code, r.code), lambda z: z[1] <> z[2])) as distance
    from c q join c r on q.vec_id % 50 = 0 and q.vec_id <> r.vec_id),
n as (select *, row_number() over (partition by query_id order by distance, neighbour_id) as nth from d)
select query_id, cast(nth as integer) as rank, neighbour_id, cast(distance as integer) as distance from n where nth <= 10
"""


def repeats_query(spark, sf):
    out = repeats.drop_repeats(table(spark, sf, "documents").select("doc_id", "text"), length=400)
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("bigint").alias("n_spans"), "kept_sha256")


def lines_query(spark, sf):
    out = lines.drop_repeated_runs(table(spark, sf, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.md5("kept_text").alias("kept_md5"))


LINES_SQL = """
with l as (
    select doc_id, text, unnest(string_split(text, chr(10))) as line, unnest(range(len(string_split(text, chr(10))))) as i
    from documents where text is not null),
b as (select doc_id, i, line, row_number() over (partition by doc_id order by i) as s from l where trim(line) <> ''),
w as (
    select doc_id, s, i as first, lead(i, 2) over p as last, line || chr(10) || lead(line, 1) over p || chr(10) || lead(line, 2) over p as run
    from b window p as (partition by doc_id order by s)),
f as (select *, row_number() over (partition by run order by doc_id, s) as nth from w where run is not null),
gone as (select distinct doc_id, unnest(range(first, last + 1)) as i from f where nth > 1),
kept as (
    select l.doc_id, count(*) as n_lines, count(gone.i) as n_removed,
        coalesce(string_agg(case when gone.i is null then line end, chr(10) order by l.i), '') as kept_text
    from l left join gone on l.doc_id = gone.doc_id and l.i = gone.i group by l.doc_id)
select d.doc_id, coalesce(n_lines, 0) as n_lines, coalesce(n_removed, 0) as n_removed, md5(kept_text) as kept_md5
from documents d left join kept on d.doc_id = kept.doc_id
"""


def passages_query(spark, sf):
    """As ``lines_query``, and shorter runs of at least fifty words go too."""
    out = lines.drop_repeated_runs(table(spark, sf, "documents"), long_words=50)
    return out.select("doc_id", "n_lines", "n_removed", F.md5("kept_text").alias("kept_md5"))


PASSAGES_SQL = """
with l as (
    select doc_id, text, unnest(string_split(text, chr(10))) as line, unnest(range(len(string_split(text, chr(10))))) as i
    from documents where text is not null),
b as (
    select doc_id, i, line, row_number() over (partition by doc_id order by i) as s,
        len(list_filter(regexp_split_to_array(line, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) as words
    from l where trim(line) <> ''),
w as (
    select doc_id, s, i as first, lead(i, 2) over p as last, line || chr(10) || lead(line, 1) over p || chr(10) || lead(line, 2) over p as run
    from b window p as (partition by doc_id order by s)
    union all
    select doc_id, s, i, i, line from b where words >= 50
    union all
    select doc_id, s, i, lead(i, 1) over p, line || chr(10) || lead(line, 1) over p
    from b window p as (partition by doc_id order by s) qualify words + lead(words, 1) over p >= 50),
f as (select *, row_number() over (partition by run order by doc_id, s) as nth from w where run is not null),
gone as (select distinct doc_id, unnest(range(first, last + 1)) as i from f where nth > 1),
kept as (
    select l.doc_id, count(*) as n_lines, count(gone.i) as n_removed,
        coalesce(string_agg(case when gone.i is null then line end, chr(10) order by l.i), '') as kept_text
    from l left join gone on l.doc_id = gone.doc_id and l.i = gone.i group by l.doc_id)
select d.doc_id, coalesce(n_lines, 0) as n_lines, coalesce(n_removed, 0) as n_removed, md5(kept_text) as kept_md5
from documents d left join kept on d.doc_id = kept.doc_id
"""


def neardup_query(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text")
    return neardup.near_duplicates(d, k=3, at_least=85).select("doc_id", "n_shingles", "component_id", "kept")


def mixing_query(spark, sf):
    d = table(spark, sf, "documents")
    sized = d.select("doc_id", "source", mixing.words(d["text"]).alias("words"))
    mixed = mixing.curriculum(sized, F.col("words"))
    first = F.array_min(F.transform("occurrences", lambda o: o["position"]))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", F.size("occurrences").alias("times"),
                        first.alias("first_position"), "source").orderBy("first_position", "doc_id")


def decontam_query(spark, sf):
    found = decontam.contaminated(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    return found.select(F.col("key").alias("doc_id"), F.col("item").alias("item_id"), "windows", "of")


def toxicity_query(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text")
    model = toxicity.fitted(d, table(spark, sf, "labels"))
    return toxicity.scored(d, model).select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _template_sql(source: str, key: str) -> str:
    """Texts as lists of words: the template ``t`` and, where it is a placeholder, the word ``v``; in DuckDB's SQL."""
    number, name, ends = (_quoted(x) for x in (decontam.NUMBER, decontam.NAME, decontam.ENDS))
    return f"""(
    with w as (
        select {key} as key, list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w from {source} where text is not null),
    u as (select key, unnest(w) as w, unnest(range(1, len(w) + 1)) as i, len(w) as n from w),
    b as (select *, lower(trim(w, {_quoted(decontam.EDGES)})) as bare, lag(w) over (partition by key order by i) as before from u),
    k as (select *, case when regexp_matches(w, {number}) then '<number>'
        when regexp_matches(w, {name}) and i > 1 and not regexp_matches(before, {ends}) then '<name>'
        when bare in ({_UNITS_SQL}) and i > 1 and regexp_matches(before, {number}) then '<unit>' end as kind from b)
    select key, count(*) as n, list({{'t': coalesce(kind, bare), 'v': case when kind is not null then bare end}} order by i) as tokens,
        list(bare order by i) as bares, min(w) filter (i = 1) as head from k group by key)"""


_UNITS_SQL = ", ".join(_quoted(u) for u in decontam.UNITS.split())


def _decontam_sql() -> str:
    head = _quoted(decontam.NAME)
    return f"""
with d as (select * from {_template_sql('documents', 'doc_id')}),
b as (select * from {_template_sql('benchmark', 'item_id')}),
bw as (select key as item, unnest(range(0, greatest(n - 8, 0) + 1)) as item_at, least(n, 8) as long, tokens, head from b where n >= 5),
bx as (select item, item_at, long, tokens[item_at + 1:item_at + long] as part, head from bw),
rich as (select *, list_transform(part, lambda x: x.t) as window from bx where len(list_filter(part, lambda x: x.v is null and x.t <> '')) >= 5),
begun as (
    select *, '<name>' as kind from rich where item_at = 0 and part[1].v is null and regexp_matches(head, {head})
    union all
    select *, '<unit>' from rich where item_at = 0 and part[1].v is null and lower(trim(head, {_quoted(decontam.EDGES)})) in ({_UNITS_SQL})),
by_ as (
    select item, item_at, long, part, rich.window from rich
    union all
    select item, item_at, long, list_concat([{{'t': kind, 'v': part[1].t}}], part[2:]), list_concat([kind], begun.window[2:]) from begun),
lens as (select distinct long from by_),
dw as (select key, long, unnest(range(0, n - long + 1)) as p, tokens from d, lens where n >= long),
dx as (select key, p, long, list_transform(tokens[p + 1:p + long], lambda x: x.t) as window, tokens from dw),
m as (select dx.key, item, p - item_at as shift, item_at, part, tokens[p + 1:p + dx.long] as own from dx join by_ on dx.window = by_.window and dx.long = by_.long),
f as (select key, item, shift, unnest(part).v as slot, unnest(own).v as value from m),
broken as (select distinct key, item, shift from (select key, item, shift, slot from f where slot is not null group by all having min(value) <> max(value))),
s as (select key, item, shift, count(*) as windows from m group by all),
n as (select item, count(distinct item_at) as cnt from by_ group by item),
poor as (select key as item, bares, n from b where key not in (select item from by_) and len(list_filter(bares, lambda x: x <> '')) > 0),
pw as (select d.key, unnest(range(0, d.n - l.n + 1)) as p, d.bares, l.n from d, (select distinct n from poor) l where d.n >= l.n)
select s.key as doc_id, s.item as item_id, max(windows) as windows, max(cnt) as "of"
from s join n on s.item = n.item
where not exists (select 1 from broken x where x.key = s.key and x.item = s.item and x.shift = s.shift) and windows >= least(6, cnt)
group by all
union all
select distinct pw.key, item, 1, 1 from pw join poor on pw.n = poor.n and pw.bares[p + 1:p + pw.n] = poor.bares
"""


def chat_query(spark, sf):
    return chat.render_maximal(table(spark, sf, "conversations"))


CHAT_SQL = """
with t as (
    select conv_id, role, text, row_number() over (partition by conv_id order by turn, role, text) as k, turn from conversations),
c as (select conv_id, list({'r': role, 't': text} order by k) as said, count(*) as n from t group by conv_id),
begun as (select distinct said[1:k] as said from (select said, unnest(range(1, n)) as k from c)),
whole as (select said, any_value(n) as n_turns, min(conv_id) as conv_id, count(*) as copies from c group by said),
kept as (select * from whole where not exists (select 1 from begun where begun.said = whole.said)),
parts as (
    select conv_id, n_turns, copies, cast((k - 1) // 64 as integer) as part, k, said[k] as x
    from (select *, unnest(range(1, n_turns + 1)) as k from kept))
select conv_id, part, n_turns, copies,
    string_agg('<|' || coalesce(x.r, '') || '|>' || chr(10) || coalesce(x.t, '') || '<|end|>' || chr(10), '' order by k) as chat
from parts group by conv_id, part, n_turns, copies
"""

def _crc32_sql(text: str) -> str:
    """CRC-32 of a text's UTF-8 bytes in DuckDB's SQL, next to ``crc_table``, byte by byte."""
    digits = f"hex(encode({text}))"
    octets = f"list_transform(range(octet_length(encode({text}))), lambda i: ('0x' || substr({digits}, cast(2 * i + 1 as integer), 2))::bigint)"
    return f"xor(list_reduce(list_concat([4294967295::bigint], {octets}), lambda c, o: xor(c >> 8, crc_table.t[(xor(c, o) & 255) + 1])), 4294967295::bigint)"


CRC_TABLE = """crc_table as (
    select list_transform(range(256), lambda n: list_reduce(list_concat([n], range(8)),
        lambda c, i: case when c & 1 = 1 then xor(c >> 1, 3988292384::bigint) else c >> 1 end)) as t)"""


def resampling_query(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text")
    return resampling.resampled(d, table(spark, sf, "benchmark")).select("doc_id", "n_features", "weight", "score", "rank")


RESAMPLING_SQL = f"""
with {CRC_TABLE},
small as (
    select 'd' as side, doc_id as id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents
    union all
    select 'b', item_id, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') from benchmark),
w as (select side, id, unnest(regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) as w from small),
c as (select w, {_crc32_sql('w')} % 10000 as bucket from (select distinct w from w), crc_table),
f as (select side, id, bucket from w join c using (w)),
n as (select bucket, count(*) filter (side = 'd') as s, count(*) filter (side = 'b') as t from f group by bucket),
total as (select cast(sum(s) as double) as s, cast(sum(t) as double) as t from n),
g as (
    select bucket, cast(floor(1000 * ln(((n.t + 1) * (total.s + 10000)) / ((n.s + 1) * (total.t + 10000)))) as bigint) as gain
    from n, total),
h as (select id, count(*) as n_features, cast(sum(gain) as bigint) as weight from f join g using (bucket) where side = 'd' group by id),
x as (
    select doc_id, coalesce(n_features, 0) as n_features, coalesce(weight, 0) as weight,
        ('0x' || substr(sha256('2024:' || doc_id), 1, 8))::bigint as h
    from documents left join h on id = doc_id),
y as (
    select doc_id, n_features, weight,
        weight + cast(floor(-1000 * ln(-ln((h + cast(0.5 as double)) / cast(4294967296 as double)))) as bigint) as score from x),
z as (select doc_id, row_number() over (order by score desc, doc_id) as nth, count(*) over () as n from y where n_features >= 20)
select y.doc_id, n_features, weight, score, case when nth <= n // 10 then nth end as rank from y left join z on y.doc_id = z.doc_id
"""


def packing_query(spark, sf):
    import public_tokenizers
    d = table(spark, sf, "documents").select("doc_id", "text")
    out = packing.packed(d, public_tokenizers.path("byte_bpe_50k.json"), ranks=public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def trie_query(spark, sf):
    return trie.prefix_trie(table(spark, sf, "conversations"), rebuilt=True)


TRIE_SQL = f"""
with {CRC_TABLE},
t as (
    select conv_id, coalesce(role, '') as role, coalesce(text, '') as text,
        row_number() over (partition by conv_id order by turn nulls first, role, text) as k
    from conversations where conv_id is not null),
o as (select conv_id, list({{'r': role, 't': text}} order by k) as said from t group by conv_id),
h as (select conv_id, conv_id - conv_id % 100 as base, said, {_crc32_sql('cast(conv_id as varchar)')} % 6 as h from o, crc_table),
r as (
    select h.conv_id, list_concat(coalesce(o.said[1:h.h], []), h.said[h.h + 1:]) as said
    from h left join o on o.conv_id = h.base),
p as (select conv_id, d, len(said) as n, said[1:d] as prefix from (select *, unnest(range(len(said) + 1)) as d from r)),
g as (
    select prefix, d, min(conv_id) as conv_id, count(*) as n_convs, coalesce(length(prefix[d].t), 0) as chars,
        sha256(coalesce(string_agg(cast(conv_id as varchar), ',' order by conv_id) filter (n = d), '')) as ends_sha256
    from p group by prefix, d),
c as (select prefix[1:d - 1] as prefix, count(*) as n_children from g where d > 0 group by all),
u as (select *, unnest(range(d + 1)) as up from (select g.*, n_children from g left join c on g.prefix = c.prefix)),
s as (
    select prefix[1:up] as prefix, cast(count(*) filter (n_children is null) as bigint) as n_leaves,
        cast(sum((n_convs - 1) * chars) as bigint) as saved_tokens
    from u group by prefix[1:up])
select g.conv_id, g.d as depth, q.conv_id as parent_conv_id, g.n_convs, coalesce(n_children, 0) as n_children, n_leaves, saved_tokens, g.ends_sha256
from g left join g q on g.d > 0 and q.prefix = g.prefix[1:g.d - 1] and q.d = g.d - 1
left join c on c.prefix = g.prefix join s on s.prefix = g.prefix
"""

QUERIES = {
    "op1_secret_forest": secrets_query,
    "op2_stratified_sharding": sharding_query,
    "op3_multi_index_hashing": hamming_query,
    "op4_suffix_repeats": repeats_query,
    "op5_line_winnowing": lines_query,
    "op5_long_passages": passages_query,
    "op6_tensored_minhash": neardup_query,
    "op7_toxicity_gru": toxicity_query,
    "op8_curriculum_mixing": mixing_query,
    "op9_template_decontamination": decontam_query,
    "op10_chat_collapse": chat_query,
    "op11_crc_resampling": resampling_query,
    "op12_first_fit_packing": packing_query,
    "op13_prefix_trie": trie_query,
}

ORACLES = {
    "op3_multi_index_hashing": HAMMING_SQL,
    "op5_line_winnowing": LINES_SQL,
    "op5_long_passages": PASSAGES_SQL,
    "op9_template_decontamination": _decontam_sql(),
    "op10_chat_collapse": CHAT_SQL,
    "op11_crc_resampling": RESAMPLING_SQL,
    "op13_prefix_trie": TRIE_SQL,
}
