"""The operators of this subpackage applied to the whole tables, under their registered names."""

from __future__ import annotations

from pyspark.sql import functions as F

from wiretide.llm import (common, decontamination, graphs, language, manifest, mixing, pages, quality, repeats, sharding, simhash, tokens, toxicity,
                          tries)

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


# CRC-32 (polynomial 0xEDB88320) of the decimal digits of {0}, with the table of its 256 steps in ``steps.t``
_STEPS = """steps as (select list(v order by i) t from (select i, list_reduce(list_prepend(i, range(8)),
  lambda a, b: case when a & 1 = 1 then xor(a >> 1, 3988292384) else a >> 1 end) v from (select unnest(range(256)) i)))"""
_CRC = """xor(list_reduce(list_prepend(4294967295, list_transform(string_split(cast({0} as varchar), ''), lambda x: cast(ascii(x) as bigint))),
  lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295)"""


def query(name: str, sql: str | None = None):
    def add(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function
    return add


@query("op1_sharding")
def op1(spark, sf_dir):
    return sharding.shard_documents(common.table(spark, sf_dir, "documents"))


@query("op3_mixing")
def op3(spark, sf_dir):
    return mixing.mixed_documents(common.table(spark, sf_dir, "documents"))


@query("op4_token_counts")
def op4(spark, sf_dir):
    import public_tokenizers
    return tokens.token_counts(common.table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query("op2_decontamination", """
with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') w from documents),
b as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') w from benchmark),
win as (select distinct item_id, list_slice(w, i, i + 9) p from (select item_id, w, unnest(range(1, greatest(len(w) - 8, 2))) i from b where len(w) > 0)),
sizes as (select distinct len(p) n from win),
places as (select doc_id, i, n, list_slice(w, i, i + n - 1) p
           from (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) i from d, sizes where len(w) >= n)),
hits as (select doc_id, i, n, item_id from places join win using (p)),
words as (select doc_id, count(distinct k) n_hit from (select distinct doc_id, unnest(range(i, i + n)) k from hits) group by doc_id),
items as (select doc_id, count(distinct item_id) n_items, string_agg(distinct cast(item_id as varchar), ',' order by cast(item_id as varchar)) s
          from hits group by doc_id)
select d.doc_id, cast(len(w) as bigint) n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items, sha256(coalesce(s, '')) items_sha256,
 coalesce(n_hit, 0) > 0 contaminated
from d left join words using (doc_id) left join items using (doc_id)""")
def op2(spark, sf_dir):
    return decontamination.contamination(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


@query("op6_simhash")
def op6(spark, sf_dir):
    return simhash.fingerprint_components(common.table(spark, sf_dir, "documents"))


@query("op9_toxicity")
def op9(spark, sf_dir):
    return toxicity.severity(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))


@query("op7_html_extraction")
def op7(spark, sf_dir):
    return pages.extract(common.table(spark, sf_dir, "pages"))


@query("op10_language_id")
def op10(spark, sf_dir):
    return language.identify(common.table(spark, sf_dir, "pages"), common.table(spark, sf_dir, "documents"))


@query("op8_repeated_strings")
def op8(spark, sf_dir):
    return repeats.without_repeats(common.table(spark, sf_dir, "documents"))


@query("op5_nearest_neighbours")
def op5(spark, sf_dir):
    return graphs.nearest(common.table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


@query("op11_quality")
def op11(spark, sf_dir):
    return quality.quality(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))


_FIELDS = " || ".join(f"case when {c} is null then '-' else strlen(cast({c} as varchar)) || ':' || {c} end"
                      for c in ("doc_id", "source", "lang", "n_chars", "{0}"))


@query("op12_manifest", f"""
with recursive {_STEPS},
leaves as (select doc_id, source, leaf, start, row_number() over (partition by source order by doc_id nulls first, leaf) - 1 place,
                  count(*) over (partition by source) n, row_number() over () k
           from (select doc_id, source, sha256({_FIELDS.format("text")}) leaf,
                        case when {_CRC.format("doc_id")} % 2 = 0 then sha256({_FIELDS.format("replace(text, chr(10), '')")})
                             else sha256({_FIELDS.format("text")}) end start from documents, steps)),
low as (select 0 lv, source, place, n, leaf h from leaves
        union all select lv + 1, source, place // 3, (n + 2) // 3, sha256(string_agg(h, '' order by place)) from low where n > 1 group by lv, source, place // 3, n),
subs as (select source, h subroot, row_number() over (order by source nulls first) - 1 place, count(*) over () n from low where n = 1),
high as (select 0 lv, place, n, subroot h from subs
         union all select lv + 1, place // 3, (n + 2) // 3, sha256(string_agg(h, '' order by place)) from high where n > 1 group by lv, place // 3, n),
low_steps as (select a.lv, a.source, a.place, coalesce(string_agg(b.h, '' order by b.place) filter (where b.place < a.place), '') l,
                     coalesce(string_agg(b.h, '' order by b.place) filter (where b.place > a.place), '') r
              from low a join low b on a.lv = b.lv and a.source is not distinct from b.source and a.place // 3 = b.place // 3 where a.n > 1 group by all),
high_steps as (select a.lv, a.place, coalesce(string_agg(b.h, '' order by b.place) filter (where b.place < a.place), '') l,
                      coalesce(string_agg(b.h, '' order by b.place) filter (where b.place > a.place), '') r
               from high a join high b on a.lv = b.lv and a.place // 3 = b.place // 3 where a.n > 1 group by all),
climb as (select k, 0 part, s.lv, s.l, s.r from leaves x join low_steps s on x.source is not distinct from s.source and x.place // cast(3 ** s.lv as bigint) = s.place
          union all select k, 1, s.lv, s.l, s.r from leaves x join subs u on x.source is not distinct from u.source
          join high_steps s on u.place // cast(3 ** s.lv as bigint) = s.place),
proofs as (select k, string_agg(l || r, '' order by part, lv) proof, list({{'l': l, 'h': '', 'r': r}} order by part, lv) path from climb group by k)
select doc_id, leaf, subroot, (select h from high where n = 1) root, sha256(coalesce(proof, '')) proof_sha256, folded_root,
       folded_root = (select h from high where n = 1) verified
from (select *, list_reduce(list_prepend({{'l': '', 'h': start, 'r': ''}}, coalesce(path, [])),
                            lambda a, b: {{'l': '', 'h': sha256(b.l || a.h || b.r), 'r': ''}}).h folded_root
      from leaves x join subs u on x.source is not distinct from u.source left join proofs using (k))""")
def op12(spark, sf_dir):
    return manifest.document_manifest(common.table(spark, sf_dir, "documents"))


@query("op13_prefix_trie", f"""
with {_STEPS},
o as (select conv_id c, coalesce(role, '') r, coalesce(text, '') t,
             row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), sha256(coalesce(text, ''))) i
      from conversations where conv_id is not null),
c as (select c, {_CRC.format("c")} % 9 h, c - c % 5 b from (select distinct c from o), steps),
w as (select c, list({{'r': r, 't': t}} order by own, i) w
      from (select c.c, 0 own, i, r, t from c join o on o.c = c.b where i <= h union all select c.c, 1, i, r, t from c join o on o.c = c.c where i > h) group by c),
m as (select c, d, list_slice(w, 1, d) p, d = len(w) done from (select c, w, unnest(range(0, len(w) + 1)) d from (select c, coalesce(w, []) w from c left join w using (c)))),
n as (select p, d, min(c) conv_id, count(*) n_convs, sha256(coalesce(string_agg(cast(c as varchar), ',' order by c) filter (where done), '')) ends_sha256
      from m group by p, d),
kids as (select list_slice(p, 1, d - 1) p, count(*) n_children from n where d > 0 group by 1),
below as (select list_slice(p, 1, a) p, cast(count(*) filter (where n_children is null) as bigint) n_leaves,
                 cast(sum(case when d = 0 then 0 else (n_convs - 1) * strlen(p[d].t) end) as bigint) saved_tokens
          from (select *, unnest(range(0, d + 1)) a from n left join kids using (p)) group by 1)
select n.conv_id, n.d as depth, u.conv_id as parent_conv_id, n.n_convs, coalesce(n_children, 0) n_children, n_leaves, saved_tokens, n.ends_sha256
from n left join kids using (p) join below using (p) left join n u on n.d > 0 and u.d = n.d - 1 and u.p = list_slice(n.p, 1, n.d - 1)""")
def op13(spark, sf_dir):
    return tries.prefix_trie(common.table(spark, sf_dir, "conversations"))
