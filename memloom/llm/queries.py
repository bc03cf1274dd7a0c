"""The queries of this folder, by name, and the SQL of those that have some."""

from __future__ import annotations

from .embedding_dedup import op5_embedding_dedup
from .katz import op2_katz
from .langid import op1_language_id
from .licenses import op3_license_scan
from .minhash import op9_minhash
from .mixing import op4_mixing
from .packing import op10_packing
from .quality import op8_quality_rules
from .suffix_dedup import op7_suffix_dedup
from .token_counts import op6_token_counts

QUERIES = {f.__name__: f for f in (op1_language_id, op2_katz, op3_license_scan, op4_mixing, op5_embedding_dedup, op6_token_counts, op7_suffix_dedup, op8_quality_rules, op9_minhash, op10_packing)}

#: Smallest id that links (a, b), both ways, reach from each id of ids(id).
_COMPONENTS = "reach(id, c) as (select id, id from ids union select l.b, r.c from reach r, links l where l.a = r.id and r.c < l.b), comp as (select id, min(c) as component_id from reach group by id)"

ORACLE_SQL: dict[str, str] = {
    "op5_embedding_dedup": "with recursive v as (select vec_id, label, list_transform(embedding, lambda x: x::double) as e from embeddings), "
    "good as materialized (select vec_id, label, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) as u from v where label is not null and len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0 and len(e) > 0 and list_dot_product(e, e) > 0), "
    "links as materialized (select x.vec_id as a, y.vec_id as b from good x, good y where x.label = y.label and x.vec_id <> y.vec_id and list_dot_product(x.u, y.u) >= 0.98), "
    f"ids as (select vec_id as id from embeddings), {_COMPONENTS} "
    "select vec_id, (select count(*) from links where a = vec_id) as n_links, component_id, vec_id = component_id as kept from embeddings join comp on id = vec_id",
    "op9_minhash": r"with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents), "
    "s as materialized (select distinct doc_id, hash(array_to_string(w[i : i + 4], ' ')) as h from (select doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as i from w where len(w) > 0)), "
    "n as materialized (select doc_id, count(*) as n from s group by 1), "
    "c as (select x.doc_id as a, y.doc_id as b, count(*) as shared from s x join s y on x.h = y.h and x.doc_id < y.doc_id group by 1, 2), "
    "l as materialized (select a, b from c join n p on p.doc_id = a join n q on q.doc_id = b where 100 * shared >= 85 * (p.n + q.n - shared)), "
    "links as materialized (select a, b from l union all select b, a from l), "
    f"ids as (select doc_id as id from documents), {_COMPONENTS} "
    "select d.doc_id, coalesce(n.n, 0) as n_shingles, component_id, d.doc_id = component_id as kept from documents d join comp on id = d.doc_id left join n on n.doc_id = d.doc_id",
}
