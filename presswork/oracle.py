"""DuckDB SQL with the same rows as the queries of the catalogue."""

from __future__ import annotations

ART = """art as (select doc_id id, substr(split_part(text, chr(10), 1), 1, 120) title, split_part(text, chr(10), 1) head, 'https://docs.local/' || doc_id url, source, text summary,
  case when doc_id % 5 = 0 then '10.1/' || (doc_id % 97) end doi,
  timestamp '2024-01-01' + to_hours(((doc_id * 37) % 720)::int) published_at, timestamp '2024-01-31' + to_minutes((doc_id % 1000)::int) fetched_at from documents)"""
NORM = r"trim(regexp_replace(regexp_replace(lower(title), '[^a-z0-9 ]+', ' ', 'g'), '\s+', ' ', 'g'))"
KEY = NORM.replace("title", "head")  # the title is cut, its hash is not


def _embedding(text: str, rows: str, out: str) -> str:
    return f"""{out}_tok as (select id, unnest(regexp_extract_all(lower({text}), '[a-z0-9]+')) token from {rows}),
{out}_h as (select id, sha256(token) h from {out}_tok),
{out}_s as (select id, (('0x' || substr(h, 1, 8))::bigint % 768)::bigint dim, sum(case when ('0x' || substr(h, 9, 2))::bigint % 2 = 0 then 1::double else -1::double end) v from {out}_h group by 1, 2 having sum(case when ('0x' || substr(h, 9, 2))::bigint % 2 = 0 then 1 else -1 end) <> 0),
{out} as (select id, dim, v / sqrt(sum(v * v) over (partition by id)) w from {out}_s)"""


EMB = _embedding("substr(case when coalesce(summary, '') = '' then title else title || '. ' || summary end, 1, 2000)", "art", "emb")
INTER = """inter as (select event_id id, user_id, json_extract_string(props, '$.k')::bigint article_id,
  case event_type when 'view' then 'read' when 'purchase' then 'bookmark' when 'click' then 'like' when 'error' then 'hide' else 'search' end kind,
  case when event_type = 'view' then floor(value)::int end rt, ts created_at from events),
pos as (select *, row_number() over (partition by user_id order by created_at desc, id desc) rn from inter where kind in ('read', 'bookmark', 'like'))"""
GAZ = """gaz as (select * from (values ('thtion', 'disease', 'D:1', 2), ('attion', 'drug', 'D:2', 3), ('ertion', 'gene', 'D:3', 4), ('thanea', 'company', 'D:4', 5), ('eriner', 'disease', 'D:5', 6), ('thanedble', 'drug', 'D:6', 0), ('queoi', 'company', null, 7), ('eaureau', 'gene', null, 1)) t(name, entity_type, external_id, ord))"""
ENT = GAZ + r""", ent as (select id article_id, name, entity_type, ord, regexp_extract(t, '(?i)(?:^|[^\p{L}\p{N}_])(' || name || ')(?:$|[^\p{L}\p{N}_])', 1) mention_text
  from (select id, title || ' ' || coalesce(summary, '') t from art), gaz
  where regexp_matches(t, '(?i)(?:^|[^\p{L}\p{N}_])' || name || '(?:$|[^\p{L}\p{N}_])'))"""
REL = """pred as (select * from (values ('company', 'drug', 'develops', 'developed_by'), ('company', 'disease', 'researches', 'researched_by'), ('drug', 'disease', 'targets', 'targeted_by'), ('drug', 'gene', 'targets', 'targeted_by'), ('company', 'gene', 'researches', 'researched_by')) t(a, b, there, back)),
rel as (select x.name subject, there predicate, y.name object, x.article_id evidence_article_id from ent x join ent y using (article_id) join pred on x.entity_type = a and y.entity_type = b
  union all select y.name, back, x.name, x.article_id from ent x join ent y using (article_id) join pred on x.entity_type = a and y.entity_type = b
  union all select x.name, 'co_mentioned_with', y.name, x.article_id from ent x join ent y using (article_id) where x.ord < y.ord and not exists (select 1 from pred where (a = x.entity_type and b = y.entity_type) or (a = y.entity_type and b = x.entity_type)))"""
W = """wts as (select user_id, article_id, sum(case when kind <> 'read' then 1::double when rt > 0 then least(rt / 300.0::double, 1) else 0 end) weight from pos where rn <= 500 group by 1, 2)"""
UV = W + """, uv_s as (select user_id, dim, sum(weight * w) v from wts join emb on emb.id = article_id where weight > 0 group by 1, 2),
uv as (select user_id, dim, v / sqrt(sum(v * v) over (partition by user_id)) w from uv_s),
cnt as (select user_id, count(*)::bigint interaction_count from pos where rn <= 200 group by 1)"""
LIKED = "liked as (select distinct user_id, article_id from pos where rn <= 500)"
SRC = LIKED + """, srcn as (select user_id, source, count(*) n from liked join art on art.id = article_id group by 1, 2),
src_aff as (select user_id, source, n / sum(n) over (partition by user_id) share from srcn)"""
TOP = """topn as (select user_id, name, count(*) n from liked join art on art.id = article_id join ent using (article_id) group by 1, 2),
top_aff as (select user_id, name, n / sum(n) over (partition by user_id) share from topn)"""
STATS = """allrn as (select *, row_number() over (partition by user_id order by created_at desc, id desc) rn from inter),
stats as (select user_id, count(*)::bigint interaction_count, coalesce(avg(case when kind = 'read' and rt > 0 then rt end), 0)::double avg_read_time, avg((kind = 'bookmark')::int)::double bookmark_rate, avg((kind = 'like')::int)::double like_rate from allrn where rn <= 1000 group by 1)"""
FRESH = "coalesce(least(floor(epoch(timestamp '2024-01-31' - published_at) / 86400), 365), 365)::double"
QUAL = "(case when source in ('Nature', 'Science', 'Cell', 'NEJM', 'Lancet', 'Nature Medicine') then 1.0 when regexp_matches(lower(source), 'biorxiv|medrxiv') then 0.6 when source = 'PubMed' then 0.5 else 0.3 end)::double"
NEAR = """nl_last as (select user_id, article_id liked_id, arg_max(kind, (created_at, id)) kind from pos where rn <= 100 group by 1, 2),
nl_need as (select distinct p.id, l.liked_id from pairs p join nl_last l using (user_id)),
nl_sim as (select n.id, n.liked_id, round(sum(a.w * b.w), 9) s from nl_need n join emb a on a.id = n.id join emb b on b.id = n.liked_id and b.dim = a.dim group by 1, 2 having round(sum(a.w * b.w), 9) > 0),
nl_all as (select user_id, p.id, l.liked_id, s, kind, row_number() over (partition by user_id, p.id order by s desc, l.liked_id) r from pairs p join nl_last l using (user_id) join nl_sim x on x.id = p.id and x.liked_id = l.liked_id),
near as (select * from nl_all where r = 1)"""
PAIRS = """gone as (select distinct user_id, article_id from inter where kind = 'hide'),
sc as (select user_id, emb.id, round(sum(uv.w * emb.w), 9) sim from uv join emb using (dim) group by 1, 2),
pairs as (select user_id, id from (select *, row_number() over (partition by user_id order by sim desc, id) rn from sc where not exists (select 1 from gone g where g.user_id = sc.user_id and g.article_id = sc.id)) where rn <= 100
  union select user_id, article_id from inter where article_id in (select id from art))"""
SIGNALS = f"""hist as (select user_id, name, count(*) c from pos join ent using (article_id) where rn <= 20 group by 1, 2),
shr as (select user_id, id, name, c, row_number() over (partition by user_id, id order by c desc, name) r from pairs join ent on article_id = id join hist using (user_id, name)),
pop as (select article_id id, count(*) n from inter group by 1),
known as (select user_id, pairs.id, source, published_at from pairs join art on art.id = pairs.id),
sig as (select user_id, near.id, 0 pos, 'similar_to_interaction' as label, round(s, 3)::varchar || ' cosine similarity to "' || substr(title, 1, 80) || '" (' || kind || ')' detail, round(least(s, 1), 3) weight from near join art on art.id = liked_id where s > 0.3
union all select user_id, id, 1, 'source_affinity', round(share * 100, 1)::varchar || '% of your positive interactions are with ' || source, round(share, 3) from known join src_aff using (user_id, source)
union all select user_id, id, 2, 'topic_affinity', 'overlaps with topics (' || round(sum(share) * 100, 1)::varchar || '% affinity) from your interaction history', round(least(sum(share), 1), 3) from pairs join ent on article_id = id join top_aff using (user_id, name) group by 1, 2
union all select user_id, id, 3, 'freshness', 'published ' || round(d, 1)::varchar || ' days ago', round(greatest(0, 1 - d / 3), 3) from (select *, {FRESH} d from known) where d < 3
union all select user_id, id, 4, 'popularity', n || ' other reader interaction(s) with this article', round(least(n / 20.0::double, 1), 3) from pairs join pop using (id)
union all select user_id, id, 5, 'source_quality', source || ' is a high-quality source (score ' || q::varchar || ')', q from (select *, {QUAL} q from known) where q >= 0.7
union all select user_id, id, 6, 'shared_entities', 'mentions ' || string_agg(name, ', ' order by r) || ', which also appear in articles you''ve engaged with', round(least(sum(c) / 5.0::double, 1), 3) from shr where r <= 3 group by 1, 2)"""
BURST = f"""anc as (select id, source, published_at from art where id in (select id from emb) order by fetched_at desc, id limit 100),
prs as (select a.id anchor, b.id, round(sum(x.w * y.w), 9) sim from anc a join emb x on x.id = a.id join emb y on y.dim = x.dim join art b on b.id = y.id where a.id <> b.id group by 1, 2),
top as (select * from (select *, row_number() over (partition by anchor order by sim desc, id) rn from prs) where rn <= 20),
kept as (select t.*, b.source from top t join anc a on a.id = anchor join art b on b.id = t.id where sim >= 0.5 and b.source <> a.source and abs(epoch(b.published_at - a.published_at)) <= 720 * 3600),
bur as (select anchor article_id, 'cross_source_burst' kind, round(avg(sim) * count(distinct source), 4) score, array_to_string(list_sort(list_distinct(list(source))), ',') related_sources, string_agg(id::varchar, ',' order by rn) related_ids, round(avg(sim), 4) mean_similarity, count(distinct source) ns from kept group by 1 having count(distinct source) >= 2)"""
COLD = """gone as (select distinct user_id, article_id from inter where kind = 'hide')"""
SEARCH = _embedding("t", "(select 0 id, 'the ertion thanedble of attion' t)", "q")


#: The sequential loop: a row is kept if no row kept before it shares its DOI or title hash (URLs all differ).
THREE = f"""o as (select row_number() over (order by id) rn, id, doi, sha256({KEY}) h from art),
g as (select 0::bigint rn, []::varchar[] dois, []::varchar[] hs, -1::bigint kept
  union all select o.rn, case when k and doi is not null then list_append(dois, doi) else dois end, case when k then list_append(hs, h) else hs end, case when k then id else -1 end
  from g join o on o.rn = g.rn + 1, lateral (select not (coalesce(list_contains(dois, doi), false) or list_contains(hs, h)) k)),
kept_rows as (select kept id from g where kept >= 0)"""


def _search(query: str, others: str) -> str:
    return f"""sc as (select e.id, round(sum(e.w * q.w), 9) s from emb e join ({query}) q using (dim) group by 1),
al as (select art.id, title, source, coalesce(s, 0) s from art left join sc using (id) where {others})
select id, title, source, round(s, 4) similarity, row_number() over (order by s desc, id)::bigint as rank from (select * from al order by s desc, id limit 10)"""


SQL: dict[str, str] = {
    "hash_embed_sparse": f"with {ART}, {EMB} select id, dim, round(w, 6) w from emb",
    "semantic_search_topk": f"with {ART}, {EMB}, {SEARCH}, {_search('select dim, w from q', 'true')}",
    "related_articles_topk": f"with {ART}, {EMB}, {_search('select dim, w from emb where id = 1', 'art.id <> 1')}",
    "articles_list_recent": f"with {ART} select id, title, source, strftime(published_at, '%Y-%m-%d %H:%M:%S') published_at from art order by art.published_at desc nulls last, id limit 20",
    "articles_by_source": f"with {ART} select id, title, source from art where source = 'src3' order by published_at desc nulls last, id limit 20",
    "articles_page_offset": f"with {ART}, p as (select id, title from art order by published_at desc nulls last, id limit 20 offset 40) select id, title, case when (select count(*) from p) = 20 then 60 end::bigint next_cursor from p",
    "article_lookup": f"with {ART} select id, title, url, source from art where id = 42",
    "article_by_content_hash": f"with {ART}, h as (select id, sha256({KEY}) content_hash from art) select id, content_hash from h where content_hash = (select content_hash from h where id = 7)",
    "title_normalize_hash": f"with {ART} select id, {KEY} normalized, sha256({KEY}) content_hash from art",
    "dedup_title_hash": f"with {ART} select min(id) id from art group by {KEY}",
    "dedup_three_tier": f"with recursive {ART}, {THREE} select id from kept_rows",
    "ingest_counts_by_source": f"with recursive {ART}, {THREE} select source, count(*) filter (f.id is not null)::bigint added, count(*) filter (f.id is null)::bigint duplicates from art left join kept_rows f using (id) group by 1",
    "ingestion_run_record": f"with recursive {ART}, {THREE} select 1::bigint id, (select count(*) from kept_rows)::bigint added_total, 1::bigint error_count, (select count(distinct source) from art)::bigint n_sources",
    "interactions_latest_n": f"with {INTER} select user_id, id, article_id, kind interaction_type, rn::bigint rn from pos where rn <= 5",
    "interactions_by_user": f"with {INTER} select id, article_id, kind interaction_type from inter where user_id = 3 and kind = 'like' order by created_at desc, id limit 20",
    "hidden_articles": f"with {INTER} select distinct user_id, article_id from inter where kind = 'hide'",
    "item_popularity": f"with {INTER} select doc_id article_id, count(i.id)::bigint popularity from documents left join inter i on i.article_id = doc_id group by 1",
    "user_stats": f"with {INTER}, {STATS} select user_id, interaction_count, round(avg_read_time, 4) avg_read_time, round(bookmark_rate, 4) bookmark_rate, round(like_rate, 4) like_rate from stats",
    "source_affinity": f"with {ART}, {INTER}, {SRC} select user_id, source, round(share, 4) share from src_aff",
    "topic_affinity": f"with {ART}, {INTER}, {ENT}, {LIKED}, {TOP} select user_id, name, round(share, 4) share from top_aff",
    "interaction_weights": f"with {INTER}, {W} select user_id, article_id, round(weight, 4) weight from wts",
    "user_embedding": f"with {ART}, {EMB}, {INTER}, {UV} select user_id, dim, round(w, 4) + 0.0 w, interaction_count from uv join cnt using (user_id)",
    "stream_user_vectors": f"with {ART}, {EMB}, {INTER}, {UV} select user_id, dim, round(w, 4) + 0.0 w, interaction_count from uv join cnt using (user_id)",
    "feed_cold_start": f"""with {ART}, {EMB}, {INTER}, {COLD},
c as (select distinct id, published_at from art where id in (select id from emb) and published_at >= timestamp '2024-01-31' - interval 30 days),
r as (select u.user_id, c.id, row_number() over (partition by u.user_id order by published_at desc, c.id) rn from (select distinct user_id from inter) u, c where not exists (select 1 from gone g where g.user_id = u.user_id and g.article_id = c.id))
select user_id, id, rn::bigint rn, 0::double similarity, 'Recent biotech news' reason from r where rn <= 10""",
    "feed_warm": f"""with {ART}, {EMB}, {INTER}, {UV}, {COLD},
sc as (select user_id, emb.id, round(sum(uv.w * emb.w), 9) sim from uv join emb using (dim) group by 1, 2),
fd as (select * from (select *, row_number() over (partition by user_id order by sim desc, id) rn from sc where not exists (select 1 from gone g where g.user_id = sc.user_id and g.article_id = sc.id)) where rn <= 10),
pairs as (select user_id, id from fd), {NEAR}
select f.user_id, f.id, round(sim, 4) similarity, f.rn::bigint rn,
 case when n.s > 0.3 then 'Similar to article you ' || case n.kind when 'bookmark' then 'bookmarked' when 'like' then 'liked' else 'read' end || ': ' || substr(t.title, 1, 60) || '...' else 'Recommended based on your reading interests' end reason
from fd f left join near n on n.user_id = f.user_id and n.id = f.id left join art t on t.id = n.liked_id""",
    "knn_exact_cells": """with v as (select vec_id, list_transform(embedding, lambda x: x::double) e from embeddings),
n as (select vec_id, e, sqrt(list_dot_product(e, e)) l from v),
s as (select q.vec_id anchor, n.vec_id id, round(list_dot_product(q.e, n.e) / (q.l * n.l), 9) sim from n q, n where q.vec_id % 50 = 0 and q.vec_id <> n.vec_id),
r as (select *, row_number() over (partition by anchor order by sim desc, id) rn from s)
select anchor, id, rn, round(sim, 4) similarity from r where rn <= 10""",
    "knn_labels_recall_ndcg": """with v as (select vec_id, label, list_transform(embedding, lambda x: x::double) e from embeddings),
n as (select vec_id, label, e, sqrt(list_dot_product(e, e)) l from v),
q as (select * from n),
s as (select q.vec_id query, q.label ql, n.vec_id id, n.label, row_number() over (partition by q.vec_id order by round(list_dot_product(q.e, n.e) / (q.l * n.l), 9) desc, n.vec_id) rk from q, n where q.vec_id <> n.vec_id),
sz as (select q.vec_id query, count(n.vec_id) n_rel from q left join n on n.label = q.label and n.vec_id <> q.vec_id group by 1),
e as (select query, max(case when rk <= 5 then (ql = label)::int else 0 end) h5, max((ql = label)::int) h10, sum((ql = label)::int / log2(rk + 1)) dcg from s where rk <= 10 group by 1)
select count(*)::bigint n_queries, round(avg(h5), 4) hit_rate_at_5, round(avg(h10), 4) hit_rate_at_10,
 round(avg(case when n_rel > 0 then dcg / (select sum(1 / log2(i + 1)) from range(1, least(n_rel, 10) + 1) t(i)) else 0 end), 4) ndcg_at_10 from e join sz using (query)""",
    "latency_percentiles": "select event_type, round(quantile_cont(value, 0.5), 4) p50, round(quantile_cont(value, 0.95), 4) p95, round(quantile_cont(value, 0.99), 4) p99 from events group by 1",
    "load_summary": """with s as (select event_type <> 'error' ok, value / 100 t, value / 1000 f, floor(value)::bigint n from events)
select count(*)::bigint n, count(*) filter (ok)::bigint n_ok, count(*) filter (not ok)::bigint n_failed, round(count(*) filter (ok) / 100.0::double, 3) requests_per_second, round(coalesce(sum(n) filter (ok), 0)::double / 100, 3) tokens_per_second,
 round(quantile_cont(t * 1000, 0.5) filter (ok), 1) total_p50, round(quantile_cont(t * 1000, 0.95) filter (ok), 1) total_p95, round(quantile_cont(t * 1000, 0.99) filter (ok), 1) total_p99, round(quantile_cont(f * 1000, 0.5) filter (ok), 1) ttft_p50, round(quantile_cont(f * 1000, 0.95) filter (ok), 1) ttft_p95 from s""",
    "stream_burst_pairs": f"""with {ART}, {EMB},
near as (select a.id anchor, b.id id, round(sum(a.w * b.w), 9) sim from emb a join emb b on a.dim = b.dim and a.id <> b.id group by 1, 2)
select anchor, near.id, round(sim, 4) similarity, y.source from near join art x on x.id = anchor join art y on y.id = near.id
where sim >= 0.82 and x.source <> y.source and y.published_at between x.published_at - interval 48 hours and x.published_at + interval 48 hours""",
    "burst_detect": f"with {ART}, {EMB}, {BURST} select article_id, kind, score, related_sources, related_ids, mean_similarity from bur",
    "burst_prompt": f"""with {ART}, {EMB}, {BURST},
ln as (select k.anchor, string_agg('- [' || b.source || '] ' || b.title, chr(10) order by rn) l from kept k join art b on b.id = k.id group by 1)
select b.article_id, 'Explain in two or three sentences why this article may be an early signal. Use only the evidence below.' || chr(10) || 'Article (' || a.source || '): ' || a.title || chr(10)
 || 'Summary: ' || coalesce(nullif(a.summary, ''), '(none)') || chr(10) || 'Detector: ' || kind || ', score ' || printf('%.4f', score) || chr(10)
 || ns || ' independent sources within 720 hours, mean similarity ' || printf('%.4f', mean_similarity) || chr(10) || 'Coverage:' || chr(10) || l prompt
from bur b join art a on a.id = b.article_id join ln on anchor = b.article_id""",
    "kg_mentions": f"with {ART}, {ENT} select article_id, name, mention_text from ent",
    "kg_relations": f"with {ART}, {ENT}, {REL} select distinct subject, predicate, object, evidence_article_id from rel",
    "kg_relation_strength": f"with {ART}, {ENT}, {REL} select subject, predicate, object, count(*)::bigint strength from (select distinct * from rel) group by 1, 2, 3",
    "kg_entity_search": f"with {ART}, {ENT} select distinct name, gaz.entity_type, external_id from ent join gaz using (name) where gaz.entity_type = 'drug' and name ilike '%TION%'",
    "kg_entity_registry": f"with {ART}, {ENT} select article_id, name, first_value(case when article_id % 2 = 0 then external_id end) over (partition by name order by article_id) known_as from ent join gaz using (name)",
    "kg_entity_neighbourhood": f"""with {ART}, {ENT}, {REL}, ed as (select distinct subject, predicate, object, evidence_article_id from rel),
al as (select subject e, object o from ed union all select object, subject from ed)
select e entity, o neighbour, count(*)::bigint n from al group by 1, 2""",
    "kg_article_entities": f"with {ART}, {ENT} select article_id, name, entity_type from ent",
    "trial_entities": "select doc_id article_id, p::bigint pos, 'Trial ' || t as name, 'NCT' || lpad(t::varchar, 8, '0') external_id from (select doc_id, 0 p, doc_id t from documents union all select doc_id, 1, 1 from documents where doc_id <> 1) where t < 50 and t % 2 = 1",
    "freshness_quality": f"""with {ART}, n as (select ['Nature', 'Science', 'Cell', 'NEJM', 'Lancet', 'Nature Medicine', 'Nature Biotechnology', 'Cell Reports', 'Science Immunology', 'STAT News', 'GEN', 'bioRxiv (genomics)', 'Medrxiv', 'PubMed', 'nature', 'a blog'] names)
select id, {FRESH} freshness, [1, 1, 1, 1, 1, 1, 0.9, 0.9, 0.9, 0.7, 0.7, 0.6, 0.6, 0.5, 0.3, 0.3][id % 16 + 1]::double quality, names[id % 16 + 1] source from art, n""",
    "ranker_features": f"""with {ART}, {EMB}, {INTER}, {ENT}, {UV}, {STATS}, {SRC}, {TOP}, {PAIRS},
sm as (select user_id, p.id, sum(uv.w * emb.w) s from pairs p join emb on emb.id = p.id join uv using (user_id, dim) group by 1, 2),
pop as (select article_id id, count(*) n from inter group by 1),
ta as (select user_id, id, sum(share) s from pairs join ent on article_id = id join top_aff using (user_id, name) group by 1, 2)
select p.user_id, p.id, round(coalesce(sm.s, 0), 4) user_item_cosine, round(coalesce(sm.s, 0), 4) user_item_dot, coalesce(interaction_count, 0)::double user_interaction_count, round(coalesce(avg_read_time, 0), 4) user_avg_read_time,
 round(coalesce(bookmark_rate, 0), 4) user_bookmark_rate, round(coalesce(like_rate, 0), 4) user_like_rate, {FRESH} freshness, coalesce(pop.n, 0)::double popularity, {QUAL.replace('source', 'a.source')} source_quality, (doi is not null)::int::double has_doi,
 (p.id in (select id from emb))::int::double has_embedding, round(coalesce(ta.s, 0), 4) user_topic_aff, round(coalesce(sa.share, 0), 4) user_source_aff
from pairs p join art a on a.id = p.id left join sm on sm.user_id = p.user_id and sm.id = p.id left join stats st on st.user_id = p.user_id left join pop on pop.id = p.id
left join ta on ta.user_id = p.user_id and ta.id = p.id left join src_aff sa on sa.user_id = p.user_id and sa.source = a.source""",
    "explain_signals": f"with {ART}, {EMB}, {INTER}, {ENT}, {UV}, {SRC}, {TOP}, {PAIRS}, {NEAR}, {SIGNALS} select user_id, id, label, detail, round(weight, 3) weight from sig",
    "explain_summaries": f"""with {ART}, {EMB}, {INTER}, {ENT}, {UV}, {SRC}, {TOP}, {PAIRS}, {NEAR}, {SIGNALS}
select p.user_id, p.id, coalesce(arg_min(detail, (-weight, pos)), 'Recommended based on recent biotech coverage') summary, count(label)::bigint n_signals from pairs p left join sig s on s.user_id = p.user_id and s.id = p.id group by 1, 2""",
    "html_clean_regex": r"select page_id, nullif(trim(regexp_replace(regexp_replace(html, '<[^>]+>', '', 'g'), '\s+', ' ', 'g')), '') as text from pages",
    "nct_ids": f"with {ART} select id, case when id = 1 then 'NCT00000001' else 'NCT' || lpad(id::varchar, 8, '0') || ',NCT00000001' end nct_ids from art",
    "training_pairs": f"with {ART}, {EMB}, {INTER}, ok as (select user_id from pos where rn <= 200 group by 1 having count(*) >= 5) select distinct user_id, article_id id from pos where rn <= 100 and user_id in (select user_id from ok) and article_id in (select id from emb)",
    "training_label_counts": f"""with {ART}, {EMB}, {INTER}, ok as (select user_id from pos where rn <= 200 group by 1 having count(*) >= 10),
p as (select distinct user_id, article_id id from pos where rn <= 200 and user_id in (select user_id from ok) and article_id in (select id from emb)),
c as (select user_id, count(*) n from p group by 1),
f as (select user_id, count(*) n from ok, (select distinct id from emb) e where not exists (select 1 from p where p.user_id = ok.user_id and p.id = e.id) group by 1)
select 1::bigint as label, sum(n)::bigint n from c union all select 0, sum(least(c.n, least(f.n, 200)))::bigint from c join f using (user_id)""",
    "reranker_training_set": f"""with {ART}, {EMB}, {INTER}, ok as (select user_id from pos where rn <= 200 group by 1 having count(*) >= 10),
p as (select distinct user_id, article_id id from pos where rn <= 200 and user_id in (select user_id from ok) and article_id in (select id from emb)),
c as (select user_id, count(*) n from p group by 1),
nw as (select id, published_at from art where id in (select id from emb) order by published_at desc nulls last, id limit 400),
fr as (select user_id, id, row_number() over (partition by user_id order by published_at desc nulls last, id) t from c, nw where not exists (select 1 from p where p.user_id = c.user_id and p.id = nw.id)),
dr as (select user_id, id, row_number() over (partition by user_id order by sha256('42:' || user_id || ':' || id), id) d from fr where t <= 200),
al as (select user_id, id, 1::bigint as label from p union all select user_id, id, 0 from dr join c using (user_id) where d <= n)
select user_id, id, label, ('0x' || substr(sha256('test:42:' || user_id || ':' || id), 1, 8))::bigint % 1000 < 200 test from al""",
    "user_get_or_create": """with u as (select c_custkey id, lower(c_name) || '@x.org' email, case when c_custkey % 3 = 0 then 'a' || c_custkey end apple, case when c_custkey % 5 = 0 then 'g' || c_custkey end google from customer),
r as (select range request, case when range % 2 = 0 then 'customer#' || lpad(range::varchar, 9, '0') || '@x.org' end email, 'a' || range apple, 'g' || range google from range(300))
select request, coalesce((select min(id) from u where u.email = r.email), (select min(id) from u where u.apple = r.apple), (select min(id) from u where u.google = r.google)) user_id from r""",
    "cascade_surviving": f"with {INTER} select article_id, count(*)::bigint n from inter where article_id in (select doc_id from documents where doc_id % 3 <> 0) group by 1",
    "stream_ingest_counts": f"with {ART} select strftime(published_at, '%Y-%m-%d') as day, source, count(*)::bigint n from art group by 1, 2",
}
