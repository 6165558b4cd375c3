"""DuckDB SQL equivalents of the registered queries (the correctness oracle).

The CTE fragments mirror the Spark plans step by step; the tables are the pre-registered views.
"""

from __future__ import annotations

import zipfile
from pathlib import Path

import pyspark

FEED = r"""
feed as (
select cast(doc_id as bigint) id,
 lpad(cast(case when doc_id%40=39 then doc_id-1 else doc_id end as varchar),24,'0') raw_mongo_id,
 source,
 case when doc_id%97=5 then null else timestamp '2024-01-01 00:00:00' + to_minutes((doc_id*7919)%100003) end original_timestamp,
 concat('kw',cast(doc_id%12 as varchar)) retrieved_by_keyword,
 lang keyword_language,
 case when doc_id%3=0 then null else lpad(cast(doc_id%12 as varchar),24,'c') end keyword_concept_id,
 case when doc_id%11=0 then null else lang end detected_language,
 case when doc_id%53=11 then '  ' when doc_id%59=13 then null else text end cleaned_text,
 cast(to_json(toks) as varchar) tokens_processed,
 case when doc_id%10=1 then '[]' when doc_id%50=3 then '["a"' when doc_id%50=7 then '["a",1]'
      when doc_id%2=0 then cast(to_json(list_filter(toks, lambda x: length(x)>=4)) as varchar) end lemmas,
 concat('http://example.com/',cast(doc_id as varchar)) original_url,
 case doc_id%6 when 0 then 'completed' when 1 then 'failed_permanent' when 2 then 'failed_nlp_analysis'
      when 4 then 'pending' when 5 then 'pending_nlp_store_verification' end nlp_status
from (select *, regexp_extract_all(lower(text),'\p{L}+') toks from documents)
)"""


def _state(j: str) -> str:
    return (
        f"case when {j} is null or json_type({j})='NULL' then 'null' "
        f"when json_type({j})<>'ARRAY' then 'reject' "
        f"when coalesce(list_bool_and(list_transform(from_json({j},'[\"JSON\"]'), "
        f"lambda e: coalesce(json_type(e)='VARCHAR',false))),true) then 'ok' else 'reject' end"
    )


NORM = f"""
j as (select *, case when json_valid(tokens_processed) then tokens_processed end tj,
                case when json_valid(lemmas) then lemmas end lj from feed),
s as (select *, {_state('tj')} tokens_state, {_state('lj')} lemmas_state from j),
norm as (select id, raw_mongo_id, source, original_timestamp, retrieved_by_keyword, keyword_language,
  keyword_concept_id, detected_language, cleaned_text,
  case when tokens_state='ok' then from_json(tj,'["VARCHAR"]') end tokens, tokens_state,
  case when lemmas_state='ok' then from_json(lj,'["VARCHAR"]') end lemmas, lemmas_state,
  original_url, nlp_status from s)"""

REASONS = """list_filter([
  case when raw_mongo_id is null then 'raw_mongo_id is required' end,
  case when source is null then 'source is required' end,
  case when original_timestamp is null then 'original_timestamp is required' end,
  case when retrieved_by_keyword is null then 'retrieved_by_keyword is required' end,
  case when keyword_language is null then 'keyword_language is required' end,
  case when cleaned_text is null then 'cleaned_text is required' end,
  case when tokens_state='reject' then 'tokens_processed must be a list of strings' end,
  case when lemmas_state='reject' then 'lemmas must be a list of strings' end,
  case when length(raw_mongo_id)>24 then 'raw_mongo_id longer than 24 characters' end,
  case when length(keyword_concept_id)>24 then 'keyword_concept_id longer than 24 characters' end,
  case when length(keyword_language)>2 then 'keyword_language longer than 2 characters' end,
  case when length(detected_language)>2 then 'detected_language longer than 2 characters' end
 ], lambda x: x is not null)"""

ELIGIBLE = (
    "nlp_status is distinct from 'completed' and nlp_status is distinct from 'failed_permanent' "
    "and nlp_status is distinct from 'failed_nlp_analysis'"
)

VALIDATED = f"""
validated as (select *, {REASONS} reasons from norm),
backlog as (select * from validated where {ELIGIBLE}),
valid as (select * from backlog where len(reasons)=0)"""

TS = "strftime({c}, '%Y-%m-%d %H:%M:%S')"


def ts(c: str) -> str:
    return TS.format(c=c)


NONBLANK = "regexp_matches({c}, '[^\\s]')"


def nonblank(c: str) -> str:
    return NONBLANK.format(c=c)


BASE = f"with {FEED},{NORM},{VALIDATED}"

KW = """
kwsrc as (select id, case when coalesce(len(lemmas),-1)>0 then lemmas else tokens end toks from valid),
kwu as (select id, unnest(toks) tok, generate_subscripts(toks, 1) pos from kwsrc),
kwc as (select id, tok, count(*) frequency, min(pos) fpos from kwu group by id, tok),
kwr as (select id, tok keyword, frequency,
        row_number() over (partition by id order by frequency desc, fpos) rnk from kwc),
kw as (select id, cast(rnk as int) rank, keyword, frequency from kwr where rnk <= 10),
kwsum as (select k.id, string_agg(keyword, ' ' order by rank) summary, count(keyword) n_keywords
          from kwsrc k left join kw using (id) group by k.id)"""

SQL: dict[str, str] = {}

SQL["backlog_scan"] = f"""{BASE}
select id, raw_mongo_id, source, {ts('original_timestamp')} original_timestamp, retrieved_by_keyword,
 keyword_language, keyword_concept_id, detected_language, cleaned_text, tokens_processed, lemmas, original_url
from feed where {ELIGIBLE}
order by original_timestamp asc nulls last, id limit 50"""

SQL["backlog_status_filter"] = f"with {FEED} select id, nlp_status from feed where {ELIGIBLE}"

SQL["ensure_status"] = f"""with {FEED}
select 'absent' variant, id, 'pending' nlp_status, 1 ts_is_null from feed
union all
select 'present' variant, id, nlp_status, 1 ts_is_null from feed"""

SQL["request_scan"] = f"""with {FEED},{NORM}
select id, raw_mongo_id, source, {ts('original_timestamp')} original_timestamp, retrieved_by_keyword,
 keyword_language, keyword_concept_id, detected_language, cast(length(cleaned_text) as int) text_chars,
 cast(len(tokens) as int) n_tokens, cast(len(lemmas) as int) n_lemmas, original_url from norm"""

SQL["normalize_docs"] = f"""with {FEED},{NORM}
select id, raw_mongo_id, source, {ts('original_timestamp')} original_timestamp, retrieved_by_keyword,
 keyword_language, keyword_concept_id, detected_language, cast(length(cleaned_text) as int) text_chars,
 cast(len(tokens) as int) n_tokens, tokens_state, cast(len(lemmas) as int) n_lemmas, lemmas_state, original_url from norm"""

SQL["parse_token_lists"] = f"""with {FEED},{NORM}
select id, 'tokens_processed' field, tokens_state state, cast(len(tokens) as int) n_items, tokens[1] first_item from norm
union all
select id, 'lemmas' field, lemmas_state state, cast(len(lemmas) as int) n_items, lemmas[1] first_item from norm"""

SQL["validate_docs"] = f"""with {FEED},{NORM}, v as (select *, {REASONS} reasons from norm)
select id, case when len(reasons)=0 then 1 else 0 end is_valid, array_to_string(reasons, '; ') reasons,
 cast(len(reasons) as int) n_reasons from v"""

SQL["validate_lengths"] = f"""with {FEED},{NORM},
u as (
 select 'raw_mongo_id' column_name, 24 max_chars, length(raw_mongo_id) len from norm union all
 select 'keyword_concept_id', 24, length(keyword_concept_id) from norm union all
 select 'keyword_language', 2, length(keyword_language) from norm union all
 select 'detected_language', 2, length(detected_language) from norm)
select column_name, max_chars, cast(count_if(len > max_chars) as bigint) n_too_long, cast(count_if(len is null) as bigint) n_null,
 cast(max(len) as int) max_len from u group by all"""

SQL["blank_text_split"] = f"""with {FEED}
select id, case when cleaned_text is null then 'null' when {nonblank('cleaned_text')} then 'text' else 'blank' end text_class
from feed"""

SQL["keyword_language_rule"] = f"""with {FEED}
select id,
 case when length(detected_language)=2 then detected_language else 'en' end detected_rule,
 case when length(keyword_language || 'x')=2 then keyword_language || 'x' else 'en' end long_rule,
 case when length(keyword_language)=2 then keyword_language else 'en' end keyword_rule
from feed"""

SQL["keyword_frequency"] = f"{BASE},{KW} select id, rank, keyword, frequency from kw"

SQL["keyword_summary_text"] = f"""{BASE},{KW}
select id, summary, cast(n_keywords as int) n_keywords,
 cast({nonblank('summary')} as int) summary_scored from kwsum"""

# ---------------------------------------------------------------- label scoring

LABELS = ["Satisfied", "Grateful", "Concerned", "Anxious", "Confused", "Angry", "Neutral"]
CUSTOM = ["Concerned", "Angry", "Hopeful", "Neutral"]


def _label_values(labels):
    return "(values " + ", ".join(f"({i}, '{x}')" for i, x in enumerate(labels)) + ") t(label_pos, label)"


LEXICON = f"""
lexterms as (select term, count(*) n from (select unnest(regexp_extract_all(lower(text),'\\p{{L}}+')) term from documents) group by term),
lexr as (select term, row_number() over (order by n desc, term asc) r from lexterms qualify r <= 500),
lex as (select term, ([{', '.join(repr(x) for x in LABELS)}])[(r%7)+1] label, 1 + cast(r%5 as double)/5 weight from lexr)"""


def lexicon_scores(labels, src="feed", key="id", text="cleaned_text"):
    return f"""
labels as (select * from {_label_values(labels)}),
lexp as (select term, label_pos, weight from lex join labels using (label)),
texts as (select {key} id, regexp_extract_all(lower({text}),'\\p{{L}}+') toks from {src} where {nonblank(text)}),
hits as (select id, unnest(toks) term from texts),
sums as (select id, label_pos, sum(weight) w from hits join lexp using (term) group by all),
grid as (select t.id, len(t.toks) n, l.label_pos, l.label from texts t cross join labels l),
lg as (select g.id, g.label_pos, g.label, coalesce(s.w,0)/sqrt(greatest(g.n,1)) x from grid g left join sums s using (id, label_pos)),
ex as (select *, exp(x - max(x) over (partition by id)) e from lg),
sc as (select id, label_pos, label, e / sum(e) over (partition by id) score from ex),
rk as (select id, label, label_pos, score, cast(row_number() over (partition by id order by round(score,8) desc, label_pos) as int) rank from sc)"""


SQL["label_scores"] = f"with {FEED},{LEXICON},{lexicon_scores(LABELS)} select id, rank, label, round(score,6) score from rk"
SQL["label_scores_custom"] = f"with {FEED},{LEXICON},{lexicon_scores(CUSTOM)} select id, rank, label, round(score,6) score from rk"
SQL["label_ranking"] = f"""with {FEED},{LEXICON},{lexicon_scores(LABELS)}
select id, string_agg(label, ',' order by rank) ranking, round(max(score),6) top_score from rk group by id"""

PROTO = f"""
labels as (select * from {_label_values(LABELS)}),
pd as (select label label_pos, d, avg(cast(x as double)) m from
       (select label, unnest(embedding) x, generate_subscripts(embedding,1) d from embeddings where label < 7) group by all),
pn as (select label_pos, sqrt(sum(m*m)) pnorm from pd group by all),
vd as (select vec_id, unnest(embedding) x, generate_subscripts(embedding,1) d from embeddings),
vn as (select vec_id, sqrt(sum(cast(x as double)*cast(x as double))) vnorm from vd group by all),
dots as (select vd.vec_id, pd.label_pos, sum(cast(vd.x as double)*pd.m) dot from vd join pd using (d) group by all),
cosv as (select dots.vec_id, dots.label_pos, dot / (vnorm * pnorm) cos from dots join vn using (vec_id) join pn using (label_pos)),
lg as (select c.vec_id, l.label_pos, l.label, coalesce(c.cos, -1.0) / 0.05 x
       from (select distinct vec_id from embeddings) v cross join labels l left join cosv c on c.vec_id=v.vec_id and c.label_pos=l.label_pos),
ex as (select *, exp(x - max(x) over (partition by vec_id)) e from lg),
sc as (select vec_id, label_pos, label, e / sum(e) over (partition by vec_id) score from ex),
rk as (select vec_id, label, score, cast(row_number() over (partition by vec_id order by round(score,8) desc, label_pos) as int) rank from sc)"""
SQL["label_scores_proto"] = f"with {PROTO} select vec_id, rank, label, round(score,6) score from rk"

# ---------------------------------------------------------------- topics

TOPIC_TERMS = """
lt as (select doc_id, cast(dense_rank() over (order by lang) - 1 as int) topic_id, text from documents where lang is not null),
tk as (select topic_id, unnest(regexp_extract_all(lower(text),'\\p{L}+')) term from lt),
tf as (select topic_id, term, count(*) tf from tk group by all),
nt as (select topic_id, sum(tf) n_topic from tf group by all),
aa as (select avg(n_topic) a from nt),
ft as (select term, sum(tf) f_term from tf group by all),
tw as (select tf.topic_id, tf.term, tf.tf / nt.n_topic * ln(1 + aa.a / ft.f_term) weight
       from tf join nt using (topic_id) join ft using (term) cross join aa),
tr as (select *, cast(row_number() over (partition by topic_id order by round(weight,10) desc, term) as int) rank from tw),
tt as (select topic_id, term, weight, rank from tr where rank <= 10)"""

TOPIC_INFO = """
tinfo as (select * from (values (-1, '-1_outlier_documents'), (0, 'Gesundheit und Kosten'), (1, '1_old_generated_name'),
  (2, '2__x'), (3, '3_'), (5, '5_Costs'), (7, 'Pflege')) t(topic_id, name)),
tterms as (select topic_id, list(term order by rank) terms, list(weight order by rank) weights from tt group by topic_id),
cat as (select coalesce(tterms.topic_id, tinfo.topic_id) topic_id, tinfo.name stored_name,
        coalesce(tterms.terms, []) terms, coalesce(tterms.weights, []) weights
        from tterms full outer join tinfo on tterms.topic_id = tinfo.topic_id)"""


def display_name(tid, name, terms):
    return (
        f"case when {name} is not null and not (starts_with({name}, cast({tid} as varchar) || '_') and "
        f"coalesce(list_bool_and(list_transform(string_split({name}, '_')[2:], lambda p: p <> '')), true)) then {name} "
        f"when len({terms}) > 0 then cast({tid} as varchar) || '_' || array_to_string({terms}[1:3], '_') "
        f"else 'Topic ' || cast({tid} as varchar) end"
    )


SQL["topic_terms"] = f"with {TOPIC_TERMS} select topic_id, term, round(weight,6) weight, rank from tt"
SQL["topic_catalog"] = f"with {TOPIC_TERMS},{TOPIC_INFO} select topic_id, stored_name, cast(len(terms) as int) n_terms from cat"
SQL["topic_names"] = f"with {TOPIC_TERMS},{TOPIC_INFO} select topic_id, {display_name('topic_id', 'stored_name', 'terms')} name from cat"

TOPIC_TEXT = f"""
docs as (select id, cleaned_text from feed),
nb as (select id, regexp_extract_all(lower(cleaned_text),'\\p{{L}}+') toks from docs where {nonblank('cleaned_text')}),
th as (select id, unnest(toks) term from nb),
pt as (select th.id, tt.topic_id, sum(tt.weight) s from th join tt using (term) group by all),
tot as (select id, sum(s) total from pt group by id),
best as (select id, topic_id, s from pt qualify row_number() over (partition by id order by round(s,10) desc, topic_id) = 1),
assigned as (
  select nb.id, coalesce(best.topic_id, -1) topic_id,
         case when best.topic_id is null then 1.0 else best.s / tot.total end probability, 0 blank
  from nb left join best using (id) left join tot using (id)
  union all
  select id, -1, 1.0, 1 from docs where not coalesce({nonblank('cleaned_text')}, false))"""

SQL["topic_assign_text"] = f"with {FEED},{TOPIC_TERMS},{TOPIC_TEXT} select id, topic_id, round(probability,6) probability, blank from assigned"
SQL["topic_details"] = f"""with {FEED},{TOPIC_TERMS},{TOPIC_INFO},{TOPIC_TEXT}
select a.id, a.topic_id, {display_name('a.topic_id', 'cat.stored_name', 'coalesce(cat.terms, [])')} topic_name,
 cast(len(coalesce(cat.terms, [])) as int) n_terms, cat.terms[1] first_term, round(a.probability,6) probability
from assigned a left join cat on a.topic_id = cat.topic_id"""

CENTROIDS = """
cd as (select label topic_id, d, avg(cast(x as double)) m from
       (select label, unnest(embedding) x, generate_subscripts(embedding,1) d from embeddings) group by all),
cn as (select topic_id, sqrt(sum(m*m)) cnorm from cd group by all),
vd as (select vec_id, unnest(embedding) x, generate_subscripts(embedding,1) d from embeddings),
vn as (select vec_id, sqrt(sum(cast(x as double)*cast(x as double))) vnorm from vd group by all),
dots as (select vd.vec_id, cd.topic_id, sum(cast(vd.x as double)*cd.m) dot from vd join cd using (d) group by all),
cosv as (select dots.vec_id, dots.topic_id, coalesce(dot / nullif(vnorm * cnorm, 0), -1.0) cos from dots join vn using (vec_id) join cn using (topic_id)),
bestc as (select vec_id, topic_id, cos from cosv qualify row_number() over (partition by vec_id order by round(cos,10) desc, topic_id) = 1),
z as (select c.vec_id, sum(exp((c.cos - b.cos)/0.05)) z from cosv c join bestc b using (vec_id) group by all),
va as (select b.vec_id, cast(case when b.cos >= 0.15 then b.topic_id else -1 end as int) topic_id, 1.0 / z.z probability, b.cos best_cosine
       from bestc b join z using (vec_id))"""

SQL["topic_assign"] = f"with {CENTROIDS} select vec_id, topic_id, round(probability,6) probability, round(best_cosine,6) best_cosine from va"
SQL["topic_probability"] = f"with {CENTROIDS} select vec_id, round(probability,6) max_probability from va"
SQL["topic_probability_forms"] = f"""with {CENTROIDS}
select vec_id, form, case form when 'number' then round(probability,6) when 'distribution' then round(greatest(probability, (1 - probability) / 2),6) end probability
from va cross join (values ('number'), ('distribution'), ('none')) f(form)"""
SQL["topic_centroids"] = f"""with {CENTROIDS} select cast(topic_id as int) topic_id, cast(d - 1 as int) dim, round(m,6) value from cd"""

MODEL_TERMS = "lt as (select doc_id, va.topic_id, text from documents join va on vec_id = doc_id)," + TOPIC_TERMS.split("\n", 2)[2]
SQL["topic_model_roundtrip"] = f"""with {CENTROIDS},
{MODEL_TERMS},
mt as (select topic_id, list(term order by rank) terms, list(weight order by rank) weights from tt group by topic_id)
select vec_id, va.topic_id, {display_name('va.topic_id', 'cast(null as varchar)', 'coalesce(terms, [])')} topic_name,
 cast(len(coalesce(terms, [])) as int) n_terms, round(weights[1],6) first_weight, round(probability,6) probability, 1 same
from va left join mt on va.topic_id = mt.topic_id"""


def topic_text(src: str) -> str:
    return TOPIC_TEXT.replace("docs as (select id, cleaned_text from feed)", f"docs as (select id, cleaned_text from {src})")


# ---------------------------------------------------------------- enrichment and results

KWTEXT = """
kwtext as (select id, string_agg(keyword || ':' || cast(frequency as varchar), ' ' order by rank) kwtext from kw group by id)"""

ENRICH = f"""{BASE},{KW},{KWTEXT},{LEXICON},{TOPIC_TERMS},{TOPIC_INFO},{topic_text('valid')},
stext as (select id*2 sid, cleaned_text t from valid union all select id*2+1, summary from kwsum),
{lexicon_scores(LABELS, src='stext', key='sid', text='t')},
sent as (select id // 2 did, id % 2 slot, string_agg(label, ',' order by rank) ranking, max(score) top from rk group by id)"""

SQL["enrich_documents"] = f"""{ENRICH}
select v.id, v.raw_mongo_id, v.source, {ts('v.original_timestamp')} original_timestamp, v.retrieved_by_keyword,
 v.keyword_concept_id, v.keyword_language original_keyword_language, v.detected_language,
 case when {nonblank('v.cleaned_text')} then coalesce(s0.ranking, '') else '' end sentiment_ranking,
 round(s0.top, 6) top_score,
 a.topic_id, {display_name('a.topic_id', 'cat.stored_name', 'coalesce(cat.terms, [])')} topic_name,
 round(a.probability, 6) topic_probability, cast(len(coalesce(cat.terms, [])) as int) n_topic_terms,
 cast(ks.n_keywords as int) n_keywords, coalesce(kt.kwtext, '') keywords_text,
 case when ks.n_keywords > 0 and {nonblank('ks.summary')} then coalesce(s1.ranking, '') end summary_ranking,
 round(s1.top, 6) summary_top_score, 0 n_errors
from valid v join kwsum ks using (id) left join kwtext kt using (id)
 left join sent s0 on s0.did = v.id and s0.slot = 0 left join sent s1 on s1.did = v.id and s1.slot = 1
 left join assigned a on a.id = v.id left join cat on cat.topic_id = a.topic_id"""



def char_class_scores(src: str, key: str, text: str) -> str:
    """The stand-in model: softmax over the shares of code points by their remainder."""
    return f"""
mtext as (select {key} id, {text} t from {src} where {nonblank(text)}),
mlab as (select * from {_label_values(LABELS)}),
mcode as (select id, unicode(unnest(string_split(t, ''))) % 7 label_pos from mtext),
mcnt as (select id, label_pos, count(*) n from mcode group by all),
mx as (select m.id, l.label_pos, l.label, 10.0 * coalesce(c.n, 0) / length(m.t) x
       from mtext m cross join mlab l left join mcnt c on c.id = m.id and c.label_pos = l.label_pos),
me as (select *, exp(x - max(x) over (partition by id)) e from mx),
ms as (select id, label, label_pos, e / sum(e) over (partition by id) score from me),
mr as (select id, label, score, cast(row_number() over (partition by id order by round(score,8) desc, label_pos) as int) rank from ms)"""


SQL["label_scores_model"] = f"with {FEED},{char_class_scores('feed', 'id', 'cleaned_text')} select id, rank, label, round(score,6) score from mr"

SQL["enrich_with_model"] = f"""{BASE},{KW},{TOPIC_TERMS},{TOPIC_INFO},{topic_text('valid')},
mboth as (select id*2 sid, cleaned_text t from valid union all select id*2+1, summary from kwsum where n_keywords > 0),
{char_class_scores('mboth', 'sid', 't')},
msent as (select id // 2 did, id % 2 slot, string_agg(label, ',' order by rank) ranking, max(score) top from mr group by id)
select v.id, coalesce(s0.ranking, '') sentiment_ranking, round(s0.top, 6) top_score,
 a.topic_id, {display_name('a.topic_id', 'cat.stored_name', 'coalesce(cat.terms, [])')} topic_name, round(a.probability, 6) topic_probability,
 cast(ks.n_keywords as int) n_keywords, s1.ranking summary_ranking, round(s1.top, 6) summary_top_score, 0 n_errors
from valid v join kwsum ks using (id)
 left join msent s0 on s0.did = v.id and s0.slot = 0 left join msent s1 on s1.did = v.id and s1.slot = 1
 left join assigned a on a.id = v.id left join cat on cat.topic_id = a.topic_id"""

SQL["analysis_errors"] = f"""{BASE},
t as (select id, coalesce({nonblank('cleaned_text')}, false) nb, length(cleaned_text) n from valid),
e as (
 select 'full' variant, id, [] errs, cast(null as double) p from t
 union all select 'no_topic_model', id, ['BERTopic model is not loaded, skipping topic modeling.'], null from t
 union all select 'failing_texts', id, [
   case when nb and n % 7 = 3 then 'Overall sentiment analysis failed or returned no result for non-empty text.' end,
   case when nb and n % 5 = 2 then 'Topic modeling (transform) returned no result for non-empty text.' end],
   case when not nb then 1.0 when n % 5 = 2 then null when n % 3 = 0 then 0.5 when n % 3 = 1 then greatest(0.25, (n % 4) / 4.0) end from t
 union all select 'nothing_loaded', id, [
   case when nb then 'Overall sentiment analysis failed or returned no result for non-empty text.' end,
   'BERTopic model is loaded, but its SBERT embedding_model is missing. Skipping topic modeling.'], null from t),
f as (select variant, id, list_filter(errs, lambda x: x is not null) errs, p from e)
select variant, id, cast(len(errs) as int) n_errors, case when len(errs) > 0 then array_to_string(errs, ' | ') end errors, round(p, 6) topic_probability from f"""

LATEST_BY_KEY = "qualify row_number() over (partition by raw_mongo_id order by original_timestamp desc nulls first, id desc) = 1"

SQL["dedupe_latest"] = f"""{BASE}
select raw_mongo_id, id, {ts('original_timestamp')} original_timestamp from valid {LATEST_BY_KEY}"""

RESTAB = f"""{BASE},{KW},{TOPIC_TERMS},{topic_text('valid')},
res as (select v.*, ks.n_keywords, a.topic_id, a.probability from valid v join kwsum ks using (id)
        left join assigned a using (id) {LATEST_BY_KEY}),
restab as (select *, case when original_timestamp < timestamp '2024-02-01 00:00:00' then 'extracted' else 'pending' end
           signal_extraction_status from res)"""

REQUESTS = f"""
sent as (select *, id % 29 = 4 or id % 31 = 6 damaged, id % 43 = 10 id_bad from norm),
asked as (select * replace (case when id % 41 <> 9 then raw_mongo_id end as raw_mongo_id,
    case when id % 37 = 8 then 'reject' when tokens is null then 'null' else 'ok' end as tokens_state,
    case when lemmas is null then 'null' else 'ok' end as lemmas_state),
  case when id % 5 <> 0 and not id_bad then id end source_id from sent),
judged as (select *, case when damaged then ['line is not a request in JSON'] else
    list_concat({REASONS}, case when id_bad then ['id must be an integer'] else [] end) end reasons from asked),
valid as (select * from judged where len(reasons) = 0)"""

SQL["request_enrich"] = f"""with {FEED},{NORM},{REQUESTS},{KW},{TOPIC_TERMS},{topic_text('valid')},
kept as (select * from valid {LATEST_BY_KEY})
select 'stored' outcome, k.raw_mongo_id, k.source_id, null reasons, cast(ks.n_keywords as int) n_keywords, a.topic_id, cast(1 as bigint) n_lines
from kept k join kwsum ks using (id) left join assigned a using (id)
union all
select 'rejected', null, null, array_to_string(reasons, '; '), null, null, count(*) from judged where len(reasons) > 0 group by reasons"""

SQL["upsert_results"] = f"""{RESTAB},
newd as (select id, raw_mongo_id from valid where nlp_status = 'pending_nlp_store_verification' {LATEST_BY_KEY})
select raw_mongo_id, id source_id, cast(1 as bigint) batch_id, signal_extraction_status, cast(n_keywords as int) n_keywords
from restab where raw_mongo_id not in (select raw_mongo_id from newd)
union all
select n.raw_mongo_id, n.id, cast(2 as bigint), 'pending', cast(ks.n_keywords as int) from newd n join kwsum ks using (id)"""

# ---------------------------------------------------------------- ledger

PASS1 = f"""{BASE},
p1 as (select id,
  case when len(reasons) > 0 then 'failed_nlp_analysis' when batch_id = 2 then 'pending_nlp_store_verification'
       else 'completed' end nlp_status,
  timestamp '2024-06-01 00:00:00' + to_minutes(cast(batch_id as int)) nlp_status_timestamp, batch_id
 from (select *, cast(coalesce(floor(date_diff('second', timestamp '2024-01-01 00:00:00', original_timestamp) / 86400) + 1, 1000) as bigint) batch_id
       from backlog) where id is not null),
l1 as (select * from p1 qualify row_number() over (partition by id order by nlp_status_timestamp desc, batch_id desc) = 1),
cur as (select f.id, coalesce(l1.nlp_status, f.nlp_status) nlp_status,
        case when l1.nlp_status is not null then l1.nlp_status_timestamp end nlp_status_timestamp
        from feed f left join l1 using (id))"""

SQL["outcome_status"] = f"{PASS1} select id, nlp_status, batch_id from p1"
SQL["outcome_counts"] = f"""{PASS1}
select batch_id, count(*) evaluated, cast(count_if(nlp_status <> 'failed_nlp_analysis') as bigint) succeeded,
 cast(count_if(nlp_status = 'failed_nlp_analysis') as bigint) failed,
 cast(count_if(nlp_status = 'pending_nlp_store_verification') as bigint) store_unverified
from p1 group by batch_id"""
SQL["status_update"] = f"""{PASS1}
select batch_id, nlp_status, count(*) updated from p1 where id in (select id from feed where id is not null) group by all"""
SQL["backlog_with_log"] = f"{PASS1} select id, nlp_status, {ts('nlp_status_timestamp')} nlp_status_timestamp from cur"
SQL["retry_backlog"] = f"""{PASS1} select id, nlp_status from cur where {ELIGIBLE}"""
SQL["latest_status"] = f"""{PASS1},
retry as (select c.id from cur c where {ELIGIBLE.replace('nlp_status', 'c.nlp_status')}),
p2 as (select v.id, case when len(v.reasons) > 0 then 'failed_nlp_analysis' else 'completed' end nlp_status,
       timestamp '2024-07-01 00:00:00' nlp_status_timestamp, cast(2000 as bigint) batch_id
       from validated v join retry using (id)),
alllog as (select * from p1 union all select * from p2)
select id, nlp_status, batch_id, {ts('nlp_status_timestamp')} nlp_status_timestamp from alllog
qualify row_number() over (partition by id order by nlp_status_timestamp desc, batch_id desc) = 1"""

# ---------------------------------------------------------------- access paths

SQL["results_by_topic"] = f"{RESTAB} select raw_mongo_id, round(probability, 6) probability from restab where topic_id = 1"
SQL["signal_queue"] = f"""{RESTAB}
select raw_mongo_id, {ts('original_timestamp')} original_timestamp from restab where signal_extraction_status = 'pending'
"""
SQL["results_by_time"] = f"""{RESTAB}
select raw_mongo_id, {ts('original_timestamp')} original_timestamp, source from restab
where original_timestamp >= timestamp '2024-01-10 00:00:00' and original_timestamp < timestamp '2024-01-20 00:00:00'"""
SQL["results_by_concept"] = f"""{RESTAB}
select raw_mongo_id, keyword_concept_id, retrieved_by_keyword from restab
where keyword_concept_id = '{'c' * 23}5' or raw_mongo_id = lpad('42', 24, '0')"""

# ---------------------------------------------------------------- streaming

SQL["stream_enrich"] = f"""{RESTAB}
select raw_mongo_id, id source_id, 'pending' signal_extraction_status, cast(n_keywords as int) n_keywords, topic_id from res"""
SQL["stream_status"] = f"""{BASE}
select id, case when len(reasons) > 0 then 'failed_nlp_analysis' else 'completed' end nlp_status from backlog"""

# ---------------------------------------------------------------- keyphrases

KEYPHRASES = r"""
kd as (select doc_id, case when length(lang)=2 then lang else 'en' end lang, text from documents),
stops as (select lang, term from (
   select lang, term, row_number() over (partition by lang order by count(*) desc, term asc) r
   from (select lang, unnest(regexp_extract_all(lower(text),'\p{L}+')) term from kd) group by lang, term) where r <= 50),
ks as (select doc_id, lang, generate_subscripts(parts, 1) - 1 s_idx, unnest(parts) sentence
       from (select doc_id, lang, regexp_split_to_array(text, '[.!?\n]+') parts from kd)),
kw as (select doc_id, lang, s_idx, regexp_extract_all(sentence, '\p{L}+') words from ks),
kw2 as (select * from kw where len(words) > 0),
nsent as (select doc_id, count(*) n_sent from kw2 group by doc_id),
tok as (select doc_id, lang, s_idx, i - 1 w_idx, words[i] word, lower(words[i]) term,
               lower(words[i-1]) lft, lower(words[i+1]) rgt
        from (select *, unnest(range(1, len(words) + 1)) i from kw2)),
terms as (select doc_id, lang, term, count(*) tf,
   count_if(not (length(word) > 1 and regexp_matches(word, '^\p{Lu}+$')) and w_idx > 0 and regexp_matches(word, '^\p{Lu}')) tf_cap,
   count_if(length(word) > 1 and regexp_matches(word, '^\p{Lu}+$')) tf_upper,
   quantile_cont(cast(s_idx as double), 0.5) med, count(distinct s_idx) sent_tf,
   count(distinct lft) dl_n, count(lft) dl_d, count(distinct rgt) dr_n, count(rgt) dr_d
   from tok group by all),
terms2 as (select t.*, (s.term is not null) is_stop from terms t left join stops s using (lang, term)),
dstats as (select doc_id, avg(tf) mean_tf, stddev_pop(tf) std_tf, max(tf) max_tf from terms2 where not is_stop group by doc_id),
ts as (select t.doc_id, t.term, t.is_stop,
   (1.0 + ((case when dl_d > 0 then dl_n / dl_d else 0.0 end) + (case when dr_d > 0 then dr_n / dr_d else 0.0 end)) * tf / max_tf) rel,
   ln(ln(3.0 + med)) pos, greatest(tf_cap, tf_upper) / (1.0 + ln(tf)) cse, tf / (mean_tf + std_tf) frq, sent_tf / n_sent snt
   from terms2 t join dstats using (doc_id) join nsent using (doc_id)),
tsc as (select doc_id, term, is_stop, rel * pos / (cse + frq / rel + snt / rel) s from ts),
grams as (select doc_id, lang, list_transform(g, lambda x: lower(x)) terms from (
   select doc_id, lang, unnest(list_transform(range(0, len(words) - n + 1), lambda i: words[i+1:i+n])) g
   from kw2, (select unnest([1, 2, 3]) n) nn where len(words) >= n)),
cands as (select doc_id, terms, count(*) tf from grams g
   where not exists (select 1 from stops s where s.lang = g.lang and s.term = g.terms[1])
     and not exists (select 1 from stops s where s.lang = g.lang and s.term = g.terms[-1])
   group by doc_id, terms),
ct as (select doc_id, terms, tf, unnest(terms) term from cands),
scored as (select ct.doc_id, ct.terms, ct.tf, sum(ln(greatest(tsc.s, 1e-300))) log_prod, sum(tsc.s) sum_s
   from ct join tsc on ct.doc_id = tsc.doc_id and ct.term = tsc.term where not tsc.is_stop group by all),
kc as (select doc_id, array_to_string(terms, ' ') phrase, cast(len(terms) as int) n, tf,
   exp(log_prod) / (tf * (1.0 + sum_s)) score from scored),
kr as (select *, cast(row_number() over (partition by doc_id order by round(score, 10), phrase) as int) rank from kc)"""

SQL["keyphrase_scores"] = f"with {KEYPHRASES} select doc_id, rank, phrase, n, tf, round(score, 6) score from kr where rank <= 10"

# DuckDB's edit distance counts bytes: letters beyond ASCII become capitals, which a phrase has not
FOLD = "translate({c}, 'ßàáâäçèéêëìíîïñòóôöùúûü', 'ABCDEFGHIJKLMNOPQRSTUVW')"

DEDUP = f"""
kl as (select doc_id, list([{{'p': phrase, 'f': {FOLD.format(c='phrase')}, 's': score}}] order by round(score, 10), phrase) c from kc group by doc_id),
kk as (select doc_id, list_reduce(c, lambda acc, x: case when len(acc) < 10 and not coalesce(list_bool_or(list_transform(acc,
   lambda k: 1.0 - cast(levenshtein(k.f, x[1].f) as double) / greatest(length(k.f), length(x[1].f)) > 0.9)), false)
   then list_concat(acc, x) else acc end, []) kept from kl),
kd2 as (select doc_id, unnest(kept) k, generate_subscripts(kept, 1) rank from kk)"""

KEPT = "select doc_id, cast(rank as int) rank, k.p phrase, round(k.s, 6) score from kd2"

SQL["keyphrases"] = f"with {KEYPHRASES},{DEDUP} {KEPT}"


def shipped_stopwords() -> dict[str, list[str]] | None:
    """The lists of the languages in the tables, read from Spark's own archive; None without it."""
    names = {"de": "german", "en": "english", "es": "spanish", "fr": "french"}
    for jar in Path(pyspark.__path__[0]).glob("jars/spark-mllib_*.jar"):
        with zipfile.ZipFile(jar) as z:
            return {c: z.read(f"org/apache/spark/ml/feature/stopwords/{n}.txt").decode().split() for c, n in names.items()}
    return None


def language_keyphrases(words: dict[str, list[str]]) -> str:
    rows = ",".join(f"('{c}', '{w.replace(chr(39), chr(39) * 2)}')" for c, ws in words.items() for w in ws)
    stops = f"stops as (select distinct lang, unnest(regexp_extract_all(lower(w), '\\p{{L}}+')) term from (values {rows}) v(lang, w)),"
    head, rest = KEYPHRASES.split("stops as (", 1)
    return head + stops + "\nks as (" + rest.split("\nks as (", 1)[1]


if words := shipped_stopwords():
    SQL["keyphrase_scores_language"] = (
        f"with {language_keyphrases(words)} select doc_id, rank, phrase, n, tf, round(score, 6) score from kr where rank <= 10"
    )
    SQL["keyphrases_language"] = f"with {language_keyphrases(words)},{DEDUP} {KEPT}"
