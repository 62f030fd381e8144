"""The SQL every query of ``queries`` must agree with.

Built from common table expressions; each names the tables it reads, and
``sql`` prepends those a query needs.
"""

from __future__ import annotations

import re

from checks.fixtures import MODEL_A, MODEL_B, MODEL_PICKY
from traceline.functions.prompts import EMPTY_FILE_MESSAGE, SUMMARY_PROMPT, TASK_PROMPT
from traceline.operators.embed import HashModel

CTES: dict[str, str] = {}

CTES["files"] = """
select source as repo_id, doc_id as pos,
  source || '/' || lang || '/doc_' || doc_id ||
    case lang when 'en' then '.php' when 'fr' then '.py' when 'de' then '.txt' else '.PHP' end as path,
  text as content
from documents
union all
select 'web', page_id, 'web/page_' || page_id || '.html', html from pages
"""
CTES["decoded"] = """
select * from files where suffix(path, '.py') or suffix(path, '.sh') or suffix(path, '.java') or suffix(path, '.php')
  or suffix(path, '.js') or suffix(path, '.htm') or suffix(path, '.html') or suffix(path, '.vue')
"""
CTES["reqs"] = """
select d.doc_id as row_idx, d.source as section_name,
  case when l.toxic = 1 then '[DELETED, toxic] ' else '' end || d.text ||
    case when d.lang = 'fr' then ' (C' || d.doc_id || ')' else '' end as req_description
from documents d left join labels l using (doc_id)
"""
CTES["cleaned"] = r"""
select row_idx, section_name, regexp_replace(req_description, '\s*\([^)]*\)', '', 'g') as req_description
from reqs where not contains(req_description, '[DELETED')
"""
CTES["sections"] = """
select section_name, min(row_idx) as first_row, string_agg(req_description, ' ' order by row_idx) as query_text
from cleaned group by section_name
"""
CTES["query_texts"] = """
select 'item_' || item_id as query_id, text as query from benchmark
union all
select 'turn_' || conv_id || '_' || turn, text from conversations where role = 'user'
"""


def _hash_ctes(name: str, source: str, keys: str, text: str, model: HashModel) -> None:
    """``{name}``: the keys and the vector ``v`` of every text the model embeds."""
    first = model.first_digit + 1
    fits = f"where not contains({text}, '{model.refuse}')" if model.refuse is not None else ""
    CTES[f"{name}_words"] = f"""
select {keys}, ('0x' || substr(md5(lower(w)), {first}, 8))::bigint % {model.dim} as bucket
from (select {keys}, unnest(string_split_regex({text}, '[^A-Za-z0-9]+')) as w from {source} {fits}) where w <> ''
"""
    CTES[f"{name}_counts"] = f"select {keys}, bucket, count(*) as c from {name}_words group by all"
    CTES[f"{name}_grid"] = f"""
select {keys}, n, unnest(range({model.dim})) as bucket
from (select {keys}, sqrt(sum(c * c)) as n, sum(c) as words from {name}_counts group by all)
"""
    CTES[name] = f"""
select {keys}, list((coalesce(c, 0) / n)::float::double order by bucket) as v
from {name}_grid left join {name}_counts using ({keys}, bucket) group by {keys}
"""


_hash_ctes("files_a", "files", "repo_id, pos, path", "content", MODEL_A)
_hash_ctes("files_b", "files", "repo_id, pos, path", "content", MODEL_B)
_hash_ctes("files_picky", "files", "repo_id, pos, path", "content", MODEL_PICKY)
_hash_ctes("decoded_a", "decoded", "repo_id, pos, path", "content", MODEL_A)
_hash_ctes("decoded_b", "decoded", "repo_id, pos, path", "content", MODEL_B)
_hash_ctes("sections_a", "sections", "section_name, first_row", "query_text", MODEL_A)
_hash_ctes("sections_b", "sections", "section_name, first_row", "query_text", MODEL_B)
_hash_ctes("asks_a", "query_texts", "query_id", "query", MODEL_A)

CTES["vec_a"] = """
select vec_id as idx, 'v/' || vec_id || '/f' || label || '.php' as path, label, embedding::double[] as v from embeddings
"""
CTES["vec_b"] = "select idx, path, label, v || list_transform(v, lambda x: x * x) as v from vec_a"
for m in ("a", "b"):
    CTES[f"vsec_{m}"] = f"""
select 'f' || label as section_name, min(first_row) as first_row, list(mean order by place) as v from (
  select label, place, min(idx) as first_row, avg(x) as mean from (
    select label, idx, unnest(v) as x, generate_subscripts(v, 1) as place from vec_{m}) group by label, place) group by label
"""

_DISTANCE = "sqrt(greatest(0, 2 * (1 - round(list_cosine_similarity(q.v, f.v), 9))))"


def _top(queries: str, files: str, by: str, scope: str, keep: str, depth: int | None) -> str:
    by_q = ", ".join(f"q.{c.strip()}" for c in by.split(","))
    scoped = ", ".join(([f"f.{scope}"] if scope else []) + [by_q])
    kept = ", ".join(f"f.{c.strip()}" for c in keep.split(","))
    order = keep.split(",")[0].strip()
    cut = f"qualify rk <= {depth}" if depth is not None else ""
    return f"""
select {scoped}, {kept}, {_DISTANCE} as distance,
  (row_number() over (partition by {scoped} order by {_DISTANCE}, f.{order}))::int as rk
from {queries} q, {files} f {cut}
"""


CTES["near"] = _top("(select idx as q, v from vec_a)", "vec_a", "q", "", "idx, path", 4)
for m in ("a", "b"):
    CTES[f"vhits_{m}"] = _top(f"vsec_{m}", f"vec_{m}", "section_name, first_row", "", "idx, path", 20)
# The approximate search: the same lines, buckets and probes, with the plan of ``queries.knn_lsh``.
CTES["lsh_far"] = """
select idx, j, round(sum(x * s) / sqrt(64) / any_value(size), 9) as far
from (select idx, unnest(v) as x, generate_subscripts(v, 1) - 1 as d, sqrt(list_sum(list_transform(v, lambda c: c * c))) as size from vec_a)
join (select j, d, case when md5('42:' || j || ':' || d) >= '8' then 1 else -1 end as s from range(24) a(j), range(64) b(d)) using (d)
group by idx, j
"""
CTES["lsh_codes"] = """
select idx, j // 6 as tab, sum(case when far >= 0 then 1 << (j % 6)::int else 0 end)::bigint as code from lsh_far group by idx, tab
"""
CTES["lsh_probes"] = """
select c.idx as q, c.tab, xor(c.code, bits) as code from (
  select idx, tab, m, sum(case when (m >> place) & 1 = 1 then 1 << bit else 0 end)::bigint as bits,
    round(sum(case when (m >> place) & 1 = 1 then far * far else 0 end), 9) as cost
  from (select idx, j // 6 as tab, (j % 6)::int as bit, far,
          (row_number() over (partition by idx, j // 6 order by abs(far), j) - 1)::bigint as place from lsh_far), range(64) t(m)
  group by idx, tab, m) p
join lsh_codes c using (idx, tab)
qualify row_number() over (partition by c.idx, c.tab order by cost, m) <= 3
"""
CTES["lsh_near"] = f"""
select q.idx as q, f.idx, f.path, {_DISTANCE} as distance,
  (row_number() over (partition by q.idx order by {_DISTANCE}, f.idx))::int as rk
from (select distinct p.q, c.idx from lsh_probes p join lsh_codes c using (tab, code)) w
join vec_a q on q.idx = w.q join vec_a f on f.idx = w.idx qualify rk <= 4
"""
CTES["full_rank"] = _top("vsec_a", "vec_a", "section_name", "", "idx", None)
CTES["listed"] = """
select repo_id, pos * 2 + (repo_id = 'web')::int as idx, path, v from files_a
"""
CTES["search"] = _top("asks_a", "listed", "query_id", "", "idx, repo_id, path", 4)
CTES["single_hits"] = _top("sections_a", "decoded_a", "section_name, first_row", "repo_id", "pos, path", 3)


def _list(hits: str, keys: str) -> str:
    """Aligned threshold, then one row per base name."""
    return f"""
select {keys}, split_part(path, '/', -1) as file_name, arg_max(cos(distance), rk) as score, min(rk) as pos
from {hits} where distance > 0.5 group by {keys}, split_part(path, '/', -1)
"""


def _results(hits: str, listed: str, keys: str) -> str:
    """Result table of one model: lists numbered, empty sections kept."""
    return f"""
select {keys}, 'common_files' as kind, (row_number() over (partition by {keys} order by pos))::int as pos, file_name, score
from {listed}
union all
select distinct {keys}, null, null::int, null, null::double from {hits}
where ({keys}) not in (select ({keys}) from {listed})
"""


CTES["single_list"] = _list("single_hits", "repo_id, section_name, first_row")
CTES["single"] = _results("single_hits", "single_list", "repo_id, section_name, first_row")


def _dual(first: str, second: str, keys: str) -> str:
    side = """select {keys}, split_part(path, '/', -1) as file_name, min(distance) as near, cos(max(distance)) as score
      from {hits} where distance > 0.5 group by {keys}, split_part(path, '/', -1)"""
    a, b = side.format(keys=keys, hits=first), side.format(keys=keys, hits=second)
    return f"""
select {keys}, kind,
  row_number() over (partition by {keys}, kind order by src, near, file_name) as pos, file_name, score
from (
  select {keys}, file_name,
    case when a.near is not null and b.near is not null then 'common_files' else 'only_one_model' end as kind,
    case when a.near is not null then 1 else 2 end as src,
    coalesce(a.near, b.near) as near,
    case when a.near is not null and b.near is not null then (a.score + b.score) / 2 else coalesce(a.score, b.score) end as score
  from ({a}) a full join ({b}) b using ({keys}, file_name)
)
union all
select distinct {keys}, null, null::bigint, null, null::double
from (select {keys}, distance from {first} union all select {keys}, distance from {second})
group by {keys} having max(distance) <= 0.5
"""


for m in ("a", "b"):
    CTES[f"dual_{m}"] = _top(f"sections_{m}", f"decoded_{m}", "section_name, first_row", "repo_id", "pos, path", None)
CTES["dual"] = _dual("dual_a", "dual_b", "repo_id, section_name, first_row")

_SETUPS = []
for depth in (3, 20):
    for m in ("a", "b"):
        CTES[f"vhits_{m}{depth}"] = f"select * from vhits_{m} where rk <= {depth}"
        CTES[f"vlist_{m}{depth}"] = _list(f"vhits_{m}{depth}", "section_name, first_row")
        CTES[f"vres_{m}{depth}"] = _results(f"vhits_{m}{depth}", f"vlist_{m}{depth}", "section_name, first_row")
        _SETUPS.append((f"vec_{m}_top{depth}", f"vres_{m}{depth}"))
    CTES[f"vres_dual{depth}"] = _dual(f"vhits_a{depth}", f"vhits_b{depth}", "section_name, first_row")
    _SETUPS.append((f"dual_top{depth}", f"vres_dual{depth}"))
CTES["written"] = "\nunion all\n".join(
    f"select '{name}' as model, section_name, kind, pos::int as pos, file_name, score from {cte}" for name, cte in _SETUPS
)
CTES["evaluated"] = """
select model, section_name, (count(score) filter (hit) > 0)::int as retrieved, coalesce(max(score) filter (hit), 0.0) as score
from (select *, kind = 'common_files' and file_name = section_name || '.php' as hit from written)
group by model, section_name
"""
CTES["confusion"] = """
select section_name, count(*) filter (got and due) as "TP", count(*) filter (got and not due) as "FP",
  count(*) filter (not got and not due) as "TN", count(*) filter (not got and due) as "FN"
from (
  select s.section_name, s.section_name = 'f' || f.label as due,
    (s.section_name, f.path) in (select (section_name, path) from vhits_a) as got
  from vsec_a s, vec_a f
) group by section_name
"""
CTES["ratios"] = """
select *, "TP" / nullif("TP" + "FP", 0) as precision, "TP" / nullif("TP" + "FN", 0) as recall,
  "TN" / nullif("TN" + "FP", 0) as specificity
from confusion
"""
CTES["metrics"] = """
select section_name, "TP", "FP", "TN", "FN", precision, recall,
  2 * precision * recall / nullif(precision + recall, 0) as f1_score, specificity, (recall + specificity) / 2 as balanced_accuracy
from ratios
"""
CTES["summed"] = """
select count(*) as sections, sum("TP")::bigint as "TP", sum("FP")::bigint as "FP", sum("TN")::bigint as "TN", sum("FN")::bigint as "FN",
  count(*) filter (precision = 1 and recall = 1) as perfect_sections,
  avg(precision) as macro_precision, avg(recall) as macro_recall, avg(f1_score) as macro_f1_score,
  avg(specificity) as macro_specificity, avg(balanced_accuracy) as macro_balanced_accuracy,
  sum("TP") / nullif(sum("TP" + "FP"), 0) as p, sum("TP") / nullif(sum("TP" + "FN"), 0) as r,
  sum("TN") / nullif(sum("TN" + "FP"), 0) as s
from metrics
"""
CTES["word_lists"] = r"""
select repo_id, pos * 2 + (repo_id = 'web')::int as pos, path, list_filter(string_split_regex(content, '[ \t\n\r\f]+'), lambda w: w <> '') as words from files
"""
CTES["chunked"] = """
select repo_id, pos * 2147483648 + chunk as idx, pos * 2147483648 + chunk as pos, path,
  array_to_string(words[chunk * 180 + 1 : chunk * 180 + 200], ' ') as content
from (select *, unnest(range(greatest(0, ceil((len(words) - 200) / 180))::int + 1)) as chunk from word_lists where len(words) > 0)
"""
_hash_ctes("chunks_a", "chunked", "repo_id, pos, path, content", "content", MODEL_A)
CTES["context_hits"] = _top("asks_a", "chunks_a", "query_id", "", "pos, path, content", 2)


def _literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _filled(template: str, **values: str) -> str:
    parts = re.split(r"\{(" + "|".join(values) + r")\}", template)
    return " || ".join(values[p] if i % 2 else _literal(p) for i, p in enumerate(parts))


def _weights(source: str, keys: str, dim: int) -> str:
    return f"""
select {keys}, bucket::int as bucket, round(v[bucket + 1], 6) as weight
from (select {keys}, v, unnest(range({dim})) as bucket from {source})
"""


def _ranked(source: str) -> str:
    return f"(select *, row_number() over (partition by repo_id order by pos) - 1 as idx from {source})"


_METRICS = """select section_name, "TP", "FP", "TN", "FN", round(precision, 6) as precision, round(recall, 6) as recall,
  round(f1_score, 6) as f1_score, round(specificity, 6) as specificity, round(balanced_accuracy, 6) as balanced_accuracy from metrics"""
_NEAR = "select q, rk, idx, path, round(distance, 6) as distance from near"
_RESULT = "repo_id, section_name, kind, pos, file_name, round(score, 6) as score"
_ENCODED = f"select repo_id, idx, path, to_base64(encode(content)) as content from {_ranked('files')}"

ORACLE: dict[str, str] = {
    "src_repo_tree": _ENCODED,
    "src_repo_tree_ranges": _ENCODED,
    "src_payload": _ENCODED,
    "src_files": "select repo_id, path, content from files",
    "src_requirements": "select row_number() over (order by row_idx) - 1 as row_idx, section_name, req_description from reqs",
    "src_directory": """select repo_id as folder, sum(length(content) + 1)::bigint as n_chars,
      sum(length(content) - length(replace(content, chr(10), '')) + 1)::bigint as n_lines,
      sum(list_sum(list_transform(list_filter(string_split(content, chr(10)), lambda x: x <> ''), lambda x: ('0x' || substr(md5(x), 1, 8))::bigint)))::bigint as digest
      from files group by repo_id""",
    "src_results": "select model, section_name, kind, pos, file_name, round(score, 6) as score from written",
    "src_metrics": _METRICS,
    "file_contents": """select s.query_id, s.rk, s.path, length(coalesce(d.content, '')) as n_chars, md5(coalesce(d.content, '')) as digest
      from search s left join decoded d using (repo_id, path)""",
    "filter_extension": "select repo_id, path from decoded",
    "decode_repo": "select repo_id, pos, path, content from decoded",
    "decoded_files": "select repo_id, pos, path, content from decoded",
    "basename": "select path, split_part(path, '/', -1) as file_name from files",
    "index_numbering": f"select repo_id, idx, path from {_ranked('files_picky')}",
    "clean_requirements": "select row_idx, section_name, req_description from cleaned",
    "distinct_sections": "select section_name, first_row, row_number() over (order by first_row) - 1 as section_idx from sections",
    "section_queries": "select section_name, first_row, query_text from sections",
    "embed_hash": _weights("files_a", "repo_id, path", 64),
    "embed_two_models": f"""select repo_id, path, bucket, weight, 'hash_picky' as model from ({_weights('files_picky', 'repo_id, path', 64)})
      union all
      select repo_id, path, bucket, weight, 'hash_b' from ({_weights('files_b', 'repo_id, path', 32)})
      where (repo_id, path) in (select (repo_id, path) from files_picky)""",
    "embed_queries": _weights("asks_a", "query_id", 64),
    "embed_ok": "select repo_id, 'hash_picky' as model, path, 64 as dim from files_picky",
    "failed_files": """select repo_id, 'hash_picky' as model, path,
      case when contains(content, '@') then 'refused text' else 'no words' end as error
      from files where (repo_id, path) not in (select (repo_id, path) from files_picky)""",
    "embed_loaded": """select repo_id, path, unnest([0, 1, 2]) as bucket, round(unnest([length(content) / 1000,
      (length(content) - length(replace(content, 'e', ''))) / 1000, (length(content) - length(replace(content, chr(10), ''))) / 1000])::float::double, 6) as weight
      from files""",
    "run_totals": """select count(*) as files_found, count(s.path) as files_indexed, count(*) - count(s.path) as files_failed
      from files f left join files_picky s using (repo_id, path)""",
    "run_counts": """select f.repo_id, 'hash_picky' as model, count(*) as files_found, count(s.path) as files_indexed,
      count(*) - count(s.path) as files_failed from files f left join files_picky s using (repo_id, path) group by f.repo_id""",
    "index_roundtrip": f"select *, 'hash_picky' as model, 64 as dim from ({_weights(_ranked('files_picky'), 'repo_id, idx, path', 64)})",
    "index_map": f"select repo_id, 'hash_picky' as model, idx, path from {_ranked('files_picky')}",
    "total_files": "select repo_id, 'hash_picky' as model, count(*) as total_files from files_picky group by repo_id",
    "build_or_load": f"""select w.*, sha256(f.content) as digest, (f.repo_id <> 'web' and not suffix(f.path, '.py'))::int as reused
      from ({_weights('files_a', 'repo_id, path', 64)}) w join files f using (repo_id, path)""",
    "knn_topk": _NEAR,
    "knn_topk_block": _NEAR,
    "knn_topk_pivot": _NEAR,
    "knn_lsh": "select q, rk, idx, path, round(distance, 6) as distance from lsh_near",
    "knn_full_rank": "select section_name, rk::bigint as rk, idx, round(distance, 6) as distance from full_rank",
    "score": "select q, rk, idx, round(distance, 6) as distance, round(cos(distance), 6) as score from near",
    "threshold_aligned": "select q, rk, idx, round(cos(distance), 6) as score from near where distance > 0.5",
    "threshold_positional": """select a.q, a.rk, a.idx, round(cos(b.distance), 6) as score
      from near a join (select q, count(*) filter (distance <= 0.5) as m from near group by q) using (q)
      join near b on b.q = a.q and b.rk = a.rk + m""",
    "search_listing": "select query_id, rk, path, round(distance, 6) as distance from search",
    "dedupe_basename": "select section_name, file_name, round(score, 6) as score, pos from vlist_a20",
    "model_file_scores": "select section_name, pos, file_name, round(score, 6) as score from vlist_b20",
    "common_files": """select section_name, a.pos, file_name, round((a.score + b.score) / 2, 6) as score
      from vlist_a20 a join vlist_b20 b using (section_name, file_name)""",
    "unique_files": """select section_name, 1 as src, pos, file_name, round(score, 6) as score from vlist_a20
        where (section_name, file_name) not in (select (section_name, file_name) from vlist_b20)
      union all
      select section_name, 2, pos, file_name, round(score, 6) from vlist_b20
        where (section_name, file_name) not in (select (section_name, file_name) from vlist_a20)""",
    "match_single": f"select {_RESULT} from single",
    "match_kept": f"select {_RESULT} from single",
    "match_dual": f"select {_RESULT} from dual",
    "section_result": "select repo_id, section_name, 0 as n_only, pos, file_name, round(score, 6) as score from single",
    "result_json_roundtrip": f"select 3 as depth, {_RESULT} from single",
    "combined_payload": """select repo_id, n_sections, n_pairs, n_files, n_bytes, files_digest, pairs_digest from
      (select repo_id, count(distinct section_name) as n_sections, count(file_name) as n_pairs,
         sum(coalesce(('0x' || substr(md5(section_name || file_name), 1, 8))::bigint, 0))::bigint as pairs_digest from single group by repo_id)
      full join (select repo_id, count(*) as n_files, sum(strlen(content))::bigint as n_bytes,
         sum(('0x' || substr(md5(path || content), 1, 8))::bigint)::bigint as files_digest from files group by repo_id) using (repo_id)""",
    "prompt_table": f"""select query_id, rk, path, case when trim(content, ' ' || chr(9) || chr(10) || chr(13)) = '' then {_literal(EMPTY_FILE_MESSAGE)}
      else {_filled(TASK_PROMPT, path='path', query='query', content='content')} end as prompt
      from search join query_texts using (query_id) join files using (repo_id, path)""",
    "prompt_summary_table": f"""select query_id, rk, path, {_filled(SUMMARY_PROMPT, path='path', query='query', content='content')} as prompt
      from search join query_texts using (query_id) join files using (repo_id, path)""",
    "doc_context": """select query_id, string_agg(content, chr(10) || chr(10) order by rk) as context, count(*) as n_chunks
      from context_hits group by query_id""",
    "result_pairs": "select model, section_name, file_name, round(score, 6) as score from written where kind = 'common_files'",
    "eval_input": """select model, section_name, file_name, round(score, 6) as score from written where kind = 'common_files' and file_name is not null
      union all
      select model, section_name, null, null from written group by model, section_name
      having count(*) filter (where kind = 'common_files' and file_name is not null) = 0""",
    "eval_retrieved": "select model, section_name, retrieved, round(score, 6) as score from evaluated",
    "retrieve_accuracy": """select sum(retrieved)::bigint as ones_count, count(*) as row_count, round(100 * avg(retrieved), 6) as accuracy
      from evaluated""",
    "accuracy_by_model": """select model, sum(retrieved)::bigint as ones_count, count(*) as row_count, round(100 * avg(retrieved), 6) as accuracy
      from evaluated group by model""",
    "model_wins": """select model, count(*) as wins from (
        select model, rank() over (partition by section_name order by round(score, 6) desc) as place from evaluated where retrieved = 1
      ) where place = 1 group by model""",
    "confusion_counts": "select * from confusion",
    "confusion_metrics": _METRICS,
    "metrics_summary": """select sections, "TP", "FP", "TN", "FN", perfect_sections,
      round(macro_precision, 6) as macro_precision, round(macro_recall, 6) as macro_recall, round(macro_f1_score, 6) as macro_f1_score,
      round(macro_specificity, 6) as macro_specificity, round(macro_balanced_accuracy, 6) as macro_balanced_accuracy,
      round(p, 6) as micro_precision, round(r, 6) as micro_recall, round(2 * p * r / nullif(p + r, 0), 6) as micro_f1_score,
      round(s, 6) as micro_specificity, round((r + s) / 2, 6) as micro_balanced_accuracy from summed""",
    "stream_match": f"select {_RESULT} from single where repo_id <> 'web'",
    "stream_runs": """select repo_id, case when bad is null then 'SUCCESS' else 'FAILURE' end as state,
      bad || ': incorrect base64 padding' as error
      from (select repo_id, min(case when repo_id = 'web' and strlen(content) % 3 = 0 then path end) as bad from decoded group by repo_id)""",
}


def _needed(sql: str) -> set[str]:
    found: set[str] = set()
    todo = [sql]
    while todo:
        text = todo.pop()
        for name in CTES:
            if name not in found and re.search(rf"\b{name}\b", text):
                found.add(name)
                todo.append(CTES[name])
    return found


def sql(name: str) -> str:
    needed = _needed(ORACLE[name])
    # A table expression may only use earlier ones: order by dependency.
    order: list[str] = []

    def place(cte: str) -> None:
        if cte in order:
            return
        for other in CTES:
            if other != cte and re.search(rf"\b{other}\b", CTES[cte]):
                place(other)
        order.append(cte)

    for cte in CTES:
        if cte in needed:
            place(cte)
    body = ",\n".join(f"{c} as materialized ({CTES[c]})" for c in order)
    return f"with {body}\n{ORACLE[name]}" if order else ORACLE[name]
