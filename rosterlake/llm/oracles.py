"""DuckDB SQL for the registered queries that SQL can express."""

from __future__ import annotations

from rosterlake.llm import rules

_WORD = r"[^\x20\x09-\x0D]+"

OP5 = rf"""
with base as (
  select doc_id, coalesce(text, '') as text from documents
), split as (
  select doc_id, text, regexp_extract_all(text, '{_WORD}') as words,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) as lines
  from base
), rows_ as materialized (
  select row_number() over () as row_key, doc_id, text, words, lines from split
), windows as (
  select row_key, i, list_slice(words, i, i + 4) as gram
  from (select row_key, words, unnest(range(1, len(words) - 3)) as i from rows_)
), twice as (
  select row_key, i from (
    select row_key, i, count(*) over (partition by row_key, gram) as c from windows
  ) where c >= 2
), covered as (
  select row_key, sum(least(5, coalesce(next_i - i, 5))) as n
  from (select row_key, i, lead(i) over (partition by row_key order by i) as next_i from twice)
  group by row_key
), lines_ as (
  select row_key, x, len(regexp_extract_all(x, '{_WORD}')) as w,
    len(regexp_extract_all(x, '{rules.NOISY_WORD}')) as noisy,
    len(regexp_extract_all(x, '{rules.NAVIGATION}')) as entries
  from (select row_key, unnest(lines) as x from rows_)
), lost as (
  select row_key, sum(length(x)) as all_chars,
    sum(case when not regexp_matches(x, '{rules.SENTENCE_END.replace("'", "''")}') or noisy * 100 > w * {rules.NOISY_PERCENT}
      or entries * 100 > w * {rules.NOISY_PERCENT} or regexp_matches(x, '{rules.BOILERPLATE}') then length(x) else 0 end) as lost_chars
  from lines_ group by row_key
), counted as (
  select doc_id, len(words)::bigint as n_words,
    length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::bigint as word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
    (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines,
    coalesce(c.n, 0)::bigint as n_repeat_words,
    coalesce(l.all_chars, 0)::bigint as all_chars, coalesce(l.lost_chars, 0)::bigint as lost_chars
  from rows_ left join covered c using (row_key) left join lost l using (row_key)
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, lost_chars,
  n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed,
  not (n_words < 10 or 100 * n_repeat_words > 20 * n_words) and lost_chars * 100 <= all_chars * {rules.LOST_PERCENT} as kept
from counted
"""

OP12 = rf"""
with recursive sized as (
  select row_number() over () as row_, doc_id, source, md5(coalesce(doc_id::varchar, '-')) as turn,
    coalesce(len(regexp_extract_all(text, '{_WORD}')), 0)::bigint as size
  from documents
), sources as (
  select source, sum(size)::bigint as source_size, [1.0::double, 2, 3][(row_number() over (order by source nulls last) - 1) % 3 + 1] as weight,
    (row_number() over (order by source nulls last) - 1) % 3 as kind
  from sized group by source
), rounds as (
  select 0 as i, sum(source_size)::double as left_, sum(weight)::double as weights from sources
  union all
  select r.i + 1, sum(source_size)::double - sum(case when weight * r.left_ / r.weights > source_size * 3.0::double then source_size * 3.0::double else 0 end),
    sum(case when weight * r.left_ / r.weights > source_size * 3.0::double then 0 else weight end)
  from rounds r, sources where r.i < 50 group by r.i, r.left_, r.weights
), targets as (
  select source, source_size, kind, least(weight * left_ / weights, source_size * 3.0::double) as target
  from sources, (select left_, weights from rounds order by i desc limit 1)
), laid as (
  select s.*, source_size, kind, target, round(target)::bigint as goal,
    (sum(size) over (partition by s.source order by turn, doc_id nulls first, size, row_ rows unbounded preceding) - size)::bigint as ahead
  from sized s join targets t on s.source is not distinct from t.source
), copies as (
  select *, p * source_size + ahead as start, greatest(0, least(size, goal - p * source_size - ahead)) as words
  from laid, (select unnest([0, 1, 2]) as p)
), placed as (
  select *, start::double / goal as share, [-0.5::double, 0, 0.5][kind + 1] as slope from copies where words > 0
), timed as (
  select *, share * 2.0 / ((1 - slope) + sqrt(greatest((1 - slope) * (1 - slope) + share * (4 * slope), 0))) as position from placed
), ordered as (
  select row_, words, sum(words) over (order by position, source nulls first, turn, doc_id nulls first, size, p, row_ rows unbounded preceding) - words as first_word
  from timed
), taken as (
  select row_, sum(words)::bigint as taken, count(*) as passes, min(first_word)::bigint as first_word from ordered group by row_
)
select doc_id, size, source_size, target, coalesce(taken, 0)::bigint as taken, coalesce(passes, 0)::bigint as passes, first_word
from laid left join taken using (row_)
"""

_FIELD = "case when {0} is null then '-' else strlen({0}::varchar)::varchar || ':' || {0}::varchar end"


def _leaf(text: str) -> str:
    return "sha256(" + " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


OP13 = f"""
with recursive plain as (
  select *, list_reduce(
      [4294967295::bigint] || list_transform(range(1, length(doc_id::varchar) + 1), lambda i: ascii(substring(doc_id::varchar, i, 1))::bigint),
      lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0],
        lambda v, z: case when v & 1 = 1 then xor(v >> 1, 3988292384) else v >> 1 end)) as crc
  from documents
), changed as (
  select *, case when xor(crc, 4294967295) % 5 = 0 then translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') else text end as now
  from plain
), leaves as (
  select row_number() over () as row_, doc_id, source, {_leaf("text")} as leaf, {_leaf("now")} as claimed from changed
), placed as (
  select *, row_number() over (partition by source order by doc_id nulls first, leaf, claimed) - 1 as place from leaves
), tree as (
  select 0 as level, source, place, leaf as h, count(*) over (partition by source) as n from placed
  union all
  select level + 1, source, place // 16, sha256(string_agg(h, '' order by place)), (any_value(n) + 15) // 16
  from tree where n > 1 group by level, source, place // 16
), subroots as (
  select source, h as subroot, row_number() over (order by source nulls first) - 1 as place from tree where n = 1
), top as (
  select 0 as level, place, subroot as h, count(*) over () as n from subroots
  union all
  select level + 1, place // 16, sha256(string_agg(h, '' order by place)), (any_value(n) + 15) // 16
  from top where n > 1 group by level, place // 16
), runs as (
  select level, source, place // 16 as run, list(h order by place) as hs from tree where n > 1 group by level, source, place // 16
), top_runs as (
  select level, place // 16 as run, list(h order by place) as hs from top where n > 1 group by level, place // 16
), low as (
  select 0 as level, row_, source, place, claimed as h, '' as siblings from placed
  union all
  select l.level + 1, row_, l.source, place // 16,
    sha256(array_to_string(hs[:place % 16], '') || l.h || array_to_string(hs[place % 16 + 2:], '')),
    siblings || array_to_string(hs[:place % 16], '') || array_to_string(hs[place % 16 + 2:], '')
  from low l join runs r on r.level = l.level and r.source is not distinct from l.source and r.run = l.place // 16
), at_subroot as (
  select arg_max(h, level) as h, arg_max(siblings, level) as siblings, row_ from low group by row_
), high as (
  select 0 as level, row_, s.place, a.h, a.siblings
  from at_subroot a join placed p using (row_) join subroots s on s.source is not distinct from p.source
  union all
  select l.level + 1, row_, place // 16,
    sha256(array_to_string(hs[:place % 16], '') || l.h || array_to_string(hs[place % 16 + 2:], '')),
    siblings || array_to_string(hs[:place % 16], '') || array_to_string(hs[place % 16 + 2:], '')
  from high l join top_runs r on r.level = l.level and r.run = l.place // 16
), folded as (
  select row_, arg_max(h, level) as folded_root, sha256(arg_max(siblings, level)) as proof_sha256 from high group by row_
)
select doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root as verified
from placed p join folded using (row_) join subroots s on s.source is not distinct from p.source, (select h as root from top where n = 1)
"""

OP4 = rf"""
with recursive rows_ as (
  select row_number() over () as r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') as w from documents
), shingles as materialized (
  select distinct r, md5(array_to_string(w[i:i + 4], ' ')) as s from (select r, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as i from rows_ where len(w) > 0)
), sizes as (
  select r, count(*) as n from shingles group by r
), links as materialized (
  select a.doc_id as a, b.doc_id as b from (
    select x.r as p, y.r as q, count(*) as common from shingles x join shingles y on x.s = y.s and x.r < y.r group by all
  ) join sizes m on m.r = p join sizes n on n.r = q join rows_ a on a.r = p join rows_ b on b.r = q
  where 100 * common >= 80 * (m.n + n.n - common) and a.doc_id is not null and b.doc_id is not null
), reach as (
  select distinct doc_id as node, doc_id as root from rows_ where doc_id is not null
  union
  select case when l.a = r.node then l.b else l.a end, r.root from reach r join links l on r.node in (l.a, l.b)
), components as (select node, min(root) as component_id from reach group by node)
select doc_id, coalesce(n, 0)::bigint as n_shingles, component_id from rows_ left join sizes using (r) left join components on node = doc_id
"""

OP8 = r"""
with turns as (
  select distinct conv_id, turn, role, text from conversations where conv_id is not null
), chats as (
  select conv_id, list({'role': role, 'text': text} order by turn nulls first, role nulls first, text nulls first) as seq from turns group by conv_id
), classes as (
  select seq, min(conv_id) as conv_id, count(*) as n_same from chats group by seq
), prefixes as (
  select distinct seq[:n] as seq from (select seq, unnest(range(1, len(seq))) as n from chats)
), marked as (
  select conv_id, len(seq)::bigint as n_turns, n_same, list_transform(seq, lambda t:
    '<|' || replace(replace(coalesce(t.role, 'unknown'), '<|', '<\|'), '|>', '|\>') || '|>' || chr(10)
    || replace(replace(coalesce(t.text, ''), '<|', '<\|'), '|>', '|\>') || '<|end|>') as lines
  from classes where seq not in (select seq from prefixes)
)
select conv_id, n_turns, n_same, array_to_string(lines, chr(10)) as chat from marked
"""

OP10 = """
with recursive vectors as (
  select row_number() over () as r, vec_id, label, embedding::double[] as v from embeddings
), usable as (
  select * from vectors where vec_id is not null and label is not null and len(v) > 0
    and len(list_filter(v, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(v, lambda x: x <> 0)) > 0
), links as materialized (
  select a.r, a.vec_id as a, b.vec_id as b from usable a join usable b on a.label = b.label and len(a.v) = len(b.v) and a.r <> b.r
  where list_cosine_similarity(a.v, b.v) >= 0.93
), reach as (
  select distinct vec_id as node, vec_id as root from vectors where vec_id is not null
  union
  select l.b, r.root from reach r join links l on r.node = l.a
), components as (select node, min(root) as component_id from reach group by node)
select vec_id, coalesce(n, 0)::bigint as n_links, component_id, vec_id = component_id as kept
from vectors left join (select r, count(*) as n from links group by r) using (r) left join components on node = vec_id
"""

ORACLES: dict[str, str] = {
    "op4_jaccard_join": OP4, "op5_quality_rules": OP5, "op8_chat_formatting": OP8, "op10_embedding_near_dedup": OP10, "op12_curriculum_mix": OP12,
    "op13_merkle_manifest": OP13,
}
