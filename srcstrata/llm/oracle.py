"""The same results in SQL for DuckDB, where SQL can express the operator."""

from __future__ import annotations

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

# The control strings of the chat format, without their first character.
_CONTROL = r"\|im_start\|>|\|im_end\|>|\|endoftext\|>|s>|/s>|INST\]|/INST\]|<SYS>>|</SYS>>"


def _escaped(text: str) -> str:
    return rf"regexp_replace({text}, '([<\[])(\\*)({_CONTROL})', '\1\\\2\3', 'g')"


ORACLE = {
    "op1_chat_format": rf"""
with turns as (
  select conv_id::bigint as conv_id, turn::bigint as turn, coalesce(role, '') as role, coalesce(text, '') as text
  from conversations
  union all values (-7::bigint, 0::bigint, 'user', '</s>[INST] ok [/INST]'),
                   (-7::bigint, 1::bigint, 'assistant', '</s>[INST] ok [/INST]')
)
select conv_id, count(*)::bigint as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
       sum(case when role = 'assistant' then length(text) else 0 end)::bigint as loss_chars,
       sha256(string_agg(case when role = 'assistant' then text else '' end, '' order by turn, role, text))
         as loss_sha256,
       sum(24 + length({_escaped(r"replace(replace(role, '\', '\\'), chr(10), '\n')")})
           + length({_escaped("text")}))::bigint as formatted_chars
from turns group by conv_id""",
    "op3_exact_dedup": """
with hashed as (
  select doc_id::bigint as doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz')) as text_sha256 from documents
)
select doc_id, max(doc_id) over w as keep_id, count(*) over w as group_size,
       doc_id = max(doc_id) over w as kept, text_sha256
from hashed window w as (partition by text_sha256)""",
    "op4_quality_rules": rf"""
with texts as (select doc_id::bigint as doc_id, coalesce(text, '') as t, {WORDS} as ws from documents),
words as (select doc_id, unnest(ws) as a, generate_subscripts(ws, 1) as i from texts),
grams as (select *, lead(a, 1) over w as b, lead(a, 2) over w as c from words
          window w as (partition by doc_id order by i)),
twice as (select doc_id, i from (select *, count(*) over (partition by doc_id, a, b, c) as n
                                 from grams where c is not null) where n > 1),
covered as (select doc_id, count(distinct i + k) as n from twice, (values (0), (1), (2)) as s(k) group by doc_id),
lines as (select doc_id, unnest(string_split(t, chr(10))) as line from texts),
worded as (select doc_id, line, count(*) as n from lines where regexp_matches(line, '[^\x20\x09-\x0D]')
           group by doc_id, line),
lined as (select doc_id, sum(n) as n_lines, sum(n - 1) as dup from worded group by doc_id),
measured as (
  select doc_id, len(ws)::bigint as n_words,
         length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::bigint as word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols,
         coalesce(dup, 0)::bigint as n_dup_lines, coalesce(covered.n, 0)::bigint as n_repeat_words,
         coalesce(n_lines, 0) as n_lines,
         length(regexp_replace(t, '[^!]', '', 'g')) as bangs, length(regexp_replace(t, '[^\p{{L}}]', '', 'g')) as letters,
         length(regexp_replace(t, '[^\p{{Lu}}]', '', 'g')) as capitals
  from texts left join covered using (doc_id) left join lined using (doc_id)
),
judged as (
  select *, (case when n_words < 50 then 1 else 0 end) as f0,
         (case when 100 * n_repeat_words > 50 * n_words then 2 else 0 end) as f1,
         (case when 10 * n_symbols > n_words then 4 else 0 end) as f2,
         (case when 2 * capitals > letters then 8 else 0 end) as f3,
         (case when 5 * bangs > n_words then 16 else 0 end) as f4,
         (case when 100 * n_dup_lines > 50 * n_lines then 32 else 0 end) as f5,
         (case when word_chars < 2 * n_words then 64 else 0 end) as f6,
         (case when word_chars > 25 * n_words then 128 else 0 end) as f7
  from measured
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       (f0 + f1 + f2 + f3 + f4 + f5 + f6 + f7)::bigint as failed_rules, f0 + f1 > 0 as base_failed,
       f0 + f1 + f2 + f3 + f4 + f5 + f6 + f7 = 0 as kept
from judged""",
    "op8_substring_dedup": rf"""
with texts as (select doc_id::bigint as doc_id, {WORDS} as ws from documents),
words as (select doc_id, unnest(ws) as word, generate_subscripts(ws, 1) as i from texts),
windows as (select doc_id, unnest(range(1, len(ws) - 33)) as s, ws from texts where len(ws) >= 35),
keyed as (select doc_id, s, array_to_string(list_slice(ws, s, s + 34), ' ') as said from windows),
twice as (select doc_id, s from (select doc_id, s, count(*) over (partition by said) as n from keyed) where n > 1),
gone as (select distinct doc_id, s + k as i from twice, range(35) as r(k)),
kept as (
  select words.doc_id, count(gone.i) as n_removed,
         coalesce(string_agg(word, ' ' order by words.i) filter (where gone.i is null), '') as said
  from words left join gone on words.doc_id = gone.doc_id and words.i = gone.i group by words.doc_id
)
select doc_id, len(ws)::bigint as n_words, coalesce(n_removed, 0)::bigint as n_removed,
       sha256(coalesce(said, '')) as kept_sha256
from texts left join kept using (doc_id)""",
    "op9_line_dedup": r"""
with texts as (select doc_id::bigint as doc_id, string_split(coalesce(text, ''), chr(10)) as ls from documents),
lines as (select doc_id, unnest(ls) as line, generate_subscripts(ls, 1) as i from texts),
worded as (select *, row_number() over (partition by doc_id order by i) as place from lines
           where regexp_matches(line, '[^\x20\x09-\x0D]')),
pairs as (select *, lead(line) over (partition by doc_id order by place) as after from worded),
later as (select doc_id, place from (
            select *, row_number() over (partition by line, after order by doc_id nulls first, place) as copy
            from pairs where after is not null) where copy > 1),
gone as (select distinct doc_id, place + k as place from later, (values (0), (1)) as s(k)),
judged as (select worded.doc_id, worded.i, gone.place is not null as removed
           from worded left join gone on worded.doc_id = gone.doc_id and worded.place = gone.place)
select lines.doc_id, count(judged.i)::bigint as n_lines,
       count(*) filter (where judged.removed)::bigint as n_removed,
       sha256(coalesce(string_agg(line, chr(10) order by lines.i) filter (where not coalesce(removed, false)), ''))
         as kept_sha256
from lines left join judged on lines.doc_id = judged.doc_id and lines.i = judged.i group by lines.doc_id""",
}
