"""DuckDB SQL for the queries that SQL can express over whole tables."""

from __future__ import annotations

from stepweave.llm.mixing import Mix


def _weight(weights: dict[str, int], level: str) -> str:
    cases = "".join(f" when '{name}' then {w}" for name, w in weights.items())
    return f"case {level}{cases} else 1 end" if cases else "1"


def _divide(name: str, parents: list[str], level: str, above: str, config: Mix) -> str:
    """Two tables: children with running sums, then their shares."""
    group = f"partition by {', '.join(parents)}" if parents else ""
    keys = ", ".join([*parents, level])
    join = f"join {above} using ({', '.join(parents)})" if parents else f"cross join {above}"
    weight = _weight(config.weights.get(level, {}), level)
    return f"""
{name}_nodes as (
  select {keys}, sum(capacity)::hugeint as capacity, ({weight})::hugeint as w from leaves group by {keys}
),
{name}_sums as (
  select *,
    coalesce(sum(capacity) over (o rows between unbounded preceding and 1 preceding), 0)::hugeint as filled,
    sum(w) over (o rows between current row and unbounded following)::hugeint as to_come
  from {name}_nodes {join}
  window o as ({group} order by case when w = 0 then 'infinity'::double else capacity::double / w::double end, {level})
),
{name}_full as (select *, w > 0 and capacity * to_come <= (budget - filled) * w as is_full from {name}_sums),
{name}_open as (
  select *,
    coalesce(sum(case when is_full then capacity end) over ({group}), 0)::hugeint as taken,
    coalesce(sum(case when not is_full then w end) over ({group}), 0)::hugeint as open_w
  from {name}_full
),
{name} as (
  select {keys}, case when is_full then capacity when w = 0 or open_w = 0 then 0
    else least(((budget - taken) * w) // open_w, capacity) end::hugeint as budget
  from {name}_open
)"""


def mix_sql(config: Mix, docs: str = "documents", domain: str = "''") -> str:
    """Tables that end in ``mixed``: id, domain, lang, source, epoch, n_tokens."""
    return f"""rows_in as (
  select doc_id as id, {domain} as domain, coalesce(lang, '') as lang, coalesce(source, '') as source,
    coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::hugeint as n_tokens, md5(coalesce(text, '')) as digest
  from {docs}
),
leaves as (
  select domain, lang, source, sum(n_tokens)::hugeint as tokens, (sum(n_tokens) * {config.epochs})::hugeint as capacity
  from rows_in group by all
),
total as (select (coalesce(sum(tokens), 0)::hugeint * {config.percent}) // 100 as budget from leaves),
{_divide("by_domain", [], "domain", "total", config).strip()},
{_divide("by_lang", ["domain"], "lang", "by_domain", config).strip()},
{_divide("by_source", ["domain", "lang"], "source", "by_lang", config).strip()},
plan as (
  select *, case when tokens > 0 then budget // tokens else 0 end as full_epochs from by_source join leaves using (domain, lang, source)
),
epochs as (
  select r.*, e.epoch, p.full_epochs, p.budget - p.full_epochs * p.tokens as rest
  from rows_in r join plan p using (domain, lang, source), range({config.epochs}) e(epoch)
  where e.epoch <= p.full_epochs
),
ordered as (
  select *, sum(n_tokens) over (
    partition by domain, lang, source, epoch
    order by md5(concat('{config.seed}:', epoch, ':', coalesce(id::varchar, digest))), digest
    rows between unbounded preceding and current row) as upto
  from epochs
),
mixed as (
  select id, domain, lang, source, epoch::integer as epoch, n_tokens::bigint as n_tokens
  from ordered where epoch < full_epochs or upto <= rest
)"""


def op1_mix_sources() -> str:
    from stepweave.llm.registered import WEIGHTS

    domain = "concat('domain', coalesce(try_cast(regexp_extract(coalesce(source, ''), '(\\d+)$', 1) as integer), 0) % 4)"
    tables = mix_sql(Mix(WEIGHTS, percent=110), domain=domain)
    return f"with {tables} select id as doc_id, domain, lang, source, epoch, n_tokens from mixed"


OP3_LINE_DEDUP = """
with lines as (
  select doc_id, source, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as place
  from documents
),
gone as (select trim(line, ' \t\r') as line from lines where trim(line, ' \t\r') <> '' group by 1 having count(distinct source) >= 10),
flagged as (select l.doc_id, l.line, l.place, g.line is not null as gone from lines l left join gone g on trim(l.line, ' \t\r') = g.line)
select d.doc_id,
  coalesce(len(string_split(d.text, chr(10))), 0)::integer as n_lines,
  coalesce(f.n_removed, 0)::integer as n_removed,
  md5(case when f.n_removed > 0 then coalesce(f.kept, '') else d.text end) as kept_md5
from documents d left join (
  select doc_id, count(*) filter (where gone) as n_removed, string_agg(line, chr(10) order by place) filter (where not gone) as kept
  from flagged group by doc_id
) f using (doc_id)
"""

OP7_CHAT_ROTATION = """
with messages as (
  select distinct conv_id, turn, replace(translate(case when coalesce(role, '') = '' then 'unknown' else role end, chr(13) || chr(10), '  '), '<|', '< |') as speaker,
    replace(coalesce(text, ''), '<|', '< |') as body
  from conversations
),
people as (select distinct conv_id, speaker as perspective from messages where speaker <> 'system'),
pieces as (
  select conv_id, perspective, turn, md5(concat(speaker, ':', body)) as tie, speaker = perspective as own,
    floor(coalesce(turn, -1) / 64) as block,
    case when speaker = 'system' then '<|im_start|>system' when speaker = perspective then '<|im_start|>assistant'
      else concat('<|im_start|>user name=', speaker) end || chr(10) as head,
    concat(body, '<|im_end|>') as body
  from messages join people using (conv_id)
),
placed as (
  select *, dense_rank() over (partition by conv_id, perspective order by block) - 1 as part,
    coalesce(sum(length(head) + length(body) + 1) over (
      partition by conv_id, perspective, block order by turn, tie rows between unbounded preceding and 1 preceding), 0) as before
  from pieces
)
select conv_id, perspective, part::integer as part, count(*)::integer as n_messages,
  string_agg(concat(head, body, chr(10)), '' order by turn, tie) as text,
  coalesce(string_agg(concat(before + length(head), '-', before + length(head) + length(body)), ',' order by turn, tie)
    filter (where own), '') as mask
from placed group by conv_id, perspective, part
"""


def build() -> dict[str, str]:
    return {
        "op1_mix_sources": op1_mix_sources(),
        "op3_line_dedup": OP3_LINE_DEDUP,
        "op7_chat_rotation": OP7_CHAT_ROTATION,
    }
