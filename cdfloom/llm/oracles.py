"""DuckDB SQL with the rows of those queries that SQL can express."""

from __future__ import annotations

from .quality import BINS, DIMS, SCALE, QualityRules, _chi2_cdf, chi2_quantile

_WORD = r"[^\x20\x09-\x0D]+"


def chat_formatting() -> str:
    escaped = lambda c: rf"replace(replace({c}, '\', '\\'), '<', '<\')"
    probe = "</s>[INST] ok [/INST]"
    return f"""
with r as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
           union all values (-1, 0, 'user', '{probe}'), (-1, 1, 'assistant', '{probe}'))
select conv_id, count(*) as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
       coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
       sum(23 + length({escaped('role')}) + length({escaped('text')}))::bigint as formatted_chars
from r group by conv_id"""


def _pairs() -> list[tuple[int, int]]:
    return [(i, j) for i in range(DIMS) for j in range(i + 1)]


def _factor(est: str) -> str:
    """A select of `est` (keys, n, m_i, s_ij) with its Cholesky factor l_ij."""
    out = []
    for j in range(DIMS):
        for i in range(j, DIMS):
            v = f"s{i}{j}" + "".join(f" - l{i}{k} * l{j}{k}" for k in range(j))
            out.append(f"sqrt(greatest({v}, 1.0::double)) as l{i}{j}" if i == j else f"({v}) / l{j}{j} as l{i}{j}")
    return f"select *, {', '.join(out)} from {est}"


def _distance() -> str:
    """Columns y0.. of the forward substitution, and d2."""
    ys = [f"(x{i} - m{i}" + "".join(f" - l{i}{j} * y{j}" for j in range(i)) + f") / l{i}{i} as y{i}" for i in range(DIMS)]
    return ", ".join(ys) + ", " + " + ".join(f"y{i} * y{i}" for i in range(DIMS)) + " as d2"


def _mcd(name: str, keys: list[str], rules: QualityRules, prior: str | None) -> str:
    """CTEs name_0 .. name_<steps>: the estimates by `keys` after each step."""
    ks = ", ".join(keys)
    on = lambda a, b, cols=keys: " and ".join(f"{a}.{k} is not distinct from {b}.{k}" for k in cols)
    floors = [f * SCALE for f in rules.floors]
    consistency = rules.h / _chi2_cdf(chi2_quantile(rules.h, DIMS), DIMS + 2)
    d = range(DIMS)
    ctes = [
        f"{name}_c as (select {ks}, {', '.join(f'quantile_cont(x{i}, 0.5)::double as m{i}' for i in d)} from good group by {ks})",
        f"{name}_s as (select {', '.join('g.' + k for k in keys)}, 0 as n, {', '.join(f'any_value(m{i}) as m{i}' for i in d)}, "
        + ", ".join(f"power(quantile_cont(abs(x{i} - m{i}), 0.5)::double * 1.4826::double, 2) + {floors[i] ** 2!r}::double as s{i}{j}" if i == j else f"0.0::double as s{i}{j}" for i, j in _pairs())
        + f" from good g join {name}_c c on {on('g', 'c')} group by {', '.join('g.' + k for k in keys)})",
        f"{name}_0 as ({_factor(f'{name}_s')})",
    ]
    for step in range(1, rules.steps + 1):
        t, e = f"{name}{step}", f"{name}_{step - 1}"
        ctes += [
            f"{t}_b as (select {', '.join('g.' + k for k in keys)}, {', '.join(f'x{i}' for i in d)}, {_distance()}, floor(ln(d2 + 0.001::double) * {BINS})::int as bin from good g join {e} e on {on('g', 'e')})",
            f"{t}_a as (select {ks}, bin, count(*) as k, {', '.join(f'sum(x{i}) as t{i}' for i in d)}, {', '.join(f'sum(x{i} * x{j}) as u{i}{j}' for i, j in _pairs())} from {t}_b group by {ks}, bin)",
            f"{t}_r as (select *, coalesce(sum(k) over (partition by {ks} order by bin rows between unbounded preceding and 1 preceding), 0) as upto, sum(k) over (partition by {ks}) as total from {t}_a)",
            f"{t}_k as (select {ks}, sum(k)::double as n, {', '.join(f'sum(t{i})::double as t{i}' for i in d)}, {', '.join(f'sum(u{i}{j})::double as u{i}{j}' for i, j in _pairs())} from {t}_r where upto < ceil(total * {rules.h}::double) group by {ks})",
            f"{t}_e as (select {ks}, n, {', '.join(f't{i} / n as m{i}' for i in d)}, "
            + ", ".join(f"(u{i}{j} / n - (t{i} / n) * (t{j} / n)) * {consistency!r}::double" + (f" + {floors[i] ** 2!r}::double" if i == j else "") + f" as s{i}{j}" for i, j in _pairs()) + f" from {t}_k)",
        ]
        named = [f"m{i}" for i in d] + [f"s{i}{j}" for i, j in _pairs()]
        if prior:
            w = float(rules.prior_rows)
            ctes.append(f"{t}_p as (select {', '.join('a.' + k for k in keys)}, a.n, {', '.join(f'(a.{c} * a.n + p.{c} * {w}::double) / (a.n + {w}::double) as {c}' for c in named)} from {t}_e a join {prior} p on a.lang is not distinct from p.lang)")
        ctes.append(f"{name}_{step} as ({_factor(f'{t}_p' if prior else f'{t}_e')})")
    return ",\n".join(ctes)


def quality_rules(rules: QualityRules = QualityRules()) -> str:
    share = lambda a, b: f"sqrt({a} / greatest({b}, 1)::double)"
    stats = ["ln((word_chars + 1) / (n_words + 1)::double)", share("n_symbols", "word_chars"), share("n_dup_lines", "n_lines"), share("n_repeat_words", "n_words")]
    return rf"""
with d as (select row_number() over () as r, doc_id, lang, source, coalesce(text, '') as text from documents),
w as (select r, regexp_extract_all(text, '{_WORD}') as w, len(regexp_extract_all(text, '[#*$%&|<>]')) as n_symbols,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) as lines from d),
three as (select r, unnest(range(1, len(w) - 1)) as i, w from w where len(w) > 3),
keyed as (select r, i, w[i] || chr(32) || w[i + 1] || chr(32) || w[i + 2] as g from three),
twice as (select r, i from (select r, i, count(*) over (partition by r, g) as c from keyed) where c > 1),
hit as (select r, count(distinct i + o.o) as n from twice cross join (select unnest([0, 1, 2]) as o) o group by r),
s as (select d.r, doc_id, lang, source, len(w.w)::bigint as n_words, coalesce(list_sum(list_transform(w.w, lambda x: length(x))), 0)::bigint as word_chars,
             n_symbols::bigint as n_symbols, (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines, coalesce(hit.n, 0)::bigint as n_repeat_words, len(lines) as n_lines
      from d join w using (r) left join hit using (r)),
v as (select *, n_words < {rules.min_words} or 100 * n_repeat_words > {rules.max_repeat_percent} * n_words as base_failed,
             {', '.join(f'round({x} * {SCALE})::bigint as x{i}' for i, x in enumerate(stats))} from s),
good as (select * from v where not base_failed),
{_mcd('lang', ['lang'], rules, None)},
{_mcd('src', ['lang', 'source'], rules, f'lang_{rules.steps}')},
far as (select v.r, {_distance()} from v join src_{rules.steps} e on v.lang is not distinct from e.lang and v.source is not distinct from e.source)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       not base_failed and coalesce(d2, 0) <= {chi2_quantile(1 - rules.tail, DIMS)!r}::double as kept
from v left join far using (r)"""


ORACLES = {"op2_chat_formatting": chat_formatting, "op10_quality_rules": quality_rules}
