"""SQL of the two sequential reducers: a recursive query takes one vote of every position at a time and carries its ranked clusters as a list."""

from __future__ import annotations

#: Characters of one byte that no normalized text holds. The SQL similarity counts bytes, so what isn't ASCII is given one of these, text by text.
_FREE = "ABCDEFGHIJKLMNOPQRSTUVWXYZ" + "".join(chr(n) for n in (*range(1, 9), *range(14, 32)))


def similarity(a: str, b: str) -> str:
    """Jaro-Winkler on code points. Characters of b that a lacks match nothing, whatever they are."""
    odd = f"array_to_string(list_distinct(regexp_extract_all({a}, '[^\\x00-\\x7F]')), '')"
    free = "'" + _FREE[:26] + "' || " + " || ".join(f"chr({ord(c)})" for c in _FREE[26:])
    to = f"substr({free}, 1, length({odd}))"
    return f"round(jaro_winkler_similarity(translate({a}, {odd}, {to}), regexp_replace(translate({b}, {odd}, {to}), '[^\\x00-\\x7F]', chr(127), 'g')), 12)"


_NUMBERS = "regexp_extract_all({k}, '[0-9.]*[0-9][0-9.]*')"
_CYRILLIC = r"regexp_matches({k}, '[\x{{0400}}-\x{{04FF}}]')"
_NEGATED = "list_contains(string_split({k}, ' '), 'non')"
_BPS = "cast(greatest(0, least(10000, floor(cast(cast(cast({a} / {b} as float) * cast(10000 as float) as float) + cast(0.5 as float) as float)))) as int)"


def weighted(votes: str, threshold: float) -> str:
    """CTEs up to p and r from votes (group_id, page, line, k, vt, w float), one row per vote: p has a row per position with its scores and counters, r
    one per cluster with its rank."""
    c, v = "c.key", "v.k"
    alike = f"{similarity(c, v)} >= {threshold} and {_CYRILLIC.format(k=c)} = {_CYRILLIC.format(k=v)}"
    veto = f"case when {_NEGATED.format(k=c)} <> {_NEGATED.format(k=v)} then 1 when len({_NUMBERS.format(k=c)}) > 0 and len({_NUMBERS.format(k=v)}) > 0 and {_NUMBERS.format(k=c)} <> {_NUMBERS.format(k=v)} then 2 else 0 end"
    variant = "{'a': -x.w, 'b': -x.n, 'v': x.v, 'w': x.w, 'n': x.n}"
    more = "case when list_contains(list_transform(c.vs, lambda x: x.v), v.vt) then list_transform(c.vs, lambda x: case when x.v = v.vt then {'v': x.v, 'w': cast(x.w + v.w as float), 'n': x.n + 1} else x end) else list_append(c.vs, {'v': v.vt, 'w': v.w, 'n': 1}) end"
    rank = lambda cs: f"list_transform(list_sort(list_transform({cs}, lambda c: {{'a': -c.w, 'b': -c.n, 't': c.t, 'c': c}})), lambda x: x.c)"
    new = "{'key': v.k, 't': v.vt, 'w': v.w, 'n': 1, 'vs': [{'v': v.vt, 'w': v.w, 'n': 1}]}"
    won = f"list_sort(list_transform(({more}), lambda x: {variant}))[1].v"
    taken = f"list_transform(cs, lambda c, j: case when j = best then {{'key': c.key, 't': {won}, 'w': cast(c.w + v.w as float), 'n': c.n + 1, 'vs': {more}}} else c end)"
    return f"""
        vt as (select *, row_number() over (partition by group_id, page, line order by k, vt, w desc) as i from ({votes})),
        fold as (
            select group_id, page, line, cast(1 as bigint) as i, [{new}] as cs, 0 as merges, 0 as negations, 0 as numerics from vt v where i = 1
            union all
            select group_id, page, line, i, {rank(f"case when best > 0 then {taken} else list_append(cs, {new}) end")},
                merges + case when best > 0 then 1 else 0 end, negations + case when best = 0 and veto = 1 then 1 else 0 end, numerics + case when best = 0 and veto = 2 then 1 else 0 end
            from (
                select *, coalesce(list_position(sims, nullif(list_max(sims), -1)), 0) as best, coalesce(list_filter(vetoes, lambda x: x > 0)[-1], 0) as veto
                from (
                    select f.group_id, f.page, f.line, v.i, f.cs, f.merges, f.negations, f.numerics, v.k, v.vt, v.w, {{'k': v.k, 'vt': v.vt, 'w': v.w}} as v,
                        list_transform(f.cs, lambda c: case when {alike} and {veto} = 0 then {similarity(c, v)} else cast(-1 as double) end) as sims,
                        list_transform(f.cs, lambda c: case when {alike} then {veto} else 0 end) as vetoes
                    from fold f join vt v on f.group_id = v.group_id and f.page = v.page and f.line = v.line and v.i = f.i + 1))),
        last as (select * from fold qualify row_number() over (partition by group_id, page, line order by i desc) = 1),
        sums as (select *, cs[1].w as w1, coalesce(cs[2].w, cast(0 as float)) as w2, list_reduce(list_transform(cs, lambda c: c.w), lambda x, y: cast(x + y as float)) as total from last),
        bp as (select *, case when total > 0 then {_BPS.format(a='w1', b='total')} else 0 end as c0, case when total > 0 then {_BPS.format(a='w2', b='total')} else 0 end as a0, case when total > 0 then {_BPS.format(a='cast(w1 - w2 as float)', b='total')} else 0 end as m from sums),
        p as (select group_id, page, line, cs[1].t as winner, cast(case when total > 0 and abs(w1 - w2) >= 1.1920929e-7 and m < 750 then least(c0, 9250) else c0 end as int) as convergence_bps,
            cast(case when total <= 0 then a0 when abs(w1 - w2) < 1.1920929e-7 then greatest(a0, c0) when m < 750 then greatest(a0, 10000 - m) else a0 end as int) as ambiguity_bps,
            cast(i as int) as votes, cast(merges as int) as collisions, cast(negations as int) as negation_conflicts, cast(numerics as int) as numeric_conflicts, cast(len(cs) as int) as n_clusters, cs from bp),
        r as (select group_id, page, line, cs[j].t as t, cs[j].n as n, cs[j].w as w, j as rank from p, unnest(range(1, len(cs) + 1)) as u(j))"""


def _best(m: str) -> str:
    return f"list_sort(list_transform({m}, lambda x: {{'a': -strlen(x), 'x': x}}))[1].x"


def ranked(gs: str) -> str:
    """Clusters of members, the largest first, then by their best member."""
    return f"list_transform(list_sort(list_transform({gs}, lambda g: {{'a': -len(g), 'b': {_best('g')}, 'g': g}})), lambda x: x.g)"


def inserted(rows: str) -> str:
    """rows (gs, t and whatever else) with t taken into the first cluster of gs that is like it, as gs2; gs ranked, if t is null."""
    grown = "case when at_ > 0 then list_transform(gs, lambda g, j: case when j = at_ then list_sort(list_append(g, t)) else g end) else list_append(gs, [t]) end"
    at = f"coalesce(list_position(list_transform(gs, lambda g: {similarity('g[1]', 't')} >= 0.9), true), 0)"
    return f"select *, case when t is null then gs else {ranked(grown)} end as gs2 from (select *, {at} as at_ from ({rows}))"


def winner(gs: str) -> str:
    return f"list_sort(list_transform({gs}, lambda g: {{'a': -len(g), 'b': -strlen({_best('g')}), 'x': {_best('g')}}}))[1].x"


def counted(votes: str) -> str:
    """CTEs up to pl from votes (group_id, page, line_index, t, i), i the turn of a vote from 1: pl has a row per position with its clusters gs,
    lists of members in order, the largest cluster first."""
    step = inserted("select f.group_id, f.page, f.line_index, v.i, f.gs, v.t from steps f join vp v on f.group_id = v.group_id and f.page = v.page and f.line_index = v.line_index and v.i = f.i + 1")
    return f"""
        vp as ({votes}),
        steps as (
            select group_id, page, line_index, i, [[t]] as gs from vp where i = 1
            union all
            select group_id, page, line_index, i, gs2 from ({step})),
        pl as (select group_id, page, line_index, gs, {winner('gs')} as winner, cast(len(gs[1]) as int) as largest, cast(i as int) as total from steps qualify row_number() over (partition by group_id, page, line_index order by i desc) = 1),
        pm as (select group_id, cast(sum(largest * 10000 // total) // count(*) as int) as convergence_bps from pl group by 1)"""


#: What a position's clusters look like as one string.
MEMBERS = "array_to_string(list_transform(gs, lambda g: array_to_string(g, '|')), ' ; ')"
