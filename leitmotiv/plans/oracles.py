"""SQL for DuckDB that computes the same as the registered queries, in parts that chain as common table expressions."""

from __future__ import annotations

from leitmotiv.functions.symbols import breakpoints


def with_parts(*parts: str, select: str) -> str:
    return "with " + ",\n".join(p.strip().rstrip(",") for p in parts) + "\n" + select


KINDS = "kinds as (select event_type, cast(dense_rank() over (order by event_type) - 1 as integer) as dim from (select distinct event_type from events))"


def grid(name: str, sums: str, fill: str = "0.0") -> str:
    return f"""
{name}_span as (select min(t) as lo, max(t) as hi from {sums}),
{name} as (
  select g.t, k.dim, coalesce(s.value, {fill}) as value
  from (select unnest(generate_series(lo, hi)) as t from {name}_span) g cross join kinds k left join {sums} s on s.t = g.t and s.event_type = k.event_type
)"""


def events(per: int = 20) -> str:
    sums = f"sums as (select event_id // {per} as t, event_type, round(sum(value), 2) as value from events group by 1, 2)"
    return f"{KINDS}, {sums}, {grid('points', 'sums')}"


def hours(fill: str = "0.0") -> str:
    return f"""{KINDS},
hour_sums as (
  select h - min(h) over () as t, event_type, value
  from (select epoch_us(ts) // 3600000000 as h, event_type, round(sum(value), 2) as value from events group by 1, 2)
), {grid('points', 'hour_sums', fill)}"""


def embeddings() -> str:
    return "points as (select vec_id as t, cast(generate_subscripts(embedding, 1) - 1 as integer) as dim, unnest(embedding)::double as value from embeddings)"


def stats(w: int) -> str:
    return f"""
stats as (
  select * from (
    select t, dim, avg(value) over w as mean, stddev_pop(value) over w as std, list(value) over w as vals, count(*) over w as n
    from points window w as (partition by dim order by t rows between current row and {w - 1} following)
  ) where n = {w}
),
z as (select t, dim, mean, std, vals, list_transform(vals, lambda x: (x - mean) / case when std = 0 then 0.001 else std end) as z from stats)"""


def pair_dims(w: int, source: str = "z", pairs: str | None = None) -> str:
    """pd(a, b, dim, dist): all admissible pairs, or those of the table pairs(a, b)."""
    if pairs:
        return f"pd as (select p.a, p.b, x.dim, list_distance(x.z, y.z) as dist from {pairs} p join {source} x on x.t = p.a join {source} y on y.t = p.b and y.dim = x.dim)"
    return f"pd as (select x.t as a, y.t as b, x.dim, list_distance(x.z, y.z) as dist from {source} x join {source} y on x.dim = y.dim and y.t - x.t > {w})"


RANKED = """
ranked as (
  select a, b, dim, dist, row_number() over w as d, sum(dist) over w as distance
  from pd window w as (partition by a, b order by dist, dim rows between unbounded preceding and current row)
)"""


def motifs(low: int, high: int) -> str:
    """cand(d, a, b, distance, dims): every pair for each d."""
    return f"""
cand as (
  select d, a, b, distance,
         (select string_agg(cast(dim as varchar), ',' order by r2.d) from ranked r2 where r2.a = r.a and r2.b = r.b and r2.d <= r.d) as dims
  from ranked r where d between {low} and {high}
)"""


def plain_motifs(low: int, high: int) -> str:
    return f"""
cand as (
  select d, a, b, distance, dims from (
    select a, b, d, distance, string_agg(cast(dim as varchar), ',') over (partition by a, b order by d rows between unbounded preceding and current row) as dims from ranked
  ) where d between {low} and {high}
)"""


def greedy(k: int, w: int, source: str = "cand") -> str:
    """m1..mk: the k best of each d that don't overlap, as chosen(rank, d, a, b, distance, dims)."""
    parts = []
    for n in range(1, k + 1):
        free = " and ".join(
            f"not exists (select 1 from m{q} where m{q}.d = s.d and (abs(s.a - m{q}.a) < {w} or abs(s.a - m{q}.b) < {w} or abs(s.b - m{q}.a) < {w} or abs(s.b - m{q}.b) < {w}))"
            for q in range(1, n)
        )
        have = f"exists (select 1 from m{n - 1} where m{n - 1}.d = s.d)" if n > 1 else "true"
        parts.append(f"m{n} as (select s.* from {source} s where {have}{' and ' + free if free else ''} qualify row_number() over (partition by s.d order by s.distance, s.a, s.b) = 1)")
    union = " union all ".join(f"select {n} as rank, d, a, b, distance, dims from m{n}" for n in range(1, k + 1))
    return ",\n".join(parts) + f",\nchosen as ({union})"


def _bits(*tag: str) -> str:
    return f"('0x' || substr(md5(concat_ws('|', {', '.join(tag)})), 1, 8))::bigint"


def _gauss(*tag: str) -> str:
    return f"sqrt(-2 * ln(({_bits(*tag, '1')} + 1) / 4294967296.0::double)) * cos(2 * pi() * {_bits(*tag, '2')} / 4294967296.0::double)"


def _unif(*tag: str) -> str:
    return f"({_bits(*tag)} / 4294967296.0::double)"


def gauss(*tag: str) -> str:
    return _gauss(*tag)


def unif(*tag: str) -> str:
    return _unif(*tag)


def tensored(w: int, K: int, L: int, r: float, seed: int, side: int) -> str:
    """sig(t, dim, l, code)."""
    return f"""
proj as (
  select half, g, k, list({_gauss(str(seed), 'half', 'g', 'k', 'o')} order by o) as a, any_value({_unif(str(seed), "'b'", 'half', 'g', 'k')} * {float(r)}) as b
  from (select unnest([0, 1]) as half), (select unnest(range({side})) as g), (select unnest(range({K // 2})) as k), (select unnest(range({w})) as o)
  group by half, g, k
),
parts as (select t, dim, half, g, k, cast(floor((list_inner_product(z, a) + b) / {float(r)}) as integer) as code from z, proj),
sig as (
  select p.t, p.dim, c.l, list(p.code order by c.c) as code
  from (select l, c, c % 2 as half, case when c % 2 = 0 then l // {side} else l % {side} end as g, c // 2 as k
        from (select unnest(range({L})) as l), (select unnest(range({K})) as c)) c
  join parts p on p.half = c.half and p.g = c.g and p.k = c.k group by p.t, p.dim, c.l
)"""


def independent(w: int, K: int, L: int, r: float, seed: int) -> str:
    return f"""
proj as (
  select l, c, list({_gauss(str(seed), 'l', 'c', 'o')} order by o) as a, any_value({_unif(str(seed), "'b'", 'l', 'c')} * {float(r)}) as b
  from (select unnest(range({L})) as l), (select unnest(range({K})) as c), (select unnest(range({w})) as o) group by l, c
),
sig as (select t, dim, l, list(cast(floor((list_inner_product(z, a) + b) / {float(r)}) as integer) order by c) as code from z, proj group by t, dim, l)"""


def collisions(prefix: int, w: int, name: str = "col") -> str:
    return f"{name} as (select x.dim, x.l, x.t as a, y.t as b from sig x join sig y on x.dim = y.dim and x.l = y.l and x.code[1:{prefix}] = y.code[1:{prefix}] and y.t - x.t > {w})"


def candidate_pairs(prefix: int, w: int, d: int, name: str = "lc") -> str:
    return f"{collisions(prefix, w, name + '_col')}, {name} as (select l, a, b, count(*) as n_dims from {name}_col group by l, a, b having count(*) >= {d})"


def paa(segment: int, w: int) -> str:
    return f"paa as (select t, dim, list_transform(range(0, {w}, {segment}), lambda s: list_sum(z[s + 1 : s + {segment}]) / len(z[s + 1 : s + {segment}])) as paa from z)"


def sax_words(alphabet: int) -> str:
    count = " + ".join(f"(case when x >= {b} then 1 else 0 end)" for b in breakpoints(alphabet))
    return f"words as (select t, dim, list_transform(paa, lambda x: {count}) as word from paa)"


def sax_collisions(dims: int, d: int, w: int) -> str:
    from itertools import combinations

    choices = " union all ".join(f"select {k} as choice, t, list(word order by dim) as key from words where dim in ({', '.join(map(str, c))}) group by t" for k, c in enumerate(combinations(range(dims), d)))
    return f"keyed as ({choices}), sc as (select x.t as a, y.t as b, count(*) as n from keyed x join keyed y on x.choice = y.choice and x.key = y.key and y.t - x.t >= {w} group by 1, 2)"


RUNS = "runs as (select o_orderpriority as dataset, o_orderstatus as delta, o_totalprice as distance, o_custkey % 4 as L from orders)"
