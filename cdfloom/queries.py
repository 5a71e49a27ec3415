"""Registered queries of the regression engine, each with its SQL form where there is one."""

from __future__ import annotations

import itertools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import cdf as C
from .functions import scores as S
from .functions import udtf
from .functions.aggregates import expected_shortfall, order_statistic, weighted_average, weighted_variance
from .kernels import functionals as K
from .ml import IsotonicDistributionalRegressor
from .model import IDRModel, fit_idr
from .operators import generic
from .operators.bagging import idr_bag
from .operators.index_model import fit_index_model
from .operators.isotonic import isotonic_edges, isotonic_indexed, isotonic_mean
from .operators.prep import CovariateOrder, ecdf
from .operators.survival import fit_park, kaplan_meier, kaplan_meier_at
from .plans.asof import asof_both
from .plans.dominance import adjacency, cover_pairs, dominance_pairs, extremes, topological_order, transitive_closure
from .sources.tables import event_gaps, ordinal, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLES[name or f.__name__] = sql
        return f
    return add


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    # + 0.0 drops the sign of zero
    return df.withColumns({c: F.round(F.col(c).cast("double"), 6) + F.lit(0.0) for c in columns})


def literal(x: float) -> str:
    return f"{x!r}::double"


# ---- SQL pieces ----

def sql_chain(points: str, keys: str, decreasing: bool) -> str:
    """CTEs from `points` (keys, x, w, n) to `fits` (keys, x, f): the min-max form."""
    inner, outer = ("max", "min") if decreasing else ("min", "max")
    k = f"{keys}, " if keys else ""
    on = "".join(f"a.{c.strip()} = b.{c.strip()} and " for c in keys.split(",") if c.strip())
    part = f"partition by {keys}" if keys else ""
    same = "".join(f"rs.{c.strip()} = q.{c.strip()} and " for c in keys.split(",") if c.strip())
    ak = "".join(f"a.{c.strip()}, " for c in keys.split(",") if c.strip())
    rk = "".join(f"rs.{c.strip()}, " for c in keys.split(",") if c.strip())
    mk = "".join(f"m.{c.strip()}, " for c in keys.split(",") if c.strip())
    mq = "".join(f"m.{c.strip()} = q.{c.strip()} and " for c in keys.split(",") if c.strip())
    return f"""pts as ({points}),
p as (select {k}x, w, n, row_number() over ({part} order by x) i, sum(n) over ({part} order by x) cn, sum(w) over ({part} order by x) cw from pts),
rs as (select {ak}a.i r, b.i s, (b.cn - a.cn + a.n) / (b.cw - a.cw + a.w) v from p a join p b on {on}a.i <= b.i),
m as (select {rk}q.i i, rs.r, {inner}(rs.v) v from rs join p q on {same}rs.r <= q.i and rs.s >= q.i group by all),
fits as (select {mk}q.x x, {outer}(m.v) f from m join p q on {mq}m.i = q.i group by all)"""


def sql_idr(rows: str, decreasing_cdf: bool = True, by: str = "") -> str:
    """CTEs to `idr` ({by,} threshold, x, cdf) from rows ({by,} x, y, w)."""
    b = f"{by}, " if by else ""
    on = f"z.{by} = g.{by} and " if by else ""
    oj = f"o.{by} = z.{by} and " if by else ""
    zb = f"z.{by} {by}, " if by else ""
    keys = f"{by}, z" if by else "z"
    points = f"select {zb}z.y z, g.x, g.w, coalesce(sum(o.w), 0) n from zz z join g on {on}true left join o on {oj}o.x = g.x and o.y <= z.y group by {zb.replace(f' {by},', ',') if by else ''}z.y, g.x, g.w"
    return f"""o as (select {b}x, y, sum(w) w from ({rows}) group by all),
g as (select {b}x, sum(w) w from o group by all),
zz as (select distinct {b}y from o),
{sql_chain(points, keys, decreasing_cdf)},
idr as (select {b}z threshold, x, f cdf from fits)"""


LINE = "select l_discount x, l_quantity y, 1.0::double w from lineitem"
#: Query points: inside, between and outside the covariates.
ASK = "select c_custkey id, (c_custkey % 1000)::double / 7000.0::double - 0.01::double q, ((c_custkey * 7) % 55)::double y from customer"
NEAR = f"""ask as ({ASK}),
near as (select id, q, ask.y, coalesce(max(case when g.x <= q then g.x end), min(g.x)) l, coalesce(min(case when g.x >= q then g.x end), max(g.x)) r from ask cross join g group by id, q, ask.y),
mix as (select id, q, near.y, a.threshold z, case when l = r then a.cdf else (1 - (q - l) / (r - l)) * a.cdf + (q - l) / (r - l) * b.cdf end c
        from near join idr a on a.x = near.l join idr b on b.x = near.r and b.threshold = a.threshold),
jump as (select *, c - coalesce(lag(c) over (partition by id order by z), 0) w from mix)"""


def line(spark, d) -> DataFrame:
    return table(spark, d, "lineitem").select("l_discount", "l_tax", "l_quantity", "l_extendedprice", "l_returnflag", "l_linestatus")


def ask(spark, d) -> DataFrame:
    return table(spark, d, "customer").selectExpr("c_custkey as id", "cast(c_custkey % 1000 as double) / 7000D - 0.01D as l_discount", "cast((c_custkey * 7) % 55 as double) as y")


def line_model(spark, d) -> IDRModel:
    return fit_idr(line(spark, d), "l_quantity", "l_discount")


# ---- isotonic means ----

def _iso_sql(w: str, decreasing: bool, by: str = "") -> str:
    b = f"{by}, " if by else ""
    return f"with {sql_chain(f'select {b}l_discount x, sum({w}) w, sum({w} * l_quantity) n from lineitem group by all', by, decreasing)} select {b}x as l_discount, round(f, 6) as fitted from fits"


@query(_iso_sql("1.0::double", False))
def iso_mean_1d(spark, d):
    return rounded(isotonic_mean(line(spark, d), "l_quantity", "l_discount"), "fitted")


@query(_iso_sql("1.0::double", True))
def iso_mean_dec(spark, d):
    return rounded(isotonic_mean(line(spark, d), "l_quantity", "l_discount", increasing=False), "fitted")


@query(_iso_sql("l_tax", False))
def iso_mean_weighted(spark, d):
    return rounded(isotonic_mean(line(spark, d), "l_quantity", "l_discount", weight="l_tax"), "fitted")


@query(_iso_sql("1.0::double", False, "l_returnflag, l_linestatus"))
def iso_mean_grouped(spark, d):
    return rounded(isotonic_mean(line(spark, d), "l_quantity", "l_discount", by=["l_returnflag", "l_linestatus"]), "fitted")


# ---- survival ----

GAPS = """h as (select max(ts) t1 from events),
nx as (select user_id, ts, event_id, lead(ts) over (partition by user_id order by ts, event_id) nx from events),
hours as (select user_id, event_id, nx, (user_id % 10)::double x, ceil((epoch_us(coalesce(nx, t1)) - epoch_us(ts))::double / 3.6e9) y from nx cross join h),
gaps as (select user_id, event_id, x, least(y, 48)::double y, nx is not null and y <= 48 observed from hours)"""


def _km_sql(by: str = "", w: str = "1.0::double") -> str:
    b = f"{by}, " if by else ""
    part = f"partition by {by}" if by else ""
    return f"""with {GAPS}, t as (select {b}y, sum(case when observed then {w} else 0 end) d, sum({w}) m from gaps group by all),
r as (select *, sum(m) over ({part} order by y desc) n from t),
s as (select *, max(case when d >= n then 1 else 0 end) over ({part} order by y) done, sum(case when d < n then ln(1 - d / n) else 0 end) over ({part} order by y) l from r)
select {b}y as time, round(case when done = 1 then 0 else exp(l) end, 6) as survival from s where d > 0"""


def gaps(spark, d) -> DataFrame:
    return event_gaps(table(spark, d, "events"))


@query(_km_sql())
def km_curve(spark, d):
    return rounded(kaplan_meier(gaps(spark, d), "y", "observed"), "survival")


@query(_km_sql("x"))
def km_grouped(spark, d):
    return rounded(kaplan_meier(gaps(spark, d), "y", "observed", by=["x"]), "survival")


@query(_km_sql(w="(x + 1)"))
def km_weighted(spark, d):
    return rounded(kaplan_meier(gaps(spark, d).withColumn("w", F.col("x") + 1), "y", "observed", "w"), "survival")


@query(f"with {GAPS}, t as (select x, y, sum(observed::int) d, count(*) m from gaps group by all), r as (select *, sum(m) over (partition by x order by y desc) n from t) "
       "select x, round(1 - exp(sum(case when d > 0 then ln(1 - d / n::double) else 0 end)), 6) as cdf from r where y <= 12 group by x")
def km_at_threshold(spark, d):
    return rounded(kaplan_meier_at(gaps(spark, d), "y", "observed", 12.0, by=["x"]), "cdf")


@query("select l_quantity as value, round(sum(count(*)) over (order by l_quantity) / sum(count(*)) over (), 6)::double as cdf from lineitem group by l_quantity", "ecdf")
def _ecdf(spark, d):
    return rounded(ecdf(table(spark, d, "lineitem"), "l_quantity"), "cdf")


# ---- fits ----

def _idr_query(name: str, rows: str, decreasing: bool, by: str = "", **options) -> None:
    b = f"{by}, " if by else ""

    @query(f"with {sql_idr(rows, decreasing, by)} select {b}threshold, x, round(cdf, 6) as cdf from idr", name)
    def run(spark, d):
        options_now = dict(options)
        df = line(spark, d)
        if w := options_now.pop("where", None):
            df = df.where(w)
        if by:
            df = df.withColumnRenamed(by.replace("flag", "l_returnflag"), by)
        model = fit_idr(df, "l_quantity", "l_discount", by=[by] if by else None, **options_now)
        return rounded(model.long().select(*([by] if by else []), "threshold", F.col("l_discount").alias("x"), "cdf"), "cdf")


_idr_query("idr_sd", LINE, True)
_idr_query("idr_sd_kernel", LINE, True, method="kernel")
_idr_query("idr_sd_decreasing", LINE, False, increasing=False)
_idr_query("idr_sd_weighted", "select l_discount x, l_quantity y, l_tax + 0.01 w from lineitem", True, weight="wt")
_idr_query("idr_sd_filtered", f"{LINE} where l_returnflag = 'R'", True, where="l_returnflag = 'R'")
_idr_query("idr_sd_grouped", "select l_returnflag flag, l_discount x, l_quantity y, 1.0::double w from lineitem", True, "flag")


@query(ORACLES["idr_sd_weighted"])
def idr_sd_weighted(spark, d):
    model = fit_idr(line(spark, d).withColumn("wt", F.col("l_tax") + 0.01), "l_quantity", "l_discount", weight="wt")
    return rounded(model.long().select("threshold", F.col("l_discount").alias("x"), "cdf"), "cdf")


@query(f"with {sql_idr('select p_size::double x, p_retailprice y, 1.0::double w from part')} select threshold, x, round(cdf, 6) as cdf from idr")
def idr_sd_wide(spark, d):
    """Many thresholds: fitted in blocks by the kernel."""
    part = table(spark, d, "part").select("p_size", "p_retailprice")
    return rounded(fit_idr(part, "p_retailprice", "p_size", method="kernel").long().select("threshold", F.col("p_size").alias("x"), "cdf"), "cdf")


@query("with " + sql_idr("select substr(o_orderpriority, 1, 1)::double x, floor(o_totalprice / 10000) y, 1.0::double w from orders") + " select threshold, x, round(cdf, 6) as cdf from idr")
def idr_ordinal(spark, d):
    levels = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
    orders = table(spark, d, "orders").select(ordinal("o_orderpriority", levels).alias("x"), F.floor(F.col("o_totalprice") / 10000).alias("y"))
    return rounded(fit_idr(orders, "y", "x").long().select("threshold", "x", "cdf"), "cdf")


@query("with " + sql_idr(LINE) + " select threshold, x, round(cdf, 6) as cdf from idr where threshold in (5, 10, 20, 30, 40)")
def idr_sd_grid(spark, d):
    model = fit_idr(line(spark, d), "l_quantity", "l_discount", grid=[5, 10, 20, 30, 40])
    return rounded(model.long().select("threshold", F.col("l_discount").alias("x"), "cdf"), "cdf")


def sql_clipped(raw: str, decreasing_in_index: bool = True) -> str:
    """CTEs from `raw` (z, r, s, v: values of intervals r <= s of 1..g) to `clipped` (z, i, f): recursive clipping, then min-max.

    A row holds the lists of one z by interval length; each step appends the next length.
    """
    outer, inner = ("min", "max") if decreasing_in_index else ("max", "min")
    part = "{'lo': least(c[k][r], c[n + 1 - k][r + k]), 'hi': greatest(c[k][r], c[n + 1 - k][r + k])}"
    step = f"list_reduce([{part} for k in range(1, n + 1)], lambda a, b: {{'lo': greatest(least(a.lo, b.hi), b.lo), 'hi': a.hi}}, {{'lo': raw[n + 1][r], 'hi': raw[n + 1][r]}}).lo"
    return f"""{raw},
bylen as (select z, s - r + 1 len, list(v order by r) vs from raw group by z, len),
lists as (select z, list(vs order by len) raw, max(len) g from bylen group by z),
tri as (select z, 1 n, raw, g, [raw[1]] c from lists
        union all select z, n + 1, raw, g, list_append(c, [{step} for r in range(1, g - n + 1)]) from tri where n < g),
clipped as (select z, i, list_{outer}([list_{inner}([c[s - r + 1][r] for s in range(i, g + 1)]) for r in range(1, i + 1)]) f from (select z, g, c, unnest(range(1, g + 1)) i from tri where n = g))"""


#: Kaplan-Meier by interval of covariates at every event time, from `kept` (x, y, observed).
KM_INTERVALS = """t as (select x, y, sum(observed::int)::double d, count(*)::double m from kept group by all),
times as (select distinct y from kept where observed),
xi as (select x, row_number() over (order by x {direction}) i from (select distinct x from kept)),
full_grid as (select times.y z, xi.i, coalesce((select sum(d) from t where t.x = xi.x and t.y = times.y), 0) d, coalesce((select sum(m) from t where t.x = xi.x and t.y >= times.y), 0) n from times cross join xi),
iv as (select a.i r, b.i s, f.z, sum(f.d) d, sum(f.n) n from xi a join xi b on a.i <= b.i join full_grid f on f.i between a.i and b.i group by all),
raw as (select r, s, z, 1 - case when max(case when d >= n and n > 0 then 1 else 0 end) over w = 1 then 0 else exp(sum(case when d > 0 and d < n then ln(1 - d / n) else 0 end) over w) end v from iv window w as (partition by r, s order by z))"""
#: Without the censored rows before the first event.
LATE = "kept as (select x, y, observed from gaps where observed or y >= (select min(y) from gaps where observed))"


def _sidr_sql(select: str, direction: str = "") -> str:
    intervals = sql_clipped(f"{GAPS}, {LATE}, {KM_INTERVALS.format(direction=direction)}")
    return f"with recursive {intervals} {select}"


@query(_sidr_sql("select xi.x, z as threshold, round(f, 6) as cdf from clipped join xi using (i)"))
def sidr(spark, d):
    return rounded(fit_idr(gaps(spark, d), "y", "x", observed="observed").long().select("x", "threshold", "cdf"), "cdf")


@query(_sidr_sql("select xi.x, z as threshold, round(f, 6) as cdf from clipped join xi using (i)", "desc"))
def sidr_decreasing(spark, d):
    return rounded(fit_idr(gaps(spark, d), "y", "x", observed="observed", increasing=False).long().select("x", "threshold", "cdf"), "cdf")


@query(_sidr_sql("select xi.x, round(f, 6) as cdf from clipped join xi using (i) where z = (select max(z) from raw where z <= 12)"))
def sidr_threshold(spark, d):
    return rounded(generic.survival_threshold(gaps(spark, d), 12.0, "y", "x", "observed"), "cdf")


#: Plain S-IDR: KM by interval of covariates, then min-max; no clipping.
PLAIN = GAPS + ", kept as (select x, y, observed from gaps), " + KM_INTERVALS.format(direction="") + """,
mm as (select raw.z, q.i, raw.r, max(raw.v) v from raw join xi q on raw.r <= q.i and raw.s >= q.i group by all)
select xi.x, mm.z as threshold, round(min(mm.v), 6) as cdf from mm join xi using (i) group by all"""


@query("with " + PLAIN)
def plain_sidr(spark, d):
    return rounded(generic.plain_sidr(gaps(spark, d), "y", "x", "observed"), "cdf")


@query("select x, cdf from (with " + PLAIN + ") where threshold = 12")
def plain_sidr_threshold(spark, d):
    return rounded(generic.survival_threshold(gaps(spark, d), 12.0, "y", "x", "observed", plain_form=True), "cdf")


def _pooled_sql(value: str, weight: str) -> str:
    """List of the increasing fit of `value` with `weight` (SQL of k) over 1..g, by max-min; weights of 0 take no part."""
    mean = f"list_sum([{weight} * ({value}) for k in range(r, s + 1)]) / nullif(list_sum([{weight} for k in range(r, s + 1)]), 0)"
    return f"[list_max([list_min([{mean} for s in range(i, g + 1)]) for r in range(1, i + 1)]) for i in range(1, g + 1)]"


#: One threshold after the other: the survival list sv is multiplied by the fit of (1 - n / w) / sv.
HAZARD = f"""with recursive o as (select l_discount x, l_quantity y, count(*)::double w from lineitem group by all),
xi as (select x, w, row_number() over (order by x) i from (select x, sum(w) w from o group by x)),
zs as (select y, row_number() over (order by y) j from (select distinct y from o)),
cells as (select zs.j, zs.y, xi.i, xi.w, coalesce((select sum(w) from o where o.x = xi.x and o.y <= zs.y), 0) n from zs cross join xi),
lists as (select j, y, list(n order by i) n, list(w order by i) w, max(i) g from cells group by j, y),
st as (select 0::bigint j, null::double y, (select list(1.0::double) from xi) sv
       union all select j, y, list_transform({_pooled_sql("(1 - n[k] / w[k]) / nullif(sv[k], 0)", "(case when sv[k] > 1e-8 then sv[k] * sv[k] * w[k] else 0 end)")},
                                            lambda f, m: case when sv[m] > 1e-8 then least(greatest(sv[m] * coalesce(f, 0), 0), sv[m]) else 0 end)
       from (select l.j, l.y, l.g, l.n, l.w, st.sv from st join lists l on l.j = st.j + 1))
select xi.x as l_discount, st.y as threshold, round(1 - st.sv[xi.i], 6) + 0.0 as cdf from st cross join xi where st.j > 0"""

#: The same with censoring: own Kaplan-Meier survival ow, weights rk (what is at risk, as the fit has it), remaining rm.
HAZARD_CENSORED = f"""with recursive {GAPS}, xi as (select x, row_number() over (order by x) i from (select distinct x from gaps)),
ts as (select y, row_number() over (order by y) j, bool_or(observed) has from gaps group by y),
cells as (select ts.j, ts.y, ts.has, xi.i, count(*) filter (g.observed)::double d, count(*) filter (not g.observed)::double c from ts cross join xi left join gaps g on g.x = xi.x and g.y = ts.y group by all),
lists as (select j, y, has, list(d order by i) d, list(c order by i) c, max(i) g from cells group by j, y, has),
start as (select list(n order by x) n from (select x, count(*)::double n from gaps group by x)),
st as (select 0::bigint j, null::double y, false has, n rm, n rk, [1.0::double for q in n] ow, [1.0::double for q in n] sv from start
  union all select j, y, has, [greatest(rm[m] - d[m] - c[m], 0) for m in range(1, g + 1)],
    [rk[m] * ra[m] * case when rm[m] - d[m] > 1e-8 then greatest(1 - c[m] / (rm[m] - d[m]), 0) else 1 end for m in range(1, g + 1)], ow, [sv[m] * ra[m] for m in range(1, g + 1)]
  from (select *, case when has then list_transform({_pooled_sql("ow[k] / nullif(sv[k], 0)", "(case when sv[k] > 1e-8 then rk[k] else 0 end)")},
                                                    lambda f, m: case when sv[m] > 1e-8 then least(greatest(coalesce(f, 0), 0), 1) else 0 end) else [1.0::double for q in d] end ra
    from (select l.*, st.rm, st.rk, st.sv, [case when st.rm[m] > 1e-8 then st.ow[m] * greatest(1 - l.d[m] / st.rm[m], 0) else st.ow[m] end for m in range(1, l.g + 1)] ow from st join lists l on l.j = st.j + 1)))
select xi.x, st.y as threshold, round(1 - st.sv[xi.i], 6) + 0.0 as cdf from st cross join xi where st.has"""


@query(HAZARD)
def hazard_uncensored(spark, d):
    return rounded(fit_idr(line(spark, d), "l_quantity", "l_discount", y_order="hazard").long().select("l_discount", "threshold", "cdf"), "cdf")


@query(HAZARD_CENSORED)
def hazard_censored(spark, d):
    return rounded(fit_idr(gaps(spark, d), "y", "x", observed="observed", y_order="hazard").long().select("x", "threshold", "cdf"), "cdf")


# ---- model queries ----

def _predicted(select: str) -> str:
    return f"with {sql_idr(LINE)}, {NEAR} {select}"


@query(_predicted("select id, round(coalesce(max(case when z <= y then c end), 0), 6) as cdf_at from jump group by id"))
def idr_cdf_at(spark, d):
    return rounded(line_model(spark, d).cdf_at(ask(spark, d), "y").select("id", "cdf_at"), "cdf_at")


@query(_predicted("select id, z as threshold, round(c, 6) as cdf from jump"))
def idr_cdf_interp(spark, d):
    found = line_model(spark, d).predict_cdf(ask(spark, d))
    return rounded(found.select("id", F.explode(F.arrays_zip(F.col("thresholds").alias("z"), F.col("cdf").alias("c"))).alias("s")).select("id", F.col("s.z").alias("threshold"), F.col("s.c").alias("cdf")), "cdf")


@query(_predicted("select id, g.v::double as y, round(coalesce(max(case when z <= g.v then c end), 0), 6) as cdf_at from jump cross join (select unnest([0.5, 10, 25, 60]) v) g group by id, g.v"))
def idr_grid(spark, d):
    return rounded(line_model(spark, d).cdf_grid(ask(spark, d).drop("y"), [0.5, 10, 25, 60]).select("id", "y", "cdf_at"), "cdf_at")


@query(_predicted("select id, round(sum(w * z), 6) as prediction from jump group by id"))
def idr_mean(spark, d):
    return rounded(line_model(spark, d).predict(ask(spark, d)).select("id", "prediction"), "prediction")


PS = [0.0, 0.13, 0.5, 0.77, 1.0]


@query(_predicted(f"select id, p, min(case when (p = 0 and c > 1e-12) or (p > 0 and c >= p - 1e-12) then z end) as quantile from jump cross join (select unnest({PS})::double p) group by id, p"))
def idr_quantile_lower(spark, d):
    return line_model(spark, d).quantile(ask(spark, d), PS).select("id", "p", "quantile")


@query(_predicted(f"select id, p, coalesce(min(case when c > p + 1e-12 then z end), max(z)) as quantile from jump cross join (select unnest({PS})::double p) group by id, p"))
def idr_quantile_upper(spark, d):
    return line_model(spark, d).quantile(ask(spark, d), PS, upper=True).select("id", "p", "quantile")


def scored(spark, d):
    return line_model(spark, d).predict_cdf(ask(spark, d)), F.col("cdf"), F.col("thresholds"), F.col("y")


@query(_predicted("select id, round(2 * sum(w * ((y < z)::int - c + w / 2) * (z - y)), 6) as crps from jump group by id"))
def idr_crps(spark, d):
    df, c, z, y = scored(spark, d)
    return rounded(df.select("id", S.crps(c, z, y).alias("crps")), "crps")


@query(_predicted("select id, round(power(coalesce(max(case when z <= 20 then c end), 0) - (any_value(y) <= 20)::int, 2), 6) as brier from jump group by id"))
def idr_brier(spark, d):
    df, c, z, y = scored(spark, d)
    return rounded(df.select("id", S.brier_score(C.cdf_at(c, z, F.lit(20.0)), F.lit(20.0), y).alias("brier")), "brier")


@query(_predicted("select id, round(2 * ((q9 > y)::int - 0.9) * (q9 - y), 6)::double as qscore from (select id, any_value(y) y, min(case when c >= 0.9 - 1e-12 then z end) q9 from jump group by id)"))
def idr_qscore(spark, d):
    df, c, z, y = scored(spark, d)
    return rounded(df.select("id", S.quantile_score(C.quantile(c, z, F.lit(0.9)), 0.9, y).alias("qscore")), "qscore")


@query(_predicted("select id, round(coalesce(max(case when z <= y then c end), 0), 6) as pit from jump group by id"))
def idr_pit(spark, d):
    df, c, z, y = scored(spark, d)
    return rounded(df.select("id", S.pit(c, z, y).alias("pit")), "pit")


@query("select count(*) as n, 0::bigint as outside from customer")
def idr_pit_randomised(spark, d):
    """Random PITs lie between the two limits."""
    df, c, z, y = scored(spark, d)
    r = df.select(S.pit(c, z, y, seed=3).alias("u"), C.cdf_before(c, z, y).alias("a"), C.cdf_at(c, z, y).alias("b"))
    return r.agg(F.count("*").alias("n"), F.count_if((F.col("u") < F.col("a") - 1e-12) | (F.col("u") > F.col("b") + 1e-12)).alias("outside"))


@query("select l_discount, lag(l_discount) over (order by l_discount) as lower_neighbour from (select distinct l_discount from lineitem)")
def asof_neighbours(spark, d):
    points = line(spark, d).select("l_discount").distinct()
    asked = points.select((F.col("l_discount") - 0.0001).alias("q"), "l_discount")
    found = asof_both(asked, points.select(F.col("l_discount").alias("q")), "q")
    return found.select("l_discount", F.col("below").alias("lower_neighbour"))


# ---- raw ensembles ----

ENS = "ens as (select vec_id, label::double / 10 - 0.45 y, unnest(embedding)::double m from embeddings)"
RANKED = ENS + ", s as (select *, row_number() over (partition by vec_id order by m) k, count(*) over (partition by vec_id) n from ens)"


def ensembles(spark, d):
    df = table(spark, d, "embeddings").select("vec_id", (F.col("label").cast("double") / 10 - 0.45).alias("y"), F.col("embedding").cast("array<double>").alias("m"))
    return df, F.col("m"), F.col("y")


@query(f"with {ENS} select vec_id, round(avg((m <= y)::int), 6) as cdf from ens group by vec_id")
def ens_cdf(spark, d):
    df, m, y = ensembles(spark, d)
    return rounded(df.select("vec_id", S.ensemble_cdf(m, y).alias("cdf")), "cdf")


@query(f"with {RANKED} select vec_id, round(max(case when k = greatest(1, ceil(0.3 * n)) then m end), 6) as quantile from s group by vec_id")
def ens_quantile(spark, d):
    df, m, y = ensembles(spark, d)
    return rounded(df.select("vec_id", S.ensemble_quantile(m, F.lit(0.3)).alias("quantile")), "quantile")


@query(f"with {RANKED} select vec_id, round(2.0 / any_value(n) * sum(((y < m)::int - (k - 0.5) / n) * (m - y)), 6)::double as crps from s group by vec_id")
def ens_crps(spark, d):
    df, m, y = ensembles(spark, d)
    return rounded(df.select("vec_id", S.ensemble_crps(m, y).alias("crps")), "crps")


@query(f"with {ENS} select vec_id, round(power(avg((m <= 0.05)::int) - (any_value(y) <= 0.05)::int, 2), 6) as brier from ens group by vec_id")
def ens_brier(spark, d):
    df, m, y = ensembles(spark, d)
    return rounded(df.select("vec_id", S.brier_score(S.ensemble_cdf(m, F.lit(0.05)), F.lit(0.05), y).alias("brier")), "brier")


@query(f"with {RANKED}, q as (select vec_id, any_value(y) y, max(case when k = greatest(1, ceil(0.3 * n)) then m end) x from s group by vec_id) select vec_id, round(2 * ((x > y)::int - 0.3) * (x - y), 6)::double as qscore from q")
def ens_qscore(spark, d):
    df, m, y = ensembles(spark, d)
    return rounded(df.select("vec_id", S.quantile_score(S.ensemble_quantile(m, F.lit(0.3)), 0.3, y).alias("qscore")), "qscore")


@query(f"with {ENS} select vec_id, round(avg((m <= y)::int), 6) as pit from ens group by vec_id")
def ens_pit(spark, d):
    df, m, y = ensembles(spark, d)
    return rounded(df.select("vec_id", S.ensemble_pit(m, y).alias("pit")), "pit")


# ---- orders of several covariates ----

def _group_query(kind: str, sql: str) -> None:
    @query(f"with d as (select distinct l_discount a, l_tax b, l_quantity / 100 c from lineitem), s as (select a, b, c, list_sort([a, b, c], 'DESC') v from d) select a, b, c, {sql} from s", f"group_{kind}")
    def run(spark, d):
        points = line(spark, d).select(F.col("l_discount").alias("a"), F.col("l_tax").alias("b"), (F.col("l_quantity") / 100).alias("c")).distinct()
        order = CovariateOrder.parse([(kind, ["a", "b", "c"])], ["a", "b", "c"])
        v = order.transformed({c: F.col(c) for c in "abc"})
        return rounded(points.select("a", "b", "c", *[v[i].alias(f"v{i}") for i in range(3)]), "v0", "v1", "v2")


_group_query("comp", "round(a, 6) as v0, round(b, 6) as v1, round(c, 6) as v2")
_group_query("sd", "round(v[1], 6) as v0, round(v[2], 6) as v1, round(v[3], 6) as v2")
_group_query("icx", "round(v[1], 6) as v0, round(v[1] + v[2], 6) as v1, round(v[1] + v[2] + v[3], 6) as v2")

POINTS = "pt as (select distinct l_discount a, l_tax b from lineitem), pts as (select a, b, round(a * 100)::bigint * 100 + round(b * 100)::bigint id from pt)"
PAIRS = POINTS + ", pairs as (select p.id lo, q.id hi from pts p join pts q on p.a <= q.a and p.b <= q.b and p.id <> q.id)"


def points(spark, d):
    return line(spark, d).select(F.col("l_discount").alias("a"), F.col("l_tax").alias("b")).distinct().withColumn("id", (F.round(F.col("a") * 100) * 100 + F.round(F.col("b") * 100)).cast("long"))


@query(f"with {PAIRS} select lo, hi from pairs")
def dominance_edges(spark, d):
    return dominance_pairs(points(spark, d), ["a", "b"], "id")


@query(f"with {PAIRS} select lo, hi from pairs anti join (select distinct p.lo, q.hi from pairs p join pairs q on p.hi = q.lo) t using (lo, hi)")
def cover_edges(spark, d):
    return cover_pairs(dominance_pairs(points(spark, d), ["a", "b"], "id"))


@query("with recursive e as (select distinct n_regionkey lo, n_nationkey hi from nation where n_regionkey <> n_nationkey), c as (select lo, hi from e union select c.lo, e.hi from c join e on c.hi = e.lo) select lo, hi from c")
def closure_edges(spark, d):
    nation = table(spark, d, "nation")
    return transitive_closure(nation.select(F.col("n_regionkey").alias("lo"), F.col("n_nationkey").alias("hi")).where("lo != hi"))


@query(f"with {PAIRS} select lo, hi from pairs")
def closure_of_covers(spark, d):
    """The closure of the cover relation is the order again."""
    return transitive_closure(cover_pairs(dominance_pairs(points(spark, d), ["a", "b"], "id")))


@query(f"with {PAIRS} select id from pts where id not in (select hi from pairs)")
def minimal_points(spark, d):
    p = points(spark, d)
    return extremes(dominance_pairs(p, ["a", "b"], "id"), p, "id").select("id")


GRID = [5.0, 10.0, 20.0, 30.0, 40.0]


def sql_poset(points: str) -> str:
    """CTEs from `points` (distinct a, b, as compared) to pts (a, b, i) and `meets` (u, l, m): upper and lower sets as bits, and what both hold.

    All sets of points are looked at, so it is for few points: the value of a point
    is the max over upper sets, that hold it, of the min over lower sets of the mean of what both hold.
    """
    return f"""pts as (select a, b, row_number() over (order by a, b) - 1 i from ({points})),
le as (select p.i lo, q.i hi from pts p join pts q on p.a <= q.a and p.b <= q.b),
above as (select lo i, sum(1::bigint << hi)::bigint m from le group by lo),
below as (select hi i, sum(1::bigint << lo)::bigint m from le group by hi),
sets as (select unnest(range(1, 1::bigint << (select count(*) from pts))) s),
uppers as (select s from sets where not exists (select 1 from above where (s >> i) & 1 = 1 and (s & m) <> m)),
lowers as (select s from sets where not exists (select 1 from below where (s >> i) & 1 = 1 and (s & m) <> m)),
meets as (select u.s u, l.s l, u.s & l.s m from uppers u cross join lowers l where u.s & l.s <> 0)"""


def _poset_fit(cells: str, decreasing: bool) -> str:
    """CTEs from `cells` (z, i, n, w) to `fits` (z, i, f)."""
    outer, inner = ("min", "max") if decreasing else ("max", "min")
    return f"""cells as ({cells}),
means as (select k.m, c.z, sum(c.n) / sum(c.w) v from (select distinct m from meets) k join cells c on (k.m >> c.i) & 1 = 1 group by all),
tops as (select p.i, x.u, a.z, {inner}(a.v) v from pts p join meets x on (x.m >> p.i) & 1 = 1 join means a on a.m = x.m group by all),
fits as (select z, i, {outer}(v) f from tops group by all)"""


#: Discount and tax in three classes each: few enough points to look at every set of them.
CLASSES = "o as (select (round(l_discount * 100)::bigint // 4)::double a, (round(l_tax * 100)::bigint // 3)::double b, l_quantity y from lineitem)"


def classes(spark, d) -> DataFrame:
    third = lambda c, k: F.floor(F.round(F.col(c) * 100) / k).cast("double")
    return line(spark, d).select(third("l_discount", 4).alias("a"), third("l_tax", 3).alias("b"), "l_quantity")


def _shares(compared: str = "a = o.a and b = o.b") -> str:
    return f"select g.z, pts.i, count(*) filter (o.y <= g.z)::double n, count(*)::double w from (select unnest({GRID})::double z) g cross join pts join o on {compared} group by all"


@query(f"with {CLASSES}, {sql_poset('select distinct a, b from o')}, {_poset_fit('select 0 z, pts.i, sum(o.y) n, count(*)::double w from pts join o using (a, b) group by all', False)} select a, b, round(f, 6) as fitted from fits join pts using (i)")
def po_iso_mean_classes(spark, d):
    return rounded(isotonic_mean(classes(spark, d), "l_quantity", ["a", "b"]), "fitted")


@query(f"with {CLASSES}, {sql_poset('select distinct a, b from o')}, {_poset_fit(_shares('pts.a = o.a and pts.b = o.b'), True)} select a, b, z as threshold, round(f, 6) as cdf from fits join pts using (i)")
def po_idr_classes(spark, d):
    return rounded(fit_idr(classes(spark, d), "l_quantity", ["a", "b"], grid=GRID).long().select("a", "b", "threshold", "cdf"), "cdf")


@query(f"with {CLASSES}, {sql_poset('select distinct greatest(a, b) a, least(a, b) b from o')}, {_poset_fit(_shares('pts.a = greatest(o.a, o.b) and pts.b = least(o.a, o.b)'), True)} select a as at0, b as at1, z as threshold, round(f, 6) as cdf from fits join pts using (i)")
def po_idr_groups_classes(spark, d):
    """Exchangeable covariates: the classes as an unordered pair."""
    model = fit_idr(classes(spark, d), "l_quantity", ["a", "b"], order=[("sd", ["a", "b"])], grid=GRID)
    return rounded(model.long().select("at0", "at1", "threshold", "cdf"), "cdf")


def _po_hazard_sql() -> str:
    mean = "list_sum([((m >> (k - 1)) & 1) * sv[k] * sv[k] * w[k] * ((1 - n[k] / w[k]) / nullif(sv[k], 0)) for k in range(1, g + 1)]) / nullif(list_sum([((m >> (k - 1)) & 1) * sv[k] * sv[k] * w[k] for k in range(1, g + 1)]), 0)"
    fit = f"[list_max([list_min([{mean.replace('(m >>', '((x & y) >>')} for y in ls if ((y >> (i - 1)) & 1) = 1]) for x in us if ((x >> (i - 1)) & 1) = 1]) for i in range(1, g + 1)]"
    return f"""with recursive {CLASSES}, {sql_poset('select distinct a, b from o')}, cells as ({_shares('pts.a = o.a and pts.b = o.b')}),
lists as (select z, row_number() over (order by z) j, list(n order by i) n, list(w order by i) w, count(*) g from cells group by z),
fixed as (select (select list(s) from uppers) us, (select list(s) from lowers) ls),
st as (select 0::bigint j, null::double z, (select list(1.0::double) from pts) sv
       union all select j, z, list_transform({fit}, lambda f, m: least(greatest(sv[m] * coalesce(f, 0), 0), sv[m]))
       from (select l.j, l.z, l.n, l.w, l.g, st.sv, us, ls from st join lists l on l.j = st.j + 1 cross join fixed))
select a, b, z as threshold, round(1 - sv[i + 1], 6) + 0.0 as cdf from st cross join pts where j > 0"""


@query(_po_hazard_sql())
def po_hazard_classes(spark, d):
    return rounded(fit_idr(classes(spark, d), "l_quantity", ["a", "b"], y_order="hazard", grid=GRID).long().select("a", "b", "threshold", "cdf"), "cdf")


def _optimal(fits: DataFrame, keys: list[str]) -> DataFrame:
    """What the exact fit of v (weights w) over points (p, q) has none of: order violations, level sets whose weighted
    residuals don't cancel, and upper sets with a positive sum of residuals; the three are sufficient as well."""
    key = [F.lit(0).alias("__g"), *[F.col(k) for k in keys]]
    columns = fits.groupBy(*key, "q").agg(F.collect_list(F.struct("p", "f", (F.col("w") * (F.col("v") - F.col("f"))).alias("r"))).alias("c"))
    grids = columns.groupBy("__g", *keys).agg(
        F.array_sort(F.collect_list(F.struct("q", "c"))).alias("columns"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.transform("c", lambda x: x["p"]))))).alias("ps"))
    # upper sets are staircases: the first p that belongs falls from column to column; best[j]: sums so far with the first p at j or later
    start = F.transform(F.concat("ps", F.array(F.lit(float("inf")))), lambda p: F.lit(0.0))

    def step(best, column):
        own = F.transform(F.concat("ps", F.array(F.lit(float("inf")))), lambda p: F.aggregate(F.filter(column["c"], lambda x: x["p"] >= p), F.lit(0.0), lambda s, x: s + x["r"]))
        return F.transform(own, lambda v, j: v + F.array_max(F.slice(best, j + 1, F.size(best) - j)))

    gain = grids.select(F.array_max(F.aggregate("columns", start, step)).alias("gain"), *keys)
    a, b = fits.alias("a"), fits.alias("b")
    bad = a.join(b, [*[F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys], F.col("a.q") <= F.col("b.q"), F.col("a.p") <= F.col("b.p"), F.col("a.f") > F.col("b.f") + 1e-9])
    levels = fits.groupBy(*keys, F.round("f", 9).alias("level")).agg(F.sum(F.col("w") * (F.col("v") - F.col("f"))).alias("r"), F.sum("w").alias("m"))
    total = fits.agg(F.sum("w").alias("all"))
    return bad.agg(F.count("*").alias("violations")).crossJoin(
        levels.agg(F.count_if(F.abs(F.col("r")) > 1e-6 * F.col("m")).alias("unbalanced"))).crossJoin(
        gain.crossJoin(total).agg(F.count_if(F.col("gain") > 1e-6 * F.col("all")).alias("better")))


@query("select 0::bigint as violations, 0::bigint as unbalanced, 0::bigint as better")
def po_iso_mean(spark, d):
    df = line(spark, d)
    means = df.groupBy("l_discount", "l_tax").agg(F.avg("l_quantity").alias("v"), F.count("*").cast("double").alias("w"))
    fits = isotonic_mean(df, "l_quantity", ["l_discount", "l_tax"]).join(means, ["l_discount", "l_tax"])
    return _optimal(fits.select(F.col("l_discount").alias("p"), F.col("l_tax").alias("q"), F.col("fitted").alias("f"), "v", "w"), [])


@query("select 0::bigint as violations, 0::bigint as unbalanced, 0::bigint as better")
def po_idr(spark, d):
    df = line(spark, d)
    model = fit_idr(df, "l_quantity", ["l_discount", "l_tax"], grid=[*GRID, 50.0])
    shares = df.groupBy("l_discount", "l_tax").agg(F.count("*").cast("double").alias("w"), *[F.avg((F.col("l_quantity") <= z).cast("double")).alias(f"s{int(z)}") for z in GRID])
    long = shares.select("l_discount", "l_tax", "w", F.explode(F.array(*[F.struct(F.lit(z).alias("threshold"), F.col(f"s{int(z)}").alias("share")) for z in GRID])).alias("s")).select("l_discount", "l_tax", "w", "s.*")
    fits = model.long().join(long, ["l_discount", "l_tax", "threshold"])
    return _optimal(fits.select("threshold", F.col("l_discount").alias("p"), F.col("l_tax").alias("q"), (1 - F.col("cdf")).alias("f"), (1 - F.col("share")).alias("v"), "w"), ["threshold"])


@query()
def po_idr_groups(spark, d):
    """Exchangeable covariates: discount and tax as an unordered pair."""
    model = fit_idr(line(spark, d), "l_quantity", ["l_discount", "l_tax"], order=[("sd", ["l_discount", "l_tax"])], grid=GRID)
    return rounded(model.long(), "cdf")


@query()
def po_hazard(spark, d):
    return rounded(fit_idr(line(spark, d), "l_quantity", ["l_discount", "l_tax"], y_order="hazard", grid=[10.0, 25.0, 40.0]).long(), "cdf")


@query()
def po_sidr(spark, d):
    """User buckets as points of a 4 by 3 grid."""
    points = gaps(spark, d).withColumns({"a": F.floor(F.col("x") / 3), "b": F.pmod(F.col("x"), F.lit(3))})
    return rounded(fit_idr(points, "y", ["a", "b"], observed="observed", grid=[6.0, 12.0, 24.0]).long(), "cdf")


@query(_sidr_sql("select xi.x as a, xi.x * 2 as b, g.z as threshold, round(coalesce(f, 0), 6) as cdf from (select unnest([6.0, 12.0, 24.0])::double z) g cross join xi left join clipped on clipped.i = xi.i and clipped.z = (select max(z) from raw where raw.z <= g.z)"))
def po_sidr_chain(spark, d):
    """A partial order that is a chain: the result is that of the total order."""
    points = gaps(spark, d).withColumns({"a": F.col("x"), "b": 2 * F.col("x")})
    return rounded(fit_idr(points, "y", ["a", "b"], observed="observed", grid=[6.0, 12.0, 24.0]).long().select("a", "b", "threshold", "cdf"), "cdf")


#: Two literal fits on a square, asked at points inside, below, above and beside it.
LITERAL = [[0.0, 0.0], [1.0, 2.0], [2.0, 1.0], [3.0, 3.0]], [1.0, 2.0, 3.0], [[0.6, 0.9, 1.0], [0.5, 0.6, 1.0], [0.3, 0.7, 1.0], [0.1, 0.5, 1.0]]
ASKED = [(1, -1.0, -1.0), (2, 1.5, 1.5), (3, 5.0, 5.0), (4, -1.0, 9.0), (5, 1.0, 2.0)]


def _literal_sql() -> str:
    rows = ", ".join(f"({p[0]}::double, {p[1]}::double, {z}::double, {c}::double)" for p, cs in zip(LITERAL[0], LITERAL[2]) for z, c in zip(LITERAL[1], cs))
    asked = ", ".join(f"({i}, {a}::double, {b}::double)" for i, a, b in ASKED)
    return f"""with m(a, b, z, c) as (values {rows}), q(id, a, b) as (values {asked}), g as (select z, avg(c) c from m group by z),
e as (select q.id, m.z, min(case when m.a <= q.a and m.b <= q.b then c end) hi, max(case when m.a >= q.a and m.b >= q.b then c end) lo from q cross join m group by all)
select id::int as id, e.z as threshold, round(coalesce((lo + hi) / 2, lo, hi, g.c), 6) as cdf from e join g on e.z = g.z"""


@query(_literal_sql())
def po_predict(spark, d):
    model = IDRModel.from_cdfs(spark, LITERAL[2], LITERAL[0], LITERAL[1], ["a", "b"])
    asked = spark.createDataFrame(ASKED, "id int, a double, b double")
    out = model.predict_cdf(asked).select("id", F.explode(F.arrays_zip(F.col("thresholds").alias("z"), F.col("cdf").alias("c"))).alias("s"))
    return rounded(out.select("id", F.col("s.z").alias("threshold"), F.col("s.c").alias("cdf")), "cdf")


@query("select * from (values (-1.0::double, 0.2::double, 1.5::double, 10.0::double), (0.5, 0.2, 1.5, 10.0), (9.0, 0.2, 1.5, 10.0)) t(x, p, prediction, quantile) where false union all "
       "select x::double, p::double, prediction::double, quantile::double from (values (-1.0, 0.25, 17.0, 10.0), (0.5, 0.25, 18.0, 10.0), (9.0, 0.25, 19.0, 20.0)) t(x, p, prediction, quantile)")
def from_cdfs(spark, d):
    """A literal model at a point below, between and above its covariates."""
    model = IDRModel.from_cdfs(spark, [[0.5, 0.8, 1.0], [0.2, 0.9, 1.0]], [0.0, 1.0], [10.0, 20.0, 30.0], ["x"])
    asked = spark.createDataFrame([(-1.0,), (0.5,), (9.0,)], "x double")
    return rounded(model.quantile(model.predict(asked), [0.25]).select("x", "p", "prediction", "quantile"), "prediction", "quantile")


@query("select * from (values (0, 3.0::double), (1, 4.5::double), (2, 3.0::double), (3, 4.5::double)) t(node, fitted)")
def iso_edges(spark, d):
    values = spark.createDataFrame([(0, 4.0), (1, 6.0), (2, 2.0), (3, 3.0)], "node int, value double")
    edges = spark.createDataFrame([(0, 1), (0, 2), (1, 3), (2, 3)], "lo int, hi int")
    return isotonic_edges(values, edges)


# ---- other aggregates ----

@query("select l_returnflag, round(sum(l_tax * l_quantity) / sum(l_tax), 6) as average, round((sum(l_tax * l_quantity * l_quantity) - power(sum(l_tax * l_quantity), 2) / sum(l_tax)) / (sum(l_tax) - sum(l_tax * l_tax) / sum(l_tax)), 6) as variance from lineitem group by 1")
def weighted_moments(spark, d):
    y, w = F.col("l_quantity"), F.col("l_tax")
    return rounded(line(spark, d).groupBy("l_returnflag").agg(weighted_average(y, w).alias("average"), weighted_variance(y, w).alias("variance")), "average", "variance")


@query("with s as (select l_returnflag, l_quantity y, row_number() over (partition by l_returnflag order by l_quantity) k, count(*) over (partition by l_returnflag) n from lineitem) "
       "select l_returnflag, round(sum(least(greatest(0.1 * n - (k - 1), 0), 1)::double * y) / (0.1 * any_value(n))::double, 6) as expected_shortfall from s group by 1", "expected_shortfall")
def _expected_shortfall(spark, d):
    return rounded(expected_shortfall(line(spark, d), "l_quantity", 0.1, by=["l_returnflag"]), "expected_shortfall")


@query("select l_returnflag, quantile_disc(l_quantity, 100.0 / count(*)) filter (true) as value from lineitem group by 1".replace("quantile_disc(l_quantity, 100.0 / count(*)) filter (true)", "list_sort(list(l_quantity))[100]"))
def order_stat(spark, d):
    return order_statistic(line(spark, d), "l_quantity", 100, ["l_returnflag"])


@query(_iso_sql("1.0::double", False).replace("x as l_discount", "x"))
def iso_functional(spark, d):
    """The generic pooling with the mean as block aggregate gives the isotonic mean."""
    return rounded(generic.isotonic_functional(line(spark, d), "l_quantity", "l_discount", K.average), "fitted")


@query("with recursive " + sql_clipped("""g as (select l_discount x, count(*)::double k, sum(l_quantity) s1, sum(l_quantity * l_quantity) s2 from lineitem group by 1),
xi as (select *, row_number() over (order by x) i from g),
iv as (select a.i r, b.i s, sum(q.k) k, sum(q.s1) s1, sum(q.s2) s2 from xi a join xi b on a.i <= b.i join xi q on q.i between a.i and b.i group by all),
raw as (select 0 z, r, s, (s2 - s1 * s1 / k) / (k - 1) v from iv)""", False) + " select x, round(f, 6) as fitted from clipped join xi using (i)")
def iso_variance(spark, d):
    return rounded(generic.isotonic_functional(line(spark, d), "l_quantity", "l_discount", K.variance, definition=True), "fitted")


@query("with recursive " + sql_clipped("""g as (select l_discount x, l_quantity y, count(*)::double k from lineitem group by all),
xi as (select x, row_number() over (order by x) i from (select distinct x from g)),
iv as (select a.i r, b.i s, g.y, sum(g.k) m from xi a join xi b on a.i <= b.i join xi q on q.i between a.i and b.i join g on g.x = q.x group by all),
cu as (select *, sum(m) over (partition by r, s order by y) - m lower, 0.2 * sum(m) over (partition by r, s) cut from iv),
raw as (select 0 z, r, s, sum(least(m, greatest(cut - lower, 0)) * y) / any_value(cut) v from cu group by r, s)""", False) + " select x, round(f, 6) as fitted from clipped join xi using (i)")
def iso_shortfall(spark, d):
    return rounded(generic.isotonic_functional(line(spark, d), "l_quantity", "l_discount", K.expected_shortfall(0.2), definition=True), "fitted")


#: Kaplan-Meier at 24 hours of every run of a user's gaps, in their order.
@query("with recursive " + sql_clipped(GAPS + """,
o as (select user_id z, y, observed, row_number() over (partition by user_id order by event_id) i from gaps),
iv as (select a.z, a.i r, b.i s, q.y, count(*) filter (q.observed) d, count(*) m from o a join o b on a.z = b.z and a.i <= b.i join o q on q.z = a.z and q.i between a.i and b.i group by all),
risk as (select *, sum(m) over (partition by z, r, s order by y desc) n from iv),
raw as (select z, r, s, 1 - case when max((d = n and y <= 24)::int) = 1 then 0 else exp(sum(case when y <= 24 and d > 0 and d < n then ln(1 - d / n::double) else 0 end)) end v from risk group by all)""")
    + " select z as user_id, round(c[g][1], 6) as value from tri where n = g")
def clipped_km(spark, d):
    """Each user's gaps, in order, as one sample."""
    return rounded(generic.clipped_sample_value(gaps(spark, d), "y", "event_id", K.kaplan_meier_at(24.0), observed="observed", by=["user_id"]), "value")


@query("""with recursive o as (select user_id z, value y, row_number() over (partition by user_id order by event_id) i from events),
p as (select *, sum(y) over w s1, sum(y * y) over w s2 from o window w as (partition by z order by i)),
raw as (select a.z, a.i r, b.i s, ((b.s2 - a.s2 + a.y * a.y) - power(b.s1 - a.s1 + a.y, 2) / (b.i - a.i + 1)) / (b.i - a.i) v from p a join p b on a.z = b.z and a.i < b.i),
bylen as (select z, s - r + 1 len, list(v order by r) vs from raw group by z, len),
lists as (select z, list(vs order by len) raw, max(len) g from bylen group by z),
tri as (select z, least(g, 3) n, raw, g, raw[1:2] c from lists
        union all select z, n + 1, raw, g, list_append(c, [list_aggregate(list_concat([raw[n][r]], [c[k - 1][r] for k in range(2, n)], [c[k - 1][r + n + 1 - k] for k in range(2, n)]), 'median') for r in range(1, g - n + 1)]) from tri where n < g)
select z as user_id, round(c[g - 1][1], 6) as value from tri where n = g""")
def split_variance(spark, d):
    """The variance of each user's event values as a median over splits."""
    return rounded(generic.sample_variance_of_splits(table(spark, d, "events"), "value", "event_id", by=["user_id"]).select("user_id", "value"), "value")


@query()
def park(spark, d):
    return rounded(fit_park(gaps(spark, d), "x", "y", "observed", centres=[1.0, 4.0, 8.0]), "cdf")


@query("select count(*)::bigint as cells, 0::bigint as bad, 0::bigint as far from (select distinct l_discount from lineitem) cross join (select distinct l_quantity from lineitem)")
def bagging(spark, d):
    """Averaged CDFs of five half samples: complete, rising, within [0, 1], and near the fit of all rows."""
    df = line(spark, d)
    asked = df.select("l_discount").distinct()
    out = idr_bag(df, "l_quantity", "l_discount", asked, 5, 0.5, seed=4)
    whole = line_model(spark, d).predict_cdf(asked).select("l_discount", F.col("cdf").alias("whole"))
    bad = F.exists("cdf", lambda c: (c < 0) | (c > 1 + 1e-12)) | F.exists(C.steps(F.col("cdf")), lambda s: s < -1e-12) | (F.size("cdf") != F.size("thresholds"))
    far = F.size(F.filter(F.zip_with("cdf", "whole", lambda a, b: F.abs(a - b)), lambda x: x > 0.1))
    return out.join(whole, "l_discount").agg(F.sum(F.size("cdf")).alias("cells"), F.count_if(bad).alias("bad"), F.sum(far).cast("long").alias("far"))


@query("with " + sql_idr(LINE) + " select threshold, x, round(cdf, 6) as cdf from idr")
def bagging_whole(spark, d):
    """Subsamples of all rows without replacement: the fit itself."""
    df = line(spark, d)
    out = idr_bag(df, "l_quantity", "l_discount", df.select("l_discount").distinct(), 5, 1.0, seed=4)
    cells = out.select(F.col("l_discount").alias("x"), F.explode(F.arrays_zip(F.col("thresholds").alias("z"), F.col("cdf").alias("c"))).alias("s"))
    return rounded(cells.select(F.col("s.z").alias("threshold"), "x", F.col("s.c").alias("cdf")), "cdf")


@query("with i as (select 2 * l_discount + l_tax v, l_quantity y from lineitem), " + sql_idr("select round(v, 4) x, y, 1.0::double w from i") + " select x, threshold, round(cdf, 6) as cdf from idr")
def index_model(spark, d):
    """A fixed index, then IDR on it."""
    def index(_training):
        return lambda df: df.withColumn("prediction", F.round(2 * F.col("l_discount") + F.col("l_tax"), 4))

    model = fit_index_model(line(spark, d), "l_quantity", index)
    return rounded(model.idr.long().select(F.col("prediction").alias("x"), "threshold", "cdf"), "cdf")


@query(_iso_sql("1.0::double", False, "l_returnflag").replace("x as l_discount", "x"))
def udtf_isotonic(spark, d):
    udtf.register(spark)
    line(spark, d).groupBy("l_returnflag", "l_discount").agg(F.avg("l_quantity").alias("y"), F.count("*").cast("double").alias("w")).createOrReplaceTempView("cdfloom_line")
    return rounded(spark.sql("select key as l_returnflag, x, fitted from isotonic_by(TABLE(select l_returnflag, l_discount, y, w from cdfloom_line))"), "fitted")


@query(_km_sql("x"))
def udtf_kaplan_meier(spark, d):
    udtf.register(spark)
    gaps(spark, d).groupBy("x", "y", "observed").agg(F.count("*").cast("double").alias("w")).createOrReplaceTempView("cdfloom_gaps")
    return rounded(spark.sql("select key as x, time, survival from kaplan_meier_by(TABLE(select x, y, observed, w from cdfloom_gaps))"), "survival")


@query("with " + sql_idr("select l_returnflag flag, l_discount x, l_quantity y, 1.0::double w from lineitem", True, "flag") + " select flag, x, threshold, round(cdf, 6) as cdf from idr")
def udtf_idr_cdf(spark, d):
    udtf.register(spark)
    line(spark, d).groupBy("l_returnflag", "l_discount", "l_quantity").agg(F.count("*").cast("double").alias("w")).createOrReplaceTempView("cdfloom_cells")
    return rounded(spark.sql("select key as flag, x, threshold, cdf from idr_cdf_by(TABLE(select l_returnflag, l_discount, l_quantity, w from cdfloom_cells))"), "cdf")


#: One price a part, in order of its key: every row is an item.
@query("with " + sql_chain("select p_size::double size, p_partkey::double x, 1.0::double w, p_retailprice n from part", "size", False) + " select size::int as p_size, x::bigint as p_partkey, round(f, 6) as fitted from fits")
def iso_indexed(spark, d):
    part = table(spark, d, "part").select("p_size", "p_partkey", "p_retailprice")
    out = isotonic_indexed(part, "p_retailprice", "p_partkey", by=["p_size"])
    return rounded(out.select(F.col("p_size").cast("int").alias("p_size"), F.col("p_partkey").cast("long").alias("p_partkey"), "fitted"), "fitted")


@query("select hi as node, count(*)::bigint as rank from (with " + PAIRS + " select lo, hi from pairs) group by hi union all select id as node, 0::bigint as rank from (with " + PAIRS + " select id from pts where id not in (select hi from pairs))")
def topological(spark, d):
    p = points(spark, d)
    covers = cover_pairs(dominance_pairs(p, ["a", "b"], "id"))
    return topological_order(covers, p.select(F.col("id").alias("node")), "node")


@query(f"with {PAIRS}, covers as (select lo, hi from pairs anti join (select distinct p.lo, q.hi from pairs p join pairs q on p.hi = q.lo) t using (lo, hi)), "
       "e as (select hi node, lo x, false up from covers union all select lo, hi, true from covers) "
       "select node, coalesce(string_agg(x::varchar, ',' order by x) filter (not up), '') as below, coalesce(string_agg(x::varchar, ',' order by x) filter (up), '') as above from e group by node")
def cover_adjacency(spark, d):
    found = adjacency(cover_pairs(dominance_pairs(points(spark, d), ["a", "b"], "id")))
    joined = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c)
    return found.select("node", joined("below"), joined("above"))


@query(_predicted("select id, round(sum(w * z), 6) as prediction from jump group by id"))
def ml_regressor(spark, d):
    model = IsotonicDistributionalRegressor("l_quantity", "l_discount").fit(line(spark, d))
    return rounded(model.transform(ask(spark, d)).select("id", "prediction"), "prediction")


@query("select 0::bigint as bad, 0.0::double as precision")
def model_checks(spark, d):
    """Consistency and diagnostics of a fit."""
    model = line_model(spark, d)
    return model.consistent().crossJoin(model.diagnostic()).select("bad", rounded(model.diagnostic(), "precision").select("precision").columns[0]).withColumn("precision", F.round("precision", 6) + 0.0)


def oracle_names() -> list[str]:
    return list(itertools.chain(ORACLES))
