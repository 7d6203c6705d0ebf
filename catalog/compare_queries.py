"""Statistics by group, tests and summary tables."""

import numpy as np
from pyspark.sql import functions as F

from catalog.exposure_queries import DESO, EXP
from catalog.fixtures import Tables, rd, rd3, rounded
from catalog.place_queries import METRICS, _median_cte, cells_sql
from catalog.registry import query
from copresence.functions import indices, labels
from copresence.functions.draws import poisson_quantile
from copresence.operators import cleaning, compare, place, quantiles, series


@query("weighted_moments", "E13 E14", f"""SELECT grp, {rd('tw')} AS weight, {rd('m')} AS mean, {rd('sqrt(ss/(tw-1))')} AS std FROM (
    SELECT c.grp, any_value(t.tw) AS tw, any_value(t.m) AS m, sum(w*pow(x-t.m,2)) AS ss FROM cases c
    JOIN (SELECT grp, sum(w) AS tw, sum(x*w)/sum(w) AS m FROM cases GROUP BY 1) t ON t.grp = c.grp GROUP BY 1)""")
def _(t: Tables):
    return rounded(compare.wmoments(t.cases, ["grp"], "x", "w"), "weight", "mean", "std")


KNOT = """SELECT grp, status, x, w, sum(w) OVER o - w/2 AS k, sum(w) OVER (PARTITION BY grp, status) AS tot FROM cases
    WINDOW o AS (PARTITION BY grp, status ORDER BY x, w ROWS UNBOUNDED PRECEDING)"""


@query("interpolated_quantiles", "E15 K3", f"""SELECT grp, status, p AS prob, {rd('''max(CASE WHEN k2 IS NULL AND k <= p*tot THEN x
    WHEN rn = 1 AND k >= p*tot THEN x WHEN k <= p*tot AND k2 > p*tot THEN x + (p*tot-k)/(k2-k)*(x2-x) END)''')} AS value FROM (
    SELECT *, unnest([0.1e0, 0.5e0, 0.9e0]) AS p FROM (SELECT *, lead(x) OVER o AS x2, lead(k) OVER o AS k2, row_number() OVER o AS rn FROM knot
    WINDOW o AS (PARTITION BY grp, status ORDER BY x, w, k))) GROUP BY 1, 2, 3""", knot=KNOT)
def _(t: Tables):
    return rounded(quantiles.wquantile_interp(t.cases, ["grp", "status"], "x", "w", [0.1, 0.5, 0.9]), "value")


def ecdf_sql(table: str, by: str, x: str, w: str, probs: str) -> str:
    """Smallest value whose cumulative weight reaches p*W, averaged with the next value on equality."""
    return f"""SELECT {by}, p AS prob, min(CASE WHEN cum = p*tot AND nx IS NOT NULL THEN (x+nx)/2 ELSE x END) AS value FROM (
        SELECT *, unnest([{probs}]) AS p FROM (SELECT *, sum(w) OVER (PARTITION BY {by} ORDER BY x) AS cum, sum(w) OVER (PARTITION BY {by}) AS tot,
        lead(x) OVER (PARTITION BY {by} ORDER BY x) AS nx FROM (SELECT {by}, {x} AS x, sum({w}) AS w FROM {table} GROUP BY ALL))) WHERE cum >= p*tot GROUP BY ALL"""


Q3 = "0.25e0, 0.5e0, 0.75e0"


def stats_sql(table: str, by: str, x: str, w: str) -> str:
    pick = ", ".join(f"round(max(value) FILTER (prob = 0.{q}e0), 6)+0 AS q{q}" for q in (25, 50, 75)).replace("0.50e0", "0.5e0")
    return f"""SELECT * FROM (SELECT {by}, {pick} FROM ({ecdf_sql(table, by, x, w, Q3)}) GROUP BY ALL)
        JOIN (SELECT {by}, round(sum({x}*{w})/sum({w}), 6)+0 AS avg FROM {table} GROUP BY ALL) USING ({by})"""


@query("weighted_group_stats", "E16 E17", stats_sql("cases", "grp, status", "x", "w"))
def _(t: Tables):
    return rounded(quantiles.group_stats(t.cases, ["grp", "status"], "x", "w"), "q25", "q50", "q75", "avg")


@query("plain_quantiles", "E18", f"""SELECT grp, prob, {rd('value')} AS value FROM (SELECT grp, unnest([0.05e0, 0.5e0, 0.95e0]) AS prob,
    unnest(quantile_cont(x, [0.05, 0.5, 0.95])) AS value FROM cases GROUP BY 1)""")
def _(t: Tables):
    return rounded(quantiles.quantiles(t.cases, ["grp"], "x", [0.05, 0.5, 0.95]), "value")


QC = "(SELECT quantile_cont(x, [0.0, 0.25, 0.5, 0.75, 1.0]) AS e FROM cases)"


@query("quantile_bins", "B14 B15", f"""SELECT bin, count(*) AS n, {rd3('sum(x)')} AS total FROM (SELECT x, CASE WHEN x >= e[1] AND x <= e[2] THEN 1 WHEN x > e[2] AND x <= e[3] THEN 2
    WHEN x > e[3] AND x <= e[4] THEN 3 WHEN x > e[4] AND x <= e[5] THEN 4 END AS bin FROM cases, {QC}) GROUP BY 1""")
def _(t: Tables):
    out = cleaning.qcut(t.cases, "x", [0.0, 0.25, 0.5, 0.75, 1.0], "bin")
    return out.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("x"), 3).alias("total"))


@query("weighted_quantile_bins", "B16", f"""SELECT c.grp, CASE WHEN x <= q25 THEN 'low' WHEN x <= q75 THEN 'mid' ELSE 'high' END AS bin, count(*) AS n
    FROM cases c JOIN (SELECT grp, max(value) FILTER (prob = 0.25e0) AS q25, max(value) FILTER (prob = 0.75e0) AS q75 FROM ({ecdf_sql('cases', 'grp', 'x', 'w', Q3)}) GROUP BY 1) q ON q.grp = c.grp GROUP BY 1, 2""")
def _(t: Tables):
    out = cleaning.wqcut(t.cases, "x", "w", [0.25, 0.75], ["grp"], "bin", ["low", "mid", "high"])
    return out.groupBy("grp", "bin").agg(F.count(F.lit(1)).alias("n"))


@query("fixed_bins", "B13 C20", """SELECT class, log_class, count(*) AS n FROM (SELECT CASE WHEN disc >= 0 AND disc <= 0.02e0 THEN 'none' WHEN disc > 0.02e0 AND disc <= 0.06e0 THEN 'some' WHEN disc > 0.06e0 AND disc <= 0.1e0 THEN 'much' END AS class,
    CAST(round_even(log10(x), 0) AS INTEGER) AS log_class FROM cases) GROUP BY 1, 2""")
def _(t: Tables):
    c = labels.cut(F.col("disc"), [0, 0.02, 0.06, 0.1], ["none", "some", "much"], include_lowest=True)
    return t.cases.groupBy(c.alias("class"), F.rint(F.log10("x")).cast("int").alias("log_class")).agg(F.count(F.lit(1)).alias("n"))


def t_tail_sql(t: str, df: str) -> str:
    """P(T > t) for t >= 0 by Simpson's rule after a tangent substitution; the upper end lies 60 deviations out."""
    lo = f"atan({t}/sqrt({df}))"
    step = f"((least(pi()/2, {lo} + 60/sqrt({df})) - {lo})/4000)"
    return f"""(exp(lgamma(({df} + 1)/2.0e0) - lgamma({df}/2.0e0))/sqrt(pi())*{step}/3*list_sum(list_transform(range(0, 4001),
        lambda i: CASE WHEN i = 0 OR i = 4000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END*pow(greatest(cos({lo} + i*{step}), 0), {df} - 1))))"""


def spearman_sql(by: str, x: str, y: str) -> str:
    return f"""SELECT *, 2*{t_tail_sql('abs(t)', '(n - 2)')} AS p FROM (SELECT *, rho*sqrt((n - 2)/(1 - rho*rho)) AS t FROM (SELECT {by}, corr(rx, ry) AS rho, count(*) AS n FROM (
        SELECT {by}, rank() OVER a + (count(*) OVER (PARTITION BY {by}, {x}) - 1)/2.0e0 AS rx, rank() OVER b + (count(*) OVER (PARTITION BY {by}, {y}) - 1)/2.0e0 AS ry
        FROM cases WINDOW a AS (PARTITION BY {by} ORDER BY {x}), b AS (PARTITION BY {by} ORDER BY {y})) GROUP BY ALL))"""


@query("rank_correlation", "E39", f"SELECT grp, {rd('rho')} AS rho, n, {rd('t')} AS t, {rd('p')} AS p FROM sp", sp=spearman_sql("grp", "x", "disc"))
def _(t: Tables):
    return rounded(compare.spearman(t.cases, ["grp"], "x", "disc"), "rho", "t", "p")


@query("significant_rank_correlations", "E39", f"SELECT grp, zone, g, {rd('rho')} AS rho, n, {rd('p')} AS p FROM sp WHERE p < 0.2", sp=spearman_sql("grp, zone, g", "y", "tax"))
def _(t: Tables):
    return rounded(compare.spearman(t.cases, ["grp", "zone", "g"], "y", "tax", gate=0.2).drop("t"), "rho", "p")


@query("weighted_correlation", "E40", f"""SELECT grp, {rd('sum(w*(x-mx)*(tax-mt))/sqrt(sum(w*pow(x-mx,2))*sum(w*pow(tax-mt,2)))')} AS r FROM cases JOIN
    (SELECT grp, sum(x*w)/sum(w) AS mx, sum(tax*w)/sum(w) AS mt FROM cases GROUP BY 1) USING (grp) GROUP BY 1""")
def _(t: Tables):
    return rounded(compare.wcorr(t.cases, ["grp"], "x", "tax", "w"), "r")


# Poisson counts by inversion of an arithmetic number, so that SQL can repeat a bootstrap: a cell is a set of equal rows, `m` its mean
RATES = """SELECT m, list(share ORDER BY j) AS shares FROM (SELECT m, j, sum(exp(j*ln(m) - m - lgamma(j + 1))) OVER (PARTITION BY m ORDER BY j) AS share FROM (
    SELECT m, unnest(range(0, CAST(m + 12*sqrt(m) + 30 AS BIGINT))) AS j FROM (SELECT DISTINCT m FROM cells))) GROUP BY 1"""
COPIES = """SELECT c.* EXCLUDE (m), sim, len(list_filter(shares, lambda s: s < (((key*7919 + sim*104729) % 10007) + 0.5e0)/10007)) AS copies
    FROM (SELECT *, unnest(range(1, 1001)) AS sim FROM cells) c JOIN rates USING (m)"""
DRAWN = dict(rates=RATES, copies=COPIES)


def arithmetic_counts(keys, means, n):
    """((7919*key + 104729*sim) mod 10007 + 0.5)/10007, turned into Poisson counts."""
    mixed = (7919 * keys)[:, None] + (104729 * np.arange(1, n + 1))[None, :]
    return poisson_quantile(means, (mixed % 10007 + 0.5) / 10007)


def whole_cases(t: Tables):
    """Cases in whole units, with a small weight: few distinct values."""
    return t.cases.withColumns({"x": F.floor("x").cast("double"), "w5": 1 + F.col("w") % 5})


def _group_key(*parts):
    """A whole number for a cell; parts are columns below 1000."""
    key = F.ascii("grp").cast("long")
    for p in parts:
        key = key * 1000 + p.cast("long")
    return key


@query("weighted_correlation_se", "E40 G7", f"""SELECT grp, {rd('r')} AS r, {rd('stddev_samp(rs)')} AS se FROM (SELECT grp, sim,
        (sum(c)*sum(c*dx*dt) - sum(c*dx)*sum(c*dt))/sqrt((sum(c)*sum(c*dx*dx) - pow(sum(c*dx), 2))*(sum(c)*sum(c*dt*dt) - pow(sum(c*dt), 2))) AS rs
        FROM (SELECT grp, sim, copies*w5 AS c, disc - md AS dx, tax - mt AS dt FROM copies JOIN (SELECT grp, avg(disc) AS md, avg(tax) AS mt FROM cases GROUP BY 1) USING (grp)) GROUP BY 1, 2)
    JOIN (SELECT grp, sum(w5*(disc-md)*(tax-mt))/sqrt(sum(w5*pow(disc-md, 2))*sum(w5*pow(tax-mt, 2))) AS r FROM (SELECT grp, disc, tax, 1 + w%5 AS w5 FROM cases) JOIN (
        SELECT grp, sum((1 + w%5)*disc)/sum(1 + w%5) AS md, sum((1 + w%5)*tax)/sum(1 + w%5) AS mt FROM cases GROUP BY 1) USING (grp) GROUP BY 1) USING (grp) GROUP BY grp, r""", **DRAWN,
       cells="SELECT grp, disc, tax, 1 + w%5 AS w5, count(*)*1.0e0 AS m, CAST(((ascii(grp)*1000 + round(disc*100))*1000 + round(tax*100))*1000 + 1 + w%5 AS BIGINT) AS key FROM cases GROUP BY ALL")
def _(t: Tables):
    key = _group_key(F.round(F.col("_x") * 100), F.round(F.col("_y") * 100), F.col("_w"))
    return rounded(compare.wcorr_se(whole_cases(t), ["grp"], "disc", "tax", "w5", counts=arithmetic_counts, key=key), "r", "se")


@query("bootstrap_median", "E41 G7", f"""SELECT grp, {rd('median(value)')} AS median, {rd('stddev_pop(value)')} AS se FROM (
    SELECT grp, sim, min_by(CASE WHEN upto*2 = whole THEN (v + coalesce(after, v))/2 ELSE v END, v) AS value FROM (
        SELECT *, sum(s) OVER (PARTITION BY grp, sim ORDER BY v) AS upto, sum(s) OVER (PARTITION BY grp, sim) AS whole, lead(v) OVER (PARTITION BY grp, sim ORDER BY v) AS after
        FROM (SELECT grp, sim, v, sum(copies*w) AS s FROM copies GROUP BY 1, 2, 3 HAVING sum(copies) > 0)) WHERE upto*2 >= whole GROUP BY 1, 2) GROUP BY 1""", **DRAWN,
       cells="SELECT grp, floor(x) AS v, w, count(*)*1.0e0 AS m, CAST((ascii(grp)*1000 + floor(x))*1000 + w AS BIGINT) AS key FROM cases GROUP BY ALL")
def _(t: Tables):
    key = _group_key(F.col("_x"), F.col("_w"))
    return rounded(compare.boot_median(whole_cases(t), ["grp"], "x", "w", counts=arithmetic_counts, key=key), "median", "se")


@query("bootstrap_median_of_prices", "E41 G7")
def _(t: Tables):
    return rounded(compare.boot_median(t.cases, ["grp"], "x", "w"), "median", "se")


_Z = "greatest(abs(z), 1e-300)"
TAIL = f"""CASE WHEN abs(z) < 2.5 THEN 0.5 - exp(-z*z/2)/sqrt(2*pi())*list_sum(list_transform(range(0, 61), lambda k: exp((2*k + 1)*ln({_Z}) - lgamma(2*k + 2) + k*ln(2) + lgamma(k + 1))))
    ELSE exp(-z*z/2)/sqrt(2*pi())/list_reduce([abs(z)] || list_transform(range(100, 0, -1), lambda k: k*1.0e0), lambda below, k: abs(z) + k/below) END"""


@query("bootstrap_signed_rank", "E42 G7", f"""SELECT grp, {rd('avg(p)')} AS p_mean, {rd('stddev_pop(p)')} AS p_sd, {rd3('avg(t_plus)')} AS stat_mean, {rd3('stddev_pop(t_plus)')} AS stat_sd FROM (
    SELECT *, CASE WHEN z >= 0 THEN {TAIL} ELSE 1 - ({TAIL}) END AS p FROM (SELECT *, (t_plus - n*(n + 1)/4)/sqrt(n*(n + 1)*(2*n + 1)/24 - ties/48) AS z FROM (
        SELECT grp, sim, sum(pos*(lt + (c + 1)/2)) AS t_plus, sum(c) AS n, sum(c*c*c - c) AS ties FROM (SELECT *, sum(c) OVER (PARTITION BY grp, sim ORDER BY a) - c AS lt FROM (
            SELECT grp, sim, abs(v) AS a, sum(copies)*1.0e0 AS c, sum(CASE WHEN v > 0 THEN copies ELSE 0 END)*1.0e0 AS pos FROM copies GROUP BY 1, 2, 3)) GROUP BY 1, 2))) GROUP BY 1""", **DRAWN,
       cells="""SELECT grp, floor(x) - 50 AS v, sum(w/whole*n) AS m, CAST(ascii(grp)*1000 + floor(x) AS BIGINT) AS key FROM cases JOIN (SELECT grp, sum(w) AS whole, count(*) AS n FROM cases GROUP BY 1) USING (grp)
           WHERE floor(x) <> 50 GROUP BY ALL""")
def _(t: Tables):
    out = compare.boot_wilcoxon(whole_cases(t), ["grp"], "x", "w", 50.0, "greater", counts=arithmetic_counts, key=_group_key(F.col("_v") + 50))
    return rounded(rounded(out, "p_mean", "p_sd"), "stat_mean", "stat_sd", digits=3)


@query("bootstrap_signed_rank_of_prices", "E42 G7")
def _(t: Tables):
    return rounded(rounded(compare.boot_wilcoxon(t.cases, ["grp"], "x", "w", 50.0, "greater"), "p_mean", "p_sd"), "stat_mean", "stat_sd", digits=3)


@query("signed_rank_sums", "E42", f"""SELECT grp, {rd('sum(CASE WHEN v > 0 THEN c*(lt+(tot+1)/2.0e0) END)')} AS t_plus, CAST(sum(c) AS BIGINT) AS n FROM (
    SELECT *, sum(c) OVER (PARTITION BY grp ORDER BY a) - tot AS lt FROM (SELECT grp, v, abs(v) AS a, sum(w) AS c, sum(sum(w)) OVER (PARTITION BY grp, abs(v)) AS tot
    FROM (SELECT grp, disc-0.05e0 AS v, w FROM cases) WHERE v <> 0 GROUP BY 1, 2)) GROUP BY 1""")
def _(t: Tables):
    v = t.cases.select("grp", (F.col("disc") - 0.05).alias("v"), F.col("w").cast("long").alias("copies"))
    return rounded(compare.signed_rank(v, ["grp"], "v", "copies").drop("z"), "t_plus")


@query("weighted_rank_test", "E43", f"""SELECT grp, n, {rd('m1-m0')} AS estimate, {rd('(m1-m0)/sqrt(ss*n/(n-1))')} AS t FROM (SELECT r.grp, any_value(n) AS n, any_value(m1) AS m1, any_value(m0) AS m0,
    sum(pow(CASE WHEN g = 1 THEN w*(rk-m1)/w1 ELSE w*(rk-m0)/w0 END, 2)) AS ss FROM ranked r JOIN (SELECT grp, count(*) AS n, sum(w) FILTER (g=1) AS w1, sum(w) FILTER (g=0) AS w0,
    sum(w*rk) FILTER (g=1)/sum(w) FILTER (g=1) AS m1, sum(w*rk) FILTER (g=0)/sum(w) FILTER (g=0) AS m0 FROM ranked GROUP BY 1) m ON m.grp = r.grp GROUP BY 1)""",
       ranked="""SELECT grp, g, w, (sum(w) OVER (PARTITION BY grp ORDER BY x) - sum(w) OVER (PARTITION BY grp, x)/2)/sum(w) OVER (PARTITION BY grp) AS rk FROM cases""")
def _(t: Tables):
    return rounded(compare.wrank_test(t.cases, ["grp"], "x", "g", "w"), "estimate", "t")


@query("weighted_ks", "E44", f"""SELECT grp, {rd('max(abs(a/ta-b/tb))')} AS ks FROM (SELECT grp, x, sum(w*(1-g)) OVER o AS a, sum(w*g) OVER o AS b, sum(w*(1-g)) OVER p AS ta, sum(w*g) OVER p AS tb
    FROM cases WINDOW o AS (PARTITION BY grp ORDER BY x), p AS (PARTITION BY grp)) GROUP BY 1""")
def _(t: Tables):
    return rounded(compare.wks(t.cases, ["grp"], "x", "g", "w"), "ks")


@query("effect_size", "E45", f"""SELECT grp, {rd('d')} AS d, CASE WHEN abs(d) < 0.2 THEN 'Very small' WHEN abs(d) < 0.5 THEN 'Small' WHEN abs(d) < 0.8 THEN 'Medium' ELSE 'Large' END AS size FROM (
    SELECT grp, (any_value(mx)-any_value(my))/sqrt((sum(w*pow(x-mx,2)) + sum(w*pow(y-my,2)))/(2*sum(w)-2)) AS d FROM cases JOIN
    (SELECT grp, sum(x*w)/sum(w) AS mx, sum(y*w)/sum(w) AS my FROM cases GROUP BY 1) USING (grp) GROUP BY 1)""")
def _(t: Tables):
    return rounded(compare.cohen_d(t.cases, ["grp"], "x", "y", "w"), "d")


@query("weighted_mean_interval", "E46", f"""SELECT grp, {rd('m')} AS mean, {rd('m-1.959963984540054e0*se')} AS lower, {rd('m+1.959963984540054e0*se')} AS upper FROM (
    SELECT grp, any_value(mx) AS m, sqrt(sum(w*pow(x-mx,2))/sum(w)/count(*)) AS se FROM cases JOIN (SELECT grp, sum(x*w)/sum(w) AS mx FROM cases GROUP BY 1) USING (grp) GROUP BY 1)""")
def _(t: Tables):
    return rounded(compare.wmean_ci(t.cases, ["grp"], "x", "w"), "mean", "lower", "upper")


SERIES_KEY = "uid, weekday, holiday"
# both one-sided tests against a band of 0.1; the exact signed-rank distribution is convolved rank by rank, the t tail integrated
SERIES = dict(
    series=f"SELECT {SERIES_KEY}, {rd('ice_birth')} AS v FROM exped WHERE ice_birth IS NOT NULL",
    moments=f"SELECT {SERIES_KEY}, count(*) AS whole, avg(v) AS mean, stddev_samp(v) AS sd FROM series GROUP BY ALL",
    sides=f"SELECT {SERIES_KEY}, 'greater' AS side, v - 0.1e0 AS d FROM series UNION ALL SELECT {SERIES_KEY}, 'less', -(v + 0.1e0) FROM series",
    placed=f"""SELECT *, rank() OVER (PARTITION BY {SERIES_KEY}, side ORDER BY abs(d)) + (t - 1)/2 AS place FROM (
        SELECT *, count(*) OVER (PARTITION BY {SERIES_KEY}, side, abs(d))*1.0e0 AS t FROM sides WHERE d <> 0)""",
    summed=f"SELECT {SERIES_KEY}, side, coalesce(sum(place) FILTER (d > 0), 0) AS plus, count(*)*1.0e0 AS n, sum(t*t - 1) AS ties FROM placed GROUP BY ALL",
    exact="""SELECT whole, list_reduce([[1.0e0]] || list_transform(range(1, whole + 1), lambda r: [r*1.0e0]), lambda acc, x: list_transform(range(1, CAST(len(acc) + x[1] + 1 AS BIGINT)),
        lambda k: (coalesce(acc[k], 0) + CASE WHEN k > x[1] THEN coalesce(acc[CAST(k - x[1] AS BIGINT)], 0) ELSE 0 END)/2)) AS share FROM (SELECT DISTINCT whole FROM moments WHERE whole <= 50)""",
    scored=f"""SELECT m.*, s.side, s.plus, s.n, s.ties, e.share, CASE s.side WHEN 'greater' THEN mean - 0.1e0 ELSE -(mean + 0.1e0) END/(sd/sqrt(whole)) AS t, (plus - n*(n + 1)/4)/nullif(sqrt(n*(n + 1)*(2*n + 1)/24 - ties/48), 0) AS z
        FROM moments m JOIN summed s USING ({SERIES_KEY}) LEFT JOIN exact e USING (whole)""",
)
T_TAIL = """exp(lgamma(whole/2.0e0) - lgamma((whole - 1)/2.0e0))/sqrt(pi())*(pi()/2 - atan(t/sqrt(whole - 1)))/2000/3*list_sum(list_transform(range(0, 2001),
    lambda i: CASE WHEN i = 0 OR i = 2000 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END*pow(greatest(cos(atan(t/sqrt(whole - 1)) + i*(pi()/2 - atan(t/sqrt(whole - 1)))/2000), 0), whole - 2)))"""


@query("series_tests", "E47", f"""SELECT {SERIES_KEY}, any_value(CAST(whole AS INTEGER)) AS n, any_value({rd('mean', 11)}) AS mean, {', '.join(
    f"max({v}) FILTER (side = '{s}') AS {c}_{s}" for s in ('greater', 'less') for c, v in (('t', 'tp'), ('w', 'plus'), ('rank', 'rp')))}
    FROM (SELECT *, {rd(f"CASE WHEN whole > 1 THEN {T_TAIL} END")} AS tp, {rd(f"CASE WHEN ties = 0 AND n = whole AND whole <= 50 THEN list_sum(share[CAST(plus AS BIGINT) + 1:]) WHEN z >= 0 THEN {TAIL} ELSE 1 - ({TAIL}) END")} AS rp
        FROM scored) GROUP BY ALL""", **SERIES, exped=EXP, **DESO)
def _(t: Tables):
    from catalog.exposure_queries import exp
    rows = rounded(exp(t), "ice_birth")
    out = series.tests(rows, ["uid", "weekday", "holiday"], "ice_birth", 0.1).drop("normal_p")
    return rounded(rounded(out, "t_greater", "t_less", "rank_greater", "rank_less"), "mean", digits=11)


@query("person_series_class", "E47 K1")
def _(t: Tables):
    from catalog.exposure_queries import exp
    return compare.ice_group(exp(t), ["uid", "weekday", "holiday"], "ice_birth", 0.0)


VISITORS = ["lowest_income", "cum_jobs"]


def place_series(t: Tables):
    from catalog.place_queries import shares
    sa, sb = shares(t)
    people = t.persons.select("uid", "wt_p", "q1", "q2", "q3", "q4", "birth_se", "birth_eu", "birth_other", "pop", *VISITORS)
    return place.place_metrics(t.bins, people, "loc", VISITORS, sa, sb).where("weekday = 1 and holiday = 0")


@query("place_series_class", "E48")
def _(t: Tables):
    out = series.place_classes(place_series(t), "loc", "ice_birth", VISITORS)
    return rounded(out, "ice_birth", *VISITORS)


@query("place_visitor_medians", "E48", f"""SELECT loc, {rd('median(ice_birth)')} AS ice_birth, {', '.join(f'{rd(f"median({a})")} AS {a}' for a in VISITORS)} FROM (SELECT * RENAME (unit AS loc) FROM metrics)
    {' '.join(f"JOIN (SELECT * RENAME (deso AS loc) FROM {_median_cte(a)}) m{i} USING (weekday, holiday, loc, time_seq)" for i, a in enumerate(VISITORS))}
    WHERE weekday = 1 AND holiday = 0 AND ice_birth IS NOT NULL GROUP BY 1""", cells=cells_sql("loc"), metrics=METRICS,
       pb=f"SELECT b.weekday, b.holiday, b.loc AS deso, b.time_seq, b.wt_total, {', '.join(f'p.{a}*1.0e0 AS {a}' for a in VISITORS)} FROM bins b JOIN persons p ON b.uid = p.uid")
def _(t: Tables):
    out = series.place_classes(place_series(t), "loc", "ice_birth", VISITORS).drop("grp")
    return rounded(out, "ice_birth", *VISITORS)


@query("flow_similarity", "E49", f"""SELECT {rd('2*sum(least(a, b))/(sum(a)+sum(b))')} AS ssi FROM (SELECT x/sum(x) OVER () AS a, n/sum(n) OVER () AS b FROM (
    SELECT origin, desti, sum(weight) AS x, count(*)*1.0e0 AS n FROM trips GROUP BY 1, 2))""")
def _(t: Tables):
    od = t.trips.groupBy("origin", "desti").agg(F.sum("weight").alias("x"), F.count(F.lit(1)).alias("y"))
    return rounded(compare.ssi(od, "x", "y"), "ssi")


@query("feature_screen", "E50 S6", f"""SELECT feature, {rd('vif')} AS vif, round(f, 1)+0 AS f, vif < 10 AS keep, CAST(row_number() OVER (ORDER BY f DESC, feature) AS INTEGER) AS rank FROM (SELECT unnest(['x', 'disc']) AS feature, 1/(1-r*r) AS vif,
    unnest([a*a/(1-a*a)*(n-2), b*b/(1-b*b)*(n-2)]) AS f FROM (SELECT sum(x*disc)/sqrt(sum(x*x)*sum(disc*disc)) AS r, corr(x, y) AS a, corr(disc, y) AS b, count(*) AS n FROM cases))""")
def _(t: Tables):
    out = compare.feature_screen(t.cases, ["x", "disc"], "y")
    return rounded(out, "vif").withColumn("f", F.round("f", 1))


@query("stay_ccdf", "E51", f"SELECT kind, dur, {rd('1-cume_dist() OVER (PARTITION BY kind ORDER BY dur)')} AS ccdf FROM stops QUALIFY row_number() OVER (PARTITION BY kind, dur) = 1")
def _(t: Tables):
    return rounded(compare.ccdf(t.stops, ["kind"], "dur"), "ccdf")


@query("stay_summary", "E52", f"""SELECT kind, count(dur) AS count, {rd('avg(dur)')} AS mean, {rd('stddev_samp(dur)')} AS std, min(dur) AS min, max(dur) AS max, {rd('quantile_cont(dur, 0.25)')} AS q25,
    {rd('quantile_cont(dur, 0.5)')} AS q50, {rd('quantile_cont(dur, 0.75)')} AS q75 FROM stops GROUP BY 1""")
def _(t: Tables):
    return rounded(compare.describe(t.stops, ["kind"], "dur"), "mean", "std", "q25", "q50", "q75")


@query("weighted_histogram", "E53", f"""SELECT 'lin' AS scale, grp, CAST(floor(x/5) AS INTEGER) AS bin, {rd('sum(w)')} AS weight, count(*) AS n FROM cases GROUP BY 2, 3
    UNION ALL SELECT 'log', grp, CAST(floor((log10(x)-0)/0.25e0) AS INTEGER), {rd('sum(w)')}, count(*) FROM cases GROUP BY 2, 3""")
def _(t: Tables):
    lin = compare.whist(t.cases, ["grp"], "x", "w", 0.0, 5.0).withColumn("scale", F.lit("lin"))
    log = compare.whist(t.cases, ["grp"], "x", "w", 0.0, 0.25, log=True).withColumn("scale", F.lit("log"))
    return rounded(lin.unionByName(log), "weight")


@query("histogram_2d", "E54", "SELECT CAST(floor(x/10) AS INTEGER) AS bin_x, CAST(floor(tax/0.02e0) AS INTEGER) AS bin_y, count(*) AS n FROM cases GROUP BY 1, 2")
def _(t: Tables):
    return compare.hist2d(t.cases, "x", "tax", 10.0, 0.02)


GROUPED = """SELECT c.*, CASE WHEN x >= e[1] AND x <= e[2] THEN 1 WHEN x <= e[3] THEN 2 WHEN x <= e[4] THEN 3 WHEN x <= e[5] THEN 4 END AS access_grp
    FROM cases c, (SELECT quantile_cont(x, [0.0, 0.25, 0.5, 0.75, 1.0]) AS e FROM cases)"""


@query("access_group_stats", "E63", f"""SELECT * FROM ({stats_sql('grouped', 'grp, access_grp', 'disc', 'w')})
    JOIN (SELECT access_grp, round(sum(x*w)/sum(w), 6)+0 AS access_mean FROM grouped GROUP BY 1) USING (access_grp)""", grouped=GROUPED)
def _(t: Tables):
    out = compare.access_stats(t.cases, "x", "disc", "w", ["grp"], n=4)
    return rounded(out, "q25", "q50", "q75", "avg", "access_mean")


@query("reduction_shares", "E64 E65 B21", f"""SELECT grp, status, {rd('sum(w) FILTER ((y-x)/abs(x) <= -0.05e0)/sum(w)*100')} AS share_dec, {rd('sum(w) FILTER (abs(y) < abs(x))/sum(w)*100')} AS share_reduced, {rd("sum(CASE WHEN CASE WHEN x < 0 THEN x-y ELSE y-x END > 0 THEN w ELSE 0 END)/sum(w)*100")} AS share_inc FROM cases GROUP BY 1, 2""")
def _(t: Tables):
    c = t.cases.withColumn("delta", indices.signed_change(F.col("x"), F.col("y")))
    a = compare.reduction_share(c, ["grp", "status"], "x", "delta", "w", -0.05)
    b = compare.reduced_share(c, ["grp", "status"], "y", "x", "w")
    labelled = c.withColumn("change", indices.change_label(F.col("delta")))
    more = compare.weighted_share(labelled, ["grp", "status"], F.col("change") == "inc", "w", "share_inc")
    return rounded(a.join(b, ["grp", "status"]).join(more, ["grp", "status"]), "share_dec", "share_reduced", "share_inc")


@query("grid_map", "E66", f"""SELECT zone, grp, status, g, {rd('sum(w)')} AS pop, {rd('sum(x*w)/sum(w)')} AS x, {rd('sum(disc*w)/sum(w)')} AS disc FROM cases GROUP BY 1, 2, 3, 4""")
def _(t: Tables):
    return rounded(compare.grid_map(t.cases, ["zone", "grp", "status", "g"], ["x", "disc"], "w"), "pop", "x", "disc")


@query("segregated_zone_share", "E67", f"""SELECT county, count(*) AS zones, {rd('avg(CASE WHEN abs(ice) > 0.4e0 THEN 1 ELSE 0 END)*100')} AS segregated FROM (SELECT n_regionkey AS county, (birth_se-birth_other)*1.0e0/pop AS ice FROM zones JOIN nation ON n_nationkey = deso) GROUP BY 1""")
def _(t: Tables):
    ice = indices.ice(F.col("birth_se"), F.col("birth_other"), F.col("pop"))
    z = t.zones.join(t.squares.select("deso", "county"), "deso").select("county", ice.alias("ice"))
    return rounded(compare.seg_share(z, "county", "ice", 0.4), "segregated")


CATES = ["status", "g", "zone", "line", "ship", "size"]
MEASURES = ["x", "y", "disc", "tax", "w", "net", "gross"]
WIDE = "SELECT *, oid % 4 AS ship, CASE WHEN w > 25 THEN 'large' ELSE 'small' END AS size, x - tax AS net, x + disc AS gross FROM cases"
LONG = f"""SELECT grp, w, unnest([{', '.join(f"'{c}'" for c in CATES)}]) AS cate_name, unnest([{', '.join(f'CAST({c} AS VARCHAR)' for c in CATES)}]) AS cate_level, {', '.join(f'{m} AS m_{m}' for m in MEASURES)} FROM wide"""
LONG2 = f"SELECT grp, w, cate_name, cate_level, unnest([{', '.join(repr(m) for m in MEASURES)}]) AS var, unnest([{', '.join(f'm_{m}' for m in MEASURES)}]) AS val FROM long1"


@query("heterogeneity_table", "E68", stats_sql("long2", "grp, cate_name, cate_level, var", "val", "w"), wide=WIDE, long1=LONG, long2=LONG2)
def _(t: Tables):
    wide = t.cases.withColumns({
        "ship": F.col("oid") % 4, "size": F.when(F.col("w") > 25, "large").otherwise("small"),
        "net": F.col("x") - F.col("tax"), "gross": F.col("x") + F.col("disc")})
    return rounded(compare.heterogeneity(wide, ["grp"], CATES, MEASURES, "w"), "q25", "q50", "q75", "avg")


IMP = "SELECT zone, s, row_number() OVER (ORDER BY s DESC, zone) AS rk FROM (SELECT zone, round(avg(x), 6) AS s FROM cases WHERE grp = '{g}' GROUP BY 1)"


@query("importance_ranks", "E72", f"""SELECT zone, a.s AS s_a, CAST(a.rk AS INTEGER) AS rank_a, b.s AS s_b, CAST(b.rk AS INTEGER) AS rank_b FROM ({IMP.format(g='A')}) a FULL JOIN ({IMP.format(g='R')}) b USING (zone) WHERE a.rk <= 10 OR b.rk <= 10""")
def _(t: Tables):
    score = lambda g: t.cases.where(F.col("grp") == g).groupBy("zone").agg(F.round(F.avg("x"), 6).alias("s"))
    return compare.importance_compare(score("A"), score("R"), "zone", "s")


@query("group_change_table", "E36 E38", f"""SELECT grp, {rd("sum(w) FILTER (status='F')/sum(w)")} AS F, {rd("sum(w) FILTER (status='O')/sum(w)")} AS O FROM cases GROUP BY 1""")
def _(t: Tables):
    return rounded(compare.crosstab(t.cases, "grp", "status", "w", ["F", "O"]).fillna(0.0), "F", "O")


@query("type_time_profile", "E37", f"""SELECT k.kind, f.b AS time_seq, {rd('coalesce(s.share, 0)')} AS share FROM (SELECT DISTINCT kind FROM stops) k CROSS JOIN (SELECT CAST(unnest(range(1, 49)) AS INTEGER) AS b) f
    LEFT JOIN (SELECT kind, time_seq, sum(wt_total)/sum(sum(wt_total)) OVER (PARTITION BY kind) AS share FROM bins GROUP BY 1, 2) s ON s.kind = k.kind AND s.time_seq = f.b""")
def _(t: Tables):
    return rounded(compare.type_tempo(t.bins, "kind", "wt_total"), "share")


@query("type_stats", "E75", stats_sql("person", "kind, sim", "ice", "w"),
       person="SELECT uid, event_type AS kind, 1 AS sim, 1 + uid%5 AS w, median(value) AS ice FROM (SELECT *, user_id AS uid FROM events) GROUP BY ALL")
def _(t: Tables):
    s = t.stops.select("uid", "kind", F.lit(1).alias("sim"), (1 + F.col("uid") % 5).alias("w"), F.col("dur").alias("ice"))
    return rounded(compare.type_stats(s, "kind", "ice", "w", ["sim"]), "q25", "q50", "q75", "avg")
