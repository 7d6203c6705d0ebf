"""Time bins, indices and place metrics."""

from pyspark.sql import functions as F

from catalog.fixtures import ATTRS, Tables, r6, rd, rounded
from catalog.registry import query
from copresence.functions import time_bins
from copresence.operators import place

SHARES = ("(SELECT sum(birth_se)*1.0e0/sum(pop) FROM zones)", "(SELECT sum(birth_other)*1.0e0/sum(pop) FROM zones)")
EVEN = "4/6.0e0*(abs(q1/nullif(qs,0)-0.25e0)+abs(q2/nullif(qs,0)-0.25e0)+abs(q3/nullif(qs,0)-0.25e0)+abs(q4/nullif(qs,0)-0.25e0))"


def ice_sql(a, b, p, sa, sb):
    return (f"({a}/{sa}-{b}/{sb})/nullif({a}/{sa}+{b}/{sb}+({p}-{a}-{b})/(1-{sa}-{sb}), 0)")


def cells_sql(unit: str) -> str:
    """Sums per place and half hour."""
    return f"""SELECT b.weekday, b.holiday, b.{unit} AS unit, b.time_seq, count(*) AS num_visits, sum(wt_total) AS num_visits_wt,
        count(DISTINCT b.uid) AS num_unique_uid, sum(q1*wt_total) AS q1, sum(q2*wt_total) AS q2, sum(q3*wt_total) AS q3,
        sum(q4*wt_total) AS q4, sum((q1+q2+q3+q4)*wt_total) AS qs, sum(birth_se*wt_total) AS a, sum(birth_other*wt_total) AS o,
        sum(z.pop*wt_total) AS p FROM bins b JOIN homes h ON b.uid = h.uid JOIN zones z ON z.deso = h.deso GROUP BY 1,2,3,4"""


METRICS = f"""SELECT weekday, holiday, unit, time_seq, num_visits, num_visits_wt, num_unique_uid, {EVEN} AS evenness_income,
    {ice_sql('a', 'o', 'p', 'sa', 'sb')} AS ice_birth FROM cells, (SELECT {SHARES[0]} AS sa, {SHARES[1]} AS sb) s"""


def shares(t: Tables):
    """Overall shares of the two extremes, as scalar subqueries over the zone table."""
    total = lambda c: t.zones.select(F.sum(c) / F.sum("pop")).scalar()
    return total("birth_se"), total("birth_other")


def home_counts(t: Tables):
    return t.homes.select("uid", "deso").join(t.zones, "deso").drop("deso")


def metrics(t: Tables, unit: str = "deso", bins=None):
    sa, sb = shares(t)
    return place.zone_indices(t.bins if bins is None else bins, home_counts(t), unit, sa, sb)


@query("zone_halfhour_segregation", "E19 E22 E25", f"""SELECT weekday, holiday, unit AS deso, time_seq, num_visits,
    {rd('num_visits_wt')} AS num_visits_wt, num_unique_uid, {rd('evenness_income')} AS evenness_income, {rd('ice_birth')} AS ice_birth
    FROM metrics""", cells=cells_sql("deso"), metrics=METRICS)
def _(t: Tables):
    return rounded(metrics(t), "num_visits_wt", "evenness_income", "ice_birth")


KNOTS = """SELECT weekday, holiday, deso, time_seq, {a} AS x, wt_total AS w, sum(wt_total) OVER o - wt_total/2 AS k,
    sum(wt_total) OVER g AS tot FROM pb WINDOW g AS (PARTITION BY weekday, holiday, deso, time_seq),
    o AS (PARTITION BY weekday, holiday, deso, time_seq ORDER BY {a}, wt_total ROWS UNBOUNDED PRECEDING)"""


def _median_cte(a: str) -> str:
    return f"""(SELECT weekday, holiday, deso, time_seq, max(CASE WHEN k2 IS NULL AND k <= tot/2 THEN x
        WHEN first AND k >= tot/2 THEN x WHEN k <= tot/2 AND k2 > tot/2 THEN x + (tot/2-k)/(k2-k)*(x2-x) END) AS {a}
        FROM (SELECT *, lead(x) OVER o AS x2, lead(k) OVER o AS k2, row_number() OVER o = 1 AS first FROM ({KNOTS.format(a=a)})
        WINDOW o AS (PARTITION BY weekday, holiday, deso, time_seq ORDER BY x, w, k)) GROUP BY 1,2,3,4)"""


_JOINS = " ".join(f"JOIN {_median_cte(a)} m{i} USING (weekday, holiday, deso, time_seq)" for i, a in enumerate(ATTRS))


@query("zone_visitor_profile", "E25", f"""SELECT weekday, holiday, deso, time_seq, num_visits, num_unique_uid,
    {rd('num_visits_wt')} AS num_visits_wt, {rd('evenness_income')} AS evenness_income, {rd('ice_birth')} AS ice_birth,
    {', '.join(f'{rd(a)} AS {a}' for a in ATTRS)} FROM (SELECT * RENAME (unit AS deso) FROM metrics) q {_JOINS}""",
       cells=cells_sql("deso"), metrics=METRICS,
       pb=f"SELECT b.weekday, b.holiday, b.deso, b.time_seq, b.wt_total, {', '.join(f'p.{a}*1.0e0 AS {a}' for a in ATTRS)} FROM bins b JOIN persons p ON b.uid = p.uid")
def _(t: Tables):
    sa, sb = shares(t)
    out = place.place_metrics(t.bins, t.persons.drop("home_deso"), "deso", ATTRS, sa, sb)
    return rounded(out, "num_visits_wt", "evenness_income", "ice_birth", *ATTRS)


@query("stay_spans", "C12 C13 C14", """SELECT sid, lo, hi, coalesce(whi, 0) AS wrap_hi, hi-lo+1+coalesce(whi,0) AS n_bins FROM spans""")
def _(t: Tables):
    s = t.stops.withColumn("span", time_bins.stay_span(F.col("h_s"), F.col("dur")))
    last = F.element_at("span", -1)
    wrap = F.when(F.size("span") > 1, F.get("span", F.lit(0))["hi"]).otherwise(0)
    return s.select("sid", last["lo"].alias("lo"), last["hi"].alias("hi"), wrap.alias("wrap_hi"),
                    time_bins.span_length(F.col("span")).alias("n_bins"))


@query("person_bins", "C13 K4", "SELECT uid, time_seq, count(*) AS n FROM bins GROUP BY 1, 2")
def _(t: Tables):
    return t.bins.groupBy("uid", "time_seq").agg(F.count(F.lit(1)).alias("n"))


@query("record_weights", "E8", f"SELECT sid, {rd('wt')} AS wt, {rd('wt_total')} AS wt_total FROM visits")
def _(t: Tables):
    return t.visits.select("sid", r6("wt").alias("wt"), r6("wt_total").alias("wt_total"))


@query("zone_model_table", "J20 E33", f"""SELECT unit AS deso, m.weekday, m.holiday, count(*) AS half_hours, {rd('sum(ice_birth*num_visits_wt)/sum(num_visits_wt)')} AS ice_e,
    {rd('any_value(z.birth_se)*1.0e0/any_value(z.pop)')} AS native, any_value(a.cum_jobs) AS cum_jobs, {rd('any_value(a.car_ownership)')} AS car_ownership
    FROM metrics m JOIN zones z ON z.deso = unit JOIN access a ON a.deso = unit GROUP BY 1, 2, 3""", cells=cells_sql("deso"), metrics=METRICS)
def _(t: Tables):
    w = F.col("num_visits_wt")
    per_zone = metrics(t).groupBy("deso", "weekday", "holiday").agg(
        F.count(F.lit(1)).alias("half_hours"), (F.sum(F.col("ice_birth") * w) / F.sum(w)).alias("ice_e"))
    side = t.zones.select("deso", (F.col("birth_se") / F.col("pop")).alias("native")).join(t.access.select("deso", "cum_jobs", "car_ownership"), "deso")
    return rounded(per_zone.join(side, "deso"), "ice_e", "native", "car_ownership")
