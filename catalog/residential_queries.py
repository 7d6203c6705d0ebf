"""Residential segregation and population grids."""

from pyspark.sql import functions as F

from catalog.fixtures import Tables, rd, rounded
from catalog.place_queries import ice_sql
from catalog.registry import query
from copresence.operators import cleaning, grids, residential

QUARTERS = ["q1", "q2", "q3", "q4"]
EVEN0 = "4/6.0e0*(abs(q1*1.0e0/pop-0.25e0)+abs(q2*1.0e0/pop-0.25e0)+abs(q3*1.0e0/pop-0.25e0)+abs(q4*1.0e0/pop-0.25e0))"
NAT = "(SELECT sum(pop)*1.0e0 AS P, sum(birth_se)*1.0e0 AS A, sum(birth_other)*1.0e0 AS B, sum(q1)*1.0e0 AS Q FROM zones)"


@query("income_evenness", "E19", f"SELECT deso, {rd(EVEN0)} AS evenness FROM zones")
def _(t: Tables):
    return rounded(residential.evenness_table(t.zones, "deso", QUARTERS), "evenness")


@query("dissimilarity_terms", "E20", f"SELECT deso, {rd('abs(birth_se/A - birth_other/B)')} AS evenness FROM zones, {NAT}")
def _(t: Tables):
    return rounded(residential.dissimilarity_table(t.zones, "deso", "birth_se", "birth_other", "pop"), "evenness")


@query("isolation_terms", "E21", f"""SELECT deso, {rd('pow(q1*1.0e0/pop, 2)*pop/Q')} AS iso, {rd('pow(1-birth_se*1.0e0/pop, 2)*pop/B')} AS iso_birth FROM zones, {NAT}""")
def _(t: Tables):
    a = residential.isolation_table(t.zones, "deso", "q1", "pop", "q1")
    b = residential.isolation_table(t.zones, "deso", "birth_se", "pop", "birth_other", reverse=True).withColumnRenamed("iso", "iso_birth")
    return rounded(a.join(b, "deso"), "iso", "iso_birth")


ICE_ADJ = ice_sql("birth_se", "birth_other", "pop", "(A/P)", "(B/P)")


@query("zone_ice", "E22", f"SELECT deso, {rd(ICE_ADJ)} AS ice, {rd('(birth_se-birth_other)*1.0e0/pop')} AS ice_raw FROM zones, {NAT}")
def _(t: Tables):
    adj = residential.ice_table(t.zones, "deso", "birth_se", "birth_other", "pop")
    raw = residential.ice_table(t.zones, "deso", "birth_se", "birth_other", "pop", adjusted=False).withColumnRenamed("ice", "ice_raw")
    return rounded(adj.join(raw, "deso"), "ice", "ice_raw")


@query("regional_ice", "E23", f"""SELECT CAST(region AS INTEGER) AS region, {rd(ice_sql('a', 'b', 'p', '(A2/P2)', '(B2/P2)'))} AS ice FROM (
    SELECT deso%5 AS region, sum(birth_se)*1.0e0 AS a, sum(birth_other)*1.0e0 AS b, sum(pop)*1.0e0 AS p FROM zones GROUP BY 1),
    (SELECT sum(pop)*1.0e0 AS P2, sum(birth_se)*1.0e0 AS A2, sum(birth_other)*1.0e0 AS B2 FROM zones)""")
def _(t: Tables):
    return rounded(residential.ice_region(t.zones, F.col("deso") % 5, "birth_se", "birth_other", "pop"), "ice")


@query("residential_segregation", "E24 U1 D3", f"""SELECT deso, 'income' AS var, {rd(EVEN0)} AS evenness, {rd('pow(q1*1.0e0/pop, 2)*pop/Q')} AS iso,
    {rd('(q4-q1)*1.0e0/pop')} AS ice FROM zones, {NAT} UNION ALL SELECT deso, 'birth_region', {rd('abs(birth_se/A - birth_other/B)')},
    {rd('pow(1-birth_se*1.0e0/pop, 2)*pop/B')}, {rd(ICE_ADJ)} FROM zones, {NAT}""")
def _(t: Tables):
    out = residential.residential(t.zones, "deso", QUARTERS, "pop", "birth_se", "birth_other")
    return rounded(out, "evenness", "iso", "ice")


@query("zone_shares", "B19 B20", f"""SELECT z.deso, {rd('birth_se*1.0e0/pop')} AS birth_se, {rd('birth_other*1.0e0/pop')} AS birth_other,
    {rd('cars*1.0e0/pop')} AS car_ownership FROM zones z JOIN (SELECT c_nationkey AS deso, count(*) FILTER (c_acctbal > 4500) AS cars FROM customer GROUP BY 1) c USING (deso)""")
def _(t: Tables):
    cars = t.read("customer").groupBy(F.col("c_nationkey").alias("deso")).agg(F.count(F.when(F.col("c_acctbal") > 4500, 1)).alias("cars"))
    shares = cleaning.to_shares(t.zones, ["birth_se", "birth_other"], "pop").select("deso", "birth_se", "birth_other")
    return rounded(shares.join(grids.car_ownership(cars, t.zones, "deso", "cars", "pop"), "deso"), "birth_se", "birth_other", "car_ownership")


# cells: customers on small squares, suppliers on large ones; ids below 4 are given in both sizes
CELLS = """SELECT CAST(c_custkey%64 AS INTEGER) AS cell, 250 AS size, count(*) AS pop, CAST(count(*) FILTER (c_acctbal > 4500) AS BIGINT) AS rich, avg(c_acctbal) AS inc FROM customer GROUP BY 1
    UNION ALL SELECT CAST(s_suppkey%4 AS INTEGER), 1000, count(*), CAST(count(*) FILTER (s_acctbal > 4500) AS BIGINT), avg(s_acctbal) FROM supplier GROUP BY 1"""


def cells(t: Tables):
    def side(table, key, bal, n, size):
        return t.read(table).groupBy((F.col(key) % n).cast("int").alias("cell")).agg(
            F.lit(size).alias("size"), F.count(F.lit(1)).alias("pop"), F.count(F.when(F.col(bal) > 4500, 1)).alias("rich"), F.avg(bal).alias("inc"))
    return side("customer", "c_custkey", "c_acctbal", 64, 250).unionByName(side("supplier", "s_suppkey", "s_acctbal", 4, 1000))


@query("merged_duplicate_cells", "E69 D6 U2", f"""SELECT cell, CAST(max(size) AS INTEGER) AS size, CAST(sum(pop) AS BIGINT) AS pop, CAST(sum(rich) AS BIGINT) AS rich,
    {rd('sum(pop*inc)/sum(pop)')} AS inc FROM cells GROUP BY 1""", cells=CELLS)
def _(t: Tables):
    return rounded(grids.merge_duplicate_cells(cells(t), "cell", "size", ["pop", "rich"], 1000, "inc", "pop"), "inc")


@query("folded_cells", "E70", f"""SELECT id AS cell, CAST(max(size) AS INTEGER) AS size, CAST(sum(pop) AS BIGINT) AS pop, CAST(sum(rich) AS BIGINT) AS rich,
    {rd('sum(pop*inc)/sum(pop)')} AS inc FROM (SELECT *, CASE WHEN size = 1000 THEN concat('L', cell) WHEN cell//8 < 4 THEN concat('L', cell//8) ELSE concat('S', cell) END AS id
    FROM cells) GROUP BY 1""", cells=CELLS)
def _(t: Tables):
    big = F.col("size") == 1000
    # small cells of 4 to 7 have no large one
    host = F.concat(F.lit("L"), F.when(big, F.col("cell")).otherwise(F.floor(F.col("cell") / 8)))
    c = cells(t).withColumn("host", host).withColumn("cell", F.when(big, F.col("host")).otherwise(F.concat(F.lit("S"), F.col("cell"))))
    return rounded(grids.fold_cells(c, "cell", "size", "host", ["pop", "rich"], 1000, "inc", "pop"), "inc")


@query("grid_overlap", "E77", """SELECT count(*) AS total, count(*) FILTER (cell < 4) AS in_large FROM (SELECT DISTINCT CAST(c_custkey%64 AS INTEGER) AS cell FROM customer)""")
def _(t: Tables):
    c = cells(t)
    return grids.grid_overlap(c.where("size = 250"), {"in_large": c.where("size = 1000")}, "cell")


@query("grid_shares", "E77", f"""SELECT {rd('avg(CASE WHEN size = 250 THEN 1 ELSE 0 END)*100')} AS small_cells, {rd('avg(CASE WHEN pop <> 0 THEN 1 ELSE 0 END)*100')} AS nonempty,
    {rd('sum(pop) FILTER (size = 250)*100.0e0/sum(pop)')} AS people_in_small FROM cells""", cells=CELLS)
def _(t: Tables):
    return rounded(grids.grid_shares(cells(t), "size", "pop", 250), "small_cells", "nonempty", "people_in_small")
