"""Clustering and cluster measures on the user table and on labelled embeddings."""

from pyspark.sql import functions as F

from devicehealth.catalog.aggregates import rounded
from devicehealth.catalog.registry import query
from devicehealth.catalog.tables import SCALED_USERS_SQL, USER_METRICS, USERS_SQL, fleet, table, users
from devicehealth.operators import cluster, density, evaluate, geometry, hierarchy
from devicehealth.operators.models import standardise
from devicehealth.operators.ordering import ordered_position
from devicehealth.plans import fleet as fleet_plan
from devicehealth.session import cut_lineage

FEATURES = [f"e{i}" for i in range(64)]
GROUPED = "cast(user_id as bigint) % 4"
APART = " + ".join(f"(a.{m} - b.{m}) ** 2" for m in USER_METRICS)


def known_users(spark, sf):
    return users(spark, sf).na.drop()


def scaled_users(spark, sf):
    return standardise(known_users(spark, sf), USER_METRICS)


def embedded(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", "label", *[F.col("embedding")[i].cast("double").alias(f) for i, f in enumerate(FEATURES)])


SILHOUETTE_SQL = """e as (select vec_id, label, cast(embedding as double[]) as v from embeddings),
    m as (select a.vec_id, a.label, b.label as other, avg(list_distance(a.v, b.v)) as d from e a join e b on a.vec_id <> b.vec_id group by all),
    ab as (select vec_id, label, max(case when other = label then d end) as a, min(case when other <> label then d end) as b from m group by all),
    s as (select vec_id, label, coalesce((b - a) / nullif(greatest(a, b), 0), 0) as silhouette from ab)"""


@query("c6_silhouette_score", sql=f"with {SILHOUETTE_SQL} select round(avg(silhouette), 8) as silhouette from s")
def c6(spark, sf):
    return rounded(geometry.silhouette_score(embedded(spark, sf), "vec_id", FEATURES, "label"), 8)


@query("c6_silhouette_squared", sql=SILHOUETTE_SQL.join(["with ", " select round(avg(silhouette), 8) as silhouette from s"]).replace(
    "list_distance(a.v, b.v)", "list_distance(a.v, b.v) ** 2"))
def c6_squared(spark, sf):
    return rounded(geometry.silhouette_squared(embedded(spark, sf), FEATURES, "label"), 8)


@query("c7_silhouette_samples", sql=f"with {SILHOUETTE_SQL} select vec_id, label, round(silhouette, 8) as silhouette from s")
def c7(spark, sf):
    return rounded(geometry.silhouette_samples(embedded(spark, sf), "vec_id", FEATURES, "label"), 8)


@query("w8_ordered_silhouettes", sql=f"""with {SILHOUETTE_SQL}, r as (select vec_id, label, round(silhouette, 8) as silhouette from s)
    select vec_id, label, silhouette, cast(row_number() over (partition by label order by silhouette, vec_id) as bigint) as position from r""")
def w8_silhouettes(spark, sf):
    # The cuts of the order, the pieces and their rows each read the silhouettes, which are worked out once.
    return ordered_position(cut_lineage(c7(spark, sf)), "silhouette", ["label"], ["vec_id"])


@query("c8_davies_bouldin", sql=f"""with {USERS_SQL}, p as (select *, {GROUPED} as g from users where {' and '.join(f'{m} is not null' for m in USER_METRICS)}),
    c as (select g, {', '.join(f'avg({m}) as {m}' for m in USER_METRICS)} from p group by g),
    s as (select a.g, avg(sqrt({APART})) as s from p a join c b using (g) group by a.g),
    r as (select a.g, max((sa.s + sb.s) / sqrt({APART})) as r from c a join c b on a.g <> b.g join s sa on sa.g = a.g join s sb on sb.g = b.g group by a.g)
    select round(avg(r), 6) as davies_bouldin from r""")
def c8(spark, sf):
    grouped = known_users(spark, sf).withColumn("g", F.col("user_id") % 4)
    return rounded(geometry.davies_bouldin(grouped, USER_METRICS, "g"))


@query("m3_standardise", sql=f"with {SCALED_USERS_SQL} select user_id, {', '.join(f'round({m}, 6) as {m}' for m in USER_METRICS)} from scaled")
def m3(spark, sf):
    return rounded(scaled_users(spark, sf))


@query("c3_dbscan", sql=f"""with recursive {SCALED_USERS_SQL}, p as (select * from scaled),
    pairs as (select a.user_id as i, b.user_id as j from p a join p b on sqrt({APART}) <= 1.5),
    core as (select i from pairs group by i having count(*) >= 10),
    ce as (select i, j from pairs where i in (select i from core) and j in (select i from core)),
    reach as (select i, i as j from core union select r.i, ce.j from reach r join ce on r.j = ce.i),
    comp as (select i, min(j) as c from reach group by i),
    numbered as (select c, row_number() over (order by c) - 1 as n from (select distinct c from comp)),
    border as (select pairs.i, min(c) as c from pairs join comp on pairs.j = comp.i where pairs.i not in (select i from core) group by pairs.i)
    select p.user_id, cast(coalesce(n, -1) as bigint) as cluster, p.user_id in (select i from core) as is_core from p
      left join (select * from comp union all select * from border) x on p.user_id = x.i left join numbered using (c)""")
def c3(spark, sf):
    return density.dbscan(scaled_users(spark, sf), "user_id", USER_METRICS)


@query("c10_worst_cluster", sql=f"""with {USERS_SQL}, p as (select user_id, error, {GROUPED} as cluster from users where {' and '.join(f'{m} is not null' for m in USER_METRICS)}),
    w as (select cluster, avg(error) as cluster_mean from p group by cluster order by cluster_mean desc, cluster limit 1)
    select cluster, round(cluster_mean, 6) as cluster_mean, user_id, round(error, 6) as error, cast(row_number() over (order by error desc, user_id) as integer) as rank
    from p join w using (cluster) qualify rank <= 5""")
def c10(spark, sf):
    grouped = known_users(spark, sf).withColumn("cluster", F.col("user_id") % 4)
    return rounded(cluster.worst_cluster(grouped, "user_id", "error"))


@query("c1_kmeans")
def c1(spark, sf):
    return cluster.kmeans(scaled_users(spark, sf), USER_METRICS, 4)[0]


@query("c1_kmeans_profile")
def c1_profile(spark, sf):
    labelled, _ = cluster.kmeans(scaled_users(spark, sf), USER_METRICS, 5)
    return labelled.groupBy("cluster").agg(F.count("*").alias("size"), *[F.avg(m).alias(f"{m}_mean") for m in USER_METRICS])


@query("c2_sweep_k")
def c2(spark, sf):
    return cluster.sweep_k(scaled_users(spark, sf), "user_id", USER_METRICS, range(2, 11))


@query("c2_best_k")
def c2_best(spark, sf):
    return cluster.best_k(cluster.sweep_k(scaled_users(spark, sf), "user_id", USER_METRICS, range(2, 16)))


@query("c4_divisive")
def c4(spark, sf):
    return cluster.divisive(scaled_users(spark, sf), USER_METRICS, 4)


# The cheapest pair of all is merged again and again; a cluster carries its size, centre and members.
WARD_SQL = f"""with recursive {SCALED_USERS_SQL},
    merging as (
      select count(*) as k, list({{'i': user_id, 'n': 1::double, 'v': [{', '.join(USER_METRICS)}], 'm': [user_id]}} order by user_id) as cs from scaled
      union all
      select k - 1, list_append(list_filter(cs, lambda c: c.i <> p.a.i and c.i <> p.b.i), {{'i': p.a.i, 'n': p.a.n + p.b.n,
        'v': list_transform(list_zip(p.a.v, p.b.v), lambda z: (p.a.n * z[1] + p.b.n * z[2]) / (p.a.n + p.b.n)), 'm': list_concat(p.a.m, p.b.m)}})
      from (select k, cs, (select arg_min({{'a': x.c, 'b': y.c}}, x.c.n * y.c.n / (x.c.n + y.c.n) * list_distance(x.c.v, y.c.v) ** 2)
          from (select unnest(cs) as c) x, (select unnest(cs) as c) y where x.c.i < y.c.i) as p from merging where k > 4)),
    found as (select unnest(cs) as c from merging where k = 4),
    numbered as (select cast(row_number() over (order by c.i) - 1 as integer) as cluster, c.m as m from found)"""


@query("c4_ward", sql=f"{WARD_SQL} select unnest(m) as user_id, cluster from numbered")
def c4_ward(spark, sf):
    return hierarchy.ward(scaled_users(spark, sf), "user_id", USER_METRICS, 4).select("user_id", "cluster")


@query("c5_gaussian_mixture")
def c5(spark, sf):
    labelled, bic = cluster.gaussian_mixture(scaled_users(spark, sf), USER_METRICS, 4)
    return labelled.withColumn("bic", F.lit(bic))


@query("c9_method_comparison")
def c9(spark, sf):
    scaled = scaled_users(spark, sf).persist()
    methods = {
        "K-Means (k=4)": cluster.kmeans(scaled, USER_METRICS, 4)[0],
        "Divisive": cluster.divisive(scaled, USER_METRICS, 4),
        "Ward": hierarchy.ward(scaled, "user_id", USER_METRICS, 4),
        "GMM": cluster.gaussian_mixture(scaled, USER_METRICS, 4)[0],
    }
    return cluster.compare_methods(USER_METRICS, methods)


@query("c9_recommended_method")
def c9_best(spark, sf):
    return evaluate.best_of(c9(spark, sf), "method", "silhouette")


@query("c10_extreme_hosts_of_fleet")
def c10_fleet(spark, sf):
    return fleet_plan.extreme_hosts_of(fleet(spark, sf))


@query("c9_fleet_cluster_report")
def c9_fleet(spark, sf):
    return fleet_plan.cluster_report(fleet(spark, sf))
