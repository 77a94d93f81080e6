"""Graph features, embeddings, pair samples and evaluation on the driver tables."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from tabred import oracle
from tabred.catalog import register
from tabred.functions import tokens as K
from tabred.functions.vectors import cosine
from tabred.operators import embed, evaluate as E, fds, graph as G, pairs as P
from tabred.operators.ranking import exact_quantiles
from tabred.schemas import KEYS, REFERENCE_BY_CODE, TABLE_OF
from tabred.session import stored, written
from tabred.sources.tables import tpch_view

V = oracle.with_views
GRAPH_TYPES = ("O_C", "C_N", "S_N", "N_R")


def node_frame(t, code: str) -> DataFrame:
    return t[TABLE_OF[code]].select(F.concat(F.lit(f"{code}|"), F.col(KEYS[code][0]).cast("string")).alias("id"), F.lit(code).alias("label"))


def tpch_graph(s, d) -> tuple[DataFrame, DataFrame]:
    """Orders, customers, suppliers, nations and regions as nodes and their references as edges."""
    t = tpch_view(s, d)
    nodes = reduce(DataFrame.unionAll, [node_frame(t, c) for c in ("O", "C", "S", "N", "R")])
    edges = []
    for code in GRAPH_TYPES:
        r = REFERENCE_BY_CODE[code]
        edges.append(t[TABLE_OF[r.source]].select(
            F.concat(F.lit(f"{r.source}|"), F.col(KEYS[r.source][0]).cast("string")).alias("src"),
            F.concat(F.lit(f"{r.target}|"), F.col(r.fields[0]).cast("string")).alias("dst"), F.lit(code).alias("type")))
    return nodes, reduce(DataFrame.unionAll, edges)


GRAPH_SQL = {
    "g_nodes": """select 'O|' || o_orderkey as id, 'O' as label from orders union all select 'C|' || c_custkey, 'C' from customer
        union all select 'S|' || s_suppkey, 'S' from supplier union all select 'N|' || n_nationkey, 'N' from nation union all select 'R|' || r_regionkey, 'R' from region""",
    "g_edges": """select 'O|' || o_orderkey as src, 'C|' || o_custkey as dst, 'O_C' as type from orders union all select 'C|' || c_custkey, 'N|' || c_nationkey, 'C_N' from customer
        union all select 'S|' || s_suppkey, 'N|' || s_nationkey, 'S_N' from supplier union all select 'N|' || n_nationkey, 'R|' || n_regionkey, 'N_R' from nation"""}


def g(sql: str) -> str:
    return V(sql, GRAPH_SQL)


register("v8_graph_inventory", lambda s, d: G.graph_inventory(*tpch_graph(s, d)),
         g("select (select count(*) from g_nodes) as nodes, count(*) as edges, string_agg(distinct type, ',' order by type) as types from g_edges"))
register("v9_node_degrees", lambda s, d: G.node_degrees(tpch_graph(s, d)[1], tpch_graph(s, d)[0].where("label in ('C', 'N')")),
         g("""with e as (select src as id, type from g_edges union all select dst, type from g_edges), p as (select id, type, count(*) as n from e
              where id[1] in ('C', 'N') group by 1, 2) select id, cast(sum(n) as bigint) as degree, string_agg(type || ':' || n, ',' order by type) as by_type from p group by 1"""))
register("j12_key_lookup", lambda s, d: G.lookup(tpch_view(s, d)["orders"].select("o_orderkey", "o_custkey"), tpch_view(s, d)["customer"].where("c_mktsegment = 'BUILDING'")
                                                  .select(F.col("c_custkey").alias("key")), "o_custkey"),
         "select o_orderkey, o_custkey from orders where o_custkey in (select c_custkey from customer where c_mktsegment = 'BUILDING')")
register("j13_one_hop", lambda s, d: G.one_hop(*tpch_graph(s, d), tpch_graph(s, d)[0].where("label = 'C'"), "C"),
         g("select dst as id from g_edges where src[1] = 'C' and dst[1] <> 'C' union select src from g_edges where dst[1] = 'C' and src[1] <> 'C'"))
register("j14_induced_edges", lambda s, d: G.induced_edges(tpch_graph(s, d)[1], tpch_graph(s, d)[0].where("label in ('C', 'N', 'S')"), exclude=["N_R"]),
         g("select src, dst, type from g_edges where src[1] in ('C', 'N', 'S') and dst[1] in ('C', 'N', 'S') and type <> 'N_R'"))
register("j15_undirected_pairs", lambda s, d: G.undirected_pairs(s.read.parquet(f"{d}/lineitem.parquet").select(
    F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"), F.lit("L").alias("type")), ["L"]),
         "select distinct least(l_partkey, l_suppkey) as a, greatest(l_partkey, l_suppkey) as b from lineitem where l_partkey <> l_suppkey")
register("g1_projection", lambda s, d: G.project(tpch_graph(s, d)[1], ["C_N", "S_N"]).groupBy("src").agg(F.count(F.lit(1)).alias("neighbours")),
         g("""select src, count(*) as neighbours from (select src, dst from g_edges where type in ('C_N', 'S_N') union all select dst, src from g_edges where type in ('C_N', 'S_N')) group by 1"""))

# -- hashed features -----------------------------------------------------------------------------------
_own, _moved = ["c_mktsegment", "c_acctbal"], ["c_nationkey", "n_name"]


def customers(s, d):
    t = tpch_view(s, d)
    return (t["customer"].join(t["nation"], F.col("c_nationkey") == F.col("n_nationkey"))
            .select(F.concat(F.lit("C|"), F.col("c_custkey").cast("string")).alias("id"), "c_custkey", "c_mktsegment", F.col("c_acctbal").cast("int").alias("c_acctbal"),
                    "c_nationkey", "n_name"))


CUSTOMERS_SQL = """select 'C|' || c_custkey as id, c_custkey, c_mktsegment, cast(trunc(c_acctbal) as int) as c_acctbal, c_nationkey, n_name
    from customer join nation on c_nationkey = n_nationkey"""


def long_form(df, *names):
    """Non-zero entries of vectors as rows: [id, kind, slot, value]."""
    parts = [df.select("id", F.lit(n).alias("kind"), F.posexplode(n).alias("slot", "value")).where("value <> 0") for n in names]
    return reduce(DataFrame.unionAll, parts).withColumn("value", F.round("value", 6))


def vector_sql(source: str, parts: list[tuple[str, list[str]]], kind: str) -> str:
    fields = [(ns, c) for ns, cols in parts for c in sorted(cols)]
    tok = " union all ".join(
        f"""select id, '{ns}.{c}=' || v as tok from (select id, lower(trim(cast({c} as varchar))) as v from src)
            union all select id, '{ns}.{c}:word=' || unnest(regexp_extract_all(v, '\\w+')) from (select id, lower(trim(cast({c} as varchar))) as v from src)""" for ns, c in fields)
    return f"""with src as ({source}), tok as ({tok}), hit as (select id, ('0x' || substr(md5(tok), 1, 8))::bigint % 128 as slot,
        sum(case when substr(md5(tok), 9, 1) in ('1', '3', '5', '7', '9', 'b', 'd', 'f') then 1.0 else -1.0 end) as v from tok group by 1, 2)
        select id, '{kind}' as kind, cast(slot as int) as slot, round(cast(v as double) / sqrt(cast(sum(v * v) over (partition by id) as double)), 6) as value from hit qualify v <> 0"""


register("g2_hashed_features", lambda s, d: long_form(K.hash_features(customers(s, d), "id", [("Customer", _own + _moved)]), "features"),
         V(vector_sql(CUSTOMERS_SQL, [("Customer", _own + _moved)], "features")))
register("g2_hashed_features_blake", lambda s, d: K.hash_features(customers(s, d), "id", [("Customer", _own + _moved)], blake=True))
register("g3_feature_variants", lambda s, d: long_form(G.fd_feature_variants(customers(s, d), "id", "Customer", "nation_fd", _own, _moved), "denormalised", "normalised"),
         V(f"select * from ({vector_sql(CUSTOMERS_SQL, [('Customer', _own), ('nation_fd', _moved)], 'denormalised')}) union all "
           f"select * from ({vector_sql(CUSTOMERS_SQL, [('Customer', _own)], 'normalised')})"))
register("g4_attach_dimension_nodes", lambda s, d: G.attach_dimension(customers(s, d), "id", "c_nationkey", ["n_name"], "DIM_NATION", "HAS_NATION")[0],
         "select distinct 'DIM_NATION|' || c_nationkey as id, 'DIM_NATION' as label, c_nationkey, n_name from customer join nation on c_nationkey = n_nationkey")
register("g4_attach_dimension_edges", lambda s, d: G.attach_dimension(customers(s, d), "id", "c_nationkey", ["n_name"], "DIM_NATION", "HAS_NATION")[1],
         "select 'C|' || c_custkey as src, 'DIM_NATION|' || c_nationkey as dst, 'HAS_NATION' as type from customer")
register("g5_random_hub_sizes", lambda s, d: G.random_hubs(customers(s, d), "id", "c_nationkey", 5).groupBy(F.col("dst").alias("hub")).agg(
    F.count(F.lit(1)).alias("members"), F.countDistinct("src").alias("distinct_members")),
         "select c_nationkey as hub, count(*) as members, count(*) as distinct_members from customer group by 1")
register("g6_self_loops", lambda s, d: G.self_loops(customers(s, d)), "select 'C|' || c_custkey as src, 'C|' || c_custkey as dst, 'SELF' as type from customer")
register("g14_updated_dimension_features",
         lambda s, d: long_form(K.hash_features(tpch_view(s, d)["nation"].where("n_regionkey = 1").select(F.concat(F.lit("N|"), F.col("n_nationkey").cast("string")).alias("id"), "n_nationkey", K.correct("n_name").alias("n_name")),
                                                "id", [("nation_fd", ["n_nationkey", "n_name"])]), "features"),
         V(vector_sql("select 'N|' || n_nationkey as id, n_nationkey, n_name || ' [corrected]' as n_name from nation where n_regionkey = 1", [("nation_fd", ["n_nationkey", "n_name"])], "features")))


# -- embeddings ------------------------------------------------------------------------------------------
def feature_links(s, d) -> DataFrame:
    """Undirected adjacency of customers, suppliers, nations and regions."""
    return G.project(tpch_graph(s, d)[1], ["C_N", "S_N", "N_R"])


def feature_graph(s, d) -> tuple[DataFrame, DataFrame]:
    """Customers, suppliers, nations and regions with hashed features, and their undirected adjacency."""
    def build():
        t = tpch_view(s, d)
        parts = [(("C", "customer"), ["c_mktsegment", "c_acctbal"]), (("S", "supplier"), ["s_acctbal", "s_name"]),
                 (("N", "nation"), ["n_name"]), (("R", "region"), ["r_name"])]
        return reduce(DataFrame.unionAll, [
            K.hash_features(t[name].withColumn("id", F.concat(F.lit(f"{code}|"), F.col(KEYS[code][0]).cast("string"))), "id", [(name, cols)])
            for (code, name), cols in parts])
    nodes = stored(s, "feature_nodes", d, build)
    return nodes, feature_links(s, d)


def embedded(s, d, method: str) -> DataFrame:
    make = {"fast_rp": lambda: embed.fast_rp(*feature_graph(s, d)), "hash_gnn": lambda: embed.hash_gnn(*feature_graph(s, d)),
            "mean_aggregate": lambda: embed.mean_aggregate(*feature_graph(s, d)), "node2vec": lambda: embed.node2vec(feature_links(s, d))}[method]
    return stored(s, f"vectors_{method}", d, make)


register("g7_fast_rp", lambda s, d: embedded(s, d, "fast_rp"))
register("g8_node2vec", lambda s, d: embedded(s, d, "node2vec"))


def closer_to_own(s, d, method):
    """Whether customers lie nearer to their own nation's vector than to the others', on average."""
    own = tpch_view(s, d)["customer"].select(F.concat(F.lit("C|"), F.col("c_custkey").cast("string")).alias("id"), F.concat(F.lit("N|"), F.col("c_nationkey").cast("string")).alias("group"))
    return E.group_cosines(own, embedded(s, d, method), K.DIMENSION).select((F.col("own") > F.col("other") + 0.1).alias("closer"))


register("g8_neighbours_closer", lambda s, d: closer_to_own(s, d, "node2vec"), "select count(*) > 0 as closer from customer")
register("g8_random_walks", lambda s, d: embed.random_walks(feature_links(s, d)).select("walk", F.size("path").alias("nodes")),
         g("""with walks as (select distinct src || '#' || k as walk from (select src from g_edges where type <> 'O_C' union select dst from g_edges where type <> 'O_C'),
              (values (1), (2), (3), (4), (5)) x(k)) select walk, 20 as nodes from walks"""))
register("g9_hash_gnn", lambda s, d: embedded(s, d, "hash_gnn"))
register("g10_mean_aggregate", lambda s, d: embedded(s, d, "mean_aggregate"))
register("g11_check_vectors", lambda s, d: G.check_vectors(s.read.parquet(f"{d}/embeddings.parquet").where("label <> 3").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec")),
                                                            s.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("id")), 64),
         "select vec_id as id, 'missing' as problem from embeddings where label = 3")
register("g12_receptive_field", lambda s, d: G.receptive_field(G.project(tpch_graph(s, d)[1]), tpch_graph(s, d)[0].where("id in ('C|1', 'C|7', 'S|3')")),
         g("""with recursive adj as (select src, dst from g_edges union select dst, src from g_edges), r(id, h) as (select id, 0 from (values ('C|1'), ('C|7'), ('S|3')) v(id)
              union select adj.dst, h + 1 from r join adj on adj.src = r.id where h < 3), m as (select id, min(h) as h from r group by 1)
              select k as hops, count(*) as nodes from m, (values (1), (2), (3)) x(k) where h <= k group by 1"""))


def pair_score(s, d):
    same = written(P.same_pairs(customers(s, d), "c_nationkey", "id", 100, 3))

    def score(vectors):
        return exact_quantiles(E.score_pairs(same, vectors, vectors), [], {"score": ("score_d", 0.5)})
    return score


register("g13_parameter_sweep", lambda s, d: embed.sweep(*feature_graph(s, d), pair_score(s, d), ratios=[0.0, 0.5], influences=[0.5, 2.0], rounds=[2], seeds=[1]))


# -- pairs -----------------------------------------------------------------------------------------------
def vectors(s, d):
    return s.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("label").alias("group"), F.col("embedding").cast("array<double>").alias("vec"))


SAME_SQL = """with m as (select {key} as k, {row} as id, row_number() over (partition by {key} order by md5('{seed}:' || {row}), {row}) as pos,
    count(*) over (partition by {key}) as n from {table}), g as (select count(distinct k) as groups from m where n >= 2),
    p as (select k, (pos + 1) // 2 as pair, min_by(id, pos) as a, max_by(id, pos) as b from m, g where n >= 2 and pos <= 2 * ceil({n} / groups) group by 1, 2 having count(*) = 2)
    select k as {key}, a, b from p order by md5('{seed}:pair:' || a || ':' || b) limit {n}"""
register("w6_sample_per_group", lambda s, d: P.sample_per_group(tpch_view(s, d)["customer"].select("c_nationkey", "c_custkey"), "c_nationkey", "c_custkey", 5, 9),
         """select c_nationkey, c_custkey, position from (select c_nationkey, c_custkey, row_number() over (partition by c_nationkey order by md5('9:' || c_custkey)) as position from customer)
            where position <= 5""")
register("e1_same_pairs", lambda s, d: P.same_pairs(tpch_view(s, d)["customer"], "c_nationkey", "c_custkey", 200, 3),
         SAME_SQL.format(key="c_nationkey", row="c_custkey", table="customer", seed=3, n=200))
register("e2_child_pairs", lambda s, d: P.child_pairs(tpch_view(s, d)["orders"], "o_custkey", "o_orderkey", 500, 4))
register("e2_child_pairs_valid",
         lambda s, d: P.child_pairs(tpch_view(s, d)["orders"], "o_custkey", "o_orderkey", 500, 4).alias("p")
         .join(tpch_view(s, d)["orders"].select(F.col("o_orderkey").alias("ka"), F.col("o_custkey").alias("ca")), F.col("a") == F.col("ka"))
         .join(tpch_view(s, d)["orders"].select(F.col("o_orderkey").alias("kb"), F.col("o_custkey").alias("cb")), F.col("b") == F.col("kb"))
         .agg(F.count(F.when((F.col("ca") == F.col("cb")) & (F.col("a") < F.col("b")), 1)).alias("valid"), F.count_distinct("a", "b").alias("distinct_pairs")),
         "select cast(500 as bigint) as valid, cast(500 as bigint) as distinct_pairs from orders limit 1")
register("e3_group_pairs", lambda s, d: P.group_pairs(tpch_view(s, d)["orders"], "o_custkey", "o_orderkey", 100, 6),
         """with g as (select o_custkey from orders group by 1 having count(*) >= 2 order by md5('6:group:' || o_custkey) limit 100),
            m as (select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by md5('6:' || o_orderkey)) as pos from orders where o_custkey in (select o_custkey from g))
            select o_custkey, min_by(o_orderkey, pos) as a, max_by(o_orderkey, pos) as b from m where pos <= 2 group by 1""")


def different(s, d):
    same = P.same_pairs(tpch_view(s, d)["customer"], "c_nationkey", "c_custkey", 200, 3)
    return P.different_pairs(same, "c_nationkey", 200, 3)


register("e4_different_pairs", different)
register("e4_different_pairs_valid", lambda s, d: different(s, d).agg(F.count(F.when(F.col("group_a") != F.col("group_b"), 1)).alias("valid"), F.count_distinct("a", "b").alias("distinct_pairs")),
         "select cast(200 as bigint) as valid, cast(200 as bigint) as distinct_pairs from customer limit 1")


def drawn_blocks(s, d):
    blocks = P.pair_blocks(tpch_view(s, d)["orders"], "o_custkey")
    total = blocks.agg(F.sum("size").alias("t")).scalar()
    return P.locate(P.draws(blocks, total, 300, 8), blocks, total, 300).agg(
        F.count(F.lit(1)).alias("drawn"), F.count(F.when((F.col("offset") >= 0) & (F.col("offset") < F.col("size")), 1)).alias("inside"))


register("w7_unrank_draws", drawn_blocks, "select cast(300 as bigint) as drawn, cast(300 as bigint) as inside from orders limit 1")
register("w7_pair_blocks", lambda s, d: P.pair_blocks(tpch_view(s, d)["orders"], "o_custkey"),
         """with b as (select o_custkey, count(*) as n, count(*) * (count(*) - 1) // 2 as size from orders group by 1 having count(*) >= 2)
            select o_custkey, n, cast(size as bigint) as size, cast(coalesce(sum(size) over (order by ('0x' || substr(md5(o_custkey::varchar), 1, 15))::bigint
            rows between unbounded preceding and 1 preceding), 0) as bigint) as start from b""")
register("e5_pair_population", lambda s, d: P.pair_population(tpch_view(s, d)["orders"], "o_custkey"),
         """select cast(sum(n * (n - 1) / 2) as double) as same_pairs, cast((sum(n) * sum(n) - sum(n * n)) / 2 as double) as different_pairs
            from (select count(*) as n from orders group by o_custkey)""")
register("e17_pool", lambda s, d: P.pool(P.same_pairs(tpch_view(s, d)["customer"], "c_nationkey", "c_custkey", 200, 3), "c_nationkey"),
         f"""select distinct unnest([a, b]) as id, c_nationkey as "group" from ({SAME_SQL.format(key="c_nationkey", row="c_custkey", table="customer", seed=3, n=200)})""")

# -- scores ----------------------------------------------------------------------------------------------
PAIRS_SQL = SAME_SQL.format(key="label", row="vec_id", table="embeddings", seed=2, n=100)
COS = "list_sum(list_transform(list_zip({a}::double[], {b}::double[]), lambda x: x[1] * x[2])) / sqrt(list_sum(list_transform({a}::double[], lambda x: x * x)) * list_sum(list_transform({b}::double[], lambda x: x * x)))"


def label_pairs(s, d):
    return P.same_pairs(vectors(s, d).withColumnRenamed("group", "label").withColumnRenamed("id", "vec_id"), "label", "vec_id", 100, 2)


def half(v):
    """A second representation: the first half of the vector."""
    return v.withColumn("vec", F.slice("vec", 1, 32))


_cos = COS.format(a="x.embedding", b="y.embedding")
_cos_half = COS.format(a="x.embedding[1:32]", b="y.embedding[1:32]")
SCORES_SQL = f"""with p as ({PAIRS_SQL}) select label, a, b, round({_cos}, 6) as score_d, round({_cos_half}, 6) as score_n
    from p join embeddings x on x.vec_id = a join embeddings y on y.vec_id = b"""
register("e6_cosine", lambda s, d: E.score_pairs(label_pairs(s, d), vectors(s, d), vectors(s, d)).select("a", "b", F.round("score_d", 6).alias("cosine")),
         f"select a, b, score_d as cosine from ({SCORES_SQL.replace('x.label', 'label')})".replace("select label, a, b", "select a, b").replace("with p as", "with p as"))
register("e7_score_pairs", lambda s, d: E.score_pairs(label_pairs(s, d), vectors(s, d), half(vectors(s, d))).select("a", "b", F.round("score_d", 6).alias("score_d"), F.round("score_n", 6).alias("score_n")),
         f"select a, b, score_d, score_n from ({SCORES_SQL.replace('select label, a, b', 'select p.label, a, b')})")
register("e8_summarise_scores", lambda s, d: E.summarise(E.score_pairs(label_pairs(s, d), vectors(s, d), half(vectors(s, d))).withColumn("score_d", F.round("score_d", 6)), ["label"], "score_d")
         .select("label", *[F.round(c, 4).alias(c) for c in ("median", "mean", "sd", "q1", "q3", "low", "high")]),
         f"""select label, round(quantile_cont(score_d, 0.5), 4) as median, round(avg(score_d), 4) as mean, round(stddev_samp(score_d), 4) as sd, round(quantile_cont(score_d, 0.25), 4) as q1,
             round(quantile_cont(score_d, 0.75), 4) as q3, round(min(score_d), 4) as low, round(max(score_d), 4) as high
             from ({SCORES_SQL.replace('select label, a, b', 'select p.label as label, a, b')}) group by 1""")


def labelled(s, d):
    return s.read.parquet(f"{d}/labels.parquet").join(s.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang", "n_chars"), "doc_id")


AUC_SQL = """with j as (select lang, n_chars, quality from labels join documents using (doc_id)),
    r as (select *, rank() over (partition by lang order by n_chars) + (count(*) over (partition by lang, n_chars) - 1) / 2.0 as r from j)
    select lang, (sum(r) filter (quality = 1) - count(*) filter (quality = 1) * (count(*) filter (quality = 1) + 1) / 2.0)
    / nullif(count(*) filter (quality = 1) * count(*) filter (quality = 0), 0) as auc from r group by 1"""
register("e9_auc", lambda s, d: E.auc(labelled(s, d), ["lang"], "n_chars", F.col("quality") == 1).select("lang", F.round("auc", 9).alias("auc")),
         f"select lang, round(auc, 9) as auc from ({AUC_SQL})")


def pool_vectors(s, d):
    return P.pool(label_pairs(s, d), "label").join(vectors(s, d).select("id", "vec"), "id")


register("e10_retrieval", lambda s, d: E.retrieval_metrics(pool_vectors(s, d)).select(*[F.round(m, 6).alias(m) for m in ("r_precision", "map", "mrr", "p_at_5", "lift")], "queries", "pool"),
         f"""with pl as (select distinct unnest([a, b]) as id, label as grp from ({PAIRS_SQL})), v as (select id, grp, embedding from pl join embeddings on vec_id = id),
             sc as (select x.id as q, y.id as c, x.grp = y.grp as hit, {_cos} as s from v x join v y on x.id <> y.id),
             rk as (select q, hit, row_number() over (partition by q order by s desc) as r, sum(hit::int) over (partition by q) as rel, count(*) over (partition by q) as n from sc),
             cu as (select *, sum(hit::int) over (partition by q order by r) as cum from rk where rel > 0),
             per as (select q, avg(hit::int) filter (r <= rel) as rp, avg(cum / r) filter (hit) as ap, max(1.0 / r) filter (hit) as rr, avg(hit::int) filter (r <= 5) as p5,
                     any_value(rel) as rel, any_value(n) as n from cu group by 1)
             select round(avg(rp), 6) as r_precision, round(avg(ap), 6) as map, round(avg(rr), 6) as mrr, round(avg(p5), 6) as p_at_5, round(avg(rp / (rel / n)), 6) as lift,
             count(*) as queries, (select count(*) from v) as pool from per""")
register("e11_drift", lambda s, d: E.drift(vectors(s, d), vectors(s, d).withColumn("vec", F.when(F.col("group") < 3, F.reverse("vec")).otherwise(F.col("vec"))), vectors(s, d).where(F.col("group") < 3))
         .select(F.round("inside", 6).alias("inside"), F.round("outside", 6).alias("outside")),
         f"""select round(avg(1 - {COS.format(a='embedding', b='list_reverse(embedding)')}) filter (label < 3), 6) as inside, cast(0 as double) as outside from embeddings""")
register("e12_within_group_similarity", lambda s, d: E.within_group_similarity(vectors(s, d), 64).select(F.round("similarity", 6).alias("similarity")),
         f"""select round(avg(m), 6) as similarity from (select x.label, avg({_cos}) as m from embeddings x join embeddings y on x.label = y.label and x.vec_id < y.vec_id group by 1)""")


def customer_duplicates(s, d):
    """Customers with the same balance in whole hundreds and segment count as known duplicates."""
    c = tpch_view(s, d)["customer"].select("c_custkey", "c_nationkey", "c_mktsegment", F.floor(F.col("c_acctbal") / 100).alias("level"))
    first = c.groupBy("c_mktsegment", "level").agg(F.min("c_custkey").alias("a"))
    return (c.join(first, ["c_mktsegment", "level"]).where("c_custkey > a").select("a", F.col("c_custkey").alias("b")),
            c.select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("group")))


def er_sample(s, d):
    dup, ent = customer_duplicates(s, d)
    return P.er_samples(ent, dup, 100, 5, 5, 12)


register("e13_er_samples", er_sample)
register("e13_er_samples_valid",
         lambda s, d: er_sample(s, d).join(customer_duplicates(s, d)[0].select(F.col("a").alias("da"), F.col("b").alias("db")),
                                           (F.least("a", "b") == F.col("da")) & (F.greatest("a", "b") == F.col("db")), "left")
         .groupBy("kind", F.when(F.col("kind") == "random", F.col("a")).alias("anchor")).agg(F.count(F.lit(1)).alias("pairs"), F.count("da").alias("known"))
         .groupBy("kind").agg(F.sum("pairs").alias("pairs"), F.sum("known").alias("known"), F.min("pairs").alias("least"), F.max("pairs").alias("most")).where("kind <> 'hard'")
         .select("kind", F.when(F.col("kind") == "positive", F.col("pairs")).alias("pairs"), F.when(F.col("kind") == "positive", 0).otherwise(F.col("known")).cast("long").alias("wrong"),
                 F.when(F.col("kind") == "random", F.col("least")).alias("least_of_anchor"), F.when(F.col("kind") == "random", F.col("most")).alias("most_of_anchor")),
         """select 'positive' as kind, cast(100 as bigint) as pairs, cast(0 as bigint) as wrong, cast(null as bigint) as least_of_anchor, cast(null as bigint) as most_of_anchor
            union all select 'random', null, 0, 5, 5""")


def er_scores(s, d):
    """Scores of all documents with a label: positives by quality, negatives by toxicity."""
    l = labelled(s, d)
    kind = F.when(F.col("quality") == 1, "positive").when(F.col("toxic") == 1, "hard").otherwise("random")
    return l.select(kind.alias("kind"), F.col("doc_id").alias("a"), (F.col("doc_id") + 1).alias("b"), F.col("n_chars").cast("double").alias("score"), (F.col("lang") == "en").alias("same_group"))


ER_SQL = """with e as (select case when quality = 1 then 'positive' when toxic = 1 then 'hard' else 'random' end as kind, doc_id as a, doc_id + 1 as b, cast(n_chars as double) as score,
    lang = 'en' as same_group from labels join documents using (doc_id)),
    t as (select 'auc_random' as metric, score, kind = 'positive' as pos from e where kind in ('positive', 'random') union all
          select 'auc_hard', score, kind = 'positive' from e where kind in ('positive', 'hard') union all
          select 'auc_hard_same_det', score, kind = 'positive' from e where kind = 'hard' or (kind = 'positive' and same_group) union all
          select 'auc_hard_diff_det', score, kind = 'positive' from e where kind = 'hard' or (kind = 'positive' and not same_group)),
    r as (select *, rank() over (partition by metric order by score) + (count(*) over (partition by metric, score) - 1) / 2.0 as r from t)
    select metric, round((sum(r) filter (pos) - count(*) filter (pos) * (count(*) filter (pos) + 1) / 2.0) / nullif(count(*) filter (pos) * count(*) filter (not pos), 0), 9) as value from r group by 1
    union all select 'mrr', round(avg(1.0 / (1 + (select count(*) from e x where x.kind <> 'positive' and x.a in (p.a, p.b) and x.score > p.score))), 9) from e p where p.kind = 'positive'"""
register("e14_er_metrics", lambda s, d: E.er_metrics(er_scores(s, d)).select("metric", F.round("value", 9).alias("value")), ER_SQL)


def seed_scores(s, d):
    """Ten paired measurements per event type: means of two event halves per user residue."""
    e = s.read.parquet(f"{d}/events.parquet")
    cents = F.floor(F.col("value") * 100 + 0.5).cast("long")
    return (e.groupBy("event_type", (F.col("user_id") % 10).alias("seed"))
            .agg(F.sum(F.when(F.hour("ts") < 12, cents)).cast("double").alias("n"), F.sum(F.when(F.hour("ts") >= 12, cents)).cast("double").alias("d")))


SEED_SQL = """select event_type, user_id % 10 as seed, sum(cast(floor(value * 100 + 0.5) as bigint)) filter (hour(ts) < 12) - sum(cast(floor(value * 100 + 0.5) as bigint)) filter (hour(ts) >= 12) as diff
    from events group by 1, 2"""
register("e15_paired_test", lambda s, d: E.paired_test(seed_scores(s, d), ["event_type"], "n", "d").select("event_type", "n", "w_plus", "w_minus", F.round("p", 9).alias("p"), F.round("p_holm", 9).alias("p_holm")),
         f"""with x as (select * from ({SEED_SQL}) where diff <> 0), r as (select event_type, diff, rank() over (partition by event_type order by abs(diff))
             + (count(*) over (partition by event_type, abs(diff)) - 1) / 2.0 as r from x),
             w as (select event_type, count(*) as n, cast(coalesce(sum(r) filter (diff > 0), 0) as double) as w_plus, cast(coalesce(sum(r) filter (diff < 0), 0) as double) as w_minus, list(r) as rs from r group by 1),
             pt as (select event_type, n, w_plus, w_minus, list_sum(list_transform(rs, lambda v, i: case when (s >> (i - 1)) & 1 = 1 then v else 0 end)) as t from w, range(1024) q(s) where s < 2 ** n),
             p as (select event_type, n, w_plus, w_minus, least(1.0, 2.0 * avg(case when t <= least(w_plus, w_minus) + 1e-9 then 1.0 else 0.0 end)) as p from pt group by all),
             h as (select *, row_number() over (order by p) as k, count(*) over () as m from p)
             select event_type, n, w_plus, w_minus, round(p, 9) as p, round(max(least(1.0, (m - k + 1) * p)) over (order by k rows unbounded preceding), 9) as p_holm from h""")
register("e16_noise_gate", lambda s, d: E.noise_filter(s.read.parquet(f"{d}/events.parquet").groupBy("user_id").agg(
    (F.count(F.when(F.col("event_type") == "error", 1)) / F.count(F.lit(1)) / 10).alias("null_drift"), F.count(F.when(F.col("event_type") == "click", 1)).cast("double").alias("partial"),
    F.count(F.lit(1)).cast("double").alias("full"))),
         """select *, partial / nullif("full", 0) as ratio from (select user_id, count(*) filter (event_type = 'error') / count(*) / 10 as null_drift,
            cast(count(*) filter (event_type = 'click') as double) as partial, cast(count(*) as double) as "full" from events group by 1) where null_drift <= 0.01""")
register("w3_extremes", lambda s, d: E.score_pairs(label_pairs(s, d), vectors(s, d), half(vectors(s, d))).withColumn("gap", F.round(F.abs("delta"), 6)).groupBy("label").agg(
    F.min_by("a", F.struct("gap", "a")).alias("closest"), F.max_by("a", F.struct("gap", "a")).alias("largest"), F.min("gap").alias("low"), F.max("gap").alias("high")),
         f"""with s as (select label, a, round(abs(cn - cd), 6) as gap from (select p.label as label, a, {_cos} as cd, {_cos_half} as cn
             from ({PAIRS_SQL}) p join embeddings x on x.vec_id = a join embeddings y on y.vec_id = b))
             select label, arg_min(a, (gap, a)) as closest, arg_max(a, (gap, a)) as largest, min(gap) as low, max(gap) as high from s group by 1""")
register("w5_ecdf", lambda s, d: E.ecdf(s.read.parquet(f"{d}/events.parquet").withColumn("seed", F.col("user_id") % 10), ["event_type"], "value", [5.0, 10.0, 20.0, 50.0], "seed")
         .select("event_type", "point", F.round("share", 9).alias("share")),
         """select event_type, point, round(avg(share), 9) as share from (select event_type, user_id % 10 as seed, cast(g as double) as point, avg(case when value <= g then 1.0 else 0.0 end) as share
            from events, (values (5), (10), (20), (50)) x(g) group by 1, 2, 3) group by 1, 2""")
