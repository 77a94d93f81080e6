"""Text sources, typed loads and streams, fed with the driver tables that Spark has written out."""
from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tabred import oracle
from tabred.catalog import register
from tabred.schemas import TBL_SCHEMAS
from tabred.session import shared_folder
from tabred.sources import rdf, results, text, typed
from tabred.sources.tables import tpch_view
from tabred.streaming import feeds

V = oracle.with_views
c = F.col


def fresh(s) -> str:
    return f"{shared_folder(s)}/tabred/text-{uuid.uuid4().hex}"


def as_text(df, path):
    df.write.mode("overwrite").text(path)
    return path


def tbl(s, d):
    t = tpch_view(s, d)["supplier"].select(*TBL_SCHEMAS["supplier"].names)
    path = fresh(s)
    text.write_tbl(t, path)
    return text.read_tbl(s, path, "supplier")[0]


register("s2_tbl_scan", tbl, V(f"select {', '.join(TBL_SCHEMAS['supplier'].names)} from v_supplier"))


def bad_tbl(s, d):
    line = F.concat_ws("|", "n_nationkey", "n_name", "n_regionkey", "n_comment")
    broken = F.when(c("n_nationkey") % 5 == 0, line).when(c("n_nationkey") % 5 == 1, F.concat(F.lit("x"), line, F.lit("|"))).otherwise(F.concat(line, F.lit("|")))
    return text.read_tbl(s, as_text(tpch_view(s, d)["nation"].select(broken), fresh(s)), "nation")[1].groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


register("s2_tbl_rejected", bad_tbl, """select case when n_nationkey % 5 = 0 then 'wrong number of fields' else 'n_nationkey is no int' end as reason, count(*) as n
    from nation where n_nationkey % 5 < 2 group by 1""")


def pipe(s, d):
    rows = tpch_view(s, d)["customer"].select(F.concat_ws("|", c("c_custkey").cast("string"), "c_name", F.when(c("c_custkey") % 3 == 0, "NULL").when(c("c_custkey") % 3 == 1, "").otherwise(c("c_mktsegment"))).alias("value"))
    header = s.range(1).select(F.lit(text.BOM + "CustomerID|CompanyName|Segment").alias("value"))
    path = fresh(s)
    as_text(header.unionAll(rows).coalesce(1), path)
    return text.read_pipe_csv(s, path, ["CustomerID", "CompanyName", "Segment"])


register("s3_pipe_csv", pipe, "select c_custkey::varchar as CustomerID, c_name as CompanyName, case when c_custkey % 3 = 2 then c_mktsegment end as Segment from customer".replace("CustomerID", '"CustomerID"').replace("CompanyName", '"CompanyName"').replace("Segment", '"Segment"'))


def records(s, d):
    path = fresh(s)
    (tpch_view(s, d)["part"].select(c("p_partkey").cast("string").alias("Part Key"), c("p_name").alias("Name/Title"), F.when(c("p_size") > 25, "").otherwise(c("p_brand")).alias("Brand"))
     .write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path))
    return text.read_record_csv(s, path)


register("s4_record_csv", records, "select p_partkey::varchar as part_key, p_name as name_title, case when p_size > 25 then '' else p_brand end as brand from part")


def graph_files(s, d):
    t, root = tpch_view(s, d), fresh(s)
    out = lambda df, name: df.write.mode("overwrite").option("header", True).csv(f"{root}/{name}")
    out(t["customer"].select(c("c_custkey").alias("node_id"), c("c_name").alias("name"), c("c_mktsegment").alias("note")), "customers")
    out(t["supplier"].select(c("s_suppkey").alias("node_id"), c("s_name").alias("name"), c("s_phone").alias("phone")), "suppliers")
    out(t["orders"].select(c("o_orderkey").alias("node_id_start"), c("o_custkey").alias("node_id_end"), F.lit("PLACED").alias("rel_type")), "rels")
    return text.read_graph_csv(s, [("Customer", f"{root}/customers"), ("Supplier", f"{root}/suppliers")], f"{root}/rels")


register("s5_graph_nodes", lambda s, d: graph_files(s, d)[0].select("node_id", F.array_join("labels", "+").alias("labels"), "name", "note", "phone"),
         """select coalesce(c_custkey, s_suppkey)::varchar as node_id, concat_ws('+', case when c_custkey is not null then 'Customer' end, case when s_suppkey is not null then 'Supplier' end) as labels,
            coalesce(c_name, s_name) as name, c_mktsegment as note, case when c_custkey is null then (s_nationkey + 10) || '-' || s_suppkey end as phone from customer full join supplier on c_custkey = s_suppkey""")
register("s5_graph_edges", lambda s, d: graph_files(s, d)[1],
         """with n as (select c_custkey as k from customer union select s_suppkey from supplier) select o_orderkey::varchar as src, o_custkey::varchar as dst, 'PLACED' as type from orders
            where o_orderkey in (select k from n) and o_custkey in (select k from n)""")

EX = "http://example.org/"


def triple_files(s, d):
    """Parts as entities: a type, a name with language, a typed size, and a link to the brand."""
    p, root = tpch_view(s, d)["part"], fresh(s)
    iri = lambda x: F.concat(F.lit(f"<{EX}"), x, F.lit(">"))
    subject = iri(F.concat(F.lit("part/"), c("p_partkey").cast("string")))
    line = lambda pred, obj: F.concat(subject, F.lit(f" <{pred}> "), obj, F.lit(" ."))
    types = p.select(line(rdf.RDF_TYPE, iri(F.concat(F.lit("type/"), "p_type"))))
    names = line(EX + "name", F.concat(F.lit('"'), "p_name", F.lit(' \\"q\\""@en')))
    sizes = line(EX + "size", F.concat(F.lit('"'), c("p_size").cast("string"), F.lit('"^^<http://www.w3.org/2001/XMLSchema#int>')))
    as_text(types.unionAll(types), f"{root}/types")
    as_text(p.select(names).unionAll(p.select(sizes)).unionAll(p.where("p_size < 3").select(F.concat(F.lit("broken "), "p_name"))), f"{root}/literals")
    as_text(p.select(line(EX + "brand", iri(F.concat(F.lit("brand/"), F.replace("p_brand", F.lit("#"), F.lit("%23")))))), f"{root}/objects")
    read = {k: rdf.read_triples(s, f"{root}/{k}", k) for k in ("types", "literals", "objects")}
    every = read["types"][0].unionByName(read["literals"][0]).unionByName(read["objects"][0])
    return every, read["literals"][1]


register("s6_rdf_literals", lambda s, d: triple_files(s, d)[0].where("datatype is not null"),
         f"""select '{EX}part/' || p_partkey as subject, '{EX}name' as predicate, p_name || ' "q"' as object, '{rdf.RDF_LANG_STRING}' as datatype, 'en' as language from part union all
             select '{EX}part/' || p_partkey, '{EX}size', p_size::varchar, 'http://www.w3.org/2001/XMLSchema#int', null from part""")
register("s6_rdf_rejected", lambda s, d: triple_files(s, d)[1], "select 'broken ' || p_name as value from part where p_size < 3")
register("s7_entity_types", lambda s, d: rdf.assemble_entities(triple_files(s, d)[0])[0], f"select '{EX}part/' || p_partkey as subject, '{EX}type/' || p_type as class from part")
register("s7_entity_edges", lambda s, d: rdf.assemble_entities(triple_files(s, d)[0])[2],
         f"select '{EX}part/' || p_partkey as subject, '{EX}brand' as predicate, '{EX}brand/' || replace(p_brand, '#', '%23') as object from part")
register("p17_parse_literal", lambda s, d: tpch_view(s, d)["part"].select("p_partkey", rdf.literal_json(F.lit(EX + "name"), c("p_name"), F.lit(rdf.XSD_STRING), F.lit(None).cast("string")).alias("j"))
         .select("p_partkey", rdf.parse_literal("j").alias("t")).select("p_partkey", "t.predicate", "t.value", "t.language"),
         f"select p_partkey, '{EX}name' as predicate, p_name as value, null as language from part")
register("p18_short_uri", lambda s, d: tpch_view(s, d)["part"].select("p_partkey", F.concat(F.lit(EX + "brand/"), F.replace("p_brand", F.lit("#"), F.lit("%23"))).alias("u")).select("p_partkey", rdf.short_uri("u").alias("name")),
         "select p_partkey, p_brand as name from part")


def typed_events(s, d):
    e = s.read.parquet(f"{d}/events.parquet")
    raw = e.select(c("event_id").cast("string").alias("id"), F.when(c("event_id") % 7 == 0, "n/a").otherwise(c("user_id").cast("string")).alias("user"),
                   F.when(c("event_id") % 11 == 0, "Infinity").otherwise(c("value").cast("string")).alias("value"), F.when(c("event_id") % 13 == 0, "2024-13-01").otherwise(F.date_format("ts", "yyyy-MM-dd")).alias("day"),
                   F.when(c("event_id") % 2 == 0, "TRUE").otherwise("0").alias("flag"))
    return typed.cast_checked(raw, {"id": "int", "user": "int", "value": "float", "day": "date", "flag": "boolean"})


register("s8_typed_good", lambda s, d: typed_events(s, d)[0],
         "select event_id as id, user_id as user, value, cast(ts as date) as day, event_id % 2 = 0 as flag from events where event_id % 7 > 0 and event_id % 11 > 0 and event_id % 13 > 0".replace("as user", 'as "user"'))
register("s8_typed_rejected", lambda s, d: typed_events(s, d)[1].select(c("id"), "reason"),
         """select event_id::varchar as id, concat_ws('; ', case when event_id % 7 = 0 then 'user is no int' end, case when event_id % 11 = 0 then 'value is no float' end,
            case when event_id % 13 = 0 then 'day is no date' end) as reason from events where event_id % 7 = 0 or event_id % 11 = 0 or event_id % 13 = 0""")


def upserted(s, d):
    base = tpch_view(s, d)["customer"].select("c_custkey", "c_name", "c_acctbal")
    batch = base.where("c_custkey % 4 = 0").select((c("c_custkey") * 2).alias("c_custkey"), F.when(c("c_custkey") % 8 == 0, c("c_name")).alias("c_name"), F.lit(1.0).alias("c_acctbal"))
    return typed.upsert_by_key(base, batch, ["c_custkey"])


register("s9_upsert", upserted, """with b as (select c_custkey * 2 as k, case when c_custkey % 8 = 0 then c_name end as n, cast(1.0 as double) as a from customer where c_custkey % 4 = 0)
    select coalesce(k, c_custkey) as c_custkey, coalesce(n, c_name) as c_name, coalesce(a, c_acctbal) as c_acctbal from customer full join b on k = c_custkey""")


def manifest(s, d):
    path = fresh(s)
    text.write_tbl(tpch_view(s, d)["nation"].coalesce(1), path)
    m = results.source_manifest(s, [path])
    return m.agg(F.count(F.lit(1)).alias("files"), F.min(F.length("sha256")).alias("digits"))


register("s10_source_manifest", manifest, "select cast(1 as bigint) as files, 64 as digits from nation limit 1")


def stream_of(s, d, name):
    source = f"{d}/{name}.parquet"
    path = fresh(s)
    s.read.parquet(source).repartition(3).write.parquet(path)
    return s.readStream.schema(s.read.parquet(source).schema).option("maxFilesPerTrigger", 1).parquet(path)


def in_time(s, d, name, time, steps=6):
    """The table as a stream whose files follow each other in time, as they would arrive."""
    source = f"{d}/{name}.parquet"
    path, df = fresh(s), s.read.parquet(source)
    if dict(df.dtypes)[time] == "timestamp_ntz":                        # watermarks need instants: the wall clock is taken as that of UTC
        df = df.withColumn(time, F.expr(f"timestamp_micros(timestampdiff(microsecond, timestamp_ntz'1970-01-01 00:00:00', {time}))"))
    low, high = df.agg(F.unix_timestamp(F.min(time)), F.unix_timestamp(F.max(time))).first()
    step = F.least(F.floor((F.unix_timestamp(time) - low) * steps / max(high - low, 1)), F.lit(steps - 1))
    for i in range(steps):
        df.where(step == i).coalesce(1).write.mode("append").parquet(path)
    return s.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def done(q):
    q.awaitTermination()
    if q.exception():
        raise q.exception()
    return q


def streamed_updates(s, d, compact):
    """Events correct the comment of the nation that their user falls on; the last event wins."""
    root = fresh(s)
    t = tpch_view(s, d)
    table = feeds.FoldedTable(s, f"{root}/table", {"n_nationkey": "c_nationkey"}, "n_comment", "long")
    table.create(t["customer"].join(t["nation"], c("c_nationkey") == c("n_nationkey")).select("c_custkey", "c_nationkey", "n_comment"), 8)
    feed = stream_of(s, d, "events").select((c("user_id") % 20).cast("int").alias("n_nationkey"), F.concat(F.lit("event "), c("event_id").cast("string")).alias("new"), c("event_id").cast("long").alias("event_id"))
    done(feeds.stream_updates(feed, table, f"{root}/checkpoint", "new", "event_id"))
    if compact:
        table.compact()
    return table.read().select("c_custkey", "c_nationkey", "n_comment")


CORRECTED = """select c_custkey, c_nationkey, coalesce('event ' || e, 'nation ' || c_nationkey) as n_comment from customer
            left join (select user_id % 20 as k, max(event_id) as e from events group by 1) on k = c_nationkey"""
register("t1_stream_updates", lambda s, d: streamed_updates(s, d, False), CORRECTED)
register("t1_stream_compacted_updates", lambda s, d: streamed_updates(s, d, True), CORRECTED)


def monitored(s, d):
    """The state written last of every window of a day, by a stream that holds no window longer than its day and an hour."""
    root = fresh(s)
    done(feeds.stream_fd_monitor(in_time(s, d, "events", "ts"), "user_id", "event_type", "ts", f"{root}/out", f"{root}/checkpoint"))
    return feeds.monitored_windows(s, f"{root}/out", "user_id")


register("t2_stream_fd_monitor", lambda s, d: feeds.monitored_groups(monitored(s, d), "user_id"),
         "select user_id, count(*) as rows, min(event_type) <> max(event_type) as conflicting from events group by 1")
register("t2_windowed_conflicts", lambda s, d: monitored(s, d).select(
    F.expr("timestampadd(microsecond, unix_micros(start), timestamp_ntz'1970-01-01 00:00:00')").alias("start"), "user_id", "rows", "conflicting"),
         "select date_trunc('day', ts) as start, user_id, count(*) as rows, min(event_type) <> max(event_type) as conflicting from events group by 1, 2")
