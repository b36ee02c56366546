"""Sources and sinks. Sink queries write to a new folder and return what they read back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stockflow.demo import LATE, Frames, sql
from stockflow.functions.calendar import month_of
from stockflow.operators import order as O
from stockflow.operators import rollup as R
from stockflow.queries import query
from stockflow.sources import files as S
from stockflow.sources import manifests as M
from stockflow.sources import store as T
from stockflow.streaming.loader import load_into, load_new

_FILES = "SELECT 'orders' AS dataset, 'orders_' || strftime(month, '%Y%m') || '_' || (1 + month(month) % 3) || '.parquet' AS filename, month, 1 + month(month) % 3 AS version, n AS size FROM (SELECT order_month AS month, count(*) AS n FROM ordered GROUP BY 1)"


def _manifest(f: Frames) -> DataFrame:
    """A manifest as the months of orders would make it."""
    n = f.orders.groupBy(F.col("order_month").alias("month")).agg(F.count("*").alias("size"))
    version = F.lit(1) + F.month("month") % 3
    return n.select(F.lit("orders").alias("dataset"), F.concat(F.lit("orders_"), F.date_format("month", "yyyyMM"), F.lit("_"), version, F.lit(".parquet")).alias("filename"), "month", version.cast("long").alias("version"), "size")


@query("SELECT 'lineitem.parquet' AS source_file, count(*) AS n FROM lineitem UNION ALL SELECT 'orders.parquet', count(*) FROM orders")
def scan_with_file_meta(f: Frames) -> DataFrame:
    return S.scan(f.spark, f"{f.sf_dir}/orders.parquet", f"{f.sf_dir}/lineitem.parquet").groupBy("source_file").agg(F.count("*").alias("n"))


@query(sql(f"SELECT filename, dataset, month AS period, CAST(version AS INTEGER) AS version FROM ({_FILES})"))
def filename_parts(f: Frames) -> DataFrame:
    return _manifest(f).select("filename", *S.name_parts(F.col("filename")))


@query(sql(f"SELECT dataset, filename, CAST(year(month) AS INTEGER) AS year, CAST(month(month) AS INTEGER) AS month, version, month AS period FROM ({_FILES})"))
def manifest_periods(f: Frames) -> DataFrame:
    """The manifest written as JSON and read back, with its period as a date."""
    out = S.work_dir(f.spark, "manifest")
    _manifest(f).select("dataset", "filename", F.year("month").alias("year"), F.month("month").alias("month"), "version").write.json(out)
    back = f.spark.read.schema("dataset string, filename string, year int, month int, version long").json(out)
    return back.withColumn("period", F.make_date("year", "month", F.lit(1)))


@query(sql("SELECT order_month AS month, max(1 + CAST(o_orderkey % 997 = 0 AS BIGINT)) AS orders, (SELECT max(1 + CAST(l_orderkey % 499 = 0 AS BIGINT)) FROM all_outflow WHERE file_month = order_month) AS lines FROM ordered GROUP BY 1"))
def versions_pivot(f: Frames) -> DataFrame:
    """The manifest's file versions, datasets as columns: 2 where a file holds a record that came late."""
    v = lambda rows, month, d, key, n: rows.select(F.col(month).alias("month"), F.lit(d).alias("d"), F.when(F.col(key) % n == 0, 2).otherwise(1).cast("long").alias("v"))
    both = v(f.orders, "order_month", "orders", "o_orderkey", 997).unionByName(v(f.all_outflow, "file_month", "lines", "l_orderkey", 499))
    manifest = both.groupBy("month", "d").agg(F.max("v").alias("v"))
    return manifest.groupBy("month").pivot("d", ["orders", "lines"]).agg(F.max("v"))


@query(sql(f"SELECT sha256(string_agg('{{\"dataset\":\"' || dataset || '\",\"filename\":\"' || filename || '\",\"version\":' || version || '}}', ',' ORDER BY dataset, filename)) AS sha256, count(*) AS files FROM ({_FILES})"))
def manifest_hash(f: Frames) -> DataFrame:
    """SHA-256 of the manifest's canonical JSON, its records in order; a manifest has a row a file."""
    rows = F.sort_array(F.collect_list(F.struct("dataset", "filename", F.to_json(F.struct("dataset", "filename", "version")).alias("json"))))
    return _manifest(f).agg(F.sha2(F.array_join(F.transform(rows, lambda x: x["json"]), ","), 256).alias("sha256"), F.count("*").alias("files"))


@query("SELECT CAST(r_regionkey AS VARCHAR) AS code, r_name AS label FROM region")
def crosswalk_read(f: Frames) -> DataFrame:
    """A crosswalk through CSV: header, and all columns text."""
    out = S.work_dir(f.spark, "crosswalk")
    f.table("region").select(F.col("r_regionkey").alias("code"), F.col("r_name").alias("label")).write.option("header", True).csv(out)
    return f.spark.read.option("header", True).option("inferSchema", False).csv(out)


@query(sql(f"SELECT dataset, filename FROM ({_FILES}) WHERE month >= DATE '2000-01-01'"))
def ledger_anti_join(f: Frames) -> DataFrame:
    m = _manifest(f)
    return S.to_load(m, m.where("month < DATE '2000-01-01'")).select("dataset", "filename")


@query(sql(f"SELECT o.order_month AS month, count(*) AS n FROM ordered o JOIN ({_FILES}) m ON m.month = o.order_month WHERE m.version <> 2 GROUP BY 1"))
def supersede_semi_join(f: Frames) -> DataFrame:
    m = _manifest(f)
    rows = f.orders.join(m.select("month", F.col("filename").alias("source_file")), F.col("order_month") == F.col("month"))
    return S.superseded(rows, m.where("version <> 2")).groupBy("month").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey AS k, o_orderstatus AS status, CAST(NULL AS VARCHAR) AS flag FROM orders UNION ALL SELECT l_orderkey, NULL, l_returnflag FROM lineitem")
def union_by_name(f: Frames) -> DataFrame:
    """Both tables whole."""
    a = f.table("orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("status"))
    return a.unionByName(f.table("lineitem").select(F.col("l_returnflag").alias("flag"), F.col("l_orderkey").alias("k")), allowMissingColumns=True)


@query(sql("SELECT month, count(*) AS stock FROM stock GROUP BY month"))
def overwrite_idempotent(f: Frames) -> DataFrame:
    """Written twice over: the second time changes nothing."""
    out = S.work_dir(f.spark, "panel")
    panel = f.stock.groupBy("month").agg(F.count("*").alias("stock"))
    for _ in range(2):
        panel.write.mode("overwrite").parquet(out)
    return f.spark.read.parquet(out)


@query(sql("SELECT grain, period, stock, entity FROM rolled"))
def partitioned_sink(f: Frames) -> DataFrame:
    """The cube partitioned by entity, and every partition read back."""
    out = S.work_dir(f.spark, "cube")
    R.roll_up(f.base, []).select("grain", "period", "stock", "entity").repartition("entity").write.partitionBy("entity").parquet(out)
    return f.spark.read.parquet(out)


@query(sql("SELECT entity, era, stock FROM running WHERE n = 12"))
def era_view_at_n(f: Frames) -> DataFrame:
    out = S.work_dir(f.spark, "view")
    R.running(f.base, f.eras, []).where("n = 12").select("entity", "era", "stock").write.parquet(out)
    return f.spark.read.parquet(out)


@query(sql("SELECT l_orderkey, l_linenumber, code, years_text FROM all_outflow"))
def records_sink(f: Frames) -> DataFrame:
    """Records in full order, ZSTD."""
    out = S.work_dir(f.spark, "records")
    f.all_outflow.select("l_orderkey", "l_linenumber", "code", "years_text").sort("l_orderkey", "l_linenumber", "code", "years_text").write.option("compression", "zstd").parquet(out)
    return f.spark.read.parquet(out)


_RECORD_ORDER = ["code", "years_text", "l_orderkey", "l_linenumber"]


@query(sql("SELECT code, years_text, l_orderkey, l_linenumber, row_number() OVER (ORDER BY code NULLS FIRST, years_text NULLS FIRST, l_orderkey, l_linenumber) AS place FROM all_outflow"))
def ordered_records(f: Frames) -> DataFrame:
    """Records written in order over several files, and read back with the place that file and row give them."""
    out = S.work_dir(f.spark, "ordered")
    O.write_ordered(f.all_outflow.select(*_RECORD_ORDER), _RECORD_ORDER, out, rows_per_file=20_000)
    return O.read_ordered(f.spark, out)


@query(sql("SELECT count(*) AS rows, true AS same FROM base"))
def dataset_fingerprint(f: Frames) -> DataFrame:
    """The fingerprint of the base equals that of the same rows dealt and ordered in another way."""
    a, b = S.fingerprint(f.base), S.fingerprint(f.base.repartition(7, "month"))
    return a.join(b.select(F.col("rows").alias("r"), F.col("low").alias("l"), F.col("xor").alias("x"))).select("rows", ((F.col("rows") == F.col("r")) & (F.col("low") == F.col("l")) & (F.col("xor") == F.col("x"))).alias("same"))


@query(sql("SELECT entity, month, stock FROM base"))
def gated_publish(f: Frames) -> DataFrame:
    """Published as the checks of the stage find nothing; the second time nothing changes, and a stage with a negative stock is refused."""
    rows, store = f.base.select("entity", "month", "stock"), S.work_dir(f.spark, "store")
    checks = lambda staged: [staged.where("stock < 0")]
    said = [S.publish(x, checks, store, "base", source="2001-08") for x in (rows, rows, rows.withColumn("stock", F.col("stock") - 10**9))]
    assert said == ["published", "unchanged", "refused: a check finds something"], said
    return S.published(f.spark, store, "base")


@query(sql("SELECT 'base' AS name, '2001-08' AS source, count(*) AS rows FROM base UNION ALL SELECT 'base', '2001-09', count(*) FROM base WHERE entity <> 'ALL'"))
def publish_history(f: Frames) -> DataFrame:
    """Every promotion, in an append-only table: a later source is published over an earlier one, and not the other way round."""
    rows, store = f.base.select("entity", "month", "stock"), S.work_dir(f.spark, "store")
    some = rows.where("entity <> 'ALL'")
    said = [S.publish(rows, lambda x: [], store, "base", "2001-08"), S.publish(some, lambda x: [], store, "base", "2001-09"), S.publish(rows, lambda x: [], store, "base", "2001-08"), S.publish(rows, lambda x: [], store, "base", "2001-10", complete=False)]
    assert said == ["published", "published", "refused: its source is older", "refused: it is incomplete"], said
    return S.history(f.spark, store).select("name", "source", "rows")


@query("SELECT p_partkey, p_name, nullif(p_type, 'PROMO') AS p_type FROM part")
def csv_export(f: Frames) -> DataFrame:
    """CSV with published names, empty for null and doubled quotes, read back."""
    out = S.work_dir(f.spark, "export")
    rows = f.table("part").select("p_partkey", "p_name", F.nullif(F.col("p_type"), F.lit("PROMO")).alias("p_type"))
    rows.write.option("header", True).option("nullValue", "").option("quote", '"').option("escape", '"').csv(out)
    return f.spark.read.schema(rows.schema).option("header", True).option("nullValue", "").option("quote", '"').option("escape", '"').csv(out)


@query("SELECT CAST(n_nationkey AS VARCHAR) AS code, n_name AS name FROM nation")
def columnar_to_rows(f: Frames) -> DataFrame:
    """{columns, rows} of arrays, as old cube files have it, to rows."""
    cube = f.table("nation").agg(F.collect_list(F.array(F.col("n_nationkey").cast("string"), "n_name")).alias("rows")).withColumn("columns", F.array(F.lit("code"), F.lit("name")))
    row = cube.select("columns", F.explode("rows").alias("row")).select(F.map_from_arrays("columns", "row").alias("m"))
    return row.select(F.col("m")["code"].alias("code"), F.col("m")["name"].alias("name"))


@query(sql("""SELECT 'grain' AS kind, grain AS name, CAST(count(*) AS VARCHAR) AS value FROM rolled GROUP BY grain UNION ALL SELECT 'first', grain, strftime(min(last_month), '%Y-%m') FROM rolled GROUP BY grain
    UNION ALL SELECT 'last', grain, strftime(max(last_month), '%Y-%m') FROM rolled GROUP BY grain UNION ALL SELECT 'entity end', entity, strftime(end_month, '%Y-%m') FROM ends
    UNION ALL SELECT 'provisional', tag, 'true' FROM month_flags WHERE provisional UNION ALL SELECT 'reissued', tag, 'true' FROM month_flags WHERE reissued
    UNION ALL SELECT 'groups', entity, string_agg(group_code, ',' ORDER BY group_code) FROM (SELECT entity, group_code FROM base_by_group GROUP BY ALL HAVING max(greatest(stock, inflow, outflow)) > 0) GROUP BY entity
    UNION ALL SELECT 'issue rows', 'years', CAST(sum(years_issue) AS VARCHAR) FROM base WHERE entity = 'ALL'"""))
def cube_summary(f: Frames) -> DataFrame:
    """What stands beside a cube: rows and range by grain, entity ends, provisional and reissued months, present groups, applied issues."""
    from stockflow.functions.calendar import month_key
    from stockflow.operators import base as B

    row = lambda kind, name, value: F.struct(F.lit(kind).alias("kind"), name.alias("name"), value.cast("string").alias("value"))
    r = R.roll_up(f.base, []).groupBy("grain").agg(F.count("*").alias("n"), F.min("last_month").alias("a"), F.max("last_month").alias("b"))
    grain = F.col("grain")
    grains = r.select(F.inline(F.array(row("grain", grain, F.col("n")), row("first", grain, month_key(F.col("a"))), row("last", grain, month_key(F.col("b"))))))
    one = lambda df, *cells: df.select(F.inline(F.array(row(*cells))))
    ends = one(B.entity_ends(f.base), "entity end", F.col("entity"), month_key(F.col("last_month")))
    flags = one(f.month_flags.where("provisional"), "provisional", F.col("tag"), F.lit("true")).unionByName(one(f.month_flags.where("reissued"), "reissued", F.col("tag"), F.lit("true")))
    pairs = f.base_all_groups.where("group_code <> 'all'").groupBy("entity").agg(F.array_join(F.sort_array(F.collect_set("group_code")), ",").alias("g"))
    issue = f.base.where("entity = 'ALL'").agg(F.sum("years_issue").alias("n"))
    return grains.unionByName(ends).unionByName(flags).unionByName(one(pairs, "groups", F.col("entity"), F.col("g"))).unionByName(one(issue, "issue rows", F.lit("years"), F.col("n")))


_ERA_TAGS = "SELECT 'era' AS grain, era AS period, tag FROM month_flags JOIN eras ON month BETWEEN first_month - INTERVAL 1 MONTH AND last_month"


@query(sql(f"""SELECT grain, period, string_agg(tag, ',' ORDER BY tag) AS versions FROM (SELECT grain, period, tag FROM bridge JOIN month_flags USING (month) UNION ALL {_ERA_TAGS}
    UNION ALL SELECT 't12', strftime(e.month, '%Y-%m'), m.tag FROM months e JOIN month_flags m ON m.month BETWEEN e.month - INTERVAL 11 MONTH AND e.month WHERE e.month >= (SELECT first_month + INTERVAL 11 MONTH FROM bounds)) GROUP BY ALL"""))
def version_tags(f: Frames) -> DataFrame:
    """The file tags of every window in month order: periods, trailing twelve months, and eras with the month before them first."""
    from stockflow.functions.calendar import bridge
    from stockflow.plans.full import windows

    tags = f.month_flags.select("month", "tag")
    spans = bridge(tags.select("month")).select("grain", "period", "month").unionByName(windows(f.month_flags, f.eras).where("grain = 't12'").select("grain", "period", "month"))
    era = tags.join(F.broadcast(f.eras), F.col("month").between(F.add_months("first_month", -1), F.col("last_month"))).select(F.lit("era").alias("grain"), F.col("era").alias("period"), "tag")
    rows = F.broadcast(spans).join(tags, "month").select("grain", "period", "tag").unionByName(era)
    return rows.groupBy("grain", "period").agg(F.array_join(F.sort_array(F.collect_list("tag")), ",").alias("versions"))


@query(sql("SELECT order_month AS month, count(*) AS size, count(*) FILTER (o_orderkey % 997 <> 0) AS size_before, count(*) FILTER (o_orderkey % 997 = 0) > 0 AS reissued FROM ordered GROUP BY 1"))
def reissued_months(f: Frames) -> DataFrame:
    """Two manifests written as JSON, the one before without what came late: months that the later one lists with another size."""
    from stockflow.demo import LATE

    def manifest(name: str, rows: DataFrame) -> DataFrame:
        out = S.work_dir(f.spark, name)
        rows.groupBy(F.col("order_month").alias("month")).agg(F.count("*").alias("size")).write.json(out)
        return f.spark.read.schema("month date, size long").json(out)

    now, before = manifest("manifest", f.orders), manifest("manifest-before", f.orders.where(F.col("o_orderkey") % LATE != 0))
    both = now.join(before.withColumnRenamed("size", "size_before"), "month", "left")
    return both.select("month", "size", F.coalesce("size_before", F.lit(0)).alias("size_before"), (~F.col("size").eqNullSafe(F.col("size_before"))).alias("reissued"))


@query(sql(f"SELECT filename, 'not loaded' AS problem FROM ({_FILES}) WHERE month >= DATE '2000-01-01' UNION ALL SELECT 'orders_190001_1.parquet', 'not listed'"))
def ledger_difference(f: Frames) -> DataFrame:
    """The ledger against the manifest, both ways."""
    m = _manifest(f).select("dataset", "filename", "month")
    stray = f.spark.createDataFrame([("orders", "orders_190001_1.parquet")], "dataset string, filename string")
    return S.ledger_difference(m, m.where("month < DATE '2000-01-01'").select("dataset", "filename").unionByName(stray))


def _monthly_source(f: Frames, name: str) -> tuple[DataFrame, str]:
    """Orders with their month, and a folder for them, a file a month."""
    return f.table("orders").select("o_orderkey", "o_totalprice", month_of("o_orderdate").alias("month")), S.work_dir(f.spark, name)


def _deliver(rows: DataFrame, out: str) -> None:
    rows.repartition("month").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(out)


def _order_file() -> Column:
    return F.concat(F.lit("orders_"), F.date_format("month", "yyyy-MM"))


@query(sql("SELECT 'orders_' || strftime(order_month, '%Y-%m') AS source_file, count(*) AS rows, 'loaded' AS action, CASE WHEN order_month < DATE '1997-01-01' THEN 0 ELSE 1 END AS batch, count(*) AS stored, round(sum(price), 2) AS price FROM ordered GROUP BY order_month"))
def ledger_stream_load(f: Frames) -> DataFrame:
    """A stream with a kept ledger: three runs, months delivered between the first two, nothing before the third. The ledger beside what is stored."""
    orders, src = _monthly_source(f, "monthly")
    store, mark = S.work_dir(f.spark, "store"), S.work_dir(f.spark, "stream-mark")
    run = lambda: load_into(f.spark, src, orders.schema, store, mark, _order_file)
    _deliver(orders.where("month < DATE '1997-01-01'"), src)
    said = run()
    _deliver(orders.where("month >= DATE '1997-01-01'"), src)
    said += run() + run()
    assert said == ["loaded", "loaded"], said
    stored = T.rows(f.spark, store).groupBy("source_file").agg(F.count("*").alias("stored"), F.round(F.sum("o_totalprice"), 2).alias("price"))
    return T.ledger(f.spark, store).join(stored, "source_file", "full_outer").select("source_file", "rows", "action", F.right("load", F.lit(12)).cast("int").alias("batch"), "stored", "price")


_REISSUED, _LEFT = "DATE '1997-05-01'", "DATE '1998-02-01'"


@query(sql(f"SELECT 'orders_' || strftime(order_month, '%Y-%m') AS source_file, count(*) FILTER (order_month <> {_REISSUED} OR o_orderkey % 5 <> 0) AS stored, CASE WHEN order_month = {_REISSUED} THEN 'second' ELSE 'first' END AS load FROM ordered WHERE order_month <> {_LEFT} GROUP BY order_month"))
def superseded_store(f: Frames) -> DataFrame:
    """A stored table after one of its source files was delivered anew with other rows and one left the manifest; what no longer counts is deleted."""
    orders, src = _monthly_source(f, "monthly")
    store = S.work_dir(f.spark, "store")

    def delivered() -> DataFrame:
        meta = {"size": F.col("_metadata.file_size"), "modified": F.col("_metadata.file_modification_time")}
        return f.spark.read.schema(orders.schema).parquet(src).select("*", _order_file().alias("source_file"), *(c.alias(n) for n, c in meta.items()))

    listed = lambda: delivered().groupBy("source_file").agg(F.max("size").alias("size"), F.max("modified").alias("modified"))
    _deliver(orders, src)
    said = [T.add(delivered().drop("size", "modified"), listed(), store, "first")]
    _deliver(orders.where(f"month = {_REISSUED} AND o_orderkey % 5 <> 0"), src)
    manifest = listed().where(F.col("source_file") != F.lit("orders_1998-02"))
    wanted = T.supersede(f.spark, manifest, store, "removal")
    said += [T.add(delivered().drop("size", "modified"), wanted, store, "second"), str(T.sweep(f.spark, store))]
    assert said == ["loaded", "loaded", "2"], said
    return T.rows(f.spark, store).groupBy("source_file", "load").agg(F.count("*").alias("stored"))


_SIZES = """SELECT order_month AS month, count(*) FILTER (o_orderkey % 997 <> 0) AS s1, count(*) AS s2, count(*) FILTER (order_month <> DATE '1997-05-01' OR o_orderkey % 5 <> 0) AS s3 FROM ordered GROUP BY 1"""


def _refreshes(f: Frames) -> str:
    """Three refreshes of the orders' manifest: without what came late, with it, and with one month delivered anew; the second is recorded twice."""
    late, again = F.col("o_orderkey") % LATE == 0, (F.col("month") == F.lit("1997-05-01").cast("date")) & (F.col("o_orderkey") % 5 == 0)
    orders = f.table("orders").select("o_orderkey", month_of("o_orderdate").alias("month"))
    n = orders.groupBy("month").agg(F.count_if(~late).alias("s1"), F.count("*").alias("s2"), F.count_if(~again).alias("s3"))
    path, v2 = S.work_dir(f.spark, "manifests"), F.when(F.col("s2") != F.col("s1"), 2).otherwise(1)

    def manifest(size: str, version: Column) -> DataFrame:
        name = F.concat(F.lit("orders_"), F.date_format("month", "yyyyMM"), F.lit("_"), version, F.lit(".parquet"))
        return n.select(F.lit("orders").alias("dataset"), "month", name.alias("filename"), version.cast("long").alias("version"), F.col(size).alias("size"))

    third = manifest("s3", v2 + F.when(F.col("s3") != F.col("s2"), 1).otherwise(0))
    said = [M.record(m, path) for m in (manifest("s1", F.lit(1)), manifest("s2", v2), manifest("s2", v2), third)]
    assert said == [1, 2, 2, 3], said
    return path


@query(sql(f"""SELECT refresh, month, CAST(version AS BIGINT) AS version, reissued FROM (SELECT 1 AS refresh, month, 1 AS version, false AS reissued FROM ({_SIZES}) UNION ALL SELECT 2, month, 1 + CAST(s1 <> s2 AS INTEGER), s1 <> s2 FROM ({_SIZES})
    UNION ALL SELECT 3, month, 1 + CAST(s1 <> s2 AS INTEGER) + CAST(s3 <> s2 AS INTEGER), s3 <> s2 FROM ({_SIZES}))"""))
def reissue_marks(f: Frames) -> DataFrame:
    """Which months each of three refreshes marks as reissued: a mark appears, stays while its refresh is the newest, and goes with the next."""
    path, out = _refreshes(f), None
    for r in (1, 2, 3):
        one = M.flags(f.spark, path, "orders", r).select(F.lit(r).alias("refresh"), "month", F.regexp_extract("tag", r"v(\d+)$", 1).cast("long").alias("version"), "reissued")
        out = one if out is None else out.unionByName(one)
    return out


@query(sql(f"SELECT month, CASE WHEN (s1 <> s2) <> (s3 <> s2) THEN 'flag' ELSE 'tag' END AS problem FROM ({_SIZES}) WHERE (s1 <> s2) <> (s3 <> s2) OR s3 <> s2"))
def stale_flags(f: Frames) -> DataFrame:
    """The core cube's flags and tags, made of the second refresh, against the state: none is wrong by then, and after the third those that it changed are."""
    from stockflow.queries.cubes import cube_core

    path = _refreshes(f)
    published = cube_core(f).where("grain = 'month' AND entity = 'ALL'").select(F.col("first_month").alias("month"), "reissued", F.col("files").alias("tag"))
    then = M.wrong_flags(published, M.flags(f.spark, path, "orders", 2))
    return M.wrong_flags(published, M.flags(f.spark, path, "orders")).unionByName(then.withColumn("problem", F.concat(F.lit("then: "), "problem")))


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def stream_load_new(f: Frames) -> DataFrame:
    """Events loaded by an available-now stream, twice: the second finds nothing new."""
    src, out, mark = (S.work_dir(f.spark, x) for x in ("stream-source", "stream-out", "stream-mark"))
    f.table("events").write.parquet(src)
    for _ in range(2):
        load_new(f.spark, src, f.table("events").schema, out, mark)
    return f.spark.read.parquet(out).groupBy("event_type").agg(F.count("*").alias("n"))
