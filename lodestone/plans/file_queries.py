"""Registered queries over files: the tables are written as large documents, then indexed, split and extracted as files are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import index as IX
from lodestone.sources.scan import listed

from . import routes as RT
from .queries import field, query, t
from .recipe import Recipe, build
from .staging import fresh_path

#: So small that files of the test tables are cut into many pieces.
PIECE = 1 << 16
#: Keys of the orders that are put together at once: some 9 MB at most.
RUN = 100_000


def files_of(docs: DataFrame) -> str:
    """Writes documents (key, content) as one file each below a new folder; the key is part of the path."""
    path = fresh_path(docs.sparkSession, "files")
    docs.select("key", "content").repartition("key").write.partitionBy("key").option("lineSep", "\n").text(path)
    return path + "/*"


def key_of(column: str = "source_file") -> Column:
    return F.regexp_extract(column, r"/key=(-?\d+)/", 1).cast("int")


def nation_orders(spark: SparkSession, sf_dir: str, body: Column, ends: tuple[Column, Column] | None = None, sep: str = "") -> str:
    """Writes one file per nation that holds its customers' orders by key, between ``ends``; its path as that of :func:`files_of`.

    Runs of ``RUN`` keys are put together in groups and written in their order, with a line's end behind each and, but for the
    first, ``sep`` before it: no group holds a whole file.
    """
    run = F.expr(f"o_orderkey div {RUN}").alias("run")
    rows = t(spark, sf_dir, "orders").join(t(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("c_nationkey", run, F.struct("o_orderkey", body.alias("x")).alias("p"))
    runs = rows.groupBy("c_nationkey", "run").agg(F.concat_ws(sep or "\n", F.sort_array(F.collect_list("p"))["x"]).alias("x")).withColumn("last", F.lit(False))
    if ends:
        first = rows.groupBy(F.col("c_nationkey").alias("of")).agg(F.min("run").alias("first"))
        runs = runs.join(F.broadcast(first), F.col("c_nationkey").eqNullSafe(F.col("of"))).withColumn("x", F.concat(F.when(F.col("run") == F.col("first"), ends[0]).otherwise(F.lit(sep)), "x"))
        runs = runs.drop("of", "first").unionByName(first.select(F.col("of").alias("c_nationkey"), F.lit(None).cast("long").alias("run")).select("*", ends[1].alias("x"), F.lit(True).alias("last")))
    path = fresh_path(spark, "files")
    dealt = runs.withColumnRenamed("c_nationkey", "key").repartition("key").sortWithinPartitions("key", "last", "run")
    dealt.select("key", "x").write.partitionBy("key").option("lineSep", "\n").text(path)
    return path + "/*"


def order_element() -> Column:
    return F.concat(F.lit('<q:Order id="'), F.col("o_orderkey").cast("string"), F.lit('"><Status>'), F.col("o_orderstatus"), F.lit("</Status><Priority>"), F.col("o_orderpriority"), F.lit("</Priority></q:Order>"))


#: The same text in SQL.
ORDER_SQL = """'<q:Order id="' || CAST(o_orderkey AS VARCHAR) || '"><Status>' || o_orderstatus || '</Status><Priority>' || o_orderpriority || '</Priority></q:Order>'"""
HEAD, TAIL = '<?xml version="1.0"?>\n<!-- <q:Order> --><R xmlns:q="urn:q"><S>', "</S></R>"


def xml_files(spark: SparkSession, sf_dir: str) -> str:
    """An XML file of orders for every nation; every seventh one ends too early."""
    return nation_orders(spark, sf_dir, order_element(), (F.lit(HEAD), F.when(F.col("c_nationkey") % 7 == 0, F.lit("</S>")).otherwise(F.lit(TAIL))))


_ORDERS_OF = "FROM orders JOIN customer ON o_custkey = c_custkey"


@query(f"""SELECT c_nationkey AS nation, row_number() OVER (PARTITION BY c_nationkey ORDER BY o_orderkey) AS record_num, CAST(strlen({ORDER_SQL}) AS BIGINT) AS size_bytes, 3 AS depth, sha256({ORDER_SQL}) AS sha256, 'q=urn:q' AS namespaces {_ORDERS_OF} WHERE c_nationkey % 7 <> 0""")
def index_build(spark, sf_dir):
    """The index of large files, each built by many tasks; files that aren't well-formed have none."""
    ix = IX.build_index(listed(spark, xml_files(spark, sf_dir)), "Order", piece=PIECE)
    return ix.records.select(key_of().alias("nation"), "record_num", "size_bytes", "depth", "sha256", "namespaces")


@query(f"""WITH n AS (SELECT c_nationkey AS nation, count(*) AS n {_ORDERS_OF} GROUP BY 1 HAVING c_nationkey % 7 <> 0) SELECT nation, CASE WHEN nation % 3 = 0 THEN 'the file''s digest differs' ELSE 'record 1: the digest differs' END AS problem, CAST(1 AS BIGINT) AS times FROM n WHERE nation % 3 < 2""")
def index_verify(spark, sf_dir):
    """Files are read again by pieces: of an index that other files or records were given, each fault is told once."""
    ix = IX.build_index(listed(spark, xml_files(spark, sf_dir)), "Order", piece=PIECE).records
    k = key_of() % 3
    other = ix.withColumns({"file_digest": F.when(k == 0, F.reverse("file_digest")).otherwise(F.col("file_digest")), "sha256": F.when((k == 1) & (F.col("record_num") == 1), F.reverse("sha256")).otherwise(F.col("sha256"))})
    return IX.verify(other).groupBy(key_of().alias("nation"), "problem").agg(F.count("*").alias("times"))


def order_recipe(fmt: str, **more) -> Recipe:
    """Orders with a status by expression; at least so many a file; an order of a bad priority fails its file."""
    at = "@" if fmt == "xml" else ""
    maps = [field("order_id", f"{at}id", "integer"), field("status", "Status"), field("priority", "Priority"), field("urgent", type="boolean", expression="priority == '1-URGENT'")]
    ns = {"namespaces": {"q": "urn:q"}} if fmt == "xml" else {}
    return build({"record_type": "order", "match_selectors": [{"xpath": "//Order" if fmt != "ndjson" else "row", **more}], "field_mappings": maps, "output_schema": {"properties": {"priority": {"maxLength": 20}}}, **ns}, {"format_type": fmt})


def mixed_files(spark: SparkSession, sf_dir: str, fmt: str) -> str:
    """Files of nations: sound ones, of no orders (key % 5 = 1), of a bad order (2), that end too early (3)."""
    k, bad = F.col("c_nationkey") % 5, F.col("o_orderkey") % 50 == 7
    priority = F.when((k == 2) & bad, F.lit("no priority of the schema")).otherwise(F.col("o_orderpriority"))
    name = F.when(k == 1, "Other").otherwise("Order")
    if fmt == "xml":
        body = F.concat(F.lit("<"), name, F.lit(' id="'), F.col("o_orderkey").cast("string"), F.lit('"><Status>'), F.col("o_orderstatus"), F.lit("</Status><Priority>"), priority, F.lit("</Priority></"), name, F.lit(">"))
        ends = (F.lit("<R>"), F.when(k == 3, "").otherwise("</R>"))
        return nation_orders(spark, sf_dir, body, ends)
    own = F.concat(F.lit('{"id":'), F.col("o_orderkey").cast("string"), F.lit(',"Status":"'), F.col("o_orderstatus"), F.lit('","Priority":"'), priority, F.lit('"}'))
    if fmt == "json":
        return nation_orders(spark, sf_dir, own, (F.concat(F.lit('{"'), F.when(k == 1, "Other").otherwise("Order"), F.lit('":[')), F.when(k == 3, "]").otherwise("]}")), ",")
    lines = F.when(k == 1, F.lit("")).when((k == 3) & bad, F.lit('{"id":')).otherwise(own)
    return nation_orders(spark, sf_dir, lines)


_MIXED = f"""WITH n AS (SELECT c_nationkey AS nation, count(*) AS n, count(*) FILTER (o_orderkey % 50 = 7) AS bad {_ORDERS_OF} GROUP BY 1)
SELECT nation, CASE WHEN {{late}} THEN 'failed' WHEN nation % 5 = 2 AND bad > 0 THEN 'failed' WHEN nation % 5 = 1 OR n < 50 THEN 'failed' ELSE 'applied' END AS disposition,
CASE WHEN {{late}} THEN 'parse_error' WHEN nation % 5 = 2 AND bad > 0 THEN 'validation_error' WHEN nation % 5 = 1 OR n < 50 THEN 'min_occurrences_violation' END AS reason,
CASE WHEN {{late}} OR nation % 5 = 1 OR nation % 5 = 2 AND bad > 0 OR n < 50 THEN 0 ELSE n END AS records FROM n"""


def outcomes(e) -> DataFrame:
    return e.dispositions.select(key_of().alias("nation"), "disposition", "reason", "records")


@query(_MIXED.format(late="nation % 5 = 3"))
def outcomes_by_document(spark, sf_dir):
    """What becomes of files that are read whole; those above the document route's limit (100 MiB) go record by record."""
    return outcomes(RT.extract_files(spark, mixed_files(spark, sf_dir, "xml"), order_recipe("xml", min_occurrences=50)))


@query(_MIXED.format(late="nation % 5 = 3"))
def outcomes_by_record(spark, sf_dir):
    """The same of files that are read record by record, by many tasks each: the outcomes are those of the files."""
    files = listed(spark, mixed_files(spark, sf_dir, "xml"))
    return outcomes(RT.extract_records(spark, files, order_recipe("xml", min_occurrences=50), index=IX.build_index(files, "Order", piece=PIECE)))


@query(_MIXED.format(late="nation % 5 = 3"))
def outcomes_by_json_record(spark, sf_dir):
    """The same of JSON files: an incremental reader finds their records."""
    files = listed(spark, mixed_files(spark, sf_dir, "json"))
    return outcomes(RT.extract_records(spark, files, order_recipe("json", min_occurrences=50)))


@query(_MIXED.format(late="nation % 5 = 3 AND bad > 0"))
def outcomes_by_line(spark, sf_dir):
    """The same of NDJSON files that are split: a bad line fails its file."""
    return outcomes(RT.extract_lines(spark, mixed_files(spark, sf_dir, "ndjson"), order_recipe("ndjson", min_occurrences=50)))


@query(f"""SELECT nation, record_num, order_id, urgent FROM (SELECT c_nationkey AS nation, row_number() OVER (PARTITION BY c_nationkey ORDER BY o_orderkey) AS record_num, o_orderkey AS order_id, o_orderpriority = '1-URGENT' AS urgent, count(*) FILTER (o_orderkey % 50 = 7) OVER (PARTITION BY c_nationkey) AS bad {_ORDERS_OF}) WHERE nation % 5 <> 1 AND (nation % 5 NOT IN (2, 3) OR bad = 0)""")
def lines_split(spark, sf_dir):
    """Records of NDJSON files that several tasks read, numbered over the whole file."""
    rows = RT.extract_lines(spark, mixed_files(spark, sf_dir, "ndjson"), order_recipe("ndjson"), split=PIECE).data
    return rows.select(key_of().alias("nation"), "record_num", "order_id", "urgent")


@query("""SELECT CASE WHEN o_orderkey % 9 = 0 THEN 'broken' WHEN o_orderkey % 4 = 0 THEN 'late' ELSE 'sound' END AS kind, recipe, CASE WHEN o_orderkey % 9 = 0 OR recipe = 'strict' AND o_orderkey % 4 = 0 THEN 'failed' ELSE 'applied' END AS disposition, CASE WHEN o_orderkey % 9 = 0 THEN 'parse_error' WHEN recipe = 'strict' AND o_orderkey % 4 = 0 THEN 'validation_error' END AS reason, count(*) AS documents, CAST(sum(CASE WHEN o_orderkey % 9 = 0 OR recipe = 'strict' AND o_orderkey % 4 = 0 THEN 0 ELSE 1 END) AS BIGINT) AS records FROM orders, (VALUES ('strict'), ('loose')) v(recipe) GROUP BY ALL""")
def recipes_and_documents(spark, sf_dir):
    """Dispositions by recipe and document: a document that one recipe refuses may be applied by another."""
    from .extract import extract_many
    from .queries import order_xml

    late = F.when(F.col("doc") % 9 == 0, "broken").when(F.col("doc") % 4 == 0, "late").otherwise("sound")
    docs = order_xml(spark, sf_dir, lines=False).select(late.alias("kind"), "doc", F.when(F.col("doc") % 9 == 0, F.lit("<a>")).when(F.col("doc") % 4 == 0, F.regexp_replace("content", "<Priority>[^<]*", "<Priority>")).otherwise(F.col("content")).alias("content"))
    maps = {"match_selectors": [{"xpath": "//Order"}], "field_mappings": [field("id", "@id"), field("priority", "Priority")]}
    strict = build({"record_type": "strict", **maps, "output_schema": {"properties": {"priority": {"minLength": 1}}}})
    made = extract_many(docs, [strict, build({"record_type": "loose", **maps})])
    parts = [e.dispositions.withColumn("recipe", F.lit(n)) for n, e in made.items()]
    return parts[0].unionByName(parts[1]).groupBy("kind", "recipe", "disposition", "reason").agg(F.count("*").alias("documents"), F.sum("records").alias("records"))


@query(f"""WITH r AS (SELECT c_nationkey AS nation, o_orderkey, strlen({ORDER_SQL}) AS size, row_number() OVER w AS n, 62 + coalesce(sum(strlen({ORDER_SQL}) + 1) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos {_ORDERS_OF} WHERE c_nationkey % 7 <> 0 WINDOW w AS (PARTITION BY c_nationkey ORDER BY o_orderkey)),
s AS (SELECT nation, CASE WHEN n <= 3 THEN n - 1 ELSE n % 3 END AS slot, arg_max(pos, n) AS pos FROM r GROUP BY 1, 2)
SELECT nation, count(*) AS records, CAST(sum(size) AS BIGINT) AS bytes, CAST(min(pos) AS BIGINT) AS first_offset, CAST(count(*) FILTER (size > 74) AS BIGINT) AS large_records, (SELECT string_agg(CAST(CAST(pos AS BIGINT) AS VARCHAR), ' ' ORDER BY slot) FROM s WHERE s.nation = r.nation) AS samples, CASE WHEN count(*) >= 10000 THEN 'high' WHEN count(*) >= 1000 THEN 'medium' ELSE 'low' END AS streaming FROM r GROUP BY nation""")
def record_boundaries(spark, sf_dir):
    """Counts, offsets and advice for the records of large files."""
    from lodestone.operators import inspect as IN

    ix = IX.build_index(listed(spark, xml_files(spark, sf_dir)), "Order", piece=PIECE)
    return IN.boundaries(ix.records, 74).select(key_of().alias("nation"), "records", "bytes", "first_offset", "large_records", F.concat_ws(" ", "sample_offsets").alias("samples"), "streaming")


@query(f"""SELECT c_nationkey AS nation, row_number() OVER (PARTITION BY c_nationkey ORDER BY o_orderkey) AS record_num, CAST(strlen({ORDER_SQL}) AS BIGINT) AS size_bytes {_ORDERS_OF} WHERE c_nationkey % 7 <> 0 ORDER BY size_bytes DESC, 'key=' || CAST(c_nationkey AS VARCHAR) || '/', record_num LIMIT 5""")
def largest_records(spark, sf_dir):
    from lodestone.operators import inspect as IN

    ix = IX.build_index(listed(spark, xml_files(spark, sf_dir)), "Order", piece=PIECE)
    return IN.largest(ix.records, 5).select(key_of().alias("nation"), "record_num", "size_bytes")


# ---- recipes that Columns can say: Spark's own reader, no Python on the data --------------------------------------


def order_files(spark: SparkSession, sf_dir: str, lines: bool = True) -> str:
    """Orders in XML files of a thousand keys each."""
    from .queries import order_texts

    own = order_texts(spark, sf_dir, lines).select(F.floor(F.col("doc") / 1000).cast("int").alias("key"), F.regexp_replace("content", "^<Orders>|</Orders>$", "").alias("x"))
    docs = own.groupBy("key").agg(F.concat_ws("\n", F.collect_list("x")).alias("x"))
    return files_of(docs.select("key", F.concat(F.lit("<Orders>"), F.col("x"), F.lit("</Orders>")).alias("content")))


def native(spark: SparkSession, path: str, maps: list[dict], selector: str = "//Order") -> DataFrame:
    """The fields of a recipe that needs no evaluator."""
    from .extract import extract
    from .native import scan_native

    r = build({"record_type": "order", "match_selectors": [{"xpath": selector}], "field_mappings": maps})
    return extract(scan_native(spark, path, r), r, settle=False, scanned=True).data


ID = field("order_id", "@id", "integer")


@query("""SELECT o_orderkey AS order_id, o_orderstatus AS status, o_totalprice AS total, CAST(o_custkey AS VARCHAR) AS customer, o_orderpriority AS priority FROM orders""")
def native_records(spark, sf_dir):
    maps = [ID, field("status", "@status"), field("total", "Total", "number"), field("customer", "Customer"), field("priority", "Priority")]
    return native(spark, order_files(spark, sf_dir, False), maps).select("order_id", "status", "total", "customer", "priority")


@query("""SELECT l_orderkey AS order_id, CAST(l_linenumber AS BIGINT) AS no, l_partkey AS part, l_returnflag AS flag, l_quantity AS quantity, l_extendedprice AS price FROM lineitem JOIN orders ON o_orderkey = l_orderkey""")
def native_item_mapping(spark, sf_dir):
    items = [field("no", "@no", "integer"), field("part", "@part", "integer"), field("flag", "Flag"), field("quantity", "Quantity", "number"), field("price", "Price", "number")]
    rows = native(spark, order_files(spark, sf_dir), [ID, field("lines", "Lines/Line", "array", item_mapping=items)])
    return rows.select("order_id", F.explode("lines").alias("l")).select("order_id", "l.no", "l.part", "l.flag", "l.quantity", "l.price")


@query("""SELECT o_orderkey AS order_id, o_totalprice AS total FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 1000""")
def native_predicate_selector(spark, sf_dir):
    return native(spark, order_files(spark, sf_dir, False), [ID, field("total", "Total", "number")], "//Order[@status='F' and Total > 1000]").select("order_id", "total")


@query("""SELECT l_orderkey AS order_id, count(*) AS lines, CAST(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS BIGINT) AS returned, round(sum(l_quantity), 6) AS quantity FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1""")
def native_count_and_sum(spark, sf_dir):
    maps = [ID, field("lines", "count(Lines/Line)", "integer"), field("returned", "count(Lines/Line[Flag='R'])", "integer"), field("quantity", "sum(Lines/Line/Quantity)", "number")]
    return native(spark, order_files(spark, sf_dir), maps, "//Order[Lines/Line]").select("order_id", "lines", "returned", F.round("quantity", 6).alias("quantity"))


@query("""SELECT o_orderkey AS order_id, EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') AS returned, o_orderpriority LIKE '%T' AS ends_t, contains(o_orderpriority, 'IG') AS has_ig, o_totalprice > 100000 AS dear, false AS has_note FROM orders""")
def native_booleans(spark, sf_dir):
    maps = [ID, field("returned", "Lines/Line[Flag='R']", "boolean", transform="exists"), field("ends_t", "ends-with(Priority, 'T')", "boolean"), field("has_ig", "contains(Priority, 'IG')", "boolean"), field("dear", "boolean(Total[. > 100000])", "boolean"), field("has_note", "Note", "boolean", transform="exists")]
    return native(spark, order_files(spark, sf_dir), maps).select("order_id", "returned", "ends_t", "has_ig", "dear", "has_note")


@query("""SELECT o_orderkey AS order_id, CAST(o_orderkey AS VARCHAR) || '/' || o_orderpriority AS joined, lower(o_orderpriority) AS low, split_part(o_orderpriority, '-', 1) AS before, substr(o_orderpriority, strpos(o_orderpriority, '-') + 1) AS after, CAST(strlen(o_orderpriority) AS BIGINT) AS size, upper(o_orderstatus) AS status FROM orders""")
def native_strings(spark, sf_dir):
    maps = [ID, field("joined", "concat(@id, '/', Priority)"), field("low", "lower-case(Priority)"), field("before", "substring-before(Priority, '-')"), field("after", "substring-after(Priority, '-')"), field("size", "string-length(Priority)", "integer"), field("status", "normalize-space(@status)", transform="upper")]
    return native(spark, order_files(spark, sf_dir, False), maps).select("order_id", "joined", "low", "before", "after", "size", "status")


# ---- inputs and sinks -------------------------------------------------------------------------------------------


def nation_files(spark: SparkSession, sf_dir: str, **options) -> str:
    """A small XML file for each nation, with its suppliers."""
    s = t(spark, sf_dir, "supplier").select("s_nationkey", F.struct("s_suppkey", F.concat(F.lit('<Order id="'), F.col("s_suppkey").cast("string"), F.lit('"><Name>'), F.col("s_name"), F.lit("</Name></Order>")).alias("x")).alias("p"))
    rows = s.groupBy("s_nationkey").agg(F.concat_ws("", F.sort_array(F.collect_list("p"))["x"]).alias("x"))
    n = t(spark, sf_dir, "nation").join(rows, F.col("n_nationkey") == F.col("s_nationkey"), "left").select(F.col("n_nationkey").alias("key"), F.concat(F.lit("<R>"), F.coalesce("x", F.lit("")), F.lit("</R>")).alias("content"))
    path = fresh_path(spark, "nations")
    n.repartition("key").write.partitionBy("key").options(**options).text(path)
    return path + "/*"


def supplier_recipe(**manifest) -> Recipe:
    return build({"record_type": "supplier", "match_selectors": [{"xpath": "//Order"}], "field_mappings": [field("supp", "@id", "integer"), field("name", "Name", description="the supplier's name")]}, None, manifest)


_PATH = "'key=' || CAST(n_nationkey AS VARCHAR) || '/'"


@query("SELECT s_nationkey AS nation, s_suppkey AS supp, s_name AS name FROM supplier")
def gzip_inputs(spark, sf_dir):
    """Compressed files are read as they are named."""
    from lodestone.sources.scan import read_files

    from .extract import extract

    return extract(read_files(spark, nation_files(spark, sf_dir, compression="gzip")), supplier_recipe()).data.select(key_of().alias("nation"), "supp", "name")


@query(f"SELECT n_nationkey AS nation, row_number() OVER (ORDER BY {_PATH}) AS input_ordinal, CAST(7 + coalesce(s, 0) + 1 AS BIGINT) AS size_bytes FROM nation LEFT JOIN (SELECT s_nationkey, sum(strlen(CAST(s_suppkey AS VARCHAR)) + strlen(s_name) + 34) AS s FROM supplier GROUP BY 1) ON s_nationkey = n_nationkey")
def input_ordinals(spark, sf_dir):
    """Inputs are numbered by their paths."""
    from lodestone.sources.scan import read_files

    return read_files(spark, nation_files(spark, sf_dir)).select(key_of().alias("nation"), "input_ordinal", "size_bytes")


@query("""SELECT n_nationkey AS nation, CASE WHEN n_nationkey % 3 = 0 THEN 'failed' ELSE 'applied' END AS disposition, CASE WHEN n_nationkey % 3 = 0 THEN 'input_unavailable' END AS reason, CASE WHEN n_nationkey % 6 = 3 THEN 'sha256_mismatch' WHEN n_nationkey % 6 = 0 THEN 'size_mismatch' END AS error, CASE WHEN n_nationkey % 3 = 0 THEN 0 ELSE coalesce(n, 0) END AS records FROM nation LEFT JOIN (SELECT s_nationkey, count(*) AS n FROM supplier GROUP BY 1) ON s_nationkey = n_nationkey UNION ALL SELECT -1, 'failed', 'input_unavailable', 'input_unavailable', 0""")
def file_lists(spark, sf_dir):
    """Inputs of a list: those that are missing, or of another size or digest than declared, fail alone."""
    from lodestone.sources.inputs import Declared, read_list
    from lodestone.sources.scan import read_files

    files = read_files(spark, nation_files(spark, sf_dir)).select("source_file", "size_bytes", "input_sha256", key_of().alias("k")).orderBy("k").collect()  # a row a nation
    declared = [Declared(j, f["source_file"], f["size_bytes"] + (f["k"] % 6 == 0), "0" * 64 if f["k"] % 6 == 3 else f["input_sha256"]) for j, f in enumerate(files, 1)]
    declared.append(Declared(len(declared) + 1, files[0]["source_file"].rsplit("/", 2)[0] + "/key=-1/none.xml"))
    e = RT.extract_files(spark, read_list(spark, declared), supplier_recipe())
    return e.dispositions.select(key_of().alias("nation"), "disposition", "reason", "error", "records")


@query("""SELECT s_suppkey AS supp, s_nationkey AS code, n_name AS nation, r_name AS region, s_nationkey % 2 = 0 AS even FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey""")
def reference_files(spark, sf_dir):
    """Reference tables of the three formats, by their files."""
    from lodestone.sources import reference as R

    from .extract import extract

    base = fresh_path(spark, "reference")
    n = t(spark, sf_dir, "nation")
    n.select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name")).write.option("header", True).csv(f"{base}/a.csv")
    n.join(t(spark, sf_dir, "region"), F.col("r_regionkey") == F.col("n_regionkey")).select(F.col("n_nationkey").alias("key"), F.col("r_name").alias("name")).write.option("header", True).option("sep", "\t").csv(f"{base}/b.tsv")
    n.where("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("key")).write.json(f"{base}/c.ndjson")
    tables = [R.load(spark, {"name": k, "source": f"{base}/{f}", "format": f.split(".")[1], **c}) for k, f, c in (("names", "a.csv", {"key_column": "key", "value_column": "name"}), ("regions", "b.tsv", {"key_column": "key", "value_column": "name"}), ("evens", "c.ndjson", {"column": "key"}))]
    docs = t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("doc"), F.concat(F.lit("<O><k>"), F.col("s_nationkey").cast("string"), F.lit("</k></O>")).alias("content"))
    maps = [field("k", "k"), field("code", "k", "integer"), *(field(n, type=k, expression=x) for n, k, x in (("nation", "string", "lookup_reference('names', k, '')"), ("region", "string", "lookup_reference('regions', k, '')"), ("even", "boolean", "in_reference('evens', k)")))]
    r = build({"record_type": "o", "match_selectors": [{"xpath": "//O"}], "field_mappings": maps})
    return extract(docs, r, references=tables).data.select(F.col("doc").alias("supp"), "code", "nation", "region", "even")


@query("SELECT s_suppkey AS supp, 'the supplier''s name' AS comment FROM supplier")
def parquet_projection(spark, sf_dir):
    """Data as Parquet, a column withheld, descriptions kept, read back."""
    from lodestone.operators import sinks as S
    from lodestone.sources.scan import read_files

    from .extract import extract

    e = extract(read_files(spark, nation_files(spark, sf_dir)), supplier_recipe())
    path = fresh_path(spark, "parquet")
    S.write_parquet(e, f"{path}/all")
    S.write_parquet(e, f"{path}/less", withhold=["name"])
    note = spark.read.parquet(f"{path}/all").schema["name"].metadata["comment"]
    return spark.read.parquet(f"{path}/less").withColumn("comment", F.lit(note))


_SUPPLIER_JSON = """'{"name":"' || s_name || '","supp":' || CAST(s_suppkey AS VARCHAR) || '}'"""


@query(f"SELECT s_nationkey AS nation, {_SUPPLIER_JSON} AS data FROM supplier")
def ndjson_by_input(spark, sf_dir):
    """Envelopes as lines, a folder for each input, read back."""
    from lodestone.operators import sinks as S
    from lodestone.sources.scan import read_files

    from .extract import extract

    docs = read_files(spark, nation_files(spark, sf_dir)).select(key_of().alias("nation"), "content")
    path = fresh_path(spark, "lines")
    S.write_ndjson(extract(docs, supplier_recipe()), path)
    return spark.read.text(path).select("input", F.regexp_extract("value", r'"data":(\{[^}]*\})', 1).alias("data")).select(F.col("input").cast("int").alias("nation"), "data")


@query(f"""WITH o AS (SELECT row_number() OVER (ORDER BY {_PATH}) AS ordinal, n_nationkey FROM nation), r AS (SELECT (row_number() OVER (ORDER BY ordinal, s_suppkey) - 1) // 7 AS shard, ordinal FROM supplier JOIN o ON n_nationkey = s_nationkey) SELECT CAST(shard AS BIGINT) AS shard, 'shard-' || lpad(CAST(shard AS VARCHAR), 6, '0') || '.ndjson' AS file, count(*) AS rows, CAST(min(ordinal) AS VARCHAR) AS first_input, CAST(max(ordinal) AS VARCHAR) AS last_input, true AS whole FROM r GROUP BY 1, 2""")
def shard_manifest(spark, sf_dir):
    """Shards that tasks hash while they write them: the manifest's figures, and whether the files are what it says."""
    from lodestone.operators import sinks as S
    from lodestone.sources.scan import read_files

    from .extract import extract

    path = fresh_path(spark, "run")
    m = S.write_shards(extract(read_files(spark, nation_files(spark, sf_dir)), supplier_recipe()), path, 7)
    told = spark.createDataFrame([tuple(s[k] for k in ("shard", "file", "rows", "first_input", "last_input", "bytes", "sha256")) for s in m["shards"]], "shard long, file string, rows long, first_input string, last_input string, bytes long, sha256 string")
    there = spark.read.format("binaryFile").load(f"{path}/shards").select(F.element_at(F.split("path", "/"), -1).alias("f"), F.sha2("content", 256).alias("h"), "length")
    return told.join(there, F.col("file") == F.col("f"), "left").select("shard", "file", "rows", "first_input", "last_input", (F.coalesce("h", F.lit("")).eqNullSafe(F.col("sha256")) & F.col("length").eqNullSafe(F.col("bytes"))).alias("whole"))


@query("""SELECT CAST(s_nationkey AS VARCHAR) AS value, count(*) AS n FROM supplier WHERE s_nationkey % 4 <> 0 GROUP BY 1""")
def profile_of_a_run(spark, sf_dir):
    """The value profile in a run's manifest: inputs that failed have no part in it."""
    from lodestone.operators import sinks as S
    from lodestone.sources.scan import read_files

    from .extract import extract

    docs = read_files(spark, nation_files(spark, sf_dir)).withColumn("content", F.when(key_of() % 4 == 0, F.expr("substr(content, 1, length(content) - 3)")).otherwise(F.col("content")))
    r = supplier_recipe(defaults={"source_extraction": [{"source": "absolute_path", "pattern": r"/key=(?P<nation>\d+)/"}], "value_profile": {"fields": [{"field": "nation", "safe_to_profile": True, "sensitivity": "public"}, {"field": "name"}]}})
    m = S.write_shards(extract(docs, r), fresh_path(spark, "run"), 50)
    return spark.createDataFrame(sorted(m["value_profile"]["nation"]["values"].items()), "value string, n long")


@query("""WITH s AS (SELECT CAST((row_number() OVER (ORDER BY n_nationkey) - 1) // 3 AS BIGINT) AS shard FROM nation) SELECT DISTINCT 'strict' AS rung, 'shard-' || lpad(CAST(shard AS VARCHAR), 6, '0') || '.ndjson' AS what, CASE shard % 4 WHEN 0 THEN 'its digest differs' WHEN 1 THEN 'its size differs' ELSE 'its rows differ' END AS problem FROM s WHERE shard % 4 < 3
UNION ALL SELECT 'sidecars', 'manifest', 'the rows of its shards aren''t its records' UNION ALL SELECT 'sidecars', 'dispositions', (SELECT CAST(count(*) AS VARCHAR) FROM nation) || ' inputs applied, the manifest has ' || (SELECT CAST(count(*) - 1 AS VARCHAR) FROM nation) UNION ALL SELECT 'sidecars', 'dispositions', '0 inputs failed, the manifest has 1'""")
def output_validation(spark, sf_dir):
    """All rungs of the checks of a run's output, against a manifest that says other things of its shards."""
    from lodestone.operators import artifacts as A
    from lodestone.operators import sinks as S

    from .extract import extract

    docs = t(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("doc"), F.concat(F.lit("<O><n>"), F.col("n_name"), F.lit("</n></O>")).alias("content"))
    e = extract(docs, build({"record_type": "o", "match_selectors": [{"xpath": "//O"}], "field_mappings": [field("n", "n")]}))
    path = fresh_path(spark, "run")
    m = S.write_shards(e, path, 3)
    S.write_dispositions(e, path)
    S.write_json(e.rows, f"{path}/artifact", A.descriptor(e, path, "ndjson"))
    if A.validate_output(spark, path, "strict").count():
        raise ValueError("a sound output has problems")
    for s in m["shards"]:
        k = s["shard"] % 4
        s |= {"sha256": s["sha256"][::-1]} if k == 0 else {"bytes": s["bytes"] + 1} if k == 1 else {"rows": s["rows"] + 1} if k == 2 else {}
    m |= {"inputs_applied": m["inputs_applied"] - 1, "inputs_failed": 1}
    return A.validate_output(spark, path, "strict", m)
