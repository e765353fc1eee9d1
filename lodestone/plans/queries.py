"""Registered queries of the extraction engine, each with SQL that gives the same rows from the relational tables.

Documents are rendered from the tables by Spark, extracted by recipes, and compared with plain SQL over the tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.expressions import Scope, Typed, compile_expression
from lodestone.functions.transforms import apply_transform
from lodestone.operators import inspect as IN
from lodestone.operators import profile as P
from lodestone.operators import sinks as S
from lodestone.operators import validation as V
from lodestone.sources import inputs as I
from lodestone.sources import reference as R

from .extract import Extraction, envelope, extract
from .recipe import Recipe, build

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Registers a function under its name, with its SQL."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = " ".join(sql.split())
        return f

    return add


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def field(name: str, xpath: str = "", type: str = "string", **more) -> dict:  # noqa: A002
    return {"output_field": name, "type": type, **({"xpath": xpath} if xpath else {}), **more}


def recipe(mappings: list[dict], selector: str = "//Order", signature: dict | None = None, defaults: dict | None = None, **more) -> Recipe:
    return build({"record_type": "order", "match_selectors": [{"xpath": selector}], "field_mappings": mappings, **more}, signature, {"defaults": defaults or {}})


JSON = {"format_type": "json"}


# ---- documents rendered from the tables -------------------------------------------------------------------------


#: Documents of a task.
SPREAD = 50_000


def spread(docs: DataFrame) -> DataFrame:
    """Documents dealt over all cores: a small table is one split, and the scan's work is in the Python behind it.

    Large ones go to more tasks, of about ``SPREAD`` documents, so that what a task groups or sorts doesn't grow with the table.
    """
    return docs.repartition(max(docs.sparkSession.sparkContext.defaultParallelism, -(-docs.count() // SPREAD)))


def element(name: str, value: Column) -> Column:
    text = F.replace(F.replace(value.cast("string"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    return F.concat(F.lit(f"<{name}>"), text, F.lit(f"</{name}>"))


def line_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(l_orderkey, lines): the lines of an order as XML, in line order."""
    x = F.concat(
        F.lit('<Line no="'), F.col("l_linenumber").cast("string"), F.lit('" part="'), F.col("l_partkey").cast("string"), F.lit('">'),
        element("Quantity", F.col("l_quantity")), element("Price", F.col("l_extendedprice")), element("Discount", F.col("l_discount")), element("Flag", F.col("l_returnflag")), F.lit("</Line>"),
    )
    rows = t(spark, sf_dir, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_partkey", x.alias("x")).alias("p"))
    return rows.groupBy("l_orderkey").agg(F.concat_ws("", F.sort_array(F.collect_list("p"))["x"]).alias("lines"))


def order_xml(spark: SparkSession, sf_dir: str, lines: bool = True) -> DataFrame:
    """One document per order: doc (its key), content."""
    return spread(order_texts(spark, sf_dir, lines))


def order_texts(spark: SparkSession, sf_dir: str, lines: bool = True) -> DataFrame:
    """The same where the rows of the tables lie: for those who deal them by a key of their own."""
    o = t(spark, sf_dir, "orders")
    if lines:
        o = o.join(line_elements(spark, sf_dir), o.o_orderkey == F.col("l_orderkey"), "left")
    body = F.concat(
        F.lit('<Orders><Order id="'), F.col("o_orderkey").cast("string"), F.lit('" status="'), F.col("o_orderstatus"), F.lit('">'),
        element("Customer", F.col("o_custkey")), element("Total", F.col("o_totalprice")), element("Priority", F.col("o_orderpriority")),
        F.concat(F.lit("<Lines>"), F.coalesce("lines", F.lit("")), F.lit("</Lines>")) if lines else F.lit(""), F.lit("</Order></Orders>"),
    )
    return o.select(F.col("o_orderkey").alias("doc"), body.alias("content"))


def customer_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One document per customer with orders: a section that holds the orders by key."""
    x = F.concat(F.lit('<Order id="'), F.col("o_orderkey").cast("string"), F.lit('">'), F.when(F.col("o_orderkey") % 2 == 0, F.concat(element("Beta", F.col("o_orderstatus")), element("Alpha", F.col("o_orderpriority")))).otherwise(element("Alpha", F.col("o_orderpriority"))), F.lit("</Order>"))
    rows = t(spark, sf_dir, "orders").select("o_custkey", F.struct("o_orderkey", x.alias("x")).alias("p")).groupBy("o_custkey").agg(F.concat_ws("", F.sort_array(F.collect_list("p"))["x"]).alias("x"))
    return spread(rows.select(F.col("o_custkey").alias("doc"), F.concat(F.lit('<Shop><Section code="C'), F.col("o_custkey").cast("string"), F.lit('">'), F.col("x"), F.lit("</Section></Shop>")).alias("content")))


def event_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON document per event; the amount keeps a lexeme with two more zeros; odd events have a null and an empty array."""
    e = t(spark, sf_dir, "events")
    odd = F.col("event_id") % 2 == 1
    body = F.concat(
        F.lit('{"Event":{"id":'), F.col("event_id").cast("string"), F.lit(',"type":"'), F.col("event_type"), F.lit('","amount":'), F.floor("value").cast("string"), F.lit('.00,"props":'), F.col("props"),
        F.when(odd, F.lit(',"note":null,"tags":[]')).otherwise(F.concat(F.lit(',"note":"n'), F.col("user_id").cast("string"), F.lit('","tags":["a",null,"b"]'))), F.lit("}}"),
    )
    return spread(e.select(F.col("event_id").alias("doc"), body.alias("content")))


LINES = field("lines", "Lines/Line", "array", item_mapping=[field("no", "@no", "integer"), field("part", "@part", "integer"), field("flag", "Flag"), field("quantity", "Quantity", "number"), field("price", "Price", "number"), field("discount", "Discount", "number")])
BASIC = [field("order_id", "@id", "integer"), field("status", "@status"), field("total", "Total", "number")]


def run(spark: SparkSession, docs: DataFrame, r: Recipe, **more) -> Extraction:
    return extract(docs, r, **more)


# ---- scans, selectors and mappings ------------------------------------------------------------------------------


@query("""SELECT o_orderkey AS order_id, o_orderstatus AS status, o_totalprice AS total, CAST(o_custkey AS VARCHAR) AS customer, o_orderpriority AS priority FROM orders""")
def xml_records_basic(spark, sf_dir):
    r = recipe([*BASIC, field("customer", "Customer"), field("priority", "Priority")])
    return run(spark, order_xml(spark, sf_dir, lines=False), r).data.select("order_id", "status", "total", "customer", "priority")


@query("""SELECT l_orderkey AS order_id, CAST(l_linenumber AS BIGINT) AS no, l_partkey AS part, l_returnflag AS flag, l_quantity AS quantity, l_extendedprice AS price FROM lineitem JOIN orders ON o_orderkey = l_orderkey""")
def xml_item_mapping(spark, sf_dir):
    rows = run(spark, order_xml(spark, sf_dir), recipe([*BASIC, LINES])).data
    return rows.select("order_id", F.explode("lines").alias("l")).select("order_id", "l.no", "l.part", "l.flag", "l.quantity", "l.price")


@query("""SELECT l_orderkey AS order_id, CASE WHEN l_returnflag = 'N' THEN 'sale' ELSE 'return' END AS item_type, count(*) AS n, CAST(min(l_partkey) AS VARCHAR) IS NOT NULL AS has_part FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1, 2""")
def xml_polymorphic(spark, sf_dir):
    maps = [field("part", "@part", "integer")]
    poly = field("events", "Lines", "array", polymorphic_mapping=[{"item_type": "sale", "match_xpath": "Line[Flag='N']", "field_mappings": maps}, {"item_type": "return", "match_xpath": "Line[Flag!='N']", "field_mappings": [*maps, field("why", "Flag")]}])
    rows = run(spark, order_xml(spark, sf_dir), recipe([BASIC[0], poly])).data
    return rows.select("order_id", F.explode("events").alias("e")).groupBy("order_id", "e.item_type").agg(F.count("*").alias("n"), F.min("e.part").isNotNull().alias("has_part"))


@query("""SELECT o_orderkey AS order_id, o_totalprice AS total FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 1000""")
def xml_predicate_selector(spark, sf_dir):
    return run(spark, order_xml(spark, sf_dir, lines=False), recipe([BASIC[0], BASIC[2]], "//Order[@status='F' and Total > 1000]")).data.select("order_id", "total")


@query("""SELECT o_orderkey AS order_id, 'C' || CAST(o_custkey AS VARCHAR) AS section, coalesce(CAST(lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS VARCHAR), '') AS before, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS record_num FROM orders""")
def xml_ancestor_and_sibling(spark, sf_dir):
    r = recipe([BASIC[0], field("section", "ancestor::Section[1]/@code"), field("before", "string(preceding-sibling::Order[1]/@id)")])
    return run(spark, customer_xml(spark, sf_dir), r).data.select("order_id", "section", "before", "record_num")


@query("""SELECT o_orderkey AS order_id, CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus ELSE o_orderpriority END AS first_of, o_orderpriority AS preferred FROM orders""")
def xml_union_order(spark, sf_dir):
    r = recipe([BASIC[0], field("first_of", "(Alpha | Beta)[1]"), field("preferred", "(Alpha | Beta[not(../Alpha)])[1]")])
    return run(spark, customer_xml(spark, sf_dir), r).data.select("order_id", "first_of", "preferred")


@query("""SELECT o_orderkey AS order_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS record_num FROM orders WHERE o_orderpriority > '3' QUALIFY true""".replace("WHERE o_orderpriority > '3' QUALIFY true", "QUALIFY o_orderpriority > '3'"))
def record_num_gaps(spark, sf_dir):
    r = recipe([BASIC[0], field("priority", "Alpha")], filters={"priority": "> 3"})
    return run(spark, customer_xml(spark, sf_dir), r).data.select("order_id", "record_num")


@query("""SELECT event_id AS id, event_type AS type, CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) || '.00' AS lexeme, CAST(floor(value) AS DOUBLE) AS amount, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CASE WHEN event_id % 2 = 0 THEN 'n' || CAST(user_id AS VARCHAR) END AS note, CASE WHEN event_id % 2 = 0 THEN 'a,b' END AS tags FROM events""")
def json_records(spark, sf_dir):
    r = recipe([field("id", "id", "integer"), field("type", "type"), field("lexeme", "amount"), field("amount", "amount", "number"), field("k", "props/k", "integer"), field("note", "note"), field("tags", "tags", "array")], "/Event", JSON)
    d = run(spark, event_json(spark, sf_dir), r).data
    return d.select("id", "type", "lexeme", "amount", "k", "note", F.when(F.col("tags").isNotNull(), F.concat_ws(",", "tags")).alias("tags"))


@query("""SELECT user_id AS doc, event_id AS id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS record_num FROM events""")
def ndjson_records(spark, sf_dir):
    e = t(spark, sf_dir, "events").select("user_id", F.struct("event_id", F.concat(F.lit('{"id":'), F.col("event_id").cast("string"), F.lit("}")).alias("x")).alias("p"))
    docs = e.groupBy("user_id").agg(F.concat_ws("\n\n", F.sort_array(F.collect_list("p"))["x"]).alias("content")).withColumnRenamed("user_id", "doc")
    r = recipe([field("id", "id", "integer")], "record", {"format_type": "ndjson", "match_scope": "record"})
    return run(spark, docs, r).data.select("doc", "id", "record_num")


@query("""SELECT 'xml' AS format, count(*) AS n, count(DISTINCT o_orderkey) AS keys, CAST(sum(o_custkey) AS BIGINT) AS customers FROM orders UNION ALL SELECT 'json', count(*), count(DISTINCT o_orderkey), CAST(sum(o_custkey) AS BIGINT) FROM orders""")
def xml_json_twins(spark, sf_dir):
    o = t(spark, sf_dir, "orders")
    docs = o.select(F.col("o_orderkey").alias("doc"), F.concat(F.lit('{"Orders":{"Order":[{"id":"'), F.col("o_orderkey").cast("string"), F.lit('","Customer":'), F.col("o_custkey").cast("string"), F.lit("}]}}")).alias("content"))
    x = run(spark, order_xml(spark, sf_dir, lines=False), recipe([BASIC[0], field("customer", "Customer", "integer")])).data
    j = run(spark, docs, recipe([field("order_id", "id", "integer"), field("customer", "Customer", "integer")], signature=JSON)).data
    agg = lambda d, f: d.agg(F.lit(f).alias("format"), F.count("*").alias("n"), F.countDistinct("order_id").alias("keys"), F.sum("customer").alias("customers"))
    return agg(x, "xml").union(agg(j, "json"))


@query("""SELECT p_partkey AS id, split_part(p_type, ' ', 1) AS head, CASE WHEN strpos(p_type, ' ') > 0 THEN substr(p_type, strpos(p_type, ' ') + 1) ELSE '' END AS tail, lower(p_brand) AS brand, starts_with(p_name, 'a') AS a_name, regexp_matches(p_brand, '#[1-3]') AS low_brand, regexp_replace(p_brand, '^[A-Za-z]+#([0-9])([0-9])$', '\\2-\\1') AS swapped, CAST(length(p_name) AS BIGINT) AS size, trim(substr(p_name, 2, 3)) AS middle, translate(p_brand, 'Bd', 'b') AS moved FROM part""")
def xpath_strings_and_regex(spark, sf_dir):
    p = t(spark, sf_dir, "part")
    docs = p.select(F.col("p_partkey").alias("doc"), F.concat(F.lit('<P id="'), F.col("p_partkey").cast("string"), F.lit('">'), element("Type", F.col("p_type")), element("Brand", F.col("p_brand")), element("Name", F.col("p_name")), F.lit("</P>")).alias("content"))
    head = "substring-before(concat(Type, ' '), ' ')"
    r = recipe(
        [field("id", "@id", "integer"), field("head", head), field("tail", "substring-after(Type, ' ')"), field("brand", "lower-case(Brand)"), field("a_name", "starts-with(Name, 'a')", "boolean"), field("low_brand", "matches(Brand, '#[1-3]')", "boolean"),
         field("swapped", "replace(Brand, '^[A-Za-z]+#([0-9])([0-9])$', '$2-$1')"), field("size", "string-length(Name)", "integer"), field("middle", "substring(Name, 2, 3)"), field("moved", "translate(Brand, 'Bd', 'b')")], "/P",
    )
    return run(spark, spread(docs), r).data.drop("doc", "record_num", "selector")


@query("""SELECT l_orderkey AS order_id, count(*) AS lines, CAST(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS BIGINT) AS returned, round(sum(l_quantity), 6) AS quantity FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1""")
def xpath_count_and_sum(spark, sf_dir):
    r = recipe([BASIC[0], field("lines", "count(Lines/Line)", "integer"), field("returned", "count(Lines/Line[Flag='R'])", "integer"), field("quantity", "sum(Lines/Line/Quantity)", "number")], "//Order[Lines/Line]")
    return run(spark, order_xml(spark, sf_dir), r).data.select("order_id", "lines", "returned", F.round("quantity", 6).alias("quantity"))


@query("""SELECT o_orderkey AS order_id, 'demo' AS tenant, CAST(o_custkey AS VARCHAR) AS shop, '2024' AS year FROM orders""")
def parameters_and_source_fields(spark, sf_dir):
    docs = order_xml(spark, sf_dir, lines=False).join(t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc"), "o_custkey"), "doc").select("doc", F.concat(F.lit("/data/2024/shop-"), F.col("o_custkey").cast("string"), F.lit(".xml")).alias("source_file"), "content")
    src = [{"source": "filename", "pattern": r"^shop-(?P<shop>\d+)\.xml$"}, {"source": "absolute_path", "pattern": r"/(?P<year>\d{4})/"}]
    r = recipe([BASIC[0]], defaults={"parameters": {"tenant": "none"}, "parameters_required": ["tenant"], "source_extraction": src, "source_extraction_required": ["shop"]})
    return run(spark, docs, r, parameters={"tenant": "demo"}).data.select("order_id", "tenant", "shop", "year")


@query("""SELECT o_orderkey AS doc, CASE WHEN o_orderkey % 10 = 0 THEN 'failed' WHEN o_orderkey % 10 = 1 THEN 'not_applicable' ELSE 'applied' END AS disposition, CASE WHEN o_orderkey % 10 = 0 THEN 'parse_error' WHEN o_orderkey % 10 = 1 THEN 'signature_mismatch' END AS reason, CAST(CASE WHEN o_orderkey % 10 > 2 THEN 1 ELSE 0 END AS BIGINT) AS records, CASE WHEN o_orderkey % 10 = 0 THEN NULL WHEN o_orderkey % 10 = 1 THEN CAST(0.25 AS DOUBLE) ELSE 1.0::DOUBLE END AS confidence FROM orders""")
def dispositions_and_signature(spark, sf_dir):
    k = F.col("doc") % 10
    c = F.col("content")
    docs = order_xml(spark, sf_dir, lines=False).select("doc", F.when(k == 0, F.left(c, F.length(c) - 9)).when(k == 1, F.lit("<Other><Order/></Other>")).when(k == 2, F.lit("<Orders><Note/></Orders>")).otherwise(c).alias("content"))
    sig = {"match_patterns": [{"selector": "/Orders", "weight": 3}, {"selector": "count(//*) > 1", "weight": 1}], "confidence_threshold": 0.5}
    return run(spark, docs, recipe([BASIC[0]], signature=sig)).dispositions.select("doc", "disposition", "reason", "records", "confidence")


@query("""SELECT o_custkey AS doc, CASE WHEN count(*) < 10 THEN 'failed' ELSE 'applied' END AS disposition, CASE WHEN count(*) < 10 THEN 0 ELSE count(*) END AS records FROM orders GROUP BY 1""")
def min_occurrences_floor(spark, sf_dir):
    r = build({"record_type": "o", "match_selectors": [{"xpath": "//Order", "min_occurrences": 10}], "field_mappings": [BASIC[0]]})
    return run(spark, customer_xml(spark, sf_dir), r).dispositions.select("doc", "disposition", "records")


@query("""SELECT o_orderkey AS order_id, CASE WHEN o_orderkey % 7 = 0 THEN 0.0 ELSE round(o_totalprice * 100) END AS cents FROM orders""")
def nan_guard(spark, sf_dir):
    o = t(spark, sf_dir, "orders")
    docs = o.select(F.col("o_orderkey").alias("doc"), F.concat(F.lit('<Order id="'), F.col("o_orderkey").cast("string"), F.lit('"><Total> '), F.when(F.col("o_orderkey") % 7 == 0, "TBD").otherwise(F.format_string("%.2f", "o_totalprice")), F.lit(" </Total></Order>")).alias("content"))
    good = r"matches(normalize-space(.), '^-?[0-9]+(\.[0-9]+)?$')"
    r = recipe([BASIC[0], field("ok", good.replace("(.)", "(Total)"), "boolean", internal=True), field("n", f"number(replace(normalize-space(Total[{good}]), '^$', '0'))", "number", internal=True), field("cents", "", "number", expression="ok ? round(n * 100) : 0")])
    return run(spark, docs, r).data.select("order_id", "cents")


@query("""SELECT o_orderkey AS order_id, o_orderstatus AS status FROM orders WHERE o_totalprice <= 200000 AND o_orderstatus IN ('F', 'O')""")
def output_schema_checks(spark, sf_dir):
    schema = {"type": "object", "required": ["order_id", "total"], "properties": {"total": {"type": "number", "maximum": 200000}, "status": {"enum": ["F", "O"]}}}
    return run(spark, order_xml(spark, sf_dir, lines=False), recipe(BASIC, output_schema=schema)).data.select("order_id", "status")


@query("""SELECT 'big' AS recipe, count(*) AS n FROM orders WHERE o_totalprice > 100000 UNION ALL SELECT 'lines', count(*) FROM lineitem JOIN orders ON o_orderkey = l_orderkey""")
def many_recipes(spark, sf_dir):
    """Two recipes over the same documents, each parsed once."""
    from .extract import extract_many

    ids = {"record_type": "big", "match_selectors": [{"xpath": "//Order[Total > 100000]"}], "field_mappings": [BASIC[0]]}
    lines = {"record_type": "lines", "match_selectors": [{"xpath": "//Line"}], "field_mappings": [field("no", "@no")]}
    made = extract_many(order_xml(spark, sf_dir), [build(ids), build(lines)])
    big, other = (e.data.agg(F.lit(n).alias("recipe"), F.count("*").alias("n")) for n, e in made.items())
    return big.union(other)


@query("""SELECT o_orderkey AS order_id, '{"customer":"' || CAST(o_custkey AS VARCHAR) || '","order_id":' || CAST(o_orderkey AS VARCHAR) || ',"status":"' || o_orderstatus || '"}' AS body FROM orders""")
def json_envelope(spark, sf_dir):
    e = run(spark, order_xml(spark, sf_dir, lines=False), recipe([*BASIC[:2], field("customer", "Customer"), field("gone", "Nope")]))
    return envelope(e).select(F.col("doc").alias("order_id"), F.regexp_extract("value", r'"data":(\{.*\})\}\}$', 1).alias("body"))


# ---- expressions ------------------------------------------------------------------------------------------------


def derive(df: DataFrame, **expressions: str) -> DataFrame:
    """Adds expression fields over a DataFrame's own columns, without documents."""
    scope = Scope(V.variables_of(df.schema, lambda n: F.col(f"`{n}`")))
    return df.withColumns({k: compile_expression(e, scope).value for k, e in expressions.items()})


@query("""SELECT l_orderkey, l_linenumber, l_extendedprice * (l_discount / 4.0) AS a, l_extendedprice + (l_tax - l_discount) AS b, (l_quantity - l_tax + l_discount) - l_tax AS c, abs(l_discount - l_tax) AS d FROM lineitem""".replace("(l_quantity - l_tax + l_discount) - l_tax", "(l_quantity - l_tax) + (l_discount - l_tax)"))
def dsl_arithmetic(spark, sf_dir):
    df = t(spark, sf_dir, "lineitem")
    return derive(df, a="l_extendedprice*l_discount/4", b="l_extendedprice+l_tax-l_discount", c="l_quantity-l_tax+l_discount-l_tax", d="abs(l_discount - l_tax)").select("l_orderkey", "l_linenumber", "a", "b", "c", "d")


@query("""SELECT l_orderkey, l_linenumber, round(l_extendedprice) AS r0, round(l_discount * 10.0) / 10.0 AS r1, least(l_tax, l_discount, 0.05) AS low, greatest(l_tax, l_discount) AS high FROM lineitem""")
def dsl_round_min_max(spark, sf_dir):
    df = t(spark, sf_dir, "lineitem")
    return derive(df, r0="round(l_extendedprice)", r1="round(l_discount, 1)", low="min(l_tax, l_discount, 0.05)", high="max(l_tax, l_discount)").select("l_orderkey", "l_linenumber", "r0", "r1", "low", "high")


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 40 THEN 'big' WHEN l_quantity > 20 THEN 'mid' ELSE 'low' END AS size, (l_returnflag = 'R' AND NOT (l_discount >= 0.05)) OR l_tax = 0 AS odd, l_returnflag = '1' AS never FROM lineitem""")
def dsl_ternary_and_logic(spark, sf_dir):
    df = t(spark, sf_dir, "lineitem")
    return derive(df, size='l_quantity > 40 ? "big" : l_quantity > 20 ? "mid" : "low"', odd='(l_returnflag == "R" && !(l_discount >= 0.05)) || l_tax == 0', never="l_returnflag == '1'").select("l_orderkey", "l_linenumber", "size", "odd", "never")


@query("""SELECT c_custkey, repeat('X', greatest(length(c_name) - 4, 0)) || right(c_name, 4) AS tail, left(c_name, 2) || repeat('#', length(c_name) - 5) || right(c_name, 3) AS middle, lower(c_mktsegment) AS low, upper(c_name) AS up, CAST(length(c_name) AS BIGINT) AS size FROM customer""")
def dsl_masks_and_case(spark, sf_dir):
    df = t(spark, sf_dir, "customer")
    return derive(df, tail="mask_tail(c_name, 4)", middle="mask_middle(c_name, 2, 3, '#')", low="lower(c_mktsegment)", up="UPPER(c_name)", size="string_length(c_name)").select("c_custkey", "tail", "middle", "low", "up", "size")


@query("""SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS clean, CAST(length(text) AS BIGINT) AS size FROM documents""")
def dsl_normalize_space(spark, sf_dir):
    return derive(t(spark, sf_dir, "documents"), clean="normalize_space(text)", size="string_length(text)").select("doc_id", "clean", "size")


@query("""SELECT p_partkey, (starts_with(p_type, 'ECONOMY') OR starts_with(p_type, 'PROMO')) AS special, p_brand IN ('Brand#11', 'Brand#23') AS ours FROM part""")
def dsl_list_parameters(spark, sf_dir):
    df = t(spark, sf_dir, "part")
    scope = Scope(V.variables_of(df.schema, lambda n: F.col(n)))
    for name, values in (("heads", ["ECONOMY", "PROMO"]), ("brands", ["Brand#11", "Brand#23"])):
        scope.variables[name] = Typed(F.array(*(F.lit(v) for v in values)), "strings", literal=values)
    return df.select("p_partkey", compile_expression("starts_with_any(p_type, heads)", scope).value.alias("special"), compile_expression("value_in(p_brand, brands)", scope).value.alias("ours"))


def _nations(spark: SparkSession, sf_dir: str) -> list[R.ReferenceTable]:
    n = t(spark, sf_dir, "nation").where("n_regionkey <> 3").select(F.col("n_nationkey").cast("string").alias("code"), "n_name")
    return [R.from_frame(n, {"name": "names", "key_column": "code", "value_column": "n_name", "max_rows": 100}), R.from_frame(n, {"name": "known", "column": "code", "max_rows": 100})]


@query("""SELECT c_custkey AS id, n_nationkey IS NOT NULL AS known, coalesce(n_name, 'elsewhere') AS nation FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_regionkey <> 3) n ON c_nationkey = n_nationkey""")
def reference_lookup(spark, sf_dir):
    c = t(spark, sf_dir, "customer")
    docs = c.select(F.col("c_custkey").alias("doc"), F.concat(F.lit('<C id="'), F.col("c_custkey").cast("string"), F.lit('" nation="'), F.col("c_nationkey").cast("string"), F.lit('"/>')).alias("content"))
    r = recipe([field("id", "@id", "integer"), field("code", "@nation"), field("known", "", "boolean", expression="in_reference('known', code)"), field("nation", "", expression="lookup_reference('names', code, 'elsewhere')")], "/C")
    return run(spark, docs, r, references=_nations(spark, sf_dir)).data.select("id", "known", "nation")


@query("""SELECT c_custkey AS id FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_regionkey <> 3) n ON c_nationkey = n_nationkey WHERE n_nationkey IS NULL""")
def reference_anti(spark, sf_dir):
    c = t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), "c_nationkey")
    return R.probe(c, _nations(spark, sf_dir)[1], F.col("c_nationkey").cast("string"), "p").where("not p.hit").select("id")


# ---- transforms -------------------------------------------------------------------------------------------------


@query("""SELECT c_custkey, left(c_name, 4) || repeat('*', length(c_name) - 4) AS first4, repeat('x', length(c_name) - 3) || right(c_name, 3) AS last3, repeat('*', length(c_name)) AS all_, replace(c_name, 'Customer', 'C') AS short, upper(c_mktsegment) AS up, left(c_name, 2) || repeat('*', length(c_name) - 2) || '@x.org' AS mail, trim(c_name) AS plain, c_name AS bare FROM customer""")
def field_transforms(spark, sf_dir):
    c = F.col("c_name")
    f = apply_transform
    return t(spark, sf_dir, "customer").select(
        "c_custkey", f(c, "blind_string").alias("first4"), f(c, "blind_string", {"mode": "keep_last", "count": 3, "mask_char": "x"}).alias("last3"), f(c, "blind_string", {"mode": "mask_all"}).alias("all_"), f(c, "replace", {"old": "Customer", "new": "C"}).alias("short"),
        f(F.col("c_mktsegment"), "upper").alias("up"), f(F.concat(c, F.lit("@x.org")), "blind_string", {"mode": "keep_domain", "count": 2}).alias("mail"), f(F.concat(F.lit(" \t"), c, F.lit(" \n")), "trim").alias("plain"), f(f(F.concat(F.lit(" \t"), c, F.lit("\n ")), "ltrim"), "rtrim").alias("bare"),
    )


# ---- validation, reconciliation, summaries ----------------------------------------------------------------------


def order_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with nested lines as records: the form that a scan gives, for rules on data that is already typed."""
    lines = t(spark, sf_dir, "lineitem").select("l_orderkey", F.struct(F.col("l_linenumber").alias("no"), F.col("l_returnflag").alias("flag"), F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"), F.col("l_discount").alias("discount")).alias("l"))
    lines = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list("l")).alias("lines"))
    return t(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_orderkey").alias("order_id"), F.col("o_totalprice").alias("total"), F.col("o_orderstatus").alias("status"), "lines")


def checked(df: DataFrame, cfg: dict, later: set[str] = frozenset()) -> V.Validated:
    return V.validate(df, df.schema, Scope(V.variables_of(df.schema, lambda n: F.col(f"`{n}`"))), cfg, later)


@query("""SELECT l_orderkey AS order_id, count(*) AS n, round(sum(l_quantity), 6) AS qty, round(avg(l_quantity), 6) AS mean, min(l_quantity) AS low, max(l_quantity) AS high, count(*) FILTER (l_returnflag = 'R') AS returned, round(coalesce(sum(l_extendedprice) FILTER (l_discount > 0.05 AND l_returnflag <> 'N'), 0), 6) AS cut FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1""")
def accumulations(spark, sf_dir):
    ops = [("qty", "sum"), ("mean", "avg"), ("low", "min"), ("high", "max")]
    accs = [{"name": "n", "operation": "count"}, *({"name": k, "operation": op, "field": "quantity"} for k, op in ops), {"name": "returned", "operation": "increment", "filter": 'flag == "R"'}, {"name": "cut", "operation": "sum", "field": "price", "filter": 'discount > 0.05 && flag != "N"'}]
    v = checked(order_records(spark, sf_dir), {"array_path": "lines", "accumulations": accs})
    one = {k: F.col(f"_acc_{k}") for k in ("n", "low", "high", "returned")} | {k: F.round(F.col(f"_acc_{k}"), 6) for k in ("qty", "mean", "cut")}
    return v.df.select("order_id", *(c.alias(k) for k, c in one.items()))


@query("""SELECT l_orderkey AS order_id, count(*) AS n, round(sum(l_quantity) / count(*), 6) AS mean, round(sum(l_quantity) / count(*) * 2.0, 6) AS twice FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1""")
def aggregation_expressions(spark, sf_dir):
    v = checked(order_records(spark, sf_dir), {"array_path": "lines", "accumulations": [{"name": "n", "operation": "count"}, {"name": "qty", "operation": "sum", "field": "quantity"}], "aggregations": [{"name": "mean", "expression": "qty / n"}, {"name": "twice", "expression": "mean * 2"}]})
    return v.df.select("order_id", F.col("_acc_n").alias("n"), F.round("_agg_mean", 6).alias("mean"), F.round("_agg_twice", 6).alias("twice"))


GROUPED = """WITH g AS (SELECT l_orderkey, l_returnflag, sum(l_extendedprice * (1.0 - l_discount)) AS v FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1, 2), s AS (SELECT l_orderkey, sum(v) AS total FROM g GROUP BY 1)"""


def _grouped(name: str = "by_flag", **more) -> dict:
    return {"name": name, "base_expression": "total", "group_by": {"source": "lines[]", "field": "flag", "value_expression": "price * (1 - discount)", "name_template": "flag_{{group}}", **more}}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as XML documents, extracted, grouped by return flag and reconciled with the order's total by one recipe."""
    r = recipe([*BASIC, LINES], "//Order[Lines/Line]", validation_metadata={"enable": True, "expression_language": "dsl", "array_path": "lines", "reconciliations": [_grouped()]})
    rec = F.col("validation.reconciliations")[0]
    rows = run(spark, order_xml(spark, sf_dir), r).records.select(F.col("data.order_id").alias("order_id"), rec.alias("r"))
    return rows.select("order_id", F.explode("r.components").alias("c"), "r").select("order_id", F.col("c.name").alias("component"), F.round("c.value", 4).alias("value"), F.round("r.residual", 4).alias("residual"), F.col("r.status").alias("status"))


@query(GROUPED + """ SELECT g.l_orderkey AS order_id, 'flag_' || l_returnflag AS component, round(v, 4) AS value, round(o_totalprice - total, 4) AS residual, CASE WHEN abs(o_totalprice - total) > 0.01 THEN 'unbalanced' ELSE 'balanced' END AS status FROM g JOIN s ON g.l_orderkey = s.l_orderkey JOIN orders ON o_orderkey = g.l_orderkey""")
def reconciliation_grouped(spark, sf_dir):
    return flagship(spark, sf_dir)


@query(GROUPED + """ SELECT g.l_orderkey AS order_id, 'flag_' || l_returnflag AS component, round(v * CASE WHEN o_totalprice / 2 < total THEN o_totalprice / 2 / total ELSE 1.0 END, 4) AS value FROM g JOIN s ON g.l_orderkey = s.l_orderkey JOIN orders ON o_orderkey = g.l_orderkey""")
def reconciliation_cap_to_base(spark, sf_dir):
    cfg = {"array_path": "lines", "reconciliations": [_grouped(overflow_strategy="cap_to_base") | {"base_expression": "total / 2"}]}
    v = checked(order_records(spark, sf_dir), cfg)
    return v.df.select("order_id", F.explode("_rec_by_flag.components").alias("c")).select("order_id", F.col("c.name").alias("component"), F.round("c.value", 4).alias("value"))


@query("""SELECT order_id, CASE WHEN r <= 50000 THEN 'balanced' ELSE 'unexplained' END AS status, r <= 50000 AS fine FROM (SELECT o_orderkey AS order_id, abs(o_totalprice - sum(l_extendedprice)) AS r FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey, o_totalprice)""")
def reconciliation_status(spark, sf_dir):
    cfg = {
        "array_path": "lines", "accumulations": [{"name": "sum_price", "operation": "sum", "field": "price"}],
        "reconciliations": [{"name": "rec", "base_expression": "total", "tolerance": 50000, "allow_unexplained": True, "components": [{"name": "lines", "expression": "sum_price"}]}],
        "validations": [{"name": "fine", "rule": "rec_status == 'balanced'", "severity": "info"}],
    }
    v = checked(order_records(spark, sf_dir), cfg)
    return v.df.select("order_id", F.col("_rec_rec.status").alias("status"), F.col("_rule_fine").alias("fine"))


@query("""SELECT order_id, n AS total, name, value, CASE WHEN n <> 0 THEN round(value / n, 6) END AS share FROM (SELECT l_orderkey AS order_id, CAST(count(*) AS DOUBLE) AS n, unnest(['returned', 'accepted', 'other']) AS name, CAST(unnest([count(*) FILTER (l_returnflag = 'R'), count(*) FILTER (l_returnflag = 'A'), count(*) FILTER (l_returnflag NOT IN ('R', 'A'))]) AS DOUBLE) AS value FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1)""")
def summary_remainder(spark, sf_dir):
    accs = [{"name": "n", "operation": "count"}, {"name": "r", "operation": "count", "filter": "flag == R"}, {"name": "a", "operation": "count", "filter": "flag == A"}]
    v = checked(order_records(spark, sf_dir), {"array_path": "lines", "accumulations": accs})
    made, _ = V.summaries([{"name": "s", "total": {"expression": "n"}, "components": [{"name": "returned", "expression": "r"}, {"name": "accepted", "expression": "a"}, {"name": "other", "remainder": True}]}], Scope(v.scope))
    return v.df.select("order_id", made["s"].alias("s")).select("order_id", F.col("s.total").alias("total"), F.explode("s.components").alias("c")).select("order_id", "total", "c.name", "c.value", "c.share")


@query("""SELECT o_orderkey AS order_id, CASE WHEN big THEN 1 ELSE 3 END AS total_checks, CASE WHEN big THEN 0 ELSE 1 + CAST(o_orderstatus = 'F' AS INT) + CAST(o_totalprice > 100 AS INT) END AS passed, CAST(CASE WHEN big THEN 0 ELSE CAST(o_orderstatus <> 'F' AS INT) END AS BIGINT) AS warnings, CAST(CASE WHEN NOT big AND o_totalprice <= 100 THEN 1 ELSE 0 END AS BIGINT) AS errors, CAST(big AS BIGINT) AS fatals, CASE WHEN big THEN 'total ' || o_orderstatus ELSE '' END AS message FROM (SELECT *, o_totalprice > 300000 AS big FROM orders)""".replace("THEN 1 ELSE 3 END AS total", "THEN CAST(1 AS BIGINT) ELSE 3 END AS total").replace("THEN 0 ELSE 1 +", "THEN CAST(0 AS BIGINT) ELSE 1 +"))
def validation_quality(spark, sf_dir):
    df = t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("order_id"), F.col("o_totalprice").alias("total"), F.col("o_orderstatus").alias("status"))
    rules = [{"name": "top", "rule": "total <= 300000", "severity": "fatal", "message": "total {status}"}, {"name": "done", "rule": "status == 'F'", "severity": "warning"}, {"name": "some", "rule": "total > 100", "severity": "error"}]
    v = checked(df, {"failure_policy": {"halt_on_first_fatal": True}, "validations": rules})
    return v.df.select("order_id", V.quality(F.col("_results")).alias("q"), F.col("_results")[0]["message"].alias("message")).select("order_id", "q.*", "message")


@query("""SELECT CASE WHEN o_totalprice > 300000 THEN 'failed' ELSE 'applied' END AS disposition, count(*) AS n FROM orders GROUP BY 1""")
def failure_policy(spark, sf_dir):
    r = recipe(BASIC, validation_metadata={"enable": True, "expression_language": "dsl", "validations": [{"name": "top", "rule": "total <= 300000", "severity": "fatal"}]})
    return run(spark, order_xml(spark, sf_dir, lines=False), r).dispositions.groupBy("disposition").agg(F.count("*").alias("n"))


# ---- profiles, inspection, index, shards ------------------------------------------------------------------------


@query("""SELECT 'o_orderpriority' AS field, o_orderpriority AS value, count(*) AS n FROM orders GROUP BY 2 UNION ALL SELECT 'o_orderstatus', o_orderstatus, count(*) FROM orders GROUP BY 2""")
def profile_enumeration(spark, sf_dir):
    c = P.ProfileConfig.of({"fields": [{"field": f, "safe_to_profile": True, "sensitivity": "public"} for f in ("o_orderpriority", "o_orderstatus")]})
    return P.value_counts(t(spark, sf_dir, "orders"), c)


@query("""SELECT 'c_name' AS field, 'aggregates' AS tier, 'high_cardinality_capped' AS status, count(*) AS n, '>=100' AS "distinct", min(strlen(c_name)) AS len_min, max(strlen(c_name)) AS len_max, avg(strlen(c_name)) AS len_mean FROM customer UNION ALL SELECT 'c_mktsegment', 'aggregates', 'complete', count(*), CAST(count(DISTINCT c_mktsegment) AS VARCHAR), min(strlen(c_mktsegment)), max(strlen(c_mktsegment)), avg(strlen(c_mktsegment)) FROM customer""")
def profile_aggregates(spark, sf_dir):
    c = P.ProfileConfig.of({"fields": [{"field": "c_name", "safe_to_profile": True, "sensitivity": "public"}, {"field": "c_mktsegment"}]})
    return P.profile(t(spark, sf_dir, "customer"), c).select("field", "tier", "status", F.col("count").alias("n"), "distinct", "len_min", "len_max", "len_mean")


@query("""SELECT 'c_nationkey' AS field, CAST(c_nationkey AS VARCHAR) AS value, count(*) AS n FROM customer GROUP BY 2 HAVING count(*) >= 60""")
def profile_small_cells(spark, sf_dir):
    c = P.ProfileConfig.of({"small_cell_threshold": 60, "fields": [{"field": "c_nationkey", "safe_to_profile": True, "sensitivity": "internal", "protection_tags": ["quasi_identifier"]}]})
    return P.value_counts(t(spark, sf_dir, "customer"), c)


@query("""SELECT '/Orders' AS path, count(*) AS n, count(*) AS docs FROM orders UNION ALL SELECT '/Orders/Order', count(*), count(*) FROM orders UNION ALL SELECT '/Orders/Order/@id', count(*), count(*) FROM orders UNION ALL SELECT '/Orders/Order/@status', count(*), count(*) FROM orders UNION ALL SELECT '/Orders/Order/Customer', count(*), count(*) FROM orders UNION ALL SELECT '/Orders/Order/Total', count(*), count(*) FROM orders UNION ALL SELECT '/Orders/Order/Priority', count(*), count(*) FROM orders""")
def inspect_paths(spark, sf_dir):
    rows = IN.paths(order_xml(spark, sf_dir, lines=False), id_col="doc")
    return IN.path_report(rows).select("path", "n", "docs")


@query("""SELECT path, sum(CASE WHEN kind = 'string' THEN 1 ELSE 0 END)::BIGINT AS n_string, sum(CASE WHEN kind = 'number' THEN 1 ELSE 0 END)::BIGINT AS n_number, sum(CASE WHEN kind = 'null' THEN 1 ELSE 0 END)::BIGINT AS n_null FROM (SELECT '/Event/id' AS path, 'number' AS kind FROM events UNION ALL SELECT '/Event/note', CASE WHEN event_id % 2 = 1 THEN 'null' ELSE 'string' END FROM events UNION ALL SELECT '/Event/tags', 'string' FROM events WHERE event_id % 2 = 0 UNION ALL SELECT '/Event/tags', 'string' FROM events WHERE event_id % 2 = 0 UNION ALL SELECT '/Event/tags', 'null' FROM events WHERE event_id % 2 = 0) GROUP BY 1""")
def inspect_json_kinds(spark, sf_dir):
    rows = IN.paths(event_json(spark, sf_dir), "json", "doc")
    return IN.value_kinds(rows).where("path in ('/Event/id', '/Event/note', '/Event/tags')").select("path", "n_string", "n_number", "n_null")


@query("""SELECT 'integer' AS type, '/Orders/Order/@id' AS path UNION ALL SELECT 'integer', '/Orders/Order/Customer' UNION ALL SELECT 'string', '/Orders/Order/@status' UNION ALL SELECT 'string', '/Orders/Order/Priority'""")
def inspect_types(spark, sf_dir):
    rows = IN.path_types(IN.paths(order_xml(spark, sf_dir, lines=False), id_col="doc"))
    return rows.where("path <> '/Orders/Order/Total'").select("type", "path")


@query("""SELECT CAST(o_custkey AS VARCHAR) AS doc, CASE WHEN max(CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 0 END) = 1 THEN 'both' ELSE 'plain' END AS dialect, CAST(1.0 AS DOUBLE) AS score FROM orders GROUP BY 1""")
def dialect_scores(spark, sf_dir):
    rows = IN.paths(customer_xml(spark, sf_dir), id_col="doc").where("kind = 'element'").select("doc", "name")
    pats = spark.createDataFrame([("both", "Bet*", 1.0), ("both", "Alpha", 1.0), ("plain", "Alpha", 1.0)], "dialect string, pattern string, weight double")
    return IN.detect_dialect(rows, pats)


@query("""SELECT count(*) AS records, CAST(min(n) AS BIGINT) AS smallest, CAST(max(n) AS BIGINT) AS largest, avg(n) AS mean, CAST(floor(quantile_cont(n, 0.5) + 0.5) AS BIGINT) AS p50, CAST(floor(quantile_cont(n, 0.95) + 0.5) AS BIGINT) AS p95, CAST(floor(quantile_cont(n, 0.99) + 0.5) AS BIGINT) AS p99 FROM (SELECT strlen(text) AS n FROM documents)""")
def index_size_percentiles(spark, sf_dir):
    from lodestone.operators.index import size_stats

    return size_stats(t(spark, sf_dir, "documents").select(F.octet_length("text").cast("long").alias("size_bytes")))


@query("""WITH h AS (SELECT CAST(greatest(10, least(30, ceil(log2(greatest(strlen(text), 1))))) AS INT) AS b, count(*) AS n FROM documents GROUP BY 1) SELECT CAST(min(pow(2, b)) AS BIGINT) AS percentile FROM (SELECT b, sum(n) OVER (ORDER BY b) AS upto, sum(n) OVER () AS total FROM h) WHERE upto >= ceil(total * 0.95)""")
def inspect_size_histogram(spark, sf_dir):
    return IN.histogram_percentile(t(spark, sf_dir, "documents").select(F.octet_length("text").cast("long").alias("size")), 0.95)


@query("""SELECT CAST((row_number() OVER (ORDER BY o_orderkey) - 1) // 1000 AS BIGINT) AS shard, o_orderkey AS order_id FROM orders""")
def shard_by_rows(spark, sf_dir):
    o = t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("order_id"))
    return S.shards_by_rows(o, ["order_id"], 1000).select("shard", "order_id")


@query("""SELECT CAST((row_number() OVER (ORDER BY o_orderkey) - 1) // 40 AS BIGINT) AS shard, o_orderkey AS order_id FROM orders""")
def shard_by_bytes(spark, sf_dir):
    o = t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("order_id"))
    return S.shards_by_bytes(o, ["order_id"], F.lit(25), 1024).select("shard", "order_id")


@query("""SELECT CASE WHEN o_orderkey % 5 = 0 THEN 'size_mismatch' WHEN o_orderkey % 5 = 1 THEN 'sha256_mismatch' WHEN o_orderkey % 5 = 2 THEN 'input_unavailable' ELSE 'fine' END AS problem, count(*) AS n FROM orders GROUP BY 1""")
def input_integrity(spark, sf_dir):
    files = order_xml(spark, sf_dir, lines=False).select(F.col("doc").cast("string").alias("source_file"), F.octet_length("content").cast("long").alias("size_bytes"), F.sha2("content", 256).alias("input_sha256"), "content")
    k = F.col("source_file").cast("long") % 5
    declared = files.select(F.col("source_file").cast("long").alias("input_ordinal"), F.when(k == 2, F.concat(F.lit("x"), F.col("source_file"))).otherwise(F.col("source_file")).alias("uri"), F.when(k == 0, F.lit(1)).otherwise(F.col("size_bytes")).cast("long").alias("declared_size"), F.when(k == 1, F.lit("0" * 64)).otherwise(F.col("input_sha256")).alias("declared_sha256"))
    return I.verified(files, declared).groupBy(F.coalesce("input_problem", F.lit("fine")).alias("problem")).agg(F.count("*").alias("n"))


@query("""SELECT shard, order_id FROM (WITH RECURSIVE r AS (SELECT c_custkey AS k, row_number() OVER (ORDER BY c_custkey) AS n, 10 + c_custkey * 7 % 90 AS s FROM customer), p AS (SELECT n, k, s AS used, CAST(0 AS BIGINT) AS shard FROM r WHERE n = 1 UNION ALL SELECT r.n, r.k, CASE WHEN p.used + r.s > 500 THEN r.s ELSE p.used + r.s END, CASE WHEN p.used + r.s > 500 THEN p.shard + 1 ELSE p.shard END FROM p JOIN r ON r.n = p.n + 1) SELECT shard, k AS order_id FROM p)""")
def shard_by_bytes_of_rows(spark, sf_dir):
    c = t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("order_id"))
    return S.shards_by_bytes(c, ["order_id"], 10 + F.col("order_id") * 7 % 90, 500).select("shard", "order_id")


# ---- namespaces, presence, applicability and other forms of recipes ------------------------------------------------


@query("""SELECT o_orderkey AS order_id, o_totalprice AS total, o_orderstatus AS status FROM orders""")
def xml_namespaces(spark, sf_dir):
    """A bound prefix matches by URI, whatever the document's own prefix is."""
    o = t(spark, sf_dir, "orders")
    prefix = F.when(F.col("o_orderkey") % 2 == 0, F.lit("a")).otherwise(F.lit("b"))
    x = F.concat(F.lit("<"), prefix, F.lit(":Orders xmlns:"), prefix, F.lit('="urn:orders" xmlns:z="urn:else"><z:Order id="0"/><'), prefix, F.lit(':Order id="'), F.col("o_orderkey").cast("string"), F.lit('"><'), prefix, F.lit(":Total>"), F.col("o_totalprice").cast("string"), F.lit("</"), prefix, F.lit(":Total><z:Status>"), F.col("o_orderstatus"), F.lit("</z:Status></"), prefix, F.lit(":Order></"), prefix, F.lit(":Orders>"))
    r = recipe([BASIC[0], field("total", "o:Total", "number"), field("status", "e:Status")], "//o:Order", namespaces={"o": "urn:orders", "e": "urn:else"})
    return run(spark, spread(o.select(F.col("o_orderkey").alias("doc"), x.alias("content"))), r).data.select("order_id", "total", "status")


@query("""SELECT o_orderkey AS order_id, EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey) AS has_lines, EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') AS returned, false AS has_note FROM orders""")
def exists_transform(spark, sf_dir):
    maps = [BASIC[0], field("has_lines", "Lines/Line", "boolean", transform="exists"), field("returned", "Lines/Line[Flag='R']", "boolean", transform="exists"), field("has_note", "Note", "boolean", transform="exists")]
    return run(spark, order_xml(spark, sf_dir), recipe(maps)).data.select("order_id", "has_lines", "returned", "has_note")


@query("""SELECT CASE WHEN o_orderstatus = 'F' THEN 'applied' ELSE 'not_applicable' END AS disposition, CASE WHEN o_orderstatus = 'F' THEN NULL ELSE 'applicability_predicate_false' END AS reason, count(*) AS documents, CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS records FROM orders GROUP BY 1, 2""")
def applicability_predicate(spark, sf_dir):
    r = build({"record_type": "order", "match_selectors": [{"xpath": "//Order"}], "field_mappings": BASIC}, None, {}, {"applicability": {"expression": "//Order[@status='F']"}})
    d = run(spark, order_xml(spark, sf_dir, lines=False), r).dispositions
    return d.groupBy("disposition", "reason").agg(F.count("*").alias("documents"), F.sum("records").alias("records"))


@query("""SELECT o_orderkey AS order_id, '{"note":null,"order_id":' || CAST(o_orderkey AS VARCHAR) || ',"status":"' || o_orderstatus || '"}' AS uniform, '{"order_id":' || CAST(o_orderkey AS VARCHAR) || ',"status":"' || o_orderstatus || '"}' AS sparse FROM orders""")
def uniform_schema(spark, sf_dir):
    """Absent fields are nulls under a uniform schema and left out otherwise."""
    docs, maps = order_xml(spark, sf_dir, lines=False), [*BASIC[:2], field("note", "Note")]
    data = r'"data":(\{[^}]*\})'
    both = [envelope(run(spark, docs, build({"record_type": "order", "match_selectors": [{"xpath": "//Order"}], "field_mappings": maps}, None, {"defaults": {"output": {"uniform_schema": u}}}))).select("doc", F.regexp_extract("value", data, 1).alias(n)) for n, u in (("uniform", True), ("sparse", False))]
    return both[0].join(both[1], "doc").select(F.col("doc").alias("order_id"), "uniform", "sparse")


@query("""SELECT o_custkey AS cust, selector, record_num, order_id FROM (SELECT o_custkey, s AS selector, row_number() OVER (PARTITION BY o_custkey ORDER BY s, o_orderkey) AS record_num, o_orderkey AS order_id FROM orders, (VALUES (0), (1)) v(s) WHERE s = 0 AND o_orderkey % 2 = 0 OR s = 1 AND o_orderkey % 3 = 0)""")
def selectors_in_turn(spark, sf_dir):
    """Records of several selectors follow each other; a node that two of them match gives two records."""
    r = build({"record_type": "order", "match_selectors": [{"xpath": "//Order[@id mod 2 = 0]"}, {"xpath": "//Order[@id mod 3 = 0]"}], "field_mappings": [BASIC[0]]}, None, {})
    return run(spark, customer_xml(spark, sf_dir), r).data.select(F.col("doc").alias("cust"), F.col("selector").cast("int").alias("selector"), "record_num", "order_id")


@query("""SELECT o_custkey AS cust, CAST(count(*) FILTER (o_orderkey % 2 = 0) AS BIGINT) AS evens, CAST(count(*) FILTER (o_orderkey % 3 = 0) AS BIGINT) AS thirds FROM orders GROUP BY 1 HAVING count(*) FILTER (o_orderkey % 2 = 0 OR o_orderkey % 3 = 0) > 0""")
def counts_per_selector(spark, sf_dir):
    r = build({"record_type": "order", "match_selectors": [{"xpath": "//Order[@id mod 2 = 0]"}, {"xpath": "//Order[@id mod 3 = 0]"}], "field_mappings": [BASIC[0]]}, None, {})
    rows = run(spark, customer_xml(spark, sf_dir), r).rows.where("record_num = 1")
    return rows.select(F.col("doc").alias("cust"), F.col("selector_counts")[0].alias("evens"), F.col("selector_counts")[1].alias("thirds"))


@query("""SELECT o_orderkey AS order_id, o_orderpriority LIKE '%T' AS ends_t, contains(o_orderpriority, 'IG') AS has_ig, o_totalprice > 100000 AS dear, o_orderstatus <> '' AS has_status FROM orders""")
def xpath_booleans(spark, sf_dir):
    maps = [BASIC[0], field("ends_t", "ends-with(Priority, 'T')", "boolean"), field("has_ig", "contains(Priority, 'IG')", "boolean"), field("dear", "boolean(Total[. > 100000])", "boolean"), field("has_status", "boolean(@status)", "boolean")]
    return run(spark, order_xml(spark, sf_dir, lines=False), recipe(maps)).data.select("order_id", "ends_t", "has_ig", "dear", "has_status")


@query("""SELECT n_nationkey AS nation, 'nï' AS part, CAST(strlen('Ünï–' || n_name) AS BIGINT) AS size, 'é' || n_name AS after, 'Ün' AS before FROM nation""")
def xpath_beyond_ascii(spark, sf_dir):
    """``substring`` and ``string-length`` count UTF-8 bytes."""
    x = F.concat(F.lit("<N k='"), F.col("n_nationkey").cast("string"), F.lit("'><T>Ünï–"), F.col("n_name"), F.lit("</T><U>é"), F.col("n_name"), F.lit("</U></N>"))
    maps = [field("nation", "@k", "integer"), field("part", "substring(T, 3, 3)"), field("size", "string-length(T)", "integer"), field("after", "U"), field("before", "substring-before(T, 'ï')")]
    rows = run(spark, t(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("doc"), x.alias("content")), recipe(maps, "/N")).data
    return rows.select("nation", "part", "size", "after", "before")


@query("""SELECT o_orderkey AS order_id, left(o_orderpriority, 2) || array_to_string(list_transform(string_split(substr(o_orderpriority, 3), ' '), lambda w: upper(left(w, 1)) || lower(substr(w, 2))), ' ') AS title, 'O''brien-Smith' AS name FROM orders""")
def title_transform(spark, sf_dir):
    """Words begin after hyphens too, but not after an apostrophe between letters."""
    o = t(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("order_id"), apply_transform(F.col("o_orderpriority"), "title").alias("title"), apply_transform(F.lit("o'BRIEN-smith"), "title").alias("name"))


@query("""SELECT row_number() OVER (ORDER BY o_orderkey) AS ordinal, o_orderkey AS order_id FROM orders""")
def ordinals(spark, sf_dir):
    """Numbers over a whole order, from ranges and one count each."""
    o = t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("order_id"))
    return S.numbered(o, ["order_id"], "ordinal").select("ordinal", "order_id")


@query("""SELECT o_orderkey AS order_id, o_totalprice AS total FROM orders WHERE o_orderkey % 3 <> 0 UNION ALL SELECT o_orderkey + 1000000000, o_totalprice FROM orders WHERE o_orderkey % 3 = 1""")
def concatenated_inputs(spark, sf_dir):
    """Records of two sets of documents; a document that can't be parsed fails alone."""
    docs = order_xml(spark, sf_dir, lines=False)
    bad = docs.withColumn("content", F.when(F.col("doc") % 3 == 0, F.expr("substr(content, 1, length(content) - 3)")).otherwise(F.col("content")))
    more = docs.where("doc % 3 = 1").select((F.col("doc") + 1000000000).alias("doc"), F.regexp_replace("content", 'id="\\d+"', "id=''").alias("content"))
    return run(spark, bad.union(more), recipe(BASIC)).data.select(F.coalesce("order_id", "doc").alias("order_id"), "total")


from . import file_queries  # noqa: E402, F401  registers its own
