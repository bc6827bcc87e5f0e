"""Scalar functions: strings, numbers, dates, arrays, maps, structs, JSON, vectors, texts."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.functions import cosine, dot, json_int, word_count
from brindle.operators.products import query_products
from brindle.plans import query, sql
from brindle.sources import table

sql("f01_strings", """
SELECT c_custkey, substring(c_name, -4) AS tail, length(c_name) AS n, concat_ws('-', c_mktsegment, c_name) AS j, c_mktsegment || '!' AS bang, instr(c_name, '0') AS at,
       lpad(c_mktsegment, 12, '*') AS l, rpad(c_mktsegment, 12, '*') AS r, reverse(c_name) AS rev, levenshtein(c_mktsegment, 'BUILDINGS') AS d, md5(c_name) AS m, ascii(c_name) AS a,
       trim('  x ') AS t, translate(c_name, '0123', 'abcd') AS tr, regexp_extract(c_name, '([0-9]+)', 1) AS digits, upper(c_name) AS u, lower(c_name) AS lo, repeat('ab', 3) AS rep, replace(c_name, '0', 'o') AS re,
       split_part(c_name, '#', 2) AS part, left(c_name, 3) AS le, right(c_name, 3) AS ri, starts AS s FROM (SELECT *, startswith(c_name, 'Cust') AS starts FROM {customer})""",
"""SELECT c_custkey, right(c_name, 4) AS tail, CAST(length(c_name) AS INT) AS n, concat_ws('-', c_mktsegment, c_name) AS j, c_mktsegment || '!' AS bang, CAST(instr(c_name, '0') AS INT) AS at,
       lpad(c_mktsegment, 12, '*') AS l, rpad(c_mktsegment, 12, '*') AS r, reverse(c_name) AS rev, CAST(levenshtein(c_mktsegment, 'BUILDINGS') AS INT) AS d, md5(c_name) AS m, CAST(ascii(c_name) AS INT) AS a,
       trim('  x ') AS t, translate(c_name, '0123', 'abcd') AS tr, regexp_extract(c_name, '([0-9]+)', 1) AS digits, upper(c_name) AS u, lower(c_name) AS lo, repeat('ab', 3) AS rep, replace(c_name, '0', 'o') AS re,
       split_part(c_name, '#', 2) AS part, left(c_name, 3) AS le, right(c_name, 3) AS ri, starts_with(c_name, 'Cust') AS s FROM customer""")
sql("f02_strings_that_differ", "SELECT c_custkey, regexp_replace(c_name, '0', '_') AS r, substring(c_name, 1, 2) AS s, concat(c_name, CAST(NULL AS STRING)) AS c FROM {customer}", "SELECT c_custkey, regexp_replace(c_name, '0', '_', 'g') AS r, substring(c_name, 1, 2) AS s, CAST(NULL AS VARCHAR) AS c FROM customer")
sql("f03_initcap", "SELECT c_custkey, initcap(c_mktsegment) AS s FROM {customer}", "SELECT c_custkey, upper(left(c_mktsegment, 1)) || lower(substring(c_mktsegment, 2)) AS s FROM customer")
sql("f04_numbers", "SELECT p_partkey, p_size / 7 AS q, p_size div 7 AS d, p_size % 7 AS m, round(ln(p_size), 9) AS l, round(power(p_size, 1.5), 6) AS p, round(p_retailprice, 1) AS r, abs(p_size - 25) AS a, sign(p_size - 25.0D) AS s, round(sqrt(p_size), 9) AS sq, round(exp(p_size / 50), 9) AS e FROM {part}",
    "SELECT p_partkey, p_size / 7 AS q, CAST(p_size // 7 AS BIGINT) AS d, p_size % 7 AS m, round(ln(p_size), 9) AS l, round(power(p_size, 1.5), 6) AS p, round(p_retailprice, 1) AS r, abs(p_size - 25) AS a, CAST(sign(p_size - 25.0) AS DOUBLE) AS s, round(sqrt(p_size), 9) AS sq, round(exp(p_size / 50), 9) AS e FROM part")
sql("f05_numbers_that_differ", "SELECT p_partkey, floor(p_retailprice) AS f, ceil(p_retailprice) AS c, round(log10(p_size), 9) AS l, CAST(p_retailprice AS INT) AS i, CAST(CAST(p_size AS DECIMAL(9, 2)) / CAST(3 AS DECIMAL(9, 2)) AS DECIMAL(12, 4)) AS d, try_divide(p_size, 0) AS z FROM {part}",
    "SELECT p_partkey, CAST(floor(p_retailprice) AS BIGINT) AS f, CAST(ceil(p_retailprice) AS BIGINT) AS c, round(log10(p_size), 9) AS l, CAST(trunc(p_retailprice) AS INT) AS i, CAST(round(p_size / 3.0, 4) AS DECIMAL(12, 4)) AS d, CAST(NULL AS DOUBLE) AS z FROM part")
sql("f06_decimals", "SELECT p_partkey, CAST(CAST(p_size AS DECIMAL(10, 2)) * CAST(1.25 AS DECIMAL(4, 2)) AS DECIMAL(12, 4)) AS d FROM {part}")
sql("f07_dates", "SELECT o_orderkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS m, year(o_orderdate) AS y, CAST(extract(month FROM o_orderdate) AS INT) AS mo, last_day(o_orderdate) AS l, weekofyear(o_orderdate) AS w, dayofyear(o_orderdate) AS dy FROM {orders}",
    "SELECT o_orderkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS m, CAST(year(o_orderdate) AS INT) AS y, CAST(extract(month FROM o_orderdate) AS INT) AS mo, last_day(o_orderdate) AS l, CAST(weekofyear(o_orderdate) AS INT) AS w, CAST(dayofyear(o_orderdate) AS INT) AS dy FROM orders")
sql("f08_date_arithmetic", "SELECT o_orderkey, datediff(o_orderdate, DATE'1995-01-01') AS d, date_format(o_orderdate, 'yyyy/MM/dd') AS f FROM {orders}", "SELECT o_orderkey, CAST(datediff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS INT) AS d, strftime(o_orderdate, '%Y/%m/%d') AS f FROM orders")
sql("f09_dates_that_differ", "SELECT event_id, dayofweek(ts) AS dw, CAST(CAST(ts AS DATE) + INTERVAL 1 MONTH AS DATE) AS m, CAST(extract(second FROM ts) AS INT) AS s, timestampdiff(SECOND, TIMESTAMP_NTZ'2024-01-01', ts) AS e, hour(ts) AS h, minute(ts) AS mi FROM {events}",
    "SELECT event_id, CAST(dayofweek(ts) + 1 AS INT) AS dw, CAST(CAST(ts AS DATE) + INTERVAL 1 MONTH AS DATE) AS m, CAST(extract(second FROM ts) AS INT) AS s, CAST(floor(epoch(ts) - epoch(TIMESTAMP '2024-01-01')) AS BIGINT) AS e, CAST(hour(ts) AS INT) AS h, CAST(minute(ts) AS INT) AS mi FROM events")
sql("f10_calendar", "SELECT o_orderkey, make_date(year(o_orderdate), 1, 1) AS y, quarter(o_orderdate) AS q, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS tq, add_months(o_orderdate, 2) AS am FROM {orders}",
    "SELECT o_orderkey, make_date(year(o_orderdate), 1, 1) AS y, CAST(quarter(o_orderdate) AS INT) AS q, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS tq, CAST(CAST(o_orderdate AS DATE) + INTERVAL 2 MONTH AS DATE) AS am FROM orders")
sql("f10_zones_and_months", "SELECT o_orderkey, next_day(o_orderdate, 'Mon') AS n, CAST(months_between(date_trunc('month', o_orderdate), DATE'1995-01-01') AS INT) AS mb, date_format(convert_timezone('UTC', 'Asia/Tokyo', o_orderdate), 'yyyy-MM-dd HH') AS tokyo FROM {orders}",
    "SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) + CAST(1 + (7 - isodow(o_orderdate)) AS INT) AS DATE) AS n, CAST(datediff('month', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS INT) AS mb, strftime(o_orderdate + INTERVAL 9 HOUR, '%Y-%m-%d %H') AS tokyo FROM orders")
sql("f11_arrays", "SELECT n_nationkey, element_at(a, -1) AS l, array_contains(a, 2) AS c, array_join(transform(a, x -> x * 2), ',') AS t FROM (SELECT n_nationkey, array(n_nationkey, n_regionkey, 2) AS a FROM {nation})",
    "SELECT n_nationkey, a[-1] AS l, list_contains(a, 2) AS c, array_to_string([x * 2 for x in a], ',') AS t FROM (SELECT n_nationkey, [n_nationkey, n_regionkey, 2] AS a FROM nation)")
sql("f12_explode", "SELECT vec_id, pos, round(CAST(col AS DOUBLE), 6) AS v FROM (SELECT vec_id, posexplode(embedding) FROM {embeddings})", "SELECT vec_id, CAST(pos - 1 AS INT) AS pos, round(CAST(v AS DOUBLE), 6) AS v FROM (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS pos FROM embeddings)")
sql("f12_array_functions", "SELECT n_nationkey, size(filter(s, x -> x % 2 = 0)) AS evens, array_join(slice(s, 2, 3), ',') AS sl, CAST(array_position(s, 3) AS BIGINT) AS p, array_max(s) AS m, size(flatten(array(s, s))) AS f FROM (SELECT n_nationkey, sequence(0, n_regionkey + 3) AS s FROM {nation})",
    "SELECT n_nationkey, CAST(len([x for x in s if x % 2 = 0]) AS INT) AS evens, array_to_string(s[2:4], ',') AS sl, CAST(list_position(s, 3) AS BIGINT) AS p, CAST(list_max(s) AS INT) AS m, CAST(len(flatten([s, s])) AS INT) AS f FROM (SELECT n_nationkey, range(0, n_regionkey + 4) AS s FROM nation)")
sql("f12_array_sets", "SELECT n_nationkey, exists(a, x -> x > 20) AS e, forall(a, x -> x >= 0) AS fa, array_join(zip_with(a, b, (x, y) -> x + y), ',') AS z, array_join(array_sort(array_union(a, b)), ',') AS u, array_join(array_sort(array_except(a, b)), ',') AS ex, array_join(array_sort(array_intersect(a, b)), ',') AS i, size(arrays_zip(a, b)) AS az FROM (SELECT n_nationkey, array(n_nationkey, 1) AS a, array(n_regionkey, 2) AS b FROM {nation})",
    "SELECT n_nationkey, n_nationkey > 20 AS e, true AS fa, (n_nationkey + n_regionkey) || ',3' AS z, array_to_string(list_sort(list_distinct(a || b)), ',') AS u, array_to_string(list_sort(list_distinct([x for x in a if NOT list_contains(b, x)])), ',') AS ex, array_to_string(list_sort(list_distinct([x for x in a if list_contains(b, x)])), ',') AS i, CAST(2 AS INT) AS az FROM (SELECT n_nationkey, n_regionkey, [n_nationkey, 1] AS a, [n_regionkey, 2] AS b FROM nation)")
sql("f13_array_distinct", "SELECT n_nationkey, array_join(array_sort(array_distinct(array(n_regionkey, 1, n_regionkey, 2))), ',') AS d FROM {nation}", "SELECT n_nationkey, array_to_string(list_sort(list_distinct([n_regionkey, 1, n_regionkey, 2])), ',') AS d FROM nation")
sql("f15_maps", "SELECT n_nationkey, m['r'] AS r, array_join(array_sort(map_keys(m)), ',') AS k, array_join(array_sort(map_values(m)), ',') AS v FROM (SELECT n_nationkey, map('r', n_regionkey, 'n', n_nationkey) AS m FROM {nation})", "SELECT n_nationkey, n_regionkey AS r, 'n,r' AS k, array_to_string(list_sort([n_regionkey, n_nationkey]), ',') AS v FROM nation")
sql("f16_map_functions", "SELECT n_nationkey, map_concat(m, map('z', 1))['z'] AS z, size(map_filter(m, (k, v) -> v > 2)) AS f, transform_values(m, (k, v) -> v + 1)['n'] AS t FROM (SELECT n_nationkey, map('r', n_regionkey, 'n', n_nationkey) AS m FROM {nation})",
    "SELECT n_nationkey, 1 AS z, CAST((CASE WHEN n_regionkey > 2 THEN 1 ELSE 0 END) + (CASE WHEN n_nationkey > 2 THEN 1 ELSE 0 END) AS INT) AS f, n_nationkey + 1 AS t FROM nation")
sql("f17_structs", "SELECT s.key AS k, s.name AS n FROM (SELECT named_struct('key', r_regionkey, 'name', r_name) AS s FROM {region})", "SELECT r_regionkey AS k, r_name AS n FROM region")
sql("f18_json_path", "SELECT event_id, get_json_object(props, '$.k') AS k FROM {events}", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
sql("f19_from_json", "SELECT event_id, from_json(props, 'k BIGINT').k AS k FROM {events}", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
sql("f19_variant_and_to_json", "SELECT event_id, variant_get(parse_json(props), '$.k', 'bigint') AS v, to_json(named_struct('id', event_id)) AS j FROM {events}", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS v, CAST('{\"id\":' || event_id || '}' AS VARCHAR) AS j FROM events")
sql("f20_conversions", "SELECT try_cast(s AS INT) AS i, CAST('NaN' AS DOUBLE) = CAST('NaN' AS DOUBLE) AS nan_equal, s COLLATE UTF8_LCASE = 'ABC' AS folded, nullif(s, 'x') AS n, coalesce(NULL, s) AS c FROM (VALUES ('12'), ('x'), ('abc')) AS t(s)",
    "SELECT TRY_CAST(s AS INT) AS i, CAST('NaN' AS DOUBLE) = CAST('NaN' AS DOUBLE) AS nan_equal, lower(s) = 'abc' AS folded, nullif(s, 'x') AS n, s AS c FROM (VALUES ('12'), ('x'), ('abc')) AS t(s)")
sql("f19_json_tuple", "SELECT event_id, CAST(t.k AS BIGINT) AS k FROM {events} LATERAL VIEW json_tuple(props, 'k') t AS k", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
sql("f08_timestamp_difference", "SELECT event_id, CAST(extract(DAY FROM ts - TIMESTAMP_NTZ'2024-01-01') AS INT) AS d, CAST(extract(HOUR FROM ts - TIMESTAMP_NTZ'2024-01-01') AS INT) AS h FROM {events}",
    "SELECT event_id, CAST(extract(day FROM ts - TIMESTAMP '2024-01-01') AS INT) AS d, CAST(extract(hour FROM ts - TIMESTAMP '2024-01-01') AS INT) AS h FROM events")
sql("f09_date_difference", "SELECT event_id, CAST(extract(DAY FROM CAST(ts AS DATE) - DATE'2023-12-25') AS INT) AS d FROM {events}", "SELECT event_id, CAST(CAST(ts AS DATE) - DATE '2023-12-25' AS INT) AS d FROM events")
sql("f10_from_utc", "SELECT event_id, CAST(from_utc_timestamp(CAST(ts AS TIMESTAMP), 'Asia/Tokyo') AS TIMESTAMP_NTZ) AS t FROM {events}", "SELECT event_id, ts + INTERVAL 9 HOUR AS t FROM events")
sql("f20_time", "SELECT r_regionkey, CAST(TIME'10:11:12' AS STRING) AS t, TIME'10:11:12' < TIME'10:11:13' AS earlier FROM {region}", "SELECT r_regionkey, CAST(TIME '10:11:12' AS VARCHAR) AS t, TIME '10:11:12' < TIME '10:11:13' AS earlier FROM region")
sql("f20_urls", "SELECT page_id, parse_url(url, 'HOST') AS host FROM {pages}", "SELECT page_id, regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS host FROM pages")
sql("f22_hashes", "SELECT r_regionkey, sha2(r_name, 256) AS s, md5(r_name) AS m, base64(encode(r_name, 'UTF-8')) AS b, hex(r_name) AS h FROM {region}", "SELECT r_regionkey, sha256(r_name) AS s, md5(r_name) AS m, base64(encode(r_name)) AS b, hex(r_name) AS h FROM region")


@query("f14_vector_products", """
WITH l AS (SELECT label, arg_min(embedding, vec_id) AS first FROM embeddings GROUP BY label)
SELECT vec_id, CAST(round(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(first AS DOUBLE[])), 4) AS DECIMAL(9, 4)) AS dot, CAST(round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(first AS DOUBLE[])), 4) AS DECIMAL(9, 4)) AS cosine
FROM embeddings e JOIN l ON e.label = l.label""")
def f14_vector_products(spark, sf_dir):
    """Every vector with the first of its label."""
    e = table(spark, sf_dir, "embeddings")
    first = e.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("first"))
    return e.join(first, "label").select("vec_id", F.round(dot(F.col("embedding"), F.col("first")), 4).cast("decimal(9, 4)").alias("dot"), F.round(cosine(F.col("embedding"), F.col("first")), 4).cast("decimal(9, 4)").alias("cosine"))


@query("f14_query_vectors", """
SELECT a.vec_id, b.vec_id AS other, CAST(round(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 4) AS DECIMAL(9, 4)) AS dot, CAST(round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 4) AS DECIMAL(9, 4)) AS cosine
FROM embeddings a CROSS JOIN embeddings b WHERE a.vec_id % 100 = 0""")
def f14_query_vectors(spark, sf_dir):
    """The vectors whose number 100 divides (the stated query set) with all vectors, by tiles."""
    e = table(spark, sf_dir, "embeddings")
    found = query_products(e.filter("vec_id % 100 = 0").select("vec_id", "embedding"), e.select(F.col("vec_id").alias("other"), "embedding"))
    return found.select("vec_id", "other", *(F.coalesce(f"{c}_rounded", F.round(c, 4).cast("decimal(9, 4)")).alias(c) for c in ("dot", "cosine")))


def query_blocks(queries, rows, size=50_000):
    """Each row with each of the queries; these go to the tasks by blocks of about `size`, with one scan of the rows for each (of vectors of
    64 floats a block has some 15 MB)."""
    blocks = max(1, -(-queries.count() // size))
    part = F.pmod(F.xxhash64("vec_id"), F.lit(blocks))
    return reduce(DataFrame.unionByName, (rows.crossJoin(F.broadcast(queries.filter(part == k))) for k in range(blocks)))


@query("f19_json_int", "SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1")
def f19_json_int(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(json_int(F.col("props"), "k").alias("k")).agg(F.count("*").alias("n"))


@query("f21_texts", "SELECT lang, count(DISTINCT md5(text)) AS texts, CAST(sum(len([w for w in regexp_split_to_array(text, '\\s+') if w <> ''])) AS BIGINT) AS words FROM documents GROUP BY lang")
def f21_texts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.groupBy("lang").agg(F.count_distinct(F.md5("text")).alias("texts"), F.sum(word_count(F.col("text"))).alias("words"))


@query("f21_conversation_turns", "SELECT role, count(*) AS turns, count(DISTINCT conv_id) AS conversations, CAST(max(turn) AS BIGINT) AS longest FROM conversations GROUP BY role")
def f21_conversation_turns(spark, sf_dir):
    return table(spark, sf_dir, "conversations").groupBy("role").agg(F.count("*").alias("turns"), F.count_distinct("conv_id").alias("conversations"), F.max("turn").alias("longest"))


sql("f20_conversions_of_columns", """SELECT event_id, try_cast(get_json_object(props, '$.k') AS INT) AS k, try_cast(event_type AS DOUBLE) IS NULL AS no_number, event_type COLLATE UTF8_LCASE = 'CLICK' AS click,
    isnan(CASE WHEN event_type = 'error' THEN double('NaN') ELSE value END) AS nan, CASE WHEN event_type = 'error' THEN double('NaN') ELSE value END = CASE WHEN event_type = 'error' THEN double('NaN') ELSE 0D END AS same FROM {events}""",
    """SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS INT) AS k, TRY_CAST(event_type AS DOUBLE) IS NULL AS no_number, lower(event_type) = 'click' AS click,
    isnan(CASE WHEN event_type = 'error' THEN 'NaN'::DOUBLE ELSE value END) AS nan, CASE WHEN event_type = 'error' THEN 'NaN'::DOUBLE ELSE value END = CASE WHEN event_type = 'error' THEN 'NaN'::DOUBLE ELSE 0 END AS same FROM events""")
