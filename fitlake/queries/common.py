"""SQL text of the bindings in ``fitlake.sources.tables``, for the SQL counterparts."""

SERIES = """series AS (
  SELECT l_suppkey AS trial,
         row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber,
                            l_partkey, l_quantity, l_extendedprice) - 1 AS k,
         l_quantity + 0e0 AS x0, l_extendedprice + 0e0 AS x1, l_discount + 0e0 AS x2,
         l_tax + 0e0 AS x3
  FROM lineitem)"""

TRACES = """traces AS (
  SELECT o_custkey AS run,
         row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS step,
         o_totalprice AS logl, o_orderpriority AS context, o_orderstatus AS status, o_orderkey
  FROM orders)"""

NAN_TRACES = TRACES.replace(
    "o_totalprice AS logl",
    "CASE WHEN o_orderkey % 97 = 0 THEN 'NaN'::DOUBLE ELSE o_totalprice END AS logl")

RUNS = """last_order AS (
  SELECT o_custkey AS run, o_orderstatus AS status,
         row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn
  FROM orders),
runs AS (
  SELECT c_custkey AS run, c_name AS label, c_mktsegment AS split, 'n' || c_nationkey AS lam,
         c_nationkey AS nation,
         '(' || c_nationkey || ', ' || (c_custkey % 7) || ')' AS init_key,
         'Init params: (' || c_nationkey || ', ' || (c_custkey % 7) || ')' || chr(10)
           || 'segment ' || c_mktsegment AS reason,
         CASE o.status WHEN 'F' THEN 'Status: <OptimizerStatus.Converged>'
                       WHEN 'O' THEN 'Status: <OptimizerStatus.NotConverged>'
                       WHEN 'P' THEN 'Status: <OptimizerStatus.Failed>' END AS outcome,
         c_custkey * 977 % 200000 AS duration_s, c_acctbal AS score
  FROM customer LEFT JOIN (SELECT * FROM last_order WHERE rn = 1) o ON o.run = c_custkey)"""

# paths of web pages: scheme and query removed, split on '/'
FILES = """files AS (
  SELECT page_id, regexp_replace(regexp_replace(url, '[?#].*$', ''), '^https?://', '') AS path
  FROM pages)"""

ITEMS = """items AS (
  SELECT p_partkey AS id,
         list_concat(string_split(p_name, ' '), [p_type, p_brand]) AS tags
  FROM part)"""
