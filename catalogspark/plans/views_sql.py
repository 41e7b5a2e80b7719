"""The same catalogue views as DuckDB common table expressions, for the side-by-side check."""

SITE = "https://shop.example.com"
AS_OF = "TIMESTAMP '2001-08-02 00:00:00'"
EVENTS_AS_OF = "TIMESTAMP '2024-01-31 00:00:00'"

VIEWS = {
    "navigation": f"""
  SELECT id, title, '{SITE}/nav/' || id AS source_url, parent_id,
         {AS_OF} - to_days(CAST(key % 40 AS INTEGER)) AS last_scraped_at
  FROM (SELECT 'r' || r_regionkey AS id, r_name AS title, CAST(NULL AS VARCHAR) AS parent_id, r_regionkey AS key FROM region
        UNION ALL SELECT 'n' || n_nationkey, n_name, 'r' || n_regionkey, n_nationkey FROM nation
        UNION ALL SELECT 's' || s_suppkey, s_name,
               CASE WHEN s_suppkey % 50 = 7 THEN 'n999' ELSE 'n' || s_nationkey END, s_suppkey FROM supplier)""",
    "category": f"""
  SELECT id, CASE WHEN no = 99 THEN 'n99' ELSE 'n' || (no % 25) END AS navigation_id,
         'Brand ' || no AS title, '{SITE}/collections/brand-' || no AS source_url,
         CAST(no * 3 AS INTEGER) AS product_count, {AS_OF} - to_days(CAST(no % 10 AS INTEGER)) AS last_scraped_at
  FROM (SELECT DISTINCT p_brand AS id, CAST(substr(p_brand, 7) AS INTEGER) AS no FROM part
        UNION ALL SELECT 'Brand#0', 0 UNION ALL SELECT 'Brand#99', 99)""",
    "product": f"""
  SELECT CAST(p_partkey AS VARCHAR) AS id, p_partkey AS k,
         CASE WHEN p_partkey % 23 = 0 THEN NULL WHEN p_partkey % 29 = 0 THEN 'Brand#404' ELSE p_brand END AS category_id,
         p_name AS title, '{SITE}/products/' || p_partkey AS source_url, 'P' || p_partkey AS source_id,
         CAST(CASE WHEN p_partkey % 17 = 0 THEN NULL ELSE p_retailprice END AS DECIMAL(10,2)) AS price,
         CASE WHEN p_partkey % 5 = 0 THEN 'USD' WHEN p_partkey % 7 = 0 THEN 'EUR' ELSE 'GBP' END AS currency,
         list_transform(range(1, 1 + p_partkey % 4),
                        lambda i: 'https://cdn.example.com/img/' || p_partkey || '-' || i || '.jpg') AS image_urls,
         CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE 'Summary of ' || p_name END AS summary,
         p_type AS spec_type, CAST(p_size AS VARCHAR) AS spec_size, 'Author ' || (p_partkey % 50) AS spec_author,
         CASE WHEN p_partkey % 3 = 0 THEN '978' || p_partkey END AS spec_isbn,
         CASE WHEN p_partkey % 11 = 0 THEN 'n/a' ELSE CAST(p_partkey % 700 + 20 AS VARCHAR) END AS spec_pages,
         CASE WHEN p_partkey % 2 = 0 THEN 'Paperback' ELSE '' END AS spec_format,
         p_partkey % 10 <> 0 AS available,
         {AS_OF} - to_days(CAST(p_partkey % 60 AS INTEGER)) AS last_scraped_at,
         {AS_OF} - to_hours(CAST((p_partkey * 37) % 1000 AS INTEGER)) AS created_at
  FROM part""",
    "scrape_job": f"""
  SELECT *, '{SITE}/' || type || '/' || c AS target_url,
         CASE WHEN status IN ('completed', 'failed') THEN updated_at END AS completed_at,
         CASE WHEN status = 'failed' AND o % 2 = 0 THEN 'timeout on ' || o END AS last_error
  FROM (SELECT o_orderkey AS o, o_custkey AS c, 'j' || o_orderkey AS id,
          CASE o_custkey % 3 WHEN 0 THEN 'navigation' WHEN 1 THEN 'category' ELSE 'product' END AS type,
          CASE WHEN o_orderstatus = 'O' THEN 'queued' WHEN o_orderstatus = 'P' THEN 'running'
               WHEN o_orderkey % 5 = 0 THEN 'failed' ELSE 'completed' END AS status,
          CAST(o_orderkey % 4 AS INTEGER) AS attempts, 3 AS max_attempts,
          6 - CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS priority,
          CASE WHEN o_orderstatus = 'P' THEN {AS_OF} - to_minutes(CAST(o_orderkey % 60 AS INTEGER)) END AS locked_at,
          CASE WHEN o_orderstatus = 'P' THEN 'worker-' || (o_custkey % 8) END AS locked_by,
          o_orderdate AS created_at, o_orderdate + to_hours(CAST(o_orderkey % 72 AS INTEGER)) AS updated_at
        FROM orders)""",
    "log": """
  SELECT event_id, ts AS timestamp, event_type AS message, props AS metadata,
         CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN 'warn' ELSE 'info' END AS level,
         CASE user_id % 5 WHEN 0 THEN 'scraper' WHEN 1 THEN 'crawler' WHEN 2 THEN 'queue'
                          WHEN 3 THEN 'database' ELSE 'storage' END AS component
  FROM events""",
    "clickstream": """
  SELECT event_id, ts, (epoch_us(ts) // 1000) AS ts_ms, user_id, event_type AS event, value, props,
         (epoch_us(date_trunc('day', ts)) // 1000) || '-' || user_id AS session_id
  FROM events""",
    "cache_access": """
  SELECT event_id, 'user-' || user_id AS key, ts, (epoch_us(ts) // 1000) AS ts_ms, value,
         CASE WHEN event_type IN ('view', 'purchase') THEN 'hit' WHEN event_type = 'click' THEN 'stale'
              WHEN event_type = 'signup' THEN 'miss' ELSE 'error' END AS outcome
  FROM events""",
}


def with_views(sql: str, *names: str, recursive: bool = False, **extra: str) -> str:
    """Prefix a query with the views it reads."""
    parts = [f"{name} AS ({VIEWS[name]})" for name in names] + [f"{name} AS ({text})" for name, text in extra.items()]
    return f"WITH {'RECURSIVE ' if recursive else ''}{', '.join(parts)}\n{sql}"
