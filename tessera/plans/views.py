"""The catalogue's tables as projections of the relational test tables, for Spark and, in SQL, for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Each view as SQL that Spark and DuckDB both read; `{...}` names the tables under it.
VIEWS = {
    "sets": """SELECT n_nationkey AS set_id, CAST(n_regionkey AS VARCHAR(9)) AS game_id, n_name AS set_code, n_name AS set_name,
        concat('20', lpad(CAST(n_nationkey % 7 AS VARCHAR(9)), 2, '0'), '-01-01') AS release_date FROM nation""",
    "cards": "SELECT DISTINCT p_name AS card_id, p_name AS name, concat('art:', p_name) AS art_id FROM part",
    "printings": """SELECT CAST(p.p_partkey AS VARCHAR(20)) AS id, p.p_partkey AS ordinal, p.p_name AS card_id, p.p_name AS name, concat('art:', p.p_name) AS art_id,
        s.game_id, s.set_id, s.set_code, s.set_name, s.release_date,
        concat(CASE p.p_partkey % 3 WHEN 0 THEN 'OP' WHEN 1 THEN 'ST' ELSE 'EB' END, lpad(CAST(p.p_size AS VARCHAR(9)), 2, '0'), '-', lpad(CAST(p.p_partkey % 1000 AS VARCHAR(9)), 3, '0')) AS number,
        CAST(p.p_size AS VARCHAR(9)) AS set_total, p.p_type AS rarity, CASE p.p_type WHEN 'PROMO' THEN 'foil' WHEN 'ECONOMY' THEN 'reverse' ELSE 'normal' END AS variant, 'en' AS language,
        CASE WHEN p.p_size % 7 <> 0 THEN concat('http://img/', CAST(p.p_partkey AS VARCHAR(20))) END AS image_url,
        CASE WHEN p.p_partkey % 3 = 0 THEN 1 END AS fingerprinted_at, p.p_retailprice AS updated
        FROM part p JOIN sets s ON CAST(substr(p.p_brand, 7) AS INT) - 1 = s.set_id""",
    "prices": """SELECT CAST(l_partkey AS VARCHAR(20)) AS printing_id, CAST(l_suppkey AS VARCHAR(20)) AS source, l_extendedprice AS market, l_discount AS low, l_shipdate AS as_of,
        l_orderkey, l_linenumber, l_quantity FROM lineitem""",
    "versions": """SELECT CAST(o_custkey AS VARCHAR(20)) AS game_id, CAST(o_orderkey AS VARCHAR(20)) AS version, CAST(floor(o_totalprice) AS BIGINT) AS printings_count,
        CASE WHEN o_orderpriority = '1-URGENT' THEN concat('games/', CAST(o_custkey AS VARCHAR(20)), '/index-', CAST(o_orderkey AS VARCHAR(20)), '.bin') END AS index_pack_key,
        o_orderdate AS created_at FROM orders""",
    "reads": """SELECT s_suppkey AS scan_id, CAST(n.n_regionkey AS VARCHAR(9)) AS game_id,
        concat(CASE s_suppkey % 3 WHEN 0 THEN 'OP' WHEN 1 THEN 'ST' ELSE 'EB' END, lpad(CAST(p_size AS VARCHAR(9)), 2, '0'), '-', lpad(CAST((s_suppkey + s_suppkey % 2) % 1000 AS VARCHAR(9)), 3, '0')) AS serial,
        p_name AS seen, s_acctbal FROM supplier JOIN nation n ON n.n_nationkey = s_nationkey JOIN part ON p_partkey = s_suppkey""",
    "detections": """SELECT event_id, value, width, height, CASE turn WHEN 0 THEN a0 WHEN 1 THEN a2 WHEN 2 THEN a4 ELSE a6 END AS c0, CASE turn WHEN 0 THEN a1 WHEN 1 THEN a3 WHEN 2 THEN a5 ELSE a7 END AS c1,
        CASE turn WHEN 0 THEN a2 WHEN 1 THEN a4 WHEN 2 THEN a6 ELSE a0 END AS c2, CASE turn WHEN 0 THEN a3 WHEN 1 THEN a5 WHEN 2 THEN a7 ELSE a1 END AS c3,
        CASE turn WHEN 0 THEN a4 WHEN 1 THEN a6 WHEN 2 THEN a0 ELSE a2 END AS c4, CASE turn WHEN 0 THEN a5 WHEN 1 THEN a7 WHEN 2 THEN a1 ELSE a3 END AS c5,
        CASE turn WHEN 0 THEN a6 WHEN 1 THEN a0 WHEN 2 THEN a2 ELSE a4 END AS c6, CASE turn WHEN 0 THEN a7 WHEN 1 THEN a1 WHEN 2 THEN a3 ELSE a5 END AS c7
        FROM (SELECT event_id, value, event_id % 4 AS turn, CAST(640 + event_id % 3 * 320 AS DOUBLE) AS width, CAST(480 AS DOUBLE) AS height,
        CAST(event_id % 7 AS DOUBLE) / 97 + 0.1 AS a0, CAST(event_id % 8 AS DOUBLE) / 97 + 0.1 AS a1, CAST(event_id % 9 AS DOUBLE) / 89 + CASE WHEN event_id % 19 = 0 THEN 1.6 ELSE 0.6 END AS a2, CAST(event_id % 10 AS DOUBLE) / 83 + 0.15 AS a3,
        CAST(event_id % 11 AS DOUBLE) / 79 + 0.55 AS a4, CAST(event_id % 12 AS DOUBLE) / 73 + 0.7 AS a5, CAST(event_id % 13 AS DOUBLE) / 71 + 0.05 AS a6, CAST(event_id % 14 AS DOUBLE) / 67 + 0.75 AS a7 FROM events ) made""",
    "index_rows": "SELECT CAST(vec_id AS VARCHAR(20)) AS id, CAST(vec_id AS BIGINT) AS row, embedding, label FROM embeddings",
}
NEEDS = {"sets": ["nation"], "cards": ["part"], "printings": ["part", "sets"], "prices": ["lineitem"], "versions": ["orders"], "reads": ["supplier", "nation", "part"], "detections": ["events"], "index_rows": ["embeddings"]}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view of VIEWS, or a test table itself."""
    if name not in VIEWS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql, below = VIEWS[name], {t: view(spark, sf_dir, t) for t in NEEDS[name]}
    for t in below:
        for lead in ("FROM ", "JOIN "):
            sql = sql.replace(f"{lead}{t} ", f"{lead}{{{t}}} ").replace(f"{lead}{t}\n", f"{lead}{{{t}}}\n")
        sql = sql.removesuffix(f"FROM {t}") + (f"FROM {{{t}}}" if sql.endswith(f"FROM {t}") else "")
    return spark.sql(sql, **below)


def with_views(sql: str, *names: str) -> str:
    """sql behind common table expressions of the views it names and those under them."""
    order: list[str] = []

    def add(name: str) -> None:
        if name in VIEWS and name not in order:
            for t in NEEDS[name]:
                add(t)
            order.append(name)

    for name in names:
        add(name)
    parts = [f"{n} AS ({VIEWS[n]})" for n in order]
    rest = sql.lstrip()
    lead = "WITH RECURSIVE " if rest.startswith("RECURSIVE ") else "WITH "
    rest = rest.removeprefix("RECURSIVE ").lstrip()
    more = rest.startswith("+")  # goes on with the list
    return f"{lead}{', '.join(parts)}{', ' if more and parts else ' '}{rest.removeprefix('+')}"
