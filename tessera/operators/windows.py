"""Window functions, and spelled-out forms of the clauses that Spark's parser rejects."""

from __future__ import annotations

from tessera.plans.registry import Registry


def register_queries(r: Registry) -> None:
    r.sql(
        "win_ranks",
        "orders",
        """SELECT o_orderkey, CAST(rank() OVER w AS BIGINT) AS r, CAST(dense_rank() OVER w AS BIGINT) AS d,
        round(percent_rank() OVER w, 9) AS p, round(cume_dist() OVER w, 9) AS c FROM orders
        WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate)""",
    )
    r.sql(
        "win_row_number_ntile",
        "orders",
        """SELECT o_orderkey, CAST(row_number() OVER w AS BIGINT) AS rn, CAST(ntile(4) OVER w AS BIGINT) AS q FROM orders
        WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey)""",
    )
    r.sql(
        "win_lag_lead",
        "events",
        """SELECT event_id, lag(event_id, 1, -1) OVER w AS before, lead(event_id, 2, -1) OVER w AS after FROM events
        WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""",
    )
    r.sql(
        "win_first_last_nth",
        "events",
        """SELECT event_id, first_value(event_id) OVER w AS f, last_value(event_id) OVER w AS l, nth_value(event_id, 2) OVER w AS n FROM events
        WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""",
    )
    r.sql(
        "win_rows_frame",
        "events",
        """SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), 6) AS moving
        FROM events""",
    )
    r.sql(
        "win_range_frame",
        "events",
        """SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '12' HOUR PRECEDING AND CURRENT ROW) AS n
        FROM events""",
    )
    r.sql(
        "win_ignore_nulls",
        "events",
        """SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN event_id END) IGNORE NULLS
        OVER (PARTITION BY user_id ORDER BY ts, event_id) AS last_purchase FROM events""",
        """SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS)
        OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_purchase FROM events""",
    )
    r.sql(
        "win_qualify",
        "orders",
        """SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS rn
        FROM orders) WHERE rn = 1""",
        """SELECT o_custkey, o_orderkey FROM orders
        QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) = 1""",
    )
    r.sql(
        "win_groups_frame",
        "orders",
        """WITH g AS (SELECT *, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderdate) AS grp FROM orders)
        SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY grp RANGE BETWEEN 1 PRECEDING AND CURRENT ROW), 2) AS s FROM g""",
        """SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate
        GROUPS BETWEEN 1 PRECEDING AND CURRENT ROW), 2) AS s FROM orders""",
    )
    r.sql(
        "win_exclude_current",
        "orders",
        """SELECT o_orderkey, CAST(sum(CAST(o_totalprice AS DECIMAL(14, 2))) OVER (PARTITION BY o_custkey) - CAST(o_totalprice AS DECIMAL(14, 2)) AS STRING) AS others
        FROM orders""",
        """SELECT o_orderkey, CAST(coalesce(sum(CAST(o_totalprice AS DECIMAL(14, 2))) OVER (PARTITION BY o_custkey ORDER BY o_orderkey
        ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING EXCLUDE CURRENT ROW), 0) AS VARCHAR) AS others FROM orders""",
    )
    r.sql(
        "win_running_share",
        "orders",
        """SELECT o_orderkey, round(o_totalprice / sum(o_totalprice) OVER (PARTITION BY o_custkey), 8) AS share,
        count(*) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS nth FROM orders""",
    )
