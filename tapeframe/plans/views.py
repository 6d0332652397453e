"""The domain tables again, as SQL for the checking statements."""

from tapeframe.plans.registry import view

view("fx_bars", """
SELECT ticker, date, max(CASE WHEN rn = 1 THEN px END) AS open, max(px) AS high, min(px) AS low,
       max(CASE WHEN rn = n THEN px END) AS close, sum(q) AS volume,
       CAST(sum(CAST(round(v * 100) AS BIGINT)) AS DOUBLE) / 100 AS trading_value
FROM (SELECT concat('S', l_suppkey) AS ticker, CAST(l_shipdate AS DATE) AS date,
             l_extendedprice / l_quantity AS px, l_quantity AS q, l_extendedprice AS v,
             row_number() OVER (PARTITION BY l_suppkey, CAST(l_shipdate AS DATE)
                                ORDER BY l_orderkey, l_linenumber, l_extendedprice / l_quantity) AS rn,
             count(*) OVER (PARTITION BY l_suppkey, CAST(l_shipdate AS DATE)) AS n
      FROM lineitem WHERE l_quantity > 0)
GROUP BY ticker, date
""")
view("fx_benchmark", """
SELECT date, CAST(sum(CAST(round(trading_value * 100) AS BIGINT)) AS DOUBLE) / 100 / sum(volume) AS close,
       sum(volume) AS volume FROM fx_bars GROUP BY date
""")
view("fx_companies", """
SELECT concat('S', s_suppkey) AS ticker, s_name AS company_name,
       CASE WHEN s_nationkey % 2 = 0 THEN 'HOSE' ELSE 'HNX' END AS exchange,
       r_name AS sector, n_name AS industry,
       CASE WHEN s_acctbal > 0 THEN s_acctbal * 10000 END AS market_cap,
       CASE WHEN s_acctbal < 0 THEN 'restricted' ELSE 'normal' END AS trading_status
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
""")


def _total(value: str) -> str:
    return f"CAST(sum(CAST(round(({value}) * 10000) AS BIGINT)) AS DOUBLE) / 10000"


view("fx_fin_wide", f"""
SELECT concat('S', k) AS ticker, fiscal_year, make_date(fiscal_year, 12, 31) AS period_end,
       r AS revenue, r - c AS gross_profit, 0.55 * r - c AS ebit,
       i AS interest_expense, 0.55 * r - c - i AS profit_before_tax,
       0.8 * (0.55 * r - c - i) AS net_income, 0.8 * (0.55 * r - c - i) / 1000 AS eps,
       2 * e AS total_assets, eq + 0.15 * e AS equity, 1.85 * e - eq AS total_liabilities,
       cash AS cash_and_cash_equivalents, ca AS current_assets, cl AS current_liabilities,
       sb AS short_term_borrowings, lb AS long_term_borrowings,
       cfo AS operating_cash_flow, 0.05 * e AS depreciation,
       CASE WHEN fiscal_year % 2 = 0 THEN 0.01 * e END AS amortization
FROM (SELECT l_suppkey AS k, year(l_shipdate) AS fiscal_year,
         {_total('l_extendedprice * (1 - l_discount)')} AS r, {_total('l_quantity * p_retailprice')} AS c,
         {_total('l_extendedprice * l_tax')} AS i, {_total('l_extendedprice')} AS e,
         {_total("CASE WHEN l_linestatus = 'F' THEN l_extendedprice ELSE -l_extendedprice END")} AS cfo,
         {_total("CASE WHEN l_linestatus = 'O' THEN l_extendedprice ELSE -0.8 * l_extendedprice END")} AS eq,
         {_total("CASE WHEN l_returnflag = 'N' THEN l_extendedprice END")} AS ca,
         {_total("CASE WHEN l_returnflag = 'A' THEN l_extendedprice END")} AS cl,
         {_total('CASE WHEN l_discount >= 0.095 THEN l_extendedprice END')} AS sb,
         {_total('CASE WHEN l_discount <= 0.005 THEN l_extendedprice END')} AS lb,
         {_total('CASE WHEN l_linenumber = 1 THEN l_extendedprice END')} AS cash
      FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_suppkey, year(l_shipdate))
WHERE (k + fiscal_year) % 11 <> 0
""")
view("fx_actions", """
SELECT ticker, min(date) AS ex_date,
       CASE year(date) % 5 WHEN 0 THEN 'cash_dividend' WHEN 1 THEN 'stock_dividend' WHEN 2 THEN 'stock_split'
            WHEN 3 THEN 'rights_issue' ELSE 'capital_increase' END AS action_type,
       CASE WHEN year(date) % 5 = 0 THEN CAST(15.0 AS DOUBLE) END AS cash_dividend,
       CASE WHEN year(date) % 5 = 1 THEN CAST(10.0 AS DOUBLE) END AS stock_ratio,
       CASE WHEN year(date) % 5 = 2 THEN CAST(2.0 AS DOUBLE) END AS split_ratio,
       CASE WHEN year(date) % 5 = 3 THEN CAST(0.2 AS DOUBLE) END AS rights_ratio,
       CASE WHEN year(date) % 5 = 3 THEN CAST(100.0 AS DOUBLE) END AS rights_price
FROM fx_bars GROUP BY ticker, year(date)
""")
view("fx_trades", """
SELECT event_id AS id, user_id AS account,
       CASE WHEN event_type IN ('purchase', 'click', 'view') THEN 'BUY' ELSE 'SELL' END AS side,
       concat('S', CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) % 5) AS ticker,
       CAST(1 + floor(value) % 10 AS BIGINT) AS quantity, value + 10 AS price,
       CAST(ts AS TIMESTAMP) AS executed_at, CAST(ts AS DATE) AS market_date
FROM events
""")
view("fx_ticks", """
SELECT concat('S', user_id) AS ticker, ts, value AS price, 1 + event_id % 7 AS size, event_id AS tick_id FROM events
""")
view("fx_news", """
SELECT doc_id, split_part(text, chr(10), 1) AS title, text AS content, lang, source,
       CASE doc_id % 3 WHEN 0 THEN 'company' WHEN 1 THEN 'industry' ELSE 'macro' END AS category FROM documents
""")
