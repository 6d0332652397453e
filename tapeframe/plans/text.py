"""Text relevance over the document tables; whole texts are read."""

from pyspark.sql import functions as F

from tapeframe.operators import textmatch as tm
from tapeframe.plans.registry import query, view
from tapeframe.sources.driver import Market

# The driver's prose is invented, so its own words stand in for names and keywords.
KEYWORDS = {"banking": ["tion", "erst"], "retail": ["eau", "oux"], "steel": ["schen", "und"], "energy": ["que", "ción"]}
COUNTRY, MACRO, TITLE = ["the", "les"], ["tion", "ment"], ["an", "en", "on"]
EVENTS, PUBLICITY = ["tion", "ment", "ing", "er"], ["the", "que"]
HINTS = [(["nation_1", "nation_2"], "first"), (["nation_3"], "second"), (["africa", "nation_4"], "third")]


def sql_any(text: str, terms: list[str]) -> str:
    return "(" + " OR ".join(f"contains({text}, '{t}')" for t in terms) + ")"


ARTICLE = "NOT (contains(lower(trim(title)), 'vietstockfinance') OR starts_with(lower(trim(title)), 'tìm kiếm:') OR starts_with(lower(trim(title)), 'tin tức, bài viết mới nhất'))"

# Companies named after the first words of the benchmark texts, with a word of them as ticker.
view("tx_companies", r"""
SELECT 'B' || item_id AS ticker0, upper(regexp_extract_all(lower(text), '([a-z0-9]+)', 1)[3]) AS ticker,
       array_to_string(regexp_extract_all(lower(text), '([\p{L}\p{N}_]+)', 1)[1:3], ' ') AS company_name FROM benchmark
""")
view("tx_stop", "SELECT unnest([" + ", ".join(f"'{w}'" for w in tm.STOP_WORDS) + "]) AS word")


def companies(market: Market):
    text = F.lower("text")
    names = F.array_join(F.slice(tm.words(text), 1, 3), " ")
    return market.table("benchmark").select(F.upper(F.get(tm.code_tokens(text), F.lit(2))).alias("ticker"), names.alias("company_name"))


@query("company_match", rf"""
WITH docs AS (SELECT doc_id, lower(concat_ws(' ', title, content)) AS body FROM fx_news WHERE {ARTICLE} AND NOT {sql_any('lower(title)', tm.DERIVATIVE_TERMS)}),
own AS (SELECT ticker, company_name, list_filter(list_distinct(regexp_extract_all(lower(company_name), '([\p{{L}}\p{{N}}_]+)', 1)),
        lambda w: length(w) >= 4 AND NOT list_contains([{', '.join(repr(w) for w in tm.STOP_WORDS)}], w)) AS ws FROM tx_companies),
dw AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(body, '([\p{{L}}\p{{N}}_]+)', 1)) AS word FROM docs),
dc AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(body, '([a-z0-9]+)', 1)) AS code FROM docs)
SELECT doc_id, ticker FROM (
  SELECT dw.doc_id, o.ticker, o.company_name, count(*) AS hits, max(CASE WHEN o.n = 1 THEN 1 ELSE 2 END) AS needed
  FROM dw JOIN (SELECT ticker, company_name, unnest(ws) AS word, len(ws) AS n FROM (SELECT DISTINCT * FROM own)) o ON o.word = dw.word GROUP BY ALL) WHERE hits >= needed
UNION SELECT dc.doc_id, c.ticker FROM dc JOIN tx_companies c ON lower(c.ticker) = dc.code
""")
def company_match(spark, folder):
    market = Market(spark, folder)
    return tm.company_match(market.news, companies(market))


# Industry texts of companies: some contain a keyword's name, some stand for themselves, one is too wide.
INDUSTRIES = ["Retail banking", "steel and energy", "ouxeau", "und", "the", "Other"]
UNSPECIFIC = ["the", "other"]
view("tx_terms", "SELECT DISTINCT industry, term FROM (" + " UNION ALL ".join(
    f"SELECT i.industry, unnest([{', '.join(repr(t) for t in terms)}]) AS term FROM (SELECT unnest({INDUSTRIES}) AS industry) i WHERE contains(lower(i.industry), '{key}')"
    for key, terms in KEYWORDS.items()) + " UNION ALL SELECT industry, lower(trim(industry)) FROM (SELECT unnest(" + str(INDUSTRIES) + ") AS industry) i WHERE NOT "
     + sql_any("lower(i.industry)", list(KEYWORDS)) + " AND lower(i.industry) NOT IN (" + ", ".join(f"'{u}'" for u in UNSPECIFIC) + "))")


@query("industry_match", f"SELECT DISTINCT n.doc_id, t.industry FROM fx_news n JOIN tx_terms t ON contains(lower(n.title), t.term) WHERE {ARTICLE}")
def industry_match(spark, folder):
    industries = spark.createDataFrame([(i,) for i in INDUSTRIES], "industry string")
    return tm.industry_match(Market(spark, folder).news, industries, KEYWORDS, UNSPECIFIC)


_HINT = "CASE " + " ".join(f"WHEN {sql_any('t', terms)} THEN '{label}'" for terms, label in HINTS) + " ELSE industry END"


@query("industry_hint", f"SELECT ticker, {_HINT} AS industry FROM (SELECT ticker, industry, lower(concat_ws(' ', company_name, concat_ws(' ', sector, industry))) AS t FROM fx_companies)")
def industry_hint(spark, folder):
    rows = Market(spark, folder).companies
    place = F.concat_ws(" ", "sector", "industry")
    hint = tm.industry_hint(F.col("company_name"), place, HINTS)
    return rows.select("ticker", F.when(hint == place, F.col("industry")).otherwise(hint).alias("industry"))


@query("macro_match", f"SELECT doc_id, lang FROM fx_news WHERE {ARTICLE} AND {sql_any('lower(concat_ws(chr(32), title, content))', COUNTRY)} AND {sql_any('lower(concat_ws(chr(32), title, content))', MACRO)} AND {sql_any('lower(title)', TITLE)}")
def macro_match(spark, folder):
    return tm.macro_match(Market(spark, folder).news, COUNTRY, MACRO, TITLE).select("doc_id", "lang")


_PRIORITY = "(" + " + ".join(f"2 * contains(lower(title), '{t}')::INT" for t in EVENTS) + " - " + " - ".join(f"2 * contains(lower(title), '{t}')::INT" for t in PUBLICITY) + ")"


@query("company_priority", f"SELECT doc_id, CAST({_PRIORITY} AS BIGINT) AS priority FROM fx_news")
def company_priority(spark, folder):
    return Market(spark, folder).news.select("doc_id", tm.company_priority(F.col("title"), EVENTS, PUBLICITY).alias("priority"))


view("tx_cand", f"SELECT doc_id, lang, category, CAST({_PRIORITY} AS BIGINT) AS priority, concat('https://news.example.org/', doc_id % 7) AS url FROM fx_news")
view("tx_best", "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, category, url ORDER BY priority DESC, doc_id) AS r FROM tx_cand) WHERE r = 1")


def sql_pick(category: str, used: str) -> str:
    return (f"SELECT lang, '{category}' AS category, doc_id, url FROM (SELECT b.*, row_number() OVER (PARTITION BY lang ORDER BY priority DESC, doc_id) AS k "
            f"FROM tx_best b WHERE category = '{category}'{used}) WHERE k = 1")


view("tx_p1", sql_pick("company", ""))
view("tx_p2", sql_pick("industry", " AND NOT EXISTS (SELECT 1 FROM tx_p1 p WHERE p.lang = b.lang AND p.url = b.url)"))
view("tx_p3", sql_pick("macro", " AND NOT EXISTS (SELECT 1 FROM tx_p1 p WHERE p.lang = b.lang AND p.url = b.url) AND NOT EXISTS (SELECT 1 FROM tx_p2 p WHERE p.lang = b.lang AND p.url = b.url)"))


@query("pick_sources", "SELECT * FROM tx_p1 UNION ALL SELECT * FROM tx_p2 UNION ALL SELECT * FROM tx_p3")
def pick_sources(spark, folder):
    rows = Market(spark, folder).news.select(
        "doc_id", "lang", "category", tm.company_priority(F.col("title"), EVENTS, PUBLICITY).alias("priority"),
        F.concat(F.lit("https://news.example.org/"), (F.col("doc_id") % 7).cast("string")).alias("url"))
    return tm.pick_sources(rows, "lang", ["company", "industry", "macro"])


@query("cited_ids", """
SELECT DISTINCT c.conv_id, c.turn, d.doc_id AS cited, d.lang FROM (
  SELECT conv_id, turn, unnest([conv_id % 50, turn, conv_id % 50]) AS cited FROM conversations) c JOIN documents d ON d.doc_id = c.cited
""")
def cited_ids(spark, folder):
    """Answers that cite documents by number, joined to what they cite."""
    market = Market(spark, folder)
    mark = lambda n: F.concat(F.lit(" ["), n.cast("string"), F.lit("]"))
    plain = F.regexp_replace("text", r"[\[\]]", " ")
    answers = market.table("conversations").select("conv_id", "turn", F.concat(
        plain, mark(F.col("conv_id") % 50), mark(F.col("turn")), F.lit(" see"), mark(F.col("conv_id") % 50)).alias("text"))
    docs = market.table("documents").select(F.col("doc_id").alias("cited"), "lang")
    return tm.cited_ids(answers, "text").join(docs, "cited").select("conv_id", "turn", "cited", "lang")


@query("strip_markup", r"""
SELECT doc_id, regexp_replace(regexp_replace(replace(replace(concat('## ', text), '*', ''), '`', ''), '(?m)^\s{0,3}#{1,6}\s*', '', 'g'), '^\s+|\s+$', '', 'g') AS plain FROM documents
""")
def strip_markup(spark, folder):
    marked = F.concat(F.lit("## **"), F.col("text"), F.lit("**"))
    return Market(spark, folder).table("documents").select("doc_id", tm.strip_markup(marked).alias("plain"))


@query("trusted_domain", r"""
SELECT page_id, host FROM (SELECT page_id, lower(regexp_extract(CASE WHEN page_id % 3 = 0 THEN url ELSE replace(url, 'http://', 'https://') END, '^https://([^/:?#]+)', 1)) AS host FROM pages)
WHERE host <> '' AND (host = 'example.com' OR ends_with(host, '.example.com'))
""")
def trusted_domain(spark, folder):
    k = F.when(F.col("page_id") % 3 == 0, F.col("url")).otherwise(F.regexp_replace("url", "http://", "https://"))
    rows = Market(spark, folder).table("pages").select("page_id", k.alias("url"))
    return rows.filter(tm.trusted_domain(F.col("url"), ["example.com"])).select(
        "page_id", F.lower(F.regexp_extract("url", r"^https://([^/:?#]+)", 1)).alias("host"))
