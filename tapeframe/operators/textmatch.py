"""Relevance of documents to companies, industries and the economy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tapeframe.runtime import stage

# Words too common in company names to identify one.
STOP_WORDS = ["ctcp", "cong", "công", "ty", "tap", "tập", "doan", "đoàn", "tong", "tổng", "ngan", "ngân", "hang", "hàng",
              "thuong", "thương", "mai", "mại", "viet", "việt", "nam"]
# Titles about derivatives and listings are not company news.
DERIVATIVE_TERMS = ["chứng quyền", "phái sinh", "quyền chọn", "giá cổ phiếu", "bảng giá"]
# Titles of search and index pages.
INDEX_PREFIXES = ["tìm kiếm:", "tin tức, bài viết mới nhất"]
INDEX_TERM = "vietstockfinance"
# Disclosure and publicity terms of the company ranking.
EVENT_TERMS = ["lợi nhuận", "doanh thu", "kết quả kinh doanh", "báo cáo tài chính", "kế hoạch kinh doanh", "dự án",
               "hợp đồng", "cổ tức", "phát hành", "tăng vốn", "tín dụng", "đại hội cổ đông"]
PUBLICITY_TERMS = ["vinh danh", "giải thưởng", "top 10", "top 100"]
# The three term lists of the macro filter.
COUNTRY_TERMS = ["việt nam", "vietnam", "ngân hàng nhà nước", "nhnn"]
MACRO_TERMS = ["lãi suất", "tín dụng", "tỷ giá", "usd/vnd", "gdp", "cpi", "lạm phát", "chính sách tiền tệ", "ngân hàng nhà nước"]
MACRO_TITLE_TERMS = ["việt nam", "vietnam", "ngân hàng nhà nước", "nhnn", "lãi suất", "tỷ giá", "tín dụng", "gdp", "cpi"]
# Industry words and the title keywords that count as news of it.
INDUSTRY_KEYWORDS = {
    "bất động sản": ["bất động sản", "nhà ở", "đất đai"],
    "ngân hàng": ["ngành ngân hàng", "các ngân hàng", "hệ thống ngân hàng", "tín dụng"],
    "công nghệ": ["ngành công nghệ", "phần mềm", "chuyển đổi số"],
    "dầu khí": ["dầu khí", "giá dầu", "xăng dầu"],
    "vận tải": ["vận tải", "logistics", "cước vận chuyển"],
    "bán lẻ": ["bán lẻ", "tiêu dùng nội địa"],
    "khoáng sản": ["khoáng sản", "kim loại", "khai khoáng"],
    "khai khoáng": ["khoáng sản", "kim loại", "khai khoáng", "quặng"],
    "xây dựng": ["xây dựng", "đầu tư công", "vật liệu xây dựng"],
    "thép": ["ngành thép", "giá thép", "tôn mạ", "sản lượng thép"],
    "nhựa": ["ngành nhựa", "hạt nhựa", "giá nhựa", "hóa chất"],
    "giấy": ["ngành giấy", "bột giấy", "giấy bao bì", "bao bì giấy"],
}
# Ordered hints from a company's name to its real industry.
INDUSTRY_HINTS = [
    (["hoa sen", "hòa phát", "hoà phát", "nam kim", "thép"], "ngành thép"),
    (["nhựa"], "nhựa và hóa chất"),
    (["ngân hàng", "bank"], "ngân hàng"),
    (["chứng khoán"], "chứng khoán"),
    (["vinhomes", "vingroup", "địa ốc", "bất động sản"], "bất động sản"),
    (["fpt", "công nghệ", "phần mềm"], "công nghệ phần mềm"),
    (["dầu", "petro", "lọc hóa"], "dầu khí"),
    (["cao su"], "cao su"),
    (["giấy", "bao bì"], "ngành giấy và bao bì"),
    (["khoáng sản", "khai khoáng", "quặng"], "khai khoáng và kim loại"),
    (["dược"], "dược phẩm"),
    (["điện", "năng lượng"], "điện và năng lượng"),
]
# Industries too wide for news of them.
UNSPECIFIC_INDUSTRIES = ["sản xuất", "dịch vụ", "khác"]


def contains_any(text: Column, terms: list[str]) -> Column:
    hit = F.lit(False)
    for term in terms:
        hit = hit | text.contains(term)
    return hit


def count_terms(text: Column, terms: list[str]) -> Column:
    return sum((text.contains(t).cast("long") for t in terms), F.lit(0).cast("long"))


def article_like(title: Column) -> Column:
    t = F.lower(F.trim(title))
    bad = t.contains(INDEX_TERM)
    for prefix in INDEX_PREFIXES:
        bad = bad | t.startswith(prefix)
    return ~bad


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}_]+)"), F.lit(1))


def code_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), F.lit(1))


def known_tokens(names: DataFrame, texts: DataFrame, tokens: Column, word: str) -> DataFrame:
    """(doc_id, bag): the distinct tokens of each text that occur in names.

    Tokens are looked up in the task that cuts the text, and only those that names use leave it: the vocabulary is a
    staged table of names, whose size Spark knows and broadcasts up to its limit; a larger one is joined by word.
    """
    vocabulary = stage(names.select(F.col(word).alias("token")).distinct(), "vocabulary")
    met = texts.select("doc_id", F.explode(tokens).alias("token")).join(vocabulary, "token", "left_semi")
    return met.groupBy("doc_id").agg(F.collect_set("token").alias("bag"))


def company_match(docs: DataFrame, companies: DataFrame) -> DataFrame:
    """(document, company) pairs: the ticker as a whole token, or enough distinctive name words.

    A name that needs h of its n words is looked for by its n - h + 1 rarest ones, of which every match has at least
    one; candidates are then tested on all words.  A word that most names share is thus never joined on unless a name
    has nothing rarer.
    """
    fit = docs.filter(article_like(F.col("title")) & ~contains_any(F.lower("title"), DERIVATIVE_TERMS))
    texts = fit.select("doc_id", F.concat_ws(" ", "title", "content").alias("body"))
    own = F.filter(F.array_distinct(words(F.col("company_name"))),
                   lambda w: (F.length(w) >= 4) & ~w.isin(STOP_WORDS))
    names = stage(companies.select("ticker", "company_name", own.alias("own"), F.when(F.size(own) == 1, 1).otherwise(2).alias("needed")).distinct(), "names")
    words_of = names.select("*", F.explode("own").alias("word"))
    bags = stage(known_tokens(words_of, texts, words(F.col("body")), "word"), "bags")
    common = words_of.join(bags.select(F.explode("bag").alias("word")).groupBy("word").agg(F.count("*").alias("n")), "word", "left")
    rarity = Window.partitionBy("ticker", "company_name").orderBy(F.coalesce("n", F.lit(0)), "word")
    keyed = common.withColumn("rn", F.row_number().over(rarity)).filter(F.col("rn") <= F.size("own") - F.col("needed") + 1)
    keyed = stage(keyed.select("word", "ticker", "own", "needed"), "keyed")  # of known size, so the bags of all documents are never the side that is broadcast
    tried = bags.select("doc_id", "bag", F.explode("bag").alias("word")).hint("shuffle_merge").join(keyed, "word")
    by_word = tried.filter(F.size(F.array_intersect("bag", "own")) >= F.col("needed")).select("doc_id", "ticker")
    codes = names.filter("ticker <> ''").select("ticker", F.lower("ticker").alias("code")).distinct()
    by_code = known_tokens(codes, texts, code_tokens(F.col("body")), "code").select("doc_id", F.explode("bag").alias("code")).join(codes, "code").select("doc_id", "ticker")
    return by_word.union(by_code).distinct()


def industry_terms(industry: Column, keywords: dict[str, list[str]], unspecific: list[str]) -> Column:
    """Terms of every keyword entry that the industry's text contains, else its own name, else none."""
    text = F.trim(F.lower(industry))
    listed = F.flatten(F.filter(F.array(*[F.when(text.contains(key), F.array(*map(F.lit, terms))) for key, terms in keywords.items()]), lambda t: t.isNotNull()))
    own = F.when(~text.isin(unspecific) & (text != ""), F.array(text)).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.when(F.size(listed) > 0, listed).otherwise(own))


def industry_match(docs: DataFrame, industries: DataFrame, keywords: dict[str, list[str]] = INDUSTRY_KEYWORDS,
                   unspecific: list[str] = UNSPECIFIC_INDUSTRIES) -> DataFrame:
    """(document, industry) pairs by a term of the industry in the title only.

    ``industries`` has the distinct industry texts of companies, a short vocabulary by nature; titles meet them by term,
    and only terms that occur are paired.
    """
    terms = industries.select("industry").distinct().select("industry", F.explode(industry_terms(F.col("industry"), keywords, unspecific)).alias("term"))
    vocabulary = [r.term for r in terms.select("term").distinct().collect()]
    title = F.lower("title")
    hits = F.array_compact(F.array(*[F.when(title.contains(t), F.lit(t)) for t in vocabulary])) if vocabulary else F.array().cast("array<string>")
    fit = docs.filter(article_like(F.col("title"))).select("doc_id", F.explode(hits).alias("term"))
    return fit.join(terms, "term").select("doc_id", "industry").distinct()


def industry_hint(name: Column, industry: Column, hints=INDUSTRY_HINTS) -> Column:
    text = F.lower(F.concat_ws(" ", name, industry))
    out = None
    for terms, label in hints:
        hit = contains_any(text, terms)
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise(industry)


def macro_match(docs: DataFrame, country=COUNTRY_TERMS, macro=MACRO_TERMS, title_terms=MACRO_TITLE_TERMS) -> DataFrame:
    text = F.lower(F.concat_ws(" ", "title", "content"))
    return docs.filter(article_like(F.col("title")) & contains_any(text, country) & contains_any(text, macro)
                       & contains_any(F.lower("title"), title_terms))


def company_priority(title: Column, events=EVENT_TERMS, publicity=PUBLICITY_TERMS) -> Column:
    t = F.lower(title)
    return 2 * count_terms(t, events) - 2 * count_terms(t, publicity)


def trusted_domain(url: Column, domains: list[str]) -> Column:
    host = F.lower(F.regexp_extract(url, r"^https://([^/:?#]+)", 1))
    hit = F.lit(False)
    for d in domains:
        hit = hit | (host == d) | host.endswith("." + d)
    return (host != "") & hit


def _url_not_in(used: Column):
    return lambda x: ~F.array_contains(used, x["url"])


def pick_sources(candidates: DataFrame, key: str, categories: list[str]) -> DataFrame:
    """Best document per category and key, no URL twice.

    An earlier category can block at most one URL of a later one, so the best
    k distinct URLs of the k-th category are enough for an exact choice.
    """
    w = Window.partitionBy(key, "category", "url").orderBy(F.col("priority").desc(), F.col("doc_id").asc())
    rows = candidates.withColumn("_r", F.row_number().over(w)).filter("_r = 1")
    w = Window.partitionBy(key, "category").orderBy(F.col("priority").desc(), F.col("doc_id").asc())
    rows = rows.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= len(categories))
    lists = rows.groupBy(key).agg(*[F.array_sort(F.collect_list(F.when(F.col("category") == c, F.struct("_r", "doc_id", "url")))).alias(c)
                                    for c in categories])
    used, out = F.array().cast("array<string>"), lists
    for c in categories:
        free = F.filter(c, _url_not_in(used))
        out = out.withColumn(f"_{c}", F.get(free, F.lit(0)))
        used = F.array_compact(F.array(*[F.col(f"_{d}.url") for d in categories[:categories.index(c) + 1]]))
    picked = F.array(*[F.struct(F.lit(c).alias("category"), F.col(f"_{c}.doc_id").alias("doc_id"), F.col(f"_{c}.url").alias("url")) for c in categories])
    return out.select(key, F.explode(F.filter(picked, lambda p: p["doc_id"].isNotNull())).alias("p")).select(key, "p.*")


def cited_ids(answers: DataFrame, text: str) -> DataFrame:
    """Distinct [n] references of each answer."""
    found = F.regexp_extract_all(F.col(text), F.lit(r"\[(\d+)\]"), F.lit(1))
    keys = [c for c in answers.columns if c != text]
    return answers.select(*keys, F.explode(F.array_distinct(found)).alias("n")).select(*keys, F.col("n").try_cast("long").alias("cited"))


def strip_markup(text: Column) -> Column:
    plain = F.regexp_replace(F.translate(text, "*`", ""), r"(?m)^\s{0,3}#{1,6}\s*", "")
    return F.regexp_replace(plain, r"^\s+|\s+$", "")
