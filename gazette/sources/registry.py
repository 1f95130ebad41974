"""The registry of sources and feeds, and the small ordered dimensions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Categories and regions in order, with the names and signs they are shown with.
CATEGORIES = [
    ("politics", "정치", "🏛️"), ("economy", "경제", "💰"), ("society", "사회", "👥"), ("life", "생활", "🌱"),
    ("culture", "문화", "🎭"), ("it", "IT", "💻"), ("science", "과학", "🔬"), ("world", "국제", "🌍"),
]
REGIONS = [("domestic", "국내", "🇰🇷"), ("overseas", "해외", "🌐")]

# Sources (id, name, language, region, entries read of a feed) with their feeds by category, in order.
FEEDS = [
    ("yonhap", "연합뉴스TV", "ko", "domestic", 15, [
        ("politics", "https://www.yonhapnewstv.co.kr/category/news/politics/feed/"),
        ("economy", "https://www.yonhapnewstv.co.kr/category/news/economy/feed/"),
        ("society", "https://www.yonhapnewstv.co.kr/category/news/society/feed/"),
        ("world", "https://www.yonhapnewstv.co.kr/category/news/international/feed/"),
    ]),
    ("googlenews", "구글 뉴스", "ko", "domestic", 15, [
        ("politics", "https://news.google.com/rss/topics/CAAqIQgKIhtDQkFTRGdvSUwyMHZNRFZ4ZERBU0FtdHZLQUFQAQ?hl=ko&gl=KR&ceid=KR:ko"),
        ("economy", "https://news.google.com/rss/topics/CAAqIggKIhxDQkFTRHdvSkwyMHZNR2RtY0hNekVnSnJieWdBUAE?hl=ko&gl=KR&ceid=KR:ko"),
        ("world", "https://news.google.com/rss/topics/CAAqJggKIiBDQkFTRWdvSUwyMHZNRGx1YlY4U0FtdHZHZ0pMVWlnQVAB?hl=ko&gl=KR&ceid=KR:ko"),
        ("it", "https://news.google.com/rss/topics/CAAqJggKIiBDQkFTRWdvSUwyMHZNRGRqTVhZU0FtdHZHZ0pMVWlnQVAB?hl=ko&gl=KR&ceid=KR:ko"),
    ]),
    ("bbc", "BBC News", "en", "overseas", 10, [
        ("world", "http://feeds.bbci.co.uk/news/world/rss.xml"),
        ("economy", "http://feeds.bbci.co.uk/news/business/rss.xml"),
        ("politics", "http://feeds.bbci.co.uk/news/politics/rss.xml"),
        ("it", "http://feeds.bbci.co.uk/news/technology/rss.xml"),
        ("science", "http://feeds.bbci.co.uk/news/science_and_environment/rss.xml"),
    ]),
    ("nyt", "New York Times", "en", "overseas", 10, [
        ("world", "https://rss.nytimes.com/services/xml/rss/nyt/World.xml"),
        ("economy", "https://rss.nytimes.com/services/xml/rss/nyt/Business.xml"),
        ("politics", "https://rss.nytimes.com/services/xml/rss/nyt/Politics.xml"),
        ("it", "https://rss.nytimes.com/services/xml/rss/nyt/Technology.xml"),
        ("science", "https://rss.nytimes.com/services/xml/rss/nyt/Science.xml"),
    ]),
    ("guardian", "The Guardian", "en", "overseas", 10, [
        ("world", "https://www.theguardian.com/world/rss"),
        ("economy", "https://www.theguardian.com/uk/business/rss"),
        ("politics", "https://www.theguardian.com/politics/rss"),
        ("it", "https://www.theguardian.com/uk/technology/rss"),
        ("science", "https://www.theguardian.com/science/rss"),
        ("culture", "https://www.theguardian.com/uk/culture/rss"),
        ("society", "https://www.theguardian.com/society/rss"),
        ("life", "https://www.theguardian.com/uk/lifeandstyle/rss"),
    ]),
    ("aljazeera", "Al Jazeera", "en", "overseas", 15, [
        ("world", "https://www.aljazeera.com/xml/rss/all.xml"),
    ]),
    ("hani", "한겨레", "ko", "domestic", 15, [
        ("politics", "https://www.hani.co.kr/rss/politics"),
        ("economy", "https://www.hani.co.kr/rss/economy"),
        ("society", "https://www.hani.co.kr/rss/society"),
        ("world", "https://www.hani.co.kr/rss/international"),
        ("culture", "https://www.hani.co.kr/rss/culture"),
        ("science", "https://www.hani.co.kr/rss/science"),
    ]),
    ("hankyung", "한국경제", "ko", "domestic", 15, [
        ("politics", "https://www.hankyung.com/feed/politics"),
        ("economy", "https://www.hankyung.com/feed/economy"),
        ("it", "https://www.hankyung.com/feed/it"),
    ]),
    ("yna", "연합뉴스", "ko", "domestic", 15, [
        ("politics", "https://www.yna.co.kr/rss/politics.xml"),
        ("economy", "https://www.yna.co.kr/rss/economy.xml"),
        ("society", "https://www.yna.co.kr/rss/society.xml"),
        ("world", "https://www.yna.co.kr/rss/international.xml"),
        ("culture", "https://www.yna.co.kr/rss/culture.xml"),
        ("life", "https://www.yna.co.kr/rss/health.xml"),
    ]),
    ("khan", "경향신문", "ko", "domestic", 15, [
        ("politics", "https://www.khan.co.kr/rss/rssdata/politic_news.xml"),
        ("economy", "https://www.khan.co.kr/rss/rssdata/economy_news.xml"),
        ("society", "https://www.khan.co.kr/rss/rssdata/society_news.xml"),
        ("culture", "https://www.khan.co.kr/rss/rssdata/culture_news.xml"),
        ("it", "https://www.khan.co.kr/rss/rssdata/it_news.xml"),
        ("life", "https://www.khan.co.kr/rss/rssdata/life_news.xml"),
    ]),
    ("donga", "동아일보", "ko", "domestic", 15, [
        ("politics", "https://rss.donga.com/politics.xml"),
        ("economy", "https://rss.donga.com/economy.xml"),
        ("society", "https://rss.donga.com/national.xml"),
        ("world", "https://rss.donga.com/international.xml"),
        ("culture", "https://rss.donga.com/culture.xml"),
        ("science", "https://rss.donga.com/science.xml"),
        ("life", "https://rss.donga.com/lifeinfo.xml"),
    ]),
    ("donga_health", "동아일보", "ko", "domestic", 15, [
        ("life", "https://rss.donga.com/health.xml"),
    ]),
    ("wsj", "WSJ Markets", "en", "overseas", 10, [
        ("economy", "https://feeds.a.dj.com/rss/RSSMarketsMain.xml"),
    ]),
    ("cnn", "CNN", "en", "overseas", 10, [
        ("world", "http://rss.cnn.com/rss/edition_world.rss"),
    ]),
    ("khan_sci", "경향신문", "ko", "domestic", 15, [
        ("science", "https://www.khan.co.kr/rss/rssdata/kh_science.xml"),
    ]),
    ("asiae", "아시아경제", "ko", "domestic", 15, [
        ("economy", "https://www.asiae.co.kr/rss/stock.htm"),
    ]),
    ("einfomax", "연합인포맥스", "ko", "domestic", 15, [
        ("economy", "https://news.einfomax.co.kr/rss/allArticle.xml"),
    ]),
    ("etnews", "전자신문", "ko", "domestic", 15, [
        ("it", "https://rss.etnews.com/04.xml"),
    ]),
    ("etnews_sci", "전자신문", "ko", "domestic", 15, [
        ("science", "https://rss.etnews.com/20.xml"),
    ]),
    ("zdnetkr", "ZDNet Korea", "ko", "domestic", 15, [
        ("it", "https://feeds.feedburner.com/zdkorea"),
    ]),
    ("nocut", "노컷뉴스", "ko", "domestic", 15, [
        ("society", "https://rss.nocutnews.co.kr/nocutnews.xml"),
    ]),
    ("sbs", "SBS 뉴스", "ko", "domestic", 15, [
        ("society", "https://news.sbs.co.kr/news/SectionRssFeed.do?sectionId=03"),
    ]),
    ("ohmynews", "오마이뉴스", "ko", "domestic", 15, [
        ("society", "http://rss.ohmynews.com/rss/ohmynews.xml"),
    ]),
    ("pressian", "프레시안", "ko", "domestic", 15, [
        ("society", "https://www.pressian.com/api/v3/site/rss/news"),
    ]),
    ("ft", "Financial Times", "en", "overseas", 10, [
        ("economy", "https://www.ft.com/rss/home"),
    ]),
    ("nature", "Nature", "en", "overseas", 10, [
        ("science", "https://www.nature.com/nature.rss"),
    ]),
    ("sciencedaily", "ScienceDaily", "en", "overseas", 10, [
        ("science", "https://www.sciencedaily.com/rss/all.xml"),
    ]),
    ("wired", "WIRED", "en", "overseas", 10, [
        ("it", "https://www.wired.com/feed/rss"),
    ]),
    ("techcrunch", "TechCrunch", "en", "overseas", 10, [
        ("it", "https://techcrunch.com/feed/"),
    ]),
    ("arstechnica", "Ars Technica", "en", "overseas", 10, [
        ("it", "https://feeds.arstechnica.com/arstechnica/index"),
    ]),
]

# Watch-lists of stocks in order.
WATCHED = {
    "domestic": [
        ("005930", "삼성전자"), ("000660", "SK하이닉스"), ("035420", "NAVER"), ("035720", "카카오"), ("373220", "LG에너지솔루션"),
        ("005380", "현대차"), ("000270", "기아"), ("005490", "POSCO홀딩스"), ("207940", "삼성바이오로직스"), ("068270", "셀트리온"),
        ("105560", "KB금융"), ("055550", "신한지주"), ("006400", "삼성SDI"), ("051910", "LG화학"), ("096770", "SK이노베이션"),
        ("028260", "삼성물산"), ("066570", "LG전자"), ("323410", "카카오뱅크"), ("086790", "하나금융지주"), ("030200", "KT"),
    ],
    "overseas": [
        ("AAPL", "Apple"), ("MSFT", "Microsoft"), ("GOOGL", "Alphabet"), ("AMZN", "Amazon"), ("NVDA", "NVIDIA"),
        ("META", "Meta Platforms"), ("TSLA", "Tesla"), ("AVGO", "Broadcom"), ("JPM", "JPMorgan Chase"), ("V", "Visa"),
        ("JNJ", "Johnson & Johnson"), ("WMT", "Walmart"), ("PG", "Procter & Gamble"), ("UNH", "UnitedHealth"), ("HD", "Home Depot"),
        ("MA", "Mastercard"), ("XOM", "ExxonMobil"), ("CVX", "Chevron"), ("KO", "Coca-Cola"), ("PEP", "PepsiCo"),
    ],
}

SCHEMA = "source_seq int, feed_seq int, source_id string, source string, language string, region string, entry_limit int, category string, url string"


def feed_rows(sources: list[tuple] = FEEDS) -> list[tuple]:
    """One row for each feed, in order."""
    return [(i, k, *head, category, url) for i, (*head, own) in enumerate(sources) for k, (category, url) in enumerate(own)]


def feeds(spark: SparkSession, sources: list[tuple] = FEEDS) -> DataFrame:
    return spark.createDataFrame(feed_rows(sources), SCHEMA)


def categories(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, *c) for i, c in enumerate(CATEGORIES)], "category_seq int, category string, category_name string, icon string")


def regions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, *r) for i, r in enumerate(REGIONS)], "region_seq int, region string, region_name string, region_icon string")


def watched(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(m, i, s, n) for m, x in WATCHED.items() for i, (s, n) in enumerate(x)], "market string, seq int, symbol string, name string")
