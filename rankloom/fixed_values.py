"""Fixed values.

Everything in this file is data that results must agree on (word lists, lookup tables, patterns,
label texts, published click rates). The logic that uses them lives elsewhere.
"""

# --- fixed values: English stopwords used by phrase keys, n-grams and content words -----------
STOPWORDS = """
a about above after again against all am an and any are as at be because been before being
below between both but by can could did do does doing down during each few for from further
had has have having he her here hers herself him himself his how i if in into is it its itself
just me more most my myself no nor not now of off on once only or other our ours ourselves out
over own same she should so some such than that the their theirs them themselves then there
these they this those through to too under until up very was we were what when where which
while who whom why will with would you your yours yourself yourselves also get got us one
many much may might must need via per etc every within without across
""".split()

# --- fixed values: text patterns ---------------------------------------------------------------
WORD_PATTERN = r"[a-z0-9][a-z0-9'+&.-]*[a-z0-9+]|[a-z0-9]"
SENTENCE_BREAK = r"[.!?\n;:()\[\]|]+"
NOT_PHRASE_CHAR = r"[^\w\s'&+.-]"
NAVIGATIONAL = (
    r"\b(log ?in|sign ?in|sign ?up|download|phone number|customer service|near me)\b"
)
QUESTION = r"^(what|how|why|which|when|who|is|are|can|does|do|should)\b|\bvs\b"
TITLE_YEAR = r"\b(20[0-3]\d)\b"
PLACEHOLDER = r"\[ADD:[^\]]*\]"

# --- fixed values: page types, tried in this order ---------------------------------------------
PAGE_TYPES = [
    "listicle", "guide", "product", "category", "comparison", "tool", "forum", "video", "news",
    "pdf", "login", "unknown",
]
LOGIN_PATH = r"/(login|signin|sign-in|signup|sign-up|register|auth)\b"
FORUM_PATH = r"/(forum|forums|community|discussions?|threads?)/|/t/"
COMPARISON_TEXT = r"\bvs\.?\b|-vs-|/vs/|\balternatives?\b|\bcompar"
LISTICLE_TEXT = r"\b(best|top)[- ]\d*|\b\d+[- ](best|top|ways|tools|apps|tips|examples)\b"
TOOL_TEXT = r"calculator|generator|checker|converter|\btemplate\b|free[- ]tool"
GUIDE_TEXT = r"how[- ]to|\bguide\b|what[- ]is|tutorial|\bexplained\b"
CATEGORY_PATH = r"/(category|categories|directory|collections?|tag)/"
PRODUCT_PATH = r"^/?$|^/(pricing|product|products|features|solutions|platform)\b"
VIDEO_HOSTS = ["youtube.com", "youtu.be", "vimeo.com", "tiktok.com"]
FORUM_HOSTS = ["reddit.com", "quora.com", "stackexchange.com", "stackoverflow.com"]
NEWS_HOSTS = ["techcrunch.com", "theverge.com", "reuters.com", "bbc.co.uk", "cnn.com"]
SCHEMA_PAGE_TYPE = {
    "product": "product",
    "softwareapplication": "product",
    "service": "product",
    "howto": "guide",
    "article": "guide",
    "blogposting": "guide",
    "techarticle": "guide",
    "newsarticle": "news",
    "itemlist": "listicle",
    "videoobject": "video",
    "qapage": "forum",
    "discussionforumposting": "forum",
    "collectionpage": "category",
    "webapplication": "tool",
}
IGNORED_SCHEMA = [
    "WebSite", "Organization", "BreadcrumbList", "WebPage", "SiteNavigationElement",
]
INTENT_OF_TYPE = {
    "product": "commercial",
    "comparison": "commercial",
    "listicle": "commercial",
    "category": "commercial",
    "tool": "transactional",
    "guide": "informational",
    "news": "informational",
    "forum": "informational",
    "video": "informational",
}
UGC_TYPES = ["forum", "video"]
NO_INTENT_TYPES = ["unknown", "pdf", "login"]
WRONG_FORMAT_TYPES = ["forum", "video", "pdf", "login"]

# --- fixed values: domain lists ----------------------------------------------------------------
AUTHORITY_DOMAINS = [
    "wikipedia.org", "amazon.com", "youtube.com", "g2.com", "capterra.com", "trustpilot.com",
    "forbes.com", "nytimes.com", "linkedin.com", "facebook.com",
]
PLATFORM_DOMAINS = [
    "wikipedia.org", "youtube.com", "reddit.com", "quora.com", "linkedin.com", "facebook.com",
    "instagram.com", "x.com", "twitter.com", "pinterest.com", "medium.com", "github.com",
    "stackoverflow.com", "amazon.com", "forbes.com", "nytimes.com", "g2.com", "capterra.com",
    "trustpilot.com", "getapp.com", "softwareadvice.com", "clutch.co", "goodfirms.co",
    "upwork.com", "fiverr.com", "indeed.com", "glassdoor.com", "google.com", "microsoft.com",
    "apple.com", "ibm.com", "dev.to", "geeksforgeeks.org", "w3schools.com", "freecodecamp.org",
    "hashnode.com", "tutorialspoint.com", "javatpoint.com", "substack.com", "wordpress.com",
    "blogspot.com",
]
SECOND_LEVEL_LABELS = ["co", "com", "org", "net", "ac", "gov", "edu"]

# --- fixed values: sitemap rules ---------------------------------------------------------------
SKIP_SEGMENTS = [
    "tag", "tags", "author", "authors", "login", "log-in", "signin", "sign-in", "signup",
    "sign-up", "register", "logout", "account", "my-account", "cart", "checkout", "basket",
    "wishlist", "search", "terms", "legal", "gdpr", "disclaimer", "imprint", "impressum",
    "data-deletion", "feed", "rss", "amp", "attachment", "404", "forgot-password",
    "reset-password", "unsubscribe", "category", "categories",
]
LISTING_SECTIONS = [
    "blog", "blogs", "articles", "news", "insights", "resources", "posts", "stories",
    "success-stories", "case-studies", "press", "events", "library", "knowledge-base", "learn",
    "guides", "updates", "podcast", "podcasts", "webinars", "community",
]
SKIP_PREFIXES = ["privacy", "terms-", "cookie", "wp-"]
SKIP_CONTAINS = ["thank-you", "thankyou"]
SKIP_EXTENSIONS = [
    ".pdf", ".jpg", ".jpeg", ".png", ".gif", ".webp", ".svg", ".zip", ".mp4", ".mp3", ".doc",
    ".docx", ".xls", ".xlsx", ".ppt", ".pptx", ".xml", ".txt", ".json", ".css", ".js",
]
PAGINATION_PATH = r"/page/\d+(/|$)"
VERIFICATION_PATH = r"/(google[0-9a-f]{8,}\.html|yandex_[0-9a-f]+\.html|bingsiteauth\.xml)$"
LANGUAGE_SEGMENT = r"^[a-z]{2}(?:[-_][a-z]{2,4})?$"
SITEMAP_FIRST = r"page|product|service|solution|feature|landing|pricing"
SITEMAP_LAST = r"post|blog|news|article"
SITEMAP_SKIP = (
    r"(?<![a-z])(tags?|authors?|attachments?|images?|videos?|media|formats?|users)(?![a-z])"
)

# --- fixed values: page text extraction --------------------------------------------------------
DROPPED_TAGS = [
    "script", "style", "noscript", "svg", "template", "iframe", "nav", "footer", "form",
]
BLOCK_TAGS = [
    "h1", "h2", "h3", "h4", "h5", "h6", "p", "li", "blockquote", "dt", "dd", "figcaption", "td",
    "th", "summary",
]
BOILERPLATE_MARKS = ["cookie", "consent", "gdpr", "newsletter", "navbar", "menu", "breadcrumb"]

# --- fixed values: published click rates by position 1-20, and search shares by country ---------
CLICK_RATES = [
    0.2002, 0.1036, 0.0389, 0.0171, 0.0108, 0.0073, 0.0046, 0.0047, 0.0054, 0.0058,
    0.0067, 0.0070, 0.0082, 0.0088, 0.0080, 0.0067, 0.0064, 0.0055, 0.0052, 0.0027,
]
SEARCH_SHARES = {
    "US": (86.01, 8.99),
    "GB": (91.75, 5.66),
    "CA": (85.6, 9.61),
    "AU": (87.53, 9.45),
    "IN": (97.71, 1.26),
    "NP": (96.3, 2.74),
    "DE": (88.41, 5.88),
    "FR": (88.67, 5.17),
    "NZ": (88.31, 8.22),
    "IE": (93.97, 3.55),
    "SG": (92.57, 3.66),
}
# USD per million tokens: input on a cache miss, input on a cache hit, output
TOKEN_PRICES = {
    "deepseek-chat": (0.28, 0.028, 0.42),
    "deepseek-reasoner": (0.28, 0.028, 0.42),
}

# --- fixed values: Arial advance widths in thousandths of an em ---------------------------------
CHAR_WIDTHS = {
    " ": 278, "!": 278, '"': 355, "#": 556, "$": 556, "%": 889, "&": 667, "'": 191,
    "(": 333, ")": 333, "*": 389, "+": 584, ",": 278, "-": 333, ".": 278, "/": 278,
    "0": 556, "1": 556, "2": 556, "3": 556, "4": 556, "5": 556, "6": 556, "7": 556,
    "8": 556, "9": 556, ":": 278, ";": 278, "<": 584, "=": 584, ">": 584, "?": 556,
    "@": 1015, "A": 667, "B": 667, "C": 722, "D": 722, "E": 667, "F": 611, "G": 778,
    "H": 722, "I": 278, "J": 500, "K": 667, "L": 556, "M": 833, "N": 722, "O": 778,
    "P": 667, "Q": 778, "R": 722, "S": 667, "T": 611, "U": 722, "V": 667, "W": 944,
    "X": 667, "Y": 667, "Z": 611, "[": 278, "\\": 278, "]": 278, "^": 469, "_": 556,
    "`": 333, "a": 556, "b": 556, "c": 500, "d": 556, "e": 556, "f": 278, "g": 556,
    "h": 556, "i": 222, "j": 222, "k": 500, "l": 222, "m": 833, "n": 556, "o": 556,
    "p": 556, "q": 556, "r": 333, "s": 500, "t": 278, "u": 556, "v": 500, "w": 722,
    "x": 500, "y": 500, "z": 500, "{": 334, "|": 260, "}": 334, "~": 584,
    "–": 556, "—": 1000, "‘": 222, "’": 222, "“": 333, "”": 333, "…": 1000, "·": 278,
    "•": 350, "©": 737, "®": 737, "™": 1000,
}
DEFAULT_CHAR_WIDTH = 556
WIDE_CHAR_WIDTH = 1000
WIDE_CHAR_FROM = 0x2E80

# --- fixed values: gap categories, check keys, label texts --------------------------------------
CATEGORIES = ["shared", "missing", "weak", "strong", "untapped", "unique"]
CATEGORIES_TO_ADD = ["missing", "weak", "untapped"]
CHECK_KEYS = [
    "https", "http_redirect", "one_address", "permanent_redirects", "robots", "sitemap",
    "indexable", "title", "description", "canonical",
]
CHECK_STATUSES = ["pass", "warn", "fail", "unknown"]
ROBOTS_VALUE_RULES = [
    "max-snippet", "max-image-preview", "max-video-preview", "unavailable_after",
]
SERP_FEATURE_KEYS = {
    "answerBox": "featured_snippet",
    "knowledgeGraph": "knowledge_graph",
    "peopleAlsoAsk": "people_also_ask",
    "relatedSearches": "related_searches",
    "topStories": "top_stories",
    "videos": "video",
    "images": "images",
    "places": "local_pack",
    "shopping": "shopping",
}
QUESTION_SOURCES = ["People Also Ask", "Google autocomplete"]
FIT_TEXT = {3: "Exact fit", 2: "Good fit", 1: "Loose fit", 0: "No fit"}
INTENT_TEXT = {
    "commercial": "Comparing options",
    "transactional": "Ready to sign up or buy",
    "informational": "Want to learn",
    "navigational": "Looking for a specific site",
}
VITALS_METRICS = [
    "largest_contentful_paint", "interaction_to_next_paint", "cumulative_layout_shift",
]
GROUNDING_REDIRECT_HOST = "vertexaisearch.cloud.google.com"
KEYWORD_CSV_TAIL = ["traffic_lift", "difficulty", "difficulty_band", "intent", "cluster",
                    "serp_features"]
SNAPSHOT_CSV_HEADER = [
    "keyword", "position", "url", "bing_searches_per_month", "bing_status",
    "google_searches_estimate", "visits_estimate", "difficulty", "difficulty_band", "intent",
    "serp_features",
]
FORMULA_START = r"^[=+\-@\t\r]"
