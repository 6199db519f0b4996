"""Word lists, lookup tables and constants of the directory domain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Results depend on each of them and on their order.

NEWS_DOMAINS = [
    "weforum.org", "cnn.com", "bbc.com", "bbc.co.uk", "reuters.com", "bloomberg.com", "ft.com", "wsj.com", "nytimes.com",
    "theguardian.com", "washingtonpost.com", "forbes.com", "businessinsider.com", "techcrunch.com", "wired.com", "zdnet.com",
    "theregister.com", "arstechnica.com", "securityweek.com", "darkreading.com", "threatpost.com", "bleepingcomputer.com",
    "cyberscoop.com", "helpnetsecurity.com", "infosecurity-magazine.com", "govinfosecurity.com", "bankinfosecurity.com",
    "healthcareinfosecurity.com", "medium.com", "substack.com", "wordpress.com", "blogger.com", "wikipedia.org", "wikimedia.org",
    "reddit.com", "quora.com", "twitter.com", "x.com", "facebook.com", "instagram.com", "youtube.com", "linkedin.com", "flickr.com",
    "pinterest.com", "amazon.com", "ebay.com", "aliexpress.com", "etsy.com", "google.com", "bing.com", "yahoo.com", "duckduckgo.com",
    "github.com", "gitlab.com", "stackoverflow.com", "npmjs.com", "apple.com", "microsoft.com", "docs.microsoft.com", "qualtrics.com",
    "typeform.com", "surveymonkey.com", "share.flipboard.com",
]
STRONG_KEYWORDS = [
    "exhibitor", "exhibitors", "vendor", "vendors", "sponsor", "sponsors", "participant", "participants", "booth", "booths", "stand",
    "stands", "floor-plan", "floorplan", "floor_plan", "hall-map", "hallmap", "companies", "company-list", "brand-list", "brands",
    "solution-provider", "solution_provider", "tech-provider", "member-directory", "members-directory", "directory",
]
MEDIUM_KEYWORDS = [
    "partner", "partners", "showcase", "profiles", "listing", "attendee", "attendees", "delegate", "delegates", "pavilion", "hall",
    "zone", "sector", "segment", "portfolio", "lineup", "featured-companies",
]
IGNORED_PATHS = [
    r"^/cdn-cgi/", r"^/wp-admin/", r"^/wp-login", r"/login", r"/register", r"/signup", r"/cart", r"/checkout", r"/privacy", r"/terms",
    r"/cookie", r"/sitemap", r"\.(pdf|doc|docx|xls|xlsx|ppt|pptx|zip|rar|exe|dmg)$",
    r"\.(jpg|jpeg|png|gif|svg|ico|webp|mp4|mp3|avi)$", r"\.(css|js|json|xml|txt|csv)$",
]
IGNORED_SCHEMES = ["javascript:", "mailto:", "tel:", "fax:"]
VENDOR_PATH_KEYWORDS = [
    "exhibitor", "vendor", "company", "booth", "brand", "participant", "sponsor", "supplier", "partner", "profile", "member",
    "katilimci", "firma", "expositor", "empresa", "exposant", "aussteller", "unternehmen", "detail", "listing", "directory",
]
NAV_PATH_KEYWORDS = [
    "login", "register", "signup", "sign-up", "contact", "about", "faq", "privacy", "terms", "cookie", "sitemap", "search", "tag",
    "category", "news", "blog", "press", "media", "career", "jobs", "help", "appointment", "book", "apply", "register-booth",
    "event-pass", "ticket", "pass", "credential", "accreditation", "verification", "booking", "reserve", "attend", "signup-event",
    "registration", "organizationchart", "organisation", "joinus", "join-us", "culture", "abroad", "introduction", "history",
    "leadership", "management", "investor", "shareholder", "governance", "sustainability", "csr", "download", "gallery", "photo",
    "video", "map", "floor-plan", "agenda", "schedule", "session", "speaker", "keynote", "workshop", "hotel", "venue", "travel",
    "transport", "parking", "accommodation",
]
PAGE_PARAMS = ["page", "p", "pagenumber", "pagenum", "pg", "paged", "currentpage"]
SEED_KEYWORDS_3 = ["exhibitor", "vendor", "sponsor", "booth", "directory", "participant"]
SEED_KEYWORDS_2 = ["expo", "exhibition", "conference", "tradeshow", "summit"]
SEED_TOPICS = [
    "cyber", "cybersecurity", "infosec", "information security", "defense", "defence", "military", "nato", "security", "intelligence",
    "surveillance", "disa", "darpa", "homeland", "critical infrastructure", "threat", "soc", "pentest", "red team", "blue team", "ciso",
]
EVENT_DOMAINS = [
    "10times.com", "expodatabase.com", "eventbrite.com", "meetup.com", "tradeshow.com", "exhibitorsonline.com", "tsnn.com",
    "tradeshowtalk.com", "expodirectory.com", "biztradeshows.com", "allconferences.com", "confguide.com", "informa.com",
    "reedexhibitions.com", "ubmasia.com", "spargo.com", "a2zinc.net", "eventinterface.com", "swapcard.com", "stova.io",
    "eventsair.com", "cvent.com", "globex360.com", "afcea.org", "isaca.org", "sans.org", "gartner.com", "idcevents.com",
    "rsaconference.com", "blackhat.com", "defcon.org", "cyberuk.uk",
]
SEARCH_TEMPLATES = [
    "{query} exhibitors list", "{query} vendors directory", "{query} expo participants 2025 2026", "{query} conference exhibitors",
    "{query} tradeshow companies list", "{query} summit sponsors vendors", "site:10times.com {query}", "site:expodatabase.com {query}",
    "{query} floor plan exhibitors", "{query} expo hall vendors directory", "{query} event exhibitor list",
    "{query} technology providers directory",
]
#: label, engine, keywords
REGIONS = [
    ("China", "baidu", ["china", "cina", "tiongkok", "beijing", "shanghai", "shenzhen", "guangzhou"]),
    ("Japan", "yahoo", ["jepang", "japan", "tokyo", "osaka", "kyoto", "nagoya", "fukuoka"]),
    ("Korea", "naver", ["korea", "korean", "seoul", "busan", "incheon", "daegu", "daejeon"]),
    ("USA", "google", ["usa", "us ", " us,", "america", "united states", "amerika", "new york", "washington", "los angeles", "san francisco", "chicago"]),
    ("Europe", "google", ["eropa", "europe", "european", "eu ", "german", "jerman", "prancis", "france", "inggris", "uk ", "belanda", "netherlands", "italy", "italia", "spain", "spanyol", "sweden", "swedia", "poland", "polandia", "brussels"]),
    ("Greece", "google", ["greece", "greek", "yunani", "athens", "athena", "hellenic"]),
    ("Russia", "yandex", ["russia", "rusia", "russian", "moskow", "moscow", "st. petersburg"]),
    ("India", "google", ["india", "mumbai", "new delhi", "delhi", "bangalore", "bengaluru", "hyderabad"]),
    ("Pakistan", "google", ["pakistan", "karachi", "islamabad", "lahore", "pakistani"]),
    ("Southeast Asia", "google", ["singapura", "singapore", "asia tenggara", "southeast asia", "asean", "malaysia", "thailand", "filipina", "philippines", "vietnam"]),
    ("Oceania", "google", ["oceania", "australia", "new zealand", "auckland", "sydney", "melbourne", "pacific", "pasifik", "papua"]),
    ("Middle East", "google", ["arab", "arabic", "saudi", "dubai", "uae", "timur tengah", "middle east", "qatar", "kuwait", "bahrain", "oman", "abu dhabi"]),
    ("Asia", "google", ["asia ", " asia", ",asia", "asian"]),
]
GLOBAL_REGION = ("Global", "google")
GLOBAL_KEYWORDS = ["global", "worldwide", "world", "seluruh dunia", "all regions", "covers over", "international", "internasional"]
IGNORED_DOMAINS = ["google.com", "facebook.com", "twitter.com", "linkedin.com", "youtube.com", "instagram.com", "wikipedia.org", "amazon.com", "microsoft.com", "apple.com", "github.com"]
IGNORED_EXTENSIONS = [
    "pdf", "doc", "docx", "xls", "xlsx", "ppt", "pptx", "zip", "rar", "tar", "gz", "exe", "dmg", "pkg", "jpg", "jpeg", "png", "gif", "svg",
    "ico", "webp", "mp4", "mp3", "avi", "mov", "wmv", "flv", "css", "js", "json", "xml", "txt", "csv",
]
JUNK_PAGES = [
    "make an appointment", "click here to apply", "register for event", "book a meeting", "apply to exhibit", "apply booth pass",
    "sign up for", "register now", "schedule visit", "request demo", "download brochure", "fill out form", "complete registration",
    "reserve your spot",
]
RENDER_MARKS = [
    'id="__next"', "data-reactroot", "/_next/static/", 'id="root">', 'id="app">', "react-app", "ng-version", "vue-app", "__nuxt",
    "please enable javascript", "javascript is required", "cloudflare", "checking your browser", "<noscript>",
]
API_NAME_KEYS = ["name", "companyName", "company_name", "title", "displayName", "exhibitorName", "vendorName", "organizationName"]
API_FIELDS = ["name", "website", "url", "email", "phone", "country", "city", "category", "description", "booth", "stand", "linkedin", "twitter", "logo", "industry"]
SAMPLE_WORDS = ["exhibitor", "vendor", "company", "participant", "booth", "sponsor", "listing"]
COUNTRIES = {
    "united states": "United States", "usa": "United States", "u.s.a": "United States", "u.s.a.": "United States", "us": "United States",
    "canada": "Canada", "mexico": "Mexico", "brazil": "Brazil", "brasil": "Brazil", "argentina": "Argentina", "colombia": "Colombia",
    "chile": "Chile", "peru": "Peru", "venezuela": "Venezuela", "ecuador": "Ecuador", "uruguay": "Uruguay", "paraguay": "Paraguay",
    "bolivia": "Bolivia", "united kingdom": "United Kingdom", "uk": "United Kingdom", "great britain": "United Kingdom",
    "england": "United Kingdom", "germany": "Germany", "deutschland": "Germany", "france": "France", "spain": "Spain", "italy": "Italy",
    "netherlands": "Netherlands", "holland": "Netherlands", "belgium": "Belgium", "switzerland": "Switzerland", "austria": "Austria",
    "sweden": "Sweden", "norway": "Norway", "finland": "Finland", "denmark": "Denmark", "ireland": "Ireland", "portugal": "Portugal",
    "luxembourg": "Luxembourg", "iceland": "Iceland", "liechtenstein": "Liechtenstein", "monaco": "Monaco", "andorra": "Andorra",
    "malta": "Malta", "cyprus": "Cyprus", "poland": "Poland", "czech republic": "Czech Republic", "czech": "Czech Republic",
    "czechia": "Czech Republic", "slovakia": "Slovakia", "hungary": "Hungary", "romania": "Romania", "bulgaria": "Bulgaria",
    "croatia": "Croatia", "slovenia": "Slovenia", "serbia": "Serbia", "bosnia": "Bosnia and Herzegovina",
    "bosnia and herzegovina": "Bosnia and Herzegovina", "north macedonia": "North Macedonia", "albania": "Albania", "kosovo": "Kosovo",
    "montenegro": "Montenegro", "ukraine": "Ukraine", "belarus": "Belarus", "moldova": "Moldova", "russia": "Russia",
    "estonia": "Estonia", "latvia": "Latvia", "lithuania": "Lithuania", "israel": "Israel", "turkey": "Turkey", "türkiye": "Turkey",
    "united arab emirates": "UAE", "uae": "UAE", "saudi arabia": "Saudi Arabia", "qatar": "Qatar", "kuwait": "Kuwait",
    "bahrain": "Bahrain", "oman": "Oman", "jordan": "Jordan", "iraq": "Iraq", "iran": "Iran", "lebanon": "Lebanon", "syria": "Syria",
    "yemen": "Yemen", "palestine": "Palestine", "india": "India", "pakistan": "Pakistan", "bangladesh": "Bangladesh",
    "sri lanka": "Sri Lanka", "nepal": "Nepal", "bhutan": "Bhutan", "maldives": "Maldives", "afghanistan": "Afghanistan",
    "china": "China", "prc": "China", "japan": "Japan", "south korea": "South Korea", "korea": "South Korea",
    "north korea": "North Korea", "taiwan": "Taiwan", "hong kong": "Hong Kong", "macau": "Macau", "mongolia": "Mongolia",
    "singapore": "Singapore", "malaysia": "Malaysia", "indonesia": "Indonesia", "thailand": "Thailand", "philippines": "Philippines",
    "vietnam": "Vietnam", "myanmar": "Myanmar", "burma": "Myanmar", "cambodia": "Cambodia", "laos": "Laos", "brunei": "Brunei",
    "timor-leste": "Timor-Leste", "east timor": "Timor-Leste", "kazakhstan": "Kazakhstan", "uzbekistan": "Uzbekistan",
    "kyrgyzstan": "Kyrgyzstan", "tajikistan": "Tajikistan", "turkmenistan": "Turkmenistan", "azerbaijan": "Azerbaijan",
    "georgia": "Georgia", "armenia": "Armenia", "south africa": "South Africa", "egypt": "Egypt", "nigeria": "Nigeria",
    "kenya": "Kenya", "ethiopia": "Ethiopia", "ghana": "Ghana", "tanzania": "Tanzania", "uganda": "Uganda", "morocco": "Morocco",
    "algeria": "Algeria", "tunisia": "Tunisia", "libya": "Libya", "sudan": "Sudan", "cameroon": "Cameroon", "senegal": "Senegal",
    "zimbabwe": "Zimbabwe", "zambia": "Zambia", "australia": "Australia", "new zealand": "New Zealand",
    "papua new guinea": "Papua New Guinea", "fiji": "Fiji", "republic of korea": "South Korea", "rok": "South Korea",
    "people's republic of china": "China", "russian federation": "Russia",
}
LABELS = {
    "organizer": "organizer", "organiser": "organizer", "organized by": "organizer", "organizing unit": "organizer",
    "host organization": "organizer", "co-organizer": "organizer", "organizers": "organizer", "主办单位": "organizer", "主办方": "organizer",
    "主办": "organizer", "协办单位": "organizer", "host city": "city", "venue city": "city", "city": "city", "host region": "city",
    "host area": "city", "event city": "city", "host location": "city", "location": "city", "举办地区": "city", "举办地": "city",
    "举办城市": "city", "城市": "city", "country": "country", "nation": "country", "host country": "country", "举办国家": "country",
    "国家": "country", "address": "address", "venue address": "address", "hall address": "address", "exhibition hall address": "address",
    "展馆地址": "address", "地址": "address", "industry": "category", "sector": "category", "category": "category", "type": "category",
    "fair type": "category", "domain": "category", "所属行业": "category", "行业": "category", "类型": "category",
    "exhibition hall": "event_location", "venue": "event_location", "hall": "booth_number", "exhibition venue": "event_location",
    "event venue": "event_location", "举办展馆": "event_location", "展馆": "event_location", "展览馆": "event_location",
    "举办地点": "event_location", "date": "event_date", "period": "event_date", "exhibition date": "event_date",
    "event date": "event_date", "fair date": "event_date", "exhibition time": "event_date", "show time": "event_date",
    "event time": "event_date", "展会时间": "event_date", "展览时间": "event_date", "时间": "event_date", "scale": "scale", "area": "scale",
    "exhibition area": "scale", "floor area": "scale", "gross area": "scale", "展览面积": "scale", "面积": "scale", "展区面积": "scale",
    "exhibitors": "exhibitor_count", "number of exhibitors": "exhibitor_count", "参展商": "exhibitor_count",
    "参展商数量": "exhibitor_count", "展商数量": "exhibitor_count", "visitors": "visitor_count", "attendance": "visitor_count",
    "number of visitors": "visitor_count", "visitor count": "visitor_count", "观众人数": "visitor_count", "观众数量": "visitor_count",
    "观众": "visitor_count", "website": "website", "web": "website", "official site": "website", "official website": "website",
    "展会网站": "website", "官网": "website", "网站": "website", "phone": "phone", "telephone": "phone", "tel": "phone", "电话": "phone",
    "联系电话": "phone", "email": "email", "e-mail": "email", "邮箱": "email", "电子邮件": "email", "booth": "booth_number",
    "booth number": "booth_number", "booth no": "booth_number", "stand": "booth_number", "stand number": "booth_number",
    "stand no": "booth_number", "stand no.": "booth_number", "pavilion": "booth_number", "展位": "booth_number", "展位号": "booth_number",
    "摊位": "booth_number",
}
CORE_FIELDS = ["name", "website", "email", "phone", "address", "city", "country", "description", "category"]
MERGE_FIELDS = ["name", "website", "email", "phone", "address", "city", "country", "category", "description", "linkedin", "twitter", "booth_number", "event_name", "event_location", "event_date"]
METHOD_PRIORITY = {"schema_org": 3, "rule_based": 2, "llm": 1, "enrichment": 1, "unknown": 0}
EXPORT_FIELDS = [
    ("name", "Company Name"), ("website", "Website"), ("email", "Email"), ("phone", "Phone"), ("address", "Address"), ("city", "City"),
    ("country", "Country"), ("category", "Category"), ("description", "Description"), ("linkedin", "LinkedIn"),
    ("twitter", "Twitter / X"), ("booth_number", "Booth / Stand"), ("event_name", "Event Name"), ("event_location", "Event Location"),
    ("event_date", "Event Date"), ("source_url", "Source URL"), ("extraction_method", "Extract Method"), ("confidence_score", "Confidence"),
]
JUNK_DESCRIPTIONS = [
    "make an appointment", "book an appointment", "book a meeting", "book a demo", "request a demo", "apply to exhibit",
    "exhibit with us", "register to exhibit", "sign up to exhibit", "apply for a booth", "apply booth", "register booth",
    "schedule a visit", "schedule a demo", "fill out the form", "complete your registration", "reserve your spot",
]
SOCIAL_DOMAINS = [
    "twitter.com", "x.com", "facebook.com", "flickr.com", "instagram.com", "youtube.com", "pinterest.com", "reddit.com", "tumblr.com",
    "t.co", "bit.ly", "tinyurl.com", "ow.ly", "buff.ly", "share.flipboard.com", "qualtrics.com", "typeform.com", "surveymonkey.com",
    "forms.gle", "docs.google.com",
]
WEBSITE_BLOCKLIST = [
    "twitter.com", "x.com", "facebook.com", "linkedin.com", "instagram.com", "youtube.com", "flickr.com", "pinterest.com", "reddit.com",
    "tumblr.com", "t.co", "bit.ly", "tinyurl.com", "ow.ly", "buff.ly", "hootsuite.com", "share.flipboard.com", "qualtrics.com",
    "typeform.com", "surveymonkey.com", "google.com", "apple.com", "microsoft.com", "amazon.com", "github.com", "wikipedia.org",
    "outlook.live.com", "outlook.com", "calendar.google.com", "calendar.yahoo.com", "calendly.com", "zoom.us", "teams.microsoft.com",
    "meet.google.com", "webex.com", "gotomeeting.com", "beian.gov.cn", "beian.miit.gov.cn", "mps.gov.cn", "gongan.gov.cn", "icp.gov.cn",
]
SKIP_DOMAINS = ["linkedin.com", "facebook.com", "twitter.com", "wikipedia.org", "bloomberg.com", "reuters.com", "crunchbase.com", "dnb.com", "yellowpages.com", "yelp.com", "glassdoor.com", "indeed.com", "zoominfo.com", "dun.com", "manta.com"]
BLOCKLIST_SIGNALS = ["appointment", "book-", "booking", "apply", "register-booth", "event-pass", "ticket", "credential", "accreditation", "reserve", "signup-event"]
ENRICHABLE = ["website", "email", "phone", "address", "city", "description", "linkedin", "twitter", "category", "company_size", "founded_year"]
EVENT_PAGE_KEYWORDS = ["exhibitor", "vendor", "sponsor", "booth", "tradeshow", "expo", "exhibition"]
CHINA_WORDS = [
    "china", "chinese", "prc", "beijing", "shanghai", "shenzhen", "guangzhou", "chengdu", "wuhan", "tianjin", "hangzhou", "nanjing",
    "qingdao", "xian", "xi'an", "chongqing", "dalian", "suzhou",
]
RUSSIA_WORDS = ["russia", "russian", "moscow", "moskow", "st. petersburg", "saint petersburg", "novosibirsk"]
#: engine, words in a company's country and name
ENGINE_WORDS = [
    ("baidu", ["china", "chinese", "prc", "beijing", "shanghai", "shenzhen", "guangzhou"]),
    ("yandex", ["russia", "russian", "moscow", "moskow"]),
    ("yahoo", ["japan", "japanese", "tokyo", "osaka", "kyoto", "nagoya"]),
    ("naver", ["korea", "korean", "seoul", "busan", "incheon"]),
]
TWITTER_PAGES = ["intent", "share", "home", "search", "hashtag", "i/", "settings", "notifications", "messages", "explore", "login", "signup", "about"]
TRADE_WORDS = ["expo", "exhibition", "show", "fair", "conference", "summit", "congress", "forum"]
LEGAL_SUFFIXES = ["inc", "llc", "ltd", "corp", "corporation", "company", "co", "gmbh", "ag", "bv", "sa", "spa", "plc", "pty", "nv"]
#: Public suffixes of two labels that the registered domain keeps whole.
TWO_LABEL_SUFFIXES = ["co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.nz", "co.jp", "or.jp", "ne.jp", "com.cn", "net.cn", "org.cn", "gov.cn", "com.br", "com.tr", "com.mx", "co.in", "co.kr", "or.kr", "com.sg", "com.my", "co.id", "com.hk", "com.tw", "co.za", "com.ar", "com.sa", "com.pk", "com.ua", "com.vn", "co.th", "co.il"]
EMAIL = r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}"
PHONE = r"(?:(?:\+|00)[1-9]\d{0,3}[\s\-\.]?)?(?:\(?\d{1,4}\)?[\s\-\.]?)?\d{3,4}[\s\-\.]?\d{3,4}(?:[\s\-\.]?\d{3,4})?"
BAD_NAME_WORDS = (
    r"partner articles?|read more|click here|learn more|see more|view all|show more|load more|next|prev(ious)?|page \d+|\d+ of \d+|"
    r"home|about|contact|news|blog|events?|resources?|solutions?|products?|services?|support|faq|sitemap|privacy|terms|cookies?|"
    r"sign in|log in|register|subscribe|newsletter|follow us|share|twitter|facebook|linkedin|instagram|youtube|flickr|"
    r"menu|navigation|header|footer|sidebar|search|copyright|all rights reserved|\d{4}|"
    r"exhibitors?(\s+(list|directory|search|results?|profile|information|details?))?|"
    r"vendors?(\s+(list|directory|search|results?|profile|information))?|"
    r"companies|company\s+(list|directory|profile|information|details?|overview|introduction)?|"
    r"profile|company\s*profile|exhibitor\s*profile|vendor\s*profile|company\s*(info(rmation)?|details?|overview|introduction)|"
    r"exhibitor\s*(info(rmation)?|details?|overview)|vendor\s*(info(rmation)?|details?)|"
    r"about\s+(the\s+)?company|about\s+(the\s+)?exhibitor|enterprise\s*(profile|info(rmation)?|introduction)|"
    r"participants?(\s+list)?|sponsors?(\s+list)?|our\s+(exhibitors?|vendors?|sponsors?|partners?)|"
    r"all\s+(exhibitors?|companies|vendors?)|quick\s+links?|exhibitor\s+list|vendor\s+list|company\s+list|"
    r"overseas\s+(exhibition|expo|fair|show|event|engineering)|domestic\s+(exhibition|expo|fair|show)|"
    r"(exhibition|booth|stand)\s+(construction|engineering|setup|service)|(organizational?|organisation(al)?)\s+(structure|chart)|"
    r"corporate\s+(culture|values?|history|mission|vision)|company\s+culture|(join|recruit)\s+us|careers?|recruitment|"
    r"news\s+(center|centre)|company\s+news|latest\s+news|more\s+(details?|info(rmation)?)|see\s+all|"
    r"(aviation|aerospace|defense|automotive|maritime|marine|security|fire\s*fighting|surveillance).*(series|sector|type|category|zone)|"
    r"公司介绍|企业介绍|关于我们|联系我们|加入我们|组织结构|企业文化|境外展|自办展|国内展示工程|海外搭建工程|展会新闻|新闻中心|展会动态|"
    r"更多|查看更多|了解更多|返回首页|网站地图|航空.*防务|汽车.*汽配|船舶.*海事|安防.*消防|"
    r".*召开.*会议|.*举行.*会议|.*举办.*活动|.*签署.*协议|.*开展.*合作|.*发布.*报告|.*举行.*仪式|.*完成.*工作|.*取得.*成果|.*实现.*目标"
)
SECTION_HEADINGS = r"about|overview|contact|news|home|services?|products?|solutions?|resources?|support|faq|privacy|terms|menu|search|quick\s+links?|our\s+\w+|all\s+\w+"
HEADING_PREFIXES = r"about|overview|profile|description|summary|introduction|info|information|history|vision|mission|company|who we are"
EVENT_WORDS = r"exhibition|expo|fair|congress|summit|conference|symposium|forum|trade\s+show"
NEXT_DATA_KEYS = ["name", "title", "website", "country", "stand", "description", "logo", "slug", "id", "category"]
PAGE_MINIMA = {"api": 50, "pdf": 100, "reader": 150, "listing": 200}
# End of fixed values.


def country_table(spark: SparkSession) -> DataFrame:
    """(ord, alias, country): fixed size, small enough to broadcast."""
    return spark.createDataFrame([(k, a, c) for k, (a, c) in enumerate(COUNTRIES.items())], "ord int, alias string, country string")


def region_table(spark: SparkSession) -> DataFrame:
    """(ord, label, engine, keyword)."""
    return spark.createDataFrame([(k, label, engine, w) for k, (label, engine, words) in enumerate(REGIONS) for w in words], "ord int, label string, engine string, keyword string")


def map_of(pairs: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])


def suffix_match(host: Column, suffixes: list[str]) -> Column:
    """host equals one of the suffixes or is a subdomain of it."""
    return host.rlike(rf"(^|\.)({'|'.join(x.replace('.', chr(92) + '.') for x in suffixes)})$")
