"""Results depend on these being exactly as written."""

# Topics of the feed and of the ranking, and the words that describe them.
TOPICS = ["sports", "lifestyle", "music", "finance"]
TOPIC_KEYWORDS = {
    "sports": ["athlete", "tournament", "score", "breaking news"],
    "lifestyle": ["wellness", "fashion", "routine", "breaking news"],
    "music": ["concert", "album", "artist", "breaking news"],
    "finance": ["investment", "market", "economy", "breaking news"],
}
QUERY_PREFIX = "Australian"
FEED_LANGUAGE = "en"
FEED_WINDOW_DAYS = 14
MAX_PAGES = 1
PAGE_SIZE = 100

# De-duplication, ranking and export.
NEIGHBOURS = 4
SIMILARITY_PERCENT = 90
RRF_CONSTANT = 60
UI_RANK_CUT = 15
HIGHLIGHTS_PER_TOPIC = 5
NEW_WITHIN_SECONDS = 86400

# Model calls, chunks and retrieval.
MAX_CONCURRENCY = 30
CHUNK_SIZE = 512
CHUNK_OVERLAP = 50
TOP_K = 7
GENERAL_CATEGORY = "general"
UNKNOWN_SOURCE = "Unknown Source"

# A question that is only a topic word stands for a full question.
CANNED_QUESTIONS = {
    "sports": "What are the latest sports news and events in Australia?",
    "music": "What are the recent developments in Australian music scene?",
    "finance": "What are the current financial trends and news in Australia?",
    "lifestyle": "What are the latest lifestyle trends and news in Australia?",
}

# Layout of the highlights page.
HIGHLIGHTS_TITLE = "# 📰 News Hub\n\n"
RULE = "---\n\n"
NEW_MARK = " 🆕"
SENTIMENT_MARKS = {"positive": "😀", "negative": "😟"}
OTHER_SENTIMENT_MARK = "😐"

# Layout of the user prompt.
PROMPT_TEMPLATE = "\n**User Question:** %s\n\n**Context (Articles):**\n%s\n"
