"""Word lists, tickers, thresholds and enum members."""

# Fixed values, results depend on them as they stand.
POSITIVE_WORDS = [
    "growth", "profit", "increase", "gain", "success", "positive",
    "bullish", "buy", "upgrade", "strong", "beat", "exceed",
]
NEGATIVE_WORDS = [
    "loss", "decline", "decrease", "fall", "negative", "bearish",
    "sell", "downgrade", "weak", "miss", "below", "concern",
]
MARKET_KEYWORDS = [
    "earnings", "profit", "revenue", "loss", "merger", "acquisition",
    "ipo", "dividend", "buyback", "partnership", "contract", "lawsuit",
    "fda", "approval", "recall", "bankruptcy", "restructuring", "ceo",
    "guidance", "forecast", "upgrade", "downgrade", "bullish", "bearish",
]
KNOWN_SYMBOLS = [
    "AAPL", "GOOGL", "MSFT", "TSLA", "AMZN", "META", "NVDA",
    "JPM", "V", "WMT", "DIS", "NFLX", "AMD", "INTC", "CSCO",
]
USER_STATUSES = ["ACTIVE", "INACTIVE", "SUSPENDED", "PENDING_VERIFICATION"]
USER_ROLES = ["USER", "ADMIN", "PREMIUM_USER"]
NOTIFICATION_TYPES = ["EMAIL", "SMS", "PUSH", "IN_APP"]
NOTIFICATION_STATUSES = ["PENDING", "SENT", "FAILED", "CANCELLED", "SCHEDULED"]
ALERT_TYPES = ["PRICE_ABOVE", "PRICE_BELOW", "VOLUME_SPIKE", "NEWS_SENTIMENT", "TECHNICAL_INDICATOR"]
SIGNAL_TYPES = ["BUY", "SELL", "HOLD"]
INDEX_SYMBOLS = ["SPY"]

PRICE_MOVE_PERCENT = 5.0
VOLUME_FACTOR = 3
SIGNAL_SCORE = 0.3
ALERT_SCORE = 0.5
BREAKING_START_SCORE = 0.7
BREAKING_FOLLOW_SCORE = 0.5
BREAKING_WITHIN_SECONDS = 30 * 60
SUMMARY_CHARS = 200
