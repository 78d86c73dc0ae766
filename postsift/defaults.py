"""Fixed values the results depend on. Every one is a default of a parameter."""

# Brands and rule words of the brand sentiment job.
BRANDS = ["kfc", "mcdonald's", "starbucks"]
POSITIVE_WORDS = ["love", "great", "awesome", "amazing", "good", "happy"]
NEGATIVE_WORDS = ["hate", "bad", "terrible", "awful", "horrible", "sad"]
SENTIMENTS = ["positive", "negative", "neutral"]

# Stop words on top of the English list.
EXTRA_STOP_WORDS = ["https", "news"]

# Labels and fallbacks written to the results.
COUNTRY = "United States"
PRO_LABEL = "pro-vacunas"
ANTI_LABEL = "anti-vacunas"
UNKNOWN_LOCATION = "desconocida"

# Sizes of the substring and topic jobs.
MIN_SUBSTRING = 5
TOP_SUBSTRINGS = 100
TOPICS = 20
TOPIC_WORDS = 10
CHUNK = 10_000
PASSES = 5
MIN_DOCS = 5
MAX_DOC_SHARE = 0.5
MAX_VOCABULARY = 100_000

#: How often the topics of a text are adjusted to its words.
FOLD_STEPS = 8

#: A term list travels inside the plan only up to these sizes; larger ones are looked up.
INLINE_TERMS = 50
INLINE_BYTES = 256 * 1024

#: Patterns that have to be tried on every text are tried so many at a time.
SLICE_TERMS = 2_000

#: A longer term table is one automaton per Python worker up to these sizes, some 100 MB.
INDEX_TERMS = 100_000
INDEX_BYTES = 1024 * 1024

#: A table is copied to every executor only if it was measured to be at most this large.
BROADCAST_BYTES = 64 * 1024 * 1024
