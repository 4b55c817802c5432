"""Fixed word lists and constants.

Every value here is a fixed value: results depend on the exact entries and on
their order. All of them are defaults; the operators take replacements as
arguments.
"""

# Topics in tie-break order.
TOPICS = [
    "performance", "usability", "features", "pricing", "support", "compatibility", "other",
]

# Sentiment states in model index order 0, 1, 2.
SENTIMENTS = ["positive", "negative", "neutral"]

# Rating categories.
RATING_CATEGORIES = ["low", "medium", "high"]

# Short topic lists used to guess the topic of a query.
QUERY_TOPIC_KEYWORDS = {
    "performance": ["slow", "fast", "crash", "bug", "freeze", "lag", "speed", "memory", "hang", "error"],
    "usability": ["easy", "difficult", "confusing", "intuitive", "ui", "interface", "simple", "user-friendly"],
    "features": ["feature", "function", "capability", "missing", "wish", "need", "want", "option"],
    "pricing": ["price", "cost", "expensive", "cheap", "value", "subscription", "free", "money", "worth"],
    "support": ["support", "help", "customer service", "documentation", "response", "team"],
    "compatibility": ["install", "compatible", "windows", "mac", "linux", "version", "os"],
}

# Longer topic lists used to label reviews.
LABEL_TOPIC_KEYWORDS = {
    "performance": ["slow", "fast", "crash", "bug", "freeze", "lag", "speed", "memory", "cpu", "hang", "stuck",
                    "error", "glitch"],
    "usability": ["easy", "difficult", "confusing", "intuitive", "ui", "interface", "learn", "simple",
                  "complicated", "user-friendly"],
    "features": ["feature", "function", "capability", "missing", "wish", "need", "want", "add", "include",
                 "option", "setting"],
    "pricing": ["price", "cost", "expensive", "cheap", "value", "subscription", "free", "pay", "money", "worth",
                "affordable"],
    "support": ["support", "help", "customer service", "response", "documentation", "update", "team", "email",
                "contact"],
    "compatibility": ["install", "compatible", "windows", "mac", "linux", "version", "os", "update", "upgrade",
                      "work with"],
}

# Cleaning, sampling and labelling limits.
MIN_TEXT_LENGTH, MAX_TEXT_LENGTH = 10, 5000
MIN_RATING, MAX_RATING = 1, 5
REVIEWS_PER_RATING = 20
MIN_LABEL_CONFIDENCE = 2
CURATED_SAMPLE_SIZE = 300

# Words that open a question, and words that mark a sentence.
QUESTION_WORDS = "how what why when where who which is are do does can could would should".split()
SENTENCE_MARKERS = "the a an about think feel mentioned said".split()

# Stop words of the phrase report; the other two reports add some.
PHRASE_STOP_WORDS = (
    "the and for this that with have was but not are you can all your from they been has had will more "
    "when make than into time very about"
).split()
VOCABULARY_STOP_WORDS = PHRASE_STOP_WORDS + (
    "out there were get some what only other which their also would use used using one two any much does did"
).split()
CONTEXT_STOP_WORDS = PHRASE_STOP_WORDS + "its too just use used".split()

# Spark ML's default English stop words without the contractions and single letters.
SEARCH_STOP_WORDS = (
    "me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers "
    "herself it its itself they them their theirs themselves what which who whom this that these those am is "
    "are was were be been being have has had having do does did doing an the and but if or because as until "
    "while of at by for with about against between into through during before after above below to from up "
    "down in out on off over under again further then once here there when where why how all any both each few "
    "more most other some such no nor not only own same so than too very can will just don should now cannot "
    "could ought would"
).split()

# Groups of related review words.
SYNONYM_GROUPS = {
    "fast": ["quick", "speedy", "rapid", "swift", "responsive"],
    "slow": ["sluggish", "laggy", "unresponsive", "delayed"],
    "easy": ["simple", "straightforward", "intuitive", "user-friendly"],
    "difficult": ["hard", "complicated", "complex", "confusing", "challenging"],
    "bug": ["error", "issue", "problem", "glitch", "defect"],
    "expensive": ["pricey", "costly", "overpriced"],
    "cheap": ["affordable", "inexpensive", "budget-friendly"],
    "good": ["great", "excellent", "amazing", "wonderful", "fantastic"],
    "bad": ["poor", "terrible", "awful", "horrible"],
    "install": ["setup", "installation", "download"],
    "crash": ["freeze", "hang", "stuck"],
}

# Abbreviations whose full stop does not end a sentence.
ABBREVIATIONS = "Mr Mrs Ms Dr Prof Sr Jr St vs etc Inc Ltd Co No approx".split()

# Own seed list: word polarity on a scale from -4 to 4. Replace it with a full sentiment table.
POLARITY = {
    "amazing": 2.8, "awesome": 3.1, "awful": -2.0, "bad": -2.5, "best": 3.2, "better": 1.9, "broken": -2.1,
    "bug": -1.5, "confusing": -1.3, "crash": -2.0, "crashed": -2.0, "crashes": -2.0, "difficult": -1.5,
    "easy": 1.9, "error": -1.7, "excellent": 2.7, "fail": -2.5, "fantastic": 2.6, "fast": 1.2, "fine": 0.8,
    "free": 2.3, "frustrating": -1.9, "glitch": -1.5, "good": 1.9, "great": 3.1, "happy": 2.7, "hate": -2.7,
    "helpful": 1.8, "horrible": -2.5, "intuitive": 1.7, "like": 1.5, "love": 3.2, "loved": 2.9, "nice": 1.8,
    "okay": 0.9, "perfect": 2.7, "poor": -2.1, "problem": -1.7, "recommend": 1.5, "reliable": 1.9,
    "slow": -1.2, "terrible": -2.1, "useless": -1.8, "waste": -1.8, "well": 1.1, "wonderful": 2.7,
    "worse": -2.1, "worst": -3.1, "worth": 0.9, "wrong": -2.1,
}

# Published constants of the rule-based polarity score.
NEGATION_FACTOR = -0.74
BOOST = 0.293
EXCLAMATION_BOOST = 0.292
POLARITY_ALPHA = 15.0

# Own seed lists for the polarity rules.
NEGATIONS = "not no never none nothing neither nor cannot without hardly isn't wasn't don't doesn't didn't can't won't".split()
BOOSTERS_UP = "very really extremely absolutely completely highly incredibly totally so".split()
BOOSTERS_DOWN = "slightly somewhat barely kinda partly almost".split()
