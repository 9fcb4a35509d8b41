"""Fixed values.

Everything in this module is a constant of the data contract (word lists, header
names, indicators, delimiters, thresholds). The values decide results, so they are
kept together and in plain form; every operator takes them as default parameters.
"""

# --- stop words: the public default lists of Spark ML (`StopWordsRemover`), as fixed values ---
ENGLISH_STOP_WORDS = tuple("""
    i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers
    herself it its itself they them their theirs themselves what which who whom this that these those am is are
    was were be been being have has had having do does did doing a an the and but if or because as until while
    of at by for with about against between into through during before after above below to from up down in out
    on off over under again further then once here there when where why how all any both each few more most
    other some such no nor not only own same so than too very s t can will just don should now i'll you'll he'll
    she'll we'll they'll i'd you'd he'd she'd we'd they'd i'm you're he's she's it's we're they're i've we've
    you've they've isn't aren't wasn't weren't haven't hasn't hadn't don't doesn't didn't won't wouldn't shan't
    shouldn't mustn't can't couldn't cannot could here's how's let's ought that's there's what's when's where's
    who's why's would
""".split())
TURKISH_STOP_WORDS = tuple("""
    acaba ama aslında az bazı belki biri birkaç birşey biz bu çok çünkü da daha de defa diye eğer en gibi hem
    hep hepsi her hiç için ile ise kez ki kim mı mu mü nasıl ne neden nerde nerede nereye niçin niye o sanki şey
    siz şu tüm ve veya ya yani
""".split())
# --- chat stop words, added to both lists ---
CHAT_STOP_WORDS = (
    "abi", "kanka", "aga", "knk", "reyiz", "reis", "hocam", "orda", "burda", "şurda",
    "yani", "şey", "ben", "sen", "biz", "siz", "onlar", "bu", "şu", "o",
    "ama", "veya", "yada", "gibi", "ile", "için", "mi", "mı", "mu", "mü",
    "bi", "bir", "be", "de", "da", "ki", "ne", "ya", "hee", "yaw", "yav",
    "çok", "az", "var", "yok", "evet", "hayır",
    "bro", "bruh", "dude", "pls", "plz", "ffs", "gg", "wp", "ez", "ngl", "smh", "tbh",
    "btw", "aka", "afk", "rn", "imo", "imho",
    "lul", "lol", "kekw", "omegalul", "pog", "poggers", "pogchamp", "kappa", "pepega",
    "residentsleeper", "sadge", "copium", "monkas", "feelsbadman", "feelsgoodman",
    "haha", "hehe", "hihi",
    "wtf", "lmao", "amk", "aq", "zort", "oe", "oç", "oc",
)
MIN_WORD_LENGTH = 3

# Word tokenizer contractions: a whole word on the left becomes the two on the right.
CONTRACTIONS = (
    ("cannot", "can not"),
    ("gimme", "gim me"),
    ("gonna", "gon na"),
    ("gotta", "got ta"),
    ("lemme", "lem me"),
    ("wanna", "wan na"),
)

# --- labels ---
LABELS = ("negative", "neutral", "positive", "unknown")
POLARITY_THRESHOLD = 0.1
VALENCE_THRESHOLD = 0.05
MODEL_LABEL_NAMES = {
    "LABEL_0": "negative", "LABEL_1": "neutral", "LABEL_2": "positive",
    "0": "negative", "1": "neutral", "2": "positive",
}

# --- valence rules (Hutto and Gilbert, 2014) ---
BOOST = 0.293
BOOST_DAMPING = (1.0, 0.95, 0.9)
NEGATION_FACTOR = -0.74
CAPS_EMPHASIS = 0.733
EXCLAMATION_STEP = 0.292
EXCLAMATION_MAX = 4
QUESTION_STEP = 0.18
QUESTION_FULL = 0.96
BEFORE_BUT = 0.5
AFTER_BUT = 1.5
NORMALISER = 15.0
NEGATIONS = (
    "aint", "arent", "cannot", "cant", "couldnt", "didnt", "doesnt", "dont", "hadnt",
    "hasnt", "havent", "isnt", "mightnt", "mustnt", "neednt", "neither", "never", "none",
    "nope", "nor", "not", "nothing", "nowhere", "shouldnt", "wasnt", "werent", "without",
    "wont", "wouldnt", "rarely", "seldom", "despite",
)
BOOSTERS_UP = (
    "absolutely", "amazingly", "awfully", "completely", "considerably", "deeply",
    "especially", "exceptionally", "extremely", "fully", "greatly", "highly", "hugely",
    "incredibly", "intensely", "particularly", "purely", "quite", "really", "remarkably",
    "so", "thoroughly", "totally", "tremendously", "unusually", "utterly", "very",
)
BOOSTERS_DOWN = (
    "almost", "barely", "hardly", "kinda", "less", "little", "marginally", "occasionally",
    "partly", "scarcely", "slightly", "somewhat", "sorta",
)

# --- webhook contract ---
H_SIGNATURE = "Kick-Event-Signature"
H_MESSAGE_ID = "Kick-Event-Message-Id"
H_TIMESTAMP = "Kick-Event-Message-Timestamp"
H_EVENT_TYPE = "Kick-Event-Type"
CHAT_EVENT = "chat.message.sent"
UNKNOWN_SENDER = "bilinmeyen"
TEST_INDICATORS = (
    "test", "test_", "test123", "test_sender", "test_message",
    "debug_broadcaster", "debug_self_test", "verify_test_",
)
PENDING_SENTIMENT = "N/A"

# --- captured page contract ---
ENTRY_MARK = 'data-chat-entry="'
CONTENT_MARK = 'class="chat-entry-content">'
CONTENT_END = "</div>"
USER_ID_MARK = 'data-chat-entry-user-id="'
NAME_END = "</span>"
BREAKER_MARK = "chatroom-history-breaker"
ERROR_PAGE_TEXT = "Oops, Something went wrong"
SECURITY_PAGE_TEXT = "Checking if the site connection is secure"
NO_USER_ID = "unknown_user_id"
NO_USER_NAME = "UnknownUser"
SNIPPET_LENGTH = 200

# Errors that end a capture: the Turkish texts of the contract and their English forms.
CRITICAL_ERRORS = (
    "kazıyıcı durduruluyor", "404", "tarayıcı başlatılamadı",
    "kazıma döngüsünde işlenmeyen hata", "sayfa kaynağı alınamadı",
    "stopping scraper", "failed to initialize browser",
    "unhandled error in scraping loop", "failed to get page source",
)

# --- sinks and retention ---
LOG_COLUMNS = ("timestamp", "username", "message")
UNKNOWN_CHANNEL = "unknown_kick_channel"
LOG_NAME_PREFIX = "live-kick-data"
KEEP_STREAM_MESSAGES = 100
ITEMS_PER_CYCLE = 100
KEEP_WEBHOOK_MESSAGES = 50
KEEP_RAW_EVENTS = 200
SUMMARY_TAIL = 5
DISPLAY_ROWS = 100
PREVIEW_ROWS = 5
CLOUD_WORDS = 100

# --- topic model ---
TOPIC_COUNT = 5
TOPIC_WORDS = 5
TOPIC_SEED = 100
TOPIC_CHUNK = 100
TOPIC_PASSES = 10
COHERENCE_WINDOW = 110
COHERENCE_WORDS = 20
COHERENCE_EPSILON = 1e-12

# --- suggestions ---
NO_DATA_TEXT = "Not enough data for suggestions."
MOOD_TEXT = {
    "positive": "Overall chat sentiment is positive! Keep up the great engagement.",
    "negative": "Consider addressing potential concerns, as overall sentiment leans negative.",
    "neutral": "Chat sentiment is mostly neutral. Look for opportunities to boost engagement.",
}
TOPIC_TEXT = ("Top discussion keywords include: ", ". Consider focusing on these.")
NO_TOPIC_TEXT = "Topic modeling did not produce results for suggestions."
NEGATIVE_TEXT = (
    "Keywords associated with negative sentiment include: ",
    ". Be mindful of discussions around these.",
)

# --- training ---
TEST_PERCENT = 20
