"""Lists, patterns and texts that must be as they are for the results to be right."""

# --- fixed values: scrub patterns, in the order in which they apply -------------------------------------------------
SCRUB_SQL = [
    (r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}", "[EMAIL]"),
    (r"\b(?:\d{1,3}\.){3}\d{1,3}\b", "[IP]"),
    (r"https?://[^\s\"<>()\]]+", "[URL]"),
    (r"\bwww\.[a-zA-Z0-9\-\.]+\.[a-zA-Z]{2,}(?:/[^\s]*)?", "[URL]"),
    (r"\b[a-zA-Z0-9\-\.]+\.[a-zA-Z]{2,}/wp-(?:admin|login|json|content)[^\s]*", "[URL]"),
    (r"(?i)Bearer\s+[A-Za-z0-9\-._~+/]+=*", "[API_KEY]"),
    (r"\b(?:sk|pk|rk|whsec|xoxb|xoxa|xoxp|xoxs|ghp|gho|ghs|ghr)[-_][A-Za-z0-9][A-Za-z0-9_-]{9,}", "[API_KEY]"),
    (r"\+\d[\d\s\-().]{7,20}\d", "[PHONE]"),
    (r"(?i)(?:password|passwd|pwd)\s*(?:is|:|=|was)\s*\S+", "[CREDENTIAL]"),
]
EMAIL = SCRUB_SQL[0][0]
#: The other scrub chain: its URL class also ends at a single quote, it has no rule for addresses of log-in pages without a
#: scheme, and it has one for one-time codes.
SCRUB_CODES = [
    (r"(?i)[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}", "[EMAIL]"),
    SCRUB_SQL[1],
    (r"https?://[^\s\"'<>()\]]+", "[URL]"),
    SCRUB_SQL[3],
    SCRUB_SQL[5],
    SCRUB_SQL[6],
    SCRUB_SQL[7],
    SCRUB_SQL[8],
    (r"(?i)(?:verification|OTP|one[\s\-]time)\s+(?:code\s+)?(?:is\s+)?\b\d{4,8}\b", "[OTP]"),
]
# --- fixed values: what must not be left after scrubbing ------------------------------------------------------------
RESIDUAL = [
    ("email", r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}"),
    ("ipv4", r"\b(?:\d{1,3}\.){3}\d{1,3}\b"),
    ("url_https", r"https?://[^\s]+"),
    ("url_www", r"\bwww\.[a-zA-Z0-9\-\.]+\.[a-zA-Z]{2,}"),
    ("wp_admin", r"/wp-(?:admin|login|json|content)"),
    ("password_phrase", r"(?i)password\s*(?:is|:|=|was)\s*\S+"),
    ("bearer_token", r"(?i)Bearer\s+[A-Za-z0-9]{10,}"),
    ("api_key_prefix", r"\b(?:sk|pk|rk|whsec|xoxb)[-_][A-Za-z0-9]{10,}"),
]
# --- fixed values: entities found by pattern, and the placeholders that are numbered --------------------------------
DOMAIN = r"\b(?:[a-zA-Z0-9](?:[a-zA-Z0-9\-]{0,61}[a-zA-Z0-9])?\.)+(?:com|net|org|io|co|info|biz|dev|app|site|online|cloud|ai|me|us|uk|ca|de|fr|nl|eu|am)\b"
ACCOUNT = r"\b(?:acct|site|client|account|user|cust|inv|order|sub|ticket|ref)[-_#]?[0-9]{4,12}\b"
UUID = r"\b[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\b"
#: Agents whose names stay in clear; a parameter of the operator.
CLEAR_AGENTS = ["Answer Bot"]
# --- fixed values: ratings (the first is two code points) -----------------------------------------------------------
HEART, SAD = "❤️", "\U0001f61e"
# --- fixed values: character references, in the order in which they are replaced ------------------------------------
ENTITIES = [
    ("&#39;", "'"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&nbsp;", " "),
    ("&#160;", " "), ("&ndash;", "-"), ("&mdash;", "-"), ("&hellip;", "..."), ("&copy;", "(c)"), ("&reg;", "(R)"),
]
# --- fixed values: stop words ---------------------------------------------------------------------------------------
STOP_WORDS = """
i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself
it its itself they them their theirs themselves a an the am is are was were be been being have has had having
do does did doing and but or if because as so than of at by for with to from in on into onto up down out off
over under through during before after above below between among about against across around within without until while
what which who whom when where why how this that these those all any both each few more most other some such no nor
only own same too very here there then now once again further s t d ll m re ve don doesn didn isn aren wasn weren
hasn haven hadn won wouldn couldn shouldn just ok okay yes yeah sure really actually maybe probably like one also
already even way well two left right long short big small
""".split()
# --- fixed values: requests for a person ----------------------------------------------------------------------------
AGENT_REQUEST = "|".join([
    r"\btalk[ _-]?to[ _-]?(an?[ _-])?(agent|human|person|operator|support)\b",
    r"\bspeak[ _-]?(to|with)[ _-]?(an?[ _-])?(agent|human|person|operator|support)\b",
    r"\bconnect[ _-]?(me[ _-]?)?(to|with)[ _-]?(an?[ _-])?(agent|human|person|operator|support)\b",
    r"\bneed[ _-]?(an?[ _-])?(agent|human|person|operator|support)\b",
    r"\bi[ _-]?want[ _-]?(an?[ _-])?(human|agent|person|operator|real[ _-]?person)\b",
    r"\blive[ _-]?(agent|chat|support|person)\b",
    r"\bhuman[ _-]?(agent|support|help)\b",
    r"\breal[ _-]?person\b",
])
# --- fixed values: failure types in order of precedence -------------------------------------------------------------
FAILURE_TYPES = [
    "explicit_negative_bot", "explicit_negative_escalated", "repetition_loop", "agent_request_unserved", "escalated_no_feedback",
    "abandoned_inquiry", "resolved_positive", "trivial_noise", "resolved_or_unknown",
]
# --- fixed values: strata of sample chunks in order of rank ---------------------------------------------------------
STRATA = ["negative", "probable_failure", "abandoned_inquiry", "escalated_no_feedback", "resolved_or_unknown", "trivial_noise", "positive", "no_failure_flags", "unmapped_failure"]
# --- fixed values: texts that make no sample ------------------------------------------------------------------------
SAMPLE_BOILERPLATE = (
    r"were my answers helpful|how would you rate the support|it was a pleasure assisting"
    r"|you.ll receive an nps survey|i.m now ending this chat session|please don.t hesitate to start a new one"
)
# --- fixed values: boilerplate in chunks ----------------------------------------------------------------------------
NPS = r"were (my|our) answers helpful|rate (your|this) (chat|experience)|how (would you rate|satisfied)"
CLOSING = r"(chat|conversation|session) (has been |is )?closed|goodbye|take care|bye"
FILLER = r"thank you for (contacting|reaching out|using|choosing)|is there anything else"
BOILERPLATE = NPS + r"|(chat|conversation|session) (has been |is )?closed|" + FILLER
# --- fixed values: client messages without content ------------------------------------------------------------------
SHORT_REPLIES = [
    "hi", "hello", "hey", "yes", "no", "ok", "okay", "sure", "thanks", "bye", "goodbye", "please", "alright", "right", "great", "perfect", "awesome",
    "cool", "fine", "noted", "understood", "agree", "agreed", "welcome", "yep", "nope", "np", "ty", "thx", "yw", "k", "hmm", "oh", "ah", "well", "nice",
    "good", "wow", "thank you", "thank you!", "thanks!", "got it", "i see", "sounds good", "no problem", "no worries", "of course", "absolutely",
    "certainly", "will do", "makes sense", "fair enough", "i know", "i understand", "take care", "good luck", "see you", "cheers",
    "thank you very much", "many thanks", "much appreciated",
]
# --- fixed values: themes that say too little -----------------------------------------------------------------------
VAGUE_THEME = r"\btechnical issues?\b|\baccount problems?\b|\bbilling questions?\b|\bgeneral\b|\bvarious\b|\bmisc"
# --- fixed values: clusters with a declining trend ------------------------------------------------------------------
DECLINING = [1, 2, 3, 4, 5, 8, 9, 10, 11, 13, 15, 19, 20]
# --- fixed values: phrases by which clients ask for escalation ------------------------------------------------------
ESCALATION_PHRASES = [
    ("agent", r"\bagent\b"),
    ("human", r"\bhuman\b"),
    ("live chat/support", r"live (chat|support|agent)"),
    ("speak to someone", r"speak to (someone|a person|support)"),
    ("real person", r"real person"),
    ("supervisor/manager", r"(supervisor|manager)"),
    ("escalate", r"\bescalate\b"),
    ("talk to agent", r"talk to (someone|a human|an agent|agent)"),
    ("customer service", r"customer service"),
]
# --- fixed values: the team that a cluster goes to; others go to the first ------------------------------------------
TEAMS = {
    "Support / KB": [0, 2, 21],
    "Billing / Finance": [1, 4, 7, 14],
    "Sales / Product": [3, 17, 22, 23],
    "Engineering": [5, 6, 8, 9, 10, 11, 12, 13, 15, 16, 18, 19, 20],
}
# --- fixed values: whole messages that say nothing ------------------------------------------------------------------
EMPTY_MESSAGES = """
hi
hello
hey
yes
no
ok
okay
sure
thanks
bye
goodbye
please
alright
right
great
perfect
awesome
cool
fine
noted
understood
agree
agreed
welcome
yep
nope
np
ty
thx
yw
k
hmm
oh
ah
well
nice
good
wow
sorry
correct
true
wait
idk
one moment
please wait
hold on
stand by
just a moment
one sec
one second
brb
i'm sorry
i am sorry
my apologies
apologies
that's right
you're right
you are right
i agree
sure thing
not really
i don't know
i do not know
thank you
thank you!
thanks!
good morning
good afternoon
good evening
got it
i see
sounds good
no problem
no worries
my pleasure
of course
absolutely
certainly
will do
sounds great
works for me
makes sense
fair enough
i know
i understand
take care
good luck
same to you
no rush
that works
you are welcome
you're welcome
it was my pleasure
thank you very much
many thanks
much appreciated
have a great day
have a nice day
have a good day
have a great week
have a good week
good to know
talk soon
see you
best regards
kind regards
warm regards
best wishes
sincerely
cheers
regards
ok thanks
okay thanks
ok thank you
got it thanks
thank you for your help
thanks for your help
thanks for helping
you're welcome!
you are welcome!
""".strip().split("\n")
# --- fixed values: beginnings of messages that say nothing ----------------------------------------------------------
EMPTY_BEGINNINGS = """
as an ai
i am an ai
i'm an ai
i am a virtual assistant
i'm a virtual assistant
i am a chatbot
i'm a chatbot
please note that i am
i do not have access to
i cannot access your account
i don't have access to
is there anything else i can help
let me know if you need anything else
let me know if you have any
feel free to reach out
feel free to ask
feel free to contact
please don't hesitate
please feel free
please let me know
hope that helps
hope this helps
have a great day
have a nice day
have a good day
have a wonderful day
have a great week
if you have any other
if you have any questions
if you need anything else
if there's anything else
thank you for reaching out
thank you for contacting
thank you for your message
thank you for your inquiry
thank you for your patience
thank you for using
thank you for choosing
thank you for your time
i'm here to help
i am here to help
i'd be happy to
i would be happy to
i'll be happy to
i will be happy to
i'm happy to assist
i am happy to assist
of course, i
certainly, i
absolutely, i
i apologize for any inconvenience
i'm sorry for any inconvenience
i apologize for the inconvenience
i'm sorry for the inconvenience
i understand your frustration
i understand how frustrating
i can understand your
i can see that you
i see that you are
one moment please
just a moment please
please wait while
please hold on
please give me a moment
let me help you
i'll help you with that
i will help you with that
i can help you with that
i'd be glad to
i would be glad to
i'll be glad to
i will be glad to
happy to help
glad to help
great question
good question
that's a great question
let me explain
allow me to explain
as i mentioned
as mentioned earlier
as stated above
to summarize
in summary
to recap
""".strip().split("\n")
