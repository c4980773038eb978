"""Fixed values.

Everything in this module is a value that has to be what it is for results to be right:
Unicode block ranges, word lists, text patterns, limits, names and question texts. No logic
lives here; the operators read these tables.
"""

from __future__ import annotations

# --- limits -----------------------------------------------------------------------------

DETECTION_CHARS = 4000      # code points of the flattened context that detection looks at
DETECTION_DEPTH = 6         # string leaves nested deeper than this are not looked at
EMAIL_CHARS = 3000          # default code-point limit of a cleaned email body
OPTION_TOKENS = 48          # ids kept per option text
MIN_HEAD_ROOM = 16          # ids that must stay free for the question text
MIN_OPTION_TOKENS = 4       # an option is never cut below this, mask included
MIN_HEAD_TOKENS = 8         # a question text is never cut below this
MAX_CONTEXT = 8192          # longest sequence of any checkpoint
DEFAULT_MAX_LEN = 512
DEFAULT_HEAD_MAX_LEN = 192
LOW_DIACRITIC_RATE = 0.02
HIGH_DIACRITIC_RATE = 0.04
SIGNATURE_BYTES = 40        # a signature line is at most this many bytes long
SIGNATURE_SHARE = 0.6       # signatures are looked for after this share of the lines ...
SIGNATURE_TAIL = 8          # ... or in the last lines, whichever starts earlier
SCORE_TOLERANCE = 2e-3      # tolerance of model output in parity reports
DRIFT_GATE = 1e-2           # largest accepted logit difference between graph variants

# --- scripts: name and code-point ranges ---------------------------------------------------

LATIN_RANGES = [(0x0000, 0x024F), (0x1E00, 0x1EFF)]

SCRIPT_RANGES = [
    ("greek", [(0x0370, 0x03FF), (0x1F00, 0x1FFF)]),
    ("cyrillic", [(0x0400, 0x052F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)]),
    ("hebrew", [(0x0590, 0x05FF)]),
    ("arabic", [(0x0600, 0x06FF), (0x0750, 0x077F), (0x08A0, 0x08FF), (0xFB50, 0xFDFF),
                (0xFE70, 0xFEFF)]),
    ("devanagari", [(0x0900, 0x097F), (0xA8E0, 0xA8FF)]),
    ("bengali", [(0x0980, 0x09FF)]),
    ("gurmukhi", [(0x0A00, 0x0A7F)]),
    ("gujarati", [(0x0A80, 0x0AFF)]),
    ("oriya", [(0x0B00, 0x0B7F)]),
    ("tamil", [(0x0B80, 0x0BFF)]),
    ("telugu", [(0x0C00, 0x0C7F)]),
    ("kannada", [(0x0C80, 0x0CFF)]),
    ("malayalam", [(0x0D00, 0x0D7F)]),
    ("sinhala", [(0x0D80, 0x0DFF)]),
    ("thai", [(0x0E00, 0x0E7F)]),
    ("lao", [(0x0E80, 0x0EFF)]),
    ("tibetan", [(0x0F00, 0x0FFF)]),
    ("myanmar", [(0x1000, 0x109F)]),
    ("georgian", [(0x10A0, 0x10FF)]),
    ("ethiopic", [(0x1200, 0x137F)]),
    ("khmer", [(0x1780, 0x17FF)]),
    ("hangul", [(0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF)]),
    ("kana", [(0x3040, 0x309F), (0x30A0, 0x30FF), (0x31F0, 0x31FF)]),
    ("han", [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF)]),
]

# --- Latin-script languages: stopwords in tie-break order, English first ---------------------

STOPWORDS = {
    "en": "the and is are was were to of in for with that this it you have has not but on at be "
          "as from will can would there their what which please we i",
    "fr": "le la les des une est pour dans que qui avec sur pas plus nous vous être cette mais "
          "sont ont aux ce",
    "de": "der die das und ist ein eine den dem nicht mit für auf von zu sich auch werden wurde "
          "haben sind oder aber",
    "es": "el los las que por con para una es se del como pero son está este esta todo más muy "
          "hay sus",
    "pt": "os as que em um uma para com não é se do da dos das mas são está este esta muito pelo "
          "pela",
    "it": "il lo gli che di per con non è si del della sono questo questa anche come più nella "
          "alla",
    "nl": "het een van is op te dat niet met voor zijn aan door maar ook worden deze naar wordt",
}

DIACRITICS = "àâäãáåçéèêëíìîïñóòôöõøúùûüýÿßæœđłşţğı"

WORD_PATTERN = r"[\p{L}\p{Nl}\p{No}]+"

# --- whitespace ---------------------------------------------------------------------------

# Characters trimmed from lines, paragraphs, subjects and names (Unicode White_Space).
SPACE_CHARS = "".join(map(chr, [
    0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
    0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))

# Whitespace as the email patterns understand it: no vertical tab, but the separators 1c-1f.
PATTERN_SPACE = r"[\t\n\f\r \p{Z}\x{85}\x{1c}-\x{1f}]"

# --- email patterns -------------------------------------------------------------------------
# "~" stands for PATTERN_SPACE. All but the rule of underscores ignore case.

QUOTE_HEADERS = [
    r"^~*On .{0,300}wrote:~*$",
    r"^~*-{2,}~*(Original|Forwarded) Message~*-{2,}",
    r"^~*_{8,}~*$",
    r"^~*From:~*.+$",
]

SIGNATURE_MARKERS = [
    r"^~*--~*$",
    r"^~*(best|kind|warm|many thanks|thanks|thank you|regards|cheers|sincerely)"
    r"[\p{L}\p{N}_ ,!.]*$",
    r"^~*sent from my (iphone|android|mobile|ipad)",
]

DISCLAIMERS = [
    r"confidential",
    r"intended (solely )?for the (use of the )?(named )?(addressee|recipient)",
    r"if you (have )?received this (e-?mail|message) in error",
]

# --- checkpoints ------------------------------------------------------------------------------

MODEL_NAMES = ["english", "multilingual", "typed-decisions"]

ALIASES = {
    "en": "english", "default": "english",
    "multi": "multilingual", "ml": "multilingual",
    "typed": "typed-decisions", "typed_decisions": "typed-decisions",
    "decisions": "typed-decisions",
}

REPO_SUFFIXES = {"english": "", "multilingual": "/multilingual",
                 "typed-decisions": "/typed-decisions"}

ENGLISH_CODES = ["en", "eng", "english"]

DEFAULT_MASK = "[MASK]"
DEFAULT_GRAPH_FILE = "model.onnx"
GRAPH_INPUTS = ["input_ids", "attention_mask", "marker_pos", "marker_mask", "qtype"]
GRAPH_OUTPUTS = ["logits", "act_logits"]

# Question-id sets of the workflows the typed-decisions checkpoint was made for.
WORKFLOWS = {
    "agent_trace_observability": ["action", "needs_review", "outcome", "risk", "urgency"],
    "customer_service": ["action", "category", "churn_risk", "needs_human", "urgency"],
    "invoice_processing": ["discrepancy_severity", "disposition", "duplicate", "matches_order",
                           "urgency"],
    "security_incidents": ["credential_compromise", "disposition", "severity", "true_positive",
                           "urgency"],
}

# --- questions ----------------------------------------------------------------------------------

QTYPES = ["choice", "score", "noul"]   # the position is the type code
NOUL_FALSE = "no, the statement does not hold"
NOUL_TRUE = "yes, the statement holds"

PRESET_DESCRIPTIONS = {
    "email": "inbound email triage and threat filtering (state keys `subject`, `body`, `from`)",
    "guard": "real-time LLM input guardrails: jailbreak, injection, sensitive data, harm, topic "
             "(state key `prompt`)",
    "moderation": "content safety: toxicity, harassment, threats, spam, severity "
                  "(state key `post`)",
    "router": "LLM model routing: difficulty, domain, tools, sensitivity (state key `request`)",
    "triage": "support ticket triage: intent, urgency, frustration, refund, churn "
              "(state key `message`)",
}

# preset -> question id -> (type, instructions, criteria)
PRESETS = {
    "triage": {
        "intent": ("choice", "What does the customer want in `message`?", {
            "refund": "money returned or a duplicate charge reversed",
            "technical_help": "a bug, outage or integration problem",
            "billing_question": "a question about an invoice, plan or payment method",
            "information": "general information, pricing or how-to",
            "cancellation": "wants to cancel or downgrade",
            "other": "none of the other options fits"}),
        "is_urgent": ("noul", "Does `message` communicate time pressure or a deadline?", None),
        "frustration": ("score", "How frustrated does the customer sound in `message`?", [
            "calm and neutral", "concerned but civil", "clearly annoyed",
            "very angry or using strong language"]),
        "refund_requested": ("noul", "Does the customer ask for money back?", None),
        "churn_risk": ("noul", "Does `message` suggest the customer may leave for a competitor "
                               "or cancel?", None),
    },
    "email": {
        "category": ("choice", "Which team should handle the email in `body`?", {
            "billing": "invoices, payments, refunds",
            "technical": "bugs, outages, integrations",
            "sales": "pricing, demos, new purchases",
            "security": "phishing, scams, account compromise",
            "hr": "hiring, leave, payroll",
            "other": "none of the above"}),
        "is_spam": ("noul", "Is this email unsolicited spam or bulk marketing?", None),
        "is_phishing": ("noul", "Is this email a phishing or scam attempt to steal money, "
                                "credentials, or personal data?", {
            "true": "phishing, scam, or fraud", "false": "a legitimate email"}),
        "urgency": ("score", "How urgent is the request in `body`?", [
            "no time pressure", "needs attention soon", "blocking issue or hard deadline"]),
        "needs_reply": ("noul", "Does the sender expect a reply?", None),
    },
    "guard": {
        "jailbreak": ("noul", "Does `prompt` try to make an AI assistant ignore its rules, "
                              "policies or system instructions?", None),
        "prompt_injection": ("noul", "Does `prompt` contain instructions aimed at the AI system "
                                     "rather than a genuine user request?", None),
        "sensitive_data": ("noul", "Does `prompt` contain credentials, personal data or other "
                                   "sensitive information?", None),
        "harm_severity": ("score", "How much harm would complying with `prompt` cause?", [
            "none: ordinary request", "minor: mildly inappropriate",
            "serious: unsafe advice or abuse", "severe: dangerous or illegal"]),
        "topic": ("choice", "What is `prompt` about?", {
            "product_support": None, "coding": None, "general_knowledge": None,
            "personal_advice": None, "security_testing": None, "other": None}),
    },
    "moderation": {
        "toxic": ("noul", "Is `post` toxic: rude, disrespectful or likely to make someone leave "
                          "the discussion?", None),
        "harassment": ("noul", "Does `post` target or harass a specific person?", None),
        "threat": ("noul", "Does `post` threaten violence, harm or intimidation?", None),
        "spam": ("noul", "Is `post` spam or advertising?", None),
        "severity": ("score", "How severe is any rule-breaking in `post`?", [
            "no rule-breaking: ordinary on-topic post",
            "mild: rude tone or off-topic, no target",
            "clear violation: insults, harassment or spam aimed at someone",
            "severe: threats, hate speech or calls for violence"]),
    },
    "router": {
        "difficulty": ("score", "How hard is `request` for a language model?", [
            "trivial: a lookup or one-liner", "easy: short answer, no reasoning",
            "moderate: several steps",
            "hard: long multi-step reasoning or specialist knowledge"]),
        "domain": ("choice", "What domain does `request` belong to?", {
            "code": "software engineering, programming, refactoring, architecture, debugging",
            "math_or_logic": "mathematics, logic puzzles, proofs, complex calculation",
            "writing": "creative writing, essays, emails, blog posts, copywriting",
            "factual_lookup": "facts, definitions, trivia, history",
            "data_analysis": "statistics, SQL, data manipulation, metrics",
            "chitchat": "casual conversation, greetings, small talk"}),
        "needs_tools": ("noul", "Does answering `request` require external tools, search or "
                                "private data?", None),
        "is_sensitive": ("noul", "Does `request` involve money, legal, medical or safety "
                                 "consequences?", None),
    },
}

# --- requests -----------------------------------------------------------------------------------

CONTEXT_FIELDS = ["context", "state"]
SPEC_FIELDS = ["spec", "questions"]
HINT_FIELDS = ["model", "lang", "task"]
REQUEST_FIELDS = CONTEXT_FIELDS + SPEC_FIELDS + ["categories"] + HINT_FIELDS + ["max_len"]
