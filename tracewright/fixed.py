"""Word lists, limits, weights, patterns and formats that results depend on.

Patterns are in Java's dialect.  ``\\b`` of ASCII-only patterns is spelled out with look-around.
"""

# Limits -------------------------------------------------------------------------------------------------------
MAX_LINE_BYTES = 4 * 1024 * 1024
MAX_TEXT_BYTES = 64 * 1024
TRUNCATION_MARK = "\n[…truncated…]"
STAMP_BYTES = 64 * 1024
MAX_QUERY_CHARS, MAX_TERMS, MAX_TERM_CHARS, MAX_HINTS, MAX_REPO_HINTS = 2048, 32, 64, 16, 8
MAX_SESSIONS, MAX_EVIDENCE, MAX_CONTEXT = 20, 100, 3
CANDIDATES_PER_EVIDENCE, MAX_CANDIDATES = 40, 4000
MARKDOWN_LINES = 80

# Versions of stored and emitted data ---------------------------------------------------------------------------
SCHEMA_VERSION, OUTPUT_SCHEMA_VERSION, RANKER_VERSION = 2, 1, 1
APPLICATION_ID = 0x54524143  # our own mark of an index folder

# Ranking -------------------------------------------------------------------------------------------------------
FIELD_WEIGHTS = {"user": 20.0, "assistant": 3.0, "tool": 1.0, "metadata": 7.0}
BM25_K1, BM25_B, BM25_LEAST_IDF = 1.2, 0.75, 1e-6
BOOST_ID = BOOST_PR = BOOST_COMMIT = 4_000_000
BOOST_VERSION, BOOST_REPO = 3_000_000, 6_000_000
BOOST_WHY_USER, BOOST_WHY_ASSISTANT, BOOST_HOW_DONE, BOOST_HOW_TOOL = 1_500_000, 900_000, 1_500_000, 800_000
BOOST_UNFINISHED, BOOST_MODEL, BOOST_ATTACHMENT, BOOST_CHRONOLOGY = 1_500_000, 2_000_000, 2_000_000, 700_000
CHRONOLOGY_STEP, CHRONOLOGY_MOST = 10, 100

# Word lists ----------------------------------------------------------------------------------------------------
STOPWORDS = (
    "a an and are as at be been but by can could did do does for from had has have i if in into is it me my of on or our "
    "please that the their then there these they this to us was we were what when where which who with would you your"
).split()
PATH_PREFIXES = "bin dev etc home opt private src tmp users usr var volumes".split()

# Intents: (name, words and score, words or phrases and score ...) ------------------------------------------------
WHY = (("why", 12), ("rationale reason reasons", 7), ("decision", 4))
HOW = (("how", 10), ("implementation implemented approach", 5))
UNFINISHED = ("unfinished incomplete remaining remains pending todo", ("left to do", "still needs"), 10)
CHRONOLOGY = (("chronology timeline sequence", 11), ("before after between", 7), ("from through until to", 7), ("over time", 7))
MODEL = (("model models", 9), ("reasoning effort", 6), ("handoff handoffs", 6))
ATTACHMENT = (("attachment attachments screenshot screenshots image images photo photos", 9), ("file lineage", 6), ("visual input", 6))

# Patterns of hints in questions ----------------------------------------------------------------------------------
UUID = r"(?iuU)\b[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\b"
LABELLED_ID = (
    r"(?iuU)\b(?:session|thread|task|turn|run|workflow|build)(?:\s+id)?\s*[:=#]\s*([a-z0-9][a-z0-9_.:-]{2,127})\b"
    r"|\bid\s*[:=#]\s*([a-z0-9][a-z0-9_.:-]{2,127})\b"
)
LOOSE_ID = r"(?iuU)\b(?:session|thread|task|turn|run|workflow|build)\s+([a-z0-9][a-z0-9_.:-]{7,127})\b"
PULL_REQUEST = r"(?iuU)\b(?:pr|pull[\s-]+request)\s*#?\s*(\d{1,12})\b|#(\d{1,12})\b"
VERSION = r"(?iuU)\bv?([0-9]{1,4}(?:\.[0-9a-z]+){2,}(?:[-+][0-9a-z.-]+)?)\b"
COMMIT = r"(?iuU)\b[0-9a-f]{7,40}\b"
GITHUB_REPO = r"(?iuU)(?:https?://)?github\.com/([a-z0-9_.-]+)/([a-z0-9_.-]+)(?:/[\w./?#=&%-]*)?"
OWNER_REPO = r"(?iuU)\b([a-z0-9_.-]{1,64})/([a-z0-9_.-]{2,100})\b"
NAMED_REPO = r"""(?iuU)\b(?:repo|repository|project)\s+(?:named\s+|called\s+)?[`"']?([a-z0-9][a-z0-9_.-]{1,99})"""
SLUG = r"(?iuU)\b[a-z0-9]+(?:-[a-z0-9]+){2,}(?:\.git)?\b"

# Patterns of secrets, in the order they are applied, with their replacements -------------------------------------
_BEGIN, _END = r"(?<![A-Za-z0-9_])", r"(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])"
_KEYWORDS = (
    r"api[_-]?key|access[_-]?token|refresh[_-]?token|token|secret|client[_-]?secret|password|passwd|private[_-]?key|authorization|cookie"
    r"|API[_-]?KEY|ACCESS[_-]?TOKEN|REFRESH[_-]?TOKEN|TOKEN|SECRET|CLIENT[_-]?SECRET|PASSWORD|PASSWD|PRIVATE[_-]?KEY|AUTHORIZATION|COOKIE"
)
TERMINAL_CONTROLS = (
    r"(?:\x1b\[|\x9b)[^\x40-\x7e]*+[\x40-\x7e]?"
    r"|(?:\x1b\]|\x9d)[^\x07\x9c\x1b]*+(?:\x1b(?!\\)[^\x07\x9c\x1b]*+)*+(?:\x07|\x9c|\x1b\\)?"
    r"|\x1b(?s:.)?"
    r"|[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f\x{61c}\x{200e}\x{200f}\x{202a}-\x{202e}\x{2066}-\x{206f}\x{feff}]"
)
ANY_CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f\x{61c}\x{200e}\x{200f}\x{202a}-\x{202e}\x{2066}-\x{206f}\x{feff}]"
SECRETS = [
    (r"(?s)-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----.*?-----END [A-Z0-9 ]*PRIVATE KEY-----", "[REDACTED:PRIVATE_KEY]"),
    (_BEGIN + r"(?:Bearer|bearer|BEARER)[ \t]+[A-Za-z0-9._~+/=-]{4,}", "Bearer [REDACTED:BEARER]"),
    (_BEGIN + r"(?:Basic|basic|BASIC)[ \t]+[A-Za-z0-9+/]{4,}={0,2}", "Basic [REDACTED:BASIC]"),
    (_BEGIN + r"eyJ[A-Za-z0-9_-]{4,}\.[A-Za-z0-9_-]{4,}\.[A-Za-z0-9_-]{4,}" + _END, "[REDACTED:JWT]"),
    (
        _BEGIN + r"(?:sk-(?:proj-)?[A-Za-z0-9_-]{8,}|github_pat_[A-Za-z0-9_]{8,}|gh[pousr]_[A-Za-z0-9]{8,}|xox[baprs]-[A-Za-z0-9-]{8,}"
        r"|npm_[A-Za-z0-9]{8,}|AIza[A-Za-z0-9_-]{12,}|AKIA[0-9A-Z]{16})" + _END,
        "[REDACTED:TOKEN]",
    ),
    (r'("(?:[^"]*_)?(?:' + _KEYWORDS + r')"[ \t]*:[ \t]*")([^"\r\n]*)(")', "$1[REDACTED:SECRET]$3"),
    (
        r"(?md)^([ \t]*(?:(?:export|EXPORT)[ \t]+)?[A-Za-z][A-Za-z0-9_]*(?:API_?KEY|TOKEN|SECRET|PASSWORD|PASSWD|PRIVATE_?KEY|CLIENT_?SECRET"
        r"|AUTHORIZATION|COOKIE|api_?key|token|secret|password|passwd|private_?key|client_?secret|authorization|cookie)[A-Za-z0-9_]*[ \t]*=[ \t]*)"
        r"""(?:"[^"\r\n]*"|'[^'\r\n]*'|[^\x20\t#\r\n]+)""",
        "$1[REDACTED:SECRET]",
    ),
    (_BEGIN + r"((?:" + _KEYWORDS + r")[ \t]*[:=][ \t]*)" + r"""(?:"[^"\r\n]*"|'[^'\r\n]*'|[^\x20\t,;\r\n]+)""", "$1[REDACTED:SECRET]"),
]

# Names and formats of records and output -------------------------------------------------------------------------
WIRE_ROLES = ["user", "assistant", "tool", "developer", "system"]
ATTACHMENT_KEYS = ["images", "local_images", "audio", "local_audio"]
CONTENT_KEYS = ["text", "input_text", "output_text"]
TOOL_CALLS = ["function_call", "custom_tool_call", "tool_search_call"]
ARGUMENT_KEYS = ["arguments", "input", "args"]
CITATION = ("codex://session/", "#event-")
DEFAULT_SOURCES = ["~/.codex/sessions", "~/.codex/archived_sessions"]
MARKDOWN_TITLE, MARKDOWN_NONE = "# Dossier: ", "\nNo matching Codex evidence was found.\n"
MARKDOWN_EVIDENCE, MARKDOWN_END = "\n## Evidence\n", "\nThis is cited evidence, not a generated answer.\n"
ERROR_TERMS = "query does not contain searchable Codex-history terms"
ERROR_SESSIONS, ERROR_EVIDENCE, ERROR_CONTEXT = "max_sessions must be between 1 and 20", "max_evidence must be between 1 and 100", "context must be between 0 and 3"
