"""Word lists, prices, limits and patterns that results depend on."""

from __future__ import annotations

# Acknowledgements that are never an ask.
CONTINUATIONS = (
    "yes", "y", "yeah", "yep", "ok", "okay", "k", "sure", "continue", "go on", "go ahead", "thanks", "thank you", "thx", "no", "nope", "nah",
    "try again", "fix it", "do it", "please", "please continue", "lgtm", "looks good", "done", "ship it",
)
# How a later turn begins that corrects and doesn't ask anew.
CORRECTION_PREFIXES = (
    "actually", "wait", "no wait", "never mind", "nevermind", "i meant", "i mean", "instead", "rather", "change that", "update that", "make it",
    "make that", "fix that", "fix the typo", "also just", "one more thing", "sorry", "my bad", "on second thought", "don't", "do not", "remove that", "undo",
)
# Verbs of an ask.
IMPERATIVE_VERBS = (
    "add", "build", "change", "check", "clean", "create", "debug", "delete", "deploy", "document", "explain", "extract", "find", "fix", "generate",
    "implement", "improve", "investigate", "migrate", "move", "optimize", "parse", "patch", "refactor", "remove", "rename", "replace", "rewrite",
    "run", "set", "ship", "show", "simplify", "summarize", "test", "update", "upgrade", "wire", "write", "compare", "review", "resolve", "handle",
    "support", "convert", "install", "configure", "setup", "make", "help", "please", "can", "could", "would", "need", "want", "look", "inspect",
    "trace", "profile", "benchmark", "commit", "push", "merge", "rebase", "draft", "design", "plan", "scaffold", "stub", "mock", "assert", "ensure",
    "verify", "validate", "audit", "rank", "cluster", "normalize", "discover", "render", "cost", "redact", "publish", "bump", "polish",
)
# Words that don't tell asks apart.
STOPWORDS = (
    "a", "an", "the", "and", "or", "but", "if", "then", "else", "when", "while", "of", "at", "by", "for", "with", "about", "against", "between",
    "into", "through", "during", "before", "after", "above", "below", "to", "from", "up", "down", "in", "out", "on", "off", "over", "under", "again",
    "further", "once", "here", "there", "all", "each", "few", "more", "most", "other", "some", "such", "no", "nor", "not", "only", "own", "same",
    "so", "than", "too", "very", "can", "will", "just", "don", "should", "now", "i", "me", "my", "we", "our", "you", "your", "it", "its", "this",
    "that", "these", "those", "is", "am", "are", "was", "were", "be", "been", "being", "have", "has", "had", "having", "do", "does", "did", "doing",
    "please", "also", "like", "get", "got", "using", "use", "used",
)
# Sentences of shared templates, left out of the compared text.
BOILERPLATE_PHRASES = (
    "implement the plan as specified", "it is attached for your reference", "do not edit the plan file itself", "do not edit the plan", "do not edit files",
    "to-do's from the plan have already been created", "todos from the plan have already been created", "do not create them again",
    "mark them as in_progress as you work, starting with the first one", "mark them as in_progress as you work",
    "don't stop until you have completed all the to-dos", "don't stop until you have completed all the todos", "dont stop until you have completed all the to-dos",
    "read-only exploration", "read only exploration", "return exact", "focus on:", "find and summarize:",
)
# How a remark about the conversation begins.
META_PREFIXES = ("fair \u2014", "fair\u2014", "fair -", "fair,", "you're right", "you\u2019re right", "youre right", "you are right", "sorry", "i mixed", "actually")
# Phrases that ask for files, tried in this order; words that may stand beside file names.
FILE_FETCH_PHRASES = (
    "send me this file please", "send me these files please", "send me this file", "send me these files", "send this file please",
    "please send me this file", "please send me", "send me this", "send me",
)
FILE_FETCH_FILLER = ("and", "or", "the", "file", "files", "this", "these", "please", "a")
# Words that may stand between a softener and its verb.
SOFT_WORDS = ("you", "me", "us", "to", "the", "a", "an")
# Marks of pasted stack traces and code.
STACK_HINTS = ("traceback (most recent call last)", "exception in thread", "caused by:", "fatal error:", "panic:", "stack trace", 'file "/', "file '/", "at com.", "at org.")
STACK_START = r"(?im)^(traceback \(most recent call last\)|fatal error:|panic:|exception in thread|stack trace)"
CODE_LINE_HINTS = ("import ", "from ", "def ", "class ", "function ", "const ", "let ", "var ", "public ", "private ", "package ", "#!/", "```")
# Limits of texts.
MAX_INTENT_CHARS, MIN_INTENT_CHARS = 1200, 25
NORMALIZED_MAX_CHARS, NORMALIZED_MAX_TOKENS = 400, 30
# Clustering thresholds and the length of a label.
SIMILARITY_THRESHOLD, MIN_COHESION, LABEL_LIMIT = 0.45, 0.35, 70
# Openers that make poor labels, verbs that make good ones, words that say nothing in one.
LABEL_PENALTY_PREFIXES = (
    "confirmed", "fair \u2014", "fair\u2014", "fair -", "fair,", "fair ", "you're right", "you\u2019re right", "youre right", "sorry", "thanks", "thank you",
    "okay", "ok,", "yes,", "yeah,",
)
LABEL_VERBS = (
    "add", "build", "change", "check", "clean", "compare", "configure", "create", "debug", "delete", "deploy", "design", "document", "explore",
    "explain", "extract", "find", "fix", "generate", "harden", "implement", "improve", "inspect", "investigate", "migrate", "move", "optimize",
    "parse", "patch", "refactor", "remove", "rename", "replace", "rewrite", "run", "scaffold", "set", "ship", "show", "simplify", "summarize", "test",
    "update", "upgrade", "verify", "wire", "write", "review", "resolve", "support", "install", "make", "help", "please", "can", "could", "would",
    "need", "look", "read", "re-run", "rerun",
)
NON_CONTENT = ("<path>", "<url>", "<sha>", "<id>", "<num>", "<str>", "please", "also", "just", "help", "need", "want")
# Words that count as one term.
TOKEN_FOLD = {
    "authentication": "auth", "authenticate": "auth", "authorisation": "auth", "authorization": "auth", "tests": "test", "testing": "test",
    "suites": "suite", "failures": "fail", "failing": "fail", "failed": "fail", "failure": "fail", "repair": "fix", "repairs": "fix",
    "repairing": "fix", "fixed": "fix", "fixes": "fix", "fixing": "fix", "rewrite": "write", "rewriting": "write", "rewrote": "write",
    "writing": "write", "written": "write", "explains": "explain", "explained": "explain", "understands": "understand",
    "understanding": "understand", "scaffolding": "scaffold", "modules": "module", "flags": "flag", "records": "record", "helpers": "helper",
    "intents": "intent", "paths": "path", "urls": "url", "shas": "sha", "reports": "report", "attacks": "attack", "fixtures": "fixture",
    "sessions": "session", "projects": "project",
}
# Tools and commands that change nothing, and those that do.
MUTATING_TOOLS = ("strreplace", "write", "edit", "delete", "editnotebook", "applypatch")
SHELL_TOOLS = ("shell", "bash", "terminal")
READ_TOOLS, SEARCH_TOOLS = ("read", "readfile"), ("glob", "grep")
READONLY_COMMANDS = (
    "ls", "dir", "cat", "head", "tail", "less", "more", "bat", "grep", "egrep", "fgrep", "rg", "ag", "ack", "find", "fd", "locate", "wc", "file",
    "stat", "pwd", "which", "type", "echo", "printf", "true", "false", "test", "dirname", "basename", "realpath", "readlink", "tree", "md5sum",
    "sha256sum", "sha1sum", "cksum", "env", "printenv", "date", "uname", "whoami", "id", "hostname", "jq", "sed", "awk", "cut", "sort", "uniq", "tr",
    "diff", "cmp", "column", "nl", "od", "hexdump", "strings", "cd",
)
GIT_READONLY = (
    "status", "log", "diff", "show", "blame", "ls-files", "ls-tree", "rev-parse", "describe", "branch", "tag", "remote", "config", "shortlog",
    "whatchanged", "cat-file", "name-rev", "symbolic-ref", "rev-list", "range-diff",
)
COMMAND_PREFIXES = ("sudo", "command", "time", "nice", "nohup", "env", "stdbuf")
MIN_RESOLVABLE = 5
# USD per million tokens, as of 2026-09-03.
PRICES = (
    ("default", 3.0, 15.0, 0.30),
    ("claude-opus-4", 15.0, 75.0, 1.50),
    ("claude-sonnet-4", 3.0, 15.0, 0.30),
    ("claude-haiku-4", 1.0, 5.0, 0.10),
    ("claude-3-5-sonnet", 3.0, 15.0, 0.30),
    ("claude-3-opus", 15.0, 75.0, 1.50),
    ("gpt-4.1", 2.0, 8.0, 0.50),
    ("gpt-4o", 2.5, 10.0, 1.25),
    ("gpt-4o-mini", 0.15, 0.60, 0.075),
    ("o3", 2.0, 8.0, 0.50),
    ("o4-mini", 1.1, 4.4, 0.275),
)
# Secrets that reports must not show, replaced in this order, and the length of evidence.
SECRET_PATTERNS = (
    r"\bsk-[A-Za-z0-9_-]{10,}\b", r"\bghp_[A-Za-z0-9]{20,}\b", r"\bAKIA[0-9A-Z]{16}\b", r"(?i)Bearer\s+[A-Za-z0-9._\-+=/]{8,}", r"\b[A-Za-z0-9+/]{40,}={0,2}\b",
)
EVIDENCE_LIMIT = 120
# Names of months in time stamps.
MONTHS = {
    "jan": 1, "january": 1,
    "feb": 2, "february": 2,
    "mar": 3, "march": 3,
    "apr": 4, "april": 4,
    "may": 5,
    "jun": 6, "june": 6,
    "jul": 7, "july": 7,
    "aug": 8, "august": 8,
    "sep": 9, "september": 9, "sept": 9,
    "oct": 10, "october": 10,
    "nov": 11, "november": 11,
    "dec": 12, "december": 12,
}
