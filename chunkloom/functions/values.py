"""Fixed values that results depend on."""

# Element types.
SKIPPED_TYPES = ("page_header", "page_footer", "footnote_reference")
ATOMIC_TYPES = ("code", "table", "formula", "picture", "chart", "figure")
VISUAL_TYPES = ("picture", "chart", "figure")
PROSE_TYPES = ("text", "list_item", "paragraph", "caption", "footnote")
BLOCK_KINDS = {"code": "code_block", "table": "table_block", "formula": "formula_block"}
PASSABLE_KINDS = ("code_block", "table_block", "formula_block", "visual_block")

# Abbreviations before a full stop that end no sentence.
ABBREVIATIONS = (
    "dr", "mr", "mrs", "ms", "prof", "sr", "jr",
    "etc", "vs", "i.e", "e.g", "fig", "vol",
    "no", "nos", "p", "pp", "ch", "sec",
    "u.s", "u.k", "e.u", "ph.d", "b.s", "b.a", "m.s", "m.a",
    "inc", "ltd", "corp", "dept", "approx", "govt",
    "jan", "feb", "mar", "apr", "jun", "jul", "aug",
    "sep", "oct", "nov", "dec",
)

# Headings of sections that are left out.
BACKMATTER_RE = (
    r"^(?:References|Bibliography|Works\s+Cited|Literature|Cited\s+Works|Acknowledge?ments?|Author\s+Contributions?"
    r"|Conflicts?\s+of\s+Interest|Funding|Data\s+Availability|Supplementary\s+Materials?|Competing\s+Interests?|Disclosure)\s*$"
)

# What introduces or captions a block.
INTRO_RE = r"(?::\s*$|as follows|below|following\s+(?:code|table|figure|chart|listing|example))"
CAPTION_RE = r"^(?:Table|Figure|Fig\.|Chart|Listing|Eq\.)\s*\d"
CONTEXT_TOKENS = 60

# Headings.
NUMBERED_RE = r"^\s*(?:\d+(\.\d+)*\.?|[A-Z](\.\d+)*\.?)\s+\S"
HEADING_CHARS = (3, 120)
FRAGMENT_RE = r"[a-z]\.\s*$|\.\s+[a-z]"
LEVEL_RE = r"^section_header_level_(\d+)$"
STYLE_RE = r"(?i)heading\s*(\d)"

# What a line of Markdown is.
ATX_RE = r"^(#{1,6})\s+(.*?)\s*#*\s*$"
FENCE_RE = r"^\s*(`{3,}|~{3,})(.*)$"
ITEM_RE = r"^\s*(?:[-*+]|\d+[.)])\s+(.*)$"
IMAGE_RE = r"^\s*!\[([^\]]*)\]\([^)]*\)\s*$"
BREAK_RE = r"^\s*(?:-(?:\s*-){2,}|\*(?:\s*\*){2,}|_(?:\s*_){2,})\s*$"
UNDERLINE_RE = r"^\s*(?:=+|-+)\s*$"
TABLE_RULE_RE = r"^\s*\|?\s*:?-{1,}:?\s*(?:\|\s*:?-{1,}:?\s*)+\|?\s*$"
PIPE_ROW_RE = r"^\s*\|.*\|\s*$"
QUOTE_RE = r"^\s*>\s?"
MATH_MARKS = {"$$": "$$", "\\[": "\\]"}

# Where code, tables and formulas are parted.
SCRIPT_START_RE = r"(?:export\s+)?(?:async\s+)?(?:function\s+(\w+)|const\s+(\w+)\s*=\s*(?:async\s+)?\([^)]*\)\s*=>)"
SECTION_RE = r"\n\n+|(?=\n(?:def|function|class|fn)\s+\w+)"
RULE_LINE_RE = r"^\s*\|[\s\-:|]+\|\s*$"
STEP_RE = r"\\\\(?:\s*\n)?"

# Sizes in tokens.
MAX_TOKENS = 500
OVERLAP_TOKENS = 50
MIN_TOKENS = 200
LARGE_BLOCK = 800
TABLE_CHILD = 350
MERGE_BELOW = 100
BOUNDARY_THRESHOLD = 0.5

# Parser artifacts.
PREFIX_CHARS, PREFIX_ADDED, REPEAT_WINDOW = 10, 20, 8
BLEED_CHARS, BLEED_RATIO = 10, 0.85
SPAN_WORDS, SPAN_MAX = 4, 80

# Embeddings.
DIMENSIONS = 384
MAX_SENTENCE_TOKENS = 128

# Signs of a language, in the order they are tried.
PYTHON_SIGNS = ("def ", "class ", ":\n")
SCRIPT_SIGNS = ("function ", "const ", "let ", "var ", "=>", "export ")
TYPED_SIGNS = (": string", ": number", "interface ", "type ")
LANGUAGE_NAMES = {
    "python": "python", "py": "python",
    "javascript": "javascript", "js": "javascript", "jsx": "javascript",
    "typescript": "typescript", "ts": "typescript", "tsx": "typescript",
}
FORMULA_ENVIRONMENTS = ("equation", "align", "gather", "eqnarray")
