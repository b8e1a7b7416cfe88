"""Regular expressions and word lists as data, put together from named pieces.

They are in Python's syntax; `java()` says the same to Java's engine.
"""

from __future__ import annotations

OCTET = r"(?:25[0-5]|2[0-4]\d|1\d{2}|[1-9]?\d)"
WEB = r'https?://[^\s<>"{}|\\^`\[\]]+'
MAIL = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-z|A-Z]{2,}\b"
NUMBER = r"\b\d+(?:\.\d+)?\b"
WORD = r"\b\w+\b"
IDENTIFIER = r"\b[_a-zA-Z][_0-9a-zA-Z]*\b"
HEX = "0x[a-fA-F0-9]+|[a-fA-F0-9]{4,}"

DATE = r"\b(?:19|20)\d{2}[-/]\d{1,2}[-/]\d{1,2}|\b\d{1,2}[-/]\d{1,2}[-/](?:19|20)\d{2}|\b\d{1,2}:\d{2}:\d{2}\b"
HAN = "一-龥"
COMPANY_ENDINGS = ("Corporation", "Company", "Limited", "Corp", "Inc", "LLC", "Ltd", "有限公司", "公司", "软件", "科技")

#: kind -> (pattern, whether case is ignored, what replaces it), the earlier first where two begin at one place.
PERSONAL: dict[str, tuple[str, bool, str]] = {
    "url": (WEB, False, "<URL>"),
    "email": (MAIL, False, "<EMAIL>"),
    "id_card": (r"\b\d{15}|\d{17}[Xx\d]\b", False, "<ID_CARD>"),
    "phone": (r"(?<!\d)1[3-9]\d{9}(?!\d)|\b\d{3,4}[\s-]?\d{7,8}\b", False, "<PHONE>"),
    "ip_address": (rf"\b{OCTET}(?:\.{OCTET}){{3}}\b", False, "<IP_ADDRESS>"),
    "employee_id": (r"\b(?:employee|emp|worker|staff|id)[_:-]?\d{3,}\b|\b[A-Z]{2,}\d{3,}\b", True, "<EMPLOYEE_ID>"),
    "datetime": (DATE, False, "<DATE>"),
    "person_name": (rf"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)+\b|\b[{HAN}]{{2,4}}\b(?![{HAN}])", False, "<NAME>"),
    "organization": (r"\b[a-zA-Z][\s\w]*(?:" + "|".join(COMPANY_ENDINGS) + r")\b", True, "<ORGANIZATION>"),
}

#: Comments that carry nothing for a reader. All ignore case.
VOID_COMMENTS = [
    r"\b(?:fixme|todo|xxx|hack|warning:|attention:|note:)\b.*$",
    r"\b(?:authored?|coded?|created?|written?)\s+(?::|by)\s+\w+",
    r"\bversion\s*:?\s*[.\d]+.*$",
    r"\bv\d+\.\d+(?:\.\d+)?.*$",
    r"\b(?:modified?|updated?|changed?)\s+(?::|by)\s+\w+.*$",
    r"\b(?:time|date)\s*:?\s*\d+.*$",
]

_YEARS = r"\s*(?:\d{4}\s*)?(?:\s*-\s*\d{4})?\s*"
#: Licence and copyright notices. All ignore case.
NOTICES = [
    r"\bcopyright\s+[(c)©]?" + _YEARS + r"[^\n]+",
    "©" + _YEARS + r"[^\n]+",
    "all rights reserved.*?$",
    r"licensed under\s+[^\n]+",
    r"\bmit\s+license\b",
    r"\bapache\s+license\b",
    r"\bgpl\b.*$",
]

STOP_WORDS = sorted(
    [
        *"a an the this that these those".split(), *"and but or".split(), *"at by for in of on to with".split(),
        *"i me you he him she her it we us they them".split(), *"be been being is are was were".split(),
        *"do does did have has had can could may might must should will would".split(),
    ]
)

#: extension -> language, by language
_EXTENSIONS = {
    "c": "c h", "cangjie": "cj", "cpp": "cpp", "csharp": "cs", "css": "css", "go": "go", "html": "html", "java": "java",
    "javascript": "js jsx", "json": "json", "kotlin": "kt", "markdown": "md", "matlab": "m", "php": "php", "python": "py", "r": "r",
    "ruby": "rb", "rust": "rs", "scala": "scala", "shell": "sh", "sql": "sql", "svelte": "svelte", "swift": "swift", "text": "txt",
    "typescript": "ts tsx", "vue": "vue", "xml": "xml", "yaml": "yaml yml",
}
LANGUAGES = {"." + e: language for language, own in _EXTENSIONS.items() for e in own.split()}


_WORD, _SPACE = r"\p{L}\p{N}_", r"\s\x1c-\x1f"


def java(pattern: str, ignore_case: bool = False) -> str:
    """A pattern in Python's syntax for Java's engine: Unicode classes, line feed alone as line end, and Python's notion of word
    characters (any numeral, no combining marks) and of white space."""
    out, inside, i = [], False, 0
    while i < len(pattern):
        c = pattern[i : i + 2] if pattern[i] == "\\" else pattern[i]
        i += len(c)
        if c == "[" and not inside:
            inside = True
        elif c == "]" and inside:
            inside = False
        elif c in (r"\w", r"\s"):
            chars = _WORD if c == r"\w" else _SPACE
            c = chars if inside else f"[{chars}]"
        elif c == r"\b":
            c = f"(?:(?<=[{_WORD}])(?![{_WORD}])|(?<![{_WORD}])(?=[{_WORD}]))"
        out.append(c)
    return ("(?Udiu)" if ignore_case else "(?Ud)") + "".join(out)
