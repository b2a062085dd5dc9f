"""Text functions as Column expressions: they stay in the JVM and inside code generation.

Three normalisers serve three purposes and are kept apart: ``norm_query`` for
queries, ``norm_store`` for stored keys, ``norm_fts`` for indexed message text.
Regular expressions ask for Unicode classes with ``(?U)`` where white space or
word characters are meant in that sense.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ARABIC = "؀-ۿ"


def _text(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def remove_diacritics(c: Column | str) -> Column:
    """Without harakat, superscript alef and tatweel."""
    return F.regexp_replace(_text(c), "[ً-ٰٟـ]", "")


def normalize_alef(c: Column | str) -> Column:
    return F.translate(_text(c), "آأإ", "ااا")


def normalize_hamza(c: Column | str) -> Column:
    """Hamza carriers to their letters, lone hamza to nothing, Persian kaf and yeh to Arabic ones."""
    return F.translate(_text(c), "ؤئکیء", "ويكي")


def normalize_yaa(c: Column | str) -> Column:
    return F.translate(_text(c), "ى", "ي")


def normalize_ta_marbuta(c: Column | str) -> Column:
    return F.translate(_text(c), "ة", "ه")


def _if_arabic(c: Column, form: Column) -> Column:
    """``form``, which changes only Arabic letters and marks: other texts are spared its passes."""
    return F.when(c.rlike(f"[{ARABIC}]"), form).otherwise(c)


def normalize_whitespace(c: Column | str) -> Column:
    return F.trim(F.regexp_replace(_text(c), r"(?U)\s+", " "))


def norm_query(c: Column | str) -> Column:
    """Normal form of a query; null becomes empty, feminine endings stay."""
    c = F.coalesce(_text(c), F.lit(""))
    return normalize_whitespace(_if_arabic(c, normalize_yaa(normalize_hamza(normalize_alef(remove_diacritics(c))))))


def norm_store(c: Column | str) -> Column:
    """Normal form of stored keys: tatweel and hamza stay, feminine endings go."""
    c = _text(c)
    bare = F.translate(F.regexp_replace(c, "[ً-ٟؐ-ؚٰ]", ""), "إأآٱىة", "اااايه")
    return normalize_whitespace(_if_arabic(c, bare))


def norm_fts(c: Column | str) -> Column:
    """Normal form of indexed text. Composes hamza and madda first, as canonical composition would."""
    c = bare = _text(c)
    for pair, one in (("آ", "آ"), ("أ", "أ"), ("إ", "إ"), ("ؤ", "ؤ"), ("ئ", "ئ")):
        bare = F.replace(bare, F.lit(pair), F.lit(one))
    bare = F.regexp_replace(bare, "[ً-ٰٟۖ-ۜ۟-۪ۨ-ۭ]", "")
    return F.trim(_if_arabic(c, F.translate(bare, "أإآٱىئة", "ااااييه")))


def is_arabic(c: Column | str) -> Column:
    return F.coalesce(_text(c).rlike(f"[{ARABIC}]"), F.lit(False))


def arabic_ratio(c: Column | str) -> Column:
    """Arabic characters over all but white space; 0 for blank text."""
    c = F.coalesce(_text(c), F.lit(""))
    solid = F.length(F.regexp_replace(c, r"(?U)\s+", ""))
    return F.when(solid > 0, F.length(F.regexp_replace(c, f"[^{ARABIC}]+", "")) / solid).otherwise(F.lit(0.0))


def is_arabic_heavy(c: Column | str, least: float = 0.3) -> Column:
    c = F.coalesce(_text(c), F.lit(""))
    # A text with an Arabic letter is not blank, and one without has a ratio of 0, which need not be worked out.
    some = is_arabic(c) if least > 0 else F.length(normalize_whitespace(c)) > 0
    return some & (arabic_ratio(c) >= least)


def clean_chunk(c: Column | str, most: int = 300, least: int = 15) -> Column:
    """Display form: no marks or control characters, one line, cut at a space; empty when too short to tell anything."""
    c = F.coalesce(_text(c), F.lit(""))
    c = F.replace(F.replace(c, F.lit(">>>"), F.lit("")), F.lit("<<<"), F.lit(""))
    c = F.regexp_replace(c, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]", "")
    c = F.regexp_replace(c, r"\\r\\n|\\n|\\t", " ")
    c = normalize_whitespace(c)
    head = F.substring(c, 1, most)
    cut = F.when(F.instr(head, " ") > 0, F.regexp_replace(head, r" [^ ]*$", "")).otherwise(head)
    c = F.when(F.length(c) > most, F.concat(cut, F.lit("..."))).otherwise(c)
    return F.when(F.length(c) >= least, c).otherwise(F.lit(""))


def format_age(seconds: Column | str) -> Column:
    s = _text(seconds)
    told = lambda unit, sign: F.concat(F.floor(s / unit).cast("string"), F.lit(f"{sign} ago"))
    return F.when(s < 60, "now").when(s < 3600, told(60, "m")).when(s < 86400, told(3600, "h")).otherwise(told(86400, "d"))


def format_size(size: Column | str) -> Column:
    """One decimal, halves to even."""
    s = _text(size).cast("double")
    told = lambda power, unit: F.format_string(f"%.1f {unit}", F.bround(s / 1024.0**power, 1))
    out = told(4, "TB")
    for power, unit in reversed(list(enumerate(("B", "KB", "MB", "GB")))):
        out = F.when(s < 1024.0 ** (power + 1), told(power, unit)).otherwise(out)
    return out


# What a node's text begins with if it is code, and the letters and signs that make it Arabic.
CODE_STARTS = ["def ", "class ", "import ", "from ", "function ", "const ", "let ", "var "]
ARABIC_SIGNS = "؟۔،؛ءآأإابتثجحخدذرزسشصضطظعغفقكلمنهوي"


def detect_type(c: Column | str, bang_is_arabic: bool = False) -> Column:
    """``code``, ``arabic`` or ``text``. An exclamation mark counts as Arabic only on demand."""
    c = F.trim(F.coalesce(_text(c), F.lit("")))
    code = F.lit(False)
    for start in CODE_STARTS:
        code = code | c.startswith(start)
    return F.when(code, "code").when(c.rlike(f"[{ARABIC_SIGNS}{'!' if bang_is_arabic else ''}]"), "arabic").otherwise("text")


def fact_hash(key: Column | str) -> Column:
    """Identity of a fact: MD5 of the key's stored form."""
    return F.md5(norm_store(key))


def node_id(key: Column | str) -> Column:
    return F.concat(F.lit("fact_"), F.substring(F.md5(_text(key)), 1, 12))


# Trust of each importance.
TRUST = {1: 0.3, 2: 0.5, 3: 0.7, 4: 0.85, 5: 1.0}


def trust_of(importance: Column | str) -> Column:
    table = F.create_map(*(F.lit(x) for pair in TRUST.items() for x in pair))
    return F.coalesce(F.try_element_at(table, _text(importance).cast("int")), F.lit(0.5))


def importance_of(trust: Column | str) -> Column:
    """Half to even, so 0.5 gives 2."""
    return F.bround(_text(trust) * 5, 0).cast("int")


def truncated(c: Column | str, most: int = 500, mark: str = "... [truncated]") -> Column:
    c = _text(c)
    return F.when(F.length(c) > most, F.concat(F.substring(c, 1, most), F.lit(mark))).otherwise(c)


def parse_time(c: Column | str, otherwise: Column | None = None) -> Column:
    """ISO text or epoch seconds as a timestamp; ``otherwise`` (null) when it is neither."""
    c = _text(c)
    number = c.try_cast("double") if hasattr(c, "try_cast") else c.cast("double")
    found = F.when(number > 1e9, F.timestamp_micros((number * 1e6).cast("long"))).otherwise(F.try_to_timestamp(c))
    return F.coalesce(found, otherwise) if otherwise is not None else found


# Platform names, and entity patterns, by type, of the current and of the older extractor.
PLATFORMS = ["Multica", "Telegram", "OpenClaw", "Claude", "Qwen", "Gemma", "WSL"]


def platform_pattern(names: list[str]) -> tuple[str, str]:
    """The pattern of platform names; add the host agent's own name to the list."""
    return "platform", rf"\b({'|'.join(names)})\b"


ENTITIES = [
    platform_pattern([*PLATFORMS, "Ollama"]),
    ("telegram_bot", r"@([A-Za-z0-9_]+bot)"),
    ("version", r"\b(v?\d+\.\d+(?:\.\d+)?)\b"),
    ("port", r"(?:port|gateway)\s+(\d{4,5})"),
    ("file_path", r"(/[^\s]{10,})"),
]
OLDER_ENTITIES = [
    ("person", r"[@]?([A-Z][a-z]+(?:\s+[A-Z][a-z]+)+)"),
    ("telegram_bot", r"@([A-Za-z0-9_]+bot)"),
    platform_pattern(PLATFORMS),
    ("port", r"(?:port|gateway|api_server)\s+(\d{4,5})"),
    ("file_path", r"(/[^\s]{5,})"),
    ("version", r"\b(v?\d+\.\d+\.\d+)\b"),
]


def entities(c: Column | str, patterns: list[tuple[str, str]] = ENTITIES) -> Column:
    """Distinct structs ``(name, type)`` of all patterns' matches of two characters or more."""

    def of(kind: str, pattern: str) -> Column:
        names = F.regexp_extract_all(F.coalesce(_text(c), F.lit("")), F.lit(pattern), F.lit(1))
        return F.transform(names, lambda n: F.struct(n.alias("name"), F.lit(kind).alias("type")))

    found = [of(kind, p) for kind, p in patterns]
    return F.array_distinct(F.filter(F.concat(*found), lambda e: F.length(e["name"]) >= 2))


def passes_gate(query: Column | str, least: int = 2, letters: str | None = "[ء-يa-zA-Z0-9]") -> Column:
    """Long enough to search for, and, unless ``letters`` is None, with a letter or digit of the class."""
    q = F.trim(F.coalesce(_text(query), F.lit("")))
    good = F.length(q) >= least
    return good & q.rlike(letters) if letters else good


def expand_query(query: Column | str, synonyms: dict[str, list[str]], most: int = 3) -> Column:
    """The query with up to ``most`` synonyms a word, of three characters or more, appended once each."""
    q = _text(query)
    if not synonyms:
        return q
    table = F.create_map(*(x for w, s in synonyms.items() for x in (F.lit(w), F.array(*(F.lit(y) for y in s[:most] if len(y) > 2)).cast("array<string>"))))
    words = F.transform(F.split(norm_query(q), " "), lambda w: F.regexp_replace(w, "[؟!.,:;،؛]+$", ""))
    more = F.array_distinct(F.flatten(F.transform(words, lambda w: F.coalesce(F.try_element_at(table, w), F.array().cast("array<string>")))))
    return F.when(F.size(more) > 0, F.concat(q, F.lit(" "), F.array_join(F.array_sort(more), " "))).otherwise(q)
